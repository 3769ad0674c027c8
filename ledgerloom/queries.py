"""Queries by name: each operator on its whole lens, with column types that both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, num, text
from ledgerloom.operators import adapt, aggregates, categorize, layout, pages, payoff, reconcile, recurring, store, transfers
from ledgerloom.plans import ask, dashboard
from ledgerloom.session import new_path
from ledgerloom.sources import lenses, statements
from ledgerloom.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text, whole numbers as bigint, lists as text: what compares alike everywhere."""
    out = []
    for f in df.schema:
        kind, x = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        elif kind in ("integer", "short", "byte"):
            x = x.cast("bigint")
        elif kind == "array":
            x = F.array_join(F.transform(x, lambda e: e.cast("string")), ",")
        out.append(x.alias(f.name))
    return df.select(*out)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
    return f


_txns = lenses.transactions


@query
def a1_summary(spark, d):
    return aggregates.summary(_txns(spark, d))


@query
def a2_by_category(spark, d):
    return aggregates.by_category(_txns(spark, d))


@query
def a3_by_month(spark, d):
    return aggregates.by_month(_txns(spark, d))


@query
def a4_account_counts(spark, d):
    return aggregates.account_counts(_txns(spark, d))


@query
def a5_transfers_excluded(spark, d):
    return aggregates.transfers_excluded(_txns(spark, d))


@query
def j1_accounts_with_counts(spark, d):
    return aggregates.accounts_with_counts(lenses.accounts(spark, d), _txns(spark, d)).select("id", "bank_name", "closing_balance", "txn_count")


@query
def o1_recent_transactions(spark, d):
    return aggregates.recent(_txns(spark, d)).select("id", "account_id", "date", "amount")


@query
def p9_filtered_transactions(spark, d):
    return aggregates.recent(_txns(spark, d), 1000, "1-URGENT", "c7").select("id", "account_id", "category", "amount")


@query
def p11_distinct_merchants(spark, d):
    return aggregates.distinct_merchants(_txns(spark, d))


@query
def p15_merchant_contains(spark, d):
    return _txns(spark, d).where(F.col("merchant").ilike("%SHOP 12%") & (F.col("amount") < 0)).groupBy("merchant").agg(F.abs(num.money_sum(F.col("amount"))).alias("spent"))


@query
def p17_rounded_averages(spark, d):
    return aggregates.rounded(_txns(spark, d).groupBy("account_id").agg((num.money_sum(F.col("amount")) / F.count("*")).alias("mean_amount"), F.max("amount").alias("largest")))


@query
def p18_empty_results(spark, d):
    txns = _txns(spark, d)
    tests = (("all", txns), ("no rows", txns.where("amount IS NULL")), ("only nulls", txns.select(F.lit(None).cast("string").alias("x"))))
    return spark.createDataFrame([(n, aggregates.is_empty_result(df)) for n, df in tests], "name string, is_empty boolean")


@query
def f36_weekend_spending(spark, d):
    out = _txns(spark, d).where(aggregates.spending() & (F.col("amount") < 0))
    weekend = F.dayofweek("date").isin(1, 7)
    return out.groupBy(weekend.alias("weekend"), F.date_trunc("week", "date").cast("date").alias("week")).agg(F.abs(num.money_sum(F.col("amount"))).alias("spent"), F.count("*").alias("n"))


@query
def f1_merchant_key(spark, d):
    return lenses.raw_descriptions(spark, d).select("key", "description", text.merchant_key(F.col("description")).alias("merchant"))


@query
def f2_title(spark, d):
    return _txns(spark, d).select("id", text.title(F.concat_ws("-x.", "merchant", F.lower("description"))).alias("titled"))


@query
def f3_account_identity(spark, d):
    acc = lenses.accounts(spark, d)
    four = text.last4(F.col("account_number"))
    return acc.select("key", text.account_type(F.col("raw_type")).alias("account_type"), four.alias("account_last4"), text.account_id(F.col("bank_name"), four, F.lit("2024-01-01")).alias("account_id"))


@query
def f7_keyword_category(spark, d):
    return _txns(spark, d).select("id", text.keyword_category(F.col("description"), F.col("amount")).alias("category"))


@query
def f8_transfer_word(spark, d):
    return _txns(spark, d).groupBy("description").agg(F.bool_or(text.transfer_word(F.col("description"))).alias("has_word"), F.bool_or(F.col("description").rlike(recurring.NO_SUBSCRIPTION)).alias("no_subscription"))


@query
def f20_to_number(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    commas = F.format_number(price, 2)
    dotted = F.translate(commas, ",.", ".,")
    bare = F.call_function("format_number", price, F.lit("0.00"))
    shown = (
        F.when(k % 7 == 0, F.concat(F.lit("$"), commas)).when(k % 7 == 1, F.concat(F.lit("("), bare, F.lit(")"))).when(k % 7 == 2, F.concat(bare, F.lit("-")))
        .when(k % 7 == 3, dotted).when(k % 7 == 4, "n/a").when(k % 7 == 5, F.translate(bare, ".", ",")).otherwise(F.concat(F.lit(" CAD "), commas, F.lit(" ")))
    )
    return lenses.table(spark, d, "orders").select(k.alias("key"), num.to_number(shown).alias("value"))


@query
def f30_parse_date(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    styles = ("yyyy-M-d", "M/d/yyyy", "yyyy/MM/dd", "MMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd")
    shown = F.date_format(day, styles[-1])
    for i, s in enumerate(styles[:-1]):
        shown = F.when(k % 6 == i, F.date_format(day, s)).otherwise(shown)
    shown = F.when(k % 41 == 0, "soon").otherwise(shown)
    return lenses.table(spark, d, "orders").select(k.alias("key"), dates.parse_date(shown).alias("date"), dates.iso_text(shown).alias("iso"))


@query
def f31_recover_date(spark, d):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    start, end = F.date_sub(day, (k % 40).cast("int")), F.date_add(day, (k % 25).cast("int"))
    shown = F.when(k % 10 == 0, "12/34 Payment").when(k % 10 == 1, "rent").otherwise(F.concat(F.date_format(day, "MM/dd"), F.lit(" rent")))
    return lenses.table(spark, d, "orders").select(k.alias("key"), dates.recover_date(shown, start, end).alias("date"))


def _ids(spark, d):
    k = F.col("o_orderkey")
    return lenses.table(spark, d, "orders").select(
        k.alias("pos"), F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("account_id"), F.trunc("o_orderdate", "month").alias("date"),
        lenses.pick(("coffee", "rent", "fuel"), k).alias("description"), (F.floor(F.col("o_totalprice") / 100000) * -12.25).alias("amount"), F.when(k % 4 != 0, "0064").alias("reference"),
    )


@query
def w2_occurrence(spark, d):
    return store.occurrence(_ids(spark, d)).select("pos", "occurrence")


@query
def f6_transaction_id(spark, d):
    return store.with_ids(_ids(spark, d)).select("pos", "id")


@query
def c5_insert_new(spark, d):
    rows = store.with_ids(_ids(spark, d))
    stored = rows.where(F.col("date") < F.lit("1998-01-01").cast("date"))
    return store.new_rows(rows.unionByName(rows), stored).select("pos", "id")


@query
def j11_upsert_accounts(spark, d):
    k = F.col("s_suppkey")
    stored = lenses.accounts(spark, d).select("id", "bank_name", "closing_balance", "apr")
    new = lenses.table(spark, d, "supplier").select(
        F.concat(F.lit("c"), (k * 7).cast("string")).alias("id"), F.when(k % 3 == 0, F.col("s_name")).alias("bank_name"), F.when(k % 2 == 0, F.col("s_acctbal")).alias("closing_balance"), F.lit(None).cast("double").alias("apr"),
    )
    return store.upsert(stored, new)


@query
def j9_update_flags(spark, d):
    txns = _txns(spark, d).select("id", "is_transfer", F.lit(False).alias("is_recurring"))
    flags = lenses.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(True).alias("is_transfer"), (F.col("o_orderkey") % 2 == 0).alias("is_recurring"))
    return store.update_flags(txns, flags)


def _statements(spark, d):
    heads = lenses.statement_headers(spark, d).withColumn("account_type", text.account_type(F.col("account_type")))
    rows = lenses.statement_rows(spark, d).withColumn("amount", num.py_round(F.coalesce("deposit", F.lit(0.0)) - F.coalesce("withdrawal", F.lit(0.0))))
    return heads, rows


@query
def c2_reconcile(spark, d):
    return reconcile.reconcile(*_statements(spark, d))


@query
def w1_running_balance(spark, d):
    heads, rows = _statements(spark, d)
    return reconcile.balance_checks(heads, rows).select("row_key", "pos", "prior", "step_ok")


@query
def a6_extraction_summary(spark, d):
    return aggregates.extraction_summary(reconcile.reconcile(*_statements(spark, d)))


@query
def a19_parser_warnings(spark, d):
    return reconcile.parser_warnings(*_statements(spark, d))


@query
def a19_parser_warnings_broken_chain(spark, d):
    return reconcile.parser_warnings(*_statements(spark, d), carry=False)


def _parsed(spark, d):
    return statements.parse(lenses.statement_documents(spark, d))[0]


@query
def c1_adapt_rows(spark, d):
    return adapt.adapt_rows(_parsed(spark, d)).select("statement_id", "pos", "date", "description", "amount", "balance")


@query
def c1_adapt_accounts(spark, d):
    parsed = statements.kept(_parsed(spark, d))
    return adapt.adapt_accounts(parsed, adapt.adapt_rows(parsed)).select("statement_id", "id", "account_last4", "account_type", "currency", "total_deposits", "total_withdrawals", "totals_source")


@query
def c15_normalize_rows(spark, d):
    return adapt.normalize_rows(_parsed(spark, d))


@query
def c15_normalize_headers(spark, d):
    parsed = statements.kept(_parsed(spark, d))
    return adapt.normalize_headers(parsed, adapt.normalize_rows(parsed))


@query
def a17_incomplete_rows(spark, d):
    return adapt.incomplete_rows(adapt.normalize_rows(_parsed(spark, d)))


@query
def s2_batch_failures(spark, d):
    docs = lenses.statement_documents(spark, d)
    spoilt = docs.select(F.concat(F.lit("x"), "statement_id").alias("statement_id"), F.when(F.col("statement_id").endswith("7"), "{").when(F.col("statement_id").endswith("3"), "").otherwise("[1]").alias("json"))
    good, failures = statements.parse(docs.unionByName(spoilt))
    return good.select("statement_id", F.lit("good").alias("reason")).unionByName(failures.select("statement_id", "reason"))


@query
def c8_find_recurring(spark, d):
    return recurring.find_recurring(lenses.bills(spark, d))


@query
def a12_recurring_totals(spark, d):
    return recurring.totals(recurring.find_recurring(lenses.bills(spark, d)))


@query
def c10_subscriptions(spark, d):
    return recurring.split_recurring(recurring.find_recurring(lenses.bills(spark, d)))[0].select("merchant", "nature", "annual_cost")


@query
def c8_flag_recurring(spark, d):
    bills = lenses.bills(spark, d)
    return recurring.flag_recurring(bills, recurring.find_recurring(bills)).select("pos", "is_recurring")


@query
def f23_minimum_payment(spark, d):
    b, apr = F.col("balance"), F.col("apr")
    return lenses.debts(spark, d).select("key", payoff.minimum_payment(b, apr).alias("minimum"), payoff.payment_for(b, apr, 36).alias("in_36"), payoff.payment_for(b, apr, 12).alias("in_12"))


@query
def f25_payoff(spark, d):
    plan = payoff.payoff(F.col("balance"), F.col("apr"), F.lit(150.0), series=False)
    return lenses.debts(spark, d).withColumn("plan", plan).select("key", "plan.months", "plan.total_interest")


@query
def c11_payoff_scenarios(spark, d):
    return payoff.payoff_table(lenses.debts(spark, d), series=False).select("key", "label", "monthly_payment", "months", "total_interest")


@query
def n12_payoff_chart(spark, d):
    return payoff.series_by_month(payoff.payoff_table(lenses.debts(spark, d)), "key").withColumnsRenamed({"36 months": "m36", "minimum plus 100": "plus100", "12 months": "m12"})


@query
def j7_transfer_candidates(spark, d):
    return transfers.candidates(lenses.legs(spark, d))


@query
def j8_transfer_pairs(spark, d):
    return transfers.pair_legs(lenses.legs(spark, d))


@query
def c7_mark_transfers(spark, d):
    marked = transfers.mark_transfers(lenses.legs(spark, d))
    return marked.groupBy("account_id").agg(F.count_if("is_transfer").alias("transfers"), num.money_sum(F.when(~F.col("is_transfer"), F.col("amount"))).alias("net_of_rest"))


def _categorized(spark, d):
    dictionary = lenses.table(spark, d, "nation").select(F.concat(F.lit("Shop "), F.col("n_nationkey").cast("string")).alias("merchant"), lenses.pick(text.CATEGORIES, F.col("n_nationkey")).alias("category"))
    cache = lenses.table(spark, d, "supplier").select(F.concat(F.lit("Shop "), (F.col("s_suppkey") % 60 + 20).cast("string")).alias("merchant"), lenses.pick(text.CATEGORIES, F.col("s_suppkey") % 60).alias("category"))
    return categorize.categorize(_txns(spark, d), dictionary, cache)


@query
def c4_categorize(spark, d):
    return _categorized(spark, d).select("id", "category", "confidence", "layer")


@query
def c18_learned_merchants(spark, d):
    return categorize.learned_merchants(_categorized(spark, d))


@query
def a13_coverage(spark, d):
    return categorize.coverage(_categorized(spark, d))


@query
def j2_resolve_merchants(spark, d):
    raw = lenses.raw_descriptions(spark, d)
    aliases = raw.select(F.concat(F.lit(" "), "description").alias("raw_description"), F.when(F.col("key") % 6 != 1, F.concat(F.lit("Alias "), (F.col("key") % 5).cast("string"))).alias("merchant"), (F.col("key") % 100).cast("string").alias("confidence"))
    return categorize.resolve_merchants(raw.withColumn("merchant", F.lit(None).cast("string")), aliases).select("key", "merchant")


@query
def j13_dictionary(spark, d):
    rows = lenses.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("merchant"), lenses.pick(text.CATEGORIES, F.col("p_partkey")).alias("category"))
    return categorize.build_dictionary(rows)[0]


@query
def c12_ingest(spark, d):
    none = spark.createDataFrame([], "merchant string, category string")
    aliases = spark.createDataFrame([], "raw_description string, merchant string, confidence string")
    led = dashboard.ingest(lenses.statement_documents(spark, d), aliases, none, none)
    return led.transactions.groupBy("statement_id").agg(F.count("*").alias("n"), num.money_sum(F.col("amount")).alias("net"))


@query
def c13_dashboard(spark, d):
    accounts = lenses.accounts(spark, d).select("id", "bank_name", "closing_balance", text.account_type(F.col("raw_type")).alias("account_type"), "apr")
    verdicts = reconcile.reconcile(*_statements(spark, d))
    blocks = dashboard.dashboard(accounts, lenses.transactions(spark, d), verdicts)
    named = {
        "summary": (F.lit("net"), F.col("net")), "by_category": (F.col("category"), F.col("amount")), "spending_over_time": (F.col("month"), F.col("amount")),
        "accounts": (F.col("id"), F.col("txn_count")), "transfers_excluded": (F.lit("both legs"), F.col("amount")), "extraction": (F.lit("statements"), F.col("statements")),
    }
    out = None
    for name, (key, value) in named.items():
        rows = blocks[name].select(F.lit(name).alias("block"), key.alias("key"), value.cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def q2_ask_templates(spark, d):
    """Each suggested question's statement through the guard, over the whole ledger."""
    out = None
    with ask.isolated(spark, transactions=_txns(spark, d), accounts=lenses.accounts(spark, d)) as inner:
        for i, sql in enumerate(ask.TEMPLATES.values()):
            df = inner.sql(ask.check(inner, sql, ("transactions", "accounts")))
            rows = df.groupBy().agg(F.count("*").alias("n"), num.money_sum(F.col("spent")).alias("spent")).select(F.lit(i).alias("template"), "n", "spent")
            out = rows if out is None else out.unionByName(rows)
    return out


def _boxes(spark, d):
    """A page for each order, a line for each of its items: date, words, one amount under one of two columns; borders."""
    line = F.col("l_linenumber")
    y = line * 20.0 + (F.col("l_partkey") % 3) * 0.5
    amount = F.format_number(F.col("l_extendedprice"), 2)
    right = F.when(F.col("l_returnflag") == "R", 480.0).otherwise(400.0) + (F.col("l_suppkey") % 4)
    boxes = F.array(
        F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("text"), F.lit(10.0).alias("x1"), F.lit(50.0).alias("x2")),
        F.struct(F.lit("|").alias("text"), F.lit(52.0).alias("x1"), F.lit(53.0).alias("x2")),
        F.struct(F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("text"), F.lit(60.0).alias("x1"), F.lit(140.0).alias("x2")),
        F.struct(amount.alias("text"), (right - 50).alias("x1"), right.alias("x2")),
    )
    rows = lenses.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(600.0).alias("width"), y.alias("y1"), (y + 10).alias("y2"), (F.col("l_quantity") * 2).alias("conf"), F.explode(boxes).alias("b"))
    return rows.select("page", "width", "b.*", "y1", "y2", "conf")


@query
def g2_number_rows(spark, d):
    numbered = layout.number_rows(layout.words_only(_boxes(spark, d)))
    return numbered.groupBy("page").agg((F.max("row") + 1).alias("rows"), F.count("*").alias("words"))


@query
def g3_columns(spark, d):
    return layout.columns(_boxes(spark, d)).withColumn("edge", num.py_round(F.col("edge"), 3))


@query
def g8_lines(spark, d):
    words = _boxes(spark, d).withColumns({"doc": F.col("page").cast("string"), "page": F.lit(0)})
    rows, heads = pages.read_pages(words)
    money = F.coalesce("amount", F.lit(0.0)) + F.coalesce("balance", F.lit(0.0))
    found = rows.groupBy("doc").agg(F.count("*").alias("transactions"), F.count_if("doubtful").alias("doubtful"), num.money_sum(money).alias("total"))
    found = heads.select("doc").join(found, "doc", "left")
    return found.select(F.col("doc").cast("bigint").alias("page"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("transactions", "doubtful", "total")))


@query
def w5_infer_signs(spark, d):
    rows = lenses.statement_rows(spark, d).withColumns({"value": F.coalesce("deposit", "withdrawal"), "opening": F.lit(1000.0)}).drop("deposit", "withdrawal")
    return layout.infer_signs(rows).select("row_key", "deposit", "withdrawal")


@query
def st1_tumbling_windows(spark, d):
    return events.drain(events.tumbling(events.read(spark, f"{d}/events.parquet")), new_path(spark, "tumbling"))


@query
def st2_deduplicated_stream(spark, d):
    stream = events.once(events.read(spark, f"{d}/events.parquet"))
    return events.drain(stream.select("event_id", "event_type", "value"), new_path(spark, "once"), "append")


@query
def st3_sessions(spark, d):
    return events.drain(events.sessions(events.read(spark, f"{d}/events.parquet")), new_path(spark, "sessions"))


HEADLINE = ("a1_summary", "a2_by_category", "a3_by_month", "j1_accounts_with_counts", "c2_reconcile", "c4_categorize", "c8_find_recurring", "c11_payoff_scenarios", "j7_transfer_candidates", "f6_transaction_id", "c1_adapt_rows", "f1_merchant_key")
