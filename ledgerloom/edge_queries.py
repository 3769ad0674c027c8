"""More queries by name: odd spellings and pages, outside answers, layouts, refusals and repeated events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates, text
from ledgerloom.operators import adapt, aggregates, categorize, layout, reconcile, recurring
from ledgerloom.plans import ask, dashboard
from ledgerloom.queries import _statements, query
from ledgerloom.session import new_path, spread, written
from ledgerloom.sources import lenses, statements
from ledgerloom.streaming import events

#: Statements and whether the guard is to refuse them; the views are transactions and accounts.
STATEMENTS = (
    ("SELECT count(*) AS n FROM transactions", False), ("WITH t AS (SELECT * FROM accounts) SELECT id FROM t", False), ("SELECT * FROM IDENTIFIER('accounts')", True),
    ("SELECT * FROM parquet.`/tmp/x`", True), ("DROP TABLE accounts", True), ("INSERT INTO accounts SELECT * FROM accounts", True), ("SELECT 1; SELECT 2", True), ("SELECT * FROM elsewhere", True),
)


def _odd_statements(spark, d):
    """A statement for each supplier, its keys in any case and with blanks, its period an object or spoken, short years."""
    k, spent = F.col("s_suppkey"), F.round(F.abs("s_acctbal"), 2)
    period = F.when(k % 3 == 0, F.lit('"Statement_Period":{"START":"2024-01-05","End ":"2024-02-04"}')).when(k % 3 == 1, F.lit('" PERIOD ":"01/05/24 to 02/04/24"')).otherwise(F.lit('"From_Date":"5 Jan 24","TO_DATE":"Feb 4, 2024"'))
    money = F.when(k % 2 == 0, F.concat(F.lit('"AMOUNT":"-'), spent.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"Money_In":'), spent.cast("string")))
    row = F.concat(F.lit('{"Posted_Date":"14/01/24"," Memo":"'), F.col("s_name"), F.lit('",'), money, F.lit("}"))
    body = F.concat(F.lit('{"BANK":"Bank '), k.cast("string"), F.lit('","ISO_Currency":"'), F.when(k % 4 == 0, "paid in eur").otherwise("£"), F.lit('",'), period, F.lit(',"Lines":['), row, F.lit("]}"))
    return lenses.table(spark, d, "supplier").select(k.alias("statement_id"), body.alias("json"))


@query
def f13_odd_keys(spark, d):
    parsed = statements.parse(_odd_statements(spark, d))[0]
    rows = adapt.normalize_rows(parsed)
    heads = adapt.normalize_headers(parsed, rows, derive=False)
    fields = heads.select("statement_id", "bank_name", "currency", "statement_period_start", "statement_period_end")
    return fields.join(rows.select("statement_id", "date", "description", "withdrawal", "deposit"), "statement_id")


@query
def s4_page_lists(spark, d):
    """Lists of three pages: of one account, or of several, by chance wrapped."""
    k = F.col("c_custkey")

    def page(i: int):
        number = F.when(k % 2 == 0, k * 10 + i).otherwise(k * 10).cast("string")
        body = F.concat(F.lit('{"Account_No":"'), number, F.lit('","rows":['), F.array_join(F.array_repeat(F.lit('{"x":1}'), i + 1), ","), F.lit("]}"))
        return F.when(k % 5 == 0, F.concat(F.lit('{"Data":'), body, F.lit("}"))).otherwise(body)

    docs = lenses.table(spark, d, "customer").select(k.alias("key"), F.concat(F.lit("["), F.concat_ws(",", *(page(i) for i in range(3))), F.lit(',"end"]')).alias("json"))
    found = statements.pages(docs)
    return found.groupBy("key", "unit").agg(F.count("*").alias("pages"), F.sum(F.size(statements.rows_of(F.col("v")))).alias("rows"))


@query
def p16_card_rates(spark, d):
    parsed = statements.parse(lenses.statement_documents(spark, d))[0]
    rate = F.substring("statement_id", 2, 20).cast("int") % 25 + F.lit(4.99)
    return adapt.adapt_accounts(parsed, adapt.adapt_rows(parsed), rate).select("statement_id", "account_type", "apr")


def _natures(spark, d):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" "), k.cast("string"))
    return lenses.table(spark, d, "part").where(k % 2 == 0).select(name.alias("merchant"), lenses.pick(("subscription", "bill", "habitual", "nonsense"), F.floor(k / 2)).alias("nature"))


@query
def c9_natures(spark, d):
    return recurring.find_recurring(lenses.bills(spark, d), _natures(spark, d)).select("merchant", "category", "nature")


@query
def o9_repeated_spending(spark, d):
    return recurring.split_recurring(recurring.find_recurring(lenses.bills(spark, d), _natures(spark, d)))[1].select("merchant", "annual_cost")


def _dictionary(spark, d):
    k = F.col("p_partkey")
    return lenses.table(spark, d, "part").select(F.concat(F.when(k % 9 == 0, "Cheque ").otherwise(""), F.lit("m"), k.cast("string")).alias("merchant"), lenses.pick(text.CATEGORIES, k).alias("category"))


@query
def c19_natures_to_ask(spark, d):
    known = _dictionary(spark, d).where(F.col("merchant").endswith("5")).select("merchant", F.lit("bill").alias("nature"))
    return recurring.natures_to_ask(_dictionary(spark, d), known)


@query
def c19_learned_natures(spark, d):
    k = F.col("p_partkey")
    part = lenses.table(spark, d, "part").select(F.concat(F.lit("m"), (k % 700).cast("string")).alias("merchant"), lenses.pick((" Subscription", "BILL", "unclear", "habitual", "?"), k).alias("nature"))
    known = lenses.table(spark, d, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("merchant"), F.lit("bill").alias("nature"))
    return recurring.learn_natures(known, part)


def _aliases(spark, d):
    texts = [(s, "M", "c", "90", "enrichment") for s in lenses.DESCRIPTIONS[::3]]
    return spark.createDataFrame(texts, "raw_description string, merchant string, category string, confidence string, source string")


@query
def a18_descriptions_to_ask(spark, d):
    txns = lenses.transactions(spark, d).withColumn("description", F.concat(F.lit(" "), "description", F.lit(" ")))
    return categorize.descriptions_to_ask(txns, _aliases(spark, d))


@query
def c19_learned_aliases(spark, d):
    k = F.col("o_orderkey")
    answers = lenses.table(spark, d, "orders").select(
        F.concat(F.lit("d"), (k % 500).cast("string")).alias("raw_description"), F.when(k % 500 % 3 != 0, F.concat(F.lit("m"), (k % 500).cast("string"))).alias("merchant"),
        F.lit("shop").alias("category"), (k % 500 % 100).cast("int").alias("confidence"), F.when(k % 500 % 7 == 0, "timeout").alias("error"),
    )
    return categorize.learn_aliases(_aliases(spark, d), answers)


#: What an enrichment says of some descriptions, in its own vocabulary, and how sure it is.
ANSWERS = (("ITEM 0", "Cafes", 95.0), ("ITEM 1", "Fuel", 40.0), ("ITEM 2", "Gaming", 90.0), ("ITEM 3", "Uncategorized", 99.0), ("ITEM 4", "Fitness", 89.5), ("ITEM 5", "nonsense", 99.0), ("ITEM 6", " Utilities ", None))
OPINIONS = ("Health", "Transportation", "Nonsense", "Other")


@query
def c4_all_layers(spark, d):
    """Every fourth row has a description that no keyword knows, and every eighth has no merchant."""
    k = F.col("pos")
    item = F.concat(F.lit("ITEM "), (F.floor(k / 4) % 12).cast("string"))
    txns = lenses.transactions(spark, d).withColumns({"description": F.when(k % 4 == 0, item).otherwise(F.col("description")), "merchant": F.when(k % 8 != 0, F.col("merchant"))})
    dictionary = lenses.table(spark, d, "nation").select(F.concat(F.lit("Shop "), F.col("n_nationkey").cast("string")).alias("merchant"), F.lit("Shopping").alias("category"))
    cache = lenses.table(spark, d, "nation").select(F.concat(F.lit("Shop "), (F.col("n_nationkey") + 20).cast("string")).alias("merchant"), F.lit("Travel").alias("category"))
    opinions = txns.where(k % 5 == 0).select("pos", lenses.pick(OPINIONS, F.floor(k / 20)).alias("category"))
    out = categorize.categorize(txns, dictionary, cache, spark.createDataFrame(ANSWERS, "description string, category string, confidence double"), opinions)
    return out.select("id", "category", "confidence", "layer")


@query
def c13_dashboard_lists(spark, d):
    """The blocks of a dashboard about what recurs and about debts."""
    bills = lenses.bills(spark, d)
    accounts = lenses.debts(spark, d).select(F.col("key").cast("string").alias("id"), F.lit("Bank").alias("bank_name"), F.lit("credit").alias("account_type"), F.col("balance").alias("closing_balance"), "apr")
    found = written(recurring.find_recurring(bills, _natures(spark, d)), "found")
    blocks = dashboard.dashboard(accounts, bills, reconcile.reconcile(*_statements(spark, d)), found=found)
    named = {
        "subscriptions": (F.col("merchant"), F.col("annual_cost")), "repeated": (F.col("merchant"), F.col("annual_cost")), "recurring_totals": (F.col("nature"), F.col("annual_cost")),
        "price_increases": (F.col("merchant"), F.col("price_change_pct")), "payoff": (F.concat_ws(" ", "id", "label"), F.col("total_interest")),
    }
    out = None
    for name, (key, value) in named.items():
        rows = blocks[name].select(F.lit(name).alias("block"), key.alias("key"), value.cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def g10_account_numbers(spark, d):
    """The head of a page for each customer: the number beside its heading, below it in two parts, or without a heading,
    and a telephone number and a date before it."""
    k = F.col("c_custkey")
    word = lambda t, x1, row: F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(x1).alias("x1"), F.lit(x1 + 40.0).alias("x2"), F.lit(row).alias("row"))
    number = F.lpad(k.cast("string"), 7, "0")
    words = [word("1-800-555-0199", 10.0, 0), word("2024-01-31", 60.0, 0), word("987654321", 10.0, 3), word(F.when(k % 3 != 2, "Account").otherwise("Client"), 300.0, 2), word(F.when(k % 2 == 0, "Number:").otherwise("No."), 345.0, 2)]
    words += [word(F.when(k % 3 == 0, F.concat(F.lit("12-"), number)).otherwise("-"), 400.0, 2), word(F.when(k % 3 == 1, F.concat(F.lit("005"), F.lit("-"))).otherwise("-"), 310.0, 3), word(F.when(k % 3 == 1, number).otherwise("-"), 320.0, 4)]
    found = lenses.table(spark, d, "customer").select(k.alias("page"), F.lit(600.0).alias("width"), F.explode(F.array(*words)).alias("w")).select("page", "width", "w.*")
    return layout.account_numbers(found)


@query
def o1_page_total(spark, d):
    txns = lenses.transactions(spark, d)
    return aggregates.page_total(txns).withColumn("page", F.lit("all")).unionByName(aggregates.page_total(txns, "1-URGENT").withColumn("page", F.lit("urgent")))


@query
def o8_top_categories(spark, d):
    return aggregates.top_categories(aggregates.by_category(lenses.transactions(spark, d)))


@query
def w9_month_over_month(spark, d):
    return aggregates.month_over_month(aggregates.by_month(lenses.transactions(spark, d)))


@query
def f33_row_dates(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    shown = F.lit("rent 5")
    for i, style in enumerate(("yyyy-M-d", "M/d/yyyy", "MMM d, yyyy", "d MMM yyyy", "MMM d", "d MMM")):
        shown = F.when(k % 7 == i, F.concat(F.date_format(day, style), F.lit(" rent"))).otherwise(shown)
    return lenses.table(spark, d, "orders").select(k.alias("key"), dates.row_date(F.split(shown, " "), F.year(day)).alias("r")).select("key", "r.date", "r.used")


def _tables(spark, d):
    """A page for each order: a header row, three lines of amounts under one or two headings, one under the balance."""
    k = F.col("o_orderkey")
    word = lambda t, x2, row: F.struct(t.alias("text") if not isinstance(t, str) else F.lit(t).alias("text"), F.lit(x2 - 40.0).alias("x1"), F.lit(x2).alias("x2"), F.lit(row).alias("row"))
    amount = F.format_number("o_totalprice", 2)
    words = [word(F.when(k % 2 == 0, "Debit").otherwise("Credits"), 300.0, 1), word("Date", 60.0, 1), word("Details", 150.0, 1), word("Balance", 500.0, 1), word("Summary", 150.0, 0)]
    words += [word(amount, 300.0 + i, i + 2) for i in range(3)] + [word(F.when(k % 3 != 0, amount).otherwise("-"), 503.0, 2)]
    orders = spread(lenses.table(spark, d, "orders"), lenses.ORDERS_A_TASK)
    return orders.select(k.alias("page"), F.lit(600.0).alias("width"), F.explode(F.array(*words)).alias("w")).select("page", "width", "w.*")


@query
def g4_header_rows(spark, d):
    words = _tables(spark, d)
    heads = layout.headings(words, layout.header_row(words))
    return layout.header_row(words).join(heads.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles")), "page")


@query
def g5_column_labels(spark, d):
    words = _tables(spark, d)
    heads = layout.headings(words, layout.header_row(words))
    found = layout.recover_columns(words, layout.columns(words), heads)
    money = F.filter(F.array_sort(F.collect_list(F.struct("x1", "role"))), lambda h: h["role"].isin(*layout.MONEY))
    roles = heads.groupBy("page").agg(F.transform(money, lambda h: h["role"]).alias("roles"))
    counted = found.groupBy("page").agg(F.count("*").alias("n"), F.max("edge").alias("last_edge"))
    return counted.join(roles.hint("merge"), "page").select("page", "n", "last_edge", F.array_join(layout.column_labels(F.col("n"), F.col("roles")), ",").alias("labels"))


@query
def f21_generated_statements(spark, d):
    """Statements as a model writes them: fenced, with some amounts as text."""
    told = F.regexp_replace("json", r'"(withdrawal|deposit)":(\d+\.\d+)([,}])', r'"$1":" \$$2 "$3')
    docs = lenses.statement_documents(spark, d).withColumn("json", F.concat(F.lit("Here it is:\n```json\n"), told, F.lit("\n```\nAsk for more.")))
    return adapt.adapt_rows(statements.parse(statements.generated(docs))[0]).select("statement_id", "pos", "date", "description", "amount", "balance")


@query
def q1_refusals(spark, d):
    def refused(inner, sql: str) -> bool:
        try:
            ask.check(inner, sql, ("transactions", "accounts"))
        except ask.Refused:
            return True
        return False

    with ask.isolated(spark, transactions=lenses.transactions(spark, d), accounts=lenses.accounts(spark, d)) as inner:
        found = [(sql, refused(inner, sql)) for sql, _ in STATEMENTS]
    return spark.createDataFrame(found, "statement string, refused boolean")


@query
def st2_doubled_stream(spark, d):
    """Every event delivered twice."""
    stream = events.read(spark, f"{d}/events.parquet")
    return events.drain(events.once(stream.unionByName(stream)).select("event_id", "event_type", "value"), new_path(spark, "doubled"), "append")
