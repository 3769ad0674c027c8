"""Parsed statements as accounts and signed transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import iso_text, parse_date, recover_date
from ledgerloom.functions.num import money_sum, py_round, to_number
from ledgerloom.functions.text import account_id, account_type, clean_text, currency_code, last4
from ledgerloom.sources import statements as st


def exploded(parsed: DataFrame) -> DataFrame:
    """parsed (statement_id, v) with one row each element of its list: pos from 0, and r; elements that are no objects go."""
    rows = parsed.select("*", F.posexplode(st.rows_of(F.col("v"))).alias("pos", "r")).where(F.schema_of_variant("r").startswith("OBJECT"))
    return rows.withColumn("r", st.lower_keys(F.col("r")))


def adapt_rows(parsed: DataFrame) -> DataFrame:
    """statement_id, pos, date, description, reference, amount (in positive, out negative), deposit, withdrawal, balance.

    The date is the row's, else that of a month and day before the description, else the period's start. Rows without a
    date or without money go. Missing amounts count as nothing.
    """
    r, start, end = F.col("r"), F.col("_start"), F.col("_end")
    head = st.header(F.col("v"))
    # each step's columns are made before the next uses them, as an expression used ten times is else written out ten times
    parsed = parsed.withColumns({"_start": head["statement_period_start"], "_end": head["statement_period_end"]})
    parsed = parsed.withColumns({c: parse_date(F.col(c)) for c in ("_start", "_end")})
    number = {c: F.try_variant_get(r, f"$.{c}", "double") for c in ("withdrawal", "deposit", "balance")}
    raw = exploded(parsed).select(
        "statement_id", "pos", "_start", "_end", F.try_variant_get(r, "$.date", "string").alias("date"),
        F.coalesce(F.try_variant_get(r, "$.description", "string"), F.lit("")).alias("description"),
        F.try_variant_get(r, "$.reference", "string").alias("reference"),
        *(number[c].alias(c) for c in ("deposit", "withdrawal", "balance")),
    )
    rows = raw.withColumns({
        "date": F.coalesce(parse_date(F.col("date")), recover_date(F.col("description"), start, end), start),
        "amount": py_round(F.coalesce("deposit", F.lit(0.0)) - F.coalesce("withdrawal", F.lit(0.0))),
    }).select("statement_id", "pos", "date", "description", "reference", "amount", "deposit", "withdrawal", "balance")
    return rows.where(F.col("date").isNotNull() & (F.col("amount") != 0))


def adapt_accounts(parsed: DataFrame, rows: DataFrame, apr: Column | None = None) -> DataFrame:
    """One row a statement: the account's fields (no more than the last four digits of its number), balances and totals,
    and totals_source: `statement`, or `derived` where a printed total is missing and both come from the rows. A rate
    stays on cards alone."""
    v = F.col("v")
    kind, four = account_type(F.col("_account_type")), last4(F.col("_account_number"))
    head = {name: F.col(f"_{name}") for name in st.HEADER}
    parsed = parsed.withColumns({f"_{name}": x for name, x in st.header(v).items()})
    printed = {c: F.try_variant_get(v, f"$.{c}", "double") for c in ("opening_balance", "closing_balance", "total_deposits", "total_withdrawals")}
    accounts = parsed.select(
        "statement_id", account_id(head["bank_name"], four, head["statement_period_start"]).alias("id"), head["bank_name"].alias("bank_name"),
        head["account_holder_name"].alias("account_holder_name"), four.alias("account_last4"), kind.alias("account_type"),
        F.coalesce(head["currency"], F.lit("USD")).alias("currency"),
        F.when(kind == "credit", F.lit(None).cast("double") if apr is None else apr).alias("apr"), *(c.alias(n) for n, c in printed.items()),
    )
    sums = rows.groupBy("statement_id").agg(money_sum(F.col("deposit")).alias("_in"), money_sum(F.col("withdrawal")).alias("_out"))
    whole = F.col("total_deposits").isNotNull() & F.col("total_withdrawals").isNotNull()
    joined = accounts.join(sums, "statement_id", "left").withColumn("totals_source", F.when(whole, "statement").otherwise("derived"))
    derived = {f"total_{n}": F.when(F.col("totals_source") == "statement", F.col(f"total_{n}")).otherwise(F.coalesce(py_round(F.col(s)), F.lit(0.0))) for n, s in (("deposits", "_in"), ("withdrawals", "_out"))}
    return joined.withColumns(derived).drop("_in", "_out")


def normalize_rows(parsed: DataFrame) -> DataFrame:
    """statement_id, pos and the six fields under any of their spellings: ISO date text, clean texts, magnitudes. One
    signed amount parts into withdrawal and deposit."""
    r = F.col("r")
    text = {name: F.col(f"_{name}") for name in st.ROW}
    raw = exploded(parsed).withColumns({f"_{name}": st.field(r, names) for name, names in st.ROW.items()})
    out, into, signed = (to_number(text[c]) for c in ("withdrawal", "deposit", "amount"))
    raw = raw.withColumns({"_out": out, "_into": into, "_signed": signed})
    out, into, signed = F.col("_out"), F.col("_into"), F.col("_signed")
    lone = out.isNull() & into.isNull()
    whole = F.regexp_replace(text["reference"], r"^(-?\d+)\.0+$", "$1")
    return raw.select(
        "statement_id", "pos", iso_text(text["date"]).alias("date"), clean_text(text["description"]).alias("description"), clean_text(whole).alias("reference"),
        F.when(lone, F.when(signed < 0, F.abs(signed))).otherwise(F.abs(out)).alias("withdrawal"),
        F.when(lone, F.when(signed > 0, signed)).otherwise(F.abs(into)).alias("deposit"), to_number(text["balance"]).alias("balance"),
    )


def normalize_headers(parsed: DataFrame, rows: DataFrame, *, derive: bool = True, currency: str | None = None, upper: bool = False) -> DataFrame:
    """statement_id, the head's eleven fields and `missing` (those still null). With derive, missing totals are the
    rows' sums, a missing closing balance is the last one printed, a missing opening balance is the first row's before
    its money, and a missing period is that of the rows' dates."""
    head = {name: F.col(f"_{name}") for name in st.HEADER}
    parsed = parsed.withColumns({f"_{name}": x for name, x in st.header(F.col("v")).items()})
    names = {c: (F.upper(clean_text(head[c])) if upper else clean_text(head[c])) for c in ("bank_name", "account_holder_name")}
    money = ("opening_balance", "closing_balance", "total_withdrawals", "total_deposits")
    heads = parsed.select(
        "statement_id", *(x.alias(n) for n, x in names.items()), *(clean_text(head[c]).alias(c) for c in ("account_number", "account_type")),
        *(iso_text(head[c]).alias(c) for c in ("statement_period_start", "statement_period_end")),
        (F.lit(currency) if currency else currency_code(clean_text(head["currency"]))).alias("currency"), *(to_number(head[c]).alias(c) for c in money),
    )
    fields = [c for c in heads.columns if c != "statement_id"]
    if derive:
        change = F.coalesce("deposit", F.lit(0.0)) - F.coalesce("withdrawal", F.lit(0.0))
        sums = rows.groupBy("statement_id").agg(
            F.coalesce(money_sum(F.col("withdrawal")), F.lit(0.0)).alias("_total_withdrawals"), F.coalesce(money_sum(F.col("deposit")), F.lit(0.0)).alias("_total_deposits"),
            F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("pos"))).alias("_closing_balance"),
            py_round(F.min_by(F.col("balance") - change, F.col("pos"))).alias("_opening_balance"),
            F.min("date").alias("_statement_period_start"), F.max("date").alias("_statement_period_end"),
        )
        heads = heads.join(sums, "statement_id", "left")
        heads = heads.select("statement_id", *(F.coalesce(c, f"_{c}").alias(c) if f"_{c}" in heads.columns else F.col(c) for c in fields))
    return heads.withColumn("missing", F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in fields))))


def incomplete_rows(rows: DataFrame) -> DataFrame:
    """statement_id and the number of rows without a date, a description or any money."""
    lacking = F.col("date").isNull() | F.col("description").isNull() | (F.col("withdrawal").isNull() & F.col("deposit").isNull())
    return rows.groupBy("statement_id").agg(F.count_if(lacking).alias("incomplete"))


def merge_pages(pages: DataFrame, rows: DataFrame, key: str, head: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(heads, rows) of statements given page by page: of each field the first page's that has it, and all rows in the order
    of pages and lines, numbered anew."""
    from pyspark.sql import Window

    heads = pages.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(c) for c in head))
    order = Window.partitionBy(key).orderBy("page", "pos")
    return heads, rows.withColumn("pos", (F.row_number().over(order) - 1).cast("int")).drop("page")
