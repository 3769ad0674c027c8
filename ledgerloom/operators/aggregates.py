"""Spending aggregates over a ledger. Each is one partial and one final hash aggregate; transfers do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.num import money_sum, py_round

def spending() -> Column:
    """Whether a row counts: a flag that is null is no transfer."""
    return ~F.coalesce(F.col("is_transfer"), F.lit(False))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def summary(txns: DataFrame) -> DataFrame:
    """One row: spent and income (both positive), net, number of rows, first and last day. An empty ledger gives zeros
    and empty days."""
    amount = F.col("amount")
    out, into = money_sum(F.when(amount < 0, amount)), money_sum(F.when(amount > 0, amount))
    return txns.where(spending()).agg(
        py_round(_zero(F.abs(out))).alias("total_spent"),
        py_round(_zero(into)).alias("total_income"),
        py_round(_zero(money_sum(amount))).alias("net"),
        F.count("*").alias("txn_count"),
        F.coalesce(F.date_format(F.min("date"), "yyyy-MM-dd"), F.lit("")).alias("date_from"),
        F.coalesce(F.date_format(F.max("date"), "yyyy-MM-dd"), F.lit("")).alias("date_to"),
    )


def by_category(txns: DataFrame) -> DataFrame:
    """Money out by category, blank ones as Other, largest first."""
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Other"))
    out = txns.where(spending() & (F.col("amount") < 0)).groupBy(category.alias("category"))
    return out.agg(F.abs(money_sum(F.col("amount"))).alias("amount"), F.count("*").alias("count")).orderBy(F.desc("amount"), "category").withColumn("amount", py_round(F.col("amount")))


def by_month(txns: DataFrame) -> DataFrame:
    """Money out by month, in order."""
    out = txns.where(spending() & (F.col("amount") < 0)).groupBy(F.date_format("date", "yyyy-MM").alias("month"))
    return out.agg(py_round(F.abs(money_sum(F.col("amount")))).alias("amount")).orderBy("month")


def account_counts(txns: DataFrame) -> DataFrame:
    return txns.groupBy("account_id").agg(F.count("*").alias("txn_count"))


def accounts_with_counts(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """Every account and the number of its transactions. They are counted before the join, so that an account with very
    many rows puts no more than its count through it."""
    joined = accounts.join(account_counts(txns), accounts["id"] == F.col("account_id"), "left")
    return joined.select(*accounts.columns, F.coalesce("txn_count", F.lit(0)).alias("txn_count"))


def transfers_excluded(txns: DataFrame) -> DataFrame:
    """Rows that are transfers and their absolute amounts, both legs of a pair."""
    moved = txns.where(F.coalesce("is_transfer", F.lit(False)))
    return moved.agg(F.count("*").alias("count"), py_round(_zero(money_sum(F.abs("amount")))).alias("amount"))


def extraction_summary(verdicts: DataFrame) -> DataFrame:
    """Statements, those that reconcile, checks and flagged rows; all reconcile only if there are some and each ran checks."""
    return verdicts.agg(
        F.count("*").alias("statements"),
        F.count_if("reconciled").alias("reconciled_statements"),
        F.coalesce(F.sum("checks_run"), F.lit(0)).cast("bigint").alias("checks_run"),
        F.coalesce(F.sum("rows_flagged"), F.lit(0)).cast("bigint").alias("rows_flagged"),
    ).withColumn("reconciled", (F.col("statements") > 0) & (F.col("reconciled_statements") == F.col("statements")) & (F.col("checks_run") > 0))


def recent(txns: DataFrame, limit: int = 100, category: str | None = None, account_id: str | None = None) -> DataFrame:
    """The latest transactions, with the filters asked for: the limit is the page size."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    for name, wanted in (("category", category), ("account_id", account_id)):
        if wanted is not None:
            txns = txns.where(F.col(name) == F.lit(wanted))
    return txns.orderBy(F.desc("date"), "id").limit(limit)


def page_total(txns: DataFrame, category: str | None = None, account_id: str | None = None) -> DataFrame:
    """How many transactions the filters of `recent` leave, whatever the size of the page: one row, total."""
    for name, wanted in (("category", category), ("account_id", account_id)):
        if wanted is not None:
            txns = txns.where(F.col(name) == F.lit(wanted))
    return txns.agg(F.count("*").alias("total"))


def top_categories(by_category: DataFrame, most: int = 8) -> DataFrame:
    """The dearest categories, by name among equals: what a chart has room for."""
    return by_category.orderBy(F.desc("amount"), "category").limit(most)


def month_over_month(by_month: DataFrame) -> DataFrame:
    """by_month (month as yyyy-MM, amount) with the amount of the calendar month before, the change, and the change in
    percent; null where that month has no spending."""
    following = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")
    before = by_month.select(following.alias("month"), F.col("amount").alias("previous"))
    change = F.col("amount") - F.col("previous")
    pct = F.when(F.col("previous") != 0, py_round(change / F.col("previous") * 100, 1))
    return by_month.join(before, "month", "left").select("month", "amount", "previous", py_round(change).alias("change"), pct.alias("change_pct"))


def distinct_merchants(txns: DataFrame) -> DataFrame:
    return txns.where(F.col("merchant").isNotNull()).select("merchant").distinct()


def is_empty_result(df: DataFrame) -> bool:
    """Whether there are no rows, or only nulls in all of them. Stops at the first value."""
    some = [F.col(f"`{c}`").isNotNull() for c in df.columns]
    return df.where(F.greatest(*some) if len(some) > 1 else some[0]).isEmpty()


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """df with its floating-point columns rounded."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*(py_round(F.col(f"`{c}`"), digits).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns))
