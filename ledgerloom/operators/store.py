"""Ids, idempotent inserts, upserts and flag updates on plain Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.num import printed
from ledgerloom.session import written

IDENTITY = ("account_id", "date", "description", "amount", "reference")


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with pos, which rises in the order of the keys (nulls first): sorted by ranges, so that no one task holds all."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank, from 1, in an order that leaves no ties: the place in a sorted range, and the rows of the ranges
    before it. Rows are sorted once, by ranges; what is sent to all tasks is one number for each range."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "ranked").withColumn("_range", F.shiftrightunsigned("_place", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.partitionBy().orderBy("_range")) - F.col("_n")).alias("_before"))
    joined = placed.join(F.broadcast(before), F.col("_range") == F.col("_r"))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def occurrence(rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with `occurrence`: how many equal rows (account, date, description, amount, reference; nulls equal) stand
    before it by pos, among those that are equal in the columns of `within` too.

    Counted in two steps, so that one row repeated very many times isn't one task's: ranks within ranges of pos, and
    for each range the number of equal rows in the ranges before.
    """
    names = (*IDENTITY, *within)
    keys = [F.col(c) for c in names]
    ranged = rows.withColumn("_range", F.floor(F.col("pos") / 100_000))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    several = sizes.groupBy(*keys).agg(F.count("*").alias("_ranges")).where("_ranges > 1").toDF(*(f"_s_{c}" for c in names), "_ranges")
    before = sizes.join(several, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in names], "left_semi").withColumn(
        "_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    ).toDF(*(f"_{c}" for c in names), "_r", "_n", "_before")
    within = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("pos")) - 1)
    joined = within.join(before, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names] + [F.col("_range") == F.col("_r")], "left")
    return joined.select(*rows.columns, (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("int").alias("occurrence"))


def transaction_id(occurrence: Column) -> Column:
    """16 hex digits of the digest of a row's identity and occurrence; null prints as None."""
    parts = [F.coalesce(x, F.lit("None")) for x in (F.col("account_id"), F.date_format("date", "yyyy-MM-dd"), F.col("description"), printed(F.col("amount")), F.col("reference"))]
    return F.substring(F.sha2(F.concat_ws("|", *parts, occurrence.cast("string")), 256), 1, 16)


def with_ids(rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with id; equal rows are told apart within a statement, say, so that one that two statements hold has one id."""
    return occurrence(rows, within).withColumn("id", transaction_id(F.col("occurrence"))).drop("occurrence")


def new_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet, the first by pos of equal ids."""
    first = rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), "pos").alias("_row")).select("_row.*")
    return first.join(stored.select("id"), "id", "left_anti").select(*rows.columns)


def insert(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Append the new rows to the table at path and say how many there were. Each call is one append."""
    from pyspark.errors import AnalysisException

    try:
        rows = new_rows(rows, spark.read.parquet(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = new_rows(rows, rows.limit(0))
    fresh = written(rows, "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def latest(rows: DataFrame, key: str, fields: tuple[str, ...], order: str) -> DataFrame:
    """One row a key: of each field the value of the last row by `order` in which it is not null."""
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields))


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of both tables by key; where both have one, the new values that are not null win. Of several new rows of a key
    the last by `order` counts, field by field; without an order a key may come once."""
    others = tuple(c for c in stored.columns if c != key)
    new = new if order else new.withColumn("_order", F.lit(0))
    fresh = latest(new, key, others, order or "_order").toDF(key, *(f"_{c}" for c in others))
    return stored.join(fresh, key, "full_outer").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in others))


def update_flags(stored: DataFrame, flags: DataFrame, names: tuple[str, ...] = ("is_transfer", "is_recurring")) -> DataFrame:
    """stored with the named flags of `flags` (id and the flags) where it has them."""
    fresh = flags.select("id", *(F.col(n).alias(f"_{n}") for n in names)).dropDuplicates(["id"])
    return stored.join(fresh, "id", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in stored.columns))


def extraction_log(verdicts: DataFrame, owners: DataFrame) -> DataFrame:
    """A row for the log of each statement's verdict, under its account (owners: statement_id, account_id); a statement read
    again is logged again."""
    return verdicts.join(owners, "statement_id").select(
        F.expr("uuid()").alias("id"), "account_id", F.current_timestamp().alias("uploaded_at"), "reconciled", "delta", "checks_run", "rows_flagged",
    )


def create_tables(spark: SparkSession, database: str = "default", *, reset: bool = False) -> None:
    """The stored tables, if absent; with reset, dropped first."""
    tables = {
        "accounts": "id STRING, bank_name STRING, account_holder_name STRING, account_last4 STRING, account_type STRING, currency STRING, opening_balance DOUBLE, closing_balance DOUBLE, apr DOUBLE",
        "transactions": "id STRING, account_id STRING, date DATE, description STRING, merchant STRING, category STRING, confidence DOUBLE, amount DOUBLE, balance DOUBLE, reference STRING, is_transfer BOOLEAN, is_recurring BOOLEAN",
        "merchant_cache": "merchant STRING, category STRING",
        "extractions": "id STRING, account_id STRING, uploaded_at TIMESTAMP, reconciled BOOLEAN, delta DOUBLE, checks_run INT, rows_flagged INT",
    }
    for name, columns in tables.items():
        if reset:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
