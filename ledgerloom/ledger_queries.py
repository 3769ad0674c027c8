"""Queries of the stored ledger: three uploads that overlap, merged one after another; and of orders, as ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import recurring, store, transfers
from ledgerloom.plans import ask
from ledgerloom.plans.ledger import Ledger, Upload
from ledgerloom.queries import query
from ledgerloom.session import new_path
from ledgerloom.sources import lenses


def _uploaded(spark, d) -> tuple[Ledger, list[Upload]]:
    ledger, done = Ledger(spark, new_path(spark, "ledger")), []
    sent = lenses.uploads(spark, d)
    aliases = lenses.bills(spark, d).select(F.col("merchant").alias("raw_description"), "merchant", F.lit("100").alias("confidence")).distinct()
    none = spark.createDataFrame([], "merchant string, category string")
    for i in range(1, len(lenses.UPLOADS) + 1):
        done.append(ledger.upload(sent.where(F.col("upload") == i).drop("upload"), aliases, none))
    return ledger, done


@query
def c12_uploads(spark, d):
    """Every stored row with the flags that the uploads have left and the upload that brought it."""
    return _uploaded(spark, d)[0].transactions().select("id", "account_id", "date", "description", "merchant", "category", "amount", "is_transfer", "is_recurring", "upload")


@query
def a14_new_rows(spark, d):
    """Rows submitted and rows that were new, for each statement of each upload."""
    out = None
    for each in _uploaded(spark, d)[1]:
        rows = each.statements.select(F.lit(each.version).alias("upload"), "statement_id", "account_id", "submitted", "inserted", "reconciled")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def o2_recurring_order(spark, d):
    found = recurring.find_recurring(lenses.bills(spark, d)).where(F.col("nature").isin("subscription", "bill"))
    return store.ranked(found.select("merchant", "annual_cost"), F.desc("annual_cost"), F.col("merchant"))


@query
def o3_result_cap(spark, d):
    """What a question gets of a statement that gives more rows than are shown."""
    with ask.isolated(spark, transactions=lenses.transactions(spark, d)) as inner:
        rows = ask.run(inner, "SELECT id, amount FROM transactions ORDER BY date DESC, id", ("transactions",), seconds=120)
    return spark.createDataFrame([(i, r["id"], r["amount"]) for i, r in enumerate(rows, 1)], "rank long, id string, amount double")


@query
def o5_candidate_order(spark, d):
    rank = (F.when(F.col("has_word"), 0).otherwise(1), F.col("gap"), F.least("out_pos", "in_pos"), F.greatest("out_pos", "in_pos"))
    return store.ranked(transfers.candidates(lenses.legs(spark, d)).select("out_pos", "in_pos", "has_word", "gap"), *rank)
