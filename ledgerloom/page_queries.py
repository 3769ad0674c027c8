"""Queries of the page driver: from word boxes to settled rows, heads, names and stored transactions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import adapt, pages, reconcile
from ledgerloom.queries import query
from ledgerloom.sources import lenses, statements


@query
def g13_page_rows(spark, d):
    """Every transaction on the pages, with the sides that its balances imply."""
    return pages.settle(*pages.read_pages(lenses.statement_pages(spark, d)))


@query
def g8_page_heads(spark, d):
    """What the summary lines say, doubtful rows, and whether rows and heads add up."""
    rows, heads = pages.read_pages(lenses.statement_pages(spark, d))
    rows = pages.settle(rows, heads).withColumnRenamed("doc", "statement_id")
    named = heads.withColumnRenamed("doc", "statement_id").withColumn("account_type", F.lit("checking"))
    warned = reconcile.parser_warnings(named, rows, carry=False)
    return named.drop("account_type").join(warned, "statement_id")


@query
def g9_names(spark, d):
    return pages.names(lenses.statement_pages(spark, d))


@query
def g13_adapted_pages(spark, d):
    """The pages as statements, adapted: rows by account as an upload would store them."""
    parsed = statements.kept(statements.parse(pages.statements(lenses.statement_pages(spark, d)))[0])
    rows = adapt.adapt_rows(parsed)
    owners = adapt.adapt_accounts(parsed, rows).select("statement_id", F.col("id").alias("account_id"), "closing_balance")
    return rows.join(owners, "statement_id").select("statement_id", "account_id", "closing_balance", "pos", "date", "description", "amount", "balance")


@query
def w8_continuations(spark, d):
    """Pages without a header: dated lines, undated ones with a balance, with an amount alone, and with words alone."""
    k = F.col("o_orderkey")
    y = F.row_number().over(Window.partitionBy("page").orderBy(k)) * 20
    word = lambda text, x1, x2: F.struct(text.alias("text"), F.lit(float(x1)).alias("x1"), F.lit(float(x2)).alias("x2"))
    dated, balance, lone = k % 3 == 0, (k % 3 == 0) | (k % 7 == 0), k % 5 == 0
    named = F.when(dated, "buy").when(balance, "fee").when(lone, "plus").when(k % 11 == 0, "member").otherwise("note")
    boxes = F.array_compact(F.array(
        F.when(dated, word(F.date_format("o_orderdate", "yyyy-MM-dd"), 10, 50)), word(named, 60, 90), word(F.concat(F.lit("n"), k.cast("string")), 95, 140),
        F.when(balance | lone, word(F.format_number("o_totalprice", 2), 350, 400)), F.when(balance, word(F.format_number(F.col("o_totalprice") * 2, 2), 450, 500)),
    ))
    lines = lenses.table(spark, d, "orders").withColumn("page", (F.col("o_custkey") % 50).cast("int")).withColumn("y1", y.cast("double"))
    words = lines.select(F.col("page").cast("string").alias("doc"), "page", F.lit(600.0).alias("width"), "y1", (F.col("y1") + 10).alias("y2"), F.lit(90.0).alias("conf"), F.explode(boxes).alias("b"))
    rows = pages.read_pages(words.select("doc", "page", "width", "b.*", "y1", "y2", "conf"))[0]
    return rows.select("doc", "pos", "date", "description", "amount", "balance")
