"""A statement against its own arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.num import agree, finite, money_sum, py_round


def _sign(kind: Column) -> Column:
    """Cards print what is owed."""
    return F.when(kind == "credit", -1.0).otherwise(1.0)


def balance_checks(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row with `prior` (the balance before it; the opening one at first; null after a null) and `step_ok` (null where
    nothing can be compared)."""
    head = statements.select("statement_id", F.col("account_type").alias("_type"), finite(F.col("opening_balance")).alias("_opening"))
    order = Window.partitionBy("statement_id").orderBy("pos")
    joined = rows.withColumns({"amount": finite(F.col("amount")), "balance": finite(F.col("balance"))}).join(head, "statement_id")
    prior = F.when(F.row_number().over(order) == 1, F.col("_opening")).otherwise(F.lag("balance").over(order))
    step = agree(F.col("balance") - F.col("prior"), F.col("amount") * _sign(F.col("_type")))
    return joined.withColumn("prior", prior).withColumn("step_ok", step).drop("_type", "_opening")


def reconcile(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a statement: whether opening plus rows gives closing (check_balance), whether the printed totals do
    (check_totals; not if they were derived from the rows), whether each balance follows from the one before
    (check_running), delta, flagged rows by position, checks run, and reconciled: some ran and all that ran hold.

    statements: statement_id, account_type, opening_balance, closing_balance, total_deposits, total_withdrawals and, if
    known, totals_source. rows: statement_id, pos, amount, balance. A statement without rows has nothing to check but its
    totals. Rows are dealt by statement, whose length is what a bank prints.
    """
    if "totals_source" not in statements.columns:
        statements = statements.withColumn("totals_source", F.lit("statement"))
    sums = balance_checks(statements, rows).groupBy("statement_id").agg(
        money_sum(F.col("amount")).alias("_net"),
        F.bool_and("step_ok").alias("check_running"),
        F.array_sort(F.collect_list(F.when(~F.col("step_ok"), F.col("pos")))).alias("flagged"),
    )
    opening, closing, paid_in, paid_out = (finite(F.col(c)) for c in ("opening_balance", "closing_balance", "total_deposits", "total_withdrawals"))
    expected, sign = closing - opening, _sign(F.col("account_type"))
    observed = py_round(F.col("_net") * sign)
    totals = F.when(F.coalesce("totals_source", F.lit("statement")) != "derived", agree((paid_in - paid_out) * sign, expected))
    checks = ("check_balance", "check_totals", "check_running")
    ran = [F.col(c).isNotNull().cast("int") for c in checks]
    return (
        statements.join(sums, "statement_id", "left")
        .withColumns({
            "check_balance": agree(observed, expected),
            "check_totals": totals,
            "delta": F.coalesce(py_round(F.abs(observed - expected)), F.lit(0.0)),
            "flagged": F.coalesce("flagged", F.array().cast("array<int>")),
        })
        .withColumn("checks_run", ran[0] + ran[1] + ran[2])
        .withColumn("reconciled", (F.col("checks_run") > 0) & F.coalesce("check_balance", F.lit(True)) & F.coalesce("check_totals", F.lit(True)) & F.coalesce("check_running", F.lit(True)))
        .withColumn("rows_flagged", F.size("flagged"))
        .select("statement_id", "reconciled", "delta", *checks, "flagged", "checks_run", "rows_flagged")
    )


def parser_warnings(statements: DataFrame, rows: DataFrame, *, carry: bool = True) -> DataFrame:
    """statement_id and the list of what does not add up. With carry, the last known balance bridges rows without one;
    else they break the chain. A statement without a closing balance takes the last row's where carry is off."""
    head = statements.select("statement_id", F.col("account_type").alias("_type"), F.col("opening_balance").alias("_opening"))
    before = Window.partitionBy("statement_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("statement_id").orderBy("pos")
    last = F.last("balance", ignorenulls=True).over(before) if carry else F.lag("balance").over(order)
    pending = F.sum("_since").over(Window.partitionBy("statement_id", "_island").orderBy("pos")) if carry else F.col("_net")
    net = (F.coalesce("deposit", F.lit(0.0)) - F.coalesce("withdrawal", F.lit(0.0))) * _sign(F.col("_type"))
    joined = rows.join(head, "statement_id").withColumn("_net", net)
    known = F.count("balance").over(before)
    joined = joined.withColumn("_since", F.col("_net")).withColumn("_island", F.coalesce(known, F.lit(0)))
    prior = F.coalesce(last, F.col("_opening")) if carry else F.when(F.row_number().over(order) == 1, F.col("_opening")).otherwise(last)
    bad = F.col("balance").isNotNull() & ~agree(F.col("balance"), prior + pending)
    marked = joined.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    sums = marked.groupBy("statement_id").agg(
        money_sum(F.col("deposit")).alias("_in"), money_sum(F.col("withdrawal")).alias("_out"), F.count_if("_bad").alias("_steps"),
        money_sum(F.col("_net")).alias("_moved"), F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("pos"))).alias("_last"),
    )
    closing = F.col("closing_balance") if carry else F.coalesce("closing_balance", "_last")
    found = F.array(
        F.when(~agree(F.col("total_deposits"), F.coalesce("_in", F.lit(0.0))), "deposits"),
        F.when(~agree(F.col("total_withdrawals"), F.coalesce("_out", F.lit(0.0))), "withdrawals"),
        F.when(F.col("_steps") > 0, "running balance"),
        F.when(~agree(F.col("opening_balance") + F.coalesce("_moved", F.lit(0.0)), closing), "closing balance"),
    )
    return statements.join(sums, "statement_id", "left").select("statement_id", F.array_compact(found).alias("warnings"))
