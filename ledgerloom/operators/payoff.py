"""How long a card balance takes to clear, month by month for a batch of debts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.num import py_round
from ledgerloom.session import spread

#: Months at most; the least payment and its share of the balance; targets in months; dollars that two
#: scenarios must differ by.
MONTHS, FLOOR, SHARE, TARGETS, EXTRA, APART = 600, 25.0, 0.01, (36, 12), 100.0, 1.0
#: Debts that one task plans.
DEBTS_A_TASK = 2_000
POINTS = "array<struct<month:int,balance:double>>"


def monthly_rate(apr: Column) -> Column:
    return apr / 100 / 12


def minimum_payment(balance: Column, apr: Column) -> Column:
    return py_round(F.greatest(F.lit(FLOOR), balance * monthly_rate(apr) + SHARE * balance))


def payment_for(balance: Column, apr: Column, months: int) -> Column:
    """The level payment that clears the balance in so many months, up to the next cent."""
    r = monthly_rate(apr)
    exact = F.when(r == 0, balance / months).otherwise(balance * r / (1 - F.pow(1 + r, F.lit(-months))))
    return F.ceil(exact * 100) / 100


def _rounded(x: np.ndarray) -> np.ndarray:
    """py_round of an array, as num.py_round has it: half-even on the exact value; NaN for what is not finite."""
    scaled = x * 100
    whole = np.rint(scaled)
    out = whole / 100 + 0.0
    hard = (np.abs(np.abs(scaled - whole) - 0.5) < 1e-4) | (np.abs(scaled) >= 1 << 40)
    for i in np.flatnonzero(hard & np.isfinite(x)).tolist():
        out[i] = round(float(x[i]), 2) + 0.0
    out[~np.isfinite(x)] = np.nan
    return out


def _plans(series: bool, balance: pa.Array, apr: pa.Array, payment: pa.Array) -> pa.Array:
    """The plan of each debt: all of them go through a month together."""
    known = np.ones(len(balance), bool)
    for x in (balance, apr, payment):
        known &= x.is_valid().to_numpy(zero_copy_only=False)
    b, a, pay = (x.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for x in (balance, apr, payment))
    owed = balance.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        rate, nothing = a / 100 / 12, owed & (b <= 0)
        least = _rounded(b * rate)  # NaN, which is no number, is above all numbers
        open_ = known & ~nothing & ((pay > 0) | np.isnan(pay)) & ((a >= 0) | np.isnan(a)) & ~np.isnan(least) & ((pay > least) | np.isnan(pay))
        left, interest, months, after = np.where(open_, b, 0.0), np.zeros(len(b)), np.zeros(len(b), np.int32), []
        for _ in range(MONTHS):
            at = np.flatnonzero(left > 0)
            if not len(at):
                break
            due = _rounded(left[at] * rate[at])
            rest = _rounded(left[at] + due - pay[at])
            left[at] = np.where(rest > 0, rest, 0.0)
            interest[at] += due
            months[at] += 1
            if series:
                after.append((at, left[at].copy()))
        clears = nothing | (open_ & (left <= 0))
        fields = [pa.array(months), pa.array(_rounded(interest))]
    names = ["months", "total_interest"]
    if series:
        sizes = np.where(clears, months, 0)
        starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        month, value = np.zeros(starts[-1], np.int32), np.zeros(starts[-1])
        for n, (at, rest) in enumerate(after):
            own = clears[at]
            place = starts[at[own]] + n
            month[place], value[place] = n + 1, rest[own]
        points = pa.StructArray.from_arrays([pa.array(month), pa.array(value)], ["month", "balance"])
        fields.append(pa.ListArray.from_arrays(pa.array(starts), points))
        names.append("series")
    return pa.StructArray.from_arrays(fields, names, mask=pa.array(~clears))


def payoff(balance: Column, apr: Column, payment: Column, *, series: bool = True) -> Column:
    """months, total_interest and, if asked for, series (the balance after each month), or null where the payment does not clear the
    balance within 600 months or not even its first interest. Nothing owed takes no months."""
    kind = "struct<months:int,total_interest:double" + (f",series:{POINTS}>" if series else ">")

    def plans(b: pa.Array, a: pa.Array, p: pa.Array) -> pa.Array:
        return _plans(series, b, a, p)

    return F.arrow_udf(plans, kind)(balance.cast("double"), apr.cast("double"), payment.cast("double"))


def scenarios(balance: Column, apr: Column, *, series: bool = True) -> Column:
    """An array of monthly_payment, label and plan, by payment: the minimum, clear in 36 months, a hundred over the
    minimum, clear in 12 months. One within a dollar of an earlier one, or that never clears, is left out."""
    least = minimum_payment(balance, apr)
    wanted = (
        (least, "minimum"), (payment_for(balance, apr, TARGETS[0]), "36 months"), (py_round(least + EXTRA), "minimum plus 100"), (payment_for(balance, apr, TARGETS[1]), "12 months"),
    )
    runs = F.array(*(F.struct(payment.alias("monthly_payment"), F.lit(label).alias("label"), payoff(balance, apr, payment, series=series).alias("plan")) for payment, label in wanted))
    clears = F.filter(runs, lambda w: w["plan"].isNotNull())

    def accept(kept: Column, w: Column) -> Column:
        close = F.exists(kept, lambda k: F.abs(k["monthly_payment"] - w["monthly_payment"]) < APART)
        return F.when(close, kept).otherwise(F.concat(kept, F.array(w)))

    return F.array_sort(F.aggregate(clears, F.filter(clears, lambda w: F.lit(False)), accept))


def payoff_table(debts: DataFrame, *, series: bool = True) -> DataFrame:
    """The columns of debts (with balance and apr) and one row a scenario: label, monthly_payment, months,
    total_interest, and series if asked for. Rows without a rate, or that owe nothing, have none."""
    b, apr = F.col("balance"), F.col("apr")
    # a debt is some bytes and its plans are hundreds of months, so few debts are a task
    owed = spread(debts.where((b > 0) & (apr >= 0)), DEBTS_A_TASK)
    each = owed.select("*", F.explode(scenarios(b, apr, series=series)).alias("_s"))
    return each.select(*debts.columns, "_s.label", "_s.monthly_payment", "_s.plan.months", "_s.plan.total_interest", *(["_s.plan.series"] if series else []))


def series_by_month(table: DataFrame, key: str) -> DataFrame:
    """A row for each key and month, a column for each scenario: what a chart needs."""
    points = table.select(key, "label", F.explode("series").alias("p")).select(key, "label", "p.month", "p.balance")
    return points.groupBy(key, "month").pivot("label", ["minimum", "36 months", "minimum plus 100", "12 months"]).agg(F.first("balance"))
