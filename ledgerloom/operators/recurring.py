"""Charges that come back at a steady cadence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.num import finite, py_round

# Cadences in days and how often a year holds them; tolerances; what is no subscription; natures.
PER_YEAR = {7: 52, 14: 26, 30: 12, 90: 4, 365: 1}
LEAST_ROWS, TOLERANCE, GAPS_STEADY, AMOUNTS_STEADY, MOST_PERIODS, LEAST_CHANGE = 3, 0.15, 0.25, 0.15, 3, 2.0
NO_SUBSCRIPTION = r"(?i)^(?:cheque|check)\b|\bcheque no\b|atm withdrawal|cash withdrawal|funds transfer|e-?transfer"
NATURES = ("subscription", "bill", "habitual", "unclear")
NATURE_OF = {
    "Subscriptions": "subscription", "Utilities": "bill", "Housing": "bill", "Food & Drink": "habitual",
    "Groceries": "habitual", "Transportation": "habitual", "Shopping": "habitual",
}


def eligible(txns: DataFrame) -> DataFrame:
    """Money out that is no transfer, has a day and a merchant, and is no cheque or cash."""
    merchant = F.trim("merchant")
    return txns.withColumns({"merchant": merchant, "amount": finite(F.col("amount"))}).where(
        ~F.coalesce("is_transfer", F.lit(False)) & (F.col("amount") < 0) & F.col("date").isNotNull() & (merchant != "") & ~merchant.rlike(NO_SUBSCRIPTION)
    )


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _mean(xs: Column) -> Column:
    return _sum(xs) / F.size(xs)


def _pstdev(xs: Column) -> Column:
    def around(v: Column) -> Column:
        squares = _let(_mean(v), lambda mean: _sum(F.transform(v, lambda x: (x - mean) * (x - mean))))
        return F.sqrt(squares / F.size(v))

    return _let(xs, around)


def _median(xs: Column) -> Column:
    return _let(F.sort_array(xs), lambda up: (F.get(up, F.floor((F.size(up) - 1) / 2).cast("int")) + F.get(up, F.floor(F.size(up) / 2).cast("int"))) / 2)


def _fit(gaps: Column, cadence: Column) -> Column:
    """(payments missed, unsteadiness, cadence) of the gaps; null where they do not keep the cadence."""

    def judged(periods: Column) -> Column:
        def steady(each: Column) -> Column:
            near = F.forall(each, lambda g: F.abs(g - cadence) <= TOLERANCE * cadence) & F.forall(periods, lambda p: p <= MOST_PERIODS)
            missed = _sum(F.transform(periods, lambda p: p - 1))
            return F.when(near, _let(_pstdev(each) / _median(each), lambda ratio: F.when(ratio < GAPS_STEADY, F.struct(missed.alias("missed"), ratio.alias("ratio"), cadence.alias("cadence")))))

        return _let(F.zip_with(gaps, periods, lambda g, p: g / p), steady)

    return _let(F.transform(gaps, lambda g: F.greatest(F.lit(1.0), F.bround(g / cadence))), judged)


def merchant_series(txns: DataFrame) -> DataFrame:
    """merchant and its charges in order of the day, for merchants with three or more and no two on one day.

    Charges are first combined by merchant and day. A merchant with two on any day is out, and all others have at most
    one row a day, so that what is then collected for a merchant is bounded by the days of the ledger, whatever its
    share of the rows.
    """
    daily = eligible(txns).groupBy("merchant", "date").agg(F.count("*").alias("_n"), F.first(F.struct("amount", "account_id", "category")).alias("_row"))
    days = F.collect_list(F.struct("date", "_row.amount", "_row.account_id", "_row.category"))
    series = daily.groupBy("merchant").agg(F.max("_n").alias("_most"), days.alias("rows"))
    return series.where((F.col("_most") == 1) & (F.size("rows") >= LEAST_ROWS)).select("merchant", F.array_sort("rows").alias("rows"))


def _first_mode(categories: Column) -> Column:
    """The most frequent value; the one seen first among equals."""
    tally = F.transform(F.array_distinct(categories), lambda c: F.struct(
        F.size(F.filter(categories, lambda x: x.eqNullSafe(c))).alias("n"), (-F.array_position(F.transform(categories, lambda x: F.coalesce(x, F.lit("\0"))), F.coalesce(c, F.lit("\0")))).alias("at"), c.alias("value")))
    return F.array_max(tally)["value"]


def find_recurring(txns: DataFrame, natures: DataFrame | None = None) -> DataFrame:
    """One row for each merchant whose charges keep a cadence: merchant, cadence_days, amount (median), kind (fixed or
    variable), occurrences, first and last day, next_expected, price_change_pct (null under two percent), annual_cost,
    account_id (of the last charge, '' if null), category (most frequent, first seen among equals) and nature (by
    category, else by the lookup `natures` (merchant, nature), else unclear).

    Null or non-finite amounts, null days and blank merchants are no charges; an empty ledger gives no rows.
    """
    rows = F.col("rows")
    charges = F.transform(rows, lambda r: -r["amount"])
    gaps = F.transform(F.sequence(F.lit(1), F.size(rows) - 1), lambda i: F.datediff(F.get(rows, i)["date"], F.get(rows, i - 1)["date"]).cast("double"))
    fits = F.transform(F.array(*map(F.lit, PER_YEAR)), lambda c: _fit(F.col("gaps"), c))
    found = merchant_series(txns).withColumn("gaps", gaps).withColumn("charges", charges)
    found = found.withColumn("fit", F.array_min(F.array_compact(fits))).where(F.col("fit").isNotNull())
    cadence, charges, last = F.col("fit.cadence"), F.col("charges"), F.element_at(rows, -1)
    first = F.get(charges, F.lit(0))
    change = (F.element_at(charges, -1) - first) / first * 100
    yearly = F.element_at(F.create_map(*(F.lit(x) for pair in PER_YEAR.items() for x in pair)), cadence)
    out = found.select(
        "merchant",
        cadence.alias("cadence_days"),
        py_round(_median(charges)).alias("amount"),
        F.when(_pstdev(charges) / _mean(charges) < AMOUNTS_STEADY, "fixed").otherwise("variable").alias("kind"),
        F.size(rows).alias("occurrences"),
        F.get(rows, F.lit(0))["date"].alias("first_date"),
        last["date"].alias("last_date"),
        F.date_add(last["date"], cadence).alias("next_expected"),
        F.when(F.abs(change) >= LEAST_CHANGE, py_round(change, 1)).alias("price_change_pct"),
        py_round(_median(charges) * yearly).alias("annual_cost"),
        F.coalesce(last["account_id"], F.lit("")).alias("account_id"),
        _first_mode(F.transform(rows, lambda r: r["category"])).alias("category"),
    )
    return with_nature(out, natures)


def with_nature(found: DataFrame, natures: DataFrame | None = None) -> DataFrame:
    by_category = F.try_element_at(F.create_map(*(F.lit(x) for pair in NATURE_OF.items() for x in pair)), F.col("category"))
    if natures is None:
        return found.withColumn("nature", F.coalesce(by_category, F.lit("unclear")))
    known = natures.where(F.col("nature").isin(*NATURES)).groupBy(F.col("merchant").alias("_m")).agg(F.min("nature").alias("_n"))
    joined = found.join(known, found["merchant"] == known["_m"], "left")
    return joined.withColumn("nature", F.coalesce(by_category, "_n", F.lit("unclear"))).drop("_m", "_n")


#: Categories that may recur and do not settle how.
UNSETTLED = ("Health", "Entertainment", "Education", "Travel", "Other")


def natures_to_ask(dictionary: DataFrame, natures: DataFrame) -> DataFrame:
    """merchant and category of the dictionary's merchants whose category does not settle their nature, that are no
    cheques or cash, and that natures (merchant) have no row for."""
    asked = dictionary.where(F.col("category").isin(*UNSETTLED) & ~F.col("merchant").rlike(NO_SUBSCRIPTION)).select("merchant", "category")
    return asked.join(natures.select("merchant").distinct(), "merchant", "left_anti")


def learn_natures(natures: DataFrame, answers: DataFrame) -> DataFrame:
    """natures (merchant, nature) and the answers for merchants that they lack, trimmed and in lower case; unclear and
    unknown natures are left out, so that such merchants stay repeated spending. The smallest counts, were one to repeat."""
    nature = F.lower(F.trim("nature"))
    given = answers.where(nature.isin(*NATURES) & (nature != "unclear")).groupBy("merchant").agg(F.min(nature).alias("nature"))
    return natures.select("merchant", "nature").unionByName(given.join(natures.select("merchant"), "merchant", "left_anti"))


def split_recurring(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subscriptions and bills, repeated spending), dearest first."""
    ranked = [F.desc("annual_cost"), "merchant"]
    agreed = F.col("nature").isin("subscription", "bill")
    return found.where(agreed).orderBy(*ranked), found.where(~agreed).orderBy(*ranked)


def totals(found: DataFrame) -> DataFrame:
    """By nature: merchants, yearly cost, price rises."""
    return found.groupBy("nature").agg(
        F.count("*").alias("merchants"),
        py_round(F.sum(F.col("annual_cost").cast("decimal(18,2)")).cast("double")).alias("annual_cost"),
        F.count_if(F.col("price_change_pct") > 0).alias("price_increases"),
    )


def flag_recurring(txns: DataFrame, found: DataFrame, *, sticky: bool = False) -> DataFrame:
    """txns with is_recurring: the charge counted towards a merchant found. With sticky, a flag once set stays."""
    names = found.select(F.col("merchant").alias("_m"))
    counted = (
        ~F.coalesce("is_transfer", F.lit(False)) & (finite(F.col("amount")) < 0) & F.col("date").isNotNull() & F.col("_m").isNotNull()
    )
    joined = txns.join(names, F.trim(txns["merchant"]) == names["_m"], "left")
    flag = F.coalesce(counted, F.lit(False))
    if sticky and "is_recurring" in txns.columns:
        flag = flag | F.coalesce(txns["is_recurring"], F.lit(False))
    return joined.withColumn("is_recurring", flag).drop("_m")
