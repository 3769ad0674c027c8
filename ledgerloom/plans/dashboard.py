"""From statements to flagged ledgers, and from a ledger to one dashboard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import adapt, aggregates, categorize, payoff, reconcile, recurring, store, transfers
from ledgerloom.session import written
from ledgerloom.sources import statements


@dataclass
class Ledger:
    accounts: DataFrame
    transactions: DataFrame
    verdicts: DataFrame
    failures: DataFrame


def ingest(documents: DataFrame, aliases: DataFrame, dictionary: DataFrame, cache: DataFrame, *, apr: Column | None = None, window: int = transfers.WINDOW) -> Ledger:
    """All statements (statement_id, json) in one job: parse, adapt, reconcile, resolve merchants, categorize, identify,
    pair transfers, find what recurs. Bad documents are in `failures` and spoil no other.

    Detection runs once, over everything. pos rises over all statements in the order of their ids, then lines.
    """
    parsed, failures = statements.parse(documents)
    parsed = statements.kept(parsed)
    rows = adapt.adapt_rows(parsed)
    heads = adapt.adapt_accounts(parsed, rows, apr)
    verdicts = reconcile.reconcile(heads, rows)
    accounts = heads.select("statement_id", F.col("id").alias("account_id"))
    txns = rows.join(accounts, "statement_id")
    txns = written(store.numbered(txns.withColumnRenamed("pos", "line"), "statement_id", "line"), "numbered")
    txns = store.with_ids(categorize.categorize(categorize.resolve_merchants(txns, aliases), dictionary, cache), within=("statement_id",))
    txns = written(store.new_rows(txns, txns.select("id").limit(0)), "ledger")
    marked = written(transfers.mark_transfers(txns, window=window), "marked")
    flagged = recurring.flag_recurring(marked, recurring.find_recurring(marked))
    return Ledger(heads, flagged, verdicts, failures)


def dashboard(accounts: DataFrame, txns: DataFrame, verdicts: DataFrame, natures: DataFrame | None = None, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """The blocks of a dashboard, each a lazy DataFrame; money is rounded, and only the summary's net can be negative. Four
    blocks come from what recurs: who wants several of them gives it as found, written, so that it is looked for once."""
    found = recurring.find_recurring(txns, natures) if found is None else found
    subscriptions, repeated = recurring.split_recurring(found)
    debts = accounts.where((F.col("account_type") == "credit") & F.col("apr").isNotNull()).withColumn("balance", F.col("closing_balance"))
    return {
        "summary": aggregates.summary(txns),
        "by_category": aggregates.by_category(txns),
        "spending_over_time": aggregates.by_month(txns),
        "accounts": aggregates.accounts_with_counts(accounts, txns),
        "subscriptions": subscriptions,
        "repeated": repeated,
        "recurring_totals": recurring.totals(found),
        "price_increases": found.where(F.col("price_change_pct") > 0).orderBy(F.desc("price_change_pct"), "merchant"),
        "transfers_excluded": aggregates.transfers_excluded(txns),
        "extraction": aggregates.extraction_summary(verdicts),
        "payoff": payoff.payoff_table(debts.select("id", "balance", "apr")),
    }
