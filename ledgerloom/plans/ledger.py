"""A stored ledger that uploads are merged into: only new rows are added, and what is known of old ones is kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import adapt, categorize, reconcile, recurring, store, transfers
from ledgerloom.plans import dashboard as blocks
from ledgerloom.session import written
from ledgerloom.sources import statements
from ledgerloom.sources.versions import Versions

_ACCOUNT = ("bank_name", "account_holder_name", "account_last4", "account_type", "currency", "opening_balance", "closing_balance", "apr")
_ROW = ("id", "account_id", "date", "description", "merchant", "category", "confidence", "amount", "balance", "reference")
TABLES = {
    "transactions": "id string, account_id string, date date, description string, merchant string, category string, confidence double, amount double, balance double, reference string, upload long",
    "accounts": "id string, bank_name string, account_holder_name string, account_last4 string, account_type string, currency string, opening_balance double, closing_balance double, apr double, upload long, statement_id string",
    "flags": "id string, is_transfer boolean, is_recurring boolean",
    "merchants": "merchant string, category string",
    "extractions": "id string, account_id string, uploaded_at timestamp, reconciled boolean, delta double, checks_run int, rows_flagged int",
}


@dataclass
class Upload:
    """What an upload did: the version it made, and for each statement its account, rows submitted and rows that were new,
    with its verdict; documents that could not be read are in failures."""

    version: int
    statements: DataFrame
    failures: DataFrame


class Ledger:
    """The tables of TABLES under a folder, by version. Nothing that is stored is ever written again: rows, fields of
    accounts, flags and learned merchants are added, and put together when they are read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root, TABLES)

    def accounts(self, version: int | None = None) -> DataFrame:
        """One row an account: of each field the latest upload's value that is not null (of one upload the last statement's)."""
        rows = self.versions.read("accounts", version).withColumn("_at", F.struct("upload", "statement_id"))
        return store.latest(rows, "id", _ACCOUNT, "_at")

    def transactions(self, version: int | None = None) -> DataFrame:
        """Every stored row with its flags, and the upload that brought it."""
        flags = self.versions.read("flags", version).groupBy("id").agg(F.bool_or("is_transfer").alias("is_transfer"), F.bool_or("is_recurring").alias("is_recurring"))
        rows = self.versions.read("transactions", version).join(flags, "id", "left")
        return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_transfer", "is_recurring")})

    def dashboard(self, natures: DataFrame | None = None) -> dict[str, DataFrame]:
        found = written(recurring.find_recurring(self.transactions(), natures), "found")
        return blocks.dashboard(self.accounts(), self.transactions(), self.versions.read("extractions"), natures, found)

    def upload(self, documents: DataFrame, aliases: DataFrame, dictionary: DataFrame, *, apr: Column | None = None, window: int = transfers.WINDOW) -> Upload:
        """Merge statements (statement_id, json) into the ledger, as one new version.

        A row is new if its id is: of equal rows of one statement each has an id of its own, and a row that two statements
        hold is one row. Stored rows keep their merchant and category. What merchants have taught before is known, what
        they teach now is added. Transfers are looked for among all rows, stored and new, by date and id; charges that
        recur among all rows of the merchants that the upload touches, be it by a new row or by a new transfer: the others
        are judged as they were. Flags are only ever set, never taken back.

        If anything fails, the version before stays what readers get. Two uploads at once: the later one gets a Conflict
        and is to be repeated. Stored rows are matched by id among the days of the upload alone. Documents that can't be
        read spoil no other; an upload without any row logs its verdicts. Null statement_ids and texts are failures.
        """
        base = self.versions.current()
        parsed, failures = statements.parse(documents)
        parsed = statements.kept(parsed)
        rows = written(adapt.adapt_rows(parsed), "adapted")
        heads = written(adapt.adapt_accounts(parsed, rows, apr), "heads")
        verdicts = reconcile.reconcile(heads, rows)
        owners = heads.select("statement_id", F.col("id").alias("account_id"))
        lines = rows.join(owners, "statement_id").withColumnRenamed("pos", "line")
        lines = written(store.numbered(lines, "statement_id", "line"), "numbered")
        known = self.versions.read("merchants", base)
        submitted = store.with_ids(categorize.categorize(categorize.resolve_merchants(lines, aliases), dictionary, known), within=("statement_id",))
        submitted = written(submitted, "submitted")
        days = submitted.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        stored = self.versions.read("transactions", base).where(F.col("date").between(F.lit(days.a), F.lit(days.b)))
        fresh = written(store.new_rows(submitted, stored), "fresh")

        taught = categorize.learned_merchants(submitted).join(known, "merchant", "left_anti")
        number = F.lit(base + 1).cast("long")
        added = {
            "transactions": [self.versions.stage("transactions", fresh.withColumn("upload", number).repartitionByRange("account_id", "date").sortWithinPartitions("account_id", "date"))],
            "accounts": [self.versions.stage("accounts", heads.withColumn("upload", number))],
            "merchants": [self.versions.stage("merchants", taught)],
            "extractions": [self.versions.stage("extractions", store.extraction_log(verdicts, owners))],
        }
        added["flags"] = [self.versions.stage("flags", self._flags(base, fresh, window))]
        counts = submitted.groupBy("statement_id").agg(F.count("*").alias("submitted"))
        news = fresh.groupBy("statement_id").agg(F.count("*").alias("inserted"))
        told = owners.join(counts, "statement_id", "left").join(news, "statement_id", "left").join(verdicts.select("statement_id", "reconciled", "delta"), "statement_id")
        told = written(told.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("submitted", "inserted")}), "told")
        return Upload(self.versions.commit(base, added), told, failures)

    def _flags(self, base: int, fresh: DataFrame, window: int) -> DataFrame:
        """id and flags of the rows, stored or new, that have a flag now and had it not."""
        both = self.transactions(base).select(*_ROW, "is_transfer", "is_recurring")
        new = fresh.select(*_ROW, F.lit(False).alias("is_transfer"), F.lit(False).alias("is_recurring"))
        every = written(store.numbered(both.unionByName(new), "date", "id"), "every")
        pairs = transfers.pair_legs(every, window=window)
        legs = every.join(pairs.select(F.explode(F.array("out_pos", "in_pos")).alias("pos")), "pos", "left_semi").where("NOT is_transfer")
        legs = written(legs.select("id", "merchant"), "legs")
        touched = fresh.select("merchant").unionByName(legs.select("merchant")).select(F.trim("merchant").alias("_touched")).distinct()
        theirs = every.join(touched, F.trim(every["merchant"]) == touched["_touched"], "left_semi").join(legs.select("id", F.lit(True).alias("_leg")), "id", "left")
        theirs = theirs.withColumn("is_transfer", F.col("is_transfer") | F.coalesce("_leg", F.lit(False))).drop("_leg")
        flagged = recurring.flag_recurring(theirs.withColumn("_before", F.col("is_recurring")), recurring.find_recurring(theirs))
        charges = flagged.where("is_recurring AND NOT _before").select("id", F.lit(False).alias("is_transfer"), F.lit(True).alias("is_recurring"))
        return legs.select("id", F.lit(True).alias("is_transfer"), F.lit(False).alias("is_recurring")).unionByName(charges)
