"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session_of, shared_dir, stash


@dataclass(frozen=True)
class Rule:
    """kind, version, pattern and the group whose length must reach `least`; a hint that every match contains, if any.
    Findings of one kind are leftmost and do not overlap; a match whose group is too short is passed over."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str | None = None

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order in which findings at one place are listed.
BASE = (
    Rule("assign", 1, r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds beyond the base.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
)
FINDING = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def _spans(text: Column, found: Column, sized: Column, rule: Rule, rank: int) -> Column:
    """Places of the matches: the texts between matches and the matches' own lengths, summed from the left. Lengths
    are in code points."""
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("own"), F.transform(sized, F.length).alias("sized"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(FINDING).alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        stop = begin + x["own"]
        finding = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop")))
        out = F.coalesce(acc["out"], F.array().cast(FINDING))
        return F.struct(stop.alias("at"), F.when(x["sized"] >= rule.least, F.concat(out, finding)).otherwise(out).alias("out"))

    return F.coalesce(F.aggregate(steps, start, step)["out"], F.array().cast(FINDING))


def findings(blobs: DataFrame, rules: tuple[Rule, ...], pending: Column) -> DataFrame:
    """blobs (with `text`) and the findings of those rules whose ids are in `pending`."""
    none = F.array().cast("array<string>")
    blobs = blobs.withColumn("pending", pending)
    for rule in rules:
        due = F.array_contains("pending", rule.id)
        if rule.hint:
            due &= F.col("text").contains(rule.hint)
        blobs = blobs.withColumn(f"found_{rule.kind}", F.when(due, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).otherwise(none))
    parts = []
    for rank, rule in enumerate(rules):
        found = F.col(f"found_{rule.kind}")
        sized = found if not rule.group else F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
        parts.append(F.when(F.size(found) > 0, _spans(F.col("text"), found, sized, rule, rank)).otherwise(F.array().cast(FINDING)))
    return blobs.select("blob", F.col("pending").alias("rules"), F.array_sort(F.concat(*parts)).alias("found"))


def scan(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """Ledger rows (blob, rules, found) for the pairs of blob and rule version that `ledger` has not seen.

    versions: blob (SHA-256 of the text) and text of every version of every path, equal ones as often as they occur;
    grouping keeps one of each, combined before the shuffle, so a hot blob is scanned once; the ledger's side is dealt
    by blob too, so texts are shuffled once. A blob without findings gets a row too, so that it counts as seen.
    """
    blobs = versions.groupBy("blob").agg(F.any_value("text").alias("text"))
    every = F.array(*(F.lit(r.id) for r in rules))
    if ledger is None:
        return findings(blobs, rules, every)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    left = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return findings(blobs.join(seen, "blob", "left").withColumn("left_over", left).where("size(left_over) > 0"), rules, F.col("left_over"))


def _versions(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))


def record(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE + ADDED) -> None:
    """Scan what the ledger (a Parquet folder, made by the first scan) has not seen of docs' texts, and append it."""
    spark = session_of(docs)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    old = spark.read.parquet(ledger) if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None
    stash(scan(_versions(docs), old, rules), "ledger").write.mode("append").parquet(ledger)


def report(docs: DataFrame, rows: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, paths: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings of every row of docs from ledger rows that hold all of its blobs; see secret_scan(). Both sides are plain
    shuffles of digests, so a hot blob's partition is split. A blob's findings may lie in several rows: a row's findings
    of a kind are those of the version that the row was scanned for, and only a current one counts."""
    current = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.id)))
    own = F.filter("found", lambda x: F.coalesce(F.array_contains("rules", F.try_element_at(current, x["kind"])), F.lit(False)))
    with_any = rows.where("size(found) > 0").where(F.arrays_overlap("rules", F.array(*(F.lit(r.id) for r in rules))))
    with_any = with_any.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("found"))
    docs = docs.select(*paths, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))
    return docs.join(with_any, "blob", "left").select(*paths, "blob", F.coalesce("found", F.array().cast(FINDING)).alias("found"))


def secret_scan(docs: DataFrame, *, ledger: str | None = None, rules: tuple[Rule, ...] = BASE + ADDED, paths: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings of every row of docs: its path columns, blob and found (start, rank, kind, stop; code points, stop
    exclusive; by start, then in the order of the rules).

    ledger: a Parquet folder that earlier scans have appended to; what it has seen is not scanned again, and the new
    rows are appended. Without one, the ledger is a new table in the shared folder. Findings are then joined back from
    blobs to all paths. To put several batches into one result, record() each and report() once: Spark takes two reads
    of one folder in one plan for the same, whenever they were made.

    Nulls: a null text counts as empty, which has no findings; null paths are kept. Repeated rows give a row each. An
    empty table gives no rows. Other columns of docs are ignored.
    """
    if ledger is None:
        return report(docs, stash(scan(_versions(docs), None, rules), "ledger"), rules, paths)
    record(docs, ledger, rules)
    return report(docs, session_of(docs).read.parquet(ledger), rules, paths)


def digest_columns(scanned: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base findings, and all spans as kind:start:stop."""
    as_text = lambda kinds: F.concat_ws(",", F.transform(F.filter("found", lambda x: x["kind"].isin(kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in BASE]
    return scanned.select("doc_id", *map(count, base), F.sha2(as_text(base), 256).alias("base_sha256"), as_text([r.kind for r in BASE + ADDED]).alias("spans"))
