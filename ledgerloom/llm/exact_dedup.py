"""Exact dedup: a static binary-fuse filter per bucket of an immutable snapshot screens the digests of a new batch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, small, stash

#: Distinct digests that a bucket of the snapshot holds on average; a filter takes about nine bits for each.
BUCKET = 200_000


class BinaryFuse:
    """A static set of 64-bit keys with 8-bit fingerprints in three overlapping segments: no false negatives, and a
    false positive for about one in 256 other keys."""

    def __init__(self, seed: int, segment: int, prints: np.ndarray):
        self.seed, self.segment, self.prints = seed, segment, prints

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        first = ((h >> np.uint64(32)) * np.uint64(length - 2 * segment) >> np.uint64(32)).astype(np.int64)
        mask = np.uint64(segment - 1)
        second = (first + segment) ^ ((h >> np.uint64(18)) & mask).astype(np.int64)
        third = (first + 2 * segment) ^ (h & mask).astype(np.int64)
        return np.stack([first, second, third]), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray) -> "BinaryFuse":
        """keys: distinct. Keys are peeled in rounds: each round takes the keys that lie alone in a slot."""
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        size = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + 8
        length = (max(1, -(-size // segment) - 2) + 2) * segment
        for seed in range(1, 200):
            slots, prints = cls._slots(keys, seed, segment, length)
            count = np.bincount(slots.ravel(), minlength=length)
            held = np.zeros(length, np.int64)
            for s in slots:
                np.bitwise_xor.at(held, s, np.arange(n))
            rounds, left = [], n
            while left:
                alone = np.flatnonzero(count == 1)
                own, at = np.unique(held[alone], return_index=True)
                if not len(own):
                    break
                rounds.append((own, alone[at]))
                for s in slots:
                    np.subtract.at(count, s[own], 1)
                    np.bitwise_xor.at(held, s[own], own)
                left -= len(own)
            if not left:
                table = np.zeros(length, np.uint8)
                for own, at in reversed(rounds):
                    table[at] = 0
                    table[at] = prints[own] ^ table[slots[0][own]] ^ table[slots[1][own]] ^ table[slots[2][own]]
                return cls(seed, segment, table)
        raise ValueError("no seed separates the keys: they are not distinct")

    def has(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys, self.seed, self.segment, len(self.prints))
        return prints == self.prints[slots[0]] ^ self.prints[slots[1]] ^ self.prints[slots[2]]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring("digest", 17, 15), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in digests], np.uint64)


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of the text in UTF-8; a null text counts as empty."""
    return docs.select(F.col(key).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))


def groups_of(rows: DataFrame) -> DataFrame:
    """digest, n, top: rows of a digest and the largest doc_id among them, combined before the shuffle."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))


def snapshot(groups: DataFrame, *, bucket_size: int = BUCKET, incoming: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """The exact buckets of an immutable snapshot (digest, n, top, bucket), and for each bucket its filter. The number
    of buckets follows the number of digests, or of incoming ones if they are more, so that one is always built and
    screened in little memory."""
    buckets = max(1, -(-max(groups.count(), incoming) // bucket_size))
    groups = groups.withColumn("bucket", _bucket(buckets))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.of(np.unique(_keys(rows["digest"])))
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "seed": made.seed, "segment": made.segment, "prints": [made.prints.tobytes()]})

    filters = groups.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, prints binary")
    return groups, filters, buckets


def screened(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming digest groups with `maybe`: whether the filter of their bucket lets them through."""

    def screen(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows.assign(maybe=pd.Series(dtype=bool))
        if not len(own):
            return rows.assign(maybe=False)
        x = own.iloc[0]
        return rows.assign(maybe=BinaryFuse(int(x["seed"]), int(x["segment"]), np.frombuffer(x["prints"], np.uint8)).has(_keys(rows["digest"])))

    incoming = incoming.withColumn("bucket", _bucket(buckets))
    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(screen, incoming.schema.simpleString()[7:-1].replace(":", " ") + ", maybe boolean")


def exact_dedup(docs: DataFrame, is_new: Column, *, bucket_size: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (the largest doc_id among equal texts), group_size, kept, text_sha256.

    `is_new` tells the incoming batch from the snapshot. The snapshot's digests are grouped into exact buckets with a
    filter each. The batch's digests are grouped among themselves, then screened: what a filter rejects is new for
    certain, what it lets through is joined to its exact bucket. Then the texts of every group of several rows are
    compared byte by byte (by grouping on the text itself); a digest that two texts share is regrouped by text.

    Nulls: a null text counts as empty; a null is_new means new; rows with a null doc_id form groups like others, and
    stay only if all ids of the group are null. Rows that repeat a doc_id and text all count, and all that bear the
    kept id stay marked as kept. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(is_new, F.lit(True)).alias("is_new"))
    rows = docs.select("doc_id", "is_new", F.sha2("text", 256).alias("digest"))
    old = stash(groups_of(rows.where(~F.col("is_new"))), "snapshot")
    new = stash(groups_of(rows.where("is_new")), "incoming")
    exact, filters, buckets = snapshot(old, bucket_size=bucket_size, incoming=new.count())
    batch = stash(screened(new, filters, buckets), "screened")
    positive = batch.where("maybe").select("digest", "n", "top")
    both = exact.select("digest", "n", "top").unionByName(positive).groupBy("digest").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    groups = stash(both.unionByName(batch.where("not maybe").select("digest", "n", "top")), "groups")

    several = groups.where("n > 1").select("digest")
    checked = docs.select(F.sha2("text", 256).alias("digest"), "text", "doc_id").join(small(several), "digest", "left_semi").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    clash = stash(checked.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "clashes")
    out = rows.join(groups, "digest")
    if clash.count():  # two texts with one digest
        by_text = checked.join(clash.select("digest"), "digest", "left_semi")
        apart = docs.withColumn("digest", F.sha2("text", 256)).join(by_text, ["digest", "text"]).select(*out.columns)
        out = out.join(clash.select("digest"), "digest", "left_anti").unionByName(apart)
    return out.select("doc_id", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"), F.col("digest").alias("text_sha256"))


def newer_half(docs: DataFrame) -> Column:
    """Ids rise with arrival: those above the middle of the id range are the incoming batch."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") > F.lit(0 if low is None else (low + high) // 2)
