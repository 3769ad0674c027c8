"""Repeated byte strings of a minimum length, found on Burrows-Wheeler transforms and cut out of every document.

Every window of `least` bytes has an anchor: the smallest hash of its short substrings. Equal windows have equal
anchors, so windows meet their equals within the anchor's group, wherever they stand. A maximal run of windows with one
anchor is a segment. Segments that are equal byte strings are counted before any shuffle of bytes; only anchors with
several different segments need a comparison of substrings, which the transform makes in buckets of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stash, texts
from .packing import groups_of

#: Bytes of the substrings that anchors are chosen from; windows of a segment at most; bytes of a bucket, on average;
#: different segments of an anchor up to which one bucket takes them all.
GRAM, RUN, BUCKET, HOT = 64, 512, 1_000_000, 1_000
SEPARATOR = 255  # no byte of UTF-8


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of data in the order of the suffixes' first `depth` bytes at least, by doubling; ties stay in any order."""
    n, width = len(data), 7
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(width, np.uint64)])  # 0: past the end
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = key << np.uint64(9) | padded[i : i + n]
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    while True:
        starts = np.flatnonzero(new)
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        rank[n] = -1
        if width >= depth or len(starts) == n:
            return order
        size = np.diff(np.append(starts, n))
        tied = np.repeat(size > 1, size)  # only places with an equal are sorted again
        at = order[tied]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(at + width, n)] + 1).astype(np.uint64)
        again = np.argsort(key)
        order[tied] = at[again]
        key = key[again]
        new[tied] = np.concatenate(([True], key[1:] != key[:-1]))
        width *= 2


def repeated_starts(data: np.ndarray, least: int) -> np.ndarray:
    """For each place of data (bytes below 255, which separates): whether the string of `least` bytes there starts at
    another place too.

    Breadth-first backward extension on the transform: level l holds the intervals of the suffixes with a common
    prefix of l bytes that were new on that level. A backward step of an interval by a byte gives the interval of a
    prefix of l + 1 bytes; the border behind it gets the common prefix l if it has none yet. After level least - 1 the
    borders left without a value are those between suffixes with a common prefix of `least` or more.
    """
    n = len(data) + 1
    if n <= least:
        return np.zeros(len(data), bool)
    text = np.append(data.astype(np.int16) + 1, 0)  # 0 ends the text
    order = np.concatenate(([n - 1], suffix_order(data, least + 1)))
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_byte] = np.arange(n)
    border = np.zeros(n + 1, bool)  # has a common prefix below `least`
    border[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    owner = np.full(n, -1, np.int64)
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
        to = step[rows]
        if len(to) * 12 > n:  # a pass over all places costs less than a sort
            owner[to] = which
            to = np.flatnonzero(owner >= 0)
            which = owner[to]
            owner[to] = -1
        else:
            again = np.argsort(to)
            to, which = to[again], which[again]
        byte = before[by_byte[to]]
        first = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (byte[1:] != byte[:-1]) | (to[1:] != to[:-1] + 1))))
        begin, end = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        new = ~border[end]
        border[end[new]] = True
        low, high = begin[new], end[new]
    joined = ~border[:n]  # row i shares `least` bytes with row i - 1
    alike = joined | np.append(joined[1:], False)
    out = np.zeros(n, bool)
    out[order[alike]] = True
    return out[: n - 1]


def _anchors(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of the substrings of GRAM bytes in each window of `least` bytes; whether the window starts with it."""
    h, width, power, made = mix(data.astype(np.uint64) + np.uint64(1)), 1, 0x9E3779B97F4A7C15, 0
    whole = np.zeros(len(data) + 1, np.uint64)
    while width <= GRAM:  # h: hashes of the strings of `width` bytes; whole: of those of `made` bytes
        if GRAM & width:
            whole = whole[: len(h) - made] * np.uint64(power) + h[made:] if made else h
            made += width
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = width * 2, power * power % (1 << 64)
    h = mix(whole)
    grams, width, most = h, 1, least - GRAM + 1
    while width * 2 <= most:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    h = np.minimum(h[: len(h) - (most - width)], h[most - width :]) if most > width else h
    return h, grams[: len(h)] == h


def segments(own: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """Row, start, windows, anchor and content hash of every segment of some texts; whether the anchor recurs within it,
    so that its own windows may be equal."""
    data = b"\xff".join(own)
    if len(data) < least:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z.astype(bool)
    size = np.array([len(x) for x in own], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    anchor, leads = _anchors(np.frombuffer(data, np.uint8), least)
    anchor = anchor.view(np.int64)
    room = np.maximum(size - least + 1, 0)  # windows of each text
    at = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(begin, room)
    row = np.repeat(np.arange(len(own)), room)
    anchor, leads = anchor[at], leads[at]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))[: len(at)]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    if (length > RUN).any():
        k = -(-length // RUN)
        nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        first, length = np.repeat(first, k) + nth * RUN, np.minimum(np.repeat(length, k) - nth * RUN, RUN)
    leads[first + length - 1] = False
    again = np.add.reduceat(leads, first) > 0 if len(first) else leads
    start = at[first]
    digest = b"".join([hashlib.blake2b(data[s : s + n + least - 1], digest_size=8).digest() for s, n in zip(start.tolist(), length.tolist(), strict=True)])
    return row[first], start - begin[row[first]], length, anchor[first], np.frombuffer(digest, np.int64), again


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in groups_of(batch, most=1_000_000):
                row, start, length, anchor, digest, again = segments([x.encode() for x in piece.column("text").to_pylist()], least)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(take), piece.column("th").take(take), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(anchor), pa.array(digest), pa.array(again)], ["doc_id", "th", "start", "windows", "anchor", "seg", "again"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, start int, windows int, anchor long, seg long, again boolean")


def _compare(rows: DataFrame, least: int, buckets: int) -> DataFrame:
    """Windows of the different segments of an anchor that occur in several of them: doc_id, th, start, windows."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        own = bucket["bytes"].tolist()
        found = repeated_starts(np.frombuffer(b"\xff".join(own), np.uint8), least)
        size = np.array([len(x) for x in own], np.int64)
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        room = size - least + 1
        at = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        row = np.repeat(np.arange(len(own)), room)
        hit = found[at + begin[row]]
        row, at = row[hit], at[hit]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else np.zeros(0, np.int64)
        out = bucket.iloc[row[first]]
        return pd.DataFrame({"doc_id": out["doc_id"].to_numpy(), "th": out["th"].to_numpy(), "start": (out["start"].to_numpy() + at[first]).astype(np.int32), "windows": np.diff(np.append(first, len(at))).astype(np.int32)})

    return rows.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInPandas(run, f"doc_id {kind}, th long, start int, windows int")


def _hot(rows: DataFrame, least: int) -> DataFrame:
    """The same for anchors with very many different segments: each window is a row, and equal windows are counted."""
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("bytes") - least)))
    window = F.expr(f"substring(bytes, i + 1, {least})")
    each = each.select("doc_id", "th", (F.col("start") + F.col("i")).cast("int").alias("start"), "anchor", F.xxhash64(window).alias("window"), F.xxhash64(F.md5(window)).alias("check"))
    each = stash(each, "windows")
    several = each.groupBy("anchor", "window", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.join(several, ["anchor", "window", "check"], "left_semi").select("doc_id", "th", "start", F.lit(1).alias("windows"))


def suffix_dedup(docs: DataFrame, *, least: int = 200, bucket_size: int = BUCKET, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the
    remaining bytes). A byte goes if a string of `least` bytes that covers it also starts anywhere else.

    Nulls: a null text counts as empty; a null doc_id is kept. Texts shorter than `least` lose nothing. Rows that
    repeat a doc_id are separate texts: if equal, each repeats the other. An empty table gives no rows. Columns besides
    doc_id and text are ignored.
    """
    docs = texts(docs).withColumn("th", F.xxhash64("text"))
    kind = dict(docs.dtypes)["doc_id"]
    every = stash(_occurrences(docs, least), "segments")
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"), F.max("again").alias("again"))
    anchors = anchors.where("n > 1 or again").select("anchor", (F.col("low") != F.col("high")).alias("several"))
    shared = stash(every.join(anchors, "anchor").select(*every.columns, (F.col("several") | F.col("again")).alias("differ")).drop("again"), "shared")
    counted = shared.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("differ"), F.struct("doc_id", "th", "start", "windows"))).alias("one"))
    counted = stash(counted, "counted")
    equal = shared.join(counted.where("n > 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi").select("doc_id", "th", "start", "windows")

    one = counted.where("one is not null").select("anchor", "n", "one.*")
    crowd = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd"))
    one = one.join(crowd, "anchor")
    cut = F.expr(f"substring(cast(text as binary), start + 1, windows + {least - 1})").alias("bytes")
    found = stash(one.join(docs.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own")) & (one["th"] == docs["th"])).select("doc_id", one["th"], "start", "anchor", "crowd", cut), "bytes")
    total = found.agg(F.sum(F.length("bytes"))).first()[0] or 0
    part = _compare(found.where(f"crowd <= {hot}"), least, max(1, -(-total // bucket_size)))
    spans = equal.unionByName(part).unionByName(_hot(found.where(f"crowd > {hot}"), least))

    merged = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))  # a set: rows that repeat an id and a text give the same ones

    def cuts(batches):
        for batch in (piece for whole in batches for piece in groups_of(whole)):
            rows = []
            for text, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "runs")), strict=True):
                data = text.encode()
                runs = []
                for s, n in sorted((x["start"], x["windows"]) for x in spans or ()):
                    e = s + n + least - 1
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    merged = merged.withColumnsRenamed({"doc_id": "own", "th": "own_th"})
    both = docs.join(merged, docs["doc_id"].eqNullSafe(merged["own"]) & (docs["th"] == merged["own_th"]), "left")
    return both.select("doc_id", "text", "runs").mapInArrow(cuts, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
