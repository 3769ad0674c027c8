"""Set-similarity self-join of documents on word shingles: pigeonhole over a partition of the shingle universe.

For two linked documents x and y the symmetric difference d is at most (|x| + |y|) / 9 at a similarity of 0.8. Sizes
are dealt into bands; each band cuts the universe of shingles into segments by hash. A subset segment is indexed by all
its shingles (it misses a pair only where one difference falls into it), a deletion segment also by its one-deletion
neighbourhood (it misses a pair only where two do). So subset segments and twice the deletion segments must number
d + 1 together.

- Allocation by cost, for a band: how many segments of either kind, from the index rows that they take and the chance
  candidates that they let through (`allocation`). Small sets get deletion segments, large ones subset segments.
- Allocation by cost, for a set: of its subset segments, which outnumber those needed, it indexes the dearest to meet
  by chance, those of most shingles, under one order of all subsets, so that both documents of a link choose alike.

Documents near the top of a band are indexed in the next band as well. Equal sets are one node from the start. The nodes
of a bucket are compared with its lead, the node that shares most buckets. Only where a bucket then lies in several
components are its nodes compared across these, where a bound leaves a link possible (`_apart`); nodes that can have no
link at all go before anything is compared (`_living`).
Verification is exact: it compares the words of both texts.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, release, row_key, small, stash, texts
from .packing import groups_of

#: Subset segments of a band against those that pigeonhole needs; top size of the smallest band.
SLACK, SMALL = 1.6, 8
#: For the allocation: a candidate costs as much as so many index rows; a passage that strangers share has so many shingles.
CANDIDATE, PASSAGE = 100, 64
#: Bits of a sketch for each difference that a link of two of the band's largest sets allows.
SPREAD = 8
#: Bytes of text that a worker turns into sets at once.
PIECE = 2_000_000


@dataclass(frozen=True)
class Similarity:
    """Intersection to union of at least num / den."""

    num: int = 80
    den: int = 100

    def differ(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def top(self, size: int) -> int:
        """The largest size of a set linked to one of this size."""
        return size * self.den // self.num

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common * self.den >= self.num * (a + b - common)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the texts, the number of each word in turn, and where each text's words begin and end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = np.array([len(w) > 0 for w in names], bool)[code]  # white space at either end leaves an empty word
    offsets = split.offsets.to_numpy().astype(np.int64)
    return names, code[real], np.concatenate(([0], np.cumsum(real)))[offsets - offsets[0]]


def _windows(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every shingle: its first word's place and its number of words; and where each text's shingles begin and end."""
    k = np.minimum(np.diff(at), width)
    n = np.where(k > 0, np.diff(at) - k + 1, 0)
    ends = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(at[:-1] - ends[:-1], n) + np.arange(ends[-1]), np.repeat(k, n), ends


def _distinct(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, laid end to end, and where each text's begin and end."""
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[ends[:-1][np.diff(ends) > 0]] = True
    return values[new], np.concatenate(([0], np.cumsum(new)))[ends]


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles of `width` words, of all its words if they are fewer."""
    names, code, at = _words(texts)
    h = pd.util.hash_array(names, categorize=False)[code] if len(names) else np.zeros(0, np.uint64)
    first, k, ends = _windows(at, width)
    h = np.append(h, np.zeros(width, np.uint64))
    rolled = np.zeros(len(h) - width, np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + i]
    total = rolled[first]
    for row in np.flatnonzero(k < width).tolist():  # a text of few words: one shingle
        own = h[first[row] : first[row] + k[row]]
        total[row] = mix(np.array([functools.reduce(lambda x, y: x * 0x9E3779B97F4A7C15 + y & (1 << 64) - 1, own.tolist(), len(own))], np.uint64))[0]
    return _distinct(mix(total), ends)


def exact_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Like shingles(), but numbers in place of hashes: equal among these texts for equal words and only for them."""
    names, code, at = _words(texts)
    first, k, ends = _windows(at, width)
    pad = len(names)  # a text of few words is filled up with a word that no text has
    full = np.minimum(first[:, None] + np.arange(width), max(len(code) - 1, 0)) if len(first) else np.zeros((0, width), np.int64)
    run = np.where(np.arange(width) < k[:, None], code[full] if len(code) else full, pad)
    total, most = run[:, 0], pad + 1
    for i in range(1, width):
        total = total * (pad + 1) + run[:, i]
        most *= pad + 1
        if i < width - 1 and most * (pad + 1) >= 1 << 62:
            total = np.unique(total, return_inverse=True)[1].ravel()
            most = len(total) + 1
    return _distinct(total, ends)


def _nodes(values: np.ndarray, ends: np.ndarray, clashing: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """One number for each set, and another to check it by; sets of a number that several have get other ones."""
    n = np.diff(ends)
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64))) for salt in (11, 23)]
    node, check = (mix(s[ends[1:]] - s[ends[:-1]] + n.astype(np.uint64)) for s in sums)
    node, check = node.view(np.int64), check.view(np.int64)
    if clashing:
        again = np.isin(node, np.fromiter(clashing, np.int64, len(clashing)))
        node = np.where(again, mix(node.view(np.uint64) ^ mix(check.view(np.uint64))).view(np.int64), node)
    return np.where(n > 0, node, 0), np.where(n > 0, check, 0)


def bands(size: int) -> tuple[int, int]:
    """Number and largest size of the band of a size."""
    n = max(size - 1, 0) // SMALL
    return n.bit_length(), SMALL << n.bit_length()


@functools.cache
def allocation(top: int, sim: Similarity) -> tuple[int, int]:
    """Subset and deletion segments of the band up to this size: those of least cost for a set of three quarters of it."""
    n, need = 0.75 * top, sim.differ(top, top) + 1
    share = PASSAGE / (PASSAGE + n)

    def cost(deletions: int) -> float:
        subsets = max(0, need - 2 * deletions)
        unit = n / (int(SLACK * subsets) + 2 * deletions)  # shingles of a subset segment; a deletion segment has two units
        rows = subsets + deletions * (2 * unit + 1)
        chance = subsets * share ** (1.3 * unit) + deletions * (2 * unit + 1) * share ** max(2 * unit - 1, 0)
        return rows + CANDIDATE * chance

    best = min(range((need + 1) // 2 + 1), key=cost)
    return int(SLACK * max(0, need - 2 * best)), best


def _levels(size: int, sim: Similarity) -> list[tuple[int, int]]:
    """The band of a size, and the next where a link may lead there; with their largest sizes."""
    band, top = bands(size)
    return [(band, top), (band + 1, 2 * top)][: 1 + (sim.top(size) > top)]


def parities(x: np.ndarray, sim: Similarity) -> list[np.ndarray]:
    """Sketches of a set, as 64-bit numbers, for each of its levels: a bit says whether an odd number of the set's shingles
    fall to it. In one level two sets' sketches differ in no more bits than the sets do in shingles, and in little fewer
    while these are few for the bits."""
    out = []
    for band, top in _levels(len(x), sim):
        n = 64 * (1 + SPREAD * sim.differ(top, top) // 64)
        at = (mix(x ^ mix(np.array([~band], np.int64).view(np.uint64))[0]) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        out.append(np.packbits(np.bincount(at.astype(np.int64), minlength=n).astype(np.uint8) & 1).view(np.int64))
    return out


def keys(x: np.ndarray, sim: Similarity) -> np.ndarray:
    """Index keys of a set: equal for two linked sets in one key at least."""
    size, out = len(x), []
    for band, top in _levels(size, sim):
        salt = mix(np.array([band + 1], np.uint64))[0]
        subsets, deletions = allocation(top, sim)
        units = subsets + 2 * deletions
        segment = ((mix(x ^ salt) >> np.uint64(32)) * np.uint64(units) >> np.uint64(32)).astype(np.int64)
        segment = np.where(segment < 2 * deletions, segment >> 1, segment - deletions)  # deletion segments come first
        count = np.bincount(segment, minlength=subsets + deletions)
        order = np.argsort(segment, kind="stable")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x[order], dtype=np.uint64)))
        stop = np.cumsum(count)
        sums = sums[stop] - sums[stop - count]
        name = mix(np.arange(subsets + deletions, dtype=np.uint64) + salt)
        key = mix(sums ^ name)
        if deletions:
            inside = segment < deletions
            out += [key[:deletions], mix((sums[segment[inside]] - x[inside]) ^ name[segment[inside]])]
        keep = sim.differ(size, min(sim.top(size), top)) + 1 - 2 * deletions
        if keep > 0:
            key, count = key[deletions:], count[deletions:]
            out.append(key[np.lexsort((key, -count))[:keep]])  # one order for all: by number of shingles, then by key
    return np.concatenate(out)


def _sets(docs: DataFrame, width: int, clashing: frozenset[int]) -> DataFrame:
    """doc_id, row, n and node (0 for an empty set) with a check of the node, of every document."""

    def run(batches):
        for batch in batches:
            for piece in groups_of(batch, most=PIECE):
                values, ends = shingles(piece.column("text"), width)
                node, check = _nodes(values, ends, clashing)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("row"), pa.array(np.diff(ends)), pa.array(node), pa.array(check)], ["doc_id", "row", "n", "node", "check"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, n long, node long, check long")


def _index(docs: DataFrame, width: int, sim: Similarity, clashing: frozenset[int]) -> DataFrame:
    """key, node, others: within a group of texts a key leaves as one row, for its smallest node, with the other nodes
    of the group that hold it, so a hot key is combined before the shuffle."""

    def run(batches):
        for batch in batches:
            for piece in groups_of(batch, most=2 * PIECE):
                values, ends = shingles(piece.column("text"), width)
                nodes, rows = np.unique(_nodes(values, ends, clashing)[0], return_index=True)
                nodes, rows = (x[ends[rows + 1] > ends[rows]] for x in (nodes, rows))
                if not len(nodes):
                    continue
                each = [keys(values[ends[r] : ends[r + 1]], sim) for r in rows.tolist()]
                key = np.concatenate(each).view(np.int64)
                node = np.repeat(nodes, [len(k) for k in each])
                order = np.argsort(key, kind="stable")  # nodes ascend already
                key, node = key[order], node[order]
                same = np.concatenate(([False], (key[1:] == key[:-1]) & (node[1:] == node[:-1])))
                key, node = key[~same], node[~same]
                first = np.concatenate(([True], key[1:] != key[:-1]))
                at = np.append(np.flatnonzero(first), len(key))
                others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.diff(at) - 1)), pa.int32()), pa.array(node[~first]))
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(node[first]), others], ["key", "node", "others"])

    return docs.select("text").mapInArrow(run, "key long, node long, others array<long>")


def _shared(index: DataFrame) -> DataFrame:
    """key, node of the buckets that hold several nodes."""
    # A key has one row from each group of texts, so that few rows of it meet in the window.
    bucket = W.partitionBy("key")
    index = index.withColumns({"low": F.min("node").over(bucket), "high": F.max(F.coalesce(F.array_max("others"), "node")).over(bucket)})
    return index.where("low <> high").select("key", F.explode(F.concat(F.array("node"), "others")).alias("node")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, width: int, sim: Similarity) -> DataFrame:
    """The pairs (a, b) with their symmetric difference and whether they are linked. The second join ships each pair's
    first text beside it; a node of very many pairs is split by the sort-merge join's own treatment of skew."""
    first = sets.select(F.col("node").alias("a"), F.col("text").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("text").alias("y"))
    both = pairs.select("a", "b").join(first, "a").join(second, "b").withColumn("size", F.octet_length("x") + F.octet_length("y"))

    def run(batches):
        for batch in batches:
            at = np.cumsum(batch.column("size").to_numpy()) // PIECE
            for place in np.unique(at).tolist():
                lo, hi = np.searchsorted(at, [place, place + 1])
                piece = batch.slice(lo, hi - lo)
                a, b = (piece.column(c).to_numpy() for c in "ab")
                _, rows, which = np.unique(np.concatenate((a, b)), return_index=True, return_inverse=True)
                own = pa.concat_arrays([piece.column("x"), piece.column("y")]).take(pa.array(rows))
                values, ends = exact_shingles(own, width)
                size, (left, right) = np.diff(ends), np.split(which, 2)
                common = np.array([len(np.intersect1d(values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
                n, m = size[left], size[right]
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(n + m - 2 * common), pa.array(sim.linked(common, n, m))], ["a", "b", "apart", "linked"])
            release()

    return both.select("a", "b", "x", "y", "size").mapInArrow(run, "a long, b long, apart long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) of links (a, b): each round every node takes the smallest label
    around it, then its label's label."""
    ways = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ways")
    labels = stash(ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        around = ways.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = stash(near.join(jump, "mid").select("node", "was", F.least("mid", "far").alias("comp")), "labels")
        if not new.where("comp <> was").limit(1).count():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _several(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows (key, node) of buckets that lie in several components, with their components."""
    rows = rows.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return rows.join(mixed, "key")


def _own(nodes: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """node, own: how many shingles of a node no other one of these nodes has (or fewer, where hashes clash)."""

    def run(batches):
        for batch in batches:
            for piece in groups_of(batch, most=PIECE):
                values, ends = shingles(piece.column("text"), width)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.repeat(piece.column("node").to_numpy(), np.diff(ends)))], ["shingle", "node"])

    held = sets.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(run, "shingle long, node long")
    alone = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _living(shared: DataFrame, sizes: DataFrame, sets: DataFrame, width: int, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """The rows (key, node) of shared that may matter, and their nodes with n and own: a node with more shingles of its
    own than a link allows links with none. Twice, as those that stay then have more of their own."""
    for _ in range(2):
        nodes = shared.select("node").distinct().join(sizes, "node")
        nodes = nodes.join(_own(nodes, sets, width), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        nodes = stash(nodes.where(F.col("own") * sim.den <= (sim.den - sim.num) * F.col("n")), "nodes")
        live = shared.join(nodes.select("node"), "node", "left_semi")
        several = live.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
        shared = stash(live.join(several, "key"), "shared")
    return shared, nodes


def _sketches(nodes: DataFrame, sets: DataFrame, width: int, sim: Similarity) -> DataFrame:
    """node, band, bits and up: the sketches of these nodes in their band and, null where no link leads there, the next."""

    def run(batches):
        for batch in batches:
            for piece in groups_of(batch, most=PIECE):
                values, ends = shingles(piece.column("text"), width)
                each = [parities(values[a:b], sim) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                band = pa.array([bands(n)[0] for n in np.diff(ends).tolist()], pa.int32())
                bits, up = (pa.array([x[i] if i < len(x) else None for x in each], pa.list_(pa.int64())) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([piece.column("node"), band, bits, up], ["node", "band", "bits", "up"])

    return sets.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(run, "node long, band int, bits array<long>, up array<long>")


def _apart(rows: DataFrame, home: DataFrame, nodes: DataFrame, sets: DataFrame, width: int, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket, lie in two components and may link for all that bounds say.

    Shingles that a node alone has count in its symmetric difference to any other. Where two nodes have been compared
    with one lead, what they differ by is the symmetric difference of their differences to the lead: these have their
    own shingles apart, and the rest of one covers that of the other at best. With far the difference of a node to the
    lead, own its own shingles and near = far - 2 own, a link of a and b needs far(a) - near(b) and far(b) - near(a)
    within what it allows, so nodes of one lead meet by ranges of near, once each, instead of in buckets. What these
    bounds leave is a share of all pairs of a large group of variants; the sketches tell nearly all of it apart.
    """
    open_ = stash(rows, "open")
    named = open_.select("node", "comp").distinct().join(home.select(F.col("b").alias("node"), F.col("a").alias("lead"), "apart"), "node", "left")
    named = named.join(nodes, "node").join(nodes.select(F.col("node").alias("lead"), F.col("n").alias("lead_n")), "lead", "left")
    nodes = stash(named.join(_sketches(open_, sets, width, sim), "node"), "nodes")

    def side(table: DataFrame, p: str, *keep: str) -> DataFrame:
        return table.select(*keep, *(F.col(c).alias(f"{p}_{c}") for c in ("node", "comp", "n", "lead", "own", "far", "near", "band", "bits", "up")))

    def unlike(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m)

    differ = lambda a, b: F.floor((sim.den - sim.num) * (a + b) / (sim.den + sim.num))
    nodes = nodes.withColumns({"far": F.col("apart"), "near": F.col("apart") - 2 * F.col("own")})
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    allowed, two = differ(a("n"), b("n")), (a("node") < b("node")) & (a("comp") != b("comp"))
    level = a("band") - b("band")
    close = F.when(level == 0, unlike(a("bits"), b("bits"))).when(level == 1, unlike(a("bits"), b("up"))).when(level == -1, unlike(a("up"), b("bits"))) <= allowed
    step, most = F.greatest(F.lit(1), F.floor(differ(F.col("lead_n"), F.col("lead_n")) / 4)), differ(F.col("n"), F.floor(F.col("n") * sim.den / sim.num))
    same = nodes.where("lead is not null")
    by_range = side(same.withColumn("place", F.floor(F.col("near") / step)), "a", "lead", "place").join(
        side(same.withColumn("place", F.explode(F.sequence(F.floor((F.col("far") - most) / step), F.greatest(F.floor((F.col("far") - most) / step), F.floor((F.col("near") + most) / step))))), "b", "lead", "place"), ["lead", "place"])
    by_range = by_range.where(two & (a("far") - b("near") <= allowed) & (b("far") - a("near") <= allowed) & close)
    bucket = open_.select("key", "node").join(nodes, "node")
    by_key = side(bucket, "a", "key").join(side(bucket, "b", "key"), "key").where(
        two & ~F.coalesce(a("lead") == b("lead"), F.lit(False)) & (a("own") + b("own") + F.abs(a("n") - a("own") - b("n") + b("own")) <= allowed) & close)
    return by_range.unionByName(by_key, allowMissingColumns=True).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def jaccard_join(docs: DataFrame, *, width: int = 5, sim: Similarity = Similarity(), rows: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own
    included). With `rows` also row (common.row_key) and component, a number for the component, null for an empty set:
    they tell apart what null or repeated ids do not.

    Two documents link when the intersection of their sets is at least sim of the union. Nulls: a null text has an
    empty set, which links with nothing, like a text without words; a null doc_id takes part, but is never a
    component_id unless all ids of the component are null. Rows that repeat a doc_id are documents of their own. An
    empty table gives no rows. Columns besides doc_id and text are ignored.
    """
    docs = texts(docs).withColumn("row", row_key())
    clashing: frozenset[int] = frozenset()
    while True:
        own = stash(_sets(docs, width, clashing), "sets")
        nodes = stash(own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.min("n").alias("n"), F.min("check").alias("c"), F.max("check").alias("d")), "nodes")
        several = nodes.where("c <> d").select("node").limit(100_001).collect()  # a handful in 10^10 sets
        if not several:
            break
        if len(several) > 100_000 or clashing & {r.node for r in several}:
            raise ValueError("many different sets have one node number")
        clashing |= {r.node for r in several}

    shared = stash(_shared(_index(docs, width, sim, clashing)), "shared")
    sizes = nodes.select("node", "n")
    wanted = stash(shared.select("node").distinct().join(nodes, "node").select("node", "row"), "wanted")
    # A row of each node, by a key that a null doc_id has too; of rows with the same key by chance, one of the node.
    some = docs.join(small(wanted.select("row")), "row", "left_semi").select("text")

    def named(batches):
        for batch in batches:
            for piece in groups_of(batch, most=PIECE):
                node = _nodes(*shingles(piece.column("text"), width), clashing)[0]
                yield pa.RecordBatch.from_arrays([pa.array(node), piece.column("text")], ["node", "text"])

    sets = stash(some.mapInArrow(named, "node long, text string").dropDuplicates(["node"]), "texts")

    # Strangers that share a passage go here, before anything is compared.
    shared, living = _living(shared, sizes, sets, width, sim)
    weight = shared.groupBy("node").agg((-F.count(F.lit(1))).alias("w"))
    lead = shared.join(weight, "node").groupBy("key").agg(F.min(F.struct("w", "node")).alias("x")).select("key", F.col("x.node").alias("lead"))
    counted = stash(shared.join(lead, "key").where("node <> lead").groupBy("node", "lead").count(), "pairs")

    # Each node first with the lead that it shares most keys with, then with its other leads, where still apart.
    top = counted.groupBy("node").agg(F.max(F.struct("count", "lead")).alias("top")).select(F.col("top.lead").alias("a"), F.col("node").alias("b"))
    home = stash(_verified(top, sets, width, sim), "links")
    links = home.where("linked")
    comps = components(links)

    def across(pairs: DataFrame) -> DataFrame:
        comp = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))
        both = pairs.join(comp("a"), "a", "left").join(comp("b"), "b", "left").where(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b")
        size = lambda name: sizes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"))
        both = both.join(size("a"), "a").join(size("b"), "b")
        return both.where(F.least("a_n", "b_n") * sim.den >= F.greatest("a_n", "b_n") * sim.num).select("a", "b")

    rest = across(counted.select(F.col("lead").alias("a"), F.col("node").alias("b"))).join(home.select("a", "b"), ["a", "b"], "left_anti")
    second = stash(_verified(stash(rest, "pairs"), sets, width, sim), "links")
    if second.where("linked").limit(1).count():
        links = links.unionByName(second.where("linked"))
        comps = components(links)
    done = home.select("a", "b").unionByName(second.select("a", "b"))
    done = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = stash(_apart(_several(shared, comps), home, living, sets, width, sim).join(done, ["a", "b"], "left_anti"), "pairs")
    third = stash(_verified(pairs, sets, width, sim).where("linked"), "links")
    if third.limit(1).count():
        comps = components(links.unionByName(third))

    named_ = nodes.join(comps, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    smallest = named_.groupBy("comp").agg(F.min("least").alias("component_id"))
    label = stash(named_.join(smallest, "comp").select("node", "component_id", F.col("comp").alias("component")), "components")
    return own.join(label, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *(["row", "component"] if rows else []))
