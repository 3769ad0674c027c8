"""Quality classifier: a document's own evidence, shrunk towards what its path and its host are like on the whole."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session_of, small, stash
from .packing import groups_of

#: Hashed word features; a worker's word memo.
BUCKETS, MEMO = 4096, 400_000
#: The fit's bounds: labelled documents at most (by a hash of the id), and bytes of each; longer ones teach nothing.
FIT_DOCS, FIT_BYTES = 4000, 16_384
#: A document stays if its probability is at least this.
KEEP = 0.5
SHAPES = 12
_memo: dict[bytes, int] = {}
_MARKS = b"#$%&*|<>{}[]=~^_\\"


def features(texts: list[str]) -> np.ndarray:
    """Shape features (lengths, shares of kinds of characters, repetition) and hashed words, each text scaled."""
    out = np.zeros((len(texts), SHAPES + BUCKETS), np.float32)
    if len(_memo) > MEMO:
        _memo.clear()
    for i, text in enumerate(texts):
        data = text.encode()
        words = data.lower().split()
        if not words:
            continue
        n = len(data)
        kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        for w in (known := set(words)).difference(_memo):
            _memo[w] = xxhash.xxh32_intdigest(w) % BUCKETS
        lines = data.split(b"\n")
        marks = int(kinds[list(_MARKS)].sum())
        letters = int(kinds[65:91].sum() + kinds[97:123].sum() + kinds[128:].sum())
        count = np.bincount(np.fromiter(map(_memo.__getitem__, words), np.int64, len(words)), minlength=BUCKETS)
        out[i, :SHAPES] = (
            1, math.log1p(n) / 10, len(words) / n * 5, letters / n, kinds[65:91].sum() / n * 5, kinds[48:58].sum() / n * 5, marks / n * 10,
            (kinds[33] + kinds[63]) / n * 10, len(known) / len(words), len(set(lines)) / len(lines), count.max() / len(words), min(1, len(words) / 50),
        )
        bag = np.log1p(count)
        out[i, SHAPES:] = bag / math.sqrt(float(bag @ bag))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, most: int = FIT_DOCS, longest: int = FIT_BYTES, label: str = "quality") -> np.ndarray:
    """Weights of a logistic regression on at most `most` labelled documents of at most `longest` bytes, whole ones, so
    that no more than their product comes to the driver; zeros if none is labelled."""
    labels = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    short = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= longest)).select("doc_id", "text")
    rows = short.join(F.broadcast(chosen), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("o")).orderBy("o", "text").limit(most).collect()
    w = np.zeros(SHAPES + BUCKETS, np.float32)
    if not rows:
        return w
    x, y = features([r.text for r in rows]), np.array([r.y for r in rows], np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 401):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w.astype(np.float32)


def evidence(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep` and `own`, the classifier's log odds for the whole text (0 for a null or blank one)."""
    shared = session_of(docs).sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for piece in groups_of(batch, "_text", 500_000):
                own = np.concatenate([features(piece.column("_text").to_pylist()[i : i + 256]) @ shared.value for i in range(0, len(piece), 256)]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(np.clip(own, -12, 12))], [*keep, "own"])

    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{kinds}, own double")


def _strength(groups: DataFrame) -> float:
    """How many documents the prior is worth, by moments: the variance within groups over that between them."""
    r = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("m")).first()
    if not r.n or r.k < 2 or r.n <= r.k:
        return 100.0
    within = max((r.q - r.b) / (r.n - r.k), 1e-9)
    between = (r.b - r.s * r.s / r.n - (r.k - 1) * within) / max(r.n - r.m / r.n, 1e-9)
    return min(1e6, within / max(between, 1e-9))


def site_of(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: the host in lower case without its port, and the first folder of its path, or / where the
    page lies in no folder; null where the url is none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    folder = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^(/[^/]+)/", 1)
    return host, F.when(host.isNotNull(), F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")))


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", url: str | None = None, keep: float = KEEP) -> DataFrame:
    """One row per row of docs: doc_id, host, path, own (the text's log odds), host_mean, path_mean (posterior means of
    the documents' probabilities there), score (0 to 1) and keep_doc (score >= keep).

    With `url`, host and path come from that column (see site_of); else the columns `host` and `path` stand for them.
    Sums of the documents' probabilities are grouped by host and path, combined before the shuffle, so that a hot host
    costs no more than others. The prior of a host is the mean of all documents, that of a path its host's posterior; a
    site with few documents stays near its prior, with a strength estimated from the spread of the sites. The score
    adds to a document's log odds how much its path differs from the whole.

    Nulls: null hosts and paths are sites of their own; a null or blank text has no evidence, so that its site decides;
    null ids are kept. Repeated rows give a row each. Empty tables: no documents, no rows; no labels, no evidence, and
    a score of 0.5 all over.
    """
    site = (F.col(host), F.col(path)) if url is None else site_of(F.col(url))
    docs = docs.select("doc_id", *(F.coalesce(x.cast("string"), F.lit("")).alias(n) for n, x in zip(("host", "path"), site, strict=True)), "text")
    rows = stash(evidence(docs, fit(docs, labels), ("doc_id", "host", "path")), "evidence")
    p = 1 / (1 + F.exp(-F.col("own")))
    paths = stash(rows.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    whole = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = whole[1] / whole[0] if whole[0] else 0.5
    worth_host, worth_path = _strength(hosts), _strength(paths)
    hosts = hosts.select("host", ((F.col("s") + worth_host * mean) / (F.col("n") + worth_host)).alias("host_mean"))
    sites = paths.join(hosts, "host").select("host", "path", "host_mean", ((F.col("s") + worth_path * F.col("host_mean")) / (F.col("n") + worth_path)).alias("path_mean"))
    out = rows.join(small(stash(sites, "sites")), ["host", "path"])
    score = 1 / (1 + F.exp(-(F.col("own") + _logit(F.col("path_mean")) - _logit(F.lit(mean)))))
    return out.select("doc_id", "host", "path", "own", "host_mean", "path_mean", score.alias("score"), (score >= keep).alias("keep_doc"))
