"""Language ID: a byte convolutional network, trained in numpy, applied to fixed-length windows of whole texts."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session_of
from .packing import groups_of

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: The fit takes about so many texts of each language, chosen by a hash of the id, and so many characters of each,
#: from a place that the hash chooses: the bound of what reaches the driver.
#: With many languages it takes fewer of each, FIT_ALL of all of them, but LEAST_TEXTS at least: all are learned.
FIT_TEXTS, FIT_CHARS, FIT_ALL, LEAST_TEXTS = 500, 1024, 100_000, 20
UNKNOWN = "und"


class ByteNet:
    """Byte embeddings, filters of several widths, max pooling over the window, a softmax layer."""

    def __init__(self, langs: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "dense": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "bias": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"shift{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _filters(self) -> np.ndarray:
        """All filters as one matrix: narrower ones are zero in the rows that they don't reach."""
        return np.concatenate([np.pad(self.p[f"conv{w}"], ((0, (max(WIDTHS) - w) * EMBED), (0, 0))) for w in WIDTHS], 1)

    def _pooled(self, x: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter over the window, and all answers."""
        e = self.p["embed"][x]
        n, places, k = len(e), e.shape[1] - max(WIDTHS) + 1, max(WIDTHS) * EMBED
        c = (np.lib.stride_tricks.as_strided(e, (n, places, k), e.strides).reshape(-1, k) @ filters).reshape(n, places, -1)
        top = c
        while top.shape[1] > 8:  # halves are compared as wholes
            half = top.shape[1] // 2
            rest = top[:, 2 * half :]
            top = np.maximum(top[:, :half], top[:, half : 2 * half])
            if rest.shape[1]:
                top[:, :1] = np.maximum(top[:, :1], rest)
        return np.maximum(top.max(1) + np.concatenate([self.p[f"shift{w}"] for w in WIDTHS]), 0), c

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        filters = self._filters()
        out = [self._softmax(self._pooled(x[i : i + 32], filters)[0] @ self.p["dense"] + self.p["bias"]) for i in range(0, len(x), 32)]  # 32 windows' answers fit a core's cache
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 2) -> "ByteNet":
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                own, target = x[rows], y[rows]
                pooled, answers = self._pooled(own, self._filters())
                at = answers.argmax(1)
                d = self._softmax(pooled @ self.p["dense"] + self.p["bias"])
                d[np.arange(len(rows)), target] -= 1
                d /= len(rows)
                grad = {"dense": pooled.T @ d, "bias": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
                back = (d @ self.p["dense"].T) * (pooled > 0)
                for k, w in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    bytes_ = own[np.arange(len(rows))[:, None, None], at[:, k * FILTERS : (k + 1) * FILTERS, None] + np.arange(w)]  # row, filter, w
                    patch = self.p["embed"][bytes_].reshape(len(rows), FILTERS, w * EMBED)
                    grad[f"conv{w}"] = np.einsum("nf,nfk->kf", g, patch)
                    grad[f"shift{w}"] = g.sum(0)
                    to = np.einsum("nf,kf->nfk", g, self.p[f"conv{w}"]).reshape(-1, EMBED)
                    np.add.at(grad["embed"], bytes_.ravel(), to)
                step += 1
                for k, g in grad.items():  # Adam
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def windows(data: bytes) -> np.ndarray:
    """The text's bytes in windows, the last one filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L, as isalpha has it: ², ½ or Ⅷ are numbers."""
    return any(map(str.isalpha, text))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5, F.lit(0)) == 0


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNet | None:
    """A net from the texts that are not held out and whose language is given; None if there are none."""
    known = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000))
    some = max(LEAST_TEXTS, min(FIT_TEXTS, FIT_ALL // len(counts)))
    shares = session_of(docs).createDataFrame([(k, min(1_000_000, int(1_000_000 * some / n) + 1)) for k, n in counts.items()], "_lang string, _share int")
    known = known.join(F.broadcast(shares), F.col(lang) == F.col("_lang"))
    start = (F.pmod(F.xxhash64(F.lit("place"), F.col(key).cast("string")), F.greatest(F.lit(1), F.length(text) - FIT_CHARS)) + 1).cast("int")
    sample = known.where(draw < F.col("_share")).select(F.col(lang).alias("lang"), F.substring(F.col(text), start, F.lit(FIT_CHARS)).alias("text"), F.xxhash64(key, text).alias("o")).orderBy("o", "text").limit(2 * some * len(counts)).collect()
    langs = sorted(counts)
    place = {k: i for i, k in enumerate(langs)}
    each = [windows(r.text.encode()) for r in sample if has_letter(r.text)]
    labels = [place[r.lang] for r in sample if has_letter(r.text)]
    if not each:
        return None
    x, y = np.concatenate(each), np.repeat(labels, [len(w) for w in each])
    return ByteNet(langs).fit(x, y)


def identify(docs: DataFrame, net: ByteNet | None, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` of every row with lang_pred and score: the mean of the windows' probabilities, weighted by
    their bytes. `und` with score 0 where the text is null or has no letter, or where nothing could be learned.

    Repeated rows give a row each; an empty table gives none; null ids are kept; other columns are ignored.
    """
    shared = session_of(docs).sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for batch in batches:
            for piece in groups_of(batch, "_text", 2_000_000):
                own = piece.column("_text").to_pylist()
                data = [t.encode() if net and t and has_letter(t) else b"" for t in own]
                some = [i for i, d in enumerate(data) if d]
                lang, score = [UNKNOWN] * len(own), np.zeros(len(own))
                if some:
                    each = [windows(data[i]) for i in some]
                    n = np.array([len(w) for w in each])
                    first = np.cumsum(n) - n
                    p = net.predict(np.concatenate(each)).astype(np.float64)
                    size = np.full(len(p), float(WINDOW))
                    size[first + n - 1] = [len(data[i]) - (k - 1) * WINDOW for i, k in zip(some, n.tolist(), strict=True)]
                    mean = np.add.reduceat(p * size[:, None], first) / np.add.reduceat(size, first)[:, None]
                    for i, k, s in zip(some, mean.argmax(1).tolist(), mean.max(1).tolist(), strict=True):
                        lang[i], score[i] = net.langs[k], min(1.0, s)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(lang), pa.array(score)], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
