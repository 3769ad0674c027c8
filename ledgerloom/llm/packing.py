"""Concatenate and cut: token streams of documents laid end to end and cut into fixed windows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stash, texts
from .tokens import word_ids

#: Texts are encoded in groups of so many characters, which bounds a worker's memory.
GROUP_CHARS = 4_000_000


def groups_of(batch: pa.RecordBatch, name: str = "text", most: int = GROUP_CHARS):
    """Slices of a batch whose texts hold about `most` bytes; a longer single text is a slice of its own. A null has none."""
    sizes = pc.binary_length(batch.column(name))
    at, total = 0, 0
    for i, n in enumerate(sizes.fill_null(0).to_pylist()):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(batch):
        yield batch.slice(at)
    release()


def encoded(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, ids (little-endian), n, and the partition that encoded it with the tokens before it there."""

    def run(batches):
        part, before, words = TaskContext.get().partitionId(), 0, word_ids(path)
        end = np.array([end_id], words.kind).tobytes()
        for batch in batches:
            for piece in groups_of(batch):
                ids = [x + end for x in words.ids(piece.column("text").to_pylist())]
                n = np.array([len(x) // words.kind.itemsize for x in ids], np.int64)
                starts = before + np.concatenate(([0], n.cumsum()[:-1])) if len(n) else n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "before", "n", "ids"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, part int, before long, n long, ids binary")


def pack(docs: DataFrame, path: str, *, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of `window` tokens: no token is lost and only the last sequence may be short.

    The first pass encodes every document and writes the ids to the shared folder, with each document's place in its
    partition's stream. Prefix sums of one total per partition (all that reaches the driver) turn these places into
    places in the whole stream; the second pass cuts there, without a shuffle. A document over a cut gives several
    rows (boundary records). Documents follow the order in which they are read.

    Nulls: a null text counts as empty and gives the end id alone; a null doc_id is kept. Repeated rows are packed as
    often as they occur. An empty table gives no rows. Columns besides doc_id and text are ignored.
    """
    table = stash(encoded(texts(docs), path, end_id), "packing")
    totals = dict(table.groupBy("part").agg(F.sum("n")).collect())
    parts = sorted(totals)
    base = dict(zip(parts, np.concatenate(([0], np.cumsum([totals[p] for p in parts])[:-1])).astype(int).tolist() if parts else [], strict=True))
    total = sum(totals.values())
    short = total % window
    tail = short if short & (short - 1) == 0 else window

    def run(batches):
        kind = word_ids(path).kind
        for batch in (piece for whole in batches for piece in groups_of(whole, "ids")):
            starts = np.array([base[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("before").to_numpy()
            n = batch.column("n").to_numpy()
            k = (starts + n - 1) // window - starts // window + 1
            row = np.repeat(np.arange(len(n)), k)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            seq = starts[row] // window + nth
            left = np.maximum(seq * window, starts[row])
            right = np.minimum((seq + 1) * window, starts[row] + n[row])
            ids = [np.frombuffer(x, kind).astype("<u4") for x in batch.column("ids").to_pylist()]
            own, size = left - starts[row], right - left
            crc = [zlib.crc32(ids[r][a : a + s]) for r, a, s in zip(row.tolist(), own.tolist(), size.tolist(), strict=True)]
            padded = np.where((seq + 1) * window > total, tail, window)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (own, size, crc, n[row], seq, left - seq * window, padded))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"],
            )

    kind = dict(table.dtypes)["doc_id"]
    return table.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")
