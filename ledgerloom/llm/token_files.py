"""Token ids as files of patched frame-of-reference blocks, in the order of documents, and back.

A shard holds whole documents (SHARD ids, or one longer document) in one byte string, little-endian throughout:

    magic "PFOR", version u16, width of the ids in bytes u16
    documents u64, ids u64, blocks u64, exceptions u64
    ids of each document u64, documents of them
    for each block: start of its words u64, number of its first exception u64, least id u32, width in bits u8
    words of all blocks, u32
    exceptions: place in the block u8 each, then what is above the width each, as wide as the ids

A block is BLOCK ids (the last one is filled up with its least id). Its least id is taken off, and what is left is packed
at the width that holds SHARE of the block's ids; those that need more keep their low bits in place, and their high bits
are exceptions. As block starts are indexed, any range of ids is read without the blocks around it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, texts
from .packing import groups_of
from .tokens import word_ids

#: Ids of a block; the share of a block's ids that its width holds; ids of a shard, unless one document has more.
BLOCK, SHARE, SHARD = 256, 0.95, 1 << 20
HEAD = struct.Struct("<4sHHQQQQ")
INDEX = np.dtype([("start", "<u8"), ("first", "<u8"), ("least", "<u4"), ("width", "u1")])
#: Values that are packed together: as many words hold them as they have bits.
LANE = 32


def _spread(values: np.ndarray, width: int) -> np.ndarray:
    """Words of rows of LANE values of `width` bits: value i lies at bits i * width and on of its row."""
    lanes = np.ascontiguousarray(values.T)
    words = np.zeros((width, values.shape[0]), np.uint32)
    for i in range(LANE):
        word, bit = divmod(i * width, LANE)
        words[word] |= lanes[i] << np.uint32(bit)
        if bit + width > LANE:
            words[word + 1] |= lanes[i] >> np.uint32(LANE - bit)
    return np.ascontiguousarray(words.T)


def _gather(words: np.ndarray, width: int) -> np.ndarray:
    """The values that _spread has packed."""
    lanes = np.ascontiguousarray(words.T)
    values, mask = np.empty((LANE, words.shape[0]), np.uint32), np.uint32((1 << width) - 1)
    for i in range(LANE):
        word, bit = divmod(i * width, LANE)
        x = lanes[word] >> np.uint32(bit)
        if bit + width > LANE:
            x |= lanes[word + 1] << np.uint32(LANE - bit)
        np.bitwise_and(x, mask, out=values[i])
    return np.ascontiguousarray(values.T)


def _bits(x: np.ndarray) -> np.ndarray:
    """Binary digits of numbers below 2^32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _blocks(ids: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index, words, places and high bits of the exceptions of ids in blocks of their own."""
    count = -(-len(ids) // BLOCK)
    values = np.empty((count, BLOCK), np.uint32)
    flat = values.reshape(-1)
    flat[: len(ids)] = ids
    flat[len(ids) :] = ids[(count - 1) * BLOCK :].min()
    index = np.zeros(count, INDEX)
    index["least"] = values.min(axis=1)
    values -= index["least"][:, None]
    rank = min(BLOCK, max(1, int(np.ceil(share * BLOCK)))) - 1
    index["width"] = _bits(np.partition(values, rank, axis=1)[:, rank])
    over = values >> np.minimum(index["width"], 31).astype(np.uint32)[:, None]
    over[index["width"] == 32] = 0
    odd = np.flatnonzero(over)
    at, place = np.divmod(odd, BLOCK)
    index["first"] = np.searchsorted(at, np.arange(count))
    words = np.concatenate(([0], np.cumsum(index["width"].astype(np.int64) * (BLOCK // LANE))))
    index["start"] = words[:-1]
    packed = np.zeros(int(words[-1]), "<u4")
    for w in np.unique(index["width"]).tolist():
        own = np.flatnonzero(index["width"] == w)
        if w:
            rows = _spread((values[own] & np.uint32((1 << w) - 1)).reshape(-1, LANE), w).reshape(len(own), -1)
            packed[words[own][:, None] + np.arange(rows.shape[1])] = rows
    return index, packed, place.astype(np.uint8), over.ravel()[odd]


def encode_shard(ids: np.ndarray, lengths: np.ndarray, *, share: float = SHARE) -> bytes:
    """Ids (below 2^32) of documents of these lengths, as a shard. SHARD ids are worked on at once."""
    size = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    parts = [_blocks(ids[a : a + SHARD], share) for a in range(0, len(ids), SHARD)]
    words = exceptions = 0
    for index, packed, place, _ in parts:
        index["start"] += words
        index["first"] += exceptions
        words, exceptions = words + len(packed), exceptions + len(place)
    parts = [(*p[:3], p[3].astype(f"<u{size}")) for p in parts]
    head = HEAD.pack(b"PFOR", 1, size, len(lengths), len(ids), sum(len(p[0]) for p in parts), exceptions)
    return b"".join((head, lengths.astype("<u8").tobytes(), *(x.tobytes() for column in zip(*parts) for x in column)))


class Shard:
    """A shard's bytes, of which only what is asked for is unpacked."""

    def __init__(self, data: bytes):
        self._unpacked = None
        magic, version, self.size, documents, self.n, blocks, exceptions = HEAD.unpack_from(data)
        if magic != b"PFOR" or version != 1:
            raise ValueError("this is no shard of token ids")
        at = HEAD.size
        self.lengths = np.frombuffer(data, "<u8", documents, at).astype(np.int64)
        self.index = np.frombuffer(data, INDEX, blocks, at := at + 8 * documents)
        at += INDEX.itemsize * blocks
        words = int(self.index[-1]["start"]) + int(self.index[-1]["width"]) * (BLOCK // LANE) if blocks else 0
        self.words = np.frombuffer(data, "<u4", words, at)
        self.place = np.frombuffer(data, np.uint8, exceptions, at := at + 4 * words)
        self.high = np.frombuffer(data, f"<u{self.size}", exceptions, at := at + exceptions)
        if len(data) != at + self.size * exceptions:
            raise ValueError("the shard is cut short")

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids number start to stop (exclusive), from the blocks that hold them."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        index = self.index[a:b]
        values = np.zeros((b - a, BLOCK), np.uint32)
        for w in np.unique(index["width"]).tolist():
            own = np.flatnonzero(index["width"] == w)
            if w:
                rows = self.words[index["start"][own].astype(np.int64)[:, None] + np.arange(w * (BLOCK // LANE))]
                values[own] = _gather(rows.reshape(-1, w), w).reshape(len(own), BLOCK)
        first = int(index[0]["first"])
        last = int(self.index[b]["first"]) if b < len(self.index) else len(self.place)
        firsts = np.append(index["first"].astype(np.int64), last)
        block = np.repeat(np.arange(b - a), np.diff(firsts))
        values[block, self.place[first:last]] |= (self.high[first:last].astype(np.uint64) << index["width"][block].astype(np.uint64)).astype(np.uint32)
        values += index["least"][:, None]
        return values.reshape(-1)[start - a * BLOCK : stop - a * BLOCK]

    def crc32(self, start: int, stop: int) -> int:
        """The checksum of ids start to stop as little-endian 32-bit numbers; SHARD ids are unpacked at once."""
        if self._unpacked is None and self.n <= SHARD:
            self._unpacked = self.ids().astype("<u4", copy=False)
        if self._unpacked is not None:
            return zlib.crc32(self._unpacked[start:stop])
        found = 0
        for a in range(start, stop, SHARD):
            found = zlib.crc32(self.ids(a, min(stop, a + SHARD)).astype("<u4", copy=False), found)
        return found


def _order(spread: Column) -> list[Column]:
    """Documents by doc_id, nulls first; those of one doc_id by a hash of their text, then as they are spread."""
    return [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), spread]


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, shard: int = SHARD, share: float = SHARE) -> None:
    """Encode the texts, each followed by end_id, and write them as shards in the order of doc_id to path.

    Texts are sorted by ranges, so that a part holds the documents between two ids; each part cuts its own stream into
    shards, of which one is in memory at a time. Spark's own writer carries the shards, one a row of a Parquet table:
    only what a task has committed is there, whatever is lost or run twice, and on any store. Columns: part, seq (the
    shard's number in the part), before (ids before it in the part), n, doc_ids, and data, the bytes of the shard.

    Nulls: a null text counts as empty and gives end_id alone; null doc_ids are kept, and come first. Rows of one doc_id
    follow a hash of their text; equal rows are written as often as they occur, and may be spread over parts. An empty
    table gives no shards. Columns besides doc_id and text are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    ordered = texts(docs).withColumn("_row", F.monotonically_increasing_id())
    keys = _order(F.col("_row"))
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches):
        words, part, seq, before = word_ids(tokenizer), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], words.kind).tobytes()
        doc_ids, pieces, total = [], [], 0

        def flush():
            nonlocal doc_ids, pieces, total, seq, before
            lengths = np.array([len(p) // words.kind.itemsize for p in pieces], np.int64)
            data = encode_shard(np.frombuffer(b"".join(pieces), words.kind), lengths, share=share)
            ids = pa.concat_arrays(doc_ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            out = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([total], pa.int64()), listed, pa.array([data], pa.binary())]
            seq, before = seq + 1, before + total
            doc_ids, pieces, total = [], [], 0
            return pa.RecordBatch.from_arrays(out, ["part", "seq", "before", "n", "doc_ids", "data"])

        for batch in batches:
            for piece in groups_of(batch):
                column, at = piece.column("doc_id"), 0
                for i, ids in enumerate(words.ids(piece.column("text").to_pylist())):
                    n = len(ids) // words.kind.itemsize + 1
                    if pieces and total + n > shard:
                        if i > at:
                            doc_ids.append(column.slice(at, i - at))
                        at = i
                        yield flush()
                    pieces.append(ids + end)
                    total += n
                if at < len(column):
                    doc_ids.append(column.slice(at))
        if pieces:
            yield flush()

    shards = ordered.mapInArrow(run, f"part int, seq long, before long, n long, doc_ids array<{kind}>, data binary")
    shards.write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The shards at path with `start`: the ids of all parts and shards before each. The driver gets one total a part."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base = np.cumsum([0, *(r.n for r in parts)]).tolist()
    spark_base = spark.createDataFrame([(r.part, b) for r, b in zip(parts, base)], "part int, base long")
    return shards.join(F.broadcast(spark_base), "part").select("part", "seq", (F.col("base") + F.col("before")).alias("start"), "n", "doc_ids", "data")


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of its ids as little-endian unsigned
    32-bit numbers), from the bytes of the shards."""
    kind = dict(shards.dtypes)["doc_ids"].removeprefix("array<")[:-1]

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                shard = Shard(batch.column("data")[i].as_buffer())
                ends = np.cumsum(shard.lengths)
                crc = [shard.crc32(a, b) for a, b in zip((ends - shard.lengths).tolist(), ends.tolist(), strict=True)]
                starts = batch.column("start")[i].as_py() + ends - shard.lengths
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, *(pa.array(x, pa.int64()) for x in (starts, shard.lengths, crc))], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )
            release()

    return shards.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def export(shards: DataFrame, uri: str) -> DataFrame:
    """Write each shard as a file of its own, part-00000-00000000.pfor, into the folder at uri (any that pyarrow's file
    systems open), for readers that map files into memory; gives path, start, n and doc_ids of each. A task writes under
    a name of its own first, so that a file is whole whoever else writes it."""
    kind = dict(shards.dtypes)["doc_ids"]

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "data")), strict=True):
                path = f"{root}/part-{part:05d}-{seq:08d}.pfor"
                own = f"{path}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(own) as out:
                    out.write(data)
                store.move(own, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(batch.column(c) for c in ("start", "n", "doc_ids"))], ["path", "start", "n", "doc_ids"])

    return shards.mapInArrow(run, f"path string, start long, n long, doc_ids {kind}")
