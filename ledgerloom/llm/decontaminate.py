"""Benchmark decontamination: documents that contain a test item within an edit budget."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, session_of, texts
from .packing import groups_of

#: Edits allowed against the length of an item; code points of the items that one scan of the documents looks for.
RATE, BLOCK = 0.08, 8_000_000


def normal(text: str) -> str:
    """Lower case, with one blank for each run of white space, and none at the ends."""
    return " ".join(text.lower().split())


@dataclass(frozen=True)
class Item:
    id: int
    text: str
    budget: int

    @classmethod
    def of(cls, id: int, text: str, rate: float) -> "Item":
        return cls(id, text, int(len(text) * rate))

    def pieces(self) -> list[tuple[int, str]]:
        """budget + 1 pieces of nearly equal length with their places: that many edits leave one of them whole."""
        n, k = len(self.text), self.budget + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Bit-parallel edit distance of a pattern to the substrings of a text: a bit for each place of the pattern."""

    def __init__(self, pattern: str):
        self.size, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, budget: int) -> tuple[int, int] | None:
        """The least distance to a substring, up to budget, and the first place after such a substring."""
        full, last, masks = (1 << self.size) - 1, 1 << self.size - 1, self.masks
        up, down, score, found = full, 0, self.size, None
        for at, c in enumerate(text):
            same = masks.get(c, 0)
            level = same | down
            across = (((same & up) + up) ^ up) | same
            more, less = down | (full & ~(across | up)), up & across
            if more & last:
                score += 1
            elif less & last:
                score -= 1
            more, less = more << 1 & full, less << 1 & full
            up, down = less | (full & ~(level | more)), more & level
            if score <= budget:
                found, budget = (score, at + 1), score - 1
                if budget < 0:
                    break
        return found


class Finder:
    """All items within their budgets in a text."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items, self.patterns = items, {}
        at: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for place, piece in item.pieces():
                at.setdefault(piece, []).append((i, place + len(piece)))
        self.trie = ahocorasick.Automaton()
        for piece, where in at.items():
            self.trie.add_word(piece, where)
        self.trie.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """item id, distance, place after the match in the normalised text; one row an item, the least distance."""
        starts: dict[int, set[int]] = {}
        for end, where in self.trie.iter(text):
            for i, shift in where:
                starts.setdefault(i, set()).add(end + 1 - shift)
        out = []
        for i, own in starts.items():
            item, best = self.items[i], None
            n, k = len(item.text), item.budget
            for s in own:
                if s >= 0 and text.startswith(item.text, s):
                    end = s + n
                    best = (0, end) if best is None or best[0] or end < best[1] else best
            windows: list[list[int]] = []
            for s in sorted(own) if best is None else ():
                if windows and s - k <= windows[-1][1]:
                    windows[-1][1] = s + n + k
                else:
                    windows.append([max(0, s - k), s + n + k])
            for a, b in windows:
                if i not in self.patterns:
                    self.patterns[i] = Myers(item.text)
                if (hit := self.patterns[i].best(text[a:b], k)) and (best is None or hit[0] < best[0]):
                    best = (hit[0], hit[1] + a)
            if best:
                out.append((item.id, *best))
        return sorted(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block: int = BLOCK, rows: bool = False) -> DataFrame:
    """doc_id, item_id, distance, stop (the place after the match in the normalised text) for each pair of a document
    and a benchmark item that a substring of the document matches within rate * length edits. With `rows` also row
    (common.row_key), which tells apart rows with null or repeated ids.

    An item is cut into budget + 1 pieces, of which a match contains one unchanged; one automaton finds all pieces, and
    only the places around them are verified. The benchmark goes to the workers in blocks of bounded size, each with a
    scan of its own, so that nothing that grows with it is broadcast whole; documents are never shuffled.

    Both sides are normalised (case, white space). Items with null or blank text match nothing; null texts count as
    empty; null ids are kept. Repeated rows of docs give rows each; items of equal text each match. An empty table on
    either side gives no rows. Other columns are ignored.
    """
    spark = session_of(docs)
    own = benchmark.select("item_id", "text").where("text is not null")
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    docs = texts(docs)
    keep = ["doc_id", "row"] if rows else ["doc_id"]
    if rows:
        docs = docs.withColumn("row", row_key())
    kinds = dict(docs.dtypes)["doc_id"], dict(own.dtypes)["item_id"]
    out = None
    for i in range(blocks):
        items = [Item.of(r.item_id, t, rate) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect() if (t := normal(r.text))]
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            finder = Finder(shared.value)
            for batch in batches:
                for piece in groups_of(batch) if shared.value else ():
                    hits = [(j, *hit) for j, t in enumerate(piece.column("text").to_pylist()) for hit in finder.find(normal(t))]
                    if hits:
                        at, item, distance, stop = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays([*(piece.column(c).take(pa.array(at)) for c in keep), pa.array(item, _ARROW[kinds[1]]), pa.array(distance, pa.int32()), pa.array(stop, pa.int64())], [*keep, "item_id", "distance", "stop"])

        found = docs.mapInArrow(run, f"doc_id {kinds[0]}{', row long' if rows else ''}, item_id {kinds[1]}, distance int, stop long")
        out = found if out is None else out.unionByName(found)
    return out


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
