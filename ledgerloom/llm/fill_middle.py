"""Fill-in-the-middle: texts cut in three and put together anew around sentinels, by one scan of a byte automaton."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .packing import groups_of

#: Sentinels before prefix, suffix and middle; of a hundred texts, those that stay plain and, of the rest, those in spm order.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, SPM = 10, 20
#: Bytes of a slice; slices that the automaton runs over at once, which bounds a worker's memory for texts of any length.
SLICE, AT_ONCE = 256, 8_192
#: A byte that UTF-8 never has: it fills slices up and changes no state.
FILL = 0xFF


class Automaton:
    """Transitions by state and byte: the next state, and counts that a transition adds.

    A state is what has been read of a sentinel and how many continuation bytes of a character are to come. A transition
    counts a unit where a character begins, and a sentinel where one ends. Both parts of a state follow from the last
    `reach` bytes, so a slice can start anywhere once it has read those before it. An entry of `table` holds the next
    state from bit 24 on, sentinels from bit 12 on and units below, so that the sum of a slice's entries counts both.
    """

    UNIT, SENTINEL, COUNTS = 1, 1 << 12, (1 << 24) - 1

    def __init__(self, sentinels: tuple[str, ...]):
        marks = {s.encode() for s in sentinels}
        begun = {m[:i] for m in marks for i in range(len(m))}
        states, rows, todo = {(b"", 0): 0}, {}, [(b"", 0)]
        for read, left in todo:  # grows while states turn up
            row = []
            for byte in range(256):
                if byte == FILL:
                    row.append(states[read, left] << 24)
                    continue
                more = byte & 0xC0 == 0x80
                after = max(left - 1, 0) if more else 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
                now = read + bytes([byte])
                kept = next(now[i:] for i in range(len(now) + 1) if now[i:] in begun)
                to = (kept, after)
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                row.append(states[to] << 24 | (0 if more else self.UNIT) | (self.SENTINEL if any(now.endswith(m) for m in marks) else 0))
            rows[states[read, left]] = row
        self.table = np.array([rows[i] for i in range(len(rows))], np.uint32).ravel()
        self.begins = (self.table[:256] & self.UNIT).astype(bool)
        self.reach = max(3, *(len(m) - 1 for m in marks))

    def scan(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slices of the texts at starts: for each, the number of its text, its units and its sentinels. All slices of a
        group step on together, a byte of each at a time."""
        count = -(-sizes // SLICE)
        owner = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        units, found = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        for a in range(0, len(owner), AT_ONCE):
            own, first = owner[a : a + AT_ONCE], nth[a : a + AT_ONCE] * SLICE
            columns = _windows(data, starts[own], sizes[own], first, -self.reach, SLICE).T.copy()
            state, total = np.zeros(len(own), np.uint32), np.zeros(len(own), np.uint32)
            for i, column in enumerate(columns):
                step = self.table[(state << np.uint32(8)) | column]
                if i >= self.reach:
                    total += step & np.uint32(self.COUNTS)
                state = step >> np.uint32(24)
            units[a : a + AT_ONCE], found[a : a + AT_ONCE] = total % self.SENTINEL, total // self.SENTINEL
        return owner, units, found


def _windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, left: int, right: int) -> np.ndarray:
    """For each text, its bytes from first + left to first + right; FILL where the text has none."""
    at = first[:, None] + np.arange(left, right)
    inside = (at >= 0) & (at < sizes[:, None])
    return np.where(inside, data[np.where(inside, at + starts[:, None], 0)], np.uint8(FILL))


@functools.cache
def automaton(sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(sentinels)


def locate(auto: Automaton, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, units: np.ndarray, n: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The second pass: bytes of each text before its unit number `cut`, from the counts of its slices and one look at
    the slice that holds the unit. All of a text's bytes where it has no unit of that number."""
    before = np.concatenate(([0], np.cumsum(units)))
    first_slice = np.searchsorted(owner, np.arange(len(n)))
    out, asked = sizes.copy(), np.flatnonzero(cut < n)
    want = before[first_slice[asked]] + cut[asked]
    slot = np.searchsorted(before, want, side="right") - 1
    for a in range(0, len(asked), AT_ONCE):
        rows, j = asked[a : a + AT_ONCE], slot[a : a + AT_ONCE]
        first = (j - first_slice[rows]) * SLICE
        begins = np.cumsum(auto.begins[_windows(data, starts[rows], sizes[rows], first, 0, SLICE)], axis=1)
        out[rows] = first + (begins == (want[a : a + AT_ONCE] - before[j] + 1)[:, None]).argmax(axis=1)
    return out


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 that follow from a seed and a row's key alone (a null key: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _rows(batch: pa.RecordBatch, auto: Automaton, sentinels: tuple[str, ...], plain: int, spm: int) -> pa.RecordBatch:
    column = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"\0", np.uint8)
    starts, sizes = offsets[:-1], np.diff(offsets)
    owner, units, found = auto.scan(data, starts, sizes)
    n = np.bincount(owner, units, len(sizes)).astype(np.int64)
    marked = np.bincount(owner, found, len(sizes)) > 0
    h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
    cuts = np.sort(np.stack((h1 % (n + 1), h2 % (n + 1))), axis=0)
    form = np.where((n == 0) | marked | (h3 % 100 >= 100 - plain), "plain", np.where(h4 % 100 < spm, "spm", "psm"))
    left, right = (starts + locate(auto, data, starts, sizes, owner, units, n, cut) for cut in cuts)
    view, out = memoryview(data), []
    p, s, m = (x.encode() for x in sentinels)
    for kind, a, b, c, d in zip(form.tolist(), starts.tolist(), left.tolist(), right.tolist(), (starts + sizes).tolist(), strict=True):
        if kind == "plain":
            out.append(bytes(view[a:d]))
        else:
            first, second = (p + bytes(view[a:b]), s + bytes(view[c:d])) if kind == "psm" else (s + bytes(view[c:d]), p + bytes(view[a:b]))
            out.append(b"".join((first, second, m, view[b:c])))
    cut = form != "plain"
    middle = cuts[1] - cuts[0]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(cuts[0], mask=~cut), pa.array(middle, mask=~cut), pa.array(out, pa.binary()).cast(pa.string())],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(docs: DataFrame, *, seed: str = "1", sentinels: tuple[str, ...] = SENTINELS, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), and output.

    psm is prefix, suffix, middle, each behind its sentinel; spm is suffix, prefix, middle. Where a text is cut and what
    form it takes follow from the seed and its doc_id alone. Empty texts and those that hold a sentinel stay plain, as
    does `plain` of a hundred of the rest. One pass over the table, no shuffle; texts are read in slices, so that a very
    long one costs its own bytes and no more.

    Nulls: a null text is empty; a null doc_id is kept, and draws as one without digits. Repeated rows give the same row
    as often as they occur; rows of one doc_id with different texts draw alike. An empty table gives no rows. Columns
    besides doc_id and text are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = texts(docs)
    rows = rows.select("doc_id", "text", *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)))

    def run(batches):
        auto = automaton(sentinels)
        for batch in batches:
            for piece in groups_of(batch):
                yield _rows(piece, auto, sentinels, plain, spm)

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text that an output of a form was made from: a text with a sentinel is plain, so the three sentinels of any
    other form are where it parts."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def digest_columns(made: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
