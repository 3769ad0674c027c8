"""Conversations whose turns alternate again: the cheapest edits, by shortest paths with buckets for small whole costs.

A conversation is a path through nodes (rows done, what the roles so far end with): START, SYSTEM, USER, ANSWER. Each
edit is an arc: Keep 0, Rerole 1, Delete 2, Insert 5, and 5 more for a truncated row that is not deleted. Dial's queue
records how far every node is from the end; the audit then walks arcs that lose exactly what they cost, the letter that
is least in ASCII first.

A conversation is cut into segments of consecutive rows. Of one that lies in a single segment nothing but its rows is
needed. Of a longer one each segment first gives its 4 x 4 least costs from state to state, which are chained from the
end to give how far the end is from each border; then where its walks from each of the 4 states come out, which are
chained from the start. So no task holds more than a segment's rows, whatever share of the table a conversation has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stash

START, SYSTEM, USER, ANSWER = range(4)
#: Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The role that an inserted or reroled row gets after each state, and the state it leads to.
ROLE, TO = ("user", "user", "assistant", "user"), (USER, USER, ANSWER, USER)
#: How far the end of a conversation is from each state at its last row: START and ANSWER may end it.
GOAL = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
#: Rows and bytes of text of a segment (a single longer text has one of its own).
ROWS, BYTES = 65_536, 8 << 20
#: What counts as white space in texts.
SPACE = " \t\n\x0b\x0c\r"
#: Codes of rows: the initial of the role (s, u, a, others), TRUNC more if truncated; GONE must be deleted.
INITIALS, TRUNC, GONE = "sua", 4, 8


def _keeps(code: int, state: int) -> int | None:
    """The state to which keeping a row leads, if the pattern allows it."""
    initial = code % TRUNC
    if code == GONE or initial == 3:
        return None
    if initial == 0:
        return SYSTEM if state == START else None
    return TO[state] if (TO[state] == USER) == (initial == 1) else None


def _arcs(code: int) -> list[list[tuple[int, int]]]:
    """For each state that a row of this code can lead to, the states before and what the cheapest edit costs."""
    into: list[dict[int, int]] = [{s: DELETE} for s in range(4)]
    left = TRUNCATED if TRUNC <= code < GONE else 0
    for s in range(4):
        if code != GONE:
            into[TO[s]][s] = min(into[TO[s]].get(s, FAR), REROLE + left)
        if (kept := _keeps(code, s)) is not None:
            into[kept][s] = min(into[kept].get(s, FAR), left)
    return [list(x.items()) for x in into]


ARCS = [_arcs(code) for code in range(GONE + 1)]
KEEPS = [[_keeps(code, s) for s in range(4)] for code in range(GONE + 1)]
BEFORE = [[s for s in range(4) if TO[s] == t] for t in range(4)]


def distances(codes: bytes, end: tuple[int, ...] | list[int]) -> list[int]:
    """How far node 4 * row + state is from the end, which is `end` away from the states after the last row. A ring of
    buckets holds the nodes by distance: one more than the longest arc, or than the ends lie apart."""
    n = len(codes)
    dist = [FAR] * (4 * n + 4)
    near = [d for d in end if d < FAR]
    size = max(INSERT, REROLE + TRUNCATED, max(near) - min(near)) + 1
    ring: list[list[int]] = [[] for _ in range(size)]
    for s, d in enumerate(end):
        if d < FAR:
            dist[4 * n + s] = d
            ring[d % size].append(4 * n + s)
    waiting, d = len(near), min(near)
    while waiting:
        bucket = ring[d % size]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != d:
                continue  # a shorter way has been found since
            row, state = divmod(node, 4)
            steps = [(4 * row + s, INSERT) for s in BEFORE[state]]
            if row:
                steps += [(4 * row - 4 + s, cost) for s, cost in ARCS[codes[row - 1]][state]]
            for before, cost in steps:
                if d + cost < dist[before]:
                    dist[before] = d + cost
                    ring[(d + cost) % size].append(before)
                    waiting += 1
        d += 1
    return dist


def ways(codes: bytes) -> list[int]:
    """Least costs from each state before a segment (slow index) to each one after it."""
    to = [distances(codes, [0 if s == t else FAR for s in range(4)]) for t in range(4)]
    return [to[t][s] for s in range(4) for t in range(4)]


def walk(codes: bytes, dist: list[int], state: int, last: bool) -> tuple[str, int, int]:
    """The letters of the edits from a state on, the state that they end in, and their cost. Edits at the border of two
    segments belong to the later one."""
    audit, row, n, first = [], 0, len(codes), dist[state]
    while True:
        here = dist[4 * row + state]
        if row == n and (not last or here == 0):
            return "".join(audit), state, first - here
        if row < n:
            code, below = codes[row], 4 * row + 4
            left = TRUNCATED if TRUNC <= code < GONE else 0
            if dist[below + state] + DELETE == here:
                audit.append("D")
                row += 1
                continue
        if dist[4 * row + TO[state]] + INSERT == here:
            audit.append("I")
            state = TO[state]
            continue
        kept = KEEPS[code][state]
        if kept is not None and dist[below + kept] + left == here:
            audit.append("K")
            state = kept
        else:
            audit.append("R")
            state = TO[state]
        row += 1


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(role, text) of what the edits leave and make of a segment's rows."""
    out, row = [], 0
    for letter in audit:
        if letter == "I":
            out.append((ROLE[state], ""))
            state = TO[state]
            continue
        if letter == "R":
            out.append((ROLE[state], texts[row]))
            state = TO[state]
        elif letter == "K":
            out.append((roles[row], texts[row]))
            state = SYSTEM if roles[row][0] == "s" else TO[state]
        row += 1
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text,
    2 takes out full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Null roles and texts, and
    null ids and turns in what is hashed, are one space; ids and turns themselves stay null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_nth")).drop("_nth")


def _judged(rows: DataFrame) -> DataFrame:
    """rows in order, with initial and fault (0 none, 1 blank, 2 duplicate, 3 truncated). What repeats is found by
    counting digests, which combine before the shuffle; a long conversation is cut by the ranges it is sorted in."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    base = stash(rows.select("conv_id", "turn", "role", "text", digest.alias("_digest"), F.monotonically_increasing_id().alias("_row")), "conversations")
    first = base.groupBy("conv_id", "_digest").agg(F.count("*").alias("_n"), F.min(F.struct("turn", "_row")).alias("_first")).where("_n > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("_digest").alias("_same"), F.col("_first._row").alias("_first"))
    joined = base.join(first, base["conv_id"].eqNullSafe(first["_conv"]) & (base["_digest"] == first["_same"]), "left")
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    again = F.col("_first").isNotNull() & (F.col("_first") != F.col("_row"))
    fault = F.when(body == "", 1).when(again, 2).when(~F.substring(body, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "_digest", "_row"]
    kept = joined.select("conv_id", "turn", "role", "text", "_digest", "_row", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))
    return kept.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "initial", "fault")


FACTS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _facts(turns: list, initials: list[str], faults: list[int]) -> tuple:
    known = [t for t in turns if t is not None]
    pairs = sum(p not in LEGAL for p in zip(initials, initials[1:]))
    ends = (known[0], known[-1]) if known else (None, None)
    return (*(faults.count(i) for i in (1, 2, 3)), pairs, len(set(known)), *ends, initials[0], initials[-1])


def _cut(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows in lists of one conversation each, none of more than `most` rows or, but for a single row, BYTES of text."""
    own, size = [], 0
    for row in rows:
        if own and (row[0] != own[-1][0] or len(own) >= most or size + len(row[3]) > BYTES):
            yield own
            own, size = [], 0
        own.append(row)
        size += len(row[3])
    if own:
        yield own


def _table(schema: str, conv: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of the columns of a schema text, conv_id first."""
    plain = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = [pa.array(list(c), conv if name == "conv_id" else plain[kind]) for (name, kind), c in zip(fields, zip(*rows), strict=True)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


def _segments(rows: DataFrame, most: int) -> DataFrame:
    """A row for each segment: where it lies (part, seg), whether its conversation is whole in it (whole), the codes of
    its rows, roles and texts, and facts that add up."""
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, part int, seg long, whole boolean, codes binary, roles array<string>, texts array<string>, {FACTS}"

    def run(batches):
        part, conv = TaskContext.get().partitionId(), None

        def each():
            nonlocal conv
            for batch in batches:
                conv = batch.schema.field("conv_id").type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def row(own, seg, whole):
            _, turns, roles, texts, initials, faults = zip(*own)
            codes = bytes(GONE if f in (1, 2) else (INITIALS.index(i) if i and i in INITIALS else 3) + (TRUNC if f == 3 else 0) for i, f in zip(initials, faults))
            return (own[0][0], part, seg, whole, codes, list(roles), list(texts), *_facts(list(turns), list(initials), list(faults)))

        # a conversation that the part begins or ends with may go on in another part
        out, size, seg, held, begun = [], 0, 0, None, False
        for own in _cut(each(), most):
            if held is not None:
                ends = own[0][0] != held[0][0]
                out.append(row(held, seg, begun and ends))
                size += sum(len(r[3]) for r in held)
                seg, begun = seg + 1, ends
                if size > BYTES or len(out) >= 4_096:
                    yield _table(schema, conv, out)
                    out, size = [], 0
            held = own
        if held is not None:
            yield _table(schema, conv, [*out, row(held, seg, False)])
        release()

    return rows.mapInArrow(run, schema)


def _chained(df: DataFrame, order: list[Column], schema: str, step) -> DataFrame:
    """For each row of a conversation's segments in order, what step makes of it and of what it made of the one before:
    (state, columns). A few numbers of each segment are read one after the other; nothing is collected."""

    def run(batches):
        state, conv = None, (None,)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if conv != (row["conv_id"],):
                    state, conv = None, (row["conv_id"],)
                state, columns = step(state, row)
                out.append((row["conv_id"], row["part"], row["seg"], *columns))
            if out:
                yield _table(schema, batch.schema.field("conv_id").type, out)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


def _borders(split: DataFrame) -> DataFrame:
    """part, seg and, for each segment of conversations in several, how far the end is from each state after it (end),
    whether it is the last, and the state it is entered in."""
    key = f"conv_id {dict(split.dtypes)['conv_id']}, part int, seg long"

    def costs(batches):
        for batch in batches:
            rows = [(r["conv_id"], r["part"], r["seg"], ways(r["codes"])) for r in batch.to_pylist()]
            if rows:
                yield _table(f"{key}, ways array<long>", batch.schema.field("conv_id").type, rows)

    def backward(end, row):
        last, end = end is None, GOAL if end is None else end
        return [min(row["ways"][4 * s + t] + end[t] for t in range(4)) for s in range(4)], (list(end), last)

    def leave(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                dist = distances(r["codes"], r["end"])
                rows.append((r["conv_id"], r["part"], r["seg"], [walk(r["codes"], dist, s, r["last"])[1] for s in range(4)]))
            if rows:
                yield _table(f"{key}, leave array<long>", batch.schema.field("conv_id").type, rows)

    def forward(state, row):
        entry = START if state is None else state
        return row["leave"][entry], (entry,)

    codes = split.select("conv_id", "part", "seg", "codes")
    across = codes.mapInArrow(costs, f"{key}, ways array<long>")
    ends = _chained(across, [F.desc("part"), F.desc("seg")], f"{key}, end array<long>, last boolean", backward)
    ends = stash(ends, "conversation-ends")
    left = codes.join(ends.drop("conv_id"), ["part", "seg"]).select("conv_id", "part", "seg", "codes", "end", "last").mapInArrow(leave, f"{key}, leave array<long>")
    entries = _chained(left, ["part", "seg"], f"{key}, entry int", forward)
    return ends.join(entries.drop("conv_id"), ["part", "seg"]).select("part", "seg", "end", "last", "entry")


@dataclass
class Repaired:
    """Segments of conversations: conv_id, part and seg (their order), audit (letters of the edits), cost, roles and texts
    of what is left, and facts. `whole` has one segment a conversation; `split` those of conversations in several."""

    whole: DataFrame
    split: DataFrame

    def rows(self) -> DataFrame:
        """The repaired conversations: conv_id, part, seg and pos (their order), role and text."""
        both = self.whole.unionByName(self.split).select("conv_id", "part", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "_row"))
        return both.select("conv_id", "part", "seg", "pos", F.col("_row.roles").alias("role"), F.col("_row.texts").alias("text"))


def repair(rows: DataFrame, *, most: int = ROWS) -> Repaired:
    """The cheapest edits that delete all blank and repeated rows and leave roles whose initials are (s?(ua)+)?; of equally
    cheap ones those whose letters are least in ASCII.

    rows: conv_id, turn, role and text, taken by turn. A row's first fault counts: blank (white space alone), duplicate
    (its role and text stand earlier in the conversation), truncated (its last character but white space is no full
    stop, exclamation or question mark). Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or
    assistant row) 5; a truncated row that is not deleted 5 more. A segment has `most`
    rows at most. Stages are written to the shared folder.

    Nulls: a null conv_id is a conversation of its own; null turns come first; null roles and texts count as empty. Rows of
    one turn follow a digest of role and text, equal ones beside each other. An empty role has no initial, so that such a
    row cannot stay as it is. An empty table gives no segments. Other columns are ignored.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    segments = stash(_segments(_judged(rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), empty("role"), empty("text"))), most), "segments")
    facts = [x.split(" ")[0] for x in FACTS.split(", ")]
    schema = f"conv_id {dict(segments.dtypes)['conv_id']}, part int, seg long, audit string, cost long, roles array<string>, texts array<string>, {FACTS}"

    def edit(batches):
        for batch in batches:
            out, size = [], 0
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                audit, _, cost = walk(r["codes"], distances(r["codes"], r["end"]), r["entry"], r["last"])
                kept = edited(audit, r["entry"], r["roles"], r["texts"])
                out.append((r["conv_id"], r["part"], r["seg"], audit, cost, [k[0] for k in kept], [k[1] for k in kept], *(r[f] for f in facts)))
                size += sum(map(len, r["texts"]))
                if size > BYTES:
                    yield _table(schema, batch.schema.field("conv_id").type, out)
                    out, size = [], 0
            if out:
                yield _table(schema, batch.schema.field("conv_id").type, out)
        release()

    whole, split = segments.where("whole"), segments.where("NOT whole")
    alone = whole.withColumns({"end": F.array(*(F.lit(d).cast("bigint") for d in GOAL)), "last": F.lit(True), "entry": F.lit(START)})
    return Repaired(alone.mapInArrow(edit, schema), split.join(_borders(split), ["part", "seg"]).mapInArrow(edit, schema))


def report(repaired: Repaired) -> DataFrame:
    """conv_id, gaps (turns missing between the least and the greatest), blank, duplicate, truncated, illegal (adjacent rows
    before the repair whose initials are not su, ua or au), cost, audit and repaired_sha256 (of role:text of the repaired
    rows, joined by newlines). The segments of a long conversation are read one after another, never together; its
    audit is one value, as it is asked for."""
    kind = dict(repaired.whole.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches):
        conv, total = None, None
        for batch in batches:
            out = []
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if conv != (r["conv_id"],):
                    if conv is not None:
                        out.append(close(conv[0], total))
                    conv, total = (r["conv_id"],), {"sums": [0] * 5, "audit": [], "sha": hashlib.sha256(), "any": False, "least": None, "turns": 0, "last": None, "initial": None}
                add(total, r)
            kind = batch.schema.field("conv_id").type
            if out:
                yield _table(schema, kind, out)
        if conv is not None:
            yield _table(schema, kind, [close(conv[0], total)])
        release()

    def add(t, r):
        t["sums"] = [a + r[s] for a, s in zip(t["sums"], sums, strict=True)]
        if t["initial"] is not None and (t["initial"], r["first_initial"]) not in LEGAL:
            t["sums"][3] += 1
        t["initial"] = r["last_initial"]
        if r["turns"]:
            t["turns"] += r["turns"] - (t["last"] == r["first_turn"])
            t["least"], t["last"] = r["first_turn"] if t["least"] is None else t["least"], r["last_turn"]
        t["audit"].append(r["audit"])
        for role, text in zip(r["roles"], r["texts"], strict=True):
            t["sha"].update(f"{chr(10) if t['any'] else ''}{role}:{text}".encode())
            t["any"] = True

    def close(conv, t):
        gaps = t["last"] - t["least"] + 1 - t["turns"] if t["turns"] else 0
        return (conv, gaps, *t["sums"], "".join(t["audit"]), t["sha"].hexdigest())

    split = repaired.split.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return repaired.whole.mapInArrow(run, schema).unionByName(split.mapInArrow(run, schema))


def for_all(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """found with a row for each conversation of the table: one without rows after the damage has zeros, an empty audit
    and the hash of nothing."""
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    joined = every.join(found, every["_conv"].eqNullSafe(found["conv_id"]), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    rest = {"audit": F.lit(""), "repaired_sha256": F.lit(nothing)}
    return joined.select(F.col("_conv").alias("conv_id"), *(F.coalesce(c, rest.get(c, F.lit(0))).alias(c) for c in found.columns if c != "conv_id"))
