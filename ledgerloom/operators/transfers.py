"""Money that leaves one account and arrives in another."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.num import CENT, finite
from ledgerloom.functions.text import TRANSFER_WORDS, transfer_word
from ledgerloom.session import written

#: Days between the legs at most.
WINDOW = 3
#: Legs that one task sweeps in one block, and in all its blocks on average; cents and days on the sides of a block, from all
#: legs in one block to the smallest blocks.
BLOCK_LEGS, LEGS_A_TASK = 200_000, 100_000
#: Legs at least that are swept at once, of as many blocks as it takes.
GROUP_LEGS = 20_000
GRIDS = ((0, 0), (1 << 18, 1 << 10), (1 << 14, 512), (1 << 11, 256), (256, 128), (64, 64), (16, 32))


def _words(out_pos: Column, out_text: Column, in_pos: Column, in_text: Column) -> Column:
    """Whether the texts of both legs, the earlier row's first, hold a transfer word."""
    return F.when(out_pos < in_pos, transfer_word(out_text, in_text)).otherwise(transfer_word(in_text, out_text))


def candidates(txns: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """out_pos, in_pos, has_word, gap: pairs of rows on different accounts (a null one equals another), with amounts of
    opposite sign that agree to the cent, no more than `window` days apart.

    An equi-join on the cents and a bin of days, in place of a join on inequalities: the legs out go to the bins around
    theirs. Rows need pos (unique), account_id, amount, date and description; zero, null or non-finite amounts and null
    days make no pairs. The number of pairs is that of the result; a very common amount also parts by the bins.
    """
    width = window + 1
    amount = finite(F.col("amount"))
    legs = txns.select(
        "pos", "account_id", amount.alias("amount"), F.col("date"), "description", F.round(F.abs(amount) * 100).cast("bigint").alias("cents"),
        F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / width).cast("int").alias("bin"),
    ).where((F.col("amount") != 0) & F.col("date").isNotNull())
    out = legs.where(F.col("amount") < 0).select(
        *(F.col(c).alias(f"out_{c}") for c in ("pos", "account_id", "amount", "date", "description")),
        F.explode(F.array(*(F.col("cents") + d for d in (-1, 0, 1)))).alias("cents"), "bin",
    )
    out = out.withColumn("bin", F.explode(F.array(*(F.col("bin") + d for d in (-1, 0, 1)))))
    into = legs.where(F.col("amount") > 0).select(*(F.col(c).alias(f"in_{c}") for c in ("pos", "account_id", "amount", "date", "description")), "cents", "bin")
    gap = F.abs(F.datediff("in_date", "out_date"))
    pairs = out.join(into, ["cents", "bin"]).where(
        ~F.col("out_account_id").eqNullSafe(F.col("in_account_id")) & (F.abs(F.col("out_amount") + F.col("in_amount")) <= CENT) & (gap <= window)
    )
    words = _words(F.col("out_pos"), F.col("out_description"), F.col("in_pos"), F.col("in_description"))
    return pairs.select("out_pos", "in_pos", words.alias("has_word"), gap.alias("gap"))


def _split_words() -> list[tuple[str, str]]:
    """Transfer words of several words, parted at each blank: they may begin in one leg's text and end in the other's."""
    parts = [w.split(" ") for w in TRANSFER_WORDS]
    return [(" ".join(p[:i]), " ".join(p[i:])) for p in parts for i in range(1, len(p))]


def _legs(txns: DataFrame) -> DataFrame:
    """pos, account_id, amount, cents, day (a number) and what its text holds: word, ends and starts (bits of the parts of
    words in _split_words that its text ends or starts with)."""
    amount, text = finite(F.col("amount")), F.upper(F.coalesce("description", F.lit("")))
    bits = lambda test, side: sum((F.when(test(text, F.lit(w[side])), 1 << i).otherwise(0) for i, w in enumerate(_split_words())), F.lit(0))
    legs = txns.select(
        F.col("pos").cast("bigint").alias("pos"), F.col("account_id").cast("string").alias("account_id"), amount.alias("amount"),
        F.round(F.abs(amount) * 100).cast("bigint").alias("cents"), F.unix_date("date").alias("day"),
        F.coalesce(transfer_word(text), F.lit(False)).alias("word"), bits(F.endswith, 0).alias("ends"), bits(F.startswith, 1).alias("starts"),
    )
    return legs.where((F.col("amount") != 0) & F.col("day").isNotNull())


class _Queue:
    """Legs by account in order of position: the first one of another account than a given one."""

    def __init__(self):
        self.own: dict[int, deque[int]] = {}
        self.heads: list[tuple[int, int]] = []

    def _top(self) -> tuple[int, int] | None:
        while self.heads:
            leg, account = self.heads[0]
            if self.own[account] and self.own[account][0] == leg:
                return self.heads[0]
            heapq.heappop(self.heads)
        return None

    def first(self, account: int) -> int | None:
        top = self._top()
        if top is None or top[1] != account:
            return top and top[0]
        heapq.heappop(self.heads)
        second = self._top()
        heapq.heappush(self.heads, top)
        return second and second[0]

    def push(self, leg: int, account: int) -> None:
        queue = self.own.setdefault(account, deque())
        queue.append(leg)
        if len(queue) == 1:
            heapq.heappush(self.heads, (leg, account))

    def pop(self, account: int) -> None:
        queue = self.own[account]
        queue.popleft()
        if queue:
            heapq.heappush(self.heads, (queue[0], account))


class _Least:
    """Of legs that come in any order, the least one of another account than a given one."""

    def __init__(self):
        self.best: list[tuple[int, int]] = []

    def push(self, leg: int, account: int) -> None:
        each = dict((a, x) for x, a in reversed(self.best))
        each[account] = min(leg, each.get(account, leg))
        self.best = sorted((x, a) for a, x in each.items())[:2]

    def first(self, account: int) -> int | None:
        return next((leg for leg, own in self.best if own != account), None)


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, the same where the columns are equal, and a row for each number."""
    number = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        each = np.unique(column, return_inverse=True)[1]
        _, first, number = np.unique(number * (each.max() + 1) + each, return_index=True, return_inverse=True)
    return number, first


def _meets(legs: dict[str, np.ndarray], window: int) -> np.ndarray:
    """Whether a leg of the other sign lies within two cents and the window of days: no pair without one."""
    inward, met = legs["amount"] > 0, np.zeros(len(legs["pos"]), bool)
    first = int(legs["day"].min()) - window
    step = int(legs["day"].max()) + window + 1 - first
    place = legs["cents"].astype(np.int64) * step + (legs["day"].astype(np.int64) - first)
    if int(legs["cents"].max()) > (1 << 62) // step:
        return ~met  # places would not fit into 64 bits: all are gone through
    for side in (inward, ~inward):
        others, own = np.sort(place[~side]), place[side]
        found = np.zeros(len(own), bool)
        for d in range(-2, 3):
            at = own + d * step
            found |= np.searchsorted(others, at - window) < np.searchsorted(others, at + window, "right")
        met[side] = found
    return met


def sweep(legs: dict[str, np.ndarray], outside: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, bool, int]], list[int]]:
    """Pairs (earlier leg, later leg, has_word, gap) of a block's legs, in order of position, that the greedy choice takes
    whatever legs are outside the block; and the legs about which the block alone can't say.

    The ranks' first two parts are classes: word or none, then the gap. Within a class the choice is a sweep by position:
    a leg is taken by the earliest one still waiting that it fits. outside holds, for each leg, the first class in which
    a leg outside might take it; from then on it is in doubt, and so is each leg that would wait for it or take it, were
    it there. A pair is taken only if no leg in doubt stands before it.

    Legs of one sign, amount, day and kind of text are a cell; what may take from what is found once for the cells, and a
    class goes through the legs of those cells only that have one to take from or to wait for.
    """
    n, last = len(legs["pos"]), 2 * (window + 1)
    if not n:
        return [], []
    met = _meets(legs, window)
    if not met.all():  # the others change nothing here: they are left for where the legs outside are
        kept = np.flatnonzero(met)
        alone = np.flatnonzero(~met & (outside < last)).tolist()
        pairs, rest = sweep({c: x[kept] for c, x in legs.items()}, outside[kept], window)
        at = kept.tolist()
        return [(at[a], at[b], word, gap) for a, b, word, gap in pairs], sorted(alone + [at[i] for i in rest])
    values, at = np.unique(np.abs(legs["amount"]), return_inverse=True)
    low, high = np.searchsorted(values, values - 2 * CENT).tolist(), np.searchsorted(values, values + 2 * CENT).tolist()
    inward = (legs["amount"] > 0).astype(int)
    kind, of_kind = _numbered(legs["word"], legs["ends"], legs["starts"])
    kinds = list(zip(*(legs[c][of_kind].tolist() for c in ("word", "ends", "starts"))))
    holds = [[bool(a[0] or b[0] or a[1] & b[2]) for b in kinds] for a in kinds]  # of an earlier and a later leg
    cells, of_cell = _numbered(inward, at, legs["day"], kind)
    places: dict[tuple[int, int], dict[int, list[int]]] = {}
    known = list(zip(*(x[of_cell].tolist() for x in (inward, at, legs["day"], kind))))
    for c, (way, i, day, _) in enumerate(known):
        places.setdefault((way, i), {}).setdefault(day, []).append(c)
    values = values.tolist()
    takes: list[dict[int, list[int]]] = [{} for _ in range(2 * (window + 1))]  # for each rank, from which cells a cell takes
    for c, (way, i, day, k) in enumerate(known):
        for j in range(low[i], high[i]):
            days = places.get((1 - way, j))
            if days is None or abs(values[j] - values[i]) > CENT:
                continue
            for d in range(day - window, day + window + 1):
                for x in days.get(d, ()):
                    takes[abs(d - day) + (0 if holds[known[x][3]][k] else window + 1)].setdefault(c, []).append(x)
    names: dict = {}
    account = [names.setdefault(x, len(names)) for x in legs["account_id"].tolist()]
    cell = cells.tolist()
    doubt, taken, pairs, first_doubt = bytearray(n), bytearray(n), [], outside.tolist()
    for rank, sources in enumerate(takes):
        word, gap = rank <= window, rank % (window + 1)
        met = np.zeros(len(known), bool)
        met[list(sources)] = True
        met[[x for found in sources.values() for x in found]] = True
        sure: dict[int, _Queue] = {}
        unsure: dict[int, _Least] = {}
        for q in np.flatnonzero(met[cells]).tolist():  # for others this rank changes nothing
            if taken[q]:
                continue
            if first_doubt[q] <= rank:
                doubt[q] = 1
            own, here, u, v, waiting = account[q], cell[q], None, None, None
            for c in sources.get(here, ()):
                if c in sure and (x := sure[c].first(own)) is not None and (u is None or x < u):
                    u, waiting = x, c
                if c in unsure and (x := unsure[c].first(own)) is not None and (v is None or x < v):
                    v = x
            if not doubt[q] and u is not None and (v is None or u < v):
                sure[waiting].pop(account[u])
                taken[u] = taken[q] = 1
                pairs.append((u, q, word, gap))
                continue
            if not doubt[q] and v is None:
                sure.setdefault(here, _Queue()).push(q, own)
                continue
            doubt[q] = 1
            if u is not None:
                sure[waiting].pop(account[u])
                doubt[u] = 1
                unsure.setdefault(waiting, _Least()).push(u, account[u])
            unsure.setdefault(here, _Least()).push(q, own)
    return pairs, [i for i in range(n) if not taken[i] and (doubt[i] or first_doubt[i] < last)]


_COLUMNS = "pos long, account_id string, amount double, cents long, day int, word boolean, ends int, starts int"


def _groups(batches: Iterator[pa.RecordBatch], least: int = GROUP_LEGS) -> Iterator[pa.Table]:
    """The legs of whole blocks, of several together until they are so many, of batches in which a block's rows follow one
    another: a hot amount makes all blocks small, and a block of few legs costs as much as one of a thousand."""
    held: list[pa.RecordBatch] = []
    rows, now = 0, None
    for batch in batches:
        if not len(batch):
            continue
        sides = np.stack([batch.column(c).to_numpy() for c in ("across", "along")])
        starts = np.flatnonzero((sides[:, 1:] != sides[:, :-1]).any(axis=0)) + 1
        cut = int(starts[-1]) if len(starts) else 0  # where the last block begins
        if held and rows + cut >= least and (cut or sides[:, 0].tolist() != now):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            batch, held, rows = batch.slice(cut), [], 0
        held.append(batch)
        rows, now = rows + len(batch), sides[:, -1].tolist()
    if held:
        yield pa.Table.from_batches(held)


def _round(left: DataFrame, grid: tuple[int, int], turn: int, window: int, tasks: int) -> DataFrame:
    """One sweep of every block: rows with a partner are pairs, those without are still to be judged."""
    cents, days = grid
    shift = (cents // 2 * (turn % 2), days // 2 * (turn // 2 % 2))
    side = lambda c, width, moved: F.floor((F.col(c) + moved) / width).cast("bigint") if width else F.lit(0).cast("bigint")
    placed = left.withColumns({"across": side("cents", cents, shift[0]), "along": side("day", days, shift[1])})
    names = [x.split(" ")[0] for x in _COLUMNS.split(", ")]

    def run(batches):
        # of blocks swept together, what a leg of another block might take is in doubt all the same
        for table in _groups(batches):
            table = table.sort_by("pos")
            legs = {c: table.column(c).to_numpy() for c in names if c != "account_id"} | {"account_id": table.column("account_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()}
            across, along = (table.column(c).to_numpy() for c in ("across", "along"))
            outside = np.full(len(table), 2 * (window + 1))
            if cents:
                edge = legs["cents"] + shift[0] - across * cents
                outside[(edge < 2) | (edge >= cents - 2)] = 0
            if days:
                edge = legs["day"] + shift[1] - along * days
                outside = np.minimum(outside, np.where((beyond := np.minimum(edge + 1, days - edge)) <= window, beyond, outside))
            pairs, rest = sweep(legs, outside, window)
            for rows, partners, words, gaps in (([p[0] for p in pairs], [p[1] for p in pairs], [p[2] for p in pairs], [p[3] for p in pairs]), (rest, None, None, None)):
                if rows:
                    own = table.take(pa.array(rows)).select(names).combine_chunks()
                    more = [
                        pa.array(legs["pos"][partners]) if partners else pa.nulls(len(rows), pa.int64()),
                        pa.array(words, pa.bool_()) if partners else pa.nulls(len(rows), pa.bool_()),
                        pa.array(gaps, pa.int32()) if partners else pa.nulls(len(rows), pa.int32()),
                    ]
                    for batch in own.to_batches():
                        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "partner", "has_word", "gap"])

    ordered = placed.repartition(tasks, "across", "along").sortWithinPartitions("across", "along", "pos")
    return ordered.mapInArrow(run, f"{_COLUMNS}, partner long, has_word boolean, gap int")


def pair_legs(txns: DataFrame, *, window: int = WINDOW, block_legs: int = BLOCK_LEGS) -> DataFrame:
    """out_pos, in_pos, has_word and gap: the pairs that a greedy choice by rank takes among all candidates, each row once.
    Rank: with a transfer word first, then fewer days, then the lower and the higher position.

    No list of candidates is made. Legs lie on a plane of cents and days; each task sweeps a block of it, and takes the
    pairs that no leg outside its block can change. What is left are the legs in doubt, near the borders: they are swept
    again in blocks half a side further on, which are the larger the fewer legs there are, until they fit into one. So
    the rounds follow the logarithm of the rows, and a hot amount costs no round of its own. A block takes time in
    proportion to its legs; the legs of one amount within the days of the smallest block are one task's, as numbers.

    Rows need pos (unique), account_id (a null one equals another), amount, date and description; zero, null or
    non-finite amounts and null days make no pairs. An empty table gives none. Rounds are written to the shared folder.
    """
    left, taken, turn = written(_legs(txns), "legs"), None, 0
    while True:
        tasks = max(1, -(-left.count() // LEGS_A_TASK))
        for grid in GRIDS:
            sides = [F.floor(F.col(c) / w) for c, w in zip(("cents", "day"), grid, strict=True) if w]
            largest = left.groupBy(*sides).count().agg(F.max("count")).first()[0] or 0
            if largest <= block_legs:
                break
        swept = written(_round(left, grid, turn, window, tasks), "swept")
        pairs = swept.where(F.col("partner").isNotNull())
        inward = F.col("amount") > 0
        pairs = pairs.select(F.when(inward, F.col("partner")).otherwise(F.col("pos")).alias("out_pos"), F.when(inward, F.col("pos")).otherwise(F.col("partner")).alias("in_pos"), "has_word", "gap")
        taken = pairs if taken is None else taken.unionByName(pairs)
        left, turn = swept.where(F.col("partner").isNull()).drop("partner", "has_word", "gap"), turn + 1
        if grid == GRIDS[0]:
            return taken  # one block has nothing outside


def mark_transfers(txns: DataFrame, *, window: int = WINDOW, sticky: bool = True) -> DataFrame:
    """txns with is_transfer: true on both legs of a matched pair; with sticky, what was true before stays so."""
    pairs = pair_legs(txns, window=window)
    used = pairs.select(F.explode(F.array("out_pos", "in_pos")).alias("_p"))
    joined = txns.join(used, txns["pos"] == used["_p"], "left")
    flag = F.col("_p").isNotNull()
    if sticky and "is_transfer" in txns.columns:
        flag = flag | F.coalesce(txns["is_transfer"], F.lit(False))
    return joined.withColumn("is_transfer", flag).drop("_p")
