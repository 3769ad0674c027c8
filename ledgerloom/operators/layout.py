"""Statements from word boxes on pages: rows, columns, and what each row is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ledgerloom.functions.num import agree
from ledgerloom.session import once, tasks

#: Of the median height, a row's reach; of a page's width, a column's; columns' reach for a word; words of a
#: column at least; mean confidence under which a row is doubtful.
ROW_REACH, COLUMN_REACH, ASSIGN, LEAST_WORDS, DOUBTFUL = 0.6, 0.02, 2.5, 2, 70.0
#: Fixed value: a row's reach where no word has a height.
NO_HEIGHT = 5.0
BORDERS = r"^[|_—―–=~<>*·•¦ ]+$"
CURRENCY = r"^[($€£-]*\d{1,3}(?:,\d{3})*(?:\.\d{2})?[)-]?$|^[($€£-]*\d+\.\d{2}[)-]?$"


def words_only(words: DataFrame) -> DataFrame:
    """Words without those that are borders of tables."""
    return words.where(F.col("text").isNotNull() & (F.trim("text") != "") & ~F.trim("text").rlike(BORDERS))


def is_currency(text: Column) -> Column:
    return F.regexp_replace(text, " ", "").rlike(CURRENCY)


def _starts(keys: pa.Array | pa.ChunkedArray) -> list[int]:
    """Where each run of equal keys begins; nulls are equal."""
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False) if isinstance(new, pa.Array) else new.to_numpy()) + 1).tolist()]


def _keys(key: str | tuple[str, ...]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _laid(words: DataFrame, keys: list[str]) -> DataFrame:
    """words dealt by page, in order from the top, with the reach of a row of their page (`_reach`): the one shuffle of words.
    A key that is a constant is made as any other, else the window goes by the rest alone and deals words a second time."""
    whole = once(words, {k: F.col(k) for k in keys} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("y1", "y2")})
    order = (*keys, (F.col("y1") + F.col("y2")) / 2, "x1")
    height = F.when((F.col("y2") > F.col("y1")) & ~F.isnan("y2"), F.col("y2") - F.col("y1"))
    reach = F.coalesce(ROW_REACH * F.percentile(height, 0.5).over(Window.partitionBy(*keys)), F.lit(NO_HEIGHT))
    return whole.repartition(tasks(words.sparkSession), *keys).sortWithinPartitions(*order).withColumn("_reach", reach)


def _numbered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of laid words, each word's row on its page, and whether a page begins with it. Only a row's sum and number of
    words go on from word to word; words of one height on the page, one after another, are of one row."""
    row, total, n, last = -1, 0.0, 0, None
    for batch in batches:
        if not len(batch):
            continue
        top, bottom, reach = (batch.column(c).to_numpy() for c in ("y1", "y2", "_reach"))
        middle = (top + bottom) / 2
        page = np.zeros(len(batch), bool)
        for k in keys:
            page[_starts(batch.column(k))] = True
        page[0] = last != [batch.column(k)[0].as_py() for k in keys]
        last = [batch.column(k)[-1].as_py() for k in keys]
        run = page.copy()
        run[0] = True
        run[1:] |= (middle[1:] != middle[:-1]) | ~np.isfinite(middle[1:])
        at = np.flatnonzero(run)
        sizes = np.diff([*at, len(batch)])
        rows = []
        for m, size, new, far in zip(middle[at].tolist(), sizes.tolist(), page[at].tolist(), reach[at].tolist()):
            if new:
                row, n = -1, 0
            if not n or not abs(m - total / n) <= far:
                row, total, n = row + 1, 0.0, 0
            for _ in range(size):
                total += m
            n += size
            rows.append(row)
        yield batch, np.repeat(np.array(rows, np.int32), sizes), page


def number_rows(words: DataFrame, key: str | tuple[str, ...] = "page") -> DataFrame:
    """words (key, text, x1, x2, y1, y2, conf) with `row`: from the top, a word joins the row before if its middle is
    within 0.6 median heights of that row's mean. Words come sorted by page and are handed on batch by batch: a page of
    any size is held by none."""
    names, keys = words.columns, _keys(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _ in _numbered(batches, keys):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows)], [*names, "row"])

    laid = _laid(words, keys)
    return laid.mapInArrow(run, StructType([*laid.select(*names).schema, StructField("row", IntegerType())]))


def gather_rows(words: DataFrame, fields: tuple[str, ...], key: str | tuple[str, ...] = "page") -> DataFrame:
    """key, row (as number_rows has it), width and words (an array of the fields) of every row: put together where the words
    are numbered, so that words are sent once. Tasks hold the words of one batch and of the row that goes on; rows stay
    dealt by the key to as many tasks as `session.tasks` says."""
    names = _keys(key)

    def gathered(parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches([p[0] for p in parts]).combine_chunks()
        rows, first = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        begins = np.flatnonzero(first)
        column = lambda c: pa.concat_arrays(whole.column(c).chunks)
        listed = pa.ListArray.from_arrays(pa.array([*begins, len(whole)], pa.int32()), pa.StructArray.from_arrays([column(c) for c in fields], list(fields)))
        own = [column(c).take(pa.array(begins)) for c in (*names, "width")]
        yield pa.RecordBatch.from_arrays([*own[:-1], pa.array(rows[begins]), own[-1], listed], [*names, "row", "width", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch, rows, page in _numbered(batches, names):
            first = page.copy()
            first[0] |= rows[0] != last
            first[1:] |= rows[1:] != rows[:-1]
            last = rows[-1]
            cut = int(np.flatnonzero(first)[-1]) if first.any() else 0  # where the last row begins
            if cut or (first[0] and held):
                yield from gathered([*held, (batch.slice(0, cut), rows[:cut], first[:cut])])
                held = []
            held.append((batch.slice(cut), rows[cut:], first[cut:]))
        if held:
            yield from gathered(held)

    laid = _laid(words, names)
    types = {f.name: f.dataType for f in laid.schema}
    inner = ArrayType(StructType([StructField(c, types[c]) for c in fields]))
    out = [*(StructField(k, types[k]) for k in names), StructField("row", IntegerType()), StructField("width", types["width"]), StructField("words", inner)]
    return laid.mapInArrow(run, StructType(out))


def columns(words: DataFrame, key: str | tuple[str, ...] = "page") -> DataFrame:
    """key, column (from the left) and edge: clusters of the right edges of amounts, where the next is within two
    hundredths of the page's width (`width`), of two words or more."""
    keys = _keys(key)
    order = Window.partitionBy(*keys).orderBy("x2")
    starts = words.where(is_currency(F.col("text"))).withColumn("_new", F.coalesce((F.col("x2") - F.lag("x2").over(order) > COLUMN_REACH * F.col("width")).cast("int"), F.lit(1)))
    islands = starts.withColumn("_c", F.sum("_new").over(order))
    edges = islands.groupBy(*keys, "_c").agg(F.avg("x2").alias("edge"), F.count("*").alias("_n")).where(F.col("_n") >= LEAST_WORDS)
    return edges.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("edge")) - 1).alias("column"), "edge")


def assign_columns(words: DataFrame, found: DataFrame, key: str = "page") -> DataFrame:
    """words with `column`: the nearest edge within reach, else null. A page has few columns; they travel as one array."""
    edges = found.groupBy(key).agg(F.collect_list(F.struct("column", "edge")).alias("_edges"))
    near = F.array_min(F.transform("_edges", lambda e: F.struct(F.abs(F.col("x2") - e["edge"]).alias("d"), e["column"].alias("c"))))
    joined = words.join(edges, key, "left").withColumn("_near", near)
    reach = ASSIGN * COLUMN_REACH * F.col("width")
    return joined.withColumn("column", F.when(is_currency(F.col("text")) & (F.col("_near.d") <= reach), F.col("_near.c"))).drop("_edges", "_near")


#: Words of a header row by the field that they head.
HEADINGS = {"date": "date|posted", "description": "description|details|particulars", "withdrawal": "withdrawals?|debits?|paid out", "deposit": "deposits?|credits?|paid in", "balance": "balance"}


def header_row(words: DataFrame, key: str = "page") -> DataFrame:
    """key and row of the header: among the first forty rows that with most different headings, three at least;
    the first, were several to have as many. A row's headings are bits of one number, so that words are combined before they
    are sent and nothing is sorted."""
    held = F
    for i, pattern in enumerate(HEADINGS.values()):
        held = held.when(F.lower("text").rlike(f"^(?:{pattern})$"), 1 << i)
    scored = words.where(F.col("row") < 40).withColumn("_h", held).where(F.col("_h").isNotNull()).groupBy(key, "row").agg(F.bit_count(F.bit_or("_h")).alias("score"))
    best = F.col("score").cast("bigint") * (1 << 33) - F.col("row")
    return scored.where("score >= 3").groupBy(key).agg(F.max_by("row", best).alias("row"))


def headings(words: DataFrame, head: DataFrame, key: str = "page") -> DataFrame:
    """key, role, x1 and x2 of the headings in the header rows that header_row found; the leftmost, were one to repeat.
    There are as many as pages, whatever their size is guessed at: they are not sent whole to each task."""
    role = F
    for name, pattern in HEADINGS.items():
        role = role.when(F.lower("text").rlike(f"^(?:{pattern})$"), name)
    found = words.join(head.hint("merge"), [key, "row"], "left_semi").withColumn("role", role).where(F.col("role").isNotNull())
    return found.groupBy(key, "role").agg(F.min("x1").alias("x1"), F.min_by("x2", "x1").alias("x2"))


#: Fields with amounts, from the left; how many columns' reaches a heading stands for.
MONEY, UNDER = ("withdrawal", "deposit", "balance"), 1.5


def recover_columns(words: DataFrame, found: DataFrame, heads: DataFrame, key: str | tuple[str, ...] = "page") -> DataFrame:
    """found (key, column, edge) and the columns of one amount alone, which make no cluster: a heading of money without
    a column near its right edge, but with amounts below it, gives one at their mean. Columns are numbered anew."""
    near, keys = UNDER * COLUMN_REACH, _keys(key)
    money = heads.where(F.col("role").isin(*MONEY)).select(*keys, "role", F.col("x2").alias("_right"))
    amounts = words.where(is_currency(F.col("text"))).select(*keys, "width", F.col("x2").alias("_x2"))
    under = amounts.join(money.hint("merge"), keys).where(F.abs(F.col("_x2") - F.col("_right")) <= near * F.col("width"))
    edges = under.groupBy(*keys, "role").agg(F.avg("_x2").alias("edge"), F.first("_right").alias("_right"), F.first("width").alias("width"))
    old = found.select(*keys, F.col("edge").alias("_edge"))
    same = [edges[k] == old[k] for k in keys]
    lone = edges.join(old.hint("merge"), [*same, F.abs(F.col("_edge") - F.col("_right")) <= near * F.col("width")], "left_anti")
    every = found.select(*keys, "edge").unionByName(lone.select(*keys, "edge"))
    return every.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("edge")) - 1).alias("column"), "edge")


def column_labels(count: Column, roles: Column) -> Column:
    """What so many columns of amounts hold, from the left, given the headings of money that were read, from the left:
    the headings if there are as many; else withdrawal, deposit and balance at the right; two are one of them and the
    balance; one is an amount, or the balance if only that has a heading."""
    fixed = lambda *names: F.array(*map(F.lit, names))
    has = lambda name: F.array_contains(roles, name)
    return (
        F.when(count == 0, F.array().cast("array<string>")).when(F.size(roles) == count, roles)
        .when(count >= 3, F.concat(F.array_repeat(F.lit("amount"), (count - 3).cast("int")), fixed(*MONEY)))
        .when(count == 2, F.when(has("withdrawal"), fixed("withdrawal", "balance")).when(has("deposit"), fixed("deposit", "balance")).otherwise(fixed("amount", "balance")))
        .when(has("balance"), fixed("balance")).otherwise(fixed("amount"))
    )


#: Rows of a page's head; rows below a heading and share of the page's width around it where its value may
#: stand; digits of an account number that is taken at once; numbers that are none.
HEAD, BELOW, AROUND, ENOUGH = 20, 4, 0.12, 6
PHONE_OR_DATE = r"^\+?1?-?\(?\d{3}\)?-\d{3}-\d{4}$|^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"


def account_numbers(words: DataFrame, key: str = "page") -> DataFrame:
    """key and account_number, for pages whose head (words with key, row, text, x1, x2, width) holds one.

    Numbers are looked for to the right of the first "account" that "no", "number", "num" or "#" follows, and below
    these two; on the whole head if it has no such heading. A number that ends with a dash goes on with the next one.
    The first with six digits is taken, else the first.
    """
    line = Window.partitionBy(key, "row").orderBy("x1")
    plain = lambda c: F.btrim(F.lower(c), F.lit(".:"))
    head = words.where(F.col("row") < HEAD).withColumns({"_next": F.lead("text").over(line), "_end": F.lead("x2").over(line)})
    named = (plain(F.col("text")) == "account") & plain(F.col("_next")).rlike("^(?:no.*|number|num|#)$")
    at = head.where(named).groupBy(key).agg(F.min(F.struct("row", "x1", F.col("_end").alias("x2"))).alias("_at"))
    numbers = head.where(F.trim("text").rlike(r"^\d[\d-]{2,}$") & ~F.trim("text").rlike(PHONE_OR_DATE)).join(at, key, "left")
    middle, reach = (F.col("x1") + F.col("x2")) / 2, AROUND * F.col("width")
    beside = (F.col("row") == F.col("_at.row")) & (F.col("x1") > F.col("_at.x1"))
    below = F.col("row").between(F.col("_at.row") + 1, F.col("_at.row") + BELOW) & middle.between(F.col("_at.x1") - reach, F.col("_at.x2") + reach)
    near = numbers.where(F.col("_at").isNull() | beside | below)
    listed = near.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "x1", F.trim("text").alias("text")))), lambda w: w["text"]).alias("_n"))
    last = lambda found: F.get(found, F.size(found) - 1)

    def join(state: Column, n: Column) -> Column:
        goes_on = state["open"]
        found = F.when(goes_on, F.concat(F.slice(state["found"], 1, F.size(state["found"]) - 1), F.array(F.concat(last(state["found"]), n)))).otherwise(F.concat(state["found"], F.array(n)))
        return F.struct(found.alias("found"), (~goes_on & n.endswith("-")).alias("open"))

    whole = F.aggregate("_n", F.struct(F.array().cast("array<string>").alias("found"), F.lit(False).alias("open")), join, lambda s: s["found"])
    long = F.filter("_whole", lambda n: F.length(F.regexp_replace(n, "-", "")) >= ENOUGH)
    return listed.withColumn("_whole", whole).select(key, F.coalesce(F.get(long, F.lit(0)), F.get("_whole", F.lit(0))).alias("account_number"))


def infer_signs(rows: DataFrame) -> DataFrame:
    """rows (statement_id, pos, value, balance, opening) with deposit and withdrawal: the side on which the amount takes
    the last known balance to this one; null where neither does."""
    before = Window.partitionBy("statement_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.last("balance", ignorenulls=True).over(before), F.col("opening"))
    delta = F.col("balance") - F.col("prior")
    return rows.withColumn("prior", prior).withColumns({
        "deposit": F.when(agree(delta, F.col("value")), F.col("value")), "withdrawal": F.when(agree(delta, -F.col("value")), F.col("value")),
    }).drop("prior")


def extract(pages: DataFrame, reader) -> DataFrame:
    """Words of binary documents (path, content) by a reader given from outside: content -> iterable of (page, width,
    text, x1, x2, y1, y2, conf). A document that the reader fails on gives no words."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out += [(path, *word) for word in reader(content)]
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=["path", "page", "width", "text", "x1", "x2", "y1", "y2", "conf"])

    return pages.select("path", "content").mapInPandas(read, "path string, page int, width double, text string, x1 double, x2 double, y1 double, y2 double, conf double")
