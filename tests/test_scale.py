"""What a small file's rows grow into is shared out among tasks."""

import math
import random
import statistics

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom import edge_queries
from ledgerloom.operators import adapt, layout, pages, payoff, transfers
from ledgerloom.session import dealt
from ledgerloom.sources import lenses, statements
from tests.test_operators import _plan


def _tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_plans_of_many_debts_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(payoff, "DEBTS_A_TASK", 50, raising=False)
    debts = spark.range(400).coalesce(1).select("id", (F.col("id") * 7.25 + 10).alias("balance"), (F.col("id") % 30 + 4.99).alias("apr"))
    assert _tasks(payoff.payoff_table(debts)) > 4


def test_plans_as_one_debt_at_a_time_has_them(spark):
    rng = random.Random(5)
    cases = [(round(rng.uniform(1, 20000), rng.choice((0, 1, 2))), rng.choice((0.0, 4.99, 12.0, 24.0, 29.99, 6.0)), rng.choice((25.0, 50.0, 100.5, 333.33, 4000.0))) for _ in range(3000)]
    cases += [(None, 5.0, 10.0), (10.0, None, 10.0), (10.0, 5.0, None), (float("nan"), 5.0, 10.0), (float("inf"), 5.0, 10.0), (-1.0, None, None)]
    rows = spark.createDataFrame(cases, "b double, r double, p double").select("b", "r", "p", payoff.payoff(F.col("b"), F.col("r"), F.col("p")).alias("x")).collect()
    for row in rows:
        if row.b is not None and row.b <= 0:
            assert (row.x.months, row.x.total_interest, row.x.series) == (0, 0.0, [])
        elif None in (row.b, row.r, row.p) or not math.isfinite(row.b) or row.p <= round(row.b * (row.r / 100 / 12), 2):
            assert row.x is None
        else:
            wanted = _plan(row.b, row.r, row.p)
            assert wanted == (row.x and (row.x.months, row.x.total_interest)), row
            assert row.x is None or [p.month for p in row.x.series] == list(range(1, row.x.months + 1)) and row.x.series[-1].balance == 0


def test_bills_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(lenses, "PARTS_A_TASK", 50, raising=False)
    assert _tasks(lenses.bills(spark, "/root/testdata/sf0.001")) > 2


def test_rows_of_many_pages_in_one_batch(spark):
    """Pages that end inside a batch, go on in the next, or have no key; as one page at a time has them, in few batches."""
    rng = random.Random(3)
    words = [(None if p == 7 else f"p{p}", i, float(y), float(y) + rng.choice((0.0, 8.0, 10.0))) for p in range(60) for i in range(rng.choice((1, 2, 5, 40))) for y in (rng.randrange(200),)]
    wanted = {}
    for page in {w[0] for w in words}:
        own = sorted((w for w in words if w[0] == page), key=lambda w: ((w[2] + w[3]) / 2, w[1]))
        heights = [w[3] - w[2] for w in own if w[3] > w[2]]
        reach = layout.ROW_REACH * statistics.median(heights) if heights else layout.NO_HEIGHT
        row, held = -1, []
        for w in own:
            middle = (w[2] + w[3]) / 2
            if held and abs(middle - sum(held) / len(held)) <= reach:
                held.append(middle)
            else:
                row, held = row + 1, [middle]
            wanted[w[0], w[1]] = row
    df = spark.createDataFrame(words, "page string, x1 int, y1 double, y2 double")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {(r.page, r.x1): r.row for r in layout.number_rows(df).collect()} == wanted
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_where_pages_begin(spark):
    """Pages are told apart for a whole batch at once."""
    df = spark.range(3000).select(F.floor(F.col("id") / 3).alias("page"), F.col("id").cast("double").alias("y1"), (F.col("id") + 1).cast("double").alias("y2"), F.lit(1.0).alias("x1")).coalesce(1)
    run = layout.number_rows(df)
    assert run.count() == 3000 and run.select("page", "row").distinct().count() == 3000
    assert layout._starts(pa.array([1, 1, None, None, 2])) == [0, 2, 4]


def test_heads_and_rows_come_from_one_parse(spark):
    docs = spark.createDataFrame([("a", '{"Bank":"B","transactions":[{"date":"2024-01-02","withdrawal":1.5}]}'), ("b", "{")], "statement_id string, json string")
    parsed = statements.kept(statements.parse(docs)[0])
    joined = adapt.adapt_accounts(parsed, adapt.adapt_rows(parsed))
    assert "parse_json" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.statement_id, r.bank_name, r.total_withdrawals) for r in joined.collect()] == [("a", "B", 1.5)]


def test_statements_are_parsed_once_a_row(spark):
    """Filters on what was parsed are not written out as its parsing, over and over."""
    docs = spark.createDataFrame([("a", 'So:\n```json\n{"transactions":[{"date":"2024-01-02","withdrawal":"$1.50"},{"date":null}]}\n```'), ("b", "{")], "statement_id string, json string")
    good, failures = statements.parse(statements.generated(docs))
    rows = adapt.adapt_rows(good)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") < 8 and plan.count("regexp_replace") < 100
    assert [(r.statement_id, r.pos, str(r.date), r.amount) for r in rows.collect()] == [("a", 0, "2024-01-02", -1.5)]
    assert [(r.statement_id, r.reason) for r in failures.collect()] == [("b", "no JSON")]


def test_legs_with_no_partner_are_not_gone_through(spark, monkeypatch):
    """A class of pairs goes through the legs that have one to meet in it, not through all legs of an amount."""
    pushed = []
    push = transfers._Queue.push
    monkeypatch.setattr(transfers._Queue, "push", lambda self, *leg: (pushed.append(leg), push(self, *leg)) and None)
    n = 400
    legs = {"pos": np.arange(n), "account_id": np.arange(n) % 90, "amount": np.where(np.arange(n) % 2, 10.0, -10.0), "cents": np.full(n, 1000), "day": np.arange(n) * 10}
    legs |= {"word": np.zeros(n, bool), "ends": np.zeros(n, int), "starts": np.zeros(n, int)}
    assert transfers.sweep(legs, np.full(n, 8)) == ([], []) and not pushed
    legs["day"][1] = legs["day"][0] + 2
    assert transfers.sweep(legs, np.full(n, 8)) == ([(0, 1, False, 2)], []) and len(pushed) == 1


def test_legs_with_nobody_near_make_no_cells(monkeypatch):
    """Legs without one of the other sign near them are told apart for the block at once; what may be taken from outside
    stays to be judged."""
    n, seen = 600, []
    numbered = transfers._numbered
    monkeypatch.setattr(transfers, "_numbered", lambda *columns: (seen.append(len(columns[0])), numbered(*columns))[1])
    legs = {"pos": np.arange(n), "account_id": np.arange(n) % 90, "amount": -5.0 - np.arange(n), "cents": 500 + 100 * np.arange(n), "day": np.arange(n) % 40}
    legs |= {"word": np.zeros(n, bool), "ends": np.zeros(n, int), "starts": np.zeros(n, int)}
    outside = np.full(n, 8)
    outside[7] = 3
    legs["amount"][20], legs["cents"][20], legs["day"][20] = 14.99, 1499, 12  # across a cent from leg 10, two days on
    assert transfers.sweep(legs, outside) == ([(10, 20, False, 2)], [7])
    assert seen and max(seen) == 2


def test_small_blocks_are_swept_together(spark, monkeypatch):
    """Many blocks of few legs are few sweeps, and the pairs are those of one block."""
    sides = [(i // 3, 0) for i in range(300)]
    table = pa.table({"across": pa.array([s[0] for s in sides], pa.int64()), "along": pa.array([s[1] for s in sides], pa.int64()), "pos": pa.array(range(300))})
    for size in (1, 7, 300):
        groups = list(transfers._groups(iter(table.to_batches(max_chunksize=size)), 50))
        assert len(groups) <= 6 and pa.concat_tables(groups).column("pos").to_pylist() == list(range(300))
        owners = [set(g.column("across").to_pylist()) for g in groups]
        assert sum(map(len, owners)) == 100  # no block is parted
    legs = lenses.legs(spark, "/root/testdata/sf0.001")
    whole = {tuple(r) for r in transfers.pair_legs(legs).collect()}
    assert {tuple(r) for r in transfers.pair_legs(legs, block_legs=100).collect()} == whole and len(whole) > 100


def test_legs_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(transfers, "LEGS_A_TASK", 50, raising=False)
    legs = lenses.legs(spark, "/root/testdata/sf0.001")
    seen = []
    swept = transfers.written
    monkeypatch.setattr(transfers, "written", lambda df, name: (seen.append(df.rdd.getNumPartitions()) if name == "swept" else None, swept(df, name))[1])
    assert transfers.pair_legs(legs, block_legs=200).count() > 0
    assert seen[0] == -(-legs.count() // 50)


def test_header_rows_are_combined_before_they_are_sent(spark):
    """A row's headings are one number: one shuffle for the rows and one for the pages, no sort of either."""
    words = [("a", r, t) for r, t in ((0, "Date"), (0, "Details"), (0, "x"), (1, "Date"), (1, "posted"), (1, "Debit"), (1, "Balance"), (2, "Date"), (2, "Credits"), (2, "balance"), (50, "Date"))]
    words += [("b", 3, t) for t in ("Date", "Date", "Debit")] + [(None, 39, t) for t in ("DATE", "Debits", "Credit", "Balance")] + [("c", 40, t) for t in ("Date", "Debit", "Credit")]
    head = layout.header_row(spark.createDataFrame(words, "page string, row int, text string"))
    assert {tuple(r) for r in head.collect()} == {("a", 1), (None, 39)}
    plan = spark.createDataFrame(words, "page string, row int, text string").transform(layout.header_row)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "distinct" not in plan


def test_pages_of_orders_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(lenses, "ORDERS_A_TASK", 200, raising=False)
    assert _tasks(edge_queries._tables(spark, "/root/testdata/sf0.001")) > 2


def _words(spark, docs=20, lines=7):
    words = [(f"d{d}", p, 600.0, f"w{i}", 50.0 * x, 50.0 * x + 40, 20.0 * i, 20.0 * i + 10, 95.0) for d in range(docs) for p in range(2) for i in range(lines) for x in (2, 0, 1)]
    return spark.createDataFrame(words, "doc string, page int, width double, text string, x1 double, x2 double, y1 double, y2 double, conf double")


def _plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_sent_once(spark):
    """From words to lines there is one shuffle, a page known by a constant too; lines are read by page without any."""
    words = _words(spark)
    for each in (words, words.withColumn("page", F.lit(0))):
        assert _plan_of(pages.lines(each)).count("Exchange hashpartitioning") == 1
    found = dealt(pages.lines(words), "lines", "doc", "page")
    assert "Exchange" not in _plan_of(found.join(found.groupBy("doc", "page").count().hint("merge"), ["doc", "page"]))
    assert found.count() == 20 * 2 * 7 and not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_lines_that_go_on_in_the_next_batch(spark):
    words = _words(spark)
    wanted = {(f"d{d}", p, i): [f"w{i}"] * 3 for d in range(20) for p in range(2) for i in range(7)}
    for size in ("1", "4", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = pages.lines(words).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r.doc, r.page, r.row): [w.text for w in r.words] for r in got} == wanted and len(got) == len(wanted)
        assert all([w.x1 for w in r.words] == [0.0, 50.0, 100.0] for r in got)


def test_a_large_page_is_held_by_none():
    """Rows are known before the page's last words have come."""
    left = [pa.record_batch({"page": pa.array(["a"] * 4), "y1": pa.array([i * 20.0] * 4), "y2": pa.array([i * 20.0 + 10] * 4), "_reach": pa.array([6.0] * 4)}) for i in range(5)]
    batches = iter(left)
    rows = next(layout._numbered(batches, ["page"]))[1]
    assert rows.tolist() == [0] * 4 and len(list(batches)) == 4


def test_statements_read_their_words_once(spark, monkeypatch):
    seen = []
    lines = pages.lines
    monkeypatch.setattr(pages, "lines", lambda words: (seen.append(1), lines(words))[1])
    made = pages.statements(_words(spark, docs=2))
    assert len(seen) == 1 and made.count() == 2 and "ExistingRDD" not in _plan_of(made)
