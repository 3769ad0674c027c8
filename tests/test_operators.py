"""Operators against small cases and against plain Python."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import adapt, aggregates, categorize, layout, payoff, reconcile, recurring, store, transfers
from ledgerloom.plans import ask, dashboard
from ledgerloom.sources import statements
from ledgerloom.streaming import events

DAY = dt.date(2024, 1, 1)
TXN = "pos bigint, id string, account_id string, date date, description string, merchant string, category string, amount double, reference string, is_transfer boolean"


def txns(spark, rows):
    return spark.createDataFrame(rows, TXN)


def row(pos, amount, days=0, account="a", merchant="m", category="Other", description="d", transfer=None):
    return (pos, f"t{pos}", account, DAY + dt.timedelta(days), description, merchant, category, amount, None, transfer)


def test_aggregates_and_empty(spark):
    led = txns(spark, [row(1, -10.0), row(2, 25.5), row(3, -4.25, category=""), row(4, -100.0, transfer=True), row(5, -1.0, category=None)])
    s = aggregates.summary(led).first()
    assert (s.total_spent, s.total_income, s.net, s.txn_count) == (15.25, 25.5, 10.25, 4)
    assert {r.category: r.amount for r in aggregates.by_category(led).collect()} == {"Other": 15.25}
    assert sum(r.amount for r in aggregates.by_month(led).collect()) == s.total_spent
    empty = aggregates.summary(led.limit(0)).first()
    assert (empty.total_spent, empty.net, empty.txn_count, empty.date_from) == (0.0, 0.0, 0, "")
    assert aggregates.transfers_excluded(led).first().amount == 100.0
    assert aggregates.is_empty_result(led.limit(0)) and not aggregates.is_empty_result(led)
    with pytest.raises(ValueError):
        aggregates.recent(led, 0)


def _statement(spark, kind, opening, closing, rows, deposits=None, withdrawals=None, source="statement"):
    head = spark.createDataFrame([("s", kind, opening, closing, deposits, withdrawals, source)], "statement_id string, account_type string, opening_balance double, closing_balance double, total_deposits double, total_withdrawals double, totals_source string")
    lines = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(rows)], "statement_id string, pos int, amount double, balance double")
    return reconcile.reconcile(head, lines).first()


def test_reconcile(spark):
    good = _statement(spark, "checking", 100.0, 120.0, [(-30.0, 70.0), (50.0, 120.0)], 50.0, 30.0)
    assert good.reconciled and good.checks_run == 3 and good.flagged == []
    card = _statement(spark, "credit", 100.0, 80.0, [(-30.0, 130.0), (50.0, 80.0)], 50.0, 30.0)
    assert card.reconciled and card.checks_run == 3
    bad = _statement(spark, "checking", 100.0, 120.0, [(-30.0, 71.0), (50.0, 120.0)], 50.0, 30.0)
    assert not bad.reconciled and bad.flagged == [0, 1] and bad.check_balance
    gap = _statement(spark, "checking", 100.0, 120.0, [(-30.0, None), (50.0, 120.0)], 50.0, 30.0, "derived")
    assert gap.check_running is None and gap.check_totals is None and gap.checks_run == 1 and gap.reconciled
    none = _statement(spark, "checking", None, None, [(-30.0, None)])
    assert none.checks_run == 0 and not none.reconciled and none.delta == 0.0
    assert _statement(spark, "checking", 0.0, 0.01, [(0.02, None)]).check_balance
    assert not _statement(spark, "checking", 0.0, 0.01, [(0.05, None)]).check_balance
    assert _statement(spark, "checking", 0.0, 1.0, [(float("nan"), None)]).check_balance is None


@pytest.mark.parametrize("gaps,cadence", [([7, 7, 7], 7), ([14, 14], 14), ([30, 31, 30], 30), ([31, 28, 31], 30), ([30, 60, 30], 30), ([90, 91], 90), ([365, 366], 365), ([7, 2, 13, 18], None), ([30, 0, 30], None), ([30], None), ([30, 150, 30], None), ([50, 50, 50], None)])
def test_cadence(spark, gaps, cadence):
    days = [0]
    for g in gaps:
        days.append(days[-1] + g)
    found = recurring.find_recurring(txns(spark, [row(i, -9.99, d) for i, d in enumerate(days)])).collect()
    assert [r.cadence_days for r in found] == ([cadence] if cadence else [])


def test_recurring_values(spark):
    rows = [row(i, -a, i * 30, category=c) for i, (a, c) in enumerate([(15.99, "Groceries"), (15.99, "Subscriptions"), (16.0, "Subscriptions"), (20.0, "Groceries")])]
    r = recurring.find_recurring(txns(spark, rows)).first()
    assert r.amount == round((15.99 + 16.0) / 2, 2) and r.annual_cost == round((15.99 + 16.0) / 2 * 12, 2)
    assert r.category == "Groceries" and r.price_change_pct == 25.1 and r.kind == "fixed" and r.nature == "habitual"
    assert r.next_expected == DAY + dt.timedelta(120)
    odd = [row(9, float("nan")), row(10, None), row(11, -5.0, merchant=" "), row(12, -5.0, merchant=None), row(13, -5.0, 1, transfer=True)]
    again = recurring.find_recurring(txns(spark, rows + odd))
    assert again.count() == 1
    assert recurring.find_recurring(txns(spark, rows).limit(0)).count() == 0
    assert recurring.flag_recurring(txns(spark, rows + odd), again).where("is_recurring").count() == 4
    natures = spark.createDataFrame([("m", "bill"), ("m", "nonsense")], "merchant string, nature string")
    health = txns(spark, [row(i, -10.0, i * 30, category="Health") for i in range(3)])
    assert recurring.find_recurring(health, natures).first().nature == "bill"
    assert recurring.find_recurring(health).first().nature == "unclear"


def _plan(balance, apr, pay):
    rem, interest, months, r = balance, 0.0, 0, apr / 100 / 12
    if pay <= round(balance * r, 2):
        return None
    while rem > 0 and months < 600:
        i = round(rem * r, 2)
        rem, interest, months = max(0.0, round(rem + i - pay, 2)), interest + i, months + 1
    return (months, round(interest, 2)) if rem <= 0 else None


def test_payoff(spark):
    cases = [(3204.18, 24.99, 150.0), (1000.0, 0.0, 100.0), (1000.0, 24.0, 20.0), (0.0, 10.0, 50.0), (500.0, 19.99, 500000.0), (90000.0, 5.0, 380.0), (100.0, -1.0, 10.0)]
    df = spark.createDataFrame(cases, "b double, r double, p double").select(payoff.payoff(F.col("b"), F.col("r"), F.col("p")).alias("x"))
    got = [(r.x.months, r.x.total_interest) if r.x else None for r in df.collect()]
    assert got == [_plan(*cases[0]), (10, 0.0), None, (0, 0.0), _plan(*cases[4]), _plan(*cases[5]), None] and got[0] == (29, 1079.17)
    table = payoff.payoff_table(spark.createDataFrame([(3204.18, 24.99)], "balance double, apr double")).collect()
    assert sorted(r.months for r in table) == [12, 20, 36, 55] and min(r.monthly_payment for r in table) == 98.77
    assert all(r.series[-1].balance == 0 for r in table)
    assert payoff.payoff_table(spark.createDataFrame([(None, 1.0), (5.0, None), (-5.0, 1.0)], "balance double, apr double")).count() == 0


def _greedy(rows):
    found = []
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if a[2] != b[2] and a[7] * b[7] < 0 and abs(a[7] + b[7]) <= 0.01 + 1e-9 and abs((a[3] - b[3]).days) <= 3:
                word = any(w in f"{a[4]} {b[4]}".upper() for w in ("PAYMENT", "TRANSFER"))
                found.append((0 if word else 1, abs((a[3] - b[3]).days), i, j))
    used, pairs = set(), set()
    for _, _, i, j in sorted(found):
        if i not in used and j not in used:
            used |= {i, j}
            pairs.add(frozenset((i, j)))
    return pairs


@pytest.mark.parametrize("seed", range(3))
def test_transfers_are_greedy(spark, seed):
    rnd = random.Random(seed)
    rows = [row(i, rnd.choice([-1, 1]) * rnd.choice([10.0, 10.01, 20.0]), rnd.randrange(12), rnd.choice("abc"), description=rnd.choice(["x", "Payment"])) for i in range(60)]
    assert {frozenset((r.out_pos, r.in_pos)) for r in transfers.pair_legs(txns(spark, rows)).collect()} == _greedy(rows)


def test_transfer_edges(spark):
    rows = [row(0, -5.0), row(1, 5.0, account=None), row(2, -7.0, account=None), row(3, 7.0, account=None), row(4, -9.0), row(5, 9.02, account="b"), row(6, 0.0), row(7, None), row(8, -3.0), row(9, 3.0, 4, "b")]
    marked = {r.pos: r.is_transfer for r in transfers.mark_transfers(txns(spark, rows)).collect()}
    assert marked[0] and marked[1] and not any(marked[i] for i in range(2, 10))
    kept = transfers.mark_transfers(txns(spark, [row(0, -5.0, transfer=True)])).first()
    assert kept.is_transfer
    assert transfers.mark_transfers(txns(spark, [row(0, -5.0)]).limit(0)).count() == 0


def test_categorize_order(spark):
    none = spark.createDataFrame([], "merchant string, category string")
    known = spark.createDataFrame([("dict", "Travel"), ("bad", "Nonsense"), ("", "Travel")], "merchant string, category string")
    rows = [
        row(0, -1.0, merchant="p", description="x"), row(1, 5.0, merchant="p", description="payroll"), row(2, -1.0, merchant="p", description="payroll"),
        row(3, -1.0, merchant="dict", description="coffee"), row(4, -1.0, merchant="", description="coffee"), row(5, -1.0, merchant="", description="x"), row(6, -1.0, merchant=None, description=None), row(7, -1.0, merchant="bad"),
    ]
    got = {r.pos: (r.category, r.layer, r.confidence) for r in categorize.categorize(txns(spark, rows), known, none).collect()}
    assert got[0] == ("Other", "fallback", 0.0) and got[1] == ("Income", "keyword", 0.95) and got[2] == ("Income", "cache", 0.9)
    assert got[3] == ("Travel", "dict", 1.0) and got[4] == ("Food & Drink", "keyword", 0.95) and got[5][0] == "Other" and got[6][0] == "Other" and got[7][0] == "Other"
    enriched = spark.createDataFrame([("one", "Fuel", 95.0), ("two", "Fuel", 60.0), ("three", "Uncategorized", 99.0), ("four", "Fuel", 50.0)], "description string, category string, confidence double")
    opinions = spark.createDataFrame([(13, "Transportation"), (14, "Travel")], "pos bigint, category string")
    rows = [row(10, -1.0, merchant="e", description="one"), row(11, -1.0, merchant="e", description="x"), row(12, -1.0, merchant="f", description="two"), row(13, -1.0, merchant="g", description="four"), row(14, -1.0, merchant="h", description="three")]
    got = {r.pos: (r.category, r.layer) for r in categorize.categorize(txns(spark, rows), none, none, enriched, opinions).collect()}
    assert got == {10: ("Transportation", "enriched"), 11: ("Transportation", "cache"), 12: ("Transportation", "enriched_low"), 13: ("Transportation", "agreed"), 14: ("Travel", "arbitrated")}


def test_store(spark, tmp_path):
    rows = txns(spark, [row(i, -6.25) for i in (0, 1, 150_000, 250_000)] + [row(5, -6.5)])
    assert {r.pos: r.occurrence for r in store.occurrence(rows).collect()} == {0: 0, 1: 1, 150_000: 2, 250_000: 3, 5: 0}
    with_ids = store.with_ids(rows)
    assert with_ids.select("id").distinct().count() == 5
    path = str(tmp_path / "table")
    assert store.insert(spark, path, with_ids) == 5
    assert store.insert(spark, path, with_ids) == 0
    assert spark.read.parquet(path).count() == 5
    old = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, "x")], "id string, n double, s string")
    new = spark.createDataFrame([("a", None, "y"), ("c", 3.0, None)], "id string, n double, s string")
    assert {tuple(r) for r in store.upsert(old, new).collect()} == {("a", 1.0, "y"), ("b", 2.0, "x"), ("c", 3.0, None)}


STATEMENT = """{"bank": "Mill Bank", "account_no": "99-1234", "type": "Chequing", "statement_period": "Jan 1, 2024 to Jan 31, 2024", "previous_balance": "$100.00", "rows": [
 {"posted_date": "01/05/2024", "details": " Rent \\n unit ", "debit": "(40.00)", "running_balance": "60.00"}, "junk", 7, null,
 {"date": "2024-01-09", "memo": "N/A", "amount": "15.50", "ref": 12.0}]}"""


def test_statements(spark):
    docs = spark.createDataFrame([("s", STATEMENT), ("e", ""), ("n", None), ("j", "{x"), ("l", "[1]"), ("t", '{"a": 1}')], "statement_id string, json string")
    good, failures = statements.parse(docs)
    assert {r.statement_id: r.reason for r in failures.collect()} == {"e": "empty", "n": "empty", "j": "no JSON", "l": "no object", "t": "no transactions"}
    rows = adapt.normalize_rows(good)
    got = [tuple(r)[1:] for r in rows.orderBy("pos").collect()]
    assert got == [(0, "2024-01-05", "Rent unit", None, 40.0, None, 60.0), (4, "2024-01-09", None, "12", None, 15.5, None)]
    head = adapt.normalize_headers(good, rows).first()
    assert (head.bank_name, head.account_number, head.statement_period_start, head.statement_period_end) == ("Mill Bank", "99-1234", "2024-01-01", "2024-01-31")
    assert (head.opening_balance, head.closing_balance, head.total_withdrawals, head.total_deposits) == (100.0, 60.0, 40.0, 15.5)


def test_generated_json(spark):
    rows = [
        ("a", 'Sure!\n```json\n{"opening_balance": "$1,000.00", "bank": "12", "transactions": [{"withdrawal": "(62.47)", "deposit": "", "balance": "-5 CAD", "n": "7"}, 3, {"deposit": 5, "balance": null, "withdrawal": "n/a"}]}\n``` ok'),
        ("b", "```\n[1]\n```"), ("c", "{bad"), ("d", None), ("e", '{"closing_balance": " 1.2.3 ", "x": {"balance": "1"}}'), ("f", ' {"transactions": [], "balance": "7-"}\n'), ("g", "```{}```"), ("h", "``` {}"),
    ]
    got = {r.statement_id: r.json for r in statements.generated(spark.createDataFrame(rows, "statement_id string, json string")).collect()}
    assert json.loads(got.pop("a")) == {"bank": "12", "opening_balance": 1000.0, "transactions": [{"balance": -5.0, "deposit": None, "n": "7", "withdrawal": -62.47}, 3, {"balance": None, "deposit": 5, "withdrawal": "n/a"}]}
    assert json.loads(got.pop("e")) == {"closing_balance": " 1.2.3 ", "x": {"balance": "1"}} and json.loads(got.pop("f")) == {"transactions": [], "balance": 7.0}
    assert got == {"b": "[1]", "c": "{bad", "d": None, "g": "{}", "h": "``` {}"}


def test_pages(spark):
    docs = spark.createDataFrame([("p", '[{"account_number": "1", "x": 1}, {"data": {"account_number": "1"}}, 5]'), ("q", '[{"account_number": "1"}, {"account_number": "2"}]')], "source string, json string")
    got = {(r.source, r.page): r.unit for r in statements.pages(docs).collect()}
    assert got == {("p", 0): 0, ("p", 1): 0, ("q", 0): 0, ("q", 1): 1}


def test_ingest_and_dashboard(spark):
    doc = '{"bank_name": "B", "account_number": "1234", "account_type": "%s", "opening_balance": 0, "closing_balance": %s, "statement_period_start": "2024-01-01", "statement_period_end": "2024-01-31", "transactions": [{"date": "2024-01-0%s", "description": "Payment", "%s": 450.0, "balance": %s}]}'
    docs = spark.createDataFrame([("x", doc % ("Chequing", -450, 2, "withdrawal", -450)), ("y", (doc % ("Visa", -450, 3, "deposit", -450)).replace("1234", "9999"))], "statement_id string, json string")
    none = spark.createDataFrame([], "merchant string, category string")
    led = dashboard.ingest(docs, spark.createDataFrame([], "raw_description string, merchant string, confidence string"), none, none)
    assert led.transactions.where("is_transfer").count() == 2 and led.verdicts.where("reconciled").count() == 2
    blocks = dashboard.dashboard(led.accounts.drop("statement_id"), led.transactions, led.verdicts)
    assert blocks["summary"].first().net == 0.0 and blocks["transfers_excluded"].first()["count"] == 2
    assert all(b.columns for b in blocks.values())


@pytest.mark.parametrize("sql", ["SELECT 1 AS x", "select count(*) from transactions", "WITH t AS (SELECT * FROM transactions) SELECT * FROM t", "```sql\nSELECT id FROM accounts;\n```", "-- hi\nSELECT DISTINCT id FROM accounts", "SELECT id FROM accounts -- end"])
def test_guard_accepts(spark, sql):
    _views(spark)
    assert ask.run(spark, sql, ("transactions", "accounts"), seconds=60) is not None


@pytest.mark.parametrize("sql", [
    "DROP TABLE transactions", "SELECT 1; SELECT 2", "(SELECT 1)", "SELECT 1 UNION SELECT 2", "VALUES (1)", "SET x = 1", "SHOW TABLES", "INSERT INTO transactions VALUES (1)", "", "hello",
    "SELECT * FROM parquet.`/root/testdata`", "SELECT * FROM secrets", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT input_file_name() FROM accounts", "SELECT * FROM accounts WHERE id IN (SELECT id FROM other)", "SELECT * FROM range(5)",
    "SELECT * FROM IDENTIFIER('other')", "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`')", "SELECT id FROM accounts WHERE id IN (SELECT id FROM IDENTIFIER('other'))",
    "WITH t AS (SELECT * FROM IDENTIFIER('other')) SELECT * FROM t", "SELECT (SELECT max(id) FROM IDENTIFIER('other')) AS x",
])
def test_guard_refuses(spark, sql):
    _views(spark)
    with pytest.raises(ask.Refused):
        ask.check(spark, sql, ("transactions", "accounts"))


def _views(spark):
    led = txns(spark, [row(1, -10.0), row(2, -2.0)])
    acc = spark.createDataFrame([("a", "B", "checking")], "id string, bank_name string, account_type string")
    led.createOrReplaceTempView("transactions")
    acc.createOrReplaceTempView("accounts")
    return acc, led


def test_ask(spark):
    acc, led = _views(spark)
    got = ask.ask(spark, "How much did I spend in each category?", acc, led)
    assert got.rows == [{"category": "Other", "spent": 12.0}] and got.answer
    assert ask.ask(spark, "?", acc, led).rows == []
    replies = iter([{"sql": "SELECT nope FROM transactions"}, {"sql": "SELECT count(*) AS n FROM transactions"}])
    assert ask.ask(spark, "q", acc, led, generate=lambda _: next(replies)).rows == [{"n": 2}]
    assert "no matching" in ask.ask(spark, "q", acc, led, generate=lambda _: {"sql": "SELECT max(amount) AS m FROM transactions WHERE 1 = 0"}).answer
    assert ask.ask(spark, "q", acc, led, generate=lambda _: 1 / 0).rows == []


def test_ask_leaves_the_session_alone(spark):
    acc, led = _views(spark)
    spark.sql("SELECT 'mine' AS x").createOrReplaceTempView("transactions")
    spark.sql("SELECT 'secret' AS x").createOrReplaceTempView("other")
    seen = []

    def look(text):
        seen.append(text)
        return {"sql": "SELECT x FROM other" if len(seen) == 1 else "SELECT count(*) AS n FROM transactions"}

    assert ask.ask(spark, "q", acc, led, generate=look).rows == [{"n": 2}] and "other" in seen[1]
    assert spark.table("transactions").first().x == "mine" and spark.conf.get("spark.sql.optimizer.excludedRules", "") == ""
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("ask_")]
    with ask.isolated(spark, transactions=led) as inner:
        for sql in ("SELECT sequence(1, 1000000000)", "SELECT size(array_repeat(1, 1000000000))", "SELECT repeat('x', 1000000000)", "SELECT " + "1 + " * 10_000 + "1", "SELECT * FROM accounts", "SELECT * FROM global_temp.x"):
            with pytest.raises(ask.Refused):
                ask.check(inner, sql, ("transactions",))
        assert ask.run(inner, "SELECT 1 + 1 AS x", ("transactions",), seconds=60) == [{"x": 2}]
    with pytest.raises(ask.Refused):
        ask._within(0.05, lambda: __import__("time").sleep(2))


def test_streams_go_on(spark, tmp_path):
    source, base, schema = tmp_path / "in", str(tmp_path / "stream"), "event_id long, ts timestamp, user_id long, event_type string, value double"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[(1, at(0), 7, "view", 1.0), (2, at(10), 7, "view", 2.0), (2, at(10), 7, "view", 2.0)], [(3, at(20), 7, "buy", 3.0), (1, at(0), 7, "view", 1.0), (4, at(90), 7, "view", 4.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        once = events.drain(events.once(events.read(spark, str(source))).select("event_id"), f"{base}/once", "append")
        assert sorted(r.event_id for r in once.collect()) == ([1, 2], [1, 2, 3, 4])[i]
        sessions = events.drain(events.sessions(events.read(spark, str(source))), f"{base}/sessions")
    assert sorted((r.session_start, r.events) for r in sessions.collect()) == [("2024-01-01 00:00:00", 5), ("2024-01-01 01:30:00", 1)]
    # the last batch broke off before it was committed: it is run again, and counts once
    last = max(int(f) for f in os.listdir(f"{base}/once/checkpoint/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{base}/once/checkpoint/commits/{name}")
    again = events.drain(events.once(events.read(spark, str(source))).select("event_id"), f"{base}/once", "append")
    assert sorted(r.event_id for r in again.collect()) == [1, 2, 3, 4]


def test_layout(spark):
    words = [(1, 600.0, t, x1, x2, y, y + 10, c) for t, x1, x2, y, c in [
        ("Date", 10.0, 50.0, 0.0, 90.0), ("Description", 60.0, 140.0, 1.0, 90.0), ("Withdrawals", 300.0, 400.0, 0.0, 90.0), ("01/02", 10.0, 50.0, 20.0, 60.0), ("Rent", 60.0, 140.0, 21.0, 60.0), ("40.00", 350.0, 400.0, 20.0, 60.0),
        ("unit", 60.0, 90.0, 40.0, 90.0), ("01/03", 10.0, 50.0, 60.0, 90.0), ("|", 52.0, 53.0, 60.0, 90.0), ("Food", 60.0, 140.0, 60.0, 90.0), ("1,234.50", 350.0, 402.0, 60.0, 90.0)]]
    df = spark.createDataFrame(words, "page int, width double, text string, x1 double, x2 double, y1 double, y2 double, conf double")
    numbered = layout.number_rows(layout.words_only(df))
    assert layout.header_row(numbered).first().row == 0
    assigned = layout.assign_columns(numbered, layout.columns(numbered))
    assert {(r.row, r.text): r.column for r in assigned.where("column IS NOT NULL").collect()} == {(1, "40.00"): 0, (3, "1,234.50"): 0}
