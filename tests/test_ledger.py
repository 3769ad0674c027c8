"""The stored ledger: versions, uploads that overlap, and transfer matching by blocks."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import TRANSFER_WORDS
from ledgerloom.operators import store, transfers
from ledgerloom.plans import ledger as plans
from ledgerloom.plans.ledger import Ledger
from ledgerloom.session import written
from ledgerloom.sources import statements
from ledgerloom.sources.versions import Conflict, Versions

DAY = datetime.date(2024, 1, 1)


# --- transfers


def greedy(rows):
    found = []
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if a[1] != b[1] and a[2] * b[2] < 0 and abs(a[2] + b[2]) <= 0.01 + 1e-9 and abs((a[3] - b[3]).days) <= 3:
                word = any(w in f"{a[4] or ''} {b[4] or ''}".upper() for w in TRANSFER_WORDS)
                found.append((not word, abs((a[3] - b[3]).days), i, j))
    used, out = set(), set()
    for plain, gap, i, j in sorted(found):
        if i not in used and j not in used:
            used |= {i, j}
            out.add((*((i, j) if rows[i][2] < 0 else (j, i)), not plain, gap))
    return out


def paired(spark, rows, monkeypatch, **options):
    """The pairs, and how many rounds they took."""
    rounds, plain = [], transfers._round
    monkeypatch.setattr(transfers, "_round", lambda *a: rounds.append(a[1]) or plain(*a))
    df = spark.createDataFrame(rows, "pos bigint, account_id string, amount double, date date, description string").repartition(3)
    got = [tuple(r) for r in transfers.pair_legs(df, **options).collect()]
    monkeypatch.setattr(transfers, "_round", plain)
    assert len(set(got)) == len(got)
    return set(got), len(rounds)


@pytest.mark.parametrize("accounts, split", [(8, False), (700, True), (2, False), (1, False)])
def test_a_hot_amount_takes_one_round(spark, monkeypatch, accounts, split):
    rng = random.Random(accounts)
    rows = [(i, f"a{rng.randrange(accounts)}", (-1 if (i < 1_000 if split else rng.random() < 0.5) else 1) * 100.0, DAY, rng.choice(["x", "Payment", None])) for i in range(2_000)]
    got, rounds = paired(spark, rows, monkeypatch)
    assert rounds == 1 and got == greedy(rows)


@pytest.mark.parametrize("most", [300, 40, 5])
def test_blocks_give_what_one_block_gives(spark, monkeypatch, most):
    rng = random.Random(most)
    texts = ["x", "Payment", "thank", "you x", "an online", "pmt", None]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([-1, 1]) * (100 + rng.randrange(60) / 100), DAY + datetime.timedelta(rng.randrange(60)), rng.choice(texts)) for i in range(900)]
    got, rounds = paired(spark, rows, monkeypatch, block_legs=most)
    assert got == greedy(rows) and 1 < rounds < 12


def test_no_legs(spark, monkeypatch):
    assert paired(spark, [(0, "a", 0.0, DAY, "x"), (1, "b", None, DAY, "x"), (2, "c", 5.0, None, "x"), (3, "d", float("nan"), DAY, "x")], monkeypatch)[0] == set()


# --- versions


def test_versions(spark, tmp_path):
    tables = Versions(spark, str(tmp_path), {"a": "x int", "b": "y string"})
    assert tables.current() == 0 and tables.read("a").count() == 0
    one = tables.stage("a", spark.range(3).selectExpr("CAST(id AS INT) AS x"))
    assert tables.read("a").count() == 0  # nothing counts before a commit names it
    assert tables.commit(0, {"a": [one]}) == 1
    tables.commit(1, {"a": [tables.stage("a", spark.range(2).selectExpr("CAST(id AS INT) AS x"))], "b": [tables.stage("b", spark.sql("SELECT 'z' AS y"))]})
    assert (tables.read("a").count(), tables.read("b").count(), tables.read("a", 1).count(), tables.read("b", 1).count()) == (5, 1, 3, 0)
    with pytest.raises(Conflict):
        tables.commit(1, {"a": [one]})
    assert tables.read("a").count() == 5
    tables.compact("a")
    assert len(tables.folders()["a"]) == 1 and tables.read("a").count() == 5
    tables.stage("b", spark.sql("SELECT 'lost' AS y"))
    assert tables.vacuum() == 3  # two folders of a, and the staged one
    assert tables.current() == 3 and tables.read("a").count() == 5 and tables.read("b").first().y == "z"


def test_latest_fields(spark):
    rows = spark.createDataFrame([("k", 5.0, None, 1), ("k", 2.0, "x", 2), ("k", None, None, 3), ("m", None, None, 1)], "id string, a double, b string, n int")
    assert {tuple(r) for r in store.latest(rows, "id", ("a", "b"), "n").collect()} == {("k", 2.0, "x"), ("m", None, None)}
    old = spark.createDataFrame([("k", 9.0, "old"), ("z", 1.0, "stays")], "id string, a double, b string")
    assert {tuple(r) for r in store.upsert(old, rows, order="n").collect()} == {("k", 2.0, "x"), ("z", 1.0, "stays"), ("m", None, None)}


def test_ranks(spark):
    values = [5, None, 3, 3, 9, None, 1] * 40
    rows = spark.createDataFrame([*enumerate(values)], "i int, v int").repartition(7)
    got = {r.i: r["rank"] for r in store.ranked(rows, store.F.col("v").desc_nulls_last(), store.F.col("i")).collect()}
    want = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert got == {i: n for n, i in enumerate(want, 1)}
    assert store.ranked(rows.limit(0), store.F.col("i")).count() == 0


# --- uploads


def statement(bank, number, kind, rows, **head):
    listed = [{"date": d, "description": t, "withdrawal": -a if a < 0 else None, "deposit": a if a > 0 else None} for d, t, a in rows]
    return json.dumps({"bank_name": bank, "account_number": number, "account_type": kind, "transactions": listed, **head})


CHEQUING = [("2024-01-02", "Corner Market", -20.0), ("2024-01-02", "Corner Market", -20.0), ("2024-01-05", "Card payment", -450.0)]
CARD = [("2024-01-06", "Thanks", 450.0), ("2024-01-03", "Streamly", -9.99), ("2024-02-02", "Streamly", -9.99)]


def upload(spark, ledger, *texts, **options):
    docs = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "statement_id string, json string")
    none = spark.createDataFrame([], "merchant string, category string")
    return ledger.upload(docs, spark.createDataFrame([], "raw_description string, merchant string, confidence string"), none, **options)


def stored(ledger):
    return sorted(tuple(r) for r in ledger.transactions().select("id", "account_id", "date", "amount", "category", "is_transfer", "is_recurring").collect())


def test_uploads(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    first = upload(spark, ledger, statement("Mill", "1234", "Chequing", CHEQUING, opening_balance=1000.0, closing_balance=510.0), "{bad", statement("Mill", "9999", "Visa", [], closing_balance=80.0))
    told = {r.statement_id: (r.account_id, r.submitted, r.inserted, r.reconciled) for r in first.statements.collect()}
    assert told == {"s0": ("mill-1234", 3, 3, True), "s2": ("mill-9999", 0, 0, False)} and first.failures.count() == 1
    assert not any(r[5] for r in stored(ledger)) and len({r[0] for r in stored(ledger)}) == 3

    # the same statement again changes nothing but the log
    before = stored(ledger)
    again = upload(spark, ledger, statement("Mill", "1234", "Chequing", CHEQUING, opening_balance=1000.0, closing_balance=510.0))
    assert [(r.submitted, r.inserted) for r in again.statements.collect()] == [(3, 0)] and stored(ledger) == before
    assert ledger.versions.read("extractions").count() == 3

    # the other leg comes with a later upload; a balance that falls arrives, a missing rate takes nothing away
    upload(spark, ledger, statement("Mill", "9999", "Visa", CARD, closing_balance=60.0), apr=plans.F.lit(19.9))
    assert [(r[1], r[3]) for r in stored(ledger) if r[5]] == [("mill-1234", -450.0), ("mill-9999", 450.0)] and not any(r[6] for r in stored(ledger))
    upload(spark, ledger, statement("Mill", "9999", "Visa", [*CARD[1:], ("2024-03-03", "Streamly", -9.99)]))
    card = ledger.accounts().where("id = 'mill-9999'").first()
    assert (card.closing_balance, card.apr) == (60.0, 19.9)
    assert [r[3] for r in stored(ledger) if r[6]] == [-9.99] * 3  # two of them were stored before the third came
    blocks = ledger.dashboard()
    assert blocks["transfers_excluded"].first()["count"] == 2 and blocks["subscriptions"].unionByName(blocks["repeated"]).count() == 1
    assert blocks["extraction"].first().statements == 5

    # a better partner later on takes no flag back
    upload(spark, ledger, statement("Mill", "5555", "Savings", [("2024-01-05", "Transfer in", 450.0)]))
    assert sum(r[5] for r in stored(ledger)) == 3

    # what fails leaves the version before
    before, version = stored(ledger), ledger.versions.current()
    monkeypatch.setattr(plans.recurring, "find_recurring", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        upload(spark, ledger, statement("Mill", "7777", "Savings", [("2024-05-05", "x", 1.0)]))
    assert ledger.versions.current() == version and stored(ledger) == before
    monkeypatch.undo()
    ledger.versions.compact("transactions")
    assert ledger.versions.vacuum() > 0 and stored(ledger) == before


def test_three_batches_are_one(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"2024-0{m}-{d:02d}", f"Shop {rng.randrange(5)}", round(rng.choice([-1, 1]) * rng.choice([10.0, 25.5, 40.0]), 2)) for m in (1, 2, 3) for d in range(1, 28, 2)]
    by_month = {m: [r for r in rows if r[0][6] == str(m)] for m in (1, 2, 3)}
    three, one = Ledger(spark, str(tmp_path / "three")), Ledger(spark, str(tmp_path / "one"))
    news = [upload(spark, three, statement("Mill", "1", "Chequing", by_month[a] + (by_month[b] if b else []))) for a, b in ((1, 2), (2, 3), (3, None))]
    assert [u.statements.first().inserted for u in news] == [28, 14, 0]
    upload(spark, one, statement("Mill", "1", "Chequing", by_month[1] + by_month[2]), statement("Mill", "1", "Chequing", by_month[2] + by_month[3]), statement("Mill", "1", "Chequing", by_month[3]))
    assert [r[:4] for r in stored(three)] == [r[:4] for r in stored(one)] and len(stored(one)) == 42


def test_large_statements_are_parsed_whole(spark):
    row = F.lit('{"date":"2020-01-01","description":"' + "memo " * 20 + '","withdrawal":12.5}')
    text = F.concat(F.lit('{"transactions":['), F.array_join(F.array_repeat(row, F.col("id").cast("int") + 90_000), ","), F.lit("]}"))
    docs = written(spark.range(1).select(F.lit("a").alias("statement_id"), text.alias("json")), "large")
    good, failures = statements.parse(docs)
    assert good.select(F.size(statements.rows_of(F.col("v")))).first()[0] == 90_000 and not failures.count()
    assert [r.reason for r in statements.parse(docs, largest=10 * 1024 * 1024)[1].collect()] == ["too large"]
