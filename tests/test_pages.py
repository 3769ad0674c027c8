"""Pages to statements: what each line is, summaries, several pages, names, and sides from balances."""

import json

import pytest

from ledgerloom.operators import layout, pages

WORDS = "doc string, page int, width double, text string, x1 double, x2 double, y1 double, y2 double, conf double"
HEADER = [("Date", 10, 40), ("Description", 60, 140), ("Ref", 250, 280), ("Withdrawals", 330, 400), ("Deposits", 430, 480), ("Balance", 510, 560)]


def money(text, right):
    return (text, right - 40, right)


def said(text, x=60):
    return [(t, x + 45 * i, x + 45 * i + 40) for i, t in enumerate(text.split())]


def boxes(spark, *docs):
    """docs of (name, pages), pages of lines, lines of (text, x1, x2) with a confidence at the end, if any"""
    out = []
    for name, sheets in docs:
        for p, sheet in enumerate(sheets):
            for i, line in enumerate(sheet):
                for w in line:
                    out.append((name, p, 600.0, w[0], float(w[1]), float(w[2]), 20.0 * i, 20.0 * i + 10, float(w[3]) if len(w) > 3 else 95.0))
    return spark.createDataFrame(out, WORDS)


def read(words):
    rows, heads = pages.read_pages(words)
    rows = [(r.doc, r.date, r.description, r.reference, r.withdrawal, r.deposit, r.balance, r.amount) for r in rows.orderBy("doc", "pos").collect()]
    return rows, {h.doc: h for h in heads.collect()}


def test_lines(spark):
    sheet = [
        HEADER,
        [*said("stray words here")],  # nothing above to go on with
        [*said("Balance Forward"), money("100.00", 560)],
        [("2024-01-02", 10, 50), *said("Rent"), ("0123", 255, 280), money("40.00", 400), money("60.00", 560)],
        [*said("unit B")],
        [*said("Fee"), money("5.00", 400), money("55.00", 560)],  # undated, but with a balance: a row of its own
        [*said("and a bit more"), money("1.00", 400)],  # undated, without a balance: goes on
        [*said("Page 1 of")],
        [*said("Member FDIC")],
        [*said("one two three four five six seven", 60)],
        [*said("elsewhere", 330)],
        [*said("2024-01-03 note")],
        [("2024-01-04", 10, 50), *said("Total wine"), money("9.00", 400)],  # a date: no summary
        [*said("* Totals"), money("55.00", 400), money("7.00", 480)],
        [*said("Ending balance"), money("46.00", 560)],
        [("x", 60, 70), money("12.00", 200)],  # an amount in no column
    ]
    rows, heads = read(boxes(spark, ("a", [sheet])))
    assert rows == [
        ("a", "2024-01-02", "Rent unit B", "0123", 40.0, None, 60.0, None),
        ("a", None, "Fee and a bit more", None, 5.0, None, 55.0, None),
        ("a", "2024-01-04", "Total wine", None, 9.0, None, None, None),
    ]
    h = heads["a"]
    assert (h.opening_balance, h.closing_balance, h.total_withdrawals, h.total_deposits, h.low_confidence_rows) == (100.0, 46.0, 55.0, 7.0, [])


def test_pages_have_columns_of_their_own(spark):
    one = [HEADER, [("2024-01-02", 10, 50), *said("A"), money("1.00", 480, ), money("11.00", 560)], [("2024-01-03", 10, 50), *said("B"), money("2.00", 400), money("9.00", 560)]]
    two = [[*said("goes nowhere")], [("Jan", 10, 30), ("4,", 32, 40), ("2024", 42, 58), *said("C"), money("3.00", 300, ), money("6.00", 500)], [("05", 10, 20), ("Feb", 22, 40), ("2024", 42, 58), *said("D"), ("77", 345, 365), money("4.00", 300), money("2.00", 500)]]
    rows, heads = read(boxes(spark, ("a", [one, two]), ("b", [[[("nothing", 10, 50)]]])))
    assert [r[1:] for r in rows] == [
        ("2024-01-02", "A", None, None, 1.0, 11.0, None), ("2024-01-03", "B", None, 2.0, None, 9.0, None),
        ("2024-01-04", "C", None, None, None, 6.0, 3.0), ("2024-02-05", "D 77", None, None, None, 2.0, 4.0),
    ]
    assert set(heads) == {"a", "b"} and heads["b"].closing_balance is None
    settled = {r.description: (r.withdrawal, r.deposit, r.amount, r.note) for r in pages.settle(*pages.read_pages(boxes(spark, ("a", [one, two])))).collect()}
    assert settled == {"A": (None, 1.0, None, None), "B": (2.0, None, None, None), "C": (3.0, None, None, None), "D 77": (4.0, None, None, None)}


def test_a_reference_without_a_heading_stands_right(spark):
    sheet = [[("2024-01-02", 10, 50), *said("A"), ("0045", 345, 375), money("1.00", 450), money("9.00", 560)], [("2024-01-03", 10, 50), *said("B"), ("0046", 100, 140), money("2.00", 450), money("7.00", 560)]]
    assert [(r[2], r[3]) for r in read(boxes(spark, ("a", [sheet])))[0]] == [("A", "0045"), ("B 0046", None)]


def test_settle(spark):
    rows = spark.createDataFrame(
        [("a", 0, None, None, 90.0, 10.0), ("a", 1, None, None, None, 5.0), ("a", 2, None, None, 100.0, 10.5), ("a", 3, None, None, 100.0, 4.0), ("a", 4, 1.0, None, 98.0, None), ("a", 5, None, None, 60.0, None), ("b", 0, None, None, 5.0, 5.0)],
        "doc string, pos int, withdrawal double, deposit double, balance double, amount double",
    )
    heads = spark.createDataFrame([("a", 100.0), ("b", None)], "doc string, opening_balance double")
    got = {(r.doc, r.pos): (r.withdrawal, r.deposit, r.amount, r.note) for r in pages.settle(rows, heads).collect()}
    assert got == {
        ("a", 0): (10.0, None, None, None), ("a", 1): (None, None, 5.0, None), ("a", 2): (None, 10.5, None, "amount"), ("a", 3): (None, None, None, "amount"),
        ("a", 4): (1.0, None, None, "columns"), ("a", 5): (38.0, None, None, None), ("b", 0): (None, None, 5.0, None),
    }


def test_names(spark):
    head = [said("fb Lake"), said("12 Oak"), [*said("Lake County Bank", 10), *said("Account No. 00005-", 400)], [("123-456-7", 400, 470)], [*said("LAKE STREET", 10), *said("01/02/2024 through 2024-02-01", 380)], said("MARY JO LEE", 10), said("JOHN DOE", 10), said("your savings", 10)]
    got = {r.doc: r for r in pages.names(boxes(spark, ("a", [head, [said("SECOND PAGE")]]), ("b", [[said("x")]]))).collect()}
    a = got["a"]
    assert (a.bank_name, a.account_holder_name, a.account_type, a.account_number) == ("Lake County Bank", "Mary Jo Lee", "Savings", "00005-123-456-7")
    assert (a.statement_period_start, a.statement_period_end) == ("2024-01-02", "2024-02-01")
    assert all(got["b"][c] is None for c in ("bank_name", "account_holder_name", "account_type", "account_number", "statement_period_start"))


def test_statements(spark):
    sheet = [HEADER, [("2024-01-02", 10, 50), *said("Rent"), money("40.00", 400), money("60.00", 560)], [("2024-01-03", 10, 50), *said("Pay", ), money("7.00", 480), money("67.00", 560, )]]
    texts = {r.statement_id: json.loads(r.json) for r in pages.statements(boxes(spark, ("a", [sheet]), ("b", [[said("no rows")]]))).collect()}
    assert [t["description"] for t in texts["a"]["transactions"]] == ["Rent", "Pay"] and texts["a"]["closing_balance"] == 67.0
    assert texts["b"]["transactions"] == []


def test_odd_words(spark):
    empty = boxes(spark, ("a", [[said("x")]])).limit(0)
    assert read(empty) == ([], {}) and pages.names(empty).count() == 0
    odd = boxes(spark, ("a", [[[("|", 1, 2), (None, 3, 4), ("  ", 5, 6), ("—_", 7, 8)]]]))
    assert read(odd) == ([], {})
    same = boxes(spark, ("a", [[[("2024-01-02", 10, 50), ("A", 60, 70), ("A", 60, 70), money("1.00", 400), money("1.00", 400)]]]))
    assert [r[2:] for r in read(same)[0]] == [("A A", None, None, None, None, 1.0)]


@pytest.mark.parametrize("n", [1, 5_000])
def test_rows_of_long_pages(spark, n):
    words = spark.createDataFrame([(i % 2, str(i), 0.0, 1.0, 20.0 * (i // 4), 20.0 * (i // 4) + 10, 90.0) for i in range(4 * n)], "page int, text string, x1 double, x2 double, y1 double, y2 double, conf double")
    got = {(r.page, int(r.text)): r.row for r in layout.number_rows(words).collect()}
    assert got == {(i % 2, i): i // 4 for i in range(4 * n)}


def test_dated_line_whose_amount_no_column_holds(spark):
    header = [*HEADER[:3], ("Amount", 430, 480), HEADER[5]]
    row = [("2024-01-02", 10, 50, 60.0), *((*w, 60.0) for w in said("Corner market")), (*money("12.00", 480), 60.0)]
    rows, heads = read(boxes(spark, ("a", [[header, row, [*said("unit B")]]]), ("b", [[row]])))
    assert rows == [("a", "2024-01-02", "Corner market 12.00 unit B", None, None, None, None, None)]  # without a header it is none
    assert heads["a"].low_confidence_rows == ["Corner market 12.00"]
