"""Statements from the word boxes of their pages: headings, columns, lines and what each line is, one plan for all pages.

Words: doc, page (a number), width, text, x1, x2, y1, y2, conf. A page's words and a statement's lines are what a bank
prints; everything is dealt by page or statement, and no step needs more than one of them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import row_date
from ledgerloom.functions.num import CENT, py_round, to_number
from ledgerloom.functions.text import title
from ledgerloom.operators import layout
from ledgerloom.operators.layout import ASSIGN, COLUMN_REACH, DOUBTFUL, MONEY
from ledgerloom.session import dealt, once, written

# Words that head columns; marks of lines that are no transactions; marks of a page's furniture.
KEYWORDS = {
    "date": ("date",),
    "description": ("description", "transaction", "particulars", "details", "activity", "narrative"),
    "reference": ("ref", "reference", "cheque", "check", "no.", "number"),
    "withdrawal": ("withdrawal", "withdrawals", "debit", "debits", "paid out", "charges", "payments"),
    "deposit": ("deposit", "deposits", "credit", "credits", "paid in"),
    "balance": ("balance", "bal"),
}
OPENING = ("previous balance", "opening balance", "balance forward", "brought forward", "beginning balance")
CLOSING = ("closing balance", "ending balance", "new balance", "final balance", "balance carried")
FURNITURE = ("page ", "member", "fdic", "equal housing", "continued", "insured", "www.", "customer service", "important")
HEADER_ROWS, LEAST_HEADINGS, MOST_WORDS, REFERENCE_FROM = 40, 3, 6, 0.55
# Lines of a page's head, its left block, kinds of accounts, and words that no holder's name has.
HEAD, LEFT = 20, 0.55
KINDS = ("chequing", "checking", "savings", "credit card", "current")
NO_NAME = ("statement", "account", "period", "page", "bank", "chequing", "checking", "savings", "box", "street", "st", "ave", "road")
_DAY = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}"
PERIOD = rf"({_DAY})\s*(?:to|-|–|through)\s*({_DAY})"
EDGES = " |_-—."
#: What a page is known by.
PAGE = ("doc", "page")


def _any_in(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | text.contains(m)
    return found


def lines(words: DataFrame) -> DataFrame:
    """doc, page, row, width and words (x1, text, x2, conf, from the left) of every line, from the top of its page."""
    return layout.gather_rows(layout.words_only(words), ("x1", "text", "x2", "conf"), PAGE).withColumn("words", F.array_sort("words"))


def _text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def header(found: DataFrame) -> DataFrame:
    """doc, page, head_row and heads (field to x1 and x2) of the pages with a header: of the first forty lines that with the
    words of most fields, three at least, of which three fields have a word of their own."""
    score = sum((_any_in(F.col("_low"), marks).cast("int") for marks in KEYWORDS.values()), F.lit(0))
    token = lambda w: F.btrim(F.lower(w["text"]), F.lit(" |_-—:"))

    def fields(w: Column) -> Column:
        fits = {name: F.exists(F.array(*map(F.lit, marks)), lambda k: w["token"].startswith(k) | (k.startswith(w["token"]) & (F.length(w["token"]) > 2))) for name, marks in KEYWORDS.items()}
        return F.array_compact(F.array(*(F.when(test, name) for name, test in fits.items())))

    def take(state: Column, w: Column) -> Column:
        free = F.get(F.filter(fields(w), lambda name: ~F.map_contains_key(state, name)), F.lit(0))
        return F.when(free.isNull(), state).otherwise(F.map_concat(state, F.map_from_arrays(F.array(F.coalesce(free, F.lit(""))), F.array(F.struct(w["x1"], w["x2"])))))

    named = F.transform("words", lambda w: F.struct(token(w).alias("token"), w["x1"].alias("x1"), w["x2"].alias("x2")))
    none = F.from_json(F.lit("{}"), "map<string,struct<x1:double,x2:double>>")
    first = once(found.where(F.col("row") < HEADER_ROWS), {"_low": F.lower(_text(F.col("words")))})
    scored = once(first, {"_score": score}).where(F.col("_score") >= LEAST_HEADINGS)
    mapped = once(scored, {"heads": F.aggregate(named, none, take)}).where(F.size(F.map_keys("heads")) >= LEAST_HEADINGS)
    best = mapped.groupBy("doc", "page").agg(F.max_by(F.struct("row", F.map_entries("heads").alias("heads")), F.struct("_score", -F.col("row"))).alias("b"))
    return best.select("doc", "page", F.col("b.row").alias("head_row"), F.map_from_entries("b.heads").alias("heads"))


def _columns(amounts: DataFrame, marks: DataFrame) -> DataFrame:
    """doc, page and columns (edge and label, from the left) of the amounts below the header, where there are any."""
    heads = marks.select(*PAGE, F.explode("heads").alias("role", "at")).select(*PAGE, "role", F.col("at.x1").alias("x1"), F.col("at.x2").alias("x2"))
    edges = layout.recover_columns(amounts, layout.columns(amounts, PAGE), heads, PAGE)
    listed = edges.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "edge"))), lambda c: c["edge"]).alias("edges"))
    roles = heads.where(F.col("role").isin(*MONEY)).groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("x1", "role"))), lambda h: h["role"]).alias("roles"))
    labels = layout.column_labels(F.size("edges"), F.coalesce("roles", F.array().cast("array<string>")))
    named = listed.join(roles.hint("merge"), [*PAGE], "left").withColumn("labels", labels)
    return named.select(*PAGE, F.arrays_zip("edges", "labels").alias("columns"))


def _placed(found: DataFrame) -> DataFrame:
    """Lines with amounts (label to value; the rightmost of a label), rest (the other words), date, description and reference."""
    reach = COLUMN_REACH * F.col("width")

    def near(w: Column) -> Column:
        return F.array_min(F.transform("columns", lambda c, i: F.struct(F.abs(w["x2"] - c["edges"]).alias("d"), i.alias("i"), c["labels"].alias("label"))))

    own = lambda w: (w["x1"].alias("x1"), w["text"].alias("text"), w["x2"].alias("x2"))
    # each step is made before the next uses it twice
    marked = F.transform("words", lambda w: F.struct(*own(w), layout.is_currency(w["text"]).alias("money")))
    marked = F.transform(marked, lambda w: F.struct(*own(w), w["money"].alias("money"), F.when(w["money"], near(w)).alias("near"), F.when(w["money"], to_number(w["text"])).alias("value")))
    marked = F.transform(marked, lambda w: F.struct(*own(w), w["money"].alias("money"), F.when(w["near"]["d"] <= ASSIGN * reach, w["near"]["label"]).alias("label"), w["value"].alias("value")))
    held = lambda w: w["label"].isNotNull() & w["value"].isNotNull()
    placed = once(found, {"_marked": marked}).withColumns({
        "has_money": F.exists("_marked", lambda w: w["money"]),
        "_money": F.filter("_marked", held), "rest": F.filter("_marked", lambda w: ~held(w)),
    })
    value = lambda label: F.try_element_at(F.filter("_money", lambda w: w["label"] == label), F.lit(-1))["value"]
    placed = placed.withColumns({label: value(label) for label in (*MONEY, "amount")})
    placed = placed.withColumn("_date", row_date(F.transform(F.when(F.col("has_money"), F.col("rest")).otherwise(F.col("_marked")), lambda w: w["text"]), F.lit(None).cast("int")))
    placed = placed.withColumn("_left", F.slice("rest", F.col("_date.used") + 1, F.size("rest")))
    ref, first = F.col("heads")["reference"], F.coalesce(F.array_min(F.transform("columns", lambda c: c["edges"])), F.col("width"))
    middle = lambda w: (w["x1"] + w["x2"]) / 2
    zone = lambda w: F.when(ref.isNotNull(), middle(w).between(ref["x1"] - reach, ref["x2"] + reach)).otherwise((w["x2"] < first) & (middle(w) > REFERENCE_FROM * F.col("width")))
    at = F.array_min(F.filter(F.transform("_left", lambda w, i: F.when(w["text"].rlike(r"^\d{1,8}$") & zone(w), i)), lambda i: i.isNotNull()))
    placed = placed.withColumn("_at", at)
    said = F.btrim(_text(F.filter("_left", lambda w, i: ~i.eqNullSafe(F.col("_at")))), F.lit(EDGES))
    return placed.withColumns({"date": F.col("_date.date"), "reference": F.get("_left", F.col("_at"))["text"], "description": F.regexp_replace(said, r"\s+", " ")})


def kinds(placed: DataFrame) -> DataFrame:
    """placed with kind: opening, closing, total, transaction, continuation, or null for what says nothing.

    A line with amounts is a summary by its words, else a transaction if it has a date, a balance, or no transaction
    above it; without all three its words go on with the transaction above. A dated line below a header whose amount no
    column holds is a transaction too; the amount stays among its words. A line without amounts goes on if it has
    at most six words, none of the furniture's, no date, and starts at the description's column.
    """
    low, words = F.col("_low"), F.btrim(F.regexp_replace(_text(F.col("words")), r"\s+", " "), F.lit(EDGES))
    money = F.size("_money") > 0
    spoken = (F.col("description") != "") | F.col("date").isNotNull()
    summary = F.when(_any_in(low, OPENING), "opening").when(_any_in(low, CLOSING), "closing").when(low.contains("total") & F.col("date").isNull(), "total")
    bare = F.col("heads").isNotNull() & F.col("has_money") & F.col("date").isNotNull()
    own = F.when((money | bare) & summary.isNull() & spoken, F.when(F.col("date").isNotNull() | F.col("balance").isNotNull(), "sure").otherwise("loose"))
    placed = once(placed, {"_low": F.lower("description"), "_words": words}).withColumn("_own", own)
    own, words = F.col("_own"), F.col("_words")
    placed = placed.withColumn("_begun", F.min(F.when(own.isNotNull(), F.col("row"))).over(Window.partitionBy(*PAGE)) < F.col("row"))
    begun = F.col("_begun")
    at, reach = F.col("heads")["description"], COLUMN_REACH * F.col("width")
    left = F.array_min(F.transform("words", lambda w: w["x1"]))
    below = at.isNull() | left.between(at["x1"] - reach, at["x2"] + 4 * reach)
    wraps = ~F.col("has_money") & (words != "") & (F.size(F.split(words, " ")) <= MOST_WORDS) & ~_any_in(F.lower(words), FURNITURE) & F.col("date").isNull() & below
    kind = F.when(money & summary.isNotNull(), summary).when(own == "sure", "transaction").when((own == "loose") & ~begun, "transaction").when(begun & ((own == "loose") | wraps), "continuation")
    said = F.when(F.col("has_money"), F.col("description")).otherwise(words)
    mean = F.aggregate(F.filter("words", lambda w: w["conf"] < 100), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, w: F.struct((a["s"] + w["conf"]).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))
    placed = once(placed, {"kind": kind, "said": said, "doubtful": F.coalesce(mean < DOUBTFUL, F.lit(False))})
    return placed.drop("_low", "_words", "_own", "_begun")


def read_pages(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, heads) of the statements on the pages.

    rows: doc, pos, date (text, null if none is printed), description, reference, withdrawal, deposit, balance, amount
    (where the page doesn't say which side it is), doubtful. Each page has its own header and columns; the words of
    continuation lines are at the end of the description. heads: doc, opening_balance, closing_balance,
    total_withdrawals, total_deposits and the doubtful rows' descriptions; of each field the first page's that has it.

    Lines, the pages' headings, amounts and columns, and what each line is, are written to the shared folder, dealt by page:
    words are sent once, and what follows reads lines where they lie. Words without text, or of
    borders alone, are left out; a document without words gives nothing, one without
    transactions a head alone.
    """
    return _read(dealt(lines(words), "lines", *PAGE))


def _read(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What read_pages gives, of lines that were written."""
    marks = dealt(header(found), "marks", *PAGE)
    below = lambda x: x.join(marks.hint("merge"), [*PAGE], "left").where(F.col("row") > F.coalesce("head_row", F.lit(-1)))
    amount = F.explode(F.filter("words", lambda w: layout.is_currency(w["text"])))
    amounts = below(found.select(*PAGE, "row", "width", amount.alias("w"))).select(*PAGE, "width", "w.text", "w.x2")
    listed = dealt(_columns(dealt(amounts, "amounts", *PAGE), marks), "columns", *PAGE)
    columns = F.coalesce("columns", F.array().cast("array<struct<edges:double,labels:string>>"))
    judged = kinds(_placed(below(found).join(listed.hint("merge"), [*PAGE], "left").withColumn("columns", columns)))
    judged = judged.where(F.col("kind").isNotNull()).select("doc", "page", "row", "kind", "said", "date", "reference", *MONEY, "amount", "doubtful")
    judged = dealt(judged, "judged", *PAGE)
    kept = judged.where(F.col("kind").isin("transaction", "continuation"))
    island = F.count_if(F.col("kind") == "transaction").over(Window.partitionBy("doc", "page").orderBy("row"))
    fields = ("date", "reference", *MONEY, "amount", "doubtful")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row", "said"))), lambda x: x["said"])
    rows = kept.withColumn("_i", island).groupBy("doc", "page", "_i").agg(
        F.min("row").alias("row"), F.min_by(F.struct(*fields), "row").alias("r"), F.nullif(F.array_join(F.filter(parts, lambda s: s != ""), " "), F.lit("")).alias("description"),
    )
    lone = F.when(F.col("r.withdrawal").isNull() & F.col("r.deposit").isNull(), F.col("r.amount"))
    order = Window.partitionBy("doc").orderBy("page", "row")
    rows = rows.select("doc", (F.row_number().over(order) - 1).alias("pos"), F.col("r.date").alias("date"), "description", *(F.col(f"r.{c}").alias(c) for c in ("reference", *MONEY)), lone.alias("amount"), F.col("r.doubtful").alias("doubtful"))
    either = F.coalesce(F.nullif(F.col("balance"), F.lit(0.0)), F.col("amount"))
    last = lambda x, kind: F.max_by(F.struct(x.alias("v")), F.when(F.col("kind") == kind, F.col("row")))["v"]
    by_page = judged.groupBy("doc", "page").agg(
        last(either, "opening").alias("opening_balance"), last(either, "closing").alias("closing_balance"), last(F.col("withdrawal"), "total").alias("total_withdrawals"), last(F.col("deposit"), "total").alias("total_deposits"),
    )
    names = ("opening_balance", "closing_balance", "total_withdrawals", "total_deposits")
    heads = by_page.groupBy("doc").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(c) for c in names))
    doubtful = judged.where("doubtful AND kind = 'transaction'").select("doc", F.struct("page", "row", F.left("said", F.lit(40)).alias("t")).alias("d"))
    doubts = doubtful.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list("d")), lambda x: x["t"]).alias("low_confidence_rows"))
    every = found.select("doc").distinct()
    heads = every.join(heads.hint("merge"), "doc", "left").join(doubts.hint("merge"), "doc", "left").withColumn("low_confidence_rows", F.coalesce("low_confidence_rows", F.array().cast("array<string>")))
    return rows, heads


def settle(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows with the sides that balances imply: an amount without a side goes where the balance went since the last one
    known (the opening one at first), and a row without any amount gets the difference. note says what does not fit:
    `amount` or `columns`; an amount without a balance to compare stays where it is."""
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(heads.select("doc", F.col("opening_balance").alias("_opening")), "doc")
    prior = F.coalesce(F.last("balance", ignorenulls=True).over(before), F.col("_opening"))
    joined = joined.withColumn("_delta", py_round(F.col("balance") - prior))
    split, delta = F.col("withdrawal").isNotNull() | F.col("deposit").isNotNull(), F.col("_delta")
    value = F.coalesce("amount", F.abs(delta))
    change = F.coalesce("deposit", F.lit(0.0)) - F.coalesce("withdrawal", F.lit(0.0))
    note = F.when(~split & (F.abs(F.abs(F.col("amount")) - F.abs(delta)) > CENT), "amount").when(split & (F.abs(change - delta) > CENT), "columns")
    return joined.withColumns({
        "deposit": F.when(~split & (delta > 0), value).otherwise(F.col("deposit")), "withdrawal": F.when(~split & (delta < 0), value).otherwise(F.col("withdrawal")),
        "amount": F.when(delta.isNull(), F.col("amount")), "note": note,
    }).drop("_delta", "_opening")


def names(words: DataFrame) -> DataFrame:
    """doc, bank_name, account_holder_name, account_type, account_number and the period's start and end, as far as the
    head of a document's first page with words says.

    The head is its first twenty lines, of which the left block is what lies left of 55 hundredths of the width. The bank
    is the first of four left lines with two words and eight letters; the holder the first later one of two to four
    words in capitals, without digits, without a word that names no one, and not part of the bank's name; the period
    two dates that a word or a dash joins.
    """
    words = layout.words_only(words)
    first = words.groupBy("doc").agg(F.min("page").alias("page"))
    return _names(lines(words.join(first, [*PAGE])).where(F.col("row") < HEAD))


def _names(top: DataFrame) -> DataFrame:
    """What names gives, of the lines of the heads of first pages."""
    strip = lambda x: F.btrim(x, F.lit(" |_-—"))
    left = strip(_text(F.filter("words", lambda w: (w["x1"] + w["x2"]) / 2 < LEFT * F.col("width"))))
    # a logo is often read as one or two stray small letters before the name
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(left, r"\s+", " ")), r"^(?:(?=\S*\p{Ll})[^\p{Lu}\s]{1,2}(?:\s|$))+", ""))
    listed = top.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("row", strip(_text(F.col("words"))).alias("line"), clean.alias("left")))).alias("l"))
    listed = listed.withColumns({"_all": F.array_join(F.transform("l", lambda x: x["line"]), " \n"), "_left": F.transform("l", lambda x: x["left"])})
    letters = lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z ]", ""))
    bank = F.get(F.filter(F.slice("_left", 1, 4), lambda x: (F.length(letters(x)) >= 8) & letters(x).rlike(r"\S\s+\S")), F.lit(0))
    listed = listed.withColumn("bank_name", bank)
    parts = lambda x: F.split(x, " ")
    named = lambda x: F.exists(parts(x), lambda t: F.btrim(F.lower(t), F.lit(".,")).isin(*NO_NAME))
    holder = F.get(F.filter(F.slice("_left", 2, 11), lambda x: F.size(parts(x)).between(2, 4) & ~x.rlike(r"\d") & (x == F.upper(x)) & ~named(x) & ~F.coalesce(F.col("bank_name").contains(x), F.lit(False))), F.lit(0))
    kind = F.coalesce(*(F.when(F.lower("_all").contains(k), title(F.lit(k))) for k in KINDS))
    day = lambda i: row_date(F.array(F.regexp_extract("_all", PERIOD, i)), F.lit(None).cast("int"))["date"]
    flat = top.select("doc", "row", "width", F.explode("words").alias("w")).select("doc", "row", "width", "w.text", "w.x1", "w.x2")
    found = listed.select("doc", "bank_name", title(holder).alias("account_holder_name"), kind.alias("account_type"), day(1).alias("statement_period_start"), day(2).alias("statement_period_end"))
    return found.join(layout.account_numbers(flat, "doc"), "doc", "left")


def statements(words: DataFrame) -> DataFrame:
    """statement_id and json of every document, as an upload takes it: names, balances, totals and settled rows."""
    found = dealt(lines(words), "lines", *PAGE)
    rows, heads = _read(found)
    first = found.groupBy("doc").agg(F.min("page").alias("page"))
    named = written(_names(found.where(F.col("row") < HEAD).join(first.hint("merge"), [*PAGE], "left_semi")), "names")
    line = F.struct("date", "description", "reference", "withdrawal", "deposit", "balance", "amount")
    listed = settle(rows, heads).groupBy("doc").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]).alias("transactions"), F.max_by(F.struct("balance"), "pos")["balance"].alias("_last"),
    )
    whole = heads.join(named.hint("merge"), "doc", "left").join(written(listed, "listed").hint("merge"), "doc", "left")
    fields = ("bank_name", "account_holder_name", "account_number", "account_type", "statement_period_start", "statement_period_end", "opening_balance")
    empty = F.array().cast(dict(whole.dtypes)["transactions"])
    return whole.select(F.col("doc").alias("statement_id"), F.to_json(F.struct(
        *fields, F.coalesce("closing_balance", "_last").alias("closing_balance"), "total_withdrawals", "total_deposits", "low_confidence_rows", F.coalesce("transactions", empty).alias("transactions"),
    )).alias("json"))
