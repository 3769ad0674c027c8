"""Ledger-shaped views of the order tables, so that every operator can run on them: each is a plain projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import spread

DESCRIPTIONS = (
    "PAYROLL NORTHWIND", "Monthly service charge", "E-TRANSFER TO SAM", "ATM WITHDRAWAL 0042", "AUTOMATIC PAYMENT - THANK YOU",
    "RENT UNIT 7", "CITY HYDRO BILL", "Lakeside Pharmacy", "SUNRISE YOGA", "CORNER MARKET #123", "BEAN COFFEE CA", "ESSO 44117",
    "METRO TRANSIT", "PAGE TURNER BOOKSTORE", "HILL COLLEGE", "ACME INSURANCE", "ZEBRA LOUNGE",
)
ACCOUNT_KINDS = ("Everyday Chequing", "Visa Signature", "High Interest Savings", "Acme Credit Union Checking", "Brokerage")
GAPS = (7, 14, 30, 90, 365)
OFFSETS_OUT_OF_STEP = (0, 7, 9, 22, 40, 41)
#: Parts that one task makes bills of; orders that one task makes pages of.
PARTS_A_TASK = ORDERS_A_TASK = 50_000
BILL_CATEGORIES = ("Subscriptions", "Utilities", "Food & Drink", "Health", "Other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    """values[index modulo their number]"""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction for each order: money in where the order is filled, else out."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("pos"),
        F.concat(F.lit("t"), k.cast("string")).alias("id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("account_id"),
        F.to_date("o_orderdate").alias("date"),
        pick(DESCRIPTIONS, k).alias("description"),
        F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("Shop "), (F.col("o_custkey") % 400).cast("string"))).alias("merchant"),
        F.when(k % 11 == 0, "").when(k % 13 == 0, None).otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("amount"),
        F.when(k % 3 != 0, F.lpad((k % 100).cast("string"), 4, "0")).alias("reference"),
        F.when(k % 7 == 0, None).otherwise(k % 5 == 0).alias("is_transfer"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = pick(ACCOUNT_KINDS, k)
    return table(spark, sf_dir, "customer").select(
        k.alias("key"),
        F.concat(F.lit("c"), k.cast("string")).alias("id"),
        F.initcap(F.lower("c_mktsegment")).alias("bank_name"),
        raw.alias("raw_type"),
        F.concat(F.lit("12-"), F.lpad(k.cast("string"), 7, "0")).alias("account_number"),
        F.col("c_acctbal").alias("closing_balance"),
        F.when(k % 5 == 1, k % 25 + F.lit(4.99)).alias("apr"),
    )


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one statement an account, in order of date: some balances are missing, some are a unit off."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("statement_id"),
        F.col("o_custkey").alias("key"),
        k.alias("row_key"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("deposit"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("withdrawal"),
        pick(DESCRIPTIONS, k).alias("description"),
    )
    order = Window.partitionBy("statement_id").orderBy("date", "row_key")
    sign = F.when(F.col("key") % 5 == 1, -1).otherwise(1)
    amount = (F.coalesce("deposit", F.lit(0.0)) - F.coalesce("withdrawal", F.lit(0.0))).cast("decimal(18,2)")
    running = (1000 + F.sum(amount * sign).over(order)).cast("double")
    balance = F.when(k_mod("row_key", 89), None).when(k_mod("row_key", 97), running + 1.0).otherwise(running)
    return rows.withColumn("pos", (F.row_number().over(order) - 1).cast("int")).withColumn("balance", balance)


def k_mod(name: str, modulus: int) -> Column:
    return F.col(name) % modulus == 0


def statement_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each statement: the printed totals are missing on some, the closing balance is wrong on some."""
    k = F.col("o_custkey")
    sign = F.when(k % 5 == 1, -1).otherwise(1)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    inward, outward = (F.coalesce(F.sum(F.when(test, price)), F.lit(0).cast("decimal(18,2)")) for test in (F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F"))
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        inward.alias("inward"), outward.alias("outward"), F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"),
    )
    return sums.select(
        F.concat(F.lit("c"), k.cast("string")).alias("statement_id"),
        k.alias("key"),
        pick(ACCOUNT_KINDS, k).alias("account_type"),
        F.lit(1000.0).alias("opening_balance"),
        F.when(k % 31 == 0, None).otherwise((1000 + (F.col("inward") - F.col("outward")) * sign).cast("double") + F.when(k % 23 == 0, 5.0).otherwise(0.0)).alias("closing_balance"),
        F.when(k % 6 != 0, F.col("outward").cast("double")).alias("total_withdrawals"),
        F.when(k % 7 != 0, F.col("inward").cast("double")).alias("total_deposits"),
        F.date_format("first_day", "yyyy-MM-dd").alias("statement_period_start"),
        F.date_format("last_day", "yyyy-MM-dd").alias("statement_period_end"),
    )


def statement_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statements as JSON texts, with the spellings of dates that banks use, null dates whose day stands in the
    description, rows of nothing, and rows that are no objects."""
    k = F.col("row_key")
    style = k % 5
    date = (
        F.when(style == 1, F.date_format("date", "M/d/yyyy")).when(style == 2, F.date_format("date", "yyyy/MM/dd"))
        .when(style == 3, F.date_format("date", "MMM d, yyyy")).when(style == 4, None).otherwise(F.date_format("date", "yyyy-MM-dd"))
    )
    description = F.when(style == 4, F.concat(F.date_format("date", "MM/dd"), F.lit(" "), F.col("description"))).otherwise(F.col("description"))
    nothing = k % 53 == 0
    body = F.to_json(F.struct(
        date.alias("date"), description.alias("description"), F.lpad((k % 100).cast("string"), 4, "0").alias("reference"),
        F.when(nothing, 0.0).otherwise(F.col("withdrawal")).alias("withdrawal"), F.when(nothing, None).otherwise(F.col("deposit")).alias("deposit"), "balance",
    ))
    lines = statement_rows(spark, sf_dir).select("statement_id", "pos", F.when(k % 59 == 0, F.lit('"page total"')).otherwise(body).alias("line"))
    lists = lines.groupBy("statement_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), ",").alias("lines"))
    heads = statement_headers(spark, sf_dir).join(lists, "statement_id")
    head = F.to_json(F.struct(
        F.concat(F.lit("Bank "), (F.col("key") % 40).cast("string")).alias("bank_name"), F.concat(F.lit("12-"), F.lpad(F.col("key").cast("string"), 7, "0")).alias("account_number"),
        "account_type", "opening_balance", "closing_balance", "total_withdrawals", "total_deposits", "statement_period_start", "statement_period_end",
    ))
    return heads.withColumn("h", head).select(
        "statement_id", F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"transactions":['), "lines", F.lit("]}")).alias("json")
    )


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs for each order: money out of one account and, some days later, into another; some a cent or two apart."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    round_price = F.when(k % 50 == 0, F.floor(price / 50000) * 500.0 + 500.0).otherwise(price)
    cents = F.when(k % 7 == 0, 0.01).when(k % 17 == 0, 0.02).otherwise(0.0)
    day = F.to_date("o_orderdate")
    word = F.when(k % 3 == 0, "ONLINE PMT").when(k % 50 == 25, "Zelle").otherwise("memo")
    sides = F.explode(F.array(
        F.struct((k * 2).alias("pos"), F.concat(F.lit("c"), (F.col("o_custkey") % 90).cast("string")).alias("account_id"), (-round_price).alias("amount"), day.alias("date"), F.lit("memo").alias("description")),
        F.struct((k * 2 + 1).alias("pos"), F.concat(F.lit("c"), ((F.col("o_custkey") + k % 3) % 90).cast("string")).alias("account_id"), (round_price + cents).alias("amount"),
                 F.date_add(day, (k % 6).cast("int")).alias("date"), word.alias("description")),
    ))
    return table(spark, sf_dir, "orders").select(sides.alias("s")).select("s.*")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six charges for each part, in step with a cadence or not; some skip one, some rise in price."""
    k = F.col("p_partkey")
    gap = pick(GAPS, k)
    i = F.col("i")
    day = F.when(k % 10 == 3, pick(OFFSETS_OUT_OF_STEP, i)).otherwise(i * gap + F.when((k % 9 == 0) & (i >= 3), gap).otherwise(0) + (k + i) % 2)
    base = 5 + F.col("p_retailprice") % 97
    rows = spread(table(spark, sf_dir, "part"), PARTS_A_TASK).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return rows.select(
        (k * 6 + i).alias("pos"),
        F.concat(F.lit("v"), (k % 30).cast("string")).alias("account_id"),
        F.concat(F.col("p_name"), F.lit(" "), k.cast("string")).alias("merchant"),
        F.date_add(F.lit("2020-01-01").cast("date"), day.cast("int")).alias("date"),
        (-F.call_function("format_number", F.when((k % 4 == 0) & (i == 5), base * 1.1).when(k % 6 == 5, base * (1 + i * 0.3)).otherwise(base), F.lit("0.00")).cast("double")).alias("amount"),
        F.when((k % 8 == 0) & (i < 3), "Groceries").otherwise(pick(BILL_CATEGORIES, k)).alias("category"),
        (k % 29 == 0).alias("is_transfer"),
    )


#: Years of each upload: 1995, 1998, 2020 and 2021 are in two of them.
UPLOADS = ((1995, 1996, 2020), (1995, 1997, 1998, 2020, 2021), (1998, 1999, 2000, 2001, 2021, 2022, 2023, 2024, 2025))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upload (from 1), statement_id and json: the legs and bills as statements, one for each account and upload, so that
    rows of some years are submitted twice."""
    row = ("owner", "number", "date", "description", "amount", "ord")
    number = F.regexp_replace("account_id", r"\D", "").cast("int")
    some = legs(spark, sf_dir).select(F.lit("Acme").alias("owner"), number.alias("number"), "date", "description", "amount", F.col("pos").alias("ord"))
    more = bills(spark, sf_dir).select(F.lit("Globe").alias("owner"), number.alias("number"), "date", F.col("merchant").alias("description"), "amount", F.col("pos").alias("ord"))
    sent = F.array(*(F.when(F.year("date").isin(*years), i) for i, years in enumerate(UPLOADS, 1)))
    rows = some.unionByName(more).select(*row, F.explode(F.array_compact(sent)).alias("upload"))
    line = F.to_json(F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "description",
        F.when(F.col("amount") < 0, -F.col("amount")).alias("withdrawal"), F.when(F.col("amount") > 0, F.col("amount")).alias("deposit"),
    ))
    lists = rows.groupBy("owner", "number", "upload").agg(F.sort_array(F.collect_list(F.struct("date", "ord", line.alias("line")))).alias("lines"))
    head = F.to_json(F.struct(F.col("owner").alias("bank_name"), F.format_string("77-%07d", "number").alias("account_number"), F.lit("Everyday Chequing").alias("account_type")))
    return lists.withColumn("h", head).select(
        "upload", F.concat_ws("-", "owner", F.col("number").cast("string"), F.col("upload").cast("string")).alias("statement_id"),
        F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"transactions":['), F.array_join(F.transform("lines", lambda r: r["line"]), ","), F.lit("]}")).alias("json"),
    )


def raw_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions as processors print them: prefix, name, store, phone, code, day and state."""
    k = F.col("p_partkey")
    parts = (
        pick(("SQ *", "TST* ", "POS DEBIT ", "PAYPAL *", "CHECKCARD 0907 ", "", "1126 "), k), F.upper("p_name"),
        F.when(k % 3 == 0, F.concat(F.lit(" #"), (k % 1000).cast("string"))).otherwise(""),
        F.when(k % 4 == 0, " 555-018-2233").otherwise(""), F.when(k % 8 == 0, " 7Q2WZ9").otherwise(""),
        F.when(k % 6 == 0, " MON").otherwise(""), F.when(k % 5 == 0, " CA").otherwise(""), F.when(k % 25 == 1, " 00098760").otherwise(""),
    )
    return table(spark, sf_dir, "part").select(k.alias("key"), F.concat(*parts).alias("description"))


def debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("key"), F.col("s_acctbal").alias("balance"), (k % 30 + F.lit(4.99)).alias("apr"))


HOLDERS = ("ANNA BELL", "JOHN Q DOE", "ELLA VON STEIN")
ROWS_A_PAGE = 6


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, width and word boxes of the statements of statement_rows, printed six rows to a page: a head on the first
    page, headings on each, an opening line, rows of which some lack the date, have a second line or furniture below, and
    totals and the closing balance at the end. A third of the documents print one column of unsigned amounts."""
    k, row = F.col("row_key"), F.col("pos") % ROWS_A_PAGE
    lone = F.col("key") % 3 == 0
    word = lambda text, x1, x2, y, conf=95.0: F.struct(text.alias("text"), F.lit(x1).cast("double").alias("x1"), F.lit(x2).cast("double").alias("x2"), F.lit(y).cast("double").alias("y1"), F.lit(conf).cast("double").alias("conf"))
    lit = lambda text, x1, x2, y, conf=95.0: word(F.lit(text), x1, x2, y, conf)
    money = lambda x, right, y, conf=95.0: word(F.format_number(x, 2), right + F.col("key") % 4 - 50, right + F.col("key") % 4, y, conf)
    run = lambda text, x, y: F.transform(F.split(F.lit(text) if isinstance(text, str) else text, " "), lambda t, i: word(t, x + 40 * i, x + 40 * i + 35, y))
    rows = statement_rows(spark, sf_dir).withColumn("page", F.floor(F.col("pos") / ROWS_A_PAGE).cast("int"))
    y, conf = 140 + 40 * row, F.when(k % 13 == 0, 60.0).otherwise(95.0)
    said = F.transform(F.split(F.replace("description", F.lit("UNIT 7"), F.lit("UNIT B")), " "), lambda t, i: word(t, 60 + 40 * i, 95 + 40 * i, y, conf))
    side = F.when(lone | F.col("deposit").isNotNull(), 480).otherwise(400)
    below = (
        F.when(k % 5 == 0, run("Store north", 62, y + 20)).when(k % 7 == 0, run("Member FDIC insured", 62, y + 20))
        .when(k % 11 == 0, run("please see the other side for terms", 62, y + 20)).when(k % 17 == 0, run("carried over", 350, y + 20))
    )
    printed = F.concat(
        F.array(F.when(k % 9 != 0, word(F.date_format("date", "yyyy-MM-dd"), 10, 50, y, conf))), said, F.array(F.when(k % 4 != 0, word(F.lpad((k % 100).cast("string"), 4, "0"), 252, 278, y, conf))),
        F.array(money(F.coalesce("deposit", "withdrawal"), side, y, conf), F.when((k % 89 != 0) | (k % 9 == 0), money(F.coalesce("balance", F.lit(500.0)), 560, y, conf))), F.coalesce(below, F.array().cast(BOXES)),
    )
    lines = rows.select("statement_id", "page", F.explode(F.array_compact(printed)).alias("w"))
    ends = rows.groupBy("statement_id", "key").agg(F.max("pos").alias("last"))
    heads = statement_headers(spark, sf_dir).join(ends.drop("key"), "statement_id")
    titles = F.concat(F.array(lit("Date", 10, 40, 100, 3.0), lit("Description", 60, 140, 100, 3.0), lit("Ref", 250, 280, 100, 3.0)), F.when(lone, F.array(lit("Amount", 430, 480, 100, 3.0))).otherwise(F.array(lit("Withdrawals", 330, 400, 100, 3.0), lit("Deposits", 430, 480, 100, 3.0))), F.array(lit("Balance", 510, 560, 100, 3.0)))
    every = heads.select("statement_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / ROWS_A_PAGE).cast("int"))).alias("page"), F.explode(titles).alias("w"))
    first = F.concat(
        run("ab Harbour Trust Bank", 10, 0), run("Statement of Account", 400, 0), run("12 Quay Street", 10, 20), run("Account Number:", 400, 20), F.array(word(F.concat(F.lit("12-"), F.lpad(F.col("key").cast("string"), 7, "0")), 480, 560, 20)),
        run(pick(HOLDERS, F.col("key")), 10, 40), F.array(word(pick(("Chequing", "Savings"), F.col("key")), 400, 440, 40)),
        F.array(word(F.col("statement_period_start"), 400, 450, 60), lit("to", 455, 465, 60), word(F.col("statement_period_end"), 470, 520, 60)), run("Opening Balance", 60, 120), F.array(money(F.col("opening_balance"), 560, 120)),
    )
    foot = 140 + 40 * (F.col("last") % ROWS_A_PAGE) + 40
    last = F.concat(
        F.array(F.when(~lone, lit("Totals", 60, 95, foot)), F.when(~lone, money(F.col("outward"), 400, foot)), F.when(~lone, money(F.col("inward"), 480, foot))),
        run("Closing Balance", 60, foot + 20), F.array(money(F.coalesce("closing_balance", F.lit(0.0)), 560, foot + 20)),
    )
    sums = rows.groupBy("statement_id").agg(*(F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")), F.lit(0)).cast("double").alias(n) for c, n in (("withdrawal", "outward"), ("deposit", "inward"))))
    top = heads.select("statement_id", F.lit(0).alias("page"), F.explode(first).alias("w"))
    end = heads.join(sums, "statement_id").select("statement_id", F.floor(F.col("last") / ROWS_A_PAGE).cast("int").alias("page"), F.explode(F.array_compact(last)).alias("w"))
    boxes = lines.unionByName(every).unionByName(top).unionByName(end)
    return boxes.select(F.col("statement_id").alias("doc"), "page", F.lit(600.0).alias("width"), "w.text", "w.x1", "w.x2", "w.y1", (F.col("w.y1") + 10).alias("y2"), "w.conf")


BOXES = "array<struct<text:string,x1:double,x2:double,y1:double,conf:double>>"
