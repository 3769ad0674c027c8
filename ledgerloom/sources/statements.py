"""Statement documents: JSON texts of any spelling, read as VARIANT so that one bad row spoils no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import once, written

#: Bytes that a VARIANT holds at most: a larger text may still fit, as its keys are kept once.
HELD = 128 * 1024 * 1024
WHITE = " \t\n\x0b\x0c\r"
# Spellings of fields, the canonical one first.
HEADER = {
    "bank_name": ("bank_name", "bank", "institution", "institution_name", "vendor_name"),
    "account_holder_name": ("account_holder_name", "account_holder", "holder_name", "customer_name", "name"),
    "account_number": ("account_number", "account_no", "account", "acct_number", "acct_no"),
    "account_type": ("account_type", "type", "product", "product_type"),
    "statement_period_start": ("statement_period_start", "period_start", "start_date", "from_date", "statement_start", "statement_start_date"),
    "statement_period_end": ("statement_period_end", "period_end", "end_date", "to_date", "statement_end", "statement_end_date"),
    "currency": ("currency", "currency_code", "iso_currency"),
    "opening_balance": ("opening_balance", "previous_balance", "beginning_balance", "balance_forward", "start_balance"),
    "closing_balance": ("closing_balance", "ending_balance", "new_balance", "final_balance", "end_balance"),
    "total_withdrawals": ("total_withdrawals", "total_debits", "withdrawals_total", "total_paid_out", "total_withdrawal"),
    "total_deposits": ("total_deposits", "total_credits", "deposits_total", "total_paid_in", "total_deposit"),
}
ROW = {
    "date": ("date", "transaction_date", "posted_date", "post_date", "value_date", "effective_date"),
    "description": ("description", "details", "particulars", "narrative", "memo", "merchant", "payee", "transaction"),
    "reference": ("reference", "ref", "ref_no", "cheque_number", "check_number", "check_no", "confirmation"),
    "withdrawal": ("withdrawal", "withdrawals", "debit", "debits", "paid_out", "money_out", "amount_debit"),
    "deposit": ("deposit", "deposits", "credit", "credits", "paid_in", "money_in", "amount_credit"),
    "balance": ("balance", "running_balance", "balance_after", "closing_balance"),
    "amount": ("amount", "transaction_amount", "value", "net_amount"),
}
LISTS = ("transactions", "transaction", "lines", "entries", "rows", "activity", "items")
PERIODS = ("statement_period", "period", "statement_dates")
PERIOD_START = ("start", "start_date", "from", "begin", "beginning")
PERIOD_END = ("end", "end_date", "to", "finish", "ending")
AMOUNTS = ("opening_balance", "closing_balance", "total_withdrawals", "total_deposits", "withdrawal", "deposit", "balance")
WRAPPERS = ("statement", "data", "result", "extracted_data")


def lower_keys(v: Column) -> Column:
    """An object with its keys trimmed and in lower case; of several that become one, that which sorts last (the one in
    lower case) counts. Anything else as it is."""
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    plain = F.coalesce(F.forall(entries, lambda e: e["key"] == F.lower(F.trim(e["key"]))), F.lit(True))
    keys = F.array_distinct(F.transform(entries, lambda e: F.lower(F.trim(e["key"]))))
    values = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == k), -1)["value"])
    return F.when(plain, v).otherwise(F.to_variant_object(F.map_from_arrays(keys, values)))


def field(v: Column, names: tuple[str, ...], kind: str = "string") -> Column:
    """The first of the fields that is there and not blank."""
    found = [F.try_variant_get(v, f"$.{n}", kind) for n in names]
    return F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in found) if kind == "string" else found)


def read_files(spark: SparkSession, *paths: str, glob: str = "*.json") -> DataFrame:
    """source and json of every file under the paths (files, folders, globs), a file once."""
    whole = spark.read.text([*dict.fromkeys(paths)], wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return whole.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("json"))


def unfenced(text: Column) -> Column:
    """What stands between the first fence of three backticks and the next, trimmed; the whole text without them."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.btrim(F.when(text.rlike(r"(?s)```.*?```"), fenced).otherwise(text), F.lit(WHITE))


def plain_number(v: Column) -> Column:
    """A field as a number where it is text that holds one (`$1,234.50`, `(62.47)`, `-5`): its digits and points, negative
    with parentheses around or a dash before; blank text as null; anything else as it is."""
    text = F.btrim(F.try_variant_get(v, "$", "string"), F.lit(WHITE))
    digits = F.regexp_replace(text, r"[^\d.]", "")
    number = digits.try_cast("double")
    signed = F.when(text.rlike(r"(?s)^\(.*\)$|^-"), -number).otherwise(number)
    return F.when(F.schema_of_variant(v) != "STRING", v).when(text == "", F.lit(None).cast("variant")).when(number.isNotNull(), signed.cast("variant")).otherwise(v)


def generated(documents: DataFrame, *, text: str = "json") -> DataFrame:
    """documents whose texts a model has written, as JSON to be parsed: out of their fences, and with numbers for the
    amounts of the head and of each row. What is no object then is left as it stands, for parse to say why."""
    amounts = lambda v: F.to_variant_object(F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: F.when(k.isin(*AMOUNTS), plain_number(x)).otherwise(x)))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    bare = once(once(documents, {text: unfenced(F.col(text))}), {"_v": F.try_parse_json(text)})
    rows = F.try_variant_get("_v", "$.transactions", "array<variant>")
    cleaned = F.transform(rows, lambda r: F.when(is_object(r), amounts(r)).otherwise(r))
    head = F.try_variant_get(amounts(F.col("_v")), "$", "map<string,variant>")
    whole = F.when(rows.isNull(), head).otherwise(F.map_concat(F.map_filter(head, lambda k, _: k != "transactions"), F.create_map(F.lit("transactions"), F.to_variant_object(cleaned))))
    return once(bare, {text: F.when(is_object(F.col("_v")), F.to_json(F.to_variant_object(whole))).otherwise(F.col(text))}).drop("_v")


def parse(documents: DataFrame, *, text: str = "json", largest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, failures): the documents with `v`, the parsed object; and those that are empty, too large, no JSON, or hold
    no list of transactions, with `reason`. Too large are texts over `largest` bytes, if it is given, and what no VARIANT
    holds."""
    size, v = F.octet_length(text), F.col("v")
    over = F.lit(False) if largest is None else F.coalesce(size > largest, F.lit(False))
    parsed = once(once(documents, {"v": F.when(~over, F.try_parse_json(text))}), {"v": lower_keys(v)})
    listed = F.coalesce(*(F.try_variant_get(v, f"$.{n}", "array<variant>") for n in LISTS))
    reason = (
        F.when(F.col(text).isNull() | (F.trim(text) == ""), "empty").when(over | (v.isNull() & (size > HELD)), "too large").when(v.isNull(), "no JSON")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "no object").when(listed.isNull(), "no transactions")
    )
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").drop("v")


def kept(parsed: DataFrame, text: str = "json") -> DataFrame:
    """Good documents, written without their texts: heads and rows are then read from what was parsed once."""
    return written(parsed.drop(text), "parsed")


def pages(documents: DataFrame, *, list_as: str = "auto", text: str = "json") -> DataFrame:
    """Documents that are lists, or wrap an object that has a list of rows, as one row an element: `page` and `v`. As `pages` the elements are
    one statement's, as `statements` each is its own; `auto` says statements where the elements name different accounts.
    The column `unit` numbers the statements of a document."""
    if list_as not in ("auto", "pages", "statements"):
        raise ValueError("list_as must be auto, pages or statements")
    v = F.try_parse_json(text)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    rows = documents.select("*", F.posexplode(items).alias("page", "e")).where(F.schema_of_variant("e").startswith("OBJECT")).withColumn("e", lower_keys(F.col("e")))
    rows = rows.withColumns({f"_{w}": lower_keys(F.try_variant_get("e", f"$.{w}", "variant")) for w in WRAPPERS})
    rows = rows.withColumn("v", F.coalesce(*(F.when(rows_of(F.col(f"_{w}")).isNotNull(), F.col(f"_{w}")) for w in WRAPPERS), F.col("e"))).drop("e", *(f"_{w}" for w in WRAPPERS))
    if list_as != "auto":
        return rows.withColumn("unit", F.lit(0) if list_as == "pages" else F.col("page"))
    key = [c for c in documents.columns if c != text]
    identity = F.concat_ws("|", field(F.col("v"), HEADER["account_number"]), field(F.col("v"), HEADER["statement_period_start"]))
    several = rows.groupBy(*key).agg((F.count_distinct(F.nullif(identity, F.lit(""))) > 1).alias("_several"))
    return rows.join(several, key).withColumn("unit", F.when(F.col("_several"), F.col("page")).otherwise(0)).drop("_several")


def header(v: Column) -> dict[str, Column]:
    """The head's fields as text, under their canonical names; the period may be an object or `X to Y`."""
    out = {name: field(v, names) for name, names in HEADER.items()}
    boxes = [lower_keys(F.try_variant_get(v, f"$.{p}", "variant")) for p in PERIODS]
    spoken = F.coalesce(*(F.try_variant_get(v, f"$.{p}", "string") for p in PERIODS))
    halves = F.split(spoken, r"\s+(?:to|through|-|–|—)\s+")
    for name, keys, i in (("statement_period_start", PERIOD_START, 0), ("statement_period_end", PERIOD_END, 1)):
        out[name] = F.coalesce(out[name], *(field(b, keys) for b in boxes), F.when(F.size(halves) == 2, F.get(halves, i)))
    return out


def rows_of(v: Column) -> Column:
    """The list of rows under any of its names."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", "array<variant>") for n in LISTS))
