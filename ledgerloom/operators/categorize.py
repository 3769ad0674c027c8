"""Categories by a cascade: dictionary, learned merchants, keywords, enrichment, a second opinion, Other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.num import py_round
from ledgerloom.functions.text import CATEGORIES, enrichment_category, keyword_category, merchant_key

#: The confidence of each layer, and how sure an enrichment must be to be taken alone.
CONFIDENCE = {"dict": 1.0, "keyword": 0.95, "cache": 0.9, "enriched": 0.85, "agreed": 0.85, "arbitrated": 0.75, "enriched_low": 0.5, "fallback": 0.0}
TRUST, ALIAS_TRUST = 90.0, 70.0


def lookup(df: DataFrame, key: str, value: str, allowed: tuple[str, ...]) -> DataFrame:
    """_key and _value of the valid rows, one a key: the smallest value, were a key to repeat."""
    return df.where((F.trim(key) != "") & F.col(value).isin(*allowed)).groupBy(F.trim(key).alias("_key")).agg(F.min(value).alias("_value"))


def resolve_merchants(txns: DataFrame, aliases: DataFrame) -> DataFrame:
    """txns with merchant: that of the description's alias, if it has one of confidence 70 or more, else the key made
    from the description. aliases: raw_description, merchant, confidence."""
    good = (F.trim("merchant") != "") & (F.col("confidence").try_cast("double") >= ALIAS_TRUST)
    known = aliases.where(good).groupBy(F.trim("raw_description").alias("_raw")).agg(F.min(F.trim("merchant")).alias("_alias"))
    joined = txns.drop("merchant").join(known, F.trim(F.col("description")) == F.col("_raw"), "left")
    return joined.withColumn("merchant", F.coalesce("_alias", merchant_key(F.col("description")))).drop("_raw", "_alias")


def categorize(txns: DataFrame, dictionary: DataFrame, cache: DataFrame, enriched: DataFrame | None = None, opinions: DataFrame | None = None) -> DataFrame:
    """txns with category, confidence and layer.

    A row takes the first that answers: the dictionary's category of its merchant; the category learned for the merchant,
    be it from the cache or from an earlier row (by pos) that a keyword or a trusted enrichment answered; a keyword; an
    enrichment; a second opinion; Other. dictionary and cache: merchant, category. enriched: description, category,
    confidence (0 to 100), in the source's vocabulary. opinions: pos, category. Blank and null merchants never learn.

    What a merchant learns is one row (its first answer and where it stands), found by an aggregate that combines before
    the shuffle. So a merchant with a third of all rows needs no window over them.
    """
    known = lookup(dictionary, "merchant", "category", CATEGORIES).toDF("_dm", "_dict")
    stored = lookup(cache, "merchant", "category", CATEGORIES).toDF("_cm", "_cache")
    rows = txns.drop("category", "confidence", "layer").join(known, F.col("merchant") == F.col("_dm"), "left").join(stored, F.col("merchant") == F.col("_cm"), "left")
    if enriched is not None:
        answers = enriched.groupBy(F.trim("description").alias("_ed")).agg(F.max_by(F.struct(enrichment_category(F.col("category")).alias("c"), F.col("confidence").alias("p")), F.struct("confidence", "category")).alias("_e"))
        rows = rows.join(answers, F.trim(F.col("description")) == F.col("_ed"), "left").withColumns({"_enriched": F.col("_e.c"), "_sure": F.coalesce(F.col("_e.p"), F.lit(0.0)) >= TRUST}).drop("_ed", "_e")
    else:
        rows = rows.withColumns({"_enriched": F.lit(None).cast("string"), "_sure": F.lit(False)})
    rows = rows.withColumn("_word", keyword_category(F.col("description"), F.col("amount")))
    teaches = F.coalesce("_word", F.when(F.col("_sure"), F.col("_enriched")))
    open_rows = rows.where(F.coalesce("_dict", "_cache").isNull() & teaches.isNotNull() & (F.trim("merchant") != ""))
    learned = open_rows.groupBy(F.col("merchant").alias("_lm")).agg(F.min("pos").alias("_from"), F.min_by(teaches, "pos").alias("_learned"))
    rows = rows.join(learned, F.col("merchant") == F.col("_lm"), "left")
    if opinions is not None:
        second = opinions.where(F.col("category").isin(*CATEGORIES)).groupBy(F.col("pos").alias("_op")).agg(F.min("category").alias("_opinion"))
        rows = rows.join(second, F.col("pos") == F.col("_op"), "left").drop("_op")
    else:
        rows = rows.withColumn("_opinion", F.lit(None).cast("string"))
    earlier = F.when(F.col("pos") > F.col("_from"), F.col("_learned"))
    layer = (
        F.when(F.col("_dict").isNotNull(), "dict").when(F.coalesce("_cache", earlier).isNotNull(), "cache").when(F.col("_word").isNotNull(), "keyword")
        .when(F.col("_enriched").isNotNull() & F.col("_sure"), "enriched").when(F.col("_opinion").isNotNull(), F.when(F.col("_opinion") == F.col("_enriched"), "agreed").otherwise("arbitrated"))
        .when(F.col("_enriched").isNotNull(), "enriched_low").otherwise("fallback")
    )
    category = (
        F.when(F.col("layer").isin("agreed", "arbitrated"), F.col("_opinion"))
        .otherwise(F.coalesce("_dict", "_cache", earlier, "_word", "_enriched", F.lit("Other")))
    )
    confidence = F.element_at(F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair)), F.col("layer"))
    out = rows.withColumn("layer", layer).withColumns({"category": category, "confidence": confidence})
    return out.select(*txns.drop("category", "confidence", "layer").columns, "category", "confidence", "layer")


def learned_merchants(categorized: DataFrame) -> DataFrame:
    """merchant and category for the cache: each merchant's first answer by keyword, trusted enrichment or opinion."""
    taught = categorized.where(F.col("layer").isin("keyword", "enriched", "agreed", "arbitrated") & (F.trim("merchant") != ""))
    return taught.groupBy("merchant").agg(F.min_by("category", "pos").alias("category"))


def coverage(categorized: DataFrame) -> DataFrame:
    """Rows by layer and their share in percent."""
    layers = categorized.groupBy("layer").agg(F.count("*").alias("rows"))  # eight rows at most
    return layers.select("layer", "rows", py_round(F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy()), 1).alias("share_pct"))


def descriptions_to_ask(txns: DataFrame, aliases: DataFrame) -> DataFrame:
    """description, trimmed and once each, for those that aliases (raw_description) have no row for, not even one that
    found no merchant: what an enrichment is still to be asked for."""
    wanted = txns.select(F.trim("description").alias("description")).where("description != ''").distinct()
    return wanted.join(aliases.select(F.col("raw_description").alias("description")).distinct(), "description", "left_anti")


def learn_aliases(aliases: DataFrame, answers: DataFrame) -> DataFrame:
    """aliases (raw_description, merchant, category, confidence, source) and the answers (also with error) for
    descriptions that they lack. A failed call is no answer and is left out; an answer without a merchant is kept, so
    that nobody asks again. Of several answers to one description the surest counts."""
    best = F.max_by(F.struct("merchant", "category", "confidence"), F.struct(F.col("confidence"), F.col("merchant"), F.col("category"))).alias("a")
    given = answers.where("error IS NULL").join(aliases.select("raw_description"), "raw_description", "left_anti").groupBy("raw_description").agg(best)
    merchant = F.coalesce("a.merchant", F.lit(""))
    source = F.when(merchant == "", "nomerchant").otherwise("enrichment")
    new = given.select("raw_description", merchant.alias("merchant"), F.coalesce("a.category", F.lit("")).alias("category"), F.coalesce(F.col("a.confidence").cast("string"), F.lit("")).alias("confidence"), source.alias("source"))
    return aliases.select(*new.columns).unionByName(new)


def build_dictionary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merchant, category: the first by pos) and the merchants that were given several categories."""
    both = rows.select(F.explode(F.array_distinct(F.array("merchant", merchant_key(F.col("merchant"))))).alias("merchant"), "category", "pos")
    tally = both.where((F.trim("merchant") != "") & F.col("category").isin(*CATEGORIES)).groupBy("merchant").agg(F.min_by("category", "pos").alias("category"), F.count_distinct("category").alias("_n"))
    return tally.select("merchant", "category"), tally.where("_n > 1").select("merchant", F.col("_n").alias("categories"))
