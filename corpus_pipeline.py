"""A training corpus from `documents`: each stage is one corpus operator, whose decisions hold for those after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, exact_dedup, jaccard_join, lang_id, packing
from ledgerloom.llm.common import row_key, stash
from ledgerloom.llm.queries import tokenizer_file

#: A document is rejected if no language can be told, or if the best one's probability is below this. With as few as
#: four languages a score under 0.3 is next to a guess; with more, a guess is worth less and so is the bound.
LEAST_SCORE, LANGS = 0.3, 4


def least_score(langs: int) -> float:
    """The bound of a net of so many languages: as far above a guess among them as LEAST_SCORE is among LANGS."""
    return LEAST_SCORE * LANGS / max(langs, LANGS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network tells."""
    net = lang_id.fit(docs)
    found = lang_id.identify(docs, net, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= least_score(len(net.langs) if net else 0))).select(*docs.columns)


def _join(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined to rows (doc_id and row_key) that are theirs; ids may be null or repeated."""
    rows = rows.withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    return docs.withColumn("_key", row_key()).join(rows, F.col("_key").eqNullSafe(F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), how)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id; one row of those that repeat both."""
    kept = exact_dedup.exact_dedup(docs, exact_dedup.newer_half(docs)).where("kept")
    kept = stash(kept.groupBy(F.col("doc_id").alias("_id"), "text_sha256").count(), "kept")
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (digest == kept["text_sha256"]), "left_semi").select(*docs.columns)
    return out.dropDuplicates(["doc_id", "text"]) if kept.where("count > 1").limit(1).count() else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (the one with the smallest doc_id; a null one if there is no other;
    one of them if several have it), and all without words."""
    found = stash(jaccard_join.jaccard_join(docs, rows=True).select("doc_id", "row", "component"), "near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    least = found.where("component is not null").groupBy("component").agg(first).select("first.doc_id", "first.row", F.lit(True).alias("_words"))
    empty = found.where("component is null").select("doc_id", "row", F.lit(False).alias("_words")).distinct()
    kept = _join(docs, stash(least.unionByName(empty), "kept"), "inner").select(*docs.columns, "_words")
    if found.where("component is not null").groupBy("doc_id", "row").count().where("count > 1").limit(1).count():  # whole rows that repeat
        kept = kept.where("_words").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("not _words"))
    return kept.select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item: of rows with null or repeated ids, those that contain none."""
    hits = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rows=True).select("doc_id", "row").distinct()
    return _join(docs, hits, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near duplicates", near), ("decontamination", clean), ("packing", packed)]

#: Language ID and packing run a trained network and a tokenizer, so SQL cannot give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, "pipeline")
    return docs
