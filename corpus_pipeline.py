"""A training corpus from documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import line_dedup, mix, pack, quality, simhash
from quarryline.llm.common import col, fresh, read_table, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under its threshold go."""
    model = quality.train(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    name = fresh(docs, "quality_score")
    return quality.score(docs, model, name).where(col(name) >= quality.THRESHOLD).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; all documents stay, with n_chars of what is left of them."""
    out = line_dedup.drop_recurring_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id."""
    return simhash.keep_one_of_each_group(docs.select(*COLUMNS))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources to their target weights takes it."""
    mixed = mix.mix(docs.select(*COLUMNS))
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token sequences of several context sizes, a row for each piece."""
    return pack.pack(docs, pack.default_tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_to_targets", mix_to_targets),
    ("packing", packing),
]

#: The stages learn, hash and iterate as SQL cannot; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
