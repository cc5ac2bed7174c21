"""From raw documents to packed training sequences: the stages of a corpus, one operator each.

Every stage but the last takes and returns the columns of ``documents``; each
result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerisk.llm.common import settle
from pagerisk.llm.jaccard import similar_groups
from pagerisk.llm.language import identify_languages
from pagerisk.llm.mixing import label_weights, mix
from pagerisk.llm.packing import pack_documents
from pagerisk.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A language has to have the larger share of the likelihood.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a clear language go; a missing language is filled in. NULL texts go."""
    named = identify_languages(docs, carry=("text", "lang", "source", "n_chars"))
    kept = named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def one_of_repeats(docs: DataFrame) -> DataFrame:
    """Of rows with one doc_id and one text, NULL ids being alike and NULL texts empty, the least stays.

    Only the rows of repeated keys are grouped, combined before the shuffle; all others stay where they are.
    """
    keyed = docs.withColumn("_text", F.md5(F.coalesce("text", F.lit(""))))
    repeated = settle(keyed.groupBy("doc_id", "_text").agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "repeated-rows")
    if repeated.isEmpty():
        return docs
    same = [keyed[c].eqNullSafe(repeated[c]) for c in ("doc_id", "_text")]
    least = keyed.join(repeated, same, "left_semi").groupBy("doc_id", "_text").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return keyed.join(repeated, same, "left_anti").select(*COLUMNS).union(least.select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or through others, the smallest doc_id stays.

    Rows that repeat a doc_id and its text stay once, rows without doc_id once for each text.
    """
    gone = similar_groups(docs, words=5, percent=80).filter("component_id <> doc_id").select("doc_id").distinct()
    return one_of_repeats(docs.join(settle(gone, "near-duplicates"), "doc_id", "left_anti").select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings of smaller documents are cut out; characters cut in half go, and documents of which nothing is left."""
    cut = remove_repeats(docs, keep="text", carry=("lang", "source")).filter("n_removed = 0 OR kept <> ''")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the mix of sources takes them: not at all, once or twice. Each row counts for itself, whatever its id."""
    weights = label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    taken = mix(docs, quality=weights, carry=("text", "lang", "n_chars")).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("mixture", mixture), ("packing", packing),
]

#: The trees of the language stage are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
