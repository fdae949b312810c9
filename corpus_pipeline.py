"""Corpus pipeline: from raw documents to a weighted mix, one operator a stage.

Each stage gets all that its predecessor kept and its decisions take effect at once. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import discard, materialize
from trajecta.llm.decontaminate import find_benchmark_text
from trajecta.llm.langid import fit, identify, training_rows
from trajecta.llm.mixing import mix_sources
from trajecta.llm.neardup import near_duplicate_rows
from trajecta.llm.pii import redact

SURE = 0.5  # least share of a document's words in its language


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language: no letters, or no language with half of the words, and they go."""
    found = identify(docs, fit(training_rows(docs)))
    return found.where((F.col("_lang_pred") != "und") & (F.col("_score") >= SURE)).select(docs.columns)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """A doc_id may be missing or repeated, so a row is named by it (null-safe) and a hash."""
    return a["doc_id"].eqNullSafe(b["_id"]) & (a["_row"] == b["_row"])


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles at a similarity of 0.8.

    The smallest doc_id stays; a document without an id only where its group has no id. A
    repeated row stays once; of rows with one id and text that differ otherwise, the least by
    their other columns (null first). Texts without words have no group: those without an id all stay.
    """
    kept = near_duplicate_rows(docs, k=5, percent=80).where("first")
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), (F.col("doc_id").isNull() & F.col("node").isNull()).alias("_all")).distinct()
    own = docs.withColumn("_row", F.xxhash64("text"))
    own = materialize(own.join(kept.hint("merge"), same_row(own, kept)).select(*docs.columns, "_all"), "kept")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = own.where("not _all").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_least")).select("doc_id", "text", "_least.*").select(docs.columns)
    return once.unionByName(own.where("_all").select(docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items; a missing id, or one that a contaminated document has too, changes nothing."""
    own = docs.withColumn("_row", F.xxhash64("text"))
    found = find_benchmark_text(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keys=("doc_id", "_row"))
    leaks = materialize(found.select(F.col("doc_id").alias("_id"), "_row").distinct(), "leaks")
    return own.join(leaks.hint("merge"), same_row(own, leaks), "left_anti").select(docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; every document stays, a null text with its ``n_chars``."""
    size = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")
    return redact(docs).withColumn("n_chars", size).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them (repeats counted) and their source's target.

    Every row has its own line, also those that repeat an id, have none, or are alike in all columns.
    """
    row = F.xxhash64("text", "source", "lang", "n_chars")
    per_doc = mix_sources(docs, row=row)[1].withColumnRenamed("row", "_row")
    # rows of one key are alike, so any of them gives the columns of all
    text = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id"), row.alias("_row"), "text", "lang", "n_chars")
    keys = ["_id", "_no_id", "_row"]
    text = text.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("n_chars"))).where("_n = 1")
    per_doc = per_doc.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_no_id", F.col("doc_id").isNull())
    return per_doc.join(text.hint("merge"), keys).select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", keep_languages),
    ("MinHash near-dedup", keep_one_copy),
    ("benchmark decontamination", drop_benchmark),
    ("PII", hide_personal_data),
    ("mixing sources to target weights", mix),
]

ORACLE_SQL = None  # SQL can't state the learned and sketched stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, then the one before goes."""
    docs, used = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
        discard(*used)
        used = [docs]
    return docs
