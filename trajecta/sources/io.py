"""Readers and writers of items, tables, states, trees and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.text import id_part, squash_ws


def read_items(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Headerless ``id, word`` rows whose id ends in ``whole``: ``id, word, seq_id, pos`` (pos from 0)."""
    rows = spark.read.schema("id string, word string").csv(path, sep=sep, quote="")
    rows = rows.na.drop(subset=["id", "word"]).where(id_part(F.col("id"), -1) == "whole").withColumn("word", squash_ws(F.col("word")))
    rows = rows.where(F.length("word") > 0)
    return rows.select("id", "word", id_part(F.col("id"), 1).cast("int").alias("seq_id"), (id_part(F.col("id"), 2).cast("int") - 1).alias("pos"))


def read_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A headered delimited file; a NaN counts as missing."""
    reader = spark.read.option("header", True).option("sep", sep).option("nanValue", "NaN")
    rows = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    numbers = [c for c, kind in rows.dtypes if kind in ("double", "float")]
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in numbers else F.col(c) for c in rows.columns])


def read_by_file(spark: SparkSession, path: str, schema: str, name: str = "subject") -> DataFrame:
    """All files of a folder in one frame; the file's stem is a column. Used for subjects and annotators."""
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1))


def read_bracketed(spark: SparkSession, path: str) -> DataFrame:
    """``tree``: one balanced bracketed tree a row; unbalanced records are left out."""
    rows = spark.read.text(path, lineSep="\n(ROOT").select(F.trim("value").alias("t")).where("t <> ''")
    rows = rows.select(F.when(F.startswith("t", F.lit("(ROOT")), F.col("t")).otherwise(F.concat(F.lit("(ROOT"), F.lit(" "), F.ltrim("t"))).alias("tree"))
    count = lambda c: F.length("tree") - F.length(F.replace("tree", F.lit(c), F.lit("")))
    return rows.where(count("(") == count(")"))


BUCKETS = 256  # folders of a store, however many keys it has


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def _bucket(key: str, buckets: int) -> Column:
    return F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def _of_store(store: DataFrame) -> tuple[str, int]:
    """The column of a store's folders, whose name says how many there are."""
    name = next(c for c in store.columns if c.startswith("bucket_"))
    return name, int(name.removeprefix("bucket_"))


def write_states(states: DataFrame, path: str, key: str = "seq_id", buckets: int = BUCKETS) -> None:
    """Sequences (or subjects' results) as a Parquet store in ``buckets`` folders by the key's hash.

    A store that is there already takes in the keys of ``states``: theirs are replaced, other keys stay,
    and only folders with one of the new keys are written again. Each of them gets one file in the order of
    the key, so the number of files doesn't grow with keys or runs, and readers skip row groups. A store
    keeps the number of folders it was begun with. Null keys are a key of their own.
    """
    spark = states.sparkSession
    rows, there = states, _exists(spark, path)
    if there:
        old = spark.read.parquet(path)
        name, buckets = _of_store(old)
        keys = states.select(F.col(key).alias("_key")).distinct()
        touched = keys.select(F.coalesce(_bucket("_key", buckets), F.lit(0)).alias(name)).distinct()
        stay = old.join(F.broadcast(touched), name, "left_semi").join(keys.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left_anti")  # a number for each folder
        rows = states.unionByName(stay.drop(name).select(states.columns))
    name = f"bucket_{buckets}"
    rows = rows.withColumn(name, F.coalesce(_bucket(key, buckets), F.lit(0)))
    dealt = rows.repartition(name).sortWithinPartitions(name, key)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def read_states(spark: SparkSession, path: str, key: str = "seq_id", keys: list | None = None) -> DataFrame:
    """A store's rows, of all keys or of ``keys``, whose folders alone are then read."""
    rows = spark.read.parquet(path)
    name, buckets = _of_store(rows)
    if keys is not None:
        asked = spark.createDataFrame([(k,) for k in keys], rows.select(key).schema)
        own = sorted({r[0] for r in asked.select(F.coalesce(_bucket(key, buckets), F.lit(0))).collect()})
        rows = rows.where(F.col(name).isin(own)).where(F.col(key).isin([k for k in keys if k is not None]) | (F.col(key).isNull() if None in keys else F.lit(False)))
    return rows.drop(name)


def unfinished(manifest: DataFrame, path: str, key: str = "subject") -> DataFrame:
    """The rows of a manifest whose key a store does not have yet; all of them before there is a store."""
    spark = manifest.sparkSession
    if not _exists(spark, path):
        return manifest
    done = spark.read.parquet(path).select(F.col(key).alias("_key")).distinct()
    return manifest.join(done.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left_anti")


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)
