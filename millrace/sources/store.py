"""Small tables of parameters and scores that are kept between runs, and reports in JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, path: str) -> None:
    """Replace the table at ``path``."""
    rows.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path`` with the columns of ``schema``; empty if there is none, or none that can be read so."""
    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.parquet(path)
        return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema))
    except AnalysisException:
        return empty


def save_reports(rows: DataFrame, path: str, name: str) -> None:
    """One folder of JSON per value of ``name``, each line with a report of that name."""
    rows.write.mode("overwrite").partitionBy(name).json(path)


def load_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The reports below ``path`` with their ``file``; lines that are no JSON of the ``schema`` are left out."""
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").json(path)
    return rows.withColumn("file", F.input_file_name()).where("_bad is null").drop("_bad")


def cache_state(now: DataFrame, kept: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state) of ``now``(key, digest) against the ``kept`` rows: hit, stale (kept with another digest) or miss, and
    gone for kept keys that are no more. Null keys are left out; of several kept digests any equal one is a hit."""
    new = now.where(F.col(key).isNotNull()).select(key, F.col(digest).alias("_d")).distinct()
    old = kept.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(digest).alias("_o")).distinct()
    both = new.join(old, new[key] == old["_k"], "full")
    state = F.when(F.col("_k").isNull(), "miss").when(F.col(key).isNull(), "gone").when(F.col("_d").eqNullSafe(F.col("_o")), "hit").otherwise("stale")
    rank = F.when(state == "hit", 0).otherwise(1)
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), state.alias("state"), rank.alias("_r")).groupBy(key).agg(F.min_by("state", F.struct("_r", "state")).alias("state"))
