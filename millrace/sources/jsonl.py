"""JSON lines: tolerant reading, resumption, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), known_only: bool = False) -> DataFrame:
    """The records of a JSON-lines file or folder in the declared ``schema``. Blank and broken lines are left out, and
    so are records without a ``required`` key or, with ``known_only``, with a key that the schema doesn't have."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_keys", F.json_object_keys("value"))
    parsed = lines.withColumn("_r", F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}))
    good = parsed.where(F.col("_r").isNotNull() & F.col(f"_r.{CORRUPT}").isNull() & F.col("_keys").isNotNull())
    for key in required:
        good = good.where(F.array_contains("_keys", key))
    if known_only:
        good = good.where(F.size(F.array_except("_keys", F.array(*map(F.lit, names)))) == 0)
    return good.select(*(F.col(f"_r.{n}").alias(n) for n in names))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_lines, n_bad): non-blank lines of each file, and those that are no JSON."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.trim("value") != "")
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.expr("try_parse_json('[' || value || ']') is null")).alias("n_bad"))


def remaining(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The records whose ``key`` isn't done yet."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def append_jsonl(records: DataFrame, path: str) -> None:
    """Append records as JSON lines, nulls included."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def export_records(records: DataFrame, path: str, line: str = "line") -> None:
    """Write a column of ready JSON texts, one per line."""
    records.select(F.col(line)).write.mode("overwrite").text(path)
