"""Queries over the JSON lines whose schema drifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import schema_drift
from millrace.sources.tables import table

LINES = ("series", "source_file", "file_seq", "line_no", "line")


def p1_found(spark, sf_dir):
    return schema_drift.schema_changes(table(spark, sf_dir, "complete_patches", *LINES))


def p1_unified(spark, sf_dir):
    unified = schema_drift.unified_table(table(spark, sf_dir, "complete_patches", *LINES))
    return unified.withColumn("rest", F.to_json("rest"))


def p1_values(spark, sf_dir):
    """Lines and values that are not null of every file, counted in the unified table."""
    unified = schema_drift.unified_table(table(spark, sf_dir, "complete_patches", *LINES))
    own = sum((F.col(c).isNotNull().cast("int") for c in ("task_id", "instance_id", "patch")), F.lit(0))
    return unified.groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("rest") + own).cast("bigint").alias("values"))


P1_VALUES = r"""WITH l AS (SELECT DISTINCT series, source_file, file_seq, line_no, line FROM complete_patches WHERE regexp_matches(line, '^\s*\{') AND json_valid(line)),
k AS (SELECT *, json_keys(line) AS keys FROM l), o AS (SELECT * FROM k WHERE len(keys) = len(list_distinct(keys)))
SELECT source_file, count(*) AS lines, sum(len(list_filter(keys, lambda x: json_type(line, '$."' || x || '"') <> 'NULL')))::BIGINT AS values FROM o WHERE len(keys) > 0 GROUP BY source_file"""

QUERIES = {"p1_found": p1_found, "p1_unified": p1_unified, "p1_values": p1_values}
ORACLES = {"p1_values": P1_VALUES}
