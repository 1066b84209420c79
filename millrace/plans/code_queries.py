"""Queries over source files and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import patches
from millrace.operators.distinct import rows_once
from millrace.sources import code
from millrace.sources.tables import table


def parsed_symbols(spark, sf_dir):
    """Symbols of every Python source, counted."""
    files = rows_once(table(spark, sf_dir, "source_files", "file_id", "file_path", "source"), "file_id").where("source is not null and lower(file_path) rlike '[.]pyi?$'")
    parsed = files.select("file_id", code.python_symbols("source").alias("s"))
    return parsed.select("file_id", (F.col("s.parse_error") == "").alias("parsed"), *(F.size(f"s.{c}").cast("bigint").alias(f"n_{c}") for c in ("imports", "functions", "classes", "calls")))


def hunk_headers(spark, sf_dir):
    """Hunks whose header doesn't declare the lines it has."""
    rows = rows_once(table(spark, sf_dir, "trajectories", "entry_id", "patch"), "entry_id")
    return patches.hunk_counts(rows, "entry_id", "patch").where("declared_old <> old or declared_new <> new")


HUNKS = r"""WITH e AS (SELECT DISTINCT entry_id, string_split(regexp_replace(patch, '\n$', ''), chr(10)) AS l FROM trajectories WHERE patch <> ''),
x AS (SELECT entry_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM e),
h AS (SELECT *, regexp_matches(line, '^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@.*$') AS head FROM x),
n AS (SELECT *, sum(head::INT) OVER (PARTITION BY entry_id ORDER BY place) AS hunk,
  NOT head AND line NOT LIKE '\%' AND NOT regexp_matches(line, '^(?:diff --git |index |--- |\+\+\+ )') AS body FROM h),
g AS (SELECT entry_id, hunk::BIGINT AS hunk, max(line) FILTER (head) AS t, count(*) FILTER (body AND line NOT LIKE '+%') AS old, count(*) FILTER (body AND line NOT LIKE '-%') AS new FROM n WHERE hunk > 0 GROUP BY 1, 2),
d AS (SELECT entry_id, hunk, coalesce(TRY_CAST(nullif(regexp_extract(t, '^@@ -\d+(?:,(\d+))?', 1), '') AS BIGINT), 1) AS declared_old,
  coalesce(TRY_CAST(nullif(regexp_extract(t, '^@@ -\d+(?:,\d+)? \+\d+(?:,(\d+))? @@', 1), '') AS BIGINT), 1) AS declared_new, old, new FROM g)
SELECT * FROM d WHERE declared_old <> old OR declared_new <> new"""


def repaired_patches(spark, sf_dir):
    rows = rows_once(table(spark, sf_dir, "trajectories", "entry_id", "patch"), "entry_id")
    return patches.repaired(rows, "entry_id", "patch").select("entry_id", F.sha2("patch", 256).alias("digest"))


REPAIRED = r"""WITH e AS (SELECT DISTINCT entry_id, string_split(regexp_replace(patch, '\n$', ''), chr(10)) AS l FROM trajectories WHERE patch <> ''),
x AS (SELECT entry_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM e),
h AS (SELECT *, regexp_matches(line, '^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@.*$') AS head FROM x),
n AS (SELECT *, sum(head::INT) OVER (PARTITION BY entry_id ORDER BY place) AS hunk, NOT head AND line NOT LIKE '\%' AND NOT regexp_matches(line, '^(?:diff --git |index |--- |\+\+\+ )') AS body FROM h),
g AS (SELECT *, count(*) FILTER (body AND line NOT LIKE '+%') OVER w AS o, count(*) FILTER (body AND line NOT LIKE '-%') OVER w AS p FROM n WINDOW w AS (PARTITION BY entry_id, hunk)),
f AS (SELECT entry_id, place, CASE WHEN head THEN regexp_replace(line, '^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@(.*)$', '@@ -\1' || CASE WHEN o = 1 THEN '' ELSE ',' || o END || ' +\2' || CASE WHEN p = 1 THEN '' ELSE ',' || p END || ' @@\3') ELSE line END AS line FROM g)
SELECT entry_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest FROM f GROUP BY entry_id"""


def file_hashes(spark, sf_dir):
    """Sources whose recorded hash is no longer theirs."""
    files = rows_once(table(spark, sf_dir, "source_files", "file_id", "source"), "file_id").where("source is not null")
    known = table(spark, sf_dir, "file_symbols", "file_id", "file_hash").distinct()
    return files.select("file_id", F.sha2("source", 256).alias("digest")).join(known, "file_id").select("file_id", (F.col("digest") == F.col("file_hash")).alias("same"))


FILE_HASHES = """WITH s AS (SELECT DISTINCT file_id, sha256(source) AS digest FROM source_files WHERE source IS NOT NULL), k AS (SELECT DISTINCT file_id, file_hash FROM file_symbols)
SELECT file_id, digest = file_hash AS same FROM s JOIN k USING (file_id)"""

QUERIES = {"parsed_symbols": parsed_symbols, "hunk_headers": hunk_headers, "repaired_patches": repaired_patches, "file_hashes": file_hashes}
ORACLES = {"hunk_headers": HUNKS, "repaired_patches": REPAIRED, "file_hashes": FILE_HASHES}
