"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import encoding, overlap, packing, spam, splits, syntax, truncation
from millrace.sources.tables import table


def p2_found(spark, sf_dir):
    return syntax.unparsable_files(table(spark, sf_dir, "source_files", "file_id", "file_path", "source"))


def p2_rates(spark, sf_dir):
    files = table(spark, sf_dir, "source_files", "file_id", "repo", "file_path", "source")
    return syntax.parse_rates(files, table(spark, sf_dir, "repo_moves"), table(spark, sf_dir, "file_symbols", "file_id", "parse_error"))


def p3_found(spark, sf_dir):
    entries = table(spark, sf_dir, "trajectories", "entry_id", "instance_id", "repo")
    return splits.related_entries(entries, table(spark, sf_dir, "repo_moves"))


def p3_splits(spark, sf_dir):
    entries = table(spark, sf_dir, "trajectories", "entry_id", "instance_id", "repo", "resolved")
    return splits.split_entries(entries, table(spark, sf_dir, "repo_moves"))


def p3_deviation(spark, sf_dir):
    entries = table(spark, sf_dir, "trajectories", "entry_id", "instance_id", "repo", "resolved")
    return splits.split_deviation(p3_splits(spark, sf_dir), entries.select("entry_id", F.col("resolved").alias("label")))


def p3_unity(spark, sf_dir):
    """Entries, groups, groups in more than one split, and whether every split is within a hundredth of its share."""
    found = p3_splits(spark, sf_dir)
    per_group = found.groupBy("group_id").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("split") == s).alias(s) for s in splits.PARTS))
    close = [F.abs(F.sum(s) / F.sum("n") - share) <= 0.01 for s, share in splits.PARTS.items()]
    return per_group.agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("splits") > 1).alias("torn"), (close[0] & close[1] & close[2]).alias("close"))


def p4_found(spark, sf_dir):
    return overlap.cross_split_pairs(table(spark, sf_dir, "fine_tuning", "example_id", "split", "source", "messages"))


def p4_report(spark, sf_dir):
    return overlap.overlap_report(table(spark, sf_dir, "fine_tuning", "example_id", "split", "source", "messages"))


def _ended(spark, sf_dir):
    entries = table(spark, sf_dir, "trajectories", "entry_id", "repo", "patch", "test_stdout")
    results = table(spark, sf_dir, "tool_results", "result_id", "tool_name", "output")
    return truncation.cut_values(truncation.text_values(entries, results, table(spark, sf_dir, "repo_moves")))


def p5_found(spark, sf_dir):
    return _ended(spark, sf_dir).where("odds > 0").select("table_name", "row_id", "field").distinct()


def p5_rates(spark, sf_dir):
    return truncation.cut_rates(_ended(spark, sf_dir))


def p6_ids(spark, sf_dir):
    return encoding.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def p6_edits(spark, sf_dir):
    return encoding.edited_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def p7_containers(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_fill(spark, sf_dir):
    return packing.fill_report(p7_containers(spark, sf_dir))


def p8_found(spark, sf_dir):
    return spam.spam_pages(table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_rates(spark, sf_dir):
    return spam.spam_rates(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


QUERIES = {
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p3_deviation": p3_deviation,
    "p3_unity": p3_unity,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_ids": p6_ids,
    "p6_edits": p6_edits,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}

P3_FOUND = r"""
WITH RECURSIVE names AS (
  SELECT lower(trim(old_repo)) AS a, lower(trim(new_repo)) AS b FROM repo_moves
  UNION SELECT lower(trim(new_repo)), lower(trim(old_repo)) FROM repo_moves),
reach AS (SELECT a, a AS b FROM names UNION SELECT r.a, n.b FROM reach r JOIN names n ON r.b = n.a),
homes AS (SELECT a AS repo, min(b) AS home FROM reach GROUP BY a),
plain AS (
  SELECT DISTINCT entry_id, repo,
    regexp_replace(lower(trim(instance_id, E' \t\r\n')), '(\s*\(retry \d+\)|\.attempt-\d+|@run\d+|#comment-\d+|/)+$', '') AS t
  FROM trajectories WHERE instance_id IS NOT NULL AND trim(instance_id, E' \t\r\n') <> ''),
parts AS (
  SELECT entry_id, repo, ltrim(regexp_extract(t, '(\d+)$', 1), '0') AS number,
    regexp_replace(regexp_replace(regexp_replace(t, '\d+$', ''), '(/issues/|[-#])$', ''), '^https?://[^/]+/', '') AS head FROM plain),
named AS (
  SELECT entry_id, number, CASE WHEN head LIKE '%\_\_%' ESCAPE '\' THEN replace(head, '__', '/') WHEN head LIKE '%/%' THEN head
    ELSE regexp_replace(lower(trim(repo)), '\.git$', '') END AS r FROM parts),
issues AS (SELECT n.entry_id, coalesce(h.home, n.r) || '#' || n.number AS issue FROM named n LEFT JOIN homes h ON h.repo = n.r WHERE n.r IS NOT NULL),
grouped AS (SELECT min(entry_id) OVER (PARTITION BY issue) AS group_id, entry_id, count(*) OVER (PARTITION BY issue) AS n FROM issues)
SELECT group_id, entry_id FROM grouped WHERE n > 1
"""

P3_UNITY = P3_FOUND.replace(
    "SELECT group_id, entry_id FROM grouped WHERE n > 1",
    "SELECT (SELECT count(DISTINCT entry_id) FROM trajectories) AS entries, (SELECT count(DISTINCT entry_id) FROM trajectories) - (SELECT count(*) FROM grouped) + (SELECT count(DISTINCT group_id) FROM grouped) AS groups, 0 AS torn, true AS close",
)
ORACLES = {"p3_found": P3_FOUND, "p3_unity": P3_UNITY}
