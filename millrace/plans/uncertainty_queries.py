"""Queries on how sure a ranking is: coverage, labels, gates, and calibration by the files of a patch."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import calibration
from millrace.operators.distinct import rows_once
from millrace.plans.calibration_queries import SCORED, _scored
from millrace.session import shared_folder
from millrace.sources import store
from millrace.sources.tables import table

ALPHA, LEAST_CONFIDENCE, CAP, FILE_TOKENS, NAIVE = 0.1, 0.2, 8, 1500, 20


def _sets(spark, sf_dir):
    """The sets of the queries that weren't used for calibration, with ``right`` and ``rank``."""
    rows = _scored(spark, sf_dir)
    return calibration.conformal_sets(rows.where("query % 40 <> 0"), rows.where("query % 40 = 0 and right = 1"), ALPHA)


SETS = f"""{SCORED}, c AS (SELECT s FROM x WHERE query % 40 = 0 AND "right" = 1), m AS (SELECT count(*) AS n FROM c),
o AS (SELECT list_sort(list(s)) AS l, (count(*) - 1) * least(ceil((count(*) + 1) * 0.9) / greatest(count(*), 1), 1) AS pos FROM c),
t AS (SELECT CASE WHEN len(l) = 0 OR l IS NULL THEN 1.0 ELSE l[floor(pos)::INT + 1] + (pos - floor(pos)) * (l[ceil(pos)::INT + 1] - l[floor(pos)::INT + 1]) END AS q FROM o),
st AS (SELECT query, doc, rank, "right", ((SELECT count(*) FROM c WHERE c.s >= x.s) + 1) / (n + 1) AS p, s <= q AS in_set FROM x, m, t WHERE query % 40 <> 0)"""


def coverage(spark, sf_dir):
    """How often the nearest right neighbour is in the set, against what was asked for, and the sets' mean size."""
    found = _sets(spark, sf_dir)
    per = found.groupBy("query").agg(F.count_if("in_set").alias("size"), F.min_by("in_set", F.when(F.col("right") == 1, F.col("rank"))).alias("gold_in"))
    return calibration.coverage(per, F.coalesce("gold_in", F.lit(False)), F.col("size"), ALPHA)


COVERAGE = f"""WITH {SETS}, g AS (SELECT query, count(*) FILTER (in_set) AS size, coalesce(arg_min(in_set, rank) FILTER ("right" = 1), false) AS covered FROM st GROUP BY query)
SELECT count(*) AS n_test, round(avg(covered::INT), 6) AS empirical_coverage, round(avg(size), 6) AS avg_set_size, 0.9::DOUBLE AS coverage_guarantee, round(avg(covered::INT), 6) >= 0.9 AS coverage_satisfied FROM g"""


def uncertainty_labels(spark, sf_dir):
    """Queries by the label that the size of their set has among the candidates."""
    per = _sets(spark, sf_dir).groupBy("query").agg(F.count_if("in_set").alias("size"), F.count(F.lit(1)).alias("candidates"), F.avg(1 - F.col("p_value")).alias("confidence"))
    label = calibration.uncertainty_label(F.col("size"), F.col("candidates"))
    return per.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("queries"), F.sum("size").alias("members"), text.percent(F.avg("confidence")).alias("mean_confidence"))


LABEL = """CASE WHEN size = 0 THEN 'very_uncertain' WHEN size = 1 THEN 'confident' WHEN size <= 3 THEN 'moderate' WHEN size <= candidates // 2 THEN 'uncertain' ELSE 'very_uncertain' END"""
UNCERTAINTY_LABELS = f"""WITH {SETS}, g AS (SELECT query, count(*) FILTER (in_set) AS size, count(*) AS candidates, avg(1 - p) AS c FROM st GROUP BY query)
SELECT {LABEL} AS label, count(*) AS queries, sum(size)::BIGINT AS members, printf('%.1f%%', avg(c) * 100) AS mean_confidence FROM g GROUP BY 1"""


def gated_sets(spark, sf_dir):
    """What of each query's set passes the gate, the tokens that costs, and what is saved; a query without candidates has
    the empty set of a default row."""
    queries = table(spark, sf_dir, "embeddings", "vec_id").where("vec_id % 20 = 0 and vec_id % 40 <> 0").select(F.col("vec_id").alias("query")).distinct()
    found = calibration.gated_sets(_sets(spark, sf_dir), LEAST_CONFIDENCE, CAP, FILE_TOKENS, NAIVE)
    return calibration.with_defaults(queries, found)


GATED = f"""WITH {SETS}, g AS (SELECT *, in_set AND 1 - p >= 0.2 AS ok FROM st), h AS (SELECT *, ok OR (rank = min(rank) OVER w AND count(*) FILTER (ok) OVER w = 0) AS kept FROM g WINDOW w AS (PARTITION BY query)),
k AS (SELECT *, kept AND count(*) FILTER (kept) OVER (PARTITION BY query ORDER BY rank) <= 8 AS within FROM h),
z AS (SELECT query, count(*) FILTER (within) AS files, count(*) FILTER (in_set) AS size, count(*) AS candidates FROM k GROUP BY query)
SELECT q.vec_id AS query, coalesce(files, 0) AS files, coalesce(size, 0) AS set_size, coalesce({LABEL}, 'very_uncertain') AS label, coalesce(files, 0) * 1500 AS tokens,
  CASE WHEN files IS NULL THEN 0 ELSE round(1 - files * 1500 / (20 * 1500), 6) END AS savings FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 40 <> 0) q LEFT JOIN z ON z.query = q.vec_id""".replace("coalesce(CASE", "coalesce(CASE WHEN size IS NULL THEN NULL")


def _gold_scores(spark, sf_dir):
    """(repo, s): for every file of an entry's patch 1 - score, where a localised file scores 1 / (60 + place) and one that
    wasn't localised 0. Entries without localised files are skipped."""
    rows = rows_once(table(spark, sf_dir, "trajectories", "entry_id", "repo", "patch", "localised_files"), "entry_id").where("size(localised_files) > 0")
    gold = rows.select("entry_id", "repo", F.explode(text.diff_files(F.col("patch"))).alias("file"))
    found = rows.select("entry_id", F.posexplode("localised_files").alias("place", "file")).groupBy("entry_id", "file").agg(F.min("place").alias("place"))
    score = F.coalesce(1 / (61 + F.col("place")), F.lit(0.0))
    return gold.join(found, ["entry_id", "file"], "left").select("repo", F.round(1 - score, 6).alias("s"))


GOLD = r"""e AS (SELECT DISTINCT entry_id, repo, patch, localised_files FROM trajectories WHERE len(localised_files) > 0),
g AS (SELECT entry_id, repo, localised_files, unnest(list_distinct(regexp_extract_all(coalesce(patch, ''), '(?m)^(?:\+\+\+|---)[ \t]+[ab]/([^\s]+)', 1))) AS file FROM e),
gs AS (SELECT repo, round(1 - coalesce(1.0::DOUBLE / (60 + list_position(localised_files, file)), 0), 6) AS s FROM g)"""


def gold_calibration(spark, sf_dir):
    """The calibration scores of the patches' files per repository as written, from the store they were kept in."""
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4()}"
    schema = "repo string, s double"
    empty = store.load(spark, path, schema)
    store.save(_gold_scores(spark, sf_dir).unionByName(empty), path)
    found = store.load(spark, path, schema)
    return found.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") == 1).alias("not_localised"), F.round(F.avg("s"), 6).alias("mean"))


GOLD_CALIBRATION = f"WITH {GOLD} SELECT repo, count(*) AS n, count(*) FILTER (s = 1) AS not_localised, round(avg(s), 6) AS mean FROM gs GROUP BY repo"

QUERIES = {"coverage": coverage, "uncertainty_labels": uncertainty_labels, "gated_sets": gated_sets, "gold_calibration": gold_calibration}
ORACLES = {"coverage": COVERAGE, "uncertainty_labels": UNCERTAINTY_LABELS, "gated_sets": GATED, "gold_calibration": GOLD_CALIBRATION}
