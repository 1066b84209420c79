"""Queries that calibrate the scores of vector search: a neighbour is right if it has the query's label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import calibration
from millrace.plans.retrieval_queries import DENSE, dense_top20
from millrace.session import checkpointed
from millrace.sources.tables import table


def _scored(spark, sf_dir):
    """(query, doc, score, rank, p, s, right, margin) of the neighbours, without the query itself."""
    labels = table(spark, sf_dir, "embeddings", "vec_id", "label")
    found = dense_top20(spark, sf_dir).where("query_id <> vec_id")
    both = found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    p = F.round((F.col("score") + 1) / 2, 6)
    rows = both.select(F.col("query_id").alias("query"), F.col("vec_id").alias("doc"), "score", F.col("rank").cast("int").alias("rank"), p.alias("p"), F.round(1 - p, 6).alias("s"), (F.col("label") == F.col("own")).cast("int").alias("right"))
    return checkpointed(rows.withColumn("margin", F.col("score") * 4))


SCORED = f"""n AS ({DENSE}), x AS (SELECT query_id AS query, n.vec_id AS doc, score, rank, round((score + 1) / 2, 6) AS p, round(1 - round((score + 1) / 2, 6), 6) AS s, (a.label = b.label)::INT AS "right"
  FROM n JOIN embeddings a ON a.vec_id = n.vec_id JOIN embeddings b ON b.vec_id = query_id WHERE query_id <> n.vec_id)"""


def score_statistics(spark, sf_dir):
    return calibration.statistics(_scored(spark, sf_dir), ["right"], "s")


STATISTICS = f"""WITH {SCORED} SELECT "right", count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS spread, round(quantile_cont(s, 0.1), 6) AS q10,
  round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.9), 6) AS q90 FROM x GROUP BY "right\""""


def conformal(spark, sf_dir):
    """p-values and sets of every neighbour, calibrated on the right ones of every second query."""
    rows = _scored(spark, sf_dir)
    found = calibration.conformal_sets(rows.where("query % 40 <> 0"), rows.where("query % 40 = 0 and right = 1"), 0.1)
    return found.select("query", "doc", F.round("p_value", 6).alias("p_value"), "in_set")


CONFORMAL = f"""WITH {SCORED}, c AS (SELECT s FROM x WHERE query % 40 = 0 AND "right" = 1), m AS (SELECT count(*) AS n FROM c),
o AS (SELECT list_sort(list(s)) AS l, (count(*) - 1) * least(ceil((count(*) + 1) * 0.9) / greatest(count(*), 1), 1) AS pos FROM c),
t AS (SELECT CASE WHEN len(l) = 0 OR l IS NULL THEN 1.0 ELSE l[floor(pos)::INT + 1] + (pos - floor(pos)) * (l[ceil(pos)::INT + 1] - l[floor(pos)::INT + 1]) END AS q FROM o)
SELECT query, doc, round(((SELECT count(*) FROM c WHERE c.s >= x.s) + 1) / (n + 1), 6) AS p_value, s <= q AS in_set FROM x, m, t WHERE query % 40 <> 0"""


def regularised(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("query", "doc", "score", F.row_number().over(_by_rank()).alias("rank"))
    found = calibration.regularised_sets(rows, 0.3)
    return found.groupBy("query").agg(F.count_if("in_set").alias("members"), F.round(F.max(F.when(F.col("in_set"), F.col("mass"))), 4).alias("reached"))


def _by_rank():
    return Window.partitionBy("query").orderBy("rank")


REGULARISED = f"""WITH {SCORED}, r AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM x),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query)) AS e FROM r), f AS (SELECT *, e / sum(e) OVER (PARTITION BY query) AS soft FROM e),
m AS (SELECT query, rank, round(sum(soft) OVER (PARTITION BY query ORDER BY rank) - soft + 0.01 * greatest(rank - 5, 0), 6) AS mass FROM f),
i AS (SELECT *, mass <= 0.3 OR (rank = 1 AND count(*) FILTER (mass <= 0.3) OVER (PARTITION BY query) = 0) AS in_set FROM m)
SELECT query, count(*) FILTER (in_set) AS members, round(max(mass) FILTER (in_set), 4) AS reached FROM i GROUP BY query"""


def calibration_error(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return calibration.calibration_error(rows, F.col("p"), F.col("right"))


ERROR = f"""WITH {SCORED}, b AS (SELECT ceil(greatest(p, 1 - p) * 10) AS bin, greatest(p, 1 - p) AS t, ((p > 0.5)::INT = "right")::INT AS hit FROM x),
g AS (SELECT bin, count(*) AS n, avg(hit) AS a, avg(t) AS c FROM b GROUP BY bin) SELECT sum(n)::BIGINT AS n, round(sum(n * abs(a - c)) / sum(n), 6) AS error FROM g"""


def reliability(spark, sf_dir):
    return calibration.reliability(_scored(spark, sf_dir), F.col("p"), F.col("right"))


RELIABILITY = f"""WITH {SCORED} SELECT floor(p * 10)::BIGINT AS bin, count(*) AS n, round(avg("right"), 6) AS positives, round(avg(p), 6) AS mean FROM x WHERE p < 1 GROUP BY 1"""


def temperature(spark, sf_dir):
    """Log loss of the neighbours before and after fitting a temperature, and the loss's slope at one."""
    rows = _scored(spark, sf_dir)
    margin, label = F.col("margin"), F.col("right")
    fitted = calibration.fit_temperature(rows, margin, label, steps=30, rate=0.5)
    loss = lambda t: F.avg(calibration.log_loss(margin, label, t))
    return rows.agg(F.round(F.lit(fitted), 4).alias("temperature"), F.round(loss(1.0), 6).alias("loss"), F.round(loss(fitted), 6).alias("fitted_loss"), F.round((loss(1.0001) - loss(0.9999)) / 2e-4, 4).alias("slope"))


QUERIES = {
    "score_statistics": score_statistics,
    "conformal": conformal,
    "regularised": regularised,
    "calibration_error": calibration_error,
    "reliability": reliability,
    "temperature": temperature,
}
ORACLES = {"score_statistics": STATISTICS, "conformal": CONFORMAL, "regularised": REGULARISED, "calibration_error": ERROR, "reliability": RELIABILITY}
