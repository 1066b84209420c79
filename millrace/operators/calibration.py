"""Calibration of scores: conformal sets, probabilities and their errors.

Nonconformity is s = 1 - score. Values are rounded to six digits, so exact quantiles and ranks need no more than a
million counters however many rows there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of [0, 1] over which counts are carried.
RANGES = 1000


def statistics(scores: DataFrame, by: list[str], value: str) -> DataFrame:
    """(``by``, n, mean, spread, q10, q50, q90) with the population deviation and interpolated quantiles."""
    quantile = lambda q: F.round(F.percentile(F.round(value, 6), F.lit(q)), 6)
    return scores.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("spread"),
        quantile(0.1).alias("q10"), quantile(0.5).alias("q50"), quantile(0.9).alias("q90"),
    )


def threshold(calibration: DataFrame, alpha: float) -> float:
    """The finite-sample quantile at level ceil((n + 1)(1 - alpha)) / n of ``s``; 1 without calibration rows."""
    n = calibration.count()
    if not n:
        return 1.0
    level = min(math.ceil((n + 1) * (1 - alpha)) / n, 1.0)
    return calibration.agg(F.percentile(F.round("s", 6), F.lit(level))).first()[0]


def p_values(scores: DataFrame, calibration: DataFrame) -> DataFrame:
    """``scores`` with ``p_value`` = (calibration rows with s at least as large + 1) / (n + 1).

    The inequality join is a running count: calibration counts per distinct ``s`` are carried down over ranges of s,
    and only within a range rows are sorted.
    """
    n = calibration.count()
    at = F.floor(F.col("s") * RANGES)
    counts = calibration.select(F.round("s", 6).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).withColumn("_r", at)
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows
    ranges = counts.groupBy("_r").agg(F.sum("c").alias("c"))
    used = scores.select(F.floor(F.round("s", 6) * RANGES).alias("_r")).distinct()
    carried = ranges.join(used, "_r", "full").select("_r", F.coalesce(F.sum("c").over(above), F.lit(0)).alias("_more"))
    values = counts.select("s", "_r", "c").unionByName(scores.select(F.round("s", 6).alias("s")).distinct().withColumn("_r", at).withColumn("c", F.lit(0).cast("bigint")))
    values = values.groupBy("_r", "s").agg(F.sum("c").alias("c"))
    within = F.sum("c").over(Window.partitionBy("_r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = values.join(F.broadcast(carried), "_r").select(F.col("s").alias("_s"), ((within + F.col("_more") + 1) / (n + 1)).alias("p_value"))
    return scores.join(known, F.round(scores.s, 6) == F.col("_s")).drop("_s")


def conformal_sets(scores: DataFrame, calibration: DataFrame, alpha: float = 0.1) -> DataFrame:
    """``scores``(query, doc, s) with ``p_value`` and ``in_set``, whether s is within the threshold of the calibration."""
    return p_values(scores, calibration).withColumn("in_set", F.round("s", 6) <= F.lit(threshold(calibration, alpha)))


def regularised_sets(scores: DataFrame, limit: float, k_reg: int = 5, penalty: float = 0.01) -> DataFrame:
    """``scores``(query, doc, score, rank) with ``mass``, the softmax before a document plus a penalty for ranks above
    ``k_reg``, and ``in_set``: within the limit, or the best of a query that would have none."""
    per_query = Window.partitionBy("query")
    order = per_query.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = F.exp(F.col("score") - F.max("score").over(per_query))
    soft = scores.withColumn("_e", e).withColumn("_soft", F.col("_e") / F.sum("_e").over(per_query))
    mass = F.sum("_soft").over(order) - F.col("_soft") + penalty * F.greatest(F.col("rank") - k_reg, F.lit(0))
    found = soft.withColumn("mass", F.round(mass, 6)).withColumn("_in", F.col("mass") <= limit)
    return found.withColumn("in_set", F.col("_in") | ((F.col("rank") == 1) & (F.count_if(F.col("_in")).over(per_query) == 0))).drop("_e", "_soft", "_in")


def calibration_error(rows: DataFrame, probability: Column, label: Column, bins: int = 10) -> DataFrame:
    """One row (n, error): expected calibration error of a two-class probability over bins (lo, hi] of the larger class."""
    top = F.greatest(probability, 1 - probability)
    hit = F.when(F.when(probability > 0.5, 1).otherwise(0) == label, 1.0).otherwise(0.0)
    per_bin = rows.groupBy(F.ceil(top * bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(top).alias("confidence"))
    return per_bin.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n"), 6).alias("error"))


def reliability(rows: DataFrame, probability: Column, label: Column, bins: int = 10) -> DataFrame:
    """(bin, n, positives, mean): bins [lo, hi) of the probability; 1 itself is in none, empty bins are left out."""
    return rows.where(probability < 1).groupBy(F.floor(probability * bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(label.cast("double")), 6).alias("positives"), F.round(F.avg(probability), 6).alias("mean")
    )


def log_loss(margin: Column, label: Column, temperature: float) -> Column:
    p = 1 / (1 + F.exp(-margin / temperature))
    return -F.log(F.when(label == 1, p).otherwise(1 - p) + 1e-8)


def fit_temperature(rows: DataFrame, margin: Column, label: Column, steps: int = 100, rate: float = 0.01, eps: float = 1e-4) -> float:
    """The temperature that gradient descent on the mean log loss reaches; each step is one aggregate of both sides
    of the central difference, over rows that are counted once per distinct margin and label."""
    counts = rows.groupBy(F.round(margin, 3).alias("m"), label.alias("y")).agg(F.count(F.lit(1)).alias("c")).persist()
    t = 1.0
    try:
        for _ in range(steps):
            side = lambda d: F.sum(F.col("c") * log_loss(F.col("m"), F.col("y"), t + d)) / F.sum("c")  # noqa: B023, E731
            up, down = counts.agg(side(eps).alias("u"), side(-eps).alias("d")).first()
            if up is None:
                break
            following = max(0.01, t - rate * (up - down) / (2 * eps))
            if abs(following - t) < 1e-6:
                break
            t = following
    finally:
        counts.unpersist()
    return t


def coverage(rows: DataFrame, covered: Column, size: Column, alpha: float) -> DataFrame:
    """One row (n_test, empirical_coverage, avg_set_size, coverage_guarantee, coverage_satisfied) over one row per query;
    zeros without any."""
    share = F.round(F.coalesce(F.avg(covered.cast("int")), F.lit(0.0)), 6)
    return rows.agg(F.count(F.lit(1)).alias("n_test"), share.alias("empirical_coverage"), F.round(F.coalesce(F.avg(size), F.lit(0.0)), 6).alias("avg_set_size")).select(
        "*", F.lit(round(1 - alpha, 6)).alias("coverage_guarantee"), (F.col("empirical_coverage") >= round(1 - alpha, 6)).alias("coverage_satisfied")
    )


def uncertainty_label(size: Column, candidates: Column) -> Column:
    """How sure a set of this size among so many candidates is; an empty one and one of more than half are not at all."""
    return (
        F.when(size == 0, "very_uncertain").when(size == 1, "confident").when(size <= 3, "moderate")
        .when(size <= F.floor(candidates / 2), "uncertain").otherwise("very_uncertain")
    )


def gated_sets(sets: DataFrame, least: float, cap: int, cost: int, naive: int) -> DataFrame:
    """(query, files, set_size, label, tokens, savings) from ``sets``(query, rank, p_value, in_set).

    A member passes with the confidence 1 - p_value of at least ``least``; a query none of whose members passes keeps
    its best document. At most ``cap`` files stay, the best; each costs ``cost`` tokens, against ``naive`` files without
    a gate. ``set_size`` and ``label`` are those before the gate.
    """
    per = Window.partitionBy("query")
    rows = sets.withColumn("_ok", F.col("in_set") & (1 - F.col("p_value") >= least))
    rows = rows.withColumn("_kept", F.col("_ok") | ((F.col("rank") == F.min("rank").over(per)) & (F.count_if(F.col("_ok")).over(per) == 0)))
    found = rows.groupBy("query").agg(F.count_if("_kept").alias("n"), F.count_if("in_set").alias("set_size"), F.count(F.lit(1)).alias("candidates"))
    files = F.least(F.col("n"), F.lit(cap))
    return found.select(
        "query", files.alias("files"), "set_size", uncertainty_label(F.col("set_size"), F.col("candidates")).alias("label"), (files * cost).alias("tokens"),
        F.round(1 - files * cost / max(naive * cost, 1), 6).alias("savings"),
    )


def with_defaults(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` by gated_sets with a row for each of ``queries``(query) that has none: nothing kept, very uncertain."""
    rows = queries.join(found, "query", "left")
    zero = {"files": 0, "set_size": 0, "tokens": 0, "savings": 0.0, "label": "very_uncertain"}
    return rows.na.fill(zero)
