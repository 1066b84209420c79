"""Aggregates over attempts, logs and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the buckets of a latency histogram in seconds.
SECONDS = [1.0, 5.0, 15.0, 30.0, 60.0, 120.0, 300.0]
# What a log says about a failure, the first rule that matches; letter case doesn't count.
LOG_RULES = [
    ("syntax_error", r"SyntaxError|IndentationError|TabError"),
    ("import_error", r"ImportError|ModuleNotFoundError|cannot import name"),
    ("hallucinated_api", r"AttributeError: .+ object has no attribute|TypeError: .+ takes \d+ positional argument|NameError: name .+ is not defined"),
    ("type_error", r"TypeError:"),
    ("assertion_error", r"AssertionError"),
]
FLAKY = r"ResourceWarning|random|race condition|flaky|connection refused|socket\.timeout"
#: Rows of a range over which a running total is carried, about.
ROWS = 100_000


def map_total(values: Column) -> Column:
    """Sum of a map's values; 0 for a null or empty map, null values count nothing."""
    return F.aggregate(F.coalesce(F.map_values(values), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, v: s + F.coalesce(v, F.lit(0)))


def passed(results: Column) -> tuple[Column, Column]:
    """How many tests a map of results has, and how many of them passed; both 0 for a null map."""
    verdicts = F.coalesce(F.map_values(results), F.array().cast("array<boolean>"))
    return F.size(verdicts), F.size(F.filter(verdicts, lambda v: F.coalesce(v, F.lit(False))))


def failure_category(log: Column, applied: Column, fail_to_pass: Column, pass_to_pass: Column, unsteady: Column | None = None) -> Column:
    """Why an attempt failed, by the first rule that holds: the patch didn't apply, all wanted tests passed and no other
    broke, what the log says, a flaky test (only if ``unsteady``, that is if earlier attempts failed in several ways), some
    of the wanted tests passed, all of them passed but others broke; else unknown."""
    (f, fp), (p, pp) = passed(fail_to_pass), passed(pass_to_pass)
    rule = F.when(~applied, "syntax_error").when((f > 0) & (fp == f) & (pp == p), "success")
    for name, pattern in LOG_RULES:
        rule = rule.when(F.coalesce(log, F.lit("")).rlike(f"(?i){pattern}"), name)
    if unsteady is not None:
        rule = rule.when(unsteady & F.coalesce(log, F.lit("")).rlike(f"(?i){FLAKY}"), "flaky_test")
    return rule.when((fp > 0) & (fp < f), "incomplete_patch").when((fp == f) & (pp < p), "wrong_file_edit").otherwise("unknown")


def unsteady(key: str, order: list[str], category: str) -> Column:
    """Whether the attempts of the same ``key`` before this one have two or more different categories: their least and
    greatest differ, so no list of them is held. Attempts without a key have none before them."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.col(key).isNotNull() & F.coalesce(F.min(category).over(before) != F.max(category).over(before), F.lit(False))


def histogram(rows: DataFrame, by: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative histogram (``by``, le, n): values up to each bound, the last bound is infinite. One aggregation with
    a counter per bound; the bounds become rows after it."""
    counts = rows.groupBy(*by).agg(*(F.count_if(value <= b).alias(f"c{i}") for i, b in enumerate(bounds)), F.count(value).alias("c_all"))
    rungs = [F.struct(F.lit(b).alias("le"), F.col(f"c{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(*by, F.explode(F.array(*rungs, F.struct(F.lit(float("inf")).alias("le"), F.col("c_all").alias("n")))).alias("b")).select(*by, "b.le", "b.n")


def running_rate(rows: DataFrame, by: list[str], order: str, good: Column, every: int = 1) -> DataFrame:
    """(``by``, ``order``, n, good, rate): running count, running number of good ones and their share, in the order of a
    whole-number column; only every so-manieth row is given.

    No group is sorted in one task: rows are cut into ranges of the order column that hold about as many rows each,
    at quantiles of it, running totals are carried from range to range, and only ranges are sorted.
    """
    n = rows.count()
    cuts = max(1, -(-n // ROWS))
    shares = [i / cuts for i in range(1, cuts)]
    edges = rows.agg(F.percentile_approx(order, shares, 10 * cuts)).first()[0] if shares else []
    edges = sorted(set(edges or []))
    cut = rows.select(*by, order, good.cast("bigint").alias("_good"))
    bounds = F.array(*(F.lit(e) for e in edges)) if edges else F.array().cast("array<bigint>")
    cut = cut.withColumn("_range", F.size(F.filter(bounds, lambda e: e < F.col(order))))
    sums = cut.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_good").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut.join(sums, [*by, "_range"]).select(*by, order, (F.col("_n0") + F.count(F.lit(1)).over(inside)).alias("n"), (F.col("_s0") + F.sum("_good").over(inside)).alias("good"))
    return run.where(F.col("n") % every == 0).withColumn("rate", F.round(F.col("good") / F.col("n"), 6))
