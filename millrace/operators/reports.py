"""Summaries of runs as tables and texts, the states of a queue, selections and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a find-and-replace block begins, goes on and ends.
BLOCK_MARKS = (r"<<\s*FIND", r"==\s*WITH", r"END\s*>>")


def queue_states(events: DataFrame, key: str, order: list[str], capacity: int) -> DataFrame:
    """``events``(key, op) with running, queued, completed, rejected and utilisation in per cent after each event of its key.

    ``op`` is queued, started or finished. A task is refused while ``capacity`` tasks run. Neither number falls below zero: a
    running sum that may not is the plain sum less its lowest value so far, if that is negative; so the state is two windows
    in one order, without code that steps through the events.
    """
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = lambda total: F.col(total) - F.least(F.lit(0), F.min(total).over(ahead))
    step = F.when(F.col("op") == "started", 1).when(F.col("op") == "finished", -1).otherwise(0)
    rows = events.withColumn("_s", F.sum(step).over(ahead)).withColumn("running", above("_s"))
    was = F.coalesce(F.lag("running").over(Window.partitionBy(key).orderBy(*order)), F.lit(0))
    rows = rows.withColumn("_no", (F.col("op") == "queued") & (was >= capacity))
    change = F.when((F.col("op") == "queued") & ~F.col("_no"), 1).when(F.col("op") == "started", -1).otherwise(0)
    rows = rows.withColumn("_q", F.sum(change).over(ahead)).withColumn("queued", above("_q"))
    counts = {"completed": F.count_if(F.col("op") == "finished").over(ahead), "rejected": F.count_if("_no").over(ahead), "utilisation": F.round(F.col("running") / capacity * 100, 1)}
    return rows.withColumns(counts).drop("_s", "_q", "_no")


def variant_summary(results: DataFrame) -> DataFrame:
    """(variant, n, patched, resolved, rate in per cent, avg_attempts, avg_tokens, recall) of ``results``, one row per run."""
    return results.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("patched").alias("patched"), F.count_if("resolved").alias("resolved"), F.round(F.avg(F.col("resolved").cast("int")) * 100, 2).alias("rate"),
        F.round(F.avg("attempts"), 2).alias("avg_attempts"), F.round(F.avg("tokens")).alias("avg_tokens"), F.round(F.avg("recall"), 6).alias("recall"),
    )


def markdown_table(summary: DataFrame) -> DataFrame:
    """(place, line): ``variant_summary`` as the lines of a table in Markdown, the head at -1 and 0, variants by name."""
    line = F.format_string("| %s | %.2f%% | %.3f | %.2f | %d | %d |", "variant", "rate", "recall", "avg_attempts", F.col("avg_tokens").cast("bigint"), "n")
    rows = summary.select(F.row_number().over(Window.orderBy("variant")).cast("bigint").alias("place"), line.alias("line"))  # one row per variant
    head = [(-1, "| Variant | Resolved | Recall@5 | Attempts | Tokens | N |"), (0, "|---|---|---|---|---|---|")]
    return rows.unionByName(summary.sparkSession.createDataFrame(head, "place bigint, line string"))


def format_score(answer: Column, marks: tuple[str, str, str]) -> Column:
    """A quarter each for the three marks of a block, and for the absence of code fences."""
    parts = [F.when(answer.rlike(m), 0.25).otherwise(0.0) for m in marks] + [F.when(F.contains(answer, F.lit("```")), 0.0).otherwise(0.25)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def against(scores: DataFrame, name: str, base: str, score: str) -> DataFrame:
    """``scores`` with ``delta`` to the row named ``base``, and a verdict: improved by more than .05, marginal, or none."""
    own = scores.where(F.col(name) == base).agg(F.max(score).alias("_base"))
    rows = scores.crossJoin(F.broadcast(own)).withColumn("delta", F.round(F.col(score) - F.col("_base"), 6)).drop("_base")
    return rows.withColumn("verdict", F.when(F.col("delta") > 0.05, "improved").when(F.col("delta") > 0, "marginal").otherwise("none"))


def listings(items: DataFrame, by: str, item: str, most: int) -> DataFrame:
    """(``by``, files, listing): the first ``most`` distinct items in order, and how many more there are. Only those that are
    listed are ever gathered."""
    items = items.select(by, item).distinct()
    first = items.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(item))).where(F.col("_r") <= most)
    shown = first.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("_shown"))
    counts = items.groupBy(by).agg(F.count(F.lit(1)).alias("files"))
    more = F.when(F.col("files") > most, F.concat(F.lit("\n... and "), (F.col("files") - most).cast("string"), F.lit(" more"))).otherwise("")
    both = counts.withColumnRenamed(by, "_by").join(shown, F.col("_by").eqNullSafe(F.col(by)))
    return both.select(F.col("_by").alias(by), "files", F.concat("_shown", more).alias("listing"))


def selected(rows: DataFrame, key: str, ids: DataFrame | None = None, most: int | None = None, skip: int = 0) -> DataFrame:
    """``rows`` whose key is among ``ids``(key) if there are any, in order of the key, without the first ``skip`` and at most
    ``most``. An empty table of ids filters nothing."""
    if ids is not None and not ids.isEmpty():
        rows = rows.join(ids.select(key).distinct(), key, "left_semi")
    rows = rows.orderBy(key).offset(skip)
    return rows.limit(most) if most is not None else rows
