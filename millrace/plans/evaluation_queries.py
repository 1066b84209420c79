"""Queries that evaluate attempts: rates, breakdowns, categories, progress, and metrics of the tools."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import evaluation
from millrace.operators.distinct import rows_once
from millrace.sources.tables import table


def _entries(spark, sf_dir, *columns):
    """Attempts with repeated rows once."""
    return rows_once(table(spark, sf_dir, "trajectories", "entry_id", *columns), "entry_id")


ENTRIES = "SELECT DISTINCT * FROM trajectories"


def attempt_summary(spark, sf_dir):
    """Per attempt number: entries, resolved ones, rate, tokens, and elapsed seconds of the plausible ones."""
    rows = _entries(spark, sf_dir, "attempt", "resolved", "token_cost", "elapsed_seconds")
    seconds = F.when(F.col("elapsed_seconds") >= 0, F.col("elapsed_seconds"))
    spent = evaluation.map_total(F.col("token_cost"))
    return rows.groupBy("attempt").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("resolved", F.lit(False))).alias("resolved"),
        F.round(F.avg(F.coalesce("resolved", F.lit(False)).cast("int")), 6).alias("rate"),
        F.coalesce(F.sum(spent), F.lit(0)).cast("bigint").alias("tokens"),
        F.round(F.avg(seconds), 4).alias("mean_seconds"),
    )


ATTEMPT_SUMMARY = f"""WITH e AS ({ENTRIES}) SELECT attempt, count(*) AS n, count(*) FILTER (resolved) AS resolved, round(avg(coalesce(resolved, false)::INT), 6) AS rate,
  coalesce(sum(list_sum(map_values(coalesce(token_cost, MAP {{}})))), 0)::BIGINT AS tokens, round(avg(elapsed_seconds) FILTER (elapsed_seconds >= 0), 4) AS mean_seconds FROM e GROUP BY attempt"""


def instance_results(spark, sf_dir):
    """Per instance_id as written: attempts, the first resolved one, the category of the last, and the totals."""
    rows = _entries(spark, sf_dir, "instance_id", "attempt", "resolved", "failure_category").where("trim(instance_id) <> ''")
    order = F.struct("attempt", "entry_id")
    return rows.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.min(F.when(F.col("resolved"), F.col("attempt"))).alias("first_resolved"),
        F.coalesce(F.min(F.when(F.col("resolved"), F.col("attempt"))), F.count(F.lit(1))).cast("bigint").alias("attempts_to_fix"),
        F.max_by("failure_category", order).alias("last_category"),
    )


INSTANCE_RESULTS = f"""WITH e AS ({ENTRIES}) SELECT instance_id, count(*) AS attempts, min(attempt) FILTER (resolved) AS first_resolved,
  coalesce(min(attempt) FILTER (resolved), count(*))::BIGINT AS attempts_to_fix, arg_max_null(failure_category, (attempt, entry_id)) AS last_category FROM e WHERE trim(instance_id) <> '' GROUP BY instance_id"""


def failure_breakdown(spark, sf_dir):
    """How many instances end unresolved with each category of their last attempt, and their share."""
    last = instance_results(spark, sf_dir).where("first_resolved is null")
    counts = last.groupBy(F.lower(F.when(F.trim("last_category") != "", F.trim("last_category")).otherwise("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


FAILURE_BREAKDOWN = f"""WITH i AS ({INSTANCE_RESULTS}), c AS (SELECT coalesce(lower(nullif(trim(last_category), '')), 'unknown') AS category, count(*) AS n
  FROM i WHERE first_resolved IS NULL GROUP BY 1) SELECT category, n, round(n / sum(n) OVER (), 6) AS share FROM c"""


def failure_categories(spark, sf_dir):
    """The category that log, test results and earlier attempts of each attempt speak for, and how often the logged one
    agrees. A patch counts as applied if it isn't blank."""
    rows = _entries(spark, sf_dir, "instance_id", "attempt", "test_stdout", "patch", "fail_to_pass_results", "pass_to_pass_results", "failure_category")
    rows = rows.withColumn("instance_id", F.when(F.trim("instance_id") != "", F.col("instance_id")))
    marked = rows.select("entry_id", "instance_id", "attempt", "failure_category").withColumn("unsteady", evaluation.unsteady("instance_id", ["attempt", "entry_id"], "failure_category")).select("entry_id", "unsteady")
    found = evaluation.failure_category(F.col("test_stdout"), F.trim(F.coalesce("patch", F.lit(""))) != "", F.col("fail_to_pass_results"), F.col("pass_to_pass_results"), F.col("unsteady"))
    return rows.join(marked, "entry_id").groupBy(found.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(found == F.lower("failure_category")).alias("agreeing"))


FAILURE_CATEGORIES = rf"""WITH e AS (SELECT *, cardinality(coalesce(fail_to_pass_results, MAP {{}})) AS f, cardinality(coalesce(pass_to_pass_results, MAP {{}})) AS p,
    len(list_filter(map_values(coalesce(fail_to_pass_results, MAP {{}})), lambda v: v)) AS fp, len(list_filter(map_values(coalesce(pass_to_pass_results, MAP {{}})), lambda v: v)) AS pp,
    coalesce(test_stdout, '') AS s, trim(instance_id) <> '' AND coalesce(min(failure_category) OVER w <> max(failure_category) OVER w, false) AS unsteady
  FROM ({ENTRIES}) WINDOW w AS (PARTITION BY instance_id ORDER BY attempt, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT failure_category, CASE WHEN trim(coalesce(patch, '')) = '' THEN 'syntax_error' WHEN f > 0 AND fp = f AND pp = p THEN 'success'
    WHEN s ILIKE '%SyntaxError%' OR s ILIKE '%IndentationError%' OR s ILIKE '%TabError%' THEN 'syntax_error'
    WHEN s ILIKE '%ImportError%' OR s ILIKE '%ModuleNotFoundError%' OR s ILIKE '%cannot import name%' THEN 'import_error'
    WHEN regexp_matches(s, '(?i)attributeerror: .+ object has no attribute') OR regexp_matches(s, '(?i)typeerror: .+ takes \d+ positional argument') OR regexp_matches(s, '(?i)nameerror: name .+ is not defined') THEN 'hallucinated_api'
    WHEN s ILIKE '%TypeError:%' THEN 'type_error' WHEN s ILIKE '%AssertionError%' THEN 'assertion_error'
    WHEN coalesce(unsteady, false) AND regexp_matches(s, '(?i)resourcewarning|random|race condition|flaky|connection refused|socket\.timeout') THEN 'flaky_test'
    WHEN fp > 0 AND fp < f THEN 'incomplete_patch' WHEN pp < p AND fp = f THEN 'wrong_file_edit' ELSE 'unknown' END AS category FROM e)
SELECT category, count(*) AS n, count(*) FILTER (category = lower(failure_category)) AS agreeing FROM c GROUP BY category"""


def localisation_categories(spark, sf_dir):
    """How the localised files stand to the files of the patch: success, partial_file, wrong_file, or ambiguous_issue
    where none is right and the issue has fewer than ten words."""
    rows = _entries(spark, sf_dir, "patch", "localised_files", "problem_statement")
    gold, found = text.diff_files(F.col("patch")), F.slice(F.coalesce("localised_files", F.array().cast("array<string>")), 1, 5)
    hit = F.size(F.array_intersect(gold, found))
    category = F.when(hit == F.size(gold), "success").when(hit > 0, "partial_file").when(text.word_count(F.col("problem_statement")) < 10, "ambiguous_issue").otherwise("wrong_file")
    return rows.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


LOCALISATION = rf"""WITH e AS ({ENTRIES}), g AS (SELECT list_distinct(regexp_extract_all(coalesce(patch, ''), '(?m)^(?:\+\+\+|---)[ \t]+[ab]/([^\s]+)', 1)) AS gold,
    coalesce(localised_files, [])[1:5] AS found, len(list_filter(string_split_regex(coalesce(problem_statement, ''), '\s+'), lambda w: w <> '')) AS words FROM e),
h AS (SELECT *, len(list_intersect(gold, found)) AS hit FROM g)
SELECT CASE WHEN hit = len(gold) THEN 'success' WHEN hit > 0 THEN 'partial_file' WHEN words < 10 THEN 'ambiguous_issue' ELSE 'wrong_file' END AS category, count(*) AS n FROM h GROUP BY 1"""


def progress(spark, sf_dir):
    """The running resolved rate of each attempt number in order of the entries, at every hundredth entry."""
    rows = table(spark, sf_dir, "trajectories", "entry_id", "attempt", "resolved").where("attempt is not null").distinct()
    return evaluation.running_rate(rows, ["attempt"], "entry_id", F.coalesce("resolved", F.lit(False)), every=100)


PROGRESS = """WITH e AS (SELECT DISTINCT entry_id, attempt, resolved FROM trajectories WHERE attempt IS NOT NULL), r AS (SELECT attempt, entry_id,
  row_number() OVER w AS n, sum(coalesce(resolved, false)::INT) OVER w AS good FROM e WINDOW w AS (PARTITION BY attempt ORDER BY entry_id))
SELECT attempt, entry_id, n, good::BIGINT AS good, round(good / n, 6) AS rate FROM r WHERE n % 100 = 0"""


def progress_all(spark, sf_dir):
    """``progress`` at every entry."""
    rows = table(spark, sf_dir, "trajectories", "entry_id", "attempt", "resolved").where("attempt is not null").distinct()
    return evaluation.running_rate(rows, ["attempt"], "entry_id", F.coalesce("resolved", F.lit(False)))


PROGRESS_ALL = PROGRESS.removesuffix(" WHERE n % 100 = 0")


def tool_calls(spark, sf_dir):
    """Calls, failures, output characters and durations of each tool in any letter case."""
    rows = rows_once(table(spark, sf_dir, "tool_results", "result_id", "tool_name", "success", "output", "metadata"), "result_id")
    ms = F.col("metadata")["duration_ms"].try_cast("bigint")
    return rows.groupBy(F.lower(F.trim("tool_name")).alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.coalesce(F.sum(F.length("output")), F.lit(0)).alias("characters"), F.count(ms).alias("timed"), F.sum(ms).alias("total_ms")
    )


TOOL_CALLS = """WITH t AS (SELECT DISTINCT * FROM tool_results) SELECT lower(trim(tool_name)) AS tool, count(*) AS calls, count(*) FILTER (NOT success) AS failures,
  coalesce(sum(length(output)), 0)::BIGINT AS characters, count(TRY_CAST(metadata['duration_ms'] AS BIGINT)) AS timed, sum(TRY_CAST(metadata['duration_ms'] AS BIGINT))::BIGINT AS total_ms FROM t GROUP BY 1"""


def latency_histogram(spark, sf_dir):
    """Cumulative counts of the elapsed seconds in the buckets of a latency histogram, per attempt number."""
    rows = _entries(spark, sf_dir, "attempt", "elapsed_seconds").where("elapsed_seconds >= 0")
    return evaluation.histogram(rows, ["attempt"], F.col("elapsed_seconds"), evaluation.SECONDS)


LATENCY = f"""WITH e AS (SELECT * FROM ({ENTRIES}) WHERE elapsed_seconds >= 0), b AS (SELECT unnest([{', '.join(map(str, evaluation.SECONDS))}, 'inf'::DOUBLE]) AS le)
SELECT attempt, le, count(*) FILTER (elapsed_seconds <= le) AS n FROM e, b GROUP BY attempt, le"""


def attempt_pairs(spark, sf_dir):
    """Per instance, each attempt with the one before it: seconds between them and whether the category changed."""
    rows = _entries(spark, sf_dir, "instance_id", "attempt", "failure_category", "elapsed_seconds").where("trim(instance_id) <> ''")
    w = Window.partitionBy("instance_id").orderBy("attempt", "entry_id")
    return rows.select(
        "instance_id", "entry_id", F.lag("entry_id").over(w).alias("before"),
        F.round(F.col("elapsed_seconds") - F.lag("elapsed_seconds").over(w), 4).alias("seconds_more"),
        (F.lag("failure_category").over(w) != F.col("failure_category")).alias("changed"),
    ).where("before is not null")


ATTEMPT_PAIRS = f"""WITH e AS ({ENTRIES}), p AS (SELECT instance_id, entry_id, lag(entry_id) OVER w AS before, round(elapsed_seconds - lag(elapsed_seconds) OVER w, 4) AS seconds_more,
  lag(failure_category) OVER w <> failure_category AS changed FROM e WHERE trim(instance_id) <> '' WINDOW w AS (PARTITION BY instance_id ORDER BY attempt, entry_id))
SELECT * FROM p WHERE before IS NOT NULL"""


QUERIES = {
    "attempt_summary": attempt_summary,
    "instance_results": instance_results,
    "failure_breakdown": failure_breakdown,
    "failure_categories": failure_categories,
    "localisation_categories": localisation_categories,
    "progress": progress,
    "progress_all": progress_all,
    "tool_calls": tool_calls,
    "latency_histogram": latency_histogram,
    "attempt_pairs": attempt_pairs,
}
ORACLES = {
    "attempt_summary": ATTEMPT_SUMMARY,
    "instance_results": INSTANCE_RESULTS,
    "failure_breakdown": FAILURE_BREAKDOWN,
    "failure_categories": FAILURE_CATEGORIES,
    "localisation_categories": LOCALISATION,
    "progress": PROGRESS,
    "progress_all": PROGRESS_ALL,
    "tool_calls": TOOL_CALLS,
    "latency_histogram": LATENCY,
    "attempt_pairs": ATTEMPT_PAIRS,
}
