"""Queries that turn logs into training records, and text parsers over patches and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import dataset
from millrace.operators.distinct import rows_once
from millrace.sources.tables import table

ENTRIES = "SELECT DISTINCT * FROM trajectories"
RECORDS = "SELECT DISTINCT * FROM fine_tuning"
WORDS = r"len(list_filter(string_split_regex(coalesce(problem_statement, ''), '\s+'), lambda w: w <> ''))"
REJECTION = f"""CASE WHEN lower(trim(coalesce(failure_category, ''))) IN ('', 'unknown') THEN 'unknown_category' WHEN trim(coalesce(patch, ''), ' ') = '' THEN 'empty_patch'
  WHEN NOT regexp_matches(trim(patch, ' '), '^(?:---|diff )') THEN 'invalid_patch_format' WHEN length(trim(patch, ' ')) > 8000 THEN 'patch_too_long' WHEN {WORDS} < 20 THEN 'problem_too_short' END"""


def _entries(spark, sf_dir, *columns):
    return rows_once(table(spark, sf_dir, "trajectories", "entry_id", *columns), "entry_id")


def _reason():
    return dataset.rejection(F.col("failure_category"), F.col("patch"), F.col("problem_statement"))


def filter_reasons(spark, sf_dir):
    rows = _entries(spark, sf_dir, "failure_category", "patch", "problem_statement")
    return rows.groupBy(F.coalesce(_reason(), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


FILTER_REASONS = f"SELECT coalesce({REJECTION}, 'kept') AS reason, count(*) AS n FROM ({ENTRIES}) GROUP BY 1"


def correction_pairs(spark, sf_dir):
    rows = _entries(spark, sf_dir, "instance_id", "attempt", "resolved", "failure_category", "patch", "problem_statement").where("trim(instance_id) <> ''")
    rows = rows.select("instance_id", "entry_id", "attempt", F.coalesce("resolved", F.lit(False)).alias("resolved"), _reason().isNull().alias("usable"))
    return dataset.correction_pairs(rows, "instance_id", ["attempt", "entry_id"])


CORRECTION_PAIRS = f"""WITH e AS (SELECT *, {REJECTION} IS NULL AS usable FROM ({ENTRIES}) WHERE trim(instance_id) <> ''),
r AS (SELECT instance_id, arg_max(entry_id, (attempt, entry_id)) AS "right", max((attempt, entry_id)) AS place FROM e WHERE resolved GROUP BY instance_id)
SELECT e.instance_id, entry_id AS wrong, "right" FROM e JOIN r USING (instance_id) WHERE NOT coalesce(resolved, false) AND usable AND (attempt, entry_id) < place"""


def train_split(spark, sf_dir):
    rows = _entries(spark, sf_dir, "failure_category", "patch", "problem_statement")
    kept = rows.where(_reason().isNull()).select("entry_id")
    return dataset.hashed_split(kept, "entry_id", 0.1, 42)


TRAIN_SPLIT = f"""WITH k AS (SELECT entry_id FROM ({ENTRIES}) WHERE {REJECTION} IS NULL), r AS (SELECT entry_id, row_number() OVER (ORDER BY sha256('42:' || entry_id), entry_id) AS r, count(*) OVER () AS n FROM k)
SELECT entry_id, CASE WHEN r <= greatest(floor(n * 0.1), 1) THEN 'validation' ELSE 'train' END AS split FROM r"""


def chat_formats(spark, sf_dir):
    """Every record in four formats, by digest, with an estimate of its tokens (four characters each)."""
    rows = rows_once(table(spark, sf_dir, "fine_tuning", "example_id", "messages"), "example_id")
    m = F.col("messages")
    forms = {"chat": dataset.chat_text(m), "instruction": dataset.instruction_json(m), "conversation": dataset.conversation_json(m), "messages": dataset.messages_json(m)}
    return rows.select("example_id", *(F.sha2(f, 256).alias(n) for n, f in forms.items()), F.floor(F.length(forms["chat"]) / 4).cast("bigint").alias("tokens"))


ROLE = "CASE lower(trim(m.role)) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE lower(trim(m.role)) END"
CHAT = "array_to_string([concat('<|im_start|>', " + ROLE + ", chr(10), coalesce(m.content, ''), '<|im_end|>', chr(10)) for m in messages], '')"


def record_roles(spark, sf_dir):
    """Turns, characters and estimated tokens by split and role in any spelling."""
    rows = rows_once(table(spark, sf_dir, "fine_tuning", "example_id", "split", "messages"), "example_id")
    turns = rows.select(F.lower(F.trim("split")).alias("split"), F.explode("messages").alias("m")).select("split", dataset.role_name(F.col("m.role")).alias("role"), F.length("m.content").alias("c"))
    return turns.groupBy("split", "role").agg(F.count(F.lit(1)).alias("turns"), F.coalesce(F.sum("c"), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.floor(F.col("c") / 4)), F.lit(0)).cast("bigint").alias("tokens"))


RECORD_ROLES = f"""WITH t AS (SELECT lower(trim(split)) AS split, unnest(messages) AS m FROM ({RECORDS})), r AS (SELECT split, {ROLE} AS role, length(m.content) AS c FROM t)
SELECT split, role, count(*) AS turns, coalesce(sum(c), 0)::BIGINT AS characters, coalesce(sum(c // 4), 0)::BIGINT AS tokens FROM r GROUP BY split, role"""


def chat_texts(spark, sf_dir):
    rows = rows_once(table(spark, sf_dir, "fine_tuning", "example_id", "messages"), "example_id")
    return rows.select("example_id", F.sha2(dataset.chat_text(F.col("messages")), 256).alias("digest"), F.length(dataset.chat_text(F.col("messages"))).cast("bigint").alias("characters"))


CHAT_TEXTS = f"SELECT example_id, sha256({CHAT}) AS digest, length({CHAT}) AS characters FROM ({RECORDS})"


def patch_stats(spark, sf_dir):
    """Added and removed lines, hunks and files of each patch."""
    rows = _entries(spark, sf_dir, "patch").where("patch <> ''")
    p = F.col("patch")
    return rows.select(
        "entry_id", text.count_lines(p, r"^\+(?!\+\+)").cast("bigint").alias("added"), text.count_lines(p, r"^-(?!--)").cast("bigint").alias("removed"),
        text.count_lines(p, "^@@ ").cast("bigint").alias("hunks"), F.size(text.diff_files(p)).cast("bigint").alias("files"),
    )


def _lines(test: str) -> str:
    return f"len(list_filter(string_split(patch, chr(10)), lambda x: {test}))"


PATCH_STATS = f"""SELECT entry_id, {_lines("x LIKE '+%' AND x NOT LIKE '+++%'")} AS added, {_lines("x LIKE '-%' AND x NOT LIKE '---%'")} AS removed, {_lines("x LIKE '@@ %'")} AS hunks,
  len(list_distinct(regexp_extract_all(patch, '(?m)^(?:\\+\\+\\+|---)[ \\t]+[ab]/([^\\s]+)', 1))) AS files FROM ({ENTRIES}) WHERE patch <> ''"""


def log_results(spark, sf_dir):
    """Tests that each log reports as passed, failed or in error, in the formats of two test runners."""
    rows = _entries(spark, sf_dir, "test_stdout").where("test_stdout <> ''")
    log = F.col("test_stdout")
    counts = {
        **{f"pytest_{v.lower()}": text.pytest_results(log, v) for v in ("PASSED", "FAILED", "ERROR")},
        **{f"unittest_{v.lower()}": text.unittest_results(log, v) for v in ("ok", "FAIL", "ERROR")},
    }
    return rows.select("entry_id", *(F.size(c).cast("bigint").alias(n) for n, c in counts.items()))


LOG_RESULTS = "SELECT entry_id, " + ", ".join(
    [rf"len(regexp_extract_all(test_stdout, '(?m)^(\S+?::[A-Za-z0-9_:\[\]-]+)[ \t]+{v}\b', 1)) AS pytest_{v.lower()}" for v in ("PASSED", "FAILED", "ERROR")]
    + [rf"len(regexp_extract_all(test_stdout, '(?m)^(test_\w+ \([\w.]+\))(?:\n[^\n]+)? \.\.\. {v}\b', 1)) AS unittest_{v.lower()}" for v in ("ok", "FAIL", "ERROR")]
) + f" FROM ({ENTRIES}) WHERE test_stdout <> ''"


def test_outcomes(spark, sf_dir):
    """Tests of the result maps, per attempt number: wanted, passed, and how many names appear in the log."""
    rows = rows_once(table(spark, sf_dir, "trajectories", "entry_id", "attempt", "fail_to_pass_results", "test_stdout"), "entry_id")
    tests = rows.select("attempt", F.explode("fail_to_pass_results").alias("test", "good"), "test_stdout")
    return tests.groupBy("attempt").agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("good")).alias("good"), F.count_if(F.contains("test_stdout", "test")).alias("in_log"))


TEST_OUTCOMES = f"""WITH t AS (SELECT attempt, unnest(map_entries(fail_to_pass_results)) AS x, test_stdout FROM ({ENTRIES}))
SELECT attempt, count(*) AS tests, count(*) FILTER (x.value) AS good, count(*) FILTER (contains(test_stdout, x.key)) AS in_log FROM t GROUP BY attempt"""


def code_mentions(spark, sf_dir):
    """Names of code that documents mention: documents and mentions of each, those in two or more documents."""
    rows = rows_once(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id").where("text is not null")
    names = rows.select("doc_id", F.explode(text.code_names(F.col("text"))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")


CODE_MENTIONS = r"""WITH n AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '`([A-Za-z_][\w.]*)`', 1) || regexp_extract_all(text, '\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b', 1)
  || regexp_extract_all(text, '\b([a-z]+_[a-z0-9_]+)\b', 1) || regexp_extract_all(text, '\b([a-z_]+(?:\.[a-z_]+)+)\b', 1))) AS name FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))
SELECT name, count(*) AS docs FROM n GROUP BY name HAVING count(*) > 1"""


def issue_times(spark, sf_dir):
    """Entries by day of their timestamps, which come in several notations and zones; null for what is no time."""
    rows = table(spark, sf_dir, "trajectories", "entry_id", "timestamp").distinct()
    stamp = F.regexp_replace(F.trim("timestamp"), r"^(\d{4}-\d\d-\d\d)T", "$1 ")
    return rows.groupBy(F.date_format(F.try_to_timestamp(stamp), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def recorded_runs(spark, sf_dir):
    """The readable JSON lines of the hosted runs by resolved: how many have a repository, a patch (a text, or an object with
    one), and their tokens."""
    rows = table(spark, sf_dir, "complete_patches", "series", "source_file", "line_no", "line").distinct()
    field = lambda f: F.get_json_object("line", f"$.{f}")
    good = rows.where(F.col("line").rlike(r"^\s*\{") & F.expr("try_parse_json('[' || line || ']') is not null"))
    return good.groupBy(field("resolved").alias("resolved")).agg(F.count(F.lit(1)).alias("lines"), F.count(field("repo")).alias("with_repo"), F.count_if(F.coalesce(field("patch.patch"), field("patch")) != "").alias("with_patch"), F.sum(F.coalesce(field("tokens").try_cast("bigint"), F.lit(0))).alias("tokens"))


RECORDED_RUNS = r"""WITH l AS (SELECT DISTINCT series, source_file, line_no, line FROM complete_patches WHERE regexp_matches(line, '^\s*\{') AND json_valid(line))
SELECT line ->> '$.resolved' AS resolved, count(*) AS lines, count(line ->> '$.repo') AS with_repo, count(*) FILTER (coalesce(line ->> '$.patch.patch', line ->> '$.patch') <> '') AS with_patch, sum(coalesce(TRY_CAST(line ->> '$.tokens' AS BIGINT), 0))::BIGINT AS tokens FROM l GROUP BY 1"""

FIRST = "coalesce([coalesce(m.content, '') for m in messages if " + ROLE + " = '{0}'][1], '')"
CHAT_FORMATS = f"""SELECT example_id, sha256({CHAT}) AS chat, sha256(json_object('instruction', {FIRST.format("system")}, 'input', {FIRST.format("user")}, 'output', {FIRST.format("assistant")})::VARCHAR) AS instruction,
  sha256(json_object('conversations', [json_object('from', CASE {ROLE} WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE {ROLE} END, 'value', coalesce(m.content, '')) for m in messages])::VARCHAR) AS conversation,
  sha256(json_object('messages', [json_object('role', {ROLE}, 'content', coalesce(m.content, '')) for m in messages])::VARCHAR) AS messages, length({CHAT}) // 4 AS tokens FROM ({RECORDS})"""

QUERIES = {
    "filter_reasons": filter_reasons,
    "correction_pairs": correction_pairs,
    "train_split": train_split,
    "chat_formats": chat_formats,
    "chat_texts": chat_texts,
    "record_roles": record_roles,
    "patch_stats": patch_stats,
    "log_results": log_results,
    "test_outcomes": test_outcomes,
    "code_mentions": code_mentions,
    "issue_times": issue_times,
    "recorded_runs": recorded_runs,
}
ORACLES = {
    "filter_reasons": FILTER_REASONS,
    "correction_pairs": CORRECTION_PAIRS,
    "train_split": TRAIN_SPLIT,
    "chat_formats": CHAT_FORMATS,
    "chat_texts": CHAT_TEXTS,
    "record_roles": RECORD_ROLES,
    "patch_stats": PATCH_STATS,
    "log_results": LOG_RESULTS,
    "test_outcomes": TEST_OUTCOMES,
    "code_mentions": CODE_MENTIONS,
    "recorded_runs": RECORDED_RUNS,
}
