"""Queries that build training records: pairs of an issue and a patch, their statistics, gold records, hard negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import dataset, retrieval
from millrace.plans.dataset_queries import ENTRIES, REJECTION, _entries, _reason
from millrace.plans.retrieval_queries import BM25, _files, _index, every_issue, summary
from millrace.session import checkpointed
from millrace.sources.tables import table

COLUMNS = ("instance_id", "attempt", "resolved", "failure_category", "patch", "problem_statement", "test_stdout", "localised_files")


def _pairs(spark, sf_dir):
    rows = _entries(spark, sf_dir, *COLUMNS).withColumn("reason", _reason())
    rows = rows.withColumns({"instance_id": F.when(F.trim("instance_id") != "", F.col("instance_id")), "resolved": F.coalesce("resolved", F.lit(False)), "failure_category": F.lower(F.trim("failure_category"))})
    return dataset.training_pairs(rows)


def training_pairs(spark, sf_dir):
    """All pairs by kind, with a digest of the prompt and the entry whose patch is the answer."""
    return _pairs(spark, sf_dir).select("kind", "entry_id", "answer_id", F.sha2("prompt", 256).alias("digest"), F.length("prompt").cast("bigint").alias("characters"))


ROWS = r"string_split(regexp_replace(coalesce(test_stdout, ''), '\n$', ''), chr(10))"
PAIRS = f"""b AS (SELECT * REPLACE (CASE WHEN trim(instance_id) <> '' THEN instance_id END AS instance_id, coalesce(resolved, false) AS resolved, lower(trim(failure_category)) AS failure_category),
    {REJECTION} AS reason, {ROWS} AS lines FROM ({ENTRIES})),
c AS (SELECT *, list_position([contains(x, 'FAILED') OR contains(x, 'ERROR') OR contains(lower(x), 'assert') for x in lines], true) AS first FROM b),
d AS (SELECT *, array_to_string(CASE WHEN first > 0 THEN lines[greatest(first - 2, 1):first + 19] ELSE lines[greatest(len(lines) - 19, 1):] END, chr(10)) AS context FROM c),
t AS (SELECT *, '## GitHub Issue' || chr(10) || coalesce(problem_statement, '')[1:1000]
    || CASE WHEN len(localised_files) > 0 THEN chr(10) || chr(10) || '## Relevant Files' || chr(10) || array_to_string(['- ' || x for x in localised_files[1:8]], chr(10)) ELSE '' END AS head,
  CASE WHEN coalesce(failure_category, '') <> '' THEN chr(10) || chr(10) || '## Previous Attempt Failed' || chr(10) || 'Failure category: **' || failure_category || '**' || chr(10) || chr(10) || '```' || chr(10)
    || context[1:500] || chr(10) || '```' || chr(10) || chr(10) || 'Previous patch:' || chr(10) || '```diff' || chr(10) || patch[1:800] || chr(10) || '```' ELSE '' END AS failed,
  chr(10) || chr(10) || 'Generate a unified diff patch that fixes the issue.' AS tail FROM d),
fin AS (SELECT instance_id, arg_max(entry_id, (attempt, entry_id)) AS answer_id, arg_max(coalesce(patch, ''), (attempt, entry_id)) AS answer FROM t WHERE resolved AND instance_id IS NOT NULL GROUP BY instance_id),
las AS (SELECT instance_id, max((attempt, entry_id)) AS ende FROM t GROUP BY instance_id),
pr AS (SELECT 'positive' AS kind, entry_id, entry_id AS answer_id, head || tail AS prompt FROM t WHERE reason IS NULL AND resolved
  UNION ALL SELECT 'negative', entry_id, entry_id, head || failed || tail FROM t WHERE reason IS NULL AND NOT resolved AND test_stdout <> ''
  UNION ALL SELECT 'reflection', t.entry_id, answer_id, head || failed || tail FROM t JOIN fin USING (instance_id) JOIN las USING (instance_id)
    WHERE answer <> '' AND NOT resolved AND reason IS NULL AND (attempt, entry_id) < ende)"""
TRAINING_PAIRS = f"WITH {PAIRS} SELECT kind, entry_id, answer_id, sha256(prompt) AS digest, length(prompt) AS characters FROM pr"


def dataset_statistics(spark, sf_dir):
    """The whole build in one row: entries, those kept, pairs of each kind, sizes of both splits, estimated tokens."""
    pairs = checkpointed(_pairs(spark, sf_dir))
    total = table(spark, sf_dir, "trajectories", "entry_id").distinct().agg(F.count(F.lit(1)).alias("total_trajectories"))
    kinds = pairs.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("positive", "negative", "reflection")), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.floor(F.length("prompt") / 4)), F.lit(0)).cast("bigint").alias("tokens"))
    held = F.greatest(F.floor(F.col("n") * 0.1), F.lit(1))
    return total.crossJoin(kinds).select(
        "total_trajectories", F.col("positive").alias("resolved"), F.col("negative").alias("unresolved_with_category"), (F.col("positive") + F.col("negative")).alias("after_filter"),
        F.col("reflection").alias("augmented_pairs"), F.greatest(F.col("n") - held, F.lit(0)).alias("train_size"), F.least(held, F.col("n")).alias("val_size"), "tokens",
    )


DATASET_STATISTICS = f"""WITH {PAIRS}, k AS (SELECT count(*) FILTER (kind = 'positive') AS p, count(*) FILTER (kind = 'negative') AS q, count(*) FILTER (kind = 'reflection') AS r, count(*) AS n, sum(length(prompt) // 4)::BIGINT AS tokens FROM pr)
SELECT (SELECT count(DISTINCT entry_id) FROM trajectories) AS total_trajectories, p AS resolved, q AS unresolved_with_category, p + q AS after_filter, r AS augmented_pairs,
  (n - greatest(floor(n * 0.1), 1))::BIGINT AS train_size, greatest(floor(n * 0.1), 1)::BIGINT AS val_size, tokens FROM k"""


def pair_splits(spark, sf_dir):
    """The pairs in a split of nine tenths and one, by a seeded digest of what they are."""
    rows = _pairs(spark, sf_dir).select(F.concat_ws(":", "kind", "entry_id", "answer_id").alias("pair"))
    return dataset.hashed_split(rows, "pair", 0.1, 42)


PAIR_SPLITS = f"""WITH {PAIRS}, i AS (SELECT kind || ':' || entry_id || ':' || answer_id AS pair FROM pr), r AS (SELECT pair, row_number() OVER (ORDER BY sha256('42:' || pair), pair) AS r, count(*) OVER () AS n FROM i)
SELECT pair, CASE WHEN r <= greatest(floor(n * 0.1), 1) THEN 'validation' ELSE 'train' END AS split FROM r"""


def last_localised(spark, sf_dir):
    """The last non-empty list of localised files that any attempt of an instance has."""
    rows = _entries(spark, sf_dir, "instance_id", "attempt", "localised_files").where("trim(instance_id) <> ''")
    return dataset.last_localised(rows).select("instance_id", F.size("localised_files").cast("bigint").alias("files"), F.sha2(F.array_join("localised_files", "\n"), 256).alias("digest"))


LAST = f"""la AS (SELECT instance_id, arg_max(localised_files, (attempt, entry_id)) AS localised_files FROM ({ENTRIES}) WHERE trim(instance_id) <> '' AND len(localised_files) > 0 GROUP BY instance_id)"""
LAST_LOCALISED = f"WITH {LAST} SELECT instance_id, len(localised_files) AS files, sha256(array_to_string(localised_files, chr(10))) AS digest FROM la"


def gold_records(spark, sf_dir):
    """Chat records whose answer is a resolved patch and whose prompt names the files that were localised last; the split is
    four fifths and one. Resolved entries of instances without localised files are skipped."""
    rows = _entries(spark, sf_dir, "instance_id", "attempt", "resolved", "patch", "problem_statement", "localised_files").where("trim(instance_id) <> ''")
    gold = rows.where("resolved and trim(patch) <> ''").select("entry_id", "instance_id", "patch", "problem_statement")
    both = gold.join(dataset.last_localised(rows), "instance_id")
    prompt = F.concat(F.coalesce("problem_statement", F.lit("")), F.lit("\n\n"), F.array_join(F.transform("localised_files", lambda f: F.concat(F.lit("### "), f)), "\n"))
    turn = lambda role, body: F.concat(F.lit(f"<|im_start|>{role}\n"), body, F.lit("\n<|im_end|>"))
    record = F.concat_ws("\n", turn("user", prompt), turn("assistant", F.trim("patch")))
    return dataset.hashed_split(both.select("entry_id", F.sha2(record, 256).alias("digest")), "entry_id", 0.2, 42)


GOLD_RECORDS = f"""WITH {LAST}, g AS (SELECT entry_id, sha256('<|im_start|>user' || chr(10) || coalesce(problem_statement, '') || chr(10) || chr(10) || array_to_string(['### ' || f for f in la.localised_files], chr(10)) || chr(10) || '<|im_end|>' || chr(10)
    || '<|im_start|>assistant' || chr(10) || trim(patch) || chr(10) || '<|im_end|>') AS digest FROM ({ENTRIES}) e JOIN la USING (instance_id) WHERE resolved AND trim(patch) <> ''),
r AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || entry_id), entry_id) AS r, count(*) OVER () AS n FROM g)
SELECT entry_id, digest, CASE WHEN r <= greatest(floor(n * 0.2), 1) THEN 'validation' ELSE 'train' END AS split FROM r"""


def hard_negatives(spark, sf_dir):
    """For every file that has the name of one in an entry's patch a positive record, and with it those of the five best files
    by the words of the entry's issue that have not; the files' whole summaries by digest."""
    entries = table(spark, sf_dir, "trajectories", "entry_id", "patch")
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    files = _files(spark, sf_dir).where("file_path is not null")
    docs = files.select(F.col("file_id").alias("doc"), name(F.col("file_path")).alias("name"), F.sha2(summary(), 256).alias("digest"))
    wanted = entries.select(F.col("entry_id").alias("query"), F.explode(text.diff_files(F.col("patch"))).alias("path")).select("query", name(F.col("path")).alias("name"))
    issues = every_issue(spark, sf_dir)
    words = issues.select("query", F.flatten(F.transform("texts", text.tokens)).alias("tokens"))
    hits = retrieval.bm25(words, _index(spark, sf_dir), 5).select("query", "doc")
    hits = hits.join(issues.select("query", F.explode("entries.entry_id").alias("entry_id")), "query").select(F.col("entry_id").alias("query"), "doc")
    found = dataset.hard_negatives(wanted, docs, hits)
    return found.select(F.col("query").alias("entry_id"), F.col("gold").alias("gold_id"), F.col("doc").alias("file_id"), F.col("label").cast("bigint").alias("label"), "digest")


def _hard_negatives_sql() -> str:
    from millrace.plans.retrieval_queries import SUMMARY

    return BM25.replace(" WHERE entry_id % 20 = 0", "") + rf""", hd AS (SELECT DISTINCT file_id AS doc, regexp_extract(file_path, '([^/]+)$', 1) AS name, sha256({SUMMARY}) AS digest FROM file_symbols WHERE coalesce(parse_error, '') = '' AND file_path IS NOT NULL),
wa AS (SELECT DISTINCT entry_id, regexp_extract(p, '([^/]+)$', 1) AS name FROM (SELECT entry_id, unnest(regexp_extract_all(coalesce(patch, ''), '(?m)^(?:\+\+\+|---)[ \t]+[ab]/([^\s]+)', 1)) AS p FROM trajectories)),
go AS (SELECT DISTINCT entry_id, doc FROM wa JOIN hd USING (name)), hi AS (SELECT entry_id, doc FROM ranked WHERE rank <= 5 AND score > 0 ANTI JOIN go USING (entry_id, doc)),
al AS (SELECT entry_id, doc AS gold_id, doc, 1 AS label FROM go UNION ALL SELECT entry_id, go.doc, hi.doc, 0 FROM go JOIN hi USING (entry_id))
SELECT entry_id, gold_id, doc AS file_id, label::BIGINT AS label, digest FROM al JOIN hd USING (doc)""".replace("FROM ranked WHERE rank <= 5 AND score > 0 ANTI JOIN go USING (entry_id, doc)", "FROM ranked ANTI JOIN go USING (entry_id, doc) WHERE rank <= 5 AND score > 0")


def exported_pairs(spark, sf_dir):
    """Entries of three categories that have an issue and a patch, as instruction records in JSON, by digest."""
    rows = _entries(spark, sf_dir, *COLUMNS).where("lower(trim(failure_category)) in ('success', 'incomplete_patch', 'assertion_error') and problem_statement <> '' and patch <> ''")
    files = F.array_join(F.transform(F.coalesce("localised_files", F.array().cast("array<string>")), lambda f: F.concat(F.lit("# File: "), f)), "\n\n")
    log = F.coalesce("test_stdout", F.lit(""))
    user = F.concat(
        F.lit("## GitHub Issue\n"), text.word_prefix(F.col("problem_statement"), 800), F.lit("\n\n## Relevant Files\n"), files, F.lit("\n\n## Previous Attempt Failed\nCategory: "), F.col("failure_category"),
        F.lit("\nTest output:\n"), F.substring(log, F.greatest(F.length(log) - 999, F.lit(1)), F.lit(1000)),
    )
    return rows.select("entry_id", F.sha2(F.to_json(F.struct(user.alias("user"), F.col("patch").alias("assistant"))), 256).isNotNull().alias("exported"), F.sha2(user, 256).alias("digest"))


EXPORTED = f"""SELECT entry_id, true AS exported, sha256('## GitHub Issue' || chr(10) || problem_statement[1:800] || chr(10) || chr(10) || '## Relevant Files' || chr(10) || array_to_string(['# File: ' || f for f in coalesce(localised_files, [])], chr(10) || chr(10))
  || chr(10) || chr(10) || '## Previous Attempt Failed' || chr(10) || 'Category: ' || failure_category || chr(10) || 'Test output:' || chr(10) || coalesce(test_stdout, '')[greatest(length(coalesce(test_stdout, '')) - 999, 1):]) AS digest
FROM ({ENTRIES}) WHERE lower(trim(failure_category)) IN ('success', 'incomplete_patch', 'assertion_error') AND problem_statement <> '' AND patch <> ''"""

QUERIES = {
    "training_pairs": training_pairs, "dataset_statistics": dataset_statistics, "pair_splits": pair_splits, "last_localised": last_localised,
    "gold_records": gold_records, "hard_negatives": hard_negatives, "exported_pairs": exported_pairs,
}
ORACLES = {
    "training_pairs": TRAINING_PAIRS, "dataset_statistics": DATASET_STATISTICS, "pair_splits": PAIR_SPLITS, "last_localised": LAST_LOCALISED,
    "gold_records": GOLD_RECORDS, "hard_negatives": _hard_negatives_sql(), "exported_pairs": EXPORTED,
}
