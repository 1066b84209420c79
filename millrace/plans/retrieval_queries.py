"""Queries of ranking: issues against source files, and vectors against vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import retrieval
from millrace.operators.distinct import rows_once
from millrace.session import written
from millrace.sources.tables import table


def summary(prefix: str = ""):
    """The text of a file's symbols: docstrings and names of module, functions, classes, methods and imports."""
    f = F.coalesce("functions", F.array().cast("array<struct<name:string,qualified_name:string,args:array<string>,decorators:array<string>,docstring:string,start_line:int,end_line:int,is_async:boolean,is_method:boolean>>"))
    c = F.coalesce("classes", F.array().cast("array<struct<name:string,bases:array<string>,methods:array<string>,docstring:string,start_line:int,end_line:int>>"))
    i = F.coalesce("imports", F.array().cast("array<struct<module:string,names:array<string>,is_from:boolean,alias:string>>"))
    return F.concat_ws(
        " ",
        F.col("module_docstring"),
        F.array_join(F.transform(f, lambda x: F.concat_ws(" ", x["name"], x["docstring"])), " "),
        F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["name"], x["docstring"], F.array_join(x["methods"], " "))), " "),
        F.array_join(F.transform(i, lambda x: F.concat_ws(" ", x["module"], F.array_join(x["names"], " "))), " "),
    )


def _files(spark, sf_dir):
    rows = rows_once(table(spark, sf_dir, "file_symbols", "file_id", "file_path", "parse_error", "module_docstring", "functions", "classes", "imports"), "file_id")
    return rows.where("coalesce(parse_error, '') = ''")


def _issues(spark, sf_dir):
    """The stated query set: every entry whose id is divisible by 20."""
    rows = table(spark, sf_dir, "trajectories", "entry_id", "problem_statement").where("entry_id % 20 = 0").distinct()
    return rows.select(F.col("entry_id").alias("query"), text.tokens(F.col("problem_statement")).alias("tokens"))


def every_issue(spark, sf_dir):
    """The texts of all entries, equal ones once: (query, texts, entries), a number, the distinct texts of an entry, and the
    entries that have just these."""
    own = table(spark, sf_dir, "trajectories", "entry_id", "problem_statement").groupBy("entry_id").agg(F.array_sort(F.collect_set("problem_statement")).alias("texts"))
    return written(own.groupBy("texts").agg(F.collect_list(F.struct("entry_id")).alias("entries")).withColumn("query", F.monotonically_increasing_id()))


def _index(spark, sf_dir):
    path = text.path_tokens(F.col("file_path"))
    docs = _files(spark, sf_dir).select(F.col("file_id").alias("doc"), F.concat(path, path, text.tokens(summary())).alias("tokens"))
    return retrieval.bm25_index(docs)


def bm25_top20(spark, sf_dir):
    found = retrieval.bm25(_issues(spark, sf_dir), _index(spark, sf_dir), 20)
    return found.select(F.col("query").alias("entry_id"), F.col("doc").alias("file_id"), F.col("rank").cast("bigint").alias("rank"))


TOKENS = "list_filter(string_split_regex(lower(regexp_replace(coalesce({0}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 2)"
JOINED = "array_to_string(list_filter([{0}], lambda v: v IS NOT NULL), ' ')"
SUMMARY = JOINED.format(
    "module_docstring, array_to_string([" + JOINED.format("x.name, x.docstring") + " for x in coalesce(functions, [])], ' '), array_to_string(["
    + JOINED.format("x.name, x.docstring, array_to_string(coalesce(x.methods, []), ' ')") + " for x in coalesce(classes, [])], ' '), array_to_string(["
    + JOINED.format("x.module, array_to_string(coalesce(x.names, []), ' ')") + " for x in coalesce(imports, [])], ' ')"
)
FILES = f"""files AS (
  SELECT DISTINCT file_id, file_path, {TOKENS.format("translate(file_path, '/_.', '   ')")} AS p, {TOKENS.format(SUMMARY)} AS s
  FROM file_symbols WHERE coalesce(parse_error, '') = '')"""
BM25 = f"""WITH {FILES},
docs AS (SELECT file_id AS doc, p || p || s AS t FROM files WHERE len(p || p || s) > 0),
sizes AS (SELECT count(*) AS n, avg(len(t)) AS al FROM docs),
tf AS (SELECT doc, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc, len(t) AS l, unnest(t) AS term FROM docs) GROUP BY doc, term),
raw AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, sizes GROUP BY term),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT entry_id, term, count(*) AS times FROM (SELECT entry_id, unnest({TOKENS.format('problem_statement')}) AS term
  FROM (SELECT DISTINCT entry_id, problem_statement FROM trajectories WHERE entry_id % 20 = 0)) GROUP BY entry_id, term),
scores AS (SELECT entry_id, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term), sizes GROUP BY entry_id, doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, doc) AS rank FROM scores)"""


def dense_top20(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = retrieval.dense_top(vectors.where("id % 20 = 0"), vectors, 20)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), F.col("score"), F.col("rank").cast("bigint").alias("rank"))


DENSE = """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 20"""


def rrf_fused(spark, sf_dir):
    """Issues against files by all words and by the words of the path alone, fused; weights .7 and .3."""
    issues = _issues(spark, sf_dir)
    whole = retrieval.bm25(issues, _index(spark, sf_dir), 20)
    paths = _files(spark, sf_dir).select(F.col("file_id").alias("doc"), text.path_tokens(F.col("file_path")).alias("tokens"))
    by_path = retrieval.bm25(issues, retrieval.bm25_index(paths), 20)
    fused = retrieval.fuse({"text": (whole, 0.7), "path": (by_path, 0.3)}, 10)
    return fused.select(F.col("query").alias("entry_id"), F.col("doc").alias("file_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), F.col("text_rank").cast("bigint").alias("text_rank"), F.col("path_rank").cast("bigint").alias("path_rank"))


RRF = BM25 + f""",
pdocs AS (SELECT file_id AS doc, p AS t FROM files WHERE len(p) > 0),
psizes AS (SELECT count(*) AS n, avg(len(t)) AS al FROM pdocs),
ptf AS (SELECT doc, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc, len(t) AS l, unnest(t) AS term FROM pdocs) GROUP BY doc, term),
praw AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM ptf, psizes GROUP BY term),
pidf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM praw) ELSE idf END AS idf FROM praw),
pscores AS (SELECT entry_id, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) AS score
  FROM q JOIN ptf USING (term) JOIN pidf USING (term), psizes GROUP BY entry_id, doc),
pranked AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, doc) AS rank FROM pscores),
a AS (SELECT entry_id, doc, rank FROM ranked WHERE rank <= 20 AND score > 0),
b AS (SELECT entry_id, doc, rank FROM pranked WHERE rank <= 20 AND score > 0),
f AS (SELECT coalesce(a.entry_id, b.entry_id) AS entry_id, coalesce(a.doc, b.doc) AS file_id, a.rank AS text_rank, b.rank AS path_rank,
  round(coalesce(0.7 / (60 + a.rank), 0) + coalesce(0.3 / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b ON a.entry_id = b.entry_id AND a.doc = b.doc),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, file_id) AS rank FROM f)
SELECT entry_id, file_id, round(score, 6) AS score, rank, text_rank, path_rank FROM r WHERE rank <= 10"""


def recall_at_k(spark, sf_dir):
    """Localised files against the files of the patch, per attempt number: mean recall and hit rate at 1, 3 and 5."""
    rows = rows_once(table(spark, sf_dir, "trajectories", "entry_id", "attempt", "patch", "localised_files"), "entry_id")
    gold, found = text.diff_files(F.col("patch")), F.coalesce("localised_files", F.array().cast("array<string>"))
    rows = rows.withColumns({"gold": gold, "found": F.array_distinct(found)}).where(F.size("gold") > 0)
    parts = {k: retrieval.recall(F.col("found"), F.col("gold"), k) for k in (1, 3, 5)}
    return rows.groupBy("attempt").agg(
        F.count(F.lit(1)).alias("n"), *(F.round(F.avg(s), 6).alias(f"recall_{k}") for k, (s, _) in parts.items()), *(F.round(F.avg(h), 6).alias(f"hit_{k}") for k, (_, h) in parts.items())
    )


GOLD = r"list_distinct(regexp_extract_all(coalesce(patch, ''), '(?m)^(?:\+\+\+|---)[ \t]+[ab]/([^\s]+)', 1))"
RECALL = f"""WITH e AS (SELECT DISTINCT entry_id, attempt, {GOLD} AS gold,
  [x for x, i in coalesce(localised_files, []) if list_position(localised_files, x) = i] AS found FROM trajectories),
g AS (SELECT attempt, gold, found FROM e WHERE len(gold) > 0)
SELECT attempt, count(*) AS n,
  """ + ", ".join(f"round(avg(len(list_intersect(found[1:{k}], gold)) / len(gold)), 6) AS recall_{k}, round(avg((len(list_intersect(found[1:{k}], gold)) > 0)::INT), 6) AS hit_{k}" for k in (1, 3, 5)) + " FROM g GROUP BY attempt"


def name_hits(spark, sf_dir):
    """Files that issues mention by a name of code: 3 for the file's stem, 1 for a part of its path; the best five."""
    hints = table(spark, sf_dir, "trajectories", "entry_id", "problem_statement").where("entry_id % 20 = 0").distinct()
    parts = hints.select("entry_id", F.explode(F.array_distinct(F.flatten(F.transform(text.code_names(F.col("problem_statement")), lambda n: F.split(F.lower(n), r"[^a-z0-9]+"))))).alias("part")).where(F.length("part") > 2)
    files = rows_once(table(spark, sf_dir, "file_symbols", "file_id", "file_path"), "file_id")
    stem = F.regexp_extract(F.lower("file_path"), r"([^/]+?)\.[a-z]+$", 1)
    keys = files.select("file_id", F.explode(F.array_distinct(F.split(F.lower("file_path"), "[^a-z0-9]+"))).alias("part"), stem.alias("stem"))
    points = parts.join(keys, "part").groupBy("entry_id", "file_id").agg(F.sum(F.when(F.col("stem") == F.col("part"), 3).otherwise(1)).alias("score"))
    return retrieval.top(points, 5, "entry_id", "file_id").select("entry_id", "file_id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


NAME_HITS = r"""WITH h AS (SELECT DISTINCT entry_id, coalesce(problem_statement, '') AS t FROM trajectories WHERE entry_id % 20 = 0),
n AS (SELECT entry_id, unnest(regexp_extract_all(t, '`([A-Za-z_][\w.]*)`', 1) || regexp_extract_all(t, '\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b', 1)
  || regexp_extract_all(t, '\b([a-z]+_[a-z0-9_]+)\b', 1) || regexp_extract_all(t, '\b([a-z_]+(?:\.[a-z_]+)+)\b', 1)) AS name FROM h),
p AS (SELECT DISTINCT entry_id, part FROM (SELECT entry_id, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS part FROM n) WHERE length(part) > 2),
f AS (SELECT DISTINCT file_id, lower(file_path) AS path FROM file_symbols),
k AS (SELECT DISTINCT file_id, unnest(string_split_regex(path, '[^a-z0-9]+')) AS part, regexp_extract(path, '([^/]+?)\.[a-z]+$', 1) AS stem FROM f),
s AS (SELECT entry_id, file_id, sum(CASE WHEN stem = part THEN 3 ELSE 1 END)::BIGINT AS score FROM p JOIN k USING (part) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, file_id) AS rank FROM s)
SELECT entry_id, file_id, score, rank FROM r WHERE rank <= 5"""

QUERIES = {"bm25_top20": bm25_top20, "dense_top20": dense_top20, "rrf_fused": rrf_fused, "recall_at_k": recall_at_k, "name_hits": name_hits}
ORACLES = {
    "bm25_top20": BM25 + " SELECT entry_id, doc AS file_id, rank FROM ranked WHERE rank <= 20 AND score > 0",
    "dense_top20": DENSE,
    "rrf_fused": RRF,
    "recall_at_k": RECALL,
    "name_hits": NAME_HITS,
}
