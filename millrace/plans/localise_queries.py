"""Queries that find the files an issue speaks of: by words, by the graph of modules, by names, and all of it fused."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import graph, keywords, retrieval
from millrace.operators.distinct import rows_once
from millrace.plans.graph_queries import LINKED, _linked
from millrace.plans.retrieval_queries import BM25, _files, _index, _issues, every_issue, summary
from millrace.session import checkpointed
from millrace.sources.tables import table

#: Weights of the three rankings, and sizes of the lists.
WEIGHTS = {"bm25": 0.4, "embed": 0.4, "ppr": 0.2}
CANDIDATES, SEEDS, BEST = 20, 10, 5


def _nodes(spark, sf_dir):
    """(file_id, node) of every file with a path; files of one module share a node."""
    files = rows_once(table(spark, sf_dir, "file_symbols", "file_id", "file_path"), "file_id").where("file_path is not null")
    key = text.module_key(F.col("file_path"))
    return files.select("file_id", "file_path", F.when(key == "", "__init__").otherwise(key).alias("node"))


def module_statistics(spark, sf_dir):
    """Modules, edges, mean out-degree, isolated modules, and whether there is no cycle."""
    return graph.statistics(_nodes(spark, sf_dir), _linked(spark, sf_dir))


MODULE_STATISTICS = f"""WITH RECURSIVE {LINKED}, n AS (SELECT DISTINCT node FROM f), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT (SELECT count(*) FROM n) AS num_nodes, (SELECT count(*) FROM e) AS num_edges, round((SELECT count(*) FROM e) / greatest((SELECT count(*) FROM n), 1), 6) AS avg_out_degree,
  (SELECT count(*) FROM n WHERE node NOT IN (SELECT src FROM e) AND node NOT IN (SELECT dst FROM e)) AS num_isolated, NOT EXISTS (FROM r WHERE src = dst) AS is_dag"""
MODULE_STATISTICS = MODULE_STATISTICS.replace("n AS (SELECT src, dst, sum(i)", "w AS (SELECT src, dst, sum(i)").replace("FROM n), n AS (SELECT DISTINCT", "FROM w), n AS (SELECT DISTINCT")


def module_importers(spark, sf_dir):
    """For every module what links to it directly: how many, and the first of them."""
    edges = checkpointed(_linked(spark, sf_dir))
    found = graph.reverse_neighbours(edges, edges.select(F.col("dst").alias("target")).distinct())
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("importers"), F.min("node").alias("first_importer"))


MODULE_IMPORTERS = f"WITH {LINKED} SELECT dst AS target, count(DISTINCT src) AS importers, min(src) AS first_importer FROM e GROUP BY dst"


def most_connected(spark, sf_dir):
    """The ten modules with the most edges that arrive."""
    return graph.degrees(_linked(spark, sf_dir)).select("node", F.col("n_in").cast("bigint").alias("n_in")).where("n_in > 0").orderBy(F.desc("n_in"), "node").limit(10)


MOST_CONNECTED = f"WITH {LINKED} SELECT dst AS node, count(*) AS n_in FROM e GROUP BY dst ORDER BY n_in DESC, node LIMIT 10"


def _rankings(spark, sf_dir):
    """The two rankings (query, doc, rank) of the issues, by words and by the graph from the best hits by words."""
    words = checkpointed(retrieval.bm25(_issues(spark, sf_dir), _index(spark, sf_dir), CANDIDATES))
    nodes = checkpointed(_nodes(spark, sf_dir).select("file_id", "node"))
    # A node is known by its smallest file.
    files = checkpointed(nodes.groupBy("node").agg(F.min("file_id").alias("at")))
    seeds = words.where(F.col("rank") <= SEEDS).join(nodes, F.col("doc") == F.col("file_id")).join(files, "node").select("query", F.col("at").alias("node"), (1 / F.col("rank")).alias("share"))
    end = lambda c: files.select(F.col("node").alias(c), F.col("at").alias(f"{c}_at"))
    edges = _linked(spark, sf_dir).join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_at").alias("src"), F.col("dst_at").alias("dst"), "weight")
    spread = checkpointed(graph.personal_top(edges, seeds, CANDIDATES)).withColumnRenamed("node", "doc")
    return {"bm25": words, "ppr": spread}


def module_ranks(spark, sf_dir):
    """Personalised PageRank of every issue from its ten best files by words, each with the share 1 / rank."""
    found = _rankings(spark, sf_dir)["ppr"]
    return found.select(F.col("query").alias("entry_id"), F.col("doc").alias("file_id"), F.round("score", 4).alias("score"))


def _steps(n: int) -> str:
    parts = ["z0 AS (SELECT entry_id, node, share / sum(share) OVER (PARTITION BY entry_id) AS score FROM s0)"]
    parts += [f"z{i + 1} AS MATERIALIZED (SELECT entry_id, dst AS node, sum(score * p) AS score FROM z{i} JOIN p ON src = node GROUP BY ALL)" for i in range(n)]
    union = " UNION ALL ".join(f"SELECT * FROM z{i}" for i in range(n + 1))
    return ", ".join(parts) + f", zs AS (SELECT entry_id, node, sum(score) AS score FROM ({union}) GROUP BY ALL)"


#: So many steps of the flow the SQL follows.
STEPS = 60
PPR = (
    BM25 + ", words AS MATERIALIZED (SELECT entry_id, doc, rank FROM ranked WHERE rank <= 20 AND score > 0), "
    + LINKED.replace("f AS (SELECT *, CASE", "fl AS (SELECT *, CASE").replace("FROM f)", "FROM fl)").replace("FROM f WHERE", "FROM fl WHERE").replace("node FROM f ", "node FROM fl ")
    .replace("FROM f\n", "FROM fl\n").replace("qualified_name FROM f UNION", "qualified_name FROM fl UNION").replace("(SELECT DISTINCT key, node FROM f)", "(SELECT DISTINCT key, node FROM fl)")
    .replace("n AS (SELECT src, dst, sum(i)", "nn AS (SELECT src, dst, sum(i)").replace("FROM n)", "FROM nn)")
    + """, s0 AS (SELECT entry_id, node, sum(1.0::DOUBLE / rank) AS share FROM words JOIN fl ON fl.file_id = doc WHERE rank <= 10 GROUP BY ALL),
p AS (SELECT src, dst, 0.85 * weight / sum(weight) OVER (PARTITION BY src) AS p FROM e), """
    + _steps(STEPS)
    + """, zn AS (SELECT entry_id, node, score / sum(score) OVER (PARTITION BY entry_id) AS score FROM zs),
zf AS (SELECT entry_id, file_id AS doc, round(score, 6) AS score FROM zn JOIN (SELECT node, min(file_id) AS file_id FROM fl GROUP BY node) USING (node) WHERE score >= 1e-6),
spread AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, doc) AS rank FROM zf)"""
)
MODULE_RANKS = PPR + " SELECT entry_id, doc AS file_id, round(score, 4) AS score FROM spread WHERE rank <= 20"


def localised(spark, sf_dir):
    """The five best files of every issue: the rankings by words and by the graph fused to twice as many candidates,
    each with its ranks, the lists it stands in, and the size of its summary (0 without symbols). Texts have no vectors in
    these tables, so that list is empty, as it may be; its weight isn't given to the others."""
    lists = _rankings(spark, sf_dir)
    fused = retrieval.fuse({name: (ranking, WEIGHTS[name]) for name, ranking in lists.items()}, 2 * BEST)
    sizes = _files(spark, sf_dir).select(F.col("file_id").alias("doc"), F.length(summary()).alias("size"))
    best = fused.where(F.col("rank") <= BEST).join(sizes, "doc", "left")
    return best.select(
        F.col("query").alias("entry_id"), F.col("doc").alias("file_id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"),
        F.col("bm25_rank").cast("bigint").alias("bm25_rank"), F.col("ppr_rank").cast("bigint").alias("ppr_rank"),
        F.col("bm25_rank").isNotNull().alias("in_bm25"), F.lit(False).alias("in_embed"), F.col("ppr_rank").isNotNull().alias("in_ppr"), F.coalesce("size", F.lit(0)).cast("bigint").alias("summary_size"),
    )


FUSED = PPR + """, sp AS (SELECT entry_id, doc, rank FROM spread WHERE rank <= 20),
fu AS (SELECT coalesce(a.entry_id, b.entry_id) AS entry_id, coalesce(a.doc, b.doc) AS file_id, a.rank AS bm25_rank, b.rank AS ppr_rank,
  round(coalesce(0.4 / (60 + a.rank), 0) + coalesce(0.2 / (60 + b.rank), 0), 9) AS score FROM words a FULL JOIN sp b ON a.entry_id = b.entry_id AND a.doc = b.doc)"""
SIZES = "(SELECT DISTINCT file_id, length({summary}) AS size FROM file_symbols WHERE coalesce(parse_error, '') = '')"


def _localised_sql() -> str:
    from millrace.plans.retrieval_queries import SUMMARY

    return FUSED + f""", fr AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, file_id) AS rank FROM fu)
SELECT entry_id, fr.file_id, rank, round(score, 6) AS score, bm25_rank, ppr_rank, bm25_rank IS NOT NULL AS in_bm25, false AS in_embed, ppr_rank IS NOT NULL AS in_ppr, coalesce(size, 0) AS summary_size
FROM fr LEFT JOIN {SIZES.format(summary=SUMMARY)} z ON z.file_id = fr.file_id WHERE rank <= 5"""


def localisation_variants(spark, sf_dir):
    """How many files each variant of the fusion finds, and how many of its best five the full one has as well: lists
    are left out whole, and the weights of the others stay as they are."""
    lists = {name: (ranking, WEIGHTS[name]) for name, ranking in _rankings(spark, sf_dir).items()}
    variants = {"full": ["bm25", "ppr"], "no_bm25": ["ppr"], "no_ppr": ["bm25"]}
    rows = None
    for variant, used in variants.items():
        part = retrieval.fuse({n: lists[n] for n in used}, BEST).select("query", "doc", F.lit(variant).alias("variant"))
        rows = part if rows is None else rows.unionByName(part)
    rows = checkpointed(rows)
    full = rows.where("variant = 'full'").select("query", "doc", F.lit(1).alias("hit"))
    return rows.join(full, ["query", "doc"], "left").groupBy("variant").agg(F.count_distinct("query").alias("queries"), F.count(F.lit(1)).alias("files"), F.count("hit").alias("shared"))


LOCALISATION_VARIANTS = FUSED + """, va AS (
  SELECT 'full' AS variant, entry_id, file_id, score FROM fu UNION ALL SELECT 'no_bm25', entry_id, doc, round(0.2 / (60 + rank), 9) FROM sp UNION ALL SELECT 'no_ppr', entry_id, doc, round(0.4 / (60 + rank), 9) FROM words),
vr AS (SELECT variant, entry_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY variant, entry_id ORDER BY score DESC, file_id) AS rank FROM va) WHERE rank <= 5)
SELECT vr.variant, count(DISTINCT vr.entry_id) AS queries, count(*) AS files, count(h.file_id) AS shared FROM vr LEFT JOIN (SELECT entry_id, file_id FROM vr WHERE variant = 'full') h USING (entry_id, file_id) GROUP BY vr.variant"""


def _sources(spark, sf_dir):
    files = rows_once(table(spark, sf_dir, "source_files", "file_id", "file_path", "source"), "file_id")
    return files.where("lower(file_path) like '%.py' and lower(file_path) not like '%test%'")


def keyword_files(spark, sf_dir):
    """For every entry the three Python files in which the long words of its issue stand most often, also within other words."""
    issues = every_issue(spark, sf_dir)
    words = issues.select("query", F.explode("texts").alias("text")).select("query", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\w{5,}"), F.lit(0))).alias("word"))
    best = keywords.keyword_top(words, _sources(spark, sf_dir).select(F.col("file_id").alias("doc"), F.col("source").alias("text")), 3)
    best = best.join(issues.select("query", F.explode("entries.entry_id").alias("entry_id")), "query")
    return best.select("entry_id", F.col("doc").alias("file_id"), "n", F.col("rank").cast("bigint").alias("rank"))


KEYWORD_FILES = r"""WITH k AS (SELECT DISTINCT entry_id, unnest(regexp_extract_all(lower(problem_statement), '\w{5,}')) AS word FROM trajectories),
f AS (SELECT DISTINCT file_id, lower(source) AS t FROM source_files WHERE lower(file_path) LIKE '%.py' AND lower(file_path) NOT LIKE '%test%' AND source IS NOT NULL),
d AS (SELECT DISTINCT word FROM k), c AS (SELECT word, file_id, (length(t) - length(replace(t, word, ''))) // length(word) AS n FROM d, f WHERE contains(t, word)),
s AS (SELECT entry_id, file_id, sum(n)::BIGINT AS n FROM k JOIN c USING (word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY n DESC, file_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3"""


def hint_files(spark, sf_dir):
    """The five Python files that an issue's names point to, 3 for a file's stem and 1 for a place in its path; an issue
    without any gets the first five by path, with the score 0."""
    issues = table(spark, sf_dir, "trajectories", "entry_id", "problem_statement").where("entry_id % 20 = 0").distinct()
    names = text.hint_names(F.col("problem_statement"))
    hints = issues.select(F.col("entry_id").alias("query"), F.explode(names).alias("hint"))
    files = checkpointed(_sources(spark, sf_dir).select(F.col("file_id").alias("doc"), F.col("file_path").alias("path")))
    best = retrieval.top(keywords.name_points(hints, files), 5).select("query", "doc", "score", "rank")
    first = files.orderBy("path", "doc").limit(5)
    none = issues.select(F.col("entry_id").alias("query")).distinct().join(best.select("query").distinct(), "query", "left_anti")
    fallback = none.crossJoin(F.broadcast(first.select("doc", F.row_number().over(Window.orderBy("path", "doc")).alias("rank")))).select("query", "doc", F.lit(0).cast("bigint").alias("score"), "rank")  # five rows
    return best.unionByName(fallback).select(F.col("query").alias("entry_id"), F.col("doc").alias("file_id"), "score", F.col("rank").cast("bigint").alias("rank"))


HINT_FILES = r"""WITH i AS (SELECT DISTINCT entry_id, coalesce(problem_statement, '') AS t FROM trajectories WHERE entry_id % 20 = 0),
n AS (SELECT entry_id, unnest(regexp_extract_all(t, '[`''"](\S+?)\.py[`''"\s]', 1) || regexp_extract_all(lower(t), '`([a-z][a-z0-9_]{3,})`', 1)
  || regexp_extract_all(lower(t), '\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b', 1) || regexp_extract_all(lower(t), '\b([a-z]{7,})\b', 1)
  || [lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g')) for x in regexp_extract_all(t, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1)]
  || flatten([[replace(x, '.', '/'), regexp_extract(x, '([^.]*)$', 1)] for x in regexp_extract_all(lower(t), '\b([a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){2,})\b', 1)])) AS hint FROM i),
h AS (SELECT DISTINCT entry_id, lower(hint) AS hint FROM n WHERE length(hint) > 3),
f AS (SELECT DISTINCT file_id, file_path, lower(file_path) AS path, regexp_extract(lower(file_path), '([^/]*?)(\.[a-z0-9]+)?$', 1) AS stem FROM source_files WHERE lower(file_path) LIKE '%.py' AND lower(file_path) NOT LIKE '%test%'),
s AS (SELECT entry_id, file_id, sum(CASE WHEN stem = hint THEN 3 ELSE 1 END)::BIGINT AS score FROM h JOIN f ON contains(path, hint) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, file_id) AS rank FROM s),
d AS (SELECT file_id, row_number() OVER (ORDER BY file_path, file_id) AS rank FROM f)
SELECT entry_id, file_id, score, rank FROM r WHERE rank <= 5
UNION ALL SELECT entry_id, file_id, 0, rank FROM i, d WHERE rank <= 5 AND entry_id NOT IN (SELECT entry_id FROM s)"""

QUERIES = {
    "module_statistics": module_statistics, "module_importers": module_importers, "most_connected": most_connected, "module_ranks": module_ranks,
    "localised": localised, "localisation_variants": localisation_variants, "keyword_files": keyword_files, "hint_files": hint_files,
}
ORACLES = {
    "module_statistics": MODULE_STATISTICS, "module_importers": MODULE_IMPORTERS, "most_connected": MOST_CONNECTED, "module_ranks": MODULE_RANKS,
    "localised": _localised_sql(), "localisation_variants": LOCALISATION_VARIANTS, "keyword_files": KEYWORD_FILES, "hint_files": HINT_FILES,
}
