"""Queries over the graph of modules that import and call each other."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import graph
from millrace.operators.distinct import rows_once
from millrace.session import checkpointed
from millrace.sources.tables import table

ITERATIONS = 10


def _graph(spark, sf_dir):
    """Packages as nodes: the folder of a file, and all but the last name of an imported module (the module itself if
    it has no dot); a call counts for the package of the first name of its callee, if that is a folder."""
    files = rows_once(table(spark, sf_dir, "file_symbols", "file_id", "file_path", "imports", "calls"), "file_id")
    key = text.module_key(F.col("file_path"))
    src = F.regexp_replace(key, r"\.[^.]+$", "")
    rows = files.select(src.alias("src"), "imports", "calls")
    module = F.regexp_replace(F.col("m.module"), r"^\.+", "")
    imports = rows.select("src", F.explode("imports").alias("m")).select("src", F.regexp_replace(module, r"\.[^.]+$", "").alias("dst"))
    calls = rows.select("src", F.explode("calls").alias("c")).where("c.callee like '%.%' and c.callee not like 'self.%'").select("src", F.split("c.callee", r"\.")[0].alias("dst"))
    return graph.edges(imports, calls)


EDGES = r"""f AS (SELECT DISTINCT file_id, regexp_replace(regexp_replace(replace(regexp_replace(file_path, '\.[A-Za-z]+$', ''), '/', '.'), '(?:^|\.)__init__$', ''), '\.[^.]+$', '') AS src, imports, calls FROM file_symbols),
x AS (SELECT src, regexp_replace(regexp_replace(m.module, '^\.+', ''), '\.[^.]+$', '') AS dst, 1 AS i, 0 AS c FROM (SELECT src, unnest(imports) AS m FROM f)
  UNION ALL SELECT src, split_part(c.callee, '.', 1), 0, 1 FROM (SELECT src, unnest(calls) AS c FROM f) WHERE c.callee LIKE '%.%' AND c.callee NOT LIKE 'self.%'),
n AS (SELECT src, dst, sum(i) AS i, sum(c) AS c FROM x WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
e AS (SELECT src, dst, CASE WHEN i > 0 THEN 'import' ELSE 'call' END AS kind, round(CASE WHEN i > 0 THEN 1 + 0.5 * (i - 1) ELSE 0 END + 0.3 * c, 6)::DOUBLE AS weight FROM n)"""


def module_edges(spark, sf_dir):
    return _graph(spark, sf_dir)


def module_degrees(spark, sf_dir):
    found = graph.degrees(_graph(spark, sf_dir))
    return found.select("node", F.col("n_in").cast("bigint").alias("n_in"), F.col("n_out").cast("bigint").alias("n_out"))


DEGREES = f"WITH {EDGES}, d AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM d GROUP BY node"


def module_reach(spark, sf_dir):
    """What each package reaches within two edges."""
    edges = checkpointed(_graph(spark, sf_dir))
    found = graph.reach(edges, edges.select(F.col("src").alias("start")).distinct(), 2)
    return found.select("start", "node", F.col("hops").cast("bigint").alias("hops"))


REACH = f"WITH {EDGES}, r AS (SELECT src AS start, dst AS node, 1 AS hops FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src) SELECT start, node, min(hops)::BIGINT AS hops FROM r GROUP BY start, node"


def module_pagerank(spark, sf_dir):
    """Personalised PageRank after ten iterations, seeded by the packages with most imported ones (1 / rank)."""
    edges = checkpointed(_graph(spark, sf_dir))
    seeds = graph.degrees(edges).orderBy(F.desc("n_out"), "node").limit(10)
    seeds = seeds.select("node", (1 / F.row_number().over(Window.orderBy(F.desc("n_out"), "node"))).alias("share"))  # ten rows
    found = graph.pagerank(edges, seeds, ITERATIONS)
    return found.select("node", F.round("score", 6).alias("score"))


def _pagerank_sql() -> str:
    parts = [
        f"WITH {EDGES}",
        "d AS (SELECT node, sum(o) AS o FROM (SELECT src AS node, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY node)",
        "s AS (SELECT node, 1.0::DOUBLE / row_number() OVER (ORDER BY o DESC, node) AS share FROM (SELECT * FROM d ORDER BY o DESC, node LIMIT 10))",
        "h AS (SELECT d.node, o, coalesce(share / (SELECT sum(share) FROM s), 0) AS home FROM d LEFT JOIN s USING (node))",
        "p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e)",
        "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM d) AS score FROM d)",
    ]
    for i in range(ITERATIONS):
        parts.append(f"a{i} AS (SELECT dst, sum(score * p) AS arrived FROM p JOIN r{i} ON src = node GROUP BY dst)")
        parts.append(f"l{i} AS (SELECT coalesce(sum(score), 0) AS loose FROM r{i} JOIN h USING (node) WHERE o = 0)")
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT node, 0.85 * coalesce(arrived, 0) + (0.85 * loose + 0.15) * home AS score FROM h LEFT JOIN a{i} ON node = dst, l{i})")
    return ", ".join(parts) + f" SELECT node, round(score, 6) AS score FROM r{ITERATIONS}"


def _linked(spark, sf_dir):
    """Modules as nodes, the root package as __init__: imports and calls that resolve to a module of the table, which
    is taken as one code base. Of functions and classes of one name that of the highest file_id counts."""
    files = rows_once(table(spark, sf_dir, "file_symbols", "file_id", "file_path", "imports", "functions", "classes", "calls"), "file_id").where("file_path is not null")
    key = text.module_key(F.col("file_path"))
    rows = files.withColumns({"key": key, "node": F.when(key == "", "__init__").otherwise(key)})
    imports = rows.select(F.col("node").alias("src"), F.explode("imports.module").alias("module"))
    calls = rows.select(F.col("node").alias("src"), F.explode("calls.callee").alias("callee"))
    none = F.array().cast("array<string>")
    names = F.concat(*(F.coalesce(c, none) for c in ("functions.name", "functions.qualified_name", "classes.name")))
    symbols = rows.select(F.explode(names).alias("name"), "node", F.col("file_id").alias("place"))
    return graph.edges(graph.resolved_imports(imports, rows.select("key", "node")), graph.resolved_calls(calls, symbols))


LINKED = r"""f AS (SELECT *, CASE WHEN key = '' THEN '__init__' ELSE key END AS node FROM (SELECT DISTINCT file_id, imports, functions, classes, calls,
    regexp_replace(replace(regexp_replace(file_path, '\.[A-Za-z]+$', ''), '/', '.'), '(?:^|\.)__init__$', '') AS key FROM file_symbols WHERE file_path IS NOT NULL)),
i AS (SELECT row_number() OVER () AS id, * FROM (SELECT node AS src, unnest(imports).module AS name FROM f) WHERE name <> ''),
ik AS (SELECT i.id, k.node, CASE WHEN k.key = name THEN 1e9 WHEN k.key = ltrim(name, '.') THEN 1e8 ELSE length(k.key) END AS score FROM i JOIN (SELECT DISTINCT key, node FROM f) k
  ON k.key = name OR k.key = ltrim(name, '.') OR starts_with(name, k.key || '.')),
c AS (SELECT row_number() OVER () AS id, * FROM (SELECT node AS src, unnest(calls).callee AS name FROM f)),
sy AS (SELECT name, arg_max(node, file_id) AS node FROM (SELECT node, file_id, unnest(functions).name AS name FROM f
  UNION ALL SELECT node, file_id, unnest(functions).qualified_name FROM f UNION ALL SELECT node, file_id, unnest(classes).name FROM f) GROUP BY name),
cp AS (SELECT id, 1000 AS score, name FROM c UNION ALL SELECT id, generate_subscripts(string_split(name, '.'), 1), unnest(string_split(name, '.')) FROM c),
x AS (SELECT src, arg_max(ik.node, score) AS dst, 1 AS i, 0 AS c FROM i JOIN ik USING (id) GROUP BY id, src
  UNION ALL SELECT src, arg_max(sy.node, score), 0, 1 FROM c JOIN cp USING (id) JOIN sy ON sy.name = cp.name GROUP BY id, src),
n AS (SELECT src, dst, sum(i) AS i, sum(c) AS c FROM x WHERE src <> dst GROUP BY src, dst),
e AS (SELECT src, dst, CASE WHEN i > 0 THEN 'import' ELSE 'call' END AS kind, round(CASE WHEN i > 0 THEN 1 + 0.5 * (i - 1) ELSE 0 END + 0.3 * c, 6)::DOUBLE AS weight FROM n)"""


def linked_edges(spark, sf_dir):
    return _linked(spark, sf_dir)


def linked_degrees(spark, sf_dir):
    found = graph.degrees(_linked(spark, sf_dir))
    return found.select("node", F.col("n_in").cast("bigint").alias("n_in"), F.col("n_out").cast("bigint").alias("n_out"))


def linked_reach(spark, sf_dir):
    """What each module reaches within two edges."""
    edges = checkpointed(_linked(spark, sf_dir))
    found = graph.reach(edges, edges.select(F.col("src").alias("start")).distinct(), 2)
    return found.select("start", "node", F.col("hops").cast("bigint").alias("hops"))


def linked_pagerank(spark, sf_dir):
    """``module_pagerank`` over the modules, with the same number of iterations."""
    edges = checkpointed(_linked(spark, sf_dir))
    seeds = graph.degrees(edges).orderBy(F.desc("n_out"), "node").limit(10)
    seeds = seeds.select("node", (1 / F.row_number().over(Window.orderBy(F.desc("n_out"), "node"))).alias("share"))  # ten rows
    return graph.pagerank(edges, seeds, ITERATIONS).select("node", F.round("score", 6).alias("score"))


def part_suppliers(spark, sf_dir):
    """Parts that several suppliers of one nation deliver, per nation, and their lines."""
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    supply = lines.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    per = supply.join(nation, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "l_partkey").agg(F.count(F.lit(1)).alias("suppliers"), F.sum("n").alias("lines"))
    return per.where("suppliers > 1").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("shared_parts"), F.sum("lines").alias("lines"))


PART_SUPPLIERS = """WITH s AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT s_nationkey, l_partkey, count(*) AS suppliers, sum(n) AS lines FROM s JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT s_nationkey, count(*) AS shared_parts, sum(lines)::BIGINT AS lines FROM p WHERE suppliers > 1 GROUP BY 1"""

QUERIES = {"module_edges": module_edges, "module_degrees": module_degrees, "module_reach": module_reach, "module_pagerank": module_pagerank, "part_suppliers": part_suppliers}
QUERIES |= {"linked_edges": linked_edges, "linked_degrees": linked_degrees, "linked_reach": linked_reach, "linked_pagerank": linked_pagerank}
ORACLES = {"module_edges": f"WITH {EDGES} SELECT * FROM e", "module_degrees": DEGREES, "module_reach": REACH, "module_pagerank": _pagerank_sql(), "part_suppliers": PART_SUPPLIERS}
ORACLES |= {"linked_edges": f"WITH {LINKED} SELECT * FROM e"} | {f"linked_{name}": ORACLES[f"module_{name}"].replace(EDGES, LINKED) for name in ("degrees", "reach", "pagerank")}
