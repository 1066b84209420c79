"""A weighted directed graph of modules: edges, degrees, reach, and personalised PageRank by iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import retrieval
from millrace.session import checkpointed

IMPORT, MORE, CALL = 1.0, 0.5, 0.3
#: A graph of so many edges at most is held by each task that follows flows; so many seeds make a task.
HELD_EDGES, SEEDS = 1 << 21, 1 << 12


def edges(imports: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, kind, weight) from one row per import and call, each (src, dst).

    A pair's first import weighs IMPORT, each further one MORE and each call CALL; the kind is import if there is
    any. Null ends and loops are dropped. Counted with partial aggregation, so a hot module costs one row per task.
    """
    rows = imports.select("src", "dst", F.lit(1).alias("i"), F.lit(0).alias("c")).unionByName(calls.select("src", "dst", F.lit(0).alias("i"), F.lit(1).alias("c")))
    counts = rows.where("src is not null and dst is not null and src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("i").alias("i"), F.sum("c").alias("c"))
    weight = F.when(F.col("i") > 0, IMPORT + MORE * (F.col("i") - 1)).otherwise(0.0) + CALL * F.col("c")
    return counts.select("src", "dst", F.when(F.col("i") > 0, "import").otherwise("call").alias("kind"), F.round(weight, 6).alias("weight"))


def resolved_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst) of each of ``imports``(src, module) that names one of ``modules``(key, node): by its whole name, else
    without leading dots, else by its longest dotted prefix. Others are dropped.

    Candidates are resolved once per distinct name; both joins are by key.
    """
    name = F.col("module")
    parts = F.split(name, r"\.")
    prefixes = F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i + 1), "."))
    names = imports.select("module").where("module <> ''").distinct()
    keys = names.select("module", F.posexplode(F.concat(F.array(name, F.regexp_replace(name, r"^\.+", "")), prefixes)).alias("at", "key"))
    found = keys.join(modules.groupBy("key").agg(F.max("node").alias("node")), "key").groupBy("module").agg(F.min_by("node", "at").alias("dst"))
    return imports.join(found, "module").select("src", "dst")


def resolved_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) of each of ``calls``(src, callee) that names one of ``symbols``(name, node, place): as a whole, else by
    one of its dotted parts, from the right. Of several symbols of a name that of the highest place counts. Others are
    dropped."""
    parts = F.concat(F.array("callee"), F.reverse(F.split("callee", r"\.")))
    keys = calls.select("callee").where("callee is not null").distinct().select("callee", F.posexplode(parts).alias("at", "name"))
    last = symbols.where("name is not null").groupBy("name").agg(F.max_by("node", "place").alias("node"))
    found = keys.join(last, "name").groupBy("callee").agg(F.min_by("node", "at").alias("dst"))
    return calls.join(found, "callee").select("src", "dst")


def degrees(graph: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of all nodes; one aggregation over both ends."""
    ends = graph.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(graph.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def reach(graph: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): what ``starts``(start) reach within ``depth`` edges, with the fewest. A start reaches itself
    only over a cycle. The new frontier alone is joined in each step."""
    seen = starts.join(graph, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().withColumn("hops", F.lit(1))
    frontier = seen
    for hops in range(2, depth + 1):
        step = frontier.join(graph, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hops))
        seen = seen.unionByName(frontier)
    return seen


def reverse_neighbours(graph: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node): what links to each of ``targets``(target) directly."""
    return targets.join(graph, F.col("target") == F.col("dst")).select("target", F.col("src").alias("node")).distinct()


def is_acyclic(graph: DataFrame, max_rounds: int = 1000) -> bool:
    """Whether no node reaches itself. Edges that begin where nothing arrives, or end where nothing leaves, lie on no
    cycle; they are taken away until none is left, or nothing more goes. Lineage is cut in every round."""
    left = checkpointed(graph.select("src", "dst").distinct())
    n = left.count()
    for _ in range(max_rounds):
        if not n:
            return True
        rest = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        rest = checkpointed(rest.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, rest.count()
        if n == before:
            return False
        left = rest
    raise RuntimeError(f"edges still go after {max_rounds} rounds")


def statistics(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """One row (num_nodes, num_edges, avg_out_degree, num_isolated, is_dag) of ``nodes``(node) and their edges."""
    nodes, graph = nodes.select("node").distinct(), checkpointed(graph)
    isolated = nodes.join(degrees(graph).select("node"), "node", "left_anti").agg(F.count(F.lit(1)).alias("num_isolated"))
    counts = nodes.agg(F.count(F.lit(1)).alias("num_nodes")).crossJoin(graph.agg(F.count(F.lit(1)).alias("num_edges"))).crossJoin(isolated)
    return counts.select("num_nodes", "num_edges", F.round(F.col("num_edges") / F.greatest("num_nodes", F.lit(1)), 6).alias("avg_out_degree"), "num_isolated", F.lit(is_acyclic(graph)).alias("is_dag"))


def personal_ranks(graph: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 200) -> DataFrame:
    """(query, node, score): personalised PageRank of every query from its own ``seeds``(query, node, share).

    With what stands at nodes without out-edges returned to the seeds, the fixed point is the sum of all that flows
    from the seeds, damped at every step and divided by its total; so only nodes that a query reaches take part, and
    no row is made for the others. Seeds outside the graph keep their share. The flow is followed until less than
    ``tolerance`` of every query's share still moves. Each round is one keyed join and one aggregation, with a
    reliable checkpoint. Shares below zero or null count nothing; a query without any has no rows.
    """
    known = seeds.where("query is not null and node is not null and share > 0").groupBy("query", "node").agg(F.sum("share").alias("share"))
    totals = known.groupBy("query").agg(F.sum("share").alias("total"))
    moving = checkpointed(known.join(totals, "query").select("query", "node", (F.col("share") / F.col("total")).alias("score")))
    out = graph.groupBy("src").agg(F.sum("weight").alias("out"))
    flow = checkpointed(graph.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out") * damping).alias("p")))
    rounds = [moving]
    for _ in range(max_rounds):
        moving = checkpointed(moving.join(flow, F.col("node") == F.col("src")).groupBy("query", "dst").agg(F.sum(F.col("score") * F.col("p")).alias("score")).withColumnRenamed("dst", "node"))
        rounds.append(moving)
        left = moving.groupBy("query").agg(F.sum("score").alias("left")).agg(F.max("left")).first()[0]
        if left is None or left < tolerance:
            break
    arrived = rounds[0]
    for part in rounds[1:]:
        arrived = arrived.unionByName(part)
    sums = checkpointed(arrived.groupBy("query", "node").agg(F.sum("score").alias("score")))
    return sums.join(sums.groupBy("query").agg(F.sum("score").alias("total")), "query").select("query", "node", (F.col("score") / F.col("total")).alias("score"))


def column_blocks(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` of numbers in up to ``n`` blocks, dealt by ``keys``: a row and a task per block, each column as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            block = pa.Table.from_batches(parts)
            yield pa.RecordBatch.from_pylist([{c: block[c].to_numpy().tobytes() for c in block.column_names}])

    return checkpointed(rows.repartition(n, *keys).mapInArrow(pack, ", ".join(f"{c} binary" for c in rows.columns)))


def flows(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, query: np.ndarray, node: np.ndarray, share: np.ndarray, damping: float, tolerance: float, max_rounds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, nodes, scores) of every query: ``personal_ranks`` of one after the other, over the part of the graph that it reaches."""
    nodes, at = np.unique(np.concatenate([src, dst, node]), return_inverse=True)
    src, dst, node = np.split(at, [len(src), 2 * len(src)])
    order = np.argsort(dst, kind="stable")
    src, dst, weight = src[order], dst[order], weight[order]
    p = damping * weight / np.bincount(src, weight, len(nodes))[src]
    by_src = np.argsort(src, kind="stable")
    n_out = np.bincount(src, minlength=len(nodes))
    first = np.cumsum(n_out) - n_out
    order = np.argsort(query, kind="stable")
    query, node, share = query[order], node[order], share[order]
    queries, begins = np.unique(query, return_index=True)
    seen, place = np.zeros(len(nodes), bool), np.zeros(len(nodes), np.int64)
    for q, own in zip(queries, np.split(np.arange(len(query)), begins[1:])):
        seen[:] = False
        frontier, edges = np.unique(node[own]), []
        seen[frontier] = True
        while len(frontier):
            n = n_out[frontier]
            out = by_src[np.arange(n.sum()) + np.repeat(first[frontier] - (np.cumsum(n) - n), n)]
            edges.append(out)
            new = dst[out]
            frontier = np.unique(new[~seen[new]])
            seen[frontier] = True
        reached = np.flatnonzero(seen)
        place[reached] = np.arange(len(reached))
        used = np.sort(np.concatenate(edges))
        s, d, x = place[src[used]], place[dst[used]], p[used]
        moving = np.bincount(place[node[own]], share[own], len(reached))
        moving /= moving.sum()
        total = moving.copy()
        if len(used):
            starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            for _ in range(max_rounds):
                arrived = np.add.reduceat(moving[s] * x, starts)
                moving = np.zeros(len(reached))
                moving[d[starts]] = arrived
                total += moving
                if arrived.sum() < tolerance:
                    break
        yield q, nodes[reached], total / total.sum()


def personal_top(graph: DataFrame, seeds: DataFrame, k: int, least: float = 1e-6, damping: float = 0.85, tolerance: float = 1e-8, max_rounds: int = 200) -> DataFrame:
    """(query, node, score, rank): of the ``personal_ranks`` of at least ``least`` the ``k`` best of every query, rounded to six
    places, ties by the node. Nodes and queries are whole numbers.

    A graph of up to HELD_EDGES edges, as counted, is held by every task, which follows the flows of its own queries and
    passes on ``k`` rows of each; a larger one is joined round by round.
    """
    graph = checkpointed(graph.select(*(F.col(c).cast("bigint").alias(c) for c in ("src", "dst")), F.col("weight").cast("double").alias("weight")))
    edges = graph.count()
    if edges > HELD_EDGES:
        ranks = personal_ranks(graph, seeds, damping, tolerance, max_rounds).where(F.col("score") >= least)
        return retrieval.top(ranks.select("query", "node", F.round("score", 6).alias("score")), k, item="node")
    known = checkpointed(seeds.where("query is not null and node is not null and share > 0").select(*(F.col(c).cast("bigint").alias(c) for c in ("query", "node")), F.col("share").cast("double").alias("share")))
    held = column_blocks(graph, 1) if edges else graph.sparkSession.createDataFrame([(b"", b"", b"")], "src binary, dst binary, weight binary")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            column = {c: np.frombuffer(v, np.float64 if c in ("weight", "share") else np.int64) for c, v in r.items()}
            found = []
            for q, nodes, scores in flows(**column, damping=damping, tolerance=tolerance, max_rounds=max_rounds):
                nodes, scores = nodes[scores >= least], np.floor(scores[scores >= least] * 1e6 + 0.5) / 1e6
                best = np.lexsort((nodes, -scores))[:k]
                found.append((np.full(len(best), q), nodes[best], scores[best], np.arange(1, len(best) + 1, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query", "node", "score", "rank"])

    pairs = column_blocks(known, -(-known.count() // SEEDS) or 1, "query").hint("shuffle_replicate_nl").crossJoin(held)
    return pairs.mapInArrow(follow, "query bigint, node bigint, score double, rank int")


def pagerank(graph: DataFrame, seeds: DataFrame, iterations: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(node, score): personalised PageRank after a number of iterations.

    ``seeds``(node, share) are normalised over the nodes of the graph; scores begin uniform, follow out-edges by
    weight, and what stands at nodes without any returns to the seeds. An iteration is one join and one aggregation;
    lineage is cut every few of them by a reliable checkpoint. An empty graph or no seed in it gives no rows.
    """
    nodes = degrees(graph).select("node", "n_out")
    total = nodes.count()
    known = seeds.join(nodes, "node").select("node", "share")
    mass = known.agg(F.sum("share")).first()[0]
    if not total or not mass:
        return nodes.select("node", F.lit(0.0).alias("score")).limit(0)
    out = graph.groupBy("src").agg(F.sum("weight").alias("out"))
    flow = checkpointed(graph.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")))
    nodes = checkpointed(nodes.join(known.groupBy("node").agg((F.sum("share") / mass).alias("home")), "node", "left").select("node", "n_out", F.coalesce("home", F.lit(0.0)).alias("home")))
    ranks = nodes.select("node", F.lit(1.0 / total).alias("score"))
    for i in range(1, iterations + 1):
        arrived = flow.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("score") * F.col("p")).alias("arrived"))
        loose = ranks.join(nodes, "node").where("n_out = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))
        ranks = nodes.join(arrived, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(loose)).select(
            "node", (damping * F.coalesce("arrived", F.lit(0.0)) + (damping * F.col("loose") + 1 - damping) * F.col("home")).alias("score")
        )
        if i % every == 0 or i == iterations:
            ranks = checkpointed(ranks)
    return ranks
