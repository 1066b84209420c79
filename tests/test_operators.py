import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import calibration, components, dataset, distinct, evaluation, graph, retrieval, schema_drift


def test_components(spark):
    links = [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (4, "a"), (5, None), (6, "z"), (6, "z"), (None, "z")]
    got = {r.record: r.component for r in components.record_components(spark.createDataFrame(links, "record long, entity string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
    chain = [(i, f"e{i // 2}") for i in range(40)] + [(i, f"f{(i + 1) // 2}") for i in range(40)]
    got = {r.component for r in components.record_components(spark.createDataFrame(chain, "record long, entity string")).collect()}
    assert got == {0}
    assert components.record_components(spark.createDataFrame([], "record long, entity string")).count() == 0


def test_rows_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (None, None), (None, None)], "id int, t string")
    want = [(None, None), (1, "a"), (2, "b"), (2, "c")]
    assert sorted(map(tuple, distinct.rows_once(df, "id").collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(distinct, "BROADCAST_KEYS", 0)
    assert distinct.rows_once(df, "id").count() == 4
    maps = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (1, {"a": 2}), (2, None), (2, None)], "id int, m map<string,int>")
    assert distinct.rows_once(maps, "id").count() == 3


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["cat", "dog"]), (2, ["cat", "cat", "fish"]), (3, ["bird"]), (4, []), (5, ["ox"])], "doc int, tokens array<string>")
    got = {r.doc: r.score for r in retrieval.bm25(spark.createDataFrame([(9, ["dog", "dog", "fish"])], "query int, tokens array<string>"), retrieval.bm25_index(docs)).collect()}
    idf, mean = math.log(4 - 1 + 0.5) - math.log(1.5), 7 / 4
    assert got[1] == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / mean)), abs=1e-6)
    assert got[2] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / mean)), abs=1e-6)
    assert set(got) == {1, 2}


def test_fusion_and_recall(spark):
    rank = lambda rows: spark.createDataFrame(rows, "query int, doc string, rank int")
    got = {r.doc: r.score for r in retrieval.fuse({"a": (rank([(1, "x", 1)]), 0.4), "b": (rank([(1, "x", 2), (1, "y", 1)]), 0.2)}).collect()}
    assert got["x"] == pytest.approx(0.4 / 61 + 0.2 / 62, abs=1e-8) and got["y"] == pytest.approx(0.2 / 61, abs=1e-8)
    share, hit = retrieval.recall(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "ac")), 2)
    assert tuple(spark.range(1).select(share, hit).first()) == (0.5, 1)


def test_dense_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rows = [(i, [float(math.sin(i * k + 1)) for k in range(1, 6)]) for i in range(30)] + [(99, [0.0] * 5)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    got = retrieval.dense_top(vectors.where("id < 3"), vectors, 4).collect()

    def cosine(a, b):
        dot, la, lb = sum(x * y for x, y in zip(a, b)), math.hypot(*a), math.hypot(*b)
        return dot / (la * lb) if la and lb else 0.0

    for q in range(3):
        want = sorted(((-round(cosine(rows[q][1], v), 5), i) for i, v in rows))[:4]
        assert [r.doc for r in sorted(got, key=lambda r: r.rank) if r.query == q] == [i for _, i in want]


def test_edge_weights(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    got = {(r.src, r.dst): (r.kind, r.weight) for r in graph.edges(pairs([("a", "b"), ("a", "b"), ("a", "a"), ("a", None)]), pairs([("a", "b")] * 3 + [("c", "b")] * 3)).collect()}
    assert got == {("a", "b"): ("import", 2.4), ("c", "b"): ("call", 0.9)}


def test_pagerank_keeps_its_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 3.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0), ("none", 5.0)], "node string, share double")
    got = {r.node: r.score for r in graph.pagerank(edges, seeds, 15).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["c"] > got["b"]
    assert graph.pagerank(edges.limit(0), seeds).count() == 0


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = {(r.node, r.hops) for r in graph.reach(edges, spark.createDataFrame([("a",)], "start string"), 2).collect()}
    assert got == {("b", 1), ("a", 2), ("c", 2)}


def test_conformal_by_hand(spark):
    cal = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "s double")
    got = {r.s: r.p_value for r in calibration.p_values(spark.createDataFrame([(0.2,), (0.05,), (0.9,)], "s double"), cal).collect()}
    assert got == {0.2: 0.75, 0.05: 1.0, 0.9: 0.25}
    assert calibration.threshold(cal, 0.1) == pytest.approx(0.3) and calibration.threshold(cal.limit(0), 0.1) == 1.0


def test_regularised_sets_are_never_empty(spark):
    rows = spark.createDataFrame([("q", "a", 5.0, 1), ("q", "b", 0.0, 2), ("r", "a", 0.0, 1)], "query string, doc string, score double, rank int")
    got = {(r.query, r.doc): r.in_set for r in calibration.regularised_sets(rows, -1.0).collect()}
    assert got == {("q", "a"): True, ("q", "b"): False, ("r", "a"): True}


def test_temperature(spark):
    rows = spark.createDataFrame([(4.0, 1)] * 7 + [(4.0, 0)] * 3, "m double, y int")
    fitted = calibration.fit_temperature(rows, F.col("m"), F.col("y"), steps=80, rate=1.0)
    assert fitted > 2  # overconfident scores are cooled
    assert calibration.fit_temperature(rows.limit(0), F.col("m"), F.col("y")) == 1.0


def test_running_rate_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "ROWS", 3)
    rows = spark.createDataFrame([("g", i, i % 3 == 0) for i in range(20)], "g string, i long, ok boolean")
    got = sorted((r.i, r.n, r.good) for r in evaluation.running_rate(rows, ["g"], "i", F.col("ok")).collect())
    assert got == [(i, i + 1, i // 3 + 1) for i in range(20)]


def test_histogram_and_category(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", 20.0), ("a", None)], "k string, v double")
    got = {r.le: r.n for r in evaluation.histogram(rows, ["k"], F.col("v"), [1.0, 30.0]).collect()}
    assert got == {1.0: 1, 30.0: 2, math.inf: 2}
    row = spark.createDataFrame([("ImportError: x", {"t": True, "u": False}, {}), (None, {"t": True}, None), (None, None, None)], "log string, f map<string,boolean>, p map<string,boolean>")
    got = [r[0] for r in row.select(evaluation.failure_category(F.col("log"), F.lit(True), F.col("f"), F.col("p"))).collect()]
    assert got == ["import_error", "success", "unknown"]


def test_split_size(spark):
    rows = dataset.hashed_split(spark.range(16).withColumnRenamed("id", "k"), "k", 0.2, 42)
    assert {r.split: r["count"] for r in rows.groupBy("split").count().collect()} == {"validation": 3, "train": 13}


def lines(spark, files):
    rows = [("s", f"f{seq}", seq, i, line, "extra") for seq, body in files.items() for i, line in enumerate(body)]
    return spark.createDataFrame(rows, "series string, source_file string, file_seq int, line_no int, line string, field string")


def test_schema_changes(spark):
    old = ['{"task_id": "a%d-b1-c2", "n": %d, "gone": "some words here"}' % (i, i) for i in range(6)]
    new = ['{"run": "d%d-e1-f2", "n": "%d", "extra": [1]}' % (i, i) for i in range(6)]
    noise = ["", None, "no json", '{"run": 1},', '{"run":1}{"n":2}', "[1]", '{"rare": 1, "run": "x1-y2-z3", "n": "1", "extra": []}']
    df = lines(spark, {0: old, 1: new + noise})
    want = {("f1", "renamed", "task_id", "run"), ("f1", "type_changed", "n", "n"), ("f1", "removed", "gone", ""), ("f1", "added", "", "extra")}
    assert {tuple(r) for r in schema_drift.schema_changes(df.union(df)).collect()} == want
    assert schema_drift.schema_changes(df.limit(0)).count() == 0


def test_unified_table(spark):
    df = lines(spark, {0: ['{"task_id": "a%d-b1", "patch": null}' % i for i in range(4)], 1: ['{"taskId": "c%d-d1", "patch": "p"}' % i for i in range(3)]})
    got = {(r.file_seq, r.line_no): (r.task_id, r.patch) for r in schema_drift.unified_table(df).collect()}
    assert len(got) == 7 and got[1, 0] == ("c0-d1", "p") and got[0, 3] == ("a3-b1", None)


def test_assignment_is_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    for shape in [(1, 1), (2, 3), (4, 4), (5, 3)]:
        gain = rng.random(shape)
        small, large = min(shape), max(shape)
        g = gain if shape[0] <= shape[1] else gain.T
        best = max(sum(g[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert sum(gain[r, c] for r, c in schema_drift.assign(gain)) == pytest.approx(best)


def test_sparse_top_in_blocks(spark, monkeypatch):
    """Blocks of a few rows, terms that all share and rare ones: the same as all pairs joined, with ties and terms nobody has."""
    for name, size in (("QUERY_TERMS", 7), ("POSTINGS", 20), ("DENSE_TERMS", 2), ("PRODUCTS", 5)):
        monkeypatch.setattr(retrieval, name, size)
    terms = [(q, f"t{t}", 1 + (q * t) % 3) for q in range(9) for t in range(12) if (q + t) % 3 or t == 0] + [(90, "none", 1), (None, "t0", 1), (91, None, 1)]
    postings = [(f"t{t}", d, ((d * t) % 5 - 1) / 7) for d in range(40) for t in range(14) if (d * t) % 4 < 2] + [("t0", None, 1.0)]
    t, p = spark.createDataFrame(terms, "query long, term string, times int"), spark.createDataFrame(postings, "term string, doc int, weight double")
    got = {(r.query, r.rank): (r.doc, r.score) for r in retrieval.sparse_top(t, p, 3).collect()}
    want = {}
    for q in {q for q, _, _ in terms if q is not None}:
        sums = {}
        for term, d, w in postings:
            for x in (x for y, z, x in terms if y == q and z == term and d is not None):
                sums[d] = sums.get(d, 0) + x * w
        best = sorted((-round(s, 6), d) for d, s in sums.items() if round(s, 6) > 0)[:3]
        want |= {(q, i + 1): (d, pytest.approx(-s)) for i, (s, d) in enumerate(best)}
    assert got == want


def test_bm25_makes_no_row_per_pair(spark):
    """A word that all have: 3,000 queries and 3,000 documents meet without nine million rows."""
    docs = retrieval.bm25_index(spark.range(3000).select(F.col("id").alias("doc"), F.array(F.lit("all"), F.col("id").cast("string")).alias("tokens")))
    found = retrieval.bm25(spark.range(3000).select(F.col("id").alias("query"), F.array(F.lit("all"), F.col("id").cast("string")).alias("tokens")), docs, 1)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "")
    assert found.where("query = doc").count() == 3000
