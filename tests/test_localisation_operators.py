import numpy as np

from millrace.operators import calibration, graph, keywords, reports
from millrace.sources import store

EDGES = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "a", 0.5), ("c", "d", 0.5), ("e", "a", 1.0)]


def edges(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "src string, dst string, weight double, score string")


def test_personal_ranks_are_the_fixed_point(spark):
    nodes = sorted({n for s, d, _ in EDGES for n in (s, d)})
    at = {n: i for i, n in enumerate(nodes)}
    step, out = np.zeros((len(nodes), len(nodes))), {s: sum(w for x, _, w in EDGES if x == s) for s, _, _ in EDGES}
    for s, d, w in EDGES:
        step[at[d], at[s]] = w / out[s]
    seeds = {"q": {"a": 1.0, "e": 0.5}, "r": {"d": 2.0}, "s": {"b": 1.0}}
    rows = [(q, n, w) for q, own in seeds.items() for n, w in own.items()] + [("t", "a", None), ("t", None, 1.0), (None, "a", 1.0), ("u", "a", 0.0)]
    got = {(r.query, r.node): r.score for r in graph.personal_ranks(edges(spark, EDGES), spark.createDataFrame(rows, "query string, node string, share double")).collect()}
    for q, own in seeds.items():
        home = np.array([own.get(n, 0) for n in nodes]) / sum(own.values())
        x = home.copy()
        for _ in range(500):
            x = 0.85 * step @ x + (0.15 + 0.85 * x[at["d"]]) * home
        assert all(abs(got.get((q, n), 0) - x[at[n]]) < 1e-5 for n in nodes)
    assert {q for q, _ in got} == set(seeds)


def test_cycles_and_statistics(spark):
    assert not graph.is_acyclic(edges(spark, EDGES))
    assert graph.is_acyclic(edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)])) and graph.is_acyclic(edges(spark, []))
    assert not graph.is_acyclic(edges(spark, [("a", "a", 1.0)]))
    nodes = spark.createDataFrame([("a",), ("b",), ("z",), ("z",)], "node string")
    row = graph.statistics(nodes, edges(spark, [("a", "b", 1.0)])).first()
    assert tuple(row) == (3, 1, 0.333333, 1, True)


def test_keyword_counts_are_substring_counts(spark):
    texts = {1: "aaaaaaa Window windows, rewindow\nwindow_window", 2: None, 3: "", 4: "nothing of it"}
    words = [("q", "Window"), ("q", "aaaaa"), ("q", "tiny"), ("r", "nothing"), ("r", None), (None, "windows")]
    got = {(r.query, r.doc): r.n for r in keywords.keyword_counts(spark.createDataFrame(words, "query string, word string"), spark.createDataFrame(list(texts.items()), "doc long, text string")).collect()}
    assert got == {("q", 1): texts[1].lower().count("window") + 1, ("r", 4): 1, (None, 1): 1}


def test_name_points(spark):
    hints = spark.createDataFrame([("q", "Load"), ("q", "ab"), ("q", "core/lo"), ("r", None)], "query string, hint string")
    paths = spark.createDataFrame([(1, "core/load.py"), (2, "core/loader.PY"), (3, None), (4, "")], "doc long, path string")
    assert {(r.query, r.doc): r.score for r in keywords.name_points(hints, paths).collect()} == {("q", 1): 4, ("q", 2): 2}


def test_queue_never_falls_below_zero(spark):
    ops = ["finished", "queued", "started", "started", "queued", "started", "finished", "queued", "finished", "finished", "finished", "started"]
    got = reports.queue_states(spark.createDataFrame([(i, "k", op) for i, op in enumerate(ops)], "at int, k string, op string"), "k", ["at"], 2).orderBy("at").collect()
    running = queued = done = refused = 0
    for op, row in zip(ops, got):
        if op == "queued" and running >= 2:
            refused += 1
        elif op == "queued":
            queued += 1
        elif op == "started":
            queued, running = max(0, queued - 1), running + 1
        else:
            running, done = max(0, running - 1), done + 1
        assert (row.running, row.queued, row.completed, row.rejected) == (running, queued, done, refused)


def test_gates(spark):
    rows = [("q", r, p, i) for r, p, i in [(1, 0.95, True), (2, 0.5, True), (3, 0.4, False)]] + [("r", 1, 0.99, False), ("r", 2, 0.98, True)] + [("s", r, 0.1, True) for r in range(1, 13)]
    got = {r.query: r for r in calibration.gated_sets(spark.createDataFrame(rows, "query string, rank int, p_value double, in_set boolean"), 0.2, 8, 1500, 20).collect()}
    assert [(got[q].files, got[q].set_size, got[q].label) for q in "qrs"] == [(1, 2, "moderate"), (1, 1, "confident"), (8, 12, "very_uncertain")]
    both = calibration.with_defaults(spark.createDataFrame([("q",), ("none",)], "query string"), calibration.gated_sets(spark.createDataFrame(rows, "query string, rank int, p_value double, in_set boolean"), 0.2, 8, 1500, 20))
    assert {r.query: (r.files, r.label) for r in both.collect()} == {"q": (1, "moderate"), "none": (0, "very_uncertain")}


def test_stores(spark, tmp_path):
    schema = "repo string, s double"
    assert store.load(spark, str(tmp_path / "none"), schema).count() == 0
    store.save(spark.createDataFrame([("a", 1.0)], schema), str(tmp_path / "t"))
    assert store.load(spark, str(tmp_path / "t"), schema).collect() == [("a", 1.0)]
    assert store.load(spark, str(tmp_path / "t"), "other string").count() == 0
    now = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "k long, d string")
    kept = spark.createDataFrame([(1, "x"), (1, "old"), (2, "old"), (4, "w")], "k long, d string")
    assert {r.k: r.state for r in store.cache_state(now, kept, "k", "d").collect()} == {1: "hit", 2: "stale", 3: "miss", 4: "gone"}


def test_keyword_top_is_the_top_of_the_counts(spark):
    texts = spark.createDataFrame([(d, " ".join(["window"] * (d % 5) + ["windows"] * (d % 2) + ["nothing"])) for d in range(20)], "doc long, text string")
    words = spark.createDataFrame([(q, w) for q in range(4) for w in ("Window", "nothing", "tiny", "windows")[q:]], "query long, word string")
    got = {(r.query, r.rank): (r.doc, r.n) for r in keywords.keyword_top(words, texts, 3).collect()}
    counts = [(r.query, -r.n, r.doc) for r in keywords.keyword_counts(words, texts).collect()]
    assert got == {(q, i + 1): (d, -n) for q in {q for q, _, _ in counts} for i, (_, n, d) in enumerate(sorted(c for c in counts if c[0] == q)[:3])}


def test_personal_top_held_and_joined(spark, monkeypatch):
    """A graph held by the tasks gives the best of the ranks that joins give, seeds outside of it included."""
    graph_ = spark.createDataFrame([(i, (i * 7 + j) % 30, 1.0 + j) for i in range(25) for j in range(1, 4) if i != (i * 7 + j) % 30], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(q, (q * 5 + i) % 35, 1 / (i + 1)) for q in range(8) for i in range(3)] + [(50, 77, 2.0), (51, 1, None), (None, 1, 1.0)], "query long, node long, share double")
    held = {(r.query, r.rank): (r.node, r.score) for r in graph.personal_top(graph_, seeds, 4, damping=0.3).collect()}
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    joined = {(r.query, r.rank): (r.node, r.score) for r in graph.personal_top(graph_, seeds, 4, damping=0.3).collect()}
    assert held == joined and held[50, 1] == (77, 1.0) and {q for q, _ in held} == {*range(8), 50}
    assert graph.personal_top(graph_.limit(0), seeds.where("query = 50"), 4).collect() == [(50, 77, 1.0, 1)]
