from millrace.operators import graph
from millrace.plans import graph_queries


def test_imports_and_calls_resolve(spark):
    modules = spark.createDataFrame([("a.b", "a.b"), ("a", "a"), ("u", "u")], "key string, node string")
    imports = spark.createDataFrame([("m", x) for x in ["a.b", "a.b.C", "a.x.y", ".u", "..u", ".u.v", "typing", "", None, "a.b"]], "src string, module string")
    assert sorted(r.dst for r in graph.resolved_imports(imports, modules).collect()) == ["a", "a.b", "a.b", "a.b", "u", "u"]
    symbols = spark.createDataFrame([("run", "x", 1), ("run", "y", 2), ("K.go", "z", 3), ("K", "w", 4), (None, "n", 5)], "name string, node string, place long")
    calls = spark.createDataFrame([("m", x) for x in ["run", "self.run", "K.go", "K.none", "print", None]], "src string, callee string")
    assert sorted(r.dst for r in graph.resolved_calls(calls, symbols).collect()) == ["w", "y", "y", "z"]


def test_linked_edges_have_calls(spark, data):
    kinds = {r.kind for r in graph_queries.linked_edges(spark, data).collect()}
    assert "call" in kinds
