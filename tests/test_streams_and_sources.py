from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.sources import code, jsonl
from millrace.streaming import admission, windows


def events(spark, seconds, key=1):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, key, start + timedelta(seconds=s)) for i, s in enumerate(seconds)], "event_id long, key long, ts timestamp")


def test_denied_events_do_not_count(spark):
    df = events(spark, [0, 10, 20, 61]).union(events(spark, [5], 2)).union(spark.createDataFrame([(7, None, None)], "event_id long, key long, ts timestamp"))
    got = {(r.key, r.event_id): r.allowed for r in admission.admitted(df, 2, 60).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): False, (1, 3): True, (2, 0): True}


def test_stream_admits_like_the_batch(spark, tmp_path):
    df = events(spark, [0, 10, 20, 61, 62, 70, 125])
    df.where("event_id < 4").write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = windows.run_to_table(admission.admitted_stream(stream, 2, 60), spark, "append")
    want = admission.admitted(df.where("event_id < 4"), 2, 60)
    assert {(r.event_id, r.allowed) for r in got.collect()} == {(r.event_id, r.allowed) for r in want.collect()}


def test_trailing_counts(spark):
    got = {r.event_id: r.n for r in windows.trailing_counts(events(spark, [0, 30, 60, 61, 200]), "key", "event_id", 60).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: 1}


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "a": "x"}\n\n{bad\n{"a": "no id"}\n{"id": 3, "b": 1}\n')
    path = str(tmp_path / "x.jsonl")
    assert [r.id for r in jsonl.read_jsonl(spark, path, "id long, a string", ("id",)).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in jsonl.read_jsonl(spark, path, "id long, a string", ("id",), known_only=True).collect()] == [1]
    assert [(r.n_lines, r.n_bad) for r in jsonl.bad_lines(spark, path).collect()] == [(4, 1)]
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.id for r in jsonl.remaining(rows, rows.where("id = 1"), "id").collect()] == [2]
    jsonl.append_jsonl(rows.withColumn("n", F.lit(None).cast("string")), f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['{"id":1,"n":null}', '{"id":2,"n":null}']
    jsonl.export_records(rows.select(F.to_json(F.struct("id")).alias("line")), f"{tmp_path}/text")
    assert spark.read.json(f"{tmp_path}/text").count() == 2


def test_source_tree_and_symbols(spark, tmp_path):
    for name, body in {"a/m.py": "import os\nclass C(B):\n    def f(self, x):\n        '''Doc.'''\n        return os.path.join(x)\n", "a/__pycache__/m.py": "", ".hid/x.py": "", "bad.py": "def (", "n.txt": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    rows = code.source_tree(spark, str(tmp_path)).withColumn("s", code.python_symbols("source"))
    got = {r.path: r.s for r in rows.collect()}
    assert set(got) == {"a/m.py", "bad.py"}
    good = got["a/m.py"]
    assert good.parse_error == "" and good.imports[0].module == "os" and good.classes[0].methods == ["f"] and good.functions[0].docstring == "Doc." and good.calls[0].callee == "os.path.join"
    assert got["bad.py"].parse_error.startswith("SyntaxError")
