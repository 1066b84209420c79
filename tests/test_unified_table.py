import json

import pytest

from millrace.operators import schema_drift

SCHEMA = "series string, source_file string, file_seq int, line_no int, line string, name string"


def lines(spark, files):
    rows = [(s, f"{s}{q}.jsonl", q, n, json.dumps(make(n)) if callable(make) else make[n], "clash") for s, q, make in files for n in range(12 if callable(make) else len(make))]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.union(df)


def issue(k):
    return f"owner__repo-{k}"


def test_a_name_of_two_meanings(spark):
    """One series calls its tasks id first, another its instances; a third has both."""
    files = [
        ("A", 1, lambda n: {"id": f"T-{n}", "patch": "--- a"}), ("A", 2, lambda n: {"task_id": f"T-{n + 50}", "patch": "--- a"}),
        ("B", 1, lambda n: {"id": issue(n), "patch": "--- b"}), ("B", 2, lambda n: {"instance_id": issue(n + 9), "patch": "--- b"}),
        ("C", 1, lambda n: {"task_id": f"T-{n}", "instance_id": issue(n), "patch": "--- c"}),
    ]
    got = {(r.source_file, r.line_no): r for r in schema_drift.unified_table(lines(spark, files)).collect()}
    assert len(got) == 60
    for n in range(12):
        assert (got["A1.jsonl", n].task_id, got["A1.jsonl", n].instance_id) == (f"T-{n}", None)
        assert (got["A2.jsonl", n].task_id, got["A2.jsonl", n].instance_id) == (f"T-{n + 50}", None)
        assert (got["B1.jsonl", n].task_id, got["B1.jsonl", n].instance_id) == (None, issue(n))
        assert (got["C1.jsonl", n].task_id, got["C1.jsonl", n].instance_id) == (f"T-{n}", issue(n))
    assert all(r.rest == {} for r in got.values())


def test_a_rename_names_other_series_as_well(spark):
    files = [("A", 1, lambda n: {"uid": issue(n), "patch": "x"}), ("A", 2, lambda n: {"instance_id": issue(n + 5), "patch": "x"}), ("A", 3, lambda n: {"instance_id": issue(n), "patch": "x"}), ("B", 1, lambda n: {"uid": issue(n), "patch": "y"})]
    got = schema_drift.unified_table(lines(spark, files)).collect()
    assert all(r.instance_id.startswith("owner__repo-") and r.rest == {} for r in got)


def test_no_value_is_lost(spark):
    """Stray fields, nulls, two fields under one name, an empty object, blank and broken lines."""
    mixed = ['{"uid": "owner__repo-1", "instance_id": "owner__repo-2", "patch": "x"}', '{"instance_id": null, "uid": "owner__repo-3", "n": 1}', "{}", "", "{oops", '{"other": [1, null]}', None]
    files = [("A", 1, lambda n: {"uid": issue(n), "patch": "x"}), ("A", 2, lambda n: {"instance_id": issue(n + 5), "patch": "x"}), ("A", 3, mixed)]
    got = {r.line_no: r for r in schema_drift.unified_table(lines(spark, files)).where("file_seq = 3").collect()}
    values = {k: sorted(v for v in [r.task_id, r.instance_id, r.patch, *r.rest.values()] if v is not None) for k, r in got.items()}
    assert values == {0: ["owner__repo-1", "owner__repo-2", "x"], 1: ["1", "owner__repo-3"], 5: ["[1,null]"]}
    assert schema_drift.unified_table(lines(spark, files).limit(0)).count() == 0


@pytest.mark.parametrize("column", ["series", "source_file", "line"])
def test_null_columns(spark, column):
    df = lines(spark, [("A", 1, lambda n: {"a": n}), ("A", 2, lambda n: {"a": n})]).withColumn(column, schema_drift.F.lit(None).cast("string"))
    assert schema_drift.schema_changes(df).count() == 0
    assert schema_drift.unified_table(df).count() >= 0
