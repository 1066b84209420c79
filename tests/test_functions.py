from pyspark.sql import functions as F

from millrace.functions import patches, text

PATCH = "--- a/x.py\n+++ b/x.py\n@@ -1,9 +1,1 @@ def f\n a\n-b\n+c\n+d\n--- a/y.py\n+++ /dev/null\n@@ -5 +4,7 @@\n-z\n"


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert value(spark, text.tokens(F.col("t")), t="QuerySet get_queryset aB9C HTTPServer") == ["query", "set", "get", "queryset", "b9", "httpserver"]
    assert value(spark, text.tokens(F.col("t")), t=None) == []


def test_paths_and_diffs(spark):
    assert value(spark, text.module_key(F.col("t")), t="a/b/__init__.py") == "a.b"
    assert value(spark, text.module_key(F.col("t")), t="__init__.py") == ""
    assert value(spark, text.diff_files(F.col("t")), t=PATCH) == ["x.py", "y.py"]
    assert value(spark, text.diff_files(F.col("t")), t=None) == []


def test_logs(spark):
    log = "a.py::test_x PASSED [1%]\na.py::T::test_y[1] FAILED\ntest_z (m.C)\nDoc line ... ok\ntest_w (m.C) ... FAIL\n"
    assert value(spark, text.pytest_results(F.col("t"), "PASSED"), t=log) == ["a.py::test_x"]
    assert value(spark, text.pytest_results(F.col("t"), "FAILED"), t=log) == ["a.py::T::test_y[1]"]
    assert value(spark, text.unittest_results(F.col("t"), "ok"), t=log) == ["test_z (m.C)"]
    assert value(spark, text.unittest_results(F.col("t"), "FAIL"), t=log) == ["test_w (m.C)"]


def test_other_text(spark):
    assert value(spark, text.numbered(F.col("t")), t="x\ny") == "   1 | x\n   2 | y"
    assert value(spark, text.without_fences(F.col("t")), t="```diff\n+a\n```") == "+a"
    assert value(spark, text.snake_case(F.col("t")), t="FieldName") == "field_name"
    assert value(spark, text.code_names(F.col("t")), t="see `a.b` and FieldName, do_it in x.y") == ["a.b", "FieldName", "do_it", "x.y"]


def test_hunks(spark):
    df = spark.createDataFrame([(1, PATCH), (2, ""), (3, None)], "id int, patch string")
    got = {(r.hunk, r.declared_old, r.declared_new, r.old, r.new) for r in patches.hunk_counts(df, "id", "patch").collect()}
    assert got == {(1, 9, 1, 2, 3), (2, 1, 7, 1, 0)}
    fixed = patches.repaired(df, "id", "patch").collect()
    assert [r.id for r in fixed] == [1]
    assert "@@ -1,2 +1,3 @@ def f" in fixed[0].patch and "@@ -5 +4,0 @@" in fixed[0].patch


def test_replaced_blocks(spark):
    content = "def f():\n    alpha = compute(1)\n    return alpha\n"
    rows = [
        (1, content, "alpha = compute(1)", "beta = 2"), (2, content, "alpha = compute( 1)\nreturn alpha", "  x = 1\n  return x"), (3, content, "something else entirely", "x"), (4, content, "  ", "x"),
        (5, "xay", "a", "o"), (6, None, "a", "o"), (7, content, None, "o"), (8, "a\nb", "a\nb\nc\nd", "o"), (9, "aa.bb.aa", "aa", None), (10, "one line of text\nother", "one line of texts", "new"),
    ]
    df = spark.createDataFrame(rows, "id int, content string, search string, replacement string").selectExpr("*", "'clash' as line", "'clash' as how")
    got = {r.id: (r.content, r.how) for r in patches.replaced_blocks(df, "id").collect()}
    assert got == {
        1: ("def f():\n    beta = 2\n    return alpha\n", "exact"), 2: ("def f():\n    x = 1\n    return x\n", "alike"), 3: ("", "missing"), 4: (content, "blank"),
        5: ("xoy", "exact"), 6: ("", "missing"), 7: (content, "blank"), 8: ("", "missing"), 9: (".bb.aa", "exact"), 10: ("new\nother", "alike"),
    }
    assert patches.replaced_blocks(df.limit(0), "id").count() == 0


def test_views_and_contexts(spark):
    log = "a\nb\nc\ntest FAILED\nd"
    assert value(spark, text.error_context(F.col("t"), 2), t=log) == "b\nc\ntest FAILED\nd"
    assert value(spark, text.error_context(F.col("t"), 2), t="a\nb\nc\n") == "b\nc"
    assert value(spark, text.view(F.col("t"), 1), t="x\ny\nz\n") == "   1 | x\n... [2 more lines truncated]"
    assert value(spark, text.context_view(F.col("t")), t='  1 | x = 1\n  2 | \"\"\"a\nb\"\"\"\n'.replace('\\"', '"')) == '  1 | x = 1\n  2 | """..."""'
    assert value(spark, text.test_module(F.col("t")), t="tests/test_a.py::T") == "tests/test_a.py::T"
    assert value(spark, text.test_module(F.col("t")), t="a.test_b.C.d") == "a.test_b"
    assert value(spark, text.test_module(F.col("t")), t="test_m (x.test_y.Z)") == "x.test_y"
    assert value(spark, text.test_target(F.col("t")), t="test_m (a.B)") == "a.B.test_m"
    assert value(spark, text.json_list(F.col("t")), t='["a", "b"]') == ["a", "b"] and value(spark, text.json_list(F.col("t")), t="no") == []
    assert value(spark, text.log_summary(F.col("t")), t="x\n1 passed\nFAILED y\n") == "1 passed\n---\nFAILED y"
    assert value(spark, text.log_summary(F.col("t")), t="x" * 1200) == "x" * 1000
