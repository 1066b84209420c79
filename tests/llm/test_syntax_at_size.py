"""Sources that once ended the query by an error, and what it shuffles."""

import pytest

from millrace.llm import syntax


@pytest.mark.parametrize(("texts", "bad"), [
    (["async\n", "x = 1\nasync", "if x:\n    async ;\n", "async def f(): pass\n"], {0, 1, 2}),
    (["x = a" + ".b" * 20_000 + "\n", "x = a" + ".b" * 20_000 + ".\n", "x = " + "a, " * 20_000 + "b\n", "x = " + "(" * 3_000 + "1" + ")" * 3_000 + "\n"], {1}),
])
def test_lines_that_ended_the_query(spark, texts, bad):
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, source string").selectExpr("file_id", "'a.py' as file_path", "source")
    assert {r.file_id for r in syntax.unparsable_files(files).collect()} == bad


def test_tokens_stay_in_their_task(spark):
    """No window, sort or table of tokens: only sources and found files are shuffled."""
    files = spark.createDataFrame([(i, f"{i}.py", f"x = [{i}]\n" * 50 + ")" * (i % 7 == 0)) for i in range(300)], "file_id long, file_path string, source string")
    found = syntax.unparsable_files(files)
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert not [x for x in ("Window", "Sort ", "Generate", "FileScan") if x in plan]
    assert {r.file_id for r in found.collect()} == {i for i in range(300) if i % 7 == 0}


def test_files_meet_in_one_reduction_and_over_several(spark, monkeypatch):
    """What is found doesn't depend on which files are reduced together."""
    import pyarrow as pa

    texts = ["f(a=1, b)\n", "f(b, a=1)\n", "[t]\nx = 1\nx = 2\n", "[t]\nx = 1\n", "a ? b;\n", "a ? b : c;\n", ")\n", "", "x = [1]\n", "[1, 2}", "try:\n    pass\n"] * 3
    languages = ["python", "python", "toml", "toml", "javascript", "javascript", "python", "python", "python", "json", "python"] * 3
    batch = pa.RecordBatch.from_pydict({"file_id": list(range(len(texts))), "language": languages, "source": texts})
    allowed = {r.pair for r in syntax.permitted(spark).collect()}
    results = []
    for tokens in (1, 40, 1 << 18):
        monkeypatch.setattr(syntax, "TOKENS", tokens)
        rows = [r for b in syntax.file_pairs(iter([batch])) for r in b.to_pylist()]
        results.append({r["file_id"] for r in rows if r["pair"] not in allowed})
    assert results[0] == results[1] == results[2] == {i for i in range(len(texts)) if i % 11 in (0, 2, 4, 6, 9, 10)}
