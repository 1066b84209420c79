"""Queries that once read a twentieth of the entries, or the first characters of a text: every entry and the whole text count."""

import hashlib

import pytest

from millrace.operators import dataset
from millrace.plans import catalog
from tests.oracle import compare

SYMBOLS = """file_id long, file_path string, parse_error string, module_docstring string,
functions array<struct<name:string,qualified_name:string,args:array<string>,decorators:array<string>,docstring:string,start_line:int,end_line:int,is_async:boolean,is_method:boolean>>,
classes array<struct<name:string,bases:array<string>,methods:array<string>,docstring:string,start_line:int,end_line:int>>,
imports array<struct<module:string,names:array<string>,is_from:boolean,alias:string>>"""
LONG = "copper window " * 40
ENTRIES = [
    (7, "the lantern is broken", "--- a/x/one.py\n+++ b/x/one.py\n"), (9, "the lantern is broken", "+++ b/two.py\n+++ b/one.py\n"), (20, "copper copper", "+++ b/q/one.py\n"), (20, "lantern", None),
    (21, None, "+++ b/one.py\n"), (22, "nothing known", "+++ b/three.py\n"), (23, "the lantern is broken", None), (None, "lantern", "+++ b/one.py\n"), (9, "the lantern is broken", "+++ b/two.py\n+++ b/one.py\n"),
]
#: File 4 has two paths, file 5 none.
DOCS = [(1, "a/one.py", LONG + "first"), (2, "b/one.py", LONG + "second"), (3, "c/two.py", "lantern"), (4, "c/one.py", "lantern lantern"), (4, "d/two.py", "lantern lantern"), (5, None, "lantern"), (6, "e/more.py", "lantern lamp"), (6, "e/more.py", "lantern lamp")]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(ENTRIES, "entry_id long, problem_statement string, patch string").write.parquet(str(tmp_path / "trajectories.parquet"))
    spark.createDataFrame([(*d, [], [], []) for d in DOCS], SYMBOLS.replace("parse_error string, module_docstring string", "module_docstring string")).selectExpr("*", "'' as parse_error").write.parquet(str(tmp_path / "file_symbols.parquet"))
    sources = [(1, "a/one.py", "Lanterns and lantern = copper"), (2, "b/two.py", "lantern"), (3, "c/test_one.py", "lantern"), (4, "d/four.py", "copperplate copper"), (5, "e/none.py", None), (6, "f/six.py", "lantern or broken"), (6, "f/six.py", "lantern or broken")]
    spark.createDataFrame(sources, "file_id long, file_path string, source string").write.parquet(str(tmp_path / "source_files.parquet"))
    return str(tmp_path)


def test_hard_negatives_of_every_entry_and_whole_summaries(spark, tables):
    got = catalog.QUERIES["hard_negatives"](spark, tables).collect()
    own = lambda entry: {(r.gold_id, r.file_id, r.label) for r in got if r.entry_id == entry}
    assert own(7) == {(g, g, 1) for g in (1, 2, 4)} | {(g, d, 0) for g in (1, 2, 4) for d in (3, 6)}
    assert own(9) == {(g, g, 1) for g in (1, 2, 3, 4)} | {(g, 6, 0) for g in (1, 2, 3, 4)}
    assert own(21) == own(None) == {(g, g, 1) for g in (1, 2, 4)}
    assert {r.entry_id for r in got} == {7, 9, 20, 21, None}
    # Three empty lists of symbols follow the docstring.
    assert {(r.file_id, r.digest) for r in got if r.file_id < 3} == {(d, hashlib.sha256(f"{text}   ".encode()).hexdigest()) for d, _, text in DOCS[:2]}
    compare(spark, tables, catalog.QUERIES["hard_negatives"], catalog.ORACLES["hard_negatives"])


def test_names_dealt_over_tasks(spark, tables, monkeypatch):
    """However few pairs a task may make, the same rows."""
    monkeypatch.setattr(dataset, "PAIRS", 2)
    compare(spark, tables, catalog.QUERIES["hard_negatives"], catalog.ORACLES["hard_negatives"])


def test_keyword_files_of_every_entry(spark, tables):
    got = {(r.entry_id, r.rank): (r.file_id, r.n) for r in catalog.QUERIES["keyword_files"](spark, tables).collect()}
    broken = {(e, r): x for e in (7, 9, 23) for r, x in enumerate([(1, 2), (6, 2), (2, 1)], 1)}
    copper = {(20, r): x for r, x in enumerate([(1, 3), (4, 2), (2, 1)], 1)}
    alone = {(None, r): x for r, x in enumerate([(1, 2), (2, 1), (6, 1)], 1)}
    assert got == broken | copper | alone
    compare(spark, tables, catalog.QUERIES["keyword_files"], catalog.ORACLES["keyword_files"])
