"""Trees of source files, and the symbols of Python sources."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = (
    "struct<module_docstring:string,parse_error:string,imports:array<struct<module:string,names:array<string>,is_from:boolean,alias:string>>,"
    "functions:array<struct<name:string,args:array<string>,decorators:array<string>,docstring:string,start_line:int,end_line:int,is_async:boolean>>,"
    "classes:array<struct<name:string,bases:array<string>,methods:array<string>,docstring:string,start_line:int,end_line:int>>,"
    "calls:array<struct<callee:string,line:int>>>"
)


def source_tree(spark: SparkSession, root: str, pattern: str = "*.py", exclude: str = r"/__pycache__/|/\.[^/]+") -> DataFrame:
    """(path, file_hash, source) of the files below ``root`` whose name matches; paths below it that match ``exclude``
    are left out. Bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    below = F.regexp_replace("path", f"^(?:[a-z]+:)?/*{root.strip('/')}", "")
    return files.where(~below.rlike(exclude)).select(F.ltrim(below, F.lit("/")).alias("path"), F.sha2("content", 256).alias("file_hash"), F.decode("content", "UTF-8").alias("source"))


def symbols_of(source: str | None) -> dict:
    """Definitions, imports and calls of one Python source; of a source that doesn't parse only the error."""
    found: dict = {"module_docstring": "", "parse_error": "", "imports": [], "functions": [], "classes": [], "calls": []}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return found | {"parse_error": f"{type(error).__name__}: {error}"}
    found["module_docstring"] = ast.get_docstring(tree) or ""
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found["imports"] += [{"module": a.name, "names": [], "is_from": False, "alias": a.asname or ""} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found["imports"].append({"module": "." * node.level + (node.module or ""), "names": [a.name for a in node.names], "is_from": True, "alias": ""})
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found["functions"].append({
                "name": node.name, "args": [a.arg for a in node.args.args], "decorators": [ast.unparse(d) for d in node.decorator_list], "docstring": ast.get_docstring(node) or "",
                "start_line": node.lineno, "end_line": node.end_lineno, "is_async": isinstance(node, ast.AsyncFunctionDef),
            })
        elif isinstance(node, ast.ClassDef):
            methods = [m.name for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            found["classes"].append({"name": node.name, "bases": [ast.unparse(b) for b in node.bases], "methods": methods, "docstring": ast.get_docstring(node) or "", "start_line": node.lineno, "end_line": node.end_lineno})
        elif isinstance(node, ast.Call):
            found["calls"].append({"callee": ast.unparse(node.func)[:100], "line": node.lineno})
    return found


def python_symbols(source: Column | str) -> Column:
    """The symbols of Python sources as a nested column."""

    @F.pandas_udf(SYMBOLS)
    def parse(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([symbols_of(text) for text in sources], columns=["module_docstring", "parse_error", "imports", "functions", "classes", "calls"], dtype=object)

    return parse(source)
