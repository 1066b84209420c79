"""Column functions over texts, paths, diffs and logs. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric words of two or more characters; camel case is cut, duplicates stay, anything else,
    accented letters included, separates. Null gives an empty list."""
    cut = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.split(cut, "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def path_tokens(path: Column) -> Column:
    """``tokens`` of a path, cut at slashes, dots and underscores as well."""
    return tokens(F.translate(path, "/_.", "   "))


def module_key(path: Column) -> Column:
    """The dotted module of a source path: without the extension and a trailing __init__; '' for the root one."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), F.lit("/"), F.lit(".")), r"(?:^|\.)__init__$", "")


def word_count(text: Column) -> Column:
    """Words between any white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def diff_files(patch: Column) -> Column:
    """Distinct paths of the file headers of a unified diff, without a/ and b/, in order of appearance; a path ends
    at white space. /dev/null is none."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^(?:\+\+\+|---)[ \t]+[ab]/([^\s]+)"), F.lit(1)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def count_lines(text: Column, pattern: str) -> Column:
    """How many lines match the pattern from their start."""
    return F.size(F.filter(lines(text), lambda x: x.rlike(pattern)))


def without_fences(text: Column) -> Column:
    """The text without the lines that open and close a code block."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^```[A-Za-z]*[ \t]*\n?", ""), r"^\s+|\s+$", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_"))


def pytest_results(log: Column, verdict: str) -> Column:
    """Test ids that a pytest log gives the verdict PASSED, FAILED or ERROR."""
    return F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(rf"(?m)^(\S+?::[A-Za-z0-9_:\[\]-]+)[ \t]+{verdict}\b"), F.lit(1))


def unittest_results(log: Column, verdict: str) -> Column:
    """Tests, as "name (class)", that a unittest log gives the verdict ok, FAIL or ERROR; one docstring line may
    stand between name and verdict."""
    return F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(rf"(?m)^(test_\w+ \([\w.]+\))(?:\n[^\n]+)? \.\.\. {verdict}\b"), F.lit(1))


def numbered(text: Column) -> Column:
    """The text's lines with their numbers, as a reading tool shows them."""
    return F.array_join(F.transform(lines(text), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def code_names(text: Column) -> Column:
    """Names of code that a text mentions: in back quotes, in camel case, in snake case, or dotted; distinct."""
    joined = [r"([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)", r"([a-z]+_[a-z0-9_]+)", r"([a-z_]+(?:\.[a-z_]+)+)"]
    rules = [r"`([A-Za-z_][\w.]*)`", *(rf"(?<![A-Za-z0-9_]){rule}(?![A-Za-z0-9_])" for rule in joined)]
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rule), F.lit(1)) for rule in rules]
    return F.array_distinct(F.concat(*found))


def hint_names(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Names that may be those of files an issue speaks of, in lower case and distinct: quoted .py names, names in back
    quotes, dotted paths of three or more parts (as a path, and their last part), snake case, words of seven or more
    letters, and camel case as snake case. Names of up to three characters and ``stopwords`` are none."""
    plain = F.coalesce(text, F.lit(""))
    low = F.lower(plain)
    every = lambda where, rule: F.regexp_extract_all(where, F.lit(rule), F.lit(1))
    dotted = every(low, r"\b([a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){2,})\b")
    found = F.concat(
        every(plain, r"[`'\"](\S+?)\.py[`'\"\s]"), every(low, r"`([a-z][a-z0-9_]{3,})`"), every(low, r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"), every(low, r"\b([a-z]{7,})\b"),
        F.transform(every(plain, r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), snake_case),
        F.transform(dotted, lambda x: F.replace(x, F.lit("."), F.lit("/"))), F.transform(dotted, lambda x: F.substring_index(x, ".", -1)),
    )
    names = F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: F.length(x) > 3))
    return F.array_except(names, F.array(*(F.lit(w) for w in stopwords))) if stopwords else names


def word_prefix(text: Column, n: int) -> Column:
    """The first ``n`` characters; '' for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def view(text: Column, most: int = 300) -> Column:
    """The first ``most`` lines with their numbers, and how many more there are."""
    all_lines = lines(F.regexp_replace(text, r"\n$", ""))
    more = F.size(all_lines) - most
    shown = numbered(F.array_join(F.slice(all_lines, 1, most), "\n"))
    return F.when(text == "", "").when(more > 0, F.concat(shown, F.lit("\n... ["), more.cast("string"), F.lit(" more lines truncated]"))).otherwise(shown)


def context_view(text: Column, most: int = 6500) -> Column:
    """A file as a prompt shows it: the first ``most`` characters without line numbers that stand there already,
    docstrings of several lines shortened to one, numbered again. Numbers are padded to three or more digits."""
    bare = F.regexp_replace(word_prefix(text, most), r"(?m)^\s*\d+\s*\|\s?", "")
    short = F.regexp_replace(bare, "(?s)(?:'''(?:(?!''').)*?\n.*?'''|\"\"\"(?:(?!\"\"\").)*?\n.*?\"\"\")", '"""..."""')
    rows = F.split(F.regexp_replace(short, r"\n$", ""), "\n")
    width = F.greatest(F.length(F.size(rows).cast("string")), F.lit(3))
    number = lambda i: F.concat(F.repeat(F.lit(" "), width - F.length((i + 1).cast("string"))), (i + 1).cast("string"))
    return F.when(short == "", "").otherwise(F.array_join(F.transform(rows, lambda x, i: F.concat(number(i), F.lit(" | "), x)), "\n"))


def error_context(log: Column, most: int = 20) -> Column:
    """The lines around the first one that names a failure, two before it and ``most`` from it on; the last ``most``
    lines of a log without any."""
    rows = F.split(F.regexp_replace(F.coalesce(log, F.lit("")), r"\n$", ""), "\n")
    marks = F.transform(rows, lambda x: F.contains(x, F.lit("FAILED")) | F.contains(x, F.lit("ERROR")) | F.contains(F.lower(x), F.lit("assert")))
    first = F.array_position(marks, F.lit(True)).cast("int")
    start = F.greatest(first - 2, F.lit(1))
    around = F.slice(rows, start, first + most - start)
    return F.array_join(F.when(first > 0, around).otherwise(F.slice(rows, F.greatest(F.size(rows) - most + 1, F.lit(1)), F.lit(most))), "\n")


def log_summary(log: Column, most: int = 40, fallback: int = 1000) -> Column:
    """What a test log sums up to: its lines with counts, then up to ``most`` lines of failures: those that begin with
    FAILED or name an error, and every line from the section of failures on (such a line twice, if it names an error as
    well). A log without either is cut to ``fallback`` characters."""
    rows = F.split(F.regexp_replace(F.coalesce(log, F.lit("")), r"\n$", ""), "\n")
    begin = F.array_position(F.transform(rows, lambda x: x.startswith("_ _ _ ") | F.contains(x, F.lit("FAILURES"))), F.lit(True)).cast("int")
    named = lambda x: x.startswith("FAILED") | F.contains(x, F.lit("Error"))
    none = F.array().cast("array<string>")
    kept = lambda x, i: F.concat(F.when(named(x), F.array(x)).otherwise(none), F.when((begin > 0) & (i + 1 >= begin), F.array(x)).otherwise(none))
    failures = F.slice(F.flatten(F.transform(rows, kept)), 1, most)
    counts = F.filter(rows, lambda x: x.rlike(r"\d+ (?:passed|failed|error)"))
    parts = F.when(F.size(failures) > 0, F.concat(counts, F.array(F.lit("---")), failures)).otherwise(counts)
    joined = F.array_join(parts, "\n")
    return F.when(joined == "", word_prefix(log, fallback)).otherwise(joined)


def tool_prompt(tool: Column, success: Column, output: Column, error: Column) -> Column:
    """A tool's result as a prompt shows it: a head, at most 3000 characters of output and 500 of the error."""
    status = F.when(success, "SUCCESS").otherwise("ERROR")
    head = F.concat(F.lit("[TOOL: "), F.coalesce(tool, F.lit("")), F.lit(" | "), status, F.lit("]"))
    return F.concat_ws("\n", head, F.when(output != "", word_prefix(output, 3000)), F.when(error != "", F.concat(F.lit("ERROR: "), word_prefix(error, 500))))


def json_list(text: Column) -> Column:
    """The strings of a JSON list; an empty list for what is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def test_target(test: Column) -> Column:
    """A test as its runner is called with it: "test_m (a.B)" becomes "a.B.test_m", other names stay."""
    return F.regexp_replace(test, r"^(test_\w+)\s+\(([\w.]+)\)$", "$2.$1")


def test_module(test: Column) -> Column:
    """The module of a test: what stands in brackets, else the name up to ::, cut behind its first part that begins
    with test_; a name without such a part stays whole."""
    inner = F.when(F.contains(test, F.lit(" (")), F.replace(F.element_at(F.split(test, r" \("), 2), F.lit(")"), F.lit(""))).otherwise(test)
    head = F.split(F.split(inner, "::")[0], r"\.")
    at = F.array_position(F.transform(head, lambda p: p.startswith("test_")), F.lit(True)).cast("int")
    return F.when(at > 0, F.array_join(F.slice(head, 1, F.greatest(at, F.lit(1))), ".")).otherwise(inner)


def safe_key(name: Column) -> Column:
    """A name as a key of a cache: without separators of paths and times."""
    return F.translate(name, "/:\\ ", "____")


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)
