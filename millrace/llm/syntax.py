"""Source files that don't parse in the language of their extension.

Every file is lexed into tokens. A file is suspected if a token is no token of the language, if two tokens
stand side by side that the grammar never permits there (an anti-join with the permitted pairs, by the innermost
open bracket, which a running depth gives), if brackets don't nest, if a statement has the form of no
production, or if what a running reduction carries along speaks against it: the order of arguments, choices without
their other part, keys given twice. No parser is asked; the tests hold the rules against the languages' own.

The tokens of many files stand side by side in arrays, and running sums, fills and reductions over their segments
take the part of windows, in the task that lexes them: only the distinct pairs of a file become rows, and no token is
shuffled, sorted by a task or written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import lexers
from millrace.llm.splits import normal_repo, repository_names

OPENERS = ["(", "[", "{", "h[", "(c", "(f", "{b", "{t", "{f", "{e", "{k", "{o", "{i", "{x"]
CLOSERS = [")", "]", "}", "h]", ")c", ")f", "}b", "}t", "}f", "}e", "}k", "}o", "}i", "}x"]
#: Files are reduced together until they have so many tokens.
TOKENS = 1 << 18
#: The pair of a fault that is no pair of tokens; so many forms of lines are kept by a worker.
FAULT, FORMS = -1, 1 << 16


class Codes(dict):
    """Numbers of kinds of tokens; a kind that no grammar permits anywhere has 0."""

    def __missing__(self, kind: str) -> int:
        return 0


LANGUAGES = sorted(lexers.LEXERS)
NAMES = ["", *sorted({k for _, _, *pair in lexers.permitted_pairs() for k in pair} | {*OPENERS, *CLOSERS, "BOF", "EOF", "NL"})]
CODE = Codes({kind: i for i, kind in enumerate(NAMES) if i})
CONTEXTS = {context: i for i, context in enumerate(["", *OPENERS])}
PYTHON, JAVASCRIPT, TOML = (LANGUAGES.index(x) for x in ("python", "javascript", "toml"))
STEP, CONTEXT = np.zeros(len(NAMES), np.int64), np.zeros(len(NAMES), np.int64)
STEP[[CODE[k] for k in OPENERS]], STEP[[CODE[k] for k in CLOSERS]] = 1, -1
CONTEXT[[CODE[k] for k in OPENERS]] = [CONTEXTS[k] for k in OPENERS]
PAIRS = len(LANGUAGES) * len(CONTEXTS) * 2 * len(NAMES) ** 2
CLAUSES = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "try", "except"), "except": ("try", "except"), "finally": ("try", "except", "else")}
STATEMENT = re.compile(lexers.PY_STATEMENT)
COMPOUND = {"if", "elif", "else", "while", "for", "with", "async", "def", "class", "try", "except", "finally", "soft"}


def language_of(path: Column) -> Column:
    """python, javascript, json or toml by the extension in any letter case; null for any other."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)\s*$", 1))
    pairs = [F.lit(x) for item in lexers.LANGUAGES.items() for x in item]
    return F.create_map(*pairs)[extension]


def source_rows(files: DataFrame) -> DataFrame:
    """(file_id, language, source) with a source and a known language, dealt over the tasks by a hash: what is read is small
    beside the work on it, so the tasks aren't made by its size."""
    rows = files.select("file_id", language_of(F.col("file_path")).alias("language"), "source").where("file_id is not null and source is not null and language is not null")
    return rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id", "source")


def pair_code(language, context, line_break, kind, following):
    """The number of a pair of tokens, from the numbers of its parts; arrays or single ones."""
    return (((language * len(CONTEXTS) + context) * 2 + line_break) * len(NAMES) + kind) * len(NAMES) + following


def permitted(spark: SparkSession) -> DataFrame:
    """(pair) of all grammars, a table of fixed size. A plus behind a context marks a line break."""
    rows = ((LANGUAGES.index(language), context.rstrip("+"), context.endswith("+"), CODE[kind], CODE[following]) for language, context, kind, following in lexers.permitted_pairs())
    codes = {pair_code(language, CONTEXTS[context], line_break, kind, following) for language, context, line_break, kind, following in rows if context in CONTEXTS}
    return spark.createDataFrame(pa.table({"pair": pa.array(sorted(codes), pa.int32())}))


class Tokens(NamedTuple):
    """Arrays over the tokens of files that stand one behind the other: number of the file, language, kind, what the lexer says
    besides, how many brackets are open behind the token, and the place of the innermost of them (-1 for none).
    ``first`` has the place where each file begins."""

    file: np.ndarray
    language: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    depth: np.ndarray
    open_at: np.ndarray
    first: np.ndarray

    def places(self, language: int, *kinds: str) -> np.ndarray:
        return np.flatnonzero((self.language == language) & among(self.kind, *kinds))


def among(kind: np.ndarray, *kinds: str) -> np.ndarray:
    known = np.zeros(len(NAMES), bool)
    known[[CODE[k] for k in kinds]] = True
    return known[kind]


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where the segments of equal ``keys`` begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def running(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Running sums of ``values`` within the segments that start at ``begin``."""
    total = np.cumsum(values, dtype=np.int64)
    return total - np.repeat(total[begin] - values[begin], np.diff([*begin, len(values)]))


def nested(language: np.ndarray, length: np.ndarray, kind: np.ndarray, at: np.ndarray) -> Tokens:
    """The tokens with their depth, by a running sum, and the innermost open bracket, the last one that opened this depth.
    ``language`` and ``length`` are by file."""
    file, first = np.repeat(np.arange(len(length)), length), np.cumsum(length) - length
    step = STEP[kind]
    depth = running(step, first)
    place = np.flatnonzero(step)
    # The brackets by file and depth; behind each the last opening one of its depth.
    level = file[place] * (2 * len(kind) + 1) + depth[place] + len(kind)
    order = np.argsort(level, kind="stable")
    opening = np.maximum.accumulate(np.where(step[place[order]] > 0, np.arange(len(order)), -1))
    same = (opening >= 0) & (level[order[opening]] == level[order]) & (depth[place[order]] > 0)
    innermost = np.empty(len(place), np.int64)
    innermost[order] = np.where(same, place[order[opening]], -1)
    # Up to the next bracket it stays.
    last = np.cumsum(step != 0) - 1
    own = last >= 0
    own[own] = file[place[last[own]]] == file[own]
    open_at = np.full(len(kind), -1)
    open_at[own] = innermost[last[own]]
    return Tokens(file, np.repeat(language, length), kind, at, depth, open_at, first)


def side_by_side(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(files, pairs): the distinct pairs of each file, and FAULT where more brackets closed than were open. The permitted
    pairs name a closing bracket only in the context of its opening one, so an unequal or missing partner is an
    unpermitted pair, too."""
    left = np.flatnonzero(t.file[1:] == t.file[:-1])
    context = np.where(t.open_at[left] >= 0, CONTEXT[t.kind[t.open_at[left]]], 0)
    pair = pair_code(t.language[left], context, (t.language[left] == JAVASCRIPT) & (t.at[left + 1] == 1), t.kind[left], t.kind[left + 1])
    seen = np.unique(t.file[left] * PAIRS + pair)
    below = np.unique(t.file[left[t.depth[left] < 0]])
    return np.concatenate([seen // PAIRS, below]), np.concatenate([seen % PAIRS, np.full(len(below), FAULT)])


def form_of(form: str) -> tuple[str, bool, bool]:
    """Of the kinds of a line's tokens: the first word, whether it ends in a colon, and whether it is the form of no production
    or, as a simple statement, has an if without its else. Simple statements may share a line."""
    words = form.split(" ")
    opens = form.endswith(":")
    off = not STATEMENT.search(form) and not all(STATEMENT.search(x) for x in form.removesuffix(" ;").split(" ; "))
    unequal = not opens and words[0] not in COMPOUND and words.count("if") != words.count("else")
    return words[1] if words[0] == "async" and len(words) > 1 else words[0], opens, off or unequal


def blocks_fault(lines: list[tuple[int, str, bool]]) -> bool:
    """Whether the lines of a file, each its indent, first word and whether it opens a block, have a wrong indent or an
    unpaired clause.

    They are reduced in order to the stack of open indents, each with the first word of the last statement at that
    indent: a line that ends in a colon must be followed by a deeper one and no other may be, an indent must return to an
    open one, a clause needs its statement before it, try needs a handler, and a decorator a definition.
    """
    stack, expects = [(0, "")], False
    for indent, word, opens in lines:
        if (indent > stack[-1][0]) != expects:
            return True
        if expects:
            stack.append((indent, ""))
        while stack and stack[-1][0] > indent:
            if stack.pop()[1] in ("try", "@"):
                return True
        if not stack or stack[-1][0] != indent:
            return True
        before = stack[-1][1]
        if word in CLAUSES:
            if before not in CLAUSES[word]:
                return True
        elif before == "try" or (before == "@" and word not in ("@", "def", "class")):
            return True
        stack[-1], expects = (indent, word), opens
    return expects or any(word in ("try", "@") for _, word in stack)


def line_faults(t: Tokens, known: dict[bytes, tuple[str, bool, bool]]) -> set[int]:
    """Python files with a line of no production, a wrong indent, an unpaired clause, or a choice without its else.

    A logical line is told by the tokens outside of brackets and the opening brackets among them. ``known`` keeps what
    ``form_of`` says of a form.
    """
    line = np.cumsum((t.language == PYTHON) & (t.at >= 0))
    outer = (t.language == PYTHON) & ((t.depth == 0) | ((t.depth == 1) & among(t.kind, "(", "[", "{"))) & ~among(t.kind, ")", "]", "}", "NL", "BOF", "EOF")
    place = np.flatnonzero(outer)
    if not len(place):
        return set()
    begin = starts(t.file[place], line[place])
    kinds, ends = t.kind[place].astype(np.uint16).tobytes(), [*begin[1:].tolist(), len(place)]
    faults, lines, now = set(), [], -1
    for file, indent, a, b in zip(t.file[place[begin]].tolist(), np.maximum.reduceat(t.at[place], begin).tolist(), begin.tolist(), ends):
        if file != now:
            if blocks_fault(lines):
                faults.add(now)
            lines, now = [], file
        form = kinds[2 * a : 2 * b]
        if form not in known:
            if len(known) >= FORMS:
                known.clear()
            known[form] = form_of(" ".join(NAMES[k] or "ERR" for k in np.frombuffer(form, np.uint16)))
        word, opens, wrong = known[form]
        if wrong:
            faults.add(file)
        lines.append((indent, word, opens))
    return faults | {now} if blocks_fault(lines) else faults


def argument_faults(t: Tokens) -> set[int]:
    """Python files that call with a positional argument behind a keyword, or with one behind a ** mapping, or
    declare a parameter without a default behind one that has it.

    The tokens of a round bracket are cut into items by its own commas, a running count over the bracket; an item is told by
    its first token, and running counts over the items of a bracket carry whether a keyword came before.
    """
    inside = np.flatnonzero((t.language == PYTHON) & (t.open_at >= 0) & (t.kind[t.open_at] == CODE["("]) & (t.kind != CODE["("]))
    inside = inside[np.argsort(t.open_at[inside], kind="stable")]
    item = np.cumsum(t.kind[inside] == CODE[","])
    kept = ~among(t.kind[inside], ",", ")", "]", "}")
    inside, item = inside[kept], item[kept]
    if not len(inside):
        return set()
    begin = starts(t.open_at[inside], item)
    first, bracket = t.kind[inside[begin]], t.open_at[inside[begin]]
    named = np.logical_or.reduceat(t.kind[inside] == CODE["="], begin)
    other = np.logical_or.reduceat(among(t.kind[inside], "for", "lambda"), begin)
    # What stands before the bracket, and the first token of its logical line.
    file_at, head = t.first[t.file[bracket]], np.maximum.accumulate(np.where((t.language == PYTHON) & (t.at >= 0), np.arange(len(t.at)), -1))[bracket]
    before, before2 = (np.where(bracket - n >= file_at, t.kind[bracket - n], 0) for n in (1, 2))
    generic = (before == CODE["]"]) & (head >= file_at) & among(t.kind[head], "def", "async", "class")
    made = before2 == CODE["def"]
    call = ~made & among(before, "id", ")", "]") & ~generic
    by_bracket = starts(bracket)
    seen = lambda flag: running(flag.astype(np.int64), by_bracket) - flag > 0
    after_name, after_map, after_star = seen(named & ~other), seen(first == CODE["**"]), seen(first == CODE["*"])
    plain = ~named & ~other & ~among(first, "*", "**", "/")
    wrong_call = call & ((plain & (after_name | after_map)) | ((first == CODE["*"]) & after_map))
    # In a definition a bare star begins the keyword-only part, where any order holds.
    wrong_made = made & ((plain & after_name & ~after_star) | after_map)
    return set(t.file[bracket[wrong_call | wrong_made]].tolist())


def choice_faults(t: Tokens) -> set[int]:
    """JavaScript files in one of whose brackets, or outside of all, question marks and their colons aren't
    equally many, or more else than if came so far."""
    place = t.places(JAVASCRIPT, "?", ":t", "if", "else")
    if not len(place):
        return set()
    bracket = np.where(t.open_at[place] >= 0, t.open_at[place], -1 - t.file[place])
    order = np.argsort(bracket, kind="stable")
    place, begin = place[order], starts(bracket[order])
    is_ = {k: (t.kind[place] == CODE[k]).astype(np.int64) for k in ("?", ":t", "if", "else")}
    unequal = np.add.reduceat(is_["?"] - is_[":t"], begin) != 0
    early = np.minimum.reduceat(running(is_["if"] - is_["else"], begin), begin) < 0
    return set(t.file[place[begin[unequal | early]]].tolist())


def toml_faults(t: Tokens) -> set[int]:
    """TOML files that give a key twice, or a table.

    Running counts number the lines and the tables outside of brackets; the keys of a line up to its sign of equality are
    the path of a value, those in a header that of a table. A path may occur once in its table, or inline table, and the
    header of a plain table once between two headers of arrays of tables.
    """
    place = t.places(TOML, "NL", ",", "h[", "key")
    header, key = CODE["h["], CODE["key"]
    faults, now, paths, lines, table, arrays = set(), -1, {}, {}, 0, 0

    def twice() -> bool:
        values = [(*where[::2], tuple(path)) for where, (path, _, _) in paths.items() if not where[1]]
        tables = [(count, tuple(path)) for where, (path, deep, count) in paths.items() if where[1] and deep == 1]
        return len(set(values)) < len(values) or len(set(tables)) < len(tables)

    for file, kind, at, depth, open_at in zip(*(x[place].tolist() for x in (t.file, t.kind, t.at, t.depth, t.open_at))):
        if file != now:
            if twice():
                faults.add(now)
            now, paths, lines, table, arrays = file, {}, {}, 0, 0
        if kind == header:
            table += depth == 1
            arrays += depth == 2
        if kind != key:
            lines[open_at] = lines.get(open_at, 0) + 1
            continue
        path, deep, _ = paths.get(where := (open_at, open_at >= 0 and bool(t.kind[open_at] == header), table, lines.get(open_at, 0)), ([], 0, 0))
        paths[where] = ([*path, at], max(deep, depth), arrays)
    return faults | {now} if twice() else faults


def file_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, pair) of ``source_rows``: the distinct pairs of tokens of each source, and FAULT if a rule speaks against it.
    Files are reduced some at a time, so a task holds few of their tokens at once, however many it has."""
    forms: dict[bytes, tuple[str, bool, bool]] = {}
    for batch in batches:
        sources, languages = batch.column("source"), batch.column("language").to_pylist()
        begin, kind, at, length = 0, [], [], []
        for i, language in enumerate(languages):
            kinds, ats = zip(*lexers.LEXERS[language](sources[i].as_py()))
            kind.extend(map(CODE.__getitem__, kinds))
            at.extend(ats)
            length.append(len(kinds))
            if len(kind) < TOKENS and i + 1 < len(languages):
                continue
            t = nested(np.array([LANGUAGES.index(x) for x in languages[begin : i + 1]]), np.array(length), np.array(kind), np.array(at))
            file, pair = side_by_side(t)
            faults = sorted(line_faults(t, forms) | argument_faults(t) | choice_faults(t) | toml_faults(t))
            file, pair = np.concatenate([file, np.array(faults, np.int64)]), np.concatenate([pair, np.full(len(faults), FAULT)])
            yield pa.RecordBatch.from_arrays([batch.column("file_id").take(pa.array(begin + file)), pa.array(pair.astype(np.int32))], ["file_id", "pair"])
            begin, kind, at, length = i + 1, [], [], []


def unparsable_files(files: DataFrame) -> DataFrame:
    """(file_id) of the files whose source doesn't parse in the language of its extension.

    ``files`` has file_id, file_path and source; more columns are ignored. Null sources and other extensions are no
    cases, repeated rows count once, an empty source is a case only in JSON. No file is cut: one file's tokens
    stay in one task.
    """
    rows = source_rows(files)
    pairs = rows.mapInArrow(file_pairs, f"file_id {dict(rows.dtypes)['file_id']}, pair int")
    return pairs.join(F.broadcast(permitted(files.sparkSession)), "pair", "left_anti").select("file_id").distinct()


def parse_flags(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(file_id, repo, language, broken, reported) of every distinct file with a source; ``reported`` says whether
    ``symbols``(file_id, parse_error) names an error for it."""
    rows = files.where("file_id is not null and source is not null").select("file_id", normal_repo(F.col("repo")).alias("repo"), F.coalesce(language_of(F.col("file_path")), F.lit("other")).alias("language")).distinct()
    broken = unparsable_files(files).withColumn("broken", F.lit(True))
    flags = rows.join(broken, "file_id", "left").withColumn("broken", F.coalesce("broken", F.lit(False)))
    if symbols is None:
        return flags.withColumn("reported", F.lit(None).cast("boolean"))
    named = symbols.groupBy("file_id").agg(F.max(F.trim(F.coalesce("parse_error", F.lit(""))) != "").alias("reported"))
    return flags.join(named, "file_id", "left")


def parse_rates(files: DataFrame, moves: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(repo, language, n_files, n_broken, n_reported, rate); repositories under their common name, '?' if unknown."""
    homes = repository_names(moves)
    flags = parse_flags(files, symbols).join(homes, "repo", "left").withColumn("repo", F.coalesce("home", "repo", F.lit("?")))
    return flags.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("broken")).alias("n_broken"), F.count_if(F.col("reported")).alias("n_reported")
    ).withColumn("rate", F.round(F.col("n_broken") / F.col("n_files"), 6))
