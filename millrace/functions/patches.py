"""Unified diffs as rows of lines, repaired hunk headers, and blocks of text found again and replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"
#: A block counts as found again if its lines are on average more alike than this.
ALIKE = 0.85


def hunk_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """One row per line of each patch: (key, place, line, hunk), where hunk counts the headers so far, 0 before any."""
    lines = patches.where(F.col(patch) != "").select(key, F.posexplode(F.split(F.regexp_replace(patch, r"\n$", ""), "\n")).alias("place", "line"))
    so_far = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("hunk", F.sum(F.when(F.col("line").rlike(HEADER), 1).otherwise(0)).over(so_far))


def hunk_counts(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, hunk, declared_old, declared_new, old, new): the lines that each hunk's header declares and those it has."""
    rows = hunk_lines(patches, key, patch).where("hunk > 0")
    header = F.when(F.col("line").rlike(HEADER), F.col("line"))
    body = header.isNull() & ~F.col("line").startswith("\\") & ~F.col("line").rlike("^(?:diff --git |index |--- |\\+\\+\\+ )")
    found = rows.groupBy(key, "hunk").agg(F.max(header).alias("h"), F.count_if(body & ~F.col("line").startswith("+")).alias("old"), F.count_if(body & ~F.col("line").startswith("-")).alias("new"))

    def declared(group: int) -> Column:
        text = F.regexp_extract("h", HEADER, group)
        return F.when(text == "", 1).otherwise(text.try_cast("bigint"))

    return found.select(key, F.col("hunk").cast("bigint").alias("hunk"), declared(2).cast("bigint").alias("declared_old"), declared(4).cast("bigint").alias("declared_new"), "old", "new")


def repaired(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, patch) with the counts of every hunk header set to the lines that follow; a count of one is left out."""
    lines, counts = hunk_lines(patches, key, patch), hunk_counts(patches, key, patch)
    part = lambda n: F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string")))
    start = [F.regexp_extract("line", HEADER, g) for g in (1, 3, 5)]
    fixed = F.concat(F.lit("@@ -"), start[0], part(F.col("old")), F.lit(" +"), start[1], part(F.col("new")), F.lit(" @@"), start[2])
    rows = lines.join(counts.select(key, "hunk", "old", "new"), [key, "hunk"], "left").withColumn("line", F.when(F.col("line").rlike(HEADER), fixed).otherwise(F.col("line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias(patch))


def line_likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: how much of the longer of two lines stays without edits."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def found_blocks(edits: DataFrame, key: str) -> DataFrame:
    """(key, start, likeness): where the lines of ``search`` stand best in ``content``, and how alike they are there.

    Lines are compared without white space around them, each with the one at the same place of the block. Lines of
    both that are equal propose where the block may begin; texts that share none try every place. The likeness of a place
    is the mean over the block's lines, and a line beyond the end counts nothing. The earliest of equal places is taken.
    """
    trimmed = lambda c: F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    block = F.regexp_replace("search", r"^\n+|\n+$", "")
    rows = edits.where(F.trim("search") != "").select(key, trimmed(F.col("content")).alias("have"), trimmed(block).alias("want"))
    have = rows.select(key, F.posexplode("have").alias("place", "line"))
    want = rows.select(key, F.posexplode("want").alias("offset", "line"))
    shared = have.where("line <> ''").join(want, [key, "line"]).select(key, (F.col("place") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    lone = rows.join(shared.select(key).distinct(), key, "left_anti").select(key, F.explode(F.sequence(F.lit(0), F.greatest(F.size("have") - F.size("want"), F.lit(0)))).alias("start"))
    tried = rows.join(shared.unionByName(lone), key).where(F.col("start") + F.size("want") <= F.size("have"))
    alike = F.zip_with(F.slice("have", F.col("start") + 1, F.size("want")), F.col("want"), line_likeness)
    mean = F.aggregate(alike, F.lit(0.0), lambda s, x: s + x) / F.size("want")
    scored = tried.select(key, "start", F.round(mean, 6).alias("likeness"))
    return scored.groupBy(key).agg(F.max(F.struct("likeness", (-F.col("start")).alias("_s"))).alias("best")).select(key, (-F.col("best._s")).alias("start"), "best.likeness")


def replaced_blocks(edits: DataFrame, key: str, least: float = ALIKE) -> DataFrame:
    """(key, content, how) of ``edits``(key, content, search, replacement), one row per key.

    A blank search leaves the content as it is (how = 'blank'). Where the search stands in the content, its first
    occurrence is replaced ('exact'); else the lines that ``found_blocks`` finds, if they are more alike than
    ``least``, by the replacement at the indent of the first of them ('alike'); else the content is '' ('missing').
    """
    rows = edits.select(key, *(F.coalesce(c, F.lit("")).alias(c) for c in ("content", "search", "replacement")))
    at = F.instr("content", F.col("search"))
    how = F.when(F.trim("search") == "", "blank").when(at > 0, "exact")
    rows = rows.withColumns({"how": how, "at": at})
    best = found_blocks(rows.where("how is null"), key).where(F.col("likeness") > least)
    rows = rows.join(best, key, "left")
    lines = F.split("content", "\n")
    size = F.size(F.split(F.regexp_replace("search", r"^\n+|\n+$", ""), "\n"))
    indent = F.regexp_extract(F.get(lines, F.col("start")), r"^([ \t]*)", 1)
    fresh = F.split(F.regexp_replace("replacement", r"^\n+|\n+$", ""), "\n")
    own = F.length(F.regexp_extract(fresh[0], r"^([ \t]*)", 1))
    moved = F.transform(fresh, lambda x: F.when(F.trim(x) == "", x).otherwise(F.concat(indent, F.substring(x, F.least(own, F.length(F.regexp_extract(x, r"^([ \t]*)", 1))) + 1, F.length(x)))))
    alike = F.array_join(F.concat(F.slice(lines, 1, F.col("start")), moved, F.slice(lines, F.col("start") + size + 1, F.size(lines))), "\n")
    exact = F.concat(F.substring("content", F.lit(1), F.col("at") - 1), F.col("replacement"), F.substring("content", F.col("at") + F.length("search"), F.length("content")))
    text = F.when(F.col("how") == "blank", F.col("content")).when(F.col("how") == "exact", exact).when(F.col("start").isNotNull(), alike).otherwise("")
    return rows.select(key, text.alias("content"), F.coalesce("how", F.when(F.col("start").isNotNull(), "alike").otherwise("missing")).alias("how"))
