"""How often words stand in texts, as substrings of longer words as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import retrieval
from millrace.session import written


def wanted_words(keywords: DataFrame, least: int = 5) -> DataFrame:
    """The distinct ``keywords``(query, word) of at least ``least`` characters, in lower case."""
    return keywords.where(F.length("word") >= least).select("query", F.lower("word").alias("word")).distinct()


def word_postings(words: DataFrame, texts: DataFrame, least: int = 5) -> DataFrame:
    """(doc, word, n): how often the distinct lower-case ``words``(word) of at least ``least`` word characters stand in each of
    ``texts``(doc, text), overlaps not counted twice, in any letter case.

    A word consists of word characters, so it lies within one token of a text. Distinct tokens and distinct words meet
    by a word's first ``least`` characters, which are one of a token's substrings of that length; so vocabularies are
    joined by key, not texts with words in pairs. Null texts and words count nothing.
    """
    tokens = written(texts.where("text is not null").select("doc", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\w{{{least},}}"), F.lit(0))).alias("token")).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf")))
    starts = F.sequence(F.lit(1), F.length("token") - least + 1)
    parts = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("token"), i, F.lit(least))))).alias("part"))
    words = words.withColumn("part", F.substring("word", 1, least))
    within = parts.join(words, "part").where(F.contains("token", "word")).select("token", "word", ((F.length("token") - F.length(F.replace("token", F.col("word"), F.lit("")))) / F.length("word")).cast("bigint").alias("times"))
    return tokens.join(within, "token").groupBy("doc", "word").agg(F.sum(F.col("tf") * F.col("times")).alias("n"))


def keyword_counts(keywords: DataFrame, texts: DataFrame, least: int = 5) -> DataFrame:
    """(query, doc, n): how often the distinct ``keywords``(query, word) of a query stand in each of ``texts``(doc, text), of
    those where any does. A row for every such pair; ``keyword_top`` makes none for those that aren't among the best."""
    wanted = wanted_words(keywords, least)
    return wanted.join(word_postings(wanted.select("word").distinct(), texts, least), "word").groupBy("query", "doc").agg(F.sum("n").alias("n"))


def keyword_top(keywords: DataFrame, texts: DataFrame, k: int, least: int = 5) -> DataFrame:
    """(query, doc, n, rank): of the ``keyword_counts`` the ``k`` largest per query, ties by the document. Ids are whole
    numbers."""
    wanted = written(wanted_words(keywords, least))
    postings = word_postings(wanted.select("word").distinct(), texts, least)
    found = retrieval.sparse_top(wanted.select("query", F.col("word").alias("term"), F.lit(1).alias("times")), postings.select(F.col("word").alias("term"), "doc", F.col("n").alias("weight")), k)
    return found.select("query", "doc", F.col("score").cast("bigint").alias("n"), "rank")


def name_points(hints: DataFrame, paths: DataFrame, least: int = 3) -> DataFrame:
    """(query, doc, score): for each distinct hint of ``hints``(query, hint) 3 points if it is the stem of the path of a
    document of ``paths``(doc, path), else 1 if it stands anywhere in the path, in any letter case. Hints shorter than
    ``least`` characters count nothing; hints meet the paths by their first ``least`` characters."""
    wanted = hints.where(F.length("hint") >= least).select("query", F.lower("hint").alias("hint")).distinct()
    known = paths.where("path is not null").select("doc", F.lower("path").alias("path"))
    known = known.withColumn("stem", F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[a-z0-9]+$", ""))
    starts = F.sequence(F.lit(1), F.length("path") - least + 1)
    parts = known.where(F.length("path") >= least).select("doc", "path", "stem", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("path"), i, F.lit(least))))).alias("part"))
    met = wanted.withColumn("part", F.substring("hint", 1, least)).join(parts, "part").where(F.contains("path", "hint"))
    return met.groupBy("query", "doc").agg(F.sum(F.when(F.col("stem") == F.col("hint"), 3).otherwise(1)).cast("bigint").alias("score"))
