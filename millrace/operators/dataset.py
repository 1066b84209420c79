"""From attempt logs to training records: ordered filters, pairs, splits and chat formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.session import written

# The longest patch in characters, and the fewest words of an issue.
MAX_PATCH, MIN_WORDS = 8000, 20
#: About so many pairs of a query and a document of one name are made by one task.
PAIRS = 1 << 18


def rejection(category: Column, patch: Column, problem: Column) -> Column:
    """Why an attempt is no training example, the first reason that holds; null for a good one."""
    body = F.trim(F.coalesce(patch, F.lit("")))
    return (
        F.when(F.lower(F.trim(F.coalesce(category, F.lit("")))).isin("", "unknown"), "unknown_category")
        .when(body == "", "empty_patch")
        .when(~body.rlike(r"^(?:---|diff )"), "invalid_patch_format")
        .when(F.length(body) > MAX_PATCH, "patch_too_long")
        .when(text.word_count(problem) < MIN_WORDS, "problem_too_short")
    )


def correction_pairs(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each failed attempt with the last resolved attempt of the same ``key``: (key, wrong, right).

    ``entries`` has ``key``, entry_id, resolved, usable and ``order``. The last resolved one per key is an aggregate
    with partial combination, not a sort; usable failed attempts before it are joined to it.
    """
    place = F.struct(*order)
    right = entries.where("resolved").groupBy(key).agg(F.max_by("entry_id", place).alias("right"), F.max(place).alias("_at"))
    wrong = entries.where("not resolved and usable").select(key, F.col("entry_id").alias("wrong"), place.alias("_p"))
    return wrong.join(right, key).where(F.col("_p") < F.col("_at")).select(key, "wrong", "right")


def hashed_split(rows: DataFrame, key: str, validation: float, seed: int, size: int = 50_000) -> DataFrame:
    """``rows`` with ``split``: exactly ``max(1, floor(n * validation))`` rows are validation, those first in the order
    of a seeded digest of ``key``. Ranks are carried over ranges of the digest of about ``size`` rows, so nothing is sorted
    as a whole."""
    buckets = max(1, -(-rows.count() // size))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    share = F.conv(F.substring("_d", 1, 8), 16, 10).cast("bigint") * buckets
    cut = rows.withColumn("_d", digest).withColumn("_b", F.shiftright(share, 32).cast("int"))
    sizes = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    rank = F.col("_n0") + F.row_number().over(Window.partitionBy("_b").orderBy("_d", key))
    limit = F.greatest(F.floor(F.col("_all") * validation), F.lit(1))
    ranked = cut.join(F.broadcast(sizes), "_b").withColumn("split", F.when(rank <= limit, "validation").otherwise("train"))
    return ranked.drop("_d", "_b", "_n0", "_all")


def role_name(role: Column) -> Column:
    """user, assistant or system for any of the names in use."""
    plain = F.lower(F.trim(role))
    return F.when(plain == "human", "user").when(plain == "gpt", "assistant").otherwise(plain)


def chat_text(messages: Column) -> Column:
    """Messages folded into one text with start and end marks of each turn."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), role_name(m["role"]), F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(messages, turn), "")


def content_of(messages: Column, role: str) -> Column:
    """The first content of a role; '' if there is none."""
    own = F.filter(messages, lambda m: role_name(m["role"]) == role)
    return F.coalesce(F.get(own, F.lit(0))["content"], F.lit(""))


def instruction_json(messages: Column) -> Column:
    """The record as JSON with instruction, input and output."""
    return F.to_json(F.struct(content_of(messages, "system").alias("instruction"), content_of(messages, "user").alias("input"), content_of(messages, "assistant").alias("output")))


def conversation_json(messages: Column) -> Column:
    """The record as JSON with conversations of from and value, roles named human and gpt."""
    other = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    return F.to_json(F.struct(F.transform(messages, lambda m: F.struct(other(role_name(m["role"])).alias("from"), F.coalesce(m["content"], F.lit("")).alias("value"))).alias("conversations")))


def messages_json(messages: Column) -> Column:
    """The record as JSON with messages of role and content."""
    return F.to_json(F.struct(F.transform(messages, lambda m: F.struct(role_name(m["role"]).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))).alias("messages")))


def repair_prompt(problem: Column, files: Column, patch: Column | None = None, category: Column | None = None, context: Column | None = None) -> Column:
    """What a model is asked: the issue's first 1000 characters, up to eight files, and with ``patch`` what failed before, if its
    category is known: 500 characters of the log's ``context`` and 800 of the patch."""
    parts = [F.concat(F.lit("## GitHub Issue\n"), text.word_prefix(problem, 1000))]
    listed = F.array_join(F.transform(F.slice(files, 1, 8), lambda f: F.concat(F.lit("- "), f)), "\n")
    parts.append(F.when(F.size(files) > 0, F.concat(F.lit("## Relevant Files\n"), listed)))
    if patch is not None:
        failed = F.concat(
            F.lit("## Previous Attempt Failed\nFailure category: **"), category, F.lit("**\n\n```\n"), text.word_prefix(context, 500), F.lit("\n```\n\nPrevious patch:\n```diff\n"), text.word_prefix(patch, 800), F.lit("\n```")
        )
        parts.append(F.when((F.coalesce(patch, F.lit("")) != "") & (F.coalesce(category, F.lit("")) != ""), failed))
    return F.concat_ws("\n\n", *parts, F.lit("Generate a unified diff patch that fixes the issue."))


def training_pairs(entries: DataFrame) -> DataFrame:
    """(kind, entry_id, answer_id, prompt): what an entry is asked, and the entry whose patch is the answer.

    ``entries`` has entry_id, instance_id (null for none), attempt, resolved, failure_category, patch, problem_statement,
    test_stdout, localised_files and ``reason``, why it is no example. Of entries without a reason a resolved one is
    ``positive``, an unresolved one with a log ``negative``; an unresolved one that isn't its instance's last is also a
    ``reflection``, answered by the instance's last resolved patch. The last ones are aggregates with partial
    combination, so an instance with very many attempts is not sorted anywhere.
    """
    place = F.struct("attempt", "entry_id")
    prompt = repair_prompt(F.col("problem_statement"), F.col("localised_files"))
    failed = repair_prompt(F.col("problem_statement"), F.col("localised_files"), F.col("patch"), F.col("failure_category"), text.error_context(F.col("test_stdout")))
    good = entries.where("reason is null")
    positive = good.where("resolved").select(F.lit("positive").alias("kind"), "entry_id", F.col("entry_id").alias("answer_id"), prompt.alias("prompt"))
    negative = good.where("not resolved and test_stdout <> ''").select(F.lit("negative").alias("kind"), "entry_id", F.col("entry_id").alias("answer_id"), failed.alias("prompt"))
    ends = entries.where("instance_id is not null").groupBy("instance_id").agg(
        F.max(place).alias("_last"), F.max(F.when(F.col("resolved"), F.struct("attempt", "entry_id", (F.coalesce("patch", F.lit("")) != "").alias("filled")))).alias("_final")
    ).where("_final.filled")
    tries = good.where("not resolved").join(ends, "instance_id").where(place < F.col("_last"))
    return positive.unionByName(negative).unionByName(tries.select(F.lit("reflection").alias("kind"), "entry_id", F.col("_final.entry_id").alias("answer_id"), failed.alias("prompt")))


def last_localised(entries: DataFrame) -> DataFrame:
    """(instance_id, localised_files): the last non-empty list in order of attempt and entry_id."""
    return entries.where("size(localised_files) > 0").groupBy("instance_id").agg(F.max_by("localised_files", F.struct("attempt", "entry_id")).alias("localised_files"))


def hard_negatives(wanted: DataFrame, docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, gold, doc, label, digest): each document with a name that the query wants as a positive of itself, label 1, and
    with it the query's ``hits``(query, doc) that have none, label 0. ``wanted`` is (query, name), ``docs`` (doc, name,
    digest); a document may have several rows.

    Queries meet documents by name, with their own negatives beside them, so no pair of a query and a document is shuffled;
    names with many such pairs are dealt over tasks, PAIRS to each.
    """
    wanted = written(wanted.distinct())
    docs = written(docs.distinct().groupBy("doc").agg(F.array_sort(F.collect_set("name")).alias("names"), F.collect_list("digest").alias("digests")))
    named = docs.select("*", F.explode("names").alias("name"))
    each = lambda doc, digests, label: F.transform(digests, lambda x: F.struct(doc.alias("doc"), F.lit(label).alias("label"), x.alias("digest")))
    sizes = wanted.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(named.groupBy("name").agg(F.count(F.lit(1)).alias("m")), "name")
    sizes = written(sizes.select("name", F.ceil(F.col("n") * F.col("m") / PAIRS).cast("int").alias("parts")))
    known = hits.join(docs, "doc").groupBy("query").agg(F.collect_list(F.struct("names", each(F.col("doc"), F.col("digests"), 0).alias("rows"))).alias("known"))
    asked = wanted.join(sizes, "name").groupBy("query").agg(F.collect_list("name").alias("asked"), F.collect_list(F.struct("name", "parts")).alias("places")).join(known, "query", "left")
    wrong = F.filter("known", lambda h: ~F.arrays_overlap(h["names"], F.col("asked")))
    asked = asked.select("query", "asked", F.flatten(F.transform(wrong, lambda h: h["rows"])).alias("wrong"), F.inline("places"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    dealt = named.join(sizes, "name").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # A document with several wanted names is gold once.
    met = asked.join(dealt.drop("parts"), ["name", "part"]).where((F.size("names") == 1) | (F.col("name") == F.array_intersect("names", "asked")[0]))
    positive = each(F.col("doc"), F.col("digests"), 1)
    return met.select("query", F.col("doc").alias("gold"), F.inline(F.when(F.col("wrong").isNull(), positive).otherwise(F.concat(positive, "wrong"))))
