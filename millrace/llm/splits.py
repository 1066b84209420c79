"""Splits that keep related records together.

Records are linked to entities (an issue, an author, a source), components of that bipartite graph are found by
iterative minimum-label propagation, and whole components are assigned to splits so that both the sizes and the
label distribution of the splits follow the wanted proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import record_components
from millrace.session import checkpointed

#: Up to this size groups are alike only if they are equal in size and labels; larger ones by classes.
EXACT = 8
#: Groups of a hash bucket, between which offsets are carried instead of sorting a stratum in one task.
BUCKET = 20_000
#: So many strata are broadcast at most; beyond that the groups are shuffled to them.
BROADCAST_STRATA = 100_000


def normal_repo(name: Column) -> Column:
    """owner/name in lower case, without white space, a trailing slash or ``.git``; null if nothing is left."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), r"^https?://[^/]+/|/+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\.git$", ""), "^([^/_]+(?:_[^/_]+)*)__", "$1/")
    return F.when(plain != "", plain)


def repository_names(moves: DataFrame) -> DataFrame:
    """(``repo``, ``home``) of every name in ``moves``(old_repo, new_repo): all names that one repository has
    had share one of them as ``home``. Moves with a null or blank name are ignored."""
    pairs = (
        moves.select(normal_repo(F.col("old_repo")).alias("old"), normal_repo(F.col("new_repo")).alias("new"))
        .dropna()
        .distinct()
        .withColumn("record", F.struct("old", "new"))
    )
    named = pairs.select("record", F.explode(F.array("old", "new")).alias("entity"))
    return checkpointed(
        named.join(record_components(named), "record")
        .groupBy("entity")
        .agg(F.min("component").alias("component"))
        .select(F.col("entity").alias("repo"), F.col("component.old").alias("_c"), F.col("component.new").alias("_d"))
        .select("repo", F.least("_c", "_d").alias("home"))
    )


def issue_parts(instance_id: Column) -> tuple[Column, Column]:
    """Repository (null if none is named) and number of the issue that ``instance_id`` means.

    Understood are owner__name-12, owner/name-12, owner/name#12, URLs of issues, GH-12, issue-12, #12 and 12, in
    any letter case, with white space around, leading zeros, and a note of the attempt or comment behind. The
    number of a text without digits is the normalised text itself; a null or blank text gives nulls.
    """
    text = F.lower(F.regexp_replace(instance_id, r"(?U)^\s+|\s+$", ""))
    text = F.regexp_replace(text, r"(?U)(?:\s*\(?\b(?:retry|attempt|run|try)[\s_-]*\d+\)?|(?<=\d)[.@_](?:retry|attempt|run|try)[\s_-]*\d+|#[a-z]*comment-?\d+|[/?\s]+)+$", "")
    number = F.regexp_replace(F.regexp_extract(text, r"(\d+)$", 1), "^0+(?=.)", "")
    head = F.regexp_replace(F.regexp_replace(text, r"\d+$", ""), r"(?:/issues?/|/pulls?/|[-#/\s])+$", "")
    named = F.when(head.rlike(r"^(?:https?://[^/]+/)?[^/\s]+?(?:__|/)[^/\s]+$"), head)
    blank = (text == "") | text.isNull()
    return F.when(~blank, normal_repo(named)), F.when(~blank, F.when(number == "", text).otherwise(number))


def issue_links(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """(entry_id, issue): the issue of every distinct entry as home#number, or null where it can't be told."""
    named, number = issue_parts(F.col("instance_id"))
    rows = (
        entries.select("entry_id", "instance_id", "repo")
        .where("entry_id is not null")
        .select("entry_id", F.coalesce(named, normal_repo(F.col("repo"))).alias("repo"), number.alias("number"))
        .distinct()
    )
    homes = repository_names(moves)
    return rows.join(homes, "repo", "left").select(
        "entry_id", F.concat_ws("#", F.coalesce("home", "repo"), "number").alias("issue"), "repo", "number"
    ).select("entry_id", F.when(F.col("repo").isNotNull() & F.col("number").isNotNull(), F.col("issue")).alias("issue"))


def related_entries(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """(group_id, entry_id) of every entry whose issue has two or more entries; group_id is the smallest of them."""
    links = issue_links(entries, moves)
    groups = checkpointed(record_components(links, "entry_id", "issue"))
    shared = groups.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("component")
    return groups.join(shared, "component", "left_semi").select(F.col("component").alias("group_id"), "entry_id")


def group_kinds(records: DataFrame) -> DataFrame:
    """(group, size, stratum, labels) of ``records``(record, group, label): groups of one stratum count as alike.

    Up to EXACT records they have the same number of each label. Above, they are of one class of sizes (four to each
    doubling), and share the commonest label, its part in eighths, and the second label; so there are no more strata than
    the labels and classes allow, however many groups.
    """
    labelled = records.groupBy("group", F.coalesce(F.col("label").cast("string"), F.lit("\0null")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    groups = labelled.groupBy("group").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("n", "label")), asc=False).alias("labels"))
    exact = F.to_json(F.struct(F.array_sort("labels").alias("l")))
    first = F.col("labels")[0]
    coarse = F.concat_ws("|", F.floor(4 * F.log2("size")), first["label"], F.floor(8 * first["n"] / F.col("size")), F.get("labels", F.lit(1))["label"])
    return groups.select("group", "size", F.when(F.col("size") <= EXACT, exact).otherwise(coarse).alias("stratum"), "labels")


def dealt(strata: list[tuple[str, int, dict[str, float]]], parts: dict[str, float]) -> dict[str, list[int]]:
    """How many groups of each stratum every split gets. ``strata`` are (name, groups, mean label counts of a group).

    Strata of large groups come first. Of each, a split gets as many groups as bring it nearest to the label counts that it
    should have by then (a least-squares solution, cut at nothing and rounded down), and the groups that are
    left go one by one to where they leave the least squared deviation; so what large groups leave askew smaller
    ones mend.
    """
    have: dict[str, dict[str, float]] = {s: {} for s in parts}
    seen: dict[str, float] = {}
    given = {}
    for name, groups, labels in sorted(strata, key=lambda x: (-sum(x[2].values()), x[0])):
        for k, n in labels.items():
            seen[k] = seen.get(k, 0.0) + n * groups
        norm = sum(n * n for n in labels.values())
        wanted = {s: max(0.0, sum(n * (parts[s] * seen[k] - have[s].get(k, 0.0)) for k, n in labels.items()) / norm) for s in parts}
        scale = groups / (sum(wanted.values()) or 1.0)
        counts = {s: int(w * scale + 1e-9) for s, w in wanted.items()}
        for s in parts:
            for k, n in labels.items():
                have[s][k] = have[s].get(k, 0.0) + n * counts[s]
        for _ in range(groups - sum(counts.values())):
            best = min(parts, key=lambda s: sum(n * n + 2 * n * (have[s][k] - parts[s] * seen[k]) for k, n in labels.items()))
            counts[best] += 1
            for k, n in labels.items():
                have[best][k] += n
        given[name] = list(counts.values())
    return given


def stratified_groups(records: DataFrame, parts: dict[str, float], seed: int = 0) -> DataFrame:
    """Assign whole groups to splits.

    ``records`` has (record, group, label); returns (group, size, split). ``parts`` gives the wanted share of
    every split. A null label counts as a label of its own.

    How many groups of each stratum of ``group_kinds`` a split gets is told from the strata's counts alone, by ``dealt``,
    at every size of groups alike. Which ones, the order of a seeded hash tells: a group's rank in its stratum is carried
    from hash bucket to hash bucket, so no stratum is sorted in one task.
    """
    total_parts = sum(parts.values())
    parts = {k: v / total_parts for k, v in parts.items()}
    groups = checkpointed(group_kinds(records))
    counts = groups.groupBy("stratum").agg(F.count(F.lit(1)).alias("groups"))
    sums = groups.select("stratum", F.explode("labels").alias("l")).groupBy("stratum", "l.label").agg(F.sum("l.n").alias("n"))
    strata = counts.join(sums.groupBy("stratum").agg(F.collect_list(F.struct("label", "n")).alias("labels")), "stratum").collect()
    given = dealt([(r.stratum, r.groups, {x.label: x.n / r.groups for x in r.labels}) for r in strata], parts)
    spark = records.sparkSession
    cuts = spark.createDataFrame([(k, [sum(v[: i + 1]) for i in range(len(v))]) for k, v in given.items()], "stratum string, cuts array<bigint>")
    total = sum(r.groups for r in strata)
    rows = groups.select("group", "size", "stratum", F.xxhash64("group", F.lit(seed)).alias("h")).withColumn("bucket", F.pmod("h", F.lit(max(1, -(-total // BUCKET)))))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n")).select("stratum", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    known = carried.join(F.broadcast(cuts) if len(given) <= BROADCAST_STRATA else cuts, "stratum")
    rank = F.col("carried") + F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "group"))
    ranked = rows.join(known, ["stratum", "bucket"]).select("group", "size", "cuts", rank.alias("rank"))
    passed = F.size(F.filter("cuts", lambda c: c < F.col("rank")))
    names = F.array(*(F.lit(s) for s in parts))
    return ranked.select("group", "size", F.get(names, F.least(passed, F.lit(len(parts) - 1))).alias("split"))


PARTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def split_entries(entries: DataFrame, moves: DataFrame, parts: dict[str, float] | None = None, seed: int = 0, more: DataFrame | None = None) -> DataFrame:
    """(entry_id, group_id, split) of every distinct entry: entries of one issue share the split, an entry whose
    issue is unknown is a group of its own. Stratified by ``resolved``. Null entry_ids are dropped.

    ``more``(entry_id, entity) names further entities, as authors or sources, whose entries must stay together as well;
    they must differ from the issues' names (owner/name#number). Groups are then joined over all of them.
    """
    links = issue_links(entries, moves).select("entry_id", F.col("issue").alias("entity"))
    if more is not None:
        known = links.select("entry_id").distinct()
        links = links.unionByName(more.select("entry_id", F.concat(F.lit("\0"), F.col("entity").cast("string")).alias("entity")).join(known, "entry_id", "left_semi"))
    groups = checkpointed(record_components(links, "entry_id", "entity"))
    labels = entries.where("entry_id is not null").groupBy("entry_id").agg(F.max("resolved").alias("label"))
    records = groups.join(labels, "entry_id").select(F.col("entry_id").alias("record"), F.col("component").alias("group"), "label")
    assigned = stratified_groups(records, parts or PARTS, seed)
    return groups.join(assigned, groups.component == assigned.group).select("entry_id", F.col("component").alias("group_id"), "split")


def split_deviation(splits: DataFrame, labels: DataFrame, parts: dict[str, float] | None = None) -> DataFrame:
    """(split, label, n, wanted, deviation) of ``splits``(entry_id, split) with ``labels``(entry_id, label): how many entries of a
    label each split has, its share of the label's entries, and by how much of them it misses it. Null labels are '?'."""
    parts = parts or PARTS
    rows = splits.join(labels.select("entry_id", F.coalesce(F.col("label").cast("string"), F.lit("?")).alias("label")).groupBy("entry_id").agg(F.max("label").alias("label")), "entry_id")
    counts = rows.groupBy("label").pivot("split", list(parts)).agg(F.count(F.lit(1))).na.fill(0)
    whole = sum((F.col(s) for s in parts), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.col(s).alias("n"), (whole * share).alias("wanted"), whole.alias("of")) for s, share in parts.items())))
    found = counts.select("label", each.alias("c")).select("c.split", "label", "c.n", "c.wanted", "c.of")
    return found.select("split", "label", "n", F.round("wanted", 2).alias("wanted"), F.round((F.col("n") - F.col("wanted")) / F.col("of"), 6).alias("deviation"))
