"""Schemas that drift between files: JSON lines whose fields are added, removed, renamed or change type.

Every file's top-level fields are profiled (presence, types, place in the line, a sketch of the values), fields that
vanish and appear between two versions are matched as a bipartite assignment problem, and all lines are then read
into one table in which a field has one name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import record_components
from millrace.operators.distinct import rows_once
from millrace.session import checkpointed

#: Width of a value sketch: relative frequencies of value tokens, by hash bucket.
SKETCH = 64
#: Weights of the parts of a pair's likeness, and the least likeness of a rename.
WEIGHTS = {"values": 0.45, "place": 0.3, "name": 0.15, "presence": 0.1}
RENAME_FROM = 0.5
FILE = ["series", "source_file", "file_seq"]
#: So many names of fields in files are broadcast at most; beyond that the fields are shuffled to them.
BROADCAST_NAMES = 200_000


def readable_lines(lines: DataFrame) -> DataFrame:
    """The distinct lines that are exactly one JSON object: (series, source_file, file_seq, line_no, line, object).

    Blank and null lines, other JSON values, broken JSON, objects with something behind them and objects with a
    repeated key are left out. The line is parsed inside brackets, since the parser alone would stop after the
    first value and not see what follows. Lines are told apart by their place, so only repeated ones are shuffled.
    """
    boxed = F.expr("try_parse_json('[' || line || ']')")
    return (
        rows_once(lines.select(*FILE, "line_no", "line"), *FILE, "line_no")
        .withColumn("boxed", boxed)
        .where(F.expr("boxed is not null and schema_of_variant(boxed) like 'ARRAY<OBJECT<%' and try_variant_get(boxed, '$[1]', 'variant') is null"))
        .select(*FILE, "line_no", "line", F.expr("variant_get(boxed, '$[0]', 'variant')").alias("object"))
    )


def top_level(objects: DataFrame) -> DataFrame:
    """One row per line and field: (series, source_file, file_seq, line_no, first, field, place, type, value).

    ``type`` is string, number, boolean, object or array, null for a JSON null; ``value`` is a string's text, else
    its JSON; ``first`` is true in one row of each line. An empty object has a single row whose field is null.
    """
    kind = F.expr("schema_of_variant(value)")
    return objects.lateralJoin(
        objects.sparkSession.tvf.variant_explode_outer(F.col("object").outer())
    ).select(
        *FILE, "line_no", (F.coalesce("pos", F.lit(0)) == 0).alias("first"), F.col("key").alias("field"),
        F.expr("array_position(json_object_keys(line), key)").alias("place"),
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind != "VOID", "number").alias("type"),
        F.when(kind == "STRING", F.expr("try_variant_get(value, '$', 'string')")).otherwise(F.expr("to_json(value)")).alias("value"),
    )


def layouts(fields: DataFrame) -> DataFrame:
    """The fields that belong to each file, those that more than half of its readable lines have: (series,
    source_file, file_seq, field, type, place, presence). ``type`` is the commonest of the non-null values, by name
    among equals; it is null if all are null."""
    typed = fields.groupBy(*FILE, "field", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places"), F.count_if("first").alias("firsts"))
    profile = typed.groupBy(*FILE, "field").agg(
        F.sum("n").alias("n"),
        (F.sum("places") / F.sum("n")).alias("place"),
        F.min_by("type", F.when(F.col("type").isNotNull(), F.struct(-F.col("n"), "type"))).alias("type"),
        F.coalesce(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
        F.sum("firsts").alias("firsts"),
    )
    lines = F.sum("firsts").over(Window.partitionBy(*FILE))
    return profile.withColumn("lines", lines).where("field is not null and n * 2 > lines").select(*FILE, "field", "type", "place", (F.col("filled") / F.col("lines")).alias("presence"))


def field_steps(layout: DataFrame) -> DataFrame:
    """The layout of each file beside that of the file before it (next lower file_seq of its series): one row per
    file and field of either, with columns old_* and new_* that are null where the field is missing. The first
    file of a series has no row; files without a readable line have no layout and are passed over."""
    files = layout.select(*FILE).distinct()
    in_order = Window.partitionBy("series").orderBy("file_seq", "source_file")
    steps = files.withColumn("before", F.lag(F.struct("file_seq", "source_file")).over(in_order)).where("before is not null")
    side = ["type", "place", "presence"]
    new = layout.join(steps.select(*FILE), FILE).select(*FILE, "field", *(F.col(c).alias(f"new_{c}") for c in side), F.lit(True).alias("in_new"))
    old = (
        steps.select("series", F.col("source_file").alias("later"), F.col("file_seq").alias("later_seq"), F.col("before.source_file").alias("source_file"), F.col("before.file_seq").alias("file_seq"))
        .join(layout, FILE)
        .select("series", F.col("later").alias("source_file"), F.col("later_seq").alias("file_seq"), F.col("source_file").alias("old_file"), "field", *(F.col(c).alias(f"old_{c}") for c in side), F.lit(True).alias("in_old"))
    )
    both = new.join(old, [*FILE, "field"], "full")
    kept = F.when(F.col("in_new") & F.col("in_old"), 1).otherwise(0)
    per_step = Window.partitionBy(*FILE)
    return both.select(
        "*",
        # How many of the kept fields stand before this one, in either version.
        (F.sum(kept).over(per_step.orderBy(F.coalesce("new_place", F.lit(1e9)), "field").rowsBetween(Window.unboundedPreceding, 0)) - kept).alias("new_slot"),
        (F.sum(kept).over(per_step.orderBy(F.coalesce("old_place", F.lit(1e9)), "field").rowsBetween(Window.unboundedPreceding, 0)) - kept).alias("old_slot"),
        F.max("old_file").over(per_step).alias("before"),
    )


def value_tokens(value: Column, kind: Column) -> Column:
    """What a sketch counts of a value: its words, and for each of them, to the end of the value, the signs on both sides of
    it; of digits and of mixtures of digits and letters, as in ids and hashes, only the length; of a number the digits
    before and behind the point; the value of a boolean."""
    words = F.transform(
        F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda w: w != ""),
        lambda w: F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(w))).when(w.rlike("[0-9]"), F.concat(F.lit("x"), F.length(w))).otherwise(w),
    )
    signs = F.split(value, "[A-Za-z0-9]+")
    patterns = F.zip_with(signs, F.slice(signs, 2, F.size(signs)), lambda a, b: F.concat(a, F.lit("w"), F.coalesce(b, F.lit(""))))
    number = F.array(F.concat_ws(".", F.length(F.regexp_extract(value, r"^-?(\d+)", 1)), F.length(F.regexp_extract(value, r"\.(\d+)", 1))))
    return F.when(kind == "number", number).when(kind == "boolean", F.array(value)).otherwise(F.concat(words, F.slice(patterns, 1, F.size(words))))


def sketches(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """(series, source_file, field, sketch) of the ``wanted``(series, source_file, field): an array of SKETCH
    relative token frequencies. Counts are combined before the shuffle."""
    tokens = fields.join(wanted, ["series", "source_file", "field"], "left_semi").where("type is not null").select(
        "series", "source_file", "field", F.explode(value_tokens(F.col("value"), F.col("type"))).alias("token")
    )
    key = ["series", "source_file", "field"]
    counts = tokens.groupBy(*key, F.pmod(F.xxhash64("token"), F.lit(SKETCH)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    gathered = counts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sum("n").alias("all"))
    slots = F.sequence(F.lit(0), F.lit(SKETCH - 1))
    return gathered.select(*key, F.transform(slots, lambda i: F.coalesce(F.col("m")[i], F.lit(0)) / F.col("all")).alias("sketch"))


def name_parts(name: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")


def name_likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the larger of the edit likeness of the two names and the share of parts they have in common."""
    plain_a, plain_b = F.array_join(name_parts(a), ""), F.array_join(name_parts(b), "")
    edit = 1 - F.levenshtein(plain_a, plain_b) / F.greatest(F.length(plain_a), F.length(plain_b), F.lit(1))
    parts = F.size(F.array_intersect(name_parts(a), name_parts(b))) / F.least(F.size(F.array_distinct(name_parts(a))), F.size(F.array_distinct(name_parts(b))))
    return F.greatest(edit, 0.9 * parts)


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of an assignment with the largest sum of ``gain``, by shortest augmenting paths."""
    rows, cols = gain.shape
    if rows > cols:
        return [(r, c) for c, r in assign(gain.T)]
    cost, u, v = gain.max() - gain, np.zeros(rows + 1), np.zeros(cols + 1)
    match = np.zeros(cols + 1, dtype=int)
    for r in range(1, rows + 1):
        match[0], at = r, 0
        least, via, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, dtype=int), np.zeros(cols + 1, dtype=bool)
        while match[at]:
            done[at] = True
            row = match[at]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better], via[1:][better] = reduced[better], at
            free = np.where(done[1:], np.inf, least[1:])
            nearest = int(free.argmin()) + 1
            step = least[nearest]
            u[match[done]] += step
            v[done] -= step
            least[1:][~done[1:]] -= step
            at = nearest
        while at:
            match[at], at = match[via[at]], via[at]
    return [(match[c] - 1, c - 1) for c in range(1, cols + 1) if match[c]]


def match_fields(pairs: pd.DataFrame) -> pd.DataFrame:
    """The best one-to-one matching of one step's vanished and new fields, without pairs below RENAME_FROM."""
    table = pairs.pivot_table(index="old_name", columns="new_name", values="likeness", fill_value=0.0, aggfunc="max").sort_index().sort_index(axis=1)
    gain = np.where(table.to_numpy() >= RENAME_FROM, table.to_numpy(), 0.0)
    chosen = [(table.index[r], table.columns[c]) for r, c in assign(gain) if gain[r, c] > 0]
    first = pairs.iloc[0]
    rows = [(str(first["series"]), str(first["source_file"]), str(o), str(n)) for o, n in chosen]
    return pd.DataFrame(rows, columns=["series", "source_file", "old_name", "new_name"], dtype=object)


def rename_candidates(steps: DataFrame, fields: DataFrame) -> DataFrame:
    """All pairs of a vanished and a new field of one step, with their likeness. Their number is bounded by the
    width of the two layouts, whatever the number of lines."""
    gone = steps.where("in_new is null").select("series", "source_file", "before", F.col("field").alias("old_name"), "old_type", "old_presence", "old_slot")
    come = steps.where("in_old is null").select("series", "source_file", F.col("field").alias("new_name"), "new_type", "new_presence", "new_slot")
    pairs = gone.join(come, ["series", "source_file"])
    wanted = pairs.select("series", F.col("before").alias("source_file"), F.col("old_name").alias("field")).union(pairs.select("series", "source_file", F.col("new_name").alias("field"))).distinct()
    sketch = sketches(fields, wanted)
    old = sketch.select("series", F.col("source_file").alias("before"), F.col("field").alias("old_name"), F.col("sketch").alias("old_sketch"))
    new = sketch.select("series", "source_file", F.col("field").alias("new_name"), F.col("sketch").alias("new_sketch"))
    pairs = pairs.join(old, ["series", "before", "old_name"], "left").join(new, ["series", "source_file", "new_name"], "left")
    overlap = F.aggregate(F.zip_with("old_sketch", "new_sketch", lambda a, b: F.least(a, b)), F.lit(0.0), lambda s, x: s + x)
    same_type = F.col("old_type").eqNullSafe(F.col("new_type"))
    values = F.coalesce(overlap, F.lit(0.0)) * F.when(same_type, 1.0).otherwise(0.3)
    place = F.exp(-F.abs(F.col("old_slot") - F.col("new_slot")) / 2)
    presence = 1 - F.abs(F.col("old_presence") - F.col("new_presence"))
    likeness = WEIGHTS["values"] * values + WEIGHTS["place"] * place + WEIGHTS["name"] * name_likeness(F.col("old_name"), F.col("new_name")) + WEIGHTS["presence"] * presence
    return pairs.select("series", "source_file", "old_name", "new_name", values.alias("values"), place.alias("place"), presence.alias("presence"), likeness.alias("likeness"))


def parsed_fields(lines: DataFrame) -> DataFrame:
    """``top_level`` of the readable lines, parsed once and kept in the shared folder, since it is read several times."""
    return checkpointed(top_level(readable_lines(lines)))


def schema_changes(lines: DataFrame) -> DataFrame:
    """Every change of a top-level field between a file and the file before it in its series.

    ``lines`` has series, source_file, file_seq, line_no and line; more columns are ignored and repeated rows count
    once. Returns (source_file, change, old_name, new_name) where change is added, removed, renamed or type_changed.
    An empty input, or series of a single file, give no rows.
    """
    return field_changes(parsed_fields(lines)).drop("series", "file_seq")


def field_changes(fields: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """``schema_changes`` of ``parsed_fields``, with the series and file_seq of the later file."""
    steps = checkpointed(field_steps(layouts(fields) if layout is None else layout))
    renamed = rename_candidates(steps, fields).select("series", "source_file", "old_name", "new_name", "likeness").groupBy("series", "source_file").applyInPandas(
        match_fields, "series string, source_file string, old_name string, new_name string"
    )
    retyped = steps.where("in_new and in_old and old_type <> new_type").select("series", "source_file", F.lit("type_changed").alias("change"), F.col("field").alias("old_name"), F.col("field").alias("new_name"))
    # A matched pair takes the place of its removal and its addition.
    single = steps.where("in_new is null or in_old is null").select("series", "source_file", "field", F.col("in_old").isNull().alias("added"))
    matched = renamed.select("series", "source_file", F.explode(F.array(F.struct(F.col("old_name").alias("field"), F.lit(False).alias("added")), F.struct(F.col("new_name").alias("field"), F.lit(True).alias("added")))).alias("m")).select("series", "source_file", "m.*")
    rest = single.join(matched, ["series", "source_file", "field", "added"], "left_anti").select(
        "series",
        "source_file",
        F.when(F.col("added"), "added").otherwise("removed").alias("change"),
        F.when(F.col("added"), "").otherwise(F.col("field")).alias("old_name"),
        F.when(F.col("added"), F.col("field")).otherwise("").alias("new_name"),
    )
    changes = rest.unionByName(retyped).unionByName(renamed.select("series", "source_file", F.lit("renamed").alias("change"), "old_name", "new_name"))
    return changes.join(steps.select("series", "source_file", "file_seq").distinct(), ["series", "source_file"])


def field_tracks(layout: DataFrame, changes: DataFrame) -> DataFrame:
    """(series, file_seq, source_file, field, track): what goes on under changing names within one series.

    A field lives from a file in whose layout it is new to the last file before one that lacks it; a rename joins the
    life that ends with the one that begins. A name that is given up and later taken again is another life.
    """
    files = layout.select(*FILE).distinct().withColumn("no", F.row_number().over(Window.partitionBy("series").orderBy("file_seq", "source_file")))
    placed = layout.select(*FILE, "field").join(files, FILE)
    own = Window.partitionBy("series", "field").orderBy("no")
    fresh = F.coalesce(F.col("no") - F.lag("no").over(own) > 1, F.lit(True))
    begun = F.max(F.when(fresh, F.col("no"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lives = placed.withColumn("life", F.struct("series", "field", begun.alias("begun")))
    renames = changes.where("change = 'renamed'").join(files.select("series", "source_file", "no"), ["series", "source_file"])
    here, there = lives.select("series", F.col("field").alias("new_name"), "no", F.col("life").alias("new")), lives.select("series", F.col("field").alias("old_name"), (F.col("no") + 1).alias("no"), F.col("life").alias("old"))
    links = renames.join(here, ["series", "new_name", "no"]).join(there, ["series", "old_name", "no"]).select("new", "old").distinct().withColumn("record", F.struct("old", "new"))
    ends = links.select("record", F.explode(F.array("old", "new")).alias("entity"))
    joined = ends.join(record_components(ends), "record").select(F.col("entity").alias("life"), F.col("component.old").alias("track")).distinct()
    joined = joined.groupBy("life").agg(F.min("track").alias("track"))
    return lives.join(joined, "life", "left").select(*FILE, "field", F.to_json(F.coalesce("track", "life")).alias("track"))


def field_names(fields: DataFrame, layout: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """(series, source_file, file_seq, field, name): what each field of each file is called in the one table.

    Names that share a track in any series are one family, called by the one that most lines use, one of the ``columns`` if
    there is any, in all series; so a series that never renamed is named as the others. But a name that shares tracks with two names that some file has
    both means different things in different series: it links nothing, and its tracks are called by their
    other names. A family that still holds two fields of one file isn't applied; its tracks are called by their own
    commonest name. Fields that belong to no layout keep their names.
    """
    tracks = checkpointed(field_tracks(layout, changes))
    used = checkpointed(fields.where("field is not null").groupBy("field").agg(F.count(F.lit(1)).alias("n")))
    members = checkpointed(tracks.select("track", "field").distinct())
    pairs = checkpointed(members.join(members.withColumnRenamed("field", "other"), "track").where("field <> other").select("field", "other").distinct())
    renamed = pairs.select("field").distinct()
    # Which of the renamed names stand together in some file's layout.
    in_files = tracks.join(renamed, "field", "left_semi").select(*FILE, "field").distinct()
    together = checkpointed(in_files.join(in_files.withColumnRenamed("field", "other"), FILE).where("field < other").select("field", "other").distinct())
    both = pairs.join(pairs.withColumnRenamed("other", "third"), "field").where("other < third")
    ambiguous = both.join(together.select(F.col("field").alias("other"), F.col("other").alias("third")), ["other", "third"], "left_semi").select("field").distinct()
    clear = pairs.join(ambiguous, "field", "left_anti").join(ambiguous.withColumnRenamed("field", "other"), "other", "left_anti")
    links = clear.select(F.struct(F.least("field", "other").alias("a"), F.greatest("field", "other").alias("b")).alias("record"), F.col("field").alias("entity")).distinct()
    family = checkpointed(links.join(record_components(links), "record").select(F.col("entity").alias("field"), F.to_json("component").alias("family")).distinct())
    torn = together.join(family, "field").join(family.select(F.col("field").alias("other"), F.col("family").alias("f")), "other").where("family = f").select("family").distinct()
    family = family.join(torn, "family", "left_anti")
    called = family.join(used, "field").groupBy("family").agg(F.max_by("field", F.struct(F.col("field").isin(*columns).alias("wanted"), "n", "field")).alias("common"))
    family = family.join(called, "family").select("field", "common")
    rank = F.struct(F.col("doubtful").isNull().alias("clear"), F.col("field").isin(*columns).alias("wanted"), "n", "field")
    own = members.join(used, "field").join(ambiguous.withColumn("doubtful", F.lit(1)), "field", "left").groupBy("track").agg(F.max_by("field", rank).alias("field"))
    names = own.join(family, "field", "left").select("track", F.coalesce("common", "field").alias("name"))
    return tracks.join(names, "track").select(*FILE, "field", "name")


def unified_table(lines: DataFrame, columns: tuple[str, ...] = ("task_id", "instance_id", "patch")) -> DataFrame:
    """All readable lines as one consistent table: series, source_file, file_seq, line_no, the ``columns``, and
    ``rest``, a map of all other fields, each under its common name, as text or JSON.

    No value is lost: of two fields of a line with one common name the one that stands first and is not null has it, the
    other is in ``rest`` under its own name behind a ~. Nulls have no entry in ``rest``.
    """
    fields = parsed_fields(lines).where("field is not null")
    layout = checkpointed(layouts(fields))
    names = checkpointed(field_names(fields, layout, field_changes(fields, layout), columns))
    row = [*FILE, "line_no"]
    few = F.broadcast(names) if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else names
    called = fields.join(few, [*FILE, "field"], "left").withColumn("name", F.coalesce("name", "field"))
    cells = called.select(*row, F.struct(F.col("type").isNull().alias("empty"), "place", "name", "field", "value").alias("c")).groupBy(*row).agg(F.array_sort(F.collect_list("c")).alias("cells"))
    filled = F.filter("cells", lambda c: ~c["empty"])
    keyed = F.transform(filled, lambda c, i: F.struct(F.when(F.exists(F.slice(filled, 1, i), lambda x: x["name"] == c["name"]), F.concat(F.lit("~"), c["field"])).otherwise(c["name"]).alias("key"), c["value"].alias("value")))
    whole = cells.select(*row, F.map_from_entries(keyed).alias("all"))
    return whole.select(*row, *(F.col("all")[c].alias(c) for c in columns), F.map_filter("all", lambda k, v: ~k.isin(*columns)).alias("rest"))
