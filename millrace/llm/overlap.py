"""Records that stand in training and in evaluation splits, exactly or almost.

All texts together form one row of words, and all their suffixes are brought into one order (a suffix array in range
partitions). A suffix's nearest neighbours from the other side of the split are the ones with which it has the longest
common beginning; these shared spans are merged into the part of a text that a pair of records shares, and pairs that
share enough are checked exactly. Pairs that no neighbourhood shows, as among very many texts from one template, are
found by an exact filter on rare words and word counts behind it, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpointed

#: Words of a suffix that its place in the order depends on. Longer spans show as spans that follow each other.
DEPTH = 12
#: The least common beginning, in words, of two neighbours.
SHARED = 6
#: Suffixes of a range partition, about.
SUFFIXES = 200_000
#: Least part of the longer text that must be covered by shared spans for the exact check.
COVERED = 0.1
#: Least part of the words of the longer text that must stand in the same order in the other.
SAME = 0.8
#: Size of the table of word counts that orders words by rarity, and of a text's histogram of words.
COUNTS, BINS = 1 << 18, 128
#: Rows of a block in the exact filter; a key with more rows on one side is split into a grid of blocks.
ROWS = 4_000
#: A histogram is compared by at most so many levels of its counts; what is above them is added to the bound.
LEVELS = 6


def split_side(split: Column) -> Column:
    """train or eval by the label in any spelling; null for other labels."""
    label = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    return F.when(label.startswith("train"), "train").when(label.rlike("^(?:val|dev|test|eval)"), "eval")


def message_words(messages: Column) -> Column:
    """The words of all user (human) messages: runs of letters, digits and underscores in lower case."""
    own = F.filter(messages, lambda m: F.lower(F.trim(m["role"])).isin("user", "human"))
    text = F.array_join(F.transform(own, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def message_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (class, example_id, side) and texts (class, words, n, in_train, in_eval): records with the same words
    form a class, named by its smallest example_id. Records of no known split, with a null id or without a word are
    left out; repeated rows count once."""
    rows = records.select("example_id", split_side(F.col("split")).alias("side"), message_words(F.col("messages")).alias("words"))
    rows = rows.where("example_id is not null and side is not null and size(words) > 0").withColumn("digest", F.sha2(F.array_join("words", " "), 256))
    classes = rows.groupBy("digest").agg(F.min("example_id").alias("class"), F.first("words").alias("words"), F.bool_or(F.col("side") == "train").alias("in_train"), F.bool_or(F.col("side") == "eval").alias("in_eval"))
    members = rows.select("digest", "example_id", "side").hint("merge").join(classes.select("digest", "class"), "digest").select("class", "example_id", "side").distinct()
    return members, classes.select("class", "words", F.size("words").alias("n"), "in_train", "in_eval")


def sides(texts: DataFrame) -> Column:
    """1 for training, 2 for evaluation, 3 for both."""
    return F.when(texts.in_train, 1).otherwise(0) + F.when(texts.in_eval, 2).otherwise(0)


# ---------------------------------------------------------------- the suffix array


def suffix_keys(codes: np.ndarray) -> np.ndarray:
    """One row of 4 * DEPTH bytes per suffix of a text: the codes of its first words, 0 behind the end."""
    padded = np.concatenate([codes, np.zeros(DEPTH - 1, codes.dtype)])
    return np.lib.stride_tricks.sliding_window_view(padded, DEPTH)


def suffixes(texts: DataFrame) -> DataFrame:
    """The suffixes of each text that have at least SHARED words: (class, at, key, turn), where ``key`` orders them by
    their first DEPTH words and ``turn`` orders equal ones differently from place to place, so that each of several
    copies is the nearest somewhere. ``at`` is 4 * place + side."""
    # 0 stands for the end of a text, which comes before every word.
    code = F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(0xFFFFFFFE) + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, side, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = codes.values.to_numpy(zero_copy_only=False)
                m = len(words) - SHARED + 1
                if m < 1:
                    continue
                keys = np.ascontiguousarray(suffix_keys(words.astype(">u4"))[:m])
                ends = np.arange(m + 1, dtype=np.int32) * 4 * DEPTH
                key = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())])
                at = np.arange(m, dtype=np.int64)
                turn = ((at + 1) * 0x9E3779B1 ^ np.int64(name) * 0x85EBCA6B) & 0x7FFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, name, np.int64)), pa.array(4 * at + side), key, pa.array((turn * 0x27D4EB2F >> 7 & 0x7FFFFFFF).astype(np.int32))], ["class", "at", "key", "turn"])

    return texts.select(F.col("class").cast("bigint").alias("class"), sides(texts).cast("bigint").alias("side"), code.alias("codes")).mapInArrow(cut, "class bigint, at bigint, key binary, turn int")


def nearest(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the nearest row before and behind it where ``mask`` holds; -1 if there is none."""
    rows = np.arange(len(mask))
    before = np.maximum.accumulate(np.where(mask, rows, -1))
    behind = np.minimum.accumulate(np.where(mask, rows, len(mask))[::-1])[::-1]
    behind = np.append(behind, len(mask))[1:]
    return np.append(-1, before)[:-1], np.where(behind == len(mask), -1, behind)


def adjacent_links(name: np.ndarray, at: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """The links of ``neighbours`` among suffixes in order."""
    train, held, m = at & 1 != 0, at & 2 != 0, max(len(at), 1)
    rows, found = np.arange(len(at)), []
    for e, t in [(rows, x) for x in nearest(train)] + [(x, rows) for x in nearest(held)]:
        good = held[e] & train[t] & (e >= 0) & (t >= 0)
        e, t = e[good], t[good]
        good = (keys[e, :SHARED] == keys[t, :SHARED]).all(axis=1)
        found.append(e[good] * m + t[good])
    e, t = np.divmod(np.unique(np.concatenate(found)), m)
    same = (keys[e] == keys[t]) & (keys[e] != 0)
    long = np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))
    good = (long >= SHARED) & (name[e] != name[t])
    e, t, long = e[good], t[good], long[good]
    return pa.RecordBatch.from_arrays([pa.array(name[e]), pa.array(name[t]), pa.array((at[e] >> 2).astype(np.int32)), pa.array(long.astype(np.int32))], ["eval_class", "train_class", "pos", "len"])


def key_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = table.column("key").combine_chunks()
    raw = np.frombuffer(keys.buffers()[2], ">u4")[keys.offset * DEPTH :][: table.num_rows * DEPTH] if table.num_rows else np.zeros(0, ">u4")
    return table.column("class").to_numpy(), table.column("at").to_numpy(), raw.reshape(-1, DEPTH)


def neighbours(rows: DataFrame, total: int) -> DataFrame:
    """(eval_class, train_class, pos, len): ``len`` words at the place ``pos`` of an evaluation text begin a training
    text's suffix as well. Every suffix is linked to the nearest of the other side before and behind it, whatever
    the number of suffixes that begin alike.

    The order is cut into ranges of about SUFFIXES by a sample, equal suffixes by ``turn``, so no run, however long, is
    sorted in one task. The outermost suffixes of each side of all ranges meet in a second, small order (four rows
    a range), so that neighbours across borders are linked as well.
    """
    ordered = rows.repartitionByRange(max(1, -(-total // SUFFIXES)), "key", "turn").sortWithinPartitions("key", "turn")
    schema = "eval_class bigint, train_class bigint, pos int, len int, part int, class bigint, at bigint, key binary"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        name, at, keys = key_rows(table)
        links = adjacent_links(name, at, keys)
        none = lambda kind: pa.nulls(links.num_rows, kind)
        names = ["eval_class", "train_class", "pos", "len", "part", "class", "at", "key"]
        yield pa.RecordBatch.from_arrays([*links.columns, none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.binary())], names)
        edge = sorted({int(x) for mask in (at & 1 != 0, at & 2 != 0) for x in np.flatnonzero(mask)[[0, -1]] if mask.any()} if len(at) else ())
        m = len(edge)
        here = pa.array(np.full(m, TaskContext.get().partitionId(), np.int32))
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), here, pa.array(name[edge]), pa.array(at[edge]), pa.array([keys[i].tobytes() for i in edge], pa.binary())], names)

    found = checkpointed(ordered.mapInArrow(link, schema))
    borders = found.where("part is not null").select("class", "at", "key", "part")
    across = borders.coalesce(1).sortWithinPartitions("part", "key").mapInArrow(lambda b: (adjacent_links(*key_rows(pa.Table.from_batches(list(b)))) for _ in (0,)), "eval_class bigint, train_class bigint, pos int, len int") if not borders.isEmpty() else None
    links = found.where("part is null").select("eval_class", "train_class", "pos", "len")
    return links if across is None else links.unionByName(across)


def shared_parts(links: DataFrame) -> DataFrame:
    """(eval_class, train_class, covered): the words of the evaluation text that the merged spans cover."""
    spans = links.groupBy("eval_class", "train_class", "pos").agg(F.max("len").alias("len"))
    before = Window.partitionBy("eval_class", "train_class").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("pos") + F.col("len")).over(before), F.lit(0))
    fresh = F.greatest(F.col("pos") + F.col("len") - F.greatest("pos", reach), F.lit(0))
    return spans.select("eval_class", "train_class", fresh.alias("fresh")).groupBy("eval_class", "train_class").agg(F.sum("fresh").alias("covered"))


# ---------------------------------------------------------------- the exact check


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per word of ``a``."""
    masks: dict[str, int] = {}
    for k, word in enumerate(a):
        masks[word] = masks.get(word, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def same_order(a: str, b: str) -> Column:
    """How many words of ``a`` stand in ``b`` in the same order."""

    @F.pandas_udf("int")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_words(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")

    return count(a, b)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (eval_class, train_class) of ``pairs`` of which enough words of the longer text stand in the other in the
    same order. Texts are shuffled to the pairs, never broadcast."""
    e = texts.where("in_eval").select(F.col("class").alias("eval_class"), F.col("words").alias("e_words"), F.col("n").alias("e_n"))
    t = texts.where("in_train").select(F.col("class").alias("train_class"), F.col("words").alias("t_words"), F.col("n").alias("t_n"))
    both = pairs.select("eval_class", "train_class").hint("merge").join(e, "eval_class").hint("merge").join(t, "train_class").where(F.least("e_n", "t_n") >= F.lit(SAME) * F.greatest("e_n", "t_n") - 1e-9)
    return both.where(same_order("e_words", "t_words") >= F.lit(SAME) * F.greatest("e_n", "t_n") - 1e-9).select("eval_class", "train_class")


def spanned_pairs(texts: DataFrame) -> DataFrame:
    """(eval_class, train_class) of different texts that share spans over COVERED of the longer one."""
    total = texts.agg(F.sum("n")).first()[0] or 0
    lengths = texts.select("class", "n")
    parts = shared_parts(neighbours(suffixes(texts), total))
    parts = parts.hint("merge").join(lengths.toDF("eval_class", "e_n"), "eval_class").hint("merge").join(lengths.toDF("train_class", "t_n"), "train_class")
    longer, shorter = F.greatest("e_n", "t_n"), F.least("e_n", "t_n")
    return parts.where((F.col("covered") >= COVERED * longer) & (shorter >= SAME * longer - 1e-9)).select("eval_class", "train_class")


# ---------------------------------------------------------------- the exact way for the rest


def word_counts(texts: DataFrame) -> np.ndarray:
    """In how many texts words of each of COUNTS buckets of hashes stand: a table of fixed size."""
    found = texts.select(F.explode(F.array_distinct(F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(COUNTS))))).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(COUNTS, np.int64)
    counts[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return counts


def rare_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words of a text one of which any text must share in which SAME of its words stand in order.

    Words are put in one order for all texts, rare ones first. Of a text's n words at most n - ceil(SAME * n) have no
    partner, so the first word in this order that has one has at most so many words before it.
    """
    order = np.lexsort((hashes, counts[hashes % COUNTS]))
    ranked = hashes[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    unpaired = len(hashes) - int(np.ceil(SAME * len(hashes) - 1e-9))
    return ranked[first[first <= unpaired]]


def filter_rows(texts: DataFrame) -> DataFrame:
    """(key, class, side, n, bins): one row for each of a text's ``rare_words``, with the text's histogram of words."""
    counts = texts.sparkSession.sparkContext.broadcast(word_counts(texts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, side, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hashes = codes.values.to_numpy(zero_copy_only=False)
                keys = rare_words(hashes, counts.value)
                bins = np.bincount((hashes >> 20) % BINS, minlength=BINS).clip(max=65_535).astype(np.uint16)
                m = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(m, name, np.int64)), pa.array(np.full(m, side, np.int32)), pa.array(np.full(m, len(hashes), np.int32)), pa.array([bins.tobytes()] * m, pa.binary())], ["key", "class", "side", "n", "bins"])

    codes = F.transform("words", lambda w: F.xxhash64(w))
    return texts.select(F.col("class").cast("bigint").alias("class"), sides(texts).alias("side"), codes.alias("codes")).mapInArrow(cut, "key bigint, class bigint, side int, n int, bins binary")


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``: keys are dealt over blocks of about ROWS rows; a key with more than that on one side is a
    grid of blocks, each with a part of either side, to which its rows are copied."""
    sized = checkpointed(rows.groupBy("key").agg(F.count_if(F.col("side").bitwiseAND(2) != 0).alias("e"), F.count_if(F.col("side").bitwiseAND(1) != 0).alias("t")).where("e > 0 and t > 0"))
    total = sized.agg(F.sum(F.col("e") + F.col("t"))).first()[0] or 0
    grid = sized.select("key", F.ceil(F.col("e") / ROWS).cast("int").alias("es"), F.ceil(F.col("t") / ROWS).cast("int").alias("ts"))
    known = rows.hint("merge").join(grid, "key")
    # A text on both sides takes both roles, one row for each.
    roles = known.withColumn("role", F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda r: F.col("side").bitwiseAND(r) != 0)))
    own = F.pmod(F.xxhash64("class"), F.when(F.col("role") == 2, F.col("es")).otherwise(F.col("ts")))
    others = F.sequence(F.lit(0), F.when(F.col("role") == 2, F.col("ts")).otherwise(F.col("es")) - 1)
    copies = roles.select("key", "class", "role", "n", "bins", "es", "ts", own.alias("own"), F.explode(others).alias("other"))
    cell = F.when(F.col("role") == 2, F.col("own") * F.col("ts") + F.col("other")).otherwise(F.col("other") * F.col("ts") + F.col("own"))
    block = F.when((F.col("es") == 1) & (F.col("ts") == 1), F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // ROWS))))).otherwise(F.xxhash64("key", cell))
    return copies.select(block.alias("block"), "key", "class", "role", "n", "bins")


def thermometer(bins: np.ndarray, levels: int) -> np.ndarray:
    """Ones for each level that a count reaches: the product of two rows is the sum of the smaller counts."""
    return (bins[:, :, None] > np.arange(levels)[None, None, :]).reshape(len(bins), -1).astype(np.float32)


def close_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a block that share a key and by their histograms and lengths may have SAME of the words in common."""
    rows = rows.sort_values("key", kind="stable")
    key, name, role, n = (rows[c].to_numpy() for c in ("key", "class", "role", "n"))
    bins = np.frombuffer(b"".join(rows["bins"]), np.uint16).reshape(-1, BINS)
    levels = int(min(LEVELS, max(bins.max(initial=1), 1)))
    over = np.maximum(bins.astype(np.int64) - levels, 0).sum(axis=1)
    # A count at the top of its range may be larger; such texts pass.
    over = np.where((bins == 65_535).any(axis=1), n, over)
    ends, out = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)), []
    begin = 0
    for end in ends:
        here = np.arange(begin, end)
        begin = end
        e, t = here[role[here] == 2], here[role[here] == 1]
        if not len(e) or not len(t):
            continue
        e, t = e[np.argsort(n[e])], t[np.argsort(n[t])]
        for part in np.array_split(e, -(-len(e) // 64)):
            # Only texts of a like length can pass.
            like = t[np.searchsorted(n[t], SAME * n[part[0]] - 1e-6) : np.searchsorted(n[t], n[part[-1]] / SAME + 1e-6, "right")]
            for other in np.array_split(like, -(-len(like) // 1024)) if len(like) else ():
                bound = thermometer(bins[part], levels) @ thermometer(bins[other], levels).T + np.minimum(over[part][:, None], over[other][None, :])
                longer, shorter = np.maximum(n[part][:, None], n[other][None, :]), np.minimum(n[part][:, None], n[other][None, :])
                i, j = np.nonzero((np.minimum(bound, shorter) >= SAME * longer - 1e-6) & (name[part][:, None] != name[other][None, :]))
                out.append(np.stack([name[part][i], name[other][j]], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame(pairs, columns=["eval_class", "train_class"])


def filtered_pairs(texts: DataFrame) -> DataFrame:
    """(eval_class, train_class): all pairs of different texts that may have SAME of the words of the longer one in
    common in one order, and few others. No pair with such an overlap is missing.

    Texts meet by the rare words of ``rare_words``; whether a pair may pass is told in its block by the histograms of
    both, so only pairs that may are ever listed. Its work grows with the square of the texts that share a key, which for
    rare words are few; texts of a small vocabulary share keys with many.
    """
    return blocked(filter_rows(texts)).groupBy("block").applyInPandas(close_pairs, "eval_class bigint, train_class bigint").distinct()


def similar_classes(texts: DataFrame) -> DataFrame:
    """All (eval_class, train_class) of different texts that are almost the same: those that the suffix array shows, and
    the rest of them by the exact filter."""
    found = checkpointed(verified(spanned_pairs(texts), texts))
    rest = filtered_pairs(texts).hint("merge").join(found, ["eval_class", "train_class"], "left_anti")
    return found.unionByName(verified(rest, texts))


def cross_split_pairs(records: DataFrame) -> DataFrame:
    """(example_id_a, example_id_b), the smaller first: one record in train, the other in validation or test, and at
    least four fifths of the words of the longer user message in the same order in the other.

    ``records`` has example_id, split and messages; more columns are ignored. Work is done on classes of equal texts;
    only the result lists their members. An empty table gives no rows.
    """
    members, texts = message_classes(records)
    members, texts = checkpointed(members), checkpointed(texts)
    pairs = similar_classes(texts).unionByName(texts.where("in_train and in_eval").select(F.col("class").alias("eval_class"), F.col("class").alias("train_class")))
    e = members.where("side = 'eval'").select(F.col("class").alias("eval_class"), F.col("example_id").alias("e"))
    t = members.where("side = 'train'").select(F.col("class").alias("train_class"), F.col("example_id").alias("t"))
    return pairs.hint("merge").join(e, "eval_class").hint("merge").join(t, "train_class").where("e <> t").select(F.least("e", "t").alias("example_id_a"), F.greatest("e", "t").alias("example_id_b")).distinct()


def overlap_report(records: DataFrame) -> DataFrame:
    """(split, source, n_records, n_overlapping): how many of a split's records of a source also stand on the other
    side; splits are train, validation and test, a null source is '?'. Told from classes, without a list of pairs of records."""
    label = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    name = F.when(label.startswith("train"), "train").when(label.startswith("test"), "test").when(label.rlike("^(?:val|dev|eval)"), "validation").otherwise("?")
    rows = records.where("example_id is not null").select("example_id", name.alias("split"), F.coalesce("source", F.lit("?")).alias("source")).distinct()
    members, texts = message_classes(records)
    members, texts = checkpointed(members), checkpointed(texts)
    pairs = checkpointed(similar_classes(texts))
    both = texts.where("in_train and in_eval")
    hit = (
        pairs.select(F.col("eval_class").alias("class"), F.lit("eval").alias("side")).union(pairs.select("train_class", F.lit("train")))
        .union(both.select("class", F.lit("eval"))).union(both.select("class", F.lit("train"))).distinct()
    )
    # A record that stands in two splits itself is no pair with itself.
    alone = members.groupBy("class").agg(F.min("example_id").alias("lo"), F.max("example_id").alias("hi")).where("lo = hi").select("class").hint("merge").join(both.select("class"), "class", "left_semi")
    paired = pairs.select(F.explode(F.array("eval_class", "train_class")).alias("class")).distinct()
    alone = alone.hint("merge").join(paired, "class", "left_anti")
    hit = members.hint("merge").join(hit, ["class", "side"], "left_semi").hint("merge").join(alone, "class", "left_anti").select("example_id").distinct().withColumn("hit", F.lit(1))
    return rows.hint("merge").join(hit, "example_id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_records"), F.count("hit").alias("n_overlapping"))
