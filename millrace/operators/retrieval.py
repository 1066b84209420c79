"""Ranking: BM25, exact vector search, reciprocal rank fusion, recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpointed, written

K1, B, FLOOR = 1.5, 0.75, 0.25
#: About so many rows make a block of queries or documents; where they meet, terms that at least this share of the pairs
#: have in common are multiplied as matrices, up to so many terms and cells, the others along their postings, so many products at
#: once. A product in a matrix takes some 1/300 of the time of one along postings, so the share is small.
QUERY_TERMS, POSTINGS, DENSE, DENSE_TERMS, CELLS, PRODUCTS = 1 << 17, 1 << 19, 0.004, 1 << 10, 1 << 23, 1 << 21
#: Pairs that are summed again at once.
PIECE = 1 << 12
#: Documents of a group; the largest score of each is compared before single ones are.
GROUP = 64
#: Vectors of a block; blocks of queries meet blocks of the corpus as matrices.
BLOCK = 1024


def bm25_index(docs: DataFrame) -> DataFrame:
    """Postings (term, doc, weight) of ``docs``(doc, tokens): the BM25 score that one occurrence of the term in a query
    adds to the document. Documents without tokens have none.

    idf = ln(N - n + .5) - ln(n + .5); a negative one is replaced by FLOOR times the mean idf of all terms. Corpus
    figures are one-row aggregates; terms are counted with partial aggregation before the shuffle. Documents are read once,
    their words and these counts are each written once.
    """
    docs = written(docs.select("doc", "tokens")).where(F.size("tokens") > 0)
    sizes = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("tokens")).alias("mean_length"))
    tf = written(docs.select("doc", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("term", "doc", "length").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(sizes))
    idf = df.select("term", "mean_length", (F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", "mean_length", F.when(F.col("idf") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return tf.join(idf, "term").select("term", "doc", (F.col("idf") * part).alias("weight"))


def bm25(queries: DataFrame, index: DataFrame, k: int = 20) -> DataFrame:
    """(query, doc, score, rank) of the ``k`` best documents of each of ``queries``(query, tokens) with a positive score;
    repeated terms count each time, ties go to the smaller document."""
    terms = queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    return sparse_top(terms, index, k)


def packed(rows: DataFrame, item: str, weight: str, size: int) -> DataFrame:
    """``rows``(term, ``item``, ``weight``) in blocks of about ``size`` rows, all rows of an item in one: the terms and the
    items of a block, and as bytes the places of its rows in them, and their weights. One row and one task per block."""
    kept = written(rows.select("term", F.col(item).cast("bigint").alias("item"), F.col(weight).cast("double").alias("weight")).where("term is not null and item is not null"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            block = pa.Table.from_batches(parts)
            term = block["term"].combine_chunks().dictionary_encode()
            items, at = np.unique(block["item"].to_numpy(), return_inverse=True)
            row = {"terms": term.dictionary.to_pylist(), "items": items.tobytes(), "term": term.indices.to_numpy().astype(np.int32).tobytes(), "at": at.astype(np.int32).tobytes(), "weight": block["weight"].to_numpy().tobytes()}
            yield pa.RecordBatch.from_pylist([row])

    blocks = kept.repartition(max(1, -(-kept.count() // size)), "item")
    return checkpointed(blocks.mapInArrow(pack, "terms array<string>, items binary, term binary, at binary, weight binary"))


def least_of_best(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row a positive bound that its ``k`` best positive scores reach, and not many others: the k-th best of the
    largest scores of groups of columns, as each of those groups has a score at least as large, or of the columns themselves
    where the groups are few. A millionth is taken off, as rounding may still order what is closer."""
    n = scores.shape[1] // GROUP
    best = scores
    if n > 4 * k:
        best = scores[:, : n * GROUP].reshape(-1, GROUP, n).max(axis=1)
    if k >= best.shape[1]:
        return np.full((len(scores), 1), np.nextafter(0, 1))
    least = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k, None] - 1e-6
    return np.maximum(least, np.nextafter(0, 1))


def block_top(q: dict, c: dict, k: int) -> pa.RecordBatch:
    """(query, doc, score) of the ``k`` best documents of block ``c`` with a positive score, rounded to six places, for each
    query of block ``q``; ties go to the smaller document. Sums in single precision, which take half the time, tell which
    documents may be among the best, by a bound of their error; only those are summed in double precision."""
    known = {t: i for i, t in enumerate(c["terms"])}
    queries, docs = np.frombuffer(q["items"], np.int64), np.frombuffer(c["items"], np.int64)
    term = np.array([known.get(t, -1) for t in q["terms"]], np.int64)[np.frombuffer(q["term"], np.int32)]
    q_at, times = np.frombuffer(q["at"], np.int32), np.frombuffer(q["weight"])
    order = np.argsort(q_at, kind="stable")
    order = order[term[order] >= 0]
    term, q_at, times = term[order], q_at[order].astype(np.int64), times[order]
    c_term = np.frombuffer(c["term"], np.int32)
    order = np.argsort(c_term, kind="stable")
    c_at, weight = np.frombuffer(c["at"], np.int32)[order], np.frombuffer(c["weight"])[order]
    have = np.bincount(c_term, minlength=len(known))
    start = np.cumsum(have) - have
    # Terms that many of both have: a matrix of weights by document.
    common = have * np.bincount(term, minlength=len(known))
    dense = np.argsort(-common, kind="stable")[: min(DENSE_TERMS, CELLS // len(docs))]
    dense = dense[common[dense] > DENSE * len(queries) * len(docs)]
    row_of = np.full(len(known), -1)
    row_of[dense] = np.arange(len(dense))
    by_doc = np.zeros((len(docs), len(dense)))
    for i, t in enumerate(dense):
        by_doc[c_at[start[t] : start[t] + have[t]], i] = weight[start[t] : start[t] + have[t]]
    matrix = np.ascontiguousarray(by_doc.T, np.float32)
    largest = np.zeros(len(known))
    np.maximum.at(largest, c_term[order], np.abs(weight))
    signed = bool((weight < 0).any() or (times < 0).any())
    products = np.where(row_of[term] < 0, have[term], 0)
    done = np.concatenate([[0], np.cumsum(np.bincount(q_at, products, len(queries)))])
    ends = np.searchsorted(q_at, np.arange(len(queries) + 1))
    found, first, most = [], 0, max(1, PRODUCTS // len(docs))
    while first < len(queries):
        last = min(first + most, max(first + 1, int(np.searchsorted(done, done[first] + PRODUCTS, "right")) - 1), len(queries))
        own = slice(ends[first], ends[last])
        t, at, x, in_row = term[own], q_at[own] - first, times[own], row_of[term[own]]
        level = np.zeros((last - first, len(dense)))
        level[at[in_row >= 0], in_row[in_row >= 0]] = x[in_row >= 0]
        # Twice what a sum of so many products, in any order, can be off.
        error = (np.bincount(at, minlength=last - first) + 4) * np.finfo(np.float32).eps * np.bincount(at, np.abs(x) * largest[t], last - first)
        scores = level.astype(np.float32) @ matrix
        t, at, x = t[in_row < 0], at[in_row < 0], x[in_row < 0]
        n = have[t]
        part = np.repeat(np.arange(len(t)), n)
        place = np.arange(len(part)) + (start[t] - (np.cumsum(n) - n))[part]
        along = np.bincount((at * len(docs))[part] + c_at[place], x[part] * weight[place], scores.size).astype(np.float64, copy=False)
        np.add(scores, along.reshape(scores.shape), out=scores, casting="same_kind")
        # A sum of positive products that rounds to more than 0 is above a ten-millionth in either precision.
        least = np.maximum(least_of_best(scores, k).astype(np.float64) - 1e-6 - 2 * error[:, None], -error[:, None] if signed else 1e-7)
        cell = np.flatnonzero(scores >= least.astype(np.float32))
        r, d = np.divmod(cell, len(docs))
        s = along[cell]
        for i in range(0, len(cell), PIECE):
            s[i : i + PIECE] += np.einsum("ij,ij->i", level[r[i : i + PIECE]], by_doc[d[i : i + PIECE]])
        s = np.floor(s * 1e6 + 0.5) / 1e6
        order = np.lexsort((docs[d], -s, r))
        r, d, s = r[order], d[order], s[order]
        keep = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (s > 0)
        found.append((queries[first + r[keep]], docs[d[keep]], s[keep]))
        first = last
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query", "doc", "score"])


def sparse_top(terms: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank): for each query the ``k`` documents with the largest positive sum of times x weight over
    the terms that both have, exactly; ties go to the smaller document.

    ``terms`` has (query, term, times), ``postings`` (term, doc, weight), each term once per query and document; both ids
    are whole numbers, rows without one count nothing. Blocks of queries meet blocks of documents, one task each, and pass
    on ``k`` rows per query, which a window merges; no row is made for a pair of query and document.
    """
    kinds = {"query": dict(terms.dtypes)["query"], "doc": dict(postings.dtypes)["doc"]}
    q, c = packed(terms, "query", "times", QUERY_TERMS), packed(postings, "doc", "weight", POSTINGS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield block_top({x[2:]: v for x, v in r.items() if x[0] == "q"}, {x[2:]: v for x, v in r.items() if x[0] == "c"}, k)

    pairs = q.select(*(F.col(x).alias(f"q_{x}") for x in q.columns)).hint("shuffle_replicate_nl").crossJoin(c.select(*(F.col(x).alias(f"c_{x}") for x in c.columns)))
    found = pairs.mapInArrow(meet, "query bigint, doc bigint, score double")
    return top(found.select(*(F.col(x).cast(kind).alias(x) for x, kind in kinds.items()), "score"), k)


def top(scores: DataFrame, k: int, by: str = "query", item: str = "doc", score: str = "score") -> DataFrame:
    """The ``k`` best rows per query with their ``rank`` from 1, ties by the item."""
    order = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_blocks(vectors: DataFrame, seed: int) -> DataFrame:
    """``vectors``(id, vector) in blocks (block, ids, matrix) of about BLOCK vectors, dealt by a hash of the id."""
    n = max(1, round(vectors.count() / BLOCK))
    return vectors.groupBy(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("vector").alias("matrix"))


def dense_top(queries: DataFrame, corpus: DataFrame, k: int = 20) -> DataFrame:
    """(query, doc, score, rank): the ``k`` corpus vectors with the largest cosine for every query vector, exactly.

    Both have (id, vector). Blocks of queries meet blocks of the corpus; each meeting is a matrix product that
    passes on ``k`` rows per query, and a window merges them. A zero vector has the cosine 0 with all.
    """
    q = vector_blocks(queries.where("id is not null and vector is not null"), 1).select(F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q"))
    c = vector_blocks(corpus.where("id is not null and vector is not null"), 2).select(F.col("block").alias("cb"), F.col("ids").alias("c_ids"), F.col("matrix").alias("c"))

    def unit(rows) -> np.ndarray:
        m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length == 0, 1, length)

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                ids, score = np.asarray(r.c_ids), np.round(unit(r.q) @ unit(r.c).T, 6) + 0.0
                best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                yield pd.DataFrame({"query": np.repeat(np.asarray(r.q_ids), best.shape[1]), "doc": ids[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    pairs = q.crossJoin(c).repartition("qb", "cb")
    return top(pairs.mapInPandas(meet, "query bigint, doc bigint, score double"), k)


def fuse(rankings: dict[str, tuple[DataFrame, float]], k: int = 10, damping: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (query, doc, rank), each with its weight: (query, doc, score, rank) and the
    rank in each as ``<name>_rank``, null where the document is missing. One union and one aggregation, no joins."""
    rows = None
    for name, (ranking, weight) in rankings.items():
        part = ranking.select("query", "doc", (F.lit(weight) / (damping + F.col("rank"))).alias("share"), F.lit(name).alias("list"), F.col("rank").alias("r"))
        rows = part if rows is None else rows.unionByName(part)
    found = rows.groupBy("query", "doc").agg(F.round(F.sum("share"), 9).alias("score"), *(F.max(F.when(F.col("list") == n, F.col("r"))).alias(f"{n}_rank") for n in rankings))
    return top(found, k)


def recall(predicted: Column, gold: Column, k: int) -> tuple[Column, Column]:
    """Share of the distinct gold items among the first ``k`` predicted, and whether there is any; 0 without gold."""
    found = F.size(F.array_intersect(F.slice(predicted, 1, k), gold))
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, found / n).otherwise(0.0), F.when(found > 0, 1).otherwise(0)
