"""Filling fixed-capacity containers with texts: best-fit decreasing with a segment tree over free capacities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.encoding import RANKS_FILE, token_count
from millrace.operators.distinct import rows_once

#: Items that one task packs together, on average. Only the last containers of each such bucket stay partly
#: empty, so the space lost by packing buckets apart is below one container per bucket.
BUCKET_ITEMS = 20_000


class FreeSpace:
    """Open containers by free capacity. A segment tree over the capacities counts the containers below each
    node, so the tightest container that still takes an item is found in logarithmic time."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, container: int, free: int) -> None:
        self.open[free].append(container)
        node = self.width + free
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, size: int) -> int | None:
        """The least free capacity of at least ``size`` that some container has."""
        count, node = self.count, self.width + size
        if count[node]:
            return size
        while node > 1:  # up, until a right sibling holds a container
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.width:  # down, to the left where possible
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.width

    def take(self, free: int) -> int:
        node = self.width + free
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.open[free].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, from 0, of each item; every size must be from 1 to ``capacity``. Equal sizes keep their order."""
    space, containers, n = FreeSpace(capacity), np.empty(len(sizes), dtype=np.int64), 0
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        free = space.tightest(size)
        if free is None:
            at, free, n = n, capacity, n + 1
        else:
            at = space.take(free)
        containers[k] = at
        if free > size:
            space.add(at, free - size)
    return containers


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """``items``(item, size) with one row per piece (item, piece, start, n): an item larger than ``capacity`` is
    cut into full pieces and a rest, any other is piece 0. Items of size 0 and null have one piece of size 0."""
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long")
    n = F.greatest(F.ceil(size / capacity), F.lit(1))
    return items.select("item", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece")).select(
        "item", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).alias("n")
    )


def pack(items: DataFrame, capacity: int, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """Put ``items``(item, size) into containers: (container_id, item, piece, start, n).

    A piece that fills a container has it alone. All others are dealt over buckets by a hash of the item, about
    ``bucket_items`` to each, so every bucket has the same mixture of sizes and none grows with the data, and each
    bucket is packed by best-fit decreasing. An item of size 0 takes no space: its container_id is null. Items
    with equal ids and sizes are packed one by one.
    """
    rows = pieces(items, capacity)
    n_items = items.count()
    buckets = max(1, round(n_items / bucket_items))
    bucket: Column = F.pmod(F.xxhash64("item", "piece"), F.lit(buckets))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "item", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["n"].to_numpy()
        full, part = sizes >= capacity, (sizes > 0) & (sizes < capacity)
        inside = best_fit_decreasing(sizes[part], capacity)
        at = np.zeros(len(pdf), dtype=np.int64)
        at[part] = inside
        at[full] = np.arange(full.sum()) + (inside.max() + 1 if len(inside) else 0)
        container = pd.Series(at * buckets + pdf["bucket"].to_numpy(), index=pdf.index, dtype="Int64").mask(sizes <= 0)
        return pdf.assign(container_id=container).drop(columns="bucket")

    item = rows.schema["item"].dataType.simpleString()
    packed = rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
        fill, f"item {item}, piece int, start bigint, n bigint, container_id bigint"
    )
    return packed.select("container_id", "item", "piece", "start", "n")


def pack_documents(documents: DataFrame, capacity: int = 2000, ranks_file: str = RANKS_FILE) -> DataFrame:
    """(container_id, doc_id, piece, start_token, n_tokens) of all texts of ``documents``(doc_id, text), measured
    in tokens; null and empty texts come out with 0 tokens and a null container. Repeated rows count once."""
    rows = rows_once(documents.select("doc_id", "text"), "doc_id")
    sized = rows.select(F.col("doc_id").alias("item"), token_count("text", ranks_file).alias("size"))
    packed = pack(sized, capacity)
    return packed.select("container_id", F.col("item").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("n").alias("n_tokens"))


def fill_report(packed: DataFrame, capacity: int = 2000) -> DataFrame:
    """One row: containers, tokens, the unused share of all space, and the least number of containers possible."""
    per = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.round(1 - F.coalesce(F.sum("used"), F.lit(0)) / F.greatest(F.count(F.lit(1)) * capacity, F.lit(1)), 6).alias("unused_share"),
        F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("least_containers"),
    )
