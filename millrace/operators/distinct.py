"""Rows counted once without shuffling wide columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: So many keys of repeated rows are broadcast at most; beyond that the rows are shuffled.
BROADCAST_KEYS = 500_000


def comparable(df: DataFrame) -> list[Column]:
    """The columns of ``df``, maps as their sorted entries, since maps can't be compared."""
    return [F.array_sort(F.map_entries(df[f.name])).alias(f.name) if isinstance(f.dataType, MapType) else df[f.name] for f in df.schema]


def dropped(df: DataFrame) -> DataFrame:
    """``df`` with rows equal in all columns, maps included, only once."""
    if not any(isinstance(f.dataType, MapType) for f in df.schema):
        return df.dropDuplicates()
    digest = F.sha2(F.to_json(F.struct(*comparable(df)), {"ignoreNullFields": "false"}), 256)
    return df.withColumn("_digest", digest).dropDuplicates(["_digest"]).drop("_digest")


def rows_once(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with rows that are repeated as a whole only once; rows that differ in any column all stay.

    Only rows whose ``keys`` occur several times are compared, in all columns. A first job over the keys finds them;
    where they are few, as the count then shows, they are broadcast and the other rows are not shuffled at all.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys))
    found = repeated.limit(BROADCAST_KEYS + 1).count()
    if not found:
        return df
    if found > BROADCAST_KEYS:
        return dropped(df)
    same = [df[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    few = F.broadcast(repeated)
    return df.join(few, same, "left_anti").unionByName(dropped(df.join(few, same, "left_semi")))
