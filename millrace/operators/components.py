"""Connected components of a bipartite record-entity graph by minimum-label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpointed


def record_components(links: DataFrame, record: str = "record", entity: str = "entity", max_rounds: int = 60) -> DataFrame:
    """Label every record with the smallest record reachable over shared entities.

    ``links`` has one row per record and entity; more columns are ignored and repeated rows do no harm. Rows
    with a null record are dropped, a record whose entities are all null forms a component of its own.
    Returns (``record``, ``component``), one row per record; an empty input gives an empty result.

    A round sends labels record -> entity -> record. Both directions are ``groupBy(...).min`` with a partial
    aggregation before the shuffle, so an entity that holds a third of all records reaches its reducer as one
    row per map task; the join back is split by AQE's skew handling. Records with a single entity can't carry a
    label further, so only the records with several entities take part in the rounds after the first, and a
    pointer jump (label := label of the label) halves long chains. Each round ends in a reliable checkpoint, and
    so do the distinct links, which are read several times and may be costly to make.
    """
    edges = checkpointed(links.where(F.col(record).isNotNull()).select(F.col(record).alias("_r"), F.col(entity).alias("_e")).distinct())
    known = edges.where(F.col("_e").isNotNull())
    degree = edges.groupBy("_r").agg(F.count("_e").alias("_n"))
    # The first round: every entity gets its smallest record.
    seeds = known.groupBy("_e").agg(F.min("_r").alias("_c"))
    bridges = checkpointed(known.join(degree.where("_n > 1").select("_r"), "_r", "left_semi"))
    if bridges.isEmpty():
        labels = seeds
    else:
        # Entities exchange labels over the records that link several of them.
        state = checkpointed(bridges.join(seeds, "_e"))
        labels = seeds
        for _ in range(max_rounds):
            by_record = state.groupBy("_r").agg(F.min("_c").alias("_m"))
            by_entity = state.join(by_record, "_r").groupBy("_e").agg(F.min("_m").alias("_m"))
            moved = state.join(by_entity, "_e").select("_r", "_e", F.least("_c", "_m").alias("_c"), (F.col("_m") < F.col("_c")).alias("_moved"))
            jump = moved.groupBy("_r").agg(F.min("_c").alias("_j")).withColumnRenamed("_r", "_c")
            state = checkpointed(
                moved.join(jump, "_c", "left").select("_r", "_e", F.least("_c", F.coalesce("_j", "_c")).alias("_c"), (F.col("_moved") | F.coalesce(F.col("_j") < F.col("_c"), F.lit(False))).alias("_moved"))
            )
            if state.where("_moved").isEmpty():
                break
            state = state.drop("_moved")
        else:
            raise RuntimeError(f"labels still move after {max_rounds} rounds")
        better = state.groupBy("_e").agg(F.min("_c").alias("_b"))
        labels = seeds.join(better, "_e", "left").select("_e", F.coalesce(F.least("_c", "_b"), "_c").alias("_c"))
    return (
        edges.join(labels, "_e", "left")
        .groupBy("_r")
        .agg(F.min(F.coalesce("_c", "_r")).alias("component"))
        .withColumnRenamed("_r", record)
    )
