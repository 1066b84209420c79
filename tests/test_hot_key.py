from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.streaming import admission, windows


def test_rows_of_a_key_come_in_bounded_pieces():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"ts": pd.to_datetime(rng.integers(0, 500, 5_000), unit="s"), "known": rng.random(5_000) > 0.1, "event_id": rng.permutation(5_000)})
    parts = (rows[i : i + 70] for i in range(0, 5_000, 70))
    got = list(admission.in_order(parts, 200))
    assert max(map(len, got)) == 200
    want = rows.sort_values(["ts", "known", "event_id"])
    assert [r[2] for r in np.concatenate(got).tolist()] == want["event_id"].tolist()


def test_hot_key_in_a_stream_like_the_batch(spark, tmp_path):
    rows = spark.range(120_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 50 != 0, F.lit(1)).alias("key").cast("long"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("ts")
    )
    late = spark.createDataFrame([(None, 2, datetime(2024, 1, 1)), (7, 2, datetime(2024, 1, 1) + timedelta(seconds=1)), (5, 2, None)], "event_id long, key long, ts timestamp")
    rows.union(late).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = windows.run_to_table(admission.admitted_stream(stream, 2, 60), spark, "append")
    want = admission.admitted(spark.read.parquet(f"{tmp_path}/in/a"), 2, 60)
    key = lambda df: sorted(((r.event_id, r.key, r.ts, r.allowed) for r in df.collect()), key=repr)
    assert key(got) == key(want)
