from millrace.plans import catalog


def test_last_state_of_every_attempt(spark, data):
    rows = spark.read.parquet(f"{data}/trajectories.parquet").select("entry_id", "attempt", "resolved").where("attempt is not null").distinct()
    want = {r.attempt: r["count"] for r in rows.groupBy("attempt").count().collect()}
    got = {r.attempt: r.n for r in catalog.QUERIES["progress_all"](spark, data).groupBy("attempt").max("n").withColumnRenamed("max(n)", "n").collect()}
    assert got == want
