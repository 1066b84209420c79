from pyspark.sql import functions as F

from millrace.operators import schema_drift


def test_signs_of_the_whole_value(spark):
    start = "one two, " * 30
    rows = spark.createDataFrame([(1, start + "{a}"), (2, start + "[a]"), (3, "--"), (4, ""), (5, "a-b")], "id int, v string")
    got = {r.id: r.t for r in rows.select("id", schema_drift.value_tokens(F.col("v"), F.lit("string")).alias("t")).collect()}
    assert ", {w}" in got[1] and ", [w]" in got[2] and ", {w}" not in got[2]
    assert got[3] == [] and got[4] == [] and got[5] == ["a", "b", "w-", "-w"]
