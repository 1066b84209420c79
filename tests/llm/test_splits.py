from pyspark.sql import functions as F

from millrace.llm import splits

COLUMNS = "entry_id long, instance_id string, repo string, resolved boolean, component string"


def entries(spark, rows):
    return spark.createDataFrame([(i, t, r, (i or 0) % 2 == 0, "clash") for i, t, r in rows], COLUMNS)


def moves(spark, rows=(("a/old", "A/new"), ("a/new", "b/newest"))):
    return spark.createDataFrame([(*r, None) for r in rows] + [(None, "x/y", None)], "old_repo string, new_repo string, moved_at timestamp")


SPELLINGS = [
    (1, "a__old-7", None), (2, " A__NEW-007 ", "z/z"), (3, "b/newest#7", None), (4, "https://forge.example/a/new/issues/7/", None), (5, "GH-7", "a/old.git"),
    (6, "issue-7", "A/NEW"), (7, "#7", "b/newest"), (8, "7", "a/old"), (9, "a__old-7.attempt-3", None), (10, "a__old-7@run2", None), (11, "a__old-7 (retry 2)", None),
    (12, "https://forge.example/a/old/issues/7#comment-9", None),
]


def test_all_spellings_of_an_issue(spark):
    rows = SPELLINGS + [(20, "c__py3-x-4d-12", None), (21, "c/py3-x-4d#12", None), (30, "c__py3-x-4d-13", None), (31, None, "a/old"), (32, "  ", "a/old"), (33, "GH-7", None), (None, "a__old-7", None)]
    df = entries(spark, rows)
    got = {(r.group_id, r.entry_id) for r in splits.related_entries(df.union(df), moves(spark)).collect()}
    assert got == {(1, i) for i, *_ in SPELLINGS} | {(20, 20), (20, 21)}
    assert splits.related_entries(df.limit(0), moves(spark)).count() == 0
    assert splits.related_entries(df, moves(spark).limit(0)).where("group_id = 20").count() == 2


def test_groups_stay_together_and_shares_hold(spark):
    rows = [(i, f"o__r-{i // 3}", None) for i in range(1, 1500)] + [(5000 + i, "o__hot-1", None) for i in range(300)]
    got = splits.split_entries(entries(spark, rows), moves(spark)).cache()
    assert got.count() == len(rows)
    assert got.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {r.split: r["count"] / len(rows) for r in got.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02
    labels = got.join(entries(spark, rows).select("entry_id", "resolved"), "entry_id").groupBy("split").agg(F.avg(F.col("resolved").cast("int")).alias("a")).collect()
    assert all(abs(r.a - 0.5) < 0.06 for r in labels)


def test_split_of_nothing(spark):
    assert splits.split_entries(entries(spark, [(1, "a__b-1", None)]).limit(0), moves(spark)).count() == 0
    assert splits.split_entries(entries(spark, [(1, None, None)]), moves(spark)).count() == 1


def test_least_deviation_of_labels(spark):
    """A few large groups of one label each; the small ones mend what they leave askew."""
    rows = [(100_000 * g + i, f"o__big-{g}", None, g % 2 == 0) for g in range(1, 8) for i in range(40 * g)] + [(i, f"o__r-{i // 2}", None, i % 4 < 2) for i in range(1, 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS)
    got = splits.split_entries(df, moves(spark))
    rows = splits.split_deviation(got, df.select("entry_id", F.col("resolved").alias("label"))).collect()
    assert len(rows) == 6 and all(abs(r.deviation) < 0.005 for r in rows), rows


def test_more_entities(spark):
    rows = [(i, f"o__r-{i}", None) for i in range(1, 200)]
    df = entries(spark, rows)
    authors = spark.createDataFrame([(i, i // 10, "x") for i in range(1, 200)] + [(None, 1, "x"), (5000, 1, "x")], "entry_id long, entity long, split string")
    got = splits.split_entries(df, moves(spark), more=authors)
    assert got.count() == 199 and got.select("group_id").distinct().count() == 20
    assert got.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
