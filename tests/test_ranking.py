"""Two-level row numbers and validity intervals against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagelattice.operators import history, ranking


def test_numbers_equal_sorting(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "b", None]), r.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "project string, seq int, id int").repartition(7)
    want = {}
    for k in ("hot", "b", None):
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want.update({x[2]: n for n, x in enumerate(own, 1)})
    got = {x.id: x.rn for x in ranking.first_rows(df, ["project"], ["seq", "id"], None).collect()}
    assert got == want
    few = {x.id: x.rn for x in ranking.first_rows(df, ["project"], ["seq", "id"], 5).collect()}
    assert few == {i: n for i, n in want.items() if n <= 5}
    assert ranking.numbered(df.limit(0), ["project"], ["seq", "id"]).collect() == []


def test_a_hot_group_lies_in_many_ranges(spark):
    df = spark.range(20000).select(F.lit("hot").alias("project"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = df.repartitionByRange("project", "id").groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == 8 and max(x["count"] for x in dealt) < 20000 / 2
        assert ranking.numbered(df, ["project"], ["id"]).where("rn <> id + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_intervals_of_runs(spark):
    runs = [("t1", {"kept": 1, "dropped": 1, "back": 1}), ("t2", {"kept": 2, "late": 1}), ("t3", {"kept": 2, "back": 5, "late": 1}), ("t4", {})]
    schema = "id string, value int"
    frame = lambda found: spark.createDataFrame([*found.items(), *list(found.items())[:1], (None, 9)], schema)
    past, seen = history.empty_history(frame({})), []
    for at, found in runs:
        past = history.merge_run(past, frame(found), at)
        seen.append({tuple(x) for x in past.select("id", "value", *history.TIMES, "action").collect()})
    assert seen[0] == {(i, 1, "t1", "t1", "t1", None, "created") for i in ("kept", "dropped", "back")}
    assert seen[1] == {("kept", 2, "t1", "t1", "t2", None, "kept"), ("late", 1, "t2", "t2", "t2", None, "created"), *[(i, 1, "t1", "t1", "t1", "t2", "dropped") for i in ("dropped", "back")]}
    assert ("back", 5, "t1", "t3", "t3", None, "returned") in seen[2] and ("back", 1, "t1", "t1", "t1", "t2", "past") in seen[2]
    assert {x[0]: (x[5], x[6]) for x in seen[3] if x[6] != "past"} == {i: ("t4", "dropped") for i in ("kept", "late", "back")}
    again = history.merge_run(history.merge_run(history.empty_history(frame({})), frame({"a": 1}), "t1"), frame({"a": 1}), "t1")
    assert [tuple(x) for x in again.select("id", *history.TIMES).collect()] == [("a", "t1", "t1", "t1", None)]
    assert [x.is_new for x in history.found_in_run(again).collect()] == [False]
