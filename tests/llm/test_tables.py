"""The prefilter that spares shuffles: a superset that hardly holds more than what is wanted."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.llm.tables import maybe_among, not_among


def test_prefilter_keeps_all_wanted_and_few_others(spark):
    rows = spark.range(400_000).select(F.xxhash64("id").alias("key"), "id")
    wanted = rows.where("id % 8 = 3").select("key")  # 50,000: a fifth of 2**18
    kept = maybe_among(rows, F.col("key"), wanted)
    by = kept.agg(F.count_if(F.col("id") % 8 == 3).alias("wanted"), F.count_if(F.col("id") % 8 != 3).alias("others")).first()
    assert by.wanted == 50_000
    assert by.others < 350_000 // 100
    left = not_among(rows, F.col("key"), wanted)
    assert left.where("id % 8 = 3").isEmpty()
    assert left.count() + kept.count() == 400_000


def test_prefilter_with_nulls_repeats_and_nothing_wanted(spark):
    rows = spark.createDataFrame([(1,), (1,), (None,), (2,), (-(1 << 63),)], "key long")
    wanted = spark.createDataFrame([(1,), (1,), (None,), (-(1 << 63),)], "key long")
    kept = sorted(maybe_among(rows, F.col("key"), wanted).collect(), key=str)
    assert [r.key for r in kept if r.key is not None and r.key != 2] == [-(1 << 63), 1, 1]
    assert maybe_among(rows, F.col("key"), wanted.where("false")).isEmpty()
    assert not_among(rows, F.col("key"), wanted.where("false")).count() == 5


def test_tables_on_the_way_go(spark):
    """Every table that was settled on the way stayed, so a pipeline held those of all its stages."""
    import os

    from pagelattice.llm import decontaminate, lines, neardup
    from pagelattice.session import shared_folder

    held = lambda: {f for f in os.listdir(shared_folder(spark).removeprefix("file://")) if f.startswith("llm-")}
    text = lambda i: " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(60))
    rows = [(i, text(i // 3) + (f"\nrest {i}" if i % 3 == 2 else "") + "\nthe line that all have in common") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, text(4))], "item_id long, text string")
    for work in (lines.deduplicated, neardup.one_of_each_group, lambda d: decontaminate.clean(d, marks)):
        before = held()
        out = work(docs)
        assert len(held() - before) == 1
        first = sorted(out.collect())
        assert 0 < len(first) < 60 and sorted(out.collect()) == first
