"""What a written step leaves behind."""

import time

from pyspark.sql import functions as F

from pagelattice import session
from pagelattice.llm import tables


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if f.endswith(".data") and "shuffle_" in f}


def test_shuffle_files_of_a_written_step_go_with_it(spark):
    """They stayed until the driver collected garbage, so a query of many steps held them all at once."""
    conf = spark.conf.get(session._CLEANUP, None)
    for write in (session.settled, tables.settled, session.reliable_checkpoint):
        before = shuffle_files(spark)
        rows = spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s"))
        out = write(rows)
        until = time.time() + 20  # files are deleted in the background
        while shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.1)
        assert not shuffle_files(spark) - before
        assert out.count() == 5000 and out.where("k = 7").first().s == sum(range(7, 100_000, 5000))
        assert rows.count() == 5000 and rows.collect() and rows.collect()
    assert spark.conf.get(session._CLEANUP, None) == conf


def test_writes_at_once_restore_the_setting(spark):
    spark.conf.set(session._CLEANUP, "false")
    try:
        with session.shuffles_end(spark):
            with session.shuffles_end(spark):
                pass
            assert spark.conf.get(session._CLEANUP) == "true"
        assert spark.conf.get(session._CLEANUP) == "false"
    finally:
        spark.conf.unset(session._CLEANUP)
