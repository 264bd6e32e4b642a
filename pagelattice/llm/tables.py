"""What the operators of this package share: picking columns, cutting lineage, sizing."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.session import shared_folder, write_rows


# Paths that each thread's open `settled_alone` calls have settled, the innermost last.
_STEPS = threading.local()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, found by exact name, so other columns may be called anything."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[n]}").alias(n) for n in names])


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends there, and lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    write_rows(df, path, compression="zstd")
    if getattr(_STEPS, "open", None):
        _STEPS.open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes settled tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` plans, settled; the tables that were settled while it was planned go, so nothing else may read them."""
    if not hasattr(_STEPS, "open"):
        _STEPS.open = []
    _STEPS.open.append([])
    try:
        df = make()
    finally:
        steps = _STEPS.open.pop()
    out = settled(df)
    dropped(df.sparkSession, steps)
    return out


def rows_per(df_rows: int, each: int) -> int:
    """How many buckets of about ``each`` rows hold ``df_rows`` rows."""
    return max(1, -(-df_rows // each))


def _place(value: Column, bits: int) -> Column:
    """The place of a value's hash among 2**(bits + 6) marks."""
    return F.xxhash64(value).bitwiseAND(F.lit((1 << bits + 6) - 1))


def _marked(df: DataFrame, value: Column, wanted: DataFrame, bits: int, how: str) -> DataFrame:
    """A semi or anti join with the marks of ``wanted``, 64 of them in each broadcast row."""
    place = _place(F.col(wanted.columns[0]), bits)
    marks = wanted.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("mark"))
    marks = marks.groupBy("word").agg(F.bit_or("mark").alias("marks"))
    at = _place(value, bits)
    return df.join(F.broadcast(marks), (F.shiftright(at, 6) == F.col("word")) & (F.getbit("marks", at.bitwiseAND(F.lit(63)).cast("int")) == 1), how)


def maybe_among(df: DataFrame, value: Column, wanted: DataFrame, bits: int = 18) -> DataFrame:
    """The rows whose ``value`` may be the one column of ``wanted``: a superset, found without a shuffle.

    What is broadcast are marks at the hashes of the wanted values, in at most 2**bits rows whatever the size of ``wanted``; an exact
    join has to follow. Of the other rows it keeps about one in 2**(bits + 6) for each wanted value, so with very many wanted values
    it keeps most rows, and loses none.
    """
    return _marked(df, value, wanted, bits, "left_semi")


def not_among(df: DataFrame, value: Column, wanted: DataFrame, bits: int = 18) -> DataFrame:
    """The other rows: those whose ``value`` surely is not in ``wanted``."""
    return _marked(df, value, wanted, bits, "left_anti")
