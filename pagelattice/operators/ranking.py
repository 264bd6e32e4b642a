"""Row numbers within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.session import reliable_checkpoint


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """``df`` with each row's number, from 1, in its group of ``keys`` by ``order``.

    Rows are dealt into ranges of (keys, order), so a group with a large share of all rows lies in many of them. They are numbered
    within their range only, and the sizes of a group's ranges, at most one row for each range, are summed ahead. The dealt rows are
    written to the checkpoint folder, since a range must not change between the two readings. Null keys form a group; rows equal in
    all of ``order`` come in any order.
    """
    at, before = f"{name}_range", f"{name}_before"
    dealt = reliable_checkpoint(df.repartitionByRange(*keys, *order).withColumn(at, F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, at).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"{name}_of_{c}" for c in [*keys, at]}
    sizes = sizes.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(*keys, at).orderBy(*order)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    rows = dealt.withColumn(name, F.row_number().over(inside)).join(sizes, same)
    return rows.withColumn(name, F.col(name) + F.col(before)).drop(at, before, *names.values())


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int | None, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group with their number, limited ahead of the shuffle; None numbers all rows."""
    if n is None:
        return numbered(df, keys, order, name)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
