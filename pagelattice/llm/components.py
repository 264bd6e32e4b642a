"""Distributed union-find: connected components of a table of links. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.tables import settled


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them. Links point from the larger to the smaller node."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): every linked id with the smallest id it reaches. ``links`` has (a, b) of type bigint.

    Alternating large-star and small-star steps, each two partial aggregates and joins over the links; a hub is
    only ever aggregated partially or joined, never gathered. Each round is written to the shared folder. Loops, repeated links
    and nulls do not matter; no links give no rows. Convergence takes about log(longest path) rounds; more than
    ``rounds`` is an error, never a partial answer.
    """
    e = settled(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _print(e)
    if seen[0] == 0:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(rounds):
        e = settled(_small_star(_large_star(e)))
        now = _print(e)
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError("components did not converge")
