"""The nodes of a chosen-path similarity join as tables. DataFrame operations only.

Rows are (key, id, n, comp, path): a member of a node, its set size, its component so far and its minhashes. Rows that branch also
have ``used``, a bit for each coordinate that their path has used, so there are at most 64 coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.components import components
from pagelattice.llm.tables import maybe_among, settled


def shared(rows: DataFrame) -> DataFrame:
    """Of (key, id), the rows whose key occurs more than once.

    Most such keys occur twice, and then their least and greatest id are the rows; only for the others the rows are gone over again.
    """
    often = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("c > 1")
    often = settled(often)
    two = often.where("c = 2").select("key", F.explode(F.array("lo", "hi")).alias("id"))
    keys = often.where("c > 2").select(F.col("key").alias("k"))
    more = maybe_among(rows, F.col("key"), keys).select("key", "id").join(keys, F.col("key") == F.col("k"), "left_semi")
    return two.unionByName(more)


def nodes(rows: DataFrame) -> DataFrame:
    """Members of the nodes that hold two components or more, with the node's first member, main component and minority size.

    All from partial aggregates and joins on the node key, so one huge node is spread over its rows.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min(F.struct("id", "n", "path")).alias("f"))
    keys = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("most"), F.min("f").alias("f")).where("comps > 1")
    keys = keys.select(F.col("key").alias("k"), "f", (F.col("size") - F.col("most.c")).alias("minority"), F.col("most.comp").alias("main"))
    return rows.join(keys, F.col("key") == F.col("k")).drop("k")


def pairs(members: DataFrame, minority: int, alike: Column) -> DataFrame:
    """Candidate pairs (a, b): every member with its node's first one, and the minority of a settled node with all its members.

    ``alike`` tells from (n, path, n2, path2) whether a pair may be similar.
    """
    first = [F.col(f"f.{c}").alias(f"{c}2") for c in ("id", "n", "path")]
    stars = members.where(F.col("id") != F.col("f.id")).select("id", "n", "path", *first).where(alike)
    few = members.where(F.col("minority") <= minority)
    odd = few.where("comp != main").select(F.col("key").alias("k2"), F.col("comp").alias("comp2"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("path").alias("path2"))
    near = few.join(odd, F.col("key") == F.col("k2")).where(F.col("comp") != F.col("comp2")).where(alike)
    both = stars.select("id", "id2").unionByName(near.select("id", "id2"))
    return both.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def picks(coordinates: int, branches: int) -> Column:
    """The coordinates (from 0) that a node (key, used) branches by: the first unused ones in an order of its own, so nodes differ in them as trees do."""
    unused = F.filter(F.sequence(F.lit(0), F.lit(coordinates - 1)), lambda i: F.getbit("used", i) == 0)
    ordered = F.array_sort(F.transform(unused, lambda i: F.struct(F.xxhash64("key", i).alias("h"), i.alias("i"))))
    return F.transform(F.slice(ordered, 1, branches), lambda x: x["i"])


def children(members: DataFrame, *keep: str) -> DataFrame:
    """The next level of nodes: each member goes to a child for each coordinate of its node's ``picks``."""
    picked = members.select("key", "id", "n", "comp", "path", "used", *keep, F.explode("picks").alias("pick"))
    value = F.get("path", F.col("pick"))
    used = F.col("used").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pick")))
    return picked.where(value.isNotNull()).select(F.xxhash64("key", "pick", value).alias("key"), "id", "n", "comp", "path", used.alias("used"), *keep)


def joined(members: DataFrame) -> DataFrame:
    """(key, id, n, comp): nodes that have half of their members in common as one, so what meets in many trees is compared once."""
    mine = members.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    both = mine.select(F.get("keys", F.lit(0)).alias("a"), F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("common"))
    sizes = members.groupBy("key").agg(F.count("*").alias("rows"))
    of = lambda c: sizes.select(F.col("key").alias(f"k{c}"), F.col("rows").alias(f"rows_{c}"))
    both = both.join(of("a"), F.col("a") == F.col("ka")).join(of("b"), F.col("b") == F.col("kb"))
    whole = components(both.where(F.col("common") * 2 >= F.least("rows_a", "rows_b")).select("a", "b")).select(F.col("id").alias("k"), "component")
    return members.join(whole, F.col("key") == F.col("k"), "left").select(F.coalesce("component", "key").alias("key"), "id", "n", "comp").distinct()


def block_pairs(members: DataFrame, node_rows: int, node_total: int) -> DataFrame:
    """Nodes of any size as bounded nodes: members are dealt into blocks, and each two blocks of a node make a node.

    The main component has blocks of its own, which only meet those of the minority: what is linked already needs no comparison.
    """
    half = node_rows // 2
    main = members.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("main")).select(F.col("key").alias("k"), "main")
    dealt = settled(members.join(main, F.col("key") == F.col("k")).select("key", "id", "n", (F.col("comp") == F.col("main")).alias("is_main")))
    blocks = F.greatest(F.ceil(F.count("*") / half), F.ceil(2 * F.sum("n") / node_total))
    sizes = dealt.groupBy("key", "is_main").agg(blocks.alias("blocks")).groupBy("key")
    sizes = sizes.agg(F.max(F.when(F.col("is_main"), F.col("blocks"))).alias("mains"), F.max(F.when(~F.col("is_main"), F.col("blocks"))).alias("minors")).select(F.col("key").alias("k"), "mains", "minors")
    block = F.when(F.col("is_main"), F.col("minors") + F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("minors")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") + F.when(F.col("is_main"), 0).otherwise(F.col("mains")) - 1)).alias("other")
    dealt = dealt.join(sizes, F.col("key") == F.col("k")).where("minors > 0").select("key", "id", block.alias("block"), other).where("block != other")
    return dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "id")
