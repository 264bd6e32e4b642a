"""Mixing sources to target weights by Pfair windows and earliest deadline first. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.llm.tables import pick, rows_per, settled


def whole_parts(weights: DataFrame, parts: int = 1000) -> DataFrame:
    """(source, m): weights rounded down to shares of ``parts``, at least 1 each.

    Their sum is the length of a round. Null, negative and zero weights count as the least share; a repeated source
    has its weights added up.
    """
    w = pick(weights, "source", "weight").groupBy("source").agg(F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"))
    total = w.agg(F.sum("weight")).first()[0] or 1.0
    return w.select("source", F.greatest(F.floor(F.col("weight") * parts / F.lit(total)), F.lit(1)).cast("long").alias("m"))


def round_slots(parts: DataFrame) -> DataFrame:
    """(source, j, slot): which block of a source each slot of a round gets.

    Block j of a source with m of M parts may start at floor(j M / m) and must be over by ceil((j + 1) M / m). Each slot takes the
    started block with the earliest deadline, ties to the source first in order. One processor, weights that sum to 1: every block
    meets its window, so at any time a source is less than one block off its target. The round repeats for
    ever, and its length is bounded by the parameter ``parts`` and the number of weights, not by the data.
    """
    listed = parts.agg(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col("source"), F.lit("")).alias("o"), "source", "m"))).alias("s"), F.sum("m").alias("total"))
    done = F.transform("s", lambda x: F.struct(x["m"].alias("m"), F.lit(0).cast("long").alias("j")))
    start = F.struct(done.alias("q"), F.array().cast("array<struct<i:int,j:bigint>>").alias("taken"))

    def step(state, t):
        total = F.col("total")
        keyed = F.transform(state["q"], lambda x, i: F.when(F.floor(x["j"] * total / x["m"]) <= t, F.struct(F.ceil((x["j"] + 1) * total / x["m"]).alias("d"), i.alias("i"), x["j"].alias("j"))))
        best = F.array_min(F.filter(keyed, lambda x: x.isNotNull()))
        q = F.transform(state["q"], lambda x, i: F.struct(x["m"].alias("m"), F.when(i == best["i"], x["j"] + 1).otherwise(x["j"]).alias("j")))
        return F.struct(q.alias("q"), F.concat(state["taken"], F.array(F.struct(best["i"].alias("i"), best["j"].alias("j")))).alias("taken"))

    ran = listed.where("total > 0").select("s", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), start, step).alias("r"))
    slots = ran.select("s", F.posexplode(F.col("r")["taken"]).alias("slot", "x"))
    return slots.select(F.element_at("s", F.col("x")["i"] + 1)["source"].alias("source"), F.col("x")["j"].alias("j"), F.col("slot").cast("long").alias("slot"))


def mixed(docs: DataFrame, weights: DataFrame, block_rows: int = 16, parts: int = 1000, bucket_rows: int = 4000) -> DataFrame:
    """(doc_id, source, block, slot, in_mix) for every document.

    A source's documents, in the order of a hash of their id, form blocks of ``block_rows``; block k goes to the slot that its source's
    Pfair schedule gives it. ``in_mix`` holds up to the first slot whose source has run out: until then
    the mixture is less than a block off its targets. Later rows keep their slots, so reading on by slot goes on mixing
    what is left; nothing is dropped or repeated. A source without a weight gets the least share; a null source is a source of
    its own, null ids come last in it, repeated rows are kept, and an empty table gives no rows.

    Ranks come in two levels: (source, hash bucket) counts are summed ahead, and rows are numbered within their bucket only, so a
    source with a third of all rows is spread over its buckets.
    """
    d = pick(docs, "doc_id", "source")
    buckets = rows_per(d.count(), bucket_rows)
    d = d.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)))
    sizes = settled(d.groupBy("source", "bucket").agg(F.count("*").alias("n")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    ranked = d.withColumn("r", F.row_number().over(inside) - 1)
    o = offsets.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "offset")
    ranked = ranked.join(o, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    ranked = ranked.select("doc_id", "source", F.floor((F.col("offset") + F.col("r")) / block_rows).alias("block"))

    totals = sizes.groupBy("source").agg(F.ceil(F.sum("n") / block_rows).cast("long").alias("blocks"))
    given = pick(weights, "source", "weight").unionByName(totals.select("source", F.lit(0.0).alias("weight")))
    shares = settled(whole_parts(given, parts))
    plan = settled(round_slots(shares))
    length = F.lit(shares.agg(F.sum("m")).first()[0] or 0)
    m = shares.select(F.col("source").alias("s3"), "m")
    # The first slot of each source that it has no block left for; the least of them ends the mixture.
    p = plan.select(F.col("source").alias("s4"), "j", "slot")
    ends = totals.join(m, F.col("source").eqNullSafe(F.col("s3"))).join(p, F.col("s3").eqNullSafe(F.col("s4")) & (F.col("blocks") % F.col("m") == F.col("j")))
    end = F.lit(ends.agg(F.min(F.floor(F.col("blocks") / F.col("m")) * length + F.col("slot"))).first()[0])

    out = ranked.join(m, F.col("source").eqNullSafe(F.col("s3")))
    out = out.join(p, F.col("s3").eqNullSafe(F.col("s4")) & (F.col("block") % F.col("m") == F.col("j")))
    slot = (F.floor(F.col("block") / F.col("m")) * length + F.col("slot")).cast("long")
    return out.select("doc_id", "source", F.col("block").cast("long").alias("block"), slot.alias("slot"), (slot < end).alias("in_mix"))


def tempered_weights(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """(source, weight): each source's share of all rows raised to ``power``, so large sources are toned down."""
    return pick(docs, "source").groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))
