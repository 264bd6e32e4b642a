"""Redirect chains of fetched URLs, followed by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.session import reliable_checkpoint


def redirect_chains(fetches: DataFrame, rounds: int = 40) -> DataFrame:
    """Where each fetched URL ends: (url, final_url, final_status, hops, chain, outcome).

    ``fetches`` has (url, status, location); a row with a location redirects, and of several rows of a URL the greatest (status,
    location) counts. Rows without a URL are left out. ``outcome`` is ok (the last status is 2xx), error (another status), broken (the
    last URL was never fetched) or loop. A loop has no end: its ``final_url``, ``hops`` and ``chain`` are null, for the URLs that
    lead into it as well. ``chain`` lists the URLs passed, without the first.

    Only redirecting URLs are iterated over. In a round each of them jumps to where its target points by then, so a chain
    of n hops takes log2(n) rounds, each one join on the target. While any open URL has an end, some of them reach it in a round; when none does,
    what is left are loops. Chains longer than 2**``rounds`` are an error.
    """
    seen = fetches.where("url IS NOT NULL").groupBy("url").agg(F.max(F.struct("status", "location")).alias("r")).select("url", "r.status", "r.location")
    seen = reliable_checkpoint(seen)
    moved = seen.where("location IS NOT NULL").select("url", F.col("location").alias("next"))
    redirecting = moved.select(F.col("url").alias("u"), F.lit(True).alias("goes_on"))
    jumps = moved.join(redirecting, F.col("next") == F.col("u"), "left").select(
        "url", "next", F.lit(1).alias("hops"), F.array("next").alias("chain"), F.col("goes_on").isNotNull().alias("open"))
    jumps = reliable_checkpoint(jumps)
    left = jumps.where("open").count()
    for _ in range(rounds):
        if not left:
            break
        target = jumps.select(F.col("url").alias("t"), F.col("next").alias("next2"), F.col("hops").alias("hops2"), F.col("chain").alias("chain2"), F.col("open").alias("open2"))
        on = jumps.where("open").join(target, F.col("next") == F.col("t")).select(
            "url", F.col("next2").alias("next"), (F.col("hops") + F.col("hops2")).alias("hops"),
            F.concat("chain", "chain2").alias("chain"), F.col("open2").alias("open"))
        jumps = reliable_checkpoint(jumps.where("NOT open").unionByName(on))
        now = jumps.where("open").count()
        if now == left:
            break
        left = now
    else:
        raise RuntimeError("redirect chains did not end")
    ends = jumps.select(F.col("url").alias("u"), "next", "hops", "chain", "open")
    status = seen.select(F.col("url").alias("final_url"), F.col("status").alias("final_status"), F.lit(True).alias("fetched"))
    placed = seen.select("url").join(ends, F.col("url") == F.col("u"), "left").select(
        "url", F.when(F.coalesce("open", F.lit(False)), None).otherwise(F.coalesce("next", "url")).alias("final_url"),
        F.when(F.coalesce("open", F.lit(False)), None).otherwise(F.coalesce("hops", F.lit(0))).alias("hops"),
        F.when(F.coalesce("open", F.lit(False)), None).otherwise(F.coalesce("chain", F.array().cast("array<string>"))).alias("chain"))
    outcome = (
        F.when(F.col("final_url").isNull(), "loop").when(F.col("fetched").isNull(), "broken")
        .when(F.col("final_status").between(200, 299), "ok").otherwise("error")
    )
    return placed.join(status, "final_url", "left").select("url", "final_url", "final_status", "hops", "chain", outcome.alias("outcome"))
