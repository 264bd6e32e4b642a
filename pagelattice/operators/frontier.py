"""Crawl frontier over URL and link tables: gate, next frontier, sitemaps, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import urls as U
from pagelattice.functions.core import strings
from pagelattice.operators.ranking import first_rows
from pagelattice.session import reliable_checkpoint


def robots_table(robots: DataFrame) -> DataFrame:
    """project_slug, text -> project_slug, disallow, sitemaps."""
    return robots.select("project_slug", U.robots_rules("text").alias("r")).select("project_slug", "r.*")


def _with_rules(df: DataFrame, projects: DataFrame, rules: DataFrame | None) -> DataFrame:
    p = projects.select(F.col("slug").alias("project_slug"), "approved_hosts", "max_crawl_pages")
    if rules is None:
        p = p.withColumn("disallow", strings([]))
    else:
        p = p.join(rules.select("project_slug", "disallow"), "project_slug", "left")
    return df.join(p, "project_slug")


def _static_verdict(canon: Column) -> Column:
    return (
        F.when(canon.isNull(), "invalid")
        .when(~U.host_allowed(canon, "approved_hosts"), "host")
        .when(U.should_skip_path(canon), "skip_path")
        .when(U.is_document_href(canon), "document")
        .when(~U.robots_allowed(canon, "disallow"), "robots")
        .otherwise("admit")
    )


def frontier_gate(
    candidates: DataFrame, projects: DataFrame, rules: DataFrame | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """Verdict per candidate (project_slug, seq, url).

    Only admitted URLs count as seen, so a repeated URL is a duplicate exactly when
    its first occurrence was admitted. First occurrences are found by a partial
    aggregate and matched back on the unique (url, seq), which spreads a hot URL.
    """
    df = _with_rules(candidates, projects, rules)
    df = df.withColumn("canon", U.normalize_url("url", U.preferred_host("approved_hosts")))
    df = df.withColumn("static", _static_verdict(F.col("canon"))).select(
        "project_slug", "seq", "url", "canon", "static"
    )
    admitted = df.filter("static = 'admit'")
    if seen is not None:
        known = seen.select("project_slug", F.col("url").alias("canon")).distinct()
        admitted = admitted.join(known, ["project_slug", "canon"], "left_anti")
    first = admitted.groupBy("project_slug", "canon").agg(F.min("seq").alias("seq")).withColumn("first", F.lit(True))
    df = df.join(first, ["project_slug", "canon", "seq"], "left")
    verdict = F.when((F.col("static") == "admit") & F.col("first").isNull(), "duplicate").otherwise(F.col("static"))
    return df.select("project_slug", "seq", "url", "canon", verdict.alias("verdict"))


def next_frontier(
    links: DataFrame, seen: DataFrame, projects: DataFrame, rules: DataFrame | None = None, capped: bool = True, most: int | None = None
) -> DataFrame:
    """Unseen admissible link targets, first come first served up to each project's own page budget.

    A project without ``max_crawl_pages`` has no budget; ``most`` bounds every budget.

    ``links``: project_slug, seq, href (already internal); ``seen``: project_slug, url.
    """
    df = _with_rules(links, projects, rules)
    df = df.withColumn("url", U.normalize_url("href", U.preferred_host("approved_hosts")))
    ok = (
        U.host_allowed("url", "approved_hosts")
        & ~U.should_skip_path("url")
        & U.robots_allowed("url", "disallow")
    )
    fresh = (
        df.filter(F.col("url").isNotNull() & ok)
        .groupBy("project_slug", "url")
        .agg(F.min("seq").alias("seq"), F.first("max_crawl_pages").alias("max_crawl_pages"))
        .join(seen.select("project_slug", "url").distinct(), ["project_slug", "url"], "left_anti")
    )
    if not capped:
        return fresh.select("project_slug", "url", "seq")
    used = seen.select("project_slug", "url").distinct().groupBy("project_slug").agg(F.count("*").alias("used"))
    ranked = first_rows(fresh, ["project_slug"], ["seq", "url"], most)
    budget = F.col("max_crawl_pages") - F.coalesce(F.col("used"), F.lit(0))
    within = F.col("max_crawl_pages").isNull() | (F.col("rn") <= budget)
    return ranked.join(used, "project_slug", "left").filter(within).select("project_slug", "url", "seq")


def link_reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Fewest hops to every URL within ``hops`` of a seed.

    ``edges``: project_slug, from_url, to_url; ``seeds``: project_slug, url. Every
    round writes only the URLs it found to the checkpoint folder, so a lost executor costs one round.
    """
    edges = reliable_checkpoint(edges.select("project_slug", "from_url", "to_url").distinct())
    front = seeds.select("project_slug", "url").distinct().withColumn("hops", F.lit(0))
    rounds = [front]
    for hop in range(1, hops + 1):
        reached = reduce(DataFrame.unionByName, rounds).select("project_slug", "url")
        found = (
            edges.join(front.select("project_slug", F.col("url").alias("from_url")), ["project_slug", "from_url"])
            .select("project_slug", F.col("to_url").alias("url"))
            .distinct()
            .join(reached, ["project_slug", "url"], "left_anti")
        )
        front = reliable_checkpoint(found.withColumn("hops", F.lit(hop)))
        rounds.append(front)
    return reduce(DataFrame.unionByName, rounds)


def sitemap_urls(sitemaps: DataFrame, seeds: DataFrame) -> DataFrame:
    """URLs listed by the seed sitemaps, one level of sitemap index followed.

    ``sitemaps``: url, xml; ``seeds``: project_slug, sitemap_url.
    """
    locs = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>([^<]+)</loc>"), F.lit(1))
    files = sitemaps.select(F.col("url").alias("sitemap_url"), F.explode(locs).alias("loc"))
    level1 = seeds.select("project_slug", "sitemap_url").join(files, "sitemap_url").select("project_slug", "loc")
    is_index = F.col("loc").contains("sitemap") & F.col("loc").endswith(".xml")
    nested = (
        level1.filter(is_index)
        .select("project_slug", F.col("loc").alias("sitemap_url"))
        .join(files, "sitemap_url")
        .select("project_slug", "loc")
    )
    return level1.filter(~is_index).unionByName(nested).withColumnRenamed("loc", "url")


def sitemap_seeds(sitemaps: DataFrame, seeds: DataFrame, projects: DataFrame) -> DataFrame:
    """Distinct canonical, allowed, unskipped sitemap URLs."""
    df = _with_rules(sitemap_urls(sitemaps, seeds), projects, None)
    df = df.withColumn("canon", U.normalize_url("url", U.preferred_host("approved_hosts")))
    ok = U.host_allowed("canon", "approved_hosts") & ~U.should_skip_path("canon")
    return df.filter(F.col("canon").isNotNull() & ok).select("project_slug", F.col("canon").alias("url")).distinct()


def fetch_outcomes(fetch_log: DataFrame) -> DataFrame:
    """Retry and failure counters per project of fetch_log(project_slug, url, attempts, ok, error)."""
    kind = U.classify_fetch_error("error")["kind"]
    failed = ~F.col("ok")
    return fetch_log.groupBy("project_slug").agg(
        F.count("*").alias("pages_attempted"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"),
        F.count_if((F.col("attempts") > 1) & F.col("ok")).alias("retry_successes"),
        F.count_if(failed).alias("permanent_failures"),
        F.count_if(failed & (kind == "download")).alias("download_blocked"),
        F.count_if(failed & (kind == "rate_limit")).alias("rate_limited"),
        F.count_if(failed & (kind == "timeout")).alias("timeouts"),
    )


def failure_samples(fetch_log: DataFrame, n: int | None = None) -> DataFrame:
    """The failures per project in order: all, or the first ``n``."""
    df = first_rows(fetch_log.filter(~F.col("ok")).select("project_slug", "seq", "url", "error"), ["project_slug"], ["seq", "url"], n)
    kind = U.classify_fetch_error("error")["kind"]
    return df.select("project_slug", F.col("rn").cast("int").alias("rn"), "url", F.coalesce("error", F.lit("unknown")).alias("error"), kind.alias("kind"))


def crawl_health(verdicts: DataFrame, fetch_log: DataFrame, records: DataFrame) -> DataFrame:
    """One row of crawl counters per project."""
    gate = verdicts.groupBy("project_slug").agg(
        F.count_if(F.col("verdict") == "robots").alias("robots_skipped"),
        F.count_if(F.col("verdict") == "document").alias("document_links_skipped"),
        F.count_if(F.col("verdict") == "duplicate").alias("queue_duplicates_skipped"),
        F.count_if(F.col("verdict").isin("skip_path", "robots")).alias("skipped_urls"),
    )
    # One row per canonical URL first, so a distinct count needs no extra shuffle stage.
    per_url = records.groupBy("project_slug", "url").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("text_log.ok")).alias("bad"),
        F.count_if(F.col("text_log.ok") & F.array_contains("text_log.issues", "salvaged_readable_text")).alias("salvaged"),
    )
    pages = per_url.groupBy("project_slug").agg(
        F.count("*").alias("pages_succeeded"),
        F.sum(F.col("n") - 1).alias("duplicates_collapsed"),
        F.sum("bad").alias("encoding_failures"),
        F.sum("salvaged").alias("encoding_salvages"),
    )
    out = fetch_outcomes(fetch_log).join(gate, "project_slug", "full").join(pages, "project_slug", "full")
    return out.fillna(0)
