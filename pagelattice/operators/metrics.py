"""Source reliability and platform metrics per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import reliability as R
from pagelattice.functions import urls as U
from pagelattice.functions.core import clip, txt
from pagelattice.functions.text import needs_text_repair, normalize_text
from pagelattice.operators.ranking import first_rows


def score_sources(df: DataFrame, url: str = "url", title: str | None = "title", file_type: str | None = None, hints: str | None = None) -> DataFrame:
    """Adds source_class, reliability_score and rationale."""
    df = df.withColumn("source_class", R.source_class(url, title, file_type, hints))
    return df.withColumn("reliability_score", R.class_weight("source_class")).withColumn("rationale", R.class_rationale("source_class"))


def apply_overrides(scored: DataFrame, overrides: DataFrame) -> DataFrame:
    """Reliability with the weights of ``overrides`` (source_class, weight) in place."""
    df = scored.join(overrides.select("source_class", "weight"), "source_class", "left")
    return df.withColumn("overridden", F.col("weight").isNotNull()).withColumn(
        "reliability_score", F.coalesce("weight", "reliability_score")
    ).drop("weight")


def reliability_by_class(scored: DataFrame) -> DataFrame:
    return scored.groupBy("project_slug", "source_class").agg(F.count("*").alias("n"))


def average_reliability(scored: DataFrame) -> DataFrame:
    return scored.groupBy("project_slug").agg(F.count("*").alias("pages"), F.avg("reliability_score").alias("average"))


def recommendation_confidence(store: dict) -> DataFrame:
    """Mean of confidence weight times reliability over a recommendation's evidence."""
    recs = store["entities"].filter("epistemic_class = 'recommendation'").select(F.col("id").alias("entity_id"), "name")
    links = store["entity_links"].filter("kind = 'evidence'").join(recs, "entity_id", "left_semi").select("entity_id", F.col("value").alias("id"))
    weight = R.confidence_weight("confidence") * F.coalesce("reliability_score", F.lit(0.55))
    support = links.join(store["evidence"].select("id", weight.alias("w")), "id").groupBy("entity_id").agg(
        F.count("*").alias("supports"), F.avg("w").alias("mean")
    )
    df = recs.join(support, "entity_id", "left")
    mean = F.coalesce("mean", F.lit(0.0))
    return df.select(
        "entity_id", "name", F.coalesce("supports", F.lit(0)).alias("supports"), R.rounded_support(F.round(mean, 12)).alias("score"),
        R.support_label(F.round(mean, 12)).alias("label"),
        F.when(F.col("mean").isNull(), "no_supporting_evidence").otherwise("avg(confidenceWeight * reliabilityScore)").alias("method"),
    )


def unsupported_recommendations(store: dict) -> DataFrame:
    backed = store["entity_links"].filter("kind = 'evidence'").select(F.col("entity_id").alias("id")).distinct()
    return store["entities"].filter("epistemic_class = 'recommendation'").join(backed, "id", "left_anti").select("id", "name")


def recommendation_coverage(store: dict, minimum: float = 0.8) -> DataFrame:
    """Share of a project's recommendations that carry evidence; passes at 0.8."""
    recs = store["entities"].filter("epistemic_class = 'recommendation'").select(F.col("id").alias("entity_id"))
    mine = store["entity_links"].join(recs, "entity_id", "left_semi")
    projects = mine.filter("kind = 'project'").select("entity_id", F.col("value").alias("project"))
    backed = mine.filter("kind = 'evidence'").select("entity_id").distinct().withColumn("ok", F.lit(1))
    df = projects.join(backed, "entity_id", "left").groupBy("project").agg(
        F.count("*").alias("recommendations"), F.count("ok").alias("with_evidence")
    )
    return df.withColumn("coverage", F.col("with_evidence") / F.col("recommendations")).withColumn("passed", F.col("coverage") >= minimum)


def text_quality_counts(records: DataFrame, text: str = "main_text_summary") -> DataFrame:
    """Pages per project whose text is fine, failed or salvaged."""
    df = normalize_text(records.select("project_slug", text), text, "tq")
    return df.groupBy("project_slug").agg(
        F.count("*").alias("pages"), F.count_if("tq.ok").alias("ok"), F.count_if(~F.col("tq.ok")).alias("failed"),
        F.count_if(F.array_contains("tq.issues", "salvaged_readable_text")).alias("salvaged"),
    )


def extraction_health(records: DataFrame, minimum: float = 0.65) -> DataFrame:
    """Good and bad page texts per project, whether the home page reads, and the gate."""
    df = needs_text_repair(records.select("project_slug", "seq", "url", "main_text_summary"), "main_text_summary", "bad")
    df = normalize_text(df, "main_text_summary", "tq")
    root = F.coalesce(U.url_path("url") == "/", F.lit(False))
    agg = df.groupBy("project_slug").agg(
        F.count("*").alias("total"), F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"),
        F.min_by(F.when(root, F.col("tq.ok")), F.when(root, F.col("seq"))).alias("home"),
    )
    return agg.select(
        "project_slug", "total", "good", "bad", F.coalesce("home", F.col("good") > 0).alias("homepage_ok"),
        (F.col("good") / F.col("total") >= minimum).alias("passed"),
    )


def repair_records(records: DataFrame, fresh: DataFrame, force_all: bool = False) -> DataFrame:
    """Records with failed text replaced by a fresh extraction of the same URL."""
    flagged = needs_text_repair(records, "main_text_summary", "_needs")
    want = F.lit(True) if force_all else F.col("_needs")
    payload = [c for c in records.columns if c not in ("project_slug", "url", "seq")]
    new = fresh.groupBy("project_slug", "url").agg(F.max_by(F.struct(*payload), F.col("seq")).alias("_new"))
    df = flagged.join(new, ["project_slug", "url"], "left")
    use = want & F.col("_new").isNotNull()
    return df.select(
        "project_slug", "url", "seq",
        *[F.when(use, F.coalesce(F.col(f"_new.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in payload],
        use.alias("repaired"),
    )


def crawl_quality(health: DataFrame, text: DataFrame) -> DataFrame:
    """0.55 success rate + 0.35 readable text + 0.1 failure-free share, within [0, 1]."""
    df = health.join(text.select("project_slug", "pages", "ok"), "project_slug", "full")
    tried = F.greatest(F.lit(1), F.col("pages_attempted"))
    has = F.col("pages_attempted").isNotNull()
    success = F.when(has, F.col("pages_succeeded") / tried).when(F.col("pages") > 0, 1.0).otherwise(0.5)
    readable = F.when(F.col("pages") > 0, F.col("ok") / F.col("pages")).otherwise(0.4)
    clean = F.when(has, F.greatest(F.lit(0.0), 1 - F.col("permanent_failures") / tried) * 0.1).otherwise(0.1)
    return df.select("project_slug", clip(success * 0.55 + readable * 0.35 + clean, 0.0, 1.0).alias("crawl_quality"))


def knowledge_quality(critical: Column, high: Column, medium: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - critical * 0.2 - high * 0.1 - medium * 0.02)


def evidence_completeness(facts: Column, unsupported: Column) -> Column:
    return F.when(facts == 0, 0.0).otherwise(1 - unsupported * 0.1)


def overall_confidence(crawl: Column, knowledge: Column, summary_ok: Column, reliability: Column, completeness: Column) -> Column:
    summary = F.when(summary_ok, 0.15).otherwise(0.05)
    return crawl * 0.25 + knowledge * 0.3 + summary + reliability * 0.15 + completeness * 0.15


def lowest_confidence(evidence: DataFrame, n: int | None = None) -> DataFrame:
    """The low-confidence findings per project in order: all, or the first ``n``."""
    df = first_rows(evidence.filter("confidence = 'low'").select("source_project", "seq", "id", "reliability_score", "excerpt"), ["source_project"], ["seq", "id"], n)
    return df.select(F.col("source_project").alias("project"), F.col("rn").cast("int").alias("rn"), "id", "reliability_score", txt("excerpt").alias("excerpt"))


def knowledge_metrics(store: dict, ascii_only: bool = False) -> DataFrame:
    """Graph metrics per project: sizes, density, confidence, reliability, duplicates."""
    from pagelattice.functions.keys import normalize_key

    c = F.col
    member = store["entity_links"].filter("kind = 'project'").select("entity_id", c("value").alias("project"))
    backed = store["entity_links"].filter("kind = 'evidence'").select("entity_id").distinct().withColumn("backed", F.lit(True))
    e = store["entities"].select(
        c("id").alias("entity_id"), "type", "epistemic_class", normalize_key("name", ascii_only).alias("nk")
    )
    base = member.join(e, "entity_id").join(backed, "entity_id", "left")
    fact = c("epistemic_class") == "fact"
    # Two levels: (project, type, name) groups first, so distinct counts stay partial.
    per_name = base.groupBy("project", "type", "nk").agg(
        F.count("*").alias("ids"), F.count_if(fact).alias("facts"), F.count_if(fact & c("backed").isNotNull()).alias("backed_facts")
    )
    per_type = per_name.groupBy("project", "type").agg(
        F.sum("ids").alias("ids"), F.sum("facts").alias("facts"), F.sum("backed_facts").alias("backed_facts"), F.count_if(c("ids") >= 2).alias("dups")
    )
    ents = per_type.groupBy("project").agg(
        F.count("*").alias("types"), F.sum("ids").alias("entities"), F.sum("facts").alias("facts"),
        F.sum("backed_facts").alias("backed_facts"), F.sum("dups").alias("dups"),
    )
    rels = store["relationship_links"].filter("kind = 'project'").groupBy(c("value").alias("project")).agg(F.count("*").alias("relationships"))
    ev = store["evidence"].groupBy(c("source_project").alias("project")).agg(
        F.count("*").alias("evidence"), F.avg(R.confidence_weight("confidence")).alias("average_confidence"),
        F.avg("reliability_score").alias("average_reliability"),
    )
    df = ents.join(rels, "project", "left").join(ev, "project", "left")
    n = F.greatest(F.lit(1), c("entities"))
    return df.select(
        "project", "types", "entities", F.coalesce("relationships", F.lit(0)).alias("relationships"), F.coalesce("evidence", F.lit(0)).alias("evidence"),
        F.when(c("facts") > 0, c("backed_facts") / c("facts")).otherwise(1.0).alias("evidence_completeness"),
        (F.coalesce("relationships", F.lit(0)) / n).alias("density"),
        F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"), F.coalesce("average_reliability", F.lit(0.0)).alias("average_reliability"),
        (c("dups") / n).alias("duplicate_rate"),
    )


def crawl_metrics(health: DataFrame, text: DataFrame) -> DataFrame:
    """Readable-text, canonicalization and broken-source rates per project."""
    tried = F.greatest(F.lit(1), F.col("pages_attempted"))
    df = health.join(text.select("project_slug", "pages", "ok"), "project_slug", "left")
    return df.select(
        "project_slug", F.when(F.col("pages") > 0, F.col("ok") / F.col("pages")).otherwise(0.4).alias("normalization_quality"),
        (F.col("pages_succeeded") / tried).alias("canonicalization_success"), (F.col("permanent_failures") / tried).alias("broken_source_rate"),
    )


def platform_metrics(crawl: DataFrame, knowledge: DataFrame, issue_counts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Overall confidence per project.

    ``crawl``: project_slug, crawl_quality. ``knowledge``: `knowledge_metrics` plus
    facts. ``issue_counts``: project, critical, high, medium, unsupported, facts.
    ``profiles``: project_slug, summary_ok.
    """
    c = F.col
    df = (
        issue_counts.join(knowledge.select("project", "average_reliability"), "project", "left")
        .join(crawl.withColumnRenamed("project_slug", "project"), "project", "left")
        .join(profiles.select(c("project_slug").alias("project"), "summary_ok"), "project", "left")
    )
    kq = knowledge_quality(c("critical"), c("high"), c("medium"))
    comp = evidence_completeness(c("facts"), c("unsupported"))
    return df.select(
        "project", F.coalesce("crawl_quality", F.lit(0.5)).alias("crawl_quality"), kq.alias("knowledge_quality"), comp.alias("evidence_completeness"),
        overall_confidence(F.coalesce("crawl_quality", F.lit(0.5)), kq, F.coalesce("summary_ok", F.lit(False)), F.coalesce("average_reliability", F.lit(0.0)), comp).alias("overall_confidence"),
    )
