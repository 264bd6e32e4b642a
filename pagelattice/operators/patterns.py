"""Candidate patterns over projects, inverted index, human pattern decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.keys import candidate_pattern_id, entity_id, normalize_key
from pagelattice.session import settled

# Labels a pattern carries.
LABEL = "Candidate pattern — unapproved. Not an industry standard, best practice, or verified conclusion."
BLOCKED_LABEL = LABEL + " BLOCKED by conflicts — needs human review."
_RANK = {"high": 0, "medium": 1, "low": 2}


def severity(confidence: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in _RANK.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def worst_label(rank: Column) -> Column:
    return F.when(rank == 2, "low").when(rank == 1, "medium").otherwise("high")


def companies_by_project(entities: DataFrame, links: DataFrame) -> DataFrame:
    company = entities.filter("type = 'Company'").select(F.col("id").alias("entity_id"))
    return (
        links.filter("kind = 'project'").join(company, "entity_id", "left_semi")
        .select(F.col("value").alias("project"), F.col("entity_id").alias("company_id")).distinct()
    )


def observation_members(store: dict[str, DataFrame]) -> DataFrame:
    """entity_id, key, name, seq of observations that carry an observation key."""
    keys = store["entity_props"].filter("prop = 'observationKey'").select("entity_id", F.col("value").alias("key"))
    obs = store["entities"].filter("epistemic_class = 'observation'").select(F.col("id").alias("entity_id"), "name", "seq")
    return obs.join(keys, "entity_id")


def candidate_patterns(store: dict[str, DataFrame], previous: DataFrame | None = None) -> DataFrame:
    """One row per observation key seen in at least two projects and two companies.

    Members are joined to their observations once and reduced to distinct (key, kind, value) rows, which spreads a key that holds a
    large share of all observations over the cluster; one aggregate by key then counts every kind. Observations, their members and
    their first evidence are written on the way: where they are few, the links and the evidence of the store stay where they are, and
    else those are dealt once.
    """
    obs = settled(observation_members(store))
    links = store["entity_links"].select("entity_id", "kind", "value", F.col("seq").alias("link_seq"))
    member = settled(obs.select("entity_id", "key").join(links, "entity_id"))
    blank = {"blocks": F.lit(None).cast("boolean"), "severity": F.lit(None).cast("int"), "name": F.lit(None).cast("string"), "at": F.lit(None).cast("struct<seq:bigint,entity_id:string>")}

    def of_kind(df: DataFrame, kind: Column, **given: Column) -> DataFrame:
        return df.select("key", kind.alias("kind"), *[given.get(n, c).alias(n) for n, c in blank.items()])

    distinct = member.groupBy("key", "kind", "value").agg(F.count("*").alias("times"))
    conflicts = store["conflicts"].filter("blocks").select(F.col("id").alias("value"), F.lit("conflict").alias("kind"), F.lit(True).alias("blocks")).distinct()
    blocking = distinct.filter("kind = 'conflict'").join(conflicts, ["value", "kind"])
    companies = companies_by_project(store["entities"], store["entity_links"])
    company = distinct.filter("kind = 'project'").join(companies, F.col("value") == F.col("project")).select("key", "company_id").distinct()
    first = member.filter("kind = 'evidence'").groupBy("entity_id", "key").agg(F.min_by("value", F.struct("link_seq", "value")).alias("id"))
    first = settled(first.select("key", "id")).join(store["evidence"].select("id", "confidence"), "id")
    at = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("entity_id").alias("entity_id"))
    rows = (
        of_kind(distinct, F.col("kind"))
        .unionByName(of_kind(blocking, F.lit("blocking"), blocks=F.col("blocks")))
        .unionByName(of_kind(company, F.lit("company")))
        .unionByName(of_kind(first, F.lit("first"), severity=severity(F.col("confidence"))))
        .unionByName(of_kind(obs, F.lit("name"), name=F.col("name"), at=at))
    )
    counted = lambda kind: F.count_if(F.col("kind") == kind)
    df = rows.groupBy("key").agg(
        counted("project").alias("projects"), counted("company").alias("companies"), counted("evidence").alias("evidence_count"),
        F.count_if("blocks").alias("blocking_conflicts"), F.max("severity").alias("worst"), F.min_by("name", "at").alias("first_name"),
    ).filter("projects >= 2 AND companies >= 2")
    blocked = F.coalesce(F.col("blocking_conflicts"), F.lit(0)) > 0
    df = df.select(
        candidate_pattern_id("key").alias("id"), F.col("key").alias("observation_key"),
        F.concat(F.lit("Candidate: "), F.when(blocked, F.col("key")).otherwise(F.col("first_name"))).alias("name"),
        F.lit("candidate_unapproved").alias("status"),
        F.when(blocked, BLOCKED_LABEL).otherwise(LABEL).alias("label"),
        "projects", "companies", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.coalesce("blocking_conflicts", F.lit(0)).alias("blocking_conflicts"),
        worst_label(F.col("worst")).alias("confidence_summary"), blocked.alias("blocked"),
        F.when(blocked, "needs_review").otherwise("unreviewed").alias("review_status"),
    )
    if previous is None:
        return df.withColumn("is_new", F.lit(True))
    known = previous.select("id", F.lit(True).alias("_k")).distinct()
    return df.join(known, "id", "left").withColumn("is_new", F.col("_k").isNull()).drop("_k")


def pattern_links(patterns: DataFrame, store: dict[str, DataFrame]) -> DataFrame:
    """Members of each pattern: pattern_id, kind (project | company | evidence | conflict), value."""
    obs = observation_members(store).select("entity_id", "key")
    keys = patterns.select(F.col("id").alias("pattern_id"), F.col("observation_key").alias("key"))
    direct = obs.join(store["entity_links"], "entity_id").select("key", "kind", "value").distinct()
    companies = (
        direct.filter("kind = 'project'").select("key", F.col("value").alias("project"))
        .join(companies_by_project(store["entities"], store["entity_links"]), "project")
        .select("key", F.lit("company").alias("kind"), F.col("company_id").alias("value")).distinct()
    )
    blocking = store["conflicts"].filter("blocks").select(F.col("id").alias("value"))
    others = direct.filter("kind <> 'conflict'").unionByName(
        direct.filter("kind = 'conflict'").join(blocking, "value", "left_semi").select("key", "kind", "value")
    )
    return others.unionByName(companies).join(keys, "key").select("pattern_id", "kind", "value")


def pattern_counters(patterns: DataFrame) -> DataFrame:
    """How many patterns were created and how many are blocked."""
    return patterns.agg(
        F.count_if(F.col("is_new") & ~F.col("blocked")).alias("created"), F.count_if("blocked").alias("blocked")
    )


def inverted_index(store: dict[str, DataFrame]) -> DataFrame:
    """Postings (index_name, key, id) of the six lookup indexes."""
    e, links = store["entities"], store["entity_links"]
    by_project = links.filter("kind = 'project'").select(
        F.lit("by_project").alias("index_name"), F.col("value").alias("key"), F.col("entity_id").alias("id")
    )
    company = e.filter("type = 'Company'")
    # Companies that share a key overwrite each other in the index: the last one stays.
    by_company = company.groupBy("normalized_key").agg(F.max_by("id", F.struct("seq", "id")).alias("id")).select(
        F.lit("by_company").alias("index_name"), F.col("normalized_key").alias("key"), "id"
    )
    by_slug = companies_by_project(e, links).select(
        F.lit("by_company").alias("index_name"), F.col("project").alias("key"), F.col("company_id").alias("id")
    )
    posting = lambda df, name, key: df.select(F.lit(name).alias("index_name"), F.col(key).alias("key"), "id")
    status = store["evidence"].withColumn("status", F.when(F.col("stale"), "stale").otherwise(F.col("review_status")))
    parts = [
        by_project, by_company.unionByName(by_slug).distinct(),
        posting(e.filter("type = 'Industry'"), "by_industry", "normalized_key"),
        posting(e, "by_entity_type", "type"),
        posting(store["relationships"], "by_relationship_type", "type"),
        posting(status, "by_evidence_status", "status"),
    ]
    return reduce(DataFrame.unionByName, parts)


def latest_decisions(decisions: DataFrame, key: str) -> DataFrame:
    """The newest decision per key (ts, then decision_id)."""
    cols = [c for c in decisions.columns if c != key]
    return decisions.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("ts", "decision_id")).alias("d")).select(key, "d.*")


def apply_pattern_decisions(patterns: DataFrame, decisions: DataFrame) -> DataFrame:
    """Patterns after the newest human decision (promote | reject) each.

    ``outcome``: promoted, rejected, refused (a blocked pattern cannot be promoted) or
    none. Decisions on unknown patterns are `unknown_decisions`.
    """
    d = latest_decisions(decisions, "pattern_id").withColumnRenamed("pattern_id", "id")
    df = patterns.join(d, "id", "left")
    can = ~F.col("blocked") & (F.col("status") == "candidate_unapproved")
    outcome = (
        F.when((F.col("decision") == "promote") & can, "promoted")
        .when(F.col("decision") == "promote", "refused")
        .when(F.col("decision") == "reject", "rejected")
        .otherwise("none")
    )
    df = df.withColumn("outcome", outcome)
    status = (
        F.when(F.col("outcome") == "promoted", "approved").when(F.col("outcome") == "rejected", "rejected")
        .otherwise(F.col("review_status"))
    )
    approved = F.when(
        F.col("outcome") == "promoted", entity_id("DesignPattern", normalize_key("observation_key", ascii_only=True))
    )
    return df.withColumn("review_status", status).withColumn("approved_entity_id", approved)


def approved_entities(decided: DataFrame) -> DataFrame:
    """Design pattern entities made by promotion."""
    return decided.filter("outcome = 'promoted'").select(
        F.col("approved_entity_id").alias("id"), F.lit("DesignPattern").alias("type"),
        F.regexp_replace("name", r"(?i)^Candidate:\s*", "Approved pattern: ").alias("name"),
        F.col("observation_key").alias("normalized_key"), F.lit("reusable_pattern").alias("epistemic_class"),
        F.lit("industry_approved").alias("visibility"), F.lit("approved").alias("review_status"),
        F.lit(0).cast("bigint").alias("seq"),
    )


def unknown_decisions(patterns: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(patterns.select(F.col("id").alias("pattern_id")), "pattern_id", "left_anti")


def audit_log(decided: DataFrame, patterns: DataFrame, now: str) -> DataFrame:
    """Audit rows to append: created and blocked candidates, promotions, rejections."""
    human = decided.filter(F.col("outcome").isin("promoted", "rejected")).select(
        F.lit(now).alias("at"), F.col("outcome").alias("action"), F.col("reviewer").alias("actor"),
        F.col("id").alias("pattern_id"), "reason",
    )
    made = patterns.filter("blocked or is_new").select(
        F.lit(now).alias("at"), F.when(F.col("blocked"), "candidate_blocked").otherwise("candidate_created").alias("action"),
        F.lit("system").alias("actor"), F.col("id").alias("pattern_id"),
        F.when(F.col("blocked"), F.lit("Conflicting evidence blocks automatic candidate pattern creation")).otherwise(
            F.concat(F.lit("Same normalized observation in "), F.col("projects").cast("string"), F.lit(" projects / "),
                     F.col("companies").cast("string"), F.lit(" companies"))
        ).alias("reason"),
    )
    return human.unionByName(made)
