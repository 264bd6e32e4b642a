"""Benchmark scoring: observations, scores, peers, recommendations, approvals.

A definition is a small configuration object. Its concept x dimension pairs enter the
plan as a literal array that is exploded per project, so the observation grid needs no
product of tables. An unknown value stays NULL in every aggregate.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.core import compact, txt, word
from pagelattice.functions.keys import digest
from pagelattice.operators.patterns import latest_decisions

GAP_CONCEPT = "canon_calculator-opportunity"
TOOL_CONCEPTS = ["canon_engineering-calculator", "canon_limiting-height-tool", "canon_engineering-table"]
CORE_CONCEPTS = ["canon_engineering-calculator", "canon_submittal-workflow", "canon_document-center"]
PRESENCE = "capability_presence"
APPROVAL_KEYS = ["benchmark.definition.review", "benchmark.observation.review", "benchmark.publish"]
SYNTHETIC_NOTE = "SYNTHETIC FIXTURE — not live market evidence"


@dataclass(frozen=True)
class Dimension:
    id: str
    name: str
    weight: float
    missing: str = "mark_unknown"  # mark_unknown | exclude_dimension | cap_confidence
    concepts: tuple[str, ...] = ()  # empty: all concepts


@dataclass(frozen=True)
class Definition:
    id: str
    version: str
    concepts: tuple[str, ...]
    dimensions: tuple[Dimension, ...]
    status: str = "accepted"
    min_mapped_concepts: int = 3
    min_evidence_coverage: float = 0.35
    min_eligible_dimensions: int = 4
    required_dimensions: tuple[str, ...] = (PRESENCE, "evidence_quality")
    suppress_below_coverage: float = 0.35
    require_evidence: bool = True
    allow_stale: bool = False
    high_floor: float = 0.9
    medium_floor: float = 0.75
    stale_penalty: float = 0.25
    conflict_penalty: float = 0.35
    weights: dict = field(default_factory=dict, hash=False, compare=False)

    def pairs(self) -> list[tuple[str, str]]:
        return [(c, d.id) for c in self.concepts for d in self.dimensions if not d.concepts or c in d.concepts]

    def weight(self, dim: Dimension) -> float:
        return self.weights.get(dim.id, dim.weight)


def _c(*names: str) -> tuple[str, ...]:
    return tuple(f"canon_{n}" for n in names)


# The seed definition (20 concepts, 11 dimensions, 108 observations per company).
SEED_DEFINITION = Definition(
    id="cfs-digital-capability",
    version="1.0.0",
    concepts=_c(
        "document-center", "engineering-calculator", "product-selector", "submittal-workflow", "technical-resources",
        "product-catalog", "product-data-sheet", "installation-guide", "specification", "cad-bim-resource", "code-report",
        "engineering-table", "limiting-height-tool", "product-family", "product-detail", "contact-rep-locator",
        "search-experience", "navigation-pattern", "download-workflow", "calculator-opportunity",
    ),
    dimensions=(
        Dimension(PRESENCE, "Capability Presence", 0.2),
        Dimension("discoverability", "Discoverability", 0.1, "cap_confidence",
                  _c("navigation-pattern", "search-experience", "product-catalog", "document-center")),
        Dimension("information_completeness", "Information Completeness", 0.1, "mark_unknown",
                  _c("document-center", "product-data-sheet", "installation-guide", "specification", "product-detail", "product-family")),
        Dimension("technical_depth", "Technical Depth", 0.1, "mark_unknown",
                  _c("engineering-table", "cad-bim-resource", "code-report", "specification", "technical-resources")),
        Dimension("workflow_support", "Workflow Support", 0.1, "mark_unknown",
                  _c("submittal-workflow", "download-workflow", "contact-rep-locator")),
        Dimension("document_accessibility", "Document Accessibility", 0.08, "cap_confidence",
                  _c("document-center", "download-workflow")),
        Dimension("product_navigation", "Product Navigation", 0.07, "mark_unknown",
                  _c("product-catalog", "product-family", "product-detail", "navigation-pattern")),
        Dimension("engineering_utility", "Engineering Utility", 0.1, "mark_unknown",
                  _c("engineering-calculator", "limiting-height-tool", "engineering-table", "calculator-opportunity")),
        Dimension("evidence_quality", "Evidence Quality", 0.1, "cap_confidence"),
        Dimension("evidence_recency", "Evidence Recency", 0.03, "cap_confidence"),
        Dimension("cross_channel_consistency", "Cross-Channel Consistency", 0.02, "cap_confidence"),
    ),
)


def resolve_definition(definitions: list[Definition], benchmark_id: str, version: str | None = None) -> Definition:
    """The requested version, else the highest accepted one, else the highest."""
    pool = [d for d in definitions if d.id == benchmark_id]
    if version is not None:
        pool = [d for d in pool if d.version == version]
    if not pool:
        raise ValueError(f"no definition {benchmark_id}@{version or 'any'}")
    accepted = [d for d in pool if d.status == "accepted"]
    return max(accepted or pool, key=lambda d: d.version)


def definition_errors(d: Definition) -> list[str]:
    """What is wrong with a definition; empty when it is valid."""
    out = []
    if abs(sum(d.weight(x) for x in d.dimensions) - 1.0) > 1e-6:
        out.append("weights do not sum to 1")
    out += [f"weight of {x.id} out of range" for x in d.dimensions if not 0 <= d.weight(x) <= 1]
    out += [f"unknown missing-evidence behavior of {x.id}" for x in d.dimensions
            if x.missing not in ("mark_unknown", "exclude_dimension", "cap_confidence")]
    out += [f"{x.id} names an unknown concept" for x in d.dimensions if set(x.concepts) - set(d.concepts)]
    if len({x.id for x in d.dimensions}) != len(d.dimensions):
        out.append("duplicate dimension")
    return out


def definition_digest(d: Definition) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(asdict(d), sort_keys=True).encode()).hexdigest()[:24]


def is_synthetic(website_url: Column | str, notes: Column | str) -> Column:
    """Fixture projects: an .example host, or notes saying so unless they deny it."""
    n = F.lower(txt(notes))
    return (
        F.when(txt(website_url).contains(".example"), True)
        .when(n.rlike(word(r"not\s+synthetic")), False)
        .otherwise(n.rlike(word("synthetic")) | n.rlike(word("fixture")))
    )


def best_mappings(mappings: DataFrame) -> DataFrame:
    """Most confident unrejected mapping per project and concept, the first on ties."""
    return (
        mappings.filter("review_status <> 'rejected' and concept_id is not null")
        .groupBy(F.col("source_project").alias("project"), "concept_id")
        .agg(
            F.max_by(
                F.struct("id", "source_entity_id", "confidence", "method", "review_status", "below_threshold", "ambiguity_notes"),
                F.struct("confidence", -F.col("seq"), "id"),
            ).alias("m")
        )
        .select("project", "concept_id", F.col("m.id").alias("mapping_id"), F.col("m.source_entity_id").alias("entity_id"),
                F.col("m.confidence").alias("mapping_confidence"), F.col("m.method").alias("mapping_method"),
                F.col("m.review_status").alias("mapping_status"), "m.below_threshold", "m.ambiguity_notes")
    )


def _support(best: DataFrame, store: dict) -> DataFrame:
    """Evidence count, staleness and conflicts of the mapped entities."""
    wanted = best.select("entity_id").distinct()
    links = store["entity_links"].filter(F.col("kind").isin("evidence", "conflict")).join(wanted, "entity_id", "left_semi")
    stale = store["evidence"].filter("stale").select(F.col("id").alias("value"), F.lit(True).alias("st"))
    blocking = store["conflicts"].filter("blocks").select(F.col("id").alias("value"), F.lit(True).alias("bl"))
    ev = links.filter("kind = 'evidence'").join(stale, "value", "left").groupBy("entity_id").agg(
        F.count("*").alias("evidence_count"), F.bool_or(F.col("st").isNotNull()).alias("stale")
    )
    cf = links.filter("kind = 'conflict'").join(blocking, "value", "left").groupBy("entity_id").agg(
        F.count("*").alias("conflict_count"), F.bool_or(F.col("bl").isNotNull()).alias("blocking")
    )
    return wanted.join(ev, "entity_id", "left").join(cf, "entity_id", "left")


def observe(mappings: DataFrame, store: dict, projects: DataFrame, definition: Definition = SEED_DEFINITION) -> DataFrame:
    """Observations of every project: one per applicable concept and dimension."""
    d, c = definition, F.col
    best = best_mappings(mappings)
    best = best.join(_support(best, store), "entity_id", "left")
    grid = F.array(*[F.struct(F.lit(k).alias("concept_id"), F.lit(dim).alias("dimension_id")) for k, dim in d.pairs()])
    p = projects.select(c("slug").alias("project"), c("name").alias("company_name"), is_synthetic("website_url", "notes").alias("synthetic"))
    df = p.select("*", F.explode(grid).alias("g")).select("project", "company_name", "synthetic", "g.*").join(best, ["project", "concept_id"], "left")
    n_ev, n_cf = F.coalesce("evidence_count", F.lit(0)), F.coalesce("conflict_count", F.lit(0))
    none = c("mapping_id").isNull()
    unsure = (c("mapping_status") == "ambiguous") | c("below_threshold")
    lacking = F.lit(d.require_evidence) & (n_ev == 0)
    gap = c("concept_id") == GAP_CONCEPT
    mc = c("mapping_confidence")
    case = (
        F.when(none, "none").when(unsure, "unsure").when(lacking, "lacking").when(gap, "gap").when(mc >= 0.85, "present").otherwise("partial")
    )
    df = df.withColumn("case", case)
    scored = c("case").isin("gap", "present", "partial")
    penalized = scored & F.coalesce("stale", F.lit(False)) & F.lit(not d.allow_stale)
    blocked = scored & F.coalesce("blocking", F.lit(False))
    base = (
        F.when(mc >= d.high_floor, F.least(F.lit(0.95), mc)).when(mc >= d.medium_floor, F.least(F.lit(0.85), mc))
        .otherwise(F.greatest(F.lit(0.35), mc * 0.9))
    )
    conf = F.when(c("case") == "none", 0.35).when(c("case") == "unsure", F.least(F.lit(0.5), mc)).when(c("case") == "lacking", 0.4).otherwise(base)
    df = df.withColumn("is_stale", penalized).withColumn("is_blocked", blocked).withColumn("c0", conf)
    df = df.withColumn("c1", F.when(c("is_stale"), F.greatest(F.lit(0.2), c("c0") - d.stale_penalty)).otherwise(c("c0")))
    df = df.withColumn("c2", F.when(c("is_blocked"), F.greatest(F.lit(0.15), c("c1") - d.conflict_penalty)).otherwise(c("c1")))
    state = (
        F.when(c("case").isin("none", "lacking"), "unknown").when(c("case") == "unsure", "ambiguous")
        .when(c("case") == "present", "present").otherwise("partial")
    )
    note = F.array_join(
        compact(
            F.when(c("case") == "none", "No successful normalization mapping for this concept — unknown, not absent")
            .when(c("case") == "unsure", "Mapping not accepted for scoring performance")
            .when(c("case") == "lacking", "Mapping exists but required evidence missing — unknown")
            .when(c("case") == "gap", "Opportunity/gap signal — not a confirmed capability"),
            F.when(c("is_stale"), "stale evidence penalty applied"),
            F.when(c("synthetic"), SYNTHETIC_NOTE),
        ),
        "; ",
    )
    carries = c("case").isin("unsure", "lacking", "gap", "present", "partial")
    df = df.select(
        "project", "company_name", "concept_id", "dimension_id", state.alias("observed_state"),
        F.when(c("case") == "gap", "gap_signal").when(c("case").isin("unsure", "present", "partial"), mc.cast("string")).alias("raw_value"),
        F.when(c("case") == "gap", 0.25).when(c("case") == "present", 1.0).when(c("case") == "partial", 0.55).alias("normalized_value"),
        F.when(c("synthetic"), F.least(c("c2"), F.lit(0.7))).otherwise(c("c2")).alias("confidence"),
        F.when(carries, c("entity_id")).alias("entity_id"), "mapping_id",
        F.when(carries, n_ev).otherwise(0).alias("evidence_count"),
        F.when(c("case").isin("lacking", "gap", "present", "partial"), n_cf).otherwise(0).alias("conflict_count"),
        "is_stale",
        F.when(c("is_blocked"), "Blocking conflicts on source entity")
        .when(c("case") == "unsure", F.coalesce(F.when(c("ambiguity_notes") != "", c("ambiguity_notes")), F.lit("Ambiguous or below-threshold mapping")))
        .otherwise("").alias("ambiguity"),
        "synthetic", note.alias("notes"),
    )
    oid = F.substring(F.sha2(F.concat_ws("|", "project", F.lit(d.id), F.lit(d.version), "concept_id", "dimension_id", "observed_state"), 256), 1, 32)
    return df.select(F.concat(F.lit("bobs_"), oid).alias("id"), "*")


def concept_scores(obs: DataFrame) -> DataFrame:
    """Score per project and concept from its presence observation; unknown is NULL."""
    c = F.col
    eligible = ~c("observed_state").isin("unknown", "ambiguous", "not_applicable") & c("normalized_value").isNotNull()
    return obs.filter(c("dimension_id") == PRESENCE).select(
        "project", "concept_id", F.when(eligible, c("normalized_value") * 100).alias("raw_score"), "confidence",
        F.when(c("evidence_count") > 0, 1.0).otherwise(0.0).alias("evidence_coverage"),
        F.when(eligible, 1.0).otherwise(0.0).alias("completeness"), (1 - c("confidence")).alias("uncertainty"), eligible.alias("eligible"),
        F.when(c("observed_state") == "unknown", "unknown_not_scored_as_absent").when(c("observed_state") == "ambiguous", "ambiguous")
        .when(c("observed_state") == "not_applicable", "not_applicable").otherwise("").alias("exclusion"),
    )


def dimension_scores(obs: DataFrame, definition: Definition = SEED_DEFINITION) -> DataFrame:
    """Score per project and dimension, one partial aggregate."""
    c, d = F.col, definition
    known = c("normalized_value").isNotNull() & c("observed_state").isin("present", "partial", "absent")
    held = c("observed_state").isin("present", "partial")
    tool, gap = c("concept_id").isin(TOOL_CONCEPTS), c("concept_id") == GAP_CONCEPT
    value = F.when(known, c("normalized_value"))
    agg = obs.groupBy("project", "dimension_id").agg(
        F.count("*").alias("n"), F.count_if(c("observed_state") == "unknown").alias("unknown"),
        F.count_if(c("observed_state") == "ambiguous").alias("ambiguous"), F.count_if(known).alias("scored"),
        F.avg("confidence").alias("conf"), F.avg(value).alias("plain"), F.avg(F.when(tool, value)).alias("tools"),
        F.count_if(known & gap).alias("gaps"), F.count_if(held).alias("held"),
        F.count_if(held & (c("evidence_count") > 0) & (c("conflict_count") == 0)).alias("good"),
        F.avg(F.when(c("evidence_count") > 0, F.when(c("is_stale"), 0.4).otherwise(0.95))).alias("fresh"),
        F.count_if(c("observed_state") != "not_applicable").alias("total"),
        F.count_if((c("observed_state") != "not_applicable") & ((c("observed_state") == "ambiguous") | (c("conflict_count") > 0))).alias("bad"),
    )
    mean = (
        F.when(c("dimension_id") == "engineering_utility", F.coalesce("tools", F.when(c("gaps") > 0, 0.2)))
        .when(c("dimension_id") == "evidence_quality", F.when(c("held") > 0, c("good") / c("held")))
        .when(c("dimension_id") == "evidence_recency", c("fresh"))
        .when(c("dimension_id") == "cross_channel_consistency", F.when(c("total") > 0, 1 - c("bad") / c("total")))
        .otherwise(c("plain"))
    )
    weight, caps, label = F.lit(None).cast("double"), F.lit(False), F.lit(None).cast("string")
    for x in d.dimensions:
        is_x = c("dimension_id") == x.id
        weight = F.when(is_x, F.lit(float(d.weight(x)))).otherwise(weight)
        label = F.when(is_x, x.name).otherwise(label)
        caps = F.when(is_x, F.lit(x.missing == "cap_confidence")).otherwise(caps)
    # Rounding removes the summation-order noise of a distributed mean.
    df = agg.withColumn("raw_score", F.round(mean * 100, 9)).withColumn("coverage", (c("n") - c("unknown")) / c("n")).withColumn("weight", weight)
    capped = caps & (c("coverage") < 0.25)
    return df.select(
        "project", "dimension_id", label.alias("label"), "raw_score", (c("raw_score") * c("weight")).alias("weighted_score"),
        F.when(capped, F.least("conf", F.lit(0.55))).otherwise(c("conf")).alias("confidence"), c("coverage").alias("evidence_coverage"),
        (1 - c("conf")).alias("uncertainty"), "weight", c("raw_score").isNotNull().alias("eligible"),
        F.when(c("raw_score").isNotNull(), "").when((c("unknown") > 0) & (c("scored") == 0), "insufficient_known_observations")
        .otherwise("no_scorable_observations").alias("exclusion"),
        "ambiguous",
    )


def company_scores(dims: DataFrame, concepts: DataFrame, definition: Definition = SEED_DEFINITION) -> DataFrame:
    """Overall score per project, suppressed (NULL) unless all eligibility rules hold."""
    c, d = F.col, definition
    required = [F.bool_or((c("dimension_id") == r) & c("eligible")) for r in d.required_dimensions]
    agg = dims.groupBy("project").agg(
        F.count_if("eligible").alias("eligible_dimensions"), F.avg("evidence_coverage").alias("evidence_coverage"),
        F.avg(F.when(c("eligible"), c("confidence"))).alias("ec"), F.avg("confidence").alias("ac"),
        F.sum(F.when(c("eligible"), c("raw_score") * c("weight"))).alias("num"), F.sum(F.when(c("eligible"), c("weight"))).alias("den"),
        (reduce(lambda a, b: a & b, required) if required else F.lit(True)).alias("required_ok"),
    )
    mapped = concepts.groupBy("project").agg(F.count_if("eligible").alias("mapped_concepts"))
    df = agg.join(mapped, "project")
    ok = (
        (c("mapped_concepts") >= d.min_mapped_concepts) & (c("evidence_coverage") >= d.min_evidence_coverage)
        & (c("eligible_dimensions") >= d.min_eligible_dimensions) & c("required_ok") & (c("evidence_coverage") >= d.suppress_below_coverage)
    )
    conf = F.coalesce("ec", "ac")
    return df.select(
        "project", F.when(ok, c("num") / F.when(c("den") == 0, 1.0).otherwise(c("den"))).alias("overall_score"), conf.alias("confidence"),
        "evidence_coverage", (1 - conf).alias("uncertainty"), "mapped_concepts", "eligible_dimensions", ok.alias("eligible"),
        F.when(ok, "").otherwise("eligibility_threshold_not_met").alias("exclusion"),
    )


def peer_medians(scores: DataFrame, key: str, cohorts: DataFrame) -> DataFrame:
    """Lower median, range and coverage per cohort and concept or dimension.

    ``cohorts``: cohort_id, project. The exact median keeps one counter per distinct
    score; a definition bounds how many there are, however many companies there are.
    """
    size = cohorts.groupBy("cohort_id").agg(F.count("*").alias("cohort_size"))
    df = scores.join(cohorts, "project").groupBy("cohort_id", key).agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY raw_score)").alias("median"),
        F.min("raw_score").alias("low"), F.max("raw_score").alias("high"), F.count("raw_score").alias("known"),
        F.avg(F.when(F.col("raw_score").isNotNull(), F.col("confidence"))).alias("conf"),
        F.count_if(F.col("exclusion") == "unknown_not_scored_as_absent").alias("unknown"),
    ).join(size, "cohort_id")
    coverage = F.col("known") / F.greatest(F.lit(1), F.col("cohort_size"))
    return df.select(
        "cohort_id", key, "median", "low", "high", "known", "unknown", F.coalesce("conf", F.lit(0.3)).alias("confidence"),
        coverage.alias("evidence_coverage"), (1 - coverage).alias("uncertainty"), (F.col("known") >= 2).alias("eligible"),
    )


def peer_gaps(scores: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Gap per cohort and concept where exactly two companies are known."""
    c = F.col
    strong = F.struct((-c("raw_score")).alias("r"), c("project"))
    df = (
        scores.filter("raw_score is not null").join(cohorts, "project").groupBy("cohort_id", "concept_id").agg(
            F.count("*").alias("known"), F.min_by("project", strong).alias("stronger"), F.max_by("project", strong).alias("weaker"),
            (F.max("raw_score") - F.min("raw_score")).alias("delta"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"),
        )
        .filter("known = 2")
    )
    inconclusive = (c("delta") < 5) | (c("hi") - c("lo") > 0.35) | (c("lo") < 0.5)
    return df.select("cohort_id", "concept_id", "stronger", "weaker", "delta", inconclusive.alias("inconclusive"))


def peer_conclusions(gaps: DataFrame) -> DataFrame:
    """Largest and smallest conclusive gap per cohort."""
    row = F.struct("concept_id", "stronger", "weaker", "delta")
    agg = gaps.filter("not inconclusive").groupBy("cohort_id").agg(
        F.min_by(row, F.struct(-F.col("delta"), "concept_id")).alias("s"), F.max_by(row, F.struct(-F.col("delta"), "concept_id")).alias("w")
    )
    return agg.select(
        "cohort_id", F.col("s.stronger").alias("leader"), F.col("s.concept_id").alias("leads_on"), F.col("s.delta").alias("leads_by"),
        F.col("w.weaker").alias("trailer"), F.col("w.concept_id").alias("trails_on"),
    )


def recommend(obs: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Recommendations from a company's own evidence; a peer only adds context."""
    c = F.col
    presence = obs.filter(c("dimension_id") == PRESENCE).select("project", "company_name", "concept_id", "observed_state", "confidence", "evidence_count")

    def rows(df: DataFrame, kind: str, tag: str, dimension: str, confidence: Column) -> DataFrame:
        rid = F.substring(F.sha2(F.concat_ws("|", "project", "concept_id", F.lit(tag)), 256), 1, 32)
        return df.select(
            F.concat(F.lit("brec_"), rid).alias("id"), "project", "concept_id", F.lit(dimension).alias("dimension_id"),
            F.lit(kind).alias("kind"), confidence.alias("confidence"), "evidence_count",
        )

    core = c("concept_id").isin(CORE_CONCEPTS)
    out = [
        rows(presence.filter("observed_state = 'unknown'"), "evidence_gap", "evidence_gap", PRESENCE, c("confidence")),
        rows(presence.filter("observed_state = 'ambiguous'"), "likely_gap", "likely_gap", PRESENCE, c("confidence")),
        rows(presence.filter((c("observed_state") == "partial") & core), "optimization_opportunity", "optimization", "engineering_utility", c("confidence")),
    ]
    if gaps is not None:
        firm = gaps.filter("not inconclusive")
        ahead = firm.filter("delta >= 20").select(c("stronger").alias("project"), "concept_id").distinct()
        behind = firm.filter("delta >= 25").select(c("weaker").alias("project"), "concept_id").distinct()
        keys = ["project", "concept_id"]
        own = presence.join(ahead, keys, "left_semi").filter(c("observed_state").isin("present", "partial") & (c("evidence_count") > 0))
        out.append(rows(own, "peer_relative_advantage", "advantage", PRESENCE, F.least("confidence", F.lit(0.75))))
        weak = presence.join(behind, keys, "left_semi").filter("observed_state = 'partial'")
        out.append(rows(weak, "confirmed_gap", "confirmed_gap", PRESENCE, F.least("confidence", F.lit(0.7))))
    return reduce(DataFrame.unionByName, out)


def run_status(obs: DataFrame, companies: DataFrame, recommendations: DataFrame) -> DataFrame:
    """State counters and headline numbers per project of one run."""
    c = F.col
    states = obs.groupBy("project").agg(
        F.count("*").alias("observations"), *[F.count_if(c("observed_state") == s).alias(s) for s in ("present", "absent", "partial", "unknown", "ambiguous")],
        F.bool_or("synthetic").alias("synthetic"),
    )
    conflicts = obs.filter("conflict_count > 0").groupBy("project", "entity_id").agg(F.max("conflict_count").alias("k")).groupBy("project").agg(F.sum("k").alias("conflicts"))
    recs = recommendations.groupBy("project").agg(F.count("*").alias("recommendations"))
    return (
        states.join(companies.select("project", "overall_score", "eligible", "confidence", "evidence_coverage"), "project")
        .join(conflicts, "project", "left").join(recs, "project", "left").fillna(0, ["conflicts", "recommendations"])
    )


def input_digests(mappings: DataFrame, definition: Definition = SEED_DEFINITION) -> DataFrame:
    """Digest of a project's mapping ids under a definition, independent of order."""
    part = lambda at: F.conv(F.substring(F.sha2(F.col("id"), 256), at, 15), 16, 10).cast("decimal(38,0)")
    df = mappings.groupBy(F.col("source_project").alias("project")).agg(
        F.count("*").cast("string").alias("n"), F.sum(part(1)).cast("string").alias("a"), F.sum(part(16)).cast("string").alias("b")
    )
    return df.select("project", digest("project", F.lit(definition.id), F.lit(definition.version), "n", "a", "b").alias("input_digest"))


def stale_inputs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Projects whose inputs changed since the previous run."""
    old = previous.select("project", F.col("input_digest").alias("old"))
    return current.join(old, "project", "left").filter(~F.col("input_digest").eqNullSafe(F.col("old"))).select("project")


def run_record(digests: DataFrame, definition: Definition, run_id: str, now: str) -> DataFrame:
    """One row describing a run; append it to the run log."""
    part = F.conv(F.substring(F.sha2(F.col("input_digest"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    df = digests.agg(F.count("*").alias("projects"), F.sum(part).cast("string").alias("a"))
    return df.select(
        F.lit(run_id).alias("run_id"), F.lit(definition.id).alias("benchmark_id"), F.lit(definition.version).alias("benchmark_version"),
        "projects", digest(F.col("projects").cast("string"), "a").alias("input_digest"), F.lit(now).alias("generated_at"),
    )


def approvals(log: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Latest approval per key, artifact and version, valid while the artifact still has
    that version and digest.

    ``log``: key, artifact_id, artifact_version, digest, reviewer, decision, ts,
    decision_id. ``artifacts``: artifact_id, current_version, current_digest.
    """
    c = F.col
    cols = ["digest", "reviewer", "decision", "ts", "decision_id"]
    last = log.groupBy("key", "artifact_id", "artifact_version").agg(F.max_by(F.struct(*cols), F.struct("ts", "decision_id")).alias("d"))
    df = last.select("key", "artifact_id", "artifact_version", "d.*").join(artifacts, "artifact_id", "left")
    changed = c("current_version").isNotNull() & ((c("artifact_version") != c("current_version")) | (c("digest") != c("current_digest")))
    return df.withColumn("valid", ~changed).drop("current_version", "current_digest")


def publish_gate(approved: DataFrame, keys: list[str] = APPROVAL_KEYS) -> DataFrame:
    """Per artifact version which required approvals are satisfied."""
    ok = F.col("valid") & (F.col("decision") == "approved")
    flags = [F.bool_or(ok & (F.col("key") == k)).alias(k.replace(".", "_")) for k in keys]
    df = approved.groupBy("artifact_id", "artifact_version").agg(*flags)
    return df.withColumn("publishable", reduce(lambda a, b: a & b, [F.col(k.replace(".", "_")) for k in keys]))


def apply_observation_reviews(obs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Observations after the newest review each.

    ``decisions``: observation_id, decision (accepted | rejected | overridden |
    unresolved), reviewer, rationale, resulting_state, resulting_normalized, ts,
    decision_id. An override without a state changes nothing.
    """
    c = F.col
    d = latest_decisions(decisions, "observation_id").withColumnRenamed("observation_id", "id")
    df = obs.join(d, "id", "left")
    over = F.coalesce((c("decision") == "overridden") & c("resulting_state").isNotNull(), F.lit(False))
    rejected = F.coalesce(c("decision") == "rejected", F.lit(False))
    accepted = F.coalesce(c("decision") == "accepted", F.lit(False))
    note = (
        F.when(over, F.concat(c("notes"), F.lit("; OVERRIDE by "), c("reviewer"), F.lit(": "), c("rationale")))
        .when(rejected, F.concat(c("notes"), F.lit("; REJECTED observation: "), c("rationale")))
        .when(accepted, F.concat(c("notes"), F.lit("; ACCEPTED by "), c("reviewer"))).otherwise(c("notes"))
    )
    changed = df.withColumn("notes", F.trim(note)).withColumn("material_override", over)
    changed = changed.withColumn("observed_state", F.when(over, c("resulting_state")).when(rejected, "unknown").otherwise(c("observed_state")))
    value = F.when(over, F.coalesce("resulting_normalized", "normalized_value")).when(rejected, F.lit(None)).otherwise(c("normalized_value"))
    return changed.withColumn("normalized_value", value).select(*obs.columns, "material_override")


def observation_digest() -> Column:
    return digest("id", "observed_state", F.format_string("%.6f", "normalized_value"), F.format_string("%.6f", "confidence"),
                  "concept_id", "dimension_id", tag="observation")


def cohort_labels(cohorts: DataFrame, projects: DataFrame) -> DataFrame:
    """Live and synthetic members per cohort and the label that follows from them."""
    p = projects.select(F.col("slug").alias("project"), is_synthetic("website_url", "notes").alias("synthetic"))
    df = cohorts.join(p, "project").groupBy("cohort_id").agg(
        F.count_if(~F.col("synthetic")).alias("live"), F.count_if("synthetic").alias("synthetic")
    )
    live, syn, dash = F.col("live"), F.col("synthetic"), " — "
    label = (
        F.when((live > 0) & (syn > 0), f"Mixed live+synthetic cohort{dash}synthetic evidence must not be treated as market proof")
        .when(syn > 0, f"Synthetic validation cohort{dash}not live market evidence")
        .when(live == 2, f"Live two-company validation cohort{dash}not an industry benchmark")
        .when(live > 2, F.concat(F.lit("Live "), live.cast("string"), F.lit(f"-company validation cohort{dash}not an industry benchmark")))
        .otherwise("Single-company validation run")
    )
    return df.withColumn("label", label).withColumn("limited", (live + syn < 3) | (syn > 0))


def evidence_gaps(obs: DataFrame) -> DataFrame:
    """Unknown and ambiguous observations per project, and how many concepts they span."""
    per_concept = obs.groupBy("project", "concept_id").agg(
        F.count_if(F.col("observed_state") == "unknown").alias("u"), F.count_if(F.col("observed_state") == "ambiguous").alias("a")
    )
    return per_concept.groupBy("project").agg(
        F.sum("u").alias("unknown"), F.sum("a").alias("ambiguous"), F.count_if(F.col("u") > 0).alias("unknown_concepts"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("u") > 0, F.col("concept_id")))), ",").alias("concepts"),
    )


def run_benchmark(tables: dict, definition: Definition = SEED_DEFINITION) -> dict[str, DataFrame]:
    """All result tables of a run over mappings, store, projects and (optional) cohorts."""
    obs = observe(tables["mappings"], tables["store"], tables["projects"], definition)
    cs = concept_scores(obs)
    ds = dimension_scores(obs, definition)
    co = company_scores(ds, cs, definition)
    out = {"observations": obs, "concept_scores": cs, "dimension_scores": ds, "company_scores": co}
    gaps = None
    if tables.get("cohorts") is not None:
        gaps = peer_gaps(cs, tables["cohorts"])
        out["concept_peers"] = peer_medians(cs, "concept_id", tables["cohorts"])
        out["dimension_peers"] = peer_medians(ds, "dimension_id", tables["cohorts"])
        out["gaps"] = gaps
    out["recommendations"] = recommend(obs, gaps)
    out["status"] = run_status(obs, co, out["recommendations"])
    return out
