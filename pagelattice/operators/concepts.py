"""Entity-to-concept linking: registry, matching, human review, comparison.

Matching works on distinct label shapes instead of entities: a label used by many
projects is matched once. All three fuzzy rules are equi-joins (on key, on a shared
six-character piece, on a shared token), never a product of labels and aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelattice.functions.core import clip, txt
from pagelattice.functions.keys import candidate_pattern_id, digest, key_of, normalize_key, stable_hash
from pagelattice.operators.patterns import companies_by_project, latest_decisions
from pagelattice.session import settled

# The concepts a registry starts from, as (name, type, aliases).
SEED_CONCEPTS = [
    ("Document Center", "resource", ["Engineering Resources", "Technical Documents", "Downloads", "Literature", "Resources", "Technical Library", "Document Library"]),
    ("Engineering Calculator", "tool", ["Wall Selector", "Stud Selector", "Limiting Height Calculator", "Limiting Height Tool", "Span Calculator", "Load Calculator", "Engineering Tools"]),
    ("Product Selector", "tool", ["Product Finder", "Selector Tool", "Choose a Product"]),
    ("Submittal Workflow", "workflow", ["Submittals", "Submittal Builder", "Package Builder", "Request a Submittal", "Submittal Package"]),
    ("Technical Resources", "resource", ["Tech Resources", "Engineering Support", "Technical Support"]),
    ("Product Catalog", "product_structure", ["Products", "Product Line", "Catalog", "Our Products"]),
    ("Product Data Sheet", "document_type", ["Data Sheet", "Datasheet", "Product Sheet", "Tech Sheet"]),
    ("Installation Guide", "document_type", ["Install Guide", "Installation Instructions", "How to Install"]),
    ("Specification", "document_type", ["Specs", "Architectural Specifications", "Guide Spec", "CSI Spec"]),
    ("CAD/BIM Resource", "document_type", ["CAD", "BIM", "Revit Families", "Details", "Drawings", "DWG"]),
    ("Code Report", "document_type", ["ESR", "Code Compliance", "Evaluation Report", "ICC Report"]),
    ("Engineering Table", "document_type", ["Load Tables", "Span Tables", "Limiting Height Tables", "Engineering Tables", "Allowable Height"]),
    ("Limiting Height Tool", "tool", ["Limiting Heights", "Wall Height Tool", "Stud Height"]),
    ("Product Family", "product_structure", ["Product Line", "Product Series", "Product Family"]),
    ("Product Detail", "product_structure", ["Product Page", "SKU Detail", "Item Detail"]),
    ("Project Resource", "resource", ["Projects", "Case Studies", "Project Gallery"]),
    ("Contact / Rep Locator", "experience", ["Contact", "Find a Rep", "Rep Locator", "Distributor Locator", "Sales Contact"]),
    ("Search Experience", "experience", ["Search", "Site Search", "Find"]),
    ("Navigation Pattern", "navigation", ["Main Menu", "Primary Navigation", "Header Navigation"]),
    ("Download Workflow", "workflow", ["Download", "File Download", "Get the PDF"]),
    ("Mobile Experience Gap", "observation_signal", ["mobile stress", "mobile viewport", "dense homepage mobile"]),
    ("SEO Metadata Gap", "observation_signal", ["seo weak", "meta description", "template metadata"]),
    ("Accessibility Gap", "observation_signal", ["accessibility", "a11y", "accessible components"]),
    ("Performance Gap", "observation_signal", ["performance", "lighthouse", "third-party assets"]),
    ("Calculator Opportunity", "observation_signal", ["no clear first-class limiting-height calculator", "calculator opportunity", "calculator ux gap", "weak calculator experience", "Calculators", "calculator maturity"]),
]
# Entity types that are never mapped.
SKIP_TYPES = [
    "Company", "Industry", "Website", "Page", "Audience", "Technology", "CMS", "CandidatePattern", "Product",
    "Integration", "ImplementationDependency", "Feature", "DesignPattern", "ContentPattern",
]
# Concepts an entity type suggests, in order.
TYPE_HINTS = {
    "Calculator": ["canon_engineering-calculator", "canon_limiting-height-tool"],
    "ProductSelector": ["canon_product-selector"],
    "SubmittalWorkflow": ["canon_submittal-workflow"],
    "TechnicalResource": ["canon_technical-resources", "canon_document-center"],
    "ProductFamily": ["canon_product-family"],
    "Product": ["canon_product-detail", "canon_product-catalog"],
    "Document": ["canon_document-center", "canon_product-data-sheet", "canon_installation-guide", "canon_specification",
                 "canon_cad-bim-resource", "canon_code-report", "canon_engineering-table"],
    "DocumentType": ["canon_product-data-sheet", "canon_specification", "canon_cad-bim-resource", "canon_engineering-table"],
    "NavigationPattern": ["canon_navigation-pattern"],
    "Form": ["canon_contact-rep-locator", "canon_download-workflow"],
    "EngineeringWorkflow": ["canon_engineering-calculator", "canon_submittal-workflow"],
    "ProcessIssue": ["canon_submittal-workflow", "canon_engineering-calculator", "canon_download-workflow", "canon_calculator-opportunity"],
    "DigitalOpportunity": ["canon_calculator-opportunity", "canon_product-catalog", "canon_search-experience", "canon_document-center", "canon_submittal-workflow"],
    "UxIssue": ["canon_mobile-experience-gap", "canon_seo-metadata-gap", "canon_accessibility-gap", "canon_performance-gap",
                "canon_search-experience", "canon_navigation-pattern"],
    "AccessibilityIssue": ["canon_accessibility-gap"],
    "SeoIssue": ["canon_seo-metadata-gap"],
    "PerformanceIssue": ["canon_performance-gap"],
}
# What a type adds to or takes from the confidence of a concept.
TYPE_BONUS = {
    "Calculator": {"canon_engineering-calculator": 0.08, "canon_limiting-height-tool": 0.06, "canon_calculator-opportunity": -0.15},
    "SubmittalWorkflow": {"canon_submittal-workflow": 0.1},
    "TechnicalResource": {"canon_document-center": 0.08, "canon_technical-resources": 0.08},
    "ProductFamily": {"canon_product-family": 0.12},
    "Document": {"canon_product-family": -0.2, "canon_product-detail": -0.1, "canon_engineering-table": 0.05,
                 "canon_product-data-sheet": 0.05, "canon_document-center": 0.03},
    "DigitalOpportunity": {"canon_calculator-opportunity": 0.08, "canon_engineering-calculator": -0.05},
}
THRESHOLD, MARGIN = 0.72, 0.06
PIECE = 6  # shortest alias that may match inside a label
CONCEPT_DDL = (
    "id string, seq int, canonical_name string, concept_type string, aliases array<string>, "
    "company_specific_aliases map<string,array<string>>, status string, reviewed_by string"
)


def seed_concepts(spark: SparkSession) -> DataFrame:
    rows = [(f"canon_{key_of(n)}", i, n, t, a, {}, "accepted", "platform") for i, (n, t, a) in enumerate(SEED_CONCEPTS)]
    return spark.createDataFrame(rows, CONCEPT_DDL)


def refresh_registry(seeds: DataFrame, existing: DataFrame) -> DataFrame:
    """The seeds plus existing concepts a person has reviewed and the seeds lack."""
    human = existing.filter("reviewed_by is not null and reviewed_by not in ('', 'platform')")
    return seeds.unionByName(human.join(seeds.select("id"), "id", "left_anti"))


def alias_index(concepts: DataFrame) -> DataFrame:
    """concept_id, alias, lexical_key, source, company_slug, seq of live concepts.

    ``seq`` orders the aliases: by concept, its general ones first, then by place.
    """
    none = F.lit(None).cast("string")
    item = lambda alias, source, slug, own, n: F.struct(
        alias.alias("alias"), F.lit(source).alias("source"), slug.alias("company_slug"), F.lit(own).alias("own"), n.alias("n")
    )
    own = F.flatten(
        F.transform(
            F.map_entries(F.coalesce("company_specific_aliases", F.create_map().cast("map<string,array<string>>"))),
            lambda e: F.transform(e["value"], lambda a, i: item(a, "company_specific", e["key"], 1, i)),
        )
    )
    entries = F.concat(
        F.array(item(F.col("canonical_name"), "canonical_name", none, 0, F.lit(0))),
        F.transform("aliases", lambda a, i: item(a, "alias", none, 0, i + 1)),
        own,
    )
    df = concepts.filter("status <> 'deprecated'").select("id", "seq", F.explode(entries).alias("e"))
    return df.select(
        F.col("id").alias("concept_id"), "e.alias", normalize_key("e.alias").alias("lexical_key"), "e.source", "e.company_slug",
        F.struct(F.col("seq").cast("bigint").alias("concept"), F.col("e.own").alias("own"), F.col("e.n").alias("n")).alias("seq"),
    )


def _place(concept: Column) -> Column:
    return F.struct(concept.cast("bigint").alias("concept"), F.lit(0).alias("own"), F.lit(0).alias("n"))


def _order(rule: int, place: Column, step: int = 0) -> Column:
    """Which of two hits came first: by the rule's band, the alias's place, the step."""
    return F.struct(F.lit(rule).alias("rule"), place.alias("place"), F.lit(step).alias("step"))


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, "-"), lambda t: F.length(t) > 2))


def concept_tokens(concepts: DataFrame) -> DataFrame:
    """concept_id, token, size, seq, status over the name and the general aliases."""
    words = F.concat(F.array("canonical_name"), F.col("aliases"))
    df = concepts.select("id", "seq", "status", F.explode(words).alias("a"))
    df = df.select("id", "seq", "status", F.explode(_tokens(normalize_key("a"))).alias("token")).distinct()
    sizes = df.groupBy("id").agg(F.count("*").alias("size"))
    return df.join(sizes, "id").select(F.col("id").alias("concept_id"), F.col("seq").alias("concept_seq"), "status", "token", "size")


def mapped_entities(store: dict) -> DataFrame:
    """entity_id, project, type, name, normalized_key, obs_key, seq of mappable entities."""
    obs = store["entity_props"].filter("prop = 'observationKey'").select("entity_id", F.col("value").alias("obs_key"))
    e = store["entities"].filter(~F.col("type").isin(SKIP_TYPES)).select(
        F.col("id").alias("entity_id"), "type", "name", "normalized_key", "seq"
    )
    projects = store["entity_links"].filter("kind = 'project'").select("entity_id", F.col("value").alias("project"))
    return e.join(obs, "entity_id", "left").join(projects, "entity_id")


def _shapes(entities: DataFrame, ascii_only: bool) -> DataFrame:
    """Distinct label shapes with their lexical keys."""
    d = entities.select("shape", "type", "name", "normalized_key", "obs_key").distinct()
    blank_null = lambda c: F.when(c != "", c)
    words = F.concat_ws(" ", blank_null(F.col("name")), blank_null(F.col("obs_key")), blank_null(F.col("normalized_key")))
    return d.select(
        "shape", "type", normalize_key("name", ascii_only).alias("label_key"),
        normalize_key(words, ascii_only).alias("lexical"), normalize_key(txt("obs_key"), ascii_only).alias("obs"),
    )


def _contained(shapes: DataFrame, text: str, index: DataFrame, confidence: float, order: int, note: str) -> DataFrame:
    """Aliases of six or more characters inside a key: join on the alias's first six
    characters against all six-character pieces of the key, then check the whole alias."""
    long = index.filter(F.length("lexical_key") >= PIECE).withColumn("piece", F.substring("lexical_key", 1, PIECE))
    key = F.col(text)
    keys = shapes.filter(F.length(key) >= PIECE).select(key.alias("k")).distinct()
    starts = F.sequence(F.lit(1), F.length("k") - (PIECE - 1))
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("k"), i, F.lit(PIECE))))
    hit = keys.select("k", F.explode(pieces).alias("piece")).join(long, "piece").filter(
        F.contains(F.col("k"), F.col("lexical_key"))
    )
    return shapes.select("shape", key.alias("k")).join(hit, "k").select(
        "shape", "company_slug", "concept_id", F.lit(confidence).alias("confidence"), F.lit("semantic").alias("method"),
        _order(0, F.col("seq"), order).alias("ord"),
        F.concat(F.lit(note + ' registered alias "'), F.col("alias"), F.lit('"')).alias("notes"),
    )


def _pair_case(table: dict[str, dict[str, float]], default: float) -> Column:
    out = F.lit(default)
    for etype, deltas in table.items():
        for concept, value in deltas.items():
            out = F.when((F.col("type") == etype) & (F.col("concept_id") == concept), F.lit(value)).otherwise(out)
    return out


def score_mappings(entities: DataFrame, concepts: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Scored concepts per entity and project, best rule per concept, type bonus applied.

    ``entities`` as from `mapped_entities`. Columns: entity_id, project, type, concept_id,
    confidence, method, notes, first_order.
    """
    e = entities.filter(~F.col("type").isin(SKIP_TYPES)).withColumn(
        "shape", digest("type", "name", "normalized_key", "obs_key", size=32)
    )
    shapes = _shapes(e, ascii_only)
    index = alias_index(concepts)
    exact = (
        shapes.select("shape", F.explode(F.array_distinct(F.array("label_key", "lexical"))).alias("lexical_key"))
        .join(index, "lexical_key").select(
            "shape", "company_slug", "concept_id",
            F.when(F.col("source") == "canonical_name", 0.96).otherwise(0.9).alias("confidence"),
            F.when(F.col("source") == "canonical_name", "exact").otherwise("alias").alias("method"),
            _order(0, F.col("seq")).alias("ord"),
            F.concat(F.lit("Exact lexical match on "), F.col("source")).alias("notes"),
        )
    )
    inside = _contained(shapes, "lexical", index, 0.82, 1, "Label contains")
    inside_obs = _contained(shapes, "obs", index, 0.8, 2, "Observation key contains")
    overlap = _overlaps(shapes, concepts)
    general = exact.unionByName(inside).unionByName(inside_obs).unionByName(_hinted(shapes, overlap, concepts)).unionByName(_semantic(overlap))
    rows = e.select("entity_id", "project", "type", "shape").join(general, "shape").filter(
        F.col("company_slug").isNull() | (F.col("company_slug") == F.col("project"))
    )
    best = rows.groupBy("entity_id", "project", "type", "concept_id").agg(
        F.min_by(F.struct("confidence", "method", "notes"), F.struct(-F.col("confidence"), F.col("ord"))).alias("b"),
        F.min("ord").alias("first_order"),
    )
    delta = _pair_case(TYPE_BONUS, 0.0)
    return best.withColumn("delta", delta).select(
        "entity_id", "project", "type", "concept_id",
        F.when(F.col("delta") == 0, F.col("b.confidence")).otherwise(clip(F.col("b.confidence") + F.col("delta"), 0.0, 0.99)).alias("confidence"),
        F.col("b.method").alias("method"),
        F.when(F.col("delta") == 0, F.col("b.notes")).otherwise(
            F.concat(F.col("b.notes"), F.lit("; type_bonus="), F.format_string("%.2f", "delta"))
        ).alias("notes"),
        "first_order",
    )


def _overlaps(shapes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Token Jaccard of every (shape, concept) that shares a token."""
    t = shapes.select("shape", "type", _tokens(F.col("lexical")).alias("ts")).select(
        "shape", "type", F.size("ts").alias("n"), F.explode("ts").alias("token")
    )
    return (
        t.join(concept_tokens(concepts), "token").groupBy("shape", "type", "n", "concept_id", "concept_seq", "status", "size")
        .agg(F.count("*").alias("both"))
        .withColumn("j", F.col("both") / (F.col("n") + F.col("size") - F.col("both")))
    )


def _hinted(shapes: DataFrame, overlap: DataFrame, concepts: DataFrame) -> DataFrame:
    order = _pair_case({t: {c: float(i) for i, c in enumerate(cs)} for t, cs in TYPE_HINTS.items()}, -1.0)
    by_overlap = overlap.withColumn("h", order).filter("h >= 0 and j >= 0.25").select(
        "shape", F.lit(None).cast("string").alias("company_slug"), "concept_id",
        F.least(F.lit(0.88), F.lit(0.7) + F.col("j") * 0.25).alias("confidence"), F.lit("structural").alias("method"),
        _order(1, _place(F.col("h"))).alias("ord"),
        F.concat(F.lit("Entity type "), F.col("type"), F.lit(" + alias token overlap "), F.format_string("%.2f", "j")).alias("notes"),
    )
    lone = TYPE_HINTS["ProductSelector"][0]
    selector = shapes.filter("type = 'ProductSelector'").select("shape", F.lit(lone).alias("concept_id"))
    selector = selector.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    strong = overlap.filter("j >= 0.25").select("shape", "concept_id")
    default = selector.join(strong, ["shape", "concept_id"], "left_anti").select(
        "shape", F.lit(None).cast("string").alias("company_slug"), "concept_id", F.lit(0.78).alias("confidence"),
        F.lit("structural").alias("method"), _order(1, _place(F.lit(0))).alias("ord"),
        F.lit("Unambiguous structural type ProductSelector").alias("notes"),
    )
    return by_overlap.unionByName(default)


def _semantic(overlap: DataFrame) -> DataFrame:
    return overlap.filter("status <> 'deprecated' and j >= 0.45").select(
        "shape", F.lit(None).cast("string").alias("company_slug"), "concept_id",
        F.least(F.lit(0.86), F.lit(0.65) + F.col("j") * 0.3).alias("confidence"), F.lit("semantic").alias("method"),
        _order(2, _place(F.col("concept_seq"))).alias("ord"),
        F.concat(F.lit("Semantic token overlap "), F.format_string("%.2f", "j"), F.lit(" with registered aliases")).alias("notes"),
    )


def pick_mapping(scored: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """The best concept per entity and project; ambiguous when the second is too close."""
    w = Window.partitionBy("entity_id", "project").orderBy(F.col("confidence").desc(), "first_order", "concept_id")
    df = scored.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("confidence").over(w)).withColumn(
        "second_concept", F.lead("concept_id").over(w)
    )
    return df.filter("rn = 1").select(
        "entity_id", "project", F.col("concept_id").alias("best_concept"), "confidence", "method", "notes", "second_concept", "second",
        F.coalesce(F.abs(F.col("confidence") - F.col("second")) < margin, F.lit(False)).alias("ambiguous"),
        (F.col("confidence") < threshold).alias("below"),
    )


def normalize(entities: DataFrame, concepts: DataFrame, prior: DataFrame | None = None, rebuild: bool = False,
              threshold: float = THRESHOLD, ascii_only: bool = False) -> DataFrame:
    """One mapping row per mappable entity and project.

    Confirmed and rejected mappings of ``prior`` are kept unless ``rebuild``.
    """
    picked = pick_mapping(score_mappings(entities, concepts, ascii_only), threshold)
    names = concepts.select(F.col("id").alias("best_concept"), "canonical_name")
    seconds = concepts.select(F.col("id").alias("second_concept"), F.col("canonical_name").alias("second_name"))
    picked = picked.join(names, "best_concept", "left").join(seconds, "second_concept", "left")
    df = entities.select("entity_id", "project", "type", "name", "seq").join(picked, ["entity_id", "project"], "left")
    two = lambda c: F.format_string("%.2f", c)
    accepted = F.when(~F.col("ambiguous") & ~F.col("below"), F.col("best_concept"))
    ambiguity = F.concat(
        F.lit("Ambiguous between "), "canonical_name", F.lit(" ("), two("confidence"), F.lit(") and "), "second_name", F.lit(" ("), two("second"), F.lit(")"),
    )
    weak = F.concat(F.lit("Best candidate "), "canonical_name", F.lit(" below threshold ("), two("confidence"), F.lit(f" < {threshold})"))
    none = F.col("best_concept").isNull()
    fresh = df.select(
        F.concat(F.lit("nmap_"), stable_hash("project", "entity_id", F.coalesce("best_concept", F.lit("unmapped")))).alias("id"),
        F.col("project").alias("source_project"), F.col("entity_id").alias("source_entity_id"), F.col("name").alias("original_label"),
        normalize_key("name", ascii_only).alias("lexical_key"), accepted.alias("concept_id"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("semantic")).alias("method"),
        F.when(F.col("ambiguous"), "ambiguous").otherwise("unreviewed").alias("review_status"),
        F.when(none, "No registry-backed candidate (alias/structural/semantic)").when(F.col("ambiguous"), ambiguity)
        .when(F.col("below"), weak).otherwise("").alias("ambiguity_notes"),
        (none | F.coalesce(F.col("below") | F.col("ambiguous"), F.lit(False))).alias("below_threshold"), "seq",
    )
    if prior is None or rebuild:
        return fresh
    decided = prior.filter(F.col("review_status").isin("confirmed", "rejected"))
    keys = ["source_project", "source_entity_id"]
    labels = fresh.select(*keys, "original_label", "lexical_key", "seq")
    kept = decided.drop("original_label", "lexical_key", "seq").join(labels, keys)
    return fresh.join(decided.select(*keys), keys, "left_anti").unionByName(kept.select(*fresh.columns))


def _is_mapped() -> Column:
    return F.col("concept_id").isNotNull() & ~F.col("below_threshold")


def mapping_status(mappings: DataFrame, entity_projects: DataFrame) -> DataFrame:
    """Mapped, unmapped, ambiguous and below-threshold counts and the mean confidence.

    ``entity_projects``: entity_id, project of all entities, mappable or not.
    """
    mapped = _is_mapped()
    status = mappings.groupBy(F.col("source_project").alias("project")).agg(
        F.count_if(mapped).alias("mapped"),
        F.count_if(~mapped | (F.col("review_status") == "ambiguous")).alias("unmapped"),
        F.count_if(F.col("review_status") == "ambiguous").alias("ambiguous"),
        F.count_if("below_threshold").alias("below_threshold"),
        F.coalesce(F.round(F.avg(F.when(mapped, F.col("confidence"))), 4), F.lit(0.0)).alias("average_confidence"),
    )
    entities = entity_projects.groupBy("project").agg(F.count("*").alias("entities"))
    return entities.join(status, "project", "left").fillna(0)


def concept_coverage(mappings: DataFrame) -> DataFrame:
    return mappings.filter(_is_mapped()).groupBy(F.col("source_project").alias("project"), "concept_id").agg(F.count("*").alias("n"))


def mapping_coverage(mappings: DataFrame) -> DataFrame:
    """Mappings per project and method, and how many of them are mapped."""
    return mappings.groupBy(F.col("source_project").alias("project"), "method").agg(
        F.count("*").alias("total"), F.count_if(_is_mapped()).alias("mapped")
    )


def review_queue(mappings: DataFrame, status: str = "queue", method: str | None = None,
                 min_confidence: float | None = None, max_confidence: float | None = None) -> DataFrame:
    """Mappings for review by status (queue, below_threshold, all or a review status),
    method and confidence range."""
    c = F.col
    df = mappings
    if status == "queue":
        df = df.filter(
            (c("review_status") == "ambiguous") | (c("below_threshold") & (c("confidence") > 0))
            | ((c("review_status") == "unreviewed") & (c("confidence") > 0) & c("concept_id").isNull())
        )
    elif status == "below_threshold":
        df = df.filter("below_threshold")
    elif status != "all":
        df = df.filter(c("review_status") == status)
    if method:
        df = df.filter(c("method") == method)
    if min_confidence is not None:
        df = df.filter(c("confidence") >= min_confidence)
    if max_confidence is not None:
        df = df.filter(c("confidence") <= max_confidence)
    return df


def mapping_digest() -> Column:
    return digest(
        "id", "concept_id", "original_label", F.format_string("%.6f", "confidence"), "method", "review_status", tag="mapping"
    )


def apply_mapping_decisions(mappings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mappings after the newest human decision each.

    ``decisions``: mapping_id, decision (confirmed | rejected | unresolved), concept_id,
    reviewer, rationale, ts, decision_id.
    """
    d = latest_decisions(decisions.withColumnRenamed("concept_id", "new_concept"), "mapping_id").withColumnRenamed("mapping_id", "id")
    df = mappings.join(d, "id", "left")
    yes, no, open_ = (F.coalesce(F.col("decision") == x, F.lit(False)) for x in ("confirmed", "rejected", "unresolved"))
    reason = F.when(F.col("rationale") != "", F.col("rationale"))
    was_ambiguous = F.lower("ambiguity_notes").contains("ambiguous")
    note = (
        F.when(yes, F.coalesce(reason, F.concat(F.lit("Confirmed by "), F.col("reviewer"))))
        .when(no, F.coalesce(reason, F.lit("Rejected by reviewer")))
        .when(open_, F.coalesce(reason, F.lit("Left unresolved pending better evidence")))
        .otherwise(F.col("ambiguity_notes"))
    )
    return df.select(
        "id", "source_project", "source_entity_id", "original_label", "lexical_key",
        F.when(yes, F.col("new_concept")).otherwise(F.col("concept_id")).alias("concept_id"),
        F.when(yes, F.greatest(F.col("confidence"), F.lit(0.95))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(yes, "manually_reviewed").otherwise(F.col("method")).alias("method"),
        F.when(yes, "confirmed").when(no, "rejected").when(open_, F.when(was_ambiguous, "ambiguous").otherwise("unreviewed"))
        .otherwise(F.col("review_status")).alias("review_status"),
        note.alias("ambiguity_notes"),
        F.when(yes, False).when(no, True).otherwise(F.col("below_threshold")).alias("below_threshold"), "seq",
    )


def review_log(decisions: DataFrame, key: str, current: DataFrame | None = None) -> DataFrame:
    """The decision log with validity: only the newest decision per item is valid, and
    only while its digest matches ``current`` (key, digest)."""
    newest = decisions.groupBy(key).agg(F.max(F.struct("ts", "decision_id")).alias("m"))
    newest = newest.select(key, F.col("m.decision_id").alias("decision_id"), F.lit(True).alias("_new"))
    df = decisions.join(newest, [key, "decision_id"], "left").withColumn("superseded", F.col("_new").isNull())
    reason = F.when(F.col("superseded"), "Superseded by newer review decision")
    if current is not None:
        df = df.join(current.select(key, F.col("digest").alias("_cur")), key, "left")
        stale = F.col("_cur").isNotNull() & (F.col("artifact_digest") != F.col("_cur"))
        reason = F.coalesce(reason, F.when(stale, "Digest mismatch"))
    return df.withColumn("invalidated_reason", reason).withColumn("valid", F.col("invalidated_reason").isNull()).drop("_new", "superseded", "_cur")


def accepted_presence(mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """First accepted mapping per project and concept."""
    ok = _is_mapped() & ~F.col("review_status").isin("rejected", "ambiguous")
    return (
        mappings.filter(ok).join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
        .groupBy("source_project", "concept_id")
        .agg(F.min_by(F.struct("id", "source_entity_id", "original_label", "confidence"), F.struct("seq", "id")).alias("m"))
        .select(F.col("source_project").alias("project"), "concept_id", F.col("m.source_entity_id").alias("entity_id"),
                F.col("m.original_label").alias("label"), F.col("m.confidence").alias("confidence"))
    )


def _with_evidence(presence: DataFrame, links: DataFrame) -> DataFrame:
    """Presence is written, since its rows are far fewer than the mappings it is planned from: links are dealt only where it is large."""
    presence = settled(presence)
    backed = links.filter("kind = 'evidence'").join(
        presence.select("entity_id").distinct(), "entity_id", "left_semi"
    ).select("entity_id").distinct().withColumn("has_evidence", F.lit(True))
    return presence.join(backed, "entity_id", "left").fillna(False, ["has_evidence"])


def compare_projects(mappings: DataFrame, concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Per concept: companies that have it, shared or unique, evidence complete, ready."""
    p = _with_evidence(accepted_presence(mappings, concepts), links)
    df = p.groupBy("concept_id").agg(
        F.count("*").alias("companies"), F.bool_and("has_evidence").alias("evidence_complete"), F.min("project").alias("first_project")
    )
    return df.select(
        "concept_id", "companies", (F.col("companies") >= 2).alias("shared"), "evidence_complete",
        F.when(F.col("companies") == 1, F.col("first_project")).alias("only_project"),
        ((F.col("companies") >= 2) & F.col("evidence_complete")).alias("pattern_ready"),
    )


def unmapped_counts(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy(F.col("source_project").alias("project")).agg(
        F.count_if(F.col("concept_id").isNull() | F.col("below_threshold")).alias("unmapped")
    )


def canonical_patterns(mappings: DataFrame, concepts: DataFrame, store: dict, previous: DataFrame | None = None) -> DataFrame:
    """Candidate patterns from concepts that several independent companies have."""
    p = _with_evidence(accepted_presence(mappings, concepts), store["entity_links"])
    companies = (
        p.select("concept_id", "project").join(companies_by_project(store["entities"], store["entity_links"]), "project")
        .select("concept_id", "company_id").distinct().groupBy("concept_id").agg(F.count("*").alias("companies"))
    )
    blocking = store["conflicts"].filter("blocks").select(F.col("id").alias("value"))
    conflicts = (
        store["entity_links"].filter("kind = 'conflict'").join(blocking, "value", "left_semi")
        .join(p.select("concept_id", "entity_id"), "entity_id").select("concept_id", "value").distinct()
        .groupBy("concept_id").agg(F.count("*").alias("blocking_conflicts"))
    )
    rank = F.when(F.col("confidence") >= 0.9, 0).when(F.col("confidence") >= 0.75, 1).otherwise(2)
    df = (
        p.groupBy("concept_id").agg(
            F.count("*").alias("projects"), F.bool_and("has_evidence").alias("evidence_complete"), F.max(rank).alias("worst")
        )
        .filter("projects >= 2").join(companies.filter("companies >= 2"), "concept_id").join(conflicts, "concept_id", "left")
        .join(concepts.select(F.col("id").alias("concept_id"), "canonical_name"), "concept_id")
    )
    n = F.coalesce("blocking_conflicts", F.lit(0))
    key = normalize_key(F.concat(F.lit("canonical:"), F.col("concept_id")), ascii_only=True)
    outcome = F.when(~F.col("evidence_complete"), "incomplete").when(n > 0, "blocked").otherwise("candidate")
    out = df.select(
        candidate_pattern_id(key).alias("id"), "concept_id", F.concat(F.lit("Candidate: "), "canonical_name").alias("name"),
        key.alias("observation_key"), "projects", "companies", n.alias("blocking_conflicts"),
        F.when(F.col("worst") == 2, "low").when(F.col("worst") == 1, "medium").otherwise("high").alias("confidence_summary"),
        outcome.alias("outcome"),
        F.when(outcome == "blocked", "needs_review").otherwise("unreviewed").alias("review_status"),
    )
    if previous is None:
        return out.withColumn("is_new", F.lit(True))
    known = previous.select("id", F.lit(True).alias("_k")).distinct()
    return out.join(known, "id", "left").withColumn("is_new", F.col("_k").isNull()).drop("_k")
