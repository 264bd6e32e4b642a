"""Queries over keys, slices, the merged store and its integrity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelattice.functions import keys as K
from pagelattice.operators import history, ingest, integrity, knowledge, merge, metrics, patterns, slices
from pagelattice.plans.derived import ctes, derived, new_slice, projects, store
from pagelattice.plans.dialect import Duck, Spark
from pagelattice.plans.registry import query, table
from pagelattice import schemas
from pagelattice.session import reliable_checkpoint, shared_folder, written
from pagelattice.sources import store as io

D = Duck()
sha, key = D.sha128, D.key


def _sql(names: list[str], body: str) -> str:
    body = body.strip()
    return f"{ctes(D, names)}{', ' + body[1:] if body.startswith('+') else ' ' + body}"


# --- Keys ---------------------------------------------------------------------------
@query("entity_ids", f"""
    SELECT p_partkey, 'ent_Product_' || {sha("'Product|' || " + key("p_name || ' ' || p_brand") + " || '|project:s-1'")} AS entity_id, 'ent_DocumentType_' || {sha("'DocumentType|' || " + key('p_type') + " || '|global'")} AS global_id,
      'rel_PRODUCT_BELONGS_TO_FAMILY_' || {sha("'PRODUCT_BELONGS_TO_FAMILY|a' || CAST(p_partkey AS STRING) || '|' || p_type || '|global'")} AS rel_id,
      'ev_' || {sha("'s-1||' || p_name")} AS ev_id, 'conflict_' || {sha("p_name || '|score|1|5'")} AS conflict_id, 'cpat_' || {sha("'CandidatePattern|' || p_type")} AS pattern_id FROM part""")
def entity_ids(spark, folder):
    p = table(spark, folder, "part").withColumn("proj", F.lit("s-1"))
    return p.select(
        "p_partkey", K.entity_id("Product", K.normalize_key(F.concat_ws(" ", "p_name", "p_brand")), "proj").alias("entity_id"),
        K.entity_id("DocumentType", K.normalize_key("p_type")).alias("global_id"),
        K.relationship_id("PRODUCT_BELONGS_TO_FAMILY", F.concat(F.lit("a"), F.col("p_partkey").cast("string")), "p_type").alias("rel_id"),
        K.evidence_id("proj", F.lit(None).cast("string"), "p_name").alias("ev_id"),
        K.conflict_id("p_name", F.lit("score"), F.lit("1"), F.lit("5")).alias("conflict_id"), K.candidate_pattern_id("p_type").alias("pattern_id"),
    )


@query("document_keys", f"SELECT doc_id, {key('strip_accents(lower(text))')} AS doc_key, {key('text')} AS slug FROM documents")
def document_keys(spark, folder):
    return table(spark, folder, "documents").select("doc_id", K.normalize_key("text").alias("doc_key"), K.slugify("text").alias("slug"))


@query("observation_keys", f"SELECT p_partkey, {key("p_type || ':' || p_name || ':present'")} AS present, {key("p_type || ':' || p_brand || ':score-' || CAST(p_size AS STRING)")} AS scored FROM part")
def observation_keys(spark, folder):
    c = F.col
    return table(spark, folder, "part").select(
        "p_partkey", K.observation_key(c("p_type"), c("p_name")).alias("present"),
        K.observation_key(c("p_type"), c("p_brand"), F.concat(F.lit("score-"), c("p_size").cast("string"))).alias("scored"),
    )


# --- Slices -------------------------------------------------------------------------
def _inventories(d):
    """Inventory tables for the slice rules, by SQL both engines run."""
    key = d.key
    return {
        "i_profiles": (["d_projects"], "SELECT slug AS project_slug, name AS company_name, website_url, industry, 'Supplier ' || name || ' sells parts.' AS summary FROM d_projects"),
        "i_families": (["li_all"], "SELECT slug AS project_slug, noun AS family, min(l_partkey) AS seq FROM li_all WHERE l_returnflag = 'R' AND p_size > 5 GROUP BY slug, noun"),
        "i_products": (["li_all"], """SELECT slug AS project_slug, l_partkey AS seq, p_name || ' ' || p_brand AS name, noun AS family, p_type AS category, 'Part of size ' || CAST(p_size AS STRING) AS description,
            website_url || 'p/' || CAST(l_partkey AS STRING) AS source_url, CASE max(l_returnflag) WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence, p_size, p_type
            FROM li_all GROUP BY slug, l_partkey, p_name, p_brand, noun, p_type, p_size, website_url"""),
        "i_documents": (["li_all"], """SELECT slug AS project_slug, min(l_partkey) AS seq, p_brand || ' ' || p_type || ' sheet' AS title, website_url || 'files/' || lower(p_type) || '/' || CAST(p_size AS STRING) || '.pdf' AS href,
            'pdf' AS file_type, p_type AS document_type, website_url || lower(p_type) AS source_page_url, 'unknown' AS status, 'medium' AS confidence FROM li_all GROUP BY slug, p_brand, p_type, p_size, website_url"""),
        "i_pages": (["li_all"], """SELECT slug AS project_slug, min(l_partkey) AS seq, website_url || lower(p_type) AS url, p_type || ' parts' AS title, 'All ' || lower(p_type) || ' parts of ' || s_name AS main_text_summary, p_type
            FROM li_all GROUP BY slug, p_type, website_url, s_name"""),
        "i_maturity": (["issue_all", "d_projects"], """SELECT i.slug AS project_slug, CAST(length(p_type) AS BIGINT) AS seq, CASE p_type WHEN 'PROMO' THEN 'SEO' WHEN 'SMALL' THEN 'Submittal workflow' ELSE p_type END AS category, CAST(score AS DOUBLE) AS score,
            'Score of ' || p_type AS evidence, '' AS source_url, 'high' AS confidence, 'Improve ' || lower(p_type) AS recommendation, 'Prototype for ' || lower(p_type) AS prototype_response FROM issue_all i"""),
        "i_calculators": (["li_all"], """SELECT slug AS project_slug, min(l_partkey) AS seq, 'calc ' || p_brand AS calc_id, p_brand || ' calculator' AS name, CASE WHEN min(p_size) < 10 THEN 'conceptual' ELSE 'table_driven' END AS classification, 'Demo' AS disclaimer
            FROM li_all GROUP BY slug, p_brand"""),
    }


def _inv(spark, folder):
    extra = _inventories(Spark(folder))
    get = lambda n: derived(spark, folder, n, extra)
    products = get("i_products").select(
        "*", F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attributes"),
        F.array(F.concat(F.lit("https://cdn.suppliers.net/"), F.lower("p_type"), F.lit(".pdf"))).alias("documents"),
    )
    pages = get("i_pages").select(
        "*", F.array("title").alias("h1"), F.when(F.col("p_type") == "PROMO", F.array(F.lit("WordPress"), F.lit("Yoast SEO"))).otherwise(F.array(F.lit("Yoast SEO"))).alias("technology_indicators"),
    )
    profiles = get("i_profiles").withColumn("approved_hosts", F.array("website_url"))
    offers = get("i_profiles").select(
        "project_slug", F.lit(0).alias("seq"), F.lit("Sells parts.").alias("claim"), F.col("website_url").alias("source_url"), F.lit("high").alias("confidence"),
        F.lit("inference").alias("kind"), F.lit("seen").alias("notes"))
    return {"profiles": profiles, "offerings": offers, "audiences": offers.withColumn("claim", F.lit("Serves builders.")), "families": get("i_families"), "products": products,
            "documents": get("i_documents"), "pages": pages, "maturity": get("i_maturity"), "calculators": get("i_calculators")}


def _slice(spark, folder):
    return slices.extract_slice(_inv(spark, folder), ascii_only=True)


def _inv_sql(names: list[str], body: str) -> str:
    body = body.strip()
    return f"{ctes(D, names, _inventories(D))}{', ' + body[1:] if body.startswith('+') else ' ' + body}"


def _eid(t: str, k: str, scope: str) -> str:
    return f"'ent_{t}_' || " + sha(f"'{t}|' || {k} || '|' || {scope}")


_P = "'project:' || project_slug"
_NAV_KEY = "navigation-products-tools-tables-documents-present"
_KIND = "CASE category WHEN 'SEO' THEN 'SeoIssue' WHEN 'Submittal workflow' THEN 'ProcessIssue' ELSE 'UxIssue' END"
_ISSUE_KEY = key("category || ':' || recommendation || ':score-' || CAST(CAST(score AS BIGINT) AS STRING)")
_ENT = f"""
    SELECT project_slug, {_eid('Company', key('company_name'), _P)} AS id, 'Company' AS type, company_name AS name, 'fact' AS epistemic_class, 'shared_unreviewed' AS visibility FROM i_profiles
    UNION ALL SELECT project_slug, {_eid('Industry', key('industry'), "'global'")}, 'Industry', industry, 'fact', 'shared_unreviewed' FROM i_profiles
    UNION ALL SELECT project_slug, {_eid('Website', key('website_url'), _P)}, 'Website', website_url, 'fact', 'project_private' FROM i_profiles
    UNION ALL SELECT project_slug, {_eid('Audience', "'serves-builders'", _P)}, 'Audience', 'Serves builders.', 'inference', 'project_private' FROM i_profiles
    UNION ALL SELECT DISTINCT project_slug, {_eid('ProductFamily', 'family', _P)}, 'ProductFamily', family, 'fact', 'project_private' FROM (SELECT project_slug, family FROM i_families UNION SELECT project_slug, family FROM i_products)
    UNION ALL SELECT DISTINCT project_slug, {_eid('Product', key('name'), _P)}, 'Product', name, 'fact', 'project_private' FROM i_products
    UNION ALL SELECT project_slug, {_eid('ProductAttribute', key("name || ':size'"), _P)}, 'ProductAttribute', arg_max('size=' || CAST(p_size AS STRING), length(CAST(p_size AS STRING)) * 1000000000 - seq), 'fact', 'project_private' FROM i_products GROUP BY project_slug, name
    UNION ALL SELECT DISTINCT project_slug, {_eid('Document', key("'https://cdn.suppliers.net/' || lower(p_type) || '.pdf'"), _P)}, 'Document', lower(p_type) || '.pdf', 'fact', 'project_private' FROM i_products
    UNION ALL SELECT project_slug, {_eid('Document', key('href'), _P)}, 'Document', arg_max(title, length(title) * 1000000000 - seq), 'fact', 'project_private' FROM i_documents GROUP BY project_slug, href
    UNION ALL SELECT DISTINCT project_slug, {_eid('DocumentType', key('document_type'), "'global'")}, 'DocumentType', document_type, 'fact', 'shared_unreviewed' FROM i_documents
    UNION ALL SELECT DISTINCT project_slug, {_eid('Page', key('source_page_url'), _P)}, 'Page', source_page_url, 'fact', 'project_private' FROM i_documents
    UNION ALL SELECT DISTINCT project_slug, {_eid('Technology', "'yoast-seo'", "'global'")}, 'Technology', 'Yoast SEO', 'observation', 'shared_unreviewed' FROM i_pages
    UNION ALL SELECT DISTINCT project_slug, {_eid('Technology', "'wordpress'", "'global'")}, 'Technology', 'WordPress', 'observation', 'shared_unreviewed' FROM i_pages WHERE p_type = 'PROMO'
    UNION ALL SELECT DISTINCT project_slug, {_eid('CMS', "'wordpress'", _P)}, 'CMS', 'WordPress', 'observation', 'project_private' FROM i_pages WHERE p_type = 'PROMO'
    UNION ALL SELECT project_slug, 'ent_' || {_KIND} || '_' || {sha(_KIND + " || '|' || " + _ISSUE_KEY + " || '|' || " + _P)}, {_KIND}, category || ': score ' || CAST(CAST(score AS BIGINT) AS STRING) || '/10', 'observation', 'shared_unreviewed' FROM i_maturity WHERE score <= 5
    UNION ALL SELECT DISTINCT project_slug, {_eid('DigitalOpportunity', key("'opportunity:' || prototype_response || ':present'"), _P)}, 'DigitalOpportunity', prototype_response, 'recommendation', 'project_private' FROM i_maturity WHERE score <= 5
    UNION ALL SELECT project_slug, {_eid('Calculator', key('calc_id'), _P)}, 'Calculator', name, CASE classification WHEN 'conceptual' THEN 'recommendation' ELSE 'observation' END, 'project_private' FROM i_calculators
    UNION ALL SELECT project_slug, {_eid('NavigationPattern', "'" + _NAV_KEY + "'", _P)}, 'NavigationPattern', 'Products / Tools / Tables / Documents IA', 'observation', 'shared_unreviewed' FROM i_profiles"""
_ALL_INV = list(_inventories(D))


@query("slice_entities", _inv_sql(_ALL_INV, _ENT))
def slice_entities(spark, folder):
    return _slice(spark, folder)["entities"].select("project_slug", "id", "type", "name", "epistemic_class", "visibility")


_EV = f"""
    + raw AS (SELECT project_slug, website_url AS url, 'Company profile for ' || company_name AS excerpt, 'high' AS conf, 0 AS o FROM i_profiles
      UNION ALL SELECT project_slug, website_url, 'Sells parts.', 'high', 1 FROM i_profiles UNION ALL SELECT project_slug, website_url, 'Serves builders.', 'high', 2 FROM i_profiles
      UNION ALL SELECT project_slug, website_url, 'Product family term observed: ' || family, 'medium', 3 FROM i_families JOIN i_profiles USING (project_slug)
      UNION ALL SELECT project_slug, source_url, 'Product inventory: ' || name, confidence, 4 FROM i_products UNION ALL SELECT DISTINCT project_slug, source_page_url, 'Document: ' || title, 'medium', 5 FROM i_documents
      UNION ALL SELECT project_slug, url, main_text_summary, 'high', 6 FROM i_pages
      UNION ALL SELECT DISTINCT i_pages.project_slug, website_url, 'Technology indicator: Yoast SEO', 'medium', 7 FROM i_pages JOIN i_profiles USING (project_slug)
      UNION ALL SELECT DISTINCT i_pages.project_slug, website_url, 'Technology indicator: WordPress', 'medium', 7 FROM i_pages JOIN i_profiles USING (project_slug) WHERE p_type = 'PROMO'
      UNION ALL SELECT project_slug, website_url, evidence, 'high', 8 FROM i_maturity JOIN i_profiles USING (project_slug) WHERE score <= 5
      UNION ALL SELECT project_slug, website_url, 'Calculator requirement: ' || name || ' (' || classification || ')', 'medium', 9 FROM i_calculators JOIN i_profiles USING (project_slug)
      UNION ALL SELECT project_slug, website_url, 'Navigation themes Products/Tools/Tables/Documents observed in public IA', 'medium', 10 FROM i_profiles),
    e AS (SELECT project_slug, 'ev_' || {sha("project_slug || '|' || url || '|' || excerpt")} AS id, url AS source_url, excerpt, conf AS confidence FROM raw)
    SELECT * FROM e"""


@query("slice_evidence", _inv_sql(_ALL_INV, _EV))
def slice_evidence(spark, folder):
    return _slice(spark, folder)["evidence"].select("project_slug", "id", "source_url", "excerpt", "confidence")


@query("slice_relationships", _inv_sql(_ALL_INV, f"""
    SELECT 'COMPANY_OPERATES_IN_INDUSTRY' AS type, count(*) AS n FROM i_profiles UNION ALL SELECT 'COMPANY_HAS_WEBSITE', count(*) FROM i_profiles UNION ALL SELECT 'COMPANY_SERVES_AUDIENCE', count(*) FROM i_profiles
    UNION ALL SELECT 'COMPANY_OFFERS_PRODUCT_FAMILY', count(DISTINCT project_slug || family) FROM (SELECT project_slug, family FROM i_families UNION SELECT project_slug, family FROM i_products)
    UNION ALL SELECT 'PRODUCT_BELONGS_TO_FAMILY', count(DISTINCT project_slug || name) FROM i_products UNION ALL SELECT 'PRODUCT_HAS_ATTRIBUTE', count(DISTINCT project_slug || name) FROM i_products
    UNION ALL SELECT 'PRODUCT_HAS_DOCUMENT', count(DISTINCT project_slug || name || p_type) FROM i_products UNION ALL SELECT 'WEBSITE_CONTAINS_PAGE', count(DISTINCT project_slug || url) FROM i_pages
    UNION ALL SELECT 'PAGE_LINKS_TO_DOCUMENT', count(DISTINCT project_slug || href) FROM i_documents
    UNION ALL SELECT 'WEBSITE_USES_TECHNOLOGY', count(DISTINCT project_slug) + 2 * count(DISTINCT CASE WHEN p_type = 'PROMO' THEN project_slug END) FROM i_pages
    UNION ALL SELECT CASE {_KIND} WHEN 'SeoIssue' THEN 'PAGE_EXHIBITS_SEO_ISSUE' WHEN 'ProcessIssue' THEN 'COMPANY_HAS_PROCESS_ISSUE' ELSE 'PAGE_EXHIBITS_UX_ISSUE' END, count(*) FROM i_maturity WHERE score <= 5 GROUP BY 1
    UNION ALL SELECT 'COMPANY_HAS_DIGITAL_OPPORTUNITY', count(*) FROM i_maturity WHERE score <= 5 UNION ALL SELECT 'PROCESS_ISSUE_CREATES_OPPORTUNITY', count(*) FROM i_maturity WHERE score <= 5 AND category = 'Submittal workflow'
    UNION ALL SELECT 'COMPANY_PROVIDES_CALCULATOR', count(*) FROM i_calculators UNION ALL SELECT 'COMPANY_EXHIBITS_NAVIGATION_PATTERN', count(*) FROM i_profiles"""))
def slice_relationships(spark, folder):
    return _slice(spark, folder)["relationships"].groupBy("type").agg(F.count("*").alias("n"))


@query("slice_counts", _inv_sql(_ALL_INV, f"+ e AS ({_ENT}) SELECT project_slug, count(*) AS entities FROM e GROUP BY 1"))
def slice_counts(spark, folder):
    return slices.slice_counts(_slice(spark, folder)).select("project_slug", "entities")


@query("slice_links")
def slice_links(spark, folder):
    s = _slice(spark, folder)
    return s["entity_links"].groupBy("kind").agg(F.count("*").alias("n")).unionByName(s["evidence_links"].groupBy("kind").agg(F.count("*").alias("n"))).unionByName(
        s["relationship_links"].groupBy(F.concat(F.lit("edge_"), "kind").alias("kind")).agg(F.count("*").alias("n")))


# --- Merge --------------------------------------------------------------------------
def _first_sql(name: str, fields: str, extra: str = "") -> str:
    return _sql([f"store_{name}_old", f"{name}_new"], f"""
    + u AS (SELECT 0 AS src, '' AS p, * FROM store_{name}_old UNION ALL BY NAME SELECT 1 AS src, project_slug AS p, * EXCLUDE (project_slug) FROM {name}_new),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, p, seq) AS rn, min(src) OVER (PARTITION BY id) = 1 AS inserted, min(src) OVER (PARTITION BY id) <> max(src) OVER (PARTITION BY id) AS updated FROM u)
    SELECT {fields}, inserted, updated FROM r WHERE rn = 1""")


_VIS = "CASE WHEN src = 1 AND visibility = 'project_private' THEN 'shared_unreviewed' ELSE visibility END AS visibility"


@query("merge_entities", _first_sql("entities", f"id, type, name, {_VIS}"))
def merge_entities(spark, folder):
    return merge.merge_entities(store(spark, folder, "old")["entities"], new_slice(spark, folder)["entities"]).select("id", "type", "name", "visibility", "inserted", "updated")


@query("merge_relationships", _first_sql("relationships", f"id, type, from_id, to_id, {_VIS}"))
def merge_relationships(spark, folder):
    m = merge.merge_relationships(store(spark, folder, "old")["relationships"], new_slice(spark, folder)["relationships"])
    return m.select("id", "type", "from_id", "to_id", "visibility", "inserted", "updated")


@query("merge_evidence", _first_sql("evidence", "id, source_url, confidence, stale AND NOT updated AS stale"))
def merge_evidence(spark, folder):
    m = merge.merge_evidence(store(spark, folder, "old")["evidence"], new_slice(spark, folder)["evidence"])
    return m.select("id", "source_url", "confidence", "stale", "inserted", "updated")


def _links_sql(name: str, owner: str) -> str:
    return _sql([f"store_{name}_old", f"{name}_new"], f"""
    + u AS (SELECT 0 AS src, '' AS p, * FROM store_{name}_old UNION ALL BY NAME SELECT 1 AS src, project_slug AS p, * EXCLUDE (project_slug) FROM {name}_new),
    r AS (SELECT *, row_number() OVER (PARTITION BY {owner}, kind, value ORDER BY src, p, seq) AS rn FROM u) SELECT {owner}, kind, value, src = 1 AS inserted FROM r WHERE rn = 1""")


@query("merge_entity_links", _links_sql("entity_links", "entity_id"))
def merge_entity_links(spark, folder):
    return merge.merge_links(store(spark, folder, "old")["entity_links"], new_slice(spark, folder)["entity_links"], "entity_links").drop("seq")


@query("merge_evidence_links", _links_sql("evidence_links", "evidence_id"))
def merge_evidence_links(spark, folder):
    return merge.merge_links(store(spark, folder, "old")["evidence_links"], new_slice(spark, folder)["evidence_links"], "evidence_links").drop("seq")


@query("merge_props", _sql(["store_entity_props_old", "entity_props_new"], """
    + u AS (SELECT 0 AS src, '' AS p, * FROM store_entity_props_old UNION ALL BY NAME SELECT 1 AS src, project_slug AS p, * EXCLUDE (project_slug) FROM entity_props_new),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, type, prop ORDER BY src DESC, p DESC, seq DESC) AS rn FROM u) SELECT entity_id, type, prop, value FROM r WHERE rn = 1"""))
def merge_props(spark, folder):
    return merge.merge_props(store(spark, folder, "old")["entity_props"], new_slice(spark, folder)["entity_props"]).drop("seq")


_CONFLICT = f"""
    + b AS (SELECT issue_id, score, CASE WHEN score <= 3 THEN 'weak' WHEN score <= 5 THEN 'moderate' END AS k FROM issue_old), a AS (SELECT issue_id, score, CASE WHEN score <= 3 THEN 'weak' WHEN score <= 5 THEN 'moderate' END AS k FROM issue_new),
    cf AS (SELECT 'conflict_' || {sha("issue_id || '|score|' || CAST(b.score AS STRING) || '|' || CAST(a.score AS STRING)")} AS id, issue_id AS entity_id, 'Score conflict on ' || name || ': ' || CAST(b.score AS STRING) || ' vs ' || CAST(a.score AS STRING) AS description
      FROM b JOIN a USING (issue_id) JOIN store_entities_old ON store_entities_old.id = issue_id WHERE abs(b.score - a.score) >= 4 AND b.k IS NOT DISTINCT FROM a.k)"""


def _conflicts(spark, folder):
    return written(spark, (folder, "conflicts"), lambda: merge.score_conflicts(store(spark, folder, "old"), new_slice(spark, folder)))


@query("score_conflicts", _sql(["issue_old", "issue_new", "store_entities_old"], _CONFLICT + " SELECT * FROM cf"))
def score_conflicts(spark, folder):
    return _conflicts(spark, folder).select("id", "entity_id", "description")


@query("merge_conflicts", _sql(["issue_old", "issue_new", "store_entities_old"], _CONFLICT + " SELECT id, entity_id FROM cf"))
def merge_conflicts(spark, folder):
    found = _conflicts(spark, folder)
    known = found.filter(F.col("description").contains("PROMO"))
    return merge.merge_conflicts(known, found).select("id", "entity_id")


@query("conflict_links", _sql(["issue_old", "issue_new", "store_entities_old", "entity_links_old", "entity_links_new"], _CONFLICT + """
    SELECT DISTINCT cf.id AS conflict_id, kind, value FROM cf JOIN (SELECT entity_id, kind, value FROM entity_links_old UNION SELECT entity_id, kind, value FROM entity_links_new) USING (entity_id)"""))
def conflict_links(spark, folder):
    s, n = store(spark, folder, "old"), new_slice(spark, folder)
    return merge.conflict_links(merge.score_conflicts(s, n), s["entity_links"], n["entity_links"])


@query("stale_evidence", _sql(["store_evidence_old", "evidence_new", "d_projects"], """
    SELECT id, NOT EXISTS (SELECT 1 FROM evidence_new n WHERE n.id = o.id) AND notes <> 'Not synthetic' AS stale,
      CASE WHEN NOT EXISTS (SELECT 1 FROM evidence_new n WHERE n.id = o.id) AND notes <> 'Not synthetic' THEN 'stale' ELSE 'unreviewed' END AS review_status FROM store_evidence_old o JOIN d_projects ON slug = source_project"""))
def stale_evidence(spark, folder):
    refreshed = projects(spark, folder).filter("notes <> 'Not synthetic'").select(F.col("slug").alias("project_slug"))
    df = merge.mark_stale(store(spark, folder, "old")["evidence"], new_slice(spark, folder)["evidence"].select("id"), refreshed)
    return df.select("id", "stale", "review_status")


_GONE = "SELECT slug FROM d_projects WHERE notes = 'Synthetic fixture'"


@query("force_replace", _sql(["store_entities_all", "store_entity_links_all", "store_evidence_all", "store_relationships_all", "store_relationship_links_all", "d_projects"], f"""
    + kept AS (SELECT DISTINCT entity_id FROM store_entity_links_all WHERE kind = 'project' AND value NOT IN ({_GONE}))
    SELECT 'entities' AS part, count(*) AS n FROM store_entities_all WHERE id IN (SELECT entity_id FROM kept) UNION ALL SELECT 'evidence', count(*) FROM store_evidence_all WHERE source_project NOT IN ({_GONE})
    UNION ALL SELECT 'relationships', count(*) FROM store_relationships_all WHERE id IN (SELECT relationship_id FROM store_relationship_links_all WHERE value NOT IN ({_GONE}))
    UNION ALL SELECT 'entity_links', count(*) FROM store_entity_links_all WHERE (kind = 'project' AND value NOT IN ({_GONE})) OR (kind <> 'project' AND entity_id IN (SELECT entity_id FROM kept))"""))
def force_replace(spark, folder):
    gone = projects(spark, folder).filter("notes = 'Synthetic fixture'").select(F.col("slug").alias("project_slug"))
    out = merge.drop_contribution(store(spark, folder), gone)
    parts = [out[n].select(F.lit(n).alias("part")) for n in ("entities", "evidence", "relationships", "entity_links")]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.groupBy("part").agg(F.count("*").alias("n"))


@query("ingest_counts", _sql(["entities_new", "relationships_new", "evidence_new", "d_projects"], """
    SELECT slug AS project_slug, false AS skipped, (SELECT count(*) FROM entities_new WHERE project_slug = slug) AS entities_count, (SELECT count(*) FROM relationships_new WHERE project_slug = slug) AS relationships_count,
      (SELECT count(*) FROM evidence_new WHERE project_slug = slug) AS evidence_count FROM d_projects"""))
def ingest_counts(spark, folder):
    p = projects(spark, folder).select(F.col("slug").alias("project_slug"))
    _, result = merge.ingest(store(spark, folder, "old"), new_slice(spark, folder), p, dry_run=True)
    return result.drop("dry_run")


# Every project is ingested as of before the split; then those that do not refuse are ingested as of after it, the synthetic ones by force; then again.
_INGEST = f"""
    + act AS (SELECT slug FROM d_projects WHERE notes <> 'Not synthetic'), frc AS ({_GONE}),
    dead AS (SELECT entity_id FROM store_entity_links_old WHERE kind = 'project' GROUP BY 1 HAVING count(*) = count_if(value IN (SELECT slug FROM frc))),
    eu AS (SELECT 0 AS src, '' AS p, id, type, name, seq FROM store_entities_old WHERE id NOT IN (SELECT entity_id FROM dead) UNION ALL SELECT 1, project_slug, id, type, name, seq FROM entities_new WHERE project_slug IN (SELECT slug FROM act)),
    en AS (SELECT id, type, name FROM eu QUALIFY row_number() OVER (PARTITION BY id ORDER BY src, p, seq) = 1),
    pu AS (SELECT 0 AS src, '' AS p, * FROM store_entity_props_old WHERE entity_id NOT IN (SELECT entity_id FROM dead) UNION ALL SELECT 1, project_slug, entity_id, type, prop, value, seq FROM entity_props_new WHERE project_slug IN (SELECT slug FROM act)),
    pr AS (SELECT entity_id, prop, value FROM pu QUALIFY row_number() OVER (PARTITION BY entity_id, prop ORDER BY src DESC, p DESC, seq DESC) = 1),
    ol AS (SELECT * FROM store_entity_links_old WHERE CASE WHEN kind = 'project' THEN value NOT IN (SELECT slug FROM frc) ELSE entity_id NOT IN (SELECT entity_id FROM dead) END),
    nl AS (SELECT * FROM entity_links_new WHERE project_slug IN (SELECT slug FROM act)),
    bs AS (SELECT slug, issue_id, score, CASE WHEN score <= 3 THEN 'weak' WHEN score <= 5 THEN 'moderate' END AS k FROM issue_old WHERE slug IN (SELECT slug FROM act) AND slug NOT IN (SELECT slug FROM frc)),
    cf AS (SELECT slug, issue_id, 'conflict_' || {sha("issue_id || '|score|' || CAST(bs.score AS STRING) || '|' || CAST(a.score AS STRING)")} AS id FROM bs
      JOIN (SELECT issue_id, score, CASE WHEN score <= 3 THEN 'weak' WHEN score <= 5 THEN 'moderate' END AS k FROM issue_new) a USING (issue_id) WHERE abs(bs.score - a.score) >= 4 AND bs.k IS NOT DISTINCT FROM a.k),
    li AS (SELECT entity_id, kind, value FROM ol UNION SELECT entity_id, kind, value FROM nl UNION SELECT issue_id, 'conflict', id FROM cf),
    vu AS (SELECT 0 AS src, id, source_project FROM store_evidence_old WHERE source_project NOT IN (SELECT slug FROM frc) UNION ALL SELECT 1, id, source_project FROM evidence_new WHERE source_project IN (SELECT slug FROM act)),
    ev AS (SELECT id, source_project, max(src) = 0 AND source_project IN (SELECT slug FROM act) AS stale FROM vu GROUP BY id, source_project),
    vl AS (SELECT evidence_id, value FROM store_evidence_links_old WHERE evidence_id IN (SELECT id FROM vu WHERE src = 0) UNION SELECT evidence_id, value FROM evidence_links_new WHERE project_slug IN (SELECT slug FROM act)),
    re AS (SELECT id, type FROM store_relationships_old WHERE id IN (SELECT relationship_id FROM store_relationship_links_old WHERE value NOT IN (SELECT slug FROM frc)) UNION SELECT id, type FROM relationships_new WHERE project_slug IN (SELECT slug FROM act)),
    rn AS (SELECT slug, CASE WHEN slug IN (SELECT slug FROM frc) THEN 'replaced' ELSE 'ingested' END AS action, (SELECT count(*) FROM entities_new WHERE project_slug = slug) AS e, (SELECT count(*) FROM evidence_new WHERE project_slug = slug) AS v,
      (SELECT count(*) FROM cf WHERE cf.slug = act.slug) AS c, (SELECT count(*) FROM ev WHERE stale AND source_project = act.slug) AS s FROM act)
    SELECT 'entity' AS part, id, name AS detail FROM en UNION ALL SELECT 'property', entity_id || ' ' || prop, value FROM pr UNION ALL SELECT 'link', entity_id || ' ' || kind, value FROM li
    UNION ALL SELECT 'evidence', id, CASE WHEN stale THEN 'stale' ELSE 'unreviewed' END FROM ev UNION ALL SELECT 'evidence link', evidence_id, value FROM vl UNION ALL SELECT 'relationship', id, type FROM re
    UNION ALL SELECT 'conflict', id, issue_id FROM cf UNION ALL SELECT 'conflict link', cf.id, li.kind || ' ' || li.value FROM cf JOIN (SELECT entity_id, kind, value FROM ol UNION SELECT entity_id, kind, value FROM nl) li ON entity_id = issue_id WHERE li.kind IN ('project', 'evidence')
    UNION ALL SELECT 'first run', slug, 'ingested' FROM d_projects UNION ALL SELECT 'second run', slug, concat_ws(' ', action, e, v, c, s) FROM rn UNION ALL SELECT 'third run', slug, 'skipped' FROM act"""


@query("ingest_store", _sql(["d_projects", "issue_old", "issue_new", *[f"store_{n}_old" for n in ("entities", "entity_props", "entity_links", "relationships", "relationship_links", "evidence", "evidence_links")],
                             *[f"{n}_new" for n in ("entities", "entity_props", "entity_links", "relationships", "evidence", "evidence_links")]], _INGEST))
def ingest_store(spark, folder):
    every = projects(spark, folder).select(F.col("slug").alias("project_slug"), "notes")
    some, forced = every.filter("notes <> 'Not synthetic'"), every.filter("notes = 'Synthetic fixture'")
    graph = ingest.StoredGraph(f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", buckets=16)
    old, new = new_slice(spark, folder, "old"), new_slice(spark, folder)
    runs = [ingest.ingest(spark, graph, old, every), ingest.ingest(spark, graph, new, some, force=forced), ingest.ingest(spark, graph, new, some)]
    told = F.concat_ws(" ", "action", "entities_count", "evidence_count", "conflicts_count", "stale_marked")
    g = ingest.read_graph(spark, graph, new)
    row = lambda name, part, of, detail: g[name].select(F.lit(part).alias("part"), of.alias("id"), detail.alias("detail"))
    c = F.col
    parts = [
        row("entities", "entity", c("id"), c("name")), row("entity_props", "property", F.concat_ws(" ", "entity_id", "prop"), c("value")),
        row("entity_links", "link", F.concat_ws(" ", "entity_id", "kind"), c("value")), row("evidence", "evidence", c("id"), c("review_status")),
        row("evidence_links", "evidence link", c("evidence_id"), c("value")), row("relationships", "relationship", c("id"), c("type")),
        row("conflicts", "conflict", c("id"), c("entity_id")), row("conflict_links", "conflict link", c("conflict_id"), F.concat_ws(" ", "kind", "value")),
        *[r.select(F.lit(f"{n} run"), "project_slug", told if n == "second" else c("action")) for n, r in zip(("first", "second", "third"), runs)],
    ]
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    return df


@query("registry_upsert", """SELECT c_custkey AS id, coalesce(o.status, c_mktsegment) AS status, c_name AS name FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status FROM orders GROUP BY 1) o ON o_custkey = c_custkey
    UNION ALL SELECT o_custkey, max(o_orderstatus), NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def registry_upsert(spark, folder):
    base = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("name"))
    delta = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderstatus").alias("status"))
    return merge.upsert_by_key(base, delta, ["id"])


def drawn_sql(items: str) -> str:
    """The same draw in SQL: (id, event_id, ts, event_type)."""
    one = lambda at: f"CAST('0x' || substr(sha256(id), {at}, 7) AS BIGINT) % (SELECT count(*) FROM events)"
    return f"SELECT DISTINCT id, event_id, ts, event_type FROM (SELECT id, {one(1)} AS event_id FROM {items} UNION SELECT id, {one(8)} FROM {items}) JOIN events USING (event_id)"


# --- Patterns -----------------------------------------------------------------------
def _conflicted(spark, folder):
    """The whole store with the conflicts of the split."""
    s = store(spark, folder)
    s["conflicts"] = _conflicts(spark, folder)
    s["entity_links"] = s["entity_links"].unionByName(merge.conflict_entity_links(s["conflicts"]))
    return s


_PATTERN = _CONFLICT + """, obs AS (SELECT p.entity_id, p.value AS k, e.name, e.seq FROM store_entity_props_all p JOIN store_entities_all e ON e.id = p.entity_id WHERE p.prop = 'observationKey' AND e.epistemic_class = 'observation'),
    pr AS (SELECT k, count(DISTINCT value) AS projects FROM obs JOIN store_entity_links_all USING (entity_id) WHERE kind = 'project' GROUP BY k),
    ev AS (SELECT k, count(DISTINCT value) AS evidence_count FROM obs JOIN store_entity_links_all USING (entity_id) WHERE kind = 'evidence' GROUP BY k),
    bl AS (SELECT k, count(*) AS blocking_conflicts FROM obs JOIN cf USING (entity_id) GROUP BY k),
    fe AS (SELECT DISTINCT ON (obs.entity_id) obs.entity_id, k, value AS ev FROM obs JOIN store_entity_links_all l USING (entity_id) WHERE kind = 'evidence' ORDER BY obs.entity_id, l.seq, value),
    ws AS (SELECT k, max(CASE confidence WHEN 'low' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS w FROM fe JOIN store_evidence_all ON store_evidence_all.id = ev GROUP BY k),
    pt AS (SELECT 'cpat_' || """ + sha("'CandidatePattern|' || k") + """ AS id, k AS observation_key, projects, projects AS companies, coalesce(evidence_count, 0) AS evidence_count, coalesce(blocking_conflicts, 0) AS blocking_conflicts,
      CASE w WHEN 2 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence_summary, coalesce(blocking_conflicts, 0) > 0 AS blocked, CASE WHEN coalesce(blocking_conflicts, 0) > 0 THEN 'needs_review' ELSE 'unreviewed' END AS review_status
      FROM pr LEFT JOIN ev USING (k) LEFT JOIN bl USING (k) LEFT JOIN ws USING (k) WHERE projects >= 2)"""
_PATTERN_NEEDS = ["issue_old", "issue_new", "store_entities_old", "store_entity_props_all", "store_entities_all", "store_entity_links_all", "store_evidence_all"]


def _patterns(spark, folder):
    return written(spark, (folder, "patterns"), lambda: patterns.candidate_patterns(_conflicted(spark, folder)))


@query("candidate_patterns", _sql(_PATTERN_NEEDS, _PATTERN + " SELECT * FROM pt"))
def candidate_patterns(spark, folder):
    return _patterns(spark, folder).drop("name", "status", "label", "is_new")


@query("pattern_counters", _sql(_PATTERN_NEEDS, _PATTERN + " SELECT count_if(NOT blocked) AS created, count_if(blocked) AS blocked FROM pt"))
def pattern_counters(spark, folder):
    return patterns.pattern_counters(_patterns(spark, folder))


@query("inverted_index", _sql(["store_entities_all", "store_entity_links_all", "store_relationships_all", "store_evidence_all"], """
    SELECT 'by_project' AS index_name, value AS key, entity_id AS id FROM store_entity_links_all WHERE kind = 'project'
    UNION ALL SELECT * FROM (SELECT 'by_company', normalized_key, id FROM store_entities_all WHERE type = 'Company' UNION SELECT 'by_company', value, id FROM store_entities_all JOIN store_entity_links_all ON id = entity_id WHERE type = 'Company' AND kind = 'project')
    UNION ALL SELECT 'by_industry', normalized_key, id FROM store_entities_all WHERE type = 'Industry' UNION ALL SELECT 'by_entity_type', type, id FROM store_entities_all
    UNION ALL SELECT 'by_relationship_type', type, id FROM store_relationships_all UNION ALL SELECT 'by_evidence_status', CASE WHEN stale THEN 'stale' ELSE review_status END, id FROM store_evidence_all"""))
def inverted_index(spark, folder):
    return patterns.inverted_index(store(spark, folder))


@query("pattern_decisions", _sql(_PATTERN_NEEDS, _PATTERN + f""", l AS (SELECT DISTINCT ON (id) id, CASE event_type WHEN 'purchase' THEN 'promote' ELSE 'reject' END AS decision FROM ({drawn_sql('pt')}) WHERE event_type IN ('purchase', 'error') ORDER BY id, ts DESC, event_id DESC)
    SELECT pt.id, CASE WHEN decision = 'promote' AND NOT blocked THEN 'promoted' WHEN decision = 'promote' THEN 'refused' WHEN decision = 'reject' THEN 'rejected' ELSE 'none' END AS outcome,
      CASE WHEN decision = 'promote' AND NOT blocked THEN 'approved' WHEN decision = 'reject' THEN 'rejected' ELSE review_status END AS review_status FROM pt LEFT JOIN l USING (id)"""))
def pattern_decisions(spark, folder):
    pt = _patterns(spark, folder)
    return patterns.apply_pattern_decisions(pt, _decisions(spark, folder, pt, "pattern_id", {"purchase": "promote", "error": "reject"})).select("id", "outcome", "review_status")


# Event types by which a pattern is found in each of three runs, one after another: so some are kept, some dropped, some return.
_RUNS = [("2024-01-01", ("view", "click", "signup", "error")), ("2024-02-01", ("view", "click", "purchase")), ("2024-03-01", ("signup", "purchase", "error"))]
_RUN_SQL = _PATTERN + ", dr AS (" + drawn_sql("pt") + "), ru AS (" + " UNION ".join(
    f"SELECT id, {n} AS r, '{at}' AS day FROM dr WHERE event_type IN ({', '.join(repr(k) for k in kinds)})" for n, (at, kinds) in enumerate(_RUNS, 1)) + ")"


def _runs(spark, folder):
    """Time and merged history of each run."""
    pt = _patterns(spark, folder)
    kept = pt.drop("is_new")
    past, out = history.empty_history(kept), []
    for at, kinds in _RUNS:
        found = _decisions(spark, folder, pt, "pattern_id", {k: k for k in kinds}).select(F.col("pattern_id").alias("id")).distinct()
        past = reliable_checkpoint(history.merge_run(past, kept.join(found, "id", "left_semi"), at))
        out.append((at, past))
    return out


@query("pattern_history", _sql(_PATTERN_NEEDS, _RUN_SQL + """, i AS (SELECT *, r - row_number() OVER (PARTITION BY id ORDER BY r) AS g, min(day) OVER (PARTITION BY id) AS created_at FROM ru),
    s AS (SELECT id, created_at, min(day) AS opened_at, max(day) AS updated_at, max(r) AS r FROM i GROUP BY id, g, created_at)
    SELECT id, observation_key, blocked, created_at, opened_at, updated_at, CASE r WHEN 1 THEN '2024-02-01' WHEN 2 THEN '2024-03-01' END AS closed_at,
      CASE WHEN r < 2 THEN 'past' WHEN r = 2 THEN 'dropped' WHEN opened_at < '2024-03-01' THEN 'kept' WHEN created_at < '2024-03-01' THEN 'returned' ELSE 'created' END AS action
    FROM s JOIN pt USING (id)"""))
def pattern_history(spark, folder):
    return _runs(spark, folder)[-1][1].select("id", "observation_key", "blocked", *history.TIMES, "action")


_DECIDED = """, de AS (SELECT DISTINCT ON (id) id, CASE event_type WHEN 'purchase' THEN 'promote' ELSE 'reject' END AS decision, 'user-' || CAST(user_id AS STRING) AS reviewer
      FROM dr JOIN (SELECT event_id, user_id FROM events) USING (event_id) WHERE event_type IN ('purchase', 'error') ORDER BY id, ts DESC, event_id DESC),
    ou AS (SELECT ru.id, de.reviewer, CASE decision WHEN 'promote' THEN 'promoted' ELSE 'rejected' END AS outcome FROM ru JOIN pt USING (id) JOIN de ON de.id = ru.id WHERE r = 3 AND (decision = 'reject' OR NOT blocked))"""


def _decided(spark, folder, merged):
    found = history.found_in_run(merged)
    return patterns.apply_pattern_decisions(found, _decisions(spark, folder, found, "pattern_id", {"purchase": "promote", "error": "reject"}))


@query("pattern_audit", _sql(_PATTERN_NEEDS, _RUN_SQL + _DECIDED + """
    SELECT day AS "at", CASE WHEN blocked THEN 'candidate_blocked' ELSE 'candidate_created' END AS action, 'system' AS actor, id AS pattern_id,
      CASE WHEN blocked THEN 'Conflicting evidence blocks automatic candidate pattern creation' ELSE 'Same normalized observation in ' || CAST(projects AS STRING) || ' projects / ' || CAST(companies AS STRING) || ' companies' END AS reason
    FROM ru JOIN pt USING (id) WHERE blocked OR day = (SELECT min(day) FROM ru f WHERE f.id = pt.id)
    UNION ALL SELECT '2024-03-01', outcome, reviewer, id, '' FROM ou"""))
def pattern_audit(spark, folder):
    runs = _runs(spark, folder)
    none = _decided(spark, folder, runs[0][1]).limit(0)
    logs = [patterns.audit_log(none, history.found_in_run(m), at) for at, m in runs[:-1]]
    at, last = runs[-1]
    df = patterns.audit_log(_decided(spark, folder, last), history.found_in_run(last), at)
    for log in logs:
        df = df.unionByName(log)
    return df


@query("approved_patterns", _sql(_PATTERN_NEEDS, _RUN_SQL + _DECIDED + f""", nm AS (SELECT k AS observation_key, arg_min(name, (seq, entity_id)) AS name FROM obs GROUP BY k)
    SELECT 'ent_DesignPattern_' || {sha("'DesignPattern|' || " + key('observation_key') + " || '|global'")} AS id, 'DesignPattern' AS type, 'Approved pattern: ' || name AS name, observation_key AS normalized_key,
      'reusable_pattern' AS epistemic_class, 'industry_approved' AS visibility, 'approved' AS review_status, CAST(0 AS BIGINT) AS seq FROM ou JOIN pt USING (id) JOIN nm USING (observation_key) WHERE outcome = 'promoted'"""))
def approved_patterns(spark, folder):
    return patterns.approved_entities(_decided(spark, folder, _runs(spark, folder)[-1][1]))


def _decisions(spark, folder, items, key_name, kinds, id_col="id"):
    """Decisions made of events: every item draws two events by its hash, and an event
    of one of the given kinds is a decision on it."""
    kind = F.lit(None).cast("string")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    events = table(spark, folder, "events")
    total = events.agg(F.count("*")).scalar()
    draw = lambda at: F.conv(F.substring(F.sha2(F.col(id_col), 256), at, 7), 16, 10).cast("bigint") % total
    drawn = items.select(F.col(id_col).alias(key_name), F.explode(F.array_distinct(F.array(draw(1), draw(8)))).alias("event_id"))
    return events.filter(F.col("event_type").isin(list(kinds))).join(drawn, "event_id").select(
        key_name, "ts", F.col("event_id").alias("decision_id"), kind.alias("decision"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("reviewer"), F.lit("").alias("reason"))


# --- Queries ------------------------------------------------------------------------
@query("knowledge_company", _sql(["store_entities_all", "store_entity_links_all"], """
    + c AS (SELECT id, 0 AS step, seq FROM store_entities_all WHERE type = 'Company' AND normalized_key = 'supplier-000000001' UNION SELECT e.id, 1, e.seq FROM store_entities_all e JOIN store_entity_links_all ON e.id = entity_id WHERE kind = 'project' AND value = 'Supplier#000000001')
    SELECT e.id, e.type, e.name FROM store_entities_all e JOIN c USING (id)"""))
def knowledge_company(spark, folder):
    return knowledge.query(store(spark, folder), company="Supplier#000000001")["entities"].select("id", "type", "name")


@query("knowledge_industry", _sql(["store_entities_all", "store_entity_props_all", "store_relationships_all"], """
    + i AS (SELECT id FROM store_entities_all WHERE type = 'Industry' AND contains(normalized_key, 'natio') UNION SELECT entity_id FROM store_entity_props_all WHERE prop = 'industry' AND contains(lower(value), 'natio')),
    a AS (SELECT id, min(step) AS step FROM (SELECT id, 2 AS step FROM i UNION ALL SELECT from_id, 3 FROM store_relationships_all WHERE type = 'COMPANY_OPERATES_IN_INDUSTRY' AND to_id IN (SELECT id FROM i)) GROUP BY 1)
    SELECT e.id, e.type, e.name FROM store_entities_all e JOIN a USING (id)"""))
def knowledge_industry(spark, folder):
    return knowledge.query(store(spark, folder), industry="natio")["entities"].select("id", "type", "name")


@query("knowledge_type_project", _sql(["store_entities_all", "store_entity_links_all"], """
    SELECT e.id, e.type, e.name FROM store_entities_all e JOIN store_entity_links_all ON e.id = entity_id WHERE kind = 'project' AND value = 's-3' AND type = 'Product'"""))
def knowledge_type_project(spark, folder):
    return knowledge.query(store(spark, folder), entity_type="Product", project="s-3")["entities"].select("id", "type", "name")


@query("knowledge_relationship", _sql(["store_relationships_all"], "SELECT id, from_id, to_id FROM store_relationships_all WHERE type = 'COMPANY_HAS_PROCESS_ISSUE'"))
def knowledge_relationship(spark, folder):
    return knowledge.query(store(spark, folder), relationship_type="COMPANY_HAS_PROCESS_ISSUE")["relationships"].select("id", "from_id", "to_id")


@query("knowledge_evidence", _sql(["store_evidence_all", "store_evidence_links_all", "store_entities_all"], """
    + top AS (SELECT id FROM store_entities_all WHERE type = 'Product')
    SELECT id, source_url FROM store_evidence_all WHERE id IN (SELECT evidence_id FROM store_evidence_links_all WHERE value IN (SELECT id FROM top))"""))
def knowledge_evidence(spark, folder):
    return knowledge.query(store(spark, folder), entity_type="Product")["evidence"].select("id", "source_url")


@query("knowledge_evidence_status", _sql(["store_evidence_all"], "SELECT id, confidence FROM store_evidence_all WHERE review_status = 'unreviewed'"))
def knowledge_evidence_status(spark, folder):
    return knowledge.query(store(spark, folder), evidence_status="unreviewed")["evidence"].select("id", "confidence")


@query("entity_evidence", _sql(["store_entity_links_all", "store_evidence_all"], """
    SELECT entity_id, count(*) AS evidence, round(avg(reliability_score) + 1e-9, 6) AS reliability FROM store_entity_links_all JOIN store_evidence_all ON value = id WHERE kind = 'evidence' GROUP BY 1"""))
def entity_evidence(spark, folder):
    s = store(spark, folder)
    df = knowledge.entity_evidence(s["entities"], s["entity_links"], s["evidence"])
    return df.groupBy("entity_id").agg(F.count("*").alias("evidence"), F.round(F.avg("reliability_score") + 1e-9, 6).alias("reliability"))


_HITS = """h AS (SELECT entity_id, CASE WHEN min(confidence) = max(confidence) THEN min(confidence) ELSE 'mixed' END AS confidence, count(*) AS evidence_count, count(DISTINCT source_url) AS url_count
      FROM store_entity_links_all JOIN store_evidence_all v ON value = v.id WHERE kind = 'evidence' GROUP BY 1),
    hit AS (SELECT e.id AS entity_id, e.name, e.type, e.epistemic_class AS classification, coalesce(confidence, 'none') AS confidence, coalesce(evidence_count, 0) AS evidence_count, coalesce(url_count, 0) AS url_count, e.seq FROM store_entities_all e LEFT JOIN h ON h.entity_id = e.id)"""


@query("entity_hits", _sql(["store_entities_all", "store_entity_links_all", "store_evidence_all"], "+ " + _HITS + " SELECT entity_id, name, type, classification, confidence, evidence_count, url_count FROM hit"))
def entity_hits(spark, folder):
    s = store(spark, folder)
    return knowledge.entity_hits(s["entities"], s["entity_links"], s["evidence"])


@query("standard_questions", _sql(["store_entities_all", "store_entity_links_all", "store_evidence_all"], "+ " + _HITS + """,
    q AS (SELECT 'families' AS question, entity_id, 0 AS g FROM hit WHERE type = 'ProductFamily' UNION ALL SELECT 'document_types', entity_id, 0 FROM hit WHERE type = 'DocumentType'
      UNION ALL SELECT 'task_pages', entity_id, 0 FROM hit WHERE type = 'Page' AND regexp_matches(name, '(?i)product|catalog|distributor|contact|document|table|tool')
      UNION ALL SELECT 'underserved_tasks', entity_id, CASE WHEN type = 'UxIssue' THEN 1 ELSE 0 END FROM hit WHERE type = 'ProcessIssue' OR (type = 'UxIssue' AND regexp_matches(name, '(?i)calculator|submittal|document|product discovery'))
      UNION ALL SELECT 'calculators', entity_id, 0 FROM hit WHERE type = 'Calculator' UNION ALL SELECT 'recommended_calculators', entity_id, 0 FROM hit WHERE type = 'Calculator' AND classification = 'recommendation'
      UNION ALL SELECT 'submittals', entity_id, 0 FROM hit WHERE type = 'SubmittalWorkflow' OR regexp_matches(name, '(?i)submittal') UNION ALL SELECT 'process_issues', entity_id, 0 FROM hit WHERE type = 'ProcessIssue'
      UNION ALL SELECT 'opportunities', entity_id, 0 FROM hit WHERE type = 'DigitalOpportunity' UNION ALL SELECT 'entities_without_source', entity_id, 0 FROM hit WHERE url_count = 0),
    a AS (SELECT question, l.value AS project, entity_id AS subject_id, name, type, classification, confidence, CASE WHEN type = 'UxIssue' THEN 1 ELSE 0 END * (question <> 'entities_without_source')::INT AS g, hit.seq FROM q JOIN hit USING (entity_id) JOIN store_entity_links_all l USING (entity_id) WHERE l.kind = 'project'
      UNION ALL SELECT 'low_confidence_evidence', source_project, id, excerpt, 'Evidence', epistemic_class, confidence, 0, seq FROM store_evidence_all WHERE confidence = 'low'),
    r AS (SELECT *, row_number() OVER (PARTITION BY question, project ORDER BY g, seq, subject_id) AS rn FROM a)
    SELECT question, project, subject_id, name, type, classification, confidence FROM r"""))
def standard_questions(spark, folder):
    return knowledge.standard_questions(store(spark, folder))


# --- Integrity ----------------------------------------------------------------------
_STORE = ["store_entities_all", "store_entity_props_all", "store_entity_links_all", "store_relationships_all", "store_evidence_all", "store_evidence_links_all"]
_ISSUES = """+ iss AS (
    SELECT 'orphan-rel-' || id AS issue_id, 'critical' AS severity, 'missing_endpoints' AS category FROM store_relationships_all WHERE from_id NOT IN (SELECT id FROM store_entities_all) OR to_id NOT IN (SELECT id FROM store_entities_all)
    UNION ALL SELECT 'orphan-ent-' || id, 'medium', 'orphan_entities' FROM store_entities_all WHERE id NOT IN (SELECT from_id FROM store_relationships_all UNION SELECT to_id FROM store_relationships_all)
    UNION ALL SELECT 'orphan-ev-' || id, 'high', 'orphan_evidence' FROM store_evidence_all WHERE id NOT IN (SELECT evidence_id FROM store_evidence_links_all WHERE value IN (SELECT id FROM store_entities_all))
    UNION ALL SELECT 'ev-url-' || id, 'high', 'invalid_source_url' FROM store_evidence_all WHERE source_url LIKE 'ftp:%'
    UNION ALL SELECT 'schema-ent-none', 'critical', 'schema_validation' FROM store_entities_all WHERE false
    UNION ALL SELECT 'fact-no-ev-' || id, 'critical', 'unsupported_facts' FROM store_entities_all WHERE epistemic_class = 'fact' AND type <> 'Industry' AND id NOT IN (SELECT entity_id FROM store_entity_links_all WHERE kind = 'evidence')
    UNION ALL SELECT 'misc-calc-' || id, 'critical', 'misclassification' FROM store_entities_all WHERE epistemic_class = 'fact' AND type = 'Calculator' AND id IN (SELECT entity_id FROM store_entity_props_all WHERE prop = 'classification' AND value = 'conceptual')
    UNION ALL SELECT 'near-dup-' || """ + key("type || ':' || k") + """, 'medium', 'near_duplicates' FROM (SELECT type, """ + key("name") + """ AS k FROM store_entities_all GROUP BY 1, 2 HAVING count(*) >= 2)
    UNION ALL SELECT 'low-confidence-summary', 'low', 'low_confidence' FROM store_evidence_all WHERE confidence = 'low' GROUP BY ALL HAVING count(*) > 0)"""


def _issues(spark, folder):
    return integrity.issues(store(spark, folder), projects(spark, folder), ascii_only=True)


@query("integrity_issues", _sql(_STORE, _ISSUES + " SELECT issue_id, severity, category FROM iss"))
def integrity_issues(spark, folder):
    return _issues(spark, folder).select("issue_id", "severity", "category")


# Evidence of projects whose number begins with 1 counts as stale, so that both summaries have members.
@query("issue_members", _sql(_STORE, """
    + k AS (SELECT id, type, """ + key("name") + """ AS k FROM store_entities_all), d AS (SELECT type, k FROM k GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT 'near-dup-' || """ + key("type || ':' || k") + """ AS issue_id, 'entity' AS kind, id AS member_id FROM k JOIN d USING (type, k)
    UNION ALL SELECT 'low-confidence-summary', 'evidence', id FROM store_evidence_all WHERE confidence = 'low'
    UNION ALL SELECT 'stale-evidence-summary', 'evidence', id FROM store_evidence_all WHERE source_project LIKE 's-1%'"""))
def issue_members(spark, folder):
    s = store(spark, folder)
    s["evidence"] = s["evidence"].withColumn("stale", F.col("source_project").startswith("s-1"))
    return integrity.issue_members(s, ascii_only=True)


@query("integrity_gate", _sql(_STORE, _ISSUES + " SELECT count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low, false AS passed FROM iss"))
def integrity_gate(spark, folder):
    return integrity.strict_gate(_issues(spark, folder))


@query("integrity_counts", _sql(_STORE, """
    SELECT 'total' AS dimension, 'entities' AS value, count(*) AS n FROM store_entities_all UNION ALL SELECT 'entities_by_type', type, count(*) FROM store_entities_all GROUP BY type UNION ALL SELECT 'visibility', visibility, count(*) FROM store_entities_all GROUP BY visibility
    UNION ALL SELECT 'epistemic_class', epistemic_class, count(*) FROM store_entities_all GROUP BY epistemic_class UNION ALL SELECT 'total', 'relationships', count(*) FROM store_relationships_all UNION ALL SELECT 'relationships_by_type', type, count(*) FROM store_relationships_all GROUP BY type
    UNION ALL SELECT 'total', 'evidence', count(*) FROM store_evidence_all UNION ALL SELECT 'evidence_by_confidence', confidence, count(*) FROM store_evidence_all GROUP BY confidence
    UNION ALL SELECT 'evidence_by_review_status', review_status, count(*) FROM store_evidence_all GROUP BY review_status UNION ALL SELECT 'evidence_by_source_page', source_url, count(*) FROM store_evidence_all GROUP BY source_url"""))
def integrity_counts(spark, folder):
    return integrity.counts(store(spark, folder))


@query("top_source_pages", _sql(["store_evidence_all"], "SELECT source_url, count(*) AS n FROM store_evidence_all GROUP BY 1 ORDER BY n DESC, source_url LIMIT 25"))
def top_source_pages(spark, folder):
    return integrity.top_source_pages(store(spark, folder)["evidence"])


@query("fetch_failure_issues", "SELECT CAST(user_id AS STRING) AS project_slug, count(*) AS failures FROM events WHERE event_type = 'error' AND value < 30 GROUP BY 1")
def fetch_failure_issues(spark, folder):
    error = F.when(F.col("value") < 10, "Timeout").when(F.col("value") < 30, "net::ERR_FAILED").otherwise("boom")
    df = table(spark, folder, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("project_slug"), error.alias("error"))
    return integrity.fetch_failure_issues(df).select("project_slug", "failures")


@query("summary_warnings", r"SELECT CAST(doc_id AS STRING) AS project_slug, 'extract-binary-summary' AS issue_id FROM documents WHERE lang = 'de' UNION ALL SELECT CAST(doc_id AS STRING), 'extract-summary-unreadable' FROM documents WHERE length(text) > 50 AND length(regexp_replace(text, '[^\x20-\x7E\n]', '', 'g')) / length(text) < 0.5")
def summary_warnings(spark, folder):
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit(chr(7)))).otherwise(F.col("text"))
    df = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("project_slug"), text.alias("summary"))
    return integrity.summary_warnings(df).select("project_slug", "issue_id")


# --- Validation, hashes, exports --------------------------------------------------------
@query("validate_evidence", "SELECT o_orderkey AS id, o_orderstatus NOT IN ('high', 'medium', 'low') AS rejected FROM orders")
def validate_evidence(spark, folder):
    df = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("c").alias("source_company"), F.lit("p").alias("source_project"), F.col("o_orderstatus").alias("confidence"), F.lit("unreviewed").alias("review_status"),
        F.lit("fact").alias("epistemic_class"), F.lit("project_private").alias("visibility"), F.lit("manual").alias("extraction_method"), F.lit(0.5).alias("reliability_score"))
    return schemas.validate(df, "evidence").select("id", (F.size("errors") > 0).alias("rejected"))


@query("valid_projects", _sql(["d_projects"], "SELECT slug FROM d_projects"))
def valid_projects(spark, folder):
    p = projects(spark, folder).select("slug", "name")
    return schemas.valid_projects(p.select("slug").unionByName(p.select(F.col("name").alias("slug"))))


_HASH = f"""+ h AS (SELECT project_slug, substr(sha256('|' || id || '|' || confidence), 1, 30) AS d, {{part}} AS part FROM evidence_all),
    s AS (SELECT project_slug, CAST(count(*) AS STRING) AS n, CAST(sum(CAST(('0x' || substr(d, 1, 15)) AS BIGINT)) AS STRING) AS a, CAST(sum(CAST(('0x' || substr(d, 16, 15)) AS BIGINT)) AS STRING) AS b FROM h GROUP BY 1)
    SELECT project_slug, 'evidence' AS artifact, substr(sha256('|' || n || '|' || a || '|' || b), 1, 32) AS hash FROM s"""


@query("artifact_hashes", _sql(["evidence_all"], _HASH.format(part="1")))
def artifact_hashes(spark, folder):
    return io.artifact_hashes(derived(spark, folder, "evidence_all"), "evidence", [F.col("id"), F.col("confidence")])


@query("changed_projects", _sql(["evidence_old", "evidence_all"], "SELECT project_slug FROM evidence_all GROUP BY 1 HAVING count(*) <> (SELECT count(*) FROM evidence_old o WHERE o.project_slug = evidence_all.project_slug)"))
def changed_projects(spark, folder):
    f = [F.col("id"), F.col("confidence")]
    old = io.artifact_hashes(derived(spark, folder, "evidence_old"), "evidence", f)
    return io.changed_projects(old, io.artifact_hashes(derived(spark, folder, "evidence_all"), "evidence", f))


@query("export_manifest", _sql(_STORE, "SELECT 'entities' AS table_name, count(*) AS row_count FROM store_entities_all UNION ALL SELECT 'relationships', count(*) FROM store_relationships_all UNION ALL SELECT 'evidence', count(*) FROM store_evidence_all"))
def export_manifest(spark, folder):
    s = store(spark, folder)
    return io.export_manifest({k: s[k] for k in ("entities", "relationships", "evidence")})


# --- Reliability and metrics over the store --------------------------------------------
@query("recommendation_confidence", _sql(_STORE, """
    + r AS (SELECT e.id, count(v.id) AS supports, coalesce(avg(CASE v.confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END * v.reliability_score), 0) AS m FROM store_entities_all e LEFT JOIN store_entity_links_all l ON l.entity_id = e.id AND l.kind = 'evidence'
      LEFT JOIN store_evidence_all v ON v.id = l.value WHERE e.epistemic_class = 'recommendation' GROUP BY 1)
    SELECT id AS entity_id, supports, floor(round(m, 12) * 1000 + 0.5) / 1000 AS score, CASE WHEN round(m, 12) >= 0.8 THEN 'high' WHEN round(m, 12) >= 0.55 THEN 'medium' ELSE 'low' END AS label FROM r"""))
def recommendation_confidence(spark, folder):
    return metrics.recommendation_confidence(store(spark, folder)).select("entity_id", "supports", "score", "label")


@query("unsupported_recommendations", _sql(_STORE, "SELECT id, name FROM store_entities_all WHERE epistemic_class = 'recommendation' AND id NOT IN (SELECT entity_id FROM store_entity_links_all WHERE kind = 'evidence')"))
def unsupported_recommendations(spark, folder):
    return metrics.unsupported_recommendations(store(spark, folder))


@query("recommendation_coverage", _sql(_STORE, """
    + r AS (SELECT p.value AS project, e.id, EXISTS (SELECT 1 FROM store_entity_links_all v WHERE v.entity_id = e.id AND v.kind = 'evidence') AS ok FROM store_entities_all e JOIN store_entity_links_all p ON p.entity_id = e.id AND p.kind = 'project' WHERE e.epistemic_class = 'recommendation')
    SELECT project, count(*) AS recommendations, count_if(ok) AS with_evidence, round(count_if(ok) / count(*), 6) AS coverage, count_if(ok) / count(*) >= 0.8 AS passed FROM r GROUP BY 1"""))
def recommendation_coverage(spark, folder):
    return metrics.recommendation_coverage(store(spark, folder)).withColumn("coverage", F.round("coverage", 6))


@query("lowest_confidence", _sql(["store_evidence_all"], """
    SELECT * FROM (SELECT source_project AS project, CAST(row_number() OVER (PARTITION BY source_project ORDER BY seq, id) AS INTEGER) AS rn, id, reliability_score, excerpt FROM store_evidence_all WHERE confidence = 'low')"""))
def lowest_confidence(spark, folder):
    return metrics.lowest_confidence(store(spark, folder)["evidence"])


_METRIC = """+ b AS (SELECT l.value AS project, e.id, e.type, e.epistemic_class = 'fact' AS fact, """ + key("e.name") + """ AS nk, e.id IN (SELECT entity_id FROM store_entity_links_all WHERE kind = 'evidence') AS backed
      FROM store_entities_all e JOIN store_entity_links_all l ON l.entity_id = e.id AND l.kind = 'project'),
    en AS (SELECT project, count(DISTINCT type) AS types, count(*) AS entities, count_if(fact) AS facts, count_if(fact AND backed) AS bf FROM b GROUP BY 1),
    du AS (SELECT project, count(*) AS d FROM (SELECT project, type, nk FROM b GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1),
    rl AS (SELECT value AS project, count(*) AS r FROM store_relationship_links_all WHERE kind = 'project' GROUP BY 1),
    ev AS (SELECT source_project AS project, count(*) AS v, avg(CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END) AS ac, avg(reliability_score) AS ar FROM store_evidence_all GROUP BY 1)"""


@query("knowledge_metrics", _sql(_STORE + ["store_relationship_links_all"], _METRIC + """
    SELECT project, types, entities, coalesce(r, 0) AS relationships, coalesce(v, 0) AS evidence, round(bf / facts + 1e-9, 6) AS evidence_completeness, round(coalesce(r, 0) / entities + 1e-9, 6) AS density, round(ac + 1e-9, 6) AS average_confidence,
      round(ar + 1e-9, 6) AS average_reliability, round(coalesce(d, 0) / entities + 1e-9, 6) AS duplicate_rate FROM en LEFT JOIN du USING (project) LEFT JOIN rl USING (project) LEFT JOIN ev USING (project)"""))
def knowledge_metrics(spark, folder):
    df = metrics.knowledge_metrics(store(spark, folder), ascii_only=True)
    return df.select("project", "types", "entities", "relationships", "evidence", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("evidence_completeness", "density", "average_confidence", "average_reliability", "duplicate_rate")])
