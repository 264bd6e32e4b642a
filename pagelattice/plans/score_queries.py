"""Queries over concept mappings, benchmark scores and platform metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions.core import Tables
from pagelattice.functions.keys import key_of
from pagelattice.operators import concepts as C
from pagelattice.operators import integrity, metrics, scoring
from pagelattice.plans import web_queries as W
from pagelattice.plans.derived import ctes, projects, store
from pagelattice.plans.dialect import Duck
from pagelattice.plans.graph_queries import _CONFLICT, _METRIC, _STORE, _conflicted, _decisions, drawn_sql
from pagelattice.plans.registry import query, table
from pagelattice.session import written

D = Duck()
sha, key = D.sha128, D.key
# Concepts beside the seeds: two a person reviewed, one of them withdrawn.
EXTRA = [("canon_ring", 100, "Ring", "product_structure", ["small ring"], {"s-1": ["bolt"]}, "accepted", "ann"),
         ("canon_gear", 101, "Gear", "product_structure", ["hot gear"], {}, "deprecated", "ann"),
         ("canon_rod", 102, "Rod", "product_structure", ["steel rod"], {}, "accepted", "platform")]


def _registry(spark):
    return C.refresh_registry(C.seed_concepts(spark), spark.createDataFrame(EXTRA, C.CONCEPT_DDL))


def _entities(spark, folder):
    return C.mapped_entities(store(spark, folder))


def _scored(spark, folder):
    return written(spark, (folder, "scored"), lambda: C.score_mappings(_entities(spark, folder), _registry(spark), ascii_only=True))


def _mappings(spark, folder):
    return written(spark, (folder, "mappings"), lambda: C.normalize(_entities(spark, folder), _registry(spark), ascii_only=True))


# --- SQL of the checks ----------------------------------------------------------------
def _values() -> str:
    rows = [(f"canon_{key_of(n)}", i, n, a, {}, "accepted") for i, (n, _, a) in enumerate(C.SEED_CONCEPTS)]
    rows += [(i, s, n, a, c, st) for i, s, n, _, a, c, st, by in EXTRA if by != "platform"]
    out = []
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    for cid, seq, name, aliases, own, status in rows:
        items = [(name, "canonical_name", None, 0)] + [(a, "alias", None, i + 1) for i, a in enumerate(aliases)]
        items += [(a, "company_specific", slug, 500 + i) for slug, xs in own.items() for i, a in enumerate(xs)]
        out += [f"({q(cid)}, {seq}, {q(name)}, {q(a)}, {q(src)}, {q(slug)}, {n}, {q(status)})" for a, src, slug, n in items]
    return ", ".join(out)


_HINTS = ", ".join(f"('{t}', '{c}', {i})" for t, cs in C.TYPE_HINTS.items() for i, c in enumerate(cs))
_BONUS = ", ".join(f"('{t}', '{c}', {v})" for t, cs in C.TYPE_BONUS.items() for c, v in cs.items())
_SKIP = ", ".join(f"'{t}'" for t in C.SKIP_TYPES)
_REG = f"""+ rg AS (SELECT * FROM (VALUES {_values()}) v(concept_id, cseq, cname, alias, source, company_slug, n, status)),
    al AS (SELECT *, {key('alias')} AS lk, cseq * 1000 + n AS aseq FROM rg WHERE status <> 'deprecated')"""
_TOK = lambda k: f"unnest(list_distinct(list_filter(string_split({k}, '-'), lambda t: length(t) > 2)))"
_SCORE = _REG + f""",
    en AS (SELECT e.id, l.value AS project, e.type, e.name, e.normalized_key AS nk, p.value AS obs, e.seq FROM store_entities_all e JOIN store_entity_links_all l ON l.entity_id = e.id AND l.kind = 'project'
      LEFT JOIN store_entity_props_all p ON p.entity_id = e.id AND p.prop = 'observationKey' WHERE e.type NOT IN ({_SKIP})),
    ky AS (SELECT *, {key('name')} AS lab, {key("concat_ws(' ', name, obs, nk)")} AS lex, {key("coalesce(obs, '')")} AS ob FROM en),
    ex AS (SELECT id, project, type, concept_id, CASE source WHEN 'canonical_name' THEN 0.96 ELSE 0.9 END AS cf, CASE source WHEN 'canonical_name' THEN 'exact' ELSE 'alias' END AS method, aseq * 10 AS o FROM ky JOIN al ON lk = lab WHERE company_slug IS NULL OR company_slug = project
      UNION ALL SELECT id, project, type, concept_id, CASE source WHEN 'canonical_name' THEN 0.96 ELSE 0.9 END, CASE source WHEN 'canonical_name' THEN 'exact' ELSE 'alias' END, aseq * 10 FROM ky JOIN al ON lk = lex WHERE company_slug IS NULL OR company_slug = project),
    inn AS (SELECT id, project, type, concept_id, 0.82 AS cf, 'semantic' AS method, aseq * 10 + 1 AS o FROM ky JOIN al ON length(lk) >= 6 AND contains(lex, lk) WHERE company_slug IS NULL OR company_slug = project
      UNION ALL SELECT id, project, type, concept_id, 0.8, 'semantic', aseq * 10 + 2 FROM ky JOIN al ON length(lk) >= 6 AND contains(ob, lk) WHERE company_slug IS NULL OR company_slug = project),
    ct AS (SELECT DISTINCT concept_id, cseq, status, {_TOK(key('alias'))} AS tok FROM rg WHERE source <> 'company_specific'), cs AS (SELECT concept_id, count(*) AS csize FROM ct GROUP BY 1),
    sh AS (SELECT DISTINCT lex FROM ky), et AS (SELECT lex, {_TOK('lex')} AS tok FROM sh), es AS (SELECT lex, count(*) AS esize FROM et GROUP BY 1),
    ov AS (SELECT lex, concept_id, cseq, status, count(*) / (any_value(esize) + any_value(csize) - count(*)) AS j FROM et JOIN es USING (lex) JOIN ct USING (tok) JOIN cs USING (concept_id) GROUP BY 1, 2, 3, 4),
    hi AS (SELECT * FROM (VALUES {_HINTS}) v(type, concept_id, h)), bo AS (SELECT * FROM (VALUES {_BONUS}) v(type, concept_id, delta)),
    st AS (SELECT id, project, type, concept_id, least(0.88, 0.7 + j * 0.25) AS cf, 'structural' AS method, 1000000000 + h AS o FROM ky JOIN ov USING (lex) JOIN hi USING (type, concept_id) WHERE j >= 0.25),
    se AS (SELECT id, project, type, concept_id, least(0.86, 0.65 + j * 0.3) AS cf, 'semantic' AS method, 2000000000 + cseq AS o FROM ky JOIN ov USING (lex) WHERE status <> 'deprecated' AND j >= 0.45),
    ca AS (SELECT * FROM ex UNION ALL SELECT * FROM inn UNION ALL SELECT * FROM st UNION ALL SELECT * FROM se),
    be AS (SELECT *, row_number() OVER (PARTITION BY id, project, concept_id ORDER BY cf DESC, o) AS rn, min(o) OVER (PARTITION BY id, project, concept_id) AS fo FROM ca),
    sc AS (SELECT id, project, type, concept_id, CAST(CASE WHEN delta IS NULL THEN cf ELSE greatest(0, least(0.99, cf + delta)) END AS DOUBLE) AS cf, method, fo FROM be LEFT JOIN bo USING (type, concept_id) WHERE rn = 1)"""
_PICK = _SCORE + """, rk AS (SELECT *, row_number() OVER (PARTITION BY id, project ORDER BY cf DESC, fo, concept_id) AS r, lead(cf) OVER (PARTITION BY id, project ORDER BY cf DESC, fo, concept_id) AS nx FROM sc),
    pk AS (SELECT id, project, concept_id AS best, cf, method, coalesce(abs(cf - nx) < 0.06, false) AS amb, cf < 0.72 AS below FROM rk WHERE r = 1)"""
_MAP = _PICK + """, mp AS (SELECT 'nmap_' || """ + sha("en.project || '|' || en.id || '|' || coalesce(best, 'unmapped')") + """ AS id, en.project, en.id AS entity_id, name AS label, CASE WHEN NOT amb AND NOT below THEN best END AS concept_id, coalesce(cf, 0) AS confidence,
      coalesce(method, 'semantic') AS method, CASE WHEN amb THEN 'ambiguous' ELSE 'unreviewed' END AS review_status, best IS NULL OR below OR amb AS below_threshold, seq FROM en LEFT JOIN pk ON pk.id = en.id AND pk.project = en.project)"""


def _sql(body: str, more: list[str] = []) -> str:  # noqa: B006
    return f"{ctes(D, _STORE + more)}, {body.strip()[1:]}"


# --- Concepts ---------------------------------------------------------------------------
@query("alias_index", f"""
    WITH n AS (SELECT DISTINCT regexp_extract(p_name, '[^ ]+$') AS noun, p_name, p_brand FROM part),
    live AS (SELECT * FROM n WHERE noun <> 'ring'),
    a AS (SELECT 'part_' || noun AS concept_id, noun AS alias, 'canonical_name' AS source, NULL AS company_slug FROM live
      UNION ALL SELECT DISTINCT 'part_' || noun, p_name, 'alias', NULL FROM (SELECT DISTINCT noun, p_name FROM live)
      UNION ALL SELECT 'part_' || noun, 'our ' || noun, 'company_specific', p_brand FROM (SELECT DISTINCT noun, p_brand FROM live))
    SELECT DISTINCT concept_id, alias, {key('alias')} AS lexical_key, source, company_slug FROM a""")
def alias_index(spark, folder):
    """A concept for each noun of the part names, withdrawn for one of them; every brand has a name of its own for it."""
    noun = F.element_at(F.split("p_name", " "), -1)
    named = table(spark, folder, "part").select(noun.alias("canonical_name"), "p_name", "p_brand")
    reg = named.groupBy("canonical_name").agg(F.array_sort(F.collect_set("p_name")).alias("aliases"), F.array_sort(F.collect_set("p_brand")).alias("brands"))
    own = F.map_from_arrays("brands", F.transform("brands", lambda b: F.array(F.concat(F.lit("our "), F.col("canonical_name")))))
    reg = reg.select(
        F.concat(F.lit("part_"), "canonical_name").alias("id"), F.lit(0).cast("bigint").alias("seq"), "canonical_name", "aliases", own.alias("company_specific_aliases"),
        F.when(F.col("canonical_name") == "ring", "deprecated").otherwise("accepted").alias("status"))
    return C.alias_index(reg).select("concept_id", "alias", "lexical_key", "source", "company_slug")


@query("concept_scores_raw", _sql(_SCORE + " SELECT id AS entity_id, project, concept_id, round(cf, 6) AS confidence, method FROM sc"))
def concept_scores_raw(spark, folder):
    return _scored(spark, folder).select("entity_id", "project", "concept_id", F.round("confidence", 6).alias("confidence"), "method")


@query("concept_pick", _sql(_PICK + " SELECT id AS entity_id, project, best AS best_concept, round(cf, 6) AS confidence, amb AS ambiguous, below FROM pk"))
def concept_pick(spark, folder):
    return C.pick_mapping(_scored(spark, folder)).select("entity_id", "project", "best_concept", F.round("confidence", 6).alias("confidence"), "ambiguous", "below")


@query("mappings", _sql(_MAP + " SELECT id, project, entity_id, concept_id, round(confidence, 6) AS confidence, method, review_status, below_threshold FROM mp"))
def mappings(spark, folder):
    return _mappings(spark, folder).select("id", F.col("source_project").alias("project"), F.col("source_entity_id").alias("entity_id"), "concept_id",
                                           F.round("confidence", 6).alias("confidence"), "method", "review_status", "below_threshold")


@query("mapping_status", _sql(_MAP + """, t AS (SELECT value AS project, count(*) AS entities FROM store_entity_links_all WHERE kind = 'project' GROUP BY 1)
    SELECT project, entities, count_if(concept_id IS NOT NULL AND NOT below_threshold) AS mapped, count_if(NOT (concept_id IS NOT NULL AND NOT below_threshold) OR review_status = 'ambiguous') AS unmapped,
      count_if(review_status = 'ambiguous') AS ambiguous, count_if(below_threshold) AS below_threshold, coalesce(round(avg(CASE WHEN concept_id IS NOT NULL AND NOT below_threshold THEN confidence END) + 1e-9, 4), 0) AS average_confidence FROM mp JOIN t USING (project) GROUP BY 1, 2"""))
def mapping_status(spark, folder):
    all_of = store(spark, folder)["entity_links"].filter("kind = 'project'").select("entity_id", F.col("value").alias("project"))
    return C.mapping_status(_mappings(spark, folder).withColumn("confidence", F.col("confidence") + 1e-9), all_of)


@query("concept_coverage", _sql(_MAP + " SELECT project, concept_id, count(*) AS n FROM mp WHERE concept_id IS NOT NULL AND NOT below_threshold GROUP BY 1, 2"))
def concept_coverage(spark, folder):
    return C.concept_coverage(_mappings(spark, folder))


@query("mapping_coverage", _sql(_MAP + " SELECT project, method, count(*) AS total, count_if(concept_id IS NOT NULL AND NOT below_threshold) AS mapped FROM mp GROUP BY 1, 2"))
def mapping_coverage(spark, folder):
    return C.mapping_coverage(_mappings(spark, folder))


@query("review_queue", _sql(_MAP + " SELECT id, review_status FROM mp WHERE (review_status = 'ambiguous' OR (below_threshold AND confidence > 0) OR (review_status = 'unreviewed' AND confidence > 0 AND concept_id IS NULL)) AND method = 'semantic'"))
def review_queue(spark, folder):
    return C.review_queue(_mappings(spark, folder), method="semantic").select("id", "review_status")


_KINDS = {"purchase": "confirmed", "error": "rejected", "signup": "unresolved"}


def _reviews(spark, folder):
    d = _decisions(spark, folder, _mappings(spark, folder), "mapping_id", _KINDS)
    return d.withColumn("concept_id", F.lit("canon_ring")).withColumn("rationale", F.lit(""))


def _reviewed(spark, folder):
    return written(spark, (folder, "reviewed"), lambda: C.apply_mapping_decisions(_mappings(spark, folder), _reviews(spark, folder)))


_REV = _MAP + f""", dl AS (SELECT id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'rejected' ELSE 'unresolved' END AS decision FROM ({drawn_sql('mp')}) WHERE event_type IN ('purchase', 'error', 'signup')),
    ld AS (SELECT DISTINCT ON (id) id, decision FROM dl ORDER BY id, ts DESC, event_id DESC),
    rv AS (SELECT mp.id, project, entity_id, label, CASE WHEN decision = 'confirmed' THEN 'canon_ring' ELSE concept_id END AS concept_id, CASE WHEN decision = 'confirmed' THEN greatest(confidence, 0.95) ELSE confidence END AS confidence,
      CASE WHEN decision = 'confirmed' THEN 'manually_reviewed' ELSE method END AS method, CASE decision WHEN 'confirmed' THEN 'confirmed' WHEN 'rejected' THEN 'rejected' WHEN 'unresolved' THEN CASE WHEN review_status = 'ambiguous' THEN 'ambiguous' ELSE 'unreviewed' END ELSE review_status END AS review_status,
      CASE decision WHEN 'confirmed' THEN false WHEN 'rejected' THEN true ELSE below_threshold END AS below_threshold, seq FROM mp LEFT JOIN ld USING (id))"""


@query("mapping_decisions", _sql(_REV + " SELECT id, concept_id, round(confidence, 6) AS confidence, method, review_status, below_threshold FROM rv"))
def mapping_decisions(spark, folder):
    return _reviewed(spark, folder).select("id", "concept_id", F.round("confidence", 6).alias("confidence"), "method", "review_status", "below_threshold")


@query("normalize_with_prior", _sql(_REV + " SELECT mp.id, coalesce(rv.review_status, mp.review_status) AS review_status FROM mp LEFT JOIN rv ON rv.id = mp.id AND rv.review_status IN ('confirmed', 'rejected')"))
def normalize_with_prior(spark, folder):
    return C.normalize(_entities(spark, folder), _registry(spark), prior=_reviewed(spark, folder), ascii_only=True).select("id", "review_status")


@query("review_log", _sql(_REV + " SELECT event_id AS decision_id, id AS mapping_id, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1 AS valid FROM dl"))
def review_log(spark, folder):
    log = _reviews(spark, folder).withColumn("artifact_digest", F.lit("x"))
    return C.review_log(log, "mapping_id").select("decision_id", "mapping_id", "valid")


@query("review_digests", _sql(_REV + " SELECT event_id AS decision_id, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1 AND decision = 'unresolved' AS valid FROM dl"))
def review_digests(spark, folder):
    """Only a review that left its mapping unchanged still has the right digest."""
    before = _mappings(spark, folder).select(F.col("id").alias("mapping_id"), C.mapping_digest().alias("artifact_digest"))
    after = _reviewed(spark, folder).select(F.col("id").alias("mapping_id"), C.mapping_digest().alias("digest"))
    return C.review_log(_reviews(spark, folder).join(before, "mapping_id"), "mapping_id", after).select("decision_id", "valid")


_PRES = """, ac AS (SELECT DISTINCT ON (project, concept_id) project, concept_id, entity_id, confidence FROM mp WHERE concept_id IS NOT NULL AND NOT below_threshold AND review_status NOT IN ('rejected', 'ambiguous') ORDER BY project, concept_id, seq, id),
    pe AS (SELECT *, entity_id IN (SELECT entity_id FROM store_entity_links_all WHERE kind = 'evidence') AS has FROM ac)"""


@query("compare_projects", _sql(_MAP + _PRES + " SELECT concept_id, count(*) AS companies, count(*) >= 2 AS shared, bool_and(has) AS evidence_complete, CASE WHEN count(*) = 1 THEN min(project) END AS only_project, count(*) >= 2 AND bool_and(has) AS pattern_ready FROM pe GROUP BY 1"))
def compare_projects(spark, folder):
    return C.compare_projects(_mappings(spark, folder), _registry(spark), store(spark, folder)["entity_links"])


@query("unmapped_counts", _sql(_MAP + " SELECT project, count_if(concept_id IS NULL OR below_threshold) AS unmapped FROM mp GROUP BY 1"))
def unmapped_counts(spark, folder):
    return C.unmapped_counts(_mappings(spark, folder))


_CF = ", " + _CONFLICT.strip()[1:]


@query("canonical_patterns", _sql(_MAP + _PRES + _CF + """,
    x AS (SELECT concept_id, count(*) AS projects, bool_and(has) AS complete, max(CASE WHEN confidence >= 0.9 THEN 0 WHEN confidence >= 0.75 THEN 1 ELSE 2 END) AS w FROM pe GROUP BY 1 HAVING count(*) >= 2),
    y AS (SELECT concept_id, count(*) AS k FROM pe JOIN cf USING (entity_id) GROUP BY 1)
    SELECT 'cpat_' || """ + sha("'CandidatePattern|' || " + key("'canonical:' || concept_id")) + """ AS id, concept_id, projects, projects AS companies, CAST(coalesce(k, 0) AS BIGINT) AS blocking_conflicts, CASE w WHEN 2 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence_summary,
      CASE WHEN NOT complete THEN 'incomplete' WHEN coalesce(k, 0) > 0 THEN 'blocked' ELSE 'candidate' END AS outcome FROM x LEFT JOIN y USING (concept_id)""", ["issue_old", "issue_new", "store_entities_old"]))
def canonical_patterns(spark, folder):
    return C.canonical_patterns(_mappings(spark, folder), _registry(spark), _conflicted(spark, folder)).select(
        "id", "concept_id", "projects", "companies", "blocking_conflicts", "confidence_summary", "outcome")


# --- Benchmark --------------------------------------------------------------------------
DEF = scoring.SEED_DEFINITION


def _bench_store(spark, folder):
    """The store with conflicts, and evidence of low confidence marked stale."""
    s = _conflicted(spark, folder)
    return Tables({k: (lambda k=k: s[k]) for k in s}, evidence=s["evidence"].withColumn("stale", F.col("confidence") == "low"))


def _obs(spark, folder):
    return written(spark, (folder, "observations"), lambda: scoring.observe(_reviewed(spark, folder), _bench_store(spark, folder), projects(spark, folder)))


def _cohorts(spark, folder):
    return projects(spark, folder).select("cohort_id", F.col("slug").alias("project"))


_PAIRS = ", ".join(f"('{c}', '{d}')" for c, d in DEF.pairs())
_DIMS = ", ".join(f"('{d.id}', {d.weight}, {str(d.missing == 'cap_confidence').lower()})" for d in DEF.dimensions)
_OBS = _REV + _CF + f""",
    bm AS (SELECT DISTINCT ON (project, concept_id) * FROM rv WHERE review_status <> 'rejected' AND concept_id IS NOT NULL ORDER BY project, concept_id, confidence DESC, seq, id DESC),
    sv AS (SELECT entity_id, count(*) AS nev, bool_or(confidence = 'low') AS stl FROM store_entity_links_all JOIN store_evidence_all ON value = id WHERE kind = 'evidence' GROUP BY 1), sf AS (SELECT entity_id, count(*) AS ncf FROM cf GROUP BY 1),
    gd AS (SELECT slug AS project, name AS company_name, coalesce(notes = 'Synthetic fixture', false) AS syn, v.concept_id, v.dimension_id FROM d_projects, (VALUES {_PAIRS}) v(concept_id, dimension_id)),
    jo AS (SELECT gd.*, bm.id AS mid, bm.entity_id, bm.confidence AS mc, coalesce(nev, 0) AS nev, coalesce(stl, false) AS stl, coalesce(ncf, 0) AS ncf,
      CASE WHEN bm.id IS NULL THEN 'none' WHEN review_status = 'ambiguous' OR below_threshold THEN 'unsure' WHEN coalesce(nev, 0) = 0 THEN 'lacking' WHEN gd.concept_id = 'canon_calculator-opportunity' THEN 'gap' WHEN bm.confidence >= 0.85 THEN 'present' ELSE 'partial' END AS cs
      FROM gd LEFT JOIN bm USING (project, concept_id) LEFT JOIN sv ON sv.entity_id = bm.entity_id LEFT JOIN sf ON sf.entity_id = bm.entity_id),
    c0 AS (SELECT *, CASE cs WHEN 'none' THEN 0.35 WHEN 'unsure' THEN least(0.5, mc) WHEN 'lacking' THEN 0.4 ELSE CASE WHEN mc >= 0.9 THEN least(0.95, mc) WHEN mc >= 0.75 THEN least(0.85, mc) ELSE greatest(0.35, mc * 0.9) END END AS a, cs IN ('gap', 'present', 'partial') AS scd FROM jo),
    c1 AS (SELECT *, CASE WHEN scd AND stl THEN greatest(0.2, a - 0.25) ELSE a END AS b FROM c0), c2 AS (SELECT *, CASE WHEN scd AND ncf > 0 THEN greatest(0.15, b - 0.35) ELSE b END AS d FROM c1),
    ob AS (SELECT project, company_name, concept_id, dimension_id, CASE WHEN cs IN ('none', 'lacking') THEN 'unknown' WHEN cs = 'unsure' THEN 'ambiguous' WHEN cs = 'present' THEN 'present' ELSE 'partial' END AS state,
      CASE cs WHEN 'gap' THEN 0.25 WHEN 'present' THEN 1.0 WHEN 'partial' THEN 0.55 END AS val, CAST(CASE WHEN syn THEN least(d, 0.7) ELSE d END AS DOUBLE) AS conf, CASE WHEN cs = 'none' THEN 0 ELSE nev END AS nev,
      CASE WHEN cs IN ('lacking', 'gap', 'present', 'partial') THEN ncf ELSE 0 END AS ncf, scd AND stl AS is_stale FROM c2),
    oi AS (SELECT *, 'bobs_' || {sha("project || '|cfs-digital-capability|1.0.0|' || concept_id || '|' || dimension_id || '|' || state")} AS id FROM ob)"""
_BN = ["issue_old", "issue_new", "store_entities_old", "d_projects"]


@query("observations", _sql(_OBS + " SELECT id, project, concept_id, dimension_id, state AS observed_state, val AS normalized_value, round(conf, 6) AS confidence, nev AS evidence_count, CAST(ncf AS BIGINT) AS conflict_count, is_stale FROM oi", _BN))
def observations(spark, folder):
    return _obs(spark, folder).select("id", "project", "concept_id", "dimension_id", "observed_state", "normalized_value", F.round("confidence", 6).alias("confidence"),
                                      "evidence_count", "conflict_count", "is_stale")


_CSC = _OBS + ", cc AS (SELECT project, concept_id, CASE WHEN state IN ('present', 'partial') THEN val * 100 END AS raw_score, conf, state = 'unknown' AS unk, nev, state FROM ob WHERE dimension_id = 'capability_presence')"


def _cs(spark, folder):
    return scoring.concept_scores(_obs(spark, folder))


@query("concept_scores", _sql(_CSC + " SELECT project, concept_id, round(raw_score, 6) AS raw_score, round(conf, 6) AS confidence, raw_score IS NOT NULL AS eligible FROM cc", _BN))
def concept_scores(spark, folder):
    return _cs(spark, folder).select("project", "concept_id", F.round("raw_score", 6).alias("raw_score"), F.round("confidence", 6).alias("confidence"), "eligible")


_DSC = _CSC + f""", dm AS (SELECT * FROM (VALUES {_DIMS}) v(dimension_id, weight, caps)),
    ag AS (SELECT project, dimension_id, count(*) AS n, count_if(state = 'unknown') AS u, avg(conf) AS cf, avg(val) AS pl, avg(CASE WHEN concept_id IN ('canon_engineering-calculator', 'canon_limiting-height-tool', 'canon_engineering-table') THEN val END) AS tl,
      count_if(val IS NOT NULL AND concept_id = 'canon_calculator-opportunity') AS gp, count_if(state IN ('present', 'partial')) AS hd, count_if(state IN ('present', 'partial') AND nev > 0 AND ncf = 0) AS gd,
      avg(CASE WHEN nev > 0 THEN CASE WHEN is_stale THEN 0.4 ELSE 0.95 END END) AS fr, count_if(state = 'ambiguous' OR ncf > 0) AS bad FROM ob GROUP BY 1, 2),
    ds AS (SELECT project, dimension_id, weight, (n - u) / n AS cov, CASE WHEN caps AND (n - u) / n < 0.25 THEN least(cf, 0.55) ELSE cf END AS conf,
      100 * CASE dimension_id WHEN 'engineering_utility' THEN coalesce(tl, CASE WHEN gp > 0 THEN 0.2 END) WHEN 'evidence_quality' THEN CASE WHEN hd > 0 THEN gd / hd END WHEN 'evidence_recency' THEN fr WHEN 'cross_channel_consistency' THEN 1 - bad / n ELSE pl END AS raw
      FROM ag JOIN dm USING (dimension_id))"""


def _ds(spark, folder):
    return scoring.dimension_scores(_obs(spark, folder))


_R6 = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)


@query("dimension_scores", _sql(_DSC + " SELECT project, dimension_id, round(raw + 1e-9, 6) AS raw_score, round(conf + 1e-9, 6) AS confidence, round(cov + 1e-9, 6) AS evidence_coverage, raw IS NOT NULL AS eligible FROM ds", _BN))
def dimension_scores(spark, folder):
    return _ds(spark, folder).select("project", "dimension_id", _R6("raw_score"), _R6("confidence"), _R6("evidence_coverage"), "eligible")


_CO = _DSC + """, co AS (SELECT project, avg(cov) AS cov, coalesce(avg(CASE WHEN raw IS NOT NULL THEN conf END), avg(conf)) AS conf, count(raw) AS nd, sum(raw * weight) / sum(CASE WHEN raw IS NOT NULL THEN weight END) AS ov,
      bool_or(dimension_id = 'capability_presence' AND raw IS NOT NULL) AND bool_or(dimension_id = 'evidence_quality' AND raw IS NOT NULL) AS req FROM ds GROUP BY 1), mc AS (SELECT project, count(raw_score) AS mapped FROM cc GROUP BY 1),
    ce AS (SELECT *, mapped >= 3 AND round(cov, 12) >= 0.35 AND nd >= 4 AND req AS ok FROM co JOIN mc USING (project))"""


def _company(spark, folder):
    return scoring.company_scores(_ds(spark, folder), _cs(spark, folder))


@query("company_scores", _sql(_CO + " SELECT project, CASE WHEN ok THEN round(ov + 1e-9, 6) END AS overall_score, round(conf + 1e-9, 6) AS confidence, round(cov + 1e-9, 6) AS evidence_coverage, mapped AS mapped_concepts, nd AS eligible_dimensions, ok AS eligible FROM ce", _BN))
def company_scores(spark, folder):
    return _company(spark, folder).select("project", _R6("overall_score"), _R6("confidence"), _R6("evidence_coverage"), "mapped_concepts", "eligible_dimensions", "eligible")


@query("peer_medians", _sql(_CSC + """, m AS (SELECT cohort_id, concept_id, quantile_disc(raw_score, 0.5) AS median, min(raw_score) AS low, max(raw_score) AS high, count(raw_score) AS known, count_if(unk) AS unknown, coalesce(avg(CASE WHEN raw_score IS NOT NULL THEN conf END), 0.3) AS confidence, count(*) AS sz
      FROM cc JOIN d_projects ON slug = project GROUP BY 1, 2) SELECT cohort_id, concept_id, median, low, high, known, unknown, round(confidence + 1e-9, 6) AS confidence, round(known / sz + 1e-9, 6) AS evidence_coverage, known >= 2 AS eligible FROM m""", _BN))
def peer_medians(spark, folder):
    df = scoring.peer_medians(_cs(spark, folder), "concept_id", _cohorts(spark, folder))
    return df.select("cohort_id", "concept_id", "median", "low", "high", "known", "unknown", _R6("confidence"), _R6("evidence_coverage"), "eligible")


@query("dimension_peers", _sql(_DSC + " SELECT cohort_id, dimension_id, round(quantile_disc(raw, 0.5) + 1e-9, 6) AS median, count(raw) AS known FROM ds JOIN d_projects ON slug = project GROUP BY 1, 2", _BN))
def dimension_peers(spark, folder):
    df = scoring.peer_medians(_ds(spark, folder), "dimension_id", _cohorts(spark, folder))
    return df.select("cohort_id", "dimension_id", _R6("median"), "known")


_GAP = _CSC + """, gk AS (SELECT cohort_id, concept_id, project, raw_score, conf, count(*) OVER (PARTITION BY cohort_id, concept_id) AS k, row_number() OVER (PARTITION BY cohort_id, concept_id ORDER BY raw_score DESC, project) AS r FROM cc JOIN d_projects ON slug = project WHERE raw_score IS NOT NULL),
    gp AS (SELECT a.cohort_id, a.concept_id, a.project AS stronger, b.project AS weaker, a.raw_score - b.raw_score AS delta, a.raw_score - b.raw_score < 5 OR abs(a.conf - b.conf) > 0.35 OR least(a.conf, b.conf) < 0.5 AS inconclusive
      FROM gk a JOIN gk b ON a.cohort_id = b.cohort_id AND a.concept_id = b.concept_id AND a.r = 1 AND b.r = 2 WHERE a.k = 2)"""


def _gaps(spark, folder):
    return scoring.peer_gaps(_cs(spark, folder), _cohorts(spark, folder))


@query("peer_gaps", _sql(_GAP + " SELECT cohort_id, concept_id, stronger, weaker, round(delta, 6) AS delta, inconclusive FROM gp", _BN))
def peer_gaps(spark, folder):
    return _gaps(spark, folder).withColumn("delta", F.round("delta", 6))


@query("peer_conclusions", _sql(_GAP + """, f AS (SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY delta DESC, concept_id) AS r, row_number() OVER (PARTITION BY cohort_id ORDER BY delta, concept_id DESC) AS q FROM gp WHERE NOT inconclusive)
    SELECT a.cohort_id, a.stronger AS leader, a.concept_id AS leads_on, b.weaker AS trailer, b.concept_id AS trails_on FROM f a JOIN f b ON a.cohort_id = b.cohort_id AND a.r = 1 AND b.q = 1""", _BN))
def peer_conclusions(spark, folder):
    return scoring.peer_conclusions(_gaps(spark, folder)).drop("leads_by")


_REC = _GAP + """, rc AS (SELECT project, concept_id, 'evidence_gap' AS kind, conf FROM cc WHERE state = 'unknown' UNION ALL SELECT project, concept_id, 'likely_gap', conf FROM cc WHERE state = 'ambiguous'
    UNION ALL SELECT project, concept_id, 'optimization_opportunity', conf FROM cc WHERE state = 'partial' AND concept_id IN ('canon_engineering-calculator', 'canon_submittal-workflow', 'canon_document-center')
    UNION ALL SELECT project, concept_id, 'peer_relative_advantage', least(conf, 0.75) FROM cc WHERE state IN ('present', 'partial') AND nev > 0 AND (project, concept_id) IN (SELECT (stronger, concept_id) FROM gp WHERE NOT inconclusive AND delta >= 20)
    UNION ALL SELECT project, concept_id, 'confirmed_gap', least(conf, 0.7) FROM cc WHERE state = 'partial' AND (project, concept_id) IN (SELECT (weaker, concept_id) FROM gp WHERE NOT inconclusive AND delta >= 25))"""


@query("recommendations", _sql(_REC + " SELECT project, concept_id, kind, round(conf, 6) AS confidence FROM rc", _BN))
def recommendations(spark, folder):
    return scoring.recommend(_obs(spark, folder), _gaps(spark, folder)).select("project", "concept_id", "kind", F.round("confidence", 6).alias("confidence"))


@query("run_status", _sql(_REC + """, s AS (SELECT project, count(*) AS observations, count_if(state = 'present') AS present, count_if(state = 'partial') AS partial, count_if(state = 'unknown') AS unknown, count_if(state = 'ambiguous') AS ambiguous FROM ob GROUP BY 1),
    r AS (SELECT project, count(*) AS recommendations FROM rc GROUP BY 1) SELECT s.*, coalesce(recommendations, 0) AS recommendations FROM s LEFT JOIN r USING (project)""", _BN))
def run_status(spark, folder):
    st = scoring.run_status(_obs(spark, folder), _company(spark, folder), scoring.recommend(_obs(spark, folder), _gaps(spark, folder)))
    return st.select("project", "observations", "present", "partial", "unknown", "ambiguous", "recommendations")


@query("evidence_gaps", _sql(_OBS + " SELECT project, count_if(state = 'unknown') AS unknown, count_if(state = 'ambiguous') AS ambiguous, count(DISTINCT CASE WHEN state = 'unknown' THEN concept_id END) AS unknown_concepts FROM ob GROUP BY 1", _BN))
def evidence_gaps(spark, folder):
    return scoring.evidence_gaps(_obs(spark, folder)).drop("concepts")


@query("cohort_labels", f"{ctes(D, ['d_projects'])} , c AS (SELECT cohort_id, count_if(notes <> 'Synthetic fixture') AS live, count_if(notes = 'Synthetic fixture') AS synthetic FROM d_projects GROUP BY 1) SELECT cohort_id, live, synthetic, live + synthetic < 3 OR synthetic > 0 AS limited FROM c")
def cohort_labels(spark, folder):
    return scoring.cohort_labels(_cohorts(spark, folder), projects(spark, folder)).drop("label")


def _obs_decisions(spark, folder):
    d = _decisions(spark, folder, _obs(spark, folder), "observation_id", {"purchase": "accepted", "error": "rejected", "signup": "overridden"})
    return d.withColumn("rationale", F.lit("seen")).withColumn("resulting_state", F.lit("present")).withColumn("resulting_normalized", F.lit(0.9))


@query("observation_reviews", _sql(_OBS + f""", dd AS (SELECT DISTINCT ON (id) id, event_type FROM ({drawn_sql('oi')}) WHERE event_type IN ('purchase', 'error', 'signup') ORDER BY id, ts DESC, event_id DESC)
    SELECT oi.id, CASE event_type WHEN 'signup' THEN 'present' WHEN 'error' THEN 'unknown' ELSE state END AS observed_state, CASE event_type WHEN 'signup' THEN 0.9 WHEN 'error' THEN NULL ELSE val END AS normalized_value, coalesce(event_type = 'signup', false) AS material_override FROM oi LEFT JOIN dd USING (id)""", _BN))
def observation_reviews(spark, folder):
    return scoring.apply_observation_reviews(_obs(spark, folder), _obs_decisions(spark, folder)).select("id", "observed_state", "normalized_value", "material_override")


def _approval_log(spark, folder):
    keys = F.array(*[F.lit(k) for k in scoring.APPROVAL_KEYS])
    return table(spark, folder, "events").select(
        F.get(keys, (F.col("event_id") % 3).cast("int")).alias("key"), F.concat(F.lit("bench-"), F.col("user_id").cast("string")).alias("artifact_id"), F.lit("1.0.0").alias("artifact_version"),
        F.when(F.col("event_type") == "error", "old").otherwise("now").alias("digest"), F.lit("ann").alias("reviewer"),
        F.when(F.col("event_type") == "click", "needs_changes").otherwise("approved").alias("decision"), "ts", F.col("event_id").alias("decision_id"))


_APP = """WITH l AS (SELECT CASE event_id % 3 WHEN 0 THEN 'benchmark.definition.review' WHEN 1 THEN 'benchmark.observation.review' ELSE 'benchmark.publish' END AS key, 'bench-' || CAST(user_id AS STRING) AS artifact_id, event_type, ts, event_id FROM events),
    a AS (SELECT DISTINCT ON (key, artifact_id) key, artifact_id, CASE event_type WHEN 'click' THEN 'needs_changes' ELSE 'approved' END AS decision, event_type <> 'error' AS valid FROM l ORDER BY key, artifact_id, ts DESC, event_id DESC)"""


def _approved(spark, folder):
    log = _approval_log(spark, folder)
    now = log.select("artifact_id").distinct().select("artifact_id", F.lit("1.0.0").alias("current_version"), F.lit("now").alias("current_digest"))
    return scoring.approvals(log, now)


@query("approvals", _APP + " SELECT * FROM a")
def approvals(spark, folder):
    return _approved(spark, folder).select("key", "artifact_id", "decision", "valid")


@query("publish_gate", _APP + " SELECT artifact_id, bool_or(valid AND decision = 'approved' AND key = 'benchmark.definition.review') AND bool_or(valid AND decision = 'approved' AND key = 'benchmark.observation.review') AND bool_or(valid AND decision = 'approved' AND key = 'benchmark.publish') AS publishable FROM a GROUP BY 1")
def publish_gate(spark, folder):
    return scoring.publish_gate(_approved(spark, folder)).select("artifact_id", "publishable")


@query("input_digests", _sql(_REV + """, h AS (SELECT project, sha256(id) AS d FROM mp), s AS (SELECT project, CAST(count(*) AS STRING) AS n, CAST(sum(CAST(('0x' || substr(d, 1, 15)) AS BIGINT)) AS STRING) AS a, CAST(sum(CAST(('0x' || substr(d, 16, 15)) AS BIGINT)) AS STRING) AS b FROM h GROUP BY 1)
    SELECT project, substr(sha256('|' || project || '|cfs-digital-capability|1.0.0|' || n || '|' || a || '|' || b), 1, 32) AS input_digest FROM s"""))
def input_digests(spark, folder):
    return scoring.input_digests(_mappings(spark, folder))


@query("stale_inputs", _sql(_MAP + " SELECT DISTINCT project FROM mp WHERE label LIKE 'PROMO%'"))
def stale_inputs(spark, folder):
    before = _mappings(spark, folder).filter("original_label not like 'PROMO%'")
    return scoring.stale_inputs(scoring.input_digests(before), scoring.input_digests(_mappings(spark, folder)))


@query("run_record", _sql(_MAP + " SELECT count(DISTINCT project) AS projects, 'run-1' AS run_id FROM mp"))
def run_record(spark, folder):
    return scoring.run_record(scoring.input_digests(_mappings(spark, folder)), DEF, "run-1", "2024-01-01T00:00:00Z").select("projects", "run_id")


# --- Platform metrics ---------------------------------------------------------------------
@query("text_quality_counts", f"{W._QUALITY} SELECT lang AS project_slug, count(*) AS pages, count_if(ok) AS ok, count_if(NOT ok) AS failed, count_if(sal) AS salvaged FROM w GROUP BY 1")
def text_quality_counts(spark, folder):
    docs = W._damaged(spark, folder).select(F.col("lang").alias("project_slug"), F.col("t").alias("main_text_summary"))
    return metrics.text_quality_counts(docs)


def _crawl(spark, folder):
    from pagelattice.operators import frontier

    health = frontier.crawl_health(W._verdicts(spark, folder), W._df(spark, folder, "w_fetch"), W._records(spark, folder))
    return health, metrics.text_quality_counts(W._records(spark, folder))


_CQ = f"""+ u AS (SELECT project_slug, {W._canon('url')} AS url FROM w_pages), pg AS (SELECT project_slug, count(DISTINCT url) AS ps FROM u GROUP BY 1), o AS (SELECT project_slug, count(*) AS pa, count_if(NOT ok) AS pf FROM w_fetch GROUP BY 1),
    q AS (SELECT project_slug, coalesce(ps, 0) AS ps, coalesce(pa, 0) AS pa, coalesce(pf, 0) AS pf FROM pg FULL JOIN o USING (project_slug))"""


@query("crawl_quality", W._sql(["w_pages", "w_fetch"], _CQ + " SELECT project_slug, round(greatest(0, least(1, ps / greatest(1, pa) * 0.55 + 0.35 + greatest(0, 1 - pf / greatest(1, pa)) * 0.1)) + 1e-9, 6) AS crawl_quality FROM q"))
def crawl_quality(spark, folder):
    return metrics.crawl_quality(*_crawl(spark, folder)).select("project_slug", _R6("crawl_quality"))


@query("crawl_metrics", W._sql(["w_pages", "w_fetch"], _CQ + " SELECT project_slug, 1.0 AS normalization_quality, round(ps / greatest(1, pa) + 1e-9, 6) AS canonicalization_success, round(pf / greatest(1, pa) + 1e-9, 6) AS broken_source_rate FROM q"))
def crawl_metrics(spark, folder):
    return metrics.crawl_metrics(*_crawl(spark, folder)).select("project_slug", "normalization_quality", _R6("canonicalization_success"), _R6("broken_source_rate"))


@query("platform_metrics", f"""{ctes(D, _STORE + ['store_relationship_links_all', 'd_projects'])}, {_METRIC[1:]},
    uf AS (SELECT project, count_if(fact AND NOT backed AND type <> 'Industry') AS uf, count_if(fact) AS nf FROM b GROUP BY 1), oe AS (SELECT source_project AS project, count_if(source_url LIKE 'ftp:%') AS bu FROM store_evidence_all GROUP BY 1),
    k AS (SELECT project, greatest(0, 1 - uf * 0.2 - coalesce(bu, 0) * 0.1) AS kq, 1 - uf * 0.1 AS ce, ar FROM uf LEFT JOIN oe USING (project) LEFT JOIN ev USING (project))
    SELECT project, round(kq + 1e-9, 6) AS knowledge_quality, round(ce + 1e-9, 6) AS evidence_completeness, round(0.5 * 0.25 + kq * 0.3 + 0.15 + ar * 0.15 + ce * 0.15 + 1e-9, 6) AS overall_confidence FROM k""")
def platform_metrics(spark, folder):
    s = store(spark, folder)
    found = integrity.issues(s, ascii_only=True)
    member = s["entity_links"].filter("kind = 'project'").select(F.col("entity_id").alias("subject_id"), F.col("value").alias("project"))
    unsupported = found.filter("category = 'unsupported_facts'").join(member, "subject_id").groupBy("project").agg(F.count("*").alias("unsupported"))
    owner = s["evidence"].select(F.col("id").alias("subject_id"), F.col("source_project").alias("project"))
    bad_urls = found.filter("category = 'invalid_source_url'").join(owner, "subject_id").groupBy("project").agg(F.count("*").alias("high"))
    facts = s["entities"].filter("epistemic_class = 'fact'").select(F.col("id").alias("subject_id")).join(member, "subject_id").groupBy("project").agg(F.count("*").alias("facts"))
    counts = facts.join(unsupported, "project", "left").join(bad_urls, "project", "left").fillna(0).withColumn("critical", F.col("unsupported")).withColumn("medium", F.lit(0))
    p = projects(spark, folder).select(F.col("slug").alias("project_slug"), F.lit(True).alias("summary_ok"))
    crawl = p.select("project_slug", F.lit(0.5).alias("crawl_quality"))
    df = metrics.platform_metrics(crawl, metrics.knowledge_metrics(s, ascii_only=True), counts, p)
    return df.select("project", _R6("knowledge_quality"), _R6("evidence_completeness"), _R6("overall_confidence"))
