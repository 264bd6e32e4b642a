from pyspark.sql import functions as F

from pagelattice import schemas
from pagelattice.operators import concepts as C
from pagelattice.operators import merge, metrics, patterns, scoring, slices
from pagelattice.sources import store as io

EMPTY = {
    "conflicts": "id string, kind string, description string, entity_id string, blocks boolean, review_status string",
    "conflict_links": "conflict_id string, kind string, value string",
}


def inventories(spark, slugs=("p1", "p2")):
    mk = spark.createDataFrame
    profiles = [(s, f"Company {s}", f"https://{s}.com/", "Steel", "We sell.", [f"{s}.com"]) for s in slugs]
    maturity = [(s, 0, "SEO", 2.0, "weak titles", "", "high", "fix titles", "search page") for s in slugs]
    products = [(s, i, f"Stud {i % 2}", "stud", "c", "d", f"https://{s}.com/p{i}", "high", {"w": "1"}, ["/a.pdf"]) for s in slugs for i in range(3)]
    return {
        "profiles": mk(profiles, "project_slug string, company_name string, website_url string, industry string, summary string, approved_hosts array<string>"),
        "maturity": mk(maturity, "project_slug string, seq bigint, category string, score double, evidence string, source_url string, confidence string, recommendation string, prototype_response string"),
        "products": mk(products, "project_slug string, seq bigint, name string, family string, category string, description string, source_url string, confidence string, attributes map<string,string>, documents array<string>"),
    }


def as_store(spark, tables):
    cols = merge.STORE_TABLES
    ev = tables["evidence"].withColumn("source_project", F.col("project_slug"))
    out = {n: (ev if n == "evidence" else tables[n]).select(*cols[n]) for n in cols}
    out["entities"] = out["entities"].dropDuplicates(["id"])
    out["entity_links"] = out["entity_links"].dropDuplicates(["entity_id", "kind", "value"])
    out.update({k: spark.createDataFrame([], v) for k, v in EMPTY.items()})
    return out


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_slice_folds_and_is_order_free(spark):
    inv = inventories(spark)
    a = slices.extract_slice(inv)
    b = slices.extract_slice({k: v.orderBy(F.rand(7)) for k, v in inv.items()})
    ids = rows(a["entities"], "project_slug", "id", "type", "name")
    assert ids == rows(b["entities"], "project_slug", "id", "type", "name")
    kinds = [r[2] for r in ids if r[0] == "p1"]
    assert (kinds.count("Product"), kinds.count("ProductFamily"), kinds.count("SeoIssue")) == (2, 1, 1)
    # The navigation pattern is stated for every project unless the gate is closed.
    assert "NavigationPattern" in kinds
    gated = slices.extract_slice(inv, nav_always=False)["entities"]
    assert gated.filter("type = 'NavigationPattern'").count() == 0


def test_merge_twice_is_merge_once(spark):
    tables = slices.extract_slice(inventories(spark))
    store = as_store(spark, tables)
    again = merge.merge_store(store, tables)
    assert again["entities"].count() == store["entities"].count()
    assert rows(again["entity_links"], "entity_id", "kind", "value") == rows(store["entity_links"], "entity_id", "kind", "value")
    assert again["conflicts"].count() == 0


def test_pattern_needs_two_projects(spark):
    one = as_store(spark, slices.extract_slice(inventories(spark, ("p1",))))
    assert patterns.candidate_patterns(one).count() == 0
    two = as_store(spark, slices.extract_slice(inventories(spark)))
    found = patterns.candidate_patterns(two)
    assert found.filter("not blocked").count() == 2  # weak SEO and the navigation pattern
    issue = two["entities"].filter("type = 'SeoIssue'").limit(1).select(F.col("id").alias("entity_id")).collect()[0][0]
    two["conflicts"] = spark.createDataFrame([("c1", "k", "d", issue, True, "needs_review")], EMPTY["conflicts"])
    two["entity_links"] = two["entity_links"].unionByName(merge.conflict_entity_links(two["conflicts"]))
    assert patterns.candidate_patterns(two).filter("blocked").count() == 1


def test_score_conflict_and_stale(spark):
    ent = "project_slug string, id string, type string, name string, normalized_key string, epistemic_class string, visibility string, review_status string, seq bigint"
    prop = "project_slug string, entity_id string, type string, prop string, value string, seq bigint"
    link = "project_slug string, entity_id string, kind string, value string, seq bigint"
    mk = spark.createDataFrame

    def side(score):
        return {"entities": mk([("p", "e", "UxIssue", "Nav", "nav", "observation", "shared_unreviewed", "unreviewed", 1)], ent),
                "entity_props": mk([("p", "e", "UxIssue", "score", score, 1), ("p", "e", "UxIssue", "observationKey", "k", 1)], prop),
                "entity_links": mk([("p", "e", "project", "p", 1)], link)}

    got = merge.score_conflicts(side("1"), side("6")).collect()
    assert got[0].description == "Score conflict on Nav: 1 vs 6"
    assert merge.score_conflicts(side("1"), side("4")).count() == 0


def test_containment_matches_brute_force(spark):
    names = ["Deluxe Submittals page", "product line overview", "Load Calculator 3", "nothing here", "Guide Spec", "Document Library of ACME"]
    ents = spark.createDataFrame([(f"e{i}", "p", "TechnicalResource", n, f"k{i}", None, i) for i, n in enumerate(names)],
                                 "entity_id string, project string, type string, name string, normalized_key string, obs_key string, seq bigint")
    reg = C.seed_concepts(spark)
    shapes = C._shapes(ents.withColumn("shape", F.col("entity_id")), False)
    got = {(r.shape, r.concept_id) for r in C._contained(shapes, "lexical", C.alias_index(reg), 0.82, 1, "x").collect()}
    lex = {r.shape: r.lexical for r in shapes.collect()}
    want = {(s, a.concept_id) for s, t in lex.items() for a in C.alias_index(reg).collect() if len(a.lexical_key) >= 6 and a.lexical_key in t}
    assert got == want and want


def test_near_tie_is_ambiguous(spark):
    scored = spark.createDataFrame([("e", "p", "t", "a", 0.9, "alias", "", 1), ("e", "p", "t", "b", 0.86, "alias", "", 2)],
                                   "entity_id string, project string, type string, concept_id string, confidence double, method string, notes string, first_order bigint")
    assert C.pick_mapping(scored).collect()[0].ambiguous


def mapping(spark, conf, status="unreviewed"):
    return spark.createDataFrame([("m", "p", "e", "l", "l", "canon_document-center", conf, "alias", status, "", False, 1)],
                                 "id string, source_project string, source_entity_id string, original_label string, lexical_key string, concept_id string, confidence double, method string, review_status string, ambiguity_notes string, below_threshold boolean, seq bigint")


def bench_store(spark):
    return {"entity_links": spark.createDataFrame([("e", "evidence", "v", 1)], "entity_id string, kind string, value string, seq bigint"),
            "evidence": spark.createDataFrame([("v", False)], "id string, stale boolean"), "conflicts": spark.createDataFrame([], EMPTY["conflicts"])}


def test_unknown_is_not_absent(spark):
    assert scoring.definition_errors(scoring.SEED_DEFINITION) == [] and len(scoring.SEED_DEFINITION.pairs()) == 108
    p = spark.createDataFrame([("p", "P", "https://p.com", "Not synthetic fixture")], "slug string, name string, website_url string, notes string")
    obs = scoring.observe(mapping(spark, 0.9), bench_store(spark), p)
    assert obs.count() == 108
    cs = scoring.concept_scores(obs)
    assert cs.filter("eligible").count() == 1 and cs.filter("raw_score = 0").count() == 0
    co = scoring.company_scores(scoring.dimension_scores(obs), cs).collect()[0]
    assert not co.eligible and co.overall_score is None


def test_lower_median_and_two_known_gap(spark):
    s = spark.createDataFrame([(p, "c", v, 0.9, "") for p, v in (("a", 25.0), ("b", 100.0))], "project string, concept_id string, raw_score double, confidence double, exclusion string")
    cohort = spark.createDataFrame([("x", "a"), ("x", "b")], "cohort_id string, project string")
    assert scoring.peer_medians(s, "concept_id", cohort).collect()[0]["median"] == 25.0
    g = scoring.peer_gaps(s, cohort).collect()[0]
    assert (g.stronger, g.weaker, g.delta, g.inconclusive) == ("b", "a", 75.0, False)


def test_rejects_are_kept_and_store_round_trip(spark, tmp_path):
    tables = as_store(spark, slices.extract_slice(inventories(spark, ("p1",))))
    bad = tables["entities"].limit(1).withColumn("type", F.lit("Nope")).withColumn("id", F.lit("bad"))
    tables["entities"] = tables["entities"].unionByName(bad)
    assert schemas.rejected_rows(tables["entities"], "entities").count() == 1
    io.write_store(tables, str(tmp_path))
    back = io.read_store(spark, str(tmp_path))
    assert back["entities"].count() == tables["entities"].count() - 1
    assert io.read_rejects(spark, str(tmp_path), "entities").count() == 1


def test_log_tail_is_cut_before_corrupt_lines_go(spark, tmp_path):
    io.append_log(spark.createDataFrame([(str(i),) for i in range(5)], "at string"), str(tmp_path / "log"))
    (tmp_path / "log" / "part-x.json").write_text("{broken\n")
    assert io.read_log(spark, str(tmp_path / "log"), "at string", limit=3).count() == 2


def test_hash_ignores_row_order(spark):
    df = spark.createDataFrame([("p", i) for i in range(50)], "project_slug string, v bigint")
    h = lambda d: io.artifact_hashes(d, "a", [F.col("v").cast("string")]).collect()[0]["hash"]
    assert h(df) == h(df.orderBy(F.rand(3))) != h(df.filter("v < 49"))


def test_support_labels(spark):
    s = {"entities": spark.createDataFrame([("r", "R", "recommendation"), ("n", "N", "recommendation")], "id string, name string, epistemic_class string"),
         "entity_links": spark.createDataFrame([("r", "evidence", "v1"), ("r", "evidence", "v2")], "entity_id string, kind string, value string"),
         "evidence": spark.createDataFrame([("v1", "high", 1.0), ("v2", "medium", 0.9)], "id string, confidence string, reliability_score double")}
    got = {r.entity_id: (r.score, r.label) for r in metrics.recommendation_confidence(s).collect()}
    assert got == {"r": (0.815, "high"), "n": (0.0, "low")}


def test_few_accepted_mappings_meet_links_where_they_lie(spark):
    reg = C.seed_concepts(spark)
    first = reg.orderBy("seq").first().id
    mappings = spark.range(40_000).select(
        F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("p"), F.col("id") % 3).alias("source_project"), F.concat(F.lit("e"), F.col("id")).alias("source_entity_id"),
        F.lit("x").alias("original_label"), F.when(F.col("id") < 5, first).alias("concept_id"), F.lit(0.9).alias("confidence"), F.lit("unreviewed").alias("review_status"),
        F.lit(False).alias("below_threshold"), F.col("id").alias("seq"))
    links = spark.range(40_000).select(F.concat(F.lit("e"), F.col("id") * 2).alias("entity_id"), F.lit("evidence").alias("kind"), F.lit("v").alias("value"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        df = C.compare_projects(mappings, reg, links)
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(r.companies, r.evidence_complete, r.shared) for r in got] == [(3, False, True)]
    semi = [x for x in plan.splitlines() if "LeftSemi" in x]
    assert semi and all("BroadcastHashJoin" in x for x in semi)
