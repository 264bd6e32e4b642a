"""Nothing is cut, capped or merged by a prefix unless asked for: one case beyond each former limit."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelattice import schemas
from pagelattice.functions import keys as K
from pagelattice.functions import text as T
from pagelattice.operators import concepts, frontier, inventory, knowledge, metrics, pages

PAGE = "project_slug string, page_id bigint, seq bigint, url string, html string"


def records(spark, html):
    page = spark.createDataFrame([("p", 1, 1, "https://s.com/x", html)], PAGE)
    hosts = spark.createDataFrame([("p", ["s.com"])], "slug string, approved_hosts array<string>")
    return pages.extract_pages(page, hosts)


def test_frontier_beyond_two_hundred(spark):
    links = spark.range(500).select(F.lit("p").alias("project_slug"), F.col("id").alias("seq"), F.concat(F.lit("https://s.com/a"), F.col("id").cast("string")).alias("href"))
    seen = spark.createDataFrame([("p", "https://s.com/")], "project_slug string, url string")
    of = lambda most: spark.createDataFrame([("p", ["s.com"], most)], "slug string, approved_hosts array<string>, max_crawl_pages int")
    assert frontier.next_frontier(links, seen, of(1000)).count() == 500
    assert frontier.next_frontier(links, seen, of(None)).count() == 500
    assert frontier.next_frontier(links, seen, of(301)).count() == 300
    assert frontier.next_frontier(links, seen, of(1000), most=200).count() == 200


def test_contacts_late_on_a_page(spark):
    words = "plain words fill this page without end " * 60
    r = records(spark, f"<body><article>{words} call 555-123-4567 or write a@b.co</article></body>").first()
    assert (r.phone_numbers, r.email_addresses) == (["555-123-4567"], ["a@b.co"])
    assert len(r.main_text_summary) > 2000


def test_all_rows_of_an_html_table_and_whole_broken_json(spark):
    rows = "".join(f"<tr><td>{i}<td>x" for i in range(40))
    broken = "{broken " + "y" * 500
    r = records(spark, f'<body><table>{rows}</table><script type="application/ld+json">{broken}</script></body>')
    assert pages.page_tables(r).first().sample_rows == [[str(i), "x"] for i in range(1, 40)]
    assert pages.page_jsonld(r).first().content == broken


def test_keys_beyond_160_characters(spark):
    a, b = "n" * 170 + "1", "n" * 170 + "2"
    df = spark.createDataFrame([(a,), (b,)], "v string")
    got = [tuple(r) for r in df.select(K.normalize_key("v"), K.normalize_key("v", max_chars=160), K.stable_hash(K.normalize_key("v"))).collect()]
    assert got[0][0] != got[1][0] and got[0][1] == got[1][1] and got[0][2] != got[1][2] and len(got[0][2]) == 32
    assert K.key_of(a) == a


def test_long_texts_stay_whole(spark):
    text = "These are clean words of an ordinary text. " * 400
    df = spark.createDataFrame([(text,)], "t string")
    assert T.normalize_text(df, "t").first().tq.text == text.strip()
    assert len(T.normalize_text(df, "t", max_length=100).first().tq.text) == 101


def test_rankings_and_findings_are_whole(spark):
    rows = [(f"e{i}", "p", "low", 0.1, "x" * 300, i) for i in range(60)]
    ev = spark.createDataFrame(rows, "id string, source_project string, confidence string, reliability_score double, excerpt string, seq bigint")
    got = metrics.lowest_confidence(ev).collect()
    assert len(got) == 60 and {len(r.excerpt) for r in got} == {300}
    assert metrics.lowest_confidence(ev, 15).count() == 15


@pytest.mark.parametrize("limit, n", [(None, 120), (50, 50)])
def test_knowledge_limit(spark, limit, n):
    e = spark.range(120).select(F.col("id").cast("string").alias("id"), F.lit("Product").alias("type"), F.col("id").alias("seq"))
    none = spark.createDataFrame([], "id string, from_id string, to_id string, type string, seq bigint, entity_id string, evidence_id string, kind string, value string, stale boolean, review_status string")
    store = {"entities": e, "relationships": none, "evidence": none, "entity_links": none, "evidence_links": none, "entity_props": none}
    assert knowledge.query(store, entity_type="Product", limit=limit)["entities"].count() == n


def test_aliases_keep_their_order_beyond_a_thousand(spark):
    many = [f"alias number {i}" for i in range(1500)]
    rows = [("c1", "First", many, {"co": [f"own {i}" for i in range(700)]}, "active", 0), ("c2", "Second", ["other"], {}, "active", 1)]
    reg = spark.createDataFrame(rows, "id string, canonical_name string, aliases array<string>, company_specific_aliases map<string,array<string>>, status string, seq bigint")
    got = [(r.concept_id, r.alias) for r in concepts.alias_index(reg).orderBy("seq").collect()]
    assert got == [("c1", x) for x in ["First", *many, *[f"own {i}" for i in range(700)]]] + [("c2", "Second"), ("c2", "other")]


def test_member_demand_is_the_sum_of_its_pairs(spark):
    keys = [F.lit(16.0).alias("spacing_in"), F.lit(5.0).alias("lateral_load_psf"), F.lit("L").alias("deflection_limit")]
    members = spark.range(30).select(F.col("id").cast("string").alias("designation"), (F.col("id") / 2 + 3).alias("max_height_ft"), *keys)
    requests = spark.range(200).select(F.col("id").alias("request_id"), (F.col("id") % 37 / 2.5 + 0.5).alias("required_height_ft"), *keys)
    pairs = inventory.passing_members(members, requests).groupBy("designation").agg(F.count("*").alias("n"), F.round(F.sum(F.col("max_height_ft") - F.col("required_height_ft")), 6).alias("s"))
    got = inventory.member_demand(members, requests).select("designation", "requests", F.round("slack", 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))


def test_latest_record_of_equal_times_is_settled(spark):
    rows = [("a", i, 5) for i in range(50)] + [("b", 1, 1), ("b", 2, 2)]
    df = spark.createDataFrame(rows, "id string, v bigint, seq bigint")
    one = {r.id: r.v for r in schemas.latest_by_id(df.repartition(7)).collect()}
    assert one == {r.id: r.v for r in schemas.latest_by_id(df.coalesce(1)).collect()} and one["b"] == 2


def test_evidence_records_make_no_ids_of_entities(spark):
    """The records of a slice need no ids of entities; they were made for every row and dropped again."""
    from pagelattice.operators import slices

    profiles = spark.createDataFrame([("s", "Co", "https://a.example/", "Steel", "sum", ["a.example"])], "project_slug string, company_name string, website_url string, industry string, summary string, approved_hosts array<string>")
    families = spark.createDataFrame([("s", "studs", 1)], "project_slug string, family string, seq bigint")
    s = slices.extract_slice({"profiles": profiles, "families": families}, ascii_only=True)
    plan = s["evidence"]._jdf.queryExecution().optimizedPlan().toString()
    assert "ent_ProductFamily_" not in plan and "ent_Industry_" not in plan and "entity_ids" not in plan
    members = s["evidence_links"].join(s["evidence"].select("project_slug", "id"), [F.col("evidence_id") == F.col("id")])
    assert {r.value.split("_")[1] for r in members.collect()} == {"Company", "Industry", "Website", "ProductFamily", "NavigationPattern"}
