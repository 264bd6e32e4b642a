"""Rule tables against a search of every row with every rule."""

import re

from pyspark.sql import functions as F

from pagelattice.operators import rules

PAGE = "project_slug string, page_id bigint, seq bigint, url string, title string, h1 array<string>, pdf_links array<string>, main_text_summary string"


def page(slug, i, path, title="", h1=(), text=None):
    return (slug, i, i, f"https://{slug or 'none'}.com{path}", title, list(h1), [], text)


def test_matches_equal_search(spark):
    rows = [("a" if i % 5 else "hot", i, ["red bolt", "RED rod", "bolt bolt", "", None, "end red"][i % 6], ["", "head red", None][i % 3]) for i in range(300)]
    rows += [rows[7], (None, 900, "red", "red"), ("c", 901, "red", "")]
    given = [
        ("a", "1", "red", False), ("a", "2", "(?i)^red", False), ("hot", "3", r"(\w+) \1", False), ("hot", "4", "red$", True),
        (None, "5", None, False), (None, "6", "rod|head", True), ("b", "7", "red", False), ("a", "1", "red", False), (None, "8", "red$", False),
    ]
    r = spark.createDataFrame(rows, "project_slug string, id int, text string, heads string")
    table = spark.createDataFrame(given, "project_slug string, rule_id string, pattern string, search_headings boolean")
    got = rules.matches(r, table, F.col("text"), ["id"], F.col("heads")).select("project_slug", "id", "rule_id").collect()
    want = [
        (slug, i, rule) for slug, i, text, heads in rows for of, rule, pattern, whole in given
        if slug is not None and of in (slug, None) and (pattern is None or re.search(pattern, (text or "") + ((heads or "") if whole else "")))
    ]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300
    assert rules.matches(r.limit(0), table, F.col("text"), ["id"], F.col("heads")).count() == 0
    assert rules.matches(r, table.limit(0), F.col("text"), ["id"], F.col("heads")).count() == 0


def test_rules_of_a_large_project_are_asked_by_many_tasks(spark):
    r = spark.range(20000).select(F.lit("hot").alias("project_slug"), "id", F.lit("x").alias("text"))
    table = spark.createDataFrame([("hot", "x")], "project_slug string, pattern string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = rules.matches(r, table, F.col("text"), ["id"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(p["count"] for p in parts) == 20000 and len(parts) >= 6


def test_projects_have_their_own_facts(spark):
    home = spark.createDataFrame([("a", "https://a.com/", "we make rods"), ("b", "https://b.com/", "we make rods"), ("c", "https://c.com/", None)], "project_slug string, url string, main_text_summary string")
    columns = "project_slug string, section string, pos int, pattern string, claim string, confidence string, kind string, notes string"
    table = spark.createDataFrame([("a", "s", 1, "rods", "rods", "high", "fact", None), ("b", "s", 1, "bolts", "bolts", "high", "fact", None), (None, "t", 2, None, "any", "low", "fact", "n")], columns)
    got = {(r.project_slug, r.claim, r.notes) for r in rules.facts_by_rules(home, table).collect()}
    assert got == {("a", "rods", None), ("a", "any", "n"), ("b", "any", "n"), ("c", "any", "n")}


def test_named_products(spark):
    pages = spark.createDataFrame([
        page("a", 1, "/x", text="the nitro rod"), page("a", 2, "/y", h1=["Nitro rod"]), page("a", 3, "/nitro-bolt"), page("a", 4, "/z", text="Nitro bolt"),
        page("b", 1, "/x", text="nitro rod"), page(None, 1, "/x", text="nitro rod"),
    ], PAGE)
    products = spark.createDataFrame([("b", "NITRO ROD 2"), ("b", None), ("a", "other")], "project_slug string, name string")
    named = spark.createDataFrame([(None, "ROD", "rods", "(?i)nitro rod"), ("a", "BOLT", "bolts", "(?i)nitro.bolt")], "project_slug string, label string, named_family string, pattern string")
    got = {(r.project_slug, r.name, r.source_url, r.family) for r in rules.named_products(pages, products, named).collect()}
    assert got == {("a", "ROD", "https://a.com/y", "rods"), ("a", "BOLT", "https://a.com/nitro-bolt", "bolts")}


def test_pages_by_label(spark):
    pages = spark.createDataFrame([page("a", 1, "/p"), page("a", 2, "/", h1=["contact"]), page("a", 3, "/contact"), page("b", 1, "/contact"), page(None, 1, "/contact")], PAGE)
    labels = spark.createDataFrame([("a", "c", "contact", True), (None, "u", "/contact", False), (None, "homepage", "contact", False)], "project_slug string, page_label string, pattern string, search_headings boolean")
    got = {(r.project_slug, r.page_label, r.url[13:]) for r in rules.pages_by_label(pages, labels).collect()}
    assert got == {("a", "c", "/"), ("a", "u", "/contact"), ("a", "homepage", "/"), ("b", "u", "/contact"), ("b", "homepage", "/contact")}


def test_terms_are_no_patterns(spark):
    pages = spark.createDataFrame([page("a", 1, "/", text="Stud (a.b) C\\E"), page("b", 1, "/", text="axb stud"), page("b", 2, "/")], PAGE)
    terms = spark.createDataFrame([(None, "a.b"), ("a", "STUD"), ("a", "STUD"), ("a", "c\\e"), ("a", " "), (None, None)], "project_slug string, term string")
    got = sorted((r.project_slug, r.page_id, r.term) for r in rules.terms_by_rules(pages, terms).collect())
    assert got == [("a", 1, "STUD"), ("a", 1, "a.b"), ("a", 1, "c\\e")]


def test_pages_made_of_narrow_rows_are_parsed_by_many_tasks(spark, tmp_path):
    """The table of parts is few bytes, so all its pages were made and parsed in one task."""
    from pagelattice.plans import web_queries as W

    rows = spark.range(6000).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("small "), F.when(F.col("id") % 5 > 0, F.lit("rod")).otherwise("gear")).alias("p_name"), F.lit("B#1").alias("p_brand"),
        F.when(F.col("id") % 3 > 0, F.lit("PROMO")).otherwise("LARGE").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    rows.unionByName(rows.where("p_partkey < 10")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made, plain = W._rich_pages(spark, str(tmp_path)), W._df(spark, str(tmp_path), "w_rich")
    assert made.exceptAll(plain.select(*made.columns)).isEmpty() and made.count() == plain.count() == 6010
    found = W._rich(spark, str(tmp_path))
    assert found.count() == 6010 and len(found.inputFiles()) == 3
