from pyspark.sql import functions as F

from pagelattice.functions import keys as K
from pagelattice.functions import text as T
from pagelattice.functions import urls as U
from pagelattice.operators import frontier, pages

HTML = """<html><head><title> A  B </title><meta name="description" content=" d "><link rel="canonical" href="/c/">
<script type="application/ld+json">{"@type":"Org"}</script></head><body><nav><a href="/n1">N</a></nav><h1>H <b>x</b></h1>
<form action="/s"><label for="q">Query</label><input id="q" name="q" required><label>Wrap <select name="w"></select></label></form>
<table><caption>Cap</caption><tr><th>a<th>b<tr><td>1<td>2</table><img src="/i.png"><div class="cta"><a href="https://e.com/calculator">go</a></div>
<a class="btn" href="f.PDF">pdf</a><article>Call 555-123-4567 or a@b.co, our stud framing is great for all walls</article></body></html>"""


def one(df):
    return df.collect()[0]


def test_normalize_url(spark):
    cases = [
        ("HTTP://www.Ex.com:80/a/../b/./c/?utm_source=x&q=a b&Ref=1&z#f", "https://ex.com/b/c?q=a+b&z="),
        ("https://h.com", "https://h.com/"), ("ftp://x/y", None), ("foo", None), ("https://h.com/Ción/x y/", "https://h.com/Ci%C3%B3n/x%20y"),
    ]
    df = spark.createDataFrame(cases, "raw string, want string").withColumn("got", U.normalize_url("raw"))
    assert [r.got for r in df.collect()] == [w for _, w in cases]
    kept = df.select(U.normalize_url(F.lit("https://h.com/x"), "www.h.com").alias("a"), U.normalize_url(F.lit("https://www.o.com/"), "h.com").alias("b"))
    assert tuple(one(kept)) == ("https://www.h.com/x", "https://www.o.com/")


def test_resolve_href(spark):
    cases = [("/x", "https://s.com/x"), ("y", "https://s.com/p/y"), ("//a.b/c", "https://a.b/c"), ("?q=1", "https://s.com/p/q?q=1"), ("", None)]
    df = spark.createDataFrame(cases, "h string, want string").select(U.resolve_href("h", F.lit("https://s.com/p/q?z=1")).alias("g"))
    assert [r.g for r in df.collect()] == [w for _, w in cases]


def test_robots_sections(spark):
    text = "User-agent: *\r\nDisallow: /a # c\nDisallow:\n\nUser-Agent: Foo\nDisallow: /b\nSitemap: http://x/s.xml\nuser-agent:*\ndisallow:/c"
    r = one(spark.createDataFrame([(text,)], "t string").select(U.robots_rules("t").alias("r")).select("r.*"))
    assert (r.disallow, r.sitemaps) == (["/a", "/c"], ["http://x/s.xml"])


def test_duplicate_only_after_admission(spark):
    projects = spark.createDataFrame([("p", ["s.com"], 75)], "slug string, approved_hosts array<string>, max_crawl_pages int")
    rows = [("p", 1, "https://s.com/cart/1"), ("p", 2, "https://s.com/cart/1"), ("p", 3, "https://s.com/x"), ("p", 4, "http://www.s.com/x/"), ("p", 5, "nope")]
    got = frontier.frontier_gate(spark.createDataFrame(rows, "project_slug string, seq bigint, url string"), projects)
    assert [r.verdict for r in got.orderBy("seq").collect()] == ["skip_path", "skip_path", "admit", "duplicate", "invalid"]


def test_hot_url_keeps_first(spark):
    rows = spark.range(3000).select(F.lit("p").alias("project_slug"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "https://s.com/hot").otherwise(F.concat(F.lit("https://s.com/"), F.col("id").cast("string"))).alias("url"))
    projects = spark.createDataFrame([("p", ["s.com"], 75)], "slug string, approved_hosts array<string>, max_crawl_pages int")
    got = {r.verdict: r.n for r in frontier.frontier_gate(rows, projects).groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    assert got == {"admit": 2001, "duplicate": 999}


def test_extract_page(spark):
    page = spark.createDataFrame([("ext", 1, 1, "http://www.s.com/p/q", HTML)], "project_slug string, page_id bigint, seq bigint, url string, html string")
    projects = spark.createDataFrame([("ext", ["s.com", "www.s.com"])], "slug string, approved_hosts array<string>")
    r = one(pages.extract_pages(page, projects))
    assert (r.url, r.title, r.canonical_url, r.meta_description, r.h1) == ("https://s.com/p/q", "A B", "https://s.com/c", "d", ["H x"])
    assert (r.navigation_links, r.external_links) == (["https://s.com/n1"], ["https://e.com/calculator"])
    assert [(f.name, f.label, f.required) for f in r.forms[0].fields] == [("q", "Query", True), ("w", "Wrap", False)]
    t = r.tables[0]
    # Rows stay rows: a table of cells per row, as the declared schema says.
    assert (t.caption, t.headers, t.row_count, t.sample_rows) == ("Cap", ["a", "b"], 1, [["1", "2"]])
    assert (r.phone_numbers, r.email_addresses, r.product_family_terms, r.pdf_links) == (["555-123-4567"], ["a@b.co"], ["stud", "framing"], ["https://s.com/p/f.PDF"])


def test_text_quality(spark):
    rows = [(1, "hello world"), (2, ("中文 " * 40) + "The quick brown fox jumps over the lazy dog and then runs away from there"), (3, "\x00\x01abc"), (4, "a &amp;lt; &#65;&#x42;")]
    got = {r.i: r.tq for r in T.normalize_text(spark.createDataFrame(rows, "i int, t string"), "t").collect()}
    assert got[1].ok and got[1].issues == []
    assert got[2].ok and got[2].text.startswith("The quick") and got[2].confidence_penalty == 0.12
    assert not got[3].ok and "likely_binary_or_compressed" in got[3].issues and got[3].text == ""
    assert got[4].text == "a < AB"


def test_keys(spark):
    r = one(spark.range(1).select(K.normalize_key(F.lit("Café ﬁn/X")).alias("k"), K.entity_id("Industry", F.lit("steel")).alias("e")))
    assert r.k == "cafe-fin-x" and r.e.startswith("ent_Industry_") and K.key_of("Café ﬁn/X") == r.k


def test_native_plans(spark):
    df = spark.createDataFrame([("https://a.b/", "text")], "url string, t string")
    plan = T.normalize_text(df.select(U.normalize_url("url"), "t"), "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
