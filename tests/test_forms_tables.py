"""Forms and tables read off as ranges, held against a search over all elements."""

import random
import time

from pyspark.sql import functions as F

from pagelattice.operators import pages
from pagelattice.sources.html import tokenize_html


def records(spark, htmls):
    rows = [("p", i, i, "https://s.com/", h) for i, h in enumerate(htmls)]
    df = spark.createDataFrame(rows, "project_slug string, page_id bigint, seq bigint, url string, html string")
    projects = spark.createDataFrame([("p", ["s.com"])], "slug string, approved_hosts array<string>")
    return pages.extract_pages(df, projects)


def searched(elements):
    """Tables and forms of a page by looking at every element's ancestors."""
    inside = lambda x, outer: outer.seq in x.up
    clean = lambda s: " ".join(s.split())
    tables, forms = [], []
    labels = [e for e in elements if e.tag == "label"]
    for t in elements:
        if t.tag == "table":
            rows = [e for e in elements if e.tag == "tr" and inside(e, t)]
            cells = [e for e in elements if e.tag in ("th", "td") and inside(e, t)]
            firsts = {r.seq for r in rows if r.nth == 1}
            heads = {e.seq for e in elements if e.tag == "thead" and inside(e, t)}
            headers = [clean(c.text) for c in cells if firsts & set(c.up) or (c.tag == "th" and heads & set(c.up))]
            body = [[clean(c.text) for c in cells if inside(c, r)] for r in rows]
            caption = "".join(e.text for e in elements if e.tag == "caption" and inside(e, t)).strip() or None
            tables.append((caption, headers, max(0, len(rows) - bool(headers)), body[1:]))
        if t.tag == "form":
            fields = []
            for f in elements:
                if f.tag in ("input", "select", "textarea") and inside(f, t):
                    own = f.attrs.get("id")
                    named = [x.text for x in labels if own and x.attrs.get("for", "") == own][:1]
                    around = [x.text for x in labels if inside(f, x)][-1:]
                    label = (named[0] if named else "") or (around[0] if around else "") or f.attrs.get("aria-label")
                    fields.append((f.attrs.get("name"), clean(label or "") or None))
            forms.append(fields)
    return tables, forms


def check(spark, htmls):
    given = spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string")
    want = {r.page_id: searched(r.elements) for r in tokenize_html(given).collect()}
    got = records(spark, htmls).select("page_id", "tables", "forms").collect()
    assert len(got) == len(htmls)
    for r in got:
        tables = [(t.caption, t.headers, t.row_count, t.sample_rows) for t in r.tables]
        forms = [[(f.name, f.label) for f in form.fields] for form in r.forms]
        assert (tables, forms) == want[r.page_id], htmls[r.page_id]


def test_nested_and_broken_markup(spark):
    check(spark, [
        "", "<table></table>", "<table><tr></table>", "<form>", "<form></form></form>",
        "<table><caption>A<caption>B<thead><tr><th>h<td>d<tbody><tr><th>x<td>y<tr><td>z</table>",
        "<table><tr><td>o1<table><caption>in</caption><tr><td>i1<tr><td>i2</table></td><td>o2<tr><td>p</table>",
        "<table><tr><td>a<tbody><tr><th>first of part<tr><td>b</table>", "<table><tr><td>1<table><thead><tr><td>2<th>3</table><tr><th>4</table>",
        "<form><label for=a>one</label><label for=a>two</label><input id=a name=x><label>w<input name=y></label><input name=z aria-label=al></form>",
        "<label>out<form><input name=q><label> </label><label for=''>e</label><input id='' name=r></form></label><input name=free>",
        "<form id=o><input name=1><form><input name=2></form><select name=3></form><textarea name=4></textarea>",
        "<label for=k></label><form><label>in<input id=k name=k></label><label>a<label>b<input name=l></label></label></form>",
    ])


def test_random_markup(spark):
    rng = random.Random(5)
    tags = "table thead tbody tr td th caption form label input select".split()
    out = []
    for _ in range(60):
        html = ""
        for _ in range(rng.randrange(5, 60)):
            tag = rng.choice(tags)
            own = f" id={rng.randrange(4)} for={rng.randrange(4)} name=n{rng.randrange(9)}"
            html += f"</{tag}>" if rng.random() < 0.35 else f"<{tag}{own}>w{rng.randrange(99)} "
        out.append(html)
    check(spark, out)


def test_large_table_and_form_are_linear(spark):
    def seconds(n):
        table = "<table>" + "".join(f"<tr><td>{i}<td>x" for i in range(n)) + "</table>"
        form = "<form>" + "".join(f"<label for=f{i}>L{i}</label><input id=f{i} name=n{i}>" for i in range(n)) + "</form>"
        start = time.time()
        r = records(spark, [table + form]).select(
            F.col("tables")[0]["row_count"].alias("rows"), F.size(F.col("tables")[0]["sample_rows"]).alias("kept"),
            F.col("forms")[0]["fields"][n - 1]["label"].alias("label"),
        ).collect()[0]
        assert (r.rows, r.kept, r.label) == (n - 1, n - 1, f"L{n - 1}")
        return time.time() - start

    seconds(300)
    small, large = seconds(3000), seconds(30000)
    assert large < 10 * small, (small, large)


def test_containers_keep_no_text_and_columns_pass(spark):
    df = spark.createDataFrame([(7, "<nav>n<a href=x>l</a></nav><form class=btn>b</form><table><tr><td>c</table>", "keep"), (8, None, None)], "page_id bigint, html string, other string")
    rows = {r.page_id: r for r in tokenize_html(df).collect()}
    assert [(e.tag, e.text) for e in rows[7].elements] == [("nav", ""), ("a", "l"), ("form", "b"), ("table", ""), ("tr", ""), ("td", "c")]
    assert (rows[7].other, rows[8].elements, rows[8].body_text) == ("keep", [], "")
    assert tokenize_html(df.filter("page_id > 99")).count() == 0
