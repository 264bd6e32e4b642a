"""Inventories and audit aggregates over page records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions import urls as U
from pagelattice.functions.core import compact, js_round, txt, word
from pagelattice.functions.text import normalize_text
from pagelattice.operators.ranking import first_rows

# Facts read off the home page as (section, pattern, claim, confidence, kind, notes);
# no pattern means the fact is always stated.
FACT_RULES = [
    ("locations", rf"(?i)bow|new hampshire|{word('nh')}",
     "Company references a New Hampshire / Bow location in public site copy.", "high", "fact", None),
    ("locations", rf"(?i)montgomery|alabama|{word('al')}",
     "Company references a Montgomery, Alabama location in public site copy.", "high", "fact", None),
    ("offerings", None,
     "Public positioning describes a lightweight / cold-formed steel framing manufacturer and fabricator.", "high", "fact", None),
    ("audiences", None,
     "Site language targets construction professionals and distribution partners (distributors listed publicly).", "medium", "inference",
     "Audience inferred from distributor listings and industry copy; not an explicit persona statement."),
    ("standards", "(?i)aisi|csa|s100",
     "Site states structural property standards are computed in accordance with AISI and CSA references.", "high", "fact", None),
]
# Pages that describe products; products added when named anywhere.
PRODUCT_PAGE = "(?i)product|stud|track|joist|nitro|framing|catalog"
NAMED_PRODUCTS = [("NITROSTUD", "nitrostud", "(?i)nitrostud")]
NO_SUMMARY = "Summary unavailable — text normalization failed on crawled homepage content."
PRODUCT_NOTE = "Extracted from public page inventory; attributes require structured table parsing."
NAMED_NOTE = "Name observed in crawl corpus; verify product-detail completeness."
# Labels of representative pages as (label, pattern, also search headings).
PAGE_LABELS = [
    ("catalog", "(?i)product|catalog|framing", False),
    ("product-category", "(?i)stud|track|joist|category", False),
    ("nitrostud", "(?i)nitrostud", True),
    ("technical-resources", "(?i)technical|resource|engineering|table", False),
    ("documents", "(?i)document|download|brochure|pdf", False),
    ("contact", "(?i)contact", False),
    ("distributors", "(?i)distributor|dealer|where.?to.?buy", False),
    ("submittal", "(?i)submittal|specification", False),
    ("calculator-or-tool", "(?i)calculat|tool|limiting.?height|span", False),
]


def cap(df: DataFrame, n: int | None, keys: list[str], order: list) -> DataFrame:
    """At most n rows per key; None keeps all. The limit is applied before the shuffle."""
    if n is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def homepages(records: DataFrame) -> DataFrame:
    """The first page with path '/', else the first page, per project."""
    not_root = F.coalesce(U.url_path("url") != "/", F.lit(True))
    return (
        records.select("project_slug", "url", "title", "main_text_summary", "seq", not_root.alias("nr"))
        .groupBy("project_slug")
        .agg(F.min_by(F.struct("url", "title", "main_text_summary", "nr"), F.struct("nr", "seq")).alias("p"))
        .select("project_slug", "p.url", "p.title", "p.main_text_summary", (~F.col("p.nr")).alias("is_root"))
    )


def project_values(records: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct values of an array column per project with their first position."""
    df = (
        records.select("project_slug", "seq", F.posexplode(column).alias("pos", "value"))
        .filter("value <> ''")
        .groupBy("project_slug", "value")
        .agg(F.min(F.struct("seq", "pos")).alias("at"))
        .select("project_slug", "value", F.col("at.seq").alias("seq"), F.col("at.pos").alias("pos"))
    )
    return cap(df, limit, ["project_slug"], ["seq", "pos"])


def rule_facts(home: DataFrame, rules: list = FACT_RULES) -> DataFrame:
    """Sourced facts whose pattern occurs in the home page text."""
    text = txt("main_text_summary")

    def fact(i: int, rule: tuple) -> Column:
        section, pattern, claim, confidence, kind, notes = rule
        row = F.struct(
            F.lit(section).alias("section"), F.lit(i).alias("pos"), F.lit(claim).alias("claim"),
            F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"),
            F.lit(notes).cast("string").alias("notes"),
        )
        return row if pattern is None else F.when(text.rlike(pattern), row)

    found = compact(*[fact(i, r) for i, r in enumerate(rules)])
    return home.select("project_slug", F.col("url").alias("source_url"), F.explode(found).alias("f")).select(
        "project_slug", "f.section", "f.pos", "f.claim", "source_url", "f.confidence", "f.kind", "f.notes"
    )


def contact_facts(records: DataFrame, home: DataFrame, limit: int | None = None) -> DataFrame:
    """Phone and e-mail facts of each project: all, or the first ``limit`` of each."""
    def facts(column: str, label: str, base: int) -> DataFrame:
        v = first_rows(project_values(records, column), ["project_slug"], ["seq", "pos"], limit)
        return v.select(
            "project_slug", F.lit("contacts").alias("section"), (F.lit(base) + F.col("rn")).cast("int").alias("pos"),
            F.concat(F.lit(label + " observed on public pages: "), F.col("value")).alias("claim"),
        )

    both = facts("phone_numbers", "Phone number", 100).unionByName(facts("email_addresses", "Email address", 200))
    return both.join(home.select("project_slug", F.col("url").alias("source_url")), "project_slug").select(
        "project_slug", "section", "pos", "claim", "source_url",
        F.lit("medium").alias("confidence"), F.lit("fact").alias("kind"), F.lit(None).cast("string").alias("notes"),
    )


def company_profiles(records: DataFrame, projects: DataFrame) -> DataFrame:
    """One profile row per project; its facts are `rule_facts` and `contact_facts`."""
    home = homepages(records).withColumnRenamed("url", "home_url")
    df = normalize_text(home, "main_text_summary", "tq")
    summary = F.when(F.col("tq.ok"), F.col("tq.text")).otherwise(F.lit(NO_SUMMARY))
    p = projects.select(
        F.col("slug").alias("project_slug"), F.col("name").alias("company_name"), "website_url", "industry"
    )
    return p.join(df, "project_slug").select(
        "project_slug", "company_name", "website_url", "industry", "home_url",
        summary.alias("summary"), F.col("tq.ok").alias("summary_ok"),
    )


def _searched(headings: bool) -> Column:
    parts = [F.col("url"), txt("title")]
    if headings:
        parts.append(F.array_join("h1", " "))
    return F.concat_ws(" ", *parts)


def product_inventory(records: DataFrame, max_per_project: int | None = None) -> DataFrame:
    """Product pages, plus named products that no product page carries yet."""
    description = F.col("main_text_summary")
    base = records.select(
        "project_slug", "seq", "url", "title", "h1", "main_text_summary", "pdf_links", "product_family_terms",
        _searched(True).rlike(PRODUCT_PAGE).alias("is_product"),
    )
    name = F.coalesce(F.get("h1", F.lit(0)), F.when(F.col("title") != "", F.col("title")), F.col("url"))
    pages = base.filter("is_product").select(
        "project_slug", "seq", name.alias("name"),
        F.get("product_family_terms", F.lit(0)).alias("family"), description.alias("description"),
        F.col("url").alias("source_url"), F.col("pdf_links").alias("documents"),
        F.lit("medium").alias("confidence"), F.lit(PRODUCT_NOTE).alias("notes"),
    )
    pages = cap(pages, max_per_project, ["project_slug"], ["seq"])
    out = pages
    for label, family, pattern in NAMED_PRODUCTS:
        in_name = F.concat_ws(" ", "url", txt("title"), F.array_join("h1", " ")).rlike(pattern)
        in_text = txt("main_text_summary").rlike(pattern)
        best = (
            base.filter(in_name | in_text)
            .groupBy("project_slug")
            .agg(F.min_by(F.struct("url", "main_text_summary", "pdf_links"), F.struct(~in_name, F.col("seq"))).alias("p"))
        )
        listed = pages.filter(F.col("name").rlike(pattern)).select("project_slug").distinct()
        extra = best.join(listed, "project_slug", "left_anti").select(
            "project_slug", F.lit(-1).cast("bigint").alias("seq"), F.lit(label).alias("name"),
            F.lit(family).alias("family"), F.col("p.main_text_summary").alias("description"),
            F.col("p.url").alias("source_url"), F.col("p.pdf_links").alias("documents"),
            F.lit("medium").alias("confidence"), F.lit(NAMED_NOTE).alias("notes"),
        )
        out = out.unionByName(extra)
    return out


def document_inventory(documents: DataFrame) -> DataFrame:
    """Page documents with a title: link text, else file name, else the link."""
    file_name = F.element_at(F.split("href", "/"), -1)
    title = F.coalesce("text", F.when(file_name != "", file_name), F.col("href"))
    return documents.select(
        "project_slug", title.alias("title"), "href", "file_type",
        F.col("page_url").alias("source_page_url"), F.lit("unknown").alias("status"), F.lit("medium").alias("confidence"),
    )


def audit_aggregates(records: DataFrame) -> DataFrame:
    """Form, table, image and metadata counts per project."""
    no_alt = F.size(F.filter("images", lambda i: F.trim(txt(i["alt"])) == ""))
    return records.groupBy("project_slug").agg(
        F.count("*").alias("pages"),
        F.sum(F.size("forms")).alias("forms"),
        F.sum(F.size("tables")).alias("tables"),
        F.sum(no_alt).alias("images_missing_alt"),
        F.count_if(txt("meta_description") == "").alias("pages_missing_description"),
        F.count_if(txt("title") != "").alias("pages_with_title"),
        F.count_if(txt("meta_description") != "").alias("pages_with_description"),
        F.count_if(F.size("json_ld") > 0).alias("pages_with_jsonld"),
        F.count_if(F.size("iframes") > 0).alias("pages_with_iframes"),
        F.count_if(_searched(False).rlike(PRODUCT_PAGE)).alias("product_pages"),
    )


def overall_maturity(maturity: DataFrame) -> DataFrame:
    """Mean category score per project to one decimal."""
    return maturity.groupBy("project_slug").agg(js_round(F.avg("score"), 1).alias("overall_score"))


def representative_pages(records: DataFrame) -> DataFrame:
    """First page per label; the first page stands in for a missing home page.

    All labels are min_by aggregates of one pass, so nothing is joined to the rules.
    """
    def searched(headings: bool) -> Column:
        parts = [F.col("url"), txt("title")] + ([F.array_join("h1", " ")] if headings else [])
        return F.concat(*parts)

    root = F.coalesce(U.url_path("url") == "/", F.lit(False))
    first = lambda cond: F.min_by(F.when(cond, F.col("url")), F.when(cond, F.col("seq")))
    aggs = [F.coalesce(first(root), F.min_by("url", "seq")).alias("homepage")]
    aggs += [first(searched(h).rlike(p)).alias(label) for label, p, h in PAGE_LABELS]
    labels = ["homepage"] + [label for label, _, _ in PAGE_LABELS]
    wide = records.groupBy("project_slug").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("page_label"), F.col(f"`{n}`").alias("url")) for n in labels])
    return wide.select("project_slug", F.explode(rows).alias("r")).select("project_slug", "r.*").filter("url is not null")


def passing_members(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Members that carry a requested wall height, weakest first.

    ``requests``: request_id, spacing_in, lateral_load_psf, deflection_limit,
    required_height_ft. A request without a positive height is an error; filter
    with `invalid_requests` first to keep going.
    """
    checked = requests.withColumn(
        "required_height_ft",
        F.when(F.col("required_height_ft") > 0, F.col("required_height_ft")).otherwise(
            F.raise_error(F.lit("Wall height must be greater than zero")).cast("double")
        ),
    )
    keys = ["spacing_in", "lateral_load_psf", "deflection_limit"]
    return checked.join(members, keys).filter("max_height_ft >= required_height_ft").select(
        "request_id", "required_height_ft", *keys, "designation", "max_height_ft"
    )


def member_demand(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Per member how many requests it carries and the height it has to spare over them.

    The counts of `passing_members` without its pairs: running sums over the heights of a key in two levels,
    totals of one-foot bins and the rows of a bin, so a key that all rows share is spread over its bins.
    """
    keys = ["spacing_in", "lateral_load_psf", "deflection_limit"]
    ask = requests.select(*keys, F.col("required_height_ft").alias("h"), F.lit(0).alias("member"), F.lit(None).cast("string").alias("designation"))
    have = members.select(*keys, F.col("max_height_ft").alias("h"), F.lit(1).alias("member"), "designation")
    rows = ask.unionByName(have).withColumn("bin", F.floor("h"))
    asked = F.col("member") == 0
    inside = Window.partitionBy(*keys, "bin").orderBy("h", "member").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("n", F.count_if(asked).over(inside)).withColumn("s", F.sum(F.when(asked, F.col("h")).otherwise(0.0)).over(inside)).filter("member = 1")
    bins = rows.groupBy(*keys, "bin").agg(F.count_if(asked).alias("bn"), F.sum(F.when(asked, F.col("h")).otherwise(0.0)).alias("bs"))
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "bin", F.coalesce(F.sum("bn").over(below), F.lit(0)).alias("bn"), F.coalesce(F.sum("bs").over(below), F.lit(0.0)).alias("bs"))
    out = running.join(bins, [*keys, "bin"]).withColumn("requests", F.col("n") + F.col("bn")).filter("requests > 0")
    return out.select(*keys, "designation", F.col("h").alias("max_height_ft"), "requests", (F.col("requests") * F.col("h") - F.col("s") - F.col("bs")).alias("slack"))


def invalid_requests(requests: DataFrame) -> DataFrame:
    return requests.filter(~F.coalesce(F.col("required_height_ft") > 0, F.lit(False)))
