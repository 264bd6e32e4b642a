"""Page records and their child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import urls as U
from pagelattice.functions.core import (
    built_once, collapse_space, compact, first_seen, js_trim, let, strings, txt,
)
from pagelattice.functions.text import (
    FAILED_SUMMARY, common_text_ratio, decode_entities, normalize_text, printable_ratio, strip_control_chars,
    strip_invisible, uncommon_char_ratio,
)
from pagelattice.sources.html import tokenize_html

# Product family terms looked for in page text.
FAMILY_TERMS = [
    "nitrostud", "stud", "track", "joist", "furring", "channel", "clip", "angle", "header", "framing",
]
# Marks of a technology in raw HTML.
TECHNOLOGIES = [
    ("WordPress", "wp-content|wordpress"),
    ("Yoast SEO", "yoast"),
    ("Google Fonts/CDN", "googleapis|gstatic"),
    ("Google Tag Manager/Analytics", r"googletagmanager|gtag\("),
    ("Cloudflare indicators", "cloudflare"),
]
# External links that look like a tool, phone and mail patterns.
TOOL_HREF = "(?i)calculator|configurator|portal|locator|map|tool|submittal|bim|cad"
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
TOOL_NOTE = "Linked external tool candidate; not deeply crawled."


def technology_indicators(html: Column) -> Column:
    return compact(*[F.when(html.rlike("(?i)" + p), F.lit(name)) for name, p in TECHNOLOGIES])


def family_terms(text: Column, terms: list[str] = FAMILY_TERMS) -> Column:
    return let(F.lower(text), lambda t: F.filter(strings(terms), lambda w: F.contains(t, w)))


def phone_numbers(text: Column) -> Column:
    return first_seen(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)))


def email_addresses(text: Column) -> Column:
    return first_seen(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))


def _attr(e: Column, name: str) -> Column:
    return F.element_at(e["attrs"], name)


def _has_class(e: Column, *names: str) -> Column:
    return F.arrays_overlap(F.split(txt(_attr(e, "class")), r"\s+"), strings(list(names)))


def _clean_text(e: Column) -> Column:
    return collapse_space(e["text"])


def _pick(elements: Column, rule) -> Column:
    return F.filter(elements, rule)


def _seqs(elements: Column, rule) -> Column:
    return F.transform(_pick(elements, rule), lambda e: e["seq"])


def _within(elements: Column, x: Column) -> Column:
    """Descendants of an element: the range up to its last one, elements lie in document order."""
    return F.slice(elements, x["seq"] + 2, x["last"] - x["seq"])


def _texts(elements: Column, *tags: str) -> Column:
    return first_seen(F.transform(_pick(elements, lambda e: e["tag"].isin(*tags)), _clean_text))


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def extract_pages(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """Page records from stored HTML.

    ``pages``: project_slug, page_id, seq, url, html. ``projects``: slug,
    approved_hosts. Map-only apart from the join to the project table.
    """
    hosts = projects.select(F.col("slug").alias("project_slug"), "approved_hosts")
    df = pages.join(hosts, "project_slug", "left").select(*_page_columns())
    df = _with_summary(tokenize_html(df))
    for stage in _link_stages():
        df = df.withColumns(stage)
    return df.select(*_record_columns())


@built_once
def _page_columns() -> list:
    pref = U.preferred_host("approved_hosts")
    return [
        "project_slug", "page_id", "seq", F.transform("approved_hosts", U.bare_host).alias("_allowed"), pref.alias("_pref"),
        F.coalesce(U.normalize_url("url", pref), F.col("url")).alias("url"),
        technology_indicators(F.col("html")).alias("technology_indicators"), "html",
    ]


def _absolute(href: Column) -> Column:
    """STRUCT<href, host>: canonical form of a link on the page and its bare host."""
    return U.canonical_link(U.resolve_href(href, F.col("url")), F.col("_pref"))


def _hrefs(rows: Column) -> Column:
    return first_seen(F.transform(rows, lambda x: x["href"]))


@built_once
def _link_stages() -> list[dict[str, Column]]:
    e, links = F.col("elements"), F.col("_links")
    made = F.transform(
        _pick(e, lambda x: (x["tag"] == "a") & txt(_attr(x, "href")).rlike(r"\S")),
        lambda x: F.struct(x["up"].alias("up"), _clean_text(x).alias("text"), _absolute(_attr(x, "href")).alias("at")),
    )
    flat = F.transform(
        F.filter(made, lambda x: x["at"].isNotNull()),
        lambda x: F.struct(
            x["up"].alias("up"), x["text"].alias("text"), x["at"]["href"].alias("href"),
            F.coalesce(F.array_contains("_allowed", x["at"]["host"]), F.lit(False)).alias("internal"),
        ),
    )
    nav = _seqs(e, lambda x: x["tag"].isin("nav", "header") | _has_class(x, "menu") | (_attr(x, "id") == "menu"))
    documents = F.transform(
        _pick(links, lambda x: U.is_document_href(x["href"])),
        lambda x: F.struct(
            x["href"].alias("href"), _blank_to_null(x["text"]).alias("text"), U.file_type_from_href(x["href"]).alias("file_type")
        ),
    )
    return [
        {"_links": flat, "_nav": nav},
        {
            "navigation_links": _hrefs(_pick(links, lambda x: F.arrays_overlap(x["up"], F.col("_nav")))),
            "internal_links": _hrefs(_pick(links, lambda x: x["internal"])),
            "external_links": _hrefs(_pick(links, lambda x: ~x["internal"])),
            "documents": documents,
        },
    ]


@built_once
def _record_columns() -> list:
    e = F.col("elements")
    button = lambda x: (x["tag"] == "button") | (txt(_attr(x, "role")) == "button") | _has_class(x, "btn", "button")
    is_cta = lambda x, n: (x["tag"] == "a") & (
        _has_class(x, "btn", "button") | txt(_attr(x, "class")).contains("cta") | F.arrays_overlap(x["up"], n)
    )
    cta = _seqs(e, lambda x: _has_class(x, "cta"))
    first_attr = lambda rule, name: F.get(F.transform(_pick(e, rule), lambda x: _attr(x, name)), F.lit(0))
    meta = lambda key, value: first_attr(lambda x: (x["tag"] == "meta") & (_attr(x, key) == value), "content")
    doc_type = lambda *t: _hrefs(_pick(F.col("documents"), lambda d: d["file_type"].isin(*t)))
    tools = F.filter(F.col("external_links"), lambda h: h.rlike(TOOL_HREF))
    summary = F.col("_text")
    canonical = first_attr(lambda x: (x["tag"] == "link") & (_attr(x, "rel") == "canonical"), "href")
    return [
        "project_slug", "page_id", "seq", "url",
        F.coalesce(_absolute(canonical)["href"], meta("property", "og:url")).alias("canonical_url"),
        _blank_to_null(F.get(F.transform(_pick(e, lambda x: x["tag"] == "title"), _clean_text), F.lit(0))).alias("title"),
        _blank_to_null(js_trim(meta("name", "description"))).alias("meta_description"),
        _texts(e, "h1").alias("h1"), _texts(e, "h2").alias("h2"), _texts(e, "h3").alias("h3"),
        F.when(summary == "", F.lit(FAILED_SUMMARY)).otherwise(summary).alias("main_text_summary"),
        F.col("_log").alias("text_log"),
        "navigation_links", "internal_links", "external_links",
        first_seen(F.transform(_pick(e, button), _clean_text)).alias("buttons"),
        let(cta, lambda n: first_seen(F.transform(_pick(e, lambda x: is_cta(x, n)), _clean_text))).alias("calls_to_action"),
        _forms(e).alias("forms"), _tables(e).alias("tables"), _images(e).alias("images"),
        first_seen(
            F.transform(
                _pick(e, lambda x: (x["tag"] == "iframe") & _attr(x, "src").isNotNull()),
                lambda x: F.coalesce(_absolute(_attr(x, "src"))["href"], _attr(x, "src")),
            )
        ).alias("iframes"),
        "documents",
        doc_type("pdf").alias("pdf_links"), doc_type("doc", "docx").alias("word_links"),
        doc_type("xls", "xlsx", "csv").alias("spreadsheet_links"), doc_type("dwg", "dxf", "rvt", "ifc").alias("cad_bim_links"),
        family_terms(summary).alias("product_family_terms"),
        phone_numbers(summary).alias("phone_numbers"), email_addresses(summary).alias("email_addresses"),
        F.transform(tools, lambda h: F.struct(h.alias("href"), U.url_host(h).alias("host"))).alias("external_tools"),
        F.transform(_pick(e, lambda x: x["tag"] == "script"), lambda x: x["text"]).alias("json_ld"),
        "technology_indicators",
    ]


def _with_summary(df: DataFrame) -> DataFrame:
    """Adds the page text (main region if it has more than 40 characters, else the
    whole body) cleaned, and what the cleaning found."""
    for stage in _summary_stages():
        df = normalize_text(df, "_cand", "_tq") if stage is None else df.withColumns(stage)
    return df.drop("_cand", "_short", "_back", "_tq", "body_text", "main_text")


@built_once
def _summary_stages() -> list[dict[str, Column] | None]:
    main, c = F.col("main_text"), F.col
    # A failed body falls back on a short main region. Such a text is too short to be
    # salvaged, so the plain measures decide.
    retry = ~c("_tq.ok") & (main != "") & (main != c("_cand")) & ~main.contains(chr(0))
    short = collapse_space(decode_entities(strip_control_chars(strip_invisible(main))))
    fine = (common_text_ratio("_short") >= 0.75) & (uncommon_char_ratio("_short") < 0.05) & (printable_ratio("_short") >= 0.7)
    noted = ~c("_tq.ok") | (F.size("_tq.issues") > 0)
    log = F.struct(
        c("_tq.ok").alias("ok"), c("_tq.issues").alias("issues"), c("_tq.printable_ratio").alias("printable_ratio"),
        c("_tq.common_text_ratio").alias("common_text_ratio"), c("_tq.raw_preserved").alias("raw_preserved"),
        c("_back").alias("recovered_from_main"),
    )
    return [
        {"_cand": F.when(F.length(js_trim(main)) > 40, main).otherwise(c("body_text"))},
        None,
        {"_short": F.when(retry, short)},
        {"_back": F.coalesce(fine, F.lit(False))},
        {"_text": F.when(c("_back"), c("_short")).otherwise(c("_tq.text")), "_log": F.when(noted, log)},
    ]


def _forms(e: Column) -> Column:
    text_at = lambda seq: _blank_to_null(F.get(e, seq)["text"])

    def field(f: Column) -> Column:
        label = F.coalesce(text_at(f["named"]), text_at(f["label"]), _attr(f, "aria-label"))
        return F.struct(
            _attr(f, "name").alias("name"),
            F.coalesce(_blank_to_null(_attr(f, "type")), f["tag"]).alias("type"),
            _blank_to_null(collapse_space(label)).alias("label"),
            _attr(f, "required").isNotNull().alias("required"),
            _attr(f, "placeholder").alias("placeholder"),
        )

    def form(x: Column) -> Column:
        return F.struct(
            _attr(x, "action").alias("action"),
            F.coalesce(_blank_to_null(_attr(x, "method")), F.lit("get")).alias("method"),
            _attr(x, "id").alias("id"), _attr(x, "name").alias("name"),
            F.transform(_pick(_within(e, x), lambda f: f["tag"].isin("input", "select", "textarea")), field).alias("fields"),
        )

    return F.transform(_pick(e, lambda x: x["tag"] == "form"), form)


def _tables(e: Column) -> Column:
    cells_of = lambda x: _pick(_within(e, x), lambda c: c["tag"].isin("th", "td"))

    def table(t: Column) -> Column:
        rows = _pick(_within(e, t), lambda x: x["tag"] == "tr")
        # A cell's head is the innermost first row or head part around it; it counts if it lies in this table.
        headers = F.transform(F.filter(cells_of(t), lambda c: c["head"] > t["seq"]), _clean_text)
        captions = F.transform(_pick(_within(e, t), lambda x: x["tag"] == "caption"), lambda c: c["text"])
        return let(
            F.struct(headers.alias("h"), F.transform(rows, lambda r: F.transform(cells_of(r), _clean_text)).alias("r")),
            lambda k: F.struct(
                _blank_to_null(js_trim(F.array_join(captions, ""))).alias("caption"),
                k["h"].alias("headers"),
                F.greatest(F.lit(0), F.size(k["r"]) - F.when(F.size(k["h"]) > 0, 1).otherwise(0)).alias("row_count"),
                F.slice(k["r"], 2, F.greatest(F.size(k["r"]), F.lit(1))).alias("sample_rows"),
            ),
        )

    return F.transform(_pick(e, lambda x: x["tag"] == "table"), table)


def _images(e: Column) -> Column:
    images = F.transform(
        _pick(e, lambda x: x["tag"] == "img"),
        lambda x: F.struct(
            F.coalesce(
                _absolute(F.coalesce(_blank_to_null(_attr(x, "src")), _attr(x, "data-src")))["href"], txt(_attr(x, "src"))
            ).alias("src"),
            _attr(x, "alt").alias("alt"), _attr(x, "width").alias("width"), _attr(x, "height").alias("height"),
        ),
    )
    return F.filter(images, lambda i: i["src"] != "")


def _child(records: DataFrame, array: str, alias: str) -> DataFrame:
    return records.select("project_slug", "page_id", F.col("url").alias("page_url"), F.posexplode(array).alias("pos", alias))


def page_links(records: DataFrame) -> DataFrame:
    """One row per distinct link of a page: kind internal / external."""
    both = F.concat(
        F.transform("internal_links", lambda h: F.struct(F.lit("internal").alias("kind"), h.alias("href"))),
        F.transform("external_links", lambda h: F.struct(F.lit("external").alias("kind"), h.alias("href"))),
    )
    df = records.select("project_slug", "page_id", F.col("url").alias("page_url"), F.explode(both).alias("l"))
    return df.select("project_slug", "page_id", "page_url", "l.kind", "l.href")


def page_navigation(records: DataFrame) -> DataFrame:
    return _child(records, "navigation_links", "href")


def page_forms(records: DataFrame) -> DataFrame:
    """One row per form field; forms without fields keep one row."""
    df = _child(records, "forms", "f").select("*", F.posexplode_outer("f.fields").alias("field_pos", "fld"))
    return df.select(
        "project_slug", "page_id", "page_url", F.col("pos").alias("form_pos"),
        "f.action", "f.method", F.col("f.id").alias("form_id"), F.col("f.name").alias("form_name"),
        "field_pos", F.col("fld.name").alias("field_name"), F.col("fld.type").alias("field_type"),
        F.col("fld.label").alias("label"), F.col("fld.required").alias("required"),
        F.col("fld.placeholder").alias("placeholder"),
    )


def page_tables(records: DataFrame) -> DataFrame:
    return _child(records, "tables", "t").select("project_slug", "page_id", "page_url", "pos", "t.*")


def page_images(records: DataFrame) -> DataFrame:
    return _child(records, "images", "i").select("project_slug", "page_id", "page_url", "pos", "i.*")


def page_documents(records: DataFrame) -> DataFrame:
    return _child(records, "documents", "d").select("project_slug", "page_id", "page_url", "pos", "d.*")


def page_tools(records: DataFrame) -> DataFrame:
    return _child(records, "external_tools", "t").select(
        "project_slug", "page_id", "page_url", "t.href", "t.host", F.lit(TOOL_NOTE).alias("notes")
    )


def page_jsonld(records: DataFrame) -> DataFrame:
    """JSON-LD blocks, whole, with a flag for those that are no JSON."""
    df = _child(records, "json_ld", "raw").withColumn("doc", F.try_parse_json("raw"))
    return df.select(
        "project_slug", "page_id", "page_url", "pos",
        F.col("doc").isNull().alias("parse_error"),
        F.col("raw").alias("content"),
        F.try_variant_get("doc", "$['@type']", "string").alias("ld_type"),
    )


def text_log(records: DataFrame) -> DataFrame:
    """Pages whose text was not clean."""
    return records.filter("text_log is not null").select("project_slug", "page_id", "url", "text_log.*")


def dedupe_pages(records: DataFrame) -> DataFrame:
    """One record per canonical URL: first position, last content."""
    payload = [c for c in records.columns if c not in ("project_slug", "url", "seq")]
    df = records.groupBy("project_slug", "url").agg(
        F.min("seq").alias("seq"),
        F.max_by(F.struct(*payload), F.col("seq")).alias("p"),
        (F.count("*") - 1).alias("duplicates_collapsed"),
    )
    return df.select("project_slug", "url", "seq", "p.*", "duplicates_collapsed")


def navigation_snapshot(records: DataFrame) -> DataFrame:
    """Links of the first page per project that has navigation."""
    first = (
        records.filter(F.size("navigation_links") > 0)
        .groupBy("project_slug")
        .agg(F.min_by(F.struct("url", "navigation_links"), F.col("seq")).alias("p"))
    )
    return first.select(
        "project_slug", F.col("p.url").alias("source_url"),
        F.posexplode("p.navigation_links").alias("pos", "href"), F.lit(0).alias("depth"),
    )
