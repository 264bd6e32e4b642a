"""Queries over pages and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import reliability as R
from pagelattice.functions import text as T
from pagelattice.functions import urls as U
from pagelattice.operators import frontier, inventory, metrics, pages, redirects
from pagelattice.plans.derived import ctes
from pagelattice.plans.dialect import Duck, Spark
from pagelattice.plans.registry import query, table
from pagelattice.session import written

TRACKING = ", ".join(f"'{p}'" for p in U.TRACKING_PARAMS)


def _web(d: Duck) -> dict[str, tuple[list[str], str]]:
    """Derived web tables, the same SQL for both engines."""
    host = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
    bare = f"regexp_replace({host}, '^www[.]', '')"
    site = f"'https://' || {bare}"
    variants = [
        "url", "url || '#again'", f"{site} || '/cart/' || CAST(page_id AS STRING)", f"{site} || '/files/' || CAST(page_id AS STRING) || '.pdf'",
        f"{site} || '/private/' || CAST(page_id AS STRING)", "'https://elsewhere.example/' || CAST(page_id AS STRING)", f"'mailto:info@' || {bare}",
    ]
    out = {
        "w_pages": ([], f"SELECT page_id, page_id AS seq, url, html, {bare} AS project_slug FROM {d.t('pages')}"),
        "w_candidates": (["w_pages"], " UNION ALL ".join(
            f"SELECT project_slug, page_id * 10 + {i} AS seq, {v} AS url FROM w_pages" for i, v in enumerate(variants))),
        "w_projects": (["w_pages"], "SELECT DISTINCT project_slug AS slug FROM w_pages"),
        "w_robots": (["w_projects"], """SELECT slug AS project_slug, 'User-agent: *' || chr(13) || chr(10) || 'Disallow: /private # inner' || chr(10) || 'Disallow:' || chr(10)
            || 'User-agent: slow' || chr(10) || 'Disallow: /en' || chr(10) || 'Sitemap: https://' || slug || '/sitemap.xml' || chr(10)
            || 'user-agent:*' || chr(10) || 'disallow: /fr/9' AS text FROM w_projects"""),
        "w_sitemaps": (["w_pages"], f"""
            SELECT 'https://' || project_slug || '/sitemap-' || CAST(page_id AS STRING) || '.xml' AS url, '<urlset><url><LOC>' || url || '</LOC></url><url><loc>https://' || project_slug || '/login/' || CAST(page_id AS STRING) || '</loc></url></urlset>' AS xml, project_slug, page_id FROM w_pages"""),
        "w_fetch": (["w_pages"], f"""
            SELECT project_slug, event_id AS seq, url, 1 + CAST(floor(value) AS BIGINT) % 3 AS attempts, event_type <> 'error' AS ok,
              CASE WHEN event_type <> 'error' THEN NULL WHEN value < 10 THEN 'Timeout 45000ms exceeded' WHEN value < 20 THEN 'HTTP 429 Too Many Requests'
                WHEN value < 30 THEN 'Download is starting' WHEN value < 40 THEN 'net::ERR_TOO_MANY_REDIRECTS' WHEN value < 50 THEN 'net::ERR_ABORTED' ELSE 'boom' END AS error
            FROM {d.t('events')} JOIN w_pages ON page_id = user_id"""),
        "w_rich": ([], f"""
            SELECT 'parts' AS project_slug, p_partkey AS page_id, p_partkey AS seq, 'http://www.parts.net/' || slot || '/' || CAST(p_partkey AS STRING) || '/?utm_source=x&v=' || CAST(p_size AS STRING) AS url,
              p_name, p_type, p_brand, p_size, p_partkey, slot,
              '<html><head><title> ' || p_name || chr(10) || '  ' || p_brand || ' </title><meta name="description" content=" ' || CASE WHEN p_size > 40 THEN '' ELSE p_type || ' part' END || ' "><link rel="canonical" href="/c/' || CAST(p_partkey AS STRING) || '/">'
              || '<script type="application/ld+json">' || CASE WHEN p_size > 25 THEN '{{"@type":"' || p_type || '"}}' ELSE '{{broken ' || p_name END || '</script></head><body><nav><a href="/">Home</a><a href="../t">Up</a></nav>'
              || '<h1>' || p_name || '</h1><h2>' || p_type || '</h2><h2>' || p_type || '</h2><main>The ' || p_name || ' is a stud and track part of brand number ' || CAST(p_size AS STRING) || '. Call 555-123-' || lpad(CAST(p_size AS STRING), 4, '0')
              || ' or mail sales' || CAST(p_size AS STRING) || '@parts.net today.</main>'
              || '<form action="/buy" id="f' || CAST(p_size AS STRING) || '"><label for="q">How  many</label><input id="q" name="qty" required><select aria-label="' || p_brand || '" name="brand"></select></form>'
              || '<table><caption>' || p_type || '</caption><tr><th>Size</th><th>Brand</th></tr><tr><td>' || CAST(p_size AS STRING) || '</td><td>' || p_brand || '</td></tr></table>'
              || '<img src="/wp-content/' || p_type || '.png" alt="' || CASE WHEN p_type = 'PROMO' THEN '' ELSE p_name END || '"><img data-src="i/' || CAST(p_size AS STRING) || '.jpg">'
              || '<a class="btn" href="/files/' || lower(p_type) || '.PDF">Get  sheet</a><a href="https://tools.example.org/calculator/' || CAST(p_size AS STRING) || '">Calc</a><a href="bim/' || CAST(p_partkey AS STRING) || '.dwg"> </a>'
              || '<iframe src="//maps.example.org/' || p_type || '"></iframe><button>Buy ' || p_type || '</button></body></html>' AS html
            FROM (SELECT *, CASE p_type WHEN 'PROMO' THEN 'catalog' WHEN 'SMALL' THEN 'document-tools' WHEN 'LARGE' THEN 'contact' ELSE lower(p_type) END AS slot FROM {d.t('part')}) u"""),
    }
    return out


def _df(spark: SparkSession, folder: str, name: str) -> DataFrame:
    d = Spark(folder)
    return spark.sql(f"{ctes(d, [name], _web(d))} SELECT * FROM {name}")


def _sql(names: list[str], body: str) -> str:
    d = Duck()
    return f"{ctes(d, names, _web(d))}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().lstrip('+')}"


def _projects(spark: SparkSession, folder: str) -> DataFrame:
    p = _df(spark, folder, "w_projects")
    return p.select("slug", F.array("slug", F.concat(F.lit("www."), "slug")).alias("approved_hosts"), F.lit(75).alias("max_crawl_pages"))


def _rich_projects(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("parts").alias("slug"), F.array(F.lit("parts.net"), F.lit("www.parts.net")).alias("approved_hosts"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Page records: the HTML is parsed once and written, all page queries read that."""
    src = ["project_slug", "page_id", "seq", "url", "html"]
    return written(spark, (folder, "records"), lambda: pages.extract_pages(_df(spark, folder, "w_pages").select(*src), _projects(spark, folder)))


# Pages that a task makes and parses.
_TASK_PAGES = 2500


class _Dealt(Spark):
    """Tables dealt by their rows: a row of few bytes that makes a page is much work, and by bytes a million of them are read in one task."""

    def __init__(self, folder: str, tasks: int):
        super().__init__(folder)
        self.tasks = tasks

    def t(self, table: str) -> str:
        return f"(SELECT /*+ REPARTITION({self.tasks}) */ * FROM {super().t(table)})"


def _rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    d = _Dealt(folder, max(1, -(-table(spark, folder, "part").count() // _TASK_PAGES)))
    return spark.sql(f"{ctes(d, ['w_rich'], _web(d))} SELECT project_slug, page_id, seq, url, html FROM w_rich")


def _rich(spark: SparkSession, folder: str) -> DataFrame:
    return written(spark, (folder, "rich"), lambda: pages.extract_pages(_rich_pages(spark, folder), _rich_projects(spark)))


# --- SQL pieces of the checks -------------------------------------------------------
def _encode(p: str) -> str:
    return rf"""array_to_string(list_transform(string_split({p}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7e]|["<>`{{}}]') THEN url_encode(c) ELSE c END), '')"""


def _canon(u: str, keep_www: bool = False) -> str:
    host = f"lower(regexp_extract({u}, '^https?://([^/?#]+)', 1))"
    host = host if keep_www else f"regexp_replace({host}, '^www[.]', '')"
    raw = f"regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"
    path = f"CASE WHEN {raw} IN ('', '/') THEN '/' ELSE regexp_replace({_encode(raw)}, '/$', '') END"
    kept = f"list_filter(string_split(regexp_extract({u}, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({TRACKING}))"
    qs = f"array_to_string({kept}, '&')"
    return f"CASE WHEN regexp_matches({u}, '^https?://') THEN 'https://' || {host} || {path} || CASE WHEN {qs} = '' THEN '' ELSE '?' || {qs} END END"


HOST = "regexp_extract({u}, '^https?://([^/?#]+)', 1)"
SKIP_SQL = "regexp_matches({p}, '(?i)/wp-admin|/wp-login|/login|/logout|/account|/cart|/checkout|/my-account|/feed/?$|/xmlrpc[.]php|[.](jpg|jpeg|png|gif|webp|svg|css|js|ico|woff2?)([?]|$)')"
PATH = "regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"


# --- URLs and frontier --------------------------------------------------------------
@query("url_normalize", _sql(["w_pages"], f"SELECT page_id, {_canon('url')} AS canon, {_canon('url', True)} AS canon_www FROM w_pages"))
def url_normalize(spark, folder):
    df = _df(spark, folder, "w_pages")
    own = U.url_host("url")
    return df.select("page_id", U.normalize_url("url").alias("canon"), U.normalize_url("url", own).alias("canon_www"))


@query("url_duplicates", _sql(["w_pages"], f"""
    + c AS (SELECT {_canon('url')} AS canon FROM w_pages)
    SELECT canon, count(*) AS copies FROM c GROUP BY canon"""))
def url_duplicates(spark, folder):
    return _df(spark, folder, "w_pages").groupBy(U.normalize_url("url").alias("canon")).agg(F.count("*").alias("copies"))


@query("url_hosts", _sql(["w_pages"], f"""
    SELECT page_id, lower({HOST.format(u='url')}) AS host, project_slug = regexp_replace(lower({HOST.format(u='url')}), '^www[.]', '') AS allowed,
      regexp_replace(lower({HOST.format(u='url')}), '^www[.]', '') || ',www.' || regexp_replace(lower({HOST.format(u='url')}), '^www[.]', '') AS host_forms,
      project_slug AS preferred, true AS valid FROM w_pages"""))
def url_hosts(spark, folder):
    df = _df(spark, folder, "w_pages").withColumn("hosts", F.array(F.concat(F.lit("www."), "project_slug"), F.col("project_slug")))
    return df.select(
        "page_id", U.url_host("url").alias("host"), U.host_allowed("url", "hosts").alias("allowed"),
        F.array_join(U.hosts_from_url("url"), ",").alias("host_forms"), U.preferred_host("hosts").alias("preferred"), U.is_valid_url("url").alias("valid"),
    )


@query("url_path_rules", _sql(["w_candidates"], f"""
    SELECT seq, NOT regexp_matches(url, '^https?://') OR {SKIP_SQL.format(p=PATH.format(u='url'))} AS skip,
      regexp_matches(url, '(?i)[.](pdf|docx?|xlsx?|csv|dwg|dxf|rvt|ifc)([?]|$)') AS is_document,
      CASE WHEN regexp_extract(lower(url), '[.]([a-z0-9]+)(?:[?]|$)', 1) IN ('pdf','doc','docx','xls','xlsx','csv','dwg','dxf','rvt','ifc') THEN regexp_extract(lower(url), '[.]([a-z0-9]+)(?:[?]|$)', 1) ELSE 'other' END AS file_type
    FROM w_candidates"""))
def url_path_rules(spark, folder):
    df = _df(spark, folder, "w_candidates")
    return df.select("seq", U.should_skip_path("url").alias("skip"), U.is_document_href("url").alias("is_document"), U.file_type_from_href("url").alias("file_type"))


FETCH_KIND = """CASE WHEN error IS NULL THEN 'other' WHEN contains(lower(error), 'download is starting') THEN 'download' WHEN regexp_matches(lower(error), '429|rate.?limit|too many requests') THEN 'rate_limit'
    WHEN regexp_matches(lower(error), 'timeout|timed out') THEN 'timeout' WHEN contains(lower(error), 'redirect') THEN 'redirect_loop' ELSE 'other' END"""


@query("fetch_errors", _sql(["w_fetch"], f"""
    SELECT {FETCH_KIND} AS kind, coalesce({FETCH_KIND} IN ('rate_limit', 'timeout', 'redirect_loop') OR regexp_matches(lower(error), 'net::err_|econnreset|socket') AND {FETCH_KIND} = 'other', false) AS retryable, count(*) AS n
    FROM w_fetch GROUP BY ALL"""))
def fetch_errors(spark, folder):
    df = _df(spark, folder, "w_fetch").select(U.classify_fetch_error("error").alias("e"))
    return df.groupBy("e.kind", "e.retryable").agg(F.count("*").alias("n"))


@query("fetch_outcomes", _sql(["w_fetch"], f"""
    SELECT project_slug, count(*) AS pages_attempted, CAST(sum(attempts - 1) AS BIGINT) AS retries, count_if(attempts > 1 AND ok) AS retry_successes, count_if(NOT ok) AS permanent_failures,
      count_if(NOT ok AND {FETCH_KIND} = 'download') AS download_blocked, count_if(NOT ok AND {FETCH_KIND} = 'rate_limit') AS rate_limited, count_if(NOT ok AND {FETCH_KIND} = 'timeout') AS timeouts
    FROM w_fetch GROUP BY project_slug"""))
def fetch_outcomes(spark, folder):
    return frontier.fetch_outcomes(_df(spark, folder, "w_fetch"))


@query("failure_samples", _sql(["w_fetch"], f"""
    SELECT * FROM (SELECT project_slug, CAST(row_number() OVER (PARTITION BY project_slug ORDER BY seq, url) AS INTEGER) AS rn, url, error, {FETCH_KIND} AS kind FROM w_fetch WHERE NOT ok)"""))
def failure_samples(spark, folder):
    return frontier.failure_samples(_df(spark, folder, "w_fetch"))


@query("robots_rules", _sql(["w_robots"], "SELECT project_slug, '/private,/fr/9' AS disallow, 'https://' || project_slug || '/sitemap.xml' AS sitemaps FROM w_robots"))
def robots_rules(spark, folder):
    r = frontier.robots_table(_df(spark, folder, "w_robots"))
    return r.select("project_slug", F.array_join("disallow", ",").alias("disallow"), F.array_join("sitemaps", ",").alias("sitemaps"))


@query("robots_gate", _sql(["w_pages"], f"""
    SELECT page_id, NOT ({PATH.format(u='url')} LIKE '/private%' OR {PATH.format(u='url')} LIKE '/fr/9%') AS allowed FROM w_pages"""))
def robots_gate(spark, folder):
    rules = frontier.robots_table(_df(spark, folder, "w_robots"))
    return _df(spark, folder, "w_pages").join(rules, "project_slug").select("page_id", U.robots_allowed("url", "disallow").alias("allowed"))


_VERDICT = f"""
    + c AS (SELECT project_slug, seq, url, {_canon('url', True)} AS raw FROM w_candidates),
    n AS (SELECT project_slug, seq, url, CASE WHEN raw IS NOT NULL AND split_part(raw, '/', 3) = 'www.' || project_slug THEN replace(raw, 'https://www.', 'https://') ELSE raw END AS canon FROM c),
    v AS (SELECT *, CASE WHEN canon IS NULL THEN 'invalid' WHEN split_part(canon, '/', 3) <> project_slug THEN 'host' WHEN {SKIP_SQL.format(p=PATH.format(u='canon'))} THEN 'skip_path'
      WHEN regexp_matches(canon, '(?i)[.](pdf|docx?|xlsx?|csv|dwg|dxf|rvt|ifc)([?]|$)') THEN 'document'
      WHEN {PATH.format(u='canon')} LIKE '/private%' OR {PATH.format(u='canon')} LIKE '/fr/9%' THEN 'robots' ELSE 'admit' END AS verdict FROM n),
    f AS (SELECT project_slug, seq, url, canon, CASE WHEN verdict = 'admit' AND row_number() OVER (PARTITION BY project_slug, canon, verdict ORDER BY seq) > 1 THEN 'duplicate' ELSE verdict END AS verdict FROM v)"""


def _verdicts(spark, folder):
    rules = frontier.robots_table(_df(spark, folder, "w_robots"))
    return frontier.frontier_gate(_df(spark, folder, "w_candidates"), _projects(spark, folder), rules)


@query("frontier_gate", _sql(["w_candidates"], _VERDICT + " SELECT * FROM f"))
def frontier_gate(spark, folder):
    return _verdicts(spark, folder)


_LINKS = f"""
    + raw AS (SELECT project_slug, page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, 'https://' || project_slug AS origin FROM w_pages),
    lk AS (SELECT DISTINCT project_slug, page_id, CASE WHEN regexp_matches(href, '^https?://') THEN {_canon('href')} ELSE {_canon("(origin || href)")} END AS href FROM raw)"""


@query("page_links", _sql(["w_pages"], _LINKS + " SELECT project_slug, page_id, CASE WHEN split_part(href, '/', 3) = project_slug THEN 'internal' ELSE 'external' END AS kind, href FROM lk"))
def page_links(spark, folder):
    return pages.page_links(_records(spark, folder)).select("project_slug", "page_id", "kind", "href")


_NEXT = _LINKS + f""", seen AS (SELECT DISTINCT project_slug, {_canon('url')} AS url FROM w_pages),
    ok AS (SELECT project_slug, href AS url, min(page_id) AS seq FROM lk WHERE split_part(href, '/', 3) = project_slug AND NOT {SKIP_SQL.format(p=PATH.format(u='href'))}
      AND NOT ({PATH.format(u='href')} LIKE '/private%' OR {PATH.format(u='href')} LIKE '/fr/9%') GROUP BY ALL),
    fresh AS (SELECT * FROM ok ANTI JOIN seen USING (project_slug, url)), used AS (SELECT project_slug, count(*) AS n FROM seen GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY project_slug ORDER BY seq, url) AS rn FROM fresh)
    SELECT project_slug, url, seq FROM ranked JOIN used USING (project_slug) WHERE rn <= 75 - n"""


def _page_edges(spark, folder):
    rec = _records(spark, folder)
    return rec.select("project_slug", "seq", F.col("url").alias("from_url"), F.explode("internal_links").alias("href"))


@query("next_frontier", _sql(["w_pages"], _NEXT))
def next_frontier(spark, folder):
    seen = _df(spark, folder, "w_pages").select("project_slug", U.normalize_url("url").alias("url"))
    rules = frontier.robots_table(_df(spark, folder, "w_robots"))
    return frontier.next_frontier(_page_edges(spark, folder), seen, _projects(spark, folder), rules)


@query("link_reach", _sql(["w_pages"], _LINKS + f""", e AS (SELECT DISTINCT w.project_slug, {_canon('w.url')} AS f, lk.href AS t FROM w_pages w JOIN lk USING (project_slug, page_id) WHERE split_part(lk.href, '/', 3) = w.project_slug),
    s AS (SELECT project_slug, arg_min(u, page_id) AS url FROM (SELECT project_slug, page_id, {_canon('url')} AS u FROM w_pages) GROUP BY 1),
    h1 AS (SELECT DISTINCT e.project_slug, t AS url FROM e JOIN s ON e.project_slug = s.project_slug AND f = url),
    h2 AS (SELECT DISTINCT e.project_slug, t AS url FROM e JOIN h1 ON e.project_slug = h1.project_slug AND f = url)
    SELECT project_slug, url, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT *, 0 AS hops FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2"""))
def link_reach(spark, folder):
    edges = _page_edges(spark, folder).select("project_slug", "from_url", F.col("href").alias("to_url"))
    seeds = _df(spark, folder, "w_pages").groupBy("project_slug").agg(F.min_by(U.normalize_url("url"), F.col("page_id")).alias("url"))
    return frontier.link_reach(edges, seeds, 2)


@query("sitemap_seeds", _sql(["w_pages"], f"SELECT DISTINCT project_slug, {_canon('url')} AS url FROM w_pages"))
def sitemap_seeds(spark, folder):
    maps = _df(spark, folder, "w_sitemaps")
    # An index file for each sitemap of a host; nothing gathers a host.
    at = F.concat(F.lit("https://"), "project_slug", F.lit("/sitemap-index-"), F.md5("url"), F.lit(".xml"))
    index = maps.select(at.alias("url"), F.concat(F.lit("<loc>"), "url", F.lit("</loc>")).alias("xml"))
    seeds = maps.select("project_slug", at.alias("sitemap_url"))
    return frontier.sitemap_seeds(maps.select("url", "xml").unionByName(index), seeds, _projects(spark, folder))


# --- Pages ----------------------------------------------------------------------------
_UNESC = lambda x: f"replace(replace(replace({x}, '&quot;', '\"'), '&middot;', chr(183)), '&amp;', '&')"


@query("page_titles", _sql(["w_pages"], f"""
    SELECT page_id, {_canon('url')} AS url, trim(regexp_replace({_UNESC("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) AS title,
      trim(regexp_replace({_UNESC("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '\\s+', ' ', 'g')) AS h1,
      CAST(len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS INTEGER) AS links FROM w_pages"""))
def page_titles(spark, folder):
    r = _records(spark, folder)
    return r.select("page_id", "url", "title", F.array_join("h1", "|").alias("h1"), F.size(F.array_union("internal_links", "external_links")).alias("links"))


@query("page_navigation", _sql(["w_pages"], f"""
    + raw AS (SELECT project_slug, page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS hs FROM w_pages),
    u AS (SELECT project_slug, page_id, unnest(list_transform(hs, lambda h: 'https://' || project_slug || {_encode('h')})) AS href FROM raw)
    SELECT DISTINCT project_slug, page_id, CASE WHEN regexp_matches(href, '/$') AND length(href) > length('https://' || project_slug || '/') THEN regexp_replace(href, '/$', '') ELSE href END AS href FROM u"""))
def page_navigation(spark, folder):
    return pages.page_navigation(_records(spark, folder)).select("project_slug", "page_id", "href")


@query("navigation_snapshot", _sql(["w_pages"], f"""
    + first AS (SELECT project_slug, arg_min(page_id, page_id) AS page_id FROM w_pages WHERE regexp_matches(html, '<nav>.*<a href') GROUP BY 1)
    SELECT project_slug, {_canon('url')} AS source_url, CAST(len(list_distinct(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1))) AS BIGINT) AS items
    FROM w_pages JOIN first USING (project_slug, page_id)"""))
def navigation_snapshot(spark, folder):
    return pages.navigation_snapshot(_records(spark, folder)).groupBy("project_slug", "source_url").agg(F.count("*").alias("items"))


@query("page_dedupe", _sql(["w_pages"], f"""
    + c AS (SELECT project_slug, page_id, {_canon('url')} AS url FROM w_pages)
    SELECT project_slug, url, min(page_id) AS seq, arg_max(page_id, page_id) AS kept_page, count(*) - 1 AS duplicates_collapsed FROM c GROUP BY 1, 2"""))
def page_dedupe(spark, folder):
    d = pages.dedupe_pages(_records(spark, folder))
    return d.select("project_slug", "url", "seq", F.col("page_id").alias("kept_page"), "duplicates_collapsed")


@query("tech_indicators", _sql(["w_rich"], """
    SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '(?i)wp-content|wordpress') THEN 'WordPress' END, CASE WHEN regexp_matches(html, '(?i)yoast') THEN 'Yoast SEO' END,
      CASE WHEN regexp_matches(html, '(?i)googleapis|gstatic') THEN 'Google Fonts/CDN' END], lambda x: x IS NOT NULL), ',') AS technologies FROM w_rich"""))
def tech_indicators(spark, folder):
    return _df(spark, folder, "w_rich").select("page_id", F.array_join(pages.technology_indicators(F.col("html")), ",").alias("technologies"))


_RICH_URL = "'https://parts.net/' || slot || '/' || CAST(p_partkey AS STRING) || '?v=' || CAST(p_size AS STRING)"


@query("rich_records", _sql(["w_rich"], f"""
    SELECT page_id, {_RICH_URL} AS url, 'https://parts.net/c/' || CAST(p_partkey AS STRING) AS canonical_url, p_name || ' ' || p_brand AS title,
      CASE WHEN p_size > 40 THEN NULL ELSE p_type || ' part' END AS meta_description, p_name AS h1, p_type AS h2,
      'Get sheet|Buy ' || p_type AS buttons, 'Get sheet' AS calls_to_action, 'https://maps.example.org/' || p_type AS iframes,
      'The ' || p_name || ' is a stud and track part of brand number ' || CAST(p_size AS STRING) || '. Call 555-123-' || lpad(CAST(p_size AS STRING), 4, '0') || ' or mail sales' || CAST(p_size AS STRING) || '@parts.net today.' AS summary,
      'stud,track' AS families, '555-123-' || lpad(CAST(p_size AS STRING), 4, '0') AS phones, 'sales' || CAST(p_size AS STRING) || '@parts.net' AS emails FROM w_rich"""))
def rich_records(spark, folder):
    r = _rich(spark, folder)
    join = lambda c, s="|": F.array_join(c, s).alias(c)
    return r.select(
        "page_id", "url", "canonical_url", "title", "meta_description", join("h1"), join("h2"), join("buttons"), join("calls_to_action"), join("iframes"),
        F.col("main_text_summary").alias("summary"), F.array_join("product_family_terms", ",").alias("families"),
        F.array_join("phone_numbers", ",").alias("phones"), F.array_join("email_addresses", ",").alias("emails"),
    )


@query("rich_forms", _sql(["w_rich"], """
    SELECT page_id, '/buy' AS action, 'get' AS method, 'f' || CAST(p_size AS STRING) AS form_id, 'qty' AS field_name, 'input' AS field_type, 'How many' AS label, true AS required FROM w_rich
    UNION ALL SELECT page_id, '/buy', 'get', 'f' || CAST(p_size AS STRING), 'brand', 'select', p_brand, false FROM w_rich"""))
def rich_forms(spark, folder):
    return pages.page_forms(_rich(spark, folder)).select("page_id", "action", "method", "form_id", "field_name", "field_type", "label", "required")


@query("rich_tables", _sql(["w_rich"], "SELECT page_id, p_type AS caption, 'Size,Brand' AS headers, CAST(1 AS INTEGER) AS row_count, CAST(p_size AS STRING) || ',' || p_brand AS first_row FROM w_rich"))
def rich_tables(spark, folder):
    t = pages.page_tables(_rich(spark, folder))
    return t.select("page_id", "caption", F.array_join("headers", ",").alias("headers"), "row_count", F.array_join(F.get("sample_rows", F.lit(0)), ",").alias("first_row"))


@query("rich_images", _sql(["w_rich"], """
    SELECT page_id, 'https://parts.net/wp-content/' || p_type || '.png' AS src, CASE WHEN p_type = 'PROMO' THEN '' ELSE p_name END AS alt FROM w_rich
    UNION ALL SELECT page_id, 'https://parts.net/' || slot || '/i/' || CAST(p_size AS STRING) || '.jpg', NULL FROM w_rich"""))
def rich_images(spark, folder):
    return pages.page_images(_rich(spark, folder)).select("page_id", "src", "alt")


@query("rich_documents", _sql(["w_rich"], f"""
    SELECT page_id, 'https://parts.net/files/' || lower(p_type) || '.PDF' AS href, 'Get sheet' AS title, 'pdf' AS file_type, {_RICH_URL} AS source_page_url FROM w_rich
    UNION ALL SELECT page_id, 'https://parts.net/' || slot || '/bim/' || CAST(p_partkey AS STRING) || '.dwg', CAST(p_partkey AS STRING) || '.dwg', 'dwg', {_RICH_URL} FROM w_rich"""))
def rich_documents(spark, folder):
    docs = pages.page_documents(_rich(spark, folder))
    inv = inventory.document_inventory(docs)
    key = docs.select("page_id", F.col("page_url").alias("source_page_url")).distinct()
    return inv.join(key, "source_page_url").select("page_id", "href", "title", "file_type", "source_page_url")


@query("rich_link_lists", _sql(["w_rich"], """
    SELECT page_id, 'https://parts.net/files/' || lower(p_type) || '.PDF' AS pdf, '' AS word, '' AS spreadsheet, 'https://parts.net/' || slot || '/bim/' || CAST(p_partkey AS STRING) || '.dwg' AS cad_bim FROM w_rich"""))
def rich_link_lists(spark, folder):
    j = lambda c: F.array_join(c, ",")
    return _rich(spark, folder).select("page_id", j("pdf_links").alias("pdf"), j("word_links").alias("word"), j("spreadsheet_links").alias("spreadsheet"), j("cad_bim_links").alias("cad_bim"))


@query("rich_tools", _sql(["w_rich"], "SELECT page_id, 'https://tools.example.org/calculator/' || CAST(p_size AS STRING) AS href, 'tools.example.org' AS host FROM w_rich"))
def rich_tools(spark, folder):
    return pages.page_tools(_rich(spark, folder)).select("page_id", "href", "host")


@query("rich_jsonld", _sql(["w_rich"], """
    SELECT page_id, p_size <= 25 AS parse_error, CASE WHEN p_size > 25 THEN '{"@type":"' || p_type || '"}' ELSE '{broken ' || p_name END AS content, CASE WHEN p_size > 25 THEN p_type END AS ld_type FROM w_rich"""))
def rich_jsonld(spark, folder):
    return pages.page_jsonld(_rich(spark, folder)).select("page_id", "parse_error", "content", "ld_type")


@query("page_text_log")
def page_text_log(spark, folder):
    return pages.text_log(_records(spark, folder)).select("project_slug", "url", "ok", F.array_join("issues", ",").alias("issues"))


@query("crawl_health", _sql(["w_candidates", "w_fetch"], _VERDICT + f""",
    g AS (SELECT project_slug, count_if(verdict = 'robots') AS robots_skipped, count_if(verdict = 'document') AS document_links_skipped, count_if(verdict = 'duplicate') AS queue_duplicates_skipped FROM f GROUP BY 1),
    o AS (SELECT project_slug, count(*) AS pages_attempted, count_if(NOT ok) AS permanent_failures FROM w_fetch GROUP BY 1),
    u AS (SELECT project_slug, {_canon('url')} AS url, count(*) AS n FROM w_pages GROUP BY 1, 2), p AS (SELECT project_slug, count(*) AS pages_succeeded, CAST(sum(n - 1) AS BIGINT) AS duplicates_collapsed FROM u GROUP BY 1)
    SELECT project_slug, coalesce(robots_skipped, 0) AS robots_skipped, coalesce(document_links_skipped, 0) AS document_links_skipped, coalesce(queue_duplicates_skipped, 0) AS queue_duplicates_skipped,
      coalesce(pages_attempted, 0) AS pages_attempted, coalesce(permanent_failures, 0) AS permanent_failures, coalesce(pages_succeeded, 0) AS pages_succeeded, coalesce(duplicates_collapsed, 0) AS duplicates_collapsed
    FROM g FULL JOIN o USING (project_slug) FULL JOIN p USING (project_slug)"""))
def crawl_health(spark, folder):
    h = frontier.crawl_health(_verdicts(spark, folder), _df(spark, folder, "w_fetch"), _records(spark, folder))
    return h.select("project_slug", "robots_skipped", "document_links_skipped", "queue_duplicates_skipped", "pages_attempted", "permanent_failures", "pages_succeeded", "duplicates_collapsed")


# --- Inventories ------------------------------------------------------------------------
@query("homepages", _sql(["w_pages"], f"""
    + c AS (SELECT project_slug, page_id, {_canon('url')} AS url, {PATH.format(u='url')} IN ('', '/') AS root FROM w_pages)
    SELECT project_slug, arg_min(url, CASE WHEN root THEN page_id ELSE page_id + 1000000000 END) AS url, bool_or(root) AS is_root FROM c GROUP BY 1"""))
def homepages(spark, folder):
    return inventory.homepages(_records(spark, folder)).select("project_slug", "url", "is_root")


@query("project_contacts", _sql(["w_rich"], """
    + v AS (SELECT 'phone' AS kind, '555-123-' || lpad(CAST(p_size AS STRING), 4, '0') AS value, page_id FROM w_rich UNION ALL SELECT 'email', 'sales' || CAST(p_size AS STRING) || '@parts.net', page_id FROM w_rich)
    SELECT kind, value, min(page_id) AS first_page FROM v GROUP BY 1, 2"""))
def project_contacts(spark, folder):
    r = _rich(spark, folder)
    phones = inventory.project_values(r, "phone_numbers").select(F.lit("phone").alias("kind"), "value", F.col("seq").alias("first_page"))
    return phones.unionByName(inventory.project_values(r, "email_addresses").select(F.lit("email").alias("kind"), "value", F.col("seq").alias("first_page")))


@query("profile_facts", _sql(["w_rich"], f"""
    + home AS (SELECT arg_min({_RICH_URL}, page_id) AS url FROM w_rich), v AS (SELECT 'Phone number observed on public pages: 555-123-' || lpad(CAST(p_size AS STRING), 4, '0') AS claim, min(page_id) AS p, 'phone' AS k FROM w_rich GROUP BY 1
      UNION ALL SELECT 'Email address observed on public pages: sales' || CAST(p_size AS STRING) || '@parts.net', min(page_id), 'email' FROM w_rich GROUP BY 1),
    r AS (SELECT claim, row_number() OVER (PARTITION BY k ORDER BY p) AS rn FROM v)
    SELECT 'contacts' AS section, claim, url AS source_url, 'medium' AS confidence, 'fact' AS kind FROM r, home
    UNION ALL SELECT 'offerings', 'Public positioning describes a lightweight / cold-formed steel framing manufacturer and fabricator.', url, 'high', 'fact' FROM home
    UNION ALL SELECT 'audiences', 'Site language targets construction professionals and distribution partners (distributors listed publicly).', url, 'medium', 'inference' FROM home"""))
def profile_facts(spark, folder):
    r = _rich(spark, folder)
    home = inventory.homepages(r)
    facts = inventory.rule_facts(home).unionByName(inventory.contact_facts(r, home))
    return facts.select("section", "claim", "source_url", "confidence", "kind")


@query("company_profiles", _sql(["w_rich"], f"""
    SELECT 'Parts' AS company_name, arg_min({_RICH_URL}, page_id) AS home_url,
      arg_min('The ' || p_name || ' is a stud and track part of brand number ' || CAST(p_size AS STRING) || '. Call 555-123-' || lpad(CAST(p_size AS STRING), 4, '0') || ' or mail sales' || CAST(p_size AS STRING) || '@parts.net today.', page_id) AS summary, true AS summary_ok FROM w_rich"""))
def company_profiles(spark, folder):
    p = _rich_projects(spark).select("*", F.lit("Parts").alias("name"), F.lit("https://parts.net/").alias("website_url"), F.lit("parts").alias("industry"))
    return inventory.company_profiles(_rich(spark, folder), p).select("company_name", "home_url", "summary", "summary_ok")


@query("product_inventory", _sql(["w_rich"], f"SELECT page_id AS seq, p_name AS name, 'stud' AS family, {_RICH_URL} AS source_url, 'https://parts.net/files/' || lower(p_type) || '.PDF' AS documents FROM w_rich WHERE regexp_matches({_RICH_URL} || ' ' || p_name || ' ' || p_brand, '(?i)product|stud|track|joist|nitro|framing|catalog')"))
def product_inventory(spark, folder):
    return inventory.product_inventory(_rich(spark, folder)).select("seq", "name", "family", "source_url", F.array_join("documents", ",").alias("documents"))


@query("audit_aggregates", _sql(["w_rich"], """
    SELECT project_slug, count(*) AS pages, count(*) AS forms, count(*) AS tables, count(*) + count_if(p_type = 'PROMO') AS images_missing_alt, count_if(p_size > 40) AS pages_missing_description,
      count(*) AS pages_with_title, count_if(p_size <= 40) AS pages_with_description, count(*) AS pages_with_jsonld, count(*) AS pages_with_iframes FROM w_rich GROUP BY 1"""))
def audit_aggregates(spark, folder):
    return inventory.audit_aggregates(_rich(spark, folder)).drop("product_pages")


def _label_sql() -> str:
    out = []
    for label, pattern, heads in inventory.PAGE_LABELS:
        text = f"{_RICH_URL} || p_name || ' ' || p_brand" + (" || p_name" if heads else "")
        out.append(f"SELECT '{label}' AS page_label, arg_min({_RICH_URL}, page_id) AS url FROM w_rich WHERE regexp_matches({text}, '{pattern}')")
    out.append(f"SELECT 'homepage', arg_min({_RICH_URL}, page_id) FROM w_rich")
    return "SELECT * FROM (" + " UNION ALL ".join(out) + ") WHERE url IS NOT NULL"


@query("representative_pages", _sql(["w_rich"], _label_sql()))
def representative_pages(spark, folder):
    return inventory.representative_pages(_rich(spark, folder)).select("page_label", "url")


@query("member_lookup", """
    WITH m AS (SELECT DISTINCT p_brand || '/' || p_name AS designation, p_type AS deflection_limit, CAST(p_size AS DOUBLE) AS max_height_ft FROM part),
    r AS (SELECT o_orderkey AS request_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'PROMO' WHEN '2-HIGH' THEN 'LARGE' ELSE 'SMALL' END AS deflection_limit, 1 + o_totalprice / 10000 AS required_height_ft FROM orders)
    SELECT deflection_limit, designation, count(*) AS requests, round(sum(max_height_ft - required_height_ft), 2) AS slack FROM r JOIN m USING (deflection_limit) WHERE max_height_ft >= required_height_ft GROUP BY 1, 2""")
def member_lookup(spark, folder):
    fixed = [F.lit(16.0).alias("spacing_in"), F.lit(5.0).alias("lateral_load_psf")]
    members = table(spark, folder, "part").select(
        F.concat_ws("/", "p_brand", "p_name").alias("designation"), F.col("p_type").alias("deflection_limit"), F.col("p_size").cast("double").alias("max_height_ft"), *fixed).distinct()
    limit = F.when(F.col("o_orderpriority") == "1-URGENT", "PROMO").when(F.col("o_orderpriority") == "2-HIGH", "LARGE").otherwise("SMALL")
    requests = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"), limit.alias("deflection_limit"), (1 + F.col("o_totalprice") / 10000).alias("required_height_ft"), *fixed)
    demand = inventory.member_demand(members, requests)
    return demand.groupBy("deflection_limit", "designation").agg(F.sum("requests").alias("requests"), F.round(F.sum("slack"), 2).alias("slack"))


# --- Text -------------------------------------------------------------------------------
_COMMON = r"\t\n\r\x20-\x7e\x{A0}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}\x{2026}"
_N16 = r"(length(t) + length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"
_RATIOS = rf"""
    CASE WHEN t = '' THEN 1.0 ELSE round(length(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) / {_N16}, 6) END AS printable,
    CASE WHEN t = '' THEN 1.0 ELSE round(length(regexp_replace(t, '[^{_COMMON}]', '', 'g')) / {_N16}, 6) END AS common,
    CASE WHEN t = '' THEN 0.0 ELSE round(length(regexp_replace(t, '[{_COMMON}]', '', 'g')) / {_N16}, 6) END AS uncommon"""
# Documents damaged in known ways: a foreign run in front, a control character inside,
# entities, or zero-width characters, by language.
_RUN = chr(1041) + chr(1080) + " "
_DAMAGE = f"""SELECT doc_id, lang, CASE lang WHEN 'fr' THEN repeat('{_RUN}', 40) || text WHEN 'de' THEN text || chr(7) || ' &amp;lt; &#65;&#x42; &nbsp;end'
    WHEN 'es' THEN '{chr(0x200B)}' || text || '{chr(0xFFFD)}' ELSE text END AS t FROM {{documents}}"""


def _damaged(spark, folder):
    return spark.sql(_DAMAGE.format(documents=Spark(folder).t("documents")))


@query("text_ratios", f"WITH d AS ({_DAMAGE.format(documents='documents')}) SELECT doc_id, {_RATIOS} FROM d")
def text_ratios(spark, folder):
    r = lambda c, n: F.round(c, 6).alias(n)
    return _damaged(spark, folder).select("doc_id", r(T.printable_ratio("t"), "printable"), r(T.common_text_ratio("t"), "common"), r(T.uncommon_char_ratio("t"), "uncommon"))


@query("text_entities", f"""WITH d AS ({_DAMAGE.format(documents='documents')})
    SELECT doc_id, CASE lang WHEN 'de' THEN md5(replace(t, '&amp;lt; &#65;&#x42; &nbsp;end', '< AB  end')) ELSE md5(replace(replace(t, '&nbsp;', ' '), '&amp;', '&')) END AS decoded FROM d""")
def text_entities(spark, folder):
    return _damaged(spark, folder).select("doc_id", F.md5(T.decode_entities("t")).alias("decoded"))


@query("text_flags", rf"""WITH d AS ({_DAMAGE.format(documents='documents')})
    SELECT doc_id, regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') AS control, contains(t, chr(65533)) AS replacement, length(t) - length(regexp_replace(t, '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]', '', 'g')) AS invisible FROM d""")
def text_flags(spark, folder):
    return _damaged(spark, folder).select("doc_id", T.has_control_chars("t").alias("control"), T.has_replacement_char("t").alias("replacement"), (F.length("t") - F.length(T.strip_invisible("t"))).cast("bigint").alias("invisible"))


_TOKEN = r"""(regexp_matches(x, '^[\d$\x{20AC}\x{A3}\x{A5}%+./:\-]+$') OR regexp_matches(x, '^(?i:https?://|www\.)\S+$') OR regexp_matches(x, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$')
    OR regexp_matches(x, '^[A-Za-z][A-Za-z0-9''\x{2019}&+./\-]{0,40}[A-Za-z0-9]?[.:;,!?]?$') OR regexp_matches(x, '^[&\-\x{2014}/|\x{2022}()\[\]]$'))"""


@query("english_tokens", rf"""WITH d AS ({_DAMAGE.format(documents='documents')}), k AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '[\s\x0B\x{{A0}}\x{{FEFF}}\x{{2028}}\x{{2029}}\x{{3000}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{1680}}]+'), lambda y: y <> '')) AS x FROM d)
    SELECT doc_id, count(*) AS tokens, count_if({_TOKEN}) AS english FROM k GROUP BY doc_id""")
def english_tokens(spark, folder):
    toks = F.filter(F.split("t", f"[{T.JS_SPACE}]+"), lambda x: x != "")
    df = _damaged(spark, folder).select("doc_id", toks.alias("k")).filter(F.size("k") > 0)
    return df.select("doc_id", F.size("k").cast("bigint").alias("tokens"), F.size(F.filter("k", T.is_english_like)).cast("bigint").alias("english"))


_WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_UNC = lambda t: rf"(length(regexp_replace({t}, '[{_COMMON}]', '', 'g')) / greatest(1, length({t}) + length(regexp_replace({t}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))))"
_COM = lambda t: f"(CASE WHEN {t} = '' THEN 1.0 ELSE length(regexp_replace({t}, '[^{_COMMON}]', '', 'g')) / (length({t}) + length(regexp_replace({t}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) END)"
_QUALITY = rf"""WITH d AS ({_DAMAGE.format(documents='documents')}),
    v AS (SELECT doc_id, lang, t AS raw, regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') AS ctl, contains(t, chr(65533)) AS rep,
      regexp_replace(t, '[\x{{FFFD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM d),
    e AS (SELECT * REPLACE (CASE lang WHEN 'de' THEN replace(t, '&amp;lt; &#65;&#x42; &nbsp;end', '< AB  end') ELSE replace(replace(t, '&nbsp;', ' '), '&amp;', '&') END AS t) FROM v),
    c AS (SELECT * REPLACE (trim(regexp_replace(t, '{_WS}', ' ', 'g')) AS t) FROM e),
    m AS (SELECT *, {_UNC('t')} AS u0, {_COM('t')} AS c0, {_UNC('substr(t, 1, 240)')} AS uh, {_COM('substr(t, 1, 240)')} AS ch, length(t) AS n FROM c),
    f AS (SELECT *, c0 < 0.85 AND n > 20 AS low, uh >= 0.08 OR u0 >= 0.04 AS dense FROM m),
    k AS (SELECT *, list_filter(string_split(t, ' '), lambda y: y <> '') AS tok FROM f),
    g AS (SELECT *, array_to_string(list_transform(tok, lambda x: CASE WHEN {_TOKEN} THEN '1' ELSE '0' END), '') AS fl FROM k),
    o AS (SELECT *, CASE WHEN (low OR ctl OR dense) AND (uh >= 0.08 OR u0 >= 0.04 OR ch < 0.9) AND len(tok) >= 6 AND regexp_matches(fl, '[01]1111|1[01]111|11[01]11|111[01]1|1111[01]')
        THEN length(regexp_extract(fl, '^(.*?)(?:[01]1111|1[01]111|11[01]11|111[01]1|1111[01])', 1)) + 1 END AS onset FROM g),
    p AS (SELECT *, onset + instr(substr(fl, onset), '1') - 1 AS st FROM o),
    q AS (SELECT *, array_to_string(list_filter(list_transform(range(1, len(tok) + 1), lambda i: CASE WHEN i >= st AND (length(tok[i]) <= 2 OR substr(fl, i, 1) = '1' OR {_COM('tok[i]')} >= 0.85) THEN tok[i] END), lambda y: y IS NOT NULL), ' ') AS cut FROM p),
    s AS (SELECT *, onset IS NOT NULL AND length(cut) >= 40 AND {_UNC('cut')} < u0 AND {_COM('cut')} >= 0.9 AS sal FROM q),
    z AS (SELECT *, CASE WHEN sal THEN cut ELSE t END AS txt, CASE WHEN sal THEN {_COM('cut')} ELSE c0 END AS cr, CASE WHEN sal THEN {_UNC('cut')} ELSE u0 END AS ur FROM s),
    y AS (SELECT *, sal AND ur < 0.02 AND cr >= 0.9 AS cleared, NOT ((cr < 0.7 AND length(txt) > 20) OR (ur >= 0.08 AND NOT sal)) AND cr >= 0.75 AND ur < 0.05 AS ok FROM z),
    w AS (SELECT *, list_filter([CASE WHEN rep THEN 'replacement_chars' END, CASE WHEN ctl AND NOT cleared THEN 'control_characters' END, CASE WHEN low AND NOT cleared THEN 'low_common_text_ratio' END,
      CASE WHEN dense AND NOT cleared THEN 'uncommon_unicode_density' END, CASE WHEN sal THEN 'salvaged_readable_text' END], lambda x: x IS NOT NULL) AS issues FROM y)"""


@query("text_normalize", _QUALITY + """
    SELECT doc_id, ok, array_to_string(issues, ',') AS issues, CASE WHEN NOT ok THEN 0.35 WHEN sal THEN 0.12 WHEN len(issues) > 0 THEN 0.1 ELSE 0.0 END AS penalty, round(cr, 6) AS common,
      md5(CASE WHEN NOT ok THEN '' ELSE txt END) AS text_md5 FROM w""")
def text_normalize(spark, folder):
    df = T.normalize_text(_damaged(spark, folder), "t", "tq")
    return df.select("doc_id", "tq.ok", F.array_join("tq.issues", ",").alias("issues"), F.col("tq.confidence_penalty").alias("penalty"), F.round("tq.common_text_ratio", 6).alias("common"), F.md5("tq.text").alias("text_md5"))


@query("text_salvage", _QUALITY + " SELECT lang, count(*) AS n, count_if(sal) AS salvaged, CAST(sum(CASE WHEN sal THEN length(cut) ELSE 0 END) AS BIGINT) AS kept FROM w GROUP BY lang")
def text_salvage(spark, folder):
    df = T.normalize_text(_damaged(spark, folder), "t", "tq", 1 << 30)
    sal = F.array_contains("tq.issues", "salvaged_readable_text")
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(sal).alias("salvaged"), F.coalesce(F.sum(F.when(sal, F.length("tq.text"))), F.lit(0)).cast("bigint").alias("kept"))


@query("confidence_degrade", _QUALITY + """, x AS (SELECT quality, CASE WHEN NOT ok THEN 0.35 WHEN sal THEN 0.12 WHEN len(issues) > 0 THEN 0.1 ELSE 0.0 END AS p FROM w LEFT JOIN labels USING (doc_id))
    SELECT b AS base, CASE WHEN p >= 0.3 THEN 'low' WHEN p >= 0.1 THEN CASE WHEN b = 'high' THEN 'medium' ELSE 'low' END ELSE b END AS degraded, count(*) AS n
    FROM (SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 1 THEN 'high' ELSE 'medium' END AS b, p FROM x) GROUP BY 1, 2""")
def confidence_degrade(spark, folder):
    df = T.normalize_text(_damaged(spark, folder), "t", "tq").join(table(spark, folder, "labels"), "doc_id", "left")
    base = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 1, "high").otherwise("medium")
    return df.select(base.alias("base"), T.degrade_confidence(base, F.col("tq.confidence_penalty")).alias("degraded")).groupBy("base", "degraded").agg(F.count("*").alias("n"))


def _redirects(t) -> str:
    """Chains of up to 20 hops over the orders: some end well, some in an error, some at a URL that was never fetched, some in a loop."""
    u = lambda i: f"'https://shop.net/' || CAST(g AS STRING) || '/' || CAST({i} AS STRING)"
    return f"""SELECT {u('i')} AS url, CASE WHEN i < n OR (i = n AND g % 7 = 3) OR (i = n AND g % 11 = 5) THEN 301 WHEN g % 5 = 0 THEN 404 ELSE 200 END AS status,
      CASE WHEN i < n THEN {u('i + 1')} WHEN i = n AND g % 7 = 3 THEN {u('CAST(floor(n / 2) AS BIGINT)')} WHEN i = n AND g % 11 = 5 THEN {u('99')} END AS location
      FROM (SELECT CAST(floor(o_orderkey / 25) AS BIGINT) AS g, o_orderkey % 25 AS i, CAST(floor(o_orderkey / 25) AS BIGINT) % 21 AS n FROM {t('orders')}) o"""


@query("redirect_chains", f"""WITH RECURSIVE f AS ({_redirects(Duck().t)}),
    w AS (SELECT url, url AS here, 0 AS hops, '' AS via FROM f UNION ALL SELECT w.url, f.location, hops + 1, via || ' ' || f.location FROM w JOIN f ON f.url = w.here WHERE f.location IS NOT NULL AND hops < 30),
    e AS (SELECT w.url, here, hops, via, f.url IS NOT NULL AS fetched, status FROM w LEFT JOIN f ON f.url = here WHERE f.location IS NULL)
    SELECT f.url, here AS final_url, e.status AS final_status, CAST(hops AS INTEGER) AS hops, trim(via) AS chain, CASE WHEN here IS NULL THEN 'loop' WHEN NOT fetched THEN 'broken' WHEN e.status BETWEEN 200 AND 299 THEN 'ok' ELSE 'error' END AS outcome
    FROM f LEFT JOIN e USING (url)""")
def redirect_chains(spark, folder):
    return redirects.redirect_chains(spark.sql(_redirects(Spark(folder).t))).withColumn("chain", F.array_join("chain", " "))


_NEEDS = "(t0 = '' OR NOT ok OR sal OR cr < 0.9)"


@query("extraction_health", _QUALITY.replace("SELECT doc_id, lang, CASE lang", "SELECT doc_id, source AS project_slug, lang, CASE lang", 1).replace("SELECT doc_id, lang, t AS raw", "SELECT doc_id, project_slug, lang, t AS raw", 1) + """
    SELECT project_slug, count(*) AS total, count_if(NOT (raw = '' OR NOT ok OR sal OR cr < 0.9)) AS good, count_if(raw = '' OR NOT ok OR sal OR cr < 0.9) AS bad,
      count_if(NOT (raw = '' OR NOT ok OR sal OR cr < 0.9)) / count(*) >= 0.65 AS passed FROM w GROUP BY project_slug""")
def extraction_health(spark, folder):
    src = table(spark, folder, "documents").select("doc_id", F.col("source").alias("project_slug"))
    df = _damaged(spark, folder).join(src, "doc_id").select(
        "project_slug", F.col("doc_id").alias("seq"), F.concat(F.lit("https://docs.net/d/"), F.col("doc_id").cast("string")).alias("url"), F.col("t").alias("main_text_summary"))
    return metrics.extraction_health(df).select("project_slug", "total", "good", "bad", "passed")


@query("repair_records", _sql(["w_pages"], "SELECT page_id, page_id % 3 = 0 AS repaired, true AS has_text FROM w_pages"))
def repair_records(spark, folder):
    rec = _records(spark, folder)
    new = rec.select("project_slug", "url", "seq", "page_id", "title", "main_text_summary")
    # A third of the pages had failed before.
    old = new.withColumn("main_text_summary", F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.col("main_text_summary")))
    out = metrics.repair_records(old, new)
    return out.select(F.col("seq").alias("page_id"), "repaired", (F.col("main_text_summary") != "").alias("has_text"))


# --- Reliability ------------------------------------------------------------------------
_BLOB = "lower(url || ' ' || title || '  ')"
_CLASS = f"""CASE WHEN regexp_matches({_BLOB}, 'limiting.?height|span.?table|load.?table|section.?propert') AND regexp_matches({_BLOB}, '[.]pdf') THEN 'engineering_table_pdf'
    WHEN regexp_matches({_BLOB}, 'calculat|engineering.?tool|design.?aid') AND NOT regexp_matches({_BLOB}, 'blog|news') THEN 'engineering_calculation'
    WHEN regexp_matches({_BLOB}, '[.](dwg|dxf|rvt|ifc)\\b|bim|cad library') THEN 'cad_bim_resource' WHEN regexp_matches({_BLOB}, 'install|erection|handling') THEN 'installation_guide'
    WHEN regexp_matches({_BLOB}, 'product.?data|data.?sheet|tech.?sheet|submittal.?sheet') THEN 'technical_product_sheet' WHEN regexp_matches({_BLOB}, 'catalog|brochure') THEN 'product_catalog'
    WHEN regexp_matches(path, '/blog/|news|insight') OR contains({_BLOB}, 'blog') THEN 'blog' WHEN regexp_matches({_BLOB}, 'support|faq|help.?center') THEN 'support_article'
    WHEN contains(path, 'download') OR contains({_BLOB}, 'downloads') THEN 'downloads_page' WHEN path IN ('', '/') THEN 'homepage' WHEN regexp_matches({_BLOB}, 'landing|campaign|promo') THEN 'marketing_landing_page'
    WHEN regexp_matches({_BLOB}, 'product|stud|track|joist|nitro|framing') THEN 'product_page' WHEN regexp_matches({_BLOB}, 'meta description|og:|json-ld only') THEN 'meta_tags' ELSE 'unknown' END"""
_WEIGHT = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.WEIGHTS.items()) + " END"
_SCORED = f"""+ t AS (SELECT project_slug, page_id, url, trim(regexp_replace({_UNESC("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) AS title, lower({PATH.format(u='url')}) AS path FROM w_pages),
    s AS (SELECT project_slug, page_id, {_CLASS} AS c FROM t), sc AS (SELECT project_slug, page_id, c AS source_class, CAST({_WEIGHT} AS DOUBLE) AS w FROM s)"""


def _titles(spark, folder):
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " "))
    title = F.replace(F.replace(F.replace(title, F.lit("&quot;"), F.lit('"')), F.lit("&middot;"), F.lit(chr(183))), F.lit("&amp;"), F.lit("&"))
    return _df(spark, folder, "w_pages").select("project_slug", "page_id", "url", title.alias("title"))


@query("source_reliability", _sql(["w_pages"], _SCORED + " SELECT page_id, source_class, w AS reliability_score FROM sc"))
def source_reliability(spark, folder):
    return metrics.score_sources(_titles(spark, folder)).select("page_id", "source_class", "reliability_score")


@query("reliability_by_class", _sql(["w_pages"], _SCORED + " SELECT project_slug, source_class, count(*) AS n FROM sc GROUP BY 1, 2"))
def reliability_by_class(spark, folder):
    return metrics.reliability_by_class(metrics.score_sources(_titles(spark, folder)))


@query("page_reliability", _sql(["w_pages"], _SCORED + " SELECT project_slug, count(*) AS pages, round(avg(w), 6) AS average FROM sc GROUP BY 1"))
def page_reliability(spark, folder):
    a = metrics.average_reliability(metrics.score_sources(_titles(spark, folder)))
    return a.withColumn("average", F.round("average", 6))


@query("reliability_overrides", _sql(["w_pages"], _SCORED + ", o AS (SELECT 'unknown' AS source_class, 0.4 AS weight) SELECT page_id, coalesce(weight, w) AS reliability_score, weight IS NOT NULL AS overridden FROM sc LEFT JOIN o USING (source_class)"))
def reliability_overrides(spark, folder):
    over = spark.range(1).select(F.lit("unknown").alias("source_class"), F.lit(0.4).alias("weight"))
    return metrics.apply_overrides(metrics.score_sources(_titles(spark, folder)), over).select("page_id", "reliability_score", "overridden")


@query("host_reliability", _sql(["w_pages"], _SCORED + " SELECT project_slug AS host, source_class, count(*) AS pages, round(avg(w), 6) AS reliability FROM sc GROUP BY 1, 2"))
def host_reliability(spark, folder):
    """The flagship: canonical host, title, source class and mean reliability."""
    df = _titles(spark, folder)
    canon = U.normalize_url("url")
    df = df.select(U.url_host(canon).alias("host"), R.source_class("url", "title").alias("source_class"))
    return df.groupBy("host", "source_class").agg(F.count("*").alias("pages"), F.round(F.avg(R.class_weight("source_class")), 6).alias("reliability"))
