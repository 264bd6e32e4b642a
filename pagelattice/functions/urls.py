"""URL columns: canonical form, hosts, path rules, file types, robots rules.

Everything is a native expression, so a URL step fuses into the scan it sits on.
Not covered: punycode for non-ASCII hosts and IPv6 literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelattice.functions.core import col, js_trim, let, strings, txt

# Query parameters that only track the visitor.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "mc_cid", "mc_eid", "_ga", "ref", "source",
]
# Paths a crawl does not enter.
SKIP_PATHS = [
    r"/wp-admin", r"/wp-login", r"/login", r"/logout", r"/account", r"/cart",
    r"/checkout", r"/my-account", r"/feed/?$", r"/xmlrpc\.php",
    r"\.(jpg|jpeg|png|gif|webp|svg|css|js|ico|woff2?)(\?|$)",
]
# Downloadable document types.
FILE_TYPES = ["pdf", "doc", "docx", "xls", "xlsx", "csv", "dwg", "dxf", "rvt", "ifc"]
DOCUMENT_HREF = r"(?i)\.(pdf|docx?|xlsx?|csv|dwg|dxf|rvt|ifc)(\?|$)"
# Fetch error messages, first match wins -> (kind, retryable).
FETCH_ERRORS = [
    (r"download is starting", "download", False),
    (r"429|rate.?limit|too many requests", "rate_limit", True),
    (r"timeout|timed out|net::err_timed_out", "timeout", True),
    (r"redirect", "redirect_loop", True),
    (r"net::err_|econnreset|socket", "other", True),
]

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*(?:([^/\\?#]*)@)?([^/\\?#@]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_SEP = chr(1)
_PATH_UNSAFE = r'[^\x21-\x7e]|["<>`{}]'


def _parsed(url: Column | str) -> Column:
    """STRUCT<scheme, user, host, port, path, query> of an http(s) URL, NULL for others."""
    trimmed = F.regexp_replace(F.trim(col(url)), r"[\t\n\r]", "")
    split = F.split(F.regexp_replace(trimmed, _PARTS, f"$1{_SEP}$2{_SEP}$3{_SEP}$4{_SEP}$5"), _SEP)

    def build(p: Column) -> Column:
        scheme, hostport = F.lower(p[0]), F.lower(p[2])
        ok = (F.size(p) == 5) & scheme.isin("http", "https") & hostport.rlike(r"^[^\s<>\[\]^|%:@]+(?::[0-9]*)?$")
        path = F.replace(p[3], F.lit("\\"), F.lit("/"))
        return F.when(
            ok,
            F.struct(
                scheme.alias("scheme"),
                p[1].alias("user"),
                F.substring_index(hostport, ":", 1).alias("host"),
                F.regexp_extract(hostport, r"(:[0-9]+)$", 1).alias("port"),
                F.when(path == "", F.lit("/")).otherwise(_encode_path(_drop_dot_segments(path))).alias("path"),
                p[4].alias("query"),
            ),
        )

    return let(split, build)


def is_http(url: Column | str) -> Column:
    """An absolute http(s) URL with a usable host; NULL is false."""
    return _parsed(url).isNotNull()


def url_host(url: Column | str) -> Column:
    """Lower-case host name without port, NULL when the URL does not parse."""
    return _parsed(url)["host"]


def bare_host(host: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(host)), r"^www\.", "")


def _encode_path(path: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda c: F.when(
                c.rlike(_PATH_UNSAFE), F.regexp_replace(F.url_encode(c), r"\+", "%20")
            ).otherwise(c),
        ),
        "",
    )
    return F.when(path.rlike(_PATH_UNSAFE), encoded).otherwise(path)


def _drop_dot_segments(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    kept = F.aggregate(
        F.split(F.substring(path, 2, 1 << 30), "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        )
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    closed = F.when(last.isin(".", "..") & ~joined.endswith("/"), F.concat(joined, F.lit("/")))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.coalesce(closed, joined)).otherwise(path)


def url_path(url: Column | str) -> Column:
    """Percent-encoded path, '/' when empty, NULL when the URL does not parse."""
    return _parsed(url)["path"]


def _kept_query(query: Column) -> Column:
    """Form-encoded query without the tracking parameters, '' when none is left."""

    def decoded(s: Column) -> Column:
        return F.coalesce(F.try_url_decode(s), s)

    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(
        pairs,
        lambda p: F.struct(
            decoded(F.substring_index(p, "=", 1)).alias("k"),
            decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS))
    text = F.array_join(
        F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&"
    )
    return F.when(query == "", F.lit("")).otherwise(
        let(text, lambda t: F.when(t == "", t).otherwise(F.concat(F.lit("?"), t)))
    )


def _canonical(p: Column, pref: Column, prefer_https: bool) -> Column:
    scheme = F.lit("https") if prefer_https else p["scheme"]
    apex = bare_host(p["host"])
    host = F.when(pref.isNull(), apex).when(apex == bare_host(pref), pref).otherwise(p["host"])
    default = (p["port"] == ":443") | ((p["port"] == ":80") & (p["scheme"] == "http"))
    if not prefer_https:
        default = F.concat(p["scheme"], p["port"]).isin("http:80", "https:443")
    port = F.when(default, F.lit("")).otherwise(p["port"])
    user = F.when(p["user"] == "", F.lit("")).otherwise(F.concat(p["user"], F.lit("@")))
    path = F.when(p["path"] == "/", F.lit("/")).otherwise(F.regexp_replace(p["path"], r"/$", ""))
    return F.concat(scheme, F.lit("://"), user, host, port, path, _kept_query(p["query"]))


def _preference(preferred_host: Column | str | None) -> Column:
    if isinstance(preferred_host, Column):
        return F.lower(preferred_host)
    return F.lower(F.lit(preferred_host).cast("string"))


def normalize_url(
    url: Column | str, preferred_host: Column | str | None = None, prefer_https: bool = True
) -> Column:
    """Canonical form of an absolute URL, NULL unless it is http(s)."""
    pref = _preference(preferred_host)
    return let(_parsed(url), lambda p: F.when(p.isNotNull(), _canonical(p, pref, prefer_https)))


def canonical_link(url: Column | str, preferred_host: Column | str | None = None) -> Column:
    """STRUCT<href, host>: the canonical URL and its bare host, parsed once."""
    pref = _preference(preferred_host)
    return let(
        _parsed(url),
        lambda p: F.when(
            p.isNotNull(),
            F.struct(_canonical(p, pref, True).alias("href"), bare_host(p["host"]).alias("host")),
        ),
    )


def resolve_href(href: Column | str, base: Column | str) -> Column:
    """Absolute form of an href found on the page ``base``; NULL for an empty href."""
    h = js_trim(col(href))
    b = col(base)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_query = F.regexp_replace(b, r"[?#].*$", "")
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    folder = F.concat(origin, F.lit("/"), F.regexp_extract(no_query, r"^[^:]+://[^/]*/(.*/)?[^/]*$", 1))
    return (
        F.when((h == "") | h.isNull(), F.lit(None).cast("string"))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.rlike(r"^[/\\]{2}"), F.concat(scheme, h))
        .when(h.rlike(r"^[/\\]"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(no_query, h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(b, r"#.*$", ""), h))
        .otherwise(F.concat(folder, h))
    )


def preferred_host(hosts: Column | str) -> Column:
    """First host without www., else the first host, lower-cased."""
    h = col(hosts)
    apex = F.filter(h, lambda x: ~F.lower(x).startswith("www."))
    return F.lower(F.coalesce(F.get(apex, F.lit(0)), F.get(h, F.lit(0))))


def host_allowed(url: Column | str, hosts: Column | str) -> Column:
    allowed = F.transform(col(hosts), bare_host)
    return F.coalesce(F.array_contains(allowed, bare_host(url_host(url))), F.lit(False))


def hosts_from_url(url: Column | str) -> Column:
    bare = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.array(bare, F.concat(F.lit("www."), bare))


def should_skip_path(url: Column | str) -> Column:
    return F.coalesce(url_path(url).rlike("(?i)" + "|".join(SKIP_PATHS)), F.lit(True))


def is_document_href(href: Column | str) -> Column:
    return F.coalesce(col(href).rlike(DOCUMENT_HREF), F.lit(False))


def file_type_from_href(href: Column | str) -> Column:
    ext = F.regexp_extract(F.lower(col(href)), r"\.([a-z0-9]+)(?:\?|$)", 1)
    return F.when(ext.isin(*FILE_TYPES), ext).otherwise(F.lit("other"))


def classify_fetch_error(message: Column | str) -> Column:
    """STRUCT<kind, retryable>."""
    m = F.lower(txt(message))
    out = F.lit(None)
    for pattern, kind, retry in reversed(FETCH_ERRORS):
        out = F.when(m.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(retry).alias("retryable"))).otherwise(out)
    default = F.struct(F.lit("other").alias("kind"), F.lit(False).alias("retryable"))
    return F.coalesce(out, default)


def is_valid_url(url: Column | str) -> Column:
    """Empty counts as valid; anything else must be http(s)."""
    u = col(url)
    return u.isNull() | (u == "") | is_http(u)


def robots_rules(text: Column | str) -> Column:
    """STRUCT<disallow, sitemaps> of a robots.txt: the Disallow values of '*' groups.

    Each User-agent line opens a section that ends at the next one, so splitting on
    those lines gives the sections; Allow lines and wildcards carry no meaning here.
    """
    body = F.regexp_replace(txt(text), r"#[^\n]*", "")
    sections = F.slice(F.split(body, r"(?imd)^[^\S\n]*user-agent[^\S\n]*:"), 2, 1 << 30)
    starred = F.filter(sections, lambda s: F.trim(F.regexp_extract(s, r"^([^\r\n]*)", 1)) == "*")

    def values(s: Column, key: str) -> Column:
        found = F.regexp_extract_all(s, F.lit(rf"(?imd)^[^\S\n]*{key}[^\S\n]*:([^\n]*)"), F.lit(1))
        return F.filter(F.transform(found, js_trim), lambda v: v != "")

    return F.struct(
        F.flatten(F.transform(starred, lambda s: values(s, "disallow"))).alias("disallow"),
        values(body, "sitemap").alias("sitemaps"),
    )


def robots_allowed(url: Column | str, disallow: Column | str) -> Column:
    """True when no rule is a prefix of the path; no rules allow everything."""
    rules = F.coalesce(col(disallow), strings([]))
    blocked = let(url_path(url), lambda path: F.exists(rules, lambda r: path.startswith(r)))
    return (F.size(rules) == 0) | F.coalesce(~blocked, F.lit(False))

