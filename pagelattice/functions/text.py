"""Text quality: character ratios, cleaning, salvage of readable spans.

Single-step measures are column functions. The multi-step ones (`normalize_text`,
`salvage_text`) take a DataFrame and add their columns in stages, so that every
intermediate text is computed once instead of being inlined many times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.core import (
    ASTRAL, JS_SPACE, UNICODE_SPACE, built_once, col, collapse_space, compact, count_in, count_outside, txt, u16len, word,
)

# Characters usual in Western web copy.
COMMON_CLASS = (
    r"\t\n\r\x20-\x7E\x{A0}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"
    r"\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}\x{2026}"
)
# Control characters that are removed (tab, LF and CR stay).
CONTROL_CLASS = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
# Named entities in decoding order (&amp; comes before &lt;).
ENTITIES = [
    (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&quot;", '"'),
    (r"&#39;", "'"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"),
]
# Shapes of a token that reads as English.
TOKEN_SHAPES = [
    r"^[\d$\x{20AC}\x{A3}\x{A5}%+./:\-]+$",
    rf"^(?i:https?://|www\.)[^{JS_SPACE}]+$",
    r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$",
    r"^[A-Za-z][A-Za-z0-9'\x{2019}&+./\-]{0,40}[A-Za-z0-9]?[.:;,!?]?$",
    r"^[&\-\x{2014}/|\x{2022}()\[\]]$",
]
# Phrases that mark the start of readable copy, tried in order.
ANCHORS = [
    rf"(?i)About[{JS_SPACE}]+[A-Z]",
    r"(?i)Technical Support",
    r"(?i)REQUEST A SUBMITTAL",
    rf"(?i){word('Home')}.*{word('Products')}",
    rf"[A-Z][a-z]+(?:[{JS_SPACE}]+[A-Z][a-z]+){{2,}}[{JS_SPACE}]+is[{JS_SPACE}]+a(?![A-Za-z0-9_])",
]
REPLACEMENT = chr(0xFFFD)
FAILED_SUMMARY = "[text extraction failed — raw content preserved in crawl logs; confidence degraded]"


def _beyond_ascii(t: Column) -> Column:
    """What is left once plain ASCII text is removed; every measure needs only this."""
    return F.regexp_replace(t, r"[\t\n\r\x20-\x7E]+", "")


def _units(t: Column, rest: Column) -> Column:
    return F.length(t) + count_in(rest, ASTRAL)


def _ratio(count: Column, n: Column, empty: float) -> Column:
    return F.when(n == 0, F.lit(empty)).otherwise(count / n)


def printable_ratio(text: Column | str, rest: Column | None = None) -> Column:
    t = col(text)
    r = _beyond_ascii(t) if rest is None else rest
    return _ratio(F.length(t) - count_in(r, CONTROL_CLASS), _units(t, r), 1.0)


def common_text_ratio(text: Column | str, rest: Column | None = None) -> Column:
    t = col(text)
    r = _beyond_ascii(t) if rest is None else rest
    return _ratio(F.length(t) - count_outside(r, COMMON_CLASS), _units(t, r), 1.0)


def uncommon_char_ratio(text: Column | str, rest: Column | None = None) -> Column:
    t = col(text)
    r = _beyond_ascii(t) if rest is None else rest
    return _ratio(count_outside(r, COMMON_CLASS), _units(t, r), 0.0)


def has_control_chars(text: Column | str) -> Column:
    return col(text).rlike(f"[{CONTROL_CLASS}]")


def has_replacement_char(text: Column | str) -> Column:
    return col(text).contains(REPLACEMENT)


def strip_control_chars(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"[{CONTROL_CLASS}]", "")


def strip_invisible(text: Column | str) -> Column:
    """Without byte order marks, zero-width and bidirectional control characters."""
    return F.regexp_replace(col(text), f"{ZERO_WIDTH}|{BIDI}", "")


def _numeric_entities(s: Column, pattern: str, base: int) -> Column:
    def char(m: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(m, r"([0-9a-fA-F]+);$", 1), r"^0+(?=.)", "")
        code = F.when(F.length(digits) <= 7, F.conv(digits, base, 10).cast("bigint"))
        valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.when(valid, utf32), F.lit(""))

    found = F.array_distinct(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))
    return F.aggregate(found, s, lambda acc, m: F.replace(acc, m, char(m)))


def decode_entities(text: Column | str) -> Column:
    s = col(text)
    for pattern, plain in ENTITIES:
        s = F.regexp_replace(s, pattern, plain)
    both = _numeric_entities(_numeric_entities(s, r"(?i)&#x[0-9a-f]+;", 16), r"&#[0-9]+;", 10)
    decoded = F.when(col(text).contains("#"), both).otherwise(s)
    return F.when(col(text).contains("&"), decoded).otherwise(col(text))


def is_english_like(token: Column | str) -> Column:
    t = col(token)
    return (t != "") & t.rlike("|".join(f"(?:{p})" for p in TOKEN_SHAPES))


def head(text: Column | str, n: int = 240) -> Column:
    """First n UTF-16 units, on a code point boundary."""
    cut = F.substring(col(text), 1, n)
    return F.substring(cut, F.lit(1), F.lit(n) - count_in(cut, ASTRAL))


def degrade_confidence(base: Column | str, penalty: Column) -> Column:
    b = col(base)
    return (
        F.when(penalty >= 0.3, "low")
        .when(penalty >= 0.1, F.when(b == "high", "medium").otherwise("low"))
        .otherwise(b)
    )


def _staged(df: DataFrame, stages: list[dict[str, Column]], prefix: str) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage)
    return df.drop(*[c for c in df.columns if c.startswith((prefix, "_" + prefix))])


def salvage_text(df: DataFrame, text: str, out: str = "salvaged") -> DataFrame:
    """Adds ``out`` STRUCT<text, salvaged>: the readable span of a corrupted text."""
    return _staged(df, _salvage_stages(text, out, None), f"_{out}_")


@built_once
def _salvage_stages(text: str, out: str, when: str | None) -> list[dict[str, Column]]:
    """Tokens carry whether they read as English. Their flags also make a string of 0 and 1, so
    the first window of five tokens with at least four good ones is one regular expression
    match; the string is not indexed by position, which would read it from its start each time."""
    p = f"_{out}_"
    c = lambda name: F.col(p + name)
    t = F.col(text)
    need = (
        (uncommon_char_ratio(head(t)) >= 0.08)
        | (uncommon_char_ratio(t) >= 0.04)
        | (common_text_ratio(head(t)) < 0.9)
    ) & (F.length(t) > 0)
    if when is not None:
        need = F.col(when) & need
    tokens = F.filter(F.split(t, f"[{JS_SPACE}]+"), lambda x: x != "")
    judged = F.transform(tokens, lambda x: F.struct(x.alias("word"), is_english_like(x).alias("good")))
    flags = F.array_join(F.transform(c("tok"), lambda x: F.when(x["good"], "1").otherwise("0")), "")
    window = "[01]1111|1[01]111|11[01]11|111[01]1|1111[01]"
    onset = F.when(F.size(c("tok")) >= 6, F.regexp_instr(c("flags"), F.lit(window)))
    start = c("on") + F.instr(F.substring(c("flags"), c("on"), F.length(c("flags"))), "1") - 1
    # The start is used outside the lambda: inside, the optimizer would work it out for every token.
    kept = F.filter(
        F.slice(c("tok"), c("start"), F.size(c("tok"))),
        lambda x: x["good"] | (u16len(x["word"]) <= 2) | (common_text_ratio(x["word"]) >= 0.85),
    )
    anchored = F.lit(None).cast("string")
    for pattern in reversed(ANCHORS):
        at = F.regexp_instr(t, F.lit(pattern))
        part = collapse_space(F.substring(t, at, F.length(t)))
        anchored = F.when((at > 0) & (u16len(part) >= 40), part).otherwise(anchored)
    cut = c("cut")
    good = (
        (u16len(cut) >= 40)
        & (uncommon_char_ratio(cut) < uncommon_char_ratio(t))
        & (common_text_ratio(cut) >= 0.9)
    )
    best = c("best")
    return [
        {p + "tok": F.when(need, judged)},
        {p + "flags": flags},
        {p + "on": onset},
        {p + "start": F.when(c("on") > 0, start)},
        {p + "cut": F.when(c("on") > 0, F.array_join(F.transform(kept, lambda x: x["word"]), " "))},
        {p + "best": F.coalesce(F.when(good, cut), F.when(c("on") == 0, anchored))},
        {out: F.struct(F.coalesce(best, t).alias("text"), best.isNotNull().alias("salvaged"))},
    ]


def normalize_text(df: DataFrame, text: str, out: str = "tq", max_length: int | None = None) -> DataFrame:
    """Adds ``out`` STRUCT<text, ok, printable_ratio, common_text_ratio, issues,
    confidence_penalty, raw_preserved>: the text cleaned and judged, whole unless
    ``max_length`` is given."""
    return _staged(df, _normalize_stages(text, out, max_length), f"_{out}_")


@built_once
def _normalize_stages(text: str, out: str, max_length: int | None) -> list[dict[str, Column]]:
    p = f"_{out}_"
    c = lambda name: F.col(p + name)
    dirty = c("rest0").rlike(f"[{CONTROL_CLASS}]|{ZERO_WIDTH}|{BIDI}|{REPLACEMENT}")
    stripped = strip_control_chars(strip_invisible(F.regexp_replace(c("raw"), REPLACEMENT, "")))
    no_odd_space = ~c("rest0").rlike(f"[{UNICODE_SPACE}]") & ~c("raw").contains("&")
    keep = ~c("cleared")
    issues = compact(
        F.when(c("raw").contains(REPLACEMENT), F.lit("replacement_chars")),
        F.when(c("ctl") & keep, F.lit("control_characters")),
        F.when(c("pr") < 0.7, F.lit("low_printable_ratio")),
        F.when(c("low") & keep, F.lit("low_common_text_ratio")),
        F.when(c("dense") & keep, F.lit("uncommon_unicode_density")),
        F.when(c("bin"), F.lit("likely_binary_or_compressed")),
        F.when(c("sal"), F.lit("salvaged_readable_text")),
    )
    fatal = (
        c("bin")
        | ((c("cr") < 0.7) & (c("size") > 20))
        | ((c("ur") >= 0.08) & ~c("sal"))
        | (c("pr") < 0.5)
    )
    penalty = F.when(~c("ok"), 0.35).when(c("sal"), 0.12).when(F.size(c("issues")) > 0, 0.1).otherwise(0.0)
    cut = c("text") if max_length is None else F.when(
        c("size") > max_length, F.concat(head(c("text"), max_length), F.lit(chr(0x2026)))
    ).otherwise(c("text"))
    sv = F.col(f"{p}sv")
    return [
        {p + "raw": txt(text)},
        {p + "rest0": _beyond_ascii(c("raw"))},
        {
            p + "vis": F.when(dirty, stripped).otherwise(c("raw")),
            p + "ctl": has_control_chars(c("rest0")),
        },
        {p + "clean": collapse_space(decode_entities(c("vis")), no_odd_space)},
        {p + "rest": _beyond_ascii(c("clean"))},
        {
            p + "n": _units(c("clean"), c("rest")),
            p + "un": count_outside(c("rest"), COMMON_CLASS),
            p + "pr": printable_ratio(c("clean"), c("rest")),
        },
        {
            p + "cr0": _ratio(F.length(c("clean")) - c("un"), c("n"), 1.0),
            p + "ur0": _ratio(c("un"), c("n"), 0.0),
        },
        {
            p + "low": (c("cr0") < 0.85) & (c("n") > 20),
            p + "dense": (c("ur0") >= 0.04)
            | ((c("un") > 0) & (uncommon_char_ratio(head(c("clean"))) >= 0.08)),
        },
        {p + "try": c("low") | c("ctl") | c("dense")},
        *_salvage_stages(p + "clean", p + "sv", p + "try"),
        {
            p + "sal": sv["salvaged"],
            p + "text": sv["text"],
            p + "cr": F.when(sv["salvaged"], common_text_ratio(sv["text"])).otherwise(c("cr0")),
            p + "ur": F.when(sv["salvaged"], uncommon_char_ratio(sv["text"])).otherwise(c("ur0")),
            p + "size": F.when(sv["salvaged"], u16len(sv["text"])).otherwise(c("n")),
            p + "bin": c("raw").contains(chr(0)) | (c("pr") < 0.5),
        },
        {p + "cleared": c("sal") & (c("ur") < 0.02) & (c("cr") >= 0.9)},
        {
            p + "issues": issues,
            p + "ok": ~fatal & (c("cr") >= 0.75) & (c("pr") >= 0.7) & (c("ur") < 0.05),
        },
        {
            out: F.struct(
                F.when(c("ok"), cut).otherwise("").alias("text"),
                c("ok").alias("ok"),
                c("pr").alias("printable_ratio"),
                c("cr").alias("common_text_ratio"),
                c("issues").alias("issues"),
                penalty.alias("confidence_penalty"),
                (~c("ok")).alias("raw_preserved"),
            )
        },
    ]


def needs_text_repair(df: DataFrame, summary: str, out: str = "needs_repair") -> DataFrame:
    """Adds the flag for a summary that is missing, failed or only partly readable."""
    df = normalize_text(df, summary, f"{out}_tq")
    tq, s = F.col(f"{out}_tq"), F.col(summary)
    bad = (
        s.isNull() | (s == "") | s.startswith("[text extraction failed")
        | ~tq["ok"]
        | F.array_contains(tq["issues"], "salvaged_readable_text")
        | (tq["common_text_ratio"] < 0.9)
    )
    return df.withColumn(out, bad).drop(f"{out}_tq")


