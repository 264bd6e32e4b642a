"""Small shared column helpers.

Stored values follow ECMAScript's notions of white space, string length and rounding,
and the helpers pin those down.
"""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a JavaScript regular expression treats as white space.
JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Fixed value: the non-ASCII ones among them.
UNICODE_SPACE = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Fixed value: every code point that takes two UTF-16 units.
ASTRAL = r"\x{10000}-\x{10FFFF}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def built_once(fn):
    """Keeps what ``fn`` builds for its (hashable) arguments.

    Columns over names carry no data and can be used in any plan; building a large one
    takes many calls into the JVM, so it is done once per Spark context.
    """
    kept: dict = {}

    @wraps(fn)
    def inner(*args):
        key = (id(SparkContext._active_spark_context), args)
        if key not in kept:
            kept[key] = fn(*args)
        return kept[key]

    return inner


class Tables(dict):
    """Named tables that are only planned when someone asks for them."""

    def __init__(self, makers: dict, **ready):
        super().__init__(ready)
        self._makers = makers

    def __missing__(self, name: str):
        self[name] = self._makers[name]()
        return self[name]

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or name in self._makers

    def keys(self):
        return list(dict.fromkeys([*super().keys(), *self._makers]))

    def __iter__(self):
        return iter(self.keys())

    def items(self):
        return [(k, self[k]) for k in self.keys()]

    def get(self, name, default=None):
        return self[name] if name in self else default


def txt(c: Column | str) -> Column:
    """NULL as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def re_replace(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, pattern, replacement)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(c: Column) -> Column:
    return re_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def collapse_space(c: Column, ascii_only: Column | bool = False) -> Column:
    """Runs of white space become one blank, then trim. Single blanks stay untouched.

    ``ascii_only`` marks rows without Unicode blanks, which skip the first pass.
    """
    plain = F.regexp_replace(c, f"[{UNICODE_SPACE}]", " ")
    if isinstance(ascii_only, Column):
        plain = F.when(ascii_only, c).otherwise(plain)
    return F.trim(re_replace(plain, r"[\t-\r][\t-\r ]*| [\t-\r ]+", " "))


def u16len(c: Column) -> Column:
    """String length in UTF-16 units (Spark's length counts code points)."""
    return F.length(c) + count_in(c, ASTRAL)


def count_in(c: Column, chars: str) -> Column:
    """How many code points belong to a class; strips whole runs of the others at once."""
    return F.length(F.regexp_replace(c, f"[^{chars}]+", ""))


def count_outside(c: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(c, f"[{chars}]+", ""))


def js_round(c: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def js_number(c: Column) -> Column:
    """A double printed as JavaScript prints it when it is a whole number."""
    whole = c.cast("bigint")
    return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))


def word(pattern: str) -> str:
    """ASCII word boundaries; \\b is Unicode-aware on current JVMs."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def strings(values: list[str]) -> Column:
    """A literal ARRAY<STRING>."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def first_seen(c: Column) -> Column:
    """Distinct non-empty strings in order of first appearance."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
