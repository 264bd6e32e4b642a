"""Lexical keys and content-hash ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelattice.functions.core import col, txt


@F.pandas_udf(StringType())
def _fold_marks(s: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no Unicode normalization."""

    def fold(x):
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F)

    return s.map(fold, na_action="ignore")


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normalize_key(value: Column | str, ascii_only: bool = False, max_chars: int | None = None) -> Column:
    """Lower-case dashed key, whole unless ``max_chars`` is given.

    Python sees only the non-ASCII strings (all others reach it as NULL). Pass
    ``ascii_only=True`` where the input cannot hold anything else: the expression
    then stays entirely in the JVM.
    """
    low = F.lower(col(value))
    if not ascii_only:
        needs_fold = low.rlike(r"[^\x00-\x7f]")
        low = F.when(needs_fold, _fold_marks(F.when(needs_fold, low))).otherwise(low)
    return _dashed(low) if max_chars is None else F.substring(_dashed(low), 1, max_chars)


def slugify(value: Column | str) -> Column:
    return _dashed(F.lower(col(value)))


def stable_hash(*parts: Column | str, digits: int = 32) -> Column:
    """First ``digits`` hex digits (128 bits by default) of sha256 over the parts joined by '|' (NULL as '')."""
    return F.substring(F.sha2(F.concat_ws("|", *[txt(p) for p in parts]), 256), 1, digits)


def digest(*parts: Column | str, size: int = 32, tag: str = "") -> Column:
    """Content digest of a record: equal records, equal digests."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(tag), *[txt(p) for p in parts]), 256), 1, size)


def entity_id(entity_type: Column | str, key: Column | str, project: Column | str | None = None) -> Column:
    """Id of a project entity, or of a global one when no project is given."""
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    scope = F.lit("global") if project is None else F.concat(F.lit("project:"), col(project))
    return F.concat(F.lit("ent_"), kind, F.lit("_"), stable_hash(kind, col(key), scope))


def relationship_id(rel_type: Column | str, from_id: Column | str, to_id: Column | str, project: Column | str | None = None) -> Column:
    kind = F.lit(rel_type) if isinstance(rel_type, str) else rel_type
    scope = F.lit("global") if project is None else F.coalesce(col(project), F.lit("global"))
    return F.concat(F.lit("rel_"), kind, F.lit("_"), stable_hash(kind, col(from_id), col(to_id), scope))


def evidence_id(project: Column | str, url: Column | str, excerpt: Column | str) -> Column:
    return F.concat(F.lit("ev_"), stable_hash(col(project), col(url), col(excerpt)))


def conflict_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("conflict_"), stable_hash(*parts))


def candidate_pattern_id(key: Column | str) -> Column:
    return F.concat(F.lit("cpat_"), stable_hash(F.lit("CandidatePattern"), col(key)))


def observation_key(category: Column, signal: Column, polarity: Column | str = "present", ascii_only: bool = False) -> Column:
    pol = F.lit(polarity) if isinstance(polarity, str) else polarity
    return normalize_key(F.concat(txt(category), F.lit(":"), txt(signal), F.lit(":"), pol), ascii_only)


def key_of(text: str) -> str:
    """`normalize_key` of a Python string, for query parameters."""
    import re

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", plain))
