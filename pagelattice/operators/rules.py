"""Rules as tables: facts, named products, page labels and terms that differ by project.

A rule row names the project it holds for; a null project means all projects. The rules of a
project are one row, and they reach the rows of the project by an equi-join. They are copied
to ``SALTS`` keys of which each row asks one, so neither a large project nor the rules of all
projects make a hot key; the copies grow with the rules only. A row is first held against the alternation of
its rules, so one that meets none is dropped after a single pattern and never multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import urls as U
from pagelattice.functions.core import txt
from pagelattice.operators.inventory import NAMED_NOTE

SALTS = 32
# A pattern that refers back to its own groups cannot be part of an alternation.
_REFERS_BACK = r"\\[1-9k]"


def _rule_sets(rules: DataFrame) -> DataFrame:
    """One row per project and salt: its rules and their alternation (null if it would not do)."""
    rule = F.struct(*[c for c in rules.columns if c != "project_slug"])
    alone = lambda r: r["pattern"].isNull() | r["pattern"].rlike(_REFERS_BACK)
    grouped = F.transform("_rules", lambda r: F.concat(F.lit("(?:"), r["pattern"], F.lit(")")))
    sets = rules.groupBy(F.col("project_slug").alias("_scope")).agg(F.collect_list(rule).alias("_rules"))
    return sets.select(
        "_scope", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), "_rules",
        F.when(~F.exists("_rules", alone), F.array_join(F.array_distinct(grouped), "|")).alias("_any"),
    )


def matches(rows: DataFrame, rules: DataFrame, text: Column, key: list[str], heads: Column | None = None) -> DataFrame:
    """Each row with each rule of its project, or of all projects, whose pattern occurs in ``text``.

    ``rows``: project_slug and ``key``, the columns that tell rows apart. ``rules``: project_slug (null: every
    project), pattern (a regular expression, null: always holds) and any payload, whose names must not occur in the
    rows. With ``heads``, rules whose ``search_headings`` is true search the text followed by the heads. A null text is empty, rows
    without a project have no rules, repeated rows and rules give repeated matches, and with either table empty
    there are none. The rules of one project are gathered in a row: they are written by people, not data.
    """
    payload = [c for c in rules.columns if c != "project_slug"]
    salt = F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")
    asked = rows.filter("project_slug is not null").select(
        "*", txt(text).alias("_text"), (F.lit("") if heads is None else txt(heads)).alias("_heads"), salt.alias("_ask"),
        F.explode(F.array(F.col("project_slug"), F.lit(None).cast("string"))).alias("_of"),
    )
    met = asked.join(_rule_sets(rules), F.col("_of").eqNullSafe(F.col("_scope")) & (F.col("_ask") == F.col("_salt")))
    whole = F.col("_text") if heads is None else F.concat("_text", "_heads")
    any_of = lambda c: F.rlike(c, F.col("_any"))
    either = any_of(whole) if heads is None else any_of(whole) | any_of(F.col("_text"))

    def holds(r: Column) -> Column:
        searched = F.col("_text") if heads is None else F.when(r["search_headings"], whole).otherwise(F.col("_text"))
        return r["pattern"].isNull() | F.rlike(searched, r["pattern"])

    hit = met.filter(F.col("_any").isNull() | either).select(*rows.columns, F.explode(F.filter("_rules", holds)).alias("_rule"))
    return hit.select(*rows.columns, *[F.col("_rule")[c].alias(c) for c in payload if c != "pattern"])


def facts_by_rules(home: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts of each project whose rules hold for its home page (see `inventory.homepages`).

    ``rules``: project_slug, section, pos, pattern, claim, confidence, kind, notes.
    """
    pages = home.select("project_slug", F.col("url").alias("source_url"), "main_text_summary")
    found = matches(pages, rules, F.col("main_text_summary"), ["project_slug"])
    return found.select("project_slug", "section", "pos", "claim", "source_url", "confidence", "kind", "notes")


def named_products(records: DataFrame, products: DataFrame, named: DataFrame) -> DataFrame:
    """Named products that a page mentions and no listed product carries yet, with the best page.

    ``products``: project_slug, name. ``named``: project_slug, label, named_family, pattern. A page that has the name in its
    URL, title or main headings goes before one with it in the text only, then the earlier page; of rules with the same
    label in one project the first family by order holds.
    """
    kept = ["project_slug", "seq", F.col("url").alias("source_url"), F.col("pdf_links").alias("documents"), F.col("main_text_summary").alias("description")]
    name = F.concat_ws(" ", "url", txt("title"), F.array_join("h1", " "))
    parts = F.array(
        F.struct(F.lit(0).alias("behind"), name.alias("where")),
        F.struct(F.lit(1).alias("behind"), txt("main_text_summary").alias("where")),
    )
    pages = records.select(*kept, F.explode(parts).alias("part"))
    found = matches(pages, named, F.col("part.where"), ["project_slug", "seq", "source_url"])
    best = found.groupBy("project_slug", "label").agg(
        F.min_by(F.struct("source_url", "description", "documents"), F.struct("part.behind", "seq", "source_url")).alias("p"),
        F.min("named_family").alias("family"),
    )
    names = products.select("project_slug", F.col("name").alias("listed_name"))
    listed = matches(names, named, F.col("listed_name"), ["listed_name"]).select("project_slug", "label").distinct()
    return best.join(listed, ["project_slug", "label"], "left_anti").select(
        "project_slug", F.lit(-1).cast("bigint").alias("seq"), F.col("label").alias("name"), "family", "p.description", "p.source_url", "p.documents",
        F.lit("medium").alias("confidence"), F.lit(NAMED_NOTE).alias("notes"),
    )


def pages_by_label(records: DataFrame, labels: DataFrame) -> DataFrame:
    """First page of a project per label of its rules, and its home page.

    ``labels``: project_slug, page_label, pattern, search_headings. The home page is the first one with path '/', else
    the first page. A label 'homepage' of the rules does not replace it.
    """
    rows = records.select("project_slug", "seq", "url", txt("title").alias("title"), F.array_join("h1", " ").alias("head"))
    found = matches(rows.withColumnRenamed("head", "_head"), labels, F.concat(txt("url"), F.col("title")), ["project_slug", "seq", "url"], F.col("_head"))
    first = found.filter("page_label <> 'homepage'").groupBy("project_slug", "page_label").agg(F.min_by("url", F.struct("seq", "url")).alias("url"))
    inner = F.coalesce(U.url_path("url") != "/", F.lit(True))
    home = records.filter("project_slug is not null").groupBy("project_slug").agg(F.min_by("url", F.struct(inner, "seq", "url")).alias("url"))
    return first.unionByName(home.select("project_slug", F.lit("homepage").alias("page_label"), "url")).filter("url is not null")


def terms_by_rules(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(project_slug, page_id, url, term) for every term of a project, or of all, that its page text contains.

    ``terms``: project_slug, term. Letter case does not count; a term stands for itself, not for a pattern. A term that is given
    twice for a page is reported once; blank and null terms are no terms.
    """
    safe = F.replace(F.lower("term"), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    rules = terms.filter("trim(term) <> ''").select("project_slug", "term", F.concat(F.lit("\\Q"), safe, F.lit("\\E")).alias("pattern"))
    pages = records.select("project_slug", "page_id", "url", F.lower(txt("main_text_summary")).alias("page_text"))
    found = matches(pages, rules, F.col("page_text"), ["project_slug", "page_id", "url"])
    return found.select("project_slug", "page_id", "url", "term").distinct()
