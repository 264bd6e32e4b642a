"""Queries over rule tables that differ by project; half of all pages lie in one project."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.operators import inventory, rules
from pagelattice.plans import web_queries as W
from pagelattice.plans.derived import ctes
from pagelattice.plans.dialect import Duck, Spark
from pagelattice.plans.registry import query

_SUMMARY = """'The ' || p_name || ' is a stud and track part of brand number ' || CAST(p_size AS STRING) || '. Call 555-123-' || lpad(CAST(p_size AS STRING), 4, '0')
    || ' or mail sales' || CAST(p_size AS STRING) || '@parts.net today.'"""
_TEAM = "CASE WHEN {key} % 2 = 0 THEN 'team-0' ELSE 'team-' || CAST(p_size AS STRING) END"


def _rules(d) -> dict[str, tuple[list[str], str]]:
    part = d.t("part")
    own, noun = "'team-' || CAST(p_size AS STRING)", "split_part(p_name, ' ', 2)"
    return {
        # One project per page, its own rule, and rules of all projects: one always holds, one never.
        "r_facts": ([], f"""
            SELECT 'page-' || CAST(p_partkey AS STRING) AS project_slug, 'offerings' AS section, 1 AS pos,
              CASE p_size % 3 WHEN 0 THEN '(?i)' || upper({noun}) WHEN 1 THEN 'gizmo|anvil' ELSE '^' || {noun} END AS pattern,
              'Names a ' || {noun} AS claim, 'high' AS confidence, 'fact' AS kind, CAST(NULL AS STRING) AS notes FROM {part}
            UNION ALL SELECT DISTINCT CAST(NULL AS STRING), 'audiences', 2 + p_size, 'number ' || CAST(p_size AS STRING) || '[.]', 'Size ' || CAST(p_size AS STRING), 'medium', 'inference', 'by text' FROM {part}
            UNION ALL SELECT DISTINCT CAST(NULL AS STRING), 'offerings', 0, CAST(NULL AS STRING), 'Sells parts', 'high', 'fact', '' FROM {part}
            UNION ALL SELECT DISTINCT CAST(NULL AS STRING), 'offerings', 99, 'no such ' || p_type, 'Never', 'low', 'fact', '' FROM {part}"""),
        "r_named": ([], f"""
            SELECT DISTINCT CAST(NULL AS STRING) AS project_slug, upper(p_name) AS label, {noun} AS named_family, '(?i)' || upper(p_name) AS pattern FROM {part}
            UNION ALL SELECT DISTINCT {own}, 'SIZE ' || CAST(p_size AS STRING), 'sizes', 'brand number ' || CAST(p_size AS STRING) || '[.]' FROM {part}"""),
        "r_labels": ([], f"""
            SELECT DISTINCT CAST(NULL AS STRING) AS project_slug, 'type ' || lower(p_type) AS page_label, '/' || lower(p_type) || '/' AS pattern, false AS search_headings FROM {part}
            UNION ALL SELECT DISTINCT {own}, 'ends in ' || {noun}, {noun} || '$', true FROM {part}
            UNION ALL SELECT DISTINCT {own}, 'never ' || {noun}, {noun} || '$', false FROM {part}"""),
        "r_terms": ([], f"""
            SELECT DISTINCT {own} AS project_slug, upper({noun}) AS term FROM {part}
            UNION ALL SELECT DISTINCT CAST(NULL AS STRING), 'Number ' || CAST(p_size AS STRING) || '.' FROM {part}"""),
    }


def _table(spark, folder, name):
    d = Spark(folder)
    return spark.sql(f"{ctes(d, [name], _rules(d))} SELECT * FROM {name}")


def _sql(names: list[str], body: str) -> str:
    d = Duck()
    given = ctes(d, names, {**W._web(d), **_rules(d)})
    return f"{given}{',' if body.lstrip().startswith('+') else ''} {body.lstrip().lstrip('+')}"


def _teams(spark, folder):
    size = F.regexp_extract("url", r"v=(\d+)$", 1)
    team = F.when(F.col("page_id") % 2 == 0, F.lit("team-0")).otherwise(F.concat(F.lit("team-"), size))
    return W._rich(spark, folder).withColumn("project_slug", team)


_PAGES = f"t AS (SELECT * EXCLUDE (project_slug), {_TEAM.format(key='page_id')} AS team, {W._RICH_URL} AS canon, {_SUMMARY} AS summary FROM w_rich)"


@query("facts_by_rules", _sql(["w_rich", "r_facts"], f"""
    + {_PAGES}, asked AS (SELECT 'page-' || CAST(page_id AS STRING) AS slug, canon, summary FROM t),
    met AS (SELECT slug, canon, summary, r.* FROM asked JOIN r_facts r ON slug = project_slug UNION ALL SELECT slug, canon, summary, r.* FROM asked JOIN r_facts r ON project_slug IS NULL)
    SELECT slug AS project_slug, section, pos, claim, canon AS source_url, confidence, kind, notes FROM met WHERE pattern IS NULL OR regexp_matches(summary, pattern)"""))
def facts_by_rules(spark, folder):
    own = W._rich(spark, folder).withColumn("project_slug", F.concat(F.lit("page-"), F.col("page_id").cast("string")))
    return rules.facts_by_rules(inventory.homepages(own), _table(spark, folder, "r_facts"))


@query("named_products", _sql(["w_rich", "r_named"], f"""
    + {_PAGES}, met AS (SELECT team, page_id, label, named_family, 0 AS behind FROM t JOIN r_named ON project_slug IS NULL AND regexp_matches(p_name, pattern)
      UNION ALL SELECT team, page_id, label, named_family, 1 FROM t JOIN r_named ON project_slug IS NULL AND regexp_matches(summary, pattern)
      UNION ALL SELECT team, page_id, label, named_family, 1 FROM t JOIN r_named ON project_slug = team AND regexp_matches(summary, pattern)),
    best AS (SELECT team, label, min(named_family) AS family, arg_min(page_id, behind * 1000000000 + page_id) AS page FROM met GROUP BY 1, 2),
    listed AS (SELECT DISTINCT team, label FROM t JOIN r_named ON project_slug IS NULL AND regexp_matches(p_name, pattern) WHERE p_type = 'PROMO')
    SELECT team AS project_slug, label AS name, family, canon AS source_url, summary AS description FROM (SELECT * FROM best ANTI JOIN listed USING (team, label)) b JOIN t USING (team)
    WHERE page_id = page"""))
def named_products(spark, folder):
    pages = _teams(spark, folder)
    found = rules.named_products(pages, inventory.product_inventory(pages), _table(spark, folder, "r_named"))
    return found.select("project_slug", "name", "family", "source_url", "description")


@query("pages_by_label", _sql(["w_rich", "r_labels"], f"""
    + {_PAGES}, met AS (SELECT team, canon, page_id, l.* FROM t JOIN r_labels l ON project_slug IS NULL AND regexp_matches(canon || p_name || ' ' || p_brand, pattern)
      UNION ALL SELECT team, canon, page_id, l.* FROM t JOIN r_labels l ON project_slug = team
        AND regexp_matches(canon || p_name || ' ' || p_brand || CASE WHEN search_headings THEN p_name ELSE '' END, pattern))
    SELECT team AS project_slug, page_label, arg_min(canon, page_id) AS url FROM met GROUP BY 1, 2 UNION ALL SELECT team, 'homepage', arg_min(canon, page_id) FROM t GROUP BY 1"""))
def pages_by_label(spark, folder):
    return rules.pages_by_label(_teams(spark, folder), _table(spark, folder, "r_labels"))


@query("terms_by_rules", _sql(["w_rich", "r_terms"], f"""
    + {_PAGES} SELECT team AS project_slug, page_id, canon AS url, term FROM t JOIN r_terms ON project_slug IS NULL AND contains(lower(summary), lower(term))
    UNION SELECT team, page_id, canon, term FROM t JOIN r_terms ON project_slug = team AND contains(lower(summary), lower(term))"""))
def terms_by_rules(spark, folder):
    return rules.terms_by_rules(_teams(spark, folder), _table(spark, folder, "r_terms"))
