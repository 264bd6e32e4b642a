"""The registered queries of this package, a thin one for each operator, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm import backoff, centroids, codebooks, decontaminate, fingerprints, language, licenses, lines, mixing, neardup, repeats, token_counts, topk
from pagelattice.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.score(table(spark, folder, "documents"))


ORACLES["op1_lm_scores"] = r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), p AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t
), g AS (
  SELECT *, lag(w) OVER d AS w1, lag(w, 2) OVER d AS w2 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    count(*) OVER (PARTITION BY w1, w) - count(*) OVER (PARTITION BY doc_id, w1, w) AS c2,
    count(*) OVER (PARTITION BY w2, w1, w) - count(*) OVER (PARTITION BY doc_id, w2, w1, w) AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n
  FROM g
), h AS (
  SELECT *, lag(c1) OVER d AS d2, lag(c2) OVER d AS d3, least(i, 3) AS longest
  FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), u AS (
  SELECT *, CASE WHEN longest = 3 AND c3 > 0 THEN 3 WHEN longest >= 2 AND c2 > 0 THEN 2 ELSE 1 END AS used FROM h
), v AS (
  SELECT doc_id, used, CAST(round(1000000 * (
    ln(greatest(CASE used WHEN 3 THEN c3 WHEN 2 THEN c2 ELSE c1 END, 1)) - ln(greatest(CASE used WHEN 3 THEN d3 WHEN 2 THEN d2 ELSE n END, 1))
    + (longest - used) * ln(0.4::DOUBLE))) AS BIGINT) AS s
  FROM u
)
SELECT t.doc_id, count(v.s) AS n_words, CAST(coalesce(sum(v.s), 0) AS BIGINT) AS log_score,
  count(CASE WHEN used = 1 THEN 1 END) AS n_order_1, count(CASE WHEN used = 2 THEN 1 END) AS n_order_2, count(CASE WHEN used = 3 THEN 1 END) AS n_order_3
FROM t LEFT JOIN v USING (doc_id) GROUP BY t.doc_id
"""


@_query
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mixed(docs, mixing.tempered_weights(docs))


@_query
def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@_query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@_query
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    templates = spark.createDataFrame(licenses.NOTICES, "license string, text string")
    return licenses.scan(licenses.page_files(table(spark, folder, "pages")), templates, any_notice=True)


@_query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 AS over_limit")


@_query
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query
def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(table(spark, folder, "documents"))


@_query
def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantized(table(spark, folder, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLES["op9_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.kept_lines(table(spark, folder, "documents"))


@_query
def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.digest(table(spark, folder, "embeddings"))


@_query
def op12_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.near_duplicates(table(spark, folder, "documents"))


@_query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codebooks.digest(table(spark, folder, "embeddings"))


# Squared distance of two integer lists, and the floor of sum / count.
_SQUARE = "CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))) AS BIGINT)"
_FLOOR = "CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END"


def _clustering_sql(rounds: int = 5) -> str:
    """The rounds written out one by one: a<r> assigns the vectors to the centroids c<r>."""
    steps = ["""
v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS k, w FROM v ORDER BY k LIMIT 40
)"""]
    for r in range(rounds + 1):
        d = _SQUARE.format(a="v.w", b="c.w")
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, v.w, c.k, {d} AS d FROM v CROSS JOIN c{r} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.k) = 1)")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT k, i, CAST(sum(w[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, w, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY k, i
), c{r + 1} AS MATERIALIZED (
  SELECT k, list({_FLOOR} ORDER BY i) AS w FROM s{r} GROUP BY k UNION ALL SELECT k, w FROM c{r} WHERE k NOT IN (SELECT k FROM a{r})
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)
"""


ORACLES["op11_centroid_clustering"] = _clustering_sql()


def _codes_sql(rounds: int = 6) -> str:
    """The rounds written out one by one: a<r> assigns the parts (vec_id, p) to the entries of c<r>."""
    steps = ["""
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), w AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(x, 8 * p + 1, 8 * p + 8) AS w FROM (SELECT *, unnest(range(0, 8)) AS p FROM v)
), c0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS k, w FROM w QUALIFY k < 16
)"""]
    for r in range(rounds + 1):
        d = _SQUARE.format(a="w.w", b="c.w")
        steps.append(f"a{r} AS MATERIALIZED (SELECT w.vec_id, w.label, w.p, w.w, c.k, {d} AS d FROM w JOIN c{r} c USING (p) QUALIFY row_number() OVER (PARTITION BY w.vec_id, w.p ORDER BY d, c.k) = 1)")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT p, k, i, CAST(sum(w[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, k, w, unnest(range(1, 9)) AS i FROM a{r}) GROUP BY p, k, i
), c{r + 1} AS MATERIALIZED (
  SELECT p, k, list({_FLOOR} ORDER BY i) AS w FROM s{r} GROUP BY p, k UNION ALL SELECT p, k, w FROM c{r} WHERE (p, k) NOT IN (SELECT (p, k) FROM a{r})
)""")
    return "WITH " + ", ".join(steps) + f""", f AS (
  SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM f
"""


ORACLES["op13_vector_codes"] = _codes_sql()
