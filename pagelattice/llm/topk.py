"""Exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.llm.tables import pick, rows_per

FOUND = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, weights): each component x as floor(scale * x).

    Vectors that are null or hold a null or non-finite component, and rows without an id, take
    no part. An empty vector takes part and scores 0. Of several rows under one vec_id the one
    with the smallest weights counts.
    """
    v = pick(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    weights = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return v.where(finite).groupBy("vec_id").agg(F.min(weights).alias("weights"))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and weights of the non-zero entries."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
    keep = flat != 0
    return row[keep], term[keep], flat[keep]


def _by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    cut = np.flatnonzero(np.diff(term)) + 1
    return {int(t[0]): (r, w) for t, r, w in zip(np.split(term, cut), np.split(row, cut), np.split(weight, cut)) if len(t)}


def best_of_block(cand_ids: np.ndarray, cand: tuple, query_ids: np.ndarray, query: tuple, k: int, rows: int = 256) -> tuple[list, list, list]:
    """The k best of one block for each query: dense scores filled term by term, then a partition."""
    postings, wanted = _by_term(*cand), _by_term(*query)
    out: tuple[list, list, list] = ([], [], [])
    for start in range(0, len(query_ids), rows):
        stop = min(start + rows, len(query_ids))
        scores = np.zeros((stop - start, len(cand_ids)), np.int64)
        for term, (at, weight) in wanted.items():
            if term not in postings:
                continue
            lo, hi = np.searchsorted(at, (start, stop))
            ids, values = postings[term]
            if len(ids) == len(cand_ids):
                scores[at[lo:hi] - start] += weight[lo:hi, None] * values
            else:
                scores[np.ix_(at[lo:hi] - start, ids)] += weight[lo:hi, None] * values
        for i in range(stop - start):
            others = np.flatnonzero(cand_ids != query_ids[start + i])
            row = scores[i, others]
            if len(row) > k:
                near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                others, row = others[near], row[near]
            for j in np.lexsort((cand_ids[others], -row))[:k]:
                out[0].append(int(query_ids[start + i]))
                out[1].append(int(cand_ids[others[j]]))
                out[2].append(int(row[j]))
    return out


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best candidates but itself, ties to the smaller id.

    ``candidates`` and ``queries`` have (vec_id, weights array<bigint>); entries past the end of
    the shorter array count as 0, and sums are 64-bit integers. Both sides are dealt into
    hash blocks of about ``block_rows`` rows, and each pair of blocks is one bounded
    group: its scores are accumulated densely, only k rows of each query leave it, and a
    partial top-k merges them. All (fewer) rows come back where fewer than k exist; empty
    tables give no rows.
    """
    blocks, query_blocks = (rows_per(df.count(), block_rows) for df in (candidates, queries))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.select("vec_id", "weights", own(blocks).alias("block"), every(query_blocks).alias("query_block"))
    right = queries.select("vec_id", "weights", own(query_blocks).alias("query_block"), every(blocks).alias("block"))

    def score(cands: pa.Table, asked: pa.Table) -> pa.Table:
        out = best_of_block(cands["vec_id"].to_numpy(), _lists(cands["weights"]), asked["vec_id"].to_numpy(), _lists(asked["weights"]), k) if len(cands) and len(asked) else ([], [], [])
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out)})

    found = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInArrow(score, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
