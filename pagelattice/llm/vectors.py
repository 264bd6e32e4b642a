"""What the iterative vector operators share: integer vectors, exact distances, exact sums of the members of each centroid."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.tables import pick
from pagelattice.session import shared_folder

# Integer components lie within this, so that a squared distance of up to 64 of them fits 64 bits.
LIMIT = 1 << 27
# Bounds are doubles; a bound decides only where it is apart by more than this share, which is far above their rounding.
SLACK = 1e-9


def integers(vectors: DataFrame, scale: int, dims: int, *more: str) -> DataFrame:
    """(vec_id, x array<int>, more ...): each component c as floor(scale * c), held within ``LIMIT``.

    Vectors that are null, hold a null or non-finite component or have another length take no part. Rows without an id and
    rows that repeat an id are rows like others.
    """
    v = pick(vectors, "vec_id", "embedding", *more).where(F.col("embedding").isNotNull() & (F.size("embedding") == dims))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))

    def whole(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c.cast("double") * F.lit(float(scale)), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int")

    return v.where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x"), *more)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as an Arrow column of lists."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to the same row of ``c``."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def all_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 20 and x.shape[1] <= 1 << 10:  # then all sums are whole doubles
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return np.stack([distances(x, row[None, :]) for row in c], 1)


def sums(rows: DataFrame, columns: list[str], labels: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], width: int) -> dict[int, tuple[int, list[int]]]:
    """Members and exact componentwise sums by key, over all rows.

    ``labels`` makes (keys, vectors) of a batch. A task returns one row for each key it met, so what is shuffled and what reaches the
    driver is bounded by the number of keys; a key with most of the rows is summed where its rows are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x = labels(batch)
            order = np.argsort(keys, kind="stable")
            own, begins = np.unique(keys[order], return_index=True)
            added = np.add.reduceat(x[order], begins)
            for k, n, s in zip(own.tolist(), np.diff(np.r_[begins, len(keys)]).tolist(), added):
                if k in held:
                    held[k][0] += n
                    held[k][1] += s
                else:
                    held[k] = [n, s.copy()]
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), lists(np.array([s for _, s in held.values()]), pa.int64())],
                ["key", "n", "sums"],
            )

    partial = rows.select(*columns).mapInArrow(run, "key int, n long, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    found = partial.groupBy("key").agg(F.sum("n").alias("n"), *added).collect()
    return {r["key"]: (r["n"], [int(r[f"s{i}"]) for i in range(width)]) for r in found}


def settled_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written to the shared folder and read back, and where they lie."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of an earlier round, once the next one is written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
