"""Product codes of vectors: codebooks refined with adaptive bounds on the closest entries of every part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.vectors import SLACK, all_distances, discard, distances, integers, lists, matrix, settled_at, sums

STATE = "vec_id long, label {label}, x array<int>, codes binary, near binary, upper binary, lower binary, deepest int"
RESULT = "vec_id long, label {label}, code string, error long"


@dataclass(frozen=True)
class Settings:
    """``parts`` equal parts of ``dims`` components of ``scale`` * x, ``entries`` (at most 256) for each, moved ``rounds`` times.

    ``closest`` is how many closest entries besides its own a part remembers at first.
    """

    parts: int = 8
    entries: int = 16
    dims: int = 64
    scale: int = 4096
    rounds: int = 6
    closest: int = 6


class Codebook:
    """The entries of one part position and how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        self.moved = np.zeros(len(at)) if before is None else np.sqrt(distances(at, before).astype(np.float64))


class Bounds:
    """What is remembered of the parts at one position, by row.

    ``code`` is the part's own entry and ``upper`` bounds its distance from above. ``near`` are the next closest entries when they
    were last compared, and ``lower[:, i]`` bounds the distance of ``near[:, i]`` from below; the last column of ``lower`` is the
    outer bound, of all other entries. ``deepest`` is the largest rank that the last search needed.
    """

    def __init__(self, code: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, deepest: int = 0):
        self.code, self.upper, self.near, self.lower, self.deepest = code, upper, near, lower, deepest

    @property
    def b(self) -> int:
        return self.near.shape[1]

    def narrowed(self, b: int) -> Bounds:
        """With the ``b`` closest entries only; the bounds of the others go into the outer one."""
        if b >= self.b:
            return self
        outer = self.lower[:, b:].min(1)
        return Bounds(self.code, self.upper, self.near[:, :b], np.c_[self.lower[:, :b], outer], self.deepest)


def full_search(x: np.ndarray, book: Codebook, b: int) -> Bounds:
    """Bounds from all distances. Entries are ranked by integer distance, then number."""
    d = all_distances(x, book.at)
    order = np.argsort(d, axis=1, kind="stable")
    ranked = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    outer = ranked[:, b + 1] if len(book.at) > b + 1 else np.full(len(x), np.inf)
    return Bounds(order[:, 0].copy(), ranked[:, 0].copy(), order[:, 1 : b + 1].copy(), np.c_[ranked[:, 1 : b + 1], outer])


def search(x: np.ndarray, held: Bounds, book: Codebook) -> tuple[Bounds, int]:
    """Bounds after the entries moved, and the number of distances it took.

    Every bound moves by the way of its own entry, the outer one by the longest way of any. With least(i) the least of the bounds from rank i
    on, a part is certain where its upper bound lies below least(0). Else its own distance is made exact, and with the first
    rank r whose least(r) lies above it, only its own and the r closest entries are compared, by integer distance, then
    number. Where no rank will do, all entries are compared. Bounds only exclude by a margin, so ties are always compared.
    """
    n, b = len(x), held.b
    upper = held.upper + book.moved[held.code]
    lower = held.lower.copy()
    lower[:, :b] -= book.moved[held.near]
    lower[:, b] -= book.moved.max(initial=0.0)
    least = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    code, near, out = held.code.copy(), held.near.copy(), least.copy()
    rows = np.flatnonzero(~(upper * (1 + SLACK) < least[:, 0] * (1 - SLACK)))
    own = distances(x[rows], book.at[code[rows]])
    upper[rows] = np.sqrt(own.astype(np.float64))
    taken = len(rows)
    certain = upper[rows, None] * (1 + SLACK) < least[rows] * (1 - SLACK)
    rank = np.where(certain.any(1), certain.argmax(1), b + 1)
    deepest = int(rank[rank <= b].max(initial=0))
    for r in range(1, deepest + 1):
        at = rows[rank == r]
        if not len(at):
            continue
        asked = np.c_[code[at], near[at, :r]]
        d = np.stack([own[rank == r], *[distances(x[at], book.at[asked[:, i]]) for i in range(1, r + 1)]], 1)
        taken += r * len(at)
        order = np.lexsort((asked, d), axis=1)
        asked, d = np.take_along_axis(asked, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        code[at], upper[at], near[at, :r], out[at, :r] = asked[:, 0], d[:, 0], asked[:, 1:], d[:, 1:]
    at = rows[rank == b + 1]
    if len(at):
        found = full_search(x[at], book, b)
        taken += len(at) * len(book.at)
        code[at], upper[at], near[at], out[at] = found.code, found.upper, found.near, found.lower
    return Bounds(code, upper, near, out, deepest), taken


def _starts(kept: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors with the smallest ids, ascending, then by components: entry i of every part is that part of the i-th."""
    rows = kept.where("vec_id IS NOT NULL").select("vec_id", "x").orderBy("vec_id", "x").limit(settings.entries).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, settings.dims)


def _rows(values: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    wide = np.ascontiguousarray(values).reshape(len(values), -1)
    data, width = wide.tobytes(), wide.dtype.itemsize * wide.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer((np.arange(len(wide) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _bytes(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _down(values: np.ndarray) -> np.ndarray:
    """Single floats that are not above the values."""
    return np.nextafter(values.astype(np.float32), np.float32(-np.inf))


def _up(values: np.ndarray) -> np.ndarray:
    return np.nextafter(values.astype(np.float32), np.float32(np.inf))


def _state(ids: pa.Array, labels: pa.Array, x: np.ndarray, found: list[Bounds]) -> pa.RecordBatch:
    """Rows with the bounds of all positions, as single floats rounded outwards; all positions keep as many as the one that needs most."""
    codes = np.stack([f.code for f in found], 1).astype(np.uint8)
    near = np.stack([f.near for f in found], 1).astype(np.uint8)
    upper, lower = _up(np.stack([f.upper for f in found], 1)), _down(np.stack([f.lower for f in found], 1))
    deepest = pa.array(np.full(len(x), max(f.deepest for f in found)), pa.int32())
    return pa.RecordBatch.from_arrays([ids, labels, lists(x, pa.int32()), _rows(codes), _rows(near), _rows(upper), _rows(lower), deepest], ["vec_id", "label", "x", "codes", "near", "upper", "lower", "deepest"])


def _bounds(batch: pa.RecordBatch, parts: int, b: int, narrow: int) -> list[Bounds]:
    codes = _bytes(batch.column(3), np.uint8, parts).astype(np.int64)
    near = _bytes(batch.column(4), np.uint8, parts, b).astype(np.int64) if b else np.zeros((batch.num_rows, parts, 0), np.int64)
    upper = _bytes(batch.column(5), np.float32, parts).astype(np.float64)
    lower = _bytes(batch.column(6), np.float32, parts, b + 1).astype(np.float64)
    return [Bounds(codes[:, p], upper[:, p], near[:, p], lower[:, p]).narrowed(narrow) for p in range(parts)]


def coded(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every vector that takes part, final codebooks as parts x entries x components).

    A round reads vectors and bounds once, writes them with new bounds and deletes the table of the round before. All rounds
    keep as many closest entries as the last search needed at its deepest (never more than before, at least one), so bounds that
    do not pay are neither stored nor moved. Only codebooks, ``entries`` x ``dims`` numbers, and that rank pass the driver. Unused entries
    stay where they are. Fewer vectors than entries make fewer entries; vectors without an id start none.
    """
    if not 1 <= settings.entries <= 256 or settings.rounds < 1 or settings.dims % settings.parts:
        raise ValueError("1 to 256 entries, a round and equal parts are needed")
    spark, parts, dims, width = vectors.sparkSession, settings.parts, settings.dims, settings.dims // settings.parts
    kept = integers(vectors, settings.scale, dims, "label")
    label = kept.schema["label"].dataType.simpleString()
    at = _starts(kept, settings).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    if not at.shape[1]:
        return spark.createDataFrame([], RESULT.format(label=label)), at
    b = min(settings.closest, at.shape[1] - 1)
    books = [Codebook(a) for a in at]

    def cut(x: np.ndarray) -> list[np.ndarray]:
        return [x[:, p * width : (p + 1) * width] for p in range(parts)]

    def begin(batches: Iterator[pa.RecordBatch], books: list[Codebook] = books, b: int = b) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            yield _state(batch.column(0), batch.column(2), x, [full_search(part, book, b) for part, book in zip(cut(x), books)])

    state, path = settled_at(kept.select("vec_id", "x", "label").mapInArrow(begin, STATE.format(label=label)))
    for number in range(settings.rounds):

        def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            codes = _bytes(batch.column(1), np.uint8, parts).astype(np.int64)
            return (codes + 256 * np.arange(parts)).ravel(), matrix(batch.column(0), dims).reshape(-1, width)

        found = sums(state, ["x", "codes"], keyed, width)
        narrow = b
        if number:
            narrow = min(b, max(1, state.agg(F.max("deepest")).first()[0] or 0))
        at = at.copy()
        for k, (n, total) in found.items():
            at[k // 256, k % 256] = [s // n for s in total]
        books = [Codebook(a, old.at) for a, old in zip(at, books)]
        last = number == settings.rounds - 1

        def go_on(batches: Iterator[pa.RecordBatch], books: list[Codebook] = books, b: int = b, narrow: int = narrow, last: bool = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(2), dims)
                out = [search(part, held, book)[0] for part, held, book in zip(cut(x), _bounds(batch, parts, b, narrow), books)]
                if not last:
                    yield _state(batch.column(0), batch.column(1), x, out)
                    continue
                codes = np.stack([f.code for f in out], 1).astype(np.uint8)
                error = sum(distances(part, book.at[f.code]) for part, book, f in zip(cut(x), books, out))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

        old, b = path, narrow
        state, path = settled_at(state.mapInArrow(go_on, (RESULT if last else STATE).format(label=label)))
        discard(spark, old)
    return state, at


def digest(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part.

    Errors of equal labels are summed by partial aggregates and joined back, null labels being equal; a sum beyond 64 bits is null. Which
    vectors take part, and what becomes of null and repeated ids, is said at ``integers`` and ``coded``. Extra columns do not matter.
    """
    rows, at = coded(vectors, settings)
    named = hashlib.sha256(",".join(map(str, at.ravel().tolist())).encode()).hexdigest()
    summed = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("all"), F.count("*").alias("n"))
    summed = summed.select(F.col("label").alias("same"), F.expr("try_cast(`all` AS bigint)").alias("label_error"), "n")
    total = rows.count()
    # Labels with a thousandth of all rows or more are at most a thousand, and only those are broadcast; the others have no hot key.
    hot, cold = summed.where(F.col("n") * 1000 >= total), summed.where(F.col("n") * 1000 < total)
    near = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("same")), "left")
    known = near.where("n IS NOT NULL").select("vec_id", "code", "error", "label_error")
    rest = near.where("n IS NULL").select("vec_id", "label", "code", "error").join(cold, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error")
    return known.unionByName(rest).withColumn("codebooks_sha256", F.lit(named))
