"""Removal of long repeated strings by sharded suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.shingles import parts
from pagelattice.llm.suffixes import anchors, repeated_starts
from pagelattice.llm.tables import maybe_among, not_among, pick, rows_per, settled


@dataclass(frozen=True)
class Settings:
    """``length``: bytes of a repeated string. ``gram``: bytes of an anchor. ``shard_bytes`` bounds the text of a suffix array."""

    length: int = 400
    gram: int = 48
    shard_bytes: int = 2_000_000


def _anchored(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, h, first, last): runs of starts with one anchor, as offsets in the document's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for part in parts(texts, 1_000_000):
                doc, h, _, first, last = anchors([(t or "").encode() for t in texts[part]], s.length, s.gram)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part][doc], pa.int64()), pa.array(h), pa.array(first), pa.array(last)], ["doc_id", "h", "first", "last"])

    return docs.mapInArrow(run, "doc_id long, h long, first long, last long")


UNITS = "doc_id long, first long, h long, f1 long, f2 long, size int, unit binary"


def _units(docs: DataFrame, runs: DataFrame, s: Settings) -> DataFrame:
    """A row per run: its anchor, a 128-bit fingerprint of it, and the bytes of its strings."""
    listed = runs.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "h")).alias("runs")).withColumnRenamed("doc_id", "d")
    both = maybe_among(docs, F.col("doc_id"), runs.select("doc_id")).join(listed, F.col("doc_id") == F.col("d")).select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                first, last, h = (own.values.field(c).to_numpy() for c in ("first", "last", "h"))
                for start in range(0, len(first), 2000):
                    cut = slice(start, start + 2000)
                    units = [data[a : b + s.length] for a, b in zip(first[cut], last[cut])]
                    prints = np.frombuffer(b"".join(blake2b(u, digest_size=16).digest() for u in units), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc_id] * len(units), pa.int64()), pa.array(first[cut]), pa.array(h[cut]), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                            pa.array([len(u) for u in units], pa.int32()), pa.array(units, pa.binary()),
                        ],
                        [c.split()[0] for c in UNITS.split(", ")],
                    )

    return both.mapInArrow(run, UNITS)


def _merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered intervals of sorted starts of ``length``-byte strings."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(x[0]), int(x[-1]) + length) for x in np.split(starts, cut)]


def _laid_out(shard: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's text, its valid starts, and the unit and the unit's begin of each text position."""
    units = shard["unit"].to_pylist()
    sizes = np.array([len(u) for u in units], np.int64)
    begins = np.r_[0, np.cumsum(sizes)][:-1]
    text = np.frombuffer(b"".join(units), np.uint8)
    owner = np.repeat(np.arange(len(units)), sizes)
    at = np.arange(len(text)) - begins[owner]
    return text, np.flatnonzero(at + length <= sizes[owner]), owner, begins


FOUND = "f1 long, f2 long, a int, b int"
EDGES = "shard long, f1 long, f2 long, at int, w1 long, w2 long"


def _found_rows(shard: pa.Table, repeated: np.ndarray, owner: np.ndarray, begins: np.ndarray, length: int) -> pa.Table:
    out: tuple[list, list, list] = ([], [], [])
    of = owner[repeated]
    for own in np.split(repeated, np.flatnonzero(np.diff(of)) + 1) if len(repeated) else []:
        u = int(owner[own[0]])
        for a, b in _merged(own - begins[u], length):
            out[0].append(u)
            out[1].append(a)
            out[2].append(b)
    take = pa.array(out[0], pa.int64())
    return pa.table({"f1": shard["f1"].take(take), "f2": shard["f2"].take(take), "a": pa.array(out[1], pa.int32()), "b": pa.array(out[2], pa.int32())})


def _in_shards(units: DataFrame, s: Settings) -> DataFrame:
    """Covered intervals of each distinct unit from strings that stand twice in its shard, by suffix array and common prefixes."""

    def run(shard: pa.Table) -> pa.Table:
        text, starts, owner, begins = _laid_out(shard, s.length)
        repeated, _ = repeated_starts(text, starts, s.length)
        return _found_rows(shard, np.flatnonzero(repeated), owner, begins, s.length)

    return units.groupBy("shard").applyInArrow(run, FOUND)


def _across_shards(units: DataFrame, s: Settings, ranges: int) -> DataFrame:
    """(f1, f2, a, b) for the strings of anchors that are dealt over several shards: each shard hands on one fingerprint of each of its distinct
    strings, dealt by range, and a binary search in the sorted fingerprints of a range finds those of two shards."""

    def fingerprints(shard: pa.Table) -> pa.Table:
        text, starts, owner, begins = _laid_out(shard, s.length)
        _, distinct = repeated_starts(text, starts, s.length)
        data = text.tobytes()
        prints = np.frombuffer(b"".join(blake2b(data[i : i + s.length], digest_size=16).digest() for i in distinct), np.int64).reshape(-1, 2)
        of = pa.array(owner[distinct])
        return pa.table({
            "shard": shard["shard"].take(of), "f1": shard["f1"].take(of), "f2": shard["f2"].take(of),
            "at": pa.array((distinct - begins[owner[distinct]]).astype(np.int32)), "w1": pa.array(prints[:, 0]), "w2": pa.array(prints[:, 1]),
        })

    def merge(rows: pa.Table) -> pa.Table:
        # Both halves as one sortable string, so that a binary search compares them whole.
        w = np.ascontiguousarray(np.stack([rows["w1"].to_numpy(), rows["w2"].to_numpy()], 1).astype(">i8")).view("V16").ravel()
        listed = np.sort(w)
        twice = np.searchsorted(listed, w, "right") - np.searchsorted(listed, w, "left") > 1
        return pa.table({c: rows[c].filter(pa.array(twice)) for c in ("w1", "w2")})

    prints = settled(units.groupBy("shard").applyInArrow(fingerprints, EDGES))
    by_range = prints.withColumn("range", F.pmod("w1", F.lit(ranges)))
    twice = by_range.select("range", "w1", "w2").groupBy("range").applyInArrow(merge, "w1 long, w2 long").distinct()
    t = twice.select(F.col("w1").alias("v1"), F.col("w2").alias("v2"))
    both = prints.join(t, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")), "left_semi")
    return both.select("f1", "f2", F.col("at").alias("a"), (F.col("at") + s.length).alias("b"))


def repeated_spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, a, b): byte intervals covered by ``length``-byte strings that start anywhere else too. They may overlap.

    Two equal strings have the same anchor, their least ``gram``-byte piece, so only runs of starts whose anchor occurs twice can hold a
    repeat; all other text is left behind by a count of anchors. A run's bytes are a unit, and equal units are one. A unit that occurs
    twice is covered in full; anchors with several units, one of which is single, go to suffix arrays, sharded by anchor. An
    anchor with more text than a shard is dealt over several, whose distinct strings are then merged.
    """
    d = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = settled(_anchored(d, s))
    often = runs.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("n")).where("n > 1").select("g")
    runs = settled(runs.join(often, F.col("h") == F.col("g"), "left_semi"))
    units = settled(_units(d, runs, s))

    kinds = units.groupBy("h", "f1", "f2").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    whole = kinds.where("n > 1").select("f1", "f2", F.lit(0).alias("a"), F.col("size").alias("b"))
    mixed = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), F.sum("size").alias("bytes")).where("kinds > 1 AND least = 1")
    mixed = settled(mixed.select(F.col("h").alias("g"), F.ceil(F.col("bytes") / s.shard_bytes).alias("dealt"), "bytes"))
    total = mixed.agg(F.sum("bytes")).first()[0] or 0
    shards = rows_per(total, s.shard_bytes // 2)
    distinct = units.join(mixed, F.col("h") == F.col("g")).groupBy("h", "f1", "f2", "dealt").agg(F.max("unit").alias("unit"))
    shard = F.when(F.col("dealt") > 1, F.xxhash64("h", F.pmod("f1", F.col("dealt")))).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards)))
    distinct = settled(distinct.select(shard.alias("shard"), "f1", "f2", "dealt", "unit"))
    found = whole.unionByName(_in_shards(distinct, s))

    spread = distinct.where("dealt > 1")
    if not spread.isEmpty():
        found = found.unionByName(_across_shards(spread, s, max(1, 4 * shards)))

    x = found.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "a", "b")
    of = units.select("doc_id", "first", "f1", "f2").join(x, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")))
    return of.select("doc_id", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def _kept(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, the bytes and the maximal runs removed."""
    gone = np.zeros(len(data) + 1, np.int32)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    text = np.frombuffer(data, np.uint8)
    return text[~covered].tobytes(), int(covered.sum()), int((covered & ~np.r_[False, covered[:-1]]).sum())


def without_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document's bytes without those covered by repeated strings.

    Every byte that a ``length``-byte string covers which also starts anywhere else, in the same document or another, goes; matches never
    cross documents, and all strings are judged on the input. A null text counts as empty. Rows without an id are left
    out; of rows that repeat an id, the largest text in order counts. Documents that can have no span pass without a shuffle.
    """
    d = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not d.groupBy("doc_id").count().where("count > 1").isEmpty():
        d = settled(d.groupBy("doc_id").agg(F.max("text").alias("text")))
    spans = settled(repeated_spans(d, s).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans")).withColumnRenamed("doc_id", "d"))
    plain = d.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    marked = maybe_among(plain, F.col("doc_id"), spans.select("d"))
    cut = marked.join(spans, F.col("doc_id") == F.col("d"), "left").select("doc_id", "data", "spans")
    clear = not_among(plain, F.col("doc_id"), spans.select("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time
                data, own = batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or []
                kept, removed, runs = _kept(data, [(x["a"], x["b"]) for x in own])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(data)]), pa.array([removed]), pa.array([runs]), pa.array([kept], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    zero = F.lit(0).cast("long")
    same = clear.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("data").alias("kept"))
    return same.unionByName(cut.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def digest(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return without_repeats(docs, s).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
