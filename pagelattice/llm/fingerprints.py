"""SimHash near duplicates by fuzzy keys of the Golay code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm import golay
from pagelattice.llm.components import components
from pagelattice.llm.paths import block_pairs
from pagelattice.llm.tables import maybe_among, pick, rows_per, settled

RADIUS = 4
SEED = 42
# Fingerprints of one bounded group: two of them are compared as a matrix of this many rows and columns at most.
GROUP_ROWS = 4096
# Fingerprints whose keys one task makes.
KEYED_ROWS = 1 << 14


def simhash(text: str | None, n: int = 4) -> int:
    """The 64-bit SimHash of a whole text's n-word shingles, repeats included; 0 without words, the whole sequence with fewer than n."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = ends[min(n, len(words)) - 1 :].tolist()
    starts = (ends - sizes)[: len(last)].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        chunk = np.ascontiguousarray(h[at : at + (1 << 16)]).astype("<u8")
        ones += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as bigint), one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def _keys(prints: DataFrame) -> DataFrame:
    """(key, id): the fuzzy keys of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), 2048):
                own = ids[at : at + 2048]
                row, key = golay.keys(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], ["key", "id"])

    # A fingerprint of 8 bytes makes some 96 keys, so files of them are dealt into bounded tasks first.
    return prints.select("id").repartition(rows_per(prints.count(), KEYED_ROWS), "id").mapInArrow(run, "key long, id long")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def spanning(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of a bounded group which close fingerprints connect, less than one for each of its rows.

    Every row's distance to all others is looked at; of its close ones that are not yet joined to it, one link for each is kept.
    """
    root = np.arange(len(prints))
    a, b = [], []
    for i in range(len(prints)):
        close = np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius) + i + 1
        if not len(close):
            continue
        other, first = np.unique(root[close], return_index=True)
        new = other != root[i]
        for r, j in zip(other[new], close[first[new]]):
            a.append(i)
            b.append(j)
            root[root == r] = root[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def _within(groups: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        ids = np.unique(table["id"].to_numpy())
        a, b = spanning(ids.view(np.uint64))
        return pa.table({"a": ids[a], "b": ids[b]})

    return groups.select("key", "id").groupBy("key").applyInArrow(run, "a long, b long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links of at most ``RADIUS`` bits that connect whatever such links connect, of distinct fingerprints (id).

    Keys are counted by partial aggregates. A key of two fingerprints is a pair to be verified. Keys of more that hold the same
    fingerprints count once; their members are linked to the least one where they are close, and only what is in several components
    then goes on to bounded groups, where blocks of a key meet in pairs and all members are compared. So a key with very many close
    fingerprints costs a row for each of them, and only what is apart from the rest is compared with all of it.
    """
    keyed = _keys(prints)
    sums = F.sum(F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)))
    often = settled(keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"), sums.alias("s")).where("c > 1"))
    two = often.where("c = 2").select("lo", "hi").distinct().where(_near("lo", "hi")).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    crowds = settled(often.where("c > 2").groupBy("c", "lo", "hi", "s").agg(F.min("key").alias("k")).select("k", "lo"))
    members = maybe_among(keyed, F.col("key"), crowds.select("k")).join(crowds, F.col("key") == F.col("k")).select("key", "id", "lo")
    members = settled(members)
    stars = members.where("id != lo").where(_near("lo", "id")).select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    first = settled(two.unionByName(stars))
    found = components(first)
    placed = members.join(found.select(F.col("id").alias("i"), "component"), F.col("id") == F.col("i"), "left")
    placed = placed.select("key", "id", F.coalesce("component", "id").alias("comp"), F.lit(1).alias("n"))
    parted = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select(F.col("key").alias("k"))
    open_ = settled(placed.join(parted, F.col("key") == F.col("k"), "left_semi"))
    return first.unionByName(_within(block_pairs(open_, GROUP_ROWS, GROUP_ROWS * 2)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of ``docs``.

    Rows with equal fingerprints are one class. A null text and one without words have fingerprint 0 and are linked like any other. Rows
    that repeat an id are rows like others: each has the fingerprint of its own text, and the id alone links nothing. ``component_id``
    is the least id of all linked rows; a row without an id takes part, and where no linked row has one it is null. An empty table
    gives no rows; extra columns do not matter.
    """
    printed = settled(fingerprints(docs))
    prints = settled(printed.groupBy(F.col("fingerprint").alias("id")).agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    found = components(links(prints)).select(F.col("id").alias("i"), "component")
    placed = prints.join(found, F.col("id") == F.col("i"), "left").select("id", "least", "rows", F.coalesce("component", "id").alias("comp"))
    placed = settled(placed)
    firsts = placed.groupBy(F.col("comp").alias("c")).agg(F.min("least").alias("component_id"))
    named = placed.join(firsts, F.col("comp") == F.col("c")).select("id", "rows", "component_id")
    total = printed.count()
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    # Fingerprints of a thousandth of all rows or more are at most a thousand, and only those are broadcast; the others have no hot key.
    hot, cold = named.where(F.col("rows") * 1000 >= total), named.where(F.col("rows") * 1000 < total)
    near = printed.join(F.broadcast(hot), F.col("fingerprint") == F.col("id"), "left")
    known = near.where("rows IS NOT NULL").select("doc_id", text, "component_id")
    rest = near.where("rows IS NULL").select("doc_id", "fingerprint").join(cold, F.col("fingerprint") == F.col("id")).select("doc_id", text, "component_id")
    return known.unionByName(rest)
