"""MinHash near-duplicates by a chosen-path similarity join with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm import paths
from pagelattice.llm.components import components
from pagelattice.llm.shingles import minhashes, multipliers, parts, shingle_sets
from pagelattice.llm.tables import maybe_among, pick, settled, settled_alone


@dataclass(frozen=True)
class Settings:
    """A pair at the threshold survives a tree with probability 0.67. Nodes draw their coordinates from ``coordinates`` minhashes beside those of
    the trees; as these are few, 16 trees of all levels lose about 3 in 10**5 of such pairs, and one in 10**8 if all were independent.

    ``minority``: a node's pairs are listed when all but so many of its documents are in one component already; that is
    linear in the node. ``node_rows`` and ``node_shingles`` bound a node that is compared exhaustively in one task. A node with a child of ``shrink``
    of its rows or more is compared by pairs of blocks, as branching would repeat its rows more often. ``likely`` is the agreement of the
    sketches below which a pair is not verified: with 128 entries a pair at 0.75 is six standard deviations above it.
    """

    words: int = 5
    percent: int = 75
    trees: int = 16
    coordinates: int = 64
    sketch: int = 128
    minority: int = 16
    branches: int = 2
    depth: int = 12
    shrink: float = 0.7
    node_rows: int = 1024
    node_shingles: int = 2_000_000
    likely: float = 0.5


SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, trees array<long>, path array<int>, sketch binary"


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """A row per document: set size, a 128-bit fingerprint of the set, minhashes for the paths, a byte of each minhash as a sketch.

    ``trees`` are whole minhashes, ``path`` are 32 bits of those that nodes branch by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = multipliers(s.sketch)
        f = multipliers(2, 12)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in parts(texts):
                sets = shingle_sets(texts[part], s.words)
                least = minhashes(sets, a)
                prints = np.array([[np.bitwise_xor.reduce(x * m) if k else np.sum((x ^ (x >> np.uint64(31))) * m, dtype=np.uint64) for k, m in enumerate(f)] for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
                trees = np.ascontiguousarray(least[:, : s.trees]).view(np.int64)
                path = (least[:, s.trees : s.trees + s.coordinates] >> np.uint64(16)).astype(np.uint32).view(np.int32)
                low = (least >> np.uint64(40)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.start, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                        *[pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (trees, path)],
                        pa.array([r.tobytes() for r in low], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "trees", "path", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def _alike(s: Settings) -> F.Column:
    """Set sizes that allow the threshold."""
    return F.least("n", "n2") * 100 >= F.greatest("n", "n2") * s.percent


def _likely(pairs: DataFrame, signed: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose sketches agree often enough to be worth verifying."""
    sk = signed.select(F.col("doc_id").alias("d"), "sketch")
    both = pairs.join(sk, F.col("a") == F.col("d")).drop("d").withColumnRenamed("sketch", "s1")
    both = both.join(sk, F.col("b") == F.col("d")).select("a", "b", "s1", F.col("sketch").alias("s2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, s.sketch) for i in (2, 3))
            keep = (x == y).mean(1) >= s.likely
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold."""
    t = texts.select(F.col("doc_id").alias("d"), F.col("text"))
    both = pairs.join(t, F.col("a") == F.col("d")).drop("d").withColumnRenamed("text", "t1")
    both = both.join(t, F.col("b") == F.col("d")).select("a", "b", "t1", F.col("text").alias("t2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}  # the set compared last on either side

        def set_of(side: int, i: int, text: str) -> np.ndarray:
            if last.get(("id", side)) != i:
                last["id", side], last[side] = i, shingle_sets([text], s.words)[0]
            return last[side]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(len(a)):  # one pair of texts at a time
                x, y = set_of(0, a[i], batch.column(2)[i].as_py()), set_of(1, b[i], batch.column(3)[i].as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= s.percent * (len(x) + len(y) - common):
                    yield pa.RecordBatch.from_arrays([pa.array([a[i]]), pa.array([b[i]])], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of a few documents."""
    wanted = settled(ids.select(F.col("id").alias("w")))
    return settled(maybe_among(docs, F.col("doc_id"), wanted).join(wanted, F.col("doc_id") == F.col("w"), "left_semi"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a bounded number of sets: rare shingles by their pairs, frequent ones by matrix products."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, at, size = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    owner, size_of = owner[order], size[at[order]]
    out = np.zeros((n, n), np.float32)
    for c in range(2, 9):
        rows = owner[size_of == c].reshape(-1, c)
        for i in range(c):
            for j in range(i):
                np.add.at(out, (rows[:, i], rows[:, j]), 1)
                np.add.at(out, (rows[:, j], rows[:, i]), 1)
    often = owner[size_of > 8]
    sizes = size[size > 8]
    ends = np.cumsum(sizes)
    for start in range(0, len(sizes), 2048):
        stop = min(start + 2048, len(sizes))
        own = often[ends[start] - sizes[start] : ends[stop - 1]]
        x = np.zeros((n, stop - start), np.float32)
        x[own, np.repeat(np.arange(stop - start), sizes[start:stop])] = 1
        out += x @ x.T
    return out


def spanning_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a bounded node that connect what its linked documents connect: one fewer than documents at most."""
    common, n = common_counts(sets), np.array([len(x) for x in sets], np.float32)
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    left, out = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if left[root]:
            left[root], todo = False, [root]
            while todo:
                i = todo.pop()
                new = np.flatnonzero(linked[i] & left)
                left[new] = False
                todo += new.tolist()
                out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in new]
    return out


def _exhaustive(members: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) within each node (key), whose members are compared on their full sets in one task."""
    t = texts.select(F.col("doc_id").alias("d"), "text")
    rows = members.select("key", "id").distinct().join(t, F.col("id") == F.col("d")).select("key", "id", "text")

    def run(node: pa.Table) -> pa.Table:
        links = spanning_links(node["id"].to_pylist(), shingle_sets(node["text"].to_pylist(), s.words), s.percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("key").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document.

    Documents are linked if the Jaccard similarity of their word-shingle sets is ``percent`` or more; component_id is the smallest
    doc_id reachable and kept marks it. Equal sets are one class from the start and only its smallest id is compared. Each
    tree sends a class to the node of one of its minhashes; a node that holds several components compares its first member with
    all, and its minority with all once that is small. Links found so are verified and unified, which ends most nodes: one with a single
    component is dropped, without loss, so a huge group of near copies stays linear. Of the others, small nodes are compared exhaustively and large ones branch
    again by minhashes that their key chooses. What is still large at the last level, or hardly gets smaller, is compared by pairs of blocks. Candidates are verified on the full sets of whole texts.

    A text that is null or has no words has an empty set: n_shingles 0, linked with nothing, kept. Rows without an id are left
    out; of rows that repeat an id, the largest text in order counts; empty tables give no rows.
    """
    d = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = settled(signatures(d, s).groupBy("doc_id").agg(F.max(F.struct("n_shingles", "f1", "f2", "trees", "path", "sketch")).alias("x")).select("doc_id", "x.*"))
    full = signed.where("n_shingles > 0")
    same = full.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = same.where("copies > 1").select(F.col("n_shingles").alias("m"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), "rep")
    copied = full.select("doc_id", "n_shingles", "f1", "f2").join(copies, (F.col("n_shingles") == F.col("m")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))).where("doc_id != rep")
    copied = settled(copied.select("doc_id", "rep"))
    reps = settled(full.join(copied.select(F.col("doc_id").alias("c")), F.col("doc_id") == F.col("c"), "left_anti").select("doc_id", "n_shingles", "trees", "path", "sketch"))

    tree = F.posexplode("trees").alias("tree", "value")
    shared = paths.shared(reps.select(F.col("doc_id").alias("id"), tree).select(F.xxhash64("tree", "value").alias("key"), "id"))
    size = reps.select(F.col("doc_id").alias("i"), F.col("n_shingles").alias("n"))
    no_path = F.lit(None).cast("array<int>").alias("path")
    level = settled(paths.nodes(shared.join(size, F.col("id") == F.col("i")).select("key", "id", "n", F.col("id").alias("comp"), no_path)))
    likely = settled(_likely(paths.pairs(level, s.minority, _alike(s)), reps, s))
    links = settled(_verified(likely, _texts(d, _ends(likely)), s))
    found = settled(components(links))

    path = reps.select(F.col("doc_id").alias("p"), "path")
    comp = found.select(F.col("id").alias("i"), "component")
    level = level.where(F.col("minority") > s.minority).select("key", "id", "n").join(path, F.col("id") == F.col("p")).join(comp, F.col("id") == F.col("i"), "left")
    level = settled(paths.nodes(level.select("key", "id", "n", F.coalesce("component", "id").alias("comp"), "path", F.lit(0).cast("long").alias("used"))))
    pairs, small, slow = [], [], []
    for depth in range(s.depth + 1):
        # Nodes with a small minority give pairs, small nodes are compared exhaustively, and the others branch; at the last level none is left.
        pairs.append(paths.pairs(level, s.minority, _alike(s)))
        rest = level.where(F.col("minority") > s.minority)
        sizes = rest.groupBy("key", "used").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
        large = (F.col("rows") > s.node_rows) | (F.col("shingles") > s.node_shingles)
        sizes = sizes.select(F.col("key").alias("k"), "rows", large.alias("large"), paths.picks(s.coordinates, s.branches).alias("picks"))
        rest = settled(rest.join(sizes, F.col("key") == F.col("k")).drop("k"))
        small.append(rest.where("NOT large").select("key", "id"))
        rest = rest.where("large")
        if rest.isEmpty():
            break
        if depth == s.depth:
            slow.append(rest.select("key", "id", "n", "comp"))
        else:
            below = settled(paths.children(rest.withColumn("up", F.col("key")), "up", "rows"))
            most = below.groupBy("key", "up", "rows").agg(F.count("*").alias("c")).where(F.col("c") >= F.col("rows") * s.shrink)
            stuck = settled(most.select(F.col("up").alias("k")).distinct())
            slow.append(rest.join(stuck, F.col("key") == F.col("k"), "left_semi").select("key", "id", "n", "comp"))
            level = settled(paths.nodes(below.join(stuck, F.col("up") == F.col("k"), "left_anti").drop("up", "rows")))
    if slow:
        small.append(paths.block_pairs(settled(paths.joined(settled(reduce(DataFrame.unionByName, slow)))), s.node_rows, s.node_shingles))
    likely = settled(_likely(reduce(DataFrame.unionByName, pairs).distinct(), reps, s))
    small = settled(reduce(DataFrame.unionByName, small).distinct())
    texts = _texts(d, _ends(likely).unionByName(small.select("id")).distinct())
    links2 = settled(_verified(likely, texts, s).unionByName(_exhaustive(small, texts, s)))
    if not links2.isEmpty():
        found = settled(components(links.unionByName(links2)))

    # Copies follow their class; all others are their own component.
    root = found.select(F.col("id").alias("i"), "component")
    moved = copied.join(root, F.col("rep") == F.col("i"), "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    moved = moved.unionByName(found.where("id != component").select(F.col("id").alias("doc_id"), "component"))
    moved = moved.select(F.col("doc_id").alias("i"), "component")
    out = signed.select("doc_id", "n_shingles").join(moved, F.col("doc_id") == F.col("i"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents that stay: the one with the smallest id of each group, with all its columns."""
    kept = settled_alone(lambda: near_duplicates(docs, s).where("kept").select(F.col("doc_id").alias("kept_doc_id")))
    at = docs.columns.index("doc_id")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.join(kept, F.col(f"c{at}") == F.col("kept_doc_id"), "left_semi").toDF(*docs.columns)
