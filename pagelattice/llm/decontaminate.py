"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.tables import maybe_among, pick, settled, settled_alone


@dataclass(frozen=True)
class Settings:
    """``radius``: of 64 bits. A window at the threshold differs from its item in about 11 bits, standard deviation 3. ``broadcast_rows``
    bounds the benchmark shingles that are broadcast; a larger benchmark is joined by a shuffle instead, with the same result.
    """

    words: int = 5
    percent: int = 75
    radius: int = 24
    broadcast_rows: int = 1_000_000


BLANKS = " \t\n\x0b\x0c\r"


def _words(df: DataFrame, *keep: str) -> DataFrame:
    """The lower-cased words of a text between blanks."""
    text = F.btrim(F.lower("text"), F.lit(BLANKS))
    return df.where("text IS NOT NULL").select(*keep, F.split(text, f"[{BLANKS}]+").alias("words")).where("words[0] != ''")


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(n)])


def _shingles(df: DataFrame, n: int, *keep: str) -> DataFrame:
    """(keep..., at, h): the hash of each n-word shingle of ``words`` and where it starts."""
    at = F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at")
    return df.where(F.size("words") >= n).select(*keep, "words", at).select(*keep, "at", _hash(F.col("words"), F.col("at"), n).alias("h"))


def _simhash(shingles: DataFrame, *key: str) -> DataFrame:
    """(key..., print): 64-bit SimHash of the weighted shingles of each key, by 64 partial sums.

    A shingle counts with the root of its weight, so the cosine that the bits follow is that of the weights which
    the verification adds up. The roots are whole numbers, so sums do not depend on the order.
    """
    root = F.round(F.sqrt("weight") * F.lit(1 << 20)).cast("long")
    bits = [F.sum(F.when(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) == 1, F.col("root")).otherwise(0)).alias(f"b{b}") for b in range(64)]
    sums = shingles.select(*key, "h", root.alias("root")).groupBy(*key).agg(F.sum("root").alias("n"), *bits)
    parts = [F.when(F.col(f"b{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return sums.select(*key, reduce(lambda x, y: x.bitwiseOR(y), parts).alias("print"))


def _blocks(prints: DataFrame, s: Settings, *key: str) -> DataFrame:
    """A row for each of radius + 1 blocks of a fingerprint: two within the radius agree in at least one of them."""
    n = s.radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    block = lambda i: F.shiftrightunsigned("print", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    return prints.select(*key, "print", F.posexplode(F.array(*[block(i) for i in range(n)])).alias("block", "value"))


def windows(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, start, similarity): the item-sized windows of documents that are similar to a benchmark item.

    A window has as many words as its item and starts where the item would if a shared shingle stands in both; windows that share none
    have similarity 0 and are never made. Windows and items get a 64-bit SimHash of their weighted shingles; pairs that agree in one of ``radius`` + 1 blocks
    and differ in at most ``radius`` bits are verified: the weight of common shingles is ``percent`` of the weight of all or more, where
    a shingle that k items have weighs 1 / k and any other 1. Words are cut at blanks and lower-cased; an item with fewer words than a
    shingle is one shingle. Null texts and ids, and texts without words, take no part. Of items that repeat an id, the largest text
    counts; documents that repeat an id are taken together. Start may be negative or run over the end where a document
    is cut off.
    """
    items = pick(benchmark, "item_id", "text").where("item_id IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text"))
    items = settled(_words(items, "item_id"))
    sizes = [r.n for r in items.select(F.least(F.size("words"), F.lit(s.words)).alias("n")).distinct().collect()]  # at most s.words numbers
    of_items = [_shingles(items.where((F.size("words") == n) if n < s.words else (F.size("words") >= n)).withColumn("size", F.size("words")), n, "item_id", "size").withColumn("k", F.lit(n)) for n in sorted(sizes)]
    nothing = "doc_id bigint, item_id bigint, start int, similarity double"
    if not of_items:
        return docs.sparkSession.createDataFrame([], nothing)
    item_shingles = settled(reduce(DataFrame.unionByName, of_items))
    weights = item_shingles.groupBy("h").agg((F.lit(1.0) / F.countDistinct("item_id")).alias("weight"))
    few = item_shingles.count() <= s.broadcast_rows

    d = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = []
    for n in sorted(sizes):
        known = item_shingles.where(F.col("k") == n).select(F.col("h").alias("g"), "item_id", "size", F.col("at").alias("offset"))
        own = _shingles(_words(d, "doc_id"), n, "doc_id").join(F.broadcast(known) if few else known, F.col("h") == F.col("g"))
        hits.append(own.select("doc_id", "item_id", "size", F.lit(n).alias("k"), (F.col("at") - F.col("offset")).alias("start")))
    found = settled(reduce(DataFrame.unionByName, hits).distinct())

    texts = maybe_among(d, F.col("doc_id"), found.select("doc_id"))
    at = found.select(F.col("doc_id").alias("d"), "item_id", "size", "k", "start")
    cut = _words(texts, "doc_id").join(at, F.col("doc_id") == F.col("d"))
    first = F.greatest(F.col("start"), F.lit(0))
    cut = settled(cut.select("doc_id", "item_id", "start", "k", F.slice("words", first + 1, F.col("start") + F.col("size") - first).alias("words")))
    key = ["doc_id", "item_id", "start"]
    w = settled(weights.select(F.col("h").alias("g"), "weight"))
    shingles = reduce(DataFrame.unionByName, [_shingles(cut.where(F.col("k") == n), n, *key) for n in sorted(sizes)]).select(*key, "h").distinct()
    shingles = settled(shingles.join(w, F.col("h") == F.col("g"), "left").select(*key, "h", F.coalesce("weight", F.lit(1.0)).alias("weight")))

    item_set = item_shingles.select("item_id", "h").distinct().join(w, F.col("h") == F.col("g")).select("item_id", "h", "weight")
    item_blocks = _blocks(_simhash(item_set, "item_id"), s, "item_id").select(F.col("item_id").alias("i"), F.col("print").alias("print2"), F.col("block").alias("block2"), F.col("value").alias("value2"))
    mine = _blocks(_simhash(shingles, *key), s, *key)
    near = mine.join(item_blocks, (F.col("item_id") == F.col("i")) & (F.col("block") == F.col("block2")) & (F.col("value") == F.col("value2")))
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("print2"))) <= s.radius).select(*key).distinct()

    keyed = near.select(*[F.col(c).alias(f"{c}_") for c in key])
    checked = shingles.join(keyed, (F.col("doc_id") == F.col("doc_id_")) & (F.col("item_id") == F.col("item_id_")) & (F.col("start") == F.col("start_"))).select(*key, "h", "weight")
    weighed = item_set.select(F.col("item_id").alias("i"), F.col("h").alias("h2"), F.col("weight").alias("common"))
    totals = weighed.groupBy("i").agg(F.sum("common").alias("item_weight"))
    checked = checked.join(weighed, (F.col("item_id") == F.col("i")) & (F.col("h") == F.col("h2")), "left")
    sums = checked.groupBy(*key).agg(F.sum(F.coalesce("common", F.lit(0.0))).alias("common"), F.sum("weight").alias("own"))
    sums = sums.join(totals, F.col("item_id") == F.col("i"))
    similarity = F.round(F.col("common") / (F.col("own") + F.col("item_weight") - F.col("common")), 9)
    return sums.select(*key, similarity.alias("similarity")).where(F.col("similarity") * 100 >= s.percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): each document's best window for each benchmark item it holds."""
    best = windows(docs, benchmark, s).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).alias("start_word"), "b.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents without a contaminated window, with all their columns; those without an id stay."""
    bad = settled_alone(lambda: contaminated(docs, benchmark, s).select(F.col("doc_id").alias("bad_doc_id")).distinct())
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.join(bad, F.col(f"c{docs.columns.index('doc_id')}") == F.col("bad_doc_id"), "left_anti").toDF(*docs.columns)
