"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.shingles import U, mix, word_hashes
from pagelattice.llm.tables import pick, rows_per

MICRO = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``block_bytes``: text whose n-grams are collected together. ``table_bytes``: text whose n-grams one part of the count table answers for."""

    order: int = 3
    alpha: float = 0.4
    block_bytes: int = 8_000_000
    table_bytes: int = 8_000_000


_TOTAL = U(0)  # stands for the number of all words


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n, the hash of the n words that end at each position (0 where a text has fewer before it), and each position's text."""
    own = [word_hashes(t.decode()) for t in texts]
    sizes = np.array([len(x) for x in own], np.int64)
    words = np.concatenate(own) if own else np.zeros(0, U)
    doc = np.repeat(np.arange(len(own)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, h = [], words
    for n in range(1, order + 1):
        if n > 1:  # the n-gram that ends here: the (n-1)-gram that ends one before, and this word
            h = mix(np.r_[h[:1], h[:-1]] * U(0x9E3779B97F4A7C15) + words)
        out.append(np.where(place >= n - 1, mix(h + U(n)) | U(1), U(0)))
    return out, doc


def _requests(all_grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a block with their counts, and the number of its words."""
    h = np.concatenate([g[g != 0] for g in all_grams])
    found, counts = np.unique(h, return_counts=True)
    return np.r_[_TOTAL, found], np.r_[len(all_grams[0]), counts]


def places(all_grams: list[np.ndarray]) -> list[np.ndarray]:
    """Where each position's n-gram is among those that `_requests` gives (0 for none), by sorting them once instead of a search for each."""
    given = [g != 0 for g in all_grams]
    _, at = np.unique(np.concatenate([g[x] for g, x in zip(all_grams, given)]), return_inverse=True)
    out = [np.zeros(len(g), np.int64) for g in all_grams]
    for place, x, own in zip(out, given, np.split(at + 1, np.cumsum([x.sum() for x in given])[:-1])):
        place[x] = own
    return out


def _own_counts(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each position's n-gram occurs in its own document."""
    _, at, n = np.unique(doc.astype(np.int64) << 40 | place, return_inverse=True, return_counts=True)
    return n[at]


def block_scores(texts: list[bytes], totals: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, score in millionths of a nat, positions by the order that answered) of each text. ``totals``: of the n-grams that `_requests` gives."""
    all_grams, doc = grams(texts, s.order)
    n_words = np.bincount(doc, minlength=len(texts))
    words = totals[0] - n_words[doc]
    numerators, denominators = [], []
    for at in places(all_grams):
        c = np.where(at != 0, totals[at] - _own_counts(doc, at), 0)
        numerators.append(c)
        # The history of the next order is this order's n-gram one position before.
        denominators.append(np.r_[0, c[:-1]] if len(c) else c)
    score = np.zeros(len(doc), np.int64)
    used = np.zeros(len(doc), np.int64)
    left = np.ones(len(doc), bool)
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    longest = np.minimum(place + 1, s.order)
    for n in range(s.order, 0, -1):
        c = numerators[n - 1]
        take = left & (longest >= n) & ((c > 0) | (n == 1))
        d = words if n == 1 else denominators[n - 2]
        value = np.log(np.maximum(c[take], 1)) - np.log(np.maximum(d[take], 1)) + (longest[take] - n) * np.log(s.alpha)
        score[take] = np.rint(MICRO * value).astype(np.int64)
        used[take] = n
        left &= ~take
    # Positions lie text by text, so a text's sum is a difference of running sums.
    running, ends = np.r_[0, np.cumsum(score)], np.cumsum(n_words)
    sums = running[ends] - running[ends - n_words]
    return n_words, sums, np.stack([np.bincount(doc[used == n], minlength=len(texts)) for n in range(1, s.order + 1)], 1)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts of the table are ranges of the hash, so sorted n-grams fall into consecutive slices."""
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, log_score, n_order_1 ... n_order_N) per document, scored by the n-gram counts of all other documents.

    The score of a word after the words before it in its document is count(n-gram) / count(history) of the longest n-gram, up to ``order`` words, that the
    rest of the corpus has, times ``alpha`` for each order given up; the last resort is the word's own count, at least 1, over the
    number of words of the rest. log_score sums the logarithms, each rounded to millionths of a nat. Words are cut
    at ASCII blanks with A-Z lower-cased.

    Count tables are partitioned by n-gram hash. Documents are dealt into blocks; a block sends each part of the table its distinct n-grams
    with their counts, so a frequent n-gram costs one entry per block, and the part joins the totals back to the blocks, which sum per document.
    Entries travel as sorted, delta-coded arrays, a row for each block and part. Texts without words, and null texts, score 0
    over 0 words; rows without an id are left out; rows that repeat an id count and come back as rows of their own.
    """
    d = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, table = rows_per(size, s.block_bytes), rows_per(size, s.table_bytes)
    order = s.order

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze(t.as_py().encode()) for t in batch.column(2)], pa.binary())], ["block", "doc_id", "text"])

    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    dealt = d.select(block, "doc_id", "text").mapInArrow(compress, "block long, doc_id long, text binary").repartition("block")

    def plain(rows: pa.Table) -> list[bytes]:
        spread = zstandard.ZstdDecompressor().decompress
        return [spread(t.as_py()) for t in rows["text"]]

    def ask(rows: pa.Table) -> pa.Table:
        h, counts = _requests(grams(plain(rows), order)[0])
        part = _part_of(h, table)
        cuts = np.searchsorted(part, np.arange(table + 1))
        out: list[tuple] = []
        b = rows["block"][0].as_py()
        for p in range(table):
            own, n = (x[cuts[p] : cuts[p + 1]] for x in (h, counts))
            if len(own):
                out.append((p, b, packed(np.diff(own, prepend=U(0))), packed(n)))
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("part", "block", "grams", "counts"), zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))})

    def answer(rows: pa.Table) -> pa.Table:
        own = [np.cumsum(unpacked(x.as_py()), dtype=U) for x in rows["grams"]]
        counts = np.concatenate([unpacked(x.as_py()) for x in rows["counts"]]).astype(np.int64)
        h = np.concatenate(own)
        _, at = np.unique(h, return_inverse=True)
        totals = np.bincount(at, weights=counts).astype(np.int64)[at]
        cuts = np.cumsum([len(x) for x in own])[:-1]
        return pa.table({"block": rows["block"], "part": rows["part"], "totals": pa.array([packed(x) for x in np.split(totals, cuts)], pa.binary())})

    def sum_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = plain(rows)
        answers = answers.sort_by("part")
        totals = np.concatenate([unpacked(x.as_py()) for x in answers["totals"]]).astype(np.int64)
        n_words, sums, used = block_scores(texts, totals, s)
        return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(n_words.astype(np.int64)), "log_score": pa.array(sums)} | {f"n_order_{n + 1}": pa.array(used[:, n].astype(np.int64)) for n in range(order)})

    asked = dealt.groupBy("block").applyInArrow(ask, "part long, block long, grams binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(answer, "block long, part long, totals binary")
    schema = "doc_id long, n_words long, log_score long, " + ", ".join(f"n_order_{n + 1} long" for n in range(order))
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(sum_up, schema)
