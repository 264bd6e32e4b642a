"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.shingles import parts
from pagelattice.llm.tables import pick

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled documents that the weights are fitted on, over all languages together."""

    bits: int = 15
    orders: tuple[int, ...] = (1, 2, 3)
    sample_rows: int = 2400
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    calibration_share: float = 0.2


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray  # feature
    weights: np.ndarray  # feature x language
    bias: np.ndarray
    temperature: float
    bits: int
    orders: tuple[int, ...]


# Texts are judged in parts of about this many characters, whose n-grams take some eighty bytes for each, and decoded this many rows at a time.
PART_CHARS = 250_000
PART_ROWS = 1_000


def features(texts: list[str], bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each lower-cased text, and where each text's begin.

    A text is wrapped in two spaces, so even an empty one has n-grams and none crosses texts.
    """
    wrapped = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in wrapped], np.int64)
    chars = np.frombuffer("".join(wrapped).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.r_[0, np.cumsum(sizes)][:-1]
    mixed = chars * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - bits)
    longest, own = max(orders), np.full(len(chars), 1, np.uint32)
    out = []
    left = np.repeat(first + sizes, sizes) - np.arange(len(chars))  # characters up to the text's end
    for n in range(1, longest + 1):
        if n > 1:
            own = own[:-1] if len(own) else own
        own = (own * np.uint32(0x85EBCA6B)) ^ mixed[n - 1 :]
        if n in orders:
            h = own * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
            h = (h * np.uint32(0x27D4EB2F)) >> shift
            keep = left[: len(h)] >= n
            out.append((h[keep], np.cumsum(np.r_[0, keep])[:-1][first] if n == 1 else np.r_[0, np.cumsum(keep)][np.minimum(first, len(keep))]))
    return _joined(out)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all orders, text by text."""
    sizes = [np.diff(np.r_[start, len(h)]) for h, start in parts]
    total = np.sum(sizes, axis=0)
    begins = np.r_[0, np.cumsum(total)][:-1]
    out, at = np.empty(int(total.sum()), np.int32), begins.copy()
    for (h, start), size in zip(parts, sizes):
        out[np.arange(len(h)) + np.repeat(at - start, size)] = h
        at = at + size
    return out, begins


def document_frequencies(texts: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """In how many documents each hashed n-gram occurs, over all rows: one partial row of counts per task."""
    size = 1 << settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            values = batch.column(0).to_pylist()
            for part in parts(values, PART_CHARS):
                own = values[part]
                hashed, begins = features(own, settings.bits, settings.orders)
                for h in np.split(hashed, begins[1:]):
                    seen = np.zeros(size, bool)
                    seen[h] = True
                    counts += seen
                rows += len(own)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[counts[at], rows])], ["feature", "n"])

    found = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most 2**bits + 1 rows
    counts = np.zeros(size, np.int64)
    rows = 0
    for r in found:
        if r.feature < 0:
            rows = r.n
        else:
            counts[r.feature] = r.n
    return counts, rows


def sample(rows: DataFrame, settings: Settings) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, features, counts) of a bounded sample with equal shares of the languages.

    The rows with the smallest hashes of their id are taken: a share of the hash range that holds slightly more than the
    wanted rows of each language is filtered first, so only about ``sample_rows`` rows are sorted.
    """
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return []
    each = max(1, settings.sample_rows // len(sizes))
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * each / n + 20 / n)))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.withColumn("draw", draw).where(F.col("draw") < share)
    bits, orders = settings.bits, settings.orders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            ids, counts = [], []
            for part in parts(values, PART_CHARS):
                hashed, begins = features(values[part], bits, orders)
                for h in np.split(hashed, begins[1:]):
                    at, n = np.unique(h, return_counts=True)
                    ids.append(at.astype(np.int32).tobytes())
                    counts.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), batch.column(2), batch.column(3)], ["lang", "ids", "n", "draw", "doc_id"])

    found = near.select("lang", "text", "draw", "doc_id").mapInArrow(run, "lang string, ids binary, n binary, draw double, doc_id long")
    found = found.orderBy("draw", "doc_id").limit(2 * settings.sample_rows + 40 * len(sizes)).collect()
    taken: dict[str, int] = {}
    out = []
    for r in found:
        if taken.get(r.lang, 0) < each:
            taken[r.lang] = taken.get(r.lang, 0) + 1
            out.append((r.lang, np.frombuffer(r.ids, np.int32), np.frombuffer(r.n, np.int32)))
    return out


def _tf_idf(ids: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Shares of the text's n-gram mass: TF-IDF scaled to sum to 1."""
    v = n * idf[ids]
    return v / max(v.sum(), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, settings: Settings) -> Model:
    """FTRL-proximal with elastic net on the first rows, then a temperature on the rest."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], idf, np.zeros((len(idf), 0)), np.zeros(0), 1.0, settings.bits, settings.orders)
    size, k = 1 << settings.bits, len(languages)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - settings.l1, 0)
        return -shrunk / ((settings.beta + np.sqrt(ns)) / settings.alpha + settings.l2)

    held = max(1, int(len(rows) * settings.calibration_share)) if len(rows) > 4 else 0
    train, rest = rows[held:], rows[:held] or rows
    rng = np.random.default_rng(7)
    scale = 30.0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(train)):
            lang, ids, counts = train[i]
            at = np.r_[ids, size]
            x = np.r_[scale * _tf_idf(ids, counts, idf), 1.0]
            w = weights(at)
            p = _softmax(x @ w)
            p[languages.index(lang)] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    logits = np.array([scale * _tf_idf(ids, c, idf) @ w[ids] + w[size] for _, ids, c in rest]).reshape(-1, k)
    truth = np.array([languages.index(r[0]) for r in rest], int)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
    losses = [-np.mean(np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12)) for t in grid]
    return Model(languages, idf, scale * w[:size], w[size], float(grid[int(np.argmin(losses))]), settings.bits, settings.orders)


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from (doc_id, text, lang). Inverse document frequencies count every row; weights come from the bounded sample."""
    rows = pick(labelled, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counts, total = document_frequencies(rows.select("text"), settings)
    idf = np.log((1.0 + total) / (1.0 + counts)) + 1.0
    return fit(sample(rows, settings), idf, settings)


def _table(model: Model) -> np.ndarray:
    return np.c_[model.weights * model.idf[:, None], model.idf].astype(np.float32) if model.languages else np.zeros((1 << model.bits, 1), np.float32)


def _judge(texts: list, model: Model, table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores of the texts of a batch; null ones are ``und``."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t is not None] if model.languages else []
    for part in parts([texts[i] for i in known], PART_CHARS):
        own = known[part]
        hashed, begins = features([texts[i] for i in own], model.bits, model.orders)
        sums = np.stack([np.add.reduceat(c[hashed], begins, dtype=np.float64) for c in np.ascontiguousarray(table.T)], 1)
        p = _softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1e-12) + model.bias) / model.temperature)
        for i, row in zip(own, p):
            best = int(np.argmax(row))
            names[i], scores[i] = model.languages[best], row[best]
    return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) from whole texts: ``und`` with score 0 if a text is null or has no letter, or nothing was learned."""
    judged = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    table = _table(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _judge(batch.column(1).to_pylist(), model, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return judged.mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, least_score: float, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text's language is told with ``least_score`` or more.

    Each row is judged by its own text and goes on or not in the scan that judges it, so nothing is shuffled. Rows with a null or
    letterless text or without an id go, and all rows where nothing was learned; rows that repeat an id are judged one by one. An
    empty table gives no rows.
    """
    model = train(pick(docs, "doc_id", "text", "lang").where(~in_fold()), settings)
    table, at, id_at = _table(model), docs.columns.index("text"), docs.columns.index("doc_id")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).where(F.col(f"c{id_at}").isNotNull() & F.col(f"c{at}").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PART_ROWS):
                own = batch.slice(start, PART_ROWS)
                names, scores = _judge(own.column(at).to_pylist(), model, table)
                yield own.filter(pa.array([n != UNDETERMINED and s >= least_score for n, s in zip(names, scores.tolist())], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def in_fold(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is held out: crc32 of its id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document; learned from the labelled ones that are not held out.

    Rows without id, text or lang teach nothing, and all but the text is unknown to the prediction. Null and letterless
    texts are ``und``. Repeated rows each count and each come back; an empty table gives no rows. Only scans: counts come
    back as one bounded row per n-gram bucket and the sample as at most ``sample_rows`` feature rows (both for the fit on the driver).
    """
    named = pick(docs, "doc_id", "text", "lang")
    model = train(named.where(~in_fold()), settings)
    return predict(docs, model).select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")
