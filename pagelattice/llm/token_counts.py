"""Token counts without token ids: pieces counted once per distinct pre-token."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.shingles import parts
from pagelattice.llm.tables import pick

COUNTED = "doc_id long, n_bytes long, n_tokens long"

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# Fixed value: characters that the pattern engines of either library class alike. Other characters may be letters to one
# and unassigned to the other, as they know different versions of Unicode.
ALIKE = r"\x00-\u0557\u0600-\u06ff\u0900-\u097f\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u23ff\u2500-\u27ff\u3000-\u30ff\u4e00-\u9fef\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001f64f"


class PreTokenCounter:
    """Counts a text's tokens from its pre-token frequencies.

    ``cut`` is the library's own pre-tokenizer, a span for each pre-token; it serves the texts that have other characters than ``ALIKE``.
    ``pieces`` holds the number of pieces of each distinct pre-token seen so far, at most
    ``held`` of them; beyond that it starts anew, so memory stays bounded and only work is repeated.
    """

    def __init__(self, special: list[str], count_pieces: Callable[[list[str]], list[int]], cut: Callable[[str], list], held: int = 400_000):
        import regex

        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split if special else lambda text: [text]
        self.pre_tokens = regex.compile(PRE_TOKENS).findall
        self.other = regex.compile(f"[^{ALIKE}]").search
        self.count_pieces, self.cut, self.held, self.pieces = count_pieces, cut, held, {}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies and the number of special strings, one token each."""
        parts = self.split(text)
        found: Counter = Counter()
        for part in parts:
            found.update([part[a:b] for _, (a, b) in self.cut(part)] if self.other(part) else self.pre_tokens(part))
        return found, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        own = [self.frequencies(t) for t in texts]
        if len(self.pieces) > self.held:
            self.pieces.clear()
        new = list({p for found, _ in own for p in found}.difference(self.pieces))
        self.pieces.update(zip(new, self.count_pieces(new)))
        pieces = self.pieces
        return [sum(pieces[p] * n for p, n in found.items()) + special for found, special in own]


def _json_counter(spec: str) -> Callable[[list[str]], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    known = Tokenizer.from_str(spec)
    special = [t.content for t in known.get_added_tokens_decoder().values()]
    pieces = lambda texts: [len(e) for e in known.encode_batch(texts, add_special_tokens=False)]
    return PreTokenCounter(special, pieces, known.pre_tokenizer.pre_tokenize_str).count


def _model_counter(spec: bytes) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_proto=spec)

    def count(texts: list[str]) -> list[int]:
        once = list(dict.fromkeys(texts))
        pieces = dict(zip(once, map(len, known.encode(once, num_threads=1))))
        return [pieces[t] for t in texts]

    return count


def _rows(batches: Iterator[pa.RecordBatch], count: Callable[[list[str]], list[int]], part_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for part in parts(texts, part_chars):
            own = [t or "" for t in texts[part]]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(part.start, len(own)), pa.array([len(t.encode()) for t in own], pa.int64()), pa.array(count(own), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )


def count_tokens(docs: DataFrame, tokenizer_path: str, part_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text as the library for the file gives them.

    A byte-level ``.json`` goes to tokenizers: texts are cut at its added-token strings (a token each, the
    library's default) and then into pre-tokens; each part of about ``part_chars`` characters counts the pieces of
    each distinct pre-token once, looks them up for its documents' pre-token frequencies, and sums. A
    ``.model`` goes to sentencepiece, whose unit is the whole text. The work follows the scan's partitions: no shuffle,
    no key that could be hot, and a lost task is simply run again. A null text counts as empty
    (0 bytes, 0 tokens); repeated rows and null ids are kept.
    """
    with open(tokenizer_path, "rb") as f:  # on the driver; its content goes along with the tasks
        spec = f.read()
    of_json = tokenizer_path.endswith(".json")
    spec_text = spec.decode() if of_json else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(batches, _json_counter(spec_text) if of_json else _model_counter(spec), part_chars)

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)
