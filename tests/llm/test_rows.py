"""Scores, counts, searches, mixtures and scans against brute force, and the pipeline."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pagelattice.llm import backoff, language, licenses, mixing, repeats, suffixes, token_counts, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "a", "A\x0bb c", "\x00 zero", "x" * 3000, "one two " * 2000, "same text here", "same text here"]


def frame(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("Block", "part", "H", "runs", "d")})


# 1: language-model scores


def expected_scores(texts, s):
    docs = [(i, [w for w in (t or "").encode().lower().split()]) for i, t in texts if i is not None]
    grams = lambda w: [[tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w))] for n in range(1, s.order + 1)]
    total = [Counter() for _ in range(s.order)]
    for _, w in docs:
        for n, g in enumerate(grams(w)):
            total[n].update(g)
    words = sum(len(w) for _, w in docs)
    out = []
    for i, w in docs:
        own = [Counter(g) for g in grams(w)]
        left = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
        score, used = 0, Counter()
        for p in range(len(w)):
            longest = min(p + 1, s.order)
            for n in range(longest, 0, -1):
                g = tuple(w[p - n + 1 : p + 1])
                if left(g) > 0 or n == 1:
                    below = left(g[:-1]) if n > 1 else words - len(w)
                    score += round(1e6 * (np.log(max(left(g), 1)) - np.log(max(below, 1)) + (longest - n) * np.log(s.alpha)))
                    used[n] += 1
                    break
        out.append((i, len(w), int(score), *[used[n + 1] for n in range(s.order)]))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_scores_equal_brute_force(spark, order):
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(f"v{x}" for x in rng.zipf(1.4, int(rng.integers(0, 200))) % 50)) for i in range(60)]
    texts += list(enumerate(ODD, 100)) + [(None, "left out"), (5, "twice")]
    s = backoff.Settings(order=order, block_bytes=2000, table_bytes=3000)
    got = sorted(tuple(r) for r in backoff.score(frame(spark, texts), s).collect())
    assert got == expected_scores(texts, s)
    assert backoff.score(frame(spark, texts).limit(0), s).count() == 0


def test_numbers_survive_packing():
    x = np.array([0, 1, 2**63, 2**64 - 1, 7], np.uint64)
    assert (backoff.unpacked(backoff.packed(x)) == x).all()


# 2: mixing


def test_mixture_stays_within_a_block(spark):
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, None: 1.0}
    rows = [(i, "t", "en", src, 0) for i, src in enumerate(["a"] * 900 + ["b"] * 700 + ["c"] * 150 + [None] * 150 + ["d"] * 3)]
    docs = spark.createDataFrame([*rows, (None, None, None, "a", 0), (0, "t", "en", "a", 0)], SCHEMA)
    w = spark.createDataFrame(list(weights.items()) + [("b", 0.0)], "source string, weight double")
    got = mixing.mixed(docs, w, block_rows=5, parts=100, bucket_rows=50).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in docs.collect())
    blocks = Counter((r.source, r.block, r.slot) for r in got)
    assert all(n <= 5 for n in blocks.values()) and len({s for *_, s in blocks}) == len(blocks)
    parts = {r.source: r.m for r in mixing.whole_parts(w.union(spark.createDataFrame([("d", 0.0)], w.schema)), 100).collect()}
    total = sum(parts.values())
    end = max(r.slot for r in got if r.in_mix) + 1
    at = {r.slot: r.source for r in got if r.in_mix}
    done = Counter()
    for t in range(end):
        done[at[t]] += 1
        assert all(abs(done[s] - (t + 1) * m / total) < 1 for s, m in parts.items())
    assert not mixing.mixed(docs.limit(0), w).collect()


# 4: languages


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + i, t, "en", "s", 0) for i, t in enumerate([None, "", " 12 %$ ", "é", "x" * 100_000])], SCHEMA)
    both = docs.unionByName(odd).unionByName(spark.createDataFrame([(None, "the of and", "en", "s", 0), (10**6 + 9, "the of", None, None, 0)], SCHEMA))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in language.identify(both.withColumn("Score", F.lit("x"))).collect()}
    held = [r for i, r in got.items() if i in lang and r.held_out]
    assert len(got) == both.count() and held
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97
    assert all((got[10**6 + i].lang_pred, got[10**6 + i].score) == ("und", 0.0) for i in range(3))
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "fr", "de", "es", "und"} for r in got.values())
    nothing = language.identify(both.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(both.limit(0)).count() == 0


def test_recognised_rows_keep_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6 + i, t, "en", "s", 0) for i, t in enumerate([None, "", " 12 %$ "])] + [(None, "the of and the house of the", "en", "s", 0)]
    twice = docs.limit(1).withColumn("text", F.lit(None).cast("string"))
    both = docs.unionByName(spark.createDataFrame(odd, SCHEMA)).unionByName(twice).withColumn("extra", F.lit(7))
    both = both.select("*", F.lit("other").alias("TEXT"))  # a clashing name
    model = language.train(docs.where(~language.in_fold()))
    wanted = language.predict(both, model).where("doc_id IS NOT NULL AND lang_pred <> 'und' AND score >= 0.3").count()
    got = language.recognised(both, 0.3)
    rows = got.collect()
    assert got.columns == both.columns and len(rows) == wanted and wanted >= 0.9 * docs.count()
    assert all(r[0] is not None and r[1] is not None and r[0] < 10**6 and r[5:] == (7, "other") for r in rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_character_features():
    hashed, begins = language.features(["ab", "", "éxy"], 15, (1, 2, 3))
    assert np.diff(np.r_[begins, len(hashed)]).tolist() == [9, 3, 12]
    alone = [language.features([t], 15, (1, 2, 3))[0].tolist() for t in ("ab", "", "éxy")]
    assert [x.tolist() for x in np.split(hashed, begins[1:])] == alone


# 5: licenses


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/b/x.c", "int x;"), ("a/LICENSE", mit), ("a/b/c/y.c", f"# {apache}\ncode"), ("a/b/c/z.c", None), ("a/b/d/COPYING.txt", apache),
        ("a/b/d/e/f.c", ""), ("top.c", "released under nothing at all"), ("q/r.c", "the " * 5000), (None, mit), ("a/b/x.c", "int x;"),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumns({"dir": F.lit(1), "License": F.lit(2)})
    templates = spark.createDataFrame([*licenses.NOTICES, (None, "x"), ("Z", None)], "license string, text string")
    got = {r.path: (r.license, r.how, r.directory) for r in licenses.scan(df, templates).collect()}
    assert got == {
        "a/b/x.c": ("MIT", "inherited", "a"), "a/LICENSE": ("MIT", "own", None), "a/b/c/y.c": ("Apache-2.0", "own", None), "a/b/c/z.c": ("MIT", "inherited", "a"),
        "a/b/d/COPYING.txt": ("Apache-2.0", "own", None), "a/b/d/e/f.c": ("Apache-2.0", "inherited", "a/b/d"), "top.c": (None, "none", None), "q/r.c": (None, "none", None),
    }
    assert {r.path: r.how for r in licenses.scan(df, templates, any_notice=True).collect()}["a/b/c/z.c"] == "inherited"
    assert licenses.scan(df.limit(0), templates).count() == 0
    assert {r.how for r in licenses.scan(df, templates.limit(0)).collect()} == {"none"}
    page = spark.createDataFrame([("http://b.x.org/en/7?q=1#t", "<p>Hi<br>there</p>"), ("https://x.org", None)], "url string, html string")
    assert [r.path for r in licenses.page_files(page).collect()] == ["org/x/b/en/7", "org/x"]


# 6: tokens


def test_token_counts_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*ODD, "end<|endoftext|> of<|endoftext|><|endoftext|>", "it's we'll I'D  \n\n  x  y", "中文 \U0001f600 ՘Ᲊ", "<|endoftext|", "\r\n\t mixed  9.5½"]
    got = sorted(tuple(r) for r in token_counts.count_tokens(frame(spark, enumerate(texts)), P.path("byte_bpe_50k.json"), part_chars=50).collect())
    assert got == [(i, len((t or "").encode()), len(known.encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts)]
    assert token_counts.count_tokens(frame(spark, []).limit(0), P.path("byte_bpe_50k.json")).count() == 0
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [t for t in texts if t != "\x00 zero"]
    got = sorted(tuple(r) for r in token_counts.count_tokens(frame(spark, enumerate(plain)), P.path("piece_bpe_32k.model")).collect())
    assert [x[2] for x in got] == [len(model.encode(t or "")) for t in plain]


def test_pre_tokens_of_all_settled_characters():
    P = pytest.importorskip("public_tokenizers")
    import regex
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counter = token_counts.PreTokenCounter([], lambda x: [1] * len(x), known.pre_tokenizer.pre_tokenize_str)
    alike = regex.compile(f"[{token_counts.ALIKE}]").match
    texts = [f"a{c}1{c} b {c}{c}  {c}'s x" for c in map(chr, range(0x1F650)) if alike(c)]
    cut = lambda t: [t[a:b] for _, (a, b) in known.pre_tokenizer.pre_tokenize_str(t)]
    assert len(texts) > 30_000 and [t for t in texts if counter.pre_tokens(t) != cut(t)] == []


# 8: repeated strings


def expected_kept(texts, length):
    data = {i: (t or "").encode() for i, t in texts}
    seen = Counter(b[j : j + length] for b in data.values() for j in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out[i] = (i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [100_000, 700])
def test_repeats_equal_brute_force(spark, shard):
    rng = np.random.default_rng(4)
    make = lambda n, k=26: "".join(chr(97 + x) for x in rng.integers(0, k, n))
    shared = [make(int(rng.integers(30, 200))) for _ in range(6)]
    texts = []
    for i in range(60):
        body = [make(int(rng.integers(0, 80)))]
        for _ in range(int(rng.integers(0, 4))):
            body += [shared[int(rng.integers(0, 6))][int(rng.integers(0, 20)) :], make(int(rng.integers(0, 50)))]
        texts.append("".join(body))
    texts += [texts[0], texts[0], "ab" * 300, "ab" * 20, "x" * 500, "éè" * 60, make(40), make(39), *ODD]
    texts += [make(10) + shared[0] + make(10) for _ in range(40)]  # one very frequent passage
    rows = list(enumerate(texts))
    got = {r.doc_id: tuple(r) for r in repeats.digest(frame(spark, [*rows, (None, texts[1]), (3, "")]), repeats.Settings(40, 12, shard)).collect()}
    assert got == expected_kept(rows, 40)
    assert repeats.digest(frame(spark, []).limit(0)).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for trial in range(60):
        t = rng.integers(0, trial % 4 + 1, int(rng.integers(1, 200))).astype(np.uint8)
        b, length = t.tobytes(), int(rng.integers(8, 40))
        order = suffixes.suffix_array(t, length)
        assert sorted(order) == list(range(len(t))) and [b[i : i + length] for i in order] == sorted(b[i : i + length] for i in order)
        starts = np.arange(max(0, len(t) - length + 1))
        seen = Counter(b[i : i + length] for i in starts)
        assert all(suffixes.repeated_starts(t, starts, length)[0][i] == (seen[b[i : i + length]] > 1) for i in starts)


# 9: top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 8) / 7.0]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    odd = [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (304, []), (305, [1.0]), (0, rows[0][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("Block", F.lit(1))
    v = topk.quantized(df)
    got = sorted(tuple(r) for r in topk.exact_top_k(v, v.where("vec_id % 50 = 0"), k=5, block_rows=16).collect())
    whole = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) if len(x) else np.zeros(0, int) for i, x in [*rows, (304, []), (305, [1.0])]}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        dot = lambda c: int((whole[q][: len(whole[c])] * whole[c][: len(whole[q])]).sum())
        best = sorted((-dot(c), c) for c in whole if c != q)[:5]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert got == sorted(want)
    few = v.where("vec_id < 3")
    assert topk.exact_top_k(few, few).count() == 6
    assert topk.exact_top_k(v.limit(0), v.limit(0)).count() == 0


# the pipeline and the registered queries


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("Extra", F.lit(1))
    odd = docs.limit(1).select((F.col("doc_id") + 10**6).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars", "Extra")
    kept = docs.unionByName(odd)
    sizes = [kept.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept.select("doc_id").collect()}, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == kept.columns, name
            kept = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(len(ids))
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3] * 0.5 and sizes[-1] == sizes[-2]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_queries_are_registered_once_each():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
