"""Near duplicates, lines, components and decontamination against brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import decontaminate, lines, neardup, paths
from pagelattice.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("Key", "block", "ID", "comp")}) if extra else df


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingle_words(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def expected_groups(texts):
    sets = {i: shingle_words(t) for i, t in texts}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, roots(sets, links)


def near_texts():
    rng = np.random.default_rng(3)
    base = words(rng, 120)
    texts = [" ".join(base)] * 3
    for k in range(60):  # a large group of edited copies, some beyond the threshold
        w = list(base)
        for j in rng.integers(0, 120, k % 8):
            w[j] = f"x{k}{j}"
        texts.append(" ".join(w))
    passage = " ".join(words(rng, 12))
    texts += [passage + " " + " ".join(words(rng, int(rng.integers(3, 30)))) for _ in range(50)]  # share a passage only
    texts += [None, "", " \n\t ", "one", "ONE", "one two three four", "one  two three\tFOUR", "a b c d e", "A B C D E"]
    texts += [" ".join(["again"] * 3000), " ".join(["again"] * 50), " ".join(words(rng, 20000, 9000))]
    return list(enumerate(texts))


@pytest.mark.parametrize("settings", [neardup.Settings(), neardup.Settings(minority=2, node_rows=8, depth=2), neardup.Settings(minority=1, node_rows=16, node_shingles=3000)])
def test_near_duplicates_equal_brute_force(spark, settings):
    texts = near_texts()
    sets, root = expected_groups(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, texts), settings).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


@pytest.mark.parametrize("other", [{}, {"shrink": 2.0}])
def test_near_duplicates_in_a_group_just_below_the_threshold(spark, other):
    rng = np.random.default_rng(21)
    core, texts = words(rng, 255, 10**6), []
    for k in range(400):  # alike to 0.74, so that no node gets small before the last level
        own = words(rng, 45, 10**6)
        texts.append(" ".join(core + own))
        if k < 100:  # a planted partner, alike to 0.75 or a little more
            own[-42 + k % 3 :] = words(rng, 42 - k % 3, 10**6)
            texts.append(" ".join(core + own))
    texts = list(enumerate(texts))
    _, root = expected_groups(texts)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts, False), neardup.Settings(minority=1, node_rows=64, depth=3, **other)).collect()}
    assert len(set(root.values())) < len(texts) - 50 and got == root


def test_nodes_differ_in_their_coordinates(spark):
    rows = spark.range(200).select(F.col("id").alias("key"), F.lit(0b1011).cast("long").alias("used"))
    got = [tuple(r.p) for r in rows.select(paths.picks(64, 2).alias("p")).collect()]
    assert all(len({*p, 0, 1, 3}) == 5 and max(p) < 64 for p in got) and len(set(got)) > 150


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(frame(spark, []).limit(0)).count() == 0
    rows = neardup.near_duplicates(frame(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)])).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, 1, True), (2, 0, 2, True)]
    kept = neardup.one_of_each_group(frame(spark, near_texts()))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "Key", "block", "ID", "comp"]


def test_spanning_links_connect_what_is_linked():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**60, 100, dtype=np.uint64)
    sets = []
    for _ in range(60):
        x = base.copy()
        x[rng.integers(0, 100, int(rng.integers(0, 25)))] = rng.integers(0, 2**60, 1, dtype=np.uint64)
        sets.append(np.unique(x))
    links = [(a, b) for a, b in combinations(range(60), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    ids = list(range(60))
    assert roots(ids, neardup.spanning_links(ids, sets, 75)) == roots(ids, links)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7), (None, 3)]
    root = roots({i for p in links if None not in p for i in p}, [p for p in links if None not in p])
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root[i] for p in links if None not in p and p[0] != p[1] for i in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_keys(spark):
    rows = [(k, i) for k, n in ((1, 1), (2, 2), (3, 5), (4, 300)) for i in range(n)]
    got = paths.shared(spark.createDataFrame(rows, "key long, id long")).collect()
    assert sorted(tuple(r) for r in got) == [r for r in rows if r[0] > 1]


def line_texts():
    rng = np.random.default_rng(8)
    base = [" ".join(words(rng, int(rng.integers(6, 60)))) for _ in range(30)]
    texts = []
    for k in range(40):
        own = [base[i] for i in rng.integers(0, 30, 4)]
        own.append(" ".join(words(rng, 25)))
        edited = own[int(rng.integers(0, 4))].split(" ")
        edited[int(rng.integers(0, len(edited)))] = f"edit{k}"
        texts.append("\n".join([*own, " ".join(edited), "Short", "", "  " + base[0].upper() + " "]))
    return [*enumerate(texts), (90, None), (91, ""), (92, "short\nShort"), (93, base[3]), (96, "tiny\r\nother\r\n \r"), (97, "tiny\nxyz"), (98, "-" * 300 + "\n" + "- " * 200), (99, "-" * 310 + "\n" + "- " * 205), (100, "=-" * 400), (94, base[3] + "\n" + base[4]), (95, "x" * 5000)]


def expected_lines(texts, s):
    found = []
    for i, t in sorted(texts):
        for n, line in enumerate((t or "").split("\n")):
            b = line.strip(" \t\r\x0b\x0c").lower().encode()
            if b:
                found.append(((i, n), {b[j : j + s.shingle] for j in range(max(1, len(b) - s.shingle + 1))}))
    links = [(a[0], b[0]) for a, b in combinations(found, 2) if 100 * len(a[1] & b[1]) >= s.percent * len(a[1] | b[1])]
    return roots([k for k, _ in found], links)


@pytest.mark.parametrize("minority", [8, 1])
def test_lines_equal_brute_force(spark, minority):
    s = lines.Settings(minority=minority)
    texts = line_texts()
    want = expected_lines(texts, s)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in lines.line_classes(frame(spark, texts), s).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)  # the bands' stated recall


@pytest.mark.parametrize("node_rows", [256, 32])
def test_lines_with_many_variants(spark, node_rows):
    rng = np.random.default_rng(31)
    draw = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    core, texts = draw(260), []
    for k in range(150):  # alike to 0.68, so that no band gets small
        own = draw(54)
        texts += [core + own, core + own[: 54 - 39 + k % 4] + draw(39 - k % 4)]  # a planted partner, alike to 0.77 or a little more
    texts = list(enumerate(texts))
    s = lines.Settings(node_rows=node_rows, depth=2)
    want = expected_lines(texts, s)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in lines.line_classes(frame(spark, texts, False), s).collect()}
    assert len(set(want.values())) <= 160 and sum(got[k] != want[k] for k in want) <= 0.01 * len(want)


def test_deduplicated_texts(spark):
    texts = line_texts()
    df = frame(spark, texts)
    first = {(r.doc_id, r.line_no): r.kept for r in lines.kept_lines(df).collect()}
    want = {}
    for i, t in texts:
        left = None if t is None else [x for n, x in enumerate(t.split("\n")) if first.get((i, n), True)]
        gone = t is not None and len(left) < len(t.split("\n"))
        if not gone or any(x.strip(" ") for x in left):
            want[i] = t if not gone else "\n".join(left)
    out = lines.deduplicated(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert 93 not in want and 91 in want and 90 in want and want[97] == "xyz" and 99 not in want
    assert {(98, 0), (98, 1)} <= {k for k, v in first.items() if v}
    assert lines.deduplicated(df.limit(0)).count() == 0


def test_lines_of_rows_that_repeat_an_id(spark):
    texts = [(1, "only here, at the top of it\nsomething else that is said"), (1, "a second text of the id\nonly once, below"), (2, "a second text of the id\nhere alone it stands"), (None, "a second text of the id")]
    out = sorted((r.doc_id or 0, r.text) for r in lines.deduplicated(frame(spark, texts)).collect())
    assert out == [(0, texts[3][1]), (1, texts[1][1]), (1, texts[0][1]), (2, "here alone it stands")]
    again = lines.deduplicated(frame(spark, texts[:1] * 2)).collect()
    assert [r.text for r in again] == [texts[0][1]] * 2


def item_texts():
    rng = np.random.default_rng(12)
    items = [" ".join(words(rng, int(rng.integers(8, 60)), 3000)) for _ in range(12)]
    items += ["two words", items[0], items[1] + " " + " ".join(words(rng, 3))]
    docs = []
    for k in range(40):
        body = words(rng, int(rng.integers(5, 200)), 3000)
        item = items[int(rng.integers(0, len(items)))].upper().split()
        for j in rng.integers(0, len(item), k % 5):
            item[j] = f"z{k}"
        at = int(rng.integers(0, len(body)))
        docs.append(" ".join([*body[:at], *(item if k % 3 else item[: len(item) // 2]), *body[at:]]))
    docs += [None, "", items[2], " ".join(items[2].split()[:-1]), "two", "now two words\tagain", items[3] + "\n" + items[4] + " " + items[3]]
    return list(enumerate(items)) + [(None, "a b c d e f"), (50, None), (51, "")], list(enumerate(docs)) + [(None, items[2])]


def expected_leaks(items, docs, s):
    cut = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    known = {i: t.lower().split() for i, t in items if i is not None and t and t.split()}
    size = {i: min(5, len(w)) for i, w in known.items()}
    sets = {i: set(cut(w, size[i])) for i, w in known.items()}
    holders: dict = {}
    for i, x in sets.items():
        for h in x:
            holders.setdefault(h, set()).add(i)
    weigh = lambda x: sum(1 / len(holders[h]) if h in holders else 1.0 for h in x)
    best = {}
    for d, text in docs:
        w = (text or "").lower().split()
        if d is None:
            continue
        for i, item in known.items():
            starts = {a - b for a, x in enumerate(cut(w, size[i])) for b, y in enumerate(cut(item, size[i])) if x == y}
            for start in starts:
                own = set(cut(w[max(start, 0) : start + len(item)], size[i]))
                sim = weigh(own & sets[i]) / weigh(own | sets[i])
                if round(sim, 9) * 100 >= s.percent:
                    best[d, i] = max(best.get((d, i), (0, 0)), (round(sim, 9), -start))
    return {k: (-v[1], v[0]) for k, v in best.items()}


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_contamination_equals_brute_force(spark, broadcast_rows):
    items, docs = item_texts()
    s = decontaminate.Settings(broadcast_rows=broadcast_rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("at", F.lit(0))
    got = {(r.doc_id, r.item_id): (r.start_word, pytest.approx(r.similarity, abs=2e-9)) for r in decontaminate.contaminated(frame(spark, docs), bench, s).collect()}
    assert expected_leaks(items, docs, s) == got
    bad = {d for d, _ in got}
    left = decontaminate.clean(frame(spark, docs), bench, s)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_contamination_of_odd_tables(spark):
    items, docs = item_texts()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame(spark, docs).limit(0), bench).count() == 0
    assert decontaminate.clean(frame(spark, docs), bench.limit(0)).count() == len(docs)


def test_pairs_by_packed_minhashes_equal_plain_comparison(spark):
    s = lines.Settings()
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 31, s.further)
    rows, paths_of = [], {}
    for i in range(40):
        further = np.where(rng.random(s.further) < rng.choice([0.2, 0.5, 0.9]), base, rng.integers(0, 1 << 31, s.further))
        further[:4] = base[:4] ^ (256 * int(rng.integers(0, 4)))  # equal lowest bytes of unequal minhashes
        paths_of[i] = further
        rows.append((7, i, i % 30, [None] * s.bins + [int(x) for x in further]))
    known = spark.createDataFrame(rows, "key long, id long, comp long, path array<int>")
    want = {(a, b) for a, b in combinations(range(40), 2) if a % 30 != b % 30 and 2 * int((paths_of[a] == paths_of[b]).sum()) >= s.further}
    df = lines._all_pairs(known.select("key", "id"), known.drop("key"), s)
    assert {(r.a, r.b) for r in df.collect()} == want and 20 < len(want) < 700
    far = known.withColumn("packed", lines._packed(s)).alias("x")
    both = far.select("id", "packed").crossJoin(far.select(F.col("id").alias("id2"), F.col("packed").alias("packed2"))).select("id", "id2", lines._unlike(s).alias("n"))
    assert {(r.id, r.id2): r.n for r in both.collect()} == {(a, b): int((paths_of[a] % 256 != paths_of[b] % 256).sum()) for a in range(40) for b in range(40)}
