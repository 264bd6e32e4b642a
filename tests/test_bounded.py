"""What a step holds at once or deals over the network stays small, with the same rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagelattice.llm import backoff, language
from pagelattice.operators import knowledge, patterns
from pagelattice.sources import html


def test_links_meet_entities_once(spark):
    entities = spark.createDataFrame([("a", "A", "Page", "fact"), ("b", "B", "Page", "fact"), ("c", "C", "Page", "fact"), (None, "D", "Page", "fact")], "id string, name string, type string, epistemic_class string")
    links = [("a", "evidence", "e1"), ("a", "evidence", "e2"), ("a", "evidence", "e3"), ("b", "evidence", "gone"), ("b", "project", "e1"), ("other", "evidence", "e1"), (None, "evidence", "e1"), ("c", "evidence", "e4")]
    links = spark.createDataFrame([(*x, i) for i, x in enumerate(links)], "entity_id string, kind string, value string, seq bigint")
    evidence = [("e1", "u1", "high"), ("e2", "u1", "high"), ("e3", None, "low"), ("e4", "", "low")]
    evidence = spark.createDataFrame(evidence, "id string, source_url string, confidence string").select("*", F.lit("p").alias("source_project"), F.lit(1.0).alias("reliability_score"), F.lit("fact").alias("epistemic_class"))
    hits = knowledge.entity_hits(entities, links, evidence)
    assert {(r.entity_id, r.confidence, r.evidence_count, r.url_count) for r in hits.collect()} == {("a", "mixed", 3, 1), ("b", "none", 0, 0), ("c", "low", 1, 0), (None, "none", 0, 0)}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Join") == 2
    assert {r.entity_id for r in knowledge.entity_evidence(entities, links, evidence).collect()} == {"a", "c"}


def test_patterns_deal_links_once(spark):
    make = lambda rows, columns: spark.createDataFrame(rows, columns)
    entities = [("c1", "C1", "Company", "fact"), ("c2", "C2", "Company", "fact"), ("i1", "weak", "UxIssue", "observation"), ("i2", "weak too", "UxIssue", "observation"), ("i3", "alone", "UxIssue", "observation"),
                ("f", "F", "Page", "fact")]
    links = [("c1", "project", "p1"), ("c2", "project", "p2"), ("i1", "project", "p1"), ("i2", "project", "p2"), ("i3", "project", "p1"), ("f", "project", "p1"), ("f", "project", "p2"), ("i1", "evidence", "e1"), ("i1", "evidence", "e1"),
             ("i1", "evidence", "e2"), ("i2", "evidence", "e2"), ("i2", "evidence", None), ("i2", "conflict", "x"), ("i1", "conflict", "open"), ("i1", "conflict", None), ("i1", "evidence", "x")]
    store = {
        "entities": make([(*e, n) for n, e in enumerate(entities)], "id string, name string, type string, epistemic_class string, seq bigint"),
        "entity_props": make([(i, "observationKey", k) for i, k in (("i1", "k"), ("i2", "k"), ("i3", "other"), ("f", "k"))], "entity_id string, prop string, value string"),
        "entity_links": make([(*x, n) for n, x in enumerate(links)], "entity_id string, kind string, value string, seq bigint"),
        "evidence": make([("e1", "high"), ("e2", "low")], "id string, confidence string"),
        "conflicts": make([("x", True), ("x", True), ("open", False), (None, True)], "id string, blocks boolean"),
    }
    found = patterns.candidate_patterns(store)
    rows = [(r.observation_key, r.name, r.projects, r.companies, r.evidence_count, r.blocking_conflicts, r.confidence_summary, r.blocked) for r in found.collect()]
    assert rows == [("k", "Candidate: k", 2, 2, 4, 1, "low", True)]
    # Links are only joined for the companies; members, conflicts and evidence are looked up in what was written.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 4


def test_pages_leave_in_small_parts():
    page = "<ul>" + "<li><a href='/x'>y</a>" * 4000 + "</ul>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([page] * 10 + ["", None])], ["page_id", "html"])
    got = list(html._tokenize([batch]))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(12))
    assert len(got) >= 4 and max(b.num_rows for b in got) * len(page) <= 400_000


def test_languages_are_judged_in_small_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, w * 40, "en" if i % 2 else "fr", "s", 0) for i, w in enumerate(["le chat et la maison ", "the cat and the house "] * 40)], "doc_id long, text string, lang string, source string, n_chars long")
    model = language.train(docs)
    sizes, features = [], language.features
    monkeypatch.setattr(language, "features", lambda texts, *rest: sizes.append(sum(map(len, texts))) or features(texts, *rest))
    texts = [r.text * 20 for r in docs.collect()] + [None, ""]
    names, scores = language._judge(texts, model, language._table(model))
    assert len(sizes) > 1 and max(sizes) <= 300_000
    alone = [language._judge([t], model, language._table(model)) for t in texts]
    assert names == [n[0] for n, _ in alone] and np.allclose(scores, [s[0] for _, s in alone])


def test_places_of_n_grams_equal_a_search():
    for texts in ([b""], [b"a"], [b"a b a b c", b"", b"b a b", b"\n a"], [b"x " * 500, b"x y x"]):
        grams, _ = backoff.grams(texts, 3)
        known, _ = backoff._requests(grams)
        for at, g in zip(backoff.places(grams), grams):
            assert (known[at] == g).all() and (at == np.searchsorted(known, g)).all()
