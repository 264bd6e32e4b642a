"""Fallbacks of knowledge filters and redirect chains."""

import random

from pagelattice.operators import knowledge, redirects


def graph(spark):
    mk = spark.createDataFrame
    ents = [("c1", "Company", "Acme", "acme"), ("c2", "Company", "Acme Steel", "acme-steel"), ("i1", "Industry", "Steel", "steel"), ("p1", "Page", "Home", "home"), ("p2", "Page", "News", "news")]
    links = [("c1", "p-a"), ("p1", "p-a"), ("c2", "p-b"), ("p2", "p-b"), ("i1", "p-b")]
    return {
        "entities": mk([(i, t, n, k, "fact", s) for s, (i, t, n, k) in enumerate(ents)], "id string, type string, name string, normalized_key string, epistemic_class string, seq bigint"),
        "entity_links": mk([(e, "project", p, 1) for e, p in links], "entity_id string, kind string, value string, seq bigint"),
        "entity_props": mk([("c1", "Company", "industry", "Wood", 1)], "entity_id string, type string, prop string, value string, seq bigint"),
        "relationships": mk([("r1", "COMPANY_OPERATES_IN_INDUSTRY", "c2", "i1", 1)], "id string, type string, from_id string, to_id string, seq bigint"),
        "evidence": mk([], "id string, stale boolean, review_status string, seq bigint"), "evidence_links": mk([], "evidence_id string, kind string, value string, seq bigint"),
    }


def found(store, **filters):
    return sorted(r.id for r in knowledge.query(store, **filters)["entities"].collect())


def test_filters_fall_back_within_the_plan(spark):
    g = graph(spark)
    sc = spark.sparkContext
    sc.setJobGroup("planning", "planning")
    planned = [knowledge.query(g, company="Acme"), knowledge.query(g, industry="wood"), knowledge.query(g, company="none", entity_type="Page", project="p-a", relationship_type="X")]
    assert not sc.statusTracker().getJobIdsForGroup("planning") and len(planned) == 3
    sc.setJobGroup("", "")
    assert found(g, company="Acme") == ["c1"]  # the exact key
    assert found(g, company="p-b") == ["c2", "i1", "p2"]  # a project
    assert found(g, company="steel") == ["c2"]  # a part of the key, as nothing else is found
    assert found(g, industry="Steel") == ["c2", "i1"] and found(g, industry="stee") == ["c2", "i1"] and found(g, industry="wood") == ["c1"]
    assert found(g, company="none", entity_type="Page") == ["p1", "p2"]  # an empty set is replaced
    assert found(g, company="none", entity_type="Page", strict=True) == []
    assert found(g, company="Acme", entity_type="Page") == []  # a set that is there is only narrowed
    assert found(g, company="none", relationship_type="COMPANY_OPERATES_IN_INDUSTRY") == ["c2", "i1"]
    assert found(g, company="Acme", relationship_type="COMPANY_OPERATES_IN_INDUSTRY") == ["c1"]


def walk(table, url):
    chain, at = [], url
    while at in table and table[at][1] is not None:
        at = table[at][1]
        if at in chain:
            return (None, None, None, None, "loop")
        chain.append(at)
    status = table[at][0] if at in table else None
    return (at, status, len(chain), chain, "broken" if at not in table else "ok" if status is not None and 200 <= status <= 299 else "error")


def test_redirect_chains_equal_a_walk(spark):
    draw, table = random.Random(3), {}
    for n in (0, 1, 2, 5, 20, 70):  # chains of all lengths, with a good, bad, unknown and looping end
        for kind in range(4):
            for i in range(n):
                table[f"{n}/{kind}/{i}"] = (301, f"{n}/{kind}/{i + 1}")
            end = [(200, None), (404, None), (302, "nowhere"), (302, f"{n}/{kind}/{draw.randrange(n + 1)}")][kind]
            table[f"{n}/{kind}/{n}"] = end
    table |= {"self": (301, "self"), "hub": (200, None), "none": (None, None)} | {f"to-hub-{i}": (301, "hub") for i in range(50)}
    rows = [(u, s, t) for u, (s, t) in table.items()] + [(None, 200, None), ("hub", 200, None), ("hub", 100, None)]
    df = redirects.redirect_chains(spark.createDataFrame(rows, "url string, status int, location string"))
    got = {r.url: (r.final_url, r.final_status, r.hops, r.chain, r.outcome) for r in df.collect()}
    assert got == {u: walk(table, u) for u in table}
    assert redirects.redirect_chains(spark.createDataFrame([], "url string, status int, location string")).count() == 0
