"""Keyed merge of slices into the shared store.

The store has the tables of a slice without ``project_slug`` (membership is a link of
kind 'project'), plus conflicts(id, kind, description, entity_id, blocks, review_status)
and conflict_links(conflict_id, kind, value). Each fold is one shuffle on the row's own
id with partial aggregation; list members are rows, so a vertex shared by every project
costs one row per member and never an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.core import Tables, js_number
from pagelattice.functions.keys import conflict_id

# Entity types shared by all projects; how far apart scores conflict.
GLOBAL_TYPES = ["Industry", "Technology", "DocumentType"]
SCORE_GAP = 4
STORE_TABLES = {
    "entities": ["id", "type", "name", "normalized_key", "epistemic_class", "visibility", "review_status", "seq"],
    "entity_props": ["entity_id", "type", "prop", "value", "seq"],
    "entity_links": ["entity_id", "kind", "value", "seq"],
    "relationships": ["id", "type", "from_id", "to_id", "epistemic_class", "visibility", "review_status", "seq"],
    "relationship_links": ["relationship_id", "kind", "value", "seq"],
    "evidence": [
        "id", "source_company", "source_project", "source_url", "source_page_title", "excerpt", "confidence",
        "extraction_method", "review_status", "epistemic_class", "visibility", "reliability_class",
        "reliability_score", "text_ok", "text_issues", "stale", "seq",
    ],
    "evidence_links": ["evidence_id", "kind", "value", "seq"],
}


def _both(store: DataFrame, new: DataFrame, name: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Store rows (src 0) and slice rows (src 1), slices in project order. ``also`` names columns that depend on the row's owner alone."""
    if name == "evidence" and "source_project" not in new.columns:
        new = new.withColumn("source_project", F.col("project_slug"))
    cols = [*STORE_TABLES[name], *also]
    order = F.col("project_slug") if "project_slug" in new.columns else F.lit("")
    return store.select(*cols, F.lit(0).alias("src"), F.lit("").alias("_p")).unionByName(
        new.select(*cols, F.lit(1).alias("src"), order.alias("_p"))
    )


def _published(visibility: str = "visibility") -> Column:
    """A private row becomes shared when it first enters the store."""
    return F.when(
        (F.col("src") == 1) & (F.col(visibility) == "project_private"), F.lit("shared_unreviewed")
    ).otherwise(F.col(visibility))


def _first_wins(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per id the fields of the stored row, else of the first slice; updated when both."""
    kept = [c for c in cols if c != "id"]
    return (
        df.groupBy("id")
        .agg(
            F.min_by(F.struct(*kept), F.struct("src", "_p", "seq")).alias("p"),
            (F.min("src") == 1).alias("inserted"),
            ((F.min("src") == 0) & (F.max("src") == 1)).alias("updated"),
        )
        .select("id", "p.*", "inserted", "updated")
    )


def merge_entities(store: DataFrame, new: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    df = _both(store, new, "entities", also).withColumn("visibility", _published())
    return _first_wins(df, [*STORE_TABLES["entities"], *also])


def merge_relationships(store: DataFrame, new: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    df = _both(store, new, "relationships", also).withColumn("visibility", _published())
    return _first_wins(df, [*STORE_TABLES["relationships"], *also])


def merge_evidence(store: DataFrame, new: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Stored provenance is kept; a record seen again is no longer stale."""
    df = _first_wins(_both(store, new, "evidence", also), [*STORE_TABLES["evidence"], *also])
    return df.withColumn("stale", F.col("stale") & ~F.col("updated"))


def merge_links(store: DataFrame, new: DataFrame, name: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Union of members; the earliest sighting keeps the position."""
    df = _both(store, new, name, also)
    owner = STORE_TABLES[name][0]
    return (
        df.groupBy(owner, "kind", "value", *also).agg(F.min(F.struct("src", "_p", "seq")).alias("o"))
        .select(owner, "kind", "value", *also, F.col("o.seq").alias("seq"), (F.col("o.src") == 1).alias("inserted"))
    )


def merge_props(store: DataFrame, new: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Latest value per property; a global vertex keeps the properties of its first row."""
    df = _both(store, new, "entity_props", also)
    is_global = F.col("type").isin(GLOBAL_TYPES)
    own = df.filter(~is_global)
    merged = own.groupBy("entity_id", "type", "prop", *also).agg(
        F.max_by(F.struct("value", "seq"), F.struct("src", "_p", "seq")).alias("p")
    ).select("entity_id", "type", "prop", *also, "p.value", "p.seq")
    shared = df.filter(is_global)
    owner = shared.groupBy("entity_id").agg(F.min(F.struct("src", "_p")).alias("o"))
    kept = (
        shared.join(owner, "entity_id").filter((F.col("src") == F.col("o.src")) & (F.col("_p") == F.col("o._p")))
        .select("entity_id", "type", "prop", *also, "value", "seq")
    )
    return merged.unionByName(kept)


def _scores(props: DataFrame) -> DataFrame:
    """entity_id, score, obs_key of entities with a numeric score."""
    return (
        props.filter(F.col("prop").isin("score", "observationKey")).groupBy("entity_id")
        .agg(
            F.max(F.when(F.col("prop") == "score", F.col("value").try_cast("double"))).alias("score"),
            F.max(F.when(F.col("prop") == "observationKey", F.col("value"))).alias("obs_key"),
        )
        .filter("score is not null")
    )


def score_conflicts(store: dict[str, DataFrame], new: dict[str, DataFrame], also: tuple[str, ...] = ()) -> DataFrame:
    """Entities whose score moved by four or more under the same observation key
    within a project both sides share."""
    before = _scores(store["entity_props"])
    after = _scores(new["entity_props"]).select(
        "entity_id", F.col("score").alias("next"), F.col("obs_key").alias("next_key")
    )
    df = before.join(after, "entity_id").filter(
        (F.abs(F.col("score") - F.col("next")) >= SCORE_GAP) & F.col("obs_key").eqNullSafe(F.col("next_key"))
    )
    project = F.col("kind") == "project"
    common = (
        store["entity_links"].filter(project).select("entity_id", "value")
        .join(new["entity_links"].filter(project).select("entity_id", "value"), ["entity_id", "value"], "left_semi")
        .select("entity_id").distinct()
    )
    df = df.join(common, "entity_id", "left_semi").join(
        store["entities"].select(F.col("id").alias("entity_id"), "name", *also), "entity_id"
    )
    old, nxt = js_number(F.col("score")), js_number(F.col("next"))
    return df.select(
        conflict_id(F.col("entity_id"), F.lit("score"), old, nxt).alias("id"),
        F.lit("stale_vs_fresh").alias("kind"),
        F.concat(F.lit("Score conflict on "), F.col("name"), F.lit(": "), old, F.lit(" vs "), nxt).alias("description"),
        "entity_id", F.lit(True).alias("blocks"), F.lit("needs_review").alias("review_status"), *also,
    )


def merge_conflicts(store: DataFrame, new: DataFrame) -> DataFrame:
    """Known conflicts stay as they are, unknown ones are added."""
    return store.unionByName(new.join(store.select("id"), "id", "left_anti"))


def conflict_entity_links(conflicts: DataFrame, seq: int = 0, also: tuple[str, ...] = ()) -> DataFrame:
    return conflicts.select(
        "entity_id", F.lit("conflict").alias("kind"), F.col("id").alias("value"), F.lit(seq).cast("bigint").alias("seq"), *also
    )


def conflict_links(conflicts: DataFrame, store_links: DataFrame, new_links: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Projects and evidence of both sides of a conflict."""
    members = store_links.select("entity_id", "kind", "value").unionByName(new_links.select("entity_id", "kind", "value"))
    return (
        members.filter(F.col("kind").isin("project", "evidence"))
        .join(conflicts.select("entity_id", F.col("id").alias("conflict_id"), *also), "entity_id")
        .select("conflict_id", "kind", "value", *also).distinct()
    )


def mark_stale(evidence: DataFrame, active_ids: DataFrame, projects: DataFrame) -> DataFrame:
    """Evidence of the refreshed projects that is no longer produced becomes stale."""
    refreshed = projects.select(F.col("project_slug").alias("source_project"), F.lit(True).alias("_ref")).distinct()
    active = active_ids.select("id", F.lit(True).alias("_act")).distinct()
    df = evidence.join(refreshed, "source_project", "left").join(active, "id", "left")
    gone = F.col("_ref").isNotNull() & F.col("_act").isNull() & ~F.col("stale")
    return (
        df.withColumn("newly_stale", gone)
        .withColumn("review_status", F.when(gone, "stale").otherwise(F.col("review_status")))
        .withColumn("stale", F.col("stale") | gone)
        .drop("_ref", "_act")
    )


def drop_contribution(store: dict[str, DataFrame], projects: DataFrame) -> dict[str, DataFrame]:
    """The store without what only the given projects contributed.

    Shared entities lose the project link; relationships, evidence and conflicts go
    when they belong to these projects alone.
    """
    gone = projects.select(F.col("project_slug").alias("value")).distinct()

    def orphaned(links: DataFrame, owner: str) -> DataFrame:
        member = links.filter("kind = 'project'").join(gone.withColumn("_g", F.lit(1)), "value", "left")
        return (
            member.groupBy(owner).agg(F.count("*").alias("n"), F.count("_g").alias("g"))
            .filter("n = g").select(F.col(owner).alias("id"))
        )

    out = Tables({k: (lambda k=k: store[k]) for k in store})
    dead_e = orphaned(store["entity_links"], "entity_id")
    dead_r = orphaned(store["relationship_links"], "relationship_id")
    mine = F.col("kind") == "project"
    links = store["entity_links"]
    kept_projects = links.filter(mine).join(gone, "value", "left_anti")
    others = links.filter(~mine).join(dead_e.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")
    out["entities"] = store["entities"].join(dead_e, "id", "left_anti")
    out["entity_links"] = others.unionByName(kept_projects)
    out["entity_props"] = store["entity_props"].join(dead_e.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")
    out["relationships"] = store["relationships"].join(dead_r, "id", "left_anti")
    out["relationship_links"] = store["relationship_links"].join(
        dead_r.withColumnRenamed("id", "relationship_id"), "relationship_id", "left_anti"
    )
    dropped = gone.withColumnRenamed("value", "source_project")
    out["evidence"] = store["evidence"].join(dropped, "source_project", "left_anti")
    out["evidence_links"] = store["evidence_links"].join(
        out["evidence"].select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi"
    )
    if "conflict_links" in store:
        dead_c = orphaned(store["conflict_links"], "conflict_id")
        out["conflicts"] = store["conflicts"].join(dead_c, "id", "left_anti")
        out["conflict_links"] = store["conflict_links"].join(
            dead_c.withColumnRenamed("id", "conflict_id"), "conflict_id", "left_anti"
        )
    return out


def merge_store(store: dict[str, DataFrame], new: dict[str, DataFrame], also: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All merges of one ingest; conflicts are found against the store as it was. ``also`` names columns that both sides carry
    along and that depend on the row's owner alone, such as the bucket it lies in."""
    made = Tables({"found": lambda: score_conflicts(store, new, also)})

    def entity_links() -> DataFrame:
        links = merge_links(store["entity_links"], new["entity_links"], "entity_links", also).drop("inserted")
        both = links.unionByName(conflict_entity_links(made["found"], also=also))
        return both.groupBy("entity_id", "kind", "value", *also).agg(F.min("seq").alias("seq"))

    def all_conflict_links() -> DataFrame:
        members = conflict_links(made["found"], store["entity_links"], new["entity_links"], also)
        return store["conflict_links"].unionByName(members).distinct() if "conflict_links" in store else members

    def plain(name: str):
        return lambda: merge_links(store[name], new[name], name, also)

    return Tables(
        {
            "entities": lambda: merge_entities(store["entities"], new["entities"], also),
            "entity_props": lambda: merge_props(store["entity_props"], new["entity_props"], also),
            "entity_links": entity_links,
            "relationships": lambda: merge_relationships(store["relationships"], new["relationships"], also),
            "relationship_links": plain("relationship_links"),
            "evidence": lambda: merge_evidence(store["evidence"], new["evidence"], also),
            "evidence_links": plain("evidence_links"),
            "conflicts": lambda: merge_conflicts(store["conflicts"], made["found"]) if "conflicts" in store else made["found"],
            "conflict_links": all_conflict_links,
        }
    )


def ingest(
    store: dict[str, DataFrame],
    new: dict[str, DataFrame],
    projects: DataFrame,
    dry_run: bool = False,
    force: bool = False,
    changed: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merged store and result counts per project.

    ``changed`` (project_slug) limits the ingest to projects whose inputs changed;
    ``force`` replaces their earlier contribution; ``dry_run`` only counts.
    """
    if changed is not None and not force:
        only = changed.select("project_slug").distinct()
        given = new
        new = Tables({k: (lambda k=k: given[k].join(only, "project_slug", "left_semi")) for k in given})
        active = projects.join(only, "project_slug", "left_semi")
    else:
        active = projects
    parts = [
        new[n].select("project_slug", F.lit(n).alias("part")) for n in ("entities", "relationships", "evidence")
    ]
    counts = reduce(DataFrame.unionByName, parts).groupBy("project_slug").agg(
        *[F.count_if(F.col("part") == n).alias(f"{n}_count") for n in ("entities", "relationships", "evidence")]
    )
    result = projects.select("project_slug").distinct().join(counts, "project_slug", "left").join(
        active.select("project_slug").distinct().withColumn("_run", F.lit(True)), "project_slug", "left"
    )
    result = result.select(
        "project_slug", F.lit(dry_run).alias("dry_run"), F.col("_run").isNull().alias("skipped"),
        *[F.coalesce(f"{n}_count", F.lit(0)).alias(f"{n}_count") for n in ("entities", "relationships", "evidence")],
    )
    if dry_run:
        return store, result
    base = drop_contribution(store, active) if force else store
    merged = merge_store(base, new)
    merged["evidence"] = mark_stale(
        merged["evidence"], new["evidence"].select("id"), active.select("project_slug")
    )
    # What the merges note about a row (inserted, updated, newly stale) is no part of the store.
    stored = Tables({n: (lambda n=n: merged[n].select(*STORE_TABLES[n]) if n in STORE_TABLES else merged[n]) for n in merged})
    return stored, result


def upsert_by_key(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, the non-NULL delta values win."""
    others = [c for c in base.columns if c not in keys]
    d = delta.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in others if c in delta.columns])
    joined = base.join(d, keys, "full")
    return joined.select(
        *keys, *[F.coalesce(f"_d_{c}", c).alias(c) if c in delta.columns else F.col(c) for c in others]
    )
