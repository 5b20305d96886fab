"""Snapshot merges: a new snapshot of a table is a function of the old one and a batch of changes.

Each merge is one grouped aggregation on the key, so partial results combine before the shuffle and a replayed batch finds its
key again. Batches carry `ord`, their order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_KEY = ["label", "canonical_name"]
EDGE_KEY = ["subj_label", "subj", "predicate", "obj_label", "obj"]
#: Labels that hold the documents' own structure.
STRUCTURAL = ("Document", "Section")


def keyed_mentions(mentions: DataFrame, canonical=F.lower) -> DataFrame:
    return mentions.withColumn("canonical_name", canonical(F.col("text")))


def keyed_edges(edges: DataFrame, canonical=F.lower) -> DataFrame:
    return edges.withColumn("subj", canonical(F.col("subj"))).withColumn("obj", canonical(F.col("obj")))


#: What a node keeps of its first mention, where the mentions have it.
FIRST = ("text", "id", "properties", "source_text")
#: Mentions whose sources are appended to one piece before the pieces meet.
PIECE = 4096


def _node_rows(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Rows of a snapshot (age 0) and of a batch (age 1) alike: key, `at` (age, ord), first (fields of a first mention), name, confidence,
    verified, seen, n_mentions, and, where there is one, source_doc: one source, or the string of an old snapshot."""
    fields = [c for c in FIRST if c in batch.columns or (old is not None and c in old.columns)]
    held = lambda df, created: F.struct(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields), F.col(created).alias("created_at")).alias("first")
    at = lambda age, order: F.struct(F.lit(age).alias("age"), order.cast("long").alias("ord")).alias("at")
    source = lambda df, c: (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias("source_doc")
    rows = batch.select(*NODE_KEY, at(1, F.col("ord")), held(batch, "seen"), F.col("text").alias("name"), "confidence", "verified", "seen", F.lit(1).cast("long").alias("n_mentions"), source(batch, "source_doc"))
    if old is None:
        return rows
    n = F.col("n_mentions") if "n_mentions" in old.columns else F.lit(1).cast("long").alias("n_mentions")
    before = old.select(*NODE_KEY, at(0, F.lit(0)), held(old, "created_at"), "name", "confidence", "verified", F.col("last_confirmed_at").alias("seen"), n, source(old, "source_docs"))
    return before.unionByName(rows)


def merge_node_fields(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Nodes by (label, canonical_name), without their sources. New: all fields of the first mention. Known: greatest confidence, name of
    the latest, verified once verified, confirmed last; text, id, properties, source_text and created_at stay. n_mentions counts them.

    All of it combines before the shuffle, so a name that a third of all mentions have is one small row of each task."""
    rows = _node_rows(old, batch)
    out = rows.groupBy(*NODE_KEY).agg(
        F.min_by("first", "at").alias("f"),
        F.max_by("name", "at").alias("name"),
        F.max("confidence").alias("confidence"),
        F.bool_or("verified").alias("verified"),
        F.max("seen").alias("last_confirmed_at"),
        F.sum("n_mentions").alias("n_mentions"),
    )
    kept = [c for c in rows.schema["first"].dataType.names if c != "created_at"]
    return out.select(*NODE_KEY, *(F.col(f"f.{c}").alias(c) for c in kept), "name", "confidence", "verified", "f.created_at", "last_confirmed_at", "n_mentions")


def merge_sources(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The sources of nodes as a table (label, canonical_name, source_doc, n, first_ord): a row for each source, however often it names the node."""
    rows = batch.select(*NODE_KEY, "source_doc", F.lit(1).cast("long").alias("n"), F.col("ord").cast("long").alias("first_ord"))
    rows = rows if old is None else old.select(*rows.columns).unionByName(rows)
    return rows.groupBy(*NODE_KEY, "source_doc").agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))


def merge_nodes(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """merge_node_fields with `source_docs`, the sources of all mentions appended in order, for those who want them in one string.

    Sources are appended to pieces by runs of ord, then the pieces of a node, with the snapshot's string before them as it is; so
    no task gathers more rows of a hot node than it has pieces. The string itself grows with the node: snapshots that
    need no such string take merge_node_fields and merge_sources."""
    rows = _node_rows(old, batch).withColumn("run", F.struct("at.age", F.floor(F.col("at.ord") / PIECE).alias("k")))
    joined = lambda order, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("c")))), lambda d: d["c"]), ", ").alias("source_docs")
    parts = rows.groupBy(*NODE_KEY, "run").agg(
        F.min_by("first", "at").alias("first"),
        F.max_by("name", "at").alias("name"),
        F.max("confidence").alias("confidence"),
        F.bool_or("verified").alias("verified"),
        F.max("seen").alias("seen"),
        joined("at", "source_doc"),
    )
    out = parts.groupBy(*NODE_KEY).agg(
        F.min_by("first", "run").alias("f"),
        F.max_by("name", "run").alias("name"),
        F.max("confidence").alias("confidence"),
        F.bool_or("verified").alias("verified"),
        joined("run", "source_docs"),
        F.max("seen").alias("last_confirmed_at"),
    )
    kept = [c for c in rows.schema["first"].dataType.names if c != "created_at"]
    return out.select(*NODE_KEY, *(F.col(f"f.{c}").alias(c) for c in kept), "name", "confidence", "verified", "source_docs", "f.created_at", "last_confirmed_at")


def resolve_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ends = nodes.select("label", "canonical_name")
    for side in ("subj", "obj"):
        edges = edges.join(ends.select(F.col("label").alias(f"{side}_label"), F.col("canonical_name").alias(side)), [f"{side}_label", side], "left_semi")
    return edges


def dangling_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that lack an end: the key and which end."""
    ends = nodes.select("label", "canonical_name")
    out = None
    for side in ("subj", "obj"):
        lost = edges.join(ends.select(F.col("label").alias(f"{side}_label"), F.col("canonical_name").alias(side)), [f"{side}_label", side], "left_anti").select(*EDGE_KEY, F.lit(side).alias("missing"))
        out = lost if out is None else out.unionByName(lost)
    return out


def merge_edges(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Edges by both ends and predicate: the first one's confidence, verified, source and date stay; only the last confirmation moves."""
    rows = batch.select(*EDGE_KEY, "ord", "confidence", "verified", "source_doc", F.col("seen").alias("first_seen"), "seen")
    if old is not None:
        rows = old.select(*EDGE_KEY, F.lit(-1).cast("long").alias("ord"), "confidence", "verified", "source_doc", F.col("created_at").alias("first_seen"), F.col("last_confirmed_at").alias("seen")).unionByName(rows)
    first = F.min_by(F.struct("confidence", "verified", "source_doc", "first_seen"), "ord").alias("f")
    return rows.groupBy(*EDGE_KEY).agg(first, F.max("seen").alias("last_confirmed_at")).select(*EDGE_KEY, "f.confidence", "f.verified", "f.source_doc", F.col("f.first_seen").alias("created_at"), "last_confirmed_at")


def upsert_by_key(old: DataFrame | None, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; rows of the batch come after those of the old table."""
    values = [c for c in batch.columns if c not in (*keys, order)]
    rows = batch if old is None else old.withColumn(order, F.lit(None).cast(batch.schema[order].dataType)).unionByName(batch)
    last = F.max_by(F.struct(*values), F.struct(F.col(order).isNotNull(), F.col(order))).alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*")


def delete_by_key(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def _ends(edges: DataFrame) -> DataFrame:
    """The distinct ends of edges: tasks combine theirs before the shuffle."""
    end = lambda side: F.struct(F.col(f"{side}_label").alias("label"), F.col(side).alias("canonical_name"))
    return edges.select(F.explode(F.array(end("subj"), end("obj"))).alias("e")).select("e.label", "e.canonical_name").distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches, structural ones counted as edges if they are among `edges`."""
    return nodes.join(_ends(edges), NODE_KEY, "left_anti")


def delete_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    return nodes.join(_ends(edges), NODE_KEY, "left_semi")


def reconfirm(nodes: DataFrame, names: DataFrame, as_of) -> DataFrame:
    """Nodes of the given names (canonical_name) are confirmed as of that date."""
    named = names.select("canonical_name").distinct().withColumn("__hit", F.lit(True))
    return nodes.join(named, "canonical_name", "left").withColumn("last_confirmed_at", F.when(F.col("__hit"), as_of).otherwise(F.col("last_confirmed_at"))).drop("__hit")


def delete_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of those names and the edges at them."""
    gone = names.select("canonical_name").distinct()
    left = nodes.join(gone, "canonical_name", "left_anti")
    for side in ("subj", "obj"):
        edges = edges.join(gone.withColumnRenamed("canonical_name", side), side, "left_anti")
    return left, edges


def verify_nodes(nodes: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """verified = true for the decided (label, canonical_name), or for all."""
    if decisions is None:
        return nodes.withColumn("verified", F.lit(True))
    hit = decisions.select(*NODE_KEY).distinct().withColumn("__hit", F.lit(True))
    return nodes.join(hit, NODE_KEY, "left").withColumn("verified", F.when(F.col("__hit"), True).otherwise(F.col("verified"))).drop("__hit")


def verify_edges(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges are decided by name alone (subj, predicate, obj), whatever the labels."""
    hit = decisions.select("subj", "predicate", "obj").distinct().withColumn("__hit", F.lit(True))
    return edges.join(hit, ["subj", "predicate", "obj"], "left").withColumn("verified", F.when(F.col("__hit"), True).otherwise(F.col("verified"))).drop("__hit")


def reject_nodes(nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unverified nodes among the decisions go, with their edges; verified ones stay (no flag counts as verified)."""
    gone = nodes.where(~F.coalesce("verified", F.lit(True))).join(decisions.select(*NODE_KEY).distinct(), NODE_KEY, "left_semi").select(*NODE_KEY)
    left = delete_by_key(nodes, gone, NODE_KEY)
    for side in ("subj", "obj"):
        edges = delete_by_key(edges, gone.select(F.col("label").alias(f"{side}_label"), F.col("canonical_name").alias(side)), [f"{side}_label", side])
    return left, edges


def reject_edges(edges: DataFrame, decisions: DataFrame, only_unverified: bool = True) -> DataFrame:
    hit = edges.where(~F.coalesce("verified", F.lit(True))) if only_unverified else edges
    gone = hit.join(decisions.select("subj", "predicate", "obj").distinct(), ["subj", "predicate", "obj"], "left_semi")
    return delete_by_key(edges, gone, EDGE_KEY)


def backfill_verified(table: DataFrame) -> DataFrame:
    return table.withColumn("verified", F.coalesce("verified", F.lit(True)))


def newest(table: DataFrame, name: list[str], order: str) -> DataFrame:
    """The last row of each name."""
    return table.withColumn("__r", F.row_number().over(Window.partitionBy(*name).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def activate_version(versions: DataFrame, version_id: int) -> DataFrame:
    return versions.withColumn("is_active", F.col("version_id") == version_id)
