"""Reports on a graph snapshot: counts, health, conflicts, decay, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import effective_confidence
from loomgraph.operators import structure
from loomgraph.operators.merge import STRUCTURAL, orphans

LOW = 0.6
# Predicates that contradict each other.
CONTRADICTIONS = (("CAUSES", "PROTECTS_AGAINST"), ("COMPATIBLE_WITH", "INCOMPATIBLE_WITH"), ("SUITABLE_FOR", "INEFFECTIVE_AGAINST"), ("VULNERABLE_TO", "PROTECTS_AGAINST"))


def domain(label: str | Column) -> Column:
    """Not a label of the documents' structure."""
    return ~(F.col(label) if isinstance(label, str) else label).isin(*STRUCTURAL)


def unverified(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("verified", F.lit(True)))


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes")).join(edges.agg(F.count("*").alias("n_edges")))


def duplicates(nodes: DataFrame, by: list[str]) -> DataFrame:
    return nodes.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def graph_health(nodes: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """One row of metrics of a graph with its documents' layer, which only n_nodes, n_edges, the coverage and the ends that keep an
    entity from being an orphan take in. unused_types: the types (type_name) that no entity has, in order. One pass over the
    nodes, one over the edges; the joins are of one-row frames."""
    entities = nodes.where(domain("label"))
    open_ = lambda c="verified": ~F.coalesce(c, F.lit(True))
    own, known = domain("label"), structure.knowledge()
    n = nodes.agg(
        F.count("*").alias("n_nodes"), F.count_if(own).alias("n_entities"), F.coalesce(F.round(F.avg(F.when(own, F.col("confidence"))), 3), F.lit(0.0)).alias("avg_confidence"),
        F.count_if(own & (F.col("confidence") < LOW)).alias("low_nodes"), F.count_if(own & open_()).alias("unverified_nodes"), F.countDistinct(F.when(own, F.col("label"))).alias("n_labels"),
    )
    e = edges.agg(
        F.count("*").alias("n_edges"), F.count_if(known).alias("n_facts"), F.count_if(known & (F.col("confidence") < LOW)).alias("low_edges"), F.count_if(known & open_()).alias("unverified_edges"),
    )
    o = orphans(entities, edges).agg(F.count("*").alias("n_orphans"))
    t = unused_types(types, entities).agg(F.array_join(F.array_sort(F.collect_list("type_name")), ",").alias("unused_types"))
    out = n.join(e).join(o).join(t).join(structure.coverage(nodes, edges))
    density = F.when(F.col("n_entities") > 0, F.round(F.col("n_facts") / F.col("n_entities"), 2)).otherwise(0.0)
    return out.withColumn("density", density)


def unused_types(types: DataFrame, nodes: DataFrame) -> DataFrame:
    return types.select("type_name").distinct().subtract(nodes.select(F.col("label").alias("type_name")))


def contradiction_pairs(pairs: DataFrame) -> DataFrame:
    """Unordered pairs (a, b), once each."""
    return pairs.select(F.array_sort(F.array("a", "b")).alias("p")).distinct().select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))


def conflicts(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Ends that are joined by both predicates of a rule (a, b). The rules select edges first; one shuffle on the ends meets both sides."""
    ends = ["subj_label", "subj", "obj_label", "obj"]
    left = edges.join(rules, edges["predicate"] == rules["a"]).select(*ends, "a", "b", F.col("confidence").alias("conf_a"))
    right = edges.join(rules.select(F.col("a").alias("__a"), F.col("b").alias("__b")), F.col("predicate") == F.col("__b")).select(*ends, F.col("__a").alias("a"), F.col("__b").alias("b"), F.col("confidence").alias("conf_b"))
    return left.join(right, [*ends, "a", "b"])


def decayed(nodes: DataFrame, as_of: Column, rate: float, threshold: float) -> DataFrame:
    eff = effective_confidence(F.col("confidence"), F.col("last_confirmed_at"), as_of, rate)
    return nodes.where(domain("label")).withColumn("effective", F.round(eff, 6)).where(eff < threshold)


def section_coverage(sections: DataFrame, links: DataFrame) -> DataFrame:
    """One row: sections (section_id), those of them that a link (section_id) has, and their share in percent (0 where there are none)."""
    hit = sections.select("section_id").join(links.select("section_id", F.lit(1).alias("hit")).distinct(), "section_id", "left")
    out = hit.agg(F.count("*").alias("sections"), F.count("hit").alias("covered"))
    share = F.when(F.col("sections") > 0, F.round(F.col("covered") / F.col("sections") * 100, 1)).otherwise(0.0)
    return out.withColumn("percent", share)


def label_config(table: DataFrame, marks: list[str], candidates: list[str]) -> DataFrame:
    """For each label: whether any row has one of the mark columns (then it is structure), and its name column, the first candidate that has a value."""
    flags = [F.bool_or(F.col(c).isNotNull()).alias(f"__{c}") for c in dict.fromkeys([*marks, *candidates])]
    out = table.groupBy("label").agg(*flags)
    name = F.coalesce(*(F.when(F.col(f"__{c}"), F.lit(c)) for c in candidates))
    is_meta = F.array_max(F.array(*(F.col(f"__{m}").cast("int") for m in marks))) == 1
    return out.select("label", is_meta.alias("is_structure"), name.alias("name_column"))


def present_fields(table: DataFrame, fields: list[str]) -> DataFrame:
    """The fields that have a value in any row."""
    flags = table.agg(*(F.bool_or(F.col(f).isNotNull()).alias(f) for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(False)).alias("present")) for f in fields))
    return flags.select(F.explode(pairs).alias("p")).select("p.field", "p.present")


def display_name() -> Column:
    return F.coalesce(F.nullif("canonical_name", F.lit("")), F.nullif("name", F.lit("")), F.col("text"))


def properties(nodes: DataFrame, fields: list[str], nested: list[str] | None = None) -> DataFrame:
    """(label, canonical_name, k, v) of every shown property: no empty values. Columns of `nested` hold JSON objects, whose entries are
    shown as properties; one that is no object is shown as it is."""
    pairs = F.array(*(F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v")) for f in sorted(fields)))
    for f in nested or []:
        entries = F.transform(F.map_entries(F.from_json(f, "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
        pairs = F.concat(pairs, F.coalesce(entries, F.array(F.struct(F.lit(f).alias("k"), F.col(f).alias("v")))))
    shown = F.filter(pairs, lambda p: p["v"].isNotNull() & ~p["v"].isin("", "{}"))
    return nodes.select("label", "canonical_name", F.explode(shown).alias("p")).select("label", "canonical_name", "p.k", "p.v")


def dashboard(documents: DataFrame, pages: DataFrame, nodes: DataFrame, edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row: documents, pages, nodes, edges, density (edges of a node), sessions and turns."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    e = episodes.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("turns"))
    out = n(documents, "documents").join(n(pages, "pages")).join(n(nodes, "nodes")).join(n(edges, "edges")).join(e)
    return out.withColumn("density", F.when(F.col("nodes") > 0, F.round(F.col("edges") / F.col("nodes"), 2)).otherwise(0.0))


def type_histogram(records: DataFrame, by: str = "type") -> DataFrame:
    """Types of extracted records and how many of each, and their share in percent."""
    n = records.groupBy(by).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select(by, "n", F.round(F.col("n") / F.col("all") * 100, 1).alias("percent"))
