"""The documents' own layer of a graph: Document and Section nodes, their trees, and the edges that join them to each other and to
the entities that were found in them.

Structural nodes are known by their id, which stands where other nodes have their canonical name; a section's id is its
document's and its node's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.merge import EDGE_KEY

DOCUMENT, SECTION = "Document", "Section"
BELONGS_TO, EXTRACTED_FROM = "BELONGS_TO", "EXTRACTED_FROM"


def section_id(doc_id: Column, node_id: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), node_id)


def knowledge(predicate: str | Column = "predicate") -> Column:
    """Not a predicate of the documents' structure."""
    return ~(F.col(predicate) if isinstance(predicate, str) else predicate).isin(BELONGS_TO, EXTRACTED_FROM)


# ---- trees ----

_LABELS = "node_id string, parent_id string, level int, first int, last int"


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by document and node; a section's row is made when the next one that is no deeper has come."""
    open_: list[list] = []  # document, node, parent, level, depth, place
    done: list[tuple] = []
    doc, place = object(), 0

    def close(depth: int | None) -> None:
        while open_ and (depth is None or open_[-1][4] >= depth):
            d, node, parent, level, _, first = open_.pop()
            done.append((d, node, parent, level, first, place))

    def batch(names: list[str], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        kinds = (kind, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["doc_id", "node_id", "parent_id", "level", "first", "last"]
    kind = pa.null()
    for b in batches:
        kind = b.column(0).type
        for d, node, depth in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if d != doc:
                close(None)
                doc, place = d, 0
            close(depth)
            place += 1
            open_.append([d, node, open_[-1][1] if open_ else None, len(open_), depth, place])
        if done:
            yield batch(names, kind)
    close(None)
    if done:
        yield batch(names, kind)


def nested_sets(sections: DataFrame) -> DataFrame:
    """doc_id, node_id, parent_id, level, first, last of sections (doc_id, node_id in reading order, depth): the parent is the nearest
    section before it that is less deep; first is its place in its document and last that of its last descendant, so a
    section's descendants are those with first < place <= last. Documents are read in order, with a stack as deep as the tree.
    """
    rows = sections.select("doc_id", "node_id", F.col("depth").cast("int").alias("depth")).repartition("doc_id").sortWithinPartitions("doc_id", "node_id")
    return rows.mapInArrow(_labelled, f"doc_id {sections.schema['doc_id'].dataType.simpleString()}, {_LABELS}")


def tree_json(sections: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tree_json of sections (doc_id, node_id, title, start_page, end_page, summary) and their nested_sets: nested objects with
    `children`. Each section writes its own opening, and closes what the section before it leaves open; no round a level."""
    rows = sections.join(labels.select("doc_id", "node_id", "level", "first"), ["doc_id", "node_id"])
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("first"))
    own = F.to_json(F.struct("node_id", F.coalesce("title", F.lit("")).alias("title"), "start_page", "end_page", F.coalesce("summary", F.lit("")).alias("summary")), {"ignoreNullFields": "false"})
    opening = F.concat(F.substring(own, 1, F.length(own) - 1), F.lit(',"children":['))
    closing = F.when(before >= F.col("level"), F.concat(F.repeat(F.lit("]}"), before - F.col("level") + 1), F.lit(","))).otherwise("")
    pieces = rows.select("doc_id", "first", "level", F.concat(closing, opening).alias("piece"))
    of = F.array_sort(F.collect_list(F.struct("first", "piece")))
    out = pieces.groupBy("doc_id").agg(of.alias("p"), F.max_by("level", "first").alias("level"))
    return out.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.repeat(F.lit("]}"), F.col("level") + 1), F.lit("]")).alias("tree_json"))


def subtree_text(labels: DataFrame, texts: DataFrame, between: str = "\n\n---\n\n") -> DataFrame:
    """doc_id, node_id, text of sections: their own text (doc_id, node_id, text), or, where they have none, those of all their
    descendants in order; sections without either are left out. Places of descendants are keys, so a large document is no hot key."""
    own = labels.join(texts.where("text != ''"), ["doc_id", "node_id"], "left").select("doc_id", "node_id", "first", "last", "text")
    bare = own.where("text is null and last > first").select("doc_id", "node_id", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("place"))
    met = bare.join(own.where("text is not null").select("doc_id", F.col("first").alias("place"), "text"), ["doc_id", "place"])
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    below = met.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), between).alias("text"))
    return own.where("text is not null").select("doc_id", "node_id", "text").unionByName(below)


# ---- nodes and edges ----


def _first(old: DataFrame | None, batch: DataFrame, last: list[str]) -> DataFrame:
    """Rows by id: those of `old` stay as they are but for the columns in `last`, which the batch's row sets."""
    rows = batch.withColumn("__age", F.lit(1))
    if old is not None:
        rows = old.withColumn("__age", F.lit(0)).unionByName(rows)
    stay = [c for c in batch.columns if c not in ("id", *last)]
    out = rows.groupBy("id").agg(F.min_by(F.struct(*stay), F.struct("__age", F.xxhash64(*stay))).alias("f"), *(F.max_by(c, F.struct("__age", F.xxhash64(c))).alias(c) for c in last))
    return out.select("id", "f.*", *last).select(*batch.columns)


def document_nodes(docs: DataFrame, trees: DataFrame) -> DataFrame:
    """Document nodes of docs (doc_id, title, filename, page_count, ingested_at) and their trees; without sections the tree is empty."""
    title = F.col("title")
    rows = docs.join(trees, "doc_id", "left")
    return rows.select(F.col("doc_id").cast("string").alias("id"), "filename", "title", title.alias("name"), title.alias("text"), F.lower(title).alias("canonical_name"), "page_count", "ingested_at", F.coalesce("tree_json", F.lit("[]")).alias("tree_json"))


def section_nodes(sections: DataFrame) -> DataFrame:
    title = F.col("title")
    return sections.select(
        section_id(F.col("doc_id"), F.col("node_id")).alias("id"), F.col("doc_id").cast("string").alias("document_id"), "node_id", "title", title.alias("name"), title.alias("text"),
        F.lower(title).alias("canonical_name"), "start_page", "end_page", F.coalesce("summary", F.lit("")).alias("summary"),
    )


def belongs_edges(sections: DataFrame) -> DataFrame:
    """A BELONGS_TO edge of each section node."""
    return sections.select(F.lit(SECTION).alias("subj_label"), F.col("id").alias("subj"), F.lit(BELONGS_TO).alias("predicate"), F.lit(DOCUMENT).alias("obj_label"), F.col("document_id").alias("obj")).distinct()


def store_documents(old: tuple[DataFrame, DataFrame] | None, documents: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document nodes, section nodes, BELONGS_TO edges) after a batch of document and section nodes. A known document takes the
    batch's tree and nothing else; a known section stays as it is. A batch that comes again changes nothing."""
    known = old or (None, None)
    docs, secs = _first(known[0], documents, ["tree_json"]), _first(known[1], sections, [])
    return docs, secs, belongs_edges(secs)


def extracted_edges(found: DataFrame, nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """An EXTRACTED_FROM edge for each entity and section (label, canonical_name, section_id), if both are there."""
    links = found.select("label", "canonical_name", "section_id").distinct()
    links = links.join(nodes.select("label", "canonical_name"), ["label", "canonical_name"], "left_semi").join(sections.select(F.col("id").alias("section_id")), "section_id", "left_semi")
    return links.select(F.col("label").alias("subj_label"), F.col("canonical_name").alias("subj"), F.lit(EXTRACTED_FROM).alias("predicate"), F.lit(SECTION).alias("obj_label"), F.col("section_id").alias("obj"))


def layered_nodes(nodes: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Entities and structure in one table, with what both have; structural nodes stand under their ids."""
    ids = lambda df, label: df.select(F.lit(label).alias("label"), F.col("id").alias("canonical_name"), *(c for c in df.columns if c in nodes.columns and c not in ("id", "canonical_name")))
    return nodes.unionByName(ids(documents, DOCUMENT), allowMissingColumns=True).unionByName(ids(sections, SECTION), allowMissingColumns=True)


def layered_edges(edges: DataFrame, *structural: DataFrame) -> DataFrame:
    for more in structural:
        edges = edges.unionByName(more, allowMissingColumns=True)
    return edges


def provenance(edges: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """label, canonical_name, section_id, section_title, doc_title, doc_filename of every entity: from it to its sections, from these to their documents."""
    hop = lambda p, a, b: edges.where(F.col("predicate") == p).select(*(F.col(x).alias(y) for x, y in zip(EDGE_KEY, (f"{a}_label", a, "p", f"{b}_label", b), strict=True))).drop("p")
    met = hop(EXTRACTED_FROM, "entity", "section").join(hop(BELONGS_TO, "section", "document"), ["section_label", "section"])
    titled = met.join(sections.select(F.col("id").alias("section"), F.col("title").alias("section_title")), "section").join(documents.select(F.col("id").alias("document"), F.col("title").alias("doc_title"), F.col("filename").alias("doc_filename")), "document")
    return titled.select(F.col("entity_label").alias("label"), F.col("entity").alias("canonical_name"), F.col("section").alias("section_id"), "section_title", "doc_title", "doc_filename")


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sections, those that an entity was extracted from, and their share in percent (0 where there are none)."""
    sections = nodes.where(F.col("label") == SECTION).select(F.col("canonical_name").alias("section_id"))
    hit = edges.where((F.col("predicate") == EXTRACTED_FROM) & (F.col("obj_label") == SECTION)).select(F.col("obj").alias("section_id"), F.lit(1).alias("hit")).distinct()
    out = sections.join(hit, "section_id", "left").agg(F.count("*").alias("total_sections"), F.count("hit").alias("covered_sections"))
    return out.withColumn("document_coverage", F.when(F.col("total_sections") > 0, F.round(F.col("covered_sections") / F.col("total_sections") * 100, 1)).otherwise(0.0))
