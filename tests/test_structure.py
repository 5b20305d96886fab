"""The documents' layer, trees and formats against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import audit, merge, structure
from loomgraph.sources import documents as D
from loomgraph.sources import formats

SECTIONS = "doc_id long, node_id string, depth int, title string, start_page int, end_page int, summary string"


def some_sections(depths):
    return [(d, f"{k:04d}", depth, f"T{k} \"é\"" if k % 5 else None, k, k + 1, "s" if k % 3 == 0 else None) for d, of in depths.items() for k, depth in enumerate(of, 1)]


def random_depths():
    rng = random.Random(3)
    return {1: [0], 2: [2, 1, 0], 3: [0, 1, 2, 3, 1, 0, 5, 5], None: [0, 1], **{k: [rng.randrange(6) for _ in range(rng.randrange(1, 60))] for k in range(4, 30)}, 99: list(range(300)), 100: [0] * 300}


def plain_tree(of):
    """(parent, level, first, last) of each section, by looking back and ahead."""
    out = []
    for k, depth in enumerate(of):
        parent = next((j for j in range(k - 1, -1, -1) if of[j] < depth), None)
        last = next((j for j in range(k + 1, len(of)) if of[j] <= depth), len(of))
        out.append((parent, 0 if parent is None else out[parent][1] + 1, k + 1, last))
    return out


def test_nested_sets_are_brute_force(spark):
    depths = random_depths()
    got = {(r.doc_id, r.node_id): (r.parent_id, r.level, r["first"], r["last"]) for r in structure.nested_sets(spark.createDataFrame(some_sections(depths), SECTIONS)).collect()}
    want = {(d, f"{k:04d}"): (None if p is None else f"{p + 1:04d}", level, first, last) for d, of in depths.items() for k, (p, level, first, last) in enumerate(plain_tree(of), 1)}
    assert got == want
    assert structure.nested_sets(spark.createDataFrame([], SECTIONS)).count() == 0


def test_trees_are_nested_objects(spark):
    depths = {k: v for k, v in random_depths().items() if k is not None}
    rows = some_sections(depths)
    s = spark.createDataFrame(rows, SECTIONS)
    got = {r.doc_id: json.loads(r.tree_json) for r in structure.tree_json(s, structure.nested_sets(s)).collect()}
    for d, of in depths.items():
        own = [{"node_id": r[1], "title": r[3] or "", "start_page": r[4], "end_page": r[5], "summary": r[6] or "", "children": []} for r in rows if r[0] == d]
        roots = []
        for node, (parent, *_) in zip(own, plain_tree(of), strict=True):
            (roots if parent is None else own[parent]["children"]).append(node)
        assert got[d] == roots


def test_texts_of_subtrees(spark):
    depths = {k: v for k, v in random_depths().items() if k is not None}
    rng = random.Random(4)
    text = {(d, k): f"text {d} {k}" for d, of in depths.items() for k in range(len(of)) if rng.random() < 0.4}
    s = spark.createDataFrame(some_sections(depths), SECTIONS)
    texts = spark.createDataFrame([(d, f"{k + 1:04d}", t) for (d, k), t in text.items()] + [(1, "0001", ""), (7, "9999", "no such section")], "doc_id long, node_id string, text string")
    got = {(r.doc_id, r.node_id): r.text for r in structure.subtree_text(structure.nested_sets(s), texts).collect()}
    want = {}
    for d, of in depths.items():
        for k, (_, _, first, last) in enumerate(plain_tree(of)):
            below = [text[d, j] for j in range(first, last) if (d, j) in text]
            if (d, k) in text or below:
                want[d, f"{k + 1:04d}"] = text.get((d, k)) or "\n\n---\n\n".join(below)
    assert got == want


def batch(spark, title, sections):
    docs = spark.createDataFrame([(d, title, f"{d}.md", 3, None) for d in sorted({s[0] for s in sections})], "doc_id long, title string, filename string, page_count int, ingested_at date")
    s = spark.createDataFrame(sections, SECTIONS)
    return structure.document_nodes(docs, structure.tree_json(s, structure.nested_sets(s))), structure.section_nodes(s)


def test_a_known_document_changes_its_tree_alone(spark):
    first = batch(spark, "One", [(1, "0001", 0, "A", 1, 2, None), (1, "0002", 1, "B", 2, 2, None)])
    second = batch(spark, "Two", [(1, "0001", 0, "A again", 9, 9, "new"), (1, "0003", 1, "C", 3, 3, None), (2, "0001", 0, "D", 1, 1, None)])
    once = structure.store_documents(None, *first)
    twice = structure.store_documents(once[:2], *second)
    again = structure.store_documents(twice[:2], *second)
    docs, secs, edges = ({r[0] if df is not twice[2] else r.subj: r for r in df.collect()} for df in twice)
    assert {k: (r.title, r.canonical_name, r.filename) for k, r in docs.items()} == {"1": ("One", "one", "1.md"), "2": ("Two", "two", "2.md")}
    assert [n["title"] for n in json.loads(docs["1"].tree_json)] == ["A again"] and json.loads(docs["1"].tree_json)[0]["children"][0]["node_id"] == "0003"
    assert {k: (r.title, r.start_page, r.summary) for k, r in secs.items()} == {"1:0001": ("A", 1, ""), "1:0002": ("B", 2, ""), "1:0003": ("C", 3, ""), "2:0001": ("D", 1, "")}
    assert {(k, r.predicate, r.obj) for k, r in edges.items()} == {("1:0001", "BELONGS_TO", "1"), ("1:0002", "BELONGS_TO", "1"), ("1:0003", "BELONGS_TO", "1"), ("2:0001", "BELONGS_TO", "2")}
    assert [sorted(map(str, df.collect())) for df in again] == [sorted(map(str, df.collect())) for df in twice]


NODES = "label string, canonical_name string, confidence double, verified boolean"
EDGES = "subj_label string, subj string, predicate string, obj_label string, obj string, confidence double, verified boolean"


def test_health_leaves_structure_out(spark):
    nodes = spark.createDataFrame([("PART", "a", 0.9, True), ("PART", "b", 0.5, None), ("BRAND", "alone", None, None), ("Document", "1", None, None), ("Section", "1:1", 0.1, False), ("Section", "1:2", 0.1, False)], NODES)
    edges = spark.createDataFrame([("Section", "1:1", "BELONGS_TO", "Document", "1", 0.1, False), ("PART", "b", "EXTRACTED_FROM", "Section", "1:1", 0.1, False), ("PART", "a", "LIKES", "PART", "b", 0.5, None)], EDGES)
    types = spark.createDataFrame([("PART",), ("Section",), ("WORD",)], "type_name string")
    r = audit.graph_health(nodes, edges, types).first()
    assert (r.n_nodes, r.n_edges, r.n_entities, r.n_facts, r.n_orphans) == (6, 3, 3, 1, 1)
    assert (r.avg_confidence, r.low_nodes, r.low_edges, r.unverified_nodes, r.unverified_edges, r.density) == (0.7, 1, 1, 0, 0, 0.33)
    assert (r.unused_types, r.total_sections, r.covered_sections, r.document_coverage) == ("Section,WORD", 2, 1, 50.0)
    none = audit.graph_health(nodes.limit(0), edges.limit(0), types).first()
    assert (none.n_nodes, none.density, none.document_coverage, none.avg_confidence) == (0, 0.0, 0.0, 0.0)
    assert [r.canonical_name for r in merge.orphans(nodes.where(audit.domain("label")), edges).collect()] == ["alone"]


def test_provenance_and_links(spark):
    docs, secs, belongs = structure.store_documents(None, *batch(spark, "One", [(1, "0001", 0, "A", 1, 2, None), (1, "0002", 1, "B", 2, 2, None)]))
    nodes = spark.createDataFrame([("PART", "a", 0.9, True)], NODES)
    found = spark.createDataFrame([("PART", "a", "1:0002"), ("PART", "a", "1:0002"), ("PART", "a", "1:0009"), ("PART", "z", "1:0001")], "label string, canonical_name string, section_id string")
    links = structure.extracted_edges(found, nodes, secs)
    assert [tuple(r) for r in links.collect()] == [("PART", "a", "EXTRACTED_FROM", "Section", "1:0002")]
    got = structure.provenance(structure.layered_edges(spark.createDataFrame([("PART", "a", "LIKES", "PART", "b", 0.5, None)], EDGES), belongs, links), docs, secs)
    assert [tuple(r) for r in got.collect()] == [("PART", "a", "1:0002", "B", "One", "1.md")]
    every = structure.layered_nodes(nodes, docs, secs)
    assert {(r.label, r.canonical_name) for r in every.collect()} == {("PART", "a"), ("Document", "1"), ("Section", "1:0001"), ("Section", "1:0002")} and every.columns == nodes.columns


def test_files_are_routed_by_extension(spark, tmp_path):
    para = "One two three. " * 90
    held = {"a.md": f"# H\n\n{para}\n\n## I\n\nword", "b.txt": f"{para}\n\n{para}", "c.TEXT": "short", "d.html": "<p>one</p><script>x</script><p>two</p>", "e.htm": " ", "empty.md": "", "f.eml": "From: a@b.c\nSubject: s\nContent-Type: text/plain\n\nbody\n", "g.pdf": "%PDF", "h": "none", "i.tar.gz": "z"}
    rows = spark.createDataFrame(list(held.items()), "name string, text string").repartition(4)
    folder = f"file://{tmp_path}/in"
    assert formats.write_files(rows, folder) == len(held)
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xfe\x00")
    chunks, lost = formats.chunks(formats.files(spark, folder))
    got = {}
    for r in chunks.orderBy("doc_id", "page_no").collect():
        got.setdefault(r.doc_id.rsplit("/", 1)[1], (r.format, []))[1].append(r.text)
    one = lambda of: [x.text for x in of.orderBy("page_no").collect()]
    table = lambda name: spark.createDataFrame([(1, held[name])], "doc_id long, text string")
    assert got["a.md"] == ("markdown", one(D.chunk_rows(table("a.md"), D.markdown_chunks(F.col("text")))))
    assert got["b.txt"] == ("text", one(D.chunk_rows(table("b.txt"), D.paragraph_chunks(F.col("text"))))) and len(got["b.txt"][1]) == 2
    assert got["c.TEXT"] == ("text", ["short"]) and got["d.html"] == ("html", ["one\n\ntwo"]) and got["e.htm"] == ("html", [""])
    assert got["f.eml"] == ("mail", one(D.mail_chunks(table("f.eml").withColumnRenamed("text", "raw"))))
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in lost.collect()} == {"g.pdf": "unsupported type: pdf", "h": "unsupported type: none", "i.tar.gz": "unsupported type: gz", "bad.txt": "not UTF-8"}
    _, large = formats.chunks(formats.files(spark, folder, largest=10))
    assert {r.reason for r in large.collect()} >= {"too large"}


def test_files_of_apart_folders_are_read_once_and_not_shuffled(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    rows = spark.createDataFrame([(f"{k}.txt", f"text {k}") for k in range(200)], "name string, text string").repartition(3)
    formats.write_files(rows, folder)
    each = formats.folders(folder)
    assert len(each) == 3
    found = formats.files(spark, each, tasks=2)
    read = formats.chunked(found)
    assert found.rdd.getNumPartitions() == 2 and "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path.rsplit("/", 1)[1], r.format, r.reason, tuple(r.parts)) for r in read.collect()) == sorted((f"{k}.txt", "text", None, (f"text {k}",)) for k in range(200))
    for twice in ([folder, each[0]], [each[0], each[0] + "/", *each], f"{folder}/*", [f"{folder}/*", folder]):
        assert formats.files(spark, twice).count() == 200


@pytest.mark.parametrize("layer", [True, False])
def test_edges_merge_before_or_after_their_ends_are_looked_up(spark, layer):
    e = spark.createDataFrame([("P", "a", "R", "P", "b", k, k / 10, True, "d", "2024-01-01") for k in range(3)] + [("P", "a", "R", "P", "gone", 4, 0.4, True, "d", "2024-01-02")], "subj_label string, subj string, predicate string, obj_label string, obj string, ord long, confidence double, verified boolean, source_doc string, seen string")
    n = spark.createDataFrame([("P", "a", 1.0, True), ("P", "b", 1.0, True)], NODES)
    got = merge.resolve_ends(merge.merge_edges(None, e), n) if layer else merge.merge_edges(None, merge.resolve_ends(e, n))
    assert [(r.obj, r.confidence) for r in got.collect()] == [("b", 0.0)]
