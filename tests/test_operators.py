"""Operators on small frames: merges of nodes and sources, layouts, aliases, hybrid hits, review items, scans."""

import datetime
import itertools
import os

import duckdb
from pyspark.sql import functions as F

from loomgraph.operators import audit, layouts, logs, merge, ontology, pipe_tables, resolve, search
from loomgraph.plans import demo
from loomgraph.plans.queries import ORACLES, QUERIES
from loomgraph.sources import documents as D

MENTION = "label string, canonical_name string, ord long, text string, confidence double, verified boolean, source_doc string, seen string, properties string, source_text string"


def mentions(spark, n):
    rows = [("P", "hot" if i % 3 else f"n{i}", i, f"T{i}", (i % 11) / 10, None if i % 2 else i % 4 == 0, f"d, {i % 7}", f"2024-01-{i % 28 + 1:02}", None if i % 5 else f'{{"k": {i}}}', f"s{i}") for i in range(n)]
    return spark.createDataFrame(rows, MENTION)


def test_node_fields_are_merge_nodes_without_sources(spark):
    m = mentions(spark, 300).repartition(5)
    one = merge.merge_nodes(None, m).drop("source_docs")
    two = merge.merge_node_fields(merge.merge_node_fields(None, m.where("ord < 120")), m.where("ord >= 120"))
    assert sorted(map(str, two.select(*one.columns).collect())) == sorted(map(str, one.collect()))
    assert {r.canonical_name: r.n_mentions for r in two.where("canonical_name = 'hot'").collect()} == {"hot": 200}
    first = two.where("canonical_name = 'hot'").first()
    assert (first.text, first.name, first.source_text, first.properties) == ("T1", "T299", "s1", None)


def test_appended_sources_keep_order_over_pieces_and_batches(spark, monkeypatch):
    monkeypatch.setattr(merge, "PIECE", 7)
    m = mentions(spark, 100).repartition(4)
    want = ", ".join(f"d, {i % 7}" for i in range(100) if i % 3)
    old = merge.merge_nodes(None, m.where("ord < 41"))
    for got in (merge.merge_nodes(None, m), merge.merge_nodes(old, m.where("ord >= 41"))):
        assert got.where("canonical_name = 'hot'").first().source_docs == want


def test_sources_are_a_table(spark):
    m = mentions(spark, 90)
    both = merge.merge_sources(merge.merge_sources(None, m.where("ord < 50")), m.where("ord >= 50"))
    assert sorted(both.collect()) == sorted(merge.merge_sources(None, m).collect())
    assert both.agg(F.sum("n")).first()[0] == 90
    assert merge.merge_sources(None, m.limit(0)).count() == 0


def test_alike_layouts_are_those_of_all_pairs(spark):
    pages = []
    for i in range(60):
        tags = [f"t{(j * 7 + i % 4) % 13}" if (i * j) % 17 else f"x{i % 9}" for j in range(3 + i % 25)]
        pages.append((i, "".join(f"<{t}>word" for t in tags)))
    pages += [(100, None), (101, ""), (102, "no tags"), (103, "<p>"), (104, "<p>")]
    found = layouts.layouts(spark.createDataFrame(pages, "page_id long, html string"))
    sets = {r.first_page: set(r.runs) for r in found.collect()}
    assert 100 not in sets and 102 not in sets and sets[103] == {"p"} and 104 not in sets
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert want and {(r.a, r.b) for r in layouts.alike(found).collect()} == want


def test_aliases_and_thresholds(spark):
    names = ["aluzink (az) - c4", "aluzink - c4", "aluzink [az], c4", "zinc", "(only)", "polydimethylsiloxane", "polydimethyl siloxanes"]
    rows = [(i, "M", n, 0.5, "d") for i, n in enumerate(names)] + [(9, "X", "aluzink", 0.5, "d")]
    g = resolve.exact_groups(spark.createDataFrame(rows, "ord long, label string, text string, confidence double, source_doc string"))
    assert {(r.a, r.b) for r in resolve.alias_pairs(g).collect()} == {(names[0], names[1]), (names[0], names[2])}
    near = lambda t: {(r.a, r.b) for r in resolve.typed_pairs(g, t).where("why = 'ratio'").collect()}
    assert (names[5], names[6]) in near({"M": 0.9}) and (names[5], names[6]) not in near({"M": 0.99, "X": 0.5})
    assert near({}) == {(r.a, r.b) for r in resolve.same_pairs(g).where("why = 'ratio'").collect()}


def test_edge_templates(spark):
    rows = spark.createDataFrame([(1, 0, ["Part Name", "Maker"], ["bolt", ""]), (1, 1, ["Part Name", "Maker"], ["nut", "acme"])], "doc_id long, row_index int, columns array<string>, cells array<string>")
    got = pipe_tables.map_row_edges(pipe_tables.row_properties(rows), "{part_name}", [("made by", "Maker"), ("IS_A", "part")]).collect()
    assert {tuple(r) for r in got} == {(1, 0, "bolt", "IS_A", "part"), (1, 1, "nut", "MADE_BY", "acme"), (1, 1, "nut", "IS_A", "part")}


def test_hybrid_and_context(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "q int, v int, r int")
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2), (2, 5, 1)], "q int, v int, r int")
    assert {tuple(r) for r in search.hybrid(a, b, ["q"], "v").select("q", "v", "rank", "both_ways").collect()} == {(1, 5, 1, False), (1, 6, 2, True), (1, 7, 3, False), (2, 5, 1, False)}
    found = spark.createDataFrame([(1, "zinc", None), (1, "iron", "kept"), (2, "tin", ""), (3, "tin", None)], "doc_id int, canonical_name string, source_text string")
    texts = spark.createDataFrame([(1, "x" * 50 + " Zinc " + "y" * 50), (2, "q" * 400)], "doc_id int, text string")
    got = {(r.doc_id, r.canonical_name): r.context for r in search.provenance_context(found, texts, "doc_id", around=3).collect()}
    assert got == {(1, "zinc"): "...xx >>>Zinc<<< yy...", (1, "iron"): "kept", (2, "tin"): "q" * 300, (3, "tin"): None}


def test_review_context(spark):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    n = spark.createDataFrame([("a", None), ("b", "own"), ("c", None), ("e", None)], "canonical_name string, source_text string")
    chats = spark.createDataFrame([(1, "a", "old", "x" * 30, day(2)), (2, "a", "new", "y" * 30, day(9, 5)), (3, "b", "lb", "z" * 30, day(4, 3)), (4, "c", "lc", "short", day(1))], "id long, item_name string, action_label string, item_detail string, created_at timestamp")
    ep = spark.createDataFrame([(1, "q1", "a1", 1, 0, day(4, 1)), (2, "q2", "a2", 0, 0, day(4, 2)), (3, "q3", "a3", 0, 2, day(4, 4)), (4, "q4", "a4", 1, 1, day(9, 6))], "id long, question string, answer string, entities_added int, rels_added int, created_at timestamp")
    got = {r[0]: tuple(r)[1:] for r in logs.review_context(n, chats, ep).collect()}
    assert got == {"a": ("y" * 30, "new", "q3", "a3"), "b": ("own", "lb", "q1", "a1"), "c": (None, "lc", None, None), "e": (None, None, None, None)}
    assert logs.review_context(n, chats.limit(0), ep.limit(0)).count() == 4


def test_properties_and_coverage(spark):
    n = spark.createDataFrame([("L", "a", "A", '{"z": 1, "y": ""}'), ("L", "b", None, "no json"), ("L", "c", "", "{}")], "label string, canonical_name string, name string, props string")
    assert {(r.canonical_name, r.k, r.v) for r in audit.properties(n, ["name"], ["props"]).collect()} >= {("a", "name", "A"), ("a", "z", "1")}
    assert not [r for r in audit.properties(n, ["name"], ["props"]).collect() if r.canonical_name == "c"]
    s = spark.createDataFrame([("1",), ("2",), ("3",)], "section_id string")
    links = spark.createDataFrame([("1",), ("1",), ("9",)], "section_id string")
    assert tuple(audit.section_coverage(s, links).first()) == (3, 1, 33.3)
    assert tuple(audit.section_coverage(s.limit(0), links).first()) == (0, 0, 0.0)


def test_scanned_paths(spark, tmp_path):
    for name in ("a.md", "b.MD", "c.txt", "sub/d.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    names = lambda paths: sorted(r.path.rsplit("/", 1)[1] for r in D.scan_files(spark, paths, ["md"]).select("path").collect())
    assert names(str(tmp_path)) == ["a.md", "b.MD", "d.md"]
    assert names([str(tmp_path), f"{tmp_path}/*.md", f"{tmp_path}/sub/d.md"]) == ["a.md", "b.MD", "d.md"]
    assert names([f"{tmp_path}/sub/d.md"]) == ["d.md"]


def test_typed_records_keep_types_and_places(spark):
    rows = [
        (1, '[{"text": "a", "ok": true, "p": {"n": 3, "deep": {"x": "y"}}}, 7, {"text": 5, "ok": "perhaps"}]'),
        (2, '{"entities": "none", "items": [{"text": "b", "p": {"n": 2.5}}]}'),
        (3, '{"text": "c", "p": {"n": null}}'),
        (4, "not json"),
        (5, None),
        (6, "[]"),
        (7, "12"),
        (8, '{"entities": []}'),
    ]
    fields = {"text": ("$.text", "string"), "ok": ("$.ok", "boolean"), "n": ("$.p.n", "double"), "x": ("$.p.deep.x", "string"), "deep": ("$.p.deep", "variant")}
    got = ontology.typed_records(spark.createDataFrame(rows, "id int, json string"), ["entities", "items"], fields)
    assert dict(got.dtypes)["record"] == "variant" and dict(got.dtypes)["deep"] == "variant"
    out = sorted(tuple(r) for r in got.select("id", "at", "text", "ok", "n", "x", F.schema_of_variant("record").alias("kind")).collect())
    assert [r[:6] for r in out] == [(1, 0, "a", True, 3.0, "y"), (1, 2, "5", None, None, None), (2, 0, "b", None, 2.5, None), (3, 0, "c", None, None, None)]
    assert "n: BIGINT" in out[0][6] and "n: DECIMAL" in out[2][6] and "text: BIGINT" in out[1][6]
    assert ontology.typed_records(spark.createDataFrame([], "id int, json string"), ["entities"], fields).count() == 0


def test_edges_of_lines_are_merged_by_keys_alike(spark):
    """What merge_edges and resolve_ends make of all mentions, and no exchange of the lines holds a part's name."""
    sf = "/root/testdata/sf0.001"
    want = merge.resolve_ends(merge.merge_edges(None, merge.keyed_edges(demo.edge_mentions(spark, sf))), demo.nodes(spark, sf))
    got = demo.merged_edges(spark, sf).select(*want.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    plan = demo._line_edges(spark, sf, demo.nodes(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [l_" not in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(l_partkey" in x and "obj" in x]


def test_long_keys_meet_on_long_ends(spark):
    """Numbers that end alike are no candidates: each key of sixteen characters meets the one name that holds it."""
    n = spark.range(500).selectExpr("'X' as label", "format_string('name#%09d', id * 1000 + 7) as canonical_name", "0.5D as confidence")
    q = n.selectExpr("canonical_name as qid", "canonical_name as term")
    candidates = search.contains_join(n, q.withColumn("block", search.ending(F.col("term"))), ["canonical_name"], F.lit(True))
    assert candidates.count() == 500
    found = search.find(n, q, ["canonical_name"])
    assert found.where("qid = canonical_name").count() == found.count() == 500
    odd = spark.createDataFrame([("X", "asia minor", 0.1), ("X", "as", 0.2), ("X", "a", None)], "label string, canonical_name string, confidence double")
    asked = spark.createDataFrame([("1", "asia"), ("2", "as"), ("3", "a"), ("4", "sia minor"), ("5", "zz"), ("6", "")], "qid string, term string")
    rows = {(r.qid, r.canonical_name) for r in search.find(odd, asked, ["canonical_name"]).collect()}
    assert rows == {("1", "asia minor"), ("2", "as"), ("2", "asia minor"), ("3", "a"), ("3", "as"), ("3", "asia minor"), ("4", "asia minor")}


def test_orphans_and_paths_shuffle_little(spark, tmp_path):
    """Ends are distinct before they are shuffled and met once; no hash of an edge is shuffled with it."""
    e = spark.createDataFrame([("A", "a", "P", "B", "b"), ("A", "a", "Q", "B", "b"), ("B", "b", "P", "C", "c")], merge.EDGE_KEY)
    e.write.parquet(f"{tmp_path}/e")
    e, n = spark.read.parquet(f"{tmp_path}/e"), spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("C", "a")], merge.NODE_KEY)
    assert {tuple(r) for r in merge.orphans(n, e).collect()} == {("C", "a")}
    left = merge.delete_orphans(n, e)
    assert {tuple(r) for r in left.collect()} == {("A", "a"), ("B", "b"), ("C", "c")}
    assert "LeftAnti" not in left._jdf.queryExecution().executedPlan().toString()
    found = search.paths(e, n.where("label = 'A'"), 2)
    assert sorted(tuple(r) for r in found.select("predicates", "names").collect()) == [("P", "a>b"), ("P>P", "a>b>c"), ("P>Q", "a>b>a"), ("Q", "a>b"), ("Q>P", "a>b>a"), ("Q>P", "a>b>c")]


def test_suppliers_of_one_name_are_asked_for_once(spark, tmp_path):
    """As the SQL has it: a name that three suppliers have is one name, whose edges are given once."""
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    for t in os.listdir(sf):
        if t != "supplier.parquet":
            os.symlink(f"{sf}/{t}", tmp_path / t)
    con = duckdb.connect()
    con.execute(f"copy (select s_suppkey + 100000 * k as s_suppkey, * exclude (s_suppkey, k) from '{sf}/supplier.parquet', range(3) r(k)) to '{tmp_path}/supplier.parquet' (format parquet)")
    for t in demo.TABLES:
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = [tuple(r) for r in QUERIES["join6_related"](spark, str(tmp_path)).collect()]
    want = con.execute(ORACLES["join6_related"]).fetchall()
    assert sorted(got) == sorted(want) and want
