"""Batches that run again change nothing; results do not depend on partitions or order."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import logs, merge, search
from loomgraph.streaming import ingest
from loomgraph.streaming.buckets import Store

MENTIONS = "label string, canonical_name string, ord long, text string, confidence double, verified boolean, source_doc string, seen string"


def mentions(spark, n=60):
    rows = [("P", f"n{i % 7}", i, f"N{i % 7}", (i * 37 % 41) / 40, i % 3 == 0 if i % 5 else None, f"d{i % 4}", f"2024-01-{1 + i % 28:02d}") for i in range(n)]
    return spark.createDataFrame(rows, MENTIONS)


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_batch_that_runs_again_is_skipped(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/nodes", merge.NODE_KEY, merge.merge_nodes, 4)
    m = mentions(spark)
    for k in (0, 1, 1, 0):
        store.merge(m.where(F.col("ord") % 2 == k), k)
    want = merge.merge_nodes(merge.merge_nodes(None, m.where("ord % 2 = 0")), m.where("ord % 2 = 1"))
    assert rows(store.read()) == rows(want)
    with pytest.raises(ValueError, match="before batch 5"):
        store.merge(m, 5)


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/nodes", merge.NODE_KEY, merge.merge_node_fields, 16)
    m = mentions(spark)
    assert store.merge(m, 0) == m.select(F.pmod(F.xxhash64(*merge.NODE_KEY), F.lit(16))).distinct().count()
    one = m.where("canonical_name = 'n3'")
    assert store.merge(one, 1) == 1
    data = tmp_path / "nodes" / "data"
    assert len(list((data / "batch=00000001").glob("bucket=*"))) == 1
    assert store.merge(one.limit(0), 2) == 0
    assert rows(store.read()) == rows(merge.merge_node_fields(merge.merge_node_fields(None, m), one))
    for k in range(3, 7):
        store.merge(one, k)
    assert store.batches() == [5, 6]  # older manifests are gone, and so are the buckets that only they named
    assert sorted(p.name for p in data.glob("batch=*/bucket=*/..") if p.exists()) and len(list(data.glob("batch=0000000[1-4]/bucket=*"))) == 0
    assert store.read(5).count() == store.read().count()
    with pytest.raises(ValueError, match="16 buckets"):
        Store(spark, f"file://{tmp_path}/nodes", merge.NODE_KEY, merge.merge_node_fields, 8).merge(m, 7)


def test_a_crash_before_the_manifest_is_made_good(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/nodes", merge.NODE_KEY, merge.merge_node_fields, 4)
    m = mentions(spark)
    store.merge(m.where("ord < 30"), 0)
    with monkeypatch.context() as broken:
        broken.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.merge(m.where("ord >= 30"), 1)
    assert rows(store.read()) == rows(merge.merge_node_fields(None, m.where("ord < 30")))  # readers see the batch before
    store.merge(m.where("ord >= 30"), 1)
    assert rows(store.read()) == rows(merge.merge_node_fields(None, m))


def test_windows_close_and_late_rows_are_rejected(spark, tmp_path):
    """Rows within the watermark count, later ones are in the rejects, each row is in one of both; state stays as large as the open windows."""
    schema = "event_id long, event_type string, value double, ts timestamp"
    row = lambda k, hour: (k, "ab"[k % 2], 1.0, datetime(2024, 1, 1) + timedelta(hours=hour))
    files = [[row(k, k / 4) for k in range(40)], [row(100, 8.5), row(101, 1.5), row(102, 12)], [row(103, 10.2), row(104, 30), row(105, 2)], [row(106, 500)]]
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    state = []
    for rows_ in files:
        spark.createDataFrame(rows_, schema).write.mode("append").parquet(f"{tmp_path}/in")
        counts = ingest.activity_counts(stream(), "ts")
        q = ingest.run_to_end(counts, f"{tmp_path}/counts", lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/counts/result/batch={i:08d}"))
        state.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        late = ingest.rejects(stream(), f"{tmp_path}/late", "ts")
    counted = {(r.started.isoformat(), r.event_type): r.n for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/counts/result").collect()}
    gone = {r.event_id for r in late.collect()}
    assert gone == {101, 105}
    want = Counter((r[3].replace(minute=0, second=0).isoformat(), r[1]) for f in files for r in f if r[0] not in gone and r[0] != 106)
    assert counted == want
    assert state[0] <= 8 and state[-1] == 1


def test_new_contents_forget(spark, tmp_path):
    schema = "doc_id long, text string, ts timestamp"
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    files = [[(1, "x", at(0)), (2, "x", at(0)), (3, None, at(0))], [(4, "x", at(0.5)), (5, "y", at(9))], [(6, "x", at(9)), (7, "y", at(9))]]
    for f in files:
        spark.createDataFrame(f, schema).write.mode("append").parquet(f"{tmp_path}/in")
        got = ingest.append(ingest.new_contents(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "1 hour"), f"{tmp_path}/out")
    texts = [r.text for r in got.collect()]
    assert Counter(texts) == {"x": 2, "y": 1, None: 1}  # x came again long after the watermark had passed it


def test_stream_of_files_is_the_batches_in_order(spark, tmp_path):
    m = mentions(spark)
    m.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in")
    got = ingest.ingest_mentions(stream, f"file://{tmp_path}/out")
    assert rows(got) == rows(merge.merge_nodes(None, m))


@pytest.mark.parametrize("n", [1, 8])
def test_merges_do_not_depend_on_partitions(spark, n):
    m = mentions(spark)
    assert rows(merge.merge_nodes(None, m.orderBy(F.desc("ord")).repartition(n))) == rows(merge.merge_nodes(None, m))


def test_search_finds_what_a_loop_finds(spark):
    names = [f"{a} {b} {i}" for i, (a, b) in enumerate((a, b) for a in ("steel", "al", "blue") for b in ("rod", "x", "widget set"))]
    nodes = spark.createDataFrame([("P", n, 0.5) for n in names], "label string, canonical_name string, confidence double")
    asked = [(1, "STEEL rod"), (2, "a"), (3, "widget steel"), (4, "zzz"), (5, "the x of al"), (6, "")]
    out = {}
    for r in search.find(nodes, spark.createDataFrame(asked, "qid int, term string"), ["canonical_name"], limit=100).collect():
        out.setdefault(r.qid, set()).add(r.canonical_name)
    assert out[1] == {n for n in names if "steel rod" in n}
    assert out[2] == {n for n in names if "a" in n}
    assert out[3] == {n for n in names if "steel" in n}  # no phrase has both words in that order; the second word is the next tier
    assert 4 not in out and 6 not in out
    assert out[5] == {n for n in names if "al" in n}


def test_paths_use_an_edge_once(spark):
    e = spark.createDataFrame([("A", "a", "P", "A", "b"), ("A", "b", "P", "A", "c"), ("A", "c", "P", "A", "a")], ", ".join(f"{c} string" for c in merge.EDGE_KEY))
    start = spark.createDataFrame([("A", "a")], "label string, canonical_name string")
    got = sorted((r.length, r.end) for r in search.paths(e, start, 4).collect())
    assert got == [(1, "b"), (1, "c"), (2, "b"), (2, "c"), (3, "a"), (3, "a")]
    with pytest.raises(ValueError, match="one hop"):
        search.paths(e, start, 0)


def test_as_of_takes_the_last_row_before(spark):
    left = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("j", 9, "z")], "k string, t int, n string")
    right = spark.createDataFrame([("k", 2, 10), ("k", 5, 11), ("k", 6, 12)], "k string, rt int, id int")
    got = {r.n: r.r_id for r in logs.as_of(left, right, "k", "t", "rt", "id").collect()}
    assert got == {"x": 11, "y": None, "z": None}


def test_empty_runs_count_anew_after_a_trigger(spark):
    steps = [("s", i, c == "e") for i, c in enumerate("eeeeeeeofeeof")] + [("t", 0, False)]
    got = {r.session_id: r.triggers for r in logs.empty_runs(spark.createDataFrame(steps, "session_id string, at int, empty boolean")).collect()}
    assert got == {"s": 2, "t": 0}


@pytest.mark.parametrize("cuts", [0, 1, 7, 127])
def test_as_of_is_brute_force(spark, cuts):
    """A key with half of all rows, equal times on both sides, null times and keys, and keys that only one side has."""
    rng = random.Random(9)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    time = lambda: rng.randrange(40) if rng.random() < 0.9 else None
    left = [(key(), time(), f"l{i}") for i in range(150)] + [("only", 3, "l-only")]
    right = [(key(), time(), f"r{i:03d}") for i in range(90)] + [("other", 3, "r-other")]
    got = logs.as_of(spark.createDataFrame(left, "k string, t int, x string"), spark.createDataFrame(right, "k string, u int, y string"), "k", "t", "u", "y", cuts)
    rank = lambda t: -1 if t is None else t
    want = {x: max(((rank(u), y) for rk, u, y in right if rk == k and rank(u) <= rank(t)), default=(None, None))[1] for k, t, x in left}
    assert {r.x: r.r_y for r in got.collect()} == want and got.count() == len(left)


def test_a_hot_key_is_spread_over_groups(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    at = logs._cut_times(rows.select(F.col("t").alias("__t")), "__t", 31)
    sizes = [b - a for a, b in zip([0, *at], [*at, 4000], strict=True)]
    assert len(at) == 31 and max(sizes) < 300
