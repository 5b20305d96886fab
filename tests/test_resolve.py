"""Resolution against plain loops: candidates, the same-entity test, leaders of chains and stars."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import resolve
from loomgraph.operators.components import components


def names(seed=1, n=160):
    """Names and copies of them with a few characters put in, taken out or changed; short ones, numbered ones, repeated letters."""
    rng = random.Random(seed)
    out = ["a", "ab", "abc", "aaaaaaaaaa", "aaaaaaaaaaa", "part 1", "part 2", "part", "x12 long name here", "long name here", "12", "13"]
    for _ in range(n):
        base = " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 6)))
        out.append(base)
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = [rng.choice("abcde 1")] * rng.randrange(2)
            out.append("".join(w).strip())
    return sorted({x for x in out if x})


def runs(x):
    return set(re.findall(r"[0-9]+", x))


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.95, 1.0])
def test_no_pair_of_the_ratio_is_lost(spark, threshold):
    every = names()
    got = {(r.a, r.b) for r in resolve.ratio_candidates(spark.createDataFrame([("L", x) for x in every], "label string, name string"), threshold).collect()}
    ratio = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
    want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if ratio(a, b) >= threshold and (not runs(a) or not runs(b) or runs(a) == runs(b))}
    assert want <= got and (want or threshold == 1.0)
    assert threshold < 0.9 or len(got) < 0.2 * len(every) ** 2 / 2


def test_candidates_grow_with_the_names(spark):
    """100,000 names of one label over sixteen letters, one in ten beside one that is like it: 21 candidates a name."""
    rng = spark.range(100_000).select(F.lit("L").alias("label"), F.concat(F.substring(F.sha2(F.concat((F.col("id") - (F.col("id") % 10 == 0).cast("int")).cast("string"), F.lit("s")), 256), 1, 24), F.when(F.col("id") % 10 == 0, "x").otherwise("")).alias("name"))
    letters = rng.select("label", F.translate("name", "0123456789", "ghijklmnop").alias("name"))
    assert 9_000 < resolve.ratio_candidates(letters).count() < 3_000_000


def plain_leaders(order, pairs):
    leader = {}
    for name in order:
        if leader.setdefault(name, name) == name:
            for a, b in pairs:
                if a == name:
                    leader.setdefault(b, name)
    return leader


def frames(spark, order, pairs):
    groups = spark.createDataFrame([("L", x, i) for i, x in enumerate(order)], "label string, canonical_name string, ord long")
    return groups, spark.createDataFrame([("L", *p) for p in pairs], "label string, a string, b string")


@pytest.mark.parametrize("limit", [200_000, 3, 0])
def test_leaders_are_those_of_a_loop(spark, limit):
    rng = random.Random(2)
    order = [f"n{i}" for i in range(60)]
    rng.shuffle(order)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)} | {(k, k + 1) for k in range(40, 50)})
    pairs = [(order[i], order[j]) for i, j in pairs]
    got = {r.canonical_name: r.leader for r in resolve.leaders(*frames(spark, order, pairs), component_pairs=limit).collect()}
    assert got == plain_leaders(order, pairs)


def test_a_long_chain_takes_a_bounded_number_of_jobs(spark):
    order = [f"n{i:05d}" for i in range(10_000)]
    groups, pairs = frames(spark, order, list(zip(order, order[1:], strict=False)))
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "leaders of a chain")
    got = {r.canonical_name: r.leader for r in resolve.leaders(groups, pairs).collect()}
    jobs = len(seen.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert got == {x: order[i - i % 2] for i, x in enumerate(order)}
    assert jobs < 400


def test_leaders_of_nothing(spark):
    groups, pairs = frames(spark, ["a", "b"], [])
    assert {(r.canonical_name, r.leader) for r in resolve.leaders(groups, pairs).collect()} == {("a", "a"), ("b", "b")}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_same_pairs_are_those_of_a_loop(spark):
    """The three reasons on all pairs: ratio with digits alike, containment, and equal codes."""
    every = names(3, 60) + ["pump", "pump housing", "housing of a pump", "big pump station 7", "abcd efgh", "bcd"]
    groups = spark.createDataFrame([("L", x, i, (x, 0.5)) for i, x in enumerate(every)], "label string, canonical_name string, ord long, best struct<text:string,confidence:double>")
    got = {(r.a, r.b) for r in resolve.same_pairs(groups).collect()}
    want = set()
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            x, y = runs(a), runs(b)
            short, long = sorted((a, b), key=len)
            inside = short != long and len(short) >= 4 and short in long and len(short) / len(long) >= 0.35
            if (SequenceMatcher(None, a, b).ratio() >= 0.9 and (not x or not y or x == y)) or inside:
                want.add((a, b))
    coded = {(r.a, r.b) for r in resolve.same_pairs(groups).where("why = 'code'").collect()}
    assert got - coded == want - coded and want <= got


def test_rules_send_no_runs_of_characters_through_the_driver(spark, tmp_path):
    """Runs of many names look small in their compressed file; broadcast, they filled the driver."""
    spark.range(2000).selectExpr("concat('New red bolt mark ', id) as name", "id as ord").write.parquet(f"{tmp_path}/o")
    objects = spark.read.parquet(f"{tmp_path}/o")
    subjects = spark.createDataFrame([("Red bolt", 1), ("red", 2), ("bolt", 3)], "name string, ord long")
    for rule, want in ((resolve.contains_rule, "red bolt"), (resolve.prefix_rule, None)):
        out = rule(subjects, objects, "part_of")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert not any("BroadcastHashJoin" in line and "Inner" in line for line in plan.splitlines())
        assert {(r.subj, r.n) for r in out.groupBy("subj").agg({"*": "count"}).toDF("subj", "n").collect()} == ({(want, 2000)} if want else set())


def test_names_taken_apart_are_not_sent_through_the_driver(spark, tmp_path):
    """Pieces of names look as small as the compressed file of the names; broadcast, they filled the driver."""
    spark.range(300).selectExpr("id as ord", "'PART' as label", "concat('red bolt of ', chr(97 + cast(id % 20 as int)), 'xyz') as text", "0.5D as confidence", "'d' as source_doc").write.parquet(f"{tmp_path}/m")
    groups = resolve.exact_groups(spark.read.parquet(f"{tmp_path}/m"))
    pairs = resolve.typed_pairs(groups, {"PART": 0.9})
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert pairs.count() == 20 * 19 / 2
