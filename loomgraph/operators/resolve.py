"""Entity resolution: exact groups, candidate pairs by blocking, the same-entity test, leader clusters and merged records.

Mentions have ord (first-seen order), text, label, confidence, source_doc. Candidates come from equi-joins on blocks that lose
no pair which the test could accept; the sequence ratio, which Spark lacks, is computed in Arrow batches on pairs that are left.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgraph.functions.text import abbreviation, canonical_name, digit_runs
from loomgraph.operators.components import components
from loomgraph.sources.folders import shared_folder

THRESHOLD = 0.9
LEAST_CONTAINED, CONTAINED_SHARE = 4, 0.35


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matched characters over all characters, matched in ordered blocks; not symmetric; null if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def exact_groups(mentions: DataFrame) -> DataFrame:
    """One row for each (label, canonical name): ord of the first, n, the best record (greatest confidence, first on ties), all sources,
    and the first code that a mention has, with its ord."""
    m = mentions.withColumn("canonical_name", canonical_name(F.col("text")))
    best = F.max_by(F.struct("text", "confidence"), F.struct(F.col("confidence"), (-F.col("ord")).alias("o")))
    found = abbreviation(F.col("text"))
    code = F.min(F.when(found.isNotNull(), F.struct("ord", found.alias("code"))))
    return m.groupBy("label", "canonical_name").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), best.alias("best"), F.array_sort(F.collect_set("source_doc")).alias("docs"), code.alias("code"))


def _met_by_key(taken_apart: DataFrame) -> DataFrame:
    """Rows that were made of others, for a join: many more than the size of their files tells, so the planner must not send them to
    every executor by way of the driver."""
    return taken_apart.hint("merge")


def containment_pairs(names: DataFrame) -> DataFrame:
    """(label, a, b) where a is in b, has 4 characters at least and 0.35 of b's length: blocked on that run of four characters of
    a which the fewest names have, so that a beginning which many names share is no block."""
    gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - LEAST_CONTAINED + 1), lambda i: F.substring(c, i, F.lit(LEAST_CONTAINED))))
    long = names.where(F.length("name") >= LEAST_CONTAINED)
    b = long.select("label", F.col("name").alias("b"), F.explode(gram(F.col("name"))).alias("g"))
    held = b.groupBy("label", "g").agg(F.count("*").alias("n"))
    a = _met_by_key(b).join(held, ["label", "g"]).groupBy("label", F.col("b").alias("a")).agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    hit = a.join(_met_by_key(b), ["label", "g"]).where((F.col("a") != F.col("b")) & F.contains("b", "a") & (F.length("a") / F.length("b") >= CONTAINED_SHARE))
    return hit.select("label", "a", "b").distinct()


def ratio_candidates(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(label, a, b), a the lesser, that may have a ratio of at least the threshold, and whose sets of digit runs are equal unless
    one of them is empty.

    A pair above it, a no longer than b, differs by at most k = 2 |a| (1 - t) / t inserts and deletes, so one of k + 1 pieces of a
    stands in b. All places where it is to be sought follow from the two lengths alone: a name asks, for each length that its
    shorter partners can have, for the pieces' texts there, so names meet on (label, length, number of the piece, text, digits)
    and on nothing wider. A piece shifted by more than there are pieces before it (or, seen from the end, after it) need not be
    sought: as many changes on that side leave another piece whole on the other. Numbered names that are alike but for their
    numbers do not meet.
    """
    own = F.array_join(digit_runs(F.col("name")), ",")
    base = names.select("label", "name", F.length("name").alias("n"), own.alias("own"))
    allowed = lambda n: F.floor(2 * n * F.lit((1 - threshold) / threshold) + 1e-9).cast("int")
    start = lambda i: F.floor(F.col("la") * i / (F.col("k") + 1)).cast("int")
    piece = {"at": start(F.col("i")), "w": start(F.col("i") + 1) - start(F.col("i"))}
    a = base.withColumns({"la": F.col("n"), "k": allowed(F.col("n"))}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumns(piece).where("w > 0")
    # equal digits meet on "=..."; a without digits meets b with some on "n", and the other way round on "x"
    digits = lambda none, some: F.explode(F.array(F.concat(F.lit("="), "own"), F.when(F.col("own") == "", none).otherwise(some)))
    a = a.select("label", F.col("name").alias("a"), "la", "i", F.substring("name", F.col("at") + 1, F.col("w")).alias("piece"), digits("n", "x").alias("d"))
    least = F.greatest(F.ceil(F.col("n") * F.lit(threshold / (2 - threshold)) - 1e-9).cast("int"), F.lit(1))
    b = base.where("n > 0").withColumn("la", F.explode(F.sequence(least, F.col("n")))).withColumn("k", allowed(F.col("la"))).where("n - la <= k")
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumns(piece).where("w > 0")
    longer = F.col("n") - F.col("la")
    low = F.greatest(F.col("at") - F.col("i"), F.col("at") + longer - (F.col("k") - F.col("i")), F.lit(0))
    high = F.least(F.col("at") + F.col("i"), F.col("at") + longer + (F.col("k") - F.col("i")), F.col("n") - F.col("w"))
    b = b.withColumns({"low": low, "high": high}).where("low <= high").withColumn("bt", F.explode(F.sequence("low", "high")))
    b = b.select("label", F.col("name").alias("b"), "la", "i", F.substring("name", F.col("bt") + 1, F.col("w")).alias("piece"), digits("x", "n").alias("d"))
    hit = _met_by_key(a).join(b, ["label", "la", "i", "piece", "d"]).where("a != b")
    return hit.select("label", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().select("label", F.col("x").alias("a"), F.col("y").alias("b"))


def same_pairs(groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(label, a, b) of canonical names that are the same entity, a seen before b; `why` is ratio, contained or code."""
    names = groups.select("label", F.col("canonical_name").alias("name"), "ord", F.col("best.text").alias("text"))
    order = _met_by_key(names.select("label", "name", "ord"))
    both = lambda p: p.join(order.select("label", F.col("name").alias("a"), F.col("ord").alias("oa")), ["label", "a"]).join(order.select("label", F.col("name").alias("b"), F.col("ord").alias("ob")), ["label", "b"]).select("label", F.when(F.col("oa") < F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("oa") < F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("b"))
    digits = (F.size(digit_runs(F.col("a"))) == 0) | (F.size(digit_runs(F.col("b"))) == 0) | (digit_runs(F.col("a")) == digit_runs(F.col("b")))
    ratio = both(ratio_candidates(names, threshold)).where(digits).where(similarity_ratio("a", "b") >= threshold).withColumn("why", F.lit("ratio"))
    inside = both(containment_pairs(names)).withColumn("why", F.lit("contained"))
    code = names.select("label", "name", abbreviation(F.col("name")).alias("code")).where("code is not null")
    coded = both(_met_by_key(code.withColumnRenamed("name", "a")).join(code.withColumnRenamed("name", "b"), ["label", "code"]).where("a < b").select("label", "a", "b")).withColumn("why", F.lit("code"))
    return ratio.unionByName(inside).unionByName(coded).groupBy("label", "a", "b").agg(F.max("why").alias("why"))


def typed_pairs(groups: DataFrame, thresholds: dict[str, float], default: float = THRESHOLD) -> DataFrame:
    """same_pairs with the threshold of each label, the default for others; labels of one threshold are one job. Groups are made once."""
    shared_folder(groups.sparkSession)
    groups, out = groups.checkpoint(), None
    for t in sorted({default, *thresholds.values()}):
        some = [label for label, x in thresholds.items() if x == t]
        hit = F.col("label").isin(some)
        p = same_pairs(groups.where(hit | ~F.col("label").isin(list(thresholds)) if t == default else hit), t)
        out = p if out is None else out.unionByName(p)
    return out


def alias_pairs(groups: DataFrame) -> DataFrame:
    """(label, a, b, why) of names that are one but for what stands in brackets and for white space, dashes and commas: each meets the first
    seen of them (which leads them), so a much used name gives as many rows as it has forms."""
    bare = F.regexp_replace(F.regexp_replace("canonical_name", r"\([^()]*\)|\[[^\[\]]*\]", " "), r"[\s,\-\u2013\u2014]+", " ")
    g = groups.select("label", "canonical_name", "ord", F.trim(bare).alias("alias")).where("alias != ''")
    first = g.groupBy("label", "alias").agg(F.min_by("canonical_name", F.struct("ord", "canonical_name")).alias("a"))
    return g.join(first, ["label", "alias"]).where("canonical_name != a").select("label", "a", F.col("canonical_name").alias("b"), F.lit("alias").alias("why"))


#: Pairs of a component that one task decides.
COMPONENT_PAIRS = 200_000


def _led(pairs: pd.DataFrame) -> pd.DataFrame:
    """A component's pairs (a, oa, b, ob) decided in first-seen order."""
    later: dict[str, list[str]] = {}
    first: dict[str, int] = {}
    for a, oa, b, ob in zip(pairs["a"], pairs["oa"], pairs["b"], pairs["ob"], strict=True):
        later.setdefault(a, []).append(b)
        first[a], first[b] = oa, ob
    leader: dict[str, str] = {}
    for name in sorted(first, key=lambda x: (first[x], x)):
        if leader.setdefault(name, name) == name:
            for b in later.get(name, []):
                leader.setdefault(b, name)
    return pd.DataFrame({"label": [pairs["label"].iat[0]] * len(leader), "canonical_name": list(leader), "leader": list(leader.values())})


def leaders(groups: DataFrame, pairs: DataFrame, component_pairs: int = COMPONENT_PAIRS) -> DataFrame:
    """(label, canonical_name, leader): in first-seen order a leader takes every later match that is still free; members are compared to it alone.

    Names of different components of the pairs do not touch each other, so a component of up to component_pairs pairs is decided in
    one pass by one task, however long its chains; larger ones are decided by rounds over all of them. A name without a pair
    leads itself.
    """
    shared_folder(groups.sparkSession)
    order = groups.select("label", F.col("canonical_name").alias("name"), "ord")
    e = pairs.join(order.select("label", F.col("name").alias("a"), F.col("ord").alias("oa")), ["label", "a"]).join(order.select("label", F.col("name").alias("b"), F.col("ord").alias("ob")), ["label", "b"]).select("label", "a", "oa", "b", "ob").checkpoint()
    key = lambda c: F.concat_ws("\0", "label", c)
    roots = components(e.select(key("a").alias("u"), key("b").alias("v")))
    e = e.withColumn("node", key("a")).join(roots, "node").drop("node").checkpoint()
    sizes = e.groupBy("root").agg(F.count("*").alias("n"))
    small = e.join(sizes.where(F.col("n") <= component_pairs).select("root"), "root")
    found = small.groupBy("root").applyInPandas(_led, "label string, canonical_name string, leader string")
    large = e.join(sizes.where(F.col("n") > component_pairs).select("root"), "root").drop("root")
    if large.take(1):
        names = large.select("label", F.col("a").alias("name")).unionByName(large.select("label", F.col("b").alias("name"))).distinct()
        found = found.unionByName(_by_rounds(order.join(names, ["label", "name"]), large.checkpoint()))
    paired = e.select("label", F.explode(F.array("a", "b")).alias("name")).distinct()
    alone = order.join(paired, ["label", "name"], "left_anti").select("label", F.col("name").alias("canonical_name"), F.col("name").alias("leader"))
    return found.unionByName(alone)


def _by_rounds(order: DataFrame, e: DataFrame) -> DataFrame:
    """Each round decides all names that have no undecided earlier match: those without an earlier leader lead, and followers take
    their earliest leader. A round is two joins on the pairs; checkpoints cut the plan. Every round decides the first open name
    at least, so it ends."""
    state = order.select("label", "name", "ord", F.lit(None).cast("string").alias("leader"))
    loose = e.select("label", F.col("b").alias("name")).distinct()
    state = state.join(loose.withColumn("later", F.lit(True)), ["label", "name"], "left").withColumn("leader", F.when(F.col("later").isNull(), F.col("name"))).drop("later").checkpoint()
    while True:
        seen = e.join(state.select("label", F.col("name").alias("a"), F.col("leader").alias("la")), ["label", "a"])
        verdict = seen.groupBy("label", F.col("b").alias("name")).agg(
            F.min(F.when(F.col("la").isNull(), F.col("oa"))).alias("open"),
            F.min(F.when(F.col("la") == F.col("a"), F.struct("oa", "a"))).alias("first"),
        )
        after = state.join(verdict, ["label", "name"], "left")
        ready = F.col("leader").isNull() & (F.col("open").isNull() | (F.col("first.oa") < F.col("open")))
        after = after.withColumn("leader", F.when(ready, F.coalesce(F.col("first.a"), F.col("name"))).otherwise(F.col("leader"))).select("label", "name", "ord", "leader").checkpoint()
        state = after
        if not state.where("leader is null").take(1):
            break
    return state.select("label", F.col("name").alias("canonical_name"), "leader")


def resolved(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """One record for each leader: the best text and confidence, number of names, all sources; several names of which one has a code take the code, upper-cased, as their name."""
    rows = groups.join(clusters, ["label", "canonical_name"])
    best = F.max_by(F.struct("best.text", "best.confidence"), F.struct(F.col("best.confidence"), (-F.col("ord")).alias("o")))
    code = F.min("code")["code"]
    out = rows.groupBy("label", "leader").agg(best.alias("b"), F.count("*").alias("n_names"), F.sum("n").alias("n_mentions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"), code.alias("code"))
    name = F.when((F.col("n_names") > 1) & F.col("code").isNotNull(), F.upper("code")).otherwise(canonical_name(F.col("b.text")))
    return out.select("label", "leader", name.alias("canonical_name"), F.col("b.text").alias("text"), F.col("b.confidence").alias("confidence"), "n_names", "n_mentions", F.array_join("docs", ", ").alias("source_docs"))


def lookup(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """names (qid, raw) to the mention of that text: by lower-cased text, else by canonical name; the last one of equal keys."""
    last = lambda key: mentions.groupBy("label", key.alias("key")).agg(F.max_by("text", "ord").alias("found"))
    by_text, by_name = last(F.lower("text")), last(canonical_name(F.col("text")))
    q = names.withColumn("k1", F.lower("raw")).withColumn("k2", canonical_name(F.col("raw")))
    q = q.join(by_text.select(F.col("label"), F.col("key").alias("k1"), F.col("found").alias("f1")), ["label", "k1"], "left")
    q = q.join(by_name.select(F.col("label"), F.col("key").alias("k2"), F.col("found").alias("f2")), ["label", "k2"], "left")
    return q.select("qid", "label", "raw", F.coalesce("f1", "f2").alias("found"))


def new_names(batch: DataFrame, known: DataFrame, threshold: float | None = None) -> DataFrame:
    """Mentions of the batch (ord, label, text, confidence, source_doc) whose canonical name the graph has not.

    Exact names by anti-join. With a threshold, names that are the same entity as a known one of their label (same_pairs) are known
    too, and of new names that are the same only the first stays: what inserting one after another would leave.
    """
    b = batch.withColumn("canonical_name", canonical_name(F.col("text")))
    known = known.select("label", "canonical_name").distinct()
    b = b.join(known, ["label", "canonical_name"], "left_anti")
    if threshold is None:
        return b
    groups = exact_groups(batch).join(known, ["label", "canonical_name"], "left_anti")
    before = known.select("label", "canonical_name", F.lit(-(1 << 63)).cast("long").alias("ord"), F.struct(F.col("canonical_name").alias("text"), F.lit(1.0).alias("confidence")).alias("best"))
    near = same_pairs(groups.select(*before.columns).unionByName(before), threshold)
    ours = groups.select("label", "canonical_name", F.lit(True).alias("ours"))
    near = near.join(ours.withColumnRenamed("canonical_name", "a").withColumnRenamed("ours", "new_a"), ["label", "a"], "left").join(ours.withColumnRenamed("canonical_name", "b").withColumnRenamed("ours", "new_b"), ["label", "b"], "left")
    gone = near.where("new_a is null and new_b").select("label", F.col("b").alias("canonical_name")).distinct()
    within = near.where("new_a and new_b").select("label", "a", "b")
    left = groups.join(gone, ["label", "canonical_name"], "left_anti")
    within = within.join(gone.withColumnRenamed("canonical_name", "a"), ["label", "a"], "left_anti").join(gone.withColumnRenamed("canonical_name", "b"), ["label", "b"], "left_anti")
    first = leaders(left, within).where("canonical_name = leader").select("label", "canonical_name")
    return b.join(first, ["label", "canonical_name"], "left_semi")


def _held(subjects: DataFrame, taken_apart: DataFrame, key: str) -> DataFrame:
    """Subjects and the runs of objects that have the same key; the runs that no subject has go before any shuffle where the keys are few."""
    return subjects.join(_met_by_key(taken_apart.join(subjects.select(key).distinct(), key, "left_semi")), key)


def prefix_rule(subjects: DataFrame, objects: DataFrame, predicate: str, block: int = 4) -> DataFrame:
    """For each object (name, ord), the longest subject that its name starts with, ignoring case; first seen on ties. Short subjects meet the objects' first characters in an equi-join."""
    s, o = subjects.select(F.lower("name").alias("s"), F.col("ord").alias("so")), objects.select(F.lower("name").alias("o"), F.col("ord").alias("oo"))
    long = s.where(F.length("s") >= block).withColumn("g", F.substring("s", 1, block)).join(_met_by_key(o.withColumn("g", F.substring("o", 1, block))), "g").drop("g")
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("o"), F.lit(block - 1))), lambda n: F.substring("o", F.lit(1), n))
    short = s.where(F.length("s") < block).join(_met_by_key(o.where(F.length("o") > 0).withColumn("s", F.explode(starts))), "s").select("s", "so", "o", "oo")
    return _longest(long.unionByName(short).where(F.startswith("o", "s")), predicate)


def contains_rule(subjects: DataFrame, objects: DataFrame, predicate: str, block: int = 4) -> DataFrame:
    """For each object, the longest subject that its name holds: blocked on the subject's first characters. Of the objects' runs of
    characters only those go on that some subject begins with or is."""
    gram = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("o") - block + 1, F.lit(1))), lambda i: F.substring("o", i, F.lit(block))))
    s, o = subjects.select(F.lower("name").alias("s"), F.col("ord").alias("so")), objects.select(F.lower("name").alias("o"), F.col("ord").alias("oo"))
    long = _held(s.where(F.length("s") >= block).withColumn("g", F.substring("s", 1, block)), o.withColumn("g", F.explode(gram)), "g").drop("g")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("o") - n + 1, F.lit(1))), lambda i: F.substring("o", i, F.lit(n)))
    inside = F.array_distinct(F.concat(*(runs(n) for n in range(1, block))))
    short = _held(s.where(F.length("s") < block), o.withColumn("s", F.explode(inside)), "s").select("s", "so", "o", "oo")
    return _longest(long.unionByName(short).where(F.contains("o", "s")), predicate)


def _longest(met: DataFrame, predicate: str) -> DataFrame:
    w = Window.partitionBy("o", "oo").orderBy(F.desc(F.length("s")), "so")
    return met.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("s").alias("subj"), F.lit(predicate.upper()).alias("predicate"), F.col("o").alias("obj"), F.lit(0.9).alias("confidence"))

