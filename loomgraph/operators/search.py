"""Search, neighbourhood, comparison and paths, in batch form: one job answers a table of questions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.bloom import bloom, possible
from loomgraph.functions.text import keywords, search_term, snippet
from loomgraph.operators.audit import domain
from loomgraph.sources.folders import shared_folder

# Words that a search phrase loses.
NOISE = ["the", "a", "an", "of", "for", "and", "or", "in", "on", "to", "is", "at", "by", "with"]


def matches(term: Column, fields: list[str]) -> Column:
    """The term is in one of the fields, ignoring case."""
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.contains(F.lower(F.col(f)), term), F.lit(False))
    return out


def all_words(term: Column, fields: list[str]) -> Column:
    """Each word of the term is in one of the fields."""
    some = lambda w: F.array_max(F.array(*(F.coalesce(F.contains(F.lower(F.col(f)), w), F.lit(False)).cast("int") for f in fields))) == 1
    return F.forall(F.split(term, " "), some)


def search_entities(nodes: DataFrame, term: str, limit: int = 20) -> DataFrame:
    hit = nodes.where(domain("label") & F.contains(F.lower("canonical_name"), F.lower(F.lit(term))))
    return hit.orderBy("canonical_name", "label").limit(limit)


def top_hits(nodes: DataFrame, limit: int) -> DataFrame:
    return nodes.orderBy(F.desc_nulls_last("confidence"), "canonical_name", "label").limit(limit)


GRAM = 3
#: Lengths of the substrings that probes and nodes meet on: a long key meets on twelve or more characters, which few names share.
GRAMS = (1, 2, 3, 6, 12, 24)
#: Probes of one length that every task gets a copy of.
FEW = 10_000


def grams(fields: list[str], size: int = GRAM) -> Column:
    """The distinct substrings of that size of the fields, lower-cased: a text that holds a key holds the key's last characters."""
    of = lambda f: F.transform(F.sequence(F.lit(1), F.greatest(F.length(f) - size + 1, F.lit(1))), lambda i: F.substring(F.lower(F.col(f)), i, F.lit(size)))
    return F.array_distinct(F.flatten(F.filter(F.array(*(of(f) for f in fields)), lambda g: g.isNotNull())))


def ending(key: Column) -> Column:
    """A key's last 24, 12, 6, 3, 2 or 1 characters, the most that it has."""
    n = F.length(key)
    size = F.coalesce(*(F.when(n >= g, F.lit(g)) for g in reversed(GRAMS)), F.lit(0))
    return F.right(key, size)


def contains_join(nodes: DataFrame, probes: DataFrame, fields: list[str], hit: Column, least: int = 1) -> DataFrame:
    """nodes and probes (with a column `block`: the `ending` of what a hit must hold, `least` characters at least) that meet `hit`.

    An equi-join on the block for each length that a probe has, so a probe meets only the nodes that hold it, and nodes are not
    taken apart for nobody. Up to FEW probes of a length are broadcast; parts of nodes themselves are never broadcast, they are far more than their files tell.
    """
    sizes = {r[0]: r[1] for r in probes.groupBy(F.length("block")).count().collect() if r[0] is not None and r[0] >= least}
    out = None
    for size in sorted(sizes or {GRAM: 0}, reverse=True):
        own, parts = probes.where(F.length("block") == size), nodes.withColumn("block", F.explode(grams(fields, size))).where(F.length("block") == size)
        met = parts.join(F.broadcast(own), "block") if sizes.get(size, 0) <= FEW else parts.hint("merge").join(own, "block")
        met = met.where(hit).drop("block")
        out = met if out is None else out.unionByName(met)
    return out


def find(nodes: DataFrame, queries: DataFrame, fields: list[str], limit: int = 10, exact_first: bool = False, noise: list[str] = NOISE) -> DataFrame:
    """queries (qid, term) to (qid, tier, rank, label, canonical_name, confidence).

    Tier 1: the whole term; then each keyword in order; last: all words. The first tier with hits answers. All tiers of all
    questions are one join with the nodes, blocked on the ends of keys.
    """
    norm = queries.select("qid", search_term(F.col("term")).alias("term")).where("term != ''")
    row = lambda tier, key, words: F.struct(tier.alias("tier"), key.alias("key"), F.lit(words).alias("words"))
    keys = F.transform(keywords(F.col("term"), noise), lambda k, i: row(i + 2, k, False))
    own = F.array(row(F.lit(1), F.col("term"), False))
    every = F.array(row(F.lit(1000), F.col("term"), True))
    exact = F.array(row(F.lit(0), F.col("term"), False)) if exact_first else F.array().cast("array<struct<tier:int,key:string,words:boolean>>")
    tiers = norm.select("qid", F.explode(F.concat(exact, own, keys, every)).alias("t")).select("qid", "t.tier", "t.key", "t.words")
    longest = F.array_max(F.transform(F.split("key", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    block = ending(F.when(F.col("words"), longest).otherwise(F.col("key")))  # names differ at their ends more than at their starts
    tiers = tiers.withColumn("block", block)
    n = nodes.where(domain("label")).select(*dict.fromkeys(["label", "canonical_name", "confidence", *fields]))
    hit = F.when(F.col("tier") == 0, F.lower("canonical_name") == F.col("key")).when(F.col("words"), all_words(F.col("key"), fields)).otherwise(matches(F.col("key"), fields))
    met = contains_join(n, tiers, fields, hit).select("qid", "tier", "label", "canonical_name", "confidence")
    w = Window.partitionBy("qid").orderBy("tier", F.desc_nulls_last("confidence"), "canonical_name", "label")
    best = met.withColumn("best", F.min("tier").over(Window.partitionBy("qid"))).where("tier = best").drop("best")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def related(edges: DataFrame, names: DataFrame, predicate: str | None = None) -> DataFrame:
    """One-hop neighbours of the given names (canonical_name), both directions, structure left out; both rows of a loop are kept."""
    e = edges.where(domain("subj_label") & domain("obj_label"))
    e = e if predicate is None else e.where(F.col("predicate") == predicate)
    out = e.join(names.select(F.col("canonical_name").alias("subj")), "subj").select(F.col("subj").alias("canonical_name"), F.lit("→").alias("direction"), "predicate", F.col("obj_label").alias("other_label"), F.col("obj").alias("other"))
    back = e.join(names.select(F.col("canonical_name").alias("obj")), "obj").select(F.col("obj").alias("canonical_name"), F.lit("←").alias("direction"), "predicate", F.col("subj_label").alias("other_label"), F.col("subj").alias("other"))
    return out.unionByName(back)


def chains(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Directed two-hop chains over two predicates."""
    a = edges.where(F.col("predicate") == first).select(F.col("subj_label").alias("a_label"), F.col("subj").alias("a"), F.col("obj_label").alias("b_label"), F.col("obj").alias("b"))
    b = edges.where(F.col("predicate") == second).select(F.col("subj_label").alias("b_label"), F.col("subj").alias("b"), F.col("obj_label").alias("c_label"), F.col("obj").alias("c"))
    return a.join(b, ["b_label", "b"])


def shared_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (a, b): what both point at."""
    e = edges.select("subj", "obj_label", "obj").distinct()
    left = pairs.join(e.withColumnRenamed("subj", "a"), "a")
    return left.join(e.withColumnRenamed("subj", "b"), ["b", "obj_label", "obj"]).select("a", "b", "obj_label", "obj")


def compare(questions: DataFrame, nodes: DataFrame, edges: DataFrame, props: DataFrame) -> DataFrame:
    """questions (qid, a, b) to qid, side, kind, k, v: both names resolved as in find, exact names first; then, of questions with both,
    `entity` (label, name), `property`, `→` (predicate, name) of each side 1 and 2, and `shared` of side 0: a node that both point
    at, and the two predicates. A name that is not found is a row `missing`, the first one of a question alone.

    props: label, canonical_name, k, v. Structure is left out.
    """
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.trim(c).alias("term")) for i, c in ((1, "a"), (2, "b"))))
    asked = questions.select("qid", F.explode(sides).alias("s")).select(F.struct("qid", "s.side").alias("qid"), "s.term")
    found = find(nodes, asked, ["canonical_name"], limit=1, exact_first=True).select("qid", "label", "canonical_name")
    shared_folder(questions.sparkSession)
    all_ = asked.join(found, "qid", "left").select("qid.qid", "qid.side", "term", "label", "canonical_name").checkpoint()  # read by each kind of row
    lost = all_.where("canonical_name is null").groupBy("qid").agg(F.min_by(F.struct("side", "term"), "side").alias("m")).select("qid", "m.side", F.lit("missing").alias("kind"), F.col("m.term").alias("k"), F.lit(None).cast("string").alias("v"))
    both = all_.join(lost.select("qid"), "qid", "left_anti")
    asked_for = both.select(F.col("canonical_name").alias("subj")).distinct()
    e = edges.where(domain("subj_label") & domain("obj_label")).select("subj", "predicate", "obj_label", "obj").join(asked_for, "subj", "left_semi").distinct()
    row = lambda df, kind, k, v: df.select("qid", "side", F.lit(kind).alias("kind"), k.alias("k"), v.alias("v"))
    own = row(both, "entity", F.col("label"), F.col("canonical_name"))
    shown = row(both.join(props, ["label", "canonical_name"]), "property", F.col("k"), F.col("v"))
    out = both.select("qid", "side", F.col("canonical_name").alias("subj")).join(e, "subj")
    left, right = (out.where(F.col("side") == i).select("qid", "obj_label", "obj", F.col("predicate").alias(f"p{i}")) for i in (1, 2))
    shared = left.join(right, ["qid", "obj_label", "obj"]).withColumn("side", F.lit(0))
    met = row(shared, "shared", F.concat("obj_label", F.lit(" "), "obj"), F.concat_ws(" / ", "p1", "p2"))
    return lost.unionByName(own).unionByName(shown).unionByName(row(out, "→", F.col("predicate"), F.col("obj"))).unionByName(met)


def paths(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Undirected paths of 1 to `hops` edges from the start nodes (label, canonical_name), no edge twice: (start, end, length, predicates, names), predicates and
    names of nodes in order, joined by `>`.

    The hops are unrolled joins on the end's key; the start filter and `hops` keep them small. Paths that go on are written once. A few
    of them are broadcast; else edges are shuffled only in the direction in which they may go on, by a Bloom filter of the paths' ends."""
    if hops < 1:
        raise ValueError("one hop at least")
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/paths-{uuid.uuid4().hex}"
    e = edges.select("subj_label", "subj", "predicate", "obj_label", "obj")
    both = e.select(F.col("subj_label").alias("fl"), F.col("subj").alias("f"), "predicate", F.col("obj_label").alias("tl"), F.col("obj").alias("t"), F.lit(True).alias("ahead")).unionByName(e.select(F.col("obj_label").alias("fl"), F.col("obj").alias("f"), "predicate", F.col("subj_label").alias("tl"), F.col("subj").alias("t"), F.lit(False).alias("ahead")))
    # made after the join, so that no hash of an edge is shuffled
    eid = F.when(F.col("ahead"), F.xxhash64("fl", "f", "predicate", "tl", "t")).otherwise(F.xxhash64("tl", "t", "predicate", "fl", "f"))
    end = F.xxhash64("fl", "f").alias("__end")
    front = start.select(F.col("canonical_name").alias("start"), F.col("label").alias("fl"), F.col("canonical_name").alias("f"), F.array().cast("array<bigint>").alias("used"), F.array().cast("array<string>").alias("predicates"), F.array("canonical_name").alias("names"))
    out = None
    for k in range(1, hops + 1):
        if front.limit(FEW + 1).count() <= FEW:
            met = both.join(F.broadcast(front), ["fl", "f"])
        else:  # merged, as paths are many more bytes than their file
            near = possible(both.withColumn("__end", end), "__end", bloom(front.select(end))).drop("__end")
            met = front.hint("merge").join(near, ["fl", "f"])
        step = met.withColumn("eid", eid).where(~F.array_contains("used", F.col("eid")))
        front = step.select("start", F.col("tl").alias("fl"), F.col("t").alias("f"), F.concat("used", F.array("eid")).alias("used"), F.concat("predicates", F.array("predicate")).alias("predicates"), F.concat("names", F.array("t")).alias("names"))
        if k < hops:
            schema = front.schema
            front.write.parquet(f"{folder}/{k}")
            front = spark.read.schema(schema).parquet(f"{folder}/{k}")
        rows = front.select("start", F.col("f").alias("end"), F.lit(k).alias("length"), F.array_join("predicates", ">").alias("predicates"), F.array_join("names", ">").alias("names"))
        out = rows if out is None else out.unionByName(rows)
    return out


def match_triples(edges: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a list of triple patterns (?a, predicate, ?b): a chain of equi-joins on shared variables."""
    out = None
    for s, p, o in patterns:
        step = edges.where(F.col("predicate") == p).select(F.col("subj").alias(s.lstrip("?")), F.col("obj").alias(o.lstrip("?")))
        shared = [] if out is None else [c for c in step.columns if c in out.columns]
        if out is not None and not shared:
            raise ValueError(f"pattern {(s, p, o)} shares no variable with those before it")
        out = step if out is None else out.join(step, shared)
    return out.distinct()


def suggestions(nodes: DataFrame, failed: DataFrame, per_word: int = 8, total: int = 10) -> DataFrame:
    """For failed lookups (qid, term): verified names that hold a word of three letters and more, few for each word and question."""
    words = failed.select("qid", F.explode(F.array_distinct(F.filter(F.split(search_term(F.col("term")), " "), lambda w: F.length(w) >= 3))).alias("word"))
    ok = nodes.where(domain("label") & F.coalesce("verified", F.lit(True))).select("canonical_name").distinct()
    met = contains_join(ok, words.withColumn("block", ending(F.col("word"))), ["canonical_name"], F.contains("canonical_name", "word"), GRAM)
    some = met.withColumn("r", F.row_number().over(Window.partitionBy("qid", "word").orderBy("canonical_name"))).where(F.col("r") <= per_word)
    names = some.select("qid", "canonical_name").distinct()
    return names.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("canonical_name"))).where(F.col("rank") <= total)


def hybrid(first: DataFrame, then: DataFrame, question: list[str], item: str) -> DataFrame:
    """Hits of two searches (question, item, r) as one list without doubles: those of the first in their order, then the others;
    (question, item, rank, both_ways)."""
    both = first.select(*question, item, F.lit(0).alias("way"), F.col("r").cast("long").alias("r")).unionByName(then.select(*question, item, F.lit(1).alias("way"), F.col("r").cast("long").alias("r")))
    found = both.groupBy(*question, item).agg(F.min(F.struct("way", "r")).alias("at"), (F.countDistinct("way") > 1).alias("both_ways"))
    w = Window.partitionBy(*question).orderBy("at.way", "at.r", item)
    return found.withColumn("rank", F.row_number().over(w)).drop("at")


def provenance_context(found: DataFrame, sources: DataFrame, key: str, width: int = 300, around: int = 200) -> DataFrame:
    """Entities (key, canonical_name, source_text) with their context: the source text that was kept with them, else the first place
    of the name in the source (key, text); at most `width` characters."""
    met = found.join(sources.select(key, F.col("text").alias("__text")), key, "left")
    context = F.coalesce(F.nullif("source_text", F.lit("")), snippet(F.col("__text"), F.col("canonical_name"), around))
    return met.select(key, "canonical_name", F.substring(context, 1, width).alias("context"))


def seeded_sample(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of their key."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return df.withColumn("__h", h).orderBy("__h").limit(n).drop("__h")
