"""Approximate nearest neighbours: a hash-prefix forest.

A hash function gives a symbol: the signed axis that is largest after a seeded rotation. A tree's strings are symbols of
functions that it draws from a common pool, as many as 56 bits hold, so near vectors share long prefixes. Its strings are sorted
arrays, kept with ids alone in buckets of the first symbol. A query descends to its longest prefix matches in every tree;
then all trees ascend together, a symbol at a time and tree after tree, and candidates are all entries that share so long a
prefix. It stops where the chance that a neighbour as near in angle as those found has been missed by all trees is small
enough, so tight neighbourhoods stop deep in the trees and even spreads near the root. Distances are taken of distinct
candidates alone, whose vectors are kept in blocks.

Equal vectors are one entry. Buckets are dealt out by salt beyond BUCKET_ROWS, queries in lists of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, arrow_rows

TREES, SEED = 48, 5
#: Bits of a hash string, axes of a rotation at most, and hash functions in the pool for each tree.
STRING_BITS, AXES, POOL = 56, 64, 2
#: Share of the neighbours that the ascent is to reach, by its own reckoning.
TARGET = 0.94
#: Longest prefix matches that a tree gives on either side in the descent.
MATCHES = 4
#: Entries of a bucket of a tree and of a block of vectors, and queries of a list that meets one.
BUCKET_ROWS, BLOCK_ROWS, LIST_ROWS = 8192, 8192, 256
#: Entries, about, whose mean centres the hashes.
SAMPLE_ROWS = 2000


class Hashes:
    """The forest's hash functions for vectors of so many components."""

    def __init__(self, dims: int, trees: int, seed: int):
        self.trees, self.axes = trees, min(dims, AXES)
        self.bits = max(1, (2 * self.axes - 1).bit_length())
        self.symbols = STRING_BITS // self.bits
        rng = np.random.default_rng(seed)
        self.pool = np.stack([np.linalg.qr(rng.standard_normal((dims, self.axes)))[0] for _ in range(POOL * trees)]).astype(np.float32)
        others = [rng.permutation(np.setdiff1d(np.arange(POOL * trees), [t])) for t in range(trees)]
        self.drawn = [np.concatenate(([t], np.resize(others[t], self.symbols - 1))) for t in range(trees)]

    def strings(self, x: np.ndarray) -> np.ndarray:
        """[row, tree]; x is centred."""
        x = x.astype(np.float32)
        symbol = np.empty((len(self.pool), len(x)), np.int64)
        rows = np.arange(len(x))
        for k, r in enumerate(self.pool):
            z = x @ r
            axis = np.abs(z).argmax(1)
            symbol[k] = 2 * axis + (z[rows, axis] < 0)
        out = np.zeros((len(x), self.trees), np.int64)
        for t, functions in enumerate(self.drawn):
            for f in functions:
                out[:, t] = (out[:, t] << self.bits) | symbol[f]
        return out


@lru_cache(maxsize=4)
def hashes(dims: int, trees: int, seed: int) -> Hashes:
    return Hashes(dims, trees, seed)


@lru_cache(maxsize=4)
def collisions(dims: int, seed: int = 1, pairs: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Cosines, and the share of drawn pairs of vectors with just that cosine that have the same symbol."""
    rng = np.random.default_rng(seed)
    a, other = rng.standard_normal((2, pairs, min(dims, 4 * AXES)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other -= (a * other).sum(1, keepdims=True) * a
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    rows = np.arange(pairs)
    a, other = a[:, :AXES], other[:, :AXES]
    i = np.abs(a).argmax(1)
    cosines, shares = np.linspace(-0.2, 1, 49), []
    for c in cosines:
        b = c * a + np.sqrt(1 - c * c) * other
        j = np.abs(b).argmax(1)
        shares.append(float(((i == j) & ((a[rows, i] > 0) == (b[rows, j] > 0))).mean()))
    return cosines, np.maximum.accumulate(shares)


def place(symbols: int, trees: int, depth: int, t: int) -> int:
    """The step of the ascent at which t trees share `depth` symbols and the others one more; 0: none yet."""
    return (symbols - depth) * trees + t


def steps_needed(cosines: list[np.ndarray | None], k: int, symbols: int, trees: int, dims: int, target: float) -> np.ndarray:
    """For the cosines of each query's nearest found: the first step that reaches the target's share of such neighbours, on
    average; one step past the last, the root, if none does or fewer than k were found."""
    root = symbols * trees + 1
    out = np.full(len(cosines), root, np.int32)
    some = [i for i, c in enumerate(cosines) if c is not None and len(c) >= k]
    if not some:
        return out
    at, share = collisions(dims)
    p = np.interp(np.array([np.asarray(cosines[i], np.float64)[:k] for i in some]), at, share)
    left = np.arange(len(some))
    for depth in range(symbols, 0, -1):
        here, below = p[left] ** depth, p[left] ** (depth + 1) if depth < symbols else np.zeros_like(p[left])
        full = (1 - (1 - here) ** trees).mean(1) >= target
        for i in np.flatnonzero(full):
            t = np.arange(1, trees + 1)[:, None]
            reached = (1 - (1 - here[i]) ** t * (1 - below[i]) ** (trees - t)).mean(1)
            out[some[left[i]]] = place(symbols, trees, depth, int(np.argmax(reached >= target)) + 1)
        left = left[~full]
        if not len(left):
            break
    return out


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _hasher(dims: int, mean: list[float], trees: int, seed: int):
    @F.pandas_udf("array<long>")
    def run(vectors):
        import pandas as pd

        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(hashes(dims, trees, seed).strings(np.array(vectors.tolist(), np.float64) - np.array(mean))), dtype=object)

    return run


BUCKET = "tree int, top long, strings binary, eids binary"
BLOCK = "block long, eids binary, lows binary, vectors binary"


def _sorted_bucket(key: tuple, rows: pa.Table) -> pa.Table:
    strings, eids = rows.column("string").to_numpy(), rows.column("eid").to_numpy()
    order = np.lexsort((eids, strings))
    return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "top": pa.array([key[1].as_py()], pa.int64()), "strings": [strings[order].tobytes()], "eids": [eids[order].tobytes()]})


def _packed_block(key: tuple, rows: pa.Table) -> pa.Table:
    eids = rows.column("eid").to_numpy()
    order = np.argsort(eids)
    v = np.array(rows.column("v").to_pylist(), np.float64)[order]
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "eids": [eids[order].tobytes()], "lows": [rows.column("low").to_numpy()[order].tobytes()], "vectors": [v.tobytes()]})


FOUND = "q long, block long, eids binary"


def _searcher(symbols: int, bits: int, blocks: int):
    """Of each row, a bucket with a list of probes (q, string, depth after, depth before; after < 0: the descent): the entries
    that come in between the two depths, by their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                strings, eids = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("strings", "eids"))
                out_q, out_block, out_eids = [], [], []
                for probe in batch.column("probes")[i].as_py():
                    string = probe["string"]

                    def span(depth: int, string: int = string) -> tuple[int, int]:
                        if depth > symbols:
                            return 0, 0
                        drop = bits * (symbols - depth)
                        return tuple(np.searchsorted(strings, [(string >> drop) << drop, ((string >> drop) + 1) << drop]).tolist())

                    if probe["to"] < 0:
                        lo, hi = span(symbols)
                        hi = max(hi, lo + 1)
                        got = np.concatenate((eids[max(0, lo - MATCHES) : lo], eids[lo : min(hi, lo + 2 * MATCHES)], eids[hi : hi + MATCHES]))
                    else:
                        lo, hi = span(probe["to"])
                        a, b = span(probe["at"])
                        got = np.concatenate((eids[lo:a], eids[b:hi])) if b > a else eids[lo:hi]
                    of = got % blocks
                    order = np.argsort(of, kind="stable")
                    cuts = np.flatnonzero(np.diff(of[order])) + 1
                    for part in np.split(order, cuts):
                        if len(part):
                            out_q.append(probe["q"])
                            out_block.append(int(of[part[0]]))
                            out_eids.append(got[part].tobytes())
                yield pa.RecordBatch.from_pydict({"q": pa.array(out_q, pa.int64()), "block": pa.array(out_block, pa.int64()), "eids": pa.array(out_eids, pa.binary())})

    return run


NEAR = "q long, n long, near array<struct<dist:double,low:long,eid:long,cos:double>>"
_NEAR = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("near", pa.list_(pa.struct([("dist", pa.float64()), ("low", pa.int64()), ("eid", pa.int64()), ("cos", pa.float64())])))])


def _measurer(dims: int, mean: list[float], keep: int):
    """Of each row, a block with a list of (q, v, lists of eids; null: all): the number of distinct candidates and the nearest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.array(mean)
        for batch in batches:
            for i in range(batch.num_rows):
                eids, lows = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("eids", "lows"))
                x = np.frombuffer(batch.column("vectors")[i].as_buffer(), np.float64).reshape(-1, dims)
                size = np.linalg.norm(x - centre, axis=1)
                rows = []
                for ask in batch.column("asked")[i].as_py():
                    at = np.arange(len(eids)) if ask["lists"] is None else np.searchsorted(eids, np.unique(np.frombuffer(b"".join(ask["lists"]), np.int64)))
                    q = np.array(ask["v"])
                    y = x[at]
                    dist = np.sqrt(((y - q) ** 2).sum(1))
                    near = at[dist <= np.partition(dist, keep - 1)[keep - 1]] if len(at) > keep else at
                    d = dist[np.searchsorted(at, near)]
                    own = np.linalg.norm(q - centre)
                    # row by row, so that a candidate found again is the same row to the last bit
                    cos = ((x[near] - centre) * (q - centre)).sum(1) / np.maximum(size[near] * own, 1e-300)
                    order = np.lexsort((lows[near], d))[:keep]
                    rows.append({"q": ask["q"], "n": len(at), "near": [{"dist": float(d[j]), "low": int(lows[near[j]]), "eid": int(eids[near[j]]), "cos": float(cos[j])} for j in order]})
                yield pa.RecordBatch.from_pylist(rows, schema=_NEAR)

    return run


RESULT = "query_id long, rank int, vec_id long, score double, candidates long"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, seed: int = SEED, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score, candidates: the k nearest found of each query (query_id, v) among vectors (vec_id, v) but its own id.

    Distance is Euclidean, in double precision; ties go to the smaller id; all candidates if there are fewer than k.
    candidates: entries whose distance was taken, those of several rounds (five at most) once for each. Vectors that are null, empty, zero, or hold
    null or non-finite components take no part, nor do rows with a null id or with another number of components than most.
    Rows that repeat an id are one candidate, at its nearest.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    own = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    asked = queries.where(F.col("query_id").isNotNull() & usable(F.col("v"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    dims = own.agg(F.mode(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], RESULT)
    own, asked = own.where(F.size("v") == dims).distinct(), asked.where(F.size("v") == dims)
    twice = own.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    keep = (k + 1) * twice  # a query's own id, and ids with several vectors, are among the nearest
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= keep)
    entries = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = scratch.write(entries.select(F.monotonically_increasing_id().alias("eid"), F.xxhash64("v").alias("h"), "v", F.get("ids", F.lit(0)).alias("low"), "ids"))
    n = entries.count()
    # hashes are even over all longs, so a bound on them takes about SAMPLE_ROWS entries, the same ones in every run
    bound = (1 << 63) - 1 if n <= SAMPLE_ROWS else -(1 << 63) + (1 << 64) * SAMPLE_ROWS // n
    sample = np.array([r[0] for r in entries.where(F.col("h") <= bound).orderBy("h", "low").select("v").collect()], np.float64)
    mean = sample.mean(0).tolist() if len(sample) else [0.0] * dims
    functions = hashes(dims, trees, seed)
    symbols, bits = functions.symbols, functions.bits

    asked = scratch.write(asked.join(entries.select("v", F.col("eid").alias("q")), "v").select("query_id", "q"))
    hashed = scratch.write(entries.select("eid", _hasher(dims, mean, trees, seed)("v").alias("strings")))
    spread = hashed.select("eid", F.posexplode("strings").alias("tree", "string")).withColumn("top", F.shiftright("string", bits * (symbols - 1)))
    salts = F.ceil(F.count("*") / BUCKET_ROWS).alias("salts")
    salted = scratch.write(spread.groupBy("tree", "top").agg(salts).where("salts > 1"))  # at most one for each BUCKET_ROWS strings
    salted = F.broadcast(salted) if salted.count() <= 200_000 else salted
    salt = F.pmod(F.xxhash64("eid"), F.coalesce("salts", F.lit(1))).alias("salt")
    forest = spread.join(salted, ["tree", "top"], "left").select("tree", "top", salt, "string", "eid")
    forest = scratch.write(forest.groupBy("tree", "top", "salt").applyInArrow(_sorted_bucket, BUCKET))
    blocks = max(1, -(-n // BLOCK_ROWS))
    packed = entries.select(F.pmod("eid", F.lit(blocks)).alias("block"), "eid", "low", "v").groupBy("block")
    packed = scratch.write(packed.applyInArrow(_packed_block, BLOCK))

    wanted = asked.select("q").distinct().join(entries.select(F.col("eid").alias("q"), "v"), "q").join(hashed.withColumnRenamed("eid", "q"), "q")
    wanted = scratch.write(wanted)
    lists = max(1, -(-wanted.count() // LIST_ROWS))
    deal = lambda c: F.pmod(F.xxhash64("q", *c), F.lit(lists)).alias("list")

    def candidates(probes: DataFrame) -> DataFrame:
        """(q, block, lists of eids) of probes (q, to, at): steps of the ascent."""
        reached = lambda p, none: F.when(F.col(p) < 1, none).otherwise(symbols - F.floor((F.col(p) - 1) / trees) + (F.col("tree") > (F.col(p) - 1) % trees).cast("int")).cast("int")
        each = probes.join(wanted.select("q", "strings"), "q").select("q", "to", "at", F.posexplode("strings").alias("tree", "string"))
        each = each.select("q", "tree", "string", reached("to", F.lit(-1)).alias("to"), reached("at", F.lit(symbols + 1)).alias("at")).where("to < at")
        each = each.withColumn("top", F.shiftright("string", bits * (symbols - 1)))
        dealt = each.groupBy("tree", "top", deal([])).agg(F.collect_list(F.struct("q", "string", "to", "at")).alias("probes"))
        met = forest.join(dealt, ["tree", "top"]).select("strings", "eids", "probes")
        return met.mapInArrow(_searcher(symbols, bits, blocks), FOUND).groupBy("q", "block").agg(F.collect_list("eids").alias("lists"))

    def measured(found: DataFrame) -> DataFrame:
        dealt = found.join(wanted.select("q", "v"), "q").groupBy("block", deal([])).agg(F.collect_list(F.struct("q", "v", "lists")).alias("asked"))
        return packed.join(dealt, "block").select("eids", "lows", "vectors", "asked").mapInArrow(_measurer(dims, mean, keep), NEAR)

    @F.pandas_udf("int")
    def needed(cosines):
        import pandas as pd

        return pd.Series(steps_needed(list(cosines), k, symbols, trees, dims, target), dtype="int32")

    root = symbols * trees + 1

    def after(old: DataFrame | None, new: DataFrame) -> DataFrame:
        """The state of each query: its step, candidates so far, the nearest, and the step that it needs."""
        rows = new.select("q", F.lit(0).alias("step"), "n", "near")
        rows = rows if old is None else rows.unionByName(old.select("q", "step", "n", "near"))
        near = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, keep)
        out = rows.groupBy("q").agg(F.max("step").alias("step"), F.sum("n").alias("n"), near.alias("near"))
        others = F.filter("near", lambda x: x["eid"] != F.col("q"))
        return out.withColumn("need", needed(F.transform(others, lambda x: x["cos"])))

    with arrow_rows(spark, 16):
        start = wanted.select("q", F.lit(0).alias("to"), F.lit(0).alias("at"))
        state = scratch.write(after(None, measured(candidates(start))))
        # how far a round may ascend: what is found on the way shows that less is needed
        for limit in (place(symbols, trees, 2, trees), place(symbols, trees, 1, trees // 2), place(symbols, trees, 1, trees), root):
            active = state.where((F.col("need") > F.col("step")) & (F.col("step") < limit))
            if not active.take(1):
                continue
            probes = active.select("q", F.least("need", F.lit(limit)).alias("to"), F.col("step").alias("at"))
            if limit == root:
                every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
                found = probes.select("q", every, F.lit(None).cast("array<binary>").alias("lists"))
            else:
                found = candidates(probes)
            moved = state.join(probes.select("q", "to"), "q", "left").withColumn("n", F.when(F.col("to") == root, 0).otherwise(F.col("n"))).withColumn("step", F.coalesce("to", "step"))
            state = scratch.write(after(moved, measured(found)))

    hits = asked.join(state.select("q", F.col("n").alias("candidates"), F.explode("near").alias("x")), "q").select("query_id", "candidates", F.col("x.dist").alias("score"), F.col("x.eid").alias("eid"))
    hits = hits.join(entries.select("eid", "ids"), "eid").select("query_id", "candidates", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.max("candidates").alias("candidates"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "candidates")
