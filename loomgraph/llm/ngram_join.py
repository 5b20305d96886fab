"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of word 5-grams are one class. Classes that share a band of MinHash values are candidates; their
values are compared a few at a time, and a pair is dropped once the posterior probability that its similarity reaches the
threshold is below the tolerance. What is left is verified exactly on the 64-bit hashes of the 5-grams.

Buckets of a band that are small give pairs. The members of large ones are dealt into chunks, and every two chunks that
meet in such a bucket are one cell of a grid, compared in blocks by one group of a task. A cell returns a row a class:
its links and the least class that it is connected with. So a group of N near copies is never a row for each of its
pairs: N / CHUNK rows a class go out and N / CHUNK come back. Components of the links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, arrow_rows, mix64, shingle_hashes, word_hashes
from loomgraph.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares none of the bands with a probability of (1 - 0.8 ** 4) ** 24, 3e-6.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Values compared between two looks at the posterior, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-5
#: Largest bucket that gives pairs, and members of a chunk of larger ones.
SMALL_BUCKET, CHUNK = 24, 4096
#: 5-grams of a chunk, about: one of long texts has fewer members. Two chunks are in a task's memory.
CHUNK_GRAMS = 1 << 20
#: Classes that are compared at once within a cell, and the share of pairs below which they are verified one by one.
BLOCK, SPARSE = 512, 0.02
#: Classes of more than a share of 1 / HOT_CLASSES of all rows are broadcast: there are no more than that.
HOT_CLASSES = 50_000
#: Keys are broadcast up to so many bytes, else joined.
BROADCAST_BYTES = 32 << 20
_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_MULTIPLY, _ADD = _SEEDS[:HASHES] | np.uint64(1), _SEEDS[HASHES:]


def minhash(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Signatures [text, HASHES] of texts with per > 0 hashes each, one after another."""
    starts = (np.cumsum(per) - per)[per > 0]
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        v = ((hashes * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def class_key(ngrams: np.ndarray) -> bytes:
    """128 bits of a set, given sorted and distinct."""
    return int(mix64(ngrams + np.uint64(1)).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix64(ngrams ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)).to_bytes(8, "big")


def _parts(texts: list[str | None], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    h, per = shingle_hashes(*word_hashes(texts), n)
    ends = np.cumsum(per).tolist()
    return [np.unique(h[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


SIGNED = "doc_id long, th long, cid binary, n int, sig binary"
SETS = "cid binary, grams binary"


def _signer(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo, hi in _parts(texts):
                sets = _ngram_sets(texts[lo:hi], n)
                per = np.array([len(s) for s in sets])
                sigs = iter(minhash(np.concatenate(sets), per).view(np.uint8).reshape(-1, 4 * HASHES) if per.any() else [])
                rows = [(class_key(s), bytes(next(sigs))) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_pydict({"doc_id": ids[lo:hi], "th": batch.column("th")[lo:hi], "cid": pa.array([r[0] for r in rows], pa.binary()), "n": pa.array(per, pa.int32()), "sig": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _parts(texts):
                sets = [s for s in _ngram_sets(texts[lo:hi], n) if len(s)]
                yield pa.RecordBatch.from_pydict({"cid": pa.array([class_key(s) for s in sets], pa.binary()), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def least_matches(threshold: float, tolerance: float, step: int = STEP, hashes: int = HASHES) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): with a uniform prior, P(J >= t | m of k match) = P(Bin(k + 1, t) <= m)."""
    out = []
    for k in range(step, hashes + 1, step):
        total, m = 0.0, 0
        for m in range(k + 1):
            total += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                break
        out.append((k, m))
    return out


def prune(a: np.ndarray, b: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs of signatures (rows of a and b) that no look drops."""
    left, matches, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for k, least in rule:
        matches = matches + (a[left, at:k] == b[left, at:k]).sum(1, dtype=np.int32)
        keep = matches >= least
        left, matches, at = left[keep], matches[keep], k
    return left


def _pruner(rule: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
                left = pa.array(prune(a, b, rule))
                yield pa.RecordBatch.from_arrays([part.column("a").take(left), part.column("b").take(left)], ["a", "b"])

    return run


def enough(common: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether common / (sizes - common) is at least the threshold, sizes being both sets' together."""
    return (common > 0) & (common >= threshold * (sizes - common) - 1e-9)


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("ga"), batch.column("gb")
            common, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                a, b = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                sizes[i] = len(a) + len(b)
                at = np.searchsorted(b, a)
                common[i] = (b[np.minimum(at, len(b) - 1)] == a).sum()
            keep = pa.array(enough(common, sizes, threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a's and b's sets: a product of incidence matrices over the 5-grams on both sides, in column blocks."""
    x, y = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)
    i, j = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    cx, cy = np.searchsorted(shared, x), np.searchsorted(shared, y)
    for lo in range(0, len(shared), 4096):
        hi = min(lo + 4096, len(shared))
        block = []
        for v, owner, at, n in ((x, i, cx, len(a)), (y, j, cy, len(b))):
            own = np.flatnonzero((at >= lo) & (at < hi))
            own = own[shared[at[own]] == v[own]]
            m = np.zeros((n, hi - lo), np.float32)
            m[owner[own], at[own] - lo] = 1
            block.append(m)
        out += block[0] @ block[1].T
    return out.astype(np.int64)


NODE = "struct<no_id:boolean,doc_id:long,th:long,cid:binary>"
CELL = f"node {NODE}, root {NODE}, links long"
_NODE = pa.struct([("no_id", pa.bool_()), ("doc_id", pa.int64()), ("th", pa.int64()), ("cid", pa.binary())])
_CELL = pa.schema([("node", _NODE), ("root", _NODE), ("links", pa.int64())])


def alike(a: np.ndarray, b: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """[row of a, row of b]: whether two signatures share a band and no look drops them."""
    wide = [np.ascontiguousarray(x.view(np.uint64).T) for x in (a, b)]
    left = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(wide[0]), ROWS // 2):
        left |= (wide[0][k][:, None] == wide[1][k]) & (wide[0][k + 1][:, None] == wide[1][k + 1])
    if not left.any():
        return left
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    matches, at = np.zeros(left.shape, np.uint8), 0
    for k, least in rule:
        for j in range(at, k):
            matches += x[j][:, None] == y[j]
        left &= matches >= least
        at = k
        if not left.any():
            break
    return left


def similar(a: list[np.ndarray], b: list[np.ndarray], left: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs in `left` (by place in a and b) have sets of at least the threshold's similarity."""
    i, j = np.nonzero(left)
    out = np.zeros(left.shape, bool)
    if not len(i):
        return out
    size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    if len(i) > SPARSE * left.size:
        common = _common(a, b)[i, j]
    else:
        common = np.array([len(np.intersect1d(a[p], b[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    good = enough(common, size_a[i] + size_b[j], threshold)
    out[i[good], j[good]] = True
    return out


def join_labels(labels: np.ndarray, rows: np.ndarray, cols: np.ndarray, ok: np.ndarray) -> None:
    """Gives every two places that ok links, and all that have their labels, the least of them."""
    of = labels[cols][None, :]
    low, high = np.where(ok, of, len(labels)).min(1), np.where(ok, of, -1).max(1)
    for i in np.flatnonzero((high >= 0) & ((low != labels[rows]) | (high != labels[rows]))):
        met = np.unique(np.append(labels[cols[ok[i]]], labels[rows[i]]))
        if len(met) > 1:
            labels[np.isin(labels, met[1:])] = met[0]


def compare_cell(sig: np.ndarray, grams: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, rule: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """links (copies counted) of each class within the cell, and the least place that it is connected with. left and right: places
    of the two chunks; right None: one chunk with itself."""
    links, labels = np.zeros(len(sig)), np.arange(len(sig))
    cut = lambda at: [at[lo : lo + BLOCK] for lo in range(0, len(at), BLOCK)]
    for p, rows in enumerate(cut(left)):
        for q, cols in enumerate(cut(left if right is None else right)):
            if right is None and q < p:
                continue
            ok = alike(sig[rows], sig[cols], rule)
            if right is None and q == p:
                ok = np.triu(ok, 1)
            ok = similar([grams[i] for i in rows], [grams[i] for i in cols], ok, threshold)
            if ok.any():
                links[rows] += ok @ copies[cols].astype(np.float64)
                links[cols] += copies[rows].astype(np.float64) @ ok
                join_labels(labels, rows, cols, ok)
    return links.astype(np.int64), labels


def _cell(threshold: float, rule: list[tuple[int, int]]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        nodes = rows.column("node").to_pylist()
        order = np.array(sorted(range(len(nodes)), key=lambda i: (nodes[i]["no_id"], nodes[i]["doc_id"] or 0, nodes[i]["th"], nodes[i]["cid"])), np.int64)
        rows = rows.take(pa.array(order))
        g = rows.column("g").to_numpy()
        first, second = (k.as_py() for k in key)
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        grams = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
        left, right = np.flatnonzero(g == first), None if first == second else np.flatnonzero(g == second)
        links, labels = compare_cell(sig, grams, rows.column("copies").to_numpy(), left, right, threshold, rule)
        some = np.flatnonzero(links)
        node = rows.column("node")
        return pa.table({"node": node.take(pa.array(some)), "root": node.take(pa.array(labels[some])), "links": links[some]}).cast(_CELL)

    return run


def _limited(df: DataFrame, rows: int, width: int) -> DataFrame:
    """df (of so many rows, of so many bytes each in a hash table), broadcast if that is little."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def _components(scratch: Scratch, classes: DataFrame, linked: DataFrame, cells: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(cid, root node) of the classes with links, and (cid, links). Classes of a cell are first joined to the least class that
    their cells know, so that only these labels, and not a hot group's classes, take part in the rounds."""
    node = classes.select("cid", F.struct("lead.*", "cid").alias("node"))
    copies = classes.select(F.col("cid").alias("b"), "copies")
    counts = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(copies, "b").groupBy(F.col("a").alias("cid")).agg(F.sum("copies").alias("links"))
    if cells is None:
        label = node.select("cid", F.col("node").alias("label"))
    else:
        summed = cells.groupBy("node").agg(F.min("root").alias("label"), F.sum("links").alias("links"))
        summed = scratch.write(summed.select(F.col("node.cid").alias("cid"), "label", "links"))
        counts = counts.unionByName(summed.select("cid", "links")).groupBy("cid").agg(F.sum("links").alias("links"))
        label = node.join(summed.select("cid", "label"), "cid", "left").select("cid", F.coalesce("label", "node").alias("label"))
    ends = label.select(F.col("cid").alias("a"), F.col("label").alias("u")), label.select(F.col("cid").alias("b"), F.col("label").alias("v"))
    edges = linked.join(ends[0], "a").join(ends[1], "b").select("u", "v")
    if cells is not None:
        more = cells.select(F.col("node.cid").alias("cid"), "root").join(summed.select("cid", "label"), "cid").where("root != label").select(F.col("root").alias("u"), F.col("label").alias("v")).distinct()
        edges = edges.unionByName(more)
    found = components(edges, scratch)
    found = _limited(found, found.count(), 200)
    with_links = counts.select("cid").join(label, "cid")
    return with_links.join(found, F.col("label") == F.col("node"), "left").select("cid", F.coalesce("root", "label").alias("root")), counts


def _decided(docs: DataFrame, words: int, threshold: float, tolerance: float) -> DataFrame:
    """doc_id, th (hash of the text), class_id, n_links, n_copies and kept of every row: kept is true of the rows of the group's
    least (doc_id, th), null ids last, and of rows without words."""
    rule = least_matches(threshold, tolerance)
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    signed = scratch.write(own.mapInArrow(_signer(words), SIGNED))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("lead")
    classes = scratch.write(signed.where("cid is not null").groupBy("cid").agg(lead, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    bands = [F.xxhash64(F.expr(f"substring(sig, {4 * ROWS * b + 1}, {4 * ROWS})"), F.lit(b)) for b in range(BANDS)]
    keyed = classes.select("cid", "n", F.explode(F.array(*bands)).alias("key"))
    sizes = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("grams")).where("size > 1"))
    met = scratch.write(keyed.drop("n").join(sizes, "key"))

    # small buckets: pairs
    lists = met.where(F.col("size") <= SMALL_BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("cid")).alias("m"))
    pairs = lists.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b))))")).alias("p"))
    pairs = pairs.select("p.a", "p.b").distinct()

    # large buckets: chunks
    hot = met.where(F.col("size") > SMALL_BUCKET)
    any_hot = bool(hot.take(1))
    if any_hot:
        home = hot.groupBy("cid").agg(F.max(F.struct("size", "key", "grams")).alias("home"))
        n_chunks = F.ceil(F.greatest(F.col("home.size") / CHUNK, F.col("home.grams") / CHUNK_GRAMS))
        chunk = F.struct(F.col("home.key").alias("key"), F.pmod(F.xxhash64("cid"), n_chunks).alias("salt"))
        home = scratch.write(home.select("cid", F.xxhash64(chunk["key"], chunk["salt"]).alias("g")))
        spread = hot.join(home, "cid").select("key", "g").distinct()
        grid = scratch.write(spread.withColumnRenamed("g", "g1").join(spread.withColumnRenamed("g", "g2"), "key").where("g1 <= g2").select("g1", "g2").distinct())
        h1 = home.select(F.col("cid").alias("a"), F.col("g").alias("ha"))
        h2 = home.select(F.col("cid").alias("b"), F.col("g").alias("hb"))
        placed = pairs.join(h1, "a", "left").join(h2, "b", "left").withColumn("g1", F.least("ha", "hb")).withColumn("g2", F.greatest("ha", "hb"))
        both = F.col("ha").isNotNull() & F.col("hb").isNotNull()
        covered = grid.withColumn("in", F.lit(True))
        pairs = placed.withColumn("g1", F.when(both, F.col("g1"))).join(covered, ["g1", "g2"], "left").where(F.col("in").isNull()).select("a", "b")

    sig = classes.select("cid", "sig")
    pairs = pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
    left = scratch.write(pairs.select("a", "b", "sa", "sb").mapInArrow(_pruner(rule), "a binary, b binary"))
    scratch.drop(met, sizes)

    # exact verification, on the texts of the classes that are left
    needed = left.select(F.col("a").alias("cid")).unionByName(left.select(F.col("b").alias("cid")))
    needed = needed.unionByName(home.select("cid")) if any_hot else needed
    needed = scratch.write(needed.distinct().join(classes.select("cid", "lead"), "cid"))
    n = needed.count()
    ids = needed.select("lead.doc_id").where("doc_id is not null").distinct()
    texts = own.where("doc_id is not null").join(_limited(ids, n, 32), "doc_id", "left_semi")
    if needed.where("lead.no_id").take(1):
        texts = texts.unionByName(own.where("doc_id is null").select(*texts.columns))
    grams = texts.mapInArrow(_setter(words), SETS).join(_limited(needed.select("cid"), n, 64), "cid", "left_semi")
    grams = scratch.write(grams.groupBy("cid").agg(F.first("grams").alias("grams")))
    ga, gb = grams.select(F.col("cid").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("cid").alias("b"), F.col("grams").alias("gb"))
    with arrow_rows(docs.sparkSession, 500):
        linked = scratch.write(left.join(ga, "a").join(gb, "b").select("a", "b", "ga", "gb").mapInArrow(_verifier(threshold), "a binary, b binary"))
    cells = None
    if any_hot:
        about = classes.select("cid", F.struct("lead.*", "cid").alias("node"), "sig", "copies")
        members = home.join(grams, "cid").join(about, "cid").select("g", "node", "sig", "grams", "copies")
        to = grid.select(F.col("g1").alias("g"), "g1", "g2").unionByName(grid.where("g1 != g2").select(F.col("g2").alias("g"), "g1", "g2"))
        with arrow_rows(docs.sparkSession, 2000):
            cells = scratch.write(members.join(to, "g").groupBy("g1", "g2").applyInArrow(_cell(threshold, rule), CELL))
    scratch.drop(grams, left)
    roots, counts = _components(scratch, classes, linked, cells)
    about = classes.select("cid", "lead", "copies").join(roots, "cid", "left").join(counts, "cid", "left")
    root = F.coalesce("root", F.struct("lead.*", "cid"))
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    about = about.select("cid", "lead", root["doc_id"].alias("class_id"), (root["cid"] == F.col("cid")).alias("first"), links, F.col("copies").alias("n_copies"))
    kept = (F.col("first") & F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("th") == F.col("lead.th"))).alias("kept")
    # classes of very many copies are few, so their rows meet them where they are
    about = scratch.write(about)
    limit = max(500, signed.count() // HOT_CLASSES)
    hot, rows = F.broadcast(about.where(F.col("n_copies") > limit)), signed.where("cid is not null").select("doc_id", "th", "cid")
    with_words = rows.join(hot, "cid").unionByName(rows.join(hot.select("cid"), "cid", "left_anti").join(about.where(F.col("n_copies") <= limit), "cid"))
    with_words = with_words.select("doc_id", "th", "class_id", "n_links", "n_copies", kept)
    without = signed.where("cid is null").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept"))
    return with_words.unionByName(without)


def similar_groups(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row of docs.

    class_id: the least doc_id of the row's group, the component of all links; n_links: other documents with a similarity of
    at least the threshold, copies counted; n_copies: rows with the very same set of n-grams, the row's own too. Texts of
    fewer words have one n-gram of all. Null texts and texts without words have no links and their own doc_id as class_id.
    Rows with a null doc_id take part; a group of such rows alone has a null class_id. Repeated rows are copies.
    """
    return _decided(docs, words, threshold, tolerance).select("doc_id", "class_id", "n_links", "n_copies")


def keep_first(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with one row of each group, one with the least doc_id (null ids last, then the least hash of the text); all columns kept.

    Rows are told apart by doc_id and text, so rows that share an id with other texts are documents of their own. Of rows alike
    in both, the one with the least hash of all columns stays. Rows without words are nobody's copies: all stay.
    """
    rows = Scratch(docs.sparkSession).write(_decided(docs, words, threshold, tolerance))
    gone = rows.where("not kept").select(F.col("doc_id").alias("k"), F.col("th").alias("h")).distinct()
    out = _by_row(docs, gone, "left_anti")
    again = rows.where("kept and n_copies > 1").groupBy(F.col("doc_id").alias("k"), F.col("th").alias("h")).count().where("count > 1").select("k", "h")
    if not again.take(1):
        return out
    hashed = [f"`{c.name}`" for c in docs.schema if "map<" not in c.dataType.simpleString()]
    one = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*hashed)).alias("r")
    repeated = _by_row(out, again, "left_semi").groupBy(F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h")).agg(one)
    return _by_row(out, again, "left_anti").unionByName(repeated.select("r.*"))


def _by_row(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """A semi or anti join of docs with (k, h) of its rows' doc_id and text; keys are broadcast if they are few, so that texts stay where they are."""
    keys = _limited(keys, keys.count(), 80)
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["k"]) & (F.xxhash64(docs["text"]) == keys["h"]), how)
