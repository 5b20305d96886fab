"""Document fingerprints: SimHash of word pairs, and permuted block tables to find those within a Hamming radius.

Every occurrence of a term votes with the bits of its hash, so a term weighs as often as it occurs. Texts cross to Python in
Arrow batches; one range shuffle by doc_id brings each document beside the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, mix64, shingle_hashes, word_hashes

#: Words of a term, bits of a fingerprint (a multiple of 64).
TERM_WORDS, BITS = 2, 128
#: Hamming radius, and the blocks of all bits: a pair within the radius agrees in blocks - radius of them at least.
RADIUS, BLOCKS = 3, 5
_STEP = 100_000


def simhash(texts: list[str | None], term_words: int = TERM_WORDS, bits: int = BITS) -> np.ndarray:
    """Fingerprints as big-endian bytes [text, bits / 8]. A bit is set if more occurrences have it than not; no words: zeros."""
    words, counts = word_hashes(texts)
    terms, per = shingle_hashes(words, counts, term_words)
    ends = np.concatenate(([0], np.cumsum(per)))
    out = np.zeros((len(texts), bits // 8), np.uint8)
    some = np.flatnonzero(per)
    for w in range(bits // 64):
        h = (terms if not w else mix64(terms + np.uint64(w))).byteswap().view(np.uint8).reshape(-1, 8)
        ones = np.zeros((len(texts), 64), np.int64)
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(ends[some], ends[some[lo]] + _STEP)))
            a, b = ends[some[lo]], ends[some[hi - 1] + 1]
            for at in range(int(a), int(b), 16 * _STEP):  # a long text in parts
                stop = min(int(b), at + 16 * _STEP)
                starts = np.maximum(ends[some[lo:hi]], at)
                mine = np.flatnonzero((starts < stop) & (ends[some[lo:hi] + 1] > at))
                ones[some[lo + mine]] += np.add.reduceat(np.unpackbits(h[at:stop], axis=1), starts[mine] - at, axis=0, dtype=np.int32)
            lo = hi
        out[:, 8 * w : 8 * w + 8] = np.packbits(2 * ones > per[:, None], axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bits that two arrays of fingerprints have alike."""
    return 1 - np.bitwise_count(a ^ b).sum(1, dtype=np.int64) / (8 * a.shape[1])


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(text: str, after: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


def _rows(ids: list, texts: list[str], afters: list[str], term_words: int, bits: int) -> pa.RecordBatch:
    edited = [_edit(t, a) for t, a in zip(texts, afters, strict=True)]
    n = len(texts)
    own, changed, following = simhash(texts, term_words, bits), simhash(edited, term_words, bits), simhash(afters[-1:], term_words, bits)
    # the next document's text is mostly the next row's
    same = np.array([i + 1 < n and afters[i] is texts[i + 1] for i in range(n)])
    after = np.concatenate((own[1:], following))
    odd = [i for i in range(n - 1) if not same[i]]
    if odd:
        after[odd] = simhash([afters[i] for i in odd], term_words, bits)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": [bytes(x).hex() for x in own],
        "edited_fingerprint": [bytes(x).hex() for x in changed],
        "near_edited": likeness(own, changed),
        "near_next": likeness(own, after),
    })


def _pairs(term_words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: part, extra, id, text
        ids, texts, afters, size = [], [], [], 0
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True)
            for part, extra, doc_id, text in rows:
                text = text or ""
                if held is not None and held[0] == part:
                    ids.append(held[2])
                    texts.append(held[3])
                    afters.append(text)
                    size += len(text)
                    if size > 3_000_000:
                        yield _rows(ids, texts, afters, term_words, bits)
                        ids, texts, afters, size = [], [], [], 0
                held = None if extra else (part, extra, doc_id, text)
        if ids:
            yield _rows(ids, texts, afters, term_words, bits)

    return run


def fingerprint_rows(docs: DataFrame, term_words: int = TERM_WORDS, bits: int = BITS) -> DataFrame:
    """Every document with its own fingerprint, its edited text's, and their likeness and that to the next document's.

    Order: doc_id, null first, then a hash of the text; after the last comes the first. Null texts are empty. The order is cut
    at quantiles of doc_id; the document at each cut goes twice, as the first of its part and as what follows the part before.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.coalesce("doc_id", F.lit(least).cast("long")))
    shares = [i / (3 * n) for i in range(1, 3 * n)]
    first, cuts = own.agg(F.min("k"), F.percentile_approx("k", shares, F.lit(20_000))).first()
    if first is None:
        return spark.createDataFrame([], ROW)
    cuts = sorted({c for c in cuts if c > first})
    row = own.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("extra", F.lit(False))
    part = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c <= F.col("k"))) if cuts else F.lit(0)
    body = row.withColumn("part", part)
    heads = row.where(F.col("k").isin([first, *cuts])).groupBy("k").agg(F.min_by("text", F.struct("h", "text")).alias("text"))
    before = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c < F.col("k"))) if cuts else F.lit(0)
    at = F.when(F.col("k") == first, len(cuts)).otherwise(before)
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "k", F.lit(0).cast("long").alias("h"), F.lit(True).alias("extra"), at.alias("part"))
    both = body.unionByName(heads).repartition(n, "part").sortWithinPartitions("part", "extra", "k", "h", "text")
    return both.select("part", "extra", "doc_id", "text").mapInArrow(_pairs(term_words, bits), ROW)


# ---- search within a radius ----


def block_keys(fingerprint: Column, radius: int = RADIUS, blocks: int = BLOCKS, bits: int = BITS) -> Column:
    """array<struct<t, key>>: for each choice of blocks - radius of the blocks, the table's number and the digits of those blocks.

    This is the fingerprint (hexadecimal) with the chosen blocks permuted to the front, cut after them.
    """
    edges = [round(bits // 4 * i / blocks) for i in range(blocks + 1)]
    part = [F.substring(fingerprint, a + 1, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    chosen = combinations(range(blocks), blocks - radius)
    return F.array(*(F.struct(F.lit(t).alias("t"), F.concat(*(part[b] for b in c)).alias("key")) for t, c in enumerate(chosen)))


def distance(a: Column, b: Column, bits: int = BITS) -> Column:
    """Bits in which two hexadecimal fingerprints differ."""
    number = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("long")
    parts = [F.bit_count(number(a, at).bitwiseXOR(number(b, at))) for at in range(1, bits // 4 + 1, 8)]
    return sum(parts[1:], parts[0])


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bits: int = BITS) -> DataFrame:
    """q and f (distinct hexadecimal fingerprints of either table's column `fp`) that differ in at most radius of all bits, each pair
    once, and their distance.

    Two that differ in so few bits agree in blocks - radius blocks at least, so they meet in a table; a pair is taken from the
    first in which it does. Many copies of a fingerprint are one row here.
    """
    keys = lambda name: F.explode(block_keys(F.col(name), radius, blocks, bits)).alias("b")
    q = queries.select(F.col("fp").alias("q")).distinct().select("q", keys("q")).select("q", "b.t", "b.key")
    f = fingerprints.select(F.col("fp").alias("f")).distinct().select("f", keys("f")).select("f", "b.t", "b.key")
    met = q.join(f, ["t", "key"]).withColumn("distance", distance(F.col("q"), F.col("f"), bits)).where(F.col("distance") <= radius)
    a, b = block_keys(F.col("q"), radius, blocks, bits), block_keys(F.col("f"), radius, blocks, bits)
    first = F.array_min(F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.when(z["a"] == z["b"], z["a"]["t"])), lambda t: t.isNotNull()))
    return met.where(F.col("t") == first).select("q", "f", "distance")


def fingerprint_report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint_rows, with near_docs: for documents whose id is divisible by 100, the other documents within the radius; null for others."""
    rows = cut(fingerprint_rows(docs))
    fp = F.col("fingerprint").alias("fp")
    asked = F.col("doc_id") % 100 == 0
    copies = rows.groupBy(fp).agg(F.count("*").alias("copies"))
    near = within_radius(rows.where(asked).select(fp), copies, radius).join(copies.withColumnRenamed("fp", "f"), "f").groupBy(F.col("q").alias("fingerprint")).agg(F.sum("copies").alias("n"))
    joined = rows.where(asked).join(near, "fingerprint").withColumn("near_docs", F.col("n") - 1).select(*rows.columns, "near_docs")
    return joined.unionByName(rows.where(F.col("doc_id").isNull() | ~asked).withColumn("near_docs", F.lit(None).cast("long")))
