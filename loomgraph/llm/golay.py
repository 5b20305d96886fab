"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most two bits agree in one segment at least,
and the segment after it holds at most two errors. The binary Golay code takes that segment to a few codeword indices: those of
the codewords to which it, and each word one bit away from it, is decoded. Two segments that differ in at most two bits have a
word between them that is within one bit of both, so they share an index. A key is the segment that agrees and an index.

Fingerprints that share a key are compared in buckets of at most BUCKET members. Those of larger buckets meet once more on the
words within one bit of them, 65 each: such a bucket has 65 members at most, so no bucket is ever larger than a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, free_name
from loomgraph.llm.graph import components

#: Words of a shingle, seed of their hashes, and bits in which linked fingerprints differ at most.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: The segments of a fingerprint: first bit and length. The last two words of the code's 23 bits that they leave free are zero.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Largest bucket in which fingerprints are compared with each other; with more, 65 words a fingerprint cost less.
BUCKET = 64
#: A class of copies or a bucket with more than one row in so many goes by a broadcast of at most that many rows.
SPREAD = 20_000
_STEP = 100_000
# Fixed value: the generator polynomial of the binary Golay code (23, 12, 7).
GENERATOR = 0b101011100011


# ---- fingerprints ----


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Eight bytes, big-endian. A bit is one if it is set in over half the XXH64 of the text's shingles, repeats included.

    A-Z are lower-cased; words are what white space (of ASCII) parts. Fewer words than a shingle has: one of all; none: zeros.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and ASCII's white space alone
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), max(len(raw) - words + 1, min(len(raw), 1))
    for lo in range(0, n, _STEP):
        part = raw[lo : lo + _STEP + words - 1]
        shingles = zip(*(part[k:] for k in range(words))) if len(part) >= words else [part]  # noqa: B905
        h = np.frombuffer(b"".join([digest(b" ".join(s), seed) for s in shingles]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n)


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE, seed: int = SEED, id: str = "doc_id") -> DataFrame:
    """id and fp (long) of every row of docs; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint8).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(">i8").ravel().astype(np.int64))], ["id", "fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp long")


# ---- keys ----


def syndrome(v: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= ((v >> bit) & 1) * (GENERATOR << (bit - 11))
    return v


@cache
def errors() -> np.ndarray:
    """The error of each of the 2,048 syndromes: the code is perfect, every word is within three bits of one codeword."""
    out = np.zeros(2048, np.int32)
    one = 1 << np.arange(23, dtype=np.int32)
    two = (one[:, None] ^ one[None, :])[np.triu_indices(23, 1)]
    three = (two[:, None] ^ one[None, :]).ravel()
    for e in (three[np.bitwise_count(three) == 3], two, one):
        out[syndrome(e)] = e
    return out


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The index (the twelve message bits) of the codeword that each 23-bit word is decoded to."""
    return (v ^ errors()[syndrome(v)]) >> 11


def indices(segment: np.ndarray, bits: int) -> np.ndarray:
    """[word, bits + 1]: the indices of each word and of the words one of its bits away, each once, else -1."""
    flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int32))).astype(np.int32)
    out = np.sort(codeword_index(segment[:, None] ^ flips[None, :]), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all fingerprints: the number of the segment that agrees, that segment, and an index of the one after it."""
    u = fp.view(np.uint64)
    part = [((u >> np.uint64(64 - first - n)) & np.uint64((1 << n) - 1)).astype(np.int32) for first, n in SEGMENTS]
    rows, found = [], []
    for k in range(3):
        after = (k + 1) % 3
        index = indices(part[after], SEGMENTS[after][1])
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        found.append((np.int64(k) << 34) | (part[k][row].astype(np.int64) << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(found)


def keyed(fps: DataFrame) -> DataFrame:
    """key and fp of the distinct fingerprints of fps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key = keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


# ---- links ----


def _pairs(rows: DataFrame, key: str, radius: int) -> DataFrame:
    """u < v of the fingerprints that share a key, in buckets of bounded size, and differ in at most radius bits."""
    met = rows.groupBy(key).agg(F.sort_array(F.collect_list("fp")).alias("m")).where(F.size("m") > 1)
    each = met.select("m", F.posexplode("m").alias("i", "u"))
    near = F.filter(F.slice("m", F.col("i") + 2, F.greatest(F.size("m") - F.col("i") - 1, F.lit(0))), lambda v: F.bit_count(v.bitwiseXOR(F.col("u"))) <= radius)
    return each.select("u", F.explode(near).alias("v"))


def links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET, spread: int = SPREAD) -> DataFrame:
    """u < v: all pairs of the distinct fingerprints of fps that differ in at most radius (0 to 2) bits; a pair may be there twice."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius {radius} is not one of 0 to {RADIUS}")
    rows = scratch.write(keyed(fps))
    sizes = scratch.write(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    small = _pairs(rows.join(sizes.where(F.col("n") <= bucket).select("key"), "key"), "key", radius)
    # of the larger buckets, the largest are few and broadcast, so that none is one task's
    total = rows.count()
    most = max(bucket, total // spread)
    largest = sizes.where(F.col("n") > most).select("key")
    large = sizes.where((F.col("n") > bucket) & (F.col("n") <= most)).select("key")
    crowded = rows.join(F.broadcast(largest), "key", "left_semi").unionByName(rows.join(large, "key", "left_semi")).select("fp").distinct()
    near = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")) for b in range(64))]
    words = crowded.select("fp", F.explode(F.array(*near)).alias("word"))
    return small.unionByName(_pairs(words, "word", radius))


def near_groups(docs: DataFrame, text: str = "text", radius: int = RADIUS, words: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET, spread: int = SPREAD) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of docs: the least doc_id that is reached by links of at most radius bits.

    Null and empty texts have the fingerprint zero and are linked like any other. A row with a null doc_id links as others do
    and is never the least; a component of such rows alone has a null component_id. Repeated rows stay. An empty table: no rows.
    """
    scratch, inner = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(docs, text, words, seed))
    classes = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = components(links(classes, inner, radius, bucket, spread), scratch)
    inner.clear()
    own = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    found = scratch.write(own.join(least, "root").select("fp", "component_id", "n"))
    # classes of very many copies are few: their rows stay where they are
    most = max(1000, rows.count() // spread)
    common = found.where(F.col("n") > most).select("fp", "component_id", F.lit(True).alias("common"))
    marked = rows.join(F.broadcast(common), "fp", "left")
    kept = marked.where("common").select("id", "fp", "component_id")
    other = marked.where(F.col("common").isNull()).select("id", "fp").join(found.where(F.col("n") <= most).select("fp", "component_id"), "fp")
    return kept.unionByName(other.select("id", "fp", "component_id")).withColumnRenamed("id", "doc_id")


def drop_near_copies(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without those that a document of a smaller doc_id is linked to; rows with a null doc_id go if any other is in their component."""
    name = free_name("component", docs.columns)
    groups = near_groups(docs, text, radius).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(groups, docs["doc_id"].eqNullSafe(groups[name]), "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
