"""Token-ID output: shard files of a concatenated id array with Elias-Fano coded document boundaries.

Shards are cut from the documents in ascending order of doc_id, each of a bounded number of ids. A shard is written under
a temporary name and renamed, by a name that depends on its place only, so a task that runs twice writes the same file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, shared_dir

END_ID = 2
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 22
#: Bytes of text that are tokenized together.
PART_BYTES = 4 << 20
#: Words whose ids a worker keeps.
CACHE_WORDS = 300_000
MAGIC = b"LGTOKEN1"
_HEAD = struct.Struct("<8sIIqqqq")  # magic, bytes an id, null ids, documents, ids, first doc_id, bytes of the boundary section
_BLOCK = 512  # bits of the upper vector for each entry of the directory


class EliasFano:
    """A non-decreasing sequence of n integers from 0 to u in about 2 + log2(u / n) bits each.

    Lower bits are packed; upper bits are a unary bit vector with a 32-bit count for each 512 bits, by which select finds
    the i-th value without decoding those before it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).reshape(-1, _BLOCK // 8).sum(1, dtype=np.uint64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(at[-1]) + 1 if n else 1) // _BLOCK) * _BLOCK
        up = np.zeros(size, np.uint8)
        up[at] = 1
        return cls(n, bits, low, np.packbits(up, bitorder="little"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        out = np.empty(len(i), np.int64)
        for lo in range(0, len(i), 8192):
            k = i[lo : lo + 8192]
            block = np.searchsorted(self.before, k, "right") - 1
            bits = np.unpackbits(self.high.reshape(-1, _BLOCK // 8)[block], axis=1, bitorder="little")
            rank = np.cumsum(bits, axis=1, dtype=np.int32)
            inside = np.argmax(rank > (k - self.before[block].astype(np.int64))[:, None], axis=1)
            value = (block * _BLOCK + inside - k) << self.low_bits
            if self.low_bits:
                places = (k * self.low_bits)[:, None] + np.arange(self.low_bits)
                got = (self.low[places >> 3] >> (places & 7).astype(np.uint8)) & 1
                value += (got.astype(np.int64) << np.arange(self.low_bits)).sum(1)
            out[lo : lo + 8192] = value
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<qqqq", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, bits, a, b = struct.unpack_from("<qqqq", raw, at)
        at += 32
        return cls(n, bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a)), at + a + b


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard: header, boundaries (n + 1 offsets), doc ids less the first (null ids come first and are counted), ids."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    bounds = EliasFano.encode(np.concatenate(([0], np.cumsum(counts)))).to_bytes()
    names = EliasFano.encode(known - base).to_bytes()
    wide = ids.dtype.itemsize
    head = _HEAD.pack(MAGIC, wide, len(doc_ids) - len(known), len(doc_ids), len(ids), base, len(bounds) + len(names))
    return head + bounds + names + ids.astype(f"<u{wide}").tobytes()


class Shard:
    """A shard's bytes, with random access to its documents."""

    def __init__(self, raw: bytes):
        magic, wide, self.nulls, self.n_docs, self.n_ids, self.base, skip = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.bounds, at = EliasFano.from_bytes(raw, _HEAD.size)
        self.names, at = EliasFano.from_bytes(raw, at)
        self.ids = np.frombuffer(raw, f"<u{wide}", self.n_ids, _HEAD.size + skip)

    def starts(self) -> np.ndarray:
        return self.bounds.select(np.arange(self.n_docs + 1))

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.select(np.arange(self.names.n)) + self.base).tolist()

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(np.array([i, i + 1]))
        return self.ids[a:b]


#: Words, and white space between them, on which a tokenizer shows whether it cuts at white space and drops it.
PROBES, GAPS = ("a", "Word", "it's", "12", "?!", "(x)", "naïve", "日本", "-", "'s"), (" ", "\t", "\n", "\r\n", "  ", " \n ", "\x0b", "\x0c")


def splits_at_space(ids: Callable[[str], list[int]]) -> bool:
    """Whether the ids of probes joined by white space, with some about them, are the ids of the probes in order."""
    alone = {p: ids(p) for p in PROBES}
    return all(ids(f"{gap}{p}{gap}{q}{gap}") == alone[p] + alone[q] for gap in GAPS for p in PROBES for q in PROBES)


#: Marks that a word may end in, and words before them.
TAILS, STEMS = ".,;:!?", ("a", "word", "naïve", "日本", "x1", "42", "it's", "ß")


def splits_before_tails(ids: Callable[[str], list[int]]) -> bool:
    """Whether words that end in letters or digits and the marks after them have the ids of each by itself."""
    marks = (*TAILS, "..", "?!", ".,;")
    return all(ids(w + m) == ids(w) + ids(m) for w in STEMS for m in marks)


def ignores_case(ids: Callable[[str], list[int]]) -> bool:
    """Whether ASCII letters have the ids of their small ones, in and beside other letters too."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return all(ids(w) == ids(w.lower()) for w in (*capitals, capitals, "Word", "WORD's", "NAïVE", "日A", "X1", *(f"{c}{d}" for c in capitals for d in capitals)))


class BatchTokenizer:
    """Ids of many texts. With a tokenizer that cuts at white space, pieces between ASCII white space are tokenized once each, and
    the ids of a text are those of its pieces in order; with any other, whole texts are tokenized.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_piece = splits_at_space(ids) and not any(re.search(r"\s", t) for t in self.added)
        self.tails, self.any_case = self.by_piece and splits_before_tails(ids), self.by_piece and ignores_case(ids)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.tails:
            stems = [p.rstrip(TAILS) for p in pieces]
            # letters from U+0130 on may leave a mark behind in small letters, which would join the marks that follow
            stems = [s if s and s[-1].isalnum() and s[-1] < "\u0130" else p for s, p in zip(stems, pieces, strict=True)]
            tails = [p[len(s) :] for s, p in zip(stems, pieces, strict=True)]
            raw = self.raw_ids({*stems, *tails} - {""})
            raw[""] = b""
            got = [raw[s] + raw[t] for s, t in zip(stems, tails, strict=True)]
        else:
            raw = self.raw_ids(set(pieces))
            got = [raw[p] for p in pieces]
        counts = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        return np.frombuffer(b"".join(got), self.dtype), counts

    def raw_ids(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word, as bytes; those that were seen before are kept, up to CACHE_WORDS."""
        known = self.known
        out = {w: known[w] for w in words if w in known}
        new = [w for w in words if w not in out]
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), self.dtype, int(sizes.sum())).tobytes()
            ends = (np.cumsum(sizes) * self.dtype.itemsize).tolist()
            out.update(zip(some, (flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        for w in new[: max(0, CACHE_WORDS - len(known))]:
            known[w] = out[w]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), one after another, and their number for each."""
        if not self.by_piece:
            got = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            counts = np.array([len(e.ids) for e in got], np.int64)
            return np.fromiter((i for e in got for i in e.ids), self.dtype, int(counts.sum())), counts
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        per = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = split.flatten()
        coded = (pc.ascii_lower(flat) if self.any_case else flat).dictionary_encode()
        if self.any_case and any(pc.any(pc.match_substring(coded.dictionary, t)).as_py() for t in self.added):
            coded = flat.dictionary_encode()  # what reads as an added token in small letters need not be one
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, counts = self.piece_ids(coded.dictionary.to_pylist())
        if not len(which):
            return np.empty(0, self.dtype), np.zeros(len(per), np.int64)
        n = counts[which]
        ends = np.cumsum(n)
        firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))[which]
        out = ids[np.arange(int(ends[-1])) + np.repeat(firsts - (ends - n), n)]
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per)))]
        return out, np.diff(upto)


@lru_cache(maxsize=2)
def batch_tokenizer(path: str) -> BatchTokenizer:
    return BatchTokenizer(path)


def text_parts(texts: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size):
        part = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        yield from zip(edges[:-1], edges[1:], strict=True)


def settle(store, mine: str, final: str) -> None:
    """Renames a written file; where the name is taken by an earlier try of the same task, whose bytes are the same, that one stays."""
    from pyarrow import fs

    try:
        store.move(mine, final)
    except OSError:
        if store.get_file_info(final).type != fs.FileType.File:
            raise
        store.delete_file(mine)


MANIFEST = "part int, seq int, name string, n_docs long, n_ids long"


def _writer(folder: str, path: str, end_id: int | None, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, seq = task.partitionId(), 0
        coder = batch_tokenizer(path)
        docs, counts, arrays, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal docs, counts, arrays, held, seq
            name = f"{part:07d}-{seq:05d}.tokens"
            mine = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(mine) as out:
                out.write(shard_bytes(docs, np.concatenate(counts), np.concatenate(arrays)))
            settle(store, mine, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "name": [name], "n_docs": [len(docs)], "n_ids": [held]})
            docs, counts, arrays, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for lo, hi in text_parts(batch.column("text")):
                ids, per = coder.encode(batch.column("text")[lo:hi])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(per), end_id)
                    per = per + 1
                docs += batch.column("doc_id")[lo:hi].to_pylist()
                counts.append(per)
                arrays.append(ids)
                held += len(ids)
                if held >= shard_ids:
                    yield close()
        if docs:
            yield close()

    return write


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the documents' ids to shards under folder, in ascending doc_id (null first, ties by text); returns the manifest.

    Null and empty texts have the end id only. An empty table writes nothing. The folder must be one that all executors see.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(ordered.mapInArrow(_writer(folder, vocabulary, end_id, shard_ids), MANIFEST))


def shard_offsets(manifest: DataFrame) -> DataFrame:
    """name and ids before it, of each shard. The one-partition window has a row for each write task."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = manifest.select("part", "name", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("__at"))
    return rows.join(parts, rows["part"] == parts["__part"]).select("name", (F.col("__base") + F.col("__at")).alias("before"))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, before in zip(batch.column("content"), batch.column("before").to_pylist(), strict=True):
            shard = Shard(raw.as_buffer())
            starts = shard.starts()
            wide = shard.ids.astype("<u4").tobytes()
            crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids(), pa.int64()), "start": pa.array(starts[:-1] + before), "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array(crc, pa.int64())})


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("__name"), "content")
    rows = files.join(F.broadcast(shard_offsets(manifest)) if manifest.count() < 100_000 else shard_offsets(manifest), F.col("__name") == F.col("name"))
    return rows.select("content", "before").mapInArrow(_read_shards, READ)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark reads it by, so that Python writes to the same store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^(\w+):/(?!/)", r"\1:///", full)


def token_offsets(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the documents to a new folder in the shared one and reads them back."""
    spark = docs.sparkSession
    folder = qualified(spark, f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")
    manifest = write_token_files(docs, folder, vocabulary, end_id, shard_ids)
    if not manifest.take(1):
        return spark.createDataFrame([], READ)
    return read_token_files(spark, folder, manifest)
