"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a temporary one where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one run, written as Parquet to a folder of their own in the shared folder: a plan goes on from them when
    executors are lost, and those that nothing reads any more can be dropped."""

    #: Folders of this application, those that were cleared left out.
    held: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", {}
        self.held.append(self.folder)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)  # the frame is held, so that its id stays its own
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            remove(self.spark, self.paths[id(df)][1])

    def clear(self) -> None:
        """Deletes all that was written: nothing may read it any more."""
        remove(self.spark, self.folder)
        if self.folder in self.held:
            self.held.remove(self.folder)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """What Scratch wrote within this is deleted at its end, when results that read it have been written elsewhere."""
    before = len(Scratch.held)
    try:
        yield
    finally:
        for folder in Scratch.held[before:]:
            remove(spark, folder)
        del Scratch.held[before:]


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], scratch: Scratch, spread: int = 20_000, least: int = 1000) -> DataFrame:
    """Inner join of rows, a written table, with a table that has one row a key; written too. Keys of more than one row in `spread`
    (and more than `least`) are at most `spread`: what the table has of them is broadcast, so a hot key's rows stay where they are."""
    n = rows.count()
    most = max(least, n // spread)
    if n <= most:
        return scratch.write(rows.join(table, on))
    hot = scratch.write(rows.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > most))
    marked = rows.join(F.broadcast(hot.withColumn("__n", F.lit(1))), on, "left")
    common = rows.join(F.broadcast(table.join(F.broadcast(hot.drop("__n")), on, "left_semi")), on)
    return scratch.write(common.unionByName(marked.where(F.col("__n").isNull()).drop("__n").join(table, on)))


def ranked(df: DataFrame, keys: list[str], order: list[Column], top: int, name: str = "rank", parts: int = 32) -> DataFrame:
    """The first `top` rows of each key with their rank. Ranks are first taken within parts of a key, so that what meets in one task
    is at most parts * top rows of a key, however many tasks hold them."""
    part = free_name("part", df.columns)
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    first = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))).where(F.col(name) <= top)
    return first.drop(name, part).withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= top)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that none of those taken has, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within this, batches to Python have at most so many rows: for rows of many kilobytes, in actions that run to their end inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


# ---- word hashes, for whole batches of texts at once ----

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit integers: every input bit changes every output bit with a chance near one half."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        k = 1
        while k < len(out):  # doubling: the second half is the first times base ** k
            step = np.uint64(pow(base, k, 1 << 64))
            m = min(k, len(out) - k)
            out[k : k + m] = out[:m] * step
            k += m
        _POWERS[name] = have = out
    return have


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, in order, and the words' number for each text.

    A word is a longest run of ASCII letters and digits and of all characters beyond ASCII, after lower-casing.
    Each text is one buffer; a word's hash is a difference of prefix sums of byte * base ** position, brought to
    position 0 and mixed, so that no word is ever made a Python object.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[1:] = _WORD_BYTE[buf]
    edge = np.diff(inside)  # 1 where a word begins
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)  # the last byte is a separator
    ends_at = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    out = np.empty(len(start), np.uint64)
    step = 1 << 19  # bytes at a time: the prefix sums of a part need 8 times its bytes
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + step)))
        a, b = start[lo], end[hi - 1]
        n = int(b - a)
        powers = _powers("up", int(_ODD), n + 1)
        back = _powers("down", _inverse(int(_ODD)), n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf[a:b].astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = (total[e] - total[s]) * back[s]
        lo = hi
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends_at))))
    return mix64(out), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within each text, and their number for each text; fewer than n words: one run of all."""
    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    if not len(words):
        return np.empty(0, np.uint64), per
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    total = int(per.sum())
    owner = np.repeat(np.arange(len(counts)), per)
    at = np.arange(total) - np.repeat(np.cumsum(per) - per, per) + first[owner]
    length = np.minimum(counts, n)[owner]
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h = mix64(h * _ODD + padded[at + k] * (length > k) + np.uint64(k + 1))
    return h, per
