"""A Bloom filter as a table of blocks, so that rows which meet nothing are dropped where they are, before a shuffle join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 256 bits (four longs): 16 MB as rows at most, 12 bits each for 5.6 million keys. More keys let more rows through.
BLOCKS = 1 << 18


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS).cast("long"))


def _masks(key: Column) -> list[Column]:
    """Two bits in each of four longs, from a second hash."""
    h, one = F.xxhash64(key, F.lit("bits")), F.lit(1).cast("long")
    bit = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(8)]
    return [bit[2 * j].bitwiseOR(bit[2 * j + 1]) for j in range(4)]


def bloom(keys: DataFrame) -> DataFrame:
    """The filter of a table's only column: a row for each block that holds a key, to be broadcast whatever the number of keys."""
    key = F.col(keys.columns[0])
    rows = keys.select(_block(key).alias("__block"), *(m.alias(f"__m{j}") for j, m in enumerate(_masks(key))))
    return F.broadcast(rows.groupBy("__block").agg(*(F.bit_or(f"__m{j}").alias(f"__w{j}") for j in range(4))))


def possible(rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """Rows whose key may be in the filter; null keys are not."""
    met = rows.where(F.col(key).isNotNull()).withColumn("__block", _block(F.col(key))).join(held, "__block")
    for j, m in enumerate(_masks(F.col(key))):
        met = met.where(F.col(f"__w{j}").bitwiseAND(m) == m)
    return met.select(*rows.columns)
