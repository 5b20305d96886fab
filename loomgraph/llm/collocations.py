"""Phrase collocation mining by best-first branch and bound.

A phrase a times as frequent as chance is scored by its weakest cut. A phrase that starts with a prefix p is no more frequent
than p, and what follows its first word u no less frequent than itself; so its score is at most f(p) / f(u), a bound that the
prefix alone gives. All frequent words are extended first. Of their pairs, those whose bound, or whose own score, reaches the
score that the frontier has come to are extended next: every phrase of at least that score is then counted, and so is each
longer one that can take a pair's place. The frontier moves on, best bounds first, until each language has as many phrases that
stay as are asked for at or above it.

Counts are of whole texts. What a pass over the texts counts is chosen by Bloom filters of bounded size, which let a few more
through; all that counts is joined exactly afterwards, so results do not depend on the filters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, ranked, spread_join

#: Phrases of a language, least frequency, and the percentage of its occurrences in a longer phrase at which a phrase goes.
TOP, LEAST, WITHIN = 2000, 10, 50
#: Scores are whole numbers of this.
UNIT = 1_000_000
#: Words that are counted together, and the most bits of a filter.
TOKENS, BITS = 2_000_000, 1 << 27
UNKNOWN = "und"
_PART = 4_000_000
# Fixed value: what ends a piece.
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, A-Z lower-cased, with b"." between pieces and at the end; a long text's in several lists."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
    at = 0
    while at < len(raw):
        cut = _END.search(raw, at + _PART)
        end = cut.end() if cut else len(raw)
        out = _END.sub(b" . ", raw[at:end]).split()  # of the white space that is left, space and tab alone
        out.append(b".")
        yield out
        at = end


# ---- filters ----


@dataclass
class Filter:
    """A Bloom filter of 64-bit hashes, two bits each."""

    bits: int
    held: np.ndarray

    @classmethod
    def of(cls, hashes: DataFrame, most: int = BITS) -> Filter:
        """Of the column h. Its bits are joined by Spark; the driver gets at most most / 64 numbers."""
        n = hashes.count()
        bits = min(most, 1 << max(10, (16 * n).bit_length()))
        low = F.col("h").bitwiseAND(bits - 1)
        high = F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1)
        at = hashes.select(F.explode(F.array(low, high)).alias("p"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))
        rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).toPandas()
        held = np.zeros(bits // 64, np.uint64)
        held[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
        return cls(bits, held)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in (h & np.uint64(self.bits - 1), (h >> np.uint64(32)) & np.uint64(self.bits - 1)):
            out &= (self.held[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def word_hash(word: str) -> Column:
    """XXH64 of a word, with that of its language as seed."""
    return F.xxhash64("lang", word)


def pair_hash(u: str, v: str) -> Column:
    h = word_hash(v)
    return word_hash(u).bitwiseXOR(F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63)))


# ---- counting ----


def _counted(lang: str, ids: np.ndarray, names: list[bytes], size: int, frequent: Filter | None, prefixes: Filter | None, suffixes: Filter | None) -> pa.RecordBatch:
    """Runs of `size` words (number 0 ends a piece), each with its occurrences."""
    v = len(names)
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    own = np.array([xxhash.xxh64_intdigest(w, seed) for w in names], np.uint64)
    inside = np.ones(v, bool) if frequent is None else frequent.has(own)
    inside[0] = False
    if size == 1:
        n = np.bincount(ids, minlength=v) * inside
        one = np.flatnonzero(n)
        found, n = [one], n[one]
    else:
        ok = inside[ids[:-1]] & inside[ids[1:]]
        pair = ids[:-1].astype(np.int64) * v + ids[1:]
        if size == 2:
            key, n = np.unique(pair[ok], return_counts=True)
            found = [key // v, key % v]
        else:
            whole = np.flatnonzero(ok[:-1] & ok[1:])
            turned = (own << np.uint64(1)) | (own >> np.uint64(63))
            hashes = lambda at: own[ids[at]] ^ turned[ids[at + 1]]
            first = whole[prefixes.has(hashes(whole)) | suffixes.has(hashes(whole + 1))]
            key, at = np.unique(pair[first], return_inverse=True)
            three, n = np.unique(at * v + ids[first + 2], return_counts=True)
            both = key[three // v]
            found = [both // v, both % v, three % v]
    table = pa.array(names, pa.binary())
    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(n)), *(table.take(pa.array(f)) for f in found), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", *"uvw"[:size], "n"])


def grams(docs: DataFrame, size: int, frequent: Broadcast | None = None, prefixes: Broadcast | None = None, suffixes: Broadcast | None = None) -> DataFrame:
    """lang, the words u (v, w) and n of runs of one, two or three words within pieces: of words that the filter `frequent` has,
    and of three only where one of the filters has the first two or the last two."""
    get = lambda b: None if b is None else b.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [get(b) for b in (frequent, prefixes, suffixes)]
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        tokens: dict[str, int] = {}

        def counted(lang: str) -> pa.RecordBatch:
            number, parts = held.pop(lang)
            tokens.pop(lang)
            return _counted(lang, np.concatenate(parts), list(number), size, *filters)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for part in words(text.as_py()):
                    number, parts = held.setdefault(lang, ({b".": 0}, []))
                    parts.append(np.array([number.setdefault(w, len(number)) for w in part], np.int32))
                    tokens[lang] = tokens.get(lang, 0) + len(part)
                    if tokens[lang] > TOKENS:
                        yield counted(lang)
            while sum(tokens.values()) > 2 * TOKENS:  # of many languages
                yield counted(max(tokens, key=tokens.get))
        for lang in list(held):
            yield counted(lang)

    own = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    columns = "".join(f"{c} binary, " for c in "uvw"[:size])
    return own.mapInArrow(run, f"lang string, {columns}n long").groupBy("lang", *"uvw"[:size]).agg(F.sum("n").alias("n"))


# ---- scores ----


def score(a: Column, l: Column, r: Column, unit: int = UNIT) -> Column:  # noqa: E741
    """floor(unit * a * a / (l * r)), exactly, for counts under 10 ** 14."""
    whole = lambda c, digits=14: c.cast(f"decimal({digits},0)")
    return F.call_function("div", whole(F.lit(unit), 7) * whole(a) * whole(a), whole(l) * whole(r))


def _pairs(two: DataFrame, one: DataFrame, scratch: Scratch) -> DataFrame:
    """two with l, r, score, and the bound of what it is a prefix of: floor(unit * f(u v) / f(u))."""
    side = lambda w, n: one.select("lang", F.col("u").alias(w), F.col("n").alias(n))
    both = spread_join(spread_join(two, side("u", "l"), ["lang", "u"], scratch), side("v", "r"), ["lang", "v"], scratch)
    return both.withColumn("score", score(F.col("n"), F.col("l"), F.col("r"))).withColumn("bound", score(F.col("n"), F.col("l"), F.col("n")))


def _threes(three: DataFrame, two: DataFrame, one: DataFrame, scratch: Scratch) -> DataFrame:
    """three with l, r and score of the cut that scores lowest, the first of equals."""
    out = three
    for words_, name, table in ((["u"], "l1", one), (["v", "w"], "r1", two), (["u", "v"], "l2", two), (["w"], "r2", one)):
        of = table.select("lang", *(F.col(have).alias(want) for have, want in zip("uv", words_, strict=False)), F.col("n").alias(name))
        out = spread_join(out, of, ["lang", *words_], scratch)
    cuts = [F.struct(score(F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    return out.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "u", "v", "w", "n", "cut.l", "cut.r", "cut.score")


def _limits(scored: DataFrame, k: int) -> DataFrame:
    """lang and limit: a score that k pairs of the language reach, and few more, or 0 where there are fewer. Scores are counted by
    steps of one per cent, so what meets in a task is as many rows as there are steps."""
    step = F.floor(F.log2(F.col("score") + 1) * 64)
    steps = scored.groupBy("lang", step.alias("step")).agg(F.count("*").alias("c"), F.min("score").alias("least"))
    so_far = steps.withColumn("c", F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("step"))))
    return so_far.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("c") >= k, F.col("least"))), F.lit(0)).alias("limit"))


def phrases(docs: DataFrame, top: int = TOP, least: int = LEAST, within: int = WITHIN, step: int = 2) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of two and three words of each language by score, frequency
    and phrase, that occur `least` times, but those of which `within` per cent are in a longer one.

    Null lang: und. Null and empty texts have no words; repeated rows count again; an empty table has no phrases. `step`: the
    frontier starts at the step * top-th pair of a language, and takes four times as many each time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    every = scratch.write(grams(docs, 1))
    totals = scratch.write(every.groupBy("lang").agg(F.sum("n").alias("all")))
    one = scratch.write(every.where(F.col("n") >= least))
    frequent = _shared(spark, one.select(word_hash("u").alias("h")))
    two = scratch.write(grams(docs, 2, frequent).where(F.col("n") >= least))
    pairs = scratch.write(_pairs(two, one, scratch))
    left, found, k = docs.withColumn("lang", F.coalesce("lang", F.lit(UNKNOWN))).select("lang", "text"), None, step * top
    open_ = totals.select("lang")
    while True:
        limits = scratch.write(_limits(pairs.join(open_, "lang", "left_semi"), k))
        reached = pairs.join(F.broadcast(limits), "lang")
        prefixes = reached.where(F.col("bound") >= F.col("limit"))
        suffixes = reached.where(F.col("score") >= F.col("limit"))
        filters = [frequent, *(_shared(spark, e.select(pair_hash("u", "v").alias("h"))) for e in (prefixes, suffixes))]
        three = scratch.write(grams(left, 3, *filters).where(F.col("n") >= least))
        longer = _threes(three, two, one, scratch).join(F.broadcast(limits), "lang").where(F.col("score") >= F.col("limit"))
        parts = three.select("lang", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("p"), F.col("n").alias("m"))
        most = parts.groupBy("lang", "p.u", "p.v").agg(F.max("m").alias("m"))
        stay = suffixes.join(most, ["lang", "u", "v"], "left").where(F.col("m").isNull() | (100 * F.col("m") < within * F.col("n")))
        of = lambda df, *w: df.select("lang", F.concat_ws(" ", *(F.col(x).cast("string") for x in w)).alias("phrase"), "n", "l", "r", "score")
        both = of(stay, "u", "v").unionByName(of(longer, "u", "v", "w"))
        best = scratch.write(ranked(both, ["lang"], [F.desc("score"), F.desc("n"), F.col("phrase")], top))
        enough = best.groupBy("lang").agg(F.count("*").alias("c")).where(F.col("c") >= top)
        settled = scratch.write(limits.join(enough, "lang", "left").where((F.col("limit") == 0) | F.col("c").isNotNull()).select("lang"))
        done = best.join(F.broadcast(settled), "lang", "left_semi")
        found = done if found is None else found.unionByName(done)
        open_ = scratch.write(limits.select("lang").join(settled, "lang", "left_anti"))
        for b in filters[1:]:
            b.unpersist()
        if open_.isEmpty():
            break
        k, left = 4 * k, left.join(F.broadcast(open_), "lang", "left_semi")
    named = found.join(F.broadcast(totals), "lang")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("all").alias("n"), "score")


def _shared(spark: SparkSession, hashes: DataFrame) -> Broadcast:
    return spark.sparkContext.broadcast(Filter.of(hashes))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p),
g1 AS (SELECT lang, w[i] AS u, count(*)::HUGEINT AS n FROM i GROUP BY ALL),
g2 AS (SELECT lang, w[i] AS u, w[i + 1] AS v, count(*)::HUGEINT AS n FROM i WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, w[i] AS u, w[i + 1] AS v, w[i + 2] AS x, count(*)::HUGEINT AS n FROM i WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(n) AS total FROM g1 GROUP BY lang),
c2 AS (SELECT g2.lang, g2.u || ' ' || g2.v AS phrase, g2.n AS a, l.n AS l, r.n AS r, (1000000 * g2.n * g2.n) // (l.n * r.n) AS score
    FROM g2 JOIN g1 l ON l.lang = g2.lang AND l.u = g2.u JOIN g1 r ON r.lang = g2.lang AND r.u = g2.v
    WHERE NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND g3.u = g2.u AND g3.v = g2.v AND 100 * g3.n >= 50 * g2.n)
    AND NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND g3.v = g2.u AND g3.x = g2.v AND 100 * g3.n >= 50 * g2.n)),
cut AS (SELECT g3.lang, g3.u || ' ' || g3.v || ' ' || g3.x AS phrase, g3.n AS a, l1.n AS l1, r1.n AS r1, l2.n AS l2, r2.n AS r2,
    (1000000 * g3.n * g3.n) // (l1.n * r1.n) AS s1, (1000000 * g3.n * g3.n) // (l2.n * r2.n) AS s2
    FROM g3 JOIN g1 l1 ON l1.lang = g3.lang AND l1.u = g3.u JOIN g2 r1 ON r1.lang = g3.lang AND r1.u = g3.v AND r1.v = g3.x
    JOIN g2 l2 ON l2.lang = g3.lang AND l2.u = g3.u AND l2.v = g3.v JOIN g1 r2 ON r2.lang = g3.lang AND r2.u = g3.x),
c3 AS (SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, least(s1, s2) AS score FROM cut),
c AS (SELECT * FROM c2 UNION ALL SELECT * FROM c3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
