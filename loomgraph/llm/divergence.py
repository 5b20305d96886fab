"""Source divergence audit: how far the words of each source are from those of the other sources, and of all, of its language.

The terms that a language keeps are its vocabulary: a minimal acyclic transducer, built from the sorted terms, that gives each
its lexicographic ordinal. A vocabulary may be of any size, so it is cut into ranges of at most about RANGE_TERMS terms, and
each range has a transducer of its own. Texts are read twice: once for the documents of each term, then to stream their terms,
combined in each task, to the ranges, where the transducers take them to ordinals. All that follows works on ordinals.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, ranked
from loomgraph.llm.language_id import Transitions

#: Documents of its language in which a kept term is at least; the terms shown of each source.
LEAST_DOCS, TOP = 3, 200
#: Terms of a range of a vocabulary, on average; bytes of text whose terms a task combines before it sends them on; terms of
#: documents that meet in a task, on average.
RANGE_TERMS, HELD, TASK_TERMS = 50_000, 8_000_000, 5_000_000
#: Probabilities are whole numbers of this.
UNIT = 1_000_000_000
_PART = 4_000_000
# Of bytes: letters of ASCII in lower case and all beyond it, and a line break for any other.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 10 for b in range(256))


def letters(text: bytes) -> Iterator[bytes]:
    """The terms of a text (UTF-8) in order, A-Z lower-cased, with line breaks between them, a long text's in several parts."""
    raw = text.translate(_LETTERS)
    at = 0
    while at < len(raw):
        gap = raw.find(b"\n", at + _PART)
        end = gap if gap >= 0 else len(raw)
        yield raw[at:end]
        at = end


def terms(text: str | bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a long text's in several lists."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return (part.split() for part in letters(raw))


# ---- transducers ----


class Transducer:
    """The minimal acyclic transducer of sorted terms (bytes), which takes each to its number in their order.

    Built as terms come: what the last term does not share with the next one is finished, from its end, and a state that is like
    one that is there is that one. An arc puts out how many terms come before those beyond it.
    """

    def __init__(self, sorted_terms: Iterable[bytes]):
        self._known: dict[tuple[int, ...], int] = {}  # numbers go up as states are finished
        path: list[list[int]] = [[0]]  # states on the last term's way: final, then an arc's byte and target in a number each
        last: bytes | None = None
        for term in sorted_terms:
            if last is not None and term <= last:
                raise ValueError("terms are not sorted, or not different")
            last = last or b""
            same = 0
            for x, y in zip(last, term):  # noqa: B905
                if x != y:
                    break
                same += 1
            self._finish(path, last, same)
            path += [[0] for _ in range(same, len(term))]
            path[-1][0] = 1
            last = term
        self._finish(path, last or b"", 0)
        self.root = self._known.setdefault(tuple(path[0]), len(self._known))
        self._arcs = [tuple((arc & 255, arc >> 8) for arc in state[1:]) for state in self._known]
        self._ends = [bool(state[0]) for state in self._known]
        self._number()

    def _finish(self, path: list[list[int]], last: bytes, keep: int) -> None:
        known = self._known
        for at in range(len(path) - 2, keep - 1, -1):
            done = known.setdefault(tuple(path.pop()), len(known))
            path[-1].append(done << 8 | last[at])

    def _number(self) -> None:
        """Arc numbers in a table, their targets and outputs. A state's targets were made before it, so one pass counts the terms beyond each."""
        count = np.zeros(len(self._arcs), np.int64)
        keys, to, out = [], [], []
        for s, arcs in enumerate(self._arcs):
            before = int(self._ends[s])
            for byte, target in arcs:
                keys.append(s * 256 + byte)
                to.append(target)
                out.append(before)
                before += int(count[target])
            count[s] = before
        self.final, self.to, self.out = np.array(self._ends, bool), np.array(to, np.int64), np.array(out, np.int64)
        self.table = Transitions.of(np.array(keys, np.int64), np.arange(len(keys), dtype=np.int32))
        self.terms, self.states = int(count[self.root]), len(count)
        self._known = {}

    def ordinals(self, texts: bytes) -> np.ndarray:
        """The number of each term of a text of terms, each with a line break after it, or -1; all are read in step, a byte at a time."""
        buf = np.frombuffer(texts, np.uint8)
        end = np.flatnonzero(buf == 10)
        at, n = np.concatenate(([0], end[:-1] + 1)) if len(end) else end, len(end)
        found, total, state = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, self.root, np.int64)
        live = np.arange(n)
        while len(live):
            done = at[live] == end[live]
            over = live[done]
            found[over] = np.where(self.final[state[over]], total[over], -1)
            live = live[~done]
            arc = self.table.next(state[live] * 256 + buf[at[live]]) if len(self.to) else np.full(len(live), -1)
            live, arc = live[arc >= 0], arc[arc >= 0]
            total[live] += self.out[arc]
            state[live] = self.to[arc]
            at[live] += 1
        return found

    def term(self, ordinal: int) -> bytes:
        """The term of a number."""
        if not 0 <= ordinal < self.terms:
            raise IndexError(ordinal)
        state, out = self.root, bytearray()
        while ordinal or not self.final[state]:
            arcs = self._arcs[state]
            first = [self.out[int(a)] for a in self.table.next(np.array([state * 256 + b for b, _ in arcs], np.int64))]
            k = bisect_right(first, ordinal) - 1
            ordinal -= int(first[k])
            out.append(arcs[k][0])
            state = arcs[k][1]
        return bytes(out)


# ---- passes over the texts ----


def _emptied(df: DataFrame) -> DataFrame:
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _parts(rows: Iterable[tuple], whole: bool) -> Iterator[list[tuple[tuple, bytes]]]:
    """Keys and terms of rows (*key, text), some megabytes at a time; whole: each text in one part, a long one's terms once."""
    part: list[tuple[tuple, bytes]] = []
    size = 0
    for *key, text in rows:
        pieces = [b"\n".join(set().union(*terms(text)))] if whole and len(text) > _PART else letters(text)
        for piece in pieces:
            part.append((tuple(key), piece))
            size += len(piece)
            if size >= HELD:
                yield part
                part, size = [], 0
    if part:
        yield part


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, sorted, and how often each is there."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return x[first], np.diff(np.concatenate((first, [len(x)]))).astype(np.int64)


def _combined(rows: Iterable[tuple], whole: bool) -> Iterator[tuple[list[tuple], pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms of rows (*key, text), combined in each of their parts: the part's keys, its terms in order, each with a line break
    after it, and key, term (places in these) and count, by key and term; whole: a text counts a term once."""
    for part in _parts(rows, whole):
        keys = sorted({key for key, _ in part})
        place = {key: k for k, key in enumerate(keys)}
        of = np.fromiter((place[key] for key, _ in part), np.int64, len(part))
        size = np.fromiter((len(raw) + 1 for _, raw in part), np.int64, len(part))
        buf = np.frombuffer(b"\n".join([*(raw for _, raw in part), b""]), np.uint8)
        inside = buf != 10
        after = np.zeros(len(buf), bool)
        after[1:] = inside[:-1]
        text = buf[inside | after]
        ends = np.concatenate(([0], np.flatnonzero(text == 10) + 1)).astype(np.int64)
        each = np.diff(np.concatenate(([0], np.searchsorted(np.flatnonzero(inside & ~after), np.cumsum(size)))))
        coded = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)]).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        names = coded.dictionary.take(order)
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        term, most = rank[coded.indices.to_numpy()], max(len(names), 1)
        if whole:
            once, _ = _runs(np.repeat(np.arange(len(part)), each) * most + term)
            found, n = _runs(of[once // most] * most + once % most)
        else:
            found, n = _runs(np.repeat(of, each) * most + term)
        yield keys, names, found // most, found % most, n


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True)


def _plain(rows: Iterable[tuple]) -> Iterator[tuple]:
    return (tuple(v.as_py() for v in row) for row in rows)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term (bytes) and docs of all terms that are in so many documents of their language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, names, key, term, n in _combined(_plain(_rows(batches)), True):
            bare = pc.binary_slice(names, 0, -1).cast(pa.binary())
            lang = pa.array([k for (k,) in keys], pa.string())
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(key)), bare.take(pa.array(term)), pa.array(n)], ["lang", "term", "docs"])

    found = docs.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, term binary, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted terms of a range, each with its ordinal."""
    now, k = None, 0
    task = TaskContext.get()
    base = np.int64(task.partitionId() if task else 0) << 32
    for batch in batches:
        numbers = np.empty(batch.num_rows, np.int64)
        for i, lang in enumerate(batch.column(0).to_pylist()):
            now, k = lang, k + 1 if lang == now else 0
            numbers[i] = base | k
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], ["lang", "term", "ordinal"])


def _text(names: pa.Array) -> bytes:
    """All values, one after another."""
    at = np.frombuffer(names.buffers()[1], np.int64, len(names) + 1, names.offset * 8)
    return names.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes()


def _streamed(bounds: list[tuple[str, bytes]], salts: int):
    """Terms of texts, combined and sorted: a row for each range that they are in, of terms and counts. Terms before all ranges are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        salt = task.partitionId() if task else 0
        for keys, names, key, term, n in _combined(_plain(_rows(batches)), False):
            firsts = [bisect_left(range(len(names)), b[1], key=lambda k: names[k].as_py()) for b in bounds]
            group = np.searchsorted(key, np.arange(len(keys) + 1)).tolist()
            for (lang, source), begin, end in zip(keys, group[:-1], group[1:], strict=True):
                salt += 1
                first, last = bisect_right(bounds, (lang,)), bisect_right(bounds, (lang + "\0",))  # the ranges that begin in this language
                cuts = [begin, *(begin + np.searchsorted(term[begin:end], firsts[first:last])).tolist(), end]
                rows = [(first - 1 + k, lo, hi) for k, (lo, hi) in enumerate(pairwise(cuts)) if lo < hi and first - 1 + k >= 0]
                own = [pa.array(term[lo:hi]) for _, lo, hi in rows]
                columns = [
                    pa.array([k * salts + salt % salts for k, _, _ in rows], pa.int32()),
                    pa.array([1] * len(rows), pa.int8()),
                    pa.array([lang] * len(rows), pa.string()),
                    pa.array([source] * len(rows), pa.string()),
                    pa.array([_text(names.take(t)) for t in own], pa.binary()),
                    pa.array([n[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "kind", "lang", "source", "terms", "n"])

    return run


def _transduced(salts: int):
    """Rows by part, kept terms of the part (kind 0, one a row) before what is streamed to it, both by language and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, list[bytes]] = {}
        ready: dict[str, Transducer] = {}
        part, group, total = -1, None, np.zeros(0, np.int64)

        def counted() -> Iterator[pa.RecordBatch]:
            known = np.flatnonzero(total)
            if len(known):
                lang, source = (pa.repeat(pa.scalar(x, pa.string()), len(known)) for x in group)
                yield pa.RecordBatch.from_arrays([lang, source, pa.array((np.int64(part // salts) << 32) | known), pa.array(total[known])], ["lang", "source", "ordinal", "n"])

        for *head, terms_, n in _rows(batches):
            at, kind, lang, source = (v.as_py() for v in head)
            if at != part or kind == 0 or (lang, source) != group:
                yield from counted()
                group, total = None, np.zeros(0, np.int64)
                if at != part:
                    vocabulary, ready, part = {}, {}, at
                if kind == 0:
                    vocabulary.setdefault(lang, []).append(terms_.as_py())
                    continue
                group = (lang, source)
                if lang not in ready:
                    ready[lang] = Transducer(vocabulary.pop(lang, []))
                total = np.zeros(ready[lang].terms, np.int64)
            number = ready[lang].ordinals(terms_.as_py())
            total += np.bincount(number[number >= 0], np.frombuffer(n.as_py(), np.int64)[number >= 0], len(total)).astype(np.int64)
        yield from counted()

    return run


def recount(docs: DataFrame, kept: DataFrame, scratch: Scratch, range_terms: int = RANGE_TERMS, task_terms: int = TASK_TERMS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, ordinal and n of all kept terms that a source has; lang, term and ordinal). Ordinals are in the order of a
    language's terms: the range's number and the term's number in it.

    The driver takes one term of each range, one of about range_terms, and sends the tasks as many. A range of many occurrences
    is dealt to several tasks, each with the range's transducer.
    """
    spark = docs.sparkSession
    size = kept.agg(F.count("*"), F.sum("docs")).first()
    if not size[0]:
        return spark.createDataFrame([], "lang string, source string, ordinal long, n long"), spark.createDataFrame([], "lang string, term binary, ordinal long")
    ranges = -(-size[0] // range_terms)
    salts = -(-size[1] // (ranges * task_terms))
    cut = kept.select("lang", "term").repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
    vocabulary = scratch.write(cut.mapInArrow(_numbered, "lang string, term binary, ordinal long"))
    of = F.shiftright("ordinal", 32).cast("int")
    firsts = vocabulary.groupBy(of.alias("range")).agg(F.min(F.struct("lang", "term")).alias("first")).orderBy("range").collect()
    if [r["range"] for r in firsts] != list(range(len(firsts))):  # a range got no term
        vocabulary = scratch.write(_without_gaps(vocabulary, [r["range"] for r in firsts]))
    bounds = [(r["first"]["lang"], bytes(r["first"]["term"])) for r in firsts]
    none = F.lit(b"")
    each = F.explode(F.sequence(of * salts, of * salts + (salts - 1)))
    kinds = vocabulary.select(each.alias("part"), F.lit(0).cast("byte").alias("kind"), "lang", F.lit("").alias("source"), F.col("term").alias("terms"), none.alias("n"))
    streamed = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_streamed(bounds, salts), "part int, kind byte, lang string, source string, terms binary, n binary")
    parts = kinds.unionByName(streamed).repartitionById(len(bounds) * salts, F.col("part")).sortWithinPartitions("part", "kind", "lang", "source", "terms")
    found = parts.mapInArrow(_transduced(salts), "lang string, source string, ordinal long, n long")
    # a range that one task reads is counted whole
    return scratch.write(found if salts == 1 else found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))), vocabulary


def _without_gaps(vocabulary: DataFrame, there: list[int]) -> DataFrame:
    place = F.array_position(F.lit(there), F.shiftright("ordinal", 32).cast("int")) - 1
    return vocabulary.withColumn("ordinal", F.shiftleft(place, 32).bitwiseOR(F.col("ordinal").bitwiseAND((1 << 32) - 1)))


# ---- divergence ----


def probability(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / total), exactly, for n < total < 9 * 10 ** 15: by long division, three digits at a time."""
    out, rest = F.lit(1).cast("long"), (n + 1).cast("long")
    for weight in (10**6, 10**3, 1):
        out = out + F.call_function("div", rest * 1000, total) * weight
        rest = rest * 1000 % total
    return out


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most UNIT + 1, so the square is within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value of all pairs of sources of a language.

    The sum over all kept terms is that of a pair in which neither has any, put right by what each source's own terms add
    (its counts' histogram) and by what the terms that both have add beyond that; so terms that neither has cost nothing. Sums
    are under 4 * (UNIT + v)^2, which 64 bits hold for vocabularies of 500 million terms; past that Spark raises.
    """
    a = totals.select("lang", F.col("source").alias("a"), F.col("zero").alias("a0"), "v")
    b = totals.select("lang", F.col("source").alias("b"), F.col("zero").alias("b0"))
    pairs = a.join(b, "lang").where("a != b")
    own = counts.groupBy("lang", "source", "p").agg(F.count("*").alias("h"))
    none = divergence(F.col("a0"), F.col("b0"))
    left = pairs.join(own.select("lang", F.col("source").alias("a"), "p", "h"), ["lang", "a"])
    left = left.select("lang", "a", "b", ((divergence(F.col("p"), F.col("b0")) - none) * F.col("h")).alias("x"))
    right = pairs.join(own.select("lang", F.col("source").alias("b"), "p", "h"), ["lang", "b"])
    right = right.select("lang", "a", "b", ((divergence(F.col("a0"), F.col("p")) - none) * F.col("h")).alias("x"))
    side = lambda x: counts.select("lang", "ordinal", F.col("source").alias(x), F.col("p").alias(f"{x}p"), F.col("zero").alias(f"{x}0"))
    met = side("a").join(side("b"), ["lang", "ordinal"]).where("a < b")

    def more(x: str, y: str) -> Column:
        p, p0, q, q0 = (F.col(f"{s}{t}") for s in (x, y) for t in ("p", "0"))
        return divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)

    both = met.groupBy("lang", "a", "b").agg(F.sum(more("a", "b")).alias("ab"), F.sum(more("b", "a")).alias("ba"))
    there = both.select("lang", "a", "b", F.col("ab").alias("x")).unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("x")))
    start = pairs.select("lang", "a", "b", (none * F.col("v")).alias("x"))
    total = start.unionByName(left).unionByName(right).unionByName(there).groupBy("lang", "a", "b").agg(F.sum("x").alias("value"))
    return total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, range_terms: int = RANGE_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: of each source of a language, its divergence from each other source (`pair`), and the
    terms that it has more often than the language, by divergence, down to rank `top` (`term`).

    Null text, lang and source are empty strings; repeated rows are documents of their own. A language without kept terms has
    pairs of value 0 and no terms; an empty table has no rows. Ties of terms go by ordinal, of sources by name.
    """
    scratch = Scratch(docs.sparkSession)
    own = _emptied(docs)
    kept = scratch.write(kept_terms(own, least_docs))
    found, vocabulary = recount(own, kept, scratch, range_terms)
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    has = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(has, ["lang", "source"], "left").join(size, "lang", "left").fillna(0, ["total", "v"])
    whole = F.col("total") + F.col("v")
    zero = F.when(whole > 0, probability(F.lit(0), F.greatest(whole, F.lit(1)))).otherwise(1)
    totals = scratch.write(groups.withColumn("zero", zero))
    counts = found.join(totals, ["lang", "source"]).withColumn("p", probability(F.col("n"), whole))
    counts = scratch.write(counts.select("lang", "source", "ordinal", "n", "p", "zero", "v"))
    pairs = _pairs(counts.select("lang", "source", "ordinal", "p", "zero"), totals)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    in_all = F.sum("n").over(Window.partitionBy("lang", "ordinal"))
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("all_n"))
    q = probability(F.col("n_all"), F.col("all_n") + F.col("v"))
    common = counts.withColumn("n_all", in_all).join(of_lang, "lang").withColumn("q", q).where("p > q")
    common = common.withColumn("value", divergence(F.col("p"), F.col("q")))
    best = ranked(common.select("lang", "source", "ordinal", "value"), ["lang", "source"], [F.desc("value"), F.col("ordinal")], top).join(vocabulary, ["lang", "ordinal"])
    terms_ = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.unionByName(terms_)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0)::HUGEINT AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (total.total + size.v) AS p
    FROM g JOIN kept k USING (lang) JOIN size USING (lang) JOIN total USING (lang, source) LEFT JOIN n USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (coalesce(sum(n), 0) + 1)::HUGEINT) // (any_value(t.total) + any_value(v)) AS q
    FROM kept LEFT JOIN n USING (lang, term) JOIN size USING (lang) JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM total GROUP BY lang) t USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM term) WHERE rank <= 200
"""
