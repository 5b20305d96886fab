"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text of each language reads a document forward; where it can go no further, a phrase ends.
The longer the matches, the fewer the phrases. Phrases are normalised to bits a letter, log2 of the sample's length times
phrases over letters, and the language that needs fewest wins.

Texts are parsed in blocks of BLOCK characters, all blocks and languages of a batch in step, as if in one run: a block goes on
from the state in which the one before it ended. Blocks are first parsed from the root; then, with the states that they should
have begun in, only until they are in the same state as before, which is mostly within a phrase or two.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import crc_fold, free_name

BLOCK = 1024
#: Characters of a block after which states are compared with those of the parse before.
MARKS = (12, 24, 36, 48, 64, 96, 128, 256, 512)
#: Characters that are parsed together.
PART_CHARS = 1_500_000
#: Times that blocks are parsed on in step.
ROUNDS = 3
#: Blocks that are parsed in step.
IN_STEP = 4096
#: The labelled sample: characters of each language, rows of each language, and longest row.
SAMPLE_CHARS, SAMPLE_ROWS, ROW_CHARS = 24_000, 60, 4000
FOLDS = 5
UNKNOWN = "und"
#: A document of that many letters is rejected if its language does worse on it than even odds over its own alphabet, and than on most of its held-back rows.
LEAST_LETTERS = 200


def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


_IS_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    return _IS_LETTER[0]


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with every run of other characters made one 0, their number and the letters' number for each text."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    code = np.where(is_letter()[code], code, 0)
    first = np.concatenate(([0], np.cumsum(size)))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    keep[first[:-1][size > 0]] = True
    kept, lets = np.concatenate(([0], np.cumsum(keep))), np.concatenate(([0], np.cumsum(code != 0)))
    return code[keep], kept[first[1:]] - kept[first[:-1]], lets[first[1:]] - lets[first[:-1]]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings: of each state, symbol to next; state 0 is the root."""
    link, longest, step = [-1], [0], [{}]
    last = 0
    for c in symbols:
        cur = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[p] + 1 == longest[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


@dataclass
class Transitions:
    """A table of keys (state * width + symbol) and next states by open addressing, at most one third full; -1: free."""

    keys: np.ndarray
    to: np.ndarray
    bits: int

    @classmethod
    def of(cls, keys: np.ndarray, to: np.ndarray) -> Transitions:
        """Filled in rounds: of the keys that want a free slot the first gets it."""
        bits = max(4, (len(keys) * 3).bit_length())
        out = cls(np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), bits)
        at, left = out._slot(keys), np.arange(len(keys))
        while len(left):
            _, first = np.unique(np.where(out.keys[at] == -1, at, -1), return_index=True)
            first = first[out.keys[at[first]] == -1]
            out.keys[at[first]], out.to[at[first]] = keys[left[first]], to[left[first]]
            wait = np.ones(len(left), bool)
            wait[first] = False
            left, at = left[wait], (at[wait] + 1) & (len(out.keys) - 1)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, keys: np.ndarray) -> np.ndarray:
        """The next state of each key, or -1."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.to[at], -1)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            same = held == keys[left]
            out[left[same]] = self.to[at[left[same]]]
            left = left[~same & (held != -1)]
        return out


@dataclass
class CrossParser:
    """langs in order; symbol of each code point; the transitions of all automata; roots and their next states [language, symbol];
    log2 of the samples' lengths; the bits over which a document of the language is rejected."""

    langs: list[str]
    symbol: np.ndarray
    width: int
    table: Transitions
    roots: np.ndarray
    first: np.ndarray
    log_size: np.ndarray
    limits: np.ndarray

    @classmethod
    def fit(cls, samples: dict[str, list[str]], chars: int = SAMPLE_CHARS) -> CrossParser:
        """samples: texts of each language, of which whole ones are taken until there are `chars` characters."""
        out = cls._fit(samples, chars)
        half = cls._fit({lang: texts[::2] for lang, texts in samples.items()}, chars // 2)
        for k, lang in enumerate(out.langs):
            if lang in half.langs and len(samples[lang]) > 1:
                bits, letters = half.bits(samples[lang][1::2])
                held = bits[letters >= LEAST_LETTERS, half.langs.index(lang)]
                if len(held):
                    out.limits[k] = max(out.limits[k], float(np.quantile(held, 0.95)))
        return out

    @classmethod
    def _fit(cls, samples: dict[str, list[str]], chars: int) -> CrossParser:
        taken: dict[str, np.ndarray] = {}
        for lang in sorted(samples):
            parts, n = [], 0
            for t in samples[lang]:
                if n >= chars:
                    break
                code, _, _ = letters_of([t])
                parts += [code, np.zeros(1, np.int32)]
                n += len(code) + 1
            if n:
                taken[lang] = np.concatenate(parts)
        own = [np.unique(code) for code in taken.values()]
        known = np.unique(np.concatenate([*own, np.zeros(1, np.int32)]))[1:]
        width = len(known) + 2  # 0: no letter; the last: a letter of no language, which no automaton has
        symbol = np.full(0x110000, width - 1, np.min_scalar_type(width - 1))
        symbol[0] = 0
        symbol[known] = np.arange(1, len(known) + 1)
        keys, to, roots, at = [], [], [], 0
        first = np.full((len(taken), width), -1, np.int32)
        for k, code in enumerate(taken.values()):
            step = suffix_automaton(symbol[code].tolist())
            keys += [(s + at) * width + c for s, d in enumerate(step) for c in d]
            to += [t + at for d in step for t in d.values()]
            first[k, list(step[0])] = [t + at for t in step[0].values()]
            roots.append(at)
            at += len(step)
        table = Transitions.of(np.array(keys, np.int64), np.array(to, np.int32))
        log_size = np.log2([max(len(c), 2) for c in taken.values()]) if taken else np.empty(0)
        limits = np.array([np.log2(max(len(u), 2)) for u in own])
        return cls(list(taken), symbol, width, table, np.array(roots, np.int32), first, log_size, limits)

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """phrases[text, language], as of one parse from each text's first character to its last."""
        out = np.zeros((len(sizes), len(self.langs)), np.int64)
        if not len(codes) or not self.langs:
            return out
        symbols = self.symbol[codes]
        per = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        count, end = np.zeros((2, len(self.langs), len(owner)), np.int32)
        marks = np.full((len(MARKS), 2, len(self.langs), len(owner)), -1, np.int32)  # states and counts at MARKS
        order = np.argsort(-length, kind="stable")
        for lo in range(0, len(order), IN_STEP):
            b = order[lo : lo + IN_STEP]
            count[:, b], end[:, b], marks[:, :, :, b] = self._parse(symbols, start[b], length[b])
        entry = np.repeat(self.roots[:, None], len(owner), axis=1)
        inner = np.flatnonzero(nth > 0)
        for turn in range(ROUNDS + 1):
            lang, wrong = np.nonzero(entry[:, inner] != end[:, inner - 1])
            if not len(wrong):
                break
            wrong = inner[wrong]
            if turn == ROUNDS:
                self._read_on(symbols, start, length, nth, entry, lang, wrong, count, end)
                break
            entry[lang, wrong] = end[lang, wrong - 1]
            by = np.argsort(-length[wrong], kind="stable")
            for lo in range(0, len(by), 4 * IN_STEP):
                at = by[lo : lo + 4 * IN_STEP]
                self._parse_on(symbols, start, length, entry, lang[at], wrong[at], count, end, marks)
        np.add.at(out, owner, count.T)
        return out

    def _parse(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases, end states and marks [language, block] of blocks (longest first) from the root."""
        root = self.roots[:, None]
        state = np.repeat(root, len(start), axis=1)
        found = np.zeros(state.shape, np.int32)
        marks = np.full((len(MARKS), 2, *state.shape), -1, np.int32)
        live = np.searchsorted(-length, -np.arange(length[0]), "left")  # blocks longer than t
        for t in range(int(length[0])):
            n = int(live[t])
            c = symbols[start[:n] + t].astype(np.int64)
            s = state[:, :n]
            to = self.table.next((s.astype(np.int64) * self.width + c).ravel()).reshape(s.shape)
            found[:, :n] += (to < 0) | (s == root)
            again = self.first[:, c]
            np.copyto(to, np.where(again < 0, root, again), where=to < 0)
            state[:, :n] = to
            if t + 1 in MARKS:
                m = MARKS.index(t + 1)
                marks[m, 0, :, :n], marks[m, 1, :, :n] = to, found[:, :n]
        return found, state, marks

    def _parse_on(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray, lang: np.ndarray, b: np.ndarray, count: np.ndarray, end: np.ndarray, marks: np.ndarray) -> None:
        """Parses blocks b (longest first) for their languages from their entry states, until they meet the parse before: from
        there on its counts hold."""
        state, found, root = entry[lang, b], np.zeros(len(b), np.int32), self.roots[lang]
        t = 0
        while len(b):
            n = int(np.searchsorted(-length[b], -t, "left"))
            if n < len(b):
                count[lang[n:], b[n:]], end[lang[n:], b[n:]] = found[n:], state[n:]
                lang, b, state, found, root = (x[:n] for x in (lang, b, state, found, root))
                continue
            c = symbols[start[b] + t].astype(np.int64)
            to = self.table.next(state.astype(np.int64) * self.width + c)
            found += (to < 0) | (state == root)
            again = self.first[lang, c]
            state = np.where(to >= 0, to, np.where(again < 0, root, again))
            t += 1
            if t in MARKS:
                m = MARKS.index(t)
                met = state == marks[m, 0, lang, b]
                x, y = lang[met], b[met]
                more = found[met] - marks[m, 1, x, y]
                count[x, y] += more
                marks[m:, 1, x, y] += more
                left = ~met
                marks[m, 0, lang[left], b[left]], marks[m, 1, lang[left], b[left]] = state[left], found[left]
                lang, b, state, found, root = (v[left] for v in (lang, b, state, found, root))

    @cached_property
    def _step(self) -> dict[int, int]:
        there = self.table.keys >= 0
        return dict(zip(self.table.keys[there].tolist(), self.table.to[there].tolist(), strict=True))

    def _read_on(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, nth: np.ndarray, entry: np.ndarray, lang: np.ndarray, wrong: np.ndarray, count: np.ndarray, end: np.ndarray) -> None:
        """Reads each text on for each language from its first wrong block: a block that was entered right is passed over, the
        others are parsed, one after the other."""
        step, width, first = self._step, self.width, self.first.tolist()
        upto = {}
        for k, b in sorted(zip(lang.tolist(), wrong.tolist(), strict=True)):
            if b < upto.get(k, 0):
                continue
            root = int(self.roots[k])
            while b < len(nth) and nth[b] > 0:
                state = int(end[k, b - 1])
                if entry[k, b] != state:
                    entry[k, b], found = state, 0
                    for c in symbols[start[b] : start[b] + length[b]].tolist():
                        to = step.get(state * width + c, -1)
                        if to < 0:
                            found += 1
                            to = first[k][c]
                            state = root if to < 0 else to
                        else:
                            found += state == root
                            state = to
                    count[k, b], end[k, b] = found, state
                b += 1
            upto[k] = b

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """bits a symbol [text, language], and the number of letters of each text."""
        codes, sizes, letters = letters_of(texts)
        return self.phrases(codes, sizes) * self.log_size / np.maximum(sizes, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """lang, score, bits and letters. Score: 1 less the winner's bits over the runner-up's; `und`, 0 for null, no letters or no model. Ties: the first language."""
        bits, letters = self.bits([t or "" for t in texts])
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), letters
        best = bits.argmin(1)
        two = np.partition(np.column_stack([bits, np.full(len(bits), np.inf)]), 1, axis=1)[:, :2]
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(letters == 0, 0.0, np.where(np.isinf(two[:, 1]), 1.0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12)))
        langs = [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
        return langs, np.clip(score, 0, 1), two[:, 0], letters


def train(docs: DataFrame, folds: int = FOLDS, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, row_chars: int = ROW_CHARS) -> CrossParser:
    """Fitted on at most `rows` labelled rows of each language that are not held out, the ones with the smallest hash, of 200 to row_chars characters
    (of any length, for a language without such rows). Ranks are limited before the shuffle, so a common language is no hot key."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ((crc_fold(F.col("doc_id"), folds) != 0) | F.col("doc_id").isNull()))
    fit = F.length("text").between(200, row_chars)
    short = own.select("lang", F.substring("text", 1, row_chars).alias("text"), fit.alias("fit"), F.xxhash64("doc_id", "text").alias("h"))
    ranked = short.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("fit"), "h", "text"))).where(F.col("r") <= rows)
    samples: dict[str, list[str]] = {}
    for lang, text, _ in sorted((r["lang"], r["text"], r["r"]) for r in ranked.collect()):
        samples.setdefault(lang, []).append(text)
    return CrossParser.fit(samples, chars)


LANGUAGE = "lang string, score double, bits double, letters long"


def language(text: Column, model: Broadcast) -> Column:
    """struct<lang, score, bits, letters> of each text."""

    @F.pandas_udf(LANGUAGE)
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts, part, n = [], [], 0
        for t in texts:
            part.append(t)
            n += len(t or "")
            if n > PART_CHARS:
                parts.append(model.value.predict(part))
                part, n = [], 0
        parts.append(model.value.predict(part))
        lang = [x for p in parts for x in p[0]]
        score, bits, letters = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        return pd.DataFrame({"lang": lang, "score": score, "bits": bits, "letters": letters.astype(np.int64)})

    return predict(text)


def predict_languages(docs: DataFrame, model: CrossParser | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. A null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    out = docs.select("doc_id", language(F.col("text"), shared).alias("__l"))
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("__l.lang").alias("lang_pred"), F.col("__l.score").alias("score"))


def keep_known(docs: DataFrame, model: CrossParser | None = None) -> DataFrame:
    """docs without those that it rejects: no letters, or 200 letters and more that fit no language (bits above the limit of the best one).
    Where no language could be learned, every document with letters stays."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = language(F.col("text"), shared)
    name = free_name("lang", docs.columns)
    keep = F.col(name)["letters"] > 0
    if model.langs:
        limits = F.create_map(*[F.lit(x) for pair in zip(model.langs, model.limits.tolist(), strict=True) for x in pair])
        keep &= (F.col(name)["letters"] < LEAST_LETTERS) | (F.col(name)["bits"] <= limits[F.col(name)["lang"]])
    return docs.withColumn(name, found).where(keep).drop(name)
