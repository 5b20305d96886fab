"""Secret scans: three fixed patterns, and character Markov models of random strings and of ordinary identifiers.

A run of token characters is a secret if its log-likelihood ratio under the two models is above a threshold taken from the
labelled samples, and so is a stretch of it that is above one of its own; parts that patterns cover are left to them. The text column alone crosses to Python, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, the least length of what they find, and the kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Shortest token that the models judge.
TOKEN = 20
#: Words of the labelled sample of ordinary identifiers, beside those of the documents.
ORDINARY = """account action address array async average backend batch block branch bucket buffer build button cache change channel check child
class clean client code column command commit config connection content context control copy count create current customer data date
default delete description detail device digit directory document domain download driver element email encode engine entity error event
example factory feature field file filter final find folder format frame function general global graph group handler header height helper
history house identifier image import index input instance integer internal invoice item iterator key label language last layer length level library
line link list load local location long manager match memory message method middle model module monitor name network next node normal
number object option order ordinary output owner package page parent parse password path pattern people person picture player point policy
position prefix process product profile project property public query queue random range read record reference region release remote
report request resource response result return river root route sample schema screen script search second section select server service
session setting shape simple size source split start state status stream string style summary system table target task template test text
thread time title token total transfer tree type unique unit update upload user utility value variable vector version view water weight
width window word worker write yellow year""".split()
SPANS = "array<struct<kind:string,start:int,end:int>>"

_CODE = np.zeros(256, np.int16)
_CODE[list(SYMBOLS.encode())] = np.arange(1, len(SYMBOLS) + 1)
_IS_TOKEN = _CODE > 0
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_JOINT = np.zeros(256, bool)
_IS_JOINT[list(b"/_.=-")] = True


@dataclass(frozen=True)
class TokenModel:
    """ratio[a, b]: log of P(b | a, random) / P(b | a, identifier), with 0 as start; threshold: mean ratio of a symbol that a secret exceeds;
    stretch: the mean that a stretch of TOKEN symbols or more of a longer run exceeds."""

    ratio: np.ndarray
    threshold: float
    stretch: float = float("inf")

    def ratios(self, piece: np.ndarray) -> np.ndarray:
        codes = _CODE[piece]
        return self.ratio[np.concatenate(([0], codes[:-1])), codes]

    def score(self, token: str) -> float:
        return float(self.ratios(np.frombuffer(token.encode(), np.uint8)).mean())

    def best_stretch(self, token: str) -> float:
        """The largest mean of a stretch of TOKEN symbols or more; one of twice that and more has a half that is no worse."""
        total = np.concatenate(([0], np.cumsum(self.ratios(np.frombuffer(token.encode(), np.uint8)))))
        return max((float((total[k:] - total[:-k]).max()) / k for k in range(TOKEN, min(2 * TOKEN, len(total)))), default=-np.inf)

    def secrets(self, piece: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of a run's secrets: the whole run, or else its stretches with the largest sums over the limit, each out to the next joints."""
        r = self.ratios(piece)
        if r.mean() > self.threshold:
            return [(0, len(r))]
        if not np.isfinite(self.stretch) or len(r) < TOKEN:
            return []
        rises, joints = _Rises(np.concatenate(([0], np.cumsum(r - self.stretch))), TOKEN), np.flatnonzero(_IS_JOINT[piece]).tolist()
        out, open_ = [], [(0, len(r))]
        while open_:
            lo, hi = open_.pop()
            if hi - lo < TOKEN:
                continue
            gain, a, b = rises.best(lo, hi)
            if gain <= 0:
                continue
            before, after = bisect_left(joints, a), bisect_left(joints, b)
            x = joints[before - 1] + 1 if before and joints[before - 1] >= lo else lo
            y = joints[after] if after < len(joints) and joints[after] < hi else hi
            out.append((x, y))
            open_ += [(lo, x), (y, hi)]
        return sorted(out)


class _Rises:
    """The largest rises t[b] - t[a], b - a >= least, of a series within any part of it, the first of equals.

    The series is kept in blocks of about the root of its length, each with its least t[a], its greatest t[a + least] and its
    largest rise; a question reads two blocks and a row a block, however often the series is asked.
    """

    def __init__(self, t: np.ndarray, least: int, block: int = 0):
        self.least, n = least, len(t) - least
        self.size = block or max(64, int(n**0.5))
        blocks = -(-n // self.size)
        self.low, self.high = np.full(blocks * self.size, np.inf), np.full(blocks * self.size, -np.inf)
        self.low[:n], self.high[:n] = t[:-least], t[least:]
        low, high = self.low.reshape(blocks, -1), self.high.reshape(blocks, -1)
        self.floor, self.top, self.inner = low.min(1), high.max(1), (high - np.minimum.accumulate(low, axis=1)).max(1)

    def _scan(self, lo: int, hi: int, floor: float = np.inf) -> tuple[float, int]:
        """The largest rise that ends in lo to hi, from the floor or from a place in there before it, and its end."""
        rise = self.high[lo:hi] - np.minimum(np.minimum.accumulate(self.low[lo:hi]), floor)
        k = int(rise.argmax())
        return float(rise[k]), lo + k

    def _lowest(self, lo: int, hi: int) -> int:
        p, q = -(-lo // self.size), hi // self.size
        if p >= q:
            return lo + int(self.low[lo:hi].argmin())
        k = p + int(self.floor[p:q].argmin())
        parts = [(lo, p * self.size), (k * self.size, (k + 1) * self.size), (q * self.size, hi)]
        places = [a + int(self.low[a:b].argmin()) for a, b in parts if a < b]
        return min(places, key=lambda i: (self.low[i], i))

    def best(self, lo: int, hi: int) -> tuple[float, int, int]:
        """(rise, a, b) of the largest within lo to hi, which are at least `least` apart."""
        hi = hi - self.least + 1
        p, q = -(-lo // self.size), hi // self.size
        if p >= q:
            gain, end = self._scan(lo, hi)
        else:
            found = [self._scan(lo, p * self.size)] if lo < p * self.size else []
            floor = self.low[lo : p * self.size].min(initial=np.inf)
            before = np.minimum(np.minimum.accumulate(np.concatenate(([np.inf], self.floor[p:q]))), floor)
            rise = np.maximum(self.inner[p:q], self.top[p:q] - before[:-1])
            k = int(rise.argmax())
            found.append(self._scan((p + k) * self.size, (p + k + 1) * self.size, before[k]))
            if q * self.size < hi:
                found.append(self._scan(q * self.size, hi, before[-1]))
            gain, end = max(found, key=lambda x: (x[0], -x[1]))
        return gain, self._lowest(lo, end + 1), end + self.least


def _transitions(samples: list[str]) -> np.ndarray:
    n = len(SYMBOLS) + 1
    counts = np.full((n, n), 0.5)
    for s in samples:
        codes = _CODE[np.frombuffer(s.encode(), np.uint8)]
        np.add.at(counts, (np.concatenate(([0], codes[:-1])), codes), 1)
    counts[:, 0] = 0
    counts[:, 1:] += 0.5  # smoothing
    return np.log(np.where(counts > 0, counts / counts.sum(1, keepdims=True), 1))


def fit_models(random_strings: list[str], identifiers: list[str], false_share: float = 1e-3) -> TokenModel:
    """Models of two labelled samples; the threshold lets at most that share of the held-back identifiers (every fourth) pass,
    and is positive; so does that of their stretches."""
    held = identifiers[::4]
    kept = [s for i, s in enumerate(identifiers) if i % 4] or identifiers
    ratio = _transitions(random_strings) - _transitions(kept)
    ratio[:, 0] = 0
    rough = TokenModel(ratio, 0.0)

    def limit(scores: list[float]) -> float:
        scores = sorted(scores) or [0.0]
        return max(scores[min(len(scores) - 1, int(len(scores) * (1 - false_share)))] + 0.1, 0.25)

    return TokenModel(ratio, limit([rough.score(s) for s in held]), limit([rough.best_stretch(s) for s in held]))


def labelled_samples(texts: list[str], n: int = 4000, seed: int = 11) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers): the first drawn evenly from the alphabets of keys, with the values that the base
    patterns find in the texts; the second made of the texts' words, joined as people
    join names, paths and compounds, and rows of one or two characters."""
    rng = np.random.default_rng(seed)
    alphabets = [SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[26:62], SYMBOLS[:26] + SYMBOLS[52:62], "0123456789abcdef"]
    found = [m[2] for t in texts for m in ASSIGN.finditer(t) if len(m[2]) >= LEAST["assign"] and re.search(r"\d", m[2])][:n]
    random_strings = found + ["".join(rng.choice(list(alphabets[i % len(alphabets)]), rng.integers(20, 48))) for i in range(n)]
    words = [w for t in texts for w in re.findall(r"[A-Za-z]{2,14}", t)] or ORDINARY
    either = [words, ORDINARY]

    def pick(k: int) -> list[str]:
        pools = [either[i] for i in rng.integers(0, 2, k)]
        return [pool[rng.integers(0, len(pool))] for pool in pools]

    identifiers = []
    for i in range(2 * n):
        w = pick(int(rng.integers(3, 7)))
        style = i % 6
        if style == 0:
            s = "_".join(x.lower() for x in w)
        elif style == 1:
            s = w[0].lower() + "".join(x.capitalize() for x in w[1:])
        elif style == 2:
            s = "-".join(x.lower() for x in w)
        elif style == 3:
            s = ".".join(x.lower() for x in w)
        elif style == 4:
            s = "/".join(w)
        else:
            s = "_".join(x.upper() for x in w)
        if rng.random() < 0.6:
            s += rng.choice(["_", "-", ".", "/", ""]) + str(rng.integers(0, 3000))
        identifiers.append(s)
    for i in range(n):
        style, k = i % 5, i // 5
        if style == 0:
            s = "".join(x.lower() for x in pick(int(rng.integers(2, 5))))
            s = s.capitalize() if k % 2 else s
        elif style == 1:
            s = "".join(x + rng.choice(list("/.-_=")) for x in pick(int(rng.integers(5, 25))))
        elif style == 2:
            s = "www." + ".".join(x.lower() for x in pick(2)) + ".com/" + "/".join(x.lower() for x in pick(int(rng.integers(2, 9)))) + rng.choice(["", ".html", "/"])
        elif style == 3:
            s = ".".join(x.lower() for x in pick(2)) + "/" + "_".join(x.capitalize() for x in pick(int(rng.integers(2, 9))))
        elif k % 3 == 0:  # each symbol is held back once in four rounds
            s = SYMBOLS[(k // 3 + k // 3 // len(SYMBOLS)) % len(SYMBOLS)] * int(rng.integers(20, 80))
        elif k % 3 == 1:
            s = "".join(rng.choice(list("+/_.=-"), 2)) * int(rng.integers(10, 40))
        else:
            s = SYMBOLS[26 * (k % 2) :][:26]
        identifiers.append(s)
    return random_strings, identifiers


def train(docs: DataFrame, sample_rows: int = 300, sample_chars: int = 6000, text: str = "text") -> TokenModel:
    """Models fitted on at most sample_rows distinct texts (those with the smallest hash) of at most sample_chars characters each.

    The smallest hashes are found first, so that a task sends the driver hashes, and not texts that will not be taken.
    """
    short = docs.where(F.length(text) <= sample_chars).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    least = [r[0] for r in short.select("h").distinct().orderBy("h").limit(sample_rows).collect()]
    rows = short.where(F.col("h") <= max(least)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(sample_rows).collect() if least else []
    return fit_models(*labelled_samples([r["t"] for r in rows]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the base patterns find in one text."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def _runs(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - start >= least
    return start[keep], end[keep]


def _in_code_points(spans: list[tuple[int, int]], raw: bytes, n: int) -> list[tuple[int, int]]:
    """Spans of ASCII runs, from places in UTF-8 to places in the text of n code points."""
    if len(raw) == n:
        return spans
    before = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(int(before[s]) - 1, int(before[s]) - 1 + e - s) for s, e in spans]


def uncovered(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The parts of the found spans (by start, apart from each other) that no base span (by start) covers."""
    out, k, upto = [], 0, 0  # base spans before k end at upto at the latest
    for a, b in sorted(found):
        while k < len(base) and base[k][0] <= a:
            upto = max(upto, base[k][2])
            k += 1
        a = max(a, upto)
        while k < len(base) and base[k][0] < b:
            if a < base[k][0]:
                out.append((a, 3, base[k][0]))
            upto = max(upto, base[k][2])
            a = max(a, upto)
            k += 1
        if a < b:
            out.append((a, 3, b))
    return out


def scan_texts(texts: list[str | None], model: TokenModel | None) -> list[list[dict]]:
    """The spans of each text, by start and kind, in code points. Runs are found on the bytes of all texts at once; a text is
    searched with the patterns only if it has a keyword, AKIA or a long run."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    owner = lambda at: np.searchsorted(first, at, "right") - 1
    hex_at, _ = _runs(_IS_HEX[buf], LEAST["hex"])
    has_hex = set(owner(hex_at).tolist())
    tokens: dict[int, list[tuple[int, int]]] = {}
    if model is not None:
        start, end = _runs(_IS_TOKEN[buf], TOKEN)
        for s, e, i in zip(start.tolist(), end.tolist(), owner(start).tolist(), strict=True):
            for a, b in model.secrets(buf[s:e]):
                tokens.setdefault(i, []).append((s + a - int(first[i]), s + b - int(first[i])))
    out: list[list[dict]] = []
    for i, t in enumerate(texts):
        spans: list[tuple[int, int, int]] = []
        if t:
            low = t.lower()
            if i in has_hex or "AKIA" in t or any(k in low for k in KEYWORDS):
                spans = base_spans(t)
            if i in tokens:
                spans = sorted(spans + uncovered(_in_code_points(tokens[i], raw[i], len(t)), spans))
        out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
    return out


def secret_spans(text: Column, model: TokenModel | None) -> Column:
    """array<struct<kind, start, end>> of each text, by start, then kind; null and empty texts: an empty array. Ends are exclusive."""

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        out: list[list[dict]] = []
        part: list[str | None] = []
        n = 0
        for t in texts:
            part.append(t)
            n += len(t or "")
            if n > 4_000_000:
                out += scan_texts(part, model)
                part, n = [], 0
        return pd.Series(out + scan_texts(part, model), dtype=object)

    return scan(text)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, model: TokenModel | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; the model is trained on docs if none is given."""
    model = model or train(docs)
    found = docs.select("doc_id", secret_spans(F.col("text"), model).alias("__s"))
    count = lambda kind: F.size(F.filter("__s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = digest(F.filter("__s", lambda s: s["kind"] != "markov"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), digest(F.col("__s")).alias("spans"), count("markov"))


def redact(docs: DataFrame, mark: str = "[secret]", model: TokenModel | None = None) -> DataFrame:
    """docs with every span of `text` replaced by the mark (overlapping spans by one) and n_chars, if there, made to fit."""
    model = model or train(docs)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out, held = [], texts.tolist()
        for lo in range(0, len(held), 256):
            part = held[lo : lo + 256]
            for t, spans in zip(part, scan_texts(part, model), strict=True):
                if spans:
                    pieces, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            pieces += [t[at : s["start"]], mark]
                        at = max(at, s["end"])
                    t = "".join([*pieces, t[at:]])
                out.append(t)
        return pd.Series(out, dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
