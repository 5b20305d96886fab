"""SentencePiece encoding and decoding of a BPE vocabulary with byte fallback, with seeded merge-dropout.

Agenda order: of a segment's candidate merges the one with the best score, then the leftmost, is done first. Dropout skips
a candidate by a keyed 64-bit hash of seed, document, occurrence, place and merged piece, so a rerun gives the same pieces.
No merge reaches over two characters that stand side by side in no piece; texts are cut there, and each distinct segment is
merged once in a batch without dropout. Occurrences of which a candidate is skipped are merged one by one, all in step.
Segments of more than LONG characters have an agenda of their own, a heap, so that their time grows with n log n.
Decoding is a gather of the pieces' bytes and gives back every text.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import mix64
from loomgraph.llm.token_files import text_parts

SPACE, MARK = 0x20, 0x2581
DROPOUT = 0.1
SEED = 29
#: Bytes of text that are encoded together.
PART_BYTES = 1 << 20
#: Candidates whose skips are looked up together.
CANDIDATES = 1 << 19
#: Longest segment that is merged in step with others.
LONG = 128
_NONE = np.iinfo(np.int32).max
_FOREIGN = 1 << 21  # code of a character that no piece has: this plus its code point


class PieceModel:
    """The vocabulary as arrays: characters, neighbours, merges and the pieces' bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.unk = sp.unk_id()
        self.byte_id = np.full(256, self.unk, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        chars = sorted({c for p in ids for c in p})
        for c in chars:
            ids.setdefault(c, len(pieces) + len(ids))  # a character of a piece that is no piece itself
        self.char_id = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.char_id[ord(c)] = ids[c]
        self.char_id[SPACE], self.char_id[MARK] = ids.get("▁", -1), -1
        self.n_pieces = n
        inner = sorted({c for p in ids if len(p) > 1 for c in p})
        self.place = np.zeros(0x110000, np.int32)
        for k, c in enumerate(inner):
            self.place[ord(c)] = k + 1
        self.place[SPACE], self.place[MARK] = self.place[MARK], 0
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        order = {i: r for r, i in enumerate(sorted(ids.values(), key=lambda i: (-sp.get_score(i), i) if i < n else (0.0, i)))}
        self.rank = np.full(max(ids.values()) + 1, _NONE, np.int32)
        keys, made = [], []
        at = {c: k + 1 for k, c in enumerate(inner)}
        for p, i in ids.items():
            if len(p) > 1:
                self.rank[i] = order[i]
                for k in range(1, len(p)):
                    self.beside[at[p[k - 1]], at[p[k]]] = True
                    a, b = ids.get(p[:k]), ids.get(p[k:])
                    if a is not None and b is not None:
                        keys.append((a << 20) | b)
                        made.append(i)
        self._hash(np.array(keys, np.int64), np.array(made, np.int32))
        raw = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        self.piece_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _hash(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open addressing with linear probes, filled in rounds: of the keys that want a free slot the first gets it."""
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.made = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.made[at[first]] = keys[left[first]], made[left[first]]
            wait = np.ones(len(left), bool)
            wait[first] = False
            left, at = left[wait], (at[wait] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make, or -1."""
        keys = (a.astype(np.int64) << 20) | b
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.made[at], -1)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            same = held == keys[left]
            out[left[same]] = self.made[at[left[same]]]
            left = left[~same & (held != -1)]
        return out

    def merge_all(self, symbols: np.ndarray, lengths: np.ndarray, key: np.ndarray | None = None, limit: np.uint64 = np.uint64(0), seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all segments (symbols one after another), and their number for each segment. key: of each segment, for
        skipping; seen: takes (segment, candidates' hashes)."""
        seg = np.repeat(np.arange(len(lengths)), lengths)
        pos = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sym = symbols.astype(np.int32)
        made = np.full(len(sym), -1, np.int32)
        order = np.full(len(sym), _NONE, np.int64)

        def look(at: np.ndarray) -> None:
            """Candidates of the pairs at, at + 1."""
            at = at[at + 1 < len(sym)]
            at = at[seg[at] == seg[at + 1]]
            new = self.merged(sym[at], sym[at + 1])
            got = new >= 0
            at, new = at[got], new[got]
            if key is not None or seen is not None:
                h = mix64(pos[at].astype(np.uint64) << np.uint64(32) | new.astype(np.uint64))
                if seen is not None:
                    seen.append((seg[at], h))
                if key is not None:
                    take = mix64(key[seg[at]] ^ h) >= limit
                    at, new = at[take], new[take]
            made[at], order[at] = new, self.rank[new]

        look(np.arange(len(sym)))
        done_seg, done_sym, done_pos = [], [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            best = np.minimum.reduceat((order << 32) | np.arange(len(sym)), first)
            open_ = (best >> 32) < _NONE
            size = np.diff(np.concatenate((first, [len(sym)])))
            if not open_.all():
                over = ~np.repeat(open_, size)
                done_seg.append(seg[over])
                done_sym.append(sym[over])
                done_pos.append(pos[over])
            keep = np.repeat(open_, size)
            at = (best[open_] & 0xFFFFFFFF).astype(np.int64)
            sym[at] = made[at]
            keep[at + 1] = False
            where = np.cumsum(keep) - 1
            sym, seg, pos, made, order = (x[keep] for x in (sym, seg, pos, made, order))
            at = where[at]
            if not len(sym):
                break
            near = np.concatenate((at, at[at > 0] - 1))
            made[near], order[near] = -1, _NONE
            look(near)
        if not done_seg:
            return np.empty(0, np.int32), np.zeros(len(lengths), np.int64)
        seg, sym, pos = map(np.concatenate, (done_seg, done_sym, done_pos))
        return sym[np.lexsort((pos, seg))], np.bincount(seg, minlength=len(lengths))

    def merge_one(self, symbols: np.ndarray, key: np.uint64 | None = None, limit: np.uint64 = np.uint64(0)) -> np.ndarray:
        """The pieces of one segment, by a heap of candidates and links between the symbols that are left."""
        n = len(symbols)
        first = self.merged(symbols[:-1], symbols[1:])
        at = np.flatnonzero(first >= 0)
        if key is not None:
            h = mix64(at.astype(np.uint64) << np.uint64(32) | first[at].astype(np.uint64))
            at = at[mix64(key ^ h) >= limit]
        sym, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = list(zip(self.rank[first[at]].tolist(), at.tolist(), symbols[at].tolist(), symbols[at + 1].tolist(), first[at].tolist(), strict=True))
        heapq.heapify(heap)
        made_of, rank = self.pairs(), self.rank
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # a side has been merged since
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left < 0 or right >= n:
                    continue
                new = made_of.get(sym[left] << 20 | sym[right], -1)
                if new < 0:
                    continue
                if key is not None:
                    h = mix64(np.array([left << 32 | new], np.uint64))
                    if mix64(key ^ h)[0] < limit:
                        continue
                heapq.heappush(heap, (int(rank[new]), left, sym[left], sym[right], new))
        out = np.array(sym, np.int32)
        return out[out >= 0]

    def pairs(self) -> dict[int, int]:
        """The piece of each pair of symbols, as a dictionary."""
        if not hasattr(self, "_pairs"):
            some = self.keys >= 0
            self._pairs = dict(zip(self.keys[some].tolist(), self.made[some].tolist(), strict=True))
        return self._pairs

    def encode(self, texts: list[str], rows: np.ndarray, dropout: float = 0.0, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, one after another, and their number for each; rows: a key of each text for its skips."""
        body = [" " + t if t else "" for t in texts]
        code = np.frombuffer("".join(body).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(code):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        size = np.fromiter(map(len, body), np.int64, len(body))
        text_at = np.concatenate(([0], np.cumsum(size)))
        symbol = self.char_id[code]
        symbol = np.where((symbol < 0) | ((symbol >= self.n_pieces) & (self.place[code] == 0)), code + _FOREIGN, symbol).astype(np.int32)
        cut = np.ones(len(code), bool)
        place = self.place[code]
        cut[1:] = ~self.beside[place[:-1], place[1:]]
        cut[text_at[:-1][size > 0]] = True
        first = np.flatnonzero(cut)
        owner = np.repeat(np.arange(len(body)), size)[first]
        ends = np.concatenate((first[1:], [len(code)]))
        segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.concatenate((first, ends[-1:])) * 4), pa.py_buffer(symbol)])
        coded = segments.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(coded.dictionary)
        start = np.frombuffer(coded.dictionary.buffers()[1], np.int64, n + 1) // 4
        letters = np.frombuffer(coded.dictionary.buffers()[2], np.int32, int(start[-1]))
        length = np.diff(start)
        long_ = length > LONG
        short = letters[~np.repeat(long_, length)] if long_.any() else letters
        size_short = np.where(long_, 0, length)
        at, key, limit = which.copy(), None, np.uint64(0)
        if dropout > 0:
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            out, counts = self.merge_all(short, size_short, seen=seen)
            inside = np.arange(len(first)) - np.searchsorted(first, text_at)[owner]
            key = mix64(mix64(rows.astype(np.uint64) ^ mix64(np.array([seed], np.int64).view(np.uint64)))[owner] + inside.astype(np.uint64))
            limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
            again = self._skipping(which, key, limit, n, seen)
            of = which[again]
            size_of = length[of]
            pick = np.arange(int(size_of.sum())) + np.repeat(start[of] - (np.cumsum(size_of) - size_of), size_of)
            more, n_more = self.merge_all(letters[pick], size_of, key[again], limit)
            out, counts = np.concatenate((out, more)), np.concatenate((counts, n_more))
            at[again] = n + np.arange(len(again))
        else:
            out, counts = self.merge_all(short, size_short)
        if long_.any():
            own = np.flatnonzero(long_[which])
            merged = [self.merge_one(letters[start[w] : start[w + 1]], None if key is None else key[o], limit) for o, w in zip(own, which[own], strict=True)]
            at[own] = len(counts) + np.arange(len(own))
            out, counts = np.concatenate((out, *merged)), np.concatenate((counts, [len(m) for m in merged]))
        out, counts = self._spell(out, counts)
        n_each = counts[at]
        ends = np.cumsum(n_each)
        base = (np.cumsum(counts) - counts)[at]
        ids = out[np.arange(int(ends[-1])) + np.repeat(base - (ends - n_each), n_each)]
        return ids, np.bincount(owner, weights=n_each, minlength=len(body)).astype(np.int64)

    def _skipping(self, which: np.ndarray, key: np.ndarray, limit: np.uint64, n: int, seen: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The occurrences (segment and key of each) that skip one of their segment's candidates or more; the others are merged as without dropout."""
        if not seen:
            return np.empty(0, np.int64)
        of, h = map(np.concatenate, zip(*seen, strict=True))
        h = h[np.argsort(of, kind="stable")]
        number = np.bincount(of, minlength=n)
        base, each = (np.cumsum(number) - number)[which], number[which]
        ends = np.cumsum(each)
        begin = ends - each
        cuts = np.append(np.searchsorted(ends, np.arange(0, max(int(ends[-1]), 1), CANDIDATES)), len(which)).tolist()
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            who = np.repeat(np.arange(lo, hi), each[lo:hi])
            at = np.arange(len(who)) + np.repeat(base[lo:hi] - (begin[lo:hi] - begin[lo]), each[lo:hi])
            out.append(np.unique(who[mix64(key[who] ^ h[at]) < limit]))
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _spell(self, out: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become their bytes."""
        odd = np.flatnonzero((out >= _FOREIGN) | ((out >= self.n_pieces) & (out < _FOREIGN)))
        if not len(odd):
            return out, counts
        inverse = {int(v): k for k, v in enumerate(self.char_id) if v >= self.n_pieces} if (out[odd] < _FOREIGN).any() else {}
        spelled = {int(c): self.byte_id[list(chr(c - _FOREIGN if c >= _FOREIGN else inverse[int(c)]).encode("utf-8", "surrogatepass"))] for c in np.unique(out[odd])}
        width = np.ones(len(out), np.int64)
        width[odd] = [len(spelled[int(c)]) for c in out[odd]]
        at = np.cumsum(width) - width
        full = np.empty(int(width.sum()), np.int32)
        plain = np.ones(len(out), bool)
        plain[odd] = False
        full[at[plain]] = out[plain]
        for i in odd:
            full[at[i] : at[i] + width[i]] = spelled[int(out[i])]
        owner = np.repeat(np.arange(len(counts)), counts)
        return full, np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts as UTF-8: the pieces' bytes without the leading space."""
        width = (self.piece_at[1:] - self.piece_at[:-1])[ids]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.piece_bytes[np.arange(total) + np.repeat(self.piece_at[ids] - (ends - width), width)].tobytes()
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [raw[a + 1 : b] for a, b in zip(upto[:-1], upto[1:], strict=True)]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def row_keys(doc_ids: pa.Array) -> np.ndarray:
    """A key of each row for its skips; null ids are -1."""
    return np.array([-1 if d is None else d for d in doc_ids.to_pylist()], np.int64).view(np.uint64)


REPORT = "doc_id long, n_tokens long, ids_crc32 long, lossless boolean"
PIECES = "doc_id long, ids array<int>"


def _encoder(path: str, dropout: float, seed: int, report: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for lo, hi in text_parts(batch.column("text"), PART_BYTES):
                names = batch.column("doc_id")[lo:hi]
                texts = [t or "" for t in batch.column("text")[lo:hi].to_pylist()]
                ids, counts = model.encode(texts, row_keys(names), dropout, seed)
                at = np.concatenate(([0], np.cumsum(counts)))
                if not report:
                    yield pa.RecordBatch.from_pydict({"doc_id": names, "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))})
                    continue
                back = model.decode(ids, counts)
                wide = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                same = [t.encode("utf-8", "surrogatepass") == b for t, b in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": names, "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64()), "lossless": same})

    return run


def _encoded(docs: DataFrame, vocabulary: str, schema: str, dropout: float, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(vocabulary, dropout, seed, schema == REPORT), schema)


def encode_documents(docs: DataFrame, vocabulary: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id and ids of every row's text. Null and empty texts: no ids. A literal U+2581 is spelled in bytes, so that decoding
    is lossless. Rows alike in doc_id and text are encoded alike; nothing is shuffled, so skew and order don't matter."""
    return _encoded(docs, vocabulary, PIECES, dropout, seed)


def encode_report(docs: DataFrame, vocabulary: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, crc32 of the ids as little-endian 32-bit integers, and whether decoding them gave the text back."""
    return _encoded(docs, vocabulary, REPORT, dropout, seed)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); no or null ids: an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(vocabulary)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            counts = np.array([len(x) for x in lists], np.int64)
            back = model.decode(np.array([i for x in lists for i in x], np.int64), counts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([b.decode("utf-8", "replace") for b in back], pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
