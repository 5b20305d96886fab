"""Golay keys, divergence and collocations against plain versions, with nulls, empty texts, ties, repeated rows, empty tables and further columns."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import collocations, divergence, golay
from loomgraph.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, fp int, term string, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


def lowered(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


# ---- 11 ----


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=2):
    """Least id that each reaches; a null id is never the least."""
    group = list(range(len(fps)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
            group[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, f, least.get(find(i))) for i, (doc, f) in enumerate(fps)]


def test_the_code_is_perfect():
    every = np.arange(1 << 23, dtype=np.int32)
    error = golay.errors()[golay.syndrome(every)]
    assert np.bitwise_count(error).max() == 3
    assert not golay.syndrome(every ^ error).any()  # each word, its error taken off, is a codeword
    words = every[golay.syndrome(every) == 0]
    assert len(words) == 4096 and np.bitwise_count(words[1:]).min() == 7 and len(set(golay.codeword_index(words))) == 4096


def test_fingerprints_two_bits_apart_share_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    flips = [0, *(1 << b for b in range(64)), *((1 << a) | (1 << b) for a, b in combinations(range(64), 2))]
    for u in base[:6]:
        other = np.array([int(u) ^ f for f in flips], np.uint64)
        row, key = golay.keys(other.view(np.int64))
        own = set(golay.keys(np.array([u]).view(np.int64))[1])
        assert set(row[np.isin(key, list(own))]) == set(range(len(flips)))
    row, _ = golay.keys(base.view(np.int64))
    assert len(row) <= 18 * len(base)


@pytest.mark.parametrize(("bucket", "spread"), [(64, 20_000), (2, 20_000), (2, 3)])
def test_links_are_brute_force(spark, bucket, spread):
    """A chain, a cloud about one fingerprint (a large bucket), pairs two bits apart and pairs three bits apart."""
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    cloud = rng.getrandbits(64)
    fps |= {cloud} | {cloud ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    for n in (1, 2, 3):
        for _ in range(40):
            f = rng.getrandbits(64)
            fps |= {f, f ^ sum(1 << b for b in rng.sample(range(64), n))}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    table = spark.createDataFrame(signed, "fp long")
    scratch = Scratch(spark)
    got = {(u % (1 << 64), v % (1 << 64)) for u, v in golay.links(table, scratch, bucket=bucket, spread=spread).collect()}
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 2}
    scratch.clear()
    with pytest.raises(ValueError, match="radius 3"):
        golay.links(table, scratch, radius=3)


def test_near_groups(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    base = [rng.choice(words) for _ in range(4000)]
    texts = ["", None, "  \t", "one", "One", "one two", "a b c", "a\u0085b", "É x y z", "é x y z", " ".join(base), "long " * 40_000]
    for k in range(30):  # edits of a long text move few bits
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    rows = [(7 * k % 101, t, "en", "s") for k, t in enumerate(texts)]
    rows += [rows[3], (None, "one", "en", "s"), (None, "only here with a null id", None, None), (None, "", None, None)]
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in golay.report(docs(spark, rows)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})  # some different fingerprints are linked
    assert golay.report(docs(spark, [])).count() == 0
    kept = golay.drop_near_copies(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c for _, _, c in want if c is not None}
    tight = [(r.doc_id, r.component_id) for r in golay.near_groups(docs(spark, rows), radius=0).collect()]
    assert sorted(tight, key=key) == sorted([(d, c) for d, _, c in plain_components([(r[0], plain_fingerprint(r[1])) for r in rows], 0)], key=key)


# ---- 12 ----


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcé中", max_size=6), max_size=40), st.lists(st.text("abcdé", max_size=7), max_size=20))
def test_transducers_number_terms_in_order(terms, others):
    kept = sorted(t.encode() for t in terms)
    made = divergence.Transducer(kept)
    assert made.terms == len(kept)
    text = lambda some: b"".join(t + b"\n" for t in some)
    assert made.ordinals(text(kept)).tolist() == list(range(len(kept)))
    assert [made.term(k) for k in range(len(kept))] == kept
    asked = [o.encode() for o in others]
    assert made.ordinals(text(asked)).tolist() == [kept.index(o) if o in kept else -1 for o in asked]
    # minimal: as many states as there are different sets of endings, of prefixes that lead on
    endings = {frozenset(t[len(p) :] for t in kept if t.startswith(p)) for t in [*kept, b""] for p in (t[:k] for k in range(len(t) + 1))}
    assert made.states == len(endings)


def test_terms_out_of_order_are_refused():
    for wrong in ([b"b", b"a"], [b"a", b"a"]):
        with pytest.raises(ValueError, match="sorted"):
            divergence.Transducer(wrong)


def plain_audit(rows, least=3, top=200):
    own = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r[1]))) for r in rows]
    out = []
    for lang in {o[0] for o in own}:
        mine = [o for o in own if o[0] == lang]
        seen = Counter(t for o in mine for t in set(o[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, found in mine:
            counts[source].update(t for t in found if t in kept)
        every = sum(counts.values(), Counter())
        p = lambda c, t, kept=kept: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for source, c in counts.items():
            pair = [(sum(f(p(c, t), p(d, t)) for t in kept), other) for other, d in counts.items() if other != source]
            term = [(f(p(c, t), p(every, t)), t) for t in c if c[t] > 0 and p(c, t) > p(every, t)]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return out


@pytest.mark.parametrize(("range_terms", "top"), [(50_000, 200), (7, 200), (1, 3)])
def test_audit_is_brute_force(spark, range_terms, top):
    rng = random.Random(7)
    vocabulary = {lang: [f"{p}{q}{s}" for p in ("ab", "Ba", "é", "日") for q in ("x", "ö") for s in ("", lang, "z")] for lang in ("en", "de", "")}
    rows = []
    for k in range(120):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["a", "b", "Z", "é", None]) if rng.random() < 0.6 else "a"
        w = vocabulary[lang or ""]
        rows.append((k, " ".join(w[min(int(rng.expovariate(0.3)), len(w) - 1)] for _ in range(rng.randrange(30))) + rng.choice(["", "?", "1x", " rare%d" % k]), lang, source))
    rows += [rows[0], rows[0], (None, None, "en", "none"), (1, "", "fr", "x"), (2, None, "fr", "y"), (3, "word " * 30_000, "en", "long"), (4, "lone", "xx", "one")]
    got = [tuple(r) for r in divergence.audit(docs(spark, rows), top=top, range_terms=range_terms).collect()]
    assert sorted(got) == sorted(plain_audit(rows, top=top))
    assert any(r[2] == "pair" and r[4] > 0 for r in got) and any(r[0] == "fr" and r[4] == 0 for r in got)


def test_audit_of_nothing(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    assert divergence.audit(docs(spark, [(1, "a b", "en", "s")])).count() == 0
    assert sorted(tuple(r) for r in divergence.audit(docs(spark, [(1, None, "en", "s"), (2, "", "en", "t")])).collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_probabilities_are_exact_beyond_64_bits(spark):
    n = 12_345_678_901_234
    row = spark.range(1).select(divergence.probability(F.lit(n), F.lit(n + 7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (n + 7)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_PART", 5)
    monkeypatch.setattr(collocations, "_PART", 5)
    text = "Alpha beta, gammadelta. É é x  y;z " * 5
    assert [t.decode() for part in divergence.terms(text) for t in part] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
    one = b" ".join(w for part in collocations.words(text) for w in part)
    monkeypatch.setattr(collocations, "_PART", 4_000_000)
    whole = b" ".join(w for part in collocations.words(text) for w in part)
    assert re.sub(rb"( ?\.)+", b".", one) == re.sub(rb"( ?\.)+", b".", whole)


# ---- 13 ----


def plain_phrases(rows, top, least=10, within=50):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        f, n = Counter(), 0
        for r in rows:
            if (r[2] or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(r[1])):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    n += len(w)
                    for size in (1, 2, 3):
                        f.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {sub for p, a in candidates.items() if len(p) == 3 for sub in (p[:2], p[1:]) if 100 * a >= within * f[sub]}
        found = []
        for p, a in candidates.items():
            if p not in gone:
                s, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                found.append((-s, -a, " ".join(p).encode(), " ".join(p), l, r))
        out += [(lang, i + 1, p, -a, l, r, n, -s) for i, (s, a, _, p, l, r) in enumerate(sorted(found)[:top])]  # noqa: E741
    return out


def phrase_rows():
    rng = random.Random(8)
    words = [f"{c}{k}" for k in range(12) for c in ("a", "É", "b'")]
    rows = []
    for k in range(220):
        w = [words[min(int(rng.expovariate(0.12)), len(words) - 1)] for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["New york City", "red herring", "in the end", "one two", "one one one one", "tick.tock", "a b c"]))
        sep = rng.choice([" ", "\t", "  "])
        rows.append((k, sep.join(x + rng.choice(["", "", ",", "!", "\n", "\x0b"]) for x in w), rng.choice(["en", "en", "de", None, "und"]), "s"))
    return [*rows, rows[1], rows[1], (None, None, "en", None), (1, "", None, None), (2, "...", "fr", None), (3, "lang text " * 30_000, "de", "s")]


@pytest.mark.parametrize(("top", "step"), [(2000, 2), (5, 1), (5, 2), (20, 1), (60, 1)])
def test_phrases_are_brute_force(spark, top, step):
    rows = phrase_rows()
    got = [tuple(r) for r in collocations.phrases(docs(spark, rows), top=top, step=step).collect()]
    assert sorted(got) == sorted(plain_phrases(rows, top))


def test_phrases_of_nothing(spark):
    for rows in ([], [(1, None, None, None)], [(1, "a b", "en", "s")]):
        assert collocations.phrases(docs(spark, rows)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 98_765_432_109_876, 99_765_432_109_871, 98_765_999_109_873  # noqa: E741
    assert spark.range(1).select(collocations.score(*(F.lit(x) for x in (a, l, r)))).first()[0] == 10**6 * a * a // (l * r)


def test_filters_have_what_they_were_made_of(spark):
    hashes = spark.range(3000).select(F.xxhash64(F.lit("en"), F.col("id").cast("string").cast("binary")).alias("h"))
    seed = xxhash.xxh64_intdigest(b"en", 42)
    own = np.array([xxhash.xxh64_intdigest(str(k), seed) for k in range(100_000)], np.uint64)
    fit, tight = collocations.Filter.of(hashes), collocations.Filter.of(hashes, 1 << 12)
    assert fit.has(own[:3000]).all() and tight.has(own[:3000]).all()
    assert fit.has(own[3000:]).mean() < 0.05 < tight.has(own[3000:]).mean()


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_shared", lambda spark, hashes: spark.sparkContext.broadcast(collocations.Filter.of(hashes, 64)))
    rows = phrase_rows()
    assert sorted(tuple(r) for r in collocations.phrases(docs(spark, rows), top=10).collect()) == sorted(plain_phrases(rows, 10))


def test_ranges_dealt_to_several_tasks_count_alike(spark):
    rng = random.Random(10)
    rows = [(k, " ".join(rng.choice(["ab", "Ac", "öd", "x"]) + rng.choice("abc") for _ in range(40)), rng.choice(["en", "de", ""]), rng.choice("st")) for k in range(80)]
    own = divergence._emptied(docs(spark, rows).repartition(6))
    scratch = Scratch(spark)
    kept = scratch.write(divergence.kept_terms(own))
    one, vocabulary = divergence.recount(own, kept, scratch, 5)
    many, _ = divergence.recount(own, kept, scratch, 5, 10)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    for lang in ("en", "de", ""):
        found = [bytes(r.term) for r in vocabulary.where(F.col("lang") == lang).orderBy("ordinal").collect()]
        assert found == sorted(found) and found


@pytest.mark.parametrize("whole", [True, False])
def test_terms_combined_in_small_parts_count_alike(monkeypatch, whole):
    monkeypatch.setattr(divergence, "_PART", 7)
    monkeypatch.setattr(divergence, "HELD", 20)
    rows = [("en", "ab AB cd, ab"), ("", ""), ("en", "1 2 -"), ("de", "Ü xß ab cdefghijkl ab xß"), ("en", "cd a ab abc"), ("de", "ab"), ("de", "ab")]
    got, want = {}, {}
    for keys, names, key, term, n in divergence._combined([(lang, text.encode()) for lang, text in rows], whole):
        assert names.to_pylist() == sorted(names.to_pylist())
        for k, t, c in zip(key.tolist(), term.tolist(), n.tolist(), strict=True):
            at = (keys[k][0], names[t].as_py().decode().removesuffix("\n"))
            got[at] = got.get(at, 0) + c
    for lang, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        for t in set(found) if whole else found:
            want[lang, t] = want.get((lang, t), 0) + 1
    assert got == want
