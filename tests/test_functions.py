"""Pairs of inputs and outputs that the functions must keep, and plain versions of the folds."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import logs, merge, ontology, resolve, search
from loomgraph.sources import documents as D


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_canonical_names(spark):
    pairs = {"SILRES® BS 5137": "silres bs 5137", "Product™ Name": "product name", "ﬁne": "fine", "  hello   world  ": "hello world", "500 mPa·s": "500 mpa·s", "": "", "Élan Vital": "elan vital"}
    assert apply(spark, T.canonical_name, list(pairs)) == list(pairs.values())


def test_search_terms_and_keywords(spark):
    pairs = {"**bold text**": "bold text", "[test] (value)": "test value", "®™©": ""}
    assert apply(spark, T.search_term, list(pairs)) == list(pairs.values())
    got = apply(spark, lambda c: T.keywords(c, search.NOISE), ["silres bs 1052", "viscosity", "the flow of a pump"])
    assert got == [["silres bs 1052", "bs 1052", "silres", "1052", "bs"], ["viscosity"], ["flow pump", "pump", "flow"]]


def test_sentences(spark):
    text = "One. Two! Three? Four... Five. Six. Seven. Eight. Nine. Ten."
    assert apply(spark, T.truncate_sentences, ["a. b.", text])[0] == "a. b."
    rng = random.Random(3)
    texts = ["One. Two!  x", "", "  ", "...", "?"] + ["".join(rng.choice("ab .!?\n") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    want = []
    for t in texts:
        out, cur = [], ""
        for c in t:
            cur += c
            if c in ".!?" and len(cur.strip()) > 1:
                out.append(cur.strip())
                cur = ""
        want.append(out + ([cur.strip()] if cur.strip() else []))
    assert apply(spark, T.sentences, texts) == want


def plain_long(text, size):
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(cur) + len(s) < size:
            cur = f"{cur} {s}" if cur else s
        else:
            out += [cur.strip()] if cur else []
            cur = s
    return out + ([cur.strip()] if cur else [])


def plain_paragraphs(text, size):
    out, cur = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(cur) + len(p) < size:
            cur = f"{cur}\n\n{p}" if cur else p
            continue
        out += [cur] if cur else []
        cur = ""
        if len(p) > size:
            out += plain_long(p, size)
        else:
            cur = p
    out += [cur] if cur else []
    return out or [text.strip()]


def test_chunks_are_the_plain_fold(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "end. ", "so! ", "\n\n", "longer words here ", "\n \n"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["", "  "]
    assert apply(spark, lambda c: D.paragraph_chunks(c, 80), texts) == [plain_paragraphs(t, 80) for t in texts]


def test_json_repair():
    r = ontology.repair_json
    assert r('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert r('{"a": True, "b": None,}') == '{"a": true, "b": null}'
    assert r('{"a": 1} // note') == '{"a": 1}'
    assert r('text before {"a": [1, 2]} after') == '{"a": [1, 2]}'
    assert r('{"entities": [{"text": "hello"') == '{"entities": [{"text": "hello"}]}'
    assert r("") is None and r("not json") is None and r(None) is None


def test_actions(spark):
    cases = [
        ("Action: FIND(BS 1052)", ("FIND", "BS 1052", False)),
        ("Action: SCHEMA()", ("SCHEMA", "", False)),
        ("Thought: both\nAction: COMPARE(bs 1052, bs 5137)", ("COMPARE", "bs 1052, bs 5137", False)),
        ("no action", (None, None, False)),
        ("SCHEMA()", (None, None, False)),
        ("Action: MERGE(a)", (None, None, False)),
        ("Action: FIND(a)\nAction: FIND(b)", ("FIND", "a", True)),
        ("x\nAction: LIST(a (b))\nObservation: y\n\nAction: ANSWER(no)\nAction: SCHEMA()", ("LIST", "a (b)", True)),
        ("Action: GRAPH_QUERY(`\nMATCH (n)\nRETURN n\n`)", ("GRAPH_QUERY", "MATCH (n)\nRETURN n", False)),
        ("Action: GRAPH_QUERY(```cypher\nMATCH (n)\nRETURN n\n```)", ("GRAPH_QUERY", "MATCH (n)\nRETURN n", False)),
        ('Action: SECTION_TEXT("\nfirst\nsecond")', ("SECTION_TEXT", "first\nsecond", False)),
        ("Action: ANSWER(It is 5 (five)\nand more (six))", ("ANSWER", "It is 5 (five)\nand more (six)", False)),
        ("Action: ANSWER(five) ) )\n", ("ANSWER", "five", False)),
        ('[TOOL_CALL] {tool => "answer", args => { --text "it is so" } } [/TOOL_CALL]', ("ANSWER", "it is so", False)),
        ('[TOOL_CALL] {tool => "find", args => { --text "x" } } [/TOOL_CALL]', (None, None, False)),
        (None, (None, None, False)),
    ]
    got = apply(spark, logs.parse_action, [c for c, _ in cases])
    assert [tuple(g) for g in got] == [want for _, want in cases]


def test_answers_in_texts(spark):
    assert apply(spark, T.clean_answer, [r"a\nb\tc\_d", r' \"x\" ', None]) == ["a\nb\tc_d", r' \"x\" ', None]
    cases = [
        ("The FINAL answer: 42 grams ", "42 grams"),
        ("In conclusion: it holds\nfor both", "it holds\nfor both"),
        ("In conclusion, it holds", "In conclusion, it holds"),
        ("We looked. Thus: nothing", "nothing"),
        ("Thought: first of them is quite long\nAction: X\nThought: and the last one is long too\nAction: Y", "and the last one is long too"),
        ("Thought: brief", "Thought: brief"),
        ("  words only ", "words only"),
        ("", T.NO_ANSWER),
        (None, T.NO_ANSWER),
    ]
    assert apply(spark, T.inline_answer, [c for c, _ in cases]) == [want for _, want in cases]


def test_headings_and_chunks(spark):
    assert apply(spark, T.product_prefix, ["<page_1># Cat - x", "#\nfoo - bar", "## — none\n### FZ – y"]) == ["Cat", "", "FZ"]
    assert apply(spark, D.markdown_chunks, ["intro\n\nmore", "# a\nx\n## b\ny", "x" * 1500 + "\n\n" + "y" * 1500]) == [["intro\n\nmore"], ["# a\nx", "## b\ny"], ["x" * 1500, "y" * 1500]]


def test_numbered_names_do_not_meet(spark):
    """Candidates of names that differ in numbers alone do not grow with their square."""
    n = 400
    df = spark.createDataFrame([("T", f"supplier#{k:09d}") for k in range(n)] + [("T", "supplier#")], "label string, name string")
    assert resolve.ratio_candidates(df).count() <= n
    inside = resolve.containment_pairs(df)
    assert {(r.a, r.b) for r in inside.collect()} == {("supplier#", f"supplier#{k:09d}") for k in range(n)}
    assert apply(spark, lambda c: resolve.similarity_ratio(c, c), ["ab", None]) == [1.0, None]


def test_fuzzy_new_names_are_a_sequential_insert(spark):
    rng = random.Random(19)
    base = ["polydimethylsiloxane", "silicone resin", "blue widget 12", "blue widget 13", "steel"]
    names = ["".join(c for c in rng.choice(base) if rng.random() > 0.04) + rng.choice(["", "", "s", " x"]) for _ in range(60)]
    known, batch = sorted(set(names[:10])), names[10:]
    have, want = [("T", n) for n in known], set()
    for n in batch:
        inside = lambda x, y: len(x) >= 4 and x in y and len(x) / len(y) >= 0.35
        alike = lambda m: m == n or inside(m, n) or inside(n, m) or ((re.findall(r"\d+", m) == re.findall(r"\d+", n) or not re.search(r"\d", m) or not re.search(r"\d", n)) and max(SequenceMatcher(None, m, n).ratio(), SequenceMatcher(None, n, m).ratio()) >= 0.9)  # noqa: B023, E731
        if not any(alike(m) for _, m in have):
            have.append(("T", n))
            want.add(n)
    b = spark.createDataFrame([(i, "T", n, 0.5, "d") for i, n in enumerate(batch)], "ord long, label string, text string, confidence double, source_doc string")
    k = spark.createDataFrame(have[: len(known)], "label string, canonical_name string")
    got = resolve.new_names(b, k, 0.9)
    assert {r.canonical_name for r in got.collect()} == want
    assert {r.canonical_name for r in resolve.new_names(b, k).collect()} == set(batch) - set(known)


def test_code_of_any_mention_names_the_group(spark):
    rows = [(1, "T", "resin (AB®)", 0.9, "d"), (2, "T", "resin (AB)", 0.4, "d"), (3, "T", "AB — other thing", 0.5, "d"), (4, "T", "Steel", 0.95, "e")]
    g = resolve.exact_groups(spark.createDataFrame(rows, "ord long, label string, text string, confidence double, source_doc string"))
    first = {r.canonical_name: r.code for r in g.collect()}
    assert tuple(first["resin (ab)"]) == (2, "ab") and first["steel"] is None
    out = resolve.resolved(g, resolve.leaders(g, resolve.same_pairs(g))).collect()
    assert {r.canonical_name for r in out if r.n_names > 1} == {"AB"}


def test_ratio_blocking_loses_no_pair(spark):
    rng = random.Random(6)
    base = ["polydimethylsiloxane", "silicone resin", "blue widget 12", "bs", "steel"]
    names = sorted({"".join(c for c in b if rng.random() > 0.06) + rng.choice(["", "s", " x"]) for b in base for _ in range(25)} - {""})
    df = spark.createDataFrame([("T", n) for n in names], "label string, name string")
    for t in (0.9, 0.8):
        got = {(r.a, r.b) for r in resolve.ratio_candidates(df, t).collect()}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                da, db = set(re.findall(r"\d+", a)), set(re.findall(r"\d+", b))
                if (da == db or not da or not db) and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= t:
                    assert (a, b) in got


def test_leaders_are_the_sequential_result(spark):
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(24)]
    for _ in range(3):
        pairs = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.12}
        leader = {}
        for i, a in enumerate(names):
            if a not in leader:
                leader[a] = a
                for b in names[i + 1 :]:
                    if b not in leader and (a, b) in pairs:
                        leader[b] = a
        g = spark.createDataFrame([("T", n, i) for i, n in enumerate(names)], "label string, canonical_name string, ord int")
        got = {r.canonical_name: r.leader for r in resolve.leaders(g, spark.createDataFrame([("T", *p) for p in pairs], "label string, a string, b string")).collect()}
        assert got == leader


def test_resolution_examples(spark):
    rows = [(0, "P", "Apple", 0.8, "d1"), (1, "P", "apple", 0.9, "d2"), (2, "I", "water", 0.5, "d1"), (3, "Q", "water", 0.5, "d1"), (4, "P", "silicone resin", 0.4, "d3"), (5, "P", "silicone resin emulsion", 0.6, "d4"), (6, "P", "FZ — förzinkat", 0.2, "d5"), (7, "P", "zinc (FZ)", 0.3, "d6")]
    g = resolve.exact_groups(spark.createDataFrame(rows, "ord long, label string, text string, confidence double, source_doc string"))
    out = {(r.label, r.canonical_name): r for r in resolve.resolved(g, resolve.leaders(g, resolve.same_pairs(g))).collect()}
    assert set(out) == {("P", "apple"), ("I", "water"), ("Q", "water"), ("P", "silicone resin emulsion"), ("P", "FZ")} | set()
    assert out[("P", "apple")].confidence == 0.9 and out[("P", "apple")].source_docs == "d1, d2"


def test_merging_twice_changes_only_sources(spark):
    rows = [("P", "a", 1, "A", 0.4, None, "d1", "2024-01-02"), ("P", "a", 2, "a", 0.9, True, "d2", "2024-01-01")]
    b = spark.createDataFrame(rows, "label string, canonical_name string, ord long, text string, confidence double, verified boolean, source_doc string, seen string")
    one = merge.merge_nodes(None, b)
    two = merge.merge_nodes(one, b)
    x, y = one.first().asDict(), two.first().asDict()
    assert {k for k in x if x[k] != y[k]} == {"source_docs"} and y["source_docs"] == "d1, d2, d1, d2"


def test_html_and_mail():
    page = "<html><head><style>p{}</style><script>x()</script></head><body><nav>menu</nav><h1>Title</h1><p>One &amp; two</p><footer>f</footer></body></html>"
    assert D.visible_text(page).split() == ["Title", "One", "&", "two"] and D.visible_text(None) == ""
    head, body = D.mail_text("From: a@b\nSubject: s\nContent-Type: text/html\n\n<p>hi</p>")
    assert head == "From: a@b\nSubject: s" and body == "hi"
    assert D.visible_text("<p>a <b>bold</b> word</p>") == "a \n\nbold\n\n word"
    odd = "From: a@b\nContent-Type: text/plain; charset=x-none\n"
    assert D.mail_text(odd + "\ngrüße\n") == ("From: a@b", "grüße")
    assert D.mail_text(odd + "Content-Transfer-Encoding: quoted-printable\n\ngr=C3=BC=C3=9Fe\n") == ("From: a@b", "grüße")


@pytest.mark.parametrize(("raw", "kind", "number"), [(" 12 ", "int", 12.0), ("1.5", "float", 1.5), ("x1", "text", None), ("", "text", None), ("-3", "int", -3.0)])
def test_typed_cells(spark, raw, kind, number):
    r = apply(spark, T.typed_cell, [raw])[0]
    assert (r.kind, r.number) == (kind, number)
