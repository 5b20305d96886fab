"""Mentions of names: runs of words that no name can be are not shuffled."""

import re

from counted import shuffled_records

from loomgraph.functions import register


def test_only_runs_that_may_be_names_are_shuffled(spark):
    texts = ["Ab cd ef, ab. cd!  #x-1 " * 200, None, "", "... ", "ab", "cd EF", "no name at all " * 1000]
    names = ["ab", "AB cd", "cd ef ab", "ab cd ef ab", "ef, ab", "#x", "gone", "", None, "1 ab cd", "cd "]
    known = {n.lower() for n in names if n is not None}
    want = []
    for k, text in enumerate(texts):
        w = [x for x in re.split(r"[^\w#]+", (text or "").lower()) if x]
        want += [(k, " ".join(w[i : i + n]), "N", i + 1, 1.0) for n in (1, 2, 3) for i in range(len(w) - n + 1) if " ".join(w[i : i + n]) in known]
    sections = spark.createDataFrame(list(enumerate(texts)), "section_id long, text string").repartition(3)
    found = register.gazetteer_mentions(sections, spark.createDataFrame([(n, "N") for n in names * 2], "name string, label string"), 3)
    got = []
    n = shuffled_records(spark, lambda: got.extend(tuple(r) for r in found.collect()))
    assert sorted(got) == sorted(want) and len(want) > 1000
    assert n < len(want) + 500  # of some 15,000 runs
    one = register.gazetteer_mentions(sections, spark.createDataFrame([("CD", "N"), ("ab cd", "N")], "name string, label string"), 1)
    assert {r.text for r in one.collect()} == {"cd"}
