"""Files that tasks write, list and read."""

import duckdb
from pyspark.sql import functions as F

from loomgraph.plans.queries import ORACLES, QUERIES
from loomgraph.sources import formats


def test_files_of_odd_tables_are_the_sql(spark, tmp_path):
    """Null and empty texts, names that repeat or lack a part, white space that SQL keeps."""
    odd = ["# a\n\nb. \xa0c", "\x0bd\x0b\n\n e", "f\x1c", " \n", "", None, "x. " * 3000 + "　", "g\r\n\r\nh\ti"]
    docs = [(k, t, lang, "s", 1) for t in odd for k, lang in ((1, "en"), (1, "es"), (1, "fr"), (2, None), (None, "en"))]
    pages = [(k, "u", h) for k in (1, 2, 2, None) for h in ("<p>a</p>", "", None)]
    turns = [(c, t, r, x) for c in (1, 1, None, -2) for t in (0, None) for r in ("user", None) for x in odd]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("pages", pages, "page_id long, url string, html string"), ("conversations", turns, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(ORACLES["src1_scan_files"]).fetchall()
    got = [tuple(r) for r in QUERIES["src1_scan_files"](spark, str(tmp_path)).select("name", "format", "content").collect()]
    assert len(got) == len(docs) + len(pages) + len(turns)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tasks_list_folders_and_names_are_not_written_over(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k % 300}.txt", f"text {k}") for k in range(1500)] + [("a.pdf", "p"), ("b", "q"), ("empty.md", "")], "name string, text string").repartition(2)
    listed = spark.createDataFrame(formats.write_folders(rows, f"file://{tmp_path}/in").collect())
    assert listed.agg(F.sum("n")).first()[0] == 1503 and listed.agg(F.max("n")).first()[0] <= formats.FILES
    found = formats.folder_files(listed, tasks=3)
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    read = formats.chunked(found).select("path", "reason", "parts").collect()
    assert sorted(r.parts[0] for r in read if r.path.endswith(".txt")) == sorted(f"text {k}" for k in range(1500))
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in read if r.reason} == {("a.pdf", "unsupported type: pdf"), ("b", "unsupported type: none")}
    assert [r.parts for r in read if r.path.endswith("empty.md")] == [[""]] and len({r.path for r in read}) == 1503
    assert {r.reason for r in formats.folder_files(listed, largest=3).collect()} >= {"too large"}
