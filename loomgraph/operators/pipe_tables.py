"""Pipe tables in text: found, parsed and mapped to records, with windows and column functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import canonical_name, column_key, fill_template, predicate_name, product_prefix, strip, typed_cell

ROW, RULE = r"^\|.+\|$", r"^\|[\s\-:|]+\|$"
# Parts of column names that tell numbers and identifiers.
NUMERIC = ("weight", "kg", "flow", "m³/h", "m3/h", "width", "height", "length", "depth", "mm", "cm", "capacity", "pressure", "pa", "kpa", "area", "m²", "m2", "count", "quantity", "volume", "speed", "power", "kw", "temperature", "°c", "rating", "score", "cost", "price")
IDENTIFIER = ("size", "type", "module", "material", "class", "designation", "article", "model", "name", "variant", "category", "code", "id", "label", "grade", "series", "version")


def cells(line):
    """The stripped cells between the outer bars."""
    return F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), strip)


def table_rows(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) to (doc_id, table_no, row_index, columns, cells).

    A table is a row followed by a rule and by rows up to the first other line; page tags are taken out first; tables without
    data rows are none. Lines are classified, and table numbers are running sums over the starts within a document.
    """
    bare = F.regexp_replace("text", r"</?page_\d+>", "")
    lines = texts.select("doc_id", F.posexplode(F.split(bare, "\n")).alias("i", "line")).withColumn("line", strip(F.col("line")))
    kind = F.when(F.col("line").rlike(RULE), "rule").when(F.col("line").rlike(ROW), "row").otherwise("other")
    w = Window.partitionBy("doc_id").orderBy("i")
    lines = lines.withColumn("kind", kind).withColumn("next", F.lead("kind").over(w)).withColumn("before", F.lag("kind").over(w))
    start = (F.col("kind") == "row") & (F.col("next") == "rule")
    lines = lines.withColumn("block", F.sum((start | (F.col("kind") == "other")).cast("int")).over(w)).withColumn("head", start)
    b = Window.partitionBy("doc_id", "block").orderBy("i")
    lines = lines.withColumn("at", F.row_number().over(b) - 1).withColumn("columns", F.first(F.when(F.col("head"), cells(F.col("line")))).over(b))
    # after the rule, the first further rule ends the table
    lines = lines.withColumn("rules", F.sum((F.col("kind") == "rule").cast("int")).over(b))
    data = lines.where(F.col("columns").isNotNull() & (F.col("at") >= 2) & (F.col("kind") == "row") & (F.col("rules") == 1))
    number = Window.partitionBy("doc_id").orderBy("block")
    return data.select("doc_id", F.dense_rank().over(number).alias("table_no"), (F.col("at") - 2).alias("row_index"), "columns", cells(F.col("line")).alias("cells"))


def row_properties(rows: DataFrame) -> DataFrame:
    """table_rows with `props`, map of column key to value: blanks left out, the shorter side ends it, the last of equal keys wins."""
    pairs = F.transform(F.arrays_zip("columns", "cells"), lambda z: F.struct(column_key(z["columns"]).alias("k"), z["cells"].alias("v")))
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (p["v"] != ""))
    made = rows.withColumn("__kept", kept).withColumn("__back", F.reverse(F.transform("__kept", lambda p: p["k"])))  # keys are made once a row
    last = F.filter("__kept", lambda p, i: F.array_position("__back", p["k"]) == F.size("__kept") - i)
    return made.withColumn("props", F.map_from_entries(last)).drop("__kept", "__back")


def row_entities(rows: DataFrame, texts: DataFrame, least_rows: int = 2) -> DataFrame:
    """TABLE_ROW records (doc_id, table_no, row_index, text, canonical_name, confidence): the document's prefix and the row's first cell."""
    prefix = texts.select("doc_id", product_prefix(F.col("text")).alias("prefix"))
    n = Window.partitionBy("doc_id", "table_no")
    r = rows.withColumn("n", F.count("*").over(n)).where(F.col("n") >= least_rows).join(prefix, "doc_id")
    text = strip(F.concat_ws(" ", F.nullif("prefix", F.lit("")), F.get("cells", F.lit(0))))
    return r.select("doc_id", "table_no", "row_index", F.col("prefix"), text.alias("text"), canonical_name(text).alias("canonical_name"), F.lit(1.0).alias("confidence"))


def row_edges(entities: DataFrame, parent_label: str = "") -> DataFrame:
    """HAS_ROW edges from a document's prefix to its rows; without a parent label the store skips them, as their end has no type."""
    return entities.where("prefix != ''").select(F.lit(parent_label).alias("subj_label"), F.col("prefix").alias("subj"), F.lit("HAS_ROW").alias("predicate"), F.lit("TABLE_ROW").alias("obj_label"), F.col("text").alias("obj"), F.lit(0.95).alias("confidence"))


def route(rows: DataFrame, fixed: int = 3, dominated: int = 10) -> DataFrame:
    """doc_id, n_rows, route: from 3 rows tables are parsed, from 10 nothing else of the section is used."""
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    return n.withColumn("route", F.when(F.col("n_rows") >= dominated, "tables_only").when(F.col("n_rows") >= fixed, "tables").otherwise("model"))


def schema_catalog(rows: DataFrame, least_rows: int = 2) -> DataFrame:
    """signature, n_rows of every column signature, and each column's kind."""
    per = rows.groupBy("doc_id", "table_no", F.array_join(F.transform("columns", lambda c: F.lower(c)), "|").alias("signature")).agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    total = per.groupBy("signature").agg(F.sum("n").alias("n_rows"))
    c = F.explode(F.split("signature", r"\|")).alias("column")
    any_of = lambda hints: F.array_max(F.array(*(F.contains(F.col("column"), F.lit(h)).cast("int") for h in hints))) == 1
    return total.select("signature", "n_rows", c).withColumn("kind", F.when(any_of(NUMERIC), "numeric").when(any_of(IDENTIFIER), "identifier").otherwise("other"))


def row_batches(rows: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, table_no, batch, n_rows, body: rows in batches, rendered."""
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    b = rows.withColumn("batch", F.floor(F.col("row_index") / size))
    got = F.array_sort(F.collect_list(F.struct("row_index", line.alias("l"))))
    return b.groupBy("doc_id", "table_no", "batch").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(got, lambda g: g["l"]), "\n").alias("body"))


def _row_text(template: str):
    keys = sorted(set(re.findall(r"\{(\w+)\}", template)))
    return strip(fill_template(F.lit(template), {k: F.coalesce(F.element_at("props", F.lit(k)), F.lit("")) for k in keys}))


def map_row_edges(rows: DataFrame, text_template: str, edges: list[tuple[str, str]]) -> DataFrame:
    """Edges of rows by templates (predicate, source of the object): (doc_id, row_index, subj, predicate, obj).

    The subject is the row's text. The object is the value of the column of that name, else the name itself; a column without a value gives no edge."""
    names = F.transform("columns", lambda c: column_key(c))
    obj = lambda src: F.when(F.array_contains(names, column_key(F.lit(src))), F.element_at("props", column_key(F.lit(src)))).otherwise(F.lit(src))
    made = F.array(*(F.struct(predicate_name(F.lit(p)).alias("predicate"), obj(src).alias("obj")) for p, src in edges))
    out = rows.select("doc_id", "row_index", _row_text(text_template).alias("subj"), F.explode(made).alias("e")).select("doc_id", "row_index", "subj", "e.predicate", "e.obj")
    return out.where("obj is not null and obj != '' and subj != ''")


def map_rows(rows: DataFrame, text_template: str, value_keys: dict[str, str]) -> DataFrame:
    """Rows to records by a template of {key} places, and typed values of the mapped keys: (doc_id, table_no, row_index, text, k, kind, number)."""
    text = _row_text(text_template)
    values = F.array(*(F.struct(F.lit(name).alias("k"), typed_cell(F.element_at("props", F.lit(k))).alias("t")) for k, name in sorted(value_keys.items())))
    out = rows.select("doc_id", "table_no", "row_index", text.alias("text"), F.explode(values).alias("v"))
    return out.select("doc_id", "table_no", "row_index", "text", "v.k", "v.t.kind", "v.t.number")


def coverage(entities: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, n, expected, coverage of extracted records against expected rows."""
    n = entities.groupBy("doc_id").agg(F.count("*").alias("n"))
    return expected.join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), "expected", F.round(F.coalesce("n", F.lit(0)) / F.col("expected"), 4).alias("coverage"))


def table_name(prefix: Column, title: Column) -> Column:
    """`prefix_title`, without underlines at the ends, blanks as underlines."""
    return F.replace(F.regexp_replace(F.concat_ws("_", F.coalesce(prefix, F.lit("")), F.coalesce(title, F.lit(""))), "^_+|_+$", ""), F.lit(" "), F.lit("_"))


def store_tables(rows: DataFrame, texts: DataFrame, ingest_id: int) -> tuple[DataFrame, DataFrame]:
    """(tables, table_rows) to write: all table rows of a section are one table, named by its prefix and title, with the columns of its
    first row that has any value. texts: doc_id, title, text. A table's id is a hash of document, name and ingest."""
    named = texts.select("doc_id", table_name(product_prefix(F.col("text")), F.col("title")).alias("table_name"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_no", "row_index")) - 1
    held = row_properties(rows).where(F.size("props") > 0).join(named, "doc_id").withColumn("row_index", at)
    tid = F.xxhash64("doc_id", "table_name", F.lit(ingest_id)).alias("table_id")
    tables = held.groupBy("doc_id", "table_name").agg(F.min_by(F.map_keys("props"), "row_index").alias("columns"), F.count("*").alias("n_rows"))
    tables = tables.select(tid, F.col("doc_id").alias("source_doc"), "table_name", "columns", "n_rows", F.lit(ingest_id).alias("ingest_id"))
    return tables, held.select(tid, "row_index", "props")


def newest_tables(tables: DataFrame) -> DataFrame:
    """table_name, table_id of the newest table of each name (ingest_id, then source_doc)."""
    last = F.max_by("table_id", F.struct("ingest_id", "source_doc")).alias("table_id")
    return tables.groupBy("table_name").agg(last)


def _asked(tables: DataFrame, rows: DataFrame, questions: DataFrame) -> DataFrame:
    return questions.join(newest_tables(tables), "table_name").join(rows, "table_id")


def _first(met: DataFrame, limit: int) -> DataFrame:
    return met.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy("row_index"))).where(F.col("__r") <= limit).drop("__r")


def filter_rows(tables: DataFrame, rows: DataFrame, questions: DataFrame, limit: int = 100, limit_first: bool = True) -> DataFrame:
    """questions (qid, table_name, filters: map of column to value) to (qid, row_index, props): rows of the newest table of the name whose
    columns equal the values in any case, a missing column being empty. The limit comes before the filters unless told otherwise."""
    met = _asked(tables, rows, questions)
    value = lambda k: F.lower(F.coalesce(F.try_element_at("props", k), F.lit("")))
    hit = F.forall(F.map_entries("filters"), lambda f: value(f["key"]) == F.lower(f["value"]))
    kept = _first(met, limit).where(hit) if limit_first else _first(met.where(hit), limit)
    return kept.select("qid", "row_index", "props")


def rows_like(tables: DataFrame, rows: DataFrame, questions: DataFrame, limit: int = 100) -> DataFrame:
    """questions (qid, table_name, term) to (qid, row_index, props): the first rows, by index, of the newest table of the name whose JSON
    text holds the term in any case; an empty term: any row."""
    met = _asked(tables, rows, questions).where(F.contains(F.lower(F.to_json("props")), F.lower(F.coalesce("term", F.lit("")))))
    return _first(met, limit).select("qid", "row_index", "props")
