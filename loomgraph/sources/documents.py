"""Documents: file scans, chunks, pages, sections."""

from __future__ import annotations

import email
import email.policy
import functools
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip

CHUNK = 2000
# Parts of a web page that are not shown, and titles of sections that hold no facts.
HIDDEN = ("script", "style", "nav", "footer", "header")
BOILERPLATE = ("legal", "disclaimer", "warranty", "liability", "contact", "address", "imprint", "copyright", "trademark", "index", "bibliography", "about the author", "table of contents")


def scan_files(spark: SparkSession, paths: str | list[str], extensions: list[str]) -> DataFrame:
    """Files by extension under paths, each a file, a glob or a folder: path, length, modificationTime, content. A file under several
    of the paths counts once. Contents are not read unless `content` is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    keep = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])
    return files.where(keep).dropDuplicates(["path"])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def markdown_chunks(text: Column) -> Column:
    """Chunks that begin at headings of level 1 and 2; paragraphs are packed where that gives no more than one."""
    parts = F.filter(F.transform(F.split(text, r"(?m)(?=^#{1,2}\s)"), strip), lambda c: c != "")
    return _once(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(paragraph_chunks(text)))


def split_long(text: Column, size: int = CHUNK) -> Column:
    """Sentences packed into chunks of fewer than `size` characters; a longer sentence is a chunk of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))  # n: characters of cur

    def step(acc, s):
        fits = acc["n"] + F.length(s) < size
        joined = F.when(acc["n"] > 0, F.concat_ws(" ", acc["cur"], s)).otherwise(s)
        done = F.when(fits | (acc["n"] == 0), acc["out"]).otherwise(F.concat(acc["out"], F.array(strip(acc["cur"]))))
        n = F.when(fits & (acc["n"] > 0), acc["n"] + 1).otherwise(0) + F.length(s)
        return F.struct(done.alias("out"), F.when(fits, joined).otherwise(s).alias("cur"), n.alias("n"))

    return F.aggregate(F.split(text, r"(?U)(?<=[.!?])\s+"), empty, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"]))


def paragraph_chunks(text: Column, size: int = CHUNK) -> Column:
    """Paragraphs packed into chunks of fewer than `size` characters (the separator is not counted); longer ones are split at sentences."""
    parts = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))  # n: characters of cur

    def step(acc, p):
        fits = acc["n"] + F.length(p) < size
        closed = F.when(acc["n"] == 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))
        long = F.length(p) > size
        out = F.when(fits, acc["out"]).when(long, F.concat(closed, split_long(p, size))).otherwise(closed)
        cur = F.when(fits, F.when(acc["n"] == 0, p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))).when(long, F.lit("")).otherwise(p)
        n = F.when(fits & (acc["n"] > 0), acc["n"] + 2 + F.length(p)).when(long & ~fits, F.lit(0)).otherwise(F.length(p))
        return F.struct(out.alias("out"), cur.alias("cur"), n.alias("n"))

    chunks = F.aggregate(parts, empty, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))
    return _once(chunks, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(strip(text))))


def chunk_rows(docs: DataFrame, chunks: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode(chunks).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_no"), "text")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def visible_text(html: str | None) -> str:
    """The text between tags, piece by piece with an empty line between, so that each is a paragraph; hidden parts are left out."""
    if not html:
        return ""
    page = _Visible()
    page.feed(html)
    page.close()
    return "\n\n".join(page.parts).strip()


def visible(html: Column) -> Column:
    """visible_text of a column."""

    @F.pandas_udf("string")
    def shown(pages: pd.Series) -> pd.Series:
        return pages.map(visible_text)

    return shown(html)


def html_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, html, ...) to (doc_id, text): what a reader sees."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["page_id"], "text": p["html"].map(visible_text)})

    return pages.select("page_id", "html").mapInPandas(run, "doc_id long, text string")


#: Headers are parsed once for each value: most mails share kinds, senders and character sets.
MAIL = email.policy.default.clone(header_factory=functools.lru_cache(1 << 14)(email.policy.default.header_factory))


def mail_text(raw: str | None) -> tuple[str, str]:
    """(header chunk, body); a plain body is preferred to an HTML one."""
    if not raw:
        return "", ""
    m = email.message_from_string(raw, policy=MAIL)
    head = "\n".join(f"{k}: {v}" for k in ("From", "To", "Subject", "Date") if (v := m[k]))
    body = m.get_body(preferencelist=("plain", "html"))
    text = ""
    if body is not None and str(body.get("Content-Transfer-Encoding", "8bit")).lower() in ("7bit", "8bit", "binary"):
        text = body.get_payload()  # a string already, whatever the character set was
    elif body is not None:
        try:
            text = body.get_content()
        except LookupError:  # a character set that nobody knows
            text = body.get_payload(decode=True).decode("utf-8", "replace")
    if body is not None and body.get_content_subtype() == "html":
        text = visible_text(text)
    return head, text.strip()


def mail_pages(mails: DataFrame) -> DataFrame:
    """mails (doc_id, raw) to (doc_id, head, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            both = p["raw"].map(mail_text)
            yield pd.DataFrame({"doc_id": p["doc_id"], "head": both.map(lambda x: x[0]), "text": both.map(lambda x: x[1])})

    return mails.select("doc_id", "raw").mapInPandas(run, "doc_id long, head string, text string")


def mail_parts(raw: Column) -> Column:
    """struct<head, text>: mail_text of a column."""

    @F.pandas_udf("head string, text string")
    def parts(mails: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mail_text(m) for m in mails], columns=["head", "text"])

    return parts(raw)


def mail_chunks(mails: DataFrame) -> DataFrame:
    """mails (doc_id, raw) to chunks (doc_id, page_no, text): the headers, if there are any, and the body's paragraphs, packed."""
    return _mail_chunks(mail_pages(mails))


def _mail_chunks(p: DataFrame) -> DataFrame:
    return chunk_rows(p, packed_mail(F.col("head"), F.col("text")))


def packed_mail(head: Column, body: Column) -> Column:
    none = F.array().cast("array<string>")
    every = F.concat(F.when(head != "", F.array(head)).otherwise(none), F.when(body != "", paragraph_chunks(body)).otherwise(none))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("")))


def line_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_no (from 1), text: a page for each line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_no"), "text")


def content_ids(pages: DataFrame) -> DataFrame:
    """doc_id, content_id: sha-256 of all pages in order."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["text"]), ""), 256).alias("content_id"))


def tagged_text(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, node_id, tagged) of sections (doc_id, node_id, start_page, end_page): their pages in tags, blank ones left out."""
    p = pages.where(strip(F.col("text")) != "").select(F.col("doc_id"), "page_no", "text")
    met = sections.withColumn("page_no", F.explode(F.sequence("start_page", "end_page"))).join(p, ["doc_id", "page_no"])
    tag = F.format_string("<page_%d>\n%s\n</page_%d>", F.col("page_no"), F.col("text"), F.col("page_no"))
    rows = F.array_sort(F.collect_list(F.struct("page_no", tag.alias("t"))))
    return met.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("tagged"))


# ---- sections ----


def section_ranges(entries: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Entries (doc_id, ord, title, start_page, structure) with end_page (the page before the next, else the last), node_id and depth."""
    w = Window.partitionBy("doc_id").orderBy("start_page", "ord")
    e = entries.join(page_counts, "doc_id")
    end = F.coalesce(F.lead("start_page").over(w) - 1, F.col("page_count"))
    return e.withColumn("end_page", end).withColumn("node_id", F.lpad(F.row_number().over(w).cast("string"), 4, "0")).withColumn("depth", F.length("structure") - F.length(F.replace("structure", F.lit("."), F.lit(""))))


def parents(sections: DataFrame) -> DataFrame:
    """sections with parent_id: the nearest section before it with a smaller depth, in page order.

    A fold over the document's sections in order: the stack of open ancestors is at most as deep as the tree.
    """
    rows = F.array_sort(F.collect_list(F.struct("node_id", "depth")))
    none = F.array().cast("array<struct<node_id:string,depth:int>>")
    start = F.struct(none.alias("open"), F.array().cast("array<struct<node_id:string,parent_id:string>>").alias("out"))

    def step(acc, r):
        kept = F.filter(acc["open"], lambda o: o["depth"] < r["depth"])
        parent = F.when(F.size(kept) > 0, F.get(kept, F.size(kept) - 1)["node_id"])
        link = F.struct(r["node_id"].alias("node_id"), parent.alias("parent_id"))
        return F.struct(F.concat(kept, F.array(r)).alias("open"), F.concat(acc["out"], F.array(link)).alias("out"))

    links = sections.groupBy("doc_id").agg(F.aggregate(rows, start, step, lambda a: a["out"]).alias("links")).select("doc_id", F.explode("links").alias("l")).select("doc_id", "l.node_id", "l.parent_id")
    return sections.join(links, ["doc_id", "node_id"])


def leaves(tree: DataFrame) -> DataFrame:
    up = tree.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    return tree.join(up, ["doc_id", "node_id"], "left_anti")


def tree_text(tree: DataFrame) -> DataFrame:
    """doc_id, tree: the titles in order, indented by depth."""
    rows = F.array_sort(F.collect_list(F.struct("node_id", F.concat(F.expr("repeat('  ', depth)"), F.lit("["), "node_id", F.lit("] "), "title").alias("line"))))
    return tree.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("tree"))


def boilerplate(title: Column, words=BOILERPLATE) -> Column:
    low = F.lower(title)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def toc_accuracy(entries: DataFrame, pages: DataFrame, tolerance: int = 2) -> DataFrame:
    """doc_id, accuracy: share of entries whose title's words are all on a page within the tolerance."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
    e = entries.select("doc_id", "ord", "start_page", words(F.col("title")).alias("tw"))
    p = pages.select("doc_id", "page_no", words(F.col("text")).alias("pw"))
    near = e.withColumn("page_no", F.explode(F.sequence(F.col("start_page") - tolerance, F.col("start_page") + tolerance)))
    met = near.join(p, ["doc_id", "page_no"]).where(F.size(F.array_except("tw", "pw")) == 0).select("doc_id", "ord").distinct().withColumn("ok", F.lit(1))
    return e.join(met, ["doc_id", "ord"], "left").groupBy("doc_id").agg(F.round(F.avg(F.coalesce("ok", F.lit(0))), 4).alias("accuracy"))


def page_chunks(sections: DataFrame, most: int = 10) -> DataFrame:
    """Large sections cut to runs of `most` pages: (doc_id, node_id with a two-digit number, start_page, end_page); others as they are."""
    big = sections.where(F.col("end_page") - F.col("start_page") + 1 > most)
    at = big.select("doc_id", "node_id", "end_page", F.posexplode(F.sequence("start_page", "end_page", F.lit(most))).alias("i", "start"))
    made = at.select("doc_id", F.concat("node_id", F.lpad((F.col("i") + 1).cast("string"), 2, "0")).alias("node_id"), F.col("start").alias("start_page"), F.least(F.col("start") + most - 1, "end_page").alias("end_page"))
    rest = sections.where(F.col("end_page") - F.col("start_page") + 1 <= most).select("doc_id", "node_id", "start_page", "end_page")
    return made.unionByName(rest)


def sub_ranges(proposals: DataFrame) -> DataFrame:
    """Proposed sub-sections (doc_id, node_id, parent_start, parent_end, ord, start_page) with their end, clamped to the parent; single proposals go."""
    w = Window.partitionBy("doc_id", "node_id").orderBy("start_page", "ord")
    n = Window.partitionBy("doc_id", "node_id")
    p = proposals.withColumn("n", F.count("*").over(n)).where("n >= 2")
    end = F.coalesce(F.lead("start_page").over(w) - 1, F.col("parent_end"))
    start = F.greatest("start_page", "parent_start")
    return p.select("doc_id", "node_id", "ord", start.alias("start_page"), F.least(F.greatest(end, start), "parent_end").alias("end_page"))


def even_sample(rows: DataFrame, most: int = 5, budget: int = 12_000) -> DataFrame:
    """Evenly spaced rows of each document (doc_id, ord, text), at most `most`, while their characters fit the budget."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    r = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    r = r.where(F.col("i") % F.greatest(F.floor(F.col("n") / most), F.lit(1)) == 0)
    r = r.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).withColumn("upto", F.sum(F.length("text")).over(w))
    return r.where(F.col("upto") <= budget).select("doc_id", "ord", "text")


def stratified_pages(pages: DataFrame, most: int, seed: int = 3) -> DataFrame:
    """The first two pages, the last, and seeded ones between, at most `most` of each document."""
    w = Window.partitionBy("doc_id")
    p = pages.withColumn("n", F.max("page_no").over(w))
    edge = F.when(F.col("page_no") <= 2, 0).when(F.col("page_no") == F.col("n"), 1).otherwise(2)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("page_no").cast("string")))
    order = Window.partitionBy("doc_id").orderBy("edge", F.when(F.col("edge") == 2, F.col("h")), "page_no")
    return p.withColumn("edge", edge).withColumn("h", h).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("doc_id", "page_no", "text")


def sample_pages(pages: DataFrame, most: int = 30, seed: int = 3) -> DataFrame:
    """The first two pages of each document, the last, and seeded ones between, three or an even share of `most`; of all of
    these the first `most`, by document and page."""
    w = Window.partitionBy("doc_id")
    docs = pages.select("doc_id").distinct().count()
    between = max(3, most // max(docs, 1))
    p = pages.withColumn("n", F.max("page_no").over(w)).withColumn("middle", (F.col("page_no") > 2) & (F.col("page_no") < F.col("n")))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("page_no").cast("string")))
    drawn = p.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "middle").orderBy(h, "page_no")))
    return drawn.where(~F.col("middle") | (F.col("r") <= between)).orderBy("doc_id", "page_no").limit(most).select("doc_id", "page_no", "text")
