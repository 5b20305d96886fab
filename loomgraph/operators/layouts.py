"""Page layouts: the runs of tags of a page, equal layouts as one, and pairs of layouts that are alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN, ALIKE = 3, 0.8


def tag_runs(html: Column, size: int = RUN) -> Column:
    """The distinct runs of `size` tags in a page, sorted; all its tags where they are fewer; none without tags."""
    tags = F.regexp_extract_all(html, F.lit(r"<(/?[a-z0-9]+)"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tags) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(tags, i, size), " "))
    return F.array_sort(F.array_distinct(F.filter(runs, lambda r: r != "")))


def layouts(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) to (first_page, n, runs): one row for each set of runs, pages without tags left out."""
    p = pages.select("page_id", tag_runs(F.col("html")).alias("runs")).where(F.size("runs") > 0)
    return p.groupBy("runs").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


def alike(found: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """(a, b, jaccard), a < b by first_page, of layouts whose sets of runs have at least that Jaccard similarity.

    Exact, by prefixes: with the runs in order of rarity, two such sets share one of the first |s| - ceil(t |s|) + 1 of each. So layouts
    meet on their rarest runs, and common ones, which all pages have, are no block. Pairs are ids until they are checked.
    """
    runs = found.select("first_page", F.size("runs").alias("len"), F.explode("runs").alias("run"))
    held = runs.groupBy("run").agg(F.count("*").alias("held"))
    order = Window.partitionBy("first_page").orderBy("held", "run")
    r = runs.join(held, "run").withColumn("k", F.row_number().over(order))
    head = r.where(F.col("k") <= F.col("len") - F.ceil(F.col("len") * threshold - 1e-9) + 1).select("first_page", "len", "run")
    b = head.select(F.col("first_page").alias("b"), F.col("len").alias("lb"), "run")
    near = (F.least("len", "lb") >= F.greatest("len", "lb") * threshold - 1e-9) & (F.col("first_page") < F.col("b"))
    pairs = head.join(b, "run").where(near).select(F.col("first_page").alias("a"), "b").distinct()
    sets = lambda side: found.select(F.col("first_page").alias(side), F.col("runs").alias(f"runs_{side}"))
    met = pairs.join(sets("a"), "a").join(sets("b"), "b").withColumn("both", F.size(F.array_intersect("runs_a", "runs_b")))
    share = F.col("both") / (F.size("runs_a") + F.size("runs_b") - F.col("both"))
    return met.select("a", "b", share.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)
