"""Functions for SQL text, and pluggable record producers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.functions.bloom import bloom, possible
from loomgraph.operators.resolve import similarity_ratio

MENTION = "section_id string, text string, label string, at int, confidence double"


@F.pandas_udf(StringType())
def canonical_text(names: pd.Series) -> pd.Series:
    """functions.text.canonical_name for SQL text, where columns cannot be composed."""

    def one(t: str) -> str:
        bare = unicodedata.normalize("NFKD", re.sub("[®™©]", "", t))
        return " ".join("".join(c for c in bare if not unicodedata.combining(c)).split()).lower()

    return names.map(one, na_action="ignore")


def register(spark: SparkSession) -> None:
    """similarity_ratio(a, b) and canonical_name(text) in SQL."""
    spark.udf.register("canonical_name", canonical_text)
    spark.udf.register("similarity_ratio", similarity_ratio)


def produce(sections: DataFrame, producer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Mentions by any function from batches of (section_id, text) to batches of MENTION: a model, rules, a word list."""
    return sections.select("section_id", "text").mapInPandas(producer, MENTION)


def gazetteer_mentions(sections: DataFrame, names: DataFrame, words: int = 3) -> DataFrame:
    """Mentions of the names (name, label) of up to `words` words in sections: word runs meet the names in an equi-join, so no text is tried
    against every name. Runs are made only of words that may begin a name, and shuffled only where they may be one, by a Bloom filter."""
    k = names.where("name is not null").select(F.lower("name").alias("run"), "label").distinct()
    begins = lambda word: F.concat(word, F.lit(" "))
    held = bloom(k.select(F.explode(F.array("run", begins(F.substring_index("run", " ", 1))))))
    tokens = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}#]+"), lambda w: w != "")
    # a row for each word with those after it: null past the end
    after = [F.slice("w", n + 1, F.greatest(F.size("w"), F.lit(0))).alias(f"w{n}") for n in range(words)]
    t = sections.select("section_id", tokens.alias("w")).select("section_id", *after)
    r = t.select("section_id", F.posexplode(F.arrays_zip(*(f"w{n}" for n in range(words)))).alias("at", "z")).select("section_id", (F.col("at") + 1).alias("at"), "z.*")
    runs = F.array(*(F.when(F.col(f"w{n}").isNotNull(), F.concat_ws(" ", *(f"w{i}" for i in range(n + 1)))) for n in range(words)))
    r = possible(r.withColumn("begins", begins(F.col("w0"))), "begins", held).select("section_id", "at", F.explode(runs).alias("run"))
    r = possible(r, "run", held)
    return r.join(k, "run").select("section_id", F.col("run").alias("text"), "label", "at", F.lit(1.0).alias("confidence"))
