"""The corpus pipeline: language ID, near copies, secrets, mixture, pieces.

STAGES are (name, function of spark, docs, sf_dir). Each stage's result is written as Parquet to the shared folder and read
again as the next one's docs; all but the last return the columns of documents, whatever these are. What a stage read and wrote
on its way is deleted once its own result is written.

In every stage an empty table gives an empty table, rows that are repeated are rows of their own (but for near copies, of which one
stays), and further columns stay as they are (the last stage returns doc_id and ids alone).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import language_id, mixing, ngram_join, pieces, secrets
from loomgraph.llm.common import cleared, remove, shared_dir
from loomgraph.llm.queries import vocabulary

#: Rows of a batch to Python: texts are long, and what a batch takes is taken in the JVM and in Python, on every core.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Each stage sets the session's batch size for what it returns, which runs when it is written; run() puts the former one back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them) and those of 200 letters and more that fit no learned language go.
    A null lang or doc_id is no reason to go; where no row has a lang, all documents with letters stay. Ties: the first language."""
    small_batches(spark)
    return language_id.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 and more stays, the one with the least doc_id; null ids are last, and
    ties go to the least hash of the text. Texts without words are nobody's copies: all stay."""
    small_batches(spark)
    return ngram_join.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, overlapping ones by one, and n_chars is made to fit. Null texts stay null; no row goes."""
    small_batches(spark)
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated and left out so that sources, null being one, come near their targets. Rows alike in doc_id and text are taken
    alike; a text without words has size 0."""
    small_batches(spark)
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids, with merge-dropout; a null text has the ids of an empty one. Repeated rows have equal ids."""
    small_batches(spark)
    return pieces.encode_documents(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("language_id", language), ("ngram_join", near_copies), ("secret_scan", secret_scan), ("mixing", mixture), ("pieces", encoded)]
#: Merge-dropout and Markov models are not SQL; the rows are held against a plain version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for k, (name, stage) in enumerate(STAGES):
            with cleared(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    finally:
        spark.conf.set(key, before)
    return docs
