"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat_format, collocations, divergence, fingerprints, golay, language_id, mixing, nearest, ngram_join, pieces, secrets, token_files, url_filters
from loomgraph.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, url_filters.recaptured(pages)).drop("url")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_offsets(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return nearest.nearest(rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_report(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.conversation_preferences(table(spark, sf_dir, "conversations"))


def op11_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.report(table(spark, sf_dir, "documents"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


ALL = (op1_ngram_join, op2_url_filters, op3_token_files, op4_mixing, op5_nearest, op6_simhash, op7_pieces, op8_language_id, op9_secrets, op10_chat_format)
ALL += (op11_golay_dedup, op12_divergence_audit, op13_collocations)
QUERIES = {f.__name__: f for f in ALL}
ORACLES = {"op2_url_filters": url_filters.ORACLE, "op4_mixing": mixing.ORACLE, "op10_chat_format": chat_format.ORACLE, "op12_divergence_audit": divergence.ORACLE, "op13_collocations": collocations.ORACLE}
