"""The registered queries opN_<name> and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import backoff, byte_bpe, divergence, jpeg, licences, mtree, near_dedup, ordinal, packing, repair, secrets, simhash, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.classify(docs, ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels"))))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), n=4, percent=80)


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op9_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_licence_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(licences.document_files(table(spark, sf_dir, "documents")), ["doc_id"], windows=True)


def op11_cost_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_stupid_backoff": backoff.oracle(),
        "op4_secret_ledger": secrets.oracle(),
        "op9_mtree_top_k": mtree.oracle(),
        "op10_licence_cosine": licences.oracle(),
        "op11_cost_layers": repair.oracle(),
        "op13_source_divergence": divergence.oracle(),
    }
