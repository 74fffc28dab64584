"""Registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontam import DECONTAMINATION_SQL, decontamination_digest
from .html_extract import extract
from .langid import langid_digest
from .line_dedup import line_digest
from .ngram_jaccard import JACCARD_SQL, jaccard_digest
from .order_minhash import order_minhash_digest
from .packing import packing_digest
from .pii import pii_digest
from .secrets import secrets_digest
from .url_filter import URL_SQL, url_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    return pii_digest(_table(spark, sf_dir, "documents"))


def op2_secrets(spark, sf_dir):
    return secrets_digest(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard_digest(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark, sf_dir):
    return url_digest(_table(spark, sf_dir, "pages"))


def op6_language_id(spark, sf_dir):
    return langid_digest(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark, sf_dir):
    return extract(_table(spark, sf_dir, "pages"))


def op8_packing(spark, sf_dir):
    return packing_digest(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_digest(_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark, sf_dir):
    return order_minhash_digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_secrets, op3_ngram_jaccard, op4_decontamination, op5_url_filter, op6_language_id, op7_html_extraction, op8_packing, op9_line_dedup, op10_order_minhash)}
ORACLES = {"op3_ngram_jaccard": JACCARD_SQL, "op4_decontamination": DECONTAMINATION_SQL, "op5_url_filter": URL_SQL}
