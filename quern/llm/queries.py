"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, line_dedup, mixing, quality, simhash, suffix_dedup, token_store, toxicity, warc
from ._common import load


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_warc": warc.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_html_text": html_text.query,
    "op5_token_store": token_store.query,
    "op6_toxicity": toxicity.query,
    "op7_decontamination": decontam.query,
    "op8_mixing": mixing.query,
    "op9_quality": quality.query,
    "op10_simhash": simhash_query,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_warc": warc.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_quality": quality.ORACLE,
}
