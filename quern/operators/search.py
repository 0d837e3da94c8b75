"""Lexical search and checks of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.operators.sequences import with_words


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query; ties by doc_id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return bm25_scores(docs, queries, k1, b).withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of every document that holds a term of the query, however many there are.

    Only the queries' terms are counted: the words are filtered against them
    before anything is shuffled.  The query table is small by contract.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("query"), " "))).alias("term"))
    words = with_words(docs, "doc_id")
    sizes = words.select("doc_id", F.size("w").alias("dl"))
    totals = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = F.broadcast(terms.select("term").distinct())
    tf = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = joined.withColumn("s", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    return part.join(F.broadcast(terms), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def check_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """citations with verdict: none, unknown source, forged id, forged url, unsupported quote or valid."""
    s = sources.select(F.col("source_id").alias("_id"), F.col("url").alias("_url"), F.col("content").alias("_content"))
    u = sources.select(F.col("url").alias("_known")).distinct()
    j = citations.join(s, F.col("source_id") == F.col("_id"), "left").join(u, F.col("url") == F.col("_known"), "left")
    verdict = (
        F.when(F.col("source_id").isNull(), "none").when(F.col("_id").isNull() & F.col("_known").isNotNull(), "forged id").when(F.col("_id").isNull(), "unknown source")
        .when(F.col("url") != F.col("_url"), "forged url").when(~F.contains("_content", F.col("quote")), "unsupported quote").otherwise("valid")
    )
    return j.withColumn("verdict", verdict).drop("_id", "_url", "_content", "_known")
