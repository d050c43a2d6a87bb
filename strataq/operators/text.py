"""Text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Store

WINDOW, STRIDE = 1_100, 900


def chunks(docs: DataFrame, key: str, text: str, head: int | None = None) -> DataFrame:
    """Windows of every text: key, offset, chunk; of whole texts, or of their first ``head`` characters."""
    if head is not None:
        docs = docs.withColumn(text, F.substring(text, 1, head))
    last = F.length(text) - 1
    rows = docs.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), last, F.lit(STRIDE))).alias("offset"))
    return rows.select(key, "offset", F.substring(text, F.col("offset") + 1, F.lit(WINDOW)).alias("chunk"))


def tfidf_search(chunked: DataFrame, query: str, key: str, limit: int = 10) -> DataFrame:
    """Cosine of sublinear tf-idf vectors with the query, which counts as one more text.

    Words are counted once and written; norms need every word of a chunk, products only
    the query's words, which are few and joined to the norms' result.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"))
    spark = chunked.sparkSession
    q = spark.range(1).select(F.explode(words(F.lit(query))).alias("w")).groupBy("w").agg(F.count("*").alias("qc"))
    tf = chunked.select(key, "offset", F.explode(words("chunk")).alias("w")).groupBy(key, "offset", "w").agg((1 + F.log(F.count("*"))).alias("tf"))
    tf = Store(spark, "tfidf").put(tf)
    n = chunked.agg((F.count("*") + 1).alias("n"))  # one row
    df = tf.groupBy("w").agg(F.count("*").alias("df")).join(q, "w", "full").crossJoin(n)
    df = df.select("w", (1 + F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)) + F.when(F.col("qc").isNotNull(), 1).otherwise(0)))).alias("idf"), (1 + F.log("qc")).alias("qtf"))
    score = tf.join(df, "w").groupBy(key, "offset").agg(F.sum(F.col("tf") * F.col("idf") * F.col("qtf") * F.col("idf")).alias("dot"), F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    qn = df.agg(F.sqrt(F.sum((F.col("qtf") * F.col("idf")) ** 2)).alias("qn"))  # one row
    return score.where("dot > 0").crossJoin(qn).select(key, "offset", F.round(F.col("dot") / (F.col("norm") * F.col("qn")), 6).alias("score")).orderBy(F.desc("score"), key, "offset").limit(limit)
