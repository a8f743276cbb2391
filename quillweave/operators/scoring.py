"""Term frequency, document frequency and inverse document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the inverse document frequency assumes where none are given.
CORPUS = 5000


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """key, count of every distinct line."""
    return lines.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("count"))


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("word", "url").agg(F.count("*").alias("n"))


def term_frequency(hits: DataFrame) -> DataFrame:
    """word, url, tf: ln(1 + how often the word occurs at the url)."""
    return hit_counts(hits).select("word", "url", F.log(F.lit(1) + F.col("n")).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """word, df: at how many urls the word occurs."""
    return tf.groupBy("word").agg(F.count("*").alias("df"))


def inverse_document_frequency(df: DataFrame, n: int | float | None = CORPUS, variant: str = "smooth_inside") -> DataFrame:
    """word, idf.  smooth_inside: ln(n / (1 + df) + 1); plus_one: ln(n / (1 + df)) + 1."""
    ratio = F.lit(float(n)) / (1 + F.col("df"))
    forms = {"smooth_inside": F.log(ratio + 1), "plus_one": F.log(ratio) + 1}
    return df.select("word", forms[variant].alias("idf"))


def tfidf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    return tf.join(idf, "word").select("word", "url", (F.col("tf") * F.col("idf")).alias("tfidf"))
