"""The stored index: words' urls with their frequencies, words' weights, urls' ranks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Index(NamedTuple):
    tf: DataFrame  # word, url, tf: the inverted index, a row for each hit
    idf: DataFrame  # word, idf
    rank: DataFrame  # url, rank


KEYS = {"tf": ["word", "url"], "idf": ["word"], "rank": ["url"]}


def check_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises ValueError where rows share a key, as the stored entities may not."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row of {', '.join(keys)}: {twice[0]}")


def save(index: Index, path: str, check: bool = True) -> None:
    """Overwrites the index at path.  tf lies in order of word, so that a word's lookup reads few row groups."""
    for name in Index._fields:
        df = getattr(index, name)
        if check:
            check_unique(df, KEYS[name])
        df.repartitionByRange(*KEYS[name]).sortWithinPartitions(*KEYS[name]).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in Index._fields))


def hits_of(index: Index, word: str) -> DataFrame:
    return index.tf.where(F.col("word") == word).select("word", "url")


def words(index: Index) -> DataFrame:
    return index.tf.select("word")


def lookup_tf(index: Index, word: str, url: str) -> DataFrame:
    return index.tf.where((F.col("word") == word) & (F.col("url") == url))


def lookup_idf(index: Index, word: str) -> DataFrame:
    return index.idf.where(F.col("word") == word)


def lookup_rank(index: Index, url: str) -> DataFrame:
    return index.rank.where(F.col("url") == url)


def dump(index: Index) -> DataFrame:
    """word, url in the order of the index."""
    return index.tf.select("word", "url").orderBy("word", "url")


def stats(index: Index) -> DataFrame:
    """name, rows of each table."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in (("hits", index.tf), ("tfs", index.tf), ("idfs", index.idf), ("prs", index.rank))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
