"""Space-separated text relations, and the files that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each relation; numbers are text in the files.
RELATIONS = {
    "hits": [("word", "string"), ("url", "string")],
    "links": [("src", "string"), ("dst", "string")],
    "tfs": [("word", "string"), ("url", "string"), ("tf", "double")],
    "idfs": [("word", "string"), ("idf", "double")],
    "prs": [("url", "string"), ("rank", "double")],
}


def read_relation(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A relation's rows; path may be a file, a folder or a pattern (file.*)."""
    fields = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(*[F.get(fields, F.lit(i)).cast(kind).alias(c) for i, (c, kind) in enumerate(RELATIONS[name])])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value of each line."""
    return spark.read.text(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """url, under its normal form; lines that can't be parsed are dropped."""
    from ..functions.urls import normalize_url

    return spark.read.text(path).select(normalize_url(F.trim("value")).alias("url")).where("url is not null").distinct()


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """The words of a list, which is short by nature."""
    return [x.value for x in spark.read.text(path).where(F.trim("value") != "").collect()]


def write_relation(df: DataFrame, name: str, path: str, single: bool = False) -> None:
    """Lines with a space between fields.  single gives one file, for readers that can't take more."""
    lines = df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c, _ in RELATIONS[name]]).alias("value"))
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def write_pairs(df: DataFrame, path: str, single: bool = True) -> None:
    """A job's result: key, a space, value."""
    lines = df.select(F.concat_ws(" ", "key", "value").alias("value"))
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)
