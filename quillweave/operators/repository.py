"""Stored documents, users and channels (an extension: the crawl itself keeps none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import channel_name_valid, sha256_upper
from ..functions.urls import normalize_url
from ..tables import CLEAN, setting

#: What identifies a row of each stored table; a later put replaces an earlier one.
KEYS = {"documents": ["url"], "users": ["username"], "channels": ["channel"], "matches": ["url", "channel"]}


def lookup_page(documents: DataFrame, url: str) -> DataFrame:
    """The document of a plain url."""
    return documents.where(F.col("url") == normalize_url(F.lit(url)))


def credentials(users: DataFrame, given: DataFrame) -> DataFrame:
    """username, ok for each row of given (username, password): users holds the passwords' digests."""
    held = users.select("username", F.col("password").alias("held"))
    return given.join(held, "username", "left").select("username", F.coalesce(F.col("held") == sha256_upper("password"), F.lit(False)).alias("ok"))


def channels_valid(channels: DataFrame) -> DataFrame:
    return channels.where(channel_name_valid("channel"))


def new_matches(matches: DataFrame, known: DataFrame) -> DataFrame:
    """Matches (url, channel) that aren't stored yet, once each: what an insert that can be repeated appends."""
    return matches.select("url", "channel").distinct().join(known.select("url", "channel"), ["url", "channel"], "left_anti")


def channel_documents(matches: DataFrame, documents: DataFrame, channel: str) -> DataFrame:
    return matches.where(F.col("channel") == channel).select("url").join(documents, "url")


def put(rows: DataFrame, path: str, kind: str) -> None:
    """Appends rows to a stored table; of rows that share a key the last put counts."""
    with setting(rows.sparkSession, CLEAN, "true"):
        rows.withColumn("put_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/{kind}")


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a stored table, for each key those of its last put; of several in one put any."""
    rows = spark.read.parquet(f"{path}/{kind}")
    keys = KEYS[kind]
    others = [c for c in rows.columns if c not in keys and c != "put_at"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "put_at").alias("x")) if others else rows.select(*keys).distinct()
    return last.select(*keys, *[F.col("x")[c].alias(c) for c in others])


def put_matches(matches: DataFrame, path: str) -> None:
    """Appends the matches that aren't stored yet: a put that can be repeated."""
    put(new_matches(matches, load(matches.sparkSession, path, "matches")), path, "matches")


def user(users: DataFrame, name: str) -> DataFrame:
    return users.where(F.col("username") == name)


def channel(channels: DataFrame, name: str) -> DataFrame:
    return channels.where(F.col("channel") == name)


def matched_channels(channels: DataFrame, matches: DataFrame) -> DataFrame:
    """The channels that match a document."""
    return channels.join(matches.select("channel"), "channel", "left_semi")


def dump(documents: DataFrame) -> DataFrame:
    """url, bytes of the stored documents in order of url."""
    return documents.select("url", F.octet_length("html").alias("bytes")).orderBy("url")
