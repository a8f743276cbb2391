"""What a log of fetches says: redirects followed, answers accepted, and when urls may be fetched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import robots as R
from ..functions import urls as U
from ..tables import ship, stored, workspace

MEGABYTE = 1 << 20
MOVED = (301, 302, 303)
_ANSWER = ["status", "content_type", "content_length"]


def answers(log: DataFrame) -> DataFrame:
    """The last answer of each url of a log (url, seconds, status, location, content_type, content_length), under normal urls."""
    rows = log.select(U.normalize_url("url").alias("url"), "seconds", F.struct(*_ANSWER, "location").alias("said")).where(F.col("url").isNotNull())
    # Of several at the same time that of the largest status, then type and so on.
    return rows.groupBy("url").agg(F.max(F.struct("seconds", "said")).alias("x")).select("url", *[F.col("x.said")[c].alias(c) for c in [*_ANSWER, "location"]])


def redirected(url: str = "url", location: str = "location"):
    """Where an answer's location leads, under its normal url: another path of the same host, or a url; else null."""
    rooted = F.concat(F.regexp_extract(url, "^(https?://[^/]*)", 1), F.col(location))
    return U.normalize_url(F.when(F.startswith(F.col(location), F.lit("/")), rooted).otherwise(F.col(location)))


def followed(log: DataFrame) -> DataFrame:
    """asked, url, status, content_type, content_length of each url of a log that ends with 200, at once or after one redirect.

    url is the one that answered 200, and the page goes on under it. A redirect whose location is missing, can't be
    parsed, wasn't fetched, or doesn't answer 200 itself is no success: a second redirect isn't followed.
    """
    known = answers(log)
    good = known.where("status = 200")
    direct = good.select(F.col("url").alias("asked"), "url", *_ANSWER)
    moved = known.where(F.col("status").isin(*MOVED)).select(F.col("url").alias("asked"), redirected().alias("url")).where(F.col("url").isNotNull())
    return direct.unionByName(moved.join(good.select("url", *_ANSWER), "url").select("asked", "url", *_ANSWER))


def accepted(log: DataFrame, max_mb: float = 1) -> DataFrame:
    """asked, url of successes that say a length of at most max_mb and a type of HTML; an answer that lacks either is rejected."""
    good = (F.col("content_length") <= F.lit(int(MEGABYTE * max_mb))) & F.startswith("content_type", F.lit("text/html"))
    return followed(log).where(good).select("asked", "url")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of host, and each row's part and rank in its host there."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("host").dictionary_encode()
        at = code.indices.to_numpy()
        first = np.r_[True, at[1:] != at[:-1]]
        begun = np.flatnonzero(first)
        rank = np.arange(len(at)) - np.repeat(begun, np.diff([*begun, len(at)])) + 1
        if code.dictionary[int(at[0])].as_py() == last:
            rank[: begun[1] if len(begun) > 1 else len(at)] += n
        last, n = code.dictionary[int(at[-1])].as_py(), int(rank[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(rank)], [*batch.schema.names, "part", "nth"])


def schedule(urls: DataFrame, robots: DataFrame, log: DataFrame | None = None, start: int = 0, agent: str = R.AGENT) -> DataFrame:
    """host, url, rank, seconds: when each row of urls (url, position) may be fetched, a host's crawl delay apart.

    A host's urls queue in order of position and url; the one of rank r is due r delays after the host's last fetch by
    log (host, seconds), or after start. Hosts without a row in robots (host, text) have no delay; urls of a host whose robots
    text can't be parsed, and those that aren't urls, are left out. Repeated rows queue each.

    Urls are sorted over all partitions; a row's rank is that in its part and what its host has in the parts before, so
    that no host's queue has to be in one task. What is joined are hosts' rows of a part.
    """
    spark = urls.sparkSession
    ship(spark)
    home = workspace(spark, "schedule")
    rows = urls.select(U.url_host("url").alias("host"), "url", F.col("position").cast("long").alias("position")).where(F.col("host").isNotNull())
    order = ["host", "position", "url"]
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ranked, "host string, url string, position long, part int, nth long")
    ranked = stored(ranked, f"{home}/ranked")
    held = ranked.groupBy("host", "part").agg(F.max("nth").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rules = R.policies(robots, agent).groupBy("host").agg(F.max("delay").alias("delay"), F.min("valid").alias("valid"))
    held = held.select("host", "part", before.alias("before")).join(rules, "host", "left").where(F.coalesce("valid", F.lit(True)))
    last = F.lit(start).cast("long")
    if log is not None:
        held = held.join(log.groupBy("host").agg(F.max("seconds").cast("long").alias("last")), "host", "left")
        last = F.coalesce("last", last)
    held = held.select("host", "part", "before", F.coalesce("delay", F.lit(0)).alias("delay"), last.alias("last"))
    rank = F.col("nth") + F.col("before")
    return ranked.join(held, ["host", "part"]).select("host", "url", rank.alias("rank"), (F.col("last") + rank * F.col("delay")).alias("seconds"))
