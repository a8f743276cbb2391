"""Crawling a table of pages: filters, duplicates, robots rules, hits, links and the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import robots as R
from ..functions import text as X
from ..functions import urls as U
from ..functions.html import parsed
from ..tables import stored, workspace
from . import fetching, frontier

MEGABYTE = 1 << 20


def content_dedupe(pages: DataFrame, content: str = "html", key: str = "url") -> DataFrame:
    """Of pages with equal content that with the smallest key; no content is a content too."""
    digest = F.coalesce(F.md5(F.col(content).cast("binary")), F.lit(""))
    # The smallest key of each digest is found before contents move: many copies of a page don't meet in one task.
    first = pages.groupBy(digest.alias("digest")).agg(F.min(key).alias(key))
    return pages.withColumn("digest", digest).join(first, ["digest", key], "left_semi").drop("digest")


def size_filter(pages: DataFrame, max_mb: float = 1, content: str = "html") -> DataFrame:
    return pages.where(F.octet_length(content) <= F.lit(int(MEGABYTE * max_mb)))


def type_filter(log: DataFrame, column: str = "content_type") -> DataFrame:
    return log.where(F.startswith(F.col(column), F.lit("text/html")))


def status_filter(log: DataFrame) -> DataFrame:
    """Fetches that ended with 200, of a log with the codes of the first answer and of that after a redirect."""
    moved = F.col("status").isin(301, 302, 303)
    return log.where(F.coalesce(F.when(moved, F.col("status_after")), F.col("status")) == 200)


def url_dedupe(urls: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    new = urls.select("url").distinct()
    return new if visited is None else new.join(visited.select("url"), "url", "left_anti")


def normalized(pages: DataFrame) -> DataFrame:
    """Pages under their normal urls; those whose url can't be parsed are dropped."""
    return pages.withColumn("url", U.normalize_url("url")).where(F.col("url").isNotNull())


def robots_filter(pages: DataFrame, robots: DataFrame, agent: str = R.AGENT) -> DataFrame:
    """Pages that their hosts' policies allow; robots: host, text. A host without a row allows all."""
    rules = R.policies(robots, agent).withColumnRenamed("host", "rule_host")
    part = U.url_parts("url")
    joined = pages.withColumn("rule_host", part["host"]).join(rules, "rule_host", "left")
    good = F.coalesce("valid", F.lit(True)) & ~F.coalesce(R.disallowed(part["path"], F.col("disallow")), F.lit(False))
    return joined.where(good).select(*pages.columns)


def _texts(pages: DataFrame, html: str | None, text: str | None) -> DataFrame:
    return pages.select("url", F.col(text).alias("text")) if text else parsed(pages, html, links=False)


def hits(pages: DataFrame, html: str | None = "html", text: str | None = None, stop_words=X.STOP_WORDS) -> DataFrame:
    """word, url for each occurrence of an indexed word; text names a column that holds the pages' text already."""
    # The outer form, or the plan makes the words a second time to leave out pages without any.
    return _texts(pages, html, text).select(F.explode_outer(X.words("text", stop_words)).alias("word"), "url").where(F.col("word").isNotNull())


def links(pages: DataFrame, html: str | None = "html", found: str | None = None) -> DataFrame:
    """src, dst of each link, under normal urls, with repeats; links that can't be parsed are dropped.

    found names a column that holds the pages' absolute links already.
    """
    rows = pages.select("url", F.col(found).alias("links")) if found else parsed(pages, html, text=False)
    ends = rows.select(F.col("url").alias("src"), F.explode_outer("links").alias("dst")).where(F.col("dst").isNotNull())
    return ends.select("src", U.normalize_url("dst").alias("dst")).where(F.col("dst").isNotNull())


def word_pages(pages: DataFrame, html: str | None = "html", text: str | None = None, stop_words=X.STOP_WORDS) -> DataFrame:
    """word, url once for each word of each row of pages: where a url has one row, the hits without repeats."""
    return _texts(pages, html, text).select(F.explode_outer(F.array_distinct(X.words("text", stop_words))).alias("word"), "url").where(F.col("word").isNotNull())


def next_fetch(log: DataFrame, robots: DataFrame, agent: str = R.AGENT) -> DataFrame:
    """host, next_seconds: when each host of log (host, seconds) may be fetched again by its policy's crawl delay."""
    last = log.groupBy("host").agg(F.max("seconds").alias("last"))
    rules = R.policies(robots, agent).select("host", "delay")
    return last.join(rules, "host", "left").select("host", (F.col("last") + F.coalesce("delay", F.lit(0))).alias("next_seconds"))


def counted(rows: DataFrame, name: str):
    """(rows, observation): the number of rows that pass, known as count when an action on them has ended."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("count")), seen


def frontier_hosts(urls: DataFrame, shards: int = 100) -> DataFrame:
    """host, urls: the frontier by host."""
    return urls.groupBy(U.url_host("url").alias("host")).agg(F.count("*").alias("urls"))


def crawl(pages: DataFrame, seeds: DataFrame, robots: DataFrame | None = None, max_mb: float = 1, rounds: int | None = None, log: DataFrame | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages reached, urls seen with the round in which they were) from seeds (url) over a table of pages (url, html).

    Each round takes the frontier's pages that pass the filters, and their links' targets not seen before are the next
    frontier; it ends with an empty frontier, or after the given rounds if any are given. With a log of fetches
    (``fetching``) a url's page is the one that its answer, or that after a redirect, gave, if its length and type are
    accepted. With a path the crawl is kept there, and one that has begun goes on.
    """
    spark = pages.sparkSession
    home = workspace(spark, "crawl")
    path = path or f"{home}/frontier"
    if frontier.state(spark, path) is None:
        store = size_filter(normalized(pages).select("url", "html"), max_mb)
        if robots is not None:
            store = robots_filter(store, robots)
        asked = F.col("url") if log is None else F.col("asked")
        if log is not None:
            store = store.join(fetching.accepted(log, max_mb), "url")
        store = stored(store.select("url", "html", asked.alias("asked")), f"{path}/pages")
        # A page's links are read once, under the url that is asked for.
        ends = parsed(store.select("url", "html"), text=False)
        if log is not None:
            ends = store.select("url", "asked").distinct().join(ends, "url").select(F.col("asked").alias("url"), "links").distinct()
        frontier.begin(ends.where(F.col("links").isNotNull()), seeds, path)
    frontier.go_on(spark, path, rounds)
    seen = frontier.seen(spark, path)
    # With rounds given the last round's urls are seen, but their pages aren't reached yet.
    last = frontier.state(spark, path)
    done = seen.where(F.col("round") < last.round) if last.new else seen
    store = spark.read.schema("url string, html string, asked string").parquet(f"{path}/pages")
    asked = done.select(F.col("url").alias("asked"))
    if log is not None:  # a page that several redirects lead to is reached once
        asked = store.select("url", "asked").join(asked, "asked", "left_semi").groupBy("url").agg(F.min("asked").alias("asked")).select("asked", "url")
        return content_dedupe(store.join(asked, ["asked", "url"], "left_semi").select("url", "html")), seen
    return content_dedupe(store.join(asked, "asked", "left_semi").select("url", "html")), seen


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("nth = 1").drop("nth")


def crawl_stats(reached: DataFrame, seen: DataFrame) -> DataFrame:
    """documents, urls, hosts in one row."""
    return reached.agg(F.count("*").alias("documents")).join(F.broadcast(seen.agg(F.count("*").alias("urls"), F.countDistinct(U.url_host("url")).alias("hosts"))))
