"""The link graph and its ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import CLEAN, setting, stored, workspace


def distinct_edges(links: DataFrame) -> DataFrame:
    return links.select("src", "dst").distinct()


def edges_of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """src, dst of space-separated lines: repeats are dropped as lines, then the first two fields are taken."""
    f = F.split(F.col(column), " ")
    return lines.select(column).distinct().select(F.get(f, F.lit(0)).alias("src"), F.get(f, F.lit(1)).alias("dst"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("url")).distinct()


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("url")).distinct()


def targets(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("url")).distinct()


def sinks(edges: DataFrame) -> DataFrame:
    """Vertices without outgoing edges."""
    return vertices(edges).join(sources(edges), "url", "left_anti")


def graph_counts(edges: DataFrame) -> DataFrame:
    """urls, froms, tos, sinks in one row, from one pass over the edges' ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("url"), F.lit(0).alias("out")))).alias("e"))
    roles = ends.groupBy("e.url").agg(F.max("e.out").alias("is_from"), F.min("e.out").alias("not_to"))
    return roles.agg(F.count("*").alias("urls"), F.coalesce(F.sum("is_from"), F.lit(0)).alias("froms"), F.coalesce(F.sum(1 - F.col("not_to")), F.lit(0)).alias("tos"), F.coalesce(F.sum(1 - F.col("is_from")), F.lit(0)).alias("sinks"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """url, neighbours (sorted array)."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.groupBy(F.col(a).alias("url")).agg(F.array_sort(F.collect_list(b)).alias("neighbours"))


def _bucketed(edges: DataFrame, nodes: DataFrame, home: str, parts: int) -> tuple[str, DataFrame]:
    """(table of edges with salt, in buckets of their source and salt; nodes with splits) of edges (src, dst) and nodes (url, degree).

    A source with more than a quarter of a bucket is split: its edges have one of so many salts, by target. There are at
    most four times as many such sources as buckets, which is what is broadcast.
    """
    spark = edges.sparkSession
    total = nodes.agg(F.sum("degree")).first()[0] or 0
    most = max(1, total // (4 * parts))
    splits = F.ceil(F.coalesce("degree", F.lit(1)) / F.lit(most)).cast("int")
    nodes = nodes.withColumn("splits", splits)
    hot = nodes.where("splits > 1").select(F.col("url").alias("src"), "splits")
    salt = F.pmod(F.xxhash64("dst"), F.coalesce("splits", F.lit(1))).cast("int").alias("salt")
    rows = edges.join(F.broadcast(hot), "src", "left").select("src", salt, "dst")
    name = f"quillweave_edges_{uuid.uuid4().hex}"
    with setting(spark, CLEAN, "true"):
        rows.repartition(parts, "src", "salt").write.option("path", f"{home}/bucketed").format("parquet").bucketBy(parts, "src", "salt").sortBy("src", "salt").saveAsTable(name)
    return name, nodes


def _passed(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """url, into: what each target gets from its sources' ranks."""
    salts = F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt")
    given = ranks.where("degree is not null").select(F.col("url").alias("src"), (F.col("rank") / F.col("degree")).alias("share"), salts)
    return edges.join(given, ["src", "salt"]).groupBy(F.col("dst").alias("url")).agg(F.sum("share").alias("into"))


def page_rank(links: DataFrame, damping: float = 0.8, iterations: int = 5) -> DataFrame:
    """url, rank after the given iterations from 1 / n; links count once.

    rank' = (1 - d) + d * (rank of sinks) / n + d * (sum of rank / out-degree of what links here): not normalised, the
    sum of all ranks isn't 1. Without sinks their rank is 0.

    Edges lie in buckets of their source, so that an iteration moves sources' shares to them and what targets get, summed in
    each task, but not the edges; sources of many edges are split. Each iteration's ranks are a written table: they are used twice.
    """
    spark = links.sparkSession
    home = workspace(spark, "rank")
    edges = stored(distinct_edges(links), f"{home}/edges")
    nodes = stored(vertices(edges).join(out_degree(edges), "url", "left"), f"{home}/nodes")
    n = nodes.count()
    name, nodes = _bucketed(edges, nodes, home, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        edges = spark.table(name)
        ranks = nodes.select("url", "degree", "splits", F.lit(1.0 / n if n else 0.0).alias("rank"))
        for i in range(iterations):
            into = _passed(edges, ranks)
            lost = ranks.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
            new = F.lit(1 - damping) + damping * F.col("lost") / F.lit(n) + damping * F.coalesce("into", F.lit(0.0))
            ranks = ranks.select("url", "degree", "splits").join(into, "url", "left").join(F.broadcast(lost)).select("url", "degree", "splits", new.alias("rank"))
            ranks = stored(ranks, f"{home}/ranks-{i}")
        return ranks.select("url", "rank")
    finally:
        spark.sql(f"DROP TABLE {name}")  # its files stay with the other tables of the query
