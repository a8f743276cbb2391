"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target over the source's size.
Documents are laid on a line in order of size, one random offset is added, and a document is emitted once for each
whole number that its stretch of the line crosses: each gets floor or ceil of the expectation, and neighbours in size
balance each other, so that the words taken stay within about one document of the target.

Ranks come from a range partitioning by (source, size, doc_id) and a sum over the partitions before, never from a
window over a source: a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, scratch, table


def offset(seed: str, source: str | None) -> float:
    """The random offset of the source, in [0, 1): 32 bits of the MD5 of seed and name."""
    return int(hashlib.md5(f"{seed}{':' if source is None else '/' + source}".encode()).hexdigest()[:8], 16) / 4294967296.0


def targets(sizes: list[tuple[str | None, int]], weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> list[tuple[str | None, float]]:
    """Shares share * all sizes by weight; no target is above cap * its source's size, the excess goes to the others.

    Sources count by code point, null last, and take the weights in turn.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(name, size, weights[i % len(weights)]) for i, (name, size) in enumerate(order)]
    total, capped, weight = share * sum(x[1] for x in rows), 0, sum(x[2] for x in rows)
    out = {}
    for name, size, w in sorted(rows, key=lambda x: (cap * x[1] / x[2], x[0] is None, x[0] or "")):
        # Those of the lowest caps for their weight fill first; from the first that doesn't, nobody does.
        if cap * size / w <= (total - capped) / weight:
            out[name] = float(cap * size)
            capped, weight = capped + cap * size, weight - w
        else:
            break
    return [(name, out[name] if name in out else (total - capped) / weight * w) for name, _, w in rows]


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    A null or empty text has size 0 and takes its place on the line like others, a very long one is counted whole; null
    is a source of its own, last in order; an empty table gives an empty result. Repeated rows are separate documents,
    those of equal doc_id and size interchangeable. Columns of docs in keep are returned too, others of whatever name
    are ignored. The driver gets one row per source.
    """
    spark = docs.sparkSession
    home = scratch(spark, "mix")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sized = docs.select("doc_id", "source", *keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = table(sized, f"{home}/sized")
    by = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc()]
    line = sized.repartitionByRange(*by).sortWithinPartitions(*by).select("*", key.alias("key"), F.monotonically_increasing_id().alias("at"))
    line = table(line, f"{home}/line").withColumn("part", F.shiftright("at", 33))
    parts = line.groupBy("key", "part").agg(F.first("source").alias("source"), F.min("at").alias("lo"), F.count("*").alias("n"), F.sum("size").alias("words"))
    parts = table(parts, f"{home}/parts")
    sums = [(x.key, x.source, x.words) for x in parts.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("words")).collect()]
    target = {("n" if name is None else "s" + name): t for name, t in targets([x[1:] for x in sums], weights, share, cap)}
    plan = spark.createDataFrame([(k, size, target[k], target[k] / size if size else 0.0, offset(seed, name)) for k, name, size in sums], "key string, source_size long, target double, rate double, u double")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = parts.select("key", "part", (before - F.col("lo")).alias("shift"))
    out = line.join(start, ["key", "part"]).withColumn("rank", F.col("at") + F.col("shift")).join(plan, "key")
    copies = F.floor(F.col("u") + F.col("rate") * (F.col("rank") + 1)) - F.floor(F.col("u") + F.col("rate") * F.col("rank"))
    out = out.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sized GROUP BY source
), filling AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS total,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight
  FROM sources
), full_ones AS (
  SELECT *, 2 * source_size / w::DOUBLE <= (total - capped) / weight AS is_full FROM filling
), rest AS (
  SELECT coalesce(sum(2 * source_size) FILTER (WHERE is_full), 0)::BIGINT AS capped, sum(w) FILTER (WHERE NOT is_full)::BIGINT AS weight FROM full_ones
), plan AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE (total - rest.capped) / rest.weight * w END AS target
  FROM full_ones, rest
), ranked AS (
  SELECT doc_id, size, s.source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) - 1 AS r
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), drawn AS (
  SELECT source, ('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN ':' ELSE '/' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM plan
)
SELECT doc_id, size, source_size, target, (floor(u + rate * (r + 1)) - floor(u + rate * r))::BIGINT * size AS taken
FROM ranked k JOIN drawn d ON k.source IS NOT DISTINCT FROM d.source
"""
