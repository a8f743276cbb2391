"""Exact top-k inner products by a three-phase uniform threshold.

A vector's score is the sum of its scores in blocks of components, so that each block is a list of local scores.
1. Each task gathers, for each query and block of components, its rows of the largest local scores, adds up what these rows
   lack, and sends their k best totals; the k-th best of all tasks is a safe cutoff for the query: k rows reach it.
2. The cutoffs go out with the queries. A row whose total reaches a cutoff has a local score of at least the cutoff divided
   by the number of lists in some list, so the entries from that uniform threshold on are sufficient; tasks collect them.
3. What their rows' scores in the other lists are is resolved exactly; the rows that reach the cutoff go to the final
   choice, at most k of each task and query.

Queries lie in tiles and rows in blocks that meet in the cells of a grid (``vectors``): two jobs, whatever their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow, scratch, table
from .vectors import LEAST, ROWS, Best, meet, packets, product, quantised, unpacked  # noqa: F401

#: Queries of a tile.
QUERIES = 256
#: Blocks of components.
LISTS = 4
SCALE = 1024
#: Local scores beyond which sums are made of whole vectors.
WIDE = 1 << 60
_SCHEMA = "query_id long, vec_id long, score long"


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, in order; ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _parts(dims: int, lists: int) -> list[slice]:
    edges = np.linspace(0, dims, min(lists, max(1, dims)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _local(queries: np.ndarray, rows: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each list: lists x queries x rows, totals)."""
    local = np.stack([product(queries[:, p], rows[:, p]) for p in _parts(rows.shape[1], lists)])
    wide = local.size and max(int(local.max()), -int(local.min())) >= WIDE
    return local, product(queries, rows) if wide else local.sum(0)


def _gathered(queries: np.ndarray, rows: np.ndarray, cutoffs: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, total) of the rows of the k largest local scores of each list, once each."""
    local, total = _local(queries, rows, lists)
    n = min(k + 1, local.shape[2])  # one more, for the query's own row
    at = np.argpartition(local, local.shape[2] - n, axis=2)[:, :, local.shape[2] - n :]
    cells = np.unique(at + (np.arange(len(queries)) * len(rows))[:, None])
    return cells // len(rows), cells % len(rows), total.ravel()[cells]


def _collected(queries: np.ndarray, rows: np.ndarray, cutoffs: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, total) of the rows that reach the cutoff, among those of a local score from the uniform threshold on."""
    local, total = _local(queries, rows, lists)
    least = cutoffs // len(local) + (cutoffs % len(local) > 0)
    enough = (local >= least[:, None]).any(0)
    q, r = np.nonzero(enough & (total >= cutoffs[:, None]))
    return q, r, total[q, r]


def _scan(find, k: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        blocks: dict[int, tuple] = {}
        cell = None

        def found() -> Iterator[pa.RecordBatch]:
            for _, ids, _, top in held.values():
                line, got, scores = top.rows()
                yield pa.record_batch([pa.array(c) for c in (ids[line], got, scores)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                here, tile, block = (batch.column(c)[i].as_py() for c in ("cell", "t_no", "b_no"))
                if here != cell:
                    yield from found()
                    held, blocks, cell = {}, {}, here
                if block not in blocks:
                    blocks[block] = unpacked(batch, i, ["id"], "b")
                if tile not in held:
                    queries, (ids, cutoffs) = unpacked(batch, i, ["id", "cutoff"], "t")
                    held[tile] = queries.astype(np.float64), ids, cutoffs, Best(len(ids), k)
                rows, (names,) = blocks[block]
                queries, ids, cutoffs, top = held[tile]
                q, r, scores = find(queries, rows.astype(np.float64), np.maximum(cutoffs, top.scores[:, -1]), k, lists)
                other = names[r] != ids[q]
                top.take(q[other], scores[other], names[r[other]])
        yield from found()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, lists: int = LISTS, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of the largest inner products, ties to smaller vec_id.

    vectors and queries have vec_id and embedding, an array of numbers whose components count as floor(scale * x). A
    query's own vec_id is no candidate. Rows whose vec_id or vector is null, or whose vector is empty or holds a null or
    a number that isn't finite, take no part; a query's candidates are the vectors of its length; a query without
    candidates has no rows. Repeated queries count once; repeated candidates each. Other columns, of whatever name, are
    ignored; an empty table gives an empty result. block is the number of queries of a tile.
    """
    home = scratch(vectors.sparkSession, "topk")
    columns = F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector")
    known = F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    blocks = packets(vectors.where(known).select(*columns), ["id"], ROWS, scale, f"{home}/blocks")
    asked = table(queries.where(known).select(*columns).dropDuplicates(["id"]), f"{home}/queries")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def phase(rows: DataFrame, find, name: str) -> DataFrame:
        tiles = packets(rows.repartitionByRange("id").sortWithinPartitions("id"), ["id", "cutoff"], block, scale, f"{home}/{name}")
        got = meet(tiles, blocks).transform(arrow, _scan(find, k, lists), _SCHEMA)
        return got.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k)

    none = F.lit(LEAST).alias("cutoff")
    seen = phase(asked.select("*", none), _gathered, "gather").groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n"))
    cutoffs = table(seen.where(F.col("n") == k).select(F.col("query_id").alias("id"), "cutoff"), f"{home}/cutoffs")
    # With fewer than k rows all are sufficient.
    asked = asked.join(cutoffs, "id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(LEAST)))
    return phase(asked, _collected, "collect").select("query_id", "rank", "vec_id", "score")


def divisible(column: str = "vec_id", by: int = 100) -> Column:
    """The stated query set: rows whose id is divisible by 100."""
    return F.col(column) % by == 0


SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
