"""Hard negatives by branch-and-bound over ball trees.

Vectors lie in blocks, near ones side by side, and each block is a ball tree: a node has a centre, the radius that holds all
its vectors, its smallest id and its label if it has only one. For an anchor a node's inner products lie within
centre * anchor -/+ radius * |anchor|, which bounds them above and below. A node is left out if all its products are above
or below the window that a search asks for, if they are strictly beneath the k-th best that the search holds so far, or
as good at best with larger ids only, or if its one label is what the search can't use.

Anchors are searched twice: for their positives, the best of the same label, and then, with windows made of the positives'
scores, for the best of other labels. Searches lie in tiles and meet the blocks in cells of a grid (``vectors``); a cell sends
at most k rows for each search. Searches of a tile go down a tree together, those that a node can't serve stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow, scratch, table
from .vectors import ASKED, LEAST, MOST, ROWS, Best, meet, octant, packets, product, unpacked

SCALE = 256
#: Vectors of a leaf.
LEAF = 64
#: What rounding can add to a bound, relative to the numbers that it is made of.
SLACK = 1e-9


class Ball(NamedTuple):
    start: int
    end: int
    centre: np.ndarray
    radius: float
    first_id: int
    label: int | None  # of all its vectors, if they have the same
    children: tuple[Ball, ...]


class Tree(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    root: Ball


def grow(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """The ball tree of a block: a ball is halved between two of its vectors that are far apart."""
    order, stored = np.arange(len(ids)), rows
    rows = rows.astype(np.float64)

    def ball(start: int, end: int) -> Ball:
        at = order[start:end]
        with np.errstate(over="ignore", invalid="ignore"):
            centre = rows[at].mean(0)
            away = np.linalg.norm(rows[at] - centre, axis=1)
            children: tuple[Ball, ...] = ()
            if end - start > leaf and not away.max() == 0:
                a = rows[at[away.argmax()]]
                b = rows[at[np.linalg.norm(rows[at] - a, axis=1).argmax()]]
                order[start:end] = at[np.argsort(np.nan_to_num(rows[at] @ (b - a)), kind="stable")]
                middle = (start + end) // 2
                children = ball(start, middle), ball(middle, end)
        one = labels[at[0]]
        return Ball(start, end, centre, float(away.max()), int(ids[at].min()), int(one) if (labels[at] == one).all() else None, children)

    root = ball(0, len(ids))
    return Tree(ids[order], labels[order], stored[order], root)


class Searches(Best):
    """Searches of a tile, and the k best rows that each holds so far."""

    def __init__(self, ids, labels, rows, low, high, k: int, same: bool):
        super().__init__(len(ids), k)
        self.ids, self.labels, self.low, self.high, self.same = ids, labels, low, high, same
        # Searches of an anchor lie together: its products are made once.
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        self.of, self.anchors = np.cumsum(new) - 1, rows[new].astype(np.float64)
        with np.errstate(over="ignore"):
            self.norms = np.linalg.norm(self.anchors, axis=1)
        self.seen = 0  # leaves' vectors that were multiplied, times anchors

    def wanted(self, node: Ball, who: np.ndarray) -> np.ndarray:
        """Of the searches who, those that the node can serve."""
        if node.label is not None:
            who = who[(self.labels[who] == node.label) == self.same]
        if not len(who):
            return who
        of = self.of[who]
        with np.errstate(over="ignore", invalid="ignore"):
            middle, spread = (self.anchors @ node.centre)[of], node.radius * self.norms[of]
            slack = SLACK * (spread + np.linalg.norm(node.centre) * self.norms[of])
            top, least = middle + spread + slack, middle - spread - slack
        # Where a number is too large to be bounded, nothing is left out.
        kth, full = self.scores[who, -1].astype(np.float64), self.have[who] == self.k
        beneath = top < kth
        tied = (node.radius == 0) & (slack < 0.2) & (top < kth + 0.5) & (node.first_id > self.found[who, -1])
        return who[~(top < self.low[who].astype(np.float64)) & ~(least > self.high[who].astype(np.float64)) & ~(full & (beneath | tied))]

    def visit(self, tree: Tree, node: Ball, who: np.ndarray) -> None:
        who = self.wanted(node, who)
        if not len(who):
            return
        if node.children:
            a, b = node.children
            with np.errstate(over="ignore", invalid="ignore"):
                if (self.anchors @ (b.centre - a.centre))[self.of[who]].sum() > 0:
                    a, b = b, a
            self.visit(tree, a, who)
            self.visit(tree, b, who)
            return
        asked, back = np.unique(self.of[who], return_inverse=True)
        at = slice(node.start, node.end)
        ids, labels = tree.ids[at], tree.labels[at]
        scores = product(self.anchors[asked], tree.rows[at].astype(np.float64))[back]
        self.seen += len(asked) * len(ids)
        good = (scores >= np.maximum(self.low[who], self.scores[who, -1])[:, None]) & (scores <= self.high[who][:, None])
        good &= ((self.labels[who][:, None] == labels) == self.same) & (self.ids[who][:, None] != ids)
        s, r = np.nonzero(good)
        if len(s):
            self.take(who[s], scores[s, r], ids[r])


_ASKED = ["id", "label", "low", "high", "tag"]
_FOUND = "id long, tag long, found long, score long"


def _search(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Searches]] = {}
        trees: dict[int, Tree] = {}
        cell = None

        def found() -> Iterator[pa.RecordBatch]:
            for tags, x in held.values():
                line, found_, scores = x.rows()
                yield pa.record_batch([pa.array(c) for c in (x.ids[line], tags[line], found_, scores)], ["id", "tag", "found", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                here, tile, block = (batch.column(c)[i].as_py() for c in ("cell", "t_no", "b_no"))
                if here != cell:
                    yield from found()
                    held, trees, cell = {}, {}, here
                if block not in trees:
                    rows, (ids, labels) = unpacked(batch, i, ["id", "label"], "b")
                    trees[block] = grow(ids, labels, rows)
                if tile not in held:
                    rows, (ids, labels, low, high, tags) = unpacked(batch, i, _ASKED, "t")
                    held[tile] = tags, Searches(ids, labels, rows, low, high, k, same)
                x = held[tile][1]
                x.visit(trees[block], trees[block].root, np.arange(len(x.ids)))
        yield from found()

    return run


def _best(asked: DataFrame, blocks: tuple[DataFrame, int], k: int, same: bool, scale: int, home: str) -> DataFrame:
    """id, tag, rank, found, score: each search's k best rows of all blocks."""
    tiles = packets(asked.repartitionByRange("code", "id").sortWithinPartitions("code", "id", "tag"), _ASKED, ASKED, scale, f"{home}/tiles-{same}")
    got = meet(tiles, blocks).transform(arrow, _search(k, same), _FOUND)
    ranked = Window.partitionBy("id", "tag").orderBy(F.desc("score"), "found")
    return got.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k)


def window_of(score: Column, low: int, high: int) -> tuple[Column, Column]:
    """The least and the largest s with low * score <= 100 * s <= high * score, for a score of at least 0.

    Nothing here passes what a long holds.
    """
    rest = score % 100
    tens = ((score - rest) / 100).cast("long")
    return tens * low + F.ceil(rest * low / 100), tens * high + F.floor(rest * high / 100)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of the anchors.

    vectors has vec_id, embedding (an array of numbers, which count as floor(scale * x)) and label; anchors says which of its
    rows are anchors. An anchor's positives are its best other rows of the same label; for each of them the k best rows of
    other labels follow whose score is between low and high per cent of the positive's. Scores are inner products with
    the anchor; ties go to the smaller vec_id; a row with the anchor's vec_id is no candidate.

    Rows whose vec_id, label or vector is null, or whose vector is empty or holds a null or a number that isn't finite, take
    no part; vectors of different lengths don't meet. Of anchors that share a vec_id that of the smallest label and vector
    counts; repeated rows are candidates each, and a positive found twice has its rows twice. A positive of a score below 0 has
    no negatives. Scores beyond 64 bits count as the nearest long. Other columns, of whatever name, are ignored; an empty
    table, or one without anchors, gives an empty result.
    """
    spark = vectors.sparkSession
    home = scratch(spark, "negatives")
    known = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0))
    known = known.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    known = known.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).withColumn("code", octant())
    rows = known.repartitionByRange("label", "code", "id").sortWithinPartitions("label", "code", "id")
    blocks = packets(rows, ["id", "label"], ROWS, scale, f"{home}/blocks")
    asked = known.where("asked").groupBy("id").agg(F.min(F.struct("label", "vector", "code")).alias("x"))
    asked = table(asked.select("id", "x.label", "x.vector", "x.code"), f"{home}/anchors")
    ends = F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")
    found = _best(asked.select("id", "label", "vector", "code", *ends, F.lit(0).cast("long").alias("tag")), blocks, positives, True, scale, home)
    found = table(found.select("id", F.col("rank").cast("long").alias("tag"), F.col("found").alias("positive_id"), "score"), f"{home}/positives")
    least, most = window_of(F.col("score"), low, high)
    windows = found.where("score >= 0").select("id", "tag", least.cast("long").alias("low"), most.cast("long").alias("high"))
    got = _best(asked.join(windows, "id"), blocks, k, False, scale, home)
    got = got.withColumnsRenamed({"found": "negative_id", "score": "negative_score"}).join(found.withColumnRenamed("score", "positive_score"), ["id", "tag"])
    return got.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def divisible(column: str = "vec_id", by: int = 100) -> Column:
    """The stated anchors: rows whose id is divisible by 100."""
    return F.col(column) % by == 0


def relabelled(vectors: DataFrame) -> DataFrame:
    """The stated labels: where vec_id is divisible by 7 the next of ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM n WHERE rank <= 10
"""
