"""Queries against all rows of a table of vectors, in one job whatever their numbers: tiles of queries meet blocks of rows.

Rows lie in blocks and queries in tiles, each a row of a written table that holds a matrix. A grid of cells, of bounded
numbers of tiles and blocks each, deals them out: a tile goes to the cells of its line, a block to those of its column, so
that what moves is each block once for a group of tiles and each tile once for a group of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, table

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Rows of a block, queries of a tile.
ROWS, ASKED = 2048, 1024
#: Tiles and blocks of a cell at most; columns of the grid that are made where there are as many blocks.
TILES, BLOCKS, COLUMNS = 64, 32, 64
#: Components of a packet at most, unless it has one vector only.
COMPONENTS = 1 << 18
#: Partitions of cells at most.
PARTITIONS = 8192


def quantised(vectors: pa.Array, scale: int = 1024) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of valid vectors: (their positions, their components as floor(scale * x)).

    A vector that is null or empty, or holds a null or a number that isn't finite, is left out.
    """
    if not len(vectors):
        return []
    first = vectors.offsets.to_numpy()
    sizes, flat = np.diff(first), vectors.values
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    good = flat.is_valid().to_numpy(zero_copy_only=False)
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        cells = first[at][:, None] + np.arange(n)
        v = x[cells]
        fit = good[cells].all(1) & np.isfinite(v).all(1)
        if fit.any():
            with np.errstate(over="ignore"):
                out.append((at[fit], np.nan_to_num(np.floor(v[fit] * scale))))
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact: in doubles where no sum can pass 2**53, else in whole numbers.

    A score beyond 64 bits is set to the nearest that a long holds.
    """
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0.0
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    wide = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best rows that each of some searches holds so far: score descending, smaller ids first."""

    def __init__(self, n: int, k: int):
        self.k, self.have = k, np.zeros(n, np.int64)
        self.scores, self.found = np.full((n, k), LEAST), np.full((n, k), MOST)

    def take(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, ~scores, who))
        who, scores, ids = who[order], scores[order], ids[order]
        some, first, n = np.unique(who, return_index=True, return_counts=True)
        nth = np.arange(len(who)) - np.repeat(first, n)
        kept = nth < self.k
        line = np.repeat(np.arange(len(some)), n)[kept]
        new_s, new_i = np.full((len(some), self.k), LEAST), np.full((len(some), self.k), MOST)
        new_s[line, nth[kept]], new_i[line, nth[kept]] = scores[kept], ids[kept]
        s, i = np.concatenate([self.scores[some], new_s], 1), np.concatenate([self.found[some], new_i], 1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.scores[some], self.found[some] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.have[some] = np.minimum(self.k, self.have[some] + np.minimum(n, self.k))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, id, score) of all that are held."""
        line, col = np.nonzero(np.arange(self.k) < self.have[:, None])
        return line, self.found[line, col], self.scores[line, col]


def octant(vector: str = "vector", bits: int = 16) -> Column:
    """The signs of a vector's first components, by which near vectors are put side by side."""
    code = F.lit(0)
    for i in range(bits):
        code = code + F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i)).otherwise(0)
    return code


def _small(m: np.ndarray) -> tuple[str, bytes]:
    """A matrix of whole numbers in the smallest type that holds them."""
    most = np.abs(m).max() if m.size else 0
    kind = next((k for k, top in (("<i2", 2**15 - 1), ("<i4", 2**31 - 1)) if most <= top), "<f8")
    return kind, m.astype(kind).tobytes()


def _pack(columns: list[str], size: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packet(dims: int, numbers: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            nonlocal nth
            kind, raw = _small(m)
            cells = [[part], [nth], [len(m)], [dims], [kind], [raw], *([c.tobytes()] for c in numbers)]
            nth += 1
            types = [pa.int32()] * 4 + [pa.string()] + [pa.binary()] * (1 + len(columns))
            return pa.record_batch([pa.array(x, t) for x, t in zip(cells, types)], ["part", "nth", "n", "dims", "kind", "vectors", *columns])

        for batch in batches:
            for at, m in quantised(batch.column("vector"), scale):
                numbers = np.stack([batch.column(c).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
                kept = held.setdefault(m.shape[1], [])
                kept.append((numbers, m))
                some = max(1, min(size, COMPONENTS // m.shape[1]))
                if sum(len(x) for _, x in kept) >= some:
                    numbers, m = np.concatenate([x for x, _ in kept], 1), np.concatenate([x for _, x in kept])
                    whole = len(m) // some * some
                    for i in range(0, whole, some):
                        yield packet(m.shape[1], numbers[:, i : i + some], m[i : i + some])
                    kept[:] = [(numbers[:, whole:], m[whole:])]
        for dims, kept in held.items():
            numbers, m = np.concatenate([x for x, _ in kept], 1), np.concatenate([x for _, x in kept])
            if len(m):
                yield packet(dims, numbers, m)

    return run


def packets(rows: DataFrame, columns: list[str], size: int, scale: int, path: str) -> tuple[DataFrame, int]:
    """(packets, their number) of rows (vector and the columns, longs), put together in the order in which rows lie.

    Packets are numbered from 0 by no. The driver sees one number for each partition.
    """
    spark = rows.sparkSession
    schema = "part int, nth int, n int, dims int, kind string, vectors binary, " + ", ".join(f"{c} binary" for c in columns)
    out = table(rows.select("vector", *columns).transform(arrow, _pack(columns, size, scale), schema), path)
    counts = sorted(out.groupBy("part").agg(F.count("*").alias("n")).collect())
    at = np.cumsum([0, *(x.n for x in counts)]).tolist()
    before = spark.createDataFrame([(x.part, a) for x, a in zip(counts, at)], "part int, before long")
    return out.join(before, "part").withColumn("no", F.col("before") + F.col("nth")).drop("before", "part", "nth"), at[-1]


def unpacked(batch: pa.RecordBatch, i: int, columns: list[str], side: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """(vectors, in the type in which they are stored, and the columns) of a side of a meeting."""
    n, kind, raw = (batch.column(f"{side}_{c}")[i].as_py() for c in ("n", "kind", "vectors"))
    return np.frombuffer(raw, kind).reshape(n, -1), [np.frombuffer(batch.column(f"{side}_{c}")[i].as_py(), np.int64) for c in columns]


def meet(tiles: tuple[DataFrame, int], blocks: tuple[DataFrame, int]) -> DataFrame:
    """A row for each tile and block of vectors of one length: cell, and the columns of both with t_ and b_ before them."""
    (t, n_tiles), (b, n_blocks) = tiles, blocks
    lines = max(1, -(-n_tiles // TILES))
    columns = max(1, min(n_blocks, max(COLUMNS, -(-n_blocks // BLOCKS))))
    parts = min(lines * columns, PARTITIONS)
    cell = (F.col("line") * columns + F.col("col")).alias("cell")
    t = t.withColumn("line", F.pmod("no", F.lit(lines))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    b = b.withColumn("col", F.pmod("no", F.lit(columns))).withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    sides = []
    for side, x in (("t", t), ("b", b)):
        names = [c for c in x.columns if c not in ("line", "col")]
        sides.append(x.select(cell, *[F.col(c).alias(f"{side}_{c}") for c in names]).repartition(parts, "cell"))
    return sides[0].join(sides[1].hint("merge"), "cell").where("t_dims = b_dims")
