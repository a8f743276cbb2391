"""What the operators share: scratch tables, files in shared folders, and numpy views of text columns."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..tables import CLEAN, filesystem, located, remove, setting, workspace  # noqa: F401
from ..tables import stored as table

#: The white space of every contract here: space and the ASCII controls from tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch.
BATCH = 4 << 20
#: Rows, as a power of two, of a part of a file whose counts are read at once.
PART = 18
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package; on a cluster it is installed or sent by --py-files.

    Rows hold whole texts, so that the session's Arrow batches are bounded by bytes too.
    """
    tables.ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > BATCH:
        spark.conf.set(name, str(BATCH))


def give_back() -> None:
    """Returns memory that the worker has freed to the machine: where its C library can, from the middle of the heap too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, with the package at hand for the workers, which give memory back when a task ends."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def batches_of(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager:
    """Arrow batches of at most so many rows for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    return setting(spark, name, str(min(rows, before) if before > 0 else rows))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query's tables, which driver and executors share.

    Tables that frames returned to the caller read stay as long as the folder.
    """
    ship(spark)
    return workspace(spark, name)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with marks after them where columns are called so, in whatever case."""
    taken = {c.lower() for c in columns}
    out = []
    for x in names:
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return out


def _numbered(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def placed(docs: DataFrame, home: str) -> tuple[DataFrame, str, str]:
    """docs and two more columns, their names given: the file in which a row lies, and the row's number in it.

    A frame that isn't just a table read from Parquet files, whose rows alone are numbered, is written to one first.
    """
    if not _numbered(docs):
        docs = table(docs, f"{home}/rows")
    file, row = fresh(docs.columns, "file", "row")
    where = docs.metadataColumn("_metadata")
    return docs.select("*", where["file_path"].alias(file), where["row_index"].alias(row)), file, row


def _emit(path: str, width: int, coded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, base = filesystem(path)
        name, rows, n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            part, at = batch.column(width).dictionary_encode(), batch.column(width + 1).to_numpy()
            code, times = part.indices.to_numpy(), np.zeros(batch.num_rows, np.int64)
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), batch.num_rows]
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if name != (of := part.dictionary[int(code[i])].as_py()):
                    found = [x.path for x in files.get_file_info(fs.FileSelector(f"{base}/part={of}", allow_not_found=True)) if x.path.endswith(".parquet")]
                    tables = [pq.read_table(files.open_input_file(x), columns=["row", "n"]) for x in found]
                    rows, n = (np.concatenate([np.zeros(0, np.int64), *(t.column(c).to_numpy() for t in tables)]) for c in ("row", "n"))
                    order, name = np.argsort(rows), of
                    rows, n = rows[order], n[order]
                if len(rows):
                    k = np.minimum(np.searchsorted(rows, at[i:j]), len(rows) - 1)
                    times[i:j] = np.where(rows[k] == at[i:j], n[k], 0)
            if coded:
                at = np.flatnonzero(times)
                kept = batch.select(range(width)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(times[at])], [*kept.schema.names, "n"])
            else:
                yield batch.select(range(width)).take(pa.array(np.repeat(np.arange(batch.num_rows), times)))

    return run


def emit(rows: DataFrame, file: str, row: str, counts: DataFrame, home: str, code: str | None = None, then=None) -> DataFrame:
    """The columns of rows but file and row, each row as often as counts (file, row, n) says, 0 if not named there.

    With a name for n, rows that are named come once, with their n as a column of that name. then, a function of batches and
    its schema, is what the same Python worker does with the rows: another one beside it would double what workers hold.
    rows come from placed. What is written, and read by the tasks that scan a file, are the counts, in parts of a file
    of at most 2**PART rows; the rows stay where they lie.
    """
    path = f"{home}/counts"
    part = F.concat_ws("-", F.md5(F.col("file").cast("binary")), F.shiftright("row", PART))
    counts = counts.select(part.alias("part"), F.col("row").cast("long").alias("row"), F.col("n").cast("long").alias("n"))
    with setting(rows.sparkSession, CLEAN, "true"):
        counts.repartition("part").sortWithinPartitions("part", "row").write.partitionBy("part").parquet(path)
    names = [c for c in rows.columns if c not in (file, row)]
    at, of = F.col(f"`{row}`"), F.md5(F.col(f"`{file}`").cast("binary"))
    cells = rows.select(*[F.col(f"`{c}`") for c in names], F.concat_ws("-", of, F.shiftright(at, PART)).alias(file), at.alias(row))
    schema, run = rows.drop(file, row).schema, _emit(path, len(names), code is not None)
    if then is not None:
        return arrow(cells, lambda batches: then[0](run(batches)), then[1])
    return arrow(cells, run, schema.add(code, "long") if code else schema)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if off is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, of at least n exponents."""
    while len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = _POWERS[k]
            _POWERS[k] = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
    return _POWERS[0], _POWERS[1]


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = _IS_WORD, change: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, document's index, start, end) of every token of the documents between the offsets.

    A token is a longest run of bytes of one class other than 0; change maps bytes before they are hashed. Its hash
    depends on its bytes alone, so equal tokens of any documents have equal hashes. Starts and ends are places in data.
    """
    first, last = int(offsets[0]), int(offsets[-1])
    b = data[first:last]
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes[b].astype(np.int8)
    edge = np.empty(len(b) + 1, bool)  # whether a token may not span the places before and at it
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets[1:-1] - first] = True
    s = np.flatnonzero(edge[:-1] & (kind != 0))
    e = np.flatnonzero(edge[1:] & (kind != 0)) + 1
    if change is not None:
        b = change[b]
    p, inv = _powers(len(b) + 1)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_CODE[b] * p[: len(b)], out=sums[1:])
    h = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(offsets, s + first, side="right") - 1, s + first, e + first


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, document's index, length in bytes) of every word of the documents between the offsets."""
    h, doc, s, e = tokens(data, offsets, change=_LOWER if lower else None)
    return h, doc, e - s


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; of its whole sequence if it is shorter."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    for i in range(n_docs):
        w = h[bounds[i] : bounds[i + 1]]
        if not len(w):
            yield w
            continue
        n = min(k, len(w))
        out = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            out = mix(out * np.uint64(0xA24BAED4963EE407) + w[j : len(w) - n + 1 + j])
        yield np.unique(out)
