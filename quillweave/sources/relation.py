"""The text relations as a Spark data source: files in ranges, lines with their numbers, batch and stream.

    register(spark)
    spark.read.format("quillweave").option("relation", "hits").load("folder/part-*")
    spark.readStream.format("quillweave").option("relation", "lines").load("folder")

A range of bytes of a file holds the lines that begin in it; a partition is one range, or a run of small ones. A filter on a
relation's first column drops lines as they are read, before they are split. The relation lines has file, part, nth and value:
the range, and the line's number in it; ``numbered`` makes numbers of whole files or folders of them, by prefix sums over ranges.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..tables import filesystem, ship
from .textio import RELATIONS

NAME = "quillweave"
#: Bytes of a range, and of what is read and given at a time.
RANGE, BLOCK = 64 << 20, 4 << 20
#: Bytes of a partition of smaller ranges, and of what is read beyond a range's end at least.
RUN, MORE = 8 << 20, 64 << 10
_LINES = [("file", "string"), ("part", "int"), ("nth", "long"), ("value", "string")]


class Range(NamedTuple):
    path: str
    part: int  # the first one's number, of a run of ranges
    start: int
    end: int


class Runs(InputPartition):
    def __init__(self, runs: list[Range]):
        self.runs = runs


def _listed(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of a file, a folder's files, or those of a pattern's last part."""
    from pyarrow import fs

    files, base = filesystem(path)
    folder, _, last = base.rpartition("/")
    if any(c in last for c in "*?["):
        found = [x for x in files.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(x.base_name, last)]
    else:
        one = files.get_file_info(base)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [one] if one.is_file else files.get_file_info(fs.FileSelector(base))
    return sorted((x.mtime_ns or 0, x.path, x.size) for x in found if x.is_file and x.base_name[:1] not in "._")


def _ranges(found: list[tuple[int, str, int]], size: int) -> list[Range]:
    return [Range(path, i, at, min(at + size, n)) for _, path, n in found for i, at in enumerate(range(0, n, size))]


def _runs(found: list[tuple[int, str, int]], size: int) -> list[Runs]:
    """Partitions of ranges of so many bytes: small ranges, and small files, go together up to RUN bytes."""
    step = size * max(1, RUN // size)
    out: list[list[Range]] = []
    held = step
    for _, path, n in found:
        for at in range(0, n, step):
            run = Range(path, at // size, at, min(at + step, n))
            if held + run.end - run.start > step:
                out.append([])
                held = 0
            out[-1].append(run)
            held += run.end - run.start
    return [Runs(x) for x in out]


def _placed(files, r: Range) -> Iterator[tuple[int, list[bytes]]]:
    """The lines that begin in a range, without their ends, a block at a time, and where the block's first begins."""
    with files.open_input_file(r.path) as f:
        # A line that begins before the range is left out: what is read begins one byte early, to see whether one ends there.
        begin = max(0, r.start - 1)
        f.seek(begin)
        rest, first = b"", r.start > 0
        # Not much more than the range is read; of a line that is longer than a block as much again as is known of it.
        while begin < r.end and (block := f.read(max(min(BLOCK, max(MORE, r.end - begin - len(rest))), len(rest)))):
            rest += block
            if first:
                cut = rest.find(b"\n")
                if cut < 0:
                    begin += len(rest)
                    rest = b""
                    continue
                rest, begin, first = rest[cut + 1 :], begin + cut + 1, False
            # rest begins at begin, where a line does.
            parts = rest.split(b"\n")
            size, n = 0, 0
            while n < len(parts) - 1 and begin + size < r.end:
                size += len(parts[n]) + 1
                n += 1
            if n:
                yield begin, parts[:n]
            rest, begin = rest[size:], begin + size
        if not first and rest and begin < r.end:  # the file's last line, without an end
            yield begin, [rest]


def _lines(files, r: Range) -> Iterator[list[bytes]]:
    """The lines that begin in a range, without their ends, a block at a time."""
    return (lines for _, lines in _placed(files, r))


class _Reader:
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.relation, self.path = options.get("relation", "lines"), options["path"]
        self.size, self.names = int(options.get("rangebytes", RANGE)), schema.names
        self.fields = _LINES if self.relation == "lines" else RELATIONS[self.relation]
        self.key: str | None = None

    def read(self, partition: Runs) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        for r in partition.runs:
            for cols in self._numbers(files, r) if self.relation == "lines" else self._fields(files, r):
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, kinds[kind]) for x, (_, kind) in zip(cols, self.fields)], self.names)

    def _numbers(self, files, r: Range) -> Iterator[list]:
        part, n = r.part, 0  # the last line's range, and how many of its lines there were
        for begin, lines in _placed(files, r):
            ends = np.cumsum([len(x) + 1 for x in lines])
            parts = (begin + np.concatenate(([0], ends[:-1]))) // self.size
            firsts = np.concatenate(([0], np.flatnonzero(np.diff(parts)) + 1))
            nth = np.arange(len(lines)) - np.repeat(firsts, np.diff(np.append(firsts, len(lines))))
            if parts[0] == part:
                nth[: firsts[1] if len(firsts) > 1 else len(lines)] += n
            part, n = int(parts[-1]), int(nth[-1]) + 1
            yield [pa.repeat(r.path, len(lines)), parts, nth, [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]]

    def _fields(self, files, r: Range) -> Iterator[list]:
        for lines in _lines(files, r):
            if self.key is not None:
                key = self.key.encode()
                lines = [x for x in lines if x.lstrip()[: len(key)] == key]
            rows = [x for x in (line.decode("utf-8", "replace").split() for line in lines) if x and (self.key is None or x[0] == self.key)]
            cols = [[x[i] if i < len(x) else None for x in rows] for i in range(len(self.fields))]
            yield [[_number(x) for x in c] if kind == "double" else c for c, (_, kind) in zip(cols, self.fields)]


class RelationReader(_Reader, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if self.relation != "lines" and isinstance(x, EqualTo) and x.attribute == (self.fields[0][0],) and self.key in (None, x.value):
                self.key = x.value
            else:
                yield x

    def partitions(self) -> Sequence[Runs]:
        return _runs(_listed(self.path), self.size)


class RelationStreamReader(_Reader, DataSourceStreamReader):
    """Files as they come, by their time of change and path."""

    def initialOffset(self) -> dict:
        return {"last": [-1, ""]}

    def latestOffset(self) -> dict:
        found = _listed(self.path)
        return {"last": [*found[-1][:2]] if found else [-1, ""]}

    def partitions(self, start: dict, end: dict) -> Sequence[Runs]:
        return _runs([x for x in _listed(self.path) if start["last"] < [x[0], x[1]] <= end["last"]], self.size)


def _number(x: str | None) -> float | None:
    try:
        return None if x is None else float(x)
    except ValueError:
        return None


class RelationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        relation = self.options.get("relation", "lines")
        return ", ".join(f"{c} {kind}" for c, kind in (_LINES if relation == "lines" else RELATIONS[relation]))

    def reader(self, schema: StructType) -> RelationReader:
        return RelationReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> RelationStreamReader:
        return RelationStreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, which then hands its filters to sources in Python."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RelationSource)


def read(spark: SparkSession, relation: str, path: str, **options: str) -> DataFrame:
    """A relation's rows, with filters on its first column taken by the source."""
    register(spark)
    return spark.read.format(NAME).option("relation", relation).options(**options).load(path)


def numbered(lines: DataFrame, whole: bool = False) -> DataFrame:
    """file, number (from 0), value of the lines of a frame of the relation lines; whole: numbers go on from file to file, by path."""
    held = lines.groupBy("file", "part").agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each range that holds a line's begin: far fewer than lines.
    ranges = held.select("file", "part", F.coalesce(before, F.lit(0)).alias("before"))
    if whole:  # a row for each file
        earlier = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        files = held.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(earlier, F.lit(0)).alias("earlier"))
        ranges = ranges.join(files, "file").select("file", "part", (F.col("before") + F.col("earlier")).alias("before"))
    return lines.join(ranges, ["file", "part"]).select("file", (F.col("before") + F.col("nth")).alias("number"), "value")
