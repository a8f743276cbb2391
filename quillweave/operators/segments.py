"""A stored index that takes puts: sorted segments, newest wins, merged as they pile up.

Each put of a table is a segment, a small table in order of its key. What is live is said by the changes in a log, read in
order of their numbers: a put appends segments, a merge puts one in the place of a run of neighbouring ones, if it finds them
so. Writers need no lock: a change is a file of its own, and one that is written while others are takes its place when it is
whole; of changes of one number the file's name decides. A segment's files are known with the range of their keys, so that a
lookup opens those alone whose range holds its word, and in them reads the pages that hold it.

Segments are merged by size, FAN of one level to one of the next, so that there are about FAN times the logarithm of the
number of puts. Of rows that share a key that of the newest segment counts.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..tables import CLEAN, remove, setting
from .index import KEYS as INDEX_KEYS
from .index import Index, check_unique

#: Segments of a level that are merged.
FAN = 4
#: Rows of a page of a file, at most: about what a lookup reads beyond its word.
PAGE_ROWS = 4096
SCHEMAS = {"tf": "word string, url string, tf double", "idf": "word string, idf double", "rank": "url string, rank double", "counts": "word string, url string, n long"}
#: Tables whose rows of a key are added up, and count no more at 0; of others the newest counts.
SUMS = {"counts"}
KEYS = INDEX_KEYS | {"counts": ["word", "url"]}


class Segment(NamedTuple):
    table: str
    folder: str
    level: int
    files: list[tuple[str, str, str]]  # name, first key, last key


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _changes(spark: SparkSession, path: str) -> list[str]:
    where, files = _files(spark, f"{path}/log")
    names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
    return sorted(x for x in names if x.endswith(".json") and x[:9].isdigit())


def _segments(found: list) -> list[Segment]:
    return [Segment(t, f, level, [tuple(x) for x in held]) for t, f, level, held in found]


def state(spark: SparkSession, path: str) -> list[Segment]:
    """The live segments, oldest first; a change that is being written isn't one yet."""
    return _state(spark, path)[0]


def _state(spark: SparkSession, path: str) -> tuple[list[Segment], set[str]]:
    live: list[Segment] = []
    tags: set[str] = set()
    for name in _changes(spark, path):
        where, files = _files(spark, f"{path}/log/{name}")
        stream = files.open(where)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not text.endswith("\n"):
            continue
        change = json.loads(text)
        tags |= set(change["tags"])
        new, gone = _segments(change["new"]), set(change["instead"])
        if not gone:
            again = {x.folder for x in new}
            live = [x for x in live if x.folder not in again] + new
            continue
        mine = [x for x in live if x.table == change["table"]]
        at = [i for i, x in enumerate(mine) if x.folder in gone]
        if len(at) == len(gone) and at[-1] - at[0] == len(at) - 1:  # else another merge took some, or a put came between
            live = [x for x in live if x.table != change["table"]] + mine[: at[0]] + new + mine[at[-1] + 1 :]
    return live, tags


def _commit(spark: SparkSession, path: str, new: list[Segment], instead: list[Segment] = (), tags: list[str] = ()) -> None:
    names = _changes(spark, path)
    n = int(names[-1][:9]) + 1 if names else 1
    where, files = _files(spark, f"{path}/log/{n:09d}-{uuid.uuid4().hex}.json")
    out = files.create(where, False)
    table = instead[0].table if instead else None
    out.write(bytearray((json.dumps({"new": new, "instead": [x.folder for x in instead], "table": table, "tags": sorted(tags)}) + "\n").encode()))
    out.close()


def _write(rows: DataFrame, table: str, path: str, level: int, reduced: Callable[[DataFrame], DataFrame] = lambda x: x) -> Segment | None:
    """A segment of rows, in order of key; none if there are no rows.

    reduced is given the rows when they lie in ranges of their key: what it groups by key doesn't move again.
    """
    spark, keys = rows.sparkSession, KEYS[table]
    folder = f"{table}/{level}-{uuid.uuid4().hex}"
    with setting(spark, CLEAN, "true"):
        ordered = reduced(rows.repartitionByRange(*keys)).select(*_names(table)).sortWithinPartitions(*keys)
        ordered.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/{folder}")
    written = spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{folder}")
    # One row for each file, of its distinct first keys: the smallest of strings needs a sort, which few rows take.
    held = written.select(F.col("_metadata.file_name").alias("name"), keys[0]).distinct().groupBy("name").agg(F.min(keys[0]).alias("first"), F.max(keys[0]).alias("last")).collect()
    return Segment(table, folder, level, sorted((x.name, x.first, x.last) for x in held)) if held else None


def _once(rows: DataFrame, table: str, seen: Observation) -> DataFrame:
    """The rows; what is seen of them is how often the most frequent key comes."""
    rest = [F.first(c).alias(c) for c in _names(table) if c not in KEYS[table]]
    return rows.groupBy(*KEYS[table]).agg(*rest, F.count("*").alias("rows_of_key")).observe(seen, F.max("rows_of_key").alias("most"))


def put(index: Index, path: str, check: bool = True) -> None:
    """Puts the rows of an index's tables, any of which may be None; rows of a key that is stored replace it.

    Rows that share a key within a put raise ValueError. Tables of one put are seen at once.
    """
    spark, new = next(x for x in index if x is not None).sparkSession, []
    for table, rows in zip(Index._fields, index):
        if rows is None:
            continue
        seen = Observation(f"keys of {table}")
        segment = _write(rows, table, path, 0, (lambda x, t=table, o=seen: _once(x, t, o)) if check else lambda x: x)
        if segment is None:
            continue
        new.append(segment)
        if check and seen.get["most"] > 1:
            for x in new:  # no change names them
                remove(spark, f"{path}/{x.folder}")
            check_unique(rows, KEYS[table])
    if new:
        _commit(spark, path, new)


def add(rows: DataFrame, table: str, path: str, tag: str | None = None) -> bool:
    """Puts rows of one table; with a tag once, whatever how often it is called; whether it was."""
    spark = rows.sparkSession
    if tag is not None and tag in _state(spark, path)[1]:
        return False
    new = _write(rows, table, path, 0)
    _commit(spark, path, [new] if new else [], tags=[tag] if tag is not None else [])
    return True


def _names(table: str) -> list[str]:
    return [x.split()[0] for x in SCHEMAS[table].split(", ")]


def _rows(spark: SparkSession, path: str, table: str, live: list[Segment], key: str | None = None) -> DataFrame | None:
    """The rows of a table's segments, with their age if the newest counts; with a key those of files whose range holds it."""
    mine, parts = [x for x in live if x.table == table], []
    for i, x in enumerate(mine):
        held = [name for name, first, last in x.files if key is None or first <= key <= last]
        parts.append((i, [f"{path}/{x.folder}/{name}" for name in held] if key is not None else [f"{path}/{x.folder}"] if held else []))
    parts = [(i, paths) for i, paths in parts if paths]
    if not parts:
        return None
    read = spark.read.schema(SCHEMAS[table])
    if table in SUMS or len(parts) == 1:
        rows = read.parquet(*[x for _, paths in parts for x in paths])
    else:
        rows = reduce(DataFrame.unionByName, [read.parquet(*paths).withColumn("age", F.lit(i)) for i, paths in parts])
    return rows if key is None else rows.where(F.col(KEYS[table][0]) == key)


def _reduced(rows: DataFrame, table: str) -> DataFrame:
    """For each key the sums, or the row of the greatest age."""
    rest = [c for c in _names(table) if c not in KEYS[table]]
    if table in SUMS:
        added = rows.groupBy(*KEYS[table]).agg(*[F.sum(c).alias(c) for c in rest])
        return added.where(" OR ".join(f"{c} <> 0" for c in rest))
    # Numbers by themselves are held by hash; a structure of them would be sorted first.
    return rows.groupBy(*KEYS[table]).agg(*[F.max_by(c, "age").alias(c) for c in rest]) if "age" in rows.columns else rows


def _read(spark: SparkSession, path: str, table: str, live: list[Segment], key: str | None = None) -> DataFrame:
    """The table's rows, for each key those of its newest segment; with a key those of files whose range holds it."""
    rows = _rows(spark, path, table, live, key)
    return spark.createDataFrame([], SCHEMAS[table]) if rows is None else _reduced(rows, table)


def load(spark: SparkSession, path: str) -> Index:
    """The index as the last put left it; later puts and merges don't change what the frames read."""
    live = state(spark, path)
    return Index(*(_read(spark, path, table, live) for table in Index._fields))


def load_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return _read(spark, path, table, state(spark, path))


def lookup(spark: SparkSession, path: str, table: str, key: str) -> DataFrame:
    """A table's rows of a word, or of a url in rank."""
    return _read(spark, path, table, state(spark, path), key)


def _due(live: list[Segment], fan: int) -> list[Segment]:
    """Neighbouring segments of a table and level, or below it, that are to be merged; none if there aren't as many."""
    for table in SCHEMAS:
        mine = [x for x in live if x.table == table]
        for i in range(len(mine) - fan, -1, -1):
            run = mine[i : i + fan]
            if len({x.level for x in run}) == 1:
                return run
    return []


def merge(spark: SparkSession, path: str, fan: int = FAN) -> int:
    """Merges until no level has fan neighbouring segments; how many merges there were.

    Readers and puts go on meanwhile. The merged segments' files stay for readers of earlier states until ``vacuum``.
    """
    n = 0
    while run := _due(state(spark, path), fan):
        table = run[0].table
        new = _write(_rows(spark, path, table, run), table, path, run[0].level + 1, lambda x, t=table: _reduced(x, t))
        _commit(spark, path, [new] if new else [], run)
        n += 1
    return n


def merge_in_background(spark: SparkSession, path: str, fan: int = FAN) -> threading.Thread:
    """Starts ``merge`` beside what the session does."""
    thread = threading.Thread(target=merge, args=(spark, path, fan), daemon=True)
    thread.start()
    return thread


def vacuum(spark: SparkSession, path: str) -> None:
    """Makes the log one change, and deletes segments that are live no more: when no reader of earlier states, and no writer, is at work."""
    (live, tags), old = _state(spark, path), _changes(spark, path)
    held = {x.folder for x in live}
    _commit(spark, path, live, tags=tags)
    # Changes go from the newest on: what is left of them adds nothing that the last one lacks.
    for name in reversed(old):
        remove(spark, f"{path}/log/{name}")
    for table in SCHEMAS:
        where, files = _files(spark, f"{path}/{table}")
        for x in files.listStatus(where) if files.exists(where) else []:
            if f"{table}/{x.getPath().getName()}" not in held:
                remove(spark, x.getPath().toString())
