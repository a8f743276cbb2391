"""Generic map and reduce over key-value rows, for jobs that Python functions describe."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from math import log
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import ship, stored, workspace

Pairs = Iterable[tuple[str, str]]


#: Pairs that a task holds to combine them, and rows of a sample that tells which keys are heavy.
HELD, SAMPLED = 100_000, 100_000
#: Characters of the pairs that a task holds to combine them, and of a batch that it gives: keys may be whole texts.
HELD_CHARS, GIVEN_CHARS = 16 << 20, 2 << 20


class Job(NamedTuple):
    map: Callable[[str, str], Pairs]  # key and value to any number of pairs
    reduce: Callable[[str, Iterator[str]], Pairs]  # key and all its values to any number of pairs
    #: Key and some of its values to fewer pairs of that key, which reduce takes as it does the values; None if there is no such.
    combine: Callable[[str, Iterator[str]], Pairs] | None = None


class _ByTask(AccumulatorParam):
    """What each task of a side has counted: one that runs again counts once."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for k, v in b.items():
            a[k] = max(a.get(k, v), v)
        return a


class Counters:
    """A job's counters, known for its tasks that have ended while it runs, and for all when it has: rows mapped, keys
    reduced, and lines of the first outputs. The driver holds a number for each task, and SAMPLE lines."""

    SAMPLE = 10

    def __init__(self, spark: SparkSession):
        self._tasks = spark.sparkContext.accumulator({}, _ByTask())

    def _of(self, side: str) -> int:
        return sum(n for (x, _), (n, _) in self._tasks.value.items() if x == side)

    @property
    def state(self) -> str:
        return "REDUCING" if self._of("reduce") else "MAPPING" if self._of("map") else "IDLE"

    @property
    def mapped(self) -> int:
        return self._of("map")

    @property
    def reduced(self) -> int:
        return self._of("reduce")

    @property
    def keys_read(self) -> int:
        """As a worker tells it: rows while it maps, then keys."""
        return self.reduced or self.mapped

    keys_written = keys_read

    @property
    def sample(self) -> list[str]:
        return [x for _, (_, lines) in sorted(self._tasks.value.items()) for x in lines][: self.SAMPLE]

    def tell(self, side: str, n: int, lines: tuple = ()) -> None:
        self._tasks.add({(side, TaskContext.get().partitionId()): (n, lines)})


def _size(pair: tuple[str | None, str | None]) -> int:
    return sum(len(x) for x in pair if x is not None)


def _pairs(rows: Iterable[tuple[str, str]], size: int = 10_000) -> Iterator[pd.DataFrame]:
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += _size(row)
        if len(out) >= size or chars >= GIVEN_CHARS:
            yield pd.DataFrame(out, columns=["key", "value"])
            out, chars = [], 0
    if out:
        yield pd.DataFrame(out, columns=["key", "value"])


Rows = Iterator[tuple[str, str]]


def _combined(pairs: Rows, combine: Callable[[str, Iterator[str]], Pairs]) -> Rows:
    """Pairs in which values of a key are combined, HELD or HELD_CHARS at a time."""
    held: dict[str, list[str]] = defaultdict(list)
    n = chars = 0
    for k, v in pairs:
        # A key is held once, whatever the number of its values.
        chars += _size((k, v)) if k not in held else _size((v,))
        held[k].append(v)
        n += 1
        if n >= HELD or chars >= HELD_CHARS:
            some = [p for x, values in held.items() for p in combine(x, iter(values))]
            held.clear()
            left = sum(map(_size, some))
            if 2 * len(some) > n or 2 * left > chars:  # too many keys to combine here
                yield from some
                n = chars = 0
                continue
            for x, v in some:
                held[x].append(v)
            n, chars = len(some), left
    for x, values in held.items():
        yield from combine(x, iter(values))


def _heavy(pairs: DataFrame, parts: int) -> list[str]:
    """Keys that a sample of the pairs says have more than a quarter of a partition; at most four for each partition."""
    # What meets in one task are the keys' hashes; keys themselves, which may be long, are looked for only where one is heavy.
    of = F.xxhash64("key")
    some = pairs.where(F.col("key").isNotNull()).select(of.alias("h")).limit(SAMPLED).groupBy("h").agg(F.count("*").alias("n"))
    total = some.agg(F.sum("n")).first()[0] or 0
    if total < SAMPLED // 10:
        return []
    hashes = [x.h for x in some.where(F.col("n") * 4 * parts > total).orderBy(F.desc("n")).limit(4 * parts).collect()]
    if not hashes:
        return []
    return [x.key for x in pairs.where(of.isin(hashes)).select("key").distinct().limit(4 * parts).collect()]


def run_job(job: Job, df: DataFrame, counters: Counters | None = None) -> DataFrame:
    """key, value that a job makes of df (key, value).

    Values stream through reduce in order of key, one partition after the other: no key's values need to fit into
    memory, and reduce may stop early. A job with combine has its values combined before they move; keys that a sample
    finds heavy even so are dealt to several tasks by where they come from, combined there, and reduced then. Counters
    tell how far the job has come.
    """
    spark = df.sparkSession
    ship(spark)
    combine = job.combine

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0

        def pairs() -> Rows:
            nonlocal n
            for b in batches:
                for k, v in zip(b["key"], b["value"]):
                    n += 1
                    yield from job.map(k, v)

        yield from _pairs(_combined(pairs(), combine) if combine else pairs())
        if counters:
            counters.tell("map", n)

    def grouped(make: Callable[[str, Iterator[str]], Pairs], told: Counters | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, lines = 0, []

            def made() -> Rows:
                nonlocal n
                rows = (row for b in batches for row in zip(b["key"], b["value"]))
                for k, group in groupby(rows, key=lambda r: r[0]):
                    n += 1
                    for pair in make(k, (v for _, v in group)):
                        if told and len(lines) < told.SAMPLE:
                            lines.append(f"{pair[0]} {pair[1]}")
                        yield pair

            yield from _pairs(made())
            if told:
                told.tell("reduce", n, tuple(lines))

        return run

    schema = "key string, value string"
    pairs = df.select(F.col("key").cast("string"), F.col("value").cast("string")).mapInPandas(mapped, schema)
    reduced = grouped(job.reduce, counters)
    if combine is None:
        return pairs.repartition("key").sortWithinPartitions("key").mapInPandas(reduced, schema)
    pairs = stored(pairs, f"{workspace(spark, 'job')}/pairs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if heavy := _heavy(pairs, parts):
        hot = F.col("key").isin(heavy)
        salt = F.pmod(F.spark_partition_id(), F.lit(parts))
        some = pairs.where(hot).withColumn("salt", salt).repartition("key", "salt").sortWithinPartitions("key").drop("salt")
        pairs = pairs.where(~hot | F.col("key").isNull()).unionByName(some.mapInPandas(grouped(combine, None), schema))
    return pairs.repartition("key").sortWithinPartitions("key").mapInPandas(reduced, schema)


def run_named(name: str, df: DataFrame, counters: Counters | None = None, **settings) -> DataFrame:
    return run_job(JOBS[name](**settings), df, counters)


def of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """key, value of lines: jobs don't look at the key, which stays empty. A null isn't a line."""
    return lines.where(F.col(column).isNotNull()).select(F.lit("").alias("key"), F.col(column).alias("value"))


def _sum(key: str, values: Iterator[str]) -> Pairs:
    return [(key, str(sum(map(int, values))))]


def _word_count() -> Job:
    return Job(lambda k, v: [(v, "1")], _sum, _sum)


def _term_frequency() -> Job:
    def split(k, v):
        t = v.split()
        return [(f"{t[0]} {t[1]}", "1")] if len(t) > 1 else []  # not a hit

    return Job(split, lambda k, values: [(k, str(log(1 + sum(map(int, values)))))], _sum)


def _inverse_document_frequency(n: int = 1_000_000) -> Job:
    return Job(lambda k, v: [(w, "1") for w in v.split()[:1]], lambda k, values: [(k, str(log(1.0 * n / (1 + sum(map(int, values)))) + 1))], _sum)


JOBS: dict[str, Callable[..., Job]] = {"WordCount": _word_count, "TermFrequency": _term_frequency, "InverseDocumentFrequency": _inverse_document_frequency}
