"""A crawl's frontier that can stop and go on: what has been seen lies in buckets, each with a Bloom filter.

A crawl is a folder. Pages' links lie in buckets by hash of url, and so do the urls that each round saw first. A round reads
the links of its frontier's buckets, tests what they point to with the buckets' filters, and compares only urls that these
may have with those that were seen. Then it stores what is new, the filters that grow by it, and last its state, from
which a crawl goes on after it has been stopped, between rounds or in one. A round's plan doesn't know how many went before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..tables import CLEAN, filesystem, setting, ship, stored

#: Buckets of a crawl, unless it is given others when it begins.
BUCKETS = 64
#: Bits of a filter for each url, hashes of a url, and urls of a bucket's first filter; each next one holds twice as many.
BITS, HASHES, FIRST = 12, 8, 1 << 14


class State(NamedTuple):
    """What a crawl knows after a round; filters: a file for each bucket that has one."""

    round: int
    buckets: int
    new: int
    filters: dict[str, str]


class Filters:
    """The Bloom filters of a bucket: each full but the last."""

    def __init__(self, raw: bytes | None = None):
        self.parts: list[tuple[int, np.ndarray]] = []  # urls held, bits as bytes
        at = 0
        while raw and at < len(raw):
            n, size = np.frombuffer(raw, "<i8", 2, at).tolist()
            self.parts.append((n, np.frombuffer(raw, np.uint8, size, at + 16).copy()))
            at += 16 + size

    def raw(self) -> bytes:
        return b"".join(np.array([n, len(bits)], "<i8").tobytes() + bits.tobytes() for n, bits in self.parts)

    @staticmethod
    def _places(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
        h = h.view(np.uint64)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(8 * len(bits))

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Whether urls of these hashes may have been added; never false for one that was."""
        out = np.zeros(len(h), bool)
        for _, bits in self.parts:
            at = self._places(h, bits)
            out |= ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)
        return out

    def add(self, h: np.ndarray) -> None:
        while len(h):
            size = FIRST << max(0, len(self.parts) - 1)
            if not self.parts or self.parts[-1][0] >= size:
                size = FIRST << len(self.parts)
                self.parts.append((0, np.zeros(size * BITS // 8, np.uint8)))
            n, bits = self.parts[-1]
            some, h = h[: size - n], h[size - n :]
            at = self._places(some, bits).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            self.parts[-1] = n + len(some), bits


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of one bucket each, of rows in order of bucket."""
    for batch in batches:
        at = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for i, j in zip(edges[:-1], edges[1:]):
            if i < j:
                yield int(at[i]), batch.slice(i, j - i)


def _load(path: str, name: str | None) -> Filters:
    files, base = filesystem(path)
    return Filters(files.open_input_file(f"{base}/filters/{name}").read() if name else None)


def _test(path: str, filters: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, None
        for b, rows in _runs(batches):
            if b != bucket:
                bucket, held = b, _load(path, filters.get(str(b)))
            yield pa.record_batch([rows.column("bucket"), rows.column("url"), pa.array(held.holds(rows.column("hash").to_numpy()))], ["bucket", "url", "maybe"])

    return run


def _grow(path: str, filters: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, None

        def done() -> pa.RecordBatch:
            files, base = filesystem(path)
            files.create_dir(f"{base}/filters", recursive=True)
            name = f"{bucket}-{uuid.uuid4().hex}"
            with files.open_output_stream(f"{base}/filters/{name}") as out:
                out.write(held.raw())
            return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([name])], ["bucket", "name"])

        for b, rows in _runs(batches):
            if b != bucket:
                if bucket is not None:
                    yield done()
                bucket, held = b, _load(path, filters.get(str(b)))
            held.add(rows.column("hash").to_numpy())
        if bucket is not None:
            yield done()

    return run


def _bucket(buckets: int, url: str = "url") -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int").alias("bucket")


def _where(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state(spark: SparkSession, path: str) -> State | None:
    """What the crawl at path knew after its last whole round; None if there is none."""
    where, files = _where(spark, f"{path}/states")
    names = sorted((x.getPath().getName() for x in files.listStatus(where)), reverse=True) if files.exists(where) else []
    for name in names:
        stream = files.open(_where(spark, f"{path}/states/{name}")[0])
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text.endswith("\n"):
            return State(**json.loads(text))
    return None


def _keep(spark: SparkSession, path: str, new: DataFrame, round_: int, buckets: int, filters: dict[str, str]) -> State:
    """Stores a round's new urls (bucket, url), the filters that they change, and last its state."""
    with setting(spark, CLEAN, "true"):
        new.repartition("bucket").sortWithinPartitions("bucket", "url").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/seen/round={round_}")
    here = _seen(spark, path).where(F.col("round") == round_).select("bucket", "url", F.xxhash64("url").alias("hash"))
    grown = here.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "hash").mapInArrow(_grow(path, filters), "bucket int, name string")
    names = {str(x.bucket): x.name for x in grown.collect()}  # a row for each bucket
    out = State(round_, buckets, here.count(), filters | names)
    where, files = _where(spark, f"{path}/states/{round_:09d}.json")
    stream = files.create(where, True)
    stream.write(bytearray((json.dumps(out._asdict()) + "\n").encode()))
    stream.close()
    return out


def _seen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, round int, bucket int").parquet(f"{path}/seen")


def begin(links: DataFrame, seeds: DataFrame, path: str, buckets: int = BUCKETS) -> State:
    """Begins a crawl at path: links has url and links (array of urls, in any form), seeds url; the state of round 0.

    A crawl that has begun there is taken up as it is.
    """
    spark = links.sparkSession
    ship(spark)
    if (found := state(spark, path)) is not None:
        return found
    ends = F.array_distinct(F.filter(F.transform("links", U.normalize_url), lambda x: x.isNotNull()))
    with setting(spark, CLEAN, "true"):
        links.select(_bucket(buckets), "url", ends.alias("links")).repartition("bucket").sortWithinPartitions("bucket", "url").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/links")
    new = seeds.select(U.normalize_url("url").alias("url")).where(F.col("url").isNotNull()).distinct()
    return _keep(spark, path, new.select(_bucket(buckets), "url"), 0, buckets, {})


def go_on(spark: SparkSession, path: str, rounds: int | None = None) -> State:
    """Goes on with the crawl at path until its frontier is empty, or for at most the given rounds."""
    ship(spark)
    now = state(spark, path)
    while now.new and (rounds is None or rounds > 0):
        now = _round(spark, path, now)
        rounds = None if rounds is None else rounds - 1
    return now


def _round(spark: SparkSession, path: str, now: State) -> State:
    home = f"{path}/work/{now.round + 1}-{uuid.uuid4().hex}"
    seen = _seen(spark, path).where(F.col("round") <= now.round)
    frontier = seen.where(F.col("round") == now.round).select("bucket", "url")
    # The frontier's buckets, at most as many as there are: the scan of links reads no others.
    touched = [x.bucket for x in frontier.select("bucket").distinct().collect()]
    links = spark.read.schema("url string, links array<string>, bucket int").parquet(f"{path}/links").where(F.col("bucket").isin(touched))
    ends = links.join(frontier, ["bucket", "url"], "left_semi").select(F.explode("links").alias("url")).distinct()
    asked = ends.select(_bucket(now.buckets), "url", F.xxhash64("url").alias("hash")).repartition("bucket").sortWithinPartitions("bucket")
    asked = stored(asked.mapInArrow(_test(path, now.filters), "bucket int, url string, maybe boolean"), f"{home}/asked")
    unsure = asked.where("maybe").select("bucket", "url")
    near = [x.bucket for x in unsure.select("bucket").distinct().collect()]
    new = unsure.join(seen.where(F.col("bucket").isin(near)).select("bucket", "url"), ["bucket", "url"], "left_anti")
    new = stored(asked.where("NOT maybe").select("bucket", "url").unionByName(new), f"{home}/new")
    return _keep(spark, path, new, now.round + 1, now.buckets, now.filters)


def seen(spark: SparkSession, path: str) -> DataFrame:
    """url, round: what the crawl's whole rounds have seen first, and when."""
    return _seen(spark, path).where(F.col("round") <= state(spark, path).round).select("url", "round")
