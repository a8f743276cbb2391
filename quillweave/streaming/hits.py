"""An index that follows pages as they arrive (an extension: the batch engine has no streams).

Which url a content belongs to is kept in a stream's state, under the content's digest: the smallest so far. Where a smaller one
comes, the hits of the one before are taken back. Each batch's changes of counts are a segment of the stored table of
counts, where they are added up; nothing that was stored is read or written anew, and a batch that runs again is put once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.html import parse
from ..functions.text import words
from ..operators import segments
from ..operators.crawl import hits, normalized
from ..tables import ship


def count_hits(pages: DataFrame) -> DataFrame:
    """word, url, n of a stream of pages (url, html); for complete or update mode."""
    return hits(normalized(pages)).groupBy("word", "url").agg(F.count("*").alias("n"))


def write_counts(counts: DataFrame, path: str, checkpoint: str):
    """Starts a query that replaces the table at path with each batch's whole counts; a batch that runs again writes the same."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, url, text: of rows of a batch with one content that with the smallest url, so that copies don't all move."""
    for batch in batches:
        first: dict[str, tuple[str, str | None]] = {}
        for digest, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if digest not in first or url < first[digest][0]:
                first[digest] = url, html.as_py()
        urls, texts = [u for u, _ in first.values()], [None if h is None else parse(h, False)[0] for _, h in first.values()]
        yield pa.record_batch([pa.array(list(first), pa.string()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["digest", "url", "text"])


def _owner(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """url, text, sign: a content's new url, and the one that it had, of negative sign."""
    before = state.get[0] if state.exists else None
    best, text = before, None
    for f in frames:
        for url, said in zip(f["url"], f["text"]):
            text = said
            best = url if best is None or url < best else best
    if best != before:
        state.update((best,))
        rows = [(best, text, 1)] + ([(before, text, -1)] if before is not None else [])
        yield pd.DataFrame(rows, columns=["url", "text", "sign"])


def changes(pages: DataFrame) -> DataFrame:
    """word, url, sign of a stream of pages (url, html): hits that come, and those of urls whose content has got a smaller one."""
    ship(pages.sparkSession)
    digest = F.coalesce(F.md5(F.col("html").cast("binary")), F.lit(""))
    rows = normalized(pages).select(digest.alias("digest"), "url", "html").mapInArrow(_texts, "digest string, url string, text string")
    owners = rows.groupBy("digest").applyInPandasWithState(_owner, "url string, text string, sign int", "url string", "append", GroupStateTimeout.NoTimeout)
    return owners.select(F.explode_outer(words("text")).alias("word"), "url", "sign").where(F.col("word").isNotNull())


def follow(pages: DataFrame, path: str, checkpoint: str, fan: int = segments.FAN, **trigger):
    """Starts a query that adds a stream's pages to the counts stored at path; trigger as in ``DataStreamWriter.trigger``."""

    def put(batch: DataFrame, number: int) -> None:
        n = batch.groupBy("word", "url").agg(F.sum("sign").alias("n")).where("n <> 0")
        if segments.add(n, "counts", path, f"{checkpoint} {number}"):
            segments.merge(batch.sparkSession, path, fan)

    writer = changes(pages).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(**trigger) if trigger else writer).start()


def counts(spark: SparkSession, path: str) -> DataFrame:
    """word, url, n of all pages so far."""
    return segments.load_table(spark, path, "counts")
