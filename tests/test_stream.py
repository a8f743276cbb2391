"""A stream of pages into the stored counts against the batch engine."""

import random

from quillweave.operators import crawl, segments
from quillweave.streaming import hits as stream
from quillweave.tables import workspace


def test_five_batches_equal_the_whole(spark, tmp_path):
    rng = random.Random(5)
    contents = [f"<p>{' '.join(rng.choice('red blue green one two three'.split()) for _ in range(6))} c{i}</p>" for i in range(12)] + [None, ""]
    rows = [(f"http://h/{rng.randint(0, 60):02d}", rng.choice(contents)) for _ in range(90)] + [("no url", "<p>red</p>")]
    home, source = workspace(spark, "stream"), tmp_path / "in"
    batches = [rows[:20], rows[20:40], rows[10:50], [], rows[50:], rows[60:70]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, "url string, html string").coalesce(1).write.mode("append").parquet(str(source))
        arriving = spark.readStream.schema("url string, html string").parquet(str(source))
        stream.follow(arriving, f"{home}/index", f"{home}/at", 2, availableNow=True).awaitTermination()
        so_far = spark.createDataFrame([x for b in batches[: i + 1] for x in b], "url string, html string").distinct()
        want = crawl.hits(crawl.content_dedupe(crawl.normalized(so_far)).distinct()).groupBy("word", "url").count()
        assert sorted(map(tuple, stream.counts(spark, f"{home}/index").collect())) == sorted(map(tuple, want.collect()))
    assert sum(x.table == "counts" for x in segments.state(spark, f"{home}/index")) <= 3


def test_batches_of_the_query_are_of_several_files(spark, tmp_path, monkeypatch):
    from quillweave import queries

    rows = [(i, f"http://h/{i:03d}", f"<p>red blue c{i % 40}</p>") for i in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    frames, old = [], stream.follow
    monkeypatch.setattr(stream, "follow", lambda pages, *a, **b: frames.append(pages) or old(pages, *a, **b))
    got = queries.QUERIES["streamed_hits"](spark, str(tmp_path))
    pages = spark.read.parquet(str(tmp_path / "pages.parquet"))
    want = crawl.hits(crawl.content_dedupe(crawl.normalized(pages))).groupBy("word", "url").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(frames) == 5  # one for each batch, whose files no task has put together
