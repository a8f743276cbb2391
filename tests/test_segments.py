"""Puts to the stored index: newest wins, merges, lookups that read little, writers side by side."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillweave.operators import segments
from quillweave.operators.index import Index
from quillweave.tables import workspace


def tf(spark, rows):
    return spark.createDataFrame(rows, "word string, url string, tf double")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_newest_wins_through_merges(spark):
    rng, want, path = random.Random(1), {}, f"{workspace(spark, 'segments')}/index"
    assert rows(segments.load(spark, path).tf) == []
    for i in range(11):
        new = {(rng.choice("abcdefgh"), f"u{rng.randint(0, 9)}"): float(i) for _ in range(30)}
        segments.put(Index(tf(spark, [(*k, v) for k, v in new.items()]), None, spark.createDataFrame([("u", float(i))], "url string, rank double")), path)
        want |= new
        if i in (4, 10):
            before = segments.load(spark, path)
            assert segments.merge(spark, path, 3) > 0
            assert rows(before.tf) == rows(segments.load(spark, path).tf)  # readers of the earlier state go on
    live = segments.state(spark, path)
    assert max(x.level for x in live) >= 2 and sum(x.table == "tf" for x in live) <= 5
    segments.vacuum(spark, path)
    got = segments.load(spark, path)
    assert rows(got.tf) == sorted((*k, v) for k, v in want.items()) and rows(got.rank) == [("u", 10.0)] and rows(got.idf) == []
    for w in "ahz":
        assert rows(segments.lookup(spark, path, "tf", w)) == sorted((*k, v) for k, v in want.items() if k[0] == w)
    with pytest.raises(ValueError):
        segments.put(Index(tf(spark, [("a", "u", 1.0), ("a", "u", 2.0)]), None, None), path)
    segments.put(Index(tf(spark, []), None, None), path)
    assert segments.state(spark, path) == live


def test_lookup_reads_its_word(spark):
    path = f"{workspace(spark, 'segments')}/index"
    many = spark.range(200_000).select(F.format_string("w%05d", F.col("id") % 20_000).alias("word"), F.format_string("u%06d", "id").alias("url"), F.lit(1.0).alias("tf"))
    for part in range(2):
        segments.put(Index(many.where(F.col("id") % 2 == part) if part else many, None, None), path, check=False)
    found = segments.lookup(spark, path, "tf", "w00777")
    assert found.count() == 10
    df = spark.read.schema(segments.SCHEMAS["tf"]).parquet(*[f"{path}/{x.folder}/{n}" for x in segments.state(spark, path) for n, a, b in x.files if a <= "w00777" <= b]).where("word = 'w00777'")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    read = leaf.metrics().apply("numOutputRows").value()
    assert 10 <= read <= 4 * segments.PAGE_ROWS and leaf.metrics().apply("numFiles").value() <= 4


def test_writers_side_by_side(spark):
    path, errors = f"{workspace(spark, 'segments')}/index", []

    def write(k):
        try:
            for i in range(3):
                segments.put(Index(tf(spark, [(f"w{k}", f"u{i}", float(k))]), None, None), path)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    merging = segments.merge_in_background(spark, path, 2)
    for t in [*threads, merging]:
        t.join()
    segments.merge(spark, path, 2)
    assert not errors and rows(segments.load(spark, path).tf) == sorted((f"w{k}", f"u{i}", float(k)) for k in range(3) for i in range(3))
    # A change that is still being written isn't seen, and isn't lost when it is whole.
    before = segments.state(spark, path)
    new = segments._write(tf(spark, [("late", "u", 1.0)]), "tf", path, 0)
    where, files = segments._files(spark, f"{path}/log/{99:09d}-x.json")
    out = files.create(where, False)
    out.write(bytearray(b'{"new": ['))
    out.flush()
    assert segments.state(spark, path) == before
    segments.put(Index(tf(spark, [("new", "u", 0.0), ("late", "u", 2.0)]), None, None), path)
    out.write(bytearray((json.dumps(new) + '], "instead": [], "table": null, "tags": []}\n').encode()))
    out.close()
    assert rows(segments.lookup(spark, path, "tf", "late")) == [("late", "u", 2.0)] and len(segments.state(spark, path)) == len(before) + 2
    segments.vacuum(spark, path)
    assert rows(segments.lookup(spark, path, "tf", "new")) == [("new", "u", 0.0)] and len(segments._changes(spark, path)) == 1


def test_sums_and_tags(spark):
    path, want = f"{workspace(spark, 'segments')}/counts", {}
    rng = random.Random(3)
    for i in range(6):
        new = {(rng.choice("ab"), f"u{j}"): rng.randint(-2, 2) for j in range(4)}
        frame = spark.createDataFrame([(*k, n) for k, n in new.items()], segments.SCHEMAS["counts"])
        assert segments.add(frame, "counts", path, f"batch {i}") and not segments.add(frame, "counts", path, f"batch {i}")
        want = {k: want.get(k, 0) + new.get(k, 0) for k in want | new}
        if i == 3:
            segments.merge(spark, path, 2)
            segments.vacuum(spark, path)
            assert not segments.add(frame, "counts", path, "batch 0")
        assert rows(segments.load_table(spark, path, "counts")) == sorted((*k, n) for k, n in want.items() if n)


def test_put_and_merge_move_rows_once(spark):
    path = f"{workspace(spark, 'segments')}/index"
    frames = [spark.range(3000).select(F.concat(F.lit("w"), F.col("id") % 50).alias("word"), F.concat(F.lit("u"), "id").alias("url"), F.lit(x).alias("tf")) for x in (1.0, 2.0)]
    for f in frames:
        segments.put(Index(f, None, None), path)
    seen = []
    old = segments._write

    def write(rows, table, path, level, reduced=lambda x: x):
        frame = reduced(rows.repartitionByRange(*segments.KEYS[table]))
        plan = frame._jdf.queryExecution().executedPlan().toString()
        seen.append((plan.count("Exchange "), "SortAggregate" in plan))
        return old(rows, table, path, level, lambda _: frame)

    segments._write = write
    try:
        assert segments.merge(spark, path, 2) == 1
        segments.put(Index(frames[0], None, None), path)
        with pytest.raises(ValueError):
            segments.put(Index(frames[0].union(frames[1].where("url = 'u7'")), None, None), path)
    finally:
        segments._write = old
    assert seen == [(1, False)] * 3
    got = segments.load(spark, path).tf
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 3000 and {x.tf for x in got.collect()} == {1.0}
    # A newest row that holds no number counts too.
    segments.put(Index(frames[0].where("url = 'u7'").withColumn("tf", F.lit(None).cast("double")), None, None), path)
    assert [x.tf for x in segments.load(spark, path).tf.where("url = 'u7'").collect()] == [None]


def test_the_pages_index_is_grouped_once(spark, monkeypatch):
    from quillweave import queries
    from quillweave.operators import index

    monkeypatch.setattr(queries, "_STORED", {})
    asked = []
    monkeypatch.setattr(index, "check_unique", lambda df, keys: asked.append(keys))
    built = queries._index(spark, "/root/testdata/sf0.001")
    assert not asked
    for table, keys in index.KEYS.items():
        assert getattr(built, table).groupBy(*keys).count().where("count > 1").isEmpty()
