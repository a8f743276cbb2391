"""The data source of the text relations."""

import random
import time

from pyspark.sql import functions as F

from quillweave.sources import relation
from quillweave.tables import workspace


def test_ranges_hold_each_line_once(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(relation, "BLOCK", 7)
    rng = random.Random(1)
    for k in range(60):
        text = b"".join(bytes(rng.choice(b"ab\n") for _ in range(rng.randint(0, 40))) for _ in range(2))
        (tmp_path / f"{k}").write_bytes(text)
        want = text.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        for size in (1, 3, 10, 1000):
            ranges = relation._ranges([(0, str(tmp_path / f"{k}"), len(text))], size)
            assert [x for r in ranges for part in relation._lines(fs.LocalFileSystem(), r) for x in part] == want, (text, size)


def test_relations(spark, tmp_path):
    (tmp_path / "hits.1").write_text("a u1\nb  u2\n\n alone\r\n")
    (tmp_path / "hits.2").write_text("a u3 more\nab u4")
    (tmp_path / "_SUCCESS").write_text("")
    hits = relation.read(spark, "hits", f"{tmp_path}/hits.*", rangeBytes="4")
    assert sorted(map(tuple, hits.collect()), key=str) == [("a", "u1"), ("a", "u3"), ("ab", "u4"), ("alone", None), ("b", "u2")]
    some = relation.read(spark, "hits", str(tmp_path)).where(F.col("word") == "a")
    assert {x.url for x in some.collect()} == {"u1", "u3"}
    # The source takes the filter: lines of other words aren't given to Spark.
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() == 2
    lines = relation.numbered(relation.read(spark, "lines", f"{tmp_path}/hits.*", rangeBytes="3"))
    got = {(x.file[-1], x.number): x.value for x in lines.collect()}
    assert got == {("1", 0): "a u1", ("1", 1): "b  u2", ("1", 2): "", ("1", 3): " alone", ("2", 0): "a u3 more", ("2", 1): "ab u4"}
    (tmp_path / "t").write_text("w u x\nw u 0.5\nw\n")
    assert sorted(map(tuple, relation.read(spark, "tfs", f"{tmp_path}/t").collect()), key=str) == [("w", "u", 0.5), ("w", "u", None), ("w", None, None)]


def test_stream(spark, tmp_path):
    relation.register(spark)
    source, out = tmp_path / "in", f"{workspace(spark, 'stream')}/out"
    source.mkdir()
    for batch in range(3):
        (source / f"f{9 - batch}").write_text(f"w{batch} u\nsame u{batch}\n")
        time.sleep(0.02)
        frame = spark.readStream.format(relation.NAME).option("relation", "hits").load(str(source))
        query = frame.writeStream.format("parquet").option("checkpointLocation", out + "-at").trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert spark.read.parquet(out).count() == 2 * (batch + 1)
    assert {x.word for x in spark.read.parquet(out).collect()} == {"w0", "w1", "w2", "same"}


def test_small_ranges_go_together(spark, tmp_path):
    lines = [f"{i} {'x' * (i * 7919 % 300)}" for i in range(20_000)]
    for k in range(4):
        (tmp_path / f"part-{k}").write_text("".join(x + "\n" for x in lines[k * 5000 : (k + 1) * 5000]))
    (tmp_path / "part-4").write_text("")
    frame = relation.read(spark, "lines", f"{tmp_path}/part-*", rangeBytes="1000")
    assert frame.rdd.getNumPartitions() == 1 and frame.select("file", "part").distinct().count() > 2500
    assert [x.value for x in relation.numbered(frame, whole=True).orderBy("number").collect()] == lines
    got = {(x.file[-1], x.number): x.value for x in relation.numbered(frame).collect()}
    assert got == {(str(i // 5000), i % 5000): x for i, x in enumerate(lines)}


def test_a_range_is_read_without_what_follows(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(relation, "MORE", 100)
    lines = [b"y" * (i % 50) for i in range(2000)] + [b"z" * 5000]
    (tmp_path / "f").write_bytes(b"\n".join(lines))
    size, read = (tmp_path / "f").stat().st_size, []

    class Files:
        def open_input_file(self, path):
            f = fs.LocalFileSystem().open_input_file(path)

            class Counted:
                __enter__, __exit__, seek = lambda s: s, lambda s, *a: f.close(), lambda s, at: f.seek(at)

                def read(self, n):
                    read.append(len(x := f.read(n)))
                    return x

            return Counted()

    assert [x for r in relation._ranges([(0, str(tmp_path / "f"), size)], 500) for part in relation._lines(Files(), r) for x in part] == lines
    assert sum(read) < 2 * size
