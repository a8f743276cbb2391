"""Jobs with and without combine, heavy keys, counters."""

import threading
import time
from collections import Counter

from pyspark.sql import functions as F

from quillweave.operators import jobs


def lines(spark, n, heavy):
    return spark.range(n).repartition(7).select(F.lit("").alias("key"), F.when(F.col("id") % heavy != 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 5003)).alias("value"))


def test_a_key_with_half_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(jobs, "HELD", 500)
    monkeypatch.setattr(jobs, "SAMPLED", 2000)
    frame = lines(spark, 60_000, 2)
    # Combined for so few at a time, the hot key still comes many times.
    seen = []
    old = jobs._heavy
    monkeypatch.setattr(jobs, "_heavy", lambda pairs, parts: seen.append(old(pairs, parts)) or seen[-1])
    never = jobs.Job(lambda k, v: [(v, "1")], jobs._sum, lambda k, values: [(k, v) for v in values])
    for job in (jobs.JOBS["WordCount"](), never):
        counters = jobs.Counters(spark)
        got = {x.key: int(x.value) for x in jobs.run_job(job, frame, counters).collect()}
        want = Counter(x.value for x in frame.collect())
        assert got == want
        assert (counters.mapped, counters.reduced) == (60_000, len(want)) and counters.keys_read == counters.keys_written == len(want)
        assert len(counters.sample) == 10 and all(got[k] == int(v) for k, v in (x.split() for x in counters.sample))
    assert seen[-1] == ["hot"]


def test_without_combine_values_come_as_they_are(spark):
    job = jobs.Job(lambda k, v: [(k, v)], lambda k, values: [(k, ",".join(values))])
    frame = spark.createDataFrame([("a", str(i)) for i in range(50)] + [("b", "x"), (None, "y")], "key string, value string").coalesce(1)
    got = dict(map(tuple, jobs.run_job(job, frame).collect()))
    assert got["a"] == ",".join(map(str, range(50))) and got["b"] == "x" and got[None] == "y"
    first = jobs.Job(lambda k, v: [(k, v)], lambda k, values: [(k, next(values))])
    assert dict(map(tuple, jobs.run_job(first, frame).collect()))["a"] == "0"
    assert jobs.run_job(jobs.JOBS["WordCount"](), frame.limit(0)).count() == 0


def test_counters_while_a_job_runs(spark):
    counters = jobs.Counters(spark)
    assert counters.state == "IDLE" and counters.sample == []

    def slow(k, v):
        time.sleep(0.02 if v == "hot" else 0)
        return [(v, "1")]

    frame = lines(spark, 600, 100)
    job = jobs.run_job(jobs.Job(slow, jobs._sum), frame.repartition(40, "value", F.rand(1)), counters)
    thread = threading.Thread(target=job.collect)
    thread.start()
    between = set()
    while thread.is_alive():
        between.add((counters.state, counters.mapped))
        time.sleep(0.05)
    assert any(state == "MAPPING" and 0 < n < 600 for state, n in between)
    assert counters.state == "REDUCING" and counters.mapped == 600


def test_long_keys_are_held_by_their_length(monkeypatch):
    monkeypatch.setattr(jobs, "HELD_CHARS", 1000)
    monkeypatch.setattr(jobs, "GIVEN_CHARS", 500)
    held = []

    def pairs():
        for i in range(4000):
            held.append(i)
            yield (f"{i % 3000:0200d}" if i % 2 else "same"), "1"

    given, ahead = Counter(), 0
    for k, v in jobs._combined(pairs(), jobs._sum):
        given[k] += int(v)
        ahead = max(ahead, len(held) - sum(given.values()))
    assert given == Counter(f"{i % 3000:0200d}" if i % 2 else "same" for i in range(4000)) and ahead < 50
    assert all(len(x) <= 3 for x in jobs._pairs((("k" * 200, "1") for _ in range(50))))


def test_heavy_keys_without_null(spark, monkeypatch):
    monkeypatch.setattr(jobs, "SAMPLED", 2000)
    rows = [("hot", "1")] * 3000 + [(None, "1")] * 3000 + [(f"k{i}", "1") for i in range(100)]
    frame = spark.createDataFrame(rows, "key string, value string")
    assert jobs._heavy(frame.repartition(4), 8) == ["hot"]
    job = jobs.Job(lambda k, v: [(k, v)], jobs._sum, lambda k, values: [(k, v) for v in values])
    assert {x.key: int(x.value) for x in jobs.run_job(job, frame).collect()} == Counter(k for k, _ in rows)
