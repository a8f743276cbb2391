"""Redirects, schedules, and crawls that stop and go on."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillweave.operators import crawl, fetching, frontier
from quillweave.tables import workspace

LOG = "url string, seconds long, status int, location string, content_type string, content_length long"


def test_redirects(spark):
    html = ("text/html", 10)
    rows = [
        ("http://h/a", 1, 200, None, *html),
        ("http://h/b", 1, 301, "/a?x=1", *html),
        ("http://h/c", 1, 302, "http://h:80/a#top", *html),
        ("http://h/d", 1, 303, "a", *html),  # neither rooted nor a url
        ("http://h/e", 1, 301, None, *html),
        ("http://h/f", 1, 301, "/b", *html),  # a second redirect
        ("http://h/g", 1, 301, "/nowhere", *html),
        ("http://h/i", 1, 307, "/a", *html),
        ("http://h/j", 1, 301, "/a", *html), ("http://h/j", 2, 404, None, *html),  # the last answer counts
        ("http://h/k", 1, 404, None, *html), ("http://h/k", 2, 200, None, None, 5),
        ("http://h/l", 1, 200, None, "text/html", None), ("http://h/m", 1, 200, None, "text/html", 1 << 21), ("http://h/n", 1, 200, None, "image/png", 1),
        ("bad", 1, 200, None, *html), (None, 1, 200, None, *html),
    ]
    log = spark.createDataFrame(rows, LOG)
    got = {x.asked.rpartition("/")[2]: x.url.rpartition("/")[2] for x in fetching.followed(log).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", **{x: x for x in "klmn"}}
    assert {x.asked.rpartition("/")[2] for x in fetching.accepted(log).collect()} == {"a", "b", "c"}
    assert fetching.followed(log.limit(0)).count() == 0
    # Pages go on under the url that gave them, and once.
    pages = spark.createDataFrame([("http://h/a", '<a href="/k">k</a><a href="/c">c</a>'), ("http://h/k", "k"), ("http://h/l", "l")], "url string, html string")
    seeds = spark.createDataFrame([("http://h/b",), ("http://h/l",)], "url string")
    reached, seen = crawl.crawl(pages, seeds, log=log)
    assert [x.url for x in reached.collect()] == ["http://h:80/a"]
    assert {(x.url, x.round) for x in seen.collect()} == {("http://h:80/b", 0), ("http://h:80/l", 0), ("http://h:80/k", 1), ("http://h:80/c", 1)}


def test_schedule_with_a_hot_host(spark):
    rng = random.Random(2)
    rows = [(f"http://{rng.choice(['hot', 'hot', 'a', 'b', 'bad', 'x' + str(i % 50)])}/{i}", rng.randint(0, 20)) for i in range(4000)]
    rows += [rows[0], ("nothing", 1), (None, 2)]
    robots = [("hot", "User-agent: *\nCrawl-delay: 3"), ("a", "User-agent: *\nCrawl-delay: 1"), ("bad", "User-agent: *\nCrawl-delay: x"), ("hot", "User-agent: *\nCrawl-delay: 2")]
    log = [("hot", 50), ("hot", 100), ("b", 7)]
    frame = spark.createDataFrame(rows, "url string, position int").repartition(9)
    args = spark.createDataFrame(robots, "host string, text string"), spark.createDataFrame(log, "host string, seconds long")
    queues = defaultdict(list)
    for url, position in rows:
        if url and url.startswith("http"):
            queues[url.split("/")[2]].append((position, url))
    want = []
    for host, queue in queues.items():
        delay, last = {"hot": 3, "a": 1}.get(host, 0), {"hot": 100, "b": 7}.get(host, 5)
        if host != "bad":
            want += [(host, url, i, last + i * delay) for i, (_, url) in enumerate(sorted(queue), 1)]
    # Without coalescing the hot host's queue lies in several parts.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fetching.schedule(frame, *args, start=5)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert fetching.schedule(frame.limit(0), *args).count() == 0


def test_filters_grow():
    rng = np.random.default_rng(1)
    known, other = rng.integers(-(1 << 62), 1 << 62, 60_000), rng.integers(-(1 << 62), 1 << 62, 60_000)
    held = frontier.Filters()
    assert not held.holds(other[:5]).any()
    for part in np.array_split(known, 7):
        held.add(part)
    held = frontier.Filters(held.raw())
    assert [n for n, _ in held.parts] == [1 << 14, 1 << 15, 60_000 - (1 << 14) - (1 << 15)]
    assert held.holds(known).all() and held.holds(other).mean() < 0.02


def test_crawl_stops_and_goes_on(spark, monkeypatch):
    rng = random.Random(7)
    links = {i: [rng.randint(0, 120) for _ in range(2)] + [i + 1] for i in range(100)}
    pages = spark.createDataFrame([(f"http://h/{i}", f"{i} " + "".join(f'<a href="{j}">x</a>' for j in to)) for i, to in links.items()], "url string, html string")
    seeds = spark.createDataFrame([("http://h/3",), ("http://h/3",), ("no url",)], "url string")
    want, near = {3: 0}, [3]
    while near:
        near = [j for j in dict.fromkeys(j for i in near for j in links.get(i, [])) if j not in want]
        want |= {j: max(want.values()) + 1 for j in near}
    monkeypatch.setattr(frontier, "BUCKETS", 5)
    path = f"{workspace(spark, 'crawls')}/one"
    plans = []
    for rounds in (0, 1, 2, None):
        reached, seen = crawl.crawl(pages, seeds, rounds=rounds, path=path)
        plans.append(len(seen._jdf.queryExecution().executedPlan().toString()))
        now = frontier.state(spark, path)
        got = {int(x.url.rpartition("/")[2]): x.round for x in seen.collect()}
        assert got == {k: r for k, r in want.items() if r <= now.round}
        assert {int(x.url.rpartition("/")[2]) for x in reached.collect()} == {k for k, r in got.items() if k < 100 and (r < now.round or not now.new)}
    assert now.new == 0 and max(plans) < 1.2 * min(plans)
    # A round that broke off before its state was written is done again.
    path = f"{workspace(spark, 'crawls')}/two"
    crawl.crawl(pages, seeds, rounds=2, path=path)
    where, files = frontier._where(spark, f"{path}/states/{2:09d}.json")
    files.delete(where, False)
    out = files.create(where, True)
    out.write(bytearray(b'{"round": 2'))
    out.close()
    assert frontier.state(spark, path).round == 1
    assert {int(x.url.rpartition("/")[2]): x.round for x in crawl.crawl(pages, seeds, path=path)[1].collect()} == want
