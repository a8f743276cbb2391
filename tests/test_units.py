"""Small cases with results worked out by hand."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quillweave.functions import codecs, robots, text, urls
from quillweave.functions.html import parsed
from quillweave.operators import crawl, graph, index, jobs, repository, scoring, search
from quillweave.plans import pipeline
from quillweave.sources import textio

URLS = {
    "https://google.com": "https://google.com:443/",
    "http://a.b/c?x=1#y": "http://a.b:80/c",
    "https://a.b/c#top": "https://a.b:443/c",
    "http://ABC/": "http://ABC:80/",
    "http://ABC:8080/x": "http://abc:8080/x",
    "http://h#f": "http://h#f:80/",
    "http://h?x/y": "http://h:80/",
    "ftp://a/": None,
    "mailto:x": None,
    "": None,
    "http:///p": None,
    "http://h:xx/": None,
    "http://h:/": None,
    "HTTP://h/": None,
    None: None,
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {x.url: x.n for x in df.select("url", urls.normalize_url("url").alias("n")).collect()}
    assert got == URLS
    again = {x.n: x.m for x in df.select(urls.normalize_url("url").alias("n")).select("n", urls.normalize_url("n").alias("m")).collect() if x.n}
    assert all(n == m for n, m in again.items() if n == n.lower())
    assert again["http://ABC:80/"] == "http://abc:80/"


def test_resolve(spark):
    cases = [("http://h:80/a/b", "/c", "http://h:80/c"), ("http://h:80/a/b", "c", "http://h:80/a/c"), ("http://h:80/a/b", "//x/y", "http://x/y"), ("http://h:80/a/b", " https://x/ ", "https://x/"), ("http://h:80/a/b", "../z", "http://h:80/z"), ("http://h:80/", None, None)]
    df = spark.createDataFrame(cases, "base string, href string, want string")
    assert all(x.got == x.want for x in df.select("want", urls.resolve_any("base", "href").alias("got")).collect())


def test_words(spark):
    df = spark.createDataFrame([("The U.S.A., e-mail C3PO Spark. spark,  Ünïcode",), (" ",), (None,)], "t string")
    got = [x.w for x in df.select(text.words("t").alias("w")).collect()]
    assert got == [["usa", "spark", "spark"], [], None]
    assert len(text.STOP_WORDS) == 127


def test_html(spark):
    page = '<title>One</title><script>var a = "<p>no</p>"</script><p>t<b>w</b>o<br>three<!-- no --></p><A class=x HREF="/l">l</A> <a href="/m">m</a>'
    row = spark.createDataFrame([(page,)], "h string").select(text.words(text.html_text("h")).alias("w"), text.html_links("h").alias("l")).first()
    assert row.w == ["one", "two", "three", "l", "m"] and row.l == ["/l", "/m"]


def test_robots(spark):
    policy = "User-agent: *\nDisallow: /a\n\nUser-agent: quillbot\nDisallow: /b # x\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /c"
    assert robots.parse_robots(policy) == (2, ["/a", "/b"])
    assert robots.parse_robots("User-Agent: other\r\nDisallow: /\r\n\r\n") == (0, [])
    with pytest.raises(ValueError):
        robots.parse_robots("User-agent: *\nCrawl-delay: soon")
    pages = spark.createDataFrame([("http://h:80/a/x",), ("http://h:80/d",), ("http://bad:80/d",), ("http://free:80/a",)], "url string")
    rules = spark.createDataFrame([("h", policy), ("bad", "User-agent: *\n: x"), ("free", None)], "host string, text string")
    assert sorted(x.url for x in crawl.robots_filter(pages, rules).collect()) == ["http://free:80/a", "http://h:80/d"]


def test_scores(spark):
    hits = spark.createDataFrame([("spark", "u1")] * 3 + [("spark", "u2"), ("graph", "u1")], "word string, url string")
    tf = scoring.term_frequency(hits)
    assert {(x.word, x.url): round(x.tf, 9) for x in tf.collect()} == {("spark", "u1"): 1.386294361, ("spark", "u2"): 0.693147181, ("graph", "u1"): 0.693147181}
    df = scoring.document_frequency(tf)
    assert {x.word: round(x.idf, 9) for x in scoring.inverse_document_frequency(df).collect()} == {"spark": 7.419180723, "graph": 7.824445931}
    assert {x.word: round(x.idf, 9) for x in scoring.inverse_document_frequency(df, variant="plus_one").collect()} == {"spark": 8.418580903, "graph": 8.824046011}


def test_page_rank(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("c", "a")], "src string, dst string")
    want = {"a": 0.993573333, "b": 0.540856296, "c": 0.941674074, "d": 0.540856296}
    assert {x.url: round(x.rank, 9) for x in graph.page_rank(links).collect()} == want
    no_sinks = graph.page_rank(links.where("dst <> 'd'")).agg(F.sum("rank")).first()[0]
    assert no_sinks > 0
    assert graph.page_rank(links.limit(0)).count() == 0
    assert graph.graph_counts(links.limit(0)).first().asDict() == {"urls": 0, "froms": 0, "tos": 0, "sinks": 0}


def test_edges_of_lines(spark):
    lines = spark.createDataFrame([("a b",), ("a b",), ("a b c",)], "value string")
    assert sorted(map(tuple, graph.edges_of_lines(lines).collect())) == [("a", "b"), ("a", "b")]


def _small(spark):
    pages = [(f"http://h/{i}", f'<p>spark graph{"s" * (i % 2)}</p><a href="/{(i + 1) % 4}">x</a>') for i in range(4)]
    return pipeline.index_of_pages(spark.createDataFrame(pages, "url string, html string"), n=None)


def test_index_and_search(spark, tmp_path):
    made = _small(spark)
    index.save(made, str(tmp_path / "i"))
    kept = index.load(spark, str(tmp_path / "i"))
    assert {x.name: x.rows for x in index.stats(kept).collect()} == {"hits": 12, "tfs": 12, "idfs": 4, "prs": 4}
    found = search.search(kept, "spark graph").collect()
    assert found == search.search(kept, "spark").collect() and len(found) == 4
    assert [x.score for x in found] == sorted((x.score for x in found), reverse=True)
    assert search.search(kept, "Spark").count() == 0 == search.search(kept, " spark").count() == search.search(kept, "  ").count()
    assert search.search(kept, "spark", limit=2).count() == 2
    assert "http://h:80/0" in search.html_results(search.search(kept, "spark"))
    lonely = kept._replace(rank=kept.rank.where("url <> 'http://h:80/1'"))
    assert search.search(lonely, "spark").count() == 3
    with pytest.raises(ValueError):
        search.search(lonely, "spark", strict=True)
    with pytest.raises(ValueError):
        index.check_unique(kept.rank.unionByName(kept.rank), ["url"])
    assert index.lookup_idf(kept, "graph").count() == 1 and index.hits_of(kept, "graphs").count() == 2


def test_crawl(spark):
    pages = [("http://h/a", '<a href="/b">b</a>'), ("http://h/b", '<a href="/c">c</a><a href="mailto:x">m</a>'), ("http://h/d", "never"), ("http://h/c", "x" * 2000)]
    df = spark.createDataFrame(pages, "url string, html string")
    reached, seen = crawl.crawl(df, spark.createDataFrame([("http://h/a",), ("no",)], "url string"), max_mb=0.001)
    assert sorted(x.url for x in reached.collect()) == ["http://h:80/a", "http://h:80/b"]
    assert {x.url: x.round for x in seen.collect()} == {"http://h:80/a": 0, "http://h:80/b": 1, "http://h:80/c": 2}
    assert crawl.crawl_stats(reached, seen).first().asDict() == {"documents": 2, "urls": 3, "hosts": 1}
    twice = spark.createDataFrame([("u2", "same"), ("u1", "same"), ("u3", None)], "url string, html string")
    assert sorted(x.url for x in crawl.content_dedupe(twice).collect()) == ["u1", "u3"]
    log = spark.createDataFrame([(200, None, "text/html; x"), (301, 200, "text/html"), (302, 404, "text/html"), (404, None, "image/png")], "status int, status_after int, content_type string")
    assert crawl.status_filter(log).count() == 2 and crawl.type_filter(log).count() == 3


def test_jobs_agree_with_native(spark):
    lines = spark.createDataFrame([(f"w{i % 3} u{i % 5}",) for i in range(40)], "value string")
    counts = {x.key: x["count"] for x in scoring.word_count(lines).collect()}
    assert {x.key: int(x.value) for x in jobs.run_named("WordCount", jobs.of_lines(lines)).collect()} == counts
    tf = {x.key: float(x.value) for x in jobs.run_named("TermFrequency", jobs.of_lines(lines)).collect()}
    assert tf == {k: math.log(1 + n) for k, n in counts.items()}
    longest = jobs.Job(lambda k, v: ((w, v) for w in v.split()), lambda k, values: [(k, max(values))])
    assert jobs.run_job(longest, jobs.of_lines(lines)).count() == 8


def test_codecs(spark):
    row = spark.createDataFrame([("ü?>" * 40,)], "x string").select(codecs.base64url("x").alias("b"), codecs.from_base64url(codecs.base64url("x")).alias("d"), codecs.md5_upper(F.lit("")).alias("m")).first()
    import base64

    assert row.b == base64.urlsafe_b64encode(("ü?>" * 40).encode()).decode() and row.d == "ü?>" * 40 and row.m == "D41D8CD98F00B204E9800998ECF8427E"
    dates = spark.createDataFrame([("Sun, 06 Nov 1994 08:49:37 GMT",), ("x",)], "d string").select(F.unix_timestamp(codecs.http_date("d")).alias("t")).collect()
    assert [x.t for x in dates] == [784111777, None]
    assert spark.range(1).select(codecs.display_date(F.lit(784111777)).alias("d")).first().d == "1994-11-06T03:49:37"
    specs = {'/a/b-1[text() = "x y"]': True, '/a[contains(text(), "+")]': True, "a/b": False, "/a[text()=x]": False}
    got = spark.createDataFrame([(s,) for s in specs], "s string").select("s", codecs.xpath_valid("s").alias("v")).collect()
    assert {x.s: x.v for x in got} == specs


def test_text_relations(spark, tmp_path):
    rows = spark.createDataFrame([("w", "u", 0.5), ("v", "u", 1.5)], "word string, url string, tf double")
    textio.write_relation(rows, "tfs", str(tmp_path / "tfs"), single=True)
    assert sorted(map(tuple, textio.read_relation(spark, "tfs", str(tmp_path / "tfs")).collect())) == [("v", "u", 1.5), ("w", "u", 0.5)]
    (tmp_path / "seed").write_text("http://a\nnope\nhttp://a/\n")
    assert [x.url for x in textio.read_seeds(spark, str(tmp_path / "seed")).collect()] == ["http://a:80/"]
    (tmp_path / "stop").write_text("a\n\nthe\n")
    assert textio.read_stop_words(spark, str(tmp_path / "stop")) == ["a", "the"]


def test_repository(spark):
    new = spark.createDataFrame([("u", "c"), ("u", "c"), ("v", "c")], "url string, channel string")
    known = new.where("url = 'u'")
    assert [tuple(x) for x in repository.new_matches(new, known).collect()] == [("v", "c")]
    docs = spark.createDataFrame([("http://u:80/", "x")], "url string, raw string")
    assert repository.lookup_page(docs, "http://u").first().raw == "x"


def test_stream(spark, tmp_path):
    from quillweave.streaming.hits import count_hits, write_counts

    pages = spark.createDataFrame([("http://h/a", "<p>spark spark</p>"), ("no", "<p>lost</p>")], "url string, html string")
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    q = write_counts(count_hits(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()] == [("spark", "http://h:80/a", 2)]


def test_crawl_goes_on_until_the_frontier_is_empty(spark):
    rows = [(f"http://h/{i}", f'<a href="/{i + 1}">x</a>{i}') for i in range(11)]
    reached, seen = crawl.crawl(spark.createDataFrame(rows, "url string, html string"), spark.createDataFrame([("http://h/0",)], "url string"))
    assert reached.count() == 11 and seen.agg({"round": "max"}).first()[0] == 11


def test_text_as_a_parser_gives_it(spark):
    cases = {
        "<p>caf&eacute; r&amp;d &#97;bc &amp;lt; x</p>": "café r&d abc &lt; x",
        "foo&nbsp;bar": "foo bar",
        "<td>one</td><td>two</td><b>th</b>ree<time>s</time>": "one two threes",
        "a<!-- hidden <p>x -->b<SCRIPT>if (a < b) c()</SCRIPT >c<style>p{}</style>d": "a b c d",
        "<a title='x > y' href=/z>text</a> 1 < 2": "text 1 < 2",
        "end <!-- never closed <p>x": "end",
        "end <script>never closed": "end",
        "&copy; &middot; &quot;q&quot; &lt;b&gt; &bogus; R&D": '© · "q" <b> &bogus; R&D',
        "cut <a class=\"x\" hre": "cut",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", text.html_text("h").alias("t")).collect()
    assert {x.h: " ".join(x.t.split()) for x in rows} == cases


def test_links_as_a_parser_gives_them(spark):
    page = """<a href="/a">1</a><A class=x HREF='/b?x=1&amp;y=2'>2</A><a href=/c>3</a><a  title="a > b" href = "/d">4</a>
      <!-- <a href="/no">x</a> --><script>s = '<a href="/no">'</script><a data-href="/no">x</a><abbr href="/no">x</abbr>
      <a name=x>5</a><a title='href="/no"' href="e.html">6</a><a\nhref="../f">7</a><a href="it's">8</a><a href="">9</a>"""
    pages = spark.createDataFrame([("http://h:80/x/y", page)], "url string, html string")
    hrefs = pages.select(text.html_links("html").alias("l")).first().l
    assert hrefs == ["/a", "/b?x=1&amp;y=2", "/c", "/d", "e.html", "../f", "it's", ""]
    assert [x.dst.removeprefix("http://h:80") for x in crawl.links(pages).collect()] == ["/a", "/b", "/c", "/d", "/x/e.html", "/f", "/x/it's", "/x/y"]


def test_words_are_cleaned_whole(spark):
    line = " The U.S. cat, CAT,dog x-ray 9th Ké ... , end.  a\tfoo\x0bbar"
    found = spark.createDataFrame([(line,)], "t string").select(text.words("t").alias("w")).first().w
    each = [re.sub("[,.]", "", x).lower() for x in re.split(r"[ \t\n\x0b\f\r]+", line)]
    assert found == [x for x in each if re.fullmatch("[a-z]+", x) and x not in text.STOP_WORDS] == ["us", "cat", "catdog", "foo", "bar"]


def test_lines_that_are_no_hits(spark):
    lines = spark.createDataFrame([("a u",), ("a u",), ("alone",), ("",), (None,)], "value string")
    assert {x.key: float(x.value) for x in jobs.run_named("TermFrequency", jobs.of_lines(lines)).collect()} == {"a u": math.log(3)}
    assert {x.key for x in jobs.run_named("InverseDocumentFrequency", jobs.of_lines(lines)).collect()} == {"a", "alone"}


def test_compact_paths(spark):
    specs = {'/a [text() = "x + y"]': '/a[text()="x + y"]', "": "", ' a+"b c"+"d ': ' a+"bc"+"d', '" x" y "z ': '"x" y "z', '"': '"'}
    got = spark.createDataFrame([(x,) for x in specs], "s string").select("s", codecs.xpath_compact("s").alias("c")).collect()
    assert {x.s: x.c for x in got} == specs


def test_pages_are_read_once(spark):
    """Text and links come from one node of Python; odd tags are taken as a parser takes them."""
    long = "x" * 200_000
    rows = [
        ("http://h/a/b", f'<a href="data:{long}">d</a><p title="<b>no</b>">t</p>&lt;<a href=" c?x=1&amp;y ">c</a><a name=q>n</a>'),
        ("http://h/q", 'a<p title="never closed>b <i>c</i>'),
        ("http://h/e", ""),
        ("http://h/n", None),
        (None, '<a href="/x">1</a><a href="http://z/">2</a>'),
        ("http://h/f", "<b" * 3000 + "</script x><script-x>gone</script>end<!>. <!-- x --!> y -->z"),
    ]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {x.url: x for x in parsed(pages).collect()}
    assert got["http://h/a/b"].text.split() == ["d", "t", "<cn"] and got["http://h/a/b"].links == [f"data:{long}", "http://h/a/c?x=1&y"]
    assert got["http://h/q"].text == 'a<p title="never closed>b c' and got["http://h/e"].text == "" and got["http://h/n"].text is None is got["http://h/n"].links
    assert got[None].links == [None, "http://z/"] and got["http://h/f"].text.split()[-1] == "z"
    for df in (crawl.hits(pages), crawl.links(pages), crawl.word_pages(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"MapInArrow|ArrowEvalPython", plan)) == 1
    found = parsed(pages)
    assert sorted(crawl.links(found, found="links").collect(), key=repr) == sorted(crawl.links(pages).collect(), key=repr)
    assert sorted(crawl.hits(found, text="text").collect(), key=repr) == sorted(crawl.hits(pages).collect(), key=repr)


def test_workers_take_batches_of_bounded_bytes(spark):
    from quillweave.functions.html import parsed
    from quillweave.tables import BATCH, setting

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, taken in (("64m", str(BATCH)), ("1gb", str(BATCH)), ("5000000b", str(BATCH)), ("2m", "2m"), ("1000", "1000")):
        with setting(spark, name, given):
            parsed(spark.createDataFrame([("u", "<p>x</p>")], "url string, html string"))
            assert spark.conf.get(name) == taken


def test_tfidf_takes_words_once(spark):
    from quillweave.queries import QUERIES

    plan = QUERIES["tfidf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("FileScan") == 2
