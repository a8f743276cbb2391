"""The engine's queries over the driver's tables, each with DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import codecs, html, text, urls
from .functions.robots import AGENT
from .operators import crawl, fetching, frontier, graph, index, jobs, repository, scoring, search, segments
from .plans import pipeline
from .sources import relation, textio
from .streaming import hits as stream
from .tables import stored, workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Terms that the search queries look for.
TERM, RARE_QUERY, NO_MATCH = "en", "thre  and more", "En"
ROBOTS = f"User-agent: *\nDisallow: /fr\nCrawl-delay: 1\n\nUser-agent: {AGENT}\nDisallow: /de # nothing\nDisallow:\n\nUser-agent: *\nDisallow: /en"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")


def _kept(spark, d):
    return crawl.content_dedupe(crawl.normalized(_pages(spark, d)))


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("url"), "text")


def _supply_links(spark, d):
    """A graph with cycles: suppliers to parts, and back where an even part was returned."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_returnflag")
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    back = rows.where((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 2 == 0))
    return rows.select(s.alias("src"), p.alias("dst")).unionByName(back.select(p.alias("src"), s.alias("dst")))


def _page_links(spark, d):
    return crawl.links(_kept(spark, d))


# SQL of the same sources.
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_CUT = "CASE WHEN strpos(url, '?') > 1 THEN substr(url, 1, strpos(url, '?') - 1) ELSE url END"
NORMAL = f"""
  n0 AS (SELECT *, {_CUT} AS cut FROM raw_urls),
  n1 AS (SELECT *, CASE WHEN starts_with(cut, 'https://') THEN 'https' WHEN starts_with(cut, 'http://') THEN 'http' END AS scheme FROM n0),
  n2 AS (SELECT *, substr(cut, length(scheme) + 4) AS rest FROM n1 WHERE scheme IS NOT NULL),
  n3 AS (SELECT *, CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END AS address,
                CASE WHEN strpos(rest, '/') > 0 THEN split_part(substr(rest, strpos(rest, '/')), '#', 1) ELSE '/' END AS path FROM n2),
  n4 AS (SELECT *, CASE WHEN strpos(address, ':') > 0 THEN lower(substr(address, 1, strpos(address, ':') - 1)) ELSE address END AS host,
                CASE WHEN strpos(address, ':') > 0 THEN try_cast(substr(address, strpos(address, ':') + 1) AS INTEGER)
                     WHEN scheme = 'https' THEN 443 ELSE 80 END AS port FROM n3 WHERE trim(address) <> ''),
  normal AS (SELECT * EXCLUDE (cut, rest, address), scheme || '://' || host || ':' || port || path AS normal_url FROM n4 WHERE port IS NOT NULL)"""
KEPT = f"""raw_urls AS (SELECT page_id, url, html FROM pages), {NORMAL},
  kept AS (SELECT min(normal_url) AS url, html FROM normal GROUP BY html)"""


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# The pages' text and links by expressions of their own: what isn't text, tags of blocks, other tags, hrefs, references.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*(?:>|\z)"""
_BLOCK_TAG = rf"(?i)</?(?:{'|'.join(sorted(html.BLOCKS))})(?:[\s/]{_REST}|>|\z)"
_TAG = rf"(?i)</?[a-z]{_REST}|<[!?][^>]*(?:>|\z)"
_LINK = r"""(?i)<a(?:\s(?:[^>"']|"[^"]*"|'[^']*')*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_QUOTED = r"""^(?:"([^"]*)"|'([^']*)')\z"""
_COMMON = {"quot": '"', "lt": "<", "gt": ">", "nbsp": "\u00a0", "copy": "©", "middot": "·", "amp": "&"}


def _decoded(x: str) -> str:
    """The references that the pages hold."""
    for name, char in _COMMON.items():
        x = f"replace({x}, '&{name};', {_lit(char)})" if name != "amp" else f"regexp_replace({x}, '&amp;?', '&', 'g')"
    return x


_SHOWN = f"regexp_replace(html, {_lit(_HIDDEN)}, ' ', 'g')"
_TEXT = f"replace({_decoded(f"regexp_replace(regexp_replace({_SHOWN}, {_lit(_BLOCK_TAG)}, ' ', 'g'), {_lit(_TAG)}, '', 'g')")}, chr(160), ' ')"


def _hits_sql(rows: str) -> str:
    return f"""hits AS (SELECT word, url FROM (SELECT url, lower(regexp_replace(unnest(string_split_regex(body, '\\s+')), '[,.]', '', 'g')) AS word FROM ({rows}))
    WHERE regexp_matches(word, '^[a-z]+$') AND word NOT IN ({_STOP}))"""


HITS = f"{KEPT}, {_hits_sql(f'SELECT url, {_TEXT} AS body FROM kept')}"
DOC_HITS = _hits_sql("SELECT doc_id::VARCHAR AS url, text AS body FROM documents")
TF = f"{HITS}, tf AS (SELECT word, url, ln(1 + count(*)) AS tf FROM hits GROUP BY word, url), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)"
DOC_TF = f"{DOC_HITS}, tf AS (SELECT word, url, ln(1 + count(*)) AS tf FROM hits GROUP BY word, url), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)"
_HREF = _decoded(f"regexp_replace(quoted, {_lit(_QUOTED)}, '\\1\\2')")
# Hrefs relative to a page's folder have no form here: the pages have none.
LINKS = f"""{KEPT}, quotes AS (SELECT url AS src, unnest(regexp_extract_all({_SHOWN}, {_lit(_LINK)}, 1)) AS quoted FROM kept),
  found AS (SELECT src, {_HREF} AS href FROM quotes),
  absolute AS (SELECT src, CASE WHEN regexp_matches(trim(href), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN trim(href)
    WHEN starts_with(trim(href), '//') THEN regexp_extract(src, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || trim(href)
    WHEN starts_with(trim(href), '/') THEN regexp_extract(src, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || trim(href) END AS url FROM found),
  {NORMAL.replace("raw_urls", "absolute").replace("n0", "m0").replace("n1", "m1").replace("n2", "m2").replace("n3", "m3").replace("n4", "m4").replace("normal AS", "targets AS")},
  links AS (SELECT src, normal_url AS dst FROM targets)"""
SUPPLY = """links AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 2 = 0)"""
GRAPH = "edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM links), vertices AS MATERIALIZED (SELECT src AS url FROM edges UNION SELECT dst FROM edges), sinks AS MATERIALIZED (SELECT url FROM vertices WHERE url NOT IN (SELECT src FROM edges))"


def _rank_sql(iterations: int = 5) -> str:
    out = "deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM edges GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM vertices), r0 AS MATERIALIZED (SELECT url, 1.0::DOUBLE / n AS rank FROM vertices, n)"
    for i in range(iterations):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT v.url, 1 - 0.8::DOUBLE + 0.8::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE url IN (SELECT url FROM sinks)) / n + 0.8::DOUBLE * coalesce(i.into_, 0) AS rank
      FROM vertices v CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank / degree) AS into_ FROM edges e JOIN deg USING (src) JOIN r{i} r ON r.url = e.src GROUP BY dst) i ON i.dst = v.url)"""
    return out + f", ranks AS (SELECT url, rank FROM r{iterations})"


PAGE_RANKS = f"{LINKS}, {GRAPH}, {_rank_sql()}"
#: tf and ranks in one statement.
PAGE_INDEX = PAGE_RANKS + ", " + TF.split("kept AS (SELECT min(normal_url) AS url, html FROM normal GROUP BY html), ", 1)[1]


@query("SELECT text AS key, count(*) AS count FROM documents GROUP BY text")
def word_count(spark, d):
    """Counts of equal lines, a document's text being the line."""
    return scoring.word_count(_documents(spark, d), "text")


@query(f"WITH {HITS} SELECT word, url FROM hits")
def hits_pages(spark, d):
    return crawl.hits(_kept(spark, d))


@query(f"WITH {DOC_HITS} SELECT word, url FROM hits")
def hits_documents(spark, d):
    return crawl.hits(_documents(spark, d), text="text")


@query(f"WITH {TF} SELECT word, url, round(tf, 9) AS tf FROM tf")
def tf(spark, d):
    return scoring.term_frequency(crawl.hits(_kept(spark, d))).withColumn("tf", F.round("tf", 9))


def _doc_df(spark, d):
    return scoring.document_frequency(crawl.word_pages(_documents(spark, d), text="text"))


@query(f"WITH {DOC_TF} SELECT word, df FROM df")
def df(spark, d):
    return _doc_df(spark, d)


@query(f"WITH {DOC_TF} SELECT word, round(ln(5000::DOUBLE / (1 + df) + 1), 9) AS idf FROM df")
def idf_smooth_inside(spark, d):
    return scoring.inverse_document_frequency(_doc_df(spark, d)).withColumn("idf", F.round("idf", 9))


@query(f"WITH {DOC_TF} SELECT word, round(ln(5000::DOUBLE / (1 + df)) + 1, 9) AS idf FROM df")
def idf_plus_one(spark, d):
    return scoring.inverse_document_frequency(_doc_df(spark, d), variant="plus_one").withColumn("idf", F.round("idf", 9))


@query(f"WITH {DOC_TF} SELECT word, url, round(tf * ln(5000::DOUBLE / (1 + df) + 1), 6) AS tfidf FROM tf JOIN df USING (word)")
def tfidf(spark, d):
    # Used twice: words are taken from the texts once.
    t = stored(scoring.term_frequency(crawl.hits(_documents(spark, d), text="text")), f"{workspace(spark, 'frequencies')}/tf")
    return scoring.tfidf(t, scoring.inverse_document_frequency(scoring.document_frequency(t))).withColumn("tfidf", F.round("tfidf", 6))


@query(f"WITH {LINKS} SELECT src, dst FROM links")
def links_all(spark, d):
    return _page_links(spark, d)


@query(f"WITH {LINKS} SELECT DISTINCT src, dst FROM links")
def links_distinct(spark, d):
    return graph.distinct_edges(_page_links(spark, d))


def _graph_query(name: str, sql: str, make):
    def run(spark, d):
        return make(graph.distinct_edges(_supply_links(spark, d)))

    run.__name__ = name
    query(f"WITH {SUPPLY}, {GRAPH} {sql}")(run)


_graph_query("vertices", "SELECT url FROM vertices", graph.vertices)
_graph_query("sinks", "SELECT url FROM sinks", graph.sinks)
_graph_query("sources", "SELECT DISTINCT src AS url FROM edges", graph.sources)
_graph_query("targets", "SELECT DISTINCT dst AS url FROM edges", graph.targets)
_graph_query("graph_counts", "SELECT (SELECT count(*) FROM vertices) AS urls, (SELECT count(DISTINCT src) FROM edges) AS froms, (SELECT count(DISTINCT dst) FROM edges) AS tos, (SELECT count(*) FROM sinks) AS sinks", graph.graph_counts)
_graph_query("out_degree", "SELECT src AS url, count(*) AS degree FROM edges GROUP BY src", graph.out_degree)
_graph_query("in_degree", "SELECT dst AS url, count(*) AS degree FROM edges GROUP BY dst", graph.in_degree)
_graph_query("adjacency_out", "SELECT src AS url, string_agg(dst, ' ' ORDER BY dst) AS neighbours FROM edges GROUP BY src", lambda e: graph.adjacency(e).withColumn("neighbours", F.concat_ws(" ", "neighbours")))
_graph_query("adjacency_in", "SELECT dst AS url, string_agg(src, ' ' ORDER BY src) AS neighbours FROM edges GROUP BY dst", lambda e: graph.adjacency(e, True).withColumn("neighbours", F.concat_ws(" ", "neighbours")))


@query(f"WITH {PAGE_RANKS} SELECT url, round(rank, 6) AS rank FROM ranks")
def pagerank_pages(spark, d):
    return graph.page_rank(_page_links(spark, d)).withColumn("rank", F.round("rank", 6))


@query(f"WITH {SUPPLY}, {GRAPH}, {_rank_sql()} SELECT url, round(rank, 6) AS rank FROM ranks")
def pagerank_supply_graph(spark, d):
    return graph.page_rank(_supply_links(spark, d)).withColumn("rank", F.round("rank", 6))


def _found_sql(word: str, top: bool = False) -> str:
    hit = f"SELECT * FROM tf WHERE word = '{word}'" + ("" if top else " ORDER BY url LIMIT 100")
    score = "SELECT round(tf * ln(5000::DOUBLE / (1 + df) + 1) * rank, 6) AS score, h.url FROM h JOIN df USING (word) JOIN ranks USING (url)"
    return f"WITH {PAGE_INDEX}, h AS ({hit}) {score}" + (" ORDER BY tf * ln(5000::DOUBLE / (1 + df) + 1) * rank DESC, url LIMIT 100" if top else "")


_STORED: dict[tuple[str, str], str] = {}


def _index(spark, d):
    """The stored index of a folder's pages, built and saved when a session first asks for it."""
    key = spark.sparkContext.applicationId, d
    if key not in _STORED:
        path = f"{workspace(spark, 'saved')}/index"
        index.save(pipeline.index_of_pages(_pages(spark, d)), path, check=False)  # its tables are grouped by their keys
        _STORED[key] = path
    return index.load(spark, _STORED[key])


def _search(spark, d, text_: str, **how):
    return search.search(_index(spark, d), text_, **how).withColumn("score", F.round("score", 6))


@query(_found_sql(TERM))
def search_single_term(spark, d):
    return _search(spark, d, TERM)


@query(_found_sql("thre"))
def search_first_token(spark, d):
    """Only the first token counts."""
    return _search(spark, d, RARE_QUERY)


@query(_found_sql(TERM, top=True))
def search_topk(spark, d):
    return _search(spark, d, TERM, top_k=True)


@query(_found_sql(NO_MATCH))
def search_no_match(spark, d):
    """Terms aren't put in lower case, indexed words are."""
    return _search(spark, d, NO_MATCH)


@query(f"WITH {TF} SELECT word, url FROM tf")
def inverted_index_dump(spark, d):
    return index.dump(_index(spark, d))


@query(f"WITH {TF} SELECT word, url, round(tf, 9) AS tf FROM tf WHERE word = '{TERM}' AND url = (SELECT min(url) FROM tf WHERE word = '{TERM}')")
def lookup_tf(spark, d):
    i = _index(spark, d)
    first = i.tf.where(F.col("word") == TERM).agg(F.min("url")).first()[0]
    return index.lookup_tf(i, TERM, first or "").withColumn("tf", F.round("tf", 9))


@query(f"WITH {TF} SELECT word, round(ln(5000::DOUBLE / (1 + df) + 1), 9) AS idf FROM df WHERE word = '{TERM}'")
def lookup_idf(spark, d):
    return index.lookup_idf(_index(spark, d), TERM).withColumn("idf", F.round("idf", 9))


@query(f"WITH {PAGE_RANKS} SELECT url, round(rank, 6) AS rank FROM ranks WHERE url = (SELECT min(url) FROM ranks)")
def lookup_pagerank(spark, d):
    i = _index(spark, d)
    first = i.rank.agg(F.min("url")).first()[0]
    return index.lookup_rank(i, first or "").withColumn("rank", F.round("rank", 6))


@query(f"WITH {KEPT} SELECT url, html FROM kept WHERE url = (SELECT min(url) FROM kept)")
def lookup_page(spark, d):
    pages = _kept(spark, d)
    first = pages.agg(F.min("url")).first()[0]
    return repository.lookup_page(pages, first or "").select("url", "html")


@query(f"WITH raw_urls AS (SELECT page_id, url, html FROM pages), {NORMAL} SELECT page_id, scheme, host, port, path, normal_url FROM normal")
def url_normalize(spark, d):
    p = urls.url_parts("url")
    out = _pages(spark, d).select("page_id", p["scheme"].alias("scheme"), p["host"].alias("host"), p["port"].alias("port"), p["path"].alias("path"), urls.normalize_url("url").alias("normal_url"))
    return out.where("normal_url is not null")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def content_dedupe(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return crawl.content_dedupe(docs, "text", "doc_id").select("doc_id")


@query("SELECT page_id FROM pages WHERE octet_length(encode(html)) <= 5242")
def page_size_filter(spark, d):
    return crawl.size_filter(_pages(spark, d), 0.005).select("page_id")


@query(f"WITH raw_urls AS (SELECT page_id, url, html FROM pages), {NORMAL} SELECT page_id FROM normal WHERE NOT starts_with(path, '/fr') AND NOT starts_with(path, '/de')")
def robots_filter(spark, d):
    """Every host has the same policy: the record of all agents, then that of ours, which ends the reading."""
    pages = _pages(spark, d)
    hosts = pages.select(urls.url_host("url").alias("host")).where("host is not null").distinct().withColumn("text", F.lit(ROBOTS))
    return crawl.robots_filter(crawl.normalized(pages), hosts).select("page_id")


@query(f"WITH {LINKS}, {NORMAL.replace('raw_urls', 'dsts').replace('n0', 'k0').replace('n1', 'k1').replace('n2', 'k2').replace('n3', 'k3').replace('n4', 'k4').replace('normal AS', 'ends AS').replace('k0 AS', 'dsts AS (SELECT DISTINCT dst AS url FROM links), k0 AS')} SELECT host, count(*) AS urls FROM ends GROUP BY host")
def frontier_hosts(spark, d):
    return crawl.frontier_hosts(crawl.url_dedupe(_page_links(spark, d).select(F.col("dst").alias("url"))))


@query(f"WITH {LINKS}, seeds AS (SELECT DISTINCT normal_url AS url FROM normal) SELECT url, 0 AS round FROM seeds UNION ALL SELECT DISTINCT dst, 1 FROM links WHERE dst NOT IN (SELECT url FROM seeds)")
def crawl_frontier(spark, d):
    """All pages are seeds; what they link to and isn't a page is seen in the next round, where the crawl ends."""
    pages = _pages(spark, d)
    return crawl.crawl(pages, pages.select("url"))[1]


@query("SELECT doc_id, upper(md5(text)) AS digest FROM documents")
def md5_upper(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", codecs.md5_upper("text").alias("digest"))


@query("SELECT doc_id, upper(sha256(text)) AS digest FROM documents")
def sha256_upper(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", codecs.sha256_upper("text").alias("digest"))


@query("SELECT page_id, replace(replace(base64(encode(url)), '+', '-'), '/', '_') AS code, url AS decoded FROM pages")
def base64url(spark, d):
    code = codecs.base64url("url")
    return _pages(spark, d).select("page_id", code.alias("code"), codecs.from_base64url(code).alias("decoded"))


@query("SELECT source, regexp_matches(source, '^[_.a-zA-Z0-9-]+$') AS valid FROM (SELECT DISTINCT source FROM documents UNION SELECT DISTINCT lang || ' ' || source FROM documents)")
def channel_name_valid(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.select("source").union(docs.select(F.concat("lang", F.lit(" "), "source").alias("source"))).distinct()
    return names.select("source", codecs.channel_name_valid("source").alias("valid"))


_SPEC = """CASE p_partkey % 4 WHEN 0 THEN '/a/' || b || '[text() = "x +y"]' WHEN 1 THEN ' /a /' || b || '[contains(text(), "x")]' WHEN 2 THEN 'a//' || b ELSE '/a/' || b || '["x' END"""


@query(rf"""WITH specs AS (SELECT p_partkey, regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g') AS b, {_SPEC} AS spec FROM part),
  parts AS (SELECT *, string_split(spec, '"') AS p FROM specs),
  plain AS (SELECT *, array_to_string([CASE WHEN (len(p) - i) % 2 = 0 THEN regexp_replace(x, '[\s+]', '', 'g') ELSE x END FOR x, i IN p], '"') AS compact FROM parts)
  SELECT p_partkey, spec, compact, regexp_matches(compact, {_lit(codecs.XPATH)}) AS valid FROM plain""")
def xpath_valid(spark, d):
    """Path specifications made of part names."""
    names = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.regexp_replace("p_brand", r"[^a-zA-Z0-9]", "").alias("b"))
    return names.selectExpr("p_partkey", f"{_SPEC} AS spec").select("p_partkey", "spec", codecs.xpath_compact("spec").alias("compact"), codecs.xpath_valid("spec").alias("valid"))


@query("SELECT text AS key, count(*)::VARCHAR AS value FROM documents GROUP BY text")
def map_reduce_generic(spark, d):
    """The word count job through the generic engine."""
    return jobs.run_named("WordCount", jobs.of_lines(_documents(spark, d), "text"))


@query("SELECT 'w' || l_suppkey AS word, round(ln(1000000::DOUBLE / (1 + count(*))) + 1, 9) AS idf FROM lineitem GROUP BY l_suppkey")
def map_reduce_idf(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("w"), "l_suppkey", F.lit(" u"), "l_orderkey").alias("value"))
    out = jobs.run_named("InverseDocumentFrequency", jobs.of_lines(lines), n=1_000_000)
    return out.select(F.col("key").alias("word"), F.round(F.col("value").cast("double"), 9).alias("idf"))


@query("SELECT 'w' || l_suppkey || ' u' || l_partkey AS pair, round(ln(1 + count(*)), 9) AS tf FROM lineitem GROUP BY l_suppkey, l_partkey")
def map_reduce_tf(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("w"), "l_suppkey", F.lit(" u"), "l_partkey").alias("value"))
    out = jobs.run_named("TermFrequency", jobs.of_lines(lines))
    return out.select(F.col("key").alias("pair"), F.round(F.col("value").cast("double"), 9).alias("tf"))


@query(f"WITH {PAGE_INDEX} SELECT 'hits' AS name, count(*) AS rows FROM tf UNION ALL SELECT 'tfs', count(*) FROM tf UNION ALL SELECT 'idfs', count(*) FROM df UNION ALL SELECT 'prs', count(*) FROM ranks")
def index_stats(spark, d):
    return index.stats(_index(spark, d))


@query("SELECT 'u' || p_partkey AS username, p_partkey % 2 = 0 AS ok FROM part")
def credential_check(spark, d):
    """Passwords are brands; those of odd parts are given wrongly."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("u"), "p_partkey").alias("username"), "p_brand", "p_partkey")
    users = part.select("username", codecs.sha256_upper("p_brand").alias("password"))
    given = part.select("username", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit("?")).alias("password"))
    return repository.credentials(users, given)


# Files: each query writes a relation as text and reads it again.


def _round_trip(spark, rows: DataFrame, name: str, pattern: str = "") -> DataFrame:
    path = f"{workspace(spark, name)}/{name}"
    textio.write_relation(rows, name, path)
    return textio.read_relation(spark, name, path + pattern)


@query(f"WITH {DOC_HITS} SELECT word, url FROM hits")
def hits_files(spark, d):
    return _round_trip(spark, crawl.hits(_documents(spark, d), text="text"), "hits")


@query(f"WITH {LINKS} SELECT DISTINCT src, dst FROM links")
def links_files(spark, d):
    """Read by a pattern, as shards are."""
    return _round_trip(spark, graph.distinct_edges(_page_links(spark, d)), "links", "/part-*")


@query(f"WITH {TF} SELECT word, url, round(tf, 9) AS tf FROM tf")
def tfs_files(spark, d):
    return _round_trip(spark, _index(spark, d).tf, "tfs").withColumn("tf", F.round("tf", 9))


@query(f"WITH {TF} SELECT word, round(ln(5000::DOUBLE / (1 + df) + 1), 9) AS idf FROM df")
def idfs_files(spark, d):
    return _round_trip(spark, _index(spark, d).idf, "idfs").withColumn("idf", F.round("idf", 9))


@query(f"WITH {PAGE_RANKS} SELECT url, round(rank, 6) AS rank FROM ranks")
def prs_files(spark, d):
    return _round_trip(spark, _index(spark, d).rank, "prs").withColumn("rank", F.round("rank", 6))


@query("SELECT source || ' ' || lang AS value, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL")
def lines_files(spark, d):
    path = workspace(spark, "lines")
    docs = spark.read.parquet(f"{d}/documents.parquet").where("source is not null and lang is not null")
    docs.select(F.concat_ws(" ", "source", "lang").alias("value")).write.text(path)
    return textio.read_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query(f"WITH raw_urls AS (SELECT url FROM pages), {NORMAL} SELECT DISTINCT normal_url AS url FROM normal")
def seeds(spark, d):
    path = workspace(spark, "seeds")
    _pages(spark, d).select(F.col("url").alias("value")).where("value is not null").write.text(path)
    return textio.read_seeds(spark, path)


@query(f"""WITH found AS (SELECT lower(regexp_replace(unnest(string_split_regex(text, '\\s+')), '[,.]', '', 'g')) AS word FROM documents)
  SELECT word, count(*) AS n FROM found WHERE word IN ({_STOP}) GROUP BY word""")
def stop_words(spark, d):
    """How often the documents hold the words of a list that is read from a file."""
    path = workspace(spark, "stop-words")
    spark.createDataFrame([(x,) for x in text.STOP_WORDS], "value string").write.text(path)
    said = _documents(spark, d).select(F.explode(text.words("text", ())).alias("word"))
    return said.where(text.is_stop_word("word", textio.read_stop_words(spark, path))).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT n_name || ' ' || count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def job_output(spark, d):
    """A job's result as lines of key and value."""
    nations = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = workspace(spark, "job")
    textio.write_pairs(jobs.run_named("WordCount", jobs.of_lines(nations, "n_name")), path)
    return textio.read_lines(spark, path)


@query("SELECT least(10, count(*)) AS n FROM documents")
def output_sample(spark, d):
    return textio.preview(_documents(spark, d)).agg(F.count("*").alias("n"))


# The stored index and the repository.


@query(f"WITH {TF} SELECT url FROM tf WHERE word = '{TERM}'")
def hits_of_word(spark, d):
    return index.hits_of(_index(spark, d), TERM).select("url")


@query(f"WITH {TF} SELECT word, count(*) AS n FROM tf GROUP BY word")
def index_words(spark, d):
    return index.words(_index(spark, d)).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {KEPT} SELECT url, octet_length(encode(html)) AS bytes FROM kept")
def documents_dump(spark, d):
    return repository.dump(_kept(spark, d))


def _part_store(spark, d):
    """Parts as documents, brands as channels, each part matching its brand."""
    part = spark.read.parquet(f"{d}/part.parquet")
    url = F.concat(F.lit("http://parts:80/"), "p_partkey")
    return part.select(url.alias("url"), F.col("p_name").alias("html"), F.col("p_brand").alias("channel"))


@query("SELECT 'http://parts:80/' || p_partkey AS url, p_name AS html FROM part WHERE p_brand = 'Brand#13'")
def channel_documents(spark, d):
    rows = _part_store(spark, d)
    return repository.channel_documents(rows.select("url", "channel"), rows.select("url", "html"), "Brand#13").select("url", "html")


@query("SELECT p_brand AS channel FROM part WHERE p_partkey = 7")
def matched_channels(spark, d):
    rows = _part_store(spark, d)
    return repository.matched_channels(rows.select("channel").distinct(), rows.where("url = 'http://parts:80/7'"))


@query("SELECT p_brand AS channel, count(*) AS n FROM part WHERE p_brand = 'Brand#13' GROUP BY p_brand")
def channel_lookup(spark, d):
    return repository.channel(_part_store(spark, d), "Brand#13").groupBy("channel").agg(F.count("*").alias("n"))


@query("SELECT 'http://parts:80/' || p_partkey AS url, p_brand AS channel FROM part")
def repeated_matches(spark, d):
    """Put three times, the first time in part: each match is stored once."""
    path, rows = workspace(spark, "repository"), _part_store(spark, d).select("url", "channel")
    repository.put(rows.where(F.crc32("url") % 2 == 0), path, "matches")
    for _ in range(2):
        repository.put_matches(rows, path)
    return spark.read.parquet(f"{path}/matches").select("url", "channel")


def _users(spark, d):
    customer = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("u"), "c_custkey").alias("username"), F.col("c_name").alias("password"), "c_custkey")
    path = workspace(spark, "repository")
    repository.put(customer.drop("c_custkey"), path, "users")
    repository.put(customer.where("c_custkey % 2 = 0").select("username", F.lit("new").alias("password")), path, "users")
    return repository.load(spark, path, "users")


@query("SELECT 'u' || c_custkey AS username, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS password FROM customer")
def users_put(spark, d):
    """A later put of a user replaces an earlier one."""
    return _users(spark, d)


@query("SELECT 'u' || c_custkey AS username, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS password FROM customer WHERE c_custkey = 4")
def user_lookup(spark, d):
    return repository.user(_users(spark, d), "u4")


# Crawl control, dates, parts of urls and counters.


@query("SELECT o_orderkey FROM orders WHERE CASE o_orderkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE CASE WHEN o_orderkey % 2 = 0 THEN 200 ELSE 500 END END = 200")
def status_filter(spark, d):
    o = F.col("o_orderkey")
    status = F.when(o % 5 == 0, 200).when(o % 5 == 1, 404).otherwise(299 + o % 5)
    log = spark.read.parquet(f"{d}/orders.parquet").select(o, status.alias("status"), F.when(o % 2 == 0, 200).otherwise(500).alias("status_after"))
    return crawl.status_filter(log).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def type_filter(spark, d):
    o = F.col("o_orderkey")
    kind = F.when(o % 3 == 0, "text/html; charset=utf-8").when(o % 3 == 1, "application/pdf").otherwise("text/plain")
    return crawl.type_filter(spark.read.parquet(f"{d}/orders.parquet").select(o, kind.alias("content_type"))).select("o_orderkey")


@query("SELECT 'h' || o_custkey AS host, max(o_orderkey) + CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 7 ELSE 0 END AS next_seconds FROM orders GROUP BY o_custkey")
def next_fetch(spark, d):
    """Hosts of even customers have a crawl delay, the others no policy."""
    log = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("h"), "o_custkey").alias("host"), F.col("o_orderkey").alias("seconds"))
    rules = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0")
    rules = rules.select(F.concat(F.lit("h"), "c_custkey").alias("host"), F.concat(F.lit("User-agent: *\nCrawl-delay: "), F.col("c_custkey") % 7).alias("text"))
    return crawl.next_fetch(log, rules)


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def http_date(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.date_format(F.col("o_orderdate").cast("date"), "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT")).alias("said"))
    return orders.select("o_orderkey", F.unix_timestamp(codecs.http_date("said")).alias("seconds"))


@query("SELECT o_orderkey, strftime(make_timestamp((1700000000 + o_orderkey % 1000000 - 18000) * 1000000), '%Y-%m-%dT%I:%M:%S') AS shown FROM orders")
def display_date(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", codecs.display_date(F.lit(1700000000) + F.col("o_orderkey") % 1000000).alias("shown"))


@query(f"WITH raw_urls AS (SELECT page_id, url FROM pages), {NORMAL} SELECT page_id, 'https://' || host || ':443' || path AS url FROM normal")
def url_with_part(spark, d):
    pages = _pages(spark, d).select("page_id", urls.with_part("url", scheme=F.lit("https"), port=F.lit(443)).alias("url"))
    return pages.where("url is not null")


@query(f"WITH raw_urls AS (SELECT url FROM pages), {NORMAL} SELECT host, 1 AS shards, true AS in_range FROM normal GROUP BY host")
def host_shard(spark, d):
    """All urls of a host are in one shard of a hundred."""
    rows = _pages(spark, d).select(urls.url_host("url").alias("host")).where("host is not null").withColumn("shard", urls.host_shard("host"))
    return rows.groupBy("host").agg(F.count_distinct("shard").cast("int").alias("shards"), (F.min("shard").between(0, 99) & F.max("shard").between(0, 99)).alias("in_range"))


@query(f"WITH {HITS} SELECT (SELECT count(*) FROM kept) AS documents, (SELECT count(*) FROM hits) AS hits")
def crawl_counters(spark, d):
    """Documents and hits, counted as they pass."""
    pages, documents = crawl.counted(_kept(spark, d), "documents")
    found, n = crawl.counted(crawl.hits(pages), "hits")
    found.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(documents.get["count"], n.get["count"])], "documents long, hits long")


_RELATIVE = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'x.html' WHEN 1 THEN './y?q=1' WHEN 2 THEN '../z' ELSE '#top' END AS href,
  normal_url AS base FROM normal"""


@query(rf"""WITH raw_urls AS (SELECT page_id, url FROM pages), {NORMAL}, rel AS ({_RELATIVE}),
  cut AS (SELECT *, regexp_extract(base, '^(https?://[^/]*)', 1) AS origin, regexp_replace(regexp_extract(base, '^https?://[^/]*(/.*)', 1), '[^/]*\z', '') AS folder,  FROM rel)
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN origin || folder || 'x.html' WHEN 1 THEN origin || folder || 'y?q=1'
    WHEN 2 THEN origin || CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]*/\z', '') END || 'z' ELSE base || '#top' END AS url FROM cut""")
def relative_hrefs(spark, d):
    """Hrefs relative to a page's folder."""
    pages = _pages(spark, d).select("page_id", urls.normalize_url("url").alias("base")).where("base is not null")
    pages = pages.selectExpr("page_id", "base", "CASE page_id % 4 WHEN 0 THEN 'x.html' WHEN 1 THEN './y?q=1' WHEN 2 THEN '../z' ELSE '#top' END AS href")
    return pages.select("page_id", urls.resolve_any("base", "href").alias("url"))


# Puts to the stored index, fetch logs, schedules and crawls that stop and go on.


_PUTS: dict[tuple[str, str], str] = {}


def _puts(spark, d):
    """An index put in three parts, the first of them with other frequencies and ranks at first, merged on the way."""
    key = spark.sparkContext.applicationId, d
    if key not in _PUTS:
        whole, path = _index(spark, d), f"{workspace(spark, 'puts')}/index"
        nth = F.pmod(F.xxhash64("url"), F.lit(3))
        first = whole.tf.where(nth == 0), whole.rank.where(nth == 0)
        segments.put(index.Index(first[0].withColumn("tf", F.col("tf") * 2 + 1), whole.idf, first[1].withColumn("rank", -F.col("rank"))), path)
        for i in (1, 2):
            segments.put(index.Index(whole.tf.where(nth == i), None, whole.rank.where(nth == i)), path)
        segments.merge(spark, path, 2)
        segments.put(index.Index(first[0], None, first[1]), path)
        _PUTS[key] = path
    return _PUTS[key]


@query(f"WITH {PAGE_INDEX} SELECT 'tf ' || word AS name, url, round(tf, 9) AS x FROM tf UNION ALL SELECT 'idf ' || word, '', round(ln(5000::DOUBLE / (1 + df) + 1), 9) FROM df UNION ALL SELECT 'rank', url, round(rank, 6) FROM ranks")
def index_puts(spark, d):
    """The three tables after puts in parts, of which one changed."""
    i = segments.load(spark, _puts(spark, d))
    tf = i.tf.select(F.concat(F.lit("tf "), "word").alias("name"), "url", F.round("tf", 9).alias("x"))
    idf = i.idf.select(F.concat(F.lit("idf "), "word").alias("name"), F.lit("").alias("url"), F.round("idf", 9).alias("x"))
    return tf.unionByName(idf).unionByName(i.rank.select(F.lit("rank").alias("name"), "url", F.round("rank", 6).alias("x")))


@query(f"WITH {TF} SELECT word, url, round(tf, 9) AS tf FROM tf WHERE word = '{TERM}'")
def index_put_lookup(spark, d):
    """A word's rows, from the segments' files whose range holds it."""
    return segments.lookup(spark, _puts(spark, d), "tf", TERM).withColumn("tf", F.round("tf", 9))


_LOCATION = """CASE page_id % 6 WHEN 1 THEN '/moved/' || (page_id - 1) WHEN 2 THEN 'http://other.example/' || (page_id - 2) || '?q' WHEN 3 THEN NULL
  WHEN 4 THEN 'http://other.example/' || (page_id - 3) ELSE 'not a url' END"""
#: Pages' answers: every sixth is there, the others moved; a host of its own answers what they lead to.
_LOG = f"""(SELECT page_id, normal_url AS url, CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 302 WHEN 3 THEN 301 WHEN 4 THEN 303 ELSE 302 END AS status, {_LOCATION} AS location, host FROM normal)"""


def _fetch_log(spark, d):
    """url, seconds, status, location, content_type, content_length: answers of the pages' urls and of what redirects lead to."""
    pages = _pages(spark, d).select("page_id", urls.normalize_url("url").alias("url")).where("url is not null")
    log = pages.selectExpr("page_id", "url", "CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 302 WHEN 3 THEN 301 WHEN 4 THEN 303 ELSE 302 END AS status", f"{_LOCATION} AS location")
    home = workspace(spark, "log")
    log = stored(log, f"{home}/first")
    moved = stored(log.where("location is not null and page_id % 6 in (1, 2, 4)").select("page_id", fetching.redirected().alias("url")), f"{home}/moved")
    # Of what is asked for next, the targets of 4 lead on, those of 2 are there, those of 1 are there if the page's number allows.
    second = moved.selectExpr("page_id", "url", "CASE WHEN page_id % 6 = 4 THEN 301 WHEN page_id % 6 = 1 AND page_id % 4 = 3 THEN 404 ELSE 200 END AS status", "'/' AS location")
    return log.unionByName(second).selectExpr("url", "page_id AS seconds", "status", "location", "CASE WHEN page_id % 5 = 0 THEN 'text/plain' WHEN page_id % 7 = 0 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type", "CASE WHEN page_id % 9 = 0 THEN NULL ELSE page_id * 100 END AS content_length")


@query(f"""WITH raw_urls AS (SELECT page_id, url FROM pages), {NORMAL},
  asked AS (SELECT *, regexp_extract(url, '^(https?)://', 1) AS scheme, CASE page_id % 6 WHEN 1 THEN regexp_extract(url, '^(https?://[^/]*)', 1) || '/moved/' || (page_id - 1)
    WHEN 2 THEN 'http://other.example:80/' || (page_id - 2) WHEN 0 THEN url END AS went FROM {_LOG}),
  good AS (SELECT url AS asked, went AS url, page_id FROM asked WHERE page_id % 6 IN (0, 2) OR page_id % 6 = 1 AND page_id % 4 <> 3),
  last AS (SELECT max(page_id) AS page_id FROM normal GROUP BY normal_url),
  seconds AS (SELECT asked, url, page_id FROM good SEMI JOIN last USING (page_id) UNION ALL SELECT url, url, page_id FROM good WHERE page_id % 6 <> 0)
  SELECT asked, url, page_id % 5 <> 0 AND page_id % 7 <> 0 AND page_id % 9 <> 0 AND page_id * 100 <= 131072 AS accepted FROM seconds""")
def redirects(spark, d):
    """Rooted, absolute, missing, chained and bad locations, and which answers' sizes and types are accepted."""
    log = _fetch_log(spark, d)
    good = fetching.accepted(log, 0.125).withColumn("accepted", F.lit(True))
    return fetching.followed(log).select("asked", "url").join(good, ["asked", "url"], "left").select("asked", "url", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query(f"""WITH {LINKS}, {NORMAL.replace("raw_urls", "targets_").replace("n0", "q0").replace("n1", "q1").replace("n2", "q2").replace("n3", "q3").replace("n4", "q4").replace("normal AS", "ends AS").replace("q0 AS", "targets_ AS (SELECT DISTINCT dst AS url FROM links), q0 AS")}
  SELECT host, normal_url AS url, row_number() OVER (PARTITION BY host ORDER BY normal_url) AS rank,
    100 * length(host) + row_number() OVER (PARTITION BY host ORDER BY normal_url) * (length(host) % 4) AS seconds FROM ends""")
def fetch_schedule(spark, d):
    """When the urls that pages link to may be fetched: hosts' delays and last fetches differ."""
    ends = crawl.url_dedupe(_page_links(spark, d).select(F.col("dst").alias("url"))).withColumn("position", F.lit(0))
    hosts = ends.select(urls.url_host("url").alias("host")).distinct()
    rules = hosts.select("host", F.concat(F.lit("User-agent: *\nCrawl-delay: "), (F.length("host") % 4).cast("string")).alias("text"))
    log = hosts.select("host", F.explode(F.array(F.lit(1), F.length("host") * 100)).alias("seconds"))
    return fetching.schedule(ends, rules, log)


@query("""WITH RECURSIVE chain AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
  edges AS (SELECT a, b FROM chain WHERE b IS NOT NULL UNION ALL SELECT o.o_orderkey, p.o_orderkey FROM orders o JOIN orders p ON p.o_orderkey = o.o_orderkey // 2),
  reach AS (SELECT min(o_orderkey) AS k, 0 AS round FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 GROUP BY o_custkey
    UNION SELECT b, round + 1 FROM reach JOIN edges ON k = a WHERE round < 7)
  SELECT 'http://orders:80/' || k AS url, min(round)::INTEGER AS round FROM reach GROUP BY k""")
def crawl_few_seeds(spark, d):
    """Orders as pages, each with links to its customer's next one and to that of half its number; crawled from one nation's
    first orders, stopped after three rounds, and gone on with."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")  # a customer's orders
    after = orders.select("o_orderkey", F.lead("o_orderkey").over(order).alias("next"))
    half = orders.select(F.col("o_orderkey").alias("half"))
    rows = after.withColumn("half", F.floor(F.col("o_orderkey") / 2)).join(half, "half", "left_semi").select("o_orderkey", "half")
    rows = after.join(rows, "o_orderkey", "left")
    links = F.concat_ws("", *[F.when(F.col(c).isNotNull(), F.concat(F.lit("<a href='/"), F.col(c).cast("string"), F.lit("'>x</a>"))) for c in ("next", "half")])
    pages = rows.select(F.concat(F.lit("http://orders/"), "o_orderkey").alias("url"), F.concat(F.col("o_orderkey").cast("string"), links).alias("html"))
    customers = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    seeds = orders.join(customers, "o_custkey").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select(F.concat(F.lit("http://orders/"), "k").alias("url"))
    path = f"{workspace(spark, 'crawls')}/orders"
    crawl.crawl(pages, seeds, rounds=3, path=path)
    return crawl.crawl(pages, seeds, rounds=4, path=path)[1]


@query("SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS mapped, (SELECT count(DISTINCT text) FROM documents) AS reduced, (SELECT least(10, count(DISTINCT text)) FROM documents) AS sampled, true AS known")
def job_counters(spark, d):
    """The word count job's counters when it has ended; the sample's lines are among its outputs."""
    counters = jobs.Counters(spark)
    out = stored(jobs.run_named("WordCount", jobs.of_lines(_documents(spark, d), "text"), counters), f"{workspace(spark, 'counted')}/out")
    lines = spark.createDataFrame([(x,) for x in counters.sample], "line string").join(out.select(F.concat_ws(" ", "key", "value").alias("line")), "line", "left_semi")
    return spark.createDataFrame([(counters.mapped, counters.reduced, len(counters.sample), lines.count() == len(counters.sample))], "mapped long, reduced long, sampled long, known boolean")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS number, o_orderkey || ' ' || o_custkey AS value FROM orders")
def numbered_lines(spark, d):
    """Lines of files in order, read in ranges, with their numbers."""
    path = workspace(spark, "numbered")
    orders = spark.read.parquet(f"{d}/orders.parquet").orderBy("o_orderkey").select(F.concat_ws(" ", "o_orderkey", "o_custkey").alias("value"))
    orders.write.text(path)
    return relation.numbered(relation.read(spark, "lines", path, rangeBytes="10000"), whole=True).select("number", "value")


@query(f"WITH {TF} SELECT word, url, round(tf, 9) AS tf FROM tf WHERE word = '{TERM}'")
def source_of_a_word(spark, d):
    """A relation's rows of a word, as the data source reads them."""
    path = workspace(spark, "tfs")
    textio.write_relation(_index(spark, d).tf, "tfs", path)
    return relation.read(spark, "tfs", f"{path}/part-*").where(F.col("word") == TERM).withColumn("tf", F.round("tf", 9))


@query(f"WITH {HITS} SELECT word, url, count(*) AS n FROM hits GROUP BY word, url")
def streamed_hits(spark, d):
    """Pages that arrive in five batches, many of them twice, and copies' smaller urls later than larger ones."""
    home = workspace(spark, "streamed")
    pages = _pages(spark, d).select("url", "html")
    for i in range(5):
        later = F.pmod(F.xxhash64("url"), F.lit(5))
        # A batch is what has come since the stream stopped, in any number of files.
        pages.where((later == 4 - i) | (later == (i + 2) % 5)).write.mode("append").parquet(f"{home}/in")
        arriving = spark.readStream.schema(pages.schema).parquet(f"{home}/in")
        stream.follow(arriving, f"{home}/index", f"{home}/at", availableNow=True).awaitTermination()
    return stream.counts(spark, f"{home}/index")
