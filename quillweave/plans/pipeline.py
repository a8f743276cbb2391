"""From pages to a searchable index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import parsed
from ..operators import crawl, graph, scoring
from ..operators.index import Index
from ..tables import stored, workspace


def page_graph(pages: DataFrame) -> DataFrame:
    """src, dst of the pages' links."""
    return crawl.links(crawl.content_dedupe(crawl.normalized(pages)))


def index_of_pages(pages: DataFrame, n: int | None = scoring.CORPUS, variant: str = "smooth_inside") -> Index:
    """The index of pages (url, html): normal urls, one of each content. n None: as many documents as the index has."""
    # A page's text and links come from one pass over it, and are read apart.
    kept = crawl.content_dedupe(crawl.normalized(pages.select("url", "html")))
    kept = stored(parsed(kept), f"{workspace(pages.sparkSession, 'pages')}/parsed")
    return build(crawl.hits(kept, text="text"), crawl.links(kept, found="links"), n, variant)


def build(hits: DataFrame, links: DataFrame, n: int | None = scoring.CORPUS, variant: str = "smooth_inside") -> Index:
    """The index of hits (word, url) and links (src, dst)."""
    home = workspace(hits.sparkSession, "index")
    tf = stored(scoring.term_frequency(hits), f"{home}/tf")
    if n is None:
        n = tf.select(F.count_distinct("url")).first()[0]
    return Index(tf, scoring.inverse_document_frequency(scoring.document_frequency(tf), n, variant), graph.page_rank(links))
