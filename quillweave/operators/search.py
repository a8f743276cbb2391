"""Single-term search."""

from __future__ import annotations

import re
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index

LIMIT = 100


def term(query: str) -> str | None:
    """The query's first token as it is; leading white space gives an empty one, nothing but white space gives none."""
    if not query.strip():
        return None
    return re.split(r"[ \t\n\x0b\f\r]+", query)[0]


def search(index: Index, query: str, limit: int = LIMIT, top_k: bool = False, strict: bool = False) -> DataFrame:
    """score, url of a term's urls, best first: tf * idf * rank.

    The first limit urls of the term, in order of url, are scored and then sorted; top_k scores all and keeps the best
    instead. A url without rank is left out; strict raises ValueError. A query without a term gives no rows.
    """
    word = term(query)
    hits = index.tf.where(F.lit(False) if word is None else F.col("word") == word)
    if not top_k:
        hits = hits.orderBy("url").limit(limit)
    if strict and not hits.join(index.rank, "url", "left_anti").isEmpty():
        raise ValueError("a url has no rank")
    found = hits.join(index.idf, "word").join(index.rank, "url")
    found = found.select((F.col("tf") * F.col("idf") * F.col("rank")).alias("score"), "url").orderBy(F.desc("score"), "url")
    return found.limit(limit) if top_k else found


def html_results(found: DataFrame) -> str:
    """The result list as HTML; at most limit rows, so it is made on the driver."""
    items = "".join(f'<li>{x.score} <a href="{escape(x.url)}">{escape(x.url)}</a></li>' for x in found.collect())
    return f"<ol>{items}</ol>"
