"""A page's text and the hrefs of its links, from one pass over its tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..tables import ship
from .urls import Cols

# Elements whose start and end separate words, as HTML parsers lay out text; others don't.
BLOCKS = frozenset(
    (
        "html head body frameset script noscript style meta link title frame noframes section nav aside hgroup header footer p h1 h2 h3 h4 h5 h6 "
        "ul ol pre div blockquote hr address figure figcaption form fieldset ins del dl dt dd li table caption thead tfoot tbody colgroup col tr "
        "th td video audio canvas details menu plaintext template article main svg math center br"
    ).split()
)
_VALUE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)"""
#: Comments, scripts and styles, each to the page's end where it isn't closed; then tags: a block's name is group 2, an a
#: element's attributes are group 3.
_TOKEN = re.compile(
    rf"""<(?:!--.*?(?:-->|\Z)|(script|style)\b.*?(?:</\1\s*>|\Z)|/?(?:({"|".join(sorted(BLOCKS, key=len, reverse=True))})(?=[\s/>]|\Z)|a(?=\s)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)|[a-z]){_VALUE}|[!?][^>]*(?:>|\Z))""",
    re.I | re.S,
)
_HREF = re.compile(r"""(?:\s(?:[^"']|"[^"]*"|'[^']*')*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
_ORIGIN = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*:)//[^/?#]*")


def parse(page: str, links: bool = True) -> tuple[str, list[str]]:
    """(text, hrefs of a elements in order, with repeats) of a page.

    Hidden parts and tags of blocks become a space in the text, other tags vanish; references are decoded, once, but not in
    the hrefs; a space that doesn't break is one. A tag whose quotes aren't closed is text.
    """
    out, hrefs, at = [], [], 0
    for m in _TOKEN.finditer(page):
        first = m.start()
        if at < first:
            out.append(page[at:first])
        at = m.end()
        kind = m.lastindex
        if kind == 3:
            if links and page[first + 1] != "/" and (h := _HREF.match(m[3])):
                href = h[1]
                hrefs.append(href[1:-1] if href[0] in "\"'" else href)
        elif kind is not None or page.startswith("<!--", first):
            out.append(" ")
    out.append(page[at:])
    text = "".join(out)
    if "&" in text:
        text = unescape(text)
    return text.replace("\u00a0", " "), hrefs


def resolve(base: str | None, href: str) -> str | None:
    """Absolute form of an href, its references decoded, on the page base; null where there is none."""
    href = (unescape(href) if "&" in href else href).strip(" ")
    if _SCHEME.match(href):
        return href
    if base is None:
        return None
    if href[:1] == "/" and (m := _ORIGIN.match(base)):
        return (m[1] if href[:2] == "//" else m[0]) + href
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return None


def _run(text: bool, links: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, ends, urls = [], [], batch.column(0).to_pylist() if links else None
            for i, page in enumerate(batch.column(1)):
                page = page.as_py()
                if page is None:
                    said.append(None)
                    ends.append(None)
                    continue
                words, hrefs = parse(page, links)
                if text:
                    said.append(words)
                if links:
                    ends.append([resolve(urls[i], x) for x in hrefs])
            cols = [batch.column(0)] + ([pa.array(said, pa.string())] if text else []) + ([pa.array(ends, pa.list_(pa.string()))] if links else [])
            yield pa.record_batch(cols, ["url"] + ["text"] * text + ["links"] * links)

    return run


def parsed(pages: DataFrame, html: str = "html", text: bool = True, links: bool = True) -> DataFrame:
    """url, text and links (the absolute form of each href, as it is written) of each row of pages; null where it has no html."""
    ship(pages.sparkSession)
    schema = "url string" + ", text string" * text + ", links array<string>" * links
    return pages.select("url", html).mapInArrow(_run(text, links), schema)


@F.pandas_udf(StringType())
def _text(pages: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else parse(x, False)[0] for x in pages], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _links(pages: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else parse(x)[1] for x in pages], dtype=object)


def html_text(html: Cols) -> Column:
    """A page's text, as a column; ``parsed`` gives it together with the links."""
    return _text(html)


def html_links(html: Cols) -> Column:
    """Array of the href of every a element, in order, with repeats; references in them aren't decoded yet."""
    return _links(html)
