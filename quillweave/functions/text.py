"""Words of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import html_links, html_text  # noqa: F401

# The stop words that are never indexed.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def split_words(text: Column | str) -> Column:
    """Array of words at white space, with the empty first one that leading white space gives."""
    return F.split(F.col(text) if isinstance(text, str) else text, r"\s+")


def clean_word(word: Column | str) -> Column:
    """A raw token without commas and full stops, in lower case; null where letters a-z aren't all that is left."""
    c = F.lower(F.regexp_replace(F.col(word) if isinstance(word, str) else word, "[,.]", ""))
    return F.when(c.rlike(r"^[a-z]+\z"), c)


def is_stop_word(word: Column | str, stop_words=STOP_WORDS) -> Column:
    return (F.col(word) if isinstance(word, str) else word).isin(list(stop_words))


def words(text: Column | str, stop_words=STOP_WORDS) -> Column:
    """Array of the indexed words of a text, with repeats: the text is cleaned as a whole, then its words are taken."""
    clean = F.lower(F.regexp_replace(F.col(text) if isinstance(text, str) else text, "[,.]", ""))
    found = F.regexp_extract_all(clean, F.lit(r"(?<!\S)[a-z]+(?!\S)"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(stop_words)))
