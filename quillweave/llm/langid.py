"""Language identification with bit-sliced Bloom filters of n-grams.

For each language the filter holds the character n-grams that are typical of it: frequent enough, and not far more
frequent in another language. All languages share one array: a place has a bit for each language, so the AND of an
n-gram's places is the set of all languages that may contain it; beyond 63 languages a place has several words of bits.
A text's hits are counted for each language, freed of
the hits that its share of set bits makes by chance, and the largest count decides.

Least frequency bounds what the filter holds, whatever the corpus' size: at 1e-5, at most 100,000 n-grams a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow, mix, scratch, ship, slices, table, utf8

N = 4
PLACES = 1 << 20
HASHES = 3
LEAST = 1e-5
#: Languages of a word of bits.
WORD = 63
#: Share of an n-gram's largest frequency in any language from which a language has it.
SHARE = 0.4
_LETTERS: list[np.ndarray] = []


class Filter(NamedTuple):
    languages: list[str]  # of bits 0, 1, ...
    masks: np.ndarray  # of PLACES, a row of words for each 63 languages
    chance: np.ndarray  # of a false hit, for each language


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text's index) of every n-gram of lower-case letters and word ends; (whether a text has a letter).

    What isn't a letter ends a word, a run of it counts as one space, and so do a text's two ends.
    """
    low = ["  " + t.lower() + "  " for t in texts]
    sizes = np.array([len(t) for t in low])
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    alpha = letters()[code]
    has = np.bincount(doc[alpha], minlength=len(texts)) > 0
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    keep[:-1] |= alpha[1:] & (doc[1:] == doc[:-1])
    # The last of a run of others stays when a word follows, the first when one goes before: one space where they meet.
    double = ~alpha[1:] & ~alpha[:-1] & keep[1:] & keep[:-1] & (doc[1:] == doc[:-1])
    keep[1:] &= ~double
    code, doc, alpha = code[keep].astype(np.uint64), doc[keep], alpha[keep]
    code = np.where(alpha, code, np.uint64(32))
    if len(code) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    h = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x110000 + 2) + code[k : len(code) - n + 1 + k]
    same = doc[: len(h)] == doc[n - 1 :]
    return mix(h[same]), doc[: len(h)][same], has


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    data, offsets = utf8(batch.column("text"))
    for i, j in slices(offsets, 1 << 19):
        yield i, j, batch.column("text").slice(i, j - i).fill_null("").to_pylist()


def _count(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            keys = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(languages)
            for i, _, texts in _texts(batch):
                h, doc, _ = grams(texts)
                of = lang[i:][doc]
                for k in np.unique(of):
                    g, n = np.unique(h[of == k], return_counts=True)
                    old, m = keys[k]
                    u, at = np.unique(np.concatenate([old, g]), return_inverse=True)
                    keys[k] = (u, np.bincount(at, np.concatenate([m, n]), len(u)).astype(np.int64))
            for k, (g, n) in enumerate(keys):
                if len(g):
                    yield pa.record_batch([pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(n)], ["language", "gram", "n"])

    return run


def places(gram: np.ndarray, k: int, size: int) -> np.ndarray:
    """The place of the k-th hash of n-grams; size is a power of two."""
    return mix(gram + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(size - 1)


def _slots(size: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("gram").to_numpy().view(np.uint64)
            for k in range(hashes):
                yield pa.record_batch([pa.array(places(g, k, size).astype(np.int64)), batch.column("word"), batch.column("mask")], ["place", "word", "mask"])

    return run


def fit(docs: DataFrame, least: float = LEAST, share: float = SHARE, size: int = PLACES, hashes: int = HASHES) -> Filter:
    """The filter of docs (text, lang), of which rows without either are left out.

    All rows are counted; an n-gram enters a language if its frequency there is at least least, and at least share
    times its largest in any; with least 0 all do. The driver gets the languages' names and at most size places, of 8
    bytes for each 63 languages.
    """
    spark = docs.sparkSession
    home = scratch(spark, "langid")
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    languages = sorted(x.lang for x in rows.select("lang").distinct().collect())
    if not languages:
        return Filter([], np.zeros((size, 1), np.uint8), np.zeros(0))
    wide = -(-len(languages) // WORD)
    counts = rows.transform(arrow, _count(languages), "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    counts = table(counts, f"{home}/counts")
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(totals), "language").select("language", "gram", (F.col("n") / F.col("total")).alias("p"))  # a row for each language
    typical = rate.where(F.col("p") >= least).withColumn("most", F.max("p").over(Window.partitionBy("gram"))).where(F.col("p") >= share * F.col("most"))
    word = F.floor(F.col("language") / WORD).cast("int").alias("word")
    masks = typical.groupBy("gram", word).agg(F.sum(F.expr(f"shiftleft(1L, language % {WORD})")).alias("mask"))
    slots = masks.transform(arrow, _slots(size, hashes), "place long, word int, mask long").groupBy("place", "word").agg(F.bit_or("mask").alias("mask"))
    got = slots.toArrow()
    array = np.zeros((size, wide), next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= min(len(languages), WORD)))
    array[got.column("place").to_numpy(), got.column("word").to_numpy()] = got.column("mask").to_numpy()
    chance = np.array([has(array[:, i // WORD], i).mean() for i in range(len(languages))]) ** hashes
    return Filter(languages, array, chance)


def has(mask: np.ndarray, language: int) -> np.ndarray:
    """Whether the words of bits, those of the language, have it."""
    return ((mask >> mask.dtype.type(language % WORD)) & mask.dtype.type(1)).astype(bool)


def classify(texts: list[str], model: Filter, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """(language's number, -1 where there is no letter; score) of each text."""
    h, doc, lettered = grams(texts)
    mask = np.full((len(h), model.masks.shape[1]), np.iinfo(model.masks.dtype).max, model.masks.dtype)
    for k in range(hashes):
        mask &= model.masks[places(h, k, len(model.masks)).astype(np.int64)]
    total = np.bincount(doc, minlength=len(texts))
    n = max(1, len(model.languages))
    hits = np.zeros((len(texts), n))
    for i in range(len(model.languages)):
        raw = np.bincount(doc[has(mask[:, i // WORD], i)], minlength=len(texts))
        hits[:, i] = np.maximum(0, (raw - total * model.chance[i]) / max(1e-9, 1 - model.chance[i]))
    best = hits.argmax(1)
    score = hits[np.arange(len(texts)), best] / np.maximum(hits.sum(1), 1e-9)
    return np.where(lettered & bool(model.languages), best, -1), np.where(lettered, np.clip(score, 0, 1), 0.0)


def _predict(model: Filter, shared, as_names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = model._replace(masks=shared.value)
        names = np.array([*filled.languages, "und"], object)
        for batch in batches:
            for i, j, texts in _texts(batch):
                best, score = classify(texts, filled)
                part = batch.slice(i, j - i)
                cols = [part.column(c) for c in part.schema.names]
                yield pa.record_batch([*cols, pa.array(names[best], pa.string()), pa.array(score)], [*part.schema.names, *as_names])

    return run


def predict(docs: DataFrame, model: Filter, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of docs, lang_pred and score, for every row: the language whose corrected count is largest.

    score is its share of all languages' counts. A null text, and one without a letter, is und with score 0. A text with
    letters none of whose n-grams is known gets the first language with score 0. Of equal counts the language first in
    order wins. Very long texts count whole; repeated rows are kept. names are those of the new columns; columns of docs so named are replaced. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model.masks)  # PLACES rows of words, whatever the corpus
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema) + f", `{names[0]}` string, `{names[1]}` double"
    return docs.transform(arrow, _predict(model._replace(masks=model.masks[:0]), shared, names), schema)


def fold(doc_id: Column) -> Column:
    """The remainder by 4 of the CRC-32 of the id as text; 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang), learned from its rows not held out."""
    held = (fold(F.col("doc_id")) == 2).alias("held_out")
    model = fit(docs.where(fold(F.col("doc_id")) != 2))
    out = predict(docs.select("doc_id", held, "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
