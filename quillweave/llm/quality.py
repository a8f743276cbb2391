"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted, one of the texts labelled good and one of the whole corpus. A
text's log weight is the log ratio of its likelihoods under the two, for as many n-grams as every text counts for, so
that a weight says how good a text is and not how long. Adding Gumbel noise to it and taking the k largest draws k texts
without replacement, in proportion to their weights. k is given, as a number or a share of the texts, or else is the
number of good texts that the corpus is expected to hold: the sum of all texts' chances to be good, a logistic curve of
the weight fitted on labelled texts. A cut between good and bad is told beside it and decides nothing.

Tokens are runs of word characters and runs of marks, in lower case with digits alike. Two kinds get a symbol of their
own, as generative models of words can't know them: words in capitals, and tokens that repeat one of the two before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow, mix, scratch, slices, table, tokens, utf8

BUCKETS = 1 << 16
#: Labelled rows that are used, about, where there are more: those of the smallest hashes; bounds what is broadcast.
LABELLED = 200_000
#: Share of the labelled good texts that the cut keeps.
KEEP = 0.998
#: N-grams that a text counts for, whatever its length: its weight is the mean log ratio so many times.
LENGTH = 100
#: Of the noise. At 1 the draw follows the weights.
TEMPERATURE = 1.0

_KIND = np.full(256, 2, np.int8)
_KIND[list(SPACES)] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_ALIKE = np.arange(256, dtype=np.uint8)
_ALIKE[65:91] += 32
_ALIKE[48:58] = 48
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_CAPITALS, _AGAIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)


class Model(NamedTuple):
    log_ratio: np.ndarray  # of each bucket: good over all
    cut: float  # of the mean log ratio of a text's n-grams
    slope: float = 0.0  # of the log odds that a text is good, by its log weight
    offset: float = 0.0  # the log odds at a weight of 0


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document's index) of each token and each pair of neighbours."""
    h, doc, s, e = tokens(data, offsets, _KIND, _ALIKE)
    if not len(h):
        return np.zeros(0, np.int64), doc
    upper = np.concatenate([[0], np.cumsum(_UPPER[data[offsets[0] : offsets[-1]]])])
    n = e - s
    capital = (n > 1) & (upper[e - offsets[0]] - upper[s - offsets[0]] == n)
    again = np.zeros(len(h), bool)
    for lag in (1, 2):
        again[lag:] |= (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])
    h = np.where(again, _AGAIN, np.where(capital, _CAPITALS, h))
    near = doc[1:] == doc[:-1]
    pairs = mix(h[:-1][near] * np.uint64(3) + h[1:][near])
    of = np.concatenate([doc, doc[1:][near]])
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64), of


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            is_good = batch.column("good").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                bucket, doc = features(data, offsets[i : j + 1], buckets)
                every += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[is_good[i:j][doc]], minlength=buckets)
        at = np.flatnonzero(every)
        yield pa.record_batch([pa.array(at), pa.array(every[at]), pa.array(good[at])], ["bucket", "n", "good"])

    return run


def _score(model: Model, seed: int, temperature: float, keep_from: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            for i, j in slices(offsets):
                bucket, doc = features(data, offsets[i : j + 1], len(model.log_ratio))
                n = np.bincount(doc, minlength=j - i)
                weight = (np.bincount(doc, model.log_ratio[bucket], j - i) / np.maximum(n, 1) - model.cut) * LENGTH * (n > 0)
                u = (mix(ids[i:j].astype(np.uint64) ^ np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5
                key = np.where(n > 0, weight / temperature - np.log(-np.log(u / (1 << 53))), -np.inf)
                bits = key.view(np.int64)
                order = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))  # in the order of the keys
                part = batch.slice(i, j - i)
                if keep_from is not None:
                    yield part.filter(pa.array((order >= keep_from) & (n > 0)))
                    continue
                yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(weight), pa.array(key), pa.array(order)], ["doc_id", "n_features", "log_weight", "sample_key", "key_order"])

    return run


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED, keep: float = KEEP) -> Model:
    """The model of docs (doc_id, text): counts over all of them, the good ones by labels (doc_id, quality).

    Rows of labels with null are left out; a doc_id with two labels is good if any says so. Without good texts, and
    for an empty table, all weights are 0. The driver gets the buckets and a mean log ratio for each labelled
    doc_id, the largest of its rows.
    """
    spark = docs.sparkSession
    home = scratch(spark, "quality")
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") >= 1).alias("good"))
    marks = table(marks.withColumn("turn", F.xxhash64("doc_id")), f"{home}/marks")
    # Fewer in expectation than asked for by a bound on the hash, and no sort of all labels in one task.
    n = marks.count()
    if n > labelled:
        marks = marks.where(F.col("turn") < F.lit(int(-(1 << 63) + (1 << 64) * (labelled / n))))
    marks = table(marks.drop("turn"), f"{home}/labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id", "left")  # about labelled rows
    counts = rows.select("text", F.coalesce("good", F.lit(False)).alias("good")).transform(arrow, _count(buckets), "bucket long, n long, good long")
    got = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toArrow()
    every, good = np.zeros(buckets), np.zeros(buckets)
    every[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    good[got.column("bucket").to_numpy()] = got.column("good").to_numpy()
    if not good.sum():
        return Model(np.zeros(buckets), 0.0)
    ratio = np.log((good + 1) / (good.sum() + buckets)) - np.log((every + 1) / (every.sum() + buckets))
    schema = "doc_id long, n_features long, log_weight double, sample_key double, key_order long"
    scored = docs.select("doc_id", "text").join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi").transform(arrow, _score(Model(ratio, 0.0), 0, 1.0), schema)
    best = scored.where("n_features > 0").groupBy("doc_id").agg(F.max("log_weight").alias("log_weight"))  # a doc_id may have many rows
    means = best.join(F.broadcast(marks), "doc_id").orderBy("doc_id").select("good", (F.col("log_weight") / LENGTH).alias("mean")).toArrow()
    is_good, mean = means.column("good").to_numpy(zero_copy_only=False).astype(bool), means.column("mean").to_numpy()
    at = cut(mean[is_good], mean[~is_good], keep)
    return Model(ratio, at, *curve((mean - at) * LENGTH, is_good))


def curve(weight: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the log odds of good: logistic regression by Newton's steps, held back a little.

    Where one kind is missing the slope is 0 and the odds are those of the counts, one of each added.
    """
    if not len(good) or good.all() or not good.any():
        return 0.0, float(np.log((good.sum() + 1) / ((~good).sum() + 1)))
    scale = float(np.abs(weight).max()) or 1.0
    x, b = np.stack([weight / scale, np.ones(len(weight))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (good - p) - 1e-3 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def cut(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The cut that tells good from bad best (the sum of both rates), of those that keep the given share of the good."""
    good, bad = np.sort(good), np.sort(bad)
    if not len(good):
        return 0.0
    most = good[int((1 - keep) * (len(good) - 1))]
    if not len(bad):
        return float(most)
    at = np.unique(np.concatenate([good, bad]))
    at = np.concatenate([[at[0] - 1e-9], (at[1:] + at[:-1]) / 2])
    at = at[at <= most] if (at <= most).any() else at[:1]
    rate = (len(good) - np.searchsorted(good, at)) / len(good) + np.searchsorted(bad, at) / len(bad)
    return float(at[np.argmax(rate)])


def kth(scores: DataFrame, k: int) -> int:
    """The k-th largest of the column key_order (long), or the smallest, exactly, by counts of 16 bits at a time."""
    low, high = -(1 << 63), (1 << 63) - 1
    k = min(k, scores.count())
    for shift in (48, 32, 16, 0):
        part = F.shiftright("key_order", shift) if shift else F.col("key_order")
        rows = scores.where(F.col("key_order").between(low, high)).groupBy(part.alias("bin")).count().collect()
        for bin_, n in sorted(((x["bin"], x["count"]) for x in rows), reverse=True):
            if k <= n:
                low, high = bin_ << shift, (bin_ << shift) + (1 << shift) - 1
                break
            k -= n
    return low


def score(docs: DataFrame, model: Model, seed: int = 1, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, n_features, log_weight, sample_key, key_order for every row of docs (doc_id, text)."""
    schema = "doc_id long, n_features long, log_weight double, sample_key double, key_order long"
    return docs.select("doc_id", "text").transform(arrow, _score(model, seed, temperature), schema)


def expected(scores: DataFrame, model: Model) -> int:
    """Good texts that the scores' texts are expected to hold, in millionths of a text so that the sum has one value."""
    odds = F.exp(-(F.col("log_weight") * model.slope + model.offset))
    total = scores.where("n_features > 0").agg(F.sum(F.floor(1e6 / (1 + odds)))).first()[0]
    return round((total or 0) / 1e6)


def threshold(scores: DataFrame, model: Model, k: int | None = None, share: float | None = None) -> int:
    """key_order from which rows are drawn: of k rows, of a share of those with tokens, or of the expected good ones."""
    rows = scores.where("n_features > 0")
    if k is None:
        k = expected(scores, model) if share is None else round(share * rows.count())
    return kth(rows, k) if k else (1 << 63) - 1


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, seed: int = 1, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, n_features, log_weight, sample_key, selected, above_cut for every row of docs (doc_id, text).

    selected rows are the k of the largest keys, all of them if there are fewer. Noise depends on seed and doc_id alone,
    so reruns agree, and rows equal in doc_id and text enter or leave together, also where that makes more than k. A
    text without tokens, null among them, has weight 0 and is never selected; a very long one counts whole. Other
    columns, of whatever name, are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels)
    scores = table(score(docs, model, seed, temperature), f"{scratch(docs.sparkSession, 'resample')}/scores")
    chosen = (F.col("key_order") >= threshold(scores, model, k, share)) & (F.col("n_features") > 0)
    above = (F.col("log_weight") >= 0) & (F.col("n_features") > 0)
    return scores.select("doc_id", "n_features", "log_weight", "sample_key", chosen.alias("selected"), above.alias("above_cut"))


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, seed: int = 1, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of docs, with all columns, that resample selects: weighed a second time where they lie, not joined."""
    model = fit(docs, labels)
    scores = table(score(docs, model, seed, temperature), f"{scratch(docs.sparkSession, 'resample')}/scores")
    return docs.transform(arrow, _score(model, seed, temperature, threshold(scores, model, k, share)), docs.schema)
