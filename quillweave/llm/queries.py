"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, gif_media, hard_negatives, html_extract, jaccard, langid, mixing, packing, quality, secrets, token_counts, topk, warc
from .common import scratch


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_features(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store starts empty in each run: what is measured is a first count of the corpus."""
    cache = scratch(spark, "token-cache")
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(topk.divisible()))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"), k=3, num=90)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.relabelled(_read(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(vectors, hard_negatives.divisible())


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(_read(spark, sf_dir, "documents"), *paths)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger starts empty in each run: what is measured is a first scan of the corpus."""
    return secrets.scan(_read(spark, sf_dir, "documents"), scratch(spark, "ledger")).drop("blob")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_gif_media": op4_gif_media,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_langid": op7_langid,
    "op8_topk": op8_topk,
    "op9_packing": op9_packing,
    "op10_jaccard": op10_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_secrets": op13_secrets,
}

SQL: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op3_warc": warc.SQL,
    "op8_topk": topk.SQL,
    "op10_jaccard": jaccard.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_secrets": secrets.SQL,
}
