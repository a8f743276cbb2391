"""The corpus pipeline: five stages from documents to packed sequences, each applying one operator of quillweave.llm.

Part of that subpackage, though it lies at the top of the repository: it is deleted with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm import jaccard, langid, mixing, packing, quality
from quillweave.llm.common import emit, fresh, placed, scratch, table

#: Least share of a text's corrected n-gram hits that its language must have.
SURE = 0.4
#: Letters below which a text says too little to be rejected for its language.
SHORT = 8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; those that it rejects go.

    A null or empty text, or one without tokens, goes; rows equal in doc_id and text stay or go together; very long
    texts count whole. All columns are kept, whatever their names; an empty table gives an empty result.
    """
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is plain; those without a letter, null among them, or of no clear language go.

    The filters are learned from the stage's input, from rows that have a language; if none has, all rows stay. Texts of
    fewer than SHORT letters, too short to tell, stay. Repeated rows are judged alike, very long texts whole. All columns
    are kept, whatever their names; an empty table gives an empty result.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = langid.predict(docs, model, (lang, score))
    short = F.regexp_count("text", F.lit(r"\p{L}")) < SHORT
    return found.where((F.col(lang) != "und") & ((F.col(score) >= SURE) | short)).select(*[F.col(f"`{c}`") for c in docs.columns])


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Texts without words, null among them, are no duplicates of each other and stay; of repeated rows one stays; very
    long texts are compared whole. All columns are kept, whatever their names; an empty table gives an empty result.
    """
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix emits it; a null text, or one without words, has size 0 and its place too.

    Rows are told apart by where they lie, so that repeated rows and rows without doc_id each get their own copies. Very long
    texts count whole; all columns are kept, whatever their names; an empty table gives an empty result.
    """
    home = scratch(spark, "mixed")
    rows, file, row = placed(docs, home)
    named = rows.select("doc_id", "text", "source", F.col(f"`{file}`").alias("file"), F.col(f"`{row}`").alias("row"))
    counts = mixing.mix_sources(named, keep=("file", "row")).where("copies > 0").select("file", "row", F.col("copies").alias("n"))
    return emit(rows, file, row, counts, home)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens.

    A null or empty text is the end id alone, a very long one several pieces; repeated rows are packed each; other
    columns, of whatever name, are left out; an empty table gives an empty result.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the hashed models, the filters and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written as Parquet and read again as the next one's input."""
    home = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = table(stage(spark, docs, sf_dir), f"{home}/{k}")
    return docs
