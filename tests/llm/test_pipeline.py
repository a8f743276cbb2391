"""The stages of the pipeline, each on its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import SF, _check_packing, brute_components, clashing, odd_docs, same_texts  # noqa: F401

from quillweave.llm import mixing
from quillweave.llm.common import scratch, table


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    home = scratch(spark, "stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = table(stage(spark, docs, SF), f"{home}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        had, has = {x.doc_id for x in docs.collect()}, Counter(x.doc_id for x in out.collect())
        assert set(has) <= had
        if k == 0:
            good = [i for i, q in labels.items() if q]
            assert sum(i in has for i in good) >= 0.97 * len(good) and sum(i in has for i, q in labels.items() if not q) <= 0.05 * (len(labels) - len(good)) + 2
        elif k == 1:
            assert len(has) >= 0.99 * len(had)
        elif k == 2:
            assert set(has) == {i for i, (_, c) in brute_components(same_texts(docs), 5, 80, 100).items() if i == c} and max(has.values()) == 1
        elif k == 3:
            assert has == Counter({x.doc_id: x.copies for x in mixing.mix_sources(docs).collect() if x.copies})
        else:
            _check_packing(out.collect(), same_texts(docs))
        docs = out
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_rows(spark, odd_docs):  # noqa: F811
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd_docs, SF)
        assert out.columns == odd_docs.columns and out.count() >= 0
        assert stage(spark, odd_docs.limit(0), SF).count() == 0
    mixed = corpus_pipeline.mixing_stage(spark, odd_docs, SF).select("doc_id").collect()
    want = Counter()
    for x in mixing.mix_sources(odd_docs).collect():
        want[x.doc_id] += x.copies
    assert Counter(x.doc_id for x in mixed) == +want
    names = odd_docs.withColumns({"mixing copy": F.lit(1), "row": F.lit("x"), "File": F.lit(2), "n": F.lit(3)})
    # Too short to tell, and no languages to learn from: nothing speaks against these.
    short = spark.createDataFrame([(1, "A.", "en"), (2, "the cat sat on the mat", "en"), (3, "12", "en"), (4, "zzqqx vvkkw xxqqj wwvvk", None)], "doc_id long, text string, lang string")
    assert {x.doc_id for x in corpus_pipeline.language_stage(spark, short, SF).collect()} == {1, 2}
    assert corpus_pipeline.language_stage(spark, short.withColumn("lang", F.lit(None).cast("string")), SF).count() == 4
    for stage in (corpus_pipeline.duplicate_stage, corpus_pipeline.mixing_stage):
        assert stage(spark, names, SF).columns == names.columns and stage(spark, names, SF).count()
