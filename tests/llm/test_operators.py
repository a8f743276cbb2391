"""The operators on Spark: against brute force, round trips and the cases that every operator has to take."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

from quillweave.llm import gif_media, html_extract, jaccard, langid, mixing, packing, quality, queries, token_counts, topk, warc  # noqa: E402
from quillweave.llm.common import scratch  # noqa: E402

SF = "/root/testdata/sf0.001"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use themselves.
CLASH = ["score", "lang_pred", "size", "target", "copies", "part", "turn", "place", "class", "rank", "key", "at", "length", "n_bytes", "media", "digest", "root", "good", "noise", "host"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def odd_docs(spark):
    long = " ".join(f"word{i % 977} and more" for i in range(40_000))
    rows = [(0, "The cat sat on the mat. The end.", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "fr", "a"), (4, long, "en", "b"), (5, "The cat sat on the mat. The end.", "en", None)]
    rows += [(5, "The cat sat on the mat. The end.", "en", None), (6, "one", "en", "b"), (7, "!!! ### 123", None, "b"), (None, "the cat", "en", "a"), (8, "é" * 300 + " <|endoftext|> </s>", "fr", ""), (9, "ONE", "en", "b")]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same_texts(df):
    return df.select("doc_id", "text").collect()


def test_mixing(spark, odd_docs):
    duck = oracle.connect(SF)
    assert oracle.spark_rows(queries.op2_mixing(spark, SF)) == oracle.duck_rows(duck, mixing.SQL)
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count() and {x.source for x in got} == {"", "a", "b", None}
    assert all(0 <= x.taken <= 2 * x.size and x.taken == x.copies * x.size for x in got)
    held = defaultdict(int)
    for x in got:
        held[x.source] += x.size
    assert all(held[x.source] == x.source_size and x.target <= 2 * x.source_size for x in got)
    key = lambda x: (x.doc_id or -1, x.source or "", x.copies)
    assert sorted(got, key=key) == sorted(mixing.mix_sources(odd_docs).collect(), key=key)
    assert mixing.mix_sources(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_warc", "op10_jaccard"])
def test_same_rows_as_sql(spark, name):
    assert oracle.spark_rows(queries.QUERIES[name](spark, SF)) == oracle.duck_rows(oracle.connect(SF), queries.SQL[name])


def test_warc(spark):
    rows = [(3, "http://h/a b", "<p>x</p>"), (1, "http://h/c", "<p>x</p>"), (2, None, None), (5, "", ""), (4, "http://h/é", "HTTP/1.1 é\r\n\r\n"), (1, "http://h/c", "<p>x</p>"), (None, "http://h/n", "<p>x</p>"), (9, "u", "z" * 3_000_000)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    import base64

    want = Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows)
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest) for x in got) == want
    by = {(i): h or "" for i, _, h in rows}
    for h, i in first.items():
        kinds = [x.record_type for x in got if by[x.page_id] == h]
        assert kinds.count("response") == 1 and kinds.count("revisit") == len(kinds) - 1
        assert all(x.refers_to == (i if x.record_type == "revisit" else None) for x in got if by[x.page_id] == h)
        assert [x.page_id for x in got if by[x.page_id] == h and x.record_type == "response"] == [i]
    assert len({x.record_id for x in got}) == len(got)
    all_whole = warc.archive_pages(pages, min_bytes=9).collect()
    assert {x.record_type for x in all_whole} == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_archives_are_dealt_one_by_one(spark):
    names = [f"part-{i:05d}-0000.arc.gz" for i in range(40)]
    dealt = warc._files(spark, names).groupBy(F.spark_partition_id().alias("part")).agg(F.collect_list("file").alias("files")).collect()
    assert sorted(x.files for x in dealt) == [[x] for x in names]
    many = spark.range(0, 60, 1, 20).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), (F.col("id") % 7).cast("string").alias("html"))
    got = {x.page_id: x for x in warc.archive_pages(many).collect()}
    assert len({x.file for x in got.values()}) == 20
    assert {i: x.refers_to for i, x in got.items()} == {i: None if i < 7 else i % 7 for i in range(60)}


def test_gif(spark, odd_docs):
    got = gif_media.media_features(odd_docs).collect()
    want = Counter()
    for x in same_texts(odd_docs):
        raw = (x.text or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[(x.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter(tuple(x)[:5] for x in got) == want
    assert len({tuple(x)[2:] for x in got if x.doc_id in (0, 5)}) == 1
    # Colours of what a viewer shows: each frame is laid over the last one.
    texts = {x.doc_id: (x.text or "").encode() for x in same_texts(odd_docs)}
    media = {x.doc_id: bytes(x.media) for x in gif_media.store_payloads(odd_docs).collect()}
    for x in got:
        p, shown, total = gif_media.payload(texts[x.doc_id]), bytearray(min(65536, x.payload_bytes)), np.zeros(gif_media.BINS, int)
        for at in range(0, len(p), 65536):
            shown[: len(p[at : at + 65536])] = p[at : at + 65536]
            total += np.bincount(np.frombuffer(shown, np.uint8) // (256 // gif_media.BINS), minlength=gif_media.BINS)
        n = -(-len(p) // 65536)
        assert x.feature == f"frames={n};ms={100 * n};rgb=" + ",".join(map(str, total.tolist() * 3))
        assert (x.media_bytes, x.media_sha256) == (len(media[x.doc_id]), hashlib.sha256(media[x.doc_id]).hexdigest())
    stored = gif_media.store_payloads(odd_docs.where("doc_id = 4"))
    frames = gif_media.frame_table(stored).orderBy("frame").collect()
    assert len(frames) == -(-got[[x.doc_id for x in got].index(4)].payload_bytes // 65536)
    assert frames[1].start_ms == frames[0].delay_ms == 100 and sum(frames[0].histogram) == 3 * 64 * 1024
    assert gif_media.media_features(odd_docs.limit(0)).count() == 0


def test_token_counts(spark, odd_docs, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = scratch(spark, "cache")
    for df in (odd_docs, docs, odd_docs):
        got = token_counts.count_tokens(df, PIECES, cache, limit=50).collect()
        want = Counter((x.doc_id, len((x.text or "").encode()), n := len(model.encode(x.text or "")), n > 50) for x in same_texts(df))
        assert Counter(map(tuple, got)) == want
    stored = spark.read.parquet(cache)
    texts = {x.text or "" for df in (odd_docs, docs) for x in same_texts(df)}
    assert stored.count() == stored.select("digest").distinct().count() == len(texts)
    assert token_counts.count_tokens(odd_docs.limit(0), PIECES, cache).count() == 0
    # Of equal texts one is encoded, whatever their ids: each text that is encoded is a row of the store.
    many = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("all the same")).otherwise(F.concat(F.lit("word "), F.col("id") % 10)).alias("text"))
    cache = scratch(spark, "cache")
    assert token_counts.count_tokens(many.repartition(7), PIECES, cache).count() == 2000
    assert spark.read.parquet(cache).count() == 6


def test_quality(spark, odd_docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {x.doc_id: x for x in quality.resample(many, labels).collect()}
    marks = {x.doc_id: x.quality for x in labels.collect()}
    good = [got[i].selected for i, q in marks.items() if q]
    bad = [got[i].selected for i, q in marks.items() if not q]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)
    again = {x.doc_id: x.selected for x in quality.resample(many, labels).collect()}
    assert again == {i: x.selected for i, x in got.items()}
    picked = quality.select(clashing(many), labels)
    assert picked.columns == clashing(many).columns and {x.doc_id for x in picked.select("doc_id").collect()} == {i for i, x in got.items() if x.selected}
    # k rows, those of the largest keys, which aren't those above the cut.
    for k, share in ((10, None), (600, None), (None, 0.7)):
        rows = quality.resample(many, labels, k=k, share=share).collect()
        n = k or round(0.7 * sum(x.n_features > 0 for x in rows))
        assert sorted((x.sample_key for x in rows if x.selected), reverse=True) == sorted((x.sample_key for x in rows), reverse=True)[:n]
        assert any(x.above_cut and not x.selected for x in rows)
    odd_labels = clashing(spark.createDataFrame([(0, 1), (0, 0), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, quality int"))
    out = quality.resample(odd_docs, odd_labels).collect()
    assert len(out) == odd_docs.count() and not any(x.selected for x in out if x.doc_id in (1, 2, 3))
    assert quality.resample(odd_docs, odd_labels.limit(0)).count() == odd_docs.count()
    assert quality.resample(odd_docs.limit(0), odd_labels).count() == 0


def test_quality_gathers_one_row_of_a_label(spark, monkeypatch):
    """However many rows share a labelled doc_id."""
    docs = spark.range(0, 4000, 1, 4).select(F.least("id", F.lit(9)).alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 13).alias("text"))
    labels = spark.createDataFrame([(i, int(i > 4)) for i in range(10)], "doc_id long, quality int")
    seen, cut = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda good, bad, keep: seen.append((len(good), len(bad))) or cut(good, bad, keep))
    quality.fit(docs, labels)
    assert seen == [(5, 5)]


def test_quality_weights(spark):
    """Against two dictionaries of counts, and draws against the weights."""
    rng = random.Random(5)
    good = [" ".join(rng.choice("the a cat dog sat on mat runs, 12 NOT and _x é".split()) for _ in range(rng.randint(3, 30))) for _ in range(40)]
    bad = [" ".join(rng.choice("BUY now now !!! $$$ 99 cheap the http://x.y click".split()) for _ in range(rng.randint(3, 30))) for _ in range(20)]
    texts = dict(enumerate([*good, *bad, "", None, "  "]))
    marks = {i: int(i < 40) for i in range(0, 60, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    model = quality.fit(docs, spark.createDataFrame(list(marks.items()), "doc_id long, quality int"), buckets=1 << 22)

    def grams(text):
        raw = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\t-\r]+", (text or "").encode())
        low = [re.sub(rb"[0-9]", b"0", x.lower()) for x in raw]
        said = [b"<again>" if x in low[max(0, i - 2) : i] else b"<capitals>" if len(raw[i]) > 1 and re.fullmatch(rb"[A-Z]+", raw[i]) else x for i, x in enumerate(low)]
        return [(x,) for x in said] + list(zip(said[:-1], said[1:]))

    every, best = Counter(x for t in texts.values() for x in grams(t)), Counter(x for i, q in marks.items() if q for x in grams(texts[i]))
    ratio = {x: np.log((best[x] + 1) / (best.total() + (1 << 22))) - np.log((n + 1) / (every.total() + (1 << 22))) for x, n in every.items()}
    got = {x.doc_id: x for x in quality.score(docs, model).collect()}
    for i, t in texts.items():
        g = grams(t)
        want = (np.mean([ratio[x] for x in g]) - model.cut) * quality.LENGTH if g else 0.0
        assert got[i].n_features == len(g) and abs(got[i].log_weight - want) < 1e-6 * (1 + abs(want))
    # One text drawn, many times: as often as its share of all weights.
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(6)), pa.array(good[:6])], ["doc_id", "text"])
    flat = model._replace(log_ratio=model.log_ratio / 40)
    drawn, weight = Counter(), None
    for seed in range(6000):
        (out,) = quality._score(flat, seed * 7919 + 1, 1.0)(iter([batch]))
        weight = out.column("log_weight").to_numpy()
        drawn[int(np.argmax(out.column("sample_key").to_numpy()))] += 1
    share = np.exp(weight - weight.max()) / np.exp(weight - weight.max()).sum()
    assert all(abs(drawn[i] / 6000 - share[i]) < 0.03 for i in range(6)) and len(drawn) > 2


def test_quality_kth(spark):
    rng = random.Random(1)
    values = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(300)] + [5, 5, 5, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "key_order long")
    for k in (1, 2, 100, 303, 305):
        assert quality.kth(df, k) == sorted(values, reverse=True)[k - 1]


def test_language(spark, odd_docs):
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {x.doc_id: x.lang for x in many.collect()}
    got = langid.identify(many).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out]
    assert len(held) > 200 and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.99 * len(held)
    # Labels of what is held out don't matter.
    changed = many.withColumn("lang", F.when(langid.fold(F.col("doc_id")) == 2, "xx").otherwise(F.col("lang")))
    assert {(x.doc_id, x.lang_pred) for x in langid.identify(changed).collect()} == {(x.doc_id, x.lang_pred) for x in got}
    out = langid.identify(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(x.lang_pred == "und" and x.score == 0 for x in out if x.doc_id in (1, 2, 3, 7))
    assert langid.predict(odd_docs, langid.fit(odd_docs)).columns[-2:] == ["lang_pred", "score"]
    assert langid.identify(odd_docs.limit(0)).count() == 0
    unlearned = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in unlearned} == {"und"}


def test_many_languages(spark):
    """More languages than a word has bits, against sets of n-grams."""
    rng = random.Random(8)
    words = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(30)] for i in range(70)}
    rows = [(i, " ".join(rng.choice(words[name]) for _ in range(25)), name) for i, name in enumerate(sorted(words) * 6)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    got = {x.doc_id: x for x in langid.predict(docs, langid.fit(docs)).collect()}

    def grams(text):
        t = " " + " ".join(text.split()) + " "
        return [t[k : k + 4] for k in range(len(t) - 3)]

    n = defaultdict(Counter)
    for _, t, name in rows:
        n[name].update(grams(t))
    rate = {name: {g: x / c.total() for g, x in c.items()} for name, c in n.items()}
    most = Counter()
    for r in rate.values():
        for g, p in r.items():
            most[g] = max(most[g], p)
    holds = {name: {g for g, p in r.items() if p >= langid.LEAST and p >= langid.SHARE * most[g]} for name, r in rate.items()}
    for i, t, name in rows:
        hits = {x: sum(g in held for g in grams(t)) for x, held in holds.items()}
        best = max(sorted(hits), key=hits.get)
        assert got[i].lang_pred == best == name and abs(got[i].score - hits[best] / sum(hits.values())) < 0.02


def test_top_k(spark):
    duck = oracle.connect(SF)
    assert oracle.spark_rows(queries.op8_topk(spark, SF)) == oracle.duck_rows(duck, topk.SQL)
    rng = random.Random(1)
    rows = [(i, [round(rng.choice([-1, 0, 1]) * rng.random(), 1) for _ in range(3)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0]), (62, [float("nan"), 0.0, 0.0]), (63, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (7, rows[7][1])]
    vectors = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and i < 60]
    want = []
    for q, u in {i: v for i, v in good if i % 10 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in good if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    for block in (4096, 2):
        assert sorted(map(tuple, topk.search(vectors, vectors.where("vec_id % 10 = 0"), k=5, block=block).collect())) == sorted(want)
    # Empty vectors take no part; vectors of other lengths have no product with these.
    mixed = vectors.unionByName(clashing(spark.createDataFrame([(70, []), (71, [5.0, 5.0]), (72, [4.0, 1.0]), (80, [9.0, 9.0])], "vec_id long, embedding array<double>")))
    pairs = [(80, 1, 71, 5120 * 9216 * 2), (80, 2, 72, 5120 * 9216)]
    assert sorted(map(tuple, topk.search(mixed, mixed.where("vec_id % 10 = 0"), k=5).collect())) == sorted(want + pairs)
    few = vectors.where("vec_id < 3")
    assert topk.search(few, few, k=5).count() == 6
    assert topk.search(vectors.limit(0), vectors).count() == 0 == topk.search(vectors, vectors.limit(0)).count()


def _check_packing(got, texts, most=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    pieces = Counter()
    for x in texts:
        ids = np.array(t.encode(x.text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), most)):
            part = ids[at : at + most]
            pieces[(x.doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == pieces
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= most
    return len(by), sum(x.length for x in got) / most


def test_packing(spark, odd_docs, docs):
    used, least = _check_packing(packing.pack(docs, WORDS).collect(), same_texts(docs))
    assert used <= 1.02 * least + 2
    _check_packing(packing.pack(odd_docs, WORDS).collect(), same_texts(odd_docs))
    small = packing.pack(docs, WORDS, most=64, keep_ids=True).collect()
    used, least = _check_packing(small, same_texts(docs), 64)
    assert used <= 1.02 * least + 2 and all(len(x.ids) == 4 * x.length for x in small)
    assert packing.pack(odd_docs.limit(0), WORDS).count() == 0


def brute_components(rows, k, num, den):
    """By an inverted index over the shingles themselves."""
    sets, held = {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
        for x in sets[i]:
            held[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in held[x] if j > i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    rng = random.Random(3)
    texts = ["", None, "  ", "A b", "a B"]
    for n in [1, 2, 3, 5, 8, 12, 20, 30, 40, 60, 90, 150, 400] * 6:
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                p = rng.randrange(len(copy)) if copy else 0
                kind = rng.random()
                if kind < 0.4 and copy:
                    copy[p] = f"z{rng.randint(0, 9)}"
                elif kind < 0.7:
                    copy.insert(p, "y")
                elif copy:
                    del copy[p]
            texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("k,num,limit", [(3, 90, jaccard.LIMIT), (5, 80, 1500)])
def test_jaccard(spark, docs, k, num, limit):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(df, k, num, 100, limit).collect()}
    assert got == brute_components(rows, k, num, 100)


def test_a_large_group_of_near_copies(spark):
    """Copies of which most are similar to the original alone, copies without an original, and texts that share passages."""
    rng = random.Random(11)
    rows, word = [], lambda: rng.choice("abcdefgh") + str(rng.randint(0, 999))
    passage = [word() for _ in range(60)]
    base, lost = ([word() for _ in range(120)] for _ in range(2))
    rows.append(base)
    for text, n, changes in ((base, 1500, 2), (lost, 300, 3)):
        for _ in range(n):
            copy = list(text)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = word()
            rows.append(copy)
    rows += [[*(word() for _ in range(rng.randint(0, 40))), *passage, *(word() for _ in range(rng.randint(0, 40)))] for _ in range(300)]
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_components(rows, 5, 80, 100)
    for limit in (jaccard.LIMIT, 20_000):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(df, 5, 80, 100, limit).collect()} == want


def test_jaccard_cases(spark, odd_docs):
    got = jaccard.join(odd_docs, 3, 90).collect()
    assert len(got) == odd_docs.count()
    by = {x.doc_id: x for x in got}
    assert by[5].component_id == 0 and by[9].component_id == 6 and by[1].component_id == 1 and by[1].n_shingles == 0
    assert by[None].component_id is None
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(x.doc_id for x in kept.select("doc_id").collect() if x.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8]
    # Rows without ids, and ids with several texts: one row of each group stays, and nothing else goes.
    texts = ["a b c d e f g", "a b c d e f g", "h i j k l m n", "o p q", "h i j k l m n", None, None]
    for ids in ([None] * 7, [1] * 7, [4, 4, None, 4, 4, 4, None]):
        rows = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(zip(ids, texts))], "doc_id long, text string, file int").repartition(3)
        left = jaccard.keep_one(rows).collect()
        assert sorted(str(x.text) for x in left) == sorted(str(x) for x in [texts[0], texts[2], texts[3], None, None])
    assert jaccard.join(odd_docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {x.node: x.root for x in jaccard.components(spark.createDataFrame(links, "a long, b long"), scratch(spark, "cc")).collect()}
    assert got == {x: find(x) for x in linked}


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {x.page_id: x for x in html_extract.extract(pages).collect()}
    import html

    for p in pages.collect():
        body = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        text = "\n\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (text, len(text), p.url)


def test_style_tree(spark):
    rng = random.Random(1)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    bodies = [(words(4), words(30), words(20)) for _ in range(30)]
    rows = [(i, f"http://x.example/{i}", f"<body><div class=top><a>Home</a> <a>About</a></div><div class=body><h1>{a}</h1><p>{b}<p>{c}</div><div class=bottom>Copyright</div>") for i, (a, b, c) in enumerate(bodies)]
    rows += [(90, None, None), (91, None, "<p>alone</p>"), (92, "http://y/", "<div>Copyright</div>"), (None, "http://z/", ""), (91, None, "<p>alone</p>")]
    got = html_extract.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(got) == len(rows)
    by = {x.page_id: x.text for x in got}
    assert all(by[i] == "\n\n".join(b) for i, b in enumerate(bodies))
    assert by[90] == by[None] == "" and by[91] == "alone" and by[92] == "Copyright"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_and_articles(spark):
    rng = random.Random(2)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    bodies = [(words(30), words(20), words(15), words(3)) for _ in range(40)]
    page = "<body><div class=x1><a href=/>{3}</a></div><article><p>{0}<p>Read us daily<div class=x2>Follow us</div><p>{1}</article><div class=x3>{2}</div><div class=x4>Imprint</div>"
    rows = [(i, f"http://x.example/{i}", page.format(*b)) for i, b in enumerate(bodies)]
    text, card = words(200), "<article><a href=/x>teaser</a></article>"
    rows += [(100, "http://y.example/", f"<body><div class=body>{text}</div>{card * 3}"), (101, "http://y.example/2", "<article>in</article><div>out</div>")]
    rows += [(200 + i, f"http://copies.example/{i}", "<article><p>the same</article>") for i in range(40)]
    by = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[i] == "\n\n".join(b[:3]) for i, b in enumerate(bodies))
    assert by[100] == text and by[101] == "in" and all(by[200 + i] == "the same" for i in range(40))


def test_queries_are_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    assert os.path.exists(Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
