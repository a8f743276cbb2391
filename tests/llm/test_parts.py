"""Functions of the operators, without Spark."""

import gzip
import html
import io
import itertools
import os
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillweave.llm import common, gif_media, html_extract, jaccard, langid, mixing, packing, quality, token_counts, topk, warc

ODD = st.lists(st.sampled_from([*" \t\n\r\x0b\x0c\x1c\x85\xa0abB.,'|s1éÉ\u0301ß▁，\u3000İΣ\u212a<|>&;", "<|endoftext|>", "don't", "THE", "  "]), max_size=30).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), max_size=6))
def test_words(texts):
    data, offsets = common.utf8(pa.array(texts, pa.string()))
    h, doc, n = common.words(data, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(common.WORD.encode(), (t or "").encode())]
    assert list(zip(doc.tolist(), n.tolist())) == [(i, len(w)) for i, w in want]
    assert len(set(h.tolist())) == len({w for _, w in want})


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_token_counts_are_the_library_s(texts):
    c = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert c.by_part and c.count([t.encode() for t in texts]) == [len(c.model.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_ids_are_the_library_s(texts):
    c = packing.coder(public_tokenizers.path("word_bpe_49k.json"))
    assert c.by_word and c.ids([t.encode() for t in texts]) == c.whole(texts)


def test_special_tokens_in_other_cases():
    c = packing.coder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["<|ENDOFTEXT|>", "x<|EndOfText|>y", "a <|StartOfText|>, <|startoftext|>. B<|ENDOFTEXT|><|endoftext|>C", "<|END OF<|"]
    assert c.by_word and c.ids([t.encode() for t in texts]) == c.whole(texts)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 50)
    monkeypatch.setattr(packing, "MEMO", 50)
    texts = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(6)]
    c = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert c.count([t.encode() for t in texts]) == c.whole(texts)
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert w.ids([t.encode() for t in texts]) == w.whole(texts)


def test_marks_inside_words():
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["\x01", "a \x01 b", "x\x01y z", " \x01\x01 ", " ".join(f"w{i}" for i in range(1000)) + " \x01. end"]
    assert w.mark is not None and w.ids([t.encode() for t in texts]) == w.whole(texts)
    w.mark = None  # a tokenizer without a mark of one id
    w.forget()
    assert w.ids([t.encode() for t in texts]) == w.whole(texts)


def test_targets():
    assert mixing.targets([]) == []
    got = dict(mixing.targets([("b", 100), ("a", 100), (None, 100), ("c", 100)]))
    # a 3, b 1, c 2, none 3 of 600 words; 200 at most each.
    assert got["a"] == got[None] == 200 and got["b"] + got["c"] == 200 and got["c"] == 2 * got["b"]
    rng = random.Random(2)
    for _ in range(200):
        sizes = [(f"s{i}", rng.choice([0, 1, 5, 1000, rng.randint(0, 10**6)])) for i in range(rng.randint(1, 12))]
        out = mixing.targets(sizes)
        total = sum(s for _, s in sizes)
        assert sum(t for _, t in out) == pytest.approx(1.5 * total)
        held = dict(sizes)
        assert all(t <= 2 * held[n] * (1 + 1e-12) for n, t in out)
        weight = {n: (3, 1, 2)[i % 3] for i, (n, _) in enumerate(sorted(sizes))}
        free = [t / weight[n] for n, t in out if t < 2 * held[n] * (1 - 1e-9)]
        assert not free or max(free) == pytest.approx(min(free))


def _arc(version, gz):
    block = b"HTTP/1.1 200 OK\r\nX-Row-Id: 7\r\n\r\n<p>\n\n</p>"
    names = " ".join(warc._FIELDS[version])
    text = f"{version} 0 here\n{names}\n".encode()
    more = b" 200 - - 0 f" if version == "2" else b""
    parts = [b"filedesc://f 0.0.0.0 20040102030405 text/plain" + more + b" %d\n" % len(text) + text + b"\n"]
    parts += [b"http://a/ 1.2.3.4 20040102 text/html" + more + b" %d\n" % len(block) + block + b"\n", b"dns:a 1.2.3.4 2004 text/dns" + more + b" 3\nabc\n"]
    return b"".join(gzip.compress(p) if gz else p for p in parts), block


@pytest.mark.parametrize("version,gz", list(itertools.product("12", (False, True))))
def test_arc_records(version, gz):
    raw, block = _arc(version, gz)
    for size in (1 << 20, 7):
        f = io.BytesIO(raw)
        got = list(warc.arc_records(lambda n: f.read(min(n, size)), gz))
        assert [r.block for r in got][1:] == [block, b"abc"] and [r.fields["URL"] for r in got][1:] == ["http://a/", "dns:a"]
        assert got[0].offset == 0 and (gz or raw[got[1].offset :].startswith(b"http://a/"))
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(raw[:-4]).read, gz)) and list(warc.arc_records(io.BytesIO(raw[: len(raw) // 2]).read, gz))
    assert list(warc.arc_records(io.BytesIO(b"").read, gz)) == []


def test_warc_parts():
    assert warc.warc_date("20040102030405") == "2004-01-02T03:04:05Z" and warc.warc_date("2004") == "2004-01-01T00:00:00Z" and warc.warc_date("-") == "1970-01-01T00:00:00Z"
    assert warc.split_http(b"HTTP/1.0 200\n\nx") == (b"HTTP/1.0 200\n\n", b"x") and warc.split_http(b"x") == (b"", b"x")
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    member = warc.gzip(warc.warc_record("resource", [("WARC-Target-URI", "x: y")], b"\r\n\r\n"))
    assert list(warc.warc_records(io.BytesIO(member * 2).read)) == [({"WARC-Type": "resource", "WARC-Target-URI": "x: y", "Content-Length": "4"}, b"\r\n\r\n")] * 2


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_gif_round_trip(data, repeat):
    payload = gif_media.payload(data * repeat)
    media = gif_media.encode(payload, rows=100)
    assert b"".join(f.samples.tobytes() for f in gif_media.frames(media)) == payload
    assert gif_media.digest(media)[0] == len(payload)


def _gif(frames, size=(4, 2), palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff"):
    out = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + b"\x81\0\0" + palette
    for box, samples, disposal, hidden, own, interlaced in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (hidden is not None), 7, 0, hidden or 0, 0])
        out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in box) + bytes([(0x81 if own else 0) | 0x40 * interlaced]) + (own or b"")
        out += b"\x08" + gif_media._blocks(gif_media.lzw_encode(bytes(samples)))
    return out + b"\x21\xfe\x02hi\0\x3b"


def test_gif_rules():
    red, green, blue, black = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    own = b"\0\0\xff" * 4
    media = _gif([((0, 0, 4, 2), [1] * 8, 1, None, None, 0), ((1, 0, 2, 1), [2, 0], 2, 0, None, 0), ((0, 0, 1, 1), [1], 3, None, own, 0), ((3, 1, 1, 1), [3], 1, None, None, 0)])
    shown = [f.canvas.tolist() for f in map(lambda f: f._replace(canvas=f.canvas.copy()), gif_media.frames(media))]
    assert shown[0] == [[red] * 4] * 2
    assert shown[1] == [[red, green, red, red], [red] * 4]  # sample 0 is transparent
    assert shown[2] == [[blue, black, black, red], [red] * 4]  # the second frame's box is background again
    assert shown[3] == [[red, black, black, red], [red, red, red, blue]]  # the third frame is taken back
    rows = [[i] * 4 for i in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    f = next(gif_media.frames(_gif([((0, 0, 4, 9), sum((rows[i] for i in order), []), 0, None, None, 1)], (4, 9), bytes(12))))
    assert f.samples.tolist() == rows and f.delay_ms == 70
    assert gif_media.histogram(np.zeros((2, 2, 3), np.uint8)).tolist() == [4, 0, 0, 0, 0, 0, 0, 0] * 3
    with pytest.raises(ValueError):
        list(gif_media.frames(b"no gif"))
    # A reader must take streams that go on with a full table, as some writers leave it.
    data = os.urandom(20000)
    assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8, len(data)) == data


def test_html_cases():
    t = html_extract.main_text
    assert t("") == "" and t("plain & text &lt;x&gt; < 3") == "plain & text <x> < 3"
    assert t("<p>a<!-- x --><script>\"</p>\"</script>b<div>c&nbsp;d\n e</div><table><tr><td>1<td>2</table>") == "ab\n\nc d e\n\n1\n\n2"
    page = '<body class="no-sidebar"><div class="wrap sidebar-left"><header>S</header><main><header><h1>T&eacute;</h1></header><p>a <i>b</i>c<p><b>x<br><p>y<ul><li>1<li>2</ul><div id="comments"><article class=comment>no</article></div><form>f</form><div class="ad">no</div><aside>no</aside></main></div><footer>f'
    assert t(page) == "Té\n\na bc\n\nx\n\ny\n\n1\n\n2"
    assert t("<article><p>in</article><p>out") == "in" and t("<div hidden>no</div><p>yes") == "yes"
    assert t("<article>x" + "<div>" * 3000 + "deep") == "x\n\ndeep"


def test_html_names_and_articles():
    t = html_extract.main_text
    for wrap in ('<div class="layout with-ads">{}</div>', '<div class="has-comments">{}</div>', '<form id=f>{}</form>', '<div class="ads">{}</div>'):
        assert t(wrap.format('<article class="post category-social"><p>text of it</p></article>') + "<p>x") == "text of it"
    assert t('<article class="social"><div class="entry-header"><h1>T</h1></div><div class="header">h</div><p>a</article>') == "T\n\nh\n\na"
    assert t("<article><p>E <math><mi>m</mi><annotation>tex</annotation></math> c</article>") == "E m c"
    assert t('<div class="has-comments"><div>a long text</div></div><div class="ad">no</div><div class="top-nav">no</div>') == "a long text"
    page = "<main><p>text</p><div class=sidebar>no</div></main><div class=comments><article>no</article></div>"
    assert t(page) == "text"


def test_deep_pages_take_time_in_proportion():
    import time

    for page in ("<ul><li>" * 20_000 + "word", "<div>" * 20_000 + "</p>" * 20_000 + "<p>word" * 20_000):
        start = time.process_time()
        assert "word" in html_extract.main_text(page)
        assert time.process_time() - start < 10


def test_html_host():
    assert html_extract.host("https://u@A.b:80/x") == "a.b" and html_extract.host(None) == "" and html_extract.host("x/y") == ""


def test_lang_grams():
    h, doc, has = langid.grams(["Ab", "a-b", "", "12", " ab "])
    assert has.tolist() == [True, True, False, False, True]
    one = h[doc == 0].tolist()
    assert one == h[doc == 4].tolist() and len(one) == 1 and (doc == 1).sum() == 2


def test_cut():
    assert quality.cut(np.array([]), np.array([1.0]), 0.9) == 0
    good, bad = np.arange(100) + 50.0, np.arange(60) * 1.0
    c = quality.cut(good, bad, 0.95)
    assert (good >= c).mean() >= 0.95 and (bad >= c).mean() <= 0.1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20))
def test_plan_places_everything(histogram):
    steps = packing.plan(histogram, 64, 4, 3)
    filled, used = {}, {k: [] for k in histogram}
    for length, rank, n, first, at in steps:
        for i in range(n):
            used[length].append(rank + i)
            filled.setdefault(first + i, []).append((at, length))
    assert all(sorted(v) == list(range(histogram[k])) for k, v in used.items())
    for parts in filled.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    total = sum(k * v for k, v in histogram.items())
    assert len(filled) <= 1 + total * 2 / 64


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((20, 8)), np.maximum(0, rng.standard_normal(8))
    assert np.allclose(packing.nnls(a, a @ x), x)
    got = packing.nnls(a, -np.ones(20))
    assert (got == 0).all()
    assert packing.patterns(4, 3) == [(4,), (3, 1), (2, 2), (2, 1, 1)]


def test_products_are_exact():
    rng = random.Random(1)
    for size in (10**3, 10**8, 10**14):
        a, b = ([[float(rng.randint(-size, size)) for _ in range(6)] for _ in range(5)] for _ in range(2))
        want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert topk.product(np.array(a), np.array(b)).tolist() == want
    vectors = pa.array([[9.0], [0.5, -0.5], None, [1.0, None], [], [float("nan"), 1.0], [1.0]], pa.list_(pa.float64())).slice(1)
    assert [(at.tolist(), rows.tolist()) for at, rows in topk.quantised(vectors)] == [([5], [[1024]]), ([0], [[512, -512]])]


def test_signatures_meet():
    rng = random.Random(5)
    order = np.random.default_rng(5).integers(0, 4, 1 << 10).astype(np.uint8)
    for num in (80, 90):
        for _ in range(600):
            n = rng.choice([1, 2, 5, 10, 20, 31, 33, 36, 40, 60, 100, 300, 1500])
            a = np.array(sorted({rng.getrandbits(64) for _ in range(n)}), np.uint64)
            most = jaccard.differ(2 * n, num, 100)
            gone, more = rng.randint(0, most), rng.randint(0, most)
            b = np.unique(np.concatenate([rng.sample(a.tolist(), max(1, n - gone)), [rng.getrandbits(64) for _ in range(more)]]).astype(np.uint64)) if more else np.array(sorted(rng.sample(a.tolist(), max(1, n - gone))), np.uint64)
            if jaccard.similar(a, b, num, 100):
                assert np.intersect1d(jaccard.signatures(a, num, 100), jaccard.signatures(b, num, 100)).size
                assert np.intersect1d(jaccard.signatures(a, num, 100, order), jaccard.signatures(b, num, 100, order)).size


def test_tree_finds_what_brute_force_finds():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(200)]
    sets = [np.array(sorted({x if rng.random() > e else rng.getrandbits(64) for x in base}), np.uint64) for e in (0.01, 0.03, 0.06, 0.2) for _ in range(30)]
    points, sizes = [jaccard.point(s) for s in sets], np.array([len(s) for s in sets])
    assert all(jaccard.unpacked(jaccard.packed(p)).tolist() == p.tolist() and p.sum() == n for p, n in zip(points, sizes))
    flat = jaccard.Bounds(points).at[16 if min(sizes) < 128 else min(map(len, points))]
    tree = jaccard.RTree(flat, sizes, sizes)
    for i, s in enumerate(sets):
        near = set(tree.near(flat[i], len(s), len(s), 90, 100).tolist())
        assert {j for j, o in enumerate(sets) if jaccard.similar(s, o, 90, 100)} <= near
    # Boxes around two sets each are allowed wherever one of their sets is similar to one of the other's.
    high, low, up = np.maximum(flat[::2], flat[1::2]), np.minimum(sizes[::2], sizes[1::2]), np.maximum(sizes[::2], sizes[1::2])
    boxes = jaccard.RTree(high, low, up)
    for i in range(len(high)):
        near = set(boxes.near(high[i], int(low[i]), int(up[i]), 90, 100).tolist())
        assert {j for j in range(len(high)) if any(jaccard.similar(sets[x], sets[y], 90, 100) for x in (2 * i, 2 * i + 1) for y in (2 * j, 2 * j + 1))} <= near
    none, each = np.zeros(len(sets), int), np.arange(len(sets))
    links = jaccard.forest(points, sizes, sizes, none, each, 90, 100, sets)
    assert links and all(jaccard.similar(sets[i], sets[j], 90, 100) for i, j in links)
    assert len(links) <= len(jaccard.forest(points, sizes, sizes, none, each, 90, 100)) < len(sets)
    # Of rows connected already, only links between their groups.
    some = jaccard.forest(points, sizes, sizes, none, np.where(each < 30, 0, each), 90, 100, sets)
    assert some and not any(i < 30 and j < 30 for i, j in some)


def test_boxes_hold_their_points():
    rng = np.random.default_rng(1)
    rows = []
    for root in (3, 3, 3, 8, 9, 9):
        s = np.unique(rng.integers(0, 1 << 63, rng.integers(40, 300), dtype=np.uint64) * np.uint64(2))
        rows.append((root, len(s), len(s), jaccard.packed(jaccard.point(s))))
    batches = [pa.record_batch([pa.array(x, t) for x, t in zip(zip(*part), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["root", "low", "high", "data"]) for part in (rows[:2], rows[2:])]
    got = [x for b in jaccard._boxes(iter(batches)) for x in b.to_pylist()]
    assert [x["root"] for x in got] == [3, 8, 9]
    for x in got:
        box = jaccard.unpacked(x["data"])
        mine = [r for r in rows if r[0] == x["root"]]
        assert (x["low"], x["high"]) == (min(r[1] for r in mine), max(r[1] for r in mine))
        assert all((jaccard.coarse(jaccard.unpacked(r[3]), len(box)) <= box).all() for r in mine)


def test_shared_signs():
    rng = random.Random(2)
    for _ in range(60):
        rows = sorted((rng.randint(0, 12), rng.randint(0, 3)) for _ in range(rng.randint(1, 60)))
        cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), rng.randint(0, 6))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.record_batch([pa.array([x[0] for x in p], pa.int64()), pa.array([x[1] for x in p], pa.int64())], ["sign", "class"]) for p in parts]
        got = [x for b in jaccard._shared(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        several = {s for s, _ in rows if len({c for t, c in rows if t == s}) > 1}
        assert sorted(got) == sorted({x for x in rows if x[0] in several})


def test_unescape_is_complete():
    assert html_extract.main_text("<p>&amp;amp; &#233; &#xe9; &copy &bogus;") == html.unescape("&amp;amp; &#233; &#xe9; &copy &bogus;")
