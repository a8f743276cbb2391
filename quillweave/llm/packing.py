"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Documents are cut into pieces of at most a sequence's length. Their lengths' histogram, at most as many numbers as a
sequence has tokens, is all that the driver sees: it enumerates patterns of few lengths that fill a sequence, fits
the patterns' repeat counts to the histogram by non-negative least squares, rounds the counts down, and packs what
they leave over by best fit, largest first, into the gaps left and new sequences. The plan says for each length which
ranks of that length go to which sequences; pieces find their places from their rank alone.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH, arrow, scratch, slices, table, utf8

SEQUENCE = 2048
#: Tokens of a unit in which patterns are enumerated.
UNIT = 8
#: Documents in a pattern.
DEPTH = 3
#: Bytes of words and ids that a worker remembers.
MEMO = 24 << 20
#: A word that is put between others to find where their ids end, and how many of them make a text.
MARK, JOINED = "\x01", 128


class WordIds:
    """The ids of texts, little-endian unsigned 32-bit, as a tokenizers file gives them, looked up word by word.

    Where the file's tokenizer splits at ASCII white space, a text's ids are those of its words; this is tried on
    probes, and if they differ texts are encoded whole. Words of many texts are told apart and looked up as columns.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        # Only a word that holds the mark's byte can have an id that stands for it.
        mark = self.tokenizer.encode(f"a {MARK} b", add_special_tokens=False)
        at = [i for i, (x, y) in zip(mark.ids, mark.offsets) if MARK in f"a {MARK} b"[x:y]]
        self.mark = at[0] if len(at) == 1 and len(mark.ids) == 3 else None
        self.by_word = True
        probes = ["", " ", "a b", "A  b\n\nc's", " don't\tSTOP, it's \x0b1st\x0c2nd\r\n", "é é ́x", "<|endoftext|> x<|startoftext|>y <|end", "<|ENDOFTEXT|> x<|EndOfText|>y <|Startoftext|>.", "x'Re 12 a1b2 ...", "Ünï,cödé! word.'s", "a\u3000b \u0301 \ufeff c", "\x01 a\x01b \x01\x01 c"]
        said, got = self.whole(probes), self.ids([x.encode() for x in probes])
        self.by_word = said == got
        self.forget()

    def forget(self) -> None:
        self.words, self.known = pa.array([""]), pa.array([b""], pa.large_binary())

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of words: many are encoded as one text, with marks between them."""
        out: list[bytes] = []
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            text = f" {MARK} ".join(some)
            if self.mark is None or text.count(MARK) >= len(some):
                out += self.whole(some)
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in ends)], [*ends, len(ids)])]
        return out

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of different words are known."""
        at = pc.index_in(words, self.words).fill_null(-1).to_numpy().astype(np.int64)
        miss = at < 0
        if miss.any():
            new = words.filter(pa.array(miss))
            if self.words.nbytes + self.known.nbytes + 3 * new.nbytes > MEMO:  # only what is needed now stays
                keep = np.concatenate([[0], at[~miss]])
                at[~miss] = np.arange(1, len(keep))
                self.words, self.known = self.words.take(pa.array(keep)), self.known.take(pa.array(keep))
            at[miss] = len(self.words) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, pa.array(self.learn(new.to_pylist()), pa.large_binary())])
            self.words = pa.concat_arrays([self.words, new])
        return at

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self.whole([x.decode() for x in texts])
        rows = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        words = rows.values.dictionary_encode()
        at = self.places(words.dictionary)
        found = self.known.take(pa.array(at[words.indices.to_numpy()]))
        data = found.buffers()[2]
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1][rows.offsets.to_numpy()].tolist()
        raw = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(raw[i:j]) for i, j in zip(ends[:-1], ends[1:])]


_CODERS: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def _pieces(path: str, most: int, end: int, keep: bool):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seen = coder(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            docs = batch.column("doc_id")
            for i, j in slices(offsets, BATCH):
                rows, kept = [], []
                for doc, ids in zip(docs.slice(i, j - i).to_pylist(), code.ids([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)])):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * most)):
                        piece = ids[at : at + 4 * most]
                        n = len(piece) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                        seen[n] += 1
                        if keep:
                            kept.append(piece)
                cols = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.record_batch(cols + [pa.array(kept, pa.binary())] * keep, names + ["ids"] * keep)

    return run


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active set method of Lawson and Hanson."""
    n = a.shape[1]
    right = a.T @ b
    x, on = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        slope = right - a.T @ (a[:, on] @ x[on])
        slope[on] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        on[best] = True
        while True:
            cols = np.flatnonzero(on)
            used = a[:, cols]
            try:  # columns of a few small counts: normal equations are good enough, and fast
                s = np.linalg.solve(used.T @ used, right[cols])
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(used, b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[cols] = s
                break
            low = s <= 0
            step = np.min(x[cols][low] / np.maximum(x[cols][low] - s[low], 1e-300))
            x[cols] += step * (s - x[cols])
            off = cols[low & (x[cols] <= 1e-12)] if (x[cols][low] <= 1e-12).any() else cols[low][:1]
            x[off] = 0
            on[off] = False
            if not on.any():
                break
    return x


def patterns(units: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to write units as a sum of at most depth positive whole numbers, largest first."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, room: int, so_far: tuple[int, ...]) -> None:
        if not left:
            out.append(so_far)
        elif room:
            for x in range(min(left, most), -(-left // room) - 1, -1):
                grow(left - x, x, room - 1, (*so_far, x))

    grow(units, units, depth, ())
    return out


def plan(histogram: dict[int, int], most: int = SEQUENCE, unit: int = UNIT, depth: int = DEPTH) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, count, first sequence, offset): where the pieces of each length go.

    The piece of rank from + i goes to sequence first + i, at offset; a sequence's pieces leave no gap between them.
    """
    unit = max(1, min(unit, most // 2))
    units = -(-most // unit)
    shelves: dict[int, list[list[int]]] = defaultdict(list)  # by units: [length, next rank, left], longest first
    for length in sorted(histogram, reverse=True):
        if histogram[length]:
            shelves[-(-length // unit)].append([length, 0, histogram[length]])
    counts = np.array([sum(x[2] for x in shelves[u]) for u in range(1, units + 1)], float)
    ways = patterns(units, depth)
    fit = np.zeros((units, len(ways)))
    for k, way in enumerate(ways):
        for u in way:
            fit[u - 1, k] += 1
    # A long piece that no pattern takes costs more than a short one, which still fits into a gap.
    weight = np.sqrt(np.arange(1, units + 1) / units)
    repeats = np.floor(nnls(fit * weight[:, None], counts * weight) + 1e-9).astype(int)
    runs: list[tuple[int, list[tuple[int, int]]]] = []  # sequences, [(length, from rank)]

    def draw(u: int, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            shelf = shelves[u][0]
            k = min(n, shelf[2])
            out.append((shelf[0], shelf[1], k))
            shelf[1], shelf[2], n = shelf[1] + k, shelf[2] - k, n - k
            if not shelf[2]:
                shelves[u].pop(0)
        return out

    for k in sorted(np.flatnonzero(repeats), key=lambda k: ways[k], reverse=True):
        way = ways[k]
        n = min(int(repeats[k]), *(sum(x[2] for x in shelves[u]) // way.count(u) for u in set(way)))
        slots = [draw(u, n) for u in way] if n > 0 else []
        while n > 0:  # as many sequences as have the same lengths in all their slots
            same = min(slot[0][2] for slot in slots)
            runs.append((same, [slot[0][:2] for slot in slots]))
            for slot in slots:
                length, rank, left = slot[0]
                slot[:1] = [(length, rank + same, left - same)] if left > same else []
            n -= same
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    open_gaps: list[int] = []

    def leave(gap: int, run: tuple[int, list[tuple[int, int]]]) -> None:
        if not gaps[gap]:
            insort(open_gaps, gap)
        gaps[gap].append(run)

    for run in runs:
        leave(most - sum(x[0] for x in run[1]), run)
    for length, rank, left in sorted((x for u in shelves for x in shelves[u]), reverse=True):
        while left:
            at = bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                n, items = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
                k = min(n, left)
                if n > k:
                    leave(gap, (n - k, [(x, r + k) for x, r in items]))
                leave(gap - length, (k, [*items, (length, rank)]))
            else:
                each = most // length
                k = left // each if left >= each else 1
                each = min(each, left)
                leave(most - each * length, (k, [(length, rank + i * k) for i in range(each)]))
                k *= each
            rank, left = rank + k, left - k
    out, sequence = [], 0
    for gap in sorted(gaps):
        for n, items in gaps[gap]:
            at = 0
            for length, rank in items:
                out.append((length, rank, n, sequence, at))
                at += length
            sequence += n
    return out


def _place(steps: list[tuple[int, int, int, int, int]]):
    rows = np.array(sorted(steps), np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lengths are far below 2**20 and ranks below 2**43: one number orders (length, rank).
        starts = rows[:, 0] << 43 | rows[:, 1]
        for batch in batches:
            key = batch.column("length").to_numpy() << 43 | batch.column("rank").to_numpy()
            step = rows[np.searchsorted(starts, key, side="right") - 1]
            names = [x for x in batch.schema.names if x != "rank"]
            more = [pa.array(step[:, 3] + batch.column("rank").to_numpy() - step[:, 1]), pa.array(step[:, 4])]
            yield pa.record_batch([batch.column(x) for x in names] + more, [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, most: int = SEQUENCE, end: int = 0, unit: int = UNIT, depth: int = DEPTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of docs (doc_id, text).

    A document is its text's ids without special tokens, then the id end; longer ones are cut every most ids. keep_ids
    adds the piece's ids (binary, little-endian unsigned 32-bit), from which sequences are put together. A null or
    empty text is the end id alone, a very long one many pieces; repeated rows are packed each; an empty table gives an
    empty result; other columns, of whatever name, are ignored. The driver gets the histogram (at most most rows) and makes a plan bounded by it.
    """
    spark = docs.sparkSession
    home = scratch(spark, "pack")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * keep_ids
    pieces = table(docs.select("doc_id", "text").transform(arrow, _pieces(path, most, end, keep_ids), schema), f"{home}/pieces")
    counts = table(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), f"{home}/counts")
    steps = plan({x.length: x.n for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, most, unit, depth)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = ranked.select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.transform(arrow, _place(steps), schema)
