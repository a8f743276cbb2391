"""Which tokens of two tokenizers stand for the same text, counted over a corpus with packed int64 pair keys.

Both tokenizers cut a text's bytes. Where tokens of both end, a group ends; all tokens A and B of a group are linked. A
pair of ids is one number, A's id in the upper 32 bits.
1. Tasks encode texts and store each document's distinct pairs with how often they are linked; np.unique counts in how many
   documents pairs occur, task by task.
2. The partial counts are sorted over all partitions by ranges of the key, and runs of equal keys are summed. Each partition
   writes a shard: its sorted keys and their counts, as two plain files in the folder that all machines share.
3. Tasks look up their documents' pairs in the shards, which are memory-mapped, by np.searchsorted.

Both tokenizers begin a token at a space after something else, so that groups don't span such places: a text is put
together from the parts between them, and parts seen before are looked up. That no piece of B's vocabulary spans the start
of a space, and that A's cuts are those of the known pattern, is tried on the files; else texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, filesystem, scratch, slices, table, utf8

#: Bytes of parts that a worker remembers, about; beyond it forgets all and starts anew.
MEMO = 64 << 20
#: Pairs that a worker holds before it counts them, and distinct ones before it sends its counts.
PAIRS, HELD = 1 << 19, 1 << 20
#: Pairs of tokens of a group from which on they are summed by id first.
LARGE = 4096
#: Parts that are encoded at a time as one text.
JOINED = 128
#: Shards of which a worker holds the bytes where they can't be mapped.
LOADED = 8
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")


class Part(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    keys: bytes  # pairs, int64; of a text distinct and sorted
    times: bytes  # how often each is linked, int64; nothing if once each


def _alphabet() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for t, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else b""  # of no text
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        said = [str(i).encode() for i in range(max(len(pieces), len(self.bytes_a)))]
        self.digits = np.array([len(x) for x in said])
        width = int(self.digits.max()) + 1
        self.shown = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in said), np.uint8).reshape(-1, width)
        self.memo: dict[str, tuple | None] = {}
        self.held = 0
        self.space = self.b.piece_to_id("▁")
        self.by_part = not any("▁" in p.lstrip("▁") or " " in p for p in pieces)
        probes = ["a b", " a", "a  b ", "\na \nb\t c  d 　e  ", "x's 12 3a don't , .", "<|endoftext|> é<|endoftext|>", "ﬁ １ Ω 😀 ́ ́x", "</s> <0x41> <unk>", " ", "  "]
        self.by_part = self.by_part and all(self.text(x) == self.whole(x) for x in probes)

    def covered(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the bytes of the tokens are the text's."""
        said = text.encode()
        return b"".join([self.bytes_a[i] for i in a]) == said and b"".join([self.bytes_b[i] for i in b]) == said

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, ends: np.ndarray) -> list[tuple] | None:
        """Parts that lie one after the other, end at these bytes, and are covered by tokens; None if tokens span an end."""
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        home = np.searchsorted(both, ends)
        if not np.array_equal(both[np.minimum(home, len(both) - 1)], ends):
            return None
        in_a, in_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        n_a, n_b = np.bincount(in_a, minlength=len(both)), np.bincount(in_b, minlength=len(both))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        last = home + 1  # the groups of a part end before it

        # Large groups, of few distinct ids, are summed before they are paired.
        large, extra = n_a * n_b > LARGE, {}
        for g in np.flatnonzero(large).tolist():
            (x, m), (y, n) = (np.unique(ids[at[g] : at[g] + k[g]], return_counts=True) for ids, at, k in ((ids_a, first_a, n_a), (ids_b, first_b, n_b)))
            extra.setdefault(int(np.searchsorted(last, g, side="right")), []).append(((x[:, None] << 32 | y).ravel(), (m[:, None] * n).ravel()))
        reach = np.where(large, 0, n_b)[in_a]
        at_a = np.repeat(np.arange(len(ids_a)), reach)
        at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(reach) - reach, reach) + first_b[in_a[at_a]]
        raw = (ids_a[at_a] << 32 | ids_b[at_b]).tobytes()

        def upto(n: np.ndarray, unit: int = 1) -> list[int]:
            return [0, *(unit * np.cumsum(n)[home]).tolist()]

        edges = upto(np.bincount(in_a, reach, len(both)).astype(np.int64), 8)
        keys, times = [raw[i:j] for i, j in zip(edges[:-1], edges[1:])], [b""] * len(ends)
        for i, found in extra.items():
            x, n = zip(*found, (np.frombuffer(keys[i], np.int64), np.ones(len(keys[i]) // 8, np.int64)))
            keys[i], times[i] = np.concatenate(x).tobytes(), np.concatenate(n).tobytes()

        # A's tokens of a group, then B's, each with what follows it.
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        place_a, place_b = np.arange(len(ids_a)) + first_b[in_a], np.arange(len(ids_b)) + (first_a + n_a)[in_b]
        ids[place_a], ids[place_b] = ids_a, ids_b
        ends_of = np.cumsum(n_a + n_b)
        mark[ends_of - n_b - 1], mark[ends_of - 1] = ord("|"), ord(";")
        shown, size = self.shown[ids], self.digits[ids]
        shown[np.arange(len(ids)), size] = mark
        shown = shown[shown != 0].tobytes()
        edges = [0, *np.cumsum(size + 1)[ends_of[home] - 1].tolist()]
        said = [shown[i : j - 1] for i, j in zip(edges[:-1], edges[1:])]
        counts = (np.diff(upto(x)).tolist() for x in (n_a, n_b, np.ones(len(both), np.int64), n_a * n_b))
        return list(zip(*counts, said, keys, times))

    def encoded_b(self, parts: list[str]) -> list[list[int]]:
        """B puts a space before what it encodes, but not before nothing."""
        return [x if p != " " else [self.space] for p, x in zip(parts, self.b.encode([p[1:] for p in parts], num_threads=1))]

    def made(self, text: str) -> tuple | None:
        """Of a text, its first space among it; None where the tokens' bytes aren't its own."""
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.encoded_b([text])[0]
        if not self.covered(text, a, b):
            return None
        return self.groups(np.array(a), np.array(b), np.array([len(text.encode())]))[0]

    def learn(self, parts: list[str]) -> dict[str, tuple | None]:
        """Parts are encoded many at a time, one after the other, except those that end in white space."""
        new = {p: self.made(p) for p in parts if p[-1].isspace()}
        plain = [p for p in parts if not p[-1].isspace()]
        some = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        texts = ["".join(x) for x in some]
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.encoded_b(texts)
        good = [i for i, x in enumerate(texts) if self.covered(x, a[i], b[i])]
        found = None
        if good:
            sizes = np.cumsum([len(p.encode()) for i in good for p in some[i]])
            found = self.groups(*(np.fromiter(chain.from_iterable(x[i] for i in good), np.int64) for x in (a, b)), sizes)
        if found is not None:
            new.update(zip((p for i in good for p in some[i]), found))
        new.update((p, self.made(p)) for p in plain if p not in new)
        size = sum(420 + 2 * len(p) + (len(x[4]) + len(x[5]) if x else 0) for p, x in new.items())
        if self.held + size > MEMO:
            self.memo, self.held = {}, 0
        self.held += size
        self.memo.update(new)
        return new

    def whole(self, text: str) -> Part | None:
        if not text or "▁" in text:  # a piece's mark of a space, whose bytes are then others
            return None
        return self.joined([self.made(" " + text)])

    @staticmethod
    def parts(text: str) -> list[str]:
        text = " " + text
        if _ODD.search(text) or text[-1] == " ":
            return _CUT.split(text)
        return [" " + x for x in text[1:].split(" ")]

    def text(self, text: str) -> Part | None:
        return self.texts([text])[0]

    def texts(self, texts: list[str]) -> list[Part | None]:
        if not self.by_part:
            return [self.whole(x) for x in texts]
        cut = [self.parts(x) if x and "▁" not in x else None for x in texts]
        known = self.memo
        new = {p for parts in cut if parts for p in parts if p not in known}
        if new:
            made = self.learn(list(new))
            if known is not self.memo:  # all was forgotten on the way
                known = known | made
        return [self.joined([known[p] for p in parts]) if parts else None for parts in cut]

    @staticmethod
    def joined(found: list[tuple | None]) -> Part | None:
        if None in found:
            return None
        a, b, groups, links, shown, keys, times = zip(*found)
        pairs = np.frombuffer(b"".join(keys), np.int64)
        if any(times):
            often = np.concatenate([np.frombuffer(t, np.int64) if t else np.ones(len(k) // 8, np.int64) for k, t in zip(keys, times)])
            pairs, at = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, at, often)
        else:
            pairs, n = np.unique(pairs, return_counts=True)
        return Part(sum(a), sum(b), sum(groups), sum(links), b";".join(shown), pairs.tobytes(), n.tobytes())


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


def _link(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b).texts
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                raw, at = data[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                found = align([raw[a:b].decode() for a, b in zip(at[:-1], at[1:])])
                counts = [pa.array([getattr(x, c) if x else 0 for x in found], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                shown = pa.array([hashlib.sha256(x.groups).hexdigest() if x else "" for x in found], pa.string())
                pairs = [pa.array([getattr(x, c) if x else b"" for x in found], pa.binary()) for c in ("keys", "times")]
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), *counts, shown, *pairs], [c.split()[0] for c in _LINKED.split(", ")])

    return run


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n: in how many of a task's documents a pair occurs; at most HELD distinct pairs are held."""
    _ALIGNERS.clear()  # what the worker remembers of texts has had its use
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting, size = [], 0

    def counted() -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate(waiting)
        return _counted(np.concatenate([keys, new]), np.concatenate([n, np.ones(len(new), np.int64)]))

    for batch in batches:
        data, offsets = utf8(batch.column("keys"))
        if offsets[-1] > offsets[0]:
            waiting.append(np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int64))
            size += len(waiting[-1])
        if size >= PAIRS:
            keys, n = counted()
            waiting, size = [], 0
            if len(keys) > HELD:
                yield pa.record_batch([pa.array(keys), pa.array(n)], ["pair", "n"])
                keys, n = keys[:0], n[:0]
    if waiting:
        keys, n = counted()
    for i in range(0, len(keys), 1 << 18):
        yield pa.record_batch([pa.array(keys[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)])], ["pair", "n"])


def _shard(home: str):
    """Writes a sorted partition's keys and counts, equal keys summed; gives the shard's name, its first key and, for each id
    of A, the largest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(home)
        name, out, first, held = uuid.uuid4().hex, None, 0, None
        ids, tops = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def put(keys: np.ndarray, n: np.ndarray) -> None:
            nonlocal out, first, ids, tops
            if not len(keys):
                return
            if out is None:
                files.create_dir(base, recursive=True)
                out, first = [files.open_output_stream(f"{base}/{name}.{x}") for x in ("keys", "counts")], int(keys[0])
            out[0].write(keys.astype("<i8").tobytes())
            out[1].write(n.astype("<i8").tobytes())
            of = np.concatenate([ids, keys >> 32])
            some, at = np.unique(of, return_inverse=True)
            best = np.zeros(len(some), np.int64)
            np.maximum.at(best, at, np.concatenate([tops, n]))
            ids, tops = some, best

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = _counted(batch.column("pair").to_numpy(), batch.column("n").to_numpy())
            if held is not None:
                keys, n = _counted(np.concatenate([held[0], keys]), np.concatenate([held[1], n]))
            put(keys[:-1], n[:-1])
            held = keys[-1:], n[-1:]  # the run may go on
        if held is not None:
            put(*held)
            for x in out:
                x.close()
            yield pa.record_batch([pa.array([name]), pa.array([first]), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([tops.tolist()], pa.list_(pa.int64()))], ["name", "first", "ids", "tops"])

    return run


class Shards:
    """Counts of pairs, looked up in sorted shards."""

    def __init__(self, home: str, names: list[str], firsts: np.ndarray):
        from pyarrow import fs

        self.files, self.base = filesystem(home)
        self.mapped = isinstance(self.files, fs.LocalFileSystem)
        self.names, self.firsts, self.open = names, firsts, {}

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            if not self.mapped and len(self.open) >= LOADED:
                self.open.pop(next(iter(self.open)))
            paths = [f"{self.base}/{self.names[i]}.{x}" for x in ("keys", "counts")]
            self.open[i] = tuple(np.memmap(x, "<i8", "r") if self.mapped else np.frombuffer(self.files.open_input_file(x).read(), "<i8") for x in paths)
        return self.open[i]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, which all are in the shards."""
        edges = np.concatenate([[0], np.searchsorted(keys, self.firsts[1:]), [len(keys)]])
        out = np.zeros(len(keys), np.int64)
        for i in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            known, n = self.shard(i)
            out[edges[i] : edges[i + 1]] = n[np.searchsorted(known, keys[edges[i] : edges[i + 1]])]
        return out


def _look_up(home: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, firsts, best = shared.value
        shards = Shards(home, names, firsts)
        for batch in batches:
            cols = []
            for c in ("keys", "times"):
                data, offsets = utf8(batch.column(c))
                cols.append(np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int64))
            keys, times = cols
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8)
            some, at = np.unique(keys, return_inverse=True)
            counts = shards.get(some)
            top = counts == best[some >> 32]
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, doc, times * top[at])
            np.add.at(total, doc, times * counts[at])
            names_ = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.record_batch([*(batch.column(c) for c in names_), pa.array(n_best), pa.array(total), batch.column("groups_sha256")], [*names_, "n_best", "count_sum", "groups_sha256"])

    return run


class Counts(NamedTuple):
    """Sorted shards of pair counts: (home, names, first keys) and, by A's id, the largest count."""

    home: str
    names: list[str]
    firsts: np.ndarray
    best: np.ndarray


def pair_counts(linked: DataFrame, home: str) -> Counts:
    """Counts of linked's pairs in shards below home. The driver sees the shards' names and a number for each id of A."""
    partial = table(linked.select("keys").transform(arrow, _partial, "pair long, n long"), f"{home}/partial")
    ordered = partial.repartitionByRange("pair").sortWithinPartitions("pair")
    shards = table(arrow(ordered, _shard(f"{home}/shards"), "name string, first long, ids array<long>, tops array<long>"), f"{home}/manifest")
    found = shards.orderBy("first").collect()
    best = np.zeros(1 + max([0, *(i for x in found for i in x.ids)]), np.int64)
    for x in found:
        np.maximum.at(best, np.array(x.ids, np.int64), np.array(x.tops, np.int64))
    return Counts(f"{home}/shards", [x.name for x in found], np.array([x.first for x in found], np.int64), best)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs (doc_id, text).

    A is a byte-level tokenizers file, which gets a space before each text, B a sentencepiece model, which puts one; both lie
    at their paths on every machine. n_links counts all linked pairs of tokens, n_best those whose pair no other pair of
    the same A id exceeds, in how many documents it occurs; count_sum adds up these counts over the links. A text that is null
    or empty, or whose tokens' bytes aren't its own after a space, has no tokens: zeros and an empty groups_sha256. Repeated rows
    are kept and count each, very long texts whole; an empty table gives an empty result. Other columns, of whatever
    name, are ignored.
    """
    spark = docs.sparkSession
    home = scratch(spark, "alignment")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    linked = table(rows.transform(arrow, _link(path_a, path_b), _LINKED), f"{home}/linked")
    counts = pair_counts(linked, home)
    shared = spark.sparkContext.broadcast((counts.names, counts.firsts, counts.best))
    return linked.transform(arrow, _look_up(counts.home, shared), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
