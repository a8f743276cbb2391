"""N-gram Jaccard join with count-vector R-trees.

A text's set is its distinct shingles of k words. Shingles are hashed into groups and a set becomes the point of its
group counts; the overlap of two sets is at most the sum of the smaller counts, of a set and all below an R-tree's node
at most that with the node's largest counts. Pairs that the bounds leave are verified on the sets.

One tree over the corpus would not do: random points in many dimensions are all near the same few planes, so that every
query would go through most leaves and the work would grow with the square of the corpus. Sets are therefore first
brought together in blocks by signatures that any qualifying pair is sure to share:

* Sets of Jaccard similarity t and sizes a, b differ in at most d = (a + b)(1 - t) / (1 + t) shingles. Cut by hash into
  more than d groups, they agree in one group at least; the group's sum of hashes is a signature. Numbers of groups are
  powers of two by the larger set's size, and a set signs for every number that a partner's size may ask for. Groups in
  which both are empty say nothing: a set with so many empty groups that they could be all that agree signs otherwise.
* Where groups would hold few shingles, by the similarity or the set's size, sets sign with a prefix: the first
  n - tn + 1 of their shingles in one order of all shingles. Shingles that many texts repeat come last in it, so that
  texts which share passages don't share signatures. Any order is exact; repeats are counted on a map of fixed size.

Blocks give links in two steps:

1. In each block the set that shares most signatures is the centre of a star. Pairs of centre and other sets are told
   once, however many blocks have them, bounded by their points and verified on their sets. What links is one component;
   a large group of near copies costs its star, and its blocks are done with.
2. Blocks of several components are left. A component is a node, a box below its members' largest counts; each block gets
   an R-tree of its nodes, and the pairs that its bounds allow make groups of components. The sets of a group get an
   R-tree of their points, and pairs of different components that it allows are verified.

Identical sets are one class; a class is known by a 64-bit sum of its hashes, so that two of n different sets share it
with a probability of n * n / 2**65. No link is expanded within a class, no list of pairs is made within a block or a
group: trees give forests of links. Where one holds too much for a task it is cut into tiles, and each pair of tiles
whose sizes can match is a task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batches_of, emit, mix, placed, remove, scratch, shingles, slices, table, utf8, words

#: Sets of at most so many shingles sign with a prefix.
SMALL = 32
#: Shingles that groups must hold on average, or sets sign with a prefix.
GROUP = 4
#: Places of the map of repeated shingles, and shingles whose repeats are counted at a time.
REPEATS, AT_ONCE = 1 << 20, 1 << 21
#: Least and most dimensions of a point, powers of two.
DIMENSIONS = (16, 8192)
LEAF = 16
#: Rows of a batch where rows hold sets or points, which may be long.
ROWS = 500
#: Shingles of all sets that a task holds for one group, where a set counts OWN more; bytes of points likewise.
LIMIT = 2_000_000
OWN = 200


def differ(total: int, num: int, den: int) -> int:
    """Most shingles in which sets of total size may differ at a similarity of num / den."""
    return total * (den - num) // (den + num)


def needed(total, num: int, den: int):
    """Least overlap of sets of total size at a similarity of num / den."""
    return -(-total * num // (den + num))


def level(size: int, num: int, den: int) -> int:
    """0 for prefixes; else the power of two of groups for pairs whose larger set has size shingles."""
    return 0 if size <= SMALL or num + den < 4 * GROUP * (den - num) else max(1, differ(2 * size, num, den).bit_length())


_EDGES: dict[int, np.ndarray] = {}


def edges(bits: int) -> np.ndarray:
    """First hashes of 2**bits groups of equal range, but the first."""
    if bits not in _EDGES:
        _EDGES[bits] = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return _EDGES[bits]


def signatures(s: np.ndarray, num: int, den: int, repeats: np.ndarray | None = None) -> np.ndarray:
    """Of a sorted set of hashes: sets similar enough have one in common at least.

    repeats orders shingles, by the last bits of their hashes, before the hashes do.
    """
    n = len(s)
    out = []
    most = n * den // num
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s))])
    rare = s if repeats is None else s[np.argsort(repeats[(s & np.uint64(len(repeats) - 1)).astype(np.int64)], kind="stable")]
    prefix = rare[: n - -(-n * num // den) + 1]
    for lv in range(level(n, num, den), level(most, num, den) + 1):
        salt = np.uint64((lv + 1) << 48)
        if lv:
            at = np.concatenate([[0], np.searchsorted(s, edges(lv)), [n]])
            full = np.flatnonzero(at[1:] > at[:-1])
            out.append(mix((sums[at[full + 1]] - sums[at[full]]) + mix(salt + full.astype(np.uint64))))
            groups = 1 << lv
            # A partner at this level has at most `most` shingles; so many groups agree with it at least.
            if groups - len(full) < groups - min(groups - 1, differ(n + most, num, den)):
                continue
        out.append(mix(prefix + mix(np.array([(lv + 1) << 48 | 1 << 40], np.uint64))))
    return np.unique(np.concatenate(out)) if len(out) > 1 else np.unique(out[0])


def fingerprint(s: np.ndarray) -> int:
    """A number for the whole set, 0 for the empty one."""
    return int(mix(mix(s + np.uint64(7)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = utf8(batch.column("text"))
    for i, j in slices(offsets):
        h, doc, _ = words(data, offsets[i : j + 1], lower=True)
        for x, s in enumerate(shingles(h, doc, j - i, k)):
            yield i + x, s


def _repeat(k: int):
    """Counts of shingles that several of a task's different sets have, among AT_ONCE shingles, by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, held, size = np.zeros(REPEATS, np.int64), set(), [], 0

        def count() -> None:
            hashes, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            more = n > 1
            np.add.at(total, (hashes[more] & np.uint64(REPEATS - 1)).astype(np.int64), n[more])
            held.clear()

        for batch in batches:
            for _, s in _sets(batch, k):
                f = fingerprint(s)
                if f not in seen:
                    seen.add(f)
                    held.append(s)
                    size += len(s)
                if size >= AT_ONCE:
                    count()
                    size = 0
        count()
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["place", "n"])

    return run


def repeated(docs: DataFrame, k: int) -> np.ndarray:
    """How often texts repeat the shingles of each place, on a scale of 8 steps for a power of two."""
    got = docs.select("doc_id", "text").transform(arrow, _repeat(k), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most REPEATS rows
    out = np.zeros(REPEATS, np.uint8)
    out[got.column("place").to_numpy()] = np.minimum(255, 8 * np.log2(1 + got.column("n").to_numpy().astype(float)))
    return out


def _sign(k: int, num: int, den: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: copies sign once in it
        for batch in batches:
            n, prints, signs, at = [], [], [], [0]
            for _, s in _sets(batch, k):
                f = fingerprint(s)
                n.append(len(s))
                prints.append(f)
                if len(s) and f not in seen:
                    seen.add(f)
                    signs.append(signatures(s, num, den, shared.value).view(np.int64))
                    at.append(at[-1] + len(signs[-1]))
                else:
                    at.append(at[-1])
            flat = pa.array(np.concatenate(signs) if signs else np.zeros(0, np.int64))
            names = [x for x in batch.schema.names if x != "text"]
            cols = [batch.column(x) for x in names]
            yield pa.record_batch([*cols, pa.array(n, pa.int64()), pa.array(prints, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], [*names, "n_shingles", "class", "signs"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (sign, class): each class of a sign that has more than one, once."""
    sign, first, last, alone = None, 0, 0, True
    for batch in batches:
        s, c = batch.column("sign").to_numpy(), batch.column("class").to_numpy()
        if not len(s):
            continue
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        new[0] = sign is None or s[0] != sign
        fresh = new.copy()  # the first row of its class in its sign
        fresh[1:] |= c[1:] != c[:-1]
        fresh[0] |= c[0] != last
        more = fresh & ~new
        # A sign's first class is told with its second: both then stand in one batch, or the first comes from before.
        start = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        run = np.cumsum(new)
        extra = np.flatnonzero(more)
        second = extra[np.unique(run[extra], return_index=True)[1]]
        if not alone:
            second = second[start[second] >= 0]
        heads = np.where(start[second] >= 0, c[np.maximum(start[second], 0)], first)
        if len(extra):
            yield pa.record_batch([pa.array(np.concatenate([s[second], s[extra]])), pa.array(np.concatenate([heads, c[extra]]))], ["sign", "class"])
        tail = start[-1]
        alone = not bool(more[max(tail, 0) :].any()) and (tail >= 0 or alone)
        first = c[tail] if tail >= 0 else first
        sign, last = s[-1], c[-1]


def components(links: DataFrame, home: str) -> DataFrame:
    """node, root for every node of links (a, b): the smallest node of its connected component.

    Large and small stars in turn (Kiveris and others, 2014), each round a written table, until nothing changes.
    """
    spark = links.sparkSession
    now = table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{home}/links-0")
    mark, number = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large, f"{home}/large-{number}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        number += 1
        now = table(small, f"{home}/links-{number}")
        remove(spark, f"{home}/links-{number - 1}")
        remove(spark, f"{home}/large-{number - 1}")
        old, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)), F.bit_xor(F.xxhash64("b", "a"))).first())
        if mark == old:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class RTree:
    """Boxes of group counts and of ranges of sizes below nodes of at most LEAF boxes or two nodes.

    A box is known by its largest counts: those of a set, or the largest of several sets'.
    """

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.points, self.low, self.high = points, low, high
        # Halves by the dimension of the widest spread, sizes among them, down to leaves: each leaf is a range of order.
        order, todo, leaves = np.arange(len(points)), [(0, len(points))], []
        both = np.column_stack([high, points])
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            part = both[order[a:b]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            order[a:b] = order[a:b][np.argsort(part[:, axis], kind="stable")]
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        leaves.sort()
        self.order = order
        self.bounds = np.array([*(a for a, _ in leaves), len(points)])
        self.levels = [(np.maximum.reduceat(points[order], self.bounds[:-1]), np.minimum.reduceat(low[order], self.bounds[:-1]), np.maximum.reduceat(high[order], self.bounds[:-1]))]
        while len(self.levels[-1][0]) > 1:
            most, least, up = self.levels[-1]
            pairs = np.arange(0, len(most), 2)
            self.levels.append((np.maximum.reduceat(most, pairs), np.minimum.reduceat(least, pairs), np.maximum.reduceat(up, pairs)))

    def near(self, point: np.ndarray, low: int, high: int, num: int, den: int) -> np.ndarray:
        """Boxes whose sizes and overlap bound allow the similarity with one of this box, largest bounds first."""
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            most, least, up = self.levels[depth]
            if depth < len(self.levels) - 1:
                nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
                nodes = nodes[nodes < len(most)]
            nodes = nodes[allowed(most[nodes], least[nodes], up[nodes], point, low, high, num, den)[0]]
            if not len(nodes):
                return nodes
        places = np.concatenate([self.order[self.bounds[x] : self.bounds[x + 1]] for x in nodes])
        fits, bound = allowed(self.points[places], self.low[places], self.high[places], point, low, high, num, den)
        places, bound = places[fits], bound[fits]
        return places[np.argsort(-bound, kind="stable")]


def allowed(points, lows, highs, point, low, high, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether the boxes may hold a set similar to one of the box of point, bound of the overlap)."""
    fits = (highs * den >= low * num) & (lows * num <= high * den)
    bound = np.minimum(points, point).sum(1, dtype=np.int64)
    # The least sizes that can match: neither is below the other's times the similarity.
    least = np.maximum(low, -(-lows * num // den)) + np.maximum(lows, -(-low * num // den))
    return fits & (bound >= needed(least, num, den)), bound


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def point(s: np.ndarray) -> np.ndarray:
    """A set's counts in groups of four to eight shingles: with fewer groups counts of large sets are all alike."""
    bits = min(max(len(s) // 4, DIMENSIONS[0]), DIMENSIONS[1]).bit_length() - 1
    return narrow(np.diff(np.concatenate([[0], np.searchsorted(s, edges(bits)), [len(s)]])))


def narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in as few bytes as hold the largest."""
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if counts.max() <= np.iinfo(t).max))


def coarse(p: np.ndarray, dimensions: int) -> np.ndarray:
    """The point in fewer groups, each of neighbours."""
    return p.astype(np.int32).reshape(dimensions, -1).sum(1, dtype=np.int32)


def packed(p: np.ndarray) -> bytes:
    return bytes([p.itemsize]) + p.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


class Bounds:
    """Overlap bounds of points of several resolutions: each pair is compared at the finest that both have."""

    def __init__(self, points: list[np.ndarray]):
        self.resolution = np.array([len(p) for p in points])
        self.kinds = np.unique(self.resolution)
        self.rows = {d: np.flatnonzero(self.resolution >= d) for d in self.kinds}
        self.at = {d: np.stack([coarse(points[i], int(d)) for i in self.rows[d]]) for d in self.kinds}

    def of(self, i: int, others: np.ndarray) -> np.ndarray:
        out = np.empty(len(others), np.int64)
        shared = np.minimum(self.resolution[others], self.resolution[i])
        for d in np.unique(shared):
            on = shared == d
            at, rows = self.at[d], self.rows[d]
            out[on] = np.minimum(at[np.searchsorted(rows, others[on])], at[np.searchsorted(rows, i)]).sum(1)
        return out


def forest(points: list[np.ndarray], low: np.ndarray, high: np.ndarray, side: np.ndarray, known: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links connect: pairs that the bounds allow, and that the sets confirm, where given.

    Rows of one number in known are connected already. Of two sides, where there are two, links across alone. The tree
    has all points at the resolution of the coarsest; what it finds is bounded again at the resolution of each pair.
    """
    bounds = Bounds(points)
    base = bounds.at[bounds.kinds[0]]
    group, across, out = np.unique(known, return_inverse=True)[1], len(np.unique(side)) > 1, []
    tree, least = RTree(base, low, high), None
    # A pair is found from one of its ends: the largest of the groups needn't ask.
    asks = side == 0 if across else group != np.argmax(np.bincount(group)) if len(group) > group.max() + 1 else np.ones(len(group), bool)
    asked = np.zeros(len(group), bool)
    for i in np.flatnonzero(asks):
        near = tree.near(base[i], int(low[i]), int(high[i]), num, den)
        near = near[side[near] != side[i]] if across else near[~asked[near]]
        asked[i] = True
        near = near[group[near] != group[i]]
        if len(bounds.kinds) > 1 and len(near):
            least = np.maximum(low[i], -(-low[near] * num // den)) + np.maximum(low[near], -(-low[i] * num // den))
            near = near[bounds.of(i, near) >= needed(least, num, den)]
        if sets is None:
            for j in near[np.unique(group[near], return_index=True)[1]].tolist():
                out.append((i, j))
                group[group == group[j]] = group[i]
            continue
        while len(near):
            j, near = int(near[0]), near[1:]
            if similar(sets[i], sets[j], num, den):
                out.append((i, j))
                group[group == group[j]] = group[i]
                near = near[group[near] != group[i]]
    return out


def _found(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


def _link(num: int, den: int, verified: bool):
    """Forests of rows (task, class, side, known, low, high, data) in order of task, side and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len({x[2] for x in rows}) > 1:  # not all connected already
                side, known, low, high = (np.array([x[i] for x in rows]) for i in (1, 2, 3, 4))
                sets = [np.frombuffer(x[5], np.uint64) for x in rows] if verified else None
                points = [point(s) for s in sets] if verified else [unpacked(x[5]) for x in rows]
                yield _found([(rows[i][0], rows[j][0]) for i, j in forest(points, low, high, side, known, num, den, sets)])

        for batch in batches:
            for k, *row in zip(*(batch.column(x).to_pylist() for x in ("task", "class", "side", "known", "low", "high", "data"))):
                if k != key:
                    yield from done()
                    key, rows = k, []
                if not rows or rows[-1][:2] != tuple(row[:2]):  # rows that repeat a doc_id and its text
                    rows.append(tuple(row))
        yield from done()

    return run


def _bounded(num: int, den: int):
    """Of pairs and their points, those whose bound allows the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for total, a, b in zip(*(batch.column(x).to_pylist() for x in ("total", "data_a", "data_b"))):
                a, b = unpacked(a), unpacked(b)
                d = min(len(a), len(b))
                keep.append(int(np.minimum(coarse(a, d), coarse(b, d)).sum()) >= needed(total, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(num: int, den: int):
    """Of rows (task, class, side, data) in order of task and side: the sets that match their task's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in batches:
            found = []
            for k, c, side, s in zip(*(batch.column(x).to_pylist() for x in ("task", "class", "side", "data"))):
                if not side:
                    if k != key:
                        key, first = k, (c, np.frombuffer(s, np.uint64))
                elif k == key and similar(first[1], np.frombuffer(s, np.uint64), num, den):
                    found.append((first[0], c))
            yield _found(found)

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One box around each root's rows (root, low, high, data) where they follow each other."""
    names = ["root", "low", "high", "data"]
    now = None
    for batch in batches:
        out = []
        for root, low, high, data in zip(*(batch.column(x).to_pylist() for x in names)):
            if now is None or now[0] != root:
                if now is not None:
                    out.append((*now[:3], packed(narrow(now[3]))))
                now = [root, low, high, unpacked(data)]
                continue
            p = unpacked(data)
            d = min(len(p), len(now[3]))
            now[1:] = min(now[1], low), max(now[2], high), np.maximum(coarse(p, d), coarse(now[3], d))
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)
    if now is not None:
        yield pa.record_batch([pa.array([x], t) for x, t in zip((*now[:3], packed(narrow(now[3]))), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)


def _fetch(k: int, points: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, out = [], []
            for _, s in _sets(batch, k):
                prints.append(fingerprint(s))
                out.append(packed(point(s)) if points else s.tobytes())
            yield pa.record_batch([pa.array(prints, pa.int64()), pa.array(out, pa.binary())], ["class", "data"])

    return run


def fetch(docs: DataFrame, wanted: DataFrame, homes: DataFrame, k: int, points: bool, home: str) -> DataFrame:
    """The columns of wanted (class, more) and data: the class' set, or its point, built again from a text of it.

    homes (class, file, row) says where a text of each class lies. Those texts are read in place by tasks that scan their
    files; wanted sets alone are built and move.
    """
    at = wanted.select("class").distinct().join(homes, "class").select("file", "row", F.lit(1).alias("n"))
    found = emit(docs.select("text", "file", "row"), "file", "row", at, home, then=(_fetch(k, points), "class long, data binary"))
    return found.join(wanted, "class")


def _tasks(members: DataFrame, carry: list[str], num: int, den: int, limit: int) -> DataFrame:
    """task, class, side and carry of members (root, class, low, high, weight, carry).

    Each root whose weights fit a task is one; others are pairs of tiles. A tile is a part, by class, of a root's sets
    of one range of sizes; only neighbouring ranges can match. A box of several ranges is in a tile of each.
    """

    def band(size: str):
        return F.floor(F.log(F.col(size)) / float(np.log(den / num))).cast("int")

    root = members.groupBy("root").agg(F.sum("weight").alias("total"))
    rows = members.join(root, "root")
    whole = rows.where(F.col("total") <= limit).select(F.concat_ws(":", "root").alias("task"), "class", F.lit(0).alias("side"), *carry)
    large = rows.where(F.col("total") > limit).withColumn("band", F.explode(F.sequence(band("low"), band("high"))))
    bands = large.groupBy("root", "band").agg(F.ceil(F.sum("weight") * 2 / limit).cast("int").alias("tiles"))
    up = bands.select("root", (F.col("band") - 1).alias("band"), F.col("tiles").alias("above"))
    down = bands.select("root", (F.col("band") + 1).alias("band"), F.col("tiles").alias("below"))
    plan = bands.join(up, ["root", "band"], "left").join(down, ["root", "band"], "left").na.fill(0, ["above", "below"])
    large = large.join(plan, ["root", "band"]).withColumn("tile", F.pmod(F.xxhash64("class"), "tiles").cast("int"))

    def pairs(n, make):
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)).otherwise(F.array())

    def task(band_a, tile_a, band_b, tile_b, side):
        return F.struct(F.concat_ws(":", "root", band_a, tile_a, band_b, tile_b).alias("task"), side.cast("int").alias("side"))

    b, t, one = F.col("band"), F.col("tile"), F.lit(1)
    same = pairs("tiles", lambda x: task(b, F.least(t, x), b, F.greatest(t, x), t > x))
    above = pairs("above", lambda x: task(b, t, b + 1, x, F.lit(0)))
    below = pairs("below", lambda x: task(b - 1, x, b, t, one))
    large = large.select("class", *carry, F.explode(F.concat(same, above, below)).alias("t")).select("t.task", "class", "t.side", *carry)
    return whole.unionByName(large)


def _told(blocks: DataFrame, member: str) -> DataFrame:
    """Blocks (sign, member) of several members; of those with the same members one."""
    told = blocks.groupBy("sign").agg(F.bit_xor(F.xxhash64(member)).alias("x"), F.bit_xor(F.xxhash64(member, F.lit(1))).alias("y"), F.count("*").alias("n")).where("n > 1")
    return blocks.join(told.groupBy("x", "y", "n").agg(F.min("sign").alias("sign")).select("sign"), "sign", "left_semi")


def _blocks(docs: DataFrame, k: int, num: int, den: int, home: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables: docs without text but with n_shingles and class; classes (class, doc_id, size); homes (class, file, row); blocks (sign, class)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(repeated(docs, k))
    kept = [x for x in docs.schema if x.name != "text"]
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in kept) + ", n_shingles long, class long, signs array<long>"
    signed = table(docs.transform(arrow, _sign(k, num, den, shared), schema), f"{home}/signed")
    rows = signed.where("n_shingles > 0").select(F.explode("signs").alias("sign"), "class").repartition("sign").sortWithinPartitions("sign", "class")
    met = table(rows.transform(arrow, _shared, "sign long, class long"), f"{home}/shared")
    slim = table(signed.drop("signs"), f"{home}/slim")
    remove(spark, f"{home}/signed")
    found = table(slim.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"), F.min(F.struct("file", "row")).alias("at")), f"{home}/classes")
    classes, homes = found.drop("at"), found.select("class", "at.file", "at.row")
    blocks = table(_told(met, "class"), f"{home}/blocks")
    remove(spark, f"{home}/shared")
    return slim, classes, homes, blocks


def _stars(docs: DataFrame, homes: DataFrame, blocks: DataFrame, met: DataFrame, points: DataFrame, k: int, num: int, den: int, limit: int, home: str) -> DataFrame:
    """Links (a, b) of the blocks' centres with other sets of their blocks."""
    known = blocks.join(met.select("class", "size", "n"), "class")
    centre = known.groupBy("sign").agg(F.max(F.struct("n", "class", "size")).alias("c")).select("sign", F.col("c.class").alias("a"), F.col("c.size").alias("size_a"))
    pairs = known.join(centre, "sign").where((F.col("class") != F.col("a")) & (F.least("size", "size_a") * den >= F.greatest("size", "size_a") * num))
    pairs = pairs.select("a", F.col("class").alias("b")).distinct()
    ends = [points.select(F.col("class").alias(x), F.col("size").alias(f"size_{x}"), F.col("data").alias(f"data_{x}")) for x in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("total"), "data_a", "data_b")
    with batches_of(docs.sparkSession, ROWS):
        pairs = table(both.transform(arrow, _bounded(num, den), "a long, b long"), f"{home}/pairs")
    # A star of more than a task holds is dealt to several tasks, each with its centre.
    others = pairs.join(met.select(F.col("class").alias("b"), "size"), "b")
    parts = others.groupBy("a").agg(F.ceil(F.sum(F.col("size") + OWN) / limit).cast("int").alias("parts"))
    others = others.join(parts, "a").select(F.concat_ws(":", "a", F.pmod(F.xxhash64("b"), "parts")).alias("task"), "a", F.col("b").alias("class"), F.lit(1).alias("side"))
    others = table(others, f"{home}/others")
    centres = others.select("task", "a").distinct().select("task", F.col("a").alias("class"), F.lit(0).alias("side"))
    wanted = table(others.drop("a").unionByName(centres), f"{home}/rays")
    sets = fetch(docs, wanted, homes, k, False, f"{home}/at-rays").repartition("task").sortWithinPartitions("task", "side")
    with batches_of(docs.sparkSession, ROWS):
        return table(sets.transform(arrow, _compare(num, den), "a long, b long").distinct(), f"{home}/stars")


def _rest(docs: DataFrame, homes: DataFrame, blocks: DataFrame, met: DataFrame, points: DataFrame, roots: DataFrame, k: int, num: int, den: int, limit: int, home: str) -> DataFrame:
    """Links (a, b) that connect, with the components in roots (node, root), what all links in blocks connect."""
    spark = docs.sparkSession
    of = roots.withColumnRenamed("node", "class")

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(of, "class", "left").withColumn("root", F.coalesce("root", "class"))

    left = table(_told(rooted(blocks).select("sign", "root").distinct(), "root"), f"{home}/left")
    inner = rooted(points).join(left.select("root").distinct(), "root", "left_semi")
    inner = inner.select("root", F.col("size").alias("low"), F.col("size").alias("high"), "data", F.pmod(F.xxhash64("class"), F.lit(16)).alias("part"))
    schema = "root long, low long, high long, data binary"
    with batches_of(spark, ROWS):
        half = inner.repartition("root", "part").sortWithinPartitions("root").drop("part").transform(arrow, _boxes, schema)
        boxes = table(half.repartition("root").sortWithinPartitions("root").transform(arrow, _boxes, schema), f"{home}/boxes")
    members = left.join(boxes, "root").select(F.col("sign").alias("root"), F.col("root").alias("class"), F.col("root").alias("known"), "low", "high", (F.lit(OWN) + F.octet_length("data")).alias("weight"), "data")
    tasks = _tasks(members, ["known", "low", "high", "data"], num, den, limit).repartition("task").sortWithinPartitions("task", "side", "class")
    with batches_of(spark, ROWS):
        near = table(tasks.transform(arrow, _link(num, den, False), "a long, b long").distinct(), f"{home}/allowed")
    groups = components(near, f"{home}/near")
    groups = table(groups.select(F.col("node").alias("known"), F.col("root").alias("group")), f"{home}/groups")
    wanted = rooted(met).withColumnRenamed("root", "known").join(groups, "known")
    wanted = wanted.select(F.col("group").alias("root"), "class", "known", F.col("size").alias("low"), F.col("size").alias("high"), (F.col("size") + OWN).alias("weight"))
    wanted = table(_tasks(table(wanted, f"{home}/wanted"), ["known", "low", "high"], num, den, limit), f"{home}/tasks")
    verify = fetch(docs, wanted, homes, k, False, f"{home}/at-tasks").repartition("task").sortWithinPartitions("task", "side", "class")
    with batches_of(spark, ROWS):
        return table(verify.transform(arrow, _link(num, den, True), "a long, b long"), f"{home}/links")


def _classes(docs: DataFrame, k: int, num: int, den: int, limit: int, home: str) -> DataFrame:
    """docs (doc_id, text, file, row: where it lies) without text, with n_shingles, component, component_id.

    component is one number for all rows that links connect, null for empty sets.
    """
    slim, classes, homes, blocks = _blocks(docs, k, num, den, home)
    met = table(blocks.groupBy("class").agg(F.count("*").alias("n")).join(classes, "class"), f"{home}/met")
    points = table(fetch(docs, met, homes, k, True, f"{home}/at-points").select("class", "size", "data"), f"{home}/points")
    stars = _stars(docs, homes, blocks, met, points, k, num, den, limit, home)
    roots = table(components(stars, f"{home}/star-links"), f"{home}/star-roots")
    links = _rest(docs, homes, blocks, met, points, roots, k, num, den, limit, home)
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
    linked = table(components(links, f"{home}/linked"), f"{home}/roots")
    known = linked.join(classes, linked["node"] == classes["class"]).select("class", "root", "doc_id")
    lowest = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    reached = known.join(lowest, "root").select("class", F.col("root").alias("component"), "component_id")
    named = classes.join(reached, "class", "left").select("class", F.coalesce("component", "class").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    named = table(named, f"{home}/named")
    full = slim.where("n_shingles > 0").join(named, "class").drop("class")
    plain = slim.where("n_shingles = 0").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id")).drop("class")
    return full.unionByName(plain)


def _located(docs: DataFrame, home: str) -> DataFrame:
    rows, file, row = placed(docs, home)
    return rows.select("doc_id", "text", F.col(f"`{file}`").alias("file"), F.col(f"`{row}`").alias("row"))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Rows link whose sets have a Jaccard similarity of at least num / den; component_id is the smallest doc_id that links
    reach from the row. A set: distinct k-word shingles, words lower-cased in A-Z; with fewer words the whole sequence
    as one; without words, null among them, none, linked with nothing. A very long text is one set like others, hashed in
    one piece. Repeated rows link as copies do; a row without doc_id links, but its null is never the smallest while
    others have one. An empty table gives an empty result. Other columns, of whatever name, are ignored.
    """
    home = scratch(docs.sparkSession, "jaccard")
    found = _classes(_located(docs, home), k, num, den, limit, home)
    return found.select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, limit: int = LIMIT) -> DataFrame:
    """The rows of docs, with all columns, one of each group of rows that links connect, and all without words.

    The row of the smallest doc_id stays, nulls last; of rows that share it the first where they lie. Other columns, of
    whatever name, are kept as they are; an empty table gives an empty result.
    """
    home = scratch(docs.sparkSession, "keep-one")
    rows, file, row = placed(docs, home)
    found = _classes(rows.select("doc_id", "text", F.col(f"`{file}`").alias("file"), F.col(f"`{row}`").alias("row")), k, num, den, limit, f"{home}/classes")
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("x"))
    stay = first.select("x.file", "x.row").unionByName(found.where("component is null").select("file", "row"))
    return emit(rows, file, row, stay.withColumn("n", F.lit(1)), home)


#: Of three-word shingles at 0.9, by all pairs that share one.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
