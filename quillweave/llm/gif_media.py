"""Media columns: GIF.

``encode`` stores bytes losslessly as the 8-bit samples of a GIF's frames (grey palette, LZW), ``frames`` decodes any
GIF: LZW code streams, interlacing, global and local palettes, transparency and the four disposal rules, giving timed,
composed pictures. ``store_payloads`` and ``frame_table`` apply them to tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, scratch, slices, table, utf8

WIDTH = 64
#: Rows of a frame: 64 KiB of samples. Longer payloads go on in further frames.
ROWS = 1024
BINS = 8
_GREY = bytes(x for i in range(256) for x in (i, i, i))
_TOP = 4096


class Frame(NamedTuple):
    delay_ms: int
    box: tuple[int, int, int, int]  # left, top, width, height of what the file stores
    samples: np.ndarray  # of the box, palette indices, uint8
    canvas: np.ndarray  # composed picture, height x width x 3, uint8


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of each of the n codes after a clear code: a code grows when the table that the reader then has needs it."""
    entries = (1 << size) + 2 + np.maximum(np.arange(n) - 1, 0)
    bits = np.full(n, size + 1, np.int64)
    for w in range(size + 1, 12):
        bits += entries >= (1 << w)
    return bits


_WIDTHS8 = _widths(_TOP, 8)


def lzw_encode(data: bytes) -> bytes:
    """A code stream of 8-bit samples; the table is cleared when it is full."""
    out = [256 << 8]
    append = out.append
    entries: dict[int, int] = {}
    get = entries.get
    start, full = 258 << 8, _TOP << 8
    free, prefix = start, data[0] << 8
    # Codes are kept with eight zero bits below, so that a code and the next sample make a key by one operation.
    for b in memoryview(data)[1:]:
        key = prefix | b
        code = get(key)
        if code:
            prefix = code
            continue
        append(prefix)
        prefix = b << 8
        if free < full:
            entries[key] = free
            free += 256
        else:
            append(256 << 8)
            entries.clear()
            free = start
    append(prefix)
    append(257 << 8)
    codes = np.array(out, np.int32) >> 8
    after = np.flatnonzero(codes == 256) + 1
    since = np.arange(len(codes))
    since[1:] -= after[np.searchsorted(after, since[1:], side="right") - 1]
    bits = _WIDTHS8[np.minimum(since, _TOP - 1)]
    bits[0] = 9
    flat = ((codes[:, None] >> np.arange(12)) & 1).astype(np.uint8)[np.arange(12) < bits[:, None]]
    return np.packbits(flat, bitorder="little").tobytes()


def lzw_codes(stream: bytes, size: int, n: int) -> list[np.ndarray]:
    """The codes between clear codes, up to the end code or the end of the stream; at most n codes."""
    clear = 1 << size
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, at, out, count = 8 * len(stream), 0, [], 0
    steps = _WIDTHS8 if size == 8 else _widths(_TOP, size)
    starts = np.concatenate([[0], np.cumsum(steps)[:-1]])
    while count < n and at + size < total:
        stretch, first = [], True
        while True:
            most = min(_TOP, (total - at) // (size + 1) + 1)
            width = steps[:most] if first else np.full(most, 12)
            pos = at + (starts[:most] if first else 12 * np.arange(most))
            room = int(np.searchsorted(pos + width, total, side="right"))
            pos, width = pos[:room], width[:room]
            codes = ((words[pos >> 3] >> (pos & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)).astype(np.int64)
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            stop = int(stops[0]) if len(stops) else room
            stretch.append(codes[:stop])
            count += stop
            if len(stops) or room < most or not room or count >= n:
                break
            at, first = int(pos[-1] + width[-1]), False
        out.append(np.concatenate(stretch))
        if not len(stops) or codes[stop] == clear + 1:
            break
        at = int(pos[stop] + width[stop])
    return out


def lzw_expand(codes: np.ndarray, size: int) -> bytes:
    """The samples of a stretch of codes that started with an empty table.

    The table's entry of number k is what the k-th code stands for and the first sample of the next. So each code that
    is no sample points to an earlier place in the stretch; following all pointers at once, in steps of double length,
    gives lengths and first samples, and the output is filled from the last sample of each code backwards.
    """
    literal = codes < (1 << size)
    here = np.arange(len(codes))
    back = np.where(literal, here, codes - (1 << size) - 2)
    if not (literal | ((back < here) & (back >= 0))).all():
        raise ValueError("the code stream is broken")
    jump, depth = back.copy(), (~literal).astype(np.int64)
    while not literal[jump].all():
        depth += depth[jump]
        jump = jump[jump]
    first = codes[jump].astype(np.uint8)
    last = np.where(literal, first, first[np.minimum(back + 1, len(codes) - 1)])
    end = np.cumsum(depth + 1) - 1
    out = np.empty(int(end[-1]) + 1 if len(end) else 0, np.uint8)
    place = here
    while len(place):
        out[end] = last[place]
        on = ~literal[place]
        place, end = back[place[on]], end[on] - 1
    return out.tobytes()


def lzw_decode(stream: bytes, size: int, n: int) -> bytes:
    """The n samples of a code stream of size-bit samples; a stream that ends early is filled up with zeros."""
    data = b"".join(lzw_expand(c, size) for c in lzw_codes(stream, size, n) if len(c))[:n]
    return data + bytes(n - len(data))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = 100) -> bytes:
    """A GIF whose frames' samples, one after the other, are the given bytes, a positive multiple of width."""
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREY]
    step = width * height
    for i in range(0, len(samples), step):
        part = samples[i : i + step]
        # Disposal 1: the picture stays, the next frame is laid over it.
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_ms // 10, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def frames(media: bytes) -> Iterator[Frame]:
    """The frames of a GIF, each with the picture that a viewer shows."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, ground, _ = struct.unpack("<HHBBB", media[6:13])
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        out = np.zeros((256, 3), np.uint8)
        out[:n] = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return out

    def blocks() -> bytes:
        nonlocal at
        out = []
        while n := media[at]:
            out.append(media[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(out)

    shared = palette(flags)
    back = shared[ground] if shared is not None else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = back
    delay, disposal, hidden = 0, 0, -1
    while at < len(media):
        kind = media[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = media[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                bits, hundredths, index = struct.unpack("<BHB", body[:4])
                delay, disposal, hidden = 10 * hundredths, bits >> 2 & 7, index if bits & 1 else -1
        elif kind == 0x2C:
            left, top, w, h, bits = struct.unpack("<HHHHB", media[at : at + 9])
            at += 9
            own = palette(bits)
            size = media[at]
            at += 1
            samples = np.frombuffer(lzw_decode(blocks(), size, w * h), np.uint8).reshape(h, w)
            if bits & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(samples)
                plain[order] = samples
                samples = plain
            colours = own if own is not None else shared if shared is not None else np.frombuffer(_GREY, np.uint8).reshape(256, 3)
            before = canvas.copy() if disposal == 3 else None
            seen = samples[: max(0, height - top), : max(0, width - left)]
            box = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
            if hidden < 0:
                box[:] = colours[seen]
            else:
                shown = seen != hidden
                box[shown] = colours[seen[shown]]
            yield Frame(delay, (left, top, w, h), samples, canvas)
            if disposal == 2:
                box[:] = back
            elif disposal == 3:
                canvas = before
            delay, disposal, hidden = 0, 0, -1
        else:
            raise ValueError(f"unknown block {kind:#x}")


def histogram(picture: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Pixels in each of bins equal ranges of the red, the green and the blue value: 3 * bins counts."""
    step = 256 // bins
    return np.concatenate([np.bincount(picture[..., c].ravel(), minlength=256).reshape(bins, step).sum(1) for c in range(3)])


def payload(text: bytes) -> bytes:
    """The bytes, with zeros up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for i, j in slices(offsets):
            rows = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
            media = [encode(payload(x)) for x in rows]
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(map(len, rows), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text of docs (doc_id, text) as a GIF; null counts as empty."""
    return docs.select("doc_id", "text").transform(arrow, _encode, "doc_id long, n_bytes long, media binary")


def timed(media: bytes) -> Iterator[tuple[int, int, Frame, np.ndarray]]:
    """(number, start in ms, frame, colour histogram of the composed picture) of each frame of a GIF."""
    start = 0
    for k, f in enumerate(frames(media)):
        yield k, start, f, histogram(f.canvas)
        start += f.delay_ms


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "frame", "start_ms", "delay_ms", "width", "height", "pixels", "histogram"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
            if (raw := media.as_py()) is None:
                continue
            for k, start, f, colours in timed(raw):
                row = (doc, k, start, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), colours.tolist())
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)], names)


def frame_table(media: DataFrame) -> DataFrame:
    """A row for each frame of each GIF of media (doc_id, media): its time, composed picture and colour histogram.

    A null medium has no frames; what isn't a GIF raises ValueError.
    """
    schema = "doc_id long, frame int, start_ms long, delay_ms int, width int, height int, pixels binary, histogram array<long>"
    return media.select("doc_id", "media").transform(arrow, _frames, schema)


def digest(media: bytes) -> tuple:
    """(payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of a GIF made by encode.

    The payload is read from the composed pictures, whose grey is the sample.
    """
    sha, n, tail, colours, end, count = hashlib.sha256(), 0, b"", np.zeros(3 * BINS, np.int64), 0, 0
    for k, start, f, seen in timed(media):
        part = f.canvas[: f.box[3], :, 0].tobytes()
        sha.update(part)
        n += len(part)
        tail = part[-64:]
        colours += seen
        end, count = start + f.delay_ms, k + 1
    feature = f"frames={count};ms={end};rgb=" + ",".join(map(str, colours.tolist()))
    return n, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows = [digest(x.as_py()) for x in part.column("media")]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
            yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *cols], names)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text) as a GIF in a table, reads the table back and describes what it holds.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; feature has the
    number of frames, their time and the colours' histogram, of the timed frames' composed pictures. A null text is empty:
    64 zeros; a very long one is several frames. Equal texts give equal values, repeated rows are kept, an empty table
    gives an empty result, other columns, of whatever name, are ignored.
    """
    stored = table(store_payloads(docs), f"{scratch(docs.sparkSession, 'gif')}/media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").transform(arrow, _digest, schema)
