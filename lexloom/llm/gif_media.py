"""GIF media columns: decode to timed, composed frames with colour histograms, and store bytes as GIF.

``decode`` reads every GIF87a/89a: LZW code streams with deferred clears,
global and local palettes, interlacing, transparency, all disposal rules.
Code widths follow from the number of codes since the last clear, so codes are
cut out of the bit stream by arrays; only the string table is a loop.
``encode`` stores bytes as 8-bit samples, ``WIDTH`` to a row and up to
``ROWS`` rows to a frame, under a palette of 256 greys.

Defined results: a null text is empty; a payload is never empty, as zeros fill
it up to a multiple of ``WIDTH``; rows that repeat an id are each handled on
their own; a null or broken medium has one row in ``frames`` that holds its
error and no picture; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textops as tx
from lexloom.session import ship

#: Pixels of a screen or frame that is decoded at most; a larger one is an error in its row.
MOST_PIXELS = 1 << 24
WIDTH = 64
ROWS = 256
#: Hundredths of a second that each stored frame is shown.
DELAY = 10
#: Shades to a bin of the histograms' three colours.
BIN = 32

_GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
_FULL = 4096


def _widths(low: int, n: int) -> np.ndarray:
    """Bits of each of the first n codes after a clear, for a minimum code size."""
    entries = (1 << low) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.floor(np.log2(entries)).astype(np.int64) + 1)


def lzw_encode(samples: bytes, low: int = 8) -> bytes:
    """The code stream of samples below 2**low, with a clear whenever the table is full."""
    clear, end = 1 << low, (1 << low) + 1
    codes = [clear]
    put = codes.append
    table: dict[int, int] = {}
    get, free = table.get, end + 1
    if samples:
        rest = iter(samples)
        prefix = next(rest)
        for b in rest:
            code = get(key := prefix << 8 | b)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            if free < _FULL:
                table[key] = free
                free += 1
            else:
                put(clear)
                table.clear()
                free = end + 1
            prefix = b
        put(prefix)
    put(end)
    values = np.array(codes, dtype=np.int64)
    place = np.arange(len(values))
    since = place[1:] - np.maximum.accumulate(np.where(values == clear, place, 0))[:-1] - 1
    width = np.concatenate([[low + 1], _WIDTHS[low][since]])
    at = np.cumsum(width) - width
    shifted, byte = values << (at & 7), at >> 3
    size = int(at[-1] + width[-1] + 7) >> 3
    out = sum(np.bincount(byte + k, (shifted >> 8 * k) & 255, minlength=size + 2) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _strings(codes: np.ndarray, low: int) -> np.ndarray:
    """The samples of codes that follow a clear.

    The table entry made after code j is that code's string and the next
    sample, which stand side by side in the output; so a code is a copy of
    earlier output. Its length and the literals behind its samples are found by
    following those references, doubling the step.
    """
    origin = codes - ((1 << low) + 2)
    if (origin >= np.arange(len(codes))).any():
        raise ValueError("a code that stands for nothing yet")
    length = np.ones(len(codes), np.int64)
    hop = np.where(origin >= 0, origin, -1)
    while True:
        on = np.flatnonzero(hop >= 0)
        if not len(on):
            break
        # length is one plus the codes on the way to a literal
        length[on], hop[on] = length[on] + length[hop[on]], hop[hop[on]]
    begin = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    literal = origin < 0
    source = np.arange(len(out))
    copied = ~np.repeat(literal, length)
    source[copied] += np.repeat(begin[np.maximum(origin, 0)] - begin, length)[copied]
    out[begin[literal]] = codes[literal]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return out[source]
        source = further


def lzw_decode(stream: bytes, low: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; one that breaks off gives what it holds."""
    clear, end = 1 << low, (1 << low) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int32)
    bits = 8 * len(stream)
    widths, offsets = _WIDTHS[low], _OFFSETS[low]
    start, made, run, done = 0, 0, [], False
    out: list[np.ndarray] = []
    index = 0
    while not done and made < most and start < bits:
        # codes index, index + 1, ... of this run between clears lie at known places
        room = (bits - start) // low + 1
        if index < _FULL:
            at = start + offsets[index : min(_FULL, index + room)] - offsets[index]
            width = widths[index : min(_FULL, index + room)]
        else:
            at = start + 12 * np.arange(min(_FULL, room))
            width = np.full(len(at), 12)
        n = int(np.searchsorted(at + width, bits, side="right"))
        if not n:
            break
        at, width = at[:n], width[:n]
        byte = at >> 3
        codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (at & 7) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else n
        run.append(codes[:n])
        index += n
        if len(stops):
            done = codes[n] == end
            start = int(at[n] + width[n])
        else:
            start = int(at[-1] + width[-1])
        if len(stops) or start >= bits:
            samples = _strings(np.concatenate(run), low)
            made += len(samples)
            out.append(samples)
            run, index = [], 0
    if run:
        out.append(_strings(np.concatenate(run), low))
    return b"".join(x.tobytes() for x in out)[:most]


_WIDTHS = {low: _widths(low, _FULL + 2) for low in range(2, 9)}
_OFFSETS = {low: np.concatenate([[0], np.cumsum(w)]) for low, w in _WIDTHS.items()}


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames' samples are the payload, a positive multiple of ``width``."""
    height = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), _GREYS]
    for at in range(0, len(payload), width * rows):
        part = payload[at : at + width * rows]
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08"]
        stream = lzw_encode(part)
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """A frame's own samples and the picture that is shown with it (rows x columns x RGBA)."""

    start_ms: int
    delay_ms: int
    left: int
    top: int
    samples: np.ndarray
    picture: np.ndarray

    def histogram(self) -> list[int]:
        """Shown pixels by bin of red, green and blue: three times 256 / BIN counts."""
        shown = self.picture[self.picture[:, :, 3] > 0]
        return [int(n) for c in range(3) for n in np.bincount(shown[:, c] // BIN, minlength=256 // BIN)]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)


def _palette(raw: bytes) -> np.ndarray:
    table = np.zeros((256, 4), np.uint8)
    table[:, 3] = 255
    colours = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    table[: len(colours), :3] = colours
    return table


def shown(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF one by one, each with the picture on screen while it is shown."""
    read = _Reader(data)
    if read.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", read.take(7))
    shared = _palette(read.take(3 << ((flags & 7) + 1))) if flags & 0x80 else None
    if width * height > MOST_PIXELS:
        raise ValueError("a larger screen than is decoded")
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index, start = 0, 0, None, 0
    while (mark := read.take(1)) != b"\x3b":
        if mark == b"\x21":
            label = read.take(1)
            body = read.blocks()
            if label == b"\xf9" and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            continue
        if mark != b"\x2c":
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", read.take(9))
        if w * h > MOST_PIXELS:
            raise ValueError("a larger frame than is decoded")
        palette = _palette(read.take(3 << ((flags & 7) + 1))) if flags & 0x80 else shared
        low = read.take(1)[0]
        if palette is None or not 2 <= low <= 8:
            raise ValueError("no palette, or no such sample size")
        raw = np.frombuffer(lzw_decode(read.blocks(), low, w * h), np.uint8)
        samples = np.zeros(w * h, np.uint8)
        samples[: len(raw)] = raw
        samples = samples.reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        before = canvas.copy() if disposal == 3 else None
        rows, columns = slice(top, min(top + h, height)), slice(left, min(left + w, width))
        part = samples[: max(0, height - top), : max(0, width - left)]
        painted = palette[part]
        if clear_index is not None:
            painted = np.where((part == clear_index)[:, :, None], canvas[rows, columns], painted)
        canvas[rows, columns] = painted
        yield Frame(start, 10 * delay, left, top, samples, canvas.copy())
        start += 10 * delay
        if disposal == 2:
            canvas[rows, columns] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF."""
    return list(shown(data))


def frames(media: DataFrame, id_column: str, gif_column: str) -> DataFrame:
    """One row per frame: id, frame, start_ms, delay_ms, left, top, width, height, rgba, histogram, error.

    A file that is null, breaks, is too large or has no frame has a last row
    with the error and no frame, after the frames that came before the break.
    """
    ship(media.sparkSession)
    types = {"id": pa.string(), "frame": pa.int32(), "start_ms": pa.int64(), "delay_ms": pa.int32(), "left": pa.int32(), "top": pa.int32(), "width": pa.int32(), "height": pa.int32(), "rgba": pa.binary(), "histogram": pa.list_(pa.int64()), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(tx.column(batch, "id").to_pylist(), tx.column(batch, "gif")):
                k, error = 0, None
                try:
                    if not data.is_valid:
                        raise ValueError("null")
                    for f in shown(data.as_buffer().to_pybytes()):
                        yield tx.to_batch(dict(zip(types, ([x] for x in (name, k, f.start_ms, f.delay_ms, f.left, f.top, f.picture.shape[1], f.picture.shape[0], f.picture.tobytes(), f.histogram(), None)))), types)
                        k += 1
                    if not k:
                        raise ValueError("no frames")
                except ValueError as e:
                    error = str(e)
                if error:
                    yield tx.to_batch(dict(zip(types, ([x] for x in (name, *[None] * 9, error)))), types)

    table = media.select(F.col(id_column).cast("string").alias("id"), F.col(gif_column).cast("binary").alias("gif"))
    return table.mapInArrow(run, "id string, frame int, start_ms long, delay_ms int, left int, top int, width int, height int, rgba binary, histogram array<long>, error string")


def _round_trip(text: bytes) -> tuple:
    payload = text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))
    media = encode(payload)
    shown = decode(media)
    back = b"".join(f.picture[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1], 0].tobytes() for f in shown)
    bins = np.bincount(np.frombuffer(back, np.uint8) // BIN, minlength=256 // BIN)
    feature = f"frames={len(shown)};ms={sum(f.delay_ms for f in shown)};size={WIDTH}x{shown[0].picture.shape[0]};bins={','.join(map(str, bins))}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature


def stored_texts(docs: DataFrame) -> DataFrame:
    """Every text stored as a GIF, read back, with the features of its frames."""
    types = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_round_trip(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in tx.column(batch, "text")]
        return tx.to_batch({"doc_id": tx.column(batch, "doc_id")} | dict(zip(types, map(list, zip(*rows)))), types)

    return tx.id_and_text(docs).mapInArrow(tx.per_chunk(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
