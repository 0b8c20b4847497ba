"""Vectorised word and window hashing over Arrow string columns.

A chunk of texts is one flat UTF-8 byte array with document boundaries.
Words are found with a byte mask, hashed with prefix sums of a polynomial
modulo 2**64, and windows of words are hashed by the same trick over the
words' hashes, so no Python loop touches a word or a byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import ship

#: Bytes of text handled at once in a worker; a longer text is its own chunk.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_MIX_1 = U64(0xFF51AFD7ED558CCD)
_MIX_2 = U64(0xC4CEB9FE1A85EC53)


def mask_of(byte_values: bytes | range | list[int]) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(byte_values)] = True
    return mask


#: All bytes but space and U+0009..U+000D.
NON_SPACE = ~mask_of([0x20, *range(0x09, 0x0E)])
#: ASCII letters and digits and every byte of a non-ASCII character.
WORDISH = mask_of([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, dtype=U64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(_BYTE_BASE)
_WORD_POWERS = _Powers(_WORD_BASE)
_SECOND_POWERS = _Powers(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * _MIX_1
    x ^= x >> U64(33)
    x *= _MIX_2
    x ^= x >> U64(33)
    return x


class Words:
    """The words of a chunk of texts.

    ``starts``/``ends`` are byte offsets in ``data``; the words of document
    ``i`` are ``first[i]:first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        mask = np.zeros(n + 1, dtype=bool)
        mask[:n] = is_word[data]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = mask[:-1]
        before[offsets[:-1]] = False
        self.starts = np.flatnonzero(mask & ~before)
        after = np.zeros(n + 1, dtype=bool)
        after[:-1] = mask[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
        self.ends = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def windows(self, size: int, second: bool = False) -> np.ndarray:
        """A hash for the window of ``size`` words that starts at each word.

        Only those at ``window_mask(size)`` lie within one document.
        ``second`` takes an independent base: both together are 128 bits.
        """
        n = len(self)
        if n < size:
            return np.zeros(n, dtype=U64)
        up, down = (_SECOND_POWERS if second else _WORD_POWERS).get(n)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(self.hashes() * up, out=sums[1:])
        out = np.zeros(n, dtype=U64)
        out[: n - size + 1] = mix((sums[size:] - sums[: n - size + 1]) * down[: n - size + 1])
        return out

    def window_mask(self, size: int) -> np.ndarray:
        """Which words start a window of ``size`` words in their document."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(self))
        return room >= size


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, in time linear in the bytes."""
    up, down = _BYTE_POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if not pa.types.is_large_binary(column.type) else column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, at least one row."""
    if batch.num_rows == 0:
        return
    _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def per_chunk(fn: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text") -> Callable:
    """A mapInArrow function that applies ``fn`` to chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, text):
                out = fn(chunk)
                if out is not None and out.num_rows:
                    yield out

    return run


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``: whatever else a table carries can't clash."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(divisor: int, remainder: int, doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(texts: pa.Array) -> list[str | None]:
    """Python strings of a column; bytes that are no UTF-8 read as U+FFFD."""
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [t.as_buffer().to_pybytes().decode(errors="replace") if t.is_valid else None for t in texts]


def to_batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=types[k]) for k, v in columns.items()], names=list(columns))


def with_texts(batch: pa.RecordBatch, texts: list[str | None], changed: list[int]) -> pa.RecordBatch:
    """The batch with other texts; ``n_chars`` of the changed rows follows where it is a whole number."""
    columns = list(batch.columns)
    if changed:
        k = batch.schema.get_field_index("text")
        columns[k] = pa.array(texts, type=batch.schema.field(k).type)
        n = batch.schema.get_field_index("n_chars")
        if n >= 0 and pa.types.is_integer(batch.schema.field(n).type):
            counts = columns[n].to_pylist()
            for i in changed:
                counts[i] = len(texts[i])
            columns[n] = pa.array(counts, type=batch.schema.field(n).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
