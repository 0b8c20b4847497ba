"""Benchmark decontamination with a broadcast hash set of test n-grams.

Benchmark items are cut into windows of ``WINDOW`` normalised words (an item
with fewer words is one window). Workers hold the windows' hashes, scan every
token window of the training texts with rolling hashes, verify each hit word
by word, and the caller removes hit spans or whole documents.

The windows are broadcast only while their measured size is at most
``BROADCAST_BYTES``; a larger benchmark is matched by a shuffle join on hash
and words instead, with the same results. A bitmap of its hashes, of a fixed
size, then keeps nearly all other windows of the texts from being shuffled.

Defined results: null or word-less texts have no words, no hits and are not
contaminated; null or word-less items have no windows; an empty benchmark hits
nothing; rows that repeat a ``doc_id`` are scanned each on its own; items that
share an id count once; other columns of the tables are ignored (and kept by
``decontaminate``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textops as tx
from lexloom.session import ship

WINDOW = 13
#: Largest measured size of windows that is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20

_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_FILTER_BITS = 22
#: Bits of the map of a large benchmark's windows (16 MB).
_MAP_BITS = 27


def words_of(column: pa.Array) -> tx.Words:
    data, offsets = tx.flat(column)
    return tx.Words(tx.LOWER[data], offsets, tx.WORDISH)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """One row for each item and window: size in words, hash, item and the words."""
    ship(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tx.column(batch, "item_id").to_pylist()
            words = words_of(tx.column(batch, "text"))
            sizes = np.minimum(words.counts, WINDOW)
            hashes = {int(n): words.windows(int(n)) for n in np.unique(sizes) if n}
            rows: dict[str, list] = {"size": [], "hash": [], "item": [], "words": []}
            for i, n in enumerate(map(int, sizes)):
                for at in range(words.first[i], words.first[i + 1] - n + 1 if n else words.first[i]):
                    rows["size"].append(n)
                    rows["hash"].append(int(hashes[n][at].view(np.int64)))
                    rows["item"].append(ids[i])
                    rows["words"].append(b" ".join(map(words.text, range(at, at + n))))
            yield tx.to_batch(rows, {"size": pa.int32(), "hash": pa.int64(), "item": pa.string(), "words": pa.binary()})

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(cut, "size int, hash long, item string, words binary").distinct()


class Index:
    """Windows by size: sorted hashes, a bitmap that most windows miss, and the words for verification."""

    def __init__(self, rows):
        self.sizes: dict[int, tuple[np.ndarray, dict[bytes, list[str]]]] = {}
        by: dict[int, dict[bytes, tuple[int, list[str]]]] = {}
        for size, value, item, words in rows:
            by.setdefault(size, {}).setdefault(bytes(words), (value, []))[1].append(item)
        for size, windows in sorted(by.items()):
            hashes = np.unique(np.array([v for v, _ in windows.values()], dtype=np.int64).view(np.uint64))
            self.sizes[size] = (hashes, {w: sorted(set(items)) for w, (_, items) in windows.items()})
        self._maps: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {"sizes": self.sizes, "_maps": {}}

    def candidates(self, size: int, values: np.ndarray) -> np.ndarray:
        hashes = self.sizes[size][0]
        if size not in self._maps:
            bitmap = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bitmap[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self._maps[size] = bitmap
        at = np.flatnonzero(self._maps[size][(values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        found = np.minimum(np.searchsorted(hashes, values[at]), len(hashes) - 1)
        return at[hashes[found] == values[at]]

    def hits(self, words: tx.Words) -> Iterator[tuple[int, int, list[str]]]:
        """First word, size and items of every verified occurrence of a window."""
        for size, (_, known) in self.sizes.items():
            if len(words) < size:
                continue
            at = self.candidates(size, words.windows(size))
            at = at[words.window_mask(size)[at]]
            for i in map(int, at):
                items = known.get(b" ".join(map(words.text, range(i, i + size))))
                if items:
                    yield i, size, items


def covered(words: tx.Words, hits) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words are hit, and each document's items."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for at, size, found in hits:
        edge[at] += 1
        edge[at + size] -= 1
        items.setdefault(int(np.searchsorted(words.first, at, side="right")) - 1, set()).update(found)
    return np.cumsum(edge[:-1]) > 0, items


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _load(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int):
    """The windows, and them as a broadcast if their size allows."""
    windows = benchmark_windows(benchmark)
    size = windows.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item") + 32), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return windows, None
    return windows, docs.sparkSession.sparkContext.broadcast(Index(windows.collect()))


def _reported(ids: pa.Array, words: tx.Words, hit: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
    n = words.counts
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
    return tx.to_batch(
        {
            "doc_id": ids,
            "n_words": n.astype(np.int64),
            "n_hit": n_hit.astype(np.int64),
            "n_items": [len(items.get(i, ())) for i in range(len(n))],
            "items_sha256": [_digest(items.get(i, ())) for i in range(len(n))],
            "contaminated": (n_hit > 0) & (SHARE * n_hit >= n),
        },
        {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()},
    )


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs``: words, hit words, items and whether it is contaminated."""
    table = tx.id_and_text(docs)
    windows, shared = _load(docs, benchmark, broadcast_bytes)
    if shared is not None:

        def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = words_of(tx.column(batch, "text"))
            hit, items = covered(words, shared.value.hits(words))
            return _reported(tx.column(batch, "doc_id"), words, hit, items)

        return table.mapInArrow(tx.per_chunk(scan), _REPORT)
    found = _joined(table, windows)
    bare = table.select("doc_id", F.xxhash64("text").alias("_key"), F.coalesce("text", F.lit("")).alias("text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return tx.to_batch({"doc_id": tx.column(batch, "doc_id"), "_key": tx.column(batch, "_key"), "n_words": words_of(tx.column(batch, "text")).counts.astype(np.int64)}, {"n_words": pa.int64()})

    counted = bare.mapInArrow(tx.per_chunk(count), "doc_id long, _key long, n_words long")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(found, counted["doc_id"].eqNullSafe(found["_doc"]) & (counted["_key"] == found["_k"]), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _bitmap(windows: DataFrame) -> bytes:
    """One bit for the upper bits of each window's hash: of a fixed size, however many windows there are."""
    block = 1 << 19

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(block, np.uint8)
        bits[rows.column("slot").to_numpy() % block] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    slots = windows.select(F.shiftrightunsigned("hash", 64 - _MAP_BITS).cast("int").alias("slot")).distinct()
    rows = slots.groupBy(F.floor(F.col("slot") / block).cast("int").alias("block")).applyInArrow(gather, "block int, bits binary").toArrow()
    by = dict(zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()))
    return b"".join(by.get(k, bytes(block >> 3)) for k in range((1 << _MAP_BITS) // block))


def _joined(table: DataFrame, windows: DataFrame) -> DataFrame:
    """Hits by a shuffle join on window hash and words, one row per document and text with any hit."""
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most WINDOW numbers
    shared = table.sparkSession.sparkContext.broadcast(_bitmap(windows))
    keyed = table.select("doc_id", F.xxhash64("text").alias("_key"), "text").dropDuplicates(["doc_id", "_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch, "text", 1 << 18):
                words = words_of(tx.column(chunk, "text"))
                doc = words.docs()
                known = np.frombuffer(shared.value, np.uint8)
                for size in sizes:
                    slots = (words.windows(size) >> np.uint64(64 - _MAP_BITS)).astype(np.int64)
                    at = np.flatnonzero(words.window_mask(size) & (known[slots >> 3] >> (slots & 7) & 1 > 0))
                    yield tx.to_batch(
                        {"_doc": tx.column(chunk, "doc_id").take(pa.array(doc[at])), "_k": tx.column(chunk, "_key").take(pa.array(doc[at])), "at": (at - words.first[doc[at]]).astype(np.int64), "size": np.full(len(at), size, np.int32), "hash": words.windows(size)[at].view(np.int64), "words": [b" ".join(map(words.text, range(i, i + size))) for i in at]},
                        {"at": pa.int64(), "size": pa.int32(), "hash": pa.int64(), "words": pa.binary()},
                    )

    cuts = keyed.mapInArrow(cut, "_doc long, _k long, at long, size int, hash long, words binary")
    hits = cuts.join(windows, ["size", "hash", "words"]).select("_doc", "_k", "at", "size", "item")
    step = F.struct("at", (F.col("at") + F.col("size")).alias("stop"))
    spans = F.array_sort(F.collect_set(step))
    merged = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["at"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["stop"]).alias("to")))
    return hits.groupBy("_doc", "_k").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items")).select("_doc", "_k", "items", "spans", merged["n"].alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated documents; in the others hit spans are cut out of ``text``.

    A cut span reaches from the first to the last byte of a run of hit words.
    Every other column is returned as it came.
    """
    ship(docs.sparkSession)
    windows, shared = _load(docs, benchmark, broadcast_bytes)
    if shared is not None:

        def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = words_of(tx.column(batch, "text"))
            hit, _ = covered(words, shared.value.hits(words))
            return _cut(batch, words, hit)

        return docs.mapInArrow(tx.per_chunk(scan), docs.schema)
    found = _joined(tx.id_and_text(docs), windows).select("_doc", "_k", F.struct("spans").alias("_spans"))
    joined = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.xxhash64(docs["text"].cast("string")).alias("_key"))
    joined = joined.join(found, joined["_row.doc_id"].cast("long").eqNullSafe(found["_doc"]) & (joined["_key"] == found["_k"]), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = tx.column(batch, "_row")
            rows = pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in row.type])
            spans = tx.column(batch, "_spans").to_pylist()
            words = words_of(tx.column(rows, "text"))
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for i, one in enumerate(spans):
                for s in one["spans"] if one else ():
                    edge[words.first[i] + s["at"]] += 1
                    edge[words.first[i] + s["stop"]] -= 1
            yield _cut(rows, words, np.cumsum(edge[:-1]) > 0)

    return joined.select("_row", "_spans").mapInArrow(cut, docs.schema)


def _cut(batch: pa.RecordBatch, words: tx.Words, hit: np.ndarray) -> pa.RecordBatch:
    if not hit.any():
        return batch
    data, offsets = tx.flat(tx.column(batch, "text"))
    texts = tx.column(batch, "text").to_pylist()
    keep, changed = np.ones(batch.num_rows, dtype=bool), []
    for i in np.unique(words.docs()[hit]):
        own = hit[words.first[i] : words.first[i + 1]]
        if SHARE * own.sum() >= len(own):
            keep[i] = False
            continue
        edges = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
        left, out = offsets[i], []
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            out.append(data[left : words.starts[words.first[i] + a]].tobytes())
            left = words.ends[words.first[i] + b - 1]
        changed.append(int(i))
        texts[i] = b"".join([*out, data[left : offsets[i + 1]].tobytes()]).decode()
    return tx.with_texts(batch, texts, changed).filter(pa.array(keep))
