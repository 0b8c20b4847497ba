"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Every partition packs its own pieces best-fit (longest first) and closes the
bins that are nearly full. What is left, the underfull bins, goes up a tree: a
node takes the bins of ``FAN_IN`` children as items, packs again, closes again.
A node holds at most ``NODE_BINS`` open bins per child it hands up; the fullest
of a surplus are closed where they are, so no task grows with the input and no
row is lost.

A bin's number is made of its level, node and place there, so no two share one.

Defined results: null text is empty text (one piece, the end mark); the text of
an added token is that token, as the tokenizer has it; bytes that are no UTF-8
read as U+FFFD; a document of more than ``capacity`` tokens is cut so that all
pieces but the first are full; rows that repeat a ``doc_id`` are packed each on
its own; ties of length go by id, piece and CRC-32; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import textops as tx
from lexloom.session import checkpoint_dir

CAPACITY = 1024
END_ID = 2
#: Children of a tree node.
FAN_IN = 8
#: Bins with at most so many free tokens are closed at once.
NEARLY_FULL = 2
#: Open bins that a node hands up at most.
NODE_BINS = 20_000
#: Pieces that a leaf of the tree takes, about.
LEAF_PIECES = 20_000

_PIECE = "doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint"
_BINS = f"node int, level int, bin bigint, used int, members array<struct<{_PIECE}>>"


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Place of the public tokenizer's JSON file."""
    return public_tokenizers.path(f"{name}.json")


class Encoder:
    """The ids of an untouched tokenizer of the file.

    Its vocabulary as ranks is read where it lies beside, which is faster and
    gives the same ids for texts without the text of an added token; those that
    have one always go to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self._fast = None
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self._fast is not None and not any(t in text for t in self.added):
            try:
                return self._fast.encode_ordinary(text)
            except BaseException as e:  # its regular expression gives up on some endless runs, as a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.exact.encode(text, add_special_tokens=False).ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its document, number, start, length and the CRC-32 of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        serial = 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "deal")}
            for doc, text in zip(tx.column(batch, "doc_id").to_pylist(), tx.strings(tx.column(batch, "text"))):
                ids = np.array([*(encode(text) if text else ()), end_id], dtype="<u4")
                start, stop = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    serial += 1
                    crc = zlib.crc32(ids[start:stop].tobytes())
                    for name, value in zip(rows, (doc, k, start, stop - start, crc, (crc ^ serial * 0x9E3779B1) & 0x7FFFFFFF)):
                        rows[name].append(value)
                    start, stop = stop, stop + capacity
            yield tx.to_batch(rows, {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "deal": pa.int64()})

    return tx.id_and_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the open bin that it leaves the least room in."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    free: list[int] = []  # distinct free room, ascending
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in order:
        at = bisect_left(free, lengths[i])
        if at < len(free):
            room = free[at]
            k = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], free[at]
            bins[k].append(i)
            room -= lengths[i]
        else:
            k, room = len(bins), capacity - lengths[i]
            bins.append([i])
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(free, room)
            by_room[room].append(k)
    return bins


_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


def _filled(items: list[list[dict]]) -> list[dict]:
    """The pieces of several items in one bin, each with its place there."""
    out, at = [], 0
    for one in items:
        for piece in one:
            out.append(piece | {"offset": at})
            at += piece["length"]
    return out


#: Places of the node's number and of the level in a bin's number; whole sequences have a level of their own.
_NODE_BIT, _LEVEL_BIT, _WHOLE = 28, 59, 15


def _number(level: int, node: int, k: int) -> int:
    if level >= _WHOLE or node >= 1 << (_LEVEL_BIT - _NODE_BIT) or k >= 1 << _NODE_BIT:
        raise ValueError("more bins than numbers")
    return level << _LEVEL_BIT | node << _NODE_BIT | k


def _packed(node: int, level: int, last: bool, lengths: list[int], members: list[list], capacity: int, node_bins: int) -> pa.Table:
    """A node's bins; level -1 marks the closed ones."""
    bins = best_fit(lengths, capacity)
    used = [sum(lengths[i] for i in b) for b in bins]
    still = sorted((k for k in range(len(bins)) if capacity - used[k] > NEARLY_FULL), key=lambda k: used[k])
    still = set() if last else set(still[:node_bins])
    return pa.table(
        {
            "node": pa.array([node // FAN_IN] * len(bins), pa.int32()),
            "level": pa.array([level + 1 if k in still else -1 for k in range(len(bins))], pa.int32()),
            "bin": pa.array([_number(level, node, k) for k in range(len(bins))], pa.int64()),
            "used": pa.array(used, pa.int32()),
            "members": pa.array([_filled([members[i] for i in b]) for b in bins], pa.list_(_MEMBER)),
        }
    )


def _merge(level: int, last: bool, capacity: int, node_bins: int):
    """The packing of a node above the leaves, whose items are its children's open bins."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("used", "ascending"), ("bin", "ascending")])
        return _packed(key[0].as_py(), level, last, table.column("used").to_pylist(), table.column("members").to_pylist(), capacity, node_bins)

    return merge


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, leaf_pieces: int = LEAF_PIECES, node_bins: int = NODE_BINS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    cut = pieces(docs, path or vocabulary(), capacity, end_id).checkpoint()
    whole = cut.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().bitwiseOR(F.lit(_WHOLE << _LEVEL_BIT)).alias("_bin"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    leaves = max(1, -(-rest.count() // leaf_pieces))

    def leaf(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        rows = table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).to_pylist()
        return _packed(key[0].as_py(), 0, leaves == 1, [r["length"] for r in rows], [[r] for r in rows], capacity, node_bins)

    levels = [rest.withColumn("node", (F.col("deal") % leaves).cast("int")).groupBy("node").applyInArrow(leaf, _BINS).checkpoint()]
    nodes, level = leaves, 1
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        merge = _merge(level, nodes == 1, capacity, node_bins)
        levels.append(levels[-1].where(F.col("level") == level).groupBy("node").applyInArrow(merge, _BINS).checkpoint())
        level += 1
    placed = None
    for one in levels:
        done = one.where(F.col("level") == -1).select("bin", "members")
        placed = done if placed is None else placed.unionByName(done)
    short = placed.select(F.col("bin").alias("_bin"), F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "_bin", "m.offset")
    return whole.unionByName(short).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_bin").alias("sequence_id"), "offset")
