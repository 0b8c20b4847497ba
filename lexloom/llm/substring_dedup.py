"""Exact substring dedup with fixed-block anchors.

Reference blocks are the non-overlapping blocks of ``BLOCK`` words that start
at every multiple of ``BLOCK`` in every text. Every rolling window of ``BLOCK``
words probes them. A repeat of ``WINDOW`` (at least twice ``BLOCK``) words
holds a whole block of the other copy wherever that copy's blocks lie, so a
window without a hit can't repeat. Hits are then extended: every ``WINDOW``
around one is compared with all others by two independent hashes, of 64 bits
and of 32 bits beside those that choose the bucket, which yields the maximal
exact repeats, and all but the earliest start are removed. (By chance two of
the windows of 100 TB are taken for alike once in 10**9 runs.)

Three passes:

1. probes: per bucket of block hashes, three bytes a word and its place (a
   chance likeness costs an extension, no result); a block is an entry whose
   place is a multiple of ``BLOCK``;
2. extension: hits go back to the partition of their text, whose windows
   around hits are sent on, by bucket of the window's hash;
3. removal: windows that start earlier elsewhere go back to their text.

The text itself is shuffled once; passes 2 and 3 read the same exchange.

Parts and buckets are as many as the bytes of all texts want, ``GROUP_BYTES``
to each, so no task grows with the input. A hot passage is settled where it is
met: probes that meet a block in their own flush, or are there more than
``OFTEN`` times, are extended without asking (which can only extend too much),
and of the windows of one part the earliest start is known, so the others travel
by document. A bucket gets ``OFTEN`` probes and a block of a hot hash from a
flush, or one window from a part, at most.

Defined results: null and empty texts have no words; a text shorter than
``WINDOW`` words loses nothing; documents are ordered by ``doc_id`` (null
first), those that share an id by a hash of id and text, and rows that repeat
both are one document, so none of them is the other's earlier copy; words are
bytes, so texts that are no UTF-8 are as good (``kept`` reads them as U+FFFD);
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textops as tx

#: Words of a reference block; a window of 2 * BLOCK - 1 words or more holds one.
BLOCK = 10
WINDOW = 20
#: Words whose entries a task holds before it writes them out.
FLUSH_WORDS = 1_000_000
#: Times that a probe stands in a flush above which its bucket isn't asked.
OFTEN = 64
#: Bytes of text to a part and to a bucket.
GROUP_BYTES = 16 << 20

_PLACES = "keys binary, runs binary, steps binary"


def _planes(values: np.ndarray) -> bytes:
    """Small unsigned numbers with like bytes side by side, which compresses well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_places(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """Places sorted by document as: first index of each run, run lengths, steps from place to place."""
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    steps = np.diff(at, prepend=0)
    steps[heads] = at[heads]
    return heads, _planes(np.diff(heads, append=len(doc))), _planes(steps)


def unpack_places(runs: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths and places."""
    lengths, values = _from_planes(runs), _from_planes(steps)
    sums = np.cumsum(values)
    heads = np.cumsum(lengths) - lengths
    return lengths, sums - np.repeat(sums[heads] - values[heads], lengths)


class _Gathered:
    """All places of some packed rows: document key and place of each entry."""

    def __init__(self, table: pa.Table):
        keys, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.lengths, self.order = [], []
        for k, r, s in zip(*(table.column(c) for c in ("keys", "runs", "steps"))):
            lengths, places = unpack_places(r.as_py(), s.as_py())
            self.lengths.append(lengths)
            keys.append(np.repeat(np.frombuffer(k.as_py(), np.int64), lengths))
            at.append(places)
        self.keys, self.at = np.concatenate(keys), np.concatenate(at)


def _numbers(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x.as_py(), dtype) for x in table.column(name))])


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """0 to n - 1 by the hash's upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The entries of each bucket that has any, in their order."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1, dtype=bucket.dtype))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _three_bytes(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _from_three(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _by_document(keys: np.ndarray, at: np.ndarray, parts: int) -> Iterator[dict]:
    """Places by the part of their text, as packed rows."""
    part = keys % parts
    order = np.lexsort((at, keys, part))
    keys, at, part = keys[order], at[order], part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, b in zip(edges, [*edges[1:], len(part)]):
        heads, runs, steps = pack_places(keys[a:b], at[a:b])
        yield {"part": int(part[a]), "keys": keys[a:b][heads].tobytes(), "runs": runs, "steps": steps}


def _table(rows: list[dict], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array([r[k] for r in rows], type=t) for k, t in types.items()})


_REPLY = {"part": pa.int32(), "keys": pa.binary(), "runs": pa.binary(), "steps": pa.binary()}
#: Entries by bucket; without tags they are answers on their way, whose bucket is the part of their text.
_PROBE = {"bucket": pa.int32(), "tags": pa.binary(), "keys": pa.binary(), "runs": pa.binary(), "steps": pa.binary()}
_EXTENSION = {"bucket": pa.int32(), "tags": pa.binary(), "seconds": pa.binary(), "ids": pa.binary(), "keys": pa.binary(), "runs": pa.binary(), "steps": pa.binary()}


def _answers(table: pa.Table, column: str, parts: int) -> tuple[pa.Table, list[dict]]:
    """Rows with tags, and those without as replies."""
    tags = table.column(column)
    settled = table.filter(pc.is_null(tags))
    rows = [{"part": b, "keys": k, "runs": r, "steps": s} for b, k, r, s in zip(*(settled.column(c).to_pylist() for c in ("bucket", "keys", "runs", "steps")))]
    return table.filter(pc.is_valid(tags)), rows


def _probes(block: int, buckets: int):
    """Pass 1, map side: every rolling window of ``block`` words by bucket."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes, doc, at = (np.concatenate([h[i] for h in held]) for i in range(3))
        names = np.concatenate([h[3] for h in held])
        # what meets a block here, or stands here often, is extended without asking; a block of it is enough for others
        order = np.argsort(hashes, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        n_all = np.diff(heads, append=len(order))
        is_block = at[order] % block == 0
        n_blocks = np.add.reduceat(is_block.astype(np.int64), heads)
        hit = np.empty(len(hashes), bool)
        hit[order] = np.repeat(n_all > OFTEN, n_all) | (np.repeat(n_blocks, n_all) > is_block)
        own = np.flatnonzero(hit & (at % block == 0))
        send = ~hit
        send[own[np.unique(hashes[own], return_index=True)[1]]] = True
        rows = []
        some = np.flatnonzero(send)
        for b, mine in _by_bucket(_bucket(hashes[some], buckets), buckets):
            mine = some[mine]
            heads, runs, steps = pack_places(doc[mine], at[mine])
            rows.append({"bucket": b, "tags": _three_bytes(hashes[mine]), "keys": names[doc[mine][heads]].tobytes(), "runs": runs, "steps": steps})
        rows += [{"bucket": r.pop("part"), "tags": None, **r} for r in _by_document(names[doc[hit]], at[hit], buckets)]
        yield from _table(rows, _PROBE).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words_held, docs_held = [], 0, 0
        for batch in batches:
            for chunk in tx.chunks(batch, "text"):
                data, offsets = tx.flat(tx.column(chunk, "text"))
                words = tx.Words(data, offsets, tx.NON_SPACE)
                there = np.flatnonzero(words.window_mask(block))
                if not len(there):
                    continue
                doc = words.docs()[there]
                held.append((words.windows(block)[there], doc + docs_held, there - words.first[doc], tx.column(chunk, "_key").to_numpy()))
                docs_held += chunk.num_rows
                words_held += len(words)
                if words_held >= FLUSH_WORDS:
                    yield from flush(held)
                    held, words_held, docs_held = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _probe_hits(block: int, parts: int):
    """Pass 1, bucket side: probes that meet a reference block other than themselves."""

    def run(table: pa.Table) -> pa.Table:
        table, rows = _answers(table, "tags", parts)
        got = _Gathered(table)
        tags = np.concatenate([np.zeros(0, np.uint32), *(_from_three(x.as_py()) for x in table.column("tags"))])
        own = got.at % block == 0
        index, count = np.unique(tags[own], return_counts=True)
        if len(index):
            found = np.minimum(np.searchsorted(index, tags), len(index) - 1)
            hit = np.where(index[found] == tags, count[found], 0) - own > 0
            rows += _by_document(got.keys[hit], got.at[hit], parts)
        return _table(rows, _REPLY)

    return run


def _matched(docs: pa.Table, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each document the edges of its run in the sorted places, and those."""
    got = _Gathered(replies)
    order = np.lexsort((got.at, got.keys))
    keys, at = got.keys[order], got.at[order]
    names = docs.column("_key").to_numpy()
    left, right = np.searchsorted(keys, names, side="left"), np.searchsorted(keys, names, side="right")
    return np.stack([left, right], axis=1), at


def _earliest(tags: np.ndarray, seconds: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are the earliest start of their words here (one each), and which start later than that."""
    order = np.lexsort((at, keys, ids, seconds, tags))
    head = np.ones(len(order), bool)
    head[1:] = (tags[order][1:] != tags[order][:-1]) | (seconds[order][1:] != seconds[order][:-1])
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else order
    later = (ids[order] != ids[first]) | (keys[order] != keys[first]) | (at[order] != at[first])
    return order[head], order[later]


def _extensions(block: int, window: int, buckets: int):
    """Pass 2: windows that hold a hit, by bucket of their hash."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        edges, places = _matched(docs, replies)
        found: list[tuple] = [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3]
        seen = 0
        for batch in docs.to_batches():
            for chunk in tx.chunks(batch, "text"):
                own, seen = edges[seen : seen + chunk.num_rows], seen + chunk.num_rows
                if not (own[:, 1] > own[:, 0]).any():
                    continue
                data, offsets = tx.flat(tx.column(chunk, "text"))
                words = tx.Words(data, offsets, tx.NON_SPACE)
                near = np.zeros(len(words) + window + 1, dtype=np.int32)
                for i in np.flatnonzero(own[:, 1] > own[:, 0]):
                    hits = places[own[i, 0] : own[i, 1]]
                    hits = hits[hits < words.counts[i]]  # two texts of one key share places
                    np.add.at(near, words.first[i] + np.maximum(hits - (window - block), 0), 1)
                    np.add.at(near, words.first[i] + hits + 1, -1)
                there = np.flatnonzero((np.cumsum(near)[: len(words)] > 0) & words.window_mask(window))
                doc = words.docs()[there]
                found.append((words.windows(window)[there], words.windows(window, second=True)[there], tx.column(chunk, "_order").to_numpy()[doc], tx.column(chunk, "_key").to_numpy()[doc], there - words.first[doc]))
        tags, seconds, ids, keys, at = (np.concatenate([f[k] for f in found]) for k in range(5))
        first, later = _earliest(tags, seconds, ids, keys, at)
        rows = []
        first = first[np.lexsort((at[first], keys[first]))]
        for b, mine in _by_bucket(_bucket(seconds[first], buckets), buckets):
            mine = first[mine]
            heads, runs, steps = pack_places(keys[mine], at[mine])
            rows.append({"bucket": b, "tags": tags[mine].tobytes(), "seconds": seconds[mine].astype(np.uint32).tobytes(), "ids": ids[mine][heads].tobytes(), "keys": keys[mine][heads].tobytes(), "runs": runs, "steps": steps})
        rows += [{"bucket": r.pop("part"), "tags": None, "seconds": None, "ids": None, **r} for r in _by_document(keys[later], at[later], buckets)]
        return _table(rows, _EXTENSION)

    return run


def _later(parts: int):
    """Pass 2, bucket side: windows whose words also start earlier."""

    def run(table: pa.Table) -> pa.Table:
        table, rows = _answers(table, "tags", parts)
        got = _Gathered(table)
        ids = np.repeat(_numbers(table, "ids", np.int64), np.concatenate([np.zeros(0, np.int64), *got.lengths]))
        _, later = _earliest(_numbers(table, "tags", np.uint64), _numbers(table, "seconds", np.uint32), ids, got.keys, got.at)
        rows += _by_document(got.keys[later], got.at[later], parts)
        return _table(rows, _REPLY)

    return run


def _removal(window: int, texts: bool):
    """Pass 3: what is left of each text."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        edges, places = _matched(docs, replies)
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for i, text in enumerate(docs.column("text")):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            at = places[edges[i, 0] : edges[i, 1]]
            at = at[at + window <= len(words)]
            gone = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
            keep = np.cumsum(gone[:-1]) == 0
            kept = words if not len(at) else [words[k] for k in np.flatnonzero(keep)]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            joined = b" ".join(kept)
            digests.append(hashlib.sha256(joined).hexdigest())
            if texts:
                kept_texts.append(joined.decode(errors="replace"))
        out = {"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept_texts, pa.string())} if texts else {}))

    return run


def dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, texts: bool = True, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, what is kept of the text."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever the blocks lie")
    table = tx.id_and_text(docs)
    size = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // group_bytes))
    table = table.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("_order"), F.xxhash64("doc_id", "text").alias("_key"))
    dealt = table.withColumn("part", F.pmod("_key", F.lit(n)).cast("int")).repartitionById(n, F.col("part"))
    probes = table.select("text", "_key").mapInArrow(_probes(block, n), f"bucket int, tags binary, {_PLACES}").repartitionById(n, F.col("bucket"))
    hits = probes.groupBy("bucket").applyInArrow(_probe_hits(block, n), f"part int, {_PLACES}").repartitionById(n, F.col("part"))
    extended = dealt.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_extensions(block, window, n), f"bucket int, tags binary, seconds binary, ids binary, {_PLACES}").repartitionById(n, F.col("bucket"))
    later = extended.groupBy("bucket").applyInArrow(_later(n), f"part int, {_PLACES}").repartitionById(n, F.col("part"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return dealt.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(_removal(window, texts), schema)
