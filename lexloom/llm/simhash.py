"""SimHash near-dedup with anchor points of a covering code.

A text's fingerprint has 64 bits: bit i is 1 if it is set in over half of the
XXH64 hashes (seed 42) of its lower-cased ``SHINGLE``-word shingles, repeats
included. Fingerprints that differ in at most ``DISTANCE`` bits are linked.

The anchors are the codewords of a covering code over some of the bits. Each
fingerprint goes to every anchor within the covering radius plus a threshold
and is compared, at the anchors within the covering radius (its own), with all
that came there. With the two perfect Golay codes below (bits 0-22 and 23-45,
radius 3) one of the two ranges holds at most one of three differing bits, so
the threshold is 1 and a fingerprint is copied 10.6 times on average. Above
``MANY`` distinct fingerprints four Hamming codes (15 bits, radius 1) are
paired: some pair holds at most one of three differing bits, and there are
2**22 anchors in place of 2**12. Either plan finds every link.

Copies share one fingerprint and are compared once. At an anchor, two
fingerprints are compared if they agree in one of four bit ranges, as any two
that link do; what is linked is joined to the smallest fingerprint there (a
star, never all pairs). The number of groups and tasks follows the number of
fingerprints, and an anchor with too many is split by bit range and value, so
no group grows with the input. Components are closed over the stars by
alternating large-star and small-star rounds.

Defined results: null texts and texts without words have fingerprint zero and
link like any other; a text of fewer words than a shingle is one shingle; rows
that repeat a ``doc_id`` each get a row; a null ``doc_id`` is never a
component's name unless it is alone there; other columns are ignored (and
kept by ``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import textops as tx
from lexloom.session import checkpoint_dir

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Distinct fingerprints above which the finer anchors are taken.
MANY = 50_000_000
#: Copies at one anchor above which it is split by bit ranges.
HOT = 2_000_000
#: Copies that are compared at once, and that a task reads, about.
GROUP, PARTITION = 1 << 19, 1 << 22


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and only the six ASCII spaces
    if not words:
        return 0
    plain = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    n = len(words) - size + 1
    for at in range(0, n, 1 << 16):
        some = [digest(plain[a : b - 1], SEED) for a, b in zip(starts[at : min(at + (1 << 16), n)], ends[at + size - 1 : min(at + (1 << 16), n) + size - 1])]
        total += np.unpackbits(np.array(some, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _hash of the text and fingerprint (as a long of the same bits) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = tx.column(batch, "text")
        prints = np.array([fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts], dtype=np.uint64)
        return tx.to_batch({"doc_id": tx.column(batch, "doc_id"), "_hash": tx.column(batch, "_hash"), "fp": prints.view(np.int64)}, {"fp": pa.int64()})

    table = tx.id_and_text(docs).withColumn("_hash", F.xxhash64("text"))
    return table.mapInArrow(tx.per_chunk(run), "doc_id long, _hash long, fp long")


class CoveringCode:
    """A cyclic code: the codewords near a word are the word plus light patterns of its syndrome."""

    def __init__(self, length: int, generator: int, radius: int, beyond: int):
        self.length, self.radius = length, radius
        checks = generator.bit_length() - 1
        units = []
        for bit in range(length):
            rest = 1 << bit
            for high in range(bit, checks - 1, -1):
                if rest >> high & 1:
                    rest ^= generator << (high - checks)
            units.append(rest)
        self.half = length // 2
        self.low = self._sums(units[: self.half])
        self.high = self._sums(units[self.half :])
        patterns = [sum(1 << b for b in bits) for weight in range(radius + beyond + 1) for bits in combinations(range(length), weight)]
        patterns = np.array(patterns, dtype=np.int64)
        weights = np.bitwise_count(patterns).astype(np.int64)
        syndromes = self.syndrome(patterns)
        order = np.lexsort((weights, syndromes))
        self.patterns = patterns[order]
        self.over = np.maximum(weights[order] - radius, 0)
        self.edges = np.searchsorted(syndromes[order], np.arange((1 << checks) + 1))

    @staticmethod
    def _sums(units: list[int]) -> np.ndarray:
        out = np.zeros(1, dtype=np.int64)
        for u in units:
            out = np.concatenate([out, out ^ u])
        return out

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & ((1 << self.half) - 1)] ^ self.high[words >> self.half]

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every word its codewords in reach: the word's number, codeword, and distance over the radius."""
        s = self.syndrome(words)
        n = self.edges[s + 1] - self.edges[s]
        which = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.edges[s][which]
        return which, words[which] ^ self.patterns[at], self.over[at]


#: g(x) = x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the perfect binary Golay code.
_GOLAY = (23, 0xC75, 3)
#: g(x) = x^4 + x + 1 of the Hamming code of 15 bits.
_HAMMING = (15, 0x13, 1)


#: Copies of a fingerprint over all families, on average and rounded up.
_COPIES, _COPIES_MANY = 11, 85


class Plan:
    """Families of anchors; each is a product of codes over bit ranges with one threshold in all."""

    def __init__(self, many: bool, threshold: int = 1):
        length, polynomial, radius = _HAMMING if many else _GOLAY
        self.code = CoveringCode(length, polynomial, radius, threshold)
        self.threshold = threshold
        ranges = range(4) if many else range(2)
        self.families = list(combinations(ranges, 2)) if many else [(r,) for r in ranges]

    def deal(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per family: numbers of fingerprints, anchor keys and whether the anchor is the fingerprint's own."""
        size = self.code.length
        for k, family in enumerate(self.families):
            which = np.arange(len(prints))
            keys = np.full(len(prints), k, dtype=np.int64)
            over = np.zeros(len(prints), dtype=np.int64)
            for r in family:
                bits = ((prints >> np.uint64(r * size)) & np.uint64((1 << size) - 1)).astype(np.int64)
                again, words, more = self.code.anchors(bits[which])
                keys, over, which = keys[again] << size | words, over[again] + more, which[again]
                near = over <= self.threshold
                keys, over, which = keys[near], over[near], which[near]
            yield which, keys, over == 0


#: Bit ranges of which one at least is alike in two fingerprints of at most DISTANCE differing bits.
def _blocks(distance: int) -> list[tuple[int, int]]:
    n = distance + 1
    edges = [64 * k // n for k in range(n + 1)]
    return list(zip(edges, edges[1:]))


def _near(group: np.ndarray, prints: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (numbers) within a group of which one at least is at its own anchor and that differ in at most so many bits.

    Such a pair agrees in one of ``distance + 1`` bit ranges, so only members
    that do are compared.
    """
    left, right = [], []
    for low, high in _blocks(distance):
        block = (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.lexsort((block, group))
        g, v, p, o = group[order], block[order], prints[order], own[order]
        run = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])) if len(g) else np.zeros(0, np.int64)
        room = np.repeat(np.append(run[1:], len(g)), np.diff(run, append=len(g))) - np.arange(len(g)) - 1
        at, step = np.flatnonzero(room > 0), 1
        while len(at):
            close = np.bitwise_count(p[at] ^ p[at + step]) <= distance
            close &= o[at] | o[at + step]
            left.append(order[at[close]])
            right.append(order[at[close] + step])
            step += 1
            at = at[room[at] >= step]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _stars(group: np.ndarray, prints: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each group, as each linked fingerprint and the smallest that it reaches there."""
    order = np.lexsort((prints, group))
    group, prints, own = group[order], prints[order], own[order]
    a, b = _near(group, prints, own, distance)
    labels = np.arange(len(prints))
    while len(a):
        least = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], least)
        np.minimum.at(labels, labels[b], least)
        while (labels[labels] != labels).any():
            labels = labels[labels]
        if (labels == before).all():
            break
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return prints[moved], prints[labels[moved]]


def links(distinct: DataFrame, n: int, distance: int = DISTANCE, many: int = MANY, hot: int = HOT) -> DataFrame:
    """Stars (fp, to) whose closure is that of all links among the ``n`` distinct fingerprints.

    Anchors are compared in groups of about ``GROUP`` copies, however many
    there are. An anchor with more than ``hot`` copies, which can only be if
    there are more fingerprints than that, is split: each of its fingerprints
    goes to a group for each bit range and value (see ``_near``), which keeps
    every pair that can link.
    """
    plan = Plan(n > many)
    copies = max(1, n * (_COPIES_MANY if n > many else _COPIES))
    partitions = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-copies // PARTITION))
    groups = max(4 * partitions, -(-copies // GROUP))
    ranges = _blocks(distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = tx.column(batch, "fp").to_numpy().view(np.uint64)
            for a in range(0, len(prints), 1 << 14):
                part = prints[a : a + (1 << 14)]
                for which, keys, own in plan.deal(part):
                    yield tx.to_batch({"anchor": keys, "fp": part[which].view(np.int64), "own": own}, {"anchor": pa.int64(), "fp": pa.int64(), "own": pa.bool_()})

    def compare(table: pa.Table) -> pa.Table:
        fp, to = _stars(table.column("anchor").to_numpy(), table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy(), distance)
        pairs = np.unique(np.stack([fp, to]), axis=1)
        return pa.table({"fp": pa.array(pairs[0].view(np.int64)), "to": pa.array(pairs[1].view(np.int64))})

    dealt = distinct.mapInArrow(deal, "anchor long, fp long, own boolean")
    if n > hot:
        dealt = _split_hot(dealt, hot, ranges)
    grouped = dealt.withColumn("grp", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")).repartition(partitions, "grp")
    return grouped.groupBy("grp").applyInArrow(compare, "fp long, to long").distinct()


def _split_hot(dealt: DataFrame, hot: int, ranges: list[tuple[int, int]]) -> DataFrame:
    """The copies, those at anchors with more than ``hot`` as one at a group for each bit range and its value."""
    crowded = dealt.groupBy("anchor").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(F.col("anchor").alias("_hot"))
    marked = dealt.join(crowded, dealt["anchor"] == crowded["_hot"], "left")
    bits = lambda low, high: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
    parts = F.array(*[F.xxhash64("anchor", F.lit(k), bits(low, high)) for k, (low, high) in enumerate(ranges)])
    key = F.explode(F.when(F.col("_hot").isNull(), F.array("anchor")).otherwise(parts)).alias("anchor")
    return marked.select(key, "fp", "own")


def close(edges: DataFrame) -> DataFrame:
    """(fp, to) with one row per vertex but the roots: ``to`` is the component's smallest vertex.

    Alternating large-star and small-star rounds; each is a partial
    aggregation, a join and a checkpoint in the shared folder.
    """
    checkpoint_dir(edges.sparkSession)

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both)
        return both.join(m, both["u"] == m["c"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        m = least(e)
        joined = e.join(m, e["u"] == m["c"])
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = edges.select(F.greatest("fp", "to").alias("u"), F.least("fp", "to").alias("v")).where("u != v").distinct().checkpoint()
    before, after = None, state(now)
    while before != after:
        before = after
        now = small(large(now)).checkpoint()
        after = state(now)
    return now.select(F.col("u").alias("fp"), F.col("v").alias("to"))


def _rooted(docs: DataFrame, distance: int, many: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints by row; and by distinct fingerprint its smallest doc_id (``first``) and its component (``root``)."""
    checkpoint_dir(docs.sparkSession)
    prints = fingerprints(docs).checkpoint()
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    closed = close(links(distinct.select("fp"), distinct.count(), distance, many))
    return prints, distinct.join(closed, "fp", "left").select("fp", "first", F.coalesce("to", "fp").alias("root"))


def components(docs: DataFrame, distance: int = DISTANCE, many: int = MANY) -> DataFrame:
    """Per row: doc_id, fp (long) and component_id, the smallest doc_id reachable over links."""
    prints, rooted = _rooted(docs, distance, many)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the first by doc_id (null last), then by hash of the text.

    Components are told apart by their root, so rows of different ones that
    share a ``doc_id``, or have none, all stay.
    """
    prints, rooted = _rooted(docs, DISTANCE, MANY)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_hash")
    kept = prints.join(rooted, "fp").groupBy("root").agg(F.min(place).alias("_first")).select(F.col("_first.doc_id").alias("_d"), F.col("_first._hash").alias("_h"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"].cast("string")).alias("_hash"))
    kept = whole.join(kept, whole["_id"].eqNullSafe(kept["_d"]) & (whole["_hash"] == kept["_h"]), "left_semi")
    # rows that repeat id and text are of one component
    first = Window.partitionBy("_id", "_hash").orderBy("_hash")
    return kept.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select("_row.*")
