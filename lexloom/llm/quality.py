"""Hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Features are hashed n-grams of two sequences: the lower-cased words (one and
two words) and the words' forms (one and two): letter case, closing marks and
whether the word repeats the one before. A text's vector holds log counts
scaled to length 1, and its score is the logistic function of one sparse dot
product.

The model is fitted on a bounded sample: of the labelled rows that may be
learned from, the ``TRAIN_ROWS`` with the smallest hash of their id, or as many
of them as it takes to reach ``TRAIN_BYTES`` of text. Scoring covers every
whole text.

Defined results: a null or empty text has no features and scores by the bias
alone; with no rows to learn from every score is 0.5; of rows in ``labels``
that share a ``doc_id`` each distinct one counts, null labels are skipped; rows
of ``docs`` that repeat a ``doc_id`` are scored each on its own, and learned
from once if their text is the same; a score of exactly 0.5 is predicted 1;
words are bytes, so texts that are no UTF-8 are scored like any; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textops as tx

#: Labelled rows that are learned from at most, and bytes of text after which no more are taken.
TRAIN_ROWS = 5_000
TRAIN_BYTES = 32 << 20
BITS = 20
EPOCHS = 4
THRESHOLD = 0.5
#: Rows with this remainder of crc32 by HELD_DIVISOR are never learned from.
HELD_DIVISOR, HELD_REMAINDER = 3, 1

_MARK = tx.mask_of([b for b in range(0x21, 0x7F) if not tx.WORDISH[b]])
_UPPER, _LOWER_CASE = tx.mask_of(range(0x41, 0x5B)), tx.mask_of(range(0x61, 0x7B))


def _count(mask: np.ndarray, words: tx.Words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask[words.data])])
    return sums[words.ends] - sums[words.starts]


def forms(words: tx.Words, lowered: np.ndarray) -> np.ndarray:
    """A small number for each word's form. ``lowered``: hashes of the lower-cased words."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=tx.U64)
    upper, lower = _count(_UPPER, words), _count(_LOWER_CASE, words)
    case = np.where(upper == 0, np.where(lower > 0, 1, 0), np.where(lower > 0, 2, np.where(upper > 1, 4, 3)))
    form = case.astype(tx.U64)
    still = np.ones(n, dtype=bool)
    for k in range(1, 4):  # up to three closing marks
        at = np.maximum(words.ends - k, 0)
        still &= (words.ends - k >= words.starts) & _MARK[words.data[at]]
        form = form * tx.U64(131) + np.where(still, words.data[at], 0).astype(tx.U64)
    same = np.zeros(n, dtype=bool)
    same[1:] = lowered[1:] == lowered[:-1]
    same[words.first[:-1][words.counts > 0]] = False
    return form * tx.U64(2) + same.astype(tx.U64)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and values of a chunk's texts, by row."""
    data, offsets = tx.flat(column)
    words = tx.Words(data, offsets, tx.NON_SPACE)
    lowered = tx.span_hashes(tx.LOWER[data], words.starts, words.ends)
    doc = words.docs()
    two = words.window_mask(2)[:-1] if len(words) else np.zeros(0, dtype=bool)
    keys, rows = [], []
    for salt, one in ((1, lowered), (3, forms(words, lowered))):
        one = tx.mix(one + tx.U64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        pair = tx.mix(one[:-1] * tx.U64(0x9DDFEA08EB382D69) + one[1:])[two]
        keys += [one, pair]
        rows += [doc, doc[:-1][two]]
    key = np.concatenate(keys) >> tx.U64(64 - bits)
    both = np.sort((np.concatenate(rows).astype(tx.U64) << tx.U64(bits)) | key)
    heads = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    value = np.log1p(np.diff(heads, append=len(both))).astype(np.float64)
    row = (both[heads] >> tx.U64(bits)).astype(np.int64)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(offsets) - 1))
    return row, (both[heads] & tx.U64((1 << bits) - 1)).astype(np.int64), value / norm[row]


class FollowTheLeader:
    """Proximal FTRL with L1 and L2 terms, one pass per epoch, one example at a time."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        gradient = (sigmoid(w @ value) - label) * value * weight
        more = gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at] + more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += more


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, remainder: int, most: int, most_bytes: int = TRAIN_BYTES, each: bool = False) -> DataFrame:
    """doc_id, text, lang and label of a bounded sample of the labelled rows that may be learned from.

    Rows are taken by hash of their id, ``most`` at most (of label 0 and 1 each,
    if ``each``), until their texts reach ``most_bytes``; only rows that have
    both a text row and a label count, rows that repeat id and text once. The
    choice is made on ids, hashes and sizes.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where("label is not null and _id is not null")
    known = known.where(~tx.held_out(divisor, remainder, "_id")).distinct()
    tx.id_and_text(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    sizes = rows.select("doc_id", "_hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    there = sizes.join(known, sizes["doc_id"] == known["_id"]).groupBy("_id", "_hash", "label").agg(F.max("size").alias("size"))
    order = [F.xxhash64("_id"), F.col("_id"), F.col("label"), F.col("_hash")]
    parts = [there.where(F.col("label") == y) for y in (1, 0)] if each else [there]
    chosen = []
    for part in parts:
        used = 0
        for r in part.orderBy(*order).limit(most).collect():
            if used >= most_bytes / len(parts):
                break
            chosen.append((r["_id"], r["_hash"], r["label"]))
            used += r["size"]
    picked = docs.sparkSession.createDataFrame(chosen, "_id long, _h long, label int")
    joined = rows.join(F.broadcast(picked), (rows["doc_id"] == picked["_id"]) & (rows["_hash"] == picked["_h"]))
    return joined.dropDuplicates(["doc_id", "_hash", "label"]).select("doc_id", "text", "lang", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the features, the bias last."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, at, value = features(tx.column(batch, "text"), bits)
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
        return tx.to_batch(
            {"doc_id": tx.column(batch, "doc_id"), "label": tx.column(batch, "label"), "at": [at[a:b].astype(np.int32).tobytes() for a, b in zip(edges, edges[1:])], "value": [value[a:b].astype(np.float32).tobytes() for a, b in zip(edges, edges[1:])]},
            {"at": pa.binary(), "value": pa.binary()},
        )

    known = sample(docs, labels, label, HELD_DIVISOR, HELD_REMAINDER, rows).drop("lang").mapInArrow(tx.per_chunk(cut), "doc_id long, label int, at binary, value binary").toArrow()
    size = 1 << bits
    model = FollowTheLeader(size + 1)
    examples = [(np.append(np.frombuffer(a.as_py(), np.int32), size), np.append(np.frombuffer(v.as_py(), np.float32), 1.0), y.as_py()) for a, v, y in zip(known.column("at"), known.column("value"), known.column("label"))]
    keys = sorted(range(len(examples)), key=lambda i: (known.column("doc_id")[i].as_py(), examples[i][2], examples[i][0].tobytes()))
    examples = [examples[i] for i in keys]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            model.learn(*examples[i])
    return model.weights().astype(np.float32)


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows=rows, bits=bits))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = weights.value
        row, at, value = features(tx.column(batch, "text"), bits)
        dot = np.bincount(row, w[at] * value, minlength=batch.num_rows) + w[-1]
        return tx.to_batch({"doc_id": tx.column(batch, "doc_id"), "score": sigmoid(dot.astype(np.float64))}, {"score": pa.float64()})

    scored = tx.id_and_text(docs).mapInArrow(tx.per_chunk(run), "doc_id long, score double")
    return scored.select("doc_id", tx.held_out(HELD_DIVISOR, HELD_REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
