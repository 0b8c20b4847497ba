"""A convolutional text classifier for toxicity, in numpy.

Every word is the sum of two hashed embeddings, of the whole lower-cased word
and of its first ``STEM`` bytes. Filters one, two and three words wide run over
the whole text, each filter keeps its greatest response, and a logistic layer
weighs those. Training is Adagrad over every labelled row that may be learned
from; the gradient of max pooling reaches one place per filter and text only.

Rows are dealt to learners of about ``LEARNER_BYTES`` of word numbers each. A
learner goes through all its rows, some epochs a round, from the same start as
the others; a parameter then moves by the mean of the learners that changed it,
weighed by their rows, and so does Adagrad's memory. Of the rows without a label
most are left out before any are shuffled, by ``2**MARK_BITS`` bits (a fixed
size whatever the input) that mark the hashes of labelled ids; the join decides.

Thresholds are calibrated by language on a fifth of the rows, kept apart from
the fitting by their hash: all of them count, by log odds in steps of
``1 / STEPS``. The language is guessed from the text, by hashed word frequencies
of all rows that may be learned from; a language with few toxic rows takes the
threshold of all. A score is the raw probability bent so that its language's
threshold lies at ``THRESHOLD``.

Defined results: null and empty texts pool nothing and score by the bias, in
no language; with no rows of both classes to learn from every score is 0; null
labels are skipped; more than ``langid.MOST_LANGUAGES`` languages to learn from
are an error; rows of ``docs`` that repeat a ``doc_id`` are scored each
on its own, and learned from once if their text is the same; equally likely
languages go to the alphabetically first, and a score of exactly 0.3 is
predicted 1; words are bytes, so texts that are no UTF-8 are scored like any;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textops as tx
from lexloom.llm.langid import MOST_LANGUAGES
from lexloom.llm.quality import sigmoid
from lexloom.session import checkpoint_dir

#: Bytes of word numbers that one learner holds; more rows are more learners.
LEARNER_BYTES = 16 << 20
#: Times that learners are brought together.
ROUNDS = 3
#: Parameters that are brought together by one task.
BLOCK = 1 << 15
MARK_BITS = 24
#: Of log odds, in calibration.
STEPS = 512
#: Of a word's two bucket numbers where rows are stored.
CODE = np.uint16
BITS = 15
STEM = 5
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 10
THRESHOLD = 0.3
#: Toxic calibration rows that a language needs for a threshold of its own.
LEAST_TOXIC = 15
HELD_DIVISOR, HELD_REMAINDER = 4, 2


def word_ids(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Two bucket numbers for each word, and the edges of the texts."""
    data, offsets = tx.flat(column)
    words = tx.Words(tx.LOWER[data], offsets, tx.WORDISH)
    stems = tx.span_hashes(words.data, words.starts, np.minimum(words.starts + STEM, words.ends))
    ids = np.stack([words.hashes() >> tx.U64(64 - bits), (stems >> tx.U64(64 - bits)) + tx.U64(1 << bits)], axis=1)
    return ids.astype(np.int32), words.first


def _responses(x: np.ndarray, edges: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response of each filter in each text, and where; no place is past a text's end."""
    width, dim, n = filters.shape
    counts = np.diff(edges)
    some = np.flatnonzero(counts > 0)
    best, where = np.zeros((len(counts), n), np.float32), np.full((len(counts), n), -1, np.int64)
    if not len(some):
        return best, where
    y = x @ filters[0]
    room = np.repeat(edges[1:], counts) - np.arange(len(x))
    for j in range(1, width):
        more = x[j:] @ filters[j]
        more[room[:-j] <= j] = 0
        y[:-j] += more
    y += bias
    best[some] = np.maximum.reduceat(y, edges[:-1][some], axis=0)
    return best, y


def _places(y: np.ndarray, edges: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The first place of each text's greatest response, -1 in empty texts."""
    where = np.full(best.shape, -1, np.int64)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            where[i] = a + np.argmax(y[a:b], axis=0)
    return where


class Network:
    def __init__(self, bits: int = BITS, dim: int = DIM, filters: int = FILTERS, widths: tuple[int, ...] = WIDTHS, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.embedding = normal(2 << bits, dim, scale=0.1)
        self.filters = [normal(w, dim, filters, scale=(1 / (w * dim)) ** 0.5) for w in widths]
        self.biases = [np.zeros(filters, np.float32) for _ in widths]
        self.out = normal(len(widths) * filters, scale=0.3)
        self.bias = np.zeros(1, np.float32)

    def parts(self) -> dict[str, np.ndarray]:
        several = {f"filters{k}": f for k, f in enumerate(self.filters)} | {f"bias{k}": b for k, b in enumerate(self.biases)}
        return {"embedding": self.embedding, **several, "out": self.out, "bias": self.bias}

    def cut(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Copies of the stretches of ``flat`` that stand for each part."""
        parts = self.parts()
        edges = np.cumsum([x.size for x in parts.values()])[:-1]
        return {name: piece.reshape(x.shape).copy() for (name, x), piece in zip(parts.items(), np.split(flat, edges))}

    def put(self, flat: np.ndarray) -> Network:
        pieces = self.cut(flat)
        for name, x in self.parts().items():
            x[...] = pieces[name]
        return self

    def forward(self, ids: np.ndarray, edges: np.ndarray, places: bool = False):
        x = self.embedding[ids[:, 0]] + self.embedding[ids[:, 1]]
        pooled, where = [], []
        for filters, bias in zip(self.filters, self.biases):
            best, y = _responses(x, edges, filters, bias)
            pooled.append(np.maximum(best, 0))
            if places:
                where.append(_places(y, edges, best))
        pooled = np.concatenate(pooled, axis=1)
        p = sigmoid((pooled @ self.out + self.bias).astype(np.float64))
        return (p, pooled, where, x) if places else p

    def step(self, ids: np.ndarray, edges: np.ndarray, labels: np.ndarray, weights: np.ndarray, memory: dict, rate: float) -> None:
        p, pooled, where, x = self.forward(ids, edges, places=True)
        error = ((p - labels) * weights / len(labels)).astype(np.float32)
        back = error[:, None] * self.out * (pooled > 0)
        grads: dict[str, tuple] = {"out": (self.out, pooled.T @ error + 1e-5 * self.out), "bias": (self.bias, error.sum(keepdims=True))}
        touched, towards = [], []
        n = self.biases[0].shape[0]
        for k, filters in enumerate(self.filters):
            own = back[:, k * n : (k + 1) * n]
            doc, f = np.nonzero((own != 0) & (where[k] >= 0))
            at, g = where[k][doc, f], own[doc, f]
            grads[f"bias{k}"] = (self.biases[k], np.bincount(f, g, minlength=n).astype(np.float32))
            change = np.zeros_like(filters)
            for j in range(filters.shape[0]):
                inside = at + j < edges[doc + 1]
                place, gj, fj = at[inside] + j, g[inside], f[inside]
                np.add.at(change[j].T, fj, gj[:, None] * x[place])
                touched.append(place)
                towards.append(gj[:, None] * filters[j].T[fj])
            grads[f"filters{k}"] = (filters, change)
        for name, (value, grad) in grads.items():
            seen = memory.setdefault(name, np.full(value.shape, 1e-6, np.float32))
            seen += grad * grad
            value -= rate * grad / np.sqrt(seen)
        if touched:
            place, g = np.concatenate(touched), np.concatenate(towards)
            rows, back_to = np.unique(ids[place].ravel(), return_inverse=True)
            grad = np.zeros((len(rows), g.shape[1]), np.float32)
            np.add.at(grad, back_to.reshape(-1), np.repeat(g, 2, axis=0))
            seen = memory.setdefault("embedding", np.full(self.embedding.shape, 1e-6, np.float32))
            seen[rows] += grad * grad
            self.embedding[rows] -= rate * grad / np.sqrt(seen[rows])


class Languages:
    """Guesses a text's language by the frequencies of hashed words."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])).T.astype(np.float32) if names else None

    def guess(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Number of the likeliest language, -1 for empty texts."""
        out = np.full(len(edges) - 1, -1, np.int64)
        some = np.flatnonzero(np.diff(edges) > 0)
        if self.table is not None and len(some):
            out[some] = np.add.reduceat(self.table[ids[:, 0]], edges[:-1][some], axis=0).argmax(axis=1)
        return out


def _odds(p):
    return np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))


def _threshold(odds: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The middle, in log odds, of the gap at which F1 is greatest. ``n``: rows with those log odds and that label."""
    odds, at = np.unique(-odds, return_inverse=True)
    odds, rows, toxic = -odds, np.bincount(at, n), np.bincount(at, n * y)
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(rows) + toxic.sum())
    k = int(np.argmax(f1))
    below = odds[k + 1] if k + 1 < len(odds) else _odds(0.0)
    return float(np.clip(sigmoid((odds[k] + below) / 2), 0.01, 0.99))


class Model:
    def __init__(self, network: Network | None, languages: Languages, thresholds: np.ndarray):
        """thresholds: by language, that of no language last."""
        self.network, self.languages, self.thresholds = network, languages, thresholds

    def score(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(edges) - 1)
        p = self.network.forward(ids, edges)
        t = self.thresholds[self.languages.guess(ids, edges)]
        return np.where(p < t, THRESHOLD * p / t, THRESHOLD + (1 - THRESHOLD) * (p - t) / (1 - t))


def _gathered(rows: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate([[0], np.cumsum([len(rows[i]) for i in which])]).astype(np.int64)
    return np.concatenate([np.zeros((0, 2), np.int32), *(rows[i] for i in which)]), edges


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of stored rows, as of ``word_ids``, and the edges of the texts."""
    data, offsets = tx.flat(column)
    return data.view(CODE).reshape(-1, 2), offsets // (2 * CODE().itemsize)


def _slot(doc_id: str):
    return F.xxhash64(doc_id).bitwiseAND((1 << MARK_BITS) - 1).cast("int")


def _marks(known: DataFrame) -> np.ndarray:
    """Bytes of ``2**MARK_BITS`` bits; that of every id's slot is set."""
    block = 1 << 16

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(block, bool)
        bits[table.column("slot").to_numpy() % block] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slots = known.select(_slot("_id").alias("slot")).distinct()
    out = np.zeros((1 << MARK_BITS) // 8, np.uint8)
    for r in slots.groupBy(F.floor(F.col("slot") / block).cast("int").alias("block")).applyInArrow(gather, "block int, bits binary").toArrow().to_pylist():
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, _hash, label, lang, ids and apart of every labelled row that may be learned from, rows that repeat id and text once."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and _id is not null")
    known = known.where(~tx.held_out(HELD_DIVISOR, HELD_REMAINDER, "_id")).distinct()
    tx.id_and_text(docs)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & ~tx.held_out(HELD_DIVISOR, HELD_REMAINDER)).select("*", F.xxhash64("text").alias("_hash"), _slot("doc_id").alias("_slot"))
    marks = docs.sparkSession.sparkContext.broadcast(_marks(known))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = tx.column(batch, "_slot").to_numpy()
        batch = batch.filter(pa.array((marks.value[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)))
        ids, edges = word_ids(tx.column(batch, "text"))
        ids = ids.astype(CODE)
        return tx.to_batch({k: tx.column(batch, k) for k in ("doc_id", "_hash", "lang")} | {"ids": [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]}, {"ids": pa.binary()})

    cuts = rows.mapInArrow(tx.per_chunk(cut), "doc_id long, _hash long, lang string, ids binary")
    joined = cuts.join(known, cuts["doc_id"] == known["_id"])
    once = joined.groupBy("doc_id", "_hash", "label").agg(F.min("lang").alias("lang"), F.first("ids").alias("ids"))
    return once.withColumn("apart", F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(5)) == 0)


def _languages(rows: DataFrame) -> Languages:
    """By the words of all rows whose language is known."""
    names = sorted(r["lang"] for r in rows.where("lang is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    number = {x: i for i, x in enumerate(names)}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, edges = _codes(tx.column(batch, "ids"))
        langs = np.array([number[x] for x in tx.column(batch, "lang").to_pylist()])
        both, n = np.unique(np.repeat(langs << BITS, np.diff(edges)) | ids[:, 0], return_counts=True)
        return tx.to_batch({"lang": both >> BITS, "word": both & ((1 << BITS) - 1), "n": n}, {"lang": pa.int32(), "word": pa.int32(), "n": pa.int64()})

    found = rows.where("lang is not null").select("lang", "ids").mapInArrow(tx.per_chunk(count, "ids"), "lang int, word int, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), 1 << BITS))
    counts[found.column("lang").to_numpy(), found.column("word").to_numpy()] = found.column("n").to_numpy()
    return Languages(names, counts)


def _round(rows: DataFrame, flat: np.ndarray, seen: np.ndarray, balance: tuple[float, float], epochs: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and Adagrad's memory after ``epochs`` of each partition of ``rows``, which is one learner."""
    start = rows.sparkSession.sparkContext.broadcast((flat, seen))

    def learn(batches):
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        label, key = held.column("label").to_numpy(), [held.column(c).to_numpy() for c in ("_hash", "label", "doc_id")]
        codes, edges = _codes(held.column("ids"))
        order = np.lexsort(key)
        words, y = [codes[edges[i] : edges[i + 1]] for i in order], label[order].astype(np.float64)
        weights = np.where(y == 1, balance[1], balance[0])
        network = Network().put(start.value[0])
        memory, rng = network.cut(start.value[1]), np.random.default_rng(seed)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
                network.step(*_gathered(words, batch), y[batch], weights[batch], memory, 0.05)
        now = [np.concatenate([x[name].ravel() for name in network.parts()]) for x in (network.parts(), memory)]
        value, more = now[0] - start.value[0], now[1] - start.value[1]
        types = {"block": pa.int32(), "first": pa.int64(), "n": pa.int64(), "at": pa.binary(), "value": pa.binary(), "seen": pa.binary()}
        for block in range(-(-len(value) // BLOCK)):
            span = slice(block * BLOCK, (block + 1) * BLOCK)
            at = (value[span] != 0) | (more[span] != 0)
            if at.any():
                yield tx.to_batch({"block": [block], "first": [int(key[2][order[0]])], "n": [len(y)], "at": [np.packbits(at).tobytes()], "value": [value[span][at].tobytes()], "seen": [more[span][at].tobytes()]}, types)

    def together(table: pa.Table) -> pa.Table:
        sums = np.zeros((3, BLOCK))
        for r in sorted(table.to_pylist(), key=lambda r: (r["first"], r["n"])):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(r["at"], np.uint8)))
            sums[:, at] += r["n"] * np.stack([np.ones(len(at)), np.frombuffer(r["value"], np.float32), np.frombuffer(r["seen"], np.float32)])
        means = (sums[1:] / np.maximum(sums[0], 1)).astype(np.float32)
        return pa.table({"block": table.column("block").slice(0, 1), "value": pa.array([means[0].tobytes()], pa.binary()), "seen": pa.array([means[1].tobytes()], pa.binary())})

    changes = rows.select("doc_id", "_hash", "label", "ids").mapInArrow(learn, "block int, first long, n long, at binary, value binary, seen binary")
    flat, seen = flat.copy(), seen.copy()
    for r in changes.groupBy("block").applyInArrow(together, "block int, value binary, seen binary").toArrow().to_pylist():
        for all_of, change in ((flat, r["value"]), (seen, r["seen"])):
            span = all_of[r["block"] * BLOCK : (r["block"] + 1) * BLOCK]
            span += np.frombuffer(change, np.float32)[: len(span)]
    start.unpersist()
    return flat, seen


def _thresholds(rows: DataFrame, network: Network, languages: Languages) -> np.ndarray:
    """By language, that of no language last."""
    shared = rows.sparkSession.sparkContext.broadcast((network, languages))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        network, languages = shared.value
        ids, edges = _codes(tx.column(batch, "ids"))
        step = np.rint(_odds(network.forward(ids, edges)) * STEPS)
        return tx.to_batch({"label": tx.column(batch, "label"), "step": step.astype(np.int32), "lang": languages.guess(ids, edges).astype(np.int32)}, {"step": pa.int32(), "lang": pa.int32()})

    judged = rows.select("label", "ids").mapInArrow(tx.per_chunk(run, "ids"), "label int, step int, lang int")
    found = judged.groupBy("lang", "step", "label").agg(F.count("*").alias("n")).toArrow()
    lang, step, y, n = (found.column(c).to_numpy() for c in ("lang", "step", "label", "n"))
    thresholds = np.full(len(languages.names) + 1, _threshold(step / STEPS, y, n))
    for k in range(len(languages.names)):
        own = lang == k
        if n[own & (y == 1)].sum() >= LEAST_TOXIC and (y[own] == 0).any():
            thresholds[k] = _threshold(step[own] / STEPS, y[own], n[own])
    return thresholds


def train(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> Model:
    checkpoint_dir(docs.sparkSession)
    rows = learnable(docs, labels).checkpoint()
    languages = _languages(rows)
    counts = {(r["apart"], r["label"]): r for r in rows.groupBy("apart", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("ids")).alias("size")).collect()}
    n = {k: r["n"] for k, r in counts.items()}
    both = lambda parts: all(any((part, y) in n for part in parts) for y in (0, 1))
    if not both((True, False)):
        return Model(None, languages, np.full(len(languages.names) + 1, 0.5))
    # few rows may all fall on one side
    fit = (False,) if both((False,)) else (False, True)
    of_fit = rows.where(F.col("apart").isin(*fit))
    of_apart = rows.where("apart") if len(fit) == 1 and both((True,)) else of_fit
    by_label = [sum(n.get((part, y), 0) for part in fit) for y in (0, 1)]
    fitted = sum(by_label)
    learners = max(1, -(-sum(r["size"] for k, r in counts.items() if k[0] in fit) // LEARNER_BYTES))
    dealt = of_fit.coalesce(learners) if of_fit.rdd.getNumPartitions() >= learners else of_fit.repartition(learners, "doc_id", "_hash").checkpoint()
    network = Network()
    flat = np.concatenate([x.ravel() for x in network.parts().values()])
    seen = np.full(len(flat), 1e-6, np.float32)
    epochs = min(max(epochs, -(-3_000 // fitted)), 40)
    for k in range(ROUNDS):
        some = epochs * (k + 1) // ROUNDS - epochs * k // ROUNDS
        flat, seen = _round(dealt, flat, seen, tuple(0.5 * fitted / x for x in by_label), some, [5, k])
    network.put(flat)
    return Model(network, languages, _thresholds(of_apart, network, languages))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, edges = word_ids(tx.column(batch, "text"))
        return tx.to_batch({"doc_id": tx.column(batch, "doc_id"), "score": np.round(np.clip(model.value.score(ids, edges), 0.0, 1.0), 6)}, {"score": pa.float64()})

    scored = tx.id_and_text(docs).mapInArrow(tx.per_chunk(run), "doc_id long, score double")
    return scored.select("doc_id", tx.held_out(HELD_DIVISOR, HELD_REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
