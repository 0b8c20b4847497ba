"""Language ID with segmentation-marginalised unigrams.

A fixed public vocabulary of byte pieces is given; for every language each
piece has a probability. A word's probability in a language is the sum over
all its segmentations into pieces of the product of their probabilities,
computed by the forward algorithm; a text's is the product over its words.
The piece probabilities are fitted by expectation-maximisation (forward and
backward sums give expected piece counts).

Words are runs of ASCII letters and non-ASCII characters, ASCII lower-cased,
with a space in front as the vocabulary has it. Words of any length and pieces
of any length are summed whole; sums are scaled as they go, so that none
underflows. All words of a chunk are handled at once: each distinct word once,
by arrays; a worker remembers the words that it has summed, up to
``KNOWN_BYTES``, as most words of a text are frequent ones.

The sample: of the rows that may be learned from, about ``TRAIN_DOCS`` of each
language by hash of id and text, whole texts. More than ``MOST_LANGUAGES``
distinct values of ``lang`` are refused with an error, as a model of that size
doesn't fit a broadcast; no language is left out silently. Prediction covers
every whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is every text if there is nothing to learn from; ties go to the
alphabetically first language; rows that repeat a ``doc_id`` are each
predicted on their own; bytes that are no UTF-8 count as letters beyond ASCII;
other columns are ignored (and kept by ``keep_known``).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textops as tx

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
TRAIN_DOCS = 600
#: Distinct languages that a model can hold.
MOST_LANGUAGES = 2_000
#: Bytes of word sums that a worker remembers.
KNOWN_BYTES = 64 << 20
ROUNDS = 4
UNKNOWN = "und"
#: The pipeline rejects texts whose likeliest language scores less.
LEAST_SCORE = 0.5
HELD_DIVISOR, HELD_REMAINDER = 3, 1

_LETTERS = tx.mask_of([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_SLOT_BITS = 20
_SOME_LETTER = re.compile(rb"[A-Za-z]")


def vocabulary(path: str | None = None) -> list[bytes]:
    """Pieces that words can hold: letters with at most a space in front, and every single byte."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines}
    fits = re.compile(rb" ?[a-z\x80-\xff]+|.", re.DOTALL)
    return sorted({p for p in pieces if fits.fullmatch(p)} | {bytes([b]) for b in range(256)})


#: Bytes of a piece are digits of a number to this base modulo 2**64, the last byte's place being 1.
_BASE = 0x9E3779B97F4A7C15
#: Columns after which sums are scaled, and cells of a lattice that are held at once.
_SCALE_EVERY = 4
_CELLS = 1 << 18


class Pieces:
    """Finds pieces in fixed-width byte matrices by a hash table without loops."""

    def __init__(self, pieces: list[bytes]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest)], dtype=np.uint64)
        # direct slots for most pieces, the rest by binary search
        slots = self._slot(keys)
        self.table = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.table[slots] = np.arange(len(keys))
        self.by_id = keys
        crowded = np.bincount(slots, minlength=1 << _SLOT_BITS) > 1
        self.crowded = crowded

    @staticmethod
    def _key(piece: bytes) -> int:
        value = 0
        for b in piece:
            value = value * _BASE + b + 1
        return value & (1 << 64) - 1

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (tx.mix(keys) >> tx.U64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece number of each key, -1 where there is none."""
        slots = self._slot(keys)
        out = self.table[slots].copy()
        out[(out >= 0) & (self.by_id[np.maximum(out, 0)] != keys)] = -1
        doubt = np.flatnonzero(self.crowded[slots] & (out < 0))
        if len(doubt):
            at = np.minimum(np.searchsorted(self.keys, keys[doubt]), len(self.keys) - 1)
            out[doubt] = np.where(self.keys[at] == keys[doubt], self.ids[at], -1)
        return out


def batches(starts: np.ndarray, ends: np.ndarray, cells: int = _CELLS) -> Iterator[np.ndarray]:
    """Numbers of words, longest first, in groups whose matrices have at most so many cells (or one word)."""
    order = np.argsort(starts - ends, kind="stable")
    lengths = (ends - starts)[order] + 1
    at = 0
    while at < len(order):
        n = max(1, cells // int(lengths[at]))
        yield order[at : at + n]
        at += n


class Lattice:
    """Every piece at every place of some words, the longest first, each with a space in front.

    A place is a column of a word; places are numbered by column, then by word,
    and a column holds the words that reach it, which are the first ones.
    ``entries`` are the pieces that end at each place, in the order of places.
    """

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.lengths, self.longest = ends - starts + 1, pieces.longest
        self.width = int(self.lengths[0]) if len(starts) else 0
        #: words that reach each column, and the first place of each.
        self.live = np.searchsorted(-self.lengths, -np.arange(self.width + 1), side="left")
        self.first = np.concatenate([[0], np.cumsum(self.live[:-1])]).astype(np.int64)
        column = np.repeat(np.arange(self.width), self.live[:-1])
        self.word = np.arange(len(column)) - self.first[column]
        letters = np.full(len(column), 0x20, np.uint8)
        n = len(starts)
        letters[n:] = data[starts[self.word[n:]] + column[n:] - 1]
        keys, found = np.zeros(len(column), np.uint64), []
        for size in range(1, min(self.longest, self.width) + 1):
            here = slice(int(self.first[size - 1]), None)
            start = self.first[column[here] - size + 1] + self.word[here]
            keys[here] += (letters[start].astype(np.uint64) + tx.U64(1)) * pieces.powers[size - 1]
            ids = pieces.find(keys[here])
            some = np.flatnonzero(ids >= 0)
            found.append((some + here.start, start[some], ids[some]))
        self.end, self.start, self.piece = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(self.end, kind="stable")
        self.end, self.start, self.piece = self.end[order], self.start[order], self.piece[order]
        self.column = column
        #: first entry of each place; every single byte is a piece, so each has one.
        self.entries = np.searchsorted(self.end, np.arange(len(column) + 1))

    def _column(self, c: int) -> tuple[int, int, np.ndarray]:
        """Entries that end in a column: from, to, and where each place's begin."""
        edges = self.entries[self.first[c] : self.first[c + 1] + 1]
        return int(edges[0]), int(edges[-1]), edges[:-1] - edges[0]

    def log_totals(self, p: np.ndarray) -> np.ndarray:
        """Logs of the sums over all segmentations of each word; p: pieces x languages."""
        ring = self.longest + 1
        alpha = np.zeros((ring, len(self.lengths), p.shape[1]))
        alpha[0] = 1
        logs, out = np.zeros(alpha.shape[1:]), np.zeros(alpha.shape[1:])
        word, column = self.word[self.start], self.column[self.start]
        with np.errstate(divide="ignore"):
            for c in range(self.width):
                a, b, edges = self._column(c)
                now = np.add.reduceat(alpha[column[a:b] % ring, word[a:b]] * p[self.piece[a:b]], edges, axis=0)
                on, n = int(self.live[c + 1]), len(now)
                out[on:n] = np.log(now[on:]) + logs[on:n]
                alpha[(c + 1) % ring, :n] = now
                if c % _SCALE_EVERY == 0:
                    scale = np.where(now[:on] > 0, now[:on], 1.0)
                    alpha[:, :on] /= scale
                    logs[:on] += np.log(scale)
        return out

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected piece counts; p: pieces x 1, last row 0 for no piece; weights: of the words."""
        p = p[:, 0]
        n_places = len(self.column)
        with np.errstate(divide="ignore"):
            # logs of the sums before and, by place, up to and with each place
            ahead, before = np.zeros(n_places), np.zeros(len(self.start))
            for c in range(self.width):
                a, b, edges = self._column(c)
                last = ahead[self.first[c - 1] : self.first[c - 1] + self.live[c]] if c else np.zeros(int(self.live[c]))
                start = self.start[a:b]
                own = np.where(self.column[start] > 0, ahead[self.first[np.maximum(self.column[start] - 1, 0)] + self.word[start]], 0.0)
                before[a:b] = own
                ahead[self.first[c] : self.first[c + 1]] = last + np.log(np.add.reduceat(np.exp(own - last[self.word[start]]) * p[self.piece[a:b]], edges))
            words = np.arange(len(self.lengths))
            total = ahead[self.first[self.lengths - 1] + words] if len(words) else np.zeros(0)
            # logs of the sums from each place on
            order = np.argsort(self.start, kind="stable")
            begins = np.searchsorted(self.start[order], np.arange(n_places + 1))
            behind, after = np.zeros(n_places), np.zeros(len(self.start))
            for c in range(self.width - 1, -1, -1):
                some = order[begins[self.first[c]] : begins[self.first[c + 1]]]
                edges = begins[self.first[c] : self.first[c + 1]] - begins[self.first[c]]
                end, word = self.end[some], self.word[self.end[some]]
                ends = self.column[end] + 1 == self.lengths[word]
                own = np.where(ends, 0.0, behind[np.where(ends, 0, self.first[np.minimum(self.column[end] + 1, self.width - 1)] + word)])
                after[some] = own
                nxt = np.zeros(int(self.live[c]))
                nxt[: self.live[c + 1]] = behind[self.first[c + 1] : self.first[c + 1] + self.live[c + 1]] if c + 1 < self.width else 0.0
                behind[self.first[c] : self.first[c + 1]] = nxt + np.log(np.add.reduceat(np.exp(own - nxt[word]) * p[self.piece[some]], edges))
            word = self.word[self.start]
            share = np.exp(before + after - total[word]) * p[self.piece] * weights[word]
        return np.bincount(self.piece, share, minlength=len(p))[:-1]


class Model:
    def __init__(self, languages: list[str], pieces: list[bytes], p: np.ndarray):
        """p: pieces x languages, a last row of zeros."""
        self.languages, self.pieces, self.p = languages, pieces, p
        self._finder: Pieces | None = None
        self._forget()

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "p": self.p}

    def __setstate__(self, state):
        self.__init__(state["languages"], state["pieces"], state["p"])

    def _forget(self) -> None:
        self._known, self._logs = np.zeros(0, np.uint64), np.zeros((0, len(self.languages)))

    @property
    def finder(self) -> Pieces:
        if self._finder is None:
            self._finder = Pieces(self.pieces)
        return self._finder

    def log_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(starts), len(self.languages)))
        for own in batches(starts, ends, max(1, _CELLS // max(1, len(self.languages)))):
            out[own] = Lattice(self.finder, data, starts[own], ends[own]).log_totals(self.p)
        return out

    def known_words(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``log_words`` of distinct words, by their sorted hashes; those seen before are remembered."""
        at = np.minimum(np.searchsorted(self._known, hashes), max(len(self._known) - 1, 0))
        seen = self._known[at] == hashes if len(self._known) else np.zeros(len(hashes), bool)
        out = np.empty((len(hashes), len(self.languages)))
        out[seen] = self._logs[at[seen]]
        new = np.flatnonzero(~seen)
        out[new] = self.log_words(data, starts[new], ends[new])
        if (len(self._known) + len(new)) * 8 * (len(self.languages) + 1) > KNOWN_BYTES:
            self._forget()
        if len(new) * 8 * (len(self.languages) + 1) <= KNOWN_BYTES:
            known = np.concatenate([self._known, hashes[new]])
            order = np.argsort(known, kind="stable")
            self._known, self._logs = known[order], np.concatenate([self._logs, out[new]])[order]
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language, -1 for none, and its probability."""
        data, offsets = tx.flat(column)
        data = tx.LOWER[data]
        words = tx.Words(data, offsets, _LETTERS)
        best, score = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
        some = np.flatnonzero(words.counts > 0)
        if not len(self.languages) or not len(some):
            return best, score
        distinct, heads, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        logs = self.known_words(distinct, data, words.starts[heads], words.ends[heads])
        sums = np.add.reduceat(logs[which], words.first[:-1][some], axis=0)
        top = sums.argmax(axis=1)
        best[some], score[some] = top, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i in some:
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            if not _SOME_LETTER.search(raw) and not any(c.isalpha() for c in raw.decode(errors="replace")):
                best[i], score[i] = -1, 0.0
        return best, score


def train(docs: DataFrame, docs_each: int = TRAIN_DOCS, rounds: int = ROUNDS, path: str | None = None) -> Model:
    tx.id_and_text(docs)
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    table = table.where(~tx.held_out(HELD_DIVISOR, HELD_REMAINDER)).where("lang is not null and text is not null")
    counted = table.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct languages to learn")
    pieces = vocabulary(path)
    if not counted:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    share = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, docs_each / r["count"]))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    some = table.where(chance < share[F.col("lang")])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tx.flat(tx.column(batch, "text"))
        words = tx.Words(tx.LOWER[data], offsets, _LETTERS)
        langs = np.array(tx.column(batch, "lang").to_pylist(), dtype=object)
        rows: dict[str, list] = {"lang": [], "word": [], "n": []}
        doc = words.docs()
        for lang in sorted(set(langs)):
            own = np.flatnonzero((langs == lang)[doc])
            _, heads, n = np.unique(words.hashes()[own], return_index=True, return_counts=True)
            rows["lang"] += [lang] * len(n)
            rows["word"] += [words.text(i) for i in own[heads]]
            rows["n"] += n.tolist()
        return tx.to_batch(rows, {"lang": pa.string(), "word": pa.binary(), "n": pa.int64()})

    got = some.select("text", "lang").mapInArrow(tx.per_chunk(cut), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    finder, columns = Pieces(pieces), []
    for lang in languages:
        own = got.filter(pc.equal(got.column("lang"), lang)).sort_by("word")
        data, offsets = tx.flat(own.column("word"))
        weights = own.column("n").to_numpy().astype(np.float64)
        lattices = [(Lattice(finder, data, offsets[:-1][k], offsets[1:][k]), weights[k]) for k in batches(offsets[:-1], offsets[1:])]
        p = np.full((len(pieces) + 1, 1), 1.0 / len(pieces))
        p[-1] = 0
        for _ in range(rounds):
            counts = sum(lattice.expected(p, w) for lattice, w in lattices) + 0.1
            p[:-1, 0] = counts / counts.sum()
        columns.append(p[:, 0])
    return Model(languages, pieces, np.stack(columns, axis=1))


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, score = shared.value.predict(tx.column(batch, "text"))
        names = [*shared.value.languages, UNKNOWN]
        return tx.to_batch({"doc_id": tx.column(batch, "doc_id"), "lang_pred": [names[k] for k in best], "score": score}, {"lang_pred": pa.string(), "score": pa.float64()})

    found = tx.id_and_text(docs).mapInArrow(tx.per_chunk(run), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", tx.held_out(HELD_DIVISOR, HELD_REMAINDER).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without texts in no learned language or of too uncertain a one."""
    tx.id_and_text(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, score = shared.value.predict(tx.column(batch, "text"))
        return batch.filter(pa.array((best >= 0) & (score >= least)))

    return docs.mapInArrow(tx.per_chunk(run), docs.schema)
