"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .shared import remote, text_udf

BITS, DIM, WINDOW = 17, 16, 4  # hash bits of n-grams, width of embeddings, words of a bag
SAMPLE = 4000  # labelled documents fitted on at most, a quarter of them toxic
MIN_DF = 8  # n-grams of fewer fitted documents aren't learned: they'd memorise documents
EPOCHS, RATE, SEED = 30, 0.05, 7


def bags(col: pa.Array):
    """Per group of rows: (n-gram bucket or -1 at each byte, for 3, 4, 5 bytes; first byte of each word; first word of each row).

    N-grams are of the lower-cased bytes of a word with a space on either side of it, whatever white space that is."""
    col = pc.binary_join_element_wise(" ", pc.utf8_lower(col.fill_null("").cast(pa.string())), " ", "")
    for offsets, raw in bytetext.chunks(col):
        gap = bytetext.spaces(raw)
        raw = np.where(gap, np.uint8(32), raw)
        start, _, first = bytetext.words(offsets, raw)
        wide = raw.astype(np.uint32)
        n = len(raw)
        out = np.full((3, n), -1, np.int32)
        h = wide[:-1] * np.uint32(0x01000193) + wide[1:]
        inner = np.ones(n, bool)
        for k in (3, 4, 5):
            m = n - k + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + wide[k - 1 :]
            inner = inner[:m] & ~gap[k - 2 : n - 1]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out[k - 3, :m] = np.where(inner, (mixed >> np.uint32(32 - BITS)).astype(np.int32), -1)
        yield out, start - 1, first


def window_means(ids: np.ndarray, begin: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean table value of the bag that starts at each word, the word after the bag)."""
    padded = np.append(table, np.float32(0))
    value = padded[ids[0]] + padded[ids[1]] + padded[ids[2]]
    count = (ids >= 0).sum(axis=0, dtype=np.int32)
    if len(begin) == 0:
        return np.zeros(0), np.zeros(0, np.int64)
    total = np.concatenate([[0.0], np.cumsum(np.add.reduceat(value, begin).astype(np.float64))])
    number = np.concatenate([[0], np.cumsum(np.add.reduceat(count, begin))])
    row_end = np.repeat(first[1:], np.diff(first))
    stop = np.minimum(np.arange(len(begin)) + WINDOW, row_end)
    at = np.arange(len(begin))
    return (total[stop] - total[at]) / np.maximum(number[stop] - number[at], 1), stop


@dataclass
class Model:
    """table: each n-gram's share of the logit, that is embedding times the difference of the softmax weights."""

    table: np.ndarray
    bias: float

    def scores(self, col: pa.Array) -> np.ndarray:
        """Per text: the greatest toxic probability of any bag of WINDOW words in a row; the bias alone without words."""
        out = []
        for ids, begin, first in bags(col):
            mean, _ = window_means(ids, begin, first, self.table)
            best = np.zeros(len(first) - 1)
            full = first[1:] > first[:-1]
            if full.any():
                best[full] = np.maximum.reduceat(mean, first[:-1][full])
            best[~full] = -20.0
            out.append(1 / (1 + np.exp(-np.clip(best + self.bias, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


class Texts:
    """Training texts as numbers of distinct words, and each distinct word's n-grams: words repeat, so that this stays
    small where the n-grams of all words would not. Texts are added group by group."""

    def __init__(self) -> None:
        self.words: list[np.ndarray] = []  # of each text
        self.grams: list[np.ndarray] = []  # of each distinct word
        self.size: list[int] = []
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes; numbers

    def add(self, texts: list[str]) -> None:
        col = pa.array(texts, pa.string())
        for ids, begin, first in bags(col):
            byte = np.append(begin, ids.shape[1])
            h = self._hashes(ids, byte)
            order = np.argsort(h, kind="stable")
            head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]][: len(h)])
            own, count = h[order[head]], np.diff(np.r_[head, len(h)])
            at = np.searchsorted(self.known, own)
            old = self.known[np.minimum(at, len(self.known) - 1)] == own if len(self.known) else np.zeros(len(own), bool)
            number = np.zeros(len(own), np.int64)
            number[old] = self.number[at[old]]
            number[~old] = len(self.number) + np.arange(int((~old).sum()))
            for k in order[head[~old]].tolist():
                x = ids[:, byte[k] : byte[k + 1]].ravel()
                self.grams.append(x[x >= 0])
                self.size.append(len(self.grams[-1]))
            known, numbers = np.r_[self.known, own[~old]], np.r_[self.number, number[~old]]
            again = np.argsort(known)
            self.known, self.number = known[again], numbers[again]
            w = np.zeros(len(h), np.int32)
            w[order] = np.repeat(number, count)
            self.words += [w[a:b].copy() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    @staticmethod
    def _hashes(ids: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Of each word's n-grams in order; words with equal n-grams are alike to the model."""
        if len(byte) < 2:
            return np.zeros(0, np.uint64)
        ids = ids[:, byte[0] :]
        place = np.arange(ids.shape[1]) - np.repeat(byte[:-1] - byte[0], np.diff(byte))
        mixed = np.zeros(ids.shape[1], np.uint64)
        for k in range(3):
            term = bytetext.mix((ids[k] + 2).astype(np.uint64) * bytetext.BASE + (place * 3 + k).astype(np.uint64))
            mixed += np.where(ids[k] >= 0, term, np.uint64(0))
        return np.add.reduceat(mixed, byte[:-1] - byte[0])


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Fit embeddings and softmax weights by Adagrad on one bag per document and epoch: the one that scores highest
    now (a document is toxic if any of its bags is). The first choice of bags is by smoothed log odds of n-grams."""
    size, rng = 1 << BITS, np.random.default_rng(SEED)
    labels = np.asarray(labels, np.int64)
    if len(texts) == 0 or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), -20.0 if len(texts) == 0 or labels.max() == 0 else 20.0)
    seen = Texts()
    for k in range(0, len(texts), 256):
        seen.add(texts[k : k + 256])
    grams, sizes = np.concatenate([np.zeros(0, np.int32), *seen.grams]), np.array(seen.size, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])

    def of(words: np.ndarray) -> np.ndarray:
        n = sizes[words]
        return grams[np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    df = np.zeros((2, size), np.int64)
    for words, y in zip(seen.words, labels):
        holds = np.zeros(size, bool)
        holds[of(words)] = True
        df[y] += holds
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    learned = df.sum(axis=0) >= min(MIN_DF, max(2, n1 // 4))
    odds = np.log((df[1] + 1) / (n1 + 2)) - np.log((df[0] + 1) / (n0 + 2))
    table = np.where(learned, odds, 0).astype(np.float32)
    emb = (rng.random((size, DIM)) - 0.5).astype(np.float32) / DIM
    emb[~learned] = 0
    w, b = (rng.random((DIM, 2)).astype(np.float32) - 0.5), np.zeros(2, np.float32)
    ge, gw, gb = np.full(size, 1e-6, np.float32), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    full = [i for i, words in enumerate(seen.words) if len(words)]
    flat = np.concatenate([np.zeros(0, np.int32), *seen.words])
    first = np.concatenate([[0], np.cumsum([len(x) for x in seen.words])])
    stop = np.minimum(np.arange(len(flat)) + WINDOW, np.repeat(first[1:], np.diff(first)))
    number = np.concatenate([[0], np.cumsum(sizes[flat])])
    for _ in range(epochs):
        chosen: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        value = np.concatenate([[0.0], np.cumsum(table[grams].astype(np.float64))])
        total = np.concatenate([[0.0], np.cumsum((value[begin[1:]] - value[begin[:-1]])[flat])])
        mean = (total[stop] - total[:-1]) / np.maximum(number[stop] - number[:-1], 1)
        for i in full:
            k = first[i] + int(np.argmax(mean[first[i] : first[i + 1]]))
            chosen[i] = of(flat[k : stop[k]])
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 64)):
            part = np.array([i for i in part if len(chosen[i])], np.int64)
            if len(part) == 0:
                continue
            lengths = np.array([len(chosen[i]) for i in part])
            ids, row = np.concatenate([chosen[i] for i in part]), np.repeat(np.arange(len(part)), lengths)
            bag = np.add.reduceat(emb[ids], np.cumsum(lengths) - lengths) / lengths[:, None]
            logit = bag @ w + b
            prob = np.exp(logit - logit.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            err = prob
            err[np.arange(len(part)), labels[part]] -= 1
            dw, db, dbag = bag.T @ err, err.sum(axis=0), (err @ w.T) / lengths[:, None]
            grad = dbag[row] * learned[ids, None]
            uniq, inv = np.unique(ids, return_inverse=True)
            g = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(g, inv, grad.astype(np.float32))
            ge[uniq] += (g * g).mean(axis=1)
            emb[uniq] -= RATE * g / np.sqrt(ge[uniq])[:, None]
            gw += dw * dw
            w -= RATE * dw / np.sqrt(gw)
            gb += db * db
            b -= RATE * db / np.sqrt(gb)
        table = (emb @ (w[:, 1] - w[:, 0])).astype(np.float32)
    return Model(table, float(b[1] - b[0]))


def trainer():
    """All batches (doc_id, text, label) of one task -> one row, the model."""

    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        seen = {text: label for _, text, label in sorted(rows)}
        del rows
        model = train(list(seen), np.array(list(seen.values()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias])], ["table", "bias"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Rows kept from learning: crc32 of the id's text is a multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on ``sample`` labelled documents at most: a quarter toxic, in the order of a hash of their ids.

    Rows whose crc32(doc_id as text) mod 5 is 0, unlabelled rows and repeated texts are not used; of a text with two
    labels the greatest id's counts. The sample is bounded, so one task trains on it and returns the model, and the
    labels of the sampled ids are broadcast for the join.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("label = 1").orderBy(*order).limit(sample // 4).unionByName(
        known.filter("label = 0").orderBy(*order).limit(sample - sample // 4)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")
    )
    found = rows.repartition(1).mapInArrow(remote(__name__, "trainer"), "table binary, bias double").collect()
    if not found:  # no partition, no task
        return train([], np.zeros(0))
    return Model(np.frombuffer(bytes(found[0].table), np.float32), found[0].bias)


def scorer(table: bytes, bias: float):
    model = Model(np.frombuffer(table, np.float32), bias)

    def run(col: pa.Array) -> pa.Array:
        return pa.array(model.scores(col), pa.float64())

    return run


def score_column(model: Model, text):
    """Column: probability that a text is toxic."""
    return text_udf(__name__, "scorer", "double", model.table.tobytes(), model.bias)(text.cast("string"))


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; null and empty texts get the score of no evidence.

    Texts are read whole, however long, in bounded groups. Null ids count as held out nowhere (null); repeated rows are
    scored each; no rows: no rows; other columns aren't read, so their names can't clash."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; columns and the other rows (with null, empty
    or repeated texts or null ids too) as they were, whatever the columns' names."""
    name = "_toxicity_score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, score_column(model, F.col("text"))).filter(F.col(name) < threshold).drop(name)
