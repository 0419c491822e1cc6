"""Benchmark decontamination: latent semantic candidates, then longest-common-subsequence and answer checks.

Passages are runs of words; TF-IDF terms are the benchmark's informative words. A distributed randomised SVD of all
corpus passages (with the benchmark's own passages weighted in) gives the latent space. Windows of every document
are compared with the benchmark items there by cosine, and each candidate is checked on its words.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .shared import remote, text_udf

PASSAGE = 32  # words of a passage in the statistics
CELL = 16  # words; search windows are 2 or 4 cells, by the item's length
ITEMS = 224  # items of one latent space; more are dealt over several, all searched in one scan
MAX_SHARE = 0.001  # words of more passages than this carry no topic
RAREST = 8  # but each item keeps this many of its rarest words
SPARE = 48  # latent dimensions of the corpus besides one for each item
COSINE = 0.4  # of a candidate
LCS, ANSWER = 0.65, 0.6  # shares of the item's and of its answer's words in common order
SURE, SURE_WORDS = 0.75, 12  # share of an item of so many words or more that needs no answer besides
SEED = 11
_punctuation = np.arange(256, dtype=np.uint8)
_punctuation[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def passages(col: pa.Array):
    """Per group of rows: (hash of each word, first word of each row); lower case, ASCII marks separate words."""
    for offsets, raw in bytetext.chunks(pc.utf8_lower(col.fill_null("").cast(pa.string()))):
        clean = _punctuation[raw]
        start, end, first = bytetext.words(offsets, clean)
        yield bytetext.word_hashes(clean, start, end), first


class Vocabulary:
    """Numbers of the given word hashes; -1 for others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            good = self.hashes[at] == h[maybe]
            out[maybe[good]] = at[good]
        return out


def cells(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each word, first cell of each row and their number) for cells of ``size`` words that start anew in each row."""
    n = np.diff(first)
    start = np.concatenate([[0], np.cumsum(-(-n // size))])
    return np.repeat(start[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) // size, start


def frequencies(blob: bytes):
    """Batches of texts -> (word, passages that hold it), the last row (-1) the number of passages."""

    def run(batches):
        vocabulary = Vocabulary(np.frombuffer(blob, np.uint64))
        size = len(vocabulary.hashes)
        df, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for h, first in passages(batch.column(0)):
                cell, starts = cells(first, PASSAGE)
                v = vocabulary(h)
                key = np.unique(cell[v >= 0] * size + v[v >= 0])
                df += np.bincount(key % size, minlength=size) if size else 0
                total += int(starts[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(size), -1).astype(np.int32)), pa.array(np.append(df, total))], ["v", "n"])

    return run


def gram_sketch(blob: bytes):
    """Batches of texts -> rows of A'A W for this partition's TF-IDF passages A: (word, vector)."""

    def run(batches):
        hashes, idf, test = pickle.loads(blob)
        vocabulary, out = Vocabulary(hashes), np.zeros(test.shape, np.float32)
        for batch in batches:
            for h, first in passages(batch.column(0)):
                cell, _ = cells(first, PASSAGE)
                v = vocabulary(h)
                at = np.flatnonzero(v >= 0)
                if not len(at):
                    continue
                v, cell = v[at], cell[at]
                begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                image = np.add.reduceat((test * idf[:, None])[v], begin, axis=0)
                row = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(v)]))
                order = np.argsort(v, kind="stable")
                heads = np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1]])
                out[v[order][heads]] += np.add.reduceat(image[row[order]], heads, axis=0)
        used = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array((out * idf[:, None])[used].ravel()), out.shape[1]).cast(pa.list_(pa.float32()))], ["v", "x"]
        )

    return run


def add_up():
    """Rows (word, vector) -> one row per word of this partition."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(1)
            for v, x in zip(batch.column(0).to_pylist(), vectors):
                x = x.values.to_numpy()
                total[v] = total[v] + x if v in total else x.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32) for x in total.values()], pa.list_(pa.float32()))], ["v", "x"]
            )

    return run


def gram_factor(sketch: np.ndarray, test: np.ndarray, k: int) -> np.ndarray:
    """H with H H' ~ G = A'A, from Y = G W (Nystrom: G ~ Y (W'Y)^-1 Y'), at most ``k`` columns."""
    core = test.T.astype(np.float64) @ sketch
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(initial=0), 0) * 1e-9
    half = sketch @ (vector[:, good] / np.sqrt(value[good]))
    if not half.size:
        return np.zeros((len(sketch), 0))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return (u * s)[:, :k]


def latent_space(corpus: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Right singular vectors of the corpus passages stacked with the items' passages, both with the same energy."""
    energy = max(float(np.sum(corpus * corpus)), 1e-12)
    u, s, _ = np.linalg.svd(np.concatenate([corpus * np.sqrt(len(own) / energy), own.T], axis=1), full_matrices=False)
    return u[:, s > s[0] * 1e-7] if len(s) else u


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]  # hashes


def items_of(benchmark: DataFrame) -> list[Items]:
    """The benchmark's items with words, in groups of ITEMS. The benchmark is the query set: it is collected."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t").collect()
    ids, found = [], []
    for group, at in _hashed([r.t for r in rows]):
        for k, words in enumerate(group):
            if len(words):
                ids.append(rows[at + k].i)
                found.append(words)
    return [Items(ids[k : k + ITEMS], found[k : k + ITEMS]) for k in range(0, len(ids), ITEMS)]


def _hashed(texts: list[str]):
    at = 0
    for h, first in passages(pa.array(texts, pa.string())):
        yield [h[a:b] for a, b in zip(first[:-1], first[1:])], at
        at += len(first) - 1


def fit(docs: DataFrame, groups: list[Items]) -> list[bytes]:
    """Latent spaces and item vectors of each group, from all passages of all documents.

    Two scans whatever the number of items: one counts the passages of all items' words, one sketches the corpus."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    every = np.unique(np.concatenate([w for g in groups for w in g.words]))
    counts = text.mapInArrow(remote(__name__, "frequencies", every.tobytes()), "v int, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(len(every), np.int64), 0
    for r in counts:
        if r.v < 0:
            total = r.n
        else:
            df[r.v] = r.n
    keep = df <= MAX_SHARE * total
    vocabulary = Vocabulary(every)
    for g in groups:
        for w in g.words:
            v = np.unique(vocabulary(w))
            keep[v[np.argsort(df[v], kind="stable")[:RAREST]]] = True
    hashes, idf = every[keep], np.log((total + 1) / (df[keep] + 0.5)).astype(np.float32)
    test = np.random.default_rng(SEED).standard_normal((len(hashes), min(len(hashes), SPARE + 8))).astype(np.float32)
    sketch = np.zeros(test.shape)
    rows = text.mapInArrow(remote(__name__, "gram_sketch", pickle.dumps((hashes, idf, test))), "v int, x array<float>")
    for r in rows.repartition("v").mapInArrow(remote(__name__, "add_up"), "v int, x array<float>").toLocalIterator():
        sketch[r.v] = r.x
    corpus, vocabulary = gram_factor(sketch, test, SPARE), Vocabulary(hashes)
    return [space_of(g, hashes, idf, corpus, vocabulary) for g in groups]


def space_of(group: Items, hashes: np.ndarray, idf: np.ndarray, corpus: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """A group's latent space over its own words, its items' vectors there, and what a search needs of them."""
    terms = [vocabulary(w) for w in group.words]
    terms = [v[v >= 0] for v in terms]
    used = np.unique(np.concatenate(terms))
    own = np.zeros((len(terms), len(used)), np.float64)
    for k, v in enumerate(terms):
        np.add.at(own[k], np.searchsorted(used, v), idf[v])
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    space = latent_space(corpus[used], own).astype(np.float32)
    return pickle.dumps({"hashes": hashes[used], "project": space * idf[used, None], "items": (own @ space).astype(np.float32), "ids": group.ids, "words": group.words})


def common(mask: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    s = full = (1 << n) - 1
    for w in words:
        m = mask.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def bits(words: list[int]) -> dict[int, int]:
    mask: dict[int, int] = {}
    for k, w in enumerate(words):
        mask[w] = mask.get(w, 0) | 1 << k
    return mask


class Search:
    def __init__(self, blob: bytes) -> None:
        d = pickle.loads(blob)
        self.vocabulary, self.project, self.ids = Vocabulary(d["hashes"]), d["project"], d["ids"]
        norm = np.maximum(np.linalg.norm(d["items"], axis=1, keepdims=True), 1e-12)
        self.items, self.words = d["items"] / norm, [w.tolist() for w in d["words"]]
        self.mask = [bits(w) for w in self.words]
        self.answer = [w[-max(3, -(-len(w) // 4)) :] for w in self.words]
        self.answer_mask = [bits(w) for w in self.answer]
        # the greatest cosine of a window that holds one informative word, by that word
        alone = self.project / np.maximum(np.linalg.norm(self.project, axis=1, keepdims=True), 1e-12)
        self.alone = (alone @ self.items.T).max(axis=1, initial=-1.0)
        n = np.array([len(w) for w in self.words])
        self.by_span = [(2, np.flatnonzero(n <= 28)), (4, np.flatnonzero(n > 28))]

    def check(self, item: int, words: list[int]) -> float:
        """Greatest share of the item's words that a stretch of half more than its length has in order; 0 unless
        that is enough and the stretch has the item's answer (its last quarter) too, or so much of a long item that it
        can't be chance."""
        n = len(self.words[item])
        need, sure = n if n < 6 else LCS * n, SURE * n if n >= SURE_WORDS else n
        if common(self.mask[item], n, words) < need:
            return 0.0
        span, best = n + (n + 1) // 2, 0.0
        for a in range(0, max(1, len(words) - span + max(1, n // 4)), max(1, n // 4)):
            part = words[a : a + span]
            got = common(self.mask[item], n, part)
            if got >= sure or (got >= need and common(self.answer_mask[item], len(self.answer[item]), part) >= ANSWER * len(self.answer[item])):
                best = max(best, got / n)
        return best

    def found(self, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], float]:
        """(row, item): share, of rows given by their words' hashes."""
        cell, starts = cells(first, CELL)
        v = self.vocabulary(h)
        at = np.flatnonzero(v >= 0)
        found: dict[tuple[int, int], float] = {}
        if not len(at):
            return found
        held = np.zeros(int(starts[-1]) + 4, np.int64)
        held[: int(starts[-1])] = np.bincount(cell[at], minlength=int(starts[-1]))
        solo = np.zeros(len(held))
        solo[: int(starts[-1])] = np.bincount(cell[at], weights=self.alone[v[at]], minlength=int(starts[-1]))
        begin = np.flatnonzero(np.r_[True, cell[at][1:] != cell[at][:-1]])
        sums = np.zeros((len(held), self.project.shape[1]), np.float32)
        sums[cell[at][begin]] = np.add.reduceat(self.project[v[at]], begin, axis=0)
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(starts))
        last = np.append(starts[1:], 0)[row_of]
        for span, which in self.by_span:
            if not len(which):
                continue
            pos = np.arange(int(starts[-1]))
            if span == 4:
                pos = pos[(pos - starts[row_of]) % 2 == 0]
            inside = [(pos + k) < last[pos] for k in range(span)]
            number = sum(held[pos + k] * inside[k] for k in range(span))
            some = (number > 1) | ((number == 1) & (sum(solo[pos + k] * inside[k] for k in range(span)) >= COSINE - 1e-3))
            pos, inside = pos[some], [i[some] for i in inside]
            for a in range(0, len(pos), 8192):
                p = pos[a : a + 8192]
                z = sum(sums[p + k] * inside[k][a : a + 8192, None] for k in range(span))
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                for q, j in zip(*np.nonzero(z @ self.items[which].T >= COSINE)):
                    row, item = int(row_of[p[q]]), int(which[j])
                    if found.get((row, item), 0.0) < 1.0:
                        n = len(self.words[item])
                        lo = first[row] + (p[q] - starts[row]) * CELL
                        words = h[max(first[row], lo - n) : min(first[row + 1], lo + span * CELL + n)].tolist()
                        share = self.check(item, words)
                        if share:
                            found[row, item] = max(share, found.get((row, item), 0.0))
        return found


def searcher(*blobs: bytes):
    """Texts -> (item_id, share) of the items of all groups; each text's words are hashed once."""
    groups = [Search(b) for b in blobs]

    def run(col: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for h, first in passages(col):
            rows: list[list[tuple[int, float]]] = [[] for _ in range(len(first) - 1)]
            for g in groups:
                for (row, item), share in g.found(h, first).items():
                    rows[row].append((g.ids[item], share))
            out += [[{"item_id": i, "share": s} for i, s in sorted(r)] for r in rows]
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())])))

    return run


def match_column(docs: DataFrame, benchmark: DataFrame, text: Column) -> Column:
    """Array of (item_id, share) of the benchmark items that a text holds."""
    kind = "array<struct<item_id:bigint,share:double>>"
    groups = items_of(benchmark)
    if not groups:
        return F.array().cast(kind)
    return text_udf(__name__, "searcher", kind, *fit(docs, groups))(text.cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending), share (the greatest) of every document.

    Null and empty texts hold nothing; null items are ignored; repeated rows and rows with null ids are judged each; an
    empty benchmark leaves all clean, no rows give none. Texts are searched whole, in overlapping windows of 32 words
    for items of up to 28 words and of 64 for longer ones; a candidate is checked on its window and an item's length to
    either side. Other columns aren't read."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), match_column(docs, benchmark, F.col("text")).alias("m"))
    return found.select(
        "doc_id",
        (F.size("m") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("m.item_id"))).alias("item_ids"),
        F.coalesce(F.array_max(F.col("m.share")), F.lit(0.0)).alias("share"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns as they were."""
    name = "_benchmark_items"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, match_column(docs, benchmark, F.col("text"))).filter(F.size(name) == 0).drop(name)
