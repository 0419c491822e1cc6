"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .shared import remote, staged, text_udf

BITS = 14
TARGET = 8000  # labelled good documents that the target model is fitted on at most


def grams(col: pa.Array):
    """Per group of rows: (hash bucket of each word and word pair, in order of rows; first of each row)."""
    for offsets, raw in bytetext.chunks(col):
        low = bytetext.lower(raw)
        start, end, first = bytetext.words(offsets, low)
        h = bytetext.word_hashes(low, start, end)
        pair = bytetext.mix(h[:-1] * np.uint64(31) + h[1:]) if len(h) else h
        last = np.zeros(len(h), bool)
        last[first[1:][first[1:] > first[:-1]] - 1] = True
        shift = np.uint64(64 - BITS)
        out = np.full(2 * len(h), -1, np.int64)
        out[0::2] = (h >> shift).astype(np.int64)
        out[1:-1:2] = (pair >> shift).astype(np.int64)
        out[1::2][last] = -1
        yield out, 2 * first


def counter():
    def run(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for ids, _ in grams(batch.column(0)):
                total += np.bincount(ids[ids >= 0], minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << BITS, dtype=np.int32)), pa.array(total)], ["bucket", "n"])

    return run


def weigher(table: bytes):
    values = np.append(np.frombuffer(table, np.float64), 0.0)

    def run(col: pa.Array) -> pa.Array:
        sums, counts = [np.zeros(0)], [np.zeros(0)]
        for ids, first in grams(col):
            sums.append(bytetext.row_sums(values[ids], first))
            counts.append(bytetext.row_sums((ids >= 0).astype(np.float64), first))
        s, n = np.concatenate(sums), np.concatenate(counts)
        return pa.StructArray.from_arrays([pa.array(s), pa.array(n.astype(np.int64))], ["log_ratio", "n_grams"])

    return run


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all hashed n-grams of all texts; one row per bucket (a fixed number) reaches the driver."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(remote(__name__, "counter"), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << BITS, np.float64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, target: int = TARGET) -> np.ndarray:
    """Log probability ratio of each bucket: model of good documents (at most ``target`` labelled ones, by a hash of
    their ids) over the model of all documents; counts are smoothed by one."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    picked = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target)
    raw = gram_counts(docs)
    ours = gram_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id", "left_semi"))
    p, q = (ours + 1) / (ours.sum() + len(ours)), (raw + 1) / (raw.sum() + len(raw))
    return np.log(p) - np.log(q)


def gumbel(*cols: str) -> Column:
    """Standard Gumbel noise that depends on the columns' values only, so reruns draw the same sample."""
    u = (F.shiftrightunsigned(F.xxhash64(*cols, F.lit("gumbel")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a double column, exactly: histograms of ever narrower ranges, no sort, no collect of rows."""
    at = df.filter(F.col(key).isNotNull()).agg(F.min(key), F.max(key)).first()
    if k <= 0 or at[0] is None:
        return None
    lo, hi, need = at[0], at[1], k
    while lo < hi:
        width = (hi - lo) / bins
        b = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1)).cast("int")
        rows = df.filter(F.col(key).between(lo, hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.b):
            if need <= r.n:
                lo, hi = r.lo, r.hi
                break
            need -= r.n
        else:
            return lo
    return lo


def good_share(labels: DataFrame) -> float:
    """Share of good documents among the labelled ones; 1 without labels."""
    share = labels.filter(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    return 1.0 if share is None else float(share)


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None) -> DataFrame:
    """doc_id, log_weight, n_grams, gumbel_key, kept: the ``fraction`` of documents with the greatest keys, by default
    as many as the labels say are good.

    log_weight is the log of the importance ratio: the sum over a text's words and word pairs of the log ratio of their
    probabilities under the two models. Key: log_weight plus Gumbel noise, which draws without replacement in
    proportion to the weights. Null, empty and blank texts have log_weight 0. Rows that tie with the last kept key are
    kept too (repeated rows). Texts are read whole, however long; null ids take part. No rows: no rows; extra columns
    aren't read.
    """
    table = fit(docs, labels)
    weigh = text_udf(__name__, "weigher", "struct<log_ratio:double,n_grams:bigint>", table.tobytes())
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), weigh(F.col("text").cast("string")).alias("w"))
    weight = F.col("w.log_ratio")
    keyed = staged(
        scored.select("doc_id", weight.alias("log_weight"), F.col("w.n_grams").alias("n_grams"), (weight + gumbel("doc_id", "h")).alias("gumbel_key")),
        "weights",
    )
    least = kth_largest(keyed, "gumbel_key", round((good_share(labels) if fraction is None else fraction) * keyed.count()))
    kept = F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least)
    return keyed.withColumn("kept", kept)
