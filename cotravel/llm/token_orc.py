"""Token ids as ORC: run-length encoded id lists, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode
from .shared import new_path, remote

END_ID = 0  # appended to each document
PIECES = 1_000_000  # that a worker remembers (some 200 MB)


def encode_batches(path: str, end_id: int, pieces: int | None = None):
    """Batches (doc_id, text) of one sorted partition -> rows of the file format."""

    def run(batches):
        from pyspark import TaskContext

        enc, part, row, begin = encode.encoder(path, limit=pieces), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in encode.groups(texts):
                ids, size = enc.encode([t or "" for t in texts[i:j]])
                size = size + 1
                ends = np.cumsum(size)
                flat = np.full(int(size.sum()), end_id, np.int32)
                keep = np.ones(len(flat), bool)
                keep[ends - 1] = False
                flat[keep] = ids
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_col.slice(i, j - i).cast(pa.int64()),
                        pa.array(np.full(j - i, part, np.int32)),
                        pa.array(np.arange(row, row + j - i)),
                        pa.array(begin + ends - size),
                        pa.array(size),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)),
                    ],
                    ["doc_id", "part", "row", "start_in_part", "n_tokens", "ids"],
                )
                row += j - i
                begin += int(size.sum())

    return run


def checksum():
    """The files are written, so what their encoding has remembered goes: else idle workers keep it into later stages."""
    encode.release()

    def run(col: pa.Array) -> pa.Array:
        flat = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), dtype="<u4")
        ends = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))])
        view = memoryview(flat).cast("B")
        return pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, pieces: int = PIECES) -> None:
    """Encode documents (doc_id, text) and write them in ascending doc_id order as ORC.

    One range partition of doc_ids per file: columns doc_id, part, row (its place in the part), start_in_part
    (ids of the part before it), n_tokens, ids. Null ids come first, null texts hold only the end id, rows with
    equal doc_ids stand in the order of their text's hash. Other columns of ``docs`` are not read.
    The texts are dealt and sorted, not the ids, so nothing larger than the input is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    run = remote(__name__, "encode_batches", tokenizer, end_id, pieces)
    coded = ranged.mapInArrow(run, "doc_id long, part int, row long, start_in_part long, n_tokens long, ids array<int>")
    (
        coded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20))
        .option("orc.compression.zstd.level", "1")  # the ids are packed already
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the format: doc_id, part, row, start_in_part, n_tokens, ids; stripes are read in parallel,
    a filter on doc_id is checked against stripe and row-group statistics and Bloom filters."""
    return spark.read.schema("doc_id long, part int, row long, start_in_part long, n_tokens long, ids array<int>").orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Part totals come from the metadata columns alone; there are as many as files, so they are broadcast."""
    table = read(spark, path)
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    from pyspark.sql import Window

    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    from .shared import text_udf

    crc = text_udf(__name__, "checksum", "long")
    return (
        table.select("doc_id", "part", "start_in_part", F.size("ids").cast("long").alias("n_tokens"), crc("ids").alias("ids_crc32"))
        .join(F.broadcast(before), "part")
        .select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, pieces: int = PIECES) -> DataFrame:
    """Write ``docs`` in the format (to ``path`` or a new folder of the shared storage) and return its digests.

    An empty table gives an empty result. Very long texts are encoded whole."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write(docs, path, tokenizer, end_id, pieces)
    return digests(spark, path)
