"""SimHash near-duplicates: exact tiled comparison of all fingerprints with numpy XOR and bit counts."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import forest
from .shared import connected_components, drop_staged, in_batches, remote, staged, text_udf

RADIUS = 3  # differing bits of a link
SHINGLE = 3  # words
TILE = 4096  # expected fingerprints of a tile, about
FINE = 4_000_000  # fingerprints from which on cells tell four words apart instead of two; the links are the same
SEED = 42
SLICE, PAIRS = 256, 256  # texts and pairs of tiles that a Python worker holds at once
EDGES = 1 << 16  # from so many on, edges that a task has found are thinned out to a forest


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64; zero without words."""
    import xxhash

    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    text = b" ".join(words)
    if len(words) <= shingle:
        hashes = [digest(text, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        begins = (ends - sizes)[: len(words) - shingle + 1].tolist()
        hashes = [digest(text[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(shingle: int):
    def run(col: pa.Array) -> pa.Array:
        # bytes.lower and bytes.split know A-Z and the six white-space bytes only, as the definition does
        texts = (t for k in range(0, len(col), SLICE) for t in col.slice(k, SLICE).cast(pa.binary()).to_pylist())
        found = [fingerprint(t.lower().split(), shingle) if t else 0 for t in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return run


def compare(radius: int):
    """Batches of tile pairs (a, b, same) -> spanning edges of the links between them, a forest a task."""

    def run(batches):
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a, b, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for k in range(batch.num_rows):
                x = a[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = b[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                step = max(1, (1 << 18) // max(1, len(y)))  # 2 MB of differences at once
                for i in range(0, len(x), step):
                    near = np.bitwise_count(x[i : i + step, None] ^ y[None, :]) <= radius
                    if same[k]:
                        near &= np.arange(i, i + len(near))[:, None] < np.arange(len(y))[None, :]
                    p, q = np.nonzero(near)
                    if len(p):
                        u, v = forest(x[i + p].view(np.int64), y[q].view(np.int64))
                        us.append(u)
                        vs.append(v)
                if sum(map(len, us)) > 2 * len(us[0]) + EDGES:
                    us, vs = ([x] for x in forest(np.concatenate(us), np.concatenate(vs)))
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return run


def neighbour_steps(radius: int, words: int) -> list[tuple[int, ...]]:
    """Half of the steps between tiles whose words' population counts differ by ``radius`` in all at most."""
    span = range(-radius, radius + 1)
    return [s for s in product(span, repeat=words) if sum(map(abs, s)) <= radius and s >= (0,) * words]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, words: int | None = None) -> DataFrame:
    """Spanning edges (a, b) of the graph that links fingerprints (column fp, distinct) at ``radius`` bits or fewer.

    Fingerprints with equal population counts in each of their ``words`` (two of 32 bits or, where there are many
    fingerprints, four of 16) share a cell, a cell is dealt over tiles of bounded size. Two fingerprints within the
    radius have population counts that differ by no more in sum, so all other tile pairs are skipped; the pairs left are
    compared exactly, bit for bit. There are 17^4 cells at most, so their counts may be broadcast. A tile pair returns
    a spanning forest of its links. Fewer words mean fewer and fuller tiles, each sent to 13 others instead of 65.
    """
    words = words or (2 if nodes.count() < FINE else 4)
    size = 64 // words
    part = [F.bit_count(F.shiftrightunsigned("fp", 64 - size * (k + 1)).bitwiseAND(F.lit((1 << size) - 1))).cast("int") for k in range(words)]

    def code(p):
        out = F.lit(0)
        for x in p:
            out = out * (size + 1) + x
        return out

    celled = nodes.select("fp", code(part).alias("cell"))
    cells = staged(celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("n")), "cells")
    tiles = staged(
        celled.join(F.broadcast(cells), "cell")
        .groupBy("cell", F.expr("pmod(xxhash64(fp), n)").cast("int").alias("sub")).agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(s)]) for s in neighbour_steps(radius, words)])
    p = [F.expr(f"(cell div {(size + 1) ** (words - 1 - k)}) % {size + 1}").cast("int") for k in range(words)]
    q = [p[k] + F.col(f"s.d{k}") for k in range(words)]
    ok = F.lit(True)
    for x in q:
        ok = ok & x.between(0, size)
    left = (
        tiles.withColumn("s", F.explode(steps)).filter(ok)
        .select("cell", "sub", "fps", code(q).alias("to"))
        .join(F.broadcast(cells.select(F.col("cell").alias("to"), "n")), "to")
        .withColumn("to_sub", F.explode(F.sequence(F.when(F.col("to") == F.col("cell"), F.col("sub")).otherwise(0), F.col("n") - 1)))
    )
    right = tiles.select(F.col("cell").alias("to"), F.col("sub").alias("to_sub"), F.col("fps").alias("other"))
    pairs = left.join(right, ["to", "to_sub"]).select(
        "fps", "other", ((F.col("cell") == F.col("to")) & (F.col("sub") == F.col("to_sub"))).alias("same")
    )
    with in_batches(nodes.sparkSession, PAIRS):
        out = staged(pairs.mapInArrow(remote(__name__, "compare", radius), "a long, b long"), "links")
    drop_staged(cells, tiles)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are one node, so
    groups of copies cost nothing. Rows with a null doc_id take part and get their component's id, which is null
    only where no member has an id. Repeated rows are returned as often as they come, and rows that share a doc_id
    each get their own text's. A bit set in just half the shingles is 0. Texts are read whole; a very long one is
    counted in bounded pieces. No rows: no rows. Other columns aren't read.
    """
    prints = text_udf(__name__, "fingerprints", "long", shingle)
    fps = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), prints(F.col("text").cast("string")).alias("fp")), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = links(nodes, radius, tile)
    roots = connected_components(found).withColumnRenamed("node", "fp")
    linked = staged(nodes.join(roots, "fp").select("fp", "root", "rep"), "linked")
    labels = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = staged(
        nodes.join(linked.select("fp", "root"), "fp", "left").join(labels, "root", "left")
        .select("fp", F.coalesce("component_id", "rep").alias("component_id")),
        "components",
    )
    drop_staged(found, nodes, linked)
    return fps.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
