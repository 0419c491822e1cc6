"""Contacts and runs of all pairs where points are crowded: pairs of trajectory blocks are swept through time.

Where most trajectories meet, hits are far more than points, so none are sent. Blocks of trajectories (in the order of
their ids) are packed once; a task has two of them, and a run ends or goes on in a matrix of their pairs, snapshot by
snapshot. Only results leave the task. All pairs are compared, in a few machine operations each: places are replaced
by ranks among a block's distinct values, and a contact is a rank between two bounds, which are found by the very
comparison |x - y| <= delta in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import cell

SIZE, PLACES = 4096, 1 << 17  # trajectories and points of a block, about
BLOCKS, LEAST = 16, 64  # blocks of small tables, so that all cores have work; but none of less trajectories
TASKS = 4096  # tasks at most; beyond, a task sweeps several tiles
STATE = 1 << 19  # pairs swept at once
MEETING, SWEPT = 4.5, 300  # pairs that meet in a cell and its forward ones, by its points squared; swept pairs that cost as much as one joined


def crowded(points: DataFrame, delta: float) -> bool:
    """Whether sweeping all pairs costs less than joining those in near cells: counted by cell, before any join."""
    cells = points.groupBy("snap", cell("lon", delta).alias("cx"), cell("lat", delta).alias("cy")).agg(F.count("*").cast("double").alias("n"))
    met = cells.agg(F.sum(F.col("n") * F.col("n")).alias("met"), F.countDistinct("snap").alias("snaps")).first()
    n = points.agg(F.countDistinct("traj_id").alias("n")).first().n
    return n * n / 2 * met.snaps <= SWEPT * MEETING * (met.met or 0)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's places as matrices (layer, snapshot, trajectory), NaN where there is none. A layer holds a point of each
    trajectory and snapshot; repeats are in further layers."""
    ids, traj = np.unique(pdf["traj_id"].to_numpy(np.int64), return_inverse=True)
    snaps, snap = np.unique(pdf["snap"].to_numpy(np.int64), return_inverse=True)
    layer = pdf.groupby(["traj_id", "snap"]).cumcount().to_numpy()
    xy = np.full((2, int(layer.max()) + 1, len(snaps), len(ids)), np.nan)
    for k, c in enumerate(("lon", "lat")):
        xy[k, layer, snap, traj] = pdf[c].to_numpy(np.float64)
    xy[:, ~np.isfinite(xy).all(axis=0)] = np.nan  # neither NaN nor an infinite place is in contact with any
    with np.errstate(over="ignore"):
        short = xy.astype(np.float32)
    exact = np.array_equal(short.astype(np.float64), xy, equal_nan=True)
    head = np.array([len(ids), len(snaps), xy.shape[1], exact], np.int64)
    data = b"".join(x.tobytes() for x in (head, ids, snaps, short if exact else xy))
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "data": [data]})


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, t, layers, exact = np.frombuffer(data, np.int64, 4).tolist()
    ids, snaps = np.frombuffer(data, np.int64, n, 32), np.frombuffer(data, np.int64, t, 32 + 8 * n)
    xy = np.frombuffer(data, np.float32 if exact else np.float64, -1, 32 + 8 * (n + t))
    return ids, snaps, xy.reshape(2, layers, t, n).astype(np.float64)


def _bounds(x: np.ndarray, y: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each x, lowest rank, rank above the highest) so that |x - y| <= delta where the rank lies between; -1 and
    no ranks where a place is missing."""
    there, other = ~np.isnan(x), ~np.isnan(y)
    u = np.unique(x[there])
    rank = np.where(there, np.searchsorted(u, np.where(there, x, 0)), -1)
    v = np.where(other, y, 0)
    low, high = np.searchsorted(u, v - delta, "left"), np.searchsorted(u, v + delta, "right")
    if len(u):
        last = len(u) - 1
        for at, step, ask in (
            # sums are rounded otherwise than differences, so bounds are moved until the comparison itself holds
            (low, -1, lambda p: (p > 0) & (v - u[np.maximum(p - 1, 0)] <= delta)), (low, 1, lambda p: (p <= last) & (v - u[np.minimum(p, last)] > delta)),
            (high, 1, lambda p: (p <= last) & (u[np.minimum(p, last)] - v <= delta)), (high, -1, lambda p: (p > 0) & (u[np.maximum(p - 1, 0)] - v > delta)),
        ):
            while (wrong := ask(at)).any():
                at[wrong] += step
    kind = np.int16 if len(u) < 32000 else np.int32
    return rank.astype(kind), np.where(other, low, 1).astype(kind), np.where(other, high, 0).astype(kind)


class Tile:
    """Two blocks, of which the first's ids are less than the second's, or one with itself."""

    def __init__(self, first: bytes, second: bytes, delta: float, every: int = 1):
        (self.ids, s, x), (self.others, t, y) = _unpack(first), _unpack(second)
        self.same = first == second
        self.snaps, i, j = np.intersect1d(s, t, return_indices=True)
        if every > 1:
            kept = self.snaps % every == 0
            self.snaps, i, j = self.snaps[kept], i[kept], j[kept]
        self.tests = []  # by snapshot: pairs of layers with a contact: (rank, low, high) by axis
        for p, q in zip(i.tolist(), j.tolist()):
            both = [[_bounds(x[k, a, p], y[k, b, q], delta) for k in range(2)] for a in range(x.shape[1]) for b in range(y.shape[1])]
            self.tests.append([axes for axes in both if all((high > low).any() for _, low, high in axes)])

    def rows(self) -> Iterator[slice]:
        step = max(1, STATE // len(self.others))
        return (slice(a, min(a + step, len(self.ids))) for a in range(0, len(self.ids), step))

    def shape(self, part: slice) -> tuple[int, int]:
        return part.stop - part.start, len(self.others)

    def number(self):
        """A type for numbers of snapshots."""
        return np.min_scalar_type(len(self.snaps) + 1)

    def contacts(self, part: slice) -> Iterator[tuple[int, np.ndarray]]:
        """(snapshot, matrix of contacts), the same matrix again and again; snapshots without any aren't told."""
        met, one, held = (np.empty(self.shape(part), bool) for _ in range(3))
        for s, tests in zip(self.snaps.tolist(), self.tests):
            for n, axes in enumerate(tests):
                out = one if n else met
                for k, (rank, low, high) in enumerate(axes):
                    r = rank[part, None]
                    np.greater_equal(r, low, out=held if k else out)
                    if k:
                        out &= held
                    out &= np.less(r, high, out=held)
                if n:
                    met |= one
            if tests:
                yield s, met

    def pairs(self, part: slice, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs a < b in the matrix."""
        i, j = np.nonzero(kept)
        if self.same:
            up = j > i + part.start
            i, j = i[up], j[up]
        return i, j

    def named(self, part: slice, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        return [self.ids[part][i], self.others[j]]


def _longest(tile: Tile, part: slice, step: int = 1) -> np.ndarray:
    """Each pair's longest run of snapshots ``step`` apart."""
    run, best = (np.zeros(tile.shape(part), tile.number()) for _ in range(2))
    before = None
    for s, met in tile.contacts(part):
        if before is not None and s != before + step:
            run[:] = 0
        run += 1
        run *= met
        np.maximum(best, run, out=best)
        before = s
    return best


def longest(tile: Tile, part: slice, k: int):
    best = _longest(tile, part)
    i, j = tile.pairs(part, best >= max(k, 1))
    yield [*tile.named(part, i, j), best[i, j]]


def islands(tile: Tile, part: slice):
    run, before = np.zeros(tile.shape(part), tile.number()), None
    ended = lambda kept: (lambda i, j: [*tile.named(part, i, j), before + 1 - run[i, j].astype(np.int64), run[i, j]])(*tile.pairs(part, kept))
    for s, met in tile.contacts(part):
        if before is not None:
            if s != before + 1:
                yield ended(run > 0)
                run[:] = 0
            else:
                yield ended((run > 0) & ~met)
        run += 1
        run *= met
        before = s
    if before is not None:
        yield ended(run > 0)


def _slices(tile: Tile, part: slice, width: int):
    """(slice, longest run, run from its first snapshot, run to its last) of slices with a contact; runs end at borders."""
    now = before = None
    for s, met in tile.contacts(part):
        if s // width != now:
            if now is not None:
                yield now, most, first, run if before % width == width - 1 else np.zeros_like(run)
            now = s // width
            run, most, first = (np.zeros(tile.shape(part), tile.number()) for _ in range(3))
            whole = np.full(tile.shape(part), s % width == 0)
        elif s != before + 1:
            run[:] = 0
            whole[:] = False
        run += 1
        run *= met
        np.maximum(most, run, out=most)
        whole &= met
        first += whole
        before = s
    if now is not None:
        yield now, most, first, run if before % width == width - 1 else np.zeros_like(run)


def sliced(tile: Tile, part: slice, width: int):
    """Rows of equal runs follow each other, so that files hold them as repeats: there are about as many rows as pairs."""
    few = np.min_scalar_type((width + 1) ** 3)  # small numbers are sorted by their digits
    for at, most, first, last in _slices(tile, part, width):
        i, j = tile.pairs(part, most > 0)
        runs = [x[i, j].astype(few) for x in (most, first, last)]
        order = np.argsort((runs[0] * few.type(width + 1) + runs[1]) * few.type(width + 1) + runs[2], kind="stable")
        i, j = i[order], j[order]
        yield [*tile.named(part, i, j), np.full(len(i), at), *(x[order] for x in runs)]


def stitched(tile: Tile, part: slice, width: int, k: int):
    """Longest runs from slice parts: a run before a slice goes on through whole slices to the next one's first part."""
    best, carried = (np.zeros(tile.shape(part), np.min_scalar_type(len(tile.snaps) + width)) for _ in range(2))
    before = None
    for at, most, first, last in _slices(tile, part, width):
        if before is not None and at != before + 1:
            carried[:] = 0
        carried += first
        np.maximum(best, np.maximum(most, carried), out=best)
        carried = np.where(first == width, carried, last.astype(best.dtype))
        before = at
    i, j = tile.pairs(part, best >= max(k, 1))
    yield [*tile.named(part, i, j), best[i, j]]


def sampled(tile: Tile, part: slice, few: Tile, need: int, k: int):
    """Longest runs of pairs with ``need`` sampled contacts in a row; rows of the tile without any aren't swept."""
    maybe = _longest(few, part, few.every) >= need
    if maybe.any():
        best = _longest(tile, part)
        i, j = tile.pairs(part, maybe & (best >= max(k, 1)))
        yield [*tile.named(part, i, j), best[i, j]]


def windows(tile: Tile, part: slice, step: int, need: int):
    yield tile.named(part, *tile.pairs(part, _longest(tile, part, step) >= need))


def parts(tile: Tile, part: slice, cuts: list[int]):
    """Bit n where a pair meets before cuts[n] and not before the one before; the last bit where it does after all."""
    out = np.zeros(tile.shape(part), np.min_scalar_type(1 << (len(cuts) + 1)))
    for s, met in tile.contacts(part):
        out |= met.astype(out.dtype) << out.dtype.type(np.searchsorted(cuts, s, "right"))
    i, j = tile.pairs(part, out > 0)
    yield [*tile.named(part, i, j), out[i, j]]


def counts(tile: Tile, part: slice, width: int):
    """Contacts by slice and lesser trajectory."""
    n, r = {}, np.arange(part.start, part.stop)[:, None]
    above = np.arange(len(tile.others)) > r if tile.same else None
    for s, met in tile.contacts(part):
        n[s // width] = n.get(s // width, 0) + np.count_nonzero(met & above if tile.same else met, axis=1)
    for at, found in n.items():
        i = np.flatnonzero(found)
        yield [tile.ids[part][i], np.full(len(i), at), found[i]]


SWEEPS = {f.__name__: f for f in (longest, islands, sliced, stitched, sampled, windows, parts, counts)}
SCHEMA = {
    "longest": "a long, b long, best long", "islands": "a long, b long, start int, n long", "sliced": "a long, b long, slice int, max_run long, prefix_run long, suffix_run long",
    "stitched": "a long, b long, best long", "sampled": "a long, b long, best long", "windows": "a long, b long", "parts": "a long, b long, parts int", "counts": "a long, slice int, n long",
}


def _swept(kind: str, delta: float, given: dict) -> Callable:
    names, types = zip(*(c.split() for c in SCHEMA[kind].split(", ")))
    types = [{"long": pa.int64(), "int": pa.int32()}[t] for t in types]
    rows_of, every = SWEEPS[kind], given["step"] if kind == "windows" else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for at, data in enumerate(batch.column("data")):
                i, j = batch.column("i")[at].as_py(), batch.column("j")[at].as_py()
                if i != j and (i, j) not in held:
                    held[i, j] = batch.column("side")[at].as_py(), data.as_py()
                    continue
                side, other = held.pop((i, j), (1, None))
                two = [data.as_py(), other or data.as_py()]
                tile, more = Tile(*(two if side else two[::-1]), delta, every), dict(given)
                if kind == "sampled":
                    few = Tile(*(two if side else two[::-1]), delta, more["step"])
                    few.every = more.pop("step")
                    more["few"] = few
                for part in tile.rows():
                    for columns in rows_of(tile, part, **more):
                        if len(columns[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t.to_pandas_dtype())) for c, t in zip(columns, types)], list(names))

    return run


def sweep(points: DataFrame, delta: float, kind: str, **given) -> DataFrame:
    """Rows of one of the functions above (SCHEMA has their columns) for all pairs of clean points' trajectories."""
    p = points.select("traj_id", "snap", "lon", "lat")
    seen = p.groupBy("traj_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n"), F.sum("n").alias("points")).first()
    size = max(16, min(SIZE, PLACES * seen.n // max(1, seen.points or 0)))
    blocks = max(-(-seen.n // size), min(BLOCKS, -(-seen.n // LEAST)), 1)
    block = F.lit(0)
    if blocks > 1:
        cuts = p.select("traj_id").distinct().agg(F.percentile_approx("traj_id", [k / blocks for k in range(1, blocks)], 10 * SIZE).alias("c")).first().c
        cuts = sorted(set(cuts))
        block, blocks = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("traj_id"))), len(cuts) + 1
    packed = p.withColumn("block", block).groupBy("block").applyInPandas(_pack, "block int, data binary")
    # tile (i, j), i <= j: block i comes as its first side, block j as its second; of one block with itself, once
    tile = F.expr(f"transform(sequence(0, {blocks - 1}), x -> struct(least(x, block) AS i, greatest(x, block) AS j, if(x < block, 1, 0) AS side))")
    tiles = blocks * (blocks + 1) // 2
    dealt = packed.select(F.explode(tile).alias("t"), "data").select("t.*", "data")
    to = (F.col("i") * blocks - F.expr("i * (i - 1) div 2") + F.col("j") - F.col("i")) % min(tiles, TASKS)
    return dealt.repartitionById(min(tiles, TASKS), to.cast("int")).mapInArrow(_swept(kind, delta, given), SCHEMA[kind])
