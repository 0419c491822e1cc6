"""Incremental runs on a stream of contacts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_contact
from ..functions.grid import cell
from ..operators import tiles


def stream_contacts(points: DataFrame, delta: float, time_col: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Stream-stream self-join on (snapshot, cell): contacts (a, b, snap, ts) of a point stream with event times.

    Both sides carry the watermark and meet at equal event times, so their state is bounded by ``delay``."""
    keyed = points.withWatermark(time_col, delay).select("traj_id", "snap", "lon", "lat", F.col(time_col).alias("ts"), cell("lon", delta).alias("cx"), cell("lat", delta).alias("cy"))
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    r = keyed.withColumn("s", F.explode(steps)).select(
        F.col("traj_id").alias("r_id"), F.col("snap").alias("r_snap"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), F.col("ts").alias("r_ts"),
        (F.col("cx") + F.col("s.x")).alias("r_cx"), (F.col("cy") + F.col("s.y")).alias("r_cy"),
    )
    on = (F.col("snap") == F.col("r_snap")) & (F.col("cx") == F.col("r_cx")) & (F.col("cy") == F.col("r_cy")) & (F.col("ts") == F.col("r_ts"))
    met = keyed.join(r, on & (F.col("traj_id") < F.col("r_id")) & in_contact("lon", "lat", "r_lon", "r_lat", delta))
    return met.select(F.col("traj_id").alias("a"), F.col("r_id").alias("b"), "snap", "ts")


BUCKETS = 512  # groups of pairs that share a state; the state of a group is read and written whole
HELD = np.dtype([("a", "i8"), ("b", "i8"), ("last", "i8"), ("run", "i8"), ("until", "i8")])


def advanced(held: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(state of the pairs of ``held`` and ``rows``, those of rows where a run reaches k). Both are HELD; of rows, last is
    a contact's snapshot and until its pair's expiry. Late contacts and repeats go."""
    rows = rows[np.lexsort((rows["last"], rows["b"], rows["a"]))]
    both = np.concatenate([held, rows])
    new = np.arange(len(both)) >= len(held)
    order = np.lexsort((both["last"], new, both["b"], both["a"]))  # a pair's state, then its contacts in time
    both, new = both[order], new[order]
    first = np.r_[True, (both["a"][1:] != both["a"][:-1]) | (both["b"][1:] != both["b"][:-1])][: len(both)]
    pair = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    # what its state has seen of a pair, and all that isn't later, has been counted
    seen = np.where(new[begin], np.iinfo(np.int64).min, both["last"][begin])[pair]
    same = np.r_[False, ~first[1:] & new[:-1] & (both["last"][1:] == both["last"][:-1])][: len(both)]
    kept = ~new | ((both["last"] > seen) & ~same)
    until = np.maximum.reduceat(both["until"], begin) if len(both) else both["until"]
    both, new, pair = both[kept], new[kept], pair[kept]
    first = np.r_[True, pair[1:] != pair[:-1]][: len(both)]
    broken = first | np.r_[True, both["last"][1:] != both["last"][:-1] + 1][: len(both)]
    begin = np.flatnonzero(broken)
    group = np.cumsum(broken) - 1
    start = np.where(new[begin], 1, both["run"][begin])
    both["run"] = start[group] + np.arange(len(both)) - begin[group]
    end = np.r_[first[1:], True][: len(both)]
    state = both[end]
    state["until"] = until[pair[end]]
    return state, both[new & (both["run"] == k)]


def stream_runs(contacts: DataFrame, k: int, time_col: str | None = None, delay: str = "10 minutes", buckets: int = BUCKETS, delta: float | None = None) -> DataFrame:
    """(a, b, snap): emitted once per run, when a pair's contacts reach k snapshots in a row. Contacts of a pair come in
    the order of their snapshots across batches; inside a batch they are sorted and repeats go.

    A contact at or before the last one seen of its pair is late: it is left out, as its run has been counted. With an
    event time column, contacts behind the watermark (the latest time less ``delay``) are left out too, which Spark
    counts as rows dropped by the watermark, and the state of a pair expires when the watermark passes its last
    contact, so that state is bounded by the pairs of the last ``delay``; a pair that meets again starts anew. Without
    one, a pair's state stays.

    Pairs are dealt over ``buckets`` by a hash, and a bucket's pairs are one state of five numbers a pair, which numpy
    advances at once: a call a bucket and batch, not one a pair. A table of more pairs needs more buckets.

    With ``delta``, the stream is one of points (traj_id, snap, lon, lat), whose contacts are found in the stream: see
    ``point_runs``."""
    if delta is not None:
        if time_col is not None:
            raise ValueError("a stream of points has no event times here; see stream_contacts")
        return point_runs(contacts, delta, k, buckets)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], HELD) if state.exists else np.zeros(0, HELD)
        parts = [np.zeros(0, HELD)]
        for pdf in () if state.hasTimedOut else pdfs:
            part = np.zeros(len(pdf), HELD)
            for c, name in (("a", "a"), ("b", "b"), ("last", "snap")):
                part[c] = pdf[name].to_numpy()
            if time_col is not None:
                part["until"] = pdf["ms"].to_numpy()
            parts.append(part)
        rows = np.concatenate(parts)
        held, out = advanced(held, rows, k)
        if time_col is not None and len(held):
            mark = state.getCurrentWatermarkMs()
            fresh = np.isin(held[["a", "b"]], np.unique(rows[["a", "b"]])) if len(rows) else np.zeros(len(held), bool)
            held = held[fresh | (held["until"] + 1 >= mark)]  # a pair in this batch goes on, as its contacts came in time
        if len(held):
            state.update((held.tobytes(),))
            if time_col is not None:
                state.setTimeoutTimestamp(max(int(held["until"].min()), mark) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"a": out["a"], "b": out["b"], "snap": out["last"].astype("i4")})

    timeout, bucket = "NoTimeout", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).alias("bucket")
    rows = contacts.select("a", "b", "snap", bucket)
    if time_col is not None:
        rows, timeout = contacts.select("a", "b", "snap", bucket, F.col(time_col).alias("ts")).withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts")), "EventTimeTimeout"
    return rows.groupBy("bucket").applyInPandasWithState(step, "a long, b long, snap int", "held binary", "append", timeout)


PACKED = 1 << 20  # points packed at once


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, data): a block's points as ``tiles`` packs them, in a piece or several."""

    def pieces(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [tiles._pack(pdf) for _, pdf in pa.Table.from_batches(held).to_pandas().groupby("block")]
        for one in found:
            yield pa.RecordBatch.from_arrays([pa.array(one["block"], pa.int32()), pa.array(one["data"], pa.binary())], ["block", "data"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= PACKED:
            yield from pieces(held)
            held, n = [], 0
    if n:
        yield from pieces(held)


def joined(pieces: list[bytes]) -> bytes:
    """One piece of a block from several."""
    if len(pieces) == 1:
        return pieces[0]
    parts = []
    for ids, snaps, xy in map(tiles._unpack, pieces):
        _, s, i = there = np.nonzero(~np.isnan(xy[0]))
        parts.append(pd.DataFrame({"block": 0, "traj_id": ids[i], "snap": snaps[s], "lon": xy[0][there], "lat": xy[1][there]}))
    found = pd.concat(parts)
    return tiles._pack(found)["data"].iloc[0] if len(found) else pieces[0]


def open_runs(tile: tiles.Tile, data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, length) in the tile of the runs that a state holds, by row."""
    if data is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, m, size, _ = np.frombuffer(data := zlib.decompress(data), np.int64, 4).tolist()
    old = np.frombuffer(data, np.int64, n + m + size, 32)
    i, j = np.divmod(np.cumsum(old[n + m :]), m)
    kept, at = np.ones(size, bool), []
    for known, ids in ((tile.ids, old[:n][i]), (tile.others, old[n : n + m][j])):
        at.append(np.minimum(np.searchsorted(known, ids), len(known) - 1))
        kept &= known[at[-1]] == ids
    return at[0][kept], at[1][kept], np.frombuffer(data, np.int64, size, 32 + 8 * (n + m + size))[kept]


def swept(tile: tiles.Tile, last: int | None, data: bytes | None, k: int) -> tuple[bytes, pd.DataFrame]:
    """(open runs after the tile's last snapshot, rows where a run reaches k); ``data`` are those after ``last``. Runs
    beyond k count as k + 1."""
    i, j, length = open_runs(tile, data)
    wide, end = len(tile.others), int(tile.snaps[-1])
    out, flat, lengths = [np.zeros((3, 0), np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    for part in tile.rows():
        # of the dense matrix only the places of open runs are touched: contacts are few among a snapshot's pairs
        run, before = np.zeros((part.stop - part.start) * wide, np.min_scalar_type(k + 1 + len(tile.snaps))), last
        of = slice(*np.searchsorted(i, (part.start, part.stop)))
        at, n = (i[of] - part.start) * wide + j[of], length[of]
        for s, met in tile.contacts(part):
            if s - 1 == before:
                run[at] = n
            now = np.flatnonzero(met)
            if tile.same:
                now = now[now % wide > now // wide + part.start]
            n = run[now] + run.dtype.type(1)
            run[at] = 0
            at, before = now, s
            r, c = np.divmod(at[n == k], wide)
            a, b = tile.named(part, r, c)
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.full(len(a), s)]))
        if before == end:
            flat.append(at + part.start * wide)
            lengths.append(np.minimum(n, k + 1).astype(np.int64))
    flat, lengths, out = np.concatenate(flat), np.concatenate(lengths), np.concatenate(out, axis=1)
    head = np.array([len(tile.ids), len(tile.others), len(lengths), 0], np.int64)
    held = b"".join(x.astype(np.int64).tobytes() for x in (head, tile.ids, tile.others, np.diff(flat), lengths))
    return zlib.compress(held, 1), pd.DataFrame({"a": out[0], "b": out[1], "snap": out[2].astype("i4")})


def _step(delta: float, k: int) -> Callable:
    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sides, same = {0: [], 1: []}, False
        for pdf in pdfs:
            for i, j, side, data in zip(pdf["i"], pdf["j"], pdf["side"], pdf["data"]):
                sides[side].append(bytes(data))
                same = i == j
        if same:
            sides[1] = sides[0]
        found = pd.DataFrame({"a": np.zeros(0, "i8"), "b": np.zeros(0, "i8"), "snap": np.zeros(0, "i4")})
        if sides[0] and sides[1]:
            last, held = state.get if state.exists else (None, None)
            second = joined(sides[0])
            tile = tiles.Tile(second if same else joined(sides[1]), second, delta)
            new = tile.snaps > last if last is not None else np.ones(len(tile.snaps), bool)
            tile.snaps, tile.tests = tile.snaps[new], [x for x, kept in zip(tile.tests, new) if kept]
            if len(tile.snaps):
                held, found = swept(tile, last, held, k)
                state.update((int(tile.snaps[-1]), held))
        yield found

    return step


def point_runs(points: DataFrame, delta: float, k: int, buckets: int = BUCKETS) -> DataFrame:
    """(a, b, snap) as ``stream_runs`` gives it of the contacts of a stream of clean points, for crowded ones: contacts
    are far more than points, so none are sent or stored.

    Trajectories are dealt over blocks by a hash, as many as have ``buckets`` pairs of blocks at most. A pair of blocks is
    a state, swept through a batch's snapshots by ``tiles``; it holds the runs open at the last one alone. Points come in
    the order of their snapshots, all of a snapshot in one batch: those of a snapshot that was swept are late and left out."""
    blocks = (math.isqrt(8 * max(1, buckets) + 1) - 1) // 2
    block = F.pmod(F.xxhash64("traj_id"), F.lit(blocks)).cast("int").alias("block")
    data = points.select("traj_id", "snap", "lon", "lat", block).dropna().mapInArrow(packed, "block int, data binary")
    tile = F.expr(f"transform(sequence(0, {blocks - 1}), x -> struct(least(x, block) AS i, greatest(x, block) AS j, if(x < block, 1, 0) AS side))")
    bucket = (F.col("i") * blocks - F.expr("i * (i - 1) div 2") + F.col("j") - F.col("i")).alias("bucket")
    rows = data.select(F.explode(tile).alias("t"), "data").select("t.*", "data").select(bucket, "i", "j", "side", "data")
    return rows.groupBy("bucket").applyInPandasWithState(_step(delta, k), "a long, b long, snap int", "last long, held binary", "append", "NoTimeout")
