"""Optional lossless (or bit-bounded) codec of coordinate sequences: linear prediction, XOR residuals, Huffman classes.

Parquet with zstd is the storage format; this is for binary exchange of single trajectories.
Block: count, discarded bits, number of classes, class widths, code lengths, then the bit stream, all little-endian.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geo import present


def discarded_bits(max_value: float, error: float) -> int:
    """Low mantissa bits of a float32 that may go without an error above ``error`` for values up to ``max_value``."""
    if error <= 0 or max_value <= 0:
        return 0
    exponent = math.floor(math.log2(max_value)) - 23
    return max(0, min(23, math.floor(math.log2(error)) - exponent))


def predicted(x: np.ndarray, t: np.ndarray | None = None) -> np.ndarray:
    """What each value is predicted to be from the two before it: the line through them, at the value's own time if
    times are given. The first is predicted by 0, the second by the first."""
    out = np.zeros(len(x), np.float32)
    out[1:2] = x[:1]
    if len(x) > 2:
        step = x[1:-1] - x[:-2]
        if t is not None:
            step = step * time_ratio(t[:-2], t[1:-1], t[2:])
        out[2:] = x[1:-1] + step
    return out


def time_ratio(before, last, now):
    """Length of the present interval over that of the one before; 1 where that has no length."""
    old = np.asarray(last, np.float32) - np.asarray(before, np.float32)
    return np.where(old > 0, (np.asarray(now, np.float32) - np.asarray(last, np.float32)) / np.where(old > 0, old, np.float32(1)), np.float32(1)).astype(np.float32)


def classes(freq: np.ndarray, most: int = 8) -> list[int]:
    """Class widths (ascending, the last covers all): the cheapest way to round bit lengths up with at most ``most``
    classes, where a value costs its class's width and about the class's code length."""
    used = np.flatnonzero(freq)
    if len(used) == 0:
        return [0]
    top, total = int(used[-1]), float(freq.sum())
    cum = np.concatenate([[0.0], np.cumsum(freq[: top + 1])])
    n = np.maximum(cum[None, 1:] - cum[:-1, None], 0)  # of lengths a..b
    cost = n * np.arange(top + 1) - n * np.log2(np.where(n > 0, n, total) / total)  # if they are a class of width b
    after = np.where(np.arange(1, top + 1)[:, None] <= np.arange(top + 1)[None, :], cost[1:], np.inf)
    best, came = [cost[0]], []
    for _ in range(1, most):
        total_of = best[-1][:-1, None] + after
        came.append(total_of.argmin(axis=0) if top else np.zeros(1, np.int64))
        best.append(total_of.min(axis=0, initial=np.inf))
    k = int(np.argmin([row[top] for row in best]))
    out = [top]
    while k:
        out.append(int(came[k - 1][out[-1]]))
        k -= 1
    return out[::-1]


def code_lengths(freq: list[int]) -> list[int]:
    """Huffman code lengths; a single symbol gets one bit."""
    heap = [(f, k, [k]) for k, f in enumerate(freq) if f > 0]
    out = [0] * len(freq)
    if len(heap) == 1:
        out[heap[0][1]] = 1
    heapq.heapify(heap)
    tick = len(freq)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for k in a[2] + b[2]:
            out[k] += 1
        heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
        tick += 1
    return out


def canonical(lengths: list[int]) -> list[int]:
    code, last, out = 0, 0, [0] * len(lengths)
    for n, k in sorted((n, k) for k, n in enumerate(lengths) if n):
        code <<= n - last
        out[k], last = code, n
        code += 1
    return out


def encode_axis(values: np.ndarray, drop: int = 0, t: np.ndarray | None = None) -> bytes:
    x = np.asarray(values, np.float32).copy()
    if drop:
        x = (x.view(np.uint32) & np.uint32((0xFFFFFFFF << drop) & 0xFFFFFFFF)).view(np.float32)
    with np.errstate(all="ignore"):
        res = x.view(np.uint32) ^ predicted(x, t).view(np.uint32)
    bits = np.ceil(np.log2(res.astype(np.float64) + 1)).astype(np.int64)
    widths = classes(np.bincount(bits, minlength=33))
    sym = np.searchsorted(widths, bits)
    lengths = code_lengths(np.bincount(sym, minlength=len(widths)).tolist())
    codes = np.array(canonical(lengths), np.uint64)
    width = np.array(widths, np.uint64)[sym]
    word = (codes[sym] << width) | res.astype(np.uint64)
    size = np.array(lengths, np.int64)[sym] + width.astype(np.int64)
    body = b""
    for k in range(0, len(word), 1 << 16):  # each word's last ``size`` bits, one after another; parts meet at bit bounds
        part = np.unpackbits(word[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        part = part[np.arange(64)[None, :] >= 64 - size[k : k + (1 << 16), None]]
        body += part.tobytes()
    body = np.packbits(np.frombuffer(body, np.uint8)).tobytes()
    return len(x).to_bytes(4, "little") + bytes([drop, len(widths), *widths, *lengths]) + len(body).to_bytes(4, "little") + body


def residuals(stream: np.ndarray, n: int, widths: list[int], lengths: list[int]) -> np.ndarray:
    """The n residuals of a bit stream. What starts at each bit is looked up for all bits at once; only the walk from
    one code to the next is sequential."""
    bits = np.concatenate([np.unpackbits(stream), np.zeros(64, np.uint8)]).astype(np.uint64)
    most = max(lengths, default=1)
    window = np.zeros(len(bits) - most + 1, np.uint64)
    for k in range(most):
        window = (window << np.uint64(1)) | bits[k : k + len(window)]
    table = np.zeros(1 << most, np.int64)
    for s, (c, m) in enumerate(zip(canonical(lengths), lengths)):
        if m:
            table[c << (most - m) : (c + 1) << (most - m)] = s
    sym = table[window.astype(np.int64)]
    hop = (np.array(lengths, np.int64) + np.array(widths, np.int64))[sym].tolist()
    at, start = 0, np.zeros(n, np.int64)
    for i in range(n):
        start[i] = at
        at += hop[at]
    s = sym[start]
    begin, width, out = start + np.array(lengths, np.int64)[s], np.array(widths, np.int64)[s], np.zeros(n, np.uint64)
    for k in range(int(width.max(initial=0))):
        more = k < width
        out[more] = (out[more] << np.uint64(1)) | bits[begin[more] + k]
    return out.astype(np.uint32)


def decode_axis(block: bytes, t: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(values, bytes read)."""
    n, k = int.from_bytes(block[:4], "little"), block[5]
    widths, lengths = list(block[6 : 6 + k]), list(block[6 + k : 6 + 2 * k])
    at = 6 + 2 * k
    size = int.from_bytes(block[at : at + 4], "little")
    res = residuals(np.frombuffer(block[at + 4 : at + 4 + size], np.uint8), n, widths, lengths) if n else np.zeros(0, np.uint32)
    x, guess = np.zeros(n, np.float32), np.zeros(1, np.float32)
    u, g = x.view(np.uint32), guess.view(np.uint32)
    ratio = time_ratio(t[:-2], t[1:-1], t[2:]) if t is not None and n > 2 else None
    with np.errstate(all="ignore"):
        for i in range(n):
            if i < 2:
                guess[0] = x[0] if i else 0
            else:
                step = x[i - 1] - x[i - 2]
                guess[0] = x[i - 1] + (step if ratio is None else step * ratio[i - 2])
            u[i] = res[i] ^ g[0]
    return x, at + 4 + size


def encode(lon: np.ndarray, lat: np.ndarray, error: float = 0.0, t: np.ndarray | None = None) -> bytes:
    """One block of a trajectory's coordinates; with times these are kept too, and the coordinates predicted by them."""
    top = lambda v: float(np.max(np.abs(v), initial=0))
    t = None if t is None else np.asarray(t, np.float32)
    head = b"" if t is None else encode_axis(t)
    return head + encode_axis(lon, discarded_bits(top(lon), error), t) + encode_axis(lat, discarded_bits(top(lat), error), t)


def decode(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    lon, n = decode_axis(block)
    return lon, decode_axis(block[n:])[0]


def decode_timed(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, lon, lat) of a block that was encoded with times."""
    t, n = decode_axis(block)
    lon, m = decode_axis(block[n:], t)
    return t, lon, decode_axis(block[n + m :], t)[0]


def compress(points: DataFrame, error: float = 0.0) -> DataFrame:
    """(traj_id, start, block): one block for each trajectory's snapshots in order, gaps filled with the missing mark."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("snap").drop_duplicates("snap")
        at = (pdf["snap"] - pdf["snap"].iloc[0]).to_numpy()
        lon, lat = np.full(at[-1] + 1, -1.0, np.float32), np.full(at[-1] + 1, -1.0, np.float32)
        lon[at], lat[at] = pdf["lon"], pdf["lat"]
        return pd.DataFrame({"traj_id": [pdf["traj_id"].iloc[0]], "start": [pdf["snap"].iloc[0]], "block": [encode(lon, lat, error)]})

    return points.groupBy("traj_id").applyInPandas(pack, "traj_id long, start int, block binary")


def decompress(blocks: DataFrame) -> DataFrame:
    """Points of blocks, missing ones left out."""

    def unpack(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lon, lat = decode(bytes(r.block))
                yield pd.DataFrame({"traj_id": r.traj_id, "snap": np.arange(len(lon), dtype=np.int32) + r.start, "lon": lon.astype(float), "lat": lat.astype(float)})

    return blocks.select("traj_id", "start", "block").mapInPandas(unpack, "traj_id long, snap int, lon double, lat double").filter(present())


def linear_residuals(points: DataFrame, time: str | None = None) -> DataFrame:
    """Prediction of each coordinate by the line through the two before it, and its error; the first two are predicted
    by 0 and the first. With a ``time`` column the line is followed for as long as the present interval."""
    w = Window.partitionBy("traj_id").orderBy("snap")
    out = points
    for c in ("lon", "lat"):
        one, two = F.lag(c, 1).over(w), F.lag(c, 2).over(w)
        hat = 2 * one - two
        if time is not None:
            old = F.lag(time, 1).over(w) - F.lag(time, 2).over(w)
            hat = one + (one - two) * F.when(old > 0, (F.col(time) - F.lag(time, 1).over(w)) / old).otherwise(1.0)
        out = out.withColumn(f"{c}_hat", F.when(two.isNotNull(), hat).otherwise(F.coalesce(one, F.lit(0.0))))
    return out.select("traj_id", "snap", "lon_hat", "lat_hat", (F.col("lon") - F.col("lon_hat")).alias("lon_err"), (F.col("lat") - F.col("lat_hat")).alias("lat_err"))


def pack_slices(points: DataFrame, width: int) -> DataFrame:
    """Points (time_part, space_part, space_order, snap, lon, lat) as one row per slice: (time_part, space_part, content).

    Content: the number of trajectories, each block's place after the table (big-endian 32-bit integers), then the
    blocks in the order of space_order; a block has ``width`` snapshots, those without a point hold the missing mark."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        time, blocks = int(pdf["time_part"].iloc[0]), {}
        for order, g in pdf.groupby("space_order"):
            lon, lat = np.full(width, -1.0, np.float32), np.full(width, -1.0, np.float32)
            at = g["snap"].to_numpy() - time * width
            lon[at], lat[at] = g["lon"], g["lat"]
            blocks[int(order)] = encode(lon, lat)
        count = max(blocks) + 1
        rows = [blocks.get(k, b"") for k in range(count)]
        places = np.concatenate([[0], np.cumsum([len(b) for b in rows])[:-1]])
        content = np.r_[count, places].astype(">i4").tobytes() + b"".join(rows)
        return pd.DataFrame({"time_part": [time], "space_part": [int(pdf["space_part"].iloc[0])], "content": [content]})

    return points.select("time_part", "space_part", "space_order", "snap", "lon", "lat").groupBy("time_part", "space_part").applyInPandas(pack, "time_part int, space_part int, content binary")


def blocks_of(content: bytes) -> list[bytes]:
    """The blocks of a packed slice, found by its table."""
    n = int(np.frombuffer(content[:4], ">i4")[0])
    at = np.frombuffer(content[4 : 4 + 4 * n], ">i4").astype(int).tolist()
    body = content[4 + 4 * n :]
    return [body[a:b] for a, b in zip(at, [*at[1:], len(body)])]


def unpack_slices(slices: DataFrame, width: int, orders: list[int] | None = None) -> DataFrame:
    """Points (time_part, space_part, space_order, snap, lon, lat) of packed slices, missing ones left out; of the
    blocks numbered ``orders`` alone if given, whose bytes are cut out by the table."""

    def unpack(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                blocks = blocks_of(bytes(r.content))
                for k in range(len(blocks)) if orders is None else [k for k in orders if k < len(blocks)]:
                    if blocks[k]:
                        lon, lat = decode(blocks[k])
                        yield pd.DataFrame({"time_part": r.time_part, "space_part": r.space_part, "space_order": k, "snap": r.time_part * width + np.arange(len(lon)), "lon": lon.astype(float), "lat": lat.astype(float)})

    schema = "time_part int, space_part int, space_order int, snap int, lon double, lat double"
    return slices.select("time_part", "space_part", "content").mapInPandas(unpack, schema).filter(present())
