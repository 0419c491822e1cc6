"""Runs of consecutive snapshots: islands, longest runs, slices and their stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64  # snapshots of a bit mask


def islands(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs (keys, start, n) of distinct (keys, snap) rows."""
    w = Window.partitionBy(*keys).orderBy("snap")
    g = hits.withColumn("g", F.col("snap") - F.row_number().over(w))
    return g.groupBy(*keys, "g").agg(F.min("snap").cast("int").alias("start"), F.count("*").cast("long").alias("n")).drop("g")


def _within(mask: Column, k: int) -> Column:
    """Whether a mask has k set bits in a row, by doubling shifts."""
    if k > WORD:
        return F.lit(False)
    have = 1
    while have < k:
        step = min(have, k - have)
        mask, have = mask.bitwiseAND(F.shiftrightunsigned(mask, step)), have + step
    return mask != 0


def longest(hits: DataFrame, keys: list[str], k: int = 1) -> DataFrame:
    """(keys, best) of those whose longest run has k snapshots or more. Repeated hits count once.

    Hits become bits of 64-snapshot masks by a bit-or that combines before the shuffle, so one row per key, task and
    64 snapshots is sent, whatever the number of hits; no window, no sort of hits. Masks that hold no run of k and touch
    neither neighbour go before they are sent again by key alone, then keys with fewer than k hits; the runs are the
    pieces between zeros of the joined bit string.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod(snap, {WORD}) as int))")
    word = F.floor(F.col("snap") / WORD).cast("int")
    masks = hits.groupBy(*keys, word.alias("word")).agg(F.bit_or(bit).alias("mask"))
    masks = masks.filter(_within(F.col("mask"), k) | (F.col("mask").bitwiseAND(F.lit(1)) != 0) | (F.col("mask") < 0))
    rows = masks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("m"), F.sum(F.bit_count("mask")).alias("hits"))
    text = F.expr(
        "array_join(transform(m, (x, i) -> concat(IF(i > 0 AND m[i - 1].word <> x.word - 1, '0', ''), "
        f"reverse(lpad(bin(x.mask), {WORD}, '0')))), '')"
    )
    best = F.expr("array_max(transform(split(bits, '0'), x -> length(x)))").cast("long")
    return rows.filter(F.col("hits") >= k).withColumn("bits", text).withColumn("best", best).filter(F.col("best") >= k).select(*keys, "best")


def longest_by_islands(hits: DataFrame, keys: list[str], k: int = 1) -> DataFrame:
    """The same by gaps and islands, for hits without repeats."""
    return islands(hits, keys).groupBy(*keys).agg(F.max("n").alias("best")).filter(F.col("best") >= k)


def sliced(hits: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per slice of ``width`` snapshots: (keys, slice, max_run, prefix_run, suffix_run); runs end at slice borders."""
    s = hits.withColumn("slice", F.floor(F.col("snap") / width).cast("int"))
    runs = islands(s, [*keys, "slice"])
    end = F.col("start") + F.col("n") - 1
    return runs.groupBy(*keys, "slice").agg(
        F.max("n").cast("long").alias("max_run"),
        F.coalesce(F.max(F.when(F.col("start") == F.col("slice") * width, F.col("n"))), F.lit(0)).cast("long").alias("prefix_run"),
        F.coalesce(F.max(F.when(end == F.col("slice") * width + width - 1, F.col("n"))), F.lit(0)).cast("long").alias("suffix_run"),
    )


def stitched(parts: DataFrame, keys: list[str], width: int, k: int) -> DataFrame:
    """(keys, best) from slice parts, whole slices in the middle included.

    Full slices in a row form a chain; a chain's run is the suffix before it, its slices and the prefix after it."""
    w = Window.partitionBy(*keys).orderBy("slice")
    full = F.col("max_run") == width
    p = parts.withColumn("near", F.coalesce(F.lag("slice").over(w) == F.col("slice") - 1, F.lit(False)))
    # a new group starts where the slice before is absent or wasn't full
    p = p.withColumn("new", (~F.col("near") | ~F.coalesce(F.lag(full).over(w), F.lit(False))).cast("int"))
    p = p.withColumn("g", F.sum("new").over(w)).withColumn("before", F.when(F.col("near"), F.lag("suffix_run").over(w)).otherwise(F.lit(0)))
    # within a group all but the last are full; the first brings the suffix of the slice before
    c = p.groupBy(*keys, "g").agg(
        F.min_by("before", "slice").alias("before"), F.sum(F.when(full, F.lit(width)).otherwise(F.lit(0))).alias("middle"),
        F.max_by(F.when(full, F.lit(0)).otherwise(F.col("prefix_run")), "slice").alias("after"), F.max("max_run").alias("inside"),
    )
    run = F.greatest("inside", F.col("before") + F.col("middle") + F.col("after")).cast("long")
    return c.groupBy(*keys).agg(F.max(run).alias("best")).filter(F.col("best") >= k)


def sampled_windows(hits: DataFrame, keys: list[str], step: int, need: int) -> DataFrame:
    """Keys with ``need`` consecutive sampled hits (snap % step = 0) in some window; hits have no repeats."""
    s = hits.filter(F.col("snap") % step == 0).withColumn("j", (F.col("snap") / step).cast("int"))
    w = Window.partitionBy(*keys).orderBy("j").rangeBetween(-(need - 1), 0)
    return s.withColumn("c", F.count("*").over(w)).filter(F.col("c") == need).select(*keys).distinct()
