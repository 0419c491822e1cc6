"""Subtrajectory query and subtrajectory join, each one definition with several strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells, runs, tiles
from .index import candidates

SLICE, BOXES = 8, 64  # snapshots of a pattern's box; boxes pushed into a scan at most


def pattern_boxes(patterns: DataFrame, delta: float, width: int, most: int = BOXES) -> list[tuple]:
    """(first snap, last snap, min lon, max lon, min lat, max lat) that hold all contacts with the patterns: a box for
    each pattern and ``width`` snapshots, grown by delta; where these are more than ``most``, one for all patterns and
    ever wider slices. The patterns are the query set, so their boxes reach the driver."""
    sums = [f(c).alias(n) for c in ("snap", "lon", "lat") for f, n in ((F.min, f"min_{c}"), (F.max, f"max_{c}"))]
    keys = ["query_id"]
    while True:
        found = patterns.groupBy(*keys, F.floor(F.col("snap") / width).alias("part")).agg(*sums).limit(most + 1).collect()
        if len(found) <= most:
            return sorted((r.min_snap, r.max_snap, r.min_lon - delta, r.max_lon + delta, r.min_lat - delta, r.max_lat + delta) for r in found)
        keys, width = [], width if keys else 4 * width


def near_patterns(points: DataFrame, found: list[tuple]) -> DataFrame:
    """Points in one of the boxes: what is pushed into the scan as literals, all boxes' hull first."""
    if not found:
        return points
    inside = lambda b: F.col("snap").between(b[0], b[1]) & F.col("lon").between(b[2], b[3]) & F.col("lat").between(b[4], b[5])
    hull = tuple((min if k % 2 == 0 else max)(b[k] for b in found) for k in range(6))
    any_of = inside(found[0])
    for b in found[1:]:
        any_of = any_of | inside(b)
    return points.filter(inside(hull)).filter(any_of) if len(found) > 1 else points.filter(any_of)


def pattern_hits(points: DataFrame, pattern_ids: list[int], delta: float, width: int = SLICE) -> DataFrame:
    """(query_id, traj_id, snap): contacts of stored points with the stored patterns."""
    p = cells.clean(points)
    patterns = p.filter(F.col("traj_id").isin(*pattern_ids)).withColumnRenamed("traj_id", "query_id")
    return cells.query_contacts(near_patterns(p, pattern_boxes(patterns, delta, width)), patterns, delta)


def subtraj_query(points: DataFrame, pattern_ids: list[int], delta: float, k: int, prefilter_step: int = 0, ordered: bool = False) -> DataFrame:
    """(query_id, traj_id, best) of trajectories in contact with a stored pattern for k snapshots in a row or more.

    One plan answers all patterns. Each pattern's boxes by time slice, grown by delta, are pushed into the scan.
    ``prefilter_step`` > 0 first keeps trajectories with enough sampled contacts in a row, which never loses a match.
    ``ordered`` sorts the rows by pattern and id."""
    hits = pattern_hits(points, pattern_ids, delta)
    if prefilter_step and k // prefilter_step >= 1:
        hits = hits.join(runs.sampled_windows(hits, ["query_id", "traj_id"], prefilter_step, k // prefilter_step), ["query_id", "traj_id"], "left_semi")
    found = runs.longest(hits, ["query_id", "traj_id"], k)
    return found.orderBy("query_id", "traj_id") if ordered else found


def stored_query(points: DataFrame, index: DataFrame, pattern_ids: list[int], box: tuple[float, float, float, float], grid: int, step: int, delta: float, k: int) -> DataFrame:
    """The same rows for k >= step, found by way of stored postings (snap, cell, ids) of every ``step``-th snapshot:
    trajectories that share a cell with the pattern's box at k // step sampled snapshots in a row are verified, others
    aren't read. Points outside the index's box aren't in the postings, so all must lie in it."""
    p = cells.clean(points)
    patterns = p.filter(F.col("traj_id").isin(*pattern_ids)).withColumnRenamed("traj_id", "query_id")
    maybe = candidates(index, patterns.filter(F.col("snap") % step == 0), box, grid, delta)
    few = runs.sampled_windows(maybe, ["query_id", "traj_id"], step, k // step)
    kept = near_patterns(p, pattern_boxes(patterns, delta, SLICE)).join(few.select("traj_id").distinct(), "traj_id", "left_semi")
    hits = cells.query_contacts(kept, patterns, delta).join(few, ["query_id", "traj_id"], "left_semi")
    return runs.longest(hits, ["query_id", "traj_id"], k)


def query_metrics(points: DataFrame, pattern_ids: list[int], delta: float, k: int) -> DataFrame:
    """Per pattern: contacts, candidates (trajectories with a contact) and results (itself included)."""
    hits = pattern_hits(points, pattern_ids, delta)
    seen = hits.groupBy("query_id").agg(F.count("*").alias("contacts"), F.countDistinct("traj_id").alias("candidates"))
    good = runs.longest(hits, ["query_id", "traj_id"], k).groupBy("query_id").agg(F.count("*").alias("results"))
    return seen.join(good, "query_id", "left").select("query_id", "contacts", "candidates", F.coalesce("results", F.lit(0)).cast("long").alias("results"))


def metric_sums(metrics: DataFrame) -> DataFrame:
    """All numeric columns but the pattern's id, added up."""
    return metrics.agg(*[F.sum(c).alias(c) for c, t in metrics.dtypes if c != "query_id" and t in ("int", "bigint", "double", "float")])


def pair_islands(points: DataFrame, delta: float) -> DataFrame:
    """(a, b, start, n): all maximal runs of contacts. Like all ``pair_`` functions, of points that are clean, by tiles of
    trajectories where points are crowded, else by cells."""
    return tiles.sweep(points, delta, "islands") if tiles.crowded(points, delta) else runs.islands(cells.contacts(points, delta), ["a", "b"])


def pair_longest(points: DataFrame, delta: float, k: int, crowd: int = cells.CROWD) -> DataFrame:
    """(a, b, best) of pairs whose longest run has k snapshots or more."""
    return tiles.sweep(points, delta, "longest", k=k) if tiles.crowded(points, delta) else runs.longest(cells.contacts(points, delta, crowd), ["a", "b"], k)


def pair_slices(points: DataFrame, delta: float, width: int) -> DataFrame:
    """(a, b, slice, max_run, prefix_run, suffix_run) of each slice with a contact."""
    return tiles.sweep(points, delta, "sliced", width=width) if tiles.crowded(points, delta) else runs.sliced(cells.contacts(points, delta), ["a", "b"], width)


def pair_stitched(points: DataFrame, delta: float, width: int, k: int, crowd: int = cells.CROWD) -> DataFrame:
    """(a, b, best) as ``pair_longest``, by slices and their stitching."""
    if tiles.crowded(points, delta):
        return tiles.sweep(points, delta, "stitched", width=width, k=k)
    return runs.stitched(runs.sliced(cells.contacts(points, delta, crowd), ["a", "b"], width), ["a", "b"], width, k)


def pair_windows(points: DataFrame, delta: float, step: int, need: int) -> DataFrame:
    """(a, b) with ``need`` contacts in a row at every ``step``-th snapshot."""
    p = points.filter(F.col("snap") % step == 0)
    return tiles.sweep(p, delta, "windows", step=step, need=need) if tiles.crowded(p, delta) else runs.sampled_windows(cells.contacts(p, delta), ["a", "b"], step, need)


def pair_parts(points: DataFrame, delta: float, cuts: list[int]) -> DataFrame:
    """(a, b, parts) of pairs in contact, once each: bit n of parts tells of contacts from the snapshot cuts[n - 1] to
    the one before cuts[n]. Sets of pairs by times are bits of this table."""
    if tiles.crowded(points, delta):
        return tiles.sweep(points, delta, "parts", cuts=cuts)
    part = sum((F.when(F.col("snap") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    bit = F.call_function("shiftleft", F.lit(1), part)
    return cells.contacts(points, delta).groupBy("a", "b").agg(F.bit_or(bit).alias("parts"))


def contact_counts(points: DataFrame, delta: float, width: int) -> DataFrame:
    """(a, slice, n): contacts by lesser trajectory and slice, in one row or several that add up."""
    if tiles.crowded(points, delta):
        return tiles.sweep(points, delta, "counts", width=width)
    return cells.contacts(points, delta).groupBy("a", F.floor(F.col("snap") / width).cast("int").alias("slice")).agg(F.count("*").alias("n"))


def subtraj_join(points: DataFrame, delta: float, k: int, strategy: str = "cell", width: int = 8, step: int = 0, crowd: int = cells.CROWD) -> DataFrame:
    """(a, b, best) of all pairs a < b in contact for k snapshots in a row or more.

    strategy: cell (grid equi-join, bit-mask runs), naive (snapshot equi-join, islands), replicated (all touched
    cells), sliced (runs by time slices of ``width``, stitched), sampled (candidates from every ``step``-th snapshot
    first, then exact). All give the same rows. Where points are crowded, contacts are those of a sweep of all pairs,
    which is cheaper then (counted); slices are stitched and samples taken within it."""
    p = cells.clean(points)
    if strategy in ("naive", "replicated") and tiles.crowded(p, delta):
        return tiles.sweep(p, delta, "longest", k=k)
    if strategy == "naive":
        return runs.longest_by_islands(cells.contacts_naive(p, delta), ["a", "b"], k)
    if strategy == "replicated":
        return runs.longest_by_islands(cells.contacts_replicated(p, delta), ["a", "b"], k)
    if strategy == "sliced":
        return pair_stitched(p, delta, width, k, crowd)
    if strategy == "sampled":
        m = step or max(1, k // 2)
        need = k // m
        if need >= 1 and tiles.crowded(p, delta):
            return tiles.sweep(p, delta, "sampled", step=m, need=need, k=k)
        few = cells.contacts(p.filter(F.col("snap") % m == 0), delta, crowd)
        pairs = runs.sampled_windows(few, ["a", "b"], m, need) if need >= 1 else None
        # only trajectories that are in some candidate pair meet again at all snapshots
        if pairs is not None:
            ids = pairs.select(F.explode(F.array("a", "b")).alias("traj_id")).distinct()
            hits = cells.contacts(p.join(ids, "traj_id", "left_semi"), delta, crowd).join(pairs, ["a", "b"], "left_semi")
        else:
            hits = cells.contacts(p, delta, crowd)
        return runs.longest(hits, ["a", "b"], k)
    if strategy != "cell":
        raise ValueError(strategy)
    return pair_longest(p, delta, k, crowd)
