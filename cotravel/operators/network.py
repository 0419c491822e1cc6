"""Road network: endpoints, adjacency, candidates, traversal statistics and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import equirectangular, haversine, line_distance, matched_node, segment_distance

SPEED = 16.0  # metres a second where a travel time is unknown
LON_REACH, LAT_REACH, MATCH_M = 0.000976, 0.0009, 35.0


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (edge_id, s_node, e_node) with their ends' coordinates and midpoints."""
    s = nodes.select(F.col("node_id").alias("s_node"), F.col("lng").alias("s_lng"), F.col("lat").alias("s_lat"))
    e = nodes.select(F.col("node_id").alias("e_node"), F.col("lng").alias("e_lng"), F.col("lat").alias("e_lat"))
    out = edges.join(s, "s_node").join(e, "e_node")
    return out.withColumns({"c_lng": (F.col("s_lng") + F.col("e_lng")) / 2, "c_lat": (F.col("s_lat") + F.col("e_lat")) / 2})


def node_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges given by coordinates (s_lng, s_lat, e_lng, e_lat) with node ids; of nodes at one place the least id."""
    place = nodes.groupBy("lng", "lat").agg(F.min("node_id").alias("node_id"))
    s = place.select(F.col("lng").alias("s_lng"), F.col("lat").alias("s_lat"), F.col("node_id").alias("s_node"))
    e = place.select(F.col("lng").alias("e_lng"), F.col("lat").alias("e_lat"), F.col("node_id").alias("e_node"))
    return edges.join(s, ["s_lng", "s_lat"], "left").join(e, ["e_lng", "e_lat"], "left")


def lengths(edges: DataFrame, radius_km: float = 6378.137) -> DataFrame:
    """Network properties: section_id, s_node, e_node, length in metres on the sphere."""
    return edges.select(F.col("edge_id").alias("section_id"), "s_node", "e_node", haversine("s_lng", "s_lat", "e_lng", "e_lat", radius_km).alias("length"))


def flat_lengths(edges: DataFrame) -> DataFrame:
    return edges.withColumn("length", equirectangular(F.col("e_lng") - F.col("s_lng"), F.col("e_lat") - F.col("s_lat"), (F.col("s_lat") + F.col("e_lat")) / 2))


def undirected(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair of nodes: the least edge_id."""
    lo, hi = F.least("s_node", "e_node"), F.greatest("s_node", "e_node")
    return edges.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min_by(F.struct(*edges.columns), "edge_id").alias("e")).select("e.*")


def adjacency(edges: DataFrame, weights: DataFrame | None = None, times: DataFrame | None = None, default_weight: float = 1.0) -> DataFrame:
    """(node_id, next_node, edge_id, length, weight, travel_time) in both directions; unknown times are length / SPEED."""
    e = edges.select("edge_id", "s_node", "e_node", "length")
    both = e.select("edge_id", "length", F.col("s_node").alias("node_id"), F.col("e_node").alias("next_node")).unionByName(
        e.select("edge_id", "length", F.col("e_node").alias("node_id"), F.col("s_node").alias("next_node"))
    )
    if weights is not None:
        both = both.join(weights.select("edge_id", F.col("n").cast("double").alias("w")), "edge_id", "left")
    if times is not None:
        both = both.join(times.select("edge_id", F.col("mean_s").alias("t")), "edge_id", "left")
    w = F.coalesce(F.col("w"), F.lit(default_weight)) if weights is not None else F.lit(default_weight)
    t = F.coalesce(F.col("t"), F.col("length") / SPEED) if times is not None else F.col("length") / SPEED
    return both.select("node_id", "next_node", "edge_id", "length", w.alias("weight"), t.alias("travel_time"))


def geodesic_metres(x1, y1, x2, y2) -> np.ndarray:
    """Metres along the WGS-84 ellipsoid between places in degrees, by Vincenty's inverse formula (arrays); NaN where
    the iteration doesn't settle (places nearly opposite each other)."""
    a, f = 6378137.0, 1 / 298.257223563  # fixed values: the ellipsoid's axis and flattening
    b = a * (1 - f)
    x1, y1, x2, y2 = (np.radians(np.asarray(v, float)) for v in (x1, y1, x2, y2))
    u1, u2, d = np.arctan((1 - f) * np.tan(y1)), np.arctan((1 - f) * np.tan(y2)), x2 - x1
    lam = d.copy()
    with np.errstate(all="ignore"):
        for _ in range(200):
            cross = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            along = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(cross, along)
            sine = np.where(cross > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / cross, 0.0)
            flat = 1 - sine**2
            middle = np.where(flat > 1e-15, along - 2 * np.sin(u1) * np.sin(u2) / flat, 0.0)
            c = f / 16 * flat * (4 + f * (4 - 3 * flat))
            new = d + (1 - c) * f * sine * (sigma + c * cross * (middle + c * along * (2 * middle**2 - 1)))
            done = np.abs(new - lam) < 1e-13
            lam = new
            if done.all():
                break
        u = flat * (a * a - b * b) / (b * b)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        off = small * cross * (middle + small / 4 * (along * (2 * middle**2 - 1) - small / 6 * middle * (4 * cross**2 - 3) * (4 * middle**2 - 3)))
        return np.where(done, b * big * (sigma - off), np.nan)


def geodesic_lengths(edges: DataFrame) -> DataFrame:
    """Network properties with lengths along the WGS-84 ellipsoid: section_id, s_node, e_node, length."""

    @F.pandas_udf("double")
    def metres(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        return pd.Series(geodesic_metres(x1, y1, x2, y2))

    return edges.select(F.col("edge_id").alias("section_id"), "s_node", "e_node", metres("s_lng", "s_lat", "e_lng", "e_lat").alias("length"))


def place_lists(points: DataFrame) -> DataFrame:
    """(traj_id, places): each trajectory's (snap, lon, lat) in order, for operators that need it whole."""
    return points.groupBy("traj_id").agg(F.sort_array(F.collect_list(F.struct("snap", "lon", "lat"))).alias("places"))


def match_candidates(points: DataFrame, edges: DataFrame, lon_reach: float = LON_REACH, lat_reach: float = LAT_REACH, radius_m: float = MATCH_M) -> DataFrame:
    """(traj_id, snap, edge_id, dist_m, node_id): edges with an end or midpoint in reach and at most ``radius_m`` away.

    The three-way OR of ranges is three cell equi-joins in one: each edge comes once for each of its three anchors."""
    anchor = F.explode(F.array(*[F.struct(F.col(f"{k}_lng").alias("x"), F.col(f"{k}_lat").alias("y")) for k in "sec"]))
    cell = lambda c, w: F.floor(F.col(c) / (w * (1 + 1e-9)))
    e = edges.withColumn("anchor", anchor).select("*", "anchor.x", "anchor.y").drop("anchor").withColumns({"cx": cell("x", lon_reach), "cy": cell("y", lat_reach)})
    p = points.select("traj_id", "snap", "lon", "lat").withColumns({"px": cell("lon", lon_reach), "py": cell("lat", lat_reach)})
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> named_struct('i', i, 'j', j))))"))
    p = p.withColumn("s", near).withColumns({"cx": F.col("px") + F.col("s.i"), "cy": F.col("py") + F.col("s.j")}).drop("px", "py", "s")
    met = p.join(e, ["cx", "cy"]).filter((F.abs(F.col("lon") - F.col("x")) <= lon_reach) & (F.abs(F.col("lat") - F.col("y")) <= lat_reach))
    met = met.dropDuplicates(["traj_id", "snap", "edge_id"])
    a, b = haversine("lon", "lat", "s_lng", "s_lat", 6367.0), haversine("lon", "lat", "e_lng", "e_lat", 6367.0)
    c = haversine("s_lng", "s_lat", "e_lng", "e_lat", 6367.0)
    d = met.withColumns({"_a": a, "_b": b, "_c": c})
    dist = segment_distance(F.col("_a"), F.col("_b"), F.col("_c"))
    node = matched_node(F.col("_a"), F.col("_b"), F.col("_c"), "s_node", "e_node")
    return d.withColumn("dist", dist).filter(F.col("dist") <= radius_m).select("traj_id", "snap", "lon", "lat", "edge_id", F.round("dist").cast("int").alias("dist_m"), node.alias("node_id"))


def nearest_edge(points: DataFrame, matched: DataFrame, edges: DataFrame) -> DataFrame:
    """(traj_id, snap, edge_id): of the trajectory's matched edges (traj_id, ordinal, edge_id) the one whose line is
    nearest; the first of equals."""
    m = points.join(matched, "traj_id").join(edges.select("edge_id", "s_lng", "s_lat", "e_lng", "e_lat"), "edge_id")
    d = line_distance("lon", "lat", "s_lng", "s_lat", "e_lng", "e_lat")
    return m.withColumn("d", d).filter(F.col("d").isNotNull()).groupBy("traj_id", "snap").agg(F.min_by("edge_id", F.struct("d", "ordinal")).alias("edge_id"))


def edge_spans(visits: DataFrame) -> DataFrame:
    """(traj_id, edge_id, span_s): last minus first time of each stay on one edge; stays of no length go.
    visits: (traj_id, t seconds, edge_id)."""
    w = Window.partitionBy("traj_id").orderBy("t")
    new = F.coalesce((F.col("edge_id") != F.lag("edge_id").over(w)).cast("int"), F.lit(1))
    g = visits.withColumn("new", new).withColumn("g", F.sum("new").over(w))
    spans = g.groupBy("traj_id", "g", "edge_id").agg((F.max("t") - F.min("t")).cast("long").alias("span_s"))
    return spans.filter("span_s > 0").select("traj_id", "edge_id", "span_s")


def edge_mean_time(spans: DataFrame) -> DataFrame:
    return spans.groupBy("edge_id").agg(F.avg("span_s").alias("mean_s"))


def edge_counts(visited: DataFrame) -> DataFrame:
    """Visits of each edge (n), and n_after_first, which leaves out the first."""
    return visited.groupBy("edge_id").agg(F.count("*").cast("long").alias("n"), (F.count("*") - 1).cast("long").alias("n_after_first"))


def path_length(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum of the lengths of a path's edges (path_id, ordinal, edge_id)."""
    return paths.join(edges.select("edge_id", "length"), "edge_id").groupBy("path_id").agg(F.sum("length").alias("length"))


def oriented(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Path edges with the coordinates they are left and entered by: an edge runs towards the node it shares with the
    next; the last one away from the node it shares with the one before."""
    e = edges.select("edge_id", "s_node", "e_node", "s_lng", "s_lat", "e_lng", "e_lat", "length")
    w = Window.partitionBy("path_id").orderBy("ordinal")
    p = paths.join(e, "edge_id").withColumns({
        "n_s": F.lead("s_node").over(w), "n_e": F.lead("e_node").over(w), "p_s": F.lag("s_node").over(w), "p_e": F.lag("e_node").over(w),
    })
    ahead = F.when(F.col("n_s").isNotNull(), F.col("e_node").isin(F.col("n_s"), F.col("n_e"))).when(F.col("p_s").isNotNull(), F.col("s_node").isin(F.col("p_s"), F.col("p_e"))).otherwise(F.lit(True))
    p = p.withColumn("ahead", ahead)
    pick = lambda a, b: F.when(F.col("ahead"), F.col(a)).otherwise(F.col(b))
    return p.select("path_id", "ordinal", "edge_id", "length", pick("s_lng", "e_lng").alias("x1"), pick("s_lat", "e_lat").alias("y1"), pick("e_lng", "s_lng").alias("x2"), pick("e_lat", "s_lat").alias("y2"))


def resample(paths: DataFrame, edges: DataFrame, times: DataFrame | None = None, step_s: float = 5.0) -> DataFrame:
    """(path_id, ordinal, j, lon, lat): points each ``step_s`` seconds along each edge from its entry, and the path's end.

    times: (edge_id, mean_s); unknown times are length / SPEED."""
    o = oriented(paths, edges)
    if times is not None:
        o = o.join(times.select("edge_id", "mean_s"), "edge_id", "left")
    t = F.coalesce(F.col("mean_s"), F.col("length") / SPEED) if times is not None else F.col("length") / SPEED
    o = o.withColumn("share", F.lit(step_s) / t).withColumn("n", F.greatest(F.ceil(1 / F.col("share")), F.lit(1)).cast("int"))
    pts = o.withColumn("j", F.explode(F.expr("sequence(0, n - 1)"))).select(
        "path_id", "ordinal", "j", (F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("share") * F.col("j")).alias("lon"), (F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("share") * F.col("j")).alias("lat")
    )
    last = o.groupBy("path_id").agg(F.max_by(F.struct("ordinal", "n", "x2", "y2"), "ordinal").alias("e"))
    return pts.unionByName(last.select("path_id", "e.ordinal", F.col("e.n").alias("j"), F.col("e.x2").alias("lon"), F.col("e.y2").alias("lat")))


def to_snaps(samples: DataFrame) -> DataFrame:
    """Resampled path points as a point table: traj_id is the path, snap the running number of the point."""
    w = Window.partitionBy("path_id").orderBy("ordinal", "j")
    return samples.select(F.col("path_id").cast("long").alias("traj_id"), (F.row_number().over(w) - 1).cast("int").alias("snap"), "lon", "lat")


def weight_shares(adj: DataFrame) -> DataFrame:
    """Running share of each next edge's weight at its node, by edge_id: the thresholds of a weighted draw."""
    w = Window.partitionBy("node_id").orderBy("edge_id", "next_node").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node_id")
    return adj.withColumn("share", F.sum("weight").over(w) / F.sum("weight").over(whole)).select("node_id", "next_node", "edge_id", "share")
