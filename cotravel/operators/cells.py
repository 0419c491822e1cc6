"""Contact joins: box predicates turned into equi-joins on (snapshot, cell)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_contact, present
from ..functions.grid import cell

# Half of the eight neighbour cells, so that each unordered pair of cells meets once.
FORWARD = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
CROWD = 20_000  # points of a cell at one snapshot beyond which it is split
HEAVY = 1_000_000  # crowded cells that may be broadcast; beyond, they are joined
AROUND = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]


def clean(points: DataFrame) -> DataFrame:
    """Points without missing marks. (traj_id, snap) is the key of a point table; see ``dedupe`` where it isn't."""
    return points.filter(present())


def dedupe(points: DataFrame) -> DataFrame:
    """One point per trajectory and snapshot: the greatest lon and the greatest lat. Costs a shuffle of the points."""
    return points.groupBy("traj_id", "snap").agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"))


def crowded(keyed: DataFrame, crowd: int) -> DataFrame:
    """(snap, cx, cy, parts) of cells with more than ``crowd`` points. There are at most points / crowd of them."""
    return keyed.groupBy("snap", "cx", "cy").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("snap", "cx", "cy", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))


def contacts(points: DataFrame, delta: float, crowd: int = CROWD) -> DataFrame:
    """All contacts (a, b, snap), a < b, of clean points.

    Each point is keyed by its cell; the copies for the five forward cells meet it there, so a point is sent to
    six places instead of being compared with all. Cells with more than ``crowd`` points are split: their left rows
    are dealt over parts and the right rows copied to each part. Which cells these are is counted first (the counts
    combine before the shuffle); without any, nothing is salted.
    """
    keyed = points.select("traj_id", "snap", "lon", "lat", cell("lon", delta).alias("cx"), cell("lat", delta).alias("cy"))
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in FORWARD])
    right = keyed.withColumn("s", F.explode(steps)).select(
        F.col("traj_id").alias("r_id"), F.col("snap"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"),
        (F.col("cx") - F.col("s.x")).alias("cx"), (F.col("cy") - F.col("s.y")).alias("cy"),
        ((F.col("s.x") == 0) & (F.col("s.y") == 0)).alias("same"),
    )
    left, on = keyed, ["snap", "cx", "cy"]
    heavy = crowded(keyed, crowd)
    if n := heavy.limit(HEAVY + 1).count():
        heavy = F.broadcast(heavy) if n <= HEAVY else heavy
        parts = F.coalesce("parts", F.lit(1))
        left = left.join(heavy, on, "left").withColumn("salt", F.pmod(F.xxhash64("traj_id"), parts).cast("int")).drop("parts")
        right = right.join(heavy, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        on = [*on, "salt"]
    met = left.join(right, on).filter(in_contact("lon", "lat", "r_lon", "r_lat", delta) & (~F.col("same") | (F.col("traj_id") < F.col("r_id"))))
    return met.filter("traj_id <> r_id").select(F.least("traj_id", "r_id").alias("a"), F.greatest("traj_id", "r_id").alias("b"), "snap")


def contacts_naive(points: DataFrame, delta: float) -> DataFrame:
    """The definition itself: equi-join on the snapshot alone. For tests and small inputs."""
    l, r = points.alias("l"), points.alias("r")
    met = l.join(r, (F.col("l.snap") == F.col("r.snap")) & (F.col("l.traj_id") < F.col("r.traj_id")) & in_contact("l.lon", "l.lat", "r.lon", "r.lat", delta))
    return met.select(F.col("l.traj_id").alias("a"), F.col("r.traj_id").alias("b"), F.col("l.snap").alias("snap"))


def contacts_replicated(points: DataFrame, delta: float) -> DataFrame:
    """Replicate-and-probe form: copies of each point in all cells that its box touches, probed by every point's own cell."""
    keyed = points.select("traj_id", "snap", "lon", "lat", cell("lon", delta).alias("cx"), cell("lat", delta).alias("cy"))
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in AROUND])
    built = keyed.withColumn("s", F.explode(steps)).select(
        F.col("traj_id").alias("r_id"), "snap", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), (F.col("cx") + F.col("s.x")).alias("cx"), (F.col("cy") + F.col("s.y")).alias("cy")
    )
    met = keyed.join(built, ["snap", "cx", "cy"]).filter((F.col("traj_id") < F.col("r_id")) & in_contact("lon", "lat", "r_lon", "r_lat", delta))
    return met.select(F.col("traj_id").alias("a"), F.col("r_id").alias("b"), "snap")


def query_contacts(points: DataFrame, patterns: DataFrame, delta: float, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Contacts (query_id, traj_id, snap) of stored points with pattern points (query_id, snap, lon, lat).

    Patterns are the query set. They are broadcast while their number of points, which is counted, is at most
    ``broadcast_rows``; beyond that the join is by cell, like the self-join. A pattern matches itself if stored.
    """
    p = patterns.select("query_id", F.col("snap").alias("p_snap"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    if p.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = points.join(F.broadcast(p), (F.col("snap") == F.col("p_snap")) & in_contact("lon", "lat", "p_lon", "p_lat", delta))
    else:
        keyed = points.withColumns({"cx": cell("lon", delta), "cy": cell("lat", delta)})
        steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in AROUND])
        q = p.withColumn("s", F.explode(steps)).withColumns({"cx": cell("p_lon", delta) + F.col("s.x"), "cy": cell("p_lat", delta) + F.col("s.y")}).withColumnRenamed("p_snap", "snap")
        met = keyed.join(q, ["snap", "cx", "cy"]).filter(in_contact("lon", "lat", "p_lon", "p_lat", delta))
    return met.select("query_id", "traj_id", "snap")
