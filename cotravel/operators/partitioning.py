"""Time slices, z-order slices, lookup tables and slice statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import boxes_meet, haversine
from ..functions.grid import z_value
from ..plans.paths import scratch


def time_slices(points: DataFrame, width: int) -> DataFrame:
    return points.withColumn("time_part", F.floor(F.col("snap") / width).cast("int"))


def z_ordered(points: DataFrame, keys: list[str], cell_m: float = 100.0) -> DataFrame:
    """Adds z, the Morton code of (lon, lat), to one row per ``keys``.

    The grid has the least power of two of cells a side that is more than the extent in cells of ``cell_m`` metres;
    the extent is the greatest of the box's four sides. Its four bounds are all that reaches the driver."""
    b = points.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    sides = b.withColumn("d", F.greatest(
        haversine("x1", "y1", "x0", "y1"), haversine("x1", "y0", "x0", "y0"), haversine("x1", "y1", "x1", "y0"), haversine("x0", "y1", "x0", "y0")
    )).first()
    if sides.x0 is None:
        return points.withColumn("z", F.lit(0).cast("long"))
    order, n = 1, -(-sides.d // cell_m)
    while 2**order <= n:
        order += 1
    size = 2**order
    ix = F.floor((F.col("lon") - sides.x0) / ((sides.x1 - sides.x0 + 0.001) / size))
    iy = F.floor((F.col("lat") - sides.y0) / ((sides.y1 - sides.y0 + 0.001) / size))
    return points.withColumn("z", z_value(ix, iy, order))


def ranked(df: DataFrame, order: list[str], rank: str = "rn", within: str | None = None) -> DataFrame:
    """A dense row number from 1 by ``order``, over all rows or over those of equal ``within``, without sorting any
    group in one task.

    Rows are range-partitioned by (within, order) and written once to the shared folder with their partition and place,
    so that the places counted and the places joined are the same whatever is retried or re-planned. A part is numbered
    on its own and shifted by the sizes of those before it; there are few sizes (partitions, and ``within`` values that
    begin or end there), so they are broadcast."""
    spark, by = df.sparkSession, [within, *order] if within else order
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    path = scratch(spark, "ranked")
    placed.write.parquet(path)
    r = spark.read.schema(placed.schema).parquet(path)
    keys = [within] if within else []
    sizes = r.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_part")
    shift = sizes.select("_part", *keys, "_first", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    # the id counts up from partition << 33 in the order of the rows, so differences are places
    return r.join(F.broadcast(shift), ["_part", *keys]).withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first") + 1).select(*df.columns, rank)


def space_slices(points: DataFrame, width: int, size: int) -> DataFrame:
    """Lookup table (time_part, traj_id, space_part, space_order): in each time slice the trajectories by the z-order
    of their first point, cut into parts of ``size``. A slice's trajectories are ranked over many tasks."""
    first = time_slices(points, width).groupBy("time_part", "traj_id").agg(F.min_by(F.struct("lon", "lat"), "snap").alias("p")).select("time_part", "traj_id", "p.lon", "p.lat")
    z = ranked(z_ordered(first, ["time_part", "traj_id"]).select("time_part", "traj_id", "z"), ["z", "traj_id"], within="time_part")
    at = F.col("rn") - 1
    return z.select("time_part", "traj_id", F.floor(at / size).cast("int").alias("space_part"), (at % size).cast("int").alias("space_order"))


def chunks(df: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Rows with the number of their chunk: ``size`` rows each by ``order``, for files of bounded length."""
    return ranked(df, order, "_rn").withColumn(name, F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")


def with_lookup(points: DataFrame, lookup: DataFrame, width: int) -> DataFrame:
    return time_slices(points, width).join(lookup, ["time_part", "traj_id"])


def write_sliced(points: DataFrame, lookup: DataFrame, width: int, path: str) -> None:
    """Parquet by time_part, rows of a space part together and in z-order, so that file and page statistics prune."""
    rows = with_lookup(points, lookup, width)
    (
        rows.repartitionByRange("time_part", "space_part").sortWithinPartitions("time_part", "space_part", "space_order", "snap")
        .write.partitionBy("time_part").option("compression", "zstd").parquet(path)
    )


def boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box and number of points by ``keys``."""
    return points.groupBy(*keys).agg(
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.count("*").alias("n")
    )


def meeting_boxes(a: DataFrame, b: DataFrame, on: list[str], delta: float) -> DataFrame:
    """Rows of ``a`` whose box, grown by delta, meets one of ``b``'s boxes with equal ``on``."""
    renamed = b.select(*[F.col(k) for k in on], *[F.col(c).alias("o_" + c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")])
    mine = a.select(*[F.col(c).alias("t_" + c) if c in ("min_lon", "max_lon", "min_lat", "max_lat") else F.col(c) for c in a.columns])
    kept = mine.join(renamed, on).filter(boxes_meet("t_", "o_", delta)).drop(*[c for c in renamed.columns if c not in on]).distinct()
    return kept.select(*[F.col("t_" + c).alias(c) if c in ("min_lon", "max_lon", "min_lat", "max_lat") else F.col(c) for c in a.columns])


def pruned_points(points: DataFrame, stats: DataFrame, pattern: DataFrame, on: list[str], delta: float) -> DataFrame:
    """Points of the slices that can hold a contact with the pattern."""
    return points.join(meeting_boxes(stats, boxes(pattern, on[:1]), on[:1], delta).select(*on).distinct(), on, "left_semi")
