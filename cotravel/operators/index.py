"""Sampled grid postings, their storage, and the candidate filter over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_box
from ..functions.grid import cell_range, grid_cell
from .partitioning import boxes


def postings(points: DataFrame, box: tuple[float, float, float, float], grid: int, step: int) -> DataFrame:
    """(snap, cell, ids): trajectories in each grid cell at each ``step``-th snapshot, ids ascending.

    Points outside the box aren't indexed; the upper ends of the box belong to the last cells."""
    inside = points.filter(in_box("lon", "lat", box) & (F.col("snap") % step == 0))
    return inside.groupBy("snap", grid_cell("lon", "lat", box, grid).alias("cell")).agg(F.sort_array(F.collect_set("traj_id")).alias("ids"))


def write_index(points: DataFrame, box: tuple[float, float, float, float], grid: int, step: int, width: int, path: str, day: int = 0) -> None:
    """Store the postings and the slices' boxes under ``path``, Parquet by day and time part, so that a reader of some
    days or parts lists and opens those alone. Postings of a part are sorted by snapshot and cell: statistics prune them."""
    part = F.floor(F.col("snap") / width).cast("int").alias("time_part")
    kept = postings(points, box, grid, step).select(F.lit(day).alias("day"), part, "snap", "cell", "ids")
    kept.repartitionByRange("time_part", "snap", "cell").sortWithinPartitions("time_part", "snap", "cell").write.partitionBy("day", "time_part").option("compression", "zstd").parquet(f"{path}/postings/of={day}")
    stats = boxes(points.withColumn("time_part", part), ["time_part", "traj_id"]).withColumn("day", F.lit(day))
    stats.repartitionByRange("time_part", "traj_id").sortWithinPartitions("time_part", "traj_id").write.partitionBy("day", "time_part").option("compression", "zstd").parquet(f"{path}/boxes/of={day}")


def read_index(spark: SparkSession, path: str, days: list[int]) -> tuple[DataFrame, DataFrame]:
    """(postings: day, time_part, snap, cell, ids; boxes: day, time_part, traj_id, the box, n) of the days stored."""
    part = "day int, time_part int"
    read = lambda kind, schema: spark.read.schema(f"{schema}, {part}").option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/of={d}" for d in days])
    four = "min_lon double, max_lon double, min_lat double, max_lat double"
    return read("postings", "snap int, cell int, ids array<long>"), read("boxes", f"traj_id long, {four}, n long")


def candidates(index: DataFrame, pattern: DataFrame, box: tuple[float, float, float, float], grid: int, delta: float) -> DataFrame:
    """(query_id, snap, traj_id) that share a cell with a pattern's delta box at a sampled snapshot: a superset of contacts."""
    lat = F.explode(cell_range("lat", delta, box[2], box[3], grid))
    touched = pattern.select("query_id", "snap", "lon", lat.alias("cy"))
    touched = touched.select("query_id", "snap", "cy", F.explode(cell_range("lon", delta, box[0], box[1], grid)).alias("cx"))
    cells = touched.select("query_id", "snap", (F.col("cy") * grid + F.col("cx")).cast("int").alias("cell"))
    return index.join(cells, ["snap", "cell"]).select("query_id", "snap", F.explode("ids").alias("traj_id")).distinct()


def pair_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def pair_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def pair_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def part_pairs(parted: DataFrame, how: str, x: int = 1, y: int = 2) -> DataFrame:
    """The same set operations on two sets of pairs given as bits of one table (a, b, parts) that has each pair once:
    no pair is sent anywhere."""
    has = lambda bits: F.col("parts").bitwiseAND(F.lit(bits)) != 0
    return parted.filter({"union": has(x | y), "intersect": has(x) & has(y), "except": has(x) & ~has(y)}[how]).select("a", "b")


def unordered(pairs: DataFrame, x: str = "a", y: str = "b") -> DataFrame:
    """Distinct unordered pairs a < b."""
    return pairs.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
