"""Point tables and a road lattice derived from the shared test tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 points a trajectory from each embedding's pairs of components."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    p = e.withColumn("snap", F.explode(F.sequence(F.lit(0), F.lit(31))))
    at = lambda i: F.expr(f"cast(get(embedding, 2 * snap + {i}) as double)")
    return p.select(F.col("vec_id").cast("long").alias("traj_id"), "snap", at(0).alias("lon"), at(1).alias("lat"))


DENSE = """SELECT vec_id AS traj_id, CAST(s AS INTEGER) AS snap, CAST(embedding[2*s+1] AS DOUBLE) AS lon, CAST(embedding[2*s+2] AS DOUBLE) AS lat
FROM (SELECT vec_id, embedding, unnest(range(0, 32)) AS s FROM embeddings)"""


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense table with every 13th place missing (-1, -1)."""
    gone = (F.col("traj_id") + F.col("snap")) % 13 == 0
    return dense(spark, sf_dir).withColumns({c: F.when(gone, -1.0).otherwise(F.col(c)) for c in ("lon", "lat")})


GAPS = f"""SELECT traj_id, snap, CASE WHEN (traj_id + snap) % 13 = 0 THEN -1.0 ELSE lon END AS lon, CASE WHEN (traj_id + snap) % 13 = 0 THEN -1.0 ELSE lat END AS lat FROM ({DENSE})"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in 6-hour steps with places from value and props; a trajectory may have several at a snapshot."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value", "props")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").cast("long").alias("traj_id"),
        F.floor((us - F.lit(1704067200000000)) / F.lit(21600000000)).cast("int").alias("snap"),
        (103.6 + (F.col("value") % 40) / 100).cast("double").alias("lon"),
        (1.22 + (F.get_json_object("props", "$.k").cast("int") % 36) / 100).cast("double").alias("lat"),
    )


SPARSE = """SELECT CAST(user_id AS BIGINT) AS traj_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 21600000000) AS INTEGER) AS snap,
CAST(103.6 + (value % 40) / 100 AS DOUBLE) AS lon, CAST(1.22 + (CAST(json_extract_string(props, '$.k') AS INTEGER) % 36) / 100 AS DOUBLE) AS lat FROM events"""


def lattice_nodes(spark: SparkSession) -> DataFrame:
    """11 x 11 nodes, 0.1 degrees apart about the origin."""
    i = F.col("id").cast("int")
    return spark.range(121).select(i.alias("node_id"), (F.lit(-0.5) + 0.1 * (i % 11)).alias("lng"), (F.lit(-0.5) + 0.1 * F.floor(i / 11)).alias("lat"))


NODES = "SELECT CAST(i AS INTEGER) AS node_id, CAST(-0.5 + CAST(0.1 AS DOUBLE) * (i % 11) AS DOUBLE) AS lng, CAST(-0.5 + CAST(0.1 AS DOUBLE) * (i // 11) AS DOUBLE) AS lat FROM range(121) t(i)"


def lattice_pairs(spark: SparkSession) -> DataFrame:
    """220 edges (edge_id, s_node, e_node) right and up."""
    n = spark.range(121).select(F.col("id").cast("int").alias("n"))
    right = n.filter("n % 11 < 10").select((2 * F.col("n")).alias("edge_id"), F.col("n").alias("s_node"), (F.col("n") + 1).alias("e_node"))
    up = n.filter("n < 110").select((2 * F.col("n") + 1).alias("edge_id"), F.col("n").alias("s_node"), (F.col("n") + 11).alias("e_node"))
    return right.unionByName(up)


PAIRS = """SELECT CAST(2*i AS INTEGER) AS edge_id, CAST(i AS INTEGER) AS s_node, CAST(i+1 AS INTEGER) AS e_node FROM range(121) t(i) WHERE i % 11 < 10
UNION ALL SELECT CAST(2*i+1 AS INTEGER), CAST(i AS INTEGER), CAST(i+11 AS INTEGER) FROM range(121) t(i) WHERE i < 110"""


def lattice_edges(spark: SparkSession) -> DataFrame:
    from ..operators.network import flat_lengths, with_endpoints

    return flat_lengths(with_endpoints(lattice_pairs(spark), lattice_nodes(spark)))


EDGES = f"""SELECT e.edge_id, e.s_node, e.e_node, s.lng AS s_lng, s.lat AS s_lat, d.lng AS e_lng, d.lat AS e_lat, (s.lng + d.lng) / 2 AS c_lng, (s.lat + d.lat) / 2 AS c_lat,
111111.0 * sqrt(pow((d.lng - s.lng) * cos(radians((s.lat + d.lat) / 2)), 2) + pow(d.lat - s.lat, 2)) AS length
FROM ({PAIRS}) e JOIN ({NODES}) s ON e.s_node = s.node_id JOIN ({NODES}) d ON e.e_node = d.node_id"""
