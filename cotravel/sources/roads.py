"""Readers and writers of road networks, taxi logs, match results and travel-time files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_nodes(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """node, lng, lat."""
    return spark.read.csv(path, header=header, schema="node_id int, lng double, lat double")


def read_edges(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """edge, s_node, e_node, s_lng, s_lat, e_lng, e_lat, c_lng, c_lat."""
    cols = "edge_id int, s_node int, e_node int, " + ", ".join(f"{p}_{c} double" for p in "sec" for c in ("lng", "lat"))
    return spark.read.csv(path, header=header, schema=cols)


def read_network(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """section_id, s_node, e_node, length."""
    return spark.read.csv(path, header=header, schema="section_id int, s_node int, e_node int, length double")


def read_raw_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="TRAJ_ID long, LON double, LAT double").toDF("traj_id", "lon", "lat")


def read_taxi_logs(spark: SparkSession, path: str, prefix: int = 5) -> DataFrame:
    """Comma lines with a prefixed id, then lat, lon, ..., date, time: (traj_id, lon, lat, ts)."""
    f = F.split("value", ",")
    rows = spark.read.text(path).withColumn("f", f).filter(F.size("f") >= 6)
    get = lambda i: F.col("f")[i]
    return rows.select(
        F.substring(get(0), prefix + 1, 1 << 20).cast("long").alias("traj_id"), get(2).cast("double").alias("lon"), get(1).cast("double").alias("lat"),
        F.to_timestamp(F.concat_ws(" ", get(4), get(5))).alias("ts"),
    )


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """TRAJ_ID, MATCHED_EDGE, MATCHED_NODE with list literals (-1 on failure): (traj_id, ordinal, edge_id)."""
    rows = spark.read.csv(path, header=True, schema="TRAJ_ID long, MATCHED_EDGE string, MATCHED_NODE string", quote='"')
    edges = F.from_json(F.when(F.col("MATCHED_EDGE").startswith("["), F.col("MATCHED_EDGE")).otherwise(F.lit("[]")), "array<int>")
    return rows.select(F.col("TRAJ_ID").alias("traj_id"), F.posexplode(edges).alias("ordinal", "edge_id"))


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Ragged ``edge,t1,t2,...`` lines: (edge_id, span_s)."""
    f = F.filter(F.split("value", ","), lambda x: F.trim(x) != "")
    rows = spark.read.text(path).withColumn("f", f).filter(F.size("f") > 1)
    rows = rows.select(F.col("f")[0].cast("int").alias("edge_id"), F.explode(F.expr("slice(f, 2, size(f) - 1)")).alias("t"))
    return rows.select("edge_id", F.trim("t").cast("long").alias("span_s"))


def write_spans(spans: DataFrame, path: str) -> None:
    """``edge,t1,t2,...`` lines, one an edge, the times ascending."""
    lists = spans.groupBy("edge_id").agg(F.sort_array(F.collect_list("span_s")).alias("t"))
    lists.select(F.concat_ws(",", F.col("edge_id").cast("string"), F.transform("t", lambda x: x.cast("string"))).alias("value")).write.text(path)


def read_walk(spark: SparkSession, path: str) -> DataFrame:
    """``edge,travelTime`` lines of walks, one file each, in the order of the file: (file, ordinal, edge_id, travel_time)."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("ordinal", "line"))
    f = F.split("line", ",")
    return rows.select("file", "ordinal", f[0].cast("int").alias("edge_id"), f[1].cast("double").alias("travel_time"))


def write_walks(walks: DataFrame, path: str) -> None:
    """A file for each walk (walk_id, ordinal, edge_id, travel_time), its ``edge,travelTime`` lines in order."""
    line = F.struct("ordinal", F.concat_ws(",", F.col("edge_id").cast("string"), F.col("travel_time").cast("string")).alias("line"))
    texts = walks.groupBy("walk_id").agg(F.array_join(F.sort_array(F.collect_list(line)).getField("line"), "\n").alias("value"))
    texts.write.partitionBy("walk_id").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)
