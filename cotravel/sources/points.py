"""Readers and writers of point tables: Parquet, text, fixed-length records, packed and compressed files."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import unpack_slices
from ..schema import POINT
from .names import part_columns, part_ids

# Big-endian records of the exchange files.
RECORD = np.dtype([("traj_id", ">i4"), ("snap", ">u2"), ("lon", ">f4"), ("lat", ">f4")])
PLACE = np.dtype([("lon", ">f4"), ("lat", ">f4")])
LOOKUP = np.dtype([("space_part", "u1"), ("space_order", ">u2")])
# The same of time parts with more space parts, or trajectories in one, than those numbers hold; their files end in WIDE.
WIDE_LOOKUP = np.dtype([("space_part", ">i4"), ("space_order", ">i4")])
WIDE = ".wide"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Points of a folder or file, partitioned or not."""
    return spark.read.schema(POINT).parquet(path).select(*POINT.names)


def read_text(spark: SparkSession, path: str, sep: str = "\t", origin: str | None = None, step_s: int = 5) -> DataFrame:
    """traj_id, time stamp, lon, lat per line; malformed lines go. With an ``origin`` (a time stamp, or a number where
    the file's times are seconds) the times become snapshots and the result is a point table."""
    rows = spark.read.csv(path, sep=sep, schema="traj_id long, time string, lon double, lat double", mode="DROPMALFORMED").filter("traj_id IS NOT NULL")
    if origin is None:
        return rows
    seconds = F.coalesce(F.expr("try_cast(time AS double)"), F.unix_timestamp(F.try_to_timestamp("time")).cast("double"))
    start = F.coalesce(F.expr(f"try_cast('{origin}' AS double)"), F.unix_timestamp(F.try_to_timestamp(F.lit(origin))).cast("double"))
    snap = F.floor((seconds - start) / step_s).cast("int")
    return rows.withColumn("snap", snap).filter("snap IS NOT NULL").select("traj_id", "snap", "lon", "lat")


def write_text(points: DataFrame, path: str, sep: str = "\t", origin: str = "0", step_s: int = 5) -> None:
    """The same lines from a point table: times are seconds from ``origin``."""
    seconds = (F.col("snap").cast("long") * step_s + F.lit(int(origin))).alias("time")
    points.select("traj_id", seconds, "lon", "lat").write.csv(path, sep=sep)


def read_timed_lines(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``time,lon,lat`` lines, one trajectory a file: (file, ordinal, time, lon, lat) in the order of the times."""
    rows = spark.read.csv(path, sep=sep, schema="time double, lon double, lat double", mode="DROPMALFORMED").withColumn("file", F.input_file_name())
    rows = rows.filter("time IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
    ordinal = (F.row_number().over(Window.partitionBy("file").orderBy("time", "lon", "lat")) - 1).alias("ordinal")
    return rows.select("file", ordinal, "time", "lon", "lat")


def read_dated_text(spark: SparkSession, path: str, origin: str, step_s: int = 5) -> DataFrame:
    """``id date time lon lat`` lines as points, snapshots counted from ``origin``; lines without five fields go."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).withColumn("f", f).filter(F.size("f") == 5)
    ts = F.to_timestamp(F.concat_ws(" ", F.col("f")[1], F.col("f")[2]))
    snap = F.floor((F.unix_timestamp(ts) - F.unix_timestamp(F.to_timestamp(F.lit(origin)))) / step_s).cast("int")
    return rows.select(F.col("f")[0].cast("long").alias("traj_id"), snap.alias("snap"), F.col("f")[3].cast("double").alias("lon"), F.col("f")[4].cast("double").alias("lat"))


def unpacked(content: bytes) -> bytes:
    """Plain, gzip or zip content; of an archive all members in order."""
    if content[:2] == b"\x1f\x8b":
        return gzip.decompress(content)
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return b"".join(z.read(n) for n in z.namelist())
    return content


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files: for packed ones, which can't be split."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_records(spark: SparkSession, path: str, packed: bool = True) -> DataFrame:
    """Fixed-length point records (14 bytes); snapshots are unsigned 16-bit.

    Packed (gzip, zip) or plain files are read whole, one at a time; plain ones alone, of any size, by splits if
    ``packed`` is false."""
    return records_of(files(spark, path)) if packed else split_records(spark, path)


def records_of(contents: DataFrame) -> DataFrame:
    """Points of the records in column content, plain, gzipped or zipped."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                a = np.frombuffer(unpacked(bytes(content)), RECORD)
                yield pd.DataFrame({"traj_id": a["traj_id"].astype("i8"), "snap": a["snap"].astype("i4"), "lon": a["lon"].astype("f8"), "lat": a["lat"].astype("f8")})

    return contents.select("content").mapInPandas(parse, POINT)


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """Plain point records: files are cut into splits at record borders and decoded by SQL functions."""
    jvm, sc = spark._jvm, spark.sparkContext
    rdd = sc._jsc.sc().binaryRecords(path, RECORD.itemsize, spark._jsc.hadoopConfiguration())
    rows = DataFrame(spark._jsparkSession.createDataset(rdd, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    whole = lambda at, n: f"cast(conv(hex(substring(value, {at}, {n})), 16, 10) as long)"
    bits = rows.select(
        F.expr(whole(1, 4)).alias("i"), F.expr(whole(5, 2)).cast("int").alias("snap"), F.expr(whole(7, 4)).alias("lon"), F.expr(whole(11, 4)).alias("lat")
    )
    return bits.select(F.expr("IF(i >= 2147483648, i - 4294967296, i)").alias("traj_id"), "snap", float_of("lon").alias("lon"), float_of("lat").alias("lat"))


def float_of(bits: str) -> Column:
    """The value of a 32-bit float given by its bits."""
    sign = f"IF({bits} >= 2147483648, -1D, 1D)"
    power, part = f"({bits} >> 23 & 255)", f"({bits} & 8388607)"
    odd = f"IF({part} = 0, {sign} * double('Infinity'), double('NaN'))"
    return F.expr(f"CASE {power} WHEN 255 THEN {odd} WHEN 0 THEN {sign} * {part} * pow(2D, -149) ELSE {sign} * ({part} + 8388608) * pow(2D, {power} - 150) END")


def read_slices(spark: SparkSession, path: str, snaps: int) -> DataFrame:
    """Space slices of (lon, lat) records (8 bytes) in files: see ``slices_of``."""
    return slices_of(files(spark, path), snaps)


def slices_of(contents: DataFrame, snaps: int) -> DataFrame:
    """(day, time_part, space_part, space_order, snap, lon, lat) of slices (path, content). Row i is the slice's
    trajectory i / snaps at snapshot i % snaps of its time part; ids are parsed from the path."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.frombuffer(unpacked(bytes(content)), PLACE)
                day, time, space = part_ids(name)
                i = np.arange(len(a))
                yield pd.DataFrame({"day": day, "time_part": time, "space_part": space, "space_order": (i // snaps).astype("i4"), "snap": (time * snaps + i % snaps).astype("i4"), "lon": a["lon"].astype("f8"), "lat": a["lat"].astype("f8")})

    return contents.select("path", "content").mapInPandas(parse, "day int, time_part int, space_part int, space_order int, snap int, lon double, lat double")


def to_slices(points: DataFrame, width: int, day: int = 0) -> DataFrame:
    """(path, content) of the slices of points (time_part, space_part, space_order, snap, lon, lat); gaps hold the missing mark."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        time, space = int(pdf["time_part"].iloc[0]), int(pdf["space_part"].iloc[0])
        a = np.full((int(pdf["space_order"].max()) + 1) * width, -1.0, np.float32).astype(">f4")
        out = np.zeros(len(a), PLACE)
        out["lon"] = out["lat"] = a
        at = pdf["space_order"].to_numpy() * width + pdf["snap"].to_numpy() - time * width
        for c in ("lon", "lat"):
            out[c][at] = pdf[c].to_numpy()
        return pd.DataFrame({"path": [f"day{day}/time{time}/space{space}"], "content": [out.tobytes()]})

    return points.groupBy("time_part", "space_part").applyInPandas(pack, "path string, content binary")


def read_packed(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Points of files of packed slices (a table of places, then codec blocks); ids are parsed from the paths."""
    parts = part_columns(F.col("path"))
    return unpack_slices(files(spark, path).select(*parts, "content"), width)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Lookup records in files: see ``lookup_of``."""
    return lookup_of(files(spark, path))


def lookup_of(contents: DataFrame) -> DataFrame:
    """(day, time_part, traj_id, space_part, space_order) of lookup records (3 bytes, or 8 in wide files), row number = traj_id."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.frombuffer(unpacked(bytes(content)), WIDE_LOOKUP if WIDE in name.rsplit("/", 1)[-1] else LOOKUP)
                day, time, _ = part_ids(name)
                yield pd.DataFrame({"day": day, "time_part": time, "traj_id": np.arange(len(a)), "space_part": a["space_part"].astype("i4"), "space_order": a["space_order"].astype("i4")})

    return contents.select("path", "content").mapInPandas(parse, "day int, time_part int, traj_id long, space_part int, space_order int")


def to_lookup(lookup: DataFrame, day: int = 0) -> DataFrame:
    """(path, content) of lookup records of each time part; trajectories without a place get the last of both numbers.
    Numbers that don't fit, or the last part, which that mark needs, make the records of a time part wide."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf["space_part"].max() >= 255 or pdf["space_order"].max() > 65535
        out = np.full(int(pdf["traj_id"].max()) + 1, 0, WIDE_LOOKUP if wide else LOOKUP)
        out["space_part"], out["space_order"] = (2**31 - 1, 2**31 - 1) if wide else (255, 65535)
        out["space_part"][pdf["traj_id"]], out["space_order"][pdf["traj_id"]] = pdf["space_part"], pdf["space_order"]
        return pd.DataFrame({"path": [f"day{day}/time{int(pdf['time_part'].iloc[0])}{WIDE if wide else ''}"], "content": [out.tobytes()]})

    return lookup.groupBy("time_part").applyInPandas(pack, "path string, content binary")


def to_records(points: DataFrame) -> DataFrame:
    """(time_part, content): the 14-byte records of each time part's rows, by trajectory and snapshot, for exchange."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["traj_id", "snap"])
        a = np.zeros(len(pdf), RECORD)
        for c in ("traj_id", "snap", "lon", "lat"):
            a[c] = pdf[c].to_numpy()
        return pd.DataFrame({"time_part": [pdf["time_part"].iloc[0]], "content": [a.tobytes()]})

    return points.groupBy("time_part").applyInPandas(pack, "time_part int, content binary")


def write_parquet(points: DataFrame, path: str, *parts: str) -> None:
    points.write.option("compression", "zstd").partitionBy(*parts).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Tab-separated metrics, one file per partition."""
    metrics.write.csv(path, sep="\t")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema)
