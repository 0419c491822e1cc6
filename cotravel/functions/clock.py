"""Snapshots and times of day as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SECONDS_PER_SNAP
from .geo import col


def time_to_snap(time, step: int = SECONDS_PER_SNAP) -> Column:
    """HH:MM:SS to the snapshot of the day."""
    p = F.split(col(time), ":")
    return ((p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")) / step).cast("int")


def snap_to_time(snap, step: int = SECONDS_PER_SNAP) -> Column:
    s = col(snap).cast("int") * step
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), s % 60)


def elapsed_snaps(ts, origin, step: int = SECONDS_PER_SNAP) -> Column:
    """Whole steps from one timestamp to another."""
    return F.floor((F.unix_timestamp(col(ts)) - F.unix_timestamp(col(origin))) / step).cast("int")


def minute_part(time, parts: int) -> Column:
    """Which of ``parts`` equal parts of the day a HH:MM:SS lies in."""
    p = F.split(col(time), ":")
    return F.floor((p[0].cast("int") * 60 + p[1].cast("int")) / F.ceil(F.lit(1439) / parts)).cast("int")


def days_since(date, origin: str = "2015-04-01") -> Column:
    return F.datediff(F.to_date(col(date)), F.to_date(F.lit(origin)))


def unwrap_u16(x) -> Column:
    """A signed 16-bit number read as unsigned."""
    return (col(x) + 65536) % 65536
