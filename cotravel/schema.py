"""Schemas and configuration of the trajectory engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("traj_id", T.LongType()), T.StructField("snap", T.IntegerType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
CONTACT = "a long, b long, snap int"
RUN = "a long, b long, start int, n long"
NODE = "node_id int, lng double, lat double"
EDGE = "edge_id int, s_node int, e_node int, s_lng double, s_lat double, e_lng double, e_lat double, length double"

METRES_PER_DEGREE = 111111.0
MISSING = -1.0
SECONDS_PER_SNAP = 5

# City boxes as (min_lon, max_lon, min_lat, max_lat).
CITIES = {"porto": (-8.77, -8.23, 40.9, 41.5), "singapore": (103.6, 104.0, 1.22, 1.58)}


@dataclass(frozen=True)
class Config:
    """Parameters of a co-movement query; nothing here is global or mutable."""

    delta_m: float = 150.0
    k: int = 240
    total_snaps: int = 17280
    slices_per_day: int = 24
    space_parts: int = 45
    sample_step: int = 12
    grid: int = 100
    city: str = "porto"

    @property
    def delta(self) -> float:
        """Half width of the contact box in degrees."""
        return self.delta_m / METRES_PER_DEGREE

    @property
    def snaps_per_slice(self) -> int:
        return self.total_snaps // self.slices_per_day

    @property
    def box(self) -> tuple[float, float, float, float]:
        return CITIES[self.city]
