"""Grid cells, z-order and the sampled-bit helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

GUARD = 1e-9  # cells are this much wider than delta, so rounding can't put two points at delta two cells apart


def cell(x, width: float) -> Column:
    return F.floor(col(x) / (width * (1 + GUARD)))


def box_cell(x, low: float, high: float, n: int) -> Column:
    """Cell number 0..n-1 of a bounded axis; values outside, and the upper end itself, go to the nearest cell."""
    return F.least(F.greatest(F.floor((col(x) - low) / ((high - low) / n)), F.lit(0)), F.lit(n - 1)).cast("int")


def grid_cell(lon, lat, box: tuple[float, float, float, float], n: int) -> Column:
    return (box_cell(lat, box[2], box[3], n) * n + box_cell(lon, box[0], box[1], n)).cast("int")


def cell_range(x, delta: float, low: float, high: float, n: int) -> Column:
    """All cells that x - delta .. x + delta touches, as an array."""
    return F.sequence(box_cell(col(x) - delta, low, high, n), box_cell(col(x) + delta, low, high, n))


def z_value(ix: Column, iy: Column, order: int) -> Column:
    """Morton code: bits of iy at even places, of ix at odd places."""
    out = F.lit(0).cast("long")
    for j in range(order):
        out = out + F.shiftleft(F.shiftright(iy.cast("long"), j).bitwiseAND(F.lit(1)), 2 * j)
        out = out + F.shiftleft(F.shiftright(ix.cast("long"), j).bitwiseAND(F.lit(1)), 2 * j + 1)
    return out
