"""Partition ids in paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"day(\d+)/(?:.*/)?(?:trajectory|time|par|lookup)?(\d+)(?:/|zorder|space|_)?(\d*)[^/]*$"


def part_ids(path: str) -> tuple[int, int, int]:
    """(day, time part, space part) of ``.../day<d>/time<t>/space<s>.*`` and alike; -1 for what a path lacks."""
    day, time, space = (re.search(rf"{k}=?(\d+)", path) for k in ("day", "(?:time_part|time|par)", "(?:space_part|space|zorder)"))
    return tuple(int(m.group(1)) if m else -1 for m in (day, time, space))


def part_columns(path: Column | None = None) -> list[Column]:
    """The same as columns, from the scanned file's name unless given."""
    p = path if path is not None else F.input_file_name()
    get = lambda k, name: F.coalesce(F.nullif(F.regexp_extract(p, rf"{k}=?(\d+)", 1), F.lit("")).cast("int"), F.lit(-1)).alias(name)
    return [get("day", "day"), get("(?:time_part|time|par)", "time_part"), get("(?:space_part|space|zorder)", "space_part")]


def slice_paths(root: str, days: int, times: int, spaces: int | None = None) -> list[str]:
    """All paths of a dataset laid out by day, time part and space part."""
    out = [f"{root}/day={d}/time_part={t}" for d in range(days) for t in range(times)]
    return out if spaces is None else [f"{p}/space_part={s}" for p in out for s in range(spaces)]
