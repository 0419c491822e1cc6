"""The sweep of all pairs by tiles against the definition, and the queries that go by it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cotravel import catalogue
from cotravel.operators import cells, comovement, runs, tiles
from cotravel.plans.explain import physical

POINTS = "traj_id long, snap int, lon double, lat double"
K = ["a", "b"]


@pytest.fixture(scope="module", params=[0, 1])
def points(spark, request):
    """Places on a lattice, so that many differ by delta; gaps in time, absent points; repeats and NaN in the second."""
    rnd = random.Random(request.param)
    rows = [(3 * t - 40, s + 5 * (s > 11), round(rnd.uniform(-1, 1), 2 - request.param), round(rnd.uniform(-1, 1), 2)) for t in range(40) for s in range(25) if rnd.random() < 0.85]
    if request.param:
        rows += [(-40, 3, 0.1, 0.1), (-37, 3, 0.1, 0.2), (-40, 3, 0.9, 0.9), (-34, 4, float("nan"), 0.0), (-31, 4, float("inf"), 0.0), (-28, 4, float("inf"), 0.0)]
    return spark.createDataFrame(rows, POINTS).cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def wanted(h):
    part = F.when(F.col("snap") < 8, 1).when(F.col("snap") < 16, 2).otherwise(4)
    return {
        "longest": ({"k": 3}, runs.longest_by_islands(h, K, 3)), "islands": ({}, runs.islands(h, K)), "sliced": ({"width": 4}, runs.sliced(h, K, 4)),
        "stitched": ({"width": 4, "k": 3}, runs.longest_by_islands(h, K, 3)), "sampled": ({"step": 2, "need": 2, "k": 4}, runs.longest_by_islands(h, K, 4)),
        "windows": ({"step": 2, "need": 2}, runs.sampled_windows(h, K, 2, 2)), "parts": ({"cuts": [8, 16]}, h.groupBy(*K).agg(F.bit_or(part).alias("parts"))),
        "counts": ({"width": 4}, h.groupBy("a", F.floor(F.col("snap") / 4).cast("int").alias("slice")).agg(F.count("*").alias("n"))),
    }


@pytest.mark.parametrize("kind", list(tiles.SCHEMA))
def test_sweeps_equal_the_definition(spark, points, monkeypatch, kind):
    monkeypatch.setattr(tiles, "LEAST", 10)  # four blocks
    given, want = wanted(cells.contacts_naive(points, 0.5).distinct())[kind]
    got = tiles.sweep(points, 0.5, kind, **given)
    if kind == "counts":
        got = got.groupBy("a", "slice").agg(F.sum("n").alias("n"))
    assert rows(got) == rows(want) != []


def test_sweeps_of_small_parts_and_long_times(spark, monkeypatch):
    """Runs longer than a byte holds, swept a few rows at a time."""
    import numpy as np

    data = []
    for t, from_snap in ((1, 0), (2, 10), (3, 290), (4, 295)):
        data += [(t, s, 0.0 if s >= from_snap else 9.0 * t, 0.0) for s in range(600)]
    df = spark.createDataFrame(data, POINTS)
    assert rows(tiles.sweep(df, 0.1, "longest", k=300)) == [(1, 2, 590), (1, 3, 310), (1, 4, 305), (2, 3, 310), (2, 4, 305), (3, 4, 305)]
    import pandas as pd

    one = tiles._pack(pd.DataFrame(data, columns=["traj_id", "snap", "lon", "lat"]).assign(block=0))["data"][0]
    monkeypatch.setattr(tiles, "STATE", 4)
    tile = tiles.Tile(one, one, 0.1)
    found = [c for part in tile.rows() for c in tiles.longest(tile, part, 300)]
    assert len(found) == 4 and sorted(np.concatenate([c[2] for c in found]).tolist()) == [305, 305, 305, 310, 310, 590]


def test_crowded_is_counted(spark):
    near = spark.createDataFrame([(t, 0, 0.001 * t, 0.0) for t in range(300)], POINTS)
    far = spark.range(40_000).selectExpr("id AS traj_id", "0 AS snap", "cast(id % 200 AS double) AS lon", "cast(id div 200 AS double) AS lat")
    assert tiles.crowded(near, 0.5) and not tiles.crowded(far, 0.5)
    assert comovement.subtraj_join(far, 1.0, 1).count() == 2 * 199 * 200 + 2 * 199 * 199


def test_cells_give_the_same_rows(spark, points, monkeypatch):
    """The same functions where points aren't crowded."""
    one = points.dropDuplicates(["traj_id", "snap"]).cache()
    calls = [
        lambda: comovement.pair_islands(one, 0.5), lambda: comovement.pair_longest(one, 0.5, 3), lambda: comovement.pair_slices(one, 0.5, 4), lambda: comovement.pair_stitched(one, 0.5, 4, 3),
        lambda: comovement.pair_windows(one, 0.5, 2, 2), lambda: comovement.pair_parts(one, 0.5, [8, 16]), lambda: comovement.contact_counts(one, 0.5, 4).groupBy("a", "slice").agg(F.sum("n").alias("n")),
    ]
    monkeypatch.setattr(tiles, "crowded", lambda *_: True)
    swept = [rows(c()) for c in calls]
    monkeypatch.setattr(tiles, "crowded", lambda *_: False)
    assert [rows(c()) for c in calls] == swept


SWEPT = [
    "run_islands", "hit_intersect", "pair_distinct", "run_longest", "sampled_candidates", "subtraj_join_gaps", "subtraj_join_sampled", "contact_rollup", "hit_union", "run_prefix_suffix", "subtraj_join_naive", "subtraj_join_sliced", "hit_except", "run_stitched", "subtraj_join_cell", "subtraj_join_replicated",
]


@pytest.mark.parametrize("name", SWEPT)
def test_no_hit_is_sent(spark, small, name):
    """No join and no exchange above the sweep, whose rows are the pairs' results."""
    plan = physical(catalogue.QUERIES[name](spark, small))
    assert not re.search("Join|Window", plan) and "MapInArrow" in plan
    if name != "contact_rollup":
        assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_slices_of_equal_runs_follow_each_other():
    """In each lot of rows; the rows are those of the pairs, once each."""
    import numpy as np
    import pandas as pd

    rnd = np.random.default_rng(3)
    at = np.stack(np.meshgrid(np.arange(80), np.arange(8), indexing="ij"), -1).reshape(-1, 2)
    pdf = pd.DataFrame({"traj_id": at[:, 0], "snap": at[:, 1], "lon": rnd.random(len(at)), "lat": rnd.random(len(at)), "block": 0})
    data = tiles._pack(pdf)["data"].iloc[0]
    tile = tiles.Tile(data, data, 0.4)
    lots = [np.stack(x, 1).astype(int) for part in tile.rows() for x in tiles.sliced(tile, part, 4)]
    for x in lots:
        assert 1 + (np.diff(x[:, 3:], axis=0) != 0).any(axis=1).sum() == len(np.unique(x[:, 3:], axis=0)) > 5
    xy = pdf[["lon", "lat"]].to_numpy().reshape(80, 8, 2)
    met = {(a, b, s // 4) for a in range(80) for b in range(a + 1, 80) for s in range(8) if (np.abs(xy[a, s] - xy[b, s]) <= 0.4).all()}
    got = [tuple(r[:3]) for x in lots for r in x.tolist()]
    assert len(got) == len(set(got)) and set(got) == met
