"""Hand cases and differential checks of contacts, runs, query and join."""

import random

import pytest

from cotravel.operators import cells, comovement, runs
from cotravel.plans.explain import has_quadratic_join

POINTS = "traj_id long, snap int, lon double, lat double"
STRATEGIES = ["cell", "naive", "replicated", "sliced", "sampled"]


def pair(spark, snaps, delta=0.5, extra=()):
    """Trajectory 1 stands still; 2 is in contact at ``snaps`` of 0..9 and far away else."""
    rows = [(1, s, 0.0, 0.0) for s in range(10)] + [(2, s, delta if s in snaps else 9.0, 0.0) for s in range(10)]
    return spark.createDataFrame(rows + list(extra), POINTS)


def join(df, k, strategy="cell", **kw):
    return [tuple(r) for r in comovement.subtraj_join(df, 0.5, k, strategy, **kw).collect()]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_run_of_k_and_less(spark, strategy):
    df = pair(spark, range(5))
    assert join(df, 5, strategy) == [(1, 2, 5)]
    assert join(pair(spark, range(4)), 5, strategy) == []


def test_broken_run_and_k_one(spark):
    df = pair(spark, [0, 1, 2, 3, 5, 6, 7, 8])
    assert join(df, 5) == [] and join(df, 4) == [(1, 2, 4)]
    assert join(pair(spark, [3]), 1) == [(1, 2, 1)]


def test_contact_is_inclusive_and_boxed(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 0.5, 0.5), (3, 0, 0.5000001, 0.0)], POINTS)
    assert sorted(tuple(r) for r in cells.contacts(df, 0.5).collect()) == [(1, 2, 0), (2, 3, 0)]


def test_missing_breaks_a_run(spark):
    df = spark.createDataFrame([(t, s, -1.0 if (t, s) == (2, 1) else 0.1, -1.0 if (t, s) == (2, 1) else 0.1) for t in (1, 2) for s in range(3)], POINTS)
    assert join(df, 3) == [] and join(df, 1) == [(1, 2, 1)]


def test_two_missing_points_do_not_meet(spark):
    df = spark.createDataFrame([(t, s, -1.0, -1.0) for t in (1, 2) for s in range(3)], POINTS)
    assert join(df, 1) == []


def test_middle_slice_is_stitched(spark):
    df = pair(spark, [3, 4, 5, 6, 7, 8])
    assert join(df, 6, "sliced", width=2) == [(1, 2, 6)]
    assert join(df, 6, "sliced", width=4) == [(1, 2, 6)]
    assert join(df, 7, "sliced", width=2) == []


def test_duplicates_do_not_break_a_run(spark):
    df = pair(spark, range(5), extra=[(2, 2, 0.5, 0.0)])
    assert join(df, 5) == [(1, 2, 5)]
    assert join(cells.dedupe(df), 5, "naive") == [(1, 2, 5)]


def test_query_returns_the_stored_pattern_itself(spark):
    df = pair(spark, range(5))
    got = sorted(tuple(r) for r in comovement.subtraj_query(df, [1], 0.5, 5).collect())
    assert got == [(1, 1, 10), (1, 2, 5)]
    assert comovement.subtraj_query(df, [99], 0.5, 1).collect() == []


def test_runs_across_mask_words(spark):
    hits = spark.createDataFrame([(1, s) for s in [*range(60, 70), *range(128, 200), *range(320, 330)]], "a long, snap int")
    assert [tuple(r) for r in runs.longest(hits, ["a"]).collect()] == [(1, 72)]


def test_strategies_agree_on_random_points(spark):
    rnd = random.Random(5)
    rows = [(t, s, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for t in range(25) for s in range(20) if rnd.random() < 0.9]
    df = spark.createDataFrame(rows, POINTS).cache()
    want = sorted(join(df, 2, "naive"))
    assert want
    for strategy, kw in [("cell", {}), ("cell", {"crowd": 2}), ("replicated", {}), ("sliced", {"width": 1}), ("sliced", {"width": 3}), ("sliced", {"width": 7}), ("sampled", {"step": 1}), ("sampled", {"step": 2})]:
        assert sorted(join(df, 2, strategy, **kw)) == want, (strategy, kw)


def test_monotone_in_delta_and_k(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(t, s, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for t in range(15) for s in range(10)], POINTS).cache()
    pairs = lambda d, k: {(r.a, r.b) for r in comovement.subtraj_join(df, d, k).collect()}
    assert pairs(0.3, 2) <= pairs(0.5, 2) and pairs(0.5, 3) <= pairs(0.5, 2)


def test_no_quadratic_join_in_plans(spark):
    df = pair(spark, range(5))
    assert not has_quadratic_join(comovement.subtraj_join(df, 0.5, 2))
    assert not has_quadratic_join(comovement.subtraj_query(df, [1], 0.5, 2))


def test_empty_points(spark):
    df = spark.createDataFrame([], POINTS)
    assert join(df, 1) == [] and comovement.subtraj_query(df, [1], 0.5, 1).collect() == []


def test_crowded_cells_are_split(spark):
    """One cell holds nearly all points of a snapshot; with ``crowd`` its rows are dealt over many keys."""
    rng = random.Random(2)
    df = spark.createDataFrame([(t, s, rng.random() * (0.1 if t < 60 else 5), rng.random() * (0.1 if t < 60 else 5)) for t in range(80) for s in range(2)], POINTS)
    plain = sorted(map(tuple, cells.contacts(df, 0.5).collect()))
    split = cells.contacts(df, 0.5, crowd=8)
    assert sorted(map(tuple, split.collect())) == plain == sorted(map(tuple, cells.contacts_naive(df, 0.5).collect()))
    assert "salt" in split._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" not in cells.contacts(df, 0.5)._jdf.queryExecution().optimizedPlan().toString()


def test_query_by_cells_equals_broadcast(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(t, s, rng.random() * 3, rng.random() * 3) for t in range(40) for s in range(12)], POINTS)
    pattern = df.filter("traj_id < 3").withColumnRenamed("traj_id", "query_id")
    want = sorted(map(tuple, cells.query_contacts(df, pattern, 0.6).collect()))
    assert sorted(map(tuple, cells.query_contacts(df, pattern, 0.6, broadcast_rows=1).collect())) == want and want


def test_pattern_boxes_prune_and_lose_nothing(spark):
    rows = [(0, s, 0.1 * s, 0.0) for s in range(32)] + [(1, s, 0.1 * s + 0.05, 0.01) for s in range(32)] + [(2, s, 3.0 - 0.1 * s, 0.0) for s in range(32)]
    df = spark.createDataFrame(rows, POINTS)
    patterns = df.filter("traj_id = 0").withColumnRenamed("traj_id", "query_id")
    found = comovement.pattern_boxes(patterns, 0.1, 8)
    assert len(found) == 4 and comovement.near_patterns(df.filter("traj_id = 2"), found).count() < 16
    assert len(comovement.pattern_boxes(patterns, 0.1, 1, most=5)) <= 5
    assert [tuple(r) for r in comovement.subtraj_query(df, [0], 0.1, 20, ordered=True).collect()] == [(0, 0, 32), (0, 1, 32)]


def test_pushed_boxes_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(t, s, float(t), 0.0) for t in range(50) for s in range(10)], POINTS)
    df.repartition(1).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = comovement.pattern_hits(p, [7], 0.5)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(lon,6.5)" in plan and "LessThanOrEqual(lon,7.5)" in plan


def test_ranks_within_groups_need_no_single_task(spark):
    df = spark.range(3000).selectExpr("cast(id % 3 as int) as g", "(id * 7919) % 3000 as v")
    from cotravel.operators import partitioning

    got = partitioning.ranked(df, ["v"], within="g").collect()
    for g in range(3):
        assert [r.rn for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == list(range(1, 1001))
    assert partitioning.ranked(df.filter("false"), ["v"], within="g").count() == 0


def test_stored_index_is_pruned_by_part(spark, tmp_path):
    from cotravel.operators import index

    df = spark.createDataFrame([(t, s, 0.01 * t, 0.0) for t in range(30) for s in range(16)], POINTS)
    index.write_index(df, (-1.0, 1.0, -1.0, 1.0), 10, 4, 8, str(tmp_path / "i"))
    index.write_index(df, (-1.0, 1.0, -1.0, 1.0), 10, 4, 8, str(tmp_path / "i"), day=1)
    stored, boxed = index.read_index(spark, str(tmp_path / "i"), [0, 1])
    assert stored.filter("day = 1 AND time_part = 1").inputFiles() and boxed.count() == 30 * 2 * 2
    assert "PartitionFilters: [isnotnull(time_part" in stored.filter("time_part = 1")._jdf.queryExecution().executedPlan().toString()
    assert comovement.stored_query(df, stored.filter("day = 0"), [4], (-1.0, 1.0, -1.0, 1.0), 10, 4, 0.02, 8).count() == 5
