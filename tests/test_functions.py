"""Codec, z-order, clock and sources."""

import gzip
import struct

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotravel.functions import clock, codec, grid
from cotravel.operators import matching, network, partitioning
from cotravel.sources import fixtures, names, points, roads


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False), max_size=40))
def test_codec_is_lossless(values):
    x = np.array(values, np.float32)
    got, n = codec.decode_axis(block := codec.encode_axis(x))
    assert n == len(block) and np.array_equal(got.view(np.uint32), x.view(np.uint32))


def test_codec_error_bound():
    x = (-8.6 + np.random.default_rng(1).normal(0, 0.1, 200).cumsum() / 10).astype(np.float32)
    lon, lat = codec.decode(codec.encode(x, x, 0.01))
    assert np.abs(lon - x).max() <= 0.01 and len(codec.encode(x, x, 0.01)) < len(codec.encode(x, x))


def test_z_value_is_one_to_one(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    got = {r.z: (r.x, r.y) for r in df.withColumn("z", grid.z_value(F.col("x"), F.col("y"), 3)).collect()}
    assert sorted(got) == list(range(64)) and got[1] == (0, 1) and got[2] == (1, 0)


def test_rank_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.rn == r.v + 1 for r in partitioning.ranked(df, ["v"]).collect())


def test_clock(spark):
    df = spark.createDataFrame([("01:02:13", 17279)], "t string, s int")
    r = df.select(clock.time_to_snap("t").alias("a"), clock.snap_to_time("s").alias("b"), clock.minute_part("t", 24).alias("c"), clock.unwrap_u16(F.lit(-1)).alias("d")).first()
    assert tuple(r) == (746, "23:59:55", 1, 65535)


def test_record_files(spark, tmp_path):
    data = b"".join(struct.pack(">iHff", 3, s, 1.5, 2.5) for s in (0, 40000))
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(gzip.compress(data))
    got = sorted(tuple(r) for r in points.read_records(spark, str(tmp_path)).collect())
    assert got == sorted([(3, 0, 1.5, 2.5), (3, 40000, 1.5, 2.5)] * 2)
    part = points.read_records(spark, str(tmp_path / "a.bin")).withColumn("time_part", F.lit(0))
    assert bytes(points.to_records(part).first().content) == data


def test_text_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("7 2015-04-01 00:00:10 1.0 2.0\nbad line\n")
    assert [tuple(r) for r in points.read_dated_text(spark, str(tmp_path / "p.txt"), "2015-04-01 00:00:00").collect()] == [(7, 2, 1.0, 2.0)]
    (tmp_path / "s.txt").write_text("5,10,20,\n6,\n")
    assert sorted(tuple(r) for r in roads.read_spans(spark, str(tmp_path / "s.txt")).collect()) == [(5, 10), (5, 20)]
    (tmp_path / "m.csv").write_text('TRAJ_ID,MATCHED_EDGE,MATCHED_NODE\n1,"[4, 5]","[1, 2]"\n2,-1,-1\n')
    assert sorted(tuple(r) for r in roads.read_matches(spark, str(tmp_path / "m.csv")).collect()) == [(1, 0, 4), (1, 1, 5)]


def test_split_records_equal_whole_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    bits = np.r_[0, 1, 0x7F7FFFFF, 0x80000000, 0x80000001, 0x7F800000, 0xFF800000, 0x3F800000, rng.integers(0, 1 << 32, 3000)].astype(np.uint32)
    bits = bits[~np.isnan(bits.view(np.float32))]
    a = np.zeros(len(bits), points.RECORD)
    a["traj_id"], a["snap"], a["lon"], a["lat"] = rng.integers(-(1 << 31), 1 << 31, len(bits)), rng.integers(0, 1 << 16, len(bits)), bits.view(np.float32), bits[::-1].view(np.float32)
    (tmp_path / "a.bin").write_bytes(a.tobytes())
    split = points.read_records(spark, str(tmp_path), packed=False)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, points.read_records(spark, str(tmp_path)).collect())) and split.schema.simpleString() == points.read_records(spark, str(tmp_path)).schema.simpleString()


def test_slices_and_lookup_files(spark, tmp_path):
    rows = [(0, 1, o, s, 0.5 * o, 0.25 * s) for o in range(3) for s in range(4)] + [(1, 0, 0, s, 9.0, 8.0) for s in (4, 6)]
    df = spark.createDataFrame(rows, "time_part int, space_part int, space_order int, snap int, lon double, lat double")
    key = lambda r: (r.time_part, r.space_part, r.space_order, r.snap, r.lon, r.lat)
    for kind, made, read in (("raw", points.to_slices(df, 4), points.read_slices), ("packed", codec.pack_slices(df, 4), points.read_packed)):
        for r in made.collect():
            name = r.path if kind == "raw" else f"day0/time{r.time_part}/space{r.space_part}"
            path = tmp_path / kind / f"{name}.bin"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(bytes(r.content))
        got = read(spark, str(tmp_path / kind / "day0/*"), 4).filter("lon <> -1")
        assert sorted(map(key, got.collect())) == sorted(rows)
    few = codec.unpack_slices(codec.pack_slices(df, 4), 4, [2]).collect()
    assert sorted(map(key, few)) == sorted(r for r in rows if r[2] == 2)
    lookup = spark.createDataFrame([(0, 4, 2, 300), (0, 0, 7, 1), (1, 2, 1, 65534)], "time_part int, traj_id long, space_part int, space_order int")
    for r in points.to_lookup(lookup).collect():
        path = tmp_path / "l" / f"{r.path}.bin"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(bytes(r.content))
    got = points.read_lookup(spark, str(tmp_path / "l/day0")).filter("space_order <> 65535")
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 7, 1), (0, 0, 4, 2, 300), (0, 1, 2, 1, 65534)]


def test_text_points_become_a_point_table(spark, tmp_path):
    (tmp_path / "p.txt").write_text("7\t2015-04-01 00:00:10\t1.0\t2.0\nbad\n8\t2015-04-01 00:01:00\t3.0\t4.0\n9\tnever\t1.0\t1.0\n")
    got = points.read_text(spark, str(tmp_path / "p.txt"), origin="2015-04-01 00:00:00")
    assert sorted(map(tuple, got.collect())) == [(7, 2, 1.0, 2.0), (8, 12, 3.0, 4.0)] and got.columns == ["traj_id", "snap", "lon", "lat"]
    (tmp_path / "t.csv").write_text("5,1.0,2.0\n0,0.5,0.5\nx,1,1\n")
    assert [tuple(r)[1:] for r in points.read_timed_lines(spark, str(tmp_path / "t.csv")).collect()] == [(0, 0.0, 0.5, 0.5), (1, 5.0, 1.0, 2.0)]


def test_road_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("node,lng,lat\n1,0.5,0.25\n")
    assert [tuple(r) for r in roads.read_nodes(spark, str(tmp_path / "n.csv")).collect()] == [(1, 0.5, 0.25)]
    (tmp_path / "e.csv").write_text("edge,s_node,e_node,s_lng,s_lat,e_lng,e_lat,c_lng,c_lat\n1,2,3,0,0,1,1,0.5,0.5\n")
    assert tuple(roads.read_edges(spark, str(tmp_path / "e.csv")).first()) == (1, 2, 3, 0.0, 0.0, 1.0, 1.0, 0.5, 0.5)
    (tmp_path / "w.csv").write_text("section_id,s_node,e_node,length\n1,2,3,10.5\n")
    assert tuple(roads.read_network(spark, str(tmp_path / "w.csv")).first()) == (1, 2, 3, 10.5)
    (tmp_path / "r.csv").write_text("TRAJ_ID,LON,LAT\n4,1.0,2.0\n")
    assert tuple(roads.read_raw_trajectories(spark, str(tmp_path / "r.csv")).first()) == (4, 1.0, 2.0)
    (tmp_path / "x.txt").write_text("taxi_12,1.5,103.5,0,2015-04-01,00:00:10\nshort,1\n")
    row = roads.read_taxi_logs(spark, str(tmp_path / "x.txt")).first()
    assert (row.traj_id, row.lon, row.lat, str(row.ts)) == (12, 103.5, 1.5, "2015-04-01 00:00:10")
    (tmp_path / "walk.txt").write_text("4,1.5\n6,2.0\n4,1.0\n")
    got = roads.read_walk(spark, str(tmp_path / "walk.txt")).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.ordinal)] == [(0, 4, 1.5), (1, 6, 2.0), (2, 4, 1.0)]


def test_codec_with_times():
    rng = np.random.default_rng(9)
    t = np.cumsum(rng.integers(1, 5, 300)).astype(np.float32)
    lon, lat = (103.6 + 0.001 * t).astype(np.float32), (1.2 + 0.0005 * t).astype(np.float32)
    back = codec.decode_timed(codec.encode(lon, lat, 0.0, t))
    assert all(np.array_equal(a, b) for a, b in zip(back, (t, lon, lat)))
    assert len(codec.encode(lon, lat, 0.0, t)) - len(codec.encode_axis(t)) < len(codec.encode(lon, lat))


def test_geodesic_lengths(spark):
    # fixed values: a degree of the equator and of a meridian from it, on the WGS-84 ellipsoid, and a long way
    got = network.geodesic_metres([0, 0, 5.0], [0, 0, 5.0], [1, 0, 5.0], [0, 1, 5.0])
    assert np.allclose(got, [111319.4908, 110574.3886, 0], atol=1e-3)
    e = fixtures.lattice_edges(spark)
    near = network.geodesic_lengths(e).join(network.lengths(e).withColumnRenamed("length", "round"), "section_id")
    assert all(abs(r.length / r.round - 1) < 0.01 for r in near.collect())


def test_viterbi_equals_all_paths(spark):
    import itertools
    import math

    edges = fixtures.lattice_edges(spark).toPandas()
    rng, way = np.random.default_rng(3), matching.Roads(edges)
    for _ in range(6):
        layers = []
        for k in range(4):
            place = rng.uniform(-0.4, 0.4, 2)
            layers.append([(place[0], place[1], int(e), float(rng.uniform(1, 60)), None if rng.random() < 0.5 else int(edges.loc[edges.edge_id == e, "e_node"].iloc[0])) for e in rng.choice(edges.edge_id, 3, replace=False)])

        def worth(path):
            total = 0.0
            for p, q in zip(path, path[1:]):
                d = way.way(p, q)
                v = 0.0 if d is None else 1.0 if d == 0 else matching._metres(p[0], p[1], q[0], q[1]) / d
                total += v * math.exp(-q[3] ** 2 / 800) / (math.sqrt(2 * math.pi) * 20)
            return total

        assert math.isclose(worth(matching.viterbi(layers, way)), max(map(worth, itertools.product(*layers))), rel_tol=1e-12)


def test_ways_have_no_bound_unless_asked(spark):
    edges = fixtures.lattice_edges(spark).toPandas()
    assert matching.Roads(edges).distance(0, 120) > 200_000 and matching.Roads(edges, 20_000.0).distance(0, 120) is None
    assert matching.Roads(edges).distance(120, 0) is None


def test_offline_flow(spark):
    """Match, stays, mean times and counts, walks, samples, slices: one chain from points to a sliced point table."""
    edges = fixtures.lattice_edges(spark)
    pts = spark.createDataFrame([(t, s, -0.5 + 0.02 * s, -0.4995 + 0.1 * t) for t in range(3) for s in range(20)], "traj_id long, snap int, lon double, lat double")
    matched = matching.map_match(pts, edges, lon_reach=0.06, lat_reach=0.06, radius_m=500.0)
    visited = network.nearest_edge(pts, matched.filter("edge_id >= 0").select("traj_id", "ordinal", "edge_id"), edges)
    times = network.edge_mean_time(network.edge_spans(visited.select("traj_id", (F.col("snap") * 5).alias("t"), "edge_id")))
    counts = network.edge_counts(visited)
    adj = network.adjacency(edges).join(counts, "edge_id", "left").withColumn("weight", F.coalesce(F.col("n"), F.lit(1)).cast("double")).drop("n", "n_after_first")
    starts = spark.createDataFrame([(1, 0), (2, 60)], "walk_id long, node_id int")
    walks = matching.random_walks(starts, adj, 60, 600.0, seed=5)
    samples = network.resample(walks.select(F.col("walk_id").alias("path_id"), "ordinal", "edge_id"), edges, times, 600.0)
    table = network.to_snaps(samples)
    lookup = partitioning.space_slices(table, 16, 1)
    rows = partitioning.with_lookup(table, lookup, 16)
    assert rows.count() == table.count() > 60 and {r.traj_id for r in rows.select("traj_id").distinct().collect()} == {1, 2}
    assert times.count() > 0 and {tuple(r) for r in lookup.select("time_part", "space_order").collect()} == {(t, 0) for t in range(-(-table.groupBy("traj_id").count().agg(F.max("count")).first()[0] // 16))}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from cotravel.plans import paths

    off = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            paths.shared_dir(SimpleNamespace(conf=off, sparkContext=SimpleNamespace(master=master)))
    path = paths.scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    paths.remove(spark, path)
    assert not list((__import__("pathlib").Path(path.removeprefix("file://")).parent).glob("gone-*"))


def test_part_ids():
    assert names.part_ids("/x/day2/time13/space4.tstjs") == (2, 13, 4)


def test_matching_follows_the_road(spark):
    edges = fixtures.lattice_edges(spark)
    rows = [(1, s, -0.5 + 0.02 * s + 0.001, -0.4995) for s in range(10)] + [(2, 0, 5.0, 5.0), (2, 1, 5.1, 5.0)]
    pts = spark.createDataFrame(rows, "traj_id long, snap int, lon double, lat double")
    got = matching.map_match(pts, edges, lon_reach=0.06, lat_reach=0.06, radius_m=500.0).collect()
    assert [r.edge_id for r in sorted(got, key=lambda r: r.ordinal) if r.traj_id == 1] == [0] * 5 + [2] * 5
    assert [(r.edge_id, r.node_id) for r in got if r.traj_id == 2] == [(-1, -1)]


def test_walks_repeat_and_do_not_turn_back(spark):
    adj = network.adjacency(fixtures.lattice_edges(spark))
    starts = spark.createDataFrame([(1, 0), (2, 60)], "walk_id long, node_id int")
    a = sorted(tuple(r) for r in matching.random_walks(starts, adj, 50, 600.0, seed=3).collect())
    assert a == sorted(tuple(r) for r in matching.random_walks(starts, adj, 50, 600.0, seed=3).collect())
    for w in (1, 2):
        path = [r[2] for r in a if r[0] == w]
        assert all(x != y for x, y in zip(path, path[1:])) and all(r[4] for r in a)


def test_lookup_records_hold_many_space_parts(spark):
    """More parts than a byte counts, and more trajectories in a part than two bytes; the first time part stays short."""
    from cotravel.sources import points

    rows = [(0, t, t, 1) for t in range(255)] + [(1, t, t, t % 7) for t in range(300)] + [(2, 5, 0, 70_000)]
    lookup = spark.createDataFrame(rows, "time_part int, traj_id long, space_part int, space_order int")
    stored = points.to_lookup(lookup)
    got = points.lookup_of(stored).filter("space_order NOT IN (65535, 2147483647)").select(lookup.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert {r.path: len(r.content) for r in stored.collect()} == {"day0/time0": 255 * 3, "day0/time1.wide": 300 * 8, "day0/time2.wide": 6 * 8}
