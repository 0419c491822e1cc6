"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from cotravel import catalogue

SLOW = {"subtraj_join_naive", "subtraj_join_replicated"}


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in ("embeddings", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def norm(v):
    return ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["points_clean", "city_filter", "snap_convert", "subtraj_query_single", "subtraj_join_sparse", "contact_rollup", "lookup_table", "mbr_overlap", "grid_postings", "edge_spans", "resample_edges", "stored_index_query", "stored_index_boxes", "query_metrics", "metric_sums", "join_summary", "place_lists", "row_chunks", "timed_predict", "parquet_roundtrip", "records_roundtrip", "text_roundtrip", "slices_roundtrip", "packed_slices_roundtrip", "network_roundtrip", "spans_roundtrip", "walks_roundtrip", "codec_roundtrip", "stream_runs", "random_walk_checks", "subtraj_query_ordered"])
def test_query_equals_oracle(spark, small, con, name):
    df = catalogue.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    sql = f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})"
    assert got == sorted((tuple(map(norm, r)) for r in con.sql(sql).fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_stream_emits_each_run_once(spark, small):
    rows = [(r.a, r.b, r.snap) for r in catalogue.stream_runs(spark, small).collect()]
    assert len(rows) == len(set(rows))


def test_timed_streams_expire_their_state(spark, tmp_path):
    """With event times a pair's run goes on across batches, and late contacts are left out."""
    from cotravel.streaming import runs as stream

    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "a long, b long, snap int, ts timestamp"
    at = lambda rows: spark.createDataFrame(rows, "a long, b long, snap int, s long").selectExpr("a", "b", "snap", "timestamp_seconds(1000000000 + s) AS ts")
    for rows in ([(1, 2, 0, 0), (1, 2, 1, 5)], [(1, 2, 2, 10), (3, 4, 900, 4500)], [(1, 2, 3, 15), (3, 4, 901, 4505)], [(3, 4, 902, 4510)]):
        at(rows).coalesce(1).write.mode("append").parquet(src)
    got = stream.stream_runs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 3, "ts", "1 minute")
    got.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.schema("a long, b long, snap int").parquet(out).collect())) == [(1, 2, 2), (3, 4, 902)]


def test_a_call_of_the_stream_advances_many_pairs():
    """Pairs share a state; what it gives is what each pair's contacts give one after another, batch by batch."""
    import random

    import numpy as np

    from cotravel.streaming import runs as stream

    rnd, held, last, got, want = random.Random(4), np.zeros(0, stream.HELD), {}, [], []
    for batch in range(6):
        met = [(rnd.randrange(4), 10 + rnd.randrange(4), rnd.randrange(batch * 5 - 2, batch * 5 + 6)) for _ in range(70)]
        rows = np.array([(a, b, s, 0, s) for a, b, s in met], stream.HELD)
        held, out = stream.advanced(held, rows, 3)
        got += [(int(r["a"]), int(r["b"]), int(r["last"])) for r in out]
        for a, b, s in sorted(set(met)):
            before, run = last.get((a, b), (None, 0))
            if before is None or s > before:
                last[a, b] = s, run + 1 if before == s - 1 else 1
                want += [(a, b, s)] if last[a, b][1] == 3 else []
    assert sorted(got) == sorted(want) and len(want) > 20
    assert {(int(r["a"]), int(r["b"])): (int(r["last"]), int(r["run"])) for r in held} == last
    assert (held["until"] == held["last"]).all()


def test_a_stream_calls_python_by_bucket(spark, small, monkeypatch):
    """Not once a pair: there are buckets states at most."""
    from cotravel.streaming import runs as stream

    states, old = [], stream.stream_runs
    monkeypatch.setattr(stream, "stream_runs", lambda *a, **k: states.append(old(*a, **k, buckets=8)) or states[0])
    assert catalogue.stream_runs(spark, small).count() > 100
    assert "bucket" in states[0]._jdf.queryExecution().analyzed().toString()


def test_a_stream_of_crowded_points_stores_no_contacts(spark, small, con, monkeypatch):
    """Points reach the stream, contacts don't; runs that go over batches are whole, and repeats of a batch go."""
    from cotravel.operators import cells
    from cotravel.streaming import runs as stream

    sources, old = [], stream.stream_runs
    monkeypatch.setattr(stream, "stream_runs", lambda rows, *a, **k: sources.append(rows.columns) or old(rows, *a, **k))
    monkeypatch.setattr(cells, "contacts", lambda *a: 1 / 0)
    got = sorted(map(tuple, catalogue.stream_runs(spark, small).select("a", "b", "snap").collect()))
    assert sources == [["traj_id", "snap", "lon", "lat"]]
    assert got == sorted(con.sql(f"SELECT a, b, snap FROM ({catalogue.ORACLES['stream_runs']})").fetchall())


@pytest.mark.parametrize("k", [1, 3])
def test_swept_batches_give_each_run_once(k):
    """Batches of points, in pieces, with trajectories that come and go and a batch that is late: what each pair's
    contacts give one after another."""
    import random

    import numpy as np
    import pandas as pd

    from cotravel.operators import tiles
    from cotravel.streaming import runs as stream

    rnd, delta, state, got, last, want = random.Random(5), 0.3, (None, None), [], {}, []
    for batch in (0, 1, 1, 2, 4):
        points = [(t, s, rnd.random(), rnd.random()) for s in range(4 * batch, 4 * batch + 4) for t in range(30) if rnd.random() < 0.9]
        pdf = pd.DataFrame(points, columns=["traj_id", "snap", "lon", "lat"]).assign(block=0)
        side = [pdf[pdf["traj_id"] % 2 == n] for n in range(2)]
        first, second = (stream.joined([tiles._pack(x[:20])["data"].iloc[0], tiles._pack(x[20:])["data"].iloc[0]]) for x in side)
        tile = tiles.Tile(first, second, delta)
        if state[0] is not None and tile.snaps[-1] <= state[0]:
            continue
        held, found = stream.swept(tile, *state, k)
        state = int(tile.snaps[-1]), held
        got += list(map(tuple, found.itertuples(index=False)))
        for s in range(4 * batch, 4 * batch + 4):
            at = {t: (x, y) for t, u, x, y in points if u == s}
            for a in at:
                for b in at:
                    if a < b and (a + b) % 2 and all(abs(p - q) <= delta for p, q in zip(at[a], at[b])):
                        before, run = last.get((a, b), (None, 0))
                        last[a, b] = s, run + 1 if before == s - 1 else 1
                        want += [(a, b, s)] if last[a, b][1] == k else []
    assert sorted(got) == sorted(want) and len(want) > 10
    tile = tiles.Tile(first, second, delta)
    i, j, n = stream.open_runs(tile, state[1])
    ends = {p: min(run, k + 1) for p, (s, run) in last.items() if s == 19}
    assert {tuple(sorted((int(tile.ids[a]), int(tile.others[b])))): int(c) for a, b, c in zip(i, j, n)} == ends and ends
