"""Registered queries over the fixtures and their SQL oracles.

Each query runs an operator of the library on whole tables; each oracle states the same relation without cells,
masks or slices. Map matching and random walks have no oracle; what holds of every walk has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import clock, codec, geo
from .operators import cells, comovement, index, matching, network, partitioning, tiles
from .plans.explain import timed
from .plans.paths import remove, scratch
from .sources import fixtures as fx
from .sources import points as pts
from .sources import roads
from .streaming import runs as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BOX = (-0.5, 0.5, -0.5, 0.5)
DELTA, K, PATTERN = 0.2, 6, 7


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def hits_sql(points: str, delta: float) -> str:
    return f"""pts AS ({points}), h AS (SELECT l.traj_id AS a, r.traj_id AS b, l.snap FROM pts l JOIN pts r ON l.snap = r.snap AND l.traj_id < r.traj_id
AND abs(l.lon - r.lon) <= {delta} AND abs(l.lat - r.lat) <= {delta})"""


def islands_sql(keys: str, hits: str = "h") -> str:
    return f"""g AS (SELECT {keys}, snap, snap - row_number() OVER (PARTITION BY {keys} ORDER BY snap) AS g FROM {hits}),
i AS (SELECT {keys}, g, min(snap) AS start, count(*) AS n FROM g GROUP BY {keys}, g)"""


def join_sql(points: str, delta: float, k: int) -> str:
    return f"WITH {hits_sql(points, delta)}, {islands_sql('a, b')} SELECT a, b, max(n) AS best FROM i GROUP BY a, b HAVING max(n) >= {k}"


def query_sql(ids: str, delta: float, k: int) -> str:
    return f"""WITH pts AS ({fx.DENSE}), h AS (SELECT q.traj_id AS query_id, p.traj_id, p.snap FROM pts p JOIN pts q ON p.snap = q.snap AND q.traj_id IN ({ids})
AND abs(p.lon - q.lon) <= {delta} AND abs(p.lat - q.lat) <= {delta}), {islands_sql('query_id, traj_id')}
SELECT query_id, traj_id, max(n) AS best FROM i GROUP BY query_id, traj_id HAVING max(n) >= {k}"""


PRESENT = f"SELECT * FROM ({fx.GAPS}) WHERE abs(lon + 1) > 1e-6 AND abs(lat + 1) > 1e-6"
SPARSE_ONE = f"SELECT traj_id, snap, max(lon) AS lon, max(lat) AS lat FROM ({fx.SPARSE}) GROUP BY traj_id, snap"


# --- scans, projections, predicates ---------------------------------------------------------------------------------


@register("points_scan", fx.DENSE)
def points_scan(spark, sf):
    return fx.dense(spark, sf)


@register("points_clean", PRESENT)
def points_clean(spark, sf):
    return cells.clean(fx.with_gaps(spark, sf))


@register("points_sparse", SPARSE_ONE)
def points_sparse(spark, sf):
    return cells.dedupe(fx.sparse(spark, sf))


@register("city_filter", f"SELECT traj_id, snap, lon, lat FROM ({fx.SPARSE}) WHERE lon BETWEEN 103.65 AND 103.9 AND lat BETWEEN 1.25 AND 1.5")
def city_filter(spark, sf):
    return fx.sparse(spark, sf).filter(geo.in_box("lon", "lat", (103.65, 103.9, 1.25, 1.5)))


@register("snap_convert", """SELECT event_id, CAST(epoch_us(ts) // 1000000 % 86400 // 5 AS INTEGER) AS day_snap,
CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 5) AS INTEGER) AS snap FROM events""")
def snap_convert(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("event_id", clock.time_to_snap(F.date_format("t", "HH:mm:ss")).alias("day_snap"), clock.elapsed_snaps("t", F.timestamp_seconds(F.lit(1704067200))).alias("snap"))


@register("snap_to_time", f"""SELECT traj_id, snap, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS time
FROM (SELECT traj_id, snap, CAST((snap * 531 + traj_id) % 17280 * 5 AS INTEGER) AS s FROM ({fx.DENSE}))""")
def snap_to_time(spark, sf):
    p = fx.dense(spark, sf).withColumn("s", ((F.col("snap") * 531 + F.col("traj_id")) % 17280).cast("int"))
    return p.select("traj_id", "snap", clock.snap_to_time("s").alias("time"))


# --- contacts, runs, queries and joins ------------------------------------------------------------------------------


@register("contact_pairs", f"WITH {hits_sql(fx.DENSE, 0.05)} SELECT a, b, snap FROM h")
def contact_pairs(spark, sf):
    return cells.contacts(cells.clean(fx.dense(spark, sf)), 0.05)


@register("contact_pairs_salted", f"WITH {hits_sql(SPARSE_ONE, 0.02)} SELECT a, b, snap FROM h")
def contact_pairs_salted(spark, sf):
    return cells.contacts(cells.dedupe(fx.sparse(spark, sf)), 0.02, crowd=4)


@register("subtraj_query_single", query_sql(str(PATTERN), DELTA, K))
def subtraj_query_single(spark, sf):
    return comovement.subtraj_query(fx.dense(spark, sf), [PATTERN], DELTA, K)


@register("subtraj_query_multi", query_sql("0,1,2,3,4,5,6,7,8,9", 0.15, 5))
def subtraj_query_multi(spark, sf):
    return comovement.subtraj_query(fx.dense(spark, sf), list(range(10)), 0.15, 5)


@register("sampled_prefilter", query_sql(str(PATTERN), DELTA, 8))
def sampled_prefilter(spark, sf):
    return comovement.subtraj_query(fx.dense(spark, sf), [PATTERN], DELTA, 8, prefilter_step=2)


JOIN = join_sql(fx.DENSE, 0.1, 4)


@register("subtraj_join_cell", JOIN)
def subtraj_join_cell(spark, sf):
    return comovement.subtraj_join(fx.dense(spark, sf), 0.1, 4)


@register("subtraj_join_naive", JOIN)
def subtraj_join_naive(spark, sf):
    return comovement.subtraj_join(fx.dense(spark, sf), 0.1, 4, "naive")


@register("subtraj_join_replicated", JOIN)
def subtraj_join_replicated(spark, sf):
    return comovement.subtraj_join(fx.dense(spark, sf), 0.1, 4, "replicated")


@register("subtraj_join_sliced", JOIN)
def subtraj_join_sliced(spark, sf):
    return comovement.subtraj_join(fx.dense(spark, sf), 0.1, 4, "sliced", width=3)


@register("subtraj_join_sampled", JOIN)
def subtraj_join_sampled(spark, sf):
    return comovement.subtraj_join(fx.dense(spark, sf), 0.1, 4, "sampled", step=2)


@register("subtraj_join_gaps", join_sql(PRESENT, 0.15, 5))
def subtraj_join_gaps(spark, sf):
    return comovement.subtraj_join(fx.with_gaps(spark, sf), 0.15, 5)


@register("subtraj_join_sparse", join_sql(SPARSE_ONE, 0.1, 2))
def subtraj_join_sparse(spark, sf):
    return comovement.subtraj_join(cells.dedupe(fx.sparse(spark, sf)), 0.1, 2)


@register("run_islands", f"WITH {hits_sql(fx.DENSE, 0.05)}, {islands_sql('a, b')} SELECT a, b, CAST(start AS INTEGER) AS start, n FROM i")
def run_islands(spark, sf):
    return comovement.pair_islands(fx.dense(spark, sf), 0.05)


@register("run_longest", f"WITH {hits_sql(fx.DENSE, 0.05)}, {islands_sql('a, b')} SELECT a, b, max(n) AS best FROM i GROUP BY a, b HAVING max(n) >= 2")
def run_longest(spark, sf):
    return comovement.pair_longest(fx.dense(spark, sf), 0.05, 2)


SLICED = f"""WITH {hits_sql(fx.DENSE, 0.1)}, s AS (SELECT *, CAST(snap // 4 AS INTEGER) AS slice FROM h), {islands_sql('a, b, slice', 's')}
SELECT a, b, slice, max(n) AS max_run, coalesce(max(CASE WHEN start = slice * 4 THEN n END), 0) AS prefix_run,
coalesce(max(CASE WHEN start + n - 1 = slice * 4 + 3 THEN n END), 0) AS suffix_run FROM i GROUP BY a, b, slice"""


@register("run_prefix_suffix", SLICED)
def run_prefix_suffix(spark, sf):
    return comovement.pair_slices(fx.dense(spark, sf), 0.1, 4)


@register("run_stitched", join_sql(fx.DENSE, 0.15, 5))
def run_stitched(spark, sf):
    return comovement.pair_stitched(fx.dense(spark, sf), 0.15, 4, 5)


@register("sampled_candidates", f"""WITH {hits_sql(fx.DENSE, 0.15)}, s AS (SELECT a, b, snap // 2 AS j FROM h WHERE snap % 2 = 0),
w AS (SELECT a, b, count(*) OVER (PARTITION BY a, b ORDER BY j RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS c FROM s) SELECT DISTINCT a, b FROM w WHERE c = 2""")
def sampled_candidates(spark, sf):
    return comovement.pair_windows(fx.dense(spark, sf), 0.15, 2, 2)


@register("contact_rollup", f"""WITH {hits_sql(fx.DENSE, 0.1)} SELECT CAST(snap // 16 AS INTEGER) AS day, CAST(snap // 4 AS INTEGER) AS slice, count(*) AS n,
count(DISTINCT a) AS n_first FROM h GROUP BY ROLLUP (snap // 16, snap // 4)""")
def contact_rollup(spark, sf):
    s = comovement.contact_counts(fx.dense(spark, sf), 0.1, 4).withColumn("day", F.floor(F.col("slice") / 4).cast("int"))
    return s.rollup("day", "slice").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.countDistinct("a").alias("n_first"))


# --- slices, z-order, boxes, postings -------------------------------------------------------------------------------


@register("time_slices", f"SELECT CAST(snap // 8 AS INTEGER) AS time_part, count(*) AS n, count(DISTINCT traj_id) AS trajectories FROM ({fx.DENSE}) GROUP BY 1")
def time_slices(spark, sf):
    return partitioning.time_slices(fx.dense(spark, sf), 8).groupBy("time_part").agg(F.count("*").alias("n"), F.countDistinct("traj_id").alias("trajectories"))


def hav_sql(x1: str, y1: str, x2: str, y2: str, r: str) -> str:
    return f"2 * {r} * 1000 * asin(least(1.0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


Z = f"""WITH f AS (SELECT CAST(snap // 16 AS INTEGER) AS time_part, traj_id, arg_min(lon, snap) AS lon, arg_min(lat, snap) AS lat FROM ({fx.DENSE}) GROUP BY 1, 2),
b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM f),
d AS (SELECT *, greatest({hav_sql('x1', 'y1', 'x0', 'y1', '6378.137')}, {hav_sql('x1', 'y0', 'x0', 'y0', '6378.137')}, {hav_sql('x1', 'y1', 'x1', 'y0', '6378.137')}, {hav_sql('x0', 'y1', 'x0', 'y0', '6378.137')}) AS side FROM b),
o AS (SELECT *, (SELECT min(k) FROM range(1, 31) t(k) WHERE pow(2, k) > ceil(side / 100.0)) AS bits FROM d),
c AS (SELECT f.*, CAST(floor((lon - x0) / ((x1 - x0 + 0.001) / pow(2, bits))) AS BIGINT) AS ix, CAST(floor((lat - y0) / ((y1 - y0 + 0.001) / pow(2, bits))) AS BIGINT) AS iy FROM f, o),
z AS (SELECT time_part, traj_id, CAST((SELECT sum((((iy >> j) & 1) << (2 * j)) + (((ix >> j) & 1) << (2 * j + 1))) FROM range(0, 30) t(j)) AS BIGINT) AS z FROM c)"""


@register("zorder_values", Z + " SELECT * FROM z")
def zorder_values(spark, sf):
    first = partitioning.time_slices(fx.dense(spark, sf), 16).groupBy("time_part", "traj_id").agg(F.min_by(F.struct("lon", "lat"), "snap").alias("p")).select("time_part", "traj_id", "p.*")
    return partitioning.z_ordered(first, ["time_part", "traj_id"]).select("time_part", "traj_id", "z")


@register("lookup_table", Z + """, r AS (SELECT *, row_number() OVER (PARTITION BY time_part ORDER BY z, traj_id) - 1 AS rn FROM z)
SELECT time_part, traj_id, CAST(rn // 100 AS INTEGER) AS space_part, CAST(rn % 100 AS INTEGER) AS space_order FROM r""")
def lookup_table(spark, sf):
    return partitioning.space_slices(fx.dense(spark, sf), 16, 100)


@register("zorder_slices", Z + """, r AS (SELECT *, row_number() OVER (PARTITION BY time_part ORDER BY z, traj_id) - 1 AS rn FROM z), p AS (""" + fx.DENSE + """)
SELECT r.time_part, CAST(rn // 100 AS INTEGER) AS space_part, count(*) AS n, min(p.lon) AS min_lon, max(p.lon) AS max_lon FROM r JOIN p ON p.traj_id = r.traj_id AND p.snap // 16 = r.time_part GROUP BY 1, 2""")
def zorder_slices(spark, sf):
    p = fx.dense(spark, sf)
    rows = partitioning.with_lookup(p, partitioning.space_slices(p, 16, 100), 16)
    return rows.groupBy("time_part", "space_part").agg(F.count("*").alias("n"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


@register("global_rank", f"SELECT traj_id, snap, row_number() OVER (ORDER BY lon, lat, traj_id, snap) AS rn FROM ({fx.DENSE})")
def global_rank(spark, sf):
    return partitioning.ranked(fx.dense(spark, sf), ["lon", "lat", "traj_id", "snap"]).select("traj_id", "snap", "rn")


BOXES = f"SELECT CAST(snap // 4 AS INTEGER) AS time_part, traj_id, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat, count(*) AS n FROM ({fx.DENSE}) GROUP BY 1, 2"


def _boxes(spark, sf):
    return partitioning.boxes(partitioning.time_slices(fx.dense(spark, sf), 4), ["time_part", "traj_id"])


@register("part_mbr", f"SELECT *, (max_lon - min_lon) * (max_lat - min_lat) AS area FROM ({BOXES})")
def part_mbr(spark, sf):
    return _boxes(spark, sf).withColumn("area", geo.box_measures()["area"])


@register("mbr_overlap", f"""WITH b AS ({BOXES}) SELECT t.time_part, t.traj_id FROM b t JOIN b o ON o.time_part = t.time_part AND o.traj_id = {PATTERN}
AND t.min_lon - 0.05 <= o.max_lon AND t.max_lon + 0.05 >= o.min_lon AND t.min_lat - 0.05 <= o.max_lat AND t.max_lat + 0.05 >= o.min_lat""")
def mbr_overlap(spark, sf):
    b = _boxes(spark, sf)
    return partitioning.meeting_boxes(b, b.filter(F.col("traj_id") == PATTERN), ["time_part"], 0.05).select("time_part", "traj_id")


@register("mbr_prune", f"""WITH pts AS ({fx.DENSE}), b AS ({BOXES}), k AS (SELECT t.time_part, t.traj_id FROM b t JOIN b o ON o.time_part = t.time_part AND o.traj_id = {PATTERN}
AND t.min_lon - 0.05 <= o.max_lon AND t.max_lon + 0.05 >= o.min_lon AND t.min_lat - 0.05 <= o.max_lat AND t.max_lat + 0.05 >= o.min_lat)
SELECT k.time_part, count(*) AS n FROM pts p JOIN k ON k.traj_id = p.traj_id AND k.time_part = p.snap // 4 GROUP BY 1""")
def mbr_prune(spark, sf):
    p = partitioning.time_slices(fx.dense(spark, sf), 4)
    kept = partitioning.pruned_points(p, _boxes(spark, sf), p.filter(F.col("traj_id") == PATTERN), ["time_part", "traj_id"], 0.05)
    return kept.groupBy("time_part").agg(F.count("*").alias("n"))


CELL = "CAST(least(greatest(floor((lat + 0.5) / 0.1), 0), 9) * 10 + least(greatest(floor((lon + 0.5) / 0.1), 0), 9) AS INTEGER)"


@register("grid_postings", f"""SELECT snap, {CELL} AS cell, string_agg(CAST(traj_id AS VARCHAR), ',' ORDER BY traj_id) AS ids FROM ({fx.DENSE})
WHERE lon BETWEEN -0.5 AND 0.5 AND lat BETWEEN -0.5 AND 0.5 AND snap % 12 = 0 GROUP BY 1, 2""")
def grid_postings(spark, sf):
    return index.postings(fx.dense(spark, sf), BOX, 10, 12).withColumn("ids", F.array_join("ids", ","))


@register("index_candidates", f"""WITH pts AS ({fx.DENSE}), c AS (SELECT traj_id, snap, least(greatest(floor((lat + 0.5) / 0.1), 0), 9) AS y, least(greatest(floor((lon + 0.5) / 0.1), 0), 9) AS x FROM pts
WHERE lon BETWEEN -0.5 AND 0.5 AND lat BETWEEN -0.5 AND 0.5 AND snap % 12 = 0),
q AS (SELECT snap, least(greatest(floor((lat - 0.05 + 0.5) / 0.1), 0), 9) AS y0, least(greatest(floor((lat + 0.05 + 0.5) / 0.1), 0), 9) AS y1,
least(greatest(floor((lon - 0.05 + 0.5) / 0.1), 0), 9) AS x0, least(greatest(floor((lon + 0.05 + 0.5) / 0.1), 0), 9) AS x1 FROM pts WHERE traj_id = {PATTERN})
SELECT DISTINCT CAST({PATTERN} AS BIGINT) AS query_id, c.snap, c.traj_id FROM c JOIN q ON c.snap = q.snap AND c.y BETWEEN q.y0 AND q.y1 AND c.x BETWEEN q.x0 AND q.x1""")
def index_candidates(spark, sf):
    p = fx.dense(spark, sf)
    pattern = p.filter(F.col("traj_id") == PATTERN).withColumnRenamed("traj_id", "query_id")
    return index.candidates(index.postings(p, BOX, 10, 12), pattern, BOX, 10, 0.05)


# --- set operations -------------------------------------------------------------------------------------------------


def _two(spark, sf):
    """Pairs that meet before snapshot 16 (bit 1) and from it on (bit 2)."""
    return comovement.pair_parts(fx.dense(spark, sf), 0.1, [16])


TWO = f"WITH {hits_sql(fx.DENSE, 0.1)}, x AS (SELECT DISTINCT a, b FROM h WHERE snap < 16), y AS (SELECT DISTINCT a, b FROM h WHERE snap >= 16)"


@register("hit_union", TWO + " SELECT * FROM x UNION SELECT * FROM y")
def hit_union(spark, sf):
    return index.part_pairs(_two(spark, sf), "union")


@register("hit_intersect", TWO + " SELECT * FROM x INTERSECT SELECT * FROM y")
def hit_intersect(spark, sf):
    return index.part_pairs(_two(spark, sf), "intersect")


@register("hit_except", TWO + " SELECT * FROM x EXCEPT SELECT * FROM y")
def hit_except(spark, sf):
    return index.part_pairs(_two(spark, sf), "except")


@register("pair_distinct", f"WITH {hits_sql(fx.DENSE, 0.1)} SELECT DISTINCT a, b FROM h")
def pair_distinct(spark, sf):
    return comovement.pair_parts(fx.dense(spark, sf), 0.1, []).select("a", "b")


# --- scalar functions -----------------------------------------------------------------------------------------------


def _distance(name: str, sql: str, column: Callable[[], object]) -> None:
    @register(name, f"SELECT traj_id, snap, round({sql}, 6) AS d FROM ({fx.DENSE})")
    def q(spark, sf):
        return fx.dense(spark, sf).select("traj_id", "snap", F.round(column(), 6).alias("d"))


_distance("haversine_r6378", hav_sql("lon", "lat", "0.1", "0.2", "6378.137"), lambda: geo.haversine("lon", "lat", 0.1, 0.2))
_distance("haversine_r6367", hav_sql("lon", "lat", "0.1", "0.2", "6367.0"), lambda: geo.haversine("lon", "lat", 0.1, 0.2, 6367.0))
_distance("haversine_r6371", hav_sql("lon", "lat", "0.1", "0.2", "6371.0"), lambda: geo.haversine_atan2("lon", "lat", 0.1, 0.2))
_distance("equirect_dist", "111111.0 * sqrt(pow((lon - 0.1) * cos(radians(lat)), 2) + pow(lat - 0.2, 2))", lambda: geo.equirectangular(F.col("lon") - 0.1, F.col("lat") - 0.2, "lat"))
_distance("euclid_dist", "111111.0 * sqrt(pow(lon - 0.1, 2) + pow(lat - 0.2, 2))", lambda: geo.euclid_metres(F.col("lon") - 0.1, F.col("lat") - 0.2))
_distance("line_dist", "abs(0.3 * (lon + 0.1) - 0.4 * (lat + 0.1)) / sqrt(0.3 * 0.3 + 0.4 * 0.4)", lambda: geo.line_distance("lon", "lat", -0.1, -0.1, 0.3, 0.2))
_distance("observation_prob", "exp(-(lon * 100) * (lon * 100) / 800.0) / (sqrt(2 * pi()) * 20.0)", lambda: geo.observation(F.col("lon") * 100))


@register("linear_predict", f"""SELECT traj_id, snap, lon_hat, lat_hat, lon - lon_hat AS lon_err, lat - lat_hat AS lat_err FROM (SELECT *,
CASE WHEN lag(lon, 2) OVER w IS NOT NULL THEN 2 * lag(lon, 1) OVER w - lag(lon, 2) OVER w ELSE coalesce(lag(lon, 1) OVER w, 0.0) END AS lon_hat,
CASE WHEN lag(lat, 2) OVER w IS NOT NULL THEN 2 * lag(lat, 1) OVER w - lag(lat, 2) OVER w ELSE coalesce(lag(lat, 1) OVER w, 0.0) END AS lat_hat
FROM ({fx.DENSE}) WINDOW w AS (PARTITION BY traj_id ORDER BY snap))""")
def linear_predict(spark, sf):
    return codec.linear_residuals(fx.dense(spark, sf))


# --- road network ---------------------------------------------------------------------------------------------------


@register("edge_endpoints", f"SELECT edge_id, s_node, e_node, s_lng, s_lat, e_lng, e_lat FROM ({fx.EDGES})")
def edge_endpoints(spark, sf):
    return fx.lattice_edges(spark).select("edge_id", "s_node", "e_node", "s_lng", "s_lat", "e_lng", "e_lat")


@register("edge_midpoints", f"SELECT edge_id, c_lng, c_lat, round(length, 6) AS length FROM ({fx.EDGES})")
def edge_midpoints(spark, sf):
    return fx.lattice_edges(spark).select("edge_id", "c_lng", "c_lat", F.round("length", 6).alias("length"))


@register("edge_lengths", f"SELECT edge_id AS section_id, s_node, e_node, round({hav_sql('s_lng', 's_lat', 'e_lng', 'e_lat', '6378.137')}, 6) AS length FROM ({fx.EDGES})")
def edge_lengths(spark, sf):
    return network.lengths(fx.lattice_edges(spark)).withColumn("length", F.round("length", 6))


@register("edge_node_ids", f"SELECT edge_id, s_node, e_node FROM ({fx.EDGES})")
def edge_node_ids(spark, sf):
    bare = fx.lattice_edges(spark).select("edge_id", "s_lng", "s_lat", "e_lng", "e_lat")
    return network.node_ids(bare, fx.lattice_nodes(spark)).select("edge_id", "s_node", "e_node")


@register("edge_undirected", f"SELECT edge_id, s_node, e_node FROM ({fx.EDGES})")
def edge_undirected(spark, sf):
    e = fx.lattice_pairs(spark)
    back = e.select((F.col("edge_id") + 1000).alias("edge_id"), F.col("e_node").alias("s_node"), F.col("s_node").alias("e_node"))
    return network.undirected(e.unionByName(back))


@register("edge_adjacency", f"""WITH e AS ({fx.EDGES}), b AS (SELECT s_node AS node_id, e_node AS next_node, edge_id, length FROM e UNION ALL SELECT e_node, s_node, edge_id, length FROM e)
SELECT node_id, next_node, edge_id, CAST(1.0 AS DOUBLE) AS weight, round(length / 16.0, 6) AS travel_time FROM b""")
def edge_adjacency(spark, sf):
    return network.adjacency(fx.lattice_edges(spark)).select("node_id", "next_node", "edge_id", "weight", F.round("travel_time", 6).alias("travel_time"))


@register("weight_shares", f"""WITH e AS ({fx.EDGES}), b AS (SELECT s_node AS node_id, e_node AS next_node, edge_id FROM e UNION ALL SELECT e_node, s_node, edge_id FROM e)
SELECT node_id, next_node, edge_id, round(CAST(row_number() OVER (PARTITION BY node_id ORDER BY edge_id, next_node) AS DOUBLE) / count(*) OVER (PARTITION BY node_id), 9) AS share FROM b""")
def weight_shares(spark, sf):
    return network.weight_shares(network.adjacency(fx.lattice_edges(spark))).withColumn("share", F.round("share", 9))


REACH = dict(lon_reach=0.03, lat_reach=0.03, radius_m=2500.0)


def _hv(p: str, q: str) -> str:
    x = {"p": ("lon", "lat"), "s": ("s_lng", "s_lat"), "e": ("e_lng", "e_lat")}
    return hav_sql(*x[p], *x[q], "6367.0")


CANDIDATES = f"""WITH m AS (SELECT p.traj_id, p.snap, p.lon, p.lat, e.*, {_hv('p', 's')} AS a, {_hv('p', 'e')} AS b, {_hv('s', 'e')} AS c FROM ({fx.DENSE}) p JOIN ({fx.EDGES}) e ON
(abs(lon - s_lng) <= 0.03 AND abs(lat - s_lat) <= 0.03) OR (abs(lon - e_lng) <= 0.03 AND abs(lat - e_lat) <= 0.03) OR (abs(lon - c_lng) <= 0.03 AND abs(lat - c_lat) <= 0.03)),
d AS (SELECT *, CASE WHEN a*a > b*b + c*c THEN b WHEN b*b > a*a + c*c THEN a ELSE 2 * sqrt(((a+b+c)/2) * abs((a+b+c)/2 - a) * abs((a+b+c)/2 - b) * abs((a+b+c)/2 - c)) / c END AS dist,
CASE WHEN a*a > b*b + c*c THEN e_node WHEN b*b > a*a + c*c THEN s_node END AS node_id FROM m)
SELECT traj_id, snap, edge_id, CAST(round(dist) AS INTEGER) AS dist_m, node_id FROM d WHERE dist <= 2500"""


@register("match_candidates", CANDIDATES)
def match_candidates(spark, sf):
    return network.match_candidates(fx.dense(spark, sf), fx.lattice_edges(spark), **REACH).drop("lon", "lat")


MATCHED = "SELECT t.traj_id, j.j AS ordinal, CAST((t.traj_id * 7 + j.j * 31) % 220 AS INTEGER) AS edge_id FROM (SELECT DISTINCT traj_id FROM pts) t, range(0, 8) j(j)"
REAL = "SELECT * FROM e"
NEAREST = f"""pts AS ({fx.DENSE}), e AS ({fx.EDGES}), k AS (SELECT edge_id, row_number() OVER (ORDER BY edge_id) - 1 AS r FROM e),
mt AS (SELECT t.traj_id, j.j AS ordinal, k.edge_id FROM (SELECT DISTINCT traj_id FROM pts) t CROSS JOIN range(0, 8) j(j) JOIN k ON k.r = (t.traj_id * 7 + j.j * 31) % 220),
dd AS (SELECT p.traj_id, p.snap, mt.ordinal, mt.edge_id, abs((e_lat - s_lat) * (lon - s_lng) + (s_lng - e_lng) * (lat - s_lat)) / sqrt((e_lat - s_lat) * (e_lat - s_lat) + (s_lng - e_lng) * (s_lng - e_lng)) AS d
FROM pts p JOIN mt ON p.traj_id = mt.traj_id JOIN e ON e.edge_id = mt.edge_id),
nr AS (SELECT traj_id, snap, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, snap ORDER BY d, ordinal) AS rn FROM dd) WHERE rn = 1)"""


def _nearest(spark, sf):
    p, e = fx.dense(spark, sf), fx.lattice_edges(spark)
    ids = fx.lattice_pairs(spark).select("edge_id", (F.floor(F.col("edge_id") / 2)).alias("n"), (F.col("edge_id") % 2).alias("up"))
    # rank of an edge id among the 220: rights before node n, plus ups before it
    before_right = F.col("n") - F.floor(F.col("n") / 11)
    r = ids.select("edge_id", (before_right + F.least(F.col("n"), F.lit(110)) + F.when((F.col("up") == 1) & (F.col("n") % 11 < 10), 1).otherwise(0)).cast("long").alias("r"))
    t = p.select("traj_id").distinct().select("traj_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ordinal"))
    matched = t.withColumn("r", ((F.col("traj_id") * 7 + F.col("ordinal") * 31) % 220).cast("long")).join(r, "r").select("traj_id", "ordinal", "edge_id")
    return network.nearest_edge(p, matched, e)


@register("nearest_edge", f"WITH {NEAREST} SELECT traj_id, snap, edge_id FROM nr")
def nearest_edge(spark, sf):
    return _nearest(spark, sf)


SPANS = NEAREST + """, fl AS (SELECT *, CASE WHEN edge_id = lag(edge_id) OVER (PARTITION BY traj_id ORDER BY snap) THEN 0 ELSE 1 END AS new FROM nr),
gr AS (SELECT *, sum(new) OVER (PARTITION BY traj_id ORDER BY snap ROWS UNBOUNDED PRECEDING) AS g FROM fl),
sp AS (SELECT traj_id, edge_id, CAST((max(snap) - min(snap)) * 5 AS BIGINT) AS span_s FROM gr GROUP BY traj_id, g, edge_id HAVING max(snap) > min(snap))"""


def _spans(spark, sf):
    return network.edge_spans(_nearest(spark, sf).select("traj_id", (F.col("snap") * 5).alias("t"), "edge_id"))


@register("edge_spans", f"WITH {SPANS} SELECT * FROM sp")
def edge_spans(spark, sf):
    return _spans(spark, sf)


@register("edge_mean_time", f"WITH {SPANS} SELECT edge_id, avg(span_s) AS mean_s FROM sp GROUP BY edge_id")
def edge_mean_time(spark, sf):
    return network.edge_mean_time(_spans(spark, sf))


@register("edge_counts", f"WITH {NEAREST} SELECT edge_id, count(*) AS n, count(*) - 1 AS n_after_first FROM nr GROUP BY edge_id")
def edge_counts(spark, sf):
    return network.edge_counts(_nearest(spark, sf))


PATHS = "SELECT CAST(p AS INTEGER) AS path_id, CAST(j AS INTEGER) AS ordinal, CAST(2 * (11 * p + j) AS INTEGER) AS edge_id FROM range(11) a(p), range(10) b(j)"


def _paths(spark):
    """A walk along each row of the lattice."""
    return spark.range(110).select(F.floor(F.col("id") / 10).cast("int").alias("path_id"), (F.col("id") % 10).cast("int").alias("ordinal")).withColumn("edge_id", (2 * (11 * F.col("path_id") + F.col("ordinal"))).cast("int"))


@register("path_length", f"SELECT path_id, round(sum(length), 5) AS length FROM ({PATHS}) p JOIN ({fx.EDGES}) e USING (edge_id) GROUP BY path_id")
def path_length(spark, sf):
    return network.path_length(_paths(spark), fx.lattice_edges(spark)).withColumn("length", F.round("length", 5))


@register("resample_edges", f"""WITH o AS (SELECT path_id, ordinal, s_lng, s_lat, e_lng, e_lat, 600.0 / (length / 16.0) AS share FROM ({PATHS}) p JOIN ({fx.EDGES}) e USING (edge_id)),
n AS (SELECT *, CAST(greatest(ceil(1 / share), 1) AS INTEGER) AS n FROM o),
s AS (SELECT path_id, ordinal, CAST(unnest(range(0, n)) AS INTEGER) AS j, s_lng, s_lat, e_lng, e_lat, share FROM n)
SELECT path_id, ordinal, j, round(s_lng + (e_lng - s_lng) * share * j, 9) AS lon, round(s_lat + (e_lat - s_lat) * share * j, 9) AS lat FROM s
UNION ALL SELECT path_id, ordinal, n, round(e_lng, 9), round(e_lat, 9) FROM n WHERE ordinal = 9""")
def resample_edges(spark, sf):
    s = network.resample(_paths(spark), fx.lattice_edges(spark), step_s=600.0)
    return s.select("path_id", "ordinal", "j", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


# --- queries by a stored index, metrics -------------------------------------------------------------------------------


@register("subtraj_query_ordered", query_sql("3,1,2", 0.2, 6) + " ORDER BY query_id, traj_id")
def subtraj_query_ordered(spark, sf):
    return comovement.subtraj_query(fx.dense(spark, sf), [3, 1, 2], 0.2, 6, ordered=True)


WIDE = (-1.0, 1.0, -1.0, 1.0)  # holds all fixture points


@register("stored_index_query", query_sql(str(PATTERN), DELTA, 8))
def stored_index_query(spark, sf):
    p, path = fx.dense(spark, sf), scratch(spark, "index")
    index.write_index(p, WIDE, 20, 4, 8, path)
    return comovement.stored_query(p, index.read_index(spark, path, [0])[0], [PATTERN], WIDE, 20, 4, DELTA, 8)


@register("stored_index_boxes", f"SELECT 0 AS day, time_part, traj_id, min_lon, max_lon, min_lat, max_lat, n FROM ({BOXES}) WHERE time_part IN (1, 2)")
def stored_index_boxes(spark, sf):
    path = scratch(spark, "index")
    index.write_index(fx.dense(spark, sf), WIDE, 20, 4, 4, path)
    return index.read_index(spark, path, [0])[1].filter("time_part IN (1, 2)").select("day", "time_part", "traj_id", "min_lon", "max_lon", "min_lat", "max_lat", "n")


METRICS = f"""WITH pts AS ({fx.DENSE}), h AS (SELECT q.traj_id AS query_id, p.traj_id, p.snap FROM pts p JOIN pts q ON p.snap = q.snap AND q.traj_id IN (0,1,2,3,4)
AND abs(p.lon - q.lon) <= 0.15 AND abs(p.lat - q.lat) <= 0.15), {islands_sql('query_id, traj_id')},
r AS (SELECT query_id, traj_id FROM i GROUP BY query_id, traj_id HAVING max(n) >= 5),
m AS (SELECT query_id, count(*) AS contacts, count(DISTINCT traj_id) AS candidates, (SELECT count(*) FROM r WHERE r.query_id = h.query_id) AS results FROM h GROUP BY query_id)"""


@register("query_metrics", METRICS + " SELECT * FROM m")
def query_metrics(spark, sf):
    """Written as tab-separated lines and read back."""
    path = scratch(spark, "metrics")
    pts.write_metrics(comovement.query_metrics(fx.dense(spark, sf), [0, 1, 2, 3, 4], 0.15, 5), path)
    return pts.read_metrics(spark, path, "query_id long, contacts long, candidates long, results long")


@register("metric_sums", METRICS + " SELECT CAST(sum(contacts) AS BIGINT) AS contacts, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(results) AS BIGINT) AS results FROM m")
def metric_sums(spark, sf):
    return comovement.metric_sums(comovement.query_metrics(fx.dense(spark, sf), [0, 1, 2, 3, 4], 0.15, 5))


@register("join_summary", join_sql(fx.DENSE, 0.1, 4).replace("SELECT a, b, max(n) AS best FROM i", "SELECT count(*) AS pairs FROM (SELECT a, b FROM i", 1) + ")")
def join_summary(spark, sf):
    """The join's summary line (seconds, pairs) as written and read back, without its seconds."""
    path = scratch(spark, "summary")
    pts.write_metrics(timed(comovement.subtraj_join(fx.dense(spark, sf), 0.1, 4)), path)
    return pts.read_metrics(spark, path, "seconds double, pairs long").select("pairs")


@register("place_lists", f"SELECT traj_id, count(*) AS n, string_agg(CAST(snap AS VARCHAR), ',' ORDER BY snap) AS snaps, arg_max(lon, snap) AS last_lon FROM ({fx.DENSE}) GROUP BY traj_id")
def place_lists(spark, sf):
    p = network.place_lists(fx.dense(spark, sf))
    return p.select("traj_id", F.size("places").cast("long").alias("n"), F.array_join(F.transform("places.snap", lambda x: x.cast("string")), ",").alias("snaps"), F.element_at("places", -1)["lon"].alias("last_lon"))


@register("row_chunks", f"SELECT traj_id, snap, CAST((row_number() OVER (ORDER BY traj_id, snap) - 1) // 500 AS BIGINT) AS chunk FROM ({fx.DENSE})")
def row_chunks(spark, sf):
    return partitioning.chunks(fx.dense(spark, sf), ["traj_id", "snap"], 500).select("traj_id", "snap", "chunk")


@register("timed_predict", f"""SELECT traj_id, snap, one + (one - two) * r AS lon_hat FROM (SELECT *, lag(lon, 1) OVER w AS one, lag(lon, 2) OVER w AS two,
CASE WHEN lag(t, 1) OVER w > lag(t, 2) OVER w THEN (t - lag(t, 1) OVER w) / (lag(t, 1) OVER w - lag(t, 2) OVER w) ELSE 1.0 END AS r
FROM (SELECT *, CAST(snap * (snap % 3 + 1) AS DOUBLE) AS t FROM ({fx.DENSE})) WINDOW w AS (PARTITION BY traj_id ORDER BY snap)) WHERE two IS NOT NULL""")
def timed_predict(spark, sf):
    p = fx.dense(spark, sf).withColumn("t", (F.col("snap") * (F.col("snap") % 3 + 1)).cast("double"))
    return codec.linear_residuals(p, "t").filter("snap >= 2").select("traj_id", "snap", "lon_hat")


# --- sources and sinks: written, read back, compared with what was written ---------------------------------------------


@register("parquet_roundtrip", fx.DENSE)
def parquet_roundtrip(spark, sf):
    p, path = fx.dense(spark, sf), scratch(spark, "points")
    partitioning.write_sliced(p, partitioning.space_slices(p, 16, 100), 16, path)
    return pts.read_parquet(spark, path)


@register("records_roundtrip", fx.DENSE)
def records_roundtrip(spark, sf):
    return pts.records_of(pts.to_records(partitioning.time_slices(fx.dense(spark, sf), 8)))


@register("text_roundtrip", fx.DENSE)
def text_roundtrip(spark, sf):
    path = scratch(spark, "text")
    pts.write_text(fx.dense(spark, sf), path, origin="1000")
    return pts.read_text(spark, path, origin="1000")


def _with_ids(points: DataFrame, lookup: DataFrame) -> DataFrame:
    return points.join(lookup, ["time_part", "space_part", "space_order"]).select("traj_id", "snap", "lon", "lat")


def _placed(spark, sf):
    p = fx.dense(spark, sf)
    lookup = partitioning.space_slices(p, 16, 100)
    return partitioning.with_lookup(p, lookup, 16), lookup


@register("slices_roundtrip", fx.DENSE)
def slices_roundtrip(spark, sf):
    placed, lookup = _placed(spark, sf)
    back = pts.slices_of(pts.to_slices(placed, 16), 16)
    return _with_ids(back, pts.lookup_of(pts.to_lookup(lookup)))


@register("packed_slices_roundtrip", fx.DENSE)
def packed_slices_roundtrip(spark, sf):
    placed, lookup = _placed(spark, sf)
    return _with_ids(codec.unpack_slices(codec.pack_slices(placed, 16), 16), lookup)


@register("network_roundtrip", f"SELECT edge_id, s_node, e_node, s_lng, s_lat, e_lng, e_lat, c_lng, c_lat FROM ({fx.EDGES})")
def network_roundtrip(spark, sf):
    path = scratch(spark, "edges")
    cols = ["edge_id", "s_node", "e_node", *[f"{p}_{c}" for p in "sec" for c in ("lng", "lat")]]
    roads.write_csv(fx.lattice_edges(spark).select(*cols), path)
    return roads.read_edges(spark, path)


@register("spans_roundtrip", f"WITH {SPANS} SELECT edge_id, span_s FROM sp")
def spans_roundtrip(spark, sf):
    path = scratch(spark, "spans")
    roads.write_spans(_spans(spark, sf), path)
    return roads.read_spans(spark, path)


@register("walks_roundtrip", f"SELECT ordinal, edge_id, CAST(edge_id / 4 AS DOUBLE) AS travel_time FROM ({PATHS})")
def walks_roundtrip(spark, sf):
    path = scratch(spark, "walks")
    roads.write_walks(_paths(spark).select(F.col("path_id").alias("walk_id"), "ordinal", "edge_id", (F.col("edge_id") / 4).alias("travel_time")), path)
    return roads.read_walk(spark, path).select("ordinal", "edge_id", "travel_time")


@register("codec_roundtrip", PRESENT)
def codec_roundtrip(spark, sf):
    return codec.decompress(codec.compress(cells.clean(fx.with_gaps(spark, sf))))


# --- streams ------------------------------------------------------------------------------------------------------------


@register("stream_runs", f"WITH {hits_sql(fx.DENSE, 0.02)}, {islands_sql('a, b')} SELECT a, b, CAST(start + 1 AS INTEGER) AS snap FROM i WHERE n >= 2")
def stream_runs(spark, sf):
    """Runs of two from a stream in four micro-batches by snapshot, drained into Parquet: of points where they are crowded,
    else of contacts."""
    path, points = scratch(spark, "stream"), fx.dense(spark, sf)
    crowded = tiles.crowded(points, 0.02)
    rows = points if crowded else cells.contacts(points, 0.02)
    for part in range(4):
        rows.filter(F.floor(F.col("snap") / 8) == part).repartition(1).write.mode("append").parquet(path)
    schema = "traj_id long, snap int, lon double, lat double" if crowded else "a long, b long, snap int"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    found = stream.stream_runs(source, 2, delta=0.02) if crowded else stream.stream_runs(source, 2)
    q = found.writeStream.format("parquet").option("path", path + "-out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", path + "-state").start()
    q.awaitTermination()
    for done in (path, path + "-state"):
        remove(spark, done)
    return spark.read.schema("a long, b long, snap int").parquet(path + "-out")


# --- sequential operators ------------------------------------------------------------------------------------------------


@register("geodesic_lengths")
def geodesic_lengths(spark, sf):
    return network.geodesic_lengths(fx.lattice_edges(spark))


@register("map_match")
def map_match(spark, sf):
    return matching.map_match(fx.dense(spark, sf), fx.lattice_edges(spark), lon_reach=0.06, lat_reach=0.06, radius_m=5000.0)


def _walks(spark, sf):
    starts = fx.dense(spark, sf).select("traj_id").distinct().select(F.col("traj_id").alias("walk_id"), (F.col("traj_id") % 121).cast("int").alias("node_id"))
    return matching.random_walks(starts, network.adjacency(fx.lattice_edges(spark)), 2000, step_s=60.0, seed=1)


@register("random_walk")
def random_walk(spark, sf):
    return _walks(spark, sf)


@register("random_walk_checks", "SELECT DISTINCT vec_id AS walk_id, CAST(1 AS BIGINT) AS starts, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS turns, TRUE AS ends_well FROM embeddings")
def random_walk_checks(spark, sf):
    """What holds of every walk on the lattice: it starts at its node, each edge meets the next, none turns back, and
    its samples reach the number asked for with the last edge and not before."""
    e = fx.lattice_edges(spark).select("edge_id", "s_node", "e_node")
    w = Window.partitionBy("walk_id").orderBy("ordinal")
    p = _walks(spark, sf).join(e, "edge_id").withColumns({"p_s": F.lag("s_node").over(w), "p_e": F.lag("e_node").over(w), "p_edge": F.lag("edge_id").over(w)})
    n = F.greatest(F.lit(1), F.ceil(F.col("travel_time") / 60.0))
    p = p.withColumn("points", n).withColumn("before", F.sum("points").over(w) - F.col("points"))
    start = (F.col("walk_id") % 121).isin(F.col("s_node"), F.col("e_node"))
    met = F.col("s_node").isin(F.col("p_s"), F.col("p_e")) | F.col("e_node").isin(F.col("p_s"), F.col("p_e"))
    return p.groupBy("walk_id").agg(
        F.sum(((F.col("ordinal") == 0) & start).cast("long")).alias("starts"), F.sum(((F.col("ordinal") > 0) & ~met).cast("long")).alias("gaps"),
        F.sum((F.col("edge_id") == F.col("p_edge")).cast("long")).alias("turns"),
        (F.bool_and("ok") & (F.sum("points") >= 2000) & (F.max("before") < 2000)).alias("ends_well"),
    ).withColumn("turns", F.coalesce("turns", F.lit(0)))
