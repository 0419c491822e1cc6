"""Map matching of whole trajectories and weighted random walks: the sequential parts, in pandas groups."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import match_candidates

NETWORK_EDGES = 5_000_000  # edges that a network may have to be sent to every executor


def _metres(x1, y1, x2, y2) -> float:
    a, b = math.radians(y1), math.radians(y2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6367000.0 * math.asin(min(1.0, math.sqrt(h)))


_networks: dict[str, object] = {}  # what a worker has built of the networks it was sent, by their key


def built(key: str, make):
    """``make()``, once per worker and key; the last network alone is kept."""
    if key not in _networks:
        _networks.clear()
        _networks[key] = make()
    return _networks[key]


def sent(table: DataFrame, limit: int):
    """(key, Spark broadcast of the table as pandas): once to each executor, not with each task. Its size doesn't grow with
    the trajectories, and is checked: a network beyond ``limit`` rows has to be matched by region."""
    spark = table.sparkSession
    if table.limit(limit + 1).count() > limit:
        raise ValueError(f"the network has more than {limit} rows; match it by region")
    return uuid.uuid4().hex, spark.sparkContext.broadcast(table.toPandas())


class Roads:
    """A road network of directed edges; ``reach`` bounds the search for shortest ways, in metres."""

    def __init__(self, edges: pd.DataFrame, reach: float = math.inf) -> None:
        self.reach = reach
        self.out: dict[int, list[tuple[int, float]]] = {}
        self.edge: dict[int, tuple] = {}
        for r in edges.itertuples(index=False):
            self.out.setdefault(r.s_node, []).append((r.e_node, r.length))
            self.edge[r.edge_id] = (r.s_node, r.e_node, r.s_lng, r.s_lat, r.e_lng, r.e_lat)
        self.known: dict[int, tuple[dict[int, float], list]] = {}

    def distance(self, a: int, b: int) -> float | None:
        """Shortest way from node a to b, None where there is none within reach. The search from a goes on from where it
        last stopped, and no further than b."""
        if a not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            self.known[a] = ({}, [(0.0, a)])
        best, queue = self.known[a]
        while b not in best and queue:
            d, n = heapq.heappop(queue)
            if n in best or d > self.reach:
                continue
            best[n] = d
            for m, w in self.out.get(n, ()):
                if m not in best:
                    heapq.heappush(queue, (d + w, m))
        return best.get(b)

    def way(self, p: tuple, q: tuple) -> float | None:
        """Network metres between two candidates (lon, lat, edge, distance, node or None)."""
        start, end, extra = p[4], q[4], 0.0
        if start is None:
            e = self.edge[p[2]]
            start = e[1]
            extra += math.sqrt(abs(_metres(p[0], p[1], e[4], e[5]) ** 2 - p[3] ** 2))
        if end is None:
            e = self.edge[q[2]]
            end = e[0]
            extra += math.sqrt(abs(_metres(q[0], q[1], e[2], e[3]) ** 2 - q[3] ** 2))
        d = self.distance(start, end)
        return None if d is None else d + extra


def viterbi(layers: list[list[tuple]], roads: Roads) -> list[tuple] | None:
    """One candidate per layer that maximises the sum of observation times transmission along the way.

    Transmission is straight distance over network distance, 0 where there is no way, 1 where the network distance is 0."""
    score, back = [[0.0] * len(layers[0])], []
    for here, there in zip(layers, layers[1:]):
        straight = _metres(here[0][0], here[0][1], there[0][0], there[0][1])
        row, came = [], []
        for q in there:
            seen = math.exp(-q[3] ** 2 / 800.0) / (math.sqrt(2 * math.pi) * 20.0)
            best, who = -math.inf, -1
            for i, p in enumerate(here):
                d = roads.way(p, q)
                v = 0.0 if d is None else (1.0 if d == 0 else straight / d)
                if score[-1][i] + seen * v > best:
                    best, who = score[-1][i] + seen * v, i
            row.append(best)
            came.append(who)
        score.append(row)
        back.append(came)
    at = int(np.argmax(score[-1]))
    path = [at]
    for came in reversed(back):
        path.append(came[path[-1]])
    return [layer[i] for layer, i in zip(layers, reversed(path))]


def map_match(points: DataFrame, edges: DataFrame, way_reach_m: float = math.inf, **reach: float) -> DataFrame:
    """(traj_id, ordinal, edge_id, node_id): matched edges of each trajectory, in order; one row with -1 where fewer
    than two of its distinct places have candidates. Needs each trajectory's candidates together, nothing more.

    The network is broadcast once and built once per worker. Ways are searched without bound, or up to ``way_reach_m``."""
    key, network = sent(edges.select("edge_id", "s_node", "e_node", "s_lng", "s_lat", "e_lng", "e_lat", "length"), NETWORK_EDGES)
    found = match_candidates(points, edges, **reach)
    rows = points.select("traj_id").distinct().join(found, "traj_id", "left")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        roads = built(key, lambda: Roads(network.value, way_reach_m))
        tid = pdf["traj_id"].iloc[0]
        layers, places = [], set()
        for _, g in pdf.dropna(subset=["edge_id"]).sort_values(["snap", "edge_id"]).groupby("snap", sort=True):
            place = (g["lon"].iloc[0], g["lat"].iloc[0])
            if place in places:
                continue
            places.add(place)
            layers.append([(r.lon, r.lat, int(r.edge_id), float(r.dist_m), None if pd.isna(r.node_id) else int(r.node_id)) for r in g.itertuples(index=False)])
        path = viterbi(layers, roads) if len(layers) > 1 else None
        if path is None:
            return pd.DataFrame({"traj_id": [tid], "ordinal": [0], "edge_id": [-1], "node_id": [-1]})
        return pd.DataFrame({"traj_id": tid, "ordinal": range(len(path)), "edge_id": [p[2] for p in path], "node_id": [-1 if p[4] is None else p[4] for p in path]})

    return rows.groupBy("traj_id").applyInPandas(match, "traj_id long, ordinal int, edge_id int, node_id int")


def random_walks(starts: DataFrame, adj: DataFrame, sample_points: int, step_s: float = 5.0, max_edges: int = 100_000, seed: int = 0) -> DataFrame:
    """(walk_id, ordinal, edge_id, travel_time, ok) for starts (walk_id, node_id).

    The next edge is drawn by weight, never the edge just come by; a walk ends well at ``sample_points`` samples and
    is rejected (ok false) at a dead end or after ``max_edges`` edges. Each walk has its own seed, so a retried task
    walks the same way."""
    key, network = sent(adj.select("node_id", "next_node", "edge_id", "weight", "travel_time"), 2 * NETWORK_EDGES)

    def ways_of(table: pd.DataFrame) -> dict:
        groups = table.sort_values(["node_id", "edge_id"]).groupby("node_id")
        return {n: (g["next_node"].to_numpy(), g["edge_id"].to_numpy(), g["weight"].to_numpy(float), g["travel_time"].to_numpy(float)) for n, g in groups}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways = built(key, lambda: ways_of(network.value))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rng, node, last, points, path, ok = np.random.default_rng([seed, int(r.walk_id)]), r.node_id, None, 0, [], True
                while points < sample_points:
                    nxt, edge, w, t = ways.get(node, (np.zeros(0, int),) * 4)
                    w = np.where(edge == last, 0.0, w) if last is not None else w
                    if len(path) >= max_edges or w.sum() <= 0:
                        ok = False
                        break
                    i = int(rng.choice(len(w), p=w / w.sum()))
                    path.append((edge[i], t[i]))
                    points += max(1, math.ceil(t[i] / step_s))
                    node, last = nxt[i], edge[i]
                yield pd.DataFrame({"walk_id": r.walk_id, "ordinal": range(len(path)), "edge_id": [p[0] for p in path], "travel_time": [p[1] for p in path], "ok": ok})

    return starts.select("walk_id", "node_id").mapInPandas(walk, "walk_id long, ordinal int, edge_id int, travel_time double, ok boolean")


def visits(points: DataFrame) -> DataFrame:
    """Edge visits of matched paths for counting."""
    return points.filter(F.col("edge_id") >= 0).select("traj_id", "edge_id")
