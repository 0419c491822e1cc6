"""Embedding near-duplicates: rows are linked with hubs found by a navigable small-world graph, cosine verified."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import forest
from .hnsw import Index
from .shared import connected_components, drop_staged, group_udf, remote, staged

COSINE = 0.95
BEAM = 24
LISTS = 4  # hubs that a row is linked with, before audits ask for more
LIST_ROWS, SHARD_BYTES = 1024, 40 << 20  # a hub for so many rows, as long as the hubs' graph is of at most about that size
PART_ROWS = 16384  # rows of a hub that are compared in one task; longer lists are dealt over pairs of parts
PAIRS = 1 << 22  # similarities held at once
AUDIT, LINK_RECALL, NEAR_RECALL = 64, 0.995, 0.9  # queries of a sample; mean recall of links, share of planted links at the threshold found


def unit(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


PLAIN = {"parquet.enable.dictionary": "false"}  # for tables of vectors, whose numbers don't repeat


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(column: pa.Array) -> pa.Array:
    """A list column of vectors as bytes."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))]) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def unpacked(column: pa.Array, dtype: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors from bytes, by length: (places in the column, matrix)."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)
    size, out = np.diff(ends), {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        raw = flat[ends[0] : ends[-1]].reshape(-1, n) if len(at) == len(size) else flat[ends[at][:, None] + np.arange(n)]
        out[n // np.dtype(dtype).itemsize] = at, np.ascontiguousarray(raw).view(dtype)
    return out


def apart(x: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of which no two link, each row linked with one of them: a group of near copies gets one hub."""
    keep = np.ones(len(x), bool)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x.T >= cosine
        for i in range(a, min(a + 512, len(x))):
            if keep[i]:
                keep[i + 1 :] &= ~near[i - a, i + 1 :]
    return np.flatnonzero(keep)


def hub_builder(cosine: float):
    """Sampled vectors of one length (dim, h, most, embedding) -> the graph of its hubs as one binary row."""

    def run(table: pa.Table) -> pa.Table:
        table, most = table.combine_chunks().sort_by("h"), table.column("most")[0].as_py()
        x = unit(matrix(table.column("embedding").combine_chunks())).astype(np.float32)
        index = Index(x[:most][apart(x[:most], cosine)])
        blob = pickle.dumps({"x": index.x, "graphs": index.graphs, "probes": x[-16 * AUDIT :]}, protocol=5)
        return pa.table({"dim": table.column("dim").slice(0, 1), "hubs": pa.array([len(index.x)], pa.int32()), "blob": [blob]})

    return run


def nearest(index: Index, q: np.ndarray, lists: int, ef: int) -> np.ndarray:
    """The hubs that each of the unit vectors is linked with (-1: fewer were reached)."""
    if len(index.x) <= lists:
        found = np.tile(np.arange(len(index.x), dtype=np.int32), (len(q), 1))
    else:
        found = index.search(q.astype(np.float32), max(ef, 4 * lists), 2, 1024)[0][:, :lists]
    return np.concatenate([found, np.full((len(q), max(0, lists - found.shape[1])), -1, np.int32)], axis=1)


def opened(blob: bytes) -> Index:
    d = pickle.loads(blob)
    return Index(d["x"], d["graphs"])


def planted_recall(blob: bytes, cosine: float, lists: int, ef: int) -> float:
    """Of links planted at the threshold itself, one for each of some nodes, few of them hubs: the share that meets in a list."""
    index, x = opened(blob), unit(pickle.loads(blob)["probes"])
    off = np.random.default_rng(0).normal(size=x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((off * off).sum(axis=1, keepdims=True))
    y = np.where(size > 1e-9, cosine * x + np.sqrt(1 - cosine**2) * off / np.maximum(size, 1e-9), x)
    a, b = nearest(index, x, lists, ef), nearest(index, y, lists, ef)
    return float(((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=(1, 2)).mean())


def linker(hubs: dict[int, tuple[int, bytes]], lists: int, ef: int, dtype: str):
    """Batches with vectors as lists or bytes -> vectors as bytes, and the lists (numbers of hubs) that each is in."""
    graphs = {dim: (first, opened(blob)) for dim, (first, blob) in hubs.items()}

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            vectors = batch.column(at) if pa.types.is_binary(batch.column(at).type) else packed(batch.column(at))
            out = np.full((len(vectors), lists), -1, np.int32)
            for dim, (rows, x) in unpacked(vectors, dtype).items() if len(vectors) else ():
                first, index = graphs[dim]
                got = nearest(index, unit(x), lists, ef)
                out[rows] = np.where(got >= 0, got + first, -1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, lists, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], vectors, *batch.columns[at + 1 :], flat], [*batch.schema.names, "lists"])

    return run


class Found:
    """What a group of queries has found: others linked, the weight of these."""

    def __init__(self, n: int) -> None:
        self.links, self.weight = np.zeros(n, np.int64), np.zeros(n, np.int64)


class Links:
    """Links of queries to one list's vectors. Pairs are counted block by block and kept as a spanning forest only.

    With ``lists`` (of its vectors), a pair counts in the first list alone that holds both."""

    def __init__(self, held: bytes | dict, cosine: float, here: int = 0) -> None:
        d = pickle.loads(held) if isinstance(held, bytes) else held
        self.exact, self.node, self.m, self.cosine = unit(d["raw"]), d["node"], d["m"], cosine
        self.x, self.lists, self.here = self.exact.astype(np.float32), d.get("lists"), here
        self.slack = max(1e-5, 2e-7 * self.x.shape[1])  # of similarities in single precision
        self.label = np.arange(len(self.node))  # of rows that brute force has joined
        self.edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.held = 0

    def near_of(self, q: np.ndarray):
        """In blocks: (queries that link, the vectors that are linked, which link which). Single precision decides
        where it is sure, double precision the rest."""
        step, q32 = max(1, PAIRS // max(1, len(self.x))), q.astype(np.float32)
        for k in range(0, len(q), step):
            s = q32[k : k + step] @ self.x.T
            near = s >= self.cosine - self.slack
            r = np.flatnonzero(near.any(axis=1))
            if len(r):
                near = near[r]
                c = np.flatnonzero(near.any(axis=0))
                near = near[:, c]
                i, j = np.nonzero(near & (s[np.ix_(r, c)] < self.cosine + self.slack))
                for at in range(0, len(i), 1 << 16):
                    u, v = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    near[u, v] = np.einsum("fd,fd->f", q[k + r[u]], self.exact[c[v]]) >= self.cosine
                yield k + r, c, near

    def earlier(self, asked: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which of the queries and of the vectors ``c`` meet in a list before this one."""
        mine = self.lists[c]
        both = np.intersect1d(asked, mine)
        both = both[(both >= 0) & (both < self.here)]
        if not len(both):
            return np.zeros((len(asked), len(c)), bool)

        def held(lists: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(both, lists), len(both) - 1)
            row, col = np.nonzero(both[at] == lists)
            out = np.zeros((len(lists), len(both)), np.float32)
            out[row, at[row, col]] = 1
            return out

        return held(asked) @ held(mine).T > 0

    def keep(self, u: np.ndarray, v: np.ndarray) -> None:
        self.edges.append(forest(u, v))
        self.held += len(self.edges[-1][0])
        if self.held > 4 * len(self.node) + 100_000:
            self.edges = [forest(*(np.concatenate(x) for x in zip(*self.edges)))]
            self.held = 0

    def brute(self, q: np.ndarray, node: np.ndarray, rows: np.ndarray, found: Found, lists: np.ndarray | None = None) -> None:
        single = (self.m == 1).all()
        for r, c, near in self.near_of(q[rows]):
            near &= node[rows[r]][:, None] != self.node[c][None, :]
            if lists is not None:
                some = np.flatnonzero(near.any(axis=1))
                r, near = r[some], near[some]
                near &= ~self.earlier(lists[rows[r]], c)
            some = np.flatnonzero(near.any(axis=1))
            part, near = rows[r[some]], near[some]
            found.links[part] = np.count_nonzero(near, axis=1)
            found.weight[part] = found.links[part] if single else near.astype(np.float64) @ self.m[c]
            for i in range(len(part)):
                labels = self.label[c[near[i]]]
                low = labels.min()
                if low != labels.max():  # all that one query links is joined
                    joined = np.zeros(len(self.label), bool)
                    joined[labels] = True
                    self.label[joined[self.label]] = low
            self.keep(node[part], self.node[c[near.argmax(axis=1)]])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return forest(*(np.concatenate([*x, y]) for x, y in zip(zip(*self.edges), (self.node[own], self.node[self.label[own]]))))


def verifier(cosine: float, dtype: str):
    """Rows of one list (list, a, b, part, node, m, lists, embedding): those of part ``a`` are compared with those of
    part ``b`` -> link counts (node, -1, n) and spanning edges (a, b, 0)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        here, a, b = (table.column(k)[0].as_py() for k in ("list", "a", "b"))
        part, node, m = (table.column(k).to_numpy() for k in ("part", "node", "m"))
        ((_, raw),), lists = unpacked(table.column("embedding").combine_chunks(), dtype).values(), matrix(table.column("lists").combine_chunks())
        at, asks = np.flatnonzero(part == b), np.flatnonzero(part == a)
        found = Found(len(asks))
        links = Links({"raw": raw[at], "node": node[at], "m": m[at], "lists": lists[at]}, cosine, here)
        links.brute(links.exact if a == b else unit(raw[asks]), node[asks], np.arange(len(asks)), found, lists[asks])
        some, (u, v) = np.flatnonzero(found.weight), links.forest()
        columns = (node[asks][some], u), (np.full(len(some), -1), v), (found.weight[some], np.zeros(len(u)))
        return pa.table({k: pa.array(np.concatenate(x).astype(np.int64)) for k, x in zip("abn", columns)})

    return run


def auditor(node: np.ndarray, vectors: list[np.ndarray], cosine: float, dtype: str):
    """Batches (node, m, embedding) -> how much of each batch every sampled node links with, by brute force."""
    dims = {d: [i for i, v in enumerate(vectors) if len(v) == d] for d in {len(v) for v in vectors}}
    sample = {d: (np.array(i), unit(np.stack([vectors[k] for k in i]))) for d, i in dims.items()}

    def run(batches):
        for batch in batches:
            ids, m = batch.column("node").to_numpy(), batch.column("m").to_numpy()
            for dim, (rows, x) in unpacked(batch.column("embedding"), dtype).items() if len(ids) else ():
                if dim in sample:
                    i, q = sample[dim]
                    near = q @ unit(x).T >= cosine
                    near &= node[i][:, None] != ids[rows][None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array((near @ m[rows]).astype(np.int64))], ["node", "n"])

    return run


def recall(nodes: DataFrame, counts: DataFrame, cosine: float, dtype: str) -> float:
    """Mean share of their links that sampled nodes have found; half of the sample are any nodes, half have found some."""
    one = nodes.select("node", "embedding", F.xxhash64("k1").alias("h"))
    some = one.join(counts.withColumn("h", F.xxhash64("node", F.lit(1))).orderBy("h").limit(AUDIT).select("node"), "node", "left_semi")
    picked = {r.node: np.frombuffer(r.embedding, dtype) for r in [*one.orderBy("h").limit(AUDIT).collect(), *some.collect()]}
    if not picked:
        return 1.0
    run = remote(__name__, "auditor", np.array(list(picked)), list(picked.values()), cosine, dtype)
    true = nodes.select("node", "m", "embedding").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("every"))
    shares = [(r.n or 0) / r.every for r in true.filter("every > 0").join(counts, "node", "left").collect()]
    return float(np.mean(shares)) if shares else 1.0


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, ef: int = BEAM) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and vectors with null or non-finite components link with nothing; vectors of
    different lengths don't link. Equal vectors are one node with a weight, so copies cost nothing; nodes are numbered,
    so rows that share a vec_id but not the vector are told apart, each with its own links. The hubs, a bounded sample
    of the nodes, are the upper layers of a navigable small-world graph; every node is in the lowest layer and linked
    with the ``LISTS`` hubs nearest to it, which a beam search in the upper layers finds. Nodes that share a hub are
    compared, so a node meets as many lists whatever the number of rows. Links of a sample are compared with brute
    force over all rows, and nodes are linked with twice as many hubs until enough are found; with all hubs all are.
    Rows with a null vec_id are returned with a null component if no member has an id. No rows: no rows; extra columns
    aren't read.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    rows = rows.withColumn("embedding", F.expr(
        "CASE WHEN size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(embedding, x -> x <> 0) THEN embedding END"
    )).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})
    # two hashes stand for a vector
    nodes = staged(
        rows.filter("embedding IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("embedding"))
        .select(F.monotonically_increasing_id().alias("node"), "rep", "m", "k1", "k2", "embedding"),
        "nodes", **PLAIN,
    )
    sizes = {r.dim: r.n for r in nodes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    hubs, total = hub_graphs(nodes, sizes, cosine)
    lists = LISTS
    while lists < total and any(planted_recall(blob, cosine, lists, ef) < NEAR_RECALL for _, blob in hubs.values()):
        lists *= 2
    shape, dtype = "node long, rep long, m long, k1 long, k2 long, embedding binary, lists array<int>", "<f4" if kind == "float" else "<f8"
    while True:
        linked = staged(nodes.mapInArrow(remote(__name__, "linker", hubs, lists, ef, dtype), shape), "linked", **PLAIN)
        drop_staged(nodes)
        nodes = linked.drop("lists")
        found = staged(compared(linked.select("node", "m", "lists", "embedding"), cosine, dtype), "links")
        counts = staged(found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "counts")
        if lists >= total or recall(linked, counts, cosine, dtype) >= LINK_RECALL:
            break
        drop_staged(found, counts)
        lists *= 2
    roots = connected_components(found.filter("n = 0").select("a", "b"))
    lead = roots.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("lead"))
    named = staged(
        nodes.select("node", "rep", "m", "k1", "k2").join(counts, "node", "left").join(roots, "node", "left").join(lead, "root", "left")
        .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("lead", "rep").alias("component_id")),
        "named",
    )
    drop_staged(linked, found, counts)
    out = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), F.col("k1")).alias("k1"), "k2").join(named, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def hub_graphs(nodes: DataFrame, sizes: dict[int, int], cosine: float) -> tuple[dict[int, tuple[int, bytes]], int]:
    """By length of vectors: (number of the first hub, graph of the hubs), and how many hubs a length has at most."""
    width = 4 * 2 * 16 * 2
    most = {d: max(1, min(n // LIST_ROWS, SHARD_BYTES // (4 * d + width))) for d, n in sizes.items()}
    spark = nodes.sparkSession
    # hashes below the limit: some more than are needed
    wanted = [(d, most[d], (min(n, 2 * most[d] + 64) * ((1 << 64) - 1)) // n - (1 << 63)) for d, n in sizes.items()]
    few = F.broadcast(spark.createDataFrame(wanted, "dim int, most int, lim long"))
    sample = nodes.select(F.size("embedding").alias("dim"), F.col("k1").alias("h"), "embedding").join(few, "dim").filter("h <= lim")
    got = sample.select("dim", "h", "most", "embedding").groupBy("dim").applyInArrow(group_udf(__name__, "hub_builder", cosine), "dim int, hubs int, blob binary").collect()
    hubs, first = {}, 0
    for r in sorted(got, key=lambda r: r.dim):
        hubs[r.dim] = (first, bytes(r.blob))
        first += r.hubs
    return hubs, max(r.hubs for r in got)


def compared(linked: DataFrame, cosine: float, dtype: str) -> DataFrame:
    """Link counts (node, -1, n) and spanning edges (a, b, 0) of nodes that share a list. A list of more than
    ``PART_ROWS`` is dealt over parts, and each task compares one part with another or itself."""
    each = linked.select("node", "m", "lists", "embedding", F.explode("lists").alias("list")).filter("list >= 0")
    long = F.broadcast(
        linked.select(F.explode("lists").alias("list")).groupBy("list").count().filter(F.col("count") > PART_ROWS)
        .select("list", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
    )
    dealt = each.join(long, "list", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    pairs = "array_distinct(flatten(transform(sequence(0, parts - 1), q -> array(struct(part AS a, q AS b), struct(q AS a, part AS b)))))"
    dealt = dealt.select("list", "part", "node", "m", "lists", "embedding", F.expr(f"inline(IF(parts = 1, array(struct(0 AS a, 0 AS b)), {pairs}))"))
    return dealt.groupBy("list", "a", "b").applyInArrow(group_udf(__name__, "verifier", cosine, dtype), "a long, b long, n long")
