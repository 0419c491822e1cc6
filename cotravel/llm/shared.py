"""Shared storage, remote calls and connected components for the llm operators."""

from __future__ import annotations

import os
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import paths

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def remote(module: str, name: str, *args) -> Callable:
    """A callable for executors that imports ``module`` there and calls ``name(*args)(data)``.

    The factory runs once per Python worker and call site, so what it keeps at module level
    (tokenizer caches) lives as long as the worker.
    """
    root = ROOT
    state: dict = {}

    def call(data):
        if "f" not in state:
            import importlib
            import sys

            try:
                found = importlib.import_module(module)
            except ModuleNotFoundError:
                sys.path.insert(0, root)
                found = importlib.import_module(module)
            if "encode" not in vars(found) and (used := sys.modules.get("cotravel.llm.encode")):
                used.release()  # a reused worker doesn't carry the tokenizers' memory into other operators
            state["f"] = getattr(found, name)(*args)
        return state["f"](data)

    return call


def text_udf(module: str, name: str, schema: str, *args):
    """Arrow UDF over one column; ``module.name(*args)`` builds the pa.Array -> pa.Array function."""
    import pyarrow as pa

    run = remote(module, name, *args)

    def apply(col: pa.Array) -> pa.Array:
        return run(col)

    apply.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, schema)


def group_udf(module: str, name: str, *args):
    """Function for applyInArrow; ``module.name(*args)`` builds the pa.Table -> pa.Table function."""
    import pyarrow as pa

    run = remote(module, name, *args)

    def apply(table: pa.Table) -> pa.Table:
        return run(table)

    apply.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return apply


_staged: list[str] = []  # paths of staged tables that are still there


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (see ``paths.shared_dir``)."""
    return paths.scratch(spark, name)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files behind staged tables that nothing reads any more."""
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            paths.remove(df.sparkSession, f)
            _staged[:] = [p for p in _staged if p.rsplit("/", 1)[1] != f.rsplit("/", 1)[1]]


@contextmanager
def in_batches(spark: SparkSession, rows: int):
    """Python functions of what is computed inside get so many rows at once at most: for rows that hold long lists."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def swept(spark: SparkSession):
    """Delete at the end all tables staged inside: for callers that have written their result by then."""
    before = set(_staged)
    try:
        yield
    finally:
        for path in [p for p in _staged if p not in before]:
            paths.remove(spark, path)
            _staged.remove(path)


LOCAL = 200_000  # edges, of 16 bytes each, from which on the driver ends the contraction at once


def ended(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges, found in the driver."""
    import numpy as np
    import pyarrow as pa

    from .graphs import forest

    got = edges.toArrow()
    u, v = (np.concatenate([np.zeros(0, np.int64), got.column(k).to_numpy()]) for k in (0, 1))
    node, root = forest(u, v)
    node, root = np.concatenate([node, roots := np.setdiff1d(root, node)]), np.concatenate([root, roots])
    return staged(edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root})), "roots")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as rows (a long, b long); returns (node, root).

    Randomised contraction: each round every node points to the member of its closed neighbourhood with the
    smallest hash, edges move to these representatives, loops and repeats go. Nodes left shrink by a constant
    factor a round, so the number of rounds is logarithmic whatever the shape (paths, stars, cliques). The driver
    ends it where ``LOCAL`` edges are left, or fewer.
    Root is an arbitrary member of the component. Nodes without edges don't appear.
    """
    spark = edges.sparkSession
    edges = staged(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    rounds: list[DataFrame] = []
    while left := edges.limit(LOCAL + 1).count():
        if left <= LOCAL:
            rounds.append(ended(edges))
            break
        k = len(rounds)
        both = edges.union(edges.select("b", "a"))
        key = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))
        low = staged(
            both.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", key("a"))["n"].alias("root")),
            "roots",
        )
        rounds.append(low)
        moved = (
            edges.join(low.withColumnRenamed("node", "a"), "a").select(F.col("root").alias("ra"), "b")
            .join(low.withColumnRenamed("node", "b"), "b").select("ra", F.col("root").alias("rb"))
        )
        after = staged(
            moved.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges"
        )
        drop_staged(edges)
        edges = after
    drop_staged(edges)
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    # composed from the last round to the first, so that each table written is as large as its round's nodes
    out = rounds.pop()
    while rounds:
        low, nxt = rounds.pop(), out.select(F.col("node").alias("root"), F.col("root").alias("next"))
        whole = staged(low.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        drop_staged(low, out)
        out = whole
    return out
