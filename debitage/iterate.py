"""Fixpoint loops over DataFrames: durable cuts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Star rounds halve the longest chain at least, so this is far beyond any graph.
MAX_ROUNDS = 100
#: Edges of a group (a mesh, say) that one task solves by itself; larger ones go by rounds of joins.
SMALL = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a session on one machine makes a temporary one where it is unset.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder: a lost executor loses nothing that was cut here."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: for loops of many rounds.

    A checkpoint keeps what the optimiser has inferred about the rows, and that doubles
    from round to round of a loop; a table starts afresh.
    """
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def written(df: DataFrame, at: str, mode: str = "error") -> DataFrame:
    """df as a table at a path; the shuffle files of the job that writes it go as soon as it is over, as nothing reads them again."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").mode(mode).parquet(at)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(at)


def signature(df: DataFrame) -> tuple:
    """Row count and an order-free hash: equal tables have equal signatures."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def _least_reached(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 .. n-1 with edges u-v the least node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        step = root.copy()
        np.minimum.at(step, root[u], low)
        np.minimum.at(step, root[v], low)
        step = step[step]
        if (step == root).all():
            return root
        root = step


def _solved(e: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component of groups that are small enough for a task."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([g["_u"].to_numpy(), g["_v"].to_numpy()]), return_inverse=True)
        low = _least_reached(at[: len(g)], at[len(g) :], len(nodes))
        out = pd.DataFrame({"node": nodes, "component": nodes[low]})
        for k in keys:
            out[k] = g[k].iloc[0]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    schema = ", ".join(f"`{n}` {t}" for n, t in [*((k, kinds[k]) for k in keys), ("node", kinds["_u"]), ("component", kinds["_u"])])
    return e.groupBy(*keys).applyInPandas(lambda g: solve(g)[[*keys, "node", "component"]], schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", keys: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """Component of every node that has an edge, as its smallest node.

    Returns ``keys``, ``node``, ``component``.  Edges join nodes of equal keys only; null
    ends and keys are dropped.  Groups of at most ``small`` edges are solved in a task
    each.  Larger ones (all edges, without keys) are folded to forests in their
    partitions, and what links the forests goes by alternating large and small stars:
    each round hangs every node's larger neighbours, then its smaller ones, on the
    smallest node it sees.
    """
    keys = list(keys)
    e = edges.select(*keys, F.greatest(src, dst).alias("_u"), F.least(src, dst).alias("_v")).where("_u <> _v").distinct()
    e = materialise(e.dropna(subset=keys) if keys else e)
    found = None
    if keys:
        sizes = e.groupBy(*keys).agg(F.count("*").alias("_n"))
        if sizes.where(F.col("_n") > small).isEmpty():
            return _solved(e, keys)
        sizes = materialise(sizes)
        found = _solved(e.join(sizes.where(F.col("_n") <= small), keys, "left_semi"), keys)
        e = materialise(e.join(sizes.where(F.col("_n") > small), keys, "left_semi"))
    large = _by_contraction(e, keys)
    return large if found is None else found.unionByName(large)


#: Edges that a task of local contraction gathers before it folds them to a forest.
FOLD = 1_000_000


def _forests(e: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root: for every node of every partition the least one that the partition's edges reach.

    However many edges a node has in a partition, it comes out once; so a hub's edges are
    folded where they are, before any shuffle.
    """
    names = [*keys, "_u", "_v"]

    def fold(edges: pd.DataFrame) -> pd.DataFrame:
        ends = pd.concat([edges[[*keys, c]].rename(columns={c: "_u"}) for c in ("_u", "_v")], ignore_index=True)
        code = ends.groupby([*keys, "_u"], sort=True, dropna=False).ngroup().to_numpy()
        first = np.unique(code, return_index=True)[1]
        nodes = ends.iloc[first].reset_index(drop=True)
        low = _least_reached(code[: len(edges)], code[len(edges) :], len(first))
        return nodes.assign(_v=nodes["_u"].to_numpy()[low])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f[names])
            if sum(map(len, held)) > max(FOLD, 2 * len(held[0])):  # folded again once it has doubled
                held = [fold(pd.concat(held, ignore_index=True))]
        if held:
            yield fold(pd.concat(held, ignore_index=True))

    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    out = e.select(*names).mapInPandas(run, ", ".join(f"`{n}` {kinds[n]}" for n in names))
    return out.withColumnsRenamed({"_u": "node", "_v": "root"})


def _by_contraction(e: DataFrame, keys: list[str]) -> DataFrame:
    """Components of graphs of any size: forests of the partitions first, then rounds over the forests' roots.

    A node that several partitions hold links its roots there, and only such links go to
    the rounds.  A node's roots are no more than the partitions.
    """
    forest = materialise(_forests(e, keys))
    nodes = materialise(forest.groupBy(*keys, "node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots")))
    links = nodes.where("size(roots) > 1").select(*keys, F.explode("roots").alias("_u"), F.col("low").alias("_v")).where("_u <> _v").distinct()
    merged = _stars(materialise(links), keys).select(*keys, F.col("node").alias("low"), "component")
    return nodes.select(*keys, "node", "low").join(merged, [*keys, "low"], "left").select(*keys, "node", F.coalesce("component", "low").alias("component"))


def _stars(e: DataFrame, keys: list[str]) -> DataFrame:
    seen = signature(e)
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(*keys, F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        low = both.groupBy(*keys, "_u").agg(F.least("_u", F.min("_v")).alias("_low"))
        large = both.where("_v > _u").join(low, [*keys, "_u"]).select(*keys, F.col("_v").alias("_u"), F.col("_low").alias("_v")).distinct()
        low = large.groupBy(*keys, "_u").agg(F.min("_v").alias("_low"))
        moved = large.join(low, [*keys, "_u"]).where("_v <> _low").select(*keys, F.col("_v").alias("_u"), F.col("_low").alias("_v"))
        e = materialise(moved.unionByName(low.withColumnRenamed("_low", "_v")).distinct())
        now = signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
    member = e.select(*keys, F.col("_u").alias("node"), F.col("_v").alias("component"))
    root = e.select(*keys, F.col("_v").alias("node"), F.col("_v").alias("component")).distinct()
    return member.unionByName(root)
