"""Temporal ordering of scars from pairwise comparisons: a DAG of younger over older."""

from __future__ import annotations

import functools
import heapq
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import MAX_ROUNDS, SMALL, tabled
from debitage.operators.topology import M


class _Comparisons:
    """Comparisons in order of entry, with all scars (placed beforehand) in a row where every younger one stands before its older ones.

    A comparison that agrees with the row closes no cycle and costs nothing more.  Else
    only scars between its two places can be on a path against it: they are searched from
    both ends, and if there is none, those found change places among themselves.
    """

    def __init__(self) -> None:
        self.source: dict[tuple[int, int], str] = {}
        self.after: dict[int, dict[int, None]] = {}
        self.before: dict[int, dict[int, None]] = {}
        self.place: dict[int, int] = {}

    def drop(self, a: int, b: int) -> str | None:
        source = self.source.pop((a, b), None)
        if source is not None:
            del self.after[a][b], self.before[b][a]
        return source

    def _range(self, start: int, follow: dict[int, dict[int, None]], low: int, high: int) -> dict[int, int | None]:
        """What is reached from start between two places, breadth first, each with where it was reached from."""
        came: dict[int, int | None] = {start: None}
        queue = deque([start])
        while queue:
            at = queue.popleft()
            for to in follow[at]:
                if to not in came and low <= self.place[to] <= high:
                    came[to] = at
                    queue.append(to)
        return came

    def add(self, a: int, b: int, source: str) -> str:
        if a == b:
            return "self"
        if (a, b) in self.source:
            return "exists"
        while self.place[b] < self.place[a]:
            low, high = self.place[b], self.place[a]
            came = self._range(b, self.after, low, high)
            if a not in came:
                behind = self._range(a, self.before, low, high)
                moved = [*sorted(behind, key=self.place.get), *sorted(came, key=self.place.get)]
                for v, place in zip(moved, sorted(self.place[v] for v in moved), strict=True):
                    self.place[v] = place
                break
            path, at = [], a
            while came[at] is not None:
                path.append((came[at], at))
                at = came[at]
            weak = [e for e in path if self.source[e] == "preseed"]
            if not weak:
                return "cycle"
            for e in weak:
                self.drop(*e)
        self.source[a, b] = source
        self.after[a][b] = self.before[b][a] = None
        return "added"


def _foreseen(pairs: list[tuple[int, int]]) -> list[int]:
    """All scars of a log, those with the fewest younger ones left first: nearly the row that its comparisons will ask for."""
    follow: dict[int, list[int]] = {}
    left: dict[int, int] = {}
    for a, b in pairs:
        follow.setdefault(a, []).append(b)
        left.setdefault(a, 0)
        left[b] = left.get(b, 0) + 1
    queue = [(n, v) for v, n in left.items()]
    heapq.heapify(queue)
    row = []
    while queue:
        n, v = heapq.heappop(queue)
        if left.get(v) != n:
            continue
        del left[v]
        row.append(v)
        for to in follow.get(v, ()):
            if to in left:
                left[to] -= 1
                heapq.heappush(queue, (left[to], to))
    return row


def _replay(log: pd.DataFrame) -> tuple[dict[tuple[int, int], str], list[tuple[int, str]]]:
    now, outcomes = _Comparisons(), []
    adds = log[(log["op"] == "add") & (log["younger"] != log["older"])]
    for v in _foreseen(list(zip(adds["younger"].tolist(), adds["older"].tolist(), strict=True))):
        now.place[v], now.after[v], now.before[v] = len(now.place), {}, {}
    for r in log.sort_values("seq").itertuples(index=False):
        if r.op == "add":
            outcomes.append((r.seq, now.add(r.younger, r.older, r.source)))
        elif r.op == "remove":
            outcomes.append((r.seq, "removed" if now.drop(r.younger, r.older) else "absent"))
        elif r.op == "clear_preseed":
            for a, b in [e for e, s in now.source.items() if s == "preseed"]:
                now.drop(a, b)
            outcomes.append((r.seq, "cleared"))
    return now.source, outcomes


def replay_comparisons(log: DataFrame) -> DataFrame:
    """mesh_id, younger, older, source: what stays of a comparison_log (seq, op, younger, older, source).

    Entries count in order: a comparison that closes a cycle drops the preseed ones on
    the shortest path against it, and is rejected if that path is all expert.  A fold
    of one mesh's log, with its comparisons in memory; meshes run in parallel.
    """
    kind = dict(log.dtypes)[M]

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        edges, _ = _replay(g)
        return pd.DataFrame([(g[M].iloc[0], a, b, s) for (a, b), s in edges.items()], columns=[M, "younger", "older", "source"])

    return log.groupBy(M).applyInPandas(fold, f"{M} {kind}, younger int, older int, source string")


def comparison_outcomes(log: DataFrame) -> DataFrame:
    """mesh_id, seq, outcome of every log entry."""
    kind = dict(log.dtypes)[M]

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(g[M].iloc[0], s, o) for s, o in _replay(g)[1]], columns=[M, "seq", "outcome"])

    return log.groupBy(M).applyInPandas(fold, f"{M} {kind}, seq int, outcome string")


def reachable(comparisons: DataFrame) -> DataFrame:
    """mesh_id, younger, older: the transitive closure, path lengths doubling each round."""
    now = tabled(comparisons.select(M, "younger", "older").distinct())
    for _ in range(MAX_ROUNDS):
        longer = now.alias("a").join(now.select(M, F.col("younger").alias("older"), F.col("older").alias("end")), [M, "older"]).select(M, "younger", F.col("end").alias("older"))
        new = tabled(now.unionByName(longer).distinct())
        if new.count() == now.count():
            return new
        now = new
    raise RuntimeError("no fixpoint")


def reaches(pairs: DataFrame, comparisons: DataFrame, order: DataFrame) -> DataFrame:
    """mesh_id, a, b, reached of every asked pair (mesh_id, a, b), without the closure.

    ``order`` (topological_order) is the index: a path only goes on to later places, so a
    search drops what stands behind its goal, and what comes back from a cycle, which has
    no place, is kept.  All pairs search together, one step a round, each scar once a pair.
    """
    place = lambda scar, name: order.select(M, F.col("scar_id").alias(scar), F.col("position").alias(name))
    asked = tabled(pairs.select(M, "a", "b").distinct().join(place("b", "goal"), [M, "b"], "left"))
    steps = comparisons.select(M, F.col("younger").alias("at"), F.col("older").alias("to")).distinct()
    steps = tabled(steps.join(place("to", "place"), [M, "to"], "left"))
    front = asked.withColumn("at", F.col("a"))
    seen, found = front.select(M, "a", "b", "at"), None
    while True:
        met = front.join(steps, [M, "at"]).select(M, "a", "b", "goal", F.col("to").alias("at"), "place").distinct()
        met = tabled(met.where("at = b or goal is null or place is null or place < goal"))
        hit = met.where("at = b").select(M, "a", "b").distinct()
        found = hit if found is None else found.unionByName(hit)
        front = tabled(met.drop("place").join(hit, [M, "a", "b"], "left_anti").join(seen, [M, "a", "b", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select(M, "a", "b", "at"))
    done = tabled(found.distinct()).withColumn("reached", F.lit(True))
    return asked.select(M, "a", "b").join(done, [M, "a", "b"], "left").fillna(False, ["reached"])


def _queue(g: pd.DataFrame) -> pd.DataFrame:
    """The order of one mesh by a queue: younger, older; older null for a node."""
    link = g["older"].notna()
    degree = dict.fromkeys(g["younger"][~link].tolist(), 0)
    follow: dict[int, list[int]] = {}
    for a, b in zip(g["younger"][link].tolist(), g["older"][link].astype(int).tolist(), strict=True):
        follow.setdefault(a, []).append(b)
        degree[b] += 1
    queue = deque(sorted(v for v, n in degree.items() if not n))
    out = []
    while queue:
        at = queue.popleft()
        out.append(at)
        for to in follow.get(at, ()):
            degree[to] -= 1
        queue.extend(sorted(to for to in follow.get(at, ()) if not degree[to]))
    return pd.DataFrame({M: g[M].iloc[0], "scar_id": out, "position": range(len(out))})


def topological_order(nodes: DataFrame, comparisons: DataFrame, small: int = SMALL) -> DataFrame:
    """mesh_id, scar_id, position: youngest first, level by level; nodes on or behind a cycle are left out.

    A queue's order is (level, position of the predecessor that freed the node, id).
    Meshes of at most ``small`` comparisons are queued in a task each; the larger ones
    advance one level a round, which writes that level and the counts of the nodes that it
    has met but not freed, never all of them.
    """
    kinds = dict(nodes.dtypes)
    edges = tabled(comparisons.select(M, "younger", "older").distinct().join(nodes.select(M, F.col("scar_id").alias("older")), [M, "older"], "left_semi"))
    large = tabled(edges.groupBy(M).agg(F.count("*").alias("n")).where(F.col("n") > small).select(M))
    rows = nodes.select(M, F.col("scar_id").alias("younger"), F.lit(None).cast(kinds["scar_id"]).alias("older")).unionByName(edges)
    out = f"{M} {kinds[M]}, scar_id {kinds['scar_id']}, position long"
    done = rows.join(large, M, "left_anti").groupBy(M).applyInPandas(_queue, out)
    if large.isEmpty():
        return done
    edges = tabled(edges.join(large, M, "left_semi"))
    degree = tabled(edges.groupBy(M, F.col("older").alias("scar_id")).agg(F.count("*").alias("indegree")))
    roots = nodes.select(M, "scar_id").join(large, M, "left_semi").join(degree, [M, "scar_id"], "left_anti")
    byid = F.row_number().over(Window.partitionBy(M).orderBy("scar_id")) - 1
    level = tabled(roots.select(M, "scar_id", byid.cast("long").alias("position")))
    taken = tabled(level.groupBy(M).agg(F.count("*").alias("before")))
    waiting = tabled(degree.limit(0).select(M, "scar_id", F.col("indegree").alias("met")))
    levels = [level]
    for _ in range(100_000):
        hit = edges.join(level.select(M, F.col("scar_id").alias("younger"), "position"), [M, "younger"])
        hit = hit.groupBy(M, F.col("older").alias("scar_id")).agg(F.count("*").alias("met"), F.max("position").alias("by"))
        hit = tabled(hit.join(degree, [M, "scar_id"]).join(waiting.withColumnRenamed("met", "had"), [M, "scar_id"], "left").withColumn("met", F.col("met") + F.coalesce("had", F.lit(0))).drop("had"))
        place = F.row_number().over(Window.partitionBy(M).orderBy("by", "scar_id")) - 1
        level = tabled(hit.where("met = indegree").join(taken, M).select(M, "scar_id", (F.col("before") + place).alias("position")))
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, levels, done)
        levels.append(level)
        waiting = tabled(waiting.join(hit.select(M, "scar_id"), [M, "scar_id"], "left_anti").unionByName(hit.where("met < indegree").select(M, "scar_id", "met")))
        more = level.groupBy(M).agg(F.count("*").alias("more"))
        taken = tabled(taken.join(more, M, "left").select(M, (F.col("before") + F.coalesce("more", F.lit(0))).alias("before")))
    raise RuntimeError("too many levels")


def oldest_first(order: DataFrame, explicit: DataFrame) -> DataFrame:
    """mesh_id, scar_id, temporal_order (1: oldest): the explicit order of a mesh that has one, else the reverse of the topological one."""
    n = Window.partitionBy(M)
    derived = order.select(M, "scar_id", (F.max("position").over(n) - F.col("position") + 1).alias("temporal_order"))
    own = derived.join(explicit.select(M).distinct(), M, "left_anti")
    return own.unionByName(explicit.select(M, "scar_id", F.col("temporal_order").cast("long").alias("temporal_order")))


def fully_ordered(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """mesh_id, fully_ordered: whether the order covers every node."""
    a = nodes.groupBy(M).agg(F.count("*").alias("n"))
    b = order.groupBy(M).agg(F.count("*").alias("m"))
    return a.join(b, M, "left").select(M, (F.col("n") == F.coalesce("m", F.lit(0))).alias("fully_ordered"))


def preseed_by_size(scar_edges: DataFrame, scars: DataFrame) -> DataFrame:
    """mesh_id, younger, older, source: of each touching pair the smaller scar is the younger (the first on ties)."""
    a = scars.select(M, F.col("scar_id").alias("scar_a"), F.col("vertex_count").alias("na"))
    b = scars.select(M, F.col("scar_id").alias("scar_b"), F.col("vertex_count").alias("nb"))
    rows = scar_edges.join(a, [M, "scar_a"]).join(b, [M, "scar_b"])
    first = F.col("na") <= F.col("nb")
    return rows.select(M, F.when(first, F.col("scar_a")).otherwise(F.col("scar_b")).alias("younger"), F.when(first, F.col("scar_b")).otherwise(F.col("scar_a")).alias("older"), F.lit("preseed").alias("source"))


def from_global_order(scar_edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """mesh_id, younger, older, source: of each touching pair the one of the higher rank is younger; pairs without both ranks are skipped."""
    a = ranks.select(M, F.col("scar_id").alias("scar_a"), F.col("rank").alias("ra"))
    b = ranks.select(M, F.col("scar_id").alias("scar_b"), F.col("rank").alias("rb"))
    rows = scar_edges.join(a, [M, "scar_a"]).join(b, [M, "scar_b"])
    up = F.col("ra") > F.col("rb")
    return rows.select(M, F.when(up, F.col("scar_a")).otherwise(F.col("scar_b")).alias("younger"), F.when(up, F.col("scar_b")).otherwise(F.col("scar_a")).alias("older"), F.lit("expert").alias("source"))


def comparisons_of(comparisons: DataFrame, scar_id: int) -> DataFrame:
    """comparisons with ``side``: younger or older, of one scar."""
    return comparisons.where((F.col("younger") == scar_id) | (F.col("older") == scar_id)).withColumn("side", F.when(F.col("younger") == scar_id, "younger").otherwise("older"))


def serialise(scars: DataFrame, scar_edges: DataFrame, comparisons: DataFrame) -> DataFrame:
    """mesh_id, state: scars, edges (statistics to four places) and comparisons as version 1 JSON."""
    lists = [
        scars.groupBy(M).agg(F.array_sort(F.collect_list(F.struct("scar_id", "representative_vertex", "vertex_count"))).alias("scars")),
        scar_edges.groupBy(M).agg(F.array_sort(F.collect_list(F.struct("scar_a", "scar_b", F.round("sharpness", 4).alias("sharpness"), F.round("roughness", 4).alias("roughness"), "boundary_size"))).alias("edges")),
        comparisons.groupBy(M).agg(F.array_sort(F.collect_list(F.struct("younger", "older", "source"))).alias("comparisons")),
    ]
    rows = lists[0].join(lists[1], M, "left").join(lists[2], M, "left")
    return rows.select(M, F.to_json(F.struct(F.lit(1).alias("version"), "scars", "edges", "comparisons")).alias("state"))


STATE = "struct<version:int,scars:array<struct<scar_id:int,representative_vertex:bigint,vertex_count:bigint>>,comparisons:array<struct<younger:int,older:int,source:string>>>"


def restorable(states: DataFrame, scars: DataFrame) -> DataFrame:
    """mesh_id, younger, older, source of saved states whose representative vertices are today's."""
    saved = states.select(M, F.from_json("state", STATE).alias("s"))
    old = saved.select(M, "s", F.array_sort(F.transform("s.scars", lambda x: x["representative_vertex"])).alias("was"))
    now = scars.groupBy(M).agg(F.array_sort(F.collect_set("representative_vertex")).alias("now"))
    ok = old.join(now, M).where("was = now and s.version = 1")
    return ok.select(M, F.explode("s.comparisons").alias("c")).select(M, "c.younger", "c.older", "c.source")


def display_order(scars: DataFrame, ranks: DataFrame) -> DataFrame:
    """mesh_id, scar_id, shown (from 1): ranked scars by rank, then the others by id."""
    rows = scars.select(M, "scar_id").join(ranks.select(M, "scar_id", "rank"), [M, "scar_id"], "left")
    return rows.withColumn("shown", F.row_number().over(Window.partitionBy(M).orderBy(F.col("rank").asc_nulls_last(), "scar_id")))
