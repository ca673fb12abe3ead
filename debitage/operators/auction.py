"""Optimal matching of overlap graphs of any size: labels bid for each other in rounds of joins."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debitage.iterate import tabled
from debitage.operators.topology import M

#: Values are whole numbers: this many steps to an IoU of one, times one more than the labels of the largest component.
STEPS = 1 << 30
#: The first phase's least raise of a bid is an IoU of one by this; from phase to phase it falls by this factor, down to one step.
FALL = 1000
#: Around bidders without a good, holders so many bids away take part in a round.
REACH = 4
#: Bids of a task's labels in one round stop here; who is left without a mate bids again in the next.
BIDS = 2_000_000
ROUNDS = 10_000


def settle(bidder: np.ndarray, good: np.ndarray, value: np.ndarray, price: np.ndarray, owned: np.ndarray, raise_by: int, bids: int = BIDS) -> list[tuple[int, int, int]]:
    """(good, bidder, price) of the goods that were bid for among the bidders of one task.

    A row is what a bidder would give for a good at its price; owned marks the good it
    holds.  A bidder without a good takes its best one and pays what makes it as good as
    its second best, and raise_by more; its holder, where it is of this task, bids again.
    """
    ids, at = np.unique(bidder, return_inverse=True)
    goods, good_at = np.unique(good, return_inverse=True)
    cost, holder, touched = [0] * len(goods), [-1] * len(goods), set()
    offers: list[list[tuple[int, int]]] = [[] for _ in ids]
    free = set(range(len(ids)))
    for i, g, v, p, own in zip(at.tolist(), good_at.tolist(), value.tolist(), price.tolist(), owned.tolist(), strict=True):
        offers[i].append((g, v))
        cost[g] = p
        if own:
            holder[g] = i
            free.discard(i)
    waiting = deque(sorted(free))
    while waiting and bids:
        bids -= 1
        i = waiting.popleft()
        best = first = second = None
        for g, v in offers[i]:
            gain = v - cost[g]
            if first is None or gain > first:
                best, first, second = g, gain, first
            elif second is None or gain > second:
                second = gain
        cost[best] += first - second + raise_by
        if holder[best] >= 0:
            waiting.append(holder[best])
        holder[best] = i
        touched.add(best)
    return [(int(goods[g]), int(ids[holder[g]]), cost[g]) for g in sorted(touched)]


def auction(pairs: DataFrame, block: int) -> DataFrame:
    """mesh_id, gt, pred: a matching of the largest total IoU of pairs (mesh_id, component, gt, pred, iou).

    Every label is a bidder and a good at once.  A bidder may have any label that it
    overlaps at the value of their IoU, or itself at none; so the bidders of every task
    can always be served, and what ground truth takes from predictions is the matching.
    A component of at most ``block`` offers is settled in a task.  In larger ones the
    bidders without a good and those around them are dealt anew each round to tasks of
    about so many offers and settle among themselves at the prices they know; a good goes
    to the highest of its bids, others bid again.  Prices only rise, so what holds for a
    bidder in its task holds after the round too.  The phases' raises fall to one step:
    all labels' together are then less than any two totals can differ by, as values are
    multiples of more steps than there are labels.  So the last phase is exact, to
    1 / 2**30 of an IoU a pair.  Of equally good matchings it gives one.
    """
    ends = pairs.select(M, "component", (F.col("gt").cast("long") * 2).alias("a"), (F.col("pred").cast("long") * 2 + 1).alias("b"), F.round(F.col("iou") * STEPS).cast("long").alias("value"))
    both = ends.unionByName(ends.select(M, "component", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    selves = both.select(M, "component", "a").distinct().select(M, "component", "a", F.col("a").alias("b"), F.lit(0).cast("long").alias("value"))
    offers = tabled(both.unionByName(selves).withColumnsRenamed({"a": "bidder", "b": "good"}))
    sizes = offers.groupBy(M, "component").agg(F.count("*").alias("offers"), F.count_if(F.col("bidder") == F.col("good")).alias("labels"))
    largest = sizes.agg(F.max("labels"), F.sum("labels")).first()
    if largest[0] is None:
        return pairs.select(M, F.col("gt").cast("long").alias("gt"), F.col("pred").cast("long").alias("pred")).limit(0)
    scale = largest[0] + 1
    offers = offers.withColumn("value", F.col("value") * scale)
    small = F.col("offers") <= block
    raises = [STEPS * scale // FALL]
    while raises[-1] > 1:
        raises.append(max(1, raises[-1] // FALL))

    def solve(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        price: dict[int, int] = {}
        for raise_by in raises:
            known = p["good"].map(price) if price else p["good"] * 0
            rows = settle(p["bidder"].to_numpy(), p["good"].to_numpy(), p["value"].to_numpy(), known.to_numpy("int64"), np.zeros(len(p), bool), raise_by, bids=-1)
            price |= {good: cost for good, _, cost in rows}
        out = pd.DataFrame([(good, holder) for good, holder, _ in rows], columns=["good", "holder"], dtype="int64")
        out.insert(0, M, key[0])
        return out

    kind = dict(pairs.dtypes)[M]
    won = offers.join(sizes.where(small), [M, "component"], "left_semi").groupBy(M, "component").applyInPandas(solve, f"{M} {kind}, good long, holder long")
    wide = tabled(offers.join(sizes.where(~small), [M, "component"], "left_semi"))
    labels = wide.where("bidder = good").count()
    if labels:
        state = wide.where("bidder = good").select(M, "component", "good", F.lit(0).cast("long").alias("price"), F.lit(None).cast("long").alias("holder"))
        for raise_by in raises:
            state = _phase(wide, tabled(state.withColumn("holder", F.lit(None).cast("long"))), labels, raise_by, block)
        won = won.unionByName(state.select(M, "good", "holder"))
    won = won.where("holder % 2 = 0 and good % 2 <> 0")
    return won.select(M, (F.col("holder") / 2).cast("long").alias("gt"), ((F.col("good") - 1) / 2).cast("long").alias("pred"))


def _around(offers: DataFrame, state: DataFrame, block: int, turn: int) -> DataFrame:
    """offers of the bidders without a good and of those near them, dealt to tasks."""
    held = state.where("holder is not null").select(M, "good", F.col("holder").alias("bidder"))
    near = offers.where("bidder = good").select(M, "bidder").join(held.select(M, "bidder"), [M, "bidder"], "left_anti")
    for _ in range(REACH):
        wanted = offers.join(near, [M, "bidder"], "left_semi").select(M, "good").distinct()
        near = near.unionByName(held.join(wanted, [M, "good"]).select(M, "bidder")).distinct()
    own = tabled(offers.join(near, [M, "bidder"], "left_semi"))
    tasks = own.groupBy(M, "component").agg(F.ceil(F.count("*") / block).alias("tasks"))
    return own.join(tasks, [M, "component"]).withColumn("task", F.pmod(F.xxhash64("bidder", F.lit(turn)), F.col("tasks")))


def _phase(offers: DataFrame, state: DataFrame, labels: int, raise_by: int, block: int) -> DataFrame:
    """state (mesh_id, component, good, price, holder) once every label has a holder."""
    kinds = dict(state.dtypes)

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        rows = settle(*(p[c].to_numpy() for c in ("bidder", "good", "value", "price", "owned")), raise_by)
        out = pd.DataFrame(rows, columns=["good", "holder", "price"], dtype="int64")
        out.insert(0, "component", key[1])
        out.insert(0, M, key[0])
        return out

    for turn in range(ROUNDS):
        if state.where("holder is not null").count() == labels:
            return state
        known = _around(offers, state, block, turn).join(state.drop("component"), [M, "good"])
        known = known.withColumn("owned", F.coalesce(F.col("holder") == F.col("bidder"), F.lit(False)))
        bids = known.groupBy(M, "component", "task").applyInPandas(run, f"{M} {kinds[M]}, component {kinds['component']}, good long, holder long, price long")
        every = state.unionByName(bids)
        state = tabled(every.groupBy(M, "component", "good").agg(F.max(F.struct("price", "holder")).alias("top")).select(M, "component", "good", "top.price", "top.holder"))
    raise RuntimeError(f"bids go on after {ROUNDS} rounds")
