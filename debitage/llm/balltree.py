"""Ranked lexical search: exact inner products by sparse ball trees.

A document is a sparse vector of one integer weight a term, an item another, and a score
is their inner product.  The items' terms are the only ones that matter, so each
task turns its documents into sparse vectors over them and, slice by slice, builds a ball
tree: halves are split between two far vectors, and every node has its centroid and, for
each of ``GROUPS`` groups of terms, the radius around it.  A node's products with an item
are at most the centroid's plus, group by group, the radius times the length of the item
in the node's own terms (Cauchy-Schwarz); both are rounded up by more than arithmetic can lose.  Nodes are
opened best bound first until no bound reaches the k-th score found so far in the
task, and leaves are scored exactly in integers.

Items go in blocks of a bounded size, each block with a scan for the counts and one for
the search; a task hands over k rows an item.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import materialise
from debitage.llm.wordhash import LOWER, buffers, slices, spans

TOP = 10
#: Items and words of one block: both bound the vocabulary that a task holds.
ITEMS, WORDS = 4096, 60_000
#: Documents of a leaf and of a tree, weights of a tree, groups of terms that have a radius of their own.
LEAF, SLICE, WEIGHTS, GROUPS = 64, 4096, 2_000_000, 64
#: By how much bounds are widened: far beyond the rounding of sums of doubles.
SAFE = 1e-9
#: Merges go by item and one of so many parts first.
PARTS = 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a batch of texts, one after another, and how many each text has."""
    data, offsets = buffers(texts)
    low = LOWER[data]
    _, length, first, word = spans(low, offsets)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    words = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(low[word]))
    return words, np.diff(first)


@dataclass
class Items:
    """A block of items: their ids, and for each its terms (places in the vocabulary) and how often it has them."""

    ids: list[int | None]
    vocabulary: pa.Array
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        words, many = words_of(pa.array([t for _, t in rows], pa.string()))
        coded = words.dictionary_encode()
        codes, ends = np.asarray(coded.indices), np.concatenate([[0], np.cumsum(many)])
        own = [np.unique(codes[i:j], return_counts=True) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return cls([i for i, _ in rows], coded.dictionary, [t for t, _ in own], [n.astype(np.int64) for _, n in own])


def counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, term, times of every term of the vocabulary in a batch, and the terms of any kind of each text."""
    words, many = words_of(texts)
    found = pc.index_in(words, value_set=vocabulary)
    met = np.flatnonzero(np.asarray(found.is_valid()))
    text = np.repeat(np.arange(len(texts)), many)[met]
    pair, times = np.unique(text * len(vocabulary) + np.asarray(found.fill_null(0))[met], return_counts=True)
    return pair // max(len(vocabulary), 1), pair % max(len(vocabulary), 1), times.astype(np.int64), many


def importance(many_docs: int, holding: int) -> int:
    """A term's weight, by the documents and those that hold it."""
    return math.floor(1000 * math.log((2.0 * many_docs + 2) / (2.0 * holding + 1)))


def components(times: np.ndarray, length: np.ndarray, many_docs: int, total: int) -> np.ndarray:
    """A document's weight of a term: times it holds it, among its own number of terms."""
    if 75 * int(length.max(initial=0)) * many_docs < 1 << 63:
        m = 25 + 75 * length * many_docs // total
    else:  # beyond 64 bits
        m = np.array([25 + 75 * n * many_docs // total for n in length.tolist()], np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * m)


class Tree:
    """A ball tree over sparse rows (first, term, weight); none is empty.

    ``order`` has the rows' numbers as the leaves hold them; nodes are (begin, end) of it.
    """

    def __init__(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int):
        n = len(first) - 1
        self.n_terms, self.order = n_terms, np.arange(n)
        self.first, self.term, self.weight = first, term, weight
        self.nodes: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.centre = np.zeros((max(1, 4 * -(-n // LEAF)), n_terms))
        self.radius = np.zeros((len(self.centre), GROUPS))
        if n:
            self._grow(0, n)
        self.centre, self.radius = self.centre[: len(self.nodes)], self.radius[: len(self.nodes)]

    def _grow(self, begin: int, end: int) -> int:
        node = len(self.nodes)
        self.nodes.append((begin, end))
        self.children.append(None)
        a, b = self.first[begin], self.first[end]
        term, weight = self.term[a:b], self.weight[a:b].astype(float)
        row = np.repeat(np.arange(end - begin), np.diff(self.first[begin : end + 1]))
        centre = np.bincount(term, weights=weight, minlength=self.n_terms) / (end - begin)
        group = term % GROUPS
        own = np.bincount(np.arange(self.n_terms) % GROUPS, weights=centre**2, minlength=GROUPS)
        square = np.bincount(row * GROUPS + group, weights=weight**2, minlength=(end - begin) * GROUPS).reshape(-1, GROUPS)
        cross = np.bincount(row * GROUPS + group, weights=weight * centre[term], minlength=(end - begin) * GROUPS).reshape(-1, GROUPS)
        apart = np.maximum(square - 2 * cross + own, 0)
        self.centre[node] = centre
        self.radius[node] = np.sqrt(apart.max(0) + SAFE * (square.max(0) + own))
        if end - begin > LEAF:
            middle = (begin + end) // 2
            self._split(begin, end, row, term, weight, apart.sum(1), square.sum(1))
            self.children[node] = (self._grow(begin, middle), self._grow(middle, end))
        return node

    def _split(self, begin: int, end: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, apart: np.ndarray, square: np.ndarray) -> None:
        """Order the rows of a node by which of two far ones they are nearer to."""

        def products(k: int) -> np.ndarray:
            dense = np.zeros(self.n_terms)
            own = slice(self.first[begin + k] - self.first[begin], self.first[begin + k + 1] - self.first[begin])
            dense[term[own]] = weight[own]
            return np.bincount(row, weights=weight * dense[term], minlength=end - begin)

        one = int(apart.argmax())
        by_one = products(one)
        two = int((square - 2 * by_one).argmax())
        places = np.argsort((products(two) - by_one) - (square[two] - square[one]) / 2, kind="stable")
        lengths = np.diff(self.first[begin : end + 1])[places]
        base = self.first[begin]
        take = np.repeat(self.first[begin:end][places], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.term[base : base + len(take)], self.weight[base : base + len(take)] = self.term[take], self.weight[take]
        self.order[begin:end] = self.order[begin:end][places]
        self.first[begin + 1 : end + 1] = base + np.cumsum(lengths)

    def bounds(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What no product of a node's rows with these terms exceeds; terms that none of its rows holds count for nothing."""
        order = np.argsort(terms % GROUPS, kind="stable")
        groups, starts = np.unique(terms[order] % GROUPS, return_index=True)
        centre = self.centre[:, terms[order]]
        lengths = np.sqrt(np.add.reduceat((centre > 0) * values[order].astype(float) ** 2, starts, axis=1))
        return (centre @ values[order] + (self.radius[:, groups] * lengths).sum(1)) * (1 + SAFE) + 1

    def search(self, terms: np.ndarray, values: np.ndarray, best: list, k: int, ids: np.ndarray, known: np.ndarray) -> int:
        """Take the k best rows into best, (-score, no id, id) in order; the number of leaves scored."""
        bound = self.bounds(terms, values)
        dense = np.zeros(self.n_terms, np.int64)
        dense[terms] = values
        waiting, scored = [(-bound[0], 0)], 0
        while waiting:
            reach, node = heapq.heappop(waiting)
            if len(best) == k and -reach < -best[-1][0]:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(waiting, (-bound[child], child))
                continue
            scored += 1
            begin, end = self.nodes[node]
            a, b = self.first[begin], self.first[end]
            score = np.add.reduceat(self.weight[a:b] * dense[self.term[a:b]], self.first[begin:end] - a)
            for i in np.flatnonzero(score >= max(1, -best[-1][0] if len(best) == k else 1)).tolist():
                at = self.order[begin + i]
                best.append((-int(score[i]), not known[at], int(ids[at])))
            best.sort()
            del best[k:]
        return scored


def _counts(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """Documents that have terms, all their terms, and the documents that hold each term of the items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding = np.zeros(len(items.vocabulary) + 2, np.int64)
        for b in slices(batches):
            _, term, _, many = counted(b.column(0), items.vocabulary)
            holding[:-2] += np.bincount(term, minlength=len(items.vocabulary))
            holding[-2:] += [(many > 0).sum(), many.sum()]
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(holding[some])], ["term", "many"])

    held = docs.select("text").mapInArrow(count, "term int, many long").groupBy("term").agg(F.sum("many").alias("many"))
    out = np.zeros(len(items.vocabulary) + 2, np.int64)
    for r in held.collect():  # a row a term of the block
        out[r["term"]] = r["many"]
    return int(out[-2]), int(out[-1]), out[:-2]


def _found(docs: DataFrame, items: Items, k: int, first_key: int) -> DataFrame:
    """key (of the item), item_id, doc_id, score, part: the k best documents that each task has for each item."""
    many_docs, total, holding = _counts(docs, items)
    weight = np.array([importance(many_docs, n) for n in holding.tolist()], np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items.ids]
        held: list[tuple] = []

        def flush() -> None:
            rows = sum(len(x[0]) for x in held)
            if not rows:
                return
            per, term, value, ids, known = (np.concatenate([x[i] for x in held]) for i in range(5))
            tree = Tree(np.concatenate([np.zeros(1, np.int64), np.cumsum(per)]), term, value, len(items.vocabulary))
            for terms, times, own in zip(items.terms, items.repeats, best, strict=True):
                if len(terms):
                    tree.search(terms, times * weight[terms], own, k, ids, known)
            held.clear()

        for b in slices(batches):
            text, term, times, many = counted(b.column(1), items.vocabulary)
            if not len(text):
                continue
            at, per = np.unique(text, return_counts=True)
            ids = b.column(0)
            value = components(times, many[text], many_docs, total)
            for i in range(0, len(at), SLICE):
                own = slice(per[:i].sum(), per[: i + SLICE].sum())
                held.append((per[i : i + SLICE], term[own], value[own], np.asarray(ids.fill_null(0))[at[i : i + SLICE]], np.asarray(ids.is_valid())[at[i : i + SLICE]]))
                if sum(len(x[0]) for x in held) >= SLICE or sum(len(x[1]) for x in held) >= WEIGHTS:
                    flush()
        flush()
        out = [(first_key + q, items.ids[q], None if no_id else doc, -score) for q, own in enumerate(best) for score, no_id, doc in own]
        cols = list(zip(*out, strict=True)) or [()] * 4
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([part] * len(out), pa.int32())], ["key", "item_id", "doc_id", "score", "part"])

    return docs.mapInArrow(search, "key long, item_id long, doc_id long, score long, part int")


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of at most about ITEMS items and WORDS words (an item of more has its own), one block in memory at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-(size["chars"] or 0) // (6 * WORDS)))
    for k in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Items.of([tuple(r) for r in own.collect()])


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of every row of benchmark (item_id, text).

    Documents of score 0 are never found; equal scores go by ascending doc_id with null
    last.  Null and wordless texts hold no terms, count as no document and find nothing;
    every repeated row of either table counts for itself, so a repeated item has its ranks
    once for each of its rows; empty tables give an empty result; further columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, key = None, 0
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for items in _blocks(benchmark):
        found = _found(docs, items, k, key)
        key += len(items.ids)
        for by in (["key", "part"], ["key"]):  # at most PARTS * k rows an item meet in the second
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        found = materialise(found.select("item_id", "rank", "doc_id", "score"))
        out = found if out is None else out.unionByName(found)
    return out


def oracle() -> str:
    """DuckDB SQL for ranked() over documents and benchmark."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
    with d as (select doc_id, row_number() over () as rk, {words} as w from documents),
    i as (select item_id, row_number() over () as ik, {words} as w from benchmark),
    c as (select count(*) as n, sum(len(w))::bigint as l from d where len(w) > 0),
    q as (select ik, f, count(*) as r from (select ik, unnest(w) as f from i) group by all),
    t as materialized (select rk, f, count(*) as tf from (select rk, unnest(w) as f from d) group by all),
    g as (select f, floor(1000 * ln((2.0::double * n + 2) / (2.0::double * df + 1)))::bigint as g from (select f, count(*) as df from t group by f) cross join c),
    m as (select rk, doc_id, 25 + (75 * len(w) * n) // l as m from d cross join c),
    s as (select ik, rk, sum(r * g * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score, any_value(doc_id) as doc_id from q join t using (f) join g using (f) join m using (rk) group by ik, rk),
    o as (select *, row_number() over (partition by ik order by score desc, doc_id nulls last) as rank from s where score > 0)
    select item_id, rank::int as rank, doc_id, score from o join i using (ik) where rank <= {TOP}
    """
