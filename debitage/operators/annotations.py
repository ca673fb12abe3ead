"""Annotation sets, the versioned library, metadata and review queues."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from debitage.functions.scalars import YEAR_2000_MS, YEAR_2100_MS, csv_escape
from debitage.operators.topology import M

A = "annotation_id"
# Metadata keys that hold an annotation's metadata as an object, and others that belong to it.
NESTED_KEYS = ("annotation-metadata", "state-metadata")
ANNOTATION_KEYS = ("evaluation", "model_params", "annotator", "annotation_date", "annotation_source")
HISTORY = 100


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Set union of (annotation_id, vertex_id)."""
    return edges.unionByName(new).distinct()


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Set difference."""
    return edges.join(gone, [A, "vertex_id"], "left_anti").distinct()


def zeroed(labels: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Segment labels with 0 on vertices that became edges."""
    mark = new_edges.select(M, "vertex_id").distinct().withColumn("_e", F.lit(0))
    return labels.join(mark, [M, "vertex_id"], "left").select(M, "vertex_id", F.coalesce("_e", "label").alias("label"))


def same_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """left_id, right_id, same: whether two annotations have the same set of vertices."""
    own = edges.select(A, "vertex_id").distinct()
    stats = own.groupBy(A).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("vertex_id")).alias("h"), F.sum(F.xxhash64("vertex_id").cast("decimal(38,0)")).alias("s"))
    side = lambda name: stats.select(F.col(A).alias(f"{name}_id"), F.struct("n", "h", "s").alias(name))
    rows = pairs.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    return rows.select("left_id", "right_id", F.col("left").eqNullSafe(F.col("right")).alias("same"))


def same_arrows(pairs: DataFrame, arrows: DataFrame) -> DataFrame:
    """left_id, right_id, same: whether two annotations have the same arrows in order."""
    lists = arrows.groupBy(A).agg(F.array_sort(F.collect_list(F.struct("pos", "start_index", "end_index"))).alias("a"))
    seq = lists.select(A, F.transform("a", lambda x: F.struct(x["start_index"], x["end_index"])).alias("a"))
    rows = pairs.join(seq.select(F.col(A).alias("left_id"), F.col("a").alias("l")), "left_id", "left").join(seq.select(F.col(A).alias("right_id"), F.col("a").alias("r")), "right_id", "left")
    return rows.select("left_id", "right_id", F.col("l").eqNullSafe(F.col("r")).alias("same"))


def equal_annotations(pairs: DataFrame, edges: DataFrame, arrows: DataFrame) -> DataFrame:
    a = same_edges(pairs, edges).withColumnRenamed("same", "e")
    return a.join(same_arrows(pairs, arrows), ["left_id", "right_id"]).select("left_id", "right_id", (F.col("e") & F.col("same")).alias("same"))


def unsaved(pairs: DataFrame, edges: DataFrame, arrows: DataFrame) -> DataFrame:
    """left_id, right_id, unsaved: the vertices or the number of arrows differ."""
    n = arrows.groupBy(A).agg(F.count("*").alias("n"))
    side = lambda name: n.select(F.col(A).alias(f"{name}_id"), F.col("n").alias(name))
    rows = same_edges(pairs, edges).join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    return rows.select("left_id", "right_id", (~F.col("same") | (F.coalesce("left", F.lit(0)) != F.coalesce("right", F.lit(0)))).alias("unsaved"))


def to_label_vector(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """mesh_id, vertex_id, label: 1 on edge vertices; ids outside the mesh are dropped."""
    mark = edges.select(M, "vertex_id").distinct().withColumn("label", F.lit(1))
    return vertices.select(M, "vertex_id").join(mark, [M, "vertex_id"], "left").fillna(0, ["label"])


def from_label_vector(labels: DataFrame) -> DataFrame:
    return labels.where("label = 1").select(M, "vertex_id")


def current_edges(events: DataFrame) -> DataFrame:
    """annotation_id, vertex_id of the edges that stand after all events (seq, op draw/erase/restore, vertex_id).

    A restore clears what was before it; then the last operation on a vertex counts.
    """
    floor = events.where("op = 'restore'").groupBy(A).agg(F.max("seq").alias("cut"))
    after = events.where("op in ('draw', 'erase')").join(floor, A, "left").where("cut is null or seq > cut")
    last = after.groupBy(A, "vertex_id").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'draw'").select(A, "vertex_id")


def library(log: DataFrame) -> DataFrame:
    """annotation_id, name, cloud_id, modified_at of a log (seq, op save/update/rename/delete, name, cloud_id, ts).

    The last save or update counts (an update of an unknown id does nothing), a cloud id
    stays until another replaces it, a deleted annotation is gone until saved again.
    """
    w = Window.partitionBy(A).orderBy("seq")
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy(A))
    live = log.withColumn("gone", gone).where("(gone is null or seq > gone) and op <> 'delete'")
    born = F.min(F.when(F.col("op") == "save", F.col("seq"))).over(Window.partitionBy(A))
    live = live.withColumn("born", born).where("born is not null and seq >= born")
    rows = live.select(A, "seq", F.last("name", True).over(w).alias("name"), F.last("cloud_id", True).over(w).alias("cloud_id"), F.col("ts").alias("modified_at"))
    return rows.groupBy(A).agg(F.max(F.struct("seq", "name", "cloud_id", "modified_at")).alias("r")).select(A, "r.name", "r.cloud_id", "r.modified_at")


def newest_first(annotations: DataFrame) -> DataFrame:
    """annotations with ``shown``: 1 for the one modified last, ties by id."""
    return annotations.withColumn("shown", F.row_number().over(Window.partitionBy(M).orderBy(F.col("modified_at").desc_nulls_last(), A)))


def import_by_cloud_id(incoming: DataFrame, linked: DataFrame) -> DataFrame:
    """cloud_id, annotation_id, action: an existing link is updated, else a new annotation is linked."""
    rows = incoming.join(linked.select("cloud_id", F.col(A).alias("existing")), "cloud_id", "left")
    return rows.select("cloud_id", F.coalesce("existing", "new_id").alias(A), F.when(F.col("existing").isNull(), "insert").otherwise("update").alias("action"))


def sync_status(annotations: DataFrame) -> DataFrame:
    """mesh_id, n, unsynced: annotations without a cloud id."""
    return annotations.groupBy(M).agg(F.count("*").alias("n"), F.count(F.when(F.col("cloud_id").isNull(), 1)).alias("unsynced"))


def history_states(log: DataFrame, keep: int = HISTORY) -> DataFrame:
    """mesh_id, position, seq, undone: the undo stack, oldest first, then what can be redone, after a log of act, undo and redo (seq, op).

    An act clears what could be redone; the newest ``keep`` acts are kept.  Logs are dealt
    and sorted by mesh and stream through their task, which holds one pair of stacks.
    Rows without a mesh_id are left out.
    """
    kind = dict(log.dtypes)[M]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, undo, redo = None, deque(maxlen=keep), []

        def rows() -> pd.DataFrame:
            seq = [*undo, *redo[::-1]]
            return pd.DataFrame({M: [now] * len(seq), "position": range(1, len(seq) + 1), "seq": seq, "undone": [i >= len(undo) for i in range(len(seq))]})

        for f in frames:
            for mesh, seq, op in zip(f[M], f["seq"], f["op"], strict=True):
                if mesh != now:
                    if now is not None:
                        yield rows()
                    now, undo, redo = mesh, deque(maxlen=keep), []
                if op == "act":
                    undo.append(seq)
                    redo = []
                elif op == "undo" and undo:
                    redo.append(undo.pop())
                elif op == "redo" and redo:
                    undo.append(redo.pop())
        if now is not None:
            yield rows()

    dealt = log.where(F.col(M).isNotNull()).select(M, "seq", "op").repartition(M).sortWithinPartitions(M, "seq")
    return dealt.mapInPandas(fold, f"{M} {kind}, position int, seq long, undone boolean")


def split_metadata(entries: DataFrame) -> DataFrame:
    """mesh_id, key, value, side (annotation or mesh) of entries (mesh_id, key, value).

    The members of an object under a nested key become entries of the annotation;
    anything else under such a key is dropped.  A member that is also an entry of its
    own stays twice.
    """
    nested = F.col("key").isin(*NESTED_KEYS)
    member = F.from_json(F.when(nested & F.ltrim("value").startswith("{"), F.col("value")), "map<string, string>")
    own = F.when(~nested, F.create_map("key", "value"))
    side = F.when(nested | F.col("key").isin(*ANNOTATION_KEYS), "annotation").otherwise("mesh")
    return entries.where("key is not null").select(M, side.alias("side"), F.explode(F.coalesce(member, own)).alias("key", "value")).select(M, "key", "value", "side")


def as_json(text: Column) -> Column:
    """A value as JSON: objects, arrays, numbers, true and false as they are, other text quoted, null null."""
    bare = text.rlike(r"^\s*[\[{].*[\]}]\s*$") & F.try_parse_json(text).isNotNull() | text.rlike(r"^(true|false|-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?)$")
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(text.isNull(), "null").when(bare, text).otherwise(quoted)


def combine_metadata(entries: DataFrame) -> DataFrame:
    """mesh_id, key, value: mesh entries, and those of the annotation as one object under ``annotation-metadata``, if any."""
    member = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("key").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit(":"), as_json(F.col("value")))
    own = entries.where("side = 'annotation'").groupBy(M).agg(F.array_sort(F.collect_list(member)).alias("members"))
    nested = own.select(M, F.lit("annotation-metadata").alias("key"), F.concat(F.lit("{"), F.array_join("members", ","), F.lit("}")).alias("value"))
    return entries.where("side = 'mesh'").select(M, "key", "value").unionByName(nested)


def metadata_lines(entries: DataFrame) -> DataFrame:
    """mesh_id, line: comment lines; null values and keys with white space are skipped; objects are marked as JSON."""
    rows = entries.where(F.col("value").isNotNull() & ~F.col("key").rlike(r"\s"))
    mark = F.when(F.col("value").rlike(r"^\s*[\[{]"), F.lit("comment metadata:json ")).otherwise(F.lit("comment metadata "))
    return rows.select(M, F.concat(mark, F.col("key"), F.lit(" "), F.col("value")).alias("line"))


_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
#: Objects that begin in one another at their first keys; a string; a bracket or a string; any other value; ends of objects.
_OPEN, _TEXT, _LIST, _BARE, _CLOSE = (re.compile(x, re.DOTALL) for x in (r'(?:\{"[^"\\]*":)+', _STRING, rf"[\[\]]|{_STRING}", r"[^,}\]]+", r"\}+"))


def _leaves(text: str) -> Iterator[tuple[str, str]]:
    """(dotted path, value) of each leaf of an object, of its JSON as Spark writes it, without white space."""
    keys: list[str] = []
    at = 0

    def key(at: int) -> tuple[str, int]:
        end = _TEXT.match(text, at).end()
        own = text[at + 1 : end - 1]
        return (json.loads(f'"{own}"', strict=False) if "\\" in own else own), end + 1

    while True:  # a value begins here
        first = text[at]
        if first == "{":
            if run := _OPEN.match(text, at):
                keys += text[at + 2 : run.end() - 2].split('":{"')
                at = run.end()
                continue
            if text[at + 1] != "}":
                own, at = key(at + 1)
                keys.append(own)
                continue
            at += 2
        else:
            if first == "[":
                depth = 0
                for x in _LIST.finditer(text, at):
                    depth += {"[": 1, "]": -1}.get(x.group(), 0)
                    if not depth:
                        end = x.end()
                        break
            else:
                end = (_TEXT if first == '"' else _BARE).match(text, at).end()
            yield ".".join(keys), text[at:end]
            at = end
        if keys and (run := _CLOSE.match(text, at)):
            del keys[len(keys) - (run.end() - at) :]
            at = run.end()
        if not keys:
            return
        keys[-1], at = key(at + 1)


#: Leaves that are handed on at a time.
LEAVES = 50_000


def flatten_metadata(documents: DataFrame, key: str = M) -> DataFrame:
    """key, path, value (JSON) of nested JSON objects (column ``json``): dotted paths, of any depth.

    Arrays and null are leaves; an empty object has none.  Spark parses and writes each
    document once, and its text is taken apart in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, paths, values = [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())], [key, "path", "value"])

            for i, text in enumerate(b.column(1).to_pylist()):
                for path, value in _leaves(text) if text and text[0] == "{" else ():
                    rows.append(i)
                    paths.append(path)
                    values.append(value)
                    if len(rows) == LEAVES:
                        yield out()
                        rows, paths, values = [], [], []
            if rows:
                yield out()

    # objects are told by their text: a condition on the parsed column would parse it once more
    return documents.select(key, F.to_json(F.try_parse_json("json")).alias("text")).mapInArrow(run, StructType([documents.schema[key], *(StructField(c, StringType()) for c in ("path", "value"))]))


def metadata_csv(mesh: DataFrame, annotation: DataFrame, sources: DataFrame, at: Column) -> DataFrame:
    """mesh_id, header, row: the flat CSV of each mesh of sources (mesh_id, source_file).

    mesh, annotation: metadata as JSON objects (mesh_id, json); nested keys are dotted, those
    of the annotation begin with ``annotation.``; ``exportedAt`` and ``sourceFile`` come
    last.  Fields with commas, quotes or line breaks are quoted; null is empty.
    """
    text = F.when(F.col("value").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")).when(F.col("value") == "null", "").otherwise(F.col("value"))
    flat = lambda df, rank, prefix: flatten_metadata(df).select(M, F.lit(rank).alias("rank"), F.concat(F.lit(prefix), "path").alias("path"), text.alias("text"))
    tail = sources.select(M, F.explode(F.array(F.struct(F.lit(2).alias("rank"), F.lit("exportedAt").alias("path"), at.alias("text")), F.struct(F.lit(3).alias("rank"), F.lit("sourceFile").alias("path"), F.coalesce("source_file", F.lit("")).alias("text")))).alias("t")).select(M, "t.*")
    rows = flat(mesh, 0, "").unionByName(flat(annotation, 1, "annotation.")).unionByName(tail)
    fields = rows.groupBy(M).agg(F.array_sort(F.collect_list(F.struct("rank", "path", "text"))).alias("f"))
    line = lambda c: F.array_join(F.transform("f", lambda x: csv_escape(x[c])), ",")
    return fields.select(M, line("path").alias("header"), line("text").alias("row"))


def review_queue(items: DataFrame, pending_only: bool) -> DataFrame:
    """items with ``position`` in original order: all, or those without a verdict."""
    rows = items.where("verdict is null") if pending_only else items
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("dataset").orderBy("item")) - 1)


def first_unlabelled(items: DataFrame) -> DataFrame:
    """dataset, item of the first item without a verdict."""
    return items.where("verdict is null").groupBy("dataset").agg(F.min("item").alias("item"))


def review_progress(items: DataFrame) -> DataFrame:
    """dataset, verified, pending, total."""
    return items.groupBy("dataset").agg(F.count("verdict").alias("verified"), F.count(F.when(F.col("verdict").isNull(), 1)).alias("pending"), F.count("*").alias("total"))


def effective_parameters(items: DataFrame, states: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """mesh_id and each parameter: the accepted state's, else the default."""
    own = states.where("state = 'verification-accept'").select(M, *(F.col(k).alias(f"_{k}") for k in defaults))
    rows = items.select(M, "verdict").join(own, M, "left")
    return rows.select(M, *(F.when(F.col("verdict") == "accept", F.coalesce(F.col(f"_{k}"), F.lit(v))).otherwise(F.lit(v)).alias(k) for k, v in defaults.items()))


def verdict_records(items: DataFrame, edges: DataFrame) -> DataFrame:
    """mesh_id, state, n_edges: what accepting (its edges) or rejecting (none) stores."""
    n = edges.groupBy(M).agg(F.count("*").alias("n"))
    rows = items.where("verdict is not null").join(n, M, "left")
    return rows.select(M, F.concat(F.lit("verification-"), F.col("verdict")).alias("state"), F.when(F.col("verdict") == "accept", F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_edges"))


def name_search(items: DataFrame, term: str) -> DataFrame:
    """items whose original_name, or else filename, holds the term, case aside; an empty term keeps all."""
    name = F.lower(F.coalesce(F.nullif(F.col("original_name"), F.lit("")), F.col("filename"), F.lit("")))
    return items.where(F.instr(name, term.strip().lower()) > 0) if term.strip() else items


def known_times(entries: DataFrame) -> DataFrame:
    """entries (key, number) with ``at``: numbers that are times in milliseconds, from 2000 to 2100."""
    return entries.where(F.col("number").between(YEAR_2000_MS, YEAR_2100_MS)).withColumn("at", F.timestamp_millis(F.col("number").cast("long")))
