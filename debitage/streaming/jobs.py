"""Structured Streaming jobs over annotation events.

State is kept as it is read: an annotation's edge set as a map by vertex, a history as two
lists.  A batch reads and writes the entries that its events touch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from debitage.operators.annotations import HISTORY, library

#: The state store that keeps maps and lists.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of event ids in the library's log.
BUCKETS = 64


class _Edges(StatefulProcessor):
    """Vertices of an edge set by the epoch in which they were drawn; a restore begins a new one, and older entries count no more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.drawn = handle.getMapState("drawn", "vertex_id long", "epoch long")
        self.now = handle.getValueState("now", "epoch long, n_edges long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        epoch, n = self.now.get() if self.now.exists() else (0, 0)
        last = -1
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            last = int(r.seq)
            if r.op == "restore":
                epoch, n = epoch + 1, 0
                continue
            vertex = (int(r.vertex_id),)
            there = self.drawn.containsKey(vertex) and self.drawn.getValue(vertex)[0] == epoch
            if r.op == "draw" and not there:
                self.drawn.updateValue(vertex, (epoch,))
                n += 1
            elif r.op == "erase" and there:
                self.drawn.removeKey(vertex)
                n -= 1
        self.now.update((epoch, n))
        yield pd.DataFrame({"annotation_id": [key[0]], "seq": [last], "n_edges": [n]})

    def close(self) -> None:
        pass


class _History(StatefulProcessor):
    """The undo stack, oldest first, and the redo stack."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.undo = handle.getListState("undo", "seq long")
        self.redo = handle.getListState("redo", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        undo, redo = ([int(x[0]) for x in s.get()] if s.exists() else [] for s in (self.undo, self.redo))
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if r.op == "act":
                undo, redo = [*undo, int(r.seq)][-self.keep :], []
            elif r.op == "undo" and undo:
                redo.append(undo.pop())
            elif r.op == "redo" and redo:
                undo.append(redo.pop())
        for state, stack in ((self.undo, undo), (self.redo, redo)):
            if stack:
                state.put([(x,) for x in stack])
            else:
                state.clear()
        yield pd.DataFrame({"mesh_id": [key[0]], "can_undo": [len(undo)], "can_redo": [len(redo)], "undo": [undo], "redo": [redo]})

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return events.groupBy(key).transformWithStateInPandas(processor, schema, "update", "none")


def edge_events(events: DataFrame) -> DataFrame:
    """A stream of (annotation_id, seq, op draw/erase/restore, vertex_id) as the changes of each annotation's edge set.

    Output: annotation_id, seq, n_edges after each batch of an annotation's events.
    """
    return _stateful(events, "annotation_id", _Edges(), "annotation_id long, seq long, n_edges long")


def history_events(events: DataFrame, keep: int = HISTORY) -> DataFrame:
    """A stream of (mesh_id, seq, op act/undo/redo) as both stacks after each batch, of ``keep`` entries at most."""
    return _stateful(events, "mesh_id", _History(keep), "mesh_id long, can_undo long, can_redo long, undo array<long>, redo array<long>")


def library_sink(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream of library events (event_id, ...) to a log at path: each event once, for good, whatever is sent again.

    The log is kept by batch and by bucket of the event_id.  A batch drops what the same
    buckets of the committed batches before it have, is written, and counts from when its
    line is in the manifest; one that runs again replaces what it wrote.  The library
    is library() over library_log().
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(["event_id"]).withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int")).persist()
        try:
            log = library_log(spark, path)
            if log is not None:
                touched = [r["bucket"] for r in once.select("bucket").distinct().collect()]  # no more than BUCKETS
                known = log.where(F.col("batch") < number).where(F.col("bucket").isin(touched)).select("bucket", "event_id")
                new = once.join(known, ["bucket", "event_id"], "left_anti")
            else:
                new = once
            new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
            spark.range(1).select(F.lit(number).cast("long").alias("committed")).write.mode("overwrite").parquet(f"{path}/_manifest/{number}")
        finally:
            once.unpersist()

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def library_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The events of the committed batches at path, with their batch and bucket; None before the first."""
    from pyspark.errors import AnalysisException

    try:
        committed = spark.read.option("recursiveFileLookup", True).schema("committed long").parquet(f"{path}/_manifest")
        log = spark.read.parquet(path)
    except AnalysisException:
        return None
    return log.join(F.broadcast(committed.withColumnRenamed("committed", "batch").distinct()), "batch", "left_semi")  # a row a batch


def current_library(log: DataFrame) -> DataFrame:
    return library(log)


def progress(items: DataFrame) -> DataFrame:
    """A stream of review verdicts as counts by dataset, for complete mode."""
    return items.groupBy("dataset").agg(F.count("verdict").alias("verified"), F.count(F.when(F.col("verdict").isNull(), 1)).alias("pending"), F.count("*").alias("total"))
