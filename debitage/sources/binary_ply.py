"""Binary PLY files, read and written in byte ranges.

A first job reads the headers.  Elements without lists have records of one length, so
where each begins follows from the counts; lists that are all as long as the first are
checked in ranges of records, in parallel.  Where lengths vary, no range knows where its
first record begins: each finds, for every place where one may begin, where the chain
of records leaves the range and after how many, and joining those from range to range
gives every range its first record.  A last job reads all ranges of all files and
decodes their records; triangles are numbered by sums over ranges.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from debitage.iterate import tabled
from debitage.sources.mesh_files import ALIASES, ENDS, LABEL, LABEL_ID, M, _mesh_id, running

# The scalar types of the format.
SIZES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
CORNERS = ("vertex_indices", "vertex_index")
#: Bytes of a range; of the part of it whose records are chained at once; places in a range where a first record is looked for before it is known to begin elsewhere.
RANGE = 16 << 20
CHAIN = 1 << 18
ENTRIES = 1100
#: Bytes of a header that are read first.
HEAD = 1 << 16
PROPS = "array<struct<name:string,count:string,type:string>>"
LAYOUT = f"{M} string, path string, size long, ordinal int, element string, n long, big boolean, props {PROPS}, start long, parse_error string"


def _opened(path: str):
    """A file that any executor can open, local or in a store."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def _bytes(path: str, begin: int, end: int) -> bytes:
    with _opened(path) as f:
        f.seek(begin)
        return f.read(max(0, end - begin))


def header(path: str, size: int) -> tuple[list[tuple[str, int, list]], bool, int]:
    """(elements as (name, count, properties as (name, count type, type))), whether big-endian, where the body begins."""
    got, end = b"", None
    while end is None:
        more = _bytes(path, len(got), min(size, max(HEAD, 2 * len(got))))
        got += more
        end = re.search(rb"end_header\r?\n", got)
        if not got.startswith(b"ply") or end is None and not more:
            raise ValueError("no PLY header")
    elements: list[tuple[str, int, list]] = []
    kind = ""
    for line in got[: end.end()].decode("utf-8", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"] and elements:
            elements[-1][2].append((w[4], w[2], w[3]) if w[1] == "list" else (w[2], None, w[1]))
    if kind not in ("binary_little_endian", "binary_big_endian"):
        raise ValueError(f"no binary format: {kind}")
    unknown = {t for _, _, props in elements for _, c, t in props for t in (c, t) if t is not None} - set(SIZES)
    if unknown:
        raise ValueError(f"unknown type: {min(unknown)}")
    return elements, kind == "binary_big_endian", end.end()


def _heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for mesh, path, size in zip(f[M], f["path"], f["size"], strict=True):
            try:
                elements, big, start = header(path, size)
                rows += [(mesh, path, size, k, name, n, big, props, start if k == 0 else None, None) for k, (name, n, props) in enumerate(elements)]
            except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed batch
                rows.append((mesh, path, size, -1, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
        yield pd.DataFrame([(*r[:7], [{"name": a, "count": c, "type": t} for a, c, t in r[7]] if r[7] is not None else None, *r[8:]) for r in rows], columns=[c.split()[0] for c in LAYOUT.replace(PROPS, "").split(", ")])


def _properties(props) -> list[tuple[str, str | None, str]]:
    return [(p["name"], p["count"], p["type"]) for p in props]


def _record(props: list, lengths: list[int], big: bool) -> np.dtype:
    """The record of an element whose lists are so long."""
    order, fields, turn = ">" if big else "<", [], iter(lengths)
    for name, count, kind in props:
        if count is None:
            fields.append((name, order + SIZES[kind]))
        else:
            fields += [(f"n {name}", order + SIZES[count]), (name, order + SIZES[kind], (next(turn),))]
    return np.dtype(fields)


def _ends(data: np.ndarray, at: np.ndarray, props: list, big: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where records that begin at these bytes end, and their lists' lengths; -1 where the bytes don't tell."""
    place, lengths = at.astype(np.int64), []
    for _, count, kind in props:
        size = np.dtype(SIZES[kind]).itemsize
        if count is None:
            place = np.where(place < 0, -1, place + size)
            continue
        own = np.dtype((">" if big else "<") + SIZES[count])
        whole = (place >= 0) & (place + own.itemsize <= len(data))
        n = np.full(len(place), -1, np.int64)
        raw = data[place[whole][:, None] + np.arange(own.itemsize)]
        n[whole] = np.ascontiguousarray(raw).view(own)[:, 0].astype(np.int64)
        lengths.append(n)
        place = np.where(n < 0, -1, place + own.itemsize + n * size)
    return place, np.stack(lengths, axis=1)


def _leave(data: np.ndarray, entries: np.ndarray, past: int, props: list, big: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the chains from entries first reach ``past`` or beyond, and their records till then; -1 where the bytes don't tell.

    All bytes of a part are taken for beginnings at once and jumps are doubled, so the
    work grows with the bytes and not with the chains.
    """
    now, many = entries.astype(np.int64), np.zeros(len(entries), np.int64)
    for base in range(0, past, CHAIN):
        stop = min(past, base + CHAIN)
        live = (now >= base) & (now < stop)
        if not live.any():
            continue
        jump, _ = _ends(data, np.arange(base, stop), props, big)
        steps = np.ones(stop - base, np.int64)
        while True:
            inside = np.flatnonzero((jump >= base) & (jump < stop))
            if not len(inside):
                break
            to = jump[inside] - base
            steps[inside], jump[inside] = steps[inside] + steps[to], jump[to]
        own = now[live] - base
        now[live], many[live] = jump[own], many[live] + steps[own]
    return now, np.where(now < 0, -1, many)


def _beginnings(data: np.ndarray, entry: int, n: int, past: int, props: list, big: bool) -> np.ndarray:
    """Where the chained records from entry on begin: n of them, or those before ``past``, or as far as the bytes tell."""
    out, at = [np.zeros(0, np.int64)], entry
    while n > 0 and 0 <= at < past:
        stop = min(past, at + CHAIN)
        jump, _ = _ends(data, np.arange(at, stop), props, big)
        last = jump.copy()
        starts, whole = np.array([at]), True
        while whole and len(starts) < n:  # the beginnings so far, each moved on by as many records as there are
            to = jump[starts - at]
            more = to[(to >= at) & (to < stop)]
            whole = len(more) == len(to)
            starts = np.concatenate([starts, more])
            inside = np.flatnonzero((jump >= at) & (jump < stop))
            doubled = np.full(len(jump), -1, np.int64)
            doubled[inside] = jump[jump[inside] - at]
            jump = doubled
        starts = starts[:n]
        out.append(starts)
        n -= len(starts)
        at = int(last[starts[-1] - at])
    return np.concatenate(out)


def _one(path: str, start: int, size: int, props: list, big: bool) -> tuple[int, list[int]]:
    """The bytes of the record that begins at start, and its lists' lengths; -1 if the file ends before it tells."""
    width = 64
    while True:
        data = np.frombuffer(_bytes(path, start, min(size, start + width)), np.uint8)
        end, lengths = _ends(data, np.zeros(1, np.int64), props, big)
        if end[0] >= 0 or len(data) < width:
            return int(end[0]), lengths[0].tolist()
        width *= 8


def _cut(rows: DataFrame, past: str, step: Column) -> DataFrame:
    """A row (begin, end) for each ``step`` bytes from start to before past."""
    many = F.ceil((F.col(past) - F.col("start")) / step).cast("long")
    cut = rows.select("*", F.explode(F.when(many > 0, F.sequence(F.lit(0).cast("long"), many - 1))).alias("k")).withColumn("begin", F.col("start") + F.col("k") * step)
    return cut.withColumn("end", F.least(F.col("begin") + step, past)).drop("k")


def _same_lengths(rows: DataFrame, range_bytes: int, tasks: int) -> DataFrame:
    """path, ordinal, stride of the list elements of which every list is as long as that of its first record."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [_one(r.path, r.start, r.size, _properties(r.props), bool(r.big)) if r.n else (0, []) for r in f.itertuples()]
            f["stride"], f["lengths"] = [x for x, _ in got], [x for _, x in got]
            yield f[["path", "ordinal", "stride", "lengths"]]

    def same(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = []
            for r in f.itertuples():
                kind = _record(_properties(r.props), list(r.lengths), bool(r.big))
                got = np.frombuffer(_bytes(r.path, r.begin, r.end), kind)
                ok.append(all((got[f"n {name}"] == n).all() for (name, n) in zip((a for a, c, _ in _properties(r.props) if c is not None), r.lengths, strict=True)))
            f["ok"] = ok
            yield f[["path", "ordinal", "ok"]]

    firsts = tabled(rows.mapInPandas(first, "path string, ordinal int, stride long, lengths array<long>"))
    fits = rows.drop("stride").join(firsts, ["path", "ordinal"]).withColumn("past", F.col("start") + F.col("n") * F.col("stride")).where("stride >= 0 and past <= size")
    ranges = _cut(fits.where("stride > 0"), "past", F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.greatest("stride", F.lit(1)))) * F.col("stride"))  # of whole records
    ok = ranges.repartition(tasks, "path", "begin").mapInPandas(same, "path string, ordinal int, ok boolean").groupBy("path", "ordinal").agg(F.min("ok").alias("ok"))
    return firsts.join(fits.select("path", "ordinal"), ["path", "ordinal"], "left_semi").join(ok, ["path", "ordinal"], "left").where("ok or stride = 0").drop("ok")


def _chained(rows: DataFrame, range_bytes: int, tasks: int) -> DataFrame:
    """path, ordinal, begin, end, index, many of the records that begin in each range of list elements of mixed lengths, and where each element ends as a row of no record (-1: too late).

    Each range tells where the chains from its first ENTRIES bytes leave it; a chain that
    enters beyond those (a record longer than that) is followed from there.
    """

    def leave(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                width = r.end - r.begin
                # lengths of a record that begins before the end are in the bytes behind it
                data = np.frombuffer(_bytes(r.path, r.begin, min(r.size, r.end + ENTRIES)), np.uint8)
                exits, many = _leave(data, np.arange(min(ENTRIES, width)), width, _properties(r.props), bool(r.big))
                out.append((r.path, r.ordinal, r.begin, r.end, r.n, r.start, r.size, bool(r.big), r.props, exits.tolist(), many.tolist()))
            yield pd.DataFrame(out, columns=["path", "ordinal", "begin", "end", "n", "start", "size", "big", "props", "exits", "many"])

    def follow(g: pd.DataFrame) -> pd.DataFrame:
        """One element: from range to range, a look-up each."""
        g = g.sort_values("begin")
        at, index, out = int(g["start"].iloc[0]), 0, []
        n, path, ordinal = int(g["n"].iloc[0]), g["path"].iloc[0], g["ordinal"].iloc[0]
        for r in g.itertuples():
            if at >= r.end or index >= n or at < 0:
                continue
            entry, props = at - r.begin, _properties(r.props)
            if entry < len(r.exits) and r.exits[entry] >= 0 and index + r.many[entry] <= n:
                past, many = r.begin + int(r.exits[entry]), int(r.many[entry])
            else:  # a long record before, one whose lengths lie far apart, or the element's last range
                data = np.frombuffer(_bytes(r.path, r.begin, min(r.size, r.end + ENTRIES)), np.uint8)
                starts = _beginnings(data, entry, n - index, r.end - r.begin, props, bool(r.big))
                last, many = r.begin + int(starts[-1]), len(starts)
                size, _ = _one(r.path, last, r.size, props, bool(r.big))
                past = last + size if size >= 0 else -1
                while 0 <= past < r.end and index + many < n:  # beginnings stop where the bytes behind the range don't tell
                    size, _ = _one(r.path, past, r.size, props, bool(r.big))
                    past, many = (past + size, many + 1) if size >= 0 else (-1, many)
            out.append((path, ordinal, at, past, index, many))
            at, index = past, index + many
        whole = index == n and 0 <= at <= int(g["size"].iloc[0])
        out.append((path, ordinal, at if whole else -1, -1, index, 0))
        return pd.DataFrame(out, columns=["path", "ordinal", "begin", "end", "index", "many"])

    kinds = f"path string, ordinal int, begin long, end long, n long, start long, size long, big boolean, props {PROPS}, exits array<long>, many array<long>"
    left = _cut(rows, "size", F.lit(range_bytes)).repartition(tasks, "path", "begin").mapInPandas(leave, kinds)
    # one row a range, so an element of a terabyte is some 60,000 of them
    return tabled(left.groupBy("path", "ordinal").applyInPandas(follow, "path string, ordinal int, begin long, end long, index long, many long"))


def _ranges(layout: DataFrame, range_bytes: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(ranges, problems): every range of records of every element, and the files that end too soon.

    ranges: path, ordinal, begin, end, index (of the first record), many, lengths (null where they vary).
    """
    rounds = layout.agg(F.max("ordinal")).first()[0]
    fixed = F.aggregate("props", F.lit(0), lambda total, p: total + F.when(p["count"].isNull(), F.element_at(F.create_map(*(F.lit(x) for k, t in SIZES.items() for x in (k, np.dtype(t).itemsize))), p["type"])).otherwise(0))
    listed = F.exists("props", lambda p: p["count"].isNotNull())
    known = tabled(layout.where("parse_error is null").withColumn("stride", fixed.cast("long")).withColumn("listed", listed))
    start = known.where("ordinal = 0").select("path", "start")
    ranges, problems = None, None
    step = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.greatest("stride", F.lit(1))))  # records of a range
    for k in range((rounds if rounds is not None else -1) + 1):
        here = tabled(known.where(F.col("ordinal") == k).drop("start").join(start, "path"))
        plain = here.where("not listed").withColumn("lengths", F.array().cast("array<long>"))
        lists = here.where("listed")
        past = plain.select("path", (F.col("start") + F.col("n") * F.col("stride")).alias("start"), "size")
        if not lists.isEmpty():
            same = tabled(_same_lengths(lists, range_bytes, tasks))
            plain = plain.unionByName(lists.drop("stride").join(same, ["path", "ordinal"]))
            past = plain.select("path", (F.col("start") + F.col("n") * F.col("stride")).alias("start"), "size")
            mixed = lists.join(same, ["path", "ordinal"], "left_anti")
            if not mixed.isEmpty():
                chained = _chained(mixed, range_bytes, tasks)
                past = past.unionByName(chained.where("end < 0").select("path", F.col("begin").alias("start")).join(mixed.select("path", "size"), "path"))
                own = chained.where("end >= 0").withColumn("lengths", F.lit(None).cast("array<long>"))
                ranges = own if ranges is None else ranges.unionByName(own)
        cut = plain.where("n > 0").withColumn("step", step)
        cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("step")))).alias("k"))
        cut = cut.select("path", "ordinal", (F.col("k") * F.col("step")).alias("index"), F.least(F.col("step"), F.col("n") - F.col("k") * F.col("step")).alias("many"), "lengths", "start", "stride")
        cut = cut.select("path", "ordinal", (F.col("start") + F.col("index") * F.col("stride")).alias("begin"), (F.col("start") + (F.col("index") + F.col("many")) * F.col("stride")).alias("end"), "index", "many", "lengths")
        ranges = cut if ranges is None else ranges.unionByName(cut)
        past = tabled(past)
        bad = past.where("start > size or start < 0").select("path", F.concat(F.lit("ends inside element "), F.lit(k + 1)).alias("parse_error"))
        problems = bad if problems is None else problems.unionByName(bad)
        start = past.where("start <= size and start >= 0").select("path", "start")
    return ranges, problems


ROWS = {M: pa.string(), "kind": pa.string(), "split": pa.int64(), "at": pa.int64(), "id": pa.int64(), "x": pa.float64(), "y": pa.float64(), "z": pa.float64(), "label": pa.int32(), "label_id": pa.int32(), "corners": pa.list_(pa.int64()), **{e: pa.int64() for e in ENDS}}
STORED = f"{M} string, kind string, split long, at long, id long, x double, y double, z double, label int, label_id int, corners array<long>, {', '.join(f'{e} long' for e in ENDS)}"


def _columns(element: str, index: np.ndarray, got: np.ndarray) -> dict[str, pa.Array]:
    """The columns of decoded records of one layout."""
    names, out = got.dtype.names or (), {"id": pa.array(index)}
    native = lambda p, kind: pa.array(got[p].astype(kind))
    if element == "vertex":
        pick = {a: next((p for p in own if p in names), None) for a, own in (ALIASES | {"label": (LABEL,), "label_id": (LABEL_ID,)}).items()}
        return out | {a: native(p, "f8" if a in "xyz" else "i4") for a, p in pick.items() if p}
    if element == "face":
        corner = next((c for c in CORNERS if c in names), None)
        flat = got[corner].astype(np.int64) if corner else np.zeros((len(got), 0), np.int64)
        return out | {"corners": pa.ListArray.from_arrays(np.arange(len(got) + 1, dtype=np.int32) * flat.shape[1], flat.reshape(-1))}
    return out | {e: native(e, "i8") for e in ENDS if e in names}


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            props, big = _properties(r["props"]), bool(r["big"])
            data = np.frombuffer(_bytes(r["path"], r["begin"], r["end"]), np.uint8)
            index = np.arange(r["index"], r["index"] + r["many"])
            if r["lengths"] is not None:
                parts = [(index, data.view(_record(props, r["lengths"], big)))]
            else:
                starts = _beginnings(data, 0, r["many"], len(data), props, big)
                kinds, of = np.unique(_ends(data, starts, props, big)[1], axis=0, return_inverse=True)
                parts = []
                for k, lengths in enumerate(kinds.tolist()):
                    kind, own = _record(props, lengths, big), np.flatnonzero(of.reshape(-1) == k)
                    raw = np.ascontiguousarray(data[starts[own][:, None] + np.arange(kind.itemsize)])
                    parts.append((index[own], raw.view(kind)[:, 0]))
            for own, got in parts:
                n, cols = len(own), _columns(r["element"], own, got)
                cols |= {M: pa.array([r[M]]).take(np.zeros(n, np.int64)), "kind": pa.array([r["element"]]).take(np.zeros(n, np.int64)), "split": pa.array(np.full(n, r["begin"])), "at": pa.array(own)}
                yield pa.RecordBatch.from_arrays([cols.get(k, pa.nulls(n, kind)).cast(kind) for k, kind in ROWS.items()], list(ROWS))


def binary_tables(spark: SparkSession, path: str, range_bytes: int = RANGE) -> dict[str, DataFrame]:
    """vertices, faces, arrows and errors (mesh_id, parse_error) of binary PLY files of either byte order.

    A file of another kind, and one that ends before its elements do, is a row of errors
    and gives no other.  Faces of three corners stay, quads split as (0,1,3), (1,2,3),
    others give no row.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(_mesh_id(F.col("path")).alias(M), "path", F.col("length").alias("size"))
    layout = tabled(files.repartition(tasks, "path").mapInPandas(_heads, LAYOUT))
    ranges, problems = _ranges(layout, range_bytes, tasks)
    errors = layout.where("parse_error is not null").select(M, "parse_error")
    if ranges is None:
        ranges = spark.createDataFrame([], "path string, ordinal int, begin long, end long, index long, many long, lengths array<long>")
    else:
        errors = errors.unionByName(layout.select(M, "path").distinct().join(problems, "path").select(M, "parse_error"))
        ranges = ranges.join(problems, "path", "left_anti")
    wanted = layout.where(F.col("element").isin("vertex", "face", "arrow")).select(M, "path", "ordinal", "element", "big", "props")
    stored = tabled(ranges.join(wanted, ["path", "ordinal"]).repartition(tasks, "path", "begin").mapInArrow(_decoded, STORED))
    own = lambda kind: stored.where(F.col("kind") == kind)
    tri = lambda a, b, c: F.struct(*(F.get("corners", F.lit(k)).alias(f"v{i}") for i, k in enumerate((a, b, c))))
    split = F.when(F.size("corners") == 3, F.array(tri(0, 1, 2))).when(F.size("corners") == 4, F.array(tri(0, 1, 3), tri(1, 2, 3)))
    faces = running(own("face").withColumn("t", split), "first", F.when(F.col("t").isNull(), 0).otherwise(F.size("t")))
    faces = faces.select(M, "first", F.posexplode("t").alias("part", "t")).select(M, (F.col("first") + F.col("part")).cast("long").alias("face_id"), "t.v0", "t.v1", "t.v2")
    return {
        "vertices": own("vertex").select(M, F.col("id").alias("vertex_id"), *"xyz", "label", "label_id"),
        "faces": faces,
        "arrows": own("arrow").select(M, F.col("id").cast("int").alias("pos"), *ENDS),
        "errors": errors,
    }


def scan_binary_ply(spark: SparkSession, path: str, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of binary PLY files, with parse_error on a row of its own for a bad file."""
    got = binary_tables(spark, path, range_bytes)
    return tuple(got[k].withColumn("parse_error", F.lit(None).cast("string")).unionByName(got["errors"], allowMissingColumns=True) for k in ("vertices", "faces"))


def write_binary_ply(vertices: DataFrame, faces: DataFrame, folder: str, arrows: DataFrame | None = None, notes: DataFrame | None = None, big: bool = False) -> DataFrame:
    """One binary PLY file a mesh in a folder that all executors share; returns mesh_id, path, bytes.

    vertices: x, y, z and perhaps label; faces: v0, v1, v2 or corners (arrays of any
    length); arrows: pos, start_index, end_index; notes: line, header lines.  Records are
    packed where the rows are; a file is written by one task, as its rows come in order,
    under a name of its own and renamed at the end.
    """
    order, label = ">" if big else "<", "label" in vertices.columns
    corners = F.col("corners") if "corners" in faces.columns else F.array("v0", "v1", "v2")
    count = lambda df, name: df.groupBy(M).agg(F.count("*").alias(name))
    sizes = count(vertices, "nv").join(count(faces, "nf"), M, "left").join(count(arrows, "na") if arrows is not None else count(faces.limit(0), "na"), M, "left").fillna(0)
    if notes is not None:
        sizes = sizes.join(notes.groupBy(M).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("notes")), M, "left")
    head = ["ply", f"format binary_{'big' if big else 'little'}_endian 1.0"]
    mid = ["property double x", "property double y", "property double z", *(["property int labels"] if label else [])]
    tail = [F.concat(F.lit("element arrow "), "na"), *(F.lit(f"property int {e}") for e in ENDS)] if arrows is not None else []
    lines = F.concat_ws("\n", *map(F.lit, head), *([F.col("notes")] if notes is not None else []), F.concat(F.lit("element vertex "), "nv"), *map(F.lit, mid), F.concat(F.lit("element face "), "nf"), F.lit("property list uchar int vertex_indices"), *tail, F.lit("end_header\n"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.schema.names[3] == "corners":
                flat, ends = np.asarray(b.column(3).flatten()), np.concatenate([[0], np.cumsum(np.asarray(b.column(3).value_lengths()))])
                many = np.diff(ends)
                to = np.concatenate([[0], np.cumsum(1 + 4 * many)])
                raw = np.empty(to[-1], np.uint8)
                raw[to[:-1]] = many
                raw[(np.repeat(to[:-1] + 1 - 4 * ends[:-1], many) + 4 * np.arange(len(flat)))[:, None] + np.arange(4)] = flat.astype(order + "i4").view(np.uint8).reshape(-1, 4)
            else:
                kinds = np.dtype([(c, order + ("f8" if c in "xyz" else "i4")) for c in b.schema.names[3:]])
                rows = np.empty(b.num_rows, kinds)
                for k, c in enumerate(kinds.names):
                    rows[c] = np.asarray(b.column(3 + k))
                raw, to = rows.view(np.uint8), kinds.itemsize * np.arange(b.num_rows + 1)
            payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], payload], [M, "section", "id", "payload"])

    out = f"{M} string, section int, id long, payload binary"
    key = lambda df, section, i: [F.col(M).cast("string").alias(M), F.lit(section).alias("section"), F.col(i).cast("long").alias("id")]
    parts = sizes.select(F.col(M).cast("string").alias(M), F.lit(0).alias("section"), F.lit(0).cast("long").alias("id"), lines.cast("binary").alias("payload"))
    parts = parts.unionByName(vertices.select(*key(vertices, 1, "vertex_id"), *"xyz", *(["label"] if label else [])).mapInArrow(packed, out))
    parts = parts.unionByName(faces.select(*key(faces, 2, "face_id"), corners.alias("corners")).mapInArrow(packed, out))
    if arrows is not None:
        parts = parts.unionByName(arrows.select(*key(arrows, 3, "pos"), *ENDS).mapInArrow(packed, out))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        plain = re.sub(r"^file:/+", "/", folder)
        store, root = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
        store.create_dir(root)
        own, stream, temporary, n, done = None, None, "", 0, []

        def close() -> None:
            if stream is not None:
                stream.close()
                store.move(temporary, f"{root}/{own}.ply")
                done.append((own, f"{root}/{own}.ply", n))

        for b in batches:
            for mesh, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if mesh != own:
                    close()
                    own, n, temporary = mesh, 0, f"{root}/.{uuid.uuid4().hex}"
                    stream = store.open_output_stream(temporary)
                stream.write(payload)
                n += len(payload)
        close()
        cols = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], [M, "path", "bytes"])

    return parts.repartition(M).sortWithinPartitions(M, "section", "id").select(M, "payload").mapInArrow(write, f"{M} string, path string, bytes long")
