"""File scans on hand-written files, and streams against their batch twins."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from debitage.operators import annotations as A
from debitage.sources import binary_ply as B
from debitage.sources import mesh_files as P
from debitage.streaming import jobs

PLY = """ply
format ascii 1.0
comment metadata author John Doe
comment metadata:json settings {"scale":1.5}
comment metadata enabled
element vertex 4
property float px
property float py
property float pz
property int labels
element face 1
property list uchar int vertex_indices
element arrow 1
property int start
property int end
end_header
0 0 0 1

1 0 0 0
1 1 0 0
0 1 0 2
4 0 1 2 3
0 3
"""


def test_ascii_ply(spark, tmp_path):
    (tmp_path / "a.ply").write_text(PLY)
    (tmp_path / "b.ply").write_text("no mesh\n")
    got = P.scan_ply(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got["vertices"].collect()) == [("a", 0, 0.0, 0.0, 0.0, 1, None), ("a", 1, 1.0, 0.0, 0.0, 0, None), ("a", 2, 1.0, 1.0, 0.0, 0, None), ("a", 3, 0.0, 1.0, 0.0, 2, None)]
    assert sorted(tuple(r) for r in got["faces"].collect()) == [("a", 0, 0, 1, 3), ("a", 1, 1, 2, 3)]
    assert [tuple(r) for r in got["arrows"].collect()] == [("a", 0, 0, 3)]
    assert {(r["key"], r["value"], r["is_json"]) for r in got["metadata"].collect()} == {("author", "John Doe", False), ("settings", '{"scale":1.5}', True), ("enabled", None, False)}


def test_broken_ply_lines_are_told_and_stop_nothing(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty int labelid\nelement face 4\nproperty list uchar int vertex_index\nend_header\n"
    (tmp_path / "a.ply").write_text(head + "0 0 0 5\n1 0\n1 1 0 6\n0 1 x 7\n5 0 1 2 3 0\n3 0 1\n4 0 1 2 3\nx 1 2 3\n")
    (tmp_path / "b.ply").write_text("no mesh\n")
    got = P.scan_ply(spark, str(tmp_path))
    assert sorted((r["vertex_id"], r["label"], r["label_id"]) for r in got["vertices"].collect()) == [(0, None, 5), (1, None, None), (2, None, 6), (3, None, 7)]
    assert sorted(tuple(r) for r in got["faces"].collect()) == [("a", 0, 0, 1, 3), ("a", 1, 1, 2, 3)]  # the pentagon gives no row
    told = sorted((r["mesh_id"], r["element"], r["index"]) for r in got["errors"].collect())
    assert told == [("a", "face", 1), ("a", "face", 3), ("a", "vertex", 1), ("a", "vertex", 3), ("b", "file", None)]
    (tmp_path / "c.obj").write_text("v 1 2\nv 0 0 0\nf 1 2\nf 1 2 a\nf\nv\n")
    got = P.scan_obj(spark, str(tmp_path / "c.obj"))
    assert got["vertices"].count() == 3 and got["faces"].count() == 0 and got["errors"].count() == 5


def test_obj_fan_and_crlf(spark, tmp_path):
    (tmp_path / "q.obj").write_text("# c\r\nv 0 0 0\r\nv 1 0 0\r\nv 1 1 0\r\nv 0 1 0\r\nvt 0 0\r\nf 1/1/1 2//1 3 4\r\n")
    got = P.scan_obj(spark, str(tmp_path))
    assert got["vertices"].count() == 4
    assert sorted(tuple(r) for r in got["faces"].collect()) == [("q", 0, 0, 1, 2), ("q", 1, 0, 2, 3)]


def test_binary_ply_both_orders_and_a_bad_file(spark, tmp_path):
    for order, name in (("<", "little"), (">", "big")):
        head = f"ply\nformat binary_{name}_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar labels\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
        body = b"".join(struct.pack(order + "fffB", i, 0, 0, i) for i in range(3)) + struct.pack(order + "Biii", 3, 0, 1, 2)
        (tmp_path / f"{name}.ply").write_bytes(head.encode() + body)
    (tmp_path / "bad.ply").write_bytes(b"junk")
    v, f = B.scan_binary_ply(spark, str(tmp_path))
    assert sorted((r["mesh_id"], r["vertex_id"], r["x"], r["label"]) for r in v.where("parse_error is null").collect()) == [(n, i, float(i), i) for n in ("big", "little") for i in range(3)]
    assert sorted(tuple(r)[:5] for r in f.where("parse_error is null").collect()) == [("big", 0, 0, 1, 2), ("little", 0, 0, 1, 2)]
    assert v.where("parse_error is not null").select("mesh_id").collect()[0][0] == "bad"


def test_binary_ply_lists_of_mixed_lengths(spark, tmp_path):
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 5\nproperty float px\nproperty float py\nproperty float pz\nproperty int labelid\nelement face 5\nproperty uchar kind\nproperty list uchar int vertex_index\nelement extra 1\nproperty double q\nend_header\n"
    faces = [(0, 1, 2), (0, 1, 2, 3), (0, 1, 2, 3, 4), (2, 3, 4), (0, 1)]
    body = b"".join(struct.pack("<fffi", i, 0, 0, i) for i in range(5)) + b"".join(struct.pack(f"<BB{len(f)}i", 9, len(f), *f) for f in faces) + struct.pack("<d", 1)
    (tmp_path / "m.ply").write_bytes(head.encode() + body)
    v, f = B.scan_binary_ply(spark, str(tmp_path))
    assert sorted((r["vertex_id"], r["label"], r["label_id"]) for r in v.collect()) == [(i, None, i) for i in range(5)]
    assert sorted((r["face_id"], r["v0"], r["v1"], r["v2"]) for r in f.collect()) == [(0, 0, 1, 2), (1, 0, 1, 3), (2, 1, 2, 3), (3, 2, 3, 4)]


def random_faces(rng, n, most):
    return [[int(x) for x in rng.integers(0, 50, rng.choice([3, 3, 3, 4, 2, 0, most]))] for _ in range(n)]


def split_faces(faces):
    """Triangles as the loader splits them: three stay, four give (0,1,3), (1,2,3)."""
    out = []
    for f in faces:
        out += [tuple(f)] if len(f) == 3 else [(f[0], f[1], f[3]), (f[1], f[2], f[3])] if len(f) == 4 else []
    return out


@pytest.mark.parametrize("range_bytes", [97, 5000])
def test_binary_ranges_of_mixed_lists(spark, tmp_path, monkeypatch, range_bytes):
    """Ranges that begin anywhere, records longer than a range, two lists a face, int counts, elements behind."""
    monkeypatch.setattr(B, "CHAIN", 1 << 9)  # in this process only; tasks keep theirs
    rng = np.random.default_rng(5)
    want = {}
    for name, order, word in (("little", "<", "uchar"), ("big", ">", "int")):
        faces = random_faces(rng, 700, 60 if word == "uchar" else 400)
        head = f"ply\nformat binary_{name}_endian 1.0\nelement vertex 90\nproperty double x\nproperty double y\nproperty double z\nelement face {len(faces)}\nproperty list {word} int vertex_indices\nproperty short kind\nproperty list uchar float uv\nelement arrow 3\nproperty int start_index\nproperty int end_index\nend_header\n"
        count = "B" if word == "uchar" else "i"
        body = b"".join(struct.pack(order + "ddd", i, -i, i / 2) for i in range(90))
        for f in faces:
            uv = [0.5] * int(rng.integers(0, 3))
            body += struct.pack(f"{order}{count}{len(f)}ihB{len(uv)}f", len(f), *f, 7, len(uv), *uv)
        body += b"".join(struct.pack(order + "ii", k, k + 1) for k in range(3))
        (tmp_path / f"{name}.ply").write_bytes(head.encode() + body)
        (tmp_path / f"{name}-cut.ply").write_bytes(head.encode() + body[:-30])
        want[name] = split_faces(faces)
    (tmp_path / "none.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty float x\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n")
    got = B.binary_tables(spark, str(tmp_path), range_bytes)
    assert {n: [tuple(r)[2:] for r in got["faces"].where(F.col("mesh_id") == n).orderBy("face_id").collect()] for n in want} == want
    assert sorted(r["face_id"] for r in got["faces"].where("mesh_id = 'big'").collect()) == list(range(len(want["big"])))
    assert sorted(tuple(r)[:5] for r in got["vertices"].collect()) == [(n, i, float(i), float(-i), i / 2) for n in ("big", "little") for i in range(90)]
    assert sorted(tuple(r) for r in got["arrows"].collect()) == [(n, k, k, k + 1) for n in ("big", "little") for k in range(3)]
    assert {r["mesh_id"] for r in got["errors"].collect()} == {"big-cut", "little-cut"}


def test_chains_equal_a_walk():
    rng = np.random.default_rng(9)
    props = [("a", None, "uchar"), ("l", "uchar", "short"), ("b", None, "float")]
    raw = b"".join(struct.pack(f"<BB{n}hf", 1, n, *range(n), 0.5) for n in rng.integers(0, 9, 3000).tolist())
    data = np.frombuffer(raw, np.uint8)

    def walk(at, past):
        n = 0
        while at < past:
            if at + 1 >= len(raw):
                return -1, -1
            at, n = at + 6 + 2 * raw[at + 1], n + 1
        return at, n

    for past in (1, 700, 9000):
        exits, many = B._leave(data, np.arange(min(past, 60)), past, props, False)
        assert list(zip(exits.tolist(), many.tolist(), strict=True)) == [walk(k, past) for k in range(min(past, 60))]
    starts = B._beginnings(data, 0, 3000, len(data), props, False)
    assert len(starts) == 3000 and (np.diff(starts) == B._ends(data, starts, props, False)[0][:-1] - starts[:-1]).all()


@pytest.mark.parametrize("big", [False, True])
def test_binary_files_read_as_they_were_written(spark, tmp_path, big):
    v = spark.sql("select concat('m', id % 3) as mesh_id, id div 3 as vertex_id, id / 7D as x, 1D as y, -id / 3D as z, cast(id % 5 as int) as label from range(900)")
    f = spark.sql("select concat('m', id % 3) as mesh_id, id div 3 as face_id, transform(sequence(0, 2 + cast(id % 2 as int)), k -> id % 100 + k) as corners from range(600)")
    arrows = spark.sql("select 'm1' as mesh_id, 0 as pos, 5L as start_index, 6L as end_index")
    notes = spark.sql("select 'm0' as mesh_id, 'comment metadata author someone' as line")
    files = B.write_binary_ply(v, f, str(tmp_path / "out"), arrows, notes, big).collect()
    assert sorted((r["mesh_id"], r["bytes"]) for r in files) == sorted((p.stem, p.stat().st_size) for p in (tmp_path / "out").glob("*.ply"))
    assert b"comment metadata author someone" in (tmp_path / "out" / "m0.ply").read_bytes()[:200]
    got = B.binary_tables(spark, str(tmp_path / "out"), 777)
    assert sorted(map(tuple, got["vertices"].drop("label_id").collect())) == sorted(map(tuple, v.collect()))
    want = {m: split_faces([r["corners"] for r in f.where(F.col("mesh_id") == m).orderBy("face_id").collect()]) for m in ("m0", "m1", "m2")}
    assert {m: [tuple(r)[2:] for r in got["faces"].where(F.col("mesh_id") == m).orderBy("face_id").collect()] for m in want} == want
    assert [tuple(r) for r in got["arrows"].collect()] == [("m1", 0, 5, 6)] and got["errors"].count() == 0


def test_text_scans_of_many_splits_equal_those_of_one(spark, tmp_path):
    """Ids and problems don't depend on where a file is cut; the files have blank and broken lines throughout."""
    rng = np.random.default_rng(4)
    obj, ply = [], ["ply", "format ascii 1.0", "element vertex 1500", "property float x", "property float y", "property float z", "element face 900", "property list uchar int vertex_indices", "end_header"]
    for k in range(3000):
        obj.append(["v 1 2 3", f"v {k} 0 0", "f 1 2 3 4", "f 1/2 2//3 3", "", "# note", "f 1 x", "v 1", "f 1 2 3 4 5 6"][int(rng.integers(0, 9))])
    for k in range(1500):
        ply += [f"{k} 0 0"] + [""] * int(rng.integers(0, 2))
    for k in range(900):
        ply.append(["3 0 1 2", "4 0 1 2 3", "5 0 1 2 3 4", "3 0 1"][int(rng.integers(0, 4))])
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "o.obj").write_text("\r\n".join(obj))
    (tmp_path / "b" / "p.ply").write_text("\n".join(ply) + "\n")

    def scan():
        both = (P.scan_obj(spark, str(tmp_path / "a")), P.scan_ply(spark, str(tmp_path / "b")))
        return P.read_lines(spark, str(tmp_path / "a")).select("split").distinct().count(), [{k: sorted(map(str, df.collect())) for k, df in x.items()} for x in both]

    few, want = scan()
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        many, got = scan()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert many > 10 > few and got == want
    plain = [x.split() for x in obj]
    vertices = [w for w in plain if w and w[0] == "v"]
    assert len(want[0]["vertices"]) == len(vertices)
    faces = sum(len(w) - 3 for w in plain if w and w[0] == "f" and "x" not in w)
    assert len(want[0]["faces"]) == faces and len(want[0]["errors"]) == sum(w in (["v", "1"], ["f", "1", "x"]) for w in plain)
    assert {e for e in want[0]["errors"] if "face" in e} == {f"Row(mesh_id='o', element='face', index={k}, problem='fewer than three corners')" for k, w in enumerate(plain) if w == ["f", "1", "x"]}


EVENTS = [(1, 1, "draw", 5), (1, 2, "draw", 6), (2, 3, "draw", 5), (1, 4, "erase", 5), (2, 5, "restore", None), (2, 6, "draw", 9)]


def test_edge_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame(EVENTS, "annotation_id long, seq long, op string, vertex_id long")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = jobs.edge_events(stream).writeStream.format("memory").queryName("edges_now").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["annotation_id"]: r["n_edges"] for r in spark.sql("select annotation_id, max_by(n_edges, seq) as n_edges from edges_now group by 1").collect()}
    want = {r["annotation_id"]: r["n"] for r in A.current_edges(e).groupBy("annotation_id").agg(F.count("*").alias("n")).collect()}
    assert got == want == {1: 1, 2: 1}


def test_history_batch(spark):
    ops = [(7, 1, "act"), (7, 2, "act"), (7, 3, "undo"), (7, 4, "redo"), (7, 5, "undo"), (8, 6, "undo"), (8, 7, "act")]
    rows = A.history_states(spark.createDataFrame(ops, "mesh_id long, seq long, op string")).collect()
    assert sorted((r["mesh_id"], r["position"], r["seq"], r["undone"]) for r in rows) == [(7, 1, 1, False), (7, 2, 2, True), (8, 1, 7, False)]


def test_history_stream_equals_batch(spark, tmp_path):
    """Both stacks over several batches, more acts than are kept among them."""
    rng = np.random.default_rng(2)
    ops = [(int(m), k, str(op)) for k, (m, op) in enumerate(zip(rng.integers(0, 3, 240), rng.choice(["act", "act", "undo", "redo"], 240), strict=True))] + [(9, 1000 + k, "act") for k in range(130)]
    schema = "mesh_id long, seq long, op string"
    (tmp_path / "in").mkdir()
    q = jobs.history_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("histories").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    latest = {}
    for k in range(3):
        spark.createDataFrame(ops[k * len(ops) // 3 : (k + 1) * len(ops) // 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = spark.table("histories").count()
        q.processAllAvailable()
        latest |= {r["mesh_id"]: r for r in spark.table("histories").collect()[before:]}
    q.stop()
    want = {}
    for r in A.history_states(spark.createDataFrame(ops, schema)).collect():
        want.setdefault(r["mesh_id"], []).append((r["position"], r["seq"], r["undone"]))
    assert set(latest) >= set(want)
    for m, rows in want.items():
        rows.sort()
        assert latest[m]["undo"] == [x for _, x, undone in rows if not undone] and latest[m]["redo"] == [x for _, x, undone in rows[::-1] if undone]
        assert (latest[m]["can_undo"], latest[m]["can_redo"]) == (len(latest[m]["undo"]), len(latest[m]["redo"]))
    assert latest[9]["can_undo"] == 100


def test_edge_stream_over_batches(spark, tmp_path):
    """Draws after a restore and repeated ones, in three batches of one state."""
    batches = [[(1, 1, "draw", 5), (1, 2, "draw", 5), (1, 3, "draw", 6)], [(1, 4, "restore", None), (1, 5, "draw", 5), (1, 6, "erase", 6)], [(1, 7, "erase", 5), (1, 8, "draw", 8), (1, 9, "draw", 9), (2, 10, "erase", 1)]]
    schema = "annotation_id long, seq long, op string, vertex_id long"
    (tmp_path / "in").mkdir()
    q = jobs.edge_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("edge_batches").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("edge_batches").collect()) == [(1, 3, 2), (1, 6, 1), (1, 9, 2), (2, 10, 0)]


def test_library_sink_takes_each_event_once_for_good(spark, tmp_path):
    """Sent twice in a batch, again days later, and by a batch that runs again after a crash before its commit."""
    schema = "event_id long, annotation_id string, seq long, op string, name string, cloud_id string, ts timestamp"
    event = "select {0}L as event_id, 'a' as annotation_id, {0}L as seq, 'save' as op, 'n{0}' as name, cast(null as string) as cloud_id, timestamp'2024-01-{1:02d}' as ts"
    send = lambda *rows: spark.sql(" union all ".join(event.format(*r) for r in rows)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def run():
        q = jobs.library_sink(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    assert jobs.library_log(spark, out) is None
    send((1, 1), (1, 1), (2, 1))
    run()
    send((3, 20), (1, 20))  # days after
    run()
    assert sorted(r["event_id"] for r in jobs.library_log(spark, out).collect()) == [1, 2, 3]
    # the last batch loses its commit and runs again
    (tmp_path / "cp" / "commits" / "1").unlink()
    for crc in (tmp_path / "cp" / "commits").glob(".1.crc"):
        crc.unlink()
    for f in (tmp_path / "out" / "_manifest" / "1").iterdir():
        f.unlink()
    assert sorted(r["event_id"] for r in jobs.library_log(spark, out).collect()) == [1, 2]
    run()
    log = jobs.library_log(spark, out)
    assert sorted(r["event_id"] for r in log.collect()) == [1, 2, 3] and jobs.current_library(log).first()["name"] == "n3"


def test_progress_stream(spark, tmp_path):
    items = spark.createDataFrame([("d", 1, "accept"), ("d", 2, None)], "dataset string, item int, verdict string")
    items.write.parquet(str(tmp_path / "in"))
    q = jobs.progress(spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("progress_now").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from progress_now").collect()] == [tuple(r) for r in A.review_progress(items).collect()] == [("d", 1, 1, 2)]
