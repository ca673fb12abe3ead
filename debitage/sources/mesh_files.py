"""Scans and sinks of text mesh files, ASCII PLY and OBJ.

Large files are read by many tasks.  A line's number in its file, and with it every vertex
and face id, is the sum over the splits before its own plus its place in the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from debitage.iterate import tabled

M = "mesh_id"
#: Names that files use for the coordinates.
ALIASES = {"x": ("x", "px", "posx"), "y": ("y", "py", "posy"), "z": ("z", "pz", "posz")}
# The names of a vertex's label, its label id, and an arrow's ends.
LABEL, LABEL_ID, ENDS = "labels", "labelid", ("start_index", "end_index")


def _mesh_id(path: Column) -> Column:
    """The file name without folder and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)


def _folder_or_name(path: Column) -> Column:
    """Files that write_text_files() wrote are named by their folder, mesh_id=<name>."""
    return F.when(path.contains("mesh_id="), F.regexp_extract(path, r"mesh_id=([^/]+)", 1)).otherwise(path)


#: The part of a file that one task reads: the file and the byte at which the part begins.
SPLIT = (M, "split")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """mesh_id, split, at, line of every line of the text files under path.

    A large file is read by many tasks, each a stretch of whole lines; ``split`` is the
    byte where its stretch begins and ``at`` grows from line to line inside it.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n")
    lines = text.select(_mesh_id(_folder_or_name(F.col("_metadata.file_path"))).alias(M), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.rtrim("value", F.lit("\r")).alias("line"))
    return lines


def running(rows: DataFrame, name: str, size: Column | None = None) -> DataFrame:
    """rows (mesh_id, split, at, ...) with ``name``: the sum of ``size`` (1 without) over all rows before it in its file.

    Sums inside a split are one window a split, which is no larger than a task's read; those
    of whole splits are added up over a table of one row a split.
    """
    rows = rows.withColumn("_size", F.lit(1) if size is None else size)
    sums = tabled(rows.groupBy(*SPLIT).agg(F.sum("_size").alias("_sum")))
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(*SPLIT, before("_sum", *SPLIT).alias("_base"))
    own = rows.withColumn("_own", before("_size", *SPLIT, "at"))
    return own.join(base, [*SPLIT]).withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_size", "_own", "_base")


def ply_header(head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, properties): each element's range of body lines, each scalar property's place.

    head: mesh_id, line_no, line of the header's lines, some dozen a file.
    """
    head = head.withColumn("w", F.split(F.trim("line"), r"\s+"))
    w = Window.partitionBy(M).orderBy("line_no")
    element = head.where("w[0] = 'element'").select(M, "line_no", F.col("w")[1].alias("element"), F.col("w")[2].try_cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    elements = element.select(M, "element", "line_no", before.alias("first"), (before + F.col("n")).alias("past"))
    props = head.where("w[0] = 'property' and w[1] <> 'list'").select(M, "line_no", F.element_at("w", -1).alias("property"))
    owner = elements.select(M, "element", F.col("line_no").alias("at"), F.lead("line_no").over(w).alias("until"))
    owned = props.join(owner, M).where("line_no > at and (until is null or line_no < until)")
    place = F.row_number().over(Window.partitionBy(M, "element").orderBy("line_no")) - 1
    return elements, owned.select(M, "element", "property", place.alias("place"))


def scan_ply(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """vertices (label and label_id where the file has them), faces, arrows, metadata and errors of ASCII PLY files.

    Faces of three corners stay, quads split as (0,1,3), (1,2,3), others give no row.  A
    file of another kind and a line that lacks numbers give rows of errors (mesh_id,
    element, index, problem) and stop nothing.
    """
    # every non-blank line with its number among those of its file
    lines = tabled(running(read_lines(spark, path).where("trim(line) <> ''"), "line_no"))
    end = tabled(lines.where("line = 'end_header'").groupBy(M).agg(F.min("line_no").alias("end")))
    ended = lines.join(end, M, "left")
    elements, props = ply_header(ended.where("line_no < end").select(M, "line_no", "line"))
    elements = tabled(elements)
    body = ended.where("line_no > end").select(*SPLIT, "at", (F.col("line_no") - F.col("end") - 1).alias("k"), F.split(F.trim("line"), r"\s+").alias("w"))
    body = body.join(elements.select(M, "element", "first", "past"), M).where("k >= first and k < past").withColumn("index", F.col("k") - F.col("first"))
    wanted = [("vertex", a, names) for a, names in ALIASES.items()] + [("vertex", "label", (LABEL,)), ("vertex", "label_id", (LABEL_ID,))] + [("arrow", e, (e,)) for e in ENDS]
    places = [F.min(F.when((F.col("element") == element) & F.col("property").isin(*names), F.col("place"))).alias(f"p_{a}") for element, a, names in wanted]
    # one row a file
    placed = body.join(tabled(props.groupBy(M).agg(*places)), M, "left")
    at = lambda p: F.when(F.col(f"p_{p}").isNotNull(), F.get("w", F.col(f"p_{p}")))
    v = placed.where("element = 'vertex'").select(M, "index", *(at(a).try_cast("double").alias(a) for a in (*"xyz", "label", "label_id")))
    vertices = v.select(M, F.col("index").cast("long").alias("vertex_id"), *"xyz", *(F.col(c).cast("int").alias(c) for c in ("label", "label_id")))
    f = body.where("element = 'face'").select(*SPLIT, "at", "index", F.get("w", F.lit(0)).try_cast("int").alias("n"), F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda t: t.try_cast("long")).alias("c"))
    f = f.withColumn("whole", F.coalesce((F.size("c") >= F.col("n")) & ~F.exists(F.slice("c", 1, F.greatest("n", F.lit(0))), F.isnull), F.lit(False)))
    tri = lambda a, b, c: F.struct(F.get("c", F.lit(a)).alias("v0"), F.get("c", F.lit(b)).alias("v1"), F.get("c", F.lit(c)).alias("v2"))
    split = F.when(F.col("n") == 3, F.array(tri(0, 1, 2))).when(F.col("n") == 4, F.array(tri(0, 1, 3), tri(1, 2, 3)))
    faces = _number(f.where("whole"), split)
    arrows = placed.where("element = 'arrow'").select(M, F.col("index").cast("int").alias("pos"), *(F.coalesce(at(e), F.get("w", F.lit(k))).try_cast("long").alias(e) for k, e in enumerate(ENDS)))
    notes = lines.where(F.col("line").rlike(r"^comment metadata(:json)? \S+"))
    metadata = notes.select(M, F.regexp_extract("line", r"^comment metadata(?::json)? (\S+)", 1).alias("key"), F.nullif(F.regexp_extract("line", r"^comment metadata(?::json)? \S+ (.*)$", 1), F.lit("")).alias("value"), F.col("line").startswith("comment metadata:json").alias("is_json"))
    ends = lines.groupBy(M).agg(F.max(F.col("line") == "end_header").alias("ends"), F.min(F.when(F.col("line_no") == 0, F.col("line"))).alias("first"))
    problem = lambda df, element, text: df.select(M, F.lit(element).alias("element"), "index", F.lit(text).alias("problem"))
    errors = problem(ends.where("not ends or trim(first) <> 'ply'").withColumn("index", F.lit(None).cast("long")), "file", "no PLY header")
    errors = errors.unionByName(problem(v.where("x is null or y is null or z is null"), "vertex", "fewer than three coordinates"))
    errors = errors.unionByName(problem(f.where("not whole"), "face", "fewer corners than announced"))
    errors = errors.unionByName(problem(arrows.where("start_index is null or end_index is null").withColumn("index", F.col("pos").cast("long")), "arrow", "fewer than two ends"))
    return {"vertices": vertices, "faces": faces, "arrows": arrows, "metadata": metadata, "errors": errors}


def _number(faces: DataFrame, triangles: Column) -> DataFrame:
    """The triangles of faces (mesh_id, split, at, ...), numbered through each file."""
    own = running(faces.withColumn("_t", triangles), "_first", F.greatest(F.size("_t"), F.lit(0)))
    return own.select(M, "_first", F.posexplode("_t").alias("part", "t")).select(M, (F.col("_first") + F.col("part")).cast("long").alias("face_id"), "t.v0", "t.v1", "t.v2")


def scan_obj(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """vertices, faces and errors of OBJ files; polygons are fans from their first corner.

    A v line of fewer than three numbers keeps its number with null coordinates, an f line
    with a corner that is no index gives no face; both are rows of errors (mesh_id,
    element, index, problem).
    """
    lines = read_lines(spark, path).withColumn("w", F.split(F.trim("line"), r"\s+"))
    corner = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda t: F.regexp_extract(t, r"^(\d+)", 1).try_cast("long") - 1)
    # the text is read and parsed once; what follows reads columns
    parsed = tabled(
        lines.select(
            *SPLIT,
            "at",
            F.col("w")[0].alias("kind"),
            *(F.when(F.col("w")[0] == "v", F.get("w", F.lit(k + 1)).try_cast("double")).alias(a) for k, a in enumerate("xyz")),
            F.when(F.col("w")[0] == "f", corner).alias("c"),
        )
    )
    vertices = running(parsed.where("kind = 'v'"), "vertex_id").select(M, "vertex_id", *"xyz")
    f = parsed.where("kind = 'f'").withColumn("whole", (F.size("c") >= 3) & ~F.exists("c", F.isnull))
    fan = F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda k: F.struct(F.get("c", F.lit(0)).alias("v0"), F.get("c", k).alias("v1"), F.get("c", k + 1).alias("v2")))
    errors = vertices.where("x is null or y is null or z is null").select(M, F.lit("vertex").alias("element"), F.col("vertex_id").alias("index"), F.lit("fewer than three coordinates").alias("problem"))
    # lines are counted for the files that have such faces only
    short = tabled(f.where("not whole").select(*SPLIT, "at"))
    numbers = running(parsed.select(*SPLIT, "at").join(short.select(M).distinct(), M, "left_semi"), "index")
    errors = errors.unionByName(numbers.join(short, [*SPLIT, "at"], "left_semi").select(M, F.lit("face").alias("element"), "index", F.lit("fewer than three corners").alias("problem")))
    return {"vertices": vertices, "faces": _number(f.where("whole"), fan), "errors": errors}


def ply_lines(vertices: DataFrame, faces: DataFrame, arrows: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """mesh_id, section, id, line: the lines of one ASCII PLY file a mesh, in order of (section, id).

    vertices may have a label column and normals nx, ny, nz; metadata has lines.
    """
    has_label, has_normal = "label" in vertices.columns, "nx" in vertices.columns
    props = [*"xyz", *(("nx", "ny", "nz") if has_normal else ())]
    nv = vertices.groupBy(M).agg(F.count("*").alias("nv"))
    nf = faces.groupBy(M).agg(F.count("*").alias("nf"))
    sizes = nv.join(nf, M, "left").fillna(0)
    if arrows is not None:
        sizes = sizes.join(arrows.groupBy(M).agg(F.count("*").alias("na")), M, "left").fillna(0)
    head = ["ply", "format ascii 1.0"]
    mid: list = [F.concat(F.lit("element vertex "), "nv"), *(F.lit(f"property double {p}") for p in props), *((F.lit("property int labels"),) if has_label else ()), F.concat(F.lit("element face "), "nf"), F.lit("property list uchar int vertex_indices")]
    if arrows is not None:
        mid += [F.concat(F.lit("element arrow "), "na"), *(F.lit(f"property int {e}") for e in ENDS)]
    mid.append(F.lit("end_header"))
    parts = [
        sizes.select(M, F.lit(0).alias("section"), F.posexplode(F.array(*map(F.lit, head))).alias("id", "line")),
        sizes.select(M, F.lit(2).alias("section"), F.posexplode(F.array(*mid)).alias("id", "line")),
        vertices.select(M, F.lit(3).alias("section"), F.col("vertex_id").alias("id"), F.concat_ws(" ", *props, *(("label",) if has_label else ())).alias("line")),
        faces.select(M, F.lit(4).alias("section"), F.col("face_id").alias("id"), F.concat_ws(" ", F.lit("3"), "v0", "v1", "v2").alias("line")),
    ]
    if metadata is not None:
        parts.append(metadata.select(M, F.lit(1).alias("section"), F.lit(0).alias("id"), "line"))
    if arrows is not None:
        parts.append(arrows.select(M, F.lit(5).alias("section"), F.col("pos").alias("id"), F.concat_ws(" ", "start_index", "end_index").alias("line")))
    out = None
    for p in parts:
        p = p.select(M, "section", F.col("id").cast("long").alias("id"), "line")
        out = p if out is None else out.unionByName(p)
    return out


def write_text_files(lines: DataFrame, path: str) -> None:
    """One folder a mesh (mesh_id=...), its lines in order in one file."""
    spread = lines.repartition(M).sortWithinPartitions(M, "section", "id")
    spread.select(M, "line").write.mode("overwrite").partitionBy(M).text(path)


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, section, id, line of OBJ files."""
    v = vertices.select(M, F.lit(0).alias("section"), F.col("vertex_id").alias("id"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    return v.unionByName(faces.select(M, F.lit(1).alias("section"), F.col("face_id").alias("id"), F.concat_ws(" ", F.lit("f"), *(F.col(c) + 1 for c in ("v0", "v1", "v2"))).alias("line")))


def split_corpus(parsed: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(geometry, metadata, annotation): counts of each mesh, its metadata, and its vertices of a non-zero label.

    Files with errors have what could be read; ``parsed["errors"]`` tells them.
    """
    geometry = parsed["vertices"].groupBy(M).agg(F.count("*").alias("n_vertices")).join(parsed["faces"].groupBy(M).agg(F.count("*").alias("n_faces")), M, "left").fillna(0)
    return geometry, parsed["metadata"], parsed["vertices"].where("label is not null and label <> 0").select(M, "vertex_id")
