"""Meshes derived from the given tables, in Spark and in SQL.

``customer`` gives one small grid mesh for each nation, ``orders`` sixteen large ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(rows: DataFrame) -> DataFrame:
    """rows (mesh_id, k, z, ...) as square grids: vertex_id, w, x, y."""
    w = Window.partitionBy("mesh_id")
    ids = rows.withColumn("vertex_id", (F.row_number().over(w.orderBy("k")) - 1).cast("long")).withColumn("w", F.floor(F.sqrt(F.count("*").over(w))).cast("long"))
    kept = ids.where(F.col("vertex_id") < F.col("w") * F.col("w"))
    return kept.withColumn("x", (F.col("vertex_id") % F.col("w")).cast("double")).withColumn("y", F.floor(F.col("vertex_id") / F.col("w")).cast("double"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mesh_id, vertex_id, w, x, y, z, bal, seg from customer."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").cast("long").alias("mesh_id"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"), (F.col("c_acctbal") / 1000).alias("z"))
    return _grid(rows).select("mesh_id", "vertex_id", "w", "x", "y", "z", "bal", "seg")


def large_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mesh_id, vertex_id, w, x, y, z from orders."""
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_orderkey") % 16).alias("mesh_id"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 100000).alias("z"))
    return _grid(rows).select("mesh_id", "vertex_id", "w", "x", "y", "z")


def faces(v: DataFrame) -> DataFrame:
    """Two triangles for each grid cell."""
    a, w = F.col("vertex_id"), F.col("w")
    cells = v.where((F.col("x") < w - 1) & (F.col("y") < w - 1))
    two = F.array(
        F.struct((2 * a).alias("face_id"), a.alias("v0"), (a + 1).alias("v1"), (a + w).alias("v2")),
        F.struct((2 * a + 1).alias("face_id"), (a + 1).alias("v0"), (a + w + 1).alias("v1"), (a + w).alias("v2")),
    )
    return cells.select("mesh_id", F.explode(two).alias("f")).select("mesh_id", "f.*")


def meshes(v: DataFrame) -> DataFrame:
    return v.select("mesh_id").distinct()


def edge_vertices(v: DataFrame) -> DataFrame:
    """Vertices with a negative balance."""
    return v.where("bal < 0").select("mesh_id", "vertex_id")


GT = "case when bal < 0 then 0 else 1 + cast(floor(bal / 2000) as int) end"
PRED = "case when bal < 500 then 0 when bal < 4000 then 1 when bal < 6300 then 2 when bal < 8000 and seg < 'F' then 3 when bal < 8000 then 4 when bal < 9900 then 5 else 6 end"
PRED_GAPS = f"case when bal >= 8000 and mesh_id < 5 then 0 else {PRED} end"


def gt_labels(v: DataFrame) -> DataFrame:
    return v.select("mesh_id", "vertex_id", F.expr(GT).alias("label"))


def pred_labels(v: DataFrame, gaps: bool = False) -> DataFrame:
    return v.select("mesh_id", "vertex_id", F.expr(PRED_GAPS if gaps else PRED).alias("label"))


def face_scores(v: DataFrame, f: DataFrame) -> DataFrame:
    """mesh_id, face_id, p: mean of the corners' scaled balances, to six places."""
    at = v.select("mesh_id", "vertex_id", ((F.col("bal") + 1000) / 11000).alias("s"))
    ends = f.select("mesh_id", "face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).join(at, ["mesh_id", "vertex_id"])
    return ends.groupBy("mesh_id", "face_id").agg(F.round(F.avg("s"), 6).alias("p"))


SQL = f"""
_n as (select c_nationkey::bigint as mesh_id, row_number() over (partition by c_nationkey order by c_custkey) - 1 as vertex_id,
  floor(sqrt(count(*) over (partition by c_nationkey)))::bigint as w, c_acctbal as bal, c_mktsegment as seg from customer),
v as (select mesh_id, vertex_id, w, (vertex_id % w)::double as x, (vertex_id // w)::double as y, bal / 1000 as z, bal, seg from _n where vertex_id < w * w),
f as (select mesh_id, 2 * vertex_id as face_id, vertex_id as v0, vertex_id + 1 as v1, vertex_id + w as v2 from v where x < w - 1 and y < w - 1
  union all select mesh_id, 2 * vertex_id + 1, vertex_id + 1, vertex_id + w + 1, vertex_id + w from v where x < w - 1 and y < w - 1),
m as (select distinct mesh_id from v),
ev as (select mesh_id, vertex_id from v where bal < 0),
gt as (select mesh_id, vertex_id, {GT} as label from v),
pred as (select mesh_id, vertex_id, {PRED} as label from v),
predg as (select mesh_id, vertex_id, {PRED_GAPS} as label from v),
corner as (select mesh_id, face_id, 0 as k, v0 as vertex_id from f union all select mesh_id, face_id, 1, v1 from f union all select mesh_id, face_id, 2, v2 from f),
fs as (select mesh_id, face_id, round(avg((bal + 1000) / 11000), 6) as p from corner join v using (mesh_id, vertex_id) group by all),
side as (select mesh_id, face_id, 0 as slot, least(v1, v2) as lo, greatest(v1, v2) as hi from f union all select mesh_id, face_id, 1, least(v2, v0), greatest(v2, v0) from f
  union all select mesh_id, face_id, 2, least(v0, v1), greatest(v0, v1) from f),
shared as (select mesh_id, lo, hi from side group by all having count(*) = 2),
fa as (select a.mesh_id, a.face_id, a.slot, b.face_id as nbr from side a join shared using (mesh_id, lo, hi) join side b using (mesh_id, lo, hi) where (a.face_id, a.slot) <> (b.face_id, b.slot)),
ve as (select mesh_id, src, dst, min(rk) as first_rank from (
  select mesh_id, v0 as src, v1 as dst, face_id * 6 as rk from f union all select mesh_id, v0, v2, face_id * 6 + 1 from f union all select mesh_id, v1, v0, face_id * 6 + 2 from f
  union all select mesh_id, v1, v2, face_id * 6 + 3 from f union all select mesh_id, v2, v0, face_id * 6 + 4 from f union all select mesh_id, v2, v1, face_id * 6 + 5 from f) group by mesh_id, src, dst),
fp as (select f.*, a.x as x0, a.y as y0, a.z as z0, b.x as x1, b.y as y1, b.z as z1, c.x as x2, c.y as y2, c.z as z2 from f
  join v a on a.mesh_id = f.mesh_id and a.vertex_id = v0 join v b on b.mesh_id = f.mesh_id and b.vertex_id = v1 join v c on c.mesh_id = f.mesh_id and c.vertex_id = v2),
cr as (select mesh_id, face_id, v0, v1, v2, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) as cx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) as cy, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) as cz from fp),
ar as (select *, sqrt(cx*cx+cy*cy+cz*cz) / 2 as area from cr),
nm as (select mesh_id, face_id, v0, v1, v2, case when 2*area > 1e-10 then cx/(2*area) else 0 end as nx, case when 2*area > 1e-10 then cy/(2*area) else 0 end as ny, case when 2*area > 1e-10 then cz/(2*area) else 0 end as nz from ar),
ns as (select mesh_id, face_id, cx/(2*area+1e-12) as nx, cy/(2*area+1e-12) as ny, cz/(2*area+1e-12) as nz from ar),
ea as (select mesh_id, lo, hi, case when count(*) = 1 then pi() when count(*) = 2 then acos(greatest(-1, least(1, arg_min(nx, face_id)*arg_max(nx, face_id)+arg_min(ny, face_id)*arg_max(ny, face_id)+arg_min(nz, face_id)*arg_max(nz, face_id)))) else 0 end as angle
  from side join nm using (mesh_id, face_id) group by all),
va as (select v.mesh_id, v.vertex_id, coalesce(max(angle), 0) as angle from v left join ea on ea.mesh_id = v.mesh_id and (lo = vertex_id or hi = vertex_id) group by all),
vs as (select mesh_id, vertex_id, sum(cx) as sx, sum(cy) as sy, sum(cz) as sz from corner join cr using (mesh_id, face_id) group by all),
vn as (select mesh_id, vertex_id, sx/l as nx, sy/l as ny, sz/l as nz from (select *, case when sqrt(sx*sx+sy*sy+sz*sz) > 0 then sqrt(sx*sx+sy*sy+sz*sz) else 1 end as l from vs)),
el as (select mesh_id, face_id, nbr, face_id * 3 + slot as edge_idx from fa where face_id < nbr),
co as (select el.*, greatest(a.p, b.p) as cost from el join fs a on a.mesh_id = el.mesh_id and a.face_id = el.face_id join fs b on b.mesh_id = el.mesh_id and b.face_id = nbr)
"""

#: Flood fill by recursion: root is the lowest vertex of a component of non-edge vertices.
FLOOD = """
ie as (select ve.mesh_id, src, dst from ve where not exists (select 1 from ev where ev.mesh_id = ve.mesh_id and ev.vertex_id = src) and not exists (select 1 from ev where ev.mesh_id = ve.mesh_id and ev.vertex_id = dst)),
reach(mesh_id, vertex_id, root) as (select mesh_id, vertex_id, vertex_id from v where bal >= 0 union select r.mesh_id, ie.dst, r.root from reach r join ie on ie.mesh_id = r.mesh_id and ie.src = r.vertex_id and ie.dst > r.root),
cc as (select mesh_id, vertex_id, min(root) as root from reach group by all),
seg as (select v.mesh_id, v.vertex_id, coalesce(label, 0) as label from v left join (select mesh_id, vertex_id, dense_rank() over (partition by mesh_id order by root) as label from cc) using (mesh_id, vertex_id))
"""


def sql(body: str, *more: str, recursive: bool = False) -> str:
    """body over the demo tables."""
    return f"with {'recursive ' if recursive else ''}{', '.join((SQL.strip(), *(x.strip() for x in more)))} {body}"
