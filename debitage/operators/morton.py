"""Places of points on a Morton curve, regions of neighbouring points, and nearest points by descent through its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import tabled

M = "mesh_id"
#: Bits of each axis in a code; of each axis that one step of a descent takes.
BITS, STEP = 20, 2
#: Leading bits of a code whose cells are counted to number a mesh's points along the curve.
COARSE = 18
#: Rounding that a bound allows for.
SAFE = 1e-9


def _spread(x: Column) -> Column:
    """The low 21 bits of x, two zeros between one and the next."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def with_codes(points: DataFrame) -> DataFrame:
    """points (mesh_id, x, y, z, ...) with ``code``: the place on the curve through their mesh's bounding cube."""
    box = points.groupBy(M).agg(*(F.min(a).alias(f"_{a}") for a in "xyz"), F.greatest(*(F.max(a) - F.min(a) for a in "xyz")).alias("_side"))
    scaled = lambda a: F.floor(F.least(F.lit(1.0), F.coalesce((F.col(a) - F.col(f"_{a}")) / F.when(F.col("_side") > 0, F.col("_side")), F.lit(0.0))) * ((1 << BITS) - 1)).cast("long")
    code = _spread(scaled("x")).bitwiseOR(F.shiftleft(_spread(scaled("y")), 1)).bitwiseOR(F.shiftleft(_spread(scaled("z")), 2))
    return points.join(tabled(box), M).withColumn("code", code).drop("_x", "_y", "_z", "_side")


def regions(vertices: DataFrame, size: int) -> DataFrame:
    """mesh_id, vertex_id, region: each mesh's vertices along the curve, ``size`` to a region.

    The curve's coarse cells are counted and summed up in order, and a window numbers the
    points of one cell.
    """
    placed = with_codes(vertices.select(M, "vertex_id", *"xyz")).withColumn("cell", F.shiftright("code", 3 * BITS - COARSE))
    counts = tabled(placed.groupBy(M, "cell").agg(F.count("*").alias("n")))
    base = counts.select(M, "cell", F.coalesce(F.sum("n").over(Window.partitionBy(M).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy(M, "cell").orderBy("code", "vertex_id")) - 1
    return placed.withColumn("own", own).join(base, [M, "cell"]).select(M, "vertex_id", F.floor((F.col("base") + F.col("own")) / size).cast("long").alias("region"))


def nearest(probes: DataFrame, points: DataFrame, max_distance: float) -> DataFrame:
    """mesh_id, probe, vertex_id, d2: the closest point nearer than max_distance, not the probe itself; ties to the lowest id.

    probes: mesh_id, probe, px, py, pz; points: mesh_id, vertex_id, x, y, z.  All probes
    go down the cells of the curve together, 64 to a step.  Every cell met lowers the
    probe's bound (by its lowest point, or its far corner where that is the probe itself)
    and is left if its box lies beyond the bound; cells of one point are settled.  So a
    probe meets the cells around its nearest point at each step and no more, whatever
    the reach.
    """
    # points in one place: the lowest two ids are all that a nearest one can be
    same = F.row_number().over(Window.partitionBy(M, *"xyz").orderBy("vertex_id"))
    coded = tabled(with_codes(points.select(M, "vertex_id", *"xyz").dropna().withColumn("_same", same).where("_same <= 2").drop("_same")))
    reach = F.lit(float(max_distance) ** 2)
    frontier = probes.select(M, "probe", "px", "py", "pz").dropna().withColumn("cell", F.lit(0).cast("long")).withColumn("bound", reach)
    found = None
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"lo_{a}") - F.col(f"p{a}"), F.col(f"p{a}") - F.col(f"hi_{a}"))
    far = lambda a: F.greatest(F.abs(F.col(f"lo_{a}") - F.col(f"p{a}")), F.abs(F.col(f"hi_{a}") - F.col(f"p{a}")))
    least = sum(gap(a) ** 2 for a in "xyz")
    to_low = sum((F.col(f"low.{a}") - F.col(f"p{a}")) ** 2 for a in "xyz")
    for step in range(1, BITS // STEP + 1):
        cells = coded.withColumn("cell", F.shiftright("code", 3 * (BITS - STEP * step))).groupBy(M, "cell")
        cells = cells.agg(F.count("*").alias("n"), F.min(F.struct("vertex_id", *"xyz")).alias("low"), *(F.min(a).alias(f"lo_{a}") for a in "xyz"), *(F.max(a).alias(f"hi_{a}") for a in "xyz"))
        cells = tabled(cells.withColumn("parent", F.shiftright("cell", 3 * STEP)))
        met = frontier.withColumnRenamed("cell", "parent").join(cells, [M, "parent"]).where(~((F.col("n") == 1) & (F.col("low.vertex_id") == F.col("probe"))))
        most = F.when(F.col("low.vertex_id") == F.col("probe"), sum(far(a) ** 2 for a in "xyz")).otherwise(to_low)
        met = met.select(M, "probe", "px", "py", "pz", "cell", "n", F.col("low.vertex_id").alias("vertex_id"), to_low.alias("d2"), least.alias("least"), F.least("bound", F.min(most).over(Window.partitionBy(M, "probe"))).alias("bound"))
        met = tabled(met.where(F.col("least") <= F.col("bound") * (1 + SAFE)))
        settled = met.where("n = 1").select(M, "probe", "vertex_id", "d2")
        found = settled if found is None else found.unionByName(settled)
        frontier = met.where("n > 1").select(M, "probe", "px", "py", "pz", "cell", "bound")
        if frontier.isEmpty():
            break
    else:  # points that differ by less than the curve tells
        last = frontier.join(coded.withColumn("cell", F.col("code")), [M, "cell"]).where("probe <> vertex_id")
        found = found.unionByName(last.select(M, "probe", "vertex_id", sum((F.col(a) - F.col(f"p{a}")) ** 2 for a in "xyz").alias("d2")))
    near = found.where(F.sqrt("d2") < max_distance).groupBy(M, "probe").agg(F.min(F.struct("d2", "vertex_id")).alias("m"))
    return near.select(M, "probe", "m.vertex_id", "m.d2")
