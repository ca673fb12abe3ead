"""The metric registry and reports over region tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debitage.functions.scalars import SYMBOLS, converted
from debitage.operators.topology import M


@dataclass(frozen=True)
class Metric:
    """column: of the region table; kind: count, length, area, angle or order; header: of reports, with a place for the unit's symbol."""

    column: str
    kind: str
    header: str

    def value(self, source: Column, target: Column) -> Column:
        """The metric in the target unit; angles in degrees."""
        if self.kind in ("length", "area"):
            return F.round(converted(F.col(self.column), source, target, 2 if self.kind == "area" else 1), 4)
        return F.round(F.degrees(self.column), 2) if self.kind == "angle" else F.col(self.column)

    def titled(self, unit: str) -> str:
        return self.header.format(SYMBOLS.get(unit, ""))


# The headers.
REGISTRY = {
    m.column: m
    for m in (
        Metric("vertex_count", "count", "vertex_count"),
        Metric("surface_area", "area", "surface_area_{}2"),
        Metric("max_dimension", "length", "max_dimension_{}"),
        Metric("mean_curvature", "angle", "mean_curvature_deg"),
        Metric("temporal_order", "order", "temporal_order"),
    )
}


def available(regions: DataFrame) -> DataFrame:
    """metric, n: registered metrics that any region has a value of."""
    names = [n for n in REGISTRY if n in regions.columns]
    rows = regions.agg(*(F.count(n).alias(n) for n in names))
    return rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in names))).alias("m")).select("m.metric", "m.n").where("n > 0")


def ranked(regions: DataFrame, metric: str, ascending: bool = False, key: str = "scar_id") -> DataFrame:
    """regions with rank (1 first, nulls last, ties by key) and rank_fraction (0.5 for a single region)."""
    by = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    rank = F.row_number().over(Window.partitionBy(M).orderBy(by, key))
    n = F.count("*").over(Window.partitionBy(M))
    return regions.withColumn("rank", rank).withColumn("rank_fraction", F.when(n == 1, 0.5).otherwise((F.col("rank") - 1) / (n - 1)))


def summary(regions: DataFrame, metric: str) -> DataFrame:
    """mesh_id, low, high, mean, middle of the non-null values."""
    return regions.where(F.col(metric).isNotNull()).groupBy(M).agg(F.min(metric).alias("low"), F.max(metric).alias("high"), F.avg(metric).alias("mean"), F.median(metric).alias("middle"))


def percent_of_max(regions: DataFrame, metric: str, key: str = "scar_id") -> DataFrame:
    """mesh_id, key, percent; null counts as 0; a mesh of zeros has no rows."""
    top = F.max(F.coalesce(metric, F.lit(0))).over(Window.partitionBy(M))
    return regions.withColumn("_top", top).where("_top > 0").select(M, key, (F.coalesce(metric, F.lit(0)) / F.col("_top") * 100).alias("percent"))


def report(regions: DataFrame, metric: str, source: Column, unit: str) -> DataFrame:
    """mesh_id, rank and every registered metric in the given unit, best first; headers name the unit."""
    names = [n for n in REGISTRY if n in regions.columns]
    return ranked(regions, metric).select(M, "rank", *(REGISTRY[n].value(source, F.lit(unit)).alias(REGISTRY[n].titled(unit)) for n in names))


def boundary_averages(scar_edges: DataFrame, comparisons: DataFrame) -> DataFrame:
    """mesh_id, mean_sharpness, mean_roughness, n_expert, n_preseed."""
    a = scar_edges.groupBy(M).agg(F.avg("sharpness").alias("mean_sharpness"), F.avg("roughness").alias("mean_roughness"))
    b = comparisons.groupBy(M).agg(F.count(F.when(F.col("source") == "expert", 1)).alias("n_expert"), F.count(F.when(F.col("source") == "preseed", 1)).alias("n_preseed"))
    return a.join(b, M, "left").fillna(0, ["n_expert", "n_preseed"])
