"""Grid geometry: edges, centres, regions, interfaces, paths and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import RS
from .windows import islands, space

UM_PER_CM = 1.0e4


def cumulative_edges(df: DataFrame, width: str = "width_cm", boundary: Column | None = None) -> DataFrame:
    """Outer edge of each zone: the boundary plus the widths up to it."""
    start = F.lit(0.0) if boundary is None else boundary
    return df.withColumn("outer_cm", start + F.sum(width).over(space().rowsBetween(Window.unboundedPreceding, 0)))


def edge_nodes(df: DataFrame, outer: str, width: str) -> DataFrame:
    """Nodes of each snapshot: node 0 is the inner boundary, node k the outer edge of the k-th zone."""
    n = df.withColumn("node_id", F.row_number().over(space()))
    inner = n.filter("node_id = 1").select(*RS, F.lit(0).alias("node_id"), (F.col(outer) - F.col(width)).alias("position_cm"))
    return inner.unionByName(n.select(*RS, "node_id", F.col(outer).alias("position_cm")))


def repaired_edges(df: DataFrame, parsed: str, width: str, tolerance: float = 1e-3) -> DataFrame:
    """Parsed edges, or the cumulated widths where a snapshot's parsed edges do not ascend but lie close to them."""
    group = Window.partitionBy(*RS)
    out = cumulative_edges(df, width)
    step = F.col(parsed) - F.lag(parsed).over(space())
    out = out.withColumn("__step", step).withColumns({"__bad": F.coalesce(F.max((F.col("__step") <= 0).cast("int")).over(group), F.lit(0)), "__gap": F.max(F.abs(F.col(parsed) - F.col("outer_cm"))).over(group), "__scale": F.greatest(F.max(F.abs("outer_cm")).over(group), F.lit(1.0))})
    use = (F.col("__bad") == 1) & (F.col("__gap") <= tolerance * F.col("__scale"))
    return out.withColumns({"edge_cm": F.when(use, F.col("outer_cm")).otherwise(F.col(parsed)), "fallback": use}).drop("__step", "__bad", "__gap", "__scale")


def width_issues(df: DataFrame, edge: str, width: str, tolerance: float = 5e-3) -> DataFrame:
    """Snapshots whose edge steps differ from the widths by more than a share of the largest width."""
    gap = F.abs(F.col(edge) - F.lag(edge).over(space()) - F.col(width))
    out = df.withColumn("__gap", gap).groupBy(*RS).agg(F.max("__gap").alias("worst"), F.max(width).alias("widest"))
    return out.filter(F.col("worst") > tolerance * F.col("widest"))


def clip_boundary(x: Column, noise: float = 1e-6) -> Column:
    """A cylindrical inner boundary: tiny negative values become 0, larger ones null (an issue)."""
    return F.when(x >= 0, x).when(x >= -noise, F.lit(0.0))


def centers_from_edges(nodes: DataFrame) -> DataFrame:
    over = Window.partitionBy(*RS).orderBy("node_id")
    mid = (F.col("position_cm") + F.lead("position_cm").over(over)) / 2.0
    return nodes.withColumn("center_cm", mid).filter(F.col("center_cm").isNotNull()).select(*RS, (F.col("node_id") + 1).alias("zone_rank"), "center_cm")


def edges_from_centers(df: DataFrame, center: str, single: float = 0.5) -> DataFrame:
    """Lower and upper edge of each zone: midpoints inside, mirrored half steps at the ends, ``single`` around a lone zone."""
    before, after = F.lag(center).over(space()), F.lead(center).over(space())
    c = F.col(center)
    half_up, half_down = (after - c) / 2.0, (c - before) / 2.0
    return df.withColumns({"lower_cm": F.coalesce(c - half_down, c - half_up, c - single), "upper_cm": F.coalesce(c + half_up, c + half_down, c + single)})


def property_from_regions(zones: DataFrame, regions: DataFrame, value: str) -> DataFrame:
    """A region's property on each of its zones; the later region wins, uncovered zones are null. Regions are few and broadcast by size."""
    r = regions.select("region_id", "min_zone", "max_zone", F.col(value).alias("__v"))
    own = r.select(F.explode(F.sequence("min_zone", "max_zone")).alias("zone_id"), "region_id", "__v").groupBy("zone_id").agg(F.max_by("__v", "region_id").alias(value))
    return zones.join(own, "zone_id", "left")


def interfaces(regions: DataFrame, run: str | None = None) -> DataFrame:
    """Neighbouring regions: left, right, boundary zone and interface index."""
    over = Window.partitionBy(run if run else F.lit(1)).orderBy("region_id")
    keys = [run] if run else []
    out = regions.withColumn("right_region", F.lead("region_id").over(over)).filter("right_region is not null")
    return out.select(*keys, F.col("region_id").alias("left_region"), "right_region", F.col("max_zone").alias("boundary_zone"), (F.col("max_zone") - 1).alias("interface_id"))


def regions_from_ids(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Runs of equal ids along the zones: island, value, first and last zone."""
    return islands(df, keys, "zone_id", F.col(value)).groupBy(*keys, "island").agg(F.first(value).alias(value), F.min("zone_id").alias("min_zone"), F.max("zone_id").alias("max_zone"))


def laser_entry(runs: DataFrame, zones: int) -> DataFrame:
    """Entry boundary and zone from the origin zone and the ray's direction."""
    toward_low = F.upper("direction").isin("RMIN", "XMIN")
    high = F.when(F.col("direction").isNull(), F.col("origin_zone") > zones / 2).otherwise(toward_low)
    return runs.withColumns({"entry_boundary": F.when(high, "high").otherwise("low"), "entry_zone": F.when(high, F.least(F.col("origin_zone"), F.lit(zones))).otherwise(F.greatest(F.col("origin_zone"), F.lit(1))), "propagation": F.when(high, "high_to_low").otherwise("low_to_high")})


def propagation_direction(df: DataFrame, entry: DataFrame | None = None) -> DataFrame:
    """Per run: the laser's direction, else by the sign of the median velocity over all samples."""
    out = df.groupBy("run_id").agg(F.median("velocity").alias("median_velocity"))
    seen = F.when(F.col("median_velocity") < 0, "high_to_low").otherwise("low_to_high")
    if entry is None:
        return out.withColumn("propagation", seen)
    return out.join(entry.select("run_id", "propagation"), "run_id", "left").withColumn("propagation", F.coalesce("propagation", seen))


def observation_boundary(side: Column, propagation: Column) -> Column:
    """Low or high, directly or relative to the laser side."""
    entry = F.when(propagation == "high_to_low", "high").otherwise("low")
    rear = F.when(propagation == "high_to_low", "low").otherwise("high")
    return F.when(side.isin("low", "high"), side).when(side == "laser", entry).otherwise(rear)


def axis_cosine(boundary: Column, angle_deg: Column) -> Column:
    return F.when(boundary == "high", 1.0).otherwise(-1.0) * F.cos(F.radians(angle_deg))


def planar_path(width: Column, angle_deg: float) -> Column:
    return width / max(abs(math.cos(math.radians(angle_deg))), 1e-6)


def chord(inner: Column, outer: Column, impact: float) -> Column:
    """Length of a ray at an impact parameter inside a cylindrical shell."""
    leg = lambda r: F.sqrt(F.greatest(r * r - impact * impact, F.lit(0.0)))
    return F.greatest(2.0 * (leg(outer) - leg(inner)), F.lit(0.0))


def shell_factor(inner: Column, outer: Column) -> Column:
    return outer * outer - inner * inner


def profile_coordinate(mode: str, *, zone: str = "zone_id", static: str | None = None, moving: str | None = None) -> Column:
    """Zone number, static place or moving radius in micrometres, falling back in that order."""
    places = {"zone": [None], "static": [static], "moving": [moving, static]}[mode]
    found = [F.col(p) * UM_PER_CM for p in places if p]
    return F.coalesce(*found, F.col(zone).cast("double")) if found else F.col(zone).cast("double")


def interface_positions(nodes: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """Inner edges of each snapshot; where the moving one is missing, the static one."""
    over = Window.partitionBy(*RS)
    inner = nodes.withColumn("__last", F.max("node_id").over(over)).filter((F.col("node_id") > 0) & (F.col("node_id") < F.col("__last")))
    out = inner.select(*RS, (F.col("node_id") - 1).alias("interface_id"), "position_cm")
    if static is None:
        return out
    return out.join(static.withColumnRenamed("position_cm", "__s"), ["run_id", "interface_id"], "left").withColumn("position_cm", F.coalesce("position_cm", "__s")).drop("__s")


def interface_spacing(df: DataFrame, center: str) -> DataFrame:
    """Step to the next centre; non-positive steps take the snapshot's least positive one (or 1)."""
    step = F.lead(center).over(space()) - F.col(center)
    least = F.coalesce(F.min(F.when(F.col("__d") > 0, F.col("__d"))).over(Window.partitionBy(*RS)), F.lit(1.0))
    out = df.withColumn("__d", step).withColumn("__m", least)
    return out.withColumn("spacing_cm", F.when(F.col("__d") > 0, F.col("__d")).when(F.col("__d").isNotNull(), F.col("__m"))).drop("__d", "__m")


def inactive_ranges(df: DataFrame, mask: Column, inner: str, outer: str) -> DataFrame:
    """Coordinate intervals of the deselected zones."""
    runs = islands(df.withColumn("__on", F.coalesce(mask, F.lit(False))), RS, "zone_id", F.col("__on"))
    return runs.filter(~F.col("__on")).groupBy(*RS, "island").agg(F.min(inner).alias("from_cm"), F.max(outer).alias("to_cm"))
