"""Slices, masks and snapshot selection; every mask is one boolean column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RS = ["run_id", "snapshot_index"]
RZ = ["run_id", "zone_id"]


def snapshot(df: DataFrame, index: int) -> DataFrame:
    """Rows of one snapshot of each run; a negative index counts from the run's last."""
    if index >= 0:
        return df.filter(F.col("snapshot_index") == index)
    last = df.groupBy("run_id").agg(F.max("snapshot_index").alias("__last"))
    return df.join(last, "run_id").filter(F.col("snapshot_index") == F.col("__last") + 1 + index).drop("__last")


def time_trace(df: DataFrame, zone: int, first: int | None = None, last: int | None = None) -> DataFrame:
    out = df.filter(F.col("zone_id") == zone)
    if first is not None:
        out = out.filter(F.col("snapshot_index") >= first)
    return out if last is None else out.filter(F.col("snapshot_index") < last)


def field_slice(df: DataFrame, name: str, times: tuple[int, int], zones: tuple[int, int]) -> DataFrame:
    """One field between half-open bounds; the filters reach the scan."""
    at = (F.col("snapshot_index") >= times[0]) & (F.col("snapshot_index") < times[1]) & (F.col("zone_id") >= zones[0]) & (F.col("zone_id") < zones[1])
    return df.filter(at).select(*RS, "zone_id", name)


def material_mask(material: int) -> Column:
    return F.abs("material_index") == abs(material)


def subset_mask(regions: list[int] | None, materials: list[int] | None) -> Column:
    """None selects everything, an empty list nothing; materials compare by absolute value."""
    out = F.lit(True)
    if regions is not None:
        out &= F.col("region_id").isin(regions) if regions else F.lit(False)
    if materials is not None:
        out &= F.abs("material_index").isin([abs(m) for m in materials]) if materials else F.lit(False)
    return out


@dataclass(frozen=True)
class Mask:
    """Arguments of the analysis mask; what is None or False does not restrict."""

    regions: list[int] | None = None
    materials: list[int] | None = None
    zones: tuple[int | None, int | None] = (None, None)
    n_zones: int = 16
    entry_region: int | None = None
    density_floor: float | None = None
    velocity_sign: int = 0
    extra: Column | None = field(default=None, compare=False)

    def column(self) -> Column:
        out = subset_mask(self.regions, self.materials)
        low, high = (None if z is None else min(max(z, 1), self.n_zones) for z in self.zones)
        if low is not None:
            out &= F.col("zone_id") >= low
        if high is not None:
            out &= F.col("zone_id") <= high
        if self.entry_region is not None:
            out &= F.col("region_id") != self.entry_region
        if self.density_floor is not None:
            out &= F.coalesce(F.col("density") >= self.density_floor, F.lit(False))
        if self.velocity_sign:
            out &= F.coalesce(F.col("velocity") * self.velocity_sign >= 0, F.lit(False))
        return out if self.extra is None else out & self.extra

    def notes(self) -> list[str]:
        said = [("subset by region or material", self.regions is not None or self.materials is not None), ("zone range", self.zones != (None, None)), ("entry region left out", self.entry_region is not None), ("density floor", self.density_floor is not None), ("velocity sign", bool(self.velocity_sign))]
        return [text for text, on in said if on]


def slab(df: DataFrame, material: int, floor: float) -> DataFrame:
    """Rows from the first to the last zone of a material that is at least ``floor`` dense, per snapshot."""
    group = Window.partitionBy(*RS)
    hit = material_mask(material) & (F.col("density") >= floor)
    spanned = df.withColumn("__lo", F.min(F.when(hit, F.col("zone_id"))).over(group)).withColumn("__hi", F.max(F.when(hit, F.col("zone_id"))).over(group))
    return spanned.filter(F.col("zone_id").between(F.col("__lo"), F.col("__hi"))).withColumnsRenamed({"__lo": "first_zone", "__hi": "last_zone"})


def valid_states(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all columns are finite and positive."""
    keep = F.lit(True)
    for c in columns:
        keep &= F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)
    return df.filter(keep)


def near_time(snapshots: DataFrame, time: float, tolerance: float) -> DataFrame:
    """Snapshots within the tolerance of a time, else the nearest one of the run (ties: the earlier)."""
    gap = F.abs(F.col("time_s") - time)
    run = Window.partitionBy("run_id")
    ranked = snapshots.withColumn("gap", gap).withColumn("rank", F.row_number().over(run.orderBy("gap", "snapshot_index"))).withColumn("any", F.max((F.col("gap") <= tolerance).cast("int")).over(run))
    return ranked.filter(F.when(F.col("any") == 1, F.col("gap") <= tolerance).otherwise(F.col("rank") == 1)).drop("rank", "any")


def capabilities(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per run, whether each optional column has any value."""
    return df.groupBy("run_id").agg(*[(F.count(c) > 0).alias(f"has_{c}") if c in df.columns else F.lit(False).alias(f"has_{c}") for c in columns])


def masked_profile(df: DataFrame, mask: Column, columns: dict[str, Column]) -> DataFrame:
    """Profiles whose deselected zones are null."""
    return df.select(*RS, "zone_id", *[F.when(mask, c).alias(n) for n, c in columns.items()])


def single_formula(df: DataFrame, formulas: DataFrame) -> DataFrame:
    """Per snapshot the distinct formulas of its materials, and the only one where there is one."""
    joined = df.withColumn("m", F.abs("material_index")).join(F.broadcast(formulas), "m", "left")
    out = joined.groupBy(*RS).agg(F.sort_array(F.collect_set("formula")).alias("f"))
    return out.select(*RS, F.array_join("f", ",").alias("formulas"), F.when(F.size("f") == 1, F.element_at("f", 1)).alias("formula"))
