"""Preheat of a target region before a front arrives."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reduce import weighted_mean
from .select import RS, RZ
from .windows import trapezoid


@dataclass(frozen=True)
class Preheat:
    """Thresholds of modification, of the unshocked state and of severity."""

    delta_te: float = 1.0
    delta_charge: float = 0.05
    delta_electron_energy: float = 1.0e7
    radiation_heating: float = 1.0e10
    laser_deposition: float = 1.0e10
    max_ratio: float = 1.10
    max_relative_pressure: float = 0.25
    moderate_fraction: float = 0.10
    severe_fraction: float = 0.35
    moderate_te: float = 3.0
    severe_te: float = 10.0


def compressive_branch(branches: DataFrame) -> DataFrame:
    """Per run the primary compressive branch: the one flagged, else the best supported and most significant.

    The ranking prefers support and significance throughout.
    """
    rows = branches.filter(F.col("branch_type").isin("compressive_shock", "transmitted_shock", "reflected_shock") & (F.col("support") != "provisional"))
    rank = Window.partitionBy("run_id").orderBy(F.desc("primary_branch"), F.when(F.col("support") == "tracked", 0).otherwise(1), F.desc("significance"), F.desc("samples"), "branch_id")
    return rows.withColumn("__k", F.row_number().over(rank)).filter("__k = 1").drop("__k")


def target_region(candidates: DataFrame, incident: str = "incident_region") -> DataFrame:
    """Per run the region most like a sample: mass and width scores with bonuses for its place on the path.

    ``candidates``: run_id, region_id, mass, width, path_rank, path_count and the incident region.
    """
    run = Window.partitionBy("run_id")
    other = F.col("region_id") != F.col(incident)
    pool = candidates.withColumn("__others", F.max(other.cast("int")).over(run)).filter(other | (F.col("__others") == 0))
    pool = pool.withColumns({"mass_score": F.coalesce(F.try_divide("mass", F.max("mass").over(run)), F.lit(0.0)), "width_score": F.coalesce(F.try_divide("width", F.max("width").over(run)), F.lit(0.0))})
    rank, count = F.col("path_rank"), F.col("path_count")
    bonus = F.when(other, 0.75).otherwise(0.0) + F.when((rank > 0) & (rank < F.greatest(F.lit(1), count - 1)), 0.35).otherwise(0.0)
    bonus = bonus - F.when((count > 2) & (rank == count - 1), 0.20).otherwise(0.0) + F.when(rank >= 2, 0.10).otherwise(0.0)
    pool = pool.withColumn("score", 1.10 * F.col("mass_score") + 0.35 * F.col("width_score") + bonus)
    order = run.orderBy(F.desc(F.round("score", 9)), F.desc("mass_score"), F.desc("width_score"), "path_rank")
    return pool.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k", "__others")


def changes(df: DataFrame, group: list[str] = ["run_id"]) -> DataFrame:
    """Changes of each zone against its first snapshot; those of the energies only where they are known.

    The relative pressure divides by the first pressure plus 1 % of the median positive
    first pressure of the ``group``, 1e-9 at least.
    """
    over = Window.partitionBy(*RZ).orderBy("snapshot_index")
    first = lambda c: F.first(c).over(over)
    rows = df.withColumns({"__p": first("pressure"), "__k": F.row_number().over(over)})
    median = F.percentile(F.when((F.col("__k") == 1) & (F.col("__p") > 0), F.col("__p")), F.lit(0.5))  # a value a zone
    slack = rows.groupBy(*group).agg(F.greatest(F.lit(1e-9), 0.01 * F.coalesce(median, F.lit(0.0))).alias("__eps"))
    new = {"delta_te": F.col("temperature_e") - first("temperature_e"), "delta_charge": F.col("mean_charge") - first("mean_charge"), "ratio": F.try_divide(F.col("density"), first("density")), "relative_pressure": (F.col("pressure") - F.col("__p")) / (F.col("__p") + F.col("__eps"))}
    if "electron_energy" in df.columns:
        new["delta_electron_energy"] = F.col("electron_energy") - first("electron_energy")
    return rows.join(slack, group).withColumns(new).drop("__p", "__k", "__eps")


def preheated(df: DataFrame, p: Preheat = Preheat()):
    """Modified but not yet shocked; false where unknown.

    Any change of temperature or charge modifies a zone, and where ``df`` has the
    columns, one of electron energy (J/g), net radiative heating or laser deposition (J/g/s).
    """
    tests = {"delta_te": p.delta_te, "delta_charge": p.delta_charge, "delta_electron_energy": p.delta_electron_energy, "radiation_net_heating": p.radiation_heating, "laser_deposition": p.laser_deposition}
    modified = reduce(or_, [F.coalesce(F.col(c) >= least, F.lit(False)) for c, least in tests.items() if c in df.columns])
    calm = (F.col("ratio") < p.max_ratio) & (F.col("relative_pressure") < p.max_relative_pressure)
    return F.coalesce(modified & calm, F.lit(False))


#: Rates of gain (J/g/s) and energies (J/g) whose areal sums make a budget, as far as a run has them.
RATES = ("laser_deposition", "laser_source", "radiation_net_heating")
ENERGIES = ("electron_energy", "ion_energy", "radiation_energy")
#: What can dominate a budget, in the order that decides between equals.
LASER, RADIATION, RESIDUAL = "laser deposition", "net radiation heating", "residual processes"


def preheat_series(df: DataFrame, entry: DataFrame, p: Preheat = Preheat()) -> DataFrame:
    """Affected width and mass fractions, mean changes, areal energies (J/cm2) and rates of the target's snapshots before the entry time.

    ``entry``: run_id, region_id, entry_time. Of RATES and ENERGIES those that ``df`` has
    are summed; ``internal_energy`` sums the energies it has, and is null without any.
    """
    target = df.join(entry, ["run_id", "region_id"])
    rows = changes(target, ["run_id", "region_id"])
    on = preheated(rows, p) & (F.col("time_s") < F.col("entry_time"))
    mass = F.col("density") * F.col("width_cm")
    part = lambda w: F.try_divide(F.sum(F.when(on, w).otherwise(0.0)), F.sum(w))
    areal = {c: F.coalesce(F.sum(mass * F.col(c)), F.lit(0.0)) for c in (*RATES, *ENERGIES) if c in df.columns}
    energies = [areal[c] for c in ENERGIES if c in areal]
    internal = sum(energies[1:], energies[0]) if energies else F.lit(None).cast("double")
    sums = [areal.get(c, F.lit(None).cast("double")).alias(c) for c in (*RATES, *ENERGIES)]
    out = rows.groupBy(*RS, "time_s", "entry_time").agg(part(F.col("width_cm")).alias("width_fraction"), part(mass).alias("mass_fraction"), weighted_mean(F.col("delta_te"), mass, on).alias("mean_delta_te"), F.max(F.when(on, F.col("delta_te"))).alias("max_delta_te"), *sums, internal.alias("internal_energy"))
    return out.filter(F.col("time_s") < F.col("entry_time"))


def energy_budget(series: DataFrame, event_energy: DataFrame | None = None) -> DataFrame:
    """Per run: ``budget``, a map of what each rate gave and each energy gained, ``fractions`` of the internal gain, the dominant source, residual and penalty ratio.

    ``series`` as ``preheat_series`` gives it. All rates are integrated in one pass over a
    run's snapshots. The residual is the internal gain less laser (deposition, or else source) and
    radiation. ``event_energy``: run_id and event_energy (J/cm2), which the internal gain is set against.
    """
    over = Window.partitionBy("run_id").orderBy("snapshot_index")
    added = series.withColumns({c: F.when(F.col(c).isNotNull(), trapezoid(F.col(c), "time_s", over, clamp=False)) for c in RATES})
    gain = lambda c: (F.max_by(c, "snapshot_index") - F.min_by(c, "snapshot_index")).alias(c)
    out = added.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in RATES], *[gain(c) for c in (*ENERGIES, "internal_energy")])
    laser, radiation, gained = F.coalesce("laser_deposition", "laser_source"), F.col("radiation_net_heating"), F.col("internal_energy")
    residual = gained - (F.coalesce(laser, F.lit(0.0)) + F.coalesce(radiation, F.lit(0.0)))
    strength = [(LASER, laser), (RADIATION, radiation), (RESIDUAL, residual)]
    ranked = F.array(*[F.struct(F.coalesce(F.abs(v), F.lit(-1.0)).alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(strength)])
    top = F.array_max(ranked)
    channels = {**{c: F.col(c) for c in (*RATES, *ENERGIES, "internal_energy")}, "residual": residual}
    made = F.map_filter(F.create_map(*[x for n, v in channels.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    out = out.select("run_id", made.alias("budget"), F.when(gained != 0, F.transform_values(made, lambda _, v: v / gained)).alias("fractions"), gained.alias("gained"), residual.alias("residual"), F.when(top["v"] >= 0, top["n"]).alias("dominant_source"))
    if event_energy is None:
        return out.withColumn("penalty_ratio", F.lit(None).cast("double"))
    ratio = F.when(F.col("event_energy") > 0, F.greatest("gained", F.lit(0.0)) / F.col("event_energy"))
    return out.join(event_energy, "run_id", "left").withColumn("penalty_ratio", ratio).drop("event_energy")


def severity(fraction, delta, p: Preheat = Preheat()):
    f, d = F.coalesce(fraction, F.lit(0.0)), F.coalesce(delta, F.lit(0.0))
    return F.when((f >= p.severe_fraction) | (d >= p.severe_te), "severe").when((f >= p.moderate_fraction) | (d >= p.moderate_te), "moderate").when((f > 0) | (d > 0), "mild").otherwise("negligible")


def preheat_summary(series: DataFrame, event_energy: DataFrame | None = None, p: Preheat = Preheat()) -> DataFrame:
    """Per run: peak fractions, the snapshot of the peak, severity, and the energy budget of the preheated target."""
    pick = F.struct(F.coalesce(F.col("mass_fraction"), F.lit(-1.0)), -F.col("snapshot_index"))
    out = series.groupBy("run_id").agg(F.count("*").alias("snapshots"), F.max("width_fraction").alias("peak_width_fraction"), F.max("mass_fraction").alias("peak_mass_fraction"), F.max_by("snapshot_index", pick).alias("peak_snapshot"), F.max_by("mean_delta_te", pick).alias("delta_te_at_peak"), F.max("max_delta_te").alias("peak_delta_te"))
    return out.withColumn("severity", severity(F.col("peak_width_fraction"), F.col("peak_delta_te"), p)).join(energy_budget(series, event_energy), "run_id")
