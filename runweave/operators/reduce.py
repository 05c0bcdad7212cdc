"""Weighted means, budgets and other reductions per snapshot, region or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .select import RS

#: Weight of each analysis module where none is asked for.
DEFAULT_WEIGHT = {"xrd": "mass", "spectroscopy": "electron_column", "plasmon": "electron_column", "transmission": "width", "shock": "simple"}


def weight_mode(requested: str, module: str) -> str:
    return DEFAULT_WEIGHT.get(module, "simple") if requested == "auto" else requested


def weight_column(mode: str, *, path: str = "width_cm", density: str = "density", electrons: str = "electron_density", shell: str | None = None) -> Column:
    """A zone's weight: simple, width, mass (with a shell factor if cylindrical), electron_density, electron_column."""
    if mode == "simple":
        return F.lit(1.0)
    if mode == "width":
        return F.col(path)
    if mode == "mass":
        return F.col(density) * F.col(shell or path)
    if mode == "electron_density":
        return F.col(electrons)
    if mode == "electron_column":
        return F.col(electrons) * F.col(path)
    raise ValueError(f"unknown weighting mode {mode}")


def weighted_mean(value: Column, weight: Column, where: Column | None = None) -> Column:
    """Over rows with a value and a positive weight; null if there are none."""
    ok = value.isNotNull() & (weight > 0)
    ok = ok if where is None else ok & where
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def mean_series(df: DataFrame, fields: list[str], weight: Column, mask: Column | None = None) -> DataFrame:
    """Weighted means of many fields per snapshot in one aggregation."""
    return df.groupBy(*RS).agg(*[weighted_mean(F.col(f), weight, mask).alias(f"mean_{f}") for f in fields])


def with_total(df: DataFrame, keys: list[str], last: str, aggregates: list[Column]) -> DataFrame:
    """The aggregates by keys and by keys without ``last`` (null there), both levels in one pass."""
    sets = df.groupingSets([keys, [k for k in keys if k != last]], *keys)
    return sets.agg(*aggregates)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """First value whose cumulative weight reaches half of the total."""
    rows = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    by = Window.partitionBy(*keys)
    run = by.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    cum = rows.withColumn("__cum", F.sum(weight).over(run)).withColumn("__all", F.sum(weight).over(by))
    return cum.filter(F.col("__cum") >= 0.5 * F.col("__all")).groupBy(*keys).agg(F.min(value).alias("median"))


def total_pressure(df: DataFrame, total: str, parts: list[str]) -> Column:
    """The total where given, else the sum of the components that are; null if none is."""
    have = F.lit(False)
    for p in parts:
        have |= F.col(p).isNotNull()
    summed = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0.0)))
    return F.coalesce(F.col(total), F.when(have, summed))


def robust_scale(value: Column, floor: float, q: float = 0.8) -> Column:
    """Percentile of absolute values, no lower than a floor; an aggregate."""
    return F.greatest(F.percentile(F.abs(value), F.lit(q)), F.lit(floor))


def activation_threshold(score: Column, minimum: float = 0.025, share: float = 0.15, q: float = 0.95) -> Column:
    positive = F.when(score > 0, score)
    return F.greatest(F.lit(minimum), share * F.coalesce(F.percentile(positive, F.lit(q)), F.lit(0.0)))


def cluster_states(df: DataFrame, ne: str, te: str, z: str, weight: str, tol: tuple[float, float, float]) -> DataFrame:
    """Clusters of plasma states by rounded log density, log temperature and charge, heaviest first per snapshot."""
    keyed = df.withColumns({"k_ne": F.rint(F.log10(ne) / tol[0]), "k_te": F.rint(F.log10(te) / tol[1]), "k_z": F.rint(F.col(z) / tol[2])})
    keys = [*RS, "k_ne", "k_te", "k_z"]
    w = F.col(weight)
    out = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("weight"), weighted_mean(F.col(ne), w).alias("mean_ne"), weighted_mean(F.col(te), w).alias("mean_te"), weighted_mean(F.col(z), w).alias("mean_z"))
    order = Window.partitionBy(*RS).orderBy(F.desc("weight"), F.desc("k_ne"), F.desc("k_te"), F.desc("k_z"))
    return out.withColumn("cluster", F.row_number().over(order))


def error_metrics(df: DataFrame, keys: list[str], predicted: str, truth: str) -> DataFrame:
    """Count, mean absolute, root mean square and largest error over rows that have both values."""
    e = F.col(predicted) - F.col(truth)
    return df.filter(F.col(predicted).isNotNull() & F.col(truth).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_error"))


def mean_charge(fractions: Column) -> Column:
    return F.aggregate(F.transform(fractions, lambda f, q: f * q), F.lit(0.0), lambda a, x: a + x)


def dominant_charge(fractions: Column) -> Column:
    """First index of the largest fraction."""
    return (F.array_position(fractions, F.array_max(fractions)) - 1).cast("int")


def close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def mode_depths(df: DataFrame, energy_kev: Column, mu: Column) -> DataFrame:
    """Optical depth of each zone by mode: tau_thomson, tau_free_free, tau_table, and ``tau``, that of the zone's ``regime``.

    Plasma takes free-free and Thomson, cold matter the attenuation table (``mu``, cm2/g),
    the rest Thomson. An unknown or infinite free-free coefficient counts as none.
    """
    w = F.col("width_cm")
    alpha = S.free_free_per_m(F.col("temperature_e"), F.col("electron_density"), F.col("mean_charge"), energy_kev)
    absorbed = F.when(alpha < float("inf"), alpha * w / 100.0)
    out = df.withColumns({"tau_thomson": F.col("electron_density") * S.THOMSON_CM2 * w, "tau_free_free": F.coalesce(absorbed, F.lit(0.0)), "tau_table": mu * F.col("density") * w})
    chosen = F.when(F.col("regime") == "plasma", F.col("tau_thomson") + F.col("tau_free_free")).when(F.col("regime") == "cold", F.col("tau_table")).otherwise(F.col("tau_thomson"))
    return out.withColumn("tau", chosen)


def regime_shares(df: DataFrame, keys: list[str], regime: str, tau: str, path: str, small: float = 1e-8) -> DataFrame:
    """Optical depth and path by regime, each regime's share, and the dominant regime of the keys."""
    sums = df.groupBy(*keys, regime).agg(F.sum(tau).alias("tau"), F.sum(path).alias("path"))
    by = Window.partitionBy(*keys)
    depth = F.when(F.col("tau") > small, F.col("tau")).otherwise(-1.0)  # where none is opaque all tie and the path decides
    rank = F.row_number().over(by.orderBy(F.desc(depth), F.desc("path"), F.desc(regime)))
    return sums.withColumn("share", F.coalesce(F.try_divide("tau", F.sum("tau").over(by)), F.lit(0.0))).withColumn("dominant", rank == 1)
