"""Module registry, electron policy, warnings and the all-modules run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import written
from .reduce import weight_column, weight_mode
from .select import RS

AVOGADRO = 6.02214076e23


@dataclass(frozen=True)
class Module:
    """An analysis: the columns it needs, what of a cell it sums over which keys, its result from the sums, a check column over the result, and what it says of itself."""

    name: str
    requires: tuple[str, ...]
    keys: tuple[str, ...]
    terms: Callable[[], dict[str, Column]]
    finish: Callable[[DataFrame], DataFrame]
    check: Callable[[], Column] | None = None
    description: str = ""

    def compute(self, df: DataFrame) -> DataFrame:
        return self.finish(df.groupBy(*self.keys).agg(*[F.sum(t).alias(n) for n, t in self.terms().items()]))


REGISTRY: dict[str, Module] = {}


def register(module: Module) -> Module:
    REGISTRY[module.name] = module
    return module


def supported(df: DataFrame) -> list[str]:
    return [n for n, m in REGISTRY.items() if set(m.requires) <= set(df.columns)]


def run_modules(df: DataFrame, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Results by module; unsupported modules are left out.

    The cells are read once: the terms of all modules are summed together over the finest
    keys into a written table, and modules of coarser keys add up its rows.
    """
    able = supported(df)
    chosen = [REGISTRY[n] for n in (names or able) if n in able]
    if not chosen:
        return {}
    finest = list(dict.fromkeys(k for m in chosen for k in m.keys))
    own = {m.name: {n: f"{m.name}__{n}" for n in m.terms()} for m in chosen}
    sums = [F.sum(t).alias(own[m.name][n]) for m in chosen for n, t in m.terms().items()]
    once = written(df.groupBy(*finest).agg(*sums), "module-sums")
    return {m.name: m.finish(once.groupBy(*m.keys).agg(*[F.sum(c).alias(n) for n, c in own[m.name].items()])) for m in chosen}


def checked(name: str, result: DataFrame) -> DataFrame:
    """Result rows with a verdict instead of an exception."""
    check = REGISTRY[name].check
    return result.withColumn("sane", F.coalesce(check(), F.lit(False)) if check is not None else F.lit(True))


def described(df: DataFrame, keys: list[str]) -> DataFrame:
    """What each registered module says of itself, and for each group of ``df`` how many rows have all that it requires."""
    have = set(df.columns)
    rows = [F.struct(F.lit(m.name).alias("module"), F.lit(m.description).alias("description"), (F.greatest(*[F.col(c).isNull() for c in m.requires]) if len(m.requires) > 1 else F.col(m.requires[0]).isNull()).alias("lacks") if set(m.requires) <= have else F.lit(True).alias("lacks")) for m in REGISTRY.values()]
    out = df.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*")
    return out.groupBy(*keys, "module", "description").agg(F.count_if(~F.col("lacks")).alias("complete"))


def merge_warnings(parts: list[DataFrame]) -> DataFrame:
    """Warnings of many parts, each (source, message) once, at the place it first came from."""
    placed = [p.withColumn("place", F.lit(i + 1)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, placed).groupBy("source", "message").agg(F.min("place").alias("place"))


def merge_series(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same keys."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def electron_policy(df: DataFrame, *, cold: float, mass: float, factor: Column | None = None) -> DataFrame:
    """Effective charge as a cold baseline plus a bounded driven increment, and the electron density it gives."""
    baseline = F.least(F.col("mean_charge"), F.lit(cold))
    increment = F.greatest(F.col("mean_charge") - cold, F.lit(0.0))
    increment = increment if factor is None else increment * factor
    ions = F.col("density") / mass * AVOGADRO
    return df.withColumns({"baseline": baseline, "increment": increment, "z_effective": baseline + increment, "ion_density": ions, "ne_effective": ions * (baseline + increment)})


def driven_factor(compression: Column, te: Column, *, reference_te: float, most: float = 2.0) -> Column:
    """Bounded product of a compression and a thermal factor."""
    bound = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(most))
    return bound(bound(compression - 1.0) * bound(te / reference_te))


def _mean_terms(fields: list[str], weight: Column) -> dict[str, Column]:
    """Of each field the weighted value and the weight of cells with a value and a positive weight."""
    out = {}
    for f in fields:
        counts = F.col(f).isNotNull() & (weight > 0)
        out |= {f"{f}_value": F.when(counts, F.col(f) * weight), f"{f}_weight": F.when(counts, weight)}
    return out


def _means(sums: DataFrame, fields: list[str]) -> DataFrame:
    return sums.select(*RS, *[F.try_divide(f"{f}_value", f"{f}_weight").alias(f"mean_{f}") for f in fields])


SPECTROSCOPY, PLASMON = ["velocity", "temperature_i"], ["temperature_e", "electron_density", "mean_charge"]


def spectroscopy_result(sums: DataFrame, *, cosine: float = 0.5, line_nm: float = 500.0, mass: float = 27.0) -> DataFrame:
    v = S.los_velocity(F.col("mean_velocity"), cosine)
    return _means(sums, SPECTROSCOPY).withColumns({"los_velocity": v, "shift_nm": S.doppler_shift_nm(v * 1e5, line_nm), "width_nm": S.doppler_width_nm(F.col("mean_temperature_i"), mass, line_nm)})


def plasmon_result(sums: DataFrame, *, energy_kev: float = 8.0, angle_deg: float = 20.0) -> DataFrame:
    te, ne = F.col("mean_temperature_e"), F.col("mean_electron_density")
    k = S.wavevector_cm(F.lit(energy_kev), F.lit(angle_deg))
    out = _means(sums, PLASMON).withColumns({"debye_cm": S.debye_cm(te, ne), "plasma_energy_ev": S.plasma_energy_ev(ne), "k_debye": k * S.debye_cm(te, ne)})
    return out.withColumns({"regime": S.collectivity(F.col("k_debye")), "peak_ev": S.bohm_gross_peak_ev(ne, F.col("k_debye"))})


def transmission_result(sums: DataFrame) -> DataFrame:
    return sums.select(*RS, (F.col("column") * S.THOMSON_CM2).alias("tau")).withColumn("transmission", F.exp(-F.col("tau")))


def diffraction_result(sums: DataFrame) -> DataFrame:
    out = sums.select(*RS, "region_id", F.col("width").alias("thickness"), (F.col("mass") / F.col("width")).alias("layer_density"))
    return out.withColumn("angle", S.compressed_bragg_deg(F.col("layer_density") / 20.0, 0.3))


def _weight(module: str) -> Column:
    return weight_column(weight_mode("auto", module))


register(Module("spectroscopy", ("velocity", "temperature_i", "electron_density"), tuple(RS), lambda: _mean_terms(SPECTROSCOPY, _weight("spectroscopy")), spectroscopy_result, lambda: F.col("width_nm") >= 0, "Doppler shift and width of a line from weighted means"))
register(Module("plasmon", ("temperature_e", "electron_density", "mean_charge"), tuple(RS), lambda: _mean_terms(PLASMON, _weight("plasmon")), plasmon_result, lambda: F.col("k_debye") > 0, "Plasma state, scattering regime and quick-look peak"))
register(Module("transmission", ("electron_density", "width_cm"), tuple(RS), lambda: {"column": F.col("electron_density") * F.col("width_cm")}, transmission_result, lambda: F.col("transmission").between(0, 1), "Thomson depth and transmission"))
register(Module("xrd", ("density", "width_cm", "region_id"), (*RS, "region_id"), lambda: {"width": F.col("width_cm"), "mass": F.col("density") * F.col("width_cm")}, diffraction_result, lambda: F.col("angle").between(0, 90), "Layer density and shifted Bragg angle"))
