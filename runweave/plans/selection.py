"""Queries of the selection, weighting and reduction operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quantiles as Q
from ..operators import reduce as R
from ..operators import select as sel
from ..operators import windows as win
from .grid import query, regions, zone_state

RS = sel.RS
MASK = sel.Mask(regions=[1, 2, 3], materials=[1, 2, 3], zones=(2, 14), density_floor=1e1, velocity_sign=1)
MASK_SQL = "region_id IN (1, 2, 3) AND abs(material_index) IN (1, 2, 3) AND zone_id BETWEEN 2 AND 14 AND density >= 1e1 AND velocity >= 0"


@query("lineout", "run_id snapshot_index zone_id", "density", "SELECT * FROM g WHERE snapshot_index = 20")
def lineout(spark, d):
    return sel.snapshot(zone_state(spark, d), 20).select(*RS, "zone_id", "density")


@query("lineout_last", "run_id snapshot_index zone_id", "density", "SELECT * FROM g JOIN (SELECT run_id, max(snapshot_index) AS m FROM g GROUP BY 1) USING (run_id) WHERE snapshot_index = m - 1")
def lineout_last(spark, d):
    return sel.snapshot(zone_state(spark, d), -2).select(*RS, "zone_id", "density")


@query("time_trace", "run_id snapshot_index", "time_s pressure", "SELECT * FROM g WHERE zone_id = 5 AND snapshot_index BETWEEN 14 AND 29")
def time_trace(spark, d):
    return sel.time_trace(zone_state(spark, d), 5, 14, 30).select(*RS, "time_s", "pressure")


@query("field_slice", "run_id snapshot_index zone_id", "velocity", "SELECT * FROM g WHERE snapshot_index BETWEEN 16 AND 23 AND zone_id BETWEEN 3 AND 8")
def field_slice(spark, d):
    return sel.field_slice(zone_state(spark, d), "velocity", (16, 24), (3, 9))


@query("subset_mask", "run_id snapshot_index zone_id selected none_selected", "", "SELECT *, region_id IN (2, 4) AND abs(material_index) IN (2, 3, 4) AS selected, false AS none_selected FROM g")
def subset_mask(spark, d):
    return zone_state(spark, d).select(*RS, "zone_id", sel.subset_mask([2, 4], [2, 3, -4]).alias("selected"), sel.subset_mask([], None).alias("none_selected"))


@query("region_material_mask", "run_id region_id n n_material", "", "SELECT run_id, region_id, count(*) AS n, count(*) FILTER (WHERE abs(material_index) = 2) AS n_material FROM g GROUP BY ALL")
def region_material_mask(spark, d):
    return zone_state(spark, d).groupBy("run_id", "region_id").agg(F.count("*").alias("n"), F.count_if(sel.material_mask(-2)).alias("n_material"))


@query("analysis_mask", "run_id snapshot_index zone_id active", "", f"SELECT *, {MASK_SQL} AS active FROM g")
def analysis_mask(spark, d):
    return zone_state(spark, d).select(*RS, "zone_id", MASK.column().alias("active"))


@query("mask_counts", "run_id snapshot_index n_active n_zones", "", f"SELECT run_id, snapshot_index, count(*) FILTER (WHERE {MASK_SQL}) AS n_active, count(*) AS n_zones FROM g GROUP BY ALL")
def mask_counts(spark, d):
    return zone_state(spark, d).groupBy(*RS).agg(F.count_if(MASK.column()).alias("n_active"), F.count("*").alias("n_zones"))


@query("weighted_mean_series", "run_id snapshot_index", "mean_pressure mean_velocity mean_temperature_e areal", f"SELECT run_id, snapshot_index, sum(pressure * density * width_cm) FILTER (WHERE {MASK_SQL}) / sum(density * width_cm) FILTER (WHERE {MASK_SQL}) AS mean_pressure, sum(velocity * density * width_cm) FILTER (WHERE {MASK_SQL}) / sum(density * width_cm) FILTER (WHERE {MASK_SQL}) AS mean_velocity, sum(temperature_e * density * width_cm) FILTER (WHERE {MASK_SQL}) / sum(density * width_cm) FILTER (WHERE {MASK_SQL}) AS mean_temperature_e, sum(density * width_cm) FILTER (WHERE {MASK_SQL}) AS areal FROM g GROUP BY ALL")
def weighted_mean_series(spark, d):
    w, m = R.weight_column(R.weight_mode("auto", "xrd")), MASK.column()
    fields = ["pressure", "velocity", "temperature_e"]
    return zone_state(spark, d).groupBy(*RS).agg(*[R.weighted_mean(F.col(f), w, m).alias(f"mean_{f}") for f in fields], F.sum(F.when(m, F.col("density") * F.col("width_cm"))).alias("areal"))


WEIGHTS = {"simple": "1e0", "width": "width_cm", "mass": "density * width_cm", "electron_density": "electron_density", "electron_column": "electron_density * width_cm"}


@query("weighting_modes", "run_id", " ".join(f"te_{m}" for m in WEIGHTS), "SELECT run_id, " + ", ".join(f"sum(temperature_e * {w}) / sum({w}) AS te_{m}" for m, w in WEIGHTS.items()) + " FROM g GROUP BY 1")
def weighting_modes(spark, d):
    return zone_state(spark, d).groupBy("run_id").agg(*[R.weighted_mean(F.col("temperature_e"), R.weight_column(m)).alias(f"te_{m}") for m in WEIGHTS])


CASES = {"all": ("true", sel.Mask()), "dense": ("density >= 2e1", sel.Mask(density_floor=2e1)), "inner": ("zone_id <= 8", sel.Mask(zones=(None, 8))), "forward": ("velocity >= 0", sel.Mask(velocity_sign=1)), "no_entry": ("region_id <> 4", sel.Mask(entry_region=4))}


@query("selection_cases", "run_id", " ".join(f"rho_{c}" for c in CASES), "SELECT run_id, " + ", ".join(f"avg(density) FILTER (WHERE {s}) AS rho_{c}" for c, (s, _) in CASES.items()) + " FROM g GROUP BY 1")
def selection_cases(spark, d):
    return zone_state(spark, d).groupBy("run_id").agg(*[R.weighted_mean(F.col("density"), F.lit(1.0), m.column()).alias(f"rho_{c}") for c, (_, m) in CASES.items()])


@query("slab_selection", "run_id snapshot_index first_zone last_zone n", "mean_density path", "b AS (SELECT run_id, snapshot_index, min(zone_id) AS first_zone, max(zone_id) AS last_zone FROM g WHERE abs(material_index) = 2 AND density >= 2e1 GROUP BY 1, 2) ;; SELECT run_id, snapshot_index, first_zone, last_zone, count(*) AS n, sum(density * width_cm) / sum(width_cm) AS mean_density, sum(width_cm) AS path FROM g JOIN b USING (run_id, snapshot_index) WHERE zone_id BETWEEN first_zone AND last_zone GROUP BY ALL")
def slab_selection(spark, d):
    rows = sel.slab(zone_state(spark, d), 2, 2e1)
    return rows.groupBy(*RS, "first_zone", "last_zone").agg(F.count("*").alias("n"), R.weighted_mean(F.col("density"), F.col("width_cm")).alias("mean_density"), F.sum("width_cm").alias("path"))


@query("capability_flags", "run_id has_pressure has_radiation", "", "SELECT run_id, count(pressure) > 0 AS has_pressure, false AS has_radiation FROM g GROUP BY 1")
def capability_flags(spark, d):
    return sel.capabilities(zone_state(spark, d), ["pressure", "radiation"])


@query("valid_states", "run_id n", "", "SELECT run_id, count(*) AS n FROM g WHERE temperature_e > 0 AND temperature_i > 0 AND electron_density > 0 AND mean_charge > 0 AND velocity > 0 GROUP BY 1")
def valid_states(spark, d):
    return sel.valid_states(zone_state(spark, d), ["temperature_e", "temperature_i", "electron_density", "mean_charge", "velocity"]).groupBy("run_id").agg(F.count("*").alias("n"))


@query("near_probe_time", "run_id snapshot_index", "gap", "s AS (SELECT DISTINCT run_id, snapshot_index, time_s, abs(time_s - 2.234e0) AS gap FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY gap, snapshot_index) AS r, bool_or(gap <= 2e-1) OVER (PARTITION BY run_id) AS near_any FROM s) ;; SELECT * FROM k WHERE CASE WHEN near_any THEN gap <= 2e-1 ELSE r = 1 END")
def near_probe_time(spark, d):
    return sel.near_time(zone_state(spark, d).select(*RS, "time_s").distinct(), 2.234, 0.2).select(*RS, "gap")


@query("masked_profiles", "run_id snapshot_index zone_id", "velocity ti shift", f"SELECT run_id, snapshot_index, zone_id, CASE WHEN {MASK_SQL} THEN velocity END AS velocity, CASE WHEN {MASK_SQL} THEN temperature_i END AS ti, CASE WHEN {MASK_SQL} THEN velocity * 5e-1 * 1e4 END AS shift FROM g")
def masked_profiles(spark, d):
    return sel.masked_profile(zone_state(spark, d), MASK.column(), {"velocity": F.col("velocity"), "ti": F.col("temperature_i"), "shift": S.los_velocity(F.col("velocity"), 0.5) * 1e4})


@query("single_formula", "run_id snapshot_index formulas formula", "", "f(m, formula) AS (VALUES (1, 'CH'), (2, 'Al'), (3, 'Al')), u AS (SELECT run_id, snapshot_index, list_sort(list_distinct(list(formula))) AS f FROM (SELECT g.*, f.formula FROM g LEFT JOIN f ON abs(material_index) = m) GROUP BY 1, 2) ;; SELECT run_id, snapshot_index, coalesce(array_to_string(f, ','), '') AS formulas, CASE WHEN len(f) = 1 THEN f[1] END AS formula FROM u")
def single_formula(spark, d):
    f = spark.createDataFrame([(1, "CH"), (2, "Al"), (3, "Al")], "m int, formula string")
    return sel.single_formula(zone_state(spark, d), f)


@query("unresolved_materials", "run_id material", "", "SELECT DISTINCT run_id, abs(material_index) AS material FROM g WHERE abs(material_index) NOT IN (1, 2, 3)")
def unresolved_materials(spark, d):
    known = spark.createDataFrame([(1,), (2,), (3,)], "material int")
    return zone_state(spark, d).select("run_id", F.abs("material_index").alias("material")).distinct().join(known, "material", "left_anti")


@query("region_layers", "run_id snapshot_index region_id n", "thickness density compression d_ratio angle", "f AS (SELECT run_id, zone_id, min_by(density, snapshot_index) AS rho0 FROM g GROUP BY 1, 2), l AS (SELECT run_id, snapshot_index, region_id, count(*) AS n, sum(width_cm) AS thickness, sum(density * width_cm) / sum(width_cm) AS density, sum(density * width_cm) / sum(rho0 * width_cm) AS compression FROM g JOIN f USING (run_id, zone_id) GROUP BY 1, 2, 3) ;; SELECT *, pow(compression, -1e0 / 3e0) AS d_ratio, CASE WHEN 3e-1 * pow(compression, 1e0 / 3e0) <= 1 THEN degrees(asin(least(3e-1 * pow(compression, 1e0 / 3e0), 1e0))) END AS angle FROM l")
def region_layers(spark, d):
    z = zone_state(spark, d).withColumn("rho0", F.first("density").over(win.time()))
    w = F.col("width_cm")
    out = z.groupBy(*RS, "region_id").agg(F.count("*").alias("n"), F.sum(w).alias("thickness"), R.weighted_mean(F.col("density"), w).alias("density"), F.try_divide(F.sum(F.col("density") * w), F.sum(F.col("rho0") * w)).alias("compression"))
    return out.withColumns({"d_ratio": F.pow("compression", F.lit(-1.0 / 3.0)), "angle": S.compressed_bragg_deg(F.col("compression"), 0.3)})


@query("budget_rollup", "run_id snapshot_index region_id", "areal column_ne tau transmission", "SELECT run_id, snapshot_index, region_id, sum(density * width_cm) AS areal, sum(electron_density * width_cm) / 1e20 AS column_ne, sum(electron_density * width_cm) * 6.6524587321e-25 AS tau, exp(-sum(electron_density * width_cm) * 6.6524587321e-25) AS transmission FROM g GROUP BY GROUPING SETS ((run_id, snapshot_index, region_id), (run_id, snapshot_index))")
def budget_rollup(spark, d):
    column = F.sum(F.col("electron_density") * F.col("width_cm"))
    out = R.with_total(zone_state(spark, d), [*RS, "region_id"], "region_id", [F.sum(F.col("density") * F.col("width_cm")).alias("areal"), (column / 1e20).alias("column_ne"), (column * S.THOMSON_CM2).alias("tau")])
    return out.withColumn("transmission", F.exp(-F.col("tau")))


REGIME_SQL = "CASE WHEN te >= 2.5e1 OR ratio <= 5.5e-1 OR (te >= 1.5e1 AND ratio <= 7.5e-1) THEN 'plasma' WHEN m <> 4 AND ((te <= 1.2e1 AND ratio >= 7.2e-1) OR (te <= 1.8e1 AND ratio >= 5.5e-1)) THEN 'cold' ELSE 'fallback' END"
RATIO_SQL = "f AS (SELECT run_id, zone_id, min_by(density, snapshot_index) AS rho0 FROM g GROUP BY 1, 2), q AS (SELECT g.*, temperature_e AS te, abs(material_index) AS m, density / rho0 AS ratio FROM g JOIN f USING (run_id, zone_id)), z AS (SELECT *, " + REGIME_SQL + " AS regime FROM q)"


def with_regime(spark, d):
    z = zone_state(spark, d).withColumn("rho0", F.first("density").over(win.time()))
    ratio = S.density_ratio(F.col("density"), F.lit(None).cast("double"), F.col("rho0"))
    return z.withColumn("ratio", ratio).withColumn("regime", S.zone_regime(F.col("temperature_e"), F.col("ratio"), F.abs("material_index") != 4))


@query("zone_regimes", "run_id snapshot_index zone_id regime", "ratio", RATIO_SQL + " ;; SELECT * FROM z")
def zone_regimes(spark, d):
    return with_regime(spark, d).select(*RS, "zone_id", "regime", "ratio")


DEPTH_SQL = RATIO_SQL + ", da AS (SELECT *, 7.43e2 * sqrt(te / electron_density) AS ld, greatest(1.44e-7 * greatest(mean_charge, 1e0) / te, 2.76e-8 / sqrt(te)) AS rmin, 1e3 / 6.582119569e-16 AS om FROM z), db AS (SELECT *, 1e0 - pow(5.64e4 * sqrt(electron_density) / om, 2) AS cut, electron_density * 6.6524587321e-25 * width_cm AS tt, 1e-4 * density * width_cm AS tx FROM da), dc AS (SELECT *, CASE WHEN ld > rmin AND cut > 0 THEN 3.1e-17 * mean_charge * electron_density * 1e6 * electron_density * 1e6 * ln(ld / rmin) * pow(te, -1.5e0) * pow(om, -2e0) * pow(cut, -5e-1) * width_cm / 1e2 ELSE 0 END AS tf FROM db), de AS (SELECT *, CASE regime WHEN 'plasma' THEN tt + tf WHEN 'cold' THEN tx ELSE tt END AS ts FROM dc)"


def with_depths(spark, d):
    return R.mode_depths(with_regime(spark, d), F.lit(1.0), F.lit(1e-4))


@query("mode_depths", "run_id snapshot_index region_id", "thomson free_free attenuation selected", DEPTH_SQL + " ;; SELECT run_id, snapshot_index, region_id, sum(tt) AS thomson, sum(tf) AS free_free, sum(tx) AS attenuation, sum(ts) AS selected FROM de GROUP BY 1, 2, 3")
def mode_depths(spark, d):
    total = {"thomson": "tau_thomson", "free_free": "tau_free_free", "attenuation": "tau_table", "selected": "tau"}
    return with_depths(spark, d).groupBy(*RS, "region_id").agg(*[F.sum(c).alias(n) for n, c in total.items()])


@query("regime_budget", "run_id snapshot_index region_id regime dominant", "tau path share", DEPTH_SQL + ", t AS (SELECT run_id, snapshot_index, region_id, regime, sum(ts) AS tau, sum(width_cm) AS path FROM de GROUP BY 1, 2, 3, 4) ;; SELECT *, tau / sum(tau) OVER w AS share, row_number() OVER (PARTITION BY run_id, snapshot_index, region_id ORDER BY CASE WHEN tau > 1e-8 THEN tau ELSE -1 END DESC, path DESC, regime DESC) = 1 AS dominant FROM t WINDOW w AS (PARTITION BY run_id, snapshot_index, region_id)")
def regime_budget(spark, d):
    return R.regime_shares(with_depths(spark, d), [*RS, "region_id"], "regime", "tau", "width_cm")


@query("transmission_series", "run_id snapshot_index", "tau transmission", "SELECT run_id, snapshot_index, sum(density * width_cm * 1e-3) AS tau, exp(-sum(density * width_cm * 1e-3)) AS transmission FROM g GROUP BY 1, 2")
def transmission_series(spark, d):
    return zone_state(spark, d).groupBy(*RS).agg(F.sum(F.col("density") * F.col("width_cm") * 1e-3).alias("tau")).withColumn("transmission", F.exp(-F.col("tau")))


@query("exact_quantiles", "l_returnflag l_linenumber", "quantile tenth", "SELECT l_returnflag, l_linenumber, quantile_cont(l_extendedprice, 95e-2) AS quantile, quantile_cont(l_quantity, 1e-1) AS tenth FROM lineitem GROUP BY 1, 2", grid=False)
def exact_quantiles(spark, d):
    """Quantiles of prices and, with many equal ones, of quantities, closed in on by passes."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_linenumber", "l_extendedprice", "l_quantity")
    keys = ["l_returnflag", "l_linenumber"]
    q = Q.exact_quantiles(lines, keys, "l_extendedprice", 0.95, held=100)
    return q.join(Q.exact_quantiles(lines, keys, "l_quantity", 0.1, name="tenth", held=100), keys)


@query("weighted_median", "run_id snapshot_index", "median", "c AS (SELECT run_id, snapshot_index, temperature_e, sum(width_cm) OVER (PARTITION BY run_id, snapshot_index ORDER BY temperature_e) AS cum, sum(width_cm) OVER (PARTITION BY run_id, snapshot_index) AS total FROM g) ;; SELECT run_id, snapshot_index, min(temperature_e) AS median FROM c WHERE cum >= 5e-1 * total GROUP BY 1, 2")
def weighted_median(spark, d):
    return R.weighted_median(zone_state(spark, d), RS, "temperature_e", "width_cm")


@query("applicability", "run_id snapshot_index verdict", "cold_fraction hot_fraction", RATIO_SQL + ", a AS (SELECT run_id, snapshot_index, sum(width_cm) FILTER (WHERE te <= 1.8e1 AND ratio >= 5.5e-1) AS cold, sum(width_cm) FILTER (WHERE te >= 2.5e1 OR ratio <= 5.5e-1) AS hot, sum(width_cm) AS total FROM z GROUP BY 1, 2) ;; SELECT run_id, snapshot_index, coalesce(cold, 0) / total AS cold_fraction, coalesce(hot, 0) / total AS hot_fraction, CASE WHEN coalesce(cold, 0) / total >= 7.5e-1 THEN 'recommended' WHEN coalesce(hot, 0) / total > 5e-1 THEN 'not_recommended' ELSE 'borderline' END AS verdict FROM a")
def applicability(spark, d):
    z, w, te, ratio = with_regime(spark, d), F.col("width_cm"), F.col("temperature_e"), F.col("ratio")
    part = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0)) / F.sum(w)
    out = z.groupBy(*RS).agg(part((te <= S.REGIME["cold_mid_te"]) & (ratio >= S.REGIME["cold_mid_ratio"])).alias("cold_fraction"), part((te >= S.REGIME["plasma_te"]) | (ratio <= S.REGIME["plasma_ratio"])).alias("hot_fraction"))
    return out.withColumn("verdict", F.when(F.col("cold_fraction") >= 0.75, "recommended").when(F.col("hot_fraction") > 0.5, "not_recommended").otherwise("borderline"))


@query("region_initial_metrics", "run_id region_id", "width mass", "SELECT run_id, region_id, sum(width_cm) AS width, sum(density * width_cm) AS mass FROM g JOIN (SELECT run_id, min(snapshot_index) AS m FROM g GROUP BY 1) USING (run_id) WHERE snapshot_index = m GROUP BY 1, 2")
def region_initial_metrics(spark, d):
    z = zone_state(spark, d).withColumn("m", F.min("snapshot_index").over(Window.partitionBy("run_id"))).filter("snapshot_index = m")
    return z.groupBy("run_id", "region_id").agg(F.sum("width_cm").alias("width"), F.sum(F.col("density") * F.col("width_cm")).alias("mass"))


@query("total_pressure", "run_id snapshot_index zone_id", "p_total", "SELECT *, coalesce(CASE WHEN zone_id % 2 = 0 THEN pressure END, CASE WHEN zone_id % 3 <> 0 OR zone_id % 5 <> 0 THEN coalesce(CASE WHEN zone_id % 3 <> 0 THEN temperature_i END, 0) + coalesce(CASE WHEN zone_id % 5 <> 0 THEN temperature_e END, 0) END) AS p_total FROM g")
def total_pressure(spark, d):
    z = zone_state(spark, d).withColumns({"p": F.expr("CASE WHEN zone_id % 2 = 0 THEN pressure END"), "pi": F.expr("CASE WHEN zone_id % 3 <> 0 THEN temperature_i END"), "pe": F.expr("CASE WHEN zone_id % 5 <> 0 THEN temperature_e END")})
    return z.select(*RS, "zone_id", R.total_pressure(z, "p", ["pi", "pe"]).alias("p_total"))


@query("robust_scale", "run_id snapshot_index", "scale", "SELECT run_id, snapshot_index, greatest(quantile_cont(abs(velocity), 8e-1), 1e0) AS scale FROM g GROUP BY 1, 2")
def robust_scale(spark, d):
    return zone_state(spark, d).groupBy(*RS).agg(R.robust_scale(F.col("velocity"), 1.0).alias("scale"))


@query("activation_threshold", "run_id", "threshold", "SELECT run_id, greatest(2.5e-2, 1.5e-1 * quantile_cont(velocity, 9.5e-1) FILTER (WHERE velocity > 0)) AS threshold FROM g GROUP BY 1")
def activation_threshold(spark, d):
    return zone_state(spark, d).groupBy("run_id").agg(R.activation_threshold(F.col("velocity")).alias("threshold"))


@query("state_clusters", "run_id snapshot_index cluster n", "weight mean_te mean_z", "k AS (SELECT *, round_even(log10(electron_density) / 2e-1, 0) AS a, round_even(log10(temperature_e) / 1e-1, 0) AS b, round_even(mean_charge / 1e0, 0) AS c FROM g), s AS (SELECT run_id, snapshot_index, a, b, c, count(*) AS n, sum(width_cm) AS weight, sum(temperature_e * width_cm) / sum(width_cm) AS mean_te, sum(mean_charge * width_cm) / sum(width_cm) AS mean_z FROM k GROUP BY ALL) ;; SELECT *, CAST(row_number() OVER (PARTITION BY run_id, snapshot_index ORDER BY weight DESC, a DESC, b DESC, c DESC) AS INT) AS cluster FROM s")
def state_clusters(spark, d):
    return R.cluster_states(zone_state(spark, d), "electron_density", "temperature_e", "mean_charge", "width_cm", (0.2, 0.1, 1.0)).select(*RS, "cluster", "n", "weight", "mean_te", "mean_z")


@query("error_metrics", "region_id n", "mae rmse max_error", "SELECT region_id, count(*) AS n, avg(abs(pressure - density)) AS mae, sqrt(avg((pressure - density) * (pressure - density))) AS rmse, max(abs(pressure - density)) AS max_error FROM g GROUP BY 1")
def error_metrics(spark, d):
    return R.error_metrics(zone_state(spark, d), ["region_id"], "pressure", "density")


@query("level_limits", "run_id", "low high", "SELECT run_id, quantile_cont(pressure, 2e-2) AS low, quantile_cont(pressure, 9.8e-1) AS high FROM g GROUP BY 1")
def level_limits(spark, d):
    out = zone_state(spark, d).groupBy("run_id").agg(F.percentile("pressure", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    return out.select("run_id", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"))


@query("field_consistency", "run_id ok_ek ok_p", "", "SELECT run_id, bool_and(abs(5e-1 * velocity * velocity - pow(velocity, 2) / 2e0) <= 1e-9) AS ok_ek, bool_and(abs(pressure - density) <= 1e0 + 5e-1 * abs(density)) AS ok_p FROM g GROUP BY 1")
def field_consistency(spark, d):
    v = F.col("velocity")
    return zone_state(spark, d).groupBy("run_id").agg(F.bool_and(R.close(S.kinetic_energy(v) * 1e7, F.pow(v, F.lit(2.0)) / 2.0, 0.0, 1e-9)).alias("ok_ek"), F.bool_and(R.close(F.col("pressure"), F.col("density"), 0.5, 1.0)).alias("ok_p"))


@query("cross_source_errors", "field all_close", "max_error", "u AS (SELECT 'density' AS field, density AS a, round(density, 2) AS b FROM g UNION ALL SELECT 'pressure', pressure, round(pressure, 1) FROM g UNION ALL SELECT 'velocity', velocity, velocity FROM g) ;; SELECT field, max(abs(a - b)) AS max_error, bool_and(abs(a - b) <= 1e-2) AS all_close FROM u GROUP BY 1")
def cross_source_errors(spark, d):
    z = zone_state(spark, d)
    other = z.select(*RS, "zone_id", F.round("density", 2).alias("density"), F.round("pressure", 1).alias("pressure"), "velocity")
    long = lambda df, v: df.unpivot([*RS, "zone_id"], ["density", "pressure", "velocity"], "field", v)
    both = long(z.select(*RS, "zone_id", "density", "pressure", "velocity"), "a").join(long(other, "b"), [*RS, "zone_id", "field"])
    return both.groupBy("field").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_error"), F.bool_and(R.close(F.col("a"), F.col("b"), 0.0, 1e-2)).alias("all_close"))


@query("pulse_duration", "run_id caution", "duration", "s AS (SELECT run_id, snapshot_index, time_s, sum(velocity) AS power FROM g GROUP BY 1, 2, 3) ;; SELECT run_id, coalesce(max(time_s) FILTER (WHERE power > 0) - min(time_s) FILTER (WHERE power > 0), max(time_s) - min(time_s)) AS duration, coalesce(max(time_s) FILTER (WHERE power > 0) - min(time_s) FILTER (WHERE power > 0), max(time_s) - min(time_s)) <= 1e0 AS caution FROM s GROUP BY 1")
def pulse_duration(spark, d):
    # velocities have six decimals: their exact sum is above 0 or not in whatever order they come
    s = zone_state(spark, d).groupBy(*RS, "time_s").agg(F.sum(F.col("velocity").cast("decimal(18,6)")).alias("power"))
    on = F.when(F.col("power") > 0, F.col("time_s"))
    out = s.groupBy("run_id").agg(F.coalesce(F.max(on) - F.min(on), F.max("time_s") - F.min("time_s")).alias("duration"))
    return out.withColumn("caution", F.col("duration") <= 1.0)


@query("policy_pivot", "region_id", "cold driven raw spread", "p AS (SELECT region_id, CASE zone_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'cold' ELSE 'driven' END AS policy, abs(pressure - density) AS e FROM g), a AS (SELECT region_id, avg(e) FILTER (WHERE policy = 'cold') AS cold, avg(e) FILTER (WHERE policy = 'driven') AS driven, avg(e) FILTER (WHERE policy = 'raw') AS raw FROM p GROUP BY 1) ;; SELECT *, greatest(cold, driven, raw) - least(cold, driven, raw) AS spread FROM a")
def policy_pivot(spark, d):
    z = zone_state(spark, d).withColumn("policy", F.when(F.col("zone_id") % 3 == 0, "raw").when(F.col("zone_id") % 3 == 1, "cold").otherwise("driven"))
    out = z.groupBy("region_id").pivot("policy", ["cold", "driven", "raw"]).agg(F.avg(F.abs(F.col("pressure") - F.col("density"))))
    return out.withColumn("spread", F.greatest("cold", "driven", "raw") - F.least("cold", "driven", "raw"))


@query("mismatch_drivers", "bucket driver n", "mean_total", "q AS (SELECT CASE WHEN temperature_e < 3e1 THEN 'cool' ELSE 'hot' END AS bucket, pressure - density AS a, temperature_i - temperature_e AS b, velocity AS c FROM g), w AS (SELECT *, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN 'pressure' WHEN abs(b) >= abs(c) THEN 'temperature' ELSE 'velocity' END AS driver FROM q) ;; SELECT bucket, driver, count(*) AS n, avg(a + b + c) AS mean_total FROM w GROUP BY 1, 2")
def mismatch_drivers(spark, d):
    a, b, c = F.col("pressure") - F.col("density"), F.col("temperature_i") - F.col("temperature_e"), F.col("velocity")
    driver = F.when((F.abs(a) >= F.abs(b)) & (F.abs(a) >= F.abs(c)), "pressure").when(F.abs(b) >= F.abs(c), "temperature").otherwise("velocity")
    z = zone_state(spark, d).select(F.when(F.col("temperature_e") < 30, "cool").otherwise("hot").alias("bucket"), driver.alias("driver"), (a + b + c).alias("t"))
    return z.groupBy("bucket", "driver").agg(F.count("*").alias("n"), F.avg("t").alias("mean_total"))


@query("charge_moments", "vec_id dominant", "mean_q", "e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS f FROM embeddings) ;; SELECT vec_id, list_sum(list_transform(f, lambda x, i: x * (i - 1))) / list_sum(f) AS mean_q, CAST(list_position(f, list_max(f)) - 1 AS INT) AS dominant FROM e", grid=False)
def charge_moments(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", (R.mean_charge(F.col("f")) / total).alias("mean_q"), R.dominant_charge(F.col("f")).alias("dominant"))


@query("padded_vectors", "vec_id n_missing width", "first last_kept", "e AS (SELECT vec_id, list_filter(embedding, lambda x: x > 0) AS v FROM embeddings), w AS (SELECT *, max(len(v)) OVER () AS width FROM e) ;; SELECT vec_id, CAST(width AS INT) AS width, CAST(width - len(v) AS INT) AS n_missing, CAST(v[1] AS DOUBLE) AS first, CAST(v[len(v)] AS DOUBLE) AS last_kept FROM w", grid=False)
def padded_vectors(spark, d):
    from ..sources.tables import padded

    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.filter("embedding", lambda x: x > 0).alias("v"))
    out = padded(e, "v")
    kept = F.filter("v", lambda x: x.isNotNull())
    return out.select("vec_id", "width", (F.size("v") - F.size(kept)).alias("n_missing"), F.try_element_at("v", F.lit(1)).cast("double").alias("first"), F.try_element_at(kept, F.lit(-1)).cast("double").alias("last_kept"))


@query("policy_means", "material", "baseline increment final_z ion_density", "m AS (SELECT abs(material_index) AS material, least(mean_charge, 3e0) AS baseline, greatest(mean_charge - 3e0, 0e0) AS increment, mean_charge AS final_z, density / 2.7e1 * 6.02214076e23 / 1e20 AS n FROM g) ;; SELECT material, avg(baseline) AS baseline, avg(increment) AS increment, avg(final_z) AS final_z, avg(n) AS ion_density FROM m GROUP BY 1")
def policy_means(spark, d):
    from ..operators.modules import electron_policy

    z = electron_policy(zone_state(spark, d), cold=3.0, mass=27.0)
    return z.groupBy(F.abs("material_index").alias("material")).agg(F.avg("baseline").alias("baseline"), F.avg("increment").alias("increment"), F.avg("z_effective").alias("final_z"), F.avg(F.col("ion_density") / 1e20).alias("ion_density"))


@query("averaged_states", "policy summaries", "rho te", "p AS (SELECT CASE WHEN zone_id % 2 = 0 THEN 'even' ELSE 'odd' END AS policy, region_id, density, temperature_e FROM g) ;; SELECT policy, avg(density) AS rho, avg(temperature_e) AS te, array_to_string(list_sort(list_distinct(list('region ' || region_id))), ', ') AS summaries FROM p GROUP BY 1")
def averaged_states(spark, d):
    z = zone_state(spark, d).withColumn("policy", F.when(F.col("zone_id") % 2 == 0, "even").otherwise("odd"))
    return z.groupBy("policy").agg(F.avg("density").alias("rho"), F.avg("temperature_e").alias("te"), F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("region "), F.col("region_id")))), ", ").alias("summaries"))


@query("span_summary", "run_id snapshot_index", "te ti valence wmin wmax", "SELECT run_id, snapshot_index, sum(temperature_e * width_cm) / sum(width_cm) AS te, sum(temperature_i * width_cm) / sum(width_cm) AS ti, sum(electron_density * width_cm) / sum(density / 2.7e1 * 6.02214076e23 * width_cm) AS valence, min(velocity) FILTER (WHERE velocity > 0) AS wmin, max(velocity) FILTER (WHERE velocity > 0) AS wmax FROM g WHERE zone_id BETWEEN 3 AND 12 AND abs(material_index) = 2 GROUP BY 1, 2")
def span_summary(spark, d):
    z = zone_state(spark, d).filter(F.col("zone_id").between(3, 12) & sel.material_mask(2))
    w, n = F.col("width_cm"), F.col("density") / 27.0 * 6.02214076e23
    v = F.when(F.col("velocity") > 0, F.col("velocity"))
    return z.groupBy(*RS).agg(R.weighted_mean(F.col("temperature_e"), w).alias("te"), R.weighted_mean(F.col("temperature_i"), w).alias("ti"), F.try_divide(F.sum(F.col("electron_density") * w), F.sum(n * w)).alias("valence"), F.min(v).alias("wmin"), F.max(v).alias("wmax"))


@query("model_reconciliation", "model branch rank n", "mae", "m(k, model, branch) AS (VALUES (0, 'rpa', 'A'), (1, 'mermin', 'A'), (2, 'stls', 'B'), (3, 'static', 'B')), e AS (SELECT model, branch, count(*) AS n, avg(abs(pressure - density)) AS mae FROM g JOIN m ON zone_id % 4 = k GROUP BY 1, 2) ;; SELECT *, CAST(row_number() OVER (ORDER BY mae, model) AS INT) AS rank FROM e")
def model_reconciliation(spark, d):
    m = spark.createDataFrame([(0, "rpa", "A"), (1, "mermin", "A"), (2, "stls", "B"), (3, "static", "B")], "k int, model string, branch string")
    e = R.error_metrics(zone_state(spark, d).withColumn("k", F.col("zone_id") % 4).join(F.broadcast(m), "k"), ["model", "branch"], "pressure", "density")
    return e.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("mae"), "model"))).select("model", "branch", "rank", "n", "mae")


@query("best_model", "region_id model", "mae", "e AS (SELECT region_id, zone_id % 4 AS model, avg(abs(pressure - density)) AS mae FROM g WHERE zone_id % 4 <> 3 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY mae, model) AS r FROM e) ;; SELECT * FROM k WHERE r = 1")
def best_model(spark, d):
    e = R.error_metrics(zone_state(spark, d).withColumn("model", F.col("zone_id") % 4).filter("model <> 3"), ["region_id", "model"], "pressure", "density")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("region_id").orderBy(F.asc_nulls_last("mae"), "model"))).filter("r = 1").select("region_id", "model", "mae")


@query("best_state_pair", "run_id snapshot_index floor_id", "score", "c AS (SELECT run_id, snapshot_index, f AS floor_id, abs(avg(density) - 2.5e1) AS score FROM g, (SELECT unnest([10, 20, 30]) AS f) WHERE density >= f GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(score, 9), snapshot_index, floor_id) AS r FROM c) ;; SELECT * FROM k WHERE r = 1")
def best_state_pair(spark, d):
    z = zone_state(spark, d).withColumn("floor_id", F.explode(F.array(F.lit(10), F.lit(20), F.lit(30)))).filter("density >= floor_id")
    c = z.groupBy(*RS, "floor_id").agg(F.abs(F.avg("density") - 25.0).alias("score"))
    pick = F.struct(F.round("score", 9), "snapshot_index", "floor_id")
    return c.groupBy("run_id").agg(F.min_by("snapshot_index", pick).alias("snapshot_index"), F.min_by("floor_id", pick).alias("floor_id"), F.min_by("score", pick).alias("score"))


@query("parent_child_delta", "region_id", "delta", "e AS (SELECT region_id, zone_id % 2 AS v, avg(pressure) AS p FROM g GROUP BY 1, 2) ;; SELECT a.region_id, b.p - a.p AS delta FROM e a JOIN e b ON a.region_id = b.region_id AND a.v = 0 AND b.v = 1")
def parent_child_delta(spark, d):
    e = zone_state(spark, d).groupBy("region_id", (F.col("zone_id") % 2).alias("v")).agg(F.avg("pressure").alias("p"))
    a, b = e.filter("v = 0").alias("a"), e.filter("v = 1").alias("b")
    return a.join(b, "region_id").select("region_id", (F.col("b.p") - F.col("a.p")).alias("delta"))


@query("merged_warnings", "source message n", "", "w AS (SELECT DISTINCT 'mask' AS source, 'few zones in run ' || run_id AS message, 1 AS o FROM (SELECT run_id, snapshot_index, count(*) AS n FROM g GROUP BY 1, 2) WHERE n < 10 UNION ALL SELECT DISTINCT 'shock', 'negative mean velocity in run ' || run_id, 2 FROM (SELECT run_id, avg(velocity) AS v FROM g GROUP BY 1) WHERE v < 1e0 UNION ALL SELECT DISTINCT 'mask', 'few zones in run ' || run_id, 3 FROM g WHERE zone_id = 1) ;; SELECT source, message, min(o) AS n FROM w GROUP BY 1, 2")
def merged_warnings(spark, d):
    from ..operators.modules import merge_warnings

    z = zone_state(spark, d)
    few = z.groupBy(*RS).count().filter("count < 10").select(F.lit("mask").alias("source"), F.concat(F.lit("few zones in run "), "run_id").alias("message"))
    slow = z.groupBy("run_id").agg(F.avg("velocity").alias("v")).filter("v < 1").select(F.lit("shock").alias("source"), F.concat(F.lit("negative mean velocity in run "), "run_id").alias("message"))
    again = z.filter("zone_id = 1").select(F.lit("mask").alias("source"), F.concat(F.lit("few zones in run "), "run_id").alias("message"))
    return merge_warnings([few, slow, again]).select("source", "message", F.col("place").alias("n"))


@query("cleared_snapshots", "run_id snapshot_index", "", "SELECT DISTINCT run_id, snapshot_index FROM g WHERE snapshot_index NOT BETWEEN 16 AND 30")
def cleared_snapshots(spark, d):
    s = zone_state(spark, d).select(*RS).distinct()
    return s.join(s.filter("snapshot_index between 16 and 30"), RS, "left_anti")


@query("material_id_union", "id", "", "SELECT DISTINCT abs(material_index) AS id FROM g UNION SELECT region_id + 2 FROM g")
def material_id_union(spark, d):
    z = zone_state(spark, d)
    return z.select(F.abs("material_index").alias("id")).union(z.select((F.col("region_id") + 2).alias("id"))).distinct()


@query("region_range_join", "run_id snapshot_index zone_id", "initial_density", "r4(region_id, lo, hi, v) AS (VALUES (1, 1, 4, 1e0), (2, 5, 8, 2e0), (3, 7, 12, 3e0), (4, 14, 16, 4e0)), p AS (SELECT z AS zone_id, max_by(v, region_id) AS initial_density FROM (SELECT unnest(range(1, 17)) AS z) JOIN r4 ON z BETWEEN lo AND hi GROUP BY 1) ;; SELECT g.*, initial_density FROM g LEFT JOIN p USING (zone_id)")
def region_range_join(spark, d):
    from ..operators.geometry import property_from_regions

    r = regions(spark).withColumns({"min_zone": F.expr("CASE region_id WHEN 3 THEN 7 WHEN 4 THEN 14 ELSE min_zone END"), "initial_density": F.col("region_id").cast("double")})
    return property_from_regions(zone_state(spark, d), r, "initial_density").select(*RS, "zone_id", "initial_density")
