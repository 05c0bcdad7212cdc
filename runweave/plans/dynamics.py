"""Queries of the window, tracking, event, preheat and module operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chain as C
from ..operators import events as E
from ..operators import geometry as G
from ..operators import modules as M
from ..operators import preheat as P
from ..operators import reduce as R
from ..operators import waves as V
from ..operators import windows as W
from ..session import written
from .geometry import edges
from .grid import query, regions, zone_state

RS = ["run_id", "snapshot_index"]
WS = "(PARTITION BY run_id, snapshot_index ORDER BY zone_id)"
WT = "(PARTITION BY run_id, zone_id ORDER BY snapshot_index)"
S121 = f"s1 AS (SELECT *, coalesce(25e-2 * lag(density) OVER w + 5e-1 * density + 25e-2 * lead(density) OVER w, density) AS r1 FROM g WINDOW w AS {WS}), s2 AS (SELECT *, coalesce(25e-2 * lag(r1) OVER w + 5e-1 * r1 + 25e-2 * lead(r1) OVER w, r1) AS r2 FROM s1 WINDOW w AS {WS})"
SERIES = "s AS (SELECT run_id, snapshot_index, any_value(time_s) AS time_s, avg(density) AS rho, avg(velocity) AS u, avg(pressure) AS p, max(temperature_e) AS te FROM g GROUP BY 1, 2)"


def series(spark, d):
    return zone_state(spark, d).groupBy(*RS).agg(F.first("time_s").alias("time_s"), F.avg("density").alias("rho"), F.avg("velocity").alias("u"), F.avg("pressure").alias("p"), F.max("temperature_e").alias("te"))


@query("smooth_121", "run_id snapshot_index zone_id", "density", S121 + " ;; SELECT run_id, snapshot_index, zone_id, r2 AS density FROM s2")
def smooth_121(spark, d):
    return W.smooth121(zone_state(spark, d), ["density"], 2).select(*RS, "zone_id", "density")


@query("log_diffs", "run_id snapshot_index zone_id jump", "d_rho d_p d_te", f"SELECT *, ln(lead(density) OVER w) - ln(density) AS d_rho, ln(lead(pressure) OVER w) - ln(pressure) AS d_p, ln(lead(temperature_e) OVER w) - ln(temperature_e) AS d_te, lead(region_id) OVER w <> region_id AS jump FROM g WINDOW w AS {WS}")
def log_diffs(spark, d):
    return zone_state(spark, d).select(*RS, "zone_id", (F.lead("region_id").over(W.space()) != F.col("region_id")).alias("jump"), W.log_step("density").alias("d_rho"), W.log_step("pressure").alias("d_p"), W.log_step("temperature_e").alias("d_te"))


@query("local_maxima", "run_id snapshot_index zone_id", "density", f"m AS (SELECT *, coalesce(lag(density) OVER w, -1e0) AS l, coalesce(lead(density) OVER w, -1e0) AS r FROM g WINDOW w AS {WS}) ;; SELECT * FROM m WHERE density >= l AND density >= r AND density >= 3e1")
def local_maxima(spark, d):
    return W.local_maxima(zone_state(spark, d), "density", 30.0).select(*RS, "zone_id", "density")


@query("cumulative_depth", "run_id snapshot_index zone_id", "areal tau transmission", "c AS (SELECT *, sum(density * width_cm) OVER (PARTITION BY run_id, snapshot_index ORDER BY zone_id DESC) AS areal FROM g) ;; SELECT *, areal * 1e-3 AS tau, exp(-areal * 1e-3) AS transmission FROM c")
def cumulative_depth(spark, d):
    over = Window.partitionBy(*RS).orderBy(F.desc("zone_id")).rowsBetween(Window.unboundedPreceding, 0)
    c = zone_state(spark, d).withColumn("areal", F.sum(F.col("density") * F.col("width_cm")).over(over))
    return c.select(*RS, "zone_id", "areal", (F.col("areal") * 1e-3).alias("tau"), F.exp(-F.col("areal") * 1e-3).alias("transmission"))


@query("cumtrapz", "run_id snapshot_index zone_id", "cumulative", f"t AS (SELECT *, coalesce(5e-1 * (pressure + lag(pressure) OVER w) * greatest(time_s - lag(time_s) OVER w, 0), 0) AS a FROM g WINDOW w AS {WT}) ;; SELECT *, sum(a) OVER {WT} AS cumulative FROM t")
def cumtrapz(spark, d):
    return W.cumulative_integral(zone_state(spark, d), "pressure", "time_s", "cumulative", ["run_id", "zone_id"]).select(*RS, "zone_id", "cumulative")


@query("trapz", "run_id zone_id", "integral", f"t AS (SELECT *, 5e-1 * (velocity + lag(velocity) OVER w) * (time_s - lag(time_s) OVER w) AS a FROM g WINDOW w AS {WT}) ;; SELECT run_id, zone_id, CASE WHEN count(*) >= 2 THEN sum(a) END AS integral FROM t GROUP BY 1, 2")
def trapz(spark, d):
    return W.integral(zone_state(spark, d), "velocity", "time_s", ["run_id", "zone_id"])


@query("pressure_impulse", "run_id zone_id", "integral", f"b AS (SELECT *, greatest(pressure - first_value(pressure) OVER {WT}, 0) AS y FROM g), t AS (SELECT *, 5e-1 * (y + lag(y) OVER w) * (time_s - lag(time_s) OVER w) AS a FROM b WINDOW w AS {WT}) ;; SELECT run_id, zone_id, CASE WHEN count(*) >= 2 THEN sum(a) END AS integral FROM t GROUP BY 1, 2")
def pressure_impulse(spark, d):
    z = zone_state(spark, d).withColumn("y", F.greatest(W.since_first("pressure"), F.lit(0.0)))
    return W.integral(z, "y", "time_s", ["run_id", "zone_id"])


@query("source_budget", "run_id snapshot_index", "areal_energy source", "e AS (SELECT run_id, snapshot_index, any_value(time_s) AS time_s, sum(density * width_cm * temperature_e) AS areal_energy, sum(density * width_cm * mean_charge) AS rate FROM g GROUP BY 1, 2), t AS (SELECT *, coalesce(5e-1 * (rate + lag(rate) OVER w) * (time_s - lag(time_s) OVER w), 0) AS a FROM e WINDOW w AS (PARTITION BY run_id ORDER BY snapshot_index)) ;; SELECT *, sum(a) OVER (PARTITION BY run_id ORDER BY snapshot_index) AS source FROM t")
def source_budget(spark, d):
    m = F.col("density") * F.col("width_cm")
    e = zone_state(spark, d).groupBy(*RS).agg(F.first("time_s").alias("time_s"), F.sum(m * F.col("temperature_e")).alias("areal_energy"), F.sum(m * F.col("mean_charge")).alias("rate"))
    return W.cumulative_integral(e, "rate", "time_s", "source", ["run_id"]).select(*RS, "areal_energy", "source")


CROSS = "c AS (SELECT *, lag(density) OVER w AS x0, lag(time_s) OVER w AS t0 FROM g WINDOW w AS (PARTITION BY run_id, zone_id ORDER BY snapshot_index))"


@query("threshold_crossing", "run_id zone_id crossing_snapshot", "crossing_time", CROSS + " ;; SELECT run_id, zone_id, min(snapshot_index) AS crossing_snapshot, min_by(t0 + (3e1 - x0) / (density - x0) * (time_s - t0), snapshot_index) AS crossing_time FROM c WHERE x0 < 3e1 AND 3e1 <= density GROUP BY 1, 2")
def threshold_crossing(spark, d):
    return W.first_crossing(zone_state(spark, d), "density", "time_s", F.lit(30.0), ["run_id", "zone_id"])


@query("falling_crossing", "run_id zone_id crossing_snapshot", "crossing_time", CROSS + " ;; SELECT run_id, zone_id, min(snapshot_index) AS crossing_snapshot, min_by(t0 + (2e1 - x0) / (density - x0) * (time_s - t0), snapshot_index) AS crossing_time FROM c WHERE x0 > 2e1 AND 2e1 >= density GROUP BY 1, 2")
def falling_crossing(spark, d):
    return W.first_crossing(zone_state(spark, d), "density", "time_s", F.lit(20.0), ["run_id", "zone_id"], rising=False)


@query("track_smooth", "run_id snapshot_index", "smoothed", SERIES + ", k AS (SELECT *, first_value(rho) OVER a AS f, last_value(rho) OVER a AS l, count(*) OVER (PARTITION BY run_id) AS n FROM s WINDOW a AS (PARTITION BY run_id ORDER BY snapshot_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), m AS (SELECT *, CASE WHEN lag(rho) OVER w IS NULL OR lead(rho) OVER w IS NULL THEN rho ELSE (coalesce(lag(rho, 2) OVER w, f) + 2e0 * coalesce(lag(rho) OVER w, f) + 3e0 * rho + 2e0 * coalesce(lead(rho) OVER w, l) + coalesce(lead(rho, 2) OVER w, l)) / 9e0 END AS x FROM k WINDOW w AS (PARTITION BY run_id ORDER BY snapshot_index)) ;; SELECT *, CASE WHEN n < 3 THEN rho ELSE max(x) OVER (PARTITION BY run_id ORDER BY snapshot_index) END AS smoothed FROM m")
def track_smooth(spark, d):
    return W.smooth_track(series(spark, d), "rho", ["run_id"]).select(*RS, "smoothed")


@query("gradient", "run_id snapshot_index", "velocity", SERIES + ", h AS (SELECT *, time_s - lag(time_s) OVER w AS hs, lead(time_s) OVER w - time_s AS hd, lag(rho) OVER w AS fs, lead(rho) OVER w AS fd FROM s WINDOW w AS (PARTITION BY run_id ORDER BY snapshot_index)) ;; SELECT *, CASE WHEN hs IS NULL THEN (fd - rho) / hd WHEN hd IS NULL THEN (rho - fs) / hs ELSE (hs * hs * fd + (hd * hd - hs * hs) * rho - hd * hd * fs) / (hs * hd * (hd + hs)) END AS velocity FROM h")
def gradient(spark, d):
    return series(spark, d).select(*RS, W.gradient("rho", "time_s", Window.partitionBy("run_id").orderBy("snapshot_index")).alias("velocity"))


EPS = f"ep AS (SELECT run_id, greatest(1e-9, 1e-2 * coalesce(quantile_cont(fp, 5e-1) FILTER (WHERE fp > 0), 0)) AS eps FROM (SELECT run_id, zone_id, min_by(pressure, snapshot_index) AS fp FROM g GROUP BY 1, 2) GROUP BY 1)"


@query("delta_first", "run_id snapshot_index zone_id", "d_te d_z ratio rel_p", EPS + f" ;; SELECT *, temperature_e - first_value(temperature_e) OVER w AS d_te, mean_charge - first_value(mean_charge) OVER w AS d_z, density / first_value(density) OVER w AS ratio, (pressure - first_value(pressure) OVER w) / (first_value(pressure) OVER w + eps) AS rel_p FROM g JOIN ep USING (run_id) WINDOW w AS {WT}")
def delta_first(spark, d):
    return P.changes(zone_state(spark, d)).select(*RS, "zone_id", F.col("delta_te").alias("d_te"), F.col("delta_charge").alias("d_z"), "ratio", F.col("relative_pressure").alias("rel_p"))


@query("first_onset", "run_id zone_id onset_snapshot", "onset_time onset_value", "SELECT run_id, zone_id, min(snapshot_index) AS onset_snapshot, min_by(time_s, snapshot_index) AS onset_time, min_by(temperature_e, snapshot_index) AS onset_value FROM g WHERE temperature_e >= 4e1 GROUP BY 1, 2")
def first_onset(spark, d):
    return W.onset(zone_state(spark, d), "temperature_e", 40.0, ["run_id", "zone_id"])


@query("event_windows", "run_id snapshot_index zone_id", "near_max", "SELECT a.run_id, a.snapshot_index, a.zone_id, max(b.pressure) AS near_max FROM g a JOIN g b ON a.run_id = b.run_id AND a.zone_id = b.zone_id AND b.snapshot_index BETWEEN a.snapshot_index - 2 AND a.snapshot_index + 2 WHERE a.density >= 4e1 GROUP BY 1, 2, 3")
def event_windows(spark, d):
    z = zone_state(spark, d)
    e = z.filter("density >= 40").select(*RS, F.col("zone_id").alias("at"))
    rows = E.local_window(e, z.select(*RS, "zone_id", "pressure"), F.col("at"))
    return rows.groupBy("run_id", F.col("event_snapshot").alias("snapshot_index"), "zone_id").agg(F.max("pressure").alias("near_max"))


@query("compression_ratio", "run_id zone_id", "up down", "SELECT run_id, zone_id, max(density) / min_by(density, snapshot_index) AS up, min(density) / min_by(density, snapshot_index) AS down FROM g GROUP BY 1, 2")
def compression_ratio(spark, d):
    return E.compression(zone_state(spark, d), ["run_id", "zone_id"])


def energies(z):
    """The grid's cells with specific energies (J/g) and rates (J/g/s), each read off other columns."""
    u = F.col("velocity")
    return z.withColumns({"ion_energy": F.col("temperature_i") * 1e3, "electron_energy": F.col("temperature_e") * F.col("mean_charge") * 1e2, "radiation_energy": F.col("pressure") * 10.0, "kinetic_energy": S.kinetic_energy(u), "laser_deposition": F.greatest(u, F.lit(0.0)) * 1e3, "laser_source": F.abs(u) * 1e3, "radiation_net_heating": (F.col("pressure") - 40.0) * 1e2})


ENERGY = "ge AS (SELECT *, temperature_i * 1e3 AS ion_energy, temperature_e * mean_charge * 1e2 AS electron_energy, pressure * 1e1 AS radiation_energy, 5e-1 * velocity * velocity * 1e-7 AS kinetic_energy, greatest(velocity, 0) * 1e3 AS laser_deposition, abs(velocity) * 1e3 AS laser_source, (pressure - 4e1) * 1e2 AS radiation_net_heating FROM g)"


@query("energy_channels", "run_id zone_id samples channel", "impulse internal kinetic pressure_work flux share_internal share_work", ENERGY + f", b AS (SELECT *, velocity * density * (ion_energy + electron_energy + radiation_energy) AS fi, velocity * density * kinetic_energy AS fk, velocity * pressure AS fp FROM ge), c AS (SELECT *, greatest(pressure - first_value(pressure) OVER w, 0) AS p, greatest(first_value(fi) OVER w - fi, 0) AS i, greatest(first_value(fk) OVER w - fk, 0) AS k, greatest(first_value(fp) OVER w - fp, 0) AS q, greatest(first_value(fi + fk + fp) OVER w - (fi + fk + fp), 0) AS e FROM b WINDOW w AS {WT}), t AS (SELECT *, 5e-1 * (time_s - lag(time_s) OVER w) AS h, lag(p) OVER w AS p0, lag(i) OVER w AS i0, lag(k) OVER w AS k0, lag(q) OVER w AS q0, lag(e) OVER w AS e0 FROM c WINDOW w AS {WT}), s AS (SELECT run_id, zone_id, count(*) AS samples, count(*) >= 2 AS two, sum((p + p0) * h) AS impulse, sum((i + i0) * h) AS internal, sum((k + k0) * h) AS kinetic, sum((q + q0) * h) AS pressure_work, sum((e + e0) * h) AS flux FROM t GROUP BY 1, 2) ;; SELECT *, CASE WHEN internal + kinetic + pressure_work > 0 THEN internal / (internal + kinetic + pressure_work) END AS share_internal, CASE WHEN internal + kinetic + pressure_work > 0 THEN pressure_work / (internal + kinetic + pressure_work) END AS share_work, CASE WHEN internal IS NULL OR greatest(internal, kinetic, pressure_work) <= 0 THEN NULL WHEN internal >= greatest(kinetic, pressure_work) THEN 'mostly internal' WHEN kinetic >= pressure_work THEN 'mostly kinetic' ELSE 'mostly pressure-work' END AS channel FROM s")
def energy_channels(spark, d):
    """Energy that flows towards lower zones past each zone, by channel."""
    m = E.local_metrics(energies(zone_state(spark, d)), ["run_id", "zone_id"], -1.0)
    return m.select("run_id", "zone_id", "samples", "channel", "impulse", *E.CHANNELS, "flux", "share_internal", "share_work")


@query("impedance_preview", "run_id snapshot_index zone_id", "z1 z2 r t", f"i AS (SELECT *, density * sqrt((1e0 + pressure / (density * temperature_e)) * pressure / density * 1e7) AS z1 FROM g), j AS (SELECT *, lead(z1) OVER {WS} AS z2 FROM i) ;; SELECT run_id, snapshot_index, zone_id, z1 / 1e4 AS z1, z2 / 1e4 AS z2, pow((z2 - z1) / (z2 + z1), 2) AS r, 4e0 * z1 * z2 / pow(z2 + z1, 2) AS t FROM j WHERE z2 IS NOT NULL")
def impedance_preview(spark, d):
    z = zone_state(spark, d).withColumn("z1", E.impedance(F.col("pressure"), F.col("density"), F.col("temperature_e")))
    z = z.withColumn("z2", F.lead("z1").over(W.space())).filter("z2 is not null")
    z1, z2 = F.col("z1"), F.col("z2")
    return z.select(*RS, "zone_id", (z1 / 1e4).alias("z1"), (z2 / 1e4).alias("z2"), E.reflection(z1, z2).alias("r"), E.transmission(z1, z2).alias("t"))


@query("monotone_violations", "run_id n", "", "o AS (SELECT l_orderkey AS run_id, l_shipdate AS t, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS before FROM lineitem) ;; SELECT run_id, count(*) AS n FROM o WHERE before > t GROUP BY 1", grid=False)
def monotone_violations(spark, d):
    """Lines of an order that were shipped before the line above them."""
    e = spark.read.parquet(f"{d}/lineitem.parquet")
    late = F.lag("l_shipdate").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")) > F.col("l_shipdate")
    return e.withColumn("late", late).filter("late").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("n"))


SCORE = f"q AS (SELECT *, density / 2e1 AS ratio FROM g), a1 AS (SELECT *, coalesce(25e-2 * lag(ratio) OVER w + 5e-1 * ratio + 25e-2 * lead(ratio) OVER w, ratio) AS b1 FROM q WINDOW w AS {WS}), a2 AS (SELECT *, coalesce(25e-2 * lag(b1) OVER w + 5e-1 * b1 + 25e-2 * lead(b1) OVER w, b1) AS r FROM a1 WINDOW w AS {WS}), n AS (SELECT *, lead(r) OVER w AS r1, 5e-1 * (velocity + lead(velocity) OVER w) AS v, density >= 1e1 AND lead(density) OVER w >= 1e1 AS live FROM a2 WINDOW w AS {WS}), sc AS (SELECT run_id, snapshot_index, time_s, zone_id - 1 AS interface_id, CASE WHEN live THEN greatest(r1 - r, 0) * least(greatest((r1 - 1) / 8e-2, 0), 1) * CASE WHEN abs(v) >= 5e-1 THEN 1e0 ELSE 35e-2 END * CASE WHEN -v >= 0 THEN 1e0 ELSE 35e-2 END ELSE 0 END AS score FROM n WHERE r1 IS NOT NULL)"


def scores(spark, d):
    z = zone_state(spark, d).withColumn("ratio", F.col("density") / 20.0)
    return V.detector_score(z, F.col("density") >= 10, speed=0.5)


@query("front_scores", "run_id snapshot_index interface_id", "score", SCORE + " ;; SELECT * FROM sc")
def front_scores(spark, d):
    return scores(spark, d).select(*RS, "interface_id", "score")


ACT = SCORE + ", th AS (SELECT run_id, greatest(2.5e-2, 1.5e-1 * coalesce(quantile_cont(score, 9.5e-1) FILTER (WHERE score > 0), 0)) AS threshold FROM sc GROUP BY 1), be AS (SELECT run_id, snapshot_index, max(score) AS top, max_by(interface_id, {'a': round(score, 9), 'b': -interface_id}) AS interface_id FROM sc GROUP BY 1, 2)"


def thresholds(s):
    return s.groupBy("run_id").agg(R.activation_threshold(F.col("score")).alias("threshold"))


@query("first_activation", "run_id snapshot_index interface_id", "", ACT + " ;; SELECT run_id, min(snapshot_index) AS snapshot_index, min_by(interface_id, snapshot_index) AS interface_id FROM be JOIN th USING (run_id) WHERE top >= threshold GROUP BY 1")
def first_activation(spark, d):
    s = scores(spark, d).withColumn("score", F.round("score", 9))
    return V.first_activation(s, thresholds(s))


@query("front_track")
def front_track(spark, d):
    """Front of each run in interfaces and centimetres, with its speed in cm/s."""
    smooth = W.smooth_track(V.front_track(scores(spark, d)), "track_index", ["run_id"], falling=True)
    bounds = edges(spark, d).select(*RS, (F.col("zone_id") - 1).alias("interface_id"), F.col("outer_cm").alias("position_cm"))
    return V.track_velocity(V.placed_track(smooth, bounds, "smoothed"), "position_cm").select(*RS, "track_index", "smoothed", "track_score", "position_cm", "track_velocity")


def evidence(spark, d, cells=False):
    return V.wave_evidence(zone_state(spark, d), u_floor=0.5, cells=cells)


EVID = f"""p1 AS (SELECT *, coalesce(25e-2 * lag(density) OVER w + 5e-1 * density + 25e-2 * lead(density) OVER w, density) AS rho, coalesce(25e-2 * lag(velocity) OVER w + 5e-1 * velocity + 25e-2 * lead(velocity) OVER w, velocity) AS u, coalesce(25e-2 * lag(temperature_e) OVER w + 5e-1 * temperature_e + 25e-2 * lead(temperature_e) OVER w, temperature_e) AS te, coalesce(25e-2 * lag(temperature_i) OVER w + 5e-1 * temperature_i + 25e-2 * lead(temperature_i) OVER w, temperature_i) AS ti FROM g WINDOW w AS {WS}),
p2 AS (SELECT *, ln(lead(rho) OVER w) - ln(rho) AS dr, ln(lead(pressure) OVER w) - ln(pressure) AS dp, ln(lead(te) OVER w) - ln(te) AS de, ln(lead(ti) OVER w) - ln(ti) AS di, (lead(u) OVER w - u) / (5e-1 * (width_cm + lead(width_cm) OVER w)) AS du, u + lead(u) OVER w AS um, CASE WHEN lead(region_id) OVER w <> region_id THEN 1e0 ELSE 0e0 END AS jump FROM p1 WINDOW w AS {WS}),
p3 AS (SELECT * FROM p2 WHERE dr IS NOT NULL),
sc AS (SELECT run_id, snapshot_index, greatest(quantile_cont(abs(dr), 8e-1), 5e-2) AS sr, greatest(quantile_cont(abs(dp), 8e-1), 5e-2) AS sp, greatest(quantile_cont(abs(de), 8e-1), 5e-2) AS se, greatest(quantile_cont(abs(di), 8e-1), 5e-2) AS si, greatest(quantile_cont(abs(du), 8e-1), 5e-1) AS su FROM p3 GROUP BY 1, 2),
p4 AS (SELECT *, least(greatest(dr, 0) / sr, 2.5e0) AS ra, least(greatest(-dr, 0) / sr, 2.5e0) AS rb, least(greatest(dp, 0) / sp, 2.5e0) AS pa, least(greatest(-dp, 0) / sp, 2.5e0) AS pb, least(greatest(du, 0) / su, 2.5e0) AS ua, least(greatest(-du, 0) / su, 2.5e0) AS ub, least(greatest(de, 0) / se, 2.5e0) AS ea, least(greatest(-de, 0) / se, 2.5e0) AS eb, least(greatest(di, 0) / si, 2.5e0) AS ia, least(greatest(-di, 0) / si, 2.5e0) AS ib FROM p3 JOIN sc USING (run_id, snapshot_index)),
p5 AS (SELECT *, greatest(33e-2 * ra + 25e-2 * pa + 2e-1 * ub + 1e-1 * ea, 33e-2 * rb + 25e-2 * pb + 2e-1 * ub + 1e-1 * eb) AS sh, greatest(38e-2 * rb + 28e-2 * pb + 24e-2 * ua + 1e-1 * ib, 38e-2 * ra + 28e-2 * pa + 24e-2 * ua + 1e-1 * ia) AS re FROM p4)"""


@query("wave_evidence", "run_id snapshot_index interface_id", "shock_like release_like contact_like", EVID + " ;; SELECT run_id, snapshot_index, zone_id - 1 AS interface_id, greatest(sh - 18e-2 * least(greatest(abs(dr) - abs(dp), 0) / sr, 2.5e0), 0) AS shock_like, greatest(re - 35e-2 * sh, 0) AS release_like, greatest(65e-2 * jump + 28e-2 * (ra + rb) - 18e-2 * (pa + pb) - 12e-2 * (ua + ub), 0) AS contact_like FROM p5")
def wave_evidence(spark, d):
    return evidence(spark, d).select(*RS, "interface_id", "shock_like", "release_like", "contact_like")


@query("evidence_families", "run_id family n", "total", EVID + ", f AS (SELECT run_id, greatest(sh - 18e-2 * least(greatest(abs(dr) - abs(dp), 0) / sr, 2.5e0), 0) AS a, greatest(re - 35e-2 * sh, 0) AS b, greatest(65e-2 * jump + 28e-2 * (ra + rb) - 18e-2 * (pa + pb) - 12e-2 * (ua + ub), 0) AS c FROM p5), u AS (SELECT run_id, 'shock_like' AS family, a AS x FROM f UNION ALL SELECT run_id, 'release_like', b FROM f UNION ALL SELECT run_id, 'contact_like', c FROM f) ;; SELECT run_id, family, count(*) AS n, sum(x) AS total FROM u GROUP BY 1, 2")
def evidence_families(spark, d):
    return V.families(evidence(spark, d)).groupBy("run_id", "family").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


def candidates(spark, d, cells=False):
    e = evidence(spark, d, cells)
    return V.frame_candidates(e.withColumns({c: F.round(c, 9) for c in ("shock_like", "release_like", "contact_like")}))


@query("topk_per_frame", "run_id snapshot_index zone_id family_rank", "density", f"m AS (SELECT *, coalesce(lag(density) OVER w, -1e0) AS l, coalesce(lead(density) OVER w, -1e0) AS r, max(density) OVER (PARTITION BY run_id, snapshot_index) AS top FROM g WINDOW w AS {WS}), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, snapshot_index ORDER BY density DESC, zone_id) AS INT) AS family_rank FROM m WHERE density >= l AND density >= r) ;; SELECT * FROM k WHERE family_rank <= 2 AND density >= 55e-2 * top")
def topk_per_frame(spark, d):
    return V.top_per_frame(zone_state(spark, d), "density", "zone_id", RS).select(*RS, "zone_id", "family_rank", "density")


#: The three families as rows with their directions, each run's thresholds, and the best tops of each frame.
CANDIDATES = EVID + """, fa AS (SELECT run_id, snapshot_index, zone_id - 1 AS interface_id,
    greatest(sh - 18e-2 * least(greatest(abs(dr) - abs(dp), 0) / sr, 2.5e0), 0) AS shock, greatest(re - 35e-2 * sh, 0) AS release, greatest(65e-2 * jump + 28e-2 * (ra + rb) - 18e-2 * (pa + pb) - 12e-2 * (ua + ub), 0) AS contact,
    CASE WHEN 33e-2 * rb + 25e-2 * pb + 2e-1 * ub + 1e-1 * eb >= 33e-2 * ra + 25e-2 * pa + 2e-1 * ub + 1e-1 * ea THEN 1e0 ELSE -1e0 END AS ds,
    CASE WHEN 38e-2 * ra + 28e-2 * pa + 24e-2 * ua + 1e-1 * ia >= 38e-2 * rb + 28e-2 * pb + 24e-2 * ua + 1e-1 * ib THEN 1e0 ELSE -1e0 END AS dl, sign(um) * 1e0 AS dc FROM p5),
fr AS (SELECT run_id, snapshot_index, interface_id, 'shock_like' AS family, round(shock, 9) AS score, ds AS direction_sign FROM fa UNION ALL SELECT run_id, snapshot_index, interface_id, 'release_like', round(release, 9), dl FROM fa UNION ALL SELECT run_id, snapshot_index, interface_id, 'contact_like', round(contact, 9), dc FROM fa),
ft AS (SELECT run_id, family, greatest(CASE family WHEN 'contact_like' THEN 135e-3 ELSE 18e-2 END, coalesce(CASE family WHEN 'contact_like' THEN quantile_cont(score, 88e-2) FILTER (WHERE score > 0) ELSE quantile_cont(score, 92e-2) FILTER (WHERE score > 0) END, 0)) AS threshold FROM fr GROUP BY 1, 2),
fn AS (SELECT *, coalesce(lag(score) OVER w, -1e0) AS l, coalesce(lead(score) OVER w, -1e0) AS r, max(score) OVER (PARTITION BY run_id, snapshot_index, family) AS peak FROM fr JOIN ft USING (run_id, family) WINDOW w AS (PARTITION BY run_id, snapshot_index, family ORDER BY interface_id)),
fk AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, snapshot_index, family ORDER BY score DESC, interface_id) AS INT) AS family_rank FROM fn WHERE score >= threshold AND score >= l AND score >= r)"""


@query("frame_candidates", "run_id snapshot_index family interface_id family_rank", "score direction_sign", CANDIDATES + " ;; SELECT * FROM fk WHERE family_rank <= 2 AND score >= 55e-2 * peak")
def frame_candidates(spark, d):
    return candidates(spark, d).select(*RS, "family", "interface_id", "score", "direction_sign", "family_rank")


def profile(spark, d):
    return edges(spark, d).withColumns({"edge": F.col("outer_cm"), "x": F.col("outer_cm") - F.col("width_cm") / 2.0})


def wave_branches_of(spark, d):
    return V.wave_branches(V.placed_candidates(candidates(spark, d, cells=True), profile(spark, d)))


@query("wave_branches")
def wave_branches(spark, d):
    return wave_branches_of(spark, d)


SAMPLES = "b AS (SELECT run_id, zone_id AS branch_id, snapshot_index, time_s, density / 5e1 AS score, zone_id + velocity / 4e0 AS interface_id, zone_id * 2e0 + velocity / 3e0 AS position, width_cm * (1e0 + temperature_i / 1e2) AS width FROM g WHERE density >= 2.5e1)"


def samples(spark, d):
    """Branches read off the grid: a zone's dense snapshots."""
    z = zone_state(spark, d).filter("density >= 25")
    return z.select("run_id", F.col("zone_id").alias("branch_id"), "snapshot_index", "time_s", (F.col("density") / 50.0).alias("score"), (F.col("zone_id") + F.col("velocity") / 4.0).alias("interface_id"), (F.col("zone_id") * 2.0 + F.col("velocity") / 3.0).alias("position"), (F.col("width_cm") * (1.0 + F.col("temperature_i") / 100.0)).alias("width"), F.when(F.col("region_id") == 4, "merged_unresolved").when(F.col("region_id") == 3, "contact_like").otherwise("shock_like").alias("family"))


STEPS = "st AS (SELECT run_id, greatest(quantile_cont(gap, 5e-1), 1e-12) AS step FROM (SELECT run_id, time_s - lag(time_s) OVER (PARTITION BY run_id ORDER BY snapshot_index) AS gap FROM (SELECT DISTINCT run_id, snapshot_index, time_s FROM g)) GROUP BY 1)"


SUMMARY = SAMPLES + ", " + STEPS + ", c AS (SELECT run_id, branch_id, count(*) AS samples, max(time_s) - min(time_s) AS duration, count(*) * 1e0 / (max(snapshot_index) - min(snapshot_index) + 1) AS cont, sum(score) AS integrated, max(score) AS peak, (max(position) - min(position)) / greatest(coalesce(quantile_cont(width, 5e-1) FILTER (WHERE width > 0), 1e-8), 1e-8) AS span_cells, CAST(floor((branch_id - 1) / 4) AS INT) + 1 AS region FROM b GROUP BY 1, 2), v AS (SELECT *, CASE WHEN samples <= 2 THEN 'provisional' WHEN samples < 5 THEN 'short_weak' ELSE 'tracked' END AS support, CASE WHEN region = 4 THEN 4 WHEN region = 3 THEN 3 ELSE 0 END AS fam, integrated * (1 + 45e-2 * ln(1 + samples)) * CASE WHEN samples >= 2 THEN (1 + 25e-2 * ln(1 + duration / coalesce(step, 1e-12))) * (55e-2 + 45e-2 * least(cont, 1)) ELSE 1 END * (1 + 6e-2 * least(span_cells, 10)) * CASE WHEN samples <= 2 THEN 2e-1 WHEN samples < 5 THEN 65e-2 ELSE 1 END * CASE WHEN region = 4 THEN 9e-1 ELSE 1 END AS significance FROM c LEFT JOIN st USING (run_id))"


@query("branch_summary", "run_id branch_id samples support", "duration continuity integrated significance", SUMMARY + " ;; SELECT *, CASE WHEN samples >= 2 THEN cont END AS continuity FROM v")
def branch_summary(spark, d):
    return V.branch_summary(samples(spark, d), V.time_steps(zone_state(spark, d))).select("run_id", "branch_id", "samples", "support", "duration", "continuity", "integrated", "significance")


@query("branch_rank", "run_id branch_id rank suppressed primary_branch", "", SUMMARY + ", k AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CASE support WHEN 'tracked' THEN 0 WHEN 'short_weak' THEN 1 ELSE 2 END, round(significance, 9) DESC, fam, peak DESC, branch_id) AS INT) AS rank, greatest(count(*) OVER (PARTITION BY run_id) - 12, 0) AS suppressed FROM v) ;; SELECT *, rank = 1 AS primary_branch FROM k WHERE rank <= 12")
def branch_rank(spark, d):
    s = V.branch_summary(samples(spark, d), V.time_steps(zone_state(spark, d))).withColumn("significance", F.round("significance", 9))
    return V.ranked_branches(s).select("run_id", "branch_id", "rank", "suppressed", "primary_branch")


@query("support_counts", "support n", "", SUMMARY + " ;; SELECT support, count(*) AS n FROM v GROUP BY 1")
def support_counts(spark, d):
    return V.branch_summary(samples(spark, d), V.time_steps(zone_state(spark, d))).groupBy("support").agg(F.count("*").alias("n"))


@query("kept_samples", "run_id n", "", SUMMARY + ", k AS (SELECT run_id, branch_id FROM v WHERE support = 'tracked') ;; SELECT run_id, count(*) AS n FROM b WHERE (run_id, branch_id) IN (SELECT run_id, branch_id FROM k) GROUP BY 1")
def kept_samples(spark, d):
    s = samples(spark, d)
    kept = V.branch_summary(s, V.time_steps(zone_state(spark, d))).filter("support = 'tracked'")
    return s.join(kept, ["run_id", "branch_id"], "left_semi").groupBy("run_id").agg(F.count("*").alias("n"))


@query("branch_types", "run_id snapshot_index zone_id kind", "", "t AS (SELECT *, CASE zone_id % 3 WHEN 0 THEN 'shock_like' WHEN 1 THEN 'release_like' ELSE 'contact_like' END AS f, CASE WHEN velocity >= 0 THEN 'low_to_high' ELSE 'high_to_low' END AS dir FROM g) ;; SELECT *, CASE f WHEN 'contact_like' THEN 'contact_transition' WHEN 'release_like' THEN CASE WHEN zone_id > 13 AND dir <> 'high_to_low' THEN 'rear_rarefaction' ELSE 'release_rarefaction' END ELSE CASE WHEN dir <> 'high_to_low' THEN 'reflected_shock' WHEN zone_id > 4 THEN 'transmitted_shock' ELSE 'compressive_shock' END END AS kind FROM t")
def branch_types(spark, d):
    f = F.when(F.col("zone_id") % 3 == 0, "shock_like").when(F.col("zone_id") % 3 == 1, "release_like").otherwise("contact_like")
    direction = F.when(F.col("velocity") >= 0, "low_to_high").otherwise("high_to_low")
    return zone_state(spark, d).select(*RS, "zone_id", V.branch_type(f, direction, F.lit("high_to_low"), F.col("zone_id") > 4, F.col("zone_id") > 13).alias("kind"))


CROSSED = SAMPLES + ", w AS (SELECT *, lag(interface_id) OVER k AS x0, lag(time_s) OVER k AS t0 FROM b WINDOW k AS (PARTITION BY run_id, branch_id ORDER BY snapshot_index)), r AS (SELECT i AS left_region, i + 1 AS right_region, i * 4 AS boundary_zone, (i * 4 - 1) * 1e0 AS lv FROM (SELECT unnest(range(1, 4)) AS i)), x AS (SELECT run_id, branch_id, left_region, boundary_zone, min(snapshot_index) AS snapshot_index, min_by(t0 + (lv - x0) / (interface_id - x0) * (time_s - t0), snapshot_index) AS crossing_time FROM w JOIN r ON x0 < lv AND lv <= interface_id GROUP BY 1, 2, 3, 4)"


def crossed(spark, d):
    return E.crossings(samples(spark, d).withColumn("direction", F.lit("low_to_high")), G.interfaces(regions(spark)))


@query("boundary_crossings", "run_id branch_id left_region snapshot_index", "crossing_time", CROSSED + " ;; SELECT run_id, branch_id, CAST(left_region AS INT) AS left_region, snapshot_index, crossing_time FROM x")
def boundary_crossings(spark, d):
    return crossed(spark, d).select("run_id", "branch_id", "left_region", "snapshot_index", "crossing_time")


#: Branches with direction, type and support, their crossings along that direction, and for each crossing the best other branch in each role.
EVENTS = SUMMARY + """,
br AS (SELECT v.run_id, v.branch_id, support, round(significance, 9) AS significance, CASE support WHEN 'tracked' THEN 0 WHEN 'short_weak' THEN 1 ELSE 2 END AS sr, dir,
  CASE WHEN v.branch_id BETWEEN 9 AND 12 THEN 'contact_transition' WHEN v.branch_id BETWEEN 5 AND 8 THEN 'release_rarefaction' WHEN dir = 'low_to_high' THEN 'reflected_shock' WHEN v.branch_id > 4 THEN 'transmitted_shock' ELSE 'compressive_shock' END AS kind
  FROM v JOIN (SELECT run_id, branch_id, CASE WHEN max_by(interface_id, snapshot_index) < min_by(interface_id, snapshot_index) THEN 'high_to_low' ELSE 'low_to_high' END AS dir FROM b GROUP BY 1, 2) USING (run_id, branch_id)),
wd AS (SELECT b.*, dir, lag(interface_id) OVER k AS x0, lag(time_s) OVER k AS t0 FROM b JOIN br USING (run_id, branch_id) WINDOW k AS (PARTITION BY run_id, branch_id ORDER BY snapshot_index)),
lv AS (SELECT i AS left_region, i * 4 AS boundary_zone, (i * 4 - 1) * 1e0 AS lv FROM (SELECT unnest(range(1, 4)) AS i)),
x AS (SELECT run_id, branch_id, left_region, boundary_zone, min(snapshot_index) AS snapshot_index, min_by(t0 + (lv - x0) / (interface_id - x0) * (time_s - t0), snapshot_index) AS crossing_time
  FROM wd JOIN lv ON CASE dir WHEN 'high_to_low' THEN x0 > lv AND lv >= interface_id ELSE x0 < lv AND lv <= interface_id END GROUP BY 1, 2, 3, 4),
ex AS (SELECT x.*, kind, dir, sr FROM x JOIN br USING (run_id, branch_id) WHERE sr < 2),
gx AS (SELECT e.run_id, boundary_zone, b.branch_id AS other, min(abs(b.interface_id - (boundary_zone - 1))) AS gx FROM (SELECT DISTINCT run_id, boundary_zone FROM ex) e JOIN b ON b.run_id = e.run_id GROUP BY 1, 2, 3 HAVING gx <= 2.5e0),
gt AS (SELECT e.run_id, e.branch_id, e.boundary_zone, gx.other, any_value(gx.gx) AS gx, round(min(abs(b.time_s - crossing_time) / greatest(3 * step, 1e-12)), 9) AS gt
  FROM ex e JOIN gx USING (run_id, boundary_zone) JOIN st USING (run_id) JOIN b ON b.run_id = e.run_id AND b.branch_id = gx.other WHERE gx.other <> e.branch_id GROUP BY 1, 2, 3, 4),
ro AS (SELECT gt.*, c.kind, CASE WHEN c.kind IN ('transmitted_shock', 'compressive_shock') THEN 't' WHEN c.kind = 'reflected_shock' THEN 's' WHEN c.kind = 'contact_transition' THEN 'c' ELSE 'r' END AS role, c.sr, c.significance,
  CASE WHEN c.kind = 'contact_transition' THEN 0 WHEN c.kind IN ('transmitted_shock', 'compressive_shock') THEN CAST(c.dir <> i.dir AS INT) ELSE CAST(c.dir = i.dir AS INT) END AS penalty
  FROM gt JOIN br c ON c.run_id = gt.run_id AND c.branch_id = gt.other JOIN br i ON i.run_id = gt.run_id AND i.branch_id = gt.branch_id WHERE gt <= 1 AND c.sr < 2),
oc AS (SELECT *, row_number() OVER (PARTITION BY run_id, branch_id, boundary_zone, role ORDER BY sr, penalty, gt, round(gx, 9), significance DESC, other) AS k FROM ro),
on1 AS (SELECT run_id, branch_id, boundary_zone, max(other) FILTER (WHERE role = 't') AS t, max(other) FILTER (WHERE role = 's') AS shock, max(other) FILTER (WHERE role = 'r') AS release, max(other) FILTER (WHERE role = 'c') AS c FROM oc WHERE k = 1 GROUP BY 1, 2, 3),
ev AS (SELECT ex.*, CASE WHEN ex.kind = 'transmitted_shock' THEN ex.branch_id ELSE t END AS transmitted, shock, release, CASE WHEN ex.kind = 'contact_transition' THEN ex.branch_id ELSE c END AS contact FROM ex LEFT JOIN on1 USING (run_id, branch_id, boundary_zone)),
cl AS (SELECT *, CASE WHEN kind = 'contact_transition' THEN 'contact_continuation' WHEN (transmitted IS NOT NULL)::INT + (shock IS NOT NULL)::INT + (release IS NOT NULL)::INT + (contact IS NOT NULL)::INT >= 2 THEN 'unresolved_ambiguous_split' WHEN transmitted IS NOT NULL OR kind = 'transmitted_shock' THEN 'transmitted_shock' WHEN shock IS NOT NULL OR kind = 'reflected_shock' THEN 'reflected_shock' WHEN release IS NOT NULL OR kind IN ('release_rarefaction', 'rear_rarefaction') THEN 'reflected_release' WHEN contact IS NOT NULL THEN 'contact_continuation' ELSE 'unresolved_ambiguous_split' END AS classification FROM ev)"""


def typed_branches(spark, d):
    """The grid's branches: run_id, branch_id, branch_type, branch_direction, support_rank, significance; and their samples with the direction."""
    s = samples(spark, d)
    moved = s.groupBy("run_id", "branch_id").agg(F.when(F.max_by("interface_id", "snapshot_index") < F.min_by("interface_id", "snapshot_index"), "high_to_low").otherwise("low_to_high").alias("branch_direction"))
    zone = F.col("branch_id")
    family = F.when(zone.between(9, 12), "contact_like").when(zone.between(5, 8), "release_like").otherwise("shock_like")
    b = V.branch_summary(s, V.time_steps(zone_state(spark, d))).join(moved, ["run_id", "branch_id"])
    kind = V.branch_type(family, F.col("branch_direction"), F.lit("high_to_low"), zone > 4, F.lit(False))
    b = b.select("run_id", "branch_id", kind.alias("branch_type"), "branch_direction", E.support_rank(F.col("support")).alias("support_rank"), F.round("significance", 9).alias("significance"))
    return b, s.join(moved.withColumnRenamed("branch_direction", "direction"), ["run_id", "branch_id"])


def event_table(spark, d):
    b, s = typed_branches(spark, d)
    return E.interface_events(E.crossings(s, G.interfaces(regions(spark))), s, b, V.time_steps(zone_state(spark, d)))


@query("interface_events", "run_id branch_id boundary_zone transmitted shock release contact classification", "crossing_time", EVENTS + " ;; SELECT run_id, branch_id, CAST(boundary_zone AS INT) AS boundary_zone, transmitted, shock, release, contact, classification, crossing_time FROM cl")
def interface_events(spark, d):
    return event_table(spark, d).select("run_id", "branch_id", "boundary_zone", "transmitted", "shock", "release", "contact", "classification", "crossing_time")


@query("event_counts", "classification n", "", EVENTS + " ;; SELECT classification, count(*) AS n FROM cl GROUP BY 1")
def event_counts(spark, d):
    return event_table(spark, d).groupBy("classification").agg(F.count("*").alias("n"))


PLACED = CROSSED + ", " + SUMMARY.removeprefix(SAMPLES + ", ")


@query("event_order", "run_id branch_id boundary_zone place", "", PLACED + ", o AS (SELECT x.*, support, significance, 'Region ' || left_region || ' -> ' || (left_region + 1) AS label FROM x JOIN v USING (run_id, branch_id)) ;; SELECT run_id, branch_id, CAST(boundary_zone AS INT) AS boundary_zone, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CASE support WHEN 'tracked' THEN 0 ELSE 1 END, round(significance, 9) DESC, CAST(crossing_time AS FLOAT), label, branch_id) AS INT) AS place FROM o")
def event_order(spark, d):
    b = V.branch_summary(samples(spark, d), V.time_steps(zone_state(spark, d))).select("run_id", "branch_id", "support", F.round("significance", 9).alias("significance"))
    label = F.concat(F.lit("Region "), F.col("left_region"), F.lit(" -> "), F.col("left_region") + 1)
    return E.ordered(crossed(spark, d).join(b, ["run_id", "branch_id"]).withColumn("label", label)).select("run_id", "branch_id", "boundary_zone", "place")


@query("event_lookup", "run_id boundary_zone branch_id", "crossing_time", PLACED + " ;; SELECT a.run_id, a.boundary_zone, a.branch_id, crossing_time FROM (SELECT DISTINCT run_id, zone_id AS branch_id, CAST(region_id * 4 AS INT) AS boundary_zone FROM g) a LEFT JOIN (SELECT x.* FROM x JOIN v USING (run_id, branch_id) WHERE support <> 'provisional') e ON e.run_id = a.run_id AND e.branch_id = a.branch_id AND e.boundary_zone = a.boundary_zone")
def event_lookup(spark, d):
    """The event of each zone's branch at its own region's upper bound."""
    z = zone_state(spark, d)
    asked = z.select("run_id", F.col("zone_id").alias("branch_id"), (F.col("region_id") * 4).alias("boundary_zone")).distinct()
    return E.lookup(asked, crossed(spark, d), V.branch_summary(samples(spark, d), V.time_steps(z))).select("run_id", "boundary_zone", "branch_id", "crossing_time")


@query("compressive_branch", "run_id branch_id", "", SUMMARY + ", k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE support WHEN 'tracked' THEN 0 ELSE 1 END, round(significance, 9) DESC, samples DESC, branch_id) AS j FROM v WHERE region < 3 AND support <> 'provisional') ;; SELECT * FROM k WHERE j = 1")
def compressive_branch(spark, d):
    s = V.branch_summary(samples(spark, d), V.time_steps(zone_state(spark, d))).withColumns({"significance": F.round("significance", 9), "primary_branch": F.lit(False), "branch_type": F.when(F.col("family") == "shock_like", "compressive_shock").otherwise("other")})
    return P.compressive_branch(s).select("run_id", "branch_id")


TARGET = "f0 AS (SELECT run_id, min(snapshot_index) AS m FROM g GROUP BY 1), c0 AS (SELECT run_id, region_id, sum(density * width_cm) AS mass, sum(width_cm) AS width, 4 - region_id AS path_rank FROM g JOIN f0 USING (run_id) WHERE snapshot_index = m GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS path_count, bool_or(region_id <> 4) OVER (PARTITION BY run_id) AS others FROM c0), o AS (SELECT *, mass / max(mass) OVER (PARTITION BY run_id) AS ms, width / max(width) OVER (PARTITION BY run_id) AS wsc FROM n WHERE region_id <> 4 OR NOT others), t AS (SELECT *, 1.1e0 * ms + 35e-2 * wsc + CASE WHEN region_id <> 4 THEN 75e-2 ELSE 0 END + CASE WHEN path_rank > 0 AND path_rank < greatest(1, path_count - 1) THEN 35e-2 ELSE 0 END - CASE WHEN path_count > 2 AND path_rank = path_count - 1 THEN 2e-1 ELSE 0 END + CASE WHEN path_rank >= 2 THEN 1e-1 ELSE 0 END AS score FROM o), tg AS (SELECT run_id, region_id, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(score, 9) DESC, ms DESC, wsc DESC, path_rank) AS j FROM t) WHERE j = 1)"


def targets(spark, d):
    z = zone_state(spark, d).withColumn("m", F.min("snapshot_index").over(Window.partitionBy("run_id"))).filter("snapshot_index = m")
    c = z.groupBy("run_id", "region_id").agg(F.sum(F.col("density") * F.col("width_cm")).alias("mass"), F.sum("width_cm").alias("width"))
    c = c.withColumns({"path_rank": 4 - F.col("region_id"), "path_count": F.count("*").over(Window.partitionBy("run_id")), "incident_region": F.lit(4)})
    return P.target_region(c)


@query("target_region", "run_id region_id", "score", TARGET + " ;; SELECT * FROM tg")
def target_region(spark, d):
    return targets(spark, d).select("run_id", "region_id", "score")


def preheat_rows(spark, d):
    """Before each target is reached: the first crossing of its upper bound by any branch, or else the run's end."""
    b, s = typed_branches(spark, d)
    first = E.crossings(s, G.interfaces(regions(spark))).groupBy("run_id", F.col("left_region").alias("region_id")).agg(F.min("crossing_time").alias("crossing_time"))
    z = energies(zone_state(spark, d))
    ends = z.groupBy("run_id").agg(F.max("time_s").alias("end"))
    entry = targets(spark, d).join(first, ["run_id", "region_id"], "left").join(ends, "run_id").select("run_id", "region_id", F.coalesce("crossing_time", "end").alias("entry_time"))
    return P.preheat_series(z, entry)


PRE = EVENTS + ", " + ENERGY + ", " + TARGET + f""",
en AS (SELECT run_id, region_id, coalesce(crossing_time, fin) AS entry_time FROM tg LEFT JOIN (SELECT run_id, left_region AS region_id, min(crossing_time) AS crossing_time FROM x GROUP BY 1, 2) USING (run_id, region_id) JOIN (SELECT run_id, max(time_s) AS fin FROM g GROUP BY 1) USING (run_id)),
tz AS (SELECT ge.*, entry_time FROM ge JOIN en USING (run_id, region_id)),
ep AS (SELECT run_id, greatest(1e-9, 1e-2 * coalesce(quantile_cont(fp, 5e-1) FILTER (WHERE fp > 0), 0)) AS eps FROM (SELECT run_id, zone_id, min_by(pressure, snapshot_index) AS fp FROM tz GROUP BY 1, 2) GROUP BY 1),
ch AS (SELECT tz.*, temperature_e - first_value(temperature_e) OVER w AS dte, mean_charge - first_value(mean_charge) OVER w AS dz, electron_energy - first_value(electron_energy) OVER w AS dee, density / first_value(density) OVER w AS ratio, (pressure - first_value(pressure) OVER w) / (first_value(pressure) OVER w + eps) AS rp, density * width_cm AS mass FROM tz JOIN ep USING (run_id) WINDOW w AS {WT}),
pr AS (SELECT *, (dte >= 1 OR dz >= 5e-2 OR dee >= 1e7 OR radiation_net_heating >= 1e10 OR laser_deposition >= 1e10) AND ratio < 1.1e0 AND rp < 2.5e-1 AS hit FROM ch WHERE time_s < entry_time),
ps AS (SELECT run_id, snapshot_index, any_value(time_s) AS time_s, coalesce(sum(width_cm) FILTER (WHERE hit), 0) / sum(width_cm) AS width_fraction, coalesce(sum(mass) FILTER (WHERE hit), 0) / sum(mass) AS mass_fraction, sum(mass * dte) FILTER (WHERE hit) / sum(mass) FILTER (WHERE hit) AS mean_delta_te, max(dte) FILTER (WHERE hit) AS max_delta_te,
  sum(mass * laser_deposition) AS ld, sum(mass * laser_source) AS ls, sum(mass * radiation_net_heating) AS rn, sum(mass * electron_energy) AS ee, sum(mass * ion_energy) AS ie, sum(mass * radiation_energy) AS re FROM pr GROUP BY 1, 2)"""


@query("preheat_series", "run_id snapshot_index", "width_fraction mass_fraction mean_delta_te max_delta_te", PRE + " ;; SELECT * FROM ps")
def preheat_series(spark, d):
    return preheat_rows(spark, d).select(*RS, "width_fraction", "mass_fraction", "mean_delta_te", "max_delta_te")


BUDGET = PRE + """,
tr AS (SELECT *, 5e-1 * (time_s - lag(time_s) OVER k) AS h, ld + lag(ld) OVER k AS l2, ls + lag(ls) OVER k AS s2, rn + lag(rn) OVER k AS r2, ee + ie + re AS ie3 FROM ps WINDOW k AS (PARTITION BY run_id ORDER BY snapshot_index)),
su AS (SELECT run_id, count(*) AS snapshots, max(width_fraction) AS peak_width_fraction, max(max_delta_te) AS peak_delta_te, coalesce(sum(l2 * h), 0) AS laser_deposition, coalesce(sum(s2 * h), 0) AS laser_source, coalesce(sum(r2 * h), 0) AS radiation_net_heating,
  max_by(ee, snapshot_index) - min_by(ee, snapshot_index) AS electron_energy, max_by(ie, snapshot_index) - min_by(ie, snapshot_index) AS ion_energy, max_by(re, snapshot_index) - min_by(re, snapshot_index) AS radiation_energy, max_by(ie3, snapshot_index) - min_by(ie3, snapshot_index) AS gained FROM tr GROUP BY 1),
bu AS (SELECT *, gained - laser_deposition - radiation_net_heating AS residual FROM su)"""


@query("preheat_summary", "run_id snapshots severity dominant_source", "peak_width_fraction peak_delta_te gained residual", BUDGET + " ;; SELECT *, CASE WHEN peak_width_fraction >= 3.5e-1 OR coalesce(peak_delta_te, 0) >= 1e1 THEN 'severe' WHEN peak_width_fraction >= 1e-1 OR coalesce(peak_delta_te, 0) >= 3 THEN 'moderate' WHEN peak_width_fraction > 0 OR coalesce(peak_delta_te, 0) > 0 THEN 'mild' ELSE 'negligible' END AS severity, CASE WHEN abs(laser_deposition) >= greatest(abs(radiation_net_heating), abs(residual)) THEN 'laser deposition' WHEN abs(radiation_net_heating) >= abs(residual) THEN 'net radiation heating' ELSE 'residual processes' END AS dominant_source FROM bu")
def preheat_summary(spark, d):
    return P.preheat_summary(preheat_rows(spark, d)).select("run_id", "snapshots", "severity", "dominant_source", "peak_width_fraction", "peak_delta_te", "gained", "residual")


@query("preheat_chain")
def preheat_chain(spark, d):
    """Preheat of the region that the primary branch of each run's tracked waves reaches."""
    tracked = written(wave_branches_of(spark, d), "branches")
    z = energies(zone_state(spark, d))
    _, _, targets, summary = C.preheat_of_runs(tracked, z, G.interfaces(regions(spark)), 16)
    return targets.join(summary, "run_id").select("run_id", "branch_id", "region_id", "entry_time", "snapshots", "severity", "dominant_source", "peak_width_fraction", "gained", "residual", "penalty_ratio")


@query("preheat_budget", "run_id channel", "value fraction", BUDGET + ", un AS (UNPIVOT (SELECT run_id, gained, laser_deposition, laser_source, radiation_net_heating, electron_energy, ion_energy, radiation_energy, gained AS internal_energy, residual FROM bu) ON laser_deposition, laser_source, radiation_net_heating, electron_energy, ion_energy, radiation_energy, internal_energy, residual INTO NAME channel VALUE value) ;; SELECT run_id, channel, value, CASE WHEN gained <> 0 THEN value / gained END AS fraction FROM un")
def preheat_budget(spark, d):
    """What each channel gave to the target before it was reached, and its share of the gain."""
    b = P.energy_budget(preheat_rows(spark, d))
    rows = b.select("run_id", "fractions", F.explode("budget").alias("channel", "value"))
    return rows.select("run_id", "channel", "value", F.try_element_at("fractions", F.col("channel")).alias("fraction"))



#: Windows of cells about each candidate; regression sums of each front of a grid; the best front or the centroid.
LOCALISED = CANDIDATES + """,
ca AS (SELECT run_id, snapshot_index, family, interface_id, family_rank, score, threshold, l, r FROM fk WHERE family_rank <= 2 AND score >= 55e-2 * peak),
eg AS (SELECT run_id, snapshot_index, zone_id, outer_cm AS edge, outer_cm - width_cm / 2e0 AS x, width_cm, ln(greatest(density, 1e-30)) AS d, ln(greatest(pressure, 1e-30)) AS p, velocity AS u FROM (SELECT *, sum(width_cm) OVER (PARTITION BY run_id, snapshot_index ORDER BY zone_id) AS outer_cm FROM g)),
wi AS (SELECT ca.*, zone_id, x, edge, width_cm, d, p, u, x - lag(x) OVER (PARTITION BY ca.run_id, ca.snapshot_index, family, interface_id ORDER BY zone_id) AS gap FROM ca JOIN eg ON eg.run_id = ca.run_id AND eg.snapshot_index = ca.snapshot_index AND zone_id BETWEEN interface_id - 1 AND interface_id + 4),
wf AS (SELECT run_id, snapshot_index, family, interface_id, any_value(family_rank) AS fr, any_value(score) AS s, any_value(threshold) AS th, any_value(l) AS l, any_value(r) AS r, count(*) AS n, coalesce(quantile_cont(gap, 5e-1) FILTER (WHERE gap > 0), 1e-8) AS h, coalesce(quantile_cont(width_cm, 5e-1) FILTER (WHERE width_cm > 0), 1e-8) AS c,
  max(edge) FILTER (WHERE zone_id = interface_id) AS e0, max(edge) FILTER (WHERE zone_id = interface_id + 1) AS e1, max(edge) FILTER (WHERE zone_id = interface_id + 2) AS e2 FROM wi GROUP BY 1, 2, 3, 4),
gr AS (SELECT run_id, snapshot_index, family, interface_id, e1 + h * (2e0 * i / 4 - 1e0) AS front, greatest(75e-2 * h, 1e-8) + (greatest(4e0 * h, h) - greatest(75e-2 * h, 1e-8)) * (j / 3e0) AS width
  FROM wf, (SELECT unnest(range(0, 5)) AS i) a, (SELECT unnest(range(0, 4)) AS j) b WHERE family <> 'contact_like' AND fr = 1 AND s >= 125e-2 * th AND n >= 4 AND e1 IS NOT NULL),
gs AS (SELECT *, tanh((x - front) / greatest(width, 1e-12)) AS t FROM gr JOIN wi USING (run_id, snapshot_index, family, interface_id)),
su AS (SELECT run_id, snapshot_index, family, interface_id, front, width, count(*) AS n, regr_sxx(d, t) AS dx, regr_syy(d, t) AS dy, regr_sxy(d, t) AS dc, regr_sxx(p, t) AS px, regr_syy(p, t) AS py, regr_sxy(p, t) AS pc, regr_sxx(u, t) AS ux, regr_syy(u, t) AS uy, regr_sxy(u, t) AS uc FROM gs GROUP BY 1, 2, 3, 4, 5, 6),
er AS (SELECT *, sqrt(greatest(dy - CASE WHEN dx > 1e-29 * n THEN dc * dc / dx ELSE 0 END, 0) / n) / greatest(sqrt(dy / n), 1e-12) + sqrt(greatest(py - CASE WHEN px > 1e-29 * n THEN pc * pc / px ELSE 0 END, 0) / n) / greatest(sqrt(py / n), 1e-12) + sqrt(greatest(uy - CASE WHEN ux > 1e-29 * n THEN uc * uc / ux ELSE 0 END, 0) / n) / greatest(sqrt(uy / n), 1e-12) AS error FROM su),
be1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, snapshot_index, family, interface_id ORDER BY round(error, 6), front, width) AS k FROM er) WHERE k = 1),
lo AS (SELECT wf.*, b.front, b.width, b.error, greatest(l, 0) AS ml, greatest(r, 0) AS mr, greatest(s, 0) AS ms FROM wf LEFT JOIN be1 b USING (run_id, snapshot_index, family, interface_id)),
lm AS (SELECT *, CASE WHEN ml + ms + mr > 0 THEN (mr - ml) / (ml + ms + mr) ELSE 0 END AS m, CASE WHEN ml + ms + mr > 0 THEN (mr + ml) / (ml + ms + mr) ELSE 0 END AS v FROM lo)"""


@query("tanh_localisation", "run_id snapshot_index family interface_id family_rank model", "front width error fit_quality confidence", LOCALISED + " ;; SELECT run_id, snapshot_index, family, interface_id, fr AS family_rank, CASE WHEN front IS NULL THEN 'weighted-centroid' ELSE 'local-joint-tanh' END AS model, coalesce(front, e1 + m * CASE WHEN m < 0 THEN e1 - coalesce(e0, e1) ELSE coalesce(e2, e1) - e1 END) AS front, coalesce(width, greatest(sqrt(greatest(v - m * m, 0)) * c, c)) AS width, error, CASE WHEN front IS NULL THEN 35e-2 ELSE 1 / (1 + error) END AS fit_quality, CASE WHEN front IS NULL THEN 3e-1 ELSE least(greatest(3e-1 + 7e-1 / (1 + error), 0), 1) END AS confidence FROM lm")
def tanh_localisation(spark, d):
    return V.localised(candidates(spark, d, cells=True))


SPEC = "e AS (SELECT vec_id, CAST(unnest(range(1, len(embedding) + 1)) AS INT) AS i, unnest(embedding)::DOUBLE AS raw FROM embeddings), sp AS (SELECT vec_id, i, abs(raw) AS y FROM e)"


def spectra(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", (F.col("i") + 1).cast("int").alias("i"), F.abs(F.col("v").cast("double")).alias("y"))


@query("gaussian_convolve", "vec_id i", "convolved", SPEC + ", kk AS (SELECT CAST(k AS INT) AS k, exp(-5e-1 * pow(k * 1e0 / (3e0 / (2e0 * sqrt(2e0 * ln(2e0)))), 2)) AS w FROM (SELECT unnest(range(-6, 7)) AS k)), kn AS (SELECT k, w / (SELECT sum(w) FROM kk) AS w FROM kk), en AS (SELECT vec_id, max(i) AS m FROM sp GROUP BY 1) ;; SELECT a.vec_id, a.i, sum(b.y * w) AS convolved FROM sp a JOIN en USING (vec_id) CROSS JOIN kn JOIN sp b ON b.vec_id = a.vec_id AND b.i = least(greatest(a.i + k, 1), m) GROUP BY 1, 2", grid=False)
def gaussian_convolve(spark, d):
    return W.convolve(spectra(spark, d), "y", "i", ["vec_id"], 1.0, 3.0)


@query("spectrum_normalise", "vec_id i", "by_peak by_area", SPEC + ", t AS (SELECT *, 5e-1 * (y + lag(y) OVER (PARTITION BY vec_id ORDER BY i)) AS a FROM sp) ;; SELECT *, y / max(y) OVER (PARTITION BY vec_id) AS by_peak, y / sum(a) OVER (PARTITION BY vec_id) AS by_area FROM t", grid=False)
def spectrum_normalise(spark, d):
    s = W.normalised(spectra(spark, d), "y", "i", ["vec_id"], "peak").withColumnRenamed("normalised", "by_peak")
    return W.normalised(s, "y", "i", ["vec_id"], "area").select("vec_id", "i", "by_peak", F.col("normalised").alias("by_area"))


@query("peak_metrics", "vec_id", "peak_x peak_y", SPEC + " ;; SELECT vec_id, min(i) * 1e0 AS peak_x, max(top) AS peak_y FROM (SELECT *, max(y) OVER (PARTITION BY vec_id) AS top FROM sp) WHERE y = top GROUP BY 1", grid=False)
def peak_metrics(spark, d):
    s = spectra(spark, d).withColumn("x", F.col("i").cast("double"))
    return W.peak(s, "y", "x", ["vec_id"]).select("vec_id", "peak_x", "peak_y")


@query("peak_widths", "vec_id", "peak_x peak_y fwhm vertex_x", SPEC + ", n AS (SELECT *, max(y) OVER (PARTITION BY vec_id) AS top, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM sp WINDOW w AS (PARTITION BY vec_id ORDER BY i)), t AS (SELECT vec_id, min(i) AS pk, max(top) AS top FROM n WHERE y = top GROUP BY 1), lr AS (SELECT vec_id, max(i) FILTER (WHERE y < t.top / 2e0 AND i < pk) AS l, min(i) FILTER (WHERE y < t.top / 2e0 AND i > pk) AS r FROM n JOIN t USING (vec_id) GROUP BY 1), le AS (SELECT vec_id, i + (top / 2e0 - y) / (y1 - y) AS cl FROM n JOIN lr USING (vec_id) WHERE i = l), ri AS (SELECT vec_id, i - 1 + (top / 2e0 - y0) / (y - y0) AS cr FROM n JOIN lr USING (vec_id) WHERE i = r) ;; SELECT vec_id, pk * 1e0 AS peak_x, t.top AS peak_y, cr - cl AS fwhm, pk + 5e-1 * (y0 - y1) / nullif(y0 - 2e0 * y + y1, 0) AS vertex_x FROM t JOIN n USING (vec_id) LEFT JOIN le USING (vec_id) LEFT JOIN ri USING (vec_id) WHERE n.i = pk", grid=False)
def peak_widths(spark, d):
    s = spectra(spark, d).withColumn("x", F.col("i").cast("double"))
    return W.peak(s, "y", "x", ["vec_id"])


@query("spectrum_repair", "vec_id i", "repaired", SPEC + ", h AS (SELECT vec_id, i, CASE WHEN i % 5 NOT IN (2, 3) THEN y END AS y FROM sp), r AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(y IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM h) ;; SELECT *, coalesce(y, (a + b) / 2e0, b, a) AS repaired FROM r", grid=False)
def spectrum_repair(spark, d):
    s = spectra(spark, d).withColumn("y", F.when(~(F.col("i") % 5).isin(2, 3), F.col("y")))
    return s.select("vec_id", "i", W.repaired("y", Window.partitionBy("vec_id").orderBy("i")).alias("repaired"))


@query("los_spectrum", "label i", "spectrum", "e AS (SELECT label, vec_id % 10 + 1 AS w, CAST(unnest(range(1, len(embedding) + 1)) AS INT) AS i, abs(unnest(embedding)::DOUBLE) AS y FROM embeddings) ;; SELECT label, i, sum(w * y) / sum(w) AS spectrum FROM e GROUP BY 1, 2", grid=False)
def los_spectrum(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", (F.col("vec_id") % 10 + 1).alias("w"), F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", (F.col("i") + 1).cast("int").alias("i")).agg(R.weighted_mean(F.abs(F.col("v").cast("double")), F.col("w")).alias("spectrum"))


@query("ensemble_balance", "label i", "balanced", "e AS (SELECT label, CAST(unnest(range(1, len(embedding) + 1)) AS INT) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS re, avg(abs(v)) + 1e-1 AS im FROM e GROUP BY 1, 2) ;; SELECT label, i, im / (re * re + im * im) / (1e0 - exp(-i / 1e1)) AS balanced FROM m", grid=False)
def ensemble_balance(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", (F.col("i") + 1).cast("int").alias("i")).agg(F.avg(F.col("v").cast("double")).alias("re"), (F.avg(F.abs(F.col("v").cast("double"))) + 0.1).alias("im"))
    return m.select("label", "i", (S.loss(F.col("re"), F.col("im")) / S.detailed_balance(F.col("i").cast("double"), F.lit(10.0))).alias("balanced"))


@query("line_profile", "run_id i", "profile", "c AS (SELECT run_id, avg(temperature_e) / 4e0 AS mu, avg(pressure) AS area FROM g GROUP BY 1), p AS (SELECT *, CAST(unnest(range(0, 21)) AS INT) AS i FROM c), q AS (SELECT *, exp(-5e-1 * pow((i - mu) / 2e0, 2)) AS y FROM p), t AS (SELECT *, 5e-1 * (y + lag(y) OVER (PARTITION BY run_id ORDER BY i)) AS a FROM q) ;; SELECT run_id, i, area * y / sum(a) OVER (PARTITION BY run_id) AS profile FROM t")
def line_profile(spark, d):
    c = zone_state(spark, d).groupBy("run_id").agg((F.avg("temperature_e") / 4.0).alias("mu"), F.avg("pressure").alias("area"))
    q = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("y", F.exp(-0.5 * F.pow((F.col("i") - F.col("mu")) / 2.0, F.lit(2.0))))
    n = W.normalised(q, "y", "i", ["run_id"], "area")
    return n.select("run_id", "i", (F.col("area") * F.col("normalised")).alias("profile"))


@query("spectroscopy_module", "run_id snapshot_index sane", "mean_velocity los_velocity width_nm", "SELECT run_id, snapshot_index, true AS sane, sum(velocity * electron_density * width_cm) / sum(electron_density * width_cm) AS mean_velocity, 5e-1 * sum(velocity * electron_density * width_cm) / sum(electron_density * width_cm) AS los_velocity, 7.7e-5 * 5e2 * sqrt(sum(temperature_i * electron_density * width_cm) / sum(electron_density * width_cm) / 2.7e1) AS width_nm FROM g GROUP BY 1, 2")
def spectroscopy_module(spark, d):
    return M.checked("spectroscopy", M.REGISTRY["spectroscopy"].compute(zone_state(spark, d))).select(*RS, "sane", "mean_velocity", "los_velocity", "width_nm")


@query("plasmon_module", "run_id snapshot_index regime", "k_debye peak_ev", "m AS (SELECT run_id, snapshot_index, sum(temperature_e * electron_density * width_cm) / sum(electron_density * width_cm) AS te, sum(electron_density * electron_density * width_cm) / sum(electron_density * width_cm) AS ne FROM g GROUP BY 1, 2), k AS (SELECT *, 4e0 * pi() * sin(radians(2e1) / 2e0) / (1.239841984e1 * 1e-8 / 8e0) * 7.43e2 * sqrt(te / ne) AS k_debye FROM m) ;; SELECT *, CASE WHEN k_debye < 1 THEN 'collective' ELSE 'non-collective' END AS regime, sqrt(1 + 3e0 * k_debye * k_debye) * 6.582119569e-16 * 5.64e4 * sqrt(ne) AS peak_ev FROM k")
def plasmon_module(spark, d):
    return M.REGISTRY["plasmon"].compute(zone_state(spark, d)).select(*RS, "regime", "k_debye", "peak_ev")


@query("all_modules", "module n n_sane", "", "h AS (SELECT *, CASE WHEN zone_id % 16 = run_id % 16 AND velocity < 0 THEN -electron_density ELSE electron_density END AS ne, CASE WHEN velocity < -3e0 THEN -1e3 ELSE temperature_i END AS ti FROM g), x AS (SELECT pow(sum(density * width_cm) / sum(width_cm) / 2e1, 1e0 / 3e0) * 3e-1 AS s FROM g GROUP BY run_id, snapshot_index, region_id), m AS (SELECT sum(ne * width_cm) AS c, sum(CASE WHEN ne > 0 THEN ti * ne * width_cm END) / sum(CASE WHEN ne > 0 THEN ne * width_cm END) AS t, sum(CASE WHEN ne > 0 THEN temperature_e * ne * width_cm END) / sum(CASE WHEN ne > 0 THEN ne * width_cm END) AS te FROM h GROUP BY run_id, snapshot_index) ;; SELECT 'xrd' AS module, count(*) AS n, count(*) FILTER (WHERE s <= 1) AS n_sane FROM x UNION ALL SELECT 'transmission', count(*), count(*) FILTER (WHERE c >= 0) FROM m UNION ALL SELECT 'spectroscopy', count(*), count(*) FILTER (WHERE t >= 0) FROM m UNION ALL SELECT 'plasmon', count(*), count(*) FILTER (WHERE te > 0) FROM m")
def all_modules(spark, d):
    from functools import reduce

    z = zone_state(spark, d)
    bad = (F.col("zone_id") % 16 == F.col("run_id") % 16) & (F.col("velocity") < 0)
    z = z.withColumns({"electron_density": F.when(bad, -F.col("electron_density")).otherwise(F.col("electron_density")), "temperature_i": F.when(F.col("velocity") < -3.0, -1000.0).otherwise(F.col("temperature_i"))})
    parts = [M.checked(n, r).agg(F.count("*").alias("n"), F.count_if("sane").alias("n_sane")).select(F.lit(n).alias("module"), "n", "n_sane") for n, r in M.run_modules(z).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("module_support", "run_id module description complete", "", "c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE velocity >= 0) AS m FROM g GROUP BY 1) ;; SELECT run_id, k AS module, t AS description, CASE k WHEN 'spectroscopy' THEN m ELSE n END AS complete FROM c, (VALUES ('spectroscopy', 'Doppler shift and width of a line from weighted means'), ('plasmon', 'Plasma state, scattering regime and quick-look peak'), ('transmission', 'Thomson depth and transmission'), ('xrd', 'Layer density and shifted Bragg angle')) v(k, t)")
def module_support(spark, d):
    return M.described(zone_state(spark, d).withColumn("velocity", F.when(F.col("velocity") >= 0, F.col("velocity"))), ["run_id"])


@query("merged_series", "run_id snapshot_index", "p", SERIES + " ;; SELECT run_id, snapshot_index, CASE WHEN snapshot_index % 2 = 0 THEN p * 2e0 ELSE p END AS p FROM s")
def merged_series(spark, d):
    s = series(spark, d).select(*RS, "p")
    return M.merge_series(s, s.filter("snapshot_index % 2 = 0").withColumn("p", F.col("p") * 2.0), RS)


@query("shock_as_branch", "run_id branch_id samples", "mean_score", SCORE + ", m AS (SELECT run_id, snapshot_index, max(score) AS score FROM sc GROUP BY 1, 2) ;; SELECT run_id, CAST(1 AS INT) AS branch_id, count(*) AS samples, avg(score) AS mean_score FROM m WHERE score > 0 GROUP BY 1")
def shock_as_branch(spark, d):
    m = scores(spark, d).groupBy(*RS, "time_s").agg(F.max("score").alias("score"), F.max_by("interface_id", "score").alias("interface_id")).filter("score > 0")
    return V.track_as_branch(m).groupBy("run_id", "branch_id").agg(F.count("*").alias("samples"), F.avg("score").alias("mean_score"))


RANKED = SUMMARY + ", pr AS (SELECT run_id, branch_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE support WHEN 'tracked' THEN 0 WHEN 'short_weak' THEN 1 ELSE 2 END, round(significance, 9) DESC, fam, peak DESC, branch_id) AS k FROM v) WHERE k = 1)"


def ranked(spark, d):
    s = V.branch_summary(samples(spark, d), V.time_steps(zone_state(spark, d)))
    return V.ranked_branches(s.withColumn("significance", F.round("significance", 9)))


@query("branch_as_track", "run_id snapshot_index", "track_index track_score", RANKED + " ;; SELECT run_id, snapshot_index, interface_id AS track_index, score AS track_score FROM b JOIN pr USING (run_id, branch_id)")
def branch_as_track(spark, d):
    return V.branch_as_track(samples(spark, d), ranked(spark, d)).select(*RS, "track_index", "track_score")


@query("event_as_crossing", "run_id left_region boundary_zone crossing", "crossing_time", CROSSED + ", " + RANKED.removeprefix(SAMPLES + ", ") + " ;; SELECT run_id, CAST(left_region AS INT) AS left_region, CAST(boundary_zone AS INT) AS boundary_zone, crossing_time, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CAST(crossing_time AS FLOAT), boundary_zone) AS INT) AS crossing FROM x JOIN pr USING (run_id, branch_id)")
def event_as_crossing(spark, d):
    return E.as_crossings(crossed(spark, d), ranked(spark, d)).select("run_id", "left_region", "boundary_zone", "crossing", "crossing_time")
