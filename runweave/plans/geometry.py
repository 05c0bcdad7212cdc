"""Queries of the geometry, join and scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as E
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import windows as win
from .grid import REGIONS_SQL, query, regions, zone_state

RS = ["run_id", "snapshot_index"]
EDGES = "e AS (SELECT *, sum(width_cm) OVER (PARTITION BY run_id, snapshot_index ORDER BY zone_id) AS outer_cm, row_number() OVER (PARTITION BY run_id, snapshot_index ORDER BY zone_id) AS k FROM g)"
NODES = EDGES + ", n AS (SELECT run_id, snapshot_index, CAST(k AS INT) AS node_id, outer_cm AS position_cm FROM e UNION ALL SELECT run_id, snapshot_index, 0, outer_cm - width_cm FROM e WHERE k = 1)"


def edges(spark, d):
    return G.cumulative_edges(zone_state(spark, d))


def nodes(spark, d):
    return G.edge_nodes(edges(spark, d), "outer_cm", "width_cm")


@query("edges_cumulative", "run_id snapshot_index zone_id", "outer_cm", EDGES + " ;; SELECT * FROM e")
def edges_cumulative(spark, d):
    return edges(spark, d).select(*RS, "zone_id", "outer_cm")


@query("edge_nodes", "run_id snapshot_index node_id", "position_cm", NODES + " ;; SELECT * FROM n")
def edge_nodes(spark, d):
    return nodes(spark, d)


@query("edges_repaired", "run_id snapshot_index zone_id fallback", "edge_cm", EDGES + ", p AS (SELECT *, outer_cm + CASE WHEN snapshot_index % 3 = 0 AND zone_id = 8 THEN 1e-3 WHEN snapshot_index % 3 = 1 AND zone_id = 8 THEN 5e0 ELSE 0e0 END - CASE WHEN snapshot_index % 5 = 0 AND zone_id = 9 THEN width_cm ELSE 0 END AS parsed FROM e), s AS (SELECT *, parsed - lag(parsed) OVER w AS step FROM p WINDOW w AS (PARTITION BY run_id, snapshot_index ORDER BY zone_id)), f AS (SELECT run_id, snapshot_index, coalesce(bool_or(step <= 0), false) AND max(abs(parsed - outer_cm)) <= 2e-1 * greatest(max(abs(outer_cm)), 1e0) AS fallback FROM s GROUP BY 1, 2) ;; SELECT s.*, fallback, CASE WHEN fallback THEN outer_cm ELSE parsed END AS edge_cm FROM s JOIN f USING (run_id, snapshot_index)")
def edges_repaired(spark, d):
    bump = F.when((F.col("snapshot_index") % 3 == 0) & (F.col("zone_id") == 8), 1e-3).when((F.col("snapshot_index") % 3 == 1) & (F.col("zone_id") == 8), 5.0).otherwise(0.0)
    flat = F.when((F.col("snapshot_index") % 5 == 0) & (F.col("zone_id") == 9), F.col("width_cm")).otherwise(0.0)
    p = edges(spark, d).withColumn("parsed", F.col("outer_cm") + bump - flat).drop("outer_cm")
    return G.repaired_edges(p, "parsed", "width_cm", 0.2).select(*RS, "zone_id", "fallback", "edge_cm")


@query("width_issues", "run_id snapshot_index", "worst", EDGES + ", p AS (SELECT *, outer_cm + CASE WHEN snapshot_index % 4 = 0 AND zone_id = 8 THEN 1e-1 ELSE 0 END AS q FROM e), s AS (SELECT *, abs(q - lag(q) OVER (PARTITION BY run_id, snapshot_index ORDER BY zone_id) - width_cm) AS gap FROM p) ;; SELECT run_id, snapshot_index, max(gap) AS worst FROM s GROUP BY 1, 2 HAVING max(gap) > 5e-3 * max(width_cm)")
def width_issues(spark, d):
    p = edges(spark, d).withColumn("q", F.col("outer_cm") + F.when((F.col("snapshot_index") % 4 == 0) & (F.col("zone_id") == 8), 0.1).otherwise(0.0))
    return G.width_issues(p, "q", "width_cm").select(*RS, "worst")


@query("boundary_clip", "run_id snapshot_index zone_id", "clipped", "SELECT *, CASE WHEN velocity >= 0 THEN velocity WHEN velocity >= -1e0 THEN 0e0 END AS clipped FROM g")
def boundary_clip(spark, d):
    return zone_state(spark, d).select(*RS, "zone_id", G.clip_boundary(F.col("velocity"), 1.0).alias("clipped"))


@query("centers", "run_id snapshot_index zone_rank", "center_cm", NODES + ", m AS (SELECT *, node_id + 1 AS zone_rank, (position_cm + lead(position_cm) OVER (PARTITION BY run_id, snapshot_index ORDER BY node_id)) / 2e0 AS center_cm FROM n) ;; SELECT * FROM m WHERE center_cm IS NOT NULL")
def centers(spark, d):
    return G.centers_from_edges(nodes(spark, d))


CENTER = EDGES + ", c AS (SELECT *, outer_cm - width_cm / 2e0 AS center_cm FROM e)"


@query("edges_from_centers", "run_id snapshot_index zone_id", "lower_cm upper_cm", CENTER + ", h AS (SELECT *, (lead(center_cm) OVER w - center_cm) / 2e0 AS u, (center_cm - lag(center_cm) OVER w) / 2e0 AS b FROM c WINDOW w AS (PARTITION BY run_id, snapshot_index ORDER BY zone_id)) ;; SELECT *, center_cm - coalesce(b, u, 5e-1) AS lower_cm, center_cm + coalesce(u, b, 5e-1) AS upper_cm FROM h")
def edges_from_centers(spark, d):
    c = edges(spark, d).withColumn("center_cm", F.col("outer_cm") - F.col("width_cm") / 2.0)
    return G.edges_from_centers(c, "center_cm").select(*RS, "zone_id", "lower_cm", "upper_cm")


@query("interfaces", "run_id left_region right_region boundary_zone interface_id", "", "q AS (SELECT run_id, region_id, max(zone_id) AS max_zone FROM g GROUP BY 1, 2), l AS (SELECT *, lead(region_id) OVER (PARTITION BY run_id ORDER BY region_id) AS right_region FROM q) ;; SELECT run_id, region_id AS left_region, right_region, max_zone AS boundary_zone, max_zone - 1 AS interface_id FROM l WHERE right_region IS NOT NULL")
def interfaces(spark, d):
    r = zone_state(spark, d).groupBy("run_id", "region_id").agg(F.max("zone_id").alias("max_zone"))
    return G.interfaces(r, "run_id")


@query("regions_islands", "run_id snapshot_index island min_zone max_zone hot", "", "h AS (SELECT *, temperature_e > 3e1 AS hot FROM g), c AS (SELECT *, CASE WHEN hot IS NOT DISTINCT FROM lag(hot) OVER w AND lag(zone_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS ch FROM h WINDOW w AS (PARTITION BY run_id, snapshot_index ORDER BY zone_id)), i AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY run_id, snapshot_index ORDER BY zone_id) AS BIGINT) AS island FROM c) ;; SELECT run_id, snapshot_index, island, any_value(hot) AS hot, min(zone_id) AS min_zone, max(zone_id) AS max_zone FROM i GROUP BY 1, 2, 3")
def regions_islands(spark, d):
    return G.regions_from_ids(zone_state(spark, d).withColumn("hot", F.col("temperature_e") > 30), "hot", RS)


ENTRY = "en AS (SELECT run_id, run_id % 17 AS origin_zone, CASE run_id % 3 WHEN 0 THEN 'Rmin' WHEN 1 THEN 'Rmax' END AS direction FROM (SELECT DISTINCT run_id FROM g)), en2 AS (SELECT *, CASE WHEN direction IS NULL THEN origin_zone > 8 ELSE direction = 'Rmin' END AS hi FROM en), en3 AS (SELECT *, CASE WHEN hi THEN 'high' ELSE 'low' END AS entry_boundary, CASE WHEN hi THEN least(origin_zone, 16) ELSE greatest(origin_zone, 1) END AS entry_zone, CASE WHEN hi THEN 'high_to_low' ELSE 'low_to_high' END AS propagation FROM en2)"


def entries(spark, d):
    runs = zone_state(spark, d).select("run_id").distinct()
    return G.laser_entry(runs.select("run_id", (F.col("run_id") % 17).alias("origin_zone"), F.when(F.col("run_id") % 3 == 0, "Rmin").when(F.col("run_id") % 3 == 1, "Rmax").alias("direction")), 16)


@query("laser_entry", "run_id entry_boundary entry_zone propagation", "", ENTRY + " ;; SELECT * FROM en3")
def laser_entry(spark, d):
    return entries(spark, d).select("run_id", "entry_boundary", "entry_zone", "propagation")


@query("propagation_direction", "run_id propagation", "median_velocity", ENTRY + ", v AS (SELECT run_id, quantile_cont(velocity, 5e-1) AS median_velocity FROM g GROUP BY 1) ;; SELECT v.run_id, median_velocity, coalesce(p.propagation, CASE WHEN median_velocity < 0 THEN 'high_to_low' ELSE 'low_to_high' END) AS propagation FROM v LEFT JOIN (SELECT * FROM en3 WHERE run_id IN (SELECT run_id FROM g GROUP BY 1 HAVING avg(velocity) >= 1e0)) p USING (run_id)")
def propagation_direction(spark, d):
    z = zone_state(spark, d)
    known = z.groupBy("run_id").agg(F.avg("velocity").alias("v")).filter("v >= 1")
    return G.propagation_direction(z, entries(spark, d).join(known, "run_id", "left_semi"))


@query("observation_axis", "run_id boundary", "cosine", ENTRY + ", o AS (SELECT *, CASE run_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN CASE WHEN hi THEN 'high' ELSE 'low' END ELSE CASE WHEN hi THEN 'low' ELSE 'high' END END AS boundary FROM en3) ;; SELECT *, CASE WHEN boundary = 'high' THEN 1e0 ELSE -1e0 END * cos(radians((run_id % 90) * 1e0)) AS cosine FROM o")
def observation_axis(spark, d):
    side = F.element_at(F.array(*map(F.lit, ["low", "high", "laser", "rear"])), (F.col("run_id") % 4 + 1).cast("int"))
    out = entries(spark, d).withColumn("boundary", G.observation_boundary(side, F.col("propagation")))
    return out.select("run_id", "boundary", G.axis_cosine(F.col("boundary"), (F.col("run_id") % 90).cast("double")).alias("cosine"))


@query("path_lengths", "run_id snapshot_index zone_id", "planar chord shell", EDGES + " ;; SELECT *, width_cm / cos(radians(3e1)) AS planar, greatest(2e0 * (sqrt(greatest(outer_cm * outer_cm - 9e0, 0)) - sqrt(greatest((outer_cm - width_cm) * (outer_cm - width_cm) - 9e0, 0))), 0) AS chord, outer_cm * outer_cm - (outer_cm - width_cm) * (outer_cm - width_cm) AS shell FROM e")
def path_lengths(spark, d):
    e = edges(spark, d)
    inner, outer = F.col("outer_cm") - F.col("width_cm"), F.col("outer_cm")
    return e.select(*RS, "zone_id", G.planar_path(F.col("width_cm"), 30.0).alias("planar"), G.chord(inner, outer, 3.0).alias("chord"), G.shell_factor(inner, outer).alias("shell"))


@query("profile_coordinates", "run_id snapshot_index zone_id", "at_zone at_static at_moving", EDGES + " ;; SELECT *, CAST(zone_id AS DOUBLE) AS at_zone, width_cm * 1e4 AS at_static, coalesce(CASE WHEN snapshot_index % 2 = 0 THEN outer_cm * 1e4 END, width_cm * 1e4) AS at_moving FROM e")
def profile_coordinates(spark, d):
    e = edges(spark, d).withColumn("moving", F.when(F.col("snapshot_index") % 2 == 0, F.col("outer_cm")))
    return e.select(*RS, "zone_id", *[G.profile_coordinate(m, static="width_cm", moving="moving").alias(f"at_{m}") for m in ("zone", "static", "moving")])


@query("boundary_curves", "run_id snapshot_index left_region", "position_cm", NODES + ", " + REGIONS_SQL + " ;; SELECT n.run_id, n.snapshot_index, region_id AS left_region, position_cm FROM n JOIN r4 ON node_id = max_zone AND region_id < 4")
def boundary_curves(spark, d):
    b = G.interfaces(regions(spark))
    return nodes(spark, d).join(F.broadcast(b), F.col("node_id") == F.col("boundary_zone")).select(*RS, "left_region", "position_cm")


@query("interface_positions", "run_id snapshot_index interface_id", "position_cm", NODES + ", m AS (SELECT *, max(node_id) OVER (PARTITION BY run_id, snapshot_index) AS last FROM n) ;; SELECT *, node_id - 1 AS interface_id FROM m WHERE node_id > 0 AND node_id < last")
def interface_positions(spark, d):
    return G.interface_positions(nodes(spark, d))


@query("interface_spacing", "run_id snapshot_index zone_id", "spacing_cm", CENTER + ", s AS (SELECT *, lead(center_cm + CASE WHEN zone_id = 6 THEN -4e0 ELSE 0 END) OVER w - (center_cm + CASE WHEN zone_id = 6 THEN -4e0 ELSE 0 END) AS step FROM c WINDOW w AS (PARTITION BY run_id, snapshot_index ORDER BY zone_id)), m AS (SELECT *, coalesce(min(step) FILTER (WHERE step > 0) OVER (PARTITION BY run_id, snapshot_index), 1e0) AS least_step FROM s) ;; SELECT *, CASE WHEN step > 0 THEN step WHEN step IS NOT NULL THEN least_step END AS spacing_cm FROM m")
def interface_spacing(spark, d):
    c = edges(spark, d).withColumn("center_cm", F.col("outer_cm") - F.col("width_cm") / 2.0 + F.when(F.col("zone_id") == 6, -4.0).otherwise(0.0))
    return G.interface_spacing(c, "center_cm").select(*RS, "zone_id", "spacing_cm")


@query("inactive_ranges", "run_id snapshot_index", "from_cm to_cm", EDGES + ", h AS (SELECT *, density >= 2e1 AS m FROM e), c AS (SELECT *, CASE WHEN m = lag(m) OVER w THEN 0 ELSE 1 END AS ch FROM h WINDOW w AS (PARTITION BY run_id, snapshot_index ORDER BY zone_id)), i AS (SELECT *, sum(ch) OVER (PARTITION BY run_id, snapshot_index ORDER BY zone_id) AS island FROM c) ;; SELECT run_id, snapshot_index, min(outer_cm - width_cm) AS from_cm, max(outer_cm) AS to_cm FROM i WHERE NOT m GROUP BY run_id, snapshot_index, island")
def inactive_ranges(spark, d):
    e = edges(spark, d).withColumn("inner_cm", F.col("outer_cm") - F.col("width_cm"))
    return G.inactive_ranges(e, F.col("density") >= 20, "inner_cm", "outer_cm").select(*RS, "from_cm", "to_cm")


@query("eos_opacity_join", "id eos opacity", "", "e AS (SELECT p_partkey AS id, p_brand AS eos FROM part WHERE p_size >= 20), o AS (SELECT p_partkey AS id, p_type AS opacity FROM part WHERE p_size < 30) ;; SELECT coalesce(e.id, o.id) AS id, coalesce(eos, '') AS eos, coalesce(opacity, '') AS opacity FROM e FULL JOIN o ON e.id = o.id", grid=False)
def eos_opacity_join(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").withColumnRenamed("p_partkey", "id")
    e, o = p.filter("p_size >= 20").select("id", F.col("p_brand").alias("eos")), p.filter("p_size < 30").select("id", F.col("p_type").alias("opacity"))
    return e.join(o, "id", "full").select("id", F.coalesce("eos", F.lit("")).alias("eos"), F.coalesce("opacity", F.lit("")).alias("opacity"))


@query("region_masses", "run_id region_id", "mass", "q AS (SELECT DISTINCT run_id, CAST(unnest(range(1, 6)) AS INT) AS region_id FROM g), m AS (SELECT run_id, region_id, sum(density * width_cm) AS mass FROM g GROUP BY 1, 2) ;; SELECT q.run_id, q.region_id, mass FROM q LEFT JOIN m ON q.run_id = m.run_id AND q.region_id = m.region_id")
def region_masses(spark, d):
    """Masses of the regions, of which the fifth is declared and has no zones."""
    z = zone_state(spark, d)
    m = z.groupBy("run_id", "region_id").agg(F.sum(F.col("density") * F.col("width_cm")).alias("mass"))
    declared = z.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("region_id"))
    return declared.join(m, ["run_id", "region_id"], "left")


@query("source_alignment", "run_id use_log log_snapshots bin_snapshots", "", "l AS (SELECT run_id, count(DISTINCT zone_id) AS z, count(DISTINCT snapshot_index) AS s, min(time_s) AS a, max(time_s) AS b FROM g WHERE density >= 1.5e1 GROUP BY 1), k AS (SELECT run_id, count(DISTINCT zone_id) AS z, count(DISTINCT snapshot_index) AS s, min(time_s) AS a, max(time_s) AS b FROM g GROUP BY 1) ;; SELECT k.run_id, l.s AS log_snapshots, k.s AS bin_snapshots, coalesce(l.z = k.z AND l.s = k.s AND abs(l.a - k.a) <= 1e-14 + 1e-6 * abs(k.a) AND abs(l.b - k.b) <= 1e-14 + 1e-6 * abs(k.b), false) AS use_log FROM k LEFT JOIN l ON k.run_id = l.run_id")
def source_alignment(spark, d):
    z = zone_state(spark, d)
    return J.aligned(z.filter("density >= 15"), z).select("run_id", "log_snapshots", "bin_snapshots", "use_log")


REQUESTS = "rq AS (SELECT run_id, i, 1.1e0 + 1e-1 * (i * 7 % 31) + 3e-2 * i AS want FROM (SELECT DISTINCT run_id FROM g), (SELECT unnest(range(0, 5)) AS i))"


def requests(spark, d):
    z = zone_state(spark, d).select("run_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return z.withColumn("want", 1.1 + 0.1 * (F.col("i") * 7 % 31) + 0.03 * F.col("i"))


@query("nearest_snapshot", "run_id i snapshot_index", "gap", REQUESTS + ", s AS (SELECT DISTINCT run_id, snapshot_index, time_s FROM g) ;; SELECT run_id, i, min_by(snapshot_index, {'a': round(abs(time_s - want), 12), 'b': snapshot_index}) AS snapshot_index, min(abs(time_s - want)) AS gap FROM rq JOIN s USING (run_id) GROUP BY 1, 2")
def nearest_snapshot(spark, d):
    s = zone_state(spark, d).select(*RS, F.round("time_s", 12).alias("time_s")).distinct()
    return J.nearest(requests(spark, d), s, ["run_id"], "want", "time_s", "snapshot_index").drop("want")


@query("probe_2d", "run_id i snapshot_index zone_id", "pressure", REQUESTS + ", s AS (SELECT DISTINCT run_id, snapshot_index, time_s FROM g), n AS (SELECT run_id, i, min_by(snapshot_index, {'a': round(abs(time_s - want), 12), 'b': snapshot_index}) AS snapshot_index FROM rq JOIN s USING (run_id) GROUP BY 1, 2), " + CENTER + ", z AS (SELECT run_id, snapshot_index, i, min_by(zone_id, {'a': round(abs(center_cm - 3e0 * i - 2.3e0), 9), 'b': zone_id}) AS zone_id FROM n JOIN c USING (run_id, snapshot_index) GROUP BY 1, 2, 3) ;; SELECT z.*, pressure FROM z JOIN g USING (run_id, snapshot_index, zone_id)")
def probe_2d(spark, d):
    s = zone_state(spark, d).select(*RS, F.round("time_s", 12).alias("time_s")).distinct()
    at = J.nearest(requests(spark, d), s, ["run_id"], "want", "time_s", "snapshot_index").withColumn("x", 3.0 * F.col("i") + 2.3).drop("gap", "want")
    c = edges(spark, d).withColumn("center_cm", F.col("outer_cm") - F.col("width_cm") / 2.0)
    hit = J.nearest(at, c.select(*RS, "zone_id", "center_cm"), RS, "x", "center_cm", "zone_id")
    return hit.join(zone_state(spark, d).select(*RS, "zone_id", "pressure"), [*RS, "zone_id"]).select("run_id", "i", "snapshot_index", "zone_id", "pressure")


@query("active_trace_zone", "run_id snapshot_index zone_id adjusted", "", "a AS (SELECT * FROM g WHERE snapshot_index = 20 AND density >= 2e1) ;; SELECT run_id, snapshot_index, min_by(zone_id, {'a': abs(zone_id - 7), 'b': zone_id}) AS zone_id, min_by(zone_id, {'a': abs(zone_id - 7), 'b': zone_id}) <> 7 AS adjusted FROM a GROUP BY 1, 2")
def active_trace_zone(spark, d):
    z = zone_state(spark, d).filter("snapshot_index = 20 AND density >= 20")
    want = z.select(*RS).distinct().withColumn("want", F.lit(7))
    out = J.nearest(want, z.withColumn("at", F.col("zone_id")), RS, "want", "at", "zone_id")
    return out.select(*RS, "zone_id", (F.col("zone_id") != 7).alias("adjusted"))


@query("interp_position", "run_id snapshot_index", "position", CENTER + ", x AS (SELECT run_id, snapshot_index, 5.4e0 + (snapshot_index % 3) AS w FROM c GROUP BY 1, 2), b AS (SELECT x.*, max(zone_id) FILTER (WHERE zone_id <= w) AS z0, min(zone_id) FILTER (WHERE zone_id >= w) AS z1, arg_max(center_cm, zone_id) FILTER (WHERE zone_id <= w) AS c0, arg_min(center_cm, zone_id) FILTER (WHERE zone_id >= w) AS c1 FROM x JOIN c USING (run_id, snapshot_index) GROUP BY 1, 2, 3) ;; SELECT *, CASE WHEN z0 IS NULL THEN c1 WHEN z1 IS NULL THEN c0 WHEN z0 = z1 THEN c0 ELSE c0 + (w - z0) / (z1 - z0) * (c1 - c0) END AS position FROM b")
def interp_position(spark, d):
    c = edges(spark, d).withColumn("center_cm", F.col("outer_cm") - F.col("width_cm") / 2.0)
    want = c.select(*RS).distinct().withColumn("w", 5.4 + F.col("snapshot_index") % 3)
    return J.interpolated(want, c, RS, "w", "zone_id", "center_cm").select(*RS, F.col("center_cm_at").alias("position"))


@query("series_at_time", "run_id i", "pressure", REQUESTS + ", s AS (SELECT run_id, time_s, avg(pressure) AS p FROM g GROUP BY 1, 2), b AS (SELECT run_id, i, want, arg_max(p, time_s) FILTER (WHERE time_s <= want) AS p0, max(time_s) FILTER (WHERE time_s <= want) AS t0, arg_min(p, time_s) FILTER (WHERE time_s >= want) AS p1, min(time_s) FILTER (WHERE time_s >= want) AS t1 FROM rq JOIN s USING (run_id) GROUP BY 1, 2, 3) ;; SELECT run_id, i, CASE WHEN t0 IS NULL THEN p1 WHEN t1 IS NULL THEN p0 WHEN t1 = t0 THEN p0 ELSE p0 + (want - t0) / (t1 - t0) * (p1 - p0) END AS pressure FROM b")
def series_at_time(spark, d):
    s = zone_state(spark, d).groupBy("run_id", "time_s").agg(F.avg("pressure").alias("pressure"))
    return J.interpolated(requests(spark, d), s, ["run_id"], "want", "time_s", "pressure").select("run_id", "i", F.col("pressure_at").alias("pressure"))


TABLE = "t AS (SELECT 'm' || m AS material, (1000 * pow(2, k))::DOUBLE AS energy_ev, 5e1 * pow(1000 * pow(2, k) / 1e3, -2.5e0) * (1 + m) AS mu FROM (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(1, 4)) AS m)), cell AS (SELECT *, lead(energy_ev) OVER w AS e1, lead(mu) OVER w AS m1, min(energy_ev) OVER p AS lo, max(energy_ev) OVER p AS hi FROM t WINDOW w AS (PARTITION BY material ORDER BY energy_ev), p AS (PARTITION BY material))"
BRACKET = TABLE + ", q AS (SELECT run_id, snapshot_index, zone_id, width_cm, density, 'm' || abs(material_index) AS material, 7e2 + 4e2 * zone_id + 1e2 * snapshot_index AS energy_ev FROM g), x AS (SELECT q.*, c.energy_ev AS e0, c.mu AS m0, e1, m1 FROM q LEFT JOIN cell c ON q.material = c.material AND e1 IS NOT NULL AND q.energy_ev >= CASE WHEN c.energy_ev = lo THEN c.energy_ev / 1.2e0 ELSE c.energy_ev END AND (q.energy_ev < CASE WHEN e1 = hi THEN e1 * 1.2e0 ELSE e1 END OR (e1 = hi AND q.energy_ev <= e1 * 1.2e0))), y AS (SELECT *, exp(ln(m0) + (ln(m1) - ln(m0)) / (ln(e1) - ln(e0)) * (ln(energy_ev) - ln(e0))) AS mu, CASE WHEN energy_ev = e0 OR energy_ev = e1 THEN 'exact' WHEN energy_ev BETWEEN e0 AND e1 THEN 'interpolated' WHEN e0 IS NOT NULL THEN 'extrapolated' ELSE 'out_of_range' END AS kind FROM x)"


def bracketed(spark, d):
    t = spark.range(0, 12).select((F.col("id") % 4).alias("k"), (F.floor(F.col("id") / 4) + 1).alias("m"))
    e = 1000.0 * F.pow(F.lit(2.0), F.col("k"))
    t = t.select(F.concat(F.lit("m"), "m").alias("material"), e.alias("energy_ev"), (50.0 * F.pow(e / 1e3, F.lit(-2.5)) * (1 + F.col("m"))).alias("mu"))
    q = zone_state(spark, d).select(*RS, "zone_id", "width_cm", "density", F.concat(F.lit("m"), F.abs("material_index")).alias("material"), (700.0 + 400.0 * F.col("zone_id") + 100.0 * F.col("snapshot_index")).alias("energy_ev"))
    return J.attenuation(q, t)


@query("bracket_loglog", "run_id snapshot_index zone_id kind", "mu", BRACKET + " ;; SELECT * FROM y")
def bracket_loglog(spark, d):
    return bracketed(spark, d).select(*RS, "zone_id", "kind", "mu")


@query("attenuation_budget", "run_id snapshot_index material", "tau transmission", BRACKET + " ;; SELECT run_id, snapshot_index, material, sum(mu * density * width_cm * 1e-3) AS tau, exp(-least(sum(mu * density * width_cm * 1e-3), 7e2)) AS transmission FROM y WHERE mu IS NOT NULL GROUP BY 1, 2, 3")
def attenuation_budget(spark, d):
    out = bracketed(spark, d).filter("mu is not null").groupBy(*RS, "material").agg(F.sum(F.col("mu") * F.col("density") * F.col("width_cm") * 1e-3).alias("tau"))
    return out.withColumn("transmission", F.exp(-F.least("tau", F.lit(700.0))))


@query("matched_series_errors", "region_id n", "mae", "p AS (SELECT run_id, snapshot_index, zone_id AS q, region_id, pressure FROM g WHERE density >= 2e1), r AS (SELECT run_id, snapshot_index, zone_id AS q, density FROM g WHERE temperature_e >= 2.5e1) ;; SELECT region_id, count(*) AS n, avg(abs(pressure - density)) AS mae FROM p JOIN r USING (run_id, snapshot_index, q) GROUP BY 1")
def matched_series_errors(spark, d):
    z = zone_state(spark, d)
    p, r = z.filter("density >= 20").select(*RS, "zone_id", "region_id", "pressure"), z.filter("temperature_e >= 25").select(*RS, "zone_id", "density")
    return p.join(r, [*RS, "zone_id"]).groupBy("region_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pressure") - F.col("density"))).alias("mae"))


@query("plasma_state", "run_id snapshot_index zone_id regime", "debye omega energy lnl nu theta rs kf cs k_debye", "k AS (SELECT *, electron_density AS ne, temperature_e AS te, mean_charge AS z, 7.43e2 * sqrt(temperature_e / electron_density) AS ld, pow(3e0 * pi() * pi() * electron_density * 1e6, 1e0 / 3e0) AS kfm, 4e0 * pi() * sin(radians(2e1) / 2e0) / (1.239841984e1 * 1e-8 / 8e0) AS kk FROM g), l AS (SELECT *, greatest(1.44e-7 * greatest(z, 1e-6) / te, 2.76e-8 / sqrt(te)) AS rmin, kfm * kfm * (1.054571817e-34 * 1.054571817e-34 / (2e0 * 9.1093837015e-31) / 1.602176634e-19) AS ef FROM k), m AS (SELECT *, CASE WHEN ld > rmin THEN ln(ld / rmin) END AS ll FROM l) ;; SELECT *, ld * 1e8 AS debye, 5.64e4 * sqrt(ne) / 1e15 AS omega, 6.582119569e-16 * 5.64e4 * sqrt(ne) AS energy, ll AS lnl, 2.91e-6 * ne * ll * pow(te, -1.5e0) / 1e15 AS nu, te / ef AS theta, pow(3e0 / (4e0 * pi() * ne * 1e6), 1e0 / 3e0) / 5.29177210903e-11 AS rs, kfm / 1e10 AS kf, 9.79e5 * sqrt(5e0 / 3e0 * z * te / 2.7e1) / 1e5 AS cs, kk * ld AS k_debye, CASE WHEN kk * ld < 1 THEN 'collective' ELSE 'non-collective' END AS regime FROM m")
def plasma_state(spark, d):
    z = zone_state(spark, d)
    te, ne, q = F.col("temperature_e"), F.col("electron_density"), F.col("mean_charge")
    log_ = S.coulomb_log(te, ne, q)
    k = S.wavevector_cm(F.lit(8.0), F.lit(20.0)) * S.debye_cm(te, ne)
    return z.select(*RS, "zone_id", S.collectivity(k).alias("regime"), (S.debye_cm(te, ne) * 1e8).alias("debye"), (S.plasma_frequency(ne) / 1e15).alias("omega"), S.plasma_energy_ev(ne).alias("energy"), log_.alias("lnl"), (S.collision_rate(ne, te, log_) / 1e15).alias("nu"), S.degeneracy(te, ne).alias("theta"), S.wigner_seitz(ne).alias("rs"), (S.fermi_wavevector_m(ne) / 1e10).alias("kf"), (S.sound_speed(te, q, F.lit(27.0), 5.0 / 3.0) / 1e5).alias("cs"), k.alias("k_debye"))


@query("plasmon_scan", "run_id angle", "peak lnl_piecewise", "m AS (SELECT run_id, sum(temperature_e * electron_density * width_cm) / sum(electron_density * width_cm) AS te, sum(electron_density * electron_density * width_cm) / sum(electron_density * width_cm) AS ne, sum(mean_charge * electron_density * width_cm) / sum(electron_density * width_cm) AS z FROM g GROUP BY 1), a AS (SELECT *, CAST(unnest(range(10, 60, 10)) AS INT) AS angle FROM m), k AS (SELECT *, 4e0 * pi() * sin(radians(angle) / 2e0) / (1.239841984e1 * 1e-8 / 8e0) * 7.43e2 * sqrt(te / ne) AS kd FROM a) ;; SELECT *, sqrt(1 + 3e0 * kd * kd) * 6.582119569e-16 * 5.64e4 * sqrt(ne) AS peak, CASE WHEN te < 1e1 * greatest(z, 1e0) * greatest(z, 1e0) THEN 2.3e1 - ln(sqrt(ne) * greatest(z, 1e0) * pow(te, -1.5e0)) ELSE 2.4e1 - ln(sqrt(ne) / te) END AS lnl_piecewise FROM k")
def plasmon_scan(spark, d):
    from ..operators.reduce import weight_column, weighted_mean

    w = weight_column("electron_column")
    m = zone_state(spark, d).groupBy("run_id").agg(*[weighted_mean(F.col(c), w).alias(n) for c, n in (("temperature_e", "te"), ("electron_density", "ne"), ("mean_charge", "z"))])
    a = m.withColumn("angle", F.explode(F.sequence(F.lit(10), F.lit(50), F.lit(10))))
    te, ne = F.col("te"), F.col("ne")
    kd = S.wavevector_cm(F.lit(8.0), F.col("angle").cast("double")) * S.debye_cm(te, ne)
    return a.select("run_id", "angle", S.bohm_gross_peak_ev(ne, kd).alias("peak"), S.coulomb_log_piecewise(te, ne, F.col("z")).alias("lnl_piecewise"))


@query("free_free", "run_id snapshot_index zone_id opaque", "alpha", "k AS (SELECT *, 7.43e2 * sqrt(temperature_e / electron_density) AS ld, greatest(1.44e-7 * greatest(mean_charge, 1e0) / temperature_e, 2.76e-8 / sqrt(temperature_e)) AS rmin, 1e-2 * zone_id * 1e3 / 6.582119569e-16 AS om, electron_density * 1e6 AS nem FROM g), c AS (SELECT *, 1e0 - pow(5.64e4 * sqrt(electron_density) / om, 2) AS cut FROM k) ;; SELECT *, cut <= 0 AS opaque, CASE WHEN cut > 0 AND ld > rmin THEN 3.1e-17 * mean_charge * nem * nem * ln(ld / rmin) * pow(temperature_e, -1.5e0) * pow(om, -2e0) * pow(greatest(cut, 1e-300), -5e-1) END AS alpha FROM c WHERE ld > rmin")
def free_free(spark, d):
    z = zone_state(spark, d).withColumn("ev", 0.01 * F.col("zone_id"))
    a = S.free_free_per_m(F.col("temperature_e"), F.col("electron_density"), F.col("mean_charge"), F.col("ev"))
    inf = F.lit(float("inf"))
    return z.withColumn("a", a).filter("a is not null").select(*RS, "zone_id", (F.col("a") == inf).alias("opaque"), F.when(F.col("a") < inf, F.col("a")).alias("alpha"))


@query("unit_conversions", "run_id snapshot_index zone_id", "kelvin angstrom ev_line de slog slog_back ek shown ratio doppler doppler_width balance loss_fn", "SELECT *, temperature_e * 1.1604518e4 AS kelvin, 1.239841984e1 / (zone_id * 1e0) AS angstrom, 1e3 * 1.239841984e1 / (zone_id * 1e1) AS ev_line, -velocity * (1e3 * 1.239841984e1 / (zone_id * 1e1)) / zone_id AS de, sign(velocity) * log10(1 + abs(velocity)) AS slog, velocity AS slog_back, 5e-1 * velocity * velocity * 1e-7 * 1e6 AS ek, pressure * 1e-3 AS shown, CASE WHEN zone_id % 4 <> 0 THEN density / (zone_id % 4) END AS ratio, velocity * (5e2 / 2.99792458e10) * 1e6 AS doppler, 7.7e-5 * 5e2 * sqrt(temperature_i / 2.7e1) AS doppler_width, 1e0 - exp(-pressure / temperature_e) AS balance, density / (velocity * velocity + density * density) AS loss_fn FROM g")
def unit_conversions(spark, d):
    z = zone_state(spark, d)
    v, k = F.col("velocity"), F.col("zone_id").cast("double")
    return z.select(*RS, "zone_id", S.kelvin(F.col("temperature_e")).alias("kelvin"), (S.wavelength_cm(k) / S.CM_PER_ANGSTROM).alias("angstrom"), S.energy_ev(k).alias("ev_line"), S.shift_to_energy_ev(v, k).alias("de"), S.signed_log(v).alias("slog"), S.signed_log_inverse(S.signed_log(v)).alias("slog_back"), (S.kinetic_energy(v) * 1e6).alias("ek"), S.to_display(F.col("pressure"), F.lit("pressure")).alias("shown"), S.safe_ratio(F.col("density"), (F.col("zone_id") % 4).cast("double")).alias("ratio"), (S.doppler_shift_nm(v, 500.0) * 1e6).alias("doppler"), S.doppler_width_nm(F.col("temperature_i"), 27.0, 500.0).alias("doppler_width"), S.detailed_balance(F.col("pressure"), F.col("temperature_e")).alias("balance"), S.loss(v, F.col("density")).alias("loss_fn"))


@query("dense_floor", "run_id snapshot_index zone_id", "nu", "SELECT *, greatest(pressure, 5e-2 * 5.64e4 * sqrt(electron_density) / 1e13) AS nu FROM g")
def dense_floor(spark, d):
    return zone_state(spark, d).select(*RS, "zone_id", (S.dense_floor(F.col("pressure") * 1e13, F.col("electron_density")) / 1e13).alias("nu"))


@query("driven_increment", "run_id snapshot_index zone_id", "factor", "f AS (SELECT run_id, zone_id, min_by(density, snapshot_index) AS rho0 FROM g GROUP BY 1, 2) ;; SELECT g.*, least(greatest(least(greatest(density / rho0 - 1, 0), 2) * least(greatest(temperature_e / 3e1, 0), 2), 0), 2) AS factor FROM g JOIN f USING (run_id, zone_id)")
def driven_increment(spark, d):
    from ..operators.modules import driven_factor

    z = zone_state(spark, d).withColumn("rho0", F.first("density").over(win.time()))
    return z.select(*RS, "zone_id", driven_factor(F.col("density") / F.col("rho0"), F.col("temperature_e"), reference_te=30.0).alias("factor"))


@query("form_factor", "vec_id", "f0", "SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: abs(CAST(embedding[i] AS DOUBLE)) * exp(-i * pow((vec_id % 7 + 1) / (4e0 * pi()), 2)))) AS f0 FROM embeddings", grid=False)
def form_factor(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    terms = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: F.struct(F.abs(F.element_at("embedding", i).cast("double")).alias("a"), i.cast("double").alias("b")))
    return e.select("vec_id", S.form_factor((F.col("vec_id") % 7 + 1).cast("double"), terms).alias("f0"))


@query("upstream_downstream", "run_id snapshot_index zone_id up down", "up_density", "i AS (SELECT *, CASE WHEN velocity >= 0 THEN 'low_to_high' ELSE 'high_to_low' END AS dir, least(zone_id - 1, 15) AS lo, least(zone_id, 15) AS hi FROM g), u AS (SELECT *, CASE WHEN dir = 'low_to_high' THEN hi ELSE lo END AS up, CASE WHEN dir = 'low_to_high' THEN lo ELSE hi END AS down FROM i) ;; SELECT u.*, s.density AS up_density FROM u LEFT JOIN g s ON s.run_id = u.run_id AND s.snapshot_index = u.snapshot_index AND s.zone_id = up + 1")
def upstream_downstream(spark, d):
    z = zone_state(spark, d)
    direction, i = F.when(F.col("velocity") >= 0, "low_to_high").otherwise("high_to_low"), F.col("zone_id") - 1
    u = z.select(*RS, "zone_id", S.upstream_zone(i, direction, F.lit(16)).alias("up"), S.downstream_zone(i, direction, F.lit(16)).alias("down"))
    s = z.select(*RS, (F.col("zone_id") - 1).alias("up"), F.struct("density", "velocity", "pressure", "temperature_e", "region_id").alias("state"))
    return u.join(s, [*RS, "up"], "left").select(*RS, "zone_id", "up", "down", F.col("state.density").alias("up_density"))


@query("state_record", "run_id snapshot_index zone_id region_id material_index", "density pressure charge", "SELECT a.run_id, a.snapshot_index, a.zone_id, b.region_id, b.material_index, b.density, b.pressure, b.mean_charge AS charge FROM g a LEFT JOIN g b ON b.run_id = a.run_id AND b.snapshot_index = a.snapshot_index AND b.zone_id = least(16, a.zone_id + 2)")
def state_record(spark, d):
    z = zone_state(spark, d)
    s = E.local_state(z.select(*RS, "zone_id", F.lit(16).alias("n_zones")), z, F.col("zone_id") + 2)
    return s.select(*RS, "zone_id", "state.region_id", "state.material_index", "state.density", "state.pressure", F.col("state.mean_charge").alias("charge"))
