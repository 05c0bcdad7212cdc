"""Interface events from branches: crossings, companions, local integrals, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import trapezoid


def crossings(samples: DataFrame, boundaries: DataFrame) -> DataFrame:
    """First passage of each branch through each region boundary of the grid.

    ``samples``: run_id, branch_id, snapshot_index, time_s, interface_id, direction;
    ``boundaries``: left_region, right_region, boundary_zone, interface_id (few rows).
    """
    b = boundaries.select("left_region", "right_region", "boundary_zone", F.col("interface_id").cast("double").alias("level"))
    over = Window.partitionBy("run_id", "branch_id").orderBy("snapshot_index")
    s = samples.withColumns({"x0": F.lag("interface_id").over(over), "t0": F.lag("time_s").over(over)}).filter("x0 is not null")
    low, high = F.least("x0", "interface_id"), F.greatest("x0", "interface_id")
    falling = F.col("direction") == "high_to_low"
    passed = F.when(falling, (F.col("x0") > F.col("level")) & (F.col("level") >= F.col("interface_id"))).otherwise((F.col("x0") < F.col("level")) & (F.col("level") <= F.col("interface_id")))
    hits = s.join(F.broadcast(b), (b["level"] >= low) & (b["level"] <= high)).filter(passed)
    at = F.col("t0") + (F.col("level") - F.col("x0")) / (F.col("interface_id") - F.col("x0")) * (F.col("time_s") - F.col("t0"))
    return hits.withColumn("at", at).groupBy("run_id", "branch_id", "left_region", "right_region", "boundary_zone").agg(F.min("snapshot_index").alias("snapshot_index"), F.min_by("at", "snapshot_index").alias("crossing_time"))


#: How many median time steps, and how many cells, a companion is from its event at most.
STEPS, CELLS = 3.0, 2.5


def companions(events: DataFrame, samples: DataFrame, branches: DataFrame, steps: DataFrame, roles: dict[str, tuple[list[str], Column | None]], *, cells: float = CELLS) -> DataFrame:
    """The best other branch near each event in each role: a column for each of ``roles`` with its id or null.

    ``branches``: run_id, branch_id, branch_type, branch_direction, support_rank (0 tracked, 1 weak,
    2 provisional) and significance; ``steps``: run_id and step, as ``waves.time_steps`` gives them. A role has
    branch types and the direction it expects, or None. A branch fits if some sample is near in time and some, maybe
    another, near the boundary; provisional ones never do. The best is the better supported, then of the
    expected direction, nearer in time, nearer in place, more significant. Boundaries and samples meet by cells of
    place, then events and the samples of the branches so found by cells of time.
    """
    keys = ["run_id", "branch_id", "boundary_zone"]
    firm = branches.filter("support_rank < 2").select("run_id", F.col("branch_id").alias("other"), "branch_type", "branch_direction", "support_rank", "significance")
    own = samples.select("run_id", F.col("branch_id").alias("other"), "time_s", "interface_id").join(firm, ["run_id", "other"], "left_semi")
    around = lambda c: F.explode(F.array(c - 1, c, c + 1))
    bounds = events.select("run_id", "boundary_zone", (F.col("boundary_zone") - 1.0).alias("__at")).distinct().withColumn("__x", around(F.floor(F.col("__at") / cells)))
    close = bounds.join(own.withColumn("__x", F.floor(F.col("interface_id") / cells)), ["run_id", "__x"]).groupBy("run_id", "boundary_zone", "other").agg(F.min(F.abs(F.col("interface_id") - F.col("__at"))).alias("gap_x")).filter(F.col("gap_x") <= cells)
    tol = F.greatest(STEPS * F.coalesce("step", F.lit(0.0)), F.lit(1e-12))
    timed = lambda df, t: df.withColumn("__tol", tol).withColumn("__t", F.floor(F.col(t) / (1.001 * F.col("__tol"))))
    asked = timed(events.join(steps, "run_id", "left"), "crossing_time").select(*events.columns, "__tol", around(F.col("__t")).alias("__t"))
    asked = asked.join(close, ["run_id", "boundary_zone"]).filter(F.col("other") != F.col("branch_id"))
    near = timed(own.join(steps, "run_id", "left"), "time_s").select("run_id", "other", "time_s", "__t")
    gap_t = F.round(F.min(F.abs(F.col("time_s") - F.col("crossing_time")) / F.col("__tol")), 9)  # in tolerances, as runs have any scale of time
    met = asked.join(near, ["run_id", "other", "__t"]).groupBy(*keys, "other").agg(gap_t.alias("gap_t"), F.first("gap_x").alias("gap_x"))
    met = met.filter(F.col("gap_t") <= 1).join(firm, ["run_id", "other"]).join(branches.select("run_id", "branch_id", F.col("branch_direction").alias("incident")), ["run_id", "branch_id"])

    def best(name: str) -> Column:
        types, expected = roles[name]
        penalty = F.lit(0) if expected is None else F.when(F.col("branch_direction") == expected, 0).otherwise(1)
        rank = F.struct("support_rank", penalty.alias("penalty"), "gap_t", F.round("gap_x", 9).alias("gap_x"), (-F.coalesce("significance", F.lit(0.0))).alias("less"), "other")
        fits = F.col("branch_type").isin(types)
        return F.min_by(F.when(fits, F.col("other")), F.when(fits, rank)).alias(name)

    return events.join(met.groupBy(*keys).agg(*map(best, roles)), keys, "left")


def support_rank(support: Column) -> Column:
    return F.when(support == "tracked", 0).when(support == "short_weak", 1).otherwise(2)


def opposite(direction: Column) -> Column:
    return F.when(direction == "high_to_low", "low_to_high").otherwise("high_to_low")


#: The roles of companions, their branch types, and whether they are expected to go on (True) or back (False).
ROLES = {
    "transmitted": (["transmitted_shock", "compressive_shock"], True),
    "shock": (["reflected_shock"], False),
    "release": (["release_rarefaction", "rear_rarefaction"], False),
    "contact": (["contact_transition"], None),
}


def interface_events(crossed: DataFrame, samples: DataFrame, branches: DataFrame, steps: DataFrame) -> DataFrame:
    """Crossings of branches that are not provisional, with companions and classification.

    Arguments as for ``companions``. A transmitted shock and a contact are their own companions.
    """
    incident = branches.filter("support_rank < 2").select("run_id", "branch_id", "branch_type", "branch_direction", "support_rank")
    asked = crossed.join(incident, ["run_id", "branch_id"])
    on, back = F.col("incident"), opposite(F.col("incident"))
    roles = {n: (types, None if going is None else on if going else back) for n, (types, going) in ROLES.items()}
    found = companions(asked, samples, branches, steps, roles)
    itself = lambda kind, c: F.when(F.col("branch_type") == kind, F.col("branch_id")).otherwise(F.col(c))
    found = found.withColumns({"transmitted": itself("transmitted_shock", "transmitted"), "contact": itself("contact_transition", "contact")})
    return found.withColumn("classification", classified(F.col("branch_type"), *map(F.col, ROLES)))


def ordered(events: DataFrame) -> DataFrame:
    """``place`` of each event in its run: tracked branches first, then the more significant, the earlier, the smaller label.

    ``events``: run_id, support, significance (null: 0), crossing_time (null: last), label, branch_id.
    """
    order = Window.partitionBy("run_id").orderBy(F.when(F.col("support") == "tracked", 0).otherwise(1), F.desc(F.coalesce("significance", F.lit(0.0))), F.asc_nulls_last(F.col("crossing_time").cast("float")), "label", "branch_id")
    return events.withColumn("place", F.row_number().over(order))


def as_crossings(events: DataFrame, ranked: DataFrame) -> DataFrame:
    """Events in the shape of crossings of one front: those of each run's primary branch, the first at each boundary, in order of time."""
    primary = ranked.filter("primary_branch").select("run_id", "branch_id")
    first = events.join(primary, ["run_id", "branch_id"], "left_semi").groupBy("run_id", "left_region", "right_region", "boundary_zone").agg(F.min("crossing_time").alias("crossing_time"))
    order = Window.partitionBy("run_id").orderBy(F.col("crossing_time").cast("float"), "boundary_zone")
    return first.withColumn("crossing", F.row_number().over(order))


def lookup(asked: DataFrame, events: DataFrame, branches: DataFrame) -> DataFrame:
    """Each asked (run_id, boundary_zone, branch_id) with the first event of a branch that is not provisional, or nulls.

    Equal events go by time.
    """
    firm = branches.filter("support <> 'provisional'").select("run_id", "branch_id")
    keys = ["run_id", "boundary_zone", "branch_id"]
    first = events.join(firm, ["run_id", "branch_id"], "left_semi").groupBy(*keys).agg(F.min("crossing_time").alias("crossing_time"))
    return asked.join(first, keys, "left")


def compression(df: DataFrame, keys: list[str], rho: str = "density", order: str = "snapshot_index") -> DataFrame:
    """Largest and smallest positive density over the first positive one, by ``keys``: up, down."""
    positive = F.when(F.col(rho) > 0, F.col(rho))
    first = F.min_by(positive, F.when(positive.isNotNull(), F.col(order)))
    return df.groupBy(*keys).agg((F.max(positive) / first).alias("up"), (F.min(positive) / first).alias("down"))


def classified(kind: Column, transmitted: Column, shock: Column, release: Column, contact: Column) -> Column:
    outcomes = sum((c.isNotNull().cast("int") for c in (shock, release, contact)), transmitted.isNotNull().cast("int"))
    return (
        F.when(kind == "contact_transition", "contact_continuation")
        .when(outcomes >= 2, "unresolved_ambiguous_split")
        .when(transmitted.isNotNull() | (kind == "transmitted_shock"), "transmitted_shock")
        .when(shock.isNotNull() | (kind == "reflected_shock"), "reflected_shock")
        .when(release.isNotNull() | kind.isin("release_rarefaction", "rear_rarefaction"), "reflected_release")
        .when(contact.isNotNull(), "contact_continuation")
        .otherwise("unresolved_ambiguous_split")
    )


STATE = ["density", "velocity", "pressure", "temperature_e", "temperature_i", "mean_charge", "material_index", "region_id"]


def local_state(events: DataFrame, zones: DataFrame, zone: Column, name: str = "state", n_zones: str = "n_zones") -> DataFrame:
    """``events`` with a record ``name`` of the zone ``zone`` in their snapshot; a zone beyond the ends counts as the end.

    ``events``: run_id, snapshot_index and ``n_zones``; fields that ``zones`` lacks are
    null in the record, and the record is null where the zone is null or absent.
    """
    at = F.when(zone.isNotNull(), F.greatest(F.lit(1), F.least(zone, F.col(n_zones)))).cast("int")
    fields = [F.col(c) if c in zones.columns else F.lit(None).cast("double").alias(c) for c in STATE]
    states = zones.select("run_id", "snapshot_index", F.col("zone_id").alias("__zone"), F.struct(*fields).alias(name))
    return events.withColumn("__zone", at).join(states, ["run_id", "snapshot_index", "__zone"], "left").drop("__zone")


def local_window(events: DataFrame, zones: DataFrame, zone: Column, radius: int = 2) -> DataFrame:
    """Rows of each event's zone within ``radius`` snapshots: the keys are equal, the range is a residual filter."""
    e = events.withColumn("zone_id", zone).withColumnRenamed("snapshot_index", "event_snapshot")
    return e.join(zones, ["run_id", "zone_id"]).filter(F.col("snapshot_index").between(F.col("event_snapshot") - radius, F.col("event_snapshot") + radius))


def energy_fluxes(df: DataFrame) -> DataFrame:
    """Adds the fluxes of a zone's internal and kinetic energy and of its pressure's work, and ``flux``, their sum.

    From velocity (cm/s), density (g/cm3), pressure (J/cm3) and the specific energies ion_energy,
    electron_energy, radiation_energy and kinetic_energy (J/g); all null without one of these.
    """
    energies = ("ion_energy", "electron_energy", "radiation_energy", "kinetic_energy")
    e = {c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in energies}
    internal, kinetic = e["ion_energy"] + e["electron_energy"] + e["radiation_energy"], e["kinetic_energy"]
    u, rho, p = F.col("velocity"), F.col("density"), F.col("pressure")
    known = (internal + kinetic + p).isNotNull()
    parts = {"internal": u * rho * internal, "kinetic": u * rho * kinetic, "pressure_work": u * p, "flux": u * (rho * (internal + kinetic) + p)}
    return df.withColumns({n: F.when(known, x) for n, x in parts.items()})


CHANNELS = ("internal", "kinetic", "pressure_work")


def local_metrics(rows: DataFrame, keys: list[str], sign: Column | float = 1.0, since: Column | None = None) -> DataFrame:
    """Pressure impulse, compression, rarefaction, peak pressure and energy of each local window, and the largest channel.

    Impulse and energies are integrals of what exceeds the window's first value; energies count
    along ``sign`` (1 towards higher zones, -1 lower) over the rows with ``since``, a condition that holds from some row on.
    """
    over = Window.partitionBy(*keys).orderBy("snapshot_index")
    rows = energy_fluxes(rows)
    above = {"p_up": F.greatest(F.col("pressure") - F.first("pressure").over(over), F.lit(0.0))}
    since = F.lit(True) if since is None else since
    above |= {f"f_{n}": F.when(since & F.col(n).isNotNull(), F.greatest(sign * (F.col(n) - F.first(n).over(over)), F.lit(0.0))) for n in (*CHANNELS, "flux")}
    rows = rows.withColumns(above)
    rows = rows.withColumns({f"a_{c}": trapezoid(F.col(c), "time_s", over, clamp=False) for c in above})
    total = lambda c: F.when(F.count(c) >= 2, F.sum(f"a_{c}"))
    p, rho = F.col("pressure"), F.col("density")
    positive = F.when(rho > 0, rho)
    first = F.min_by(positive, F.when(positive.isNotNull(), F.col("snapshot_index")))
    out = rows.groupBy(*keys).agg(F.count("*").alias("samples"), total("p_up").alias("impulse"), (F.max(positive) / first).alias("compression"), (F.min(positive) / first).alias("rarefaction"), F.max(p).alias("peak_pressure"), *[total(f"f_{n}").alias(n) for n in (*CHANNELS, "flux")])
    gained = {n: F.greatest(F.coalesce(F.col(n), F.lit(0.0)), F.lit(0.0)) for n in CHANNELS}
    whole = F.nullif(sum(list(gained.values())[1:], gained["internal"]), F.lit(0.0))
    top = F.greatest(*gained.values())
    label = F.when(top <= 0, None).when(gained["internal"] == top, "mostly internal").when(gained["kinetic"] == top, "mostly kinetic").otherwise("mostly pressure-work")
    return out.withColumns({"channel": label, **{f"share_{n}": gained[c] / whole for n, c in (("internal", "internal"), ("kinetic", "kinetic"), ("work", "pressure_work"))}})


def impedance(p: Column, rho: Column, e: Column) -> Column:
    """Proxy impedance from an effective gamma; null unless all are positive."""
    gamma = 1.0 + p / (rho * e)
    return F.when((p > 0) & (rho > 0) & (e > 0), rho * F.sqrt(gamma * p / rho * 1e7))


def reflection(z1: Column, z2: Column) -> Column:
    return F.pow((z2 - z1) / (z2 + z1), F.lit(2.0))


def transmission(z1: Column, z2: Column) -> Column:
    return 4.0 * z1 * z2 / F.pow(z2 + z1, F.lit(2.0))
