"""From tracked branches to preheat: typed branches, interface events with their energies, the target that each run's primary branch reaches, its preheat.

``samples`` are those of ``waves.wave_branches``, ``bounds`` those of ``geometry.interfaces``.
Every step is one of the operators for branches, events and preheat; a run's shown branches
and its events are few, so after the samples only small tables are joined with the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import downstream_zone, upstream_zone
from ..session import written
from . import events as E
from . import preheat as P
from . import waves as V

#: Cells from the far end within which a release counts as coming from the rear.
REAR = 3.0


def typed_branches(samples: DataFrame, steps: DataFrame, bounds: DataFrame, primary: str = "high_to_low") -> DataFrame:
    """The shown branches of each run with summary, rank, branch_direction, branch_type and support_rank.

    A branch goes as its last sample with a sign does, or else as it has moved. It has crossed
    if a region bound lies between its ends. ``primary`` is the direction of the run's drive; the rear is where it leads.
    """
    ends = samples.groupBy("run_id").agg(F.min("interface_id").alias("low"), F.max("interface_id").alias("high"))
    sign = F.max_by("direction_sign", F.when(F.col("direction_sign").isNotNull(), F.col("snapshot_index")))
    moved = F.max_by("interface_id", "snapshot_index") - F.min_by("interface_id", "snapshot_index")
    facts = samples.groupBy("run_id", "branch_id").agg(F.coalesce(sign, F.signum(moved)).alias("sign"), F.min("interface_id").alias("lo"), F.max("interface_id").alias("hi"), F.max_by("interface_id", "snapshot_index").alias("at"), F.max_by("branch_family", "snapshot_index").alias("branch_family"))
    levels = bounds.agg(F.array_agg(F.col("boundary_zone") - 1.0).alias("levels"), F.lit(1).alias("one"))  # one row: the few bounds
    facts = facts.withColumn("one", F.lit(1)).join(F.broadcast(levels), "one", "left")
    crossed = F.exists(F.coalesce("levels", F.array().cast("array<double>")), lambda b: (F.col("lo") < b) & (b <= F.col("hi")))
    direction = F.when(F.col("sign") > 0, "low_to_high").when(F.col("sign") < 0, "high_to_low").otherwise(primary)
    facts = facts.join(ends, "run_id").select("run_id", "branch_id", direction.alias("branch_direction"), crossed.alias("crossed"), (F.col("at") - F.col("low") <= REAR if primary == "high_to_low" else F.col("high") - F.col("at") <= REAR).alias("rear"), "branch_family")
    ranked = V.ranked_branches(V.branch_summary(samples, steps)).join(facts, ["run_id", "branch_id"])
    family = F.when(F.col("ambiguous") == 1, "merged_unresolved").otherwise(F.col("branch_family"))
    kind = V.branch_type(family, F.col("branch_direction"), F.lit(primary), F.col("crossed"), F.col("rear"))
    return ranked.withColumns({"branch_type": kind, "support_rank": E.support_rank(F.col("support"))}).drop("crossed", "rear", "branch_family")


def event_energies(events: DataFrame, zones: DataFrame, n_zones: int, radius: int = 2) -> DataFrame:
    """run_id, branch_id, boundary_zone, incident_energy, transmitted_energy (J/cm2): what flows by on either side of an event beyond the window's first value, on the far side from the event on."""
    keys = ["run_id", "branch_id", "boundary_zone"]
    asked = events.select(*keys, "snapshot_index", "branch_direction")
    bound, going = F.col("boundary_zone") - 1, F.col("branch_direction")
    sides = F.array(*[F.struct(F.lit(n).alias("side"), (f(bound, going, F.lit(n_zones)) + 1).cast("int").alias("at")) for n, f in (("up", upstream_zone), ("down", downstream_zone))])
    asked = asked.withColumn("__s", F.explode(sides)).select(*keys, "snapshot_index", "branch_direction", "__s.side", "__s.at").filter("at is not null")
    rows = E.local_window(asked, zones, F.col("at"), radius)
    found = E.local_metrics(rows, [*keys, "side"], F.when(F.col("branch_direction") == "high_to_low", -1.0).otherwise(1.0), (F.col("side") == "up") | (F.col("snapshot_index") >= F.col("event_snapshot")))
    of = lambda side, name: F.max(F.when(F.col("side") == side, F.col("flux"))).alias(name)
    return found.groupBy(*keys).agg(of("up", "incident_energy"), of("down", "transmitted_energy"))


def reached_targets(primary: DataFrame, samples: DataFrame, events: DataFrame, zones: DataFrame) -> DataFrame:
    """Of each run the target region: run_id, region_id, boundary_zone, entry_time, branch_id.

    Regions count along the primary branch's direction from the one it starts in, which it enters with its first
    sample; the others at its event on their near bound. Regions that it does not enter are no candidates.
    """
    first = zones.groupBy("run_id").agg(F.min("snapshot_index").alias("snapshot_index"))
    r = zones.join(first, ["run_id", "snapshot_index"]).groupBy("run_id", "region_id").agg(F.sum(F.col("density") * F.col("width_cm")).alias("mass"), F.sum("width_cm").alias("width"), F.min("zone_id").alias("low_zone"), F.max("zone_id").alias("high_zone"))
    begun = samples.groupBy("run_id", "branch_id").agg(F.min("time_s").alias("begun"))
    r = r.join(primary.select("run_id", "branch_id", "branch_direction"), "run_id").join(begun, ["run_id", "branch_id"])
    falling = F.col("branch_direction") == "high_to_low"
    along = F.when(falling, -F.col("low_zone")).otherwise(F.col("low_zone"))
    run = Window.partitionBy("run_id")
    r = r.withColumns({"path_rank": F.row_number().over(run.orderBy(along)) - 1, "path_count": F.count("*").over(run), "incident_region": F.first("region_id").over(run.orderBy(along))})
    r = r.withColumn("boundary_zone", F.when(F.col("path_rank") > 0, F.when(falling, F.col("high_zone")).otherwise(F.col("low_zone") - 1)))
    own = events.groupBy("run_id", "branch_id", "boundary_zone").agg(F.min("crossing_time").alias("crossing_time"))
    r = r.join(own, ["run_id", "branch_id", "boundary_zone"], "left").withColumn("entry_time", F.when(F.col("path_rank") == 0, F.col("begun")).otherwise(F.col("crossing_time")))
    return P.target_region(r.filter("entry_time is not null")).select("run_id", "region_id", "boundary_zone", "entry_time", "branch_id", "score")


def preheat_of_runs(samples: DataFrame, zones: DataFrame, bounds: DataFrame, n_zones: int, primary: str = "high_to_low") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(branches, events, targets, summary): the whole chain, the first three written tables. Runs without a reliable compressive branch have no target and no summary.

    The penalty ratio sets the target's internal gain against the energy of its entry event:
    what passed the bound, or else what came to it; an unresolved event has none.
    """
    steps = V.time_steps(zones)
    branches = written(typed_branches(samples, steps, bounds, primary), "branches")
    shown = samples.join(branches.select("run_id", "branch_id", F.col("branch_direction").alias("direction")), ["run_id", "branch_id"])
    events = E.interface_events(E.crossings(shown, bounds), shown, branches, steps)
    events = written(events, "events")
    events = written(events.join(event_energies(events, zones, n_zones), ["run_id", "branch_id", "boundary_zone"], "left"), "event-energies")
    targets = written(reached_targets(P.compressive_branch(branches), shown, events, zones), "targets")
    entered = events.filter("classification <> 'unresolved_ambiguous_split'").select("run_id", "branch_id", "boundary_zone", F.coalesce(F.nullif("transmitted_energy", F.lit(0.0)), "incident_energy").alias("event_energy"))
    energy = targets.join(entered, ["run_id", "branch_id", "boundary_zone"]).groupBy("run_id").agg(F.max("event_energy").alias("event_energy"))
    series = P.preheat_series(zones, targets.select("run_id", "region_id", "entry_time"))
    return branches, events, targets, P.preheat_summary(series, energy)
