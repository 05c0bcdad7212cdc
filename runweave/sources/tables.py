"""Field catalog, aliases, vectors, run status, source resolution and writers of run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .logheader import footer_state

#: Canonical field, axes, unit, label.
FIELDS = [
    ("density", ["time", "zone"], "g/cm3", "Mass density"),
    ("velocity", ["time", "zone"], "cm/s", "Velocity"),
    ("pressure", ["time", "zone"], "J/cm3", "Total pressure"),
    ("temperature_e", ["time", "zone"], "eV", "Electron temperature"),
    ("temperature_i", ["time", "zone"], "eV", "Ion temperature"),
    ("electron_density", ["time", "zone"], "1/cm3", "Electron density"),
    ("mean_charge", ["time", "zone"], "", "Mean charge"),
    ("width_cm", ["zone"], "cm", "Zone width"),
    ("node_position", ["time", "node"], "cm", "Node position"),
    ("radiation_spectrum", ["time", "frequency"], "J/eV", "Radiation spectrum"),
]
#: A field of the binary files and its name in logs.
LOG_NAMES = {
    "zone_center_cm": "radius",
    "zone_width_cm": "zone_width",
    "mass_density_g_cm3": "density",
    "zone_outer_velocity_cm_s": "velocity",
    "radiation_temperature_eV": "temperature_radiation",
    "ion_temperature_eV": "temperature_i",
    "electron_temperature_eV": "temperature_e",
    "ion_pressure_j_cm3": "pressure_i",
    "electron_pressure_j_cm3": "pressure_e",
    "electron_density_cm3": "electron_density",
    "ion_density_cm3": "ion_density",
    "artificial_viscosity_j_cm3": "artificial_viscosity",
    "ion_energy_j_g": "ion_energy",
    "radiation_heating_j_g_s": "radiation_heating",
    "radiation_cooling_j_g_s": "radiation_cooling",
    "radiation_net_heating_j_g_s": "radiation_net_heating",
    "radiation_pressure_j_cm3": "pressure_radiation",
    "radiation_energy_j_g": "radiation_energy",
    "pressure_j_cm3": "pressure",
    "laser_source_j_g": "laser_source",
    "laser_deposition_j_g_s": "laser_deposition",
}
#: Canonical column of a run table and its older name.
ALIASES = {"temperature_e": "electron_temperature", "temperature_i": "ion_temperature", "pressure": "pressure_total", "mean_charge": "z_bar", "width_cm": "zone_width"}


def padded(df: DataFrame, vector: str, keys: list[str] | None = None) -> DataFrame:
    """Vectors filled with nulls to the widest of their keys (of all rows without keys), and that width."""
    if keys:
        widest = df.groupBy(*keys).agg(F.max(F.size(vector)).alias("width"))
        df = df.join(widest, keys)
    else:
        df = df.withColumn("width", F.lit(df.agg(F.max(F.size(vector))).first()[0]).cast("int"))
    missing = F.array_repeat(F.lit(None).cast(df.schema[vector].dataType.elementType), F.col("width") - F.size(vector))
    return df.withColumn(vector, F.concat(F.col(vector), missing))


def field_catalog(df: DataFrame) -> DataFrame:
    """The catalog rows of the columns that are present, with aliases as rows of their own."""
    spark, have = df.sparkSession, set(df.columns)
    rows = [(n, ax, unit, label, "present" if n in have else "absent", None) for n, ax, unit, label in FIELDS]
    units = {n: (ax, unit, label) for n, ax, unit, label in FIELDS}
    rows += [(alias, *units[n], "present" if n in have else "absent", n) for n, alias in ALIASES.items()]
    return spark.createDataFrame(rows, "name string, dimensions array<string>, unit string, label string, status string, alias_of string")


def inherited(catalog: DataFrame) -> DataFrame:
    """Catalog rows of older tables, which lack axes, with axes by shape.

    ``catalog``: name, dimensions (null if unknown), shape, n_snapshots, n_zones. A
    shape of snapshots by zones is (time, zone); one that begins with the snapshots is
    time and numbered axes; any other has numbered axes only.
    """
    shape, rank = F.col("shape"), F.size("shape")
    timed = (rank >= 1) & (F.get(shape, F.lit(0)) == F.col("n_snapshots"))
    axes = lambda first: F.when(rank > first, F.transform(F.sequence(F.lit(first), rank - 1), lambda i: F.concat(F.lit("axis_"), i))).otherwise(F.array().cast("array<string>"))
    both = timed & (rank == 2) & (F.get(shape, F.lit(1)) == F.col("n_zones"))
    guess = F.when(both, F.array(F.lit("time"), F.lit("zone"))).when(timed, F.concat(F.array(F.lit("time")), axes(1))).otherwise(axes(0))
    return catalog.withColumn("dimensions", F.coalesce("dimensions", guess))


def presentation(dimensions: Column) -> Column:
    """How a field can be shown, by its axes."""
    has = lambda a: F.array_contains(dimensions, a)
    return F.when(has("time") & has("zone"), "map,lineout,trace").when(has("time") & has("node"), "map,lineout").when(has("time") & has("frequency"), "spectrum,map").when(has("zone"), "lineout").when(has("time"), "trace").otherwise("table")


def alias_view(df: DataFrame, names: dict[str, str] = ALIASES) -> DataFrame:
    """The columns under their other names (``LOG_NAMES`` for fields of binary files), unless such a column is there already."""
    return df.select("*", *[F.col(n).alias(a) for n, a in names.items() if n in df.columns and a not in df.columns])


def run_status(snapshots: DataFrame, footers: DataFrame) -> DataFrame:
    """State of each run from the last lines of its log and its last whole snapshot.

    ``snapshots``: run_id, snapshot_index, time_s, time_step_s, valid, and, if it has it,
    the reason of those that are not; ``footers``: run_id, footer, intended_end. A bad last
    block makes a run truncated and is dropped; a bad block before it, or one alone, is
    an error. The note compares the last time with the intended one.
    """
    last = Window.partitionBy("run_id")
    s = snapshots if "reason" in snapshots.columns else snapshots.withColumn("reason", F.lit(None).cast("string"))
    s = s.withColumn("is_last", F.col("snapshot_index") == F.max("snapshot_index").over(last))
    ok = F.when(F.col("valid"), F.struct("snapshot_index", "time_s", "time_step_s"))
    bad_last = F.col("is_last") & ~F.col("valid")
    facts = s.groupBy("run_id").agg(
        F.count("*").alias("indexed"),
        F.count_if("valid").alias("valid_count"),
        F.max(ok).alias("l"),
        F.bool_or(bad_last).alias("dropped_last"),
        F.bool_or(~F.col("is_last") & ~F.col("valid")).alias("damaged"),
        F.max(F.when(bad_last, F.col("reason"))).alias("reason"),
    )
    j = facts.join(footers, "run_id", "left").withColumn("f", footer_state(F.col("footer")))
    state = F.when(F.col("damaged") | (F.col("valid_count") == 0), "error").when(F.col("dropped_last"), "truncated").otherwise(F.col("f.state"))
    source = F.when(F.col("dropped_last"), "partial_final_block").when(F.col("f.message").isNotNull(), "footer").otherwise("footer_absent")
    slack = F.greatest(F.coalesce(F.abs("l.time_step_s"), F.lit(0.0)), 1e-6 * F.abs("intended_end"), F.lit(1e-15))
    note = F.when((F.abs(F.col("intended_end") - F.col("l.time_s")) > slack), "last time differs from the intended end")
    return j.select("run_id", state.alias("state"), source.alias("source"), "indexed", "valid_count", F.col("l.time_s").alias("last_time"), "intended_end", "dropped_last", "reason", F.col("f.message").alias("footer_message"), F.col("f.date").alias("footer_datetime"), note.alias("note"))


def resolve_sources(paths: DataFrame) -> DataFrame:
    """Per stem the mode: the binary file leads, a log of the same stem goes along."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = paths.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"))
    b = parts.filter("ext = 'bpf'").groupBy("stem").agg(F.min("path").alias("binary"))
    l = parts.filter("ext in ('exo', 'log')").groupBy("stem").agg(F.min("path").alias("log"))
    mode = F.when(F.col("binary").isNotNull() & F.col("log").isNotNull(), "binary_with_log").when(F.col("binary").isNotNull(), "binary_only").when(F.col("log").isNotNull(), "log_only").otherwise("none")
    return b.join(l, "stem", "full").select("stem", "binary", "log", mode.alias("mode"))


def registry(paths: DataFrame) -> DataFrame:
    """Kind of each file under a root by its suffix; what is unknown is a row too.

    Where ``paths`` has ``length`` and ``error`` (null if the file could be read), a
    file that is empty or could not be read is of kind ``unreadable``, with the reason as ``problem``.
    """
    ext = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"\.([^.]*)$", 1))
    kind = F.when(ext == "bpf", "binary_run").when(ext.isin("exo", "log"), "log_run").when(ext.isin("parquet", "h5", "h5d"), "run_table").when(ext.isin("csv", "json"), "report").when(ext == "rhc", "input_deck").otherwise("unknown")
    if not {"length", "error"} <= set(paths.columns):
        return paths.select("path", kind.alias("kind"))
    problem = F.coalesce("error", F.when(F.col("length") == 0, "empty file"))
    return paths.select("path", F.when(problem.isNotNull(), "unreadable").otherwise(kind).alias("kind"), problem.alias("problem"))


def quality_gates(zones: DataFrame, fractions: Column | None = None, edges: Column | None = None) -> DataFrame:
    """Violations per snapshot as rows: missing time, missing key fields, fractions out of bounds, frequency edges that do not rise."""
    tests = {"time": F.col("time_s").isNotNull() & ~F.isnan("time_s"), "fields": F.col("density").isNotNull() & F.col("velocity").isNotNull()}
    if fractions is not None:
        total = F.aggregate(fractions, F.lit(0.0), lambda a, x: a + x)
        tests["fractions"] = F.forall(fractions, lambda x: x >= -1e-8) & (F.abs(total - 1.0) <= 1e-6)
    if edges is not None:
        n = F.size(edges)
        rises = F.zip_with(F.slice(edges, 1, F.greatest(n - 1, F.lit(0))), F.slice(edges, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (b > a) & ~F.isnan(a) & ~F.isnan(b))
        tests["edges"] = F.forall(rises, lambda x: F.coalesce(x, F.lit(False)))
    out = zones.groupBy("run_id", "snapshot_index").agg(*[F.bool_and(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    return out.unpivot(["run_id", "snapshot_index"], list(tests), "gate", "passed").filter("not passed").drop("passed")


def write_run_table(df: DataFrame, path: str, *, overwrite: bool = False, compression: str = "zstd") -> None:
    """Run tables in files by ranges of run and snapshot, rows in snapshot and zone order, so that slices prune files and row groups by their statistics.

    A large run is several files and tasks, and small runs share one: with a folder a run, a
    table of many short runs is mostly the making, listing and opening of files.
    """
    rows = df.repartitionByRange("run_id", "snapshot_index").sortWithinPartitions("run_id", "snapshot_index", "zone_id")
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).parquet(path)


def export_spectrum(df: DataFrame, path: str, required: tuple[str, str], optional: list[str] = (), keys: list[str] = ()) -> None:
    """Spectra as CSV with 17 digits, in range-sorted parts; optional columns only where they are complete."""
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in optional]).first() if optional else {}
    columns = [*required, *[c for c in optional if not missing[c]]]
    rows = df.orderBy(*keys, required[0]).select(*keys, *[F.format_string("%.17g", F.col(c)).alias(c) for c in columns])
    rows.write.option("header", True).csv(path)


def status_summary(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The distinct statuses of each group, in order, joined by commas."""
    return rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(status)), ",").alias("statuses"))


def summary(zones: DataFrame) -> DataFrame:
    """Counts of zones, snapshots, regions, materials and fields of each run."""
    fields = len([c for c, t in zones.dtypes if t == "double"])
    return zones.groupBy("run_id").agg(F.count_distinct("zone_id").alias("n_zones"), F.count_distinct("snapshot_index").alias("n_snapshots"), F.count_distinct("region_id").alias("n_regions"), F.count_distinct("material_index").alias("n_materials"), F.lit(fields).alias("n_fields"))


def flattened(df: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """A map column as rows: path and value, sorted by path."""
    return df.select(*keys, F.explode(tree).alias("path", "value"))
