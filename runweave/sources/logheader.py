"""Header facts and tables of run logs, and the diagnostics that follow a block's tables.

Everything here is a DataFrame of lines (file, line, text; diagnostics also block). A
section runs from the line with its label to the next label; in most, the first blank
line after a row ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_name, number_token
from .logtext import NUMBER

_REAL = "([0-9.E+-]+)"
#: Facts of the header, the pattern that gives each, its type.
FACTS = {
    "geometry": (r"Geometry type\s*=\s*(\S+)", "string"),
    "code_version": (r"\(ver\.\s*([^)]+)\)", "string"),
    "calculation_datetime": (r"Date and Time of Calculation:([0-9/:. \t]+)", "string"),
    "n_regions": (r"Number of regions\s*=\s*(\d+)", "int"),
    "n_materials": (r"Number of materials\s*=\s*(\d+)", "int"),
    "n_zones": (r"Number of zones\s*=\s*(\d+)", "int"),
    "total_mass": (rf"Total Mass \(g/cm\*\*X\)\s*=\s*{_REAL}", "double"),
    "plasma_model": (r"Plasma model:\s*([^\n]+)", "string"),
    "boundary_temperature_rmin": (rf"Boundary temperature at Rmin \(eV\):\s*{_REAL}", "double"),
    "boundary_temperature_rmax": (rf"Boundary temperature at Rmax \(eV\):\s*{_REAL}", "double"),
    "quiet_start_temperature": (rf"Quiet start temperature \(eV\):\s*{_REAL}", "double"),
    "frequency_groups": (r"Number of frequency groups\s*=\s*(\d+)", "int"),
    "radiation_transport_model": (r"Radiation transport model:\s*([^\n]+)", "string"),
    "laser_wavelength": (rf"Laser wavelength \(microns\)\s*=\s*{_REAL}", "double"),
    "incident_angle_cosine": (rf"Cosine of incident angle\s*=\s*{_REAL}", "double"),
    "propagation_direction": (r"Laser propagates toward\s+(\S+)", "string"),
    "origin_zone_index": (r"Originates in zone index\s*=\s*(\d+)", "int"),
    "max_cycle_count": (r"Max\. cycle count\s*=\s*(\d+)", "int"),
    "max_simulation_time": (rf"Max\. simulation time \(sec\)\s*=\s*{_REAL}", "double"),
    "initial_time_step": (rf"Initial time step \(sec\)\s*=\s*{_REAL}", "double"),
    "min_time_step": (rf"Min\. time step \(sec\)\s*=\s*{_REAL}", "double"),
    "max_time_step": (rf"Max\. time step \(sec\)\s*=\s*{_REAL}", "double"),
}
#: Header tables by label, the pattern of a row, and its columns with their types.
TABLES = {
    "eos": ("Material Equation of State parameters:", r"^\s*(\d+)\s+(\S+)\s+(.+?)\s*$", "index int, eos_model string, file_path string"),
    "opacity": ("Material Opacity parameters:", r"^\s*(\d+)\s+(\S+)\s+(.+?)\s*$", "index int, opacity_model string, file_path string"),
    "regions": ("Spatial Region parameters:", rf"^\s*(\d+)\s+(\d+)\s+(\d+)\s+(-?\d+)\s+{_REAL}\s+{_REAL}\s+{_REAL}\s+{_REAL}\s+{_REAL}\s*$", "region_index int, min_index int, max_index int, material_index int, atomic_weight double, temperature double, mass_density double, ion_density double, velocity double"),
    "laser_power": ("Laser power table:", rf"^\s*(\d+)\s+{_REAL}\s+{_REAL}\s*$", "index int, time double, power double"),
    "zone_masses": ("Zone masses:", rf"^\s*(\d+)\s+{_REAL}\s+{_REAL}\s+{_REAL}\s+{_REAL}\s*$", "index int, radius double, width double, mass double, atomic_weight double"),
    "region_masses": ("Zone masses per spatial region:", rf"^\s*(\d+)\s+{_REAL}\s*$", "region_index int, mass double"),
    "frequency_gridding": ("Frequency gridding parameters:", rf"^\s*(\d+)\s+(\d+)\s+{_REAL}\s+{_REAL}\s*$", "section int, number_of_groups int, min_photon_energy double, max_photon_energy double"),
}
#: Labels that begin or end a header section besides those of the tables.
PHOTON_GRID, STEP_CONTROLS = "Photon energy grid:", "Time step controls (dX/X):"
SOURCES = {"rmin": "Parameters at Rmin:", "rmax": "Parameters at Rmax:"}
STOPS = ("LASER SOURCE PARAMETERS:", "TIME CONTROL PARAMETERS:")
#: Labels of the diagnostics, of the parts of the exchange summary, and of the line with the unit of energy.
DIAGNOSTICS = {"radiation_boundary_fluxes": "Radiation Cooling Rates and Boundary Fluxes", "check": "Energy Conservation Check", "energy_summary": "ENERGY SUMMARY:", "energy_exchange": "ENERGY EXCHANGE SUMMARY:", "energy_balance": "ENERGY BALANCE SUMMARY:"}
EXCHANGES = {"sources_to_plasma": "Energy Sources To Plasma:", "lost_from_grid": "Energy Lost From Grid:", "between_components": "Energy Exchanged Between Components:"}
UNIT = r"Energy Conservation Check -- units are \(([^)]+)\)"
FLUXES = ["region_net_cooling_rate", "region_net_flux_at_boundary", "region_ion_flux_at_boundary", "region_electron_flux_at_boundary"]
#: Footers of runs that ended by themselves and of others.
COMPLETED = r"(?i)#\s*Simulation completed on\s*:\s*(.+)"
ABORTED = r"(?i)#\s*Simulation (?:aborted|terminated|stopped|ended)(?:\s+on|\s+at)?\s*:?\s*(.+)?"


def facts(headers: DataFrame) -> DataFrame:
    """file and the FACTS of its header (file, text), null where it lacks one."""
    found = {n: F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for n, (p, _) in FACTS.items()}
    read = {"double": number_token, "int": lambda c: c.cast("int"), "string": F.trim}
    return headers.select("file", *[read[FACTS[n][1]](c).alias(n) for n, c in found.items()])


def _sections(lines: DataFrame, labels: dict[str, str], keys: list[str], whole: bool = False) -> DataFrame:
    """Lines with the section they stand in; label lines, and lines before the first, are left out. ``whole``: a label is all of its line."""
    text = F.trim("text")
    named = F.coalesce(*[F.when(text == x if whole else F.col("text").contains(x), F.lit(n)) for n, x in labels.items()])
    so_far = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("label", named).withColumn("section", F.last("label", ignorenulls=True).over(so_far)).filter("section is not null")


def _until_blank(lines: DataFrame, is_row: Column, keys: list[str]) -> DataFrame:
    """The rows of each section before the first blank line after one."""
    so_far = Window.partitionBy(*keys, "section").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("is_row", F.coalesce(is_row, F.lit(False))).withColumn("begun", F.max("is_row").over(so_far))
    over = F.max(F.col("begun") & (F.trim("text") == "")).over(so_far)
    return marked.withColumn("over", over).filter("is_row and not over").drop("is_row", "begun", "over")


def header_sections(lines: DataFrame) -> DataFrame:
    """Header lines (file, line, text) with the section they stand in."""
    labels = {n: t[0] for n, t in TABLES.items()} | {"photon_grid": PHOTON_GRID, "step_controls": STEP_CONTROLS} | SOURCES | {f"stop_{i}": x for i, x in enumerate(STOPS)}
    return _sections(lines, labels, ["file"]).filter("label is null").drop("label")


def header_table(lines: DataFrame, name: str) -> DataFrame:
    """The rows of one of TABLES."""
    _, pattern, columns = TABLES[name]
    rows = _until_blank(header_sections(lines).filter(F.col("section") == name), F.col("text").rlike(pattern), ["file"])
    typed = {"double": number_token, "int": lambda c: c.cast("int"), "string": F.trim}
    cells = [typed[t](F.regexp_extract("text", pattern, i + 1)).alias(c) for i, (c, t) in enumerate(x.split() for x in columns.split(", "))]
    return rows.select("file", *cells)


def photon_grid(lines: DataFrame) -> DataFrame:
    """file, pos, energy: the numbers of the photon energy grid."""
    found = header_sections(lines).filter("section = 'photon_grid'").select("file", "line", F.posexplode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("i", "token"))
    pos = F.row_number().over(Window.partitionBy("file").orderBy("line", "i")) - 1
    return found.select("file", pos.alias("pos"), number_token(F.col("token")).alias("energy"))


def materials(lines: DataFrame) -> DataFrame:
    """file, index, eos_model, eos_file_path, opacity_model, opacity_file_path: both tables by index."""
    e = header_table(lines, "eos").withColumnRenamed("file_path", "eos_file_path")
    return e.join(header_table(lines, "opacity").withColumnRenamed("file_path", "opacity_file_path"), ["file", "index"], "full")


def key_values(lines: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """file, section, key, value of the ``key: value`` and ``key = value`` lines of the named sections, or of the whole header (section null)."""
    rows = header_sections(lines).filter(F.col("section").isin(sections)) if sections else lines.withColumn("section", F.lit(None).cast("string"))
    rows = rows.filter(F.col("text").rlike("[:=]") & ~F.trim("text").startswith("Index"))
    at = F.when(F.col("text").contains(":"), F.instr(F.col("text"), ":")).otherwise(F.instr(F.col("text"), "="))
    pairs = rows.select("file", "section", "line", canonical_name(F.substr("text", F.lit(1), at - 1), {}).alias("key"), F.trim(F.substr("text", at + 1)).alias("value"))
    return pairs.groupBy("file", "section", "key").agg(F.max_by("value", "line").alias("value"))


def _diagnostic_name(label: Column) -> Column:
    return canonical_name(F.replace(label, F.lit("->"), F.lit(" to ")), {})


def diagnostics(lines: DataFrame) -> DataFrame:
    """file, block, path, pos, value of every diagnostic of the blocks' lines (file, block, line, text).

    Fluxes of a region have its number less one as ``pos``, single values 0. A name
    that occurs again in its part has the value of its last line.
    """
    keys = ["file", "block"]
    rows = _sections(lines, DIAGNOSTICS, keys).filter("label is null").drop("label")
    tokens = F.transform(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)), number_token)
    pair = r"^\s*(.+?):\s*([0-9.E+-]+)\s+([0-9.E+-]+)\s*$"
    name = _diagnostic_name(F.regexp_extract("text", pair, 1))
    value = lambda i: number_token(F.regexp_extract("text", pair, i))
    entry = lambda path, v, pos=F.lit(0): F.struct(path.alias("path"), pos.cast("int").alias("pos"), v.alias("value"))
    path = lambda *parts: F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    flux = rows.filter("section = 'radiation_boundary_fluxes'").withColumn("t", tokens)
    region = F.regexp_extract("text", NUMBER, 0).rlike(r"^\d+$") & (F.size("t") >= 5)
    single = F.size("t") == 1
    flux = _until_blank(flux, region | single, keys)
    each = F.array(*[entry(path("radiation_boundary_fluxes", n), F.get("t", F.lit(i + 1)), F.get("t", F.lit(0)) - 1) for i, n in enumerate(FLUXES)])
    flux = flux.select(*keys, "line", F.inline(F.when(region, each).otherwise(F.array(entry(path("radiation_boundary_fluxes", "terminal_net_flux_at_boundary"), F.get("t", F.lit(0)))))))

    summary = _until_blank(rows.filter("section = 'energy_summary'"), F.col("text").rlike(pair), keys)
    summary = summary.select(*keys, "line", F.inline(F.array(entry(path("energy_summary", "initial", name), value(2)), entry(path("energy_summary", "current", name), value(3)))))

    exchange = _sections(rows.filter("section = 'energy_exchange'").drop("section"), EXCHANGES, keys, whole=True).filter(F.col("text").rlike(pair))
    exchange = exchange.select(*keys, "line", F.inline(F.array(entry(path("energy_exchange", F.col("section"), name, "total"), value(2)), entry(path("energy_exchange", F.col("section"), name, "last_step"), value(3)))))

    balance = rows.filter("section = 'energy_balance'").withColumn("t", tokens)
    balance = _until_blank(balance, F.col("text").contains("=") & (F.size("t") == 3), keys).withColumn("gaps", F.split("text", NUMBER))
    label = lambda i: _diagnostic_name(F.trim(F.substring_index(F.get("gaps", F.lit(i)), "=", 1)))
    balance = balance.select(*keys, "line", F.inline(F.array(*[entry(path("energy_balance", n, label(i)), F.get("t", F.lit(i))) for i, n in enumerate(("initial", "current", "initial_plus_gains_minus_losses"))])))

    found = flux.unionByName(summary).unionByName(exchange).unionByName(balance)
    return found.groupBy(*keys, "path", "pos").agg(F.max_by("value", "line").alias("value"))


def energy_unit(lines: DataFrame) -> DataFrame:
    """file, unit of the energies in its diagnostics."""
    unit = F.regexp_extract("text", UNIT, 1)
    return lines.filter(unit != "").groupBy("file").agg(F.trim(F.min_by(unit, F.struct("block", "line"))).alias("unit"))


def footer_state(footer: Column) -> Column:
    """State, message and date that a log's last lines tell: state ``unknown`` without any."""
    group = lambda p, i: F.nullif(F.regexp_replace(F.regexp_extract(footer, p, i), r"^\s+|\s+$", ""), F.lit(""))
    message, date = (lambda p: group(p, 0)), (lambda p: group(p, 1))
    done, broken = message(COMPLETED), message(ABORTED)
    states = [("completed", done, date(COMPLETED)), ("aborted", broken, date(ABORTED))]
    out = F.struct(F.lit("unknown").alias("state"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("date"))
    for state, m, d in reversed(states):
        out = F.when(m.isNotNull(), F.struct(F.lit(state).alias("state"), m.alias("message"), d.alias("date"))).otherwise(out)
    return out
