"""Ingest of run logs: their index, snapshot blocks with both zone tables, zone rows.

A log is a header up to its end marker, then snapshot blocks. A block is a heading
line, a line with cycle, time and step, two tables (a line that starts with ``#``, a
line of units, rows of numbers that end at the first other line) and diagnostics.

Spark cuts logs into line ranges. A task takes apart the blocks that lie wholly in its
range; rows are not shuffled. What may cross a range's ends, its lines before the
first heading and from the last one on, goes into the index, a written table with a row
a range, and is put together by file and block from there, as are header and footer.
Blocks are one row each, their columns arrays over the zones; ``zone_table`` has a row a zone.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_name
from ..session import scratch

#: End of the header, heading of a snapshot block.
HEADER_END = "END OF INPUT PARAMETERS"
MARK = r"^\s*Cycle\s+Time\s+\(s\)"
#: Columns of the zone tables after the zone number. The first table has PRIMARY; the second, known by its
#: first label, SECONDARY_11, or SECONDARY_12 where its labels have the radiation sink.
PRIMARY = ["radius", "zone_width", "density", "velocity", "temperature_radiation", "temperature_i", "temperature_e", "pressure_i", "pressure_e", "pressure_radiation", "compression", "electron_density", "mean_charge", "artificial_viscosity"]
SECONDARY_11 = ["ion_energy", "electron_energy", "ion_heat_capacity", "electron_heat_capacity", "radiation_energy", "kinetic_energy", "radiation_heating", "radiation_cooling", "radiation_net_heating", "laser_source", "laser_deposition"]
SECONDARY_12 = ["ion_energy", "electron_energy", "ion_heat_capacity", "electron_heat_capacity", "radiation_energy", "kinetic_energy", "radiation_heating", "radiation_cooling", "radiation_sink", "radiation_net_heating", "laser_source", "laser_deposition"]
PRIMARY_UNITS = ["cm", "cm", "g/cm3", "cm/s", "eV", "eV", "eV", "J/cm3", "J/cm3", "J/cm3", "rho/rho0", "1/cm3", "", "J/cm3"]
UNITS_11 = ["J/g", "J/g", "J/g/eV", "J/g/eV", "J/g", "J/g", "J/g/s", "J/g/s", "J/g/s", "J/g", "J/g/s"]
UNITS_12 = ["J/g", "J/g", "J/g/eV", "J/g/eV", "J/g", "J/g", "J/g/s", "J/g/s", "J/g/s", "J/g/s", "J/g", "J/g/s"]
PRIMARY_LABEL, SECONDARY_LABEL, SINK_LABEL = "Radius", "Ion energy", "RadSink"
#: Labels of table columns, as lower-case words joined by underscores, and the fields they name.
LABELS = {
    "radius": "radius",
    "zone_width": "zone_width",
    "mass_dens": "density",
    "velocity": "velocity",
    "rad_temp": "temperature_radiation",
    "ion_temp": "temperature_i",
    "elec_temp": "temperature_e",
    "ion_press": "pressure_i",
    "elec_press": "pressure_e",
    "rad_press": "pressure_radiation",
    "compression": "compression",
    "compressio": "compression",
    "elec_dens": "electron_density",
    "n_elec_dens": "electron_density",
    "mean_chg": "mean_charge",
    "art_visc": "artificial_viscosity",
    "art_vis": "artificial_viscosity",
    "ion_energy": "ion_energy",
    "ele_energy": "electron_energy",
    "ionheatcap": "ion_heat_capacity",
    "eleheatcap": "electron_heat_capacity",
    "rad_energy": "radiation_energy",
    "kin_energy": "kinetic_energy",
    "radheating": "radiation_heating",
    "radcooling": "radiation_cooling",
    "radsink": "radiation_sink",
    "radnetheat": "radiation_net_heating",
    "lasersrc": "laser_source",
    "laserdep": "laser_deposition",
}
#: A number, which may lack the letter of its exponent or stand against the next one.
NUMBER = r"[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:E[-+]?\d+|[-+]\d{2,3})?"
#: Characters at the end of a log in which its footer stands.
FOOTER = 20_000
#: Most ranges of files whose first blocks are broadcast; more are joined by a shuffle. Zones of a row batch of blocks.
RANGES, ZONES = 100_000, 20_000

_MARK, _NUMBER, _WHOLE = re.compile(MARK), re.compile(NUMBER), re.compile(rf"(?:{NUMBER})\Z")
_LEAD = frozenset("0123456789+-.")
#: What has no two blanks in it.
_SPACED = re.compile(r"\S+(?:\s\S+)*")
_BARE_EXPONENT = re.compile(r"(?<![A-Za-z])([+-]?(?:\d+\.\d*|\.\d+))([+-]\d{2,3})(?!\d)")
#: The same from the point on, which is found faster, for texts that are read only if they then are numbers throughout.
_BARE_AFTER_POINT = re.compile(r"(\.\d*)([+-]\d{2,3})(?!\d)")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """file, start, text of each line; the lines of a range (file, start) are in order within a task."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Each log whole: file, text. For logs that are small or already columns of a table."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


class _Chunk:
    """Lines of a range from one heading to the next; number 0 is what stands before the first."""

    def __init__(self, file: str, start: int, number: int):
        self.file, self.start, self.number, self.held = file, start, number, []

    def lines(self) -> list[str]:
        return [x for part in self.held for x in part.to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Chunk, bool]]:
    """The chunks of each range in order, and whether a further one of the range follows."""
    now, in_header = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, text = batch.column(0).to_pandas().to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        edges = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (start[1:] != start[:-1])]).tolist()
        for a, b in zip(edges, [*edges[1:], batch.num_rows]):
            if now is None or (file[a], start[a]) != (now.file, now.start):
                if now is not None:
                    yield now, False
                now, in_header = _Chunk(file[a], int(start[a]), 0), start[a] == 0
            part, first = text.slice(a, b - a), 0
            if in_header:  # a heading before the end of the header is none
                ends = np.flatnonzero(pc.match_substring(part, HEADER_END).to_numpy(zero_copy_only=False))
                in_header, first = not len(ends), int(ends[0]) + 1 if len(ends) else b - a
            some = np.flatnonzero(pc.match_substring(part, "Cycle").to_numpy(zero_copy_only=False))
            marks = [i for i in some.tolist() if i >= first and _MARK.match(part[i].as_py())]
            now.held.append(part.slice(0, marks[0] if marks else b - a))
            for lo, hi in zip(marks, [*marks[1:], b - a]):
                yield now, True
                now = _Chunk(now.file, now.start, now.number + 1)
                now.held.append(part.slice(lo, hi - lo))
    if now is not None:
        yield now, False


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head = None
    for chunk, more in _chunks(batches):
        if not chunk.number:
            head = "\n".join(chunk.lines())
        if not more:
            row = {"file": chunk.file, "start": chunk.start, "marks": chunk.number, "head": head, "tail": "\n".join(chunk.lines()) if chunk.number else None}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("marks", pa.int64()), ("head", pa.string()), ("tail", pa.string())]))


def index(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """A written table with a row a range: file, start, marks (headings), before (those of earlier ranges), head and tail.

    ``head`` are the lines before the first heading, ``tail`` those from the last one on. The table goes into ``folder``
    or else the scratch folder.
    """
    rows = read_ranges(spark, path).mapInArrow(_indexer, "file string, start long, marks long, head string, tail string")
    before = F.coalesce(F.sum("marks").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    folder = folder or scratch(spark, "log-index")
    rows.withColumn("before", before).write.parquet(folder)
    return spark.read.parquet(folder)


def _joined(ranges: DataFrame) -> DataFrame:
    """file, block, text: the header (block -1) and the blocks that reach an end of a range, put together from their pieces."""
    piece = lambda part, block, text: F.struct((F.col("before") + block - 1).cast("int").alias("block"), F.struct("start", F.lit(part).alias("part"), F.col(text).alias("text")).alias("p"))
    pieces = ranges.select("file", F.explode(F.array(piece(0, F.lit(0), "head"), piece(1, F.col("marks"), "tail"))).alias("x")).select("file", "x.*").filter("p.text is not null")
    return pieces.groupBy("file", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["text"]), "\n").alias("text"))


def header_text(ranges: DataFrame) -> DataFrame:
    """file, text of each header, its end marker included; a file without the marker has an empty one."""
    return _joined(ranges).filter("block = -1").select("file", F.regexp_extract("text", rf"(?s)^(.*?{HEADER_END}[^\n]*)", 1).alias("text"))


def footer_text(ranges: DataFrame) -> DataFrame:
    """file, footer: the last FOOTER characters from the last heading of each file on."""
    last = _joined(ranges).groupBy("file").agg(F.max_by("text", "block").alias("text"))
    return last.select("file", F.right("text", F.lit(FOOTER)).alias("footer"))


class _Table:
    """One zone table of a block: fields, units, zones (from 1 up) and a row of values for each."""

    def __init__(self, head: str, units: str, lines: list[str]):
        self.boundary, self.padded, self.cut = None, 0, 0
        zone = [int(z) if z.isdigit() or z.lstrip("+-").isdigit() else -1 for z in (x.split(None, 1)[0] for x in lines)]
        if 0 in zone:
            tokens = numbers(lines[zone.index(0)])
            self.boundary = number(tokens[1]) if len(tokens) > 1 else None
        if zone and min(zone) < 1:
            lines = [x for x, z in zip(lines, zone) if z > 0]
        self.fields, self.units = _layout(head, units, lines)
        width = len(self.fields) + 1
        text = "\n".join(lines)
        values = _floats(_BARE_AFTER_POINT.sub(r"\1E\2", text).replace("D", "E").replace("d", "E"))
        if len(values) != width * len(lines):
            values = self._ragged(lines, width)
        rows = values.reshape(-1, width)
        self.zones, self.values = rows[:, 0].astype(np.int64), rows[:, 1:]

    def _ragged(self, lines: list[str], width: int) -> np.ndarray:
        """Row by row: short rows are padded, long ones cut."""
        out = np.full((len(lines), width), np.nan)
        for row, line in zip(out, lines):
            tokens = line.split()
            if len(tokens) != width or not all(_WHOLE.match(t) for t in tokens):
                tokens = numbers(line)
            self.padded += len(tokens) < width
            self.cut += len(tokens) > width
            tokens = tokens[:width]
            row[: len(tokens)] = [number(t) for t in tokens]
        return out.ravel()


def _floats(text: str) -> np.ndarray:
    """The numbers of a text; fewer if some of it is no number."""
    try:
        return pa.array(text.split(), pa.string()).cast(pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # also a sign before a number
        pass
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        try:
            return np.fromstring(text, sep=" ")
        except ValueError:
            return np.empty(0)


def number(token: str) -> float:
    return float(_BARE_EXPONENT.sub(r"\1E\2", token.upper().replace("D", "E")))


def numbers(line: str) -> list[str]:
    return _NUMBER.findall(line.upper().replace("D", "E"))


def _name(label: str) -> str:
    plain = re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_")
    return LABELS.get(plain, plain)


def _layout(head: str, units: str, lines: list[str]) -> tuple[list[str], list[str]]:
    """Fields and units of a table: those of the known layouts, or else the labels of its head, in order or by place.

    Labels with two blanks or more between them are taken in order where there is one for each number of the widest row, as
    the places of numbers vary with their digits. Elsewhere a label is what stands in the head above its number. Likewise units.
    """
    if SECONDARY_LABEL in head:
        return (SECONDARY_12, UNITS_12) if SINK_LABEL in head else (SECONDARY_11, UNITS_11)
    if PRIMARY_LABEL in head or not lines:
        return PRIMARY, PRIMARY_UNITS
    widest = max(lines, key=lambda x: len(x.split())).upper().replace("D", "E")
    starts = [m.start() for m in _NUMBER.finditer(widest)][1:]
    labels, spaced = list(_SPACED.finditer(head))[1:], [m.group() for m in _SPACED.finditer(units)]
    if len(labels) == len(starts):
        starts = [m.start() for m in labels]
    over = lambda text: [text[a:b] for a, b in zip(starts, [*starts[1:], None])]
    plain = lambda texts: [x.strip().strip("#()").strip() for x in texts]
    return [_name(x) for x in plain(over(head))], plain(spaced if len(spaced) == len(starts) else over(units))


class _Block:
    """A snapshot block taken apart; ``problem`` says what it lacks."""

    def __init__(self, lines: list[str]):
        self.problem, self.tables, self.control = None, [], lines[1].strip() if len(lines) > 1 else ""
        facts = numbers(self.control)
        self.cycle, self.time, self.step = (int(number(facts[0])), number(facts[1]), number(facts[2])) if len(facts) > 2 else (None, None, None)
        if self.cycle is None:
            self.problem = "malformed cycle line"
        at = 2
        for which in ("first", "second"):
            at = next((i for i in range(at, len(lines)) if lines[i].lstrip().startswith("#")), len(lines))
            if at + 1 >= len(lines):
                self.problem = self.problem or f"missing the {which} field table"
                break
            head, units, at = lines[at], lines[at + 1], at + 2
            rows = []
            while at < len(lines):
                text = lines[at].strip()
                if text and text[0] in _LEAD:
                    rows.append(lines[at])
                elif rows:
                    break
                at += 1
            self.tables.append(_Table(head, units, rows))
        self.rest = lines[at:]

    def zones(self) -> np.ndarray:
        return np.unique(np.concatenate([t.zones for t in self.tables])) if self.tables else np.empty(0, np.int64)


_BLOCKS = pa.schema(
    [
        ("file", pa.string()),
        ("start", pa.int64()),
        ("number", pa.int64()),
        ("cycle", pa.int64()),
        ("time_s", pa.float64()),
        ("time_step_s", pa.float64()),
        ("control", pa.string()),
        ("boundary_cm", pa.float64()),
        ("problem", pa.string()),
        ("table_zones", pa.list_(pa.list_(pa.int32()))),
        ("padded", pa.list_(pa.int32())),
        ("cut", pa.list_(pa.int32())),
        ("zones", pa.list_(pa.int32())),
        ("fields", pa.map_(pa.string(), pa.list_(pa.float64()))),
        ("units", pa.map_(pa.string(), pa.string())),
        ("rest", pa.list_(pa.string())),
    ]
)
BLOCK_FIELDS = "file string, start long, number long, cycle long, time_s double, time_step_s double, control string, boundary_cm double, problem string, table_zones array<array<int>>, padded array<int>, cut array<int>, zones array<int>, fields map<string, array<double>>, units map<string, string>, rest array<string>"


def _batch(blocks: list[tuple[str, int, int, _Block]]) -> pa.RecordBatch:
    names, units, values, sizes, fields, zones = [], [], [], [], [], []
    rows = [t.zones for _, _, _, b in blocks for t in b.tables]
    for _, _, _, b in blocks:
        own, count = b.zones(), 0
        for t in b.tables:
            columns = np.full((len(own), len(t.fields)), np.nan)
            columns[np.searchsorted(own, t.zones)] = t.values  # of a repeated zone the last row
            values.append(columns.T.ravel())
            sizes += [len(own)] * len(t.fields)
            names += t.fields
            units += t.units
            count += len(t.fields)
        fields.append(count)
        zones.append(own)
    ends = lambda n: pa.array(np.cumsum([0, *n]), pa.int32())
    numbers_ = pa.array(np.concatenate([np.empty(0), *values]), from_pandas=True)
    lists = pa.ListArray.from_arrays(ends(sizes), numbers_)
    of = lambda f: [f(b) for _, _, _, b in blocks]
    columns = [
        pa.array([x[0] for x in blocks], pa.string()),
        *[pa.array([x[i] for x in blocks], pa.int64()) for i in (1, 2)],
        pa.array(of(lambda b: b.cycle), pa.int64()),
        pa.array(of(lambda b: b.time), pa.float64()),
        pa.array(of(lambda b: b.step), pa.float64()),
        pa.array(of(lambda b: b.control), pa.string()),
        pa.array(of(lambda b: b.tables[0].boundary if b.tables else None), pa.float64()),
        pa.array(of(lambda b: b.problem), pa.string()),
        pa.ListArray.from_arrays(ends(of(lambda b: len(b.tables))), pa.ListArray.from_arrays(ends([len(z) for z in rows]), pa.array(np.concatenate([np.empty(0, np.int64), *rows]), pa.int32()))),
        pa.array(of(lambda b: [t.padded for t in b.tables]), pa.list_(pa.int32())),
        pa.array(of(lambda b: [t.cut for t in b.tables]), pa.list_(pa.int32())),
        pa.ListArray.from_arrays(ends([len(z) for z in zones]), pa.array(np.concatenate([np.empty(0, np.int64), *zones]), pa.int32())),
        pa.MapArray.from_arrays(ends(fields), pa.array(names, pa.string()), lists),
        pa.MapArray.from_arrays(ends(fields), pa.array(names, pa.string()), pa.array(units, pa.string())),
        pa.array(of(lambda b: b.rest), pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_BLOCKS)


def _batched(blocks: Iterator[tuple[str, int, int, _Block]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in blocks:
        held.append(x)
        size += sum(len(t.zones) for t in x[3].tables) + 1
        if size >= ZONES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that begin and end within their range."""
    return _batched((c.file, c.start, c.number, _Block(c.lines())) for c, more in _chunks(batches) if c.number and more)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that are a column of text, with their number."""
    return _batched((file, 0, block, _Block(text.splitlines())) for batch in batches for file, block, text in zip(*(c.to_pylist() for c in batch.columns)))


def taken_apart(texts: DataFrame) -> DataFrame:
    """Blocks (file, number, text) taken apart, one row each with their number."""
    return texts.select("file", F.col("number").cast("long"), "text").mapInArrow(_whole, BLOCK_FIELDS).drop("start")


def parsed(texts: DataFrame) -> DataFrame:
    """Blocks (file, block, text) taken apart, one row each."""
    return taken_apart(texts.withColumnRenamed("block", "number")).withColumn("block", F.col("number").cast("int")).drop("number")


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_Block(text.splitlines()) for text in batch.column(2).to_pylist()]
        values = [pa.array([getattr(b, c) for b in found], t) for c, t in (("cycle", pa.int64()), ("time", pa.float64()), ("step", pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], names=["file", "block", "cycle", "time_s", "time_step_s"])


def block_facts(texts: DataFrame) -> DataFrame:
    """file, block, cycle, time_s, time_step_s of blocks (file, block, text) as ``parsed`` has them, from the two lines they stand on."""
    heads = texts.select("file", F.col("block").cast("int"), F.substring_index("text", "\n", 2).alias("text"))
    return heads.mapInArrow(_facts, "file string, block int, cycle long, time_s double, time_step_s double")


def blocks(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """All snapshot blocks of the logs, one row each; ``ranges`` is their ``index``.

    file, block (from 0), cycle, time_s, time_step_s, control (the line they stand on), boundary_cm
    (the first table's zone 0), problem, zones, fields (values over the zones by field), units, rest (the lines
    after the tables), and of each table its zones and how many rows were padded or cut.
    """
    few = ranges.limit(RANGES + 1).count() <= RANGES
    before = ranges.select("file", "start", "before")
    own = read_ranges(spark, path).mapInArrow(_in_range, BLOCK_FIELDS).join(F.broadcast(before) if few else before, ["file", "start"])
    own = own.withColumn("block", (F.col("before") + F.col("number") - 1).cast("int")).drop("start", "number", "before")
    return own.unionByName(parsed(_joined(ranges).filter("block >= 0")))


def block_texts(logs: DataFrame) -> DataFrame:
    """Header (block -1) and snapshot blocks (from 0) of logs that are a column of text."""
    after = F.regexp_extract("text", rf"(?s)^.*?{HEADER_END}[^\n]*\n?(.*)$", 1)
    head = F.regexp_extract("text", rf"(?s)^(.*?{HEADER_END}[^\n]*)", 1)
    parts = F.split(F.concat(F.lit("\n"), after), r"(?m)^(?=[^\S\n]*Cycle\s+Time\s+\(s\))")
    return logs.select("file", F.posexplode(F.transform(parts, lambda p, i: F.when(i == 0, head).otherwise(p))).alias("pos", "text")).select("file", (F.col("pos") - 1).alias("block"), "text")


def lines(parts: DataFrame) -> DataFrame:
    """file, block, line, text of blocks or headers that are columns of text."""
    return parts.select("file", "block", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))


def rest_lines(blocks_: DataFrame) -> DataFrame:
    """file, block, line, text of what stands after the tables."""
    return blocks_.select("file", "block", F.posexplode("rest").alias("line", "text"))


def zone_table(blocks_: DataFrame, fields: list[str] = [*PRIMARY, *SECONDARY_12], n_zones: Column | None = None) -> DataFrame:
    """file, block, zone and the fields, both tables side by side; a zone or field that a table lacks is null. No shuffle."""
    columns = [F.coalesce(F.col("fields")[c], F.array().cast("array<double>")).alias(c) for c in fields]
    rows = blocks_.select("file", "block", *([n_zones.alias("n_zones")] if n_zones is not None else []), F.col("zones").alias("zone"), *columns)
    flat = rows.select("file", "block", *(["n_zones"] if n_zones is not None else []), F.inline(F.arrays_zip("zone", *fields)))
    return flat.filter("zone <= n_zones").drop("n_zones") if n_zones is not None else flat


def total_pressure(zones: DataFrame) -> DataFrame:
    """Adds ``pressure``, the sum of those of ions, electrons and radiation; null without one of them."""
    return zones.withColumn("pressure", F.col("pressure_i") + F.col("pressure_e") + F.col("pressure_radiation"))


def states(blocks_: DataFrame, headers: DataFrame) -> DataFrame:
    """Per block: cycle, time, step, and whether both tables have a whole row for each of the header's zones; ``reason`` if not.

    ``headers``: file, n_zones.
    """
    joined = blocks_.join(headers.select("file", "n_zones"), "file", "left").withColumn("n_zones", F.coalesce("n_zones", F.lit(0)))
    rows = lambda i: F.size(F.filter(F.array_distinct(F.get("table_zones", F.lit(i))), lambda z: z <= F.col("n_zones")))
    lacks = lambda i, name: F.when((rows(i) != F.col("n_zones")) | (F.get("padded", F.lit(i)) > 0), F.concat(F.lit(f"incomplete {name} table: "), rows(i), F.lit(" of "), "n_zones", F.lit(" rows, "), F.get("padded", F.lit(i)), F.lit(" padded")))
    reason = F.coalesce("problem", lacks(0, "first"), lacks(1, "second"))
    return joined.select("file", "block", "cycle", "time_s", "time_step_s", "control", reason.isNull().alias("valid"), reason.alias("reason"))
