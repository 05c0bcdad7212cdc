"""Length-framed binary run files as a Spark data source.

A file is two date records, then for each snapshot one header vector, ``fixed - 1``
record vectors and two records per zone; each record is a 4-byte length, the payload, the length again. Record widths are
fixed within a file. Files are cut into ranges of bytes; where these are many, a task has some
of together TASK bytes, so that small files share one. It finds the layout from a
file's first snapshot and reads the snapshots that begin in its ranges, of these only the
records that are asked for. The driver lists files and opens none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Slots of the header vector.
HEADER = 30
TIME, CYCLE, NODES = 1, 2, 4
SCHEMA = "file string, snapshot_index int, cycle long, time_s double, record int, name string, values array<double>"


def opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def framed(file, at: int) -> tuple[bytes, int]:
    """Payload at an offset and the offset after it."""
    file.seek(at)
    (n,) = struct.unpack("<i", file.read(4))
    payload = file.read(n)
    if struct.unpack("<i", file.read(4)) != (n,):
        raise ValueError(f"damaged record at {at}")
    return payload, at + n + 8


#: Bytes of a range of a file; ranges up to which each is a task; bytes of a task if there are more, to which each file it
#: opens adds OPEN; values of a batch of records.
RANGE, FEW, TASK, OPEN, VALUES = 64 << 20, 64, 8 << 20, 64 << 10, 1 << 20
#: Bytes up to which the distance of two records is read over instead of sought.
NEAR = 64 << 10


class Ranges(InputPartition):
    """What a task reads: path, start and end of pieces of files."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


def dealt(ranges: Iterable[tuple[str, int, int]], task: int = TASK, opening: int = OPEN) -> list[Ranges]:
    """Ranges in the order of files and places, if they are many as many to a task as have ``task`` bytes; those of a task that adjoin are one piece."""
    ranges = list(ranges)
    if len(ranges) <= FEW:
        return [Ranges([r]) for r in ranges]
    out, held, size = [], [], 0
    for path, a, b in ranges:
        adjoins = bool(held) and held[-1][0] == path and held[-1][2] == a
        cost = b - a + (0 if adjoins else opening)
        if held and size + cost > task:
            out.append(Ranges(held))
            held, size, adjoins, cost = [], 0, False, b - a + opening
        held[-1:] = [(path, held[-1][1], b)] if adjoins else [*held[-1:], (path, a, b)]
        size += cost
    return [*out, Ranges(held)] if held else out


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Files and sizes: of a folder those with the suffix, or else the file itself."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    prefix = path[: -len(name)] if path.endswith(name) and "://" in path else ""
    info = store.get_file_info(name)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and (x.path == info.path or x.path.endswith(suffix)))


class Layout:
    """Where the records of a file are: ``first`` snapshot, bytes of one, offsets within it; a partial last snapshot is left out."""

    def __init__(self, file, fixed: int):
        self.first = framed(file, framed(file, 0)[1])[1]
        self.whole, self.offsets = 0, []
        if self.first >= file.size():
            return
        payload, at = framed(file, self.first)
        zones = int(np.frombuffer(payload, "<f8", HEADER)[NODES]) - 1
        self.offsets = [0]
        for _ in range(fixed - 1 + 2 * zones):
            self.offsets.append(at - self.first)
            file.seek(at)
            at += struct.unpack("<i", file.read(4))[0] + 8
        self.size = at - self.first
        self.whole = (file.size() - self.first) // self.size


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.suffix = options.get("suffix", ".bpf")
        self.names = options.get("names", "").split(",")
        self.range = int(options.get("range", RANGE))
        self.fixed = int(options.get("fixed", 69))
        self.asked: set[str] | None = None
        self.numbers: set[int] | None = None
        if options.get("fields"):
            self.asked = set(options["fields"].split(","))

    def partitions(self) -> list[Ranges]:
        return dealt((path, a, min(a + self.range, size)) for p in self.paths for path, size in listed(p, self.suffix) for a in range(0, size, self.range))

    def _name(self, record: int) -> str:
        return self.names[record] if record < len(self.names) and self.names[record] else f"record_{record}"

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path, a, b in partition.pieces:
            for row in self._records(path, a, b):
                held.append(row)
                size += len(row[-1])
                if size >= VALUES:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def _records(self, path: str, a: int, b: int) -> Iterator[tuple]:
        """The records that are asked for of the snapshots that begin from ``a`` up to ``b``."""
        with opened(path) as file:
            at = Layout(file, self.fixed)
            records = [(i, self._name(i), o) for i, o in enumerate(at.offsets)]
            records = [r for r in records if (self.asked is None or r[1] in self.asked) and (self.numbers is None or r[0] in self.numbers)]
            if not records or not at.whole:
                return
            first, end = max(0, -((at.first - a) // at.size)), min(at.whole, -((at.first - b) // at.size))
            step = max(1, RANGE // at.size) if at.size <= NEAR * len(records) else 1
            for k0 in range(first, end, step):
                start, own = at.first + k0 * at.size, file
                if at.size <= NEAR * len(records):  # small snapshots are read whole, some at a time
                    own, start = pa.BufferReader(file.read_at((min(k0 + step, end) - k0) * at.size, start)), 0
                for k in range(k0, min(k0 + step, end)):
                    here = start + (k - k0) * at.size
                    header = np.frombuffer(framed(own, here)[0], "<f8")
                    for record, name, offset in records:
                        values = np.frombuffer(framed(own, here + offset)[0], "<f8") if record else header
                        yield path, k, int(header[CYCLE]), float(header[TIME]), record, name, values

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        column = lambda i, t: pa.array([r[i] for r in rows], t)
        ends = pa.array(np.cumsum([0, *[len(r[6]) for r in rows]]), pa.int32())
        values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[6] for r in rows])))
        arrays = [column(0, pa.string()), column(1, pa.int32()), column(2, pa.int64()), column(3, pa.float64()), column(4, pa.int32()), column(5, pa.string()), values]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "snapshot_index", "cycle", "time_s", "record", "name", "values"])


class FilteredReader(Reader):
    """A reader that takes filters, which the session must allow."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality with names or numbers of records decides what is read."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("name",):
                self.asked = values if self.asked is None else self.asked & values
            elif values is not None and f.attribute == ("record",):
                self.numbers = values if self.numbers is None else self.numbers & values
            else:
                yield f


class RunFiles(DataSource):
    """``spark.read.format("run_records")``: options path (files or folders, comma-separated), suffix, names, fields (names that are read), range (bytes of a range), fixed."""

    @classmethod
    def name(cls) -> str:
        return "run_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else Reader)(self.options)


def read_runs(spark: SparkSession, path: str, names: list[str], fields: list[str] | None = None, **options) -> DataFrame:
    """The records of run files; ``names`` are those of the first records of a snapshot, ``fields`` those that are read (all).

    Where ``spark.sql.python.filterPushdown.enabled`` is on, filters on name and record do the same.
    """
    spark.dataSource.register(RunFiles)
    reader = spark.read.format("run_records").option("path", path).option("names", ",".join(names)).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).options(**{k: str(v) for k, v in options.items()})
    return (reader.option("fields", ",".join(fields)) if fields else reader).load()


def zone_fields(records: DataFrame, fields: list[str], keep: list[str] = []) -> DataFrame:
    """Named zone vectors as rows: file, snapshot_index, time_s, ``keep``, zone_id and a column per field."""
    keys = ["file", "snapshot_index", "time_s", *keep]
    rows = records.filter(F.col("name").isin(fields)).select(*keys, "name", F.posexplode("values").alias("k", "value"))
    if len(fields) == 1:  # no rows to bring together
        return rows.select(*keys, (F.col("k") + 1).alias("zone_id"), F.col("value").alias(fields[0]))
    return rows.groupBy(*keys, (F.col("k") + 1).alias("zone_id")).pivot("name", fields).agg(F.first("value"))


def ion_fractions(records: DataFrame, fixed: int = 69) -> DataFrame:
    """The charge fractions of each zone: the first of its two records."""
    k = F.col("record") - fixed
    return records.filter((k >= 0) & (k % 2 == 0)).select("file", "snapshot_index", (k / 2 + 1).cast("int").alias("zone_id"), F.col("values").alias("fractions"))


def derived(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """Centres, widths, mean and outer velocity from adjacent nodes, total pressure, net heating, radiation energy per mass.

    ``nodes``: run_id, snapshot_index, node_id, position_cm, interface_velocity; ``zones`` on
    run_id, snapshot_index, zone_id (zone k lies between nodes k - 1 and k).
    """
    from pyspark.sql import Window

    over = Window.partitionBy("run_id", "snapshot_index").orderBy("node_id")
    nxt = lambda c: F.lead(c).over(over)
    x, v = F.col("position_cm"), F.col("interface_velocity")
    per_zone = nodes.select("run_id", "snapshot_index", (F.col("node_id") + 1).alias("zone_id"), ((x + nxt("position_cm")) / 2.0).alias("center_cm"), (nxt("position_cm") - x).alias("width"), ((v + nxt("interface_velocity")) / 2.0).alias("mean_velocity"), nxt("interface_velocity").alias("outer_velocity")).filter("width is not null")
    out = zones.join(per_zone, ["run_id", "snapshot_index", "zone_id"])
    return out.withColumns({"pressure_sum": F.col("pressure_i") + F.col("pressure_e"), "net_heating": F.col("heating") - F.col("cooling"), "radiation_pressure": F.col("radiation_density") / 3.0, "radiation_energy": F.try_divide("radiation_density", "density")})
