"""The run grid that the registered queries work on, built from order lines, and the query registry.

A supplier is a run, a quarter a snapshot, sixteen part classes the zones; the
grid grows with the tables. ``GRID`` is the same grid in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = 16
#: Added before rounding, so that values that end in an exact half round alike in both engines.
TIE = 3.3e-9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GRID = """
WITH zone_state AS (
  SELECT l_suppkey AS run_id, CAST((year(l_shipdate) - 1992) * 4 + quarter(l_shipdate) - 1 AS INT) AS snapshot_index,
         CAST(l_partkey % 16 AS INT) + 1 AS zone_id,
         round(avg(l_quantity), 6) AS density, round(avg(l_discount - l_tax) * 1e2, 6) AS velocity,
         round(avg(l_extendedprice) / 1e3 + 3.3e-9, 6) AS pressure, round(5e0 + 5e2 * avg(l_discount), 6) AS temperature_e,
         round(5e0 + 4e2 * avg(l_tax), 6) AS temperature_i, round(1e0 + 1e2 * avg(l_tax), 6) AS mean_charge,
         round(avg(l_quantity), 6) * 1e20 AS electron_density
  FROM lineitem GROUP BY 1, 2, 3),
zones AS (SELECT CAST(z AS INT) AS zone_id, 1 + CAST(floor((z - 1) / 4) AS INT) AS region_id,
                 CAST(CASE WHEN floor((z - 1) / 4) % 2 = 0 THEN 1 ELSE -1 END * (1 + floor((z - 1) / 4)) AS INT) AS material_index,
                 1e0 + z % 3 AS width_cm FROM (SELECT unnest(range(1, 17)) AS z)),
g AS (SELECT s.*, z.region_id, z.material_index, z.width_cm, s.snapshot_index * 1e-1 AS time_s FROM zone_state s JOIN zones z USING (zone_id))
"""


def zone_columns(df: DataFrame) -> DataFrame:
    """Adds region, material and width, which depend on the zone alone."""
    block = F.floor((F.col("zone_id") - 1) / 4).cast("int")
    return df.withColumns({"region_id": block + 1, "material_index": F.when(block % 2 == 0, block + 1).otherwise(-(block + 1)), "width_cm": 1.0 + F.col("zone_id") % 3})


def zone_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    when = F.col("l_shipdate")
    keyed = lines.withColumns({
        "run_id": F.col("l_suppkey"),
        "snapshot_index": ((F.year(when) - 1992) * 4 + F.quarter(when) - 1).cast("int"),
        "zone_id": (F.col("l_partkey") % ZONES).cast("int") + 1,
    })
    # a cell has few lines, so these move once, by snapshot, and windows along the zones need no second shuffle
    keyed = keyed.repartition("run_id", "snapshot_index").groupBy("run_id", "snapshot_index", "zone_id")
    cells = keyed.agg(
        F.round(F.avg("l_quantity"), 6).alias("density"),
        F.round(F.avg(F.col("l_discount") - F.col("l_tax")) * 1e2, 6).alias("velocity"),
        F.round(F.avg("l_extendedprice") / 1e3 + TIE, 6).alias("pressure"),
        F.round(5e0 + 5e2 * F.avg("l_discount"), 6).alias("temperature_e"),
        F.round(5e0 + 4e2 * F.avg("l_tax"), 6).alias("temperature_i"),
        F.round(1e0 + 1e2 * F.avg("l_tax"), 6).alias("mean_charge"),
        (F.round(F.avg("l_quantity"), 6) * 1e20).alias("electron_density"),
    )
    return zone_columns(cells).withColumn("time_s", F.col("snapshot_index") * 1e-1)


def regions(spark: SparkSession) -> DataFrame:
    """The four regions: region_id, min_zone, max_zone, material_index."""
    return spark.range(1, 5).select(F.col("id").cast("int").alias("region_id"), ((F.col("id") - 1) * 4 + 1).cast("int").alias("min_zone"), (F.col("id") * 4).cast("int").alias("max_zone"), F.when(F.col("id") % 2 == 1, F.col("id")).otherwise(-F.col("id")).cast("int").alias("material_index"))


REGIONS_SQL = "r4 AS (SELECT CAST(i AS INT) AS region_id, CAST((i - 1) * 4 + 1 AS INT) AS min_zone, CAST(i * 4 AS INT) AS max_zone, CAST(CASE WHEN i % 2 = 1 THEN i ELSE -i END AS INT) AS material_index FROM (SELECT unnest(range(1, 5)) AS i))"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that two engines' summation orders compare equal."""
    return df.select(*[(F.round(F.col(c) + TIE, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, keys: str = "", doubles: str = "", sql: str = "", grid: bool = True):
    """Registers a query and, where ``sql`` is given, its SQL twin over the grid."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            columns = ", ".join([*keys.split(), *[f"round({d} + 3.3e-9, 6) + 0e0 AS {d}" for d in doubles.split()]])
            head, body = (GRID, sql) if grid else ("WITH ", sql)
            with_, _, last = body.rpartition(";;")
            prefix = head + ("," if grid and with_ else "") + with_
            SQL[name] = f"{prefix if (grid or with_) else ''}\nSELECT {columns} FROM ({last}) AS answer"
        return f

    return register
