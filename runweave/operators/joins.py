"""Nearest, as-of, interpolating, bracket and ranked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(requests: DataFrame, rows: DataFrame, keys: list[str], request: str, at: str, tie: str) -> DataFrame:
    """For each request the row of its keys nearest to it (ties: the smallest ``tie``).

    Requests and rows are merged in one ordered window, so the work is a sort
    and not a product: the last row at or before and the first row at or after each request are compared.
    """
    left = requests.select(*keys, F.col(request).alias("__x"), F.lit(1).alias("__kind"), F.struct(*requests.columns).alias("__r"), F.lit(None).cast("double").alias("__p"), F.lit(None).cast(rows.schema[tie].dataType).alias("__t"))
    right = rows.groupBy(*keys, F.col(at).alias("__x")).agg(F.min(tie).alias("__t")).select(*keys, "__x", F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["__r"].dataType).alias("__r"), F.col("__x").cast("double").alias("__p"), "__t")
    by = Window.partitionBy(*keys)
    back = by.orderBy("__x", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = by.orderBy(F.desc("__x"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("__p").isNotNull(), F.struct(F.col("__p").alias("p"), F.col("__t").alias("t")))
    both = left.unionByName(right).withColumns({"__b": F.last(hit, ignorenulls=True).over(back), "__a": F.last(hit, ignorenulls=True).over(ahead)}).filter("__kind = 1")
    gap_b, gap_a = F.abs(F.col("__x") - F.col("__b.p")), F.abs(F.col("__a.p") - F.col("__x"))
    use_back = F.col("__a").isNull() | (F.col("__b").isNotNull() & ((gap_b < gap_a) | ((gap_b == gap_a) & (F.col("__b.t") <= F.col("__a.t")))))
    picked = F.when(use_back, F.col("__b")).otherwise(F.col("__a"))
    return both.select("__r.*", picked["t"].alias(tie), F.when(use_back, gap_b).otherwise(gap_a).alias("gap"))


def interpolated(requests: DataFrame, rows: DataFrame, keys: list[str], request: str, x: str, y: str) -> DataFrame:
    """For each request the linear interpolation of y over x, constant beyond the ends; rows without a value do not count."""
    have = rows.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    left = requests.select(*keys, F.col(request).cast("double").alias("__x"), F.lit(1).alias("__kind"), F.struct(*requests.columns).alias("__r"), F.lit(None).cast("double").alias("__y"))
    right = have.select(*keys, F.col(x).cast("double").alias("__x"), F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["__r"].dataType).alias("__r"), F.col(y).cast("double").alias("__y"))
    by = Window.partitionBy(*keys)
    back = by.orderBy("__x", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = by.orderBy(F.desc("__x"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("__kind") == 0, F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    both = left.unionByName(right).withColumns({"b": F.last(point, ignorenulls=True).over(back), "a": F.last(point, ignorenulls=True).over(ahead)}).filter("__kind = 1")
    lerp = F.col("b.y") + F.coalesce(F.try_divide(F.col("__x") - F.col("b.x"), F.col("a.x") - F.col("b.x")), F.lit(0.0)) * (F.col("a.y") - F.col("b.y"))
    return both.select("__r.*", F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull(), F.col("a.y")).otherwise(lerp).alias(f"{y}_at"))


def attenuation(requests: DataFrame, table: DataFrame, *, factor: float = 1.2) -> DataFrame:
    """Log-log interpolated coefficient at each request's energy; extrapolated from the end intervals up to a factor, null beyond.

    ``table``: material, energy_ev, mu. It is small reference data; intervals join on the material and the energy range.
    """
    over = Window.partitionBy("material").orderBy("energy_ev")
    by = Window.partitionBy("material")
    cells = table.withColumns({"e1": F.lead("energy_ev").over(over), "m1": F.lead("mu").over(over), "lo": F.min("energy_ev").over(by), "hi": F.max("energy_ev").over(by)}).filter("e1 is not null")
    low = F.when(F.col("energy_ev") == F.col("lo"), F.col("energy_ev") / factor).otherwise(F.col("energy_ev"))
    high = F.when(F.col("e1") == F.col("hi"), F.col("e1") * factor).otherwise(F.col("e1"))
    cells = cells.select("material", F.col("energy_ev").alias("e0"), F.col("mu").alias("m0"), "e1", "m1", low.alias("from_ev"), high.alias("to_ev"), (F.col("e1") == F.col("hi")).alias("top"))
    r, c = requests.alias("r"), cells.alias("c")
    inside = (F.col("r.material") == F.col("c.material")) & (F.col("r.energy_ev") >= F.col("c.from_ev")) & ((F.col("r.energy_ev") < F.col("c.to_ev")) | (F.col("c.top") & (F.col("r.energy_ev") <= F.col("c.to_ev"))))
    slope = (F.log("c.m1") - F.log("c.m0")) / (F.log("c.e1") - F.log("c.e0"))
    mu = F.exp(F.log("c.m0") + slope * (F.log("r.energy_ev") - F.log("c.e0")))
    kind = F.when((F.col("r.energy_ev") == F.col("c.e0")) | (F.col("r.energy_ev") == F.col("c.e1")), "exact").when(F.col("r.energy_ev").between(F.col("c.e0"), F.col("c.e1")), "interpolated").when(F.col("c.e0").isNotNull(), "extrapolated").otherwise("out_of_range")
    return r.join(c, inside, "left").select("r.*", mu.alias("mu"), kind.alias("kind"))


def first_match(left: DataFrame, right: DataFrame, on: Column, key: list[str], order: list[Column]) -> DataFrame:
    """Left rows with their best right row by the order, if any."""
    joined = left.join(right, on, "left")
    rank = Window.partitionBy(*key).orderBy(*order)
    return joined.withColumn("__k", F.row_number().over(rank)).filter("__k = 1").drop("__k")


def aligned(log: DataFrame, binary: DataFrame, rtol: float = 1e-6, atol: float = 1e-14) -> DataFrame:
    """Runs of two sources with the same zones and snapshots and the same first and last time."""
    def facts(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count_distinct("zone_id").alias(f"{p}_zones"), F.count_distinct("snapshot_index").alias(f"{p}_snapshots"), F.min("time_s").alias(f"{p}_first"), F.max("time_s").alias(f"{p}_last"))

    both = facts(log, "log").join(facts(binary, "bin"), "run_id", "full")
    near = lambda k: F.abs(F.col(f"log_{k}") - F.col(f"bin_{k}")) <= atol + rtol * F.abs(F.col(f"bin_{k}"))
    ok = (F.col("log_zones") == F.col("bin_zones")) & (F.col("log_snapshots") == F.col("bin_snapshots")) & near("first") & near("last")
    return both.withColumn("use_log", F.coalesce(ok, F.lit(False)))
