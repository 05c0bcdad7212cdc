"""Spatial and temporal window operators over present rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import RS, RZ


def space():
    """Along the zones of a snapshot."""
    return Window.partitionBy(*RS).orderBy("zone_id")


def time():
    """Along the snapshots of a zone."""
    return Window.partitionBy(*RZ).orderBy("snapshot_index")


def smooth121(df: DataFrame, columns: list[str], passes: int = 1, over=None) -> DataFrame:
    """1-2-1 smoothing; the ends of a profile keep their values."""
    over = over or space()
    for _ in range(passes):
        df = df.withColumns({c: F.coalesce(0.25 * F.lag(c).over(over) + 0.5 * F.col(c) + 0.25 * F.lead(c).over(over), F.col(c)) for c in columns})
    return df


def log_step(c: str, floor: float = 1e-30, over=None) -> Column:
    """Change of the logarithm to the next zone."""
    over = over or space()
    x = F.log(F.greatest(F.coalesce(F.col(c), F.lit(floor)), F.lit(floor)))
    return F.lead(x).over(over) - x


def local_maxima(df: DataFrame, c: str, threshold: float, over=None) -> DataFrame:
    """Rows at least as high as both neighbours and the threshold; a plateau keeps all its rows."""
    over = over or space()
    low = F.lit(float("-inf"))
    top = (F.col(c) >= F.coalesce(F.lag(c).over(over), low)) & (F.col(c) >= F.coalesce(F.lead(c).over(over), low))
    return df.withColumn("__top", top & (F.col(c) >= threshold)).filter("__top").drop("__top")


def trapezoid(y: Column, t: str, over=None, clamp: bool = True) -> Column:
    """The trapezoid between a row and the one before; time running backward counts as no time."""
    over = over or time()
    dt = F.col(t) - F.lag(t).over(over)
    return F.coalesce(0.5 * (y + F.lag(y).over(over)) * (F.greatest(dt, F.lit(0.0)) if clamp else dt), F.lit(0.0))


def cumulative_integral(df: DataFrame, y: str, t: str, name: str, keys: list[str], order: str = "snapshot_index") -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.sum(trapezoid(F.col(y), t, over)).over(over.rowsBetween(Window.unboundedPreceding, 0)))


def integral(df: DataFrame, y: str, t: str, keys: list[str]) -> DataFrame:
    """Definite integral over rows with a value; null with fewer than two."""
    over = Window.partitionBy(*keys).orderBy(t)
    rows = df.filter(F.col(y).isNotNull() & F.col(t).isNotNull())
    parts = rows.withColumn("__a", trapezoid(F.col(y), t, over, clamp=False))
    return parts.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.sum("__a")).alias("integral"))


def first_crossing(df: DataFrame, x: str, t: str, threshold: Column, keys: list[str], rising: bool = True, order: str = "snapshot_index") -> DataFrame:
    """First time a series passes a threshold in its direction, by linear interpolation between rows with a value."""
    over = Window.partitionBy(*keys).orderBy(order)
    rows = df.filter(F.col(x).isNotNull() & F.col(t).isNotNull())
    rows = rows.withColumns({"x0": F.lag(x).over(over), "t0": F.lag(t).over(over), "level": threshold})
    passed = (F.col("x0") < F.col("level")) & (F.col("level") <= F.col(x)) if rising else (F.col("x0") > F.col("level")) & (F.col("level") >= F.col(x))
    at = F.col("t0") + (F.col("level") - F.col("x0")) / (F.col(x) - F.col("x0")) * (F.col(t) - F.col("t0"))
    return rows.filter(passed).withColumn("at", at).groupBy(*keys).agg(F.min(order).alias("crossing_snapshot"), F.min_by("at", order).alias("crossing_time"))


def smooth_track(df: DataFrame, c: str, keys: list[str], order: str = "snapshot_index", falling: bool = False) -> DataFrame:
    """1-2-3-2-1 smoothing with repeated ends over rows with a value, ends kept, then made monotone; short tracks unchanged."""
    rows = df.filter(F.col(c).isNotNull())
    by = Window.partitionBy(*keys)
    over = by.orderBy(order)
    first, last = F.first(c).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(c).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = lambda k: F.coalesce(F.lag(c, k).over(over), first) if k > 0 else F.coalesce(F.lead(c, -k).over(over), last)
    mixed = (at(2) + 2.0 * at(1) + 3.0 * F.col(c) + 2.0 * at(-1) + at(-2)) / 9.0
    edge = F.lag(c).over(over).isNull() | F.lead(c).over(over).isNull()
    rows = rows.withColumn("__m", F.when(edge, F.col(c)).otherwise(mixed)).withColumn("__n", F.count("*").over(by))
    up_to = over.rowsBetween(Window.unboundedPreceding, 0)
    monotone = (F.min if falling else F.max)("__m").over(up_to)
    return rows.withColumn("smoothed", F.when(F.col("__n") < 3, F.col(c)).otherwise(monotone)).drop("__m", "__n")


def gradient(f: str, t: str, over) -> Column:
    """Second-order derivative on unequal steps, one-sided at the ends."""
    hs, hd = F.col(t) - F.lag(t).over(over), F.lead(t).over(over) - F.col(t)
    fs, fd, x = F.lag(f).over(over), F.lead(f).over(over), F.col(f)
    inner = (hs * hs * fd + (hd * hd - hs * hs) * x - hd * hd * fs) / (hs * hd * (hd + hs))
    return F.when(hs.isNull(), (fd - x) / hd).when(hd.isNull(), (x - fs) / hs).otherwise(inner)


def since_first(c: str, over=None) -> Column:
    return F.col(c) - F.first(c).over(over or time())


def onset(df: DataFrame, metric: str, threshold: float, keys: list[str], order: str = "snapshot_index") -> DataFrame:
    """First row at which a metric reaches a threshold: its snapshot, time and value."""
    hit = df.filter(F.col(metric) >= threshold)
    return hit.groupBy(*keys).agg(F.min(order).alias("onset_snapshot"), F.min_by("time_s", order).alias("onset_time"), F.min_by(metric, order).alias("onset_value"))


def normalised(df: DataFrame, y: str, x: str, keys: list[str], mode: str = "peak") -> DataFrame:
    """A spectrum divided by its peak, or by the area of its positive part."""
    by = Window.partitionBy(*keys)
    if mode == "peak":
        return df.withColumn("normalised", F.try_divide(F.col(y), F.max(y).over(by)))
    part = trapezoid(F.greatest(F.col(y), F.lit(0.0)), x, by.orderBy(x), clamp=False)
    return df.withColumn("__a", part).withColumn("normalised", F.try_divide(F.col(y), F.sum("__a").over(by))).drop("__a")


def convolve(df: DataFrame, y: str, i: str, keys: list[str], step: float, fwhm: float) -> DataFrame:
    """Gaussian convolution on an even grid: kernel of four sigma, edges repeated."""
    import math

    sigma = fwhm / (2.0 * math.sqrt(2.0 * math.log(2.0)))
    half = max(1, math.ceil(4.0 * sigma / step))
    raw = [math.exp(-0.5 * (k * step / sigma) ** 2) for k in range(-half, half + 1)]
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / sum(raw)).alias("w")) for k, w in zip(range(-half, half + 1), raw)])
    by = Window.partitionBy(*keys)
    ends = df.withColumns({"__lo": F.min(i).over(by), "__hi": F.max(i).over(by)})
    spread = ends.select(*keys, i, y, "__lo", "__hi", F.explode(kernel).alias("__k"))
    # a row serves every place that its offset reaches; places beyond an end repeat the end row
    to = F.col(i) - F.col("__k.k")
    inner = spread.select(*keys, to.alias(i), (F.col(y) * F.col("__k.w")).alias("v"), "__lo", "__hi").filter((F.col(i) >= F.col("__lo")) & (F.col(i) <= F.col("__hi")))
    edge = spread.filter((F.col(i) == F.col("__lo")) | (F.col(i) == F.col("__hi")))
    lows = edge.filter((F.col(i) == F.col("__lo")) & (F.col("__k.k") < 0)).select(*keys, F.explode(F.sequence(F.col("__lo"), F.least(F.col("__hi"), F.col("__lo") - F.col("__k.k") - 1))).alias(i), (F.col(y) * F.col("__k.w")).alias("v"))
    highs = edge.filter((F.col(i) == F.col("__hi")) & (F.col("__k.k") > 0)).select(*keys, F.explode(F.sequence(F.greatest(F.col("__lo"), F.col("__hi") - F.col("__k.k") + 1), F.col("__hi"))).alias(i), (F.col(y) * F.col("__k.w")).alias("v"))
    return inner.select(*keys, i, "v").unionByName(lows).unionByName(highs).groupBy(*keys, i).agg(F.sum("v").alias("convolved"))


def peak(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Peak place and height (first of equals), width at half height by interpolation, and the vertex of a least-squares parabola over three points."""
    by = Window.partitionBy(*keys)
    over = by.orderBy(x)
    rows = df.withColumns({"__top": F.max(y).over(by), "__n": F.row_number().over(over)})
    rows = rows.withColumn("__at", F.min(F.when(F.col(y) == F.col("__top"), F.col("__n"))).over(by))
    below = F.col(y) < F.col("__top") / 2.0
    left, right = F.max(F.when(below & (F.col("__n") < F.col("__at")), F.col("__n"))).over(by), F.min(F.when(below & (F.col("__n") > F.col("__at")), F.col("__n"))).over(by)
    rows = rows.withColumns({"__l": left, "__r": right, "__y1": F.lead(y).over(over), "__x1": F.lead(x).over(over), "__y0": F.lag(y).over(over), "__x0": F.lag(x).over(over)})
    half = F.col("__top") / 2.0
    cut_l = F.col(x) + (half - F.col(y)) / (F.col("__y1") - F.col(y)) * (F.col("__x1") - F.col(x))
    cut_r = F.col("__x0") + (half - F.col("__y0")) / (F.col(y) - F.col("__y0")) * (F.col(x) - F.col("__x0"))
    a = F.col("__y0") - 2.0 * F.col(y) + F.col("__y1")
    vertex = F.col(x) + 0.5 * F.try_divide(F.col("__y0") - F.col("__y1"), a) * (F.col("__x1") - F.col("__x0")) / 2.0
    one = lambda c, w: F.max(F.when(w, c))
    is_top = F.col("__n") == F.col("__at")
    return rows.groupBy(*keys).agg(one(F.col(x), is_top).alias("peak_x"), F.max(y).alias("peak_y"), (one(cut_r, F.col("__n") == F.col("__r")) - one(cut_l, F.col("__n") == F.col("__l"))).alias("fwhm"), one(vertex, is_top).alias("vertex_x"))


def repaired(c: str, over) -> Column:
    """A missing value as the mean of its nearest neighbours that have one, or the only one."""
    back = F.last(c, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(c, ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(F.col(c), (back + ahead) / 2.0, back, ahead)


def islands(df: DataFrame, keys: list[str], order: str, same: Column) -> DataFrame:
    """Numbers the runs of rows in which ``same`` does not change."""
    over = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__v", same).withColumn("island", F.sum(F.when(F.lag("__v").over(over).eqNullSafe(F.col("__v")) & F.lag(order).over(over).isNotNull(), 0).otherwise(1)).over(over)).drop("__v")
