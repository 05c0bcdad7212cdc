"""Exact quantiles of groups of any size in bounded memory.

A group's wanted rank is closed in on: a sketch of its values gives cuts, exact counts
below and at a few cuts about the rank tell which it lies at or between, and only what
is strictly between two cuts is looked at again. A pass leaves some twentieth of the rows, and
what a buffer holds is a sketch or at most ``held`` values, whatever the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Values of a group that are sorted in one buffer; cuts of a sketch and its accuracy.
HELD, CUTS, ACCURACY = 20_000, 64, 1000


def _inside(v: Column) -> Column:
    """Strictly between the bounds found so far; a null bound is none."""
    return F.coalesce(v > F.col("lo"), F.lit(True)) & F.coalesce(v < F.col("hi"), F.lit(True))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, q: float, *, name: str = "quantile", held: int = HELD) -> DataFrame:
    """``keys`` and the ``q`` quantile of their values, between two values in proportion; groups without values are left out.

    Null and NaN values do not count. Each round is a pass over the rows of groups that
    are still open and a written table of a row a group.
    """
    v = F.col("__v")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(v.isNotNull() & ~F.isnan(v))
    none = F.lit(None).cast("double")
    state = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    state = state.select(*keys, F.floor((F.col("n") - 1) * F.lit(q)).alias("k"), ((F.col("n") - 1) * F.lit(q)).alias("at"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("found"))
    state = written(state, "quantiles")
    while state.filter(F.col("found").isNull() & (F.col("inside") > held)).take(1):
        open_ = F.col("found").isNull() & (F.col("inside") > held)
        near = rows.join(state.filter(open_), keys).filter(_inside(v))
        cuts = near.groupBy(*keys).agg(F.percentile_approx("__v", [i / CUTS for i in range(CUTS + 1)], ACCURACY).alias("cuts"))
        place = F.floor((F.col("k") - F.col("below")) / F.col("inside") * CUTS).cast("int")  # of the cut below the rank, as far as a sketch tells
        c = [F.get("cuts", F.least(F.greatest(place + j, F.lit(0)), F.lit(CUTS))).alias(f"c{j + 1}") for j in (-1, 0, 1, 2)]
        asked = state.filter(open_).join(cuts, keys).select(*state.columns, *c)
        counts = rows.join(asked, keys).filter(_inside(v)).groupBy(*keys).agg(*[F.count_if(v < F.col(f"c{j}")).alias(f"lt{j}") for j in range(4)], *[F.count_if(v <= F.col(f"c{j}")).alias(f"le{j}") for j in range(4)])
        rank = F.col("k") - F.col("below")
        known = asked.join(counts, keys)
        found = F.coalesce(*[F.when((F.col(f"lt{j}") <= rank) & (rank < F.col(f"le{j}")), F.col(f"c{j}")) for j in range(4)])
        passed = [F.col(f"le{j}") <= rank for j in range(4)]  # the cut is under the rank
        lo, below, used = F.col("lo"), F.lit(0).cast("long"), F.lit(0).cast("long")
        for j in range(4):
            lo, below = F.when(passed[j], F.col(f"c{j}")).otherwise(lo), F.when(passed[j], F.col(f"le{j}")).otherwise(below)
        hi, upto = F.col("hi"), F.col("inside")
        for j in reversed(range(4)):
            over = F.col(f"lt{j}") > rank
            hi, upto = F.when(over, F.col(f"c{j}")).otherwise(hi), F.when(over, F.col(f"lt{j}")).otherwise(upto)
        known = known.select(*keys, "k", "at", lo.alias("lo"), hi.alias("hi"), (F.col("below") + below).alias("below"), (upto - below).alias("inside"), found.alias("found"))
        state = written(state.filter(~open_).unionByName(known), "quantiles")
    sorted_ = rows.join(state.filter("found is null"), keys).filter(_inside(v)).groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("values"), F.first(F.col("k") - F.col("below")).alias("r"))  # at most ``held`` values
    low = state.join(sorted_, keys, "left").select(*keys, "k", "at", F.coalesce("found", F.get("values", F.col("r").cast("int"))).alias("low"))
    low = written(low, "quantiles")
    after = rows.join(low, keys).groupBy(*keys, "k", "at", "low").agg(F.count_if(v <= F.col("low")).alias("le"), F.min(F.when(v > F.col("low"), v)).alias("next"))
    high = F.when(F.col("le") > F.col("k") + 1, F.col("low")).otherwise(F.coalesce("next", "low"))
    part = F.col("at") - F.col("k")
    return after.select(*keys, F.when((part == 0) | (high == F.col("low")), F.col("low")).otherwise(F.col("low") + (high - F.col("low")) * part).alias(name))
