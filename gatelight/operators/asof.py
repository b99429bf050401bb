"""As-of alignment: nearest step, interpolation onto another time base, path lookup and distance to cuts.

Both sides are merged into one ordered stream per clip and the neighbours carried along by windows: one shuffle, no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDGE = 1e-6


def neighbours(probes: DataFrame, series: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """``probes`` plus ``before`` and ``after``: structs (at, *values) of the last series row at or before and the first at or after."""
    held = series.select(by, F.col(at), F.struct(at, *values).alias("_s"))
    asked = probes.select(by, F.col(at), F.struct(*probes.columns).alias("_p"))
    both = asked.withColumn("_s", F.lit(None).cast(held.schema["_s"].dataType)).unionByName(held.withColumn("_p", F.lit(None).cast(asked.schema["_p"].dataType)))
    order = Window.partitionBy(by).orderBy(at)
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = order.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("before", F.last("_s", ignorenulls=True).over(upto)).withColumn("after", F.first("_s", ignorenulls=True).over(onward))
    return found.filter(F.col("_p").isNotNull()).select(*[F.col(f"_p.{c}").alias(c) for c in probes.columns], "before", "after")


def nearest(probes: DataFrame, series: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """The series value nearest in time, the earlier one on a tie; null where the clip has no series."""
    both = neighbours(probes, series, by, at, [value])
    back, ahead = F.round(F.col(at) - F.col(f"before.{at}"), 6), F.round(F.col(f"after.{at}") - F.col(at), 6)
    take_after = F.col("before").isNull() | (F.col("after").isNotNull() & (ahead < back))
    return both.withColumn("nearest", F.when(take_after, F.col(f"after.{value}")).otherwise(F.col(f"before.{value}"))).drop("before", "after")


def _lerp(at: str, value: str) -> Column:
    a, b = F.col("before"), F.col("after")
    span = b[at] - a[at]
    return F.when(a.isNull(), b[value]).when(b.isNull() | (span <= 0), a[value]).otherwise(a[value] + (b[value] - a[value]) * (F.col(at) - a[at]) / span)


def interpolate(probes: DataFrame, series: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Linear between neighbours, held at the ends."""
    return neighbours(probes, series, by, at, [value]).withColumn(value, _lerp(at, value)).drop("before", "after")


def path_lookup(probes: DataFrame, path: DataFrame, by: str, at: str, values: list[str], segment: str) -> DataFrame:
    """Interpolated path; across a cut (neighbours of different segments) the incoming point holds."""
    both = neighbours(probes, path, by, at, [*values, segment])
    across = F.col(f"before.{segment}") != F.col(f"after.{segment}")
    return both.withColumns({v: F.when(across, F.col(f"after.{v}")).otherwise(_lerp(at, v)) for v in values}).drop("before", "after")


def cut_distance(steps: DataFrame, cuts: DataFrame, by: str, at: str, none: float = 10.0) -> DataFrame:
    """Time to the nearest cut on either side, ``none`` where the clip has no cut."""
    both = neighbours(steps, cuts, by, at, [])
    away = F.least(F.col(at) - F.col(f"before.{at}"), F.col(f"after.{at}") - F.col(at))
    return both.withColumn("cut_distance", F.coalesce(away, F.lit(none))).drop("before", "after")


def time_slice(steps: DataFrame, at: str, start: float, end: float) -> DataFrame:
    return steps.filter(F.col(at).between(start - EDGE, end + EDGE))
