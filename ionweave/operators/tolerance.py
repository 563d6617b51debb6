"""Range joins on mass: relative (ppm) tolerance with a floor, isolation and time windows.

A range predicate alone is planned as a nested loop.  Here the right side gets
one bin of a fixed width, the left side the few bins that its window touches,
so Spark sees an equi-join (hash or sort-merge, split by AQE where a bin is
hot) with a residual range predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PPM = 5.0
MIN_ERROR = 0.002


def tolerance(mz: Column, ppm: float | Column = PPM, min_error: float | Column = MIN_ERROR) -> Column:
    """max(mz * ppm * 1e-6, min_error)."""
    share = ppm * F.lit(1e-6) if isinstance(ppm, Column) else F.lit(ppm * 1e-6)
    return F.greatest(mz * share, min_error if isinstance(min_error, Column) else F.lit(min_error))


def interval_join(left: DataFrame, right: DataFrame, low: Column, high: Column, value: Column, width: float, how: str = "inner", keys: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows of left with the rows of right whose value lies in [low, high], ends included.

    ``width`` is the bin width; at least the usual window length keeps the
    number of bins a left row touches at two.  Null bounds or values match nothing.
    keys: pairs of columns, one of each side, that must be equal besides.
    """
    bins = F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    probes = left.where(low <= high).withColumn("_low", low).withColumn("_high", high).select("*", bins.alias("_bin"))
    keyed = right.withColumn("_value", value).where(F.col("_value").isNotNull()).withColumn("_right_bin", F.floor(F.col("_value") / width))
    on = (F.col("_bin") == F.col("_right_bin")) & F.col("_value").between(F.col("_low"), F.col("_high"))
    for a, b in keys or ():
        on = on & (F.col(a) == F.col(b))
    return probes.join(keyed, on, how).drop("_bin", "_right_bin", "_low", "_high", "_value")


def tolerance_join(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, ppm: float = PPM, min_error: float = MIN_ERROR, width: float = 0.05) -> DataFrame:
    """Inner join where right_mz lies within the tolerance of left_mz."""
    x = F.col(left_mz)
    return interval_join(left, right, x - tolerance(x, ppm, min_error), x + tolerance(x, ppm, min_error), F.col(right_mz), width)


def absolute_join(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, ppm: float = PPM, min_error: float = MIN_ERROR, width: float = 0.05) -> DataFrame:
    """Inner join with a fixed window in Da: |difference| < max(ppm * 1e-6, min_error), strictly."""
    delta = max(ppm * 1e-6, min_error)
    x = F.col(left_mz)
    return interval_join(left, right, x - delta, x + delta, F.col(right_mz), width).where(F.abs(F.col(left_mz) - F.col(right_mz)) < delta)


def overlap(x1: Column, e1: Column, x2: Column, e2: Column) -> Column:
    """Whether [x1 - e1, x1 + e1] and [x2 - e2, x2 + e2] meet."""
    return (x1 + e1 >= x2 - e2) & (x1 - e1 <= x2 + e2)


def in_isolation_window(experiment: Column, selected: Column, precursor: Column, width: Column) -> Column:
    """Whether an MS2 scan with this selected ion belongs to the precursor.

    DDA: within the width on either side; SWATH: within half of it; DIA (all
    ions): always.  Another experiment gives null.
    """
    off = F.abs(selected - precursor)
    return F.when(experiment == "DDA", off <= width).when(experiment == "SWATH", off <= width / 2).when(experiment == "DIA", F.lit(True))


def nearest_scan(scans: DataFrame, key: list[str], order: str, is_anchor: Column, name: str = "nearest") -> DataFrame:
    """Each scan with the order value of the nearest anchor scan of its key; the earlier one on a tie."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order)
    at = F.when(is_anchor, F.col(order))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    scans = scans.withColumns({"_before": before, "_after": after})
    pick = F.when(F.col("_after").isNull() | (F.col(order) - F.col("_before") <= F.col("_after") - F.col(order)), F.col("_before")).otherwise(F.col("_after"))
    return scans.withColumn(name, pick).drop("_before", "_after")
