"""Student-t quantiles, rank correlations and simple slopes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ionweave.operators.keys import accumulated, same


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_share(t: float, df: float) -> float:
    """P(T <= t)."""
    tail = 0.5 * _beta_share(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_share(middle, df) < p else (low, middle)
    return (low + high) / 2


@pandas_udf(T.DoubleType())
def _quantiles(p: pd.Series, df: pd.Series) -> pd.Series:
    known: dict[tuple[float, float], float] = {}
    return pd.Series([known.setdefault((a, b), t_quantile(a, b)) if 0 < a < 1 and b > 0 else None for a, b in zip(p, df, strict=True)], dtype=float)


def same_mean(x1: Column, x2: Column, s1: Column, s2: Column, n1: Column, n2: Column, level: float = 0.95) -> Column:
    """Whether t lies between the quantiles 1 - level and level of Student's distribution with min(n1, n2) degrees of freedom."""
    t = F.abs(x1 - x2) / F.sqrt(F.nullif(s1 * s1 / n1 + s2 * s2 / n2, F.lit(0.0)))
    return t <= _quantiles(F.lit(float(level)), F.least(n1, n2).cast("double"))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, r): correlation of average ranks over rows with both values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        ties = F.count("*").over(Window.partitionBy(*group, c))
        rows = rows.withColumn(f"_{c}", F.rank().over(Window.partitionBy(*group).orderBy(c)) + (ties - 1) / 2)
    return rows.groupBy(*group).agg(F.corr(f"_{x}", f"_{y}").alias("r"))


def kendall(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, r): Kendall's tau-b of each group, a few scans of one ion."""
    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in group) + ", r double"

    def one(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).dropna()
        a, b = pdf[x].to_numpy(), pdf[y].to_numpy()
        up = (a[:, None] > a).astype(int) - (a[:, None] < a)
        right = (b[:, None] > b).astype(int) - (b[:, None] < b)
        free = math.sqrt((up**2).sum() * (right**2).sum())
        yield pd.DataFrame([(*key, (up * right).sum() / free if free else None)], columns=[*group, "r"])

    return df.select(*group, x, y).groupBy(*group).applyInPandas(one, schema)


def slopes(df: DataFrame, group: list[str], order: str, x: str, y: str, reach: int) -> DataFrame:
    """Least-squares slope of y on x over the rows within ``reach`` of each row."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn("slope", F.regr_slope(F.col(y), F.col(x)).over(w))


def without_lockmass(scans: DataFrame, mass: float, width: float, approach: str = "baseion") -> DataFrame:
    """Scans (file, scan, ms_n, function, base_ion, ions) that aren't of the lock mass, with the mean ppm error of those that are.

    A scan is one of the lock mass if its base ion lies within ``width`` Da:
    the reported one (baseion), or the strongest of its ions, for MS1 scans
    (empbaseion).  ms1freq takes all scans of the rarer of the two functions
    that MS1 scans have, hybrid those of the function that most lock scans by
    empbaseion have.  A file without lock scans keeps all, with a null error;
    ms1freq measures none, and files with other than two MS1 functions keep all.
    """
    strongest = F.expr("element_at(array_sort(ions, (a, b) -> case when a.intensity > b.intensity then -1 when a.intensity < b.intensity then 1 else 0 end), 1).mz")
    base = F.col("base_ion") if approach == "baseion" else F.when((F.col("ms_n") == 1) & (F.size("ions") > 0), strongest)
    rows = scans.withColumn("_base", base).withColumn("_near", F.coalesce(F.abs(F.col("_base") - mass) <= width, F.lit(False)))
    if approach in ("ms1freq", "hybrid"):
        ms1 = rows.where("ms_n = 1")
        two = ms1.groupBy("file").agg(F.countDistinct("function").alias("n")).where("n = 2").select("file")
        counts = (ms1 if approach == "ms1freq" else ms1.where("_near")).groupBy("file", "function").agg(F.count("*").alias("n"), F.min("scan").alias("first"))
        order = F.struct("n" if approach == "ms1freq" else -F.col("n"), "first", "function")
        chosen = counts.join(two, "file", "left_semi").groupBy("file").agg(F.min(order)["function"].alias("_lock"))
        rows = rows.join(chosen, "file", "left").withColumn("_gone", F.coalesce(F.col("function") == F.col("_lock"), F.lit(False))).drop("_lock")
    else:
        rows = rows.withColumn("_gone", F.col("_near"))
    measured = F.lit(None).cast("double") if approach == "ms1freq" else F.lit(1e6) * (F.avg(F.when(F.col("_gone"), F.col("_base"))).over(Window.partitionBy("file")) - mass) / mass
    return rows.withColumn("lockmass_error", measured).where("not _gone").drop("_base", "_near", "_gone")


def peak_bounds(trace: DataFrame, key: list[str], order: str, value: str, slope: float, reach: int = 1) -> DataFrame:
    """(key, left, right): how far the trace falls on both sides of its apex.

    From the apex outwards, the side ends at the first place from which the
    least-squares slope over ``reach`` further points no longer falls by
    ``slope`` a point; the apex is the first of equal maxima.
    """
    w = Window.partitionBy(*key).orderBy(order)
    every = Window.partitionBy(*key)
    rows = trace.withColumn("_k", F.row_number().over(w))
    apex = F.min(F.when(F.col(value) == F.col("_top"), F.col("_k"))).over(every)
    rows = rows.withColumn("_top", F.max(value).over(every)).withColumn("_apex", apex)
    rows = rows.withColumn("_last", F.max("_k").over(every))
    after = F.regr_slope(F.col(value), F.col("_k").cast("double")).over(w.rowsBetween(0, reach))
    before = F.regr_slope(F.col(value), -F.col("_k").cast("double")).over(w.rowsBetween(-reach, 0))
    rows = rows.withColumn("_flat_right", F.coalesce(after > -slope, F.lit(True))).withColumn("_flat_left", F.coalesce(before > -slope, F.lit(True)))
    right = F.min(F.when((F.col("_k") >= F.col("_apex")) & F.col("_flat_right"), F.col("_k")))
    left = F.max(F.when((F.col("_k") <= F.col("_apex")) & F.col("_flat_left"), F.col("_k")))
    return rows.groupBy(*key).agg(F.coalesce(left, F.lit(1)).alias("left"), F.coalesce(right, F.max("_last")).alias("right"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """by and quantiles (an array, one for each share) of a number, between the two nearest ranks; nulls are left out.

    Exact, and no group meets in one task: distinct values are counted, their
    counts accumulated range by range, and only values at wanted ranks kept.  A
    group without values has no row; a null group counts as a group.
    """
    given = [F.col(c) for c in by] or [F.lit(0)]
    groups = [f"_g{k}" for k in range(len(given))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*[c.alias(g) for c, g in zip(given, groups, strict=True)], F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    ends = accumulated(counts, [*groups, "_value"], "_n", "_end")
    sizes = ends.groupBy(*[F.col(g).alias(f"_of{g}") for g in groups]).agg(F.sum("_n").alias("_size"), F.min(F.col("_end") - F.col("_n")).alias("_base"))
    rows = ends.join(sizes, same("", "_of", groups))
    first, last = F.col("_end") - F.col("_n") - F.col("_base"), F.col("_end") - F.col("_base") - 1
    at = [F.lit(float(p)) * (F.col("_size") - 1) for p in shares]
    ranks = [(F.floor(h), F.ceil(h)) for h in at]
    hit = F.lit(False)
    for pair in ranks:
        for r in pair:
            hit |= r.between(first, last)
    found = rows.where(hit).groupBy(*groups, "_size").agg(*[F.max(F.when(r.between(first, last), F.col("_value"))).alias(f"_{side}{k}") for k, pair in enumerate(ranks) for side, r in zip(("lo", "hi"), pair, strict=True)])
    between = [F.col(f"_lo{k}") + (at[k] - F.floor(at[k])) * (F.col(f"_hi{k}") - F.col(f"_lo{k}")) for k in range(len(shares))]
    return found.select(*[F.col(g).alias(c) for c, g in zip(by, groups, strict=False)], F.array(*between).alias("quantiles"))
