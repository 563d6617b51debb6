"""Spectra: packed texts, arrays and long rows; chromatograms; uncertainty mass spectra from aligned ions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tolerance import tolerance

ION = "array<struct<mz:double,intensity:double>>"


def _numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))


def unpack(mz: Column, intensity: Column) -> Column:
    """Two space-separated texts as an array of ions."""
    return F.zip_with(_numbers(mz), _numbers(intensity), lambda m, i: F.struct(m.alias("mz"), i.alias("intensity")))


def unpack_zipped(text: Column) -> Column:
    """Alternating "mz intensity mz intensity" as an array of ions."""

    def pairs(x: Column) -> Column:
        even = F.slice(x, 1, F.size(x) - F.size(x) % 2)
        of = lambda k: F.filter(even, lambda _, i: i % 2 == k)
        return F.zip_with(of(0), of(1), lambda m, i: F.struct(m.alias("mz"), i.alias("intensity")))

    return F.transform(F.array(_numbers(text)), pairs)[0]


def pack(ions: Column, field: str) -> Column:
    return F.array_join(F.transform(ions, lambda x: x[field].cast("string")), " ")


def tidy(df: DataFrame, ions: str) -> DataFrame:
    """One row for each ion; rows with a null in any column are left out first."""
    return df.dropna(how="any").select(*[c for c in df.columns if c != ions], F.inline(ions))


def extracted(ions: Column, mass: Column, ppm: float = 5.0, min_error: float = 0.002) -> Column:
    """Summed intensity within the tolerance of a mass, 0 where there is none."""
    low, high = mass - tolerance(mass, ppm, min_error), mass + tolerance(mass, ppm, min_error)
    inside = F.filter(ions, lambda x: x["mz"].between(low, high))
    return F.aggregate(inside, F.lit(0.0), lambda a, x: a + x["intensity"])


def total(ions: Column) -> Column:
    return F.aggregate(ions, F.lit(0.0), lambda a, x: a + x["intensity"])


def base_peak(ions: Column) -> Column:
    """The ion of largest intensity (the first of equals in m/z); null if there is none."""
    return F.when(F.size(ions) > 0, F.element_at(F.array_sort(ions, lambda a, b: F.when(a["intensity"] != b["intensity"], F.signum(b["intensity"] - a["intensity"]).cast("int")).otherwise(F.signum(a["mz"] - b["mz"]).cast("int"))), 1))


def merged_scans(ions: DataFrame, key: list[str], digits: int = 4) -> DataFrame:
    """Ions of all scans of a key, summed by rounded m/z (halves to even)."""
    return ions.groupBy(*key, F.bround("mz", digits).alias("mz")).agg(F.sum("intensity").alias("intensity"))


def zoomed(ions: Column, mass: Column, below: float, above: float, ppm: float = 5.0, min_error: float = 0.002) -> Column:
    """The ions in [mass - below, mass + above], with mean m/z and summed intensity of those within tolerance."""
    window = F.filter(ions, lambda x: x["mz"].between(mass - below, mass + above))
    near = F.filter(window, lambda x: F.abs(x["mz"] - mass) <= tolerance(mass, ppm, min_error))
    mean = F.try_divide(F.aggregate(near, F.lit(0.0), lambda a, x: a + x["mz"]), F.size(near))
    return F.struct(window.alias("ions"), mean.alias("base_ion"), total(near).alias("base_int"))


def uncertainty_spectrum(
    ions: DataFrame, eic: DataFrame | None, key: list[str], correl: float | None = None, height: float | None = None, freq: float | None = None, norm: str = "sum", limits: DataFrame | None = None,
) -> DataFrame:
    """Mean and spread of aligned ions over the scans of a peak.

    ions: key, ion_group, scan, mz, intensity; eic: key, scan, eic, or None where the ions have their scan's eic.  In order:
    ions must correlate with the chromatogram, scans reach ``height`` percent of
    its range, ions occur in ``freq`` percent of the scans left, and each scan is
    divided by the sum or mean of what is left in it.  A null parameter skips
    its step; ``limits`` (key, correl, height, freq) has each key's own.  Returns key, ion_group, mz, mz_u, int, int_u, n, numscans.
    """
    if eic is None:
        rows, eic = ions, ions.select(*key, "scan", "eic").distinct()
    else:
        rows = ions.join(eic, [*key, "scan"])
    group = [*key, "ion_group"]
    if limits is not None:
        return _limited_spectrum(rows, eic, key, norm, limits)
    if correl is not None:
        fits = rows.groupBy(*group).agg(F.corr("eic", "intensity").alias("r")).where(F.col("r").isNotNull() & ~F.isnan("r") & (F.col("r") >= correl))
        rows = rows.join(fits.select(*group), group, "left_semi")
    if height is not None:
        bounds = eic.groupBy(*key).agg(F.min("eic").alias("_low"), F.max("eic").alias("_high"))
        kept = eic.join(bounds, key).where(F.col("eic") >= F.lit(height / 100) * (F.col("_high") - F.col("_low")) + F.col("_low"))
        rows = rows.join(kept.select(*key, "scan"), [*key, "scan"], "left_semi")
    else:
        kept = eic
    scans = kept.groupBy(*key).agg(F.countDistinct("scan").alias("numscans"))
    rows = rows.join(scans, key)
    if freq is not None:
        often = rows.groupBy(*group, "numscans").agg(F.countDistinct("scan").alias("_seen")).where(F.col("_seen") >= F.lit(freq / 100) * F.col("numscans"))
        rows = rows.join(often.select(*group), group, "left_semi")
    return _averaged(rows, key, norm)


def _limited_spectrum(rows: DataFrame, eic: DataFrame, key: list[str], norm: str, limits: DataFrame) -> DataFrame:
    """As uncertainty_spectrum, with thresholds from limits; a key that it lacks has none."""
    group = [*key, "ion_group"]
    limits = limits.select(*key, F.col("correl").alias("_c"), F.col("height").alias("_h"), F.col("freq").alias("_f"))
    fits = rows.groupBy(*group).agg(F.corr("eic", "intensity").alias("r")).join(limits, key, "left")
    fits = fits.where("_c is null or (r is not null and not isnan(r) and r >= _c)")
    rows = rows.join(fits.select(*group), group, "left_semi")
    w = Window.partitionBy(*key)
    kept = eic.withColumns({"_low": F.min("eic").over(w), "_high": F.max("eic").over(w)}).join(limits, key, "left").where("_h is null or eic >= _h / 100 * (_high - _low) + _low")
    rows = rows.join(kept.select(*key, "scan"), [*key, "scan"], "left_semi")
    rows = rows.join(kept.groupBy(*key).agg(F.countDistinct("scan").alias("numscans")), key)
    often = rows.groupBy(*group, "numscans").agg(F.countDistinct("scan").alias("_seen")).join(limits, key, "left").where("_f is null or _seen >= _f / 100 * numscans")
    return _averaged(rows.join(often.select(*group), group, "left_semi"), key, norm)


def _averaged(rows: DataFrame, key: list[str], norm: str) -> DataFrame:
    group = [*key, "ion_group"]
    whole = F.sum("intensity") if norm == "sum" else F.avg("intensity")
    rows = rows.withColumn("_share", F.try_divide(F.col("intensity"), whole.over(Window.partitionBy(*key, "scan"))))
    return rows.groupBy(*group, "numscans").agg(
        F.avg("mz").alias("mz"), F.stddev_samp("mz").alias("mz_u"), F.avg("_share").alias("int"), F.stddev_samp("_share").alias("int_u"), F.count("*").alias("n")
    )
