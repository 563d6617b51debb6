"""Quality-control rules on reported compounds and fragments, as added columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.operators.scoring import compare
from ionweave.operators.tolerance import tolerance

from . import chem


def mass_error(df: DataFrame, measured: str, calculated: str, limit: Column) -> DataFrame:
    """measurederror in ppm of the calculated mass; passes within the limit."""
    error = chem.ppm_error(F.col(measured), F.col(calculated))
    return df.withColumn("measurederror", error).withColumn("mass_ok", F.abs("measurederror") <= limit)


def fragment_accuracy(df: DataFrame, measured: str, calculated: str, ppm: float | Column, min_error: float) -> DataFrame:
    """fragment_error in ppm of the measured mass; passes within ppm, or within min_error Da."""
    error = F.try_divide(1e6 * (F.col(measured) - F.col(calculated)), F.col(measured))
    close = F.abs(F.col(measured) - F.col(calculated)) <= min_error
    return df.withColumn("fragment_error", error).withColumn("fragment_ok", (F.abs("fragment_error") <= ppm) | close)


def fragment_is_part(df: DataFrame, fragment: str, parent: str) -> DataFrame:
    return df.withColumn("part_ok", chem.is_subset(chem.elements(F.col(fragment)), chem.elements(F.col(parent))))


def pattern_match(scores: DataFrame, column: str = "rdp", limit: float = 0.5) -> DataFrame:
    """Whether the reverse match with a simulated isotope pattern reaches the limit; no score fails."""
    return scores.withColumn("pattern_ok", F.coalesce(F.col(column) >= limit, F.lit(False)))


def rollup(df: DataFrame, key: list[str], checks: list[str]) -> DataFrame:
    """For each key, how many of its rows pass each check, and whether all pass all."""
    passes = [F.count_if(F.col(c)).alias(f"n_{c}") for c in checks]
    return df.groupBy(*key).agg(F.count("*").alias("n"), *passes, F.bool_and(_all(checks)).alias("passes"))


def _all(checks: list[str]) -> Column:
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(F.col(c), F.lit(False))
    return out


def gathered(peaks: DataFrame, fragments: DataFrame, ms1: DataFrame, ms2: DataFrame, min_error: float = 0.002, patterns: bool = False, optimal: DataFrame | None = None) -> DataFrame:
    """peak_id, parameter, value and result of the checks of peaks and of their annotated fragments, one row each.

    peaks: peak_id, mz, calculated, formula, msaccuracy; fragments: peak_id,
    fragment_mz, fragment_calculated, fragment_formula; ms1, ms2: (peak_id, mz)
    of the mean spectra.  Checks: the mass error, whether the precursor is among
    the MS1 ions, whether each fragment is among the MS2 ions, its accuracy, and
    whether its formula is part of the peak's.  With ``patterns`` the MS1 ions,
    with their intensities, are held against the formula's isotope pattern, too;
    ``optimal`` (peak_id, mslevel, correl, height, freq) are the parameters found
    for the peaks' spectra, and each level without them fails.
    """
    limits = peaks.select("peak_id", "msaccuracy", "formula")
    own = fragments.join(limits, "peak_id")
    error = mass_error(peaks, "mz", "calculated", F.col("msaccuracy"))
    accuracy = fragment_accuracy(own, "fragment_mz", "fragment_calculated", F.col("msaccuracy"), min_error)
    part = fragment_is_part(own, "fragment_formula", "formula")

    def detected(rows: DataFrame, mass: str, ions: DataFrame) -> DataFrame:
        reach = tolerance(F.col(mass), F.col("msaccuracy"), min_error)
        near = (F.col("peak_id") == F.col("_peak")) & (F.abs(F.col("_mz") - F.col(mass)) <= reach)
        met = rows.select("peak_id", mass, "msaccuracy").distinct().join(ions.select(F.col("peak_id").alias("_peak"), F.col("mz").alias("_mz")), near, "left_semi")
        return rows.join(met.select("peak_id", mass, F.lit(True).alias("_met")), ["peak_id", mass], "left").withColumn("_met", F.coalesce("_met", F.lit(False)))

    none = F.lit(None).cast("double")
    rows = [
        ("measurederror", error, F.col("measurederror"), F.col("mass_ok")),
        ("ms1precursor_detected", detected(peaks, "mz", ms1), none, F.col("_met")),
        ("annfragments_detected", detected(own, "fragment_mz", ms2), F.col("fragment_mz"), F.col("_met")),
        ("annfragments_accuracy", accuracy, F.col("fragment_error"), F.col("fragment_ok")),
        ("annfragments_subset", part, none, F.col("part_ok")),
    ]
    if patterns:
        rows.append(("ms1_isotopepattern", isotope_match(peaks.select("peak_id", "formula"), ms1), F.col("rdp"), F.col("pattern_ok")))
    if optimal is not None:
        levels = peaks.select("peak_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("mslevel"))
        own_levels = optimal.groupBy("peak_id", "mslevel").agg(F.max(F.lit(True)).alias("_found"))
        checked = levels.join(own_levels, ["peak_id", "mslevel"], "left")
        rows.append(("optimized_ums_parameters", checked, F.col("mslevel").cast("double"), F.coalesce("_found", F.lit(False))))
    found = [df.select("peak_id", F.lit(name).alias("parameter"), value.alias("value"), result.alias("result")) for name, df, value, result in rows]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def isotope_match(peaks: DataFrame, ms1: DataFrame, limit: float = 0.5, **settings) -> DataFrame:
    """peak_id, rdp and pattern_ok: mean MS1 ions (peak_id, mz, intensity) against the simulated pattern of each peak's formula (peak_id, formula)."""
    simulated = chem.isotope_patterns(peaks.select(F.col("peak_id").alias("_peak"), "formula"), "formula", **settings).select("_peak", "mz", "intensity")
    pairs = peaks.select("peak_id", F.col("peak_id").alias("_peak"))
    return pattern_match(compare(ms1, simulated, ["peak_id"], ["_peak"], pairs), "rdp", limit).select("peak_id", "rdp", "pattern_ok")
