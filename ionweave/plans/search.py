"""Searches as one lazy plan: compounds by precursor and spectrum, fragments by mass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.operators.align import optimal_parameters
from ionweave.operators.keys import dealt, staged, tasks_for
from ionweave.operators.scoring import check_fragments, compare
from ionweave.operators.spectra import uncertainty_spectrum
from ionweave.operators.tolerance import in_isolation_window, interval_join, tolerance, tolerance_join
from ionweave.plans.peak_tables import peak_table


def candidates(peaks: DataFrame, precursor: float, ppm: float = 5.0, min_error: float = 0.002) -> DataFrame:
    """Peaks whose precursor_mz lies within the tolerance of the wanted one."""
    tol = max(precursor * ppm * 1e-6, min_error)
    return peaks.where(F.col("precursor_mz").between(precursor - tol, precursor + tol))


def peak_parameters(parameters: DataFrame) -> DataFrame:
    """opt_ums_params rows with nulls in place of -1, which stands for an unset value."""
    return parameters.select(*[F.when(F.col(c) != -1, F.col(c)).alias(c) if c not in ("peak_id", "mslevel") else F.col(c) for c in parameters.columns])


def library_spectra(scans: DataFrame, peaks: DataFrame, level: int, parameters: DataFrame | None = None, ppm: float = 5.0, min_error: float = 0.002, optimized: bool = True) -> DataFrame:
    """Uncertainty spectra (peak_id, mz, mz_u, int, int_u, n, numscans) of the peaks' scans (peak_id, ms_n, scantime, ions) at a level.

    The chromatogram is that of the precursor in MS1 scans; an MS2 scan takes
    the value of the nearest MS1 scan; alignment starts as peak_table says.
    parameters: opt_ums_params, by peak and
    level; a peak's tolerances are those of its MS2 row, at both levels; where
    -1 or no row is given, a step is skipped and ppm and min_error hold.
    """
    rows = scans.join(peaks.select("peak_id", "precursor_mz"), "peak_id")
    own = {"ppm": F.lit(ppm), "min_error": F.lit(min_error)}
    if parameters is not None:
        p = peak_parameters(parameters)
        errors = p.where("mslevel = 2").groupBy("peak_id").agg(F.min("masserror").alias("_ppm"), F.min("minerror").alias("_min"))
        rows = rows.join(errors, "peak_id", "left")
        own = {"ppm": F.coalesce("_ppm", F.lit(ppm)), "min_error": F.coalesce("_min", F.lit(min_error))}
    rows = rows.withColumns(own)
    groups = staged(peak_table(rows, level, ppm, min_error), "aligned")  # alignment is the costly step, and is read several times
    # dealt out by peak, so that its sums and what follows need no other shuffle
    groups = dealt(groups.repartition("peak_id"), tasks_for(groups), "peak_id")
    limits = None
    if parameters is not None and optimized:
        limits = p.where(F.col("mslevel") == level).groupBy("peak_id").agg(F.min("correl").alias("correl"), F.min("ph").alias("height"), F.min("freq").alias("freq"))
    return uncertainty_spectrum(groups, None, ["peak_id"], limits=limits)


def query_spectrum(table: DataFrame, key: list[str], correl: float | None = 0.75, height: float | None = 10.0, freq: float | None = 10.0) -> DataFrame:
    """Uncertainty spectra of aligned peak tables (key, scan, ion_group, mz, intensity, eic) by these parameters.

    A key that they leave without ions takes its optimal parameters instead.
    """
    eic = table.select(*key, "scan", "eic").distinct()
    first = uncertainty_spectrum(table.drop("eic"), eic, key, correl, height, freq)
    lost = table.select(*key).distinct().join(first.select(*key).distinct(), key, "left_anti")
    others = table.join(lost, key, "left_semi")
    limits = optimal_parameters(others, key).select(*key, "correl", "height", "freq")
    again = uncertainty_spectrum(others.drop("eic"), others.select(*key, "scan", "eic").distinct(), key, limits=limits)
    return first.unionByName(again)


def search_spectra(query: DataFrame, library: DataFrame, peaks: DataFrame, **settings) -> DataFrame:
    """Match scores of one query spectrum (mz, int) with the library spectra (peak_id, mz, int) of the peaks, best first; no score comes last."""
    q = query.select(F.lit(0).alias("query"), "mz", F.col("int").alias("intensity"))
    lib = library.select("peak_id", "mz", F.col("int").alias("intensity"))
    pairs = peaks.select(F.lit(0).alias("query"), "peak_id").distinct()
    return compare(q, lib, ["query"], ["peak_id"], pairs, few=True, **settings).drop("query").orderBy((F.col("dp") + F.col("rdp")).desc_nulls_last(), "peak_id")


def search_compound(
    query1: DataFrame, query2: DataFrame, peaks: DataFrame, scans: DataFrame, fragments: DataFrame | None = None, precursor: float | None = None,
    ppm: float = 5.0, min_error: float = 0.002, parameters: DataFrame | None = None, optimized: bool = True,
) -> DataFrame:
    """Scores of a query's MS1 and MS2 spectra with all peaks (or those near a precursor), with checked fragments, best first.

    ppm and min_error choose the peaks and check fragments, which are those
    (peak_id, fixedmass) among the query's MS2 ions; scores use 5 ppm and 0.002.
    parameters: opt_ums_params of the library, of which the thresholds are used
    if ``optimized``.
    """
    near = peaks if precursor is None else candidates(peaks, precursor, ppm, min_error)
    # the peaks and their scans are found once, for both levels, all scores and the fragments
    near = staged(near.select("peak_id", "precursor_mz"), "near")
    scans = staged(scans.join(near.select("peak_id"), "peak_id", "left_semi"), "scans")
    out = near.select("peak_id")
    for level, query in ((1, query1), (2, query2)):
        spectra = library_spectra(scans, near, level, parameters, optimized=optimized)
        found = search_spectra(query, spectra, near).withColumnsRenamed({"dp": f"ms{level}_dp", "rdp": f"ms{level}_rdp"})
        out = out.join(found, "peak_id", "left")
        if level == 2 and fragments is not None:
            checked = check_fragments(fragments.join(near.select("peak_id"), "peak_id", "left_semi"), query2, None, ppm=ppm, min_error=min_error)
            out = out.join(checked.groupBy("peak_id").agg(F.count_if("matched").alias("fragments_matched"), F.count("*").alias("fragments")), "peak_id", "left")
    scores = ["ms1_dp", "ms1_rdp", "ms2_dp", "ms2_rdp"]
    total = sum((F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(0.0)) for c in scores), F.lit(0.0))
    return out.withColumn("sum_match", total).orderBy(F.col("sum_match").desc(), "peak_id")


def peak_context(near: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """peak_id with its sample class, compound (the one with the smallest id) and reported accuracy, for peaks (peak_id)."""
    peaks = frames["peaks"].select(F.col("id").alias("peak_id"), "sample_id").join(near.select("peak_id"), "peak_id", "left_semi")
    classes = frames["samples"].select(F.col("id").alias("sample_id"), "sample_class_id").join(frames["norm_sample_classes"].select(F.col("id").alias("sample_class_id"), F.col("name").alias("sample_class")), "sample_class_id", "left")
    links = frames["compound_fragments"].join(frames["compounds"].select(F.col("id").alias("compound_id"), F.col("name").alias("compound")), "compound_id")
    compounds = links.groupBy("peak_id").agg(F.min(F.struct("compound_id", "compound")).alias("x")).select("peak_id", "x.compound_id", "x.compound")
    errors = frames["qc_data"].where("name = 'msaccuracy'").groupBy("peak_id").agg(F.min(F.col("value").try_cast("double")).alias("msaccuracy"))
    out = peaks.join(classes.select("sample_id", "sample_class"), "sample_id", "left").join(compounds, "peak_id", "left").join(errors, "peak_id", "left")
    return out.select("peak_id", "sample_class", "compound_id", "compound", "msaccuracy")


def search_fragments(ions: DataFrame, fragments: DataFrame, links: DataFrame, ppm: float = 5.0, min_error: float = 0.002) -> DataFrame:
    """For each ion (mz), the annotated fragments within tolerance, their compounds and peaks, and whether structures are known.

    fragments: fragment_id, fixedmass, formula, smiles; links: fragment_id, peak_id, compound_id.
    Links are gathered once for each fragment, however many ions find it.
    """
    found = tolerance_join(ions.select("mz"), fragments.select("fragment_id", "fixedmass", "formula", "smiles"), "mz", "fixedmass", ppm, min_error).distinct()
    sides = links.groupBy("fragment_id").agg(
        F.countDistinct("compound_id").alias("n_compounds"), F.countDistinct("peak_id").alias("n_peaks"), F.array_sort(F.collect_set("compound_id")).alias("compounds"), F.array_sort(F.collect_set("peak_id")).alias("peaks")
    )
    none = {c: F.array().cast(links.schema[x].dataType.simpleString().join(("array<", ">"))) for c, x in (("compounds", "compound_id"), ("peaks", "peak_id"))}
    none |= dict.fromkeys(("n_compounds", "n_peaks"), F.lit(0).cast("long"))
    out = found.join(sides, "fragment_id", "left").withColumns({c: F.coalesce(c, x) for c, x in none.items()})
    out = out.select("mz", "fragment_id", "fixedmass", "formula", "smiles", "n_compounds", "n_peaks", "compounds", "peaks")
    known = F.bool_or(F.col("smiles").isNotNull()).over(Window.partitionBy("mz"))
    label = F.when(F.col("smiles").isNotNull(), "structure").when(F.col("formula").isNotNull(), "formula").otherwise("unknown")
    out = out.withColumn("mass_error", 1e6 * (F.col("mz") - F.col("fixedmass")) / F.col("fixedmass")).withColumn("label", label)
    return out.withColumn("has_smiles", known)


def scans_of_peaks(peaks: DataFrame, scans: DataFrame, experiment: str, width: float, span: float | None = None) -> DataFrame:
    """Scans (file, ms_n, scantime, precursor_mz) in the time window of each peak (rt_start, rt_end); MS2 scans by isolation window.

    span is the width of bins of time; without it the mean length of the windows.
    MS2 scans of an experiment that isolates ions meet peaks in bins of the precursor's m/z, too.
    """
    wanted = peaks.withColumnRenamed("precursor_mz", "wanted_mz")
    if span is None:
        span = wanted.where("rt_start <= rt_end").agg(F.avg(F.col("rt_end") - F.col("rt_start"))).first()[0] or 1.0  # one number
    low, high, time = F.col("rt_start"), F.col("rt_end"), F.col("scantime")
    whole = F.coalesce(F.col("ms_n") == 1, F.lit(False))
    half = {"DDA": width, "SWATH": width / 2}.get(experiment)
    if half is None:
        rows = interval_join(wanted, scans, low, high, time, span)
        return rows.where(whole | in_isolation_window(F.lit(experiment), F.col("precursor_mz"), F.col("wanted_mz"), F.lit(width)))
    first = interval_join(wanted, scans.where(whole), low, high, time, span)
    # the bins reach a little beyond the window, which is asked of each pair as it is
    step = max(2 * half, 0.001)
    reach = F.lit(half) + (F.abs("wanted_mz") + 1) * 1e-9
    near = wanted.where("wanted_mz is not null").withColumn("_mass", F.explode(F.sequence(F.floor((F.col("wanted_mz") - reach) / step), F.floor((F.col("wanted_mz") + reach) / step))))
    chosen = interval_join(near, scans.where(~whole).withColumn("_scan_mass", F.floor(F.col("precursor_mz") / step)), low, high, time, span, keys=[("_mass", "_scan_mass")])
    chosen = chosen.where(in_isolation_window(F.lit(experiment), F.col("precursor_mz"), F.col("wanted_mz"), F.lit(width)))
    return first.unionByName(chosen.drop("_mass", "_scan_mass"))


__all__ = ["candidates", "library_spectra", "scans_of_peaks", "search_compound", "search_fragments", "search_spectra", "tolerance"]
