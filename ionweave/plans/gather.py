"""Import objects of peaks: each peak of a method with the scans that belong to it, as nested rows and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.operators import spectra
from ionweave.operators.keys import same
from ionweave.operators.tolerance import in_isolation_window, interval_join, tolerance

#: Names of experiments, as far as they choose MS2 scans.
EXPERIMENTS = {"data-independent acquisition (dia/aif)": "DIA", "dia": "DIA", "data-dependent acquisition (dda/topn)": "DDA", "dda": "DDA", "swath": "SWATH"}


def experiment(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in EXPERIMENTS.items() for x in kv])
    return F.try_element_at(names, F.lower(F.trim(text)))


def gathered(peaks: DataFrame, scans: DataFrame, zoom: tuple[float, float] = (1.0, 5.0), min_error: float = 0.002, span: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(peaks with msdata, errors (file, peak, problem)) of peaks without MS2 scans, or of an unknown experiment.

    peaks: file, peak, mz, start and end of its time, polarity (text), ms2exp,
    isowidth, msaccuracy, and what else an object has.  scans: file, scantime,
    ms_n, polarity (1 or -1), precursor_mz, ions.  A peak takes the scans of its
    file and polarity between its times: all MS1 scans, cut to ``zoom`` about its
    m/z with the ions within tolerance as base ion, and the MS2 scans that its
    experiment isolates, whole, with their largest ion.  msdata is in the order of
    time, and MS1 before MS2 at one time; scans with no ion left are left out.
    """
    charge = F.when(F.lower("polarity") == "positive", 1).when(F.lower("polarity") == "negative", -1)
    wanted = peaks.withColumns({"_charge": charge, "_kind": experiment(F.col("ms2exp"))})
    own = wanted.select(F.col("file").alias("_file"), F.col("peak").alias("_peak"), "_charge", "_kind", F.col("mz").alias("_mz"), F.least("start", "end").alias("_from"), F.greatest("start", "end").alias("_to"), F.col("isowidth").alias("_width"), F.col("msaccuracy").alias("_ppm"))
    met = interval_join(own, scans.withColumnRenamed("polarity", "_sign"), F.col("_from"), F.col("_to"), F.col("scantime"), span, keys=[("_file", "file"), ("_charge", "_sign")])
    met = met.where((F.col("ms_n") == 1) | ((F.col("ms_n") == 2) & in_isolation_window(F.col("_kind"), F.col("precursor_mz"), F.col("_mz"), F.col("_width"))))
    near = F.filter("ions", lambda x: x["mz"].between(F.col("_mz") - zoom[0], F.col("_mz") + zoom[1]))
    kept = F.when(F.col("ms_n") == 1, near).otherwise(F.col("ions"))
    tol = tolerance(F.col("_mz"), F.col("_ppm"), min_error)
    base = F.filter("_ions", lambda x: F.abs(x["mz"] - F.col("_mz")) <= tol)
    mean = F.try_divide(F.aggregate(base, F.lit(0.0), lambda a, x: a + x["mz"]), F.size(base))
    top = spectra.base_peak(F.col("_ions"))
    met = met.withColumn("_ions", kept).where(F.size("_ions") > 0)
    row = F.struct(
        "scantime", "ms_n", F.when(F.col("ms_n") == 1, mean).otherwise(top["mz"]).alias("base_ion"), F.when(F.col("ms_n") == 1, spectra.total(base)).otherwise(top["intensity"]).alias("base_int"),
        spectra.pack(F.col("_ions"), "mz").alias("measured_mz"), spectra.pack(F.col("_ions"), "intensity").alias("measured_intensity"),
    )
    data = met.groupBy("_file", "_peak").agg(F.array_sort(F.collect_list(row)).alias("msdata"), F.count_if(F.col("ms_n") == 2).alias("_n2"))
    out = wanted.join(data, (F.col("file") == F.col("_file")) & (F.col("peak") == F.col("_peak")), "left")
    problem = F.when(F.col("_charge").isNull(), "unknown polarity").when(F.col("_kind").isNull(), "unknown experiment").when(F.coalesce("_n2", F.lit(0)) == 0, "no MS2 scans")
    out = out.withColumn("problem", problem)
    return out.where("problem is null").select(*peaks.columns, "msdata"), out.where("problem is not null").select("file", "peak", "problem")


def distinct_peaks(peaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(peaks of which no two are alike but for ``peak``, members (file, peak, of)).

    Peaks of a file that agree in all other columns take the same scans and have
    the same object, so it is gathered once, for the smallest ``peak`` (``of``) of them.
    """
    like = [c for c in peaks.columns if c != "peak"]
    one = peaks.groupBy(*like).agg(F.min("peak").alias("peak")).select(*peaks.columns)
    own = one.select(*[F.col(c).alias(f"_{c}") for c in like], F.col("peak").alias("of"))
    return one, peaks.join(own, same("", "_", like)).select("file", "peak", "of")


def as_json(objects: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """(file, peak, text): each object as JSON; sections name the columns that go into a nested object, the others stay beside them."""
    inside = [c for columns in sections.values() for c in columns]
    parts = [F.struct(*columns).alias(name) for name, columns in sections.items()]
    rest = [F.col(c) for c in objects.columns if c not in inside and c not in ("file", "peak")]
    return objects.select("file", "peak", F.to_json(F.struct(*parts, *rest)).alias("text"))
