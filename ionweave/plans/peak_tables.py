"""Peak tables: a peak's ions at one MS level, aligned across its scans, as long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.operators.align import aligned
from ionweave.operators.spectra import extracted, total
from ionweave.operators.tolerance import nearest_scan


def peak_table(scans: DataFrame, level: int, ppm: float = 5.0, min_error: float = 0.002, start: str = "precursor") -> DataFrame:
    """(peak_id, scan, ion_group, mz, intensity, eic) of scans (peak_id, ms_n, scantime, precursor_mz, ions) at a level.

    scan is the place by time among the peak's scans of the level; eic is the
    precursor's intensity in it, or of an MS2 scan in the nearest MS1 scan.
    Columns ppm and min_error, if there, are a peak's own tolerances.

    Alignment starts, for ``start="precursor"``, from the MS1 scan with the
    largest eic, and at level 2 from the scan that comes right after an MS1 scan,
    the one with the largest eic of those; where no MS2 scan does, from the
    largest eic.  ``start="tic"`` is the scan with the largest summed intensity.
    The first of equals counts.  A peak without MS1 scans has no precursor trace:
    it has rows for "tic" only, with a null eic.  Scans without ions have none.
    """
    if start not in ("precursor", "tic"):
        raise ValueError(f"start is precursor or tic, not {start}")
    for name, value in (("ppm", ppm), ("min_error", min_error)):
        if name not in scans.columns:
            scans = scans.withColumn(name, F.lit(value))
    rows = nearest_scan(scans, ["peak_id"], "scantime", F.col("ms_n") == 1)
    rows = rows.withColumn("_trace", extracted(F.col("ions"), F.col("precursor_mz"), F.col("ppm"), F.col("min_error")))
    in_order = Window.partitionBy("peak_id").orderBy("scantime", "ms_n")
    rows = rows.withColumns({"_level": F.lag("ms_n").over(in_order), "_before": F.lag("_trace").over(in_order)})
    traces = rows.where("ms_n = 1").select("peak_id", F.col("scantime").alias("nearest"), F.col("_trace").alias("eic"))
    own = rows.where(F.col("ms_n") == level).join(traces, ["peak_id", "nearest"], "inner" if start == "precursor" else "left")
    if start == "tic":
        seed = total(F.col("ions"))
    else:
        seed = F.when(F.lit(level > 1) & (F.col("_level") == 1), F.col("_before"))
    place = F.row_number().over(Window.partitionBy("peak_id").orderBy("scantime")).cast("long")
    ions = own.withColumns({"scan": place, "seed": seed}).select("peak_id", "scan", "eic", "ppm", "min_error", "seed", F.inline("ions"))
    return aligned(ions, ["peak_id"], ppm, min_error)
