"""One object over the frames of a library, with a method for each kind of request."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators import predicates, spectra

from . import schema, search, views


class Library:
    """Frames by table name; views are functions of plans.views."""

    def __init__(self, frames: dict[str, DataFrame]):
        self.frames = frames

    def list_tables(self) -> list[str]:
        return sorted(self.frames)

    def list_views(self) -> list[str]:
        return sorted(n for n, f in vars(views).items() if callable(f) and getattr(f, "__module__", "") == views.__name__)

    def table(self, name: str) -> DataFrame:
        return self.frames[name] if name in self.frames else getattr(views, name)(self.frames)

    def table_search(self, name: str, columns: list[str] | None = None, criteria: dict[str, Any] | None = None, **settings) -> DataFrame:
        """Rows of a table or view; criteria are data (see predicates.table_search), never code."""
        return predicates.table_search(self.table(name), columns, criteria, **settings)

    def compound_data(self, compound_id: int, tidy: bool = True) -> DataFrame:
        peaks = self.frames["compound_fragments"].where(F.col("compound_id") == compound_id).select("peak_id").distinct()
        rows = views.peak_data(self.frames).join(peaks, "peak_id", "left_semi")
        return spectra.tidy(rows, "ions") if tidy else rows

    def peak_data(self, peak_id: int, tidy: bool = True) -> DataFrame:
        rows = views.peak_data(self.frames).where(F.col("peak_id") == peak_id)
        return spectra.tidy(rows, "ions") if tidy else rows

    def sample_narrative(self, sample_id: int) -> DataFrame:
        return views.sample_narratives(self.frames).where(F.col("id") == sample_id)

    def search_fragments(self, masses: list[float], ppm: float = 5.0, min_error: float = 0.002) -> DataFrame:
        spark = next(iter(self.frames.values())).sparkSession
        ions = spark.createDataFrame([(float(m),) for m in masses], "mz double")
        f = views.annotated_fragments(self.frames).select(F.col("id").alias("fragment_id"), "fixedmass", "formula", "smiles")
        return search.search_fragments(ions, f, self.frames["compound_fragments"].withColumnRenamed("annotated_fragment_id", "fragment_id"), ppm, min_error)

    def search_compound(self, ms1: DataFrame, ms2: DataFrame, precursor: float | None = None, **settings) -> DataFrame:
        """Ranked matches of a query's spectra (mz, int); with a precursor, only among peaks near it.  Each peak's own parameters are used where the library has them."""
        settings.setdefault("parameters", self.frames.get("opt_ums_params"))
        scans = views.peak_data(self.frames).select("peak_id", "ms_n", "scantime", "ions")
        peaks = self.frames["peaks"].select(F.col("id").alias("peak_id"), "precursor_mz")
        return search.search_compound(ms1, ms2, peaks, scans, precursor=precursor, **settings)

    def problems(self) -> DataFrame:
        known = {n: f for n, f in self.frames.items() if n in schema.TABLES}
        return schema.problems(known)
