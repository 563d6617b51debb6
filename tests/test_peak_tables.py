"""Peak tables by their starting scan, mass charts, and quantiles that no task holds whole."""

import numpy as np
import pandas as pd
import pytest

from ionweave.functions import chem, stats
from ionweave.operators import align
from ionweave.plans.peak_tables import peak_table

SCANS = "peak_id long, ms_n int, scantime double, precursor_mz double, ions array<struct<mz:double,intensity:double>>"


def groups(rows):
    return {(r.peak_id, r.scan, r.mz): r.ion_group for r in rows.collect()}


def cycle(precursors, products):
    """One MS1 and two MS2 scans a cycle; the precursor is at 300."""
    rows = []
    for k, p in enumerate(precursors):
        rows.append((1, 1, 3.0 * k, 300.0, [(300.0, p)]))
        rows += [(1, 2, 3.0 * k + 1 + j, 300.0, [(100.0 + 10 * k + j, products[2 * k + j])]) for j in range(2)]
    return rows


def test_ms2_starts_after_the_strongest_ms1_scan(spark):
    scans = spark.createDataFrame(cycle([5.0, 9.0], [1.0, 1.0, 1.0, 50.0]), SCANS)
    got = groups(peak_table(scans, 2))
    # scan 3 follows the MS1 scan of 9; then 2 and 4 (the earlier first), then 1
    assert got == {(1, 3, 110.0): 0, (1, 2, 101.0): 1, (1, 4, 111.0): 2, (1, 1, 100.0): 3}
    assert groups(peak_table(scans, 2, start="tic"))[1, 4, 111.0] == 0
    assert {r.eic for r in peak_table(scans, 1).collect()} == {5.0, 9.0}


def test_a_strong_ms1_scan_that_no_ms2_scan_follows_is_not_the_start(spark):
    rows = [*cycle([5.0, 4.0], [1.0] * 4), (1, 1, 6.0, 300.0, [(300.0, 99.0)])]
    assert groups(peak_table(spark.createDataFrame(rows, SCANS), 2))[1, 1, 100.0] == 0


def test_own_tolerance_and_peaks_that_lack_scans(spark):
    rows = [(1, 1, 0.0, 300.0, [(300.0, 5.0), (100.0, 1.0)]), (1, 1, 1.0, 300.0, [(100.5, 1.0)]), (2, 2, 0.0, 300.0, [(50.0, 2.0)]), (3, 1, 0.0, 300.0, []), (3, 2, 1.0, None, None)]
    scans = spark.createDataFrame(rows, SCANS)
    assert len(set(groups(peak_table(scans, 1)).values())) == 3
    assert len(set(groups(peak_table(scans, 1, min_error=1.0)).values())) == 2
    assert peak_table(scans, 2).count() == 0  # peak 2 has no MS1 scan
    assert [(r.peak_id, r.eic) for r in peak_table(scans, 2, start="tic").collect()] == [(2, None)]
    assert peak_table(scans.where("false"), 2).count() == 0
    with pytest.raises(ValueError):
        peak_table(scans, 2, start="first")


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][k % 3], float(x)) for k, x in enumerate(rng.integers(0, 40, 600))] + [("a", None), ("none", None), ("one", 7.0)]
    got = {r.g: r.q for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.0, 0.1, 0.5, 0.99, 1.0)).withColumnRenamed("quantiles", "q").collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g in got:
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], (0.0, 0.1, 0.5, 0.99, 1.0)))
    whole = stats.quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", (0.25,)).collect()
    assert [r.asDict() for r in whole] == [{"quantiles": [np.quantile([v for _, v in rows if v is not None], 0.25)]}]
    assert stats.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_chart_gives_masses_and_patterns_of_any_element(spark):
    table = [(e, m, a) for e, x in chem.ISOTOPES.items() for m, a in x] + [("Xx", 50.0, 0.5), ("Xx", 49.0, 0.5), ("Xx", 52.0, 0.0), ("Yy", None, 1.0), (None, 1.0, 1.0)]
    chart = chem.mass_chart(spark.createDataFrame(table, "symbol string, exact_mass double, abundance double"))
    isotopes = {r.symbol: [(x.mass, x.abundance) for x in r.isotopes] for r in chart.collect()}
    assert isotopes["Xx"] == [(49.0, 0.5), (50.0, 0.5)] and "Yy" not in isotopes and isotopes["Cl"][0] == (34.968852682, 0.7576)
    df = spark.createDataFrame([(1, "C10H8Cl2"), (2, "XxC"), (3, "CYy"), (4, "c(1)"), (5, None), (6, ""), (7, "C10H8Cl2")], "symbol long, formula string")
    masses = {r.symbol: r.m for r in chem.chart_masses(df, "formula", chart, "m").collect()}
    assert masses[2] == 61.0 and masses[1] == masses[7] == pytest.approx(10 * 12 + 8 * 1.00782503223 + 2 * 34.968852682)
    assert [masses[k] for k in (3, 4, 5, 6)] == [None] * 4
    got = [(r.symbol, r.mz, r.intensity) for r in chem.isotope_patterns(df, "formula", chart).collect()]
    want = sorted((k, *x) for k in (1, 7) for x in chem.isotope_pattern("C10H8Cl2"))
    assert np.allclose(sorted(x for x in got if x[0] != 2), want, rtol=1e-9)
    assert [m for k, m, p in sorted(got) if k == 2 and p > 0.5] == [61.0, 62.0]


@pytest.mark.parametrize("size", ["1", "7", "10000"])
def test_batches_that_end_within_keys_change_nothing(spark, size):
    rng = np.random.default_rng(5)
    rows = [(None if k % 5 == 0 else k % 5, "xy"[k % 2], k // 7 % 6, round(float(rng.uniform(100, 100.05)), 3), float(k), float(k // 7 % 6 % 4)) for k in range(300)]
    ions = spark.createDataFrame(rows, "a long, b string, scan long, mz double, intensity double, eic double")
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = align.aligned(ions, ["a", "b"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    got = sorted((r.a or 0, r.b, r.scan, r.ion_group, r.mz, r.intensity, r.eic) for r in found)
    want = []
    for a in range(5):
        for b in "xy":
            own = pd.DataFrame([r[2:] for r in rows if (r[0] or 0) == a and r[1] == b], columns=["scan", "mz", "intensity", "eic"])
            want += [(a, b, *x) for x in align.align_ions(own).itertuples(index=False, name=None)]
    rounded = lambda rows: sorted((*r[:4], *(round(x, 9) for x in r[4:])) for r in rows)
    assert rounded(got) == rounded(want) and len(want) > 100
