"""Files in ranges and in order, redraws, QC with patterns and parameters, objects of peaks, suspect lists."""

from __future__ import annotations

import numpy as np
import pytest

from ionweave.functions import qc
from ionweave.operators import components, scoring
from ionweave.plans import gather, suspects
from ionweave.sources import files


def test_one_mzml_file_is_many_tasks(spark, tmp_path):
    def array(values, kind):
        return f'<binaryDataArray><cvParam accession="MS:1000574"/><cvParam accession="{kind}"/><binary>{files.zip_numbers(values)}</binary></binaryDataArray>'

    scans = [f'<spectrum index="{k}" id="scan={k + 1}"><cvParam accession="MS:1000511" value="{1 + k % 2}"/>\n{array([100.0 + k, 200.5], "MS:1000514")}{array([1.0, float(k)], "MS:1000515")}</spectrum>\n' for k in range(200)]
    (tmp_path / "a.mzML").write_text("<mzML><spectrumList>" + "".join(scans) + "</spectrumList><chromatogram/></mzML>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = files.read_mzml(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 4
        rows = sorted(found.collect(), key=lambda r: r.scan)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [r.scan for r in rows] == list(range(1, 201)) and [r.ms_n for r in rows] == [1 + k % 2 for k in range(200)]
    assert all([tuple(x) for x in r.ions] == [(100.0 + k, 1.0), (200.5, float(k))] for k, r in enumerate(rows))
    whole = list(files.parse_mzml("a", (tmp_path / "a.mzML").read_text()))
    assert [(r["scan"], r["ms_n"], len(r["ions"])) for r in whole] == [(r.scan, r.ms_n, len(r.ions)) for r in rows]


def test_parameters_of_scans(spark):
    text = '<spectrum><cvParam name="ms level" value="2"/><precursor><cvParam name="selected ion m/z" value="1.5"/><cvParam name="charge state" value="2"/><cvParam name="selected ion m/z" value="x"/></precursor><userParam name="no" value="1"/><cvParam name="profile &amp; raw" value=""/></spectrum>'
    df = spark.createDataFrame([("f", 1, text), ("f", 2, None), ("f", 3, "")], "file string, scan int, text string")
    rows = files.cv_parameters(df, "file", "scan", "text")
    assert [(r.element, r.name, r.value) for r in rows.orderBy("place").collect()] == [("spectrum", "ms level", "2"), ("precursor", "selected ion m/z", "1.5"), ("precursor", "charge state", "2"), ("precursor", "selected ion m/z", "x"), ("userParam", "profile & raw", None)]
    wide = files.parameter_table(rows).orderBy("element", "number").collect()
    assert [(r.element, r.number, r["selected ion m/z"], r["charge state"], r["ms level"], r["profile & raw"]) for r in wide] == [("precursor", 1, 1.5, "2", None, None), ("precursor", 2, None, "2", None, None), ("spectrum", 1, None, None, 2.0, None), ("userParam", 1, None, None, None, "true")]


def test_msp_files_hold_whole_entries_in_order(spark, tmp_path):
    ions = spark.createDataFrame([(k, f"n{k}", 300.5, 100.0 + j, float(j)) for k in range(90) for j in range(k % 4 + 1)], "id long, name string, precursor double, mz double, intensity double")
    files.write_msp(ions.repartition(7), str(tmp_path / "m"), "id", "name", "precursor", files=5)
    assert len(list((tmp_path / "m").glob("part-*.txt"))) == 5
    rows = files.read_msp(spark, str(tmp_path / "m")).orderBy("file", "place").collect()
    assert [r.name for r in rows] == [f"n{k}" for k in range(90)]
    assert all(r.n_peaks == k % 4 + 1 and [tuple(x) for x in r.ions] == [(100.0 + j, float(j)) for j in range(k % 4 + 1)] for k, r in enumerate(rows))


def test_redraws(spark):
    a = [(1, 100.0, 0.0, 10.0, 1.0), (1, 150.0, None, 5.0, None), (2, 100.0, 0.0, 4.0, 0.0), (3, 90.0, 0.0, 1.0, 0.0)]
    b = [(1, 100.0, 0.0, 9.0, 2.0), (1, 150.0, 0.0, 6.0, 0.5), (2, 100.0, 0.0, 4.0, 0.0), (3, 300.0, 0.0, 1.0, 0.0)]
    ddl = "k long, mz double, mz_u double, int double, int_u double"
    one = {(r.k, r.run): (r.dp, r.rdp) for r in scoring.bootstrap(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), 50, key=["k"]).collect()}
    two = {(r.k, r.run): (r.dp, r.rdp) for r in scoring.bootstrap(spark.createDataFrame(a, ddl).repartition(5), spark.createDataFrame(b, ddl), 50, key=["k"]).collect()}
    assert one == two and len(one) == 150 and len({one[1, r] for r in range(50)}) == 50
    assert all(one[2, r] == (1.0, 1.0) and one[3, r] == (None, None) for r in range(50))
    # drawn by hand from the same means and spreads
    rng = np.random.default_rng(1)
    want = []
    for _ in range(4000):
        x, y = np.array([rng.normal(10, 1), 5.0]), np.array([rng.normal(9, 2), rng.normal(6, 0.5)])
        x, y = np.maximum(x, 0) / np.maximum(x, 0).sum(), np.maximum(y, 0) / np.maximum(y, 0).sum()
        m = np.array([100.0, 150.0])
        w, v = m * np.sqrt(x), m * np.sqrt(y)
        want.append((w @ v) ** 2 / ((w @ w) * (v @ v)))
    got = [r.dp for r in scoring.bootstrap(spark.createDataFrame(a[:2], ddl).drop("k"), spark.createDataFrame(b[:2], ddl).drop("k"), 800).collect()]
    assert np.mean(got) == pytest.approx(np.mean(want), abs=0.002) and np.std(got) == pytest.approx(np.std(want), rel=0.2)


def test_qc_with_patterns_and_parameters(spark):
    peaks = spark.createDataFrame([(1, 120.0, 120.0, "C10", 5.0), (2, 120.0, 120.0, "C10", 5.0)], "peak_id long, mz double, calculated double, formula string, msaccuracy double")
    ms1 = spark.createDataFrame([(1, 120.0, 0.9), (1, 121.00335, 0.1), (2, 200.0, 1.0)], "peak_id long, mz double, intensity double")
    none = spark.createDataFrame([], "peak_id long, fragment_mz double, fragment_calculated double, fragment_formula string")
    optimal = spark.createDataFrame([(1, 1, 0.5, 10.0, 10.0), (1, 2, None, None, 5.0), (2, 1, 0.5, 1.0, 1.0)], "peak_id long, mslevel int, correl double, height double, freq double")
    out = qc.gathered(peaks, none, ms1, ms1, patterns=True, optimal=optimal)
    got = {(r.peak_id, r.parameter, r.value if "ums" in r.parameter else None): r.result for r in out.collect()}
    assert got[1, "ms1_isotopepattern", None] and not got[2, "ms1_isotopepattern", None] and got[1, "ms1precursor_detected", None] and not got[2, "ms1precursor_detected", None]
    assert [got[p, "optimized_ums_parameters", level] for p in (1, 2) for level in (1.0, 2.0)] == [True, True, True, False]


def test_peaks_take_their_scans(spark):
    ion = lambda mz, v: (mz, v)
    scans = [("a", 1.0, 1, 1, 0.0, [ion(100.0, 5.0), ion(100.002, 1.0), ion(103.0, 2.0), ion(110.0, 9.0)]), ("a", 1.1, 2, 1, 100.4, [ion(50.0, 3.0), ion(60.0, 4.0)]), ("a", 1.2, 2, 1, 102.0, [ion(50.0, 1.0)]), ("a", 1.3, 1, -1, 0.0, [ion(100.0, 1.0)]), ("a", 9.0, 1, 1, 0.0, [ion(100.0, 1.0)]), ("a", 1.4, 1, 1, 0.0, [])]
    scans = spark.createDataFrame(scans, "file string, scantime double, ms_n int, polarity int, precursor_mz double, ions array<struct<mz:double,intensity:double>>")
    rows = [("a", k, 100.0, 2.0, 0.5, p, x, 0.7, 5.0) for k, p, x in ((1, "positive", "DDA"), (2, "Positive", "dia"), (3, "positive", "SWATH"), (4, "negative", "DDA"), (5, "none", "DDA"), (6, "positive", "?"))]
    peaks = spark.createDataFrame(rows, "file string, peak long, mz double, start double, end double, polarity string, ms2exp string, isowidth double, msaccuracy double")
    found, errors = gather.gathered(peaks, scans)
    data = {r.peak: [(x.scantime, x.ms_n, x.base_ion, x.base_int, x.measured_mz) for x in r.msdata] for r in found.collect()}
    ms1 = (1.0, 1, pytest.approx(100.001), 6.0, "100.0 100.002 103.0")
    assert data == {1: [ms1, (1.1, 2, 60.0, 4.0, "50.0 60.0")], 2: [ms1, (1.1, 2, 60.0, 4.0, "50.0 60.0"), (1.2, 2, 50.0, 1.0, "50.0")]}
    assert {r.peak: r.problem for r in errors.collect()} == {3: "no MS2 scans", 4: "no MS2 scans", 5: "unknown polarity", 6: "unknown experiment"}
    text = gather.as_json(found.where("peak = 1"), {"peak": ["mz", "start"]}).first().text
    assert text.startswith('{"peak":{"mz":100.0,"start":2.0},"end":0.5')


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100 - k, 101 - k) for k in range(20)] + [(200, 200), (300, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 81 for k in range(81, 102)} | {200: 200, 300: 200}


def test_suspects(spark):
    rows = [(1, "x", "C2", "50-00-0", "note:a"), (2, None, None, None, "casrn:50-00-0; inchikey:K1"), (3, "z", "C3", None, "InChIKey:K1x; dtxsid:D9"), (4, "w", "C3", "50-00-1", "DTXSID:D9"), (5, "v", "C4", None, "smiles:S"), (6, "v", "C5", None, "smiles:S"), (7, "k", "C7", "7732-18-5", None), (8, "k", "C7", None, "smiles:known"), (9, "alone", "C1", None, None)]
    df = spark.createDataFrame(rows, "number long, NAME string, FORMULA string, CASRN string, ADDITIONAL string")
    compounds = spark.createDataFrame([(10, "water", "H2O", 18.01, 0), (11, "other", "C", 12.0, 0)], "id long, name string, formula string, fixedmass double, netcharge long")
    aliases = spark.createDataFrame([(10, 1, "7732-18-5"), (11, 4, "known")], "compound_id long, alias_type long, alias string")
    kinds = spark.createDataFrame([(1, "CASRN"), (2, "INCHIKEY"), (3, "DTXSID"), (4, "SMILES")], "id long, name string")
    found, grown, more, conflicts = suspects.extend(df, compounds, aliases, kinds)
    assert {r.number: r.compound_id for r in found.collect()} == {1: 12, 2: 12, 3: 13, 4: 13, 7: 10, 8: 11, 9: 14}
    assert {r.number: r.problem for r in conflicts.collect()} == {5: "several formulas", 6: "several formulas"}
    assert {(r.id, r.name, r.formula, r.fixedmass) for r in grown.where("id > 11").collect()} == {(12, "x", "C2", 24.0), (13, "z", "C3", 36.0), (14, "alone", "C1", 12.0)}
    assert {(r.compound_id, r.alias) for r in more.where("compound_id > 11").collect()} == {(12, "50-00-0"), (12, "K1"), (13, "K1x"), (13, "D9")}
    again = suspects.extend(df.where("number not in (9)"), grown, more, kinds)
    assert again[1].count() == grown.count() and again[2].count() == more.count()
