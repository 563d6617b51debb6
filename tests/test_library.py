import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionweave.functions import chem, qc, text
from ionweave.operators import align, predicates, relational, scoring, spectra
from ionweave.operators.tolerance import tolerance, tolerance_join
from ionweave.plans import schema, views
from ionweave.plans.api import Library
from ionweave.sources import files


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tolerance(spark):
    assert one(spark, tolerance(F.lit(412.9665))) == pytest.approx(0.0020648325)
    assert one(spark, tolerance(F.lit(100.0))) == 0.002


def test_binned_join_equals_plain_join(spark):
    rng = np.random.default_rng(1)
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.uniform(100, 101, 200))] + [(999, None)], "i long, x double")
    b = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.uniform(100, 101, 200))] + [(999, None)], "j long, y double")
    binned = {(r.i, r.j) for r in tolerance_join(a, b, "x", "y", min_error=0.01).collect()}
    plain = {(r.i, r.j) for r in a.join(b, F.col("y").between(F.col("x") - 0.01, F.col("x") + 0.01)).collect()}
    assert binned == plain and len(plain) > 100


def test_unpack(spark):
    got = one(spark, spectra.unpack(F.lit("712.9501 713.1851"), F.lit("15094.41015625 34809.9765625")))
    assert [tuple(x) for x in got] == [(712.9501, 15094.41015625), (713.1851, 34809.9765625)]
    zipped = one(spark, spectra.unpack_zipped(F.lit("712.9501 15094.41015625 713.1851 34809.9765625")))
    assert zipped == got
    ions = F.array(*[F.struct(F.lit(a).alias("mz"), F.lit(b).alias("intensity")) for a, b in ((1.5, 2.0), (3.0, 4.0))])
    assert one(spark, spectra.pack(ions, "mz")) == "1.5 3.0" and one(spark, spectra.total(ions)) == 6.0
    assert one(spark, spectra.base_peak(ions))["mz"] == 3.0


def spectrum(spark, key, ions):
    return spark.createDataFrame([(0, a, b) for a, b in ions], f"{key} long, mz double, intensity double")


@pytest.mark.parametrize(
    ("right", "dp", "rdp"),
    [
        ([(100.0, 10.0), (200.0, 20.0), (300.0, 70.0)], 1.0, 1.0),
        ([(100.001, 10.0), (200.001, 40.0), (400.0, 50.0)], 0.12387863639, 0.17368702754),
        ([(500.0, 1.0)], None, None),
    ],
)
def test_compare(spark, right, dp, rdp):
    a = spectrum(spark, "q", [(100.0, 10.0), (200.0, 20.0), (300.0, 70.0)])
    pairs = spark.createDataFrame([(0, 0)], "q long, p long")
    r = scoring.compare(a, spectrum(spark, "p", right), ["q"], ["p"], pairs).first()
    assert (r.dp, r.rdp) == (dp, rdp) or (r.dp == pytest.approx(dp, abs=1e-9) and r.rdp == pytest.approx(rdp, abs=1e-9))


def test_pooled_sd(spark):
    df = spark.createDataFrame([(0.1, 3), (0.2, 5)], "sd double, n long")
    assert df.agg(scoring.pooled_sd(F.col("sd"), F.col("n"))).first()[0] == pytest.approx(0.17320508076)


def test_formulas(spark):
    masses = {"C8HF15O2": 413.973702, "C7HF13O2": 363.976895, "C6HF11O2": 313.980089}
    for f, m in masses.items():
        assert one(spark, chem.mass(chem.elements(F.lit(f)))) == pytest.approx(m, abs=2e-6)
    assert one(spark, chem.mass(chem.elements(F.lit("C8HF15O2")))) + chem.adduct_shift("[M-H]-") == pytest.approx(412.966425, abs=2e-6)
    assert one(spark, chem.mass(chem.elements(F.lit("C2Xx")))) is None
    assert one(spark, chem.is_subset(chem.elements(F.lit("C2F5")), chem.elements(F.lit("C8HF15O2"))))
    assert not one(spark, chem.is_subset(chem.elements(F.lit("C9F5")), chem.elements(F.lit("C8HF15O2"))))
    assert one(spark, chem.hill(chem.elements(F.lit("O2F15HC8")))) == "C8HF15O2"
    assert one(spark, chem.hill(chem.with_adduct(chem.elements(F.lit("C8HF15O2")), "-H"))) == "C8F15O2"
    assert one(spark, chem.with_adduct(chem.elements(F.lit("C2")), "-H")) is None


def test_casrn(spark):
    assert [one(spark, chem.casrn(F.lit(x))) for x in ("335-67-1", "335-67-2", "000335-67-1", "x", None)] == ["335-67-1", None, "335-67-1", None, None]


def test_isotopes():
    pattern = chem.isotope_pattern("C10H8Cl2")
    assert max(p for _, p in pattern) == 1.0
    assert any(abs(m - pattern[0][0] - 1.99705) < 1e-3 and 0.6 < p < 0.7 for m, p in pattern)


def test_qc(spark):
    df = spark.createDataFrame([(412.9665, 412.966425, 118.9912, 118.992564)], "m double, c double, fm double, fc double")
    r = qc.fragment_accuracy(qc.mass_error(df, "m", "c", F.lit(5.0)), "fm", "fc", 5.0, 0.002).first()
    assert r.mass_ok and r.fragment_ok and r.fragment_error == pytest.approx(-11.463, abs=0.01)


def test_criteria(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), ("X", 4)], "a string, b long")
    pick = lambda c, **k: sorted(r.b for r in predicates.where(df, c, **k).collect())
    assert pick({"a": {"values": "x", "exclude": True}}) == [2, 4]
    assert pick({"a": "NULL"}) == pick({"a": []}) == [3]
    assert pick({"a": ["x", "y"]}) == [1, 2] and pick({"a": "x"}, case_sensitive=False) == [1, 4]
    assert pick({"a": {"values": "x", "like": True}}) == [1, 4] and pick({"a": "x", "b": 2}, and_or="OR") == [1, 2]
    with pytest.raises(ValueError):
        predicates.where(df, {"a": {"value": 1}})
    with pytest.raises(ValueError):
        predicates.where(df, {"c": 1})
    assert predicates.match_rows(df, df.where("a is null").select("a")).count() == 1


def test_relational(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    rows = spark.createDataFrame([(1, "b"), (2, "c"), (3, " "), (4, None)], "k long, kind string")
    out, grown = relational.normalize_key(rows, "kind", dim)
    assert {(r.k, r.kind) for r in out.collect()} == {(1, 2), (2, 3), (3, None), (4, None)} and grown.count() == 3
    assert relational.append_new(dim, dim, ["name"]).count() == 2
    scans = spark.createDataFrame([(0, t, n) for t, n in enumerate([1, 2, 2, 1, 2, 2])], "f long, t long, n long")
    cycles = relational.scan_cycles(scans, ["f"], "t", "n", [10.0, 30.0]).orderBy("t", "energy").collect()
    assert [(r.t, r.energy) for r in cycles] == [(0, 10), (0, 30), (1, 10), (2, 30), (3, 10), (3, 30), (4, 10), (5, 30)]


def test_alignment():
    rows = [(s, 100.0 + d, 10.0, e) for s, d, e in ((1, 0.0005, 5.0), (2, 0.0, 9.0), (3, -0.001, 4.0))] + [(2, 150.0, 1.0, 9.0), (3, 100.0015, 2.0, 4.0)]
    out = align.align_ions(pd.DataFrame(rows, columns=["scan", "mz", "intensity", "eic"]))
    assert out["ion_group"].nunique() == 2
    assert out[(out.scan == 3) & (out.ion_group == 0)]["intensity"].tolist() == [12.0]
    pairs = align.paired(pd.DataFrame({"mz": [100.0, 200.0], "int": [1.0, 2.0]}), pd.DataFrame({"mz": [100.001, 300.0], "int": [3.0, 4.0]}))
    assert pairs["mz2"].isna().sum() == 1 and pairs["mz1"].isna().sum() == 1


def test_best_parameters():
    pt = pd.DataFrame([(s, g, 100.0 + g, float(s * (g + 1)), float(s)) for s in range(1, 6) for g in range(3)], columns=["scan", "ion_group", "mz", "intensity", "eic"])
    assert align.best_parameters(pt)[:4] == (0.75, 10.0, 10.0, 4)
    # two scans: one is enough; scans, not ions, are counted
    assert align.best_parameters(pt[pt["scan"] < 3])[3] == 1


def test_mzml_and_method_files(spark, tmp_path):
    def binary(values, name):
        text = files.zip_numbers(values)
        return f'<binaryDataArray><cvParam accession="MS:1000574"/><cvParam accession="{name}"/><binary>{text}</binary></binaryDataArray>'

    assert files.unzip_numbers(files.zip_numbers([1.5, 2.5])) == [1.5, 2.5]
    scan = '<spectrum><cvParam accession="MS:1000511" value="2"/><cvParam accession="MS:1000016" value="10.8"/><cvParam accession="MS:1000744" value="312.97"/>' + binary([100.1, 200.2], "MS:1000514") + binary([5.0, 7.0], "MS:1000515") + "</spectrum>"
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a.mzML").write_text(f"<mzML>{scan}{scan.replace('value="2"', 'value="1"')}</mzML>")
    rows = files.read_mzml(spark, str(tmp_path / "run")).orderBy("scan").collect()
    assert [(r.scan, r.ms_n, r.scantime, r.precursor_mz) for r in rows] == [(1, 2, 10.8, 312.97), (2, 1, 10.8, 312.97)]
    assert [tuple(x) for x in rows[0].ions] == [(100.1, 5.0), (200.2, 7.0)]
    (tmp_path / "m.json").write_text('{"sample": {"name": "s"}, "peaks": {"peak": {"mz": 1}, "peak": {"mz": 2}}, "annotation": {"compound": {"name": "c", "fragment": {"radical": , "mz": 3}}}}')
    methods = files.read_methods(spark, str(tmp_path / "m.json")).collect()
    assert sorted((r.kind, r.number) for r in methods) == [("compound", 0), ("fragment", 0), ("peak", 0), ("peak", 1), ("sample", 0)]
    assert next(r.fields for r in methods if r.kind == "fragment")["radical"] == "unknown"


def test_csv_and_msp(spark, tmp_path):
    (tmp_path / "t.csv").write_text("other,names\n1,NA\n2,x\n")
    got = files.read_table(spark, str(tmp_path / "t.csv"), schema._dimension("d").schema).collect()
    assert [tuple(r) for r in got] == [(1, None), (2, "x")]
    rows = spark.createDataFrame([(1, "n", 312.9, 200.5, 2.0), (1, "n", 312.9, 100.5, 1.0)], "id long, name string, precursor double, mz double, intensity double")
    assert files.msp(rows, "id", "name", "precursor").first().text == "Name:  n\nPrecursorMZ:  312.9\nNum Peaks:  2\n100.5 1.0\n200.5 2.0\n"
    (tmp_path / "p.csv").write_text("mz,rt,peak_starttime,peak_endtime\n312.973,10.8,10.5,11.1\n1,2,3,4\nx,1,1,1\n5,10,11,9\n")
    assert [r.mz for r in files.peak_list(spark, str(tmp_path / "p.csv")).collect()] == [312.973, 5.0]


@pytest.fixture(scope="module")
def library(spark):
    t = {}

    def add(name, rows):
        t[name] = spark.createDataFrame([tuple(r) for r in rows], schema.TABLES[name].schema)

    add("peaks", [(1, 1, 3, 312.973, 1, 10.5, 10.8, 11.1, None), (2, 1, 3, 400.0, 1, 5.0, 5.5, 6.0, None)])
    scans = [(p, n, 10.0 + k + 0.1 * n) for p in (1, 2) for k in range(4) for n in (1, 2)]
    ions = {(1, 1): "312.973 313.976", (1, 2): "118.9926 268.983", (2, 1): "400.0 401.0", (2, 2): "80.0 90.0"}
    add("ms_data", [(i, p, n, s, 1.0, 5.0, ions[p, n], f"{100 + i} {20 + i}") for i, (p, n, s) in enumerate(scans)])
    add("norm_fragments", [(1, 118.992564, -1, "C2F5", 0, "FC"), (2, 268.983, -1, "C6F11", 0, None)])
    add("annotated_fragments", [(1, 118.9926, 1), (2, 268.9831, 2), (3, 118.9925, 1)])
    add("compounds", [(1, None, "PFHxA", "C6HF11O2", 313.980089, 0)])
    add("compound_fragments", [(1, 1, 1), (1, 1, 2), (2, 1, 3), (None, 1, None)])
    return Library(t)


def test_views_and_searches(spark, library):
    assert library.problems().collect() == [("peaks", "x", 0)][:0]
    stats = {r.fragment_id: r.n for r in views.fragment_mz_stats(library.frames).collect()}
    assert stats == {1: 2, 2: 1} and views.fragment_count(library.frames).first().n == 2
    spread = {r.fragment_id: r.mz_sd for r in views.compound_fragment_stats(library.frames).collect()}
    assert spread[1] == pytest.approx(math.sqrt(2 * 0.00005**2), abs=1e-8) and spread[2] is None
    assert library.peak_data(1).count() == 16 and library.compound_data(1).count() == 32
    found = library.search_fragments([118.9926]).collect()
    assert {r.fragment_id for r in found} == {1, 3} and all(r.has_smiles and r.label == "structure" for r in found)
    ms1 = spark.createDataFrame([(312.973, 0.8), (313.976, 0.2)], "mz double, int double")
    ms2 = spark.createDataFrame([(118.9926, 0.7), (268.983, 0.3)], "mz double, int double")
    ranked = library.search_compound(ms1, ms2).collect()
    assert [r.peak_id for r in ranked] == [1, 2] and ranked[0].ms2_dp > 0.9 and ranked[1].ms2_dp is None
    assert [r.peak_id for r in library.search_compound(ms1, ms2, precursor=312.973).collect()] == [1]
    assert library.table_search("peaks", ["id"], {"precursor_mz": 400.0}).first().id == 2


def test_integrity(spark, library):
    broken = dict(library.frames) | {"compound_fragments": spark.createDataFrame([(9, 1, 1)], schema.TABLES["compound_fragments"].schema)}
    assert [(r.table, r.problem) for r in schema.problems(broken).collect()] == [("compound_fragments", "peak_id without peaks")]
    left = schema.delete(library.frames, "peaks", library.frames["peaks"].where("id = 1"))
    assert left["peaks"].count() == 1 and left["ms_data"].count() == 8
    assert left["compound_fragments"].where("peak_id = 1").count() == 0 and left["compound_fragments"].count() == 4


def test_text(spark):
    assert [one(spark, text.article(F.lit(x))) for x in ("analytical standard", "Water")] == ["an ", "a "]
    assert one(spark, text.acronym(F.lit("high resolution mass"))) == "HRM" and text.join_names(["a", "b", "c"]) == "a, b, and c"
    assert one(spark, text.blank_to_null(F.lit("null"))) is None


def test_stream_loads_keys(spark, tmp_path):
    from ionweave.streaming import ingest

    spark.createDataFrame([(1, "water")], "id long, name string").write.mode("overwrite").saveAsTable("kinds")
    (tmp_path / "in").mkdir()
    for k, kind in enumerate(("soil", "water", "")):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"n": k, "kind": kind}))
    rows = spark.readStream.schema("n long, kind string").json(str(tmp_path / "in"))
    try:
        ingest.load_with_keys(rows, "kind", "kinds", "loaded", str(tmp_path / "ck")).awaitTermination()
        want = [(0, 2), (1, 1), (2, None)]
        assert sorted((r.n, r.kind) for r in spark.table("loaded").collect()) == want
        # the same batch once more
        first = spark.table("loaded").where("n = 0").first()
        ingest.load_batch(spark.createDataFrame([(0, "soil"), (1, "water"), (2, "")], "n long, kind string"), first.batch, "kind", "kinds", "loaded", first.stream)
        assert sorted((r.n, r.kind) for r in spark.table("loaded").collect()) == want and spark.table("kinds").count() == 2
        # other streams number their batches from 0, too
        ingest.load_batch(spark.createDataFrame([(7, "air")], "n long, kind string"), first.batch, "kind", "kinds", "loaded", "other")
        ingest.load_with_keys(rows, "kind", "kinds", "loaded", str(tmp_path / "ck2")).awaitTermination()
        assert sorted(map(str, [*want, *want, (7, 3)])) == sorted(str((r.n, r.kind)) for r in spark.table("loaded").collect())
    finally:
        spark.sql("drop table if exists loaded")
        spark.sql("drop table if exists kinds")


def test_paired_spectra(spark):
    a = spark.createDataFrame([(1, 100.0, 1.0), (1, 200.0, 2.0), (2, 50.0, 1.0)], "k long, mz double, int double")
    b = spark.createDataFrame([(1, 100.001, 3.0), (1, 300.0, 4.0), (3, 70.0, 5.0)], "k long, mz double, int double")
    got = {(r.k, r.mz1, r.mz2) for r in align.pair_spectra(a, b, ["k"]).fillna(0.0).collect()}
    assert got == {(1, 100.0, 100.001), (1, 200.0, 0.0), (1, 0.0, 300.0), (2, 50.0, 0.0), (3, 0.0, 70.0)}


def test_isotope_match(spark):
    peaks = spark.createDataFrame([(1, "C10H8Cl2"), (2, "C6H6")], "peak_id long, formula string")
    ions = [(1, m, p) for m, p in chem.isotope_pattern("C10H8Cl2")] + [(2, 500.0, 1.0)]
    got = {r.peak_id: r.pattern_ok for r in qc.isotope_match(peaks, spark.createDataFrame(ions, "peak_id long, mz double, intensity double")).collect()}
    assert got == {1: True, 2: False}


def test_query_spectrum_falls_back(spark):
    """A peak that the given parameters leave empty takes its optimal ones."""
    from ionweave.plans import search

    rows = [(1, s, 0, 100.0, float(s), float(s)) for s in range(1, 6)] + [(2, s, 0, 100.0, float(6 - s), float(s)) for s in range(1, 6)]
    table = spark.createDataFrame(rows, "k long, scan long, ion_group long, mz double, intensity double, eic double")
    got = {r.k: r.n for r in search.query_spectrum(table, ["k"]).collect()}
    assert got[1] == 4 and got[2] >= 1
