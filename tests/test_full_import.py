"""A whole import from JSON files, run twice, after a break, and with objects that lack things."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ionweave.operators import keys
from ionweave.plans import full_import, objects, schema


def sample_object(k: int, **changes) -> dict:
    out = {
        "msconvertsettings": ["converted", f"by tool {k}"],
        "sample": {"name": f"run {k % 2}", "description": "d", "sample_class": "WATER", "data_generator": "ann", "source": "", "starttime": "2024-05-01 10:00:00"},
        "chromatography": {"ctype": "LC", "cvendor": "Acme", "cmodel": "M1", "mp1solvent": "water", "mp1fraction": "90", "mp12solvent": "methanol", "mp12fraction": "10", "mp1add": "salt", "mp1add_amount": "5", "mp1add_units": "mM",
                           "m2solvent": "methanol", "mp3solvent": "none", "gcolvendor": "none", "gcolchemistry": "none", "colvendor": "Acme", "colname": "C18 x", "colchemistry": "c18", "colid": "2.1", "collen": "50", "coldp": ""},
        "massspectrometry": {"msvendor": "Acme", "msmodel": "Q", "ionization": "ESI", "polarity": "negative", "voltage": "2500", "massanalyzer1": "quad", "massanalyzer2": "trap", "fragmode": "HCD", "ms2exp": "DDA", "isowidth": "0.7", "msaccuracy": 5},
        "qcmethod": [{"name": "QC Method Used", "value": True}, {"name": "Calibration", "value": False}],
        "peak": {"mz": 312.97 + k, "rt": 10.8, "peak_starttime": 10.5, "peak_endtime": 11.1, "ionstate": "[M-H]-", "confidence": "1a"},
        "compounddata": {"NAME": f"acid {k % 2}; other {k}", "FORMULA": "C6HF11O2", "CASRN": "307-24-4", "NETCHARGE": 0},
        "msdata": [{"ms_n": 1, "scantime": 10.6, "base_int": 5.0, "measured_mz": "312.9 313.1", "measured_intensity": "5 1"}, {"ms_n": 2, "scantime": 10.7, "base_int": 2, "measured_mz": "118.9", "measured_intensity": "2"}, {"ms_n": 1, "scantime": 10.8, "base_int": 1, "measured_mz": "", "measured_intensity": ""}],
        "annotation": [{"fragment_mz": 118.9912, "fragment_formula": "C2F5", "fragment_SMILES": "F[C-]", "fragment_radical": False, "fragment_citation": "doi:1"}, {"fragment_mz": 268.98 + k, "fragment_formula": "C5F11", "fragment_SMILES": "", "fragment_citation": ""}, {"fragment_mz": ""}],
        "fragment_aliases": [{"SMILES": "F[C-]", "INCHI": "1S/x", "UNKNOWN": "y"}],
        "inspections": [{"smiles": "F[C-]", "user_note": "seen"}],
    }
    return out | changes


LOOKUPS = {
    "norm_sample_classes": ["water"], "norm_generation_type": ["empirical"], "norm_ion_states": ["[M-H]-"], "norm_ionization": ["ESI"], "norm_polarity_types": ["negative"], "norm_fragmentation_types": ["HCD"], "norm_ms_n_types": ["DDA"],
    "norm_ms_types": ["quad", "trap"], "norm_vendors": ["Acme"], "norm_chromatography_types": ["LC"], "norm_column_chemistries": ["C18"], "norm_column_positions": ["guard", "analytical"], "norm_carriers": ["water"], "norm_additive_units": ["mM"],
    "norm_analyte_alias_references": ["NAME", "CASRN", "INCHI"], "norm_qc_methods_name": ["QC Method Used", "Calibration"],
}


def library(spark) -> dict:
    out = full_import.empty(spark)
    for name, values in LOOKUPS.items():
        out[name] = spark.createDataFrame(list(enumerate(values, 1)), "id long, name string")
    out["contributors"] = spark.createDataFrame([(1, "ann", "ann@x", None, None), (2, "bob", "bob@x", None, None)], full_import.SCHEMAS["contributors"])
    return out


def rows(df) -> list:
    return sorted(map(str, map(tuple, df.collect())))


def test_import_runs_again_without_change(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.json").write_text(json.dumps(sample_object(k)).replace('"ctype"', '"extra": , "ctype"'))
    (tmp_path / "4.json").write_text(json.dumps(sample_object(1)))  # as 1, again
    (tmp_path / "5.json").write_text(json.dumps(sample_object(5, sample=sample_object(5)["sample"] | {"data_generator": "nobody"})))
    store = full_import.ImportStore(spark, str(tmp_path / "store"))
    store.save(library(spark))
    found = objects.read_objects(spark, str(tmp_path / "*.json"))
    # a break: some of the next version is there, but it isn't listed
    library(spark)["contributors"].write.parquet(str(tmp_path / "store/v000000002/samples"))
    assert store.versions() == ["v000000001"] and store.tables()["samples"].count() == 0
    out = store.load(found)
    assert store.versions() == ["v000000001", "v000000002"]
    t = store.tables()
    n = {name: df.count() for name, df in t.items()}
    want = {"samples": 2, "ms_methods": 1, "ms_descriptions": 2, "chromatography_descriptions": 1, "peaks": 4, "ms_data": 8, "conversion_software_peaks_linkage": 2, "conversion_software_settings": 6, "instrument_properties": 8, "qc_methods": 8,
            "carrier_mix_collections": 2, "carrier_mixes": 3, "carrier_additives": 1, "mobile_phases": 8, "norm_carriers": 2, "norm_additives": 1, "compounds": 2, "norm_fragments": 2, "annotated_fragments": 5, "fragment_sources": 1, "fragment_inspections": 1, "fragment_aliases": 1, "compound_fragments": 8}
    assert {k: n[k] for k in want} == want
    assert rows(t["carrier_mixes"]) == ["(1, 1, 0.9)", "(1, 2, 0.1)", "(2, 2, None)"]
    assert rows(t["fragment_aliases"]) == ["(1, 3, 'InChI=1S/x')"] and t["ms_methods"].first().has_qc_method == 1
    assert t["peaks"].where("num_points <> 1 or ion_state <> 1").isEmpty()
    assert rows(out.rejects.where("value = 'nobody'").select("step")) == ["('sample.sample_contributor',)"]
    assert schema.problems({name: t[name] for name in ("ms_data", "annotated_fragments", "fragment_sources", "norm_fragments")} | {"peaks": t["peaks"].withColumn("x", F.lit(1))}).where("problem not like '% is null'").collect() == []
    again = full_import.full_import(found, t)
    for name in full_import.SCHEMAS:
        assert rows(again.tables[name].select(*t[name].columns)) == rows(t[name]), name


def test_objects_that_lack_things(spark):
    odd = [("a", json.dumps(sample_object(0))), ("b", "no json"), ("c", None), ("d", json.dumps({"sample": {"name": "x"}, "peak": {"mz": "high"}, "msdata": [{"ms_n": 1}, 3], "annotation": []})), ("e", "[1]")]
    found = objects.import_objects(spark.createDataFrame(odd, "object string, text string"))
    bad = {(r.object, r.path): r.problem for r in objects.rejects(found).collect()}
    assert {k[1] for k in bad if k[0] == "a"} == {"msdata[2].measured_mz", "msdata[2].measured_intensity", "annotation[2].fragment_mz", "annotation[2].fragment_formula"}
    assert bad["b", "sample"] == bad["c", "msdata"] == bad["e", "peak"] == "missing"
    assert bad["d", "peak.mz"] == "not a number" and bad["d", "peak.rt"] == bad["d", "msdata[0].scantime"] == "missing" and ("d", "annotation") not in bad
    out = full_import.full_import(found, library(spark))
    assert [r.object for r in out.objects.collect()] == ["a"]
    assert {r.object for r in out.rejects.where("step = 'sample.sample_contributor'").collect()} == {"b", "c", "d", "e"}


def test_uniques_ignore_the_order_of_keys(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": None}), (2, {"b": None, "a": "1"}), (3, {"a": "2"}), (4, {}), (5, None), (6, None)], "k long, m map<string,string>")
    got = {tuple(r.members): (r.n, r.m) for r in objects.uniques(df, "m", "k").collect()}
    assert got == {(1, 2): (2, {"a": "1", "b": None}), (3,): (1, {"a": "2"}), (4,): (1, {}), (5, 6): (2, None)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_are_consecutive(spark, partitions):
    values = spark.createDataFrame([(None if k % 50 == 0 else f"v{k * 7919 % 1000:04d}",) for k in range(1, 500)], "v string").distinct().repartition(partitions)
    got = sorted((r.id, r.v) for r in keys.numbered(values, ["v"], after=10).collect())
    assert [i for i, _ in got] == list(range(11, 11 + len(got)))
    assert [v for _, v in got] == [None, *sorted(v for _, v in got if v is not None)]
    target = spark.createDataFrame([(3, "b", None), (5, "b", None), (9, None, 1)], "id long, x string, y int")
    wanted = spark.createDataFrame([("b", None), (None, 1), ("a", 2), ("a", 2), (None, None)], "x string, y int")
    out, grown = keys.keyed(target, wanted, ["x", "y"])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("b", None, 5), (None, 1, 9), ("a", 2, 11), ("a", 2, 11), (None, None, 10)]))
    assert grown.count() == 5 and keys.keyed(grown, wanted, ["x", "y"])[1].count() == 5
