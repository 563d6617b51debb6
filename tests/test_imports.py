import pytest

from ionweave.plans import imports


def test_contract(spark):
    contract = {"sample": {"names": ["name"], "required": True}, "peaks": {"names": ["mz", "rt"], "required": True}, "note": {"required": False}}
    got = imports.check_contract({"peaks": [{"mz": 1, "rt": 2}, {"mz": 1}], "other": 1}, contract)
    assert got == {"required": ["sample"], "recommended": ["note"], "extra": ["other"], "names": ["peaks.rt"]}
    assert imports.contract_of(spark.createDataFrame([(1, (2, 3))], "a long not null, b struct<x:long,y:long>")) == {"a": {"names": [], "required": True}, "b": {"names": ["x", "y"], "required": False}}


def test_resolve(spark):
    dim = spark.createDataFrame([(1, "electrospray", "ESI"), (2, "chemical ionization", "CI"), (3, "chemical", "X")], "id long, name string, acronym string")
    rows = spark.createDataFrame([(1, "esi"), (2, "Chemical"), (3, "ionization"), (4, "none such"), (5, None), (6, " ")], "k long, kind string")
    out, rejected = imports.resolve(rows, "kind", dim, fuzzy=True)
    assert {r.k: r.kind_id for r in out.collect()} == {1: 1, 2: 3, 3: 2, 4: None, 5: None, 6: None}
    assert [(r.value, r.matches) for r in rejected.collect()] == [("none such", 0)]


def test_aliases_and_votes(spark):
    rows = spark.createDataFrame([(1, "CASRN:335-67-1; PFOA;; inchi:InChI=1S/x:y"), (2, None)], "id long, alias string")
    got = {tuple(r) for r in imports.split_aliases(rows, "id", "alias").collect()}
    assert got == {(1, "CASRN", "335-67-1"), (1, None, "PFOA"), (1, "INCHI", "InChI=1S/x:y")}
    votes = spark.createDataFrame([(1, 5), (1, 5), (1, 4), (2, 9), (2, 8), (2, None)], "g long, v long")
    assert {tuple(r) for r in imports.vote(votes, ["g"], "v").collect()} == {(1, 5), (2, 8)}
    links = spark.createDataFrame([(1, 2, None), (1, None, None), (1, 2, None), (None, 2, 3)], "p long, c long, f long")
    assert imports.ternary_links(links, ["p", "c", "f"]).count() == 2


def test_fields_qc_and_removal(spark):
    fields = [{"import_parameter": "a", "sql_table": "t", "sql_parameter": "x"}, {"import_parameter": "b", "sql_table": "t", "sql_parameter": "y"}, {"import_parameter": "c", "sql_table": "u", "sql_parameter": "z"}]
    df = spark.createDataFrame([(1, "q")], "a long, c string")
    assert imports.map_fields(df, fields, "t").first().asDict() == {"x": 1, "y": None}
    qc = spark.createDataFrame([(1, 5.0, None), (1, None, "ok"), (1, None, "bad")], "peak_id long, err double, frag string")
    assert {(r.applies_to, r.name, r.value) for r in imports.qc_rows(qc, "peak_id").collect()} == {("peak", "err", "5.0"), ("fragment_1", "frag", "ok"), ("fragment_2", "frag", "bad")}
    frames = {"samples": spark.createDataFrame([(1, 7), (2, 8), (3, 8)], "id long, ms_methods_id long"), "ms_methods": spark.createDataFrame([(7,), (8,)], "id long")}
    assert {r.id for r in imports.without_sample(frames, 1)["ms_methods"].collect()} == {8}
    assert imports.without_sample(frames, 2)["ms_methods"].count() == 2


def test_fuzzy_lookup(spark, monkeypatch):
    dim = spark.createDataFrame([(1, "Agilent Technologies", "AT"), (2, "Waters", None), (3, "Waters East", None)], "id long, name string, short string")
    rows = spark.createDataFrame([("agilent",), ("at",), ("WATERS ",), ("east",), ("nobody",), ("ter",), (None,), ("",)], "vendor string")
    out, lost = imports.resolve(rows, "vendor", dim, fuzzy=True)
    # an equal text comes before texts that contain the value
    assert {r.vendor: r.vendor_id for r in out.collect()} == {"agilent": 1, "at": 1, "WATERS ": 2, "east": 3, "nobody": None, "ter": None, None: None, "": None}
    assert {r.value: r.matches for r in lost.collect()} == {"nobody": 0, "ter": 2}
    monkeypatch.setattr(imports, "LOOKUP_TEXTS", 3)
    with pytest.raises(ValueError, match="fuzzy"):
        imports.resolve(rows, "vendor", dim, fuzzy=True)
