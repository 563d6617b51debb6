"""Plans that must not grow faster than their tables, with the rows of brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionweave import catalogue
from ionweave.functions import chem
from ionweave.operators import align, keys, scoring, spectra
from ionweave.plans import gather, imports, objects, search


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_gathered_before_ions_meet_them(spark):
    ions = spark.createDataFrame([(100.0,), (100.0,), (100.001,), (300.0,), (None,)], "mz double")
    fragments = spark.createDataFrame([(1, 100.0, "C", None), (2, 100.0005, None, "S"), (3, 300.0, None, None)], "fragment_id long, fixedmass double, formula string, smiles string")
    links = spark.createDataFrame([(1, 5, 7), (1, 5, 8), (1, None, 7), (2, 6, None), (None, 1, 1)], "fragment_id long, peak_id long, compound_id long")
    found = search.search_fragments(ions, fragments, links)
    got = {(r.mz, r.fragment_id): (r.n_compounds, r.n_peaks, r.compounds, r.peaks, r.label, r.has_smiles) for r in found.collect()}
    one, two = (2, 1, [7, 8], [5], "formula", True), (0, 1, [], [6], "structure", True)
    assert found.count() == 5 and got == {(100.0, 1): one, (100.001, 1): one, (100.0, 2): two, (100.001, 2): two, (300.0, 3): (0, 0, [], [], "unknown", False)}
    plan = optimized(found)
    assert plan.index("Join LeftOuter") < plan.index("collect_set(compound_id")


@pytest.mark.parametrize("experiment", ["DDA", "SWATH", "DIA", "?"])
def test_scans_meet_peaks_in_bins_of_time_and_mass(spark, experiment):
    rnd = random.Random(3)
    peaks = [(k, rnd.choice([100.0, 100.1, 140.3, None]), t, t + rnd.choice([0.02, 0.1])) for k in range(60) for t in [rnd.choice([0.0, 1.0, 1.02])]]
    scans = [(k, rnd.choice([1, 2, 2, None]), rnd.choice([0.0, 0.01, 0.02, 0.1, 1.0, 1.02, 1.03, None]), rnd.choice([60.1, 80.1, 100.0, 120.3, 140.0, 140.1, 140.2, None])) for k in range(300)]
    half = {"DDA": 40.0, "SWATH": 20.0}.get(experiment)
    want = sorted(
        (p, s)
        for p, mass, a, b in peaks
        for s, n, t, pre in scans
        if t is not None and a <= t <= b and (n == 1 or experiment == "DIA" or (half is not None and mass is not None and pre is not None and abs(pre - mass) <= half))
    )
    found = search.scans_of_peaks(spark.createDataFrame(peaks, "peak_id long, precursor_mz double, rt_start double, rt_end double"), spark.createDataFrame(scans, "scan long, ms_n int, scantime double, precursor_mz double"), experiment, 40.0)
    assert sorted((r.peak_id, r.scan) for r in found.select("peak_id", "scan").collect()) == want and want
    assert ("_scan_mass" in optimized(found)) == (half is not None)


def test_peaks_that_are_alike_are_gathered_once(spark, monkeypatch):
    rows = [("a", 9, 100.0, "DDA"), ("a", 4, 100.0, "DDA"), ("a", 5, None, "DDA"), ("a", 6, None, "DDA"), ("b", 1, 100.0, "DDA"), ("a", 2, 100.0, None)]
    one, members = gather.distinct_peaks(spark.createDataFrame(rows, "file string, peak long, mz double, ms2exp string"))
    assert sorted(r.peak for r in one.collect()) == [1, 2, 4, 5] and one.columns == ["file", "peak", "mz", "ms2exp"]
    assert {(r.file, r.peak): r.of for r in members.collect()} == {("a", 9): 4, ("a", 4): 4, ("a", 5): 5, ("a", 6): 5, ("b", 1): 1, ("a", 2): 2}
    texts = spark.createDataFrame([(str(k), '{"peak": {"mz": %d}}' % k) for k in range(20)], "object string, text string")
    monkeypatch.setattr(objects, "PARSED", 30)
    assert {(r.object, r.peak["mz"]) for r in objects.import_objects(texts).collect()} == {(str(k), str(k)) for k in range(20)}


def test_lookups_and_keys_read_their_rows_once(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["Asia", " asia", "b", "x", "", None, "sia"])], "k long, t string").repartition(2)
    names = spark.createDataFrame([(1, "ASIA", None), (2, "B", "y"), (3, "b", ""), (4, "Z", "z")], "id long, name string, other string")
    out, lost = imports.resolve(rows, "t", names)
    assert {r.k: r.t_id for r in out.collect()} == {0: 1, 1: 1, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert {(r.value, r.matches) for r in lost.collect()} == {("b", 2), ("x", 0), ("sia", 0)}
    assert optimized(out).count("Repartition") == 1
    out, lost = imports.resolve(rows, "t", names, fuzzy=True)
    assert {r.k: r.t_id for r in out.collect()} == {0: 1, 1: 1, 2: None, 3: None, 4: None, 5: None, 6: 1}
    assert {(r.value, r.matches) for r in lost.collect()} == {("b", 2), ("x", 0)}
    found, grown = keys.keyed(names.select("id", "name"), rows.select(rows.t.alias("name")), ["name"])
    assert optimized(found).count("Repartition") == 1 and optimized(found).count("Join LeftOuter") == 1 and grown.count() == 4 + 6


def test_parts_of_one_mass_meet_their_ions_once(spark, tmp_path):
    spark.createDataFrame([(1, 100.0), (2, 100.0), (2, 100.0), (3, 200.0), (4, None)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1, 100.0, 1.0), (1, 2, 200.002, 2.0), (2, 1, 100.0, 1.0), (3, 1, 300.0, 1.0), (4, 1, 100.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.QUERIES["tolerance_join"](spark, str(tmp_path))
    assert {(r.p_partkey, r.fixedmass, r.n_ions, r.n_peaks) for r in found.collect()} == {(1, 100.0, 3, 2), (2, 100.0, 6, 2)} and found.count() == 2
    plan = optimized(found)
    assert plan.index("Join") < plan.index("avg(")


def test_vectors_meet_queries_in_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scoring, "BLOCK", 7)
    monkeypatch.setattr(scoring, "QUERIES", 2)
    rnd = random.Random(5)
    vectors = [(k, [rnd.choice([None, 0.0, rnd.random()]) for _ in range(rnd.choice([1, 3, 5]))]) for k in range(40)] + [(40, []), (41, None), (42, [0.0, 0.0]), (43, [None])]
    df = spark.createDataFrame(vectors, "k long, w array<double>")
    found = scoring.vector_cosines(df, df.where("k % 4 = 0").withColumnRenamed("k", "q"), "k", "q")
    want = {}
    for (a, x), (b, y) in [(v, w) for v in vectors if v[1] for w in vectors if w[1] and w[0] % 4 == 0]:
        both = list(zip(x, y, strict=False))
        parts = [[p * q for p, q in rows if p is not None and q is not None] for rows in (both, [(p, p) for p, _ in both], [(q, q) for _, q in both])]
        norm = sum(parts[1]) * sum(parts[2])
        want[a, b] = math.fsum(parts[0]) ** 2 / norm if parts[0] and norm else None
    got = {(r.k, r.q): r.dp for r in found.collect()}
    assert got.keys() == want.keys() and found.count() == len(want) and None in want.values()
    assert all((got[p] is None) == (s is None) and (s is None or got[p] == pytest.approx(s, abs=1e-12)) for p, s in want.items())
    spark.createDataFrame([(k, [0.5, float(k)], 0) for k in range(101)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = optimized(catalogue.QUERIES["dotprod"](spark, str(tmp_path)))
    assert "posexplode" not in plan and "Join" not in plan


def slow_groups(rows, collapse):
    """(scan, group, ion) of the ions (scan, mz) of a peak, ion by ion; the first scan is visited first."""
    groups, out = [], []
    for s in sorted({r[0] for r in rows}):
        left = sorted(r[1] for r in rows if r[0] == s)
        before, taken = [tuple(g) for g in groups], {}
        for g, (a, b) in enumerate(before):
            if collapse:
                a, b = groups[g]
            for x in left:
                if x not in taken and a - max(a * 5e-6, 0.002) <= x <= b + max(b * 5e-6, 0.002):
                    taken[x] = g
        for x, g in taken.items():
            groups[g] = [min(groups[g][0], x), max(groups[g][1], x)]
        for x in left:
            if x not in taken:
                taken[x] = len(groups)
                groups.append([x, x])
        out += [(s, taken[x], x) for x in left]
    return out


@pytest.mark.parametrize("collapse", [True, False])
def test_many_peaks_in_a_batch_equal_each_alone(collapse):
    """Ions closer and farther than the tolerance, in clusters narrower and wider than it."""
    rnd = random.Random(8)
    peaks = [sorted({(rnd.randrange(4), round(rnd.choice([100, 100, 300]) + rnd.randrange(16) * 0.0009, 4)) for _ in range(rnd.randrange(1, 14))}) for _ in range(300)]
    number, visit, mz = (np.array([x for k, rows in enumerate(peaks) for x in [(k, k * 10 + s, m)[c] for s, m in rows]]) for c in range(3))
    leader = align._leaders(number.astype(int), visit.astype(int), mz, np.full(len(mz), 5.0), np.full(len(mz), 0.002), align._grow if collapse else align._pool)
    got = align._numbers_within(number.astype(int), leader == np.arange(len(leader)))[leader]
    assert list(got) == [g for rows in peaks for _, g, _ in slow_groups(rows, collapse)]


def test_parameters_of_many_peaks_in_a_batch_equal_each_alone(monkeypatch):
    rnd = random.Random(4)
    rows = [(k, s, g, 100.0, rnd.choice([0.0, 1.0, 5.0, float(s)]), float(s * s % 7) if k % 9 else np.nan) for k in range(60) for g in range(4) for s in range(rnd.randrange(1, 6))]
    pt = pd.DataFrame(rows, columns=["k", "scan", "ion_group", "mz", "intensity", "eic"])
    want = [align.best_parameters(one.drop(columns="k")) for _, one in pt.groupby("k")]
    tried = []
    counts = align._grid_counts
    monkeypatch.setattr(align, "_grid_counts", lambda *x: tried.append(1) or counts(*x))
    assert align._best(pt["k"].to_numpy(), pt) == want
    assert len(tried) < len(want) and {w[0] for w in want} >= {0.75, None}


def test_texts_are_read_once_for_each_row(spark):
    """A value that a lambda uses is computed outside of it, so its work doesn't grow with the number of parts."""
    rows = spark.createDataFrame([("1 2 3 4", "C12H3C", "0067-64-1"), (" 1 x 3", "", "67-64-1"), ("", None, "67-64-2"), ("5", "NaCl2", " 00000000000000000000050-00-0 "), (None, "H2O", "0-1"), ("1  2 ", "C2", None)], "t string, f string, c string")
    counts = chem.elements(F.col("f"))
    less = chem.hill(chem.with_adduct(counts, "-C2"))
    out = rows.select(spectra.unpack_zipped(F.col("t")).alias("ions"), counts.alias("counts"), less.alias("less"), chem.hill(counts).alias("hill"), chem.is_match(chem.elements(F.lit("C2")), counts).alias("same"), chem.is_subset(counts, chem.elements(F.lit("C13H3"))).alias("part"), chem.casrn(F.col("c")).alias("c"))
    got = out.collect()
    assert [r.ions and [tuple(x) for x in r.ions] for r in got] == [[(1.0, 2.0), (3.0, 4.0)], [(1.0, None)], [], [], None, [(1.0, 2.0)]]
    assert [r.counts for r in got] == [{"C": 13, "H": 3}, {}, None, {"Na": 1, "Cl": 2}, {"H": 2, "O": 1}, {"C": 2}]
    assert [r.less for r in got] == ["C11H3", None, None, None, None, ""] and [r.hill for r in got] == ["C13H3", "", None, "Cl2Na", "H2O", "C2"]
    assert [r.same for r in got] == [False, False, False, False, False, True] and [r.part for r in got] == [True, True, None, False, False, True]
    assert [r.c for r in got] == ["67-64-1", "67-64-1", None, "50-00-0", None, None]
    plan = optimized(out)
    # five columns, each of which takes names and counts out of the formula
    assert plan.count("regexp_extract_all(f") == 10 and plan.count("split(trim(t") == 1 and "substr" not in plan
