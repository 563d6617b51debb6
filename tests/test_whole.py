"""Registered queries take all rows of their tables."""

import itertools

import numpy as np
import pandas as pd
import pytest

from ionweave import catalogue
from ionweave.functions import chem
from ionweave.operators import align


@pytest.fixture(scope="module")
def ion_dir(spark, tmp_path_factory):
    """lineitem with the first, a middle and a far peak of 20 orders, an order key of 0 and one alone."""
    rng = np.random.default_rng(3)
    orders = [0, *range(1, 60), *range(5000, 5020), 140_001]
    rows = [(o, int(rng.integers(1, 60)), int(rng.integers(1, 8)), k, float(rng.integers(1, 50)), int(rng.integers(0, 10)) / 100) for o in orders for k in range(1, 5)]
    folder = tmp_path_factory.mktemp("ions")
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder), pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])


def slow_align(pdf):
    """Groups one after another, ion by ion."""
    order = sorted(pdf["scan"].unique())
    eic = {s: g["eic"].iloc[0] for s, g in pdf.groupby("scan")}
    apex = order.index(max(order, key=lambda s: (eic[s], -order.index(s))))
    groups, rows = [], []
    for s in sorted(order, key=lambda s: (abs(order.index(s) - apex), order.index(s))):
        left = sorted(pdf[pdf["scan"] == s][["mz", "intensity"]].itertuples(index=False))
        for g, (a, b) in enumerate(list(groups)):
            mine = [i for i in left if a - max(a * 5e-6, 0.002) <= i.mz <= b + max(b * 5e-6, 0.002)]
            if mine:
                left = [i for i in left if i not in mine]
                groups[g] = (min(a, mine[0].mz), max(b, mine[-1].mz))
                rows.append((s, g, np.mean([i.mz for i in mine]), sum(i.intensity for i in mine)))
        rows += [(s, len(groups) + k, i.mz, i.intensity) for k, i in enumerate(left)]
        groups += [(i.mz, i.mz) for i in left]
    return rows


def slow_best(pt, top=(0.75, 10.0, 10.0), bins=(0.05, 1.0, 1.0), min_scans=3):
    """One spectrum for each grid point, from the largest parameters down, none last."""
    every = pt["scan"].nunique()
    enough = min_scans if every >= min_scans else 1
    first = align.spectrum_of(pt, *top)
    if len(first) and first["numscans"].iloc[0] >= enough:
        return (*top, first["numscans"].iloc[0], 3.0 + first["numscans"].iloc[0] / every)
    found = []
    for freq, height, correl in itertools.product(*[[*np.round(np.arange(t, -b / 2, -b), 6), None] for t, b in zip(top[::-1], bins[::-1], strict=True)]):
        ums = align.spectrum_of(pt, correl, height, freq)
        if len(ums) and ums["numscans"].iloc[0] >= enough:
            found.append((correl, height, freq, ums["numscans"].iloc[0]))
    if not found:
        return (None, None, None, 0, 0.0)
    score = [round(sum((v or 0) / t for v, t in zip(f[:3], top, strict=True)) + f[3] / every, 9) for f in found]
    return (*found[int(np.argmax(score))], max(score))


def ions_of(pdf):
    ions = pd.DataFrame({"peak": pdf.l_orderkey // 20, "scan": pdf.l_linenumber, "mz": 200.0 + pdf.l_partkey % 25 + pdf.l_discount / 100, "intensity": pdf.l_quantity})
    return ions.assign(eic=ions.groupby(["peak", "scan"])["intensity"].transform("sum"))


def test_align_ions_takes_all_rows(spark, ion_dir):
    folder, pdf = ion_dir
    got = sorted((r.peak, r.scan, r.ion_group, round(r.mz, 9), r.intensity) for r in catalogue.QUERIES["align_ions"](spark, folder).collect())
    want = sorted((p, s, g, round(m, 9), i) for p, one in ions_of(pdf).groupby("peak") for s, g, m, i in slow_align(one))
    assert got == want and sum(r[4] for r in got) == pdf.l_quantity.sum()


def test_pooled_spectra_takes_all_rows(spark, ion_dir):
    folder, pdf = ion_dir
    want = []
    for p, one in ions_of(pdf).groupby("peak"):
        groups = []
        for _, scan in one.sort_values(["scan", "mz"]).groupby("scan"):
            frozen = [(min(g), max(g)) for g in [[m for m, _ in x] for x in groups]]
            for r in scan.itertuples():
                hit = next((k for k, (a, b) in enumerate(frozen) if a - max(a * 5e-6, 0.002) <= r.mz <= b + max(b * 5e-6, 0.002)), None)
                groups.append([(r.mz, r.intensity)]) if hit is None else groups[hit].append((r.mz, r.intensity))
        want += [(p, round(np.mean([m for m, _ in g]), 9), 0.01, round(np.mean([i for _, i in g]), 9), 0.5, 3 * len(g)) for g in groups]
    got = [(r.peak, round(r.mz, 9), round(r.mz_u, 9), round(r.int, 9), round(r.int_u, 9), r.n) for r in catalogue.QUERIES["pooled_spectra"](spark, folder).collect()]
    assert sorted(got) == sorted(want)


def test_optimal_parameters_takes_all_peaks_and_the_whole_grid(spark, ion_dir):
    folder, pdf = ion_dir
    got = {r.peak: (r.correl, r.height, r.freq, r.n, r.score) for r in catalogue.QUERIES["optimal_parameters"](spark, folder).collect()}
    tables = {p: align.align_ions(one) for p, one in ions_of(pdf).groupby("peak")}
    assert got == {p: align.best_parameters(t) for p, t in tables.items()} and len(got) == 5
    for t in tables.values():
        assert align.best_parameters(t, bins=(0.25, 5.0, 2.5)) == pytest.approx(slow_best(t, bins=(0.25, 5.0, 2.5)))


def test_best_parameters_equals_one_spectrum_for_each_point():
    rng = np.random.default_rng(8)
    for _ in range(8):
        rows = [(s, g, 100.0 + g, float(rng.integers(1, 9))) for s in range(1, 7) for g in range(9) if rng.random() < 0.4]
        pt = pd.DataFrame(rows, columns=["scan", "ion_group", "mz", "intensity"])
        pt["eic"] = pt.groupby("scan")["intensity"].transform("sum")
        for top in ((0.75, 10.0, 10.0), (0.99, 60.0, 90.0)):
            bins = tuple(t / 3 for t in top)
            assert align.best_parameters(pt, top, bins) == pytest.approx(slow_best(pt, top, bins))


def test_compare_ms_all_scores_the_whole_library(spark, ion_dir):
    folder, pdf = ion_dir
    ions = pd.DataFrame({"peak": pdf.l_orderkey, "mz": 100.0 + pdf.l_suppkey % 40 + pdf.l_discount / 100, "i": pdf.l_quantity}).groupby(["peak", "mz"], as_index=False).sum()
    spectra = {p: [(m, i / g["i"].sum()) for m, i in zip(g["mz"], g["i"], strict=True)] for p, g in ions.groupby("peak")}

    def half(left, right):
        tol = max(max(m for m, _ in right) * 5e-6, 0.002)
        rows = []
        for m, i in left:
            near = [(x, j) for x, j in right if abs(m - x) <= max(m * 5e-6, 0.002) + tol]
            rows.append((m * i**0.5, np.mean([x for x, _ in near]) * sum(j for _, j in near) ** 0.5 if near else 0.0))
        below = sum(a * a for a, _ in rows) * sum(b * b for _, b in rows)
        return sum(a * b for a, b in rows) ** 2 / below if below else None

    got = {r.peak: (r.dp, r.rdp) for r in catalogue.QUERIES["compare_ms_all"](spark, folder).collect()}
    assert set(got) == set(spectra) and max(got) == 140_001
    for p, s in spectra.items():
        assert got[p] == pytest.approx((half(spectra[1], s), half(s, spectra[1])), abs=2e-8)


def test_search_fragments_all_searches_all_ions(spark, tmp_path):
    lines = [(o, o % 3 + 1, o % 2, 1.0, price) for o, price in ((1, 900.0), (1999, 901.003), (2001, 902.0), (90_000, 900.001), (140_000, 903.5))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(1, 900.0, "A", 30, "x"), (2, 902.004, "B", 1, "y"), (3, 903.501, None, 1, "z")]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double, p_type string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for mz in {np.floor(price * 1e4) / 1e4 for *_, price in lines}:
        for k, mass, *_ in parts:
            if abs(mz - mass) <= max(mz * 5e-6, 0.002):
                want.add((mz, k, len({s for _, q, s, _, _ in lines if q == k}), len({o for o, q, *_ in lines if q == k})))
    assert {(r.mz, r.fragment_id, r.n_compounds, r.n_peaks) for r in catalogue.QUERIES["search_fragments_all"](spark, str(tmp_path)).collect()} == want and len(want) == 4


def test_dotprod_all_takes_every_hundredth_vector_as_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=6).tolist() for i in (0, 1, 4, 7, 100, 250, 300)}
    spark.createDataFrame([(i, 0, v) for i, v in vectors.items()], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    weights = {i: np.arange(1, 7) * np.sqrt(np.abs(v) / np.abs(v).sum()) for i, v in vectors.items()}
    want = {(i, q): (w @ weights[q]) ** 2 / ((w @ w) * (weights[q] @ weights[q])) for i, w in weights.items() for q in (0, 100, 300)}
    got = {(r.vec_id, r.query): r.dp for r in catalogue.QUERIES["dotprod_all"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=2e-9)


def test_isotope_patterns_takes_all_parts(spark, tmp_path):
    rows = [(k, k % 50 + 1, 900.0) for k in (1, 200, 201, 5000, 19_999)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    want = {(k, *x) for k, f in catalogue._formulas(spark, str(tmp_path)).select("p_partkey", "formula").collect() for x in chem.isotope_pattern(f)}
    got = {(r.p_partkey, r.mz, r.intensity) for r in catalogue.QUERIES["isotope_patterns"](spark, str(tmp_path)).collect()}
    assert got == want and {k for k, *_ in got} == {k for k, *_ in rows}
