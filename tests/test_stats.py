import pytest
from pyspark.sql import functions as F

from ionweave.functions import stats


def test_t_distribution():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert stats.t_quantile(0.95, 3) == pytest.approx(2.353363435, abs=1e-7)
    assert stats.t_share(0.0, 5) == pytest.approx(0.5) and stats.t_share(-2.0, 5) == pytest.approx(1 - stats.t_share(2.0, 5))


def test_columns(spark):
    df = spark.createDataFrame([(1, 10.0, 10.1, 1.0, 1.0, 5, 6), (2, 10.0, 20.0, 1.0, 1.0, 5, 6), (3, 1.0, 1.0, 0.0, 0.0, 5, 5)], "k long, a double, b double, s double, t double, n long, m long")
    same = stats.same_mean(*[F.col(c) for c in ("a", "b", "s", "t", "n", "m")])
    assert {r.k: r.same for r in df.select("k", same.alias("same")).collect()} == {1: True, 2: False, 3: None}
    rows = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 4.0), (0, 3.0, 9.0), (0, 4.0, 9.0), (0, None, 1.0)], "g long, x double, y double")
    assert stats.spearman(rows, ["g"], "x", "y").first().r == pytest.approx(0.9486832981)
    assert stats.kendall(rows, ["g"], "x", "y").first().r == pytest.approx(0.9128709292)
    assert stats.slopes(rows.where("x < 4"), ["g"], "x", "x", "y", 1).orderBy("x").first().slope == pytest.approx(3.0)


def test_lock_mass(spark):
    ions = lambda *x: [(float(m), float(i)) for m, i in x]
    rows = [("f", 1, 1, 1, 556.28, ions((556.2775, 9), (100, 1))), ("f", 2, 1, 2, 300.0, ions((300, 5))), ("f", 3, 1, 2, None, ions((556.2771, 1), (200, 7))), ("f", 4, 2, 3, 556.2771, ions((80, 1))), ("f", 5, 1, 2, 310.0, [])]
    rows += [("g", 1, 1, 1, 100.0, ions((100, 1)))]
    scans = spark.createDataFrame(rows, "file string, scan int, ms_n int, function int, base_ion double, ions array<struct<mz:double,intensity:double>>")

    def left(approach):
        return {(r.file, r.scan): r.lockmass_error for r in stats.without_lockmass(scans, 556.2771, 0.01, approach).collect()}

    base, strongest = left("baseion"), left("empbaseion")
    assert set(base) == {("f", 2), ("f", 3), ("f", 5), ("g", 1)} and base["f", 2] == pytest.approx(1e6 * (556.27855 - 556.2771) / 556.2771) and base["g", 1] is None
    assert set(strongest) == {("f", 2), ("f", 3), ("f", 4), ("f", 5), ("g", 1)} and strongest["f", 4] == pytest.approx(1e6 * 0.0004 / 556.2771)
    assert set(left("ms1freq")) == set(left("hybrid")) == {("f", 2), ("f", 3), ("f", 4), ("f", 5), ("g", 1)}


def test_peak_bounds(spark):
    values = [0.0, 0.0, 1.0, 5.0, 9.0, 6.0, 2.0, 2.0, 3.0]
    trace = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "f long, t long, v double")
    assert tuple(stats.peak_bounds(trace, ["f"], "t", "v", 0.5).first()) == (0, 2, 7)
