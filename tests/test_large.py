"""Steps of queries that grew faster than their tables, or with them in one task."""

from __future__ import annotations

import math
import random

import pytest

from ionweave.operators import keys, scoring, spectra
from ionweave.plans import imports, search, views
from ionweave.sources import files


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df) -> list[tuple]:
    """The rows in order, with sums, whose order is open, rounded."""
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def _brute(x, y, ppm_x, ppm_y, least=0.002):
    """The score over the ions of x, of spectra [(mz, intensity)]."""
    tol = lambda mz, ppm: max(mz * ppm * 1e-6, least)
    sums = [sum(i for _, i in s if i is not None) for s in (x, y)]
    if not all(sums):
        return None
    dot = norm = other = 0.0
    for mz, i in x:
        if mz is None or i is None:
            continue
        w = mz * math.sqrt(i / sums[0])
        norm += w * w
        near = [b for b in y if b[0] is not None and abs(b[0] - mz) <= tol(mz, ppm_x) + tol(max(a for a, _ in y if a is not None), ppm_y)]
        if near:
            v = sum(b[0] for b in near) / len(near) * math.sqrt(sum(b[1] or 0.0 for b in near) / sums[1])
            dot, other = dot + w * v, other + v * v
    return dot**2 / (norm * other) if norm * other else None


@pytest.mark.parametrize("few", [False, True])
def test_compare_gathers_each_spectrum_once(spark, few):
    draw = random.Random(5)
    ion = lambda: (None if draw.random() < 0.05 else 100.0 + draw.randrange(12) + draw.choice([0, 0.003, 0.0045, 0.3]), None if draw.random() < 0.1 else float(draw.randrange(9)))
    queries = {k: [ion() for _ in range(9)] for k in (1, 2)}
    library = {k: [ion() for _ in range(draw.randrange(1, 14))] for k in range(40)}
    long = lambda side, key: spark.createDataFrame([(k, *i) for k, ions in side.items() for i in ions], f"{key} long, mz double, intensity double")
    pairs = spark.createDataFrame([(q, p) for q in (1, 2, 3) for p in range(41)], "q long, p long")  # 3 and 40 have no ions
    out = scoring.compare(long(queries, "q"), long(library, "p"), ["q"], ["p"], pairs, ppm=(5.0, 20.0), few=few)
    assert "Generate" not in _plan(out) and _plan(out).count("Exchange hashpartitioning(p") <= 2  # each ion was met in bins, and dealt out six times
    got = {(r.q, r.p): (r.dp, r.rdp) for r in out.collect()}
    assert len(got) == 123
    for (q, p), scores in got.items():
        a, b = queries.get(q, []), library.get(p, [])
        wanted = (None, None) if not a or not b else (_brute(a, b, 5.0, 20.0), _brute(b, a, 20.0, 5.0))
        assert [s is None for s in scores] == [w is None for w in wanted], (q, p)
        assert [s for s in scores if s is not None] == pytest.approx([w for w in wanted if w is not None])


def test_search_compound_finds_the_scans_once_and_deals_out_by_peak(spark, monkeypatch):
    draw = random.Random(3)
    scans = spark.createDataFrame(
        [(p, s % 2 + 1, float(s), [(m + draw.choice([0.0, 0.001]), float(draw.randrange(1, 9))) for m in (100.0, 200.0 + p % 3, 300.0)]) for p in range(30) for s in range(6)],
        "peak_id long, ms_n int, scantime double, ions array<struct<mz:double,intensity:double>>",
    )
    peaks = spark.createDataFrame([(p, 300.0 + p % 2) for p in range(30)], "peak_id long, precursor_mz double")
    names, kept = [], search.staged
    monkeypatch.setattr(search, "staged", lambda df, name="stage": names.append(name) or kept(df, name))
    query = [spark.createDataFrame([(100.0, 0.5), (201.0, 0.5)], "mz double, int double")] * 2
    small = _rows(search.search_compound(*query, peaks, scans, precursor=300.0))
    assert names == ["near", "scans", "aligned", "aligned"]  # scans were found for each level anew, and spectra written
    monkeypatch.setattr(keys, "TASK_ROWS", 5)
    assert _rows(search.search_compound(*query, peaks, scans, precursor=300.0)) == small and len(small) == 15
    found = search.library_spectra(scans, peaks, 2)
    assert "REPARTITION_BY_NUM" in _plan(found) and "Exchange hashpartitioning(peak_id" in _plan(found) and _plan(found).count("Join") == 1
    assert _rows(found) == _rows(spectra.uncertainty_spectrum(*_apart(scans, peaks), ["peak_id"]).select(found.columns))


def _apart(scans, peaks):
    groups = search.peak_table(scans.join(peaks, "peak_id"), 2)
    return groups.drop("eic"), groups.select("peak_id", "scan", "eic").distinct()


def _library(spark, n):
    """Links of n annotations, of which every fifth has a fragment that is missing."""
    rows = spark.range(n)
    return {
        "annotated_fragments": rows.selectExpr("id", "100.0 + id % 7 as mz", "id % 10 as fragment_id"),
        "norm_fragments": spark.range(8).selectExpr("id", "100.0D as fixedmass", "-1 as netcharge", "concat('C', id % 3) as formula", "0 as radical", "'x' as smiles"),
        "compounds": spark.range(6).selectExpr("id", "concat('name', id) as name", "concat('F', id % 2) as formula"),
        "compound_fragments": rows.selectExpr("id % 4 as peak_id", "id div 3 % 7 as compound_id", "id as annotated_fragment_id"),
    }


@pytest.mark.parametrize("view", [views.fragment_count, views.compound_fragments, views.compound_fragment_stats])
def test_links_are_dealt_out_by_their_number(spark, monkeypatch, view):
    t = _library(spark, 420)
    small = view(t)
    monkeypatch.setattr(keys, "TASK_ROWS", 20)
    large = view(t)
    # a task sorted a share of the links that only the session's setting fixed
    assert "21), REPARTITION_BY_NUM" in _plan(large) and "REPARTITION_BY_NUM" not in _plan(small)
    assert _rows(large) == _rows(small) != []


def test_vote_counts_in_as_many_tasks_as_asked_for(spark):
    rows = [(g, v) for g in range(9) for v in (1, 2, 2, 3, 3, None)] + [(None, 4), (20, None)] + [(30, 7)] * 50
    df = spark.createDataFrame(rows, "g long, v long")
    wanted = {(g, 2) for g in range(9)} | {(None, 4), (30, 7)}
    for tasks in (0, 17):
        votes = imports.vote(df, ["g"], "v", tasks)
        assert ("17), REPARTITION_BY_NUM" in _plan(votes)) == (tasks > 0)
        assert {(r.g, r.v) for r in votes.collect()} == wanted


def test_parameters_of_many_texts_are_dealt_out_by_their_number(spark, monkeypatch):
    texts = spark.range(100).selectExpr("id % 3 as file", "id as scan", """concat('<spectrum id="', id, '"><cvParam name="ms level" value="', id % 2, '"/><scan><cvParam name="scan start time" value="', id, '"/></scan></spectrum>') as text""")
    small = files.parameter_table(files.cv_parameters(texts, "file", "scan", "text"))
    monkeypatch.setattr(files, "TASK_TEXTS", 10)
    large = files.parameter_table(files.cv_parameters(texts, "file", "scan", "text"))
    assert "10), REPARTITION_BY_NUM" in _plan(large) and _plan(large).count("Exchange") == 1  # numbers, columns and gaps follow in the same tasks
    assert _rows(large) == _rows(small) and large.count() == 200
