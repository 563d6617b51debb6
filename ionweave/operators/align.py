"""Order-dependent steps on one peak: aligning ions across scans, pooling and pairing spectra, choosing parameters.

Each is a numpy step on the rows of one key, or of sorted batches of many keys
at once (alignment, pooling, parameters); a key is one peak at one MS level, a
few thousand ions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PPM, MIN_ERROR = 5.0, 0.002


def _tol(x, ppm: float, min_error: float):
    return np.maximum(np.asarray(x) * ppm * 1e-6, min_error)


def _key_type(df: DataFrame, key: list[str]) -> list[T.StructField]:
    return [df.schema[c] for c in key]


def align_ions(pdf: pd.DataFrame, ppm: float = PPM, min_error: float = MIN_ERROR, mode: str = "collapse") -> pd.DataFrame:
    """Adds ion_group to the ions (scan, mz, intensity, eic) of one peak.

    Groups start from the ions of the scan with the largest eic, or the largest
    value of a column seed, if there is one with values; scans follow by their
    distance from it, the earlier of two first.  A group takes the ions
    between its smallest m/z and its largest, widened by their tolerances, and
    so grows; ions left over start groups.  Several ions of a scan in one group
    become one: mean m/z and summed intensity (collapse), or the last (last).
    """
    seed = pdf["seed"].to_numpy(float) if "seed" in pdf else None
    one = np.zeros(len(pdf), int)
    _, rows = _align(one, pdf["scan"].to_numpy(), pdf["mz"].to_numpy(float), pdf["intensity"].to_numpy(float), pdf["eic"].to_numpy(float), seed, one + ppm, one + min_error, mode)
    return pd.DataFrame(rows)


def _leaders(key: np.ndarray, visit: np.ndarray, mz: np.ndarray, ppm: np.ndarray, min_error: np.ndarray, grow: Callable) -> np.ndarray:
    """For each ion the place of the ion that starts its group; ions are sorted by key, visited scan and m/z.

    Ions of a key that no tolerance bridges can't meet, so they fall into
    clusters.  Where a cluster is no wider than its tolerances, all ions of its
    later scans belong to the first group; other clusters are grown one by one.
    """
    tol = np.maximum(mz * ppm * 1e-6, min_error)
    by = np.lexsort((mz, key))
    x, t = mz[by], tol[by]
    apart = (key[by][1:] != key[by][:-1]) | ~((x[1:] <= x[:-1] + t[:-1]) | (x[:-1] >= x[1:] - t[1:]))
    starts = np.flatnonzero(np.concatenate([[True], apart]))
    ends = np.concatenate([starts[1:], [len(by)]]) - 1
    wide = ~(x[ends] - x[starts] <= np.minimum(t[starts], t[ends]) * (1 - 1e-6)) & (ends > starts)
    cluster = np.empty(len(by), int)
    cluster[by] = np.repeat(np.arange(len(starts)), ends - starts + 1)
    # an ion that comes first in its cluster leads it; others of that scan lead groups of their own
    first = np.full(len(starts), len(by))
    np.minimum.at(first, cluster, np.arange(len(by)))
    leader = first[cluster]
    leader = np.where(visit == visit[leader], np.arange(len(by)), leader)
    for c in np.flatnonzero(wide):
        own = np.sort(by[starts[c] : ends[c] + 1])
        leader[own] = own[grow(visit[own], mz[own], ppm[own[0]], min_error[own[0]])]
    return leader


def _grow(visit: np.ndarray, all_mz: np.ndarray, ppm: float, min_error: float) -> np.ndarray:
    """The place of the starting ion for each ion of one cluster, scan by scan."""
    low, high, started, leader = np.zeros(0), np.zeros(0), np.zeros(0, int), np.arange(len(all_mz))
    bounds = np.flatnonzero(np.concatenate([[True], visit[1:] != visit[:-1], [True]]))
    for a, b in itertools.pairwise(bounds):
        mz, left = all_mz[a:b], np.ones(b - a, bool)
        near = (mz[:, None] >= low - _tol(low, ppm, min_error)) & (mz[:, None] <= high + _tol(high, ppm, min_error))
        for g in np.flatnonzero(near.any(0)):
            hit = left & (mz >= low[g] - _tol(low[g], ppm, min_error)) & (mz <= high[g] + _tol(high[g], ppm, min_error))
            if hit.any():
                left &= ~hit
                low[g], high[g] = min(low[g], mz[hit].min()), max(high[g], mz[hit].max())
                leader[a:b][hit] = started[g]
        low, high, started = np.append(low, mz[left]), np.append(high, mz[left]), np.append(started, a + np.flatnonzero(left))
    return leader


def _in_order(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Whether a row of these sorted columns differs from the one before."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    for y in more:
        new[1:] |= y[1:] != y[:-1]
    return new


def _numbers_within(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """0, 1, ... of the marked rows of each key (rows sorted by key); others have the number of the row before."""
    seen = np.cumsum(first)
    starts = np.flatnonzero(_in_order(key))
    return seen - np.repeat((seen - first)[starts], np.diff([*starts, len(key)])) - 1


def _align(key: np.ndarray, scan: np.ndarray, mz: np.ndarray, intensity: np.ndarray, eic: np.ndarray, seed: np.ndarray | None, ppm: np.ndarray, min_error: np.ndarray, mode: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Keys (numbers that ascend) and the columns of align_ions, of the ions of many peaks at once."""
    by = np.lexsort((intensity, mz, scan, key))
    key, scan, mz, intensity, eic, ppm, min_error = (x[by] for x in (key, scan, mz, intensity, eic, ppm, min_error))
    # the scans of each key by time, and the order in which they are visited
    new = _in_order(key, scan)
    at, scans = np.flatnonzero(new), np.cumsum(new) - 1
    own, trace = key[at], eic[at]
    place = _numbers_within(own, np.ones(len(own), bool))
    wanted = trace
    if seed is not None:
        seeds = seed[by][at]
        seeded = np.zeros(own.max(initial=0) + 1, bool)
        seeded[own[~np.isnan(seeds)]] = True
        wanted = np.where(seeded[own], np.where(np.isnan(seeds), -np.inf, seeds), trace)
    wanted = np.where(np.isnan(wanted), np.where(place == 0, np.inf, -np.inf), wanted)
    best = np.lexsort((place, -wanted, own))
    apex = np.empty(own.max(initial=0) + 1, int)
    tops = best[_in_order(own[best])]
    apex[own[tops]] = place[tops]
    order = np.lexsort((place, np.abs(place - apex[own]), own))
    visit = np.empty(len(own), int)
    visit[order] = np.arange(len(own))
    by = np.argsort(visit[scans], kind="stable")
    key, scan, mz, intensity, ppm, min_error, visit, eic = (x[by] for x in (key, scan, mz, intensity, ppm, min_error, visit[scans], trace[scans]))
    leader = _leaders(key, visit, mz, ppm, min_error, _grow)
    group = _numbers_within(key, leader == np.arange(len(leader)))[leader]
    by = np.lexsort((np.arange(len(leader)), leader, visit))
    rows = np.flatnonzero(_in_order(visit[by], leader[by]))
    ends = np.append(rows[1:], len(by)) - 1
    first = by[rows]
    if mode == "collapse":
        one, summed = (np.add.reduceat(x[by], rows) if len(rows) else x for x in (mz, intensity))
        one = one / (ends - rows + 1)
    else:
        one, summed = mz[by[ends]], intensity[by[ends]]
    return key[first], {"scan": scan[first], "ion_group": group[first], "mz": one, "intensity": summed, "eic": eic[first]}


def _key_starts(pdf: pd.DataFrame, key: list[str]) -> np.ndarray:
    """Places of rows whose key differs from that of the row before; nulls are equal."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for c in key:
        x, before = pdf[c], pdf[c].shift()
        new |= ((x != before) & ~(x.isna() & before.isna())).to_numpy(bool)
    return np.flatnonzero(new)


def aligned(ions: DataFrame, key: list[str], ppm: float = PPM, min_error: float = MIN_ERROR, mode: str = "collapse") -> DataFrame:
    """key, scan, ion_group, mz, intensity, eic from ions (key, scan, mz, intensity, eic); columns ppm and min_error, if there, give a key's own tolerance, and seed its first scan."""
    fields = [("scan", T.LongType()), ("ion_group", T.LongType()), ("mz", T.DoubleType()), ("intensity", T.DoubleType()), ("eic", T.DoubleType())]
    schema = T.StructType([*_key_type(ions, key), *(T.StructField(n, t) for n, t in fields)])

    def whole(pdf: pd.DataFrame, number: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(_in_order(number))
        # a key's own tolerances are those of its first row
        own = [pdf[c].iloc[starts].astype(float).fillna(x).to_numpy()[number] if c in pdf else np.full(len(pdf), x) for c, x in (("ppm", ppm), ("min_error", min_error))]
        seed = pdf["seed"].to_numpy(float) if "seed" in pdf else None
        found, rows = _align(number, pdf["scan"].to_numpy(), *(pdf[c].to_numpy(float) for c in ("mz", "intensity", "eic")), seed, *own, mode)
        return pd.concat([pdf[key].iloc[starts[found]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return _by_keys(ions, key, whole, schema)


def _by_keys(df: DataFrame, key: list[str], whole: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """``whole`` of batches of whole keys, with the number of each row's key in its batch.

    Keys are hashed to tasks and sorted there; a task holds a batch and what came
    of the key that it ended in, so that many small keys share a batch.
    """

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = _key_starts(pdf, key)
        return whole(pdf, np.repeat(np.arange(len(starts)), np.diff([*starts, len(pdf)])))

    def many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []  # rows of the key that is still open
        for pdf in batches:
            if not len(pdf):
                continue
            if parts and len(_key_starts(pd.concat([parts[-1][-1:], pdf]), key)) == 1:
                parts.append(pdf)
                continue
            pdf = pd.concat([*parts, pdf], ignore_index=True)
            last = _key_starts(pdf, key)[-1]
            if last:
                yield numbered(pdf[:last].reset_index(drop=True))
            parts = [pdf[last:]]
        if parts:
            yield numbered(pd.concat(parts, ignore_index=True))

    return df.repartition(*key).sortWithinPartitions(*key).mapInPandas(many, schema)


def spectrum_of(pt: pd.DataFrame, correl: float | None, height: float | None, freq: float | None, norm: str = "sum", method: str = "pearson") -> pd.DataFrame:
    """The uncertainty spectrum of one aligned peak table (scan, ion_group, mz, intensity, eic); null parameters skip their step."""
    eic = pt.drop_duplicates("scan").set_index("scan")["eic"]
    if correl is not None:
        r = pt.groupby("ion_group")[["eic", "intensity"]].apply(lambda g: g["eic"].corr(g["intensity"], method=method) if len(g) > 1 else np.nan)
        pt = pt[pt["ion_group"].isin(r[r >= correl].index)]
    if height is not None:
        eic = eic[eic >= height / 100 * (eic.max() - eic.min()) + eic.min()]
        pt = pt[pt["scan"].isin(eic.index)]
    if freq is not None:
        seen = pt.groupby("ion_group")["scan"].nunique()
        pt = pt[pt["ion_group"].isin(seen[seen >= freq / 100 * len(eic)].index)]
    whole = pt.groupby("scan")["intensity"].transform(norm)
    pt = pt.assign(share=pt["intensity"] / whole)
    out = pt.groupby("ion_group").agg(mz=("mz", "mean"), mz_u=("mz", "std"), int=("share", "mean"), int_u=("share", "std"), n=("mz", "size")).reset_index()
    return out.assign(numscans=len(eic))


def _of_peak(number: np.ndarray, pt: pd.DataFrame) -> dict[str, np.ndarray]:
    """What the grids ask of aligned peak tables, of many peaks at once: scans and groups, with their peaks; correlations; which scans have which groups."""
    scan, group = pt["scan"].to_numpy(), pt["ion_group"].to_numpy()
    by = np.lexsort((np.arange(len(pt)), scan, number))
    new = _in_order(number[by], scan[by])
    scans = np.empty(len(pt), int)
    scans[by] = np.cumsum(new) - 1
    firsts = by[new]  # a scan's trace is that of its first row
    by = np.lexsort((group, number))
    new = _in_order(number[by], group[by])
    groups = np.empty(len(pt), int)
    groups[by] = np.cumsum(new) - 1
    x, y = pt["eic"].to_numpy(float), pt["intensity"].to_numpy(float)
    n_groups = int(new.sum())
    both = ~(np.isnan(x) | np.isnan(y))
    g = groups[both]
    n = np.bincount(g, minlength=n_groups)
    with np.errstate(divide="ignore", invalid="ignore"):
        dx, dy = (v[both] - (np.bincount(g, v[both], n_groups) / n)[g] for v in (x, y))
        xx, yy, xy = (np.bincount(g, v, n_groups) / (n - 1) for v in (dx * dx, dy * dy, dx * dy))
        r = np.clip(xy / np.sqrt(xx) / np.sqrt(yy), -1, 1)
    present = np.unique(scans * n_groups + groups)
    return {"scan_peak": number[firsts], "eic": x[firsts], "group_peak": number[by[new]], "r": np.where(n > 1, r, np.nan), "in_scan": present // max(n_groups, 1), "in_group": present % max(n_groups, 1)}


def _grid_counts(eic: np.ndarray, r: np.ndarray, in_scan: np.ndarray, in_group: np.ndarray, grids: list[list[float | None]]) -> tuple[np.ndarray, np.ndarray]:
    """The ion number of spectrum_of at each (correl, height, freq) of the grids, and the scan number at each height."""
    strong = np.array([np.ones(len(r), bool) if c is None else r >= c for c in grids[0]])
    low, high = (f(eic) if (~np.isnan(eic)).any() else np.nan for f in (np.nanmin, np.nanmax))
    tall = np.array([np.ones(len(eic), bool) if h is None else eic >= h / 100 * (high - low) + low for h in grids[1]])
    present = np.zeros((len(eic), len(r)))
    present[in_scan, in_group] = 1
    seen, scans = tall.astype(float) @ present, tall.sum(1)
    often = np.array([seen >= (1 if f is None else np.maximum(f / 100 * scans, 1)[:, None]) for f in grids[2]])
    counts = np.tensordot(strong.astype(float), often.astype(float), (1, 2))
    return counts.transpose(0, 2, 1).astype(int), scans


def best_parameters(pt: pd.DataFrame, top: tuple[float, float, float] = (0.75, 10.0, 10.0), bins: tuple[float, float, float] = (0.05, 1.0, 1.0), min_scans: int = 3) -> tuple:
    """(correl, height, freq, n, score): the strictest parameters that leave an ion and enough scans, n of them.

    The largest ones, if they do; else the grid point (none is allowed for each)
    with the largest sum of shares of the largest parameters and of all scans; of
    equals the strictest, correlation changing fastest and none coming last.  A
    peak with fewer scans than ``min_scans`` needs one.
    """
    return _best(np.zeros(len(pt), int), pt, top, bins, min_scans)[0] if len(pt) else (None, None, None, 0, 0.0)


def _best(number: np.ndarray, pt: pd.DataFrame, top: tuple[float, float, float] = (0.75, 10.0, 10.0), bins: tuple[float, float, float] = (0.05, 1.0, 1.0), min_scans: int = 3) -> list[tuple]:
    """best_parameters of the peaks 0, 1, ... of the rows: the largest ones are tried on all peaks at once, grids on those that they leave without."""
    p = _of_peak(number, pt)
    scan_peak, eic, group_peak, r, in_scan, in_group = p.values()
    n = int(number.max()) + 1
    every = np.bincount(scan_peak, minlength=n)
    enough = np.where(every >= min_scans, min_scans, 1)
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.fmin.at(low, scan_peak, eic)
    np.fmax.at(high, scan_peak, eic)
    with np.errstate(invalid="ignore"):
        tall = eic >= (top[1] / 100 * (high - low) + low)[scan_peak]
    scans = np.bincount(scan_peak[tall], minlength=n)
    seen = np.bincount(in_group[tall[in_scan]], minlength=len(r))
    fits = (r >= top[0]) & (seen >= np.maximum(top[2] / 100 * scans, 1)[group_peak])
    done = (np.bincount(group_peak[fits], minlength=n) > 0) & (scans >= enough)
    grids = [[*np.round(np.arange(t, -b / 2, -b), 6), None] for t, b in zip(top, bins, strict=True)]
    shares = [np.array([(v or 0) / t for v in g]) for g, t in zip(grids, top, strict=True)]
    scan_starts, group_starts = (np.searchsorted(x, np.arange(n + 1)) for x in (scan_peak, group_peak))
    pairs = np.searchsorted(in_scan, scan_starts)
    out = []
    for k in range(n):
        if done[k]:
            out.append((*top, int(scans[k]), 3.0 + scans[k] / every[k]))
            continue
        (a, b), (c, d), (i, j) = ((x[k], x[k + 1]) for x in (scan_starts, group_starts, pairs))
        counts, of_height = _grid_counts(eic[a:b], r[c:d], in_scan[i:j] - a, in_group[i:j] - c, grids)
        score = shares[0][:, None, None] + (shares[1] + of_height / max(every[k], 1))[None, :, None] + shares[2][None, None, :]
        score = np.where((counts > 0) & (of_height >= enough[k])[None, :, None], np.round(score, 9), -1)
        # frequency is the slowest to change
        f, h, e = np.unravel_index(int(score.transpose(2, 1, 0).argmax()), score.transpose(2, 1, 0).shape)
        if score[e, h, f] < 0:
            out.append((None, None, None, 0, 0.0))
        else:
            out.append((*(None if g[x] is None else float(g[x]) for g, x in zip(grids, (e, h, f), strict=True)), int(of_height[h]), float(score[e, h, f])))
    return out


def optimal_parameters(peaks: DataFrame, key: list[str], **settings) -> DataFrame:
    """key, correl, height, freq, n and score for each aligned peak table."""
    schema = T.StructType([*_key_type(peaks, key), *(T.StructField(c, T.DoubleType()) for c in ("correl", "height", "freq")), T.StructField("n", T.LongType()), T.StructField("score", T.DoubleType())])

    def whole(pdf: pd.DataFrame, number: np.ndarray) -> pd.DataFrame:
        best = pd.DataFrame(_best(number, pdf, **settings), columns=schema.names[len(key) :])
        return pd.concat([pdf[key].iloc[np.flatnonzero(_in_order(number))].reset_index(drop=True), best.astype(dict.fromkeys(("correl", "height", "freq"), float))], axis=1)

    return _by_keys(peaks, key, whole, schema)


def pooled(spectra: DataFrame, key: list[str], order: str, ppm: float = PPM, min_error: float = MIN_ERROR) -> DataFrame:
    """Spectra (key, order, mz, mz_u, int, int_u, n) of a key pooled one after another: means, pooled spreads, summed n."""
    names = ["mz", "mz_u", "int", "int_u"]
    schema = T.StructType([*_key_type(spectra, key), *(T.StructField(c, T.DoubleType()) for c in names), T.StructField("n", T.LongType())])

    def whole(pdf: pd.DataFrame, number: np.ndarray) -> pd.DataFrame:
        kept = pdf[order].notna().to_numpy()
        by = np.flatnonzero(kept)[np.lexsort((pdf["mz"].to_numpy(float)[kept], pdf[order].to_numpy()[kept], number[kept]))]
        pdf, number = pdf.iloc[by].reset_index(drop=True), number[by]
        if not len(pdf):
            return pd.DataFrame(columns=schema.names)
        visit = np.cumsum(_in_order(number, pdf[order].to_numpy()))
        leader = _leaders(number, visit, pdf["mz"].to_numpy(float), np.full(len(pdf), ppm), np.full(len(pdf), min_error), _pool)
        free = pdf["n"] - 1
        f = pdf.assign(free=free, mz_u=free * pdf["mz_u"].fillna(0) ** 2, int_u=free * pdf["int_u"].fillna(0) ** 2).groupby(leader)
        out, total = f[["mz", "int"]].mean(), f[["n", "free", "mz_u", "int_u"]].sum()
        for c in ("mz_u", "int_u"):
            out[c] = np.sqrt(total[c] / total["free"].where(total["free"] != 0))
        return out.assign(n=total["n"], **{c: pdf[c].iloc[out.index].array for c in key})[schema.names]

    return _by_keys(spectra, key, whole, schema)


def _pool(visit: np.ndarray, mz: np.ndarray, ppm: float, min_error: float) -> np.ndarray:
    """The place of the starting ion for each ion of one cluster: each takes the first group that it met before its scan."""
    low, high, group, leaders = np.zeros(0), np.zeros(0), np.zeros(len(mz), int), np.zeros(0, int)
    for start, end in itertools.pairwise(np.flatnonzero(np.concatenate([[True], visit[1:] != visit[:-1], [True]]))):
        x = mz[start:end]
        met = (x[:, None] >= low - _tol(low, ppm, min_error)) & (x[:, None] <= high + _tol(high, ppm, min_error))
        old = met.any(1)
        group[start:end][old] = met[old].argmax(1) if old.any() else 0
        group[start:end][~old] = len(low) + np.arange((~old).sum())
        np.minimum.at(low, group[start:end][old], x[old])
        np.maximum.at(high, group[start:end][old], x[old])
        low, high, leaders = np.append(low, x[~old]), np.append(high, x[~old]), np.append(leaders, start + np.flatnonzero(~old))
    return leaders[group]


def paired(left: pd.DataFrame, right: pd.DataFrame, ppm: float = PPM, min_error: float = MIN_ERROR) -> pd.DataFrame:
    """Each ion of left with the first free ion of right whose window meets its own; all that stay alone as well."""
    free = list(right.sort_values("mz").itertuples(index=False))
    rows = []
    for a in left.sort_values("mz").itertuples(index=False):
        k = next((k for k, b in enumerate(free) if abs(a.mz - b.mz) <= _tol(a.mz, ppm, min_error) + _tol(b.mz, ppm, min_error)), None)
        b = free.pop(k) if k is not None else None
        rows.append((a.mz, a.int, b.mz if b else np.nan, b.int if b else np.nan))
    rows += [(np.nan, np.nan, b.mz, b.int) for b in free]
    return pd.DataFrame(rows, columns=["mz1", "int1", "mz2", "int2"])


def pair_spectra(left: DataFrame, right: DataFrame, key: list[str], ppm: float = PPM, min_error: float = MIN_ERROR) -> DataFrame:
    """(key, mz1, int1, mz2, int2): ions of two spectra (key, mz, int) of each key paired one to one, unpaired ones with nulls."""
    schema = T.StructType([*_key_type(left, key), *(T.StructField(c, T.DoubleType()) for c in ("mz1", "int1", "mz2", "int2"))])

    def one(key_values: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = paired(a[["mz", "int"]], b[["mz", "int"]], ppm, min_error)
        for k, c in enumerate(key):
            out.insert(k, c, key_values[k])
        return out

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(one, schema)
