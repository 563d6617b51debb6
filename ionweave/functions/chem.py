"""Elemental formulas, masses, adducts, isotope patterns and registry numbers, as column expressions where they can be."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELECTRON = 0.0005486
#: Masses and abundances of common elements' stable isotopes: fixed physical values; pass a table of your own for others.
ISOTOPES: dict[str, list[tuple[float, float]]] = {
    "H": [(1.00782503223, 0.999885), (2.01410177812, 0.000115)],
    "C": [(12.0, 0.9893), (13.00335483507, 0.0107)],
    "N": [(14.00307400443, 0.99636), (15.00010889888, 0.00364)],
    "O": [(15.99491461957, 0.99757), (16.99913175650, 0.00038), (17.99915961286, 0.00205)],
    "F": [(18.99840316273, 1.0)],
    "Na": [(22.9897692820, 1.0)],
    "Si": [(27.97692653465, 0.92223), (28.97649466490, 0.04685), (29.973770136, 0.03092)],
    "P": [(30.97376199842, 1.0)],
    "S": [(31.9720711744, 0.9499), (32.9714589098, 0.0075), (33.967867004, 0.0425)],
    "Cl": [(34.968852682, 0.7576), (36.965902602, 0.2424)],
    "K": [(38.9637064864, 0.932581), (40.9618252579, 0.067302)],
    "Br": [(78.9183376, 0.5069), (80.9162897, 0.4931)],
    "I": [(126.9044719, 1.0)],
}
_PART = "([A-Z][a-z]?)([0-9]*)"


def monoisotopic_masses(isotopes: dict[str, list[tuple[float, float]]] = ISOTOPES) -> dict[str, float]:
    return {e: max(x, key=lambda m: m[1])[0] for e, x in isotopes.items()}


def bound(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used there, within other lambdas as well."""
    return F.transform(F.array(x), then)[0]


def elements(formula: Column) -> Column:
    """map<string,int> of a formula without brackets; an element that repeats is summed; null for no formula."""
    names = F.regexp_extract_all(formula, F.lit(_PART), 1)
    counts = F.transform(F.regexp_extract_all(formula, F.lit(_PART), 2), lambda x: F.when(x == "", 1).otherwise(x.cast("int")))
    pairs = F.zip_with(names, counts, lambda e, n: F.struct(e.alias("e"), n.alias("n")))

    def summed(pairs: Column) -> Column:
        total = lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda a, p: a + p["n"])
        return bound(F.array_distinct(pairs["e"]), lambda distinct: F.map_from_arrays(distinct, F.transform(distinct, total)))

    return bound(pairs, summed)


def mass(counts: Column, masses: dict[str, float] | None = None) -> Column:
    """Monoisotopic mass of an elements map; null if an element is unknown."""
    table = F.create_map(*[F.lit(x) for kv in (masses or monoisotopic_masses()).items() for x in kv])
    return F.aggregate(F.map_entries(counts), F.lit(0.0), lambda a, kv: a + kv["value"] * F.try_element_at(table, kv["key"]))


def adduct_shift(adduct: str, masses: dict[str, float] | None = None) -> float:
    """Mass that an adduct such as +H, -H or [M+Na]+ adds: its atoms, less or more one electron; 0 for none or a radical."""
    found = re.search(r"([+-])([A-Z][A-Za-z0-9]*)", adduct or "")
    if not found:
        return 0.0
    table = masses or monoisotopic_masses()
    atoms = sum(table[e] * int(n or 1) for e, n in re.findall(_PART, found[2]))
    return atoms - ELECTRON if found[1] == "+" else ELECTRON - atoms


def with_adduct(counts: Column, adduct: str) -> Column:
    """Elements map with an adduct's atoms added or taken; null if more are taken than there are."""
    found = re.search(r"([+-])([A-Z][A-Za-z0-9]*)", adduct or "")
    if not found:
        return counts
    sign = 1 if found[1] == "+" else -1
    change = F.create_map(*[x for e, n in re.findall(_PART, found[2]) for x in (F.lit(e), F.lit(sign * int(n or 1)))])
    merged = F.map_zip_with(counts, change, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return bound(merged, lambda m: F.when(F.forall(F.map_values(m), lambda n: n >= 0), F.map_filter(m, lambda k, n: n > 0)))


def hill(counts: Column) -> Column:
    """A formula in Hill order: C and then H first if there is C, the others by name."""

    def joined(counts: Column, keys: Column, lead: Column) -> Column:
        order = F.concat(lead, F.array_except(keys, lead))
        return F.array_join(F.transform(order, lambda e: bound(counts[e], lambda n: F.concat(e, F.when(n > 1, n.cast("string")).otherwise("")))), "")

    def ordered(counts: Column, keys: Column) -> Column:
        first = F.filter(F.array(F.lit("C"), F.lit("H")), lambda e: F.array_contains(keys, e))
        lead = F.when(F.array_contains(keys, "C"), first).otherwise(F.array().cast("array<string>"))
        return bound(lead, lambda lead: joined(counts, keys, lead))

    return bound(counts, lambda counts: bound(F.array_sort(F.map_keys(counts)), lambda keys: ordered(counts, keys)))


def is_subset(part: Column, whole: Column) -> Column:
    """Whether whole has each element of part at least as often."""
    return bound(whole, lambda w: F.forall(F.map_entries(part), lambda kv: F.coalesce(F.try_element_at(w, kv["key"]), F.lit(0)) >= kv["value"]))


def is_match(test: Column, true: Column) -> Column:
    """Whether true has each element of test equally often; it may have others."""
    return bound(true, lambda t: F.forall(F.map_entries(test), lambda kv: F.coalesce(F.try_element_at(t, kv["key"]), F.lit(-1)) == kv["value"]))


def ppm_error(measured: Column, calculated: Column) -> Column:
    return F.lit(1e6) * (measured - calculated) / calculated


def casrn(text: Column) -> Column:
    """A registry number with a right check digit, without leading zeros; else null."""
    plain = F.trim(text).rlike(r"^0*[0-9]{2,7}-[0-9]{2}-[0-9]$")
    # all digits as one number, of which the last one is the check digit; leading zeros add nothing
    number = F.translate(F.trim(text), "-", "").try_cast("long")
    total = sum((F.floor(number / F.lit(10**i).cast("long")) % 10 * i for i in range(1, 10)), F.lit(0))
    fits = total % 10 == number % 10
    return F.when(plain & fits, F.regexp_replace(F.trim(text), "^0+(?=[0-9])", ""))


def casrn_from_date(text: Column, origin: str = "1899-12-30") -> Column:
    """A registry number that a spreadsheet took for a date and kept as its number of days; other texts stay, NA is null."""
    days = text.try_cast("int")
    date = F.date_format(F.date_add(F.lit(origin).cast("date"), days), "yyyy-MM-dd")
    return F.when(text == "NA", None).when(days.cast("string") == text, F.regexp_replace(date, "-0([0-9])$", "-$1")).otherwise(text)


def isotope_pattern(formula: str, max_shift: float = 3.0, min_intensity: float = 0.001, charge: int = 0, isotopes: dict[str, list[tuple[float, float]]] = ISOTOPES) -> list[tuple[float, float]]:
    """(mass, intensity) of a formula's isotopologues up to a shift, largest intensity 1, small ones left out."""
    patterns = []
    counts: dict[str, int] = {}
    for e, n in re.findall(_PART, formula):
        counts[e] = counts.get(e, 0) + int(n or 1)
    for e, n in counts.items():
        known = sorted(isotopes[e], key=lambda x: -x[1])
        main, others = known[0], [x for x in known[1:] if x[1] > 0]
        limits = [range(min(n, int(max_shift // abs(x[0] - main[0]))) + 1) for x in others]
        rows = []
        for taken in itertools.product(*limits):
            rest = n - sum(taken)
            if rest < 0:
                continue
            log = math.lgamma(n + 1) - math.lgamma(rest + 1) - sum(math.lgamma(t + 1) for t in taken) + rest * math.log(main[1]) + sum(t * math.log(x[1]) for t, x in zip(taken, others, strict=True))
            rows.append((rest * main[0] + sum(t * x[0] for t, x in zip(taken, others, strict=True)), math.exp(log)))
        patterns.append([r for r in rows if r[1] > 1e-12])
    out = [(0.0, 1.0)]
    lightest = 0.0
    for rows in patterns:
        lightest += max(rows, key=lambda r: r[1])[0]
        out = [(a + b, p * q) for (a, p), (b, q) in itertools.product(out, rows) if p * q > 1e-9]
    top = max(p for _, p in out)
    shift = -charge * ELECTRON
    return sorted((m + shift, p / top) for m, p in out if p / top >= min_intensity and abs(m - lightest) <= max_shift + 0.5)


def mass_chart(isotopes: DataFrame) -> DataFrame:
    """(symbol, isotopes) of a table (symbol, exact_mass, abundance), commonest first, then lightest; isotopes without mass or abundance are left out."""
    known = isotopes.where("symbol is not null and exact_mass is not null and abundance > 0")
    rows = F.array_sort(F.collect_set(F.struct((-F.col("abundance")).alias("order"), F.col("exact_mass").alias("mass"))))
    return known.groupBy("symbol").agg(F.transform(rows, lambda x: F.struct(x["mass"].alias("mass"), (-x["order"]).alias("abundance"))).alias("isotopes"))


def _parts(df: DataFrame, formula: str, chart: DataFrame) -> DataFrame:
    """(_formula, symbol, _count, isotopes) of the distinct formulas; isotopes are null for an element that the chart lacks."""
    plain = df.select(F.col(formula).alias("_formula")).distinct().where(F.col("_formula").rlike(f"^(?:{_PART})+$"))
    return plain.select("_formula", F.explode(elements(F.col("_formula"))).alias("symbol", "_count")).join(chart, "symbol", "left")


def chart_masses(df: DataFrame, formula: str, chart: DataFrame, name: str = "mass") -> DataFrame:
    """df with the mass of its formula's commonest isotopes by a chart; null if it is no formula or has an element that the chart lacks."""
    main = F.col("isotopes")[0]["mass"]
    sums = _parts(df, formula, chart).groupBy("_formula").agg(F.when(F.bool_and(main.isNotNull()), F.sum(main * F.col("_count"))).alias(name))
    return df.join(sums, F.col(formula) == F.col("_formula"), "left").drop("_formula")


def isotope_patterns(df: DataFrame, formula: str, chart: DataFrame | None = None, **settings) -> DataFrame:
    """df with a row (mz, intensity) for each isotopologue of its formula; bad or unknown formulas give none.

    chart: the isotopes of elements (see mass_chart), joined to each distinct
    formula, in place of the common elements' own.
    """
    schema = T.StructType([*df.schema, T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())])
    charted = chart is not None
    if charted:
        of = F.collect_list(F.struct("symbol", "isotopes"))
        known = _parts(df, formula, chart).groupBy("_formula").agg(F.bool_and(F.col("isotopes").isNotNull()).alias("_all"), of.alias("_of")).where("_all")
        lists = {"_symbols": F.transform("_of", lambda x: x["symbol"]), "_mass": F.transform("_of", lambda x: x["isotopes"]["mass"]), "_abundance": F.transform("_of", lambda x: x["isotopes"]["abundance"])}
        df = df.join(known.select("_formula", *[v.alias(k) for k, v in lists.items()]), F.col(formula) == F.col("_formula")).drop("_formula")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                named = dict(zip(pdf.columns, row, strict=True))
                own, table = row, settings.get("isotopes", ISOTOPES)
                if charted:
                    own = row[: len(schema) - 2]
                    table = {e: list(zip(m, a, strict=True)) for e, m, a in zip(named["_symbols"], named["_mass"], named["_abundance"], strict=True)}
                text = named[formula]
                if isinstance(text, str) and re.fullmatch(f"(?:{_PART})+", text) and all(e in table for e, _ in re.findall(_PART, text)):
                    rows += [(*own, m, p) for m, p in isotope_pattern(text, **{**settings, "isotopes": table})]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.mapInPandas(expand, schema)
