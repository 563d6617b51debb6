"""Import objects: JSON files to nested rows, what they violate, and their distinct parts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.sources.files import parse_method

#: Sections as maps of texts: their keys are named by patterns (mp1solvent, massanalyzer2).
MAPS = ("sample", "chromatography", "massspectrometry", "peak", "compounddata", "sample_aliases")
#: Sections as lists of maps of texts.
LISTS = ("qcmethod", "annotation", "msdata", "qc", "opt_ums_params", "inspections", "fragment_aliases")
OBJECT = ", ".join(["object string", *(f"{m} map<string,string>" for m in MAPS), *(f"{x} array<map<string,string>>" for x in LISTS), "msconvertsettings array<string>"])


#: Characters of JSON that a task holds parsed at once.
PARSED = 8 << 20


def _text(x) -> str | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    return x if isinstance(x, str) else json.dumps(x) if isinstance(x, (dict, list)) else repr(x) if isinstance(x, float) else str(x)


def _map(x) -> dict[str, str | None] | None:
    return {k: _text(v) for k, v in x.items()} if isinstance(x, dict) else None


def parse_object(text: str) -> dict:
    """The sections of one import object; a section that is no object or list of objects is left out."""
    doc = parse_method(text)
    out: dict = {m: _map(doc.get(m)) for m in MAPS}
    for name in LISTS:
        x = doc.get(name)
        out[name] = None if x is None else [_map(v) for v in (x if isinstance(x, list) else [x]) if isinstance(v, dict)]
    settings = doc.get("msconvertsettings")
    out["msconvertsettings"] = None if settings is None else [_text(v) for v in (settings if isinstance(settings, list) else [settings])]
    return out


def import_objects(texts: DataFrame, name: str = "object", text: str = "text") -> DataFrame:
    """A row (OBJECT) for each JSON text; texts that aren't JSON objects have null sections."""

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ("object", *MAPS, *LISTS, "msconvertsettings")})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for key, value in zip(pdf["object"], pdf["text"], strict=True):
                try:
                    rows.append({"object": key, **parse_object(value or "")})
                except (ValueError, AttributeError):
                    rows.append({"object": key})
                size += len(value or "")
                if size >= PARSED:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)

    return texts.select(F.col(name).cast("string").alias("object"), F.col(text).alias("text")).mapInPandas(parse, OBJECT)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """The import objects of JSON files, one each, named by their path."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("object"), F.col("value").alias("text"))
    return import_objects(files)


#: What an object needs: the keys of each section, and whether it may be missing.
REQUIRED = {
    "sample": ["name", "description", "sample_class", "data_generator"],
    "massspectrometry": ["ionization", "polarity", "fragmode"],
    "peak": ["mz", "rt", "peak_starttime", "peak_endtime", "ionstate"],
    "compounddata": ["NAME", "FORMULA"],
}
LISTED = {"msdata": (["scantime", "ms_n", "measured_mz", "measured_intensity"], True), "annotation": (["fragment_mz", "fragment_formula"], False), "qcmethod": (["name", "value"], False)}
NUMBERS = {"peak": ["mz", "rt", "peak_starttime", "peak_endtime"], "msdata": ["scantime", "ms_n"], "annotation": ["fragment_mz"]}


def _problems(section: Column, path: Column, needed: list[str], numbers: list[str]) -> Column:
    value = lambda k: F.nullif(F.trim(F.try_element_at(section, F.lit(k))), F.lit(""))
    found = [F.when(value(k).isNull(), F.struct(F.concat(path, F.lit(f".{k}")).alias("path"), F.lit("missing").alias("problem"))) for k in needed]
    found += [F.when(value(k).isNotNull() & value(k).try_cast("double").isNull(), F.struct(F.concat(path, F.lit(f".{k}")).alias("path"), F.lit("not a number").alias("problem"))) for k in numbers]
    return F.array(*found)


def _each(name: str, needed: list[str], numbers: list[str]):
    return lambda x, k: _problems(x, F.concat(F.lit(f"{name}["), k.cast("string"), F.lit("]")), needed, numbers)


def rejects(objects: DataFrame, required: dict[str, list[str]] | None = None, listed: dict[str, tuple[list[str], bool]] | None = None, numbers: dict[str, list[str]] | None = None) -> DataFrame:
    """(object, path, problem) of what objects lack or hold in a wrong form, such as ("a", "msdata[2].ms_n", "not a number")."""
    required, listed, numbers = required or REQUIRED, listed or LISTED, numbers or NUMBERS
    parts = []
    for name, needed in required.items():
        inside = _problems(F.col(name), F.lit(name), needed, numbers.get(name, []))
        parts.append(F.when(F.col(name).isNull(), F.array(F.struct(F.lit(name).alias("path"), F.lit("missing").alias("problem")))).otherwise(inside))
    for name, (needed, must) in listed.items():
        each = F.flatten(F.transform(name, _each(name, needed, numbers.get(name, []))))
        empty = F.array(F.struct(F.lit(name).alias("path"), F.lit("missing").alias("problem"))) if must else F.array().cast("array<struct<path:string,problem:string>>")
        parts.append(F.when(F.coalesce(F.size(name), F.lit(0)) <= 0, empty).otherwise(each))
    rows = objects.select("object", F.explode(F.concat(*parts)).alias("p")).where("p is not null")
    return rows.select("object", "p.path", "p.problem")


def canonical(section: Column) -> Column:
    """A map's text with its keys sorted: equal for equal maps, however they are ordered."""
    return F.to_json(F.sort_array(F.map_entries(section)))


def uniques(rows: DataFrame, section: str, member: str) -> DataFrame:
    """(section, n, members): each distinct map of a column, how many rows have it, and these rows' sorted members; the order of keys doesn't count."""
    keyed = rows.withColumn("_key", canonical(F.col(section)))
    groups = keyed.groupBy("_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    return groups.select(F.map_from_entries(F.from_json("_key", "array<struct<key:string,value:string>>")).alias(section), "n", "members")
