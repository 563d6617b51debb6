"""Readers and writers: positional CSV, mzML scans, method JSON with repeated keys, MSP text."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.operators import keys

SCAN = "file string, scan int, ms_n int, scantime double, polarity int, base_ion double, base_int double, precursor_mz double, ions array<struct<mz:double,intensity:double>>"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file by position: its header is skipped, whatever it says, and must have as many columns; blank, NULL and NA are null."""
    text = spark.read.option("header", False).csv(path)
    if len(text.columns) != len(schema):
        raise ValueError(f"{path} has {len(text.columns)} columns, {len(schema)} are expected")
    rows = spark.read.option("header", True).option("enforceSchema", True).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path)

    def typed(f: T.StructField) -> Column:
        return F.when(~F.upper(F.trim(F.col(f.name))).isin("", "NULL", "NA"), F.col(f.name)).try_cast(f.dataType).alias(f.name)

    return rows.select(*map(typed, schema))


def _numbers(element: str) -> np.ndarray:
    binary = re.search(r"<binary>([^<]*)</binary>", element)
    raw = base64.b64decode(binary[1]) if binary else b""
    if "MS:1000574" in element:
        raw = zlib.decompress(raw) if raw else raw
    return np.frombuffer(raw, "<f4" if "MS:1000521" in element else "<f8").astype(float)


def _value(element: str, accession: str) -> float | None:
    found = re.search(rf'<cvParam[^>]*accession="{accession}"[^>]*>', element)
    value = re.search(r'value="([^"]*)"', found[0]) if found else None
    try:
        return float(value[1]) if value else None
    except ValueError:
        return None


def parse_mzml(file: str, content: str, before: int = 0) -> Iterator[dict]:
    """A row for each spectrum of an mzML document, numbered by its index, else by its place after ``before`` others."""
    for k, m in enumerate(re.finditer(r"<spectrum\b.*?</spectrum>", content, re.S)):
        x = m[0]
        arrays = {"mz": np.zeros(0), "intensity": np.zeros(0)}
        for a in re.findall(r"<binaryDataArray\b.*?</binaryDataArray>", x, re.S):
            if "MS:1000514" in a or "MS:1000515" in a:
                arrays["mz" if "MS:1000514" in a else "intensity"] = _numbers(a)
        time = _value(x, "MS:1000016")
        minutes = re.search(r'accession="MS:1000016"[^>]*unitName="second"', x) is None
        index = re.match(r'<spectrum\b[^>]*?\bindex="(\d+)"', x)
        yield {
            "file": file,
            "scan": int(index[1]) + 1 if index else before + k + 1,
            "ms_n": int(_value(x, "MS:1000511") or 1),
            "scantime": time if time is None or minutes else time / 60,
            "polarity": 1 if "MS:1000130" in x else -1 if "MS:1000129" in x else 0,
            "base_ion": _value(x, "MS:1000504"),
            "base_int": _value(x, "MS:1000505"),
            "precursor_mz": _value(x, "MS:1000744") or 0.0,
            "ions": [{"mz": a, "intensity": b} for a, b in zip(arrays["mz"].tolist(), arrays["intensity"].tolist(), strict=True)],
        }


_SPECTRUM_END = "</spectrum>"


def _mzml_parts(spark: SparkSession, path: str) -> DataFrame:
    """(path, part): the text up to each spectrum's end.  Tasks read ranges of bytes, so one file is as many tasks as it is long."""
    rows = spark.read.option("lineSep", _SPECTRUM_END).option("recursiveFileLookup", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("part"))


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each scan of the mzML files below path, numbered by its index; a task holds one spectrum's text at a time.

    Where some spectrum has no index, which takes a look at all of them, those of
    each file are numbered by their place.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for file, before, part in zip(pdf["path"], pdf["before"], pdf["part"], strict=True) for r in parse_mzml(file, part + _SPECTRUM_END, int(before))]
            if rows:
                yield pd.DataFrame(rows)

    parts = _mzml_parts(spark, path).where(F.col("part").rlike(r"<spectrum\b"))
    if parts.where(~F.col("part").rlike(r'<spectrum\b[^>]*?\bindex="\d+"')).isEmpty():
        parts = parts.withColumn("before", F.lit(0))
    else:
        parts = parts.withColumn("before", F.row_number().over(Window.partitionBy("path").orderBy("block", "place")) - 1)
    return parts.select("path", "before", "part").mapInPandas(parse, SCAN)


#: Parameters whose values are numbers or words; those of other names are numbers where all their values are.
NUMERIC_NAMES, TEXT_NAMES = ("m/z", "intensity", "time", "energy", "current", "level", "mobility"), ("filter string", "spectrum title", "preset scan configuration")


#: Texts whose tags a task sorts.
TASK_TEXTS = 50_000


def cv_parameters(texts: DataFrame, file: str, scan: str, text: str) -> DataFrame:
    """(file, scan, place, element, name, value, unit): the cvParam entries of a column of XML texts, as often as they occur, in order."""
    tag = r"<(?:[A-Za-z]+:)?cvParam\b[^>]*>|<[A-Za-z]+\b[^>]*>"
    texts = texts.select(F.col(file).alias("file"), F.col(scan).alias("scan"), F.col(text).alias("text"))
    # texts are dealt out before they are cut into many tags
    rows = keys.dealt(texts, keys.tasks_for(texts, TASK_TEXTS), "file", "scan").select("file", "scan", F.posexplode(F.regexp_extract_all("text", F.lit(tag), 0)).alias("place", "tag"))

    def attribute(name: str) -> Column:
        raw = F.regexp_extract("tag", rf'\s{name}="([^"]*)"', 1)
        for escaped, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            raw = F.replace(raw, F.lit(escaped), F.lit(plain))
        return F.nullif(raw, F.lit(""))

    is_parameter = F.col("tag").rlike(r"^<(?:[A-Za-z]+:)?cvParam\b")
    within = Window.partitionBy("file", "scan").orderBy("place")
    element = F.last(F.when(~is_parameter, F.regexp_extract("tag", r"^<([A-Za-z]+)", 1)), ignorenulls=True).over(within)
    rows = rows.withColumn("element", element).where(is_parameter)
    return rows.select("file", "scan", "place", "element", attribute("name").alias("name"), attribute("value").alias("value"), attribute("unitName").alias("unit")).where("name is not null")


def parameter_table(parameters: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row for each scan and entry of cv_parameters' elements (file, scan, element, number), a column for each parameter name.

    An element that occurs again in a scan, known by a name that it already has,
    is another entry; a value that an entry lacks is that of the entry before in
    its scan.  Columns of numeric names are doubles; a parameter without a value
    is "true".  Names are the vocabulary of the parameters, in their order.
    """
    if names is None:
        names = [r.name for r in parameters.select("name").distinct().orderBy("name").collect()]  # the vocabulary, not the data
    numbered = parameters.withColumn("number", F.row_number().over(Window.partitionBy("file", "scan", "element", "name").orderBy("place")))
    value = F.coalesce("value", F.lit("true"))
    wide = numbered.groupBy("file", "scan", "element", "number").agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in names])
    before = Window.partitionBy("file", "scan", "element").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = wide.select("file", "scan", "element", "number", *[F.last(F.col(f"`{n}`"), ignorenulls=True).over(before).alias(n) for n in names])
    numeric = [n for n in names if n.lower() not in TEXT_NAMES and any(word in n.lower() for word in NUMERIC_NAMES)]
    return filled.withColumns({n: F.col(f"`{n}`").try_cast("double") for n in numeric})


def is_usable_conversion(text: Column) -> Column:
    """Whether the processing notes of a converted file name the conversion, peak picking and no threshold."""
    return text.rlike(r"(?i)conversion to mzML") & text.rlike(r"(?i)peak picking") & ~text.rlike(r"(?i)threshold")


class _Many(list):
    """The values of a key that occurs repeatedly in one JSON object."""


def _collect(pairs: list[tuple]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            out[k] = _Many([*(out[k] if isinstance(out[k], _Many) else [out[k]]), v])
        else:
            out[k] = v
    return out


def parse_method(text: str) -> dict:
    """A method JSON: keys may repeat (their values become a list), and an empty value counts as "unknown"."""
    return json.loads(re.sub(r'("\w+"\s*:)\s*,', r'\1 "unknown",', text), object_pairs_hook=_collect)


def _listed(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def read_methods(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, number, parent, fields) of the peaks, compounds and fragments of method JSON files; fields as a map of texts."""

    def flat(x: dict) -> dict[str, str]:
        return {k: str(v) for k, v in x.items() if not isinstance(v, (dict, list))}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["path"], pdf["content"], strict=True):
                doc = parse_method(bytes(text).decode())
                for kind in ("sample", "chromatography", "massspectrometry"):
                    rows += [(file, kind, k, None, flat(x)) for k, x in enumerate(_listed(doc.get(kind)))]
                rows += [(file, "peak", k, None, flat(x)) for k, x in enumerate(_listed((doc.get("peaks") or {}).get("peak")))]
                for k, compound in enumerate(_listed((doc.get("annotation") or {}).get("compound"))):
                    rows.append((file, "compound", k, None, flat(compound)))
                    rows += [(file, "fragment", j, k, flat(x)) for j, x in enumerate(_listed(compound.get("fragment")))]
            yield pd.DataFrame(rows, columns=["file", "kind", "number", "parent", "fields"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, kind string, number int, parent int, fields map<string,string>")


def peak_list(spark: SparkSession, path: str) -> DataFrame:
    """Feature list (mz, rt, peak_starttime, peak_endtime): complete numeric rows whose rt lies between its ends, in either order."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(*[F.col(c).try_cast("double").alias(c) for c in ("mz", "rt", "peak_starttime", "peak_endtime")]).dropna()
    return rows.where(F.col("rt").between(F.least("peak_starttime", "peak_endtime"), F.greatest("peak_starttime", "peak_endtime")))


def msp(spectra: DataFrame, key: str, name: str, precursor: str, headers: list[str] | None = None) -> DataFrame:
    """(key, text): MSP entries from rows (key, name, precursor, headers, mz, intensity), ions by m/z."""
    headers = headers or []
    ion = F.concat_ws(" ", F.col("mz").cast("string"), F.col("intensity").cast("string"))
    rows = spectra.groupBy(key, name, precursor, *headers).agg(F.array_sort(F.collect_list(F.struct("mz", "intensity", ion.alias("line")))).alias("ions"))
    head = [F.concat(F.lit("Name:  "), F.col(name)), F.concat(F.lit("PrecursorMZ:  "), F.col(precursor).cast("string"))]
    head += [F.concat(F.lit(f"{h}:  "), F.col(h).cast("string")) for h in headers]
    body = [F.concat(F.lit("Num Peaks:  "), F.size("ions").cast("string")), F.array_join(F.col("ions.line"), "\n")]
    return rows.select(key, F.concat_ws("\n", *head, *body, F.lit("")).alias("text"))


def write_msp(spectra: DataFrame, path: str, key: str, name: str, precursor: str, headers: list[str] | None = None, files: int | None = None) -> None:
    """MSP files of whole entries in the order of the key: within a file, and from file to file by their names."""
    entries = msp(spectra, key, name, precursor, headers)
    ranged = entries.repartitionByRange(files, key) if files else entries.repartitionByRange(key)
    ranged.sortWithinPartitions(key).select("text").write.text(path)


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, name, precursor, n_peaks, ions) of the entries of MSP files, which tasks read from blank line to blank line."""
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("place"))
    field = lambda n: F.nullif(F.regexp_extract("text", rf"(?m)^{n}:\s*(.*)$", 1), F.lit(""))
    pairs = F.regexp_extract_all("text", F.lit(r"(?m)^([0-9.eE+-]+)\s+[0-9.eE+-]+"), 1), F.regexp_extract_all("text", F.lit(r"(?m)^[0-9.eE+-]+\s+([0-9.eE+-]+)"), 1)
    ions = F.zip_with(*pairs, lambda a, b: F.struct(a.cast("double").alias("mz"), b.cast("double").alias("intensity")))
    return rows.where(field("Name").isNotNull()).select("file", "place", field("Name").alias("name"), field("PrecursorMZ").cast("double").alias("precursor"), field("Num Peaks").cast("int").alias("n_peaks"), ions.alias("ions"))


def zip_numbers(values: list[float]) -> str:
    """Numbers as base64 of deflated little-endian doubles."""
    return base64.b64encode(zlib.compress(np.asarray(values, "<f8").tobytes())).decode()


def unzip_numbers(text: str) -> list[float]:
    return np.frombuffer(zlib.decompress(base64.b64decode(text)), "<f8").tolist()
