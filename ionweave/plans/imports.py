"""Imports as set operations: contracts, field maps, resolving names to keys, aliases and votes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.operators.keys import dealt

#: Texts of a dimension that a fuzzy lookup may broadcast.
LOOKUP_TEXTS = 100_000


def check_contract(found: dict[str, Any], contract: dict[str, dict[str, Any]]) -> dict[str, list[str]]:
    """What an import lacks or has besides a contract {element: {names, required}}; lists of objects are checked one by one.

    Returns missing required elements, missing recommended ones, extra elements
    and names that an element lacks, as "element.name".
    """
    out: dict[str, list[str]] = {"required": [], "recommended": [], "extra": [x for x in found if x not in contract], "names": []}
    for element, spec in contract.items():
        if element not in found:
            out["required" if spec.get("required") else "recommended"].append(element)
            continue
        for x in found[element] if isinstance(found[element], list) else [found[element]]:
            have = set(x) if isinstance(x, dict) else set()
            out["names"] += [f"{element}.{n}" for n in spec.get("names", []) if n not in have and f"{element}.{n}" not in out["names"]]
    return out


def contract_of(df: DataFrame) -> dict[str, dict[str, Any]]:
    """A contract from an example's columns: structs give their fields' names, columns that can't be null are required."""
    names = lambda t: t.names if hasattr(t, "names") else names(t.elementType) if hasattr(t, "elementType") else []
    return {f.name: {"names": list(names(f.dataType)), "required": not f.nullable} for f in df.schema}


def map_fields(df: DataFrame, fields: list[dict[str, str]], table: str) -> DataFrame:
    """The columns of one target table from a field map (import_parameter, sql_table, sql_parameter); absent ones are null text."""
    chosen = [f for f in fields if f["sql_table"] == table]
    return df.select(*[(F.col(f["import_parameter"]) if f["import_parameter"] in df.columns else F.lit(None).cast("string")).alias(f["sql_parameter"]) for f in chosen])


def resolve(df: DataFrame, column: str, dimension: DataFrame, key: str = "id", fuzzy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(df with ``column``_id, rejected values with how many rows match): a value is looked up in all other columns of a dimension.

    Case doesn't matter.  With fuzzy, a dimension text that contains the value
    matches as well, if none is equal.  Values with no match or several keys
    get null and are listed.
    """
    names = [c for c in dimension.columns if c != key]
    long = dimension.select(F.col(key).alias("_key"), F.explode(F.array(*[F.lower(F.col(c).cast("string")) for c in names])).alias("_text")).where("_text is not null").distinct()
    value = F.lower(F.trim(F.col(column).cast("string")))
    hits = long.groupBy("_text").agg(F.countDistinct("_key").alias("matches"), F.min("_key").alias("_id"))
    if fuzzy:
        lost = df.select(value.alias("_value")).where("_value <> ''").distinct().join(hits, F.col("_value") == F.col("_text"), "left_anti")
        # texts within texts have no key to join on: each value left is compared with all of a lookup table of checked size
        if long.limit(LOOKUP_TEXTS + 1).count() > LOOKUP_TEXTS:
            raise ValueError(f"a fuzzy lookup takes a dimension of {LOOKUP_TEXTS} texts at most")
        near = lost.join(F.broadcast(long.withColumnRenamed("_text", "_longer")), F.contains("_longer", F.col("_value")))
        hits = hits.unionByName(near.groupBy(F.col("_value").alias("_text")).agg(F.countDistinct("_key").alias("matches"), F.min("_key").alias("_id")))
    # texts of the lookup table, and not those of df, are counted: df is read once, and a small table is broadcast whatever value is frequent
    hits = hits.where("_text <> ''")
    out = df.withColumn("_value", value).join(hits, F.col("_value") == F.col("_text"), "left")
    out = out.withColumn(f"{column}_id", F.when(F.col("matches") == 1, F.col("_id"))).drop("_value", "_text", "_id", "matches")
    values = df.select(value.alias("_value")).where("_value <> ''").distinct().join(hits, F.col("_value") == F.col("_text"), "left")
    return out, values.select(F.col("_value").alias("value"), F.coalesce("matches", F.lit(0).cast("long")).alias("matches")).where("matches <> 1")


def split_aliases(df: DataFrame, key: str, column: str, separator: str = ";") -> DataFrame:
    """(key, type, alias) from texts such as "CASRN:335-67-1; name": the type is null where there is none."""
    part = F.explode(F.split(F.col(column), separator)).alias("_part")
    rows = df.select(key, part).select(key, F.trim("_part").alias("_part")).where("_part <> ''")
    typed = F.col("_part").rlike(r"^[A-Za-z][A-Za-z0-9_]*:")
    pair = F.split("_part", ":", 2)
    return rows.select(key, F.when(typed, F.upper(F.get(pair, 0))).alias("type"), F.when(typed, F.trim(F.get(pair, 1))).otherwise(F.col("_part")).alias("alias")).distinct()


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch once, with how often they occur in it."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        yield from table.group_by(table.column_names).aggregate([([], "count_all")]).combine_chunks().to_batches()


def vote(df: DataFrame, group: list[str], value: str, tasks: int = 0) -> DataFrame:
    """The most frequent non-null value of each group; the smallest of equals.

    tasks: how many tasks count the values, where the session's setting has
    fewer; equal rows of a batch are then one before they are dealt out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, value)
    tallies = T.StructType([*rows.schema, T.StructField("_n", T.LongType())])
    if dealt(rows, tasks, *group, value) is not rows:
        counts = dealt(rows.mapInArrow(_tallied, tallies), tasks, *group, value).groupBy(*group, value).agg(F.sum("_n").alias("votes"))
    else:
        counts = rows.groupBy(*group, value).agg(F.count("*").alias("votes"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("votes")).alias("_order"), F.col(value).alias("value"))).alias("x")).select(*group, F.col("x.value").alias(value))


def ternary_links(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of which at least two of the columns are set."""
    filled = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in columns])
    return df.where(filled >= 2).distinct()


def qc_rows(df: DataFrame, key: str) -> DataFrame:
    """QC columns as long rows (key, applies_to, name, value): the peak where a name occurs once, else fragment_i."""
    names = [c for c in df.columns if c != key]
    rows = df.withColumn("_row", F.monotonically_increasing_id()).select(key, "_row", *[F.col(c).cast("string").alias(c) for c in names])
    long = rows.unpivot([key, "_row"], names, "name", "value").where("value is not null")
    w = Window.partitionBy(key, "name")
    place = F.row_number().over(w.orderBy("_row"))
    return long.withColumn("applies_to", F.when(F.count("*").over(w) == 1, "peak").otherwise(F.concat(F.lit("fragment_"), place.cast("string")))).drop("_row")


def without_sample(frames: dict[str, DataFrame], sample_id: int) -> dict[str, DataFrame]:
    """Frames without a sample, and without methods that no other sample uses."""
    out = dict(frames)
    out["samples"] = frames["samples"].where(F.col("id") != sample_id)
    used = out["samples"].select(F.col("ms_methods_id").alias("id"))
    own = frames["samples"].where(F.col("id") == sample_id).select(F.col("ms_methods_id").alias("id"))
    gone = own.join(used, "id", "left_anti")
    out["ms_methods"] = frames["ms_methods"].join(gone, "id", "left_anti")
    return out
