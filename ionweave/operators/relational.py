"""Table verbs: decoding keys, upserts, integrity, reshaping, groups."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import keys, predicates


def decode(df: DataFrame, keys: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Replaces each key column by the name that its dimension (frame, id column, name column) has for it.

    Left joins: an unknown or null key gives a null name.  Dimensions are small,
    so Spark broadcasts them by their size.
    """
    out = df
    for column, (dim, key, name) in keys.items():
        out = out.join(dim.select(F.col(key).alias("_key"), F.col(name).alias("_name")), F.col(column) == F.col("_key"), "left").withColumn(column, F.col("_name")).drop("_key", "_name")
    return out


def keep_group_max(df: DataFrame, group: list[str], value: str, ratio: float) -> DataFrame:
    """Rows of groups whose largest value exceeds ratio times the largest of all."""
    top = df.agg(F.max(value).alias("_top"))
    best = df.groupBy(*group).agg(F.max(value).alias("_best")).join(F.broadcast(top)).where(F.col("_best") > F.col("_top") * ratio)
    return df.join(best.select(*group), group, "left_semi")


def keep_ties_of_max(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows with their group's largest value, ties included."""
    best = F.max(value).over(Window.partitionBy(*group))
    return df.withColumn("_best", best).where(F.col(value) == F.col("_best")).drop("_best")


def fill_down(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fill_up(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns})


def update(df: DataFrame, values: dict[str, Any], criteria: dict[str, Any], extra: Column | None = None) -> DataFrame:
    """df with the columns set to values in the rows that meet all criteria (and extra); words for null set null.

    Criteria are as in predicates.where; one that is None asks for nothing.
    """
    wanted = [predicates.criterion(F.col(c), spec) for c, spec in criteria.items() if spec is not None]
    wanted += [] if extra is None else [extra]
    if not wanted:
        raise ValueError("an update needs criteria")
    hit = F.coalesce(reduce(Column.__and__, wanted), F.lit(False))
    new = {c: F.lit(None if v in predicates.NULL_WORDS else v).cast(df.schema[c].dataType) for c, v in values.items()}
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def hierarchy(df: DataFrame, key: str, parent: str, name: str, most: int = 50) -> DataFrame:
    """key with depth, root and path (names from the root down, with " / " between), by joining level after level.

    Rows without a parent are roots; rows that no root reaches are left out, and
    more than ``most`` levels raise.
    """
    rows = df.select(F.col(key), F.col(parent).alias("_up"), F.col(name).alias("_name"))
    level = rows.where("_up is null").select(key, F.lit(0).cast("long").alias("depth"), F.col(key).alias("root"), F.col("_name").alias("path"))
    out = level
    for _ in range(most):
        above = level.select(F.col(key).alias("_up"), "depth", "root", "path")
        level = rows.join(above, "_up").select(key, (F.col("depth") + 1).alias("depth"), "root", F.concat_ws(" / ", "path", "_name").alias("path"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"more than {most} levels, or a circle")


def nearest_first(df: DataFrame, column: str, value: float, ties: list[str], n: int) -> DataFrame:
    """The n rows nearest to a value, nearest first, with their distance."""
    return df.withColumn("distance", F.abs(F.col(column) - value)).where("distance is not null").orderBy("distance", *ties).limit(n)


def counted(df: DataFrame, group: list[str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*group)))


def nested(df: DataFrame, group: list[str], column: str, name: str) -> DataFrame:
    """The distinct values of each group as a sorted array."""
    return df.groupBy(*group).agg(F.array_sort(F.collect_set(column)).alias(name))


def concatenated(df: DataFrame, group: list[str], column: str, separator: str, distinct: bool = False, name: str = "text") -> DataFrame:
    """The texts of each group in their order, with a separator between."""
    return df.groupBy(*group).agg(F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(column)), separator).alias(name))


def summarised(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Number, mean and sample spread of each group's values; a single one has no spread."""
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def append_new(target: DataFrame, rows: DataFrame, unique: list[str]) -> DataFrame:
    """target with those rows whose unique columns it lacks; nulls compare as equal, repeats are added once."""
    fresh = rows.dropDuplicates(unique)
    known = target.select(*[F.col(c).alias(f"_{c}") for c in unique])
    fresh = fresh.join(known, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in unique]), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def add_or_get(target: DataFrame, values: DataFrame, on: list[str], key: str = "id") -> DataFrame:
    """values with their key in target: the largest of several matches, else a new one after the largest.

    New keys follow the order of the distinct values, nulls first.
    """
    return keys.keyed(target, values, on, key)[0]


def normalize_key(df: DataFrame, column: str, dim: DataFrame, key: str = "id", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(df with the column's text replaced by dimension keys, dimension with the unknown texts added); blanks are null."""
    text = F.when(F.trim(F.col(column)) == "", None).otherwise(F.col(column))
    rows = df.withColumn(column, text)
    wanted = rows.where(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct()
    keyed = add_or_get(dim, wanted, [name], key)
    grown = append_new(dim, keyed, [name])
    return decode(rows, {column: (grown, name, key)}), grown


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key is set and has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def repeated(df: DataFrame, unique: list[str]) -> DataFrame:
    """Values of the unique columns that occur more than once, with their number."""
    return df.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with the name of each check that they fail; a null result passes, as in SQL."""
    failed = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("failed", F.explode(failed))


def delete_cascade(tables: dict[str, DataFrame], table: str, gone: DataFrame, links: list[tuple[str, str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables without the rows ``gone`` of one, and what their deletion entails.

    links: (child, column, parent, key, action) with action cascade, restrict or
    set null; a restricted child of a deleted row raises.
    """
    out = dict(tables)
    out[table] = tables[table].exceptAll(gone)
    for child, column, parent, key, action in links:
        if parent != table:
            continue
        keys = gone.select(F.col(key).alias("_key")).where("_key is not null").distinct()
        hit = tables[child].join(keys, F.col(column) == F.col("_key"), "left_semi")
        if action == "restrict" and not hit.isEmpty():
            raise ValueError(f"{child}.{column} still refers to deleted rows of {parent}")
        if action == "set null":
            marked = out[child].join(keys, F.col(column) == F.col("_key"), "left")
            out[child] = marked.withColumn(column, F.when(F.col("_key").isNull(), F.col(column))).drop("_key")
        elif action == "cascade":
            out = delete_cascade(out, child, hit, links)
    return out


def scan_cycles(scans: DataFrame, group: list[str], order: str, level: str, energies: list[float]) -> DataFrame:
    """MS2 scans between two MS1 scans take the collision energies in turn; MS1 scans occur once for each.

    Adds cycle (number of MS1 scans so far) and energy.
    """
    w = Window.partitionBy(*group).orderBy(order)
    scans = scans.withColumn("cycle", F.count_if(F.col(level) == 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*group, "cycle", level).orderBy(order)) - 1
    turn = F.array(*map(F.lit, energies))
    own = F.when(F.col(level) == 1, turn).otherwise(F.array(F.get(turn, place % len(energies))))
    return scans.withColumn("_own", own).withColumn("energy", F.explode("_own")).drop("_own")
