"""Surrogate keys without a ranking in one task, and steps written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ionweave-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written as Parquet and read back: a lost executor costs no more than reading it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or gathers at a time.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """Tasks that a shuffle of df asks for with so many rows each; takes a count of df."""
    return -(-df.count() // (rows or TASK_ROWS))


def dealt(df: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """df dealt out by the columns to so many tasks, where the session's setting has fewer; the other side of a join follows.

    So what a task sorts or holds doesn't grow with the table.
    """
    return df.repartition(tasks, *columns) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def numbered(rows: DataFrame, order: list[str], after: int = 0, key: str = "id", kept: str | None = None) -> DataFrame:
    """rows with consecutive keys from after + 1 on, in the order of the columns (nulls first); equal rows in any order.

    Rows in which the column ``kept`` is filled have that as their key and take no
    number.  Ranges of rows are sorted by as many tasks and written with their
    places; only the sizes of the ranges, one number for each task, reach the driver.
    """
    old = F.col(kept).isNotNull() if kept else F.lit(False)
    ranges = rows.repartitionByRange(*order)
    placed = staged((ranges.sortWithinPartitions(old, *order) if kept else ranges.sortWithinPartitions(*order)).withColumn("_place", F.monotonically_increasing_id()), "keys")
    part = F.shiftright("_place", 33)
    sizes = placed.where(~old).groupBy(part.cast("int").alias("_part")).agg(F.count("*").alias("n")).collect()  # a row for each range
    counts, before, top = {r["_part"]: r.n for r in sizes}, [], after
    for k in range(max(counts, default=0) + 1):
        before.append(top)
        top += counts.get(k, 0)
    start = F.get(F.array(*[F.lit(n).cast("long") for n in before]), part.cast("int"))
    number = start + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*[c for c in rows.columns if c != key], (F.when(old, F.col(kept)).otherwise(number) if kept else number).alias(key))


def accumulated(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """rows with the sum of weight over each row and all that come before it in the order of the columns, which no two rows share.

    Sums run within ranges of rows, each in its task; only the sums of whole
    ranges, one number for each task, reach the driver.
    """
    spark = rows.sparkSession
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "sums")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    before, offsets = 0, []
    for r in placed.groupBy("_part").agg(F.sum(weight).alias("n")).orderBy("_part").collect():  # a row for each range
        offsets.append((r["_part"], before))
        before += r.n
    ranges = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    running = F.sum(weight).over(Window.partitionBy("_part").orderBy("_place"))
    return placed.withColumn("_running", running).join(ranges, "_part").select(*rows.columns, (F.col("_before") + F.col("_running")).alias(name))


def same(left: str, right: str, columns: list[str]) -> Column:
    """Whether columns with one prefix equal those with another, nulls included."""
    return reduce(Column.__and__, [F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}")) for c in columns])


def keyed(target: DataFrame, values: DataFrame, on: list[str], key: str = "id", order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(values with their key, target with the rows that it lacked).

    A value has the largest key of the target rows that equal it in ``on``, nulls
    included; values that the target lacks get new keys after its largest, in
    their order (by ``order``: columns of which the least of equal values counts,
    which are not added).  A column ``key`` of values is not read.
    """
    values = values.drop(key)
    wanted = values.select(*on, F.lit(None).cast(target.schema[key].dataType).alias("_found"), F.lit(1).alias("_n"), *[F.col(c).alias(f"_o_{c}") for c in order or []])
    known = target.select(*on, F.col(key).alias("_found"), F.lit(0).alias("_n"))
    # one shuffle tells which values are asked for and which of them are there
    groups = wanted.unionByName(known, allowMissingColumns=True).groupBy(*on).agg(F.max("_found").alias("_found"), F.max("_n").alias("_n"), *[F.min(f"_o_{c}").alias(f"_o_{c}") for c in order or []])
    top = target.agg(F.max(key)).first()[0] or 0
    ids = numbered(groups.where("_n = 1").drop("_n"), [f"_o_{c}" for c in order] if order else on, top, "_new", "_found")
    out = values.join(ids.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col("_new").alias(key)), same("", "_k_", on), "left")
    rows = ids.where("_found is null").select(*on, F.col("_new").alias(key))
    rows = rows.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) if c in target.columns else F.col(c) for c in rows.columns])
    return out.drop(*[f"_k_{c}" for c in on]), target.unionByName(rows, allowMissingColumns=True)
