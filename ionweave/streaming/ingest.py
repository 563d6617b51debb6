"""Incremental loads: new rows get their dimension keys batch by batch, and watermarked counts of scans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ionweave.operators.relational import normalize_key


def load_with_keys(rows: DataFrame, column: str, dimension: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to the table target, with the column's texts replaced by keys of the dimension table, which grows.

    Each batch adds its texts to the dimension before the rows; one that is run
    again finds them there, and replaces the rows that it wrote before.  Streams
    are told apart by the id that their checkpoint keeps, so several can fill one
    table, one after the other, and a new checkpoint is a new stream.
    """

    def load(batch: DataFrame, number: int) -> None:
        stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        load_batch(batch, number, column, dimension, target, stream)

    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_batch(batch: DataFrame, number: int, column: str, dimension: str, target: str, stream: str = "") -> None:
    """One batch of a stream; running it again changes nothing.

    The target is partitioned by stream and batch, and a batch overwrites its own
    partition, whatever of it an earlier run has written.
    """
    spark = batch.sparkSession
    _, grown = normalize_key(batch, column, spark.table(dimension))
    grown.join(spark.table(dimension).select("id"), "id", "left_anti").write.mode("append").saveAsTable(dimension)
    rows = normalize_key(batch, column, spark.table(dimension))[0]
    if spark.catalog.tableExists(target):
        place = f"stream = '{stream.replace(chr(39), chr(39) * 2)}', batch = {int(number)}"
        columns = [c for c in spark.table(target).columns if c not in ("stream", "batch")]
        spark.sql(f"insert overwrite table {target} partition ({place}) select * from {{rows}}", rows=rows.select(*columns))
    else:
        rows.withColumns({"stream": F.lit(stream), "batch": F.lit(number)}).write.partitionBy("stream", "batch").saveAsTable(target)


def scan_rates(scans: DataFrame, time: str, level: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Scans and summed intensity for each window and level; rows later than ``late`` are dropped."""
    kept = scans.withWatermark(time, late)
    return kept.groupBy(F.window(time, window).alias("window"), level).agg(F.count("*").alias("n"), F.sum("value").alias("intensity"))
