"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Everything is DataFrame operations.  Only (source, slice, size) sums are
shuffled, never texts: a source is cut into ``SLICES`` slices by a seeded hash
of the document, so that a source with a third of all rows is summed by many
tasks, and only the one slice in which a source's fraction ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SLICES = 4096
SEED = 20240229
#: Passes that fill what is open with documents that fit.
ROUNDS = 2


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with its target.

    One row per source.  Clamping what is above ``max_epochs`` times its size
    and sharing the excess by weight until none is above ends at one level:
    target = min(cap, level * weight).  In order of cap / weight, the clamped
    sources are a prefix, and the level is what the others share by weight.
    Weights repeat in code-point order of the source, null last; a total of 0
    gives targets of 0.
    """
    spark_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(spark_order) - 1) % len(weights) + 1)
    x = sources.withColumn("weight", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    x = x.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    x = x.select(
        "*",
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"),
        F.sum("source_size").over(everything).cast("double").alias("total"),
    )
    # the first source in this order that isn't clamped fixes the level; -1 where none is open
    x = x.withColumn("open", (F.col("total") - F.col("before")) / F.col("left"))
    x = x.withColumn("level", F.min(F.when(F.col("open") <= F.col("ratio"), F.struct("ratio", "open"))).over(everything)["open"])
    return x.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _with(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left with the columns of right (one row a source) of its source; null is a source, too."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _repeats(rows: DataFrame) -> bool:
    """Whether an id, or the null id, has several rows."""
    return not rows.groupBy("doc_id").count().where("count > 1").isEmpty()


def _numbered(rows: DataFrame, path: str) -> DataFrame:
    """rows with copy: 0, 1, ... for rows that repeat doc_id, source and size, in any order, as they are alike here.

    Each input partition numbers its own, from the number of those in the
    partitions before, so that one id's rows don't meet in a task.
    """
    key = ["doc_id", "source", "size"]
    rows = rows.withColumn("_part", F.spark_partition_id())
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_part")).cast("long") - 1)
    # which rows a partition has must not change between the two uses
    rows = written(rows, f"{path}-parts")
    counts = rows.groupBy(*key, "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", before).where("_before is not null").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_part").alias("_of"), "_before")
    same = F.col("_part") == F.col("_of")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(offsets, same, "left").withColumn("copy", F.col("copy") + F.coalesce("_before", F.lit(0))).drop("_part", "_of", "_before", *[f"_{c}" for c in key])


def _fill(rows: DataFrame, open_: DataFrame, slices: int, path: str) -> DataFrame:
    """Takes documents of ``rows`` in seeded order while they fit ``open_`` (source, gap).

    Returns (source, cut, last, gap): slices before the cut are taken whole, the
    cut up to the (turn, doc_id, copy) last, which leaves the gap.
    """
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = _with(sums.withColumn("before", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0))), open_)
    here = F.expr("before <= gap and gap < before + in_slice")
    cut = cut.groupBy("source").agg(F.first("gap").alias("gap"), F.min(F.when(here, F.struct("slice", "before"))).alias("at"), F.sum("in_slice").alias("held"))
    cut = cut.select("source", "gap", "held", F.coalesce("at.slice", F.lit(slices)).alias("cut"), F.col("at.before").alias("before"))
    cut = written(cut, f"{path}-cut")
    inside = Window.partitionBy("source").orderBy("turn", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = _with(rows.select("source", "slice", "turn", "doc_id", "copy", "size"), cut).where("slice = cut")
    edge = edge.withColumn("up_to", F.col("before") + F.sum("size").over(inside)).where("up_to <= gap")
    last = edge.groupBy("source").agg(F.max(F.struct("turn", "doc_id", "copy")).alias("last"), F.max("up_to").alias("reached"))
    reached = F.coalesce("reached", "before", F.least("held", "gap"))
    return written(_with(cut, last, "left").select("source", "cut", "last", (F.col("gap") - reached).alias("gap")), f"{path}-ends")


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for each row of documents.

    A source takes each of its documents floor(target / source size) times.
    The rest comes from its documents in the order of a seeded hash, whole, as
    long as they fit; then in the same way from those that still fit the gap;
    then from the one document left whose size closes the gap best, if that
    helps.  Texts are never cut, so a source misses its target by half of its largest
    document at most, as a rule by a few words, and reruns agree.  Null text counts 0 words; null sources are
    one source; rows that repeat an id, a null one too, are taken or left one by
    one; an empty table gives an empty result; further columns are not read.
    """
    out, _ = _mix(docs, max_epochs, weights, seed, slices)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _mix(docs: DataFrame, max_epochs: int, weights: tuple[int, ...], seed: int, slices: int) -> tuple[DataFrame, bool]:
    """doc_id, source, size, copy, source_size, target and copies (how often a row is taken); and whether ids repeat."""
    base = shared_dir(docs.sparkSession, "mix")
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), f"{base}/sizes")
    repeats = _repeats(sized)
    sized = _numbered(sized, f"{base}/numbered") if repeats else sized.withColumn("copy", F.lit(0).cast("long"))
    sized = sized.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", "size", "copy")).withColumn("slice", F.pmod("turn", F.lit(slices)).cast("int"))

    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(totals, max_epochs, weights)
    plan = plan.withColumn("whole", F.coalesce(F.least(F.floor(F.try_divide("target", "source_size")), F.lit(max_epochs)), F.lit(0)).cast("long"))
    plan = plan.withColumn("gap", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = written(plan, f"{base}/plan")

    rows = _with(sized, plan).withColumn("taken", F.lit(False))
    for k in range(ROUNDS):
        open_ = (ends if k else plan).where("gap > 0").select("source", "gap")
        candidate = ~F.col("taken") & (F.lit(True) if not k else F.col("size") <= F.col("gap"))
        ends = _fill(rows.where(candidate), open_, slices, f"{base}/fill{k}")
        rows = _with(rows, ends.withColumnRenamed("gap", "left_open"), "left")
        upto = (F.col("slice") < F.col("cut")) | ((F.col("slice") == F.col("cut")) & (F.struct("turn", "doc_id", "copy") <= F.col("last")))
        rows = rows.withColumn("taken", F.col("taken") | (candidate & F.coalesce(upto, F.lit(False))))
        rows = rows.withColumn("gap", F.coalesce("left_open", F.lit(0))).drop("cut", "last", "left_open")
    off = F.abs(F.col("size") - F.col("gap"))
    closer = rows.where(~F.col("taken") & (off < F.col("gap")))
    closer = closer.groupBy("source").agg(F.min(F.struct(off.alias("miss"), "turn", "doc_id", "copy")).alias("extra"))
    extra = F.coalesce(~F.col("taken") & (F.struct("turn", "doc_id", "copy") == F.struct("extra.turn", "extra.doc_id", "extra.copy")), F.lit(False))
    copies = F.least(F.col("whole") + (F.col("taken") | extra).cast("long"), F.lit(max_epochs).cast("long"))
    return _with(rows, closer, "left").select("doc_id", "source", "size", "copy", "source_size", "target", copies.alias("copies")), repeats


def mixed(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    Rows that repeat an id, a null one too, are taken one by one; which of those
    with equal sizes is taken is open.
    """
    taken, repeats = _mix(docs, max_epochs, weights, seed, SLICES)
    key = ["doc_id", "source", "size", "copy"] if repeats else ["doc_id"]
    taken = taken.where("copies > 0").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("copies").alias("_copies"))
    # the documents' own columns under other names, as they may be called like those of the mix
    names = [f"_doc{k}" for k in range(len(docs.columns))]
    rows = docs.select("doc_id", "source", *([words(F.col("text")).alias("size")] if repeats else []), *[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    if repeats:
        rows = _numbered(rows, f"{shared_dir(docs.sparkSession, 'mixed')}/numbered")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = rows.join(taken, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return rows.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
