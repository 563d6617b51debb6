"""Audit of filters that overlap: what each removes in every order they can be applied in.

A relational pipeline.  Words are exploded and aggregated by document and word,
then by document; the other conditions are outer-joined; each document then has
one of 32 sets of failed filters, and counting these sets for each part is all
that the 120 orders need.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filter letters; bit k of a set stands for the k-th letter.
FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: Characters between words: space, tab to carriage return.
_BETWEEN = r"[\x20\x09-\x0D]+"
_ENDS = " \t\n\x0b\x0c\r"
_KEY = ["doc_id", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, part, text (null: empty), and text_key, which tells rows of one id apart by their texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def word_totals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words and n_distinct of each different text of an id.

    Texts are dealt out by id once; both aggregations then find the rows of a
    document together.  Each row adds an empty word, so the number of its
    copies is counted along with the words.
    """
    trimmed = F.btrim("text", F.lit(_ENDS))
    words = F.concat(F.array(F.lit("")), F.when(trimmed != "", F.split(trimmed, _BETWEEN)).otherwise(F.array().cast("array<string>")))
    exploded = docs.select(*_KEY, "text").repartition(*_KEY).select(*_KEY, F.explode(words).alias("word"))
    by_word = exploded.groupBy(*_KEY, "word").agg(F.count("*").alias("n"))
    copies = F.max(F.when(F.col("word") == "", F.col("n")))
    n = F.sum(F.when(F.col("word") != "", F.col("n")).otherwise(0))
    return by_word.groupBy(*_KEY).agg((n / copies).cast("long").alias("n_words"), (F.count("*") - 1).alias("n_distinct"))


def failed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (the set of filters that fail, as bits) and n: how many rows of this id, text and part there are.

    Of equal texts those fail E whose doc_id is above the smallest; a row without
    doc_id never does, nor does it make others fail.
    """
    rows = _keyed(docs)
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = rows.select(*_KEY, "part", F.sha2("text", 256).alias("digest"), (100 * upper > MAX_UPPER * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    flags = flags.groupBy(*_KEY, "part", "digest", "c", "d").agg(F.count("*").alias("n"))
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    flags = flags.join(first, ["doc_id", "digest"], "left")
    totals = word_totals(rows).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_words", "n_distinct")
    joined = flags.join(totals, flags["doc_id"].eqNullSafe(totals["_id"]) & (flags["text_key"] == totals["_key"]), "left")
    n_words, n_distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    conditions = [n_words < MIN_WORDS, 100 * n_distinct < MIN_DISTINCT * n_words, F.col("c"), F.col("d"), F.col("doc_id").isNotNull() & F.col("is_first").isNull()]
    failed = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(conditions)), F.lit(0))
    return joined.select("doc_id", "part", failed.alias("failed"), "n")


def set_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part: of all documents, the good and the toxic ones, the number in each of the 32 sets, as arrays."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed.join(known, "doc_id", "left")

    def count(name: str, k: int, also: Column) -> Column:
        return F.sum(F.when((F.col("failed") == k) & also, F.col("n")).otherwise(0)).alias(f"{name}{k}")

    kinds = {"counts": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    wide = rows.groupBy("part").agg(*[count(name, k, also) for name, also in kinds.items() for k in range(SETS)])
    return wide.select("part", *[F.array(*[f"{name}{k}" for k in range(SETS)]).alias(name) for name in kinds])


def _steps() -> list[dict]:
    """Each step of each order: the bit of its filter, and the bits of those before."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley; zeros included.

    A part is a value of lang (null: empty string); each has 600 rows.  Null
    texts count as empty.  Rows of one id are judged one by one, copies of a row
    as often as they occur; they share the labels of their id, and of several
    labels of an id the largest counts.  Rows without id have no label.  Long
    texts are whole in one task, their words in hash tables that can spill.  No
    documents give no rows; other columns are not read.
    """
    table = set_counts(failed_sets(docs), labels)
    step = F.explode(F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")).alias("s")
    rows = table.select("*", step).select("part", "counts", "good", "toxic", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(column: str, holds) -> Column:
        numbers = F.transform(column, lambda n, k: F.when(holds(k.cast("int")), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)

    fails = lambda k: k.bitwiseAND(bit) != 0
    removed = lambda k: fails(k) & (k.bitwiseAND(before) == 0)
    rows = rows.select(
        "part", "filter_order", "step", "bit",
        total("counts", lambda k: k.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("counts", removed).alias("removed"),
        total("counts", lambda k: fails(k) & (k.bitwiseAND(before) != 0)).alias("redundant"),
        total("counts", lambda k: k == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
