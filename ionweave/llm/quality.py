"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Statistics of whole texts are computed with numpy in tasks.  A random forest on
a bounded sample of labelled rows gives candidate rules (the conjunctions of
its tree paths); a lasso logistic regression gives most of them a weight of 0;
the rest becomes one column expression, so scoring runs inside Spark's
generated code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_dir, written
from .textblocks import Words, blocks, strings

#: At most about so many labelled rows, chosen by a hash of their id, are fitted.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.001, 7
THRESHOLD = 0.7
STATS = (
    "words", "letters_a_word", "upper", "digit", "mark", "symbol", "pipe", "bang", "stop", "line", "foreign", "upper_words", "distinct", "repeat", "pairs", "long_words", "symbol_ends",
)
_PREFIX = "_stat_"


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_CLASSES = {
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _table("0123456789"),
    "mark": _table("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())),
    "symbol": _table("#$%&*+<=>@[\\]^_`{|}~"),
    "pipe": _table("|"),
    "bang": _table("!?"),
    "stop": _table("."),
    "line": _table("\n"),
}
_CONTINUED = np.zeros(256, bool)
_CONTINUED[128:192] = True
_FOREIGN = np.zeros(256, bool)
_FOREIGN[192:] = True


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text, whole; shares are per letter or per word, 0 where there are none."""
    words = Words(texts)
    data, offsets = words.data, words.offsets

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (upto[bounds[1:]] - upto[bounds[:-1]]).astype(float)

    n = np.maximum(words.counts, 1).astype(float)
    letters = np.maximum(np.diff(offsets) - per_text(_CONTINUED[data], offsets), 1)
    out = {"words": np.log1p(words.counts.astype(float))}
    out |= {name: per_text(flag[data], offsets) / (n if name in ("stop", "line") else letters) for name, flag in _CLASSES.items()}
    out["foreign"] = per_text(_FOREIGN[data], offsets) / letters
    length = words.ends - words.starts
    out["letters_a_word"] = per_text(length, words.first) / n
    out["long_words"] = per_text(length > 20, words.first) / n
    upper = _CLASSES["upper"]
    second = data[np.minimum(words.starts + 1, max(len(data) - 1, 0))] if len(length) else np.zeros(0, np.uint8)
    out["upper_words"] = per_text(upper[data[words.starts]] & upper[second] & (length > 1), words.first) / n
    out["symbol_ends"] = per_text(_CLASSES["symbol"][data[words.ends - 1]], words.first) / n
    h, of_text = words.hashes, words.of_text()
    inner = np.concatenate([of_text[1:] == of_text[:-1], [False]]) if len(h) else np.zeros(0, bool)
    after = np.roll(h, -1)
    out["repeat"] = per_text(inner & (h == after), words.first) / n
    for name, x in (("distinct", h), ("pairs", h * np.uint64(31) + after)):
        # distinct values of each text: sort (text, hash) packed in 64 bits
        key = np.sort((of_text.astype(np.uint64) << np.uint64(40)) | (x >> np.uint64(24)))
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        out[name] = per_text(new, words.first) / n
    return {name: out[name] for name in STATS}


def free_prefix(columns: list[str]) -> str:
    """A prefix for the statistics' names that no column has, in any case of letters."""
    prefix = _PREFIX
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def with_statistics(docs: DataFrame, prefix: str = _PREFIX) -> DataFrame:
    """The rows with a column for each statistic, its name after the prefix; null text counts as empty."""
    kinds = T.StructType([*docs.schema.fields, *(T.StructField(prefix + s, T.DoubleType()) for s in STATS)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                stats = statistics(strings(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, stats.values())], names=[*part.schema.names, *(prefix + s for s in stats)])

    return docs.mapInArrow(add, kinds)


Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class Ensemble:
    """intercept + sum of the weights of the rules that hold; a rule is a conjunction of (statistic, is above, bound)."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, prefix: str = _PREFIX) -> Column:
        """The probability of label 1, over the columns of with_statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(holds(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(rule: Rule, prefix: str = _PREFIX) -> Column:
    out = F.lit(True)
    for k, above, bound in rule:
        stat = F.col(prefix + STATS[k])
        out = out & (stat > bound if above else stat <= bound)
    return out


def paths(forest) -> list[Rule]:
    """The paths to all nodes of a fitted forest's trees, as rules without repeats."""
    found: dict[Rule, None] = {}

    def walk(node, rule: dict[tuple[int, bool], float]) -> None:
        if rule:
            found[tuple((k, above, bound) for (k, above), bound in sorted(rule.items()))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            k, bound = node.split().featureIndex(), node.split().threshold()
            walk(node.leftChild(), rule | {(k, False): min(bound, rule.get((k, False), bound))})
            walk(node.rightChild(), rule | {(k, True): max(bound, rule.get((k, True), bound))})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Ensemble:
    """An ensemble from rows with the statistics and a label (0 or 1); others' labels must be left out before.

    Of more than ``rows`` rows, about so many are fitted, chosen by a hash of
    doc_id.  Without both labels among them, all texts score the share of 1 (0.5
    if there are none).
    """
    path = shared_dir(labelled.sparkSession, "quality")
    n = labelled.count()
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, rows / max(n, 1)) * (1 << 20)))
    stats = [_PREFIX + s for s in STATS]
    chosen = written(chosen.select(F.col("label").cast("double").alias("label"), *stats).repartition(6).sortWithinPartitions(*stats, "label"), f"{path}/chosen")
    ones = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    if len(ones) < 2:
        share = min(max(next(iter(ones), 0.5), 0.01), 0.99)
        return Ensemble(float(np.log(share / (1 - share))), ())
    train = chosen.select("label", array_to_vector(F.array(*stats)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(train)
    rules = paths(forest)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60)
    model = lasso.fit(chosen.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features")))
    weights = model.coefficients.toArray()
    return Ensemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def labelled_rows(stats: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """Rows of stats (doc_id and statistics) that may be learned from, with label = labels.quality."""
    own = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return stats.where(may_learn).join(own, "doc_id")


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text (null: empty) leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each document; labels of held-out rows aren't read."""
    stats = written(with_statistics(docs.select("doc_id", "text")).drop("text"), f"{shared_dir(docs.sparkSession, 'stats')}/rows")
    model = fit(labelled_rows(stats, labels, ~is_held_out(F.col("doc_id"))), rows)
    out = stats.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose score reaches the threshold, whole and with all their columns, whatever their names.

    Null texts count as empty; rows that repeat an id are scored one by one, and
    rows without one are scored, but not learned from.
    """
    prefix = free_prefix(docs.columns)
    stats = written(with_statistics(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())).drop("text"), f"{shared_dir(docs.sparkSession, 'stats')}/rows")
    model = fit(labelled_rows(stats, labels, ~is_held_out(F.col("doc_id"))), rows)
    return with_statistics(docs, prefix).where(model.score(prefix) >= threshold).select(*docs.columns)
