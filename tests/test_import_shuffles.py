"""What a whole import shuffles: names, keys and the sections that a step reads, not whole objects."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F
from test_full_import import library, sample_object

from ionweave.operators import keys
from ionweave.plans import full_import, objects


def shuffled(spark) -> int:
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_whole_objects_are_not_shuffled(spark):
    draw = random.Random(1)
    texts = [(f"o{k}", json.dumps(sample_object(k, peak=sample_object(k)["peak"] | {"note": draw.randbytes(100_000).hex()}))) for k in range(20)]
    rows = keys.staged(objects.import_objects(spark.createDataFrame(texts, "object string, text string")))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        out = full_import.full_import(rows, library(spark))
        assert sorted(r.object for r in out.objects.select("object").collect()) == sorted(o for o, _ in texts)
        # 2 MB of notes, which no step reads, and which can't be compressed
        assert shuffled(spark) - before < 1_500_000
        assert out.tables["peaks"].count() == 20 and out.tables["ms_data"].count() == 40
        links = out.tables["compound_fragments"]
        assert links.count() == 40 and links.where("peak_id is null or compound_id is null or annotated_fragment_id is null").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_objects_without_fragments_or_twice_link_peak_and_compound(spark):
    lists = {"none": None, "empty": [], "blank": [{"fragment_mz": ""}], "no formula": [{"fragment_mz": 5}], "twice": [], "good": sample_object(0)["annotation"]}
    texts = [(name, json.dumps(sample_object(k) | {"annotation": value})) for k, (name, value) in enumerate(lists.items())]
    texts.append(texts[-2])
    out = full_import.full_import(objects.import_objects(spark.createDataFrame(texts, "object string, text string")), library(spark))
    links = out.objects.join(out.tables["compound_fragments"], ["peak_id", "compound_id"], "left").groupBy("object").agg(F.count("peak_id").alias("n"), F.count("annotated_fragment_id").alias("found"))
    assert {r.object: (r.n, r.found) for r in links.collect()} == {"none": (1, 0), "empty": (1, 0), "blank": (1, 0), "no formula": (1, 0), "twice": (1, 0), "good": (2, 2)}


def test_kept_keys_take_no_number(spark):
    values = spark.createDataFrame([(f"v{k:02d}", 100 + k if k % 3 == 0 else None) for k in range(30)], "v string, old long").repartition(5)
    got = {r.v: r.id for r in keys.numbered(values, ["v"], after=7, kept="old").collect()}
    assert [got[f"v{k:02d}"] for k in range(0, 30, 3)] == [100 + k for k in range(0, 30, 3)]
    assert [got[f"v{k:02d}"] for k in range(30) if k % 3] == list(range(8, 28))
