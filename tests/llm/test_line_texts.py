"""What op2_line_dedup moves of the lines' texts, and the short cuts to their keys, normal forms and numbers."""

import random
import re
import string

from pyspark.sql import functions as F

from ionweave.llm import linededup


def shuffled(spark):
    """Bytes that this session has written for shuffles."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_few_texts_are_shuffled(spark):
    """Texts of lines without a near copy stay where they are, also where none of the sides can be broadcast."""
    rng = random.Random(21)
    lines = ["".join(rng.choice(string.ascii_lowercase) for _ in range(5000)) for _ in range(400)]
    lines += [x[:-1] + "!" for x in lines[:10]]
    size = sum(len(x) for x in lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    docs.count()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {r.doc_id: r.dropped for r in linededup.duplicate_lines(docs).collect()}
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {k: [0] if k >= 400 else [] for k in range(len(lines))}
    assert moved < 0.4 * size


def test_a_bitmap_loses_no_row(spark, monkeypatch):
    """All rows asked for come back, few others do, and the bitmap has no more words than its limit."""
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    asked = rows.where("id % 50 = 7")
    for places, most in ((linededup.PLACES, 20_000 / 50 + 20_000 / 10), (64, 20_000)):
        monkeypatch.setattr(linededup, "PLACES", places)
        for by in ("h", "id"):
            found = linededup._among(rows, asked.select(by), by)
            assert found.columns == ["h", "id"] and found.where("id % 50 = 7").count() == 400 and found.count() <= most
    assert linededup._among(rows, asked.where("false"), "h").count() == 0


def test_keys_by_shared_places(spark):
    """Keys with lengths and places found once are those of line_keys; texts of any alphabet are cut between characters."""
    rng = random.Random(22)
    lines = ["".join(rng.choice("abé日😀 ") for _ in range(n)) for n in (*range(60), 1000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for edits in (linededup.EDITS, ((1, 2),), ((9, 1),)):
        plain = df.select(*[c.alias(f"key{s}") for s, c in enumerate(linededup.line_keys(F.col("line"), edits))]).collect()
        assert plain == linededup._keyed(df, edits).collect()
        assert any(x is not None for r in plain for x in r)


def test_edits_beside_wide_characters(spark):
    long = "ab😀cd日本é" * 4
    lines = [long, long[:3] + "x" + long[4:], long[:10] + long[12:], "😀" + long, long + "abc", long[:20]]
    links = linededup.edit_links(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    # the second and third are three edits apart
    assert sorted((r.a, r.b) for r in links.collect()) == [(0, 1), (0, 2), (0, 3), (1, 3)]


def test_spaces_and_numbers_of_lines(spark):
    """The normal form of texts with and without odd spaces, and the lines of blank, null and nameless documents."""
    texts = ["A b\nc", "a  b", "a\tb", "a \t\x0b\f\r b\r\n  c ", "\t", "a b\r", "\n\n", "", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.x for r in df.select(linededup.normalised(F.col("text")).alias("x")).collect()]
    assert got == [t if t is None else re.sub(r"[^\S\n]+", " ", t.lower()) for t in texts]
    docs = df.unionByName(df.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(df.where("doc_id = 0"))
    found = {r.doc_id: r.n_lines for r in linededup.duplicate_lines(docs).collect()}
    want = {k: 0 if t is None else t.count("\n") + 1 for k, t in enumerate(texts)}
    assert found == want | {0: 4, None: sum(want.values())}
