"""The pipeline over small tables, each stage against a brute-force version of it on what the stage before kept."""

import collections
import random
import re
import string
import zlib

import pytest

from test_operators import SCHEMA, SPACE, alnum, jaccard_components, lower

from ionweave.llm import quality, tokenfiles

pipeline = pytest.importorskip("corpus_pipeline")


def tables(spark, folder):
    """Documents of good and bad quality, exact and near copies, passages of the benchmark, null and empty texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 8))) for _ in range(400)]
    passages = [[rng.choice(words) for _ in range(12)] for _ in range(5)]
    rows, labels = [], []
    for i in range(360):
        good, body = rng.random() < 0.7, [rng.choice(words) for _ in range(rng.randint(70, 140))]
        if i % 11 == 0:
            body[20:32] = passages[i % 5]
        if i % 6 == 5 and i > 60:
            good, body = True, list(rows[-1][5])
            if i % 12 == 5:
                body[rng.randrange(len(body))] = rng.choice(words)
        text = (" ".join(body) + ".") if good else "!! ".join(w.upper() for w in body)
        rows.append((i, text, "en", ["a", "b", "c", None][min(rng.randrange(9), 3)], len(text), body))
        labels.append((i, int(good), 0))
    rows = [r[:5] for r in rows] + [(900, None, "en", "a", None), (901, "", None, None, 0), (902, " \n", "en", "b", 2)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, dict(r[:2] for r in labels), passages


def targets(sizes):
    """Target of each source: weights 1, 2, 3 in turn, at most three times its size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    out, left = {}, dict(weight)
    while left:
        rest = sum(sizes.values()) - sum(out.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        above = [s for s in left if share[s] > 3 * sizes[s]]
        if not above:
            return out | share
        out |= {s: 3 * sizes[s] for s in above}
        left = {s: w for s, w in left.items() if s not in above}
    return out


def test_every_stage(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    rows, labels, passages = tables(spark, tmp_path)
    seen = []

    def noted(stage):
        def run(spark, docs, sf_dir):
            seen.append((docs.columns, [tuple(r) for r in docs.collect()]))
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(pipeline, "STAGES", [(n, noted(f)) for n, f in pipeline.STAGES])
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert all(c == seen[0][0] for c, _ in seen) and len(seen) == 5
    given, good, single, clean, taken = (kept for _, kept in seen)
    assert sorted(given) == sorted(rows)
    assert set(taken) <= set(clean) <= set(single) <= set(good) <= set(given)

    # the classifier's decisions, which also fit the labels, held out or not
    scores = quality.scored(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    accepted = {r.doc_id for r in scores if r.predicted}
    assert {r[0] for r in good} == accepted
    assert sum((i in accepted) == q for i, q in labels.items()) > 0.98 * len(labels)

    found = jaccard_components({r[0]: r[1] for r in good}, 5, 80)
    assert len(set(c for _, c in found.values())) < len(good)
    assert sorted(r[0] for r in single) == sorted({c for _, c in found.values()})

    windows = {tuple(p[k : k + 10]) for p in passages for k in range(3)}
    hit = {r[0] for r in single if any(tuple(alnum(r[1])[k : k + 10]) in windows for k in range(len(alnum(r[1])) - 9))}
    assert hit and {r[0] for r in clean} == {r[0] for r in single} - hit

    size = {r[0]: len(re.findall(SPACE, lower(r[1]))) for r in clean}
    of = {r[0]: r[3] for r in clean}
    sizes, got, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for i, n in size.items():
        sizes[of[i]] += n
        largest[of[i]] = max(largest[of[i]], n)
    for r in taken:
        got[r[3]] += size[r[0]]
    assert max(collections.Counter(r[0] for r in taken).values()) <= 3
    for s, target in targets(sizes).items():
        assert abs(got[s] - target) <= largest[s] / 2 + 1e-6

    tokenizer = Tokenizer.from_file(tokenfiles.tokenizer_path(tokenfiles.TOKENIZER))
    want, start = [], 0
    for r in sorted(taken, key=lambda r: r[0]):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out) == want


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
