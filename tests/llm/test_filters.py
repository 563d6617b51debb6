"""Filter audit, repetition rules and vector codes against brute force, with nulls, repeats, ties and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionweave.llm import filteraudit, repetition, vectorcodes

DOCS = "doc_id long, text string, lang string, source string, failed string"
WORD = r"[^\x20\x09-\x0D]+"


def _fails(rows):
    smallest = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc_id), doc_id)
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(WORD, text)
        a, b = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
        c, d = 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))
        yield doc_id, lang or "", dict(zip("ABCDE", (a, b, c, d, doc_id is not None and smallest[text] < doc_id), strict=True))


def _audit(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found, shapley = {}, Counter()
    for doc_id, part, fails in _fails(rows):
        for order in permutations("ABCDE"):
            dropped = False
            for step, letter in enumerate(order, 1):
                n = found.setdefault((part, "".join(order), step), [0] * 6)
                if fails[letter] and not dropped:
                    n[1] += 1
                    n[4] += doc_id in good
                    n[5] += doc_id in toxic
                    shapley[part, letter] += 1
                elif fails[letter]:
                    n[2] += 1
                dropped |= fails[letter]
                n[0] += not dropped
                n[3] += fails[letter] and sum(fails.values()) == 1
    return {k: (*n, shapley[k[0], k[1][k[2] - 1]]) for k, n in found.items()}


def _audited(spark, rows, labels):
    out = filteraudit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}


def test_audit_like_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one two", " " + " ".join(f"w{k}" for k in range(250)) + "\x0b", "A" + " b" * 300, "x | y", "Many Words Of Upper CASE", " ".join(f"é{k % 90}" for k in range(210)), "w#" * 3]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""]), "s", "x") for k in range(60)]
    rows += [(5, texts[4], "en", "s", None), (5, texts[4], "en", "s", None), (5, texts[4], "fr", "s", None), (5, texts[7], "en", "s", None), (None, texts[4], "en", "s", None), (None, None, None, None, None), (None, texts[3], "en", "s", None), (70, texts[7], "xx", "s", None)]
    labels = [(k, k % 2, k % 3) for k in range(0, 50, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1), (5, 1, 0)]
    assert _audited(spark, rows, labels) == _audit(rows, labels)


def test_audit_of_nothing(spark):
    assert _audited(spark, [], []) == {}
    assert len(_audited(spark, [(1, "a", "en", "s", "x")], [])) == 600


def _repeats(text, least):
    words = re.findall(WORD, text)
    n, places = len(words), {}
    for i in range(n):
        for j in range(i + least, n + 1):
            places.setdefault(tuple(words[i:j]), []).append(i)
    covered, maximal, longest = set(), 0, 0
    for sub, at in places.items():
        if len(at) > 1:
            longest = max(longest, len(sub))
            covered |= {k for i in at for k in range(i, i + len(sub))}
            before = {words[i - 1] if i else None for i in at}
            after = {words[i + len(sub)] if i + len(sub) < n else None for i in at}
            maximal += len(before) > 1 and len(after) > 1
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    out = {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines))}
    return out | {"n_repeat_words": len(covered), "repeat_chars": sum(len(words[k]) for k in covered), "n_repeats": maximal, "longest_repeat": longest}


@pytest.mark.parametrize("least", [1, 2, 3, 8])
def test_repeats_like_brute_force(least):
    rng = random.Random(least)
    for _ in range(40):
        texts = ["".join(rng.choice(["a", "é", "b#"][: rng.choice([1, 2, 3])]) + rng.choice([" ", "\n", "  ", "\t \n"]) for _ in range(rng.choice([0, 1, 9, 40])))[rng.randint(0, 2) :] for _ in range(rng.randint(0, 6))]
        counts, spans = repetition.measures(pa.array(texts, pa.large_string()), least)
        for k, text in enumerate(texts):
            want = _repeats(text, least)
            assert {c: int(counts[c][k]) for c in want} == want, text
            assert sum(int(b - a) for a, b in spans[k]) == want["n_repeat_words"]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(repetition, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    text = "a b c d a b c e\nlonger-than-eight longer-than-eighu\nx"
    counts, _ = repetition.measures(pa.array([text], pa.large_string()), 2)
    want = _repeats(text, 2)
    assert {c: int(counts[c][0]) for c in want} == want


def test_repetition_verdicts(spark):
    unique = [f"w{k}" for k in range(2000)]
    passage = unique[:150]
    texts = {
        1: " ".join(unique), 2: None, 3: "", 4: " ".join(unique[:19]), 5: " ".join(unique[:20]), 6: " ".join(unique[:30] * 4),
        7: " ".join(passage + unique[200:1900] + passage), 8: " ".join(unique[:90] + unique[200:1900] + unique[:90]),
        9: " ".join(["a-word-of-many-letters"] * 60 + [f"v{k}" for k in range(300)]),
    }
    rows = [(k, t, "en") for k, t in texts.items()] + [(1, " ".join(unique), None), (None, "a b", "en")]
    out = repetition.measured(spark.createDataFrame(rows, "doc_id long, text string, n_words string"))
    got = out.select("doc_id", repetition.base_failed().alias("base"), repetition.is_kept().alias("kept"), "longest_repeat", "repeat_spans").collect()
    verdicts = [(r.doc_id, r.base, r.kept) for r in got]
    # 7 holds one repeat of 150 words, 9 has its repeated letters in a sixth of its words
    want = [(1, False, True), (2, True, False), (3, True, False), (4, True, False), (5, False, True), (6, True, False), (7, False, False), (8, False, True), (9, False, False), (1, False, True), (None, True, False)]
    assert Counter(verdicts) == Counter(want)
    assert next(r for r in got if r.doc_id == 7).repeat_spans == [(0, 150), (1850, 2000)]
    assert out.where("doc_id = 7").select("n_words").collect() == [(2000,)]
    assert repetition.measured(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def _codes(rows, parts, entries, rounds):
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(v is not None and np.isfinite(v) for v in vector):
            kept.append((vec_id, [int(np.floor(np.float64(v) * 256)) for v in vector], label))
    size = len(min(kept, key=lambda r: (r[0], r[1]))[1])
    kept = [r for r in kept if len(r[1]) == size]
    width = size // parts
    first = sorted(kept, key=lambda r: (r[0], r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, x, _ in kept:
                part = x[p * width : (p + 1) * width]
                own.setdefault(best(part, books[p])[1], []).append(part)
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    coded = []
    for vec_id, x, label in kept:
        found = [best(x[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        coded.append((vec_id, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    totals = Counter()
    for *_, error, label in coded:
        totals[label] += error
    return Counter((v, code, error, totals[label], digest) for v, code, error, label in coded)


@pytest.mark.parametrize("seed", range(3))
def test_vector_codes_like_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(300), [rng.choice([0.0, 0.25, -0.001, rng.gauss(0, 1), rng.gauss(0, 1) * 200]) for _ in range(8)], rng.choice([1, 2, None])) for _ in range(300)]
    rows += [rows[0], rows[1], (7, [float("nan")] * 8, 1), (8, [None] + [0.5] * 7, 1), (9, [float("inf")] * 8, 1), (10, [float("-inf")] * 8, None), (11, None, 1), (2, [0.0] * 8, 3), (2, [0.0] * 8, 3)]
    schema = "vec_id long, embedding array<float>, label int, code string"
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]  # as float32
    got = Counter(map(tuple, vectorcodes.compressed(df, 4, 16, 2).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    assert got == _codes(rows, 4, 16, 2)


def test_vector_codes_of_few_or_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label string"
    empty = vectorcodes.compressed(spark.createDataFrame([(1, None, "a")], schema))
    assert empty.collect() == [] and [c for c, _ in empty.dtypes] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    two = vectorcodes.compressed(spark.createDataFrame([(None, [1.0, 2.0], "a"), (3, [1e30, -1e30], "a"), (4, [1.0], "b")], schema), parts=2, entries=4)
    assert sorted((r.vec_id or 0, r.code, r.error) for r in two.collect()) == [(0, "0101", 0), (3, "0000", 0)]
    with pytest.raises(ValueError, match="cut"):
        vectorcodes.compressed(spark.createDataFrame([(1, [1.0] * 3, "a")], schema), parts=2)
    coded = spark.createDataFrame([(k, f"l{k % 2000}", 1) for k in range(4000)] + [(k, None, 2) for k in range(500)], "vec_id long, label string, error long")
    totals = {(r.label, r.label_error): r.n for r in vectorcodes.with_label_error(coded).groupBy("label", "label_error").agg(F.count("*").alias("n")).collect()}
    assert totals.pop((None, 1000)) == 500 and len(totals) == 2000 and set(totals.values()) == {2} and all(e == 2 for _, e in totals)


def test_screening_is_exact_where_float32_is_not():
    rng = np.random.default_rng(5)
    for width, reach in ((4, 1 << 24), (4, 3), (64, 1 << 20), (1, 50)):
        entries = rng.integers(-reach, reach + 1, (64, width))
        x = np.concatenate([entries + rng.integers(-1, 2, entries.shape), rng.integers(-reach, reach + 1, (5000, width))])
        index, distance = vectorcodes.nearest(x, entries)
        exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(index, exact.argmin(axis=1)) and np.array_equal(distance, exact.min(axis=1))


def test_a_chain_of_hosts_is_judged_to_its_end(spark):
    """46 hosts in a chain to a blocked one: distrust reaches all, none has trust."""
    from ionweave.llm import urlfilter

    n = 46
    pages = [(k, f"http://h{k}.com/", f'<a href="http://h{k + 1}.com/">') for k in range(n)] + [(n, f"http://h{n}.com/", '<a href="http://bad.net/">'), (n + 1, "http://bad.net/", ""), (n + 2, "http://alone.com/", "")]
    out = {r.page_id: r for r in urlfilter.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [out[k].verdict for k in range(n + 3)] == ["block"] * (n + 2) + ["allow"]
    # against edges of one link each: every step keeps the damping's share
    for k in range(n + 1):
        assert out[k].distrust == pytest.approx(0.15 * 0.85 ** (n + 1 - k), rel=0.02)


def test_lines_of_rows_that_share_an_id(spark):
    from ionweave.llm import linededup

    rows = [(0, "a line that is there already, once", "x"), (1, "first of row a\na line that is there already, once", "a"), (1, "first of row b\nUNIQUE text nowhere else at all 123", "b")]
    out = linededup.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string, tag string"))
    assert {r.tag: r.text for r in out.collect()} == {"x": rows[0][1], "a": "first of row a", "b": rows[2][1]}


def test_join_of_ids_that_are_texts(spark):
    from ionweave.llm import ngramjoin

    text = " ".join(f"w{k}" for k in range(40))
    rows = [("b", text), ("a", text + " more"), ("c", "other words of its own kind"), (None, text), ("d", None), ("é", text)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.linked(docs).collect()}
    assert got == {"a": (38, "a"), "b": (37, "a"), "é": (37, "a"), "c": (3, "c"), "d": (0, "d"), None: (0, None)}
    kept = sorted((r.doc_id or "", r.text or "") for r in ngramjoin.deduplicated(docs).collect())
    assert kept == sorted([("a", text + " more"), ("c", "other words of its own kind"), ("", text), ("d", "")])


def test_accepted_keeps_columns_named_like_statistics(spark):
    from ionweave.llm import quality

    rows = [(k, ("plain words of a sentence with more in it. " if k % 2 else "## | $$ ## | $$ ") * (k % 5 + 5), k) for k in range(60)] + [(None, "words here", 1), (3, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _STAT_words long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    out = quality.accepted(docs, labels)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.where("doc_id is not null and text is not null").collect()]
    assert sorted(kept) == [k for k in range(60) if k % 2]
