"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import pathlib
import random
import re
import string
import zlib

import pytest
from pyspark.sql import functions as F

from ionweave.llm import components, decontaminate, exactdedup, linededup, lm, mixing, ngramjoin, personal, quality, shared, tokenfiles, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts(seed, n, vocabulary=60, longest=60):
    """Texts with near copies, exact copies in other case, empty, blank, null, non-ASCII and very long ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(string.ascii_letters + "éß") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.3:
            words = (rng.choice(out) or "x").split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
        elif out and kind < 0.4:
            out.append((rng.choice(out) or "").upper())
        else:
            out.append(rng.choice([" ", "\n", "  "]).join(rng.choice(vocab) for _ in range(rng.randint(1, longest))))
    return [*out, "", " \t\n", None, "word", "日本 語 テキスト 日本 語", " ".join(vocab * 200), "a" * 50_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts(1, 150))]
    df = spark.createDataFrame(rows, SCHEMA)
    # names that the operators use themselves
    return df.withColumns({c: F.lit("clash") for c in ("size", "label", "sig", "n", "doc", "rep", "slice", "recipe", "score")}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_exact_groups(docs, empty):
    want = collections.defaultdict(list)
    for i, t in rows_of(docs).items():
        want[lower(t)].append(i)
    for digest in (16, 1):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.exact_groups(docs, digest).collect()}
        assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in want.items() for i in g}
    assert exactdedup.exact_groups(empty).count() == 0


def test_chunks_cover_texts():
    import numpy as np

    rng = np.random.default_rng(0)
    data = np.concatenate([rng.integers(0, 256, 300_000, dtype=np.uint8), np.zeros(200_000, np.uint8)])
    offsets = np.array([0, 0, 5, 300_000, 500_000])
    found = exactdedup.chunk_ends(data, offsets)
    assert found[0] == [] and found[1] == [5]
    for ends, a, b in zip(found[2:], offsets[2:-1], offsets[3:], strict=True):
        assert ends[-1] == b and all(0 < y - x <= exactdedup.MAX_CHUNK for x, y in zip([a, *ends], ends, strict=False))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_contamination(spark, docs, empty):
    own = [t for t in rows_of(docs).values() if t]
    items = [(1, " ".join(own[3].split()[:14])), (2, own[5]), (3, "Word"), (4, None), (5, ""), (6, "--- !!"), (7, own[5].upper()), (2, own[5]), (8, "nowhere to be found at all")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    patterns = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(len(w) - 9) if len(w) >= 10 else [0] if w else []:
            patterns[tuple(w[k : k + 10])].add(i)
    for r in decontaminate.contamination(docs, benchmark).collect():
        w, hit, found = alnum(rows_of(docs)[r.doc_id]), set(), set()
        for p, ids in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= ids
        assert (r.n_words, r.n_hit, r.items) == (len(w), len(hit), sorted(found))
        assert {k for s in r.spans for k in range(s.start, s.end)} == hit
    clean = {r.doc_id for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert clean == {r.doc_id for r in decontaminate.contamination(docs, benchmark).where("n_hit = 0").collect()}
    named = decontaminate.contamination(docs, benchmark.withColumn("item_id", F.concat(F.lit("gsm-"), "item_id")))
    plain = {r.doc_id: sorted(f"gsm-{i}" for i in r["items"]) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert {r.doc_id: r["items"] for r in named.collect()} == plain
    assert decontaminate.contamination(docs, benchmark.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(empty, benchmark).count() == 0


def jaccard_components(found, k, percent):
    sets = {}
    for i, t in found.items():
        w = re.findall(SPACE, lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (1, 80)])
def test_ngram_join(docs, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.linked(docs, k, percent).collect()}
    assert got == jaccard_components(rows_of(docs), k, percent)


def test_ngram_join_of_frequent_tokens(spark):
    """Few distinct words, so that all tokens are frequent and only pairs of them are indexed."""
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = rng.choice("abcdefghij")
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.linked(docs).collect()}
    assert got == jaccard_components(dict(rows), 4, 85)
    kept = {r.doc_id for r in ngramjoin.deduplicated(docs, 4, 85).collect()}
    assert kept == {c for _, c in got.values()}


def test_ngram_join_of_nothing(spark, empty):
    assert ngramjoin.linked(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (1, None), (2, "a b c d e")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngramjoin.linked(nulls).collect()} == {(None, None), (1, 1), (2, 2)}
    assert ngramjoin.deduplicated(nulls).count() == 3


def test_signatures_keep_similar_sets():
    """Any two sets that are similar enough share a signature, whatever tokens count as rare."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 160))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(x) // 6) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, len(x) // 8) + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both) and len(y):
            bound = np.uint64(rng.choice([0, 2**61, 2**62, 2**63]))
            a, b = (ngramjoin.signatures(s, s < bound, 85) for s in (x, y))
            assert len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, None)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {i: i for a, b in links if b is not None for i in (a, b)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}


def test_mix(docs, empty, spark):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    found = {r.doc_id: r for r in docs.collect()}
    sizes = collections.Counter()
    for r in rows:
        assert r.size == len(re.findall(SPACE, found[r.doc_id].text or ""))
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[found[r.doc_id].source] += r.size
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(3 * sizes[s] for s in fixed)
        target = {s: 3.0 * sizes[s] if s in fixed else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= set(over)
    for s in order:
        own = [r for r in rows if found[r.doc_id].source == s]
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(30, 0.02 * target[s], max(r.size for r in own) / 2 + 1)
    assert mixing.mix(empty).count() == 0
    repeats = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in repeats} == {r.doc_id: r.copies for r in rows if r.copies}
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.taken) for r in mixing.mix(blank).collect()} == {(1, 0, 0), (2, 0, 0)}


def test_mix_takes_repeated_rows_one_by_one(spark):
    """A hundred rows of one id, and of a null id, come near their targets as single documents would."""
    for i in (5, None):
        rows = [(i, "a b c d e f g h i j", "x")] * 100 + [(100 + k, "a b c d e", "y") for k in range(200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        found = mixing.mix(docs).collect()
        taken = sum(r.taken for r in found if r.doc_id == i)
        assert len(found) == 300 and abs(taken - 2000 / 3) <= 10 and all(r.taken <= 3 * r.size for r in found)
        assert sorted(r.taken for r in found) == sorted(r.taken for r in mixing.mix(docs.repartition(7)).collect())
        kept = mixing.mixed(docs)
        assert kept.columns == docs.columns and kept.where("source = 'x'").count() * 10 == taken


def test_water_filling_clamps(spark):
    sizes = [("a", 1000), ("b", 1), ("c", 10), (None, 5)]
    got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert got["b"] == 3 and got["c"] == 30 and got[None] == 15 and math.isclose(got["a"], 1016 - 48)


def test_kneser_ney(docs, empty):
    train = {i: t for i, t in rows_of(docs).items() if zlib.crc32(str(i).encode()) % 10}
    tokens = {i: [*re.findall(SPACE, lower(t)), "</s>"] for i, t in rows_of(docs).items()}
    one, two = collections.Counter(), collections.Counter()
    for i in train:
        before = "<s>"
        for w in tokens[i]:
            one[w] += 1
            two[before, w] += 1
            before = w
    n, v = sum(one.values()), len(one)
    cont, context = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, b), c in two.items():
        cont[b] += 1
        context[a][0] += c
        context[a][min(c, 3)] += 1

    def discounts(counts):
        k = collections.Counter(counts)
        return [0.0, *lm._discounts([k[1], k[2], k[3], k[4]])]

    d1, d2 = discounts(cont.values()), discounts(two.values())
    rest = sum(d1[min(c, 3)] for c in cont.values()) / len(two)

    def p1(w):
        return max(cont[w] - d1[min(cont[w], 3)], 0) / len(two) + rest / (v + 1)

    def p2(a, w):
        if a not in context:
            return p1(w)
        x, c = context[a], two[a, w]
        return max(c - d2[min(c, 3)], 0) / x[0] + sum(d2[k] * x[k] for k in (1, 2, 3)) / x[0] * p1(w)

    model = lm.train(docs.where(lm.is_training(F.col("doc_id"))), shard_bytes=2000)
    assert model.train_tokens == n and model.types == v
    for r in lm.score(docs, model).collect():
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(w), sum(one[x] > 0 for x in w))
        assert math.isclose(r.base_score, sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *w], w, strict=False)), rel_tol=1e-9, abs_tol=1e-9)
    assert math.isclose(sum(p2("<s>", w) for w in one) + p2("<s>", "never seen"), 1.0)
    nothing = lm.train(empty)
    assert nothing.train_tokens == 0 and lm.score(docs, nothing).count() == docs.count() and lm.score(empty, model).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_of_any_order(docs, order):
    # a word so frequent that its n-grams are spread over the shards, and counts above a byte's
    often = [(10_001, " ".join(f"w{i * i % 97} the" for i in range(3000))), (10_002, "the the " * 700), (10_003, "w1 the w4 never the"), (10_012, "the w9 the w16")]
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(often, "doc_id long, text string"))
    tokens = {i: [*re.findall(SPACE, lower(t)), "</s>"] for i, t in rows_of(docs).items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    counts = {order: collections.Counter()}
    begun = collections.Counter()
    for i in train:
        padded = ["<s>", *tokens[i]]
        for end in range(2, len(padded) + 1):
            gram = tuple(padded[max(0, end - order) : end])
            (counts[order] if len(gram) == order else begun)[gram] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1]) + collections.Counter({g: c for g, c in begun.items() if len(g) == k})
    v = len({w for i in train for w in tokens[i]})
    discounts, context = {}, collections.defaultdict(lambda: [0, 0, 0, 0])
    for k, c in counts.items():
        of = collections.Counter(c.values())
        discounts[k] = [0.0, *lm._discounts([of[1], of[2], of[3], of[4]])]
        for g, n in c.items():
            context[g[:-1]][0] += n
            context[g[:-1]][min(n, 3)] += 1

    def p(g):
        lower_order = p(g[1:]) if len(g) > 1 else 1 / (v + 1)
        x, c, d = context.get(g[:-1]), counts[len(g)][g], discounts[len(g)]
        return lower_order if x is None else max(c - d[min(c, 3)], 0) / x[0] + sum(d[k] * x[k] for k in (1, 2, 3)) / x[0] * lower_order

    model = lm.train(docs.where(lm.is_training(F.col("doc_id"))), shard_bytes=2000, order=order)
    for r in lm.score(docs, model).collect():
        padded = ["<s>", *tokens[r.doc_id]]
        want = sum(math.log10(p(tuple(padded[max(0, end - order) : end]))) for end in range(2, len(padded) + 1))
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-9)
    words = {w for i in train for w in tokens[i]}
    for g in [("<s>",), *list(counts[order])[:3]]:
        c = g[-(order - 1) :]
        assert math.isclose(sum(p((*c, w)) for w in words) + p((*c, "never seen")), 1.0)


def test_arrays_of_the_model_return_what_was_saved(tmp_path):
    """Hashes in buckets, counts in two bits, and n-grams as places in a table of common words that lacks some of them."""
    import numpy as np

    rng = np.random.default_rng(7)
    for n in (0, 1, 15, 5000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        c = np.where(rng.random(len(h)) < 0.9, rng.integers(0, 4, len(h)), rng.integers(0, 2**40, len(h)))
        shared.save_together(str(tmp_path), f"x{n}", lm._kept_hashes("x", h) | lm._kept_counts("x", count=c))
        saved = shared.map_together(str(tmp_path), f"x{n}")
        at, there = lm._hashes_at(saved, "x", h)
        assert there.all() and (at == np.arange(len(h))).all()
        assert (lm._counts_at(saved, "x.count", at) == c).all()
        assert not lm._hashes_at(saved, "x", h ^ np.uint64(1 << 40))[1].any()
        words = np.unique(np.append(h, np.array([0, lm.BEGIN], np.uint64)))
        for common in (h[::3], h[:0], h):
            assert (lm._words_named(lm._named(words, common), common) == words).all()
    for size, dtype in ((1 << 16, np.uint16), (1 << 20, np.uint32)):
        grams = rng.integers(0, size, (3, 1000)).astype(dtype)
        assert (lm._placed(lm._places(grams), 3, dtype) == grams).all()


def test_kneser_ney_with_words_outside_the_table(docs, monkeypatch):
    want = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs, order=3)).collect()}
    monkeypatch.setattr(lm, "COMMON", 20)
    assert {r.doc_id: r.score for r in lm.score(docs, lm.train(docs, order=3)).collect()} == pytest.approx(want, rel=1e-9)


def test_kneser_ney_query_is_a_trigram_model(spark, docs, tmp_path):
    from ionweave.llm import queries

    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    model = lm.train(docs.where(lm.is_training(F.col("doc_id"))), order=3)
    want = {r.doc_id: r.score for r in lm.score(docs, model).collect()}
    assert {r.doc_id: r.score for r in queries.op3_kneser_ney(spark, str(tmp_path)).collect()} == pytest.approx(want, rel=1e-9)
    # two files a shard, and one of its counted words
    arrays = [f.name for f in pathlib.Path(model.folder.removeprefix("file:")).iterdir() if f.is_file()]
    assert {re.sub("[0-9]", "", f) for f in arrays} == {"n", "u", "w", "common.hash", "hot.hash"} and len(arrays) <= 3 * (1 << model.bits) + 2


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenfiles.tokenizer_path(tokenfiles.TOKENIZER))
    rng = random.Random(4)
    parts = ["a", "Be", " ", "  ", "\n", "\n\n", "\t", "'s", "9", ".", "é", "\u00a0", "\u3000", "\u2028", "日本", "<|endoftext|>", "\r\n", "\x1c", "😀", "\0", "ue"]
    odd = spark.createDataFrame([(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)], "doc_id long, text string")
    mixed = docs.select("doc_id", "text").unionByName(odd)
    want, start = {}, 0
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.tokenized(mixed).collect()} == want
    assert tokenfiles.tokenized(empty).count() == 0


def test_token_files_have_indexes(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    folder = str(tmp_path / "tokens")
    tokenfiles.write_tokens(docs, folder)
    meta = [pq.ParquetFile(p).metadata for p in (tmp_path / "tokens").glob("part-*.parquet")]
    ids = [m.row_group(0).column(m.num_columns - 1) for m in meta if m.num_row_groups]
    assert ids and all(c.has_dictionary_page and c.has_offset_index and c.has_column_index for c in ids)


def test_base_spans():
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def good(k, text):
        d = re.sub("[^0-9]", "", text)
        luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
        return [True, all(int(x or 0) <= 255 for x in re.split(r"\.", text)) if k == 1 else True, 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15][k]

    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("aB1234567890.@@-+ () é%_\n") for _ in range(rng.randint(0, 50)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if good(k, m.group()))
        assert personal.base_spans(text) == want


def test_skip_edges_carry_labels(spark):
    rows = [(1, "write to ann.lee@mail.example.com or +1 (383) 555-6083 today, 383-555-6083 at night, or ann.lee@mail; page 7"), (2, "version 4.0 of 2024, section 12"), (3, None), (4, ""), (5, "1" * 40_000 + "@" * 5000)]
    rows += [(10 + k, f"call +1 (383) 555-{1000 + k} or mail u{k}@x{k}.example.org from 10.0.0.{k}, page {k} of 9" + f", call +1 (383) 555-{1000 + k} or mail u{k}@x{k}.example.org" * (k % 2)) for k in range(100)]
    # sixteen digits, of which the shape doesn't say whether they are a card number, twice in a text
    numbers = [str(random.Random(k).randrange(10**15, 10**16)) for k in range(400)]
    rows += [(400 + k, f"first {x} and again {x} there") for k, x in enumerate(numbers)]
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows += [(200 + k, f'chapter {k}, version 2.{k} with token = "{key[k:]}{key[:k]}" inside, the year 20{10 + k}') for k in range(30)]
    rows += [(300, f'token = "{key}" and later {key[:30].upper()}, then {key} once more')]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = personal.learn(docs)
    assert field.skip > 0.5
    found = {r.doc_id: r for r in personal.find(docs, field).collect()}
    texts = dict(rows)
    assert [(s.kind, texts[1][s.start : s.end]) for s in found[1].added] == [("phone", "383-555-6083"), ("email", "ann.lee@mail")]
    assert [(s.kind, texts[205][s.start : s.end]) for s in found[205].added] == [("secret", f"{key[5:]}{key[:5]}")]
    assert sum(s.kind == "secret" for s in found[300].added) >= 2
    assert not found[2].base and not found[2].added and not found[3].base and not found[4].base and not found[5].added
    assert [s.kind for s in found[10].base] == ["phone", "email", "ip"] and all(not found[10 + k].added for k in range(100))
    assert personal.find(docs.where("false"), personal.learn(docs.where("false"))).count() == 0


def planted_repeats():
    """Texts with a span of a base kind and, far behind, its repeat in a form that no base pattern has; others with look-alikes alone."""
    rng = random.Random(17)
    digits = lambda n: str(rng.randint(10 ** (n - 1), 10**n - 1))
    name = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    far = "and then nothing of note came to pass " * 12
    rows, planted = [], {}
    for i in range(400):
        one, person = digits(11), f"{name()}.{name()}"
        phone, mail = f"+{one}", f"{person}@{name()}.example.org"
        number, place = (lambda: f"order {digits(11)}"), (lambda: f"ask {name()}@{name()}")
        if i % 4 == 0:
            text = f"call {phone} or {number()} {far} or {phone} or {place()} {far} {mail} or {number()} {far} that is {mail} or {place()}"
        elif i % 4 == 1:
            text = f"{number()} from {name()}@{name()} {far} of {digits(11)} pieces in box {digits(4)} {far} {place()}"
        elif i % 4 == 2:
            text = f"call {phone} or {number()} {far} {phone} or {number()} {far} {one} or {number()}"
            planted[i] = [("phone", text.rindex(one), text.rindex(one) + 11)]
        else:
            last = f"{person}@{name()}"
            text = f"write to {mail} or {place()} {far} {mail} or {place()} {far} once {last} or {place()}"
            planted[i] = [("email", text.rindex(last), text.rindex(last) + len(last))]
        rows.append((i, text, "en", "web", len(text)))
    return rows, planted


def test_skip_edges_decide_planted_repeats(spark):
    rows, planted = planted_repeats()
    docs = spark.createDataFrame(rows, SCHEMA)
    field = personal.learn(docs)

    def added(f):
        return {(r.doc_id, *s) for r in personal.find(docs, f).collect() for s in r.added}

    want = {(i, *s) for i, spans in planted.items() for s in spans}
    with_skips, without = added(field), added(personal.Field(field.shape, field.chain, 0.0))
    print(field.skip, len(want), len(with_skips & want), len(with_skips - want), len(without & want), len(without - want))
    assert len(with_skips & want) >= 0.95 * len(want) and len(with_skips - want) <= 0.02 * len(want)
    assert len(without & want) <= 0.05 * len(want)


def test_lessons_are_bounded(spark):
    docs = spark.createDataFrame(planted_repeats()[0], SCHEMA)
    few = personal.learn(docs, lessons=3)
    assert few.shape.shape == (sum(personal.BUCKETS) + 1, len(personal.LABELS)) and personal.find(docs, few).count() == 400
    assert personal._taught("key=" + "ab12" * 500, 4, 2004, 0) == personal.LABELS.index("secret")


def test_beliefs_equal_enumeration():
    """Message passing is exact where edges make a tree: against the sum over all labellings."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    k, n = len(personal.LABELS), 4
    field = personal.Field(rng.normal(size=(sum(personal.BUCKETS) + 1, k)), rng.normal(size=(k, k)), 1.3)
    rows = np.stack([rng.integers(0, b, n) for b in personal.BUCKETS], axis=1)
    observed, chain, skip = np.array([0, 2, 0, 0]), np.array([(0, 1), (1, 2)]), np.array([(0, 3)])
    unary, want = personal._one_hot(rows) @ field.shape, np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        if y[1] == 2:
            z = sum(unary[i, y[i]] for i in (0, 2, 3)) + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip * (y[a] == y[b]) for a, b in skip)
            for i in range(n):
                want[i, y[i]] += np.exp(z)
    assert np.allclose(field.beliefs(rows, observed, chain, skip), want / want.sum(1)[:, None], atol=1e-3)


def test_unbroken_letters_take_linear_time():
    import time

    began = time.time()
    assert personal.candidates("x" * 1_000_000 + " 7", []) == ([(1_000_001, 1_000_002)], [0])
    assert len(personal.candidates("é" * 500_000 + "7" + "字" * 500_000, [])[0]) == 1
    assert time.time() - began < 1


def test_quality(spark, empty):
    rng = random.Random(8)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(800):
        good = rng.random() < 0.7
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        rows.append((i, (" ".join(body) + ".") if good else "!! ".join(w.upper() for w in body), "s"))
        labels.append((i, int(good) if i % 5 else None, 0))
    rows += [(900, None, "s"), (901, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.values())
    held = [(r.predicted, q) for i, q, _ in labels.collect() if q is not None and (r := out[i]).held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.98
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}
    assert all(r.score == 0.5 for r in quality.scored(docs, labels.where("false")).collect())
    assert quality.scored(empty, labels).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def connected(pairs, n):
    """The smallest number that each of n is linked with."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize(("edits", "hot"), [(((1, 2),), 2), (((9, 2), (4, 1)), 100)])
def test_edit_links(spark, edits, hot):
    """Also where any segment that two or three lines share counts as hot, so that what is left is cut again and again."""
    rng = random.Random(9)
    lines = {"".join(rng.choice("abé ") for _ in range(rng.randint(4, 12))) for _ in range(20)}
    for b in list(lines):
        for _ in range(5):
            s = list(b)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(s))
                s[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
            lines.add("".join(s))
    lines = sorted(x for x in lines if len(x) > 2)
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {tuple(sorted((r.a, r.b))) for r in linededup.edit_links(df, edits, hot).collect()}
    allowed = lambda a, b: max([k for least, k in edits if min(len(a), len(b)) >= least], default=-1)
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= allowed(lines[i], lines[j])}
    if hot > 50:
        assert got == want
    assert got <= want and connected(got, len(lines)) == connected(want, len(lines))


def test_a_shared_segment_emits_no_pairs(spark):
    """Log lines with one prefix: candidates stay near their number, and none of the planted edits is lost."""
    rng = random.Random(11)
    tails = ["".join(rng.choice(string.ascii_lowercase) for _ in range(20)) for _ in range(5000)]
    lines = [f"2024-02-29 12:00:00 server request from {t}" for t in tails]
    planted = {(k, 5000 + k) for k in range(200)}
    lines += [lines[k][:-3] + "#" + lines[k][-2:] for k in range(200)]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    named = df.select("id", *[c.alias(f"key{s}") for s, c in enumerate(linededup.line_keys(F.col("line"), linededup.EDITS))])
    folder = linededup.shared_dir(spark, "test")
    pairs = linededup.candidates(named, lambda ids: df.join(ids, "id", "left_semi"), linededup.EDITS, folder)
    assert pairs.count() < 40 * len(lines)
    assert planted <= {(r.a, r.b) for r in linededup.edit_links(df).collect()}


def line_classes(rows, edits):
    """dropped line numbers by document, by comparing all distinct lines."""
    places = collections.defaultdict(list)
    for i, text in rows:
        for number, line in enumerate(text.split("\n") if text is not None and i is not None else ()):
            line = re.sub(r"[^\S ]\s*| \s+", " ", line.lower()).strip(" ")
            if line:
                places[line].append((i, number))
    lines = sorted(places)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(lines):
        for b in range(a):
            y = lines[b]
            k = max([k for least, k in edits if min(len(x), len(y)) >= least], default=0)
            if k and abs(len(x) - len(y)) <= k and distance(x, y) <= k:
                root[find(a)] = find(b)
    kept, dropped = {}, collections.defaultdict(set)
    for a, x in enumerate(lines):
        kept[find(a)] = min(kept.get(find(a), min(places[x])), *places[x], min(places[x]))
    for a, x in enumerate(lines):
        for i, number in places[x]:
            if (i, number) != kept[find(a)]:
                dropped[i].add(number)
    return {i: sorted(dropped[i]) for i, _ in rows}


@pytest.mark.parametrize(("kind", "hot"), [("long", 100), ("string", 3)])
def test_duplicate_lines_by_brute_force(spark, kind, hot):
    """Ids far above 2^40 or texts, with repeated, edited, short, blank and template lines."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9))) for _ in range(60)] + [f"row {k:04d} of the same old template" for k in range(0, 400, 37)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice("abcde ")
            own.append("".join(line).upper() if rng.random() < 0.2 else "".join(line))
        rows.append((5 + i * (1 << 41), "\n".join(own) + rng.choice(["", "\n", "\n\t \n"])))
    rows = [(i if kind == "long" else f"d{i:020d}", t) for i, t in rows]
    want = line_classes(rows, linededup.EDITS)
    got = {r.doc_id: r.dropped for r in linededup.duplicate_lines(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3), hot=hot).collect()}
    assert got == want


def test_duplicate_lines(spark):
    long = "the quick brown fox jumps over the lazy dog"
    rows = [(1, f"{long}\n\nshort\n{long.upper()}"), (2, f"x\n{long[:-1]}t\nshort\n\n"), (3, None), (4, ""), (5, f"{long} and quite another end"), (None, long), (6, f"  {long}!?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash"))
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.dropped) for r in linededup.duplicate_lines(docs).collect()}
    assert got == {1: (4, 1, 0, [3]), 2: (5, 1, 1, [1, 2]), 3: (0, 0, 0, []), 4: (1, 0, 0, []), 5: (1, 0, 0, []), None: (1, 0, 0, []), 6: (1, 0, 1, [0])}
    kept = {r.doc_id: r.text for r in linededup.without_duplicates(docs).collect()}
    assert kept[1] == f"{long}\n\nshort" and kept[2] == "x\n\n" and kept[3] is None and kept[6] == ""
    assert linededup.duplicate_lines(docs.where("false")).count() == 0


def test_walks_equal_power_iteration(spark):
    """Trust along the edges and distrust against them, with circles, a chain far longer than ten links, and hosts without edges."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = 60
    weights = np.zeros((n, n))
    for a, b in rng.integers(0, 40, (90, 2)):
        if a != b:
            weights[a, b] += rng.integers(1, 5)
    for k in range(40, 58):
        weights[k, k + 1] = 1
    weights[39, 40] = 1
    seeds = np.zeros((n, 2))
    seeds[[1, 39, 59], 0], seeds[[2, 58], 1] = [0.5, 0.25, 0.25], 0.5
    want = []
    for kind, w in enumerate((weights, weights.T)):
        sums = w.sum(1, keepdims=True)
        shares = np.divide(w, sums, out=np.zeros_like(w), where=sums > 0)
        want.append(np.linalg.solve(np.eye(n) - 0.85 * shares.T, 0.15 * seeds[:, kind]))
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", float(weights[a, b])) for a, b in zip(*np.nonzero(weights), strict=True)], "src string, dst string, weight double")
    given = spark.createDataFrame([(f"h{k}", float(t), float(d)) for k, (t, d) in enumerate(seeds) if t or d], "host string, trust double, distrust double")
    found = {r.host: (r.trust, r.distrust) for r in urlfilter.propagate(edges, given, 60, tolerance=2e-4).collect()}
    for k in range(n):
        assert np.allclose(found.get(f"h{k}", (0, 0)), [want[0][k], want[1][k]], atol=2e-3)
    # the chain's far end is reached
    assert found["h57"][0] > 0 and found["h41"][1] > 0
    with pytest.raises(ValueError, match="still change"):
        urlfilter.propagate(edges, given, rounds=3)


def test_urls(spark):
    pages = [
        (1, "http://A.net/x?q", "<a href='http://spam.com/'>"), (2, "https://example.net/en/1", '<a href="//good.com/a">'), (3, "https://m.example.net/en/1#t", None),
        (4, "http://example.com/de/", ""), (5, "http://spam.com", ""), (6, "http://good.com/fr", ""), (7, "http://b.org/fr/a", ""), (8, None, None), (9, "no url", ""),
        (10, "http://links-to-a.com/", '<a href="http://a.net/">'), (11, "http://net", ""), (12, "x://h.org/fr/y://z", ""),
    ]
    out = {r.page_id: r for r in urlfilter.judged(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    assert [out[k].rule for k in range(1, 13)] == ["net/", "example.net/en/", "example.net/en/", "example.com/de/", None, None, "org/fr/", None, None, None, None, "org/fr/"]
    assert (out[1].host, out[1].path, out[8].host, out[9].path, out[11].path, out[12].path) == ("a.net", "/x", "", "", "", "/fr/y://z")
    assert [out[k].verdict for k in range(1, 8)] == ["block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert out[6].trust > 0 and out[10].verdict == "block" and out[8].verdict == "allow"
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
