"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Distinct lines are cut into threshold + 1 segments, at least one of which
survives in any line within the edit threshold.  Segments are indexed with their
length and place; a line probes the index of each allowed shorter length with the
few substrings that can match there (the multi-match-aware selection).
Candidates pass a parity sketch of their characters, and are then verified by a
banded bit-parallel edit distance.

A segment that many distinct lines share (a log prefix, a template) is never
paired out: the edits are dealt to the pieces before and after it, a piece
without any must be equal, and the longer piece is cut into segments in turn,
until few lines share all that was found equal on the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import shared_dir, written

#: (least length, edits): pairs whose shorter normalised line has this length, or more, may differ by so many edits.
#: Shorter lines than the least are told apart exactly, as one edit is an eighth of them or more.
EDITS = ((24, 2), (8, 1))
#: Distinct lines with one segment, beyond which their pieces are cut in turn.
HOT = 64
#: As many, beyond which pairs are joined with their sketches at hand, which takes the lines' texts.
WARM = 16
#: Bits, at most, of the bitmap that lets through the lines whose texts are asked for.
PLACES = 1 << 24

Edits = tuple[tuple[int, int], ...]


def normalised(text: Column) -> Column:
    """Lower case, and single spaces inside the lines; spaces around a line are left for trim."""
    # the pattern is slow, so it is kept for texts that hold such a place; a single space is left alone
    odd = F.contains(text, F.lit("  "))
    for space in "\t\v\f\r":
        odd = odd | F.contains(text, F.lit(space))
    return F.when(odd, F.regexp_replace(F.lower(text), r"[^\S \n][^\S\n]*| [^\S\n]+", " ")).otherwise(F.lower(text))


def _edits(length: Column, edits: Edits) -> Column:
    """Edits allowed for a pair whose shorter line has this length."""
    out = F.lit(0)
    for least, k in sorted(edits):
        out = F.when(length >= least, F.lit(k)).otherwise(out)
    return out


def _ways(b: int, d: int) -> list[tuple[int, int, int, int]]:
    """(b, d, j, off): the ways in which a text probes for one that is d shorter and b edits away at most.

    The indexed text is cut into b + 1 segments.  For one of them, j, the parts
    before hold j edits at most and the parts after b - j; so it lies off its
    place by no more than either allows.
    """
    return [(b, d, j, off) for j in range(b + 1) for off in range(max(-j, d - (b - j)), min(j, d + (b - j)) + 1)]


def _of(ways: list[tuple[int, int, int, int]], place: int, way: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w[place]) for w in ways]), way + 1)


def _is_index(ways: list[tuple[int, int, int, int]], way: Column) -> Column:
    return way.isin([k for k, (_, d, _, off) in enumerate(ways) if not d and not off])


def _key(text: Column, b: int, d: int, j: int, off: int, *parts: Column) -> Column:
    other = F.length(text) - d
    start, size = _segment(other, F.lit(j), b + 1)
    return F.xxhash64(*parts, F.lit(4 * b + j), other, F.substr(text, start + off, size))


def line_ways(edits: Edits) -> list[tuple[int, int, int, int]]:
    """The ways of whole lines, in the order of line_keys: a line probes for lines up to its edits shorter."""
    if any(not 1 <= k <= 2 for _, k in edits):
        raise ValueError("one or two edits are allowed for")
    return [w for _, k in sorted(edits, reverse=True) for d in range(k + 1) for w in _ways(k, d)]


def _wide(line: Column) -> Column:
    """The line at four bytes a character, which is cut anywhere without a walk over what lies before."""
    return F.encode(line, "UTF-32")


def _places(length: Column, edits: Edits) -> dict[tuple[int, int, int], Column]:
    """Where segment i > 0 of a line d shorter with k edits starts (from 0), by (k, d, i); later segments are the longer ones."""
    return {(k, d, i): F.floor((length - d) * i / (k + 1)).cast("int") for _, k in edits for d in range(k + 1) for i in range(1, k + 1)}


def _keys(wide: Column, length: Column, places: dict[tuple[int, int, int], Column], edits: Edits) -> list[Column]:
    out, longest = [], 1 << 30
    for least, k in sorted(edits, reverse=True):
        for d in range(k + 1):
            other = length - d
            ends = [F.lit(0), *[places[k, d, i] for i in range(1, k + 1)], other]
            for b, _, j, off in _ways(k, d):
                segment = F.substr(wide, (ends[j] + off) * 4 + 1, (ends[j + 1] - ends[j]) * 4)
                out.append(F.when(other.between(least, longest), F.xxhash64(F.lit(4 * b + j), other, segment)))
        longest = least - 1
    return out


def line_keys(line: Column, edits: Edits) -> list[Column]:
    """A line's key for each way; null where the line that it probes for has other edits by its length."""
    return _keys(_wide(line), F.length(line), _places(F.length(line), edits), edits)


def _keyed(rows: DataFrame, edits: Edits) -> DataFrame:
    """rows with their line replaced by its line_keys, as key0, key1, ...

    The length and the segments' places are columns first, so they are found once for all
    keys, and the code of a key stays short enough for the JVM to compile.
    """
    others = [c for c in rows.columns if c != "line"]
    rows = rows.select(*others, _wide(F.col("line")).alias("_wide"), F.length("line").alias("_n"))
    places = _places(F.col("_n"), edits)
    rows = rows.select("*", *[c.alias("_p{}_{}_{}".format(*at)) for at, c in places.items()])
    keys = _keys(F.col("_wide"), F.col("_n"), {at: F.col("_p{}_{}_{}".format(*at)) for at in places}, edits)
    return rows.select(*others, *[c.alias(f"key{s}") for s, c in enumerate(keys)])


#: The ways of the pieces of a line.
PIECE_WAYS = [w for b in (1, 2) for d in range(-b, b + 1) for w in _ways(b, d)]


def _cut(rows: DataFrame, ways: list[tuple[int, int, int, int]]) -> DataFrame:
    """rows (id, parities, key, own, way, p, q and qb, qd) with p cut as the way says, as (id, parities, key, own, p, pb, pd, q, qb, qd).

    The parts before and after the segment are pieces with edits of their own;
    one that has none left must be equal, so it becomes part of the key.  p is
    the piece that is cut next, the longer one.
    """
    way = F.col("way")
    b, d, j, off = (_of(ways, k, way) for k in range(4))
    start, size = _segment(F.length("p") - d, j, b + 1)
    start = start + off
    rows = rows.withColumns({"_l": F.substr(F.col("p"), F.lit(1), start - 1), "_r": F.substr(F.col("p"), start + size), "_lb": j, "_rb": b - j, "_ld": off, "_rd": d - off})
    key = F.xxhash64("key", F.when(F.col("_lb") == 0, F.col("_l")), F.when(F.col("_rb") == 0, F.col("_r")))
    piece = lambda side: F.struct(F.col(f"_{side}").alias("t"), F.col(f"_{side}b").alias("b"), F.col(f"_{side}d").alias("d"))
    old = F.when(F.col("q").isNotNull(), F.struct(F.col("q").alias("t"), F.col("qb").alias("b"), F.col("qd").alias("d")))
    both = (F.col("_lb") > 0) & (F.col("_rb") > 0)
    rows = rows.select("id", "parities", key.alias("key"), "own", F.when(F.col("_lb") > 0, piece("l")).otherwise(piece("r")).alias("x"), F.when(both, piece("r")).otherwise(old).alias("y"))
    longer = F.col("y").isNotNull() & (F.length("y.t") - F.col("y.d") > F.length("x.t") - F.col("x.d"))
    rows = rows.select("id", "parities", "key", "own", F.when(longer, F.col("y")).otherwise(F.col("x")).alias("p"), F.when(longer, F.col("x")).otherwise(F.col("y")).alias("q"))
    return rows.select("id", "parities", "key", "own", F.col("p.t").alias("p"), F.col("p.b").alias("pb"), F.col("p.d").alias("pd"), F.col("q.t").alias("q"), F.col("q.b").alias("qb"), F.col("q.d").alias("qd"))


def _segment(length: Column, i: Column, k: Column | int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of k (from 0) of a line; later segments are the longer ones."""
    base, longer = F.floor(length / k).cast("int"), (length % k).cast("int")
    # segments before i that are one longer
    extra = F.greatest(longer - (F.lit(k) - i), F.lit(0))
    return (F.lit(1) + i * base + extra).cast("int"), base + F.when(i >= F.lit(k) - longer, 1).otherwise(0)


def parities(line: Column) -> Column:
    """Parity of the number of characters in each of 64 classes: an edit changes two of them at most."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c).bitwiseAND(F.lit(63))))))


def _common(a: Column, b: Column, most: Column) -> Column:
    """Length of the longest common prefix of two lines, ``most`` at most: its binary digits, the largest first."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int")), lambda j: F.call_function("shiftleft", F.lit(1), j))

    def step(p: Column, n: Column) -> Column:
        return F.when((p + n <= most) & (F.substr(a, p + 1, n) == F.substr(b, p + 1, n)), p + n).otherwise(p)

    return F.aggregate(F.reverse(steps), F.lit(0), step)


def trimmed(pairs: DataFrame) -> DataFrame:
    """Pairs with lines x and y, without what they begin and then end with alike, which leaves their edit distance as it is."""
    x, y = F.col("x"), F.col("y")
    head = _common(x, y, F.least(F.length(x), F.length(y)))
    pairs = pairs.withColumn("_n", head).withColumns({"x": F.substr(x, F.col("_n") + 1), "y": F.substr(y, F.col("_n") + 1)})
    tail = _common(F.reverse(x), F.reverse(y), F.least(F.length(x), F.length(y)))
    pairs = pairs.withColumn("_n", tail)
    return pairs.withColumns({"x": F.substr(x, F.lit(1), F.length(x) - F.col("_n")), "y": F.substr(y, F.lit(1), F.length(y) - F.col("_n"))}).drop("_n")


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two lines' edit distance is at most the threshold, by banded bit-parallel edit distance.

    State d (edits so far, at most) is a word of 2 * threshold + 1 bits, one for each
    diagonal of the band, that is set where a prefix of b on this diagonal can
    be reached with d edits.  Each character of a shifts all diagonals at once;
    bit t of ``same`` says whether it equals b's character on diagonal t.
    """
    k, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1

    def shift(state: Column, n: int) -> Column:
        return (F.shiftleft(state, n) if n > 0 else F.shiftrightunsigned(state, -n)).bitwiseAND(F.lit(full))

    def closed(states: list[Column]) -> list[Column]:
        """With what fewer edits and insertions (the next diagonal, one edit more) reach."""
        out = [states[0]]
        for s in states[1:]:
            out.append(s.bitwiseOR(out[-1]).bitwiseOR(shift(out[-1], 1)))
        return out

    # each character of a beside those of b within the band, as arrays that a step needn't look up
    x, y = F.split(a, ""), F.split(b, "")
    beside = [F.concat(F.array_repeat(F.lit(None).cast("string"), k - t), y) if t < k else F.slice(y, t - k + 1, F.length(b) + 1) for t in range(width)]
    zipped = F.slice(F.arrays_zip(x.alias("x"), *[c.alias(f"y{t}") for t, c in enumerate(beside)]), F.lit(1), F.length(a))

    def step(s: Column, c: Column) -> Column:
        bits = [F.when(c[f"y{t}"] == c["x"], F.lit(1 << t)).otherwise(F.lit(0)) for t in range(width)]
        same = bits[0]
        for bit in bits[1:]:
            same = same.bitwiseOR(bit)
        new = []
        for d in range(k + 1):
            here = s[f"s{d}"].bitwiseAND(same)
            if d:
                # a substituted character stays on the diagonal, a deleted one moves to the one before
                here = here.bitwiseOR(s[f"s{d - 1}"]).bitwiseOR(shift(s[f"s{d - 1}"], -1))
            new.append(here)
        return F.struct(*[c.alias(f"s{d}") for d, c in enumerate(closed(new))])

    start = closed([F.lit(1 << k) if d == 0 else F.lit(0) for d in range(k + 1)])
    zero = F.struct(*[c.alias(f"s{d}") for d, c in enumerate(start)])
    end = F.aggregate(zipped, zero, step)
    # b's end lies on this diagonal
    last = F.length(b) - F.length(a) + F.lit(k)
    reached = F.call_function("shiftright", end[f"s{k}"], F.greatest(last, F.lit(0))).bitwiseAND(F.lit(1)) == 1
    return F.when(F.abs(F.length(a) - F.length(b)) > k, F.lit(False)).otherwise(reached)


def _met(posts: DataFrame, edits: Edits, sketched: bool = True) -> DataFrame:
    """Pairs (a, b), a < b, of an indexed line of posts (key, id, own, parities) and one that probes for it."""
    posts = posts if sketched else posts.withColumn("parities", F.lit(0).cast("long"))
    left = posts.where("own").select("key", F.col("id").alias("a"), F.col("parities").alias("s"))
    right = posts.select("key", F.col("id").alias("b"), F.col("own").alias("both"), F.col("parities").alias("t"))
    met = left.join(right, "key").where(f"(a < b or (a > b and not both)) and bit_count(s ^ t) <= {2 * max(k for _, k in edits)}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def candidates(named: DataFrame, text_of: Callable[[DataFrame], DataFrame], edits: Edits, folder: str, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, that join all lines of named (id, key0, key1, ...) within the edit threshold as all such pairs would.

    ``text_of(ids)`` gives (id, line) of a frame of ids; it is asked for the
    lines of segments that more than ``hot`` distinct lines share.
    """
    ways = line_ways(edits)
    keys = [f"key{s}" for s in range(len(ways))]
    posts = named.select("id", F.posexplode(F.array(*keys)).alias("way", "key")).where("key is not null").withColumn("own", _is_index(ways, F.col("way")))
    own = named.select("id", F.explode(F.array(*[k for k, (_, d, _, off) in zip(keys, ways, strict=True) if not d and not off])).alias("key")).where("key is not null")
    warm = min(WARM, hot)
    many = written(own.groupBy("key").count().where(F.col("count") > warm), f"{folder}/hot")
    if many.isEmpty():
        return written(_met(posts, edits, False).distinct(), f"{folder}/pairs")
    found = [written(_met(posts.join(many, "key", "left_anti"), edits, False).distinct(), f"{folder}/met")]
    members = written(posts.join(many, "key").select("id", "key", "way", "own", (F.col("count") > hot).alias("cut")), f"{folder}/members")
    texts = text_of(members.select("id").distinct()).select("id", F.col("line").alias("p"), parities(F.col("line")).alias("parities"))
    texts = written(texts, f"{folder}/hot-texts", compression="zstd")
    found.append(written(_met(members.where("not cut").join(texts.drop("p"), "id"), edits).distinct(), f"{folder}/warm"))
    members = members.where("cut").join(texts, "id")
    members = members.withColumns({"q": F.lit(None).cast("string"), "qb": F.lit(None).cast("int"), "qd": F.lit(None).cast("int")})
    members, level = written(_cut(members, ways), f"{folder}/cut0", compression="zstd"), 0
    while True:
        many = written(members.where("own").groupBy("key").count().where(F.col("count") > hot).select("key"), f"{folder}/hot{level}")
        found.append(written(_met(members.join(many, "key", "left_anti"), edits).distinct(), f"{folder}/met{level}"))
        if many.isEmpty():
            break
        members = members.join(many, "key")
        # no more is left of these lines than the edits: those with the same cuts are linked, so the first stands for all
        short = F.length("p") - F.col("pd") <= F.col("pb")
        last = members.where(short)
        first = last.where("own").groupBy("key").agg(F.min("id").alias("a"))
        star = last.where("own").join(first, "key").where("a <> id").select("a", F.col("id").alias("b"))
        odd = last.where("own").select("key", F.col("id").alias("a")).join(last.where("not own").select("key", F.col("id").alias("b")), "key").where("a <> b")
        found.append(written(star.unionByName(odd.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), f"{folder}/short{level}"))
        inner = [F.struct(F.lit(n).alias("way"), F.when((F.col("pb") == w[0]) & (F.col("pd") == w[1]), _key(F.col("p"), *w, F.col("key"))).alias("key")) for n, w in enumerate(PIECE_WAYS)]
        own_ways = F.explode(F.filter(F.array(*inner), lambda x: x["key"].isNotNull())).alias("x")
        inner = members.where(~short).select("id", "parities", "own", "p", "q", "qb", "qd", own_ways).select("id", "parities", "own", "p", "q", "qb", "qd", "x.way", "x.key")
        level += 1
        members = written(_cut(inner.withColumn("own", F.col("own") & _is_index(PIECE_WAYS, F.col("way"))), PIECE_WAYS), f"{folder}/cut{level}", compression="zstd")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return written(pairs.distinct(), f"{folder}/pairs")


def verified(pairs: DataFrame, texts: DataFrame, edits: Edits, folder: str) -> DataFrame:
    """The pairs (a, b) whose texts (id, line, parities) are within the edit threshold."""
    first = texts.select(F.col("id").alias("a"), F.col("line").alias("x"), F.col("parities").alias("p"))
    both = pairs.join(first, "a").join(first.select(F.col("a").alias("b"), F.col("x").alias("y"), F.col("p").alias("q")), "b")
    both = both.withColumn("k", _edits(F.least(F.length("x"), F.length("y")), edits))
    near = both.where("abs(length(x) - length(y)) <= k and bit_count(p ^ q) <= 2 * k").select("a", "b", "x", "y", "k")
    # each step is written, or its expressions would be evaluated for all pairs, and over and over within the next step's
    near = written(near, f"{folder}/near", compression="zstd")
    near = written(trimmed(near.repartition(F.xxhash64("a", "b"))), f"{folder}/trimmed", compression="zstd")
    fits = F.lit(False)
    for k in sorted({k for _, k in edits}):
        fits = F.when(F.col("k") == k, within(F.col("x"), F.col("y"), k)).otherwise(fits)
    return written(near.where(fits).select("a", "b"), f"{folder}/links")


def _links(named: DataFrame, text_of: Callable[[DataFrame], DataFrame], edits: Edits, folder: str, hot: int) -> DataFrame:
    pairs = candidates(named, text_of, edits, folder, hot)
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{folder}/ends")
    texts = written(text_of(ends).withColumn("parities", parities(F.col("line"))), f"{folder}/texts", compression="zstd")
    return verified(pairs, texts, edits, folder)


def edit_links(lines: DataFrame, edits: Edits = EDITS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of ids of distinct lines (id, line), id a long, within the edit threshold, each once."""
    folder = shared_dir(lines.sparkSession, "edits")
    named = _keyed(lines.select("id", "line"), edits)
    return _links(named, lambda ids: lines.join(ids, "id", "left_semi").select("id", "line"), edits, folder, hot)


def duplicate_lines(docs: DataFrame, edits: Edits = EDITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near and dropped (numbers of the lines that go, from 0) of each document.

    Lines are told apart by two 64-bit hashes of their normal form; an empty one
    always stays.  Equal lines, and lines linked by the edit threshold (also
    through others), are one class, of which the occurrence with the smallest
    doc_id (of any type) and number stays; n_exact counts dropped ones equal to a
    line that occurred before, n_near the others.  Null text has no lines; rows
    that repeat an id count as one document; a null id keeps its lines; an empty
    table gives an empty result; other columns, whatever their names, are not
    read.  A line may be of any length: memory follows the longest one.
    """
    base = shared_dir(docs.sparkSession, "lines")
    rows = _rows(docs, base)
    gone = _gone(rows, edits, hot, base)
    gone = gone.groupBy("doc_id").agg(
        F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"), F.array_sort(F.collect_set("number")).alias("dropped")
    )
    lines = rows.where("n_lines is not null").groupBy("doc_id").agg(F.sum("n_lines").alias("n_lines"))
    out = lines.join(gone, "doc_id", "left")
    return out.select("doc_id", "n_lines", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_exact", "n_near")], F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def _rows(docs: DataFrame, base: str) -> DataFrame:
    """(doc_id, number, n_lines, h, g, line): two hashes and the normal form of each line that isn't empty.

    The first row of a document has its number of lines; where its first line is
    empty, or its id or text null, that row has no hashes.
    """
    parts = docs.select("doc_id", F.split(normalised(F.col("text")), "\n").alias("parts")).select("doc_id", F.coalesce(F.size("parts"), F.lit(0)).alias("size"), "parts")
    # the outer form gives null text a row, and isn't preceded by a filter that splits all texts once more
    rows = parts.select("doc_id", "size", F.posexplode_outer("parts").alias("number", "line")).withColumns({"line": F.trim("line"), "number": F.coalesce("number", F.lit(0))})
    rows = rows.withColumn("line", F.when((F.col("line") != "") & F.col("doc_id").isNotNull(), F.col("line"))).where("line is not null or number = 0")
    hashed = lambda *c: F.when(F.col("line").isNotNull(), F.xxhash64(*c))
    rows = rows.select("doc_id", "number", F.when(F.col("number") == 0, F.col("size").cast("long")).alias("n_lines"), hashed("line").alias("h"), hashed(F.lit(17), "line", F.lit(29)).alias("g"), "line")
    return written(rows, f"{base}/rows", compression="zstd")


def _among(rows: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """The rows whose long ``by`` is one of asked's, and a share of the others: those that a bitmap of asked's lets through.

    It has sixteen bits for each of asked's rows, but PLACES at most, so what is broadcast is
    bounded; rows are left out only where their bit says that they aren't asked for.
    """
    places = 1 << min(max(6, (16 * asked.count()).bit_length()), PLACES.bit_length() - 1)
    place = F.xxhash64(by).bitwiseAND(F.lit(places - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = asked.select(F.shiftright(place, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words), "_word")
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _gone(rows: DataFrame, edits: Edits, hot: int, base: str) -> DataFrame:
    """(doc_id, number, h, exact) of the lines that go; h is a hash of the line."""
    rows = rows.where("line is not null")
    # a distinct line is known by its keys, which are all long, so they are aggregated by hashing
    named = _keyed(rows.select("h", "g", "line"), edits)
    named = named.groupBy("h", "g").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in named.columns[2:]])
    named = written(named.withColumn("id", F.monotonically_increasing_id()), f"{base}/named")

    def text_of(ids: DataFrame) -> DataFrame:
        # few lines are asked for, and the others' texts aren't shuffled
        ids = ids.select("id")
        asked = _among(named.select("id", "h", "g"), ids, "id").join(ids, "id", "left_semi")
        asked = written(asked, shared_dir(named.sparkSession, "asked"))
        return _among(rows.select("h", "g", "line"), asked, "h").join(asked, ["h", "g"]).groupBy("id").agg(F.first("line").alias("line"))

    labels = written(components(_links(named, text_of, edits, base, hot)), f"{base}/labels")
    keep = named.select("h", "g", "n", "id").join(labels, F.col("id") == F.col("node"), "left").where("n > 1 or label is not null")
    keep = keep.select("h", "g", F.coalesce("label", "id").alias("class"))
    place = F.struct("doc_id", "number")
    held = written(rows.select("doc_id", "number", "h", "g").join(keep, ["h", "g"]), f"{base}/held")
    first = written(held.groupBy("class", "h", "g").agg(F.min(place).alias("first")), f"{base}/first")
    kept = first.groupBy("class").agg(F.min("first").alias("kept"))
    gone = held.drop("class").join(first.join(kept, "class"), ["h", "g"]).where(place != F.col("kept"))
    return gone.select("doc_id", "number", "h", (place != F.col("first")).alias("exact"))


def without_duplicates(docs: DataFrame, edits: Edits = EDITS, hot: int = HOT) -> DataFrame:
    """The documents with all their columns and the text without the lines that go.

    A line goes where its number and its own text are listed, so rows that share
    an id keep lines that only another of them repeats.
    """
    base = shared_dir(docs.sparkSession, "lines")
    gone = _gone(_rows(docs, base), edits, hot, base).select(F.col("doc_id").alias("_id"), F.struct("number", "h").alias("_line")).groupBy("_id").agg(F.collect_set("_line").alias("_dropped"))
    rows = docs.join(gone, F.col("doc_id") == F.col("_id"), "left")
    listed = lambda x, i: F.array_contains("_dropped", F.struct(i.cast("int").alias("number"), F.xxhash64(F.trim(normalised(x))).alias("h")))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~listed(x, i)), "\n")
    return rows.withColumn("text", F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
