"""Queries over the corpus tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exactdedup, filteraudit, linededup, lm, mixing, ngramjoin, personal, quality, repetition, tokenfiles, urlfilter, vectorcodes
from .shared import table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal.find(docs, personal.learn(docs))
    order = F.array(*map(F.lit, personal.ALL_KINDS))

    def joined(spans):
        keyed = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]), s["end"], F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("text")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["text"]), ",")

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in personal.KINDS]
    more = [F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), *more)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.duplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(lm.is_training(F.col("doc_id"))), order=3)
    held_out = (~lm.is_training(F.col("doc_id"))).alias("held_out")
    return lm.score(docs, model).select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.tokenized(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.linked(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.measured(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, repetition.base_failed().alias("base_failed"), repetition.is_kept().alias("kept"), "repeat_chars")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_line_dedup": op2_line_dedup,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_token_files": op6_token_files,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_repetition": op12_repetition,
    "op13_vector_codes": op13_vector_codes,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _assigned(books: str) -> str:
    return f"select row, p, x, min(list_sum([(t[1] - t[2]) * (t[1] - t[2]) for t in list_zip(x, c)]) * 64 + e) as best from parts join {books} using (p) group by row, p, x"


def _refined(assigned: str, books: str) -> str:
    return f"""
        select p, e, coalesce(m.c, b.c) as c from {books} b left join (
            select p, e, list((s - ((s % n) + n) % n) // n order by k) as c
            from (select p, best % 64 as e, k, sum(x[k]) as s, count(*) as n from {assigned}, (select unnest(range(1, width + 1)) as k from size) group by all) group by p, e
        ) m using (p, e)"""


ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": f"""
        with b as (select item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from benchmark),
        patterns as (
            select distinct item_id, len(w) as m, array_to_string(w, ' ') as p from b where len(w) between 1 and 9
            union
            select distinct item_id, 10, array_to_string(w[k : k + 9], ' ') from (select item_id, w, unnest(range(1, len(w) - 8)) as k from b where len(w) >= 10)
        ),
        d as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents),
        lengths as (select distinct m from patterns),
        windows as (
            select doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') as p
            from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as k from d, lengths where len(w) >= m)
        ),
        found as (select doc_id, k, m, item_id from windows join patterns using (m, p)),
        hits as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(k, k + m)) as q from found) group by doc_id),
        items as (select doc_id, count(*) as n, string_agg(s, ',' order by s) as l from (select distinct doc_id, cast(item_id as varchar) as s from found) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hits.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
               sha256(coalesce(items.l, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
        from d left join hits using (doc_id) left join items using (doc_id)
    """,
    "op8_ngram_join": f"""
        with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        shingles as (
            select distinct doc_id, array_to_string(w[k : k + 3], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 2)) as k from d where len(w) >= 4)
            union all
            select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 3
        ),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b using (s) where a.doc_id <> b.doc_id group by all),
        links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        reached as (select a, b from links union select reached.a, links.b from reached join links on reached.b = links.a)
        select doc_id, coalesce(any_value(n), 0) as n_shingles, least(doc_id, coalesce(min(b), doc_id)) as component_id
        from d left join sizes using (doc_id) left join reached on a = doc_id group by doc_id
    """,
    "op7_exact_dedup": f"""
        with t as (select doc_id, {_LOWER} as t from documents)
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from t
    """,
    "op11_filter_audit": f"""
        with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, {_WORDS} as w from documents),
        failed as (
            select doc_id, part,
                   (case when len(w) < 200 then 1 else 0 end)
                   + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
                   + (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 4 else 0 end)
                   + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
                   + (case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end) as f
            from d
        ),
        known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
        rows as (
            select part, f, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
            from failed left join known using (doc_id) group by part, f
        ),
        letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as t (letter, bit)),
        steps as (
            select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, s.step,
                   case s.step when 1 then a.bit when 2 then b.bit when 3 then c.bit when 4 then d.bit else e.bit end as bit,
                   (case when s.step > 1 then a.bit else 0 end) + (case when s.step > 2 then b.bit else 0 end)
                   + (case when s.step > 3 then c.bit else 0 end) + (case when s.step > 4 then d.bit else 0 end) as before
            from letters a, letters b, letters c, letters d, letters e, (select unnest(range(1, 6)) as step) s
            where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ),
        counted as (
            select part, filter_order, cast(step as int) as step, bit,
                   cast(sum(case when f & (bit | before) = 0 then n else 0 end) as bigint) as kept,
                   cast(sum(case when f & bit <> 0 and f & before = 0 then n else 0 end) as bigint) as removed,
                   cast(sum(case when f & bit <> 0 and f & before <> 0 then n else 0 end) as bigint) as redundant,
                   cast(sum(case when f = bit then n else 0 end) as bigint) as unique_fails,
                   cast(sum(case when f & bit <> 0 and f & before = 0 then good else 0 end) as bigint) as good_lost,
                   cast(sum(case when f & bit <> 0 and f & before = 0 then toxic else 0 end) as bigint) as toxic_lost
            from rows, steps group by all
        )
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               cast(sum(removed) over (partition by part, bit) as bigint) as shapley
        from counted
    """,
    "op12_repetition": f"""
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
        windows as (select r, k, m, array_to_string(w[k : k + m - 1], ' ') as p from (select r, w, m, unnest(range(1, len(w) - m + 2)) as k from d, (select unnest([8, 101]) as m) where len(w) >= m)),
        twice as (select r, k, m from (select r, k, m, count(*) over (partition by r, m, p) as n from windows) where n > 1),
        covered as (select distinct r, q from (select r, unnest(range(k, k + 8)) as q from twice where m = 8)),
        repeats as (select r, count(*) as n, sum(length(w[q])) as chars from covered join d using (r) group by r),
        long as (select distinct r from twice where m = 101),
        lines as (select r, unnest(string_split(text, chr(10))) as line from d),
        same as (select r, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r),
        counts as (
            select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
                   cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(same.n, 0) as bigint) as n_dup_lines,
                   cast(coalesce(repeats.n, 0) as bigint) as n_repeat_words, cast(coalesce(repeats.chars, 0) as bigint) as repeat_chars, long.r is not null as long
            from d left join same using (r) left join repeats using (r) left join long using (r)
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
               not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * repeat_chars > 30 * word_chars or long) as kept, repeat_chars
        from counts
    """,
    "op13_vector_codes": f"""
        with vectors as (
            select row_number() over (order by vec_id) - 1 as row, vec_id, label, [cast(floor(256 * cast(y as double)) as bigint) for y in embedding] as x
            from embeddings where embedding is not null and len([y for y in embedding if y is null or not isfinite(y)]) = 0
        ),
        size as (select max(len(x)) // 16 as width from vectors),
        parts as (select row, p, x[p * width + 1 : (p + 1) * width] as x from vectors, size, (select unnest(range(16)) as p)),
        b0 as (select p, row as e, x as c from parts where row < 64),
        a1 as ({_assigned("b0")}),
        b1 as ({_refined("a1", "b0")}),
        a2 as ({_assigned("b1")}),
        b2 as ({_refined("a2", "b1")}),
        a3 as ({_assigned("b2")}),
        coded as (select row, string_agg(lower(printf('%02x', best % 64)), '' order by p) as code, cast(sum(best // 64) as bigint) as error from a3 group by row)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
               (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from b2) as codebooks_sha256
        from coded join vectors using (row)
    """,
}
