"""Queries over the driver tables, one for each operator, and the SQL of the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.functions import chem, qc, stats, text
from ionweave.operators import align, keys, predicates, relational, scoring, spectra
from ionweave.operators.tolerance import absolute_join, in_isolation_window, nearest_scan, overlap, tolerance, tolerance_join
from ionweave.plans import search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL expresses it, its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mz() -> Column:
    """An m/z value of lineitem rows, in four digits."""
    return F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 1e4) / 1e4


@query(
    "tolerance_join",
    """
    with ions as (select l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity * 1e4) / 1e4 as mz from lineitem where l_quantity > 0),
    frags as (select p_partkey, p_retailprice as fixedmass from part)
    select p_partkey, fixedmass, cast(count(*) as bigint) as n_ions, cast(count(distinct l_orderkey) as bigint) as n_peaks,
           round(avg(1e6 * (mz - fixedmass) / fixedmass), 6) as avg_ppm
    from frags join ions on mz between fixedmass - greatest(fixedmass * 5e-6, 0.002) and fixedmass + greatest(fixedmass * 5e-6, 0.002)
    group by p_partkey, fixedmass
    """,
)
def _tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragment search: measured ions within the tolerance of each library mass."""
    ions = _t(spark, sf_dir, "lineitem").where("l_quantity > 0")
    ions = ions.select("l_orderkey", "l_linenumber", _mz().alias("mz"))
    frags = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("fixedmass"))
    # parts of one mass find the same ions, which are counted once
    found = tolerance_join(frags.select("fixedmass").distinct(), ions, "fixedmass", "mz")
    ppm = 1e6 * (F.col("mz") - F.col("fixedmass")) / F.col("fixedmass")
    counts = found.groupBy("fixedmass").agg(
        F.count("*").alias("n_ions"), F.countDistinct("l_orderkey").alias("n_peaks"), F.round(F.avg(ppm), 6).alias("avg_ppm")
    )
    parts = frags.groupBy("p_partkey", "fixedmass").agg(F.count("*").alias("_n"))
    return parts.join(counts, "fixedmass").select("p_partkey", "fixedmass", (F.col("n_ions") * F.col("_n")).alias("n_ions"), "n_peaks", "avg_ppm")


# --- range joins -----------------------------------------------------------------------------------------------------


@query(
    "absolute_join",
    """
    with ions as (select l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity * 1e4) / 1e4 as mz from lineitem)
    select p_partkey, cast(count(*) as bigint) as n from part join ions on abs(p_retailprice - mz) < 0.002 group by p_partkey
    """,
)
def _absolute_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions = _t(spark, sf_dir, "lineitem").select(_mz().alias("mz"))
    return absolute_join(_t(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ions, "p_retailprice", "mz").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query(
    "isolation_window",
    """
    select l_orderkey, l_linenumber, abs(l_quantity - 25.0) <= 5.0 as dda, abs(l_quantity - 25.0) <= 2.5 as swath, true as dia from lineitem
    """,
)
def _isolation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, w = F.col("l_quantity"), F.lit(5.0)
    kinds = {k: in_isolation_window(F.lit(k.upper()), q, F.lit(25.0), w) for k in ("dda", "swath", "dia")}
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in kinds.items()])


@query(
    "interval_overlap",
    "select p_partkey, p_retailprice + 1.5 >= 950.0 - p_size and p_retailprice - 1.5 <= 950.0 + p_size as meets from part",
)
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", overlap(F.col("p_retailprice"), F.lit(1.5), F.lit(950.0), F.col("p_size").cast("double")).alias("meets"))


@query(
    "nearest_ms1",
    """
    with e as (select event_id, user_id, epoch_us(ts) as t, event_type = 'click' as anchor from events),
    w as (select *, max(case when anchor then t end) over (partition by user_id order by t, event_id rows between unbounded preceding and current row) as b,
                 min(case when anchor then t end) over (partition by user_id order by t, event_id rows between current row and unbounded following) as a from e)
    select event_id, case when a is null or t - b <= a - t then b else a end as nearest from w
    """,
)
def _nearest_ms1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return nearest_scan(e, ["user_id"], "t", F.col("event_type") == "click").select("event_id", "nearest")


# --- spectra ---------------------------------------------------------------------------------------------------------


@query(
    "eic",
    """
    select user_id, cast(ts as date) as day, round(sum(case when value between 50.0 - 5.0 and 50.0 + 5.0 then value else 0 end), 6) as intensity
    from events group by user_id, cast(ts as date)
    """,
)
def _eic(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.when(F.col("value").between(F.lit(50.0) - tolerance(F.lit(50.0), min_error=5.0), F.lit(50.0) + tolerance(F.lit(50.0), min_error=5.0)), F.col("value")).otherwise(0.0)
    return _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum(inside), 6).alias("intensity"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as packed spectra: m/z 100, 101, ... and absolute values in six digits."""
    e = _t(spark, sf_dir, "embeddings")
    mz = F.array_join(F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda k: (k + 99).cast("string")), " ")
    intensity = F.array_join(F.transform("embedding", lambda x: F.format_string("%.6f", F.abs(x.cast("double")))), " ")
    return e.select("vec_id", "label", mz.alias("mz"), intensity.alias("intensity"))


_UNPACKED_SQL = """
    with v as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as k, unnest(embedding) as x from embeddings),
    s as (select vec_id, label, k + 99.0 as mz, cast(printf('%.6f', abs(cast(x as double))) as double) as intensity from v)
"""


@query("unpack_separated", _UNPACKED_SQL + "select vec_id, cast(mz as double) as mz, intensity from s")
def _unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packed(spark, sf_dir).select("vec_id", spectra.unpack(F.col("mz"), F.col("intensity")).alias("ions"))
    return spectra.tidy(rows, "ions")


@query("unpack_zipped", _UNPACKED_SQL + "select vec_id, cast(mz as double) as mz, intensity from s")
def _unpack_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = F.array_join(F.zip_with(F.split("mz", " "), F.split("intensity", " "), lambda a, b: F.concat_ws(" ", a, b)), " ")
    return spectra.tidy(_packed(spark, sf_dir).select("vec_id", spectra.unpack_zipped(zipped).alias("ions")), "ions")


@query(
    "tic_bic",
    _UNPACKED_SQL
    + """
    select vec_id, round(sum(intensity), 6) as tic, cast(arg_max(mz, struct_pack(i := intensity, m := -mz)) as double) as base_ion, max(intensity) as base_int from s group by vec_id
    """,
)
def _tic_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions = spectra.unpack(F.col("mz"), F.col("intensity"))
    top = spectra.base_peak(F.col("ions"))
    return _packed(spark, sf_dir).select("vec_id", ions.alias("ions")).select("vec_id", F.round(spectra.total(F.col("ions")), 6).alias("tic"), top["mz"].alias("base_ion"), top["intensity"].alias("base_int"))


@query(
    "merged_scans",
    """
    select l_orderkey, round_even(l_suppkey + l_linenumber / 4.0, 1) as mz, round(sum(l_quantity), 4) as intensity from lineitem group by l_orderkey, round_even(l_suppkey + l_linenumber / 4.0, 1)
    """,
)
def _merged_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + F.col("l_linenumber") / 4).alias("mz"), F.col("l_quantity").alias("intensity"))
    return spectra.merged_scans(ions, ["l_orderkey"], 1).withColumn("intensity", F.round("intensity", 4))


@query(
    "dotprod",
    """
    with v as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as k, abs(cast(unnest(embedding) as double)) as i from embeddings),
    s as (select vec_id, label, k, i / sum(i) over (partition by vec_id) as i from v),
    w as (select vec_id, label, k, k * sqrt(i) as w from s),
    q as (select label as q_label, k, w as q_w from w where vec_id % 100 = 0)
    select w.vec_id, q.vec_id as query, round(pow(sum(w.w * q.w), 2) / nullif(sum(w.w * w.w) * sum(q.w * q.w), 0), 9) as dp
    from w join (select vec_id, k, w from w where vec_id % 100 = 0) q using (k) group by w.vec_id, q.vec_id
    """,
)
def _dotprod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dot_products(spark, sf_dir, "vec_id % 100 = 0")


@query("dotprod_all")
def _dotprod_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of searches: every hundredth vector is a query, so queries grow with the table."""
    return _dot_products(spark, sf_dir, "vec_id % 100 = 0")


def _dot_products(spark: SparkSession, sf_dir: str, wanted: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("i"))
    whole = F.aggregate(F.filter("i", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    e = e.select("vec_id", "i", whole.alias("whole"))
    w = e.select("vec_id", F.transform("i", lambda x, k: scoring.weight((k + 1).cast("double"), F.try_divide(x, F.col("whole")))).alias("w"))
    return scoring.vector_cosines(w, w.where(wanted).withColumnRenamed("vec_id", "query"), "vec_id", "query", digits=9)


@query(
    "compare_ms",
    """
    with ions as (select l_orderkey as peak, 100.0 + l_suppkey % 40 + l_discount / 100 as mz, sum(l_quantity) as i from lineitem group by all),
    s as (select peak, mz, i / sum(i) over (partition by peak) as i, max(mz) over (partition by peak) as top from ions),
    q as (select * from s where peak = 1),
    half1 as (
        select l.peak, q.mz, q.i, avg(l.mz) as y, sum(l.i) as yi from q join s l
          on abs(q.mz - l.mz) <= greatest(q.mz * 5e-6, 0.002) + greatest(l.top * 5e-6, 0.002) group by l.peak, q.mz, q.i),
    half2 as (
        select l.peak, l.mz, l.i, avg(q.mz) as y, sum(q.i) as yi from s l join q
          on abs(q.mz - l.mz) <= greatest(l.mz * 5e-6, 0.002) + greatest(q.top * 5e-6, 0.002) group by l.peak, l.mz, l.i),
    full1 as (select p.peak, q.mz, q.i, coalesce(h.y, 0) as y, coalesce(h.yi, 0) as yi from (select distinct peak from s) p cross join q left join half1 h on h.peak = p.peak and h.mz = q.mz),
    full2 as (select l.peak, l.mz, l.i, coalesce(h.y, 0) as y, coalesce(h.yi, 0) as yi from s l left join half2 h on h.peak = l.peak and h.mz = l.mz),
    a as (select peak, pow(sum(mz * sqrt(i) * y * sqrt(yi)), 2) / nullif(sum(mz * mz * i) * sum(y * y * yi), 0) as dp from full1 group by peak),
    b as (select peak, pow(sum(mz * sqrt(i) * y * sqrt(yi)), 2) / nullif(sum(mz * mz * i) * sum(y * y * yi), 0) as rdp from full2 group by peak)
    select peak, round(dp, 8) as dp, round(rdp, 8) as rdp from a join b using (peak)
    """,
)
def _compare_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores_with_first(spark, sf_dir, "true")


@query("compare_ms_all")
def _compare_ms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the whole library, as compare_ms."""
    return _scores_with_first(spark, sf_dir, "true")


def _scores_with_first(spark: SparkSession, sf_dir: str, wanted: str) -> DataFrame:
    mz = F.lit(100.0) + F.col("l_suppkey") % 40 + F.col("l_discount") / 100
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("peak"), mz.alias("mz"), "l_quantity")
    summed = F.sum("l_quantity").alias("intensity")
    q = rows.where("peak = 1").groupBy("mz").agg(summed).select(F.lit(1).alias("query"), "mz", "intensity")
    rows = rows.where(wanted)
    # dealt out by peak once, for the sums, the spectra and their scores
    library = keys.dealt(rows, keys.tasks_for(rows), "peak").groupBy("peak", "mz").agg(summed)
    pairs = rows.select(F.lit(1).alias("query"), "peak").distinct()
    out = scoring.compare(q, library, ["query"], ["peak"], pairs, few=True)  # one spectrum
    return out.select("peak", F.round("dp", 8).alias("dp"), F.round("rdp", 8).alias("rdp"))


@query(
    "uncertainty_spectrum",
    """
    with ions as (select l_orderkey % 50 as peak, l_partkey % 30 as g, l_linenumber as scan, 100 + l_discount as mz, l_quantity as i from lineitem),
    eic as (select peak, scan, sum(i) as eic from ions group by peak, scan),
    r as (select i.*, e.eic from ions i join eic e using (peak, scan)),
    c as (select peak, g from r group by peak, g having corr(eic, i) >= 0.0),
    b as (select peak, min(eic) as lo, max(eic) as hi from eic group by peak),
    k as (select peak, scan from eic join b using (peak) where eic >= 0.1 * (hi - lo) + lo),
    n as (select peak, count(distinct scan) as numscans from k group by peak),
    r2 as (select r.* from r join c using (peak, g) join k using (peak, scan)),
    f as (select peak, g from r2 join n using (peak) group by peak, g, numscans having count(distinct scan) >= 0.5 * numscans),
    r3 as (select r2.*, i / sum(i) over (partition by peak, scan) as share from r2 join f using (peak, g))
    select peak, g as ion_group, numscans, round(avg(mz), 9) as mz, round(stddev_samp(mz), 9) as mz_u, round(avg(share), 9) as int, round(stddev_samp(share), 9) as int_u, count(*) as n
    from r3 join n using (peak) group by peak, g, numscans
    """,
)
def _ums(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _t(spark, sf_dir, "lineitem")
    ions = l.select((F.col("l_orderkey") % 50).alias("peak"), (F.col("l_partkey") % 30).alias("ion_group"), F.col("l_linenumber").alias("scan"), (F.lit(100) + F.col("l_discount")).alias("mz"), F.col("l_quantity").alias("intensity"))
    eic = ions.groupBy("peak", "scan").agg(F.sum("intensity").alias("eic"))
    out = spectra.uncertainty_spectrum(ions, eic, ["peak"], 0.0, 10.0, 50.0)
    return out.select("peak", "ion_group", "numscans", F.round("mz", 9).alias("mz"), F.round("mz_u", 9).alias("mz_u"), F.round("int", 9).alias("int"), F.round("int_u", 9).alias("int_u"), "n")


def _peak_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of lineitem as ions; 20 orders make one peak, so peaks stay as small as they are in any size of the table."""
    l = _t(spark, sf_dir, "lineitem")
    eic = F.sum("l_quantity").over(Window.partitionBy("peak", "scan"))
    l = l.select(F.floor(F.col("l_orderkey") / 20).alias("peak"), F.col("l_linenumber").cast("long").alias("scan"), (F.lit(200.0) + F.col("l_partkey") % 25 + F.col("l_discount") / 100).alias("mz"), F.col("l_quantity").alias("intensity"), "l_quantity")
    return l.withColumn("eic", eic).drop("l_quantity")


@query("align_ions")
def _align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(_peak_ions(spark, sf_dir), ["peak"])


@query("optimal_parameters")
def _optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.optimal_parameters(align.aligned(_peak_ions(spark, sf_dir), ["peak"]), ["peak"])


@query("pooled_spectra")
def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _peak_ions(spark, sf_dir).select("peak", "scan", "mz", F.lit(0.01).alias("mz_u"), F.col("intensity").alias("int"), F.lit(0.5).alias("int_u"), F.lit(3).cast("long").alias("n"))
    return align.pooled(rows, ["peak"], "scan")


@query("bootstrap")
def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector's spectrum and the next one's, drawn 200 times: the spread of their score."""
    e = _t(spark, sf_dir, "embeddings").where("vec_id % 100 < 2").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    e = e.select("vec_id", F.floor(F.col("vec_id") / 100).alias("pair"), (F.col("k") + 100.0).alias("mz"), F.lit(0.0005).alias("mz_u"), F.abs(F.col("x").cast("double")).alias("int"), F.lit(0.01).alias("int_u"))
    runs = scoring.bootstrap(e.where("vec_id % 100 = 0"), e.where("vec_id % 100 = 1"), 200, seed=7, key=["pair"])
    return runs.groupBy("pair").agg(F.count("*").alias("runs"), *[f("dp").alias(n) for f, n in ((F.min, "least"), (F.median, "median"), (F.max, "most"), (F.stddev_samp, "spread"))])


@query(
    "corr_filter",
    "select user_id, round(corr(value, epoch_us(ts) / 1e6), 9) as r from events group by user_id having corr(value, epoch_us(ts) / 1e6) > 0",
)
def _corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.corr("value", t).alias("r")).where("r > 0").select("user_id", F.round("r", 9).alias("r"))


@query(
    "pooled_sd",
    """
    with g as (select l_orderkey % 10 as k, l_suppkey, stddev_samp(l_quantity) as sd, count(*) as n from lineitem group by 1, 2)
    select k, round(sqrt(sum((n - 1) * coalesce(sd, 0) * coalesce(sd, 0)) / nullif(sum(n - 1), 0)), 9) as sd from g group by k
    """,
)
def _pooled_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _t(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 10).alias("k"), "l_suppkey").agg(F.stddev_samp("l_quantity").alias("sd"), F.count("*").alias("n"))
    return g.groupBy("k").agg(F.round(scoring.pooled_sd(F.coalesce("sd", F.lit(0.0)), F.col("n")), 9).alias("sd"))


@query(
    "check_fragments",
    """
    with ions as (select l_orderkey as peak_id, floor(l_extendedprice / l_quantity * 1e4) / 1e4 as mz from lineitem),
    f as (select o_orderkey as peak_id, p_partkey, p_retailprice as fixedmass from orders join part on p_partkey = o_orderkey % 200 + 1)
    select peak_id, p_partkey, exists (select 1 from ions i where i.peak_id = f.peak_id and i.mz between fixedmass - 2.0 and fixedmass + 2.0) as matched from f
    """,
)
def _check_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("peak_id"), _mz().alias("mz"))
    o, p = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "part")
    f = o.join(p, F.col("p_partkey") == F.col("o_orderkey") % 200 + 1).select(F.col("o_orderkey").alias("peak_id"), "p_partkey", F.col("p_retailprice").alias("fixedmass"))
    return scoring.check_fragments(f, ions, "peak_id", min_error=2.0).select("peak_id", "p_partkey", "matched")


@query(
    "search_fragments",
    """
    with ions as (select distinct floor(l_extendedprice / l_quantity * 1e4) / 1e4 as mz from lineitem),
    f as (select p_partkey as fragment_id, p_retailprice as fixedmass, p_type as formula, case when p_size > 25 then p_name end as smiles from part),
    links as (select l_partkey as fragment_id, l_orderkey as peak_id, l_suppkey as compound_id from lineitem),
    m as (select mz, f.* from ions join f on fixedmass between mz - greatest(mz * 5e-6, 0.002) and mz + greatest(mz * 5e-6, 0.002)),
    g as (select mz, m.fragment_id, fixedmass, formula, smiles, count(distinct compound_id) as n_compounds, count(distinct peak_id) as n_peaks from m left join links using (fragment_id) group by all)
    select mz, fragment_id, n_compounds, n_peaks, round(1e6 * (mz - fixedmass) / fixedmass, 4) as mass_error,
           case when smiles is not null then 'structure' when formula is not null then 'formula' else 'unknown' end as label, bool_or(smiles is not null) over (partition by mz) as has_smiles from g
    """,
)
def _search_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_fragments(spark, sf_dir, "true")


@query("search_fragments_all")
def _search_fragments_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of all ions, as search_fragments."""
    return _found_fragments(spark, sf_dir, "true")


def _found_fragments(spark: SparkSession, sf_dir: str, wanted: str) -> DataFrame:
    l, p = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    ions = l.where(wanted).select(_mz().alias("mz")).distinct()
    f = p.select(F.col("p_partkey").alias("fragment_id"), F.col("p_retailprice").alias("fixedmass"), F.col("p_type").alias("formula"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("smiles"))
    links = l.select(F.col("l_partkey").alias("fragment_id"), F.col("l_orderkey").alias("peak_id"), F.col("l_suppkey").alias("compound_id"))
    out = search.search_fragments(ions, f, links)
    return out.select("mz", "fragment_id", "n_compounds", "n_peaks", F.round("mass_error", 4).alias("mass_error"), "label", "has_smiles")


# --- predicates ------------------------------------------------------------------------------------------------------


def _criteria(name: str, sql: str, criteria: dict, **settings) -> None:
    @query(name, f"select p_partkey, p_brand, p_type, p_size from part where {sql}")
    def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return predicates.table_search(_t(spark, sf_dir, "part"), ["p_partkey", "p_brand", "p_type", "p_size"], criteria, **settings)


_criteria("criteria_and", "p_brand = 'Brand#12' and p_size = 7", {"p_brand": "Brand#12", "p_size": 7})
_criteria("criteria_or", "p_brand = 'Brand#12' or p_size = 7", {"p_brand": "Brand#12", "p_size": 7}, and_or="OR")
_criteria("criteria_in", "p_size in (1, 2, 3)", {"p_size": [1, 2, 3]})
_criteria("criteria_like", "p_brand ilike '%and#1%'", {"p_brand": {"values": "AND#1", "like": True}})
_criteria("criteria_not", "not p_brand = 'Brand#12'", {"p_brand": {"values": "Brand#12", "exclude": True}})
_criteria("criteria_null", "p_type is null", {"p_type": "NULL"})
_criteria("criteria_any_case", "p_brand in ('BRAND#12', 'brand#12', 'Brand#12')", {"p_brand": "bRAND#12"}, case_sensitive=False)


@query(
    "match_rows",
    """
    select o_orderkey, o_custkey, o_orderstatus from orders o
    where exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_nationkey is not distinct from cast(o.o_orderkey % 25 as integer))
    """,
)
def _match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    orders = _t(spark, sf_dir, "orders").withColumn("nation", (F.col("o_orderkey") % 25).cast("int"))
    return predicates.match_rows(orders, wanted).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("any_column", "select n_nationkey, n_name, n_regionkey from nation where cast(n_nationkey as varchar) = '3' or n_name = '3' or cast(n_regionkey as varchar) = '3'")
def _any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.any_column(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "3")


# --- groups, windows, joins ------------------------------------------------------------------------------------------


@query("keep_ties_of_max", "select p_partkey, p_brand, p_size from (select *, max(p_size) over (partition by p_brand) as m from part) where p_size = m")
def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_ties_of_max(_t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")


@query(
    "trace_filter",
    "select user_id, event_type, count(*) as n from events where user_id in (select user_id from events group by user_id having max(value) > 0.9 * (select max(value) from events)) group by user_id, event_type",
)
def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_group_max(_t(spark, sf_dir, "events"), ["user_id"], "value", 0.9).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("group_concat", "select r_name, string_agg(n_name, ' with ' order by n_name) as names from nation join region on n_regionkey = r_regionkey group by r_name")
def _group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " with ").alias("names"))


@query(
    "quantiles",
    """
    select event_type, round(quantile_cont(value, 0.0), 6) as min, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median,
           round(quantile_cont(value, 0.75), 6) as q3, round(quantile_cont(value, 1.0), 6) as max from events group by event_type
    """,
)
def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stats.quantiles(_t(spark, sf_dir, "events"), ["event_type"], "value")
    return q.select("event_type", *[F.round(F.col("quantiles")[k], 6).alias(n) for k, n in enumerate(("min", "q1", "median", "q3", "max"))])


@query(
    "decode",
    "select o_orderkey, c_name as customer, n_name as nation, r_name as region from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey",
)
def _decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (_t(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_custkey").alias("nation"), F.col("o_custkey").alias("region"))
    dims = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "right")
    return relational.decode(rows, {"customer": (dims, "c_custkey", "c_name"), "nation": (dims, "c_custkey", "n_name"), "region": (dims, "c_custkey", "r_name")})


@query(
    "narrative",
    """
    select c_custkey, 'Customer ' || c_name || ' is ' || case when substr(lower(c_mktsegment), 1, 1) in ('a', 'e', 'i', 'o', 'u') then 'an ' else 'a ' end || lower(c_mktsegment) || ' buyer from ' ||
           upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) as narrative
    from customer left join nation on n_nationkey = c_nationkey
    """,
)
def _narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    segment = F.lower("c_mktsegment")
    return rows.select("c_custkey", F.concat(F.lit("Customer "), "c_name", F.lit(" is "), text.article(segment), segment, F.lit(" buyer from "), text.sentence_case(F.col("n_name"))).alias("narrative"))


@query(
    "union_tagged",
    "select 'customer' as kind, c_nationkey as nation from customer union select 'supplier', s_nationkey from supplier",
)
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return c.union(_t(spark, sf_dir, "supplier").select(F.lit("supplier"), "s_nationkey")).distinct()


@query("orphans", "select c_custkey, c_nationkey from customer where c_custkey not in (select o_custkey from orders)")
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.orphans(_t(spark, sf_dir, "customer"), "c_custkey", _t(spark, sf_dir, "orders"), "o_custkey").select("c_custkey", "c_nationkey")


@query(
    "append_new",
    "select n_name as name from nation union all (select distinct p_brand from part where p_brand not in (select n_name from nation))",
)
def _append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.append_new(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name")), ["name"])


@query(
    "add_or_get",
    """
    with top as (select max(n_nationkey) as t from nation), v as (select distinct p_brand as name from part union select n_name from nation),
    fresh as (select name, row_number() over (order by name) as r from v where name not in (select n_name from nation))
    select name, cast(coalesce(n_nationkey, t + r) as bigint) as id from v left join nation on n_name = name left join fresh using (name), top
    """,
)
def _add_or_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return relational.add_or_get(nation, _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).union(nation.select("name")).distinct(), ["name"]).select("name", "id")


@query(
    "normalize_key",
    """
    with top as (select max(r_regionkey) as t from region), fresh as (select p_brand as name, row_number() over (order by p_brand) as r from (select distinct p_brand from part where p_brand not in (select r_name from region)))
    select p_partkey, cast(coalesce(r_regionkey, t + r) as bigint) as brand from part left join region on r_name = p_brand left join fresh on name = p_brand, top
    """,
)
def _normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return relational.normalize_key(_t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand")), "brand", dim)[0]


@query(
    "full_join_upsert",
    "select coalesce(c_nationkey, s_nationkey) as nation, coalesce(c, 0) as customers, coalesce(s, 0) as suppliers from (select c_nationkey, count(*) as c from customer group by 1) full join (select s_nationkey, count(*) as s from supplier group by 1) on c_nationkey = s_nationkey",
)
def _full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").fillna(0)


@query(
    "pivot_wide",
    "select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view from events group by user_id",
)
def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1))).fillna(0, ["click", "view"])


@query(
    "pivot_long",
    "select p_partkey, 'p_brand' as name, p_brand as value from part union all select p_partkey, 'p_type', p_type from part",
)
def _unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type").unpivot("p_partkey", ["p_brand", "p_type"], "name", "value")


@query(
    "scan_cycles",
    """
    with e as (select user_id, event_id, case when event_type = 'click' then 1 else 2 end as lvl from events),
    c as (select *, count(*) filter (lvl = 1) over (partition by user_id order by event_id rows between unbounded preceding and current row) as cycle from e),
    p as (select *, row_number() over (partition by user_id, cycle, lvl order by event_id) - 1 as place from c)
    select event_id, cycle, cast(10 as double) as energy from p where lvl = 1 union all select event_id, cycle, 30 from p where lvl = 1
    union all select event_id, cycle, case when place % 2 = 0 then 10 else 30 end from p where lvl = 2
    """,
)
def _scan_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", 1).otherwise(2).alias("level"))
    return relational.scan_cycles(e, ["user_id"], "event_id", "level", [10.0, 30.0]).select("event_id", "cycle", "energy")


@query(
    "fill_down",
    "select event_id, last_value(case when event_type = 'click' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as v from events",
)
def _fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return relational.fill_down(e, ["user_id"], ["event_id"], ["v"]).select("event_id", "v")


@query(
    "violations",
    "select p_partkey, 'size' as failed from part where not p_size <= 40 union all select p_partkey, 'brand' from part where not regexp_matches(p_brand, '^Brand#[1-4]')",
)
def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"size": F.col("p_size") <= 40, "brand": F.col("p_brand").rlike("^Brand#[1-4]")}
    return relational.violations(_t(spark, sf_dir, "part"), checks).select("p_partkey", "failed")


@query("repeated", "select p_brand, p_size, count(*) as n from part group by p_brand, p_size having count(*) > 1")
def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.repeated(_t(spark, sf_dir, "part"), ["p_brand", "p_size"])


@query("json_field", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


# --- chemistry and quality control -----------------------------------------------------------------------------------

_FORMULA_SQL = "'C' || cast(p_size as varchar) || 'H' || cast(p_partkey % 30 + 1 as varchar) || 'F' || cast(p_partkey % 7 + 2 as varchar) || 'O'"


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: c.cast("string")
    f = F.concat(F.lit("C"), n(F.col("p_size")), F.lit("H"), n(F.col("p_partkey") % 30 + 1), F.lit("F"), n(F.col("p_partkey") % 7 + 2), F.lit("O"))
    return _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", f.alias("formula"))


@query(
    "formula_mass",
    f"select p_partkey, {_FORMULA_SQL} as formula, round(cast(p_size * 12.0 + (p_partkey % 30 + 1) * 1.00782503223 + (p_partkey % 7 + 2) * 18.99840316273 + 15.99491461957 as double), 6) as mass, cast(p_size as integer) as n_c from part",
)
def _formula_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = chem.elements(F.col("formula"))
    return _formulas(spark, sf_dir).select("p_partkey", "formula", F.round(chem.mass(counts), 6).alias("mass"), counts["C"].alias("n_c"))


@query("formula_subset", "select p_partkey, p_size >= 5 and p_partkey % 7 + 2 >= 4 as part from part")
def _formula_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formulas(spark, sf_dir).select("p_partkey", chem.is_subset(chem.elements(F.lit("C5F4")), chem.elements(F.col("formula"))).alias("part"))


@query(
    "adduct_mass",
    "select p_partkey, round(cast(p_size * 12.0 + (p_partkey % 30 + 1) * 1.00782503223 + (p_partkey % 7 + 2) * 18.99840316273 + 15.99491461957 - 1.00782503223 + 0.0005486 as double), 6) as mz from part",
)
def _adduct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formulas(spark, sf_dir).select("p_partkey", F.round(chem.mass(chem.elements(F.col("formula"))) + chem.adduct_shift("-H"), 6).alias("mz"))


@query("isotope_patterns")
def _isotopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chem.isotope_patterns(_formulas(spark, sf_dir).select("p_partkey", "formula"), "formula")


@query(
    "casrn",
    """
    with c as (select p_partkey, cast(1000 + p_partkey as varchar) as a, lpad(cast(p_size as varchar), 2, '0') as b, p_partkey % 10 as d from part),
    s as (select *, reverse(a || b) as r from c),
    t as (select *, list_sum(list_transform(range(1, len(r) + 1), lambda i: cast(substr(r, i, 1) as integer) * i)) % 10 as x from s)
    select p_partkey, case when x = d then a || '-' || b || '-' || cast(d as varchar) end as casrn from t
    """,
)
def _casrn(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws("-", F.concat(F.lit("0"), (F.lit(1000) + F.col("p_partkey")).cast("string")), F.lpad(F.col("p_size").cast("string"), 2, "0"), (F.col("p_partkey") % 10).cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", chem.casrn(raw).alias("casrn"))


@query(
    "qc_mass_error",
    "select p_partkey, round(1e6 * (p_retailprice + p_size * 1e-4 - p_retailprice) / p_retailprice, 4) as measurederror, abs(1e6 * (p_retailprice + p_size * 1e-4 - p_retailprice) / p_retailprice) <= 3.0 as mass_ok from part",
)
def _qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").withColumn("measured", F.col("p_retailprice") + F.col("p_size") * 1e-4)
    return qc.mass_error(p, "measured", "p_retailprice", F.lit(3.0)).select("p_partkey", F.round("measurederror", 4).alias("measurederror"), "mass_ok")


@query(
    "alias_url",
    """
    select p_partkey, case when p_type ilike '%casrn%' then 'cas/' || p_name when p_size % 3 = 0 then 'dtx/' || replace(p_brand, '#', '%23') when p_size % 3 = 1 then 'cid/' || cast(p_partkey as varchar) end as url from part
    """,
)
def _url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("p_type").ilike("%casrn%"), F.concat(F.lit("cas/"), "p_name")).when(F.col("p_size") % 3 == 0, F.concat(F.lit("dtx/"), F.replace("p_brand", F.lit("#"), F.lit("%23"))))
    return _t(spark, sf_dir, "part").select("p_partkey", url.when(F.col("p_size") % 3 == 1, F.concat(F.lit("cid/"), F.col("p_partkey").cast("string"))).alias("url"))


# these give the rows of the queries that they are named after
for _name in ("dotprod", "compare_ms", "search_fragments"):
    ORACLE_SQL[f"{_name}_all"] = ORACLE_SQL[_name]
