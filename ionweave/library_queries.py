"""Queries over a spectral library whose tables are drawn from the driver tables, and the SQL of the same results.

``TABLES`` has each library table as a SELECT over driver tables, in the part of
SQL that Spark and the SQL side share, so both see the same rows; everything
after that is the library's own operators on one side, plain SQL on the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.functions import chem, qc, stats, text
from ionweave.operators import keys, predicates, relational, scoring, spectra
from ionweave.plans import imports, methods, peak_tables, schema, search, views
from ionweave.plans.api import Library
from ionweave.sources import files
from ionweave.streaming import ingest

Frames = dict[str, DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_REGION = "select cast(r_regionkey as bigint) as id, r_name as name, upper(substr(r_name, 1, 2)) as acronym, lower(substr(r_name, 1, 1)) as abbreviation from region"
_NATION = "select cast(n_nationkey as bigint) as id, n_name as name, upper(substr(n_name, 1, 3)) as acronym from nation"
TABLES: dict[str, str] = {
    **dict.fromkeys(("norm_sample_classes", "norm_ion_states", "norm_analyte_alias_references", "norm_ms_types", "norm_chromatography_types", "norm_column_positions", "norm_duration_units", "norm_flow_units", "norm_additive_units", "norm_polarity_types", "norm_ionization", "norm_voltage_units", "norm_ce_units", "norm_ce_desc"), _REGION),
    **dict.fromkeys(("norm_generation_type", "affiliations", "norm_carriers", "norm_additives", "norm_vendors", "norm_column_chemistries", "norm_fragmentation_types"), _NATION),
    "elements": "select cast(n_nationkey as bigint) as atomic_number, upper(substr(n_name, 1, 2)) as symbol, n_name as common_name from nation",
    "isotopes": "select p_partkey % 25 as atomic_number, p_retailprice as exact_mass, cast(p_size as double) / 50 as abundance from part",
    "contributors": "select c_custkey as id, c_name as username, case when c_custkey % 3 > 0 then c_mktsegment end as first_name, case when c_custkey % 5 > 0 then c_name end as last_name, cast(c_nationkey as bigint) as affiliation from customer",
    "samples": "select o_orderkey as id, 'run ' || cast(o_orderkey as varchar(20)) as mzml_name, o_orderpriority as description, o_orderkey % 7 as sample_class_id, o_custkey as sample_contributor, o_orderkey % 25 as generation_type, o_orderdate as generated_on, o_orderkey % 11 as ms_methods_id from orders",
    "peaks": "select o_orderkey as id, o_orderkey as sample_id, 3 as num_points, o_totalprice / 100 as precursor_mz, o_orderkey % 6 as ion_state, cast(o_custkey as double) / 100 as rt_centroid from orders",
    "ms_data": "select vec_id as id, vec_id % 400 + 1 as peak_id, label % 2 + 1 as ms_n, cast(vec_id as double) / 8 as scantime, cast(vec_id % 90 as varchar(9)) || '.5 ' || cast(100 + label as varchar(9)) as measured_mz, '10 ' || cast(label as varchar(9)) as measured_intensity, case when label > 0 then cast(1 as double) end as base_ion from embeddings",
    "norm_fragments": "select p_partkey as id, p_retailprice as fixedmass, -1 as netcharge, p_type as formula, p_size % 2 as radical, case when p_size > 25 then p_name end as smiles from part",
    "annotated_fragments": "select l_orderkey * 10 + l_linenumber as id, l_extendedprice / l_quantity as mz, l_partkey as fragment_id from lineitem",
    "compounds": "select s_suppkey as id, cast(s_nationkey as bigint) as category, s_name as name, 'C' || cast(s_suppkey % 40 as varchar(9)) as formula, s_acctbal as fixedmass from supplier",
    "compound_fragments": "select l_orderkey as peak_id, l_suppkey as compound_id, l_orderkey * 10 + l_linenumber as annotated_fragment_id from lineitem where l_linenumber < 7",
    "compound_aliases": "select p_partkey % 100 as compound_id, p_partkey % 5 as alias_type, p_brand as alias from part",
    "qc_data": "select o_orderkey as peak_id, case when o_orderkey % 3 = 0 then 'msaccuracy' else 'other' end as name, case when o_orderkey % 4 = 0 then 'x' else cast(o_custkey % 9 as varchar(9)) end as value from orders",
    "logs": "select event_type as affects_table, ts as executed_on, case when user_id % 2 = 0 then 'a' else 'b' end as category from events",
    "ms_methods": "select p_partkey as id, p_partkey % 6 as ionization, p_size % 5 as voltage_units, p_size as voltage, p_partkey % 5 as polarity, p_size + 3 as ce_value, p_partkey % 7 as ce_units, p_size % 5 as ce_desc, p_partkey % 25 as fragmentation from part",
    "ms_descriptions": "select l_partkey as ms_methods_id, l_linenumber % 5 as ms_types_id, l_suppkey % 27 as vendor_id, l_returnflag as vendor_model from lineitem where l_orderkey % 2 = 0",
    "chromatography_descriptions": "select l_partkey as ms_methods_id, l_suppkey % 6 as chromatography_types_id, l_suppkey % 25 as system_vendor_id, l_linestatus as system_vendor_model, l_linenumber % 25 as column_chemistry_id, l_linenumber % 5 as column_position_id from lineitem where l_orderkey % 2 = 1",
    "carrier_mix_collections": "select p_partkey as id, p_name as name from part",
    "carrier_mixes": "select l_partkey as mix_id, l_suppkey % 30 as component, case when l_linenumber < 6 then l_quantity / 64 end as fraction from lineitem where l_suppkey % 4 = 0",
    "carrier_additives": "select l_partkey as mix_id, l_suppkey % 27 as component, case when l_linenumber < 5 then l_quantity end as amount, l_suppkey % 7 as units from lineitem where l_suppkey % 5 = 0",
    "mobile_phases": "select o_custkey % 300 as ms_methods_id, o_orderkey as sample_id, o_orderkey as peak_id, o_orderkey % 600 as carrier_mix_collection_id, case when o_orderkey % 3 > 0 then cast(o_custkey as double) / 4 end as flow, o_orderkey % 6 as flow_units, case when o_orderkey % 4 > 0 then cast(o_custkey as double) / 2 end as duration, o_orderkey % 7 as duration_units from orders",
    "lines_all": "select l_orderkey, l_linenumber, l_extendedprice, l_quantity from lineitem",
    "lines": "select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as l_linenumber, l_suppkey, l_partkey, l_quantity from lineitem",
    "categories": "select cast(n_nationkey as bigint) as id, n_name as name, case when n_nationkey > 0 then cast((n_nationkey - 1) // 3 as bigint) end as subclass_of from nation",
}
_DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


class _Library(dict):
    """Frames of library tables, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        text = TABLES[name].replace(" // ", " div ")
        source = re.search(r" from (\w+)", text)[1]
        self[name] = self.spark.sql(text.replace(f" from {source}", " from {source}"), source=self.spark.read.parquet(f"{self.sf_dir}/{source}.parquet"))
        return self[name]


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query on library frames; its SQL sees the library tables that it names."""

    def add(f: Callable[[Frames], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(_Library(spark, sf_dir))
        if sql is not None:
            own, more = [], sql
            for t in sorted(TABLES, key=len, reverse=True):
                if re.search(rf"\b(from|join) {t}\b", more):
                    own.append(f"{t} as ({TABLES[t]})")
            head = ", ".join(own)
            own = re.match(r"with (recursive )?", sql)
            ORACLE_SQL[name] = f"with {own[1] or ''}{head}, {sql[own.end() :]}" if own else f"with {head} {sql}"
        return f

    return add


# --- views -----------------------------------------------------------------------------------------------------------


@query("view_element_isotopes", "select atomic_number, symbol, cast(cast(round(exact_mass) as integer) as varchar) || symbol as isotope, exact_mass, abundance from isotopes join elements using (atomic_number)")
def _element_isotopes(t: Frames) -> DataFrame:
    return views.element_isotopes(t)


@query("view_exact_masses", "select atomic_number, symbol, exact_mass, abundance from (select *, max(abundance) over (partition by atomic_number) as top from isotopes join elements using (atomic_number)) where abundance = top")
def _exact_masses(t: Frames) -> DataFrame:
    return views.exact_masses(t).select("atomic_number", "symbol", "exact_mass", "abundance")


_ANNOTATED = "annotated as (select a.id, a.mz, a.fragment_id, f.formula, f.fixedmass, f.netcharge, f.radical, f.smiles, 1e6 * (a.mz - f.fixedmass) / f.fixedmass as ppm from annotated_fragments a join norm_fragments f on a.fragment_id = f.id)"
_LINKED = f"{_ANNOTATED}, linked as (select k.peak_id, k.compound_id, c.name as compound, c.formula as compound_formula, a.* from compound_fragments k join annotated a on a.id = k.annotated_fragment_id join compounds c on c.id = k.compound_id)"
_STATS = f"{_LINKED}, stats as (select a.fragment_id, count(a.mz) as n, min(a.mz) as lo, avg(a.mz) as mean, max(a.mz) as hi from annotated a left join compound_fragments k on k.annotated_fragment_id = a.id group by a.fragment_id)"


@query("view_annotated_fragments", f"with {_ANNOTATED} select id, mz, fragment_id, formula, netcharge, radical, smiles, round(ppm, 3) as ppm_error from annotated")
def _annotated(t: Frames) -> DataFrame:
    return views.annotated_fragments(t).drop("fixedmass").withColumn("ppm_error", F.round("ppm_error", 3))


@query("view_compound_fragments", f"with {_LINKED} select peak_id, compound_id, compound, compound_formula, id as annotated_fragment_id, mz, formula, smiles from linked")
def _compound_fragments(t: Frames) -> DataFrame:
    return views.compound_fragments(t).select("peak_id", "compound_id", "compound", "compound_formula", "annotated_fragment_id", "mz", "formula", "smiles")


@query("view_fragment_mz_stats", f"with {_STATS} select fragment_id, n, lo as mz_min, round(mean, 8) as mz_mean, hi as mz_max from stats")
def _mz_stats(t: Frames) -> DataFrame:
    return views.fragment_mz_stats(t).select("fragment_id", "n", "mz_min", F.round("mz_mean", 8).alias("mz_mean"), "mz_max")


@query("view_compound_fragments_stats", f"with {_STATS} select compound_id, compound, l.fragment_id, count(mz) as n, min(mz) as mz_min, round(avg(mz), 8) as mz_mean, max(mz) as mz_max, round(sqrt(sum(pow(mz - mean, 2)) / nullif(count(mz) - 1, 0)), 6) as mz_sd from linked l join stats s on s.fragment_id = l.fragment_id group by compound_id, compound, l.fragment_id, formula")
def _compound_stats(t: Frames) -> DataFrame:
    return views.compound_fragment_stats(t).select("compound_id", "compound", "fragment_id", "n", "mz_min", F.round("mz_mean", 8).alias("mz_mean"), "mz_max", F.round("mz_sd", 6).alias("mz_sd"))


@query("view_fragment_count", f"with {_LINKED} select compound_formula, min(compound) as name, count(distinct formula) as n from linked group by compound_formula")
def _fragment_count(t: Frames) -> DataFrame:
    return views.fragment_count(t)


@query("view_contributors", "select c.id, case when c.first_name is null or c.last_name is null then c.username else c.first_name || ' ' || c.last_name end as name, a.name as affiliation, count(*) as samples from contributors c join affiliations a on c.affiliation = a.id join samples s on s.sample_contributor = c.id where c.id <> 1 group by all")
def _contributors(t: Frames) -> DataFrame:
    return views.contributors(t)


@query("view_samples", "select s.id, mzml_name, description, k.name as sample_class_id, c.username as sample_contributor, g.name as generation_type from samples s left join norm_sample_classes k on k.id = s.sample_class_id left join contributors c on c.id = s.sample_contributor left join norm_generation_type g on g.id = s.generation_type")
def _samples(t: Frames) -> DataFrame:
    return views.samples(t).drop("generated_on", "ms_methods_id")


@query("view_sample_narrative", "select s.id, 'Sample ' || mzml_name || ' is ' || case when substr(lower(k.name), 1, 1) in ('a', 'e', 'i', 'o', 'u') then 'an ' else 'a ' end || lower(k.name) || ' sample (' || description || '), generated by ' || c.username || ' on ' || strftime(generated_on, '%Y-%m-%d') || '.' as narrative from samples s left join norm_sample_classes k on k.id = s.sample_class_id left join contributors c on c.id = s.sample_contributor")
def _sample_narratives(t: Frames) -> DataFrame:
    return views.sample_narratives(t)


@query("view_peaks", "select p.id, sample_id, num_points, precursor_mz, i.name as ion_state, rt_centroid from peaks p left join norm_ion_states i on i.id = p.ion_state")
def _peaks(t: Frames) -> DataFrame:
    return views.peaks(t)


@query("peak_data", "select peak_id, precursor_mz, rt_centroid, m.id, ms_n, scantime, 'MS' || cast(ms_n as varchar) as level, measured_mz, measured_intensity, base_ion from ms_data m join peaks p on p.id = m.peak_id")
def _peak_data(t: Frames) -> DataFrame:
    return views.peak_data(t, unpack=False)


_PEAK_SPECTRA = "select m.id, peak_id, unnest([cast(split_part(measured_mz, ' ', 1) as double), cast(split_part(measured_mz, ' ', 2) as double)]) as mz, unnest([cast(split_part(measured_intensity, ' ', 1) as double), cast(split_part(measured_intensity, ' ', 2) as double)]) as intensity from ms_data m join peaks p on p.id = m.peak_id"


@query("peak_spectra", f"{_PEAK_SPECTRA} where base_ion is not null")
def _peak_spectra(t: Frames) -> DataFrame:
    return views.peak_spectra(t).select("id", "peak_id", "mz", "intensity")


@query("compound_data", f"{_PEAK_SPECTRA} where base_ion is not null and peak_id in (select peak_id from compound_fragments where compound_id = 7)")
def _compound_data(t: Frames) -> DataFrame:
    return Library(t).compound_data(7).select("id", "peak_id", "mz", "intensity")


@query("view_masserror", "select p.id as peak_id, precursor_mz, min(try_cast(value as double)) as msaccuracy from peaks p join qc_data q on q.peak_id = p.id where q.name = 'msaccuracy' group by p.id, precursor_mz")
def _mass_errors(t: Frames) -> DataFrame:
    return views.mass_errors(t)


@query("compound_url", "select c.id, c.name, r.name as reference, alias, case when r.name ilike 'asia' then 'https://one/' || replace(alias, '#', '%23') when r.name ilike 'europe' then 'https://two?' || replace(alias, '#', '%23') || '/x' end as link from compound_aliases a join norm_analyte_alias_references r on r.id = a.alias_type join compounds c on c.id = a.compound_id")
def _urls(t: Frames) -> DataFrame:
    return views.compound_urls(t, {"asia": "https://one/{}", "europe": "https://two?{}/x"})


@query("log_summaries", "select affects_table, cast(executed_on as date) as day, count(*) as n, min(category) as category from logs group by 1, 2")
def _log_summaries(t: Frames) -> DataFrame:
    return views.log_summaries(t["logs"])


# --- methods ---------------------------------------------------------------------------------------------------------

_CARRIERS = "cm as (select mix_id, n.name as component, case when fraction is null then '' else cast(fraction * 100 as varchar) end as amount, case when fraction is null then '' else 'percent' end as unit_name, case when fraction is null then '' else '%' end as unit from carrier_mixes m left join norm_carriers n on n.id = m.component)"
_ADDITIVES = "ca as (select mix_id, n.name as component, case when amount is null then '' else cast(amount as varchar) end as amount, case when amount is null then '' else u.name end as unit_name, case when amount is null then '' else u.abbreviation end as unit from carrier_additives m left join norm_additives n on n.id = m.component left join norm_additive_units u on u.id = m.units)"


def _method_view(name: str, view: Callable[[Frames], DataFrame], sql: str) -> None:
    query(f"view_{name}", sql)(view)


_method_view("mass_analyzers", methods.mass_analyzers, "select ms_methods_id, acronym, name from ms_descriptions join norm_ms_types on id = ms_types_id")
_method_view("chromatography_types", methods.chromatography_types, "select ms_methods_id, acronym, name from chromatography_descriptions join norm_chromatography_types on id = chromatography_types_id")
_method_view("carrier_mix", methods.carrier_mix, f"with {_CARRIERS} select * from cm")
_method_view("carrier_additives", methods.carrier_additives, f"with {_ADDITIVES} select * from ca")
_method_view("carrier_mix_collection", methods.carrier_mix_collection, f"with {_CARRIERS}, {_ADDITIVES} select c.id, c.name, component, component_type, amount, unit from carrier_mix_collections c join (select *, 'carrier' as component_type from cm union select *, 'additive' from ca) x on x.mix_id = c.id")
_LISTED = "replace(replace(string_agg(p, ',' order by p), ',', ' / '), ' ( )', '')"
_method_view(
    "mobile_phase_narrative", methods.mobile_phase_narrative,
    f"""with {_CARRIERS}, {_ADDITIVES},
    cl as (select mix_id, {_LISTED} as carriers from (select mix_id, component || ' (' || amount || ' ' || unit || ')' as p from cm) group by mix_id),
    al as (select mix_id, {_LISTED} as additives from (select mix_id, component || ' (' || amount || ' ' || unit || ')' as p from ca) group by mix_id),
    x as (select al.mix_id, coalesce(carriers, '') as c, coalesce(additives, '') as a from al left join cl using (mix_id))
    select ms_methods_id, sample_id, peak_id, coalesce(c, '') || case when coalesce(a, '') = '' then '' else case when c = '' then '' else ' with ' end || a || ' amendment' end
        || coalesce(' for ' || cast(duration as varchar), '') || coalesce(' ' || d.abbreviation, '') || coalesce(' at ' || cast(flow as varchar), '') || coalesce(' ' || f.abbreviation, '') as narrative
    from mobile_phases m left join x on x.mix_id = m.carrier_mix_collection_id left join norm_duration_units d on d.id = m.duration_units left join norm_flow_units f on f.id = m.flow_units""",
)
_DETECTORS = "det as (select ms_methods_id, replace(string_agg(name, ',' order by name), ',', ' ') as detectors from ms_descriptions join norm_ms_types on id = ms_types_id group by ms_methods_id)"
_COLUMNS = "col as (select ms_methods_id, replace(string_agg(p, ',' order by p), ',', ' with ') as columns from (select distinct ms_methods_id, h.name || ' ' || o.name || ' column' as p from chromatography_descriptions d join norm_column_positions o on o.id = d.column_position_id join norm_column_chemistries h on h.id = d.column_chemistry_id) group by ms_methods_id)"
_SEPARATION = """ctv as (select ms_methods_id, replace(string_agg(acronym, ',' order by acronym), ',', ' x ') as chrom_type from chromatography_descriptions d left join norm_chromatography_types c on c.id = d.chromatography_types_id where column_position_id = 2 group by ms_methods_id),
    sv as (select ms_methods_id, string_agg(distinct v.name, ' x ' order by v.name) as chrom_vendor, string_agg(distinct system_vendor_model, ' x ' order by system_vendor_model) as chrom_model from chromatography_descriptions d left join norm_vendors v on v.id = d.system_vendor_id group by ms_methods_id),
    sep as (select sv.*, coalesce(chrom_type, case when ctv.ms_methods_id is not null then '' end) as chrom_type from sv left join ctv using (ms_methods_id))"""
_method_view("detectors", methods.detectors, f"with {_DETECTORS} select * from det")
_method_view("column_chemistries", methods.column_chemistries, f"with {_COLUMNS} select * from col")
_method_view("separation_types", methods.separation_types, f"with {_SEPARATION} select * from sep")
_METHOD = f"""{_DETECTORS}, {_COLUMNS}, {_SEPARATION},
    ven as (select ms_methods_id, min(v.name) as mv, min(vendor_model) as mm from ms_descriptions d left join norm_vendors v on v.id = d.vendor_id group by ms_methods_id),
    m as (select q.id, chrom_vendor as chromatography_system_vendor, chrom_model as chromatograph_model, chrom_type as chromatographic_type, mv as mass_spectrometer_vendor, mm as mass_spectrometer_model, detectors as detector, columns,
        f.acronym as fragmentation_acronym, f.name as fragmentation_name, p.name as polarity, i.acronym as ionization, cast(voltage as varchar) || ' ' || vu.name as voltage, cast(ce_value as varchar) || ' ' || cu.name as collision_energy, cd.name as collision_energy_description
        from ms_methods q left join norm_ionization i on i.id = q.ionization left join norm_polarity_types p on p.id = q.polarity left join norm_voltage_units vu on vu.id = q.voltage_units left join norm_ce_units cu on cu.id = q.ce_units
        left join norm_fragmentation_types f on f.id = q.fragmentation left join norm_ce_desc cd on cd.id = q.ce_desc left join ven on ven.ms_methods_id = q.id left join sep on sep.ms_methods_id = q.id left join det on det.ms_methods_id = q.id left join col on col.ms_methods_id = q.id)"""
_method_view("method", methods.method, f"with {_METHOD} select * from m")
_method_view(
    "method_narrative", methods.method_narrative,
    f"""with {_METHOD} select id, 'Measured by ' || chromatographic_type || ' (' || chromatography_system_vendor || ') ' || detector || ' MS (' || mass_spectrometer_vendor || '), separated by ' || columns || ' in ' || polarity || ' ' || ionization
    || ' mode at ' || voltage || ' and ' || collision_energy_description || ' fragmentation by ' || fragmentation_acronym || ' (' || fragmentation_name || ') at ' || collision_energy || '.' as narrative from m""",
)


# --- table verbs -----------------------------------------------------------------------------------------------------


@query("update_rows", "select id, name, case when category > 3 and name like '%2%' then 'changed' else formula end as formula, case when category > 3 and name like '%2%' then null else fixedmass end as fixedmass, category from compounds")
def _update(t: Frames) -> DataFrame:
    return relational.update(t["compounds"], {"formula": "changed", "fixedmass": "NA"}, {"category": None, "name": {"values": "2", "like": True}}, extra=F.col("category") > 3)


@query("delete_rows", "select id, peak_id, ms_n from ms_data where peak_id not in (select id from peaks where ion_state = 2)")
def _delete(t: Frames) -> DataFrame:
    frames = {"peaks": t["peaks"], "ms_data": t["ms_data"], "compound_fragments": t["compound_fragments"]}
    return schema.delete(frames, "peaks", t["peaks"].where("ion_state = 2"))["ms_data"].select("id", "peak_id", "ms_n")


@query("delete_sets_null", "select case when p.ion_state = 2 then -1 else peak_id end as peak_id, compound_id, annotated_fragment_id from compound_fragments left join peaks p on p.id = peak_id")
def _delete_links(t: Frames) -> DataFrame:
    frames = {"peaks": t["peaks"], "ms_data": t["ms_data"], "compound_fragments": t["compound_fragments"]}
    return schema.delete(frames, "peaks", t["peaks"].where("ion_state = 2"))["compound_fragments"].fillna(-1, ["peak_id"])


@query("get_id", "select id from contributors where first_name is null and affiliation = 3")
def _get_id(t: Frames) -> DataFrame:
    return predicates.table_search(t["contributors"], ["id"], {"first_name": "NULL", "affiliation": 3})


@query("nrow", "select count(*) as n from peaks where ion_state in (1, 2)")
def _nrow(t: Frames) -> DataFrame:
    return predicates.where(t["peaks"], {"ion_state": [1, 2]}).agg(F.count("*").alias("n"))


@query("distinct_rows", "select distinct ionization, polarity from ms_methods")
def _distinct(t: Frames) -> DataFrame:
    return predicates.table_search(t["ms_methods"], ["ionization", "polarity"], distinct=True)


@query("order_limit", "select id, fixedmass from norm_fragments order by fixedmass desc, id limit 25")
def _order_limit(t: Frames) -> DataFrame:
    return predicates.table_search(t["norm_fragments"], ["id", "fixedmass"], order_by=[("fixedmass", False), ("id", True)], limit=25)


@query("nearest_first", "select id, fixedmass, abs(fixedmass - 950.03) as distance from norm_fragments order by abs(fixedmass - 950.03), id limit 10")
def _nearest_first(t: Frames) -> DataFrame:
    return relational.nearest_first(t["norm_fragments"].select("id", "fixedmass"), "fixedmass", 950.03, ["id"], 10)


@query("criteria_fuzzy", "select id, name from compounds where name ilike '%7%' or formula ilike '%c1%'")
def _fuzzy(t: Frames) -> DataFrame:
    return predicates.table_search(t["compounds"], ["id", "name"], {"name": "7", "formula": "c1"}, and_or="OR", fuzzy=True)


@query("exists_value", "select count(*) filter (where name in ('NATION_3', 'nowhere')) > 0 as found from affiliations")
def _exists(t: Frames) -> DataFrame:
    return t["affiliations"].agg((F.count_if(predicates.criterion(F.col("name"), ["NATION_3", "nowhere"])) > 0).alias("found"))


@query(
    "category_tree",
    "with recursive up as (select id, name, 0 as depth, id as root, name as path from categories where subclass_of is null union all select c.id, c.name, depth + 1, root, path || ' / ' || c.name from categories c join up on up.id = c.subclass_of) select id, cast(depth as bigint) as depth, root, path from up",
)
def _tree(t: Frames) -> DataFrame:
    return relational.hierarchy(t["categories"], "id", "subclass_of", "name").select("id", "depth", "root", "path")


@query("fill_both_ways", "select id, coalesce(last_value(base_ion ignore nulls) over (partition by peak_id % 20 order by id rows between unbounded preceding and current row), first_value(base_ion ignore nulls) over (partition by peak_id % 20 order by id rows between current row and unbounded following)) as v from ms_data")
def _fill(t: Frames) -> DataFrame:
    rows = t["ms_data"].select("id", (F.col("peak_id") % 20).alias("g"), F.col("base_ion").alias("v"))
    return relational.fill_up(relational.fill_down(rows, ["g"], ["id"], ["v"]), ["g"], ["id"], ["v"]).select("id", "v")


@query("group_sizes", "select distinct compound_id, count(*) over (partition by compound_id) as n from compound_fragments")
def _group_sizes(t: Frames) -> DataFrame:
    return relational.counted(t["compound_fragments"].select("compound_id"), ["compound_id"]).distinct()


@query("nested_groups", "select compound_id, string_agg(distinct cast(peak_id as varchar), ' ' order by cast(peak_id as varchar)) as peaks, count(distinct peak_id) as n from compound_fragments group by compound_id")
def _nested(t: Frames) -> DataFrame:
    rows = relational.nested(t["compound_fragments"], ["compound_id"], "peak_id", "peaks")
    return rows.select("compound_id", F.array_join(F.array_sort(F.transform("peaks", lambda x: x.cast("string"))), " ").alias("peaks"), F.size("peaks").cast("long").alias("n"))


@query("spread_of_groups", "select sample_class_id as g, count(*) as n, round(stddev_samp(sample_contributor), 6) as sd, round(avg(sample_contributor), 6) as mean from samples group by 1")
def _spread(t: Frames) -> DataFrame:
    return relational.summarised(t["samples"], ["sample_class_id"], "sample_contributor").select(F.col("sample_class_id").alias("g"), "n", F.round("sd", 6).alias("sd"), F.round("mean", 6).alias("mean"))


@query(
    "spearman",
    """with r as (select affiliation as g, id as x, length(name) * 7 + id % 13 as y from (select c.id, c.affiliation, a.name from contributors c join affiliations a on a.id = c.affiliation)),
    k as (select g, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2 as rx, rank() over (partition by g order by y) + (count(*) over (partition by g, y) - 1) / 2 as ry from r)
    select g, round(corr(rx, ry), 9) as r from k group by g""",
)
def _spearman(t: Frames) -> DataFrame:
    rows = t["contributors"].select(F.col("id").alias("x"), F.col("affiliation").alias("g")).join(t["affiliations"].select(F.col("id").alias("g"), "name"), "g")
    return stats.spearman(rows.withColumn("y", F.length("name") * 7 + F.col("x") % 13), ["g"], "x", "y").select("g", F.round("r", 9).alias("r"))


# --- searches --------------------------------------------------------------------------------------------------------


@query("precursor_candidates", "select id as peak_id, precursor_mz from peaks where precursor_mz between 1500 - 4.5 and 1500 + 4.5")
def _precursors(t: Frames) -> DataFrame:
    return search.candidates(t["peaks"].select(F.col("id").alias("peak_id"), "precursor_mz"), 1500.0, 3000.0, 0.002)


@query(
    "peak_context",
    """select p.id as peak_id, k.name as sample_class, coalesce(c.compound_id, -1) as compound_id, c.compound, q.a as msaccuracy from peaks p join samples s on s.id = p.sample_id left join norm_sample_classes k on k.id = s.sample_class_id
    left join (select peak_id, min(compound_id) as compound_id, arg_min(c.name, compound_id) as compound from compound_fragments l join compounds c on c.id = l.compound_id group by peak_id) c on c.peak_id = p.id
    left join (select peak_id, min(try_cast(value as double)) as a from qc_data where name = 'msaccuracy' group by peak_id) q on q.peak_id = p.id""",
)
def _context(t: Frames) -> DataFrame:
    return search.peak_context(t["peaks"].select(F.col("id").alias("peak_id")), t).fillna(-1, ["compound_id"])


_SEARCHED = """with i as (
        select l_orderkey as peak_id, l_linenumber % 2 as odd, l_linenumber as scan, unnest([100.0e0 + l_suppkey % 20, 200.0e0 + l_partkey % 10, 300.0e0 + l_orderkey % 5]) as mz, unnest([l_quantity, 10.0e0 * l_linenumber, l_quantity + 3]) as v from lines
    ),
    shares as (select peak_id, odd, scan, mz, v / sum(v) over (partition by peak_id, odd, scan) as share from i),
    u as (select peak_id, odd, mz, avg(share) as i from shares group by peak_id, odd, mz),
    s as (select peak_id, odd, mz, i / sum(i) over (partition by peak_id, odd) as i from u),
    near as (select distinct l_orderkey as peak_id from lines where l_orderkey % 5 = 2),
    q as (select odd, mz, i from s where peak_id = 2),
    a as (
        select n.peak_id, q.odd, pow(sum(q.mz * sqrt(q.i) * coalesce(s.mz, 0) * sqrt(coalesce(s.i, 0))), 2) / nullif(sum(q.mz * q.mz * q.i) * sum(coalesce(s.mz * s.mz * s.i, 0)), 0) as dp
        from near n cross join q left join s on s.peak_id = n.peak_id and s.odd = q.odd and s.mz = q.mz group by all),
    b as (
        select s.peak_id, s.odd, pow(sum(s.mz * sqrt(s.i) * coalesce(q.mz, 0) * sqrt(coalesce(q.i, 0))), 2) / nullif(sum(s.mz * s.mz * s.i) * sum(coalesce(q.mz * q.mz * q.i, 0)), 0) as rdp
        from near join s using (peak_id) left join q on s.odd = q.odd and s.mz = q.mz group by all),
    f as (
        select peak_id, count(*) filter (where mass in (select mz from q where odd = 0)) as fragments_matched, count(*) as fragments
        from near join (select l_orderkey as peak_id, 100.0e0 + l_suppkey % 20 + case when l_partkey % 3 = 0 then 0.5e0 else 0 end as mass from lines) using (peak_id) group by peak_id),
    r as (
        select n.peak_id, a1.dp as ms1_dp, b1.rdp as ms1_rdp, a2.dp as ms2_dp, b2.rdp as ms2_rdp, fragments_matched, fragments from near n left join a a1 on a1.peak_id = n.peak_id and a1.odd = 1 left join a a2 on a2.peak_id = n.peak_id and a2.odd = 0
        left join b b1 on b1.peak_id = n.peak_id and b1.odd = 1 left join b b2 on b2.peak_id = n.peak_id and b2.odd = 0 left join f on f.peak_id = n.peak_id)
    select peak_id, round(ms1_dp, 8) as ms1_dp, round(ms1_rdp, 8) as ms1_rdp, round(ms2_dp, 8) as ms2_dp, round(ms2_rdp, 8) as ms2_rdp, fragments_matched, fragments,
           round(coalesce(ms1_dp, 0) + coalesce(ms1_rdp, 0) + coalesce(ms2_dp, 0) + coalesce(ms2_rdp, 0), 7) as sum_match from r"""


@query("search_compound", _SEARCHED)
def _search_compound(t: Frames) -> DataFrame:
    """Peak 2's MS1 and MS2 spectra, searched among the peaks with its precursor: scans, alignment, spectra, scores, fragments."""
    lines = t["lines"]
    ion = lambda mz, v: F.struct(mz.cast("double").alias("mz"), v.cast("double").alias("intensity"))
    ions = F.array(ion(F.lit(100) + F.col("l_suppkey") % 20, F.col("l_quantity")), ion(F.lit(200) + F.col("l_partkey") % 10, F.lit(10.0) * F.col("l_linenumber")), ion(F.lit(300) + F.col("l_orderkey") % 5, F.col("l_quantity") + 3))
    scans = lines.select(F.col("l_orderkey").alias("peak_id"), F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2).alias("ms_n"), F.col("l_linenumber").cast("double").alias("scantime"), ions.alias("ions"))
    peaks = lines.select(F.col("l_orderkey").alias("peak_id"), (F.lit(300.0) + F.col("l_orderkey") % 5).alias("precursor_mz")).distinct()
    mass = F.lit(100.0) + F.col("l_suppkey") % 20 + F.when(F.col("l_partkey") % 3 == 0, 0.5).otherwise(0.0)
    fragments = lines.select(F.col("l_orderkey").alias("peak_id"), mass.alias("fixedmass"))
    own = peaks.where("peak_id = 2")
    query1, query2 = (search.library_spectra(scans.where("peak_id = 2"), own, level).select("mz", "int") for level in (1, 2))
    out = search.search_compound(query1, query2, peaks, scans, fragments, precursor=302.0)
    return out.select("peak_id", *[F.round(c, 8).alias(c) for c in ("ms1_dp", "ms1_rdp", "ms2_dp", "ms2_rdp")], "fragments_matched", "fragments", F.round("sum_match", 7).alias("sum_match"))


_PEAK_TABLE = """with s as (
        select l_orderkey as peak_id, l_linenumber as scan, l_linenumber % 3 = 1 as first_level, l_quantity + 3e0 as trace, l_quantity + 10e0 * l_linenumber + l_quantity + 3 as tic,
               [100e0 + l_suppkey % 20, 200e0 + l_partkey % 10, 300e0 + l_orderkey % 5] as mz, [cast(l_quantity as double), 10e0 * l_linenumber, l_quantity + 3e0] as v from lines
    ),
    m as (select *, row_number() over (partition by peak_id order by scan) as place from s where not first_level),
    near as (select m.peak_id, place, m.scan, m.mz, m.v, m.tic, arg_min(s.trace, abs(s.scan - m.scan)) as eic, max(s.trace) filter (where s.scan = m.scan - 1) as before from m join s on s.peak_id = m.peak_id and s.first_level group by all),
    apex as (select peak_id, place as apex from (select peak_id, place, row_number() over (partition by peak_id order by {seed} desc nulls last, place) as r from near) where r = 1),
    i as (select n.peak_id, place, eic, unnest(mz) as mz, unnest(v) as v, abs(place - apex) * 100 + place as visit from near n join apex using (peak_id)),
    g as (select peak_id, mz, row_number() over (partition by peak_id order by min(visit), mz) - 1 as ion_group from i group by peak_id, mz)
    select i.peak_id, place as scan, ion_group, i.mz, v as intensity, eic from i join g on g.peak_id = i.peak_id and g.mz = i.mz"""


def _cycles(t: Frames) -> DataFrame:
    """Scans of cycles of one MS1 and two MS2 scans, for each order a peak."""
    ion = lambda mz, v: F.struct(mz.cast("double").alias("mz"), v.cast("double").alias("intensity"))
    ions = F.array(ion(F.lit(100) + F.col("l_suppkey") % 20, F.col("l_quantity")), ion(F.lit(200) + F.col("l_partkey") % 10, F.lit(10.0) * F.col("l_linenumber")), ion(F.lit(300) + F.col("l_orderkey") % 5, F.col("l_quantity") + 3))
    level = F.when(F.col("l_linenumber") % 3 == 1, 1).otherwise(2)
    return t["lines"].select(F.col("l_orderkey").alias("peak_id"), level.alias("ms_n"), F.col("l_linenumber").cast("double").alias("scantime"), (F.lit(300.0) + F.col("l_orderkey") % 5).alias("precursor_mz"), ions.alias("ions"))


@query("peak_table_ms2", _PEAK_TABLE.replace("{seed}", "before"))
def _peak_table_ms2(t: Frames) -> DataFrame:
    return peak_tables.peak_table(_cycles(t), 2)


@query("peak_table_tic", _PEAK_TABLE.replace("{seed}", "tic"))
def _peak_table_tic(t: Frames) -> DataFrame:
    return peak_tables.peak_table(_cycles(t), 2, start="tic")


@query(
    "scans_of_peaks",
    """with p as (select id, fixedmass as wanted, radical * 50 + id % 50 as a from norm_fragments), s as (select id, mz, fragment_id, mz / 50 as t, id % 10 as n, fragment_id + 880.0 as pre from annotated_fragments)
    select p.id as peak_id, s.id as scan from p join s on s.t between p.a and p.a + 0.02 where n = 1 or abs(pre - wanted) <= 40""",
)
def _scans_of_peaks(t: Frames) -> DataFrame:
    start = (F.col("radical") * 50 + F.col("id") % 50).cast("double")
    peaks = t["norm_fragments"].select(F.col("id").alias("peak_id"), F.col("fixedmass").alias("precursor_mz"), start.alias("rt_start"), (start + 0.02).alias("rt_end"))
    scans = t["annotated_fragments"].select(F.col("id").alias("scan"), (F.col("id") % 10).alias("ms_n"), (F.col("mz") / 50).alias("scantime"), (F.col("fragment_id") + 880.0).alias("precursor_mz"))
    return search.scans_of_peaks(peaks, scans, "DDA", 40.0).select("peak_id", "scan")


@query("fragments_of_peaks", "select peak_id, f.id as fragment_id, count(*) as n, min(a.mz) as mz, string_agg(distinct cast(compound_id as varchar), ',' order by cast(compound_id as varchar)) as compounds from compound_fragments k join annotated_fragments a on a.id = k.annotated_fragment_id join norm_fragments f on f.id = a.fragment_id group by peak_id, f.id")
def _peak_fragments(t: Frames) -> DataFrame:
    rows = t["compound_fragments"].join(t["annotated_fragments"].withColumnRenamed("id", "annotated_fragment_id"), "annotated_fragment_id").join(t["norm_fragments"].select(F.col("id").alias("fragment_id")), "fragment_id")
    many = relational.concatenated(rows.withColumn("compound", F.col("compound_id").cast("string")), ["peak_id", "fragment_id"], "compound", ",", distinct=True, name="compounds")
    return rows.groupBy("peak_id", "fragment_id").agg(F.count("*").alias("n"), F.min("mz").alias("mz")).join(many, ["peak_id", "fragment_id"])


@query("eic_of_scans", f"with x as ({_PEAK_SPECTRA}) select id, sum(case when mz between 50 - 60.5 and 50 + 60.5 then intensity else 0 end) as intensity from x group by id")
def _eic(t: Frames) -> DataFrame:
    return views.peak_data(t).select("id", spectra.extracted(F.col("ions"), F.lit(50.0), 5.0, 60.5).alias("intensity"))


@query(
    "zoomed_scans",
    f"with x as ({_PEAK_SPECTRA}) select id, count(*) filter (where mz between 40 and 104) as n, avg(mz) filter (where mz between 40 and 104 and abs(mz - 60) <= 20) as base_ion, coalesce(sum(intensity) filter (where mz between 40 and 104 and abs(mz - 60) <= 20), 0) as base_int from x group by id",
)
def _zoomed(t: Frames) -> DataFrame:
    z = spectra.zoomed(F.col("ions"), F.lit(60.0), 20.0, 44.0, 5.0, 20.0)
    return views.peak_data(t).select("id", z.alias("z")).select("id", F.size("z.ions").cast("long").alias("n"), "z.base_ion", "z.base_int")


@query("msp_export", "select 'Name:  ' || name || chr(10) || 'PrecursorMZ:  ' || cast(fixedmass as varchar) || chr(10) || 'Num Peaks:  ' || cast(count(*) as varchar) || chr(10) || string_agg(cast(m as varchar) || ' ' || cast(i as varchar), chr(10) order by m, i) || chr(10) as text from (select distinct compound_id, cast(peak_id as double) as m, cast(annotated_fragment_id % 97 as double) as i from compound_fragments) join compounds on id = compound_id group by compound_id, name, fixedmass")
def _msp(t: Frames) -> DataFrame:
    rows = t["compound_fragments"].select("compound_id", F.col("peak_id").cast("double").alias("mz"), (F.col("annotated_fragment_id") % 97).cast("double").alias("intensity")).distinct()
    rows = rows.join(t["compounds"].select(F.col("id").alias("compound_id"), "name", "fixedmass"), "compound_id")
    return files.msp(rows, "compound_id", "name", "fixedmass").select("text")


# --- imports and checks ----------------------------------------------------------------------------------------------


@query("resolve_names", "select s.id, coalesce(case when d.n = 1 then d.id end, -1) as description_id from (select id, lower(trim(description)) as v from samples) s left join (select lower(x) as v, count(distinct id) as n, min(id) as id from (select id, name as x from norm_sample_classes union all select id, 'no' from norm_sample_classes union all select 99, '1-URGENT') group by 1) d on d.v = s.v")
def _resolve(t: Frames) -> DataFrame:
    spark = t["samples"].sparkSession
    dim = t["norm_sample_classes"].select("id", "name", F.lit("no").alias("other")).unionByName(spark.createDataFrame([(99, "1-URGENT", None)], "id long, name string, other string"))
    return imports.resolve(t["samples"].select("id", "description"), "description", dim)[0].select("id", F.coalesce("description_id", F.lit(-1)).alias("description_id"))


@query("split_aliases", "select id, case when k = 2 then 'CAS' end as type, case k when 1 then name when 2 then '7-' || cast(id as varchar) else formula end as alias from compounds, (values (1), (2), (3)) v(k)")
def _split_aliases(t: Frames) -> DataFrame:
    joined = F.concat("name", F.lit("; cas:7-"), F.col("id").cast("string"), F.lit(";; "), "formula")
    return imports.split_aliases(t["compounds"].select("id", joined.alias("aliases")), "id", "aliases")


@query("majority_vote", "select fragment_id, compound_id from (select *, row_number() over (partition by fragment_id order by n desc, compound_id) as r from (select fragment_id, compound_id, count(*) as n from annotated_fragments a join compound_fragments k on k.annotated_fragment_id = a.id group by fragment_id, compound_id)) where r = 1")
def _vote(t: Frames) -> DataFrame:
    tasks = keys.tasks_for(t["annotated_fragments"])
    links = keys.dealt(t["compound_fragments"].select("annotated_fragment_id", "compound_id"), tasks, "annotated_fragment_id")
    rows = t["annotated_fragments"].select(F.col("id").alias("annotated_fragment_id"), "fragment_id").join(links, "annotated_fragment_id")
    return imports.vote(rows, ["fragment_id"], "compound_id", tasks)


_HOLES = "select case when peak_id % 3 > 0 then peak_id end as peak_id, case when compound_id % 2 > 0 then compound_id end as compound_id, case when annotated_fragment_id % 5 > 0 then annotated_fragment_id end as annotated_fragment_id from compound_fragments"


@query("ternary_links", f"select distinct coalesce(peak_id, -1) as peak_id, coalesce(compound_id, -1) as compound_id, coalesce(annotated_fragment_id, -1) as annotated_fragment_id from ({_HOLES}) where (peak_id is not null)::int + (compound_id is not null)::int + (annotated_fragment_id is not null)::int >= 2")
def _ternary(t: Frames) -> DataFrame:
    k = t["compound_fragments"].select(*[F.when(F.col(c) % m > 0, F.col(c)).alias(c) for c, m in (("peak_id", 3), ("compound_id", 2), ("annotated_fragment_id", 5))])
    return imports.ternary_links(k, ["peak_id", "compound_id", "annotated_fragment_id"]).fillna(-1)


@query("remove_sample", "select m.id, m.polarity from ms_methods m where m.id not in (select ms_methods_id from samples where sample_class_id = 3) or m.id in (select ms_methods_id from samples where sample_class_id <> 3)")
def _remove_sample(t: Frames) -> DataFrame:
    frames = {"samples": t["samples"].withColumn("id", F.col("sample_class_id")), "ms_methods": t["ms_methods"]}
    return imports.without_sample(frames, 3)["ms_methods"].select("id", "polarity")


@query("map_fields", "select name as label, null as missing, cast(id as bigint) as number from compounds")
def _map_fields(t: Frames) -> DataFrame:
    fields = [{"import_parameter": a, "sql_table": "x", "sql_parameter": b} for a, b in (("name", "label"), ("absent", "missing"), ("id", "number"))] + [{"import_parameter": "formula", "sql_table": "y", "sql_parameter": "z"}]
    return imports.map_fields(t["compounds"], fields, "x")


@query("conform_table", "select cast(id as bigint) as id, cast(null as bigint) as category, nullif(name, '') as name, formula, try_cast(case when id % 3 = 0 then 'NA' else cast(fixedmass as varchar) end as double) as fixedmass, cast(null as bigint) as netcharge from compounds")
def _conform(t: Frames) -> DataFrame:
    raw = t["compounds"].select(F.col("id").cast("string").alias("id"), "name", "formula", F.when(F.col("id") % 3 == 0, "NA").otherwise(F.col("fixedmass").cast("string")).alias("fixedmass"))
    return schema.conform(raw, schema.TABLES["compounds"])


@query("integrity_problems", "select 'compound_fragments' as \"table\", 'annotated_fragment_id without annotated_fragments' as problem, count(*) as n from compound_fragments where annotated_fragment_id not in (select id from annotated_fragments where fragment_id % 9 > 0)")
def _problems(t: Frames) -> DataFrame:
    frames = {"compound_fragments": t["compound_fragments"], "annotated_fragments": t["annotated_fragments"].where("fragment_id % 9 > 0")}
    return schema.problems(frames).where(F.col("problem").like("% without %"))


@query("casrn_from_date", "select id, case when id % 3 = 0 then name else regexp_replace(strftime(date '1899-12-30' + cast(20000 + id * 13 as integer), '%Y-%m-%d'), '-0([0-9])$', '-\\1') end as casrn from compounds")
def _casrn_dates(t: Frames) -> DataFrame:
    raw = F.when(F.col("id") % 3 == 0, F.col("name")).otherwise((F.lit(20000) + F.col("id") * 13).cast("string"))
    return t["compounds"].select("id", chem.casrn_from_date(raw).alias("casrn"))


@query("padded_id", "select id, 'LIB' || lpad(cast(id as varchar), 6, '0') as code from compounds")
def _padded(t: Frames) -> DataFrame:
    return t["compounds"].select("id", text.padded_id(F.col("id"), "LIB").alias("code"))


@query("acronyms", "select id, upper(substr(name, 1, 1)) || upper(substr(smiles, 1, 1)) || case when contains(smiles, ' ') then upper(substr(split_part(smiles, ' ', 2), 1, 1)) else '' end as acronym from (select id, coalesce(smiles, 'x y') as smiles, formula as name from norm_fragments)")
def _acronyms(t: Frames) -> DataFrame:
    return t["norm_fragments"].select("id", text.acronym(F.concat_ws(" ", "formula", F.coalesce("smiles", F.lit("x y")))).alias("acronym"))


_QC = """with p as (select id as peak_id, fixedmass + radical * 0.003e0 as mz, fixedmass as calculated, id % 30 + 2 as c from norm_fragments),
    f as (select id as peak_id, id % 40 as n, id % 40 * 12e0 + (id % 5 - 2) * 0.0015e0 as measured from norm_fragments where id % 4 > 0),
    i as (
        select fragment_id as peak_id, fixedmass + (a.id % 5) * 0.002e0 - 0.004e0 as mz from annotated_fragments a join norm_fragments n on n.id = a.fragment_id
        union all select peak_id, measured + (peak_id % 3) * 0.0015e0 from f)
    select peak_id, 'measurederror' as parameter, round(1e6 * (mz - calculated) / calculated, 4) as value, abs(1e6 * (mz - calculated) / calculated) <= 3 as result from p
    union all select peak_id, 'ms1precursor_detected', null, exists (select 1 from i where i.peak_id = p.peak_id and abs(i.mz - p.mz) <= greatest(p.mz * 3e-6, 0.002)) from p
    union all select f.peak_id, 'annfragments_detected', round(measured, 4), exists (select 1 from i where i.peak_id = f.peak_id and abs(i.mz - measured) <= greatest(measured * 3e-6, 0.002)) from f
    union all select f.peak_id, 'annfragments_accuracy', round(1e6 * (measured - (12e0 * n)) / nullif(measured, 0), 4), abs(1e6 * (measured - 12e0 * n) / nullif(measured, 0)) <= 3 or abs(measured - 12e0 * n) <= 0.002 from f
    union all select f.peak_id, 'annfragments_subset', null, n <= c from f join p on p.peak_id = f.peak_id"""


@query("gather_qc", _QC)
def _gather_qc(t: Frames) -> DataFrame:
    """Masses with planted near misses: errors of 0 to 7 mDa about limits of 2 to 3."""
    x = t["norm_fragments"]
    peaks = x.select(F.col("id").alias("peak_id"), (F.col("fixedmass") + F.col("radical") * 0.003).alias("mz"), F.col("fixedmass").alias("calculated"), F.concat(F.lit("C"), (F.col("id") % 30 + 2).cast("string")).alias("formula"), F.lit(3.0).alias("msaccuracy"))
    n = F.col("id") % 40
    fragments = x.where("id % 4 > 0").select(F.col("id").alias("peak_id"), (n * 12.0 + (F.col("id") % 5 - 2) * 0.0015).alias("fragment_mz"), (n * 12.0).alias("fragment_calculated"), F.concat(F.lit("C"), n.cast("string")).alias("fragment_formula"))
    near = t["annotated_fragments"].select(F.col("id").alias("ion"), F.col("fragment_id").alias("peak_id")).join(x.select(F.col("id").alias("peak_id"), "fixedmass"), "peak_id")
    ions = near.select("peak_id", (F.col("fixedmass") + (F.col("ion") % 5) * 0.002 - 0.004).alias("mz")).unionByName(fragments.select("peak_id", (F.col("fragment_mz") + (F.col("peak_id") % 3) * 0.0015).alias("mz")))
    return qc.gathered(peaks, fragments, ions, ions, min_error=0.002).select("peak_id", "parameter", F.round("value", 4).alias("value"), "result")


@query("qc_rollup", f"with q as ({_QC}) select parameter, count(*) as n, count(*) filter (where result) as n_result, coalesce(bool_and(result), false) as passes from q group by parameter")
def _qc_rollup(t: Frames) -> DataFrame:
    return qc.rollup(_gather_qc(t), ["parameter"], ["result"])


@query("formula_match", "select id, id % 40 = 7 as same, case when id % 40 < 2 then null when id % 40 = 2 then '' when id % 40 = 3 then 'C' else 'C' || cast(id % 40 - 2 as varchar) end as less from norm_fragments")
def _formula_match(t: Frames) -> DataFrame:
    counts = chem.elements(F.concat(F.lit("C"), (F.col("id") % 40).cast("string")))
    less = chem.hill(chem.with_adduct(counts, "-C2"))
    return t["norm_fragments"].select("id", chem.is_match(counts, chem.elements(F.lit("HC7O2"))).alias("same"), less.alias("less"))


_CHART = "c as (select 'X' || chr(cast(97 + atomic_number as integer)) as symbol, exact_mass as mass, abundance from isotopes group by all)"


def _chart(t: Frames) -> DataFrame:
    symbol = F.concat(F.lit("X"), F.char(F.lit(97) + F.col("atomic_number")))
    return chem.mass_chart(t["isotopes"].select(symbol.alias("symbol"), "exact_mass", "abundance"))


@query("exact_mass_chart", f"with {_CHART} select symbol, count(*) as n, string_agg(cast(cast(round(mass * 100) as bigint) as varchar), ' ' order by abundance desc, mass) as masses from c group by symbol")
def _exact_mass_chart(t: Frames) -> DataFrame:
    masses = F.transform("isotopes", lambda x: F.round(x["mass"] * 100).cast("long").cast("string"))
    return _chart(t).select("symbol", F.size("isotopes").cast("long").alias("n"), F.array_join(masses, " ").alias("masses"))


@query(
    "chart_masses",
    f"""with {_CHART}, m as (select symbol, arg_min(mass, [-abundance, mass]) as main from c group by symbol)
    select f.id, f.formula, round(a.main * f.n + b.main, 6) as mass from (select id, 'X' || chr(cast(97 + id % 26 as integer)) || cast(id % 7 + 2 as varchar) || 'X' || chr(cast(97 + id // 26 % 25 as integer)) as formula,
        id % 7 + 2 as n, 'X' || chr(cast(97 + id % 26 as integer)) as x, 'X' || chr(cast(97 + id // 26 % 25 as integer)) as y from norm_fragments) f left join m a on a.symbol = x left join m b on b.symbol = y""",
)
def _chart_masses(t: Frames) -> DataFrame:
    """Formulas of two elements (or one twice) over a chart of 25; a 26th is unknown, and its formulas have no mass."""
    letter = lambda n: F.char(F.lit(97) + n)
    rows = t["norm_fragments"].select("id", F.concat(F.lit("X"), letter(F.col("id") % 26), (F.col("id") % 7 + 2).cast("string"), F.lit("X"), letter(F.floor(F.col("id") / 26) % 25)).alias("formula"))
    return chem.chart_masses(rows, "formula", _chart(t)).select("id", "formula", F.round("mass", 6).alias("mass"))


@query("score_summary", "select round(min(fixedmass), 6) as min, round(quantile_cont(fixedmass, 0.5), 6) as median, round(max(fixedmass), 6) as max, round(quantile_cont(fixedmass, 0.75) - quantile_cont(fixedmass, 0.25), 6) as iqr from compounds")
def _summary(t: Frames) -> DataFrame:
    return scoring.summary(t["compounds"], "fixedmass").select(*[F.round(c, 6).alias(c) for c in ("min", "median", "max", "iqr")])


# --- files -----------------------------------------------------------------------------------------------------------

#: Scans as mzML text: each event is a spectrum of its user's file.
TABLES["runs"] = """select event_id as id, user_id % 20 as run, row_number() over (partition by user_id % 20 order by event_id) as scan, event_type as kind, value as intensity, event_id % 3 as lack from events"""


def _mzml_text(t: Frames) -> DataFrame:
    """(run, scan, text) of spectra; the level is a number, times are in minutes or seconds, and some lack a base peak."""
    cv = lambda accession, name, value, unit="": F.concat(F.lit(f'<cvParam cvRef="MS" accession="{accession}" name="{name}" value="'), value, F.lit(f'"{unit}/>'))
    parts = [
        F.concat(F.lit('<spectrum index="'), (F.col("scan") - 1).cast("string"), F.lit('" id="scan='), F.col("scan").cast("string"), F.lit('">')),
        cv("MS:1000511", "ms level", F.when(F.col("kind") == "view", "1").otherwise("2")),
        F.when(F.col("lack") > 0, cv("MS:1000505", "base peak intensity", F.col("id").cast("string"))).otherwise(F.lit("")),
        F.lit('<scanList count="1"><scan>'), cv("MS:1000016", "scan start time", (F.col("scan") * 60).cast("string"), ' unitName="second"'), cv("MS:1000512", "filter string", F.concat(F.lit("FTMS &lt;"), F.col("kind"), F.lit("&gt;"))), F.lit("</scan></scanList></spectrum>"),
    ]
    return t["runs"].select("run", "scan", F.concat(*parts).alias("text"))


@query("mzml_scans", "select run, cast(scan as integer) as scan, case when kind = 'view' then 1 else 2 end as ms_n, cast(scan as double) as scantime, case when lack > 0 then cast(id as double) end as base_int from runs")
def _mzml_scans(t: Frames) -> DataFrame:
    """Spectra written as one mzML document a run, and read back by ranges of bytes."""
    rows = _mzml_text(t)
    folder = keys.shared_folder(rows.sparkSession, "mzml")
    rows.repartition("run").sortWithinPartitions("run", "scan").select("run", "text").write.partitionBy("run").text(folder)
    found = files.read_mzml(rows.sparkSession, folder)
    return found.select(F.regexp_extract("file", "run=([0-9]+)", 1).cast("long").alias("run"), "scan", "ms_n", "scantime", "base_int")


@query(
    "cv_parameters",
    """select run, scan, 'spectrum' as element, case when kind = 'view' then 1e0 else 2e0 end as level, case when lack > 0 then cast(id as double) end as base_intensity, cast(null as double) as start_time, cast(null as varchar) as filter from runs
    union all select run, scan, 'scan', null, null, scan * 60e0, 'FTMS <' || kind || '>' from runs""",
)
def _cv_parameters(t: Frames) -> DataFrame:
    wide = files.parameter_table(files.cv_parameters(_mzml_text(t), "run", "scan", "text"))
    names = {"ms level": "level", "base peak intensity": "base_intensity", "scan start time": "start_time", "filter string": "filter"}
    return wide.select(F.col("file").alias("run"), F.col("scan").cast("long").alias("scan"), "element", *[F.col(f"`{n}`").alias(a) for n, a in names.items()])


@query("msp_files", "select peak_id as name, row_number() over (order by peak_id) as place, count(*) as n_peaks, min(mz) as least, cast(sum(scan) as bigint) as intensity from (select l_orderkey as peak_id, l_extendedprice / l_quantity as mz, l_linenumber as scan from lines_all) group by peak_id")
def _msp_files(t: Frames) -> DataFrame:
    """All peaks' ions as MSP files, read back: the place of an entry over all files is that of its key."""
    ions = t["lines_all"].select(F.col("l_orderkey").alias("peak_id"), F.col("l_orderkey").cast("string").alias("name"), F.lit(100.5).alias("precursor"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("mz"), F.col("l_linenumber").alias("intensity"))
    folder = keys.shared_folder(ions.sparkSession, "msp")
    files.write_msp(ions, folder, "peak_id", "name", "precursor")
    found = files.read_msp(ions.sparkSession, folder)
    ordered = keys.numbered(found.withColumn("size", F.size("ions")), ["file", "place"], key="rank")
    total = F.aggregate("ions", F.lit(0.0), lambda a, x: a + x["intensity"]).cast("long")
    return ordered.select(F.col("name").cast("long").alias("name"), F.col("rank").alias("place"), F.col("n_peaks").cast("long").alias("n_peaks"), F.array_min(F.col("ions.mz")).alias("least"), total.alias("intensity"))


TABLES["clients"] = "select c_custkey as id, case when c_custkey % 7 = 0 then 'NA' when c_custkey % 7 = 1 then 'null' when c_custkey % 7 = 2 then '' when c_custkey % 7 = 3 then c_name || ', the \"first\"' else c_name end as name, c_acctbal as mass, c_nationkey as place from customer"


@query("csv_import", "select id, case when name not in ('NA', 'null', '') then name end as label, case when id % 3 > 0 then mass end as mass, case when id % 2 = 0 then cast(place as bigint) end as place from clients")
def _csv_import(t: Frames) -> DataFrame:
    """A table written as CSV files with null words and numbers that are none, read by position under other names."""
    wrong = lambda c, fits, word: F.when(fits, F.col(c).cast("string")).otherwise(word).alias(c)
    rows = t["clients"].select(F.col("id").cast("string").alias("id"), "name", wrong("mass", F.col("id") % 3 > 0, "n/a"), wrong("place", F.col("id") % 2 == 0, "NULL"))
    folder = keys.shared_folder(rows.sparkSession, "csv")
    rows.write.option("header", True).csv(folder)
    fields = (("id", T.LongType()), ("label", T.StringType()), ("mass", T.DoubleType()), ("place", T.LongType()))
    return files.read_table(rows.sparkSession, folder, T.StructType([T.StructField(*f) for f in fields]))


# --- streams ---------------------------------------------------------------------------------------------------------


def _scan_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of scans: the windows that its watermark has closed, written as files."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    scans = spark.readStream.schema(kind).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = keys.shared_folder(spark, "rates")
    rates = ingest.scan_rates(scans, "ts", "event_type")
    rates.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(rates.schema).parquet(f"{folder}/rows")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("intensity", 4).alias("intensity"))


QUERIES["scan_rates"] = _scan_rates
ORACLE_SQL["scan_rates"] = """select strftime(w, '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as intensity from (select *, date_trunc('minute', cast(ts as timestamp)) as w from events)
    where w + interval 1 minute <= (select max(cast(ts as timestamp)) from events) - interval 5 minutes group by w, event_type"""
