"""A whole import as set operations: objects to samples, methods, peaks, spectra, mobile phases, compounds, fragments and their links.

Every step takes all objects at once.  Rows that tables have already keep their
ids, so importing the same objects again changes nothing.  Objects are written
once, with a number each; steps shuffle numbers, keys and the one section that
they read, never whole objects, and what objects of a run share (sample, method,
chromatography) is resolved once for all of them.  Steps that several others
read are written to the shared folder; ``ImportStore`` keeps the tables
themselves as folders of Parquet with one commit for each import.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.operators.keys import keyed, same, staged
from ionweave.operators.relational import append_new
from ionweave.plans import fragments, imports, mobile_phases, objects

_DIMENSION = "id long, name string"
#: Tables of an import that an empty library starts with, as DDL; lookups have further text columns where a library has them.
SCHEMAS: dict[str, str] = {
    **dict.fromkeys(
        ("norm_sample_classes", "norm_generation_type", "norm_ion_states", "norm_ionization", "norm_voltage_units", "norm_polarity_types", "norm_ce_units", "norm_ce_desc", "norm_fragmentation_types", "norm_ms_n_types", "norm_ms_types", "norm_vendors", "norm_chromatography_types", "norm_column_chemistries", "norm_column_positions", "norm_carriers", "norm_additives", "norm_additive_units", "norm_flow_units", "norm_duration_units", "norm_analyte_alias_references", "norm_qc_methods_name"),
        _DIMENSION,
    ),
    "contributors": "id long, username string, contact string, first_name string, last_name string",
    "ms_methods": "id long, ionization long, voltage double, voltage_units long, polarity long, ce_value string, ce_desc long, ce_units long, fragmentation long, ms2_type long, has_qc_method long",
    "ms_descriptions": "ms_methods_id long, ms_types_id long, vendor_id long, vendor_model string, reference string",
    "chromatography_descriptions": "ms_methods_id long, chromatography_types_id long, system_vendor_id long, system_vendor_model string, column_chemistry_id long, column_position_id long, column_vendor_id long, column_vendor_model string, internal_diameter double, column_length double, particle_diameter double, citation string",
    "samples": "id long, mzml_name string, description string, sample_class_id long, source_citation string, sample_contributor long, generation_type long, generated_on timestamp_ntz, ms_methods_id long",
    "sample_aliases": "sample_id long, name string, reference string",
    "conversion_software_peaks_linkage": "id long, sample_id long, generated_on timestamp_ntz",
    "conversion_software_settings": "linkage_id long, setting_value string",
    "peaks": "id long, sample_id long, conversion_software_peaks_linkage_id long, num_points long, precursor_mz double, ion_state long, rt_start double, rt_centroid double, rt_end double, identification_confidence string",
    "ms_data": "id long, peak_id long, ms_n long, scantime double, base_ion double, base_int double, measured_mz string, measured_intensity string",
    "opt_ums_params": "peak_id long, mslevel long, correl double, ph double, freq double, n long, masserror double, minerror double",
    "instrument_properties": "peak_id long, name string, value string, value_unit string",
    "qc_methods": "peak_id long, name long, value string, citation string",
    "qc_data": "peak_id long, applies_to string, parameter string, name string, value string",
    "carrier_aliases": "carrier_id long, alias string",
    "additive_aliases": "additive_id long, alias string",
    "carrier_mix_collections": "id long, name string",
    "carrier_mixes": "mix_id long, component long, fraction double",
    "carrier_additives": "mix_id long, component long, amount double, units long",
    "mobile_phases": "ms_methods_id long, sample_id long, peak_id long, carrier_mix_collection_id long, flow double, flow_units long, duration double, duration_units long",
    "compounds": "id long, name string, formula string, fixedmass double, netcharge long",
    "compound_aliases": "compound_id long, alias_type long, alias string",
    "norm_fragments": "id long, fixedmass double, netcharge long, formula string, radical long, smiles string",
    "annotated_fragments": "id long, mz double, fragment_id long",
    "fragment_sources": "annotated_fragments_id long, generation_type long, citation string",
    "fragment_inspections": "annotated_fragments_id long, user_note string",
    "fragment_aliases": "fragment_id long, alias_type long, alias string",
    "compound_fragments": "peak_id long, compound_id long, annotated_fragment_id long",
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()}


@dataclass
class Imported:
    """Grown tables; objects with their ids (object, sample_id, ms_methods_id, peak_id, compound_id); what was rejected (object, step, value)."""

    tables: dict[str, DataFrame]
    objects: DataFrame
    rejects: DataFrame


def _of(section: str | Column, key: str) -> Column:
    """A filled value of a section, else null."""
    return F.nullif(F.trim(F.try_element_at(F.col(section) if isinstance(section, str) else section, F.lit(key))), F.lit(""))


def _number(section: str | Column, key: str, kind: str = "double") -> Column:
    return _of(section, key).try_cast(kind)


def _map(text: str) -> Column:
    """The map of a text that objects.canonical made."""
    return F.map_from_entries(F.from_json(text, "array<struct<key:string,value:string>>"))


class _Run:
    """One import: the tables so far, and what has been rejected."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables, self.rejects = dict(tables), []

    def rejected(self, rows: DataFrame, step: str, value: Column, of: DataFrame | None = None) -> None:
        """Lists rows by their object; of: the objects that rows stand for, by all of its other columns."""
        if of is not None:
            on = [c for c in of.columns if c != "object"]
            rows = rows.join(of.select("object", *[F.col(c).alias(f"_of_{c}") for c in on]), same("", "_of_", on))
        self.rejects.append(rows.select("object", F.lit(step).alias("step"), value.alias("value")))

    def looked_up(self, rows: DataFrame, column: str, name: str, table: str, step: str, of: DataFrame | None = None) -> DataFrame:
        """rows with ``name``: the key of a column's text in a lookup table; rows whose text has no key of its own are listed by their object."""
        out, _ = imports.resolve(rows, column, self.tables[table])
        out = out.withColumnRenamed(f"{column}_id", "_id")
        self.rejected(out.where(F.col("_id").isNull() & F.col(column).isNotNull()), step, F.col(column), of)
        return out.withColumn(name, F.col("_id")).drop("_id")

    def named(self, rows: DataFrame, columns: dict[str, tuple[str, str]], step: str, of: DataFrame | None = None) -> DataFrame:
        """rows with text columns replaced by keys; columns: {column: (text column, lookup table)}."""
        for name, (column, table) in columns.items():
            rows = self.looked_up(rows, column, name, table, f"{step}.{name}", of)
        return rows.drop(*[c for c, _ in columns.values() if c not in columns])

    def add(self, table: str, rows: DataFrame, unique: list[str] | None = None) -> None:
        """Rows that a table without ids lacks."""
        columns = [c for c in self.tables[table].columns if c in rows.columns]
        typed = rows.select(*[F.col(c).cast(self.tables[table].schema[c].dataType).alias(c) for c in columns])
        self.tables[table] = append_new(self.tables[table], typed, unique or columns)

    def add_keyed(self, table: str, rows: DataFrame, name: str) -> DataFrame:
        """rows with the key that they have or get in a table, all of whose columns they bring."""
        on = [c for c in self.tables[table].columns if c != "id"]
        typed = rows.withColumns({c: F.col(c).cast(self.tables[table].schema[c].dataType) for c in on})
        out, self.tables[table] = keyed(self.tables[table], typed, on)
        return out.withColumnRenamed("id", name)


#: Sections that objects of one run have in common, as a rule.
SHARED = ("sample", "chromatography", "massspectrometry", "sample_aliases")


def _shared() -> list[Column]:
    """What objects share: their maps as sorted entries, settings, and whether a QC method was used."""
    used = F.filter("qcmethod", lambda q: q["name"].contains("QC Method Used"))
    flag = F.lower(F.try_element_at(F.get(used, 0), F.lit("value")))
    flag = F.when(flag.isin("true", "1"), 1).when(flag.isin("false", "0"), 0)
    return [*[F.sort_array(F.map_entries(c)).alias(c) for c in SHARED], F.col("msconvertsettings"), flag.alias("has_qc_method")]


def _distinct_objects(import_objects: DataFrame) -> DataFrame:
    """One row for each object, with its number (_row) and a hash of what it shares (_key); only names are compared."""
    key = F.unhex(F.sha2(F.to_json(F.struct(*_shared())), 256))
    rows = staged(import_objects.withColumns({"_row": F.monotonically_increasing_id(), "_key": key}), "objects")
    again = staged(rows.groupBy("object").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("object").alias("_again"), "_first"), "repeats")
    if again.isEmpty():
        return rows
    rows = rows.join(again, F.col("object").eqNullSafe(F.col("_again")), "left")
    return staged(rows.where("_first is null or _row = _first").drop("_again", "_first"), "objects")


def _groups(rows: DataFrame) -> DataFrame:
    """What objects share, once for all that agree in it; mass spectrometry as a text."""
    groups = rows.select("_key", *_shared()).distinct()
    return staged(groups.withColumns({c: F.to_json(c) if c == "massspectrometry" else F.map_from_entries(c) for c in SHARED}), "groups")


def _methods(run: _Run, groups: DataFrame, members: DataFrame) -> DataFrame:
    """groups with ms_methods_id, and the methods' descriptions: one for each mass analyzer, one for each column that isn't "none".

    Settings are looked up once for all objects that share them; what is rejected is listed for the first of these.
    members: object and _key.
    """
    spec = {"ionization": "ionization", "voltage_units": "vunits", "polarity": "polarity", "ce_desc": "ce_desc", "ce_units": "ce_units", "fragmentation": "fragmode", "ms2_type": "ms2exp"}
    lookups = {"ionization": "norm_ionization", "voltage_units": "norm_voltage_units", "polarity": "norm_polarity_types", "ce_desc": "norm_ce_desc", "ce_units": "norm_ce_units", "fragmentation": "norm_fragmentation_types", "ms2_type": "norm_ms_n_types"}
    own = groups.where("massspectrometry is not null")
    first = members.join(own, "_key").groupBy("massspectrometry", "has_qc_method").agg(F.min("object").alias("object"))
    each = own.select("massspectrometry", "has_qc_method").distinct().withColumn("s", _map("massspectrometry"))
    each = each.select("*", *[_of("s", v).alias(f"_{k}") for k, v in spec.items()], _number("s", "voltage").alias("voltage"), _of("s", "ce_value").alias("ce_value"))
    each = staged(run.named(each, {k: (f"_{k}", lookups[k]) for k in spec}, "method", first))
    each = staged(run.add_keyed("ms_methods", each, "ms_methods_id"), "ms_methods")
    _analyzers(run, each, first)
    ids = each.select(F.col("massspectrometry").alias("_ms"), F.col("has_qc_method").alias("_qc"), "ms_methods_id")
    out = groups.join(ids, (F.col("massspectrometry") == F.col("_ms")) & F.col("has_qc_method").eqNullSafe(F.col("_qc")), "left").drop("_ms", "_qc")
    own = out.where("ms_methods_id is not null and chromatography is not null").select("_key", "ms_methods_id", objects.canonical(F.col("chromatography")).alias("_columns"))
    first = members.join(own, "_key").groupBy("ms_methods_id", "_columns").agg(F.min("object").alias("object"))
    _columns(run, own.select("ms_methods_id", "_columns").distinct().withColumn("s", _map("_columns")), first)
    return out


def _analyzers(run: _Run, rows: DataFrame, first: DataFrame) -> None:
    analyzer = F.explode(F.filter(F.map_entries("s"), lambda e: e["key"].contains("massanalyzer") & (F.trim(e["value"]) != "")))
    each = rows.select("massspectrometry", "has_qc_method", "ms_methods_id", analyzer.alias("e"), _of("s", "msvendor").alias("_vendor"), _of("s", "msmodel").alias("vendor_model"), _of("s", "source").alias("reference"))
    each = each.withColumn("_type", F.trim("e.value"))
    each = run.named(each, {"ms_types_id": ("_type", "norm_ms_types"), "vendor_id": ("_vendor", "norm_vendors")}, "mass analyzer", first)
    run.add("ms_descriptions", each.where("ms_types_id is not null"))


def _columns(run: _Run, rows: DataFrame, first: DataFrame) -> None:
    """Guard and analytical columns: the first's settings have a g before their names."""
    fields = {"_chemistry": "colchemistry", "_vendor": "colvendor", "column_vendor_model": "colname", "internal_diameter": "colid", "column_length": "collen", "particle_diameter": "coldp"}
    kinds = [F.struct(F.lit(position).alias("_position"), *[_of("s", prefix + v).alias(k) for k, v in fields.items()]) for prefix, position in (("g", "guard"), ("", "analytical"))]
    shared = [_of("s", "ctype").alias("_type"), _of("s", "cvendor").alias("_system"), _of("s", "cmodel").alias("system_vendor_model"), _of("s", "source").alias("citation")]
    each = rows.select("ms_methods_id", "_columns", *shared, F.explode(F.array(*kinds)).alias("c")).select("*", "c.*").drop("c")
    each = each.where(F.lower("_chemistry") != "none").withColumn("_vendor", F.when(F.lower("_vendor") != "none", F.col("_vendor")))
    each = each.withColumns({c: F.col(c).try_cast("double") for c in ("internal_diameter", "column_length", "particle_diameter")})
    lookups = {"chromatography_types_id": ("_type", "norm_chromatography_types"), "system_vendor_id": ("_system", "norm_vendors"), "column_chemistry_id": ("_chemistry", "norm_column_chemistries"), "column_position_id": ("_position", "norm_column_positions"), "column_vendor_id": ("_vendor", "norm_vendors")}
    run.add("chromatography_descriptions", run.named(each, lookups, "chromatography", first))


def _samples(run: _Run, groups: DataFrame, generation_type: str, members: DataFrame) -> DataFrame:
    """(_key, sample_id, ms_methods_id, generation_type, conversion_software_peaks_linkage_id) of groups; those whose contributor isn't known go no further."""
    own = groups.select("_key", "ms_methods_id", _of("sample", "data_generator").alias("_contributor"), _of("sample", "sample_class").alias("_class"), F.coalesce(_of("sample", "generation_type"), F.lit(generation_type)).alias("_generation"), _of("sample", "name").alias("mzml_name"), _of("sample", "description").alias("description"), _of("sample", "source").alias("source_citation"), *[_of("sample", k).try_cast("timestamp_ntz").alias(v) for k, v in (("starttime", "generated_on"), ("converted_on", "_converted"))])
    run.rejected(own.where("_contributor is null"), "sample.sample_contributor", F.lit(None).cast("string"), members)
    own = run.named(own, {"sample_contributor": ("_contributor", "contributors"), "sample_class_id": ("_class", "norm_sample_classes"), "generation_type": ("_generation", "norm_generation_type")}, "sample", members)
    own = run.add_keyed("samples", staged(own.where("sample_contributor is not null")), "sample_id")
    own = staged(own.select("_key", "sample_id", "ms_methods_id", "generation_type", F.col("_converted").alias("generated_on")), "samples")
    own = staged(run.add_keyed("conversion_software_peaks_linkage", own, "conversion_software_peaks_linkage_id").drop("generated_on"), "samples")
    aliases = groups.where("sample_aliases is not null").join(own, "_key").select("sample_id", F.explode("sample_aliases").alias("name", "reference"))
    run.add("sample_aliases", aliases.where("trim(name) <> ''"))
    converted = groups.where("msconvertsettings is not null").select("_key", "msconvertsettings").join(own, "_key")
    run.add("conversion_software_settings", converted.select(F.col("conversion_software_peaks_linkage_id").alias("linkage_id"), F.explode("msconvertsettings").alias("setting_value")).where("trim(setting_value) <> ''"))
    return own


def _peaks(run: _Run, rows: DataFrame, samples: DataFrame) -> DataFrame:
    """(_row, object, peak_id, sample_id, ms_methods_id, generation_type, compound_id, _lone) of the objects whose sample is known; _lone: without an annotation that counts."""
    first = F.filter("msdata", lambda x: _of(x, "measured_mz").isNotNull() & (F.try_element_at(x, F.lit("ms_n")).try_cast("int") == 1))
    annotated = F.exists("annotation", lambda x: _number(x, "fragment_mz").isNotNull() & _of(x, "fragment_formula").isNotNull())
    numbers = {"precursor_mz": "mz", "rt_start": "peak_starttime", "rt_centroid": "rt", "rt_end": "peak_endtime"}
    own = rows.select("_row", "object", "_key", *[_number("peak", v).alias(k) for k, v in numbers.items()], F.greatest(F.size(first), F.lit(0)).alias("num_points"), _of("peak", "confidence").alias("identification_confidence"), _of("peak", "ionstate").alias("_ion"), objects.canonical(F.col("compounddata")).alias("_compound"), (~F.coalesce(annotated, F.lit(False))).alias("_lone"))
    own = staged(run.named(own.join(samples, "_key").drop("_key"), {"ion_state": ("_ion", "norm_ion_states")}, "peak"), "peaks")
    compounds = _compounds(run, own.select("object", "_compound"))
    out = run.add_keyed("peaks", own, "peak_id").join(compounds, "_compound", "left")
    return staged(out.select("_row", "object", "peak_id", "sample_id", "ms_methods_id", "generation_type", "compound_id", "_lone"), "peaks")


def _details(run: _Run, rows: DataFrame, peaks: DataFrame, held: set[str]) -> None:
    """Spectra, parameters, instrument properties and QC rows of peaks; held: sections that any object has."""
    ids = peaks.select("_row", "object", "peak_id")

    def each(section: str | Column, *columns: Column, only: str | Column = "true") -> DataFrame:
        """Columns of each of a section's entries x; nothing else of it is shuffled."""
        return rows.select("_row", F.explode(section).alias("x")).where(only).select("_row", *columns).join(ids, "_row").drop("_row")

    if "msdata" in held:
        ms = each("msdata", _number("x", "ms_n", "long").alias("ms_n"), *[_number("x", c).alias(c) for c in ("scantime", "base_ion", "base_int")], *[_of("x", c).alias(c) for c in ("measured_mz", "measured_intensity")], only=F.trim(F.try_element_at("x", F.lit("measured_mz"))) != "")
        _, run.tables["ms_data"] = keyed(run.tables["ms_data"], ms, [c for c in run.tables["ms_data"].columns if c != "id"])
    names = ("isowidth", "msaccuracy", "msminerror", "ms1resolution", "ms2resolution")
    properties = F.array(*[F.struct(F.lit(n).alias("name"), _of("massspectrometry", n).alias("value")) for n in names])
    unit = F.when(F.col("name") == "isowidth", "Da").when(F.col("name") == "msaccuracy", "ppm").alias("value_unit")
    run.add("instrument_properties", each(properties, F.col("x.name"), F.col("x.value"), only="x.value is not null").select("peak_id", "name", "value", unit), ["peak_id", "name"])
    if "opt_ums_params" in held:
        table = run.tables["opt_ums_params"]
        found = each("opt_ums_params", *[_of("x", c).try_cast(table.schema[c].dataType).alias(c) for c in table.columns if c != "peak_id"])
        run.add("opt_ums_params", found.where("mslevel is not null"), ["peak_id", "mslevel"])
    if "qcmethod" in held:
        found = each("qcmethod", _of("x", "name").alias("_name"), _of("x", "value").alias("value"), _of("x", "source").alias("citation"))
        run.add("qc_methods", run.named(found, {"name": ("_name", "norm_qc_methods_name")}, "qc method").where("name is not null"), ["peak_id", "name"])
    if "qc" in held:
        found = each("qc", F.coalesce(_of("x", "applies_to"), F.lit("peak")).alias("applies_to"), *[_of("x", c).alias(c) for c in ("parameter", "name", "value")])
        run.add("qc_data", found.where("parameter is not null and name is not null and value is not null"), ["peak_id", "applies_to", "parameter", "name"])


def _compounds(run: _Run, members: DataFrame) -> DataFrame:
    """(_compound, compound_id) of compound data: by the aliases that name it (the compound of most of them), else by name and formula, else new.

    members: object and _compound, the text of its compound data.
    """
    sections = staged(members.select("_compound").where("_compound is not null").distinct().withColumn("compounddata", _map("_compound")))
    name = _of("compounddata", "NAME")
    own = sections.select("_compound", F.explode(F.split(name, ";")).alias("_part")).withColumn("_name", F.lower(F.trim("_part"))).where("_name <> ''")
    known = run.tables["compound_aliases"].select("compound_id", F.lower(F.trim("alias")).alias("_name")).unionByName(run.tables["compounds"].select(F.col("id").alias("compound_id"), F.lower(F.trim("name")).alias("_name")))
    votes = own.join(known.distinct(), "_name").groupBy("_compound", "compound_id").agg(F.count("*").alias("n"))
    tied = votes.groupBy("_compound", "n").agg(F.count("*").alias("ties"), F.min("compound_id").alias("_found"))
    best = tied.groupBy("_compound").agg(F.max(F.struct("n", "ties", "_found")).alias("b")).select("_compound", "b.ties", "b._found")
    named = sections.where(name.isNotNull()).join(best, "_compound", "left")
    named = staged(named.select("_compound", "ties", "_found", F.trim(F.get(F.split(name, ";"), 0)).alias("name"), _of("compounddata", "FORMULA").alias("formula"), F.round(_number("compounddata", "FIXEDMASS"), 6).alias("fixedmass"), F.coalesce(_number("compounddata", "NETCHARGE", "long"), F.lit(0).cast("long")).alias("netcharge")))
    run.rejected(named.where("ties > 1").select("_compound"), "compound", F.lit("names of several compounds"), members)
    fresh, run.tables["compounds"] = keyed(run.tables["compounds"], named.where("_found is null"), ["name", "formula", "fixedmass", "netcharge"])
    ids = staged(fresh.select("_compound", F.col("id").alias("compound_id")).unionByName(named.where("ties = 1").select("_compound", F.col("_found").alias("compound_id"))))
    kinds = run.tables["norm_analyte_alias_references"].select(F.col("id").alias("alias_type"), F.upper("name").alias("_kind"))
    each = ids.withColumn("compounddata", _map("_compound"))
    entries = each.select("compound_id", F.explode("compounddata").alias("_kind", "alias")).withColumns({"_kind": F.upper("_kind"), "alias": F.trim("alias")})
    names = each.select("compound_id", F.lit("NAME").alias("_kind"), F.explode(F.split(name, ";")).alias("alias")).withColumn("alias", F.trim("alias"))
    run.add("compound_aliases", entries.where("_kind <> 'NAME'").unionByName(names).where("alias <> ''").join(kinds, "_kind").select("compound_id", "alias_type", "alias"))
    return ids


def _fragments(run: _Run, rows: DataFrame, peaks: DataFrame, held: set[str]) -> DataFrame:
    """(peak_id, compound_id, annotated_fragment_id) of the annotations."""
    names = {c: f"fragment_{c}" for c in ("mz", "formula", "radical", "netcharge", "fixedmass", "citation")} | {"smiles": "fragment_SMILES"}
    each = rows.select("_row", F.posexplode("annotation").alias("number", "x")).select("_row", "number", *[_of("x", v).alias(k) for k, v in names.items()])
    each = each.join(peaks.select("_row", "peak_id", "compound_id", "generation_type"), "_row").withColumnRenamed("_row", "object")
    seen = entries = None
    if "inspections" in held:
        seen = rows.select(F.col("_row").alias("object"), F.explode("inspections").alias("x")).select("object", _of("x", "smiles").alias("smiles"), _of("x", "user_note").alias("user_note")).where("user_note is not null")
    if "fragment_aliases" in held:
        entries = rows.select(F.col("_row").alias("object"), F.explode("fragment_aliases").alias("x")).select("object", _of("x", "SMILES").alias("smiles"), F.explode("x").alias("alias_type", "alias")).where("upper(alias_type) <> 'SMILES'")
    found, tables, bad = fragments.resolve_fragments(each, run.tables, seen, entries, ["object", "peak_id", "compound_id", "generation_type", "citation", "smiles"])
    run.tables |= tables
    bad = bad.withColumnRenamed("object", "_row").join(peaks.select("_row", "object"), "_row")
    run.rejects.append(bad.select("object", F.concat(F.lit("fragment["), F.col("number").cast("string"), F.lit("]")).alias("step"), F.col("problem").alias("value")))
    return found.select("peak_id", "compound_id", "annotated_fragment_id")


def full_import(import_objects: DataFrame, tables: dict[str, DataFrame], generation_type: str = "empirical") -> Imported:
    """All tables grown by import objects (objects.OBJECT, one peak each, told apart by ``object``).

    An object lacks only its sample's contributor to be rejected as a whole; other
    texts that no lookup has, or several rows of one, become null and are listed.
    Objects that repeat another, and those imported before, add no rows.
    """
    run = _Run(tables)
    rows = _distinct_objects(import_objects)
    sections = rows.agg(*[F.max(F.size(c) > 0).alias(c) for c in objects.LISTS]).first()
    held = {c for c in objects.LISTS if sections[c]}
    members = rows.select("object", "_key")
    groups = _methods(run, _groups(rows), members)
    samples = _samples(run, groups, generation_type, members)
    peaks = _peaks(run, rows, samples)
    _details(run, rows, peaks, held)
    phases = groups.where("chromatography is not null").select("_key", "chromatography").join(samples, "_key").select("sample_id", "ms_methods_id", "chromatography")
    run.tables, bad = mobile_phases.resolve_mobile_phases(phases, peaks.select("sample_id", "peak_id"), run.tables)
    run.rejects.append(bad.select(F.lit(None).cast("string").alias("object"), F.concat(F.lit("mobile phase: "), "kind").alias("step"), "value"))
    found = _fragments(run, rows, peaks, held)
    lone = peaks.where("_lone").select("peak_id", "compound_id", F.lit(None).cast("long").alias("annotated_fragment_id"))
    links = found.unionByName(lone)
    run.add("compound_fragments", imports.ternary_links(links, links.columns))
    rejects = run.rejects[0]
    for more in run.rejects[1:]:
        rejects = rejects.unionByName(more)
    return Imported(run.tables, peaks.select("object", "sample_id", "ms_methods_id", "peak_id", "compound_id"), rejects.distinct())


class ImportStore:
    """Tables as Parquet below a folder: one version for each import, and a list of the versions that are complete.

    An import writes all tables of its version before the version is listed, so a
    reader never sees half of one, and an import that broke off is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str] = SCHEMAS):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def versions(self) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/complete")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []

    def tables(self) -> dict[str, DataFrame]:
        """The tables of the last complete version; empty ones before the first."""
        done = self.versions()
        if not done:
            return {name: self.spark.createDataFrame([], ddl) for name, ddl in self.schemas.items()}
        return {name: self.spark.read.schema(T.StructType.fromDDL(ddl)).parquet(f"{self.path}/{done[-1]}/{name}") for name, ddl in self.schemas.items()}

    def save(self, tables: dict[str, DataFrame]) -> str:
        """Writes a version and lists it; returns its name."""
        done = self.versions()
        version = f"v{int(done[-1][1:]) + 1 if done else 1:09d}"
        for name, ddl in self.schemas.items():
            schema = T.StructType.fromDDL(ddl)
            tables[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(f"{self.path}/{version}/{name}")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        mark = hadoop.Path(f"{self.path}/complete/{version}")
        mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(mark)
        return version

    def load(self, import_objects: DataFrame, generation_type: str = "empirical") -> Imported:
        """full_import into the last version, written as the next."""
        out = full_import(import_objects, self.tables(), generation_type)
        self.save(out.tables)
        return out
