"""Views of acquisition methods: analyzers, chromatography, mobile phases, and a sentence on each method.

Joined names follow the order of the names, so results don't depend on the order
of rows; where a group has one row of many to show, it is the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.operators import relational

Frames = dict[str, DataFrame]


def _joined(column: Column, separator: str, distinct: bool = False) -> Column:
    """Aggregate: the texts in their order with a separator between."""
    return F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(column)), separator)


def _named(dim: DataFrame, name: str, *columns: str) -> DataFrame:
    """A dimension's columns as name_column beside its key, called name."""
    return dim.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def mass_analyzers(t: Frames) -> DataFrame:
    types = t["norm_ms_types"].select(F.col("id").alias("ms_types_id"), "acronym", "name")
    return t["ms_descriptions"].select("ms_methods_id", "ms_types_id").join(types, "ms_types_id").select("ms_methods_id", "acronym", "name")


def chromatography_types(t: Frames) -> DataFrame:
    types = t["norm_chromatography_types"].select(F.col("id").alias("chromatography_types_id"), "acronym", "name")
    return t["chromatography_descriptions"].select("ms_methods_id", "chromatography_types_id").join(types, "chromatography_types_id").select("ms_methods_id", "acronym", "name")


def _shown(amount: Column, text: Column) -> Column:
    return F.when(amount.isNull(), F.lit("")).otherwise(text)


def carrier_mix(t: Frames) -> DataFrame:
    """Carriers of each mix with their percentage, as text; blank where the fraction is unknown."""
    rows = relational.decode(t["carrier_mixes"], {"component": (t["norm_carriers"], "id", "name")})
    x = F.col("fraction")
    return rows.select("mix_id", "component", _shown(x, (x * 100).cast("string")).alias("amount"), _shown(x, F.lit("percent")).alias("unit_name"), _shown(x, F.lit("%")).alias("unit"))


def carrier_additives(t: Frames) -> DataFrame:
    """Additives of each mix with amount and unit, as text; blank where the amount is unknown."""
    rows = relational.decode(t["carrier_additives"], {"component": (t["norm_additives"], "id", "name")})
    rows = rows.join(_named(t["norm_additive_units"], "units", "name", "abbreviation"), "units", "left")
    x = F.col("amount")
    return rows.select("mix_id", "component", _shown(x, x.cast("string")).alias("amount"), _shown(x, F.col("units_name")).alias("unit_name"), _shown(x, F.col("units_abbreviation")).alias("unit"))


def carrier_mix_collection(t: Frames) -> DataFrame:
    """Carriers and additives of each collection, each once."""
    rows = carrier_mix(t).withColumn("component_type", F.lit("carrier")).union(carrier_additives(t).withColumn("component_type", F.lit("additive"))).distinct()
    own = t["carrier_mix_collections"].select(F.col("id"), "name")
    return own.join(rows, F.col("id") == F.col("mix_id")).select("id", "name", "component", "component_type", "amount", "unit")


def _listed(mixes: DataFrame, name: str) -> DataFrame:
    """(mix_id, name): "component (amount unit)" of each, with a slash between; no brackets around nothing."""
    part = F.concat("component", F.lit(" ("), "amount", F.lit(" "), "unit", F.lit(")"))
    return mixes.groupBy("mix_id").agg(F.replace(F.replace(_joined(part, ","), F.lit(","), F.lit(" / ")), F.lit(" ( )"), F.lit("")).alias(name))


def mobile_phase_narrative(t: Frames) -> DataFrame:
    """What flows, how long and how fast, for each mobile phase; a mix is told only if it has additives."""
    mixes = _listed(carrier_additives(t), "additives").join(_listed(carrier_mix(t), "carriers"), "mix_id", "left")
    rows = t["mobile_phases"].join(mixes, F.col("carrier_mix_collection_id") == F.col("mix_id"), "left")
    rows = rows.join(_named(t["norm_duration_units"], "duration_units", "abbreviation"), "duration_units", "left").join(_named(t["norm_flow_units"], "flow_units", "abbreviation"), "flow_units", "left")

    def after(prefix: str, c: str, suffix: str = "") -> Column:
        text = F.col(c).cast("string")
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(prefix), text, F.lit(suffix)))

    both = F.when((F.coalesce("carriers", F.lit("")) != "") & (F.coalesce("additives", F.lit("")) != ""), " with ").otherwise("")
    told = F.concat(after("", "carriers"), both, after("", "additives", " amendment"), after(" for ", "duration"), after(" ", "duration_units_abbreviation"), after(" at ", "flow"), after(" ", "flow_units_abbreviation"))
    return rows.select("ms_methods_id", "sample_id", "peak_id", told.alias("narrative"))


def detectors(t: Frames) -> DataFrame:
    return mass_analyzers(t).groupBy("ms_methods_id").agg(F.replace(_joined(F.col("name"), ","), F.lit(","), F.lit(" ")).alias("detectors"))


def column_chemistries(t: Frames) -> DataFrame:
    rows = t["chromatography_descriptions"].join(_named(t["norm_column_positions"], "column_position_id", "name"), "column_position_id").join(_named(t["norm_column_chemistries"], "column_chemistry_id", "name"), "column_chemistry_id")
    each = F.concat_ws(" ", "column_chemistry_id_name", "column_position_id_name", F.lit("column"))
    return rows.groupBy("ms_methods_id").agg(F.replace(_joined(each, ",", True), F.lit(","), F.lit(" with ")).alias("columns"))


def separation_types(t: Frames, analytical: int = 2) -> DataFrame:
    """Vendors and models of each method's chromatographs, and the types of its analytical columns."""
    rows = t["chromatography_descriptions"]
    types = rows.where(F.col("column_position_id") == analytical).join(_named(t["norm_chromatography_types"], "chromatography_types_id", "acronym"), "chromatography_types_id", "left")
    types = types.groupBy("ms_methods_id").agg(F.replace(_joined(F.col("chromatography_types_id_acronym"), ","), F.lit(","), F.lit(" x ")).alias("chrom_type"))
    rows = relational.decode(rows, {"system_vendor_id": (t["norm_vendors"], "id", "name")})
    many = lambda c: F.replace(_joined(F.col(c), ",", True), F.lit(","), F.lit(" x "))
    return rows.groupBy("ms_methods_id").agg(many("system_vendor_id").alias("chrom_vendor"), many("system_vendor_model").alias("chrom_model")).join(types, "ms_methods_id", "left")


def method(t: Frames) -> DataFrame:
    """One row for each method with all its names; of several mass spectrometers the one that comes first by name."""
    rows = t["ms_methods"].select("id", "ionization", "polarity", "voltage", "voltage_units", "ce_value", "ce_units", "ce_desc", "fragmentation")
    for column, dim, fields in (
        ("ionization", "norm_ionization", ("acronym",)), ("polarity", "norm_polarity_types", ("name",)), ("voltage_units", "norm_voltage_units", ("name",)),
        ("ce_units", "norm_ce_units", ("name",)), ("fragmentation", "norm_fragmentation_types", ("acronym", "name")), ("ce_desc", "norm_ce_desc", ("name",)),
    ):
        rows = rows.join(_named(t[dim], column, *fields), column, "left")
    vendor = relational.decode(t["ms_descriptions"].select("ms_methods_id", "vendor_id", "vendor_model"), {"vendor_id": (t["norm_vendors"], "id", "name")})
    vendor = vendor.groupBy(F.col("ms_methods_id").alias("id")).agg(F.min("vendor_id").alias("mass_spectrometer_vendor"), F.min("vendor_model").alias("mass_spectrometer_model"))
    rows = rows.join(vendor, "id", "left")
    for other in (separation_types(t), detectors(t), column_chemistries(t)):
        rows = rows.join(other.withColumnRenamed("ms_methods_id", "id"), "id", "left")
    return rows.select(
        "id", F.col("chrom_vendor").alias("chromatography_system_vendor"), F.col("chrom_model").alias("chromatograph_model"), F.col("chrom_type").alias("chromatographic_type"), "mass_spectrometer_vendor", "mass_spectrometer_model",
        F.col("detectors").alias("detector"), "columns", F.col("fragmentation_acronym"), F.col("fragmentation_name"), F.col("polarity_name").alias("polarity"), F.col("ionization_acronym").alias("ionization"),
        F.concat(F.col("voltage").cast("string"), F.lit(" "), "voltage_units_name").alias("voltage"), F.concat(F.col("ce_value").cast("string"), F.lit(" "), "ce_units_name").alias("collision_energy"), F.col("ce_desc_name").alias("collision_energy_description"),
    )


def method_narrative(t: Frames) -> DataFrame:
    """A sentence on each method; null where a part of it is unknown."""
    parts = ["Measured by ", "chromatographic_type", " (", "chromatography_system_vendor", ") ", "detector", " MS (", "mass_spectrometer_vendor", "), separated by ", "columns", " in ", "polarity", " ", "ionization", " mode at ", "voltage", " and ",
             "collision_energy_description", " fragmentation by ", "fragmentation_acronym", " (", "fragmentation_name", ") at ", "collision_energy", "."]
    rows = method(t)
    return rows.select("id", F.concat(*[F.col(p) if p in rows.columns else F.lit(p) for p in parts]).alias("narrative"))
