"""Mobile phases of an import: pattern-named settings to carriers, additives and phases, one mix for each set of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.operators.keys import keyed, staged
from ionweave.operators.relational import append_new
from ionweave.plans import imports

#: Settings of a phase: mp, its number (the first digit; all digits tell its components apart), and the name of the setting.
PATTERN = "^mp*([0-9])([0-9]*)(.*)$"
NOTHING = ("none", "")
FIELDS = {
    "carrier": {"solvent": "component", "fraction": "fraction"},
    "additive": {"add": "component", "add_amount": "amount", "add_units": "units"},
    "mobile_phase": {"flow": "flow", "flowunits": "flow_units", "duration": "duration", "durationunits": "duration_units"},
}


def settings(rows: DataFrame, column: str = "chromatography") -> DataFrame:
    """(sample_id, ms_methods_id, phase, place) with a column for each setting: the filled pattern-named entries of a map."""
    entries = rows.select("sample_id", "ms_methods_id", F.explode(column).alias("key", "value"))
    entries = entries.where(F.col("key").rlike(PATTERN) & ~F.lower(F.trim("value")).isin(*NOTHING))
    part = lambda k: F.regexp_extract("key", PATTERN, k)
    entries = entries.select("sample_id", "ms_methods_id", part(1).cast("int").alias("phase"), F.concat(part(1), part(2)).cast("int").alias("place"), part(3).alias("name"), F.trim("value").alias("value"))
    names = [n for family in FIELDS.values() for n in family]
    return entries.groupBy("sample_id", "ms_methods_id", "phase", "place").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def named(values: DataFrame, column: str, norm: DataFrame, aliases: DataFrame | None = None, alias_key: str = "id", add: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """(distinct values of a column with their id, grown norm, grown aliases, rejects): by alias, else by any text of norm, else as a new name.

    Case doesn't matter.  A value that several names share is rejected, as is an
    unknown one without ``add``; aliases grow by every value that was none.
    """
    text = F.lower(F.trim(F.col(column)))
    distinct = values.where(text != "").groupBy(text.alias("value")).agg(F.min(F.trim(F.col(column))).alias("shown"))
    if aliases is not None:
        by_alias = aliases.groupBy(F.lower(F.trim("alias")).alias("_alias")).agg(F.min(alias_key).alias("alias_id"))
        distinct = distinct.join(by_alias, F.col("value") == F.col("_alias"), "left").drop("_alias")
    else:
        distinct = distinct.withColumn("alias_id", F.lit(None).cast("long"))
    found, lost = imports.resolve(distinct, "value", norm)
    found = staged(found.join(lost.select(F.col("value").alias("_lost"), "matches"), F.col("value") == F.col("_lost"), "left").drop("_lost"))
    rejected = found.where("alias_id is null and matches > 1").select("value", F.lit("ambiguous").alias("problem"))
    open_ = found.where("alias_id is null and value_id is null and matches = 0")
    grown = norm
    if add:
        added, grown = keyed(norm.withColumnRenamed("id", "_id"), open_.select(F.col("shown").alias("name"), "value"), ["name"], "_id")
        grown = grown.withColumnRenamed("_id", "id")
        found = found.join(added.select(F.col("value").alias("_value"), F.col("_id").alias("_new")), F.col("value") == F.col("_value"), "left").drop("_value")
    else:
        rejected = rejected.unionByName(open_.select("value", F.lit("unknown").alias("problem")))
        found = found.withColumn("_new", F.lit(None).cast("long"))
    found = found.select("value", "shown", F.coalesce("alias_id", "value_id", "_new").alias("id"), "alias_id")
    if aliases is not None:
        more = found.where("alias_id is null and id is not null").select(F.col("id").alias(alias_key), F.col("shown").alias("alias"))
        aliases = append_new(aliases, more, [alias_key, "alias"])
    return found.select("value", "id"), grown, aliases, rejected


def _with_id(rows: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    own = ids.select(F.col("value").alias("_value"), F.col("id").alias(name))
    return rows.join(own, F.lower(F.trim(F.col(column))) == F.col("_value"), "left").drop("_value")


def mix_key(carriers: DataFrame, additives: DataFrame, by: list[str]) -> DataFrame:
    """(by, mix_key): a hash of the sorted set of a mix's components with their amounts; equal for mixes of the same components."""

    def part(*columns: str) -> Column:
        return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))

    rows = carriers.select(*by, F.concat(F.lit("c"), part("component", "fraction")).alias("part"))
    rows = rows.unionByName(additives.select(*by, F.concat(F.lit("a"), part("component", "amount", "units")).alias("part")))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("part")), "\n"), 256).alias("mix_key"))


def resolve_mobile_phases(rows: DataFrame, peaks: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(grown tables, rejects) of the mobile phases of samples.

    rows: sample_id, ms_methods_id and chromatography (a map); peaks: sample_id
    and peak_id.  Fractions above 1 are percents.  A mix is the set of its
    carriers and additives with their amounts: one that the tables have, or that
    occurs twice, is used again, and each phase refers to it for every peak of
    its sample.  Carriers and additives that aren't known are added with their
    alias; units aren't, and are left null and rejected.
    """
    out = dict(tables)
    found = staged(settings(rows))
    carriers = found.where("solvent is not null").withColumn("fraction", F.col("fraction").try_cast("double"))
    carriers = carriers.withColumn("fraction", F.when(F.col("fraction") > 1, F.col("fraction") / 100).otherwise(F.col("fraction")))
    ids, out["norm_carriers"], out["carrier_aliases"], bad = named(carriers, "solvent", tables["norm_carriers"], tables["carrier_aliases"], "carrier_id")
    rejects = bad.withColumn("kind", F.lit("carrier"))
    carriers = _with_id(carriers, "solvent", ids, "component")
    additives = found.where("`add` is not null")
    ids, out["norm_additives"], out["additive_aliases"], bad = named(additives, "add", tables["norm_additives"], tables["additive_aliases"], "additive_id")
    rejects = rejects.unionByName(bad.withColumn("kind", F.lit("additive")))
    additives = _with_id(additives, "add", ids, "component")
    phases = found.groupBy("sample_id", "ms_methods_id", "phase").agg(*[F.max(n).alias(c) for n, c in FIELDS["mobile_phase"].items()])
    unit_columns = [("additives", "add_units", "units", "norm_additive_units"), ("phases", "flow_units", "flow_unit_id", "norm_flow_units"), ("phases", "duration_units", "duration_unit_id", "norm_duration_units")]
    frames = {"additives": additives, "phases": phases}
    for frame, column, name, norm in unit_columns:
        ids, _, _, bad = named(frames[frame], column, tables[norm], add=False)
        rejects = rejects.unionByName(bad.withColumn("kind", F.lit(norm)))
        frames[frame] = _with_id(frames[frame], column, ids, name)
    by = ["sample_id", "ms_methods_id", "phase"]
    carriers = carriers.where("component is not null").select(*by, "component", "fraction")
    additives = frames["additives"].where("component is not null").select(*by, "component", F.col("add_amount").try_cast("double").alias("amount"), "units")
    known = mix_key(tables["carrier_mixes"], tables["carrier_additives"], ["mix_id"]).groupBy("mix_key").agg(F.max("mix_id").alias("id"))
    top = tables["carrier_mix_collections"].agg(F.max("id").alias("id")).select(F.lit(None).cast("string").alias("mix_key"), "id")
    known = known.unionByName(top.where("id is not null"))
    wanted = staged(mix_key(carriers, additives, by))
    keys, _ = keyed(known, wanted, ["mix_key"], order=["sample_id", "phase"])
    keys = staged(keys.withColumnRenamed("id", "mix_id"))
    new = keys.join(known.where("mix_key is not null").select(F.col("id").alias("mix_id")), "mix_id", "left_anti")
    first = new.groupBy("mix_id").agg(F.min(F.struct("sample_id", "phase", "ms_methods_id")).alias("f"))
    first = staged(first.select("mix_id", "f.sample_id", "f.phase", "f.ms_methods_id"))
    name = F.concat(F.lit("method_"), F.coalesce(F.col("ms_methods_id").cast("string"), F.lit("none")), F.lit("_sample_"), F.col("sample_id").cast("string"), F.lit("_carrier_"), F.col("phase").cast("string"))
    out["carrier_mix_collections"] = tables["carrier_mix_collections"].unionByName(first.select(F.col("mix_id").alias("id"), name.alias("name")), allowMissingColumns=True)
    own = first.drop("ms_methods_id")
    out["carrier_mixes"] = tables["carrier_mixes"].unionByName(carriers.join(own, ["sample_id", "phase"]).select("mix_id", "component", "fraction").distinct())
    out["carrier_additives"] = tables["carrier_additives"].unionByName(additives.join(own, ["sample_id", "phase"]).select("mix_id", "component", "amount", "units").distinct())
    rows = frames["phases"].join(keys.select("sample_id", "phase", F.col("mix_id").alias("carrier_mix_collection_id")), ["sample_id", "phase"]).join(peaks, "sample_id")
    rows = rows.select("ms_methods_id", "sample_id", "peak_id", "carrier_mix_collection_id", F.col("flow").try_cast("double").alias("flow"), F.col("flow_unit_id").alias("flow_units"), F.col("duration").try_cast("double").alias("duration"), F.col("duration_unit_id").alias("duration_units"))
    out["mobile_phases"] = append_new(tables["mobile_phases"], rows, rows.columns)
    return out, rejects.select("kind", "value", "problem")
