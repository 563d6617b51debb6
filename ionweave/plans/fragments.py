"""Annotated fragments of an import: identities, annotations, sources, inspections and aliases, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.functions import chem
from ionweave.operators.keys import keyed, staged
from ionweave.operators.relational import append_new

IDENTITY = ["fixedmass", "netcharge", "formula", "radical", "smiles"]
_PARTS = ["mz", "formula", "smiles", "radical", "netcharge", "fixedmass", "citation"]


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))


def typed_parts(rows: DataFrame) -> DataFrame:
    """rows with typed identities: blanks are null, radical is 0 or 1."""
    flag = F.lower(_text("radical"))
    return rows.withColumns(
        {
            "mz": _text("mz").try_cast("double"),
            "fixedmass": _text("fixedmass").try_cast("double"),
            "netcharge": _text("netcharge").try_cast("long"),
            "radical": F.when(flag.isin("true", "t", "1"), 1).when(flag.isin("false", "f", "0"), 0).cast("long"),
            "formula": _text("formula"),
            "smiles": _text("smiles"),
            "citation": _text("citation"),
        }
    )


def identified(rows: DataFrame) -> DataFrame:
    """Typed rows in which a mass that is missing or 0 is that of the formula, calculated once for each formula."""
    lacking = F.coalesce("fixedmass", F.lit(0.0)) == 0
    masses = rows.where(lacking & F.col("formula").isNotNull()).select(F.col("formula").alias("_formula")).distinct()
    masses = staged(masses.withColumn("_mass", F.round(chem.mass(chem.elements(F.col("_formula"))), 6)), "masses")
    return rows.join(masses, F.col("formula") == F.col("_formula"), "left").withColumn("fixedmass", F.when(lacking, F.col("_mass")).otherwise(F.col("fixedmass"))).drop("_formula", "_mass")


def resolve_fragments(rows: DataFrame, tables: dict[str, DataFrame], inspections: DataFrame | None = None, aliases: DataFrame | None = None, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(rows with fragment_id and annotated_fragment_id, grown tables, rejects) of an import's fragments.

    rows: object, number, mz, formula, smiles, radical, netcharge, fixedmass,
    citation (texts) and generation_type (a key).  A fragment of which fewer than
    two parts are filled is no fragment; one without m/z or formula is rejected.
    Identities and annotations that the tables have keep their ids, nulls
    compared as equal; the others get new ones in order.  Sources, inspections
    (object, smiles and further columns) and aliases (object, smiles, alias_type,
    alias) are added once, so a second run adds nothing.  keep: the columns that
    the rows come back with (all of them, if not given); object, smiles, citation
    and generation_type have to be among them.
    """
    filled = reduce(Column.__add__, [_text(c).isNotNull().cast("int") for c in _PARTS])
    # counted in a column: as a filter, it would be pushed below rows and take each text out of its section many times
    typed = staged(typed_parts(rows.withColumn("_filled", filled))).where("_filled > 1").drop("_filled")
    bad = typed.where("mz is null or formula is null")
    rejected = bad.select("object", "number", F.when(F.col("mz").isNull(), "no m/z").otherwise("no formula").alias("problem"))
    good = identified(typed.where("mz is not null and formula is not null"))
    found, norm = keyed(tables["norm_fragments"], good, IDENTITY)
    found = found.withColumnRenamed("id", "fragment_id")
    found = found.select(*keep, "fragment_id", "mz") if keep else found
    found, annotated = keyed(tables["annotated_fragments"], found, ["fragment_id", "mz"])
    found = staged(found.withColumnRenamed("id", "annotated_fragment_id"))
    sources = found.where("citation is not null and generation_type is not null").select(F.col("annotated_fragment_id").alias("annotated_fragments_id"), "generation_type", "citation")
    out = {"norm_fragments": norm, "annotated_fragments": annotated, "fragment_sources": append_new(tables["fragment_sources"], sources, ["annotated_fragments_id", "generation_type", "citation"])}
    named = found.where("smiles is not null").select(F.col("object").alias("_o"), F.col("smiles").alias("_s"), "fragment_id", "annotated_fragment_id").distinct()
    if inspections is not None:
        own = inspections.join(named, (F.col("object") == F.col("_o")) & (F.col("smiles") == F.col("_s")))
        own = own.select(*[F.col("annotated_fragment_id" if c == "annotated_fragments_id" else c).alias(c) for c in tables["fragment_inspections"].columns if c != "id"])
        out["fragment_inspections"] = append_new(tables["fragment_inspections"], own, own.columns)
    if aliases is not None:
        own = aliases.join(named, (F.col("object") == F.col("_o")) & (F.col("smiles") == F.col("_s")))
        types = tables["norm_analyte_alias_references"].select(F.col("id").alias("_type"), F.lower("name").alias("_name"))
        own = own.join(types, F.lower("alias_type") == F.col("_name"))
        bare = F.regexp_replace(F.trim("alias"), "^(InChI=)+", "")
        alias = F.when(F.lower("alias_type") == "inchi", F.concat(F.lit("InChI="), bare)).otherwise(F.trim("alias"))
        own = own.where(F.trim("alias") != "").select("fragment_id", F.col("_type").alias("alias_type"), alias.alias("alias"))
        out["fragment_aliases"] = append_new(tables["fragment_aliases"], own, ["fragment_id", "alias_type", "alias"])
    return found, out, rejected
