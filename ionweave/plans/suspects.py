"""Suspect lists: identifiers out of their texts, identities over shared identifiers, and the rows that a library lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.functions import chem
from ionweave.operators.components import components
from ionweave.operators.keys import keyed, staged
from ionweave.operators.relational import append_new

#: Columns of a list that are identifiers by their names.
IDENTIFIERS = ("CASRN", "DTXSID", "DTXCID", "INCHIKEY", "INCHI", "SMILES")
_ENTRY = r"([A-Za-z][A-Za-z0-9_]*):([^;]*)"


def harvested(rows: DataFrame, key: str, additional: str) -> DataFrame:
    """(key, kind, value) of "KIND:value;" entries in a text column; kinds in capitals, blanks left out."""
    pairs = F.arrays_zip(F.regexp_extract_all(additional, F.lit(_ENTRY), 1).alias("k"), F.regexp_extract_all(additional, F.lit(_ENTRY), 2).alias("v"))
    out = rows.select(key, F.explode(pairs).alias("p")).select(key, F.upper("p.k").alias("kind"), F.trim("p.v").alias("value"))
    return out.where("value <> ''")


def identifiers(rows: DataFrame, key: str, additional: str | None = "ADDITIONAL", columns: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """(key, kind, value): all identifiers of the rows of a list, from their columns and from the additional text, once each.

    Entries of other kinds, such as notes, identify nothing and are left out.  A CAS number that was taken for a date is turned back; one whose check digit
    is wrong is left out.
    """
    have = [c for c in columns if c in rows.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.trim(F.col(c).cast("string")).alias("value")) for c in have]).cast("array<struct<kind:string,value:string>>")
    entries = rows.select(key, F.explode(pairs).alias("p")).select(key, "p.kind", "p.value")
    if additional and additional in rows.columns:
        entries = entries.unionByName(harvested(rows, key, additional).where(F.col("kind").isin(*columns)))
    registry = F.col("kind") == "CASRN"
    entries = entries.withColumn("value", F.when(registry, chem.casrn(chem.casrn_from_date(F.col("value")))).otherwise(F.col("value")))
    return entries.where("value <> '' and upper(value) <> 'NA'").distinct()


def extend(suspects: DataFrame, compounds: DataFrame, aliases: DataFrame, references: DataFrame, key: str = "number", additional: str | None = "ADDITIONAL") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(suspects with compound_id, grown compounds, grown aliases, conflicts) for a list (key, NAME, FORMULA, identifiers).

    Rows that share an identifier, also through others, are one compound; one
    that shares an identifier with a known compound is that compound.  Groups
    that meet several known compounds, or hold several formulas, are conflicts:
    their rows get no id and are listed as (key, problem).  A new compound has
    the name, formula, mass and charge of its first row (by key) that is filled.
    references: (id, name) of the kinds of identifiers that aliases may have.
    """
    own = staged(identifiers(suspects, key, additional), "identifiers")
    kinds = references.select(F.col("id").alias("alias_type"), F.upper("name").alias("kind"))
    known = aliases.join(kinds, "alias_type").select("kind", F.trim("alias").alias("value"), "compound_id").distinct()
    # the rows of an identifier hang on its first: links grow with the rows, not with their pairs
    first = own.groupBy("kind", "value").agg(F.min(key).alias("_first"))
    links = own.join(first, ["kind", "value"]).select(F.col(key).alias("a"), F.col("_first").alias("b"))
    groups = suspects.select(F.col(key).alias("_key")).join(components(links), F.col("_key") == F.col("node"), "left").select("_key", F.coalesce("label", "_key").alias("group"))
    groups = staged(groups, "groups")
    met = own.join(known, ["kind", "value"]).join(groups, F.col(key) == F.col("_key")).groupBy("group").agg(F.countDistinct("compound_id").alias("n_known"), F.min("compound_id").alias("known_id"))
    rows = suspects.join(groups, F.col(key) == F.col("_key")).drop("_key")
    formula = F.nullif(F.trim("FORMULA"), F.lit(""))
    formulas = rows.groupBy("group").agg(F.countDistinct(formula).alias("n_formulas"))
    state = groups.select("group").distinct().join(met, "group", "left").join(formulas, "group", "left")
    problem = F.when(F.col("n_known") > 1, "several known compounds").when(F.col("n_formulas") > 1, "several formulas")
    state = staged(state.select("group", F.when(problem.isNull(), F.col("known_id")).alias("known_id"), problem.alias("problem")), "state")
    conflicts = rows.join(state.where("problem is not null"), "group").select(key, "problem")
    good = rows.join(state.where("problem is null"), "group").drop("problem")

    def filled(c: str, kind: str):
        value = F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast(kind) if c in suspects.columns else F.lit(None).cast(kind)
        return F.min_by(value, F.when(value.isNotNull(), F.col(key))).alias(c.lower())

    new = good.where("known_id is null").groupBy("group").agg(filled("NAME", "string"), filled("FORMULA", "string"), filled("FIXEDMASS", "double"), filled("NETCHARGE", "long"))
    mass = F.round(chem.mass(chem.elements(F.col("formula"))), 6)
    new = new.withColumns({"fixedmass": F.coalesce("fixedmass", mass), "netcharge": F.coalesce("netcharge", F.lit(0).cast("long"))})
    # the group tells new compounds of one name apart, and gives their order
    wide = compounds.withColumn("group", F.lit(None).cast(groups.schema["group"].dataType))
    ids, _ = keyed(wide, new.select("group"), ["group"])
    ids = staged(ids.select("group", F.col("id").alias("new_id")), "ids")
    grown = compounds.unionByName(new.join(ids, "group").select(F.col("new_id").alias("id"), "name", "formula", "fixedmass", "netcharge"), allowMissingColumns=True)
    found = good.join(ids, "group", "left").withColumn("compound_id", F.coalesce("known_id", "new_id")).drop("group", "known_id", "new_id")
    more = own.join(found.select(key, "compound_id"), key).join(kinds, "kind").select("compound_id", "alias_type", F.col("value").alias("alias"))
    return found, grown, append_new(aliases, more, ["compound_id", "alias_type", "alias"]), conflicts
