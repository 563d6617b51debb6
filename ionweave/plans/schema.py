"""Tables of a spectral library: columns, keys and checks, and what a set of frames violates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.operators import relational


@dataclass(frozen=True)
class TableDef:
    """A table's columns as DDL, with key, unique columns, foreign keys (column, table, key, on delete) and checks (SQL predicates)."""

    name: str
    ddl: str
    key: str | None = None
    unique: tuple[str, ...] = ()
    links: tuple[tuple[str, str, str, str], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


_DIMENSION = "id long not null, name string not null"


def _dimension(name: str) -> TableDef:
    return TableDef(name, _DIMENSION, "id", ("name",))


#: The tables that the searches and views need; others are added with a TableDef of their own.
TABLES: dict[str, TableDef] = {
    t.name: t
    for t in (
        *map(_dimension, ("norm_sample_classes", "norm_ion_states", "norm_generation_type", "affiliations", "norm_analyte_alias_references")),
        TableDef("elements", "atomic_number long not null, symbol string not null, common_name string not null", "atomic_number", ("symbol",)),
        TableDef("isotopes", "atomic_number long not null, exact_mass double not null, abundance double not null", None, (), (("atomic_number", "elements", "atomic_number", "cascade"),), {"abundance": "abundance between 0 and 1", "mass": "exact_mass > 0"}),
        TableDef("contributors", "id long not null, username string not null, contact string, first_name string, last_name string, affiliation long not null, orcid string", "id", ("username",), (("affiliation", "affiliations", "id", "restrict"),), {"orcid": "orcid rlike '^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$'"}),
        TableDef("samples", "id long not null, mzml_name string not null, description string not null, sample_class_id long not null, sample_contributor long not null, generation_type long not null, generated_on timestamp_ntz not null, ms_methods_id long", "id", (), (("sample_class_id", "norm_sample_classes", "id", "restrict"), ("sample_contributor", "contributors", "id", "restrict"), ("generation_type", "norm_generation_type", "id", "restrict"))),
        TableDef("peaks", "id long not null, sample_id long not null, num_points long not null, precursor_mz double not null, ion_state long not null, rt_start double not null, rt_centroid double not null, rt_end double not null, identification_confidence long", "id", (), (("sample_id", "samples", "id", "cascade"), ("ion_state", "norm_ion_states", "id", "restrict"))),
        TableDef("ms_data", "id long not null, peak_id long not null, ms_n long not null, scantime double not null, base_ion double, base_int double not null, measured_mz string not null, measured_intensity string not null", "id", ("peak_id", "ms_n", "scantime", "base_ion", "base_int", "measured_mz", "measured_intensity"), (("peak_id", "peaks", "id", "cascade"),), {"time": "scantime >= 0", "base": "base_int >= 0", "level": "ms_n > 0 and ms_n < 9"}),
        TableDef("ms_spectra", "ms_data_id long not null, mz double not null, intensity double not null", None, ("ms_data_id", "mz", "intensity"), (("ms_data_id", "ms_data", "id", "cascade"),), {"mz": "mz > 0", "intensity": "intensity >= 0"}),
        TableDef("norm_fragments", "id long not null, fixedmass double, netcharge long, formula string not null, radical long, smiles string", "id", ("fixedmass", "netcharge", "formula", "radical", "smiles"), (), {"radical": "radical in (0, 1)", "formula": "formula rlike '^[A-Za-z0-9]*$'"}),
        TableDef("annotated_fragments", "id long not null, mz double not null, fragment_id long not null", "id", (), (("fragment_id", "norm_fragments", "id", "cascade"),)),
        TableDef("fragment_sources", "annotated_fragments_id long not null, generation_type long not null, citation string not null", None, ("annotated_fragments_id", "generation_type", "citation"), (("annotated_fragments_id", "annotated_fragments", "id", "cascade"),)),
        TableDef("compounds", "id long not null, category long, name string not null, formula string not null, fixedmass double not null, netcharge long not null", "id"),
        TableDef("compound_aliases", "compound_id long not null, alias_type long not null, alias string not null", None, ("compound_id", "alias_type", "alias"), (("compound_id", "compounds", "id", "cascade"), ("alias_type", "norm_analyte_alias_references", "id", "restrict"))),
        TableDef("compound_fragments", "peak_id long, compound_id long, annotated_fragment_id long", None, (), (("peak_id", "peaks", "id", "set null"), ("compound_id", "compounds", "id", "set null"), ("annotated_fragment_id", "annotated_fragments", "id", "set null"))),
        TableDef("opt_ums_params", "peak_id long not null, mslevel long not null, correl double, ph double, freq double, n long, masserror double, minerror double", None, ("peak_id", "mslevel"), (("peak_id", "peaks", "id", "cascade"),)),
        TableDef("qc_data", "peak_id long not null, applies_to string not null, parameter string not null, name string not null, value string not null", None, ("peak_id", "applies_to", "parameter", "name"), (("peak_id", "peaks", "id", "cascade"),)),
    )
}


def dictionary(tables: dict[str, TableDef] = TABLES) -> list[dict]:
    """Table, column, type and whether null is allowed, for each column."""
    return [{"table": t.name, "column": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for t in tables.values() for f in t.schema]


def reference_map(tables: dict[str, TableDef] = TABLES) -> dict[str, list[tuple[str, str, str]]]:
    """For each table, (column, table, key) of what it refers to."""
    return {t.name: [link[:3] for link in t.links] for t in tables.values()}


def conform(df: DataFrame, table: TableDef) -> DataFrame:
    """df with the table's columns in order and types; text that doesn't parse, blanks and missing columns become null."""

    def column(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = dict(df.dtypes)[f.name] == "string"
        value = F.when(~F.upper(F.trim(F.col(f.name))).isin("", "NULL", "NA"), F.col(f.name)) if text else F.col(f.name)
        return value.try_cast(f.dataType).alias(f.name)

    return df.select(*map(column, table.schema))


def problems(frames: dict[str, DataFrame], tables: dict[str, TableDef] = TABLES) -> DataFrame:
    """(table, problem, n): rows that lack a required value, fail a check, repeat a key or unique columns, or refer to nothing."""
    found = []

    def add(table: str, problem: str, rows: DataFrame) -> None:
        found.append(rows.agg(F.count("*").alias("n")).select(F.lit(table).alias("table"), F.lit(problem).alias("problem"), "n"))

    for name, df in frames.items():
        t = tables[name]
        checks = {f"{f.name} is null": F.col(f.name).isNotNull() for f in t.schema if not f.nullable}
        checks |= {f"check {k}": F.expr(v) for k, v in t.checks.items()}
        for k, c in checks.items():
            add(name, k, df.where(~c))
        for columns in filter(None, ((t.key,) if t.key else (), t.unique)):
            add(name, f"repeated {', '.join(columns)}", relational.repeated(df, list(columns)))
        for column, parent, key, _ in t.links:
            if parent in frames:
                add(name, f"{column} without {parent}", relational.orphans(df, column, frames[parent], key))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.where("n > 0")


def delete(frames: dict[str, DataFrame], table: str, gone: DataFrame, tables: dict[str, TableDef] = TABLES) -> dict[str, DataFrame]:
    """Frames after rows of a table are deleted, with what that entails by the links' actions."""
    links = [(t.name, column, parent, key, action) for t in tables.values() if t.name in frames for column, parent, key, action in t.links]
    return relational.delete_cascade(frames, table, gone, links)
