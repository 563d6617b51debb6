"""Decoded and summarised views over the tables of a spectral library; each takes a dictionary of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions import chem, text
from ionweave.operators import keys, relational, spectra

Frames = dict[str, DataFrame]


def element_isotopes(t: Frames) -> DataFrame:
    """Isotopes with their element, named by rounded mass and symbol."""
    rows = t["isotopes"].join(t["elements"], "atomic_number")
    return rows.select("atomic_number", "symbol", F.concat(F.round("exact_mass").cast("int").cast("string"), "symbol").alias("isotope"), "exact_mass", "abundance")


def exact_masses(t: Frames) -> DataFrame:
    """The most abundant isotopes of each element, ties included."""
    return relational.keep_ties_of_max(element_isotopes(t), ["atomic_number"], "abundance")


def annotated_fragments(t: Frames) -> DataFrame:
    rows = t["annotated_fragments"].alias("a").join(t["norm_fragments"].alias("f"), F.col("a.fragment_id") == F.col("f.id"))
    return rows.select("a.id", "a.mz", "a.fragment_id", "f.formula", "f.fixedmass", "f.netcharge", "f.radical", "f.smiles", chem.ppm_error(F.col("a.mz"), F.col("f.fixedmass")).alias("ppm_error"))


def compound_fragments(t: Frames) -> DataFrame:
    """Links of peaks, compounds and annotated fragments, by m/z."""
    return _linked(t).orderBy("mz")


def _linked(t: Frames) -> DataFrame:
    """compound_fragments in any order; links meet their annotations before the texts of fragments and compounds."""
    tasks = keys.tasks_for(t["compound_fragments"])
    ids = t["annotated_fragments"].select(F.col("id").alias("annotated_fragment_id"), "mz", "fragment_id")
    rows = keys.dealt(t["compound_fragments"], tasks, "annotated_fragment_id").join(ids, "annotated_fragment_id").alias("a")
    f = keys.dealt(t["norm_fragments"], tasks, "id").alias("f")
    c = keys.dealt(t["compounds"].select(F.col("id").alias("compound_id"), F.col("name").alias("compound"), F.col("formula").alias("compound_formula")), tasks, "compound_id")
    rows = rows.join(f, F.col("a.fragment_id") == F.col("f.id"))
    rows = rows.select("a.*", "f.formula", "f.fixedmass", "f.netcharge", "f.radical", "f.smiles", chem.ppm_error(F.col("a.mz"), F.col("f.fixedmass")).alias("ppm_error"))
    return rows.join(c, "compound_id")


def fragment_mz_stats(t: Frames) -> DataFrame:
    """For each fragment: number, least, mean and largest m/z of its annotations, counted once for each link."""
    links = t["compound_fragments"].select(F.col("annotated_fragment_id").alias("id"))
    rows = annotated_fragments(t).join(links, "id", "left")
    return rows.groupBy("fragment_id").agg(F.min("formula").alias("formula"), F.min("fixedmass").alias("fixedmass"), F.count("mz").alias("n"), F.min("mz").alias("mz_min"), F.avg("mz").alias("mz_mean"), F.max("mz").alias("mz_max"))


def compound_fragment_stats(t: Frames) -> DataFrame:
    """For each compound and fragment: measured m/z, and their spread about the fragment's mean over all compounds."""
    means = fragment_mz_stats(t).select("fragment_id", F.col("mz_mean").alias("_mean"))
    rows = _linked(t).join(means, "fragment_id")
    off = F.sum(F.pow(F.col("mz") - F.col("_mean"), F.lit(2.0)))
    return rows.groupBy("compound_id", "compound", "fragment_id", "formula").agg(F.count("mz").alias("n"), F.min("mz").alias("mz_min"), F.avg("mz").alias("mz_mean"), F.max("mz").alias("mz_max"), F.sqrt(F.try_divide(off, F.count("mz") - 1)).alias("mz_sd"))


def fragment_count(t: Frames) -> DataFrame:
    """Distinct fragment formulas of each compound formula, most first."""
    return _linked(t).groupBy("compound_formula").agg(F.min("compound").alias("name"), F.countDistinct("formula").alias("n")).orderBy(F.desc("n"), "compound_formula")


def contributors(t: Frames) -> DataFrame:
    """Contributors of samples, but for the first account, with the number of their samples."""
    rows = t["contributors"].alias("c").join(t["affiliations"].alias("a"), F.col("c.affiliation") == F.col("a.id")).join(t["samples"].alias("s"), F.col("s.sample_contributor") == F.col("c.id"))
    name = F.when(F.col("c.first_name").isNull() | F.col("c.last_name").isNull(), F.col("c.username")).otherwise(F.concat_ws(" ", "c.first_name", "c.last_name"))
    return rows.where("c.id <> 1").groupBy(F.col("c.id").alias("id"), name.alias("name"), F.col("a.name").alias("affiliation")).agg(F.count("*").alias("samples"))


def samples(t: Frames) -> DataFrame:
    return relational.decode(t["samples"], {"sample_class_id": (t["norm_sample_classes"], "id", "name"), "generation_type": (t["norm_generation_type"], "id", "name"), "sample_contributor": (t["contributors"], "id", "username")})


def sample_narratives(t: Frames) -> DataFrame:
    """A sentence on each sample; null where a part of it is unknown."""
    rows = samples(t)
    kind = F.lower("sample_class_id")
    return rows.select("id", F.concat(F.lit("Sample "), F.col("mzml_name"), F.lit(" is "), text.article(kind), kind, F.lit(" sample ("), F.col("description"), F.lit("), generated by "), F.col("sample_contributor"), F.lit(" on "), F.date_format("generated_on", "yyyy-MM-dd"), F.lit(".")).alias("narrative"))


def peaks(t: Frames) -> DataFrame:
    return relational.decode(t["peaks"], {"ion_state": (t["norm_ion_states"], "id", "name")})


def peak_data(t: Frames, unpack: bool = True) -> DataFrame:
    """Scans of peaks with precursor and level, and with the ions as an array where asked for."""
    rows = t["peaks"].select(F.col("id").alias("peak_id"), "precursor_mz", "rt_centroid").join(t["ms_data"], "peak_id").withColumn("level", F.concat(F.lit("MS"), F.col("ms_n").cast("string")))
    if not unpack:
        return rows
    return rows.withColumn("ions", spectra.unpack(F.col("measured_mz"), F.col("measured_intensity"))).drop("measured_mz", "measured_intensity")


def peak_spectra(t: Frames) -> DataFrame:
    """One row for each ion of peak_data; scans with an unknown value are left out."""
    return spectra.tidy(peak_data(t), "ions")


def mass_errors(t: Frames) -> DataFrame:
    """The accuracy (ppm) reported for each peak, joined on the peak."""
    own = t["qc_data"].where("name = 'msaccuracy'").groupBy("peak_id").agg(F.min(F.col("value").try_cast("double")).alias("msaccuracy"))
    return t["peaks"].select(F.col("id").alias("peak_id"), "precursor_mz").join(own, "peak_id")


def compound_urls(t: Frames, patterns: dict[str, str]) -> DataFrame:
    """Aliases with a link: patterns has, by reference name, a text in which {} stands for the alias."""
    rows = t["compound_aliases"].alias("x").join(t["norm_analyte_alias_references"].alias("r"), F.col("x.alias_type") == F.col("r.id")).join(t["compounds"].alias("c"), F.col("x.compound_id") == F.col("c.id"))
    url = F.lit(None).cast("string")
    for name, pattern in patterns.items():
        before, _, after = pattern.partition("{}")
        url = F.when(F.col("r.name").ilike(name), F.concat(F.lit(before), F.replace(F.col("x.alias"), F.lit("#"), F.lit("%23")), F.lit(after))).otherwise(url)
    return rows.select("c.id", "c.name", F.col("r.name").alias("reference"), "x.alias", url.alias("link"))


def mix_narratives(mixes: DataFrame, additives: DataFrame) -> DataFrame:
    """(mix_id, narrative) from carriers (mix_id, name, fraction) and additives (mix_id, name, amount, unit), largest share first."""
    part = F.concat(F.round(F.col("fraction") * 100, 1).cast("string"), F.lit("% "), F.col("name"))
    carriers = mixes.groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("fraction")).alias("o"), "name", F.coalesce(part, "name").alias("part")))).alias("x"))
    extra = F.concat_ws(" ", F.col("amount").cast("string"), "unit", "name")
    added = additives.groupBy("mix_id").agg(F.array_join(F.array_sort(F.collect_list(extra)), " and ").alias("with"))
    out = carriers.join(added, "mix_id", "left")
    base = F.array_join(F.transform("x", lambda p: p["part"]), " and ")
    return out.select("mix_id", F.concat(base, F.coalesce(F.concat(F.lit(" with "), "with"), F.lit(""))).alias("narrative"))


def log_summaries(logs: DataFrame) -> DataFrame:
    """Log entries by table and day."""
    return logs.groupBy("affects_table", F.to_date("executed_on").alias("day")).agg(F.count("*").alias("n"), F.min("category").alias("category"))


def reported_by_class(t: Frames) -> DataFrame:
    """Peaks of each sample with their rank by precursor, for browsing."""
    rows = t["peaks"].join(t["samples"].select(F.col("id").alias("sample_id"), "mzml_name"), "sample_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("sample_id").orderBy("precursor_mz", "id")))
