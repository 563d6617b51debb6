"""Text helpers of the narratives and imports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article(word: Column) -> Column:
    """ "an " before a lower-case vowel, else "a "."""
    return F.when(F.substring(word, 1, 1).isin("a", "e", "i", "o", "u"), "an ").otherwise("a ")


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def acronym(text: Column) -> Column:
    """The first letters of the words, upper case."""
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def blank_to_null(text: Column) -> Column:
    """Null for empty text and the words NULL (in any case) and NA."""
    return F.when(~F.upper(F.trim(text)).isin("", "NULL", "NA"), text)


def join_names(names: list[str], last: str = "and") -> str:
    """ "a", "a and b", "a, b, and c"."""
    if len(names) < 3:
        return f" {last} ".join(names)
    return f"{', '.join(names[:-1])}, {last} {names[-1]}"


def padded_id(number: Column, prefix: str, width: int = 6) -> Column:
    """The prefix and the number with leading zeros."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))
