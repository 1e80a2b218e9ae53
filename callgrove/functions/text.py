"""Text functions: prompt normalisation and surface rewrites."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"


def normalize_prompt(text: str) -> str:
    """NFKC, case folded; marks, punctuation and symbols become spaces; runs of white space one space."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(" " if unicodedata.category(c)[0] in "MPS" else c for c in folded).split())


@F.pandas_udf(T.StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: normalize_prompt(t) if isinstance(t, str) else None)


def normalized_prompt(text: Column) -> Column:
    """``normalize_prompt`` of a column. ASCII texts stay in the JVM: there, folding is lower case, and marks and symbols are the signs between the letters and digits."""
    ascii_ = text.rlike(r"^[\x00-\x7F]*+$")
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " "), r"[\x09-\x0D\x1C-\x20]+", " ")
    return F.when(ascii_, F.trim(plain)).otherwise(_normalized(F.when(~ascii_, text)))


def blank(text: Column) -> Column:
    """Null, or nothing but Unicode white space."""
    return F.coalesce(F.regexp_replace(text, SPACE, "") == "", F.lit(True))


# Months, digits and letters of the surface rewrites.
MONTHS = ["يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر"]
DIGITS = "٠١٢٣٤٥٦٧٨٩"
HAMZA_FORMS, BARE_ALEF = "أإآ", "ااا"


def bare_alef(text: Column) -> Column:
    return F.translate(text, HAMZA_FORMS, BARE_ALEF)


def spelled_date(iso: Column) -> Column:
    """2027-01-05 as day, month's name and year in Arabic-Indic digits."""
    part = F.split(iso, "-")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), part[1].cast("int"))
    return F.concat_ws(" ", part[2].cast("int").cast("string"), month, F.translate(part[0], "0123456789", DIGITS))


def prompt_value(field: Column, value: Column, form: Column) -> Column:
    """How a value stands in a prompt of this form: form 19 spells dates, form 17 drops hamza."""
    return F.when((form == 19) & field.endswith("_date_iso"), spelled_date(value)).when(form == 17, bare_alef(value)).otherwise(value)


def token_lengths(texts: Column, count) -> Column:
    """Lengths by a tokenizer: count takes a list of texts and gives a list of numbers. Arrow-batched."""

    @F.pandas_udf("long")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(count(batch.tolist()))

    return run(texts)
