"""Greek text: marks, Beta Code. The few functions that the JVM lacks are Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The letters of Beta Code and the Greek ones, in the same order.
BETA_LETTERS = "abgdezhqiklmncoprstufxyw"
GREEK_LETTERS = "αβγδεζηθικλμνξοπρστυφχψω"
# Marks of Beta Code and the combining characters, in the same order.
BETA_MARKS = ")(/\\=|+"
GREEK_MARKS = "̓̔́̀͂̈ͅ"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Without diacritics: decomposed, non-spacing marks dropped, composed."""
    bare = lambda x: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))
    return s.map(bare, na_action="ignore")


def headword(c: Column) -> Column:
    """Key of a dictionary entry."""
    return F.regexp_replace(F.lower(nfc(F.trim(c))), r"[.,;:!?·]+$", "")


def from_beta(c: Column) -> Column:
    """Beta Code as Greek letters; what is neither letter nor mark is dropped."""
    # a sigma is final where no letter follows its marks; what was dropped also ends it
    raw = F.regexp_replace(F.lower(F.trim(c)), r"^\*+", "")
    final = F.regexp_replace(raw, r"s(?![)(/\\=|+]*[abgdezhqiklmncoprstufxyw])", "ς")
    kept = F.regexp_replace(final, r"[^abgdezhqiklmncoprstufxywς)(/\\=|+]", "")
    return nfc(F.translate(kept, BETA_LETTERS + BETA_MARKS, GREEK_LETTERS + GREEK_MARKS))
