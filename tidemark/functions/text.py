"""Text normalisation with Unicode forms and case folding, which Spark SQL lacks, and token helpers in SQL expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_REDACTED = re.compile(r"\bx{2,}\b")
_SPACES = re.compile(r"\s+")


def normalised(text: str) -> str:
    """NFKC, case folding, runs of x as ``<redacted>``, white space collapsed and stripped."""
    return _SPACES.sub(" ", _REDACTED.sub("<redacted>", unicodedata.normalize("NFKC", text).casefold())).strip()


@F.pandas_udf(StringType())
def normalised_udf(text: pd.Series) -> pd.Series:
    return text.map(normalised, na_action="ignore")


def normalised_native(c: Column) -> Column:
    """The same for text without compatibility characters or special case foldings, inside generated code."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\bx{2,}\b", "<redacted>"), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Words of two or more letters or digits, lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words joined by a space, as an array."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
