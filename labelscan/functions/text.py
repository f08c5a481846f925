"""Text expressions: ASCII folding, cleaning, literal search, declared patterns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def clean(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def contains_fold(x: Column, query: str) -> Column:
    """Literal search that folds ASCII letters only; wildcards have no meaning."""
    return F.contains(ascii_fold(x), F.lit(query.translate(str.maketrans(UPPER, LOWER))))


def collapse(x: Column, most: int = 200) -> Column:
    """White space collapsed, at most ``most`` characters, null where nothing remains."""
    return F.nullif(F.left(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(most)), F.lit(""))


def text_detail(x: Column) -> Column:
    """Alphanumeric characters, one more if both letters and digits occur."""
    alnum = F.regexp_replace(x, r"[^\p{L}\p{N}]", "")
    return F.length(alnum) + (x.rlike(r"\p{L}") & x.rlike(r"\p{N}")).cast("int")


def ratio(a: str | None, b: str | None) -> float | None:
    """Ratcliff/Obershelp similarity."""
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")
