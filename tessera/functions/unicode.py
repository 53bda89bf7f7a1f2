"""Canonical composition and decomposition, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def _udf(form: str):
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    apply.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, StringType())


def nfc(c: Column) -> Column:
    """Rows without combining marks are composed already and never reach Python's result."""
    return F.when(c.rlike("\\p{M}"), _udf("NFC")(c)).otherwise(c)


def nfd(c: Column) -> Column:
    """Rows of ASCII only have nothing to decompose."""
    return F.when(c.rlike("[^\\x00-\\x7F]"), _udf("NFD")(c)).otherwise(c)
