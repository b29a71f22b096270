"""The two scalar functions that Spark lacks, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def gestalt(p: str | None, t: str | None) -> float | None:
    """Gestalt ratio, predicted first: it is not symmetric."""
    if p is None or t is None:
        return None
    if p == t:
        return 1.0
    return SequenceMatcher(None, p, t).ratio() if p and t else 0.0


@F.pandas_udf(T.DoubleType())
def _ratio(predicted: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([gestalt(p, t) for p, t in zip(predicted, truth, strict=True)], dtype="float64")


def nfkd(text: Column) -> Column:
    ship()
    return _nfkd(text)


def ratio(predicted: Column, truth: Column) -> Column:
    ship()
    return _ratio(predicted, truth)
