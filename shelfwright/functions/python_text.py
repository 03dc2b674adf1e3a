"""Text functions that the built-in ones cannot express, over Arrow batches."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_OTHER = re.compile(r"[\W_]+")


@F.pandas_udf(StringType())
def folded_text(c: pd.Series) -> pd.Series:
    """Compatibility composition, character references resolved, full case folding, and single blanks for what is neither letter nor digit; NULL stays."""
    return c.map(lambda v: None if v is None else _OTHER.sub(" ", unicodedata.normalize("NFKC", html.unescape(v)).casefold()).strip())


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts, the smaller one first so that order does not matter; NULL where either is NULL."""
    one = lambda x, y: None if x is None or y is None else difflib.SequenceMatcher(None, *sorted((x, y)), autojunk=False).ratio()
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
