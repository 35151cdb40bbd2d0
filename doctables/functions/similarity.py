"""Header similarity. Used on header pairs only, never on data rows."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_text(headers: Sequence[str] | None) -> str:
    if headers is None or len(headers) == 0:
        return ""
    return " ".join(h.lower().strip() for h in headers)


def ratio(left: Sequence[str] | None, right: Sequence[str] | None) -> float:
    """Share of matching text of two header lists; 0 when either is empty."""
    if left is None or right is None or len(left) == 0 or len(right) == 0:
        return 0.0
    return SequenceMatcher(None, header_text(left), header_text(right)).ratio()


@F.pandas_udf(T.DoubleType())
def header_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def edit_similarity(left: Column, right: Column) -> Column:
    """JVM-side alternative, another measure: 1 - edit distance / longer length."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer > 0, 1 - F.levenshtein(left, right) / longer).otherwise(F.lit(0.0))
