"""Engineered churn features (one projection, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as E


def engineer_features(df: DataFrame) -> DataFrame:
    """Append the five derived features; the same function serves training
    and scoring, so both always agree."""
    return df.withColumns(E.engineered_columns())


def encode_target(df: DataFrame, label_col: str = S.TARGET_COL,
                  out_col: str = "label") -> DataFrame:
    """Yes → 1, No → 0; unmapped values become 0 and are flagged."""
    return df.withColumns({
        out_col: E.encode_label(label_col),
        f"{out_col}_unmapped": E.label_unmapped(label_col),
    })
