"""Ratios and the two-proportion z-test of experiment reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest sample per variant, critical z values and their labels.
MIN_IMPRESSIONS = 100
Z_LABELS = (
    (2.576, "Statistically significant at 99%"),
    (1.96, "Statistically significant at 95%"),
    (1.645, "Marginally significant at 90%"),
)
NO_RESULT = "Not enough data"
NO_VARIANCE = "No variance"
NOT_SIGNIFICANT = "Not statistically significant"


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def z_test_label(c1: Column, n1: Column, c2: Column, n2: Column) -> Column:
    smaller = F.least(n1, n2)
    pooled = (c1 + c2) / F.nullif(n1 + n2, F.lit(0))
    error = F.sqrt(
        pooled * (1 - pooled) * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n2, F.lit(0)))
    )
    z = F.abs(c2 / F.nullif(n2, F.lit(0)) - c1 / F.nullif(n1, F.lit(0))) / F.nullif(
        error, F.lit(0.0)
    )
    label = F.when(
        smaller < MIN_IMPRESSIONS,
        F.concat(
            F.lit("Not yet — need more data ("),
            smaller.cast("string"),
            F.lit(f" < {MIN_IMPRESSIONS} impressions)"),
        ),
    ).when(error == 0, NO_VARIANCE)
    for critical, text in Z_LABELS:
        label = label.when(z >= critical, text)
    return label.otherwise(NOT_SIGNIFICANT)
