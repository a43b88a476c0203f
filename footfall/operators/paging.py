"""Paging: by page number, clamped to the existing pages, or onward from a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    page: int
    per_page: int
    total_pages: int


def paginate(
    df: DataFrame, *order: Column | str, page: int = 1, per_page: int = 25
) -> Page:
    """One page in the given order. Counting the rows is the only action. A page far
    back sorts all rows before it in one task; ``onward`` does not."""
    total = df.count()
    total_pages = max(1, -(-total // per_page))
    page = min(max(1, page), total_pages)
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return Page(rows, total, page, per_page, total_pages)


def onward(
    df: DataFrame, key: str, tiebreak: str, last: tuple | None = None, *, descending: bool = True, per_page: int = 25
) -> DataFrame:
    """The rows after the one with ``last`` = (key, tiebreak), or the first ones. Ties of
    ``key`` go up by ``tiebreak``, which is different in every row. However far one has
    come, no task keeps more than a page; with a filter on the key, neither is more read."""
    if last is not None:
        value, place = (F.lit(str(x)).cast(df.schema[c].dataType) for x, c in zip(last, (key, tiebreak)))
        later = F.col(key) < value if descending else F.col(key) > value
        df = df.filter(later | ((F.col(key) == value) & (F.col(tiebreak) > place)))
    return df.orderBy(F.desc(key) if descending else F.asc(key), tiebreak).limit(per_page)
