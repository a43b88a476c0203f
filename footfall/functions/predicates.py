"""Filters shared by the reports: score bands, time bounds, text search."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOT_SCORE = 50
SUSPECT_SCORE = 25


def is_clean(score: str = "bot_score") -> Column:
    """Scored as human. API rows carry -1 and are neither clean nor bot."""
    return F.col(score).between(0, BOT_SCORE - 1)


def is_bot(score: str = "bot_score") -> Column:
    return F.col(score) >= BOT_SCORE


def below_bot(score: str = "bot_score") -> Column:
    """The looser test of the visitor list and the sample reports: includes -1."""
    return F.col(score) < BOT_SCORE


def score_band(score: Column) -> Column:
    return (
        F.when(score >= BOT_SCORE, "high").when(score >= SUSPECT_SCORE, "med").otherwise("low")
    )


def now_utc(as_of: datetime | None) -> datetime:
    return as_of or datetime.now(timezone.utc).replace(tzinfo=None)


def at(moment: datetime | date) -> Column:
    """A UTC wall-clock literal; folds to a constant that parquet scans can use."""
    text = moment.isoformat(sep=" ") if isinstance(moment, datetime) else f"{moment} 00:00:00"
    return F.lit(text).cast("timestamp_ntz")


def first_rows(ordered: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows; None means all."""
    return ordered if limit is None else ordered.limit(limit)


def days_back(as_of: datetime | None, days: int) -> date:
    """Midnight date ``days`` before the day of ``as_of``."""
    return now_utc(as_of).date() - timedelta(days=days)


def within(
    df: DataFrame,
    first: datetime | date | None = None,
    before: datetime | date | None = None,
    *,
    ts: str = "created_at",
    day: str = "event_date",
) -> DataFrame:
    """Rows from ``first`` on and before ``before``. On a table stored by day the same
    bounds hold for its day column, so only the folders of those days are read."""
    by_day = day in df.columns
    if first is not None:
        df = df.filter(F.col(ts) >= at(first))
        if by_day:
            df = df.filter(F.col(day) >= F.lit(_day(first)))
    if before is not None:
        df = df.filter(F.col(ts) < at(before))
        if by_day:
            df = df.filter(F.col(day) <= F.lit(_day(before)))
    return df


def _day(moment: datetime | date) -> date:
    return moment.date() if isinstance(moment, datetime) else moment


def ago(as_of: datetime | None, **span: int) -> datetime:
    return now_utc(as_of) - timedelta(**span)


def since(ts: str, as_of: datetime | None, **span: int) -> Column:
    return F.col(ts) >= at(now_utc(as_of) - timedelta(**span))


def contains_text(columns: list[str], text: str) -> Column:
    """Case-insensitive substring search; wildcards in the text match themselves."""
    pattern = text.replace("!", "!!").replace("%", "!%").replace("_", "!_")
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = F.lit(False)
    for name in columns:
        found = found | F.expr(f"`{name}` ILIKE '%{quoted}%' ESCAPE '!'")
    return found


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Apply one equality per given value; None means no condition."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df
