from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.session import build_session

NOW = datetime(2024, 3, 10, 12, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="footfall-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


VIEW = dict(
    visitor_id="v1", path="/", site_id="site", interaction_ms=1000, device_type="desktop",
    country_code="NO", is_returning=0, bot_score=0, is_pwa=0, created_at=NOW,
)
EVENT = dict(
    event_type="click", site_id="site", session_id="s1", visitor_id="v1", data="{}",
    is_returning=0, bot_score=0, created_at=NOW,
)
HIT = dict(
    hit_id=1, ts=NOW, remote_addr="198.51.100.1", user_agent="Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0",
    accept_language="en", sec_ch_ua="x", sec_fetch_site="none", p="Lw==", s="site",
    sid="aaaaaaaa-0000-0000-0000-000000000001", sw="1920", sh="1080", v="2000", pow_result="valid",
)


def rows(spark, schema, defaults, *changes):
    """A table of rows that differ from the defaults as given."""
    data = []
    for number, change in enumerate(changes, 1):
        row = {f.name: None for f in schema.fields} | {"id": number} | defaults | change
        data.append(tuple(row[f.name] for f in schema.fields))
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def views(spark):
    return lambda *changes: rows(spark, schemas.VIEWS, VIEW, *changes)


@pytest.fixture(scope="session")
def events(spark):
    return lambda *changes: rows(spark, schemas.EVENTS, EVENT, *changes)


@pytest.fixture(scope="session")
def hits(spark):
    return lambda *changes: rows(spark, schemas.HITS, HIT, *changes)


@pytest.fixture(scope="session")
def table(spark):
    def build(schema, *data):
        return spark.createDataFrame(
            [tuple(r.get(f.name) for f in schema.fields) for r in data], schema
        )

    return build


@pytest.fixture(scope="session")
def excluded(spark):
    return lambda *ids: spark.createDataFrame(
        [(i, "label", NOW) for i in ids], schemas.EXCLUDED
    )


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate expressions of literals in one row."""
    return lambda *columns: tuple(
        spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    )


def texts(spark, values, column):
    """Apply a column function of 'x' to a list of texts; results in input order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in df.select(column(F.col("x")).alias("r"), "i").orderBy("i").select("r").collect()]
