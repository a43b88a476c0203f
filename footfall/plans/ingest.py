"""API batches and performance-metric posts: validate, explode, de-duplicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.decode import SITE_ID, let, variant_text, with_parsed
from footfall.functions.identity import event_number
from footfall.schemas import EVENTS
from footfall.settings import Settings

# Identifier patterns and reject messages of protocol 1.
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EVENT_TYPE = "^[a-zA-Z_][a-zA-Z0-9_]*$"
API_SCORE = -1
API_DETAIL = '{"source":"api_ingest"}'
TOO_LARGE = "Body exceeds 1MB limit"
METRICS_TOO_LARGE = "Max 64 KB"
BAD_JSON = "Invalid JSON"
NOT_OBJECT = "Body must be a JSON object"
BAD_VERSION = "Unsupported protocol version"
BAD_BATCH_ID = "Invalid batch_id"
NO_CONTEXT = "Missing context"
BAD_SESSION = "Invalid session_id"
BAD_SITE = "Invalid site_id"
NO_EVENTS = "Events array is empty or missing"
MANY_EVENTS = "Too many events (max 100)"
BAD_EVENT = "Invalid event object"
BAD_EVENT_ID = "Invalid event_id: "
NO_TYPE = "Event missing type"
BAD_TYPE = "Invalid event type: "
NO_TIME = "Event missing ts"
BAD_METRICS = "Expected array of metrics (max 100)"
BAD_METRIC = (
    "Each metric requires category (string), metric (string), value (number), unit (string)"
)
TYPE_SHOWN = 32
METRIC_TEXTS = ("category", "metric", "unit", "commit_hash", "branch")

SHAPE = "struct<events: array<struct<data: string>>>"


@dataclass(frozen=True)
class Ingested:
    events: DataFrame
    rejects: DataFrame
    counts: DataFrame


def _member(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "variant")


def _kind(variant: Column, path: str = "$") -> Column:
    """JSON type name of a member ('STRING', 'OBJECT<..>', ...), NULL if absent."""
    return F.schema_of_variant(_member(variant, path))


def _number(variant: Column, path: str) -> Column:
    """A JSON number; NULL for members of any other type."""
    return F.when(
        _kind(variant, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
        F.try_variant_get(variant, path, "double"),
    )


def _shown(variant: Column, path: str) -> Column:
    """A member as message text: 'undefined' when it is absent."""
    member = _member(variant, path)
    text = F.coalesce(F.try_variant_get(variant, path, "string"), F.to_json(member))
    return F.coalesce(text, F.lit("undefined"))


def _compound(json_text: Column) -> Column:
    """JSON text of an object or an array."""
    return F.coalesce(F.ltrim(json_text).rlike("^[{\\[]"), F.lit(False))


def _event_error(event: Column) -> Column:
    """First rule an event breaks, NULL for a good one. A valid id proves that
    the event is an object, so that test runs on bad ids only."""
    bad_id = F.when(~_compound(F.to_json(event)), BAD_EVENT).otherwise(
        F.concat(F.lit(BAD_EVENT_ID), _shown(event, "$.event_id"))
    )

    def bad_type(kind: Column) -> Column:
        return F.when(F.coalesce(kind, F.lit("")) == "", NO_TYPE).when(
            (F.length(kind) > 64) | ~kind.rlike(EVENT_TYPE),
            F.concat(F.lit(BAD_TYPE), F.left(kind, F.lit(TYPE_SHOWN))),
        )

    return F.when(
        ~F.coalesce(variant_text(event, "$.event_id").rlike(UUID), F.lit(False)), bad_id
    ).otherwise(
        F.coalesce(
            let(variant_text(event, "$.type"), bad_type),
            F.when(variant_text(event, "$.ts").isNull(), NO_TIME),
        )
    )


def parse_batches(raw: DataFrame) -> DataFrame:
    """Bodies as VARIANT, with their context and events."""
    parsed = with_parsed(raw, _json=F.try_parse_json("body"))
    return with_parsed(
        parsed,
        _context=F.try_variant_get("_json", "$.context", "variant"),
        _events=F.try_variant_get("_json", "$.events", "array<variant>"),
    )


def check_batches(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Parsed batches with ``message``: the first rule broken, NULL if accepted.
    One bad event rejects its whole batch."""
    json, context = F.col("_json"), F.col("_context")
    site = variant_text(context, "$.site_id")
    size = F.coalesce(F.size("_events"), F.lit(0))
    errors = F.filter(F.transform("_events", _event_error), lambda e: e.isNotNull())
    good = lambda c: F.coalesce(c, F.lit(False))
    bad_session = F.when(_compound(F.to_json(context)), BAD_SESSION).otherwise(NO_CONTEXT)
    message = (
        F.when(F.length("body") > settings.batch_length, TOO_LARGE)
        .when(json.isNull(), BAD_JSON)
        .when(~_compound(F.col("body")), NOT_OBJECT)
        .when(~good(_number(json, "$.v") == 1.0), BAD_VERSION)
        .when(~good(variant_text(json, "$.batch_id").rlike(UUID)), BAD_BATCH_ID)
        .when(~good(variant_text(context, "$.session_id").rlike(UUID)), bad_session)
        .when(_member(context, "$.site_id").isNotNull() & ~good(site.rlike(SITE_ID)), BAD_SITE)
        .when(size <= 0, NO_EVENTS)
        .when(size > settings.batch_events, MANY_EVENTS)
    )
    # the rules above are compiled if no function of a list's members is among them
    judged = with_parsed(parse_batches(raw), _broken=message)
    first = F.coalesce("_broken", F.get(errors, F.lit(0)))
    return with_parsed(judged, message=first).drop("_broken")


def _joined_data(
    data: Column, fields: Column, experiment: Column, variant: Column, context: Column
) -> Column:
    """The event's data with experiment ids and session context set, as JSON.

    ``data`` is the text sent and ``fields`` its members. The text is kept as it is
    unless it has one of these names itself or a name twice: then ours, or the last
    one sent, is what counts, and the members are written anew in order of name.
    """

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    def quoted(path: str) -> Column:
        return F.to_json(_member(context, path))

    def pair(a: str, b: str) -> Column:
        return F.concat(F.lit('"'), _shown(context, a), F.lit("x"), _shown(context, b), F.lit('"'))

    def text_json(value: Column) -> Column:
        wrapped = F.to_json(F.struct(value.alias("v")))
        return F.when(value.isNotNull(), F.regexp_extract(wrapped, '^\\{"v":(.*)\\}$', 1))

    session = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            member("device_class", quoted("$.device_class")),
            member("viewport", pair("$.viewport_width", "$.viewport_height")),
            member("screen", pair("$.screen_width", "$.screen_height")),
            member("language", quoted("$.language")),
        ),
        F.lit("}"),
    )

    def anew(names: Column) -> Column:
        ours = F.array_contains(names, "session_context") | (
            experiment.isNotNull() & F.arrays_overlap(names, F.array(F.lit("experiment_id"), F.lit("variant_id")))
        )
        doubled = F.size(F.json_object_keys(data)) != F.size(names)
        return F.coalesce(ours | doubled, F.lit(False))

    replaced = F.when(
        experiment.isNotNull(), F.array(*[F.lit(n) for n in ("session_context", "experiment_id", "variant_id")])
    ).otherwise(F.array(F.lit("session_context")))
    rewritten = F.array_join(
        F.transform(
            F.filter(F.map_entries(fields), lambda e: ~F.array_contains(replaced, e["key"])),
            lambda e: F.concat(text_json(e["key"]), F.lit(":"), F.to_json(e["value"])),
        ),
        ",",
    )
    as_sent = F.regexp_extract(data, "(?s)^\\{(.*)\\}$", 1)
    own = F.nullif(F.when(let(F.map_keys(fields), anew), rewritten).otherwise(as_sent), F.lit(""))
    return F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            own,
            member("experiment_id", text_json(experiment)),
            F.when(
                experiment.isNotNull(),
                member("variant_id", F.coalesce(text_json(variant), F.lit("null"))),
            ),
            member("session_context", session),
        ),
        F.lit("}"),
    )


def _listed(checked: DataFrame) -> DataFrame:
    """Events of the accepted batches: raw_id, received_at, _context, pos, col (v, e)."""
    accepted = with_parsed(
        checked.filter(F.col("message").isNull()), _typed=F.from_json("body", SHAPE)
    )
    return accepted.select(
        "raw_id",
        "received_at",
        "_context",
        F.posexplode(F.arrays_zip(F.col("_events").alias("v"), F.col("_typed.events").alias("e"))),
    )


def event_keys(checked: DataFrame) -> DataFrame:
    """Of ``batch_events`` what tells which event is the first of its id."""
    return _listed(checked).select(
        "raw_id", F.col("pos").alias("position"), variant_text(F.col("col.v"), "$.event_id").alias("event_id"),
        F.col("received_at").alias("created_at"),
    )


def batch_events(checked: DataFrame) -> DataFrame:
    """Events of the accepted batches, with the event id and their position."""
    listed = _listed(checked)
    event, sent = F.col("col.v"), F.col("col.e.data")
    first = F.try_variant_get(event, "$.experiments[0]", "variant")
    is_object = sent.startswith("{") & variant_text(event, "$.data").isNull()
    # each is named many times below
    listed = with_parsed(
        listed,
        _experiment=F.nullif(variant_text(first, "$.experiment_id"), F.lit("")),
        _variant=variant_text(first, "$.variant_id"),
        _data=F.when(is_object, sent).otherwise("{}"),
        _fields=F.try_variant_get(event, "$.data", "map<string,variant>"),
    )
    experiment, variant, data, fields = (F.col(c) for c in ("_experiment", "_variant", "_data", "_fields"))
    at = F.col("received_at")
    return listed.select(
        "raw_id",
        F.col("pos").alias("position"),
        variant_text(event, "$.event_id").alias("event_id"),
        F.try_to_timestamp(variant_text(event, "$.ts")).cast("timestamp_ntz").alias("event_ts"),
        event_number("raw_id", F.col("pos"), api=True).alias("id"),
        variant_text(event, "$.type").alias("event_type"),
        F.coalesce(variant_text(F.col("_context"), "$.site_id"), F.lit("default")).alias("site_id"),
        variant_text(F.col("_context"), "$.session_id").alias("session_id"),
        F.lit(None).cast("string").alias("visitor_id"),
        _joined_data(
            data, fields, experiment, variant, F.col("_context")
        ).alias("data"),
        experiment.alias("experiment_id"),
        F.when(experiment.isNotNull(), variant).alias("variant_id"),
        F.lit(None).cast("string").alias("utm_campaign"),
        variant_text(F.col("_context"), "$.device_class").alias("device_type"),
        variant_text(event, "$.referrer").alias("referrer"),
        F.hour(at).alias("hour"),
        F.month(at).alias("month"),
        (F.dayofweek(at) - 1).alias("day_of_week"),
        F.lit(0).alias("is_returning"),
        F.lit(API_SCORE).alias("bot_score"),
        F.lit(API_DETAIL).alias("bot_score_detail"),
        at.alias("created_at"),
    )


def first_of_each(events: DataFrame) -> DataFrame:
    """One row per event id: the earliest received. The rank filter runs in each
    task before the shuffle, so an id repeated endlessly costs one row per task."""
    earliest = Window.partitionBy("event_id").orderBy("created_at", "raw_id", "position")
    return (
        events.withColumn("_rank", F.row_number().over(earliest))
        .filter(F.col("_rank") <= 1)
        .drop("_rank")
    )


def batch_counts(listed: DataFrame, unique: DataFrame) -> DataFrame:
    """Accepted and duplicate events of every accepted batch."""
    sent = listed.groupBy("raw_id").agg(F.count("*").alias("sent"))
    kept = unique.groupBy("raw_id").agg(F.count("*").alias("accepted"))
    return (
        sent.join(kept, "raw_id", "left")
        .fillna(0, ["accepted"])
        .select("raw_id", "accepted", (F.col("sent") - F.col("accepted")).alias("duplicate"))
    )


def ingest_batches(raw: DataFrame, settings: Settings = Settings()) -> Ingested:
    """Accepted events, rejected batches with a message, and accepted and
    duplicate counts per batch."""
    checked = check_batches(raw, settings)
    unique = first_of_each(batch_events(checked))
    keys = event_keys(checked)
    return Ingested(
        events=unique.select("event_id", "event_ts", *[f.name for f in EVENTS.fields]),
        rejects=checked.filter(F.col("message").isNotNull()).select("raw_id", "message"),
        counts=batch_counts(keys, first_of_each(keys)),
    )


def ingest_metrics(raw: DataFrame, settings: Settings = Settings()) -> Ingested:
    """Metrics of well-formed posts; one bad entry rejects its whole post."""
    entry = lambda m: (
        _kind(m).startswith("OBJECT")
        & (F.coalesce(variant_text(m, "$.category"), F.lit("")) != "")
        & (F.coalesce(variant_text(m, "$.metric"), F.lit("")) != "")
        & (F.coalesce(variant_text(m, "$.unit"), F.lit("")) != "")
        & F.coalesce(
            _kind(m, "$.value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False)
        )
    )
    message = (
        F.when(F.octet_length("body") > settings.metric_bytes, METRICS_TOO_LARGE)
        .when(F.col("_json").isNull(), BAD_JSON)
        .when(F.col("_list").isNull() | (F.size("_list") > settings.metrics), BAD_METRICS)
        .when(~F.forall("_list", entry), BAD_METRIC)
    )
    parsed = with_parsed(raw, _json=F.try_parse_json("body"))
    listed = with_parsed(parsed, _list=F.try_variant_get("_json", "$", "array<variant>"))
    checked = with_parsed(listed, message=message)
    listed = checked.filter(F.col("message").isNull()).select(
        "raw_id", "received_at", F.posexplode("_list").alias("position", "_m")
    )
    texts = [variant_text(F.col("_m"), f"$.{name}").alias(name) for name in METRIC_TEXTS]
    given = F.schema_of_variant(_member(F.col("_m"), "$.metadata")) != "VOID"
    metadata = F.when(given, F.to_json(_member(F.col("_m"), "$.metadata")))
    metrics = listed.select(
        "raw_id",
        "position",
        F.col("received_at").alias("recorded_at"),
        *texts,
        F.try_variant_get("_m", "$.value", "double").alias("value"),
        metadata.alias("metadata"),
    )
    return Ingested(
        events=metrics,
        rejects=checked.filter(F.col("message").isNotNull()).select("raw_id", "message"),
        counts=metrics.groupBy("raw_id").agg(F.count("*").alias("inserted")),
    )
