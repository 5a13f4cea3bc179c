"""Alert payloads to incident cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.config import EngineConfig
from faultline.functions.instants import with_instant
from faultline.session import fence

# Labels that carry the stand and the service, most telling first, and spellings of stands.
STAND_KEYS = ["stand", "env", "environment", "deployment_environment"]
SERVICE_KEYS = ["service", "service_name", "app", "application", "job", "component", "project"]
STAND_ALIASES = {"production": "prod", "prd": "prod", "staging": "stage", "stg": "stage", "testing": "test", "qa": "test", "development": "dev", "devel": "dev"}


def shape(payload: Column) -> Column:
    """alertmanager, sentry, grafana or null for a payload no reader knows."""
    has = lambda p: F.get_json_object(payload, p).isNotNull()
    return (F.when(has("$.alerts[0].labels") | has("$.alerts[0].startsAt"), "alertmanager").when(has("$.data.event"), "sentry")
            .when(has("$.ruleName") | has("$.evalMatches") | has("$.ruleUrl"), "grafana"))


def _pick(m: Column, keys: list[str]) -> Column:
    low = F.transform_keys(m, lambda k, v: F.lower(k))
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(low, F.lit(k))), F.lit("")) for k in keys])


def norm_stand(x: Column) -> Column:
    t = F.lower(F.trim(x))
    alias = F.create_map(*[F.lit(v) for kv in STAND_ALIASES.items() for v in kv])
    return F.coalesce(F.try_element_at(alias, t), t)


def cards(alerts: DataFrame, config: EngineConfig = EngineConfig(), minutes: int = 15) -> DataFrame:
    """delivery_id, shape, title, stand, service, severity, signature, since, until, missing, sufficient of each payload.

    The window lies `minutes` around the alert's time, around the clock where it has none; nothing is guessed: what a payload does not say is listed in `missing`.
    A card suffices with a stand or a service. Null, empty and unreadable payloads have a null shape and everything missing."""
    p = F.col("payload")
    obj = lambda path: F.from_json(F.get_json_object(p, path), "map<string,string>")
    empty = F.expr("cast(map() as map<string,string>)")
    df = alerts.select("delivery_id", "payload").withColumn("shape", shape(p))
    labels = (F.when(F.col("shape") == "alertmanager", F.map_concat(F.coalesce(obj("$.commonLabels"), empty), F.coalesce(obj("$.alerts[0].labels"), empty)))
              .when(F.col("shape") == "sentry", F.coalesce(obj("$.data.event"), empty))
              .when(F.col("shape") == "grafana", F.map_concat(F.coalesce(obj("$.evalMatches[0].tags"), empty), F.coalesce(obj("$.tags"), empty))))
    df = df.withColumn("labels", labels)
    g = lambda path: F.nullif(F.trim(F.get_json_object(p, path)), F.lit(""))
    title = F.coalesce(F.try_element_at("labels", F.lit("alertname")), g("$.data.event.title"), g("$.title"), g("$.ruleName"))
    signature = F.coalesce(g("$.data.event.metadata.type"), g("$.data.event.exception.type"))
    time = F.coalesce(g("$.alerts[0].startsAt"), g("$.data.event.timestamp"))
    time = F.when(time.rlike(r"^\d(\.\d+)?[eE]\d+$"), time.try_cast("decimal(30,6)").cast("string")).otherwise(time)
    df = df.select("delivery_id", "shape", title.alias("title"), norm_stand(_pick(F.col("labels"), STAND_KEYS)).alias("stand"), _pick(F.col("labels"), SERVICE_KEYS).alias("service"),
                   F.lower(_pick(F.col("labels"), ["severity", "sev", "level"])).alias("severity"), signature.alias("signature"), time.alias("time"))
    df = fence(with_instant(df, "time", "cast(null as string)", out="us").drop("us_shift", "us_known"), "us")
    at = F.coalesce("us", F.lit(config.now_us))
    stamp = lambda x: F.timestamp_micros(x).cast("timestamp_ntz")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for c, n in (("stand", "stand"), ("service", "service"), ("us", "time"), ("title", "title"))]))
    return df.select("delivery_id", "shape", "title", "stand", "service", "severity", "signature", stamp(at - minutes * 60_000_000).alias("since"),
                     stamp(at + minutes * 60_000_000).alias("until"), missing.alias("missing"), (F.col("stand").isNotNull() | F.col("service").isNotNull()).alias("sufficient"))
