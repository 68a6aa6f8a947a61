"""OTLP/JSON log records, as exported by collectors, to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALARS = "stringValue: string, intValue: string, doubleValue: double, boolValue: boolean"
FLAT = f"struct<{SCALARS}>"
#: A value: a scalar, or an array or list of pairs of scalars.
ANY = f"struct<{SCALARS}, arrayValue: struct<values: array<{FLAT}>>, kvlistValue: struct<values: array<struct<key: string, value: {FLAT}>>>>"
KVLIST = f"array<struct<key: string, value: {ANY}>>"
DEEP = f"struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, kvlistValue: struct<values: {KVLIST}>, arrayValue: struct<values: array<struct<kvlistValue: struct<values: array<struct<key: string, value: struct<stringValue: string, doubleValue: double, kvlistValue: struct<values: {KVLIST}>>>>>>>>>"
SCHEMA = f"resourceLogs array<struct<resource: struct<attributes: {KVLIST}>, scopeLogs: array<struct<scope: struct<name: string>, logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, eventName: string, attributes: array<struct<key: string, value: {DEEP}>>>>>>>>"


def canonical(value: Column) -> Column:
    """A value's tagged text; null for an empty one."""
    from ..functions import values as V

    inside = lambda v: F.coalesce(scalar(v), F.lit("n:"))
    elements, pairs = value["arrayValue"]["values"], value["kvlistValue"]["values"]
    array = F.when(value["arrayValue"].isNotNull(), V.array(F.transform(F.coalesce(elements, F.expr(f"cast(array() as array<{FLAT}>)")), inside)))
    rows = F.transform(F.coalesce(pairs, F.expr(f"cast(array() as array<struct<key: string, value: {FLAT}>>)")), lambda p: F.struct(p["key"].alias("key"), inside(p["value"]).alias("value")))
    return F.coalesce(scalar(value), array, F.when(value["kvlistValue"].isNotNull(), V.kvlist(rows)))


def scalar(value: Column) -> Column:
    """A scalar's tagged text; null for what is no scalar."""
    from ..functions import values as V

    return F.coalesce(V.string(value["stringValue"]), V.integer(value["intValue"]), V.double(value["doubleValue"]), V.boolean(value["boolValue"]))


def _get(attributes: Column, key: str) -> Column:
    return F.get(F.filter(attributes, lambda a: a["key"] == key), 0)["value"]


def _pairs(kvlist: Column) -> Column:
    rows = F.transform(F.coalesce(kvlist["values"], F.expr(f"cast(array() as {KVLIST})")), lambda p: F.struct(p["key"].alias("key"), canonical(p["value"]).alias("value")))
    return F.filter(rows, lambda p: p["value"].isNotNull())


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def observations(exports: DataFrame, now_ns: int) -> DataFrame:
    """One row for each entity.state or entity.delete record; other records are ignored.

    ``problem`` tells why a record is rejected: a type that is no text, an identity without a
    scalar. Event time is the record's, else when it was observed, else ``now_ns``; tenant and
    producer are the resource's; a commit is one resource of one export.
    """
    resources = exports.withColumn("export", F.monotonically_increasing_id()).select("export", F.posexplode("resourceLogs").alias("r", "resource"))
    scopes = resources.select("export", "r", "resource.resource", F.posexplode("resource.scopeLogs").alias("s", "logs"))
    records = scopes.select("export", "r", "s", "resource", F.col("logs.scope.name").alias("scope"), F.posexplode("logs.logRecords").alias("n", "record"))
    a = F.col("record.attributes")
    zero = lambda c: F.nullif(F.col(f"record.{c}").cast("bigint"), F.lit(0))
    kind = F.col("record.eventName")
    rels = F.transform(_get(a, "entity.relationships")["arrayValue"]["values"], lambda d: d["kvlistValue"]["values"])
    text = lambda d, k: F.get(F.filter(d, lambda p: p["key"] == k), 0)["value"]
    made = F.transform(rels, lambda d: F.struct(text(d, "relationship.type")["stringValue"].alias("type"), text(d, "entity.type")["stringValue"].alias("target_type"), _pairs(text(d, "entity.id")["kvlistValue"]).alias("target"), text(d, "confidence")["doubleValue"].alias("confidence"), text(d, "basis")["stringValue"].alias("basis")))
    seconds = _get(a, "entity.report.interval")["intValue"].cast("bigint")
    out = records.where(kind.isin("entity.state", "entity.delete")).select(
        F.coalesce(_get(F.col("resource.attributes"), "tenant.id")["stringValue"], F.lit("default")).alias("tenant"),
        "export", "r", "s", "n",
        F.when(kind == "entity.state", "state").otherwise("delete").alias("kind"),
        _get(a, "entity.type")["stringValue"].alias("type"), _pairs(_get(a, "entity.id")["kvlistValue"]).alias("identity"),
        F.map_from_entries(_pairs(_get(a, "entity.description")["kvlistValue"])).alias("attributes"),
        F.filter(made, lambda m: m["type"].isNotNull() & m["target_type"].isNotNull() & (F.size(m["target"]) > 0)).alias("relationships"),
        F.coalesce(zero("timeUnixNano"), zero("observedTimeUnixNano"), F.lit(now_ns)).alias("event_time_ns"), F.lit(now_ns).alias("recorded_at_ns"),
        F.coalesce(_get(F.col("resource.attributes"), "service.instance.id")["stringValue"], F.lit("")).alias("producer"), F.coalesce("scope", F.lit("")).alias("scope"),
        F.when(seconds > 0, seconds * 10**9).otherwise(0).alias("interval_ns"), _get(a, "entity.delete.reason")["stringValue"].alias("delete_reason"),
    )
    return out.withColumn("problem", F.when(F.col("type").isNull(), "type").when(F.size("identity") == 0, "identity"))
