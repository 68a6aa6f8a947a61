"""An estate made of business tables: entities, relations and a stream of observations.

Regions are segments, nations hosts, suppliers devices, customers services, parts databases and
orders processes; the table ``events`` is what collectors report about one host per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.vocabulary import structural
from .log import distinct

#: Logical ids: the table's number in the high bits, the row's key below.
SPACE = 1 << 40
KINDS = ("region", "nation", "supplier", "customer", "part", "orders")
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.cast("bigint") + KINDS.index(kind) * SPACE


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, identity, attributes, fingerprint)."""
    t = lambda name: table(spark, sf_dir, name)
    text, number = lambda c: V.string(F.col(c)), lambda c: V.integer(F.col(c))
    attrs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("_", ".")), v)])
    rows = [
        t("region").select(node("region", "r_regionkey").alias("id"), F.lit("network.segment").alias("type"), V.identity(network_segment_id=text("r_name")).alias("identity"), attrs(segment_name=text("r_name")).alias("attributes")),
        t("nation").select(node("nation", "n_nationkey"), F.lit("host"), V.identity(host_id=number("n_nationkey")), attrs(host_name=text("n_name"), status=V.string(F.when(F.col("n_nationkey") % 5 == 0, "down").otherwise("up")))),
        t("supplier").select(node("supplier", "s_suppkey"), F.lit("network.device"), V.identity(network_device_id=text("s_name")), attrs(hw_vendor=V.string(F.concat(F.lit("vendor"), F.col("s_suppkey") % 3)), chassis_serial=V.string(F.concat(F.lit("SN"), F.floor(F.col("s_suppkey") / 2))))),
        t("customer").select(node("customer", "c_custkey"), F.lit("service.instance"), V.identity(service_instance_id=text("c_name")), attrs(service_name=text("c_name"), segment=text("c_mktsegment"))),
        t("part").select(node("part", "p_partkey"), F.lit("db"), V.identity(db_instance_id=number("p_partkey")), attrs(db_name=text("p_name"), brand=text("p_brand"))),
        t("orders").select(node("orders", "o_orderkey"), F.lit("process"), V.identity(process_pid=number("o_orderkey"), process_creation_time=V.string(F.date_format("o_orderdate", "yyyy-MM-dd"))), attrs(status=text("o_orderstatus"), priority=text("o_orderpriority"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("fingerprint", V.fingerprint(F.col("type"), F.col("identity")))


def pairs(lines: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct pairs (a, b) of a table, which is counted from its footers."""
    return distinct(lines.select(a, b), lines.count())


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, from_id, to_id, from_type, to_type, structural), one row for each edge."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, kind, a, b, ta, tb: df.select(F.lit(kind).alias("type"), a.alias("from_id"), b.alias("to_id"), F.lit(ta).alias("from_type"), F.lit(tb).alias("to_type"))
    lines = t("lineitem")
    out = (
        edge(t("nation"), "attached_to", node("nation", "n_nationkey"), node("region", "n_regionkey"), "host", "network.segment")
        .union(edge(t("supplier"), "runs_on", node("supplier", "s_suppkey"), node("nation", "s_nationkey"), "network.device", "host"))
        .union(edge(t("customer"), "runs_on", node("customer", "c_custkey"), node("nation", "c_nationkey"), "service.instance", "host"))
        .union(edge(pairs(lines, "l_partkey", "l_suppkey"), "depends_on", node("part", "l_partkey"), node("supplier", "l_suppkey"), "db", "network.device"))
        .union(edge(t("orders"), "runs_on", node("orders", "o_orderkey"), node("customer", "o_custkey"), "process", "service.instance"))
        .union(edge(pairs(lines, "l_orderkey", "l_partkey"), "depends_on", node("orders", "l_orderkey"), node("part", "l_partkey"), "process", "db"))
    )
    return out.withColumn("structural", structural(F.col("type")))


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """same_as claims between customers next to each other in balance, in one nation and segment."""
    from pyspark.sql import Window

    near = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_acctbal", "c_custkey")
    rows = table(spark, sf_dir, "customer").withColumns({"before": F.lag("c_custkey").over(near), "gap": F.col("c_acctbal") - F.lag("c_acctbal").over(near)})
    return rows.where("before is not null").select(F.lit("same_as").alias("type"), node("customer", "before").alias("from_id"), node("customer", "c_custkey").alias("to_id"), (1 - F.col("gap") / 10_000).alias("confidence"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What collectors report: seq, kind (state or delete), id, attributes, times, producer, scope; a tenth comes late."""
    e = table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 10 == 0, (F.col("event_id") % 7) * HOUR_US).otherwise(0)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.lit("default").alias("tenant"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("state").alias("kind"),
        F.lit("host").alias("type"), F.col("user_id").alias("id"),
        F.create_map(F.lit("status"), V.string(F.col("event_type")), F.lit("bucket"), V.integer(F.floor(F.col("value") / 50))).alias("attributes"),
        (micros("ts") * 1000).alias("event_time_ns"), ((micros("ts") + late) * 1000).alias("recorded_at_ns"),
        F.concat(F.lit("p"), k % 3).alias("producer"), F.concat(F.lit("m"), k % 4).alias("scope"),
    )
