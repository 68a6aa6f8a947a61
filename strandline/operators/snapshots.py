"""Snapshots of the live graph, what they restore, and deleted entities that stay readable for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import GRACE_NS
from .state import live

EVENT = ("tenant", "id", "attributes", "change_type", "event_time_ns", "recorded_at_ns", "seq")
#: Deleted entities that a tenant keeps readable at most.
TOMBSTONES = 1024


def snapshot_events(entities: DataFrame, relations: DataFrame | None, when_ns: int, seq: int) -> DataFrame:
    """What lives (tenant, id, attributes), as creations at one instant; what was deleted is not in it, so it stays so."""
    at = {"event_time_ns": F.lit(when_ns), "recorded_at_ns": F.lit(when_ns), "seq": F.lit(seq).cast("long")}
    made = lambda df, name: df.select("tenant", "id", "attributes").withColumns({"change_type": F.lit(name), **at}).select(*EVENT)
    out = made(entities, "entity.created")
    return out if relations is None else out.unionByName(made(relations, "relation.added"))


def restored(snapshot: DataFrame, log: DataFrame, when_ns: int) -> DataFrame:
    """The live state from a snapshot and the events recorded after it: the older log is not read."""
    return live(snapshot.select(*EVENT).unionByName(log.where(F.col("recorded_at_ns") > when_ns).select(*EVENT)))


def tombstones(log: DataFrame, now_ns: int, ttl_ns: int = GRACE_NS, cap: int = TOMBSTONES) -> DataFrame:
    """(tenant, id, attributes, deleted_ns): deleted entities that are still readable at a time.

    They are so until the time to live after their deletion was recorded has passed, its last
    instant included, and while they are among the ``cap`` latest deletions of their tenant.
    Attributes are the last ones that were stated.
    """
    order = F.struct("recorded_at_ns", "seq")
    stated = ~F.col("change_type").isin("entity.unchanged", "entity.deleted")
    last = log.where(F.col("recorded_at_ns") <= now_ns).groupBy("tenant", "id").agg(
        F.max_by("change_type", order).alias("last_change"), F.max_by("attributes", F.when(stated, order)).alias("attributes"), F.max(order).alias("last")
    )
    gone = last.where("last_change = 'entity.deleted'").where(F.col("last.recorded_at_ns") + ttl_ns >= now_ns)
    # Spark cuts to the cap within tasks before the shuffle, so no task gets a whole tenant.
    newest = Window.partitionBy("tenant").orderBy(F.desc("last"))
    return gone.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= cap).select("tenant", "id", "attributes", F.col("last.recorded_at_ns").alias("deleted_ns"))
