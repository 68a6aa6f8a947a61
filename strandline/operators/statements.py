"""What an answer says about itself: how far a window reaches, who carries a key, and counts of what came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import rfc3339


def window_reach(start: Column, end: Column, horizon: Column) -> tuple[Column, Column]:
    """How much of a window retention has left (whole, partial or empty), and from when on it can be answered, as text."""
    cut = F.coalesce(start < horizon, F.lit(False))
    reach = F.when(~cut, "whole").when(end <= horizon, "empty").otherwise("partial")
    return reach, F.when(reach != "empty", rfc3339(F.when(cut, horizon).otherwise(start)))


def key_carriers(entities: DataFrame) -> DataFrame:
    """(key, types, n): the types whose entities carry a key in identity or attributes, and how many entities do."""
    keys = F.array_distinct(F.concat(F.coalesce(F.transform("identity", lambda p: p["key"]), F.array()), F.coalesce(F.map_keys("attributes"), F.array())))
    by_type = entities.select("type", F.explode(keys).alias("key")).groupBy("key", "type").agg(F.count("*").alias("n"))
    return by_type.groupBy("key").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("n").alias("n"))  # types are few


def ingest_counters(records: DataFrame) -> DataFrame:
    """(tenant, counter, n) of records (tenant, name, refused, unknown_type, n_dropped); a tenant once seen has every counter.

    Records that are no entity events are ignored and count nowhere else; a refused one is rejected,
    any other is handled. Nulls count as no.
    """
    entity = F.coalesce(F.col("name").isin("entity.state", "entity.delete"), F.lit(False))
    refused = F.coalesce("refused", F.lit(False))
    counted = {
        "handled": F.count_if(entity & ~refused), "ignored": F.count_if(~entity), "rejected": F.count_if(entity & refused),
        "values_dropped": F.sum(F.when(entity, F.coalesce("n_dropped", F.lit(0))).otherwise(0)), "unknown_types": F.count_if(entity & ~refused & F.coalesce("unknown_type", F.lit(False))),
    }
    sums = records.groupBy("tenant").agg(*[c.cast("long").alias(k) for k, c in counted.items()])
    return sums.select("tenant", F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.col(k).alias("n")) for k in counted])).alias("r")).select("tenant", "r.*")


def discards(found: DataFrame, at: str, *by: str) -> DataFrame:
    """What was discarded, refused or in conflict: total and last_ns for each value of ``by``."""
    return found.groupBy(*by).agg(F.count("*").alias("total"), F.max(at).alias("last_ns"))


def fleet_totals(tenants: DataFrame) -> DataFrame:
    """One row over tenants (entities, relations, seq, snapshot_seq, horizon_ns): sums, but the highest snapshot and the latest horizon."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entities", "relations", "seq")]
    return tenants.agg(*sums, F.coalesce(F.max("snapshot_seq"), F.lit(0)).alias("snapshot_seq"), F.max("horizon_ns").alias("horizon_ns"))
