"""Keeping the log small: heartbeats coalesced, old events pruned behind baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import ENDS

ARRIVAL = ("recorded_at_ns", "seq")


def coalesced(log: DataFrame) -> DataFrame:
    """The log with each run of heartbeats of an entity cut to its first and last."""
    own = Window.partitionBy("tenant", "id").orderBy(*ARRIVAL)
    beat = F.col("change_type") == "entity.unchanged"
    near = lambda f: F.coalesce(f("change_type").over(own) == "entity.unchanged", F.lit(False))
    return log.withColumn("__inner", beat & near(F.lag) & near(F.lead)).where("not __inner").drop("__inner")


def _last(log: DataFrame) -> DataFrame:
    own = Window.partitionBy("tenant", "id").orderBy(*[F.desc(c) for c in ARRIVAL])
    return log.withColumn("__k", F.row_number().over(own))


def pruned(log: DataFrame, cutoff_ns: int) -> DataFrame:
    """Without what was recorded before the cutoff, but with the last event of everything that lives."""
    kept = (F.col("recorded_at_ns") >= cutoff_ns) | ((F.col("__k") == 1) & ~F.col("change_type").isin(*ENDS))
    return _last(log).where(kept).drop("__k")


def baselines(log: DataFrame, cutoff_ns: int) -> DataFrame:
    """What a pruning at the cutoff pins there: the latest state of everything that lives, was seen up to the cutoff, and whose last event is later.

    Entities and relations alike; the state is the present one, since the older events are what goes.
    """
    order = F.struct(*ARRIVAL)
    news = ~F.col("change_type").isin("entity.unchanged")
    last = log.groupBy("tenant", "id").agg(
        F.min("event_time_ns").alias("born"), F.max_by("change_type", order).alias("now"), F.max_by("event_time_ns", order).alias("newest"), F.max_by("attributes", F.when(news, order)).alias("attributes")
    )
    pinned = last.where((F.col("born") <= cutoff_ns) & ~F.col("now").isin(*ENDS) & (F.col("newest") > cutoff_ns))
    made = F.when(F.col("now").startswith("relation."), "relation.added").otherwise("entity.created")
    return pinned.select("tenant", "id", "attributes", made.alias("change_type"), F.lit(cutoff_ns).alias("event_time_ns"), F.lit(cutoff_ns).alias("recorded_at_ns"))


def horizon(old_ns: int | None, cutoff_ns: int, n_pruned: int) -> int | None:
    """The horizon after a pruning: it only moves if something went."""
    return max(cutoff_ns, old_ns or cutoff_ns) if n_pruned else old_ns
