"""Window folds over the log: recent changes, histories, net differences, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import structural

HEARTBEAT = "entity.unchanged"


def window(log: DataFrame, start_ns: int, end_ns: int, closed: bool) -> DataFrame:
    """[start, end], or [start, end) if it is not closed."""
    t = F.col("event_time_ns")
    return log.where((t >= start_ns) & ((t <= end_ns) if closed else (t < end_ns)))


def recent_changes(log: DataFrame, start_ns: int, end_ns: int, change_type: str | None = None, scope: str | None = None, heartbeats: bool = False) -> DataFrame:
    """Changes of a closed window, newest first; an explicit type wins over leaving out heartbeats."""
    found = window(log, start_ns, end_ns, True)
    if change_type:
        found = found.where(F.col("change_type") == change_type)
    elif not heartbeats:
        found = found.where(F.col("change_type") != HEARTBEAT)
    if scope:
        found = found.where(F.col("scope") == scope)
    return found.orderBy(F.desc("event_time_ns"), F.desc("seq"))


def history(log: DataFrame, ids: list | None = None, since_ns: int | None = None, until_ns: int | None = None, known_ns: int | None = None) -> DataFrame:
    """The events of some entities, or of all, on both axes of time, oldest first."""
    found = log if ids is None else log.where(F.col("id").isin(*ids))
    for c, op in ((since_ns, ">="), (until_ns, "<=")):
        if c is not None:
            found = found.where(f"event_time_ns {op} {c}")
    if known_ns is not None:
        found = found.where(F.col("recorded_at_ns") <= known_ns)
    return found.orderBy("event_time_ns", "seq")


def tally(log: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Numbers of changes by type, heartbeats too."""
    return window(log, start_ns, end_ns, True).groupBy("change_type").agg(F.count("*").alias("n"))


def net_changes(log: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """What a half-open window did to each id: created, deleted, changed or transient, with the changed keys.

    Heartbeats do not count. A thing that was there, went and came back shows only if keys changed.
    """
    found = window(log, start_ns, end_ns, False).where(F.col("change_type") != HEARTBEAT)
    order = F.struct("event_time_ns", "seq")
    begins, ends = F.col("change_type").isin("entity.created", "relation.added"), F.col("change_type").isin("entity.deleted", "relation.removed")
    life = F.when(begins | ends, order)
    folded = found.groupBy("tenant", "id").agg(
        F.min_by(begins, order).alias("began"), F.max_by(ends, life).alias("gone"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("changed_keys")))).alias("changed_keys"),
        F.coalesce(F.bool_or(F.col("change_type") == "entity.state_changed"), F.lit(False)).alias("state"), F.min(order).alias("__first"),
    )
    gone = F.coalesce("gone", F.lit(False))
    kind = F.when(F.col("began") & ~gone, "created").when(F.col("began") & gone, "transient").when(gone, "deleted").when(F.size("changed_keys") > 0, "changed")
    return folded.withColumn("outcome", kind).where("outcome is not null").drop("began", "gone", "__first")


def digest(log: DataFrame, start_ns: int, end_ns: int, examples: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Changes of a closed window in groups of one shape: number, first and last time, newest examples, a stable id.

    ``by`` names columns whose values are scopes with a digest each. The examples are cut by rank before they are collected, so that no group gathers in a task.
    """
    shape = [*by, "change_type", "type", "keys", "scope", "delete_source"]
    found = window(log, start_ns, end_ns, True).where(F.col("change_type") != HEARTBEAT)
    found = found.withColumns({"keys": F.array_join(F.array_sort("changed_keys"), ","), "delete_source": F.coalesce("delete_source", F.lit(""))})
    # Partial top-k: ranks within a salted part first, then among what is left.
    salted = Window.partitionBy(*shape, F.pmod(F.xxhash64("id", "seq"), F.lit(64))).orderBy(F.desc("event_time_ns"), F.desc("seq"))
    few = found.withColumn("__k", F.row_number().over(salted)).where(F.col("__k") <= examples)
    newest = Window.partitionBy(*shape).orderBy(F.desc("event_time_ns"), F.desc("seq"))
    few = few.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= examples).groupBy(*shape).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "seq"))), lambda x: x["seq"].cast("string")), ",").alias("examples"))
    counted = found.groupBy(*shape).agg(F.count("*").alias("n"), F.min("event_time_ns").alias("first_ns"), F.max("event_time_ns").alias("last_ns"))
    group = F.substring(F.sha2(F.concat_ws("|", *shape, F.lit(str(start_ns)), F.lit(str(end_ns))), 256), 1, 16)
    return counted.join(few, shape).withColumn("group_id", group)


def touching(log: DataFrame, scope: DataFrame) -> DataFrame:
    """The events of the entities (id) in ``scope``."""
    return log.join(scope.select("id").distinct(), "id", "left_semi")


def timeline(entity_log: DataFrame, relation_log: DataFrame, kind: str = "all") -> DataFrame:
    """Events by the entity they touch (entity, thing, change_type, both times, seq): its own, and those of edges at either end, a loop once.

    ``kind`` is all, entity, relation or structural (edges of structural types).
    """
    own = entity_log.select(F.col("id").alias("entity"), F.col("id").cast("string").alias("thing"), "change_type", "event_time_ns", "recorded_at_ns", "seq")
    edges = relation_log if kind != "structural" else relation_log.where(structural(F.col("type")))
    ends = F.array_distinct(F.array("from_id", "to_id"))
    theirs = edges.select(F.explode(ends).alias("entity"), F.concat_ws(">", "type", "from_id", "to_id").alias("thing"), "change_type", "event_time_ns", "recorded_at_ns", "seq")
    if kind == "entity":
        return own
    return theirs if kind in ("relation", "structural") else own.unionByName(theirs)
