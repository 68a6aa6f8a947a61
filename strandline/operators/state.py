"""Graph state folded from the log: now, as of an instant, as known at a time."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDS = ("entity.deleted", "relation.removed")


def _fold(log: DataFrame, order: Column) -> DataFrame:
    """The last word on each id; what it says of attributes is its last event that is no heartbeat."""
    news = F.col("change_type") != "entity.unchanged"
    last = log.groupBy("tenant", "id").agg(
        F.max_by("change_type", order).alias("last_change"), F.max_by("attributes", F.when(news, order)).alias("attributes"), F.max_by("seq", order).alias("seq"), F.max_by("event_time_ns", order).alias("event_time_ns")
    )
    return last.where(~F.col("last_change").isin(*ENDS))


def live(log: DataFrame) -> DataFrame:
    """What lives now, in order of arrival: partial aggregates, then one shuffle."""
    return _fold(log, F.struct("recorded_at_ns", "seq"))


def as_of(log: DataFrame, instant_ns: int, horizon_ns: int | None = None) -> DataFrame:
    """What lived at an instant, in order of event time; before the horizon the log can't tell."""
    if horizon_ns is not None and instant_ns < horizon_ns:
        raise ValueError("the log was pruned after that instant")
    return _fold(log.where(F.col("event_time_ns") <= instant_ns), F.struct("event_time_ns", "recorded_at_ns", "seq"))


def as_known(log: DataFrame, recorded_ns: int) -> DataFrame:
    """The log as it was at a time of recording."""
    return log.where(F.col("recorded_at_ns") <= recorded_ns)


def late_differences(log: DataFrame, instant_ns: int) -> DataFrame:
    """Ids on which arrival order and event order disagree: (id, live_attributes, as_of_attributes), null where it does not live."""
    a = live(log).select("tenant", "id", F.col("attributes").alias("live_attributes"))
    b = as_of(log, instant_ns).select("tenant", "id", F.col("attributes").alias("as_of_attributes"))
    same = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    return a.join(b, ["tenant", "id"], "full").where(~same("live_attributes").eqNullSafe(same("as_of_attributes")))


def page(entities: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """A page in the order of ``key``: only its rows leave the tasks."""
    rest = entities if after is None else entities.where(F.col(key) > after)
    return rest.orderBy(key).limit(max(1, min(size, 200)) if size > 0 else 50)


def connection(rows: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """A page in the order of ``key`` with a ``cursor`` for each row and ``has_next_page``; ``after`` is a cursor.

    One row more than the page tells whether there is a next one; no other leaves the tasks.
    """
    last = None if after is None else base64.b64decode(after).decode()
    size = max(1, min(size, 200)) if size > 0 else 50
    rest = rows if last is None else rows.where(F.col(key) > last)
    place = F.row_number().over(Window.orderBy(key))  # over a page's rows
    taken = rest.orderBy(key).limit(size + 1).withColumns({"__k": place, "__n": F.count("*").over(Window.partitionBy())})
    return taken.where(F.col("__k") <= size).withColumns({"cursor": F.base64(F.col(key).cast("binary")), "has_next_page": F.col("__n") > size}).drop("__k", "__n")
