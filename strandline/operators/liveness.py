"""Reference-counted liveness: a thing lives while any speaker holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import GRACE_NS, MAX_PROMISE_NS
from ..sources.log import written

FOREVER = (1 << 62) - 1
#: Edges of one entity that one task joins with its deletions.
HUB_EDGES = 1 << 14


def holds(observed: DataFrame) -> DataFrame:
    """(id, speaker, start, end, lapsed): how long each assertion holds.

    observed: (id, speaker, at_ns, seq, kind, interval_ns). A speaker's next word replaces the
    one before; an interval of 0, or over seven days, has no end of its own. A hold that lapses
    does so after everything at its deadline.
    """
    own = Window.partitionBy("id", "speaker").orderBy("at_ns", "seq")
    place = F.struct(F.col("at_ns").alias("t"), F.col("seq").alias("q"))
    promise = F.when(F.col("interval_ns") > MAX_PROMISE_NS, 0).otherwise(F.col("interval_ns"))
    deadline = F.struct((F.when(promise > 0, F.col("at_ns") + promise).otherwise(FOREVER)).alias("t"), F.lit(FOREVER).alias("q"))
    marked = observed.withColumns({"start": place, "next": F.lead(place).over(own), "deadline": deadline}).where("kind = 'state'")
    return marked.select("id", "speaker", promise.alias("interval_ns"), "start", F.least("deadline", F.coalesce("next", "deadline")).alias("end"), (F.coalesce("next", "deadline") >= F.col("deadline")).alias("lapsed"))


def lives(observed: DataFrame) -> DataFrame:
    """(id, life, start_ns, end_ns, ended_by): unions of holds over all speakers; end_ns is null while it lives.

    ended_by is producer or liveness_expiry. Lives less than the grace apart are one incarnation.
    """
    own = Window.partitionBy("id").orderBy("start", "end")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    islands = holds(observed).withColumn("reach", F.max("end").over(before))
    islands = islands.withColumn("new", (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).withColumn("life", F.sum("new").over(own))
    out = islands.groupBy("id", "life").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.max_by("lapsed", "end").alias("lapsed"))
    by_life = Window.partitionBy("id").orderBy("life")
    gap = F.col("s.t") - F.lag("e.t").over(by_life)
    incarnation = F.sum(F.coalesce((gap > GRACE_NS).cast("int"), F.lit(0))).over(by_life)
    open_ = F.col("e.t") >= FOREVER
    return out.select("id", "life", incarnation.alias("incarnation"), F.col("s.t").alias("start_ns"), F.when(~open_, F.col("e.t")).alias("end_ns"), F.when(~open_, F.when(F.col("lapsed"), "liveness_expiry").otherwise("producer")).alias("ended_by"))


def cascade(deleted: DataFrame, relations: DataFrame) -> DataFrame:
    """Deletes, for ``relation_events``, of all edges of deleted entities (tenant, id, event_time_ns, recorded_at_ns, seq), once a deletion."""
    stamp = ["tenant", "event_time_ns", "recorded_at_ns", "seq"]
    edges = written(relations.select("tenant", "type", "from_id", "to_id").distinct())
    once = deleted.select("id", *stamp).distinct()
    # An edge is met twice by one deletion only where the deletion has two ids.
    once = written(once.withColumn("shared", F.count("*").over(Window.partitionBy(*stamp)) > 1))
    both = _at_end(edges, once, "from_id").unionByName(_at_end(edges.where("from_id <> to_id"), once, "to_id"))
    if not once.where("shared").isEmpty():
        both = both.where("NOT shared").union(both.where("shared").distinct())
    return both.drop("shared").withColumns({"kind": F.lit("delete"), "delete_source": F.lit("cascade")})


def _at_end(edges: DataFrame, deleted: DataFrame, end: str) -> DataFrame:
    """Edges with each deletion of the entity at their ``end``; the edges of a hub are dealt out in parts, each with its deletions."""
    other = "to_id" if end == "from_id" else "from_id"
    parts = F.ceil(F.count("*") / HUB_EDGES).cast("int")
    hubs = F.broadcast(edges.groupBy("tenant", end).agg(parts.alias("parts")).where("parts > 1"))  # a row for HUB_EDGES edges at most
    of = F.coalesce("parts", F.lit(1))
    when = deleted.withColumnRenamed("id", end).join(hubs, ["tenant", end], "left").withColumn("part", F.explode(F.sequence(F.lit(0), of - 1))).drop("parts")
    dealt = edges.join(hubs, ["tenant", end], "left").withColumn("part", F.pmod(F.xxhash64("type", other), of).cast("int")).drop("parts")
    return dealt.join(when.hint("merge"), ["tenant", end, "part"]).select("tenant", "type", "from_id", "to_id", "event_time_ns", "recorded_at_ns", "seq", "shared")


def speakers(observed: DataFrame, now_ns: int) -> DataFrame:
    """(id, asserted_by, n_anonymous, interval_ns): who holds each thing at a time; unnamed speakers are only counted.

    interval_ns is the coarsest that a speaker who holds it has promised, null where none has.
    """
    held = holds(observed).where((F.col("start.t") <= now_ns) & (F.col("end.t") > now_ns))
    named = F.when(F.col("speaker") != "", F.col("speaker"))
    return held.groupBy("id").agg(F.array_sort(F.collect_set(named)).alias("asserted_by"), F.count_if(F.col("speaker") == "").alias("n_anonymous"), F.nullif(F.max("interval_ns"), F.lit(0)).alias("interval_ns"))


def saved(observed: DataFrame, at_ns: int) -> DataFrame:
    """(id, speaker, deadline_ns, interval_ns): the assertions held at a time; a deadline is null where nothing was promised."""
    last = observed.where(F.col("at_ns") <= at_ns).groupBy("id", "speaker").agg(F.max_by(F.struct("kind", "at_ns", "interval_ns"), F.struct("at_ns", "seq")).alias("r")).select("id", "speaker", "r.*")
    promise = F.when(F.col("interval_ns").between(1, MAX_PROMISE_NS), F.col("interval_ns"))
    held = last.where("kind = 'state'").select("id", "speaker", (F.col("at_ns") + promise).alias("deadline_ns"), F.coalesce(promise, F.lit(0)).alias("interval_ns"))
    return held.where(F.col("deadline_ns").isNull() | (F.col("deadline_ns") > at_ns))


def restored(held: DataFrame, now_ns: int) -> DataFrame:
    """Saved assertions after a pause: whoever promised gets one more interval from now at least, a promise too long is void."""
    void = F.col("interval_ns") > MAX_PROMISE_NS
    kept = F.when(void, 0).otherwise(F.coalesce("interval_ns", F.lit(0)))
    deadline = F.when(~F.coalesce(void, F.lit(False)), F.when((kept > 0) & F.col("deadline_ns").isNotNull(), F.greatest("deadline_ns", now_ns + kept)).otherwise(F.col("deadline_ns")))
    return held.withColumns({"deadline_ns": deadline, "interval_ns": kept})


def inherited(edges: DataFrame, held: DataFrame) -> DataFrame:
    """Edges (edge, from_id, speaker, at_ns, interval_ns) with the deadline they live by.

    Without an interval of its own an edge takes the deadline and interval by which its speaker
    holds its source; where the speaker does not hold the source there is none.
    """
    of = held.select(F.col("id").alias("from_id"), "speaker", F.col("deadline_ns").alias("__d"), F.col("interval_ns").alias("__i"))
    own = F.col("interval_ns") > 0
    out = edges.join(of, ["from_id", "speaker"], "left")
    deadline, interval = F.when(own, F.col("at_ns") + F.col("interval_ns")).otherwise(F.col("__d")), F.when(own, F.col("interval_ns")).otherwise(F.coalesce("__i", F.lit(0)))
    return out.select("edge", "from_id", "speaker", deadline.alias("deadline_ns"), interval.alias("interval_ns"))


def refused_promises(observed: DataFrame) -> DataFrame:
    """States whose interval is longer than any that is believed."""
    return observed.where((F.col("kind") == "state") & (F.col("interval_ns") > MAX_PROMISE_NS))
