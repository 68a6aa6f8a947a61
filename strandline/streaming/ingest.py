"""Classification of a stream of observations, with the last state of each entity as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import STATE_KEYS

#: Of the observations, and of the events that come out.
FIELDS = "tenant string, seq long, kind string, type string, id long, attributes map<string,string>, event_time_ns long, recorded_at_ns long, producer string, scope string"
EVENTS = "tenant string, id long, seq long, type string, attributes string, event_time_ns long, recorded_at_ns long, producer string, scope string, change_type string, changed_keys array<string>"


def _classify(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One entity's new observations, in order of arrival; what is remembered is its last attributes, or that it is gone."""
    live, old = state.get if state.exists else (False, "{}")
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["recorded_at_ns", "seq"], kind="stable")
    out = []
    for r in rows.to_dict("records"):
        new = r["attributes"]
        if r["kind"] == "delete":
            change, keys, after = ("entity.deleted" if live else None), [], False
        else:
            a, b, after = json.loads(old), json.loads(new), True
            keys = sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k)) if live else []
            change = "entity.created" if not live else "entity.unchanged" if not keys else "entity.state_changed" if set(keys) & set(STATE_KEYS) else "entity.attribute_updated"
        live, old = after, new
        if change:
            out.append((*key, r["seq"], r["type"], new, r["event_time_ns"], r["recorded_at_ns"], r["producer"], r["scope"], change, keys))
    state.update((live, old))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])


def classified(observed: DataFrame) -> DataFrame:
    """The change events of a stream of FIELDS; the same as the batch classification of all that came so far.

    A micro-batch is a commit; within an entity arrivals must come in order over batches.
    """
    narrow = observed.withColumn("attributes", F.to_json("attributes"))
    events = narrow.groupBy("tenant", "id").applyInPandasWithState(_classify, EVENTS, "live boolean, attributes string", "append", "NoTimeout")
    return events.withColumn("attributes", F.from_json("attributes", "map<string,string>"))


def subscribe(events: DataFrame, entity_type: str | None = None, change_types: list[str] | None = None) -> DataFrame:
    """What a subscriber asked for, of a stream or a batch of events; none are dropped."""
    if entity_type:
        events = events.where(F.col("type") == entity_type)
    return events.where(F.col("change_type").isin(*change_types)) if change_types else events


def ingest(observed: DataFrame, log_path: str, checkpoint: str):
    """Start the query that appends the events of a stream to the log; a batch is written once."""
    from ..sources.log import DAY_NS

    def commit(batch: DataFrame, number: int) -> None:
        dated = batch.withColumns({"commit_seq": F.lit(number), "event_day": F.floor(F.col("event_time_ns") / DAY_NS).cast("int")})
        # Its own folder for each batch: a batch that is run again overwrites what it wrote.
        dated.write.mode("overwrite").partitionBy("tenant", "event_day").parquet(f"{log_path}/commit={number}")

    return classified(observed).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).start()
