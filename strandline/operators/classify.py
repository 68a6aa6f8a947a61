"""Observations to change events: classification, removal by absence, aliases, parking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.vocabulary import CONFIDENCE, STATE_KEYS

ARRIVAL = ("recorded_at_ns", "seq")


def change_type(live: Column, changed: Column) -> Column:
    """Of a state observation: new, the same, a change of state, or of other attributes."""
    state = F.arrays_overlap(changed, F.array(*[F.lit(k) for k in STATE_KEYS]))
    return F.when(~live, "entity.created").when(F.size(changed) == 0, "entity.unchanged").when(state, "entity.state_changed").otherwise("entity.attribute_updated")


def entity_events(observed: DataFrame) -> DataFrame:
    """The change log of observations (tenant, id, kind, attributes, recorded_at_ns, seq, ...), one speaker for each.

    A state replaces all attributes; a delete of what does not live gives no event. Adds
    change_type and changed_keys; needs one shuffle on the identity.
    """
    own = Window.partitionBy("tenant", "id").orderBy(*ARRIVAL)
    before = F.lag("kind").over(own)
    old = F.lag("attributes").over(own)
    live = F.coalesce(before == "state", F.lit(False))
    marked = observed.withColumns({"__live": live, "__changed": F.when(live, V.changed_keys(old, F.col("attributes")))})
    kind = F.when(F.col("kind") == "state", change_type(F.col("__live"), F.coalesce("__changed", F.array().cast("array<string>")))).when(F.col("__live"), "entity.deleted")
    out = marked.withColumn("change_type", kind).where("change_type is not null")
    keys = F.when(F.col("kind") == "state", F.coalesce("__changed", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"changed_keys": keys, "record_kind": F.lit("entity"), "delete_source": F.when(F.col("change_type") == "entity.deleted", "producer")}).drop("__live", "__changed", "kind")


def relation_events(observed: DataFrame, entities: DataFrame) -> DataFrame:
    """Events of edges (type, from_id, to_id, attributes): added, changed, removed; the same again gives none.

    Rows are states, or by an optional kind also deletes: a producer's own, those of ``absences``
    and those of ``liveness.cascade``, with their delete_source. A delete of what does not live
    gives no event, and an edge that comes back is added again. Both ends must be entities; an
    edge of a missing end is left to ``parked``.
    """
    deletes = "kind" in observed.columns
    if not deletes:
        observed = observed.withColumn("kind", F.lit("state"))
    ids = entities.select("id")
    known = observed.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    own = Window.partitionBy("type", "from_id", "to_id").orderBy(*ARRIVAL, "kind")
    live = F.coalesce(F.lag("kind").over(own) == "state", F.lit(False))
    old = F.lag("attributes").over(own)
    changed = F.when(live & (F.col("kind") == "state"), V.changed_keys(old, F.col("attributes")))
    marked = known.withColumns({"__live": live, "changed_keys": changed})
    state = F.when(~F.col("__live"), "relation.added").when(F.size("changed_keys") > 0, "relation.attribute_changed")
    out = marked.withColumn("change_type", F.when(F.col("kind") == "state", state).when(F.col("__live"), "relation.removed")).where("change_type is not null")
    if deletes:
        said = F.col("delete_source") if "delete_source" in out.columns else F.lit(None).cast("string")
        out = out.withColumn("delete_source", F.when(F.col("change_type") == "relation.removed", F.coalesce(said, F.lit("producer"))))
    return out.drop("__live", "kind")


def removed_by_absence(reports: DataFrame, *more: str) -> DataFrame:
    """(producer, scope, source, seq, target): targets that the speaker's report before had and this one lacks.

    A report without targets (null or empty) removes all; ``more`` names columns of the report to keep.
    """
    own = Window.partitionBy("producer", "scope", "source").orderBy("seq")
    reports = reports.withColumn("targets", F.coalesce("targets", F.array().cast(reports.schema["targets"].dataType)))
    return reports.withColumn("gone", F.array_except(F.lag("targets").over(own), "targets")).select("producer", "scope", "source", "seq", *more, F.explode("gone").alias("target"))


def absences(reports: DataFrame) -> DataFrame:
    """``removed_by_absence`` as deletes for ``relation_events``: reports have tenant, type, event_time_ns and recorded_at_ns too."""
    gone = removed_by_absence(reports, "tenant", "type", "event_time_ns", "recorded_at_ns")
    return gone.select("tenant", "type", F.col("source").alias("from_id"), F.col("target").alias("to_id"), "event_time_ns", "recorded_at_ns", "seq", F.lit("delete").alias("kind"), F.lit("producer").alias("delete_source"))


def parked(edges: DataFrame, lives: DataFrame, patience_ns: int) -> DataFrame:
    """Edges whose end came late: ``waited_ns`` until the later end exists, null where none came within the patience.

    edges: (edge, from_id, to_id, at_ns); lives: (id, born_ns), each entity's first life.
    """
    born = lambda end: lives.select(F.col("id").alias(f"{end}_id"), F.col("born_ns").alias(f"{end}_born"))
    both = edges.join(born("from"), "from_id", "left").join(born("to"), "to_id", "left")
    ready = F.when(F.col("from_born").isNotNull() & F.col("to_born").isNotNull(), F.greatest("from_born", "to_born", "at_ns"))
    waited = ready - F.col("at_ns")
    return both.select("edge", "from_id", "to_id", "at_ns", F.when(waited <= patience_ns, waited).alias("waited_ns"))


def aliases(beliefs: DataFrame, identities: DataFrame) -> DataFrame:
    """(key, alias, canonical) from same_as beliefs between identities of one type that differ in exactly one text value.

    A value with two canonical ones is ambiguous and resolves to nothing.
    """
    strong = beliefs.where((F.col("type") == "same_as") & F.col("confidence").between(CONFIDENCE, 1.0))
    side = lambda p: identities.select(F.col("id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type"), F.col("identity").alias(p))
    both = strong.drop("type").join(side("from"), "from_id").join(side("to"), "to_id").where("from_type = to_type and size(from) = size(to)")
    differing = F.filter(F.zip_with("from", "to", lambda a, b: F.struct(a["key"].alias("key"), b["key"].alias("other"), a["value"].alias("canonical"), b["value"].alias("alias"))), lambda p: (p["key"] != p["other"]) | (p["canonical"] != p["alias"]))
    one = both.withColumn("d", differing).where("size(d) = 1 and d[0].key = d[0].other").select("d")
    found = one.select(F.col("d")[0].alias("p")).select("p.key", "p.canonical", "p.alias").where("canonical like 's:%' and alias like 's:%'")
    return found.groupBy("key", "alias").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("top")).where("canonical = top").drop("top")


def contested_names(named: DataFrame, within_ns: int) -> DataFrame:
    """Entities (id, name, at_ns, seq) whose name comes back after another one within the time: id and how often."""
    own = Window.partitionBy("id").orderBy("at_ns", "seq")
    runs = named.withColumn("before", F.lag("name").over(own)).where("before is null or before <> name")
    back = Window.partitionBy("id", "name").orderBy("at_ns", "seq")
    again = runs.withColumn("last_ns", F.lag("at_ns").over(back)).where(F.col("at_ns") - F.col("last_ns") <= within_ns)
    return again.groupBy("id").agg(F.count("*").alias("n_returns"))


def resolved_edges(edges: DataFrame, identities: DataFrame, known: DataFrame) -> DataFrame:
    """(edge, from_id, to_id, outcome) of edges (edge, type, from_type, from_identity, to_type, to_identity) between identities.

    An end is the entity (id, fingerprint) of its exact identity, else of the identity in which
    known aliases (key, alias, canonical) are put right. outcome: resolved, missing (an end is no
    entity), or collapsed (an alias made both ends one entity, which says nothing).
    """
    end = lambda p: F.struct(F.lit(p).alias("end"), F.col(f"{p}_type").alias("of"), F.col(f"{p}_identity").alias("identity"))
    ends = edges.select("edge", F.explode(F.array(end("from"), end("to"))).alias("r")).select("edge", "r.*")
    ids = identities.groupBy("fingerprint").agg(F.min("id").alias("id"))
    exact = ends.withColumn("fingerprint", V.fingerprint(F.col("of"), F.col("identity"))).join(ids, "fingerprint", "left")
    pairs = exact.where("id is null").select("edge", "end", "of", F.explode("identity").alias("p")).select("edge", "end", "of", "p.key", F.col("p.value").alias("alias"))
    put_right = pairs.join(known, ["key", "alias"], "left").groupBy("edge", "end", "of").agg(
        F.array_sort(F.collect_list(F.struct("key", F.coalesce("canonical", "alias").alias("value")))).alias("identity"), F.max(F.col("canonical").isNotNull()).alias("swapped")
    )  # an identity's few pairs
    put_right = put_right.where("swapped").withColumn("fingerprint", V.fingerprint(F.col("of"), F.col("identity"))).join(ids, "fingerprint")
    found = exact.where("id is not null").select("edge", "end", "id", F.lit(False).alias("swapped")).unionByName(put_right.select("edge", "end", "id", "swapped"))
    of_end = lambda p: F.max(F.when(F.col("end") == p, F.col("id")))
    both = found.groupBy("edge").agg(of_end("from").alias("from_id"), of_end("to").alias("to_id"), F.max("swapped").alias("swapped"))
    outcome = F.when(F.col("from_id").isNull() | F.col("to_id").isNull(), "missing").when(F.col("swapped") & (F.col("from_id") == F.col("to_id")), "collapsed").otherwise("resolved")
    return edges.select("edge").join(both, "edge", "left").select("edge", "from_id", "to_id", outcome.alias("outcome"))
