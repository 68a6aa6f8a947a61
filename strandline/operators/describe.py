"""Summaries of the estate, overlays and checks: schema, types, overlaps, vocabulary, annotations, endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.vocabulary import ADVISORY, FROZEN


def type_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, type, n) of entities and relations."""
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(entities, "entity").union(count(relations, "relation"))


def key_usage(entities: DataFrame, entity_type: str, sample: int = 500) -> DataFrame:
    """(section, key, seen, example) over the first ``sample`` entities of a type by id (a report's limit)."""
    few = entities.where(F.col("type") == entity_type).orderBy("id").limit(sample)
    own = few.select("id", F.lit("identity").alias("section"), F.explode("identity").alias("p")).select("id", "section", "p.key", "p.value")
    more = few.select("id", F.lit("attributes").alias("section"), F.explode(F.map_entries("attributes")).alias("p")).select("id", "section", "p.key", "p.value")
    return own.union(more).groupBy("section", "key").agg(F.count("*").alias("seen"), V.display(F.min_by("value", "id")).alias("example"))


def relation_shapes(relations: DataFrame) -> DataFrame:
    """How often each type joins which types of ends."""
    return relations.groupBy("type", "from_type", "to_type", "structural").agg(F.count("*").alias("n"))


def serial_overlaps(devices: DataFrame, *by: str) -> DataFrame:
    """(serial, n_devices), within ``by`` such as a tenant, that several devices (id, serial, vendor) share, unless they name different vendors."""
    clean = devices.select(*by, "id", F.trim("serial").alias("serial"), F.nullif(F.lower(F.trim("vendor")), F.lit("")).alias("vendor")).where("length(serial) >= 4")
    return clean.groupBy(*by, "serial").agg(F.count_distinct("id").alias("n_devices"), F.count_distinct("vendor").alias("vendors")).where("n_devices > 1 and vendors < 2").drop("vendors")


def capped(counts: DataFrame, cap: int = 50) -> DataFrame:
    """The ``cap`` largest types (type, n), the rest summed as other; as many rows as there are types."""
    place = F.row_number().over(Window.orderBy(F.desc("n"), "type"))
    named = counts.withColumn("k", place).select(F.when(F.col("k") <= cap, F.col("type")).otherwise("other").alias("type"), "n")
    return named.groupBy("type").agg(F.sum("n").alias("n"))


def vocabulary_problems(rows: DataFrame, key: str) -> DataFrame:
    """(value, n) of a frozen attribute's values that its vocabulary lacks."""
    return rows.where(F.col("value").isNotNull() & ~F.col("value").isin(*FROZEN[key])).groupBy("value").agg(F.count("*").alias("n"))


def merged_annotations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two overlays (fingerprint, key, value, updated_at): the newer word wins, empty ones delete."""
    left, right = (d.select("fingerprint", "key", F.struct("updated_at", "value").alias(n)) for d, n in ((a, "x"), (b, "y")))
    best = left.join(right, ["fingerprint", "key"], "full").withColumn("w", F.greatest("x", "y"))
    return best.where("w.value <> ''").select("fingerprint", "key", "w.value", "w.updated_at")


def annotate(overlay: DataFrame, fingerprint: str, values: dict[str, str], at: int) -> DataFrame:
    """The overlay with values set; an empty one deletes its key."""
    spark = overlay.sparkSession
    new = spark.createDataFrame([(fingerprint, k, v, at) for k, v in values.items()], "fingerprint string, key string, value string, updated_at long")
    return merged_annotations(overlay, new)


def telemetry_keys(entities: DataFrame, ownership: DataFrame, keys: list[str]) -> DataFrame:
    """(id, key, value, source): an entity's join keys, from its identity, its attributes, then its owner's (id, owner)."""
    pairs = entities.select("id", F.lit(0).alias("place"), F.explode("identity").alias("p")).union(entities.select("id", F.lit(1), F.explode(F.map_entries("attributes"))))
    pairs = pairs.select("id", "place", "p.key", V.display(F.col("p.value")).alias("value")).where(F.col("key").isin(*keys))
    owned = ownership.join(pairs.withColumnRenamed("id", "owner"), "owner").select("id", (F.col("place") + 2).alias("place"), "key", "value")
    best = pairs.union(owned).groupBy("id", "key").agg(F.min(F.struct("place", "value")).alias("best"))
    source = F.element_at(F.array(*map(F.lit, ("identity", "attributes", "owner identity", "owner attributes"))), F.col("best.place") + 1)
    return best.select("id", "key", F.col("best.value").alias("value"), source.alias("source"))


def resolved_endpoints(endpoints: DataFrame, listeners: DataFrame, addresses: DataFrame, hosts: DataFrame) -> DataFrame:
    """(endpoint, target, how): what is behind an endpoint.

    endpoints: (endpoint, address, port, transport, scope); listeners: (listener, bind, port,
    transport, host); addresses: (address, host); hosts: (host). An endpoint with a scope, the
    host that it speaks of, is the listener on that host's port, else that host; nothing if the
    host is unknown. Any other is a listener bound to the address and port, else one on the
    port of the address's host, else that host. Transports only keep apart where both are stated.
    """
    least = lambda df, by, c: df.groupBy(*by).agg(F.min(c).alias(f"{c}_"))
    kinds = lambda by, name: listeners.groupBy(F.col(by).alias(f"{name}_at"), F.col("port").alias(f"{name}_port"), F.col("transport").alias(f"{name}_transport")).agg(F.min("listener").alias(name))

    def pick(df: DataFrame, at: str, by: str, name: str) -> DataFrame:
        """The least listener of each endpoint whose transport does not differ; as many rows as there are transports meet."""
        own = kinds(by, name)
        met = df.join(own, (df[at] == own[f"{name}_at"]) & (df["port"] == own[f"{name}_port"]))
        fits = met.where(F.col("transport").isNull() | F.col(f"{name}_transport").isNull() | (F.col("transport") == F.col(f"{name}_transport")))
        return df.join(fits.groupBy("endpoint").agg(F.min(name).alias(name)), "endpoint", "left")

    known = hosts.select(F.col("host").alias("scope")).distinct().withColumn("known", F.lit(True))
    out = endpoints.join(least(addresses, ["address"], "host"), "address", "left").join(known, "scope", "left")
    out = out.withColumn("at", F.when(F.col("scope").isNull(), F.col("host_")).when(F.col("known"), F.col("scope")))
    free = out.withColumn("address", F.when(F.col("scope").isNull(), F.col("address")))
    out = pick(pick(free, "address", "bind", "bound"), "at", "host", "near")
    how = F.when(F.col("bound").isNotNull(), "bind").when(F.col("near").isNotNull(), "port").when(F.col("at").isNotNull(), "host")
    return out.select("endpoint", F.coalesce("bound", "near", "at").alias("target"), how.alias("how"))


def attribute_problems(rows: DataFrame) -> DataFrame:
    """(key, value, problem, refused, n) of attributes (key, value in canonical form) that break a frozen vocabulary."""
    allowed = F
    for key, words in FROZEN.items():
        allowed = allowed.when(F.col("key") == key, F.col("text").isin(*words))
    judged = rows.where(F.col("key").isin(*FROZEN) & F.col("value").isNotNull()).withColumn("text", V.display(F.col("value"))).withColumn("allowed", allowed.otherwise(True))
    problem = F.when(~F.col("value").startswith("s:"), "no string").when(F.col("text") == "", "empty").when(~F.col("allowed"), "outside")
    told = judged.withColumn("problem", problem).where("problem is not null")
    return told.groupBy("key", F.col("text").alias("value"), "problem", (~F.col("key").isin(*ADVISORY)).alias("refused")).agg(F.count("*").alias("n"))


def vendor_hygiene(entities: DataFrame) -> DataFrame:
    """One row: population (entities with hw.vendor), non_normative (no string, blank, padded or with capitals), retired (still with vendor)."""
    either = lambda key: F.coalesce(F.get(F.filter("identity", lambda p: p["key"] == key), 0)["value"], F.try_element_at("attributes", F.lit(key)))
    v = entities.select(either("hw.vendor").alias("vendor"), either("vendor").alias("old")).withColumn("text", V.display(F.col("vendor")))
    good = F.col("vendor").startswith("s:") & (F.col("text") != "") & (F.col("text") == F.lower("text")) & (F.col("text") == F.trim("text"))
    return v.agg(F.count("vendor").alias("population"), F.count_if(F.col("vendor").isNotNull() & ~good).alias("non_normative"), F.count("old").alias("retired"))


def resolved_handles(handles: DataFrame, entities: DataFrame) -> DataFrame:
    """(handle, id): what a handle names, null for nothing.

    A handle is an id (without a colon), a fingerprint (type:hex), or an identity
    (type:key=value, more pairs after commas), whose values are matched as strings first and
    then by their text. An id is taken as it is.
    """
    kind, rest = F.substring_index("handle", ":", 1), F.expr("substring(handle, instr(handle, ':') + 1)")
    parsed = handles.select("handle", kind.alias("type"), rest.alias("rest"), F.col("handle").contains(":").alias("colon"))
    parsed = parsed.withColumn("form", F.when(~F.col("colon"), "id").when(~F.col("rest").contains("="), "fingerprint").otherwise("identity"))
    pairs = F.split("rest", ",")
    good = F.forall(pairs, lambda p: p.contains("=") & ~p.startswith("="))
    asked = parsed.where(F.col("form") == "identity").where(good).select("handle", "type", F.array_join(F.array_sort(pairs), ",").alias("text"))
    text = F.array_join(F.array_sort(F.transform("identity", lambda p: F.concat(p["key"], F.lit("="), V.display(p["value"])))), ",")
    strings = F.forall("identity", lambda p: p["value"].startswith("s:"))
    shown = entities.select("type", text.alias("text"), F.struct((~strings).alias("late"), F.col("id").cast("string").alias("id")).alias("best")).groupBy("type", "text").agg(F.min("best.late").alias("late"), F.min("best").alias("best"))
    by_identity = asked.join(shown, ["type", "text"]).select("handle", F.col("best.id").alias("id"))
    by_print = parsed.where("form = 'fingerprint'").join(entities.select(F.col("fingerprint").alias("handle"), F.col("id").cast("string").alias("id")), "handle").groupBy("handle").agg(F.min("id").alias("id"))
    as_is = parsed.where("form = 'id'").select("handle", F.col("handle").alias("id"))
    return handles.select("handle").join(by_identity.union(by_print).union(as_is), "handle", "left")


def entity_cards(entities: DataFrame, relations: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """(id, type, fingerprint, name, n_out, n_in) of entities: what a reader of one entity gets; the name is a type's first attribute with a text, else the fingerprint."""
    count = lambda end, n: relations.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(n))
    out = entities.join(count("from_id", "n_out"), "id", "left").join(count("to_id", "n_in"), "id", "left")
    name = F.coalesce(V.display_name(F.col("type"), F.col("attributes"), names), "fingerprint")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select("id", "type", "fingerprint", name.alias("name"), zero("n_out"), zero("n_in"))


def fleet_metrics(entities: DataFrame, relations: DataFrame, log: DataFrame, devices: DataFrame) -> DataFrame:
    """(metric, label, value) over all tenants; label is a type or empty.

    entities (tenant, id, type), relations, log (tenant, seq), devices (tenant, id, serial,
    vendor). Tenants are summed: events by each one's newest sequence number, and serials are
    compared within a tenant only, as estates that never met may have the same.
    """
    row = lambda df, name, value: df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("label"), "value")
    every = F.count("*")
    serials = devices.where("length(trim(serial)) >= 4").select("tenant", "id").distinct()
    by_type = capped(entities.groupBy("type").agg(every.alias("n"))).select(F.lit("entities_by_type"), "type", "n")
    out = row(entities, "entities", every).union(row(relations, "relations", every)).union(row(serials, "serial_population", every)).union(by_type)
    out = out.union(row(log.groupBy("tenant").agg(F.max("seq").alias("n")), "events", F.sum("n")))
    return out.union(row(serial_overlaps(devices, "tenant"), "serial_overlaps", every))
