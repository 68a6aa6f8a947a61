"""What is wrong with a producer's records: their form, their beliefs, and how they spell what is joined on.

Every check reads a row alone, so that a batch of any size is one scan without a shuffle. An
advisory problem is told and does not refuse the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

# Names and rules that answers depend on.
ENTITY_EVENTS = ("entity.state", "entity.delete")
#: Bases of a belief that always carry this confidence.
EXACT_BASES = {"rekey": 1.0, "k8s_api": 1.0, "vm_id_match": 1.0}
#: Spellings that may describe a thing and not identify it -> the one that may.
RETIRED_KEYS = {"interface.name": "network.interface.name"}
RAW_MACHINE_ID = r"^[0-9A-Fa-f]{32}\z"
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z"


def _told(rows: DataFrame, keep: list[str], *problems: tuple[Column, str, bool]) -> DataFrame:
    """The columns ``keep`` with ``problem`` and ``advisory``, for each condition that holds of a row."""
    found = [F.when(when, F.struct(F.lit(name).alias("problem"), F.lit(advisory).alias("advisory"))) for when, name, advisory in problems]
    return rows.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("p")).select(*keep, "p.problem", "p.advisory")


def belief_problems(edges: DataFrame) -> DataFrame:
    """(edge, problem, advisory) of edges (edge, type, confidence in canonical form, basis).

    A same_as edge needs a number in [0, 1] as confidence, and the fixed one where its basis
    has one, or nothing collapses; without a basis no reader can judge it. A confidence of
    resolves_to is read by nothing. Other types have no beliefs.
    """
    same = F.col("type") == "same_as"
    given = F.col("confidence").isNotNull()
    number = F.when(F.col("confidence").rlike("^[di]:"), F.expr("try_cast(substring(confidence, 3) as double)"))
    outside = number.isNotNull() & ~F.isnan(number) & ((number < 0) | (number > 1))
    fixed = F.lit(None).cast("double")
    for basis, value in EXACT_BASES.items():
        fixed = F.when(F.col("basis") == basis, value).otherwise(fixed)
    return _told(
        edges, ["edge"],
        (same & F.coalesce("basis", F.lit("")).rlike(r"^\s*$"), "no basis", True),
        (same & ~given, "no confidence", False),
        (same & given & number.isNull(), "confidence is no number", False),
        (same & outside, "confidence is outside [0, 1]", False),
        (same & ~outside & (number != fixed), "confidence is not that of its basis", False),
        ((F.col("type") == "resolves_to") & given, "confidence is read by nothing", True),
    )


def _spelling(pairs: DataFrame) -> DataFrame:
    """The problems of (thing, field, key, value) as to how ids and hardware addresses are written."""
    text, is_text = V.display(F.col("value")), F.col("value").startswith("s:")
    own = F.col("field") == "identity"
    host = own & (F.col("key") == "host.id") & is_text
    mac = F.when(F.col("key") == "mac", text).when((F.col("key") == "network.device.id") & text.startswith("mac:"), F.substring(text, 5, 2**31 - 1))
    return _told(
        pairs, ["thing", "field", "key"],
        (host & text.rlike(RAW_MACHINE_ID), "raw machine id", False),
        (host & text.rlike(UUID) & text.rlike("[A-F]"), "upper-case host id", False),
        (is_text & ~V.is_mac(mac), "hardware address in another form", False),
        (own & F.col("key").isin(*RETIRED_KEYS), "retired key in an identity", False),
        (own & F.col("value").rlike("^[ak]:"), "value is no scalar", False),
        (F.col("key") == "", "empty key", False),
    )


def spelling_problems(things: DataFrame) -> DataFrame:
    """(thing, field, key, problem, advisory) of things (thing, identity, attributes).

    field is identity or attributes. A host.id is a lower-case UUID with hyphens, a hardware
    address six upper-case octets with hyphens wherever it stands, and an identity holds
    scalars under keys that are not retired. Null identities and attributes have no problems.
    """
    own = things.select("thing", F.lit("identity").alias("field"), F.explode("identity").alias("p"))
    more = things.select("thing", F.lit("attributes").alias("field"), F.explode(F.map_entries("attributes")).alias("p"))
    return _spelling(own.union(more).select("thing", "field", "p.key", "p.value"))


def record_problems(records: DataFrame) -> DataFrame:
    """(record, problem, advisory) of records (record, name, type, identity, interval, n_relationships, instance).

    type, interval and instance (the producer's instance id) are values in canonical form, null
    where absent; n_relationships is null where the record has no relationships. Records other
    than those of entities are passed over.
    """
    text = lambda c: F.col(c).startswith("s:")
    ours = records.where(F.col("name").isin(*ENTITY_EVENTS))
    interval = F.when(F.col("interval").startswith("i:"), F.expr("try_cast(substring(interval, 3) as bigint)"))
    return _told(
        ours, ["record"],
        (F.col("type").isNull(), "no type", False),
        (~text("type"), "type is no string", False),
        (F.col("type") == "s:", "type is empty", False),
        (F.col("identity").isNull(), "no identity", False),
        (F.size("identity") == 0, "identity is empty", False),
        (~F.col("interval").startswith("i:"), "interval is no integer", False),
        (interval < 0, "interval is negative", False),
        ((F.col("name") == "entity.delete") & F.col("n_relationships").isNotNull(), "relationships on a delete", False),
        (~F.coalesce(text("instance") & (F.col("instance") != "s:"), F.lit(False)), "anonymous producer", True),
    )
