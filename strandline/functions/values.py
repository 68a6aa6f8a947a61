"""Typed values as canonical strings, identities and what is computed from them.

A value is held in its canonical form, one letter for the kind and a colon before the text
(s: string, i: integer, d: double, b: boolean, a: array, k: map); attributes are maps of such.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KV = "array<struct<key: string, value: string>>"
_UNIT, _RECORD = "\x1f", "\x1e"


def string(c: Column) -> Column:
    return F.concat(F.lit("s:"), c.cast("string"))


def integer(c: Column) -> Column:
    return F.concat(F.lit("i:"), c.cast("bigint").cast("string"))


def boolean(c: Column) -> Column:
    return F.concat(F.lit("b:"), c.cast("string"))


def double(c: Column) -> Column:
    """Shortest digits, with an exponent below 1e-4 and from 1e6 on, and no trailing zero fraction."""
    text = c.cast("string")  # shortest digits too, but with an exponent from 1e7 on only
    whole = F.regexp_extract(text, r"^-?(\d+)", 1)
    sign = F.when(c < 0, "-").otherwise("")
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.length(whole) - 1)
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"^-|\.", ""), r"0+$", "")
    rest = F.substring(digits, 2, 400)
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    exponent = F.concat(sign, mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
    special = F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf")
    shown = F.when(special.isNotNull(), special).when(c == 0, F.when(text.startswith("-"), "-0").otherwise("0"))
    shown = shown.when((F.abs(c) >= 1e6) | ((power < -4) & text.contains("E")), exponent).when(text.contains("E"), small).otherwise(F.regexp_replace(text, r"\.0$", ""))
    return F.concat(F.lit("d:"), shown)


def array(elements: Column) -> Column:
    """An array of values in canonical form, each with its length in bytes before it."""
    return F.concat(F.lit("a:"), F.size(elements).cast("string"), F.lit(":"), F.array_join(F.transform(elements, _sized), ""))


def kvlist(pairs: Column) -> Column:
    """A list of (key, value), sorted by key, with the length of each key and value before it."""
    rows = F.transform(F.array_sort(pairs), lambda p: F.concat(_sized(p["key"]), _sized(p["value"])))
    return F.concat(F.lit("k:"), F.size(pairs).cast("string"), F.lit(":"), F.array_join(rows, ""))


def _sized(text: Column) -> Column:
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def display(value: Column) -> Column:
    """The untagged text: "1" and 1 are alike."""
    return F.substring(value, 3, 2**31 - 1)


def identity(**keys: Column) -> Column:
    """An identity, sorted by key; underscores in names stand for dots."""
    pairs = sorted((k.replace("_", "."), v) for k, v in keys.items())
    return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])


def fingerprint(entity_type: Column, pairs: Column) -> Column:
    """type:hex of the type and the sorted key-value pairs; names the thing, not its incarnation."""
    rows = F.transform(F.array_sort(pairs), lambda p: F.concat(p["key"], F.lit(_RECORD), p["value"], F.lit(_UNIT)))
    return F.concat(entity_type, F.lit(":"), F.substring(F.sha2(F.concat(entity_type, F.lit(_UNIT), F.array_join(rows, "")), 256), 1, 32))


def relation_id(relation_type: Column, from_id: Column, to_id: Column) -> Column:
    """One id for each (type, from, to)."""
    text = F.concat(relation_type, F.lit(_UNIT), from_id.cast("string"), F.lit(_UNIT), to_id.cast("string"))
    return F.concat(relation_type, F.lit(":"), F.substring(F.sha2(text, 256), 1, 32))


def incarnation_id(tenant: Column, fp: Column, number: Column) -> Column:
    """A reproducible logical id, new for each life of the thing."""
    return F.substring(F.sha2(F.concat_ws(_UNIT, tenant, fp, number.cast("string")), 256), 1, 26)


def changed_keys(old: Column, new: Column) -> Column:
    """Keys whose values differ or that only one side has, sorted."""
    both = F.map_filter(F.map_zip_with(old, new, lambda k, a, b: ~a.eqNullSafe(b)), lambda k, changed: changed)
    return F.array_sort(F.map_keys(both))


def attribute(attributes: Column, key: str) -> Column:
    return display(F.try_element_at(attributes, F.lit(key)))


def matches(pairs: Column, attributes: Column, **wanted: str) -> Column:
    """Every key has the wanted text in the identity or in the attributes."""
    out = F.lit(True)
    for k, v in wanted.items():
        key = k.replace("_", ".")
        out &= F.exists(pairs, lambda p: (p["key"] == key) & (display(p["value"]) == v)) | F.coalesce(attribute(attributes, key) == v, F.lit(False))
    return out


def display_name(entity_type: Column, attributes: Column, rules: dict[str, list[str]]) -> Column:
    """The first attribute with a text, in the order that ``rules`` has for the type."""
    out = F
    for t, keys in rules.items():
        out = out.when(entity_type == t, F.coalesce(*[F.nullif(attribute(attributes, k), F.lit("")) for k in keys]))
    return out.otherwise(F.lit(None).cast("string"))


def endpoint_name(address: Column, port: Column) -> Column:
    """host:port, with brackets around an IPv6 address."""
    return F.concat(F.when(address.contains(":"), F.concat(F.lit("["), address, F.lit("]"))).otherwise(address), F.lit(":"), port.cast("string"))


def tenant_name(raw: Column) -> Column:
    """The tenant's name: blank is `default`; null where it is none."""
    name = F.trim(raw)
    return F.when(F.coalesce(name, F.lit("")) == "", "default").when(name.rlike(r"^[A-Za-z0-9._-]{1,64}\z"), name)


def is_mac(c: Column) -> Column:
    return c.rlike(r"^([0-9A-F]{2}-){5}[0-9A-F]{2}\z")


def rfc3339(ns: Column) -> Column:
    """Nanoseconds since 1970 as UTC text, fractions without trailing zeros; the session's time zone does not matter."""
    second, fraction = F.lit(10**9), F.pmod(ns, F.lit(10**9))
    seconds = F.call_function("div", ns - fraction, second)
    of_day = F.pmod(seconds, F.lit(86_400))
    days = F.call_function("div", seconds - of_day, F.lit(86_400))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    whole = F.timestamp_add("SECOND", of_day.cast("int"), F.timestamp_add("DAY", days.cast("int"), epoch)).cast("string")
    digits = F.rtrim(F.lpad(fraction.cast("string"), 9, "0"), F.lit("0"))
    return F.concat(F.replace(whole, F.lit(" "), F.lit("T")), F.when(fraction > 0, F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z"))


def parse_rfc3339(text: Column) -> Column:
    """Nanoseconds since 1970 of a time such as 2024-01-31T10:00:00.5+02:00; null for any other text."""
    pattern = r"^(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|([+-])(\d\d):(\d\d))\z"
    part = lambda i: F.regexp_extract(text, pattern, i)
    local = F.concat_ws(" ", part(1), part(2)).try_cast("timestamp_ntz")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ahead = F.when(part(5) == "", 0).otherwise((part(6).try_cast("int") * 60 + part(7).try_cast("int")) * F.when(part(5) == "-", -60).otherwise(60))
    return F.when(text.rlike(pattern), (F.timestamp_diff("SECOND", epoch, local) - ahead) * 10**9 + F.rpad(part(3), 9, "0").cast("long"))
