from pyspark.sql import functions as F

from strandline.operators import conformance as C
from strandline.operators import describe

EDGE = "edge int, type string, confidence string, basis string"
PAIRS = "array<struct<key: string, value: string>>"
THING = f"thing int, identity {PAIRS}, attributes map<string, string>"
RECORD = f"record int, name string, type string, identity {PAIRS}, interval string, n_relationships int, instance string"


def told(df):
    return sorted((r[0], r["problem"]) for r in df.collect())


def test_beliefs(spark):
    rows = [(1, "same_as", "d:NaN", "serial"), (2, "same_as", "d:NaN", "rekey"), (3, "same_as", "d:+Inf", "rekey"), (4, "same_as", "b:true", "\t"), (5, "same_as", "d:0.2", "serial"),
            (6, "runs_on", None, None), (7, None, None, None), (8, "same_as", "i:1", "rekey"), (8, "same_as", "i:0", "rekey"), (9, "resolves_to", None, "dns")]
    got = told(C.belief_problems(spark.createDataFrame(rows, EDGE)))
    assert got == [(2, "confidence is not that of its basis"), (3, "confidence is outside [0, 1]"), (4, "confidence is no number"), (4, "no basis"), (8, "confidence is not that of its basis")]
    assert told(C.belief_problems(spark.createDataFrame([], EDGE))) == []


def test_spelling(spark):
    good, raw = "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "6ba7b8109dad11d180b400c04fd430c8"
    rows = [
        (1, [("host.id", f"s:{good}")], {"mac": "s:AA-BB-CC-DD-EE-FF", "host.id": f"s:{raw}", "interface.name": "s:eth0"}),
        (2, [("host.id", f"s:{good.upper()}")], None), (3, [("host.id", "i:12345678901234567890123456789012")], {"mac": "i:7"}), (4, None, {"": "s:x", "mac": "s:aa-bb-cc-dd-ee-ff"}),
        (5, [("network.device.id", "s:mac:AA-BB-CC-DD-EE-FF"), ("x", "k:0:")], {"network.device.id": "s:mac:"}), (6, [("host.id", f"s:{raw}\n")], {}),
    ]
    got = told(C.spelling_problems(spark.createDataFrame(rows, THING)))
    assert got == [(2, "upper-case host id"), (4, "empty key"), (4, "hardware address in another form"), (5, "hardware address in another form"), (5, "value is no scalar")]


def test_records(spark):
    own = [("host.id", "s:a")]
    rows = [(1, "entity.state", "s:host", own, "i:0", 2, "s:p"), (2, None, None, None, None, None, None), (3, "entity.delete", None, [], "s:60", 0, None), (4, "entity.state", "s:host", None, None, None, "i:1")]
    got = told(C.record_problems(spark.createDataFrame(rows, RECORD)))
    assert got == [(3, "anonymous producer"), (3, "identity is empty"), (3, "interval is no integer"), (3, "no type"), (3, "relationships on a delete"), (4, "anonymous producer"), (4, "no identity")]


def test_fleet_metrics(spark):
    things = spark.createDataFrame([("a", 1, "host"), ("b", 1, "host"), ("b", 2, "pod")], "tenant string, id int, type string")
    log = spark.createDataFrame([("a", 3), ("a", 9), ("b", 4)], "tenant string, seq int")
    boxes = spark.createDataFrame([("a", 1, "S-77", None), ("a", 2, " S-77", "x"), ("b", 3, "S-77", "y"), ("b", 4, "S-8", "y"), ("b", 5, None, None)], "tenant string, id int, serial string, vendor string")
    found = {(r["metric"], r["label"]): r["value"] for r in describe.fleet_metrics(things, things, log, boxes).collect()}
    assert found == {("entities", ""): 3, ("relations", ""): 3, ("events", ""): 13, ("serial_population", ""): 3, ("serial_overlaps", ""): 1, ("entities_by_type", "host"): 2, ("entities_by_type", "pod"): 1}
    none = describe.fleet_metrics(things.where(F.lit(False)), things.where(F.lit(False)), log.where(F.lit(False)), boxes.where(F.lit(False)))
    assert {r["value"] for r in none.collect()} == {0}
