import json

from pyspark.sql import functions as F

from strandline.functions import values as V
from strandline.sources import log, otlp


def test_composite_values_have_their_lengths(spark):
    one = F.array(V.string(F.lit("é")), V.integer(F.lit(12)))
    pairs = F.array(F.struct(F.lit("b").alias("key"), V.boolean(F.lit(True)).alias("value")), F.struct(F.lit("a").alias("key"), V.integer(F.lit(1)).alias("value")))
    got = spark.range(1).select(V.array(one).alias("a"), V.kvlist(pairs).alias("k"), V.array(F.expr("cast(array() as array<string>)")).alias("n")).first()
    assert list(got) == ["a:2:4:s:é4:i:12", "k:2:1:a3:i:11:b6:b:true", "a:0:"]


def test_descriptions_keep_arrays_and_lists(spark, tmp_path):
    pair = lambda k, v: {"key": k, "value": v}
    kv = lambda *p: {"kvlistValue": {"values": list(p)}}
    about = kv(pair("ips", {"arrayValue": {"values": [{"stringValue": "10.0.0.1"}, {"intValue": "7"}]}}), pair("tags", kv(pair("env", {"stringValue": "x"}))), pair("os", {"stringValue": "linux"}))
    record = {"timeUnixNano": "5", "eventName": "entity.state", "attributes": [pair("entity.type", {"stringValue": "host"}), pair("entity.id", kv(pair("host.id", {"stringValue": "h"}))), pair("entity.description", about)]}
    (tmp_path / "x.json").write_text(json.dumps({"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [record]}]}]}))
    row = otlp.observations(otlp.read(spark, str(tmp_path)), 9).first()
    assert row["attributes"] == {"ips": "a:2:10:s:10.0.0.13:i:7", "tags": "k:1:3:env3:s:x", "os": "s:linux"} and row["problem"] is None


def test_events_that_touch_an_entity(spark):
    own = spark.createDataFrame([("7", 1), ("8", 2)], "id string, seq long")
    assert [r["seq"] for r in log.touching(own, "7").collect()] == [1]
    edges = spark.createDataFrame([("e", 1, "7", "8"), ("f", 2, None, "9")], "id string, seq long, from_id string, to_id string")
    assert [r["seq"] for r in log.touching(edges, "8").collect()] == [1]
