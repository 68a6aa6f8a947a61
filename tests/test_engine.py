import json

from pyspark.sql import functions as F

from strandline.functions import values as V
from strandline.operators import classify, liveness, state, traverse
from strandline.sources import log, otlp
from strandline.streaming import ingest


def first(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_fingerprints_are_the_golden_ones(spark):
    s, i = (lambda x: V.string(F.lit(x))), (lambda x: V.integer(F.lit(x)))
    got = first(
        spark,
        V.fingerprint(F.lit("host"), V.identity(host_id=s("6a6d1121-4a85-4e64-a222-746f7bc9c04c"))).alias("a"),
        V.fingerprint(F.lit("service.listener"), V.identity(service_endpoint=s("h1:80/tcp"), network_transport=s("tcp"))).alias("b"),
        V.fingerprint(F.lit("container"), V.identity(container_id=i(42))).alias("c"),
        V.fingerprint(F.lit("db"), V.identity(db_instance_id=s("pg@h1"), port=i(5432), tls=V.boolean(F.lit(True)), weight=V.double(F.lit(1.5)))).alias("d"),
    )
    assert list(got) == ["host:c43f05d286094e40204660d8ac47eae3", "service.listener:1a012b4f4755c045bb412d5f71608eb6", "container:60370d13f4848f0941f78dc349c6fee3", "db:c22686805188f805a076409f8ae180d2"]


def test_doubles(spark):
    got = first(spark, *[V.display(V.double(F.lit(x))).alias(f"x{k}") for k, x in enumerate([1.0, 1.5, 0.0, 1e21, 1e-7, 123456789.0, 2.5e20, 0.001, 1e6, 999999.5, 1234567.5, -1e7, 0.0001, -0.00012, 0.00001])])
    assert list(got) == ["1", "1.5", "0", "1e+21", "1e-07", "1.23456789e+08", "2.5e+20", "0.001", "1e+06", "999999.5", "1.2345675e+06", "-1e+07", "0.0001", "-0.00012", "1e-05"]


def observed(spark, rows):
    made = [("default", q, kind, "host", i, attrs, q * 10, q * 10, "", "") for q, kind, i, attrs in rows]
    return spark.createDataFrame(made, ingest.FIELDS)


ROWS = [
    (1, "state", 7, {"status": "s:up"}), (2, "state", 7, {"status": "s:up"}), (3, "state", 7, {"status": "s:down"}), (4, "state", 7, {"status": "s:down", "os": "s:x"}),
    (5, "delete", 7, None), (6, "delete", 7, None), (7, "state", 7, {"os": "s:x"}), (8, "state", 8, {}), (9, "state", 7, {}),
]


def test_classification(spark):
    got = [(r["seq"], r["change_type"], r["changed_keys"]) for r in classify.entity_events(observed(spark, ROWS)).orderBy("seq").collect()]
    assert got == [
        (1, "entity.created", []), (2, "entity.unchanged", []), (3, "entity.state_changed", ["status"]), (4, "entity.attribute_updated", ["os"]),
        (5, "entity.deleted", []), (7, "entity.created", []), (8, "entity.created", []), (9, "entity.attribute_updated", ["os"]),
    ]


def test_a_stream_classifies_as_a_batch_does(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "log")
    rows = observed(spark, [r if r[3] is not None else (*r[:3], {}) for r in ROWS])
    for k in range(3):
        rows.where(f"seq between {3 * k + 1} and {3 * k + 3}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest.ingest(stream, out, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    columns = ["seq", "id", "change_type", "changed_keys"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    assert got == sorted(map(tuple, classify.entity_events(rows).select(*columns).collect()))
    few = ingest.subscribe(classify.entity_events(rows), "host", ["entity.deleted"])
    assert [r["seq"] for r in few.collect()] == [5]


def test_refcount_and_expiry(spark):
    s = 10**9
    rows = [("db", "A", 0, 1, "state", 60 * s), ("db", "B", 0, 2, "state", 60 * s), ("db", "B", 50 * s, 3, "state", 60 * s), ("x", "A", 0, 4, "state", 0), ("x", "B", 1, 5, "state", 0), ("x", "A", 5, 6, "delete", 0)]
    got = liveness.lives(spark.createDataFrame(rows, "id string, speaker string, at_ns long, seq long, kind string, interval_ns long")).collect()
    assert sorted((r["id"], r["start_ns"], r["end_ns"], r["ended_by"]) for r in got) == [("db", 0, 110 * s, "liveness_expiry"), ("x", 0, None, None)]


def test_paths_obey_crossing_rules(spark):
    kinds = {1: "host", 2: "host", 3: "service.instance", 4: "service.instance", 5: "network.endpoint", 6: "service.instance"}
    entities = spark.createDataFrame(list(kinds.items()), "id long, type string")
    edges = [("runs_on", 3, 1), ("runs_on", 6, 1), ("runs_on", 4, 2), ("depends_on", 3, 5), ("depends_on", 4, 5)]
    relations = spark.createDataFrame(edges, "type string, from_id long, to_id long")
    seen, refused = traverse.shortest_paths(spark.createDataFrame([(1,), (2,), (5,)], "id long"), relations, entities, 10)
    hops = {(r["root"], r["node"]): r["hops"] for r in seen.collect()}
    assert (1, 2) not in hops and hops[1, 5] == 2 and hops[5, 1] == 2 and hops[1, 6] == 1
    assert [r["node"] for r in traverse.convergences(refused, 1, 2).collect()] == [5]


def test_log_round_trip_and_faults(spark, tmp_path):
    events = classify.entity_events(observed(spark, [r if r[3] is not None else (*r[:3], {}) for r in ROWS]))
    log.append(events, str(tmp_path / "log"))
    back = log.scan(spark, str(tmp_path / "log"), "default", 20, 50)
    assert sorted(r["seq"] for r in back.collect()) == [2, 3, 4]
    whole = log.scan(spark, str(tmp_path / "log"))
    assert {r["id"] for r in state.live(whole).collect()} == {7, 8} == {r["id"] for r in state.as_of(whole, 10**9).collect()}
    assert [r["id"] for r in state.as_of(whole, 65).collect()] == []
    segments = spark.createDataFrame([("t", 0, 9), ("t", 10, 19), ("t", 21, 29), ("t", 25, 40)], "tenant string, from_seq long, to_seq long")
    assert sorted((r["from_seq"], r["fault"]) for r in log.segment_faults(segments).collect()) == [(21, "gap"), (25, "overlap")]


def test_otlp_records(spark, tmp_path):
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    kv = lambda k, *pairs: {"key": k, "value": {"kvlistValue": {"values": list(pairs)}}}
    record = lambda name, *attrs: {"timeUnixNano": "5", "eventName": name, "attributes": list(attrs)}
    target = {"kvlistValue": {"values": [text("relationship.type", "runs_on"), text("entity.type", "host"), kv("entity.id", text("host.id", "h"))]}}
    logs = [
        record("entity.state", text("entity.type", "process"), kv("entity.id", {"key": "process.pid", "value": {"intValue": "12"}}), kv("entity.description", text("exe", "nginx")), {"key": "entity.report.interval", "value": {"intValue": "60"}}, {"key": "entity.relationships", "value": {"arrayValue": {"values": [target]}}}),
        record("entity.delete", text("entity.type", "host")), record("other"),
    ]
    (tmp_path / "x.json").write_text(json.dumps({"resourceLogs": [{"resource": {"attributes": [text("service.instance.id", "agent")]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": logs}]}]}))
    a, b = otlp.observations(otlp.read(spark, str(tmp_path / "x.json")), 99).orderBy("n").collect()
    assert (a["kind"], a["type"], a["producer"], a["scope"], a["interval_ns"], a["event_time_ns"], a["problem"]) == ("state", "process", "agent", "s", 60 * 10**9, 5, None)
    assert a["identity"][0]["value"] == "i:12" and a["attributes"] == {"exe": "s:nginx"} and a["relationships"][0]["target"][0]["value"] == "s:h"
    assert (b["kind"], b["problem"]) == ("delete", "identity")
