from pyspark.sql import functions as F

from strandline.functions import values as V
from strandline.operators import changes, classify, liveness, snapshots, state, statements, traverse

EVENT = "tenant string, id long, attributes map<string,string>, change_type string, event_time_ns long, recorded_at_ns long, seq long"
MIN = 60 * 10**9


def log_of(spark, *rows):
    return spark.createDataFrame([("t", i, {"status": f"s:{s}"} if s else None, c, at, at, q) for q, (i, s, c, at) in enumerate(rows)], EVENT)


def test_a_snapshot_and_what_follows_give_the_live_state(spark):
    log = log_of(spark, (1, "up", "entity.created", 1), (2, "up", "entity.created", 2), (2, None, "entity.deleted", 3), (3, "up", "entity.created", 4), (1, "down", "entity.state_changed", 6), (3, "up", "entity.unchanged", 7), (2, "back", "entity.created", 8))
    edges = log_of(spark, (9, "x", "relation.added", 2))
    made = snapshots.snapshot_events(state.live(state.as_known(log, 5)), state.live(edges), 5, 0)
    assert sorted((r["id"], r["change_type"]) for r in made.collect()) == [(1, "entity.created"), (3, "entity.created"), (9, "relation.added")]
    got = {r["id"]: r["attributes"]["status"] for r in snapshots.restored(made.where("id < 9"), log, 5).collect()}
    assert got == {r["id"]: r["attributes"]["status"] for r in state.live(log).collect()} == {1: "s:down", 2: "s:back", 3: "s:up"}
    assert snapshots.restored(made.limit(0), log.limit(0), 5).isEmpty()


def test_tombstones_last_for_the_grace_and_up_to_the_cap(spark):
    log = log_of(spark, (1, "a", "entity.created", 1), (1, None, "entity.deleted", 2), (2, "b", "entity.created", 3), (2, None, "entity.unchanged", 4), (2, None, "entity.deleted", 10 * MIN), (3, None, "entity.created", 5), (3, None, "entity.deleted", 11 * MIN), (4, "d", "entity.deleted", 12 * MIN), (4, "d", "entity.created", 13 * MIN))
    ids = lambda now, **k: sorted((r["id"], (r["attributes"] or {}).get("status")) for r in snapshots.tombstones(log, now, **k).collect())
    assert ids(14 * MIN) == [(1, "s:a"), (2, "s:b"), (3, None)]
    assert ids(25 * MIN) == [(2, "s:b"), (3, None)] and ids(25 * MIN + 1) == [(3, None)] and ids(14 * MIN, cap=1) == [(3, None)]
    assert snapshots.tombstones(log.limit(0), 5).isEmpty()


def test_timeline_takes_edges_at_both_ends_and_a_loop_once(spark):
    own = log_of(spark, (1, "up", "entity.created", 1))
    edges = spark.createDataFrame([("runs_on", 1, 2, "relation.added", 2, 2, 5), ("same_as", 1, 1, "relation.added", 3, 3, 6)], "type string, from_id long, to_id long, change_type string, event_time_ns long, recorded_at_ns long, seq long")
    rows = lambda kind: sorted((r["entity"], r["thing"]) for r in changes.timeline(own, edges, kind).collect())
    assert rows("all") == [(1, "1"), (1, "runs_on>1>2"), (1, "same_as>1>1"), (2, "runs_on>1>2")]
    assert rows("entity") == [(1, "1")] and rows("relation") == rows("all")[1:] and rows("structural") == [(1, "runs_on>1>2"), (2, "runs_on>1>2")]
    at = traverse.incident(spark.range(1, 2), edges)
    assert sorted((r["id"], r["type"]) for r in at.collect()) == [(1, "runs_on"), (1, "same_as")]
    assert [traverse.relations_where(edges, *k).count() for k in ((), ("same_as",), (None, 1), (None, 1, 2), ("same_as", None, 2))] == [2, 1, 2, 1, 0]


def test_times_are_written_and_read_in_any_zone(spark):
    ns = [0, 1, 1_704_067_200_500_000_000, 253_402_300_799_999_999_999 // 10**3, -1, None]
    df = spark.createDataFrame([(n,) for n in ns], "n long").select("n", V.rfc3339(F.col("n")).alias("t"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = df.withColumn("back", V.parse_rfc3339(F.col("t"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r["back"] for r in rows] == ns
    assert [r["t"] for r in rows][:3] == ["1970-01-01T00:00:00Z", "1970-01-01T00:00:00.000000001Z", "2024-01-01T00:00:00.5Z"] and rows[4]["t"] == "1969-12-31T23:59:59.999999999Z" and rows[5]["t"] is None
    said = ["1970-01-01T02:00:00+02:00", "1969-12-31T19:30:00.25-04:30", "2024-13-01T00:00:00Z", "2024-01-01", "", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in said], "t string").select(V.parse_rfc3339(F.col("t"))).collect()] == [0, 250_000_000, None, None, None, None]


def test_windows_against_the_horizon(spark):
    df = spark.createDataFrame([(1, 2, 2), (1, 3, 2), (2, 3, 2), (1, 2, None)], "a long, b long, h long")
    assert [r[0] for r in df.select(statements.window_reach(F.col("a"), F.col("b"), F.col("h"))[0]).collect()] == ["empty", "partial", "whole", "whole"]


def test_counters_take_nulls_as_no(spark):
    rows = [("a", "entity.state", None, None, None), ("a", None, True, True, 7), ("a", "entity.delete", True, True, 2), ("b", "entity.state", False, True, 1)]
    got = {(r["tenant"], r["counter"]): r["n"] for r in statements.ingest_counters(spark.createDataFrame(rows, "tenant string, name string, refused boolean, unknown_type boolean, n_dropped int")).collect()}
    assert {k: n for k, n in got.items() if n} == {("a", "handled"): 1, ("a", "ignored"): 1, ("a", "rejected"): 1, ("a", "values_dropped"): 2, ("b", "handled"): 1, ("b", "values_dropped"): 1, ("b", "unknown_types"): 1}
    assert len(got) == 10


def test_restored_and_inherited_deadlines(spark):
    held = spark.createDataFrame([(1, "p", 50, 20), (2, "p", 500, 20), (3, "p", None, 0), (4, "p", 9, 8 * 86_400 * 10**9), (5, "p", 7, None)], "id long, speaker string, deadline_ns long, interval_ns long")
    assert {r["id"]: (r["deadline_ns"], r["interval_ns"]) for r in liveness.restored(held, 100).collect()} == {1: (120, 20), 2: (500, 20), 3: (None, 0), 4: (None, 0), 5: (7, 0)}
    edges = spark.createDataFrame([(1, 1, "p", 5, None), (2, 1, "q", 5, None), (3, 1, "p", 5, 3), (4, 2, "p", 5, 0)], "edge int, from_id long, speaker string, at_ns long, interval_ns long")
    assert {r["edge"]: (r["deadline_ns"], r["interval_ns"]) for r in liveness.inherited(edges, held).collect()} == {1: (50, 20), 2: (None, 0), 3: (8, 3), 4: (500, 20)}


def test_edges_whose_ends_an_alias_makes_one_are_told(spark):
    own = lambda name: V.identity(host_name=V.string(F.col(name)))
    ids = spark.createDataFrame([(1, "a"), (2, "b")], "id long, n string").select("id", V.fingerprint(F.lit("host"), own("n")).alias("fingerprint"))
    known = spark.createDataFrame([("host.name", "s:a2", "s:a"), ("host.name", "s:b", "s:a")], "key string, alias string, canonical string")
    edges = spark.createDataFrame([(1, "a", "b"), (2, "a2", "a"), (3, "a2", "b"), (4, "x", "b"), (5, "a", "a"), (6, "x", "y")], "edge int, f string, t string")
    edges = edges.select("edge", F.lit("same_as").alias("type"), F.lit("host").alias("from_type"), own("f").alias("from_identity"), F.lit("host").alias("to_type"), own("t").alias("to_identity"))
    got = {r["edge"]: (r["from_id"], r["to_id"], r["outcome"]) for r in classify.resolved_edges(edges, ids, known).collect()}
    assert got == {1: (1, 2, "resolved"), 2: (1, 1, "collapsed"), 3: (1, 2, "resolved"), 4: (None, 2, "missing"), 5: (1, 1, "resolved"), 6: (None, None, "missing")}
