from pyspark.sql import functions as F

from strandline.operators import changes, classify, liveness

EDGE = "seq long, kind string, from_id long, to_id long, attributes map<string,string>"


def timed(df):
    return df.withColumns({"tenant": F.lit("t"), "type": F.lit("runs_on"), "event_time_ns": F.col("seq") * 10, "recorded_at_ns": F.col("seq") * 10})


def ids(spark):
    return spark.range(1, 6)


def said(events):
    return [(r["seq"], r["from_id"], r["to_id"], r["change_type"], r["delete_source"]) for r in events.orderBy("seq", "from_id", "to_id").collect()]


def test_edges_are_removed_and_come_back(spark):
    up, down = {"status": "s:up"}, {"status": "s:down"}
    rows = [(1, "delete", 1, 2, None), (2, "state", 1, 2, up), (3, "state", 1, 2, down), (4, "delete", 1, 2, None), (5, "delete", 1, 2, None), (6, "state", 1, 2, down), (7, "state", 1, 2, down), (8, "delete", 1, 9, None)]
    events = classify.relation_events(timed(spark.createDataFrame(rows, EDGE)), ids(spark))
    assert said(events) == [(2, 1, 2, "relation.added", None), (3, 1, 2, "relation.attribute_changed", None), (4, 1, 2, "relation.removed", "producer"), (6, 1, 2, "relation.added", None)]
    outcome = lambda a, b: [r["outcome"] for r in changes.net_changes(events.withColumn("id", F.concat_ws(">", "from_id", "to_id")), a, b).collect()]
    assert (outcome(20, 50), outcome(30, 50), outcome(60, 99)) == (["transient"], ["deleted"], ["created"])


def test_absence_and_cascade_remove_edges(spark):
    reports = timed(spark.createDataFrame([(1, "p", "", 1, [2, 3]), (2, "p", "", 1, [3]), (6, "p", "", 4, [5]), (7, "p", "", 4, None)], "seq long, producer string, scope string, source long, targets array<long>"))
    states = reports.select("tenant", "type", F.col("source").alias("from_id"), F.explode("targets").alias("to_id"), "event_time_ns", "recorded_at_ns", "seq", F.lit("state").alias("kind"), F.lit(None).cast("string").alias("delete_source"))
    deleted = timed(spark.createDataFrame([(3, 3), (4, 1)], "seq long, id long"))
    edges = states.unionByName(classify.absences(reports)).unionByName(liveness.cascade(deleted, states)).withColumn("attributes", F.create_map().cast("map<string,string>"))
    assert said(classify.relation_events(edges, ids(spark))) == [
        (1, 1, 2, "relation.added", None), (1, 1, 3, "relation.added", None), (2, 1, 2, "relation.removed", "producer"), (3, 1, 3, "relation.removed", "cascade"),
        (6, 4, 5, "relation.added", None), (7, 4, 5, "relation.removed", "producer"),
    ]
