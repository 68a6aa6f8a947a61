"""Steps whose cost must not grow by roots, hubs or tables sent to the driver, against brute force."""

import random

from strandline.operators import liveness, traverse
from strandline.sources import estate, log

KINDS = ["host", "service.instance", "network.endpoint", "db"]


def graph(seed, nodes=90, edges=220):
    rng = random.Random(seed)
    types = ["runs_on", "depends_on", "attached_to"]
    return [(rng.choice(types), rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]


def test_reach_of_more_roots_than_a_row_holds(spark):
    edges = graph(1)
    roots = range(70)
    want = {}
    for root in roots:
        seen, frontier = {root}, {root}
        for d in range(1, 6):
            best = {}
            for t, a, b in edges:
                if a in frontier and b not in seen:
                    best[b] = min(best.get(b, t), t)
            want |= {(root, n, d): via for n, via in best.items()}
            seen, frontier = seen | set(best), set(best)
    near = spark.createDataFrame([(a, b, t) for t, a, b in edges], "src long, dst long, type string")
    ids = spark.createDataFrame([(r,) for r in roots], "id long")
    got = {(r["root"], r["node"], r["depth"]): r["via"] for r in traverse.reach(ids, near, 5).collect()}
    assert got == want
    counts = {(r["root"], r["key"]): r["n"] for r in traverse.reach_counts(ids, near, 5).collect()}
    assert counts == {(root, d): sum(k[0] == root and k[2] == d for k in want) for root, _, d in want}


def test_a_level_has_a_row_for_a_node_not_for_each_root(spark):
    near = spark.createDataFrame([(r, 100 + k, 0) for r in range(40) for k in range(5)], "src long, dst long, kind int")
    placed, n = traverse._placed(spark.createDataFrame([(r,) for r in range(40)], "id long"))
    assert n == 40 and [level.count() for level in traverse._walk(placed, near, 3)] == [40, 5]


def test_hop_counts_equal_paths(spark):
    for seed in (2, 3):
        rng = random.Random(seed)
        entities = spark.createDataFrame([(n, rng.choice(KINDS)) for n in range(85)], "id long, type string")  # five ids are none
        relations = spark.createDataFrame(graph(seed, edges=120), "type string, from_id long, to_id long")
        roots = spark.createDataFrame([(r,) for r in range(0, 90, 9)], "id long")
        paths, _ = traverse.shortest_paths(roots, relations, entities, 4)
        want = sorted(map(tuple, paths.groupBy("root", "hops").count().collect()))
        assert sorted(map(tuple, traverse.hop_counts(roots, relations, entities, 4).select("root", "hops", "n").collect())) == want
        odd = entities.union(spark.createDataFrame([(85, "network.interface")], entities.schema))
        paths, _ = traverse.shortest_paths(roots, relations, odd, 4)
        want = sorted(map(tuple, paths.groupBy("root", "hops").count().collect()))
        assert sorted(map(tuple, traverse.hop_counts(roots, relations, odd, 4).select("root", "hops", "n").collect())) == want


def test_cascade_deals_hubs_and_counts_shared_deletions_once(spark, monkeypatch):
    monkeypatch.setattr(liveness, "HUB_EDGES", 4)
    rng = random.Random(4)
    edges = [("t", "depends_on", a, b) for a in range(60) for b in (1, 2)] + [("t", "runs_on", 5, 5), ("t", "runs_on", 1, 2)]
    gone = [("t", i, 10 * i + k, 7, rng.randrange(3)) for i in (1, 2, 5, 9) for k in range(3)] + [("t", 30, 1, 1, 1), ("t", 1, 1, 1, 1), ("t", 1, 1, 1, 1)]
    relations = spark.createDataFrame(edges * 2, "tenant string, type string, from_id long, to_id long")
    deleted = spark.createDataFrame(gone, "tenant string, id long, event_time_ns long, recorded_at_ns long, seq long")
    rows = liveness.cascade(deleted, relations).select("type", "from_id", "to_id", "event_time_ns", "recorded_at_ns", "seq").collect()
    want = {(t, a, b, *g[2:]) for _, t, a, b in edges for g in gone if g[1] in (a, b)}
    assert len(rows) == len(want) and set(map(tuple, rows)) == want
    near = spark.createDataFrame([("t", "depends_on", a, 1) for a in range(60)], relations.schema)
    plan = liveness._at_end(near, deleted.selectExpr("*", "false AS shared"), "to_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan.split("Join Inner", 1)[1].split("\n")[0]  # a hub's edges meet in no one task


def test_components_send_no_labels_to_the_driver(spark, monkeypatch):
    plans = []
    real = traverse.written
    monkeypatch.setattr(traverse, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    links = spark.createDataFrame([(k, k + 1) for k in range(50) if k % 7], "a long, b long")
    got = {r["id"]: r["root"] for r in traverse.components(links, spark.range(60)).collect()}
    assert got == {k: (k if k > 50 or k == 0 else (k - 1) // 7 * 7 + 1) for k in range(60)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_pairs_of_lines_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(log, "BUCKET_ROWS", 100)
    rng = random.Random(6)
    rows = [(rng.randrange(40), rng.randrange(40)) for _ in range(1500)]
    pairs = estate.pairs(spark.createDataFrame(rows, "a long, b long").coalesce(1), "a", "b")
    assert sorted(map(tuple, pairs.collect())) == sorted(set(rows))
    assert pairs.rdd.getNumPartitions() == 16  # no task gathers a split of a file, or what is put together after it


def test_levels_have_partitions_by_their_edges(spark, monkeypatch):
    monkeypatch.setattr(log, "BUCKET_ROWS", 100)
    widths = []
    real = traverse.written
    monkeypatch.setattr(traverse, "written", lambda df: (widths.append(spark.conf.get("spark.sql.shuffle.partitions")), real(df))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    near = spark.createDataFrame([(r, 1000 + r, 0) for r in range(1200)], "src long, dst long, kind int")
    placed, _ = traverse._placed(spark.createDataFrame([(r,) for r in range(10)], "id long"))
    assert [level.count() for level in traverse._walk(placed, near, 3)] == [10, 10, 10]
    assert int(widths[-1]) >= 13
    assert (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == before
