"""The filter of ids: exact joins, and no Python worker beside those of the step that takes the rows."""

import random

import numpy as np

from strandline.llm import suffixes
from strandline.llm.common import BitMap, IdFilter


def test_id_filter_is_exact_and_runs_in_no_python_worker(spark):
    rng = random.Random(7)
    ids = [None, 0, -1, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**62), 2**62) for _ in range(3000)]
    rows = spark.createDataFrame([(d, k % 3, f"t{k}") for k, d in enumerate(ids)], "d long, k int, text string").repartition(5)
    chosen = {(d, k % 3) for k, d in enumerate(ids) if d is not None and k % 4 == 0}
    keys = spark.createDataFrame([*chosen, *list(chosen)[:50], (17, 1)], "d long, k int")
    own = IdFilter(keys, "d", "k")
    texts = lambda df: sorted(r["text"] for r in df.collect())
    inside = sorted(f"t{k}" for k, d in enumerate(ids) if (d, k % 3) in chosen)
    assert texts(own.semi(rows)) == inside
    assert texts(own.anti(rows)) == sorted({f"t{k}" for k in range(len(ids))} - set(inside))
    more = keys.distinct().selectExpr("d", "k", "d + k AS sum")
    assert texts(own.inner(rows, more)) == inside
    left = own.left(rows, more)
    assert left.count() == len(ids) and texts(left.where("sum is not null")) == inside
    assert own.maybe(rows).count() < len(inside) + 100  # by chance a few more
    for df in (own.semi(rows), own.anti(rows), own.inner(rows, more), left):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    own.free()


def test_regions_as_arrays_are_those_of_the_map(spark):
    df = spark.range(5000).selectExpr("xxhash64(id) AS h")
    hashes = lambda frames: (f["h"].to_numpy(np.int64).view(np.uint64) for f in frames)
    words = BitMap.of(df, hashes, 1).sent.value.reshape(256, -1)
    for r in BitMap.regions(df, hashes, 1, "array<int>").collect():
        assert (np.array(r["words"], dtype=np.int32).view(np.uint32) == words[r["shard"]]).all()


def test_empty_id_filter(spark):
    own = IdFilter(spark.createDataFrame([], "d long"), "d")
    assert own.anti(spark.range(10).toDF("d")).count() == 10 and own.semi(spark.range(10).toDF("d")).count() == 0


def test_texts_without_copies_start_one_python_worker_a_task(spark, monkeypatch):
    plans = []
    real = suffixes.shared_buckets
    monkeypatch.setattr(suffixes, "shared_buckets", lambda texts, length: (plans.append(texts._jdf.queryExecution().executedPlan().toString()), real(texts, length))[1])
    passage = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, passage), (2, passage), (3, f"other {passage}")], "doc_id long, text string")
    assert [tuple(r) for r in suffixes.without_repeats(docs).orderBy("doc_id").collect()] == [(1, passage), (3, "other ")]
    assert plans and not any("Python" in p for p in plans)
