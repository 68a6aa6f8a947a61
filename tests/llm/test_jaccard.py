import pytest

from brute import corpus, jaccard
from strandline.llm import jaccard as op
from strandline.llm.common import components

SCHEMA = "doc_id long, text string, n long, rep string, key int, token int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "clash", 2, 3) for i, t in texts], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op.jaccard_components(frame(spark, texts.items())).collect()}
    assert got == jaccard(texts)


def test_a_large_group_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(base[: 10 + i % 100] + ["new%d" % i] + base[11 + i % 100 :]) for i in range(150)}
    rows = op.jaccard_components(frame(spark, texts.items())).collect()
    want = jaccard(texts)
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(i, want[i][1]) for i in texts}


def test_threshold_is_met_exactly(spark):
    words = [f"w{i}" for i in range(13)]
    a, b = " ".join(words), " ".join(words[1:])  # 9 and 8 shingles, 8 shared: 8 / 9
    c = " ".join(words[:12] + ["other"])  # 9 shingles, 8 shared with a: 8 / 10
    d = " ".join(words[:11] + ["other", "more"])  # 7 shared with a: 7 / 11
    got = {r["doc_id"]: r["component_id"] for r in op.jaccard_components(frame(spark, enumerate([a, b, c, d]))).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_nulls_repeats_and_nothing(spark):
    rows = op.jaccard_components(frame(spark, [(5, "a b"), (5, "a b"), (None, "a b"), (3, None), (4, " "), (9, "A B")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows) == [(0, 1, 5), (3, 0, 3), (4, 0, 4), (5, 1, 5), (5, 1, 5), (9, 1, 5)]
    assert op.jaccard_components(frame(spark, [])).collect() == []
    assert sorted(r["doc_id"] for r in op.keep_one(frame(spark, [(5, "a b"), (5, "a b"), (3, None), (4, " "), (9, "A B")])).collect()) == [3, 4, 5]


def test_components_of_chains(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 100 != 99], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    assert got == {i: i // 100 * 100 for i in range(n)}


def test_a_worker_gives_free_memory_back():
    """After many arrays were made and let go, pages return to the system, as another worker's peak stands beside them."""
    import re

    import numpy as np
    import pandas as pd

    from strandline.llm.common import chunks

    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())))
    frame = pd.DataFrame({"text": [b"x"]})
    list(chunks(iter([frame]), "text"))
    before = held()
    parts = [np.ones(12_000) for _ in range(1000)]  # 96 MB in pieces that are not mapped on their own
    last = np.ones(12_000)
    del parts
    list(chunks(iter([frame]), "text"))
    assert held() - before < 20_000 and last.sum() == 12_000


def test_bins_never_deny_a_link():
    """What two sets can have in common, from counts by bins, is never less than what they have; most others are told apart."""
    import numpy as np

    rng, denied = np.random.default_rng(4), 0
    for k in range(300):
        n = int(rng.integers(1, 600))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        kept = rng.random(len(x)) < (0.6 if k % 2 else rng.uniform(0.85, 1))
        y = np.unique(np.append(x[kept], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.2))).astype(np.uint64)))
        if not len(y):
            continue
        links = 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))
        may = op._may_link(op._bins(x), op._bins(y))
        assert may or not links
        denied += not may
    assert denied > 100
    same = np.arange(1000, dtype=np.uint64) << np.uint64(20)  # all in one bin
    assert op._may_link(op._bins(same), op._bins(same[:900]))


def test_texts_of_pairs_that_cannot_link_stay(spark, monkeypatch):
    """A third of the words changed at one end: prefixes meet, and bins tell that the sets do not link."""
    base = [[f"t{g}w{i}" for i in range(90)] for g in range(6)]
    texts = {10 * g + k: " ".join(b[:60] + [f"x{g}{k}{i}" for i in range(30)]) for g, b in enumerate(base) for k in range(3)}
    asked, own = [], op.IdFilter

    class Asked(own):
        def __init__(self, keys, *on):
            asked.append((on, keys.count()))
            super().__init__(keys, *on)

    monkeypatch.setattr(op, "IdFilter", Asked)
    rows = op.jaccard_components(frame(spark, texts.items())).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i for i in texts}
    assert sum(n for on, n in asked if on == ("fp",)) == 0
