import numpy as np
import pytest

from brute import roots
from strandline.llm.embeddings import hadamard, near_vectors
import strandline.llm.embeddings as op

SCHEMA = "vec_id long, embedding array<float>, label int, c string, n string, v int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", "y", 0) for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors):
    x = {i: np.asarray(v, dtype=np.float32).astype(np.float64) for i, v in vectors.items()}
    ids = sorted(x)
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    near = m @ m.T >= 0.9
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    root = roots(ids, links)
    return {i: (int(near[k].sum()) - 1, root[i], root[i] == i) for k, i in enumerate(ids)}


def cloud(seed, n, groups, d=64):
    rng = np.random.default_rng(seed)
    out = {i: rng.normal(size=d) for i in range(n)}
    for k in range(groups):
        base = rng.normal(size=d)
        for _ in range(3 + 40 * (k == 0)):
            noise = rng.normal(size=d)
            out[len(out)] = base + rng.choice([0.0, 0.1, 0.3]) * noise
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", block)
    vectors = cloud(3, 150, 25)
    want = brute(vectors)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame(spark, vectors.items())).collect()}
    assert got == want


def test_what_cannot_link(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(5, one), (5, one), (None, one), (7, [2.0, 4.0, 6.0]), (1, None), (2, []), (3, [0.0] * 3), (4, [1.0, None, 3.0]), (6, [float("nan"), 1.0, 2.0]), (8, [float("inf"), 1.0, 2.0]), (9, [1.0, 2.0])]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame(spark, rows)).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 6, 8, 9)]
    assert got == sorted([(0, 3, 5, False), (5, 3, 5, True), (5, 3, 5, True), (7, 3, 5, False), *alone])
    assert near_vectors(frame(spark, [])).collect() == []


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(3, 8))
    h = np.array([[1]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(hadamard(x), x @ h)
