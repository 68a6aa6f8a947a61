import hashlib

import pytest

from brute import corpus, repeats
from strandline.llm import suffixes as op

SCHEMA = "doc_id long, text string, d long, fp string, s int, spans int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", 2, 3) for i, t in rows], SCHEMA).repartition(3)


def expected(texts):
    out = {}
    for i, (data, gone) in repeats(texts).items():
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), (b"\0" + gone).count(b"\0\1"), hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [4, 5])
def test_removed_bytes_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(op, "PART", 700)
    monkeypatch.setattr(op, "TOGETHER", 3)
    texts = corpus(seed, 150)
    texts[900] = texts[3] = "one\nlonger text é " * 300
    assert got(op.dedup_digests(frame(spark, texts.items()))) == expected(texts)


def test_nulls_repeats_and_nothing(spark):
    long = " ".join(str(i) for i in range(60))
    rows = [(4, long), (4, long), (None, None), (7, ""), (9, long), (4, "other " + long[:40])]
    found = sorted(tuple(r)[:4] for r in op.dedup_digests(frame(spark, rows)).collect() if r["doc_id"] is not None)
    assert found == [(4, 46, 0, 0), (4, 169, 0, 0), (4, 169, 0, 0), (7, 0, 0, 0), (9, 169, 169, 1)]
    kept = op.without_repeats(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept if r["text"]) == [(4, long), (4, long), (4, "other " + long[:40])]
    assert op.dedup_digests(frame(spark, [])).collect() == []


def test_a_task_cuts_each_text_once(spark, monkeypatch):
    plans, real = [], op.materialize
    monkeypatch.setattr(op, "materialize", lambda df, *more: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *more))[1])
    long = " ".join(str(i) for i in range(60))
    kept = op.without_repeats(frame(spark, [(1, long), (2, long), (3, f"other {long} more"), (4, None)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, long), (3, "other  more"), (4, None)]
    assert plans[-1].count("EvalPython") == 1  # a second call would be a second Python worker beside the first
