import math
from collections import Counter, defaultdict

import pytest

from brute import WORDS, corpus
from strandline.llm import quality as op
from strandline.llm.textbytes import word_hashes

SCHEMA = "doc_id long, text string, lang string, v string, n string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "y", 1) for i, t, g in rows], SCHEMA).repartition(3)


def tokens(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return WORDS.findall(data)


def brute(texts, trusted, vocabulary):
    """A function text -> perplexity, by the textbook formulas."""
    seen = {w for t in texts for w in tokens(t)}
    kinds = max(len(seen - vocabulary), 1)
    ids = lambda t: [w if w in vocabulary else None for w in tokens(t)]
    c = Counter()
    for t in trusted:
        w = ids(t)
        c.update(zip(w, w[1:] + ["</s>"]))

    def cuts(values):
        t = Counter(values)
        if not all(t[k] for k in (1, 2, 3, 4)):
            return lambda n: (0.5, 1.0, 1.5)[min(n, 3) - 1]
        y = t[1] / (t[1] + 2 * t[2])
        d = [k - (k + 1) * y * t[k + 1] / t[k] for k in (1, 2, 3)]
        return lambda n: min(max(d[min(n, 3) - 1], 0.05), min(n, 3) - 0.05)

    cut2 = cuts(c.values())
    cont = Counter(w for _, w in c)
    cut1 = cuts(cont.values())
    gamma1 = sum(map(cut1, cont.values())) / len(c)
    p1 = lambda w: (cont[w] - cut1(cont[w]) if cont[w] else 0) / len(c) + gamma1 / (len(vocabulary) + 2)
    total, left = Counter(), defaultdict(float)
    for (v, _), n in c.items():
        total[v] += n
        left[v] += cut2(n)

    def p2(v, w):
        if not total[v]:
            return p1(w)
        n = c[v, w]
        return ((n - cut2(n)) if n else 0) / total[v] + left[v] / total[v] * p1(w)

    def perplexity(text):
        w = ids(text)
        log_p = math.log(p1(w[0])) + sum(math.log(p2(a, b)) for a, b in zip(w, w[1:] + ["</s>"])) - math.log(kinds) * w.count(None)
        return math.exp(-log_p / (len(w) + 1))

    return perplexity


@pytest.mark.parametrize("size, held", [(1 << 18, 1 << 19), (700, 40)])
def test_perplexity_equals_the_formulas(spark, size, held):
    texts = corpus(21, 120, 2000)
    docs = frame(spark, [(i, t, "en") for i, t in texts.items()])
    trusted = {i: t for i, t in texts.items() if i % 2}
    model = op.Model(docs, docs.where("doc_id % 2 = 1"), size, held)
    assert len(model.held[0]) <= held and len(model.vocabulary) <= size
    known = {w for t in texts.values() for w in tokens(t) if word_hashes([w])[0][0] in model.vocabulary}
    want = brute(texts.values(), list(trusted.values()), known)
    for r in op.perplexities(docs, model).collect():
        words = tokens(texts[r["doc_id"]])
        assert r["n_words"] == len(words)
        assert r["perplexity"] == (pytest.approx(want(texts[r["doc_id"]]), rel=1e-9) if words else None)


def test_thresholds_and_odd_rows(spark):
    good, bad = "the cat sat on the mat and the dog ran", "zx### qq%%% ww$$$ the&&& ee!!!"
    rows = [(i, f"{good} {i % 7} times", "en") for i in range(60)] + [(100, bad, "en"), (101, None, None), (102, "", "en"), (None, good + " 3 times", None), (103, good + " 3 times", "xx"), (103, good + " 3 times", "xx")]
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    got = op.classify(frame(spark, rows), labels, 1.0).collect()
    keep = defaultdict(list)
    for r in got:
        keep[r["doc_id"]].append(r["keep"])
    assert len(got) == len(rows) and keep[100] == [False] == keep[101] == keep[102] and keep[103] == [True, True] and keep[None] == [True]
    assert op.classify(frame(spark, []), labels).collect() == []
    none = op.classify(frame(spark, rows), labels.where("quality = 7")).collect()
    assert all(r["perplexity"] is None and r["keep"] == (r["n_words"] > 0) for r in none)


def test_all_words_are_told_apart(spark, monkeypatch):
    """No cap on words: those seen once, in trusted text or out of it, keep counts and probabilities of their own."""
    assert not hasattr(op, "VOCABULARY")
    monkeypatch.setattr(op, "HELD", 40)
    texts = corpus(22, 90, 1500)
    texts |= {1000 + i: f"rare{i} word{i} and rare{i} once{i}" for i in range(60)}
    docs = frame(spark, [(i, t, "en") for i, t in texts.items()])
    model = op.Model(docs, docs.where("doc_id % 2 = 1"))
    assert len(model.held[0]) <= 40
    want = brute(texts.values(), [t for i, t in texts.items() if i % 2], {w for t in texts.values() for w in tokens(t)})
    for r in op.perplexities(docs, model).collect():
        assert r["perplexity"] == (pytest.approx(want(texts[r["doc_id"]]), rel=1e-9) if tokens(texts[r["doc_id"]]) else None)


def test_bigrams_are_no_rows(spark):
    """Counts stand packed by shard: no table of the model has a row for each bigram, with its weight beside its key."""
    import random

    rng = random.Random(5)
    texts = {i: " ".join(f"w{rng.randrange(8000)}" for _ in range(1000)) for i in range(60)}
    docs = frame(spark, [(i, t, "en") for i, t in texts.items()])
    model = op.Model(docs, docs, held=40)
    assert model.old and sum(spark.read.parquet(path).count() for path in model.old) < 1000
    model.free()


def test_many_runs_and_rounds_give_the_formulas(spark, monkeypatch):
    monkeypatch.setattr(op, "RUN_BYTES", 3000)
    monkeypatch.setattr(op, "ROUNDS", 7)
    texts = corpus(23, 80, 900)
    docs = frame(spark, [(i, t, "en") for i, t in texts.items()] + [(5, texts[5], "en")])
    model = op.Model(docs, docs.where("doc_id % 2 = 0"), held=20)
    want = brute(texts.values(), [t for i, t in texts.items() if i % 2 == 0], {w for t in texts.values() for w in tokens(t)})
    rows = op.perplexities(docs, model).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r["perplexity"] == (pytest.approx(want(texts[r["doc_id"]]), rel=1e-9) if tokens(texts[r["doc_id"]]) else None)
