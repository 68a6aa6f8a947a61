import random

from strandline.llm import decontamination as op

SCHEMA = "doc_id long, text string, item_id string, start int, end string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def distance(item, text):
    """Least edits of the whole item against any part of the text."""
    item, text = item.lower(), text.lower()
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_hits_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_CHARS", 300)
    rng = random.Random(8)
    words = ["ab", "cad", "éla", "ruin", "tion", "th", "en", "quo"]
    prose = lambda k: " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(k))
    bench = [(i, prose(rng.randint(3, 25))) for i in range(12)] + [(50, "short"), (51, None), (None, prose(9))]
    docs = []
    for i in range(70):
        t = prose(rng.randint(0, 30))
        if i % 2:
            item = list(rng.choice(bench[:12])[1])
            for _ in range(rng.randint(0, len(item) // 7)):
                k = rng.randrange(len(item))
                item[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "zz", item[k].upper()])
            t = rng.choice(["", t + " "]) + "".join(item) + rng.choice(["", " " + prose(20)])
        docs.append((i, t))
    want = {(i, n): distance(item, t) for i, t in docs for n, item in bench[:12] if distance(item, t) <= op.edit_budget(len(item))}
    got = op.benchmark_hits(frame(spark, docs), items(spark, bench)).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_edits"] for r in got} == want and len(got) == len(want) > 20
    text = dict(docs)
    for r in got:
        part = text[r["doc_id"]].lower()[r["start"] : r["end"]]
        assert distance(dict(bench)[r["item_id"]], part) == r["n_edits"]
    clean = {r["doc_id"] for r in op.without_benchmark(frame(spark, docs), items(spark, bench)).collect()}
    assert clean == set(text) - {i for i, _ in want}


def test_nulls_and_nothing(spark):
    bench = items(spark, [(1, "the whole passage of it")])
    rows = [(None, "so: The whole passage of it."), (3, None), (4, ""), (5, "The whole passage of it"), (5, "The whole passage of it")]
    got = op.benchmark_hits(frame(spark, rows), bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["start"], r["end"], r["n_edits"]) for r in got) == [(0, 1, 4, 27, 0), (5, 1, 0, 23, 0), (5, 1, 0, 23, 0)]
    assert op.benchmark_hits(frame(spark, []), bench).collect() == [] == op.benchmark_hits(frame(spark, rows), items(spark, [])).collect()
    assert sorted(r["doc_id"] for r in op.without_benchmark(frame(spark, rows), bench).collect()) == [3, 4]
