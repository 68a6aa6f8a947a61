import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from strandline.llm import langid as op

SCHEMA = "doc_id long, text string, lang string, gram int, lang_pred int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2) for i, t, lang in rows], SCHEMA).repartition(3)


def brute_bits(texts, text, alphabet):
    """Code length of ``text`` after ``texts`` by the definition: counts, escapes as often as kinds, full exclusion."""
    counts = defaultdict(Counter)
    for t in texts:
        data = b"\n" * 3 + t.lower().encode()
        for i in range(3, len(data)):
            for k in range(4):
                counts[data[i - k : i]][data[i]] += 1

    def p(context, byte):
        if context is None:
            return 1 / 256
        seen, shorter = counts.get(context), context[1:] if context else None
        if not seen:
            return p(shorter, byte)
        total, kinds = sum(seen.values()), len(seen)
        # bytes that no language ever saw are told apart, and count as one class of symbols
        left = sum(p(shorter, b) for b in alphabet if b not in seen) + (256 - len(alphabet)) * p(shorter, None) if len(alphabet) < 256 else sum(p(shorter, b) for b in alphabet if b not in seen)
        if byte in seen:
            return seen[byte] / (total + kinds)
        return kinds / (total + kinds) * p(shorter, byte) / left

    data = b"\n" * 3 + text.lower().encode()
    return sum(-math.log2(p(data[i - 3 : i], data[i])) for i in range(3, len(data)))


def test_code_lengths_equal_the_definition(spark):
    texts = {"aa": ["abca bac", "cab abc"], "bb": ["acca", "bcb cb ac"]}
    rows, i = [], 0
    for lang, own in texts.items():
        for t in own:
            while zlib.crc32(str(i).encode()) % 3 == 1:
                i += 1
            rows.append((i, t, lang))
            i += 1
    trees = op.train(frame(spark, rows))
    alphabet = set("".join(sum(texts.values(), [])).encode())
    for text in ("abc", "bca cab", "a", "cc bb"):
        got = trees.lengths([text])[0]
        for lang, bits in zip(trees.langs, got):
            assert bits == pytest.approx(brute_bits(texts[lang], text, alphabet), rel=1e-5)


def test_held_out_documents_teach_nothing_and_are_told(spark):
    rng = random.Random(3)
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zwölf große boxkämpfer jagen viktor".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i in range(90) for lang in [("aa", "bb")[i % 2]]]
    got = op.identify(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    assert all(r["lang_pred"] == ("aa", "bb")[r["doc_id"] % 2] and 0.5 < r["score"] <= 1 for r in got)
    # what held-out rows say of themselves changes nothing
    lies = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    assert {tuple(r) for r in op.identify(frame(spark, lies)).collect()} == {tuple(r) for r in got}


def test_nulls_ties_repeats_long_texts_and_nothing(spark):
    rows = [(0, "abc abc", "aa"), (2, "abc abc", "bb"), (5, None, "aa"), (6, "", "aa"), (7, "12 34", "aa"), (None, "abc", "aa"), (9, "abc " * 50_000, None), (9, "abc " * 50_000, None)]
    got = Counter((r["doc_id"], r["lang_pred"]) for r in op.identify(frame(spark, rows)).collect())
    assert got == Counter({(0, "aa"): 1, (2, "aa"): 1, (5, "und"): 1, (6, "und"): 1, (7, "und"): 1, (None, "aa"): 1, (9, "aa"): 2})
    assert op.identify(frame(spark, [])).collect() == []
    assert {r["lang_pred"] for r in op.identify(frame(spark, [(1, "abc", None)])).collect()} == {"und"}
