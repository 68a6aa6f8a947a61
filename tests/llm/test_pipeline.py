"""The chain on documents whose fate is known, and on odd and empty tables."""

import random
import zlib

import pytest

import corpus_pipeline
from strandline.llm.packing import encoder
from strandline.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, token int"
WORDS = {"en": "the of and water people house river small market window letter green".split(), "de": "der und wasser leute haus fluss kleiner markt fenster brief grün straße".split()}


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(5)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(40)) for _ in range(n))
    texts = {i: (prose(lang, 60), lang) for i, lang in enumerate(["en", "de"] * 20)}
    item = prose("en", 25)
    copied, passage = texts[0][0], prose("de", 40)
    texts |= {
        100: (copied, "en"), 101: (copied + " more", "en"),  # near copies of 0
        102: (None, "en"), 103: ("", "de"), 104: ("12 34 56", "en"),  # no language
        105: (f"{prose('en', 20)} {item} {prose('en', 20)}", "en"),  # holds the benchmark's item
        106: (f"{prose('de', 45)} {passage}", "de"), 107: (f"{passage} {prose('de', 45)}", "de"),  # share a passage
    }
    return texts, item, passage


def write(spark, folder, rows, items):
    spark.createDataFrame([(i, t, lang, "s", 0, 1, 2) for i, t, lang in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_every_document_meets_its_fate(spark, tmp_path, documents):
    texts, item, passage = documents
    rows = [(i, t, lang) for i, (t, lang) in texts.items()] + [(5, *texts[5])]  # a repeated row
    write(spark, str(tmp_path), rows, [(1, item), (2, None)])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = encoder(vocabulary("byte_bpe_50k.json"), True)
    want = {i: t for i, (t, _) in texts.items() if i < 100 or i == 106}
    shared = " " + passage  # 107 has it without the blank before it, and keeps what follows it
    rest = texts[107][0][len(passage) :]
    assert shared in texts[106][0]
    assert {p["doc_id"] for p in pieces} == {*want, 107}
    got = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        got.setdefault(p["doc_id"], []).append(p["ids_crc32"])
    for i, t in {**want, 107: rest}.items():
        ids = [*enc.ids(t).tolist(), 0]
        assert got[i] == [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))]
    places = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:])) and places[0][:2] == (0, 0)


def test_an_empty_table_gives_nothing(spark, tmp_path):
    write(spark, str(tmp_path), [], [(1, "some benchmark item that is long enough")])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
