"""Ids beyond doubles beside a null id, and texts that are long and monotonous."""

import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import decontamination, embeddings, jaccard, langid, licenses, packing, quality, suffixes

BIG = 2**53 + 1
TEXT = "the quick brown fox jumps over the lazy dog and runs away from all of it " * 4
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, TEXT), (None, TEXT), (BIG + 2, f"{TEXT} Released under the MIT License.")]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is None, x))


def test_ids_stay(spark, docs):
    want = [BIG, BIG + 2, None]
    found = jaccard.jaccard_components(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(BIG, BIG), (None, BIG), (BIG + 2, BIG + 2)}
    assert ids(jaccard.keep_one(docs)) == [BIG, BIG + 2]
    assert ids(suffixes.dedup_digests(docs)) == want
    assert ids(licenses.license_hits(docs)) == [BIG + 2]
    item = spark.createDataFrame([(BIG, TEXT[:120])], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_hits(docs, item).collect()} == {(BIG, BIG), (None, BIG), (BIG + 2, BIG)}
    assert ids(packing.pack_documents(docs, TOKENIZER)) == want
    named = docs.selectExpr("doc_id", "text", "'en' lang")
    assert ids(langid.identify(named)) == want
    assert ids(quality.classify(named, spark.createDataFrame([(BIG, 1)], "doc_id long, quality int"))) == want
    vectors = spark.createDataFrame([(BIG, [1.0, 0.0]), (None, [1.0, 0.0]), (BIG + 2, [0.0, 1.0])], "vec_id long, embedding array<float>").coalesce(1)
    assert {(r["vec_id"], r["component_id"], r["n_links"]) for r in embeddings.near_vectors(vectors).collect()} == {(BIG, BIG, 1), (None, BIG, 1), (BIG + 2, BIG + 2, 0)}


def test_packing_takes_long_runs_of_blanks(spark):
    text = "a" + " " * 300_000 + "b\n" + "\t" * 70_000
    rows = packing.tokenized_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), TOKENIZER, 1024).orderBy("start").collect()
    want = np.append(np.array(Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids, dtype="<u4"), np.uint32(0))
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(want[i : i + 1024].tobytes()) for i in range(0, len(want), 1024)]


def test_decontamination_takes_monotonous_texts():
    index = decontamination.ItemIndex.of([(1, "ab" * 300), (2, "the quick brown fox jumps over the lazy dog " * 4)], 8, 0.1)
    began = time.time()
    text = "ab" * 250_000 + " the quick brown fox jumped over the lazy dog" * 4
    assert [r[:2] for r in index.search([text, "b" * 500_000])] == [(0, 1), (0, 2)]
    assert time.time() - began < 30


def test_parts_of_a_long_text_lose_nothing():
    item = "pack my box with five dozen liquor jugs and send it to the address below today"
    index = decontamination.ItemIndex.of([(7, item)], 8, 0.1)
    filler = "".join(chr(97 + i * i % 23) for i in range(9000))
    for at in (0, 3300, 4000, 4090, 8000):
        changed = item.replace("dozen", "dozan")
        assert index.search([filler[:at] + changed + filler[at:]]) == [(0, 7, at, at + len(item), 1)]


def test_licenses_take_long_texts():
    text = "word " * 100_000 + "Released under the MIT License. " + "more " * 100_000
    assert [r[:2] for r in licenses.scan(text)] == [("MIT", 500_000)]
