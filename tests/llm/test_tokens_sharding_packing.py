import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from strandline.llm.packing import Encoder, pack_documents, pack_histogram, sequence_ids
from strandline.llm.sharding import locate, shard_documents
from strandline.llm.tokens import UnigramCounter, counter, token_counts

TEXTS = ["", None, "a", "Hello  wörld 漢字\n☃ xx", "  two  spaces\t tab \n\n end ", "don't 's  it's", "x" * 3000, "the " * 900, "🙂🙃 \x1c é", "same words", "same words", "<|endoftext|> in text", "▁▁ ▁ <s> <0x0A>"]
SCHEMA = "doc_id long, text string, shard string, length int, rank int, n_tokens string"


def frame(spark, texts=TEXTS, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "clash", 7, 7, "clash") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def test_token_counts_equal_the_tokenizer(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = list(counter(path).scores.items())
    full = Tokenizer(models.Unigram(pieces, 0, True))
    full.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame(spark), path).collect()}
    for i, t in enumerate(TEXTS):
        if t:
            assert got[i] == len(full.encode(t, add_special_tokens=False).ids), repr(t)
    assert got[0] == got[1] == 0


def test_viterbi_ties_follow_the_tokenizer():
    rng = random.Random(5)
    for _ in range(60):
        pieces = [("<unk>", 0.0)] + [("".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))), float(-rng.randint(1, 3))) for _ in range(12)]
        pieces = list(dict(pieces).items())
        full = Tokenizer(models.Unigram(pieces, 0, False))
        own = UnigramCounter(pieces)
        for _ in range(20):
            word = "".join(rng.choice("abc▁") for _ in range(rng.randint(1, 9)))
            if all(c in own.scores for c in word):
                assert own.word(word) == len(full.encode(word).ids), (pieces, word)


def test_sharding_is_a_gapless_reproducible_shuffle(spark):
    texts = TEXTS * 9
    rows = shard_documents(frame(spark, texts), 8, 20).collect()
    again = shard_documents(frame(spark, texts).repartition(1), 8, 20).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        assert (r["shard"], r["slot"]) == locate(r["row_number"], len(texts), 8, 20)
    assert [r["row_number"] for r in sorted(rows, key=lambda r: r["doc_id"])] == list(range(len(texts)))
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)


def test_sharding_of_repeats_nulls_and_nothing(spark):
    rows = shard_documents(frame(spark, ["x"] * 20, [1] * 10 + [None] * 10), 8).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 20
    assert shard_documents(frame(spark, []), 8).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation_is_onto(n):
    assert sorted(s * 1 + t * 3 for s, t in (locate(i, n, 3, 7) for i in range(n))) == list(range(n))


def test_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    full = Tokenizer.from_file(path)
    full.encode_special_tokens = True
    enc, rng = Encoder(path), random.Random(3)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("ab é'!1\n\t \x1c  ") for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert enc.ids(t).tolist() == full.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_is_exact(spark):
    path, length = public_tokenizers.path("byte_bpe_50k.json"), 64
    docs = frame(spark)
    placed = pack_documents(docs, path, length)
    rows = placed.collect()
    enc = Encoder(path)
    whole = {i: np.append(enc.ids(t) if t else np.empty(0, "<u4"), np.uint32(0)).astype("<u4") for i, t in enumerate(TEXTS)}
    for i, ids in whole.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
    used = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= length and sorted(used) == list(range(len(used)))
    assert len(used) <= -(-sum(used.values()) // length) + 1
    built = {r["sequence_id"]: r["ids"] for r in sequence_ids(docs, placed, path, length).collect()}
    assert {k: len(v) for k, v in built.items()} == used
    first = next(r for r in rows if r["doc_id"] == 7 and r["start"] == 64)
    assert built[first["sequence_id"]][first["offset"] : first["offset"] + first["length"]] == whole[7][64:128].tolist()
    assert pack_documents(frame(spark, []), path, length).collect() == []
    assert sorted((r["doc_id"] or -1, r["length"]) for r in pack_documents(frame(spark, [None, "", "a"], [None, 3, 3]), path, length).collect()) == [(-1, 1), (3, 1), (3, 2)]


def test_histogram_packs_hold_everything():
    rng = random.Random(1)
    for _ in range(40):
        hist = {rng.randint(1, 50): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
        packs, held = pack_histogram(hist, 50), {}
        for pattern, n in packs.items():
            assert sum(pattern) <= 50 and list(pattern) == sorted(pattern, reverse=True)
            for s in pattern:
                held[s] = held.get(s, 0) + n
        assert held == hist
