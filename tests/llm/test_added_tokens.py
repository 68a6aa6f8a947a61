import numpy as np
from tokenizers import Tokenizer

from strandline.llm import packing as op
from strandline.llm.queries import op10_packing, vocabulary


def test_added_tokens_in_texts():
    """Texts that hold an added token have the ids of the tokenizer file at its defaults."""
    path = vocabulary("byte_bpe_50k.json")
    plain, enc = Tokenizer.from_file(path), op.Encoder(path, added=True)
    assert enc.added
    for token in enc.added:
        for text in (token, f"one text{token}and the next {token} end", f"no {token[:-1]} here", "a plain text"):
            assert np.array_equal(enc.ids(text), plain.encode(text, add_special_tokens=False).ids), text


def test_op10_encodes_added_tokens(spark, tmp_path):
    texts = ["one<|endoftext|>two", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["doc_tokens"] for r in op10_packing(spark, str(tmp_path)).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
