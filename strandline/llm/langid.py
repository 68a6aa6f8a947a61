"""Language identification: prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, gathered
from .textbytes import joined

#: Bytes of context at most.
ORDER = 3
#: Training documents of each language at most: a documented bound, the same at every size.
TRAINING_DOCUMENTS = 3000
#: Contexts of the tree at most; the rarest of the longest go first.
CONTEXTS = 60_000
_letter = re.compile(r"[^\W\d_]")


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents that no statistics come from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _plain(text: str) -> bytes:
    """Lower case, after a line end that stands for the beginning."""
    return b"\n" * ORDER + text.lower().encode("utf-8", "replace")


def _grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte after its ORDER predecessors, as one number; not over a text's own beginning."""
    if len(data) <= ORDER:
        return np.empty(0, dtype=np.uint32)
    d = data.astype(np.uint32)
    out = (d[:-3] << np.uint32(24)) | (d[1:-2] << np.uint32(16)) | (d[2:-1] << np.uint32(8)) | d[3:]
    inside = np.ones(len(out), dtype=bool)
    for k in range(ORDER):
        at = starts[1:-1] + k - ORDER
        inside[at[(at >= 0) & (at < len(out))]] = False
    return out[inside]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of four-byte runs in the training sample.

    The sample is, for each language, the TRAINING_DOCUMENTS documents with the smallest hash
    of their id among those that are not held out and have a language and a text.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= TRAINING_DOCUMENTS).select("doc_id", F.col("lang").alias("__lang")).distinct()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(gathered(frames, "text"), "text", 8 << 20):
            for lang, own in frame.groupby("lang"):
                gram, n = np.unique(_grams(*joined([_plain(t) for t in own["text"]])), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n})

    # TRAINING_DOCUMENTS ids for each language bound the broadcast.
    sample = usable.join(F.broadcast(chosen), (usable["doc_id"] == chosen["doc_id"]) & (usable["lang"] == chosen["__lang"]), "left_semi")
    return sample.select("lang", F.col("text").cast("string")).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class ContextTrees:
    """Code lengths in bits for every (context, byte, language), flattened from the trees."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol; 0 for bytes that training never saw
    second: np.ndarray  # two symbols -> row of their longest context
    third: np.ndarray  # number of a two-symbol context, symbol -> row, or -1
    pairs: np.ndarray  # two symbols -> number of a two-symbol context, or -1
    bits: np.ndarray  # row, symbol -> code length for each language

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language."""
        data, starts = joined([_plain(t) for t in texts])
        s = self.symbol[data]
        size = self.bits.shape[1]
        if len(s) <= ORDER:
            return np.zeros((len(texts), len(self.langs)))
        near = s[1:-2] * size + s[2:-1]
        far = self.pairs[s[:-3] * size + s[1:-2]]
        row = self.third[far * size + s[2:-1]]
        row = np.where((far >= 0) & (row >= 0), row, self.second[near])
        got = self.bits.reshape(-1, len(self.langs))[row * size + s[3:]]
        total = np.zeros((len(got) + 1, len(self.langs)))
        np.cumsum(got, axis=0, dtype=np.float64, out=total[1:])
        return total[starts[1:] - ORDER] - total[starts[:-1]]


def _escape(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities after contexts with these counts: seen symbols by count, and an escape.

    The escape counts as often as different symbols were seen; its mass goes to the symbols
    not seen here in proportion to the next shorter context (full exclusion). A context that
    a language never had hands on to the shorter one.
    """
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    unseen = np.where(counts > 0, 0.0, shorter)
    left = unseen.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(left > 0, total + kinds, total)
        p = np.where(counts > 0, counts / scale, np.where(left > 0, kinds / scale * shorter / left, 0.0))
    return np.where(total > 0, p, shorter)


def grow(counts: pd.DataFrame) -> ContextTrees | None:
    """Build the trees from (lang, gram, n); None where there is nothing to learn from."""
    if not len(counts):
        return None
    langs = sorted(counts["lang"].unique())
    gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    of = np.searchsorted(langs, counts["lang"].to_numpy(dtype=str))
    parts = np.stack([gram >> 24, gram >> 16 & 255, gram >> 8 & 255, gram & 255])
    seen = np.unique(parts)
    size = len(seen) + 1
    symbol = np.zeros(256, dtype=np.int64)
    symbol[seen] = np.arange(1, size)
    a, b, c, d = symbol[parts]
    unseen_bytes = max(256 - len(seen), 1)

    # Before any context all bytes are alike; symbol 0 is all bytes that training never saw.
    base = np.full((1, size), 1.0 / 256)
    base[0, 0] = unseen_bytes / 256
    rows: list[list[np.ndarray]] = [[] for _ in langs]
    contexts = {1: c, 2: b * size + c, 3: (a * size + b) * size + c}
    ids = {k: np.unique(v) for k, v in contexts.items()}
    mass = np.bincount(np.searchsorted(ids[3], contexts[3]), weights=n, minlength=len(ids[3]))
    if len(ids[3]) > CONTEXTS:
        ids[3] = np.sort(ids[3][np.lexsort((ids[3], -mass))[:CONTEXTS]])
    for k in range(len(langs)):
        own = of == k
        p = _escape(np.bincount(d[own], weights=n[own], minlength=size)[None, :], base)
        rows[k].append(p)
        above = np.zeros(len(ids[1]), dtype=np.int64)
        for order in (1, 2, 3):
            if order > 1:
                above = np.searchsorted(ids[order - 1], ids[order] % size ** (order - 1))
            key = contexts[order][own]
            at = np.minimum(np.searchsorted(ids[order], key), len(ids[order]) - 1)
            kept = ids[order][at] == key
            table = np.bincount(at[kept] * size + d[own][kept], weights=n[own][kept], minlength=len(ids[order]) * size).reshape(-1, size)
            p = _escape(table, p[above])
            rows[k].append(p)
    first = np.cumsum([1, len(ids[1]), len(ids[2])])
    bits = -np.log2(np.stack([np.concatenate(r) for r in rows], axis=2))
    bits[:, 0, :] += np.log2(unseen_bytes)  # to tell them apart
    one = np.zeros(size, dtype=np.int64)
    one[ids[1]] = first[0] + np.arange(len(ids[1]))
    second = np.tile(one, size)
    second[ids[2]] = first[1] + np.arange(len(ids[2]))
    pairs = np.full(size * size, -1, dtype=np.int64)
    two = np.unique(ids[3] // size)
    pairs[two] = np.arange(len(two))
    third = np.full((len(two) + 1) * size, -1, dtype=np.int32)
    third[pairs[ids[3] // size] * size + ids[3] % size] = first[2] + np.arange(len(ids[3]))
    return ContextTrees([str(x) for x in langs], symbol, second.astype(np.int32), third, pairs, bits.astype(np.float32))


def train(docs: DataFrame) -> ContextTrees | None:
    """Learn the trees; four-byte runs of a bounded sample come to the driver, at most ORDER + 1 bytes long each."""
    return grow(gram_counts(docs).toPandas())


def predict(docs: DataFrame, trees: ContextTrees | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row of ``docs``, from the whole text alone.

    lang_pred is the language of the shortest code, ties going to the first name; score is
    that language's share of the likelihood. A null text, one without a letter, or no training
    data at all gives `und` and 0. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # CONTEXTS rows at most

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = sent.value
        for s in texts:
            out = [("und", 0.0)] * len(s)
            known = [i for i, t in enumerate(s) if isinstance(t, str) and _letter.search(t)] if trees else []
            frame = pd.DataFrame({"i": known, "t": [s.iat[i] for i in known]})
            for part in chunks(iter([frame]), "t"):
                bits = trees.lengths(part["t"].tolist())
                best = bits.argmin(1)
                share = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
                for i, k, p in zip(part["i"], best, share):
                    out[i] = (trees.langs[k], float(p))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("__guess", guess(F.col(text).cast("string"))).select("*", "__guess.lang_pred", "__guess.score").drop("__guess")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for all documents, learned from those not held out.

    Rows without a language or text teach nothing; repeated rows are predicted each; a null
    doc_id is predicted but never learned from; an empty table gives no rows.
    """
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
