"""Token counts: a Viterbi search that carries only the best score and the piece count."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the tokenizer takes off the lowest score for a character that no piece matches (fixed value).
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers at most, and the longest such word.
MEMO_WORDS, MEMO_CHARS = 400_000, 64


class UnigramCounter:
    """Counts the pieces of the best segmentation under a unigram vocabulary, without building it.

    An Aho-Corasick automaton lists all pieces that end at each character. At each end the
    longest piece comes first and a later one wins only by a strictly higher score, which is
    the tokenizer's tie rule; a character that is no piece itself may be an unknown of the
    lowest score less a penalty and counts as many pieces as it has UTF-8 bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.scores = dict(pieces)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word, which starts with the space mark."""
        n = len(word)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        at, single = 0, True  # the end whose pieces are being read, and whether its last character is a piece
        unknown = self.unknown

        def settle(end: int) -> None:
            """Offer the unknown character that ends at ``end``."""
            s = score[end - 1] + unknown
            if score[end] is None or s > score[end]:
                score[end] = s
                count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))

        for last, (length, piece) in self.automaton.iter(word):
            end = last + 1
            while at < end:
                if at and not single:
                    settle(at)
                at, single = at + 1, False
            s = score[end - length] + piece
            if score[end] is None or s > score[end]:
                score[end], count[end] = s, count[end - length] + 1
            single = single or length == 1
        while at <= n:
            if at and not single:
                settle(at)
            at, single = at + 1, False
        return count[n]

    def text(self, text: str) -> int:
        """Pieces of a whole text; each space starts a word, and a first word without one gets it."""
        total, memo = 0, self.memo
        if not text:
            return 0
        text = text.replace("▁", " ").removeprefix(" ")  # the space mark itself counts as a space
        for word in text.split(" "):
            n = memo.get(word)
            if n is None:
                n = self.word("▁" + word)
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in range(len(model))])


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``: the unigram pieces of each whole text (null and empty: 0).

    ``vocabulary`` is the path of a sentencepiece file on every machine; its pieces and scores
    are the unigram vocabulary, so the count is that of a unigram tokenizer with byte fallback
    and a space mark before each word. Nothing is shuffled. Columns of ``docs`` stay; one
    named n_tokens is replaced.
    """
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(vocabulary)
        for s in texts:
            yield pd.Series([c.text(t) if isinstance(t, str) else 0 for t in s], dtype="int64")

    return docs.withColumn("n_tokens", count(F.col(text)))
