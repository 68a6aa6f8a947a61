"""Packing: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, with_global_rank

#: Blanks in a row from which on the tokenizers library encodes a text.
BLANKS = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of a tokenizers file.

    Byte-level BPE whose ids follow the order of its merges is encoded by tiktoken, which gives
    the same ids in a sixth of the time; any other file, and a text that holds an added token
    (as <|endoftext|>), by tokenizers itself. Without ``added`` such tokens are encoded as text.
    """

    def __init__(self, path: str, added: bool = False):
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens") or []] if added else []
        self.path, self.as_text, self.ranks = path, not added, _rank_encoding(path)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = self.as_text
        return out

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is not None and not any(t in text for t in self.added) and not _long_blank(text):
            return np.array(self.ranks.encode_ordinary(text), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _long_blank(text: str) -> bool:
    """Whether blanks run on so far that tiktoken's pattern could exhaust its stack."""
    return len(text) > BLANKS and any(m.end() - m.start() > BLANKS for m in re.finditer(r"\s+", text))


def _rank_encoding(path: str):
    """The file as a tiktoken encoding, or None where its ids would not be the same."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") not in (None, "BPE") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
        return None
    # Byte-level files show a byte as itself where that is printable, and the others as the characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    bytes_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [vocab.get(t, -1) for t in merged]
    if ids != list(range(256, 256 + len(ids))) or len(vocab) != 256 + len(ids):
        return None
    ranks = {bytes(bytes_of[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def encoder(path: str, added: bool = False) -> Encoder:
    return Encoder(path, added)


def _text_id(schema: str) -> str:
    """Ids pass through Python as text: a null beside them would make them floats."""
    return schema.replace("doc_id long", "doc_id string")


def _by_text_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int = 0, added: bool = False) -> DataFrame:
    """Cut each document's ids (and a closing ``end_id``) into pieces of at most ``length`` ids.

    A null or empty text has the closing id alone. ids_crc32 is over the piece's ids as
    little-endian 32-bit numbers.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer, added), np.array([end_id], dtype="<u4")
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                ids = np.append(enc.ids(text), end) if text else end
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    rows.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
    return _by_text_id(texts.mapInPandas(cut, _text_id(PIECES)))


def pack_histogram(histogram: dict[int, int], length: int) -> Counter:
    """Counts of packing patterns (tuples of lengths, longest first) that hold the whole histogram.

    Lengths go in from the longest; each goes to the packs with the most room left, as many of
    them as share that room at once, and opens new packs where none has room. The work follows
    the number of distinct lengths, not of pieces.
    """
    rooms: dict[int, Counter] = {}
    heap: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if room not in rooms:
            rooms[room] = Counter()
            heapq.heappush(heap, -room)
        rooms[room][pattern] += n

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and heap and -heap[0] >= size:
            room = -heap[0]
            packs = rooms[room]
            # Packs of one room that share a pattern move together, each taking one piece.
            pattern = min(packs)
            n = packs.pop(pattern)
            if not packs:
                del rooms[room]
                heapq.heappop(heap)
            used = min(n, left)
            left -= used
            if n > used:
                put(room, pattern, n - used)
            put(room - size, pattern + (size,), used)
        if left:
            # New packs have the same room, so they are filled evenly: with `fit` pieces at most.
            fit = length // size
            full, more = divmod(left, fit)
            if full:
                put(length - fit * size, (size,) * fit, full)
            if more:
                put(length - more * size, (size,) * more, 1)
    total: Counter = Counter()
    for packs in rooms.values():
        total.update(packs)
    return total


class Places:
    """Where the piece of a length and a rank within that length goes; as large as the patterns."""

    def __init__(self, patterns: Counter):
        base, runs = 0, {}
        for pattern, n in sorted(patterns.items(), reverse=True):
            at = 0
            for size in dict.fromkeys(pattern):
                many = pattern.count(size)
                runs.setdefault(size, []).append((many * n, base, many, at))
                at += many * size
            base += n
        self.by = {}
        for size, found in runs.items():
            n, first, many, at = (np.array(x, dtype=np.int64) for x in zip(*found))
            self.by[size] = (np.cumsum(n), np.cumsum(n) - n, first, many, at)
        self.sequences = base

    def find(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, starts, first, many, at = self.by[size]
        i = np.searchsorted(ends, ranks, side="right")
        pack, copy = np.divmod(ranks - starts[i], many[i])
        return first[i] + pack, at[i] + copy * size


def pack(pieces: DataFrame, length: int) -> DataFrame:
    """Place pieces (doc_id, start, length, ...) into sequences: adds ``sequence_id`` and ``offset``.

    Pieces are ranked within their length by doc_id and start; the histogram of lengths, at
    most ``length`` rows, is packed by ``pack_histogram``, and each rank is looked up in the
    patterns. Whatever a length's share of the rows, ranks come from range partitions.
    """
    ranked = with_global_rank(pieces, ["length", "doc_id", "start", "ids_crc32"], "__rank")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    first, total = {}, 0
    for size in sorted(counts):
        first[size] = total
        total += counts[size]
    places = Places(pack_histogram(counts, length))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size, rank = frame["length"].to_numpy(), frame.pop("__rank").to_numpy()
            seq, off = np.empty(len(frame), dtype=np.int64), np.empty(len(frame), dtype=np.int64)
            for s in np.unique(size):
                own = size == s
                seq[own], off[own] = places.find(int(s), rank[own] - first[int(s)])
            yield frame.assign(sequence_id=seq, offset=off)

    ranked = ranked.withColumn("doc_id", F.col("doc_id").cast("string"))
    return _by_text_id(ranked.mapInPandas(place, _text_id(f"{PIECES}, sequence_id long, offset long")))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, added: bool = False) -> DataFrame:
    """Tokenize all documents and pack them into sequences of at most ``length`` ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. ``added`` gives added tokens in a text their own ids, as the file does by default. Null and empty texts are one piece of one id; repeated rows are packed each; a
    null doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    # Ranking reads the pieces twice; the texts are encoded once.
    return pack(materialize(tokenized_pieces(docs, tokenizer, length, added=added)), length)


def sequence_ids(docs: DataFrame, placed: DataFrame, tokenizer: str, length: int = 1024, added: bool = False) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, whose length is at most ``length``."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer, added), np.array([0], dtype="<u4")
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                ids = np.append(enc.ids(text), end) if text else end
                rows += [(doc_id, at, ids[at : at + length].tolist()) for at in range(0, len(ids), length)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "ids"])

    cuts = docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(cut, "doc_id long, start long, ids array<int>")
    joined = placed.join(cuts, ["doc_id", "start"])
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
