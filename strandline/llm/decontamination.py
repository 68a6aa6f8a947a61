"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, union_all
from .textbytes import gram_hashes, mix, prefix_of

#: Characters of a q-gram, and edits allowed for each character of a benchmark item.
GRAM, RATE = 8, 0.1
#: Characters of benchmark items that are searched in one pass over the documents: bounds the broadcast.
BLOCK_CHARS = 2_000_000
_BREAK = np.uint32(0x110000)  # no character: stands between texts
_TABLE_BITS = 22
#: Characters of a text that are searched at once, and matches of q-grams that are counted at once (one part at least).
PART, MATCHES = 4096, 1 << 20
HITS = "doc_id long, item_id long, start long, end long, n_edits long"


def edit_budget(length: int, gram: int = GRAM, rate: float = RATE) -> int:
    """Edits allowed for an item: as many as ``rate`` says and a q-gram can still witness."""
    return min(int(length * rate), length // gram - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)


def _grams(codes: np.ndarray, gram: int) -> np.ndarray:
    return gram_hashes(prefix_of(mix(codes.astype(np.uint64) + np.uint64(1))), gram) if len(codes) >= gram else np.empty(0, dtype=np.uint64)


def aligned(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of all of ``item`` in ``text`` on diagonals low .. low + width - 1, within the budget."""
    far = budget + 1
    x = np.arange(width)
    at = low + x
    cost = np.where((at >= 0) & (at <= len(text)), 0, far)
    start = at.copy()
    padded = np.concatenate([text, [_BREAK]])
    for i, c in enumerate(item, 1):
        j = at + i  # the text's characters used up to here
        same = padded[np.clip(j - 1, 0, len(text))] != c
        over = np.where((j >= 1) & (j <= len(text)), cost + same, far)
        down, down_start = np.append(cost[1:], far) + 1, np.append(start[1:], 0)
        take = down < over
        step, step_start = np.where(take, down, over), np.where(take, down_start, start)
        # A character more of the text: the least cost to the left, plus the distance.
        shifted = (step - x) * width + x
        best = np.minimum.accumulate(shifted)
        source = best % width
        cost = np.minimum(step[source] + x - source, far)
        start = step_start[source]
        cost = np.where((j >= 0) & (j <= len(text)), cost, far)
        if cost.min() >= far:
            return None
    ends = at + len(item)
    k = int(np.lexsort((ends, cost))[0])
    return (int(cost[k]), int(start[k]), int(ends[k])) if cost[k] < far else None


@dataclass
class ItemIndex:
    """The q-grams of a block of benchmark items, with what the lemma asks of each item."""

    ids: np.ndarray
    texts: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray  # shared q-grams that an occurrence within the budget must have
    grams: np.ndarray  # distinct, sorted
    ends: np.ndarray  # of each distinct q-gram's places
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    gram: int

    @classmethod
    def of(cls, rows: list[tuple[int, str]], gram: int, rate: float) -> "ItemIndex":
        texts = [_codes(t) for _, t in rows]
        budget = np.array([edit_budget(len(t), gram, rate) for t in texts])
        least = np.array([len(t) + 1 - gram * (k + 1) for t, k in zip(texts, budget)])
        hashes = [_grams(t, gram) for t in texts]
        item = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        grams, n = np.unique(flat, return_counts=True)
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[grams >> np.uint64(64 - _TABLE_BITS)] = True
        return cls(np.array([i for i, _ in rows]), texts, budget, least, grams, np.cumsum(n), item[order], place[order], table, gram)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits): the best place of each item found in each text.

        Long texts are searched in parts that overlap by more than an occurrence and its band.
        """
        reach = max(len(t) for t in self.texts) + 4 * (int(self.budget.max(initial=0)) + 1) + self.gram
        size = max(PART, 4 * reach)
        parts = [(i, at, c[at : at + size]) for i, c in enumerate(map(_codes, texts)) for at in range(0, max(len(c) - reach, 1), size - reach)]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        exact: set[int] = set()  # text and item whose first whole place is known: nothing later is better
        owner = np.array([i for i, _, _ in parts])
        for part, item, s, e, d in self._found([c for _, _, c in parts], owner, exact):
            i, at, _ = parts[part]
            if d == 0:
                exact.add(i * len(self.ids) + item)
            if (got := (d, s + at, e + at)) < best.get((i, item), (len(self.texts[item]), 0, 0)):
                best[i, item] = got
        return [(i, int(self.ids[item]), s, e, d) for (i, item), (d, s, e) in sorted(best.items())]

    def _found(self, codes: list[np.ndarray], owner: np.ndarray, exact: set[int]) -> Iterator[tuple[int, int, int, int, int]]:
        """(part, item, start, end, edits), with parts taken together as long as their matches are few."""
        starts = np.cumsum([0] + [len(c) + 1 for c in codes])
        data = np.concatenate([np.append(c, _BREAK) for c in codes])
        hashes = _grams(data, self.gram)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _TABLE_BITS)])
        k = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        hit = self.grams[k] == hashes[at]
        at, k = at[hit], k[hit]
        first = np.concatenate([[0], self.ends[:-1]])[k]
        n = self.ends[k] - first
        matches = np.bincount(np.searchsorted(starts, at, side="right") - 1, weights=n, minlength=len(codes)).cumsum()
        low = 0
        while low < len(codes):
            high = max(int(np.searchsorted(matches, (matches[low - 1] if low else 0) + MATCHES, side="right")), low + 1)
            own = slice(*np.searchsorted(at, starts[[low, high]]))
            yield from self._in_bands(codes, starts, owner, exact, at[own], first[own], n[own])
            low = high

    def _in_bands(self, codes: list[np.ndarray], starts: np.ndarray, owner: np.ndarray, exact: set[int], at: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        at = np.repeat(at, n)
        item = self.item[which]
        of = np.searchsorted(starts, at, side="right") - 1
        if exact:
            open_ = ~np.isin(owner[of] * len(self.ids) + item, list(exact))
            at, which, item, of = at[open_], which[open_], item[open_], of[open_]
        # Diagonals are counted from -(longest item), to be positive; two overlapping bands hold each.
        step = self.budget[item] + 1
        shift = max(len(t) for t in self.texts)
        band = (at - starts[of] - self.place[which] + shift) // step
        wide = int(band.max(initial=0)) + 2
        key = (of * len(self.ids) + item) * wide + band
        keys, places = np.concatenate([key, key - 1]), np.tile(self.place[which], 2)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.diff(keys, prepend=-2))
        count = np.diff(np.append(heads, len(keys)))
        enough = np.flatnonzero(count >= self.least[keys[heads] // wide % len(self.ids)])
        # The lemma speaks of different q-grams of the item: a text that repeats itself has one many times.
        kept = [keys[h] for h, n in zip(heads[enough], count[enough]) if len(np.unique(places[order[h : h + n]])) >= self.least[keys[h] // wide % len(self.ids)]]
        found = np.array(kept, dtype=np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for o, b in zip((found // wide).tolist(), (found % wide).tolist()):
            text, i = divmod(o, len(self.ids))
            k = int(self.budget[i])
            low = b * (k + 1) - shift
            if (got := self._place(codes[text], i, low, 2 * (k + 1), k)) and got < best.get((text, i), (k + 1, 0, 0)):
                best[text, i] = got
        for (text, i), (d, s, e) in best.items():
            yield text, i, s, e, d

    def _place(self, text: np.ndarray, i: int, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
        item = self.texts[i]
        from_, to = max(low, 0), max(0, min(low + width + len(item), len(text)))
        region = text[from_:to].tobytes()
        exact = region.find(item.tobytes())
        while exact > 0 and exact % 4:
            exact = region.find(item.tobytes(), exact + 1)
        if exact >= 0:
            return 0, from_ + exact // 4, from_ + exact // 4 + len(item)
        got = aligned(item, text[from_:to], low - from_, width, budget)
        return got and (got[0], got[1] + from_, got[2] + from_)


def item_blocks(benchmark: DataFrame, gram: int = GRAM, rate: float = RATE) -> Iterator[ItemIndex]:
    """Indexes of the benchmark's items, the query set, in blocks of bounded size; items too short for a q-gram are left out."""
    rows, total = [], 0
    chosen = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().orderBy("item_id", "text")
    for r in chosen.toLocalIterator():
        if len(_codes(r["text"])) < gram:
            continue
        if rows and total + len(r["text"]) > BLOCK_CHARS:
            yield ItemIndex.of(rows, gram, rate)
            rows, total = [], 0
        rows.append((r["item_id"], r["text"]))
        total += len(r["text"])
    if rows:
        yield ItemIndex.of(rows, gram, rate)


def _searched(sent, texts: list) -> Iterator[tuple[int, int, int, int, int]]:
    frame = pd.DataFrame({"i": [i for i, t in enumerate(texts) if t], "t": [t for t in texts if t]})
    for part in chunks(iter([frame]), "t", 1 << 19):
        rows = part["i"].tolist()
        for text, *rest in sent.value.search(part["t"].tolist()):
            yield rows[text], *rest


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, rate: float = RATE) -> DataFrame:
    """One row for each benchmark item in each document: doc_id, item_id, start, end, n_edits.

    An item is found if all of it aligns with a part of the document, upper and lower case
    alike, within min(rate * length, length / gram - 1) edits of single characters; of its
    places the one with the fewest edits counts, then the first. start and end count characters
    of the lower-cased text. Any such place shares length + 1 - gram * (edits + 1) q-grams on
    edits + 1 neighbouring diagonals, so the bands lose none.

    Null and empty texts hold nothing; items that are null or shorter than ``gram`` characters
    are not searched. Repeated documents each have their rows; a null doc_id stays null. Empty
    tables give no rows, and other columns are not read. Texts of any length are searched whole,
    in overlapping parts.
    """
    spark = docs.sparkSession

    def of(block: ItemIndex) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # BLOCK_CHARS characters at most, and one item

        def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                ids = frame["doc_id"]
                rows = list(_searched(sent, frame["text"].tolist()))
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "n_edits"], dtype="int64")
                yield out.assign(doc_id=ids.iloc[out["doc_id"]].array)

        # Ids pass through Python as text: a null beside them would make them floats.
        texts = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
        return texts.mapInPandas(find, HITS.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))

    found = [of(b) for b in item_blocks(benchmark, gram, rate)]
    return union_all(found) if found else spark.createDataFrame([], HITS)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, rate: float = RATE) -> DataFrame:
    """The documents that hold no benchmark item; nothing is shuffled."""
    def holder(block: ItemIndex):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        @F.pandas_udf("boolean")
        def holds(texts: pd.Series) -> pd.Series:
            out = np.zeros(len(texts), dtype=bool)
            out[[r[0] for r in _searched(sent, texts.tolist())]] = True
            return pd.Series(out)

        return holds

    clean = docs
    for block in item_blocks(benchmark, gram, rate):
        clean = clean.where(~holder(block)(F.col("text").cast("string")))
    return clean
