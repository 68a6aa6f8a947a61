"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model of trusted text."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, chunks, drop, gathered, materialize, shuffle_width, text_of, union_all
from .textbytes import mix, word_hashes

#: Of the trusted documents one in so many sets thresholds instead of counts.
CALIBRATION = 8
#: The quantile of trusted perplexities, language by language, up to which a document is kept.
QUANTILE = 0.995
#: Words of trusted text whose weights every task holds, those counted most; the others are asked
#: for. It bounds the broadcast and decides where a weight is looked up, never whether.
HELD = 1 << 18
#: Bytes of text whose n-grams a task brings together before it sends them on.
RUN_BYTES = 32 << 20
#: Documents ask for the weights of their n-grams in so many rounds, each for a part of the keys:
#: only that part of the requests stands on disk at once. Each round hashes all texts again.
ROUNDS = 4
#: What stands for words outside a closed vocabulary, and for the end of a text, among word hashes.
UNKNOWN, END = 0, 1


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: zstandard over first bytes, second bytes and so on."""
    squeeze, out = zstandard.ZstdCompressor(level=1).compress, []
    for x in arrays:
        body = squeeze(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
        out.append(struct.pack("<cQQ", x.dtype.char.encode(), len(x), len(body)) + body)
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    expand, out, at = zstandard.ZstdDecompressor().decompress, [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<cQQ", data, at)
        at += struct.calcsize("<cQQ")
        kind = np.dtype(kind.decode())
        planes = np.frombuffer(expand(data[at : at + size]) if n else b"", dtype=np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences, which have fewer bytes than ascending hashes; a sum gives those back."""
    return np.diff(ascending, prepend=np.uint64(0))


def _runs(ascending: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1])[: len(ascending)])


def _first_key(shards: int) -> np.ndarray:
    """The least key of each shard: shards are ranges of hashes, equal in width."""
    return np.array([(k << 64) // shards for k in range(shards)], dtype=np.uint64)


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of each shard that ascending ``keys`` have."""
    cuts = np.append(np.searchsorted(keys, _first_key(shards)), len(keys)).tolist()
    return ((k, i, j) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i)


def _by_shard(df: DataFrame) -> DataFrame:
    """The rows (kind, shard, source, data) of a shard in one task, in order: tasks take them one by one."""
    return df.repartition(shuffle_width(df.sparkSession), "shard").sortWithinPartitions("shard", "kind", "source")


def _shards(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator]]:
    rows = (r for f in frames for r in f.itertuples(index=False))
    return groupby(rows, key=lambda r: r.shard)


PACKED = "kind int, shard int, source long, data binary"


def _packed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "shard", "source", "data"])


def _at_most(table: DataFrame, most: int) -> tuple[int, DataFrame]:
    """The least count n that at most ``most`` rows of (.., n) reach, and those rows."""
    steps = table.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()  # a few hundred steps
    total, cut = 0, (steps[0]["n"] + 1) * 4 if steps else 1
    for r in steps:
        total += r["k"]
        if total > most:
            break
        cut = r["n"]
    return cut, table.where(F.col("n") >= cut)


def word_counts(docs: DataFrame, shards: int) -> DataFrame:
    """(word, n) over all texts; words are hashes."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in gathered(frames, "text", RUN_BYTES):
            parts = [np.unique(word_hashes(p["text"].tolist())[0], return_counts=True) for p in chunks(iter([frame]), "text", 1 << 20)]
            word, n = _summed(*(np.concatenate(x) for x in zip(*parts)))
            yield _packed([(0, k, 0, _pack(_steps(word[i:j]), n[i:j])) for k, i, j in _dealt(word, shards)])

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _shards(frames):
            parts = [_unpack(r.data) for r in rows]
            word, n = _summed(np.concatenate([np.cumsum(x) for x, _ in parts]), np.concatenate([n for _, n in parts]))
            yield pd.DataFrame({"shard_words": [len(word)], "data": [_pack(word, n)]})

    return _by_shard(docs.select(text_of().alias("text")).mapInPandas(count, PACKED)).mapInPandas(total, "shard_words long, data binary")


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sums of their numbers."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _ids(texts: list[bytes], vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, next word, words of each text), words as hashes; without a vocabulary all words are told apart."""
    words, first = word_hashes(texts)
    n = np.diff(first)
    if vocabulary is not None:
        at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
        words = np.where(vocabulary[at] == words, words, np.uint64(UNKNOWN)) if len(vocabulary) else np.zeros(len(words), dtype=np.uint64)
    nxt = np.append(words[1:], np.uint64(0))[: len(words)]
    nxt[first[1:][n > 0] - 1] = END
    return np.repeat(np.arange(len(texts)), n), words, nxt, n


def _keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key for each bigram of word hashes."""
    return mix(v ^ mix(w + np.uint64(0x9E3779B97F4A7C15)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in the sorted ``keys``, and the places of those."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, at[hit]


def _discounts(t: dict[int, int]) -> np.ndarray:
    """D1, D2 and D3+ of modified Kneser-Ney, from the numbers of grams counted once to four times."""
    if not all(t.get(k) for k in (1, 2, 3, 4)):
        return np.array([0.0, 0.5, 1.0, 1.5])  # too little text for the estimate
    y = t[1] / (t[1] + 2 * t[2])
    return np.array([0.0] + [min(max(k - (k + 1) * y * t[k + 1] / t[k], 0.05), k - 0.05) for k in (1, 2, 3)])  # a little is always taken and left


class Model:
    """An interpolated modified Kneser-Ney bigram model, as weights that add up over a text.

    With P1 a word's continuation probability, interpolated with the uniform one, and g(v) what
    context v leaves to unseen words, a text of n words costs n + 1 times log P1 of a word that
    trusted text lacks (``base``), ``end`` for its end, and the weights of its words and bigrams
    that trusted text has: log P1(w) + log g(w) - base for each word, and
    log P(w | v) - log g(v) - log P1(w) for each bigram. All words count; counts are distributed
    tables, dealt into shards by ranges of 64-bit keys of words and bigrams and packed, and
    weights are made of them where they are asked for. Tasks hold the
    weights of the ``held`` most frequent words. With ``size`` words outside the ``size`` most
    frequent ones are one unknown word, which costs the log of the number of different unknown
    words more.
    """

    def __init__(self, docs: DataFrame, trusted: DataFrame, size: int | None = None, held: int | None = None):
        spark, held = docs.sparkSession, HELD if held is None else held
        self.old: list[str] = []
        # No more shards than needed: what they send one another grows with the square of their number.
        self.shards = shards = max(16, shuffle_width(spark) // 2)
        counts = materialize(word_counts(docs, shards), self.old)
        kinds = counts.agg(F.sum("shard_words")).first()[0] or 0
        self.vocabulary, self.kinds = None, 1
        if size is not None:
            def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for word, n in (_unpack(x) for f in frames for x in f["data"].tolist()):
                    yield pd.DataFrame({"word": word.view(np.int64), "n": n})

            rows = counts.select("data").mapInPandas(listed, "word long, n long")
            self.vocabulary = np.sort(_at_most(rows, size)[1].select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64))  # size rows at most
            self.kinds, kinds = max(kinds - len(self.vocabulary), 1), len(self.vocabulary)
        drop(spark, self.old.pop())
        sent = spark.sparkContext.broadcast(self.vocabulary)
        self.pairs = materialize(_pair_counts(trusted, sent, shards), self.old)
        times = self.pairs.agg(*[F.sum(F.get("times", F.lit(k))) for k in range(4)]).first()
        self.discounts = _discounts({k + 1: n or 0 for k, n in enumerate(times)})
        self.words = materialize(_word_numbers(self.pairs, self.discounts, shards), self.old)
        *into, types, ends = (n or 0 for n in self.words.agg(*[F.sum(F.get("stats", F.lit(k))) for k in range(7)]).first())
        self.empty, self.types = not types, max(types, 1)
        self.cut1 = _discounts(dict(enumerate(into[:4], 1)))
        self.share = (float(sum(m * self.cut1[min(k, 3)] for k, m in enumerate(into, 1))) or 1.0) / self.types / (kinds + 2)
        self.base = float(np.log(self.share))
        self.end = float(np.log(self.first(np.array([ends]))[0])) - self.base
        weights = self.weights()

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in (x for f in frames for x in f["data"].tolist()):
                word, n, weight = weights.of_words(x)
                yield pd.DataFrame({"word": word.view(np.int64), "n": n, "weight": weight})[word != END]

        table = self.words.where("kind = 2").select("data").mapInPandas(rows, "word long, n long, weight double")
        self.held = _columns(_at_most(table, held)[1], "word", "weight")  # held rows at most
        sent.destroy()

    def first(self, k: np.ndarray) -> np.ndarray:
        """P1 of words that follow k different ones."""
        return self.weights().first(k)

    def weights(self) -> "Weights":
        return Weights(self.discounts, self.cut1, self.types, self.share, self.base)

    def free(self) -> None:
        """Drop the tables, when all scores are written."""
        for path in self.old:
            drop(self.pairs.sparkSession, path)


class Weights:
    """The numbers that all weights share, and the weights of a shard's words and bigrams: for tasks."""

    def __init__(self, discounts: np.ndarray, cut1: np.ndarray, types: int, share: float, base: float):
        self.discounts, self.cut1, self.types, self.share, self.base = discounts, cut1, types, share, base

    def first(self, k: np.ndarray) -> np.ndarray:
        return (k - self.cut1[np.minimum(k, 3)]) / self.types + self.share

    def of_words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, their counts as a context or as what follows, and their weights."""
        steps, total, taken, k = _unpack(data)
        left = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
        return np.cumsum(steps), np.maximum(total, k), np.log(self.first(k)) + np.log(left) - self.base

    def of_pairs(self, data: bytes, taken: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of bigrams and their weights, from what is taken off each context's counts and each next word's k."""
        v, times, w, at, n = _unpack(data)
        weight = np.log1p((n - self.discounts[np.minimum(n, 3)]) / (np.repeat(taken, times) * self.first(k)[at]))
        return _keys(np.repeat(np.cumsum(v), times), np.cumsum(w)[at]), weight


def _pair_counts(trusted: DataFrame, vocabulary, shards: int) -> DataFrame:
    """(shard, times, data): the counts of a shard's bigrams, packed, and how many there are of one to four."""
    def packed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order]
        first, (next_words, at) = _runs(v), np.unique(w, return_inverse=True)
        return _pack(_steps(v[first]), np.diff(np.append(first, len(v))), _steps(next_words), at.astype(np.uint32), n)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in gathered(frames, "text", RUN_BYTES // 2):
            parts = [_ids(p["text"].tolist(), vocabulary.value)[1:3] for p in chunks(iter([frame]), "text")]
            v, w = (np.concatenate(x) for x in zip(*parts))
            key = _keys(v, w)
            order = np.argsort(key)
            key = key[order]
            first = _runs(key)
            n, order, key = np.diff(np.append(first, len(key))), order[first], key[first]
            v, w = v[order], w[order]
            yield _packed([(0, k, 0, packed(v[i:j], w[i:j], n[i:j])) for k, i, j in _dealt(key, shards)])

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in _shards(frames):
            parts = []
            for v, times, w, at, n in (_unpack(r.data) for r in rows):
                parts.append((np.repeat(np.cumsum(v), times), np.cumsum(w)[at], n))
            v, w, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(_keys(v, w))
            v, w, n = v[order], w[order], n[order]
            first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
            n = np.add.reduceat(n, first)
            yield pd.DataFrame({"shard": [shard], "times": [np.bincount(np.minimum(n, 5), minlength=6)[1:5]], "data": [packed(v[first], w[first], n)]})

    return _by_shard(trusted.select(text_of().alias("text")).mapInPandas(count, PACKED)).mapInPandas(total, "shard int, times array<long>, data binary")


def _word_numbers(pairs: DataFrame, discounts: np.ndarray, shards: int) -> DataFrame:
    """(kind, shard, source, data, stats): kind 2, a shard's words with their numbers; kind 1, for each
    shard of bigrams the numbers of those of its words that shard ``source`` has, in order.

    Each shard of bigrams sends what it knows of its words to the words' shards, which sum it up and answer.
    """
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, data in zip(frame["shard"].tolist(), frame["data"].tolist()):
                v, times, w, at, n = _unpack(data)
                first, v, w = np.cumsum(times) - times, np.cumsum(v), np.cumsum(w)
                total, k = np.add.reduceat(n, first), np.bincount(at, minlength=len(w))
                levels = [np.add.reduceat(((n == x) if x < 3 else (n >= 3)).astype(np.int64), first) for x in (1, 2, 3)]
                of_v, of_w = ({s: slice(i, j) for s, i, j in _dealt(x, shards)} for x in (v, w))
                none = slice(0, 0)
                rows = []
                for s in sorted(of_v.keys() | of_w.keys()):
                    a, b = of_v.get(s, none), of_w.get(s, none)
                    rows.append((0, s, shard, _pack(_steps(v[a]), total[a], *[x[a] for x in levels], _steps(w[b]), k[b])))
                yield _packed(rows)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in _shards(frames):
            asked = [(r.source, _unpack(r.data)) for r in rows]
            v, w = [np.cumsum(x[0]) for _, x in asked], [np.cumsum(x[5]) for _, x in asked]
            word = np.unique(np.concatenate([*v, *w]))
            total, n1, n2, n3, k = (np.zeros(len(word), dtype=np.int64) for _ in range(5))
            for (_, x), contexts, following in zip(asked, v, w):
                at = np.searchsorted(word, contexts)  # words differ within a request
                for sums, own in zip((total, n1, n2, n3), x[1:5]):
                    sums[at] += own
                k[np.searchsorted(word, following)] += x[6]
            taken = n1 * discounts[1] + n2 * discounts[2] + n3 * discounts[3]
            out = [(1, source, shard, _pack(taken[np.searchsorted(word, a)], k[np.searchsorted(word, b)]), None) for (source, _), a, b in zip(asked, v, w)]
            stats = [*np.bincount(np.minimum(k, 5), minlength=6)[1:6].tolist(), int(k.sum()), int(k[word == END].sum())]
            out.append((2, shard, 0, _pack(_steps(word), total, taken, k), stats))
            for i in range(0, len(out), 64):
                yield pd.DataFrame(out[i : i + 64], columns=["kind", "shard", "source", "data", "stats"])

    return _by_shard(pairs.select("shard", "data").mapInPandas(ask, PACKED)).mapInPandas(answer, f"{PACKED}, stats array<long>")


def _columns(df: DataFrame, key: str, *more: str) -> tuple[np.ndarray, ...]:
    """A bounded table's columns in the order of ``key``."""
    table = df.select(key, *more).toArrow()
    order = np.argsort(table[key].to_numpy())
    return tuple(table[c].to_numpy()[order] for c in (key, *more))


def _scored(docs: DataFrame, model: Model, sent, part: int) -> DataFrame:
    """(d, fp, n, total): each row's log probability, as far as the shards of one round give it.

    ``docs`` has d, fp and text. The first round adds what needs no shard. Tasks send the keys of a run of
    texts, with the texts that have each, to the keys' shards, whose answers are sums by text.
    """
    shards, rounds, weights, width = model.shards, ROUNDS, model.weights(), shuffle_width(docs.sparkSession)
    base, end, unknown = model.base, model.end, float(np.log(model.kinds))
    lo, hi = part * shards // rounds, (part + 1) * shards // rounds
    edges = _first_key(shards)
    least, beyond = edges[lo] if lo < shards else None, edges[hi] if hi < shards else None

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, held, held_weights = sent.value
        number = TaskContext.get().partitionId() << 32
        for frame in gathered(frames, "text", RUN_BYTES):
            texts, n_words, totals, asked, own = 0, [], [], [], []
            for part_of in chunks(iter([frame]), "text"):
                of, words, nxt, n = _ids(part_of["text"].tolist(), vocabulary)
                if part == 0:
                    hit, at = _find(held, words.view(np.int64))
                    total = base * (n + 1) + end + np.bincount(of[hit], weights=held_weights[at], minlength=len(n))
                    if vocabulary is not None:
                        total -= unknown * np.bincount(of[words == UNKNOWN], minlength=len(n))
                    n_words.append(n)
                    totals.append(total)
                for key in (words, _keys(words, nxt)):
                    mine = np.ones(len(key), dtype=bool) if least is None else key >= least
                    if beyond is not None:
                        mine &= key < beyond
                    if key is words:
                        mine[mine] = ~_find(held, words[mine].view(np.int64))[0]
                    asked.append(key[mine])
                    own.append((of[mine] + texts).astype(np.uint32))
                texts += len(n)
            if part == 0:
                row = (np.concatenate(n_words), np.concatenate(totals))
            else:
                row = (np.zeros(texts, dtype=np.int64), np.zeros(texts))
            rows = [(4, lo + number % (hi - lo), number, _pack(frame["d"].to_numpy(np.int64), frame["fp"].to_numpy(np.int64), *row))]
            key, own = np.concatenate(asked), np.concatenate(own)
            order = np.argsort(key)
            key, own = key[order], own[order]
            for k, i, j in _dealt(key, shards):
                first = _runs(key[i:j])
                rows.append((3, k, number, _pack(_steps(key[i:j][first]), np.diff(np.append(first, j - i)).astype(np.uint32), own[i:j])))
                if len(rows) == 16:
                    yield _packed(rows)
                    rows = []
            yield _packed(rows)
            number += 1

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _shards(frames):
            pairs, numbers, found = None, [], []
            table = None
            for r in rows:
                if r.kind == 0:
                    pairs = r.data
                elif r.kind == 1:
                    numbers.append(_unpack(r.data))
                elif r.kind == 2:
                    word, _, weight = weights.of_words(r.data)
                    found.append((word, weight))
                elif r.kind == 4:
                    yield pd.DataFrame({"run": [r.source], "kind": [0], "data": [r.data]})
                else:
                    if table is None:
                        if pairs is not None:
                            found.append(weights.of_pairs(pairs, *(np.concatenate(x) for x in zip(*numbers))))
                        key, weight = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0))
                        order = np.argsort(key)
                        table, pairs, numbers, found = (key[order], weight[order]), None, [], []
                        del key, weight, order
                    steps, times, own = _unpack(r.data)
                    hit, at = _find(table[0], np.cumsum(steps))
                    each = np.zeros(len(hit))
                    each[hit] = table[1][at]
                    total = np.bincount(own, weights=np.repeat(each, times))
                    some = np.flatnonzero(total)
                    if len(some):
                        yield pd.DataFrame({"run": [r.source], "kind": [1], "data": [_pack(some.astype(np.uint32), total[some])]})

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in f.itertuples(index=False))
        for _, own in groupby(rows, key=lambda r: r.run):
            d, fp, n, total = _unpack(next(own).data)
            for some, more in (_unpack(r.data) for r in own):
                total[some] += more
            yield pd.DataFrame({"d": d, "fp": fp, "n": n, "total": total})

    mine = f"shard >= {lo} and shard < {hi}"
    known = model.pairs.where(mine).select(F.lit(0).alias("kind"), "shard", F.lit(0).cast("long").alias("source"), "data")
    known = known.unionByName(model.words.where(mine).drop("stats"))
    asked = docs.select("d", "fp", "text").mapInPandas(ask, PACKED)
    answers = _by_shard(known.unionByName(asked)).mapInPandas(answer, "run long, kind int, data binary")
    return answers.repartition(width, "run").sortWithinPartitions("run", "kind").mapInPandas(summed, "d long, fp long, n long, total double")


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_words and perplexity of each row (null without words or without a model)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.vocabulary, *model.held))  # HELD weights at most
    # Ids never go through Python; (d, fp) tells rows apart, with null as the least d.
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text_of().alias("text"))
    keyed = keyed.withColumns({"d": F.coalesce("doc_id", F.lit(-(1 << 63))), "fp": F.xxhash64("text")})
    old: list[str] = []
    parts = [materialize(_scored(keyed, model, sent, k), old).withColumn("rows", F.lit(int(k == 0))) for k in range(ROUNDS)]
    # Equal rows have equal sums, which are added up here.
    scored = union_all(parts).groupBy("d", "fp").agg(F.max("n").alias("n_words"), (F.sum("total") / F.sum("rows")).alias("log_p"))
    out = keyed.select("doc_id", "lang", "d", "fp").join(scored.hint("shuffle_hash"), ["d", "fp"])
    known = F.lit(not model.empty) & (F.col("n_words") > 0)
    out = materialize(out.select("doc_id", "lang", "n_words", F.when(known, F.exp(-F.col("log_p") / (F.col("n_words") + 1))).alias("perplexity")))
    sent.destroy()
    for path in old:
        drop(spark, path)
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per document: doc_id, lang, n_words, perplexity, threshold and keep.

    Trusted documents are those that ``labels`` gives quality 1. Seven in eight of them, chosen
    by a hash of doc_id, are counted; the eighth sets each language's threshold: the quantile of
    its perplexities, or that of all languages where a language (null: und) has none. keep tells
    perplexity <= threshold.

    A document without words has no perplexity and is not kept; without trusted text nothing
    has a perplexity or threshold and nothing is dropped for it: keep is then whether there are
    words. Repeated rows get a row each; a null doc_id is scored and never trusted; an empty
    table gives no rows; other columns do not matter.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    trusted_ids = materialize(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct())
    counted = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) > 0
    model = Model(docs, IdFilter(trusted_ids.where(counted), "doc_id").semi(docs))
    scored = perplexities(docs, model)
    model.free()
    calm = scored.join(trusted_ids.where(~counted), "doc_id", "left_semi").where("perplexity is not null")
    limits = calm.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 100_000).alias("own"))
    whole = calm.agg(F.percentile_approx("perplexity", quantile, 100_000).alias("all"))
    # One row for each language; the general quantile is one row.
    general = F.lit(whole.first()["all"]).cast("double")
    out = scored.join(materialize(limits), "lang", "left").withColumn("threshold", F.coalesce("own", general))
    keep = (F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", keep.alias("keep"))
