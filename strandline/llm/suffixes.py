"""Suffix-array dedup: byte strings that occur earlier are cut, by bucket-pointer refinement.

All windows of LENGTH bytes are sorted into buckets of equal windows, without ever listing them
all. (1) Initial q-gram buckets: every window belongs to the bucket of its least q-gram, its
anchor, so that a run of about 35 neighbouring windows is one row; buckets with one member are
dropped. (2) A bucket is refined by the identifiers of half a window more, before and behind the
anchor; runs that are alone with both are dropped. (3) It is refined by the identifiers of whole
runs: a run equal to an earlier run repeats in all its windows. (4) What is still mixed is refined
window by window, sorting on the bucket identifiers of later offsets (q, then 2q), each pass
reusing the identifiers that the pass before has updated. Identifiers of (2) and (3) are
fingerprints of the bytes (64 and 128 bits), equal wherever the bytes are, so that no pass has
to look up a pointer elsewhere in the cluster; there is no global suffix order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitMap, IdFilter, drop, materialize, release, shuffle_width, text_of
from .textbytes import gram_hashes, joined, prefix_hash, span_hash

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of the initial buckets' q-grams.
GRAM = 32
#: Bytes that numpy code takes at once; longer texts are taken in overlapping parts.
PART = 1 << 18
#: Runs of one anchor that a task sorts together; anchors with more are dealt to several tasks.
TOGETHER = 4096
_place = np.uint64((1 << 22) - 1)
_no_id = -(1 << 63)
#: In place of a span's end: the run stays, or the whole text is a copy.
_STAYS, _COPY = -1, -2


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, fp, text): the id with null as the least, a fingerprint that tells apart rows of one id, and the bytes."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_no_id)).alias("d"), text_of().alias("text")).withColumn("fp", F.xxhash64("text"))


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Runs of texts of about PART bytes: the parts, and for each its row and the offset where it begins there."""
    rows, offsets, parts, total = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PART):
            part = t[at : at + PART + length - 1]
            if total and total + len(part) > PART:
                yield np.array(rows), np.array(offsets), parts
                rows, offsets, parts, total = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            total += len(part)
    if parts:
        yield np.array(rows), np.array(offsets), parts


def anchored_runs(data: np.ndarray, starts: np.ndarray, prefix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run of windows that share an anchor, and the anchor's bucket and place."""
    n, span = len(data), length - GRAM + 1
    gram = gram_hashes(prefix, GRAM)
    least = (gram & ~_place) | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    at = (least & _place).astype(np.int64)  # for windows 0 .. n - length
    inside = np.zeros(n + 1, dtype=np.int32)
    np.add.at(inside, starts[:-1], 1)
    np.add.at(inside, np.maximum(starts[1:] - length + 1, starts[:-1]), -1)
    inside = np.cumsum(inside)[: n - length + 1] > 0
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    last = np.ones(len(at), dtype=bool)
    last[:-1] = new[1:] | ~inside[1:]
    s, e = np.flatnonzero(new & inside), np.flatnonzero(last & inside)
    return s, e, gram[at[s]], at[s]


def _later(prefix: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, length: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """(which runs, bucket identifiers): the anchor's bucket refined by what is half a window on, before it and behind it.

    A window has so much beside its anchor on one side at least, so runs that share none of
    these identifiers share no window.
    """
    half = -(-(length - GRAM) // 2)
    before, behind = at - half >= s, at + GRAM + half <= e + length
    left, right = at[before], at[behind]
    return (before, span_hash(prefix, left - half, left + GRAM)), (behind, ~span_hash(prefix, right, right + GRAM + half))


def shared_buckets(texts: DataFrame, length: int) -> list[BitMap]:
    """Bit maps that hold all anchors, and then all refined identifiers of their runs, that occur at least twice."""
    maps: list[BitMap] = []

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for frame in frames:
            for _, _, parts in _parts(frame["text"].tolist(), length):
                data, starts = joined(parts)
                yield anchored_runs(data, starts, prefix_hash(data), length)[2]
            release()

    maps.append(BitMap.of(texts.select("text"), anchors, 2))
    hits = maps[0].reader()

    def later(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for frame in frames:
            for _, _, parts in _parts(frame["text"].tolist(), length):
                data, starts = joined(parts)
                prefix = prefix_hash(data)
                s, e, anchor, at = anchored_runs(data, starts, prefix, length)
                hit = hits(anchor)
                yield np.concatenate([ids for _, ids in _later(prefix, s[hit], e[hit], at[hit], length)])
            release()

    maps.append(BitMap.of(texts.select("text"), later, 2))
    return maps


def _picker(maps: list[BitMap]):
    return tuple(m.reader() for m in maps)


def _hit_runs(texts: list[bytes], picker, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window, last window, anchor, and two fingerprints of the bytes) of all runs in shared buckets."""
    for row, offset, parts in _parts(texts, length):
        data, starts = joined(parts)
        prefix = prefix_hash(data)
        s, e, anchor, at = anchored_runs(data, starts, prefix, length)
        hit = np.flatnonzero(picker[0](anchor))
        later = np.zeros(len(hit), dtype=bool)
        for which, ids in _later(prefix, s[hit], e[hit], at[hit], length):
            later[which] |= picker[1](ids)
        hit = hit[later]
        s, e, anchor = s[hit], e[hit], anchor[hit]
        if len(s):
            of = np.searchsorted(starts, s, side="right") - 1
            more = offset[of] - starts[of]
            yield row[of], s + more, e + more, anchor, span_hash(prefix, s, e + length), span_hash(prefix_hash(data, True), s, e + length)


def anchor_rows(texts: DataFrame, shared: list[BitMap], length: int) -> DataFrame:
    """(a, b1, b2, d, fp, s, e): the runs in shared buckets; b1 and b2 identify a run's bytes."""
    picker = _picker(shared)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            d, fp = frame["d"].to_numpy(np.int64), frame["fp"].to_numpy(np.int64)
            for row, s, e, a, b1, b2 in _hit_runs(frame["text"].tolist(), picker, length):
                yield pd.DataFrame({"a": a.view(np.int64), "b1": b1.view(np.int64), "b2": b2.view(np.int64), "d": d[row], "fp": fp[row], "s": s, "e": e})
            release()

    return texts.mapInPandas(rows, "a long, b1 long, b2 long, d long, fp long, s long, e long")


def refined(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """New bucket identifiers: equal where both old ones are equal, in their sorted order."""
    order = np.lexsort((later, first))
    new = np.ones(len(order), dtype=np.int64)
    new[1:] = (first[order][1:] != first[order][:-1]) | (later[order][1:] != later[order][:-1])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def window_buckets(prefix: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of the windows that begin at ``at``: equal for equal bytes, -1 in a bucket of one.

    Buckets of q-grams come first; each pass refines a bucket by the identifier some way on.
    """
    q = -(-length // 4)
    offsets = (0, q, length - 2 * q, length - q)
    grams = np.concatenate([span_hash(prefix, at + o, at + o + q) for o in offsets])
    ids = np.unique(grams, return_inverse=True)[1]
    n = len(at)
    halves = refined(np.concatenate([ids[:n], ids[2 * n : 3 * n]]), np.concatenate([ids[n : 2 * n], ids[3 * n :]]))
    head, tail = halves[:n], halves[n:]
    out = np.full(n, -1, dtype=np.int64)
    open_ = np.flatnonzero(np.bincount(head)[head] > 1)  # a bucket of one needs no further pass
    if len(open_):
        whole = refined(head[open_], tail[open_])
        many = np.bincount(whole)[whole] > 1
        out[open_[many]] = whole[many]
    return out


def _late_windows(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Windows of the snippets in ``frame``: spans of repeats of an earlier one there, and open ones of anchors dealt to several tasks."""
    frame = frame.drop_duplicates(["a", "d", "fp", "s"])  # equal rows of the input
    data, starts = joined(frame["snippet"].tolist())
    prefix = prefix_hash(data)
    n = np.diff(starts) - length + 1
    of = np.repeat(np.arange(len(frame)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = starts[:-1][of] + within
    bucket = window_buckets(prefix, at, length)
    d, s, fp, salted = (frame[c].to_numpy()[of] for c in ("d", "s", "fp", "salted"))
    s = s + within
    order = np.lexsort((s, d, bucket))
    b, dd, ss = bucket[order], d[order], s[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = b[1:] != b[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    repeat = np.zeros(len(order), dtype=bool)
    repeat[order] = (b >= 0) & ((dd != dd[first]) | (ss != ss[first]))
    # Neighbouring repeats of one snippet are one span.
    pick = np.flatnonzero(repeat)
    new = np.ones(len(pick), dtype=bool)
    new[1:] = (np.diff(pick) != 1) | (of[pick[1:]] != of[pick[:-1]])
    begin = pick[new]
    end = pick[np.append(np.flatnonzero(new)[1:] - 1, len(pick) - 1)] if len(pick) else pick
    spans = pd.DataFrame({"d": d[begin], "fp": fp[begin], "s": s[begin], "e": s[end] + length, "w1": np.int64(0), "w2": np.int64(0)})
    pick = np.flatnonzero(~repeat & salted)
    w = at[pick]
    open_ = pd.DataFrame({"d": d[pick], "fp": fp[pick], "s": s[pick], "e": np.int64(-1), "w1": span_hash(prefix, w, w + length).view(np.int64), "w2": span_hash(prefix_hash(data, True), w, w + length).view(np.int64)})
    return pd.concat([spans, open_], ignore_index=True)


def _mixed_windows(texts: DataFrame, firsts: DataFrame, length: int, old: list[str]) -> DataFrame:
    """(d, fp, s, e): spans of repeated windows in runs that are the first of their kind but share their anchor with others."""
    many = firsts.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    mixed = firsts.join(many, "a").select("a", "n", "d", "fp", "s", "e")
    lists = materialize(mixed.groupBy("d", "fp").agg(F.collect_list(F.struct("a", "n", "s", "e")).alias("runs")), old)  # as many as a text's length allows
    named = IdFilter(lists, "d", "fp")
    found = named.inner(texts, lists)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(r["a"], r["n"], d, fp, r["s"], text[r["s"] : r["e"] + length]) for d, fp, text, runs in zip(frame["d"].tolist(), frame["fp"].tolist(), frame["text"].tolist(), frame["runs"].tolist()) for r in runs]
            for i in range(0, len(out), 20_000):
                yield pd.DataFrame(out[i : i + 20_000], columns=["a", "n", "d", "fp", "s", "snippet"])

    snippets = found.mapInPandas(cut, "a long, n long, d long, fp long, s long, snippet binary")
    salt = F.pmod(F.xxhash64("d", "s"), F.ceil(F.col("n") / TOGETHER).cast("long"))
    dealt = snippets.select("a", salt.alias("salt"), (F.col("n") > TOGETHER).alias("salted"), "d", "fp", "s", "snippet").repartition(shuffle_width(texts.sparkSession), "a", "salt").sortWithinPartitions("a", "salt")

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            a, salt = held["a"].to_numpy(), held["salt"].to_numpy()
            edges = np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1])) + 1  # a group goes on in the next frame at most
            done, here = 0, 0
            for edge in edges.tolist():
                if edge - here >= 1000:
                    yield _late_windows(held.iloc[here:edge], length)
                    here = edge
                done = edge
            if done > here:
                yield _late_windows(held.iloc[here:done], length)
            held = held.iloc[done:]
        if held is not None and len(held):
            yield _late_windows(held, length)

    seen = materialize(dealt.mapInPandas(windows, "d long, fp long, s long, e long, w1 long, w2 long"), old)
    named.free()
    open_ = seen.where("e < 0")
    least = open_.groupBy("w1", "w2").agg(F.min(F.struct("d", "s")).alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    late = open_.join(least, ["w1", "w2"]).where("least < struct(d, s)")
    return seen.where("e >= 0").select("d", "fp", "s", "e").unionByName(late.select("d", "fp", "s", (F.col("s") + length).alias("e")))


def _merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of the union of [s, e)."""
    if not len(s):
        return []
    order = np.lexsort((e, s))
    s, top = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > top[:-1]]))
    return list(zip(s[new].tolist(), top[np.append(new[1:] - 1, len(s) - 1)].tolist()))


def _spans(texts: list[bytes], marks: list, picker, length: int) -> list[list[tuple[int, int]]]:
    """The maximal spans to remove of each text, from its marks (flat starts and ends; see ``_marked``)."""
    got: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    own = [np.array([] if m is None else m, dtype=np.int64).reshape(-1, 2) for m in marks]
    whole = [bool(len(m)) and bool((m[:, 1] == _COPY).any()) for m in own]
    for row, s, e, _, _, _ in _hit_runs([b"" if w else t for t, w in zip(texts, whole)], picker, length):
        cuts = np.flatnonzero(np.diff(row)) + 1
        for i, s_i, e_i in zip(row[np.append(0, cuts)].tolist(), np.split(s, cuts), np.split(e, cuts)):
            stays = np.isin(s_i, own[i][own[i][:, 1] == _STAYS, 0])
            got[i].append((s_i[~stays], e_i[~stays] + length))
    out = []
    for text, m, w, found in zip(texts, own, whole, got):
        late = m[m[:, 1] >= 0]
        found.append((late[:, 0], late[:, 1]))
        out.append([(0, len(text))] if w else _merged(*(np.concatenate(x) for x in zip(*found))))
    return out


def _marked(docs: DataFrame, length: int, old: list[str]) -> tuple[DataFrame, list[BitMap]]:
    """``docs`` with __text and __marks: what tells repeated runs from those that stay, and the maps that pick runs.

    Marks are pairs (start, end) in a row: _STAYS for a run that is the first of its kind, the
    end of a span of other repeated windows, or _COPY for a text that is an earlier one's copy.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    keyed = _keyed(docs)
    # A text that an earlier document holds whole repeats in all its windows: it is cut, and asked nothing else.
    whole = materialize(keyed.select("d", "fp", F.unhex(F.sha2("text", 256)).alias("h")).where(F.length("text") >= length), old)
    least = whole.groupBy("h").agg(F.min("d").alias("least"), F.count("*").alias("k")).where("k > 1")
    copies = materialize(whole.join(least, "h").where("d > least").select("d", "fp").distinct(), old)
    beside = IdFilter(copies, "d", "fp")
    texts = beside.anti(keyed)
    shared = shared_buckets(texts, length)
    firsts = anchor_rows(texts, shared, length).groupBy("a", "b1", "b2").agg(F.min(F.struct("d", "s", "fp", "e")).alias("first")).select("a", "first.*")
    firsts = materialize(firsts, old)
    late = materialize(_mixed_windows(texts, firsts, length, old), old)
    beside.free()
    all_ = firsts.select("d", "fp", "s", F.lit(_STAYS).cast("long").alias("e")).unionByName(late)
    all_ = all_.unionByName(copies.select("d", "fp", F.lit(0).cast("long").alias("s"), F.lit(_COPY).cast("long").alias("e")))
    listed = all_.groupBy("d", "fp").agg(F.flatten(F.collect_list(F.array("s", "e"))).alias("marks"))  # as many as a text's length allows
    listed = materialize(listed.select(F.col("d").alias("__d"), F.col("fp").alias("__fp"), F.col("marks").alias("__marks")), old)
    rows = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_no_id)), "__text": text_of()}).withColumn("__fp", F.xxhash64("__text"))
    return IdFilter(listed, "__d", "__fp").left(rows, listed), shared


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def dedup_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that stay.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller doc_id
    or before it in the same document; all is judged on the input. Null texts are empty; a null
    doc_id is the least. Rows with one doc_id are alike in order, so that none is earlier than
    the other at the same start; each gets its own row. Texts of any length are taken whole, in
    overlapping parts. Empty tables give no rows, and other columns are not read.
    """
    old: list[str] = []
    marked, shared = _marked(docs.select("doc_id", "text"), length, old)
    picker = _picker(shared)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def digest(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows, texts = [], texts.tolist()
        for text, spans in zip(texts, _spans(texts, marks.tolist(), picker, length)):
            kept = _kept(text, spans)
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        release()
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = materialize(marked.select(F.col("doc_id").cast("long"), digest("__text", "__marks").alias("r")).select("doc_id", "r.*"))
    _clear(docs, old, shared)
    return out


def _clear(docs: DataFrame, old: list[str], shared: list[BitMap]) -> None:
    for m in shared:
        m.free()
    for path in old:
        drop(docs.sparkSession, path)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated spans cut out of ``text``; those of which nothing is left go.

    A character of which a span cuts a part goes as a whole. A null or empty text stays. Rows
    are told apart as ``dedup_digests`` says; other columns stay.
    """
    old: list[str] = []
    marked, shared = _marked(docs, length, old)
    picker = _picker(shared)

    @F.pandas_udf("string")
    def left(texts: pd.Series, marks: pd.Series) -> pd.Series:
        texts = texts.tolist()
        cut = [_kept(t, spans).decode("utf-8", "ignore") if spans else None for t, spans in zip(texts, _spans(texts, marks.tolist(), picker, length))]
        release()
        return pd.Series(cut, dtype=object)  # null: nothing is cut

    # Not deterministic, by name only: else Spark puts the filter's own call of it beside this one, with a second Python worker a task.
    cut = marked.withColumn("__left", left.asNondeterministic()("__text", "__marks")).where("__left is null or __left <> ''")
    out = materialize(cut.withColumn("text", F.coalesce("__left", "text")).select(*docs.columns))
    _clear(docs, old, shared)
    return out
