"""N-gram Jaccard join: rare-first prefix filtering over distinct word shingles, exact links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, BitMap, IdFilter, chunks, components, cut, drop, gathered, materialize, release, text_of
from .textbytes import mix, word_shingles

#: Words of a shingle; two sets link when 100 * intersection >= 80 * union, that is
#: 9 * intersection >= 4 * (sum of sizes).
WIDTH = 5
#: Shingles whose counts set the rare-first order at most. The order decides how many
#: candidates there are, never which links are found.
COMMON = 1 << 19
#: A round of single tries is followed by another while this share of its tries links.
WORTHWHILE = 0.2
_no_id = -(1 << 63)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    for part in cut(texts):
        h, starts = word_shingles(part, WIDTH)
        for i, j in zip(starts.tolist(), starts[1:].tolist()):
            s = np.sort(h[i:j])
            again = s[1:] == s[:-1]
            yield s[np.append(True, ~again)] if again.any() else s


def _key(shingles: np.ndarray) -> bytes | None:
    """A digest that stands for a set; none for the empty set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, fp, text): ids never go through Python; (d, fp) tells rows apart, with null as the least d."""
    keyed = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return keyed.withColumns({"d": F.coalesce("doc_id", F.lit(_no_id)), "fp": F.xxhash64("text")})


def set_classes(keyed: DataFrame) -> DataFrame:
    """(doc_id, d, fp, n, key): each document's number of distinct shingles and a digest of the set."""
    @F.pandas_udf("n long, key binary")
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = [(len(s), _key(s)) for s in _sets(texts.tolist())]
        release()
        return pd.DataFrame(rows, columns=["n", "key"])

    return keyed.withColumn("set", digest("text")).select("doc_id", "d", "fp", "set.n", "set.key")


def common_shingles(docs: DataFrame, old: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles (sorted) and their counts, COMMON at most.

    Every task reports the shingles that recur within a run of its documents; their counts are
    summed over the cluster and a histogram of counts gives the cut that keeps COMMON. ``old``
    gets the table of counts.
    """
    def recurring(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(gathered(frames, "text"), "text", 8 << 20):
            token, n = np.unique(np.concatenate(list(_sets(frame["text"].tolist()))), return_counts=True)
            yield pd.DataFrame({"token": token[n > 2].view(np.int64), "n": n[n > 2]})

    counts = materialize(docs.select("text").mapInPandas(recurring, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), old)
    least, total = 3, 0
    for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # a few hundred steps
        total += r["k"]
        if total > COMMON:
            break
        least = r["n"]
    else:
        least = 0
    found = counts.where(F.col("n") >= least).limit(COMMON).toPandas()
    token, n = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def _bins(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of 2 ** k bins, at least as many as shingles; 255 stands for 255 or more."""
    width = 1 << max(len(shingles) - 1, 0).bit_length()
    at = (shingles & np.uint64(width - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=width), 255).astype(np.uint8)


def _may_link(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sets with these bins can link: bin by bin they have no more in common than the smaller count."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    if max(x.max(), y.max()) >= 255:
        return True  # not counted out
    least = min(len(x), len(y))
    common = np.minimum(x.reshape(-1, least).sum(axis=0), y.reshape(-1, least).sum(axis=0)).sum()
    return bool(9 * common >= 4 * (x.sum() + y.sum()))


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, fp, n, tokens, bins): each set's prefix under the order rarest first, and its bins, packed.

    The prefix has n - ceil(0.8 n) + 1 shingles: two linked sets share one of them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)  # COMMON entries at most

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, count = sent.value
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for frame in chunks(frames, "text"):
            rows = []
            for fp, s in zip(frame["fp"].tolist(), _sets(frame["text"].tolist())):
                n, key = len(s), _key(s)
                if not n:
                    continue
                bins = squeeze(_bins(s).tobytes())
                if len(token):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    weight = np.where(token[at] == s, count[at], 0)
                    if weight.any():
                        s = s[np.argsort(weight, kind="stable")]
                rows.append((key, fp, n, s[: n - (4 * n + 4) // 5 + 1].tobytes(), bins))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "fp", "n", "tokens", "bins"])

    return docs.select("fp", "text").mapInPandas(post, "key binary, fp long, n int, tokens binary, bins binary")


def shared_postings(packed: DataFrame) -> tuple[DataFrame, BitMap]:
    """(token, key, n, pos) for the prefix shingles that (but for chance) two sets have, and the map that picks them."""
    arrays = lambda frame: [np.frombuffer(t, dtype=np.uint64) for t in frame["tokens"].tolist()]
    shared = BitMap.of(packed.select("tokens"), lambda frames: (mix(np.concatenate(arrays(f))) for f in frames if len(f)), 2)
    hits = shared.reader()

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            own = arrays(frame)
            size = np.array([len(t) for t in own])
            token = np.concatenate(own)
            hit = np.flatnonzero(hits(mix(token)))
            of = np.repeat(np.arange(len(own)), size)[hit]
            pos = hit - (np.cumsum(size) - size)[of]
            key, n = frame["key"].to_numpy(), frame["n"].to_numpy()
            yield pd.DataFrame({"token": token[hit].view(np.int64), "key": key[of], "n": n[of], "pos": pos.astype(np.int32)})

    return packed.select("key", "n", "tokens").mapInPandas(post, "token long, key binary, n int, pos int"), shared


def _suffix_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """An upper bound of the intersection, from halving both sorted sets at shared pivots."""
    if not depth or min(len(x), len(y)) < 8:
        return min(len(x), len(y))
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    return _suffix_bound(x[:i], y[:j], depth - 1) + _suffix_bound(x[i:], y[j:], depth - 1)


def verified(pairs: DataFrame, sources: DataFrame, packed: DataFrame, old: list[str]) -> DataFrame:
    """The pairs (a, b) whose sets link, after the filters by bins and suffixes, by exact intersection; a table.

    ``pairs`` is a table of keys. Bins, of a few bits a shingle, tell most pairs that cannot link;
    only texts that one of the others names are shipped, compressed: they
    take about a third of the bytes of their shingles, which are made again beside the other text.
    """
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor()
        for frame in chunks(frames, "text"):
            texts = frame["text"].tolist()
            yield pd.DataFrame({"key": [_key(s) for s in _sets(texts)], "packed": [packer.compress(t) for t in texts]})

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for frame in chunks(frames, "ta", CHUNK_BYTES):
            held = dict(zip(frame["a"].tolist(), frame["ta"].tolist())) | dict(zip(frame["b"].tolist(), frame["tb"].tolist()))
            sets = dict(zip(held, _sets([unpack(t) for t in held.values()])))
            keep = []
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
                x, y = sets[a], sets[b]
                need = 4 * (len(x) + len(y))
                keep.append(9 * _suffix_bound(x, y, 4) >= need and 9 * len(np.intersect1d(x, y, assume_unique=True)) >= need)
            yield frame.loc[keep, ["a", "b"]]

    def sift(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor().decompress
        for frame in frames:
            x, y = ([np.frombuffer(expand(t), dtype=np.uint8) for t in frame[c].tolist()] for c in ("ta", "tb"))
            yield frame.loc[[_may_link(p, q) for p, q in zip(x, y)], ["a", "b"]]

    def beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        of = lambda c: table.select(F.col("key").alias(c), F.col(column).alias(f"t{c}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")

    named = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sketched = materialize(packed.select("key", "fp", "bins").join(named(pairs), "key"), old)
    pairs = materialize(beside(pairs, sketched, "bins").mapInPandas(sift, "a binary, b binary"), old)
    wanted = IdFilter(materialize(sketched.select("key", "fp").join(named(pairs), "key").select("fp").distinct(), old), "fp")
    texts = materialize(wanted.semi(sources.select("fp", "text")).mapInPandas(pack, "key binary, packed binary").dropDuplicates(["key"]), old)
    out = materialize(beside(pairs, texts, "packed").mapInPandas(check, "a binary, b binary"), old)
    wanted.free()
    return out


def _parts(postings: DataFrame, links: DataFrame | None) -> DataFrame:
    """The postings with the component (least key reachable by ``links``) of each set as ``part``."""
    if links is None:
        return postings.withColumn("part", F.col("key"))
    label = components(links, "a", "b").select(F.col("node").alias("key"), "root")
    return postings.join(label, "key", "left").withColumn("part", F.coalesce("root", "key")).drop("root")


def _tries(placed: DataFrame, number: int) -> DataFrame:
    """(a, b): for each set one other of another component, with which it shares the most prefix shingles among pivots.

    Each shingle's pivot is first the set that has the fewest rarer shingles, as an original has
    beside its altered copies, and in later rounds a set chosen by a hash.
    """
    order = F.col("pos") if number == 0 else F.xxhash64("key", F.lit(number))
    lists = placed.groupBy("token").agg(F.min(F.struct(order.alias("o"), "key", "n", "part")).alias("pivot"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    pivots = lists.where("lo <> hi").select("token", F.col("pivot.key").alias("b"), F.col("pivot.n").alias("n_b"), F.col("pivot.part").alias("part_b"))
    met = placed.join(pivots, "token").where("part <> part_b and 5 * least(n, n_b) >= 4 * greatest(n, n_b)")
    times = met.groupBy(F.col("key").alias("a"), "b").agg(F.count("*").alias("k"))
    best = times.groupBy("a").agg(F.max(F.struct("k", "b")).alias("best")).select("a", "best.b")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(placed: DataFrame) -> int:
    """Pairs of postings of one shingle that belong to different components."""
    lists = placed.groupBy("token", "part").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    return int(lists.agg(F.sum((F.col("k") * F.col("k") - F.col("k2")) / 2)).first()[0] or 0)


def _remaining(placed: DataFrame) -> DataFrame:
    """(a, b): all candidate pairs of the prefix join whose sets are in different components.

    The smaller set is looked up by its first n - ceil(8 n / 9) + 1 shingles only, sizes must
    allow a link, and so must what is left behind the shared shingle in both sets.
    """
    mixed = placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
    left = placed.join(mixed, "token", "left_semi")
    x = left.where("pos < n - cast((8 * n + 8) / 9 as int) + 1").select("token", *[F.col(c).alias(f"{c}_x") for c in ("key", "n", "pos", "part")])
    y = left.select("token", *[F.col(c).alias(f"{c}_y") for c in ("key", "n", "pos", "part")])
    rule = "part_x <> part_y and (n_x < n_y or (n_x = n_y and key_x < key_y)) and 5 * n_x >= 4 * n_y and 9 * least(n_x - pos_x, n_y - pos_y) >= 4 * (n_x + n_y)"
    found = x.join(y, "token").where(rule).select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b"))
    return found.distinct()


def set_links(sources: DataFrame, old: list[str]) -> DataFrame:
    """(a, b): linked keys of ``sources`` (fp, text), enough of them to hold every component together."""
    packed = materialize(prefixes(sources, common_shingles(sources, old)), old)
    postings, shared = shared_postings(packed)
    postings = materialize(postings, old)
    shared.free()
    n_postings, links, tried, number = postings.count(), None, None, 0
    placed = materialize(_parts(postings, links), old)
    # Tries go on while the full join would be more than linear work and they link what they try.
    while _apart(placed) > n_postings:
        tries = _tries(placed, number)
        if tried is not None:
            tries = tries.join(tried, ["a", "b"], "left_anti")
        tries = materialize(tries, old)
        found = verified(tries, sources, packed, old)
        n_tries, n_found = tries.count(), found.count()
        tried = tries if tried is None else tried.unionByName(tries)
        links = found if links is None else links.unionByName(found)
        placed = materialize(_parts(postings, links), old)
        number += 1
        if n_found <= WORTHWHILE * n_tries:
            break
    # What the tries have not connected is checked pair by pair.
    rest = _remaining(placed)
    rest = materialize(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"), old)
    found = verified(rest, sources, packed, old)
    return found if links is None else links.unionByName(found)


def document_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, d, fp, n, root): per document its set's size and its component, null for an empty set."""
    spark = docs.sparkSession
    old: list[str] = []
    keyed = _keyed(docs)
    classes = materialize(set_classes(keyed), old)
    # One text stands for each set; rows that share an id and hold different texts are told apart by fp.
    reps = classes.where("key is not null").groupBy("key").agg(F.min(F.struct("d", "fp")).alias("first"))
    copies = materialize(classes.join(reps, "key", "left").where("key is null or struct(d, fp) <> first").select("d", "fp").distinct(), old)
    beside = IdFilter(copies, "d", "fp")
    sources = beside.anti(keyed.select("d", "fp", "text"))
    again = materialize(classes.where("key is not null").groupBy("d", "fp").agg(F.count("*").alias("k")).where("k > 1").select("d", "fp"), old)
    if not again.isEmpty():  # equal rows, as copies without an id
        repeated = IdFilter(again, "d", "fp")
        sources = repeated.anti(sources).unionByName(repeated.semi(sources).dropDuplicates(["d", "fp"]))
    links = set_links(sources.select("fp", "text"), old)
    label = components(links, "a", "b").select(F.col("node").alias("key"), "root")
    out = materialize(classes.join(label, "key", "left").select("doc_id", "d", "fp", "n", F.coalesce("root", "key").alias("root")))
    beside.free()
    for path in old:
        drop(spark, path)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id.

    Documents whose shingle sets are equal form a class, and one text stands for it in everything
    that follows, so a text copied any number of times costs one set. Prefix shingles that two
    classes share give the candidates, which pass the length, positional and suffix filters
    before one exact check of their sets; no pair is checked twice. To avoid all pairs within a
    large group of near copies, sets first try one pivot of the lists that they are in, round by
    round; the full join then takes only pairs that are not connected yet, which loses no component.

    Null or empty texts, and those without words, have no shingles and are linked with
    nothing. Rows that share a doc_id are linked each by its own text, and each gets a row; a
    row with a null doc_id takes part, and its component is null only if no document there has
    an id. Texts of any length are taken whole. An empty table gives no rows; other columns
    are not read.
    """
    found = document_classes(docs)
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return found.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component, the row with the smallest doc_id stays.

    Among rows of one doc_id the text decides; equal rows count once. A null doc_id stays only
    where nothing in its component has an id. Documents without words all stay.
    """
    found = document_classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "d", "fp")
    first = found.where("root is not null").groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    of_first = F.struct(F.col("first.d").alias("d"), F.col("first.fp").alias("fp"))
    grouped = found.join(first, "root").withColumn("stays", F.struct("d", "fp") == of_first)
    go = materialize(grouped.where("not stays").select("d", "fp").distinct())
    again = materialize(grouped.where("stays").groupBy("d", "fp").agg(F.count("*").alias("k")).where("k > 1").select("d", "fp"))
    rows = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_no_id)), "__fp": F.xxhash64(text_of())})
    named = lambda df: df.select(F.col("d").alias("__d"), F.col("fp").alias("__fp"))
    kept = IdFilter(named(go), "__d", "__fp").anti(rows)
    if again.isEmpty():
        return kept.select(*docs.columns)
    repeated = IdFilter(named(again), "__d", "__fp")
    return repeated.anti(kept).unionByName(repeated.semi(kept).dropDuplicates(["__d", "__fp"])).select(*docs.columns)
