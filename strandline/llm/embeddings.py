"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, exact check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, shuffle_width

#: Hash tables; cross-polytopes joined in a table's hash; buckets of each table that a vector enters.
#: Of pairs with cosine 0.9 in 64 dimensions 65 % share a bucket of one table, 99.8 % of some table.
TABLES, JOINED, PROBES = 6, 2, 3
#: Vectors that a task compares at once; larger buckets are compared block by block, all of them.
BLOCK = 1024
_OUT = "c binary, other binary, links long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; rows have a power of two of components."""
    x, h, n = x.copy(), 1, x.shape[1]
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def codes(x: np.ndarray, seed: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(vector, table, probe) -> bucket: the best corner first, then those that cost least more."""
    width = max(4, 1 << (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed + width).choice([-1.0, 1.0], size=(tables, JOINED, 3, width))
    out = np.empty((len(x), tables, probes), dtype=np.int64)
    near = min(probes, width)
    picks = np.stack(np.meshgrid(*[np.arange(near)] * JOINED, indexing="ij"), -1).reshape(-1, JOINED)
    for t in range(tables):
        cost, code = np.zeros((len(x), len(picks))), np.zeros((len(x), len(picks)), dtype=np.int64)
        for k in range(JOINED):
            y = x
            for s in signs[t, k]:
                y = hadamard(y * s)
            y /= width**1.5
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, top, 1)
            corner, loss = 2 * top + (value > 0), np.abs(value[:, :1]) - np.abs(value)
            cost += loss[:, picks[:, k]]
            code = code * (2 * width) + corner[:, picks[:, k]]
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(code, best, 1)
    return out


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, c, v): a digest and the double components of each vector that can link; both null otherwise."""
    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for x in frame["embedding"].tolist():
                x = np.empty(0) if x is None else np.asarray(x, dtype=np.float64) + 0.0
                good = len(x) and np.isfinite(x).all() and np.isfinite(x @ x) and x @ x > 0
                data = x.tobytes() if good else None
                rows.append((hashlib.blake2b(data, digest_size=16).digest() if good else None, data))
            yield pd.DataFrame({"vec_id": frame["vec_id"], "c": [r[0] for r in rows], "v": [r[1] for r in rows]})

    # Ids pass through Python as text: a null beside them would make them floats.
    rows = vectors.select(F.col("vec_id").cast("long").cast("string"), F.col("embedding").cast("array<double>")).mapInPandas(digest, "vec_id string, c binary, v binary")
    return rows.withColumn("vec_id", F.col("vec_id").cast("long"))


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(group: pd.DataFrame, table: int, bucket: int, cross: bool, cosine: float, seed: int) -> pd.DataFrame | None:
    """Links of one bucket (or of a pair of its blocks) that no earlier table or lower bucket has: per vector their number and a local root."""
    x = np.frombuffer(b"".join(group["v"].tolist())).reshape(len(group), -1)
    norm = np.sqrt((x * x).sum(1))
    near = x @ x.T / (norm[:, None] * norm[None, :]) >= cosine
    side = group["side"].to_numpy()
    a, b = np.nonzero(np.triu(near & (side[:, None] != side[None, :]) if cross else near, 1))
    if not len(a):
        return None
    own = codes(x, seed)
    first = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 50_000):
        ca, cb = own[a[i : i + 50_000]], own[b[i : i + 50_000]]
        same = (ca[:, : table + 1, :, None] == cb[:, : table + 1, None, :]).any(3)
        lowest = np.where(same[:, table], ca[:, table], np.iinfo(np.int64).max).min(1)
        first[i : i + 50_000] = (lowest == bucket) & ~same[:, :table].any((1, 2))
    a, b = a[first], b[first]
    if not len(a):
        return None
    weight = group["n"].to_numpy()
    links = np.bincount(a, weights=weight[b], minlength=len(x)) + np.bincount(b, weights=weight[a], minlength=len(x))
    root = _local_roots(len(x), a, b)
    some = np.flatnonzero(links > 0)
    c = group["c"].to_numpy()
    return pd.DataFrame({"c": c[some], "other": c[root[some]], "links": links[some].astype(np.int64)})


def class_links(classes: DataFrame, cosine: float, seed: int) -> DataFrame:
    """(c, other, links): for classes (c, v, n) partial numbers of linked vectors, and links that hold each component together."""
    spark = classes.sparkSession

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = frame["v"].str.len().to_numpy()
            for d in np.unique(size):
                own = frame[size == d]
                for k in range(0, len(own), 2000):
                    part = own.iloc[k : k + 2000]
                    got = codes(np.frombuffer(b"".join(part["v"].tolist())).reshape(len(part), -1), seed)
                    for t in range(TABLES):
                        for p in range(PROBES):
                            yield part.assign(dim=d // 8, t=t, bucket=got[:, t, p])

    rows = materialize(classes.mapInPandas(place, "c binary, v binary, n long, dim int, t int, bucket long"))
    keys = ["dim", "t", "bucket"]
    sizes = materialize(rows.groupBy(keys).agg(F.count("*").alias("members")).where("members > 1"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks).cast("int")
    # A block meets itself and every other block of its bucket once.
    meets = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = rows.join(sizes, keys).withColumn("own", own).select("c", "v", "n", *keys, "own", meets.alias("with"))
    dealt = dealt.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with"), "side": (F.col("own") > F.col("with")).cast("int")})
    order = [*keys, "i", "j"]
    gathered = dealt.select("c", "v", "n", *order, "side").repartition(4 * shuffle_width(spark), *order).sortWithinPartitions(*order)

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            for group in _closed(held, order):
                yield from _of(group)
            held = held.iloc[_last_edge(held, order) :]
        if held is not None and len(held) > 1:
            yield from _of(held)

    def _of(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        r = group.iloc[0]
        if len(group) > 1 and (found := _linked(group, int(r["t"]), int(r["bucket"]), r["i"] != r["j"], cosine, seed)) is not None:
            yield found

    return gathered.mapInPandas(link, _OUT)


def _edges(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(max(len(frame) - 1, 0), dtype=bool)
    for k in keys:
        x = frame[k].to_numpy()
        new |= x[1:] != x[:-1]
    return np.flatnonzero(new) + 1


def _closed(frame: pd.DataFrame, keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a sorted frame but the last, which may go on."""
    here = 0
    for edge in _edges(frame, keys).tolist():
        if edge - here > 1:
            yield frame.iloc[here:edge]
        here = edge


def _last_edge(frame: pd.DataFrame, keys: list[str]) -> int:
    found = _edges(frame, keys)
    return int(found[-1]) if len(found) else 0


def near_vectors(vectors: DataFrame, cosine: float = 0.9, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept (vec_id = component_id).

    Equal vectors form a class that is hashed once. Classes that share a bucket are compared in
    double precision; a pair is counted in the first table and lowest bucket that it shares, so
    numbers are exact for the pairs found and only sums and links along components are
    shuffled, never all pairs of a group. Buckets of any size are compared whole, in blocks.

    Null and zero vectors and those with a null or non-finite component link with nothing, nor
    do vectors of different lengths. A null vec_id takes part and has its row, but is not
    anybody's component_id; rows that share a vec_id are separate vectors. Empty tables give no
    rows; other columns are not read.
    """
    rows = materialize(vector_classes(vectors))
    classes = materialize(rows.where("c is not null").groupBy("c").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("rep")))
    found = materialize(class_links(classes.select("c", "v", "n"), cosine, seed))
    label = components(found, "c", "other").select(F.col("node").alias("c"), "root")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    placed = classes.drop("v").join(label, "c", "left").join(links, "c", "left").withColumn("root", F.coalesce("root", "c"))
    placed = materialize(placed)
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    by_class = placed.join(least, "root").select("c", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    # Rows that cannot link have no class: they are not shuffled.
    out = rows.where("c is not null").drop("v").join(by_class, "c").select("vec_id", "n_links", F.col("component").alias("component_id"))
    out = out.unionByName(rows.where("c is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
