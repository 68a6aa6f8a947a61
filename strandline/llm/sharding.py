"""Sharding: a Feistel permutation of global row numbers gives a reproducible shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_global_rank

#: Round constants of the permutation (fixed values).
ROUND_KEYS = (0x3C6EF35F, 0x1B873593, 0x27D4EB2F, 0x165667B1)
MULTIPLIER = 0x2C1B3C6D
#: Walks along a cycle that one expression holds; rows still outside after them go round again.
WALKS = 48


def half_bits(n: int) -> int:
    """Bits of each half of the smallest even-sized domain that holds n rows."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(right, key, seed: int, bits: int):
    """A round's function, for Column and int alike: multiply, add and fold, below 2 ** 58 throughout."""
    shift = F.shiftright if isinstance(right, Column) else lambda v, k: v >> k
    band = (lambda v, m: v.bitwiseAND(F.lit(m))) if isinstance(right, Column) else lambda v, m: v & m
    mixed = band((right + (key + seed) % 1_000_003) * F.lit(MULTIPLIER) if isinstance(right, Column) else (right + (key + seed) % 1_000_003) * MULTIPLIER, (1 << 58) - 1)
    return band(mixed + shift(mixed, 15) + shift(mixed, 29), (1 << bits) - 1)


def permute_once(x, n: int, seed: int):
    """The permutation of the whole power-of-four domain around n; x is a Column or an int."""
    bits = half_bits(n)
    mask = (1 << bits) - 1
    if isinstance(x, Column):
        left, right = F.shiftright(x, bits), x.bitwiseAND(F.lit(mask))
        for key in ROUND_KEYS:
            left, right = right, left.bitwiseXOR(_round(right, key, seed, bits))
        return F.shiftleft(left, bits).bitwiseOR(right)
    left, right = x >> bits, x & mask
    for key in ROUND_KEYS:
        left, right = right, left ^ _round(right, key, seed, bits)
    return left << bits | right


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of row number ``row`` among n, computed without any data."""
    x = permute_once(row, n, seed)
    while x >= n:
        x = permute_once(x, n, seed)
    return x % shards, x // shards


def feistel_shards(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Shuffle all rows of ``df`` into ``shards`` and add ``shard`` int and ``slot`` long.

    Rows are numbered globally in the order of the columns ``order`` (nulls first; rows equal
    there are interchangeable), a four-round Feistel network permutes the numbers, numbers
    outside 0..n-1 walk along their cycle until they fall inside, and the permuted number r
    gives shard r mod shards and slot r div shards. Shard sizes differ by one at most, slots
    have no gaps, and ``locate`` finds a row's place from its number alone. An empty table
    gives an empty result. A column named shard, slot or row_number is replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    numbered = with_global_rank(df.drop("shard", "slot", "row_number"), order, "row_number")
    n = numbered.count()
    if not n:
        return numbered.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    step = lambda x: F.when(x < n, x).otherwise(permute_once(x, n, seed))
    first = permute_once(F.col("row_number"), n, seed)
    walked = F.aggregate(F.array_repeat(F.lit(0), WALKS), first, lambda x, _: step(x))
    placed = numbered.withColumn("__at", walked)
    while placed.where(F.col("__at") >= n).limit(1).count():
        placed = placed.withColumn("__at", F.aggregate(F.array_repeat(F.lit(0), WALKS), F.col("__at"), lambda x, _: step(x)))
    return placed.withColumns({"shard": (F.col("__at") % shards).cast("int"), "slot": F.floor(F.col("__at") / shards).cast("long")}).drop("__at")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """Place documents by ``feistel_shards``; the law is `rows` (counts at most one apart).

    size is the text's UTF-8 bytes plus 1 and text_crc32 its checksum; a null text has no
    bytes. Rows are numbered by doc_id (null first), checksum and size, so repeated rows each
    get a place of their own and other columns do not matter.
    """
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"))
    placed = feistel_shards(sized, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
