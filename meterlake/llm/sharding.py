"""Placement of rows on shards through a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size: it starts at an offset and walks with a
skip, both taken from hashes of its name, so the order is a permutation. Shards take turns; whoever has the turn claims the
next slot of its order that is still free. Each shard ends with size/shards slots, give or take one, and when a shard joins
or leaves few slots change hands. A row's slot is its key's hash modulo the size, so placement is one look-up in a table
that has `size` rows whatever the input is: it is safe to broadcast.

Cases: a null key places a row by its text's digest instead (by the empty string's if that is null too), so null keys don't
meet on one shard for that reason; equal keys share a shard; an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Production parameters: 64 shards on a prime-sized table with over 100 slots a shard.
SHARDS = 64
SIZE = 8191


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(names: list[str], size: int = SIZE) -> list[int]:
    """The shard (index into names) of each slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct and at least one")
    if not is_prime(size) or size < len(names):
        raise ValueError("the table's size must be a prime of at least the number of shards")
    at = [_number(f"offset:{x}") % size for x in names]
    skip = [_number(f"skip:{x}") % (size - 1) + 1 if size > 2 else 1 for x in names]
    owner = [-1] * size
    left = size
    while left:
        for shard in range(len(names)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            owner[at[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot(key: Column, size: int = SIZE) -> Column:
    """60 bits of the key's md5, modulo the size: the same number in any SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, names: list[str], size: int = SIZE, key: str = "doc_id", fallback: str | None = "text") -> DataFrame:
    """df with slot and shard (int). Columns of these names in df are replaced."""
    spark = df.sparkSession
    owners = spark.createDataFrame([(i, s) for i, s in enumerate(fill_table(names, size))], "slot int, shard int")
    on = F.col(key).cast("string")
    if fallback and fallback in df.columns:
        on = F.coalesce(on, F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(fallback).cast("string"), F.lit("")))))
    placed = df.drop("slot", "shard").withColumn("slot", slot(F.coalesce(on, F.lit("null:")), size))
    # `size` rows of two ints: bounded by the parameter, not by the data
    return placed.join(F.broadcast(owners), "slot").select(*[F.col(quoted(c)) for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(df: DataFrame, path: str, names: list[str], size: int = SIZE, key: str = "doc_id", files_per_shard: int = 1) -> None:
    """One folder a shard. Rows of a shard are dealt over files_per_shard tasks, so that no task holds a whole large shard."""
    placed = assign_shards(df, names, size, key)
    part = F.pmod(F.col("slot"), F.lit(files_per_shard))
    placed.repartition(len(names) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)
