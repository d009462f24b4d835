"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
TABLE_SIZE = 65537


def preference(shard: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's own permutation of the table."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of its shard.

    Shards take turns; each claims the first free slot in its preference order, so slot counts differ by one at
    most, and a shard that leaves moves few slots of the others. size must be prime (every step then visits every
    slot). The work is one pass over ``size`` slots and depends on parameters only, never on data.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be non-empty and distinct")
    if size < len(shards) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime of at least the number of shards")
    walk = [preference(s, size) for s in shards]
    at = [first for first, _ in walk]
    owner = [-1] * size
    for turn in range(size):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + walk[k][1]) % size
        owner[at[k]] = k
    return owner


def lookup(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as rows (slot, shard); ``size`` rows, a bound that the caller sets."""
    owners = ",".join(map(str, fill_table(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("__slot", "__owner")).select("__slot", F.col("__owner").cast("int").alias("__shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 32 bits of its md5, modulo the table size."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def assign_shards(docs: DataFrame, shards: list[str] | None = None, size: int = TABLE_SIZE, id_col: str = "doc_id") -> DataFrame:
    """docs with ``slot`` and ``shard`` (int) added, one broadcast look-up a row and no shuffle.

    Equal ids land on one shard. A null id is placed by source, lang and n_chars as far as docs has them, so null
    ids spread out; repeated rows stay together. Input columns named slot or shard are replaced. An empty table
    stays empty. Texts are not read.
    """
    names = shards or [f"shard-{k}" for k in range(SHARDS)]
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "n_chars") if c in docs.columns]
    key = F.coalesce(F.col(id_col).cast("string"), F.concat_ws("\x1f", F.lit("null"), *rest))
    keep = [c for c in docs.columns if c not in ("slot", "shard")]
    placed = docs.withColumn("__slot", slot_of(key, size)).join(F.broadcast(lookup(docs.sparkSession, names, size)), "__slot")
    return placed.select(*keep, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))
