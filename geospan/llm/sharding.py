"""Operator 3: placing documents on shards by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, from two hashes of its
name: offset + j * skip. The shards take turns, each claiming the first slot of its order that
is free, until the table is full; so shares are equal to within one slot, and a change of shards
moves few slots. The table is broadcast, and a document's shard is one look at slot hash(doc_id) mod size.

Defined results
* null doc_id: hashed as the text 'null', so all such rows share a shard; repeated rows share theirs too;
* a tie for a slot can't occur, as shards claim one after another in the order of their names;
* texts aren't read; an empty table gives an empty result; extra columns aren't read by place() and pass through write(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columns

#: Prime, and above 100 times the number of shards, so that shares differ by under a percent.
SIZE = 65537
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}|{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], size: int = SIZE) -> np.ndarray:
    """For each slot, the index of its shard in sorted order. ValueError for no shards, repeated names, a size that isn't prime or below their number."""
    names = sorted(shards)
    if not names or len(set(names)) != len(names) or size < len(names) or not is_prime(size):
        raise ValueError("it needs different shard names and a prime table size that is no smaller than their number")
    offset = [_hash(n, "offset") % size for n in names]
    skip = [_hash(n, "skip") % (size - 1) + 1 if size > 2 else 1 for n in names]
    table, free, at = [-1] * size, size, list(offset)
    while free:
        for i in range(len(names)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip[i]) % size
            table[slot] = i
            at[i] = (slot + skip[i]) % size
            free -= 1
            if not free:
                break
    return np.array(table, np.int32)


def slot_of(doc_id: Column, size: int = SIZE) -> Column:
    h = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
    return F.pmod(h, F.lit(size)).cast("int")


def place(docs: DataFrame, shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """doc_id, slot, shard. The broadcast table has `size` rows, whatever the input."""
    names = sorted(shards)
    rows = [(s, names[i]) for s, i in enumerate(fill(shards, size).tolist())]
    table = docs.sparkSession.createDataFrame(rows, "slot int, shard string")
    return docs.select("doc_id").withColumn("slot", slot_of(F.col("doc_id"), size)).join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def write(docs: DataFrame, path: str, shards: Sequence[str] = SHARDS, size: int = SIZE, files: int = 8) -> None:
    """Write all columns of docs, one folder for each shard and about `files` files in each, after one shuffle.

    The folders are named by a column `shard`, or `_shard`, `__shard` ... where docs has such columns.
    """
    names, new = sorted(shards), "shard"
    while new.lower() in [c.lower() for c in docs.columns]:
        new = "_" + new
    table = docs.sparkSession.createDataFrame([(s, names[i]) for s, i in enumerate(fill(shards, size).tolist())], "slot int, shard string")
    n = len(docs.columns)
    placed = columns.numbered(docs).withColumn("slot", slot_of(F.col(f"c{docs.columns.index('doc_id')}"), size)).join(F.broadcast(table), "slot").drop("slot")
    # A shard's rows go to several tasks, so that none writes a whole shard of a large corpus; rows of one id may go to different ones.
    spread = placed.repartition("shard", F.pmod(F.xxhash64(*[f"c{i}" for i in range(n)]), F.lit(files))) if hashable(docs) else placed.repartition("shard", F.floor(F.rand(3) * files))
    spread.select(*[f"c{i}" for i in range(n)], "shard").toDF(*docs.columns, new).write.partitionBy(new).parquet(path)


def hashable(docs: DataFrame) -> bool:
    """Whether Spark can hash every column; maps it can't."""
    return not any("map<" in kind for _, kind in docs.dtypes)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_sharding": op3_sharding}
#: The table is filled in Python, turn by turn; what each slot got is a list here, as a part of the query's parameters. The placement itself is SQL.
SQL = {
    "op3_sharding": f"""
WITH shards AS (SELECT [{", ".join(str(i) for i in fill(SHARDS).tolist())}] AS slots)
SELECT doc_id, slot, 'shard-' || lpad(slots[slot + 1]::VARCHAR, 4, '0') AS shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {SIZE})::INTEGER AS slot FROM documents), shards
"""
}
