"""Operator 2: MinHash near-duplicates by a multi-index Hamming join.

A document's signature is K minima of b bits over the hashes of its runs of three words. The
distance of two signatures is the number of the K places that differ; it estimates
K * (1 - Jaccard). Pairs at distance <= RADIUS are near.

The join is exact. The K places are cut into M chunks of C places; of RADIUS errors some chunk
has at most E = RADIUS // M (pigeonhole). For every chunk, all ways to leave out E of its places
are enumerated, and the kept places, with the chunk and the choice, are a key: two signatures
within the radius share a key for certain. Candidates that share one are compared in full.

Documents of equal signatures are joined first, on the signature. Groups are the connected
components of the near pairs. For them a bucket (the signatures of one key) needs no list of all
its pairs: it is searched breadth first, each signature against those not reached so far, which
finds the bucket's components exactly; hot buckets cost little as most are reached at once.

Defined results
* a null or empty text has no signature and is a group by itself;
* a text without a word has a signature made from a hash of all of it, so that exact copies meet;
* fewer than three words: the run of all its words is the only one;
* texts are read whole; of a group the row with the lowest doc_id stays, of several with that doc_id the one
  with the lowest hash of its text; rows equal in both are marked kept in groups(), and stage() keeps one of them;
* rows that share a doc_id but not their texts are decided on one by one; a group's id and size are those of its rows;
* rows with a null doc_id can't be named: each is a group of its own (group_id null, group_size 1) and stays;
* an empty table gives an empty result; extra columns aren't read, and stage() passes them through.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columns, kernel, scratch

K = 48
BITS = 16
SHINGLE = 3
CHUNKS = 12
RADIUS = 23
WORDS = 1 << 15
SEED = 20

_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 1 << 32, K, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of `size` words, offsets by document); a shorter document has one run of all its words."""
    lengths = np.diff(offsets)
    runs = np.where(lengths == 0, 0, np.maximum(lengths - size + 1, 1))
    x, n = np.zeros(len(hashes), np.uint64), len(hashes)
    for j in range(size):
        x[: n - j] = (x[: n - j] + hashes[j:]) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(29)
    for i in np.flatnonzero((lengths > 0) & (lengths < size)):  # short: fold its words alone
        acc = 0
        for h in hashes[offsets[i] : offsets[i + 1]].tolist():
            acc = ((acc + h) * 0x9FB21C651E98DF25 + 1) & 0xFFFFFFFFFFFFFFFF
        x[offsets[i]] = acc
    return kernel.mix(x[kernel.ranges(offsets[:-1], runs)]), np.append(0, np.cumsum(runs))


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(documents x K minima of BITS bits, whether the document has a text). A text without words has bits of a hash of it instead."""
    hashes, offsets, _ = kernel.words(texts)
    out = np.zeros((len(texts), K), np.uint32)
    some = np.diff(offsets) > 0
    x, at = shingles(hashes, offsets)
    for lo, hi in kernel.blocks(at, WORDS):
        rows = lo + np.flatnonzero(some[lo:hi])
        if not len(rows):
            continue
        part = (x[at[lo] : at[hi]] >> np.uint64(16)).astype(np.uint32)
        starts = at[rows] - at[lo]
        h = np.empty_like(part)
        for k in range(K):
            np.multiply(part, _A[k], out=h)
            h ^= _B[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[rows, k] = np.minimum.reduceat(h, starts)
    for i in np.flatnonzero(~some):
        if texts[i]:
            h = int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "replace"), digest_size=8).digest(), "big")
            out[i] = (kernel.mix(np.uint64(h) + np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
            some[i] = True
    # The low bits of a minimum aren't uniform enough on their own: mix before cutting to b bits.
    out *= np.uint32(0x9E3779B1)
    return (out >> np.uint32(32 - BITS)).astype(np.uint16), some


def choices(size: int, errors: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(size), size - errors))


def keys(sig: np.ndarray, chunks: int = CHUNKS, radius: int = RADIUS) -> np.ndarray:
    """signatures x keys, as 64-bit numbers."""
    size, errors = sig.shape[1] // chunks, radius // chunks
    if sig.shape[1] % chunks or errors >= size:
        raise ValueError("the places must divide into chunks longer than the errors allowed in each")
    out, s = [], sig.astype(np.uint64)
    for m in range(chunks):
        for k, choice in enumerate(choices(size, errors)):
            h = np.full(len(s), m * 1000 + k, np.uint64)
            for j in choice:
                h = (h ^ s[:, m * size + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            out.append(kernel.mix(h))
    return np.stack(out, axis=1).view(np.int64) if out else np.zeros((len(s), 0), np.int64)


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many != one).sum(axis=1)


def stars(sig: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a forest that has the components of the graph of all pairs within the radius."""
    left, right, rest = [], [], np.arange(len(sig))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = distances(sig[i], sig[rest]) <= radius
            hit = rest[near]
            if len(hit):
                rest = rest[~near]
                left.append(np.full(len(hit), i))
                right.append(hit)
                queue.extend(hit.tolist())
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def all_pairs(sig: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    for i in range(len(sig) - 1):
        hit = i + 1 + np.flatnonzero(distances(sig[i], sig[i + 1 :]) <= radius)
        left.append(np.full(len(hit), i))
        right.append(hit)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, sig (K places of two bytes each; null for one without a text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig, some = signatures(kernel.strings(batch.column(1)))
        raw = sig.astype("<u2").tobytes()
        width = 2 * K
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[i * width : i * width + width] if s else None for i, s in enumerate(some)], pa.binary())], names=["doc_id", "sig"])

    return docs.select("doc_id", "text").mapInArrow(kernel.mapped(run), "doc_id long, sig binary")


def _bucketed(sigs: DataFrame, radius: int, every: bool) -> DataFrame:
    """From (id, sig): edges a < b within the radius; every: all such pairs, else enough for the components."""

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = b"".join(batch.column(1).to_pylist())
        ks = keys(np.frombuffer(raw, "<u2").reshape(-1, K), CHUNKS, radius)
        n = ks.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(ks.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), n))], names=["key", "id"])

    sigs = sigs.select("id", "sig")
    exploded = sigs.mapInArrow(kernel.mapped(explode), "key long, id long")
    # Only ids travel with the keys; they meet their signatures once the keys of a single row, nearly all, are gone.
    buckets = exploded.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    # A group of copies fills the same bucket under many keys; each set of ids needs one look.
    buckets = scratch.materialise(buckets.select("ids").distinct().withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    members = buckets.select("bucket", F.explode("ids").alias("id")).join(sigs, "id")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, K)
        a, b = (all_pairs if every else stars)(sig, radius)
        return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})

    return members.groupBy("bucket").applyInArrow(search, "a long, b long").distinct()


def near_pairs(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every pair a < b of documents at signature distance <= radius. The result itself can be quadratic in a group of copies; groups() isn't."""
    sigs = scratch.materialise(signed(docs).where("sig is not null and doc_id is not null").withColumnRenamed("doc_id", "id"), "signatures")
    return _bucketed(sigs, radius, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for every id in edges (a, b), the lowest of its component; by alternating large-star and small-star rounds."""
    edges = scratch.materialise(edges.select("a", "b"), "edges")
    last = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = scratch.materialise(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    rooted = edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
    return rooted.unionAll(rooted.select(F.col("root").alias("id"), "root").distinct())


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, group_id, group_size, kept: groups() by row."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig, some = signatures(kernel.strings(batch.column(1)))
        raw, width = sig.astype("<u2").tobytes(), 2 * K
        sigs = pa.array([raw[i * width : i * width + width] if s else None for i, s in enumerate(some)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sigs], names=["doc_id", "text_hash", "sig"])

    rows = scratch.materialise(hashed.mapInArrow(kernel.mapped(run), "doc_id long, text_hash long, sig binary"), "signatures")
    able = F.col("sig").isNotNull() & F.col("doc_id").isNotNull()
    # A signature's node is a number of its own, as one doc_id may stand for several; it is fixed by being written.
    same = rows.where(able).groupBy("sig").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = scratch.materialise(same.withColumn("id", F.monotonically_increasing_id()), "distinct-signatures")
    roots = components(_bucketed(nodes, radius, False))
    named = nodes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    whole = named.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("size"))
    placed = named.select("sig", "root").join(whole, "root").drop("root")
    found = rows.where(able).join(placed, "sig")
    best = (F.col("doc_id") == F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    out = found.select("doc_id", "text_hash", F.col("best.doc_id").alias("group_id"), F.col("size").alias("group_size"), best.alias("kept"))
    alone = rows.where(~able).select("doc_id", "text_hash", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return out.unionAll(alone)


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, group_id (the lowest doc_id of the group), group_size, kept; a row for every row of docs."""
    return grouped(docs, radius).drop("text_hash")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that with the lowest doc_id. Rows with a null doc_id stay."""
    marks = scratch.materialise(grouped(docs).select("doc_id", "text_hash", "kept"), "marks")
    plain = columns.numbered(docs)
    names = plain.columns
    doc_id, text_hash = F.col(f"c{docs.columns.index('doc_id')}"), F.xxhash64(f"c{docs.columns.index('text')}")
    lost = marks.where("not kept").select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash")).distinct()
    rest = plain.join(lost, (doc_id == F.col("l_id")) & (text_hash == F.col("l_hash")), "left_anti")
    twice = marks.where("kept and doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"))
    if twice.isEmpty():
        return rest.toDF(*docs.columns)
    same = (doc_id == F.col("l_id")) & (text_hash == F.col("l_hash"))
    # Of equal rows any will do; if further columns differ, the one whose JSON sorts first. An aggregate, so a large set of copies is cut within tasks.
    each = rest.join(twice, same).withColumn("whole", F.struct(*names))
    firsts = each.groupBy("l_id", "l_hash").agg(F.min_by("whole", F.to_json("whole")).alias("whole")).select("whole.*")
    return rest.join(twice, same, "left_anti").unionAll(firsts).toDF(*docs.columns)


QUERIES = {"op2_near_dedup": op2_near_dedup}
SQL: dict[str, str] = {}
