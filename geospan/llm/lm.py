"""Operator 8: scoring documents by the pseudo-likelihood of a masked language model.

A bidirectional window network predicts every token from SIDE tokens on its left and SIDE on its
right: per-place embeddings are summed into a hidden layer, and a three-level softmax (group of
classes, class, token within the class) gives a proper probability. A document's score is the sum of
the log-probabilities of all its tokens, each given both sides.

Tokens are words. The most frequent of the corpus, about the square root of its number of tokens
(FREQUENT at least), have ids of their own; the rest share hashed ids, and each is charged its own
part of the shared id: n(word) / (n(id) + 1). What is left, 1 / (n(id) + 1), is that of a word the
corpus doesn't have. So every word has its own probability, and they sum to one.

The corpus is gathered in passes over all documents. Words are counted, within tasks and then by a
shuffle, which sets the vocabulary and the output biases; texts are then turned into ids once. The
network is trained in ROUNDS rounds, on a share of the documents each, so that every token is a
target once. In a round the documents are spread over shards of about TOKENS_PER_ID tokens for each id of the model; each
shard trains a copy from where the last round ended, and the copies are averaged, a row of weights
by how often each copy trained it, in a tree of bounded fan-in. Rounds, shards and the order in them
come from hashes of the rows, so scores don't hang on tasks or files. What moves in the passes grows
with the input, the model's size with its square root. The counts of the words that share ids are
never held in one place: the words of the documents meet them by a shuffle.

Defined results
* null or empty text, or one without a word: 0 tokens, total 0, mean null;
* texts are read whole; at the ends of a text the window is filled with a padding token;
* repeated rows score alike, each on its own; ties in the vocabulary's order go by the word's hash;
* an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, scratch

FREQUENT = 1792
HASHED = 256
CLASSES = 64
SIDE = 2
HIDDEN = 24
RATE = 0.15
#: Sums of squared gradients that Adagrad begins with.
FIRST = 1.0
BATCH = 4096
WORDS = 1 << 14
#: Targets whose logits are held at once where they are only scored.
AT_ONCE = 1024
#: Stretches of up to so many rows are summed side by side.
FEW = 8
#: Rows of several classes that are multiplied together.
PADDED = 160
FAN_IN = 32
#: Distinct words that a task holds before it passes on what it has counted.
HELD = 400_000
#: Weights that are averaged at once.
PIECE = 1 << 17
ROUNDS = 3
#: Tokens of a shard's part of a round, for each id of the model: so copies of the model stay small beside the texts at any size.
TOKENS_PER_ID = 100
#: The number of ids of the smallest model.
SIZE = FREQUENT + HASHED


def shape(tokens: int) -> tuple[int, int]:
    """(classes, ids in each) of the model of a corpus of so many tokens; the last HASHED ids are the shared ones."""
    n = max(FREQUENT, math.isqrt(tokens)) + HASHED
    classes = max(CLASSES, math.isqrt(n))
    return classes, -(-n // classes)


class Vocabulary:
    """ids by word hash: the frequent ones 0, 1, ... by falling count, others frequent + hash mod HASHED, where frequent is the number of ids that aren't shared."""

    def __init__(self, hashes: np.ndarray, frequent: int):
        order = np.argsort(hashes, kind="stable")
        self.sorted, self.rank, self.frequent = hashes[order], order.astype(np.int32), frequent

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = (self.frequent + (hashes >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int32)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            hit = self.sorted[at] == hashes
            out[hit] = self.rank[at[hit]]
        return out


def edges(classes: int, width: int) -> list[np.ndarray]:
    """Of each level of the softmax, the bounds of the rows among which one is chosen: of the groups of classes, of the classes of a group, of the tokens of a class."""
    n = -(-classes // math.isqrt(classes))
    return [np.array([0, -(-classes // n)]), np.append(np.arange(0, classes, n), classes), np.arange(classes + 1) * width]


LEVELS = ("group", "class", "token")


def start(counts: np.ndarray, classes: int = CLASSES, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights, and biases (the last column) at the log-frequencies of groups, of classes within them, and of tokens within those. counts: of each id; the id after the last is the padding."""
    rng = np.random.default_rng(seed)
    p = (counts + 0.5).astype(np.float64)
    out = {"in": rng.normal(0, 0.1, (len(counts) + 1, 2 * SIDE * HIDDEN)).astype(np.float32), "in_bias": np.zeros(HIDDEN, np.float32)}
    bounds = edges(classes, len(counts) // classes)
    for name, at in zip(reversed(LEVELS), reversed(bounds)):
        sums = np.add.reduceat(p, at[:-1])
        out[name] = np.concatenate([rng.normal(0, 0.1, (len(p), HIDDEN)), np.log(p / np.repeat(sums, np.diff(at)))[:, None]], axis=1).astype(np.float32)
        p = sums
    return out


def padded(ids: np.ndarray, offsets: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with SIDE paddings before and after each document, places of the documents' own tokens)."""
    lengths = np.diff(offsets)
    places = kernel.ranges(offsets[:-1] - offsets[0] + SIDE * (2 * np.arange(len(lengths)) + 1), lengths)
    out = np.full(int(lengths.sum()) + 2 * SIDE * len(lengths), padding, np.int32)
    out[places] = ids[offsets[0] : offsets[-1]]
    return out, places


SHIFTS = (*range(-SIDE, 0), *range(1, SIDE + 1))


def contexts(seq: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    return [seq[places + d] for d in SHIFTS]


def order_of(keys: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 on, by one sort of numbers that have their places in their low bits."""
    bits = len(keys).bit_length()
    both = keys.astype(np.int64) << bits
    both |= np.arange(len(keys))
    both.sort()
    both &= (1 << bits) - 1
    return both


def activated(total: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """The hidden layer from the summed embeddings, with a column of ones for the biases."""
    out = np.ones((len(total), HIDDEN + 1), np.float32)
    np.maximum(total + w["in_bias"], 0, out=out[:, :-1])
    return out


def hidden(w: dict[str, np.ndarray], seq: np.ndarray, places: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The hidden layer of ascending places, put in order: each id of the stretch is looked up once, for all the places that it is around."""
    lo = places[0] - SIDE
    e = w["in"][seq[lo : places[-1] + SIDE + 1]]
    n = len(e) - 2 * SIDE
    total = np.zeros((n, HIDDEN), np.float32)
    for k, d in enumerate(SHIFTS):
        total += e[SIDE + d : SIDE + d + n, k * HIDDEN : (k + 1) * HIDDEN]
    return activated(total[(places - places[0])[order]], w)


def targets(w: dict[str, np.ndarray], target: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(level, row of each target, bounds of the level's choices) of sorted targets."""
    classes = len(w["class"])
    bounds = edges(classes, len(w["token"]) // classes)
    c = target // (len(w["token"]) // classes)
    yield from zip(LEVELS, (c // bounds[1][1], c, target), bounds)


def exponentials(h: np.ndarray, w: np.ndarray, total: np.ndarray) -> np.ndarray:
    """exp of the logits of each row of w, up to a factor for each row of h; total: gets their sums. Matrices, or as many of both."""
    w = w.swapaxes(-1, -2)
    x = np.matmul(h, w)
    np.exp(x, out=x)
    np.matmul(x, np.ones(x.shape[-1], np.float32), out=total)
    if not 1e-30 < np.minimum.reduce(total, axis=None) <= np.maximum.reduce(total, axis=None) < 1e30:
        x = np.matmul(h, w)
        x -= x.max(axis=-1, keepdims=True)
        np.exp(x, out=x)
        x.sum(axis=-1, out=total)
    return x


def log_probabilities(w: dict[str, np.ndarray], hs: np.ndarray, target: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each target; hs: the hidden layer in the order of the targets."""
    total, own = np.empty(len(hs), np.float32), np.empty(len(hs), np.float32)
    log_p, i = np.zeros(len(hs), np.float32), np.arange(AT_ONCE)
    for name, row, bounds in targets(w, target[order]):
        cuts = np.searchsorted(row, bounds)
        for k in np.flatnonzero(np.diff(cuts)):
            rows = w[name][bounds[k] : bounds[k + 1]]
            for lo in range(cuts[k], cuts[k + 1], AT_ONCE):
                part = slice(lo, min(lo + AT_ONCE, cuts[k + 1]))
                x = exponentials(hs[part], rows, total[part])
                own[part] = x[i[: len(x)], row[part] - bounds[k]]
        log_p += np.log(np.maximum(own / total, 1e-30))
    out = np.empty_like(log_p)
    out[order] = log_p
    return out


@np.errstate(over="ignore")
def forward(w: dict[str, np.ndarray], around: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities, hidden layer)."""
    h = activated(sum(w["in"][ids, k * HIDDEN : (k + 1) * HIDDEN] for k, ids in enumerate(around)), w)
    order = order_of(target)
    return log_probabilities(w, h[order], target, order), h


def adagrad(w: np.ndarray, g: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """In place, on the grad too."""
    x = grad * grad
    g += x
    np.sqrt(g, out=x)
    grad /= x
    grad *= rate
    w -= grad


def sums(rows: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the rows in order, the sum of each stretch that begins at at. (reduceat would go column by column.)"""
    n = np.diff(at, append=len(order))
    out = rows[order[at]]
    for k in range(1, FEW):
        some = np.flatnonzero((n > k) & (n <= FEW))
        out[some] += rows[order[at[some] + k]]
    for j in np.flatnonzero(n > FEW):
        rows[order[at[j] : at[j] + n[j]]].sum(axis=0, out=out[j])
    return out


def runs(cuts: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of choices that have targets (those from cuts[k] to cuts[k + 1]). Neighbours of one width with few targets go together, padded to the most that one of them has, at most PADDED rows in all."""
    n, width, at = np.diff(cuts).tolist(), np.diff(bounds).tolist(), 0
    while at < len(n):
        lo, most = at, n[at]
        at += 1
        while at < len(n) and width[at] == width[lo] and max(most, n[at]) * (at + 1 - lo) <= PADDED:
            most = max(most, n[at])
            at += 1
        if most:
            yield lo, at


def step(w: dict[str, np.ndarray], g: dict[str, np.ndarray], seq: np.ndarray, places: np.ndarray, rate: float = RATE) -> None:
    """One Adagrad step on the targets at ascending places, in place. Gradients are summed, so that a rare token's step doesn't depend on the batch's size."""
    order = order_of(seq[places])
    target = seq[places][order]
    hs = hidden(w, seq, places, order)
    back, dh = np.empty_like(hs), np.zeros_like(hs)
    for name, row, bounds in targets(w, target):
        cuts = np.searchsorted(row, bounds)
        for lo, hi in runs(cuts, bounds):
            part, rows, width = slice(cuts[lo], cuts[hi]), slice(bounds[lo], bounds[hi]), bounds[lo + 1] - bounds[lo]
            n, r = hi - lo, row[part] - bounds[lo]
            m = int(np.diff(cuts[lo : hi + 1]).max())
            if n > 1:
                which = r // width
                slot = np.arange(m * n)[: len(r)] + (which * m - (cuts[lo:hi] - cuts[lo])[which])
                h = np.zeros((n * m, HIDDEN + 1), np.float32)
                h[slot] = hs[part]
                place = slot * width + (r - which * width)
            else:
                slot, h = slice(None), hs[part]
                place = np.arange(0, m * width, width) + r
            h = h.reshape(n, m, -1)
            v, s = w[name][rows].reshape(n, width, -1), np.empty((n, m), np.float32)
            x = exponentials(h, v, s)
            x.reshape(-1)[place] -= s.reshape(-1)[slot]
            s = s[:, :, None]
            back[part] = (np.matmul(x, v) / s).reshape(n * m, -1)[slot]
            adagrad(v, g[name][rows].reshape(v.shape), np.matmul(x.transpose(0, 2, 1), h / s), rate)
        dh += back
    dh = dh[:, :-1] * (hs[:, :-1] > 0)
    adagrad(w["in_bias"], g["in_bias"], dh.sum(axis=0), rate)
    # Beside each id of the stretch, the gradients of the places that it is around.
    lo = places[0] - SIDE
    around = seq[lo : places[-1] + SIDE + 1]
    wide = np.zeros((len(around) + 2 * SIDE, HIDDEN), np.float32)
    wide[places[order] - lo + SIDE] = dh
    beside = np.concatenate([wide[SIDE - d : SIDE - d + len(around)] for d in SHIFTS], axis=1)
    order = order_of(around)
    ids = around[order]
    at = np.flatnonzero(np.diff(ids, prepend=-1))
    u = ids[at]
    some, acc = w["in"][u], g["in"][u]
    adagrad(some, acc, sums(beside, order, at), rate)
    w["in"][u], g["in"][u] = some, acc


@np.errstate(over="ignore")
def train(w: dict[str, np.ndarray], batches: Iterator[tuple[np.ndarray, np.ndarray]], batch_targets: int = BATCH, touched: Touched | None = None) -> int:
    """Train w in place on (ids, offsets) batches, every token a target; the number of targets."""
    g = {k: np.full_like(v, FIRST) for k, v in w.items()}
    seen = 0
    for ids, offsets in batches:
        for lo, hi in kernel.blocks(offsets, WORDS):
            part = offsets[lo : hi + 1]
            seq, places = padded(ids, part, len(w["in"]) - 1)
            for at in range(0, len(places), batch_targets):
                step(w, g, seq, places[at : at + batch_targets])
            seen += len(places)
            if touched is not None:
                touched.add(contexts(seq, places), seq[places])
    return seen


@np.errstate(over="ignore")
def score(w: dict[str, np.ndarray], ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Summed log-probability of each document."""
    out = np.zeros(len(offsets) - 1)
    for lo, hi in kernel.blocks(offsets, WORDS):
        part = offsets[lo : hi + 1]
        seq, places = padded(ids, part, len(w["in"]) - 1)
        log_p = np.empty(len(places), np.float32)
        for at in range(0, len(places), WORDS):  # a document longer than a block goes through in slices of its places
            some = places[at : at + WORDS]
            order = order_of(target := seq[some])
            log_p[at : at + WORDS] = log_probabilities(w, hidden(w, seq, some, order), target, order)
        total = np.append(0, np.cumsum(log_p, dtype=np.float64))
        out[lo:hi] = np.diff(total[part - part[0]])
    return out


def counted(docs: DataFrame) -> DataFrame:
    """word (64-bit hash), n: over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                new, m = np.unique(kernel.words(kernel.strings(whole.column(0).slice(at, 2000)))[0], return_counts=True)
                both = np.concatenate([words, new])
                words, back = np.unique(both, return_inverse=True)
                n = np.bincount(back, np.concatenate([n, m]), len(words)).astype(np.int64)
                if len(words) > HELD:
                    yield out()
                    words, n = words[:0], n[:0]
        if len(words):
            yield out()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, DataFrame]:
    """(hashes of the frequent words by falling count, counts of all ids, number of classes, counts of all words)."""
    table = scratch.materialise(counted(docs), "word-counts")
    classes, width = shape(table.agg(F.sum("n")).first()[0] or 0)
    frequent = classes * width - HASHED
    top = table.orderBy(F.desc("n"), "word").limit(frequent).collect()
    hashes = np.array([r.word for r in top], np.int64).view(np.uint64)
    counts = np.zeros(classes * width, np.int64)
    counts[: len(top)] = [r.n for r in top]
    bucket = F.pmod(F.shiftrightunsigned("word", 40), F.lit(HASHED))
    for r in table.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():
        counts[frequent + r.b] = r.n
    for h, r in zip(hashes, top):
        counts[frequent + int(h >> np.uint64(40)) % HASHED] -= r.n
    return hashes, counts, classes, table


def kind(size: int) -> np.dtype:
    """That ids of a model of so many are kept in."""
    return np.dtype(np.uint16 if size <= 1 << 16 else np.int32)


def packed(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The ids of each document as bytes, which move without a look at each."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def unpacked(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets)."""
    ids = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return ids, np.append(0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))) // dtype.itemsize


def encoded(docs: DataFrame, words: np.ndarray, frequent: int) -> DataFrame:
    """row (a number of its own), doc_id, ids (of all words, as bytes), rare (hashes of the words that share ids), and for the training round, place: both by hashes of the row."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("place"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, offsets, _ = kernel.words(kernel.strings(batch.column(1)))
        ids = Vocabulary(shared.value, frequent).ids(found)
        rare = ids >= frequent
        own = packed(ids.astype(kind(frequent + HASHED)), offsets)
        others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rare))[offsets], pa.int32()), pa.array(found[rare].view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), own, others], names=["doc_id", "place", "ids", "rare"])

    out = rows.mapInArrow(kernel.mapped(run, 1000), "doc_id long, place long, ids binary, rare array<long>")
    out = out.withColumn("row", F.monotonically_increasing_id())
    return scratch.materialise(out.withColumn("round", F.pmod(F.xxhash64(F.lit("round"), "place"), F.lit(ROUNDS)).cast("int")), "encoded")


def matrices(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights as matrices whose rows are trained together: a context token at one place, the tokens of a class, a class, or all of a layer."""
    return {"in": w["in"].reshape(-1, HIDDEN), "token": w["token"].reshape(len(w["class"]), -1), "class": w["class"]} | {k: w[k].reshape(1, -1) for k in ("in_bias", "group")}


def pieces(w: dict[str, np.ndarray]) -> list[tuple[str, str, int, int]]:
    """(name, matrix, first row, last row + 1), of about PIECE weights each."""
    out = []
    for k, x in matrices(w).items():
        n = max(1, PIECE // x.shape[1])
        out += [(f"{k}:{at}", k, at, min(at + n, len(x))) for at in range(0, len(x), n)]
    return out


class Touched:
    """How often each row of the matrices was trained."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.n = {k: np.zeros(len(x)) for k, x in matrices(w).items()}
        self.size, self.width = len(w["in"]), len(w["token"]) // len(w["class"])
        self.bounds = edges(len(w["class"]), self.width)[1]

    def add(self, around: list[np.ndarray], target: np.ndarray) -> None:
        for k, ids in enumerate(around):
            self.n["in"][k :: 2 * SIDE] += np.bincount(ids, minlength=self.size)
        classes = np.bincount(target // self.width, minlength=len(self.n["token"]))
        self.n["token"] += classes
        self.n["class"] += np.repeat(np.add.reduceat(classes, self.bounds[:-1]), np.diff(self.bounds))  # a class is trained wherever its group is met
        for k in ("in_bias", "group"):
            self.n[k] += len(target)


_PARTS = "shard int, name string, n binary, weights binary"


def merged(table: pa.Table) -> tuple[bytes, bytes]:
    """(n, weights) of a piece: each row the mean of the copies', weighted by how often they trained it, so that a rare token's row isn't diluted by copies that never met it."""
    total = most = None
    for n, x in zip(table.column("n"), table.column("weights")):
        n = np.frombuffer(n.as_buffer(), np.float64)
        x = np.frombuffer(x.as_buffer(), np.float32).reshape(len(n), -1).astype(np.float64)
        total, most = (x * n[:, None], n.copy()) if total is None else (total + x * n[:, None], most + n)
    return most.tobytes(), (total / np.maximum(most, 1)[:, None]).astype(np.float32).tobytes()


def averaged(copies: DataFrame, shards: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(n, weights) by piece, over all shards, in a tree of bounded fan-in."""

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        n, weights = merged(table.sort_by("shard"))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "name": [key[1].as_py()], "n": pa.array([n], pa.binary()), "weights": pa.array([weights], pa.binary())})

    while True:
        copies = copies.groupBy(F.expr(f"cast(shard div {FAN_IN} as int)").alias("up"), "name").applyInArrow(mean, _PARTS)
        shards = -(-shards // FAN_IN)
        if shards <= 1:
            return {r.name: (np.frombuffer(r.n, np.float64), np.frombuffer(r.weights, np.float32)) for r in copies.collect()}  # one row for each piece
        copies = scratch.materialise(copies, "averaged")


def a_round(texts: DataFrame, w0: dict[str, np.ndarray], shards: int) -> dict[str, np.ndarray]:
    """The mean of the weights that each shard gets to from w0 on its own documents (place, ids).

    A shard and the order in it are decided by the rows alone, so neither the number of tasks nor the
    layout of the files changes what is learnt.
    """
    shared = texts.sparkSession.sparkContext.broadcast(w0)
    names, dtype = pieces(w0), kind(len(w0["token"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = {k: x.copy() for k, x in shared.value.items()}
        touched, shard = Touched(w), None

        def read() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal shard
            for batch in batches:
                if batch.num_rows:
                    shard = batch.column(0)[0].as_py()
                    yield unpacked(batch.column(1), dtype)

        train(w, read(), touched=touched)
        if shard is not None:
            whole = matrices(w)
            for name, k, lo, hi in names:
                n = touched.n[k][lo:hi]
                if n.any():
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([n.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(whole[k][lo:hi]).tobytes()], pa.binary())], names=["shard", "name", "n", "weights"])
        kernel.trimmed()

    spread = texts.select(F.pmod(F.xxhash64(F.lit("shard"), "place"), F.lit(shards)).cast("int").alias("shard"), "ids", "place")
    spread = spread.repartitionById(shards, "shard").sortWithinPartitions("place").select("shard", "ids")
    found = averaged(spread.mapInArrow(run, _PARTS), shards)
    out = {k: x.copy() for k, x in w0.items()}
    whole = matrices(out)  # views of out
    for name, k, lo, hi in names:
        if name in found:
            n, x = found[name]
            some = n > 0
            whole[k][lo:hi][some] = x.reshape(len(n), -1)[some]
    return out


class Model(NamedTuple):
    words: np.ndarray  # frequent ones
    counts: np.ndarray  # of the ids
    weights: dict[str, np.ndarray]
    table: DataFrame  # counts of all words
    texts: DataFrame  # the corpus in ids


def fit(docs: DataFrame) -> Model:
    """From all documents; every token is a target once, in one of ROUNDS rounds."""
    hashes, counts, classes, table = vocabulary(docs)
    w = start(counts, classes)
    texts = encoded(docs, hashes, len(counts) - HASHED)
    shards = -(-int(counts.sum()) // (TOKENS_PER_ID * len(counts) * ROUNDS))
    if shards:
        for k in range(ROUNDS):
            w = a_round(texts.where((F.col("round") == k) & (F.length("ids") > 0)), w, shards)
    return Model(hashes, counts, w, table, texts)


def score_texts(model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum), mean_log_likelihood of the documents that the model was made from."""
    texts = model.texts
    shared = texts.sparkSession.sparkContext.broadcast((model.counts, model.weights))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, w = shared.value
        ids, offsets = unpacked(batch.column(2), kind(len(counts)))
        rare = ids >= len(counts) - HASHED
        at = np.append(0, np.cumsum(rare))[offsets]
        # log(n(word) / (n(id) + 1)): the divisor here, n(word) where the word meets its count.
        part = np.append(0, np.cumsum(np.log(counts[ids[rare]] + 1.0)))
        total = score(w, ids, offsets) - np.diff(part[at])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(total)], names=["row", "doc_id", "n_tokens", "total"])

    parts = texts.select("row", "doc_id", "ids").mapInArrow(kernel.mapped(run, 1000), "row long, doc_id long, n_tokens long, total double")
    # A word counted once, or never, adds log 1.
    known = texts.select("row", F.explode("rare").alias("word")).join(model.table.where("n > 1"), "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    out = parts.join(known, "row", "left").withColumn("log_likelihood", F.col("total") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """score_texts() of any documents, with a model made from others."""
    return score_texts(model._replace(texts=encoded(docs, model.words, len(model.counts) - HASHED)))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(fit(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op8_lm_score": op8_lm_score}
SQL: dict[str, str] = {}
