"""Operator 1: toxicity.

A convolutional text classifier: every word is the sum of hashed embeddings (two hashes of
the word, one of its first characters), filters of widths 1, 2 and 3 run over all words, the
maximum of each filter over the whole text feeds a logistic output. Trained in numpy on a
bounded sample of labelled documents; the threshold of each language is calibrated on all
labelled documents outside it, with weights that give each class its share among all labelled
documents of the language. For that, scores are counted in narrow bins, so no rows are gathered.
The start is random: without training the network tells nothing.

Defined results
* null or empty text, or one without a word: score 0, not toxic;
* texts of any length are read whole; repeated rows score alike, each on its own;
* null lang, or a language with too few labelled documents: the threshold of all languages together;
* labels with a null doc_id or a null toxic are passed over; a document labelled twice is toxic if one label says so;
* so few labels that none of a class is left outside the training sample: calibrated on all of them, those trained on too;
* rows of documents that repeat a doc_id: trained on the least of their texts;
* no labels, or labels of one class only (also empty tables): score null, nothing is toxic;
* a tie with the threshold counts as toxic;
* extra columns of any name stay out of the way: only doc_id, text and lang are read; annotate() appends its columns.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columns, kernel

BUCKETS = 1 << 17
DIM = 20
#: Filters of each width.
FILTERS = {1: 24, 2: 12, 3: 12}
PREFIX = 4
#: The network is trained on at most so many labelled documents of each class.
TRAIN_ROWS = 3000
#: This part of the labelled documents is never trained on.
HELD_OUT = 0.3
#: Bins to a unit of the log-odds of a score.
BINS = 64
EPOCHS = 6
BATCH = 32
#: Part of the filters that a training step leaves out.
DROPPED = 0.5
#: Steps of the embeddings and of all other weights.
TABLE_RATE, RATE = 0.3, 0.02
#: A language with fewer held-out toxic documents than this gets the threshold of all languages.
LEAST_CALIBRATED = 15
WORDS = 1 << 16


def buckets_of(hashes: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """words x 3 rows of the embedding table; row 0 is the padding."""
    n = np.uint64(BUCKETS - 1)
    out = np.empty((len(hashes), 3), np.int32)
    out[:, 0] = hashes % n + np.uint64(1)
    out[:, 1] = (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) % n + np.uint64(1)
    out[:, 2] = kernel.mix(prefixes) % n + np.uint64(1)
    return out


def read(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    hashes, offsets, heads = kernel.words(texts, PREFIX)
    return buckets_of(hashes, heads), offsets


class Network:
    """Parameters: table (buckets x dim), kernels (dim x all filters at all places), bias of filters, output weights and bias."""

    def __init__(self, table: np.ndarray, kernels: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: float):
        self.table, self.kernels, self.bias, self.out, self.out_bias = table, kernels, bias, out, out_bias

    @staticmethod
    def places() -> list[tuple[int, int, int, int]]:
        """(first filter, number of filters, place in the window, first column in kernels)."""
        out, f, c = [], 0, 0
        for width, n in FILTERS.items():
            for j in range(width):
                out.append((f, n, j, c))
                c += n
            f += n
        return out

    def pooled(self, ids: np.ndarray, offsets: np.ndarray, want_places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(documents x filters: maxima over each document, padded words at which they are, padded words). Documents are padded by widths - 1 zeros."""
        pad, n_docs = max(FILTERS) - 1, len(offsets) - 1
        lengths = np.diff(offsets)
        at = offsets[:-1] - offsets[0] + pad * np.arange(n_docs)
        padded = np.zeros((int(lengths.sum()) + pad * n_docs, 3), np.int32)
        padded[kernel.ranges(at, lengths)] = ids
        x = self.table[padded[:, 0]]
        x += self.table[padded[:, 1]]
        x += self.table[padded[:, 2]]
        y = x @ self.kernels
        z = np.zeros((len(x), sum(FILTERS.values())), np.float32)
        for f, n, j, c in self.places():
            z[: len(x) - j, f : f + n] += y[j:, c : c + n]
        # Windows begin at a document's own words: one that begins in the padding would reach into the next document.
        top = np.maximum.reduceat(np.concatenate([z, z[:1]]), np.stack([at, at + lengths], axis=1).ravel(), axis=0)[::2]
        top[lengths == 0] = -np.inf
        if not want_places:
            return top, None, padded
        return top, np.stack([a + z[a : a + max(n, 1)].argmax(axis=0) for a, n in zip(at, lengths)]), padded

    def logits(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for lo, hi in kernel.blocks(offsets, WORDS):
            top, _, _ = self.pooled(ids[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
            out[lo:hi] = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        ids, offsets = read(texts)
        p = 1 / (1 + np.exp(-np.clip(self.logits(ids, offsets), -40, 40)))
        return np.where(np.diff(offsets) > 0, p, 0.0)


class Batch(NamedTuple):
    """Documents of one step: rows of the table of their words, offsets, labels, weights of the loss (they sum to one), and which filters aren't dropped."""

    ids: np.ndarray
    offsets: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    keep: np.ndarray


class Gradient(NamedTuple):
    loss: float
    rows: np.ndarray  # of the table, each once, without the padding
    table: np.ndarray
    kernels: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def gradient(net: Network, batch: Batch) -> Gradient:
    """The weighted cross-entropy of a batch and its derivatives: each filter passes its own to the words at which it has its maximum."""
    top, at, padded = net.pooled(batch.ids, batch.offsets, True)
    open_ = top + net.bias > 0
    h = np.where(open_, top + net.bias, 0).astype(np.float32) * batch.keep
    logit = np.clip(h @ net.out + net.out_bias, -30, 30)
    p = 1 / (1 + np.exp(-logit))
    loss = -float((batch.weight * np.where(batch.label > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum())
    d = ((p - batch.label) * batch.weight).astype(np.float32)
    dh = np.where(open_, d[:, None] * net.out * batch.keep, 0).astype(np.float32)
    kernels, rows, grads = np.zeros_like(net.kernels), [], []
    for f, n, j, c in net.places():
        place = at[:, f : f + n] + j
        inside = place < len(padded)
        where = padded[np.minimum(place, len(padded) - 1)]
        on = inside * dh[:, f : f + n]
        kernels[:, c : c + n] = np.einsum("bn,bnd->dn", on, net.table[where].sum(axis=2))
        some = on != 0
        rows.append(where[some])
        grads.append((on[:, :, None] * net.kernels[:, c : c + n].T)[some])
    row, grad = np.concatenate(rows), np.concatenate(grads)
    index, value = row.ravel(), np.repeat(grad, 3, axis=0)
    order = np.argsort(index, kind="stable")
    first = np.flatnonzero(np.diff(index[order], prepend=-1))
    found = index[order][first]
    table = np.add.reduceat(value[order], first, axis=0) if len(first) else np.zeros((0, net.table.shape[1]), np.float32)
    real = found > 0
    return Gradient(loss, found[real], table[real], kernels, dh.sum(axis=0), h.T @ d, float(d.sum()))


def start(seed: int = 7) -> Network:
    """Random weights that know nothing of any word."""
    rng = np.random.default_rng(seed)
    filters = sum(FILTERS.values())
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    table[0] = 0
    kernels = np.concatenate([rng.normal(0, (3 * DIM * w) ** -0.5, (DIM, w * n)) for w, n in FILTERS.items()], axis=1).astype(np.float32)
    out = (rng.random(filters) * 0.3 * np.where(np.arange(filters) % 2, 1, -1)).astype(np.float32)
    return Network(table, kernels, np.zeros(filters, np.float32), out, 0.0)


def train(texts: list[str], toxic: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adagrad from a random start, with dropout over filters; both classes weigh the same in the loss, whatever their numbers."""
    rng = np.random.default_rng(seed)
    ids, offsets = read(texts)
    y = np.asarray(toxic, np.float32)
    net = start(seed)
    weight = np.where(y > 0, (len(y) - y.sum()) / max(y.sum(), 1), 1.0)
    seen = {"table": np.full(BUCKETS, 1e-4, np.float32), "kernels": np.full_like(net.kernels, 1e-4), "bias": np.full_like(net.bias, 1e-4), "out": np.full_like(net.out, 1e-4)}
    seen_bias = 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            lengths = offsets[some + 1] - offsets[some]
            keep = (rng.random((len(some), len(net.out))) >= DROPPED) / np.float32(1 - DROPPED)
            g = gradient(net, Batch(ids[kernel.ranges(offsets[some], lengths)], np.append(0, np.cumsum(lengths)), y[some], weight[some] / len(some), keep.astype(np.float32)))
            seen["table"][g.rows] += (g.table**2).sum(axis=1)
            net.table[g.rows] -= TABLE_RATE * g.table / np.sqrt(seen["table"][g.rows])[:, None]
            for name in ("kernels", "bias", "out"):
                grad = getattr(g, name)
                seen[name] += grad**2
                value = getattr(net, name)
                value -= RATE * grad / np.sqrt(seen[name])
            seen_bias += g.out_bias**2
            net.out_bias -= RATE * g.out_bias / seen_bias**0.5
    return net


def best_cut(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The threshold of the highest F1 between bins of scores from low to high with so many documents; between the scores on both sides of it, and the highest of equally good ones."""
    order = np.argsort(-low, kind="stable")
    low, high, toxic, clean = low[order], high[order], toxic[order], clean[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(toxic + clean) + toxic.sum())
    k = int(np.argmax(f1))
    return float((low[k] + high[k + 1]) / 2) if k + 1 < len(low) else float(low[k] / 2)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """best_cut() of single documents; a tie can't be cut."""
    s, back = np.unique(p, return_inverse=True)
    toxic = np.bincount(back, y, len(s))
    return best_cut(s, s, toxic, np.bincount(back, minlength=len(s)) - toxic)


class Model:
    def __init__(self, net: Network, thresholds: dict[str, float], default: float):
        self.net, self.thresholds, self.default = net, thresholds, default

    def threshold(self, langs: list[str | None]) -> np.ndarray:
        return np.array([self.thresholds.get(x, self.default) for x in langs])


def thresholds(seen: list[tuple[str | None, int, bool, float, float, int]]) -> tuple[dict[str, float], float]:
    """(threshold of each language, that of all together), from rows (lang, label, whether trained on, lowest and highest score, number), one for each bin."""
    outside = [r for r in seen if not r[2]]
    if len({r[1] for r in outside}) < 2:  # hardly any labels at all
        outside = seen

    def cut(every: list, rest: list) -> float:
        weight = [sum(r[5] for r in every if r[1] == k) / max(sum(r[5] for r in rest if r[1] == k), 1) for k in (0, 1)]
        n = np.array([r[5] * weight[r[1]] for r in rest])
        y = np.array([r[1] for r in rest])
        low, high, bins = np.array([r[3] for r in rest]), np.array([r[4] for r in rest]), _bins(np.array([r[3] for r in rest]))
        u, back = np.unique(bins, return_inverse=True)
        lows, highs = np.full(len(u), np.inf), np.full(len(u), -np.inf)
        np.minimum.at(lows, back, low)
        np.maximum.at(highs, back, high)
        return best_cut(lows, highs, np.bincount(back, n * y, len(u)), np.bincount(back, n * (1 - y), len(u)))

    found = {}
    for x in sorted({r[0] for r in outside} - {None, ""}):
        mine = [r for r in outside if r[0] == x]
        if all(sum(r[5] for r in mine if r[1] == k) >= LEAST_CALIBRATED for k in (0, 1)):
            found[x] = cut([r for r in seen if r[0] == x], mine)
    return found, cut(seen, outside)


def _bins(p: np.ndarray) -> np.ndarray:
    return np.floor(BINS * np.log((p + 1e-12) / (1 - p + 1e-12))).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Trained on at most `rows` documents of each class, the first by a hash of doc_id among those not held out; calibrated on all others.

    The sample is chosen from labels alone, so texts of others aren't moved; for the calibration only scores are.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    counted = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counted) < 2:
        return None

    def u(name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.lit(1 << 30)) / float(1 << 30)

    share = F.when(F.col("label") > 0, min(1.0, (2.0 * rows + 50) / counted[1])).otherwise(min(1.0, (2.0 * rows + 50) / counted[0]))
    near = known.withColumn("u", u("toxicity")).where((F.col("u") < share) & (u("held out") >= HELD_OUT)).toPandas()  # about 1.4 x rows of each class
    ids = near.sort_values(["u", "doc_id"]).groupby("label").head(rows)
    if ids.label.nunique() < 2:  # too few to hold any out
        near = known.withColumn("u", u("toxicity")).where(F.col("u") < share).toPandas()
        ids = near.sort_values(["u", "doc_id"]).groupby("label").head(rows)
    chosen = columns.local(spark, doc_id=pa.array(ids.doc_id, pa.int64()), label=pa.array(ids.label, pa.int32()))
    # Rows that repeat an id are cut to one before they are sent, so at most 2 x rows texts come.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = texts.toPandas().sort_values("doc_id")
    if got.label.nunique() < 2:
        return None
    net = train([t or "" for t in got.text], got.label.to_numpy())
    marked = known.join(F.broadcast(chosen.select("doc_id", F.lit(True).alias("trained"))), "doc_id", "left")
    scored = annotate(docs.select("doc_id", "lang", "text"), Model(net, {}, np.inf), ("score", "toxic")).select("doc_id", "lang", "score")
    p = F.col("score")
    bins = F.floor(F.lit(BINS) * F.log((p + 1e-12) / (1 - p + 1e-12)))
    parts = scored.join(marked, "doc_id").groupBy("lang", "label", F.coalesce("trained", F.lit(False)).alias("trained"), bins.alias("bin"))
    seen = parts.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("n")).drop("bin").collect()
    return Model(net, *thresholds([tuple(r) for r in seen]))


def annotate(docs: DataFrame, model: Model | None, out: tuple[str, str] = ("score", "toxic")) -> DataFrame:
    """docs with a score in [0, 1] and the decision appended."""
    if model is None:
        return docs.select("*", F.lit(None).cast("double").alias(out[0]), F.lit(False).alias(out[1]))
    n = model.net
    shared = docs.sparkSession.sparkContext.broadcast((n.table, n.kernels, n.bias, n.out, n.out_bias, model.thresholds, model.default))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        *parts, thresholds, default = shared.value
        m = Model(Network(*parts), thresholds, default)
        p = m.net.score(kernel.strings(batch.column(text)))
        bad = (p >= m.threshold(batch.column(lang).to_pylist())) & (p > 0)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(bad)], names=[f"c{i}" for i in range(batch.num_columns + 2)])

    return columns.appended(docs, score, ("double", "boolean"), out)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, score, toxic."""
    return annotate(docs.select("doc_id", "lang", "text"), model).drop("text")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic. Trained on the labelled ones among those given."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return columns.kept(docs, annotate(docs, model), lambda new: ~new[1])


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
