"""Operator 4: language identification.

Multinomial naive Bayes over hashed character n-grams (1 to 3). Model: a matrix of
log-probabilities, buckets x languages, broadcast; texts are scored in batches in numpy.

A language is told from a bounded sample; what belongs to none is told from all labelled documents:
under each language's model, the median score of its own documents, and that of the documents of
the nearest other language. A document is rejected if it lies REACH of the way to the latter, or
further; a short one, whose score varies more, by sqrt(1 + SHORT / n-grams) as far.

Defined results
* null or empty text, or text without a letter: pred_lang 'und', score null, rejected;
* text of any length is read whole; repeated rows are scored alike, each on its own;
* ties between languages: the one whose code sorts first;
* rows that repeat a doc_id: at most one of them is trained on, that with the least text, under the least of their labels;
* null lang: never used for training, scored as any other row;
* no labelled row at all (also an empty table): nothing can be told, so pred_lang is null and nothing is rejected;
* extra columns of any name stay out of the way: only doc_id, text and lang are read by fit() and identify();
  annotate() appends its columns under the names given in `out`, replacing none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columns, kernel

BUCKETS = 1 << 16
#: The fit reads at most so many labelled rows of each language.
TRAIN_ROWS = 600
REACH = 0.9
SHORT = 50
#: Labels nearer than this are names of one language.
APART = 1.0
#: Where there is no second language, its distance in log-probability per n-gram.
ALONE = 3.0
SMOOTHING = 0.5


def ngrams(codes: np.ndarray, table: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions of letters, buckets of the windows that begin at most two places before and end at each)."""
    x = np.where(table[codes], codes, 0)
    at = np.flatnonzero(x)
    a, b, c = x[at - 1], x[at], x[np.minimum(at + 1, len(x) - 1)]
    shift = np.uint32(32 - buckets.bit_length() + 1)

    def bucket(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
        return h >> shift

    one = b * np.uint32(0x9E3779B1) + np.uint32(1)
    two = a * np.uint32(0x85EBCA77) + one * np.uint32(3)
    three = c * np.uint32(0xC2B2AE3D) + two * np.uint32(5)
    return at, [bucket(h) for h in (one, two, three)]


class Model:
    """languages, weights (buckets x languages), and for each language the score of its own documents and its distance from that of the nearest other one."""

    def __init__(self, languages: list[str], weights: np.ndarray, own: np.ndarray | None = None, distance: np.ndarray | None = None):
        self.languages, self.weights = languages, weights
        self.own = np.zeros(len(languages)) if own is None else own
        self.distance = np.full(len(languages), np.inf) if distance is None else distance

    def floor(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The score under which a document of language best and n n-grams is rejected; not calibrated: -inf."""
        return self.own[best] - REACH * np.sqrt(1 + SHORT / np.maximum(n, 1)) * self.distance[best]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages: summed log-probabilities without the prior, number of n-grams)."""
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        table = kernel.letters(False)
        for codes, bounds, docs in kernel.folded(texts):
            at, grams = ngrams(codes, table, len(self.weights))
            if not len(at):
                continue
            s = self.weights[grams[0]]
            s += self.weights[grams[1]]
            s += self.weights[grams[2]]
            first = np.searchsorted(at, bounds)
            some = np.flatnonzero(np.diff(first))
            np.add.at(sums, docs[some], np.add.reduceat(s, first[some], axis=0, dtype=np.float64))
            np.add.at(n, docs, np.diff(first) * len(grams))
        return sums, n


def train(texts: list[str], langs: list[str], buckets: int = BUCKETS) -> Model | None:
    """Fit on labelled texts, with a uniform prior; None without any."""
    languages = sorted(set(langs))
    if not languages:
        return None
    counts, table = np.full((buckets, len(languages)), SMOOTHING), kernel.letters(False)
    for k, language in enumerate(languages):
        for codes, _, _ in kernel.folded([t for t, x in zip(texts, langs) if x == language]):
            for g in ngrams(codes, table, buckets)[1]:
                counts[:, k] += np.bincount(g, minlength=buckets)
    return Model(languages, (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32))


def calibrated(model: Model, docs: DataFrame) -> Model:
    """model with the medians of all labelled documents (approximate ones, as the rows aren't gathered)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, n = Model(*shared.value).score(kernel.strings(batch.column(1)))
        some = np.flatnonzero(n)
        rows = [pa.array(sums[some, k] / n[some]) for k in range(sums.shape[1])]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *rows], names=["lang", *[f"s{k}" for k in range(len(rows))]])

    places = range(len(model.languages))
    known = docs.where(F.col("lang").isNotNull()).select("lang", "text")
    scores = known.mapInArrow(kernel.mapped(score), ", ".join(["lang string", *[f"s{k} double" for k in places]]))
    found = {r.lang: r for r in scores.groupBy("lang").agg(*[F.percentile_approx(f"s{k}", 0.5).alias(f"s{k}") for k in places]).collect()}
    own, distance = np.zeros(len(places)), np.full(len(places), np.inf)
    for k, language in enumerate(model.languages):
        if language not in found:
            continue
        own[k] = found[language][f"s{k}"]
        others = [own[k] - r[f"s{k}"] for x, r in found.items() if x != language]
        distance[k] = min([x for x in others if x >= APART], default=ALONE)
    return Model(model.languages, model.weights, own, distance)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Train on at most `rows` labelled documents of each language, chosen by a hash of doc_id, and calibrate on all.

    The sample is taken from (doc_id, lang) alone; only then are its texts read, by a join with that bounded list.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counted:
        return None
    # Bounded without a sort: keep a hash range that holds about twice the rows wanted, then the lowest of it.
    share = F.create_map(*[x for r in counted for x in (F.lit(r.lang), F.lit(min(1.0, (2.0 * rows + 50) / r.n)))])
    u = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # Rows that repeat an id share its hash: they are made one before they are sent.
    near = known.withColumn("u", u).where(F.col("u") < share[F.col("lang")]).groupBy("doc_id", "u").agg(F.min("lang").alias("lang")).toPandas()
    ids = near.sort_values(["lang", "u", "doc_id"]).groupby("lang").head(rows)
    if ids.empty:
        return None
    chosen = columns.local(spark, doc_id=pa.array(ids.doc_id, pa.int64()), label=pa.array(ids.lang, pa.string()))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("label", "doc_id").agg(F.min("text").alias("text"))
    got = texts.toPandas().sort_values(["label", "doc_id"])  # at most rows x languages
    model = train([t or "" for t in got.text], got.label.tolist())
    return model and calibrated(model, docs)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, pred_lang, score (mean log-probability per n-gram), margin (to the second language, per n-gram), rejected."""
    return annotate(docs.select("doc_id", "lang", "text"), model).drop("text")


def annotate(docs: DataFrame, model: Model | None, out: tuple[str, ...] = ("pred_lang", "score", "margin", "rejected")) -> DataFrame:
    """docs with the columns of `out` appended."""
    kinds = ("string", "double", "double", "boolean")
    if model is None:
        values = (F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False))
        return docs.select("*", *[v.alias(n) for v, n in zip(values, out)])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.own, model.distance))
    where = docs.columns.index("text")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*shared.value)
        sums, n = m.score(kernel.strings(batch.column(where)))
        best, some = sums.argmax(axis=1), n > 0
        order = np.sort(sums, axis=1)
        per = np.maximum(n, 1)
        top = order[:, -1] / per
        gap = (order[:, -1] - order[:, -2]) / per if len(m.languages) > 1 else np.zeros(len(n))
        names = np.array([*m.languages, "und"], object)[np.where(some, best, len(m.languages))]
        new = [pa.array(names, pa.string()), pa.array(top, pa.float64(), mask=~some), pa.array(gap, pa.float64(), mask=~some), pa.array(~some | (top < m.floor(best, n)))]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f"c{i}" for i in range(batch.num_columns + 4)])

    return columns.appended(docs, score, kinds, out)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null lang is filled with the one found."""
    filled = lambda name, column, new: F.coalesce(column, new[0]) if name == "lang" else column
    return columns.kept(docs, annotate(docs, fit(docs)), lambda new: ~new[3], filled)


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
