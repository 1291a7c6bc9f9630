"""Operator 10: quality rules by robust multivariate outliers.

Every document gets a vector of transformed text statistics. For each language and source the
minimum covariance determinant (MCD) estimates where most of its documents lie, and documents whose
Mahalanobis distance is beyond a quantile of the chi-square are rejected.

The estimate follows FAST-MCD with deterministic starts, over all documents: from each of two starts
(medians with the scales of the median deviations; the same with the correlations of spatial signs)
concentration steps take the documents nearest to the last estimate, COVERAGE of the group, for the
next one, until the determinants stand still or STEPS are done; the start with the least determinant
wins. The nearest ones are told by distances in bins of a fixed width: whole bins, as many as it
takes. Medians are taken from such bins too, so nothing depends on the number of rows.

As in the regularised MCD, a group of n documents gets n / (n + PRIOR) of its own estimate, and for
the rest that of its language, which in the same way leans on all documents. That vanishes as groups
grow and has no size at which it sets in.

All groups are worked on at once: distances and moments are expressions and aggregates in the JVM,
and only a few sums for each group go through Python.

Defined results
* null or empty text, or one without a word: rejected, distance null; such rows don't enter any estimate;
* null lang or source: a value like another; texts are read whole; repeated rows and ties are judged alike;
* a statistic that doesn't vary within a group is given the least scale VANISHED; no other gets any addition;
* an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel, scratch

#: Counts of each text, and the statistics made from them.
COUNTS = ("letters", "upper", "symbols", "spaces", "words", "distinct")
STATISTICS = ("word_length", "upper", "symbols", "spaces", "distinct")
P = len(STATISTICS)
#: A text's averages are taken with so many words, or characters, of its language's average besides: few words would look odd by chance.
DRAWN_WORDS, DRAWN_CHARS = 50, 250
#: Share of a group that the determinant is minimised over.
COVERAGE = 0.75
STEPS = 10
TOLERANCE = 1e-2
#: Bins of distances to a unit of their logarithm.
BINS = 64
#: Documents of the language that count beside a group's own.
PRIOR = 50.0
#: Least standard deviation of a statistic that doesn't vary.
VANISHED = 1e-3
#: Chance that a document of a normal distribution is rejected. Texts have heavier tails.
TAIL = 1e-10


def counts(texts: list[str]) -> np.ndarray:
    """documents x COUNTS."""
    n = len(texts)
    table, sums = kernel.letters(), np.zeros((6, n), np.int64)
    for codes, bounds, docs in kernel.folded(texts, lower=False):
        member = table[codes]
        small = codes < 0x250
        c = np.where(small, codes, 0)
        for k, x in enumerate((member, _UPPER[c] & small, ~member & ~(_SPACE[c] & small) & (codes > 0), _SPACE[c] & small)):
            sums[k] += np.bincount(docs, np.diff(np.append(0, np.cumsum(x))[bounds]), n).astype(np.int64)
    hashes, offsets, _ = kernel.words(texts)
    sums[4] = np.diff(offsets)
    of = np.repeat(np.arange(n), sums[4])
    for lo, hi in kernel.blocks(offsets, 1 << 18):
        part = slice(offsets[lo], offsets[hi])
        order = np.lexsort((hashes[part], of[part]))
        h, d = hashes[part][order], of[part][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        sums[5] += np.bincount(d[new], minlength=n)
    return sums.T


_SPACE = np.array([chr(i).isspace() for i in range(0x250)])
_UPPER = np.array([chr(i).isupper() for i in range(0x250)])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = counts(kernel.strings(batch.column(3)))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(found[:, k]) for k in range(len(COUNTS))]], names=["doc_id", "lang", "source", *COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(kernel.mapped(run), schema)


def with_statistics(rows: DataFrame) -> DataFrame:
    """rows with s0, s1, ...: logarithms of averages, and arcsines of the roots of shares."""
    chars = F.col("letters") + F.col("symbols") + F.col("spaces")
    usual = rows.groupBy(F.col("lang").alias("u_lang")).agg(
        (F.sum("letters") / F.sum("words")).alias("u_length"), (F.sum("upper") / F.sum("letters")).alias("u_upper"),
        (F.sum("symbols") / F.sum(chars)).alias("u_symbols"), (F.sum("spaces") / F.sum(chars)).alias("u_spaces"),
    )

    def share(part: Column, whole: Column, mean: str) -> Column:
        return F.asin(F.sqrt(F.least((part + DRAWN_CHARS * F.col(mean)) / (whole + DRAWN_CHARS), F.lit(1.0))))

    values = (
        F.log((F.col("letters") + DRAWN_WORDS * F.col("u_length")) / (F.col("words") + DRAWN_WORDS)),
        share(F.col("upper"), F.col("letters"), "u_upper"), share(F.col("symbols"), chars, "u_symbols"), share(F.col("spaces"), chars, "u_spaces"),
        F.log((F.col("distinct") + DRAWN_WORDS) / (F.col("words") + DRAWN_WORDS)),
    )
    usual = scratch.materialise(usual, "usual")  # so that its size is known, and the rows aren't shuffled by language to meet it
    return rows.join(usual, F.col("lang").eqNullSafe(F.col("u_lang"))).select(*rows.columns, *[v.alias(f"s{k}") for k, v in enumerate(values)])


# --- numpy: one group at a time; the steps below say the same for all groups at once ------------
def regular(cov: np.ndarray) -> np.ndarray:
    """cov, with the least variance for statistics that have none."""
    return cov + np.diag(np.maximum(VANISHED**2 - np.diag(cov), 0))


def distance2(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d)


def binned(d2: np.ndarray) -> np.ndarray:
    return np.floor(BINS * np.log(d2 + 1e-12)).astype(np.int64)


def nearest(d2: np.ndarray, coverage: float = COVERAGE) -> np.ndarray:
    """Whether each is among the whole bins that hold the nearest, coverage of all."""
    b = binned(d2)
    return b <= np.sort(b)[max(math.ceil(coverage * len(b)), 1) - 1]


def starts(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    middle = np.median(x, axis=0)
    scale = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), VANISHED)
    return [(middle, np.diag(scale**2)), (middle, signed_cov((x - middle) / scale, scale))]


def signed_cov(z: np.ndarray, scale: np.ndarray) -> np.ndarray:
    sign = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return correlated(sign.T @ sign / len(z), scale)


def correlated(signs: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The covariance with these scales and the correlations of spatial signs, half way to none, so that it can be inverted."""
    r = np.sqrt(np.maximum(np.diag(signs), 1e-9))
    corr = 0.5 * signs / np.outer(r, r)
    np.fill_diagonal(corr, 1.0)
    return corr * np.outer(scale, scale)


def ridge(cov: np.ndarray, scale: np.ndarray, n: float) -> np.ndarray:
    """The regularised covariance: a part 2P / (n + 2P) of the start's variances, which vanishes as n grows."""
    rho = 2 * P / (n + 2 * P)
    return regular((1 - rho) * cov + rho * np.diag(scale**2))


def mcd(x: np.ndarray, coverage: float = COVERAGE) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, log of its determinant) of one group."""
    found = []
    scale = np.sqrt(np.diag(starts(x)[0][1]))
    for mean, cov in starts(x):
        last = np.inf
        for _ in range(STEPS):
            some = x[nearest(distance2(x, mean, cov), coverage)]
            mean, cov = some.mean(axis=0), ridge(np.cov(some.T, bias=True), scale, len(x))
            det = np.linalg.slogdet(cov)[1]
            if abs(last - det) < TOLERANCE:
                break
            last = det
        found.append((mean, cov, float(det)))
    return min(found, key=lambda f: f[2])


def chi_square(q: float, p: int = P) -> float:
    """The value that a chi-square variable is below with probability q, by Wilson and Hilferty."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def cutoff(tail: float = TAIL) -> float:
    return P * (1 - 2 / (9 * P) - NormalDist().inv_cdf(tail) * math.sqrt(2 / (9 * P))) ** 3


# --- all groups at once ------------------------------------------------------------------------
_KEY = ["key", "parent", "start"]
_MODEL = "key string, parent string, start int, n double, mean array<double>, scale array<double>, cov array<double>, inverse array<double>, log_det double, moved double"


def _model(rows: list[dict]) -> pa.RecordBatch:
    numbers = pa.list_(pa.float64())
    kinds = {"key": pa.string(), "parent": pa.string(), "start": pa.int32(), "n": pa.float64(), "mean": numbers, "scale": numbers, "cov": numbers, "inverse": numbers, "log_det": pa.float64(), "moved": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def _row(r: dict, mean: np.ndarray, scale: np.ndarray, cov: np.ndarray) -> dict:
    return {"key": r["key"], "parent": r["parent"], "start": r["start"], "n": float(r["n"]), "mean": mean.tolist(), "scale": scale.tolist(), "cov": cov.ravel().tolist(), "inverse": np.linalg.inv(cov).ravel().tolist(), "log_det": (det := float(np.linalg.slogdet(cov)[1])), "moved": abs(det - r.get("log_det", math.inf))}


def _square(r: dict, name: str) -> np.ndarray:
    out = np.zeros((P, P))
    for i in range(P):
        for j in range(i, P):
            out[i, j] = out[j, i] = r[f"{name}{i}_{j}"]
    return out


_TRIANGLE = [(i, j) for i in range(P) for j in range(i, P)]


def squared() -> Column:
    """The squared Mahalanobis distance of s0, s1, ... to (mean, inverse), as one arithmetic expression."""
    d = [F.col(f"s{i}") - F.col("mean")[i] for i in range(P)]
    total = F.lit(0.0)
    for i, j in _TRIANGLE:
        total = total + F.col("inverse")[i * P + j] * d[i] * d[j] * F.lit(1.0 if i == j else 2.0)
    return total


def bins(d2: Column) -> Column:
    return F.floor(BINS * F.log(F.greatest(d2, F.lit(0.0)) + 1e-12))


def quantile(df: DataFrame, keys: list[str], value: Column, share: float) -> DataFrame:
    """(keys, cut): the first bin of value up to which a share of each key's rows lies."""
    counted = df.groupBy(*keys, value.alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    by = Window.partitionBy(*keys)
    upto = counted.withColumn("upto", F.sum("m").over(by.orderBy("bin"))).withColumn("all", F.sum("m").over(by))
    return upto.where(F.col("upto") >= F.ceil(F.lit(share) * F.col("all"))).groupBy(*keys).agg(F.min("bin").alias("cut"))


def medians(df: DataFrame, values: list[Column], names: list[str], width: float = 1e-3) -> DataFrame:
    """(key, names): the median of each value, to within the width of a bin."""
    long = df.select("key", F.posexplode(F.array(*[F.floor(v / width) for v in values])).alias("at", "bin"))
    cut = quantile(long, ["key", "at"], F.col("bin"), 0.5)
    return cut.groupBy("key").agg(*[F.max(F.when(F.col("at") == i, (F.col("cut") + 0.5) * width)).alias(n) for i, n in enumerate(names)])


def estimated(feeding: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """_MODEL, one row for each key, from (key, parent, s0, s1, ...)."""
    s = [F.col(f"s{k}") for k in range(P)]
    middle = scratch.materialise(medians(feeding, s, [f"m{k}" for k in range(P)], 1e-4), "medians")
    around = feeding.join(middle, "key")
    spread = medians(around, [F.abs(s[k] - F.col(f"m{k}")) for k in range(P)], [f"d{k}" for k in range(P)], 1e-4)
    spread = scratch.materialise(middle.join(spread, "key"), "scales")
    z = [(s[k] - F.col(f"m{k}")) / F.greatest(1.4826 * F.col(f"d{k}"), F.lit(VANISHED)) for k in range(P)]
    norm2 = F.greatest(sum((x * x for x in z), F.lit(0.0)), F.lit(1e-18))
    signs = feeding.join(spread, "key").groupBy("key", "parent").agg(F.count(F.lit(1)).alias("n"), *[F.first(f"{c}{k}").alias(f"{c}{k}") for c in "md" for k in range(P)], *[F.avg(z[i] * z[j] / norm2).alias(f"g{i}_{j}") for i, j in _TRIANGLE])

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in batch.to_pylist():
            mean = np.array([r[f"m{k}"] for k in range(P)])
            scale = np.maximum([1.4826 * r[f"d{k}"] for k in range(P)], VANISHED)
            rows.append(_row(r | {"start": 0}, mean, scale, np.diag(scale**2)))
            rows.append(_row(r | {"start": 1}, mean, scale, correlated(_square(r, "g"), scale)))
        return _model(rows)

    def following(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in batch.to_pylist():
            a = np.array([r[f"a{k}"] for k in range(P)])
            cov = ridge(_square(r, "b") - np.outer(a, a), np.array(r["scale"]), r["n"])
            rows.append(_row(r, np.array(r["mean"]) + a, np.array(r["scale"]), cov))
        return _model(rows)

    now = scratch.materialise(signs.mapInArrow(kernel.mapped(first), _MODEL), "mcd-start")
    values = [f"s{k}" for k in range(P)]
    for _ in range(STEPS):
        placed = feeding.select("key", *values).join(now.select("key", "start", "mean", "inverse"), "key").withColumn("bin", bins(squared())).drop("inverse")
        # Written, so that its size is known: the rows needn't be shuffled by their groups, of which one may hold a third of them.
        cut = scratch.materialise(quantile(placed, ["key", "start"], F.col("bin"), coverage), "cut")
        inside = placed.join(cut, ["key", "start"]).where("bin <= cut")
        # Moments about the former mean: no digits are lost to a large common offset.
        d = [F.col(f"s{i}") - F.col("mean")[i] for i in range(P)]
        sums = inside.groupBy("key", "start").agg(*[F.avg(d[i]).alias(f"a{i}") for i in range(P)], *[F.avg(d[i] * d[j]).alias(f"b{i}_{j}") for i, j in _TRIANGLE])
        stepped = sums.join(now.select(*_KEY, "n", "mean", "scale", "log_det"), ["key", "start"])
        now = scratch.materialise(stepped.mapInArrow(kernel.mapped(following), _MODEL), "mcd-step")
        moved = now.agg(F.max("moved")).first()[0]
        if moved is None or moved < TOLERANCE:
            break
    best = now.groupBy("key").agg(F.min_by(F.struct(*now.columns), F.struct("log_det", "start")).alias("best"))
    return best.select("best.*")


def leaning(model: DataFrame, on: DataFrame | None) -> DataFrame:
    """The model with each key's estimate mixed with that of its parent in `on`, by n and PRIOR; without it, as it is."""
    if on is None:
        return model
    both = model.join(on.select(F.col("key").alias("parent"), F.col("mean").alias("p_mean"), F.col("cov").alias("p_cov")), "parent")

    def mix(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in batch.to_pylist():
            own = r["n"] / (r["n"] + PRIOR)
            mean = own * np.array(r["mean"]) + (1 - own) * np.array(r["p_mean"])
            cov = own * np.array(r["cov"]) + (1 - own) * np.array(r["p_cov"])
            rows.append(_row(r, mean, np.array(r["scale"]), cov.reshape(P, P)))
        return _model(rows)

    return both.mapInArrow(kernel.mapped(mix), _MODEL)


def judged(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, lang, source, n_words, distance2 (scaled to a chi-square), rejected; a row for every row of docs."""
    rows = scratch.materialise(measured(docs), "counts")
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    own, lang, every = name("lang", "source"), name("lang"), F.lit("*")
    able = scratch.materialise(with_statistics(rows.where("words > 0")).select("doc_id", "lang", "source", "words", own.alias("key"), lang.alias("lang_key"), *[f"s{k}" for k in range(P)]), "statistics")
    values = [f"s{k}" for k in range(P)]
    levels = F.array(F.struct(F.col("key"), F.col("lang_key").alias("parent")), F.struct(F.col("lang_key").alias("key"), every.alias("parent")), F.struct(every.alias("key"), F.lit(None).cast("string").alias("parent")))
    feeding = able.select(F.explode(levels).alias("k"), *values).select("k.*", *values)
    model = scratch.materialise(estimated(feeding), "mcd")
    whole = model.where("parent is null")
    by_lang = scratch.materialise(leaning(model.where("parent = '*'"), whole), "mcd-lang")
    leant = scratch.materialise(leaning(model.where("parent <> '*'"), by_lang).unionAll(by_lang), "mcd-leant")
    # The scale is set so that the median distance of a group is that of a chi-square; it leans on the language's in the same way.
    placed = feeding.where("parent is not null").join(leant.select("key", "n", "mean", "inverse"), "key").withColumn("bin", bins(squared()))
    middle = quantile(placed, ["key"], F.col("bin"), 0.5).join(leant.select("key", "parent", "n"), "key").withColumn("middle", F.exp((F.col("cut") + 0.5) / BINS))
    middle = scratch.materialise(middle.select("key", "parent", "n", "middle"), "middles")
    above = middle.select(F.col("key").alias("parent"), F.col("middle").alias("p_middle"))
    scale = middle.where("parent <> '*'").join(above, "parent").select("key", ((F.col("n") * F.col("middle") + PRIOR * F.col("p_middle")) / (F.col("n") + PRIOR)).alias("middle"))
    model = scratch.materialise(leant.join(scale, "key").select("key", "mean", "inverse", "middle"), "mcd-scaled")
    some = able.join(model, "key")
    distance = squared() * chi_square(0.5) / F.greatest(F.col("middle"), F.lit(1e-9))
    out = some.select("doc_id", "lang", "source", F.col("words").alias("n_words"), distance.alias("distance2"), (distance > cutoff(tail)).alias("rejected"))
    none = rows.where("words = 0").select("doc_id", "lang", "source", F.col("words").alias("n_words"), F.lit(None).cast("double").alias("distance2"), F.lit(True).alias("rejected"))
    return out.unionAll(none)


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_quality_outliers": op10_quality_outliers}
SQL: dict[str, str] = {}
