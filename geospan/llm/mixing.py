"""Operator 7: mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: its target weight x the budget / its size, sizes in
characters over all documents. A hash of (seed, doc_id) gives a uniform number, the inverse of
the Poisson distribution of the source's rate turns it into a count, and the document is
exploded into so many copies. A hash of (seed, doc_id, copy) then orders all copies globally:
partition i holds the i-th range of that hash, sorted within, so no sampling pass is needed.

Defined results
* null source: a source of its own; null or empty text: size 0, replicated at its source's rate;
* a source of size 0, or of target weight 0, has rate 0: none of its documents stay;
* texts are moved whole; rows that repeat a doc_id draw the same count and are ordered among themselves by text;
* null doc_id: hashed as the text 'null';
* an empty table gives an empty result; extra columns pass through, whatever their names (the operator's own are added last).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

SEED = 17
#: Without explicit targets, a source's weight is its share of all characters to this power, so that large sources are damped.
ALPHA = 0.7
#: Characters out per character in.
EPOCHS = 1.0
BITS = 52
#: Sources of up to this number (some MB of rates) are broadcast; more are joined by a shuffle, in so many parts each.
BROADCAST = 5000
SALT = 64


def uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of an MD5, which other SQL engines can reproduce."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << BITS)


def rates(docs: DataFrame, targets: Mapping[str | None, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS) -> DataFrame:
    """source, chars, rate: the mean number of copies of a document. targets: weights by source; one that isn't named has 0."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    if targets is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for k, v in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    weighed = sizes.select("source", "chars", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0)).alias("weight"))
    total = weighed.agg(F.sum("weight").alias("weights"), F.sum("chars").alias("all_chars"))  # one row
    rate = F.when((F.col("chars") > 0) & (F.col("weights") > 0), F.col("weight") / F.col("weights") * F.lit(float(epochs)) * F.col("all_chars") / F.col("chars")).otherwise(F.lit(0.0))
    return weighed.crossJoin(F.broadcast(total)).select("source", "chars", rate.alias("rate"))


def cumulative(rate: DataFrame) -> DataFrame:
    """(r_source, r_cdf): the distribution function of Poisson(rate) at 0, 1, ..., as far as it differs from 1 in a double; sources of rate 0 aren't there.

    From (source, rate), a row for each; running sums of the logarithms of the ratios, then of the probabilities.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    each = rate.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upward = Window.partitionBy("source").orderBy("k")
    ratio = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))
    summed = each.withColumn("l", F.sum(ratio).over(upward)).withColumn("c", F.sum(F.exp("l")).over(upward))
    return summed.groupBy(F.col("source").alias("r_source")).agg(F.sort_array(F.collect_list("c")).alias("r_cdf"))


def replicate(docs: DataFrame, rate: DataFrame, seed: int = SEED, parts: int | None = None) -> DataFrame:
    """docs with copy (1, 2, ...) and shuffle_key appended, in the order of shuffle_key.

    rate: (source, rate), a row for each source. It is counted first: up to BROADCAST sources are sent
    to all tasks, so that the documents move once, in the last shuffle; beyond, they are joined by a
    shuffle, with each source's row repeated SALT times, so that a large source spreads.
    """
    spark, names = docs.sparkSession, docs.columns
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    source, doc_id, text = (F.col(f"c{names.index(n)}") for n in ("source", "doc_id", "text"))
    table = scratch.materialise(cumulative(rate), "rates")
    if table.count() <= BROADCAST:
        joined = plain.join(F.broadcast(table), source.eqNullSafe(F.col("r_source")))
    else:
        salted = table.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = plain.join(salted, source.eqNullSafe(F.col("r_source")) & (F.pmod(F.xxhash64(doc_id, text), F.lit(SALT)) == F.col("r_salt"))).drop("r_salt")
    u = uniform(F.lit(seed), doc_id)
    copies = joined.withColumn("u", u).withColumn("n", F.size(F.filter("r_cdf", lambda c: c <= F.col("u")))).where("n > 0")
    each = copies.select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = each.withColumn("shuffle_key", uniform(F.lit(seed), F.lit("copy"), doc_id, F.col("copy")))
    part = F.least(F.floor(F.col("shuffle_key") * parts), F.lit(parts - 1)).cast("int")
    placed = keyed.repartitionById(parts, part).sortWithinPartitions("shuffle_key", doc_id, "copy", text)
    return placed.toDF(*names, "copy", "shuffle_key")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replicate(docs, rates(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, in shuffled order: a document appears as often as its count says."""
    names = docs.columns
    mixed = replicate(docs, rates(docs))
    return mixed.toDF(*[f"c{i}" for i in range(len(names) + 2)]).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


QUERIES = {"op7_source_mixing": op7_source_mixing}
SQL = {
    "op7_source_mixing": f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
weighed AS (SELECT source, chars, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {ALPHA}) ELSE 0 END AS weight FROM sizes),
rated AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / sum(weight) OVER () * {EPOCHS} * sum(chars) OVER () / chars ELSE 0 END AS rate FROM weighed
),
ks AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rated WHERE rate > 0),
cdf AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM ks
),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(1 << BITS)} AS u FROM documents d
),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS n
  FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u
  GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  ('0x' || substr(md5('{SEED}|copy|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy), 1, 13))::BIGINT / {float(1 << BITS)} AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""
}
