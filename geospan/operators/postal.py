"""Postal codes: candidates, pairs with the places around them, confidence and composite addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from . import filters
from .rules import KEY, SPAN, relations

GAP = 20


def candidates(cands: DataFrame) -> DataFrame:
    """Candidates of a postal dictionary that are no years, too short or oddly punctuated."""
    return cands.where(C.is_postal(F.col("feat_code")) & ~filters.bad_postal(F.col("text")))


def pairs(post: DataFrame, admin: DataFrame, gap: int = GAP) -> DataFrame:
    """A code and a place of the same country before or after it, with only words, blanks, stops and commas between: keys of both, slot, boundary, score.

    slot: city, admin or country. Same province 5, same country 2. post and admin have the text after them.
    A code within a longer name ('Customer 12345') is part of that name.
    """
    a = admin.where(F.col("feat_class").isin("A", "P") & ~C.is_postal(F.col("feat_code"))).select("doc_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("place_id").alias("a_id"), F.col("name").alias("a_name"), F.col("cc").alias("cc"), F.col("adm1").alias("a_adm1"), F.col("feat_class").alias("a_class"), F.col("feat_code").alias("a_code"), F.col("after").alias("a_after"))
    names = a.select("doc_id", F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("a_after").alias("after")).distinct()
    inner = relations(post, names).where("relation = 'within'").select(*SPAN).distinct()
    both = post.join(inner, [*SPAN], "left_anti").join(a, ["doc_id", "cc"])
    right, left = F.col("start") - F.col("a_end"), F.col("a_start") - F.col("end")
    between = F.when(right >= 0, F.substring(F.col("a_after"), F.lit(1), right)).otherwise(F.substring(F.col("after"), F.lit(1), left))
    near = both.where((right.between(0, gap) | left.between(0, gap)) & between.rlike(r"^[\w\s,.]*$"))
    slot = F.when(C.is_country(F.col("a_code")), "country").when(F.col("a_class") == "A", "admin").otherwise("city")
    return near.select(*KEY, "text", "cc", "adm1", "a_start", "a_end", "a_id", "a_name", slot.alias("slot"), (F.col("adm1") == F.col("a_adm1")).alias("boundary")).withColumn("score", F.when(F.col("boundary"), 5.0).otherwise(2.0))


def confidence(links: Column, level: Column, score: Column, length: Column) -> Column:
    """5 a link, 2 a slot level, 5, a tenth of the score, 2 a character; 100 at most."""
    return F.least(5 * links + 2 * level + 5 + F.floor(score / 10) + 2 * length, F.lit(100)).cast("int")


def linked(paired: DataFrame) -> DataFrame:
    """One row for each code that has a place: the composite span from the first to the last part, the parts by slot, confidence. Codes without any don't appear."""
    level = F.when(F.col("slot") == "city", 3).when(F.col("slot") == "admin", 2).otherwise(1)
    order = Window.partitionBy(*SPAN, "place_id", "slot").orderBy(F.desc("score"), "a_start", "a_id")
    best = paired.withColumn("level", level).withColumn("r", F.row_number().over(order)).where("r = 1")
    out = best.groupBy(*SPAN, "place_id", "text").agg(
        F.least(F.min("a_start"), F.min("start")).alias("c_start"), F.greatest(F.max("a_end"), F.max("end")).alias("c_end"), F.count(F.lit(1)).alias("links"), F.sum("score").alias("score"), F.max("level").alias("level"),
        *[F.max(F.when(F.col("slot") == s, F.col("a_name"))).alias(s) for s in ("city", "admin", "country")],
    )
    conf = confidence(F.col("links"), F.col("level"), F.col("score"), F.length("text"))
    scored = out.withColumn("confidence", F.least(conf + 10 * F.col("links"), F.lit(100)))
    first = Window.partitionBy(*SPAN).orderBy(F.desc("score"), "place_id")
    return scored.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def related(paired: DataFrame) -> DataFrame:
    """(keys, related): map from slot to the linked place's name."""
    each = paired.groupBy(*KEY, "slot").agg(F.min("a_name").alias("n"))
    return each.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "n")))).alias("related"))


def combined(names: DataFrame, post: DataFrame) -> DataFrame:
    """Both kinds of candidates, one row for each span; a name goes before a code."""
    both = names.withColumn("__o", F.lit(0)).unionByName(post.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*SPAN).orderBy("__o", "place_id")
    return both.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__o", "__r")
