"""Where the authors of messages are: country by time zone and language, places named in profiles, a cascade of methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import text as T
from . import filters, lookup, patterns

REFUSED = ("georgia", "jersey")
COUNTRY_CONFIDENCE = 75


def country_scores(profiles: DataFrame, countries: DataFrame) -> DataFrame:
    """(user_id, cc, score): time zone 3, UTC offset 3 (summer time 4), languages 3, 2, 1 for the first, second and any other.

    profiles: user_id, tz, utc_offset (hours), lang. countries: cc, timezones (array of tz, utc, dst), langs. Countries are
    joined by each of the three keys, never all with all.
    """
    zones = countries.select("cc", F.explode("timezones").alias("z")).select("cc", F.lower("z.tz").alias("tz"), "z.utc", "z.dst")
    p = profiles.select("user_id", F.lower("tz").alias("tz"), "utc_offset", C.primary_language(F.col("lang")).alias("lang"))
    by_tz = p.join(zones.select("cc", "tz").distinct(), "tz").select("user_id", "cc", F.lit("tz").alias("why"), F.lit(3).alias("s"))
    offsets = zones.select("cc", F.col("utc").alias("utc_offset"), F.lit(3).alias("s")).unionAll(zones.select("cc", "dst", F.lit(4)).where("dst is not null")).groupBy("cc", "utc_offset").agg(F.max("s").alias("s"))
    by_utc = p.join(offsets, "utc_offset").select("user_id", "cc", F.lit("utc").alias("why"), "s")
    spoken = countries.select("cc", F.posexplode("langs").alias("i", "lang")).select("cc", "lang", F.greatest(3 - F.col("i"), F.lit(1)).alias("s"))
    by_lang = p.join(spoken, "lang").select("user_id", "cc", F.lit("lang").alias("why"), "s")
    once = by_tz.unionAll(by_utc).unionAll(by_lang).groupBy("user_id", "cc", "why").agg(F.max("s").alias("s"))
    return once.groupBy("user_id", "cc").agg(F.sum("s").cast("int").alias("score"))


def best_countries(scores: DataFrame) -> DataFrame:
    """The countries of the highest score of each user; ties all count. confidence is 25 + score."""
    return scores.withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("score")))).where("r = 1").withColumn("confidence", 25 + F.col("score")).drop("r")


def country_by_name(profiles: DataFrame, names: DataFrame) -> DataFrame:
    """(user_id, cc, confidence) where the location is a country's name, also after punctuation is taken out. names: phrase, cc."""
    text = F.lower(F.trim("location"))
    keys = F.array_distinct(F.array(T.norm(text), T.norm(T.remove_punctuation(text))))
    each = profiles.where(~text.isin(*REFUSED)).select("user_id", F.explode(keys).alias("phrase"))
    return each.join(names.select("phrase", "cc").distinct(), "phrase").groupBy("user_id").agg(F.min("cc").alias("cc")).withColumn("confidence", F.lit(COUNTRY_CONFIDENCE))


def coordinates(profiles: DataFrame) -> DataFrame:
    """(user_id, lat, lon): the first coordinate of the location text that lies within no other match; loose patterns."""
    docs = profiles.select(F.col("user_id").alias("doc_id"), F.col("location").alias("text"))
    found = patterns.reduced(patterns.coordinates(docs, source=patterns.LOOSE)).where("not is_submatch and not is_duplicate")
    return found.groupBy("doc_id").agg(F.min_by(F.struct("lat", "lon"), F.struct("start", "priority")).alias("p")).select(F.col("doc_id").alias("user_id"), "p.lat", "p.lon")


def place_scores(profiles: DataFrame, gaz: DataFrame, country: DataFrame) -> DataFrame:
    """Places with the profile's location as name, scored: usable feature 5, longitude within 5 degrees of the UTC offset 3, the same province 15, the same country 5.

    profiles: user_id, location, utc_offset, and if known cc and adm1; country: best_countries().
    """
    named = profiles.where(~filters.profile_rejected(F.col("location"))).withColumn("query", F.trim("location"))
    keep = [c for c in ("cc", "adm1") if c in profiles.columns]
    hits = lookup.by_name(gaz.where(F.col("feat_class").isin("P", "A", "L")), named.select("user_id", "query", "utc_offset", *[F.col(c).alias(f"p_{c}") for c in keep]), 3)
    guess = country.select("user_id", F.col("cc").alias("g_cc")).distinct()
    scored = hits.join(guess.groupBy("user_id").agg(F.collect_set("g_cc").alias("g_ccs")), "user_id", "left")
    score = F.when(F.col("feat_class").isin("P", "A"), 5).otherwise(0) + F.when(F.abs(F.col("lon") - 15 * F.col("utc_offset")) <= 5, 3).otherwise(0) + F.when(F.coalesce(F.array_contains("g_ccs", F.col("cc")), F.lit(False)), 5).otherwise(0)
    if keep == ["cc", "adm1"]:
        score = score + F.when((F.col("cc") == F.col("p_cc")) & (F.col("adm1") == F.col("p_adm1")), 15).otherwise(0)
    return scored.withColumn("score", score).select("user_id", "place_id", "name", "cc", "adm1", "feat_class", "lat", "lon", "id_bias", "score")


def best_places(scored: DataFrame) -> DataFrame:
    """The best place of each user; confidence 75 for the only one, else 50 less a tenth for each, plus the score."""
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("id_bias"), "place_id")
    ranked = scored.withColumn("n", n).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return ranked.withColumn("confidence", F.when(F.col("n") == 1, 75.0).otherwise(50 - 0.1 * F.col("n") + F.col("score")))


def located(profiles: DataFrame, gaz: DataFrame, countries: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each profile: method (country, coordinate, place, timezone, none), cc, adm1, lat, lon, confidence; the first method that tells counts."""
    by_country = country_by_name(profiles, names).select("user_id", F.struct(F.lit("country").alias("method"), "cc", F.expr("cast(null as string)").alias("adm1"), F.expr("cast(null as double)").alias("lat"), F.expr("cast(null as double)").alias("lon"), F.col("confidence").cast("double").alias("confidence")).alias("m1"))
    points = coordinates(profiles)
    prov = lookup.province_at(points.select(F.col("user_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), gaz).withColumnRenamed("point_id", "user_id")
    by_point = points.join(prov, "user_id", "left").select("user_id", F.struct(F.lit("coordinate").alias("method"), "cc", "adm1", "lat", "lon", F.lit(95.0).alias("confidence")).alias("m2"))
    guess = best_countries(country_scores(profiles, countries))
    by_place = best_places(place_scores(profiles, gaz, guess)).select("user_id", F.struct(F.lit("place").alias("method"), "cc", "adm1", "lat", "lon", "confidence").alias("m3"))
    by_zone = guess.groupBy("user_id").agg(F.min("cc").alias("cc"), F.max("confidence").alias("c")).select("user_id", F.struct(F.lit("timezone").alias("method"), "cc", F.expr("cast(null as string)").alias("adm1"), F.expr("cast(null as double)").alias("lat"), F.expr("cast(null as double)").alias("lon"), F.col("c").cast("double").alias("confidence")).alias("m4"))
    out = profiles.select("user_id").distinct()
    for m in (by_country, by_point, by_place, by_zone):
        out = out.join(m, "user_id", "left")
    got = F.coalesce("m1", "m2", "m3", "m4")
    return out.select("user_id", F.coalesce(got["method"], F.lit("none")).alias("method"), *[got[c].alias(c) for c in ("cc", "adm1", "lat", "lon", "confidence")])


def mention_kind(best: DataFrame) -> DataFrame:
    """Places that messages name: geo at confidence 10 and above, else place; lower-case mentions go unless upper abbreviations."""
    return best.where(~filters.social_lower(F.col("text"))).withColumn("kind", F.when(F.col("confidence") >= 10, "geo").otherwise("place"))


def percentages(located_: DataFrame) -> DataFrame:
    """(method, percent) of all profiles."""
    n = located_.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    total = located_.agg(F.count(F.lit(1)).alias("total"))
    return n.crossJoin(F.broadcast(total)).select("method", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))
