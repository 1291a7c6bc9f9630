"""The geocoder: texts and a gazetteer in, located mentions with confidence out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, lookup, patterns, rules, tagger
from .keep import kept

#: A rule of the caller's own: candidates in, contributions out.
Rule = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Parameters:
    """Of a request."""

    tag_coordinates: bool = True
    lower_case: bool = False
    min_len: int = 2
    postal: bool = False  # numbers and codes are wanted
    preferred_cc: Sequence[str] = ()
    preferred_cells: Sequence[str] = ()
    user_rules: Sequence[Rule] = field(default_factory=tuple)
    match_filter: Column | None = None


@dataclass(frozen=True)
class Context:
    """Small tables that rules look into; None where the caller has none."""

    population: DataFrame | None = None
    stop_terms: DataFrame | None = None
    person_names: DataFrame | None = None
    taxon_spans: DataFrame | None = None


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def mentions(docs: DataFrame, gaz: DataFrame, params: Parameters = Parameters(), ctx: Context = Context()) -> DataFrame:
    """Spans that names of the gazetteer have in the texts, after the span filters."""
    spans = tagger.tag(docs, gaz, overlaps="longest_dominant_right", limit=tagger.TAG_LIMIT)
    t = F.col("text")
    bad = filters.too_short(t) | filters.broken_lines(t) | (F.lit(not params.postal) & filters.nonsense(t)) | filters.non_latin_noise(t) | filters.contraction(t, F.col("before")) | (F.length(t) < params.min_len)
    if not params.lower_case:
        bad = bad | filters.lower_phrase(t)
    if params.match_filter is not None:
        bad = bad | params.match_filter
    spans = spans.where(~bad)
    return spans if ctx.stop_terms is None else filters.without_terms(spans, ctx.stop_terms)


_NAMES = ("name", "name_type", "cc", "adm1", "feat_class", "feat_code", "lat", "lon", "id_bias", "place_id")


def places_of(spans: DataFrame, gaz: DataFrame, alike: bool = False) -> DataFrame:
    """spans (phrase, text) with the places that they may mean; alike: of places that no rule can tell apart only the first, as told_apart(). How many places a phrase has, and how it is spelt, is found out in the gazetteer, which is smaller than the candidates."""
    places = gaz.where(filters.has_point(F.col("lat"), F.col("lon"))).select("phrase", *_NAMES)
    places = filters.with_spellings(filters.crowded(places, by=("phrase",)))
    return filters.spelt(spans.join(told_apart(places) if alike else places, "phrase"))


#: A place, the one after it, and one more, as a place can't stand in a pair with itself.
ALIKE = 3


def told_apart(places: DataFrame) -> DataFrame:
    """places with weight: of those of a phrase that only differ in place_id the first ones, the very first with the weight of those left out.

    All of them have the same score in any text, so that the best place and the second are among the first. A place with several names under one phrase stays as it is.
    """
    several = F.count(F.lit(1)).over(Window.partitionBy("phrase", "place_id")) > 1
    each = places.withColumn("__own", F.when(several, F.col("place_id")))
    key = ("phrase", *[c for c in _NAMES if c != "place_id"], "__own")
    order = Window.partitionBy(*key).orderBy("place_id")
    ranked = each.withColumns({"__r": F.row_number().over(order), "__n": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    weight = F.when(F.col("__r") == 1, F.greatest(F.col("__n") - ALIKE, F.lit(0)) + 1).otherwise(1)
    return ranked.withColumn("weight", weight.cast("long")).where(F.col("__r") <= ALIKE).drop("__r", "__n", "__own")


def same_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, first): for each document the first one with the same text; for an id that has several texts, with the same texts."""
    whole = docs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.coalesce(F.sha2("text", 256), F.lit("")))).alias("texts"))
    return whole.join(whole.groupBy("texts").agg(F.min("doc_id").alias("first")).hint("merge"), "texts").select("doc_id", "first")


def candidates(docs: DataFrame, gaz: DataFrame, params: Parameters = Parameters(), ctx: Context = Context()) -> DataFrame:
    """Spans with the places that they may mean, after the span filters."""
    return places_of(mentions(docs, gaz, params, ctx), gaz)


def geocode(docs: DataFrame, gaz: DataFrame, params: Parameters = Parameters(), ctx: Context = Context(), cut: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(doc_id, start, end, text, place_id, name, cc, adm1, feat_class, feat_code, lat, lon, score, rules, second_id, confidence).

    cut materialises what all rules read: a function (df, name) that gives the table back; keep.kept() where there is none.
    """
    spark = docs.sparkSession
    keep = cut or kept
    # Unless the caller's own rules or spans ask for more than texts and names: equal texts are worked on once, equal places weighed as one.
    plain = not params.user_rules and params.match_filter is None and ctx.taxon_spans is None
    if plain:
        copies = keep(same_texts(docs), "copies")
        docs = docs.join(copies.where(F.col("doc_id") == F.col("first")).select("doc_id").hint("merge"), "doc_id", "left_semi")
    cands = keep(places_of(mentions(docs, gaz, params, ctx), gaz, plain), "candidates")
    gone = rules.bad_country_mention(cands).unionAll(rules.lone_codes(cands)).unionAll(rules.code_noise(cands))
    if ctx.person_names is not None:
        gone = gone.unionAll(rules.person_filter(cands, ctx.person_names))
    if ctx.taxon_spans is not None:
        related = rules.relations(cands, ctx.taxon_spans).where("relation in ('within', 'same')").select(*rules.SPAN).distinct()
        back = rules.contextual_org(related, cands, rules.province_context(cands))
        gone = gone.unionAll(related.join(back, [*rules.SPAN], "left_anti"))
    left = keep(cands.join(gone.distinct(), [*rules.SPAN], "left_anti"), "left")
    countries, provinces = rules.country_context(left), rules.province_context(left)
    parts = [rules.default_score(left), rules.country_rule(left), rules.name_code_rule(left), rules.name_rule(left), rules.heat_map(left), rules.context_rule(left, countries, provinces, params.preferred_cc, params.preferred_cells)]
    population = ctx.population if ctx.population is not None else _empty(spark, "cell string, population long")
    parts.append(rules.major_place_rule(left, population, countries))
    if params.tag_coordinates:
        coords = keep(patterns.coordinates(docs), "coordinates")
        parts.append(rules.coordinate_rule(left, coords))
        points = coords.select(F.struct("doc_id", "start").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
        near = lookup.province_at(points, gaz)
        parts.append(rules.province_rule(left, near.select("point_id.doc_id", "cc", "adm1")))
    parts += [r(left) for r in params.user_rules]
    best = keep(rules.chosen(rules.totals(left, parts)), "chosen")
    whole = rules.merged(rules.confidence(best, countries), rules.name_code_pairs(left))
    if plain:
        whole = whole.withColumnRenamed("doc_id", "first").join(copies.hint("merge"), "first")
    return whole.select(*rules.SPAN, "text", "place_id", "name", "cc", "adm1", "feat_class", "feat_code", "lat", "lon", F.round("score", 6).alias("score"), "rules", "second_id", "confidence")


def matches(docs: DataFrame, gaz: DataFrame, **kw) -> DataFrame:  # noqa: ANN003
    """Places, coordinates and dates of the texts in one table, told apart by type."""
    places = geocode(docs, gaz, **kw).withColumn("type", F.lit("place"))
    coords = patterns.reduced(patterns.coordinates(docs)).where("not is_duplicate and not is_submatch").select(*rules.SPAN, "text", "lat", "lon", F.col("prec_m").alias("prec"), F.lit("coord").alias("type"))
    days = patterns.reduced(patterns.dates(docs)).where("not is_duplicate and not is_submatch").select(*rules.SPAN, "text", "date_norm", F.lit("date").alias("type"))
    return places.unionByName(coords, allowMissingColumns=True).unionByName(days, allowMissingColumns=True)


def filtration(cands: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: spans found, kept, and the share filtered."""
    a = cands.select(*rules.SPAN).distinct().join(kept.select(*rules.SPAN, F.lit(1).alias("k")).distinct(), [*rules.SPAN], "left")
    return a.agg(F.count(F.lit(1)).alias("spans"), F.count("k").alias("kept"), F.round(F.avg(F.col("k").isNull().cast("int")), 6).alias("filtered_share"))


def metrics(docs: DataFrame) -> DataFrame:
    """One row: documents and characters."""
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))


def traits(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.traits(F.col("text")).alias("t")).select("doc_id", "t.*")
