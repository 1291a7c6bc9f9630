"""Geocoding rules. Each takes candidates and returns contributions; scores are the sums of them.

candidates: a row for each place that a span may mean: doc_id, start, end, text, phrase, before, after (the
text around), place_id, name, name_type, cc, adm1, feat_class, feat_code, lat, lon, id_bias; with a weight, a row
stands for so many places.
contributions: doc_id, start, end, place_id, rule, score; a rule counts once for a place of a span.
Spans are few and small against texts, and everything of a document hangs on doc_id, so that the
joins and windows of one document meet in one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geo as G
from ..functions import text as T

SPAN = ("doc_id", "start", "end")
KEY = (*SPAN, "place_id")
NAME_WEIGHT, BIAS_WEIGHT = 0.5, 0.10
NEAR_KM, MAJOR_POPULATION = 10.0, 50_000
ADJACENT = 5
#: Characters of a stretch in which spans look for others.
BUCKET = 64


def _places(cands: DataFrame) -> Column:
    return F.sum("weight") if "weight" in cands.columns else F.count(F.lit(1))


def _by_document(rows: DataFrame) -> DataFrame:
    """rows with all of a document in one partition. The number of partitions is given, as else few are made of them: the rows are small when packed and ten times as large when sorted."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def contribution(rows: DataFrame, rule: str, score: Column) -> DataFrame:
    return rows.select(*KEY, F.lit(rule).alias("rule"), score.cast("double").alias("score"))


def name_score(text: Column, name: Column, name_type: Column) -> Column:
    """Share of the text that the name leaves as it is: length less edit distance, a point either way for case, an agreeing abbreviation or for being ASCII."""
    t, n = F.lower(T.fold(text)), F.lower(T.fold(name))
    case = F.when(T.is_upper(text) == T.is_upper(name), 1).otherwise(-1)
    plain = F.when(T.is_ascii(text) == T.is_ascii(name), 1).otherwise(-1)
    return (F.length(text) - F.levenshtein(t, n) + case + plain) / F.length(text)


def default_score(cands: DataFrame) -> DataFrame:
    """The name's likeness and the place's prior; the feature's weight isn't added."""
    score = NAME_WEIGHT * name_score(F.col("text"), F.col("name"), F.col("name_type")) + BIAS_WEIGHT * F.coalesce("id_bias", F.lit(0)) / 100
    return contribution(cands, "DefaultScore", score)


def lexical(text: Column, name: Column) -> Column:
    return F.when(text == name, F.when(T.is_ascii(text), 1.5).otherwise(2.5)).when(F.lower(text) == F.lower(name), 0.5).otherwise(0.0)


def country_rule(cands: DataFrame) -> DataFrame:
    """Countries by name or by a code of three capitals."""
    code = (F.length("text") == 3) & T.is_upper(F.col("text")) & (F.col("name_type") != "N")
    name = F.length("text") > 3
    rows = cands.where(C.is_political(F.col("feat_code")) & (code | name))
    return contribution(rows, "CountryName", F.when(code, 1.0).otherwise(3.0 + lexical(F.col("text"), F.col("name"))))


def bad_country_mention(cands: DataFrame) -> DataFrame:
    """Spans that are short country mentions not in upper case: to be filtered out."""
    short = (F.length("text") < 4) & ~T.is_upper(F.col("text")) & ~T.has_cjk(F.col("text")) & ~T.has_middle_eastern(F.col("text"))
    return cands.where(C.is_political(F.col("feat_code")) & short).select(*SPAN).distinct()


def country_context(cands: DataFrame) -> DataFrame:
    """(doc_id, cc, mentions, ratio): countries named in a document; the first mention counts twice."""
    spans = cands.where(C.is_political(F.col("feat_code"))).select(*SPAN, "cc").distinct()
    n = spans.groupBy("doc_id", "cc").agg((F.count(F.lit(1)) + 1).alias("mentions"))
    return n.withColumn("ratio", F.col("mentions") / F.sum("mentions").over(Window.partitionBy("doc_id")))


def province_context(cands: DataFrame) -> DataFrame:
    """(doc_id, path, names): provinces that a document's names may lie in, with the number of distinct names; only names of a single province tell."""
    one = cands.where("adm1 is not null").groupBy(*SPAN, "phrase").agg(F.min(C.path(F.col("cc"), F.col("adm1"))).alias("path"), F.max(C.path(F.col("cc"), F.col("adm1"))).alias("other")).where("path = other")
    return one.groupBy("doc_id", "path").agg(F.countDistinct("phrase").alias("names"))


def nationality_context(taxons: DataFrame) -> DataFrame:
    """(doc_id, cc): countries from tags cc+XX of nationalities. taxons: doc_id, tags."""
    return taxons.select("doc_id", F.explode(F.filter("tags", lambda t: t.startswith("cc+"))).alias("t")).select("doc_id", F.substring("t", 4, 2).alias("cc")).distinct()


def adjacent_spans(cands: DataFrame, gap: int = ADJACENT) -> DataFrame:
    """(doc_id, start, end, n_start, n_end, comma): a span and the next one, at most so many characters apart."""
    order = Window.partitionBy("doc_id").orderBy("start")
    spans = cands.select(*SPAN, "after").dropDuplicates([*SPAN])
    pairs = spans.withColumns({"n_start": F.lead("start").over(order), "n_end": F.lead("end").over(order)})
    return pairs.where(_adjacent(gap)).withColumn("comma", _comma()).drop("after")


def _adjacent(gap: int = ADJACENT) -> Column:
    return (F.col("n_start") >= F.col("end")) & (F.col("n_start") - F.col("end") <= gap)


def _comma() -> Column:
    return F.substring(F.col("after"), F.lit(1), F.col("n_start") - F.col("end")).contains(",")


def name_code_pairs(cands: DataFrame) -> DataFrame:
    """Pairs of a place and the province or country named right after it that holds it: keys of both, comma, contained."""
    holder = F.when(C.is_upper_admin(F.col("feat_class"), F.col("feat_code")), F.struct(F.col("place_id").alias("n_place_id"), F.col("cc").alias("n_cc"), F.col("adm1").alias("n_adm1"), F.col("feat_code").alias("n_code")))
    # All of a document in one partition: neither the spans nor the pairs move again.
    slim = _by_document(cands.select(*SPAN, "after", F.struct("place_id", "cc", "adm1").alias("p"), holder.alias("h")))
    spans = slim.groupBy(*SPAN).agg(F.first("after").alias("after"), F.collect_list("p").alias("ps"), F.collect_list("h").alias("hs"))
    order = Window.partitionBy("doc_id").orderBy("start")
    near = spans.withColumns({"n_start": F.lead("start").over(order), "n_end": F.lead("end").over(order), "n": F.lead("hs").over(order)}).where(_adjacent() & (F.size("n") > 0))
    both = near.withColumn("comma", _comma()).select(*SPAN, "n_start", "n_end", "comma", "n", F.explode("ps").alias("p")).select(*SPAN, "p.*", "n_start", "n_end", "comma", F.explode("n").alias("n")).select("*", "n.*").drop("n")
    inside = (F.col("cc") == F.col("n_cc")) & (C.is_political(F.col("n_code")) | (F.col("adm1") == F.col("n_adm1")))
    return both.where(inside & (F.col("place_id") != F.col("n_place_id"))).select(*KEY, "n_start", "n_end", "n_place_id", "n_code", "comma")


def name_code_rule(cands: DataFrame) -> DataFrame:
    """10 for the pair, 2 for the comma (always granted), 4 for containment; the holder gets the same."""
    pairs = name_code_pairs(cands)
    holder = pairs.select("doc_id", F.col("n_start").alias("start"), F.col("n_end").alias("end"), F.col("n_place_id").alias("place_id"))
    return contribution(pairs.select(*KEY).unionAll(holder).distinct(), "NameCode", F.lit(16.0))


def lone_codes(cands: DataFrame) -> DataFrame:
    """Spans that are only codes or abbreviations of provinces and stand in no pair: to be filtered out."""
    only = cands.groupBy(*SPAN).agg(F.min((F.col("name_type") != "N") & C.is_upper_admin(F.col("feat_class"), F.col("feat_code"))).alias("code")).where("code").drop("code")
    paired = name_code_pairs(cands).select("doc_id", F.col("n_start").alias("start"), F.col("n_end").alias("end")).distinct()
    return only.join(paired, [*SPAN], "left_anti")


def coordinate_rule(cands: DataFrame, coords: DataFrame) -> DataFrame:
    """5 at a coordinate of the document, falling to 0 at 10 km. coords: doc_id, lat, lon."""
    c = coords.select("doc_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    # Within 10 km latitudes differ by under a tenth of a degree: a place meets coordinates of its own band and the next ones.
    band = lambda lat: F.floor(lat * 10)
    c = c.withColumn("band", F.explode(F.sequence(band(F.col("c_lat")) - 1, band(F.col("c_lat")) + 1)))
    near = cands.withColumn("band", band(F.col("lat"))).join(c, ["doc_id", "band"]).drop("band").withColumn("km", G.km(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))).where(F.col("km") < NEAR_KM)
    best = near.groupBy(*KEY).agg(F.min("km").alias("km"))
    return contribution(best, "CoordinateProximity", 5 * (NEAR_KM - F.col("km")) / NEAR_KM)


def province_rule(cands: DataFrame, provinces: DataFrame) -> DataFrame:
    """5 for places in a province that the document's coordinates lie in. provinces: doc_id, cc, adm1."""
    return contribution(cands.join(provinces.select("doc_id", "cc", "adm1").distinct(), ["doc_id", "cc", "adm1"], "left_semi"), "CoordinateProvince", F.lit(5.0))


def major_place_rule(cands: DataFrame, population: DataFrame, countries: DataFrame) -> DataFrame:
    """Capitals 4, provinces 2, populations above 50,000 ln(p) - 10; 2 more where the country is named; weight 2 for any. A large population is marked by a rule of its own, of no score. population: cell, population."""
    peopled = cands.withColumn("cell", G.geohash(F.col("lat"), F.col("lon"), 5)).join(population, "cell", "left")
    named = peopled.join(countries.select("doc_id", "cc", F.lit(1).alias("c")), ["doc_id", "cc"], "left")
    pop = F.when((F.col("feat_class") == "P") & (F.col("population") > MAJOR_POPULATION), F.log("population") - 10).otherwise(0.0)
    score = F.when(C.is_capital(F.col("feat_code")), 4.0).when(C.is_admin1(F.col("feat_class"), F.col("feat_code")), 2.0).otherwise(0.0) + pop
    some = named.withColumns({"s": score, "pop": pop}).where("s > 0")
    whole = contribution(some, "MajorPlace", F.col("s") + F.when(F.col("c").isNotNull(), 2.0).otherwise(0.0) + 2)
    return whole.unionAll(contribution(some.where("pop > 0"), "MajorPopulation", F.lit(0.0)))


def relations(spans: DataFrame, others: DataFrame) -> DataFrame:
    """How spans lie to spans of another kind in the same document: same, within, contains, before or after (only blanks between). Equi-join on doc_id and stretches of BUCKET characters, ranges within those.

    spans, others: doc_id, start, end, after (text that follows).
    """
    o = others.select("doc_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("after").alias("o_after"), *[c for c in ("type",) if c in others.columns])
    buckets = lambda lo, hi: F.sequence(F.floor(lo / BUCKET), F.floor(hi / BUCKET))
    o = o.withColumn("o_first", F.floor((F.col("o_start") - 2) / BUCKET)).withColumn("bucket", F.explode(buckets(F.col("o_start") - 2, F.col("o_end") + 2)))
    mine = spans.select(*SPAN, "after").distinct().withColumn("s_first", F.floor(F.col("start") / BUCKET)).withColumn("bucket", F.explode(buckets(F.col("start"), F.col("end"))))
    # A pair that shares several stretches meets in the first of them only.
    pair = mine.join(o, ["doc_id", "bucket"]).where(F.col("bucket") == F.greatest("s_first", "o_first")).drop("bucket", "s_first", "o_first")
    gap = lambda text, a, b: F.trim(F.substring(text, F.lit(1), b - a)) == ""
    s, e, os, oe = (F.col(c) for c in ("start", "end", "o_start", "o_end"))
    kind = (
        F.when((s == os) & (e == oe), "same").when((s >= os) & (e <= oe), "within").when((s <= os) & (e >= oe), "contains")
        .when((os >= e) & (os - e <= 2) & gap(F.col("after"), e, os), "before").when((s >= oe) & (s - oe <= 2) & gap(F.col("o_after"), oe, s), "after")
    )
    return pair.withColumn("relation", kind).where("relation is not null").drop("after", "o_after")


TITLES = ("mr", "mrs", "ms", "dr", "president", "senator", "general", "minister", "king", "queen", "prof")
SUFFIXES = ("jr", "sr", "ii", "iii", "phd", "md", "esq")


def person_filter(spans: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Spans that are persons: after a title, before a suffix, on a list of names (phrase), or written like one that is. spans: doc_id, start, end, text, phrase, before, after."""
    word = lambda tokens: F.lower(F.regexp_replace(F.try_element_at(tokens, F.lit(1)), r"[^\p{L}]", ""))
    each = spans.select(*SPAN, "phrase", "before", "after").distinct()
    direct = each.where(F.coalesce(word(T.tokens_left(F.col("before"))).isin(*TITLES), F.lit(False)) | F.coalesce(word(T.tokens_right(F.col("after"))).isin(*SUFFIXES), F.lit(False)))
    known = direct.select(*SPAN)
    if names is not None:
        known = known.unionAll(each.join(names.select("phrase").distinct(), "phrase", "left_semi").select(*SPAN))
    same = each.join(each.join(known, [*SPAN], "left_semi").select("doc_id", "phrase").distinct(), ["doc_id", "phrase"], "left_semi")
    return same.select(*SPAN).distinct()


def contextual_org(filtered: DataFrame, cands: DataFrame, provinces: DataFrame) -> DataFrame:
    """Filtered spans (within organisations' names) to be taken back: their province is in the document's context; and all spans written the same."""
    inside = cands.join(filtered, [*SPAN], "left_semi").withColumn("path", C.path(F.col("cc"), F.col("adm1"))).join(provinces.select("doc_id", "path"), ["doc_id", "path"], "left_semi")
    same = inside.select("doc_id", "phrase").distinct()
    return cands.join(same, ["doc_id", "phrase"], "left_semi").select(*SPAN).distinct().join(filtered, [*SPAN], "left_semi")


def name_rule(cands: DataFrame) -> DataFrame:
    """Lexical match, and 1 for a word next to the name that says its kind."""
    around = F.concat_ws(" ", T.tokens_left(F.lower("before"), 2), T.tokens_right(F.lower("after"), 2), F.lower("text"))
    kind = (
        F.when((F.col("feat_class") == "P") & around.rlike(r"\b(town|city|village|hamlet)\b"), 1.0)
        .when(C.is_admin1(F.col("feat_class"), F.col("feat_code")) & around.rlike(r"\b(province|state)\b"), 1.0)
        .when((F.col("feat_code") == "ADM2") & around.rlike(r"\b(district|county)\b"), 1.0).otherwise(0.0)
    )
    rows = cands.withColumn("s", lexical(F.col("text"), F.col("name")) + kind).where("s > 0")
    return contribution(rows, "NameRule", F.col("s"))


def code_noise(cands: DataFrame) -> DataFrame:
    """Upper-case spans of up to five letters with more than five places of which under a fifth is administrative: to be filtered out."""
    n, adm = _places(cands), F.sum(F.when(F.col("feat_class") == "A", F.col("weight") if "weight" in cands.columns else 1).otherwise(0))
    grouped = cands.where(T.is_upper(F.col("text")) & (F.length("text") <= 5)).groupBy(*SPAN).agg(n.alias("n"), adm.alias("a"))
    return grouped.where("n > 5 and 5 * a < n").select(*SPAN)


def heat_map(cands: DataFrame) -> DataFrame:
    """Places that lie together: cells and provinces in which two or more names of the document have places lift each of these.

    The boost is scale * (names / 2 + characters / 8) / 10, scale being the number of names (2 for a province); the best bucket of a
    place counts. Provinces are only used where the document has under 50 spans and 5 countries.
    """
    # All of a document in one partition, where windows meet all that the rule asks for; no table of cells is made.
    gh = G.geohash(F.col("lat"), F.col("lon"), 4)
    slim = _by_document(cands.select(*KEY, "phrase", "cc", gh.alias("b4"), F.when(F.col("adm1").isNotNull(), C.path(F.col("cc"), F.col("adm1"))).alias("prov")))
    doc = Window.partitionBy("doc_id")
    small = (F.size(F.collect_set(F.struct("start", "end")).over(doc)) < 50) & (F.size(F.collect_set("cc").over(doc)) < 5)
    rows = slim.withColumn("small", small).select(*KEY, "phrase", F.substring("b4", 1, 3).alias("b3"), "b4", F.when(F.col("small"), F.col("prov")).alias("prov"))
    for bucket in ("b3", "b4", "prov"):
        names = F.collect_set("phrase").over(Window.partitionBy("doc_id", bucket))
        rows = rows.withColumn("names", names).withColumns({"n": F.size("names"), "chars": F.aggregate("names", F.lit(0).cast("long"), lambda a, x: a + F.length(x))})
        boost = (F.lit(2) if bucket == "prov" else F.col("n")) * (F.col("n") / 2 + F.col("chars") / 8) / 10
        rows = rows.withColumn(f"s_{bucket}", F.when(F.col(bucket).isNotNull() & (F.col("n") >= 2), boost)).drop("names", "n", "chars")
    boosted = rows.withColumn("s", F.greatest("s_b3", "s_b4", "s_prov")).where("s is not null").groupBy(*KEY).agg(F.max("s").alias("s"))
    return contribution(boosted, "HeatMap", F.col("s"))


def context_rule(cands: DataFrame, countries: DataFrame, provinces: DataFrame, preferred_cc: Sequence[str] = (), preferred_cells: Sequence[str] = ()) -> DataFrame:
    """Preferences of the caller, the document's provinces (3 s) and countries (s); s is 5 times the country's share of mentions, or 1."""
    joined = cands.join(countries.select("doc_id", "cc", "ratio"), ["doc_id", "cc"], "left").withColumn("path", C.path(F.col("cc"), F.col("adm1")))
    joined = joined.join(provinces.select("doc_id", "path", F.lit(True).alias("p")), ["doc_id", "path"], "left")
    s = F.coalesce(5 * F.col("ratio"), F.lit(1.0))
    score = F.when(F.col("p"), 3 * s).otherwise(0.0) + F.when(F.col("ratio").isNotNull(), s).otherwise(0.0)
    out = contribution(joined.withColumn("s", score).where("s > 0"), "Context", F.col("s"))
    if preferred_cc:
        out = out.unionAll(contribution(cands.where(F.col("cc").isin(*preferred_cc)), "PreferredCountry", F.lit(0.5)))
    if preferred_cells:
        inside = F.greatest(*[G.geohash(F.col("lat"), F.col("lon"), 6).startswith(c) for c in preferred_cells], F.lit(False))
        out = out.unionAll(contribution(cands.where(inside), "PreferredCell", F.lit(1.0)))
    return out


def totals(cands: DataFrame, contributions: Sequence[DataFrame]) -> DataFrame:
    """cands with score and rules: each rule once for a place of a span (its largest score), summed."""
    # Candidates and contributions of a document meet in one partition, where chosen() finds them too.
    every = cands.withColumns({"rule": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    for c in contributions:
        every = every.unionByName(c, allowMissingColumns=True)
    place = Window.partitionBy(*KEY)
    best = F.row_number().over(Window.partitionBy(*KEY, "rule").orderBy(F.desc("score")))
    once = _by_document(every).withColumn("__r", best).where("rule is null or __r = 1").drop("__r")
    summed = once.withColumn("__s", F.sum("score").over(place)).withColumn("rules", F.array_sort(F.collect_set("rule").over(place)))
    return summed.where("rule is null and size(rules) > 0").withColumn("score", F.col("__s")).select(*cands.columns, "score", "rules")


def only_default(rules: Column) -> Column:
    return F.size(F.array_except(rules, F.array(F.lit("DefaultScore")))) == 0


def chosen(scored: DataFrame) -> DataFrame:
    """The best place of each span, second (the next one's id and score), n_places, n_countries; ties by bias, then id."""
    order = Window.partitionBy(*SPAN).orderBy(F.desc("score"), F.desc("id_bias"), "place_id", "name")
    whole = Window.partitionBy(*SPAN)
    ranked = scored.withColumns({
        "rank": F.row_number().over(order), "second_id": F.lead("place_id").over(order), "second_score": F.lead("score").over(order), "second": F.lead(F.struct("lat", "lon", "cc", "adm1", "name")).over(order),
        "n_places": _places(scored).over(whole), "n_countries": F.size(F.collect_set("cc").over(whole)),
    })
    return ranked.where("rank = 1").drop("rank")


#: Points that a mention begins with, and those that evidence adds or takes.
GEODETIC, ONE_PLACE, NAME_REGION, ONE_COUNTRY, COUNTRIES, LEAST, BARE_ACRONYM = 90, 70, 65, 50, 40, 20, 10
ADDED, UNIQUE_COUNTRY, LOWER_CASE, SHORT = 5, 8, -10, 8


def confidence(best: DataFrame, countries: DataFrame, lower_text: bool = False) -> DataFrame:
    """best with confidence, 0 to 100. A country has 65 by name and 20 by abbreviation. Any other place begins with the first of these that holds:

    90 near a coordinate of the document; 70 the only place of its name, and some country is named; 10 a short name with
    diacritics, and none is; 65 in a pair with its province; 50 one country is named; with no evidence but the default score 20,
    or 10 where text and name differ in being upper case; 40 several countries are named; else 20.
    Then: a fifth of the feature's weight; lower case -10, of which administrative places win back 15 and populated ones 10; a
    short name, not administrative, -10 without evidence and -5 in lower case; a point for every five characters and every word (each
    character and word in CJK); with an equal second place 6 within 10 km, 4 of the same name and province, 3 the same province, 2
    the same country, else -5; 5 where the second scores less by a sixth; 8 a name of one country; 5 a major population,
    5 a capital or province, 5 its country is named, 5 each for the caller's country and cell; in texts all in lower case
    the length less 4.
    """
    has = lambda r: F.array_contains("rules", r)
    points = lambda c, n: F.when(c, n).otherwise(0)
    t, n = F.col("text"), F.length("text")
    named = countries.groupBy("doc_id").agg(F.collect_set("cc").alias("__ccs"))
    rows = best.join(named, "doc_id", "left").withColumn("__ccs", F.coalesce("__ccs", F.array().cast("array<string>")))
    m = F.size("__ccs")
    alone, lower, short, admin = only_default(F.col("rules")), T.is_lower(t), n <= SHORT, C.is_administrative(F.col("feat_class"))
    first = (
        F.when(has("CoordinateProximity"), GEODETIC).when((F.col("n_places") == 1) & (m > 0), ONE_PLACE).when((m == 0) & T.has_diacritics(t) & short, LEAST - 10)
        .when(has("NameCode"), NAME_REGION).when(m == 1, ONE_COUNTRY).when(alone, F.when(T.is_upper(t) != T.is_upper(F.col("name")), BARE_ACRONYM).otherwise(LEAST))
        .when(m > 0, COUNTRIES).otherwise(LEAST)
    )
    case = points(lower, F.lit(LOWER_CASE) + F.when(admin, 15).when(F.col("feat_class") == "P", 10).otherwise(0))
    small = points(~admin & short, points(alone, F.lit(-10)) + points(lower & F.lit(not lower_text), F.lit(-5)))
    words = F.size(F.split(F.trim(t), r"\s+"))
    depth = F.when(T.has_cjk(t), n + words).otherwise(F.floor(n / 5) + words)
    other = F.col("second")
    same_land = other["cc"] == F.col("cc")
    same_province = same_land & (other["adm1"] == F.col("adm1"))
    equal = F.coalesce(F.col("second_score") == F.col("score"), F.lit(False))
    tie = F.when(G.km(F.col("lat"), F.col("lon"), other["lat"], other["lon"]) < NEAR_KM, 6).when(same_province & (other["name"] == F.col("name")), 4).when(same_province, 3).when(same_land, 2).otherwise(-5)
    lead = points((F.col("second_score") > 0) & (F.col("score") / F.col("second_score") > 1.2), ADDED)
    evidence = F.when(equal, tie).otherwise(lead) + points(F.col("n_countries") == 1, UNIQUE_COUNTRY) + points(has("MajorPopulation"), ADDED) + points(has("MajorPlace"), ADDED) + points(F.array_contains("__ccs", F.col("cc")), ADDED)
    preferred = points(has("PreferredCountry"), ADDED) + points(has("PreferredCell"), ADDED) + points(F.lit(lower_text), n - 4)
    total = first + F.floor(0.2 * C.feature_weight(F.col("feat_class"), F.col("feat_code"))) + case + small + depth + evidence + preferred
    country = F.when(F.col("name_type") != "N", LEAST).otherwise(NAME_REGION)
    whole = F.when(C.is_political(F.col("feat_code")), country).otherwise(total)
    return rows.withColumn("confidence", F.greatest(F.least(whole, F.lit(100)), F.lit(0)).cast("int")).drop("__ccs")


def merged(best: DataFrame, pairs: DataFrame) -> DataFrame:
    """'A, B' as one span where the chosen places are a pair: A's place, B's span dropped; so are codes of countries that stand alone. best: chosen rows with text; pairs: name_code_pairs()."""
    # Pairs come to the chosen places by document; the place that one is in a pair with is the next one.
    link = pairs.select(*KEY, F.struct("n_start", "n_end", "n_place_id").alias("__n")).distinct()
    mine = best.withColumns({"__n": F.lit(None).cast(link.schema["__n"].dataType), "__best": F.lit(True)})
    rows = mine.unionByName(link, allowMissingColumns=True)
    linked = _by_document(rows).withColumn("__links", F.collect_set("__n").over(Window.partitionBy(*KEY))).where("__best").drop("__n", "__best")
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    following = F.struct(F.lead("start").over(order).alias("n_start"), F.lead("end").over(order).alias("n_end"), F.lead("place_id").over(order).alias("n_place_id"))
    joined = linked.withColumns({"__next": following, "n_text": F.lead("text").over(order)}).withColumn("__real", F.array_contains("__links", F.col("__next")))
    joined = joined.withColumn("__used", F.coalesce(F.lag("__real").over(order), F.lit(False)))
    between = F.substring(F.col("after"), F.lit(1), F.col("__next.n_start") - F.col("end"))
    left = joined.where("__real or not __used").withColumns({"text": F.when(F.col("__real"), F.concat("text", between, "n_text")).otherwise(F.col("text")), "end": F.when(F.col("__real"), F.col("__next.n_end")).otherwise(F.col("end"))})
    bare = C.is_political(F.col("feat_code")) & (F.col("name_type") != "N") & (F.length("text") <= 3)
    return left.where(~bare).select(*best.columns)


def inferred_countries(best: DataFrame) -> DataFrame:
    return best.groupBy("doc_id", "cc").agg(F.count(F.lit(1)).alias("n"))


def triaged(taxons: DataFrame) -> DataFrame:
    """taxons (text, taxnode) with type and kept: persons and organisations in lower case go, acronyms only in upper case stay."""
    low = F.lower("taxnode")
    kind = F.when(low.startswith("person"), "person").when(low.startswith("org."), "org").when(low.startswith("nationality"), "nationality").otherwise("other")
    lower = T.is_lower(F.col("text"))
    keep = F.when(kind.isin("person", "org"), ~lower & ((F.length("text") > 3) | T.is_upper(F.col("text")))).otherwise(True)
    return taxons.withColumn("type", kind).withColumn("kept", keep)
