"""More registered queries: operators on cases typed out with what must come of them, files written and read back, a gazetteer of rival places, streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geo as G
from ..functions import text as T
from ..operators import etl, filters, lookup, patterns, postal, rules, social, tagger
from ..sources import readers, sinks
from . import fixtures as X
from . import geocoder
from .catalog import _geohash_sql, query
from .keep import folder, kept


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


# cases: an operator, its input, and what it must say
_CASES: dict[str, tuple[object, list[tuple]]] = {
    "contraction": (lambda a, b, c: filters.contraction(a, b), [("s", "it'", None, True), ("T he", "don’", None, True), ("Sofia", "in '", None, False), ("d", "by ", None, False)]),
    "short_cjk": (lambda a, b, c: filters.short_cjk(a), [("北京", "", None, True), ("上海市", "", None, False), ("ab", "", None, False)]),
    "short_for_language": (lambda a, b, c: filters.short_for_language(a, b), [("hola", "es", None, False), ("北京", "zh", None, True), ("東京都庁舎", "ja", None, False), ("مدينة", "ar", None, True)]),
    "lower_abbreviation": (lambda a, b, c: filters.lower_abbreviation(a), [("colo", "", None, True), ("CO", "", None, False), ("boulder", "", None, False)]),
    "abbreviation": (lambda a, b, c: T.is_abbreviation(a, b, F.lit(False)), [("Colo", ".", None, True), ("U.S", " ", None, True), ("USA", " ", None, True), ("Boulder", " ", None, False)]),
    "lexicon_punctuation": (lambda a, b, c: filters.lexicon_punctuation(a), [("A%B", "", None, True), ("A-B", "", None, False), ("A-B/C-D", "", None, True), ("O'Neil Jr.", "", None, False)]),
    "server_filtered": (lambda a, b, c: filters.server_filtered(a, b, F.lit(False)), [("CO", "code", None, True), ("abc", "place", None, True), ("Denver", "place", None, False), ("80302", "postal", None, True), ("北京", "place", None, False)]),
    "output_kept": (lambda a, b, c: filters.output_kept(c, a.try_cast("double")), [("100", "", 20, True), ("20000", "", 20, False), ("100", "", 14, False), ("", "", 15, True)]),
    "keyword_junk": (lambda a, b, c: filters.keyword_junk(a), [("abc", "", None, True), ("@someone", "", None, True), ("HTTPS://x.y", "", None, True), ("flood", "", None, False)]),
    "etl_feature_dropped": (lambda a, b, c: filters.etl_feature_dropped(F.split(b, "/")[0], F.split(b, "/")[1], a), [("Blue", "H/STM", None, True), ("Blue", "H/LK", None, False), ("Main", "R/RD", None, True), ("South NW", "L/RGNE", None, True), ("42", "P/PPL", None, True), ("Rome", "P/PPL", None, False)]),
    "search_only": (lambda a, b, c: filters.search_only(a, b), [("Oz", "P", None, True), ("Area 51", "P", None, True), ("aaab", "P", None, True), ("B52", "S", None, True), ("B52", "P", None, False), ("Rome", "P", None, False)]),
    "jrc_valid": (lambda a, b, c: filters.jrc_valid(a), [("and friends", "", None, False), ("the man", "", None, False), ("Ann Lee", "", None, True), ("李明", "", None, True), ("Al", "", None, False)]),
    "factbook_valid": (lambda a, b, c: filters.factbook_valid(a, ("union",)), [("UN", "", None, False), ("WHB", "", None, True), ("Bloc", "", None, True), ("Pac", "", None, False), ("Union", "", None, False)]),
    "social_lower": (lambda a, b, c: filters.social_lower(a), [("paris", "", None, True), ("Paris", "", None, False), ("NYC", "", None, False)]),
    "diacritic_mismatch": (lambda a, b, c: filters.diacritic_mismatch(a, F.split(b, ";")), [("OK", "ØK;øk", None, True), ("OK", "OK", None, False), ("ÄEÃ", "aea;Aeå", None, True), ("ÄEÃ", "ÄEÃ", None, False), ("Longer name", "x", None, False)]),
    "short_mismatch": (lambda a, b, c: filters.short_mismatch(a, b, 0), [("Eï", "ei", None, True), ("In", "In.", None, False), ("Abc", "abd", None, False)]),
    "valid_abbreviation": (lambda a, b, c: filters.valid_abbreviation(a), [("A.B.C.", "", None, True), ("A.B-C", "", None, True), ("A.B/C", "", None, False), ("A<>C", "", None, False)]),
    "non_latin_noise": (lambda a, b, c: filters.non_latin_noise(a), [("北 京 市 区", "", None, True), ("北京", "", None, True), ("北京市朝阳", "", None, False), ("Rome", "", None, False)]),
    "site_exempt": (lambda a, b, c: filters.site_exempt(a), [(x, "", None, True) for x in ("HSP", "HSPC", "BLDA", "BLDO", "SCHC", "SCHT", "SHRN", "TMPL", "MSSN", "CH", "UNIV", "MSQE")] + [(x, "", None, False) for x in ("PPL", "AIRP", "HTL", "PRN", "MUS")]),
    "spaced_out": (lambda a, b, c: tagger.is_spaced_out(a), [("a b c d", "", None, True), ("abc def", "", None, False)]),
    "is_coord": (lambda a, b, c: G.is_coord(a.try_cast("double"), b.try_cast("double")), [("91", "0", None, False), ("90", "-180", None, True), ("x", "1", None, False)]),
    "date_like_grid": (lambda a, b, c: patterns.is_date_like_grid(a), [("10DEC1214", "", None, True), ("4 JAN 2012", "", None, True), ("38SMB4611", "", None, False)]),
    "date_like_degrees": (lambda a, b, c: patterns.is_date_like_degrees(a), [("2012-10-11 10:12:14", "", None, True), ("N42 10 11", "", None, False)]),
    "japanese": (lambda a, b, c: T.is_japanese(a), [("東京タワー", "", None, True), ("北京", "", None, False)]),
    "korean": (lambda a, b, c: T.is_korean(a), [("서울", "", None, True), ("北京", "", None, False)]),
    "chinese": (lambda a, b, c: T.is_chinese(a), [("北京", "", None, True), ("東京タワー", "", None, False), ("abc", "", None, False)]),
    "middle_eastern": (lambda a, b, c: T.has_middle_eastern(a), [("بغداد", "", None, True), ("abc", "", None, False)]),
}


def _cases(spark: SparkSession, cases: dict, kind: str) -> DataFrame:
    out = None
    for name, (f, rows) in cases.items():
        given = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows], "a string, b string, c int")
        one = given.select(F.lit(name).alias("operator"), "a", "b", f(F.col("a"), F.col("b"), F.col("c")).cast(kind).alias("result"))
        out = one if out is None else out.unionAll(one)
    return out


@query(f"SELECT * FROM (VALUES {_values([(n, a, b, r) for n, (_, rows) in _CASES.items() for a, b, _, r in rows])}) v(operator, a, b, result)")
def filter_cases(spark: SparkSession, d: str) -> DataFrame:
    """Predicates on inputs whose answers are typed out."""
    return _cases(spark, _CASES, "boolean")


_TEXT_CASES: dict[str, tuple[object, list[tuple]]] = {
    "squeeze": (lambda a, b, c: T.squeeze(a), [("  a \n b\t", "", None, "a b")]),
    "delete_eol": (lambda a, b, c: T.delete_eol(a), [("a\r\nb\n\nc", "", None, "a b c")]),
    "reduce_line_breaks": (lambda a, b, c: T.reduce_line_breaks(a), [("a\n\n\n\nb\r\n", "", None, "a\n\nb\n")]),
    "remove_punctuation": (lambda a, b, c: T.remove_punctuation(a), [("a, b; $c!", "", None, "a b c")]),
    "remove_symbols": (lambda a, b, c: T.remove_symbols(a), [("a$b+c.", "", None, "abc.")]),
    "remove_emoticons": (lambda a, b, c: T.remove_emoticons(a), [("a😀b☀", "", None, "ab")]),
    "replace_any": (lambda a, b, c: T.replace_any(a, ",;"), [("a,b;c", "", None, "a b c")]),
    "phonetic": (lambda a, b, c: T.phonetic(a), [("Bööst-Town", "", None, "bostown"), ("Éï", "", None, "ei")]),
    "normalize_abbreviation": (lambda a, b, c: T.normalize_abbreviation(a), [("U.S.A.", "", None, "USA"), ("3.5", "", None, "3.5")]),
    "normalize_entity": (lambda a, b, c: T.normalize_entity(a), [('"The  Bank, ', "", None, "The Bank")]),
    "natural_language": (lambda a, b, c: T.natural_language(a), [("go #now @you https://x.y/z ok", "", None, "go now ok")]),
    "hashtags": (lambda a, b, c: F.array_join(T.hashtags(a), "|"), [("#One and #two_3, not # four", "", None, "One|two_3")]),
    "tokens_left": (lambda a, b, c: F.array_join(T.tokens_left(a, 2), "|"), [("a b c", "", None, "b|c"), ("a", "", None, "a")]),
    "tokens_right": (lambda a, b, c: F.array_join(T.tokens_right(a, 2), "|"), [("a b c", "", None, "a|b")]),
    "string_list": (lambda a, b, c: F.array_join(T.string_list(a), "|"), [(" a, ,b ", "", None, "a|b")]),
    "acronym_of": (lambda a, b, c: T.acronym_of(a), [("World Health Body (WHB)", "", None, "WHB"), ("None here (x)", "", None, None)]),
    "without_note": (lambda a, b, c: T.without_note(a), [("Old Town (historical)", "", None, "Old Town")]),
    "admin_code": (lambda a, b, c: C.admin_code(a), [("us.06", "", None, "06"), ("US06", "", None, "06"), ("6", "", None, "06"), ("CA", "", None, "CA")]),
    "fips_to_iso": (lambda a, b, c: C.fips_to_iso(a), [("GM", "", None, "DE"), ("uk", "", None, "GB"), ("XX", "", None, None)]),
    "language_name": (lambda a, b, c: C.language_name(a), [("en-US", "", None, "English"), ("xx", "", None, None)]),
    "language_code": (lambda a, b, c: C.language_code(a), [("German", "", None, "de")]),
    "us_adm1": (lambda a, b, c: etl.us_adm1(a), [("01", "", None, "AL"), ("06", "", None, "CA"), ("11", "", None, "DC"), ("15", "", None, "HI"), ("25", "", None, "MA"), ("44", "", None, "RI"), ("50", "", None, "VT"), ("56", "", None, "WY"), ("03", "", None, "03"), ("ZZ", "", None, "ZZ")]),
    "name_type": (lambda a, b, c: etl.name_type(a, b), [("80302", "postal", None, "C"), ("St.", "", None, "A"), ("Boulder", "", None, "N")]),
    "name_group": (lambda a, b, c: etl.name_group(a), [("北京", "", None, "cjk"), ("بغداد", "", None, "ar"), ("Rome", "", None, "")]),
    "guessed_feature": (lambda a, b, c: etl.guessed_feature(a, b), [("Green River", "", None, "H"), ("Mount Ida", "", None, "T"), ("Lee County", "", None, "A"), ("Rome", "", None, "P"), ("Rome", "S", None, "S")]),
    "retyped": (lambda a, b, c: etl.retyped(b, a), [("Ministry of Truth", "person", None, "org"), ("Red River", "person", None, "place"), ("Ann Lee", "person", None, "person")]),
    "taxon_type": (lambda a, b, c: tagger.taxon_type(a), [("org.bank", "", None, "org"), ("Person.x", "", None, "person"), ("nationality.y", "", None, "nationality"), ("theme", "", None, "taxon")]),
    "feature_weight": (lambda a, b, c: C.feature_weight(a, b), [(a, b, None, str(w)) for a, b, w in (("A", "ADM1", 16), ("A", "ADM2", 13), ("A", "ADM3", 11), ("A", "PCLI", 16), ("A", "PCLD", 16), ("P", "PPLC", 15), ("P", "PPLA2", 10), ("P", "PPLG", 9), ("P", "PPLH", 8), ("P", "PPLQ", 7), ("P", "PPLX", 7), ("P", "PPLL", 8), ("P", "PPL", 10), ("L", "RGN", 6), ("R", "RD", 6), ("H", "LK", 7), ("H", "RSV", 2), ("H", "WLL", 2), ("H", "SPNG", 2), ("V", "FRST", 7), ("S", "AIRP", 8), ("U", "TRGU", 5), ("T", "MT", 5), ("T", "ISL", 6), ("T", "ISLS", 6), ("X", "Y", 5))]),
    "feature_precision": (lambda a, b, c: G.feature_precision_m(a, b).cast("int"), [("P", "PPL", None, "5000"), ("A", "ADM1", None, "50000"), ("A", "PCLI", None, "500000"), ("S", "SCH", None, "10000")]),
    "ambiguous_grid": (lambda a, b, c: F.array_join(F.transform(patterns.ambiguous_grid(a), lambda x: F.concat(x.easting, F.lit("/"), x.northing)), "|"), [("1234", "", None, "12/34"), ("12345", "", None, "12/345|123/45")]),
    "format_latlon": (lambda a, b, c: G.format_latlon(a.cast("double"), b.cast("double")), [("1.5", "-2", None, "1.50000,-2.00000")]),
    "geojson": (lambda a, b, c: sinks.geojson(a, F.lit(1.5), F.lit(2.0)), [("x", "", None, '{"type":"Feature","geometry":{"type":"Point","coordinates":[2.0,1.5]},"properties":{"name":"x"}}')]),
    "kml": (lambda a, b, c: sinks.kml(a, F.lit(1.5), F.lit(2.0), b), [("a & b", "geo", None, "<Placemark><name>a &amp; b</name><styleUrl>#geo</styleUrl><Point><coordinates>2.0,1.5</coordinates></Point></Placemark>")]),
}


@query(f"SELECT * FROM (VALUES {_values([(n, a, b, r) for n, (_, rows) in _TEXT_CASES.items() for a, b, _, r in rows])}) v(operator, a, b, result)")
def text_cases(spark: SparkSession, d: str) -> DataFrame:
    """Functions of texts and codes on inputs whose results are typed out."""
    return _cases(spark, _TEXT_CASES, "string")


# confidence: one row for each branch of the scale, points added up by hand
_CONFIDENCE = [
    # text, name, name_type, cc, class, code, score, second_score, n_places, n_countries, rules, countries named, expected
    ("Egypt", "Egypt", "N", "EG", "A", "PCLI", 5.0, None, 1, 1, "DefaultScore", "EG", 65),
    ("EG", "EG", "C", "EG", "A", "PCLI", 5.0, None, 1, 1, "DefaultScore", "EG", 20),
    ("Longtownville", "Longtownville", "N", "R0", "P", "PPL", 5.0, None, 1, 1, "DefaultScore,CoordinateProximity", "", 90 + 2 + 2 + 1 + 8),
    ("Longtownville", "Longtownville", "N", "R0", "P", "PPL", 5.0, None, 1, 1, "DefaultScore,NameRule", "R0", 70 + 2 + 3 + 8 + 5),
    ("Longtownville", "Longtownville", "N", "R0", "P", "PPLC", 9.0, 3.0, 4, 2, "DefaultScore,MajorPlace,NameCode", "", 65 + 3 + 3 + 5 + 5),
    ("Longtownville", "Longtownville", "N", "R0", "A", "ADM1", 9.0, 8.9, 4, 2, "DefaultScore,NameRule", "R1", 50 + 3 + 3),
    ("Longtownville", "Longtownville", "N", "R0", "P", "PPL", 9.0, 9.0, 4, 2, "DefaultScore", "", 20 + 2 + 3 - 5),
    ("Rome", "Rome", "N", "R0", "P", "PPL", 9.0, 8.9, 4, 2, "DefaultScore", "", 20 + 2 - 10 + 1),
    ("ROME", "Rome", "N", "R0", "P", "PPL", 9.0, 8.9, 4, 2, "DefaultScore", "", 10 + 2 - 10 + 1),
    ("rome", "Rome", "N", "R0", "P", "PPL", 9.0, 8.9, 4, 2, "DefaultScore,HeatMap", "R1,R2", 40 + 2 + 0 - 5 + 1),
    ("Longtownville", "Longtownville", "N", "R0", "P", "PPL", 9.0, 8.9, 4, 2, "DefaultScore,MajorPopulation,PreferredCountry,PreferredCell", "R1,R2", 40 + 2 + 3 + 15),
]


@query(f"SELECT * FROM (VALUES {_values([(i, min(r[-1], 100)) for i, r in enumerate(_CONFIDENCE)])}) v(doc_id, confidence)")
def confidence_cases(spark: SparkSession, d: str) -> DataFrame:
    """The scale of confidence, a case for each of its branches."""
    schema = "doc_id int, start int, end int, place_id string, text string, name string, name_type string, cc string, adm1 string, feat_class string, feat_code string, lat double, lon double, score double, second_score double, second struct<lat:double,lon:double,cc:string,adm1:string,name:string>, n_places int, n_countries int, rules array<string>"
    rows = [(i, 0, len(r[0]), "p", r[0], r[1], r[2], r[3], "01", r[4], r[5], 10.0, 10.0, r[6], r[7], None if r[7] is None else (50.0, 50.0, "ZZ", "09", "Other"), r[8], r[9], r[10].split(",")) for i, r in enumerate(_CONFIDENCE)]
    named = spark.createDataFrame([(i, c) for i, r in enumerate(_CONFIDENCE) for c in r[11].split(",") if c], "doc_id int, cc string")
    return rules.confidence(spark.createDataFrame(rows, schema), named).select("doc_id", "confidence")


# rivals: fifty town names, each in many provinces, told apart by the province named after them
_RIVAL = f"""{X.GAZ}, rival AS (SELECT 'T' || k AS place_id, 'Town ' || (k % 50) AS name, cc, adm1 FROM (SELECT c_custkey AS k, cc, adm1 FROM customer JOIN nat ON c_nationkey = nk))"""


def _rivals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    cus = X.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk")).join(X.nations(spark, d), "nk")
    town = cus.select(F.concat(F.lit("T"), k.cast("string")).alias("place_id"), F.concat(F.lit("Town "), (k % 50).cast("string")).alias("name"), "cc", "adm1", F.lit("P").alias("feat_class"), F.lit("PPL").alias("feat_code"), (k * 37 % 170 - 85).cast("double").alias("lat"), (k * 53 % 350 - 175).cast("double").alias("lon"), F.lit(45).alias("id_bias"), F.lit("N").alias("name_type"))
    upper = X.gazetteer(spark, d).where("feat_class = 'A'")
    return tagger.phrases(town.unionByName(upper.drop("phrase")))


def _rival_texts(spark: SparkSession, d: str) -> DataFrame:
    cus = X.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk")).join(X.nations(spark, d), "nk")
    return cus.select(F.col("k").alias("doc_id"), F.concat(F.lit("They met in Town "), (F.col("k") % 50).cast("string"), F.lit(", "), "adm1_name", F.lit(" last week.")).alias("text"))


@query(f"WITH {_RIVAL} SELECT c_custkey AS doc_id, 12 AS start, (12 + length(t))::INTEGER AS \"end\", t AS text, 'Town ' || (c_custkey % 50) AS name, cc, adm1 FROM (SELECT c_custkey, 'Town ' || (c_custkey % 50) || ', ' || n.adm1_name AS t, n.cc, n.adm1 FROM customer JOIN nat n ON c_nationkey = nk)".replace('\\"', '"'))
def geocode_rivals(spark: SparkSession, d: str) -> DataFrame:
    """The whole geocoder: of all towns of a name, one in the province that is named after it; both spans become one."""
    gaz = kept(_rivals(spark, d), "rivals")
    found = geocoder.geocode(_rival_texts(spark, d), gaz, geocoder.Parameters(tag_coordinates=False))
    return found.select("doc_id", "start", "end", "text", "name", "cc", "adm1")


@query(f"WITH {_RIVAL} SELECT c_custkey AS doc_id, 12 AS start, count(*) AS n_places, count(DISTINCT rival.cc) AS n_countries FROM customer JOIN rival ON rival.name = 'Town ' || (c_custkey % 50) GROUP BY ALL")
def rival_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each town's span; populated places stay however many share the name. What a span may mean hangs on how it is written, so places are counted once for each way of writing."""
    gaz = _rivals(spark, d)
    spans = kept(geocoder.mentions(_rival_texts(spark, d), gaz).select("doc_id", "start", "phrase", "text"), "mentions")
    cands = geocoder.places_of(spans.select("phrase", "text").distinct(), gaz).where("feat_class = 'P'")
    counted = cands.groupBy("phrase", "text").agg(F.count(F.lit(1)).alias("n"), F.collect_set("cc").alias("ccs"))
    countries = F.size(F.array_distinct(F.flatten(F.collect_list("ccs"))))
    return spans.join(counted, ["phrase", "text"]).groupBy("doc_id", "start").agg(F.sum("n").alias("n_places"), countries.cast("long").alias("n_countries"))


@query("SELECT c_custkey AS doc_id, (120 - 20 - CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 10 END)::BIGINT AS kept FROM customer")
def crowded_spans(spark: SparkSession, d: str) -> DataFrame:
    """A span with 120 places: 20 hydrographic ones go, and for odd keys ten historical towns."""
    k = F.col("c_custkey")
    rows = X.table(spark, d, "customer").select(k.alias("doc_id"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.explode(F.sequence(F.lit(0), F.lit(119))).alias("i"))
    kind = rows.withColumns({"feat_class": F.when(F.col("i") < 20, "H").otherwise("P"), "feat_code": F.when((F.col("i") >= 110) & (F.col("doc_id") % 2 == 1), "PPLH").otherwise("PPL")})
    return filters.crowded(kind).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


# rules on typed candidates
_SPANS = "doc_id long, start int, end int, text string, phrase string, before string, after string, place_id string, name string, name_type string, cc string, adm1 string, feat_class string, feat_code string, lat double, lon double, id_bias int"


def _cands(spark: SparkSession) -> DataFrame:
    def one(doc: int, start: int, text: str, before: str = "", after: str = "", pid: str = "p", name: str | None = None, kind: str = "N", cc: str = "R0", adm1: str = "01", fclass: str = "P", code: str = "PPL", lat: float = 10.0, lon: float = 10.0) -> tuple:
        return (doc, start, start + len(text), text, text.lower(), before, after, pid, name or text, kind, cc, adm1, fclass, code, lat, lon, 45)

    rows = [
        one(1, 0, "Egypt", pid="EG", cc="EG", adm1="0", fclass="A", code="PCLI"), one(1, 10, "EGY", pid="EGc", kind="C", cc="EG", adm1="0", fclass="A", code="PCLI"), one(1, 20, "eg", pid="EGd", kind="C", cc="EG", adm1="0", fclass="A", code="PCLI"),
        one(2, 5, "Paris", before="Mr ", pid="PA"), one(2, 40, "Paris", pid="PA"), one(2, 60, "Berlin", after=" Jr.", pid="BE"), one(2, 80, "Rome", pid="RO"),
        one(3, 0, "MA", pid="MA", kind="C", fclass="A", code="ADM1", cc="US", adm1="MA"), one(3, 10, "Boston", after=", MA", pid="BO", cc="US", adm1="MA"), one(3, 18, "MA", pid="MA", kind="C", fclass="A", code="ADM1", cc="US", adm1="MA"),
        one(4, 0, "Oslo", pid="OS", lat=59.9, lon=10.7), one(4, 9, "Bergen", pid="BG", lat=60.39, lon=5.32),
    ]
    return spark.createDataFrame(rows, _SPANS)


@query("SELECT * FROM (VALUES (1, 0, 'CountryName', 3 + 1.5), (1, 10, 'CountryName', 1.0), (4, 0, 'CoordinateProvince', 5.0), (4, 9, 'CoordinateProvince', 5.0)) v(doc_id, start, rule, score)")
def country_and_province_rules(spark: SparkSession, d: str) -> DataFrame:
    c = _cands(spark)
    near = rules.province_rule(c.where("doc_id = 4"), spark.createDataFrame([(4, "R0", "01")], "doc_id long, cc string, adm1 string"))
    return rules.country_rule(c).unionAll(near).select("doc_id", "start", "rule", "score")


@query("SELECT * FROM (VALUES ('bad_country', 1, 20), ('person', 2, 5), ('person', 2, 40), ('person', 2, 60), ('lone_code', 3, 0)) v(why, doc_id, start)")
def filtered_spans(spark: SparkSession, d: str) -> DataFrame:
    """Short country mentions in lower case, persons (by title, by suffix, and the same text elsewhere), codes in no pair."""
    c = _cands(spark)
    parts = (("bad_country", rules.bad_country_mention(c)), ("person", rules.person_filter(c.where("doc_id = 2"))), ("lone_code", rules.lone_codes(c.where("doc_id = 3"))))
    out = [p.select(F.lit(n).alias("why"), "doc_id", "start") for n, p in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("SELECT * FROM (VALUES (1, 0, 4, 0, 4, 'same'), (1, 10, 14, 8, 20, 'within'), (1, 30, 40, 32, 36, 'contains'), (1, 50, 54, 55, 60, 'before'), (1, 71, 75, 64, 70, 'after')) v(doc_id, start, \"end\", o_start, o_end, relation)")
def span_relations(spark: SparkSession, d: str) -> DataFrame:
    """All five ways that spans lie to each other."""
    mine = spark.createDataFrame([(1, s, e, " x") for s, e in ((0, 4), (10, 14), (30, 40), (50, 54), (71, 75))], "doc_id int, start int, end int, after string")
    others = spark.createDataFrame([(1, s, e, " y") for s, e in ((0, 4), (8, 20), (32, 36), (55, 60), (64, 70))], "doc_id int, start int, end int, after string")
    return rules.relations(mine, others)


@query("SELECT * FROM (VALUES (1, 'Ann Lee', 'person', true), (2, 'ann lee', 'person', false), (3, 'WHB', 'org', true), (4, 'Whb', 'org', false), (5, 'french', 'nationality', true)) v(id, text, type, kept)")
def taxon_triage(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "Ann Lee", "person.x"), (2, "ann lee", "person.x"), (3, "WHB", "org.w"), (4, "Whb", "org.w"), (5, "french", "nationality.f")], "id int, text string, taxnode string")
    return rules.triaged(rows).select("id", "text", "type", "kept")


@query("SELECT * FROM (VALUES (1, 'FR'), (1, 'BE'), (2, 'DE')) v(doc_id, cc)")
def nationality_countries(spark: SparkSession, d: str) -> DataFrame:
    return rules.nationality_context(spark.createDataFrame([(1, ["cc+FR", "x", "cc+BE"]), (1, ["cc+FR"]), (2, ["cc+DE"])], "doc_id int, tags array<string>"))


@query("SELECT * FROM (VALUES (3, 10, true)) v(doc_id, start, back)")
def organisations_taken_back(spark: SparkSession, d: str) -> DataFrame:
    """A place within an organisation's name is taken back where its province is in the document's context."""
    c = _cands(spark).where("doc_id = 3")
    gone = c.where("start = 10").select(*rules.SPAN)
    return rules.contextual_org(gone, c, rules.province_context(c)).select("doc_id", "start", F.lit(True).alias("back"))


@query("""WITH t(lang, w, mixed) AS (VALUES ('en', 'The', true), ('en', 'and', true), ('en', 'boulder', false), ('ar', 'واحد', false), ('ar', 'مدينة', false), (NULL, 'واحد', false), ('en', 'unter', false), ('de', 'unter', false))
SELECT lang, w AS text FROM t WHERE NOT (mixed AND lower(w) = w AND length(w) < 12) AND (w, coalesce(lang, '?')) NOT IN (('واحد', 'ar'), ('واحد', '?'), ('unter', 'de'))""")
def stop_words_by_language(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("en", "The", True), ("en", "and", True), ("en", "boulder", False), ("ar", "واحد", False), ("ar", "مدينة", False), (None, "واحد", False), ("en", "unter", False), ("de", "unter", False)], "lang string, text string, doc_mixed boolean")
    words = spark.createDataFrame([("en", "the"), ("ar", "واحد"), ("de", "unter")], "lang string, term string")
    return filters.language_stop_words(rows, words).select("lang", "text")


@query(f"WITH {X.GAZ} SELECT place_id, name IN ('ASIA', 'EUROPE', 'AFRICA') AS continent FROM gaz")
def continents_marked(spark: SparkSession, d: str) -> DataFrame:
    names = tagger.phrases(spark.createDataFrame([("Asia",), ("Europe",), ("Africa",)], "name string"))
    return filters.marked(X.gazetteer(spark, d), names, "continent").select("place_id", "continent")


@query("SELECT * FROM (VALUES (1, 'Colo.', true), (3, 'CO', true)) v(doc_id, text, kept)")
def code_case(spark: SparkSession, d: str) -> DataFrame:
    """Codes and abbreviations count only where the text writes them so, but for case and stops."""
    rows = [(1, 0, 5, "Colo.", "Colo", "A"), (2, 0, 4, "Cold", "Colo", "A"), (3, 0, 2, "CO", "co", "C")]
    return filters.code_mismatch(spark.createDataFrame(rows, "doc_id int, start int, end int, text string, name string, name_type string")).select("doc_id", "text", F.lit(True).alias("kept"))


# look-ups
@query(f"WITH {X.GAZ} SELECT cc, name AS alias, 0 AS territories FROM gaz WHERE feat_code = 'PCLI'")
def country_aliases(spark: SparkSession, d: str) -> DataFrame:
    return lookup.country_names(X.gazetteer(spark, d)).select("cc", F.explode("aliases").alias("alias"), F.size("territories").alias("territories"))


@query(f"WITH {X.GAZ} SELECT nk AS id, n.cc, gaz.adm1 FROM nat n JOIN gaz ON gaz.feat_code = 'ADM1' AND gaz.name = n.adm1_name AND gaz.cc = n.cc")
def province_codes(spark: SparkSession, d: str) -> DataFrame:
    n = X.nations(spark, d).select(F.lower("adm1_name").alias("query"), "cc", "nk")
    return lookup.province_code(n, X.gazetteer(spark, d)).join(n, ["query", "cc"]).select(F.col("nk").alias("id"), "cc", "adm1")


@query(f"WITH {X.GAZ} SELECT place_id, name FROM gaz WHERE place_id = 'C7' UNION ALL SELECT place_id, name FROM gaz WHERE phrase = 'customer 12'")
def plain_lookups(spark: SparkSession, d: str) -> DataFrame:
    gaz = X.gazetteer(spark, d)
    return lookup.by_id(gaz, "C7").select("place_id", "name").unionAll(lookup.first_ten(gaz, "CUSTOMER 12").select("place_id", "name"))


@query(f"WITH {X.GAZ} SELECT place_id, 'Ö' || name AS name, name AS roman FROM gaz")
def roman_names(spark: SparkSession, d: str) -> DataFrame:
    gaz = X.gazetteer(spark, d)
    return lookup.romanised(gaz.withColumn("name", F.concat(F.lit("Ö"), "name")).unionAll(gaz))


@query(f"WITH {X.GAZ}, placed AS (SELECT {_geohash_sql('lat', 'lon', 5)} AS cell, substr(place_id, 2)::BIGINT AS p FROM gaz) SELECT cell, max(p) AS population FROM placed GROUP BY cell")
def population_cells(spark: SparkSession, d: str) -> DataFrame:
    return lookup.population_by_cell(X.gazetteer(spark, d).select("lat", "lon", F.substring("place_id", 2, 12).cast("long").alias("population")))


@query(f"WITH {X.GAZ} SELECT place_id, name FROM gaz WHERE cc = 'R1' AND feat_class = 'P' AND id_bias > 50")
def places_listed(spark: SparkSession, d: str) -> DataFrame:
    return readers.list_places(X.gazetteer(spark, d), "R1", "P", "id_bias > 50").select("place_id", "name")


# curation
@query(f"WITH {X.GAZ} SELECT place_id FROM gaz WHERE cc = 'R1' AND NOT name LIKE '%7'")
def reindexed_rows(spark: SparkSession, d: str) -> DataFrame:
    return etl.reindexed(X.gazetteer(spark, d), "cc = 'R1'", "name like '%7'").select("place_id")


@query(f"WITH {X.GAZ} SELECT cc, adm1, substr(place_id, 1, 1) AS adm2, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM gaz GROUP BY ALL")
def parents_averaged(spark: SparkSession, d: str) -> DataFrame:
    gaz = X.gazetteer(spark, d).withColumn("adm2", F.substring("place_id", 1, 1))
    return etl.averaged_parents(gaz).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query(f"WITH {X.GAZ} SELECT place_id FROM gaz WHERE feat_code = 'ADM1' OR feat_code LIKE 'PCL%'")
def postal_gazetteer_context(spark: SparkSession, d: str) -> DataFrame:
    return etl.postal_context(X.gazetteer(spark, d)).select("place_id")


@query(f"WITH {X.GAZ}, c AS (SELECT cc, CASE WHEN adm1 = '03' THEN 'X3' ELSE adm1 END AS adm1, (c_custkey % 900) AS k FROM customer JOIN nat ON c_nationkey = nk), one AS (SELECT DISTINCT cc, adm1, k FROM c) SELECT cc || '/' || adm1 || '/A ' || k AS place_id, unnest(['A ' || k, 'A' || k]) AS name, cc, adm1 FROM one")
def postal_rows(spark: SparkSession, d: str) -> DataFrame:
    """Provinces recoded, one row for each code of a province, and one without its blank."""
    cus = X.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk")).join(X.nations(spark, d), "nk")
    rows = cus.select("cc", "adm1", F.concat(F.lit("A "), (F.col("k") % 900).cast("string")).alias("code"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    return etl.postal(rows, X.nations(spark, d).where("adm1 = '03'").select("cc", "adm1", F.lit("X3").alias("iso"))).select("place_id", "name", "cc", "adm1")


@query("WITH f AS (SELECT lower(c_name) AS name, c_custkey AS n FROM customer ORDER BY n DESC, c_name LIMIT 100) SELECT name FROM (SELECT lower(s_name) AS name FROM supplier UNION SELECT name FROM f) WHERE name NOT IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey < 4)")
def person_name_sets(spark: SparkSession, d: str) -> DataFrame:
    sup, cus = X.table(spark, d, "supplier"), X.table(spark, d, "customer")
    return etl.person_names(sup.select(F.col("s_name").alias("name")), cus.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("n")), sup.where("s_suppkey < 4").select(F.col("s_name").alias("name")), 100)


@query("SELECT * FROM (VALUES ('WHB', 'org.World Health Body', true, true), ('World Health Body', 'org.World Health Body', false, true), ('Body of Health', 'org.World Health Body', false, true)) v(name, taxnode, acronym, valid)")
def organisation_names(spark: SparkSession, d: str) -> DataFrame:
    return etl.organisations(spark.createDataFrame([("World Health Body (WHB)", ["Body of Health"])], "name string, aliases array<string>"))


@query("SELECT * FROM (VALUES (1, 'Ann Lee', 0, 'Ann Lee', 'person'), (1, 'Anna Lee', 1, 'Ann Lee', 'person'), (2, 'Ministry of Truth', 0, 'Ministry of Truth', 'org')) v(entity_id, name, variant, primary_name, kind)")
def entity_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "person", "de", "Anna Lee"), (1, "person", "u", "Ann Lee"), (1, "person", "en", "and Lee"), (2, "person", "u", "Ministry of Truth")]
    return etl.entity_names(spark.createDataFrame(rows, "entity_id int, kind string, lang string, name string")).select("entity_id", "name", "variant", "primary_name", "kind")


@query(f"WITH {X.GAZ} SELECT place_id, (16 * (feat_code IN ('PCLI', 'ADM1'))::INT + 15 * (feat_code = 'PPLC')::INT + 10 * (feat_code = 'PPL')::INT) * 5 AS id_bias FROM gaz")
def id_biases(spark: SparkSession, d: str) -> DataFrame:
    return X.gazetteer(spark, d).select("place_id", etl.id_bias(F.col("feat_class"), F.col("feat_code")).alias("id_bias"))


@query("SELECT c_custkey AS id, round((c_custkey % 101) / 100.0 * (1 - log10(greatest(c_custkey, 1)::DOUBLE) / 8), 4)::DOUBLE AS accuracy FROM customer")
def location_accuracies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return X.table(spark, d, "customer").select(k.alias("id"), G.location_accuracy(k % 101, k.cast("double")).alias("accuracy"))


# files written and read back
def _where(spark: SparkSession) -> str:
    return folder(spark) or "file://" + tempfile.mkdtemp(prefix="files-")  # the latter only where executors are threads of this process


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text, lang FROM documents")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    path = _where(spark) + "/documents-json"
    X.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang").write.mode("overwrite").option("compression", "gzip").json(path)
    return readers.documents(spark, path).withColumn("text", F.md5("text"))


@query("SELECT conv_id || '-' || turn AS id, role AS text, 'en' AS user_lang, turn::DOUBLE AS utc_offset, 'x' AS location FROM conversations")
def json_messages(spark: SparkSession, d: str) -> DataFrame:
    path = _where(spark) + "/messages-json"
    user = F.struct(F.lit("en").alias("lang"), (F.col("turn") * 3600.0).alias("utc_offset"), F.lit("x").alias("location"))
    X.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id_str"), F.col("role").alias("text"), user.alias("user")).write.mode("overwrite").json(path)
    return readers.messages(spark, path).select("id", "text", "user_lang", "utc_offset", "location")


def _tsv(rows: DataFrame, path: str, sep: str = "\t", header: bool = False) -> str:
    rows.write.mode("overwrite").option("sep", sep).option("header", str(header).lower()).option("quote", "").option("emptyValue", "").csv(path)
    return path


@query("SELECT 'G' || c_custkey AS place_id, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['Ä' || c_custkey, 'A' || c_custkey, 'x', 'y'] ELSE ['Ä' || c_custkey, 'A' || c_custkey] END) AS name, 'DE' AS cc, '01' AS adm1 FROM customer")
def geonames_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    none = F.lit(None).cast("string")
    row = [k, F.concat(F.lit("Ä"), k), F.concat(F.lit("A"), k), F.when(F.col("c_custkey") % 2 == 0, "x,y"), F.lit("1.5"), F.lit("2.5"), F.lit("P"), F.lit("PPL"), F.lit("DE"), none, F.lit("01"), *[none] * 8]
    path = _tsv(X.table(spark, d, "customer").select(*[c.alias(f"c{i}") for i, c in enumerate(row)]), _where(spark) + "/geonames")
    return readers.geonames(spark, path).select("place_id", "name", "cc", "adm1")


@query("SELECT 'USGS' || c_custkey AS place_id, 'Lake ' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'PR' ELSE 'US' END AS cc, CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE 'CO' END AS adm1, CASE WHEN c_custkey % 2 = 0 THEN 'H/LK' ELSE 'T/PK' END AS feature FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def usgs_rows(spark: SparkSession, d: str) -> DataFrame:
    """National file and class map from files: notes, historical places and unknown classes go."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Lake "), k.cast("string"), F.when(k % 7 == 0, " (historical)").otherwise(F.when(k % 5 == 0, " (big)").otherwise("")))
    kind = F.when(k % 11 == 0, "Nothing").when(k % 2 == 0, "Lake").otherwise("Summit")
    rows = X.table(spark, d, "customer").select(k.alias("FEATURE_ID"), name.alias("FEATURE_NAME"), kind.alias("FEATURE_CLASS"), F.when(k % 3 == 0, "PR").otherwise("CO").alias("STATE_ALPHA"), F.lit("1.5").alias("PRIM_LAT_DEC"), F.lit("2.5").alias("PRIM_LONG_DEC"))
    path, map_path = _where(spark) + "/usgs", _where(spark) + "/usgs-map"
    _tsv(rows, path, "|", True)
    _tsv(spark.createDataFrame([("Lake", "H", "LK"), ("Summit", "T", "PK")], "USGS_FEATURE_CLASS string, FEATURE_CLASS string, FEATURE_CODE string"), map_path, ",", True)
    out = etl.usgs(readers.usgs(spark, path), readers.feature_map(spark, map_path))
    return out.select("place_id", "name", "cc", "adm1", F.concat_ws("/", "feat_class", "feat_code").alias("feature"))


@query("SELECT unnest(['old', 'new']) AS layout, 'N' || c_custkey AS place_id, 'name ' || c_custkey AS name, 1.5::DOUBLE AS lat FROM customer")
def nga_layouts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    cus, out = X.table(spark, d, "customer"), None
    for layout, version, names in (("old", 2015, "UFI FULL_NAME_RO CC1 ADM1 FC DSG LAT LONG"), ("new", 2023, "ufi full_name cc_ft adm1 fc desig_cd lat_dd long_dd")):
        values = (k, F.concat(F.lit("name "), k), F.lit("R0"), F.lit("01"), F.lit("P"), F.lit("PPL"), F.lit("1.5"), F.lit("2.5"))
        path = _tsv(cus.select(*[v.alias(n) for v, n in zip(values, names.split())]), f"{_where(spark)}/nga-{layout}", header=True)
        one = readers.nga(spark, path, version).select(F.lit(layout).alias("layout"), "place_id", "name", "lat")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT 'DE' AS cc, c_custkey::VARCHAR AS code, c_name AS place, 1.5::DOUBLE AS lat FROM customer")
def postal_files(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    row = [F.lit("DE"), F.col("c_custkey").cast("string"), F.col("c_name"), *[none] * 6, F.lit("1.5"), F.lit("2.5"), F.lit("4")]
    path = _tsv(X.table(spark, d, "customer").select(*[c.alias(f"c{i}") for i, c in enumerate(row)]), _where(spark) + "/postal")
    return readers.postal(spark, path).select("cc", "code", "place", "lat")


@query("SELECT c_name AS name, c_custkey::DOUBLE AS lat FROM customer")
def adhoc_files(spark: SparkSession, d: str) -> DataFrame:
    path = _tsv(X.table(spark, d, "customer").select(F.regexp_replace("c_name", "#", "#").alias("name"), F.col("c_custkey").cast("string").alias("lat"), F.lit("0").alias("lon")), _where(spark) + "/adhoc", ",", True)
    return readers.adhoc_places(spark, path).select("name", "lat")


@query("SELECT 'ISO' || cc AS place_id, unnest([name, cc, iso3]) AS name, unnest(['N', 'C', 'C']) AS name_type FROM (SELECT 'R' || r_regionkey AS cc, r_name AS name, 'R0' || r_regionkey AS iso3 FROM region)")
def iso_countries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey").cast("string")
    rows = X.table(spark, d, "region").select(F.concat(F.lit("R"), k).alias("cc"), F.concat(F.lit("R0"), k).alias("iso3"), F.col("r_name").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    return readers.country_rows(rows).select("place_id", "name", "name_type")


@query("SELECT DISTINCT unnest([p_brand, lower(p_brand)]) AS term FROM part")
def exclusion_files(spark: SparkSession, d: str) -> DataFrame:
    path = _tsv(X.table(spark, d, "part").select(F.col("p_brand").alias("exclusion"), F.lit("x").alias("category")), _where(spark) + "/exclusions", ",", True)
    return readers.exclusions(spark, path)


@query("SELECT DISTINCT 'en' AS lang, lower(p_type) AS term FROM part")
def stop_word_files(spark: SparkSession, d: str) -> DataFrame:
    path = _where(spark) + "/stop-words"
    X.table(spark, d, "part").select(F.concat(F.lit(" "), "p_type", F.lit(" | note")).alias("value")).write.mode("overwrite").text(path)
    return readers.stop_words(spark, path, "en")


@query("SELECT c_custkey AS entity_id, CASE c_custkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'org' ELSE 'other' END AS kind, 'u' AS lang, 'Ann ' || c_custkey AS name FROM customer")
def entity_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    path = _where(spark) + "/entities"
    X.table(spark, d, "customer").select(F.concat_ws("\t", k.cast("string"), F.when(k % 3 == 0, "P").when(k % 3 == 1, "O").otherwise("G"), F.lit("u"), F.concat(F.lit("Ann+"), k.cast("string"))).alias("value")).write.mode("overwrite").text(path)
    return readers.entity_lines(spark, path)


@query("SELECT lower(p_brand) AS word, sum(p_size)::BIGINT AS n FROM part GROUP BY 1")
def word_count_files(spark: SparkSession, d: str) -> DataFrame:
    path = _tsv(X.table(spark, d, "part").select("p_brand", F.lit("1999"), F.col("p_size").cast("string"), F.lit("1")), _where(spark) + "/word-counts")
    return readers.word_counts(spark, path)


@query("SELECT n_nationkey AS id, substr(lang, 6) AS lang, unnest(CASE lang WHEN 'name_en' THEN [n_name, 'B'] ELSE [n_name] END) AS name FROM nation, (VALUES ('name_en'), ('name_de')) v(lang)")
def wide_name_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit("|B")).alias("name_en"), F.col("n_name").alias("name_de"))
    return readers.wide_names(rows, ("id",))


@query(f"WITH {X.GAZ} SELECT place_id, name, lat FROM gaz WHERE cc = 'R2' AND lat > 0")
def gazetteer_written(spark: SparkSession, d: str) -> DataFrame:
    """Written by country and read back with one country's folder and a pushed-down condition."""
    path = _where(spark) + "/gazetteer"
    sinks.write_gazetteer(X.gazetteer(spark, d), path)
    return readers.gazetteer(spark, path, "R2", "lat > 0").select("place_id", "name", "lat")


@query(f"WITH {X.GAZ} SELECT place_id AS text, lat, lon FROM gaz")
def csv_written(spark: SparkSession, d: str) -> DataFrame:
    path = _where(spark) + "/places-csv"
    sinks.write_gis(X.gazetteer(spark, d).select(F.col("place_id").alias("text"), "lat", "lon"), path, "csv")
    return spark.read.option("header", "true").schema("text string, lat double, lon double").csv(path)


@query(f"WITH {X.GAZ} SELECT place_id, CASE WHEN cc = 'R1' THEN 'gone' ELSE name END AS name FROM gaz WHERE feat_code <> 'PCLI'")
def gazetteer_changed(spark: SparkSession, d: str) -> DataFrame:
    gaz = X.gazetteer(spark, d)
    new = sinks.updated(gaz, F.col("cc") == "R1", {"name": F.lit("gone")})
    return sinks.deleted(new, gaz.where("feat_code = 'PCLI'")).select("place_id", "name")


@query(f"""WITH {X.GAZ} SELECT place_id, '{{"name":"' || name || '","cc":"' || cc || '","adm1":"' || adm1 || '","feat_class":"' || feat_class || '","feat_code":"' || feat_code || '"' || CASE WHEN lat = 0 AND lon = 0 THEN '' ELSE ',"lat":' || lat || ',"lon":' || lon END || '}}' AS json FROM gaz""")
def geocoding_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.geocoding(X.gazetteer(spark, d))


@query("SELECT * FROM (VALUES (1, 'Rome', 0), (1, 'Oslo', 9)) v(doc_id, text, start)")
def batch_output(spark: SparkSession, d: str) -> DataFrame:
    """Of a text that occurs twice the first; confident and precise enough."""
    rows = [(1, 0, 4, "Rome", 20, 100.0), (1, 20, 24, "Rome", 50, 100.0), (1, 9, 13, "Oslo", 15, 9000.0), (1, 40, 44, "Bonn", 14, 10.0), (1, 50, 55, "Paris", 90, 20000.0)]
    return sinks.kept(spark.createDataFrame(rows, "doc_id int, start int, end int, text string, confidence int, prec double")).select("doc_id", "text", "start")


@query("""SELECT '{"rec_id":' || c_custkey || ',"inference":"geo"}' AS value FROM customer""")
def social_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.social_lines(X.table(spark, d, "customer").select(F.col("c_custkey").alias("rec_id"), F.lit("geo").alias("inference")))


# social and postal
@query("SELECT * FROM (VALUES (1, 'Paris', 'geo'), (2, 'Rome', 'place')) v(id, text, kind)")
def mention_kinds(spark: SparkSession, d: str) -> DataFrame:
    return social.mention_kind(spark.createDataFrame([(1, "Paris", 40), (2, "Rome", 5), (3, "paris", 90)], "id int, text string, confidence int")).select("id", "text", "kind")


@query("SELECT o_orderstatus AS method, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4)::DOUBLE AS percent FROM orders GROUP BY 1")
def method_percentages(spark: SparkSession, d: str) -> DataFrame:
    return social.percentages(X.table(spark, d, "orders").select(F.col("o_orderstatus").alias("method")))


@query("SELECT * FROM (VALUES (1, 0, 'a', 'name'), (1, 9, 'c', 'code')) v(doc_id, start, place_id, kind)")
def candidates_combined(spark: SparkSession, d: str) -> DataFrame:
    schema = "doc_id int, start int, end int, place_id string, kind string"
    names, post = spark.createDataFrame([(1, 0, 4, "a", "name")], schema), spark.createDataFrame([(1, 0, 4, "b", "code"), (1, 9, 13, "c", "code")], schema)
    return postal.combined(names, post).select("doc_id", "start", "place_id", "kind")


@query("SELECT * FROM (VALUES (2, 3, 17, 5, 32), (1, 1, 0, 4, 20), (9, 9, 900, 9, 100)) v(links, level, score, length, confidence)")
def postal_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(2, 3, 17, 5), (1, 1, 0, 4), (9, 9, 900, 9)], "links int, level int, score int, length int")
    return rows.withColumn("confidence", postal.confidence(*map(F.col, ("links", "level", "score", "length"))))


@query("SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(length(text)) FROM documents)::BIGINT AS chars, 10 AS spans, 6 AS kept, 0.4::DOUBLE AS filtered_share")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    spans = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    share = geocoder.filtration(spans, spans.where("doc_id < 6"))
    return geocoder.metrics(X.table(spark, d, "documents")).join(F.broadcast(share))


# patterns that the texts of the tables don't have
_LIFE_CASES = [("see https://a.example/x?y=1 now", "URL"), ("mac 00:1B:44:11:3A:B7 ok", "MAC"), ("paid $1,200.50 today", "AMOUNT"), ("mail a.b@c.example", "EMAIL"), ("ip 10.0.0.1", "IP")]


@query(f"SELECT * FROM (VALUES {_values([(i, r) for i, (_, r) in enumerate(_LIFE_CASES)])}) v(doc_id, rule)")
def pattern_life(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.life(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_LIFE_CASES)], "doc_id int, text string"))
    return patterns.reduced(found).where("not is_submatch and not is_duplicate").select("doc_id", "rule")


# streams
@query(r"SELECT doc_id, count(*) AS spans FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) WHERE w IN ('the', 'und', 'que', 'les') GROUP BY doc_id")
def stream_tag(spark: SparkSession, d: str) -> DataFrame:
    """The tagger on a stream of files, run to its end: no action while planning, no state."""
    known = tagger.compiled(["the", "und", "que", "les"])
    at = _where(spark) + "/stream-tag-" + spark.sparkContext.applicationId
    source = X.table(spark, d, "documents").select("doc_id", "text")
    source.write.mode("overwrite").parquet(at + "/in")
    docs = spark.readStream.schema(source.schema).parquet(at + "/in")
    spark._jvm.org.apache.hadoop.fs.Path(at + "/out").getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(at + "/out"), True)
    spark._jvm.org.apache.hadoop.fs.Path(at + "/state").getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(at + "/state"), True)
    tagger.tag(docs, known).select("doc_id", "start", "phrase").writeStream.format("parquet").option("path", at + "/out").option("checkpointLocation", at + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, start int, phrase string").parquet(at + "/out").groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"))

