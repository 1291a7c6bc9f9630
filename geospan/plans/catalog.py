"""The registered queries of the library's own operators, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geo as G
from ..functions import text as T
from ..operators import etl, filters, lookup, patterns, postal, rules, social, tagger
from ..sources import readers, sinks
from . import fixtures as X
from . import geocoder
from .keep import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents")


# tagging
_LEX = rf"""WITH {X.LEXICON}, {X.tags_sql('documents', 'dict', 5)},
kept AS (SELECT * FROM tags a WHERE NOT EXISTS (SELECT 1 FROM tags b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b."end" >= a."end" AND (b.start < a.start OR b."end" > a."end"))),
seen AS (SELECT k.*, substr(d.text, k.start + 1, k."end" - k.start) AS text FROM kept k JOIN documents d USING (doc_id)),
good AS (SELECT * FROM seen WHERE length(text) >= 3 AND lower(text) <> text AND length(regexp_replace(text, '[^\r\n\t]', '', 'g')) <= 1),
lex AS (SELECT doc_id, start, "end", text, min(taxnode) AS taxnode, count(DISTINCT taxnode) AS n_taxons FROM good JOIN dict USING (phrase) GROUP BY ALL)"""


def _lexicon_tags(spark: SparkSession, d: str) -> DataFrame:
    found = tagger.lexicon_tag(_docs(spark, d), tagger.allowed(X.lexicon(spark, d), ["bench"]))
    return found.select("doc_id", "start", "end", "text", F.col("taxons")[0].taxnode.alias("taxnode"), F.size("taxons").cast("long").alias("n_taxons"))


@query(_LEX + " SELECT * FROM lex")
def lexicon_tag(spark: SparkSession, d: str) -> DataFrame:
    return _lexicon_tags(spark, d)


@query(_LEX + " SELECT lang, count(*) AS spans, count(DISTINCT doc_id) AS docs FROM lex JOIN documents USING (doc_id) GROUP BY lang")
def lexicon_counts_by_lang(spark: SparkSession, d: str) -> DataFrame:
    rows = _lexicon_tags(spark, d).join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("doc_id").alias("docs"))


_LDR = rf"""WITH {X.GAZ}, {X.TEXTS}, dict AS (SELECT phrase FROM gaz UNION SELECT lower(n_name) || ' ' || lower(r_name) FROM (SELECT replace(n_name, '_', ' ') AS n_name, n_regionkey FROM nation) JOIN region ON n_regionkey = r_regionkey),
{X.tags_sql('text_fx', 'dict', 4)},
ordered AS (SELECT doc_id, list(struct_pack(s := start, e := "end") ORDER BY "end" - start DESC, start DESC) AS l FROM (SELECT DISTINCT doc_id, start, "end" FROM tags) GROUP BY doc_id),
picked AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN a ELSE list_concat(a, x) END) AS l FROM ordered)"""


@query(_LDR + ' SELECT doc_id, u.s AS start, u.e AS "end" FROM (SELECT doc_id, unnest(l) AS u FROM picked)')
def gaz_tag_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The gazetteer's names and, to overlap them, pairs 'province country'."""
    region = X.table(spark, d, "region")
    pairs = X.table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(T.norm(F.concat_ws(" ", "n_name", "r_name")).alias("phrase"))
    words = X.gazetteer(spark, d).select("phrase").unionAll(pairs)
    return tagger.tag(X.texts(spark, d), words, overlaps="longest_dominant_right", limit=tagger.TAG_LIMIT).select("doc_id", "start", "end").distinct()


@query("SELECT phrase, catalog, taxnode FROM (WITH " + X.LEXICON + " SELECT * FROM dict) WHERE ' ' || phrase || ' ' LIKE '% the %' AND length(phrase) <= 60")
def lexicon_search(spark: SparkSession, d: str) -> DataFrame:
    return tagger.search(X.lexicon(spark, d), "the", 60).select("phrase", "catalog", "taxnode")


# spans and filters
_WORDS = X.spans_sql("documents", r"[\p{L}\p{N}]+", "w")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return tagger.all_words(_docs(spark, d), "lang")


@query(rf"""WITH {_WORDS}
SELECT lang, count(*) AS words, sum((length(t) <= 1)::INT) AS too_short, sum((length(t) < 3)::INT) AS under_min, sum((regexp_full_match(t, '[\x00-\x7f]*') AND lower(t) = t AND regexp_matches(t, '\p{{L}}') AND length(t) <= 20)::INT) AS lower_phrase,
  sum((regexp_matches(t, '^\d+$'))::INT) AS numbers, sum((upper(t) = t AND regexp_matches(t, '\p{{L}}'))::INT) AS upper_case, max(e) AS last
FROM w JOIN documents USING (doc_id) GROUP BY lang""")
def span_filters(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("text"), lambda c: F.sum(F.when(c, 1).otherwise(0))
    return _words(spark, d).groupBy("lang").agg(
        F.count(F.lit(1)).alias("words"), n(filters.too_short(t)).alias("too_short"), n(F.length(t) < filters.token_min_length(F.col("lang"))).alias("under_min"), n(filters.lower_phrase(t)).alias("lower_phrase"),
        n(t.rlike(r"^\d+$")).alias("numbers"), n(T.is_upper(t)).alias("upper_case"), F.max("end").alias("last"),
    )


@query(rf"""WITH {_WORDS}, common AS (SELECT lower(t) AS term FROM w GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
SELECT doc_id, count(*) AS kept FROM w WHERE lower(t) NOT IN (SELECT term FROM common) GROUP BY doc_id""")
def stop_terms_anti(spark: SparkSession, d: str) -> DataFrame:
    """Words left after the twenty most frequent are taken for stop terms."""
    words = _words(spark, d)
    stop = words.groupBy(F.lower("text").alias("term")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(20)
    return filters.without_terms(words, stop).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(r"""SELECT doc_id, (lower(text) = text AND regexp_matches(text, '\p{L}')) AS is_lower, (upper(text) = text AND regexp_matches(text, '\p{L}')) AS is_upper,
  length(regexp_replace(text, '[^\p{Nd}]', '', 'g'))::INTEGER AS digits, length(regexp_replace(text, '[^\r\n\t]', '', 'g'))::INTEGER AS formatting, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::INTEGER AS squeezed,
  regexp_matches(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]') AS has_cjk, md5(text) AS text_id FROM documents""")
def text_traits(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", T.is_lower(t).alias("is_lower"), T.is_upper(t).alias("is_upper"), T.count_digits(t).alias("digits"), T.count_formatting(t).alias("formatting"), F.length(T.squeeze(t)).alias("squeezed"), T.has_cjk(t).alias("has_cjk"), T.text_id(t).alias("text_id"))


@query(f"SELECT doc_id, md5(lower({X.fold_sql('text')})) AS folded, ({X.fold_sql('text')} <> text) AS has_diacritics FROM documents")
def text_folding(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(F.lower(T.fold(t))).alias("folded"), T.has_diacritics(t).alias("has_diacritics"))


@query("""SELECT c_custkey, c_name, length(c_name) - length(replace(c_name, '0', '')) AS zeros, (length(c_name) <= 20 AND regexp_matches(c_name, '#')) AS irregular, levenshtein(c_name, 'Customer#000000000') AS distance,
  (CASE WHEN c_custkey % 9999 < 4 THEN true ELSE (c_custkey % 9999 > 1975 AND c_custkey % 9999 < 2025) OR length((c_custkey % 9999)::VARCHAR) < 4 END) AS bad_postal FROM customer""")
def name_filters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("c_name")
    code = (F.col("c_custkey") % 9999).cast("string")
    return X.table(spark, d, "customer").select("c_custkey", "c_name", F.regexp_count(t, F.lit("0")).cast("long").alias("zeros"), ((F.length(t) <= 20) & filters.irregular_punctuation(t)).alias("irregular"), F.levenshtein(t, F.lit("Customer#000000000")).cast("long").alias("distance"), filters.bad_postal(code).alias("bad_postal"))


# patterns
def _life_sql(part: str, rule: str, family: str, norm: str) -> str:
    return f"WITH {X.spans_sql('documents', part)} SELECT doc_id, s AS start, e AS \"end\", t AS text, '{family}' AS family, '{rule}' AS rule, {norm} AS norm FROM sp"


def _life(spark: SparkSession, d: str, rule: str) -> DataFrame:
    found = patterns.life(_docs(spark, d)).where(F.col("rule") == rule)
    return found.select("doc_id", "start", "end", "text", "family", "rule", "norm")


_R = {r.id: r for r in patterns.compiled(patterns.LIFE)[0]}


@query(_life_sql(_R["EMAIL"].regex, "EMAIL", "CYBER", "lower(t)"))
def pat_email(spark: SparkSession, d: str) -> DataFrame:
    return _life(spark, d, "EMAIL")


@query(_life_sql(_R["IP"].regex, "IP", "CYBER", "lower(t)"))
def pat_ip(spark: SparkSession, d: str) -> DataFrame:
    return _life(spark, d, "IP")


@query(_life_sql(_R["PHONE"].regex, "PHONE", "TELEPHONE", r"regexp_replace(t, '[^\d+]', '', 'g')"))
def pat_phone(spark: SparkSession, d: str) -> DataFrame:
    return _life(spark, d, "PHONE")


@query(rf"WITH {X.TEXTS}, {X.spans_sql('text_fx', r'[12]\d{3}-[01]\d-[0-3]\d')} SELECT doc_id, s AS start, e AS \"end\", t AS text, 'YMD' AS family, t AS date_norm, t::TIMESTAMP AS ts, 'DAY' AS resolution FROM sp".replace('\\"', '"'))
def pat_date(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.dates(X.texts(spark, d))
    return found.select("doc_id", "start", "end", "text", "family", "date_norm", F.col("ts").cast("timestamp_ntz").alias("ts"), "resolution")


_DD = rf"""{X.TEXTS}, {X.spans_sql('text_fx', r'[NS]\d+\.\d+, [EW]\d+\.\d+')},
dd AS (SELECT doc_id, s AS start, e AS "end", t AS text, regexp_extract(t, '[NS](\d+\.\d+)', 1)::DOUBLE * CASE WHEN t LIKE 'S%' THEN -1 ELSE 1 END AS lat, regexp_extract(t, '[EW](\d+\.\d+)', 1)::DOUBLE * CASE WHEN t LIKE '%W%' THEN -1 ELSE 1 END AS lon FROM sp)"""


@query(f'WITH {_DD} SELECT doc_id, start, "end", text, round(lat, 6) AS lat, round(lon, 6) AS lon, 556.0::DOUBLE AS prec_m FROM dd')
def pat_coord_dd(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.reduced(patterns.coordinates(X.texts(spark, d))).where("not is_duplicate and not is_submatch")
    return found.select("doc_id", "start", "end", "text", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "prec_m")


def _dms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("N"), F.lpad((k % 80).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"), F.lpad((k % 59).cast("string"), 2, "0"), F.lit(" W"), F.lpad((k % 170).cast("string"), 3, "0"), F.lpad((k % 57).cast("string"), 2, "0"), F.lpad((k % 53).cast("string"), 2, "0"))
    return X.table(spark, d, "customer").select(k.alias("doc_id"), text.alias("text"))


@query("SELECT c_custkey AS doc_id, round(k % 80 + (k % 60) / 60.0 + (k % 59) / 3600.0, 6)::DOUBLE AS lat, round(-(k % 170 + (k % 57) / 60.0 + (k % 53) / 3600.0), 6)::DOUBLE AS lon, 'DMS-02a' AS rule FROM (SELECT c_custkey, c_custkey::DOUBLE AS k FROM customer)")
def pat_coord_dms(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.reduced(patterns.coordinates(_dms(spark, d), ["DMS", "DM", "DD"])).where("not is_duplicate and not is_submatch")
    return found.select("doc_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "rule")


@query()
def pat_mgrs_utm(spark: SparkSession, d: str) -> DataFrame:
    """Grid references made from customers' keys."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("38SMB"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lpad((k * 7 % 100000).cast("string"), 5, "0"), F.lit(" or 17N "), (k % 600000 + 200000).cast("string"), F.lit(" 3333335"))
    found = patterns.coordinates(X.table(spark, d, "customer").select(k.alias("doc_id"), text.alias("text")), ["MGRS", "UTM"])
    return found.select("doc_id", "start", "end", "text", "rule", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query()
def pattern_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every #TEST of the pattern files with what was found."""
    rows = [(s, c.id, c.text, c.found, ok) for s, f in (("coordinates", patterns.COORDINATES), ("loose", patterns.LOOSE), ("dates", patterns.DATES), ("life", patterns.LIFE)) for c, ok in patterns.run_checks(spark, f)]
    return spark.createDataFrame(rows, "file string, rule string, text string, expected boolean, found boolean")


# gazetteer
def _geohash_sql(lat: str, lon: str, size: int) -> str:
    n_lat, n_lon = size * 5 // 2, size * 5 - size * 5 // 2
    y, x = f"least(floor(({lat} + 90) / 180 * {1 << n_lat}), {(1 << n_lat) - 1})::BIGINT", f"least(floor(({lon} + 180) / 360 * {1 << n_lon}), {(1 << n_lon) - 1})::BIGINT"
    bit = lambda i: f"(({x if i % 2 == 0 else y} >> {(n_lon if i % 2 == 0 else n_lat) - 1 - i // 2}) & 1)"
    return " || ".join(f"substr('{G.ALPHABET}', ({' + '.join(f'{bit(5 * c + b)} * {1 << (4 - b)}' for b in range(5))} + 1)::INTEGER, 1)" for c in range(size))


@query(f"WITH {X.GAZ} SELECT place_id, {_geohash_sql('lat', 'lon', 6)} AS geohash FROM gaz")
def geohash_encode(spark: SparkSession, d: str) -> DataFrame:
    return X.gazetteer(spark, d).select("place_id", G.geohash(F.col("lat"), F.col("lon")).alias("geohash"))


@query(f"WITH {X.GAZ} SELECT {_geohash_sql('lat', 'lon', 3)} AS cell, count(DISTINCT phrase) AS names, sum(length(phrase))::BIGINT AS chars FROM gaz GROUP BY 1")
def geohash_buckets(spark: SparkSession, d: str) -> DataFrame:
    return X.gazetteer(spark, d).groupBy(G.geohash(F.col("lat"), F.col("lon"), 3).alias("cell")).agg(F.countDistinct("phrase").alias("names"), F.sum(F.length("phrase")).alias("chars"))


@query(f"WITH {X.GAZ} SELECT cc, feat_class, count(*) AS names, count(DISTINCT place_id) AS places, count(DISTINCT (lat, lon)) AS points FROM gaz GROUP BY cc, feat_class")
def gaz_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.gazetteer(spark, d).groupBy("cc", "feat_class").agg(F.count(F.lit(1)).alias("names"), F.countDistinct("place_id").alias("places"), F.countDistinct("lat", "lon").alias("points"))


def _twice(spark: SparkSession, d: str) -> DataFrame:
    """The gazetteer as two sources have it; the second in upper case and with a shifted id."""
    g = X.gazetteer(spark, d).withColumn("id", F.xxhash64("place_id"))
    return g.withColumn("source", F.lit("X")).unionAll(g.withColumn("name", F.upper("name")).withColumn("id", F.col("id") + 1).withColumn("source", F.lit("N")))


@query(f"""WITH {X.GAZ}, two AS (SELECT *, 'X' AS source, name AS nm FROM gaz UNION ALL SELECT *, 'N', upper(name) FROM gaz),
r AS (SELECT *, row_number() OVER (PARTITION BY feat_class, cc, adm1, {_geohash_sql('lat', 'lon', 5)}, lower(nm) ORDER BY (source = 'N') DESC) > 1 AS duplicate FROM two)
SELECT source, cc, count(*) AS names, sum(duplicate::INT)::BIGINT AS duplicates FROM r GROUP BY source, cc""")
def gaz_dedup(spark: SparkSession, d: str) -> DataFrame:
    return etl.deduplicated(_twice(spark, d)).groupBy("source", "cc").agg(F.count(F.lit(1)).alias("names"), F.sum(F.col("duplicate").cast("int")).alias("duplicates"))


def _saintly(spark: SparkSession, d: str) -> DataFrame:
    k = F.substring("place_id", 2, 12).cast("long")
    before = F.element_at(F.array(*map(F.lit, ("Mount ", "Fort ", "Saint ", "San ", "Lake "))), (k % 5 + 1).cast("int"))
    return X.gazetteer(spark, d).where("feat_class = 'P'").withColumn("name", F.concat(before, "name"))


@query(f"""WITH {X.GAZ}, g AS (SELECT *, substr(place_id, 2)::BIGINT % 5 AS m FROM gaz WHERE feat_class = 'P')
SELECT place_id, (['Mt. ', 'Ft. ', 'St. ', 'S. '])[m + 1] || name AS name FROM g WHERE m < 4""")
def gaz_variants(spark: SparkSession, d: str) -> DataFrame:
    return etl.variants(_saintly(spark, d)).select("place_id", "name")


@query(f"WITH {X.GAZ} SELECT place_id, name FROM gaz WHERE NOT (feat_class = 'P' AND feat_code = 'PPL' AND lower(name) IN (SELECT 'customer ' || s_suppkey FROM supplier))")
def gaz_exclude(spark: SparkSession, d: str) -> DataFrame:
    rules_ = X.table(spark, d, "supplier").select(F.lit("P").alias("feat_class"), F.lit("PPL").alias("feat_code"), F.concat(F.lit("CUSTOMER "), F.col("s_suppkey").cast("string")).alias("name"))
    return etl.excluded(X.gazetteer(spark, d), rules_).select("place_id", "name")


@query("SELECT p_partkey, p_name, (lower(p_name) IN (SELECT lower(s_name) FROM supplier UNION SELECT lower(p_type) FROM part) OR length(p_name) <= 2) AS search_only FROM part")
def gaz_search_only(spark: SparkSession, d: str) -> DataFrame:
    part = X.table(spark, d, "part")
    names = part.select("p_partkey", F.col("p_name").alias("name"), F.lit("P").alias("feat_class"))
    flagged = etl.with_search_only(names, X.table(spark, d, "supplier").select(F.col("s_name").alias("term")).unionAll(part.select(F.col("p_type").alias("term"))))
    return flagged.select("p_partkey", F.col("name").alias("p_name"), "search_only")


@query(f"""WITH {X.GAZ}, lost AS (SELECT *, {_geohash_sql('lat', 'lon', 3)} AS gh FROM gaz),
known AS (SELECT *, {_geohash_sql('lat', 'lon', 3)} AS gh FROM gaz),
t AS (SELECT n, lower(name) AS k, cc, substr(gh, 1, n) AS p, min(place_id) AS id FROM known, (VALUES (3), (2), (1), (0)) v(n) GROUP BY ALL HAVING count(DISTINCT place_id) = 1)
SELECT l.place_id AS true_id, coalesce(t3.id, t2.id, t1.id, t0.id) AS place_id FROM lost l
LEFT JOIN t t3 ON t3.n = 3 AND t3.k = lower(l.name) AND t3.cc = l.cc AND t3.p = l.gh LEFT JOIN t t2 ON t2.n = 2 AND t2.k = lower(l.name) AND t2.cc = l.cc AND t2.p = l.gh[1:2]
LEFT JOIN t t1 ON t1.n = 1 AND t1.k = lower(l.name) AND t1.cc = l.cc AND t1.p = l.gh[1:1] LEFT JOIN t t0 ON t0.n = 0 AND t0.k = lower(l.name) AND t0.cc = l.cc AND t0.p = ''""")
def place_id_repair(spark: SparkSession, d: str) -> DataFrame:
    gaz = X.gazetteer(spark, d)
    """Every id is taken away and looked up again."""
    gone = gaz.withColumn("true_id", F.col("place_id")).withColumn("place_id", F.lit(None).cast("string"))
    return etl.repaired_ids(gone, gaz).select("true_id", "place_id")


@query("SELECT o_orderkey AS place_id, CASE WHEN o_orderkey % 7 = 0 THEN 'R0' ELSE cc END AS cc, CASE WHEN cc = 'R0' THEN '01' ELSE '0' END AS adm1 FROM orders, (VALUES ('R0'), ('R1')) v(cc) WHERE NOT (o_orderkey % 7 = 0 AND cc = 'R1')")
def nga_countries(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two countries, every seventh a river."""
    rows = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("place_id"), F.lit("name").alias("name"), F.lit("R0,R1").alias("cc"), F.lit("01").alias("adm1"), F.when(F.col("o_orderkey") % 7 == 0, "H").otherwise("P").alias("feat_class"), F.lit("X").alias("feat_code"))
    return etl.nga(rows).select("place_id", "cc", "adm1")


@query(f"WITH {X.GAZ} SELECT place_id, name_bias::INTEGER AS name_bias FROM (SELECT place_id, CASE WHEN lower(name) IN (SELECT lower(name) FROM gaz WHERE regexp_matches(feat_code, '^(ADM1|PPLC|PCL)') AND name NOT LIKE '% %') THEN 50 ELSE 7 END AS name_bias FROM gaz)")
def gaz_bias(spark: SparkSession, d: str) -> DataFrame:
    return etl.with_adjusted_bias(X.gazetteer(spark, d).withColumn("name_bias", F.lit(7))).select("place_id", "name_bias")


@query("SELECT 'R' || n_regionkey AS cc, n_nationkey AS place_id, max(CASE WHEN std = 'FIPS' THEN code END) AS fips, max(CASE WHEN std = 'ISO' THEN code END) AS iso FROM (SELECT *, 'FIPS' AS std, lpad(n_nationkey::VARCHAR, 2, '0') AS code FROM nation UNION ALL SELECT *, 'ISO', n_name FROM nation WHERE n_nationkey % 2 = 0) GROUP BY ALL")
def adm1_map(spark: SparkSession, d: str) -> DataFrame:
    n = X.table(spark, d, "nation")
    k = F.col("n_nationkey")
    base = n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("cc"), k.alias("place_id"), F.lpad(k.cast("string"), 2, "0").alias("adm1"), F.lit("FIPS").alias("standard"))
    iso = n.where(k % 2 == 0).select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("cc"), k.alias("place_id"), F.col("n_name").alias("adm1"), F.lit("ISO").alias("standard"))
    return etl.adm1_map(base.unionAll(iso))


@query("SELECT n_nationkey AS id, 'nationality.' || n_name AS taxnode, 'cc+' || upper(c) AS tag FROM nation, (VALUES ('r0'), ('r1')) v(c)")
def nationality_taxons(spark: SparkSession, d: str) -> DataFrame:
    n = X.table(spark, d, "nation").select(F.col("n_name").alias("nationality"), F.lit("r0; r1").alias("countries"))
    out = etl.nationalities(n).join(X.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")), "name")
    return out.select("id", "taxnode", F.col("tags")[0].alias("tag"))


@query(f"WITH {X.GAZ} SELECT p.c_custkey AS id, g.place_id, g.name FROM customer p JOIN gaz g ON g.phrase = 'customer ' || p.c_custkey WHERE length(g.name) - length('customer ' || p.c_custkey) <= 2")
def gaz_lookup_name(spark: SparkSession, d: str) -> DataFrame:
    names = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("CUSTOMER  "), F.col("c_custkey").cast("string")).alias("query"))
    return lookup.by_name(X.gazetteer(spark, d), names, 2).select("id", "place_id", "name")


@query(f"WITH {X.GAZ} SELECT c_custkey AS id, place_id, gaz.cc, gaz.adm1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN gaz ON phrase = 'customer ' || c_custkey")
def lookup_city_prov_cc(spark: SparkSession, d: str) -> DataFrame:
    n = X.nations(spark, d)
    q = X.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nk")).join(n, "nk").select(F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(", "), "adm1_name", F.lit(", "), "cc").alias("query"))
    out = lookup.city_province_country(q, X.gazetteer(spark, d))
    return out.select(F.regexp_extract("query", r"Customer (\d+)", 1).cast("long").alias("id"), "place_id", "cc", "adm1")


@query(f"WITH {X.GAZ} SELECT c_custkey AS id, coalesce(name, 'UNK') AS country FROM customer LEFT JOIN gaz ON feat_code = 'PCLI' AND cc = 'R' || (c_custkey % 7)")
def country_by_code(spark: SparkSession, d: str) -> DataFrame:
    ids = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("R"), (F.col("c_custkey") % 7).cast("string")).alias("cc"))
    return lookup.country(ids, X.gazetteer(spark, d).where("feat_code = 'PCLI'")).select("id", "country")


_POINTS = "pts AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 170 - 85 + 0.07)::DOUBLE AS p_lat, (c_custkey * 53 % 350 - 175 + 0.05)::DOUBLE AS p_lon FROM customer)"
_KM = f"2 * {G.EARTH_KM} * asin(least(sqrt(pow(sin(radians(lat - p_lat) / 2), 2) + cos(radians(p_lat)) * cos(radians(lat)) * pow(sin(radians(lon - p_lon) / 2), 2)), 1.0))"


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return X.table(spark, d, "customer").select(k.alias("point_id"), ((k * 37 % 170 - 85) + 0.07).cast("double").alias("p_lat"), ((k * 53 % 350 - 175) + 0.05).cast("double").alias("p_lon"))


def _near_sql(radius: float) -> str:
    box = radius / G.KM_PER_DEGREE * 1.01
    return f"{_POINTS}, near AS (SELECT * FROM (SELECT *, {_KM} AS km FROM pts JOIN gaz ON lat BETWEEN p_lat - {box} AND p_lat + {box}) WHERE km <= {radius})"


@query(f"WITH {X.GAZ}, {_near_sql(120)}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id) AS rank FROM near) SELECT point_id, rank::INTEGER AS rank, place_id, round(km, 6) AS km FROM r WHERE rank <= 25")
def radius_top25(spark: SparkSession, d: str) -> DataFrame:
    return lookup.nearest(_points(spark, d), X.gazetteer(spark, d), 120.0).select("point_id", "rank", "place_id", F.round("km", 6).alias("km"))


@query(f"""WITH {X.GAZ}, {_near_sql(100)}, t AS (SELECT *, CASE WHEN km <= 5 THEN 5 WHEN km <= 10 THEN 10 WHEN km <= 30 THEN 30 WHEN km <= 50 THEN 50 ELSE 100 END AS tier, CASE feat_class WHEN 'P' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS pr FROM near)
SELECT point_id, tier, place_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY tier, pr, km, place_id) AS n FROM t) WHERE n = 1""")
def radius_expanding(spark: SparkSession, d: str) -> DataFrame:
    return lookup.expanding(_points(spark, d), X.gazetteer(spark, d)).select("point_id", "tier", "place_id", F.round("km", 6).alias("km"))


@query(f"""WITH {X.GAZ}, {_near_sql(50)}, o AS (SELECT *, CASE WHEN feat_class = 'P' AND km <= 25 THEN 0 ELSE 1 END AS m FROM near)
SELECT point_id, CASE m WHEN 0 THEN 'city' ELSE 'province' END AS method, place_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY m, km, place_id) AS n FROM o) WHERE n = 1""")
def revgeo_tiers(spark: SparkSession, d: str) -> DataFrame:
    return lookup.reverse_geocode(_points(spark, d), X.gazetteer(spark, d)).select("point_id", "method", "place_id", F.round("km", 6).alias("km"))


# rules
_CAND = rf"""{X.GAZ}, {X.TEXTS}, {X.tags_sql('text_fx', 'gaz', 2)},
cand AS (SELECT t.doc_id, t.start, t."end", substr(d.text, t.start + 1, t."end" - t.start) AS text, g.* FROM tags t JOIN gaz g USING (phrase) JOIN text_fx d USING (doc_id))"""


def _cands(spark: SparkSession, d: str) -> DataFrame:
    """Worked out once, as rules read candidates several times."""
    return kept(geocoder.candidates(X.texts(spark, d), X.gazetteer(spark, d)), "candidates")


_SPAN = 'doc_id, start, "end"'


@query(f"""WITH {_CAND} SELECT {_SPAN}, place_id, round(0.5 * (length(text) - levenshtein(lower(text), lower(name)) + CASE WHEN (upper(text) = text) = (upper(name) = name) THEN 1 ELSE -1 END + 1) / length(text) + 0.1 * id_bias / 100, 6)::DOUBLE AS score FROM cand""")
def default_score(spark: SparkSession, d: str) -> DataFrame:
    return rules.default_score(_cands(spark, d)).select(*rules.KEY, F.round("score", 6).alias("score"))


@query(f"WITH {_CAND}, n AS (SELECT doc_id, cc, count(DISTINCT start) + 1 AS mentions FROM cand WHERE feat_code LIKE 'PCL%' GROUP BY ALL) SELECT doc_id, cc, mentions, round(mentions / sum(mentions) OVER (PARTITION BY doc_id), 6)::DOUBLE AS ratio FROM n")
def country_context(spark: SparkSession, d: str) -> DataFrame:
    return rules.country_context(_cands(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {_CAND}, one AS (SELECT doc_id, start, phrase, min(cc || '.' || adm1) AS path FROM cand GROUP BY ALL HAVING count(DISTINCT cc || '.' || adm1) = 1)
SELECT doc_id, path, count(DISTINCT phrase) AS names FROM one GROUP BY ALL""")
def province_context(spark: SparkSession, d: str) -> DataFrame:
    return rules.province_context(_cands(spark, d))


_PAIRS = """sp1 AS (SELECT DISTINCT doc_id, start, "end" FROM cand), nx AS (SELECT *, lead(start) OVER w AS ns, lead("end") OVER w AS ne FROM sp1 WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
prs AS (SELECT l.doc_id, l.start, l."end", l.place_id, r.start AS n_start, r."end" AS n_end, r.place_id AS n_place_id FROM nx JOIN cand l ON l.doc_id = nx.doc_id AND l.start = nx.start AND l."end" = nx."end"
  JOIN cand r ON r.doc_id = nx.doc_id AND r.start = nx.ns AND r."end" = nx.ne
  WHERE nx.ns - nx."end" BETWEEN 0 AND 5 AND r.feat_class = 'A' AND l.cc = r.cc AND (r.feat_code = 'PCLI' OR l.adm1 = r.adm1) AND l.place_id <> r.place_id)"""


@query(f"WITH {_CAND}, {_PAIRS} SELECT * FROM prs")
def name_code_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rules.name_code_pairs(_cands(spark, d)).select(*rules.KEY, "n_start", "n_end", "n_place_id")


@query(rf"""WITH {_CAND}, sp2 AS (SELECT doc_id, t FROM (SELECT doc_id, regexp_extract(text, '[NS]\d+\.\d+, [EW]\d+\.\d+') AS t FROM text_fx)),
c AS (SELECT doc_id, regexp_extract(t, '[NS](\d+\.\d+)', 1)::DOUBLE * CASE WHEN t LIKE 'S%' THEN -1 ELSE 1 END AS p_lat, regexp_extract(t, '[EW](\d+\.\d+)', 1)::DOUBLE * CASE WHEN t LIKE '%W%' THEN -1 ELSE 1 END AS p_lon FROM sp2),
k AS (SELECT {_SPAN}, place_id, {_KM} AS km FROM cand JOIN c USING (doc_id)) SELECT {_SPAN}, place_id, round(5 * (10 - km) / 10, 6)::DOUBLE AS score FROM k WHERE km < 10""")
def coord_association(spark: SparkSession, d: str) -> DataFrame:
    return rules.coordinate_rule(_cands(spark, d), patterns.coordinates(X.texts(spark, d))).select(*rules.KEY, F.round("score", 6).alias("score"))


_PEOPLE = f"placed AS (SELECT place_id, {_geohash_sql('lat', 'lon', 5)} AS cell FROM gaz), people AS (SELECT cell, max(20000 + substr(place_id, 2)::BIGINT * 7919 % 900000) AS pop FROM placed GROUP BY cell)"


@query(f"WITH {_CAND}, {_PEOPLE} SELECT {_SPAN}, place_id, round(s + 2 + CASE WHEN EXISTS (SELECT 1 FROM cand c WHERE c.doc_id = x.doc_id AND c.feat_code LIKE 'PCL%' AND c.cc = x.cc) THEN 2 ELSE 0 END, 6)::DOUBLE AS score FROM (SELECT cand.*, CASE WHEN feat_code = 'PPLC' THEN 4 WHEN feat_code = 'ADM1' THEN 2 ELSE 0 END + CASE WHEN feat_class = 'P' AND pop > 50000 THEN ln(pop) - 10 ELSE 0 END AS s FROM cand JOIN placed USING (place_id) JOIN people USING (cell)) x WHERE s > 0")
def major_place(spark: SparkSession, d: str) -> DataFrame:
    cands = _cands(spark, d)
    stats = X.gazetteer(spark, d).select("lat", "lon", (20000 + F.substring("place_id", 2, 12).cast("long") * 7919 % 900000).alias("population"))
    found = rules.major_place_rule(cands, lookup.population_by_cell(stats), rules.country_context(cands))
    return found.where("rule = 'MajorPlace'").select(*rules.KEY, F.round("score", 6).alias("score"))


@query(f"""WITH {_CAND}, pl AS (SELECT place_id AS pid, {_geohash_sql('lat', 'lon', 4)} AS g4 FROM gaz), b AS (SELECT DISTINCT doc_id, start, "end", place_id, phrase, unnest(['3:' || substr(g4, 1, 3), '4:' || g4, 'adm:' || cc || '.' || adm1]) AS bucket FROM cand JOIN pl ON pid = place_id),
n AS (SELECT doc_id, bucket, count(DISTINCT phrase) AS n, sum(length(phrase)) AS chars FROM (SELECT DISTINCT doc_id, bucket, phrase FROM b) GROUP BY ALL HAVING count(DISTINCT phrase) >= 2)
SELECT {_SPAN}, place_id, round(max(CASE WHEN bucket LIKE 'adm:%' THEN 2 ELSE n END * (n / 2 + chars / 8) / 10), 6)::DOUBLE AS score FROM b JOIN n USING (doc_id, bucket) GROUP BY ALL""")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return rules.heat_map(_cands(spark, d)).select(*rules.KEY, F.round("score", 6).alias("score"))


@query(f"WITH {_CAND} SELECT {_SPAN}, place_id, CASE WHEN text = name THEN 1.5 ELSE 0.5 END::DOUBLE AS score FROM cand")
def name_rule(spark: SparkSession, d: str) -> DataFrame:
    return rules.name_rule(_cands(spark, d)).select(*rules.KEY, "score")


@query(f"""WITH {X.GAZ}, {X.TEXTS}, {X.tags_sql('text_fx', 'gaz', 2)}, a AS (SELECT * FROM tags WHERE phrase LIKE 'customer%'), b AS (SELECT t.*, substr(d.text, "end" + 1, 2) AS gap FROM tags t JOIN text_fx d USING (doc_id) WHERE phrase NOT LIKE 'customer%')
SELECT a.doc_id, a.start, a."end", b.start AS o_start, b."end" AS o_end, CASE WHEN b.start >= a.start - 3 AND b."end" <= a."end" + 30 THEN 'contains' END AS relation FROM (SELECT doc_id, start - 0 AS start, "end" + 10 AS "end" FROM a) a JOIN b USING (doc_id) WHERE a.start <= b.start AND a."end" >= b."end" """)
def entity_collision(spark: SparkSession, d: str) -> DataFrame:
    """Names of customers, widened by ten characters, against the names of provinces and countries."""
    cands = _cands(spark, d)
    wide = cands.where("feat_class = 'P'").select("doc_id", "start", (F.col("end") + 10).alias("end"), F.lit("x").alias("after")).distinct()
    return rules.relations(wide, cands.where("feat_class = 'A'").select("doc_id", "start", "end", "after").distinct()).where("relation = 'contains'")


_GOOD = f"""WITH {_CAND}, {_PAIRS}, best AS (SELECT DISTINCT c.doc_id, c.start, c."end", c.place_id FROM cand c)"""


@query(f"{_GOOD} SELECT doc_id, count(*) AS mentions, max(place_id) FILTER (WHERE place_id LIKE 'C%') AS place_id FROM best GROUP BY doc_id")
def choose_best(spark: SparkSession, d: str) -> DataFrame:
    """Names of the fixture have one place each, so the choice is known."""
    cands = _cands(spark, d)
    best = rules.chosen(rules.totals(cands, [rules.default_score(cands), rules.name_code_rule(cands), rules.name_rule(cands)]))
    return best.groupBy("doc_id").agg(F.count(F.lit(1)).alias("mentions"), F.max(F.when(F.col("place_id").startswith("C"), F.col("place_id"))).alias("place_id"))


@query(f"""WITH {_CAND} SELECT doc_id, 'Customer ' || o_custkey || ', ' || n_name AS text, 'C' || o_custkey AS place_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT DISTINCT doc_id FROM cand) ON doc_id = o_orderkey""")
def related_merge(spark: SparkSession, d: str) -> DataFrame:
    cands = _cands(spark, d)
    best = kept(rules.chosen(rules.totals(cands, [rules.default_score(cands), rules.name_code_rule(cands)])), "chosen")
    whole = rules.merged(best, rules.name_code_pairs(cands))
    return whole.where("place_id like 'C%'").select("doc_id", "text", "place_id")


# postal
@query(f"""WITH {X.GAZ}, {X.POSTAL} SELECT doc_id, text, 0 AS c_start, length(text)::INTEGER AS c_end, 'Customer ' || doc_id AS city, adm1_name AS admin FROM post_fx JOIN (SELECT c_custkey, adm1_name FROM customer JOIN nat ON c_nationkey = nk) ON c_custkey = doc_id""")
def postal_derive(spark: SparkSession, d: str) -> DataFrame:
    texts = X.postal_texts(spark, d)
    post = kept(postal.candidates(geocoder.candidates(texts, X.postal_gazetteer(spark, d), geocoder.Parameters(postal=True))), "postal")
    linked = postal.linked(kept(postal.pairs(post, kept(geocoder.candidates(texts, X.gazetteer(spark, d)), "candidates")), "pairs"))
    return linked.join(texts.select("doc_id", F.col("text").alias("t")), "doc_id").select("doc_id", F.substring("t", F.col("c_start") + 1, F.col("c_end") - F.col("c_start")).alias("text"), "c_start", "c_end", "city", "admin")


# social
_SCORES = f"""{X.PROFILES}, {X.COUNTRIES},
why AS (
  SELECT user_id, cc, 'tz' AS why, 3 AS s FROM prof JOIN cty ON lower(prof.tz) = cty.tz
  UNION ALL SELECT user_id, cc, 'utc', max(s) FROM (SELECT user_id, cc, 3 AS s FROM prof JOIN cty ON utc = utc_offset UNION ALL SELECT user_id, cc, 4 FROM prof JOIN cty ON dst = utc_offset) GROUP BY user_id, cc
  UNION ALL SELECT user_id, cc, 'lang', s FROM prof JOIN spoken USING (lang)
), scores AS (SELECT user_id, cc, sum(s)::INTEGER AS score FROM why GROUP BY ALL)"""


@query(f"WITH {_SCORES} SELECT * FROM scores")
def profile_country_score(spark: SparkSession, d: str) -> DataFrame:
    return social.country_scores(X.profiles(spark, d), X.countries(spark, d))


@query(f"WITH {_SCORES} SELECT user_id, cc, score, (25 + score)::INTEGER AS confidence FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score DESC) AS r FROM scores) WHERE r = 1")
def profile_best_country(spark: SparkSession, d: str) -> DataFrame:
    return social.best_countries(social.country_scores(X.profiles(spark, d), X.countries(spark, d)))


@query(f"WITH {X.GAZ}, {X.PROFILES} SELECT user_id, CASE user_id % 4 WHEN 0 THEN CASE WHEN gaz.place_id IS NULL THEN 'timezone' ELSE 'place' END WHEN 1 THEN 'country' WHEN 2 THEN 'coordinate' ELSE 'timezone' END AS method FROM prof LEFT JOIN gaz ON phrase = lower(location)")
def profile_located(spark: SparkSession, d: str) -> DataFrame:
    gaz = X.gazetteer(spark, d)
    names = gaz.where("feat_code = 'PCLI'").select("phrase", "cc")
    return social.located(X.profiles(spark, d), gaz, X.countries(spark, d), names).select("user_id", "method")


# sinks and sources
@query(f"WITH {_DD} SELECT doc_id, 'coord' AS type, start AS \"offset\", (\"end\" - start)::INTEGER AS length, text AS matchtext, round(lat, 6) AS lat, round(lon, 6) AS lon FROM dd WHERE lat <> 0 OR lon <> 0")
def annotations_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates to JSON and back."""
    found = patterns.reduced(patterns.coordinates(X.texts(spark, d))).where("not is_duplicate and not is_submatch").withColumn("type", F.lit("coord"))
    back = sinks.parsed(sinks.annotations(found)).where("lat is not null")
    return back.select("doc_id", "type", "offset", "length", "matchtext", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"WITH {X.GAZ} SELECT place_id, 'POINT (' || lon || ' ' || lat || ')' AS wkt FROM gaz")
def wkt_points(spark: SparkSession, d: str) -> DataFrame:
    return X.gazetteer(spark, d).select("place_id", sinks.wkt(F.col("lat"), F.col("lon")).alias("wkt"))


@query(f"WITH {X.GAZ}, p AS (SELECT cc, adm1, min(name) AS adm1_name FROM gaz WHERE feat_code = 'ADM1' GROUP BY ALL), c AS (SELECT cc, min(name) AS country FROM gaz WHERE feat_code = 'PCLI' GROUP BY ALL) SELECT place_id, name, cc, country, adm1, adm1_name FROM gaz LEFT JOIN p USING (cc, adm1) LEFT JOIN c USING (cc)")
def gaz_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.exported(X.gazetteer(spark, d)).select("place_id", "name", "cc", "country", "adm1", "adm1_name")


@query(r"""SELECT page_id AS doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.pages(X.table(spark, d, "pages"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import stream  # noqa: PLC0415

    out = stream.hourly(X.table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {X.GAZ} SELECT place_id, CASE WHEN feat_code IN ('PCLI', 'ADM1') THEN 16 WHEN feat_code = 'PPLC' THEN 15 ELSE 10 END AS weight, cc || '.' || adm1 AS path FROM gaz")
def feature_weights(spark: SparkSession, d: str) -> DataFrame:
    return X.gazetteer(spark, d).select("place_id", C.feature_weight(F.col("feat_class"), F.col("feat_code")).alias("weight"), C.path(F.col("cc"), F.col("adm1")).alias("path"))
