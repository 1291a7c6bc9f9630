"""Deterministic inputs derived from the driver's tables: a gazetteer, a lexicon, texts with places in them, postal codes, profiles.

Each has a Spark form and a SQL form (a common table expression) that say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tagger


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _point(k: Column) -> list[Column]:
    return [(k * 37 % 170 - 85).cast("double").alias("lat"), (k * 53 % 350 - 175).cast("double").alias("lon")]


def _adm(k: Column) -> Column:
    return F.lpad(k.cast("string"), 2, "0")


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("adm1_name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("cc"), _adm(F.col("n_nationkey")).alias("adm1"))


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    nation = nations(spark, d)
    k = F.col("k")
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    land = region.select(F.concat(F.lit("R"), k.cast("string")).alias("place_id"), F.col("r_name").alias("name"), F.concat(F.lit("R"), k.cast("string")).alias("cc"), F.lit("0").alias("adm1"), F.lit("A").alias("feat_class"), F.lit("PCLI").alias("feat_code"), *_point(k), F.lit(100).alias("id_bias"))
    n = nation.withColumn("k", F.col("nk").cast("long"))
    prov = n.select(F.concat(F.lit("N"), k.cast("string")).alias("place_id"), F.col("adm1_name").alias("name"), "cc", "adm1", F.lit("A").alias("feat_class"), F.lit("ADM1").alias("feat_code"), *_point(k), F.lit(65).alias("id_bias"))
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nk")).join(nation, "nk")
    seat = k % 10 == 0
    city = sup.select(F.concat(F.lit("S"), k.cast("string")).alias("place_id"), F.concat(F.lit("Supplier "), k.cast("string")).alias("name"), "cc", "adm1", F.lit("P").alias("feat_class"), F.when(seat, "PPLC").otherwise("PPL").alias("feat_code"), *_point(k), F.when(seat, 80).otherwise(45).alias("id_bias"))
    cus = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk")).join(nation, "nk")
    town = cus.select(F.concat(F.lit("C"), k.cast("string")).alias("place_id"), F.concat(F.lit("Customer "), k.cast("string")).alias("name"), "cc", "adm1", F.lit("P").alias("feat_class"), F.lit("PPL").alias("feat_code"), *_point(k), F.lit(45).alias("id_bias"))
    rows = land.unionAll(prov).unionAll(city).unionAll(town).withColumn("name_type", F.lit("N"))
    return rows.withColumn("phrase", T.norm(F.col("name")))


GAZ = r"""
nat AS (SELECT n_nationkey AS nk, n_name AS adm1_name, 'R' || n_regionkey AS cc, lpad(n_nationkey::VARCHAR, 2, '0') AS adm1 FROM nation),
raw_gaz AS (
  SELECT 'R' || r_regionkey AS place_id, r_name AS name, 'R' || r_regionkey AS cc, '0' AS adm1, 'A' AS feat_class, 'PCLI' AS feat_code, r_regionkey::BIGINT AS k, 100 AS id_bias FROM region
  UNION ALL SELECT 'N' || nk, adm1_name, cc, adm1, 'A', 'ADM1', nk::BIGINT, 65 FROM nat
  UNION ALL SELECT 'S' || s_suppkey, 'Supplier ' || s_suppkey, cc, adm1, 'P', CASE WHEN s_suppkey % 10 = 0 THEN 'PPLC' ELSE 'PPL' END, s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 80 ELSE 45 END FROM supplier JOIN nat ON s_nationkey = nk
  UNION ALL SELECT 'C' || c_custkey, 'Customer ' || c_custkey, cc, adm1, 'P', 'PPL', c_custkey, 45 FROM customer JOIN nat ON c_nationkey = nk
),
gaz AS (
  SELECT place_id, name, 'N' AS name_type, cc, adm1, feat_class, feat_code, (k * 37 % 170 - 85)::DOUBLE AS lat, (k * 53 % 350 - 175)::DOUBLE AS lon, id_bias::INTEGER AS id_bias,
    replace(lower(name), '_', ' ') AS phrase FROM raw_gaz
)"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    """One text for each order: 'Customer 899, NATION_19, EUROPE on 1998-10-03 at N12.30, E45.60'."""
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("rk"), "r_name")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), "n_name", F.col("n_regionkey").alias("rk")).join(region, "rk")
    cus = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nk")).join(nation, "nk")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c_custkey"), "o_orderdate").join(cus, "c_custkey")
    k = F.col("c_custkey")
    lat, lon = k * 37 % 170 - 85, k * 53 % 350 - 175
    mark = lambda v, neg, pos: F.concat(F.when(v < 0, neg).otherwise(pos), F.abs(v).cast("string"), F.lit(".0"), (k % 10).cast("string"))
    text = F.concat(F.lit("Customer "), k.cast("string"), F.lit(", "), "n_name", F.lit(", "), "r_name", F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at "), mark(lat, "S", "N"), F.lit(", "), mark(lon, "W", "E"))
    return rows.select("doc_id", text.alias("text"))


TEXTS = r"""
text_fx AS (
  SELECT o_orderkey AS doc_id, 'Customer ' || k || ', ' || n_name || ', ' || r_name || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || ' at '
    || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || abs(lat) || '.0' || (k % 10) || ', ' || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END || abs(lon) || '.0' || (k % 10) AS text
  FROM (SELECT *, c_custkey AS k, c_custkey * 37 % 170 - 85 AS lat, c_custkey * 53 % 350 - 175 AS lon FROM customer) c
  JOIN orders ON o_custkey = k JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def _runs(words: Column) -> Column:
    return T.let(words, lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.slice(w, i, F.lit(5)))))


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Every run of five words of each benchmark item."""
    words = F.explode(_runs(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))))
    rows = table(spark, d, "benchmark").select("item_id", words.alias("w")).withColumn("name", F.array_join("w", " ")).drop("w").distinct()
    rows = rows.select("name", F.concat(F.lit("org.bench."), F.col("item_id").cast("string")).alias("taxnode"), F.lit("bench").alias("catalog"), F.lit(False).alias("acronym"), F.lit(True).alias("valid"))
    return tagger.phrases(rows)


def fold_sql(x: str) -> str:
    out = f"translate({x}, '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    for a, b in T.PAIRS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


LEXICON = rf"""
dict AS (
  SELECT DISTINCT array_to_string(list_transform(w[i:i + 4], lambda x: lower({fold_sql('x')})), ' ') AS phrase, 'org.bench.' || item_id AS taxnode, 'bench' AS catalog
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w FROM benchmark))
)"""


def spans_sql(source: str, pattern: str, name: str = "sp") -> str:
    """(doc_id, i, t, s, e): matches with offsets, by running sums; doc_id is unique in the source."""
    return rf"""
{name} AS (
  SELECT doc_id, i, t, (c - length(t))::INTEGER AS s, c::INTEGER AS e FROM (
    SELECT doc_id, i, t, sum(length(t) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM (
      SELECT doc_id, unnest(m) AS t, unnest(g[1:len(m)]) AS g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {source} WHERE text IS NOT NULL)))
)"""


def tags_sql(source: str, dictionary: str, longest: int) -> str:
    """(doc_id, start, "end", phrase): all phrases of the dictionary in the source's texts."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, s, max(e) OVER w AS e, string_agg(f, ' ') OVER w AS phrase, count(*) OVER w AS n, {n} AS k FROM folded WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
        for n in range(1, longest + 1)
    )
    return rf"""{spans_sql(source, r'[\p{L}\p{N}]+', 'tok')},
folded AS (SELECT doc_id, i, s, e, lower({fold_sql('t')}) AS f FROM tok),
tags AS (SELECT DISTINCT doc_id, s AS start, e AS "end", phrase FROM ({each}) WHERE n = k AND phrase IN (SELECT phrase FROM {dictionary}))"""


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile for each user of events: a place, a country, coordinates or nothing as location, a zone, an offset and a language by the user's number."""
    u = F.col("user_id")
    zones = F.array(*map(F.lit, ("Zone/A", "Zone/B", "Zone/C", "Zone/D")))
    langs = F.array(*map(F.lit, ("en-US", "de", "fr", "es")))
    where = F.when(u % 4 == 0, F.concat(F.lit("Customer "), u.cast("string"))).when(u % 4 == 1, "EUROPE!").when(u % 4 == 2, F.concat((u % 60).cast("string"), F.lit(".25, "), (u % 100).cast("string"), F.lit(".50"))).otherwise("http://x")
    return table(spark, d, "events").select("user_id").distinct().select("user_id", where.alias("location"), F.element_at(zones, (u % 4 + 1).cast("int")).alias("tz"), (u % 12 - 6).cast("double").alias("utc_offset"), F.element_at(langs, (u % 4 + 1).cast("int")).alias("lang"))


PROFILES = """
prof AS (
  SELECT user_id, (['Zone/A', 'Zone/B', 'Zone/C', 'Zone/D'])[(user_id % 4 + 1)::INTEGER] AS tz, (user_id % 12 - 6)::DOUBLE AS utc_offset, (['en', 'de', 'fr', 'es'])[(user_id % 4 + 1)::INTEGER] AS lang,
    CASE user_id % 4 WHEN 0 THEN 'Customer ' || user_id WHEN 1 THEN 'EUROPE!' WHEN 2 THEN (user_id % 60) || '.25, ' || (user_id % 100) || '.50' ELSE 'http://x' END AS location
  FROM (SELECT DISTINCT user_id FROM events)
)"""


def countries(spark: SparkSession, d: str) -> DataFrame:
    """cc, timezones, langs of five countries."""
    rows = [("R0", "Zone/A", -6.0, -5.0, ["en", "fr"]), ("R1", "Zone/A", -5.0, None, ["es", "en"]), ("R2", "Zone/B", 1.0, 2.0, ["de"]), ("R3", "Zone/C", 0.0, 1.0, ["fr", "de", "en"]), ("R4", "Zone/D", 3.0, None, ["es"])]
    return spark.createDataFrame([(cc, [(tz, utc, dst)], langs) for cc, tz, utc, dst, langs in rows], "cc string, timezones array<struct<tz:string,utc:double,dst:double>>, langs array<string>")


COUNTRIES = """
cty(cc, tz, utc, dst) AS (VALUES ('R0', 'zone/a', -6.0, -5.0), ('R1', 'zone/a', -5.0, NULL), ('R2', 'zone/b', 1.0, 2.0), ('R3', 'zone/c', 0.0, 1.0), ('R4', 'zone/d', 3.0, NULL)),
spoken(cc, lang, s) AS (VALUES ('R0', 'en', 3), ('R0', 'fr', 2), ('R1', 'es', 3), ('R1', 'en', 2), ('R2', 'de', 3), ('R3', 'fr', 3), ('R3', 'de', 2), ('R3', 'en', 1), ('R4', 'es', 3))"""


def postal_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """A code of five digits, or more for large keys, for each customer, in its country and province."""
    n = nations(spark, d)
    cus = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk")).join(n, "nk")
    code = (F.col("k") + 10000).cast("string")
    rows = cus.select(F.concat_ws("/", "cc", "adm1", code).alias("place_id"), code.alias("name"), F.lit("C").alias("name_type"), "cc", "adm1", F.lit("A").alias("feat_class"), F.lit("POST").alias("feat_code"), *_point(F.col("k")), F.lit(0).alias("id_bias"))
    return tagger.phrases(rows)


def postal_texts(spark: SparkSession, d: str) -> DataFrame:
    """'Customer 12, NATION_3 10012' for each customer."""
    n = nations(spark, d)
    cus = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk")).join(n, "nk")
    return cus.select(F.col("k").alias("doc_id"), F.concat(F.lit("Customer "), F.col("k").cast("string"), F.lit(", "), "adm1_name", F.lit(" "), (F.col("k") + 10000).cast("string")).alias("text"))


POSTAL = """
post_fx AS (SELECT c_custkey AS doc_id, 'Customer ' || c_custkey || ', ' || adm1_name || ' ' || (c_custkey + 10000) AS text FROM customer JOIN nat ON c_nationkey = nk),
post AS (SELECT cc || '/' || adm1 || '/' || (c_custkey + 10000) AS place_id, (c_custkey + 10000)::VARCHAR AS phrase, cc, adm1 FROM customer JOIN nat ON c_nationkey = nk)"""
