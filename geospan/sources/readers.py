"""Readers: each makes a DataFrame with a fixed schema from one kind of file. Nothing infers a schema by reading data twice."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

DOCUMENT = "doc_id string, text string, lang string"
MESSAGE = "id string, text string, lang string, user_lang string, timezone string, utc_offset double, is_dst boolean, location string, created_at timestamp"
GAZETTEER = "place_id string, name string, name_type string, cc string, adm1 string, adm2 string, feat_class string, feat_code string, lat double, lon double, source string, name_bias int, id_bias int"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines: {id or docid, text, lang, ...} -> doc_id, text, lang. Also reads gzip."""
    rows = spark.read.schema("id string, docid string, text string, lang string").json(path)
    return rows.select(F.coalesce("docid", "id").alias("doc_id"), "text", "lang")


def sequence_documents(spark: SparkSession, path: str) -> DataFrame:
    """Hadoop sequence files of JSON texts {id, text}; the only reader that needs an RDD, as Spark SQL has no source for them."""
    rows = spark.sparkContext.sequenceFile(path).map(lambda kv: (kv[1],)).toDF("value string")
    return rows.select(F.from_json("value", "id string, text string, lang string").alias("d")).select(F.col("d.id").alias("doc_id"), "d.text", "d.lang")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a folder as a document, its path as the id; markup taken out of HTML."""
    raw = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
    return raw.withColumn("text", F.when(F.lower("doc_id").rlike(r"\.x?html?$"), T.html_text(F.col("text"))).otherwise(F.col("text")))


def pages(rows: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as documents."""
    return rows.select(F.col("page_id").alias("doc_id"), T.html_text(F.col("html")).alias("text"))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages as JSON lines with a user object."""
    user = "lang string, time_zone string, utc_offset double, location string"
    rows = spark.read.schema(f"id_str string, text string, lang string, created_at string, user struct<{user.replace(' string', ':string').replace(' double', ':double')}>").json(path)
    return rows.select(F.col("id_str").alias("id"), "text", "lang", F.col("user.lang").alias("user_lang"), F.col("user.time_zone").alias("timezone"), (F.col("user.utc_offset") / 3600).alias("utc_offset"), F.col("user.location").alias("location"), F.col("created_at").try_cast("timestamp").alias("created_at"))


def tsv_schema(doc: str) -> str:
    """A schema from documentation lines 'name : description, type'; integers and decimals are told by the description."""
    out = []
    for line in doc.splitlines():
        m = re.match(r"\s*([a-z_0-9 ]+?)\s*:\s*(.+)", line)
        if m:
            kind = "double" if re.search(r"latitude|longitude|decimal degrees", m[2]) else "long" if re.search(r"\bint", m[2]) else "string"
            out.append(f"{m[1].strip().replace(' ', '_')} {kind}")
    return ", ".join(out)


GEONAMES = "geonameid long, name string, asciiname string, alternatenames string, latitude double, longitude double, feature_class string, feature_code string, country_code string, cc2 string, admin1_code string, admin2_code string, admin3_code string, admin4_code string, population long, elevation string, dem string, timezone string, modification_date string"


def geonames(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated dump: a row for the name, the ASCII name and each alternate name of a place."""
    raw = spark.read.schema(GEONAMES).option("sep", "\t").option("quote", "").csv(path)
    names = F.array_distinct(F.array_compact(F.concat(F.array("name", "asciiname"), F.coalesce(T.string_list(F.col("alternatenames")), F.array().cast("array<string>")))))
    return raw.select(F.concat(F.lit("G"), F.col("geonameid").cast("string")).alias("place_id"), F.explode(names).alias("name"), F.col("country_code").alias("cc"), F.col("admin1_code").alias("adm1"), F.col("admin2_code").alias("adm2"), F.col("feature_class").alias("feat_class"), F.col("feature_code").alias("feat_code"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "population", F.lit("G").alias("source"))


def usgs(spark: SparkSession, path: str) -> DataFrame:
    """The pipe-separated national file, as etl.usgs() takes it."""
    raw = spark.read.option("sep", "|").option("header", "true").csv(path)
    c = {x.lower().lstrip("﻿"): x for x in raw.columns}
    return raw.select(F.col(c["feature_id"]).alias("feature_id"), F.col(c["feature_name"]).alias("feature_name"), F.col(c["feature_class"]).alias("feature_class"), F.col(c["state_alpha"]).alias("state_alpha"), F.col(c["prim_lat_dec"]).try_cast("double").alias("lat"), F.col(c["prim_long_dec"]).try_cast("double").alias("lon"))


def feature_map(spark: SparkSession, path: str) -> DataFrame:
    """(usgs_class, feat_class, feat_code) from a CSV with a header and those three columns."""
    raw = spark.read.schema("usgs_class string, feat_class string, feat_code string").option("header", "true").csv(path)
    return raw.where("usgs_class is not null and feat_code is not null").distinct()


def nga(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Country files in the older layout (FIPS codes, before 2022) or the newer (ISO codes)."""
    raw = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    names = ("UFI", "FULL_NAME_RO", "CC1", "ADM1", "FC", "DSG", "LAT", "LONG") if version < 2022 else ("ufi", "full_name", "cc_ft", "adm1", "fc", "desig_cd", "lat_dd", "long_dd")
    pid, name, cc, adm1, fc, code, lat, lon = (F.col(n) for n in names)
    return raw.select(F.concat(F.lit("N"), pid).alias("place_id"), name.alias("name"), cc.alias("cc"), adm1.alias("adm1"), fc.alias("feat_class"), code.alias("feat_code"), lat.try_cast("double").alias("lat"), lon.try_cast("double").alias("lon"))


def wide_names(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Attribute tables with a column name_<language> each: (keep, lang, name), values split at '|'."""
    cols = [c for c in rows.columns if c.startswith("name_")]
    long = rows.unpivot(list(keep), cols, "lang", "names") if cols else rows.select(*keep, F.lit("").alias("lang"), F.lit(None).cast("string").alias("names"))
    return long.select(*keep, F.substring("lang", 6, 20).alias("lang"), F.explode(T.string_list(F.col("names"), r"\|")).alias("name"))


POSTAL = "cc string, code string, place string, adm1_name string, adm1 string, adm2_name string, adm2 string, adm3_name string, adm3 string, lat double, lon double, accuracy int"


def postal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTAL).option("sep", "\t").option("quote", "").csv(path)


def adhoc_places(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", "true").option("comment", "#").csv(path)
    return raw.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon") if c in raw.columns})


def country_rows(rows: DataFrame) -> DataFrame:
    """Country metadata (cc, iso3, name, lat, lon): three rows each, the name and both codes."""
    forms = F.array(F.struct(F.col("name").alias("name"), F.lit("N").alias("t")), F.struct(F.col("cc").alias("name"), F.lit("C").alias("t")), F.struct(F.col("iso3").alias("name"), F.lit("C").alias("t")))
    return rows.select(F.concat(F.lit("ISO"), "cc").alias("place_id"), "cc", "lat", "lon", F.explode(forms).alias("f")).select("place_id", "f.name", F.col("f.t").alias("name_type"), "cc", F.lit("0").alias("adm1"), F.lit("A").alias("feat_class"), F.lit("PCLI").alias("feat_code"), "lat", "lon")


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(term): each as written and in lower case. Lines that begin with # are notes."""
    raw = spark.read.option("header", "true").option("comment", "#").csv(path)
    term = F.trim(F.col(raw.columns[0]))
    return raw.select(F.explode(F.array_distinct(F.array(term, F.lower(term)))).alias("term")).where("term <> ''").distinct()


def stop_words(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, term); what follows # or | is a note."""
    raw = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", r"[#|].*$", ""))).alias("term"))
    return raw.where("term <> ''").select(F.lit(lang).alias("lang"), "term").distinct()


def entity_lines(spark: SparkSession, path: str) -> DataFrame:
    """Names of entities in four fields between blanks: id, kind, language, name with + for a blank."""
    parts = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    kind = F.when(parts[1] == "P", "person").when(parts[1] == "O", "org").otherwise("other")
    return raw.select(parts[0].cast("long").alias("entity_id"), kind.alias("kind"), parts[2].alias("lang"), F.replace(parts[3], F.lit("+"), F.lit(" ")).alias("name"))


def nationalities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("nationality string, countries string").option("header", "true").csv(path)


def name_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and name not like '#%'").distinct()


def organisations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, aliases array<string>").json(path)


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """Yearly counts of words (word, year, n, volumes) summed up: (word, n)."""
    raw = spark.read.schema("word string, year int, n long, volumes long").option("sep", "\t").option("quote", "").csv(path)
    return raw.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))


def population(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, population) from the dump of cities."""
    raw = spark.read.schema(GEONAMES).option("sep", "\t").option("quote", "").csv(path)
    return raw.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "population")


def gazetteer(spark: SparkSession, path: str, cc: str | None = None, where: str | None = None) -> DataFrame:
    """A gazetteer written by sinks.gazetteer(); the country prunes partitions, other criteria are pushed down."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("cc") == cc) if cc else rows
    return rows.where(where) if where else rows


def list_places(gaz: DataFrame, cc: str | None = None, feat_class: str | None = None, criteria: str | None = None, limit: int | None = None) -> DataFrame:
    """Places by country, class and an SQL condition; the limit, if one is given, is the caller's."""
    for name, value in (("cc", cc), ("feat_class", feat_class)):
        gaz = gaz.where(F.col(name) == value) if value else gaz
    gaz = gaz.where(criteria) if criteria else gaz
    return gaz.limit(limit) if limit else gaz
