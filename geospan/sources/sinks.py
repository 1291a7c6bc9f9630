"""Outputs: annotations as JSON and back, GIS texts, tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import filters, lookup

LOW_CONFIDENCE = 10
KINDS = ("place", "coord", "country", "person", "org", "taxon", "date", "postal")
ANNOTATION = "matchtext string, offset int, length int, type string, filtered boolean, confidence int, name string, place_id string, cc string, adm1 string, feat_class string, feat_code string, lat double, lon double, prec double, date_norm string, rules array<string>, related map<string,string>"
_PLAIN = {"kml": ("&", "&amp;"), "lt": ("<", "&lt;"), "gt": (">", "&gt;")}


def _field(df: DataFrame, name: str) -> Column:
    kind = next(x for x in ANNOTATION.split(", ") if x.split(" ")[0] == name).split(" ")[1]
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def annotations(matches: DataFrame, kinds: tuple[str, ...] = KINDS, min_len: int = 0, related_derived_only: bool = True) -> DataFrame:
    """(doc_id, json) for matches (doc_id, start, end, text, type, ...): null fields are left out; confidence of 10 and below is marked filtered.

    Coordinates appear only if valid and not 0, 0. `related` only on postal matches that are derived (unless asked for on all).
    """
    ok = G.is_coord(F.col("lat"), F.col("lon")) & ~G.is_zero(F.col("lat"), F.col("lon")) if {"lat", "lon"} <= set(matches.columns) else F.lit(False)
    low = F.coalesce(_field(matches, "confidence") <= LOW_CONFIDENCE, F.lit(False))
    shown = F.col("derived") if "derived" in matches.columns and related_derived_only else F.lit(not related_derived_only)
    names = [x.split(" ")[0] for x in ANNOTATION.split(", ")]
    special = {
        "matchtext": F.col("text"), "offset": F.col("start"), "length": F.col("end") - F.col("start"), "filtered": low | F.coalesce(_field(matches, "filtered"), F.lit(False)),
        "lat": F.when(ok, _field(matches, "lat")), "lon": F.when(ok, _field(matches, "lon")), "related": F.when(shown, _field(matches, "related")),
    }
    parts = [special.get(n, _field(matches, n)).alias(n) for n in names]
    return matches.where(F.col("type").isin(*kinds) & (F.length("text") >= min_len)).select("doc_id", F.to_json(F.struct(*parts)).alias("json"))


def parsed(rows: DataFrame) -> DataFrame:
    """Annotations back from JSON; an unknown type raises."""
    out = rows.select("doc_id", F.from_json("json", ANNOTATION).alias("a")).select("doc_id", "a.*")
    known = F.when(F.col("type").isin(*KINDS), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown annotation type: "), F.coalesce("type", F.lit("null")))).cast("string"))
    return out.withColumn("type", known)


def geocoding(places: DataFrame) -> DataFrame:
    """(place_id, json): the place alone, null fields and invalid coordinates left out."""
    ok = G.is_coord(F.col("lat"), F.col("lon")) & ~G.is_zero(F.col("lat"), F.col("lon"))
    parts = ["name", "cc", "adm1", "feat_class", "feat_code", F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lon")).alias("lon")]
    return places.select("place_id", F.to_json(F.struct(*parts)).alias("json"))


def social_lines(inferences: DataFrame) -> DataFrame:
    """(value): a JSON line for each inference about a message's author or text."""
    return inferences.select(F.to_json(F.struct(*inferences.columns)).alias("value"))


def wkt(lat: Column, lon: Column) -> Column:
    return F.when(G.is_coord(lat, lon), F.concat(F.lit("POINT ("), F.round(lon, 5).cast("string"), F.lit(" "), F.round(lat, 5).cast("string"), F.lit(")")))


def geojson(name: Column, lat: Column, lon: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(name.alias("name")).alias("properties")))


def kml(name: Column, lat: Column, lon: Column, style: Column | None = None) -> Column:
    """A placemark; the style, if given, tells the kind of inference."""
    for a, b in _PLAIN.values():
        name = F.replace(name, F.lit(a), F.lit(b))
    look = F.lit("") if style is None else F.concat(F.lit("<styleUrl>#"), style, F.lit("</styleUrl>"))
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name>"), look, F.lit("<Point><coordinates>"), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("</coordinates></Point></Placemark>"))


def write_gis(rows: DataFrame, path: str, form: str) -> None:
    """rows (text, lat, lon, ...) as csv, wkt, geojson or kml lines. ValueError for another form."""
    name, lat, lon = F.col("text"), F.col("lat"), F.col("lon")
    lines = {"wkt": wkt(lat, lon), "geojson": geojson(name, lat, lon), "kml": kml(name, lat, lon)}
    if form == "csv":
        rows.select(*[c for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))]).write.option("header", "true").csv(path)
    elif form in lines:
        rows.where(G.is_coord(lat, lon)).select(lines[form].alias("value")).write.text(path)
    else:
        raise ValueError(f"no such form: {form}")


def write_kept(matches: DataFrame, path: str) -> None:
    """What a batch job keeps: one match of each text in a document (the first), confident and precise enough."""
    kept(matches).write.parquet(path)


def kept(matches: DataFrame) -> DataFrame:
    good = matches.where(filters.output_kept(F.col("confidence"), F.col("prec") if "prec" in matches.columns else F.lit(None).cast("double")))
    first = good.groupBy("doc_id", "text").agg(F.min("start").alias("start"))
    return good.join(first, ["doc_id", "text", "start"], "left_semi")


def write_gazetteer(gaz: DataFrame, path: str) -> None:
    """Partitioned by country, rows of a country together, so that look-ups read one folder."""
    gaz.repartition("cc").sortWithinPartitions("cc", "phrase").write.partitionBy("cc").parquet(path)


def exported(gaz: DataFrame) -> DataFrame:
    """The gazetteer as a flat table with the names of provinces and countries."""
    named = lookup.province_names(gaz, gaz)
    land = gaz.where(F.col("feat_code") == "PCLI").groupBy("cc").agg(F.min("name").alias("country"))
    return named.join(land, "cc", "left").select("place_id", "name", "cc", "country", "adm1", "adm1_name", "feat_class", "feat_code", "lat", "lon")


def updated(gaz: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Rows that fulfil the condition with new values; a rewrite, as tables here don't change in place."""
    return gaz.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def deleted(gaz: DataFrame, ids: DataFrame) -> DataFrame:
    return gaz.join(ids.select("place_id").distinct(), "place_id", "left_anti")
