"""Curation of gazetteers and lexicons: repair, variants, de-duplication, exclusion, recoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geo as G
from ..functions import text as T
from . import filters

BASE_SOURCES = ("N", "U", "G")
GENERAL = (("Mount ", "Mt. "), ("Fort ", "Ft. "), ("North ", "N. "), ("South ", "S. "), ("East ", "E. "), ("West ", "W. "))
SAINTS = (("Saint ", "St. "), ("Sainte ", "Ste. "), ("Santa ", "Sta. "), ("Santo ", "Sto. "), ("San ", "S. "))
#: Where 'San' isn't a saint.
NO_SAN = ("CN", "TW", "KR", "MM", "JP")
#: FIPS numbers of the states, in order; the numbers that no state has are left out.
_STATES = "AL AK - AZ AR CA - CO CT DE DC FL GA - HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA - RI SC SD TN TX UT VT VA - WA WV WI WY".split()
US_ADM1 = {f"{i:02d}": c for i, c in enumerate(_STATES, 1) if c != "-"}
TERRITORIES = {"AS": "AS", "GU": "GU", "MP": "MP", "PR": "PR", "VI": "VI", "UM": "UM"}


def repaired_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows without a place_id get the only id known for their name and country near them: in the same geohash cell of three, two, one, then no characters.

    One aggregate gives, for every (name, country, prefix), its id if it is the only one; four equi-joins try them.
    """
    sizes = (3, 2, 1, 0)
    prefixes = F.array(*[F.struct(F.lit(n).alias("n"), F.substring(F.col("gh"), 1, n).alias("prefix")) for n in sizes])
    key = lambda df: df.withColumn("k", F.lower(T.fold(F.col("name")))).withColumn("gh", G.geohash(F.col("lat"), F.col("lon"), 3))
    ids = key(known.where("place_id is not null")).select("k", "cc", "place_id", F.explode(prefixes).alias("p"))
    only = ids.groupBy("k", "cc", F.col("p.n").alias("n"), F.col("p.prefix").alias("prefix")).agg(F.min("place_id").alias("a"), F.max("place_id").alias("b")).where("a = b").drop("b")
    out = key(rows)
    for n in sizes:
        tier = only.where(F.col("n") == n).select("k", "cc", F.col("prefix").alias("q"), F.col("a").alias(f"t{n}"))
        out = out.withColumn("q", F.substring("gh", 1, n)).join(tier, ["k", "cc", "q"], "left").drop("q")
    return out.withColumn("place_id", F.coalesce("place_id", *[f"t{n}" for n in sizes])).select(*rows.columns)


def deduplicated(gaz: DataFrame, base: tuple[str, ...] = BASE_SOURCES) -> DataFrame:
    """gaz with duplicate: not the first of its class, country, province, cell and name; base sources come first."""
    order = Window.partitionBy("feat_class", "cc", "adm1", G.geohash(F.col("lat"), F.col("lon"), 5), F.lower("name")).orderBy(F.desc(F.col("source").isin(*base)), "id")
    return gaz.withColumn("duplicate", F.row_number().over(order) > 1)


def variants(gaz: DataFrame) -> DataFrame:
    """New rows only: general and saint abbreviations of names, longer than their prefix by three letters at least, that the gazetteer doesn't have for the place."""
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (*GENERAL, *SAINTS)])
    each = gaz.where((F.col("name_type") == "N") & T.is_ascii(F.col("name"))).withColumn("v", F.explode(F.filter(table, lambda v: F.col("name").startswith(v.a))))
    each = each.where((F.length("name") - F.length("v.a") >= 3) & ~((F.col("v.a") == "San ") & F.col("cc").isin(*NO_SAN)))
    made = each.withColumn("name", F.concat("v.b", F.expr("substring(name, length(v.a) + 1)"))).drop("v").dropDuplicates(["place_id", "name"])
    return made.join(gaz.select("place_id", "name"), ["place_id", "name"], "left_anti").select(*gaz.columns)


def excluded(gaz: DataFrame, rules: DataFrame) -> DataFrame:
    """Without rows that a rule (feat_class, feat_code, name) names; names compare without case."""
    r = rules.select(F.col("feat_class"), F.col("feat_code"), F.lower("name").alias("__n")).distinct()
    return gaz.withColumn("__n", F.lower("name")).join(r, ["feat_class", "feat_code", "__n"], "left_anti").select(*gaz.columns)


def with_search_only(gaz: DataFrame, stop_terms: DataFrame) -> DataFrame:
    """gaz with search_only: by the name's form, or as a stop term, or a stop term of under 15 characters without its diacritics."""
    terms = stop_terms.select(F.lower("term").alias("__t")).distinct()
    low, plain = F.lower("name"), F.when(F.length("name") < 15, F.lower(T.fold(F.col("name"))))
    hit = lambda df, k, flag: df.withColumn("__t", k).join(terms.withColumn(flag, F.lit(True)), "__t", "left").drop("__t")
    out = hit(hit(gaz, low, "__a"), plain, "__b")
    return out.withColumn("search_only", F.coalesce("__a", "__b", F.lit(False)) | filters.search_only(F.col("name"), F.col("feat_class"))).select(*gaz.columns, "search_only")


def name_bias(name: Column, feat_class: Column, feat_code: Column, frequency: Column) -> Column:
    """Own contract, -100 to 100: common words count against a name, several words, length and standing for it."""
    common = -F.least(F.log10(F.coalesce(frequency, F.lit(0)) + 1) * 15, F.lit(90.0))
    words = F.least((T.count_spaces(name) * 10).cast("double"), F.lit(30.0))
    standing = F.when(C.is_upper_admin(feat_class, feat_code) | C.is_capital(feat_code), 30.0).when(feat_class == "P", 10.0).otherwise(0.0)
    return F.round(F.greatest(F.least(common + words + F.least(F.length(name), F.lit(20)) + standing, F.lit(100.0)), F.lit(-100.0))).cast("int")


def id_bias(feat_class: Column, feat_code: Column) -> Column:
    return C.feature_weight(feat_class, feat_code) * 5


def with_adjusted_bias(gaz: DataFrame, bias: int = 50) -> DataFrame:
    """Single-word names of provinces, capitals and countries, and the same names without diacritics, get at least this bias wherever they occur."""
    major = gaz.where(F.col("feat_code").rlike("^(ADM1|PPLC|PCL)") & (F.col("name_type") == "N") & ~F.col("name").contains(" "))
    names = major.select(F.explode(F.array(F.lower("name"), F.lower(T.fold(F.col("name"))))).alias("__n")).distinct().withColumn("__m", F.lit(True))
    out = gaz.withColumn("__n", F.lower("name")).join(names, "__n", "left")
    return out.withColumn("name_bias", F.when(F.col("__m"), F.greatest("name_bias", F.lit(bias))).otherwise(F.col("name_bias"))).select(*gaz.columns)


def us_adm1(adm1: Column) -> Column:
    """Numeric codes of states to postal ones; others as they are."""
    table = F.create_map(*[F.lit(x) for kv in US_ADM1.items() for x in kv])
    return F.coalesce(F.try_element_at(table, adm1), adm1)


def adm1_map(rows: DataFrame) -> DataFrame:
    """(cc, place_id, fips, iso): the codes of a province in both standards, side by side. rows: cc, place_id, adm1, standard."""
    pick = lambda s: F.min(F.when(F.col("standard") == s, F.col("adm1")))
    return rows.groupBy("cc", "place_id").agg(pick("FIPS").alias("fips"), pick("ISO").alias("iso"))


def usgs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """National file rows (feature_id, feature_name, feature_class, state_alpha, lat, lon) as gazetteer rows; territories get their country code, notes in parentheses go.

    classes: usgs_class, feat_class, feat_code (readers.feature_map); rows of a class that isn't there are dropped.
    """
    table = classes.select(F.col("usgs_class").alias("feature_class"), F.struct(F.col("feat_class").alias("c"), F.col("feat_code").alias("d")).alias("mapped"))
    out = rows.join(table, "feature_class").where(~F.col("feature_name").rlike(r"(?i)\(historical\)"))
    mapped = F.col("mapped")
    land = F.col("state_alpha").isin(*TERRITORIES)
    return out.select(
        F.concat(F.lit("USGS"), F.col("feature_id").cast("string")).alias("place_id"), T.without_note(F.col("feature_name")).alias("name"), F.lit("N").alias("name_type"),
        F.when(land, F.col("state_alpha")).otherwise("US").alias("cc"), F.when(land, F.lit("0")).otherwise(F.col("state_alpha")).alias("adm1"),
        mapped["c"].alias("feat_class"), mapped["d"].alias("feat_code"), "lat", "lon", F.lit("U").alias("source"),
    )


def nga(rows: DataFrame) -> DataFrame:
    """Rows of several countries become one each, but for rivers, which keep the first; province codes are split alike, a missing one is 0. rows: place_id, name, cc ('A,B'), adm1 ('1,2'), feat_class, feat_code."""
    ccs, adms = F.split("cc", ","), F.split(F.coalesce("adm1", F.lit("")), ",")
    each = rows.select("*", F.posexplode(F.when(F.col("feat_class") == "H", F.slice(ccs, F.lit(1), F.lit(1))).otherwise(ccs)).alias("i", "one"))
    code = F.coalesce(F.nullif(F.try_element_at(adms, F.col("i") + 1), F.lit("")), F.lit("0"))
    return each.withColumns({"cc": F.col("one"), "adm1": code}).select(*rows.columns)


def name_type(name: Column, kind: Column) -> Column:
    """N, A (abbreviation) or C (code)."""
    return F.when(kind.isin("code", "postal"), "C").when(name.rlike(r"\p{L}\.") & (F.length(name) <= 8), "A").otherwise("N")


def name_group(name: Column) -> Column:
    return F.when(T.has_cjk(name), "cjk").when(T.has_middle_eastern(name), "ar").otherwise("")


def guessed_feature(name: Column, feat_class: Column) -> Column:
    """A class for rows without one, by the last word."""
    low = F.lower(name)
    return F.coalesce(F.nullif(feat_class, F.lit("")), F.when(low.rlike(r"(river|creek|lake|bay)$"), "H").when(low.rlike(r"(mount|mountain|hill|peak)$|^mount "), "T").when(low.rlike(r"(county|province|district|state)$"), "A").otherwise("P"))


def postal(rows: DataFrame, adm1s: DataFrame) -> DataFrame:
    """Postal rows (cc, code, adm1, lat, lon): provinces recoded by a map (cc, adm1, iso), one row for each cc/province/code, and a second one without blanks."""
    mapped = rows.join(adm1s.select("cc", "adm1", "iso"), ["cc", "adm1"], "left").withColumn("adm1", F.coalesce("iso", "adm1"))
    one = mapped.withColumn("place_id", F.concat_ws("/", "cc", "adm1", "code")).groupBy("place_id", "cc", "adm1", "code").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    forms = F.array_distinct(F.array("code", F.regexp_replace("code", r"\s", "")))
    return one.withColumn("name", F.explode(forms)).select("place_id", "name", F.lit("C").alias("name_type"), "cc", "adm1", F.lit("A").alias("feat_class"), F.lit("POST").alias("feat_code"), "lat", "lon")


def postal_context(gaz: DataFrame) -> DataFrame:
    """What the postal set takes from the gazetteer: province names and codes, and short ASCII names of countries."""
    land = F.col("feat_code").startswith("PCL") & T.is_ascii(F.col("name")) & (F.length("name") <= 30)
    return gaz.where(C.is_admin1(F.col("feat_class"), F.col("feat_code")) | land)


def averaged_parents(rows: DataFrame) -> DataFrame:
    """Districts from their parts: the mean point. rows: cc, adm1, adm2, lat, lon."""
    return rows.groupBy("cc", "adm1", "adm2").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def person_names(names: DataFrame, census: DataFrame, places: DataFrame, top: int = 1500) -> DataFrame:
    """(name): given names and the most frequent family names, without those that are places of standing. census: name, n; the limit is the feature."""
    frequent = census.orderBy(F.desc("n"), "name").limit(top).select(F.lower("name").alias("name"))
    return names.select(F.lower("name").alias("name")).unionAll(frequent).distinct().join(places.select(F.lower("name").alias("name")).distinct(), "name", "left_anti")


def entity_names(rows: DataFrame) -> DataFrame:
    """Primary name of each entity (universal language first, then by language and name) and its variants numbered. rows: entity_id, kind, lang ('u' universal), name."""
    order = Window.partitionBy("entity_id").orderBy(F.desc(F.col("lang") == "u"), "lang", "name")
    good = rows.where(filters.jrc_valid(F.col("name")))
    return good.withColumn("variant", F.row_number().over(order) - 1).withColumn("primary_name", F.first("name").over(order)).withColumn("kind", retyped(F.col("kind"), F.col("primary_name")))


def retyped(kind: Column, name: Column) -> Column:
    """Entities whose first or last word shows another type."""
    words = F.split(F.lower(name), " ")
    last, first = F.element_at(words, -1), F.element_at(words, 1)
    return F.when(last.isin("university", "bank", "inc", "corp", "party", "ministry") | first.isin("ministry", "university", "bank"), "org").when(last.isin("river", "city", "province", "island"), "place").otherwise(kind)


def nationalities(rows: DataFrame) -> DataFrame:
    """(phrase source 'name', taxnode, tags): one row for each country of a ';' list, tagged cc+XX. rows: nationality, countries."""
    each = rows.select("nationality", F.explode(T.string_list(F.col("countries"), ";")).alias("cc"))
    return each.select(F.col("nationality").alias("name"), F.concat(F.lit("nationality."), "nationality").alias("taxnode"), F.array(F.concat(F.lit("cc+"), F.upper("cc"))).alias("tags"))


def organisations(rows: DataFrame) -> DataFrame:
    """(name, taxnode, acronym, valid): names, aliases and acronyms in parentheses of organisations. rows: name, aliases (array)."""
    base = F.trim(F.regexp_replace("name", r"\s*\([^)]*\)", ""))
    forms = F.array_distinct(F.array_compact(F.concat(F.array(base, T.acronym_of(F.col("name"))), F.coalesce("aliases", F.array().cast("array<string>")))))
    each = rows.select(F.concat(F.lit("org."), base).alias("taxnode"), F.explode(forms).alias("name")).distinct()
    return each.select("name", "taxnode", filters.is_acronym(F.col("name")).alias("acronym"), filters.factbook_valid(F.col("name")).alias("valid"))


def reindexed(gaz: DataFrame, keep: str | None = None, omit: str | None = None) -> DataFrame:
    """Rows that an SQL predicate keeps or another omits; a predicate that is null neither keeps nor omits."""
    out = gaz.where(keep) if keep else gaz
    return out.where(~F.coalesce(F.expr(omit), F.lit(False))) if omit else out
