"""Feature codes, administrative codes, languages and country tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: language: countries where it is spoken, the main one first. Own short table; a caller may bring a full one.
SPOKEN = {"en": ["US", "GB"], "de": ["DE", "AT"], "fr": ["FR", "CA"], "es": ["ES", "MX"], "pt": ["PT", "BR"], "zh": ["CN", "TW"], "ja": ["JP"], "ko": ["KR"], "ar": ["SA", "EG"]}
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "pt": "Portuguese", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "ar": "Arabic"}
FIPS = {"GM": "DE", "SP": "ES", "UK": "GB", "CH": "CN", "JA": "JP", "KS": "KR", "SA": "SA", "AU": "AT", "EI": "IE", "SW": "SE"}
#: Weight of a feature by the longest prefix of class/code that is listed, of six, five or one characters.
FEATURE_WEIGHT = dict.fromkeys(("A/ADM1", "A/PCL"), 16) | {"A/ADM2": 13, "A": 11, "P/PPLC": 15, "P/PPLG": 9} | dict.fromkeys(("P", "P/PPL", "P/PPLA"), 10)
FEATURE_WEIGHT |= dict.fromkeys(("P/PPLH", "P/PPLL", "S"), 8) | dict.fromkeys(("P/PPLQ", "P/PPLX", "H", "V"), 7) | dict.fromkeys(("L", "R", "T/ISL", "T/ISLS"), 6) | dict.fromkeys(("U", "T"), 5) | dict.fromkeys(("H/RSV", "H/WLL", "H/SPNG"), 2)
#: Sites that are organisations too: hospitals, buildings, schools, places of worship.
SITE_CODES = tuple("BLDA BLDG BLDO CH HSP HSPC MSQE MSSN SCH SCHC SCHT SHRN TMPL UNIV".split())


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def feature_weight(feat_class: Column, feat_code: Column) -> Column:
    full = F.concat_ws("/", feat_class, feat_code)
    return F.coalesce(*[_lookup(FEATURE_WEIGHT, F.substring(full, 1, n)) for n in (6, 5, 1)], F.lit(5))


def is_populated(c: Column) -> Column:
    return c == "P"


def is_administrative(c: Column) -> Column:
    return c == "A"


def is_spot(c: Column) -> Column:
    return c == "S"


def is_land(c: Column) -> Column:
    return c.isin("L", "T", "V")


def is_admin1(c: Column, code: Column) -> Column:
    return (c == "A") & (code == "ADM1")


def is_upper_admin(c: Column, code: Column) -> Column:
    return (c == "A") & (code.isin("ADM1", "ADM2") | code.startswith("PCL"))


def is_country(code: Column) -> Column:
    return code == "PCLI"


def is_political(code: Column) -> Column:
    return code.startswith("PCL") | (code == "TERR")


def is_capital(code: Column) -> Column:
    return code == "PPLC"


def is_postal(code: Column) -> Column:
    return code == "POST"


def path(cc: Column, adm1: Column) -> Column:
    """CC.ADM1, the key of containment; null without a country."""
    return F.when(cc.isNotNull(), F.concat_ws(".", cc, F.coalesce(adm1, F.lit("0"))))


def admin_code(code: Column) -> Column:
    """'us.06' or 'US06' or '6' -> '06': the country's prefix goes, a digit is padded."""
    bare = F.regexp_replace(F.upper(F.trim(code)), r"^[A-Z]{2}[.\-]?(?=[0-9A-Z]+$)(?=.*[0-9])", "")
    return F.when(bare.rlike(r"^\d$"), F.lpad(bare, 2, "0")).otherwise(bare)


def fips_to_iso(code: Column) -> Column:
    return _lookup(FIPS, F.upper(code))


def language_name(code: Column) -> Column:
    return _lookup(LANGUAGES, primary_language(code))


def language_code(name: Column) -> Column:
    return _lookup({v.lower(): k for k, v in LANGUAGES.items()}, F.lower(name))


def primary_language(code: Column) -> Column:
    """'en-US' -> 'en'."""
    return F.split_part(F.lower(code), F.lit("-"), F.lit(1))


def countries_speaking(lang: Column) -> Column:
    table = F.create_map(*[x for k, v in SPOKEN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.try_element_at(table, primary_language(lang))
