"""Filters: predicates over spans and names, and the anti-joins for lists of terms. True means the span is to go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import text as T

MAX_LOCATIONS = 100
MIN_CONFIDENCE, MAX_PRECISION_M = 15, 10_000.0
YEARS = (1975, 2025)
STATUS = ("PCL", "PCLI", "PCLD", "ADM1", "PPLC")


def too_short(t: Column) -> Column:
    return F.length(t) <= 1


def token_min_length(lang: Column) -> Column:
    """Shortest token worth a look-up: two in CJK, six in Arabic script, else three."""
    return F.when(lang.isin(*T.CJK_LANGS), 2).when(lang.isin(*T.ARABIC_LANGS), 6).otherwise(3)


def name_min_length(lang: Column) -> Column:
    """Shortest name of a minor place: only for CJK and Arabic script; else no limit (recorded deviation)."""
    return F.when(lang == "ja", 5).when(lang.isin("zh", "zt", "ko"), 4).when(lang.isin(*T.ARABIC_LANGS), 13).otherwise(0)


def short_for_language(t: Column, lang: Column, codes: Column | None = None) -> Column:
    """Below the name's length for its language, unless one of its places has a code of standing."""
    short = F.length(t) < name_min_length(lang)
    return short if codes is None else short & ~F.exists(codes, lambda c: c.isin(*STATUS))


def irregular_punctuation(t: Column) -> Column:
    return T.count_irregular_punctuation(t) > 0


def contraction(t: Column, before: Column) -> Column:
    """'s, 't or 'd after an apostrophe, taken for the start of a name."""
    return F.substring(before, -1, 1).isin("'", "’") & F.upper(F.substring(t, 1, 1)).isin("S", "T", "D") & ((F.length(t) == 1) | F.substring(t, 2, 1).rlike(r"\s"))


def lower_phrase(t: Column) -> Column:
    return T.is_ascii(t) & T.is_lower(t) & (F.length(t) <= 20)


def broken_lines(t: Column) -> Column:
    return T.count_formatting(t) > 1


def stop_key(t: Column) -> Column:
    return F.lower(F.replace(t, F.lit("-"), F.lit(" ")))


def without_terms(spans: DataFrame, terms: DataFrame, key: Column | None = None) -> DataFrame:
    """spans whose key (lower case, hyphens as blanks) isn't one of terms (term)."""
    k = stop_key(F.col("text")) if key is None else key
    return spans.withColumn("__k", k).join(terms.select(F.col("term").alias("__k")).distinct(), "__k", "left_anti").select(*spans.columns)


def language_stop_words(spans: DataFrame, words: DataFrame, lang: str = "lang") -> DataFrame:
    """Without lower-case stop words of the text's language; non-ASCII ones of an unknown language are tested against all languages.

    spans: text, a language column and doc_mixed (the document has both cases). A capitalised word stays;
    a lower-case one of under 12 characters goes from a document of mixed case.
    """
    low = F.lower("text")
    unknown = F.col(lang).isNull() & ~T.is_ascii(F.col("text")) & (F.length("text") < 12)
    capital = F.col("text").rlike(r"^\p{Lu}")
    left = spans.where(~(F.coalesce(F.col("doc_mixed"), F.lit(False)) & T.is_lower(F.col("text")) & T.is_ascii(F.col("text")) & (F.length("text") < 12)))
    keyed = left.withColumn("__w", F.when(~capital, low)).withColumn("__l", F.when(unknown, F.lit("*")).otherwise(F.col(lang)))
    every = words.select("lang", "term").unionAll(words.select(F.lit("*").alias("lang"), "term")).distinct().toDF("__l", "__w")
    return keyed.join(every, ["__l", "__w"], "left_anti").select(*spans.columns)


def short_cjk(t: Column) -> Column:
    return T.has_cjk(t) & (F.length(T.phonetic(t)) < 3)


def marked(spans: DataFrame, names: DataFrame, flag: str) -> DataFrame:
    """spans with flag: its phrase is one of names (phrase). Continents are kept so, but marked."""
    hit = names.select("phrase").distinct().withColumn(flag, F.lit(True))
    return spans.join(hit, "phrase", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).select(*spans.columns, flag)


def has_point(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def crowded(candidates: DataFrame, limit: int = MAX_LOCATIONS, by: Sequence[str] = ("doc_id", "start", "end")) -> DataFrame:
    """Of a span (or what else by names) with more than `limit` places, only administrative and populated ones whose code doesn't end in X or H."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    good = F.col("feat_class").isin("A", "P") & ~F.coalesce(F.col("feat_code"), F.lit("")).rlike("[XH]$")
    return candidates.withColumn("__n", n).where((F.col("__n") <= limit) | good).drop("__n")


def with_spellings(places: DataFrame) -> DataFrame:
    """places (phrase) with what spelt() asks: whether a name is among those of the phrase, and else how its codes and abbreviations are written."""
    whole = Window.partitionBy("phrase")
    named = F.coalesce(F.max(F.col("name_type") == "N").over(whole), F.lit(False))
    return places.withColumn("__named", named).withColumn("__spellings", F.collect_set(F.when(~F.col("__named"), F.lower("name"))).over(whole))


def spelt(candidates: DataFrame) -> DataFrame:
    """candidates without spans whose code or abbreviation isn't written as the text has it, but for case."""
    known = lambda t: F.array_contains("__spellings", F.lower(t))
    ok = F.when(F.col("__named"), True).otherwise(known(F.col("text")) | known(T.normalize_abbreviation(F.col("text"))))
    return candidates.where(ok).drop("__named", "__spellings")


def code_mismatch(candidates: DataFrame) -> DataFrame:
    """spelt() of candidates whose spans have all their places."""
    ok = F.max((F.col("name_type") == "N") | (F.lower("name") == F.lower(T.normalize_abbreviation(F.col("text")))) | (F.lower("name") == F.lower("text")))
    return candidates.withColumn("__ok", ok.over(Window.partitionBy("doc_id", "start", "end"))).where("__ok").drop("__ok")


def lower_abbreviation(t: Column, allowed: bool = False) -> Column:
    return F.lit(not allowed) & T.is_lower(t) & (F.length(t) <= 4)


def lexicon_punctuation(t: Column) -> Column:
    """Punctuation that no lexicon phrase has: all but - _ . ' and `."""
    return t.rlike(r"[\p{Punct}&&[^-_.'`]]+")


def postal_punctuation(t: Column) -> Column:
    return F.trim(t).rlike(r"[^\p{L}\p{N}\s-]")


def bad_postal(t: Column, years: tuple[int, int] = YEARS) -> Column:
    """Punctuation, under four characters, or a number between the years (both exclusive)."""
    number = F.when(F.trim(t).rlike(r"^\d{4}$"), F.trim(t).cast("int"))
    return postal_punctuation(t) | (F.length(F.trim(t)) < 4) | F.coalesce((number > years[0]) & (number < years[1]), F.lit(False))


def server_filtered(t: Column, kind: Column, is_country: Column, min_len: int = 4, codes: bool = False, qualified: Column | None = None) -> Column:
    """Marked in outputs: codes unless asked for, postal codes without a place, spans below min_len unless a country or CJK or Arabic."""
    short = (F.length(t) < min_len) & ~is_country & ~T.has_cjk(t) & ~T.has_middle_eastern(t)
    post = (kind == "postal") & ~(F.lit(False) if qualified is None else qualified)
    return F.when(F.lit(not codes) & (kind == "code"), True).otherwise(post | short)


def output_kept(confidence: Column, precision: Column) -> Column:
    return (confidence >= MIN_CONFIDENCE) & (F.coalesce(precision, F.lit(0.0)) <= MAX_PRECISION_M)


def keyword_junk(t: Column) -> Column:
    return (F.length(t) <= 3) | t.startswith("@") | F.lower(t).startswith("http")


def etl_feature_dropped(feat_class: Column, feat_code: Column, name: Column, drop: Sequence[str] = (r"^[HUV]/", r"^R/(RD|TRL)", r"^S/(HSE|RSRT)"), keep: Sequence[str] = (r"^H/(LK|SEA|OCN|BAY)$",)) -> Column:
    """Feature types not worth tagging, unless on the list to keep; regions with a short upper-case suffix; names of digits; names of under two characters."""
    full = F.concat_ws("/", feat_class, feat_code)
    either = lambda rx: F.greatest(*[full.rlike(r) for r in rx], F.lit(False))
    region = (feat_code == "RGNE") & name.rlike(r"\s\p{Lu}{1,3}$")
    return (either(drop) & ~either(keep)) | region | name.rlike(r"^\d+$") | (F.length(name) < 2)


def search_only(name: Column, feat_class: Column) -> Column:
    """Names that can be looked up but aren't tagged: tiny ASCII ones, dotted fragments, a vowel doubled thrice, alphanumeric codes of minor features."""
    tiny = T.is_ascii(name) & (F.length(name) <= 2)
    odd = name.rlike(r"(?i)^(no|number|site|area|unit|block)\s*\d+$") | name.rlike(r"(?i)([aeiouy])\1\1") | name.rlike(r"[#*?\[\]{}|]") | name.rlike(r"^\W") | name.rlike(r"^[\d\s.-]+$")
    code = name.rlike(r"^(?=.*\d)[A-Za-z0-9]{1,8}$") & ~feat_class.isin("A", "P")
    return tiny | odd | code


def jrc_valid(name: Column) -> Column:
    """A name that starts with a joining word, or 'the' and a short rest, is no entity; it needs three characters, or CJK."""
    low = F.lower(name)
    return ~low.rlike(r"^(and|of)\b") & ~(low.startswith("the ") & (F.length(name) < 10)) & ((F.length(name) > 2) | T.has_cjk(name))


def is_acronym(name: Column) -> Column:
    return T.is_upper(name) & T.is_ascii(name) & ~name.contains(" ") & (F.length(name) <= 12)


def factbook_valid(name: Column, stop_words: Sequence[str] = ()) -> Column:
    return ~F.lower(name).isin(*stop_words, "") & (F.length(name) >= F.when(is_acronym(name), 3).otherwise(4))


def social_lower(t: Column) -> Column:
    return T.is_lower(t) & ~(T.is_upper(t) & (F.length(t) >= 3))


def profile_rejected(t: Column, excluded: Sequence[str] = ("earth", "worldwide", "everywhere", "nowhere", "home")) -> Column:
    """Text of a profile's location that can't be one."""
    low = F.lower(F.trim(t))
    return low.contains("http") | low.isin(*excluded) | t.contains(":") | (T.count_digits(t) > 5) | (F.length(low) < 2)


def nonsense(t: Column) -> Column:
    """Up to 20 characters that hold more punctuation than a name, or are numerals, or a repeated lower-case word, or an article and a word in lower case, or oddly cased."""
    n = T.count_nontext(t)
    dense = n * F.when(F.length(t) > 10, 4).otherwise(3) >= F.length(t)
    words = F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0))
    repeated = T.is_lower(t) & (F.size(words) > 1) & (F.size(F.array_distinct(words)) == 1)
    article = t.rlike(r"^(the|a|an|el|la|le|der|die|das)\s+\p{Ll}+$")
    numeral = t.rlike(r"^\(?[\dIVXivx]{1,4}[).]\s+\S{1,3}$") | t.rlike(r"^\d+(\s*\p{Ll}{1,2})?$")
    odd_case = t.rlike(r"\p{Ll}\p{Lu}{2,}\p{Ll}") | t.rlike(r"^\p{Ll}\p{Lu}+$")
    return (F.length(t) <= 20) & (dense & ~valid_abbreviation(t) | irregular_punctuation(t) | repeated | article | numeral | odd_case)


def valid_abbreviation(t: Column) -> Column:
    """A.B.C. or A.B-C: single letters with stops, a hyphen allowed."""
    return t.rlike(r"^(\p{L}{1,3}[.-])+\p{L}{0,3}$") & t.contains(".")


def short_mismatch(matched: Column, signal: Column, punctuation: int) -> Column:
    """Whether a short name found in a text can stand for a name: their phonetic forms agree and neither has stray punctuation."""
    return (T.phonetic(matched) == T.phonetic(signal)) & (T.count_nontext(signal) <= punctuation)


def diacritic_mismatch(t: Column, names: Column) -> Column:
    """Up to 8 characters of which none of the names is a spelling: an unmarked text only goes with unmarked names, and a marked one with the same marks or none."""
    same = F.exists(names, lambda n: (F.lower(n) == F.lower(t)) | (T.has_diacritics(t) & ~T.is_ascii(n) & (T.phonetic(n) == T.phonetic(t)) & (F.length(n) == F.length(t)) & (F.lower(n) == F.lower(t))))
    return (F.length(t) <= 8) & ~same


def phrase_density(t: Column) -> Column:
    """Characters to each blank."""
    return F.length(t) / F.greatest(T.count_spaces(t), F.lit(1))


def non_latin_noise(t: Column) -> Column:
    """CJK or Arabic text of under three characters, or with a blank at every third (fifth) character or oftener."""
    return (T.has_cjk(t) | T.has_middle_eastern(t)) & ((F.length(F.regexp_replace(t, r"\s", "")) < 3) | (T.count_spaces(t) * F.when(T.has_cjk(t), 3).otherwise(5) > F.length(t)))


def site_exempt(feat_code: Column) -> Column:
    return feat_code.isin(*C.SITE_CODES)
