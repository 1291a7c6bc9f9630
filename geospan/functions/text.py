"""Text functions: traits, folding, cleaning, counting and tokens with offsets.

Offsets are code points, from 0, end exclusive. Where the source of a function only gave its
signature, the contract here is our own and stated in the docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what folding makes of them, one for one; two-letter foldings are in PAIRS.
FOLD_FROM = "àáâãäåāăąçćčďèéêëēėęěìíîïīłñńňòóôõöøōőŕřśšşţťùúûüūůűýÿźžżÀÁÂÃÄÅĀĂĄÇĆČĎÈÉÊËĒĖĘĚÌÍÎÏĪŁÑŃŇÒÓÔÕÖØŌŐŔŘŚŠŞŢŤÙÚÛÜŪŮŰÝŸŹŽŻ"
FOLD_TO = "aaaaaaaaacccdeeeeeeeeiiiiilnnnoooooooorrsssttuuuuuuuyyzzzAAAAAAAAACCCDEEEEEEEEIIIIILNNNOOOOOOOORRSSSTTUUUUUUUYYZZZ"
PAIRS = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"))
WORD = r"[\p{L}\p{N}]+"
CJK_CHAR = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
CJK_OR_WORD = CJK_CHAR + r"|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]+"
CJK_LANGS = ("zh", "zt", "ja", "ko")
ARABIC_LANGS = ("ar", "fa", "ur")
BLOCK = 256


# --- case and script -------------------------------------------------------------------------
def has_letter(t: Column) -> Column:
    return t.rlike(r"\p{L}")


def is_upper(t: Column) -> Column:
    return (F.upper(t) == t) & has_letter(t)


def is_lower(t: Column) -> Column:
    return (F.lower(t) == t) & has_letter(t)


def is_mixed(t: Column) -> Column:
    return has_letter(t) & ~is_upper(t) & ~is_lower(t)


def case_measure(t: Column) -> Column:
    """(upper-case letters, lower-case letters, letters)."""
    return F.struct(
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("upper"),
        F.regexp_count(t, F.lit(r"\p{Ll}")).alias("lower"),
        F.regexp_count(t, F.lit(r"\p{L}")).alias("letters"),
    )


def is_ascii(t: Column) -> Column:
    return t.rlike(r"^[\x00-\x7f]*$")


def has_diacritics(t: Column) -> Column:
    return fold(t) != t


def has_cjk(t: Column) -> Column:
    return t.rlike(CJK_CHAR)


def is_chinese(t: Column) -> Column:
    return t.rlike(r"\p{IsHan}") & ~is_japanese(t) & ~is_korean(t)


def is_japanese(t: Column) -> Column:
    return t.rlike(r"[\p{IsHiragana}\p{IsKatakana}]")


def is_korean(t: Column) -> Column:
    return t.rlike(r"\p{IsHangul}")


def has_middle_eastern(t: Column) -> Column:
    return t.rlike(r"[\p{IsArabic}\p{IsHebrew}]")


def traits(t: Column) -> Column:
    return F.struct(
        is_lower(t).alias("is_lower"), is_upper(t).alias("is_upper"), is_mixed(t).alias("is_mixed"),
        has_cjk(t).alias("has_cjk"), has_middle_eastern(t).alias("has_me"),
    )


# --- folding ---------------------------------------------------------------------------------
def fold(t: Column) -> Column:
    """Without the diacritics of Latin letters; two-letter foldings included."""
    t = F.translate(t, FOLD_FROM, FOLD_TO)
    for a, b in PAIRS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def norm(t: Column) -> Column:
    """The key of a phrase: folded, lower case, words joined by one blank."""
    return F.array_join(F.regexp_extract_all(F.lower(fold(t)), F.lit(CJK_OR_WORD), F.lit(0)), " ")


def phonetic(t: Column) -> Column:
    """Own contract: folded, lower case, only the letters and digits, doubled letters once."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold(t)), r"[^\p{L}\p{N}]", ""), r"(\p{L})\1+", "$1")


def normalize_abbreviation(t: Column) -> Column:
    """U.S.A. -> USA."""
    return F.regexp_replace(t, r"(?<=\p{L})\.", "")


def normalize_entity(t: Column) -> Column:
    """Squeezed, without quotes and punctuation at either end."""
    return F.regexp_replace(squeeze(t), r"^[\p{Punct}\s]+|[\p{Punct}\s&&[^.)]]+$", "")


# --- cleaning --------------------------------------------------------------------------------
def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def delete_eol(t: Column) -> Column:
    return F.regexp_replace(t, r"[\r\n]+", " ")


def reduce_line_breaks(t: Column) -> Column:
    """Runs of three and more line ends become two."""
    return F.regexp_replace(F.replace(t, F.lit("\r"), F.lit("")), r"\n{3,}", "\n\n")


def remove_punctuation(t: Column) -> Column:
    return squeeze(F.regexp_replace(t, r"[\p{P}\p{S}]", " "))


def remove_symbols(t: Column) -> Column:
    return F.regexp_replace(t, r"\p{S}", "")


def remove_emoticons(t: Column) -> Column:
    return F.regexp_replace(t, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", "")


def delete_controls(t: Column) -> Column:
    return F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def replace_any(t: Column, chars: str, by: str = " ") -> Column:
    return F.translate(t, chars, by * len(chars)) if len(by) == 1 else F.translate(t, chars, "")


# --- counting --------------------------------------------------------------------------------
def count_digits(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"\p{Nd}"))


def count_spaces(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"\s"))


def count_formatting(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"[\r\n\t]"))


def count_nontext(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]"))


def count_irregular_punctuation(t: Column) -> Column:
    """Punctuation that names don't have: all but . - _ , ' ` and blanks."""
    return F.regexp_count(t, F.lit(r"[\p{P}\p{S}&&[^.\-_,'`’]]"))


def count_cjk(t: Column) -> Column:
    return F.regexp_count(t, F.lit(CJK_CHAR))


# --- tokens and offsets ----------------------------------------------------------------------
def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f uses it, also within lambdas, where nothing is shared otherwise."""
    return F.transform(F.array(value), f)[0]


def running(steps: Column, block: int = BLOCK) -> Column:
    """Exclusive prefix sums of an array of int, in two levels: linear but for a small factor, also for millions of entries."""

    def appended(start: Column, items: Column) -> Column:
        none = F.array().cast("array<bigint>")
        first = F.struct(start.cast("bigint").alias("t"), none.alias("a"))
        return F.aggregate(items, first, lambda acc, x: F.struct((acc.t + x).alias("t"), F.array_append(acc.a, acc.t).alias("a")), lambda acc: acc.a)

    def in_blocks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int")), lambda b: F.slice(s, b * block + 1, F.lit(block)))

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y))
        return F.flatten(F.zip_with(blocks, appended(F.lit(0), sums), lambda x, base: appended(base, x)))

    return let(steps, lambda s: F.when(F.size(s) > 0, let(in_blocks(s), summed)).otherwise(F.array().cast("array<bigint>")))


def spans(t: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, text>> of all matches of a pattern that doesn't match the empty text; in code points, null for null."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern

    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(t.isNotNull(), let(F.regexp_extract_all(t, p, F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m, F.split(t, p, -1))).otherwise(none)))


def placed(found: Column, between: Column) -> Column:
    """spans() from the matches of a pattern and the pieces between them, of which there is one more."""
    gaps = F.slice(between, F.lit(1), F.greatest(F.size(found), F.lit(0)))
    lengths = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: F.struct(F.length(x.g).alias("g"), (F.length(x.g) + F.length(x.m)).alias("step"), x.m.alias("m")))

    def at(each: Column) -> Column:
        before = running(F.transform(each, lambda x: x.step))
        return F.zip_with(before, each, lambda b, x: F.struct((b + x.g).cast("int").alias("start"), (b + x.step).cast("int").alias("end"), x.m.alias("text")))

    return let(lengths, at)


def tokens(t: Column, lang: Column | None = None) -> Column:
    """spans() of the words; of single characters where the language is written without blanks."""
    plain = spans(t, WORD)
    return plain if lang is None else F.when(lang.isin(*CJK_LANGS), spans(t, CJK_OR_WORD)).otherwise(plain)


def text_window(t: Column, start: Column, end: Column, width: int = 40) -> Column:
    """(before, after): up to so many characters on either side."""
    at = F.greatest(start - width, F.lit(0))
    return F.struct(F.substring(t, at + 1, start - at).alias("before"), F.substring(t, end + 1, F.lit(width)).alias("after"))


def tokens_left(t: Column, n: int = 1) -> Column:
    """The last n words of a text before a span."""
    w = F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))
    return F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n))


def tokens_right(t: Column, n: int = 1) -> Column:
    return F.slice(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)), F.lit(1), F.lit(n))


def string_list(t: Column, delim: str = ",") -> Column:
    """Trimmed entries that aren't empty."""
    return F.filter(F.transform(F.split(t, delim), lambda x: F.trim(x)), lambda x: x != "")


def text_id(t: Column) -> Column:
    return F.md5(t)


def hashtags(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1))


def natural_language(t: Column) -> Column:
    """Without links, mentions and the marks of hashtags."""
    return squeeze(F.regexp_replace(F.regexp_replace(t, r"https?://\S+|@\w+", " "), r"#", ""))


def html_text(t: Column) -> Column:
    """Markup taken out: scripts and styles with their content, tags, common entities."""
    t = F.regexp_replace(t, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return squeeze(t)


# --- names -----------------------------------------------------------------------------------
def acronym_of(t: Column) -> Column:
    """An acronym in parentheses: 'World Health Body (WHB)' -> WHB."""
    return F.nullif(F.regexp_extract(t, r"\(([A-Z][A-Z0-9&.-]{1,11})\)", 1), F.lit(""))


def without_note(t: Column) -> Column:
    """'Old Town (historical)' -> 'Old Town'."""
    return F.trim(F.regexp_replace(t, r"\s*\([^)]*\)", ""))


def is_abbreviation(t: Column, next_char: Column, doc_upper: Column) -> Column:
    """A full stop after or within, or upper case of up to five characters in a text that isn't all upper case."""
    return (next_char == ".") | t.rlike(r"\p{L}\.\p{L}") | (is_upper(t) & (F.length(t) <= 5) & ~doc_upper)
