"""Pattern extraction: compiled rules, spans with offsets, coordinates, dates and everyday identifiers.

A pattern file has lines `#DEFINE name regex`, `#RULE family id regex` and `#TEST family id text [FAIL]`;
`<name>` in a rule stands for a defined part and becomes a field of the match. The order of rules is
their priority. All rules of a file are applied in one pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.projection import mgrs_to_utm, utm_to_latlon


class Rule(NamedTuple):
    family: str
    id: str
    regex: str
    fields: tuple[str, ...]


class Check(NamedTuple):
    family: str
    id: str
    text: str
    found: bool


def compiled(source: str) -> tuple[list[Rule], list[Check]]:
    """ValueError for an unknown field, a part with a group of its own, or a rule that matches the empty text."""
    parts: dict[str, str] = {}
    rules, checks = [], []
    for line in source.splitlines():
        if not line.startswith("#"):
            continue
        kind, *rest = line.split(None, 3 if line.startswith(("#RULE", "#TEST")) else 2)
        if kind == "#DEFINE":
            if re.compile(rest[1].replace("&&", "")).groups:
                raise ValueError(f"{rest[0]}: a part can't have groups of its own")
            parts[rest[0]] = rest[1]
        elif kind == "#RULE":
            family, name, body = rest
            fields: list[str] = []

            def field(m: re.Match, fields: list[str] = fields) -> str:
                if m[1] not in parts:
                    raise ValueError(f"no part {m[1]}")
                fields.append(m[1])
                return f"({parts[m[1]]})"

            regex = re.sub(r"<(\w+)>", field, body)
            if re.compile(regex).match(""):
                raise ValueError(f"{name} matches the empty text")
            rules.append(Rule(family, name, regex, tuple(fields)))
        elif kind == "#TEST":
            family, name, text = rest
            checks.append(Check(family, name, re.sub(r"\s*\bFAIL$", "", text), not text.endswith("FAIL")))
    return rules, checks


_EDGE, _END = r"(?<![\w.])", r"(?![\w])"
COORDINATES = rf"""
#DEFINE hLat [NSns]
#DEFINE hLon [EWew]
#DEFINE sLat [-+]
#DEFINE sLon [-+]
#DEFINE dLat [0-8]?\d|90
#DEFINE dLon 1[0-7]\d|180|0?\d?\d
#DEFINE d2Lat [0-8]\d
#DEFINE d3Lon [01]\d\d
#DEFINE ddLat \d?\d\.\d{{1,20}}
#DEFINE ddLon [01]?\d?\d\.\d{{1,20}}
#DEFINE mLat [0-5]?\d
#DEFINE mLon [0-5]?\d
#DEFINE m2Lat [0-5]\d
#DEFINE m2Lon [0-5]\d
#DEFINE dmLat [0-5]?\d\.\d{{1,12}}
#DEFINE dmLon [0-5]?\d\.\d{{1,12}}
#DEFINE fmLat \d{{1,6}}
#DEFINE fmLon \d{{1,6}}
#DEFINE f3Lat \d{{3}}
#DEFINE f3Lon \d{{3}}
#DEFINE secLat [0-5]?\d
#DEFINE secLon [0-5]?\d
#DEFINE s2Lat [0-5]\d
#DEFINE s2Lon [0-5]\d
#DEFINE dsLat [0-5]?\d\.\d{{1,6}}
#DEFINE dsLon [0-5]?\d\.\d{{1,6}}
#DEFINE fsLat \d\d
#DEFINE fsLon \d\d
#DEFINE zone [0-6]?\d
#DEFINE band (?![ABIOYZ])[A-Z]
#DEFINE quad (?![IO])[A-Z](?![IO])[A-V]
#DEFINE offset \d\d(?:\d\d)?(?:\d\d)?(?:\d\d)?(?:\d\d)?|\d{{2,5}}\s\d{{2,5}}
#DEFINE easting \d{{6}}
#DEFINE northing \d{{3,7}}
#RULE MGRS MGRS-01 {_EDGE}<zone>\s?<band>\s?<quad>\s?<offset>{_END}
#RULE UTM UTM-01 {_EDGE}<zone>\s?<band>\s+<easting>m?E?[,\s]\s*<northing>m?N?{_END}
#RULE DMS DMS-01fs-a {_EDGE}<dLat>°\s?<mLat>['′’]\s?<dsLat>["″”]?\s?<hLat>[\s,;x/]*<dLon>°\s?<mLon>['′’]\s?<dsLon>["″”]?\s?<hLon>{_END}
#RULE DMS DMS-01fs-b {_EDGE}<hLat>\s?<dLat>°\s?<mLat>['′’]\s?<dsLat>["″”]?[\s,;x/]*<hLon>\s?<dLon>°\s?<mLon>['′’]\s?<dsLon>["″”]?{_END}
#RULE DMS DMS-01fs-deg {_EDGE}<sLat>?<dLat>°\s?<mLat>['′’]\s?<dsLat>["″”][\s,;x/]*<sLon>?<dLon>°\s?<mLon>['′’]\s?<dsLon>["″”]{_END}
#RULE DMS DMS-01dot-a {_EDGE}<dLat>\.<m2Lat>\.<s2Lat>\s?<hLat>[\s,;x/]+<dLon>\.<m2Lon>\.<s2Lon>\s?<hLon>{_END}
#RULE DMS DMS-01dot-b {_EDGE}<hLat>\s?<dLat>\.<m2Lat>\.<s2Lat>[\s,;x/]+<hLon>\s?<dLon>\.<m2Lon>\.<s2Lon>{_END}
#RULE DMS DMS-02 {_EDGE}<hLat>\s?<dLat>[°:\s-]\s?<mLat>['′’:\s-]\s?<secLat>["″”]?[\s,;x/]+<hLon>\s?<dLon>[°:\s-]\s?<mLon>['′’:\s-]\s?<secLon>["″”]?{_END}
#RULE DMS DMS-01a {_EDGE}<d2Lat><m2Lat><s2Lat><hLat>[\s,;x/]*<d3Lon><m2Lon><s2Lon><hLon>{_END}
#RULE DMS DMS-02a {_EDGE}<hLat><d2Lat><m2Lat><s2Lat>[\s,;x/]*<hLon><d3Lon><m2Lon><s2Lon>{_END}
#RULE DMS DMS-03a {_EDGE}<d2Lat><m2Lat><s2Lat><fsLat>\d{{0,2}}<hLat>[\s,;x/]*<d3Lon><m2Lon><s2Lon><fsLon>\d{{0,2}}<hLon>{_END}
#RULE DMS DMS-03b {_EDGE}<hLat><d2Lat><m2Lat><s2Lat><fsLat>\d{{0,2}}[\s,;x/]*<hLon><d3Lon><m2Lon><s2Lon><fsLon>\d{{0,2}}{_END}
#RULE DM DM-00 {_EDGE}<d2Lat><m2Lat><hLat>-<f3Lat>[\s,;x/]*<d3Lon><m2Lon><hLon>-<f3Lon>{_END}
#RULE DM DM-01a {_EDGE}<dLat>\s<m2Lat>[-.]<f3Lat>\s?<hLat>[\s,;x/]*<dLon>\s<m2Lon>[-.]<f3Lon>\s?<hLon>{_END}
#RULE DM DM-01a-dash {_EDGE}<dLat>-<m2Lat>[-.]<f3Lat>\s?<hLat>[\s,;x/]*<dLon>-<m2Lon>[-.]<f3Lon>\s?<hLon>{_END}
#RULE DM DM-01a-dot {_EDGE}<dLat>\.<m2Lat>\.<f3Lat>\s?<hLat>[\s,;x/]*<dLon>\.<m2Lon>\.<f3Lon>\s?<hLon>{_END}
#RULE DM DM-01b {_EDGE}<hLat><d2Lat><dmLat>[\s,;x/]*<hLon><d3Lon><dmLon>{_END}
#RULE DM DM-01b-dash {_EDGE}<hLat>\s?<dLat>\s<m2Lat>-<f3Lat>[\s,;x/]*<hLon>\s?<dLon>\s<m2Lon>-<f3Lon>{_END}
#RULE DM DM-01b-dot {_EDGE}<hLat>\s?<dLat>\.<m2Lat>\.<f3Lat>[\s,;x/]*<hLon>\s?<dLon>\.<m2Lon>\.<f3Lon>{_END}
#RULE DM DM-02a {_EDGE}<d2Lat><dmLat><hLat>[\s,;x/]*<d3Lon><dmLon><hLon>{_END}
#RULE DM DM-02b {_EDGE}<hLat><d2Lat><dmLat>[\s,;x/]+<hLon><d3Lon><dmLon>{_END}
#RULE DM DM-02b-dash {_EDGE}<hLat><d2Lat><m2Lat>-<fmLat>[\s,;x/]*<hLon><d3Lon><m2Lon>-<fmLon>{_END}
#RULE DM DM-03a {_EDGE}<d2Lat><m2Lat><f3Lat><hLat>[\s,;x/]*<d3Lon><m2Lon><f3Lon><hLon>{_END}
#RULE DM DM-03b {_EDGE}<hLat><d2Lat><m2Lat><f3Lat>[\s,;x/]*<hLon><d3Lon><m2Lon><f3Lon>{_END}
#RULE DM DM-03-av {_EDGE}<hLat>\s?<dLat>[°:\s-]\s?<mLat>['′’][\s,;x/]*<hLon>\s?<dLon>[°:\s-]\s?<mLon>['′’]{_END}
#RULE DM DM-03-av-deg {_EDGE}<sLat>?<dLat>°\s?<mLat>['′’][\s,;x/]*<sLon>?<dLon>°\s?<mLon>['′’](?!\s?[NSEWnsew]\b){_END}
#RULE DM DM-03-av-decdm {_EDGE}<sLat>?<dLat>°\s?<dmLat>['′’][\s,;x/]*<sLon>?<dLon>°\s?<dmLon>['′’](?!\s?[NSEWnsew]\b){_END}
#RULE DM DM-03-bv {_EDGE}<dLat>[°:\s-]\s?<mLat>['′’]\s?<hLat>[\s,;x/]*<dLon>[°:\s-]\s?<mLon>['′’]\s?<hLon>{_END}
#RULE DM DM-04a {_EDGE}<hLat><d2Lat><m2Lat>[\s,;x/]*<hLon><d3Lon><m2Lon>{_END}
#RULE DM DM-04b {_EDGE}<d2Lat><m2Lat><hLat>[\s,;x/]*<d3Lon><m2Lon><hLon>{_END}
#RULE DM DM-05 {_EDGE}<d2Lat><m2Lat><hLat>\d/<d3Lon><m2Lon><hLon>\d{_END}
#RULE DM DM-07 {_EDGE}<dLat>\s?DEG\s?<dmLat>\s?<hLat>[\s,;x/]*<dLon>\s?DEG\s?<dmLon>\s?<hLon>{_END}
#RULE DM DM-08 {_EDGE}<sLat><dLat>[\s°]\s?<dmLat>[\s,;x/]+<sLon><dLon>[\s°]\s?<dmLon>{_END}
#RULE DD DD-01 {_EDGE}<hLat>\s?<ddLat>°?[\s,;x/]+<hLon>\s?<ddLon>°?{_END}
#RULE DD DD-02 {_EDGE}<ddLat>°?\s?<hLat>[\s,;x/]+<ddLon>°?\s?<hLon>{_END}
#RULE DD DD-03 {_EDGE}<sLat>?<ddLat>°[\s,;x/]*<sLon>?<ddLon>°(?!\s?[NSEWnsew]\b){_END}
#RULE DD DD-04 (?i:lat(?:itude)?)\W{{0,3}}<hLat>?<sLat>?<ddLat>°?[\s,;x/]*(?i:lon(?:g(?:itude)?)?)\W{{0,3}}<hLon>?<sLon>?<ddLon>°?{_END}
#RULE DD DD-05 {_EDGE}<hLat>\s?<dLat>°[\s,;x/]*<hLon>\s?<dLon>°{_END}
#RULE DD DD-06 {_EDGE}<dLat>°\s?<hLat>[\s,;x/]*<dLon>°\s?<hLon>{_END}
#RULE DD DD-07 {_EDGE}<hLat><dLat>[\s]*[,;x/][\s]*<hLon><dLon>{_END}
#TEST MGRS MGRS-01 38SMB4611036560
#TEST UTM UTM-01 17N 699990 3333335
#TEST DMS DMS-01fs-a 04°29'47.5"N 113°25'26.0"E
#TEST DMS DMS-01fs-b N04°29'47.5" E113°25'26.0"
#TEST DMS DMS-01fs-deg 04°29'47.5" 113°25'26.0"
#TEST DMS DMS-01dot-a 04.29.47N 047.29.26E
#TEST DMS DMS-01dot-b N04.29.47 E047.29.26
#TEST DMS DMS-02 N37 46' 00" W121 31' 00"
#TEST DMS DMS-01a 374600N 1213100W
#TEST DMS DMS-02a N374600 W1213100
#TEST DMS DMS-03a 3746001234N 12131001234W
#TEST DMS DMS-03b N3746001234 W12131001234
#TEST DM DM-00 3746N-009 12131W-003
#TEST DM DM-01a 37 46-009N 121 31-003W
#TEST DM DM-01a-dash 37-46-009N; 121-31-003W
#TEST DM DM-01a-dot 37.46.009N 121.31.003W
#TEST DM DM-01b N3746.009W12131.003
#TEST DM DM-01b-dash N37 46-005 x W121 31-008
#TEST DM DM-01b-dot N37.46.005 x W121.31.008
#TEST DM DM-02a 3746.009N 12131.003W
#TEST DM DM-02b N3746.0 W12131.0
#TEST DM DM-02b-dash N3746-0046 W12131-0294
#TEST DM DM-03a 3746009N12131003W
#TEST DM DM-03b N3746009W12131003
#TEST DM DM-03-av N37 46' W121 31'
#TEST DM DM-03-av-deg 37° 46' 121° 31'
#TEST DM DM-03-av-decdm 37° 46.29' 121° 31.11'
#TEST DM DM-03-bv 37° 46'N 121° 31'W
#TEST DM DM-04a N3746 W12131
#TEST DM DM-04b 3746N 12131W
#TEST DM DM-05 /3746N4/12131W5/
#TEST DM DM-07 37 DEG 46.0N 121 DEG 31.0W
#TEST DM DM-08 +37 46.0 x -121 31.0
#TEST DD DD-01 N37.3, W121.4
#TEST DD DD-02 37.3N; 121.4W
#TEST DD DD-03 +37.3°;-121.4°
#TEST DD DD-04 Latitude: N37.3° x Longitude: W121.3°
#TEST DD DD-05 N37°, W121°
#TEST DD DD-06 37° N, 121° W
#TEST DD DD-07 N37, W121
#TEST DD DD-01 N37, W121 FAIL
#TEST DD DD-02 137.3.1 FAIL
"""
#: For profiles: a bare pair of decimal degrees is enough.
LOOSE = r"""
#DEFINE hLat [NSns]
#DEFINE hLon [EWew]
#DEFINE sLat [-+]
#DEFINE sLon [-+]
#DEFINE ddLat \d?\d\.\d{1,20}
#DEFINE ddLon [01]?\d?\d\.\d{1,20}
#RULE DD LOOSE <hLat>?<sLat>?<ddLat>\s*,\s*<hLon>?<sLon>?<ddLon>
#TEST DD LOOSE at 37.3, +121.4
#TEST DD LOOSE at 37, 121 FAIL
"""
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATES = r"""
#DEFINE year [12]\d{3}
#DEFINE yy \d\d
#DEFINE month 0?[1-9]|1[0-2]
#DEFINE day 0?[1-9]|[12]\d|3[01]
#DEFINE name (?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)
#DEFINE hour [01]\d|2[0-3]
#DEFINE minute [0-5]\d
#DEFINE second [0-5]\d
#DEFINE tz Z|[A-IK-Z]|[-+]\d\d:?\d\d
#RULE DTM DTM-01 \b<day><hour><minute><tz>\s?<name>\s?<yy>\b
#RULE YMD YMD-01 \b<year>-<month>-<day>T<hour>:<minute>:<second><tz>?
#RULE YMD YMD-02 \b<year>[-/]<month>[-/]<day>\b
#RULE DMY DMY-01 \b<day>[\s-]?<name>\.?,?[\s-]?<year>\b
#RULE MDY MDY-01 \b<name>\.?\s<day>(?:st|nd|rd|th)?,?\s<year>\b
#RULE MDY MDY-02 \b<month>/<day>/<year>\b
#RULE MDY MY-01 \b<name>\.?,?\s<year>\b
#TEST DTM DTM-01 161200Z DEC 20
#TEST YMD YMD-01 2017-01-02T04:05:06Z
#TEST YMD YMD-02 on 2015-12-13.
#TEST DMY DMY-01 16DEC2020
#TEST MDY MDY-01 November 14, 2008
#TEST MDY MDY-02 12/13/2015
#TEST MDY MY-01 Nov 2008
#TEST MDY MDY-02 13/13/2015 FAIL
"""
#: No look-around, so that other SQL engines run the same patterns.
LIFE = r"""
#DEFINE mail [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}
#DEFINE ip \d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}
#DEFINE phone (?:\+\d{1,3}[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}
#DEFINE link https?://[^\s<>"]+
#DEFINE money [$€£]\s?\d+(?:,\d{3})*(?:\.\d\d)?
#DEFINE mac [0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}
#RULE CYBER EMAIL <mail>
#RULE CYBER URL <link>
#RULE CYBER MAC \b<mac>\b
#RULE CYBER IP \b<ip>\b
#RULE TELEPHONE PHONE <phone>\b
#RULE MONEY AMOUNT <money>
#TEST CYBER EMAIL write to a.b+c@mail.example.org now
#TEST CYBER URL see https://example.org/a?b=c
#TEST CYBER MAC 00:1a:2B:3c:4d:5e
#TEST CYBER IP from 10.0.0.1 on
#TEST TELEPHONE PHONE call +1 555-123-4567
#TEST MONEY AMOUNT $1,200.50
#TEST CYBER EMAIL a at b FAIL
"""

_FLOAT = "double"


def _field(t: Column, rule: Rule, *names: str) -> Column | None:
    """The value of the first of the names that is a field of the rule; null where it is empty."""
    for n in names:
        if n in rule.fields:
            return F.nullif(F.regexp_extract(t, rule.regex, rule.fields.index(n) + 1), F.lit(""))
    return None


def _ordinate(t: Column, rule: Rule, axis: str) -> Column:
    get = lambda *names: _field(t, rule, *[n + axis for n in names])
    value = get("dd", "d", "d2", "d3").cast(_FLOAT)
    minutes, part = get("dm", "m", "m2"), get("fm", "f3")
    if minutes is not None:
        m = minutes if part is None else F.concat(minutes, F.lit("."), part)
        value = value + m.cast(_FLOAT) / 60
    seconds, part = get("ds", "sec", "s2"), get("fs")
    if seconds is not None:
        s = seconds if part is None else F.concat(seconds, F.lit("."), part)
        value = value + s.cast(_FLOAT) / 3600
    hemi, sign = get("h"), get("s")
    negative = F.lit(False)
    if hemi is not None:
        negative = negative | F.coalesce(F.upper(hemi).isin("S", "W"), F.lit(False))
    if sign is not None:
        negative = negative | F.coalesce(sign == "-", F.lit(False))
    return F.when(negative, -value).otherwise(value)


def _precision(t: Column, rule: Rule) -> Column:
    """Metres: half a unit of the last place of the latitude as written."""
    get = lambda *names: _field(t, rule, *[n + "Lat" for n in names])
    for names, part, unit in ((("ds", "sec", "s2"), ("fs",), 15.4), (("dm", "m", "m2"), ("fm", "f3"), 926.0), (("dd", "d", "d2"), (), 55_600.0)):
        v = get(*names)
        if v is None:
            continue
        p = get(*part) if part else None
        digits = F.length(p) if p is not None else F.length(F.regexp_extract(v, r"\.(\d+)$", 1))
        return F.lit(unit) / F.pow(F.lit(10.0), F.coalesce(digits, F.lit(0)))
    raise ValueError(rule.id)


def _coordinate(t: Column, rule: Rule) -> Column:
    """struct<lat, lon, prec_m>."""
    if rule.family == "UTM":
        zone, band, e, n = (_field(t, rule, x) for x in ("zone", "band", "easting", "northing"))
        p = utm_to_latlon(zone.cast("int"), F.upper(band) >= "N", e.cast(_FLOAT), n.cast(_FLOAT))
        return T.let(p, lambda x: F.struct(x.lat.alias("lat"), x.lon.alias("lon"), F.lit(1.0).alias("prec_m")))
    if rule.family == "MGRS":
        zone, band, quad, offset = (_field(t, rule, x) for x in ("zone", "band", "quad", "offset"))
        digits = F.regexp_replace(offset, r"\s", "")
        half = F.floor(F.length(digits) / 2).cast("int")
        u = mgrs_to_utm(zone.cast("int"), F.upper(band), quad, F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, half))
        p = T.let(u, lambda x: utm_to_latlon(zone.cast("int"), F.upper(band) >= "N", x.easting, x.northing))
        return T.let(p, lambda x: F.struct(x.lat.alias("lat"), x.lon.alias("lon"), F.pow(F.lit(10.0), 5 - half).alias("prec_m")))
    return F.struct(_ordinate(t, rule, "Lat").alias("lat"), _ordinate(t, rule, "Lon").alias("lon"), _precision(t, rule).alias("prec_m"))


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")])
    return F.try_element_at(table, F.lower(F.substring(name, 1, 3)))


def _date(t: Column, rule: Rule) -> Column:
    """struct<date_norm, ts, resolution>; ts is null for a day that isn't in the calendar."""
    get = lambda n: _field(t, rule, n)
    year = get("year") if "year" in rule.fields else F.concat(F.when(get("yy") < "50", F.lit("20")).otherwise(F.lit("19")), get("yy"))
    month = F.lpad(get("month"), 2, "0") if "month" in rule.fields else _month(get("name"))
    day = F.lpad(get("day"), 2, "0") if "day" in rule.fields else F.lit("01")
    date = F.concat_ws("-", year, month, day)
    if "hour" in rule.fields:
        second = get("second") if "second" in rule.fields else F.lit("00")
        zone = F.when(get("tz").rlike(r"^[-+]"), get("tz")).otherwise(F.lit("Z")) if "tz" in rule.fields else F.lit("Z")
        stamp = F.concat(date, F.lit("T"), get("hour"), F.lit(":"), get("minute"), F.lit(":"), F.coalesce(second, F.lit("00")), F.regexp_replace(zone, r"^([-+]\d\d)(\d\d)$", "$1:$2"))
        resolution = "SECOND" if "second" in rule.fields else "MINUTE"
    else:
        stamp, resolution = F.concat(date, F.lit("T00:00:00Z")), "DAY" if "day" in rule.fields else "MONTH"
    return F.struct(date.alias("date_norm"), stamp.try_cast("timestamp").alias("ts"), F.lit(resolution).alias("resolution"))


def extract(docs: DataFrame, rules: Iterable[Rule], value: Callable[[Column, Rule], Column] | None = None, families: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, start, end, text, family, rule, priority[, value]): all matches of all rules, in one pass over the texts."""
    chosen = [r for r in rules if families is None or r.family in families]

    def matched(i: int, r: Rule) -> Column:
        def one(s: Column) -> Column:
            parts = [s.start.alias("start"), s.end.alias("end"), s.text.alias("text"), F.lit(r.family).alias("family"), F.lit(r.id).alias("rule"), F.lit(i).alias("priority")]
            return F.struct(*parts, *([value(s.text, r).alias("value")] if value else []))

        return F.transform(T.spans(F.col("text"), r.regex), one)

    found = [matched(i, r) for i, r in enumerate(chosen)]
    # A plain explode would have all patterns matched twice, for a filter that the optimizer adds.
    return docs.select("doc_id", F.explode_outer(F.flatten(F.array(*found))).alias("m")).where("m is not null").select("doc_id", "m.*")


def coordinates(docs: DataFrame, families: Sequence[str] | None = None, source: str = COORDINATES) -> DataFrame:
    """(doc_id, start, end, text, family, rule, priority, lat, lon, prec_m) of valid coordinates.

    Latitudes beyond 90 and longitudes beyond 180 degrees go, as do dates that look like grid references or degrees.
    """
    rules, _ = compiled(source)
    some = docs.where(F.col("text").rlike(r"\d"))
    got = extract(some, rules, _coordinate, families).select("*", "value.*").drop("value")
    valid = got.where((F.abs("lat") <= 90) & (F.abs("lon") <= 180))
    return valid.where(~((F.col("family") == "MGRS") & is_date_like_grid(F.col("text"))) & ~((F.col("family") == "DMS") & is_date_like_degrees(F.col("text"))))


def is_date_like_grid(t: Column) -> Column:
    """'10DEC1214' or '4 JAN 2012': a day, a month's name and digits."""
    return F.upper(t).rlike("^[0-3]?\\d\\s?(" + "|".join(m.upper() for m in MONTHS) + ")\\s?\\d+")


def is_date_like_degrees(t: Column) -> Column:
    """'2012-10-11 10:12:14' without a hemisphere."""
    return ~t.rlike("[NSEWnsew°]") & t.rlike(r"[12]\d{3}[-/.]\d\d?[-/.]\d\d?")


def ambiguous_grid(digits: Column) -> Column:
    """An odd number of digits has two readings: array<struct<easting, northing>>, the extra digit on either side; one for an even number."""
    d = F.regexp_replace(digits, r"\s", "")
    half = F.floor(F.length(d) / 2).cast("int")
    cut = lambda k: F.struct(F.substring(d, F.lit(1), k).alias("easting"), F.substring(d, k + 1, F.length(d)).alias("northing"))
    return F.when(F.length(d) % 2 == 0, F.array(cut(half))).otherwise(F.array(cut(half), cut(half + 1)))


def dates(docs: DataFrame, families: Sequence[str] | None = None, now: Column | None = None) -> DataFrame:
    """(doc_id, start, end, text, family, rule, priority, date_norm, ts, resolution[, is_future, is_distant_past])."""
    rules, _ = compiled(DATES)
    got = extract(docs.where(F.col("text").rlike(r"\d")), rules, _date, families).select("*", "value.*").drop("value").where("ts is not null")
    if now is not None:
        got = got.withColumns({"is_future": F.col("ts") > now, "is_distant_past": F.col("ts") < F.lit("1900-01-01").cast("timestamp")})
    return got


def life(docs: DataFrame, families: Sequence[str] | None = None) -> DataFrame:
    """Mail addresses, links, hardware and network addresses, telephone numbers and amounts, each with a normal form."""
    rules, _ = compiled(LIFE)
    got = extract(docs, rules, None, families)
    plain = F.when(F.col("rule") == "PHONE", F.regexp_replace("text", r"[^\d+]", "")).when(F.col("rule") == "AMOUNT", F.regexp_replace("text", r"[,\s]", ""))
    return got.withColumn("norm", plain.when(F.col("rule") == "MAC", F.upper(F.replace("text", F.lit("-"), F.lit(":")))).otherwise(F.lower("text")))


def reduced(matches: DataFrame) -> DataFrame:
    """matches with is_duplicate (a rule of higher priority has the same span) and is_submatch (lies within a longer one)."""
    same = Window.partitionBy("doc_id", "start", "end").orderBy("priority")
    first = F.struct("start", (-F.col("end")).alias("e"))
    inner = Window.partitionBy("doc_id").orderBy(first).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    widest = F.max(F.struct("end", (-F.col("start")).alias("s"))).over(inner)
    out = matches.withColumn("is_duplicate", F.row_number().over(same) > 1).withColumn("w", widest)
    sub = (F.col("w.end") >= F.col("end")) & ((-F.col("w.s") != F.col("start")) | (F.col("w.end") != F.col("end")))
    return out.withColumn("is_submatch", sub).drop("w")


def run_checks(spark, source: str) -> list[tuple[Check, bool]]:  # noqa: ANN001
    """Each #TEST with whether its rule found something in its text."""
    rules, checks = compiled(source)
    docs = spark.createDataFrame([(i, c.text) for i, c in enumerate(checks)], "doc_id long, text string")
    hits = {(r.doc_id, r.rule) for r in extract(docs, rules).select("doc_id", "rule").distinct().collect()}
    return [(c, (i, c.id) in hits) for i, c in enumerate(checks)]
