"""The library's own operators on small inputs; the registered queries are held against DuckDB in test_queries.py."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geospan.functions import codes as C
from geospan.functions import geo as G
from geospan.functions import text as T
from geospan.functions import words as W
from geospan.operators import etl, filters, lookup, patterns, postal, rules, tagger
from geospan.plans import fixtures as X
from geospan.plans import geocoder
from geospan.sources import readers, sinks
from geospan.streaming import stream


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("text", ["", "ab", "a 😀 b", "x" * 5, "é-è", "😀😀 ab 😀 c " * 200])
def test_spans_are_code_points(spark, text):
    got = value(spark, text, T.tokens)
    assert [text[s.start : s.end] for s in got] == [s.text for s in got]
    assert sum(map(len, (s.text for s in got))) == sum(c.isalnum() for c in text)


def test_null_text_has_no_spans(spark):
    assert value(spark, None, T.tokens) is None


def test_long_text_offsets(spark):
    text = "ab, cde. " * 20_000
    got = value(spark, text, T.tokens)
    assert len(got) == 40_000 and all(text[s.start : s.end] == s.text for s in got[::997])


def test_tag_overlap_and_limits(spark):
    docs = spark.createDataFrame([(1, "New York City, new york; York"), (2, None), (3, "")], "doc_id long, text string")
    words = tagger.phrases(spark.createDataFrame([("New York",), ("York City",), ("york",)], "name string"))
    found = tagger.tag(docs, words)
    assert found.count() == 6
    kept = [(r.start, r.end) for r in tagger.longest_dominant_right(found).orderBy("start").collect()]
    assert kept == [(4, 13), (15, 23), (25, 29)]
    assert [(r.start, r.end) for r in tagger.no_sub(found).orderBy("start").collect()] == [(0, 8), (4, 13), (15, 23), (25, 29)]
    with pytest.raises(Exception, match="break up"):
        tagger.limited(found, 3).collect()


@pytest.mark.parametrize("source", [patterns.LOOSE, patterns.DATES, patterns.LIFE])
def test_pattern_files(spark, source):
    assert [(c, ok) for c, ok in patterns.run_checks(spark, source) if ok != c.found] == []


def test_pattern_compiler_refuses():
    for bad in ("#RULE A B <x>", "#DEFINE x (a)\n#RULE A B <x>", "#DEFINE x a*\n#RULE A B <x>"):
        with pytest.raises(ValueError):
            patterns.compiled(bad)


@pytest.mark.parametrize(("text", "want"), [("A.B.C.", True), ("A.B-C", True), ("A.B/C", False), ("A<>C", False)])
def test_abbreviations(spark, text, want):
    assert value(spark, text, filters.valid_abbreviation) is want


@pytest.mark.parametrize(("text", "want"), [("AB%66", True), ("AB(66", True), ("AB66", False), ("AB-66", False), (" AB 66 ", False), ("1999", True), ("1975", False)])
def test_postal_codes(spark, text, want):
    assert value(spark, text, filters.bad_postal) is want


@pytest.mark.parametrize(("lang", "text", "want"), [("es", "hola", False), ("zh", "ab", True), ("ar", "abcde", True)])
def test_language_length(spark, lang, text, want):
    assert value(spark, text, lambda t: filters.short_for_language(t, F.lit(lang))) is want


def test_geohash_and_distance(spark):
    row = spark.range(1).select(G.geohash(F.lit(57.64911), F.lit(10.40744), 6).alias("g"), G.km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("k"), G.parse_latlon(F.lit("1.5,2")).alias("p"), G.parse_latlon(F.lit("x")).alias("q")).first()
    assert row.g == "u4pruy" and row.k == pytest.approx(111.195, abs=0.01) and tuple(row.p) == (1.5, 2.0) and row.q is None


def test_radius_join_equals_brute_force_at_poles_and_date_line(spark):
    pts = [(i, lat, lon) for i, (lat, lon) in enumerate([(0, 179.9), (89.9, 10), (-89.95, 0), (45, -180), (60, 0), (0, 0), (91, 0)])]
    gaz = [(f"p{i}", f"n{i}", float(lat), float(lon)) for i, (lat, lon) in enumerate([(0, -179.9), (89.9, -170), (-89.9, 180), (45.1, 179.9), (60.5, 1), (0.1, 0.1), (10, 10)])]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in pts], "point_id long, p_lat double, p_lon double")
    places = spark.createDataFrame(gaz, "place_id string, name string, lat double, lon double")
    for radius in (30.0, 120.0):
        want = points.where("p_lat <= 90").crossJoin(places).where(G.km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) <= radius)
        key = lambda df: sorted((r.point_id, r.place_id) for r in df.collect())
        assert key(lookup.within(points, places, radius)) == key(want) != []


def test_nearest_places_are_those_of_all_pairs_and_grow_with_the_spots(spark):
    """Many points and places at few coordinates: the same rows as from all pairs, of which most aren't made."""
    kinds = ["P", "A", "S", None]
    gaz = [(f"p{i:03}", f"n{i % 7}", "R0", None if i % 5 == 0 else "01", kinds[i // 3 % 4], "X", i % 3 * 0.2, -0.0 if i % 2 else 0.3) for i in range(360)]
    places = spark.createDataFrame(gaz, "place_id string, name string, cc string, adm1 string, feat_class string, feat_code string, lat double, lon double")
    points = spark.createDataFrame([(i, i % 4 * 0.21, 0.0) for i in range(40)] + [(99, None, 1.0)], "point_id long, p_lat double, p_lon double")
    pairs = [r.asDict() for r in lookup.within(points, places, 60.0).collect()]
    order = lambda r: (r["km"], r["place_id"], r["name"])
    of = lambda i, ok=lambda r: True: sorted((r for r in pairs if r["point_id"] == i and ok(r)), key=order)
    got = sorted((r.point_id, r.rank, r.place_id) for r in lookup.nearest(points, places, 60.0).collect())
    assert got == [(i, n, r["place_id"]) for i in range(40) for n, r in enumerate(of(i)[:25], 1)] and len(got) == 1000
    for r in lookup.reverse_geocode(points, places).collect():
        close = of(r.point_id, lambda x: x["km"] <= 50)
        city = [x for x in close if x["feat_class"] == "P" and x["km"] <= 25]
        want = (city or [x for x in close if x["adm1"]])[0]
        assert (r.method, r.place_id, r.nearby) == ("city" if city else "province", want["place_id"], [x["name"] for x in close[:5]])
    for r in lookup.expanding(points, places, (5, 30, 60)).collect():
        want = min(of(r.point_id), key=lambda x: (next(t for t in (5, 30, 60) if x["km"] <= t), {"P": 0, "A": 1}.get(x["feat_class"], 2), *order(x)))
        assert r.place_id == want["place_id"]
    few = lookup.within(lookup._spots(points), lookup._first_of_spot(places, 25), 60.0)
    assert few.count() <= 4 * 6 * 25 < len(pairs)


def test_postal_codes_of_large_keys_are_whole(spark, tmp_path):
    spark.createDataFrame([(7, 1), (95_000, 1), (1_234_567, 1)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, "NATION_01", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    names = {r.name for r in X.postal_gazetteer(spark, str(tmp_path)).collect()}
    assert names == {"10007", "105000", "1244567"} == {r.text.split()[-1] for r in X.postal_texts(spark, str(tmp_path)).collect()}


def test_a_code_within_a_name_is_no_code(spark):
    """'Customer 12345, N 22345': of another province of the country, 12345 would take N for its own."""
    columns = "doc_id long, start int, end int, text string, after string, place_id string, name string, cc string, adm1 string, feat_class string, feat_code string"
    post = spark.createDataFrame([(1, 9, 14, "12345", ", N 22345", "R0/02/12345", "12345", "R0", "02", "A", "POST"), (1, 18, 23, "22345", "", "R0/01/22345", "22345", "R0", "01", "A", "POST")], columns)
    names = spark.createDataFrame([(1, 0, 14, "Customer 12345", ", N 22345", "C", "Customer 12345", "R0", "01", "P", "PPL"), (1, 16, 17, "N", " 22345", "N", "N", "R0", "01", "A", "ADM1")], columns)
    assert [(r.text, r.c_start, r.c_end, r.links) for r in postal.linked(postal.pairs(post, names)).collect()] == [("22345", 0, 23, 2)]


def test_codes(spark):
    assert value(spark, "us.06", C.admin_code) == "06" and value(spark, "6", C.admin_code) == "06"
    assert value(spark, "en-US", C.primary_language) == "en" and value(spark, "xx", C.countries_speaking) is None


def test_annotations_omit_nulls_and_raise_on_unknown(spark):
    rows = spark.createDataFrame([(1, 0, 3, "abc", "place", 5, 0.0, 0.0)], "doc_id long, start int, end int, text string, type string, confidence int, lat double, lon double")
    text = sinks.annotations(rows).first().json
    assert "lat" not in text and '"filtered":true' in text
    with pytest.raises(Exception, match="unknown annotation type"):
        sinks.parsed(spark.createDataFrame([(1, '{"type":"nope"}')], "doc_id long, json string")).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "text": "x"}\n{"docid": "2", "text": null}\n')
    assert [tuple(r) for r in readers.documents(spark, str(tmp_path / "a.json")).orderBy("doc_id").collect()] == [("1", "x", None), ("2", None, None)]
    (tmp_path / "stop.txt").write_text("# note\nAnd | joins\n\nor\n")
    assert {r.term for r in readers.stop_words(spark, str(tmp_path / "stop.txt"), "en").collect()} == {"and", "or"}
    (tmp_path / "g.txt").write_text("1\tÄb\tAb\tx,y\t1.5\t2.5\tP\tPPL\tDE\t\t01\t\t\t\t5\t\t\t\t\n")
    assert readers.geonames(spark, str(tmp_path / "g.txt")).count() == 4


def test_postal_years_and_variants(spark):
    gaz = spark.createDataFrame([("1", "Saint Mary", "N", "US"), ("2", "San Xi", "N", "CN"), ("3", "Mount", "N", "US")], "place_id string, name string, name_type string, cc string")
    assert [r.name for r in etl.variants(gaz).collect()] == ["St. Mary"]
    assert spark.range(1).select(postal.confidence(F.lit(2), F.lit(3), F.lit(7), F.lit(5)).alias("c")).first().c == 31


def test_a_rule_counts_once(spark):
    cands = spark.createDataFrame([(1, 0, 3, "p")], "doc_id long, start int, end int, place_id string")
    one = rules.contribution(cands, "A", F.lit(2.0))
    assert rules.totals(cands, [one, one, rules.contribution(cands, "B", F.lit(1.0))]).first().score == 3.0


@pytest.mark.parametrize("text", ["New York City, new york; York É ß Straße", "a\0b 😀 c", "", "x" * 300_000 + " y", "ab-cd " * 60_000, "İstanbul ǅ æon"])
def test_words_in_numpy_are_those_of_the_expressions(spark, text):
    want = value(spark, text, T.tokens)
    of, start, end, _ = W.found([None, text])
    assert [(int(s), int(e)) for s, e in zip(start, end)] == [(w.start, w.end) for w in want] and set(of.tolist()) <= {1}


def test_both_ways_of_tagging_agree(spark, monkeypatch):
    """The compiled dictionary and the joins, with all three treatments of overlaps."""
    docs = spark.createDataFrame([(1, "New York City, new york; York STRASSE straße", "en"), (2, "北京 and 上海市 ok", "zh"), (3, None, "en"), (4, "", "en"), (5, "a b c d e f g", "en")], "doc_id long, text string, lang string")
    names = [("New York", "en"), ("York City", "en"), ("york", "en"), ("Straße", "en"), ("上海", "zh"), ("b c d", "en"), ("d e", "en"), ("c d", "en"), ("a b", "en")]
    words = tagger.phrases(spark.createDataFrame(names, "name string, lang string"), lang="lang")
    columns = ("doc_id", "start", "end", "phrase", "text", "before", "after")
    rows = lambda how: sorted(map(tuple, tagger.tag(docs, words, "lang", overlaps=how).select(*columns).collect()))
    compiled = {how: rows(how) for how in ("all", "no_sub", "longest_dominant_right")}
    monkeypatch.setattr(tagger, "COMPILED", 0)
    assert {how: rows(how) for how in compiled} == compiled and len(compiled["all"]) > len(compiled["longest_dominant_right"]) > 3
    assert [r[4] for r in compiled["all"] if r[0] == 2] == ["上海"]


def test_a_large_dictionary_is_compiled(spark, monkeypatch):
    """Over 200,000 phrases, which went by joins before; the sent one finds what a list does, and nothing that shares a hash."""
    rows = spark.range(250_000).select(F.concat(F.lit("customer "), F.col("id").cast("string")).alias("phrase")).unionAll(spark.createDataFrame([("europe",), (None,), ("not-words",), (" blank",), ("Upper",), ("two  blanks",)], "phrase string"))
    known = tagger.compiled(rows)
    assert known.size == 250_002  # "Upper" is never found, as texts are folded
    docs = spark.createDataFrame([(1, "Customer 249999, EUROPE; customer 250000 not-words Upper two  blanks")], "doc_id long, text string")
    want = [("customer 249999", 0, 15), ("europe", 17, 23)]
    assert sorted((r.phrase, r.start, r.end) for r in tagger.tag(docs, known).collect()) == want
    few = ["customer 249999", "europe", "customer 1"]
    monkeypatch.setattr(W, "_chain", lambda first, following: first * 0)
    assert [h[3] for h in W.Phrases(few).match(["Customer 249999, EUROPE; Customer 2"])] == ["customer 249999", "europe"]


def test_candidates_leave_what_the_windows_over_spans_left(spark):
    """Crowded phrases and codes spelt otherwise are settled in the gazetteer."""
    town = [(f"T{i}", "Aton", "N", "H" if i < 5 else "P", "PPLH" if 5 <= i < 10 else "PPL") for i in range(110)]
    code = [("c1", "ATON", "C", "A", "ADM1"), ("c2", "B.C", "A", "A", "ADM1"), ("c3", "EFG", "C", "A", "ADM1"), ("c4", "Efg", "N", "P", "PPL"), ("c5", "Xy-Z", "C", "A", "ADM1"), ("c6", "xy z", None, "A", "ADM1")]
    gaz = tagger.phrases(spark.createDataFrame(town + code, "place_id string, name string, name_type string, feat_class string, feat_code string"))
    for c, v in (("cc", F.lit("R0")), ("adm1", F.lit("01")), ("lat", F.lit(1.0)), ("lon", F.lit(1.0)), ("id_bias", F.lit(1))):
        gaz = gaz.withColumn(c, v)
    docs = spark.createDataFrame([(1, "In Aton and ATON, B.C. or EFG, then Xy-Z, XY Z"), (2, "B C")], "doc_id long, text string")
    spans = geocoder.mentions(docs, gaz)
    old = filters.code_mismatch(filters.crowded(spans.join(gaz.select("phrase", *geocoder._NAMES), "phrase")))
    rows = lambda df: sorted((r.doc_id, r.start, r.text, r.place_id) for r in df.collect())
    got = rows(geocoder.candidates(docs, gaz))
    assert got == rows(old) and len(got) > 200 and {r[3] for r in got} >= {"c3", "c4"}


def test_equal_texts_and_places_are_worked_on_once(spark):
    """geocode() as with every document and every place by itself, which a rule of the caller's own asks for."""
    town = [(f"T{i:02}", "Aton", "N", "R0", f"0{i % 2}", "P", "PPL", 1.0, 1.0 + i % 3, 45) for i in range(40)]
    more = [("T00", "ATON", "N", "R0", "00", "P", "PPL", 1.0, 1.0, 45), ("T01", "Aton", "N", "R0", "01", "P", "PPL", 1.0, 2.0, 45), ("B", "Bury", "N", "R0", "01", "A", "ADM1", 1.0, 1.0, 65), ("C", "Bury", "N", "R1", "01", "A", "ADM1", 1.0, 1.0, 65)]
    gaz = tagger.phrases(spark.createDataFrame(town + more, "place_id string, name string, name_type string, cc string, adm1 string, feat_class string, feat_code string, lat double, lon double, id_bias int"))
    docs = spark.createDataFrame([(i, "They met in Aton, Bury last week." if i % 2 else "Bury, Bury or Aton") for i in range(30)] + [(31, None), (32, ""), (33, "Aton"), (33, "Aton"), (34, "Aton"), (35, "ATON"), (35, "in Bury")], "doc_id long, text string")
    assert dict(map(tuple, geocoder.same_texts(docs).collect())) == {i: 1 if i % 2 else 0 for i in range(30)} | {31: 31, 32: 32, 33: 33, 34: 34, 35: 35}
    few = geocoder.places_of(geocoder.mentions(docs.where("doc_id = 34"), gaz), gaz, alike=True)
    assert few.count() < 25 and few.agg(F.sum("weight")).first()[0] == 42
    own = geocoder.Parameters(tag_coordinates=False, user_rules=(lambda c: rules.contribution(c.where("false"), "Own", F.lit(0.0)),))
    rows = lambda params: sorted(map(str, geocoder.geocode(docs, gaz, params).collect()))
    got = rows(geocoder.Parameters(tag_coordinates=False))
    assert got == rows(own) and len(got) > 40


def test_slices_are_bounded_in_characters(spark):
    """Five hundred long texts were worked on at once; a batch now goes in parts of a million bytes, a longer text alone."""
    texts = ["x" * n for n in (10, 600_000, 500_000, 3_000_000, 5)] + [None, ""] * 400 + ["y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = [p.column(1).to_pylist() for p in tagger.slices(batch.slice(1), 1)]
    assert sum(parts, []) == texts[1:] and all(len(p) <= 500 and (len(p) == 1 or sum(len(t or "") for t in p) <= tagger.CHARS) for p in parts)
    assert [len(p) for p in parts][:4] == [1, 1, 1, 500] and list(tagger.slices(batch.slice(0, 0), 1)) == []


def test_rules_keep_documents_in_one_partition(spark):
    """Heat map, pairs and totals shuffle their candidates once, by document, and don't join them with themselves."""
    cands = spark.createDataFrame([], "doc_id long, start int, end int, text string, phrase string, before string, after string, place_id string, name string, name_type string, cc string, adm1 string, feat_class string, feat_code string, lat double, lon double, id_bias int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation,org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation")
    try:
        for df in (rules.heat_map(cands), rules.name_code_pairs(cands), rules.chosen(rules.totals(cands, [rules.default_score(cands), rules.name_rule(cands)]))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.optimizer.excludedRules")


def test_coordinates_meet_places_across_bands(spark):
    place = spark.createDataFrame([(1, 0, 4, "p", 10.0999, 5.0), (1, 9, 12, "q", 10.5, 5.0)], "doc_id int, start int, end int, place_id string, lat double, lon double")
    coords = spark.createDataFrame([(1, 10.1601, 5.0), (1, 10.04, 5.0)], "doc_id int, lat double, lon double")
    got = rules.coordinate_rule(place, coords).collect()
    assert [r.place_id for r in got] == ["p"] and got[0].score == pytest.approx(5 * (10 - 6.66) / 10, abs=0.01)


def test_stream_is_run(spark, tmp_path):
    spark.createDataFrame([(1, "mail a.b@c.example")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    stream.by_batch(docs, lambda b: stream.life(b).select("doc_id", "rule"), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r.rule for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"EMAIL"}
