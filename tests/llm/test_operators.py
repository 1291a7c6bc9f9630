"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd input."""

import hashlib
import itertools
import math
import os
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geospan.llm import archive, bpe, kernel, langid, lm, mixing, neardup, outliers, scratch, sharding, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 60_000


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, an empty and a very long text, repeated rows, and columns with clashing names."""
    rows = [(None, "a b c d", "en", "x"), (1, None, "en", "x"), (2, "", "en", "x"), (3, LONG, None, "x"), (4, "one two three four", "en", None), (4, "one two three four", "en", None), (5, "one two three four", "en", "x"), (6, "!!! ...", None, None)]
    extra = [F.lit(i).alias(n) for i, n in enumerate(("score", "toxic", "id", "sig", "key", "copy", "n", "u", "shard", "rate", "c0", "__rejected", "__toxic", "__slot", "slot", "_shard", "l_id", "whole", "text_hash", "kept", "r_source"))]
    return docs_of(spark, rows).select("*", *extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1
def _toxic_texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    y = rng.integers(0, 2, n)
    return [" ".join(rng.choice(words, rng.integers(20, 80))) + (f" bad{rng.integers(0, 5)} " if t else " ") + " ".join(rng.choice(words, 10)) for t in y], y


def test_toxicity_held_out_and_learnt_by_training():
    """From a random start; without training hardly better than taking every document."""
    texts, y = _toxic_texts(600, 1)
    new, truth = _toxic_texts(300, 2)

    def accuracy(net):
        cut = toxicity.best_threshold(net.score(texts), y)
        return ((net.score(new) >= cut) == truth).mean()

    assert accuracy(toxicity.train(texts, y)) > 0.95
    assert accuracy(toxicity.train(texts, y, epochs=0)) < 0.7


def test_toxicity_against_loops_and_numeric_gradients():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in (1, 2, 7, 12)]
    net = toxicity.start(5)
    net.bias += rng.normal(0, 0.1, len(net.bias)).astype(np.float32)
    ids, offsets = toxicity.read(texts)
    want = []
    for i in range(len(texts)):
        x = [net.table[r].sum(axis=0) for r in ids[offsets[i] : offsets[i + 1]]]
        pad = [np.zeros(toxicity.DIM)] * 2
        total, f, column = net.out_bias, 0, 0
        for width, n in toxicity.FILTERS.items():
            k = net.kernels[:, column : column + width * n].reshape(toxicity.DIM, width, n)
            best = np.max([sum(k[:, j].T @ (x + pad)[at + j] for j in range(width)) for at in range(len(x))], axis=0)
            total += np.maximum(best + net.bias[f : f + n], 0) @ net.out[f : f + n]
            f, column = f + n, column + width * n
        want.append(total)
    assert np.allclose(net.logits(ids, offsets), want, atol=1e-4)
    batch = toxicity.Batch(ids, offsets, np.array([1, 0, 1, 0], np.float32), np.full(4, 0.25), np.ones((4, len(net.out)), np.float32))
    g = toxicity.gradient(net, batch)
    for value, grad in ((net.kernels, g.kernels), (net.bias, g.bias), (net.out, g.out)):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old = value[at]
        value[at] = old + 2e-3
        up = toxicity.gradient(net, batch).loss
        value[at] = old - 2e-3
        down = toxicity.gradient(net, batch).loss
        value[at] = old
        assert (up - down) / 4e-3 == pytest.approx(grad[at], rel=0.05, abs=1e-4)
    r = int(np.argmax(np.abs(g.table).sum(axis=1)))
    k = int(np.argmax(np.abs(g.table[r])))
    old = net.table[g.rows[r], k]
    net.table[g.rows[r], k] = old + 2e-3
    up = toxicity.gradient(net, batch).loss
    net.table[g.rows[r], k] = old - 2e-3
    assert (up - toxicity.gradient(net, batch).loss) / 4e-3 == pytest.approx(g.table[r, k], rel=0.05, abs=1e-4)


def _toxicity_model(texts, y):
    net = toxicity.train(texts, y)
    return toxicity.Model(net, {}, toxicity.best_threshold(net.score(texts), y))


def test_toxicity_odd(spark, odd, empty):
    texts, y = _toxic_texts(300, 1)
    model = _toxicity_model(texts, y)
    rows = toxicity.classify(odd, model).collect()
    assert len(rows) == 8
    assert all(r.score == 0 and not r.toxic for r in rows if r.doc_id in (1, 2, 6))
    assert toxicity.annotate(odd, model, ("a", "b")).columns == [*odd.columns, "a", "b"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(empty, labels) is None
    assert all(r.score is None and not r.toxic for r in toxicity.classify(odd, None).collect())
    assert toxicity.classify(empty, model).count() == 0


def test_fits_take_a_repeated_id_once(spark):
    """Ten thousand rows of one id, labelled both ways, beside a few others."""
    same = spark.range(10_000).selectExpr("7L as doc_id", "concat('good text number ', id) as text", "'en' as lang", "'x' as source", "1L as n_chars")
    others = docs_of(spark, [(100 + i, ("awful words here " if i % 2 else "nice words there ") * 4, "en" if i % 3 else "fr", "x") for i in range(60)])
    docs = same.unionAll(others)
    labels = spark.createDataFrame([(7, 1, 0)] * 50 + [(100 + i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert model is not None
    assert toxicity.classify(others, model).where("toxic").count() > 20
    assert langid.fit(docs).languages == ["en", "fr"]


def test_toxicity_thresholds_at_the_natural_rate(spark):
    """Of the toxic documents 30% and of the others 5% are of a kind that says 'maybe': at one in twenty it isn't worth it to take them, in a sample of halves it is."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(4200):
        bad = i % 21 == 0
        maybe = (i // 21) % 10 < 3 if bad else (i * 7 // 3) % 20 == 0
        words = [f"w{k}" for k in rng.integers(0, 200, 12)]
        words[int(rng.integers(0, 12))] = "maybe" if maybe else ("awful" if bad else "w1")
        rows.append((i, " ".join(words), "fr" if i % 5 == 0 else "en", "x"))
        labels.append((i, 1, int(bad)))
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows=100)
    assert set(model.thresholds) == {"en", "fr"}
    maybe = F.array_contains(F.split("text", " "), "maybe")
    got = toxicity.annotate(docs, model, ("p", "bad"))
    assert got.where(maybe & F.col("bad")).count() <= 0.1 * docs.where(maybe).count()
    assert got.where(F.array_contains(F.split("text", " "), "awful") & F.col("bad")).count() >= 130


# 2
def test_hamming_join_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (40, neardup.K)).astype(np.uint16)
    sig = np.concatenate([base] + [np.where(rng.random(base.shape) < q, rng.integers(0, 1 << 16, base.shape), base).astype(np.uint16) for q in (0.1, 0.3, 0.45, 0.5)])
    keys = neardup.keys(sig)
    near = 0
    for i, j in itertools.combinations(range(len(sig)), 2):
        if (sig[i] != sig[j]).sum() <= neardup.RADIUS:
            near += 1
            assert (keys[i] == keys[j]).any()
    assert near > 50


def test_near_pairs_and_groups_against_brute_force(spark, real):
    docs = real.where("text is not null")
    rows = docs.select("doc_id", "text").collect()
    sig, some = neardup.signatures([r.text for r in rows])
    ids = [r.doc_id for r in rows]
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in itertools.combinations(range(len(ids)), 2) if some[i] and some[j] and (sig[i] != sig[j]).sum() <= neardup.RADIUS}
    assert {tuple(r) for r in neardup.near_pairs(docs).collect()} == want
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(want):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {r.doc_id: r.group_id for r in neardup.groups(docs).collect()} == {i: find(i) for i in ids}


def test_dedup_odd(spark, odd, empty):
    got = neardup.groups(odd)
    assert got.count() == 8
    assert {r.group_id for r in got.where("doc_id in (4, 5)").collect()} == {4}
    kept = neardup.stage(spark, odd, SF)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6] and kept.where("doc_id is null").count() == 1
    assert neardup.groups(empty).count() == 0 and neardup.stage(spark, empty, SF).count() == 0


def test_dedup_decides_by_row_and_meets_wordless_copies(spark):
    a, b = "one two three four five six seven", "quite another text with other words in it"
    docs = docs_of(spark, [(3, a, "en", "x"), (5, a, "en", "x"), (5, b, "en", "x"), (5, b, "en", "y"), (8, "?! \U0001f600", "en", "x"), (9, "?! \U0001f600", "en", "x"), (10, "?!", "en", "x")])
    got = sorted((r.doc_id, r.text, r.source) for r in neardup.stage(spark, docs, SF).collect())
    assert got == sorted([(3, a, "x"), (5, b, "x"), (8, "?! \U0001f600", "x"), (10, "?!", "x")])
    assert {(r.doc_id, r.group_size) for r in neardup.groups(docs).collect()} == {(3, 2), (5, 2), (8, 2), (9, 2), (10, 1)}


# 3
def test_sharding_table():
    names = [f"s{i}" for i in range(7)]
    table = neighbours = sharding.fill(names, 1009)
    n = np.bincount(table, minlength=7)
    assert n.max() - n.min() <= 1
    fewer = sharding.fill(names[:-1], 1009)
    stay = table != 6
    assert (fewer[stay] == neighbours[stay]).mean() > 0.75
    # Brute force: every slot goes to the shard that reaches it first, turn by turn.
    free, at, want = set(range(1009)), [0] * 7, {}
    while free:
        for i, s in enumerate(names):
            while free:
                slot = (sharding._hash(s, "offset") % 1009 + at[i] * (sharding._hash(s, "skip") % 1008 + 1)) % 1009
                at[i] += 1
                if slot in free:
                    free.discard(slot)
                    want[slot] = i
                    break
    assert [want[i] for i in range(1009)] == table.tolist()
    for bad in ([], ["a", "a"], [f"s{i}" for i in range(20)]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 11)


def test_sharding_odd(spark, odd, empty, tmp_path):
    got = sharding.place(odd).collect()
    assert len(got) == 8 and len({r.shard for r in got if r.doc_id == 4}) == 1
    assert sharding.place(empty).count() == 0
    sharding.write(odd, str(tmp_path / "s"), ["a", "b"], 11)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 8 and set(back.columns) == {*odd.columns, "__shard"} and back.where("__slot = 13").count() == 8
    some = {r.doc_id: r for r in got}
    for i in (None, 1, 4):  # placement by hand
        slot = int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:15], 16) % sharding.SIZE
        assert some[i].slot == slot and some[i].shard == sorted(sharding.SHARDS)[sharding.fill(sharding.SHARDS)[slot]]


# 4
def test_language_held_out(spark, real):
    rows = [r for r in real.collect() if r.text and r.lang and len(r.text) > 40]
    model = langid.train([r.text for r in rows[::2]], [r.lang for r in rows[::2]])
    sums, _ = model.score([r.text for r in rows[1::2]])
    assert np.mean([model.languages[k] == r.lang for k, r in zip(sums.argmax(axis=1), rows[1::2])]) > 0.9


def test_language_scores_are_sums_of_log_probabilities():
    model = langid.train(["abc abd", "xyz xyw"], ["a", "b"], buckets=1 << 12)
    one, n = model.score(["abc"])
    two, m = model.score(["abc abc", "abc"])
    assert n[0] == 9 and m[0] == 18 and np.allclose(two[1], one[0]) and one[0].argmax() == 0


def test_language_odd(odd, empty):
    model = langid.train(["hello there my friend"] * 3, ["en"] * 3)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert rows[1].pred_lang == rows[2].pred_lang == rows[6].pred_lang == "und" and rows[1].rejected and rows[1].score is None
    assert langid.fit(empty) is None and langid.identify(empty, model).count() == 0
    assert all(r.pred_lang is None and not r.rejected for r in langid.identify(odd, None).collect())


def test_language_rejects_what_is_of_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(4)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    texts = [letters("0123456789abcdef", 600), " ".join(letters("0123456789abcdef", 16) for _ in range(40)), " ".join(letters("abcdefghijklmnopqrstuvwxyz", 6) for _ in range(60))]
    texts.append("Suomen kieli on yksi uralilaisista kielistä ja sitä puhutaan pääasiassa Suomessa sekä Ruotsissa että Norjassa")
    texts.append("Wszystkie zwierzęta są równe, ale niektóre są równiejsze od innych, powiedział stary człowiek")
    # One odd document under each label doesn't move a threshold.
    odd = docs_of(spark, [(10**7 + i, letters("bcdfghjklmnpqrstvwxz", 400), x, "x") for i, x in enumerate(("de", "en", "es", "fr"))])
    model = langid.fit(docs.unionAll(odd))
    got = langid.identify(docs_of(spark, [(i, x, None, "x") for i, x in enumerate(texts)]), model).collect()
    assert all(r.rejected for r in got)
    kept = langid.identify(docs.where("lang is not null"), model).where("score is not null")
    assert kept.where("rejected").count() <= 0.002 * kept.count()
    short = langid.identify(docs_of(spark, [(i, x, None, "x") for i, x in enumerate(("the", "and the", "une", "der", "la"))]), model)
    assert short.where("rejected").count() == 0


def test_language_scores_against_loops(spark):
    """Every n-gram's log-probability looked up one by one, from counts made by hand."""
    texts, langs = ["ab ba.", "cab"], ["x", "y"]
    model = langid.train(texts, langs, buckets=1 << 12)

    def grams(text):
        codes = np.frombuffer(("\0" + text.lower() + "\0").encode("utf-32-le"), np.uint32)
        x = [int(c) if chr(c).isalpha() else 0 for c in codes]
        out = []
        for i, c in enumerate(x):
            if c:
                one = (c * 0x9E3779B1 + 1) & 0xFFFFFFFF
                two = (x[i - 1] * 0x85EBCA77 + one * 3) & 0xFFFFFFFF
                three = (x[i + 1] * 0xC2B2AE3D + two * 5) & 0xFFFFFFFF
                for h in (one, two, three):
                    h ^= h >> 15
                    h = h * 0x2C1B3C6D & 0xFFFFFFFF
                    h ^= h >> 12
                    out.append((h * 0x297A2D39 & 0xFFFFFFFF) >> 20)
        return out

    tables = []
    for t in texts:
        n = [langid.SMOOTHING] * (1 << 12)
        for g in grams(t):
            n[g] += 1
        tables.append([math.log(v / sum(n)) for v in n])
    got, n = model.score(["bac, ab"])
    assert n[0] == len(grams("bac, ab"))
    assert np.allclose(got[0], [sum(t[g] for g in grams("bac, ab")) for t in tables], atol=1e-3)


# 5
def test_warc_round_trip_and_zip64(spark, tmp_path):
    rows = [(1, "http://a/?x=1", "<p>é</p>"), (1, "http://a/?x=1", "<p>é</p>"), (None, None, None), (2, "", ""), (3, "odd\nurl é", "x\r\n\r\ny" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    packs = archive.package(pages.select("*", F.lit(1).alias("uri")), f"file://{tmp_path}/p", size=1)
    listed = packs.collect()
    uris = spark.createDataFrame([(r.uri,) for r in listed], "uri string")
    got = [(r.page_id, r.url, r.html) for r in archive.read(uris).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))
    with archive.opened(listed[0].uri) as f:  # the library's reader agrees on where members are
        mine = {m.name: m for m in archive.directory(f)}
        theirs = zipfile.ZipFile(listed[0].uri.removeprefix("file://"))
        assert {n: m.header for n, m in mine.items()} == {i.filename: i.header_offset for i in theirs.infolist()}
        m = mine["archive/data.warc.gz"]
        assert archive._at(f, archive.data_offset(f, m), m.size) == theirs.read(m.name)


def test_warc_zip64_central_directory_and_partial_index(spark, tmp_path, monkeypatch):
    z = tmp_path / "z64.wacz"
    records = [archive.record(i, f"http://b/{i}", "hi" * i, "2024-01-01T00:00:00Z") for i in range(5)]
    places = np.append(0, np.cumsum([len(r) for r in records])).tolist()
    lines = "".join(f'k 2024 {{"filename": "a.warc", "offset": "{places[i]}", "length": "{len(records[i])}"}}\n' for i in (1, 3))
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)  # offsets and sizes go to the ZIP64 fields, in the central directory too
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)  # and a ZIP64 end record is written
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("archive/a.warc", b"".join(records))
        f.writestr("indexes/i.cdxj", lines)
    monkeypatch.undo()
    assert b"PK\x06\x06" in z.read_bytes()
    got = archive.read(spark.createDataFrame([(f"file://{z}",)], "uri string")).collect()
    assert sorted((r.page_id, r.html) for r in got) == [(i, "hi" * i) for i in range(5)]  # those that no index names too


def test_warc_empty_and_broken(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive.package(none, f"file://{tmp_path}/n").count() == 0
    bad = tmp_path / "bad.wacz"
    bad.write_bytes(b"no zip")
    with pytest.raises(ValueError):
        list(archive.entries(f"file://{bad}"))
    z = tmp_path / "z.wacz"
    with zipfile.ZipFile(z, "w") as f:  # no index: the member is walked
        f.writestr("archive/a.warc", archive.record(7, "http://b", "hi", "2024-01-01T00:00:00Z") * 2)
    found = list(archive.entries(f"file://{z}"))
    assert len(found) == 2 and archive.parsed(z.read_bytes()[found[1].offset : found[1].offset + found[1].length])["page_id"] == 7


# 6
def test_bpe_equals_public_tokenizer_and_decodes(spark, real, odd, empty):
    import tiktoken

    ranks = bpe.load()
    enc = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text or "" for r in real.collect()] + ["", "a" * 3000, "<|endoftext|> 😀 ñ 漢字 \r\n\t  x", LONG[:50_000], "ſpecial ªº"]
    codec = bpe.Codec(ranks)
    tokens, offsets = codec.encode(texts)
    assert all(tokens[offsets[i] : offsets[i + 1]].tolist() == enc.encode_ordinary(t) for i, t in enumerate(texts))
    assert codec.stats["exact"] > 0
    back = bpe.decode(bpe.encode(odd)).collect()
    plain = sorted(str((r.doc_id, r.text)) for r in odd.collect())
    assert sorted(str((r.doc_id, r.text)) for r in back) == plain
    assert all(r.tokens is None and r.n_tokens is None for r in back if r.doc_id == 1)
    assert bpe.encode(empty).count() == 0


def test_bpe_there_and_back_in_one_python_step(spark, odd, empty):
    """As decode(encode()), but no task holds two workers."""
    key = lambda df: sorted(map(str, df.collect()))
    both = bpe.there_and_back(odd)
    assert key(both) == key(bpe.decode(bpe.encode(odd))) and both.schema == bpe.decode(bpe.encode(odd)).schema
    assert bpe.there_and_back(empty).count() == 0
    for df in (bpe.stage(spark, odd, SF), bpe.op6_bpe(spark, SF)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_fits_send_their_samples_without_python_rows(spark, real, monkeypatch):
    """Rows given as tuples go through parallelize() and a second set of Python workers beside that of the batches."""

    def parallelize(*_, **__):
        raise AssertionError("a table of tuples")

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    assert langid.fit(real) is not None and toxicity.fit(real, labels) is not None


# 7
def test_mixing_counts_and_order(spark, odd, empty):
    docs = docs_of(spark, [(i, "x" * 10, "en", "a" if i % 4 else "b") for i in range(4000)])
    rate = {r.source: r.rate for r in mixing.rates(docs, {"a": 1.0, "b": 1.0}).collect()}
    assert rate["a"] == pytest.approx(2 / 3) and rate["b"] == pytest.approx(2)
    out = mixing.replicate(docs, mixing.rates(docs, {"a": 1.0, "b": 1.0}), parts=3).collect()
    n = {s: sum(r.source == s for r in out) for s in "ab"}
    assert abs(n["a"] - 2000) < 200 and abs(n["b"] - 2000) < 200
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)
    again = mixing.replicate(docs, mixing.rates(docs, {"a": 1.0, "b": 1.0}), parts=3).collect()
    assert out == again
    kept = mixing.stage(spark, odd, SF)
    assert kept.columns == odd.columns
    # A null source is a source; one of weight 0 or of no characters goes; repeated rows draw alike.
    few = docs_of(spark, [(i, "abc", "en", None) for i in range(200)] + [(900, "abc", "en", "zero"), (901, "", "en", "void"), (902, None, "en", "void")] + [(7, "abc", "en", None)] * 3)
    rate = {r.source: r.rate for r in mixing.rates(few, {None: 1.0, "void": 1.0}).collect()}
    assert rate["zero"] == rate["void"] == 0 and rate[None] > 0
    drawn = mixing.replicate(few, mixing.rates(few, {None: 1.0, "void": 1.0})).collect()
    assert {r.source for r in drawn} == {None} and sum(r.doc_id == 7 for r in drawn) % 4 == 0


def test_mixing_beyond_the_broadcast_limit(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"text {i}", "en", None if i % 5 == 0 else f"s{i % 4}") for i in range(500)])
    rate = mixing.rates(docs)
    want = sorted(map(str, mixing.replicate(docs, rate, parts=3).collect()))
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(map(str, mixing.replicate(docs, rate, parts=3).collect())) == want


def test_poisson_distribution(spark):
    rates = [0.3, 2.0, 400.0]
    got = {r.r_source: r.r_cdf for r in mixing.cumulative(spark.createDataFrame([(str(r), r) for r in [*rates, 0.0]], "source string, rate double")).collect()}
    assert len(got) == 3
    for r in rates:
        want = np.cumsum([math.exp(k * math.log(r) - r - math.lgamma(k + 1)) for k in range(len(got[str(r)]))])
        assert np.allclose(got[str(r)], want, atol=1e-9) and want[-1] > 1 - 1e-12


def test_mixing_empty(spark, empty):
    assert mixing.replicate(empty, mixing.rates(empty)).count() == 0


# 8
def test_lm_probabilities_sum_to_one():
    w = lm.start(np.arange(lm.SIZE))
    around = [np.array([5] * lm.SIZE)] * (2 * lm.SIDE)
    p = np.exp(lm.forward(w, around, np.arange(lm.SIZE))[0])
    assert p.sum() == pytest.approx(1, abs=1e-3)


def test_lm_score_against_brute_force_and_learning():
    rng = np.random.default_rng(0)
    ids = np.tile(np.array([1, 2, 3, 4, 5], np.int32), 4000)
    offsets = np.arange(0, len(ids) + 1, 50)
    w = lm.start(np.bincount(ids, minlength=lm.SIZE))
    before = lm.score(w, ids, offsets).sum()
    lm.train(w, iter([(ids, offsets)]))
    got = lm.score(w, ids, offsets)
    assert got.sum() > before * 0.5
    doc = ids[:50]
    seq = np.concatenate([[lm.SIZE] * lm.SIDE, doc, [lm.SIZE] * lm.SIDE]).astype(np.int32)
    total = sum(float(lm.forward(w, [seq[[i + lm.SIDE + d]] for d in (-2, -1, 1, 2)], doc[[i]])[0][0]) for i in range(50))
    assert got[0] == pytest.approx(total, rel=1e-4)
    assert lm.score(w, rng.permutation(ids).astype(np.int32), offsets).sum() < got.sum()


def test_lm_odd(odd, empty):
    rows = {r.doc_id: r for r in lm.score_documents(odd, lm.fit(odd)).collect()}
    assert rows[1].n_tokens == 0 and rows[1].log_likelihood == 0 and rows[2].mean_log_likelihood is None
    assert rows[3].n_tokens == 300_000
    assert lm.score_texts(lm.fit(empty)).count() == 0


def test_lm_does_not_hang_on_partitions(real, monkeypatch):
    monkeypatch.setattr(lm, "TOKENS_PER_ID", 3)  # several shards
    one, other = ({r.doc_id: r.log_likelihood for r in lm.score_texts(lm.fit(real.repartition(n))).collect()} for n in (1, 5))
    assert one.keys() == other.keys() and all(one[i] == pytest.approx(other[i], rel=1e-5) for i in one)


def test_lm_averages_rows_by_how_often_they_were_trained():
    w = lm.start(np.arange(lm.SIZE))
    rows = [(np.array([3.0, 0.0, 0.0]), np.full((3, 2), 1.0, np.float32)), (np.array([1.0, 2.0, 0.0]), np.full((3, 2), 5.0, np.float32))]
    table = pa.table({"n": pa.array([n.tobytes() for n, _ in rows], pa.binary()), "weights": pa.array([x.tobytes() for _, x in rows], pa.binary())})
    n, x = (np.frombuffer(b, t) for b, t in zip(lm.merged(table), (np.float64, np.float32)))
    assert n.tolist() == [4, 2, 0] and x.reshape(3, 2)[:2].tolist() == [[2, 2], [5, 5]]
    assert sum((hi - lo) * lm.matrices(w)[k].shape[1] for _, k, lo, hi in lm.pieces(w)) == sum(v.size for v in w.values())


def test_lm_trains_on_every_token():
    ids, offsets = np.arange(900, dtype=np.int32) % 40, np.array([0, 300, 300, 301, 900])
    w = lm.start(np.bincount(ids, minlength=lm.SIZE))
    assert lm.train(w, iter([(ids, offsets), (ids[:7], np.array([0, 7]))])) == 907


def test_lm_words_of_a_shared_id_have_probabilities_of_their_own(spark):
    words = [f"w{i}" for i in range(2600)]
    hashes = kernel.words([" ".join(words)])[0]
    bucket = (hashes >> np.uint64(40)) % np.uint64(lm.HASHED)
    mates = next(m for m in (np.flatnonzero(bucket == b) for b in range(lm.HASHED)) if len(m) > 2)
    one, other = words[mates[0]], words[mates[1]]
    common = [w for i, w in enumerate(words) if i not in mates[:2]]
    rows = [(1, one, "en", "x"), (2, other, "en", "x"), (3, other, "en", "x"), (4, other, "en", "x"), (5, " ".join(common * 4), "en", "x")]
    docs = docs_of(spark, rows)
    model = lm.fit(docs)
    assert not np.isin(hashes[mates[:2]], model.words).any()
    got = {r.doc_id: r.log_likelihood for r in lm.score_documents(docs, model).collect()}
    assert got[2] == got[3] and got[2] - got[1] == pytest.approx(np.log(3), abs=1e-4)
    assert lm.shape(0) == (64, 32)
    for tokens in (10**7, 10**8, 10**10):
        classes, width = lm.shape(tokens)
        assert classes * width - lm.HASHED >= np.sqrt(tokens) - 1 and abs(classes - width) < 64



def test_lm_work_for_a_token(monkeypatch):
    """Of the model of a corpus of 10^8 tokens, exponentials for each target: fewer than those of all classes and of all tokens of one."""
    classes, width = lm.shape(10**8)
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.2, 20_000), classes * width).astype(np.int32) - 1
    w = lm.start(np.bincount(ids, minlength=classes * width), classes)
    count, exp = [0], np.exp

    def counted(x, *a, **k):
        count[0] += x.size
        return exp(x, *a, **k)

    monkeypatch.setattr(np, "exp", counted)
    offsets = np.arange(0, len(ids) + 1, 500)
    lm.train(w, iter([(ids, offsets)]))
    assert count[0] < 0.9 * len(ids) * (classes + width)
    count[0] = 0
    lm.score(w, ids, offsets)
    assert count[0] < 0.7 * len(ids) * (classes + width)


def test_lm_gradients_against_differences():
    rng = np.random.default_rng(2)
    seq, places = lm.padded(rng.integers(0, 300, 400).astype(np.int32), np.array([0, 0, 150, 151, 400]), lm.SIZE)
    w = lm.start(np.bincount(seq[places], minlength=lm.SIZE))
    w["in_bias"][::2], w["in_bias"][1::2] = 2, -2  # on or off, not near the bend
    new, g = {k: v.copy() for k, v in w.items()}, {k: np.full_like(v, lm.FIRST) for k, v in w.items()}
    lm.step(new, g, seq, places)

    def total(changed):
        return lm.forward(changed, lm.contexts(seq, places), seq[places])[0].sum(dtype=np.float64)

    for name in w:
        d = (new[name].astype(np.float64) - w[name]).reshape(-1) / lm.RATE
        got = d / np.sqrt(1 - d**2) * np.sqrt(lm.FIRST)  # the step undone
        for i in np.argsort(-np.abs(got))[[0, 1, 5, 20]]:
            ends = []
            for e in (-0.001, 0.001):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name].reshape(-1)[i] += e
                ends.append(total(moved))
            assert got[i] == pytest.approx((ends[1] - ends[0]) / 0.002, rel=0.02, abs=0.02), (name, i)


def test_lm_exponentials_of_any_size():
    h, v, s = np.array([[1, 1], [300, 1], [-300, 1]], np.float32), np.array([[1, 0], [0.5, -200]], np.float32), np.empty(3, np.float32)
    with np.errstate(over="ignore"):
        x = lm.exponentials(h, v, s)
    assert (x / s[:, None])[:, 0] == pytest.approx([1, 1, 1], abs=1e-6)


def test_lm_writes_ids_once(spark, real, monkeypatch):
    """Two or four bytes for each id, and neither copies of the network nor the rare words a second time on disk."""
    names, write = [], scratch.materialise
    monkeypatch.setattr(scratch, "materialise", lambda df, name: names.append(name) or write(df, name))
    model = lm.fit(real)
    want = {(r.doc_id, r.n_tokens) for r in lm.score_texts(model).collect()}
    assert sorted(names) == ["encoded", "word-counts"]
    assert {(r.doc_id, r.n // lm.kind(len(model.counts)).itemsize) for r in model.texts.select("doc_id", F.length("ids").alias("n")).collect()} == want
    assert (lm.kind(1 << 16), lm.kind((1 << 16) + 1)) == (np.uint16, np.int32)
    for dtype in (np.uint16, np.int32):
        ids, offsets = np.array([7, 65535, 0], dtype), np.array([0, 0, 2, 2, 3])
        got = lm.unpacked(lm.packed(ids, offsets), np.dtype(dtype))
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == offsets.tolist()


# 9
def test_top_k_odd_and_ties(spark, odd, empty):
    q = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "one"), (4, "zzz")], "item_id long, text string")
    got = topk.search(odd, q).collect()
    assert {r.item_id for r in got} == {1}
    assert sorted((r.rank, r.doc_id) for r in got) == sorted(2 * [(1, 4), (2, 4), (3, 5)])
    assert topk.search(empty, q).count() == 0 and topk.search(odd, q.where("false")).count() == 0


def test_top_k_blocks_and_cut(spark, real, monkeypatch):
    q = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {tuple(r) for r in topk.search(real, q).collect()}
    monkeypatch.setattr(topk, "BATCH", 7)
    assert {tuple(r) for r in topk.search(real, q).collect()} == whole
    score = np.array([3, 9, 9, 1, 0, 9])
    assert topk.best(score, np.array([5, 4, 3, 2, 1, 0]), 2).tolist() == [5, 2]


# 10
def test_mcd_resists_outliers():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (700, outliers.P)), rng.normal(25, 1, (200, outliers.P))])
    mean, cov, _ = outliers.mcd(x)
    assert np.abs(mean).max() < 0.5
    d = outliers.distance2(x, mean, cov)
    assert d[:700].max() < d[700:].min()


@pytest.mark.parametrize("seed", range(4))
def test_mcd_against_all_subsets(seed):
    """The least determinant of all subsets of h rows of 14."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (11, outliers.P)) * rng.uniform(0.5, 2, outliers.P), rng.normal(9, 0.3, (3, outliers.P))])
    scale = np.sqrt(np.diag(outliers.starts(x)[0][1]))
    h = math.ceil(outliers.COVERAGE * len(x))

    def det(some):
        return np.linalg.slogdet(outliers.ridge(np.cov(x[list(some)].T, bias=True), scale, len(x)))[1]

    best = min(det(some) for some in itertools.combinations(range(14), h))
    got = outliers.mcd(x)
    assert got[2] <= best + 0.35  # concentration ends in a local minimum; among all subsets it is near the least
    dets = sorted(det(some) for some in itertools.combinations(range(14), h))
    assert got[2] <= dets[len(dets) // 50]
    assert outliers.distance2(x, *got[:2])[11:].min() > outliers.distance2(x, *got[:2])[:11].max()


def test_mcd_of_all_groups_is_that_of_each(spark):
    rng = np.random.default_rng(7)
    groups = {k: rng.normal(0, 1, (n, outliers.P)) @ rng.normal(0, 1, (outliers.P, outliers.P)) for k, n in (("a", 400), ("b", 90))}
    groups["a"][:80] += 12
    rows = [(k, "*", *map(float, r)) for k, x in groups.items() for r in x]
    got = {r.key: r for r in outliers.estimated(spark.createDataFrame(rows, "key string, parent string, " + ", ".join(f"s{k} double" for k in range(outliers.P)))).collect()}
    for k, x in groups.items():
        mean, cov, det = outliers.mcd(x)
        assert got[k].n == len(x) and got[k].log_det == pytest.approx(det, abs=0.1)
        assert np.allclose(got[k].mean, mean, atol=0.25)


def test_no_floor_where_statistics_vary(spark):
    """Nothing is added to the variances of real groups."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = outliers.with_statistics(outliers.measured(docs).where("words > 0")).toPandas()
    for _, part in rows.groupby(["lang", "source"]):
        if len(part) >= 30:
            x = part[[f"s{k}" for k in range(outliers.P)]].to_numpy()
            assert np.diag(outliers.mcd(x)[1]).min() > 4 * outliers.VANISHED**2


def test_cutoff_is_a_quantile_of_the_chi_square():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(400_000, outliers.P)) ** 2).sum(axis=1)
    assert np.mean(x > outliers.cutoff(1e-3)) == pytest.approx(1e-3, rel=0.2)
    assert outliers.cutoff(0.5) == pytest.approx(outliers.chi_square(0.5))


def test_squared_distance_expression(spark):
    rng = np.random.default_rng(2)
    x, mean = rng.normal(size=outliers.P), rng.normal(size=outliers.P)
    cov = np.cov(rng.normal(size=(outliers.P, 40)))
    row = (*x.tolist(), mean.tolist(), np.linalg.inv(cov).ravel().tolist())
    df = spark.createDataFrame([row], ", ".join(f"s{i} double" for i in range(outliers.P)) + ", mean array<double>, inverse array<double>")
    assert df.select(outliers.squared().alias("d")).first().d == pytest.approx(outliers.distance2(x[None], mean, cov)[0])


def test_outliers_find_junk_and_odd(spark, odd, empty, real):
    junk = docs_of(spark, [(10**6 + i, "## $$ 0101 %% " * 200, "en", "src1") for i in range(2)])
    got = outliers.judged(real.select(*junk.columns).unionAll(junk))
    assert got.where("doc_id >= 1000000 and rejected").count() == 2
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q"))
    seen = got.join(labels, "doc_id").where("n_words > 0")
    assert seen.where("q = 1 and rejected").count() <= 0.06 * seen.where("q = 1").count()
    rows = {r.doc_id: r for r in outliers.judged(odd).collect()}
    assert len(rows) == 8 - 1 and rows[1].rejected and rows[2].rejected and rows[6].rejected and not rows[5].rejected and rows[5].distance2 is not None
    assert outliers.judged(empty).count() == 0


# kernel
def test_words_are_the_same_in_any_cut():
    texts = ["Ab c-d é1 \0 x", "", LONG[:600_000], "İstanbul ab"]
    hashes, offsets, _ = kernel.words(texts)
    assert np.diff(offsets).tolist()[:2] == [5, 0]
    for i, t in enumerate(texts):
        alone, _, _ = kernel.words([t])
        assert (alone == hashes[offsets[i] : offsets[i + 1]]).all()


def test_words_without_a_blank():
    """A text of one word, and one that can only be cut at punctuation; what is made for the first isn't kept."""
    one, many = "x" * 3_000_000, "abc-" * 700_000
    hashes, offsets, _ = kernel.words([one, many, "abc"])
    assert np.diff(offsets).tolist() == [1, 700_000, 1] and (hashes[1:] == hashes[-1]).all()
    assert max(map(len, kernel._usual())) <= 4 * kernel.CHUNK
    assert len(list(kernel.pieces([many]))) > 5


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.shared_dir(Fake)


# pipeline
def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 3, 4, 5} and all(r.text and r.n_tokens == len(r.tokens) for r in got)


def test_pipeline(spark, real, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "tokens", "n_tokens", "text"] and 0 < out.count()
    assert len(corpus_pipeline.STAGES) == 5
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns(spark, odd):
    for stage in (langid.stage, toxicity.stage, neardup.stage, mixing.stage):
        assert stage(spark, odd, SF).columns == odd.columns


def test_no_file_names_machine_local_folders():
    here = os.path.dirname(archive.__file__)
    text = "".join(open(os.path.join(here, f)).read() for f in os.listdir(here) if f.endswith(".py"))
    assert "localCheckpoint" not in text and "gettempdir" not in text and '"/tmp' not in text and text.count("mkdtemp") == 1  # that one only without a cluster
