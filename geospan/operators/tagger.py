"""Tagging: every phrase of a dictionary that occurs in a text, as spans; and what to do when spans overlap.

A dictionary of up to COMPILED phrases is compiled once, its words hashed in parallel, and sent to all tasks: a text is read in
one pass that hashes its words and looks runs of them up, and yields the spans found with their
text and surroundings, so texts never move. tag() is then one narrow step, which also runs on a stream.

Beyond that size words and phrases meet by joins. A text becomes windows of at most K words, K being
the longest phrase. Windows whose first word begins no phrase are dropped by a join before anything
is expanded; those that stay are cut to the lengths that phrases with this first word really have,
and joined with the dictionary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words

TAG_LIMIT = 100_000
TOO_MANY = "a document has more tags than the limit: break up the input"
#: Dictionaries of up to so many phrases (some 26 bytes each) are sent to all tasks, of over so many as a broadcast that a worker reads once.
COMPILED, SENT = 10_000_000, 20_000
#: Texts, their characters, and words, that are worked on at once.
SLICE, CHARS, ROWS = 500, 1_000_000, 20_000


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of up to SLICE rows whose texts, in a column, have up to CHARS bytes together; a longer text is alone."""
    size = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = total[at] - size[at]
        n = max(1, min(SLICE, int(np.searchsorted(total, before + CHARS, "right")) - at))
        yield batch.slice(at, n)
        at += n


def phrases(dictionary: DataFrame, name: str = "name", lang: str | None = None) -> DataFrame:
    """dictionary with phrase, the key that texts are matched by; rows without a word are dropped."""
    plain = F.lower(T.fold(F.col(name)))
    key = F.array_join(F.regexp_extract_all(plain, F.lit(T.WORD), F.lit(0)), " ")
    if lang:
        key = F.when(F.col(lang).isin(*T.CJK_LANGS), T.norm(F.col(name))).otherwise(key)
    return dictionary.withColumn("phrase", key).where("phrase <> ''")


def compiled(dictionary: DataFrame | Iterable[str]) -> words.Phrases | None:
    """The phrases of a dictionary, or None if there are more than COMPILED. The count is bounded where the phrases are read."""
    if not isinstance(dictionary, DataFrame):
        return words.Phrases(dictionary)
    rows = dictionary.where("phrase is not null").select("phrase").distinct()
    if rows.count() > COMPILED:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, n, head, chain = words.hashed(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(n.astype("int32")), *[pa.array(x.view("int64")) for x in (head, chain)]], names=["phrase", "n", "head", "chain"])

    table = rows.mapInArrow(run, "phrase string, n int, head long, chain long").toArrow()
    n, head, chain = (table.column(c).to_numpy() for c in ("n", "head", "chain"))
    return words.Phrases.of(table.column("phrase").cast(pa.large_string()).combine_chunks(), n, head.view("uint64"), chain.view("uint64"))


def tag(docs: DataFrame, dictionary: DataFrame | words.Phrases, lang: str | None = None, window: int = 40, overlaps: str = "all", limit: int | None = None) -> DataFrame:
    """(doc_id, start, end, phrase, text, before, after): a row for each place where a phrase occurs.

    docs: doc_id, text and, if named, a language column. dictionary: a table with phrase, as made by phrases(),
    or what compiled() made of it. A null text has no spans; rows that repeat a doc_id are tagged each. Case and
    diacritics are folded, punctuation between words is passed over. before, after: up to window characters.
    overlaps: 'all', or what no_sub() or longest_dominant_right() keep of a text's spans; limit: as limited().
    """
    choose = {"all": None, "no_sub": words.not_within, "longest_dominant_right": words.dominant}[overlaps]
    known = dictionary if isinstance(dictionary, words.Phrases) else compiled(dictionary)
    if known is None:
        spans = joined_tags(docs, dictionary, lang)
        spans = no_sub(spans) if overlaps == "no_sub" else longest_dominant_right(spans) if overlaps == "longest_dominant_right" else spans
        return with_text(spans if limit is None else limited(spans, limit), docs, window)
    rows = docs.select("doc_id", "text", *([lang] if lang else []))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(known) if known.size > SENT else None
    little = None if sent else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value if sent else little
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                hits = known.match(texts, batch.column(2).to_pylist() if lang else None)
                if choose is not None:
                    hits = words.by_text(hits, choose)
                if limit is not None and hits and max(Counter(h[0] for h in hits).values()) > limit:
                    raise ValueError(TOO_MANY)
                if hits:
                    of, start, end, phrase = zip(*hits)
                    cut = lambda f: pa.array([f(texts[i], s, e) for i, s, e in zip(of, start, end)], pa.string())  # noqa: B023, E731
                    parts = [cut(lambda t, s, e: t[s:e]), cut(lambda t, s, e: t[max(s - window, 0) : s]), cut(lambda t, s, e: t[e : e + window])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(phrase, pa.string()), *parts], names=["doc_id", "start", "end", "phrase", "text", "before", "after"])

    return rows.mapInArrow(run, f"doc_id {kind}, start int, end int, phrase string, text string, before string, after string")


def all_words(docs: DataFrame, *columns: str, lang: str | None = None) -> DataFrame:
    """(doc_id, columns, start, end, text) of every word of every text."""
    rows = docs.select("doc_id", *columns, "text", *([lang] if lang else []))
    n = 1 + len(columns)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, n):
                texts = batch.column(n).to_pylist()
                of, start, end, _ = words.found(texts, batch.column(n + 1).to_pylist() if lang else None, hashes=False)
                for lo in range(0, len(of), ROWS):
                    part = slice(lo, lo + ROWS)
                    each = [texts[i][s:e] for i, s, e in zip(of[part].tolist(), start[part].tolist(), end[part].tolist())]
                    index = pa.array(of[part])
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(index) for k in range(n)], pa.array(start[part]), pa.array(end[part]), pa.array(each, pa.string())], names=["doc_id", *columns, "start", "end", "text"])

    return rows.mapInArrow(run, ", ".join([*kinds, "start int, end int, text string"]))


def joined_tags(docs: DataFrame, dictionary: DataFrame, lang: str | None = None) -> DataFrame:
    """(doc_id, start, end, phrase) by joins, for a dictionary of any size."""
    # Only the phrases matter here; what they stand for is joined to the spans found.
    keys = dictionary.select("phrase").distinct().withColumn("n", F.size(F.split("phrase", " ")))
    heads = keys.groupBy(F.split_part("phrase", F.lit(" "), F.lit(1)).alias("head")).agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    longest = keys.agg(F.max("n")).first()[0] or 0
    found = T.tokens(F.col("text"), F.col(lang) if lang else None)
    windows = T.let(found, lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.slice(w, i, F.lit(max(longest, 1))))))
    each = docs.select("doc_id", *(["text"] if lang is None else ["text", lang])).select("doc_id", F.explode_outer(windows).alias("w")).where("w is not null")  # a plain explode would have the windows made twice, for a filter
    each = each.withColumn("head", F.lower(T.fold(F.col("w")[0].text)))
    begun = each.join(heads, "head").select("doc_id", "w", F.explode(F.filter("lengths", lambda n: n <= F.size("w"))).alias("n"))
    phrase = F.array_join(F.transform(F.slice("w", F.lit(1), F.col("n")), lambda x: F.lower(T.fold(x.text))), " ")
    last = F.element_at("w", F.col("n"))
    spans = begun.select("doc_id", F.col("w")[0].start.alias("start"), last.end.alias("end"), phrase.alias("phrase"))
    return spans.join(keys.select("phrase"), "phrase", "left_semi").select("doc_id", "start", "end", "phrase")


def with_text(spans: DataFrame, docs: DataFrame, window: int = 40) -> DataFrame:
    """spans with text, before and after, cut from the documents: one shuffle of the texts by doc_id, only of documents that have spans."""
    around = T.text_window(F.col("__t"), F.col("start"), F.col("end"), window)
    joined = spans.join(docs.select("doc_id", F.col("text").alias("__t")), "doc_id")
    out = joined.withColumn("text", F.substring("__t", F.col("start") + 1, F.col("end") - F.col("start")))
    return out.withColumn("around", around).select(*spans.columns, "text", F.col("around.before").alias("before"), F.col("around.after").alias("after"))


def no_sub(spans: DataFrame) -> DataFrame:
    """Without spans that lie strictly within another one of the document (equal ones stay)."""
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    each = spans.select("doc_id", "start", "end").distinct().withColumn("reach", F.max("end").over(order))
    kept = each.where("reach is null or reach < end").select("doc_id", "start", "end")
    return spans.join(kept, ["doc_id", "start", "end"], "left_semi").select(*spans.columns)


def longest_dominant_right(spans: DataFrame) -> DataFrame:
    """The longest span of each tangle of overlapping ones, the right one of equals; then the longest that doesn't overlap it, and so on.

    A document is first cut into clusters that don't touch, so the greedy choice only looks at a few spans, however long the document.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    each = spans.select("doc_id", "start", "end").distinct()
    reach = each.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    cluster = F.sum(F.when(F.col("reach").isNull() | (F.col("start") >= F.col("reach")), 1).otherwise(0)).over(order)
    rank = F.struct((F.col("start") - F.col("end")).alias("a"), (-F.col("start")).alias("b"), "start", "end")
    gathered = reach.withColumn("cluster", cluster).groupBy("doc_id", "cluster").agg(F.sort_array(F.collect_list(rank)).alias("s"))
    none = F.array().cast("array<struct<a:int,b:int,start:int,end:int>>")
    greedy = F.aggregate("s", none, lambda acc, x: F.when(F.exists(acc, lambda y: (y.start < x.end) & (x.start < y.end)), acc).otherwise(F.array_append(acc, x)))
    kept = gathered.select("doc_id", F.explode(greedy).alias("k")).select("doc_id", "k.start", "k.end")
    return spans.join(kept, ["doc_id", "start", "end"], "left_semi").select(*spans.columns)


def limited(spans: DataFrame, limit: int = TAG_LIMIT) -> DataFrame:
    """The same spans, or an error that asks for shorter documents, where one has more than the limit."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    checked = F.when(n > limit, F.raise_error(F.lit(TOO_MANY))).otherwise(F.lit(True))
    return spans.withColumn("__n", checked).where("__n").drop("__n")


# --- lexicon ---------------------------------------------------------------------------------
def allowed(lexicon: DataFrame, catalogs: Sequence[str] | None = None, excluded_prefixes: Sequence[str] = ()) -> DataFrame:
    """Valid rows of the catalogs asked for, without taxons of an excluded prefix; done before the join."""
    out = lexicon.where("valid")
    if catalogs is not None:
        out = out.where(F.col("catalog").isin(list(catalogs)))
    for p in excluded_prefixes:
        out = out.where(~F.lower("taxnode").startswith(p.lower()))
    return out


def is_spaced_out(t: Column) -> Column:
    """'a b c d': short and nearly every other character a blank."""
    return (F.length(t) <= 12) & (1 + 2 * T.count_spaces(t) >= F.length(t))


def taxon_type(taxnode: Column) -> Column:
    low = F.lower(taxnode)
    return F.when(low.startswith("org."), "org").when(low.startswith("person"), "person").when(low.startswith("nationality"), "nationality").otherwise("taxon")


def lexicon_tag(docs: DataFrame, lexicon: DataFrame, lower_case: bool = False) -> DataFrame:
    """(doc_id, start, end, text, taxons): spans of at least three characters that a taxon names, none within another.

    lexicon: phrase, catalog, taxnode, acronym. Spans with more than one line end or tab are dropped, lower-case
    ones too unless asked for; an acronym must be in upper case; a span left with no taxon vanishes.
    """
    seen = tag(docs, lexicon, overlaps="no_sub")
    seen = seen.where((F.length("text") >= 3) & (T.count_formatting(F.col("text")) <= 1) & ~is_spaced_out(F.col("text")))
    if not lower_case:
        seen = seen.where(~T.is_lower(F.col("text")))
    rows = seen.join(lexicon.select("phrase", "catalog", "taxnode", "acronym"), "phrase").where(~F.col("acronym") | T.is_upper(F.col("text")))
    one = F.struct("catalog", "taxnode", taxon_type(F.col("taxnode")).alias("type"))
    return rows.groupBy("doc_id", "start", "end", "text").agg(F.array_sort(F.collect_set(one)).alias("taxons"))


def search(dictionary: DataFrame, query: str, max_len: int | None = None) -> DataFrame:
    """Rows whose phrase holds the query's words one after another."""
    key = T.norm(F.lit(query))
    out = dictionary.where(F.concat(F.lit(" "), "phrase", F.lit(" ")).contains(F.concat(F.lit(" "), key, F.lit(" "))))
    return out if max_len is None else out.where(F.length("phrase") <= max_len)
