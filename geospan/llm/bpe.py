"""Operator 6: byte-pair encoding and decoding, by speculating and verifying.

A text is cut into words by the vocabulary's public pattern. Greedy longest match over a trie,
run for all new words of a batch at once, proposes tokens. A sequence of tokens is the result of
merging exactly if every adjacent pair is what merging makes of the pair's own bytes, so a
vectorised look at a table of compatible pairs verifies the proposal; words that fail undergo
exact merging, lowest rank first. Ids equal those of the public tokenizer, to the byte.

Defined results
* null text: tokens null, n_tokens null, decoded text null; empty text: no tokens, and an empty text back;
* texts and words of any length are encoded whole; repeated rows alike, each on its own;
* a tie of ranks can't occur; of equal pairs within a word the left one merges first;
* special tokens' strings are ordinary text; bytes that aren't UTF-8 are read as U+FFFD;
* an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession

from . import kernel

#: Any file of base64 tokens and ranks will do.
VOCABULARY = os.environ.get("GEOSPAN_BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their tokens in a Python worker, before it starts anew; this bounds memory, not results.
KEPT_WORDS = 300_000
KEPT_PAIRS = 2_000_000
_TABLE = 1 << 20
_TOKENS = "doc_id long, tokens array<int>, n_tokens int"


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact merging. A heap of pairs by (rank, place): n log n for a word of any length."""
    n = len(word)
    if n < 2 or word in ranks and n < 3:
        return [ranks[word]] if word in ranks else [ranks[word[i : i + 1]] for i in range(n)]
    if n <= 24:
        parts = [word[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two has merged since
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Table:
    """An open-addressing map of non-negative numbers, looked up in numpy; made once and broadcast as arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    @staticmethod
    def slots(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    @classmethod
    def build(cls, pairs: dict[int, int]) -> Table:
        size = max(1024, 1 << (3 * len(pairs)).bit_length())
        table, out = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at = cls.slots(keys, size)
        while len(keys):  # place the first of each slot, move the rest on by one
            free = table[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            table[at[first]], out[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (size - 1)
        return cls(table, out)

    def get(self, key: np.ndarray, missing: int) -> np.ndarray:
        at = self.slots(key, len(self.keys))
        found = self.keys[at]
        out = np.where(found == key, self.values[at], np.int32(missing))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Trie:
    """Children by node * 256 + byte, and the token that ends at a node."""

    def __init__(self, table: Table, token: np.ndarray):
        self.table, self.token = table, token

    @classmethod
    def build(cls, ranks: dict[bytes, int]) -> Trie:
        nodes: dict[int, int] = {}
        token = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                key = node * 256 + b
                child = nodes.get(key)
                if child is None:
                    child = nodes[key] = len(token)
                    token.append(-1)
                node = child
            token[node] = rank
        return cls(Table.build(nodes), np.array(token, np.int32))

    def greedy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words in order, number by word): the longest token at each place."""
        n = len(offsets) - 1
        data = np.append(data, 0)
        lane = np.flatnonzero(np.diff(offsets) > 0)
        scan, stop = offsets[lane].astype(np.int64), offsets[lane + 1].astype(np.int64)
        node, best, best_end = np.zeros(len(lane), np.int32), np.full(len(lane), -1, np.int32), scan.copy()
        lanes, tokens = [], []
        while len(lane):
            child = np.where(scan < stop, self.table.get(node.astype(np.int64) * 256 + data[scan], 0), 0)
            on = child > 0
            node = child
            scan = scan + on
            token = self.token[child]
            better = on & (token >= 0)
            best = np.where(better, token, best)
            best_end = np.where(better, scan, best_end)
            out = np.flatnonzero(~on)
            if len(out):
                lanes.append(lane[out])
                tokens.append(best[out])
                scan[out] = best_end[out]
                node[out] = 0
                best[out] = -1
                done = np.zeros(len(lane), bool)
                done[out] = scan[out] >= stop[out]
                if done.any():
                    keep = ~done
                    lane, scan, stop, node, best, best_end = (x[keep] for x in (lane, scan, stop, node, best, best_end))
        if not lanes:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        of, flat = np.concatenate(lanes), np.concatenate(tokens)
        return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)


def merge_table(ranks: dict[bytes, int], size: int) -> Table:
    """left * size + right -> the token that the two merge to."""
    out = {}
    for word, rank in ranks.items():
        for i in range(1, len(word)):
            left, right = ranks.get(word[:i]), ranks.get(word[i:])
            if left is not None and right is not None:
                out[left * size + right] = rank
    return Table.build(out)


class Merger:
    """Exact merging of many short words at once: one merge of each word a round, the lowest rank first, the left one of equals."""

    NONE = np.iinfo(np.int32).max
    LONGEST = 32

    def __init__(self, ranks: dict[bytes, int], table: Table, size: int):
        self.ranks, self.table, self.size = ranks, table, size
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ok = (left >= 0) & (right >= 0)
        out = np.full(left.shape, self.NONE, np.int32)
        out[ok] = self.table.get(left[ok].astype(np.int64) * self.size + right[ok], self.NONE)
        return out

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words in order, number by word)."""
        n = np.diff(offsets)
        counts = np.zeros(len(n), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in (4, 8, 12, 16, 24, self.LONGEST):
            rows = np.flatnonzero((n > low) & (n <= width))
            low = width
            for at in range(0, len(rows), 1 << 14):
                done.append((some := rows[at : at + (1 << 14)], self._matrix(data, offsets[some], n[some], width, counts, some)))
        for i in np.flatnonzero(n > self.LONGEST).tolist():
            got = merged(data[offsets[i] : offsets[i + 1]].tobytes(), self.ranks)
            counts[i] = len(got)
            done.append((np.array([i]), np.array(got, np.int32)))
        out, into = np.empty(int(counts.sum()), np.int32), np.append(0, np.cumsum(counts))[:-1]
        for some, flat in done:
            out[kernel.ranges(into[some], counts[some])] = flat
        return out, counts

    def _matrix(self, data: np.ndarray, starts: np.ndarray, n: np.ndarray, width: int, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        place = np.arange(width)
        t = np.where(place < n[:, None], self.single[data[np.minimum(starts[:, None] + place, len(data) - 1)]], -1).astype(np.int32)
        t = np.concatenate([t, np.full((len(t), 1), -1, np.int32)], axis=1)
        r = self.ranked(t[:, :-1], t[:, 1:])
        final = np.full((len(t), width), -1, np.int32)
        live = np.arange(len(t))
        while len(live):
            m = r.argmin(axis=1)
            rank = r[np.arange(len(m)), m]
            stop = rank == self.NONE
            if stop.any():
                final[live[stop]] = t[stop, :width]
                go = ~stop
                live, t, r, m, rank = live[go], t[go], r[go], m[go], rank[go]
                if not len(live):
                    break
            i = np.arange(len(m))
            shift = place + (place > m[:, None])
            t2 = np.full_like(t, -1)
            t2[:, :width] = np.take_along_axis(t, shift, axis=1)
            t2[i, m] = rank  # a merge's rank is its token
            r = np.where(shift < width, np.take_along_axis(r, np.minimum(shift, width - 1), axis=1), self.NONE)
            r[i, m] = self.ranked(t2[i, m], t2[i, m + 1])
            k = np.flatnonzero(m > 0)
            r[k, m[k] - 1] = self.ranked(t2[k, m[k] - 1], t2[k, m[k]])
            t = t2
        counts[rows] = (final >= 0).sum(axis=1)
        return final[final >= 0]


#: The same pattern for texts within Latin-1, which the standard library matches faster.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Known(dict):
    """Numbers words in the order of their first look-up."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Codec:
    """Encodes and decodes in one Python process."""

    def __init__(self, ranks: dict[bytes, int], trie: Trie | None = None, merges: Table | None = None):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"not a byte-level vocabulary: bytes {missing[:5]} have no token")
        self.ranks, self.pattern, self.latin = ranks, regex.compile(PATTERN), re.compile(LATIN)
        self.trie = trie or Trie.build(ranks)
        self.bytes = {r: b for b, r in ranks.items()}
        self.size = max(self.bytes) + 1
        lengths = np.zeros(self.size, np.int64)
        for r, b in self.bytes.items():
            lengths[r] = len(b)
        self.lengths, self.at = lengths, np.append(0, np.cumsum(lengths))[:-1]
        self.pool = np.frombuffer(b"".join(self.bytes.get(r, b"") for r in range(self.size)), np.uint8)
        self.merger = Merger(ranks, merges or merge_table(ranks, self.size), self.size)
        self.stats = {"words": 0, "exact": 0}
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.flat, self.starts, self.counts, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether merging leaves it as it is; pairs not met before are decided by merging their bytes."""
        key = left.astype(np.int64) * self.size + right
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        at = np.searchsorted(self.pairs, key)
        unknown = np.unique(key[self.pairs[np.minimum(at, len(self.pairs) - 1)] != key]) if len(self.pairs) else np.unique(key)
        if len(unknown):
            one, two = unknown // self.size, unknown % self.size
            both = np.stack([one, two], axis=1).ravel()
            data = self.pool[kernel.ranges(self.at[both], self.lengths[both])]
            flat, counts = self.merger.run(data, np.append(0, np.cumsum(self.lengths[one] + self.lengths[two])))
            into = np.append(0, np.cumsum(counts))[:-1]
            ok = counts == 2
            ok[ok] = (flat[into[ok]] == one[ok]) & (flat[into[ok] + 1] == two[ok])
            pairs = np.concatenate([self.pairs, unknown])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.fits = pairs[order], np.concatenate([self.fits, ok])[order]
            at = np.searchsorted(self.pairs, key)
        return self.fits[at]

    def words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, number by word)."""
        raw = [w.encode("utf-8", "replace") for w in new]
        offsets = np.append(0, np.cumsum([len(b) for b in raw])).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        flat, counts = self.trie.greedy(data, offsets)
        of = np.repeat(np.arange(len(new)), counts)
        inside = np.flatnonzero(of[1:] == of[:-1])
        bad = np.zeros(len(new), bool)
        if len(inside):
            wrong = ~self.compatible(flat[inside], flat[inside + 1])
            bad[of[inside[wrong]]] = True
        self.stats["words"] += len(new)
        self.stats["exact"] += int(bad.sum())
        if bad.any():
            again = np.flatnonzero(bad)
            lengths = np.diff(offsets)[again]
            fixed, fixed_counts = self.merger.run(data[kernel.ranges(offsets[again], lengths)], np.append(0, np.cumsum(lengths)))
            new_counts = counts.copy()
            new_counts[bad] = fixed_counts
            out = np.empty(int(new_counts.sum()), np.int32)
            into = np.append(0, np.cumsum(new_counts))[:-1]
            out[kernel.ranges(into[~bad], counts[~bad])] = flat[~bad[of]]
            out[kernel.ranges(into[bad], new_counts[bad])] = fixed
            flat, counts = out, new_counts
        return flat, counts

    def _learn(self, new: list[str]) -> None:
        flat, counts = self.words(new)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(flat), self.used, 1 << 16), np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.append(0, np.cumsum(counts))[:-1]])
        self.counts = np.concatenate([self.counts, counts])
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts in order, offsets by text)."""
        parts, sizes = [], np.zeros(len(texts), np.int64)
        step = 1 << 20
        group: list[str] = []
        spans: list[tuple[int, int]] = []

        def flush() -> None:
            if len(self.known) > KEPT_WORDS:
                self._forget()
            known = self.known
            index = np.fromiter(map(known.__getitem__, group), np.int64, len(group))
            if known.new:
                self._learn(known.new)
                known.new = []
            counts = self.counts[index]
            parts.append(self.flat[kernel.ranges(self.starts[index], counts)])
            ends = np.append(0, np.cumsum(counts))
            at = 0
            for i, n in spans:
                sizes[i] += ends[at + n] - ends[at]
                at += n
            group.clear()
            spans.clear()

        for i, t in enumerate(texts):
            got = (self.latin if _is_latin(t) else self.pattern).findall(t)
            for lo in range(0, len(got), step):
                some = got[lo : lo + step]
                group.extend(some)
                spans.append((i, len(some)))
                if len(group) >= 1 << 17:
                    flush()
        if group:
            flush()
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.append(0, np.cumsum(sizes))

    def decode(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets by text). KeyError for a number that is no token."""
        if len(tokens) and (int(tokens.min()) < 0 or int(tokens.max()) >= self.size or not self.lengths[tokens].all()):
            raise KeyError("a number that is no token of this vocabulary")
        out, ends = [], np.zeros(len(offsets), np.int64)
        lengths = self.lengths[tokens]
        total = np.append(0, np.cumsum(lengths))
        step = 1 << 17
        for lo in range(0, len(tokens), step):
            out.append(self.pool[kernel.ranges(self.at[tokens[lo : lo + step]], lengths[lo : lo + step])])
        ends[:] = total[offsets]
        return np.concatenate(out) if out else np.zeros(0, np.uint8), ends


_codec: dict[int, Codec] = {}


def _shared(spark: SparkSession, path: str):  # noqa: ANN202
    ranks = load(path)
    merges = merge_table(ranks, max(ranks.values()) + 1)
    codec = Codec(ranks, Trie.build({bytes([b]): ranks[bytes([b])] for b in range(256)}), merges)
    words = list(ranks)
    _, counts = codec.merger.run(np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words])))
    # A token that merging can't reach is never proposed: it would be wrong even without a neighbour.
    trie = Trie.build({w: ranks[w] for w, n in zip(words, counts.tolist()) if n == 1})
    return spark.sparkContext.broadcast((uuid.uuid4().hex, ranks, trie.table.keys, trie.table.values, trie.token, merges.keys, merges.values))


def _local(shared) -> Codec:  # noqa: ANN001
    key, *parts = shared.value
    if key not in _codec:
        _codec.clear()
        ranks, keys, children, token, pairs, products = parts
        _codec[key] = Codec(ranks, Trie(Table(keys, children), token), Table(pairs, products))
    return _codec[key]


def _text_slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _encoded(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, tokens, n_tokens from doc_id, text."""
    none = part.column(1).is_null().to_numpy(zero_copy_only=False)
    tokens, offsets = codec.encode(kernel.strings(part.column(1)))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()), mask=pa.array(none))
    return pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(offsets), pa.int32(), mask=none)], names=["doc_id", "tokens", "n_tokens"])


def _decoded(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, tokens, n_tokens, and the text that the tokens say."""
    lists = part.column(1)
    none = lists.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(none, 0, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    data, ends = codec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(sizes)))
    raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    try:
        text = raw.cast(pa.string())
    except pa.ArrowInvalid:  # tokens of another origin can end within a character
        text = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())
    text = pa.compute.if_else(pa.array(~none), text, pa.scalar(None, pa.string())) if none.any() else text
    return pa.RecordBatch.from_arrays([*part.columns, text], names=["doc_id", "tokens", "n_tokens", "text"])


def _mapped(rows: DataFrame, path: str, schema: str, *steps: Callable[[Codec, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """rows with the steps applied one after another to slices of them, all in the same Python worker and with the same codec."""
    shared = _shared(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _local(shared)
        for batch in batches:
            for part in _text_slices(batch):
                for step in steps:
                    part = step(codec, part)
                yield part
        kernel.trimmed()

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens (array<int>), n_tokens."""
    return _mapped(docs.select("doc_id", "text"), path, _TOKENS, _encoded)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """encoded (doc_id, tokens, n_tokens) with the text decoded from the tokens appended."""
    return _mapped(encoded.select("doc_id", "tokens", "n_tokens"), path, f"{_TOKENS}, text string", _decoded)


def there_and_back(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """decode(encode(docs)) in one step: two would keep a second Python worker, with a codec of its own, for each core."""
    return _mapped(docs.select("doc_id", "text"), path, f"{_TOKENS}, text string", _encoded, _decoded)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its tokens."""
    return there_and_back(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, n_tokens, and the text decoded from the tokens, which can be held against the one that came in."""
    return there_and_back(docs)


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}
