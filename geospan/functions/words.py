"""Words of texts with their places, and phrases among them, in numpy over Arrow batches.

The same words as text.tokens() finds: runs of letters and digits; single characters where the
language is written without blanks. Offsets are code points. Texts of any length are read whole.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa

from .text import CJK_LANGS, FOLD_FROM, FOLD_TO, PAIRS

_M = np.uint64(0xD6E8FEB86659FD93)
_P = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18
_CJK = re.compile("[⺀-⿕々〇〡-〩〸-〻ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ᄀ-ᇿㄱ-ㆎꥠ-ꥼ가-힣ｦ-ﾝ\U00020000-\U000323af]")


def folded(text: str) -> str:
    """text.fold() and lower case of a Python string."""
    text = text.translate(_FOLD)
    for a, b in PAIRS:
        text = text.replace(a, b)
    return text.lower()


_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


class Tables:
    """By code point: whether it is of a word, whether CJK, what it becomes when folded, and whether that isn't one character."""

    def __init__(self) -> None:
        n = 0x110000
        self.member, self.cjk, self.odd = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        self.fold = np.arange(n, dtype=np.uint32)
        for i in range(0x323B0):
            c = chr(i)
            if unicodedata.category(c)[0] not in "LN":
                continue
            self.member[i] = True
            if i >= 0x1100 and _CJK.match(c):
                self.cjk[i] = True
                continue
            f = folded(c)
            if len(f) == 1:
                self.fold[i] = ord(f)
            else:
                self.odd[i] = True


@functools.cache
def tables() -> Tables:
    return Tables()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(p: int) -> np.ndarray:
        out = np.full(n, p, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_P), run(pow(_P, -1, 1 << 64))


@functools.cache
def _usual() -> tuple[np.ndarray, np.ndarray]:
    return _powers(4 * _BLOCK)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * _M
    return x ^ (x >> np.uint64(32))


def hash_of(word: str) -> int:
    """The hash of a folded word."""
    x = _values(np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32))
    power = _usual()[0] if len(x) <= 4 * _BLOCK else _powers(len(x))[0]
    return int(_mix(np.array([(x * power[: len(x)]).sum()], np.uint64))[0])


def _chain(first: np.ndarray, following: np.ndarray) -> np.ndarray:
    return _mix(first * np.uint64(0x9FB21C651E98DF25) + following)


def found(texts: Sequence[str | None], langs: Sequence[str | None] | None = None, hashes: bool = True, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(text, start, end, hash) of all words, in order. Texts are put together into blocks; one that is longer makes its own. fold: words are hashed as folded."""
    t = tables()
    out: list[tuple] = []
    group: list[int] = []
    size = 0

    def work() -> None:
        s = "\0" + "\0".join(texts[i] for i in group) + "\0"
        codes = np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)
        at = np.append(1, 1 + np.cumsum([len(texts[i]) + 1 for i in group]))
        member = t.member[codes]
        first, last = member[1:] & ~member[:-1], member[:-1] & ~member[1:]
        if langs is not None and any(langs[i] in CJK_LANGS for i in group):
            of_code = np.searchsorted(at, np.arange(len(codes)), "right") - 1
            flag = np.array([langs[i] in CJK_LANGS for i in group] + [False])
            one = t.cjk[codes] & flag[np.maximum(of_code, 0)]
            cut = one[1:] | one[:-1]
            first, last = first | (member[1:] & cut), last | (member[:-1] & cut)
        starts, ends = np.flatnonzero(first) + 1, np.flatnonzero(last) + 1
        if not len(starts):
            return
        of = np.searchsorted(at, starts, "right") - 1
        h = None
        if hashes:
            power, inverse = _usual() if len(codes) < 4 * _BLOCK else _powers(len(codes) + 1)
            total = np.cumsum(_values(t.fold[codes] if fold else codes) * power[: len(codes)])
            h = _mix((total[ends - 1] - total[starts - 1]) * inverse[starts])
            odd = np.append(0, np.cumsum(t.odd[codes]))
            for k in np.flatnonzero(odd[ends] > odd[starts]) if fold else ():  # two-letter foldings
                h[k] = hash_of(folded(s[starts[k] : ends[k]]))
        out.append((np.array(group)[of], (starts - at[of]).astype(np.int32), (ends - at[of]).astype(np.int32), h))

    for i, x in enumerate(texts):
        if x is None:
            continue
        if group and size + len(x) > _BLOCK:
            work()
            group, size = [], 0
        group.append(i)
        size += len(x) + 1
    if group:
        work()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return tuple(np.concatenate([o[k] for o in out]) if out[0][k] is not None else None for k in range(4))


def hashed(phrases: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index, number of words, hash of the first word, hash) of the phrases that can occur: words joined by single blanks."""
    of, start, end, h = found(phrases, fold=False)
    n = np.bincount(of, minlength=len(phrases)) if len(of) else np.zeros(len(phrases), np.int64)
    letters = np.bincount(of, end - start, len(phrases)) if len(of) else n
    sound = (n > 0) & (letters + n - 1 == [len(p) for p in phrases]) & (n - 1 == [p.count(" ") for p in phrases])
    index = np.flatnonzero(sound)
    first, count = np.searchsorted(of, index), n[index]
    head = h[first] if len(index) else np.zeros(0, np.uint64)
    chain = head.copy()
    for k in range(1, int(count.max(initial=0))):
        more = count > k
        chain[more] = _chain(chain[more], h[first[more] + k])
    return index, count, head, chain


class Phrases:
    """A dictionary of phrases (words joined by blanks, folded), for matching; made from a bounded list. By number of words: hashes in order, and the phrases in one piece of bytes in the same order."""

    def __init__(self, phrases: Iterable[str]):
        each = sorted(set(phrases))
        index, n, head, chain = hashed(each)
        self._fill(pa.array(each, pa.string()).take(pa.array(index)), n, head, chain)

    @classmethod
    def of(cls, phrases: pa.Array, n: np.ndarray, head: np.ndarray, chain: np.ndarray) -> Phrases:
        """From distinct phrases and what hashed() says of them."""
        out = cls.__new__(cls)
        out._fill(phrases, n, head, chain)
        return out

    def _fill(self, phrases: pa.Array, n: np.ndarray, head: np.ndarray, chain: np.ndarray) -> None:
        self.size, self.heads = len(phrases), np.unique(head)
        self.lengths: dict[int, np.ndarray] = {}
        self.known: dict[int, tuple[np.ndarray, bytes]] = {}
        for k in np.unique(n).tolist():
            at = np.flatnonzero(n == k)
            at = at[np.argsort(chain[at], kind="stable")]
            part = phrases.take(pa.array(at)).cast(pa.large_string())
            offsets, blob = part.buffers()[1:]
            self.lengths[k] = chain[at]
            self.known[k] = np.frombuffer(offsets, np.int64, len(at) + 1).copy(), b"" if blob is None else blob.to_pybytes()

    def match(self, texts: Sequence[str | None], langs: Sequence[str | None] | None = None) -> list[tuple[int, int, int, str]]:
        """(text, start, end, phrase) of every place where one occurs, by text, start and number of words."""
        of, start, end, h = found(texts, langs)
        out: list[tuple[int, int, int, str]] = []
        if not len(of) or not len(self.heads):
            return out
        at = np.flatnonzero(_within(h, self.heads))
        chain, done = h[at], 1
        for n, keys in self.lengths.items():
            while done < n and len(at):
                stay = at + done < len(of)
                at, chain = at[stay], chain[stay]
                stay = of[at + done] == of[at]
                at, chain = at[stay], chain[stay]
                chain = _chain(chain, h[at + done])
                done += 1
            hit = np.flatnonzero(_within(chain, keys))
            slot = np.searchsorted(keys, chain[hit])
            offsets, blob = self.known[n]
            first = at[hit]
            for i, j, t, s, e in zip(first.tolist(), slot.tolist(), of[first].tolist(), start[first].tolist(), end[first + n - 1].tolist()):
                text = texts[t]
                p = _folded(text[s:e]) if n == 1 else " ".join([_folded(text[a:b]) for a, b in zip(start[i : i + n].tolist(), end[i : i + n].tolist())])
                word, key = p.encode("utf-8", "replace"), keys[j]
                while blob[offsets[j] : offsets[j + 1]] != word:  # other phrases of the same hash
                    j += 1
                    if j == len(keys) or keys[j] != key:
                        break
                else:
                    out.append((t, s, e, p))
        out.sort()
        return out


def _folded(word: str) -> str:
    return word.lower() if word.isascii() else folded(word)


Hit = tuple[int, int, int, str]


def not_within(hits: list[Hit]) -> list[Hit]:
    """Of the hits of one text, by start, those that lie strictly within no other."""
    keep, reach = set(), -1
    for start, end in sorted({(h[1], h[2]) for h in hits}, key=lambda x: (x[0], -x[1])):
        if end > reach:
            keep.add((start, end))
            reach = end
    return [h for h in hits if (h[1], h[2]) in keep]


def dominant(hits: list[Hit]) -> list[Hit]:
    """Of the hits of one text, the longest of each tangle, the right one of equals; then the longest that doesn't overlap it, and so on."""
    keep: set[tuple[int, int]] = set()

    def choose(cluster: list[tuple[int, int]]) -> None:
        taken: list[tuple[int, int]] = []
        for start, end in sorted(cluster, key=lambda x: (x[0] - x[1], -x[0])):
            if all(e <= start or end <= s for s, e in taken):
                taken.append((start, end))
        keep.update(taken)

    cluster: list[tuple[int, int]] = []
    reach = -1
    for span in sorted({(h[1], h[2]) for h in hits}):
        if cluster and span[0] >= reach:
            choose(cluster)
            cluster = []
        cluster.append(span)
        reach = max(reach, span[1])
    choose(cluster)
    return [h for h in hits if (h[1], h[2]) in keep]


def by_text(hits: list[Hit], f: Callable[[list[Hit]], list[Hit]]) -> list[Hit]:
    out: list[Hit] = []
    for _, part in itertools.groupby(hits, key=lambda h: h[0]):
        out += f(list(part))
    return out


def _within(x: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x
