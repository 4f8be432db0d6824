"""Indel similarity of strings and token sets, from 0 to 100.

``indel_ratio`` is a vectorised Arrow function with bit-parallel longest common subsequences; no built-in
function has its semantics (levenshtein() substitutes).  ``indel_ratio_native`` is the same as a built-in
expression, for plans without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tavola.config import STOP_WORDS, STREET_WORDS, Settings
from tavola.functions.text import fold, without, words

#: Strings of which a Python worker keeps the letters' places and the words.
CACHED = 50_000


@lru_cache(CACHED)
def _places(text: str) -> dict[str, int]:
    """For each character the bits of its places."""
    at: dict[str, int] = {}
    for i, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << i
    return at


@lru_cache(CACHED)
def _tokens(text: str) -> tuple[str, frozenset[str], bool]:
    """Sorted words joined, their set, and whether no word repeats."""
    words_ = sorted(text.split())
    distinct = frozenset(words_)
    return " ".join(words_), distinct, len(distinct) == len(words_)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one word operation for each character of ``b``."""
    if not a or not b:
        return 0
    at = _places(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_set(a: str, b: str) -> float:
    x, y = _tokens(a)[1], _tokens(b)[1]
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if not both:
        return ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    own, other = sorted(x - y), sorted(y - x)
    if not own or not other:
        return 100.0
    shared, left, right = " ".join(both), " ".join(both + own), " ".join(both + other)
    return max(ratio(left, right), ratio(shared, left), ratio(shared, right))


def token_sort(a: str, b: str) -> float:
    return ratio(_tokens(a)[0], _tokens(b)[0])


def name_score_of(a: str, b: str, shortcut: float = 0.70) -> float:
    """Best of plain and sorted ratio; sets of tokens count only if that stays below ``shortcut``."""
    if not a or not b:
        return 0.0
    best = max(ratio(a, b), token_sort(a, b)) / 100
    if best >= shortcut:
        return best
    (_, x, once), (_, y, once_too) = _tokens(a), _tokens(b)
    if once and once_too and x.isdisjoint(y):
        return best  # the sets' ratio is the sorted one
    return max(best, token_set(a, b) / 100)


def _lcs_of(text: str, number: dict[str, int], letters: np.ndarray) -> np.ndarray:
    """lcs_length() of a text of at most 64 characters with each column of ``letters``; 0 is no character, ``number`` has the others'."""
    if not text:
        return np.zeros(letters.shape[1], np.int64)
    at = np.zeros(len(number) + 1, np.uint64)
    for c, bits in _places(text).items():
        if c in number:
            at[number[c]] = bits
    full = np.uint64((1 << len(text)) - 1)
    row = np.full(letters.shape[1], full)
    hit, rest = np.empty_like(row), np.empty_like(row)
    for line in letters:
        np.take(at, line, out=hit, mode="clip")
        np.bitwise_and(hit, row, out=hit)
        np.subtract(row, hit, out=rest)
        np.add(row, hit, out=row)
        np.bitwise_or(row, rest, out=row)
    return len(text) - np.bitwise_count(row & full).astype(np.int64)


class Names:
    """Distinct names as arrays, for name_score_of() of one name and many.

    Names of more than 64 characters or with odd blanks are ``odd``: they are compared one by one.
    """

    def __init__(self, names: list[str]):
        self.names = names
        self.odd = np.array([self.is_odd(x) for x in names], bool)
        regular = ["" if odd else x for x, odd in zip(names, self.odd)]
        tokens = [_tokens(x) for x in regular]
        self.sets = [sorted(x[1]) for x in tokens]
        self.n = np.array([len(x) for x in names], np.int64)
        self.n_set = np.array([len(" ".join(x)) for x in self.sets], np.int64)
        self.repeats = np.array([not x[2] for x in tokens], bool)
        width = max(1, *map(len, regular)) if regular else 1
        texts = (regular, [x[0] for x in tokens], [" ".join(x) for x in self.sets])
        plain, ordered, sets = (np.frombuffer("".join(x.ljust(width, "\0") for x in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width) for some in texts)
        letters = np.unique(np.concatenate([[0], plain.ravel()]))
        self.number = {chr(c): i for i, c in enumerate(letters.tolist()) if c}
        self.plain, self.ordered, self.set = (np.ascontiguousarray(np.searchsorted(letters, x).T.astype(np.intp)) for x in (plain, ordered, sets))
        self.blank = self.set == self.number.get(" ", -1)
        self.word = (np.cumsum(self.blank, axis=0) - self.blank).astype(np.int64)  # of each letter; a blank's is that before it
        self.n_words = np.array([len(x) for x in self.sets], np.int64)
        self.low, self.high, self.over = self._bits(plain)
        self.postings: dict[str, tuple[list[int], list[int]]] = {}
        for i, words_ in enumerate(self.sets):
            for k, w in enumerate(words_):
                rows, places = self.postings.setdefault(w, ([], []))
                rows.append(i)
                places.append(k)
        self.postings = {w: (np.array(rows), np.array(places)) for w, (rows, places) in self.postings.items()}

    @staticmethod
    def is_odd(name: str) -> bool:
        return len(name) > 64 or len(_tokens(name)[0]) != len(name) or "\0" in name

    @staticmethod
    def _bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters as letter_bits() counts them."""
        row, at = np.nonzero(codes)
        counts = np.bincount(row * 32 + codes[row, at] % 32, minlength=len(codes) * 32).reshape(-1, 32)
        unary = (np.uint64(1) << np.minimum(counts, 4).astype(np.uint64)) - np.uint64(1)
        unary <<= 4 * (np.arange(32, dtype=np.uint64) % np.uint64(16))
        return unary[:, :16].sum(1, dtype=np.uint64), unary[:, 16:].sum(1, dtype=np.uint64), np.maximum(counts - 4, 0).sum(1)

    def letters(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(x[rows] for x in (self.low, self.high, self.over, self.n_set, self.odd))

    def probe(self, name: str) -> Probe:
        return Probe(name, self)


class Probe:
    """One name, to be compared with many."""

    def __init__(self, name: str, names: Names):
        self.name, self.all = name, names
        self.odd = names.is_odd(name)
        self.ordered, distinct, once = _tokens(name)
        self.words, self.repeats = sorted(distinct), not once
        self.n_set = len(" ".join(self.words))
        # Shared words: as bits of this name's and of the other's, and the length of what they make.
        self.own, self.other, self.length = (np.zeros(len(names.names), np.int64) for _ in range(3))
        for k, w in enumerate([] if self.odd else self.words):  # 32 at most
            if w in names.postings:
                rows, places = names.postings[w]
                self.own[rows] |= 1 << k
                self.other[rows] |= 1 << places
                self.length[rows] += len(w) + 1

    def bounds(self, rows: np.ndarray, letters: tuple[np.ndarray, ...]) -> np.ndarray:
        """What the score can be at most, by letters, and by shared words where there are some."""
        if self.odd:
            return np.ones(len(rows))
        low, high, over, n, odd = letters
        codes = np.frombuffer(self.name.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(1, -1)
        (own_low,), (own_high,), (own_over,) = Names._bits(codes)
        common = np.bitwise_count(low & own_low).astype(np.int64) + np.bitwise_count(high & own_high) + np.minimum(over, own_over)
        bound = np.minimum(1.0, 2.0 * common / np.maximum(n + self.n_set, 1))
        shared = np.flatnonzero(self.own[rows])
        if len(shared):
            at = rows[shared]
            length = self.length[at] - 1
            sets = 2.0 * length / (length + np.minimum(self.all.n_set[at], self.n_set))
            k = np.bitwise_count(self.own[at])
            sets[(k == len(self.words)) | (k == self.all.n_words[at])] = 1.0
            bound[shared] = np.maximum(bound[shared], sets)
        bound[odd] = 1.0
        return bound

    def scores(self, rows: np.ndarray, shortcut: float = 0.70) -> np.ndarray:
        """name_score_of() with the names at ``rows``."""
        a, names = self.name, self.all
        out = np.zeros(len(rows))
        odd = np.ones(len(rows), bool) if self.odd else names.odd[rows]
        for i in np.flatnonzero(odd).tolist():
            out[i] = name_score_of(a, names.names[rows[i]], shortcut)
        even = np.flatnonzero(~odd & (names.n[rows] > 0)) if a else out[:0]
        if not len(even):
            return out
        at = rows[even]
        n = names.n[at]
        top = int(n.max())
        plain = 200.0 * _lcs_of(a, names.number, names.plain[:top, at]) / (n + len(a))
        ordered = 200.0 * _lcs_of(self.ordered, names.number, names.ordered[:top, at]) / (n + len(a))
        best = np.maximum(plain, ordered) / 100
        # Without a shared or a repeated word the sets' ratio is the sorted one.
        some = np.flatnonzero((best < shortcut) & ((self.own[at] != 0) | names.repeats[at] | self.repeats))
        if len(some):
            best[some] = np.maximum(best[some], self._sets(at[some], top) / 100)
        out[even] = best
        return out

    def _sets(self, at: np.ndarray, top: int) -> np.ndarray:
        """token_set(): the shared words come first on both sides, so they are common as a whole."""
        names = self.all
        rest = (1 << names.n_words[at]) - 1 & ~self.other[at]
        last = np.frexp(rest.astype(np.float64))[1] - 1
        word, blank = names.word[:top, at], names.blank[:top, at]
        kept = (rest[None, :] >> word & 1).astype(bool) & ~(blank & (word >= last[None, :]))
        letters = np.where(kept, names.set[:top, at], 0)
        lcs = np.zeros(len(at), np.int64)
        masks, which = np.unique(self.own[at], return_inverse=True)
        for i, mask in enumerate(masks.tolist()):
            own = " ".join(w for k, w in enumerate(self.words) if not mask >> k & 1)
            of = np.flatnonzero(which == i)
            lcs[of] = _lcs_of(own, names.number, letters[:, of])
        n, length = names.n_set[at], np.maximum(self.length[at] - 1, 0)
        whole = 200.0 * (self.length[at] + lcs) / (n + self.n_set)
        got = np.maximum(whole, np.maximum(200.0 * length / (length + self.n_set), 200.0 * length / (length + n)))
        k = np.bitwise_count(self.own[at])
        return np.where((k == len(self.words)) | (k == names.n_words[at]), 100.0, got)


def _vectorised(of):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else of(x, y) for x, y in zip(a, b)], dtype="float64")

    # Declared so that the optimizer doesn't copy the call into each expression that reads its result.
    return F.pandas_udf(run, "double").asNondeterministic()


def indel_ratio(a: Column, b: Column) -> Column:
    return _vectorised(ratio)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _vectorised(token_sort)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _vectorised(token_set)(a, b)


def name_score(a: Column, b: Column, shortcut: float = 0.70) -> Column:
    return _vectorised(lambda x, y: name_score_of(x, y, shortcut))(a, b)


def letter_bits(text: Column, words_: Column) -> Column:
    """(low, high, over, n, repeats): a text's letters as a unary count of four bits for each of 32 classes of characters.

    ``over`` counts the letters beyond four of a class.  The common bits of two texts, with the smaller ``over``, are never
    fewer than the letters of their longest common subsequence.  ``repeats`` tells whether a word repeats.
    """
    classes = F.array_sort(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % 32))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0).alias("over"))

    def add(a: Column, k: Column) -> Column:
        run = F.when(k == a["last"], a["run"] + 1).otherwise(0)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (k % 16) * 4 + run)
        low = F.when((run < 4) & (k < 16), a["low"].bitwiseOR(bit)).otherwise(a["low"])
        high = F.when((run < 4) & (k >= 16), a["high"].bitwiseOR(bit)).otherwise(a["high"])
        return F.struct(k.alias("last"), run.alias("run"), low.alias("low"), high.alias("high"), (a["over"] + (run >= 4).cast("int")).alias("over"))

    more = {"n": F.length(text), "repeats": F.size(F.array_distinct(words_)) < F.size(words_)}
    return F.aggregate(classes, start, add, lambda a: F.struct(a["low"].alias("low"), a["high"].alias("high"), a["over"].alias("over"), *[v.alias(k) for k, v in more.items()]))


def name_bound(a: Column, b: Column, a_words: Column, b_words: Column) -> Column:
    """What name_score() can be at most, from letter_bits() and the names' words: 1 where a word is shared or repeats."""
    common = F.bit_count(a["low"].bitwiseAND(b["low"])) + F.bit_count(a["high"].bitwiseAND(b["high"])) + F.least(a["over"], b["over"])
    sets = a["repeats"] | b["repeats"] | F.arrays_overlap(a_words, b_words)
    return F.when(sets, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * common / F.greatest(a["n"] + b["n"], F.lit(1))))


def lcs_native(a: Column, b: Column) -> Column:
    """Longest common subsequence as a dynamic programme in built-in functions."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")

    def next_row(row: Column, x: Column) -> Column:
        grown = F.aggregate(
            F.sequence(F.lit(1), F.size(chars(b))),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(
                acc,
                F.array(
                    F.when(F.element_at(chars(b), j) == x, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, F.lit(-1))))
                ),
            ),
        )
        return F.when(F.length(b) > 0, grown).otherwise(row)

    start = F.array_repeat(F.lit(0), F.length(b) + 1)
    return F.element_at(F.aggregate(chars(a), start, next_row), F.lit(-1))


def indel_ratio_native(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_native(a, b) / total)


def address_tokens(address: Column) -> Column:
    """(numbers, streets, n): distinct number tokens and street tokens of an address, and how many street tokens."""
    tokens = words(F.regexp_replace(F.lower(fold(F.coalesce(address, F.lit("")))), r"[^a-z0-9\s]", ""))
    streets = F.filter(without(tokens, STOP_WORDS + STREET_WORDS), lambda t: ~t.rlike(r"^\d+$"))
    numbers = F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^\d+$")))
    return F.struct(numbers.alias("numbers"), F.array_distinct(streets).alias("streets"), F.size(streets).alias("n"))


def address_score(a: Column, b: Column) -> Column:
    """Of two address_tokens(): 1 for a shared number and street word, 0.5 for a number, up to 0.3 for street words."""
    number = F.arrays_overlap(a["numbers"], b["numbers"])
    common = F.size(F.array_intersect(a["streets"], b["streets"]))
    return F.when(number & (common > 0), 1.0).when(number, 0.5).otherwise(0.3 * common / F.greatest(a["n"], b["n"], F.lit(1)))


def total_score(name: Column, geo: Column, address: Column, settings: Settings) -> Column:
    """Weighted name and geo score with the address boost; ``address`` is null if either address is empty."""
    base = settings.weight_name * name + settings.weight_geo * geo
    boost = F.when(address > settings.strong_address, settings.strong_boost).when(address > settings.weak_address, settings.weak_boost)
    return F.when(boost.isNotNull(), F.least(F.lit(1.0), base + boost)).otherwise(base)
