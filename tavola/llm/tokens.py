"""Token ids of whole texts, word by word, with a bounded cache.

The vocabulary's pre-tokenizer never joins characters across white space, so the ids of a text are the
ids of its white-space-separated chunks, one after another.  Corpora repeat words, so a chunk's ids are
kept as little-endian 32-bit bytes and a text becomes one ``bytes.join``.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Characters that str.split() takes for white space and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A run of these after letters is a pre-token of its own.
_TAIL = string.punctuation
#: Characters of texts whose words are looked up together.
GROUP_CHARS = 1 << 14
#: Longer chunks (blobs, sentences in scripts without blanks) are forgotten with their group.
KEPT_CHARS = 64


def _lowered(text: str) -> str | None:
    """The text in lower case if that changes no id, else None.

    It must be normalised before and after, its lower case be made letter by letter, and it must not hold a special
    token, which is told by case.
    """
    if "<|" in text:
        return None
    low = text.lower()
    if text.isascii() or "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
        return low
    return None


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257 and so on; the blank, which parts words, stays."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others) if b != 32}


class WordTokenizer:
    """Encodes texts as ``tokenizers`` does with ``add_special_tokens=False``.

    ``cache_entries`` bounds the memory of one worker (about 200 bytes an entry, and 1.5 KB at most, as only chunks of
    KEPT_CHARS characters stay); a full cache forgets rare words.
    """

    def __init__(self, path: str | None = None, cache_entries: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        path = path or default_tokenizer_path()
        self._tokenizer = Tokenizer.from_file(path)
        # The same model for lower-case words of letters, which need no normaliser and no pattern.
        self._plain = Tokenizer.from_file(path)
        self._plain.normalizer, self._plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self._bytes = _byte_letters()
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._limit = cache_entries
        self._cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """The ids of a text by the tokenizer alone."""
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: list[str], lowered: bool) -> None:
        cache, letters, others, composed = self._cache, [], [], []
        for w in missing:
            if not lowered:
                others.append(w)
            elif w.isalpha():
                letters.append(w)
            elif (body := w.rstrip(_TAIL)).isalpha():
                composed.append((w, body, w[len(body) :]))
            else:
                others.append(w)
        if composed:
            letters = list({*letters, *{body for _, body, _ in composed}.difference(cache)})
            others += {tail for _, _, tail in composed}.difference(cache, others)
        if letters:
            self._learn_letters(letters)
        if others:
            for w, e in zip(others, self._tokenizer.encode_batch(others, add_special_tokens=False)):
                cache[w] = np.array(e.ids, "<u4").tobytes()
        for w, body, tail in composed:
            cache[w] = cache[body] + cache[tail]

    def _learn_letters(self, words: list[str]) -> None:
        """Lower-case words of letters are one pre-token each, so many fit in one call; a word's last id ends it."""
        joined = " ".join(words)
        if not joined.isascii():
            joined = joined.encode().decode("latin-1").translate(self._bytes)
        ids = np.array(self._plain.encode(joined, add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            for w in words:
                self._cache[w] = self.whole(w)
            return
        data, at = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist()):
            self._cache[w] = data[at:end]
            at = end

    def _forget(self) -> None:
        """Drop rare words: those of many ids go first, as words of few ids are the common ones."""
        cache = self._cache
        for most in (12, 8, 4):
            for w in [w for w, ids in cache.items() if len(ids) > most]:
                del cache[w]
            if len(cache) <= self._limit // 2:
                return
        cache.clear()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, end to end."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """encode() of each text; words are learnt for GROUP_CHARS at a time."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, chars = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[bytes]:
        cache, split, new, as_is = self._cache, [], set(), set()
        for text in texts:
            if _ODD_SPACE.search(text):
                split.append(None)
                continue
            low = _lowered(text)
            words = (text if low is None else low).split()
            split.append(words)
            (as_is if low is None else new).update(words)
        if len(cache) + 2 * (len(new) + len(as_is)) > self._limit:
            self._forget()
        long: list[str] = []
        for words_, lowered in ((new, True), (as_is, False)):
            if missing := list(words_.difference(cache)):
                self._learn(missing, lowered)
                long += [w for w in missing if len(w) > KEPT_CHARS]
        for text, words in zip(texts, split):
            yield self.whole(text) if words is None else b"".join(map(cache.__getitem__, words))
        for w in long:
            cache.pop(w, None)


@lru_cache(2)
def shared_tokenizer(path: str, cache_entries: int = 500_000) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker, so that they share its cache."""
    return WordTokenizer(path, cache_entries)
