"""Token ids of whole texts, word by word, with a bounded cache.

The vocabulary in use cuts every text at white space before it merges anything, so the ids of a text are
the ids of its words, one after the other. Words repeat; a word goes through the tokenizer when the cache
doesn't hold it. `LIMIT` bounds the memory of the cache, not what is encoded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Words kept per Python worker, about 170 bytes each.
LIMIT = 1_200_000
#: Texts are looked up together up to so many bytes, new words encoded together up to so many words.
GROUP_BYTES, GROUP_WORDS = 4 << 20, 20_000
#: Rows of an Arrow column that become Python objects at a time.
SLICE = 128
#: A character that is a token of its own between spaces; it tells words apart that are encoded together.
MARK = "\x01"
#: A-Z with combining marks, one of them (U+0300 to U+036F) such that the small letter may have a composed form.
DECOMPOSED = re.compile(rb"[A-Z][\x80-\xff]*[\xcc\xcd]")


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z as a-z where the ids are the same."""
    if b"<|" in text:
        return text.split()
    if (b"\xcc" in text or b"\xcd" in text) and DECOMPOSED.search(text):
        return [word if DECOMPOSED.search(word) else word.lower() for word in text.split()]
    return text.lower().split()


def vocabulary_path() -> str:
    """The place of the vocabulary file on the machine that asks."""
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


class _Cache(dict):
    """Hands out an empty value for an unknown word and notes the word, to be filled in later."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> bytearray:
        self[word] = value = bytearray()
        self.new.append(word)
        return value


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, equal to those of the tokenizer on the whole text.

    Holds for tokenizers that cut at white space and drop it. Only white space of `[\\x20\\x09-\\x0D]` cuts
    here; other white space stays inside a "word" and is left to the tokenizer. A-Z become a-z first, as the
    vocabulary's normaliser does anyway, except in texts that may hold the string of a special token, and in words
    where it matters that the normaliser composes letters and marks first.
    """

    def __init__(self, path: str | None = None, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.limit = limit
        self.cache = _Cache()
        self.mark = self._ids(MARK)
        self.tails = {p: self._ids(p.decode()).tobytes() for p in (b",", b".")}
        if len(self.mark) != 1:
            raise ValueError("the vocabulary must have one token for the mark between words")

    def _ids(self, text: str) -> np.ndarray:
        encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(encoded.ids, dtype="<u4")

    def _fill(self) -> None:
        """Encode the words noted since the last call, many in one text."""
        plain, new = [], self.cache.new
        self.cache.new = []
        for word in new:
            if MARK.encode() in word:
                self._set(word, self._ids(word.decode()).tobytes())
            elif word[-1:] in self.tails and word[-2:-1].isalnum() and (core := self.cache.get(word[:-1])):
                self._set(word, core + self.tails[word[-1:]])  # punctuation after an ASCII letter stands alone
            else:
                plain.append(word)
        between = f" {MARK} ".encode()
        for k in range(0, len(plain), GROUP_WORDS):
            words = plain[k:k + GROUP_WORDS]
            ids = self._ids(between.join(words).decode())
            ends = (np.flatnonzero(ids == self.mark[0]) * 4).tolist() + [4 * len(ids)]
            data, start = ids.tobytes(), 0
            for word, end in zip(words, ends, strict=True):
                self._set(word, data[start:end])
                start = end + 4

    def _set(self, word: bytes, ids: bytes) -> None:
        self.cache[word].extend(ids)  # texts looked up already hold this very object
        self.cache[word] = ids

    def _shrink(self) -> None:
        """Early words are the frequent ones: keep the older half."""
        if len(self.cache) > self.limit:
            kept = list(islice(self.cache.items(), self.limit // 2))
            self.cache.clear()
            self.cache.update(kept)

    def each(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """The ids of one text (UTF-8; null is empty) after the other, looked up in groups of bounded size."""
        group: list[list] = []
        size, get = 0, self.cache.__getitem__
        for text in texts:
            text = text or b""
            group.append(list(map(get, words_of(text))))
            size += len(text)
            if size >= GROUP_BYTES:
                self._fill()
                yield from map(b"".join, group)
                group, size = [], 0
                self._shrink()
        self._fill()
        yield from map(b"".join, group)
        self._shrink()


@lru_cache(maxsize=2)
def shared_encoder(path: str | None = None, limit: int = LIMIT) -> WordEncoder:
    """One encoder per Python worker: its cache serves all tasks that the worker runs."""
    return WordEncoder(path, limit)


def utf8(column) -> Iterator[bytes | None]:
    """An Arrow string column as bytes without decoding, a slice at a time."""
    import pyarrow as pa
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    data = column.cast(kind)
    for at in range(0, len(data), SLICE):
        yield from data.slice(at, SLICE).to_pylist()
