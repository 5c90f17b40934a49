"""Encoding whole texts chunk by chunk, where a chunk is a stretch that no token crosses.

A byte-level pre-token is an optional space and what follows it up to the next white space, or white space alone; a word-level
one never holds white space. So the ids of a text are the ids of its chunks in a row, and a chunk needs to be encoded once
as long as a bounded memo holds it.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import enter, memo

# The characters with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORDS = re.compile(f"[^{WHITE}]+")
#: Texts in which white space is more than single characters between others, or with the mark below; they are split by the patterns above.
UNEVEN = f"[{WHITE}][{WHITE}]|^[{WHITE}]|[{WHITE}]$|\x01"
#: A stop after a letter starts a token as well; in the column-wise split, MARK stands before such a stop.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
STOPPED, MARK = f"([{LETTERS}])([.,!?;:])", "\x01"
#: Estimated bytes that a memo may hold between two parts, and what an entry takes besides its text and ids.
MEMO, ENTRY = 256_000_000, 200
PART_BYTES = 8_000_000
_encoders: dict = {}
memo("chunks", _encoders.clear)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = _byte_letters()


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ChunkEncoder:
    """Little-endian unsigned 32-bit ids of texts; encode_chunks gives those of distinct chunks."""

    def __init__(self, pattern: re.Pattern, encode_chunks: Callable[[list[str]], Iterable[bytes]], most: int = MEMO):
        self.find, self.encode_chunks, self.most, self.memo, self.held = pattern.findall, encode_chunks, most, {}, 0
        self.spaced = pattern == SPACED  # not "is": tasks get copies

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """One after the other, a part of the texts at a time; null is empty."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) // PART_BYTES).astype(np.int64)
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            yield from self._encode(texts.slice(lo, hi - lo))

    def _encode(self, texts: pa.Array) -> list[bytes]:
        uneven = pc.match_substring_regex(texts, UNEVEN)
        odd = iter(self._by_pattern(texts.filter(uneven).to_pylist()))
        even = iter(self._by_space(texts.filter(pc.invert(uneven))))
        return [next(odd if x else even) for x in uneven.to_pylist()]

    def _learn(self, chunks: Collection[str]) -> None:
        """Sees to it that the memo has the chunks; where that takes it over its bound, what they don't need goes."""
        memo = self.memo
        new = [x for x in chunks if x not in memo]
        gc.disable()  # the many short-lived objects would set it off again and again
        try:
            for chunk, ids in zip(new, self.encode_chunks(new), strict=True):
                memo[chunk] = ids
                self.held += ENTRY + len(chunk) + len(ids)
        finally:
            gc.enable()
        if self.held > self.most:
            self.memo = {x: memo[x] for x in chunks}
            self.held = sum(ENTRY + len(x) + len(ids) for x, ids in self.memo.items())

    def _by_pattern(self, texts: list[str]) -> list[bytes]:
        split = [self.find(x) for x in texts]
        self._learn(set().union(*split))
        return [b"".join(map(self.memo.__getitem__, x)) for x in split]

    def _by_space(self, texts: pa.Array) -> list[bytes]:
        """The same where each white space stands alone: chunks are what lies between spaces and line feeds."""
        if not len(texts):
            return []
        stopped = pc.replace_substring_regex(texts, STOPPED, f"\\1 {MARK}\\2")
        lists = pc.split_pattern(pc.replace_substring(stopped, "\n", " \n "), " ")
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        key = codes
        if self.spaced:
            feed = codes == (words.index("\n") if "\n" in words else -1)
            bare = feed.copy()
            bare[1:] |= feed[:-1]
            bare[ends[:-1]] = True
            bare |= np.array([x[:1] == MARK for x in words], dtype=bool)[codes]
            key = np.where(bare, codes, codes + len(words))
        used = np.flatnonzero(np.bincount(key, minlength=2 * len(words)))
        chunks = [words[k].removeprefix(MARK) if k < len(words) else " " + words[k - len(words)] for k in used.tolist()]
        self._learn(chunks)
        own = list(map(self.memo.__getitem__, chunks))
        lengths = np.zeros(2 * len(words), dtype=np.int64)
        lengths[used] = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        starts = np.cumsum(lengths) - lengths
        times = lengths[key]
        after = np.cumsum(times)
        ids = np.frombuffer(b"".join(own), "<u4")[np.repeat(starts[key] - (after - times), times) + np.arange(after[-1])]
        cuts = np.concatenate([[0], after])[ends].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def encoder_of(path: str, pattern: re.Pattern, most: int = MEMO) -> ChunkEncoder:
    """library_encoder(), one for each process, so that its memo outlives a task.

    Tasks must come here for it: a function that is shipped to them brings copies of the globals that it names.
    """
    enter("chunks")
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = library_encoder(path, pattern, most)
    return _encoders[path, pattern]


def library_encoder(path: str, pattern: re.Pattern, most: int = MEMO) -> ChunkEncoder:
    """By the tokenizers library; the strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    spaced, merge = pattern == SPACED, tokenizer.model.tokenize
    word = re.compile(f" ?[{LETTERS}]+" if spaced else f"[{LETTERS}]+").fullmatch

    def encode(chunks: list[str]) -> Iterator[bytes]:
        # A word of Latin letters is one pre-token, and normalising only lowers it: it can go to the model directly.
        plain = [word(x) is not None for x in chunks]
        others = tokenizer.encode_batch_fast([x for x, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False)
        others = (x.ids for x in others)
        for x, p in zip(chunks, plain, strict=True):
            if p:
                x = (x if spaced else x.lower()).encode().decode("latin-1").translate(BYTES)
                yield packed([t.id for t in merge(x)])
            else:
                yield packed(next(others))

    return ChunkEncoder(pattern, encode, most)
