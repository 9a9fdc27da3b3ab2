"""Whole columns of text through a tokenizer at once.

Pre-tokenizers of the supported vocabularies never let a token cross the place before a single
space. So a text without unusual white space is the sum of its space-led words, a word's ids do not
depend on its neighbours, and each distinct word needs the tokenizers library only once. Texts in
which that argument does not hold (runs of white space, tabs, non-ASCII spaces, NUL) go through the
library whole. Both ways give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import ctypes
import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

#: White space that the word-wise way does not cover: at either end, in runs, or not a blank or line feed.
IRREGULAR = (
    r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00-\x09\x0B-\x1F\x{7F}-\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]"
)
#: Between a letter of either case and one of these marks a word always ends, in every supported vocabulary.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r",.;:!?|*%$#&"
#: Characters of text handled together; bounds a worker's memory.
SLICE_CHARS = 2_000_000
#: Words that an encoder remembers, of which each worker has one: most words of a corpus come seldom, and a memo of more of them takes more memory than it saves time.
MEMO_WORDS = 250_000


def byte_characters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies show each byte.

    Printable Latin-1 characters stand for themselves; the other bytes get the characters from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BulkEncoder:
    """Encodes Arrow string arrays; ``drops_space`` tells that the vocabulary ignores white space.

    ``memo_limit`` bounds the remembered words: the memo starts anew when it is full, which costs
    time and changes no result.
    """

    def __init__(self, tokenizer, drops_space: bool, memo_limit: int = MEMO_WORDS):
        self.tokenizer, self.drops_space, self.memo_limit = tokenizer, drops_space, memo_limit
        self.plain = re.compile(f" ?[{LETTERS}]+").fullmatch
        # a word of letters alone is one piece: the library's model gets it in byte characters, many in a call
        self.shown = byte_characters()
        self.words = Tokenizer(tokenizer.model)
        self.words.pre_tokenizer = Split(self.shown[0], behavior="removed")
        vocabulary = tokenizer.get_vocab()
        self.width = np.zeros(1 + max(vocabulary.values()), np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>") if drops_space else token)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.arena = np.zeros(8192, np.uint32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        plain = self.plain
        for simple in (True, False):
            some = [w for w in words if (plain(w) is not None) is simple]
            for k in range(0, len(some), 20_000):
                (self._learn_plain if simple else self._learn_odd)(some[k : k + 20_000])

    def _learn_plain(self, words: list[str]) -> None:
        shown = "\0".join(words)
        if self.drops_space:
            shown = shown.lower()
        shown = shown.encode().decode("latin-1").translate(self.shown).split(self.shown[0])
        groups = [self.shown[0].join(shown[k : k + 100]) for k in range(0, len(shown), 100)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.words.encode_batch_fast(groups, add_special_tokens=False)])
        ends = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)))
        upto = np.searchsorted(np.cumsum(self.width[ids]), ends, side="right")
        self._add(words, ids, np.diff(upto, prepend=0))

    def _learn_odd(self, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self._add(words, np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths)

    def _add(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.slots), len(words)
        while first + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(flat) > len(self.arena):
            self.arena = np.resize(self.arena, 2 * len(self.arena))
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + n] = lengths
        self.arena[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.slots.update(zip(words, range(first, first + n)))

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring_regex(texts, f"([{LETTERS}])([{MARKS}])", "\\1\0\\2")
        if self.drops_space:
            texts = pc.replace_substring(pc.replace_substring(pc.ascii_lower(texts), "\n", "\0"), " ", "\0")
        else:
            texts = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        parts = pc.split_pattern(texts, "\0")
        words = pc.dictionary_encode(parts.values)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slots) + len(distinct) > self.memo_limit:
            self._forget()
        if new := [w for w in distinct if w not in self.slots]:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))
        at = slot[words.indices.to_numpy()]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.arena[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[parts.offsets.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more offset than texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, IRREGULAR), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._regular(texts)
        ids, offsets = self._regular(texts.filter(pa.array(~odd)))
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = np.diff(offsets)
        own = {}
        for i in np.flatnonzero(odd):
            own[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            counts[i] = len(own[i])
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(ends[-1], np.uint32)
        out[np.repeat(~odd, counts)] = ids
        for i, x in own.items():
            out[ends[i] : ends[i + 1]] = x
        return out, ends


@functools.cache
def trim():
    """The C library's call that returns free memory to the system, or nothing where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def hand_back() -> None:
    """Return what a batch no longer needs: workers stay for later stages, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    trim()(0)


def slices(texts: pa.Array, most: int = SLICE_CHARS):
    """(from, to) runs of rows that hold at most ``most`` bytes each, or one row. What a run took is handed back before the next one."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin, n = 0, len(texts)
    while begin < n:
        before = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, before + most, side="right")))
        yield begin, end
        begin = end
        hand_back()


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as one array with 64-bit offsets, so that no batch is too long for it."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
