"""Token ids of whole texts, by a public tokenizer file, a batch at a time.

White space separates words for this kind of tokenizer: it is dropped, and no token or
normal form spans it. So a batch's texts are split in Arrow, and the tokenizer sees each
different word once. A run of plain punctuation after a word's last letter is never part of a token with
it, so a space is put between; ASCII words are lower-cased first, as the tokenizer does.
Both leave fewer different words. Words already met are kept, up to a bound.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import compact

#: Words kept between batches, at most.
KEPT_WORDS = 500_000
#: Signs that never join the letter before them, neither in a token nor in a normal form, at the end of a word.
_TAIL = r"(\pL)([.,!?;:$%&*#|)]+)(\s|$)"


class WordTokenizer:
    """Encodes batches with the tokenizer file at ``path``; ``encode(batch)`` equals the tokenizer's own ids, text by text."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.ids, self.ends = array("I"), array("q", [0, 0])

    def _encode(self, words: list[str]) -> None:
        """Stores the ids of words that aren't known."""
        at, ids, ends = self.at, self.ids, self.ends
        for k in range(0, len(words), 8192):
            part = words[k : k + 8192]
            for word, x in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids.extend(x.ids)
                at[word] = len(ends) - 1
                ends.append(len(ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch in one array, and where each text's begin (one more than there are texts); null is empty."""
        if len(self.at) > self.kept:
            self._clear()
        plain = pc.fill_null(compact(texts).cast(pa.large_utf8()), "")
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _TAIL, r"\1 \2\3"))
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        words = lists.flatten()
        # A word with "<|" may hold a special token, whose case matters.
        fold = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        coded = pc.if_else(fold, pc.ascii_lower(words), words).dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False)
        vocabulary = coded.dictionary.to_pylist()
        known = list(map(self.at.get, vocabulary))
        if new := [w for w, k in zip(vocabulary, known, strict=True) if k is None]:
            self._encode(new)
            known = list(map(self.at.get, vocabulary))
        # Copies, as an array that is being looked at can't grow.
        ids, ends = np.array(self.ids, np.uint32), np.array(self.ends, np.int64)
        at = np.array(known, np.int64)[word] if len(word) else np.empty(0, np.int64)
        out, begins = _gather(ids, ends[at], ends[at + 1])
        return out, begins[edges]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer: its tasks follow one another and share what words they have met."""
    return WordTokenizer(path)


def _gather(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[first:end]`` one after another, and where each begins (one more than there are slices)."""
    sizes = end - first
    begins = np.concatenate(([0], np.cumsum(sizes)))
    narrow = np.int32 if max(begins[-1], len(values)) < 1 << 31 else np.int64
    take = np.repeat((first - begins[:-1]).astype(narrow), sizes)
    take += np.arange(begins[-1], dtype=narrow)
    return values[take], begins
