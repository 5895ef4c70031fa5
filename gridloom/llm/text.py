"""Word and byte access shared by the operators of this subpackage.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, which is what
``bytes.split()`` takes; ``bytes.lower()`` changes A-Z alone. A null text is empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a batch, null as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    for x in column:
        yield x.as_py() or b""


def tidy(run: Callable[[Iterator], Iterator], keep_words: bool = False) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker gives freed memory back: workers are used again, and theirs counts with their executor's.

    Words that a tokenizer keeps from task to task are forgotten first, unless ``keep_words``.
    """

    def wrapped(batches: Iterator) -> Iterator:
        if not keep_words:
            _forget_words()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def _forget_words() -> None:
    from .tokens import word_tokenizer  # which imports this module

    if word_tokenizer.cache_info().currsize:
        word_tokenizer.cache_clear()
        _give_back()


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def fold(key: int | None, parts: int) -> int:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return crc32(b"" if key is None else str(key).encode()) % parts


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows to record batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def compact(column: pa.Array) -> pa.Array:
    """A column that begins its buffers: splitting a slice of a longer one goes wrong in Arrow."""
    return column.take(pa.array(np.arange(len(column)))) if column.offset else column


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of a batch as (row of each word, index of each word in the vocabulary, vocabulary).

    Texts are lower-cased in A-Z first. Splitting and dictionary encoding run in Arrow.
    """
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(compact(column).cast(pa.large_utf8())), ""))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    keep = pc.not_equal(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(column)), sizes)
    if not pc.all(keep).as_py() and len(flat):
        row, flat = row[keep.to_numpy(zero_copy_only=False)], flat.filter(keep)
    coded = flat.dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.large_binary()).to_pylist()
