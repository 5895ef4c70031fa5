"""Document fingerprints by order MinHash.

A document's k-mers are runs of ``K`` words, each numbered by how often it occurred before in the
document. A word of more than ``LONG_WORD`` code points counts as its runs of ``PIECE`` code points, one from each
place, so texts without spaces have k-mers, too. For each of ``SLOTS`` hash functions the ``TUPLE`` numbered k-mers with the smallest
hashes are selected, put back in text order, and hashed as one tuple. Two documents agree in a slot if they share
those k-mers in that order, so moved passages count as edits and not only missing ones.

Texts of a batch are worked on together: words are hashed once for each different word, and the minima of
all documents are taken by segmented reductions.

Cases: a null or empty text, or one of white space, has no words: its fingerprint is a constant and it is like any other such text;
with fewer words than ``K`` all of them are the one k-mer; repeated rows and equal texts get equal fingerprints; an empty table gives no rows;
other columns are ignored. ``with_successors`` puts a null id first and orders rows that share an id by their texts' hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import chunks
from .text import tidy

K = 2
TUPLE = 2
SLOTS = 32
LONG_WORD, PIECE = 20, 8

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(2**64 - 1)
_NULL_ID = -(1 << 63)
_EXACT = 1 << 53


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def kmers(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every k-mer of the texts, in text order."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_utf8()), ""))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    row, flat = np.repeat(np.arange(len(texts)), sizes), lists.flatten()
    some = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
    at = (coded.indices.to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, np.int64))[some]
    row, word = row[some], hashes[at]
    if not len(row):
        return row, word
    letters = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    if (letters[at] > LONG_WORD).any():
        row, word = _in_pieces(row, at, hashes, letters, vocabulary)
    count = np.bincount(row, minlength=len(texts))
    begins = np.cumsum(count) - count
    place = np.arange(len(row)) - begins[row]
    code, left = np.zeros(len(row), np.uint64), count[row] - place
    for i in range(k):
        inside = left > i
        more = np.zeros(len(row), np.uint64)
        more[inside] = word[np.flatnonzero(inside) + i]
        code = mix(code + _STEP + more)
    keep = (left >= k) | (place == 0)
    return row[keep], code[keep]


def _in_pieces(row: np.ndarray, at: np.ndarray, hashes: np.ndarray, letters: np.ndarray, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the words, long ones as their pieces."""
    long = letters > LONG_WORD
    size = np.where(long, letters - PIECE + 1, 1)
    start = np.cumsum(size) - size
    flat = np.empty(size.sum(), np.uint64)
    flat[start[~long]] = hashes[~long]
    for v in np.flatnonzero(long).tolist():
        points = np.frombuffer(vocabulary[v].decode().encode("utf-32-le"), "<u4").astype(np.uint64)
        code = np.zeros(size[v], np.uint64)
        for i in range(PIECE):
            code = mix(code + _STEP + points[i : i + size[v]])
        flat[start[v] : start[v] + size[v]] = code
    each = size[at]
    return np.repeat(row, each), flat[np.arange(each.sum()) + np.repeat(start[at] - (np.cumsum(each) - each), each)]


def signatures(texts: pa.Array, k: int = K, size: int = TUPLE, slots: int = SLOTS) -> np.ndarray:
    """A matrix of 32-bit numbers: a row a text, a column a slot."""
    n = len(texts)
    out = np.zeros((n, slots), np.uint32)
    row, code = kmers(texts, k)
    if not len(row):
        return out
    # Number the occurrences of each k-mer in its row.
    order = np.lexsort((np.arange(len(row)), code, row))
    new = np.ones(len(row), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (code[order][1:] != code[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    occurrence = np.empty(len(row), np.uint64)
    occurrence[order] = (np.arange(len(row)) - start).astype(np.uint64)
    numbered = mix(code + _STEP * (occurrence + np.uint64(1)))
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    count = np.diff(np.append(first, len(row)))
    at = np.arange(len(row))
    for slot in range(slots):
        rank = mix(numbered ^ mix(np.array([slot + 1], np.uint64) * _STEP))
        chosen = np.full((len(first), size), len(row), np.int64)
        for j in range(size):
            least = np.minimum.reduceat(rank, first)
            hit = np.flatnonzero((rank == np.repeat(least, count)) & (rank != _TOP))
            of = np.searchsorted(first, hit, "right") - 1
            of, once = np.unique(of, return_index=True)
            chosen[of, j] = at[hit[once]]
            rank[hit[once]] = _TOP
        chosen.sort(1)  # back to text order; what a short text lacks comes last
        value = np.zeros(len(first), np.uint64)
        for j in range(size):
            there = chosen[:, j] < len(row)
            value = mix(value + _STEP + np.where(there, code[np.minimum(chosen[:, j], len(row) - 1)], 0).astype(np.uint64))
        out[row[first], slot] = (value >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the slots in which two fingerprints agree."""
    return (a == b).mean(1)


def as_text(signature: np.ndarray) -> list[str]:
    """Eight lowercase hex digits a slot."""
    return [x.astype(">u4").tobytes().hex() for x in signature]


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(as_text(signatures(pa.array(part.column(1).to_pylist(), pa.string()))), pa.string())], names=["id", "fingerprint"])

    used = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return used.mapInArrow(tidy(run), "id long, fingerprint string")


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``id, text, tail`` dealt and sorted so that each row's successor by id follows it.

    Ids are cut into as many ranges as there are shuffle partitions, at approximate quantiles; a partition holds
    one range and, last and marked ``tail``, the first row of the next (of the first range after the last one). Texts move once.
    Rows that share an id follow each other by their texts' hashes, and an id on which several cuts fall is cut again
    at quantiles of these, so one id's rows are many tasks'. Only rows equal in id and text are never parted.
    """
    spark = docs.sparkSession
    used = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    used = used.select("id", "text", F.shiftright(F.xxhash64("text"), 11).alias("mark"))  # quantiles are exact for numbers of 53 bits
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / ranges for k in range(1, ranges)]
    found = used.agg(F.min("id").alias("least"), F.percentile_approx("id", cuts or [0.5], 20 * ranges).alias("cuts")).first()
    drawn = (found["cuts"] or []) if cuts else []
    if wide := sorted({x for x in drawn if abs(x) > _EXACT}):  # rounded to a double: the next id that there is takes its place
        there = used.agg(*[F.min(F.when(F.col("id") >= x, F.col("id"))) for x in wide]).first()
        real = dict(zip(wide, there, strict=True))
        drawn = [y for x in drawn if (y := real.get(x, x)) is not None]
    times = Counter(drawn)
    hot = [x for x, n in times.items() if n > 1]
    # An id is either whole in its range, whose head is then any of its rows, or begins ranges at some of its marks.
    begins = {(x, None) for x in {found["least"], *times} - {None, *hot}}
    if hot:
        marks = F.percentile_approx("mark", cuts, 20 * ranges).alias("cuts")
        for row in used.where(F.col("id").isin(hot)).groupBy("id").agg(F.min("mark").alias("least"), marks).collect():  # a row a hot id, fewer than ranges
            parts = times[row["id"]] + 1
            begins |= {(row["id"], m) for m in (row["least"], *(row["cuts"][k * ranges // parts - 1] for k in range(1, parts)))}
    ordered = sorted(begins or {(0, None)}, key=lambda x: (x[0], x[1] or 0))
    starts, whole = np.array([x for x, _ in ordered], np.int64), np.array([m is None for _, m in ordered])
    least = np.array([m or 0 for _, m in ordered], np.int64)
    last = len(starts) - 1

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, marks: pd.Series) -> pd.Series:
        i, m = ids.to_numpy(), marks.to_numpy()
        own = np.searchsorted(starts, i, "right") - 1
        for x in hot:
            rows, first, end = np.flatnonzero(i == x), np.searchsorted(starts, x), np.searchsorted(starts, x, "right")
            own[rows] = first + np.searchsorted(least[first:end], m[rows], "right") - 1
        heads = (starts[own] == i) & (whole[own] | (least[own] == m))
        return pd.Series([[r, r - 1 if r else last] if h else [r] for r, h in zip(own.tolist(), heads.tolist(), strict=True)])

    dealt = used.select("id", "text", "mark", F.posexplode(places("id", "mark")).alias("copy", "range"))
    dealt = dealt.select("id", "text", "mark", (F.col("copy") > 0).alias("tail"), "range").repartitionById(last + 1, F.col("range"))
    return dealt.sortWithinPartitions("tail", "id", "mark", "text").select("id", "text", "tail")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many first ones of the following text, or all it has."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, str, bool]] = []
    for batch in batches:
        for part in chunks(batch):
            rows = held + list(zip(*[c.to_pylist() for c in part.columns], strict=True))
            held = rows[-1:]
            # Of several tails the first is the successor; the others, and tails themselves, have no rows here.
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[2]]
            if not pairs:
                continue
            own = signatures(pa.array([a[1] for a, _ in pairs] + [pairs[-1][1][1]], pa.large_string()))
            changed = [edited(a[1], b[1]) for a, b in pairs]
            new = signatures(pa.array(changed, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if a[0] == _NULL_ID else a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    pa.array(as_text(own[:-1])),
                    pa.array(as_text(new)),
                    pa.array(likeness(own[:-1], new)),
                    pa.array(likeness(own[:-1], own[1:])),
                ],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_successors(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(tidy(_compare), _OUT)
