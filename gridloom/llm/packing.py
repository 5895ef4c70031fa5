"""Packing documents into sequences by the sum-of-squares rule.

Each document is its token ids and one end id. Longer ones than a sequence are cut into full pieces, each of which
is a sequence, and a last shorter piece. Shorter pieces are dealt into blocks of some 16,384 by a hash; each block is
packed by one task, longest piece first: a piece goes where the squared counts of open sequences
per residual gap become smallest, or opens a sequence if that is what does. Closed sequences have no gap and don't
count. What is in sequences still open when a block ends is dealt and packed again, in
fewer blocks, until one block is left or no fewer; so the loss doesn't grow with the number of blocks.

Only lengths and places move between tasks; the token ids never leave the task that read the text.

Cases: a null or empty text is the end id alone; rows without an id, and repeated rows, are packed each
by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .tokens import word_tokenizer
from .text import tidy

LENGTH = 4096
END_ID = 1
BLOCK = 1 << 14
#: Bytes of text that are encoded at a time.
CHUNK_BYTES = 4 << 20

_PIECES = "id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", uid long, block long, sequence_id long, offset long, open boolean"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def chunks(batch: pa.RecordBatch, most: int = CHUNK_BYTES, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def cut(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``id, text``: where each starts in its document's ids, its length, and the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer_path)
        for batch in batches:
            for part in chunks(batch):
                ids, begins = words.encode(part.column(1))
                row, piece, start, size, crc = [], [], [], [], []
                for k, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                    own = np.empty(b - a + 1, "<u4")
                    own[:-1], own[-1] = ids[a:b], end_id
                    for p, at in enumerate(range(0, len(own), length)):
                        row.append(k)
                        piece.append(p)
                        start.append(at)
                        size.append(min(length, len(own) - at))
                        crc.append(crc32(own[at : at + length]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(tidy(run, keep_words=True), _PIECES)


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs sizes in the order given: the bin of each, its offset there, and each bin's gap at the end.

    With ``n(g)`` open bins of gap ``g``, moving a bin from g to h changes the sum of squares by
    ``2 (n(h) - n(g) + 1)``, closing it by ``1 - 2 n(g)``, and a new bin of gap g by ``2 n(g) + 1``. Of equals the smallest gap wins, and an open bin over a new one.
    """
    counts = np.zeros(length + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(length)]
    bins, offsets, gaps = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        before = counts[size:length]
        best, k = 2 * counts[length - size] + 1 if size < length else 0, -1
        if len(before):
            change = 2 * (counts[: length - size] - before + 1)
            change[0] = 1 - 2 * before[0]
            change[before == 0] = 1 << 60
            at = int(change.argmin())
            if change[at] <= best:
                k = at
        if k < 0:
            bins[i], offsets[i], gap = len(gaps), 0, length - size
            gaps.append(gap)
        else:
            counts[size + k] -= 1
            bins[i] = open_[size + k].pop()
            offsets[i], gap = length - size - k, k
            gaps[bins[i]] = gap
        if gap:
            counts[gap] += 1
            open_[gap].append(int(bins[i]))
    return bins, offsets, np.array(gaps, np.int64)


def _pack(round_: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(block: pa.Table) -> Iterator[pa.RecordBatch]:
            bins, offsets, gaps = sum_of_squares(block["length"].to_numpy(), length)
            number = (round_ << 56) | (block["block"][0].as_py() << 20)
            more = [pa.array(number | bins), pa.array(offsets), pa.array(gaps[bins] > 0)]
            yield from pa.table([*block.columns, *more], names=_NAMES).to_batches(1 << 14)

        held: list[pa.RecordBatch] = []
        for batch in batches:  # in order of block
            block = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column("block")[0].as_py() != block[a]:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from packed(pa.Table.from_batches(held))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece."""
    used = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = materialise(cut(used, tokenizer_path, length, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    shown = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.where(F.col("length") == length)
    out = full.withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long")).select(shown)
    left, round_ = pieces.where(F.col("length") < length), 0
    blocks = max(1, -(-left.count() // block))
    while True:
        dealt = left.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(blocks))).repartition(blocks, "block")
        placed = materialise(dealt.sortWithinPartitions("block", F.desc("length"), "uid").mapInArrow(tidy(_pack(round_, length), keep_words=True), _PACKED), "packed")
        left = placed.where("open").select(*pieces.columns)
        fewer = max(1, -(-left.count() // block)) if blocks > 1 else blocks
        if fewer == blocks:
            return out.unionByName(placed.select(shown))
        out = out.unionByName(placed.where("not open").select(shown))
        blocks, round_ = fewer, round_ + 1


def default_tokenizer() -> str:
    """The tokenizer file that the queries take when no other path is given."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path or default_tokenizer())
    return packed.withColumnRenamed("id", "doc_id")
