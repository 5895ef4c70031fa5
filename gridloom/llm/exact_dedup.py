"""Exact duplicates through an extendible-hash index on shared files.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``.
Keys are XXH64 of the remaining bytes. (1) A scan writes each row's key and digest.
(2) The directory starts with one bucket and doubles until no bucket has more distinct keys
than its capacity; it is built from counts by key prefix, never from keys, and is
a sorted list of range starts. (3) Map tasks collapse the copies they hold,
comparing bytes, so a text that fills a third of the table leaves each task once a
buffer; what is left goes to the owner of its key range, copies of hot keys by way of a few tasks that merge them. (4) An owner
walks its range in key order, chains different texts under one key, merges equal ones by
comparing bytes, and writes its part of the index to the shared folder. (5) Rows
look up their entry by key and digest; a popular entry is a skewed join of two
plain exchanges, which adaptive execution splits.

Of equal texts the row with the most code points in the original text stays, then the one with the
smallest id; a null id counts as the largest. Cases: a null text is empty, and
empty texts equal one another and those of white space alone; of fully repeated rows one stays; an empty
table gives no rows; other columns don't matter to what stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .text import SPACES, batches_of, text_bytes, tidy

#: Distinct keys in a bucket of the index, at most, unless one prefix of 64 bits has more.
CAPACITY = 1 << 13
#: Buckets of the directory, at most: 8 bytes each in the broadcast. Beyond it the capacity doubles.
MAX_BUCKETS = 1 << 20
#: Bytes of texts that a map task holds to collapse copies before it sends them on.
BUFFER_BYTES = 48 << 20
#: Bits by which counts of overfull prefixes are refined at a time, and the deepest prefix.
STEP, DEEPEST = 12, 63
#: A key of so many rows is hot, or of one row in so many where that is more, so that hot keys are few: 8 bytes each in the broadcast.
HOT_ROWS, HOT_SHARE = 1000, 10_000
#: Tasks that merge a hot key's copies before its owner does.
SALTS = 16
NO_ID = (1 << 63) - 1
_OFFSET = 1 << 63


def normalise(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def key_of(normal: bytes) -> int:
    """XXH64 moved to a signed long whose order is that of the unsigned value."""
    return xxhash.xxh64_intdigest(normal) - _OFFSET


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        normal = [normalise(t) for t in text_bytes(batch.column(1))]
        chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), chars, pa.array([key_of(x) for x in normal], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in normal], pa.binary())],
            names=["id", "chars", "key", "sha"],
        )


def _prefix(depth: int) -> F.Column:
    """The first ``depth`` bits of the unsigned key."""
    return F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-_OFFSET)), 64 - depth)


def extendible_directory(keys: DataFrame, capacity: int = CAPACITY, max_buckets: int = MAX_BUCKETS) -> list[int]:
    """First key of each bucket, ascending, as unsigned numbers.

    A bucket of local depth d holds the keys of one d-bit prefix; one with more distinct keys than
    ``capacity`` is split in two, which doubles the directory where it was as deep as the directory. Counts by prefix are tables: a
    prefix is a bucket if it fits and the one above it doesn't. Only the starts of buckets come to the driver.
    """
    distinct = materialise(keys.select("key").distinct(), "dedup-distinct")
    total = distinct.count()
    while total > capacity * max_buckets // 2:
        capacity *= 2
    starts, top, inside = [], 0, distinct
    while True:
        expected = (total // capacity).bit_length() + 3 if top == 0 else top + STEP
        depth = min(DEEPEST, max(top + 1, expected))
        counted = inside.groupBy(_prefix(depth).alias("leaf")).agg(F.count(F.lit(1)).alias("m"))
        each = counted.select("m", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("d"), "leaf")
        nodes = materialise(each.groupBy("d", F.expr(f"shiftrightunsigned(leaf, {depth} - d)").alias("p")).agg(F.sum("m").alias("n")), "dedup-prefixes")
        above = nodes.where(F.col("n") > capacity).select((F.col("d") + 1).alias("d"), F.col("p").alias("above"))
        fits = nodes.where((F.col("n") <= capacity) | (F.col("d") == DEEPEST)).withColumn("above", F.shiftrightunsigned("p", 1))
        buckets = fits.where((F.col("d") > 0) & (F.col("d") > top)).join(above, ["d", "above"], "left_semi").unionByName(fits.where("d = 0"))
        starts += [r["p"] << (64 - r["d"]) for r in buckets.select("p", "d").toLocalIterator()]
        overfull = nodes.where((F.col("d") == depth) & (F.col("n") > capacity)).select(F.col("p").alias("over"))
        if depth == DEEPEST or overfull.isEmpty():
            return [0, *sorted(starts)[1:]]
        inside, top = distinct.join(overfull, _prefix(depth) == F.col("over"), "left_semi"), depth


class _Entry:
    __slots__ = ("best", "normal", "rows", "same")

    def __init__(self, normal: bytes, best: tuple[int, int], rows: int = 1, same: int = 1):
        self.normal, self.best, self.rows, self.same = normal, best, rows, same

    def add(self, best: tuple[int, int], rows: int = 1, same: int = 1) -> None:
        """best: minus the code points and the id, so that the smallest stays; same: how many rows have just these."""
        self.rows += rows
        if best < self.best:
            self.best, self.same = best, same
        elif best == self.best:
            self.same += same


def _insert(table: dict[int, list[_Entry]], key: int, entry: _Entry) -> bool:
    chain = table.setdefault(key, [])
    for x in chain:
        if x.normal == entry.normal:
            x.add(entry.best, entry.rows, entry.same)
            return False
    chain.append(entry)
    return True


_HEADS = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("normal", pa.binary()), ("rows", pa.int64()), ("minus_chars", pa.int64()), ("id", pa.int64()), ("same", pa.int64())])
_INDEX = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.binary()), ("rows", pa.int64()), ("keep_chars", pa.int64()), ("keep_id", pa.int64()), ("same", pa.int64())])
_sql = lambda schema: ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'})[f.type]}" for f in schema)


def _collapse(starts: list[int], hot: frozenset[int] = frozenset(), only: bool = False):
    """Copies that a task holds become one; of the rows with a hot key, or with ``only`` of no others."""
    first = np.array(starts, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(table):
            keys = list(table)
            buckets = np.searchsorted(first, np.array([k + _OFFSET for k in keys], np.uint64), "right") - 1
            for k, b in zip(keys, buckets.tolist(), strict=True):
                for x in table[k]:
                    yield b, k, x.normal, x.rows, x.best[0], x.best[1], x.same

        table, held = {}, 0
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for id_, n, text in zip(batch.column(0).to_pylist(), chars, text_bytes(batch.column(1)), strict=True):
                normal = normalise(text)
                key = key_of(normal)
                if (key in hot) is only and _insert(table, key, _Entry(normal, (-n, NO_ID if id_ is None else id_))):
                    held += len(normal)
                if held >= BUFFER_BYTES:
                    yield from batches_of(rows(table), _HEADS, 1024)
                    table, held = {}, 0
        yield from batches_of(rows(table), _HEADS, 1024)

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[_Entry]]]:
    """Bucket, key and different texts of rows in key order; only the chain of one key is held."""
    at, table = None, {}
    for batch in batches:
        for bucket, key, normal, n, minus, id_, same in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at is not None and key != at[1]:
                yield *at, table.pop(at[1])
            at = bucket, key
            _insert(table, key, _Entry(normal, (minus, id_), n, same))
    if at is not None:
        yield *at, table[at[1]]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some tasks' copies of a hot key as one."""
    yield from batches_of(((b, k, x.normal, x.rows, x.best[0], x.best[1], x.same) for b, k, chain in _chains(batches) for x in chain), _HEADS, 1024)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's part of the index."""
    yield from batches_of(((b, k, c, hashlib.sha256(x.normal).digest(), x.rows, -x.best[0], x.best[1], x.same) for b, k, chain in _chains(batches) for c, x in enumerate(chain)), _INDEX)


def build_index(docs: DataFrame, keys: DataFrame, capacity: int = CAPACITY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The index over ``id, text`` as a table in the shared folder, one row for each different text."""
    starts = extendible_directory(keys, capacity)
    least = max(hot_rows, -(-keys.count() // HOT_SHARE))
    hot = frozenset(r["key"] for r in keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("key").toLocalIterator())
    heads = docs.mapInArrow(tidy(_collapse(starts, hot)), _sql(_HEADS))
    if hot:  # each task has a copy of these: a few tasks merge them for the owner
        salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
        dealt = docs.mapInArrow(tidy(_collapse(starts, hot, only=True)), _sql(_HEADS)).withColumn("salt", salt).repartition("key", "salt")
        heads = heads.unionByName(dealt.sortWithinPartitions("key").drop("salt").mapInArrow(tidy(_merge), _sql(_HEADS)))
    owned = heads.repartition(max(1, min(len(starts), 1 << 16)), "bucket").sortWithinPartitions("bucket", "key")
    return materialise(owned.mapInArrow(tidy(_own), _sql(_INDEX)), "hash-index")


def _found(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> tuple[DataFrame, bool]:
    """Each row with its entry of the index; whether whole rows repeat."""
    used = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = materialise(used.mapInArrow(tidy(_keys), "id long, chars long, key long, sha binary"), "dedup-keys")
    index = build_index(used, keys, capacity).select(F.col("key").alias("at"), F.col("sha").alias("of"), "rows", "keep_chars", "keep_id", "same")
    found = keys.join(index, (F.col("key") == F.col("at")) & (F.col("sha") == F.col("of")), "left")
    best = (F.coalesce("id", F.lit(NO_ID)) == F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    found = found.select("id", "chars", F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"), F.col("rows").alias("group_size"), best.alias("kept"), "sha", "same")
    return found, not index.where("same > 1").isEmpty()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(id, chars, keep_id, group_size, kept, sha)`` for every row."""
    found, repeats = _found(docs, id_col, text_col, capacity)
    if not repeats:
        return found.drop("same")
    # Whole rows repeat: one of each stays, told apart by numbers that are written before they are compared.
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "dedup-repeats")
    first = materialise(found.where("kept and same > 1").groupBy(F.col("sha").alias("of")).agg(F.min("row").alias("first_row")), "dedup-first")
    found = found.join(first, F.col("sha") == F.col("of"), "left")
    return found.withColumn("kept", F.col("kept") & (F.col("first_row").isNull() | (F.col("row") == F.col("first_row")))).drop("same", "row", "of", "first_row")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of equal texts the longest original stays, then the smallest id, null last, also where equal texts share an id; of rows that are alike in
    all of these, one. A null text is empty; no rows give no rows.
    """
    found, repeats = _found(docs, id_col, text_col, capacity)
    kept = found.where("kept").select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "sha", "chars").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.unhex(F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), 256))
    tagged = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), sha.alias("sha"), F.char_length(text).cast("long").alias("chars"))
    if repeats:  # map tasks collapse what they hold
        tagged = tagged.dropDuplicates(["id", "sha", "chars"])
    # Both sides grow with the documents: neither may be broadcast, whatever its size just now.
    return tagged.join(kept.hint("merge"), ["id", "sha", "chars"], "left_semi").select("row.*")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
