"""Perceptual hashes, near-duplicate groups, and splits that keep a group together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import drop_table, materialise
from .ordering import hashed_rank, running

BITS = 64
#: Bands in a key, and keys of a hash, at most.
MOST_KEY, MOST_KEYS = 6, 2048
#: Comparisons of two hashes in an array that take as long as dealing a hash out by a key.
MOVING = 32.0
#: Hashes in a block, in a bucket about, and in a run that is compared without strips; pairs in a strip; bytes of hashes a task.
BLOCK, BUCKET, SHORT, CELLS, TASK_BYTES = 1 << 14, 1 << 17, 96, 1 << 17, 1 << 25
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Pairs, or blocks of hashes that share a value: the other columns are null.
_MET = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("d", pa.int32()), ("key", pa.int32()), ("value", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("hashes", pa.binary())])
_MET_SQL = "x long, y long, d int, key int, value long, block int, blocks int, hashes binary"


def sign_hash(v: str | Column) -> Column:
    """A 64-bit hash of the first 64 numbers of an array: bit i is set where element i is above zero."""
    v = F.col(v) if isinstance(v, str) else v
    bits = F.transform(F.slice(v, 1, BITS), lambda x, i: F.when(x > 0, F.element_at(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(BITS)]), i + 1)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def band_plan(most: int, rows: int, bits: int = BITS, moving: float = 1.0) -> tuple[list[tuple[int, int]], int]:
    """Shift and mask of the bands, and how many of them are a key.

    Two hashes at most ``most`` bits apart agree in all but so many bands, whichever these are. Keys of more bands are rarer to share by chance and
    there are more of them: the plan has the fewest keys and chance meetings together, where a row's key counts as ``moving`` meetings.
    """

    def work(key: int) -> float:
        n = most + key
        return comb(n, key) * (moving * rows + rows * rows / 2 * 2.0 ** -(bits * key / n))

    key = min((k for k in range(1, MOST_KEY + 1) if most + k <= bits and comb(most + k, k) <= MOST_KEYS), key=work, default=1)
    n = most + key
    edges = [round(k * bits / n) for k in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)], key


def _dealer(masks: list[int], power: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes to rows of many: for each key's mask those whose masked values fall into a bucket, of ``2 ** power``."""

    def deal(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        for key, mask in enumerate(masks):
            at = ((h & np.uint64(mask)) * _ODD >> np.uint64(64 - power)).astype(np.uint16) if power else np.zeros(len(h), np.uint16)
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(2**power + 1))
            pieces = [(k, order[i : min(i + BLOCK, b)]) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for i in range(a, b, BLOCK)]
            columns = [pa.array([key] * len(pieces), pa.int32()), pa.array([k for k, _ in pieces], pa.int32()), pa.array([h[i].tobytes() for _, i in pieces], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "bucket", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= BUCKET:
                yield from deal(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from deal(np.concatenate(held))

    return run


def _runs_of(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """The arrays of hashes of rows that lie together and are equal in the first ``by`` columns."""
    at, held = None, []
    for batch in batches:
        for *key, data in zip(*(batch.column(k).to_pylist() for k in range(by)), batch.column(by), strict=True):
            if tuple(key) != at:
                if held:
                    yield at, held
                at, held = tuple(key), []
            held.append(np.frombuffer(data.as_buffer(), np.uint64).copy())
    if held:
        yield at, held


def _close(x: np.ndarray, y: np.ndarray | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of ``x`` with those of ``y`` at most ``most`` bits from them, or with later ones of ``x``, a strip of bounded size at a time."""
    a = 0
    while a < len(x):
        other = x[a:] if y is None else y
        strip = x[a : a + max(1, CELLS // max(1, len(other)))]
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(strip[:, None] ^ other[None, :]) <= most), len(other))
        if y is None:
            i, j = i[i < j], j[i < j]
        yield strip[i], other[j]
        a += len(strip)


def _meeting(parts: list[tuple[int, int]], keys: list[tuple[int, ...]], masks: list[int], most: int) -> tuple[Callable, Callable]:
    """Functions over rows in order of their key: pairs within buckets, and pairs of blocks."""
    bands = [np.uint64(m << s) for s, m in parts]

    def batch_of(key: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        """Pairs of a key, without those that agree in more bands and have an earlier key."""
        agreed = np.zeros(len(x), np.int64)
        for band in bands[: keys[key][-1] + 1]:
            agreed += ((x ^ y) & band) == 0
        x, y = x[agreed == len(keys[key])], y[agreed == len(keys[key])]
        none = [pa.nulls(len(x), f.type) for f in list(_MET)[3:]]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.bitwise_count(x ^ y).astype(np.int32)), *none], schema=_MET)

    def pairs_of(key: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for pair in found:
            held.append(pair)
            n += len(pair[0])
            if n >= CELLS or len(held) >= CELLS:
                yield batch_of(key, *map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield batch_of(key, *map(np.concatenate, zip(*held, strict=True)))

    def bucket(key: int, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of equal values: of short runs at one distance in the order after another, of longer ones by strips."""
        value = h & np.uint64(masks[key])
        order = np.argsort(value, kind="stable")
        h, value = h[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        after = np.repeat(starts + sizes, sizes) - np.arange(len(h)) - 1
        at = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
        for step in range(1, SHORT):
            at = at[after[at] >= step]
            if not len(at):
                break
            near = at[np.bitwise_count(h[at] ^ h[at + step]) <= most]
            yield h[near], h[near + step]
        for k in np.flatnonzero((sizes > SHORT) & (sizes <= BLOCK)):
            yield from _close(h[starts[k] : starts[k] + sizes[k]], None, most)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _), held in _runs_of(batches, 2):
            h = np.concatenate(held)
            yield from pairs_of(key, bucket(key, h))
            if len(h) <= BLOCK:
                continue
            value = h & np.uint64(masks[key])
            for v, n in zip(*np.unique(value, return_counts=True), strict=True):
                if n <= BLOCK:
                    continue
                hot, blocks = h[value == v], -(-int(n) // BLOCK)  # a value that so many have is compared by many tasks
                for k in range(blocks):
                    data = hot[k * BLOCK : (k + 1) * BLOCK].tobytes()
                    yield pa.RecordBatch.from_pylist([{"key": key, "value": int(v.view(np.int64)), "block": k, "blocks": blocks, "hashes": data}], schema=_MET)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, *_), held in _runs_of(batches, 4):
            yield from pairs_of(key, _close(held[0], held[1] if len(held) > 1 else None, most))

    return within, across


def near_hashes(distinct: DataFrame, most: int) -> DataFrame:
    """``(x, y, d)``: each two different hashes of the column ``h`` that are at most ``most`` bits apart, once, in either order. ``h`` has each hash once and no null.

    Hashes meet by the values of a few bands together, so that none is compared with all. A row of the shuffle has many hashes of a key, and those of equal
    values are compared in arrays. A value that more than ``BLOCK`` hashes share is cut into blocks, and each two blocks are a row of their own.
    A pair that agrees in more bands than a key has is left to the first of them, which removes repeats without a shuffle.
    """
    spark, rows = distinct.sparkSession, distinct.count()
    parts, size = band_plan(most, rows, moving=MOVING)
    keys = list(combinations(range(len(parts)), size))
    masks = [sum(parts[i][1] << parts[i][0] for i in key) for key in keys]
    power = min(16, max(0, rows // BUCKET).bit_length())
    within, across = _meeting(parts, keys, masks, most)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * rows * len(keys) // TASK_BYTES + 1)
    dealt = distinct.select("h").mapInArrow(_dealer(masks, power), "key int, bucket int, hashes binary")
    met = materialise(dealt.repartition(tasks, "key", "bucket").sortWithinPartitions("key", "bucket").mapInArrow(within, _MET_SQL), "hashes-met")
    near, hot = met.where("hashes is null").select("x", "y", "d"), met.where("hashes is not null")
    if hot.isEmpty():
        return near
    cells = hot.select("key", "value", "block", "hashes", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    cells = cells.select("key", "value", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "hashes")
    compared = cells.repartition(tasks, "key", "value", "i", "j").sortWithinPartitions("key", "value", "i", "j").mapInArrow(across, _MET_SQL)
    return near.unionByName(materialise(compared.select("x", "y", "d"), "hashes-met-blocks"))


def hamming_pairs(hashes: DataFrame, id_col: str, hash_col: str, most: int) -> DataFrame:
    """``(a, b, d)``, a < b: all pairs of rows at most ``most`` bits apart. Rows without an id or a hash have none.

    Equal hashes are one row while pairs are looked for, by :func:`near_hashes`.
    """
    held = materialise(hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).where("id is not null and h is not null"), "hashes")
    distinct = materialise(held.select("h").distinct(), "hashes-distinct")
    near = near_hashes(distinct, most).unionByName(distinct.select(F.col("h").alias("x"), F.col("h").alias("y"), F.lit(0).alias("d")))
    of = lambda i, h: held.select(F.col("id").alias(i), F.col("h").alias(h)).hint("merge")
    pairs = near.join(of("i", "x"), "x").join(of("j", "y"), "y").where((F.col("i") < F.col("j")) | ((F.col("x") != F.col("y")) & (F.col("i") > F.col("j"))))
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "d")


def theta_pairs(hashes: DataFrame, id_col: str, hash_col: str, most: int) -> DataFrame:
    """The same pairs by comparing all with all: what tests hold the others against."""
    a, b = hashes.select(F.col(id_col).alias("a"), F.col(hash_col).alias("x")), hashes.select(F.col(id_col).alias("b"), F.col(hash_col).alias("y"))
    return a.join(b, (F.col("a") < F.col("b")) & (hamming("x", "y") <= most)).select("a", "b", hamming("x", "y").cast("int").alias("d"))


def components(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, root)``: the smallest id that each node reaches.

    A node takes the smallest root among its neighbours', then its root's root, so that paths halve;
    each round is written to the shared folder. It ends when no root changes.
    """
    both = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "component-edges")
    roots = materialise(nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("root")), "component-roots")
    while True:
        seen = both.join(roots.select(F.col("id").alias("v"), "root"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("near"))
        hooked = materialise(roots.join(seen, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")), "component-hooked")
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("above"))
        jumped = materialise(hooked.join(up, "root").select("id", "old", F.col("above").alias("root")), "component-roots")
        drop_table(hooked)
        if jumped.where("old <> root").isEmpty():
            return jumped.select("id", "root")
        roots = jumped.select("id", "root")


def near_duplicate_groups(hashes: DataFrame, id_col: str, hash_col: str, most: int) -> DataFrame:
    """``(id, group_id)``: groups of hashes linked within ``most`` bits, numbered from 0 by their smallest id.

    A row without a hash (an unreadable image) is a group of its own. Rows of equal hashes are one node, their smallest id, so that copies make no pairs.
    """
    rows = materialise(hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")), "group-hashes")
    heads = materialise(rows.where("id is not null and h is not null").groupBy("h").agg(F.min("id").alias("head")), "group-heads")
    of = lambda i, h: heads.select(F.col("head").alias(i), F.col("h").alias(h)).hint("merge")
    links = near_hashes(heads.select("h"), most).join(of("a", "x"), "x").join(of("b", "y"), "y").select("a", "b")
    reached = components(heads.select(F.col("head").alias("id")).distinct(), links).select(F.col("id").alias("head"), "root")
    of_hash = heads.join(reached.hint("merge"), "head").select("h", "root")
    found = materialise(rows.join(of_hash.hint("merge"), "h", "left").select("id", F.coalesce("root", "id").alias("root")), "group-roots")
    first = running(found.where("id = root").select("root", (-F.col("root")).alias("__o")), "__o", ["root"], {}).select("root", (F.col("k").cast("long") - 1).alias("group_id"))
    return found.join(first.hint("merge"), "root").select("id", "group_id")


def exact_groups(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``(first_id, n)`` of each group of rows with equal keys."""
    return df.groupBy(key.alias("__k")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")).drop("__k")


def grouped_split(members: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """``members`` with ``held_out``: whole groups, in the order of md5(seed:group), until the fraction of rows is reached.

    At least one group is taken, and the last may overshoot.
    """
    total = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ordered = hashed_rank(total, F.col(group), seed, sums={"__before": F.col("n")})
    target = members.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * fraction)).alias("__target"))
    chosen = ordered.join(F.broadcast(target)).select(group, (F.col("__before") < F.col("__target")).alias("held_out"))  # one row
    return members.join(chosen, group)
