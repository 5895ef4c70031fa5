"""Binning, and symmetric tree ensembles scored by exact integer sums.

A tree asks the same question at every node of a level: a row's leaf is the number whose bit d is set
where its bin of feature f_d is above b_d. Leaves are codes on a grid, ``offset[tree] + code * 2 ** (e_min + shift)``, so
a raw score is ``sum(offsets) + total * 2 ** e_min`` with a whole number ``total``: the same whatever the order of summation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Exponent of the step of a chunk whose leaves are all alike.
EMPTY_EXPONENT = -60


@dataclass(frozen=True)
class Tree:
    """Splits ``(feature, bin)``, the root first; leaf codes; offset of the leaves; shift of the chunk's step."""

    splits: tuple[tuple[int, int], ...]
    codes: tuple[int, ...]
    offset: float
    shift: int


@dataclass(frozen=True)
class Ensemble:
    """Trees with their borders by feature, and the stages ``(trees, threshold)`` after which tiles may stop."""

    trees: tuple[Tree, ...]
    borders: tuple[tuple[float, ...], ...]
    e_min: int
    leaf_bits: int = 4
    leaf_chunk: int = 16
    coarse_trees: int = 0
    stages: tuple[tuple[int, float], ...] = ()
    level_shift: tuple[int, ...] = field(default=())

    def __post_init__(self) -> None:
        depths = {len(t.splits) for t in self.trees}
        if len(depths) > 1:
            raise ValueError("trees must have one depth")
        for t in self.trees:
            if len(t.codes) != 1 << len(t.splits):
                raise ValueError("a tree has 2 ** depth leaves")
            if any(not 0 <= c < 1 << self.leaf_bits for c in t.codes):
                raise ValueError(f"a leaf code has {self.leaf_bits} bits")
            if any(not 0 <= f < len(self.borders) for f, _ in t.splits):
                raise ValueError("a split names no feature")

    @property
    def depth(self) -> int:
        return len(self.trees[0].splits) if self.trees else 0

    @property
    def offset_sum(self) -> float:
        return float(sum(t.offset for t in self.trees))

    def with_stages(self, stages: list[tuple[int, float]]) -> Ensemble:
        return replace(self, stages=tuple(stages))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a tree: ``tree, splits, codes, offset, shift``."""
        rows = [(i, [{"feature": f, "bin": b} for f, b in t.splits], list(t.codes), t.offset, t.shift) for i, t in enumerate(self.trees)]
        return spark.createDataFrame(rows, "tree int, splits array<struct<feature: int, bin: int>>, codes array<int>, offset double, shift int")


def sum_models(models: list[Ensemble]) -> Ensemble:
    """The trees of all models, one model after another; steps are brought to the smallest exponent."""
    first = models[0]
    if any(m.borders != first.borders for m in models):
        raise ValueError("models must share their borders")
    low = min(m.e_min for m in models)
    return replace(first, trees=tuple(replace(t, shift=t.shift + m.e_min - low) for m in models for t in m.trees), e_min=low, stages=())


# Binning.


def quantile_borders(df: DataFrame, column: str, n_features: int, count: int = 15) -> list[list[float]]:
    """At most ``count`` different cuts for each element of an array column, at its exact quantiles k / (count + 1), as float."""
    if not 1 <= count <= 255:
        raise ValueError("a feature has 1 to 255 borders")
    cuts = F.array(*[F.lit(k / (count + 1)) for k in range(1, count + 1)])
    row = df.agg(*[F.percentile(F.col(column)[i].cast("double"), cuts).alias(f"f{i}") for i in range(n_features)]).first()
    return [sorted({float(np.float32(c)) for c in (row[i] or [])}) for i in range(n_features)]


def sketch_borders(df: DataFrame, column: str, n_features: int, count: int = 15, accuracy: int = 10_000) -> list[list[float]]:
    """The same at approximate quantiles, with memory bounded by ``accuracy``: for tables too large to hold all values of a column."""
    cuts = [k / (count + 1) for k in range(1, count + 1)]
    row = df.agg(*[F.percentile_approx(F.col(column)[i].cast("double"), cuts, accuracy).alias(f"f{i}") for i in range(n_features)]).first()
    return [sorted({float(np.float32(c)) for c in (row[i] or [])}) for i in range(n_features)]


def bin_of(x: Column, borders: list[float] | tuple[float, ...]) -> Column:
    """How many borders lie below x. NaN is above all, as Spark orders it."""
    if not borders:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b).cast("float") for b in borders]), lambda b: b < x.cast("float")))


def binned(x: str, borders: list[list[float]] | tuple[tuple[float, ...], ...]) -> Column:
    """The bins of an array of features."""
    return F.array(*[bin_of(F.col(x)[i], b) for i, b in enumerate(borders)])


# Scoring.


#: Trees that are spelled out as one expression, at most: generated code has a bound on its size. More are walked in Arrow batches.
UNROLLED = 48


def leaf_index(bins: Column, splits: tuple[tuple[int, int], ...]) -> Column:
    """Bit d is set where the bin of the d-th split's feature is above the split's; the root is the lowest bit."""
    out = F.lit(0)
    for d, (f, b) in enumerate(splits):
        out = out + F.when(bins[f] > b, 1 << d).otherwise(0)
    return out


def total_of(model: Ensemble, bins: str, first: int = 0, end: int | None = None) -> Column:
    """The whole number that the trees ``first`` to ``end`` add to a row's total. A few trees are generated code; many are NumPy over Arrow batches."""
    trees = model.trees[first:end]
    if len(trees) > UNROLLED:
        part = replace(model, trees=trees, stages=(), coarse_trees=0)

        @F.arrow_udf("long")
        def walked(b: pa.Array) -> pa.Array:
            return pa.array(totals(part, matrix(b, len(part.borders))))

        return walked(bins)
    out = F.lit(0).cast("long")
    for t in trees:
        out = out + F.array(*[F.lit(c << t.shift).cast("long") for c in t.codes])[leaf_index(F.col(bins), t.splits)]
    return out


def raw_of(model: Ensemble, total: Column, trees: int | None = None) -> Column:
    """The raw score after so many trees."""
    offsets = float(sum(t.offset for t in model.trees[:trees]))
    return F.lit(offsets) + total * F.lit(2.0**model.e_min)


def partial_scores(df: DataFrame, model: Ensemble, bins: str, counts: list[int]) -> DataFrame:
    """``df`` with the raw score ``raw_k`` after each number k of trees; each tree is walked once."""
    out, before, at = df, F.lit(0).cast("long"), 0
    for k in sorted(counts):
        out = out.withColumn(f"__t{k}", before + total_of(model, bins, at, k))
        before, at = F.col(f"__t{k}"), k
    for k in sorted(counts):
        out = out.withColumn(f"raw_{k}", raw_of(model, F.col(f"__t{k}"), k))
    return out.drop(*[f"__t{k}" for k in counts])


def staged_scores(df: DataFrame, model: Ensemble, bins: str, tile: list[str], keep: list[str]) -> DataFrame:
    """Rows ``keep, total, alive``: after each stage, tiles whose rows all score below its threshold keep what they have.

    The trees of a stage are walked only for rows of tiles that are still alive.
    """
    over = Window.partitionBy(*tile)
    out = df.select(*dict.fromkeys([*keep, *tile, bins])).withColumn("total", F.lit(0).cast("long")).withColumn("alive", F.lit(True))
    at = 0
    for trees, threshold in [*sorted(model.stages), (len(model.trees), None)]:
        out = out.withColumn("total", F.when(F.col("alive"), F.col("total") + total_of(model, bins, at, trees)).otherwise(F.col("total")))
        if threshold is not None:
            best = F.max(raw_of(model, F.col("total"), trees)).over(over)
            out = out.withColumn("alive", F.col("alive") & (best >= threshold))
        at = trees
    return out.select(*keep, "total", "alive")


def score_in_batches(df: DataFrame, model: Ensemble, features: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``total`` and ``probability`` for raw feature arrays: NumPy over Arrow batches, for ensembles of many trees."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a model: its size doesn't follow the data
    schema = df.select(*keep).schema.add("total", "long").add("probability", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = matrix(batch.column(len(keep)), len(m.borders)).astype(np.float32)
            total = totals(m, bins_of(m, x))
            raw = m.offset_sum + np.ldexp(total.astype(float), m.e_min)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(total), pa.array(1 / (1 + np.exp(-raw)))], names=[*keep, "total", "probability"])

    return df.select(*keep, features).mapInArrow(run, schema)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Arrays of ``width`` numbers each, as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def bins_of(model: Ensemble, x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(np.asarray(b, np.float32), x[:, i], side="left") for i, b in enumerate(model.borders)], 1).astype(np.int64) if len(model.borders) else np.zeros((len(x), 0), np.int64)


def totals(model: Ensemble, bins: np.ndarray) -> np.ndarray:
    """Column by column in bytes: a bin has at most eight bits and a leaf at most seven."""
    out = np.zeros(len(bins), np.int64)
    columns = np.ascontiguousarray(bins.T.astype(np.uint8))
    above: dict[tuple[int, int], np.ndarray] = {}
    for t in model.trees:
        leaf = np.zeros(len(bins), np.uint8)
        for d, (f, b) in enumerate(t.splits):
            if (f, b) not in above:  # there are as many questions as borders
                above[f, b] = (columns[f] > b).view(np.uint8)
            leaf |= above[f, b] << np.uint8(d)
        out += (np.asarray(t.codes, np.int64) << t.shift)[leaf]
    return out


def importances(model: Ensemble) -> list[float]:
    """For each feature, how far apart the leaves on both sides of its splits lie, summed over splits and averaged over each tree's leaves."""
    out = np.zeros(len(model.borders))
    for t in model.trees:
        values = np.ldexp(np.asarray(t.codes, float), model.e_min + t.shift)
        leaf = np.arange(len(values))
        for d, (f, _) in enumerate(t.splits):
            out[f] += np.abs(values - values[leaf ^ (1 << d)]).mean()
    return out.tolist()


# The leaf grid.


def stage_chunks(n_trees: int, chunk: int, starts: tuple[int, ...]) -> list[int]:
    """The chunk of each tree: ``chunk`` trees each, begun anew at every stage."""
    out: list[int] = []
    edges = [*starts, n_trees]
    for a, b in zip(edges, edges[1:], strict=False):
        base = out[-1] + 1 if out else 0
        out += [base + i // chunk for i in range(b - a)]
    return out


def leaf_grid(leaves: DataFrame, bits: int, chunk: int, starts: tuple[int, ...] = (0,)) -> DataFrame:
    """Leaves ``tree, leaf, value`` on the grid: adds ``chunk, offset, exponent, code``.

    A tree's offset is its smallest leaf, as float; a chunk's step is the smallest power of two whose ``2 ** bits - 1`` multiples
    span its widest tree. Codes round half to even.
    """
    most = float((1 << bits) - 1)
    stage, base, at = F.lit(0), F.lit(0), 0
    for a, b in zip(starts, [*starts[1:], None], strict=True):
        stage, base = F.when(F.col("tree") >= a, a).otherwise(stage), F.when(F.col("tree") >= a, at).otherwise(base)
        at += -(-(b - a) // chunk) if b is not None else 0
    of = leaves.withColumn("chunk", (base + F.floor((F.col("tree") - stage) / chunk)).cast("int"))
    per_tree = of.groupBy("chunk", "tree").agg(F.min("value").alias("low"), (F.max("value") - F.min("value")).alias("range"))
    widest = F.max("range").over(Window.partitionBy("chunk"))
    exponent = F.when(widest > 0, F.ceil(F.log2(widest / most))).otherwise(EMPTY_EXPONENT)
    steps = per_tree.select("tree", "low", exponent.cast("int").alias("exponent"))
    code = F.least(F.lit(most), F.greatest(F.lit(0.0), F.rint((F.col("value") - F.col("low")) / F.pow(F.lit(2.0), F.col("exponent")))))
    return of.join(steps, "tree").select("tree", "leaf", "value", "chunk", F.col("low").cast("float").alias("offset"), "exponent", code.cast("int").alias("code"))


def quantise(leaves: np.ndarray, bits: int, chunk: int, starts: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a matrix of leaves on the driver: offset of each tree, exponent of each tree's chunk, and codes."""
    of = np.array(stage_chunks(len(leaves), chunk, starts))
    low, span = leaves.min(1), leaves.max(1) - leaves.min(1)
    widest = np.zeros(of[-1] + 1)
    np.maximum.at(widest, of, span)
    exponent = np.array([math.ceil(math.log2(w / ((1 << bits) - 1))) if w > 0 else EMPTY_EXPONENT for w in widest])[of]
    codes = np.clip(np.rint((leaves - low[:, None]) / np.ldexp(1.0, exponent)[:, None]), 0, (1 << bits) - 1).astype(np.int64)
    return low.astype(np.float32), exponent, codes


def pad_leaves(leaves: list[float], depth: int) -> list[float]:
    """A shallower tree's leaves at a larger depth: the added splits don't matter."""
    if len(leaves) > 1 << depth or len(leaves) & (len(leaves) - 1):
        raise ValueError("a tree has 2 ** depth leaves")
    return [leaves[i & (len(leaves) - 1)] for i in range(1 << depth)]


def build_ensemble(splits: list[list[tuple[int, int]]], leaves: list[list[float]], borders: list[list[float]], bits: int = 4, chunk: int = 16, coarse: int = 0, level_shift: tuple[int, ...] = ()) -> Ensemble:
    """A model on the leaf grid from float leaves; trees are padded to the deepest."""
    depth = max(map(len, splits), default=0)
    filler = next((s[0] for s in splits if s), None)
    if filler is None:
        raise ValueError("every tree is a constant")
    wide = [s + [s[0] if s else filler] * (depth - len(s)) for s in splits]
    starts = (0, coarse) if 0 < coarse < len(splits) else (0,)
    offset, exponent, codes = quantise(np.array([pad_leaves(x, depth) for x in leaves], float), bits, chunk, starts)
    low = int(exponent.min())
    trees = tuple(Tree(tuple(s), tuple(c.tolist()), float(o), int(e - low)) for s, c, o, e in zip(wide, codes, offset, exponent, strict=True))
    return Ensemble(trees, tuple(tuple(b) for b in borders), low, bits, chunk, coarse if len(starts) == 2 else 0, (), tuple(level_shift))


# Early exit.


def stage_counts(n_trees: int, coarse: int, chunk: int, fractions: tuple[float, ...]) -> list[int]:
    """After how many trees a tile may stop: fractions of the fine trees, at the ends of chunks (halves to even)."""
    counts = {coarse + round(f * (n_trees - coarse) / chunk) * chunk for f in fractions}
    return sorted(k for k in counts if 0 < k < n_trees)


def calibrate(scored: DataFrame, counts: list[int], final: str, keep_probability: float, margin: float) -> list[tuple[int, float]]:
    """For each count the smallest partial score ``raw_k`` of a row whose final probability is kept, less the margin; -1e30 if none is."""
    if not 0 < keep_probability < 1:
        raise ValueError("a probability is kept from between 0 and 1")
    kept = F.col(final) >= math.log(keep_probability / (1 - keep_probability))
    row = scored.agg(*[F.min(F.when(kept, F.col(f"raw_{k}"))).alias(f"m{k}") for k in counts]).first()
    return [(k, row[f"m{k}"] - margin if row[f"m{k}"] is not None else -1e30) for k in counts]
