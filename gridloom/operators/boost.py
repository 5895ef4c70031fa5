"""Symmetric boosting by distributed histograms.

A level of a tree is one aggregation: sums of gradient and curvature by leaf, feature and bin, of which there are
a bounded number; the driver picks the one split that is best over all leaves. Rows keep their bins and running
score; a finished chunk's leaves are put on the leaf grid before the next is fitted, so that later trees
correct the rounding, and the score is written to the shared folder to cut the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise
from .trees import Ensemble, Tree, build_ensemble, matrix, quantise, total_of

#: Added to the curvature of every leaf.
L2 = 3.0


@dataclass(frozen=True)
class BoostConfig:
    """The booster's knobs; invalid ones are refused."""

    depth: int = 5
    n_trees: int = 1000
    learning_rate: float = 0.1
    leaf_bits: int = 4
    leaf_chunk: int = 16
    coarse_fraction: float = 2 / 3
    coarse_max_side: int = 16
    scale_pos_weight: float | None = None
    quantisation_aware: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.depth <= 7:
            raise ValueError("depth is 1 to 7")
        if self.n_trees < 1:
            raise ValueError("there is at least one tree")
        if self.leaf_bits not in (4, 6, 8, 16):
            raise ValueError("a leaf has 4, 6, 8 or 16 bits")
        if not 1 <= self.leaf_chunk <= 17:
            raise ValueError("a chunk has 1 to 17 trees")
        if not 0 <= self.coarse_fraction < 1:
            raise ValueError("the coarse fraction is at least 0 and below 1")
        if self.coarse_max_side < 1:
            raise ValueError("the coarse side is at least 1")
        if self.scale_pos_weight is not None and self.scale_pos_weight <= 0:
            raise ValueError("the positive weight is above 0")

    @property
    def coarse_trees(self) -> int:
        """Trees of the coarse tier; one fine tree is always left."""
        wanted = round(self.coarse_fraction * self.n_trees)
        return wanted if wanted < self.n_trees else self.n_trees - 1


def split_histogram(rows: DataFrame, bins: str, leaf: str, g: str, h: str, n_leaves: int, n_features: int, n_bins: int) -> DataFrame:
    """``(leaf, feature, bin, g, h)``: the sums of a level.

    Each task counts its rows into one array of leaves times features times bins; what moves is that array, once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = n_leaves * n_features * n_bins
        sums, seen = np.zeros((2, size)), np.zeros(size, bool)
        for batch in batches:
            if batch.num_rows:
                at, each = batch.column(0).to_numpy(), matrix(batch.column(1), n_features)
                place = ((at[:, None] * n_features + np.arange(n_features)) * n_bins + each).ravel()
                seen[place] = True
                for k in (0, 1):
                    sums[k] += np.bincount(place, np.repeat(batch.column(2 + k).to_numpy(), n_features), size)
        some = np.flatnonzero(seen)
        columns = [some // (n_features * n_bins), some // n_bins % n_features, some % n_bins]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["leaf", "feature", "bin", "g", "h"])

    used = rows.select(F.col(leaf).cast("int"), bins, F.col(g).cast("double"), F.col(h).cast("double"))
    each = used.mapInArrow(run, "leaf int, feature int, bin int, g double, h double")
    return each.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_split(histogram: np.ndarray, l2: float = L2) -> tuple[int, int, float] | None:
    """The (feature, bin) with the largest gain summed over leaves, of ``[leaf, feature, bin, (g, h)]``; the first of equals, or None."""
    below = histogram.cumsum(2)
    total = below[:, :, -1:, :]
    above = total - below
    value = lambda x: x[..., 0] ** 2 / (x[..., 1] + l2)
    gain = (value(below) + value(above) - value(total)).sum(0)[:, :-1]
    if not gain.size or gain.max() <= 1e-12:
        return None
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(f), int(b), float(gain[f, b])


def fit(rows: DataFrame, borders: list[list[float]], config: BoostConfig, sides: list[int] | None = None, block: str | None = None, n_blocks: int = 1, level_shift: tuple[int, ...] = ()) -> Ensemble:
    """A model of ``rows`` with ``bins`` and a boolean ``y``.

    ``sides`` gives each feature's native side: the first trees only split on sides up to ``coarse_max_side``. With ``block``,
    each block of rows serves the chunks of trees that start in its share of all trees.
    """
    n_bins = max(map(len, borders)) + 1
    coarse = config.coarse_trees if sides is not None else 0
    weight = F.when(F.col("y"), F.lit(config.scale_pos_weight or 1.0)).otherwise(1.0)
    held = materialise(rows.select(*([F.col(block).alias("block")] if block else []), "bins", "y", F.lit(0.0).alias("score")), "boost")
    splits: list[list[tuple[int, int]]] = []
    leaves: list[list[float]] = []
    start = 0
    while start < config.n_trees:
        stage_end = coarse if start < coarse else config.n_trees
        size = min(config.leaf_chunk, stage_end - start)
        allowed = [f for f in range(len(borders)) if start >= coarse or sides is None or sides[f] <= config.coarse_max_side]
        mine = held.where(F.col("block") == min(n_blocks - 1, start * n_blocks // config.n_trees)) if block else held
        chunk: list[tuple[list[tuple[int, int]], list[float]]] = []
        for _ in range(size):
            tree, values = _fit_tree(mine, chunk, allowed, len(borders), n_bins, config, weight)
            chunk.append((tree, values))
        splits += [t for t, _ in chunk]
        leaves += [v for _, v in chunk]
        held = materialise(held.withColumn("score", F.col("score") + _chunk_score(chunk, borders, config)), "boost")
        start += size
    return build_ensemble(splits, leaves, borders, config.leaf_bits, config.leaf_chunk, coarse, level_shift)


def _leaf(tree: list[tuple[int, int]]) -> F.Column:
    out = F.lit(0)
    for d, (f, b) in enumerate(tree):
        out = out + F.when(F.col("bins")[f] > b, 1 << d).otherwise(0)
    return out


def _value(tree: list[tuple[int, int]], values: list[float]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), _leaf(tree) + 1)


def _fit_tree(rows: DataFrame, chunk: list, allowed: list[int], n_features: int, n_bins: int, config: BoostConfig, weight: F.Column) -> tuple[list[tuple[int, int]], list[float]]:
    score = F.col("score")
    for tree, values in chunk:
        score = score + _value(tree, values)
    p = 1 / (1 + F.exp(-score))
    now = rows.select("bins", (weight * (F.col("y").cast("double") - p)).alias("g"), (weight * p * (1 - p)).alias("h"))
    tree: list[tuple[int, int]] = []
    sums = np.zeros((1, 2))
    for _ in range(config.depth):
        table = split_histogram(now.withColumn("leaf", _leaf(tree)), "bins", "leaf", "g", "h", 1 << len(tree), n_features, n_bins)
        histogram = np.zeros((1 << len(tree), n_features, n_bins, 2))
        for r in table.toLocalIterator():  # leaves times features times bins
            histogram[r["leaf"], r["feature"], r["bin"]] = r["g"], r["h"]
        sums = histogram[:, 0].sum(1)
        found = best_split(histogram[:, allowed])
        if found is None:
            break
        f, b = allowed[found[0]], found[1]
        tree.append((f, b))
        low = histogram[:, f, : b + 1].sum(1)
        sums = np.concatenate([low, histogram[:, f].sum(1) - low])
    return tree, (config.learning_rate * sums[:, 0] / (sums[:, 1] + L2)).tolist()


def _chunk_score(chunk: list, borders: list[list[float]], config: BoostConfig) -> F.Column:
    if not any(t for t, _ in chunk):
        return sum((_value(t, v) for t, v in chunk), F.lit(0.0))
    if not config.quantisation_aware:
        return sum((_value(t, v) for t, v in chunk), F.lit(0.0))
    model = build_ensemble([t for t, _ in chunk], [v for _, v in chunk], borders, config.leaf_bits, config.leaf_chunk)
    return F.lit(model.offset_sum) + total_of(model, "bins") * F.lit(2.0**model.e_min)


def log_loss(scored: DataFrame, raw: str, label: str) -> float:
    p = 1 / (1 + F.exp(-F.col(raw)))
    return scored.agg(F.avg(-F.log(F.when(F.col(label), p).otherwise(1 - p))).alias("l")).first()["l"]


# Planning.


def bin_bits(borders: int) -> int:
    """Bits a binned value takes."""
    return max(1, int(borders).bit_length())


def plan_blocks(n_rows: int, width: int, block_gib: float | None) -> int:
    """Blocks of a float matrix that are at most so many GiB each."""
    if not block_gib or block_gib <= 0 or n_rows <= 0:
        return 1
    return max(1, -int(-(n_rows * width * 4 / 2**30) // block_gib))


def auto_block_gib(host_gib: float | None, device_gib: float | None = None, device_bits: int = 4, host_use: float = 0.8, host_peak: float = 2.3, device_use: float = 0.4) -> float | None:
    """The largest block that free memory allows: a fit peaks at ``host_peak`` matrices."""
    bounds = [host_use * host_gib / host_peak] if host_gib is not None else []
    bounds += [device_use * device_gib * 32 / device_bits] if device_gib is not None else []
    return min(bounds, default=None)


def unused_blocks(config: BoostConfig, n_blocks: int) -> int:
    """Blocks in which no chunk of trees starts."""
    if n_blocks <= 1:
        return 0
    if not config.quantisation_aware:
        return max(0, n_blocks - config.n_trees)
    coarse = config.coarse_trees
    starts = {*range(0, coarse, config.leaf_chunk), *range(coarse, config.n_trees, config.leaf_chunk)}
    return n_blocks - len({min(n_blocks - 1, s * n_blocks // config.n_trees) for s in starts})


__all__ = ["BoostConfig", "Tree", "auto_block_gib", "best_split", "bin_bits", "fit", "log_loss", "plan_blocks", "quantise", "split_histogram", "unused_blocks"]
