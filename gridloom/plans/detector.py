"""A model from cells to file: split, sample, bin, fit, calibrate, evaluate, score."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boost, grid, metrics, sampling, trees
from ..sources.config import Config, columns_at, select_columns
from ..sources.model_files import ModelFile, encode_trees
from ..sources.store import materialise
from . import training

#: Fixed defaults of the early exit.
KEEP_PROBABILITY, MARGIN, FRACTIONS = 0.05, 2.0, (0.0, 0.125, 0.25, 0.5, 0.75)


@dataclass
class Detector:
    """Fits on and scores tables of cells: ``row_key``, features ``x`` and, to fit, a boolean ``y``."""

    config: Config = field(default_factory=Config)
    feature_names: list[str] = field(default_factory=list)
    border_count: int = 15
    model: trees.Ensemble | None = None
    metadata: dict = field(default_factory=dict)

    def fit(self, cells: DataFrame, validation: DataFrame | None = None, sides: list[int] | None = None, seed: int = 42, n_blocks: int = 1, sampled: bool = False) -> Detector:
        """Samples, unless that is done, bins and boosts; calibrates stages on the sample; measures on ``validation`` with the trees as they are shipped.

        With several blocks the rows have a column ``block``.
        """
        train, width = self.config.train, len(self.feature_names)
        sample = cells if sampled else sampling.stratified_sample(cells, F.col("row_key"), "y", train.neg_pos_ratio, train.max_train_cells, seed)
        block = ["block"] if n_blocks > 1 else []
        borders = trees.sketch_borders(sample, "x", width, self.border_count)
        binned = materialise(sample.select("row_key", "y", *block, trees.binned("x", borders).alias("bins")), "detector-bins")
        shift = tuple(2 * (64 // s).bit_length() - 2 for s in sides) if sides else ()
        self.model = boost.fit(binned, borders, self.config.model, sides, "block" if block else None, n_blocks, shift)
        counts = trees.stage_counts(len(self.model.trees), self.model.coarse_trees, self.model.leaf_chunk, FRACTIONS)
        if counts:
            scored = trees.partial_scores(binned, self.model, "bins", [*counts, len(self.model.trees)])
            self.model = self.model.with_stages(trees.calibrate(scored, counts, f"raw_{len(self.model.trees)}", KEEP_PROBABILITY, MARGIN))
        self.metadata = {"train_rows": binned.count()}
        if validation is not None:
            self.metadata |= metrics.summarise(self.score(validation).join(validation.select("row_key", "y"), "row_key"), "probability", "y", ["row_key"])
        return self

    def fit_images(self, images: DataFrame, cells: DataFrame, sides: list[int] | None = None, host_gib: float | None = None) -> Detector:
        """From hashed images ``image_id, hash`` and their cells ``image_id, cell, x, y``: groups near copies, splits by group, samples, gathers, fits and measures.

        With a bound on memory, each block of rows serves its share of the trees. Validation images share no group with those learned from.
        """
        train, width = self.config.train, len(self.feature_names)
        split = materialise(training.build_split(images, train), "detector-split")
        samples = training.sample_cells(cells.select("image_id", "cell", "y"), split, train)
        rows = materialise(training.gather(samples, cells), "detector-rows")
        held_out = cells.join(split.where("held_out").select("image_id"), "image_id")
        validation = held_out.select(F.concat_ws("/", F.col("image_id").cast("string"), F.col("cell").cast("string")).alias("row_key"), "x", "y")
        block_gib = train.block_gib or (boost.auto_block_gib(host_gib) if host_gib else None)
        n_blocks = boost.plan_blocks(rows.count(), width, block_gib)
        rows = sampling.blocks(rows, F.col("row_key"), n_blocks, train.split_seed) if n_blocks > 1 else rows
        self.fit(rows, validation, sides, train.split_seed, n_blocks, sampled=True)
        self.metadata |= {"blocks": n_blocks, "images_held_out": split.where("held_out").count()}
        return self

    def ranking(self) -> list[str]:
        """The columns by importance in the fitted model, the first of equals first."""
        gain = trees.importances(self.model)
        return [self.feature_names[k] for k in sorted(range(len(gain)), key=lambda k: -gain[k])]

    def prune(self, k: int) -> tuple[Detector, list[int]]:
        """A detector of the k most important columns, to be fitted anew, and where these are among the present ones."""
        names = select_columns(self.feature_names, self.ranking(), k)
        return Detector(self.config, names, self.border_count), columns_at(self.feature_names, names)

    def score_grid(self, cells: DataFrame, side: int = 64) -> DataFrame:
        """One row an image of cells ``image_id, cell, x``: its probabilities as an array."""
        scored = trees.score_in_batches(cells, self.model, "x", ["image_id", "cell"])
        return grid.to_grid(scored, "image_id", "cell", "probability", side)

    def score(self, cells: DataFrame) -> DataFrame:
        """``row_key, total, probability`` of every cell."""
        if self.model is None:
            raise RuntimeError("there is no model yet: fit or load one")
        return trees.score_in_batches(cells, self.model, "x", ["row_key"])

    def score_in_sql(self, cells: DataFrame) -> DataFrame:
        """The same by expressions alone, for models of a few trees."""
        binned = cells.select("row_key", trees.binned("x", self.model.borders).alias("bins"))
        total = binned.select("row_key", trees.total_of(self.model, "bins").alias("total"))
        return total.select("row_key", "total", metrics.sigmoid(trees.raw_of(self.model, F.col("total"))).alias("probability"))

    def score_staged(self, cells: DataFrame, tile: list[str]) -> DataFrame:
        """``row_key, total, alive, probability``, with the early exit of tiles."""
        binned = cells.select("row_key", *tile, trees.binned("x", self.model.borders).alias("bins"))
        staged = trees.staged_scores(binned, self.model, "bins", tile, ["row_key"])
        return staged.select("*", metrics.sigmoid(trees.raw_of(self.model, F.col("total"))).alias("probability"))

    def save(self, path: str | Path) -> Path:
        return ModelFile(self.config.to_dict(), self.feature_names, encode_trees(self.model), self.metadata).save(path)

    @classmethod
    def load(cls, path: str | Path) -> Detector:
        """A detector that scores, and that can be saved again."""
        file = ModelFile.load(path)
        return cls(Config.from_dict(file.config), file.feature_names, model=file.model, metadata=file.metadata)
