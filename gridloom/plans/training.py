"""From hashed images and their cells to a training set: groups, split, sample, gather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, sampling
from ..sources.config import FrontConfig
from ..sources.store import materialise


def build_split(images: DataFrame, train: FrontConfig, image: str = "image_id", hash_col: str = "hash") -> DataFrame:
    """``(image, group_id, held_out)`` of every image: near copies are one group, and groups are held out whole."""
    groups = materialise(dedup.near_duplicate_groups(images, image, hash_col, train.max_hamming), "split-groups")
    split = dedup.grouped_split(groups, "group_id", train.val_frac, train.split_seed)
    return split.select(F.col("id").alias(image), "group_id", "held_out")


def sample_cells(labels: DataFrame, split: DataFrame, train: FrontConfig, image: str = "image_id") -> DataFrame:
    """The training cells ``image, cell, y`` of ``labels`` with the same columns, from images that aren't held out, in the shares of the configuration."""
    mine = labels.join(split.where(~F.col("held_out")).select(image), image)
    key = F.concat_ws("/", F.col(image).cast("string"), F.col("cell").cast("string"))
    return sampling.stratified_sample(mine, key, "y", train.neg_pos_ratio, train.max_train_cells, train.split_seed).drop("rn")


def gather(samples: DataFrame, design: DataFrame, image: str = "image_id") -> DataFrame:
    """``(row_key, image, cell, y, x)``: sampled cells with their features, by one join on image and cell.

    A sampled cell without features is an error: nothing is dropped without a word.
    """
    found = samples.join(design.select(image, "cell", "x"), [image, "cell"], "left")
    x = F.when(F.col("x").isNotNull(), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("no features of cell "), F.col("cell").cast("string"))))
    return found.select(F.concat_ws("/", F.col(image).cast("string"), F.col("cell").cast("string")).alias("row_key"), image, "cell", "y", x.alias("x"))
