"""Rank-based quality of scores: precision-recall and ROC curves, operating points, cluster bootstrap.

The order is total, score descending and then the tie columns: tied scores are walked row by row and not grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise
from .ordering import ordered, running

#: Images that a bootstrap needs.
LEAST_IMAGES = 3


def ranked(df: DataFrame, score: str, label: str, ties: list[str]) -> DataFrame:
    """``df`` with its rank ``k`` and the positives up to it, ``tp``."""
    return running(df, score, ties, {"tp": F.col(label).cast("long")})


def totals(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("n_pos"), F.count(F.lit(1)).alias("n"))


def pr_auc(df: DataFrame, score: str, label: str, ties: list[str]) -> DataFrame:
    """One row: the step integral of precision over recall. Recall moves only at positives, by ``1 / n_pos``."""
    at = ranked(df, score, label, ties).where(F.col(label).cast("boolean"))
    total = at.agg(F.sum(F.col("tp") / F.col("k")).alias("s"), F.count(F.lit(1)).alias("n_pos"))
    return total.select("n_pos", (F.coalesce("s", F.lit(0.0)) / F.greatest(F.col("n_pos").cast("double"), F.lit(1e-12))).alias("pr_auc"))


def roc_auc(df: DataFrame, score: str, label: str, ties: list[str]) -> DataFrame:
    """One row: the area under the ROC curve, null with one class. At a negative the true positive rate stays, so trapezoids are rectangles."""
    at = ranked(df, score, label, ties)
    total = at.agg(F.sum(F.col("tp") * (1 - F.col(label).cast("long"))).alias("s"), F.sum(F.col(label).cast("long")).alias("n_pos"), F.count(F.lit(1)).alias("n"))
    n_neg = F.col("n") - F.col("n_pos")
    return total.select("n_pos", n_neg.alias("n_neg"), F.when((F.col("n_pos") > 0) & (n_neg > 0), F.col("s") / (F.col("n_pos") * n_neg)).alias("roc_auc"))


def pr_curve(df: DataFrame, score: str, label: str, ties: list[str]) -> DataFrame:
    """One row a scored row: ``k, precision, recall, threshold``."""
    n_pos = totals(df, label).select("n_pos")
    at = ranked(df, score, label, ties).join(F.broadcast(n_pos))  # one row
    return at.select(*ties, "k", (F.col("tp") / F.col("k")).alias("precision"), (F.col("tp") / F.greatest("n_pos", F.lit(1))).alias("recall"), F.col(score).alias("threshold"))


def roc_curve(df: DataFrame, score: str, label: str, ties: list[str]) -> DataFrame:
    """One row a scored row: ``k, fpr, tpr``; the curve also has the point (0, 0)."""
    at = ranked(df, score, label, ties).join(F.broadcast(totals(df, label)))  # one row
    return at.select(*ties, "k", ((F.col("k") - F.col("tp")) / F.greatest(F.col("n") - F.col("n_pos"), F.lit(1))).alias("fpr"), (F.col("tp") / F.greatest("n_pos", F.lit(1))).alias("tpr"))


def best_f1(df: DataFrame, score: str, label: str, ties: list[str]) -> DataFrame:
    """One row: the first rank with the largest F1, and precision, recall, IoU and positive rate there."""
    at = pr_curve(df, score, label, ties)
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-12))
    top = at.agg(F.max(F.struct(f1.alias("f1"), (-F.col("k")).alias("back"), "precision", "recall", "threshold")).alias("b")).select("b.*")
    both = top.join(totals(df, label))
    k = -F.col("back")
    tp = F.col("precision") * k
    return both.select("f1", "threshold", "precision", "recall", k.alias("k"), (tp / F.greatest(k + F.col("n_pos") - tp, F.lit(1e-12))).alias("iou"), (F.col("n_pos") / F.col("n")).alias("positive_rate"))


def summarise(df: DataFrame, score: str, label: str, ties: list[str]) -> dict[str, float]:
    """All of it as numbers on the driver."""
    out = best_f1(df, score, label, ties).first().asDict()
    out.pop("k", None)
    area = roc_auc(df, score, label, ties).first()["roc_auc"]
    return {"pr_auc": pr_auc(df, score, label, ties).first()["pr_auc"], "roc_auc": float("nan") if area is None else area, **out}


def pr_auc_by(df: DataFrame, group: list[str], score: str, label: str, ties: list[str]) -> DataFrame:
    """The precision-recall area of each group, whatever the groups' sizes are."""
    y = F.col(label).cast("long")
    used = df.select(*dict.fromkeys([*group, score, *ties]), y.alias("y"))
    at = running(used, score, ties, {"tp": F.col("y")}, by=group)
    total = at.groupBy(*group).agg(F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("k")).otherwise(0.0)).alias("s"), F.sum("y").alias("n_pos"))
    return total.select(*group, "n_pos", (F.col("s") / F.greatest(F.col("n_pos").cast("double"), F.lit(1e-12))).alias("pr_auc"))


def resampled(images: DataFrame, replicates: int, seed: int, image: str = "image_no") -> DataFrame:
    """``(rep, slot, image_no)``: for each replicate as many images as there are, drawn with replacement.

    ``images`` has the numbers 0 to n - 1. A draw is the first 15 hex digits of md5(seed:rep:slot), modulo n.
    """
    n = images.count()
    slots = images.sparkSession.range(replicates * n).select(F.floor(F.col("id") / max(n, 1)).alias("rep"), (F.col("id") % max(n, 1)).alias("slot"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("slot").cast("string"))), 1, 15), 16, 10).cast("long") % max(n, 1)
    return slots.select("rep", "slot", draw.alias(image))


def bootstrap_delta(df: DataFrame, image: str, score_a: str, score_b: str, label: str, ties: list[str], replicates: int = 2000, seed: int = 0) -> DataFrame | None:
    """One row: mean and 95 % interval of the precision-recall area of B less that of A over resampled images.

    Each replicate ranks its own pool, in which ties are walked row by row; replicates are groups of one distributed order.
    None with fewer than three images.
    """
    numbered = materialise(ordered(df.select(image).distinct(), [image], {}).select(image, (F.col("k").cast("long") - 1).alias("image_no")), "bootstrap-images")
    n = numbered.count()
    if n < LEAST_IMAGES:
        return None
    pool = materialise(resampled(numbered, replicates, seed).join(numbered, "image_no").join(df, image), "bootstrap-pool")
    area = lambda s, name: pr_auc_by(pool, ["rep"], s, label, ["slot", *ties]).select("rep", F.col("pr_auc").alias(name))
    delta = area(score_a, "a").join(area(score_b, "b"), "rep").select("rep", (F.col("b") - F.col("a")).alias("delta"))
    ends = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    return delta.agg(F.avg("delta").alias("delta_mean"), ends.alias("e"), F.count(F.lit(1)).alias("replicates")).select("delta_mean", F.col("e")[0].alias("ci_lo"), F.col("e")[1].alias("ci_hi"), "replicates", F.lit(n).cast("long").alias("n_images"))


def sigmoid(raw: Column) -> Column:
    return 1 / (1 + F.exp(-raw))


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: how many values of two tables differ, the largest difference, and how many rows both have."""
    x, y = a.select(*keys, F.col(value).alias("__a")), b.select(*keys, F.col(value).alias("__b"))
    d = x.join(y, keys)
    return d.agg(F.sum((~F.col("__a").eqNullSafe(F.col("__b"))).cast("long")).alias("mismatches"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("largest"), F.count(F.lit(1)).alias("n"))
