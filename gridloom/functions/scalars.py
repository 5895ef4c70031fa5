"""Scalar rules of the front end: thumbnail sizes, strides, names and small parsers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 64
#: The feature banks of a mode, in order.
MODES = {
    "raw": ("raw",),
    "raw_plus_global": ("raw", "global"),
    "raw_plus_global_context": ("raw", "global", "context"),
    "raw_plus_global_context_ext": ("raw", "global", "context", "ctx2"),
}
CONTEXT_NAMES = ("ctx_x", "ctx_y", "ctx_surr3", "ctx_ring35", "ctx_range3")
CONTEXT2_NAMES = ("ctx_surr9", "ctx_range5")


def thumb_size(h: Column, w: Column, policy: str | int) -> Column:
    """The thumbnail of an image as a struct (h, w), from a side in pixels or a policy's name.

    All policies start from the power of two below the shorter side, and no side is below the grid's. ``pow2`` is that square;
    ``pow2-fit`` has it as its longer side, ``pow2-cover`` as its shorter one, the other side in multiples of 64, halves up.
    """
    if isinstance(policy, int):
        return F.struct(F.lit(policy).cast("long").alias("h"), F.lit(policy).cast("long").alias("w"))
    short, long = F.least(h, w), F.greatest(h, w)
    side = F.pow(F.lit(2.0), F.floor(F.log2(short)))
    if policy == "pow2":
        other = side
    elif policy == "pow2-fit":
        steps = F.floor(side * short / long / GRID + 0.5)
        other = F.when(steps > 0, steps * GRID).otherwise(side)
    elif policy == "pow2-cover":
        other = F.floor(side * long / short / GRID + 0.5) * GRID
    else:
        raise ValueError(f"unknown thumbnail policy {policy!r}")
    low = F.greatest(F.lit(GRID), F.least(side, other)).cast("long")
    high = F.greatest(F.lit(GRID), F.greatest(side, other)).cast("long")
    return F.struct(F.when(h <= w, low).otherwise(high).alias("h"), F.when(h <= w, high).otherwise(low).alias("w"))


def stride_for(stride: int, h: Column, w: Column) -> Column:
    """The stride cut down so that every cell has a sample."""
    return F.greatest(F.lit(1), F.least(F.lit(stride), F.floor(F.least(h, w) / GRID))).cast("int")


def exponent_of(size: int) -> int:
    if size < 1 or size & (size - 1):
        raise ValueError(f"{size} is not a power of two")
    return size.bit_length() - 1


def parse_levels(text: str, grid: int = GRID) -> tuple[int, ...]:
    """``"64,32,8"`` to levels, the finest first, each once."""
    sizes = {int(t) for t in text.split(",") if t.strip()}
    if not sizes:
        raise ValueError(f"no levels in {text!r}")
    for s in sizes:
        if s < 1 or s & (s - 1) or grid % s:
            raise ValueError(f"level {s} must be a power of two that divides {grid}")
    return tuple(sorted(sizes, reverse=True))


def parse_scales(text: str | None) -> list[tuple[int, int, str]]:
    """``"512:2;256"`` to (thumbnail, stride, label); a missing stride gives four samples a cell."""
    out = []
    for token in filter(None, (t.strip() for t in (text or "").split(";"))):
        thumb, _, stride = token.partition(":")
        step = int(stride or 0)
        step = step if step > 0 else max(1, int(thumb) // (4 * GRID))
        out.append((int(thumb), step, f"{int(thumb)}px/s{step}"))
    return out


def column_names(levels: tuple[int, ...], channels: str, raw: tuple[str, ...], mode: str, global_names: tuple[str, ...] = (), scales: tuple[str, ...] = ()) -> list[str]:
    """The names of all columns, level by level and bank by bank."""
    if mode not in MODES:
        raise ValueError(f"unknown feature mode {mode!r}")
    names: list[str] = []
    for level in levels:
        for bank in MODES[mode]:
            if bank == "raw":
                names += [f"{level}{at}/{c}/{f}" for at in ("", *(f"@{s}" for s in scales)) for c in channels for f in raw]
            elif bank == "global":
                names += [f"{level}/global/{n}" for n in global_names] if level == levels[0] else []
            else:
                names += [f"{level}/{bank}/{n}" for n in (CONTEXT_NAMES if bank == "context" else CONTEXT2_NAMES)]
    return names


def level_of(name: str, grid: int = GRID) -> tuple[int, int]:
    """Side of a column's native grid, and twice the number of halvings from the output grid."""
    prefix, bank, *_ = name.split("/")
    side = 1 if bank == "global" else int(prefix.split("@")[0])
    if side < 1 or side & (side - 1) or grid % side:
        raise ValueError(f"{name!r}: {side} doesn't tile {grid}")
    return side, 2 * int(math.log2(grid // side))


def global_stats(block: str, h: str, w: str) -> Column:
    """An image's block of floats, non-finite ones as zero, with its aspect ratio and log area."""
    finite = F.transform(F.col(block).cast("array<float>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(0.0).cast("float")).otherwise(x))
    aspect = (F.col(w).cast("double") / F.greatest(F.col(h).cast("double"), F.lit(1.0))).cast("float")
    return F.concat(finite, F.array(aspect, F.log1p(F.col(h).cast("double") * F.col(w)).cast("float")))


def is_positive(coverage: str, least: float = 0.10) -> Column:
    """Whether a cell's coverage makes it positive; compared as float."""
    return F.col(coverage).cast("float") >= F.lit(least).cast("float")
