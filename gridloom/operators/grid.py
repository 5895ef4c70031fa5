"""Stencils and pyramids over the cells of an image.

An image is one row: its side ``g`` and its cells, row by row, in an array ``v``. A stencil is then a
projection over that row, two passes of one dimension each, and nothing is shuffled or joined. Cells are rows only where a
caller asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_cells(images: DataFrame, *arrays: str, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """One row a cell: ``cell, r, c`` and an element of each array."""
    first, *rest = arrays
    at = images.select(*keep, "g", F.posexplode(first).alias("cell", first), *rest)
    cols = [F.col(first), *(F.col(a)[F.col("cell")].alias(a) for a in rest)]
    return at.select(*keep, "cell", F.floor(F.col("cell") / F.col("g")).cast("int").alias("r"), (F.col("cell") % F.col("g")).cast("int").alias("c"), *cols)


def _reflect(i: str, g: str) -> str:
    """The index that stands for i beyond the border, the border cell repeated first."""
    return f"if({i} < 0, -{i} - 1, if({i} >= {g}, 2 * {g} - 1 - {i}, {i}))"


def _clamp(i: str, g: str) -> str:
    return f"greatest(0, least({g} - 1, {i}))"


def _box(v: str, g: str, kx: int, ky: int, at) -> str:
    """Mean over kx by ky cells as float, summed in double.

    ``v`` is bound to a name first: Spark may put what it stands for in its place, which must not be computed for every cell.
    """
    x = " + ".join(f"cast(w[(k div {g}) * {g} + {at(f'(k % {g} + {d})', g)}] as double)" for d in range(-(kx // 2), kx // 2 + 1))
    y = " + ".join(f"h[{at(f'(k div {g} + {d})', g)} * {g} + k % {g}]" for d in range(-(ky // 2), ky // 2 + 1))
    cells = f"sequence(0, cast({g} * {g} - 1 as int))"
    return f"transform(array({v}), w -> transform(array(transform({cells}, k -> {x})), h -> transform({cells}, k -> cast(({y}) / {kx * ky} as float)))[0])[0]"


def box_mean(v: str, g: str, k: int) -> Column:
    """Mean over k by k cells, reflected at the border; for sides of at least half of k."""
    return F.expr(_box(v, g, k, k, _reflect))


def smooth(v: str, g: str, kx: int, ky: int = 1) -> Column:
    """Mean over kx by ky cells, the border cell repeated."""
    return F.expr(_box(v, g, kx, ky, _clamp))


def _extreme(v: str, g: str, k: int, pick: str) -> str:
    d = k // 2
    cells = f"sequence(0, cast({g} * {g} - 1 as int))"
    x = f"array_{pick}(slice(w, cast((k div {g}) * {g} + greatest(0, k % {g} - {d}) + 1 as int), cast(least({g} - 1, k % {g} + {d}) - greatest(0, k % {g} - {d}) + 1 as int)))"
    y = f"array_{pick}(transform(sequence(cast(greatest(0, k div {g} - {d}) as int), cast(least({g} - 1, k div {g} + {d}) as int)), i -> h[i * {g} + k % {g}]))"
    return f"transform(array({v}), w -> transform(array(transform({cells}, k -> {x})), h -> transform({cells}, k -> {y}))[0])[0]"


def dilate(v: str, g: str, k: int) -> Column:
    """Largest of k by k cells; what lies outside doesn't count."""
    return F.expr(_extreme(v, g, k, "max"))


def erode(v: str, g: str, k: int) -> Column:
    return F.expr(_extreme(v, g, k, "min"))


def _minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).cast("float"))


def _zeros(g: str) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), (F.col(g) * F.col(g)).cast("int"))


def local_range(images: DataFrame, k: int, name: str) -> DataFrame:
    """Largest less smallest of k by k cells."""
    return images.withColumn("__hi", dilate("v", "g", k)).withColumn("__lo", erode("v", "g", k)).withColumn(name, _minus("__hi", "__lo")).drop("__hi", "__lo")


def coordinates(g: str) -> tuple[Column, Column]:
    """x and y of each cell, from -0.5 to 0.5; zeros below side 3."""
    axis = lambda i: f"transform(sequence(0, cast({g} * {g} - 1 as int)), k -> if({g} < 3, cast(0 as float), cast(cast({i} as float) / cast({g} - 1 as float) - 0.5 as float)))"
    return F.expr(axis(f"(k % {g})")), F.expr(axis(f"(k div {g})"))


def context(images: DataFrame) -> DataFrame:
    """``images`` with the banks ``ctx_x, ctx_y, ctx_surr3, ctx_ring35, ctx_range3`` and ``ctx_surr9, ctx_range5``.

    The first five are zero below side 3, the other two below side 5.
    """
    x, y = coordinates("g")
    out = images.withColumn("ctx_x", x).withColumn("ctx_y", y)
    wide = {3: F.col("g") >= 3, 5: F.col("g") >= 5}
    for k, least in ((3, 3), (5, 3), (9, 5)):
        out = out.withColumn(f"__b{k}", F.when(wide[least] & (F.col("g") >= (k + 1) // 2), box_mean("v", "g", k)).otherwise(_zeros("g")))
    for k, least in ((3, 3), (5, 5)):
        out = out.withColumn(f"__h{k}", dilate("v", "g", k)).withColumn(f"__l{k}", erode("v", "g", k))
    pick = lambda least, column: F.when(wide[least], column).otherwise(_zeros("g"))
    out = out.withColumn("ctx_surr3", pick(3, _minus("v", "__b3"))).withColumn("ctx_ring35", pick(3, _minus("__b5", "__b3"))).withColumn("ctx_range3", pick(3, _minus("__h3", "__l3")))
    out = out.withColumn("ctx_surr9", pick(5, _minus("v", "__b9"))).withColumn("ctx_range5", pick(5, _minus("__h5", "__l5")))
    return out.drop("__b3", "__b5", "__b9", "__h3", "__l3", "__h5", "__l5")


def pooled(images: DataFrame, factor: int, name: str = "v") -> DataFrame:
    """Images of side ``g / factor`` whose cells are means over ``factor`` by ``factor`` cells."""
    side = f"(g div {factor})"
    taps = " + ".join(f"cast(v[((k div {side}) * {factor} + {i}) * g + (k % {side}) * {factor} + {j}] as double)" for i in range(factor) for j in range(factor))
    mean = f"transform(sequence(0, cast({side} * {side} - 1 as int)), k -> cast(({taps}) / {factor * factor} as float))"
    keep = [c for c in images.columns if c not in ("g", "v")]
    return images.select(*keep, F.expr(f"cast({side} as int)").alias("g"), F.expr(mean).alias(name))


def pyramid(images: DataFrame, factors: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """One row a level and image, with the level's side ``g``. All levels come from one scan of the images."""
    levels = F.array(*[F.lit(f) for f in factors])
    keep = [c for c in images.columns if c not in ("g", "v")]
    taps = "aggregate(sequence(0, f - 1), 0D, (s, i) -> s + aggregate(sequence(0, f - 1), 0D, (t, j) -> t + v[((k div (g div f)) * f + i) * g + (k % (g div f)) * f + j]))"
    mean = f"transform(sequence(0, cast((g div f) * (g div f) - 1 as int)), k -> cast({taps} / (f * f) as float))"
    each = images.select(*keep, "g", "v", F.explode(levels).alias("f"))
    return each.select(*keep, F.expr("cast(g div f as int)").alias("side"), F.expr(mean).alias("m"))


def gather(images: DataFrame, factors: tuple[int, ...]) -> DataFrame:
    """Each finest cell with the value of its parent cell at every level, and of the whole image.

    The same values as joining the levels cell by cell: a parent is found by its index, so no join is needed.
    """
    out = images.withColumn("p1", F.col("v"))
    for f in factors:
        if f > 1:
            small = f"(g div {f})"
            taps = " + ".join(f"cast(v[((k div {small}) * {f} + {i}) * g + (k % {small}) * {f} + {j}] as double)" for i in range(f) for j in range(f))
            native = f"transform(sequence(0, cast({small} * {small} - 1 as int)), k -> cast(({taps}) / {f * f} as float))"
            out = out.withColumn(f"p{f}", F.expr(f"transform(array({native}), m -> transform(sequence(0, cast(g * g - 1 as int)), k -> m[(k div g div {f}) * {small} + (k % g) div {f}]))[0]"))
    return out.withColumn("overall", F.expr("cast(aggregate(v, 0D, (s, x) -> s + x) / (g * g) as float)"))


def to_grid(cells: DataFrame, image: str, cell: str, value: str, side: int = 64) -> DataFrame:
    """One row an image: its cells' values as an array of ``side`` times ``side`` floats, null where a cell is missing."""
    at = F.map_from_entries(F.collect_list(F.struct(F.col(cell).cast("int"), F.col(value).cast("float"))))
    held = cells.where(F.col(cell).between(0, side * side - 1)).groupBy(image).agg(at.alias("__m"))  # as many entries as an image has cells
    return held.select(image, F.lit(side).alias("g"), F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.try_element_at("__m", k)).alias("v"))


def native_offsets(sides: list[int]) -> list[int]:
    """Where each level's cells begin when levels lie one behind another, and the end."""
    return [sum(s * s for s in sides[:k]) for k in range(len(sides) + 1)]


def compose(levels: DataFrame, sides: list[int]) -> DataFrame:
    """One row an image of rows ``image_id, side, m``: all levels' cells one behind another, in the order of ``sides``: the factorised matrix."""
    held = levels.where(F.col("side").isin(*sides)).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("side", "m"))).alias("__m"))  # a few levels an image
    return held.select("image_id", F.concat(*[F.col("__m")[s] for s in sides]).alias("native"))


def expand(native: DataFrame, sides: list[int], side: int, keep: list[int] | None = None) -> DataFrame:
    """One row a cell of the finest grid: ``image_id, cell, x``, with its parent's value at each level, or at the levels ``keep``: the dense matrix.

    A parent is found by its index, so no join is needed.
    """
    start = native_offsets(sides)
    cell = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    parent = lambda s: F.expr(f"cast({start[sides.index(s)]} + (cell div {side}) div {side // s} * {s} + (cell % {side}) div {side // s} as int)")
    at = native.select("image_id", "native", cell.alias("cell"))
    return at.select("image_id", "cell", F.array(*[F.col("native")[parent(s)] for s in (sides if keep is None else [sides[k] for k in keep])]).alias("x"))


def gather_samples(samples: DataFrame, levels: DataFrame, grid: int) -> DataFrame:
    """Sampled cells ``image_id, cell`` with their parents' values, by joins on image and native cell.

    ``levels`` has ``image_id, side, cell, value`` for the native cells of all levels: the form to use when images
    are too large for one row.
    """
    sides = [r["side"] for r in levels.select("side").distinct().sort("side").toLocalIterator()]
    out = samples
    for side in sides:
        f = grid // side
        parent = F.floor(F.floor(F.col("cell") / grid) / f) * side + F.floor((F.col("cell") % grid) / f)
        native = levels.where(F.col("side") == side).select("image_id", F.col("cell").cast("long").alias("__p"), F.col("value").alias(f"p{f}"))
        out = out.withColumn("__p", parent).join(native, ["image_id", "__p"]).drop("__p")
    return out


def coverage(mask: DataFrame, h: int, w: int, grid: int) -> DataFrame:
    """``(image_id, cell, cov)``: mean of a mask's pixels ``image_id, r, c, v`` (0 to 255) over each cell of a grid.

    Where the grid doesn't divide the size, a pixel counts in each cell by the area it has there.
    """
    # A pixel of 1/h covers cells floor(r grid / h) up to floor(((r + 1) grid - 1) / h).
    shares = lambda i, n: F.transform(
        F.sequence(F.floor(F.col(i) * grid / n), F.floor(((F.col(i) + 1) * grid - 1) / n)),
        lambda k: F.struct(k.alias("at"), (F.least((k + 1) * n, (F.col(i) + 1) * grid) - F.greatest(k * n, F.col(i) * grid)).alias("part")),
    )
    each = mask.select("image_id", "v", F.explode(shares("r", h)).alias("y"), shares("c", w).alias("xs")).select("image_id", "v", "y", F.explode("xs").alias("x"))
    weight = F.col("y.part") * F.col("x.part")
    total = each.groupBy("image_id", (F.col("y.at") * grid + F.col("x.at")).alias("cell")).agg(F.sum(weight * F.col("v")).alias("s"), F.sum(weight).alias("w"))
    return total.select("image_id", F.col("cell").cast("int").alias("cell"), (F.col("s") / F.col("w") / 255).cast("float").alias("cov"))


def text_heuristic(images: DataFrame) -> DataFrame:
    """``images`` of ``g, mean, var, m3, sat, coherence`` with the closed-form baseline ``heuristic``.

    Contrast inside a cell beyond that between cells, less for saturated cells, gated by skew and by isotropy, smoothed along lines.
    """
    cells = "sequence(0, cast(g * g - 1 as int))"
    square = _box("transform(z.mean, x -> cast(x * x as float))", "g", 3, 3, _clamp)
    score = f"""
      transform({cells}, k -> cast(
        greatest(sqrt(greatest(cast(z.var[k] as double), 0D)) - sqrt(greatest(cast(b.sq[k] as double) - cast(b.m[k] as double) * b.m[k], 0D)), 0D)
        * (1 - 0.5D * z.sat[k] / 255)
        * (1 - 0.8D * (1 - least(abs(z.m3[k]) / (greatest(cast(z.var[k] as double), 0D) * sqrt(greatest(cast(z.var[k] as double), 0D)) + 0.000001D) / 1.2D, 1D)))
        * greatest(0D, least(1D, 1 - 0.8D * z.coherence[k])) as float))"""
    bound = f"transform(array(named_struct('sq', {square}, 'm', {_box('z.mean', 'g', 3, 3, _clamp)})), b -> {_box(score, 'g', 5, 1, _clamp)})[0]"
    fields = ", ".join(f"'{n}', {n}" for n in ("mean", "var", "m3", "sat", "coherence"))
    return images.withColumn("heuristic", F.expr(f"transform(array(named_struct({fields})), z -> {bound})[0]"))
