"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

A source's rows all get ``target / source size`` copies, say ``b + p`` with ``b`` whole. ``b`` copies are
certain; the fractions ``p`` are rounded dependently. Two rows of ``w`` words and ``x = w p`` words of fractional mass meet:
mass moves from one to the other, in a direction drawn so that expectations hold, until one of them has none or all
of its ``w``; that one is decided and the other carries on. Masses are whole multiples of ``2**-20`` words, so each
move keeps their sum exactly until one undecided row is left.

Rows meet in buckets of some 128 by a hash of their id, folded in hash order; a bucket leaves at most one
undecided row. Those meet 128 buckets at a time, level by level: a reduction tree of depth
log128(rows), in which a source, or one repeated row, that holds a third of all rows is only more buckets. Draws are hashes of ids and texts, so reruns agree on any layout.

Rows longer than their source's mean go first. What their last undecided row gains or loses when it is rounded to the
nearer side is spread over the short rows' masses, which are rounded next, so that the whole source misses its target by half a
short row at most (by half a long one where there are no short rows).

Expectations hold for every row but those: they are left to the nearer side, and short rows' shares shift by what that leaves over.

Cases: a null text has no words, and rows without words are taken zero times; null is the last source; rows without an
id are told apart by their texts; repeated rows are numbered and rounded one by one; no rows, or none with words, give targets of zero; other columns are ignored;
more than ``MAX_SOURCES`` sources are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: Rows that meet in one bucket of the tree, on average.
FAN_IN = 128
#: A word's mass is this many units.
UNITS = 1 << 20
#: Copies of one row that one task makes at a time.
SPREAD = 1 << 16
#: Targets are settled over one short row a source, together.
MAX_SOURCES = 1 << 16
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0


def word_count(text: str) -> F.Column:
    """Number of runs outside ``[\\x20\\x09-\\x0D]``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source: its number, words, rows and target.

    Sources go by code point, null last, and take the weights in turn. Water is poured by weight up to ``most`` times a source's
    words: sorted by where they fill up, all before the first that doesn't fill are full.
    """
    rows = F.col("rows") if "rows" in sizes.columns else F.lit(1)
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * rows).alias("source_size"), F.sum(rows).cast("long").alias("source_rows"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    listed = total.withColumn("source_no", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    every = Window.partitionBy()
    cap = most * F.col("source_size")
    level = (
        listed.withColumn("wanted", share * F.sum("source_size").over(every))
        .withColumn("full_before", F.coalesce(F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("place", F.row_number().over(by_level))
    )
    open_at = F.when(cap > F.col("level") * F.col("weight"), F.struct("place", "level"))
    first = level.withColumn("first_open", F.min(open_at).over(every))
    filled = F.col("first_open").isNull() | (F.col("place") < F.col("first_open.place"))
    return first.select("source", "source_no", "source_size", "source_rows", F.when(filled, cap).otherwise(F.col("first_open.level") * F.col("weight")).alias("target"))


# One meeting: ``s`` is the state, the undecided row (id, w, x) and the decided ones, and ``e`` the next row.
# ``let`` holds what both directions may move; ``m`` is the state after the move.
_MEET = """
aggregate(rows, cast(named_struct('id', null, 'mark', 0L, 'h', 0L, 'w', 0L, 'x', 0L, 'done', array())
                     as struct<id: bigint, mark: bigint, h: bigint, w: bigint, x: bigint, done: array<struct<id: bigint, mark: bigint, w: bigint, one: boolean>>>),
  (s, e) -> if(s.w = 0,
    named_struct('id', e.id, 'mark', e.mark, 'h', e.h, 'w', e.w, 'x', e.x, 'done', s.done),
    transform(array(named_struct('up', least(s.w * {units} - s.x, e.x), 'down', least(s.x, e.w * {units} - e.x),
                                 'u', shiftrightunsigned(xxhash64(s.h, e.h, {level}L), 11) / 9007199254740992D)), let ->
      transform(array(if(let.u * (let.up + let.down) < let.down, let.up, -let.down)), d ->
        transform(array(named_struct('a', s.x + d, 'b', e.x - d)), m ->
          named_struct(
            'id', if(m.a > 0 and m.a < s.w * {units}, s.id, e.id),
            'mark', if(m.a > 0 and m.a < s.w * {units}, s.mark, e.mark),
            'h', if(m.a > 0 and m.a < s.w * {units}, s.h, e.h),
            'w', if(m.a > 0 and m.a < s.w * {units}, s.w, if(m.b > 0 and m.b < e.w * {units}, e.w, 0L)),
            'x', if(m.a > 0 and m.a < s.w * {units}, m.a, m.b),
            'done', concat(s.done,
              if(m.a = 0 or m.a = s.w * {units}, array(named_struct('id', s.id, 'mark', s.mark, 'w', s.w, 'one', m.a > 0)), array()),
              if(m.b = 0 or m.b = e.w * {units}, array(named_struct('id', e.id, 'mark', e.mark, 'w', e.w, 'one', m.b > 0)), array())))
        )[0])[0])[0]))
"""


def pivotal_rounding(rows: DataFrame, buckets: int, fan_in: int = FAN_IN, units: int = UNITS) -> tuple[DataFrame, DataFrame]:
    """Rounds the rows ``source_no, bucket, id, mark, h, w, x`` with ``0 < x < w * units``.

    Returns the decided rows ``(source_no, id, mark, w, one)``, where ``one`` tells whether a row gets a further copy, and the at most
    one undecided row of each source, ``(source_no, id, mark, h, w, x)``. ``buckets`` is the largest number of buckets of a source.
    """
    decided, level = None, 0
    while True:
        grouped = rows.groupBy("source_no", "bucket").agg(F.sort_array(F.collect_list(F.struct("h", "id", "mark", "w", "x"))).alias("rows"))
        met = materialise(grouped.select("source_no", "bucket", F.expr(_MEET.format(units=units, level=level)).alias("s")), "pivotal")
        done = met.select("source_no", F.explode("s.done").alias("d")).select("source_no", "d.*")
        decided = done if decided is None else decided.unionByName(done)
        left = met.where("s.w > 0").select("source_no", "bucket", "s.id", "s.mark", "s.h", "s.w", "s.x")
        if buckets <= 1:
            return decided, left.drop("bucket")
        buckets, level = -(-buckets // fan_in), level + 1
        rows = left.withColumn("bucket", F.floor(F.col("bucket") / fan_in))


def _numbered(rows: DataFrame, number: str) -> DataFrame:
    """Each row as often as its column ``number`` says, numbered ``k`` from 0; many copies of one row are dealt out before they are made."""
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({number} - 1) div {SPREAD}"))))
    if (rows.agg(F.max(number)).first()[0] or 0) > SPREAD:
        parts = parts.repartition(rows.sparkSession.sparkContext.defaultParallelism * 4)
    first = F.col("part") * SPREAD
    return parts.withColumn("k", F.explode(F.sequence(first, F.least(first + SPREAD, F.col(number)) - 1))).drop("part")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, fan_in: int) -> tuple[DataFrame, bool]:
    """``(id, mark, source, size, source_size, target, copies)`` for every row, with a mark of its text; whether rows repeat in id, text and source."""
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), mark.alias("mark"))
    sizes = materialise(read.groupBy("id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    if sizes.select("source").distinct().limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"targets are for {MAX_SOURCES} sources at most")
    targets = materialise(source_targets(sizes), "mix-targets")
    most = targets.agg(F.max("source_rows")).first()[0] or 0
    repeats = not sizes.where("rows > 1").isEmpty()
    single = _numbered(sizes, "rows") if repeats else sizes.withColumn("k", F.lit(0).cast("long"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = targets.select("source_no", "source", "source_size", "target", F.floor(copies).alias("whole"))
    each = single.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    full = F.col("w") * UNITS
    h = F.xxhash64(F.coalesce("id", F.lit(-1)), "mark", "k")  # rows that repeat have a number of their own
    bucket = F.pmod(F.xxhash64("h"), F.ceil(F.col("source_rows") / fan_in))
    each = each.select("source_no", "id", "mark", h.alias("h"), F.col("size").alias("w"), bucket.alias("bucket"), (F.col("size") * F.col("source_rows") > F.col("source_size")).alias("heavy"), F.rint((copies - F.floor(copies)) * F.col("size") * UNITS).cast("long").alias("x"))
    is_open = (F.col("x") > 0) & (F.col("x") < full)
    settle = lambda rows: rows.where(~is_open).select("source_no", "id", "mark", "w", ((F.col("x") >= full) & (full > 0)).alias("one"))
    buckets = -(-most // fan_in)

    heavy, last = pivotal_rounding(each.where(F.col("heavy") & is_open).drop("heavy"), buckets, fan_in)
    one = 2 * F.col("x") >= full
    over = last.select(F.col("source_no").alias("of"), (F.col("x") - F.when(one, full).otherwise(F.lit(0))).alias("over"))
    light = each.where(~F.col("heavy") & is_open).drop("heavy")
    room = light.groupBy("source_no").agg(F.sum("w").alias("room"))
    over = materialise(over.join(room, F.col("of") == F.col("source_no")).select("of", "over", "room"), "mix-over")
    moved = F.col("x") + F.coalesce(F.rint(F.col("over") * (F.col("w") / F.col("room"))).cast("long"), F.lit(0))
    light = light.join(over, F.col("source_no") == F.col("of"), "left").withColumn("x", F.greatest(F.lit(0), F.least(full, moved))).drop("of", "over", "room")
    rounded, rest = pivotal_rounding(light.where(is_open), buckets, fan_in)

    parts = [settle(each), heavy, settle(light), rounded, *(x.select("source_no", "id", "mark", "w", one.alias("one")) for x in (last, rest))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    taken = F.when(F.col("w") > 0, F.col("whole") + F.col("one").cast("long")).otherwise(0).alias("copies")
    return every.join(per_source, "source_no").select("id", "mark", "source", F.col("w").alias("size"), "source_size", "target", taken), repeats


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fan_in: int = FAN_IN) -> DataFrame:
    """``(id, size, source_size, target, copies)`` for every row."""
    return _mixed(docs, id_col, text_col, source_col, fan_in)[0].select("id", "size", "source_size", "target", "copies")


def take_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns, whatever their names.

    Of rows that repeat in id, text and source, one is taken as often as all of them are. No rows give no rows.
    """
    mixed, repeats = _mixed(docs, id_col, text_col, source_col, FAN_IN)
    per_key = materialise(mixed.where("copies > 0").groupBy("id", "mark", "source").agg(F.sum("copies").alias("copies")), "mix-taken")
    key = F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(source_col).alias("source")
    tagged = docs.select(F.struct(*docs.columns).alias("row"), *key)
    if repeats:  # map tasks collapse what they hold
        tagged = tagged.dropDuplicates(["id", "mark", "source"])
    # Both sides grow with the documents: neither may be broadcast, whatever its size just now.
    mine, theirs = tagged.alias("mine"), per_key.hint("merge").alias("theirs")
    same = F.col("mine.id").eqNullSafe(F.col("theirs.id")) & (F.col("mine.mark") == F.col("theirs.mark")) & F.col("mine.source").eqNullSafe(F.col("theirs.source"))
    taken = mine.join(theirs, same).select("row", "copies")
    if (per_key.agg(F.max("copies")).first()[0] or 0) > SPREAD:
        return _numbered(materialise(taken, "mix-many"), "copies").select("row.*")
    return taken.withColumn("k", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
