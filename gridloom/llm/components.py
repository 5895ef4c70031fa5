"""Connected components of a distributed edge list, without collecting it.

Every round has two halves. (1) Edges meet by their larger endpoint and each task
runs union-find over the edges it holds, which leaves ``(node, smallest node seen
with it)``; after the first round a node is the larger endpoint of at most one edge a
task, so no key is hot. (2) Parents are replaced by grandparents through a join
on the parent; a popular parent is hot there, and both sides are plain exchanges
that adaptive execution can split. The rounds end when the edge set repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_table, materialise
from .text import tidy

_SCHEMA = "node long, parent long"


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "parent"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, parent)``: each node that isn't its component's smallest, with that smallest.

    Self-loops and repeated edges are harmless; edges with a null end are ignored; no edges give no rows.
    """
    held = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("parent"))
    before, last = None, None
    while True:
        local = materialise(held.repartition("node").mapInArrow(tidy(_union_find), _SCHEMA), "components")
        if last is not None:
            drop_table(last)
        now = local.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "parent").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or now == before:
            return local
        before, last = now, local
        # One grandparent is enough: a parent's own rows keep its other links. Written first, so that both sides of the join are plain exchanges.
        above = materialise(local.groupBy(F.col("node").alias("parent")).agg(F.min("parent").alias("grandparent")), "components-up")
        held = local.join(above, "parent", "left").select("node", F.coalesce("grandparent", "parent").alias("parent"))
