"""The model file: a container with a JSON header around a binary table of trees, all little-endian.

Fixed values of the formats. Container: magic ``FDT1``, u32 version 1, u32 header length, JSON padded with spaces to 8 bytes, trees.
Trees: magic ``IMSY``, then u32 version 4, trees, features, leaves, depth, leaf bits, leaf chunk, coarse trees, i32 smallest exponent, u32 chunks,
stages; u32 leaf start of each tree and the end, u32 split byte of each tree and the end; splits (u16 feature, u8 bin, u8 0); u8 leaf codes;
f32 offset of each tree; u8 shift of each chunk; stages (u32 trees, f32 threshold); u32 border count of each feature; f32 borders; u8 level shift of
each feature.
"""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trees import Ensemble, Tree, stage_chunks

CONTAINER_MAGIC, CONTAINER_VERSION = b"FDT1", 1
TREES_MAGIC, TREES_VERSION = b"IMSY", 4
MAX_BORDERS = 15
_HEAD = struct.Struct("<4s8Ii2I")
_SPLIT = np.dtype([("feature", "<u2"), ("bin", "u1"), ("pad", "u1")])


def _starts(model: Ensemble) -> tuple[int, ...]:
    return (0, model.coarse_trees) if 0 < model.coarse_trees < len(model.trees) else (0,)


def encode_trees(model: Ensemble) -> bytes:
    """The binary table of a model."""
    n, depth = len(model.trees), model.depth
    if not 1 <= depth <= 7 or model.leaf_bits not in (4, 8) or not 1 <= model.leaf_chunk <= 17:
        raise ValueError("the format holds depth 1 to 7, 4 or 8 leaf bits and chunks of 1 to 17 trees")
    if any(len(b) > MAX_BORDERS for b in model.borders):
        raise ValueError(f"a feature has at most {MAX_BORDERS} borders")
    shift = model.level_shift or (0,) * len(model.borders)
    if len(shift) != len(model.borders) or any(s % 2 or not 0 <= s <= 12 for s in shift):
        raise ValueError("each feature has an even level shift of at most 12")
    of = stage_chunks(n, model.leaf_chunk, _starts(model))
    steps: dict[int, int] = {}
    for chunk, t in zip(of, model.trees, strict=True):
        if steps.setdefault(chunk, t.shift) != t.shift:
            raise ValueError("the trees of a chunk share a step")
    splits = np.array([(f, b, 0) for t in model.trees for f, b in t.splits], _SPLIT)
    return b"".join(
        [
            _HEAD.pack(TREES_MAGIC, TREES_VERSION, n, len(model.borders), n << depth, depth, model.leaf_bits, model.leaf_chunk, model.coarse_trees, model.e_min, len(steps), len(model.stages)),
            (np.arange(n + 1) << depth).astype("<u4").tobytes(),
            (np.arange(n + 1) * 4 * depth).astype("<u4").tobytes(),
            splits.tobytes(),
            np.array([c for t in model.trees for c in t.codes], np.uint8).tobytes(),
            np.array([t.offset for t in model.trees], "<f4").tobytes(),
            bytes(steps[k] for k in sorted(steps)),
            *(struct.pack("<If", k, x) for k, x in model.stages),
            np.array([len(b) for b in model.borders], "<u4").tobytes(),
            *(np.array(b, "<f4").tobytes() for b in model.borders),
            bytes(shift),
        ]
    )


def decode_trees(data: bytes) -> Ensemble:
    """The model of a binary table; anything that isn't just one is refused."""
    if data[:4] != TREES_MAGIC:
        raise ValueError(f"no table of trees: it begins with {data[:4]!r}")
    _, version, n, features, leaves, depth, bits, chunk, coarse, e_min, n_chunks, n_stages = _HEAD.unpack_from(data)
    if version != TREES_VERSION:
        raise ValueError(f"version {version} can't be read, only {TREES_VERSION}")
    if not 1 <= depth <= 7 or bits not in (4, 8) or not 1 <= chunk <= 17 or leaves != n << depth or coarse > n:
        raise ValueError("the table's header contradicts the format")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    take("<u4", n + 1), take("<u4", n + 1)
    splits = np.frombuffer(data, _SPLIT, n * depth, at).reshape(n, depth)
    at += splits.nbytes
    codes, offsets, shifts = take("u1", leaves).reshape(n, 1 << depth), take("<f4", n), take("u1", n_chunks)
    stages = []
    for _ in range(n_stages):
        k, x = struct.unpack_from("<If", data, at)
        stages.append((k, x))
        at += 8
    borders = tuple(tuple(take("<f4", int(k)).tolist()) for k in take("<u4", features))
    level = tuple(take("u1", features).tolist())
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes follow the table")
    if any(len(b) > MAX_BORDERS for b in borders) or any(s % 2 or s > 12 for s in level):
        raise ValueError("a feature has at most 15 borders and an even level shift of at most 12")
    of = stage_chunks(n, chunk, (0, coarse) if 0 < coarse < n else (0,))
    if n and of[-1] + 1 != n_chunks:
        raise ValueError(f"{n_chunks} chunks for {n} trees")
    trees = tuple(Tree(tuple((int(f), int(b)) for f, b, _ in s), tuple(c), float(o), int(shifts[k])) for s, c, o, k in zip(splits.tolist(), codes.tolist(), offsets, of, strict=True))
    return Ensemble(trees, borders, e_min, bits, chunk, coarse, tuple(stages), level)


@dataclass
class ModelFile:
    """What a model file holds."""

    config: dict
    feature_names: list[str]
    trees: bytes
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.metadata = {"container_version": CONTAINER_VERSION, "n_features": len(self.feature_names), "blob_bytes": len(self.trees), "created_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())} | self.metadata

    @property
    def model(self) -> Ensemble:
        return decode_trees(self.trees)

    def to_bytes(self) -> bytes:
        head = {"container_version": CONTAINER_VERSION, "config": self.config, "feature_names": self.feature_names, "metadata": self.metadata, "blob_bytes": len(self.trees)}
        text = json.dumps(head, separators=(",", ":")).encode()
        text += b" " * (-len(text) % 8)
        return CONTAINER_MAGIC + struct.pack("<2I", CONTAINER_VERSION, len(text)) + text + self.trees

    @classmethod
    def from_bytes(cls, data: bytes) -> ModelFile:
        if data[:4] != CONTAINER_MAGIC:
            raise ValueError(f"no model file: it begins with {data[:4]!r}")
        version, size = struct.unpack_from("<2I", data, 4)
        if version != CONTAINER_VERSION:
            raise ValueError(f"version {version} can't be read, only {CONTAINER_VERSION}")
        head, trees = json.loads(data[12 : 12 + size]), data[12 + size :]
        if head.get("blob_bytes", len(trees)) != len(trees):
            raise ValueError(f"the table has {len(trees)} of {head['blob_bytes']} bytes")
        more = {k: v for k, v in head.items() if k not in ("config", "feature_names", "metadata")}
        return cls(head.get("config") or {}, list(head.get("feature_names") or []), trees, (head.get("metadata") or {}) | more)

    def save(self, path: str | Path) -> Path:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(self.to_bytes())
        return path

    @classmethod
    def load(cls, path: str | Path) -> ModelFile:
        return cls.from_bytes(Path(path).read_bytes())


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """``(path, n_features, n_trees, depth, n_stages, blob_bytes, config)`` of a folder's model files, read where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [ModelFile.from_bytes(bytes(x)) for x in batch.column(1).to_pylist()]
            models = [f.model for f in files]
            numbers = [[len(m.borders) for m in models], [len(m.trees) for m in models], [m.depth for m in models], [len(m.stages) for m in models], [len(f.trees) for f in files]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int32()) for x in numbers), pa.array([json.dumps(f.config) for f in files], pa.string())], names=_LISTED)

    kinds = ("string", *["int"] * 5, "string")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(_LISTED, kinds, strict=True)))


_LISTED = ["path", "n_features", "n_trees", "depth", "n_stages", "blob_bytes", "config"]


def save_borders(spark: SparkSession, borders: list[list[float]], path: str) -> None:
    """Borders as tab-separated rows ``feature, border``, so that later blocks and runs share them."""
    rows = [(f, b) for f, each in enumerate(borders) for b in each]
    spark.createDataFrame(rows, "feature int, border double").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def load_borders(spark: SparkSession, path: str, n_features: int) -> list[list[float]]:
    """The borders of each feature, ascending."""
    out: list[list[float]] = [[] for _ in range(n_features)]
    for r in spark.read.schema("feature int, border double").option("sep", "\t").csv(path).sort("feature", "border").toLocalIterator():
        out[r["feature"]].append(r["border"])
    return out


def from_booster_json(text: str, bits: int = 4, chunk: int = 16, coarse: int = 0, level_shift: tuple[int, ...] = ()) -> Ensemble:
    """A model from a booster's JSON export: borders by feature, and oblivious trees with splits by border and float leaves.

    Only an identity output (scale 1, bias 0) can be carried, and a split's border must be one of its feature's.
    """
    from ..operators.trees import build_ensemble

    data = json.loads(text)
    scale, bias = data.get("scale_and_bias", [1, [0]])
    if scale != 1 or (bias and bias[0] != 0):
        raise ValueError(f"scale {scale} and bias {bias} can't be carried")
    borders = [list(f["borders"] or []) for f in sorted(data["features_info"]["float_features"], key=lambda f: f["feature_index"])]
    place = [{b: i for i, b in enumerate(each)} for each in borders]
    splits = []
    for tree in data["oblivious_trees"]:
        mine = []
        for s in tree["splits"]:
            f, b = s["float_feature_index"], s["border"]
            if b not in place[f]:  # also NaN
                raise ValueError(f"border {b!r} is none of feature {f}")
            mine.append((f, place[f][b]))
        splits.append(mine)
    return build_ensemble(splits, [t["leaf_values"] for t in data["oblivious_trees"]], borders, bits, chunk, coarse, level_shift)


def trees_table(spark: SparkSession, model: Ensemble) -> DataFrame:
    """One row a tree and leaf, with the leaf's value."""
    t = model.table(spark)
    value = F.col("offset") + F.col("code") * F.pow(F.lit(2.0), F.lit(model.e_min) + F.col("shift"))
    return t.select("tree", "offset", "shift", F.posexplode("codes").alias("leaf", "code")).select("tree", "leaf", "code", value.alias("value"))
