"""Image and mask folders as tables, their pairing, and hash memos."""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions of images, in the order in which a mask with another extension than its image is taken.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".avif", ".gif")


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: str | Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def list_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``(path, name, length, modified)`` of a folder's images; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    named = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.unix_seconds("modificationTime").alias("modified"))
    return named.where(extension("path").isin(*EXTENSIONS))


def pair(images: DataFrame, masks: DataFrame, image_name: str = "name", mask_name: str = "name") -> DataFrame:
    """``(image, mask)`` for every image: the mask is called ``<stem>_mask`` in any case, with the image's extension or else the first of the list; null if there is none."""
    i = images.select(F.col(image_name).alias("image"), F.lower(F.concat(stem(F.col(image_name)), F.lit("_mask"))).alias("want"), extension(F.col(image_name)).alias("ext"))
    m = masks.select(F.col(mask_name).alias("mask"), F.lower(stem(F.col(mask_name))).alias("want"), extension(F.col(mask_name)).alias("mask_ext"))
    rank = F.when(F.col("ext") == F.col("mask_ext"), 0).otherwise(F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("mask_ext")))
    return i.join(m, "want", "left").groupBy("image").agg(F.min_by("mask", F.struct(rank, F.col("mask"))).alias("mask"))


def missing(images: DataFrame, masks: DataFrame, on: str) -> DataFrame:
    """Images without a mask."""
    return images.join(masks, on, "left_anti")


def require_pairs(paired: DataFrame) -> DataFrame:
    """The pairs, or an error that names up to three images without a mask."""
    lacking = [r["image"] for r in paired.where("mask is null").select("image").sort("image").limit(3).collect()]
    if lacking:
        raise ValueError(f"images without a mask, such as {lacking}")
    return paired


def decode(files: DataFrame, grey: bool = False) -> DataFrame:
    """``(path, h, w, pixels)`` of files with ``path, content``; null where one can't be read. A missing decoder is an error when rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from PIL import Image

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    im = Image.open(io.BytesIO(content)).convert("L" if grey else "RGB")
                    rows.append((path, im.height, im.width, im.tobytes()))
                except Exception:  # noqa: BLE001 - an unreadable image is a row without pixels, whatever its decoder raises
                    rows.append((path, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["path", "h", "w", "pixels"])

    return files.select("path", "content").mapInArrow(run, "path string, h int, w int, pixels binary")


def memo_key() -> Column:
    """What a hash memo is kept by: path, size and time."""
    return F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modified").cast("string"))


def unhashed(files: DataFrame, memo: DataFrame) -> DataFrame:
    """Files that the memo lacks."""
    return files.withColumn("key", memo_key()).join(memo.select("key"), "key", "left_anti")


def remember(hashed: DataFrame, memo: str) -> None:
    """Appends the hashes of files ``path, length, modified, hash`` to the memo folder; a file that changes gets another key."""
    hashed.select(memo_key().alias("key"), "hash").write.mode("append").parquet(memo)


def memoised(files: DataFrame, memo: DataFrame) -> DataFrame:
    """``files`` with ``hash`` from the memo, null where it has none. A key that was written twice counts once."""
    known = memo.groupBy("key").agg(F.min("hash").alias("hash"))
    return files.withColumn("key", memo_key()).join(known, "key", "left").drop("key")


def native_maps(found: DataFrame, sides: dict[str, int]) -> DataFrame:
    """Features that another process made, checked: ``image_id`` and a map for each name of ``sides``, an array of side times side numbers.

    A missing column is an error at once, a map of another size an error when it is read.
    """
    lacking = sorted({"image_id", *sides} - set(found.columns))
    if lacking:
        raise ValueError(f"no columns {lacking}")
    sized = lambda n, s: F.when(F.size(n) == s * s, F.col(n).cast("array<float>")).otherwise(F.raise_error(F.concat(F.lit(f"{n} has not {s * s} cells but "), F.size(n).cast("string"))))
    return found.select("image_id", *(sized(n, s).alias(n) for n, s in sides.items()))


def read_floats(path: str | Path, count: int | None = None):
    """Little-endian floats of a raw file, whose size is checked."""
    import numpy as np

    data = Path(path).read_bytes()
    if len(data) % 4 or count is not None and len(data) != 4 * count:
        raise ValueError(f"{path} has {len(data)} bytes")
    return np.frombuffer(data, "<f4")
