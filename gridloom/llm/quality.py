"""Quality of documents by a factorisation machine.

Inputs are hashed words (log counts, one unit of length a text), structure statistics of the
text, and numeric metadata columns. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so all pairwise interactions of rank ``RANK`` cost one pass over the inputs that aren't zero. It is fitted by
AdaGrad on the driver from at most ``MAX_TRAIN`` labelled rows, those with the smallest hash of their id, whose texts have ``MAX_TRAIN_BYTES`` together at most; scoring is
one pass over whole texts with a model of fixed size.

Cases: a null or empty text has no words and zero statistics, and gets a score like any other; a null label is not
learned from, a repeated one counts once, and if one class is missing every score is the share of label 1 (one half without labels); null or
non-finite metadata counts as zero; repeated rows are scored each; an empty table gives no rows; columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .packing import chunks
from .text import compact, tidy, words_of

BUCKETS = 1 << 15
RANK = 8
#: Labelled rows that the model is fitted from, at most, and bytes of their texts.
MAX_TRAIN, MAX_TRAIN_BYTES = 4096, 64 << 20
#: Bytes of text that are scored at a time; a longer text is scored by itself.
SLICE_BYTES = 1 << 20
EPOCHS = 10
BATCH = 128
RATE = 0.08
DECAY = 1e-5

#: Byte classes whose shares are statistics.
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".,;:'\"-()?", "!", "#$%&*@^~=+", "|<>[]{}\\/_")
_TABLE = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES, 1):
    _TABLE[np.frombuffer(_chars.encode(), np.uint8)] = _k
_TABLE[128:] = len(_CLASSES) + 1
N_STATS = len(_CLASSES) + 2 + 8


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows)


def _byte_shares(texts: pa.Array) -> np.ndarray:
    """Share of each byte class in each text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = _TABLE[np.frombuffer(b"".join(texts.to_pylist()), np.uint8)]
    ends = np.cumsum(sizes)
    out = np.zeros((len(sizes), len(_CLASSES) + 2))
    some = np.flatnonzero(sizes)
    for k in range(out.shape[1] if len(some) else 0):
        out[some, k] = np.add.reduceat(kinds == k, (ends - sizes)[some], dtype=np.int64) / sizes[some]
    return out


def _repeats(row: np.ndarray, item: np.ndarray, kinds: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, item) with counts; per row the number of items, the share of distinct ones, and the share of the most frequent."""
    pair, count = np.unique(row * max(kinds, 1) + item, return_counts=True)
    of, what = pair // max(kinds, 1), pair % max(kinds, 1)
    total = np.bincount(row, minlength=rows)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, of, count)
    at_least = np.maximum(total, 1)
    return of, what, count, np.stack([np.bincount(of, minlength=rows) / at_least, most / at_least], 1), total


def inputs(texts: pa.Array, metadata: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch as (row, bucket, value) of its hashed words, by row, and a dense matrix of statistics and metadata."""
    texts = compact(texts)
    n = len(texts)
    row, word, vocabulary = words_of(texts)
    bucket = np.fromiter((crc32(w) % buckets for w in vocabulary), np.int64, len(vocabulary))
    of, what, count, shares, total = _repeats(row, word.astype(np.int64), len(vocabulary), n)
    length = np.fromiter(map(len, vocabulary), np.float64, len(vocabulary))
    mean_length = _per_row(length[word], row, n) / np.maximum(total, 1)
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_utf8()), ""), "\n")
    per_line = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lines.flatten().dictionary_encode()
    *_, line_shares, n_lines = _repeats(np.repeat(np.arange(n), per_line), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary), n)
    value = np.log1p(count)
    norm = np.sqrt(_per_row(value * value, of, n))
    value = value / np.maximum(norm[of], 1e-9)
    dense = np.column_stack([_byte_shares(texts), shares, line_shares, mean_length, np.log1p(total), np.log1p(n_lines), total / np.maximum(n_lines, 1), np.log1p(np.maximum(metadata, 0))])
    return of, bucket[what], value, dense


@dataclass
class FactorisationMachine:
    """Weights for ``buckets`` hashed words and then the dense inputs, which are standardised and cut off at 5 deviations."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.linear) - len(self.mean)

    def sparse(self, row, bucket, value, dense) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row starts, columns and values of all inputs, row by row; every row has its dense ones."""
        n, d = dense.shape
        z = np.clip((dense - self.mean) / self.scale, -5, 5) / np.sqrt(d)
        rows = np.concatenate([row, np.repeat(np.arange(n), d)])
        order = np.argsort(rows, kind="stable")
        columns = np.concatenate([bucket, np.tile(np.arange(d) + self.buckets, n)])[order]
        return np.searchsorted(rows[order], np.arange(n)), columns, np.concatenate([value, z.ravel()])[order]

    def raw(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.empty(0), np.empty((0, self.factors.shape[1]))
        vx = self.factors[columns] * values[:, None]
        total = np.add.reduceat(vx, starts)
        pairs = 0.5 * (total * total - np.add.reduceat(vx * vx, starts)).sum(1)
        return self.bias + np.add.reduceat(self.linear[columns] * values, starts) + pairs, total

    def score(self, texts: pa.Array, metadata: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.sparse(*inputs(texts, metadata, self.buckets)))[0], -30, 30)))


def _in_slices(texts: pa.Array, metadata: np.ndarray, buckets: int, rows: int = 256) -> tuple[np.ndarray, ...]:
    """``inputs`` of many rows with the memory of a few."""
    parts = []
    for k in range(0, len(texts), rows):
        row, *rest = inputs(texts.slice(k, rows), metadata[k : k + rows], buckets)
        parts.append((row + k, *rest))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def fit(texts: pa.Array, metadata: np.ndarray, labels: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> FactorisationMachine:
    """A model of the labelled texts; deterministic for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    width = buckets + N_STATS + metadata.shape[1]
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(width), np.zeros((width, rank)), np.zeros(width - buckets), np.ones(width - buckets))
    if len(set(labels.tolist())) < 2:
        return model
    row, bucket, value, dense = _in_slices(texts, metadata, buckets)
    model.mean, model.scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    model.factors = rng.normal(0, 0.02, (width, rank))
    starts, columns, values = model.sparse(row, bucket, value, dense)
    ends = np.append(starts[1:], len(columns))
    seen, seen_f, seen_b = np.full(width, 1e-6), np.full((width, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            mine = order[k : k + BATCH]
            sizes = (ends - starts)[mine]
            begins = np.cumsum(sizes) - sizes
            take = np.arange(sizes.sum()) + np.repeat(starts[mine] - begins, sizes)
            c, x = columns[take], values[take]
            raw, total = model.raw(begins, c, x)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[mine]) / len(mine)
            each = np.repeat(error, sizes) * x
            used, at = np.unique(c, return_inverse=True)
            g = np.bincount(at, each) + DECAY * model.linear[used]
            gf = np.column_stack([np.bincount(at, each * (np.repeat(total[:, f], sizes) - model.factors[c, f] * x)) for f in range(rank)]) + DECAY * model.factors[used]
            seen[used] += g * g
            seen_f[used] += gf * gf
            seen_b += error.sum() ** 2
            model.linear[used] -= RATE * g / np.sqrt(seen[used])
            model.factors[used] -= 0.5 * RATE * gf / np.sqrt(seen_f[used])
            model.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return model


def _metadata(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    if not columns:
        return np.zeros((batch.num_rows, 0))
    return np.nan_to_num(np.column_stack([pc.fill_null(batch.column(c).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for c in columns]), posinf=0, neginf=0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column, columns: list[str], id_col: str = "doc_id", most: int = MAX_TRAIN, most_bytes: int = MAX_TRAIN_BYTES) -> pa.Table:
    """At most ``most`` labelled rows that fulfil ``learn``, those whose ids have the smallest hashes, sorted by it.

    ``columns`` begin with the text. Rows that repeat in id and text count once. Rows are taken whole, in order, as long as their texts have ``most_bytes`` together; one
    that would exceed them is passed over. Which rows these are is settled by numbers alone, before any text is fetched.
    """
    known = labels.where(F.col(label).isNotNull() & learn).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("double").alias("__label"))
    # Bounded by ``most`` rows of three numbers, so it may be broadcast.
    chosen = F.broadcast(known.withColumn("__hash", F.xxhash64("__id")).orderBy("__hash", "__id").limit(most))
    text = F.coalesce(F.col(columns[0]), F.lit(""))
    marked = docs.select(F.col(id_col).alias("__doc"), F.xxhash64(text).alias("__mark"), F.octet_length(text).alias("__size"), *columns).join(chosen, F.col("__doc") == F.col("__id"))
    sizes = marked.groupBy("__hash", "__mark").agg(F.max("__size").alias("n")).orderBy("__hash", "__mark").limit(most).collect()
    fit, room = [], most_bytes
    for r in sizes:
        if r["n"] <= room:
            fit.append((r["__hash"], r["__mark"]))
            room -= r["n"]
    taken = F.broadcast(docs.sparkSession.createDataFrame(fit, "h long, m long"))  # of ``most`` rows at most
    found = marked.join(taken, (F.col("__hash") == F.col("h")) & (F.col("__mark") == F.col("m"))).dropDuplicates(["__hash", "__mark"]).select("__hash", "__label", *columns)
    table = found.toArrow()
    return table.take(pc.sort_indices(table, [("__hash", "ascending"), (columns[0], "ascending")]))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> FactorisationMachine:
    table = labelled_sample(docs, labels, label, learn, [text_col, *metadata], id_col).combine_chunks()
    values = _metadata(table.to_batches()[0], list(metadata)) if len(table) else np.zeros((0, len(metadata)))
    return fit(table.column(text_col).combine_chunks() if len(table) else pa.array([], pa.string()), values, table.column("__label").to_numpy())


def with_score(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, and the score of each row; a column of that name is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, SLICE_BYTES):
                score = shared.value.score(part.column(1), _metadata(part, [f"m{k}" for k in range(len(metadata))]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["row", "score"])

    # The columns that are kept travel as one, so that their names can't clash with those here.
    used = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"), *(F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)))
    scored = used.mapInArrow(tidy(run), StructType().add("row", used.schema["row"].dataType).add("score", "double", False))
    return scored.select("row.*", F.col("score").alias(score_col))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    model = fit_quality(docs, labels, fold != 2)
    held_out, predicted = (fold == 2).alias("held_out"), (F.col("score") >= 0.7).cast("int").alias("predicted")
    return with_score(docs, model, keep=["doc_id"]).select("doc_id", held_out, "score", predicted)
