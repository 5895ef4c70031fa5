"""Language of documents by rank-order profiles.

A text's n-grams (1 to 3 signs of its letter runs, lower-cased, with an edge mark on both sides) are ranked by how often they
occur. A language's profile holds the ``TOP`` most frequent n-grams of all its learning texts; a document's
distance to it is the sum, over the document's own ``TOP`` most frequent, of how far the ranks are apart, and ``TOP`` for
n-grams the profile lacks. The nearest profile wins; of equals the first language by code point.

Counts come from every learning text, are summed in map tasks and then by language and n-gram, and only the
profiles (``TOP`` short strings a language) reach the driver. N-grams are numbers here: a slice of texts is one array of
code points, and its n-grams are counted in array operations.

Cases: a null text, or one without letters, is ``und`` with score 0; texts without a language are not
learned from; with no profile at all every text is ``und``; of n-grams equally often the first by code point ranks first; repeated rows are predicted each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .packing import chunks
from .text import tidy

TOP = 300
EDGE = "_"
UNKNOWN = "und"
#: Counts that a learning task holds before it sends them on.
KEPT = 400_000
#: Documents that are ranked at a time, and bytes of text that are cut at a time.
ROWS, CHUNK_BYTES = 128, 2 << 20
#: Largest table of n-gram numbers that is looked up directly, and largest table of counts by text; beyond them numbers are sorted.
DIRECT, CELLS = 1 << 23, 1 << 22


def _distinct(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values below ``most``, ascending, and the place of each value among them."""
    if most > DIRECT:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[values] = True
    used = np.flatnonzero(seen)
    to = np.zeros(most, np.int32)
    to[used] = np.arange(len(used), dtype=np.int32)
    return used, to[values]


def _counted(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values below ``most``, ascending, and how often each is there."""
    table = np.bincount(values, minlength=most) if most else np.empty(0, np.int64)
    return np.flatnonzero(table), table[table > 0]


class Grams:
    """Every occurrence of an n-gram in some texts, as its text's ``row`` and its place in ``numbers``.

    ``signs`` are the edge mark and the texts' different letters, ascending. An n-gram of signs a, b, c has the number
    ``(a' base + b') base + c'``, with a' one more than a's place and 0 for what a shorter n-gram lacks, so that
    numbers are in the order of the strings. ``numbers`` are the different ones, ascending.
    """

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() + "\n" for t in texts]
        points = np.frombuffer(("\n" + "".join(lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), list(map(len, lowered)))
        row = np.concatenate([np.zeros(1, np.int32), row])
        used, place = _distinct(points, int(points.max()) + 1)
        letter = np.fromiter((chr(c).isalpha() for c in used.tolist()), bool, len(used))
        self.signs = EDGE + "".join(map(chr, used[letter].tolist()))
        self.base = base = len(self.signs) + 1
        sign = np.ones(len(used), np.int64)  # what is no letter is an edge
        sign[letter] = np.arange(2, letter.sum() + 2)
        a = sign[place]
        inner = a > 1
        one, two, three = np.flatnonzero(inner), np.flatnonzero(inner[:-1] | inner[1:]), np.flatnonzero(inner[1:-1])
        number = np.concatenate([a[one] * (base * base), (a[two] * base + a[two + 1]) * base, (a[three] * base + a[three + 1]) * base + a[three + 2]])
        self.row = np.concatenate([row[one], np.where(inner[two + 1], row[two + 1], row[two]), row[three + 1]])
        self.numbers, self.place = _distinct(number, base**3)

    def strings(self, places: np.ndarray | None = None) -> list[str]:
        """The n-grams at these places of ``numbers``, or all."""
        signs, b = self.signs, self.base
        name = lambda k: signs[k - 1] if k else ""
        return [name(n // (b * b)) + name(n // b % b) + name(n % b) for n in (self.numbers if places is None else self.numbers[places]).tolist()]

    def find(self, grams: list[str]) -> np.ndarray:
        """The place of each n-gram among ``numbers``, or -1."""
        at, b = {c: k + 1 for k, c in enumerate(self.signs)}, self.base
        wanted = np.array([((at.get(g[0], -1) * b + (at.get(g[1], -1) if len(g) > 1 else 0)) * b + (at.get(g[2], -1) if len(g) > 2 else 0)) if all(c in at for c in g) else -1 for g in grams], np.int64)
        if not len(self.numbers):
            return np.full(len(grams), -1)
        k = np.minimum(np.searchsorted(self.numbers, wanted), len(self.numbers) - 1)
        return np.where(self.numbers[k] == wanted, k, -1)


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> dict[str, list[str]]:
    """For each language its ``top`` n-grams, the most frequent first. A null language is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], int] = defaultdict(int)

        def batch_of(langs, grams, counts):
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

        def out():
            rows = list(held.items())
            held.clear()
            for k in range(0, len(rows), 1 << 15):
                part = rows[k : k + (1 << 15)]
                yield batch_of([x[0][0] for x in part], [x[0][1] for x in part], [x[1] for x in part])

        for batch in batches:
            for part in chunks(batch, CHUNK_BYTES):
                langs, of = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
                grams = Grams(part.column(1).to_pylist())
                width = len(grams.numbers)
                pair, total = np.unique(of[grams.row] * width + grams.place, return_counts=True) if width > DIRECT // 8 else _counted(of[grams.row] * width + grams.place, len(langs) * width)
                many = len(pair) > KEPT // 4  # so many different ones hardly repeat: they go on as they are
                for a in range(0, len(pair), 1 << 15):
                    mine = pair[a : a + (1 << 15)]
                    names, who, n = grams.strings(mine % width), langs[mine // width], total[a : a + (1 << 15)].tolist()
                    if many:
                        yield batch_of(who, names, n)
                    else:
                        for lang, name, k in zip(who.tolist(), names, n, strict=True):
                            held[lang, name] += k
                if len(held) > KEPT:
                    yield from out()
        yield from out()

    counted = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "lang string, gram string, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = total.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).select("lang", "gram", "k")
    profiles: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in best.toLocalIterator():
        profiles[r["lang"]].append((r["k"], r["gram"]))
    return {lang: [g for _, g in sorted(profiles[lang])] for lang in sorted(profiles)}


class LanguageModel:
    """Predicts by out-of-place distance to the profiles."""

    def __init__(self, profiles: dict[str, list[str]], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        self.profiles = [profiles[lang] for lang in self.langs]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (one less the distance's share of the largest possible) of each text."""
        n, top = len(texts), self.top
        number, distance = np.zeros(n, np.int64), np.zeros((len(self.langs), n), np.int64)
        grams = Grams(texts)
        width = len(grams.numbers)
        if width and self.langs:
            rank = np.full((len(self.langs), width), -1)
            for mine, profile in zip(rank, self.profiles, strict=True):
                at = grams.find(profile)
                mine[at[at >= 0]] = np.flatnonzero(at >= 0)
            # n-grams of one length each lie in order of their texts
            order = np.argsort(grams.row, kind="stable")
            row, place = grams.row[order].astype(np.int64), grams.place[order]
            edges = np.searchsorted(row, np.arange(0, n + ROWS, ROWS))
            dense = ROWS * width <= CELLS
            for b in range(0, n, ROWS):
                rows, a, z = min(ROWS, n - b), edges[b // ROWS], edges[b // ROWS + 1]
                of, at, gram = (self._best_of_table if dense else self._best_of_pairs)((row[a:z] - b) * width + place[a:z], rows, width)
                theirs = rank[:, gram]
                apart = np.where(theirs < 0, top, np.minimum(np.abs(theirs - at), top))
                for k, each in enumerate(apart):
                    distance[k, b : b + rows] = np.bincount(of, each, rows).astype(np.int64)
                number[b : b + rows] = np.bincount(of, minlength=rows)
        known = number > 0
        near = distance.argmin(0) if self.langs else np.zeros(n, np.int64)
        score = np.where(known, 1 - distance.min(0, initial=top * top) / np.maximum(number * top, 1), 0.0)
        return [self.langs[k] if x else UNKNOWN for k, x in zip(near.tolist(), known.tolist(), strict=True)], score

    # Text, rank and n-gram of each text's most frequent ones: larger counts first, then the smaller place. ``pairs`` are text times width plus place.

    def _best_of_table(self, pairs: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From a count of every n-gram in every text: for few n-grams."""
        take = min(self.top, width)
        table = np.bincount(pairs, minlength=rows * width).reshape(rows, width)
        key = table * width - np.arange(width)  # all distinct, so what is selected is definite
        best = np.argpartition(key, width - take, axis=1)[:, width - take :]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(key, best, 1), axis=1), 1)
        of, at = np.nonzero(np.take_along_axis(table, best, 1))
        return of, at, best[of, at]

    def _best_of_pairs(self, pairs: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the n-grams that are there: memory follows the texts, however many n-grams there are."""
        pair, count = np.unique(pairs, return_counts=True)
        of, gram = pair // width, pair % width
        order = np.lexsort((gram, -count, of))
        of, gram = of[order], gram[order]
        at = np.arange(len(of)) - np.searchsorted(of, np.arange(rows))[of]
        keep = at < self.top
        return of[keep], at[keep], gram[keep]


def with_language(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", keep: list[str] | None = None, top: int = TOP) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``lang_pred`` and ``score``, which replace columns of those names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # ``top`` short strings a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(shared.value, top)
        for batch in batches:
            for part in chunks(batch, CHUNK_BYTES):
                langs, scores = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["row", "lang_pred", "score"])

    used = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    schema = StructType().add("row", used.schema["row"].dataType).add("lang_pred", "string", False).add("score", "double", False)
    return used.mapInArrow(tidy(run), schema).select("row.*", "lang_pred", "score")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    profiles = learn_profiles(docs.where(~held_out))
    return with_language(docs, profiles, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
