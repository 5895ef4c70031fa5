"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2r`` bits apart have a common variant within ``r`` bits of
each. So every distinct fingerprint emits all variants within half the radius, the
variants are shuffled, and fingerprints that meet at a variant are linked. All that
meet at one variant lie within the radius of one another, so a star from the
smallest of them keeps every connection; each star edge is verified again by
its Hamming distance and repeats are removed. A variant can hold at most as many
fingerprints as there are variants of one (65 for radius 2), so no bucket is hot, and
copies are one fingerprint before anything is emitted.

Cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other; fewer
words than the shingle length make one shingle; repeated rows and ties fall into one
component, named by its smallest id; rows with a null id get the component of
their fingerprint; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import drop_table, materialise
from .text import text_bytes, tidy

SEED = 42
BITS = 64


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of each word shingle of a text, A-Z lower-cased, words joined by one space."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = len(parts) - words + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, count)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set where over half of the hashes have them set."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[k : k + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fingerprint)`` of every row; the fingerprint is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash(t, words) for t in text_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "id long, fingerprint long")


def ball_masks(radius: int, bits: int = BITS) -> list[int]:
    """What is XORed to a fingerprint for each variant within ``radius`` bits, the fingerprint itself first, as signed longs."""
    sign = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [sign(sum(1 << b for b in chosen)) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def ball_links(prints: DataFrame, radius: int = 2, bits: int = BITS) -> DataFrame:
    """``(a, b)``, a < b: verified links that connect all distinct ``fingerprint`` values at most ``radius`` bits apart.

    Only the lowest ``bits`` bits vary; those above tell fingerprints of different kinds apart.
    """
    if radius % 2:
        raise ValueError("radius must be even: each side covers half of it")
    masks = ball_masks(radius // 2, bits)
    by_flip = F.array(*[F.lit(m) for m in masks])
    met = (
        prints.select("fingerprint", F.posexplode(by_flip).alias("flip", "mask"))
        .select(F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"), F.col("flip").cast("short").alias("flip"))
        .repartition("variant")
    )
    # A bucket's members are known from which flips led to it: word w of its bit set has flips 63 w to 63 w + 62.
    words = range((len(masks) + 62) // 63)
    sets = [F.bit_or(F.expr(f"if(flip div 63 = {w}, shiftleft(1L, flip % 63), 0L)")).alias(f"s{w}") for w in words]
    held = met.groupBy("variant").agg(*sets)
    count = sum((F.bit_count(f"s{w}") for w in words[1:]), F.bit_count("s0"))
    flips = F.concat(*[F.expr(f"transform(filter(sequence(0, 62), i -> getbit(s{w}, i) = 1), i -> i + {63 * w})") for w in words])
    member = F.transform(flips, lambda i: F.col("variant").bitwiseXOR(F.element_at(by_flip, i + 1)))
    stars = held.where(count > 1).select(F.array_sort(member).alias("m"))
    pairs = stars.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, len(masks))).alias("b"))
    return pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row; component_id is the smallest id that links reach."""
    prints = materialise(with_fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min("id").alias("first_id")), "simhash-distinct")
    up = connected_components(ball_links(distinct, radius), "a", "b")
    rooted = materialise(distinct.join(up, distinct.fingerprint == up.node, "left").select("fingerprint", "first_id", F.coalesce("parent", "fingerprint").alias("root")), "simhash-rooted")
    named = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-named")
    classes = rooted.join(named, "root").select(F.col("fingerprint").alias("known"), "component_id")
    return prints.join(classes, F.col("fingerprint") == F.col("known"), "left").select("id", "fingerprint", "component_id")


# Near copies by similarity, exactly. Fingerprints go first: texts whose fingerprints link are compared with one of their component. What fingerprints
# don't reach, prefixes do. Shingles have one order for all texts, and two texts whose similarity is at least s share a shingle
# among the first (1 - s) n + 1 of each: these, the prefixes, are dealt out by shingle. A pair that meets is passed over if sizes, places, or the bits
# in which its bitmaps differ leave no room for the overlap: a bitmap has the parity of the shingles on each bit, so bitmaps never differ in more bits than
# texts in shingles. Few others are left below s, and those are compared by all shingles. Any order is exact; one with frequent shingles last meets few.

#: One document in so many is looked at for frequent shingles; a shingle that so many of those have is frequent; so many are known at most. These set costs, not results.
SAMPLE, FREQUENT, MOST_FREQUENT = 8, 3, 1 << 18
#: Size of the table of bits by which texts that nothing met are passed over, and texts to a batch.
ASKED_BITS, TEXTS = 1 << 23, 256
#: A bitmap has two to four bits a shingle, at least and at most so many. These set costs, not results.
LEAST_BITS, MOST_BITS = 64, 2048
#: Pairs of a bucket that are looked at together, and buckets whose pairs are listed at once.
BLOCK, LISTED = 1 << 17, 32
_EPS = 1e-6


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The different shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, words))


def prefix(shingles: np.ndarray, frequent: np.ndarray, count: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles, rare ones before those of the ascending table ``frequent``: a text of this similarity has one of them among its own first ones."""
    n = len(shingles)
    if not n:
        return shingles
    level = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        level = np.where(frequent[at] == shingles, count[at], 0)
    return shingles[np.lexsort((shingles, level))][: n - int(np.ceil(similarity * n - _EPS)) + 1]


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles on each bit; the halves XORed are the bitmap of half as many bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _words(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of one length as a matrix of 64-bit words, folded to ``width`` of them."""
    out = np.frombuffer(b"".join(maps.tolist()), "<u8").reshape(len(maps), -1)
    while out.shape[1] > width:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits each pair of bitmaps differs: at most as many as there are shingles that one text alone has."""
    wide_a, wide_b = (np.fromiter(map(len, x), np.int64, len(x)) // 8 for x in (a, b))
    out = np.zeros(len(a), np.int64)
    kind = wide_a * (MOST_BITS + 1) + wide_b
    for k in np.unique(kind).tolist():
        mine = np.flatnonzero(kind == k)
        width = min(wide_a[mine[0]], wide_b[mine[0]])
        out[mine] = np.bitwise_count(_words(a[mine], width) ^ _words(b[mine], width)).sum(1)
    return out


def most_differing(size_a, size_b, similarity: float):
    """How many shingles one text alone may have in a pair of this similarity."""
    return (1 - similarity) / (1 + similarity) * (size_a.astype(np.int64) + size_b) + _EPS


def may_be_similar(size_a, place_a, size_b, place_b, similarity: float):
    """False if texts of these sizes whose first common shingle is at these places can't have the similarity."""
    room = 1 + np.minimum(size_a - place_a - 1, size_b - place_b - 1)
    least = similarity / (1 + similarity) * (size_a.astype(np.int64) + size_b)
    return (room >= least - _EPS) & (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - _EPS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            part = batch.slice(k, TEXTS)
            yield part, list(text_bytes(part.column(1)))


def _each_shingle(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, words) for t in texts]).view(np.int64))], names=["shingle"])

    return run


_ROWS = "id long, mark long, same long, size int, fingerprint long, bits binary, prefix array<long>"


def _same(sets: list[bytes]) -> pa.Array:
    """What texts with the same shingles share."""
    return pa.array(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in sets), np.uint64, len(sets)).view(np.int64))


def _described(words: int, similarity: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = shared.value
        for part, texts in _texts(batches):
            sets = [shingle_set(t, words) for t in texts]
            first = [prefix(x, frequent, count, similarity) for x in sets]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in first])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first).view(np.int64)))
            prints = np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)
            columns = [part.column(0), part.column(2), _same([x.tobytes() for x in sets]), pa.array([len(x) for x in sets], pa.int32()), pa.array(prints), pa.array(map(bitmap, sets), pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROWS.split(", ")])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, in parts that end where its value changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last value may go on in the next batch
        if cut or (held and held[-1][0][-1] != now[0][0]):
            if not cut and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            else:
                yield [np.concatenate(c) for c in zip(*held, [x[:cut] for x in now], strict=True)]
                held = []
        held.append([x[cut:] for x in now])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return first, np.diff(np.append(first, len(key)))


_POSTINGS = "shingle long, same long, size int, place int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the shingles that more than one text has."""
    for columns in _groups(batches):
        _, count = _bounds(columns[0])
        keep = np.repeat(count > 1, count)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["shingle", "same", "size", "place"])


class _Forest:
    """Which texts a task has linked for the time being."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def joins(self, a: int, b: int) -> bool:
        """Links two texts; whether that joins what wasn't joined."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x


def _listed(first: np.ndarray, count: np.ndarray, listed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in buckets of up to ``listed`` members, in blocks."""
    for n in range(2, listed + 1):
        begins = first[count == n]
        x, y = np.triu_indices(n, 1)
        step = max(1, BLOCK // len(x))
        for k in range(0, len(begins), step):
            at = begins[k : k + step, None]
            yield (at + x).ravel(), (at + y).ravel()


def _large(size: np.ndarray, place: np.ndarray, root: np.ndarray, bits: np.ndarray, similarity: float, spanning: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one bucket that may be similar and aren't of one root; with ``spanning``, only such as join roots."""
    by = np.argsort(size, kind="stable")
    s, p, root = size[by], place[by], np.unique(root[by], return_inverse=True)[1]
    wide = np.fromiter(map(len, bits[by]), np.int64, len(by)) // 8
    tables = {}
    last = np.searchsorted(s, s / similarity + _EPS, "right")
    for i in range(len(by) - 1):
        j = np.flatnonzero(root[i + 1 : last[i]] != root[i]) + i + 1
        j = j[may_be_similar(s[j], p[j], s[i], p[i], similarity)]
        if len(j):
            if (w := int(wide[i])) not in tables:  # a similar text has as many bits, or twice as many
                table = np.zeros((len(by), w), np.uint64)
                for v in (w, 2 * w):
                    if (wide == v).any():
                        table[wide == v] = _words(bits[by][wide == v], w)
                tables = {w: table}
            j = j[np.bitwise_count(tables[w][j] ^ tables[w][i]).sum(1) <= most_differing(s[j], s[i], similarity)]
        if len(j) and spanning:
            roots, once = np.unique(root[j], return_index=True)
            root[np.isin(root, roots)] = root[i]
            j = j[once]
        if len(j):
            yield np.full(len(j), by[i]), by[j]


def _meet(similarity: float, spanning: bool, listed: int):
    """Pairs of texts that meet in a bucket, may be similar and have different roots.

    With ``spanning`` a task passes over pairs that others of its pairs join already; without, none is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def out(x, y):
            if spanning:
                keep = np.fromiter((forest.joins(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
                x, y = x[keep], y[keep]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

        for shingle, same, size, place, root, bits in _groups(batches):
            first, count = _bounds(shingle)
            for x, y in _listed(first, count, listed):
                some = (root[x] != root[y]) & may_be_similar(size[x], place[x], size[y], place[y], similarity)
                x, y = x[some], y[some]
                some = differing_bits(bits[x], bits[y]) <= most_differing(size[x], size[y], similarity)
                yield out(same[x[some]], same[y[some]])
            for k in np.flatnonzero(count > listed).tolist():
                own, held, n = slice(first[k], first[k] + count[k]), [], 0
                for x, y in _large(size[own], place[own], root[own], bits[own], similarity, spanning):
                    held.append((same[own][x], same[own][y]))
                    n += len(x)
                    if n > BLOCK:
                        yield out(*map(np.concatenate, zip(*held, strict=True)))
                        held, n = [], 0
                if held:
                    yield out(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _asked_sets(words: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False)
            asked = batch.filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1))
            for _, texts in _texts([asked]):
                sets = [shingle_set(t, words).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([_same(sets), pa.array(sets, pa.binary())], names=["same", "shingles"])

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(alike, pa.bool_()))

    return run


def frequent_shingles(docs: DataFrame, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a share of the rows ``(id, text)``, ascending, and their counts there."""
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(tidy(_each_shingle(words)), "shingle long")
    found = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toArrow()
    shingle, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def fingerprint_stars(texts: DataFrame, radius: int = 2) -> DataFrame:
    """``(x, y)``, x < y: of ``(same, fingerprint)``, each text with one of the texts whose fingerprints links reach."""
    distinct = materialise(texts.groupBy("fingerprint").agg(F.min("same").alias("least")), "similar-prints")
    up = connected_components(ball_links(distinct, radius), "a", "b")
    rooted = materialise(distinct.join(up, F.col("fingerprint") == F.col("node"), "left").select(F.col("fingerprint").alias("of"), "least", F.coalesce("parent", "fingerprint").alias("root")), "similar-print-roots")
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"))
    named = materialise(rooted.join(heads, "root").select("of", "head"), "similar-print-heads")
    return texts.join(named, F.col("fingerprint") == F.col("of")).where(F.col("same") != F.col("head")).select(F.least("same", "head").alias("x"), F.greatest("same", "head").alias("y"))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Every row as ``(id, mark, same)`` with a mark of its text, and ``(same, first_id, root)``: texts with the same shingles are one, those of a component have one root."""
    context = docs.sparkSession.sparkContext
    used = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.col(text_col).alias("text"), text_mark(text_col).alias("mark"))
    frequent = context.broadcast(frequent_shingles(used.select("id", "text"), words))  # bounded
    rows = materialise(used.mapInArrow(tidy(_described(words, similarity, frequent)), _ROWS), "similar-rows")
    texts = materialise(rows.groupBy("same").agg(F.min("id").alias("first_id"), F.first("fingerprint").alias("fingerprint"), F.first("bits").alias("bits")), "similar-classes")
    # One row stands for all with the same shingles: the one with the smallest id, or any of those that repeat it.
    known = rows.join(texts.select(F.col("same").alias("of"), "first_id").hint("merge"), (F.col("same") == F.col("of")) & (F.col("id") == F.col("first_id")), "left_semi").dropDuplicates(["same"])
    by_shingle = lambda table: table.repartition("shingle").sortWithinPartitions("shingle")
    postings = known.select("same", "size", F.posexplode("prefix").alias("place", "shingle")).select("shingle", "same", "size", "place")
    shared = materialise(by_shingle(postings).mapInArrow(tidy(_shared), _POSTINGS), "similar-shared")
    mapped = texts.select(F.col("same").alias("of"), "bits").hint("merge")

    def meeting(up: DataFrame | None) -> DataFrame:
        """The pairs that meet; with ``up``, all that aren't of one component of it."""
        root = F.col("same") if up is None else F.coalesce("parent", "same")
        rooted = shared if up is None else shared.join(up.hint("merge"), F.col("same") == F.col("node"), "left")
        held = rooted.withColumn("root", root).join(mapped, F.col("same") == F.col("of")).select("shingle", "same", "size", "place", "root", "bits")
        return by_shingle(held).mapInArrow(tidy(_meet(similarity, up is None, LISTED)), "x long, y long").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar. Only their texts are read again; a table of bits of fixed size passes over nearly all others."""
        asked = texts.join(pairs.select(F.explode(F.array("x", "y")).alias("of")).distinct().hint("merge"), F.col("same") == F.col("of"), "left_semi")
        place = F.pmod(F.xxhash64(F.col("first_id")), F.lit(ASKED_BITS))
        found = asked.select(place.alias("h")).groupBy(F.expr("h div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("b")).toArrow()
        bits = np.zeros(ASKED_BITS // 64, np.int64)
        bits[found.column("w").to_numpy()] = found.column("b").to_numpy()
        again = used.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(ASKED_BITS)).alias("h"))
        sets = materialise(again.mapInArrow(tidy(_asked_sets(words, context.broadcast(bits))), "same long, shingles binary").dropDuplicates(["same"]), "similar-sets")
        # What grows with the documents isn't broadcast, whatever its size just now.
        both = pairs.join(sets.select(F.col("same").alias("x"), F.col("shingles").alias("sx")).hint("merge"), "x").join(sets.select(F.col("same").alias("y"), F.col("shingles").alias("sy")).hint("merge"), "y")
        links = materialise(both.select("x", "y", "sx", "sy").mapInArrow(tidy(_verify(similarity)), "x long, y long"), "similar-links")
        drop_table(sets)
        return links

    first = materialise(fingerprint_stars(texts).unionByName(meeting(None)).distinct(), "similar-first")
    up = connected_components(verified(first), "x", "y")
    others = materialise(meeting(up).join(first.hint("merge"), ["x", "y"], "left_anti"), "similar-others")
    if not others.isEmpty():
        more = verified(others)
        up = connected_components(up.select(F.col("node").alias("x"), F.col("parent").alias("y")).unionByName(more), "x", "y")
    rooted = texts.join(up, F.col("same") == F.col("node"), "left").select(F.col("same").alias("known"), "first_id", F.coalesce("parent", "same").alias("root"))
    return rows.select("id", "mark", "same"), materialise(rooted, "similar-rooted")


def text_mark(text_col: str) -> F.Column:
    """64 bits that tell the texts under one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id, component_id)`` for every row: components of texts whose shingles have this similarity, named by the smallest id.

    Texts with the same shingles are one text here, texts without words among them. First a spanning choice of the pairs that meet is compared,
    then every other pair that no links connect: no pair of this similarity is lost. Rows without an id count as id -1; no rows give no rows.
    """
    rows, rooted = _classes(docs, id_col, text_col, words, similarity)
    named = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "similar-named")
    classes = rooted.join(named, "root").select("known", "component_id")
    return rows.join(classes, F.col("same") == F.col("known"), "left").select("id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when of each group of near copies the row with the smallest id does.

    Groups are of rows, not of ids: different texts under one id are each judged by their own group, and of several texts under the smallest id of a
    group one stays. Of rows that repeat in id and text one stays. Rows without an id all stay; no rows give no rows; columns may have any names.
    """
    rows, rooted = _classes(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words, similarity)
    each = rows.join(rooted.select("known", "root"), F.col("same") == F.col("known")).groupBy("root")
    kept = materialise(each.agg(F.min(F.struct("id", "mark")).alias("k")).select("k.*"), "near-kept")
    # Rows travel as one column, so that their names can't clash with those here.
    tagged = docs.where(F.col(id_col).isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), text_mark(text_col).alias("mark"))
    if not rows.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        tagged = tagged.dropDuplicates(["id", "mark"])  # map tasks collapse what they hold
    # Both sides grow with the documents: neither may be broadcast, whatever its size just now.
    stays = tagged.join(kept.hint("merge"), ["id", "mark"], "left_semi").select("row.*")
    return stays.unionByName(docs.where(F.col(id_col).isNull()))


def fingerprint_hex(column: str) -> F.Column:
    """16 lowercase hex digits of a signed long's 64 bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), fingerprint_hex("fingerprint").alias("fingerprint"), "component_id")
