import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from gridloom.llm import exact_dedup, simhash_dedup
from gridloom.llm.components import connected_components


def brute_simhash(text, words=3):
    parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(items, linked):
    up = {i: i for i in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(items)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(items[a], items[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in items}


def test_fingerprints_and_components_equal_brute_force(docs, rows):
    found = {r["id"]: r for r in simhash_dedup.near_duplicates(docs).collect()}
    prints = {r["doc_id"]: brute_simhash(r["text"]) for r in rows}
    assert {i: r["fingerprint"] % (1 << 64) for i, r in found.items()} == prints
    want = brute_groups(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert {i: r["component_id"] for i, r in found.items()} == want


@pytest.mark.parametrize("radius", [2, 4])
def test_ball_links_lose_no_connection(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**63), 2**63, 20)
    values = {int(b ^ sum(1 << int(k) for k in rng.choice(16, rng.integers(0, radius + 1), False))) for b in base for _ in range(8)} | {0, 1, -1, -(2**63)}
    table = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    links = [(r["a"], r["b"]) for r in simhash_dedup.ball_links(table, radius).collect()]
    near = lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= radius
    assert all(a < b and near(a, b) for a, b in links) and len(set(links)) == len(links)
    pairs = set(links)
    assert brute_groups({v: v for v in values}, near) == brute_groups({v: v for v in values}, lambda a, b: (min(a, b), max(a, b)) in pairs)


def test_components_of_chains_stars_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1400)] + [(2000 - k, 2000) for k in range(1, 50)] + [(5, 5), (None, 3), (70, 70), (3000, 2999), (2999, 3000)]
    found = {r["node"]: r["parent"] for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert found == {**dict.fromkeys(range(1, 61), 0), **dict.fromkeys(range(1001, 1400), 1000), **dict.fromkeys(range(1952, 2001), 1951), 3000: 2999}


def test_simhash_edges(edge, empty):
    found = simhash_dedup.near_duplicates(edge).collect()
    assert len(found) == 13
    by = defaultdict(set)
    for r in found:
        by[r["id"]].add((r["fingerprint"], r["component_id"]))
    assert by[2] == by[3] == by[4] == {(0, 2)}
    assert by[9] == by[10] and next(iter(by[9]))[1] == 9
    assert by[1] == by[5]
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(10):  # one word of 200 changed: five of 196 shingles
        parts = base[i].split()
        parts[50 + i] = "changed"
        rows.append((100 + i, " ".join(parts)))
    rows += [(200, base[0]), (200, base[0]), (None, base[1]), (300, None), (301, "")]
    kept = Counter(r["doc_id"] for r in simhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == Counter([*range(30), 300, None])


def test_near_copies_are_judged_by_row_and_not_by_id(spark):
    words = [f"w{k}" for k in range(400)]
    a, b = " ".join(words[:200]), " ".join(words[200:])
    copy = a.replace("w50 ", "changed ")
    kept = lambda rows: Counter((r["doc_id"], r["text"]) for r in simhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept([(1, a), (1, b)]) == Counter([(1, a), (1, b)])
    assert kept([(3, a), (5, copy), (5, b)]) == Counter([(3, a), (5, b)])
    assert kept([(5, copy), (5, b), (5, b), (7, a), (8, b)]) == Counter([(5, copy), (5, b)])
    assert sum(kept([(5, copy), (5, a)]).values()) == 1


def test_bitmaps_never_differ_in_more_bits_than_texts_in_shingles():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 2, 30, 33, 60, 140, 600, 1500, 3000)]
    sets += [np.unique(np.concatenate([x[: len(x) - len(x) // 9], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for x in sets for k in (0, 3, 40)]
    maps = np.array([simhash_dedup.bitmap(x) for x in sets], object)
    x, y = np.triu_indices(len(sets), 1)
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)])
    assert (simhash_dedup.differing_bits(maps[x], maps[y]) <= apart).all()


@pytest.mark.parametrize("listed", [1, 32])
def test_large_buckets_of_near_copies_equal_brute_force(spark, listed, monkeypatch):
    """Copies of one text at 0.4 to 1, which share nearly all buckets, by the paths for small and for large buckets."""
    monkeypatch.setattr(simhash_dedup, "LISTED", listed)
    rng = np.random.default_rng(15)
    base = [f"g{k}" for k in range(120)]
    texts = []
    for k in range(160):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    right, linked = similar_to_brute_force(spark, texts)
    assert right and linked > 400


def test_similar_groups_equal_brute_force(docs, rows):
    found = {r["id"]: r["component_id"] for r in simhash_dedup.similar_groups(docs).collect()}
    sets = {r["doc_id"]: frozenset(simhash_dedup.shingle_hashes((r["text"] or "").encode(), 5).tolist()) for r in rows}
    alike = lambda a, b: (len(a & b) >= 0.8 * len(a | b)) if a and b else a == b
    assert found == brute_groups(sets, alike)


def test_near_edges(edge, empty):
    kept = Counter(r["doc_id"] for r in simhash_dedup.drop_near_duplicates(edge).collect())
    assert kept == Counter([1, 2, 6, 7, 8, 9, None, None])
    out = simhash_dedup.drop_near_duplicates(empty)
    assert out.count() == 0 and out.columns == empty.columns


def brute_exact(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = {}
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            i = rows[m[3]][0]
            out.setdefault((i, m[3]), (rows[best[3]][0], len(members), m[3] == best[3], hashlib.sha256(norm.encode()).hexdigest()))
    return Counter((i, *v) for (i, _), v in out.items())


@pytest.mark.parametrize("capacity", [1 << 13, 7, 1])
def test_exact_duplicates_equal_brute_force(docs, rows, capacity):
    found = exact_dedup.exact_duplicates(docs, capacity=capacity).collect()
    got = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["sha"]).hex()) for r in found)
    assert got == brute_exact([(r["doc_id"], r["text"]) for r in rows])


def test_exact_edges(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["sha"]).hex()) for r in exact_dedup.exact_duplicates(edge).collect())
    assert got == brute_exact(rows)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(edge)
    assert kept.columns == edge.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([4, 5, 6, 7, 8, 9, None])


def test_equal_texts_that_share_an_id_or_lack_one(spark):
    kept = lambda rows: Counter((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept([(1, "a b c"), (1, "ab c"), (None, "q  r"), (None, "qr")]) == Counter([(1, "a b c"), (None, "q  r")])
    assert sum(kept([(1, "a bc"), (1, "ab c"), (1, "a bc")]).values()) == 1
    assert kept([(2, "x y"), (2, "z"), (1, "xy")]) == Counter([(2, "x y"), (2, "z")])


def test_hot_keys_are_merged_before_their_owner(spark):
    rows = [(k, "the hot text" if k % 3 else f"text {k}") for k in range(600)] + [(600 + k, "the hottext ") for k in range(50)]
    used = spark.createDataFrame(rows, "id long, text string").repartition(8)
    keys = used.mapInArrow(exact_dedup._keys, "id long, chars long, key long, sha binary")
    cold, hot = ({(r["key"], bytes(r["sha"]), r["rows"], r["keep_chars"], r["keep_id"], r["same"]) for r in exact_dedup.build_index(used, keys, 64, n).collect()} for n in (10_000, 100))
    assert cold == hot and len(hot) == 201


def test_directory_doubles_until_buckets_fit(spark):
    rng = np.random.default_rng(0)
    keys = np.concatenate([rng.integers(-(2**63), 2**63, 3000), -(2**63) + rng.integers(0, 1 << 20, 500)])
    table = spark.createDataFrame([(int(k),) for k in keys], "key long")
    starts = exact_dedup.extendible_directory(table, 40)
    counts = np.bincount(np.searchsorted(np.array(starts, np.uint64), (np.unique(keys).astype(object) + 2**63).astype(np.uint64), "right") - 1)
    assert starts[0] == 0 and counts.max() <= 40 and len(starts) > 80
    assert exact_dedup.extendible_directory(table.limit(0)) == [0]


def test_colliding_keys_are_chained_by_bytes():
    import pyarrow as pa

    rows = [(0, 5, b"x", 2, -3, 7, 1), (0, 5, b"y", 1, -1, 2, 1), (0, 5, b"x", 3, -9, 8, 1), (1, 6, b"x", 1, -1, 4, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), exact_dedup._HEADS, strict=True)], schema=exact_dedup._HEADS)
    out = [tuple(r[k] for k in ("bucket", "key", "chain", "rows", "keep_chars", "keep_id")) for b in exact_dedup._own(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert out == [(0, 5, 0, 5, 9, 8), (0, 5, 1, 1, 1, 2), (1, 6, 0, 1, 1, 4)]


def similar_to_brute_force(spark, texts):
    """Whether the groups are those of all pairs; also how many pairs are linked."""
    sets = {i: frozenset(simhash_dedup.shingle_hashes(t.encode(), 5).tolist()) for i, t in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = {r["id"]: r["component_id"] for r in simhash_dedup.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return found == brute_groups(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b)), len(pairs)


def test_near_copies_among_texts_that_share_a_passage(spark):
    """Unrelated texts at 0.75 that meet in every bucket; copies of some of them at 0.9."""
    rng = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(400)]
    own = [[f"o{k}" for k in rng.integers(0, 1 << 30, 65)] for _ in range(300)]
    near = [x[:-24] + [f"c{k}" for k in rng.integers(0, 1 << 30, 24)] for x in own[:60]]
    right, linked = similar_to_brute_force(spark, [" ".join(passage + x) for x in own + near])
    assert right and linked == 60


def test_block_edits_are_met(spark):
    """Copies with text appended, cut off or replaced, at 0.8 to 0.9."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"b{k}" for k in rng.integers(0, 1 << 30, n)]
    texts = []
    for k in range(180):
        base, part = fresh(200), (0.805, 0.81, 0.85, 0.9)[k % 4]
        n = int(200 * (1 / part - 1))
        cut = int(200 * (1 - part)) - 1
        block = int(196 * (1 - part) / (1 + part)) - 5
        texts += [base, (base + fresh(n - 1), base[:-cut], base[:60] + fresh(block) + base[60 + block :])[k % 3]]
    right, linked = similar_to_brute_force(spark, [" ".join(x) for x in texts])
    assert right and linked == 180


def test_long_texts_are_compared_by_all_shingles(spark):
    rng = np.random.default_rng(13)
    fresh = lambda n: [f"l{k}" for k in rng.integers(0, 1 << 30, n)]
    texts = []
    for k in range(80):  # at 0.79 and 0.81
        base = fresh(1500)
        texts += [base, base + fresh(int(1496 * (1 / (0.79, 0.81)[k % 2] - 1)))]
    right, linked = similar_to_brute_force(spark, [" ".join(x) for x in texts])
    assert right and linked == 40
