import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import mixing, packing
from gridloom.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
REFERENCE = Tokenizer.from_file(PATH)


def brute_targets(sizes, weights=(3.0, 1.0, 2.0)):
    """Water-filling by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        full = {s for s in free if target[s] + left * w[s] / total >= 2 * sizes[s] - 1e-9}
        if not full:
            for s in free:
                target[s] += left * w[s] / total
            break
        for s in full:
            left -= 2 * sizes[s] - target[s]
            target[s] = 2.0 * sizes[s]
        free -= full
    return target


def check_mix(mixed, texts, tolerance):
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows) for s, rows in texts.items()}
    want = brute_targets(size)
    by = defaultdict(list)
    for r in mixed:
        assert r["copies"] in (0, 1, 2) and (r["size"] > 0 or r["copies"] == 0)
        by[r["source_size"], round(r["target"], 6)].append(r["size"] * r["copies"])
    assert len(mixed) == sum(map(len, texts.values()))
    for (words, target), taken in by.items():
        assert any(abs(target - t) < 1e-5 for t in want.values())
        number = sum(size[s] == words and abs(target - t) < 1e-5 for s, t in want.items())
        assert abs(sum(taken) - number * target) <= tolerance


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["source"]].append((r["doc_id"], r["text"]))
    return out


@pytest.mark.parametrize("fan_in", [128, 3])
def test_mix_meets_its_targets(docs, rows, fan_in):
    mixed = mixing.mix_sources(docs, fan_in=fan_in).collect()
    check_mix(mixed, by_source(rows), 400)
    again = mixing.mix_sources(docs.repartition(3), fan_in=fan_in).collect()
    assert Counter(map(tuple, mixed)) == Counter(map(tuple, again))


def test_mix_with_a_hot_source(spark):
    rng = np.random.default_rng(1)
    data = [(k, "w " * int(n), "hot" if k % 3 else f"s{k % 30}") for k, n in enumerate(rng.integers(1, 40, 3000))] + [(9000, "x " * 5000, "hot")]
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    check_mix(mixing.mix_sources(table).collect(), by_source([dict(zip(("doc_id", "text", "source"), r, strict=True)) for r in data]), 60)


def test_mix_edges(edge, empty, spark):
    mixed = mixing.mix_sources(edge).collect()
    check_mix(mixed, by_source([r.asDict() for r in edge.collect()]), 30_001)
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).select("target", "copies").distinct().collect() == [(0.0, 0)]
    taken = mixing.take_copies(edge)
    assert taken.columns == edge.columns
    want = Counter()
    for r in mixed:
        want[r["id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in taken.collect())
    assert got == +want and mixing.take_copies(empty).count() == 0


def test_repeated_rows_are_rounded_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD", 100)
    data = [(7, "one and the same row", "a")] * 900 + [(None, "no id", "b")] * 300 + [(k, "w " * (k % 9 + 1), "c") for k in range(400)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(table).collect()
    check_mix(mixed, by_source([dict(zip(("doc_id", "text", "source"), r, strict=True)) for r in data]), 60)
    again = mixing.mix_sources(table.repartition(7)).collect()
    assert Counter(map(tuple, mixed)) == Counter(map(tuple, again))
    want, got = Counter(), Counter((r["doc_id"], len(r["text"].split())) for r in mixing.take_copies(table).collect())
    for r in mixed:
        want[r["id"], r["size"]] += r["copies"]
    assert got == +want


def test_rounding_is_unbiased(spark):
    """Over many ids a fraction of 0.3 is taken about three times of ten."""
    rows = spark.range(6000).select(F.lit(1).alias("source_no"), F.col("id"), F.lit(0).cast("long").alias("mark"), F.xxhash64("id").alias("h"), (F.col("id") % 9 + 1).alias("w")).withColumn("x", F.rint(F.col("w") * mixing.UNITS * 0.3).cast("long")).withColumn("bucket", F.pmod("h", F.lit(47)))
    decided, last = mixing.pivotal_rounding(rows, 47)
    ones = decided.groupBy("w").agg(F.avg(F.col("one").cast("double")).alias("p"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in ones) + last.count() == 6000 and last.count() <= 1
    assert all(abs(r["p"] - 0.3) < 0.08 for r in ones)


def ids_of(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


TRICKY = ["", " ", "it's don't I'LL O'Neil's.", "x<|endoftext|>y <|ENDOFTEXT|>", "H̱a É. ΑΣ. ΑΣ", "12,345.67 é. a\x0bb !?!? )( 'S. it's,", "Ünï|cödé 字|| 🎉!! ́a .. a.́"]


def test_word_tokenizer_equals_the_tokenizer(rows):
    texts = [r["text"] for r in rows] + TRICKY + [None]
    for kept in (1 << 20, 10):
        words = WordTokenizer(PATH, kept)
        for batch in (pa.array(texts[:90]), pa.array(texts).slice(90)):
            ids, begins = words.encode(batch)
            assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == [ids_of(t) for t in batch.to_pylist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_word_tokenizer_on_any_text(texts):
    ids, begins = WordTokenizer(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == [ids_of(t) for t in texts]


def check_pack(found, rows, length):
    """A round trip: pieces give back every document's ids, and sequences are gapless."""
    want = Counter()
    for i, t in rows:
        own = np.array([*ids_of(t), 1], "<u4")
        for p, a in enumerate(range(0, len(own), length)):
            want[i, p, a, len(own[a : a + length]), crc32(own[a : a + length].tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), -(-sum(r["length"] for r in found) // length)


@pytest.mark.parametrize(("length", "block"), [(4096, 1 << 14), (256, 60)])
def test_packing_round_trip(docs, rows, length, block):
    found = packing.pack_documents(docs, PATH, length=length, block=block).collect()
    bins, least = check_pack(found, [(r["doc_id"], r["text"]) for r in rows], length)
    assert bins <= 1.03 * least + 2


def test_packing_edges(edge, empty, spark):
    found = packing.pack_documents(edge, PATH).collect()
    check_pack(found, [(r["doc_id"], r["text"]) for r in edge.collect()], 4096)
    assert packing.pack_documents(empty, PATH).count() == 0
    same = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a " * 170).alias("text"))
    bins, _ = check_pack(packing.pack_documents(same, PATH, length=256, block=10).collect(), [(k, "a " * 170) for k in range(100)], 256)
    assert bins == 100  # none fits with another, and open sequences are not dealt for ever


def brute_sum_of_squares(sizes, length):
    gaps, out = [], []
    for s in sizes:
        choices = []
        for k, g in enumerate([*gaps, None]):
            now = Counter(x for x in gaps if x)
            left = (length if g is None else g) - s
            if left < 0:
                continue
            if g:
                now[g] -= 1
            if left:
                now[left] += 1
            choices.append((sum(v * v for v in now.values()), g is None, left, k))
        _, new, left, k = min(choices)
        gaps[k : k + 1] = [left]
        out.append(sorted(gaps))
    return out[-1] if out else []


def test_sum_of_squares_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(25):
        sizes = rng.integers(1, 20, 30)
        _, _, gaps = packing.sum_of_squares(sizes, 20)
        assert sorted(gaps.tolist()) == brute_sum_of_squares(sizes.tolist(), 20)
