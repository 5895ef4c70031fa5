import importlib.util
import itertools
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import dedup, grid, metrics, sampling, sweep
from gridloom.sources import images
from gridloom.sources.store import materialise
from gridloom.streaming import frames


@pytest.mark.parametrize("g", [64, 9, 8, 7, 5, 3, 2, 1])
def test_stencils_equal_numpy(spark, g):
    rng = np.random.default_rng(g)
    v = rng.uniform(0, 255, (g, g)).astype(np.float32)
    row = grid.context(spark.createDataFrame([(1, g, v.ravel().tolist())], "image_id int, g int, v array<float>")).first()
    at = lambda name: np.array(row[name], np.float32).reshape(g, g)

    def box(k):
        p = np.pad(v.astype(float), k // 2, mode="symmetric")
        return np.lib.stride_tricks.sliding_window_view(p, (k, k)).mean((2, 3))

    def spread(k):
        p = np.pad(v, k // 2, constant_values=np.nan)
        w = np.lib.stride_tricks.sliding_window_view(p, (k, k))
        return np.nanmax(w, (2, 3)) - np.nanmin(w, (2, 3))

    zero = np.zeros((g, g))
    assert at("ctx_surr3") == pytest.approx(v - box(3) if g >= 3 else zero, abs=1e-4)
    assert at("ctx_ring35") == pytest.approx(box(5) - box(3) if g >= 3 else zero, abs=1e-4)
    assert (at("ctx_range3") == (spread(3) if g >= 3 else zero)).all()
    assert at("ctx_surr9") == pytest.approx(v - box(9) if g >= 5 else zero, abs=1e-4)
    assert (at("ctx_range5") == (spread(5) if g >= 5 else zero)).all()
    axis = (np.arange(g) / (g - 1) - 0.5) if g >= 3 else np.zeros(g)
    assert at("ctx_x") == pytest.approx(np.tile(axis, (g, 1)), abs=1e-6) and at("ctx_y").T == pytest.approx(np.tile(axis, (g, 1)), abs=1e-6)


def test_coverage_with_fractions_of_pixels(spark):
    v = np.random.default_rng(0).integers(0, 256, (10, 7))
    rows = [(1, r, c, int(v[r, c])) for r in range(10) for c in range(7)]
    found = {r["cell"]: r["cov"] for r in grid.coverage(spark.createDataFrame(rows, "image_id int, r int, c int, v int"), 10, 7, 4).collect()}
    fine = np.kron(v, np.ones((4, 4))).reshape(4, 10, 4, 7).mean((1, 3)) / 255
    assert [found[k] for k in range(16)] == pytest.approx(fine.ravel().tolist(), abs=1e-6)


#: Height, width, and the sizes that the policies give.
THUMBS = [((720, 1280), (512, 512), (320, 512)), ((1080, 1920), (1024, 1024), (576, 1024)), ((1440, 2560), (1024, 1024), (576, 1024)), ((2160, 3840), (2048, 2048), (1152, 2048)), ((300, 500), (256, 256), (128, 256)), ((160, 160), (128, 128), (128, 128)), ((96, 200), (64, 64), (64, 64)), ((40, 50), (64, 64), (64, 64)), ((1000, 30), (64, 64), (64, 64)), ((60, 2000), (64, 64), (64, 64))]


def test_thumbnails(spark):
    rows = spark.createDataFrame([s for s, _, _ in THUMBS], "h int, w int")
    found = rows.select("h", "w", *(scalars.thumb_size(F.col("h"), F.col("w"), p).alias(p) for p in ("pow2", "pow2-fit"))).collect()
    assert {((r["h"], r["w"]), tuple(r["pow2"]), tuple(r["pow2-fit"])) for r in found} == set(THUMBS)


def test_names_and_parsers():
    assert scalars.parse_levels("8,64, 16") == (64, 16, 8) and scalars.exponent_of(64) == 6
    assert scalars.parse_scales("512:2;1024") == [(512, 2, "512px/s2"), (1024, 4, "1024px/s4")] and scalars.parse_scales(None) == []
    names = scalars.column_names((64, 8), "hs", ("mean", "var"), "raw_plus_global_context_ext", ("a",), ("512px/s2",))
    assert len(names) == 2 * (8 + 7) + 1 and names[:3] == ["64/h/mean", "64/h/var", "64/s/mean"]
    assert [scalars.level_of(n) for n in ("8/h/mean", "64@512px/s2/h/var", "64/global/a")] == [(8, 6), (64, 0), (1, 12)]
    for bad in ("48", "", "128"):
        with pytest.raises(ValueError, match="."):
            scalars.parse_levels(bad)


def test_groups_equal_union_find(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 15)
    h = [int(b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), False))) for b in base for _ in range(6)]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(h)] + [(500, None), (501, h[0])], "id long, h long")
    pairs = lambda f: {(r["a"], r["b"], r["d"]) for r in f(table.where("h is not null"), "id", "h", 8).collect()}
    found = pairs(dedup.hamming_pairs)
    assert found == pairs(dedup.theta_pairs) and (0, 501, 0) in found
    up = {r["id"]: r["id"] for r in table.collect()}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b, _ in found:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    heads = sorted({root(x) for x in up})
    groups = {r["id"]: r["group_id"] for r in dedup.near_duplicate_groups(table, "id", "h", 8).collect()}
    assert groups == {x: heads.index(root(x)) for x in up}


@pytest.mark.parametrize(("most", "rows"), [(4, 2000), (8, 2000), (8, 10**9)])
def test_few_pairs_meet_by_bands(most, rows):
    parts, size = dedup.band_plan(most, rows)
    assert sum(m.bit_length() for _, m in parts) == 64 and len(parts) - size == most
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 2**64, 200_000, dtype=np.uint64) for _ in "xy")
    agreed = sum(((((x ^ y) >> np.uint64(s)) & np.uint64(m)) == 0).astype(int) for s, m in parts)
    assert (agreed >= size).mean() < 0.01


@pytest.mark.parametrize("most", [3, 8, 12])
def test_pairs_of_popular_values_equal_all_with_all(spark, monkeypatch, most):
    rng = np.random.default_rng(most)
    base = [0, -1, -(2**63), *rng.integers(-(2**63), 2**63, 4).tolist()]
    h = [b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 9), False)) for b in base for _ in range(60)]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(h)] + [(-5, h[0]), (None, h[1]), (900, None), (7, h[9])], "id long, h long").repartition(5)
    pairs = lambda f: sorted((r["a"], r["b"], r["d"]) for r in f(table, "id", "h", most).collect())
    want = pairs(dedup.theta_pairs)
    assert pairs(dedup.hamming_pairs) == want
    # Values of more hashes than a block, and several buckets.
    for name, n in (("BLOCK", 16), ("BUCKET", 64), ("SHORT", 4), ("CELLS", 100)):
        monkeypatch.setattr(dedup, name, n)
    written = []
    monkeypatch.setattr(dedup, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    assert pairs(dedup.hamming_pairs) == want and "hashes-met-blocks" in written


def test_hashes_are_dealt_in_rows_of_many(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(dedup, "materialise", lambda df, name: written.setdefault(name, materialise(df, name)))
    table = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    found = dedup.hamming_pairs(table.unionByName(table.selectExpr("id + 100000 as id", "h ^ 255 as h")), "id", "h", 8)
    assert found.where("b = a + 100000 and d = 8").count() == 20_000
    parts, size = dedup.band_plan(8, 40_000, moving=dedup.MOVING)
    keys = [k for k, _ in enumerate(itertools.combinations(range(len(parts)), size))]
    dealt = written["hashes-distinct"].coalesce(1).mapInArrow(dedup._dealer([0] * len(keys), 0), "key int, bucket int, hashes binary").selectExpr("key", "length(hashes) div 8 as n").collect()
    assert len(dealt) <= 3 * len(keys) and sum(r["n"] for r in dealt) == 40_000 * len(keys)


def test_copies_make_no_links_of_groups(spark, monkeypatch):
    table = spark.createDataFrame([(k, (0, 1, 3, -1)[k % 4]) for k in range(160)] + [(500, None), (501, None)], "id long, h long")
    seen, components = [], dedup.components
    monkeypatch.setattr(dedup, "components", lambda nodes, edges, *a: seen.append(edges.count()) or components(nodes, edges, *a))
    groups = {r["id"]: r["group_id"] for r in dedup.near_duplicate_groups(table, "id", "h", 8).collect()}
    assert seen == [3] and groups == {k: int(k % 4 == 3) for k in range(160)} | {500: 2, 501: 3}


def test_pair_search_is_never_a_broadcast(spark):
    table = spark.range(300).select("id", F.xxhash64("id").alias("h"))
    plan = dedup.hamming_pairs(table, "id", "h", 12)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_native_maps_are_checked(spark):
    found = spark.createDataFrame([(1, [1.0] * 4, [2.0]), (2, [1.0] * 4, [2.0, 3.0])], "image_id int, a array<double>, b array<double>")
    assert images.native_maps(found.where("image_id = 1"), {"a": 2, "b": 1}).first()["a"] == [1.0] * 4
    with pytest.raises(ValueError, match="c"):
        images.native_maps(found, {"c": 1})
    with pytest.raises(Exception, match="not 1 cells but 2"):
        images.native_maps(found, {"b": 1}).collect()


def test_grids_of_cells_and_levels_one_behind_another(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3, 8, 8)).astype(np.float32)
    table = spark.createDataFrame([(k, 8, x.ravel().tolist()) for k, x in enumerate(v)], "image_id int, g int, v array<float>")
    native = grid.compose(grid.pyramid(table, (1, 2, 8)), [8, 4, 1])
    assert grid.native_offsets([8, 4, 1]) == [0, 64, 80, 81] and len(native.first()["native"]) == 81
    for r in grid.expand(native, [8, 4, 1], 8).collect():
        row, c, own = r["cell"] // 8, r["cell"] % 8, v[r["image_id"]]
        np.testing.assert_allclose(r["x"], [own[row, c], own[row // 2 * 2 : row // 2 * 2 + 2, c // 2 * 2 : c // 2 * 2 + 2].mean(), own.mean()], rtol=1e-5, atol=1e-6)
    assert len(grid.expand(native, [8, 4, 1], 8, [1]).first()["x"]) == 1
    cells = grid.to_cells(table, "v").where("not (image_id = 1 and cell = 5)")
    back = {r["image_id"]: r["v"] for r in grid.to_grid(cells, "image_id", "cell", "v", 8).collect()}
    assert back[0] == v[0].ravel().tolist() and back[1][5] is None


def test_functions_for_sql(spark):
    from gridloom.functions.sql import FUNCTIONS, register

    assert len(register(spark, "g_")) == len(FUNCTIONS)
    r = spark.sql("SELECT g_hamming(7L, 1L) AS h, g_bin_of(0.5f, array(0.1f, 0.5f, 0.9f)) AS b, g_sigmoid(0D) AS p, g_cell_row(65, 64) AS r, g_leaf_value(3L, 1, -2, 0.5D) AS v").first()
    assert tuple(r) == (2, 1, 0.5, 1, 2.0)


def test_sample_targets_round_half_to_even():
    assert sampling.sample_targets(5, 100, 0.5, None) == (5, 2) and sampling.sample_targets(7, 100, 0.5, None) == (7, 4)
    assert sampling.sample_targets(10, 90, None, 50) == (5, 45) and sampling.sample_targets(3, 0, 5.0, None) == (3, 0)
    assert sampling.sample_targets(10, 90, None, None) == (10, 90)


def test_no_positive_row_is_an_error(spark):
    table = spark.createDataFrame([(1, False)], "k int, y boolean")
    with pytest.raises(ValueError, match="positive"):
        sampling.stratified_sample(table, F.col("k"), "y", None, None, 0)


def test_metric_toys(spark):
    rows = lambda scores: spark.createDataFrame([(k, s, k < 3) for k, s in enumerate(scores)], "id int, s double, y boolean")
    good = metrics.summarise(rows([0.9, 0.8, 0.7, 0.2, 0.1, 0.0]), "s", "y", ["id"])
    assert good["pr_auc"] == good["roc_auc"] == good["f1"] == good["iou"] == 1 and good["threshold"] == 0.7
    assert metrics.roc_auc(rows([0.0, 0.1, 0.2, 0.7, 0.8, 0.9]), "s", "y", ["id"]).first()["roc_auc"] == 0
    tied = metrics.pr_curve(rows([0.5] * 6), "s", "y", ["id"]).sort("k").collect()
    assert [r["precision"] for r in tied] == [1, 1, 1, 3 / 4, 3 / 5, 1 / 2]
    one = rows([0.5] * 2)
    assert metrics.roc_auc(one, "s", "y", ["id"]).first()["roc_auc"] is None
    two = one.withColumn("img", F.lit("a"))
    assert metrics.bootstrap_delta(two, "img", "s", "s", "y", ["id"], 5) is None
    many = rows([0.9, 0.8, 0.7, 0.2, 0.1, 0.0]).withColumn("img", F.col("id") % 3)
    same = metrics.bootstrap_delta(many, "img", "s", "s", "y", ["id"], 5).first()
    assert same["delta_mean"] == same["ci_lo"] == same["ci_hi"] == 0 and same["n_images"] == 3


def test_image_folders(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.tiff", "d.txt"):
        (tmp_path / name).write_bytes(b"no image")
    (tmp_path / "m").mkdir()
    for name in ("B_mask.png", "a_mask.tiff", "A_MASK.png"):
        (tmp_path / "m" / name).write_bytes(b"x")
    files = images.list_images(spark, str(tmp_path))
    assert {r["name"] for r in files.collect()} == {"a.jpg", "b.PNG", "c.tiff"}
    paired = images.pair(files, images.list_images(spark, str(tmp_path / "m")))
    assert {r["image"]: r["mask"] for r in paired.collect()} == {"a.jpg": "A_MASK.png", "b.PNG": "B_mask.png", "c.tiff": None}
    with pytest.raises(ValueError, match="c.tiff"):
        images.require_pairs(paired)
    memo = files.where("name = 'a.jpg'").select(images.memo_key().alias("key"))
    assert {r["name"] for r in images.unhashed(files, memo).collect()} == {"b.PNG", "c.tiff"}
    raw = spark.read.format("binaryFile").load(str(tmp_path / "a.jpg"))
    if importlib.util.find_spec("PIL"):
        assert images.decode(raw).first()["pixels"] is None
    else:
        with pytest.raises(Exception, match="PIL"):
            images.decode(raw).first()
    images.remember(files.where("name = 'a.jpg'").withColumn("hash", F.lit(7).cast("long")), str(tmp_path / "memo"))
    assert {r["name"]: r["hash"] for r in images.memoised(files, spark.read.parquet(str(tmp_path / "memo"))).collect()} == {"a.jpg": 7, "b.PNG": None, "c.tiff": None}
    (tmp_path / "f.f32").write_bytes(np.arange(3, dtype="<f4").tobytes())
    assert images.read_floats(tmp_path / "f.f32", 3).tolist() == [0, 1, 2]
    with pytest.raises(ValueError, match="bytes"):
        images.read_floats(tmp_path / "f.f32", 4)


def test_sweep_resumes(spark, tmp_path):
    calls = []

    def run(overrides):
        calls.append(overrides)
        return {"pr_auc": overrides["depth"] / 10, "f1": 0.5}

    at = str(tmp_path / "runs")
    sweep.run_sweep(spark, {"depth": [3, 5]}, run, at)
    records = sweep.run_sweep(spark, {"depth": [3, 5, 7]}, run, at)
    assert calls == [{"depth": 3}, {"depth": 5}, {"depth": 7}] and records.count() == 3
    assert "| 1 | 7 |" in sweep.report(records)
    named = sweep.keyed(sweep.grid(spark, {"b": [1], "a": ["x y"]})).first()
    assert len(named["key"]) == 12 and named["label"] == "a=x+y,b=1" and sweep.keyed(sweep.grid(spark, {})).first()["label"] == "defaults"
    values = lambda *a: sweep.knob_values(spark, *a)
    assert values("8,16,8", "int") == [8, 16] and values("64/32", "array<int>") == [[64, 32]]
    assert values("none,3,2.5", "double", True) == [None, 3.0, 2.5] and values("false,on", "boolean") == [False, True]
    with pytest.raises(ValueError):
        values("3,x", "int")
    sweep.save_scores(spark.createDataFrame([(1, 0.5)], "id int, p double"), f"{at}-scores", "k1")
    sweep.save_scores(spark.createDataFrame([(2, 0.25)], "id int, p double"), f"{at}-scores", "k2")
    assert [tuple(r) for r in sweep.load_scores(spark, f"{at}-scores", "k2").collect()] == [(2, 0.25)]


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        time.sleep(0.02)
    arriving = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = frames.ema_stream(arriving, "user_id", "event_id", "value").writeStream.outputMode("update").format("memory").queryName("emas").option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("emas").groupBy("user_id").agg(F.max_by("ema", "n").alias("ema"), F.max("n").alias("n")).collect()
    by_user = {}
    for k in range(3):
        for r in sorted(events.where(F.col("event_id") % 3 == k).collect(), key=lambda r: r["event_id"]):
            old = by_user.get(r["user_id"])
            by_user[r["user_id"]] = (r["value"], 1) if old is None else (0.9 * old[0] + 0.1 * r["value"], old[1] + 1)
    assert {r["user_id"]: r["n"] for r in last} == {u: n for u, (_, n) in by_user.items()}
    order_free = Counter(r["n"] for r in last)
    assert sum(k * n for k, n in order_free.items()) == events.count()
    counted = frames.late_tolerant_counts(arriving, "ts", "1 day", "400 days", "event_type")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("window"), "event_type").count().collect()
    assert Counter(map(str, spark.table("counts").select("window", "event_type", "n").collect())) == Counter(str(r).replace("count=", "n=") for r in want)
