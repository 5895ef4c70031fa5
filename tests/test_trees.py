import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boost, trees
from gridloom.plans import training, tune
from gridloom.plans.detector import Detector
from gridloom.queries import _model
from gridloom.sources.config import Config, FrontConfig, load_ranking, select_columns
from gridloom.sources.model_files import ModelFile, decode_trees, encode_trees, from_booster_json, load_borders, read_models, save_borders


def random_model(rng, n_trees=12, depth=3, features=5):
    borders = [sorted({float(np.float32(x)) for x in rng.uniform(0.05, 0.95, rng.integers(2, 12))}) for _ in range(features)]
    splits = [[(int(f), int(rng.integers(len(borders[f])))) for f in rng.integers(0, features, depth)] for _ in range(n_trees)]
    leaves = rng.normal(0, 0.05, (n_trees, 1 << depth)) * np.geomspace(1, 1e-3, n_trees)[:, None]
    return trees.build_ensemble(splits, leaves.tolist(), borders, 4, 4, 8, (0, 0, 4, 12, 12))


def restated(model, x):
    """Raw scores tree by tree, as floats."""
    out = np.zeros(len(x))
    for t in model.trees:
        leaf = np.zeros(len(x), int)
        for d, (f, b) in enumerate(t.splits):
            leaf |= (np.searchsorted(np.array(model.borders[f], np.float32), x[:, f]) > b).astype(int) << d
        out += t.offset + np.array(t.codes)[leaf] * 2.0 ** (model.e_min + t.shift)
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    model, x = random_model(rng), rng.uniform(0, 1, (300, 5)).astype(np.float32)
    x[0, :] = np.nan
    x[1, :] = np.inf
    x[2, :] = -np.inf
    x[3, 0] = model.borders[0][0]
    table = spark.createDataFrame([(k, k // 16, [float(v) for v in r]) for k, r in enumerate(x)], "k int, tile int, x array<float>")
    return model, x, table


def test_sql_and_batches_equal_numpy(scored):
    model, x, table = scored
    binned = table.select("k", "tile", trees.binned("x", model.borders).alias("bins"))
    total = {r["k"]: r["t"] for r in binned.select("k", trees.total_of(model, "bins").alias("t")).collect()}
    want = trees.totals(model, trees.bins_of(model, x))
    assert [total[k] for k in range(len(x))] == want.tolist()
    raw = model.offset_sum + want * 2.0**model.e_min
    assert raw == pytest.approx(restated(model, x))
    batches = {r["k"]: (r["total"], r["probability"]) for r in trees.score_in_batches(table.select("k", "x"), model, "x", ["k"]).collect()}
    assert [batches[k][0] for k in range(len(x))] == want.tolist()
    assert [batches[k][1] for k in range(len(x))] == pytest.approx((1 / (1 + np.exp(-raw))).tolist())


def test_staged_exit(scored):
    """A tile stops only where all its rows score below; kept rows have the full total."""
    model, x, table = scored
    binned = table.select("k", "tile", trees.binned("x", model.borders).alias("bins"))
    part = {r["k"]: r for r in trees.partial_scores(binned, model, "bins", [8, 12]).select("k", "tile", "raw_8", "raw_12").collect()}
    best = {}
    for r in part.values():
        best[r["tile"]] = max(best.get(r["tile"], -9), r["raw_8"])
    cut = float(np.median(list(best.values())))
    staged = trees.staged_scores(binned, model.with_stages([(8, cut)]), "bins", ["tile"], ["k", "tile"]).collect()
    total = trees.totals(model, trees.bins_of(model, x))
    assert {r["alive"] for r in staged} == {True, False}
    for r in staged:
        assert r["alive"] == (best[r["tile"]] >= cut)
        if r["alive"]:
            assert r["total"] == total[r["k"]]


def test_leaf_grid_error_is_half_a_step():
    leaves = np.random.default_rng(1).normal(size=(40, 8)) * np.geomspace(1, 1e-3, 40)[:, None]
    low, exponent, codes = trees.quantise(leaves, 4, 16, (0, 24))
    assert trees.stage_chunks(40, 16, (0, 24)) == [0] * 16 + [1] * 8 + [2] * 16
    error = np.abs(low[:, None] + codes * np.ldexp(1.0, exponent)[:, None] - leaves)
    assert (error <= np.ldexp(0.5, exponent)[:, None] + 1e-6).all()
    again = trees.quantise(low[:, None].astype(float) + codes * np.ldexp(1.0, exponent)[:, None], 4, 16, (0, 24))
    assert (again[2] == codes).all()
    assert trees.quantise(np.ones((2, 2)), 4, 16)[1].tolist() == [-60, -60]


def test_padding_and_sums():
    assert trees.pad_leaves([-1, 2], 3) == [-1, 2] * 4
    with pytest.raises(ValueError, match="leaves"):
        trees.pad_leaves([1, 2, 3], 3)
    with pytest.raises(ValueError, match="constant"):
        trees.build_ensemble([[]], [[1.0]], [[0.5]])
    rng = np.random.default_rng(8)
    a = random_model(rng)
    x = rng.uniform(0, 1, (50, 5)).astype(np.float32)
    assert restated(trees.sum_models([a, a]), x) == pytest.approx(2 * restated(a, x))


def test_hand_computed_model(spark):
    model = trees.build_ensemble([[(0, 0)]], [[-1.0, 2.0]], [[0.5]])
    out = trees.score_in_batches(spark.createDataFrame([(0, [0.0]), (1, [1.0])], "k int, x array<float>"), model, "x", ["k"]).collect()
    assert {r["k"]: r["probability"] for r in out} == pytest.approx({0: 1 / (1 + math.e), 1: 1 / (1 + math.exp(-2.0))}, abs=0.02)


def test_model_file_round_trip(tmp_path):
    for model in (_model(), random_model(np.random.default_rng(3)).with_stages([(8, -1.5)])):
        data = encode_trees(model)
        again = decode_trees(data)
        assert encode_trees(again) == data and again.trees == tuple(trees.Tree(t.splits, t.codes, float(np.float32(t.offset)), t.shift) for t in model.trees)
        file = ModelFile({"a": 1}, ["x", "y"], data, {"note": "n"})
        read = ModelFile.load(file.save(tmp_path / "deep" / "m.bin"))
        assert read.trees == data and read.feature_names == ["x", "y"] and read.metadata["note"] == "n"
        assert file.to_bytes()[12 + struct.unpack_from("<I", file.to_bytes(), 8)[0] :] == data


def test_bad_files_are_refused():
    data = encode_trees(_model())
    for broken in (b"XXXX" + data[4:], data[:4] + struct.pack("<I", 3) + data[8:], data + b"\0", data[:20] + struct.pack("<I", 9) + data[24:]):
        with pytest.raises(ValueError, match="begins|version|follow|contradicts"):
            decode_trees(broken)
    whole = ModelFile({}, [], data).to_bytes()
    for broken in (b"X" + whole[1:], whole[:4] + struct.pack("<I", 9) + whole[8:], whole[:-1]):
        with pytest.raises(ValueError, match="begins|version|bytes"):
            ModelFile.from_bytes(broken)


def test_booster_json():
    data = {"features_info": {"float_features": [{"feature_index": 1, "borders": [0.25]}, {"feature_index": 0, "borders": [0.5, 0.75]}]}, "oblivious_trees": [{"splits": [{"float_feature_index": 0, "border": 0.75}, {"float_feature_index": 1, "border": 0.25}], "leaf_values": [0, 1, 2, 3]}, {"splits": [{"float_feature_index": 1, "border": 0.25}], "leaf_values": [1, -1]}]}
    model = from_booster_json(json.dumps(data))
    assert model.trees[0].splits == ((0, 1), (1, 0)) and model.depth == 2
    for change in ({"scale_and_bias": [2, [0]]}, {"scale_and_bias": [1, [0.5]]}):
        with pytest.raises(ValueError, match="scale"):
            from_booster_json(json.dumps(data | change))
    data["oblivious_trees"][0]["splits"][0]["border"] = 0.6
    with pytest.raises(ValueError, match="none of feature"):
        from_booster_json(json.dumps(data))


def cells(spark, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)).astype(np.float32)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] * (x[:, 1] > 0) + x[:, 2] - 0.8 * x[:, 3] ** 2)))
    y = rng.uniform(size=n) < p
    return spark.createDataFrame([(str(k), [float(v) for v in r], bool(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "row_key string, x array<float>, y boolean")


def test_boosting_lowers_the_loss_and_coarse_trees_split_on_coarse_columns(spark):
    rows = cells(spark)
    borders = trees.sketch_borders(rows, "x", 6, 7)
    binned = rows.select("row_key", "y", trees.binned("x", borders).alias("bins")).persist()
    config = boost.BoostConfig(depth=2, n_trees=6, leaf_chunk=2, learning_rate=0.4, coarse_fraction=0.5)
    model = boost.fit(binned, borders, config, [8, 8, 8, 64, 64, 64])
    assert all(f < 3 for t in model.trees[:3] for f, _ in t.splits) and model.coarse_trees == 3
    losses = [boost.log_loss(trees.partial_scores(binned, model, "bins", [k]), f"raw_{k}", "y") for k in (1, 3, 6)]
    assert math.log(2) > losses[0] > losses[1] > losses[2]
    twice = binned.select("bins", "y").crossJoin(spark.createDataFrame([(0,), (1,)], "block int"))
    assert boost.fit(twice, borders, config, [8, 8, 8, 64, 64, 64], "block", 2).trees == model.trees
    binned.unpersist()


def test_detector_saves_and_loads(spark, tmp_path):
    rows = cells(spark, 800)
    config = Config(boost.BoostConfig(depth=2, n_trees=4, leaf_chunk=2, learning_rate=0.5), FrontConfig(neg_pos_ratio=None))
    names = [f"f{k}" for k in range(6)]
    detector = Detector(config, names).fit(rows, rows, [8, 8, 8, 64, 64, 64])
    assert detector.metadata["pr_auc"] > 0.55 and detector.model.stages
    loaded = Detector.load(detector.save(tmp_path / "model.bin"))
    order = lambda d, f: [tuple(r) for r in f(d).sort("row_key").collect()]
    a = order(rows, detector.score)
    assert a == order(rows, loaded.score) and loaded.config == config
    assert [r[1] for r in a] == [r[1] for r in order(rows, loaded.score_in_sql)]
    staged = loaded.score_staged(rows.withColumn("tile", F.col("row_key").cast("int") % 40), ["tile"])
    full = {r[0]: r[1] for r in a}
    assert all(full[r["row_key"]] == r["total"] for r in staged.where("alive").collect())
    with pytest.raises(RuntimeError):
        Detector().score(rows)


def image_cells(spark, n=24, side=4):
    """Images in pairs of near copies, and their cells."""
    rng = np.random.default_rng(9)
    hashes = [int(x) for x in rng.integers(-(2**62), 2**62, n // 2)]
    images = spark.createDataFrame([(k, hashes[k // 2] ^ (k % 2)) for k in range(n)], "image_id long, hash long")
    rows = []
    for k in range(n):
        for c in range(side * side):
            x = rng.normal(size=3)
            rows.append((k, c, [float(v) for v in x], bool(x[0] + 0.3 * x[1] > 0.8)))
    return images, spark.createDataFrame(rows, "image_id long, cell int, x array<float>, y boolean")


def test_detector_from_images(spark, tmp_path):
    images, table = image_cells(spark)
    config = Config(boost.BoostConfig(depth=2, n_trees=4, leaf_chunk=2, learning_rate=0.5), FrontConfig(neg_pos_ratio=2.0, val_frac=0.25, block_gib=1e-6))
    split = training.build_split(images, config.train)
    groups = split.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("held_out").alias("kinds")).collect()
    assert len(groups) == 12 and all(g["n"] == 2 and g["kinds"] == 1 for g in groups) and split.where("held_out").count() == 6
    detector = Detector(config, ["a", "b", "c"]).fit_images(images, table)
    assert detector.metadata["pr_auc"] > 0.5 and detector.metadata["blocks"] > 1 and detector.metadata["images_held_out"] == 6
    assert detector.ranking()[0] == "a"
    smaller, at = detector.prune(2)
    assert smaller.model is None and [detector.feature_names[k] for k in at] == smaller.feature_names and "a" in smaller.feature_names
    whole = detector.score_grid(table, 4).collect()
    assert len(whole) == 24 and all(len(r["v"]) == 16 and None not in r["v"] for r in whole)
    samples = training.sample_cells(table.select("image_id", "cell", "y"), split, config.train)
    assert training.gather(samples, table).count() == samples.count()
    with pytest.raises(Exception, match="no features"):
        training.gather(samples, table.limit(0)).collect()


def test_tune_fits_what_has_no_record(spark, tmp_path):
    images, table = image_cells(spark, 12)
    base = Config(boost.BoostConfig(depth=1, n_trees=2, leaf_chunk=2), FrontConfig(neg_pos_ratio=None, val_frac=0.4))
    args = (spark, images, table, ["a", "b", "c"])
    assert tune.tune(*args, {"depth": [1]}, str(tmp_path), base, keep_scores=True).count() == 1
    found = tune.tune(*args, {"depth": [1, 2]}, str(tmp_path), base)
    assert sorted(r["overrides"]["depth"] for r in found.collect()) == ["1", "2"] and len(list((tmp_path / "models").iterdir())) == 2
    assert read_models(spark, str(tmp_path / "models")).where("n_trees = 2 and n_features = 3").count() == 2
    assert tune.knobs()["thumb"] == ("train", "string", False) and tune.knobs()["levels"][1] == "array<int>" and tune.knobs()["neg_pos_ratio"][2]
    with pytest.raises(ValueError):
        tune.configure(base, {"no": 1})


def test_border_files(spark, tmp_path):
    borders = [[0.25, 1 / 3], [], [2.0]]
    save_borders(spark, borders, str(tmp_path / "b"))
    assert load_borders(spark, str(tmp_path / "b"), 3) == borders


def test_many_trees_equal_few_at_a_time(spark):
    rng = np.random.default_rng(8)
    model = random_model(rng, 60)
    table = spark.createDataFrame([(k, [int(x) for x in rng.integers(0, 12, 5)]) for k in range(200)], "k int, bins array<int>")
    whole, parts = trees.total_of(model, "bins"), trees.total_of(model, "bins", 0, 30) + trees.total_of(model, "bins", 30)
    assert table.where(whole != parts).count() == 0


def test_planning_tables():
    assert [boost.bin_bits(k) for k in (15, 1, 7, 8, 254)] == [4, 1, 3, 4, 8]
    assert boost.plan_blocks(5_700_000, 3122, 4.0) == 17 and boost.plan_blocks(10, 10, None) == boost.plan_blocks(0, 5, 1.0) == 1
    assert boost.auto_block_gib(None) is None and boost.auto_block_gib(23.0) == pytest.approx(8.0)
    assert boost.auto_block_gib(23.0, 1.0) == pytest.approx(3.2)
    assert boost.unused_blocks(boost.BoostConfig(), 1) == 0 and boost.unused_blocks(boost.BoostConfig(n_trees=32, leaf_chunk=16, coarse_fraction=0), 4) == 2
    assert trees.stage_counts(1000, 667, 16, (0.0, 0.125, 0.25, 0.5, 0.75)) == [667, 715, 747, 827, 923]


@pytest.mark.parametrize("bad", [{"depth": 0}, {"depth": 8}, {"n_trees": 0}, {"leaf_bits": 5}, {"leaf_chunk": 18}, {"coarse_fraction": 1.0}, {"coarse_max_side": 0}, {"scale_pos_weight": 0.0}])
def test_booster_knobs_are_checked(bad):
    with pytest.raises(ValueError, match="."):
        boost.BoostConfig(**bad)


@pytest.mark.parametrize("bad", [{"levels": (32, 16)}, {"levels": (64, 48)}, {"feature_mode": "x"}, {"thumb": "pow3"}, {"thumb": 0}, {"val_frac": 1.0}, {"block_gib": -1.0}])
def test_front_knobs_are_checked(bad):
    with pytest.raises(ValueError, match="."):
        FrontConfig(**bad)


def test_config_and_ranking_files(tmp_path):
    config = Config(boost.BoostConfig(depth=3), FrontConfig(levels=(2, 64, 4)))
    config.save(tmp_path / "c.json")
    assert Config.load(tmp_path / "c.json") == config and config.train.levels == (64, 4, 2)
    assert Config.from_dict({"export": {"x": 1}}) == Config()
    for bad in ({"other": {}}, {"model": {"x": 1}}):
        with pytest.raises(ValueError, match="unknown"):
            Config.from_dict(bad)
    (tmp_path / "r.json").write_text('{"names": ["c", "a", "b"]}')
    assert select_columns(["a", "b", "c"], load_ranking(tmp_path / "r.json"), 2) == ["a", "c"]
    with pytest.raises(ValueError, match="no columns"):
        select_columns(["a"], ["z"], 1)
    (tmp_path / "r.json").write_text('{"names": []}')
    with pytest.raises(ValueError, match="no columns"):
        load_ranking(tmp_path / "r.json")
