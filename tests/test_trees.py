"""Trees, forests and boosting against brute force, and ways of growing against each other."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from paths import SF_MID
from tidecast.operators import models as M
from tidecast.operators import tree_growth as G
from tidecast.operators.boosting import Chain, boost, in_sample
from tidecast.operators.tree_arrays import partial_sums, with_predictions
from tidecast.plans import model_jobs as MJ
from tidecast.session import scratch_path, written_table

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 1500
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n).round(1)])
    y = np.floor(3 * x[:, 0] + 2 * x[:, 1] ** 2 + 2 * rng.normal(size=n))
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(5), x, y


def brute_tree(x, y, leaf, depth):
    """(feature, threshold, left, right), or (mean, rows), every threshold tried."""
    best = None
    if len(y) >= 2 * leaf and y.min() < y.max() and depth:
        for f in range(x.shape[1]):
            own = np.unique(x[:, f])
            for low, high in zip(own, own[1:]):
                side = x[:, f] <= low
                if min(side.sum(), (~side).sum()) >= leaf:
                    score = y[side].sum() ** 2 / side.sum() + y[~side].sum() ** 2 / (~side).sum()
                    if best is None or score > best[0]:
                        best = (score, f, low / 2 + high / 2, side)
    if best is None:
        return float(y.mean()), len(y)
    _, f, cut, side = best
    return f, cut, brute_tree(x[side], y[side], leaf, depth and depth - 1), brute_tree(x[~side], y[~side], leaf, depth and depth - 1)


def nested(trees, at):
    if trees.feature[at] < 0:
        return float(trees.value[at]), int(trees.rows[at])
    return int(trees.feature[at]), float(trees.threshold[at]), nested(trees, trees.left[at]), nested(trees, trees.left[at] + 1)


def flat(tree):
    return [tree] if len(tree) == 2 else [tree[:2], *flat(tree[2]), *flat(tree[3])]


def same_trees(a, b):
    return a.n_trees == b.n_trees and all(np.allclose(np.array(flat(nested(a, i))), np.array(flat(nested(b, j)))) for i, j in zip(a.start[:-1], b.start[:-1]))


@pytest.mark.parametrize("leaf,depth", [(5, 3), (20, None)])
def test_exact_tree_tries_every_threshold(sample, leaf, depth):
    df, x, y = sample
    trees = G.exact_tree(df, NAMES, "y", leaf, depth)
    assert np.allclose(np.array(flat(nested(trees, 0))), np.array(flat(brute_tree(x, y, leaf, depth if depth else -1))))


@pytest.mark.parametrize("local_rows", [0, 300])
def test_exact_tree_does_not_depend_on_where_it_grows(sample, local_rows):
    df, _, _ = sample
    assert same_trees(G.exact_tree(df, NAMES, "y", 30, 4), G.exact_tree(df, NAMES, "y", 30, 4, local_rows))


def test_exact_tree_of_equal_labels_ties_and_gaps(spark):
    flat_rows = spark.createDataFrame([(float(i), 2.0) for i in range(20)], "a double, y double")
    for local in (0, 100):
        one = G.exact_tree(flat_rows, ["a"], "y", 1, None, local)
        assert one.shape() == (0, 1) and one.value[0] == 2.0
    twin = spark.createDataFrame([(float(i % 4), float(i % 4), float(i % 4 > 1)) for i in range(40)], "a double, b double, y double")
    for local in (0, 100):  # equal scores: the first feature, the lowest threshold
        tree = G.exact_tree(twin, ["a", "b"], "y", 1, None, local)
        assert tree.feature.tolist() == [0, -1, -1] and tree.threshold[0] == 1.5
    with pytest.raises(ValueError, match="missing"):
        G.exact_tree(spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "a double, y double"), ["a"], "y")
    with pytest.raises(ValueError, match="no train rows"):
        G.exact_tree(flat_rows.limit(0), ["a"], "y")


def test_forest_does_not_depend_on_where_it_grows(sample):
    df, _, _ = sample
    data = G.binned(df, NAMES, "y")
    whole = G.forest(data, 5, 4, None, 2)
    assert same_trees(whole, G.forest(data, 5, 4, None, 2, local_rows=200))
    assert same_trees(whole.some(0, 2), G.forest(data, 2, 4, None, 2))  # fewer trees are its beginning
    short = G.forest(data, 5, 4, 3, 2, local_rows=200)
    x = np.random.default_rng(1).normal(size=(50, 3))
    assert np.allclose(partial_sums(whole, x, [(None, 3)]), partial_sums(short, x, [(None, None)]))  # and less depth its top


def test_growth_in_a_task_is_the_same_in_runs_and_by_counts_or_sorts(monkeypatch):
    rng = np.random.default_rng(8)
    codes = rng.integers(0, [4, 40, 200], (3000, 3)).astype(np.uint8)
    y, w = np.floor(codes[:, 0] * 9 + codes[:, 1] + 6 * rng.random(3000)), rng.integers(1, 4, 3000).astype(np.uint8)
    whole = G.grow(codes, y, w, 4, None, 2, 9)
    assert len(whole["feature"]) > 300
    counts, sorts = G._dense, G._sparse
    for dense, sparse, rows in ((counts, counts, 1 << 17), (sorts, sorts, 1 << 17), (counts, sorts, 100), (sorts, sorts, 37)):
        monkeypatch.setattr(G, "_dense", dense)
        monkeypatch.setattr(G, "_sparse", sparse)
        monkeypatch.setattr(G, "RUN_ROWS", rows)
        for depth in (None, 5):
            own, at = G.grow(codes, y, w, 4, depth, 2, 9), len(G.grow(codes, y, w, 4, depth, 2, 9)["feature"])
            assert depth or all(np.array_equal(whole[k], own[k]) for k in whole)
            assert np.array_equal(whole["value"][:at], own["value"]) and (own["feature"][own["left"] >= 0] >= 0).all()


def test_equal_rows_and_single_features_grow(spark):
    y = np.arange(40.0)
    none = G.grow(np.zeros((40, 2), np.uint8), y, np.ones(40, np.uint8), 1, None, 1, 5)
    assert none["feature"].tolist() == [-1] and none["value"][0] == y.mean() and none["rows"][0] == 40
    one = G.grow(np.arange(40, dtype=np.int64)[:, None] * 1000, y, np.ones(40), 1, 1)
    assert one["cut"][0] == 19_000 and one["above"][0] == 20_000 and one["left"].tolist() == [1, -1, -1]


def test_forest_of_a_million_rows_a_node_needs_no_pass(sample, monkeypatch):
    df, _, _ = sample
    data = G.binned(df, NAMES, "y")
    monkeypatch.setattr(G, "_histograms", None)
    big = G.Binned(data.rows, data.names, data.edges, 630_000, data.mean)  # as many rows as six times the orders have
    assert same_trees(G.forest(big, 3, 4, 4, 2), G.forest(data, 3, 4, 4, 2))


def test_forest_rows_are_a_bootstrap_sample():
    rows, keys = np.arange(200_000, dtype=np.uint64), G.root_keys(42, np.arange(2))
    w = [G.poisson(rows, k) for k in keys]
    assert all(abs(v.mean() - 1) < 0.02 and abs((v == 0).mean() - np.exp(-1)) < 0.01 for v in w)
    assert abs(np.corrcoef(*w)[0, 1]) < 0.01


def test_sibling_histograms_equal_folded_ones(sample):
    df, _, _ = sample
    data = G.binned(df, NAMES, "y")
    upper = G.Upper(1, 42)
    root = G._histograms(data, upper, [0])
    (r,) = [r for r in G._best_bins(root, 5).collect() if r["feature"] == 0]
    left, right = upper.split(0, 0, r["bin"], r["bin"], 0.0, (int(r["ln"]), 0.0), (int(r["an"] - r["ln"]), 0.0))
    both = {tuple(x) for x in G._histograms(data, upper, [left, right]).collect()}
    less = {tuple(x) for x in G.sibling_histograms(root, G._histograms(data, upper, [left]), [(0, left, right)]).collect()}
    assert both == less


def test_forest_is_as_good_as_the_librarys(spark):
    t = written_table(MJ.split_table(spark, SF_MID).withColumn(MJ.LABEL, F.col(MJ.LABEL).cast("double")), "t")[0]
    train = t.where("split = 'train'")
    params = {"n_estimators": 40, "max_depth": 10, "min_samples_leaf": 5}
    own = M.fit_tree("random_forest", params, train, MJ.LABEL, MJ.FEATURES).transform(t)
    pack = VectorAssembler(inputCols=MJ.FEATURES, outputCol="v")
    lib = RandomForestRegressor(featuresCol="v", labelCol=MJ.LABEL, numTrees=40, maxDepth=10, minInstancesPerNode=5, maxBins=256, featureSubsetStrategy=M.sqrt_features(len(MJ.FEATURES)), seed=42)
    theirs = lib.fit(pack.transform(train)).transform(pack.transform(t))
    e = F.col(MJ.LABEL) - F.col("prediction")
    a, b = ({r[0]: r[1] for r in x.groupBy("split").agg(F.sqrt(F.avg(e * e))).collect()} for x in (own, theirs))
    assert a["validation"] <= 1.02 * b["validation"] and a["test"] <= 1.02 * b["test"]


def brute_boosting(codes, y, chain, number=0, rows=None):
    """(base, per-round sums over all rows) with every bin tried and every tree shrunken."""
    f = np.full(len(y), y.mean())
    out = []
    for m in range(chain.n_trees):
        use = np.ones(len(y), bool) if chain.subsample >= 1 else in_sample(rows, number, m, chain.subsample)
        tree = brute_tree(codes[use].astype(float), (y - f)[use], chain.leaf, chain.depth)

        def value(node, row):
            while len(node) == 4:
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node[0]

        f = f + chain.rate * np.array([value(tree, row) for row in codes])
        out.append(f.copy())
    return out


def test_boosting_is_the_hand_made_sum(sample):
    df, _, _ = sample
    data = G.binned(df.limit(400), NAMES, "y", bins=16)
    chains = [Chain(3, 0.1, 2, 5), Chain(5, 0.5, 3, 8, 0.7)]
    local = data.rows.toPandas()
    codes, y = np.frombuffer(b"".join(local["codes"]), np.uint8).reshape(-1, 3), local["label"].to_numpy()
    x = np.column_stack([np.append(e, np.inf)[codes[:, j]] for j, e in enumerate(data.edges)])
    for every, local_rows in ((2, 0), (10, 0), (10, 1000)):
        for number, (chain, trees) in enumerate(zip(chains, boost(data, chains, every, local_rows))):
            want = brute_boosting(codes, y, chain, number, local["row"].to_numpy())
            got = trees.base + partial_sums(trees, x, [(k + 1, None) for k in range(chain.n_trees)])
            assert trees.base == pytest.approx(y.mean())
            assert np.allclose(got, np.column_stack(want))


def test_many_partitions_are_added_up_alike(sample, monkeypatch):
    df, _, _ = sample
    data = G.binned(df, NAMES, "y")
    from tidecast.operators import boosting

    whole = boost(data, [Chain(2, 0.1, 2, 5)], local_rows=0)[0]
    monkeypatch.setattr(boosting, "GATHER", 2)
    assert same_trees(whole, boost(data, [Chain(2, 0.1, 2, 5)], local_rows=0)[0])


def test_passes_read_blocks_on_all_slots(sample, monkeypatch):
    df, _, _ = sample
    from tidecast.operators import boosting

    data = G.binned(df.coalesce(1), NAMES, "y")
    seen = []
    gathered = boosting._gathered
    monkeypatch.setattr(boosting, "_gathered", lambda told, parts: seen.append(parts) or gathered(told, parts))
    monkeypatch.setattr(boosting, "BLOCK", 64)
    own = [Chain(4, 0.2, 2, 5), Chain(3, 0.3, 3, 5, 0.8)]
    for a, b in zip(boost(data, own, 2, local_rows=0), boost(data, own)):
        assert a.feature.tolist() == b.feature.tolist() and np.allclose(a.value, b.value)
    assert min(seen) >= min(4, df.sparkSession.sparkContext.defaultParallelism)


def test_small_trees_score_split_by_split_like_the_walk(sample, monkeypatch):
    df, x, _ = sample
    from tidecast.operators import tree_arrays as A

    (trees,) = boost(G.binned(df, NAMES, "y"), [Chain(7, 0.2, 3, 5)])
    plans = [(None, None), (3, None), (7, None), (0, None)]
    walked = np.cumsum(trees.value[A.walk(trees, x)[None]], axis=1)
    monkeypatch.setattr(A, "ROWS_AT_ONCE", 400)
    monkeypatch.setattr(A, "walk", None)  # no pair of row and tree walks by itself
    assert np.allclose(partial_sums(trees, x, plans), np.column_stack([walked[:, 6], walked[:, 2], walked[:, 6], np.zeros(len(x))]))
    monkeypatch.undo()
    monkeypatch.setattr(A, "FEW_NODES", 3)  # larger trees walk
    assert np.allclose(partial_sums(trees, x, plans[:2]), walked[:, [6, 2]])


def test_passes_keep_rows_once_and_write_states_of_living_chains(sample, monkeypatch):
    df, _, _ = sample
    import glob

    from tidecast.operators import boosting

    paths = []
    monkeypatch.setattr(boosting, "scratch_path", lambda spark, name: paths.append(scratch_path(spark, name)) or paths[-1])
    data = G.binned(df, NAMES, "y")
    boost(data, [Chain(2, 0.1, 2, 5), Chain(7, 0.1, 1, 5)], write_every=2, local_rows=0)
    (path,) = paths
    names = {p.rsplit("/", 1)[1] for p in glob.glob(f"{path}/*")}
    parts = {n.split("-")[1] for n in names if n.startswith("rows-")}
    assert names == {f"rows-{i}" for i in parts} | {f"state-{i}-{k}" for i in parts for k in (2, 4, 6)}
    first = f"{path}/state-0-4"
    assert {c for b in boosting._blocks(first, ["state1"], ["state1"]) for c in b} == {"state1"}  # the chain that has ended is written no more


def test_scoring_in_blocks_and_gaps(sample, spark):
    df, _, _ = sample
    trees = G.forest(G.binned(df, NAMES, "y"), 6, 5, None, 2)
    plans = [(None, None), (2, None), (4, 2), (None, 0)]
    whole, blocks = (sorted(tuple(np.round(r[0], 9)) for r in with_predictions(df, trees, NAMES, plans, block_bytes=b).select("predictions").collect()) for b in (1 << 30, trees.nbytes // 4))
    assert whole == blocks and len(whole) == 1500
    with pytest.raises(Exception, match="missing values in a"):
        with_predictions(spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, c double"), trees, NAMES).collect()


def test_grids_share_ensembles(sample):
    df, _, _ = sample
    train = df.withColumnRenamed("y", "label")
    grid = [{"max_depth": d, "min_samples_leaf": k} for k in (5, 10) for d in (2, 4, None)]
    fits = M.fit_grid("decision_tree", grid, train, "label", NAMES)
    assert len({id(f.trees) for f in fits}) == 2
    for f, p in zip(fits, grid):
        one = M.fit_tree("decision_tree", p, train, "label", NAMES)
        assert f.shape() == one.shape() and np.allclose([v for _, v in f.importances()], [v for _, v in one.importances()])
    assert len({id(f.trees) for f in M.fit_grid("random_forest", [dict(p, n_estimators=n, max_depth=3) for p in ({"min_samples_leaf": 9},) for n in (2, 4)], train, "label", NAMES)}) == 1


def test_importances_sum_to_one_and_name_the_right_feature(sample):
    df, _, _ = sample
    trees = G.exact_tree(df, NAMES, "y", 5, 4)
    own = dict(trees.importances())
    assert sum(own.values()) == pytest.approx(1) and max(own, key=own.get) == "b"
    assert dict(trees.importances(depth=1))["b"] == 1.0


def test_a_stored_forest_answers_like_the_gathered_one(sample, spark, monkeypatch):
    df, _, _ = sample
    data = G.binned(df, NAMES, "y")
    plans = [(None, None), (2, None), (4, 2), (None, 0)]
    from tidecast.operators import stored_forest as SF

    monkeypatch.setattr(SF, "CHUNK", 100)  # several readings of the trees a task
    for local_rows, depth in ((1 << 17, None), (200, None), (200, 2)):
        whole, own = (f(data, 5, 4, depth, 2, local_rows=local_rows) for f in (G.forest, G.stored_forest))
        assert (depth == 2 or own.subtrees().count()) and not hasattr(own, "value")
        frame = df.withColumn("id", F.monotonically_increasing_id()).withColumn("told", F.lit("x"))
        a = {r["id"]: r["p"] for r in with_predictions(frame, whole, NAMES, plans, out="p").collect()}
        b = {r["id"]: r["p"] for r in own.with_predictions(frame, plans, "p").where("told = 'x'").collect()}
        assert set(a) == set(b) and all(np.allclose(a[k], b[k]) for k in a)
        for n, d in plans[:3]:
            assert np.allclose([v for _, v in whole.importances(n, d)], [v for _, v in own.importances(n, d)])
    with pytest.raises(Exception, match="missing values in a"):
        own.with_predictions(spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, c double"), plans, "p").collect()


def test_stored_trees_are_walked_by_steps_like_the_walk():
    from tidecast.operators import stored_forest as SF
    from tidecast.operators.tree_arrays import Trees, walk

    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (5000, 4)).astype(np.uint8)
    made = G.grow(codes, rng.normal(size=5000).round(1) + codes[:, 0], np.ones(5000), 2, None, 2, 3)
    tree = Trees((), np.array([0, len(made["feature"])]), made["feature"], made["cut"], made["left"], made["value"], made["gain"], made["rows"])
    own = SF._walked(SF._steps(tree), codes.ravel(), np.arange(5000) * 4, (0, 3, 12, 99))
    assert all(np.array_equal(own[d], n[:, 0]) for d, n in walk(tree, codes, (0, 3, 12, 99)).items())
    top = SF._walked(SF._steps(tree), codes.ravel(), np.arange(5000) * 4, (), most=8)[None]
    assert np.array_equal(top, walk(tree, codes, (8,))[8][:, 0])
    below = SF._walked(SF._steps(tree), codes.ravel(), np.arange(5000) * 4, (8, 12), top, 8)
    assert all(np.array_equal(below[d], n[:, 0]) for d, n in walk(tree, codes, (8, 12)).items())


def test_a_large_stored_forest_scores_rows_by_their_upper_nodes(sample, monkeypatch):
    df, _, _ = sample
    from tidecast.operators import stored_forest as SF

    own = G.stored_forest(G.binned(df, NAMES, "y"), 5, 4, None, 2)
    frame = df.withColumn("id", F.monotonically_increasing_id())
    for plans, top in (([(None, None), (2, 4), (3, 3)], 3), ([(None, None)], 4)):
        told = []
        for many in (1 << 15, 0):
            monkeypatch.setattr(SF, "MANY_NODES", many)
            monkeypatch.setattr(SF, "TOP", top)
            monkeypatch.setattr(SF, "SLICE", 90)
            told.append({r["id"]: r["p"] for r in own.with_predictions(frame, plans, "p").collect()})
        assert len(told[0]) == 1500 and all(np.allclose(told[0][k], told[1][k]) for k in told[0])


def test_forests_of_one_sample_are_grown_together(sample, monkeypatch):
    df, _, _ = sample
    data, terms = G.binned(df, NAMES, "y"), [(9, 4), (4, None), (120, None), (4, 2)]
    dealt = []
    subtrees = G._forest_subtrees
    monkeypatch.setattr(G, "_forest_subtrees", lambda data, upper, small, own, subset: dealt.append(list(own)) or subtrees(data, upper, small, own, subset))
    frame = df.withColumn("id", F.monotonically_increasing_id())
    for local_rows in (1 << 17, 500):
        dealt.clear()
        both = G.stored_forests(data, 2, terms, 2, local_rows=local_rows)
        assert sorted(map(str, terms)) == sorted(str(x) for own in dealt for x in own) and (local_rows == 500 or len(dealt) == 1)
        for (leaf, depth), own in list(zip(terms, both))[:: 2 if local_rows == 500 else 3]:
            alone = G.forest(data, 2, leaf, depth, 2, local_rows=local_rows)
            a = {r["id"]: r["p"][0] for r in with_predictions(frame, alone, NAMES, [(None, None)], out="p").collect()}
            b = {r["id"]: r["p"][0] for r in own.with_predictions(frame, [(None, None)], "p").collect()}
            assert all(a[k] == pytest.approx(b[k]) for k in a)
            assert np.allclose([v for _, v in alone.importances()], [v for _, v in own.importances()], atol=1e-6)


def test_searches_keep_their_forests_in_the_shared_folder(sample):
    df, _, _ = sample
    fits = M.fit_grid("random_forest", [{"n_estimators": n, "max_depth": 3, "min_samples_leaf": 9} for n in (2, 4)], df, "y", NAMES)
    assert all(type(f.trees).__name__ == "StoredForest" for f in fits)


def test_exact_tree_opens_few_bins_and_misses_no_threshold(spark, monkeypatch):
    """Thresholds inside of bins are found, though only bins that may hold the best one are opened."""
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.random(4000), rng.integers(0, 5, 4000), rng.normal(size=4000)])
    y = np.floor(20 * (x[:, 0] > 0.613) + 3 * x[:, 1] + 4 * rng.random(4000))
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double").repartition(4)
    whole = G.exact_tree(df, ["a", "b", "c"], "y", 30, 3)
    for bins, at_once in ((16, 1 << 21), (64, 40)):
        monkeypatch.setattr(G, "BINS_OF_VALUES", bins)
        monkeypatch.setattr(G, "BINS_AT_ONCE", at_once)
        assert same_trees(whole, G.exact_tree(df, ["a", "b", "c"], "y", 30, 3, 0))
    rows = df.select(*(F.col(c).alias(f"x{i}") for i, c in enumerate("abc")), F.col("y").alias("label"))
    edges = G.quantile_edges(rows, ["x0", "x1", "x2"], 64)
    bins = G._value_bins(rows, G.Upper(1, 1), ("x0", "x1", "x2"), edges, [0])
    opened = G.bins_to_open(G.bin_ends(bins), 30)
    assert 0 < opened.count() < bins.count() / 4
    best = G.best_thresholds(G._inner_sums(rows, G.Upper(1, 1), ("x0", "x1", "x2"), edges, opened), 30).first()
    assert best["feature"] == 0 and best["value"] == x[x[:, 0] <= 0.613, 0].max() and best["ln"] == (x[:, 0] <= 0.613).sum()
