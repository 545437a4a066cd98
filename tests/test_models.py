"""Forests, contributions, networks, local models and rules against brute force and planted structure."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.functions import schema as S
from flowguard.operators import contributions, explain, models, networks
from flowguard.plans import catalog
from flowguard.plans.fixtures import Views
from flowguard.sources.scratch import fresh_path


@pytest.fixture(scope="module")
def planted(spark):
    """600 rows of four columns, the label by two of them, each row several times."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        x = [rng.randrange(12), rng.randrange(12), rng.randrange(5), rng.random()]
        y = int((x[0] > 6) != (x[1] > 8))
        rows += [(f"k{i}-{j}", *map(float, x), y) for j in range(1 + i % 4)]
    return spark.createDataFrame(rows, "flow_key string, a double, b double, c double, d double, label int").persist()


COLUMNS = ["a", "b", "c", "d"]


def test_one_tree_is_the_same_on_distinct_rows(planted):
    """Without drawing rows, trees on distinct rows with weights predict what trees on all rows do (columns of fewer values than bins)."""
    one, two = (models.forest_fit(planted, COLUMNS[:3], trees=1, depth=8, bins=64, collapse=c) for c in (True, False))
    both = models.forest_proba(models.forest_proba(planted, one, COLUMNS[:3], "p"), two, COLUMNS[:3], "q")
    assert both.where("abs(p - q) > 1e-9").count() == 0
    assert models.collapsed(planted, COLUMNS).count() == 600


def test_forest_of_distinct_rows_is_no_worse(planted):
    found = [models.measures(models.forest_proba(planted, models.forest_fit(planted, COLUMNS, trees=20, depth=8, collapse=c), COLUMNS), "p_rf")["auc"] for c in (True, False)]
    assert min(found) > 0.97
    assert abs(found[0] - found[1]) < 0.02


def brute_contributions(paths, x, width):
    """Shapley values of one row by all orders of features of a path: the value of a set is a product over the path."""
    phi = np.zeros(width)
    for value, path in paths:
        part = [(f, float(lo < x[f] <= hi), share) for f, lo, hi, share in path]
        n = len(part)
        for i, (f, b, z) in enumerate(part):
            rest = [p for j, p in enumerate(part) if j != i]
            for r in range(n):
                for known in itertools.combinations(range(n - 1), r):
                    others = math.prod(p[1] if j in known else p[2] for j, p in enumerate(rest))
                    phi[f] += value * math.factorial(r) * math.factorial(n - 1 - r) / math.factorial(n) * (b - z) * others
    return phi


def test_contributions_by_definition(spark, planted):
    model = models.forest_fit(planted, COLUMNS, trees=4, depth=6, bins=32)
    table = contributions.path_table(contributions.forest_nodes(model), 6).collect()
    paths = [(r.value, [tuple(s) for s in r.path]) for r in table]
    few = planted.limit(25).unionAll(planted.limit(1)).persist()  # one row twice
    got = {}
    for r in explain.shap_values(few, model, COLUMNS).collect():
        got.setdefault((r.flow_key, r.feature), []).append(r.phi)
    for r in few.collect():
        want = brute_contributions(paths, [r.a, r.b, r.c, r.d], 4) / 4
        for c, phi in zip(COLUMNS, want):
            assert got[r.flow_key, c] == pytest.approx([phi] * len(got[r.flow_key, c]), abs=1e-12)
    assert sum(map(len, got.values())) == 26 * 5


def test_paths_cover_every_row_once(planted):
    """Each row stays on the path of one leaf of each tree, whose value is the tree's prediction; shares multiply to the leaf's part."""
    model = models.forest_fit(planted, COLUMNS, trees=3, depth=15)
    nodes = contributions.forest_nodes(model)
    table = contributions.path_table(nodes, 15).collect()
    cover = {(r.tree, r.node): r.cover for r in nodes.collect()}
    for r in table:
        assert math.prod(s.share for s in r.path) == pytest.approx(cover[r.tree, r.leaf] / cover[r.tree, 0])
    for row in models.forest_proba(planted.limit(40), model, COLUMNS).collect():
        on = [r for r in table if all(s.low < row[COLUMNS[s.feature]] <= s.high for s in r.path)]
        assert sorted(r.tree for r in on) == [0, 1, 2]
        assert sum(r.value for r in on) / 3 == pytest.approx(row.p_rf, abs=1e-12)


def test_contributions_of_a_forest_without_splits(spark):
    rows = spark.createDataFrame([("x", 1.0, 1), ("y", 1.0, 0)], "flow_key string, a double, label int")
    model = models.forest_fit(rows, ["a"], trees=2, depth=3)
    got = explain.shap_values(rows, model, ["a"]).groupBy("flow_key").agg(F.sum("phi").alias("s")).join(models.forest_proba(rows, model, ["a"]), "flow_key").collect()
    assert len(got) == 2
    assert all(r.s == pytest.approx(r.p_rf) for r in got)
    assert explain.shap_values(rows.limit(0), model, ["a"]).count() == 0


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = networks.Network.fresh(13, (3, 4), 5)
    x, y, keep = rng.normal(size=(7, 13)), rng.integers(0, 2, 7).astype(float), (rng.random((7, 5)) > 0.3) / 0.7
    _, grads = net.gradient(x, y, keep)
    for i, w in enumerate(net.weights):
        for j in range(w.size):
            losses = []
            for step in (1e-6, -1e-6):
                moved = [u.copy() for u in net.weights]
                moved[i].flat[j] += step
                losses.append(networks.Network(13, moved).gradient(x, y, keep)[0])
            assert grads[i].flat[j] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def waves(spark):
    """Twelve columns, the label by whether a bump stands anywhere in the first half: what a convolution finds."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3_000):
        x, y = rng.normal(0, 0.4, 12), i % 2
        at = rng.integers(0, 4) if y else rng.integers(6, 9)
        x[at : at + 3] += [1.0, 2.0, 1.0]
        rows.append((f"k{i}", *map(float, x), y))
    return spark.createDataFrame(rows, "flow_key string, " + ", ".join(f"x{i} double" for i in range(12)) + ", label int").persist()


WAVE = [f"x{i}" for i in range(12)]


def test_sums_of_partitions_are_the_whole_gradient(waves):
    net = networks.Network.fresh(12, (4, 6), 8)
    table = waves.select(F.array(*WAVE).alias("x"), F.col("label").cast("double").alias("y")).persist()
    pdf = table.toPandas()
    loss, grads = net.gradient(np.stack(pdf["x"]), pdf["y"].to_numpy())
    for parts in (1, 5, 40):  # 40 partitions are added up over a tree
        got_loss, rows, got = networks.summed_gradient(table.repartition(parts), parts, net)
        assert rows == 3_000
        assert got_loss == pytest.approx(loss, rel=1e-4)
        assert got == pytest.approx(np.concatenate([g.ravel() for g in grads]), rel=1e-3, abs=1e-2)


def test_training_goes_on_between_epochs_and_stops_early(spark, waves):
    fit, validation = waves.where("substr(flow_key, -1) < '8'"), waves.where("substr(flow_key, -1) >= '8'")
    net, trace = networks.train(fit, WAVE, validation, kernels=(8, 12), hidden=16, epochs=12, steps=4, rate=0.01, dropout=0.2)
    losses = [loss for _, _, loss in trace]
    assert losses[-1] < losses[0] / 3 and sum(b > a for a, b in zip(losses, losses[1:])) <= 3
    assert models.measures(networks.proba(validation, net, WAVE), "p_nn")["auc"] > 0.97
    # the best epoch's weights are kept, and a rate far too large ends after `patience` epochs without a better one
    assert networks.mean_loss(validation.select(F.array(*WAVE).alias("x"), F.col("label").cast("double").alias("y")), net) == pytest.approx(min(losses), rel=1e-4)
    _, wild = networks.train(fit, WAVE, validation, start=net, epochs=20, patience=3, steps=4, rate=0.5)
    assert len(wild) < 20
    found = [loss for _, _, loss in wild]
    assert found.index(min(found)) == len(found) - 4
    path = fresh_path(spark, "net")
    networks.save(net, path)
    both = networks.proba(networks.proba(validation, net, WAVE, "p"), networks.load(path), WAVE, "q")
    assert both.where("p <> q").count() == 0


def test_adam_state_is_carried():
    """Two steps of one optimizer differ from two first steps, as the moments do."""
    net = networks.Network(12, [np.zeros((2, 2))])
    g1, g2 = np.array([1.0, -2.0, 0.5, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])
    adam = networks.Adam(4, 0.1)
    got = adam.moved(adam.moved(net, g1), g2).weights[0].ravel()
    m, v = 0.9 * 0.1 * g1 + 0.1 * g2, 0.999 * 0.001 * g1**2 + 0.001 * g2**2
    first = -0.1 * g1 / (np.abs(g1) + 1e-8)
    assert got == pytest.approx(first - 0.1 * (m / (1 - 0.9**2)) / (np.sqrt(v / (1 - 0.999**2)) + 1e-8))


def test_planted_rules_among_noise(spark):
    """Two planted rules are found among 20 columns of noise, and nothing longer than they are."""
    rng = random.Random(9)
    rows = []
    for _ in range(6_000):
        x = [rng.random() for _ in range(22)]
        y = int((x[0] > 0.75 and x[1] > 0.5) or x[2] > 0.875)
        rows.append((*x, y if rng.random() > 0.02 else 1 - y))
    columns = [f"c{i}" for i in range(22)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", label int").persist()
    rules = explain.mine_rules(df, columns, "label")
    assert {frozenset((c, op) for c, op, _ in r) for r in rules} == {frozenset({("c0", ">"), ("c1", ">")}), frozenset({("c2", ">")})}
    for rule in rules:
        for c, _, cut in rule:
            assert cut == pytest.approx({"c0": 0.75, "c1": 0.5, "c2": 0.875}[c], abs=0.03)


def test_no_rule_where_there_is_none(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.random(), rng.random(), rng.randrange(2)) for _ in range(2_000)], "a double, b double, label int")
    assert len(explain.mine_rules(df, ["a", "b"], "label")) <= 1
    assert explain.mine_rules(df.where("label = 0"), ["a", "b"], "label") == []


def test_local_models_of_many_rows_equal_a_fit_of_their_own(spark):
    """Sums over parts give the ridge fit that all samples of a row give at once."""
    rng = random.Random(4)
    rows = spark.createDataFrame([(str(i), rng.random() * 10, rng.random() * 10, float(i % 3 == 0), float(i % 3 == 1)) for i in range(60)], "flow_key string, a double, b double, g_x double, g_y double").persist()
    columns = ["a", "b", "g_x", "g_y"]
    kept = []

    def predict(df):
        kept.append(df)
        return df.withColumn("p", F.when(F.col("a") > 5, 0.6).otherwise(0.1) + 0.3 * F.col("g_x"))

    found = explain.lime_local(rows, rows, columns, predict, samples=400, top=3, groups=("g_",)).collect()
    assert len(found) == 180
    frame = kept[0].toPandas()
    cuts = rows.agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000) for c in ("a", "b")]).first()
    by_row = {}
    for r in found:
        by_row.setdefault(r.flow_key, []).append(r)
    for key, part in frame.groupby("flow_key"):
        bins = lambda c, p: np.searchsorted(cuts[("a", "b").index(c)], part[p + c])  # noqa: B023, E731
        z = np.column_stack([*[bins(c, "") == bins(c, "x_") for c in ("a", "b")], (part["g_x"] == part["x_g_x"]) & (part["g_y"] == part["x_g_y"])]).astype(float)
        w = np.exp(-((1 - z).sum(1)) / (0.75 * 3**0.5) ** 2)
        p = np.where(part["a"] > 5, 0.6, 0.1) + 0.3 * part["g_x"]
        x = np.c_[z, np.ones(len(z))]
        beta = np.linalg.solve((x.T * w) @ x + np.diag([1, 1, 1, 1e-9]), (x.T * w) @ p)[:3]
        assert sorted(r.weight for r in by_row[key]) == pytest.approx(sorted(beta))
        group = next(r for r in by_row[key] if r.feature.startswith("g_"))
        assert (group.low, group.high) == (None, None)
        assert group.feature == ("g_x", "g_y", "g_other")[int(key) % 3]


def test_registry_reads_what_is_stored(spark, planted):
    root = fresh_path(spark, "models")
    flows = spark.createDataFrame([("ton", 1), ("ton", 0), ("bot", 1), ("new", 0)], "domain string, label int")
    models.save(models.forest_fit(planted, COLUMNS, trees=3, depth=4), models.model_path(root, "ton_iot"))
    models.save(models.forest_fit(planted, COLUMNS[:2], trees=5, depth=6), models.model_path(root, models.GLOBAL))
    got = {r.choice: r for r in models.registry(flows, root).collect()}
    assert {c: (r.model, r.features, r.trees, r.depth, r["rows"], r.attacks) for c, r in got.items()} == {
        "ton_iot": ("ton_iot", 4, 3, 4, 2, 1), "bot_iot": ("bot_iot_finetuned", None, None, None, 1, 1), "new": ("new_finetuned", None, None, None, 1, 0), "omni": ("omni", 2, 5, 6, 4, 2),
    }
    loaded = models.load(got["omni"].path)
    assert loaded.numFeatures == 2 and got["omni"].saved is not None


def test_queries_hold_the_surveyed_sizes(spark, sf_dir):
    """100 trees of depth 15, their floor, and contributions that add up, on the whole train part."""
    found = {r.metric: r.value for r in catalog.QUERIES["rf_fit"](spark, sf_dir).collect()}
    assert found["auc"] > 0.9
    v = Views(spark, sf_dir)
    model = catalog._forest(v)
    assert (model.getNumTrees, model.getOrDefault("maxDepth"), model.numFeatures) == (100, 15, 28)
    phi = catalog.QUERIES["shap_values"](spark, sf_dir).groupBy("flow_key").agg(F.sum("phi").alias("s"), F.count("*").alias("n"))
    joined = phi.join(catalog.QUERIES["rf_proba"](spark, sf_dir), "flow_key")
    assert joined.count() == 500
    assert joined.where("abs(s - p_rf) > 1e-9 or n <> 29").count() == 0
    nets = {r.metric: r.value for r in catalog.QUERIES["neural_fit"](spark, sf_dir).collect()}
    assert nets["auc"] > 0.9
    trace = catalog.QUERIES["early_stop"](spark, sf_dir).collect()
    assert len(trace) <= 20 and sum(r.best for r in trace) == 1
    assert all(r.weight is not None for r in catalog.QUERIES["lime_local"](spark, sf_dir).limit(20).collect())
    assert S.FEATURES[0] == "duration"
