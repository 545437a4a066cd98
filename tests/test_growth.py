"""Steps whose work must not grow faster than their input: forests, gradients, rules, caps, joins."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.operators import explain, features, forests, models, networks, sampling
from flowguard.plans import catalog
from flowguard.sources import flows
from flowguard.sources.scratch import fresh_path

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = []
    for i in range(3_000):
        x = [float(rng.randrange(12)), float(rng.randrange(9)), rng.random()]
        made.append((f"k{i}", *x, int((x[0] > 6) != (x[1] > 4) or x[2] > 0.9)))
    return spark.createDataFrame(made, "flow_key string, a double, b double, c double, label int").persist()


def test_large_nodes_split_by_level_give_the_same_forest(rows, monkeypatch):
    """Splitting nodes of many rows over all tasks, and the rest in one, is the same as growing each tree in one."""
    one = models.forest_fit(rows, COLUMNS, trees=5, depth=9)
    monkeypatch.setattr(forests, "LOCAL", 200)
    two = models.forest_fit(rows, COLUMNS, trees=5, depth=9)
    assert one.totalNumNodes == two.totalNumNodes > 100
    both = models.forest_proba(models.forest_proba(rows, one, COLUMNS, "p"), two, COLUMNS, "q")
    assert both.where("abs(p - q) > 1e-12").count() == 0
    assert models.measures(models.forest_proba(rows, two, COLUMNS), "p_rf")["auc"] > 0.97
    # depth ends the upper part too
    assert all(t.depth <= 2 for t in models.forest_fit(rows, COLUMNS, trees=3, depth=2).trees)


def test_forest_does_not_depend_on_partitions(rows):
    one, two = (models.forest_fit(rows.repartition(n), COLUMNS, trees=4, depth=6) for n in (1, 13))
    both = models.forest_proba(models.forest_proba(rows, one, COLUMNS, "p"), two, COLUMNS, "q")
    assert both.where("p <> q").count() == 0


def test_a_null_feature_is_refused(rows):
    with pytest.raises(Exception, match="null or NaN"):
        models.forest_fit(rows.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), COLUMNS, trees=2, depth=2)


def test_windows_are_one_product():
    """A place that pooling leaves out isn't worked out: 13 columns have 11 windows, of which pooling takes 10."""
    net = networks.Network.fresh(13, (3, 4), 5)
    _, (seen, *_) = net._layers(np.zeros((7, 13)))
    assert [w.shape for w, *_ in seen] == [(7 * 10, 3), (7 * 2, 9)]


def test_rules_read_counts_of_equal_rows(rows, monkeypatch):
    """What the steps read has a row for each combination of bins, however many rows lie there."""
    sizes = []
    keep = explain.written
    monkeypatch.setattr(explain, "written", lambda df, name: sizes.append((out := keep(df, name)).count()) or out)
    many = rows.select("a", "b", "label").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3))))
    found = explain.mine_rules(many, ["a", "b"], "label")
    assert found
    assert sizes[-1] <= 12 * 9


def test_caps_read_no_whole_domain(spark):
    """Only rows up to the hash digits that reach a cap are ranked; a null domain is one."""
    df = spark.range(60_000).select(F.col("id").cast("string").alias("flow_key"), F.when(F.col("id") % 5 > 0, "x").alias("domain"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    out = sampling.pool_caps(df, "domain", F.col("label"))
    got = {(r.domain, r.is_attack): r["count"] for r in out.groupBy("domain", "is_attack").count().collect()}
    assert got == {("x", 0): 2000, ("x", 1): 500, (None, 0): 2000, (None, 1): 500}
    order = F.row_number().over(sampling.W.partitionBy("domain", "label").orderBy(F.md5(F.concat("flow_key", F.lit("|42"))), "flow_key"))
    want = df.withColumn("i", order).where((F.col("i") <= 500) | ((F.col("label") == 0) & (F.col("i") <= 2000)))
    assert out.select("flow_key").exceptAll(want.select("flow_key")).count() == 0
    assert "(_b#" in (plan := out._jdf.queryExecution().analyzed().toString()) and "<= _last#" in plan


def test_no_join_of_rows_to_themselves(spark, sf_dir):
    plan = catalog.QUERIES["scaler_roundtrip"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2  # lineitem with orders, for the rows and for the scaler
    shown = catalog.QUERIES["shap_beeswarm"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in shown


def test_folders_are_written_without_a_sort(spark):
    """A task doesn't hold all its rows to sort them by folder; with more folders than stay open the rows are whole too."""
    store = spark._jsparkSession.sharedState().statusStore()
    for many, write in ((3, flows.write_mapped), (40, flows.write_mapped), (3, flows.write_matrices)):
        name = "domain" if write is flows.write_mapped else "split"
        df = spark.range(4_000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("d/"), F.col("id") % many)).alias(name))
        path = fresh_path(spark, "folders")
        write(df, path)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(store.executionsList().size())]
        assert "Sort" not in next(p for p in reversed(plans) if path in p)
        assert df.exceptAll(spark.read.parquet(path)).count() == 0 and spark.read.parquet(path).count() == 4_000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_splits_read_whole_rows_once(spark):
    """Rows are marked against a cut: neither split ranks or sorts whole rows, and a row is read once. Keys that repeat at a cut still give exact shares."""
    rows = spark.range(5_000).select(F.col("id").cast("string").alias("flow_key"), (F.col("id") % 3).cast("int").alias("label"), F.rand(1).alias("a"))
    for made, n in ((sampling.split_stratified(rows), 1), (sampling.mark_tail(rows, ["flow_key"], 0.1), 1)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("Range (0, 5000") == n
    want = {r.flow_key: r.part for r in sampling.split_tail(rows, ["flow_key"], 0.1).collect()}
    assert {r.flow_key: r.part for r in sampling.mark_tail(rows, ["flow_key"], 0.1).collect()} == want
    twice = rows.select(F.lit("k").alias("flow_key"), "label", "a")  # one key on both sides of every cut
    assert sampling.mark_tail(twice, ["flow_key"], 0.1).where("part = 'validation'").count() == 500
    assert {(r.label, r.split): r["count"] for r in sampling.split_stratified(twice).groupBy("label", "split").count().collect()} == {(i, s): {"test": 333, "train": n - 333}[s] for i, n in enumerate((1667, 1667, 1666)) for s in ("test", "train")}
    assert sampling.mark_tail(rows.limit(3), ["flow_key"], 0.1).where("part = 'fit'").count() == 3
    assert sampling.mark_tail(rows.limit(3), ["flow_key"], 1.0).where("part = 'validation'").count() == 3


def test_gradient_copies_no_windows():
    """A window is a slice of the row before it: 512 rows need no copies of overlapping windows."""
    rng = np.random.default_rng(1)
    net = networks.Network.fresh(28).as_type(np.float32)
    x, y = rng.normal(size=(512, 28)).astype(np.float32), (rng.random(512) > 0.5).astype(float)
    tracemalloc.start()
    net.gradient(x, y)
    assert tracemalloc.get_traced_memory()[1] < 15e6  # before: 20 MB
    tracemalloc.stop()


def test_scores_come_from_arrays(spark, rows, monkeypatch):
    """Rows are scored from arrays of nodes, to the bit as MLlib scores them, and no forest is loaded into the driver for it; a copy scores the same."""
    made = models.forest_fit(rows, COLUMNS, trees=7, depth=9)
    path = fresh_path(spark, "copy")
    models.save(made, path)
    copy = models.load(path)
    with monkeypatch.context() as m:
        m.setattr(forests.PipelineModel, "load", None)
        both = models.forest_proba(models.forest_proba(rows, made, COLUMNS, "p"), copy, COLUMNS, "q").persist()
        assert both.where("p = q").count() == 3_000
        with pytest.raises(Exception, match="null or NaN"):
            models.forest_proba(rows.withColumn("a", F.lit(None).cast("double")), made, COLUMNS).collect()
    assert "model" not in made.__dict__
    want = copy.model.transform(features.assemble(both, COLUMNS))
    assert want.where("prediction = p").count() == 3_000
