"""Edge tables and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowguard.functions import columns as C
from flowguard.functions import schema as S
from flowguard.operators import alerts, clean, detectors, evaluation, explain, features, models, profile, sampling
from flowguard.plans import catalog
from flowguard.plans.fixtures import Views
from flowguard.sources import flows as io
from flowguard.sources.scratch import fresh_path
from flowguard.streaming import feeds


def one(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_number(spark):
    cases = {"-": None, "0.0.0.0": None, "inf": None, "nan": None, "5d": None, " 5 ": 5.0, "": None, "1e3": 1000.0, "-2.5": -2.5, None: None, "9" * 400: None}
    rows = one(spark, cases).select("x", C.number(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases


def test_normal_modes(spark):
    words = ["BENIGN", "benign", "Normal", "normal", " normal ", "0", "0.0", None, "ddos"]
    got = {m: [r[0] for r in one(spark, words).select(C.is_normal(F.col("x"), m)).collect()] for m in ("benign", "exact", "lower", "trim_lower")}
    assert got["benign"] == [True] + [False] * 8
    assert got["exact"] == [False, True, True, False, False, True, True, True, False]
    assert got["lower"] == [True, True, True, True, False, True, True, True, False]
    assert got["trim_lower"] == [True] * 8 + [False]


def test_limits(spark):
    half = one(spark, [0.5], "double").select(C.attack_decision(F.col("x")).alias("a"), C.attack_decision(F.col("x"), inclusive=False).alias("b"), C.confidence(F.col("x")).alias("c")).first()
    assert (half["a"], half["b"], half["c"]) == (1, 0, 0.5)
    assert [r[0] for r in one(spark, [0.95, 0.951], "double").select(C.severity(F.col("x"))).collect()] == ["WARNING", "CRITICAL"]
    assert [r[0] for r in one(spark, [99, 100], "int").select(C.badge(F.col("x"))).collect()] == ["99", "99+"]
    phi = spark.createDataFrame([("a", "f", 0.25), ("b", "f", 0.2), ("b", "g", 0.25), ("c", "f", 0.46)], "flow_key string, feature string, phi double")
    levels = {r["flow_key"]: r["level"] for r in explain.threat_level(phi).collect()}
    assert levels == {"a": "Low", "b": "Medium", "c": "High"}  # 0.4 and 0.6 themselves stay below


def test_missing_share_limit(spark):
    rows = [(str(i), None if i < 3 else "x", None if i < 4 else "x") for i in range(10)]
    df = spark.createDataFrame(rows, "k string, thirty string, forty string")
    assert clean.drop_sparse_columns(df).columns == ["k", "thirty"]


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF(" Label ", "label")
    assert clean.strip_headers(df).columns == ["Label", "label"]
    with pytest.raises(ValueError):
        clean.lower_headers(clean.strip_headers(df))


def test_ghost_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert clean.ghost_columns(df, {"a": 9, "b": 0}).first() == (9, 0)
    assert clean.ghost_columns(df, {"a": 9, "b": 0}, overwrite=False).first() == (1, 0)


def test_inf(spark):
    got = clean.inf_to_null(one(spark, [1.0, math.inf, -math.inf, math.nan, None], "double")).collect()
    assert [r[0] for r in got] == [1.0, None, None, None, None]


def test_scaler_population_and_constant(spark):
    df = spark.createDataFrame([("a", 1.0, 7.0), ("b", 2.0, 7.0), ("c", 4.0, 7.0)], "flow_key string, x double, y double")
    rows = {r["flow_key"]: r for r in features.apply_scaler(df, features.fit_scaler(df, ["x", "y"]), ["x", "y"]).collect()}
    assert rows["a"]["x"] == pytest.approx(-1.069, abs=1e-3) and rows["a"]["y"] == 0.0


def test_translate_keeps_unknown(spark):
    assert [r[0] for r in clean.translate_state(one(spark, ["CON", "ACC", None]).withColumnRenamed("x", "state")).collect()] == ["SF", "ACC", None]


def test_codepage_round_trip(spark):
    assert one(spark, ["Web Attack – XSS €"]).select(io.from_cp1252(io.to_cp1252(F.col("x")))).first()[0] == "Web Attack – XSS €"


def test_first_existing(spark):
    with pytest.raises(FileNotFoundError):
        io.first_existing(spark, [fresh_path(spark, "none")])


def test_splits_are_disjoint_and_steady(spark, sf_dir):
    rows = Views(spark, sf_dir).flows_raw.select("flow_key", "label")
    one, two = (sampling.split_stratified(rows.repartition(n)).toPandas().set_index("flow_key")["split"] for n in (1, 8))
    assert len(one) == rows.count() and one.index.is_unique
    assert one.sort_index().equals(two.sort_index())
    shares = sampling.split_stratified(rows).groupBy("label").agg(F.avg((F.col("split") == "test").cast("int")).alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r["s"] - 0.2) <= 1 / r["n"] for r in shares)


def test_smote_balances_inside_the_hull(spark, sf_dir):
    v = Views(spark, sf_dir)
    columns = ["duration", "src_pkts"]
    rows = v.flows_raw.select("flow_key", *[F.col(c).cast("double").alias(c) for c in columns], "label")
    rows = sampling.sample_n(rows.where("label = 1"), 100).unionAll(sampling.sample_n(rows.where("label = 0"), 350)).persist()
    made = sampling.smote(rows, columns)
    assert made.count() == 250 and made.select("flow_key").distinct().count() == 250
    low, high = (rows.where("label = 1").agg(*[f(c) for c in columns]).first() for f in (F.min, F.max))
    got = made.agg(*[F.min(c) for c in columns], *[F.max(c) for c in columns]).first()
    assert all(got[i] >= low[i] - 1e-9 and got[i + 2] <= high[i] + 1e-9 for i in range(2))


def test_neighbours_are_exact_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK", 40)
    rng = random.Random(6)
    # Copies of one place, a lattice with ties, and lonely points far from all others.
    at = [(3.0, 3.0)] * 20 + [(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(200)] + [(rng.gauss(0, 30), rng.gauss(0, 30)) for _ in range(150)] + [(900.0, 0.0), (0.0, -5000.0)]
    rows = [(f"k{i}", *p) for i, p in enumerate(at)]
    got = {r["flow_key"]: r["others"] for r in sampling.neighbours(spark.createDataFrame(rows, "flow_key string, a double, b double"), ["a", "b"]).collect()}
    want = {r[0]: [o[0] for o in sorted(rows, key=lambda o: ((r[1] - o[1]) * (r[1] - o[1]) + (r[2] - o[2]) * (r[2] - o[2]), o[0])) if o[0] != r[0]][:5] for r in rows}
    assert got == want


def test_smote_train_makes_classes_equal(spark, sf_dir):
    train = sampling.split_stratified(Views(spark, sf_dir).flows_raw.select("flow_key", "label")).where("split = 'train'")
    n = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    made = catalog.QUERIES["smote_train"](spark, sf_dir)
    assert n[0] - n[1] > 1000 and made.count() == n[0] - n[1] == made.select("flow_key").distinct().count()
    one = spark.createDataFrame([("x", 1.0, 1), ("y", 2.0, 0), ("z", 3.0, 0)], "flow_key string, a double, label int")
    assert [tuple(r) for r in sampling.smote(one, ["a"]).collect()] == [("x~1", 1.0, 1)]


def test_forest_floor_saved_copy_and_contributions(spark, sf_dir):
    v = Views(spark, sf_dir)
    parts = sampling.split_stratified(features.featurise(v.flows_raw, ("flow_key", "label"))).persist()
    train, test = (parts.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    assert train.join(test, "flow_key").count() == 0
    model = models.forest_fit(train, trees=6, depth=6, bins=32)
    scored = models.forest_proba(test, model)
    found = models.measures(scored, "p_rf")
    majority = 1 - test.agg(F.avg("label")).first()[0]
    assert found["auc"] > 0.85 and found["accuracy"] > majority
    path = fresh_path(spark, "model")
    models.save(model, path)
    both = scored.select("flow_key", "p_rf").join(models.forest_proba(test, models.load(path)).select("flow_key", F.col("p_rf").alias("q")), "flow_key")
    assert both.where("p_rf <> q").count() == 0
    few = profile.preview(test, "flow_key", 20)
    total = explain.shap_values(few, model, S.FEATURES).groupBy("flow_key").agg(F.sum("phi").alias("s"))
    assert total.join(models.forest_proba(few, model), "flow_key").where("abs(s - p_rf) > 1e-9").count() == 0


def test_early_stop_keeps_the_best(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = features.featurise(v.flows_raw, ("flow_key", "label"))
    rows = features.apply_scaler(rows, features.fit_scaler(rows, S.FEATURES), S.FEATURES)
    parts = sampling.split_tail(rows, ["flow_key"], 0.2)
    _, trace = models.early_stop(parts.where("part = 'fit'"), parts.where("part = 'validation'"), hidden=4, most=2, iterations=3)
    trace = trace.collect()
    assert [r["loss"] for r in trace if r["best"]] == [min(r["loss"] for r in trace)]


def test_planted_rule_is_found(spark):
    rows = [(i, float(i % 100), float(i % 37), int(i % 100 > 80)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, a double, b double, label int")
    rules = explain.mine_rules(df, ["a", "b"], "label", rules=1, conditions=1, bins=20)
    assert rules[0][0][0] == "a" and rules[0][0][1] == ">" and 75 <= rules[0][0][2] <= 85
    assert explain.apply_rules(df, rules).first()["precision"] > 0.75


def test_planted_linear_model_is_recovered(spark):
    rows = spark.createDataFrame([(str(i), float(i % 20), float((i * 7) % 13)) for i in range(400)], "flow_key string, a double, b double")
    predict = lambda df: df.withColumn("p", F.when(F.col("a") > 15, 1.0).otherwise(0.0))
    found = explain.lime_local(rows.where("flow_key = '19'"), rows, ["a", "b"], predict, samples=800).collect()
    assert found[0]["feature"] == "a" and found[0]["weight"] > 0.3


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)], "s double, label int")
    assert evaluation.roc_auc(df, "s").first()[0] == pytest.approx(0.875)


def test_empty_report(spark):
    df = spark.createDataFrame([], "label int, prediction int")
    assert all(r["precision"] == 0.0 for r in evaluation.class_report(df).collect())


def test_alert_sink_is_idempotent(spark, sf_dir):
    v = Views(spark, sf_dir)
    folder, out, state = (fresh_path(spark, n) for n in ("a", "b", "c"))
    v.alerts_raw.limit(30).write.parquet(folder)
    for _ in range(2):
        feeds.alert_sink(feeds.folder_feed(spark, folder), out, state)
    assert spark.read.parquet(out).count() == 30


def _feed(spark, sf_dir):
    """Flows as a stream, closed by a row far in the future."""
    v = Views(spark, sf_dir)
    rows = v.flows_raw.select("flow_key", "ts", "src_ip", "dst_ip", "dst_port", "conn_state", "duration", "src_bytes", "dst_bytes", "src_pkts")
    last = rows.limit(1).withColumn("ts", F.lit("2100-01-01").cast("timestamp_ntz")).withColumn("dst_ip", F.lit("end")).withColumn("src_ip", F.lit("end"))
    folder = fresh_path(spark, "feed")
    rows.coalesce(1).write.parquet(folder)
    last.coalesce(1).write.mode("append").parquet(folder)
    return v, feeds.folder_feed(spark, folder)


def test_flood_stream_equals_batch(spark, sf_dir):
    v, feed = _feed(spark, sf_dir)
    got = feeds.drained(feeds.flood(feed, least_flows=3, least_bytes=1000)).where("dst_ip <> 'end'").select("dst_ip", "window_start", "flows").toPandas()
    want = detectors.detect_flood(v.flows_raw, least_flows=3, least_bytes=1000).select("dst_ip", "window_start", "flows").toPandas()
    order = ["dst_ip", "window_start"]
    assert got.sort_values(order).reset_index(drop=True).equals(want.sort_values(order).reset_index(drop=True))


def test_streams_run(spark, sf_dir):
    _, feed = _feed(spark, sf_dir)
    assert feeds.drained(feeds.scan(feed)).count() > 0
    assert feeds.drained(feeds.volumes(feed)).count() > 0
    assert feeds.drained(feeds.bruteforce(feed, least_tries=1)).count() > 0


def test_newest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "id string, timestamp int")
    assert [r["id"] for r in alerts.newest(df, 2).collect()] == ["b", "a"]


def test_numbers_by_kind(spark):
    df = spark.createDataFrame([("0x1p3", 3, 2.5, math.inf), ("\t7 ", None, math.nan, 1.0), ("1f", 4, None, -0.0)], "s string, i int, d double, e double")
    got = df.select(*[x.alias(c) for c, x in C.numbers_of(df, ["s", "i", "d", "e", "absent"]).items()]).collect()
    assert [tuple(r) for r in got] == [(None, 3.0, 2.5, None), (7.0, None, None, 1.0), (None, 4.0, None, -0.0)]


def test_quantiles_equal_numpy(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(profile, "FEW", 20)
    monkeypatch.setattr(profile, "PARTS", 8)
    rng = np.random.default_rng(3)
    a, b, c = rng.lognormal(0, 3, 3000), rng.integers(0, 4, 3000).astype(float), np.r_[np.zeros(2900), rng.normal(0, 1e9, 100)]
    df = spark.createDataFrame([(*map(float, t), None, math.nan) for t in zip(a, b, c)], "a double, b double, c double, none double, nan double")
    for q in (0.0, 0.1, 0.5, 0.95, 0.9667, 1.0):
        got = profile.quantiles(df, ["a", "b", "c", "none", "nan"], q)
        for name, x in (("a", a), ("b", b), ("c", c)):
            assert got[name] == pytest.approx(np.quantile(x, q), rel=1e-9, abs=1e-9)
        assert got["none"] is None and got["nan"] is None
    assert profile.quantiles(df.limit(0), ["a"], 0.5) == {"a": None}


def test_a_busy_source_is_split(spark):
    """Streaks and gaps of one source that lies in many ranges, against a loop over its rows."""
    rng = random.Random(9)
    rows = [(f"k{i:05d}", "s" if i % 50 else "t", rng.randrange(5), rng.choice(["REJ", "S0", "SF"]), 1_700_000_000 + rng.randrange(2000), float(rng.randrange(100))) for i in range(3000)]
    df = spark.createDataFrame(rows, "flow_key string, src_ip string, dst_port int, conn_state string, at long, src_bytes double")
    df = df.withColumn("dst_bytes", F.lit(0.0)).withColumn("ts", F.timestamp_seconds("at")).repartition(16)
    streaks, gaps = [], {}
    for source in ("s", "t"):
        run, last = [], None
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[4], r[0]))
        for r in [*mine, (None, source, 0, "SF", 0, 0.0)]:
            if r[3] == "REJ":
                run.append(r)
                continue
            if len(run) >= 3 and len({x[2] for x in run}) >= 2:
                streaks.append((source, len(run), len({x[2] for x in run})))
            run = []
        times = [r[4] for r in mine if r[3] == "S0"]
        between = [y - x for x, y in zip(times, times[1:])]
        gaps[source] = (len(times), sum(between) / len(between))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    got = detectors.detect_scan(df)
    assert sorted((r["src_ip"], r["tries"], r["ports"]) for r in got.collect()) == sorted(streaks)
    found = {r["src_ip"]: (r["tries"], r["avg_gap"]) for r in detectors.detect_beacon(df, most_variation=100.0, least_spike=0.0).collect()}
    assert {k: (n, pytest.approx(m)) for k, (n, m) in gaps.items()} == found
    assert detectors._in_ranges(df).where("src_ip = 's'").select("part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scoring_stream_equals_batch(spark, sf_dir):
    v = Views(spark, sf_dir)
    score, folder = catalog.voters(v), fresh_path(spark, "feed")
    flows = v.flows_raw.drop("label")
    flows.write.parquet(folder)
    got = feeds.drained(feeds.score_stream(feeds.folder_feed(spark, folder), score), name="scores")
    want = alerts.build_alerts(score(flows))
    assert got.count() == want.count() > 0 and got.select("id", "confidence", "attack_type").exceptAll(want.select("id", "confidence", "attack_type")).count() == 0


def test_model_queries_hold_their_invariants(spark, sf_dir):
    both = catalog.QUERIES["neural_predict"](spark, sf_dir)
    assert both.where("p_nn < 0 or p_nn > 1 or strict > inclusive or inclusive <> cast(p_nn >= 0.5 as int)").count() == 0
    for name, models_of in (("neural_finetune", {"base", "tuned"}), ("transfer_eval", {"zero_shot", "refit"})):
        rows = catalog.QUERIES[name](spark, sf_dir).collect()
        assert {r["model"] if "model" in r else r["regime"] for r in rows} == models_of and all(0 <= r["value"] <= 1 for r in rows)
    assert {r["metric"] for r in catalog.QUERIES["global_model"](spark, sf_dir).collect()} == {"accuracy", "auc"}
    assert catalog.QUERIES["throughput"](spark, sf_dir).where("rows > 0 and seconds > 0").count() == 1
    loaded = catalog.QUERIES["model_roundtrip"](spark, sf_dir)
    assert loaded.count() > 0 and loaded.where("p_rf <> p_loaded").count() == 0


END = ("end", "S0", 4_000_000_000)


def _handshakes(spark, rows, files=1):
    """(src_ip, conn_state, seconds) as a feed of so many files, each of some rows of any time, closed by a row far in the future."""
    folder = fresh_path(spark, "beacon")
    for i in range(files):
        part = spark.createDataFrame(rows[i::files], "src_ip string, conn_state string, at long")
        part.select("src_ip", "conn_state", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([END], "src_ip string, conn_state string, at long").select("src_ip", "conn_state", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    return feeds.folder_feed(spark, folder, per_trigger=1)


def test_beacon_stream_gathers_gaps(spark):
    rows = [("a", "S0", 1_700_000_000 + 60 * i) for i in range(6)] + [("a", "SF", 1_700_000_001), ("b", "S0", 1_700_000_000)]
    got = feeds.drained(feeds.beacon(_handshakes(spark, rows)), "update", "beacon").collect()
    assert [(r["src_ip"], r["gaps"], r["avg_gap"], r["variation"]) for r in got] == [("a", 5, 60.0, 0.0)]


def test_beacon_stream_equals_batch_with_shuffled_files(spark):
    rng = random.Random(8)
    rows = [(f"s{rng.randrange(5)}", rng.choice(["S0", "SH", "SF"]), 1_700_000_000 + rng.randrange(2_000_000)) for _ in range(400)]
    got = feeds.drained(feeds.beacon(_handshakes(spark, rows, files=5), "60 days"), "update", "beacon").collect()
    last = {r["src_ip"]: r for r in sorted(got, key=lambda r: r["gaps"])}
    assert last.keys() == {r[0] for r in rows}
    for source, r in last.items():
        at = sorted(t for s, state, t in rows if s == source and state != "SF")
        gaps = [b - a for a, b in zip(at, at[1:])]
        mean = sum(gaps) / len(gaps)
        assert r["gaps"] == len(gaps) and r["avg_gap"] == pytest.approx(mean)
        assert r["variation"] == pytest.approx((sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean)


def test_alert_sink_drops_repeats_across_batches_and_compacts(spark, sf_dir):
    rows = Views(spark, sf_dir).alerts_raw.orderBy("id").limit(30).persist()
    folder, out, state = (fresh_path(spark, n) for n in ("a", "b", "c"))
    for i in range(6):  # ten alerts a file, every second file a repeat
        rows.offset(i // 2 * 10).limit(10).coalesce(1).write.mode("append").parquet(folder)
    feeds.alert_sink(feeds.folder_feed(spark, folder, per_trigger=1), out, state)
    assert spark.read.parquet(out).count() == 30
    last = feeds._folders(spark, out)[-1][0]  # the six files and what the state store does at the end
    assert last >= 5
    want = [r["id"] for r in alerts.newest(rows, 12).collect()]
    feeds.compact_alerts(spark, out, last + 1, keep=12)
    assert [n for n, _ in feeds._folders(spark, out)] == [-last - 1]
    assert [r["id"] for r in feeds.alert_log(spark, out).collect()] == want
    # what a sink goes on with lies beside what was kept, and is compacted with it
    rows.limit(1).withColumn("id", F.lit("new")).withColumn("timestamp", F.lit("9999-01-01 00:00:00").cast(rows.schema["timestamp"].dataType)).write.parquet(f"{out}/batch={last + 1}")
    feeds.compact_alerts(spark, out, last + 2, keep=12)
    assert [r["id"] for r in feeds.alert_log(spark, out).collect()] == ["new", *want[:11]]


def test_late_rows_are_counted(spark):
    folder = fresh_path(spark, "late")
    days = ["2020-01-01", "2020-02-01", "2020-01-02", "2020-01-03", "2020-03-01"]
    for d in days:  # rows are late by the watermark of the batch before: the third still counts, the fourth doesn't
        spark.createDataFrame([(d, d)], "flow_key string, d string").select("flow_key", F.col("d").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    with feeds.Lateness().listening(spark) as late:
        kept = feeds.drained(feeds.volumes(feeds.counted(feeds.folder_feed(spark, folder, per_trigger=1)))).collect()
    assert (late.seen(), late.dropped()) == (5, 1)
    assert [str(r["window_start"])[:10] for r in sorted(kept)] == ["2020-01-01", "2020-01-02", "2020-02-01"]


def test_attacks_come_first_in_the_stream(spark, sf_dir):
    flows = Views(spark, sf_dir).flows_raw.select("flow_key", "type", "label")
    feed = feeds.ordered_feed(sampling.inject_attacks(flows, 20, "DDoS"), fresh_path(spark, "queue"))
    seen = []
    query = feed.writeStream.foreachBatch(lambda df, n: seen.append((n, df.count(), sorted(r[0] for r in df.select("priority").distinct().collect()))))
    query.option("checkpointLocation", fresh_path(spark, "queue-state")).trigger(availableNow=True).start().awaitTermination()
    order = [p for _, _, p in sorted(seen)]
    assert order == sorted(order) and all(len(p) <= 1 for p in order)
    assert sum(n for _, n, p in seen if p == [0]) == 20 and sum(n for _, n, _ in seen) == 20 + flows.where("label = 0").count()


def test_categories_are_few(spark):
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") % 1000).alias("x"), F.col("id").cast("string").alias("y"))
    assert features.categories(df, "x") == sorted(f"v{i}" for i in range(1000))
    with pytest.raises(ValueError, match="more than 1000"):
        features.categories(df, "y")
