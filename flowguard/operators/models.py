"""Two voters over flow features, their fusion and their adaptation to other domains.

The forest regresses on the 0/1 label: for two classes its variance split is the Gini split, and a mean leaf is P(attack).
The second voter is a convolutional network over the features in their order (`networks`).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions.columns import attack_decision, numbers_of
from flowguard.functions.schema import FEATURES, NUMERIC
from flowguard.operators import clean, evaluation, features, forests, networks, sampling
from flowguard.operators.forests import Forest
from flowguard.sources.scratch import discard, written


def steady(df: DataFrame, keys: list[str], rows: int = 100_000, least: int = 8) -> DataFrame:
    """The same rows in the same partitions, of about so many rows, and order each time: forests are reproducible only then."""
    return df.repartition(max(least, -(-df.count() // rows)), *keys).sortWithinPartitions(*keys)


def collapsed(train: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """(columns..., label, weight): equal rows as one with their number. Equal rows fall into the same leaves, so a tree grown
    on all of them has the same splits; where trees draw their rows, they draw distinct ones."""
    return train.groupBy(*columns, label).agg(F.count("*").cast("double").alias("weight"))


def forest_fit(train: DataFrame, columns: list[str] = FEATURES, label: str = "label", trees: int = 100, depth: int = 15, bins: int = 128, seed: int = 42, collapse: bool = True) -> Forest:
    """train has numeric columns and a 0/1 label. Depth is at most 30. collapse: grow on distinct rows with weights."""
    if collapse:
        rows = collapsed(train, columns, label).withColumn("_id", F.xxhash64(*columns, label))
    else:
        rows = steady(train.select(*columns, label, F.lit(1.0).alias("weight")), [*columns, label]).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows.select("_id", F.col(label).cast("double").alias("_y"), F.col("weight").alias("_w"), *columns), "distinct")
    model = forests.fit(rows, columns, trees, depth, bins, seed)
    discard(rows)
    return model


def forest_proba(df: DataFrame, model: Forest, columns: list[str] = FEATURES, to: str = "p_rf") -> DataFrame:
    """P(attack), between 0 and 1."""
    return model.proba(df, columns, to)


def forest_predict(df: DataFrame, model: Forest, columns: list[str] = FEATURES) -> DataFrame:
    """Class 1 above one half; a tie is class 0."""
    return forest_proba(df, model, columns).withColumn("prediction", attack_decision(F.col("p_rf"), 0.5, inclusive=False))


def neural_fit(train: DataFrame, columns: list[str] = FEATURES, hidden: int = 128, rounds: int = 20, kernels: tuple[int, int] = (64, 128), seed: int = 42, initial: networks.Network | None = None, step: float = 3e-3, label: str = "label") -> networks.Network:
    """train has scaled columns. initial: a network to go on from."""
    return networks.train(train, columns, label=label, start=initial, kernels=kernels, hidden=hidden, epochs=rounds, rate=step, seed=seed)[0]


def neural_proba(df: DataFrame, model: networks.Network, columns: list[str] = FEATURES, to: str = "p_nn") -> DataFrame:
    """P(attack) by the second voter, between 0 and 1."""
    return networks.proba(df, model, columns, to)


def log_loss(df: DataFrame, p: str = "p_nn", label: str = "label") -> float:
    safe = F.greatest(F.least(F.col(p), F.lit(1 - 1e-12)), F.lit(1e-12))
    return df.agg(F.avg(-F.when(F.col(label) == 1, F.log(safe)).otherwise(F.log(1 - safe)))).first()[0]


def early_stop(train: DataFrame, validation: DataFrame, columns: list[str] = FEATURES, hidden: int = 128, most: int = 20, patience: int = 3, iterations: int = 8, kernels: tuple[int, int] = (64, 128), seed: int = 42, initial: networks.Network | None = None, step: float = 3e-3):
    """(best network, trace): epochs of `iterations` steps, one after the other with the optimizer's state carried on, until the
    validation loss hasn't fallen for `patience` epochs. trace: (round, loss, train_loss, best)."""
    best, found = networks.train(train, columns, validation, start=initial, kernels=kernels, hidden=hidden, epochs=most, patience=patience, steps=iterations, rate=step, seed=seed)
    low = min(loss for _, _, loss in found)
    rows = [(i, loss, fit_loss, loss == low) for i, fit_loss, loss in found]
    return best, train.sparkSession.createDataFrame(rows, "round int, loss double, train_loss double, best boolean")


def neural_finetune(base: networks.Network, study: DataFrame, columns: list[str] = FEATURES, validation: DataFrame | None = None, rounds: int = 20, step: float = 1e-4, patience: int = 3) -> networks.Network:
    """Go on from the base network by small steps on the new domain's study part, with early stopping if a validation part is given."""
    return networks.train(study, columns, validation, start=base, epochs=rounds, rate=step, patience=patience)[0]


def soft_vote(df: DataFrame, a: str = "p_rf", b: str = "p_nn", threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """score: the mean of both voters' P(attack); prediction by the threshold."""
    out = df.withColumn("score", (F.col(a) + F.col(b)) / 2)
    return out.withColumn("prediction", attack_decision(F.col("score"), threshold, inclusive))


def zero_shot_argmax(df: DataFrame, a: str = "p_rf") -> DataFrame:
    """For comparison: adding one voter's single column to both classes of the other leaves the other's decision."""
    return df.withColumn("prediction", attack_decision(F.col(a), 0.5, inclusive=False))


def model_name(c: Column) -> Column:
    """The stored model of a choice: ton_iot and omni are kept under their names, any other one fine-tuned."""
    return F.when(c.isin("ton_iot", "omni"), c).otherwise(F.concat(c, F.lit("_finetuned")))


#: The names of stored models by domain, and what a status board calls them.
STORED_AS = {"ton": "ton_iot", "bot": "bot_iot", "cic": "cic_ids2017"}
GLOBAL, GLOBAL_TITLE, TITLE = "omni", "OMNI (GLOBAL)", "Hybrid Ensemble (RF+NN) - "


def model_path(root: str, choice: str) -> str:
    """Where the forest of a choice is stored."""
    return f"{root}/rf_model_{choice if choice in ('ton_iot', GLOBAL) else choice + '_finetuned'}"


def stored_models(spark: SparkSession, root: str) -> DataFrame:
    """(model, path, features, trees, depth, saved) of every forest stored under root, read from what was saved with it."""
    kind = "class string, timestamp long, numFeatures int, numTrees int, paramMap struct<maxDepth: int, numTrees: int>"
    found = spark.read.text(f"{root}/rf_model_*/stages/*/metadata").select(F.col("_metadata.file_path").alias("file"), F.from_json("value", kind).alias("m"))
    name = F.regexp_extract("file", "/rf_model_([^/]+)/stages/", 1)
    path = F.regexp_extract("file", "^(.*/rf_model_[^/]+)/stages/", 1)
    forests = found.where(F.col("m.class").contains("RandomForest"))
    return forests.select(name.alias("model"), path.alias("path"), F.col("m.numFeatures").alias("features"), F.col("m.numTrees").alias("trees"), F.col("m.paramMap.maxDepth").alias("depth"), F.timestamp_millis("m.timestamp").alias("saved"))


def registry(flows: DataFrame, root: str) -> DataFrame:
    """(choice, model, path, features, trees, depth, saved, status, rows, attacks): for each domain of flows (domain, label, ...)
    and for all together, omni, the model stored for it, what a status board calls it, and the rows behind it. A choice without
    a stored model has nulls in its place."""
    counts = flows.rollup("domain").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("attacks"), F.grouping("domain").alias("all"))
    names = F.create_map(*[F.lit(x) for pair in STORED_AS.items() for x in pair])
    choice = F.when(F.col("all") == 1, GLOBAL).otherwise(F.coalesce(names[F.col("domain")], F.col("domain")))
    frame = counts.select(choice.alias("choice"), "rows", "attacks").withColumn("model", model_name(F.col("choice")))
    shown = F.when(F.col("choice") == GLOBAL, GLOBAL_TITLE).otherwise(F.upper("choice"))
    joined = frame.join(stored_models(flows.sparkSession, root), "model", "left")
    return joined.select("choice", "model", "path", "features", "trees", "depth", "saved", F.concat(F.lit(TITLE), shown).alias("status"), "rows", "attacks")


def save(model: Forest, path: str) -> None:
    model.store(path)


def load(path: str) -> Forest:
    return Forest(path)


def global_frame(parts: dict[str, DataFrame], mode: str = "lower", cap: int | None = None) -> DataFrame:
    """All domains in one matrix of 14 numbers and 14 zeros: labels by the given rule of what is normal, numbers coerced, absent columns and bad values 0. cap: rows of each domain by hash, as an option."""
    made = {}
    for domain, df in parts.items():
        rows = sampling.sample_n(df, cap) if cap else df
        label = clean.resolve_label(rows)
        rows = clean.label_of(rows.withColumn("_y", label).drop("label", "Label"), "_y", mode)
        rows = clean.ghost_columns(rows, {c: 0 for c in NUMERIC}, overwrite=False)
        made[domain] = rows.select("flow_key", *[F.coalesce(x, F.lit(0.0)).alias(c) for c, x in numbers_of(rows, NUMERIC).items()], *[F.lit(0.0).alias(c) for c in FEATURES[14:]], "label")
    return clean.union_domains(made)


def measures(scored: DataFrame, score: str, label: str = "label") -> dict[str, float]:
    scored = written(scored.select(score, label), "scored")  # both measures read it: rows are scored once
    marked = scored.withColumn("prediction", attack_decision(F.col(score), 0.5))
    found = {"accuracy": evaluation.accuracy(marked, label).first()[0], "auc": evaluation.roc_auc(scored, score, label).first()[0]}
    discard(scored)
    return found


def transfer_eval(zero: Forest, targets: dict[str, tuple[Forest, DataFrame]], spark: SparkSession, columns: list[str] = FEATURES) -> DataFrame:
    """(domain, regime, metric, value): the base domain's forest on each target as it is, and the one fitted on the target's
    study part; both are measured on the exam part, which neither has seen. targets: domain -> (forest, exam part)."""
    rows = []
    for domain, (own, exam) in targets.items():
        for regime, model in (("zero_shot", zero), ("refit", own)):
            rows += [(domain, regime, k, float(v)) for k, v in measures(forest_proba(exam, model, columns), "p_rf").items()]
    return spark.createDataFrame(rows, "domain string, regime string, metric string, value double")


def throughput(df: DataFrame, work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(step, rows, seconds) of a transformation whose result is thrown away."""
    start = time.time()
    work(df).write.format("noop").mode("overwrite").save()
    return df.sparkSession.createDataFrame([(name, df.count(), time.time() - start)], "step string, rows long, seconds double")
