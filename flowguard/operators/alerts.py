"""Alerts, their roll-ups and what a status board shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowguard.functions.columns import severity

_TIME = "yyyy-MM-dd HH:mm:ss"


def attack_type(df: DataFrame, domain: str = "domain") -> Column:
    """A flagged flow's class: type, else Label, else label. Words for normal traffic give Anomaly Detected, a bare 1 the domain's default."""
    names = [F.col(c).cast("string") for c in ("type", "Label", "label") if c in df.columns]
    word = F.coalesce(*names, F.lit("Malicious Flow"))
    default = F.concat(F.lit("Malicious Flow ("), F.col(domain), F.lit(")")) if domain in df.columns else F.lit("Malicious Flow")
    return F.when(F.lower(word).isin("normal", "nan", "benign", "0", "0.0"), "Anomaly Detected").when(word.isin("1", "1.0"), default).otherwise(word)


def host(c: Column) -> Column:
    return F.coalesce(c, F.lit("Unknown"))


def build_alerts(flows: DataFrame, confidence: str = "confidence", prediction: str = "prediction", model: str = "omni") -> DataFrame:
    """The alert record of every flow predicted 1. Its id is the hash of the flow's key."""
    hit = flows.where(F.col(prediction) == 1)
    src = host(F.col("src_ip")) if "src_ip" in flows.columns else F.lit("Unknown")
    dst = host(F.col("dst_ip")) if "dst_ip" in flows.columns else F.lit("Unknown")
    return hit.select(
        F.md5(F.col("flow_key")).alias("id"), F.date_format("ts", _TIME).alias("timestamp"), src.alias("source_ip"), dst.alias("target_ip"), dst.alias("dest_ip"),
        attack_type(flows).alias("attack_type"), F.col(confidence).alias("confidence"), F.lit(f"Alerted (RF-{model.upper()})").alias("status"),
    )


def with_severity(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("severity", severity(F.col("confidence")))


def threshold_filter(alerts: DataFrame, enabled: bool = True, percent: int = 85) -> DataFrame:
    return alerts.where(F.lit(enabled) & (F.col("confidence") >= percent / 100))


def counters(flows: DataFrame, attack: Column) -> DataFrame:
    return flows.agg(F.count("*").alias("processed_packets"), F.count_if(attack).alias("threats_detected"))


def newest(df: DataFrame, n: int, time: str = "timestamp", key: str = "id") -> DataFrame:
    """The n newest rows: a top-k."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def volume_last(events: DataFrame, width: str = "1 day", n: int = 10, time: str = "ts") -> DataFrame:
    """(window_start, flows) of the newest n windows."""
    counts = events.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w")).agg(F.count("*").alias("flows"))
    return counts.select(F.col("w.start").alias("window_start"), "flows").orderBy(F.desc("window_start")).limit(n)


def host_rollup(alerts: DataFrame, n: int = 15) -> DataFrame:
    """(id, threats, last_seen, is_core) of each source among the newest n alerts, and the gateway."""
    hosts = newest(alerts, n).groupBy("source_ip").agg(F.count("*").alias("threats"), F.date_format(F.max("timestamp"), _TIME).alias("last_seen"))
    hosts = hosts.select(F.col("source_ip").alias("id"), "threats", "last_seen", F.lit(False).alias("is_core"))
    gateway = alerts.sparkSession.range(1).select(F.lit("core").alias("id"), F.lit(0).cast("long").alias("threats"), F.lit("Now").alias("last_seen"), F.lit(True).alias("is_core"))
    return hosts.unionByName(gateway)


def graph_edges(rollup: DataFrame) -> DataFrame:
    """(source, target, hot): every host to the gateway, hot above two threats."""
    return rollup.where("not is_core").select(F.col("id").alias("source"), F.lit("core").alias("target"), (F.col("threats") > 2).alias("hot"))


def search(alerts: DataFrame, text: str) -> DataFrame:
    found = F.lower(F.concat_ws(" ", "id", "source_ip", "target_ip", "attack_type"))
    return alerts.where(F.contains(found, F.lit(text.lower())))


def alert_line(alerts: DataFrame) -> DataFrame:
    """(id, level, line) for a log: warn above 95%, else alert."""
    line = F.format_string("Flow: %s → %s | Type: %s | Conf: %.1f%%", F.col("source_ip"), F.col("target_ip"), F.col("attack_type"), F.col("confidence") * 100)
    return alerts.select("id", F.when(F.col("confidence") > 0.95, "warn").otherwise("alert").alias("level"), line.alias("line"))


def status_snapshot(flows: DataFrame, events: DataFrame, contributions: DataFrame, model: str = "omni", domain: str = "omni") -> DataFrame:
    """One row for a status board: texts, counters, the newest ten volumes from old to new, the newest flow's top three contributions."""
    name = "OMNI (GLOBAL)" if model == "omni" else domain.upper()
    volumes = volume_last(events).agg(F.transform(F.sort_array(F.collect_list(F.struct("window_start", "flows"))), lambda x: x["flows"]).alias("chart_data"))
    top = latest_attribution(contributions).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("feature").alias("f"), F.col("phi").alias("v")))), lambda x: F.struct(x["f"].alias("f"), x["v"].alias("v"))).alias("latest_shap"))
    row = counters(flows, F.col("label") == 1).crossJoin(F.broadcast(volumes)).crossJoin(F.broadcast(top))
    return row.select(F.lit("Active").alias("node_status"), F.lit(f"Hybrid Ensemble (RF+NN) - {name}").alias("core_model"), "processed_packets", "threats_detected", "chart_data", "latest_shap")


def latest_attribution(contributions: DataFrame, n: int = 3) -> DataFrame:
    """(flow_key, place, feature, phi): the n largest contributions of the newest flow."""
    last = contributions.agg(F.max(F.struct("ts", "flow_key"))["flow_key"].alias("flow_key"))
    place = F.row_number().over(W.partitionBy("flow_key").orderBy(F.desc("phi"), "feature"))
    return contributions.join(F.broadcast(last), "flow_key").withColumn("place", place).where(F.col("place") <= n).select("flow_key", "place", "feature", "phi")
