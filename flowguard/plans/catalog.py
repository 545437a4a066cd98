"""Every registered query of the flow engine, each beside its equal in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions import columns as C
from flowguard.functions import schema as S
from flowguard.operators import alerts, clean, detectors, evaluation, explain, features, models, networks, profile, sampling
from flowguard.plans.fixtures import Views, with_views
from flowguard.sources import flows as io
from flowguard.sources.scratch import fresh_path, open_folders, written
from flowguard.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Views under its name, with its SQL."""

    def register(f: Callable[[Views], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[key] = with_views(sql)
        return f

    return register


# Columns of the raw feed that a CSV carries as text without loss in either engine.
_TEXT = ["flow_key", "src_ip", "dst_ip", "proto", "conn_state", "src_bytes", "dst_bytes", "service", "type", "domain"]
_TEXT_SQL = ", ".join(_TEXT)


def _csv(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


def _num(c: str) -> str:
    """SQL of columns.number for the fixture's texts."""
    return f"CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') THEN TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) END"


# --- scans, sources, sinks


@query(f"SELECT {_TEXT_SQL} FROM flows_raw")
def scan_flows(v):
    return io.read_flows(v.spark, _csv(v.flows_raw.select(*_TEXT), "flows"), _TEXT)


@query("""SELECT flow_key, state, CAST(NULL AS VARCHAR) AS "Label", proto FROM flows_bot UNION ALL SELECT flow_key, NULL, Label, NULL FROM flows_cic""")
def scan_glob_union(v):
    bot, cic = _csv(v.flows_bot.select("flow_key", "state", "proto"), "bot"), _csv(v.flows_cic.select("flow_key", "Label"), "cic")
    return io.read_many(v.spark, [(bot, ["flow_key", "state", "proto"]), (cic, ["flow_key", "Label"])]).drop("source")


@query("SELECT flow_key, concat('Web Attack – ', type) AS label FROM flows_raw WHERE domain = 'cic'")
def scan_encoding(v):
    path = fresh_path(v.spark, "codepage")
    text = F.concat(F.lit("Web Attack – "), "type").alias("label")
    v.flows_raw.where("domain = 'cic'").select("flow_key", io.to_cp1252(text).alias("label")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return io.read_flows(v.spark, path, ["flow_key", "label"], "ISO-8859-1").withColumn("label", io.from_cp1252(F.col("label")))


@query("SELECT flow_key, type FROM flows_raw WHERE domain = 'bot'")
def scan_first_chunk(v):
    path = fresh_path(v.spark, "chunks")
    with open_folders(v.spark):
        v.flows_raw.select("flow_key", "type", "domain").write.partitionBy("domain").option("header", True).csv(path)
    return io.read_flows(v.spark, io.first_path(v.spark, f"{path}/domain=*"), ["flow_key", "type"])


_MAPPED_SQL = """
SELECT flow_key, CAST(sbytes AS DOUBLE) AS src_bytes, CAST(dbytes AS DOUBLE) AS dst_bytes, CAST(spkts AS DOUBLE) AS src_pkts, CAST(dpkts AS DOUBLE) AS dst_pkts,
 CAST(dur AS DOUBLE) AS duration, CAST(TnBPSrcIP AS DOUBLE) AS src_ip_bytes, CAST(TnBPDstIP AS DOUBLE) AS dst_ip_bytes,
 CASE state WHEN 'CON' THEN 'SF' WHEN 'RST' THEN 'RSTR' WHEN 'REQ' THEN 'S0' WHEN 'INT' THEN 'OTH' WHEN 'FIN' THEN 'SF' WHEN 'URP' THEN 'OTH' ELSE state END AS conn_state,
 proto, 0 AS dns_qclass, 0 AS dns_qtype, 0 AS dns_rcode, CAST(attack AS INTEGER) AS label, 'bot' AS domain FROM flows_bot
UNION ALL
SELECT flow_key, CAST(total_length_of_fwd_packets AS DOUBLE), CAST(total_length_of_bwd_packets AS DOUBLE), CAST(total_fwd_packets AS DOUBLE), CAST(total_backward_packets AS DOUBLE),
 CAST(flow_duration AS DOUBLE), 0.0, 0.0, 'OTH', 'other', 0, 0, 0, CASE WHEN Label = 'BENIGN' THEN 0 ELSE 1 END, 'cic' FROM flows_cic"""


def _cic(v) -> DataFrame:
    return v.flows_cic.withColumnRenamed("Label", "label_text").withColumn("label", F.when(C.is_normal(F.col("label_text"), "benign"), 0).otherwise(1)).drop("label_text")


def _mapped(v) -> DataFrame:
    return clean.union_domains({"bot": clean.to_mapped(v.flows_bot, "bot"), "cic": clean.to_mapped(_cic(v), "cic")})


@query(_MAPPED_SQL)
def write_mapped(v):
    path = fresh_path(v.spark, "mapped")
    io.write_mapped(_mapped(v), path)
    return v.spark.read.parquet(path)


_SPLIT_SQL = """
, placed AS (SELECT flow_key, label, row_number() OVER (PARTITION BY label ORDER BY md5(flow_key || '|42'), flow_key) AS i, count(*) OVER (PARTITION BY label) AS n FROM flows_raw)
, parts AS (SELECT flow_key, label, CASE WHEN i <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM placed)"""


def _first(sql: str) -> str:
    return "WITH " + sql.strip().removeprefix(",")


@query(_first(_SPLIT_SQL) + " SELECT p.flow_key, p.label, p.split, src_pkts, dst_pkts FROM parts p JOIN flows_raw f ON p.flow_key = f.flow_key")
def write_matrices(v):
    path = fresh_path(v.spark, "matrices")
    io.write_matrices(sampling.split_stratified(v.flows_raw.select("flow_key", "label", "src_pkts", "dst_pkts")), path)
    return v.spark.read.parquet(path)


@query(_first(_SPLIT_SQL) + " SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS attacks FROM parts GROUP BY split")
def load_matrices(v):
    path = fresh_path(v.spark, "matrices")
    io.write_matrices(sampling.split_stratified(v.flows_raw.select("flow_key", "label")), path)
    return v.spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("attacks"))


@query("SELECT flow_key, type FROM flows_raw WHERE domain = 'ton'")
def scan_fallback(v):
    path = fresh_path(v.spark, "candidates")
    v.flows_raw.where("domain = 'ton'").select("flow_key", "type").write.option("header", True).csv(f"{path}/second")
    return io.read_flows(v.spark, io.first_existing(v.spark, [f"{path}/first", f"{path}/second"]), ["flow_key", "type"])


@query("SELECT event_id, user_id, event_type FROM events")
def stream_flows(v):
    feed = feeds.file_feed(v.spark, v.sf_dir, "events.parquet")
    return feeds.drained(feed.select("event_id", "user_id", "event_type"), name="events")


@query("SELECT id, source_ip, attack_type, confidence FROM alerts_raw ORDER BY timestamp DESC, id DESC LIMIT 100")
def alert_sink(v):
    folder, out = fresh_path(v.spark, "alerts"), fresh_path(v.spark, "alert-log")
    v.alerts_raw.write.parquet(folder)
    feeds.alert_sink(feeds.folder_feed(v.spark, folder), out, fresh_path(v.spark, "alert-state"))
    return feeds.alert_log(v.spark, out).select("id", "source_ip", "attack_type", "confidence")


@query("SELECT id, source_ip, target_ip, attack_type, status FROM alerts_raw")
def export_alerts_csv(v):
    path, columns = fresh_path(v.spark, "export"), ["id", "source_ip", "target_ip", "attack_type", "status"]
    io.export_csv(v.alerts_raw.select(*columns), path)
    return io.read_flows(v.spark, path, columns)


# --- profiles


@query("SELECT count(*) AS rows, CAST(26 AS BIGINT) AS columns FROM flows_raw")
def shape(v):
    return profile.shape(v.flows_raw)


@query("SELECT type AS value, count(*) AS n FROM flows_raw GROUP BY type")
def label_counts(v):
    return profile.value_counts(v.flows_raw, "type")


@query("SELECT type AS value, count(*) AS n, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percent FROM flows_raw GROUP BY type")
def label_share(v):
    return profile.class_shares(v.flows_raw, "type")


_ALERT_KINDS = ["id string", "timestamp timestamp_ntz", "source_ip string", "target_ip string", "dest_ip string", "attack_type string", "confidence double", "status string"]


@query(" UNION ALL ".join("SELECT CAST({} AS BIGINT) AS position, '{}' AS name, '{}' AS kind, count({}) AS filled FROM alerts_raw".format(i, *x.split(), x.split()[0]) for i, x in enumerate(_ALERT_KINDS)))
def dtypes(v):
    return profile.dtypes(v.alerts_raw)


@query("SELECT DISTINCT nullif(service, '-') AS value FROM flows_raw")
def distinct_values(v):
    return profile.distinct_values(clean.dash_to_null_all(v.flows_raw.select("service")), "service")


@query(f"""WITH t AS (SELECT nullif(service, '-') AS service, {_num('src_bytes')} AS src_bytes, {_num('dst_bytes')} AS dst_bytes, proto FROM flows_raw)
SELECT 'service' AS feature, round(avg(CASE WHEN service IS NULL THEN 1.0 ELSE 0 END), 9) AS share FROM t UNION ALL SELECT 'src_bytes', round(avg(CASE WHEN src_bytes IS NULL THEN 1.0 ELSE 0 END), 9) FROM t
UNION ALL SELECT 'dst_bytes', round(avg(CASE WHEN dst_bytes IS NULL THEN 1.0 ELSE 0 END), 9) FROM t UNION ALL SELECT 'proto', round(avg(CASE WHEN proto IS NULL THEN 1.0 ELSE 0 END), 9) FROM t""")
def missing_share(v):
    df = clean.coerce(clean.dash_to_null_all(v.flows_raw.select("service", "src_bytes", "dst_bytes", "proto")), ["src_bytes", "dst_bytes"])
    return profile.missing_share(df).withColumn("share", F.round("share", 9))


@query("""SELECT 'duration' AS feature, min(CAST(duration AS DOUBLE)) AS low, max(CAST(duration AS DOUBLE)) AS high FROM flows_raw UNION ALL SELECT 'src_pkts', min(CAST(src_pkts AS DOUBLE)), max(CAST(src_pkts AS DOUBLE)) FROM flows_raw
UNION ALL SELECT 'dst_ip_bytes', min(CAST(dst_ip_bytes AS DOUBLE)), max(CAST(dst_ip_bytes AS DOUBLE)) FROM flows_raw""")
def range_stats(v):
    return profile.range_stats(v.flows_raw, ["duration", "src_pkts", "dst_ip_bytes"])


_STATE_SUMS = " UNION ALL ".join(f"SELECT 'conn_state_{s}' AS feature, sum(CASE WHEN conn_state = '{s}' THEN 1.0::DOUBLE ELSE 0 END) AS total FROM flows_raw" for s in S.STATES)


@query(f"SELECT * FROM ({_STATE_SUMS}) ORDER BY total DESC, feature LIMIT 5")
def dummy_sums_top5(v):
    return profile.prefix_sums(features.featurise(v.flows_raw), "conn_state_")


@query(f"SELECT count(*) AS before, count({_num('src_bytes')}) AS after, count(*) - count({_num('src_bytes')}) AS removed FROM flows_raw")
def drop_report(v):
    return profile.drop_report(v.flows_raw, C.number(F.col("src_bytes")).isNotNull())


@query("SELECT flow_key, proto, conn_state, label FROM flows_raw ORDER BY flow_key LIMIT 5")
def preview(v):
    return profile.preview(v.flows_raw.select("flow_key", "proto", "conn_state", "label"), "flow_key")


# --- projections, filters, cleaning


@query('SELECT flow_key, flow_duration AS "Flow Duration", Label AS "Label" FROM flows_cic')
def strip_headers(v):
    return clean.strip_headers(v.flows_cic.select("flow_key", F.col("flow_duration").alias(" Flow Duration"), F.col("Label").alias(" Label ")))


@query('SELECT flow_key, flow_duration AS "flow duration", Label AS "label" FROM flows_cic')
def lower_headers(v):
    return clean.lower_headers(v.flows_cic.select("flow_key", F.col("flow_duration").alias("Flow Duration"), "Label"))


@query("SELECT flow_key, sbytes AS src_bytes, dbytes AS dst_bytes, spkts AS src_pkts, dpkts AS dst_pkts, dur AS duration, TnBPSrcIP AS src_ip_bytes, TnBPDstIP AS dst_ip_bytes, state AS conn_state, proto, attack AS label FROM flows_bot")
def rename_bot(v):
    return clean.rename(v.flows_bot, S.BOT_NAMES)


@query("SELECT flow_key, flow_duration AS duration, total_fwd_packets AS src_pkts, total_backward_packets AS dst_pkts, total_length_of_fwd_packets AS src_bytes, total_length_of_bwd_packets AS dst_bytes, flow_bytes_s FROM flows_cic")
def rename_cic(v):
    padded = v.flows_cic.drop("Label").toDF("flow_key", " Flow Duration", "Total Fwd Packets", " Total Backward Packets", "Total Length of Fwd Packets", " Total Length of Bwd Packets", "flow_bytes_s")
    return clean.rename(clean.lower_headers(clean.strip_headers(padded)), S.CIC_NAMES)


@query("SELECT flow_key, CASE state WHEN 'CON' THEN 'SF' WHEN 'RST' THEN 'RSTR' WHEN 'REQ' THEN 'S0' WHEN 'INT' THEN 'OTH' WHEN 'FIN' THEN 'SF' WHEN 'URP' THEN 'OTH' ELSE state END AS state FROM flows_bot")
def translate_state(v):
    return clean.translate_state(v.flows_bot.select("flow_key", "state"))


@query(f"SELECT flow_key, {_num('src_bytes')} AS src_bytes, {_num('dst_bytes')} AS dst_bytes FROM flows_raw")
def coerce_numeric(v):
    return clean.coerce(v.flows_raw.select("flow_key", "src_bytes", "dst_bytes"), ["src_bytes", "dst_bytes", "absent"])


@query("SELECT flow_key, nullif(src_bytes, '-') AS src_bytes, nullif(service, '-') AS service FROM flows_raw")
def dash_to_null(v):
    return clean.dash_to_null_all(v.flows_raw.select("flow_key", "src_bytes", "service"))


@query("SELECT flow_key, CASE WHEN flow_bytes_s IN ('Infinity', 'NaN') THEN NULL ELSE CAST(flow_bytes_s AS DOUBLE) END AS rate FROM flows_cic")
def inf_to_null(v):
    return clean.inf_to_null(v.flows_cic.select("flow_key", F.col("flow_bytes_s").try_cast("double").alias("rate")))


@query("SELECT flow_key, proto, conn_state, label FROM flows_raw")
def drop_context(v):
    return clean.drop_context(v.flows_raw.select("flow_key", *S.CONTEXT, "proto", "conn_state", "label", "type"), ("type", "absent"))


@query("SELECT flow_key, proto, nullif(src_bytes, '-') AS src_bytes FROM flows_raw")
def drop_sparse_columns(v):
    return clean.drop_sparse_columns(clean.dash_to_null_all(v.flows_raw.select("flow_key", "proto", "src_bytes", "service")))


@query(f"WITH t AS (SELECT flow_key, {_num('src_bytes')} AS src_bytes, {_num('dst_bytes')} AS dst_bytes FROM flows_raw) SELECT * FROM t WHERE src_bytes IS NOT NULL AND dst_bytes IS NOT NULL")
def drop_null_rows(v):
    return clean.drop_null_rows(coerce_numeric(v))


@query(f"SELECT flow_key, coalesce({_num('src_bytes')}, 0) AS src_bytes, coalesce({_num('dst_bytes')}, 0) AS dst_bytes FROM flows_raw")
def fill_zero(v):
    return clean.fill_zero(coerce_numeric(v), ["src_bytes", "dst_bytes", "absent"])


@query("SELECT DISTINCT src_ip, dst_ip, dst_port, proto FROM flows_raw")
def dedupe_rows(v):
    return clean.dedupe_rows(v.flows_raw.select("src_ip", "dst_ip", "dst_port", "proto"))


@query("SELECT flow_key, flow_duration, 0 AS src_ip_bytes, 0 AS dns_qtype, 'other' AS proto, 'OTH' AS conn_state FROM flows_cic")
def ghost_columns(v):
    return clean.ghost_columns(v.flows_cic.select("flow_key", "flow_duration"), {"src_ip_bytes": 0, "dns_qtype": 0, "proto": "other", "conn_state": "OTH"})


@query(f"SELECT flow_key, src_bytes, dst_bytes, src_pkts, dst_pkts, duration, src_ip_bytes, dst_ip_bytes, conn_state, proto, dns_qclass, dns_qtype, dns_rcode, label FROM ({_MAPPED_SQL}) WHERE domain = 'bot'")
def select_contract(v):
    return clean.to_mapped(v.flows_bot, "bot")


@query("SELECT flow_key, CAST(src_pkts AS DOUBLE) AS src_pkts, CAST(dst_port AS VARCHAR) AS dst_port, CAST(label AS INTEGER) AS label FROM flows_raw")
def cast_types(v):
    return clean.cast_types(v.flows_raw.select("flow_key", "src_pkts", "dst_port", "label"), {"src_pkts": "double", "dst_port": "string", "label": "int"})


@query("SELECT flow_key, round(ln(1 + src_bytes), 9) AS src_bytes, round(ln(1 + duration), 9) AS duration FROM (" + _MAPPED_SQL + ") WHERE domain = 'bot'")
def log1p_volume(v):
    out = clean.log1p_volume(clean.to_mapped(v.flows_bot, "bot"), ["src_bytes", "duration"])
    return out.select("flow_key", F.round("src_bytes", 9).alias("src_bytes"), F.round("duration", 9).alias("duration"))


@query("WITH t AS (SELECT flow_key, ln(1 + src_bytes) AS src_bytes, ln(1 + duration) AS duration FROM (" + _MAPPED_SQL + """) WHERE domain = 'bot'), q AS (SELECT quantile_cont(src_bytes, 0.95) AS a, quantile_cont(duration, 0.95) AS b FROM t)
SELECT flow_key, round(least(src_bytes, a), 9) AS src_bytes, round(least(duration, b), 9) AS duration FROM t CROSS JOIN q""")
def clip_p95(v):
    out = clean.clip_upper(clean.log1p_volume(clean.to_mapped(v.flows_bot, "bot"), ["src_bytes", "duration"]), ["src_bytes", "duration"])
    return out.select("flow_key", F.round("src_bytes", 9).alias("src_bytes"), F.round("duration", 9).alias("duration"))


@query("SELECT flow_key, CASE WHEN Label = 'BENIGN' THEN 0 ELSE 1 END AS label FROM flows_cic")
def label_benign(v):
    return _cic(v).select("flow_key", "label")


_LABELS_SQL = """WITH words AS (SELECT flow_key, CASE src_port % 8 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'benign' WHEN 2 THEN 'Normal' WHEN 3 THEN ' normal ' WHEN 4 THEN '0.0' WHEN 5 THEN 'nan' WHEN 6 THEN type END AS word FROM flows_raw)
SELECT flow_key, CASE WHEN coalesce(word, 'nan') IN ('0', '0.0', 'Normal', 'benign', 'nan') THEN 0 ELSE 1 END AS exact,
 CASE WHEN coalesce(lower(word), 'nan') IN ('0', '0.0', 'normal', 'benign', 'nan') THEN 0 ELSE 1 END AS lower,
 CASE WHEN coalesce(lower(trim(word)), 'nan') IN ('0', '0.0', 'normal', 'benign', 'nan') THEN 0 ELSE 1 END AS trim_lower FROM words"""


@query(_LABELS_SQL)
def label_normal_set(v):
    words = v.sql(_LABELS_SQL.split(")\nSELECT")[0].removeprefix("WITH words AS ("))
    return words.select("flow_key", *[F.when(C.is_normal(F.col("word"), m), 0).otherwise(1).alias(m) for m in ("exact", "lower", "trim_lower")])


@query("SELECT flow_key, Label AS label FROM flows_cic UNION ALL SELECT flow_key, CAST(label AS VARCHAR) FROM flows_raw WHERE domain = 'ton' UNION ALL SELECT flow_key, 'normal' FROM flows_raw WHERE domain = 'bot'")
def resolve_label(v):
    parts = [v.flows_cic, v.flows_raw.where("domain = 'ton'"), v.flows_raw.where("domain = 'bot'").drop("label")]
    out = [p.select("flow_key", clean.resolve_label(p).alias("label")) for p in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(_MAPPED_SQL)
def union_domains(v):
    return _mapped(v)


@query("SELECT flow_key, md5(flow_key || '|42') AS place FROM flows_raw")
def shuffle_rows(v):
    return sampling.shuffled(v.flows_raw.select("flow_key"))


@query("SELECT flow_key, CAST(src_pkts AS DOUBLE) AS src_pkts, 0.0::DOUBLE AS proto_tcp, 0.0::DOUBLE AS \"conn_state_SF\" FROM flows_raw")
def pad_features(v):
    return features.align(v.flows_raw.select("flow_key", "src_pkts"), S.FEATURES).select("flow_key", "src_pkts", "proto_tcp", "conn_state_SF")


# --- features

_NUM_SQL = ", ".join(f"coalesce({_num(c)}, 0) AS {c}" for c in S.NUMERIC)
_DUMMY_SQL = ", ".join([f"CASE WHEN lower(proto) = '{p}' THEN 1.0::DOUBLE ELSE 0 END AS proto_{p}" for p in S.PROTOCOLS] + [f"CASE WHEN upper(conn_state) = '{s}' THEN 1.0::DOUBLE ELSE 0 END AS \"conn_state_{s}\"" for s in S.STATES])
_FEATURES_SQL = f"SELECT flow_key, {_NUM_SQL}, {_DUMMY_SQL} FROM flows_raw"
_ALL_STATES = ["OTH", *S.STATES]


@query("SELECT flow_key, " + ", ".join([f"CASE WHEN proto = '{p}' THEN 1.0::DOUBLE ELSE 0 END AS proto_{p}" for p in S.PROTOCOLS] + [f"CASE WHEN conn_state = '{s}' THEN 1.0::DOUBLE ELSE 0 END AS \"conn_state_{s}\"" for s in S.STATES]) + " FROM flows_raw")
def onehot_drop_first(v):
    return features.onehot(v.flows_raw.select("flow_key", "proto", "conn_state"), ["proto", "conn_state"], drop_first=True)


@query("SELECT flow_key, " + ", ".join([f"CASE WHEN proto = '{p}' THEN 1.0::DOUBLE ELSE 0 END AS proto_{p}" for p in ["icmp", *S.PROTOCOLS]] + [f"CASE WHEN conn_state = '{s}' THEN 1.0::DOUBLE ELSE 0 END AS \"conn_state_{s}\"" for s in _ALL_STATES]) + " FROM flows_raw")
def onehot_full(v):
    return features.onehot(v.flows_raw.select("flow_key", "proto", "conn_state"), ["proto", "conn_state"])


@query("SELECT flow_key, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in ("src_pkts", "dst_pkts") else f'0.0::DOUBLE AS "{c}"' for c in S.FEATURES) + " FROM flows_raw")
def align_features(v):
    return features.align(v.flows_raw.select("flow_key", "dst_pkts", "src_pkts", "service"))


_SCALE = ["duration", "src_pkts", "dst_ip_bytes"]
_SCALE_SQL = ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END, 6) AS {c}" for c in _SCALE)


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Rounded, without a negative zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query(f"SELECT flow_key, domain, {_SCALE_SQL} FROM flows_raw WINDOW w AS (PARTITION BY domain)")
def standard_scale(v):
    rows = v.flows_raw.select("flow_key", "domain", *[F.col(c).cast("double").alias(c) for c in _SCALE])
    return _rounded(features.apply_scaler(rows, features.fit_scaler(rows, _SCALE, "domain"), _SCALE, "domain"), _SCALE)


@query("SELECT flow_key, round((src_pkts - (SELECT avg(src_pkts) FROM flows_raw WHERE domain = 'ton')) / (SELECT stddev_pop(src_pkts) FROM flows_raw WHERE domain = 'ton'), 6) AS src_pkts FROM flows_raw WHERE domain = 'bot'")
def apply_scaler(v):
    rows = v.flows_raw.select("flow_key", "domain", F.col("src_pkts").cast("double").alias("src_pkts"))
    scaler = written(features.fit_scaler(rows.where("domain = 'ton'"), ["src_pkts"]), "scaler")
    return _rounded(features.apply_scaler(rows.where("domain = 'bot'").drop("domain"), scaler, ["src_pkts"]), ["src_pkts"])


@query(f"WITH f AS ({_FEATURES_SQL}) SELECT flow_key, CAST(28 AS INTEGER) AS width, round(" + " + ".join(f'{i + 1} * "{c}"' for i, c in enumerate(S.FEATURES)) + ", 4) AS weighted FROM f")
def assemble_vector(v):
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")
    out = features.assemble(features.featurise(v.flows_raw))
    weighted = F.aggregate(F.zip_with(x, F.sequence(F.lit(1), F.lit(28)), lambda a, i: a * i), F.lit(0.0), lambda a, b: a + b)
    return out.select("flow_key", F.size(x).alias("width"), F.round(weighted, 4).alias("weighted"))


@query(_FEATURES_SQL)
def featurise_flow(v):
    return features.featurise(v.flows_raw)


@query("SELECT x.flow_key, x.src_pkts, y.label FROM flows_raw x JOIN flows_raw y ON x.flow_key = y.flow_key")
def split_xy(v):
    x, y = features.split_xy(v.flows_raw.select("flow_key", "src_pkts", "label"))
    return x.join(y, "flow_key")


# --- sampling, splitting, balancing

_ORDER = "md5(flow_key || '|42'), flow_key"


@query(f"SELECT flow_key, label FROM flows_raw ORDER BY {_ORDER} LIMIT 500")
def sample_n(v):
    return sampling.sample_n(v.flows_raw.select("flow_key", "label"), 500)


@query(f"WITH t AS (SELECT flow_key, domain, label AS is_attack, row_number() OVER (PARTITION BY domain, label ORDER BY {_ORDER}) AS i FROM flows_raw) SELECT flow_key, domain, is_attack FROM t WHERE i <= CASE WHEN is_attack = 1 THEN 500 ELSE 2000 END")
def pool_caps(v):
    return sampling.pool_caps(v.flows_raw.select("flow_key", "domain", "label"), "domain", F.col("label")).drop("label")


@query(_first(_SPLIT_SQL) + " SELECT flow_key, label, split FROM parts")
def split_stratified(v):
    return sampling.split_stratified(v.flows_raw.select("flow_key", "label"))


@query(_first(_SPLIT_SQL) + " SELECT flow_key, label, CASE split WHEN 'test' THEN 'study' ELSE 'exam' END AS split FROM parts")
def split_study_exam(v):
    return sampling.split_stratified(v.flows_raw.select("flow_key", "label"), names=("study", "exam"))


@query("WITH t AS (SELECT flow_key, row_number() OVER (ORDER BY ts, flow_key) AS place, count(*) OVER () AS n FROM flows_raw) SELECT flow_key, place, CASE WHEN place > n - floor(n * 0.2) THEN 'validation' ELSE 'fit' END AS part FROM t")
def split_tail(v):
    return sampling.split_tail(v.flows_raw.select("flow_key", "ts"), ["ts", "flow_key"]).select("flow_key", F.col("place").cast("long").alias("place"), "part")


_SMOTE = ["duration", "src_pkts", "dst_pkts"]


def _hash_fraction(key: str, seed: int) -> str:
    return f"(CAST(('0x' || substr(md5({key} || '|{seed}'), 1, 7)) AS BIGINT) / 268435456.0::DOUBLE)"


@query(f"""
WITH pool AS (SELECT flow_key, duration::DOUBLE AS duration, src_pkts::DOUBLE AS src_pkts, dst_pkts::DOUBLE AS dst_pkts FROM flows_raw WHERE label = 1),
rest AS (SELECT flow_key FROM flows_raw WHERE label = 0),
near AS (SELECT flow_key, unnest(n).o AS other, generate_subscripts(n, 1) AS place FROM (SELECT a.flow_key, min({{'d': (a.duration - b.duration) * (a.duration - b.duration) + (a.src_pkts - b.src_pkts) * (a.src_pkts - b.src_pkts) + (a.dst_pkts - b.dst_pkts) * (a.dst_pkts - b.dst_pkts), 'o': b.flow_key}}, 5) AS n FROM pool a JOIN pool b ON a.flow_key <> b.flow_key GROUP BY a.flow_key)),
ranked AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS i, (SELECT count(*) FROM rest) - (SELECT count(*) FROM pool) AS need, (SELECT count(*) FROM pool) AS m FROM pool),
made AS (SELECT *, unnest(range(1, 1 + need // m + CASE WHEN i <= need % m THEN 1 ELSE 0 END)) AS r FROM ranked),
keyed AS (SELECT *, flow_key || '~' || r AS k FROM made),
picked AS (SELECT k, flow_key, duration, src_pkts, dst_pkts, CAST(floor({_hash_fraction('k', 43)} * 5) AS BIGINT) + 1 AS place, {_hash_fraction('k', 44)} AS u FROM keyed)
SELECT k AS flow_key, round(p.duration + u * (e.duration - p.duration), 6) AS duration, round(p.src_pkts + u * (e.src_pkts - p.src_pkts), 6) AS src_pkts, round(p.dst_pkts + u * (e.dst_pkts - p.dst_pkts), 6) AS dst_pkts, 1 AS label
FROM picked p JOIN near n ON n.flow_key = p.flow_key AND n.place = p.place JOIN pool e ON e.flow_key = n.other""")
def smote(v):
    rows = v.flows_raw.select("flow_key", *[F.col(c).cast("double").alias(c) for c in _SMOTE], "label")
    return _rounded(sampling.smote(written(rows, "pool"), _SMOTE), _SMOTE)


@query()
def smote_train(v):
    rows = v.flows_raw.select("flow_key", *[F.col(c).cast("double").alias(c) for c in _SMOTE], "label")
    train = written(sampling.split_stratified(rows).where("split = 'train'").drop("split"), "train")
    return _rounded(sampling.smote(train, _SMOTE), _SMOTE)


@query(f"SELECT flow_key, 'DDoS' AS type, 0 AS priority FROM (SELECT * FROM flows_raw WHERE label = 1 ORDER BY {_ORDER} LIMIT 50) UNION ALL SELECT flow_key, type, 1 FROM flows_raw WHERE label = 0")
def inject_attacks(v):
    return sampling.inject_attacks(v.flows_raw.select("flow_key", "type", "label"), 50, "DDoS").drop("label")


_KERNELS = [[1.0, 0.0, -1.0], [-1.0, 2.0, -1.0]]

# --- models: forests of 100 trees, 50 for all domains together, of depth 15; networks of 64 and 128 kernels and 128 dense units

_BINS = 64
#: What queries of one session share: split tables and the folder of stored models of each folder of tables.
_SPLIT: dict[tuple, tuple[DataFrame, DataFrame]] = {}
_MODELS: dict[tuple, str] = {}


def _train_test(v, domain: str | None = None, share: float = 0.2, names: tuple[str, str] = ("test", "train")) -> tuple[DataFrame, DataFrame]:
    """The larger and the smaller part of a stratified split, written once a session."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir, domain, share, names)
    if key not in _SPLIT:
        rows = v.flows_raw if domain is None else v.flows_raw.where(F.col("domain") == domain)
        # dealt by key, so that no task scores or fits on most rows where the tables are single files
        parts = written(sampling.split_stratified(features.featurise(rows, ("flow_key", "label")), share=share, names=names).repartition("flow_key"), "parts")
        _SPLIT[key] = tuple(parts.where(F.col("split") == n).drop("split") for n in names[::-1])
    return _SPLIT[key]


def _scaled(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    scaler = written(features.fit_scaler(train, S.FEATURES), "scaler")
    return tuple(features.apply_scaler(x, scaler, S.FEATURES) for x in (train, test))


def _global_parts(v) -> DataFrame:
    bot = clean.to_mapped(v.flows_bot, "bot").withColumn("label", F.col("label").cast("string"))
    cic = clean.to_mapped(_cic(v), "cic").withColumn("label", F.col("label").cast("string"))
    ton = v.flows_raw.where("domain = 'ton'").drop("domain").withColumn("label", F.col("label").cast("string"))
    return written(sampling.split_stratified(models.global_frame({"ton": ton, "bot": bot, "cic": cic})).repartition("flow_key"), "global")


def _root(v) -> str:
    """The folder of the session's stored models for a folder of tables."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _MODELS:
        _MODELS[key] = fresh_path(v.spark, "models")
    return _MODELS[key]


def share_models(spark: SparkSession, fitted_on: str, used_for: str) -> None:
    """Fit and store both voters on one folder of tables, and use them for another too."""
    v = Views(spark, fitted_on)
    _forest(v)
    _network(v)
    _MODELS[spark.sparkContext.applicationId, used_for] = _root(v)


def _stored(v, name: str, fit):
    """A model stored under a name, fitted and stored first if it isn't there."""
    key = (_root(v), name)
    path = models.model_path(_root(v), name)
    if key not in _MODELS:
        model = fit()
        models.save(model, path)
        _MODELS[key] = path
        return model
    return models.load(path)


def _forest(v):
    """The forest fitted on the train part of all flows."""
    return _stored(v, "all", lambda: models.forest_fit(_train_test(v)[0], bins=_BINS))


def _domain_forest(v, domain: str):
    """The base domain's forest, fitted on its train part, and the others', fitted on their study part."""
    study = lambda: _train_test(v, domain)[0] if domain == "ton" else _study_exam(v, domain)[0]
    return _stored(v, models.STORED_AS[domain], lambda: models.forest_fit(study(), bins=_BINS))


def _study_exam(v, domain: str) -> tuple[DataFrame, DataFrame]:
    exam, study = _train_test(v, domain, 0.2, ("study", "exam"))
    return study, exam


def _global_forest(v, parts=None):
    return _stored(v, models.GLOBAL, lambda: models.forest_fit((_global_parts(v) if parts is None else parts).where("split = 'train'"), S.FEATURES[:14], trees=50, bins=_BINS))


def _network(v, domain: str | None = None):
    """(network, scaler, trace) of the second voter, fitted with early stopping on the train part; shared like the forests."""
    key = (_root(v), "network", domain)
    if key not in _MODELS:
        train, _ = _train_test(v, domain)
        scaler = written(features.fit_scaler(train, S.FEATURES), "scaler")
        parts = features.apply_scaler(sampling.mark_tail(train, ["flow_key"], 0.1), scaler, S.FEATURES)
        net, trace = models.early_stop(parts.where("part = 'fit'"), parts.where("part = 'validation'"))
        path = f"{_root(v)}/nn_model_{domain or 'all'}"
        networks.save(net, path)
        _MODELS[key] = (path, scaler, trace)
    path, scaler, trace = _MODELS[key]
    return networks.load(path), scaler, trace


@query()
def rf_fit(v):
    _, test = _train_test(v)
    found = models.measures(models.forest_proba(test, _forest(v)), "p_rf")
    return v.spark.createDataFrame(sorted(found.items()), "metric string, value double")


@query()
def rf_predict(v):
    return models.forest_predict(_train_test(v)[1], _forest(v)).select("flow_key", "label", "prediction")


@query()
def rf_proba(v):
    return models.forest_proba(_train_test(v)[1], _forest(v)).select("flow_key", "label", "p_rf")


@query()
def model_roundtrip(v):
    _, test = _train_test(v)
    model, path = _forest(v), fresh_path(v.spark, "model")
    models.save(model, path)
    before = models.forest_proba(test, model).select("flow_key", "p_rf")
    return before.join(models.forest_proba(test, models.load(path)).select("flow_key", F.col("p_rf").alias("p_loaded")), "flow_key")


@query("WITH s AS (SELECT *, " + ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS z_{c}" for c in _SCALE) + " FROM flows_raw) SELECT flow_key, " + ", ".join(f"round(z_{c}, 6) AS {c}, round(z_{c}, 6) AS {c}_loaded" for c in _SCALE) + " FROM s")
def scaler_roundtrip(v):
    rows = v.flows_raw.select("flow_key", *[F.col(c).cast("double").alias(c) for c in _SCALE])
    scaler = features.fit_scaler(rows, _SCALE)
    loaded = [f"{c}_loaded" for c in _SCALE]
    # both scalers meet the same row, so rows needn't be joined to themselves
    twice = features.apply_scaler(rows.withColumns({n: F.col(c) for n, c in zip(loaded, _SCALE)}), scaler, _SCALE)
    stored = written(scaler, "scaler").toDF(*[f"{c}_loaded_{x}" for c in _SCALE for x in ("mean", "std")])
    return _rounded(features.apply_scaler(twice, stored, loaded), [*_SCALE, *loaded])


@query()
def neural_fit(v):
    net, scaler, _ = _network(v)
    test = features.apply_scaler(_train_test(v)[1], scaler, S.FEATURES)
    return v.spark.createDataFrame(sorted(models.measures(models.neural_proba(test, net), "p_nn").items()), "metric string, value double")


@query()
def early_stop(v):
    return _network(v)[2]


@query()
def neural_finetune(v):
    base, _, _ = _network(v, "ton")
    study, exam = _scaled(*_study_exam(v, "bot"))
    parts = sampling.mark_tail(study, ["flow_key"], 0.2)
    tuned = models.neural_finetune(base, parts.where("part = 'fit'"), validation=parts.where("part = 'validation'"))
    rows = [(name, k, x) for name, m in (("base", base), ("tuned", tuned)) for k, x in models.measures(models.neural_proba(exam, m), "p_nn").items()]
    return v.spark.createDataFrame(rows, "model string, metric string, value double")


@query()
def neural_predict(v):
    net, scaler, _ = _network(v)
    scored = models.neural_proba(features.apply_scaler(_train_test(v)[1], scaler, S.FEATURES), net)
    return scored.select("flow_key", "label", "p_nn", C.attack_decision(F.col("p_nn"), 0.5, False).alias("strict"), C.attack_decision(F.col("p_nn")).alias("inclusive"))


@query("SELECT flow_key, round((p_rf + p_nn) / 2, 6) AS score, CASE WHEN (p_rf + p_nn) / 2 >= 0.5 THEN 1 ELSE 0 END AS inclusive, CASE WHEN (p_rf + p_nn) / 2 > 0.5 THEN 1 ELSE 0 END AS strict FROM scores_raw")
def soft_vote(v):
    one, two = models.soft_vote(v.scores_raw), models.soft_vote(v.scores_raw, inclusive=False)
    both = one.withColumn("strict", C.attack_decision(F.col("score"), 0.5, False))
    assert two.columns == one.columns
    return both.select("flow_key", F.round("score", 6).alias("score"), F.col("prediction").alias("inclusive"), "strict")


@query("SELECT flow_key, CASE WHEN p_rf > 0.5 THEN 1 ELSE 0 END AS prediction FROM scores_raw")
def zero_shot_argmax(v):
    return models.zero_shot_argmax(v.scores_raw).select("flow_key", "prediction")


@query("SELECT flow_key, round_even(greatest(p_rf, 1 - p_rf), 2) AS confidence FROM scores_raw")
def confidence(v):
    return v.scores_raw.select("flow_key", C.confidence(F.col("p_rf")).alias("confidence"))


@query("""WITH n AS (SELECT domain, count(*) AS rows, count(*) FILTER (label = 1) AS attacks FROM flows_raw GROUP BY domain UNION ALL SELECT NULL, count(*), count(*) FILTER (label = 1) FROM flows_raw),
c AS (SELECT CASE domain WHEN 'ton' THEN 'ton_iot' WHEN 'bot' THEN 'bot_iot' WHEN 'cic' THEN 'cic_ids2017' ELSE coalesce(domain, 'omni') END AS choice, rows, attacks FROM n)
SELECT choice, CASE WHEN choice IN ('ton_iot', 'omni') THEN choice ELSE choice || '_finetuned' END AS model, CASE WHEN choice = 'omni' THEN 14 ELSE 28 END AS features,
 'Hybrid Ensemble (RF+NN) - ' || CASE WHEN choice = 'omni' THEN 'OMNI (GLOBAL)' ELSE upper(choice) END AS status, rows, attacks FROM c""")
def model_registry(v):
    for domain in models.STORED_AS:
        _domain_forest(v, domain)
    _global_forest(v)
    return models.registry(v.flows_raw, _root(v)).select("choice", "model", "features", "status", "rows", "attacks")


_POOLED = " || ".join(
    f"list_transform(range(1, 32), lambda i: greatest(greatest(0, e[2*i-1]*{a} + e[2*i]*{b} + e[2*i+1]*{c}), greatest(0, e[2*i]*{a} + e[2*i+1]*{b} + e[2*i+2]*{c})))" for a, b, c in ([f"({x})" for x in k] for k in _KERNELS)
)


@query(f"WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT vec_id, {_POOLED} AS c FROM t) SELECT vec_id, CAST(len(c) AS INTEGER) AS width, round(list_sum(c), 5) AS total, round(c[1], 6) AS first_value, round(c[62], 6) AS last_value FROM p")
def conv_features(v):
    out = features.conv_features(v.embeddings.select("vec_id", "embedding"), "embedding", _KERNELS)
    total = F.aggregate("conv", F.lit(0.0), lambda a, x: a + x)
    return _rounded(out.select("vec_id", F.size("conv").alias("width"), F.round(total, 5).alias("total"), F.element_at("conv", 1).alias("first_value"), F.element_at("conv", 62).alias("last_value")), ["first_value", "last_value"])


@query()
def global_model(v):
    parts = _global_parts(v)
    found = models.measures(models.forest_proba(parts.where("split = 'test'"), _global_forest(v, parts), S.FEATURES[:14]), "p_rf")
    return v.spark.createDataFrame(sorted(found.items()), "metric string, value double")


@query()
def transfer_eval(v):
    targets = {d: (_domain_forest(v, d), _study_exam(v, d)[1]) for d in ("bot", "cic")}
    return models.transfer_eval(_domain_forest(v, "ton"), targets, v.spark)


# --- evaluation


def _decided(v) -> DataFrame:
    return v.scores_raw.withColumn("prediction", C.attack_decision(F.col("p_rf")))


_DECIDED = "WITH t AS (SELECT label, CASE WHEN p_rf >= 0.5 THEN 1 ELSE 0 END AS p, p_rf FROM scores_raw)"


@query(f"{_DECIDED} SELECT round(avg(CASE WHEN label = p THEN 1.0 ELSE 0 END), 9) AS accuracy FROM t")
def accuracy(v):
    return evaluation.accuracy(_decided(v)).select(F.round("accuracy", 9).alias("accuracy"))


@query(f"{_DECIDED} SELECT a.x AS actual, b.x AS predicted, (SELECT count(*) FROM t WHERE label = a.x AND p = b.x) AS n FROM (VALUES (0), (1)) a(x) CROSS JOIN (VALUES (0), (1)) b(x)")
def confusion(v):
    return evaluation.confusion(_decided(v))


@query(f"""{_DECIDED}, c AS (SELECT CAST(count(*) FILTER (label = 0 AND p = 0) AS DOUBLE) a, CAST(count(*) FILTER (label = 0 AND p = 1) AS DOUBLE) b, CAST(count(*) FILTER (label = 1 AND p = 0) AS DOUBLE) c, CAST(count(*) FILTER (label = 1 AND p = 1) AS DOUBLE) d FROM t),
m AS (SELECT *, a / (a + c) p0, a / (a + b) r0, d / (b + d) p1, d / (c + d) r1, a + b s0, c + d s1 FROM c), f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) f0, 2 * p1 * r1 / (p1 + r1) f1 FROM m)
SELECT item, round(x, 9) AS precision, round(y, 9) AS recall, round(z, 9) AS f1, CAST(s AS BIGINT) AS support FROM (
 SELECT '0' item, p0 x, r0 y, f0 z, s0 s FROM f UNION ALL SELECT '1', p1, r1, f1, s1 FROM f UNION ALL SELECT 'accuracy', (a + d) / (s0 + s1), (a + d) / (s0 + s1), (a + d) / (s0 + s1), s0 + s1 FROM f
 UNION ALL SELECT 'macro', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
 UNION ALL SELECT 'weighted', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f)""")
def class_report(v):
    return _rounded(evaluation.class_report(_decided(v)), ["precision", "recall", "f1"], 9)


@query("WITH g AS (SELECT p_rf s, sum(label)::DOUBLE p, sum(1 - label)::DOUBLE n FROM scores_raw GROUP BY 1), r AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM g) SELECT round(sum(p * (b + n / 2)) / (sum(p) * sum(n)), 9) AS auc FROM r")
def roc_auc(v):
    return evaluation.roc_auc(v.scores_raw, "p_rf").select(F.round("auc", 9).alias("auc"))


@query()
def throughput(v):
    test, model = _train_test(v)[1], _forest(v)
    return models.throughput(test, lambda df: models.forest_proba(df, model), "score")


_CHECKED = ["duration", "src_pkts", "dst_ip_bytes", "dns_qclass"]


@query(f"WITH f AS ({_FEATURES_SQL}) SELECT 'proto_' AS item, max(greatest(proto_tcp, proto_udp)) > 0 AS passed FROM f UNION ALL SELECT 'conn_state_', max(greatest(" + ", ".join(f'"conn_state_{s}"' for s in S.STATES) + ")) > 0 FROM f" + "".join(f" UNION ALL SELECT '{c}', min({c}) >= 0 AND max({c}) > min({c}) FROM f" for c in _CHECKED))
def alignment_check(v):
    return profile.alignment_check(features.featurise(v.flows_raw), ["proto_", "conn_state_"], _CHECKED)


@query("""WITH s AS (SELECT label, CAST(floor(p_rf * 100 + 1e-9) AS INTEGER) b FROM scores_raw), t AS (SELECT CAST(unnest(range(50, 100)) AS INTEGER) t),
c AS (SELECT t, (SELECT count(*) FROM s WHERE b >= t) AS alerts, (SELECT count(*) FROM s WHERE b >= t AND label = 1) AS hits, (SELECT count(*) FROM s WHERE label = 1) AS al FROM t),
m AS (SELECT *, CASE WHEN alerts > 0 THEN hits::DOUBLE / alerts ELSE 0 END p, CASE WHEN al > 0 THEN hits::DOUBLE / al ELSE 0 END r FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END f FROM m)
SELECT t / 100.0::DOUBLE AS threshold, alerts, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, t = (SELECT t FROM f ORDER BY round(f, 9) DESC, t LIMIT 1) AS best FROM f""")
def threshold_sweep(v):
    return _rounded(evaluation.threshold_sweep(v.scores_raw, "p_rf"), ["precision", "recall", "f1"], 9)


# --- explanations


@query()
def shap_values(v):
    return explain.shap_values(sampling.sample_n(_train_test(v)[1], 500), _forest(v), S.FEATURES)


@query("SELECT feature, round(avg(abs(phi)), 9) AS importance FROM phi_raw GROUP BY feature")
def shap_global(v):
    return explain.shap_global(v.phi_raw).select("feature", F.round("importance", 9).alias("importance"))


@query(f"WITH f AS (SELECT flow_key, coalesce({_num('src_bytes')}, 0) AS src_bytes, duration, src_pkts FROM flows_raw) SELECT p.flow_key, feature, CASE feature WHEN 'src_bytes' THEN src_bytes WHEN 'duration' THEN duration ELSE src_pkts END AS value, round(phi, 9) AS phi FROM phi_raw p JOIN f ON p.flow_key = f.flow_key WHERE feature IN ('src_bytes', 'duration', 'src_pkts')")
def shap_beeswarm(v):
    return _rounded(explain.beeswarm(v.phi_raw, features.featurise(v.flows_raw), ["src_bytes", "duration", "src_pkts"]), ["phi"], 9)


@query()
def lime_local(v):
    train, test = _train_test(v)
    model = _forest(v)
    attacks = profile.preview(test.where("label = 1"), "flow_key", 500)
    return explain.lime_local(attacks, train, S.FEATURES, lambda df: models.forest_proba(df, model, to="p"), groups=("proto_", "conn_state_"))


@query("SELECT flow_key, feature, CASE WHEN phi > 0 THEN 'PROMOTES' ELSE 'SUPPRESSES' END AS impact, printf('%.4f', phi) AS weight_text FROM phi_raw")
def impact_sign(v):
    return explain.impact_sign(v.phi_raw)


@query()
def mine_rules(v):
    rows = written(features.featurise(v.flows_raw, ("flow_key", "label")), "rules")
    return explain.apply_rules(rows, explain.mine_rules(rows, S.FEATURES, "label"))


_RULES = [[("dst_ip_bytes", ">", 2000.0), ("duration", "<=", 60.0)], [("src_pkts", ">", 40.0)]]


@query("SELECT CAST(0 AS INTEGER) AS rule, 'IF dst_ip_bytes > 2000 AND duration <= 60 THEN attack' AS text, count(*) FILTER (dst_ip_bytes > 2000 AND duration <= 60) AS matches, round(avg(label) FILTER (dst_ip_bytes > 2000 AND duration <= 60), 9) AS precision, round(avg(CASE WHEN dst_ip_bytes > 2000 AND duration <= 60 THEN 1.0 ELSE 0 END), 9) AS coverage FROM flows_raw UNION ALL SELECT 1, 'IF src_pkts > 40 THEN attack', count(*) FILTER (src_pkts > 40), round(avg(label) FILTER (src_pkts > 40), 9), round(avg(CASE WHEN src_pkts > 40 THEN 1.0 ELSE 0 END), 9) FROM flows_raw")
def apply_rules(v):
    return _rounded(explain.apply_rules(v.flows_raw, _RULES), ["precision", "coverage"], 9)


_NAME_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in S.FEATURE_NAMES.items()) + " ELSE replace({0}, '_', ' ') END"


@query(f"SELECT DISTINCT feature, {_NAME_SQL.format('feature')} AS name FROM phi_raw")
def feature_names(v):
    return v.phi_raw.select("feature", explain.display_name(F.col("feature")).alias("name")).distinct()


_LEVEL_SQL = "SELECT flow_key, round(0.15::DOUBLE + sum(phi), 9) AS score FROM phi_raw GROUP BY flow_key"


@query(f"SELECT flow_key, score, CASE WHEN score > 0.6 THEN 'High' WHEN score > 0.4 THEN 'Medium' ELSE 'Low' END AS level FROM ({_LEVEL_SQL})")
def threat_level(v):
    return explain.threat_level(v.phi_raw)


@query(f"""WITH l AS (SELECT flow_key, round(0.15::DOUBLE + sum(phi), 9) AS score, list(feature ORDER BY phi DESC, feature) AS f FROM phi_raw GROUP BY flow_key),
n AS (SELECT flow_key, CASE WHEN score > 0.6 THEN 'High' WHEN score > 0.4 THEN 'Medium' ELSE 'Low' END AS level, {_NAME_SQL.format('f[1]')} AS a, {_NAME_SQL.format('f[2]')} AS b FROM l)
SELECT flow_key, level, CASE WHEN level = 'High' THEN printf('Highest suspicion: this flow stands out by "%s", then by "%s".', a, b) ELSE printf('No severe sign in this flow; "%s" weighs most.', a) END AS text FROM n""")
def summary_text(v):
    return explain.summary_text(v.phi_raw)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY phi DESC, feature) AS i FROM phi_raw) SELECT flow_key, CAST(i AS INTEGER) AS place, feature, CASE WHEN phi >= 0.3 THEN 'Suspicious' ELSE 'Normal' END AS flag FROM r WHERE i <= 4")
def trigger_flags(v):
    return explain.trigger_flags(v.phi_raw)


# --- scoring stream, alerts, roll-ups

_BUILT = """SELECT md5(s.flow_key) AS id, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS timestamp, src_ip AS source_ip, dst_ip AS target_ip, dst_ip AS dest_ip,
 CASE WHEN lower(type) IN ('normal', 'nan', 'benign', '0', '0.0') THEN 'Anomaly Detected' WHEN type IN ('1', '1.0') THEN 'Malicious Flow (' || f.domain || ')' ELSE type END AS attack_type,
 round_even(greatest(p_rf, 1 - p_rf), 2) AS confidence, 'Alerted (RF-OMNI)' AS status FROM scores_raw s JOIN flows_raw f ON s.flow_key = f.flow_key WHERE p_rf >= 0.5"""


def _scored(v) -> DataFrame:
    scores = v.scores_raw.select("flow_key", C.confidence(F.col("p_rf")).alias("confidence"), C.attack_decision(F.col("p_rf")).alias("prediction"))
    return v.flows_raw.drop("label").join(scores, "flow_key")


@query(_BUILT)
def alert_build(v):
    return alerts.build_alerts(_scored(v))


def voters(v):
    """What scores a flow as it arrives: both stored voters, fitted in batch, and their mean."""
    columns = [f"_{c}" for c in S.FEATURES]
    forest = _forest(v)
    net, scaler, _ = _network(v)
    scaler = scaler.toDF(*[f"_{c}" for c in scaler.columns])

    def score(df):
        out = models.forest_proba(df.withColumns({f"_{c}": x for c, x in features.flow_features(df).items()}), forest, columns)
        out = models.soft_vote(models.neural_proba(features.apply_scaler(out, scaler, columns), net, columns))
        return out.withColumn("confidence", C.confidence(F.col("score")))

    return score


@query()
def score_stream(v):
    folder = fresh_path(v.spark, "feed")
    # as many files at least as tasks can score at a time
    v.flows_raw.drop("label").repartition(max(8, v.spark.sparkContext.defaultParallelism)).write.parquet(folder)
    return feeds.drained(feeds.score_stream(feeds.folder_feed(v.spark, folder), voters(v)), name="scores")


_WORDS = "SELECT flow_key, domain, CASE src_port % 6 WHEN 0 THEN 'BENIGN' WHEN 1 THEN '1' WHEN 2 THEN 'nan' WHEN 3 THEN NULL WHEN 4 THEN '1.0' ELSE type END AS type FROM flows_raw"


@query(f"SELECT flow_key, CASE WHEN lower(coalesce(type, 'Malicious Flow')) IN ('normal', 'nan', 'benign', '0', '0.0') THEN 'Anomaly Detected' WHEN type IN ('1', '1.0') THEN 'Malicious Flow (' || domain || ')' ELSE coalesce(type, 'Malicious Flow') END AS attack_type FROM ({_WORDS})")
def attack_type(v):
    words = v.sql(_WORDS)
    return words.select("flow_key", alerts.attack_type(words).alias("attack_type"))


@query("SELECT flow_key, coalesce(CASE WHEN src_port % 3 > 0 THEN src_ip END, 'Unknown') AS source_ip FROM flows_raw")
def host_default(v):
    return v.flows_raw.select("flow_key", alerts.host(F.when(F.col("src_port") % 3 > 0, F.col("src_ip"))).alias("source_ip"))


@query("SELECT id, CASE WHEN confidence > 0.95 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM alerts_raw", name="severity")
def severity_query(v):
    return alerts.with_severity(v.alerts_raw).select("id", "severity")


@query("SELECT id, confidence FROM alerts_raw WHERE confidence >= 0.85")
def threshold_filter(v):
    return alerts.threshold_filter(v.alerts_raw).select("id", "confidence")


@query("SELECT count(*) AS processed_packets, count(*) FILTER (label = 1) AS threats_detected FROM flows_raw")
def counters(v):
    return alerts.counters(v.flows_raw, F.col("label") == 1)


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS window_start, count(*) AS flows FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def volume_last10(v):
    return alerts.volume_last(v.events).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_ROLLUP = """WITH n AS (SELECT * FROM alerts_raw ORDER BY timestamp DESC, id DESC LIMIT 15)
SELECT source_ip AS id, count(*) AS threats, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_seen, false AS is_core FROM n GROUP BY source_ip UNION ALL SELECT 'core', 0, 'Now', true"""


@query(_ROLLUP)
def host_rollup(v):
    return alerts.host_rollup(v.alerts_raw)


@query(f"SELECT id AS source, 'core' AS target, threats > 2 AS hot FROM ({_ROLLUP}) WHERE NOT is_core")
def graph_edges(v):
    return alerts.graph_edges(alerts.host_rollup(v.alerts_raw))


@query("SELECT id, source_ip, attack_type FROM alerts_raw ORDER BY timestamp DESC, id DESC LIMIT 10")
def recent_alerts(v):
    return alerts.newest(v.alerts_raw, 10).select("id", "source_ip", "attack_type")


@query("SELECT id, source_ip, attack_type FROM alerts_raw WHERE contains(lower(concat_ws(' ', id, source_ip, target_ip, attack_type)), 'ddos')")
def search_alerts(v):
    return alerts.search(v.alerts_raw, "DDoS").select("id", "source_ip", "attack_type")


@query("SELECT id, CASE WHEN confidence > 0.95 THEN 'warn' ELSE 'alert' END AS level, printf('Flow: %s → %s | Type: %s | Conf: %.1f%%', source_ip, target_ip, attack_type, confidence * 100) AS line FROM alerts_raw")
def alert_line(v):
    return alerts.alert_line(v.alerts_raw)


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS t, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 10), l AS (SELECT flow_key FROM phi_raw ORDER BY ts DESC, flow_key DESC LIMIT 1),
p AS (SELECT feature, phi FROM phi_raw WHERE flow_key = (SELECT flow_key FROM l) ORDER BY phi DESC, feature LIMIT 3)
SELECT 'Active' AS node_status, 'Hybrid Ensemble (RF+NN) - OMNI (GLOBAL)' AS core_model, (SELECT count(*) FROM flows_raw) AS processed_packets, (SELECT count(*) FROM flows_raw WHERE label = 1) AS threats_detected,
 (SELECT string_agg(n, ',' ORDER BY t) FROM w) AS chart_data, (SELECT string_agg(feature || '=' || printf('%.2f', phi), ',' ORDER BY phi DESC, feature) FROM p) AS latest_shap""")
def status_snapshot(v):
    row = alerts.status_snapshot(v.flows_raw, v.events, v.phi_raw)
    shap = F.array_join(F.transform("latest_shap", lambda x: F.concat(x["f"], F.lit("="), F.format_string("%.2f", x["v"]))), ",")
    return row.withColumn("chart_data", F.array_join(F.col("chart_data").cast("array<string>"), ",")).withColumn("latest_shap", shap)


@query("SELECT source_ip, CASE WHEN count(*) > 99 THEN '99+' ELSE CAST(count(*) AS VARCHAR) END AS badge FROM alerts_raw GROUP BY source_ip")
def badge_count(v):
    return v.alerts_raw.groupBy("source_ip").agg(C.badge(F.count("*")).alias("badge"))


@query("WITH l AS (SELECT flow_key FROM phi_raw ORDER BY ts DESC, flow_key DESC LIMIT 1) SELECT flow_key, CAST(row_number() OVER (ORDER BY phi DESC, feature) AS INTEGER) AS place, feature, round(phi, 9) AS phi FROM phi_raw WHERE flow_key = (SELECT flow_key FROM l) ORDER BY phi DESC, feature LIMIT 3")
def latest_attribution(v):
    return _rounded(alerts.latest_attribution(v.phi_raw), ["phi"], 9)


@query("SELECT id, printf('%.1f', confidence * 100) AS percent FROM alerts_raw")
def confidence_pct(v):
    return v.alerts_raw.select("id", C.percent(F.col("confidence")).alias("percent"))


# --- behavioural detectors

_N = f"SELECT flow_key, ts, src_ip, dst_ip, dst_port, conn_state, duration, src_pkts, http_status_code, http_request_body_len, http_response_body_len, coalesce({_num('src_bytes')}, 0) AS src_bytes, coalesce({_num('dst_bytes')}, 0) AS dst_bytes FROM flows_raw"


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(f"""WITH n AS ({_N}) SELECT * FROM (SELECT dst_ip, make_timestamp(CAST(floor(epoch(ts) / 2592000) AS BIGINT) * 2592000 * 1000000) AS window_start, count(*) AS flows, round(sum(src_bytes), 3) AS bytes, round(avg(duration), 6) AS avg_duration FROM n GROUP BY 1, 2) WHERE flows >= 5 AND bytes >= 100000 AND avg_duration <= 60""")
def detect_flood(v):
    return _ntz(_rounded(_rounded(detectors.detect_flood(v.flows_raw), ["bytes"], 3), ["avg_duration"]), "window_start")


_BAD = "conn_state IN ('REJ', 'RSTO', 'RSTOS0', 'RSTR', 'RSTRH')"


@query(f"""WITH o AS (SELECT *, {_BAD} AS bad, row_number() OVER (PARTITION BY src_ip ORDER BY ts, flow_key) AS i, row_number() OVER (PARTITION BY src_ip, {_BAD} ORDER BY ts, flow_key) AS j FROM flows_raw)
SELECT src_ip, count(*) AS tries, count(DISTINCT dst_port) AS ports, min(ts) AS first_ts, max(ts) AS last_ts FROM o WHERE bad GROUP BY src_ip, i - j HAVING count(*) >= 3 AND count(DISTINCT dst_port) >= 2""")
def detect_scan(v):
    return detectors.detect_scan(v.flows_raw)


@query(f"""WITH n AS ({_N}), g AS (SELECT src_ip, src_bytes, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY src_ip ORDER BY ts, flow_key) AS gap FROM n WHERE conn_state IN ('S0', 'SH', 'SHR')),
a AS (SELECT src_ip, count(*) AS tries, avg(gap) AS m, stddev_pop(gap) AS sd, max(src_bytes) AS t, avg(src_bytes) AS x FROM g GROUP BY src_ip)
SELECT src_ip, tries, round(m, 3) AS avg_gap, round(sd / m, 6) AS variation, round(t / x, 6) AS spike FROM a WHERE tries >= 3 AND m > 0 AND sd / m <= 1.0 AND x > 0 AND t / x >= 1.2""")
def detect_beacon(v):
    return _rounded(_rounded(detectors.detect_beacon(v.flows_raw), ["avg_gap"], 3), ["variation", "spike"])


@query("""SELECT src_ip, dst_ip, flows, round(ratio, 6) AS ratio, round(errors, 6) AS error_share FROM (SELECT src_ip, dst_ip, count(*) AS flows, CASE WHEN sum(http_request_body_len) > 0 THEN sum(http_response_body_len)::DOUBLE / sum(http_request_body_len)::DOUBLE END AS ratio, avg(CASE WHEN http_status_code >= 400 THEN 1.0 ELSE 0 END) AS errors FROM flows_raw WHERE http_status_code > 0 GROUP BY src_ip, dst_ip) WHERE coalesce(ratio, 0) >= 50 OR errors >= 0.5""")
def detect_web_exploit(v):
    return _rounded(detectors.detect_web_exploit(v.flows_raw), ["ratio", "error_share"])


@query(f"WITH n AS ({_N}) SELECT src_ip, dst_ip, count(*) AS flows, sum(src_bytes) AS bytes_in, sum(dst_bytes) AS bytes_out FROM n WHERE src_bytes >= 50000 AND dst_bytes <= src_bytes * 0.02 GROUP BY src_ip, dst_ip")
def detect_infiltration(v):
    return detectors.detect_infiltration(v.flows_raw)


@query(f"""WITH n AS ({_N}), l AS (SELECT quantile_cont(duration, 0.95) AS q FROM n), r AS (SELECT src_ip, count(*) AS flows, avg(src_bytes / duration) AS m, stddev_pop(src_bytes / duration) AS sd FROM n CROSS JOIN l WHERE duration >= q AND duration > 0 GROUP BY src_ip)
SELECT src_ip, flows, round(m, 6) AS avg_rate, round(sd / m, 6) AS variation FROM r WHERE flows >= 2 AND m > 0 AND sd / m <= 0.6""")
def detect_exfil(v):
    return _rounded(detectors.detect_exfil(v.flows_raw), ["avg_rate", "variation"])


@query("SELECT src_ip, dst_ip, dst_port, src_pkts, count(*) AS tries, min(ts) AS first_ts, max(ts) AS last_ts FROM flows_raw WHERE dst_port IN (21, 22, 23) AND conn_state <> 'SF' GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2")
def detect_bruteforce(v):
    return detectors.detect_bruteforce(v.flows_raw)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts behind the web-exploit findings, with how many and how late, and the gateway."""
    v = Views(spark, sf_dir)
    found = detectors.detect_web_exploit(v.flows_raw)
    last = v.flows_raw.join(found.select("src_ip", "dst_ip"), ["src_ip", "dst_ip"], "left_semi")
    rows = last.select(F.md5("flow_key").alias("id"), F.col("ts").alias("timestamp"), F.col("src_ip").alias("source_ip"))
    return alerts.host_rollup(rows)
