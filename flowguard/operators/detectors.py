"""Seven behavioural detectors. Each takes flows with ts, src_ip, dst_ip and numbers, and returns findings with evidence.
No thresholds are fixed anywhere: all are parameters. Text numbers are coerced here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowguard.functions.columns import numbers_of
from flowguard.operators.profile import quantiles
from flowguard.sources.scratch import written


def numbers(flows: DataFrame) -> DataFrame:
    """Flows with src_bytes and dst_bytes as numbers (0 where there is none) and ts as a timestamp."""
    return flows.withColumns({c: F.coalesce(x, F.lit(0.0)) for c, x in numbers_of(flows, ["src_bytes", "dst_bytes"]).items()}).withColumn("ts", F.col("ts").cast("timestamp"))


def flood_windows(flows: DataFrame, width: str) -> DataFrame:
    """Per target and window; the stream uses the same aggregation."""
    return flows.groupBy("dst_ip", F.window("ts", width).alias("w")).agg(F.count("*").alias("flows"), F.sum("src_bytes").alias("bytes"), F.avg("duration").alias("avg_duration"))


def detect_flood(flows: DataFrame, width: str = "30 days", least_flows: int = 5, least_bytes: float = 100_000, most_duration: float = 60) -> DataFrame:
    """Very many bytes over nearly instant connections to one target."""
    found = flood_windows(numbers(flows), width)
    hit = (F.col("flows") >= least_flows) & (F.col("bytes") >= least_bytes) & (F.col("avg_duration") <= most_duration)
    return found.where(hit).select("dst_ip", F.col("w.start").alias("window_start"), "flows", "bytes", "avg_duration")


REJECTED = ("REJ", "RSTO", "RSTOS0", "RSTR", "RSTRH")


def _in_ranges(rows: DataFrame) -> DataFrame:
    """Rows dealt to ordered ranges of (src_ip, ts, flow_key), whose number is part, as a written table: a busy source lies in several of them."""
    return written(rows.repartitionByRange("src_ip", "ts", "flow_key").withColumn("part", F.spark_partition_id()), "ranges")


def detect_scan(flows: DataFrame, least_streak: int = 3, least_ports: int = 2, states: tuple[str, ...] = REJECTED) -> DataFrame:
    """Streaks of consecutive rejected tries of one source over several ports. A streak is named by the number of other
    tries of the source before it: those of earlier ranges and those inside its own."""
    tries = _in_ranges(flows.select("src_ip", "dst_port", "ts", "flow_key", F.coalesce(F.col("conn_state").isin(*states), F.lit(False)).alias("bad")))
    goods = tries.groupBy("src_ip", "part").agg(F.count_if(~F.col("bad")).alias("goods"))
    earlier = W.partitionBy("src_ip").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = goods.select("src_ip", "part", F.coalesce(F.sum("goods").over(earlier), F.lit(0)).alias("before"))
    inside = F.count_if(~F.col("bad")).over(W.partitionBy("src_ip", "part").orderBy("ts", "flow_key").rowsBetween(W.unboundedPreceding, 0))
    streaks = tries.withColumn("inside", inside).where("bad").join(before, ["src_ip", "part"]).withColumn("streak", F.col("before") + F.col("inside"))
    found = streaks.groupBy("src_ip", "streak").agg(F.count("*").alias("tries"), F.count_distinct("dst_port").alias("ports"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.where((F.col("tries") >= least_streak) & (F.col("ports") >= least_ports)).select("src_ip", "tries", "ports", "first_ts", "last_ts")


INCOMPLETE = ("S0", "SH", "SHR")


def detect_beacon(flows: DataFrame, least_tries: int = 3, most_variation: float = 1.0, least_spike: float = 1.2, states: tuple[str, ...] = INCOMPLETE) -> DataFrame:
    """Rhythmic incomplete handshakes of a source, with irregular outward spikes: little variation of the gaps between
    tries, and a largest flow well above the mean."""
    tries = numbers(flows).where(F.col("conn_state").isin(*states))
    tries = _in_ranges(tries.select("src_ip", "ts", "flow_key", "src_bytes", F.unix_timestamp("ts").alias("at")))
    inside = F.col("at") - F.lag("at").over(W.partitionBy("src_ip", "part").orderBy("ts", "flow_key"))
    # The gap between a range's first try and the last one before it belongs to the range.
    ends = tries.groupBy("src_ip", "part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    between = ends.select("src_ip", (F.col("first") - F.lag("last").over(W.partitionBy("src_ip").orderBy("part"))).alias("gap"))
    every = tries.select("src_ip", "src_bytes", inside.alias("gap"), F.lit(1).alias("try")).unionAll(between.select("src_ip", F.lit(None).cast("double"), "gap", F.lit(0)))
    gaps = every.withColumn("gap", F.col("gap").cast("double")).groupBy("src_ip").agg(F.sum("try").alias("tries"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd"), F.max("src_bytes").alias("top"), F.avg("src_bytes").alias("mean"))
    found = gaps.withColumn("variation", F.try_divide("sd", "m")).withColumn("spike", F.try_divide("top", "mean"))
    hit = (F.col("tries") >= least_tries) & (F.col("variation") <= most_variation) & (F.col("spike") >= least_spike)
    return found.where(hit).select("src_ip", "tries", F.col("m").alias("avg_gap"), "variation", "spike")


def detect_web_exploit(flows: DataFrame, least_ratio: float = 50, least_errors: float = 0.5, least_flows: int = 1) -> DataFrame:
    """Small requests with huge responses, or frequent HTTP errors, between two hosts."""
    web = flows.where("http_status_code > 0")
    found = web.groupBy("src_ip", "dst_ip").agg(
        F.count("*").alias("flows"), F.try_divide(F.sum("http_response_body_len").cast("double"), F.sum("http_request_body_len").cast("double")).alias("ratio"),
        F.avg((F.col("http_status_code") >= 400).cast("int")).alias("error_share"),
    )
    hit = (F.col("flows") >= least_flows) & ((F.coalesce("ratio", F.lit(0.0)) >= least_ratio) | (F.col("error_share") >= least_errors))
    return found.where(hit)


def detect_infiltration(flows: DataFrame, least_in: float = 50_000, most_answer: float = 0.02) -> DataFrame:
    """A big payload in, hardly an answer, between two hosts."""
    big = numbers(flows).where((F.col("src_bytes") >= least_in) & (F.col("dst_bytes") <= F.col("src_bytes") * most_answer))
    return big.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("flows"), F.sum("src_bytes").alias("bytes_in"), F.sum("dst_bytes").alias("bytes_out"))


def long_limit(flows: DataFrame, q: float = 0.95) -> DataFrame:
    """The duration from which a flow counts as long, as one row."""
    found = quantiles(flows, ["duration"], q)["duration"]
    return flows.sparkSession.range(1).select(F.lit(found).cast("double").alias("limit"))


def detect_exfil(flows: DataFrame, least_flows: int = 2, most_variation: float = 0.6, limit: DataFrame | None = None) -> DataFrame:
    """Unnaturally long flows of a source with a slow and steady outward rate."""
    rows = numbers(flows)
    long = rows.crossJoin(F.broadcast(limit if limit is not None else long_limit(rows))).where("duration >= limit and duration > 0")
    rates = long.withColumn("rate", F.col("src_bytes") / F.col("duration")).groupBy("src_ip").agg(F.count("*").alias("flows"), F.avg("rate").alias("avg_rate"), F.stddev_pop("rate").alias("sd"))
    found = rates.withColumn("variation", F.try_divide("sd", "avg_rate"))
    return found.where((F.col("flows") >= least_flows) & (F.col("variation") <= most_variation)).select("src_ip", "flows", "avg_rate", "variation")


def detect_bruteforce(flows: DataFrame, least_tries: int = 2, ports: tuple[int, ...] = (21, 22, 23), done: str = "SF") -> DataFrame:
    """Repeated requests of equal size to a login port that never complete."""
    tries = flows.where(F.col("dst_port").isin(*ports) & (F.col("conn_state") != done))
    found = tries.groupBy("src_ip", "dst_ip", "dst_port", "src_pkts").agg(F.count("*").alias("tries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.where(F.col("tries") >= least_tries)
