"""Views over the given tables that stand in for flow feeds; Spark and DuckDB run the same text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "flows_raw": """
SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS flow_key,
 l_shipdate AS ts,
 concat('192.168.', CAST(floor(o_custkey/256.0) AS BIGINT), '.', o_custkey % 256) AS src_ip,
 concat('10.0.', CAST(floor(l_suppkey/256.0) AS BIGINT), '.', l_suppkey % 256) AS dst_ip,
 1024 + l_partkey % 60000 AS src_port,
 CASE l_partkey % 7 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 53 WHEN 3 THEN 80 WHEN 4 THEN 443 WHEN 5 THEN 21 ELSE 8080 END AS dst_port,
 CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'udp' ELSE 'icmp' END AS proto,
 CASE (l_partkey + l_linenumber) % 13 WHEN 0 THEN 'OTH' WHEN 1 THEN 'REJ' WHEN 2 THEN 'RSTO' WHEN 3 THEN 'RSTOS0' WHEN 4 THEN 'RSTR' WHEN 5 THEN 'RSTRH' WHEN 6 THEN 'S0' WHEN 7 THEN 'S1' WHEN 8 THEN 'S2' WHEN 9 THEN 'S3' WHEN 10 THEN 'SF' WHEN 11 THEN 'SH' ELSE 'SHR' END AS conn_state,
 floor(l_tax * 1000) + l_quantity AS duration,
 CASE WHEN l_partkey % 29 = 0 THEN '-' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)) END AS src_bytes,
 CASE WHEN l_partkey % 31 = 0 THEN '0.0.0.0' ELSE CAST(CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS VARCHAR(20)) END AS dst_bytes,
 CASE WHEN l_linenumber = 7 THEN l_partkey % 100 ELSE 0 END AS missed_bytes,
 CAST(l_quantity AS BIGINT) AS src_pkts,
 CAST(floor(l_quantity * l_discount * 10) AS BIGINT) AS dst_pkts,
 CAST(floor(l_extendedprice) AS BIGINT) + 40 * CAST(l_quantity AS BIGINT) AS src_ip_bytes,
 CAST(floor(l_extendedprice * l_discount) AS BIGINT) + 40 AS dst_ip_bytes,
 CASE WHEN l_partkey % 7 = 2 THEN 1 ELSE 0 END AS dns_qclass,
 CASE WHEN l_partkey % 7 = 2 THEN l_linenumber ELSE 0 END AS dns_qtype,
 CASE WHEN l_partkey % 7 = 2 THEN l_linenumber % 4 ELSE 0 END AS dns_rcode,
 CASE WHEN l_partkey % 7 = 3 THEN l_linenumber * 10 ELSE 0 END AS http_request_body_len,
 CASE WHEN l_partkey % 7 = 3 THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END AS http_response_body_len,
 CASE WHEN l_partkey % 7 = 3 THEN CASE WHEN l_linenumber >= 6 THEN 500 WHEN l_linenumber = 5 THEN 404 ELSE 200 END ELSE 0 END AS http_status_code,
 CASE WHEN l_partkey % 7 IN (3, 4) THEN 'http' ELSE '-' END AS service,
 CASE WHEN l_discount >= 0.08 AND l_returnflag <> 'A' OR l_partkey % 53 = 0 THEN 1 ELSE 0 END AS label,
 CASE WHEN NOT (l_discount >= 0.08 AND l_returnflag <> 'A' OR l_partkey % 53 = 0) THEN 'normal'
      ELSE CASE l_linenumber % 4 WHEN 0 THEN 'ddos' WHEN 1 THEN 'scanning' WHEN 2 THEN 'injection' ELSE 'backdoor' END END AS type,
 CASE l_orderkey % 3 WHEN 0 THEN 'ton' WHEN 1 THEN 'bot' ELSE 'cic' END AS domain
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "flows_bot": """
SELECT flow_key, CAST(src_ip_bytes - 40 * src_pkts AS DOUBLE) AS sbytes, CAST(dst_ip_bytes - 40 AS DOUBLE) AS dbytes,
 src_pkts AS spkts, dst_pkts AS dpkts, duration AS dur, src_ip_bytes AS TnBPSrcIP, dst_ip_bytes AS TnBPDstIP,
 CASE src_port % 7 WHEN 0 THEN 'CON' WHEN 1 THEN 'RST' WHEN 2 THEN 'REQ' WHEN 3 THEN 'INT' WHEN 4 THEN 'FIN' WHEN 5 THEN 'URP' ELSE 'ACC' END AS state,
 proto, label AS attack
FROM flows_raw WHERE domain = 'bot'""",
    "flows_cic": """
SELECT flow_key, duration AS flow_duration, src_pkts AS total_fwd_packets, dst_pkts AS total_backward_packets,
 src_ip_bytes - 40 * src_pkts AS total_length_of_fwd_packets, dst_ip_bytes - 40 AS total_length_of_bwd_packets,
 CASE WHEN src_port % 41 = 0 THEN 'Infinity' WHEN src_port % 43 = 0 THEN 'NaN' ELSE CAST(src_ip_bytes AS VARCHAR(20)) END AS flow_bytes_s,
 CASE WHEN label = 0 THEN 'BENIGN' ELSE type END AS Label
FROM flows_raw WHERE domain = 'cic'""",
    "alerts_raw": """
SELECT CAST(event_id AS VARCHAR(20)) AS id, ts AS timestamp,
 concat('192.168.', CAST(floor(user_id/256.0) AS BIGINT), '.', user_id % 256) AS source_ip,
 concat('10.0.0.', 1 + event_id % 100) AS target_ip,
 concat('10.0.0.', 1 + event_id % 100) AS dest_ip,
 CASE event_id % 4 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'PortScan' WHEN 2 THEN 'Infiltration' ELSE 'Botnet' END AS attack_type,
 CAST(50 + event_id % 50 AS DOUBLE) / 100 AS confidence,
 'Alerted' AS status
FROM events WHERE event_type = 'error'""",
    "scores_raw": """
SELECT flow_key, ts, domain, label,
 CAST(label * 39 + src_port % 62 AS DOUBLE) / 100 AS p_rf,
 CAST(label * 29 + src_ip_bytes % 72 AS DOUBLE) / 100 AS p_nn
FROM flows_raw""",
    "phi_raw": """
SELECT flow_key, ts, t.f AS feature, CAST((src_port * t.k) % 76 AS DOUBLE) / 100 - 0.25 AS phi
FROM flows_raw CROSS JOIN (VALUES (1,'src_bytes'),(3,'dst_bytes'),(5,'duration'),(7,'src_pkts'),(11,'dst_pkts'),(13,'conn_state_SF')) AS t(k, f)""",
}
TABLES = ("lineitem", "orders", "events", "documents", "labels", "embeddings", "customer", "supplier", "part")


class Views:
    """The fixture views of one folder of tables as frames: views.flows_raw and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._found: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._found:
            self._found[name] = self.sql(VIEWS[name]) if name in VIEWS else self.table(name)
        return self._found[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the views and tables it names."""
        used = [n for n in (*VIEWS, *TABLES) if re.search(rf"\b{n}\b", text)]
        for n in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in used if f"{{{n}}}" in text})


def with_views(sql: str) -> str:
    """A DuckDB statement that defines the fixture views that `sql` needs before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                need.append(name)

    add(sql)
    if not need:
        return sql
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"
