"""The flow contract: columns, their order and their kinds, and the dialects' names for them."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the data contract.
NUMERIC = [
    "duration", "src_bytes", "dst_bytes", "missed_bytes", "src_pkts", "src_ip_bytes", "dst_pkts", "dst_ip_bytes",
    "dns_qclass", "dns_qtype", "dns_rcode", "http_request_body_len", "http_response_body_len", "http_status_code",
]
PROTOCOLS = ["tcp", "udp"]
STATES = ["REJ", "RSTO", "RSTOS0", "RSTR", "RSTRH", "S0", "S1", "S2", "S3", "SF", "SH", "SHR"]
FEATURES = NUMERIC + [f"proto_{p}" for p in PROTOCOLS] + [f"conn_state_{s}" for s in STATES]
CONTEXT = ["ts", "src_ip", "src_port", "dst_ip", "dst_port"]
MAPPED = [
    "src_bytes", "dst_bytes", "src_pkts", "dst_pkts", "duration", "src_ip_bytes", "dst_ip_bytes", "conn_state", "proto",
    "dns_qclass", "dns_qtype", "dns_rcode", "label",
]
VOLUME = ["src_bytes", "dst_bytes", "src_ip_bytes", "dst_ip_bytes", "duration"]
#: The names of two dialects, and what a dialect's states are called.
BOT_NAMES = {
    "sbytes": "src_bytes", "dbytes": "dst_bytes", "spkts": "src_pkts", "dpkts": "dst_pkts", "dur": "duration",
    "TnBPSrcIP": "src_ip_bytes", "TnBPDstIP": "dst_ip_bytes", "state": "conn_state", "attack": "label",
}
CIC_NAMES = {
    "total length of fwd packets": "src_bytes", "total length of bwd packets": "dst_bytes", "total fwd packets": "src_pkts",
    "total backward packets": "dst_pkts", "flow duration": "duration",
}
BOT_STATES = {"CON": "SF", "RST": "RSTR", "REQ": "S0", "INT": "OTH", "FIN": "SF", "URP": "OTH"}
#: The display names of features.
FEATURE_NAMES = {
    "src_bytes": "Data sent (Source Bytes)", "dst_pkts": "Packets received (Destination)", "duration": "Connection Time (Duration)",
    "src_ip_bytes": "Total Source IP Data", "dst_ip_bytes": "Total Destination IP Data", "conn_state_SF": "Normal Connection Finished",
    "conn_state_": "Abnormal Connection State", "proto_tcp": "TCP Protocol", "proto_udp": "UDP Protocol",
}

_KINDS = {"conn_state": T.StringType(), "proto": T.StringType(), **{c: T.IntegerType() for c in ("dns_qclass", "dns_qtype", "dns_rcode", "label")}}
FLOW_MAPPED = T.StructType([T.StructField(c, _KINDS.get(c, T.DoubleType())) for c in MAPPED])
ALERT = T.StructType(
    [T.StructField(c, T.DoubleType() if c == "confidence" else T.StringType()) for c in ("id", "timestamp", "source_ip", "target_ip", "dest_ip", "attack_type", "confidence", "status")]
)


def text_schema(columns: list[str]) -> T.StructType:
    """Every column as text; contracts cast later."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
