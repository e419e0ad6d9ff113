"""DuckDB oracle SQL for every SQL-checkable query in the catalog.

Each statement runs against the driver's pre-registered tables; the two fixture
views are inlined as CTEs so that every statement is self-contained.
"""

from __future__ import annotations

LOGS_CTE = """logs AS (
  SELECT event_id AS log_id, CAST(ts AS TIMESTAMP) AS "timestamp",
    '192.168.1.' || CAST(user_id % 50 + 1 AS VARCHAR(20)) AS source,
    '10.0.0.' || CAST(event_id % 10 + 1 AS VARCHAR(20)) AS destination,
    CASE event_type WHEN 'click' THEN 'user_login' WHEN 'purchase' THEN 'user_login'
      WHEN 'view' THEN 'file_access' WHEN 'signup' THEN 'system_update'
      ELSE CASE event_id % 3 WHEN 0 THEN 'APT_attack_port_scan' WHEN 1 THEN 'APT_attack_data_exfiltration'
        ELSE 'APT_attack_bruteforce' END
    END AS event,
    CASE event_id % 11 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 53 WHEN 3 THEN 80 WHEN 4 THEN 443
      WHEN 5 THEN 445 WHEN 6 THEN 3389 WHEN 7 THEN 8080 WHEN 8 THEN 1024 WHEN 9 THEN 50000 END AS dst_port,
    CASE event_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS protocol,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS bytes
  FROM events)"""

FLOWS_CTE = """flows AS (
  SELECT b.*, CASE WHEN b.is_apt = 1 AND (b.flow_id % 100003) % 10 < 7 THEN 1
               WHEN b.is_apt = 0 AND (b.flow_id % 100003) % 10 = 9 THEN 1 ELSE 0 END AS siem_detection,
    CAST(b.flow_id % 1009 AS INTEGER) AS siem_delay_s, CAST(b.flow_id % 907 AS INTEGER) AS ml_delay_s
  FROM (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS flow_id,
    l_shipdate AS flow_start,
    l_quantity * 20 AS "Flow Duration",
    CAST(l_partkey % 97 + l_quantity * 4 AS DOUBLE) AS "Total Fwd Packet",
    CAST(l_suppkey % 41 + l_quantity * 2 AS DOUBLE) AS "Total Bwd packets",
    CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_extendedprice END AS "Flow Bytes/s",
    1 + l_discount * 500 AS "Flow Packets/s",
    CAST(l_partkey % 800 AS DOUBLE) AS "Packet Length Mean",
    CAST(10 + l_suppkey % 200 AS DOUBLE) AS "Packet Length Std",
    CAST((10 + l_suppkey % 200) * (10 + l_suppkey % 200) AS DOUBLE) AS "Packet Length Variance",
    CAST(l_linenumber % 2 AS DOUBLE) AS "FIN Flag Count", CAST(l_orderkey % 2 AS DOUBLE) AS "SYN Flag Count",
    CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END AS "RST Flag Count",
    CAST(l_partkey % 2 AS DOUBLE) AS "PSH Flag Count",
    CASE WHEN l_linestatus = 'F' THEN 1.0e0 ELSE 0.0e0 END AS "ACK Flag Count",
    CAST(l_suppkey % 2 AS DOUBLE) AS "URG Flag Count",
    CAST(l_partkey % 800 AS DOUBLE) AS "Average Packet Size",
    CAST(200 + l_partkey % 1000 AS DOUBLE) AS "Fwd Segment Size Avg",
    CAST(100 + l_suppkey % 400 AS DOUBLE) AS "Bwd Segment Size Avg",
    CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN CASE WHEN l_linenumber % 3 = 0 THEN 'exfiltration'
      ELSE 'lateral' END ELSE 'normal' END AS "Stage",
    CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 1 ELSE 0 END AS is_apt
  FROM lineitem) b)"""


def with_logs(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join((LOGS_CTE,) + extra_ctes)
    return f"WITH {ctes}\n{body}"


def with_flows(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join((FLOWS_CTE,) + extra_ctes)
    return f"WITH {ctes}\n{body}"


def with_both(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join((LOGS_CTE, FLOWS_CTE) + extra_ctes)
    return f"WITH {ctes}\n{body}"


# Reusable SQL fragments ----------------------------------------------------

def iso_sql(ts: str) -> str:
    """ISO-8601 text, microseconds only when non-zero."""
    micros = f"((epoch_us({ts}) % 1000000) + 1000000) % 1000000"
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} = 0 THEN '' "
            f"ELSE '.' || lpad(CAST({micros} AS VARCHAR), 6, '0') END)")


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> str:
    ORACLE[name] = sql
    return sql
