"""DuckDB oracle text for the fixture views (FIXTURES.md section 2).

The driver registers only the raw tables, so every oracle statement
inlines the views it needs as CTEs.  ``sql(body, *views)`` prepends the
CTE chain; view dependencies are resolved here.
"""

from __future__ import annotations

QTYPES = "1, 2, 5, 6, 12, 15, 16, 28, 33, 255"

_VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, deps: list[str], text: str) -> None:
    _VIEWS[name] = (deps, text)


_view("fl_b", [], """
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k,
         (event_id * 7919 + CAST(json_extract(props, '$.k') AS INT) * 104729) % 1000 AS x,
         CASE WHEN event_type IN ('error','purchase') THEN 1 ELSE 0 END AS y
  FROM events""")

_view("fl_f", ["fl_b"], """
  SELECT event_id AS flow_id, ts, y, x, k,
    concat('10.0.', CAST(CAST(floor(user_id / 16) AS INT) AS VARCHAR), '.', CAST(user_id % 16 AS VARCHAR)) AS src_ip,
    concat('172.31.0.', CAST(k % 8 AS VARCHAR)) AS dst_ip,
    CAST(1024 + event_id % 60000 AS INT) AS src_port,
    CAST(CASE k % 4 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 22 END AS INT) AS dst_port,
    CAST(CASE k % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS INT) AS PROTOCOL,
    CAST(floor(value * 20) AS DOUBLE) AS IN_PKTS,
    CAST(floor(value * (k % 5)) AS DOUBLE) AS OUT_PKTS,
    CAST(floor(value * value * (k % 11) * 500) AS DOUBLE) AS IN_BYTES,
    CAST(floor(value * 100) AS DOUBLE) AS OUT_BYTES,
    CAST((event_id * 37) % 7000 AS DOUBLE) AS FLOW_DURATION_MILLISECONDS,
    CAST(CASE WHEN k % 7 = 0 THEN floor(value * 10) ELSE 0 END AS DOUBLE) AS RETRANSMITTED_IN_PKTS,
    CAST(CASE WHEN k % 7 = 0 AND event_id % 2 = 0 THEN floor(value * 8) ELSE 0 END AS DOUBLE) AS RETRANSMITTED_OUT_PKTS,
    CAST(CASE WHEN k % 3 = 2 THEN 8 ELSE -1 END AS INT) AS ICMP_TYPE,
    CAST(-1 AS INT) AS ICMP_IPV4_TYPE,
    CAST(CASE WHEN k % 4 = 0 THEN 1 + event_id % 9 ELSE 0 END AS INT) AS DNS_QUERY_ID,
    CAST(CASE WHEN k % 16 = 8 THEN 99 WHEN k % 4 = 0 THEN 1 ELSE -1 END AS INT) AS DNS_QUERY_TYPE,
    CAST(CASE WHEN k % 8 = 0 THEN 0 ELSE 300 END AS DOUBLE) AS DNS_TTL_ANSWER,
    CASE WHEN y = 0 THEN CASE event_id % 4 WHEN 0 THEN 'Benign' WHEN 1 THEN ' benign ' WHEN 2 THEN '0' ELSE 'normal' END
         ELSE CASE event_id % 4 WHEN 0 THEN 'Attack' WHEN 1 THEN '1' WHEN 2 THEN 'TRUE' ELSE 'weird' END END AS Label,
    CASE WHEN y = 0 THEN 'Benign' ELSE CASE k % 14
      WHEN 0 THEN 'Bot' WHEN 1 THEN 'Brute_Force_-Web' WHEN 2 THEN 'Brute_Force_-XSS' WHEN 3 THEN 'DDOS_attack-HOIC'
      WHEN 4 THEN 'DDOS_attack-LOIC-UDP' WHEN 5 THEN 'DDoS_attacks-LOIC-HTTP' WHEN 6 THEN 'DoS_attacks-GoldenEye'
      WHEN 7 THEN 'DoS_attacks-Hulk' WHEN 8 THEN 'DoS_attacks-SlowHTTPTest' WHEN 9 THEN 'DoS_attacks-Slowloris'
      WHEN 10 THEN 'FTP-BruteForce' WHEN 11 THEN 'Infilteration' WHEN 12 THEN 'SQL_Injection' ELSE 'SSH-Bruteforce' END END AS Attack,
    CAST(CASE WHEN y = 1 THEN 35000 + 65 * x ELSE 65 * x END AS DOUBLE) / 100000 AS p_model,
    CAST((event_id * 31 + k * 17) % 1000 AS DOUBLE) / 100000 AS recon_error
  FROM fl_b""")

_view("flows", ["fl_f"], """
  SELECT *, IN_BYTES / greatest(CAST(0.000001 AS DOUBLE), FLOW_DURATION_MILLISECONDS / CAST(1000 AS DOUBLE)) AS SRC_TO_DST_AVG_THROUGHPUT,
            OUT_BYTES / greatest(CAST(0.000001 AS DOUBLE), FLOW_DURATION_MILLISECONDS / CAST(1000 AS DOUBLE)) AS DST_TO_SRC_AVG_THROUGHPUT
  FROM fl_f""")

_view("scored", ["flows"], """
  SELECT flow_id AS row_id, y, p_model AS p, CASE WHEN p_model >= 0.5 THEN 1 ELSE 0 END AS yhat,
         recon_error AS err, CAST(x AS DOUBLE) / 1000 AS p2, Attack
  FROM flows""")

_view("fl_rin", ["flows"], f"""
  SELECT *, IN_PKTS + OUT_PKTS AS _pkts, IN_BYTES + OUT_BYTES AS _bytes, FLOW_DURATION_MILLISECONDS AS _dur,
         (RETRANSMITTED_IN_PKTS + RETRANSMITTED_OUT_PKTS) / greatest(1.0, IN_PKTS + OUT_PKTS) AS _rr,
         greatest(SRC_TO_DST_AVG_THROUGHPUT, DST_TO_SRC_AVG_THROUGHPUT) AS _thr,
         (DNS_QUERY_ID > 0 OR DNS_QUERY_TYPE IN ({QTYPES})) AS _is_dns
  FROM flows""")

_view("fl_rules", ["fl_rin"], f"""
  SELECT *, CASE
    WHEN _is_dns AND DNS_TTL_ANSWER = 0 AND _pkts >= 3 AND _dur > 0 THEN 1
    WHEN (ICMP_TYPE <> -1 OR ICMP_IPV4_TYPE <> -1) AND _pkts >= 2000 AND _dur > 0 AND _dur <= 5000 THEN 2
    WHEN _pkts >= 200 AND _rr >= CAST(0.60 AS DOUBLE) THEN 3
    WHEN _dur > 0 AND _dur <= 3000 AND _thr >= CAST(1e8 AS DOUBLE) THEN 4
    WHEN _is_dns AND (src_port = 53 OR dst_port = 53 OR DNS_QUERY_TYPE IN ({QTYPES})) AND _pkts >= 2 AND _bytes >= 60 AND DNS_TTL_ANSWER = 0 THEN 5
    WHEN _dur > 0 AND _dur <= 1000 AND _pkts >= 500 THEN 6
    WHEN _dur > 0 AND _dur <= 2000 AND _bytes >= CAST(5e7 AS DOUBLE) THEN 7
    WHEN _thr >= CAST(5e7 AS DOUBLE) THEN 8
    WHEN _pkts >= 100 AND _rr >= CAST(0.35 AS DOUBLE) THEN 9
    WHEN PROTOCOL = 17 AND _dur > 0 AND _dur <= 2000 AND _pkts >= 800 THEN 10
  END AS rule_id
  FROM fl_rin""")

_view("fl_hits", ["fl_rules"], """
  SELECT *,
    CASE rule_id WHEN 1 THEN 'DNS_TTL_ANOMALY' WHEN 2 THEN 'ICMP_BURST' WHEN 3 THEN 'HIGH_RETRANSMISSION_RATIO'
      WHEN 4 THEN 'THROUGHPUT_EXTREME_SHORT' WHEN 5 THEN 'DNS_TTL_ANOMALY' WHEN 6 THEN 'SHORT_PKT_BURST'
      WHEN 7 THEN 'SHORT_BYTES_BURST' WHEN 8 THEN 'THROUGHPUT_SPIKE' WHEN 9 THEN 'RETRANSMISSION_SUSPECT'
      WHEN 10 THEN 'UDP_BURST' END AS rule_name,
    CASE WHEN rule_id IN (2, 3, 4) THEN 'high' WHEN rule_id IS NOT NULL THEN 'medium' END AS rule_severity,
    CAST(CASE rule_id WHEN 1 THEN 0.55 WHEN 2 THEN 0.97 WHEN 3 THEN 0.95 WHEN 4 THEN 0.93 WHEN 5 THEN 0.55
      WHEN 6 THEN 0.65 WHEN 7 THEN 0.62 WHEN 8 THEN 0.60 WHEN 9 THEN 0.58 WHEN 10 THEN 0.62 END AS DOUBLE) AS rule_score,
    CASE WHEN recon_error >= 0.009 THEN 'dede_blocked' WHEN recon_error >= 0.002 THEN 'ganopt_stacking'
         ELSE 'standard_stacking' END AS ml_stage,
    CASE WHEN recon_error >= 0.009 THEN 1 WHEN p_model >= 0.5 THEN 1 ELSE 0 END AS ml_pred
  FROM fl_rules""")

_view("events_scored", ["fl_hits"], """
  SELECT flow_id, flow_id AS seq, ts, src_ip, dst_ip, src_port, dst_port, PROTOCOL,
    rule_name, rule_severity, rule_score,
    CAST(CASE WHEN rule_severity = 'high' OR ml_pred = 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS p_attack,
    CASE WHEN rule_severity = 'high' THEN 'rule' WHEN rule_id IS NOT NULL AND ml_pred = 1 THEN ml_stage
         WHEN rule_id IS NOT NULL THEN 'rule' ELSE ml_stage END AS stage,
    CASE WHEN rule_severity = 'high' THEN 'attack' WHEN rule_id IS NOT NULL AND ml_pred = 1 THEN 'attack'
         WHEN rule_id IS NOT NULL THEN 'suspicious' WHEN ml_pred = 1 THEN 'attack' ELSE 'benign' END AS verdict,
    CASE WHEN rule_severity = 'high' THEN 'rule_blocked' WHEN ml_pred = 1 THEN 'malicious' END AS family,
    CAST(CASE WHEN rule_severity = 'high' OR ml_pred = 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS family_conf,
    CASE WHEN rule_severity = 'high' THEN 'rule-only' WHEN rule_id IS NOT NULL AND ml_pred = 1 THEN 'both'
         WHEN rule_id IS NOT NULL THEN 'rule-only' WHEN ml_pred = 1 THEN 'ml-only' ELSE 'none' END AS final_source,
    CASE WHEN rule_severity = 'high' THEN 'benign' WHEN ml_pred = 1 THEN 'attack' ELSE 'benign' END AS ml_verdict,
    recon_error AS dede_error, p_model, y AS gt_label, Attack AS gt_attack
  FROM fl_hits""")

_view("vectors", [], """
  SELECT row_id, features, y, family,
         CASE WHEN row_number() OVER (PARTITION BY y ORDER BY md5(concat('42|', CAST(row_id AS VARCHAR))), row_id)
                   <= floor(0.2 * count(*) OVER (PARTITION BY y)) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT vec_id AS row_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS features,
               CASE WHEN label >= 7 THEN 1 ELSE 0 END AS y, label AS family FROM embeddings) v""")


_view("scored_long", ["scored"], """
  SELECT row_id, y, 'p' AS model, p AS score FROM scored
  UNION ALL SELECT row_id, y, 'p2' AS model, p2 AS score FROM scored""")

# evaluation grid: train scenario x defence, every row of scored in every cell
_view("eval_long", ["scored"], """
  SELECT row_id, y, err, t.train_scenario, d.defence,
    CASE WHEN d.defence = 'gate' AND err > 0.009 THEN 1
         WHEN t.train_scenario = 'clean' THEN CASE WHEN p >= 0.5 THEN 1 ELSE 0 END
         ELSE CASE WHEN p2 >= 0.5 THEN 1 ELSE 0 END END AS pred,
    CASE WHEN d.defence = 'gate' AND err > 0.009 THEN 1 ELSE 0 END AS stage1
  FROM scored, (VALUES ('clean'), ('poison_50')) t(train_scenario), (VALUES ('none'), ('gate')) d(defence)""")

_view("eval_matrix", ["eval_long"], """
  SELECT train_scenario, defence,
    round(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE y = pred) / count(*) END, 6) AS accuracy,
    round(CASE WHEN count(*) FILTER (WHERE pred = 1) = 0 THEN 0.0
          ELSE count(*) FILTER (WHERE y = 1 AND pred = 1) / count(*) FILTER (WHERE pred = 1) END, 6) AS precision,
    round(CASE WHEN count(*) FILTER (WHERE y = 1) = 0 THEN 0.0
          ELSE count(*) FILTER (WHERE y = 1 AND pred = 1) / count(*) FILTER (WHERE y = 1) END, 6) AS recall,
    round(CASE WHEN 2 * count(*) FILTER (WHERE y = 1 AND pred = 1) + count(*) FILTER (WHERE y <> pred) = 0 THEN 0.0
          ELSE 2 * count(*) FILTER (WHERE y = 1 AND pred = 1) /
               (2 * count(*) FILTER (WHERE y = 1 AND pred = 1) + count(*) FILTER (WHERE y <> pred)) END, 6) AS f1_score,
    round(count(*) FILTER (WHERE stage1 = 1) * 100.0 / count(*), 6) AS stage1_pct
  FROM eval_long GROUP BY 1, 2""")


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in _VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views...>, <extra...> <body>``."""
    parts = [f"{n} AS ({_VIEWS[n][1]}\n)" for n in _order(views)]
    parts += [f"{n} AS ({t})" for n, t in (extra or [])]
    if not parts:
        return body
    b = body.lstrip()
    if b[:4].upper() == "WITH":
        return "WITH " + ",\n".join(parts) + ",\n" + b[4:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body
