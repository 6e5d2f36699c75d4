"""Shared SQL of the checks: the input views and the main intermediate results, in DuckDB."""

from __future__ import annotations

from vigilgrid.functions.text import SPACE

TEMPLATE = (
    f"regexp_replace(regexp_replace(regexp_replace(lower(message), '^{SPACE}+|{SPACE}+$', '', 'g'), "
    f"'{SPACE}+', ' ', 'g'), '\\p{{Nd}}+', '<n>', 'g')"
)

CTES: dict[str, str] = {}

CTES["ev_raw"] = """
SELECT 'run-' || strftime(ts, '%Y%m%d') AS run_id,
       'HOST-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS host_id,
       user_id AS user_no, 'user' || user_id AS user_id, event_id AS record_id,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_raw, ts,
       json_extract_string(props, '$.k') AS k,
       CASE WHEN event_type = 'error' AND value >= 100 THEN 'bsod'
            WHEN event_type = 'error' THEN 'svc'
            WHEN event_type = 'view' AND value >= 60 THEN 'disk'
            WHEN event_type = 'click' AND value >= 60 THEN 'net'
            WHEN event_type = 'purchase' AND value >= 60 THEN 'upd'
            ELSE 'info' END AS kind
FROM events
"""
CTES["ev"] = """
SELECT *, CASE kind WHEN 'bsod' THEN 'BugCheck' WHEN 'svc' THEN 'Service Control Manager'
            WHEN 'disk' THEN 'Disk' WHEN 'upd' THEN 'WindowsUpdateClient'
            WHEN 'net' THEN CASE WHEN CAST(k AS INT) % 2 = 0 THEN 'e1cexpress' ELSE 'DNS Client Events' END
            ELSE 'Application' END AS provider,
       CASE kind WHEN 'bsod' THEN '1001' WHEN 'svc' THEN '7034' WHEN 'disk' THEN '2013' WHEN 'upd' THEN '20'
            WHEN 'net' THEN CASE WHEN CAST(k AS INT) % 2 = 0 THEN '10400' ELSE '1014' END
            ELSE '1000' END AS event_id,
       CASE WHEN kind IN ('bsod', 'svc', 'upd') THEN 'Error' WHEN kind = 'info' THEN 'Information'
            ELSE 'Warning' END AS level,
       CASE WHEN kind = 'info' THEN 'WindowsEventLog:Application' ELSE 'WindowsEventLog:System' END AS source,
       CASE WHEN kind = 'info' THEN 'Application' ELSE 'System' END AS channel,
       CASE kind WHEN 'bsod' THEN ['bsod', 'unexpected_shutdown'] WHEN 'disk' THEN ['disk_full']
            WHEN 'net' THEN CASE WHEN CAST(k AS INT) % 2 = 0 THEN ['network_reset'] ELSE ['dns_failure'] END
            WHEN 'upd' THEN ['update_failure'] WHEN 'info' THEN ['info']
            ELSE CAST([] AS VARCHAR[]) END AS tags,
       CASE kind WHEN 'bsod' THEN 'BugCheck 0x' || k || ' after driver install'
            WHEN 'svc' THEN 'Service Svc' || k || ' terminated unexpectedly'
            WHEN 'disk' THEN 'Disk C: usage at ' || k || '% threshold'
            WHEN 'net' THEN CASE WHEN CAST(k AS INT) % 2 = 0 THEN 'Link reset on adapter ' || k
                                 ELSE 'Name resolution failure for critical service' END
            WHEN 'upd' THEN 'Failed to install cumulative update KB' || k
            ELSE 'Routine application telemetry' END AS message
FROM ev_raw
"""
CTES["evf"] = "SELECT * FROM ev WHERE run_id > 'run-20240105'"
CTES["ee"] = """
SELECT *, 0 AS snap_rank, record_id AS pos FROM ev
UNION ALL
SELECT *, 1 AS snap_rank, record_id AS pos FROM ev WHERE record_id % 10 = 0
"""
CTES["dd"] = """
SELECT * FROM ee
QUALIFY row_number() OVER (
  PARTITION BY run_id, host_id, record_id, ts_raw, provider, event_id, message ORDER BY snap_rank, pos) = 1
"""
CTES["sn_raw"] = """
SELECT run_id, host_id, snap_rank, user_no, max(user_id) AS named, count(*) AS event_count,
       substr(run_id, 5, 4) || '-' || substr(run_id, 9, 2) || '-' || substr(run_id, 11, 2) AS day
FROM ee GROUP BY run_id, host_id, snap_rank, user_no
"""
CTES["sn"] = """
SELECT run_id, host_id, snap_rank, user_no, CASE WHEN user_no % 5 <> 0 THEN named END AS user_id, event_count,
       run_id || '/snapshots/' || host_id || '/snapshot-' || substr(run_id, 5, 8)
         || CASE WHEN snap_rank = 1 THEN 'T180000Z' ELSE 'T235959Z' END || '.json' AS key,
       CASE WHEN user_no % 11 <> 0 THEN CAST(day AS TIMESTAMP) END AS window_start,
       CASE WHEN user_no % 11 <> 0 AND NOT (snap_rank = 1 AND user_no % 7 = 0)
            THEN CAST(day || CASE WHEN snap_rank = 1 THEN ' 18:00:00' ELSE ' 23:59:59' END AS TIMESTAMP)
       END AS window_end
FROM sn_raw
"""
CTES["rn"] = "SELECT DISTINCT run_id FROM ev_raw"
CTES["prv"] = "SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS prev_run_id FROM rn"
CTES["span"] = "SELECT run_id, host_id, min(ts) AS lo, max(ts) AS hi FROM ee GROUP BY run_id, host_id"
CTES["hw"] = """
SELECT s.run_id, s.host_id, coalesce(min(s.window_start), any_value(span.lo)) AS window_start,
       coalesce(max(s.window_end), any_value(span.hi)) AS window_end,
       arg_min(s.user_id, s.snap_rank) FILTER (WHERE s.user_id IS NOT NULL) AS user_id
FROM sn s JOIN span ON span.run_id = s.run_id AND span.host_id = s.host_id
GROUP BY s.run_id, s.host_id
"""
CTES["rule"] = """
SELECT * FROM (VALUES
  (1, 'bsod', 1, 85, 1, 1000, 100, 'Detected blue screen or unexpected shutdown events'),
  (2, 'disk_full', 1, 70, 1, 4, 95, 'Disk usage approaching capacity'),
  (3, 'service_crash_loop', 2, 65, 0, 5, 90, 'Repeated service crashes detected'),
  (4, 'network_instability', 1, 55, 0, 6, 85, 'Network instability detected'),
  (5, 'update_failure', 1, 65, 1, 4, 90, 'Repeated update or install failures')
) t(rule_no, type, min_n, base, free, max_steps, cap, summary)
"""
CTES["mt"] = """
SELECT dd.*, r.rule_no FROM dd JOIN rule r ON CASE r.rule_no
  WHEN 1 THEN list_has_any(tags, ['bsod', 'unexpected_shutdown'])
  WHEN 2 THEN list_contains(tags, 'disk_full') OR contains(lower(source), 'disk')
  WHEN 3 THEN list_contains(tags, 'service_crash') OR contains(lower(provider), 'service control manager')
  WHEN 4 THEN list_has_any(tags, ['network_reset', 'dns_failure'])
  ELSE list_contains(tags, 'update_failure') OR contains(lower(source), 'update') END
"""
CTES["mr"] = """
SELECT *, row_number() OVER (PARTITION BY run_id, host_id, rule_no ORDER BY ts, ts_raw, snap_rank, pos) AS evidence_rank,
       count(*) OVER (PARTITION BY run_id, host_id, rule_no) AS n,
       min(ts) OVER (PARTITION BY run_id, host_id, rule_no) AS evidence_start,
       max(ts) OVER (PARTITION BY run_id, host_id, rule_no) AS evidence_end
FROM mt
"""
CTES["ic"] = f"""
SELECT f.run_id, f.host_id, f.rule_no, r.type, r.summary, f.n AS event_count,
       CAST(least(r.cap, r.base + 5 * least(f.n - r.free, r.max_steps)) AS INT) AS severity,
       CASE f.rule_no WHEN 1 THEN CASE WHEN f.n > 1 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END
         WHEN 2 THEN least(0.95::DOUBLE, 0.7::DOUBLE + 0.05::DOUBLE * f.n::DOUBLE)
         WHEN 3 THEN least(0.95::DOUBLE, 0.7::DOUBLE + 0.05::DOUBLE * f.n::DOUBLE)
         WHEN 4 THEN least(0.9::DOUBLE, 0.6::DOUBLE + 0.05::DOUBLE * f.n::DOUBLE)
         ELSE least(0.9::DOUBLE, 0.65::DOUBLE + 0.05::DOUBLE * f.n::DOUBLE) END AS confidence,
       substr(sha256(f.provider || '|' || f.event_id || '|' || f.template), 1, 12) AS signature_hash,
       f.provider || ':' || f.event_id || '|' || substr(f.template, 1, 200) AS signature_key,
       f.evidence_start, f.evidence_end, hw.window_start, hw.window_end,
       f.host_id || '-incident-' || row_number() OVER (PARTITION BY f.run_id, f.host_id ORDER BY f.rule_no) AS incident_id
FROM (SELECT *, {TEMPLATE} AS template FROM mr WHERE evidence_rank = 1) f
JOIN rule r ON r.rule_no = f.rule_no AND f.n >= r.min_n
JOIN hw ON hw.run_id = f.run_id AND hw.host_id = f.host_id
"""
CTES["cl"] = """
SELECT run_id, signature_hash, arg_min(signature_key, (host_id, rule_no)) AS signature_key,
       arg_min(type, (host_id, rule_no)) AS type, count(DISTINCT host_id) AS affected_hosts,
       array_to_string(list_sort(list_distinct(list(host_id)))[1:20], '|') AS example_hosts,
       CAST(least(100, max(severity) + 5 * (count(DISTINCT host_id) - 1)) AS INT) AS severity,
       min(window_start) AS first_seen, max(window_end) AS last_seen,
       min(host_id) AS lead_host, min(rule_no) AS lead_rule
FROM ic GROUP BY run_id, signature_hash
"""
CTES["cs"] = """
SELECT c.*, c.affected_hosts - p.affected_hosts AS delta_affected_hosts,
       CASE WHEN p.run_id IS NULL THEN 'new' WHEN c.affected_hosts - p.affected_hosts >= 2 THEN 'spiking'
            ELSE 'ongoing' END AS status
FROM cl c JOIN prv ON prv.run_id = c.run_id
LEFT JOIN cl p ON p.run_id = prv.prev_run_id AND p.signature_hash = c.signature_hash
"""
CTES["hs"] = """
SELECT hw.run_id, hw.host_id, hw.user_id, CAST(coalesce(max(ic.severity), 0) AS INT) AS score,
       count(ic.incident_id) AS incidents,
       string_agg(ic.type || ' (sev ' || ic.severity || ')', '|' ORDER BY ic.rule_no) AS reasons,
       string_agg(ic.incident_id, '|' ORDER BY ic.rule_no) AS incident_refs
FROM hw LEFT JOIN ic ON ic.run_id = hw.run_id AND ic.host_id = hw.host_id
GROUP BY hw.run_id, hw.host_id, hw.user_id
"""
CTES["th"] = """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, incidents DESC, host_id) AS host_rank
FROM hs QUALIFY host_rank <= 10
"""
CTES["hd"] = """
SELECT t.*, p.score AS prev_score, t.score - p.score AS delta_score
FROM th t JOIN prv ON prv.run_id = t.run_id
LEFT JOIN th p ON p.run_id = prv.prev_run_id AND p.host_id = t.host_id
"""
CTES["fl"] = """
SELECT ic.run_id, ic.host_id, bool_or(cs.status = 'spiking') AS has_spiking, bool_or(cs.status = 'new') AS has_new
FROM ic JOIN cs ON cs.run_id = ic.run_id AND cs.signature_hash = ic.signature_hash
GROUP BY ic.run_id, ic.host_id
"""
CTES["ha_flag"] = """
SELECT hd.*, coalesce(fl.has_spiking, false) OR coalesce(fl.has_new, false)
         OR coalesce(contains(lower(hd.reasons), 'bsod'), false)
         OR (score >= 70 AND (prev_score IS NULL OR delta_score >= 5)) AS contact,
       score >= 50 OR coalesce(delta_score >= 10, false) AS monitor
FROM hd LEFT JOIN fl ON fl.run_id = hd.run_id AND fl.host_id = hd.host_id
"""
CTES["ha"] = """
SELECT *, CASE WHEN contact THEN 'contact' WHEN monitor THEN 'monitor' ELSE 'ignore' END AS action,
       CASE WHEN contact THEN 'High severity or cluster spike' WHEN monitor THEN 'Moderate severity or trending up'
            ELSE 'Low severity or stable' END AS action_reason
FROM ha_flag
"""
CTES["fs_base"] = """
SELECT rn.run_id, (SELECT min(window_start) FROM hw WHERE hw.run_id = rn.run_id) AS window_start,
       (SELECT max(window_end) FROM hw WHERE hw.run_id = rn.run_id) AS window_end,
       (SELECT count(*) FROM hw WHERE hw.run_id = rn.run_id) AS host_count,
       (SELECT count(*) FROM ic WHERE ic.run_id = rn.run_id) AS incident_count,
       (SELECT count(*) FROM cl WHERE cl.run_id = rn.run_id) AS cluster_count,
       (SELECT CAST(sum(score) AS DOUBLE) / count(*) FROM th WHERE th.run_id = rn.run_id AND host_rank <= 5) AS top_mean,
       (SELECT max(action) FROM ha WHERE ha.run_id = rn.run_id AND host_rank = 1) AS top_action,
       (SELECT array_to_string(list_sort(list_distinct(list(type)))[1:3], ', ') FROM ic WHERE ic.run_id = rn.run_id) AS types
FROM rn
"""
CTES["fs"] = """
SELECT *, CAST(least(100, floor(top_mean + 2 * cluster_count)) AS INT) AS overall_risk_score,
       CASE WHEN incident_count > 0 THEN host_count || ' host(s) affected; ' || incident_count || ' incident(s) ('
         || types || '); overall risk ' || CAST(least(100, floor(top_mean + 2 * cluster_count)) AS INT)
         || '; action: ' || top_action || '.' ELSE 'No incidents detected in the selected window.' END AS executive_summary
FROM fs_base
"""
CTES["ad_key"] = """
SELECT * REPLACE (CASE user_no % 17
    WHEN 1 THEN regexp_extract(key, '[^/]+$')
    WHEN 2 THEN run_id || '/snapshots/HO ST/' || regexp_extract(key, '[^/]+$')
    WHEN 3 THEN run_id || '/snapshots/' || host_id || '/HOST.json'
    ELSE key END AS key), user_no % 17 = 4 AS load_error
FROM sn
"""
CTES["ad"] = """
SELECT *, CASE WHEN NOT contains(key, '/') THEN 'invalid_path'
  WHEN NOT regexp_full_match(string_split(key, '/')[-2], '[A-Za-z0-9._:-]{3,64}') THEN 'host_pattern'
  WHEN NOT regexp_full_match(string_split(key, '/')[-1], 'snapshot-[0-9]{8}T[0-9]{6}Z\\.json') THEN 'filename_pattern'
  WHEN load_error THEN 'schema_fail: load_error'
  WHEN window_end < TIMESTAMP '2024-01-17 00:00:00' THEN 'window_out_of_range' END AS reject_reason
FROM ad_key
"""
CTES["sh_base"] = """
SELECT 'sheet-' || o_custkey AS sheet_id, o_custkey % 4 AS variant, o_orderkey, o_orderdate,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1
         + CASE WHEN o_custkey % 4 = 2 THEN 1 ELSE 2 END AS row_idx
FROM orders
"""
CTES["sr"] = """
SELECT sheet_id, 0 AS row_idx, ['Customer report', strftime(max(o_orderdate), '%Y-%m-%d'), '', ''] AS cells
FROM sh_base GROUP BY sheet_id
UNION ALL
SELECT DISTINCT sheet_id, 1, ['', 'Order Key', 'Total Price', 'Order Date'] FROM sh_base WHERE variant <> 2
UNION ALL
SELECT sheet_id, row_idx, CASE WHEN variant = 3 AND row_idx % 3 = 0 THEN cells[1:3] ELSE cells END FROM (
  SELECT sheet_id, variant, row_idx, [CASE WHEN variant = 1 THEN '' ELSE 'row' || row_idx END,
         CAST(o_orderkey AS VARCHAR), 'USD ' || price, strftime(o_orderdate, '%Y-%m-%d')] AS cells FROM sh_base)
"""
