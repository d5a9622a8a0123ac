"""DuckDB SQL equal to each registered query (same column names and
types), over the pre-registered test-table views."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_PART_PRICES = """
WITH sr AS (
  SELECT s_suppkey, r_name FROM supplier
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
pr AS (
  SELECT l_partkey, r_name,
         min(l_extendedprice) AS hn, max(l_extendedprice) AS hg,
         min(l_quantity) AS mn, max(l_quantity) AS mg
  FROM lineitem JOIN sr ON l_suppkey = s_suppkey
  GROUP BY l_partkey, r_name)
"""

ORACLE["catalog_by_location"] = _PART_PRICES + """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
       hn AS price_hourly_net, hg AS price_hourly_gross,
       mn AS price_monthly_net, mg AS price_monthly_gross,
       false AS deprecated
FROM part JOIN pr ON p_partkey = l_partkey
WHERE r_name = 'AFRICA'
ORDER BY p_type, p_size, p_partkey
"""

ORACLE["catalog_all_locations"] = _PART_PRICES + """
, dc AS (SELECT r_name || '-dc' || CAST(r_regionkey AS VARCHAR) AS datacenter, r_name AS loc FROM region)
SELECT datacenter, p_partkey, p_type, p_size,
       hn AS price_hourly_net, hg AS price_hourly_gross,
       mn AS price_monthly_net, mg AS price_monthly_gross
FROM part JOIN pr ON p_partkey = l_partkey JOIN dc ON pr.r_name = dc.loc
"""

ORACLE["datacenter_flatten"] = """
SELECT s_name AS name,
       n_name || ' city' AS city,
       n_name AS country,
       'datacenter of supplier ' || CAST(s_suppkey AS VARCHAR) AS description,
       CAST(n_nationkey AS DOUBLE) AS latitude,
       CAST(n_regionkey AS DOUBLE) AS longitude,
       lower(r_name) AS network_zone,
       n_name AS location_name,
       r_name AS location_description
FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""

ORACLE["null_default"] = """
SELECT d.doc_id, d.lang, l.quality, coalesce(l.toxic, 0) AS toxic,
       l.toxic IS NULL AS toxic_defaulted
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

ORACLE["override_merge"] = """
WITH o AS (
  SELECT n_nationkey AS k,
         CASE WHEN n_regionkey <> 0 THEN r_name END AS seg,
         CASE WHEN n_regionkey = 3 THEN CAST(0 AS DOUBLE) END AS acct,
         CASE WHEN n_regionkey = 1 THEN false WHEN n_regionkey = 2 THEN true END AS act
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, c_name, c_nationkey,
       coalesce(o.acct, c_acctbal) AS c_acctbal,
       coalesce(o.seg, c_mktsegment) AS c_mktsegment,
       coalesce(o.act, c_acctbal > 0) AS active
FROM customer LEFT JOIN o ON c_nationkey = o.k
"""

ORACLE["access_report"] = """
WITH w AS (
  SELECT n_name AS cluster, s_name AS node,
         '10.' || CAST(s_nationkey AS VARCHAR) || '.' || CAST(s_suppkey // 250 AS VARCHAR)
           || '.' || CAST(s_suppkey % 250 + 1 AS VARCHAR) AS ip
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s AS (
  SELECT n_name AS cluster, n_name || '-node-scheduler' AS node,
         '10.' || CAST(n_nationkey AS VARCHAR) || '.255.254' AS ip,
         9756 + n_nationkey AS port
  FROM nation),
r AS (
  SELECT w.cluster, 'worker' AS role, 0 AS role_rank, w.node, w.ip, s.ip AS scheduler_ip, s.port
  FROM w JOIN s ON w.cluster = s.cluster
  UNION ALL
  SELECT cluster, 'scheduler', 1, node, ip, ip, port FROM s)
SELECT *, 'http://' || ip || ':' || CAST(port AS VARCHAR) || '/' AS url FROM r
"""

ORACLE["worker_filter"] = """
SELECT c_custkey, c_name, c_nationkey FROM customer
WHERE starts_with(c_name, 'Customer#0000001') AND contains(c_name, '5')
"""

ORACLE["delete_plan"] = """
WITH inv AS (
  SELECT 'customer' AS kind, c_name AS name FROM customer
  UNION ALL SELECT 'supplier', s_name FROM supplier
  UNION ALL SELECT 'part', p_brand FROM part
  UNION ALL SELECT 'nation', n_name FROM nation)
SELECT kind, name,
       CASE WHEN starts_with(name, 'Brand#1') OR starts_with(name, 'Customer#00000000')
            THEN 'delete' ELSE 'keep' END AS action
FROM inv
"""

ORACLE["config_validation"] = """
WITH f AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN NOT coalesce(l_quantity >= 2, false) THEN 'quantity_min' END AS f1,
         CASE WHEN NOT coalesce(l_orderkey <> l_partkey AND l_orderkey <> l_suppkey
                                AND l_partkey <> l_suppkey, false) THEN 'keys_distinct' END AS f2,
         CASE WHEN NOT coalesce(l_extendedprice > 0, false) THEN 'price_positive' END AS f3
  FROM lineitem)
SELECT l_orderkey, l_linenumber,
       concat_ws(',', f1, f2, f3) AS failures,
       coalesce(f1, f2, f3) AS first_failure,
       CAST((f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT + (f3 IS NOT NULL)::INT AS BIGINT) AS n_failures,
       f1 IS NULL AND f2 IS NULL AND f3 IS NULL AS valid
FROM f
"""

ORACLE["admit_new"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""

ORACLE["reject_existing"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
"""

_BUILDING = "(SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING')"

ORACLE["name_lookup"] = f"""
SELECT e.event_id, e.user_id, c.c_name, c.c_custkey IS NOT NULL AS resolved
FROM events e LEFT JOIN {_BUILDING} c ON e.user_id = c.c_custkey
"""

ORACLE["unknown_names"] = f"""
SELECT user_id, count(*) AS n_requests FROM events
WHERE user_id NOT IN (SELECT c_custkey FROM {_BUILDING})
GROUP BY user_id
"""

ORACLE["prefix_collisions"] = """
WITH b AS (SELECT DISTINCT regexp_replace(c_name, '#0+', '#') AS name FROM customer WHERE c_name IS NOT NULL),
p AS (SELECT name, unnest(range(1, length(name))) AS n FROM b)
SELECT b.name AS prefix, p.name FROM p JOIN b ON substr(p.name, 1, p.n) = b.name
"""

ORACLE["component_status"] = """
WITH g AS (
  SELECT conv_id,
         coalesce(bool_or(role = 'system'), false) AS has_system,
         coalesce(bool_or(role = 'user'), false) AS has_user,
         coalesce(bool_or(role = 'assistant'), false) AS has_assistant
  FROM conversations GROUP BY conv_id)
SELECT *, CASE WHEN NOT has_system THEN 'system_missing'
               WHEN NOT has_user THEN 'user_missing'
               WHEN NOT has_assistant THEN 'assistant_missing'
               ELSE 'complete' END AS status
FROM g
"""

ORACLE["worker_count"] = """
SELECT n_nationkey, n_name, count(s_nationkey) AS n_suppliers
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
GROUP BY n_nationkey, n_name
"""

_STAGES = """
WITH st AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN role = 'system' THEN NULL
              WHEN role = 'assistant' AND length(text) > 1000 THEN 1 ELSE 0 END AS code
  FROM conversations)
"""

ORACLE["stage_outcome"] = _STAGES + """
SELECT conv_id, count(*) AS n_stages,
       coalesce(bool_or(code <> 0), false) AS failed,
       coalesce(bool_or(code IS NULL), false) AS running,
       min(CASE WHEN code <> 0 THEN turn END) AS first_failed_stage,
       max(turn) AS last_stage
FROM st GROUP BY conv_id
"""

ORACLE["stage_render"] = _STAGES + """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role AS token, code,
       text AS out, CASE WHEN code <> 0 THEN text END AS err, count(*) OVER (PARTITION BY conv_id) AS n_stages
FROM st
"""

ORACLE["copy_plan"] = """
WITH s AS (
  SELECT l_orderkey AS k,
         count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN 'supp-' || CAST(l_suppkey AS VARCHAR) END) AS n,
         min(CASE WHEN l_returnflag <> 'N' THEN 'supp-' || CAST(l_suppkey AS VARCHAR) END) AS one
  FROM lineitem GROUP BY l_orderkey),
t AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'cust-' || CAST(o_custkey AS VARCHAR) END AS target_host
  FROM orders),
v AS (
  SELECT o_orderkey, target_host, coalesce(n, 0) AS n_source_hosts, one,
         CASE WHEN n > 1 THEN 'multiple_sources'
              WHEN target_host IS NULL AND coalesce(n, 0) = 0 THEN 'no_host'
              WHEN target_host IS NOT NULL AND n = 1 THEN 'host_to_host'
              ELSE 'ok' END AS verdict
  FROM t LEFT JOIN s ON o_orderkey = s.k)
SELECT o_orderkey, target_host, n_source_hosts, verdict,
       CASE WHEN verdict = 'ok' THEN coalesce(target_host, one) END AS host
FROM v
"""

ORACLE["last_wins"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
  FROM lineitem) WHERE rn = 1
"""

ORACLE["capacity_rollup"] = """
SELECT o_custkey, count(*) AS n_nodes,
       CAST(sum(p_size) AS BIGINT) AS total_cores,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_quantity
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_custkey
"""

ORACLE["catalog_rank"] = """
SELECT p_partkey, p_type, p_size,
       row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS rank
FROM part
"""

ORACLE["delimiter_runs"] = """
WITH e AS (
  SELECT user_id, ts, event_id, event_type,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id
  FROM events),
r AS (
  SELECT user_id, run_id, count(*) AS n_items,
         arg_min(event_id, ts) AS first_event_id, arg_max(event_id, ts) AS last_event_id,
         min(ts) AS first_ts, max(ts) AS last_ts
  FROM e WHERE event_type <> 'error' GROUP BY user_id, run_id)
SELECT user_id, n_items, first_event_id, last_event_id, first_ts, last_ts,
       row_number() OVER (PARTITION BY user_id ORDER BY run_id) - 1 AS run_no
FROM r
"""

ORACLE["concat_ordered"] = """
WITH u AS (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
n AS (SELECT conv_id, count(*) AS n FROM u GROUP BY conv_id),
a AS (
  SELECT c.conv_id, c.turn, c.role,
         row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 + coalesce(n.n, 0) AS pos
  FROM conversations c LEFT JOIN n ON c.conv_id = n.conv_id WHERE c.role = 'assistant')
SELECT conv_id, turn, role, pos FROM u UNION ALL SELECT conv_id, turn, role, pos FROM a
"""

ORACLE["node_expand"] = """
WITH w AS (SELECT s_name, unnest(range(s_nationkey)) AS i FROM supplier)
SELECT s_name AS prefix, 'worker' AS role, CAST(i AS INTEGER) AS node_index,
       s_name || '-node-worker' || lpad(CAST(i AS VARCHAR), 3, '0') AS node,
       '10.0.1.' || CAST(100 + i AS VARCHAR) AS ip,
       (100 + i <= 255 AND 100 + i <> 200) AS ip_ok
FROM w
UNION ALL
SELECT s_name, 'scheduler', CAST(NULL AS INTEGER), s_name || '-node-scheduler', '10.0.1.200', true
FROM supplier
"""

ORACLE["rule_expand"] = """
WITH r AS (
  SELECT s_name, 0 AS rule_no, 'tcp' AS protocol, '22' AS port FROM supplier
  UNION ALL SELECT s_name, 1, 'icmp', CAST(NULL AS VARCHAR) FROM supplier
  UNION ALL SELECT s_name, 2, 'tcp', CAST(9753 + s_nationkey * 10 AS VARCHAR) FROM supplier
  UNION ALL SELECT s_name, 3, 'tcp', CAST(9756 + s_nationkey * 10 AS VARCHAR) FROM supplier
  UNION ALL SELECT s_name, 4, 'tcp', CAST(9759 + s_nationkey * 10 AS VARCHAR) FROM supplier),
src AS (SELECT * FROM (VALUES ('0.0.0.0/0'), ('::/0')) v(source_ip))
SELECT s_name AS prefix, CAST(rule_no AS INTEGER) AS rule_no, 'in' AS direction, protocol, port, source_ip
FROM r, src
"""

ORACLE["first_success"] = """
WITH f AS (
  SELECT user_id AS k,
         min(ts) FILTER (WHERE event_type = 'purchase') AS s_ts,
         arg_min(event_id, ts) FILTER (WHERE event_type = 'purchase') AS s_id
  FROM events GROUP BY user_id),
g AS (
  SELECT e.user_id, min(e.ts) AS first_ts, any_value(f.s_ts) AS success_ts,
         any_value(f.s_id) AS success_event_id,
         count(*) FILTER (WHERE f.s_ts IS NULL OR e.ts < f.s_ts
                                OR (e.ts = f.s_ts AND e.event_id < f.s_id)) AS attempts_before
  FROM events e JOIN f ON e.user_id = f.k GROUP BY e.user_id)
SELECT *, epoch_us(success_ts) - epoch_us(first_ts) AS wait_us FROM g
"""

ORACLE["run_timeout"] = """
WITH s AS (
  SELECT user_id, min(ts) AS start_ts, arg_min(event_id, ts) AS start_id
  FROM events WHERE event_type = 'signup' GROUP BY user_id),
e AS (
  SELECT ev.user_id, min(ev.ts) AS end_ts
  FROM events ev JOIN s ON ev.user_id = s.user_id
  WHERE ev.event_type = 'purchase'
    AND (ev.ts > s.start_ts OR (ev.ts = s.start_ts AND ev.event_id > s.start_id))
  GROUP BY ev.user_id),
m AS (SELECT max(ts) AS asof FROM events)
SELECT s.user_id, s.start_ts, e.end_ts,
       CASE WHEN e.end_ts IS NOT NULL AND epoch_us(e.end_ts) - epoch_us(s.start_ts) <= 86400000000
              THEN 'finished'
            WHEN e.end_ts IS NOT NULL OR epoch_us(m.asof) - epoch_us(s.start_ts) >= 86400000000
              THEN 'timed_out'
            ELSE 'running' END AS status
FROM s LEFT JOIN e ON s.user_id = e.user_id, m
"""

ORACLE["latest_state"] = """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
"""

ORACLE["phase_durations"] = """
SELECT *, epoch_us(next_ts) - epoch_us(ts) AS duration_us FROM (
  SELECT user_id, event_id, event_type, ts,
         lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts
  FROM events)
WHERE next_ts IS NOT NULL
"""

ORACLE["barrier_violations"] = """
SELECT o_orderkey, o_orderdate, min(l_shipdate) AS first_child_ts, count(*) AS n_children
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_orderdate
HAVING min(l_shipdate) <= o_orderdate
"""

ORACLE["validity_status"] = """
SELECT o_orderkey, o_orderdate - INTERVAL 1 DAY AS not_before,
       o_orderdate + INTERVAL 730 DAY AS not_after,
       CASE WHEN TIMESTAMP '1998-01-01 00:00:00' < o_orderdate - INTERVAL 1 DAY THEN 'not_yet'
            WHEN TIMESTAMP '1998-01-01 00:00:00' > o_orderdate + INTERVAL 730 DAY THEN 'expired'
            ELSE 'valid' END AS status
FROM orders
"""

ORACLE["suffix_split"] = """
SELECT c_custkey, c_name, CASE WHEN strpos(c_name, '#') > 0 THEN split_part(c_name, '#', 2) END AS suffix
FROM customer
"""

ORACLE["label_cast"] = """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
"""

ORACLE["path_parse"] = """
WITH u AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, ':', '')
                       WHEN page_id % 5 = 0 THEN url || ':8080' ELSE url END AS named FROM pages),
p AS (
  SELECT page_id, replace(replace(replace(named, '/', '\\'), '\\\\', '/'), '\\', '/') AS path FROM u),
k AS (
  SELECT *, CASE len(string_split(path, ':')) WHEN 1 THEN 'local' WHEN 2 THEN 'remote'
                 ELSE 'invalid' END AS kind FROM p)
SELECT page_id, path, kind,
       CASE WHEN kind = 'remote' THEN split_part(path, ':', 1) END AS host,
       CASE WHEN kind = 'local' THEN path WHEN kind = 'remote' THEN split_part(path, ':', 2) END AS rest
FROM k
"""

ORACLE["decode_safe"] = """
WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN encode(text) || from_hex('FF')
                               WHEN lang <> 'es' THEN encode(text) END AS b FROM documents)
SELECT doc_id, octet_length(b) AS n_bytes,
       CASE WHEN b IS NULL THEN ''
            WHEN try(decode(b)) IS NOT NULL THEN decode(b)
            ELSE '0x' || hex(b) END AS text
FROM d
"""

_EVENT_LOG = """
WITH l AS (
  SELECT 'user' || CAST(user_id AS VARCHAR) AS logger,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING'
                         WHEN 'signup' THEN 'INFO' WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'DEBUG' END AS level,
         strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS asctime,
         'event ' || CAST(event_id AS VARCHAR) || ' ' || event_type AS message,
         date_trunc('millisecond', ts) AS ts
  FROM events),
p AS (
  SELECT logger, level, asctime, message, ts,
         CASE level WHEN 'CRITICAL' THEN 50 WHEN 'ERROR' THEN 40 WHEN 'WARNING' THEN 30
                    WHEN 'INFO' THEN 20 WHEN 'DEBUG' THEN 10 WHEN 'NOTSET' THEN 0 END AS levelno
  FROM l)
"""

ORACLE["log_roundtrip"] = _EVENT_LOG + "SELECT * FROM p"

ORACLE["log_level_filter"] = _EVENT_LOG + "SELECT * FROM p WHERE levelno >= 30"

ORACLE["first_success_stream"] = ORACLE["first_success"]
ORACLE["latest_state_stream"] = ORACLE["latest_state"]

ORACLE["run_timeout_stream"] = ORACLE["run_timeout"].replace(
    "SELECT max(ts) AS asof FROM events", "SELECT date_trunc('millisecond', max(ts)) AS asof FROM events")

ORACLE["cluster_status"] = """
WITH sn AS (SELECT s_suppkey, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
servers AS (
  SELECT n_name || '-node-worker' || CAST(s_suppkey AS VARCHAR) AS name FROM sn
  UNION ALL
  SELECT DISTINCT n_name || '-node-scheduler' FROM sn WHERE s_acctbal > 5000),
fw AS (SELECT n_name || '-firewall' AS name FROM nation WHERE n_regionkey <> 1),
nw AS (SELECT n_name || '-network' AS name FROM nation WHERE n_regionkey <> 2),
f AS (
  SELECT n_name AS prefix,
         EXISTS (SELECT 1 FROM servers s WHERE s.name = n_name || '-node-scheduler') AS has_scheduler,
         (SELECT count(*) FROM servers s
           WHERE starts_with(s.name, n_name) AND contains(s.name, '-node-worker')) AS n_workers,
         EXISTS (SELECT 1 FROM fw WHERE fw.name = n_name || '-firewall') AS has_firewall,
         EXISTS (SELECT 1 FROM nw WHERE nw.name = n_name || '-network') AS has_network
  FROM nation)
SELECT prefix, has_scheduler, n_workers > 0 AS has_worker, has_firewall, has_network,
       CASE WHEN NOT has_scheduler THEN 'scheduler_missing'
            WHEN n_workers = 0 THEN 'worker_missing'
            WHEN NOT has_firewall THEN 'firewall_missing'
            WHEN NOT has_network THEN 'network_missing'
            ELSE 'complete' END AS status,
       n_workers
FROM f
"""

ORACLE["first_success_final"] = ("SELECT * FROM (" + ORACLE["first_success"] + ") "
                                 "WHERE success_ts < (SELECT date_trunc('millisecond', max(ts)) FROM events)")

def _validated(table: str, key: str, rules: dict[str, str]) -> str:
    """SQL that lists the failed rules of each row, in order."""
    listed = ", ".join(f"CASE WHEN coalesce({test}, false) THEN NULL ELSE '{name}' END" for name, test in rules.items())
    return (f"SELECT {key}, array_to_string(failures, ',') AS failures, failures[1] AS first_failure, len(failures) AS n_failures, "
            f"len(failures) = 0 AS valid FROM (SELECT {key}, list_filter([{listed}], lambda x: x IS NOT NULL) AS failures FROM ({table}))")


ORACLE["cluster_validation"] = _validated(
    """SELECT s_suppkey, s_nationkey AS workers, CASE WHEN s_suppkey % 7 = 0 THEN 80 ELSE 9753 END AS ipc,
       CASE WHEN s_suppkey % 5 = 0 THEN 9753 ELSE 9756 END AS dash, 9759 AS nanny,
       CASE WHEN s_suppkey % 11 = 0 THEN 0.0 ELSE 0.5 END AS wait FROM supplier""", "s_suppkey",
    {"workers_positive": "workers > 0", "ipc_port_unprivileged": "ipc >= 1024", "dash_port_unprivileged": "dash >= 1024",
     "nanny_port_unprivileged": "nanny >= 1024", "ports_distinct": "ipc <> dash AND ipc <> nanny AND dash <> nanny",
     "wait_positive": "wait > 0"})

ORACLE["access_validation"] = _validated(
    """SELECT c_custkey, c_name AS name, lower(c_mktsegment) AS usr,
       CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '/keys/' || c_custkey END AS fn_private, c_nationkey AS port,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'aes128' END AS cipher, c_custkey % 13 AS valid_days FROM customer""",
    "c_custkey",
    {"name_set": "name <> ''", "user_set": "usr <> ''", "key_set": "fn_private <> ''", "port_positive": "port > 0",
     "cipher_set": "cipher <> ''", "valid_days_positive": "valid_days > 0"})

ORACLE["label_strict"] = "SELECT c_custkey, CAST(split_part(c_name, '#', 2) AS INTEGER) AS n FROM customer"

_SERVERS = """
WITH w AS (
  SELECT DISTINCT 'CL' || s_nationkey || '-node-worker' || (s_suppkey // 25) AS name FROM supplier
  UNION ALL SELECT 'CL' || n_nationkey || '-node-scheduler' FROM nation)
"""

ORACLE["host_index"] = _SERVERS + """
SELECT split_part(name, '-node-', 2) AS host, max(name) AS name
FROM w WHERE starts_with(name, 'CL1') AND contains(name, '-node-worker') GROUP BY 1
UNION ALL SELECT 'scheduler', name FROM w WHERE name = 'CL1-node-scheduler'
"""

ORACLE["resource_kind"] = _SERVERS + """
, n AS (
  SELECT name FROM w
  UNION ALL SELECT 'CL' || n_nationkey || x FROM nation, (VALUES ('-firewall'), ('-network')) v(x)
  UNION ALL SELECT c_name FROM customer)
SELECT name, split_part(component, '|', 1) AS prefix, split_part(component, '|', 2) AS component FROM (
  SELECT name, CASE WHEN contains(name, '-node-scheduler') THEN replace(name, '-node-scheduler', '') || '|scheduler'
                    WHEN contains(name, '-node-worker') THEN split_part(name, '-node-worker', 1) || '|worker'
                    WHEN contains(name, '-firewall') THEN replace(name, '-firewall', '') || '|firewall'
                    WHEN contains(name, '-network') THEN replace(name, '-network', '') || '|network' END AS component
  FROM n)
"""

ORACLE["provisioning_phases"] = """
WITH l AS (
  SELECT 'cluster' || (user_id % 5) AS cluster, 'worker' || (user_id % 3) AS node,
         event_type || ' ' || event_id AS phase, date_trunc('millisecond', ts) AS ts
  FROM events WHERE user_id % 4 <> 0),
n AS (
  SELECT *, lead(ts) OVER w AS next_ts, lead(phase) OVER w AS next_phase
  FROM l WINDOW w AS (PARTITION BY cluster, node ORDER BY ts, phase))
SELECT *, epoch_us(next_ts) - epoch_us(ts) AS duration_us FROM n
"""

ORACLE["log_level_stream"] = ORACLE["log_level_filter"]

ORACLE["stage_text"] = """
SELECT conv_id, coalesce(string_agg(role, ' | ' ORDER BY turn), '') AS rendered, count(*) AS n_stages
FROM conversations GROUP BY conv_id
"""

ORACLE["run_timer_stream"] = """
WITH e AS (
  SELECT user_id, ts, event_type = 'signup' AS s,
    ts + CASE WHEN event_type = 'signup' THEN INTERVAL 24 HOUR ELSE INTERVAL 1 MICROSECOND END AS fin
  FROM events WHERE event_type IN ('signup', 'purchase')),
o AS (SELECT *, max(fin) OVER (PARTITION BY user_id ORDER BY ts, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM e),
g AS (SELECT *, sum((until IS NULL OR ts > until)::INT) OVER (PARTITION BY user_id ORDER BY ts, fin ROWS UNBOUNDED PRECEDING) AS run FROM o),
r AS (SELECT user_id, min(ts) FILTER (s) AS start_ts, min(ts) FILTER (NOT s) AS end_ts, max(fin) AS closed_ts FROM g GROUP BY user_id, run)
SELECT user_id, start_ts, end_ts,
  CASE WHEN end_ts <= start_ts + INTERVAL 24 HOUR THEN 'finished' ELSE 'timed_out' END AS status, closed_ts
FROM r WHERE start_ts IS NOT NULL AND closed_ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events)
"""

ORACLE["latest_closed_stream"] = """
SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS event_type,
  max_by(value, (ts, event_id)) AS value
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM events)
GROUP BY user_id
"""

_GUARD = """
SELECT event_id, user_id AS key FROM events
WHERE user_id {} (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
"""
ORACLE["admit_sketched"] = _GUARD.format("NOT IN")
ORACLE["reject_sketched"] = _GUARD.format("IN")

ORACLE["point_lookup_stream"] = "SELECT c_name, c_custkey, c_nationkey FROM customer WHERE c_name = 'Customer#000000042'"
