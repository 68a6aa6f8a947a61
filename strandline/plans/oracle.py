"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

DAY = 86_400 * 10**9
JAN = 1_704_067_200 * 10**9
T10, T11, T15 = JAN + 9 * DAY, JAN + 10 * DAY, JAN + 14 * DAY
S = 1 << 40

OBS = """obs AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'state' END AS kind, user_id AS id, event_type AS status,
  CAST(floor(value / 50) AS BIGINT) AS bucket, epoch_us(ts) * 1000 AS event_time_ns,
  (epoch_us(ts) + CASE WHEN event_id % 10 = 0 THEN (event_id % 7) * 3600000000 ELSE 0 END) * 1000 AS recorded_at_ns,
  'p' || (k % 3) AS producer, 'm' || (k % 4) AS scope FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
LOG = OBS + """, log AS (SELECT * FROM (SELECT *, CASE WHEN kind = 'delete' THEN CASE WHEN was THEN 'entity.deleted' END WHEN NOT was THEN 'entity.created'
    WHEN status <> p_status THEN 'entity.state_changed' WHEN bucket <> p_bucket THEN 'entity.attribute_updated' ELSE 'entity.unchanged' END AS change_type,
  CASE WHEN kind = 'state' AND was THEN concat_ws(',', CASE WHEN bucket <> p_bucket THEN 'bucket' END, CASE WHEN status <> p_status THEN 'status' END) ELSE '' END AS keys
  FROM (SELECT *, coalesce(lag(kind) OVER w = 'state', false) AS was, lag(status) OVER w AS p_status, lag(bucket) OVER w AS p_bucket FROM obs
    WINDOW w AS (PARTITION BY id ORDER BY recorded_at_ns, seq))) WHERE change_type IS NOT NULL)"""


def _state(order: str, where: str = "true") -> str:
    return f"""SELECT id, status, bucket FROM (SELECT id, arg_max(change_type, ({order})) AS last, arg_max(status, ({order})) FILTER (change_type <> 'entity.unchanged') AS status,
      arg_max(bucket, ({order})) FILTER (change_type <> 'entity.unchanged') AS bucket FROM log WHERE {where} GROUP BY id) WHERE last <> 'entity.deleted'"""


def _node(kind: int, key: str) -> str:
    return f"(CAST({key} AS BIGINT) + {kind * S})"


RELS = f"""rels AS (
  SELECT 'attached_to' AS type, {_node(1, 'n_nationkey')} AS f, {_node(0, 'n_regionkey')} AS t, 'host' AS ft, 'network.segment' AS tt FROM nation
  UNION ALL SELECT 'runs_on', {_node(2, 's_suppkey')}, {_node(1, 's_nationkey')}, 'network.device', 'host' FROM supplier
  UNION ALL SELECT 'runs_on', {_node(3, 'c_custkey')}, {_node(1, 'c_nationkey')}, 'service.instance', 'host' FROM customer
  UNION ALL SELECT DISTINCT 'depends_on', {_node(4, 'l_partkey')}, {_node(2, 'l_suppkey')}, 'db', 'network.device' FROM lineitem
  UNION ALL SELECT 'runs_on', {_node(5, 'o_orderkey')}, {_node(3, 'o_custkey')}, 'process', 'service.instance' FROM orders
  UNION ALL SELECT DISTINCT 'depends_on', {_node(5, 'l_orderkey')}, {_node(4, 'l_partkey')}, 'process', 'db' FROM lineitem)"""
BOTH = RELS + ", both_ways AS (SELECT f AS src, t AS dst, type FROM rels UNION ALL SELECT t, f, type FROM rels WHERE f <> t)"


def _reach(edges: str, roots: str, depth: int) -> str:
    return f"""walk AS (SELECT id AS root, id AS node, 0 AS depth, CAST(NULL AS VARCHAR) AS via FROM ({roots})
      UNION SELECT root, dst, depth + 1, type FROM walk JOIN {edges} ON node = src WHERE depth < {depth}),
    first AS (SELECT root, node, depth, min(via) AS via FROM walk JOIN (SELECT root, node, min(depth) AS depth FROM walk GROUP BY ALL) USING (root, node, depth) GROUP BY ALL)"""


def _fp(kind: str, *pairs: tuple[str, str]) -> str:
    text = " || ".join([f"'{kind}' || chr(31)"] + [f"'{k}' || chr(30) || {v} || chr(31)" for k, v in pairs])
    return f"'{kind}:' || substr(sha256({text}), 1, 32)"


def _diff(log: str, ident: str, start: int, end: int, begins: str, ends: str, more: str) -> str:
    key = "(event_time_ns, seq)"
    return f"""SELECT {ident} AS id, CASE WHEN began AND NOT gone THEN 'created' WHEN began THEN 'transient' WHEN gone THEN 'deleted' WHEN keys <> '' THEN 'changed' END AS outcome, keys{more}
      FROM (SELECT {ident}, arg_min(change_type = '{begins}', {key}) AS began, coalesce(arg_max(change_type = '{ends}', {key}) FILTER (change_type IN ('{begins}', '{ends}')), false) AS gone,
        array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN keys = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(keys, ',') END)))), ',') AS keys,
        bool_or(change_type = 'entity.state_changed') AS state FROM {log} WHERE event_time_ns >= {start} AND event_time_ns < {end} AND change_type <> 'entity.unchanged' GROUP BY {ident}) WHERE outcome IS NOT NULL"""


def _digest(end: int, where: str, group: bool) -> str:
    shape = "change_type, type, keys, scope, delete_source"
    gid = f", substr(sha256(concat_ws('|', {shape}, '{T10}', '{end}')), 1, 16) AS group_id" if group else ""
    return f"""SELECT {shape}, count(*) AS n, min(event_time_ns) AS first_ns, max(event_time_ns) AS last_ns, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5) AS examples{gid}
      FROM (SELECT *, row_number() OVER (PARTITION BY {shape} ORDER BY event_time_ns DESC, seq DESC) AS k FROM (SELECT *, 'host' AS type, CASE WHEN change_type = 'entity.deleted' THEN 'producer' ELSE '' END AS delete_source FROM log)
        WHERE event_time_ns BETWEEN {T10} AND {end} AND change_type <> 'entity.unchanged' AND {where}) GROUP BY {shape}"""


BELIEFS = f"""beliefs AS (SELECT * FROM (SELECT lag(c_custkey) OVER w AS f, c_custkey AS t, 1 - (c_acctbal - lag(c_acctbal) OVER w) / 10000 AS confidence, lag(c_name) OVER w AS f_name, c_name AS t_name
  FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey)) WHERE f IS NOT NULL)"""
FOREVER = (1 << 62) - 1
LIVES = OBS + f""", said AS (SELECT id, producer || '/' || scope AS speaker, recorded_at_ns AS said_at, seq, kind FROM obs),
  nexts AS (SELECT *, lead(said_at) OVER w AS nt, lead(seq) OVER w AS nq FROM said WINDOW w AS (PARTITION BY id, speaker ORDER BY said_at, seq)),
  holds AS (SELECT id, {{'t': said_at, 'q': seq}} AS s, CASE WHEN nt IS NOT NULL AND nt <= said_at + {DAY} THEN {{'t': nt, 'q': nq}} ELSE {{'t': said_at + {DAY}, 'q': {FOREVER}}} END AS e, NOT coalesce(nt <= said_at + {DAY}, false) AS lapsed FROM nexts WHERE kind = 'state'),
  reached AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM holds),
  islands AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS life FROM reached),
  ends AS (SELECT id, life, min(s).t AS start_ns, max(e).t AS end_ns, CASE WHEN arg_max(lapsed, e) THEN 'liveness_expiry' ELSE 'producer' END AS ended_by FROM islands GROUP BY id, life)"""
ARRIVED = "recorded_at_ns, seq"
TELEMETRY = f"""SELECT {_node(5, 'o_orderkey')} AS id, 'process.pid' AS key, CAST(o_orderkey AS VARCHAR) AS value, 'identity' AS source FROM orders
  UNION ALL SELECT {_node(5, 'o_orderkey')}, 'service.instance.id', c_name, 'owner identity' FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT {_node(5, 'o_orderkey')}, 'service.name', c_name, 'owner attributes' FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT {_node(3, 'c_custkey')}, 'service.instance.id', c_name, 'identity' FROM customer
  UNION ALL SELECT {_node(3, 'c_custkey')}, 'service.name', c_name, 'attributes' FROM customer"""
ELOG = """seen AS (SELECT o_custkey || '>' || CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS edge, o_orderstatus AS status, epoch_us(o_orderdate) * 1000 AS event_time_ns, o_orderkey AS seq FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) OR o_custkey BETWEEN 1 AND 5),
      elog AS (SELECT * FROM (SELECT *, CASE WHEN p IS NULL THEN 'relation.added' WHEN p <> status THEN 'relation.attribute_changed' END AS change_type, CASE WHEN p <> status THEN 'status' ELSE '' END AS keys FROM (SELECT *, lag(status) OVER (PARTITION BY edge ORDER BY event_time_ns, seq) AS p FROM seen)) WHERE change_type IS NOT NULL)"""
_YEAR = 852_076_800 * 10**9

ORACLE_SQL = {
    "q01_type_counts": f"""WITH {RELS} SELECT 'entity' AS kind, type, n FROM (SELECT 'network.segment' AS type, count(*) AS n FROM region UNION ALL SELECT 'host', count(*) FROM nation UNION ALL SELECT 'network.device', count(*) FROM supplier
      UNION ALL SELECT 'service.instance', count(*) FROM customer UNION ALL SELECT 'db', count(*) FROM part UNION ALL SELECT 'process', count(*) FROM orders) UNION ALL SELECT 'relation', type, count(*) FROM rels GROUP BY type""",
    "q02_find_match": f"SELECT {_node(1, 'n_nationkey')} AS id, {_fp('host', ('host.id', chr(39) + 'i:' + chr(39) + ' || n_nationkey'))} AS fingerprint, n_name AS name FROM nation WHERE n_nationkey % 5 = 0",
    "q03_fingerprint": f"""SELECT {_node(3, 'c_custkey')} AS id, 'service.instance' AS type, {_fp('service.instance', ('service.instance.id', "'s:' || c_name"))} AS fingerprint FROM customer
      UNION ALL SELECT {_node(5, 'o_orderkey')}, 'process', {_fp('process', ('process.creation.time', "'s:' || strftime(o_orderdate, '%Y-%m-%d')"), ('process.pid', "'i:' || o_orderkey"))} FROM orders""",
    "q04_relation_ids": f"WITH {RELS} SELECT type || ':' || substr(sha256(type || chr(31) || f || chr(31) || t), 1, 32) AS relation_id, type, f AS from_id, t AS to_id, true AS structural FROM rels",
    "q05_classify": f"WITH {LOG} SELECT seq, id, change_type, keys FROM log",
    "q06_recent_changes": f"WITH {LOG} SELECT seq, id, change_type, keys, event_time_ns FROM log WHERE event_time_ns BETWEEN {T10} AND {T10 + DAY // 2} AND change_type <> 'entity.unchanged'",
    "q07_entity_history_known": f"WITH {LOG} SELECT seq, id, change_type, event_time_ns, recorded_at_ns FROM log WHERE id BETWEEN 1 AND 5 AND event_time_ns >= {T10} AND recorded_at_ns <= {T15}",
    "q08_state_live": f"WITH {LOG} " + _state(ARRIVED),
    "q09_state_as_of": f"WITH {LOG} " + _state("event_time_ns, " + ARRIVED, f"event_time_ns <= {T15}"),
    "q10_as_of_vs_live_delta": f"WITH {LOG}, a AS ({_state(ARRIVED)}), b AS ({_state('event_time_ns, ' + ARRIVED)}) SELECT coalesce(a.id, b.id) AS id, a.status AS live_status, b.status AS as_of_status FROM a FULL JOIN b ON a.id = b.id WHERE a.status IS DISTINCT FROM b.status OR a.bucket IS DISTINCT FROM b.bucket",
    "q11_graph_diff_entities": f"WITH {LOG} " + _diff("log", "id", T10, T11, "entity.created", "entity.deleted", ", state"),
    "q12_graph_diff_relations": f"WITH {ELOG} " + _diff("elog", "edge", _YEAR, _YEAR + 365 * DAY, "relation.added", "relation.removed", ""),
    "q13_diff_totals": f"WITH {LOG} SELECT outcome, count(*) AS n FROM ({_diff('log', 'id', T10, T11, 'entity.created', 'entity.deleted', '')}) GROUP BY outcome",
    "q14_change_digest": f"WITH {LOG} " + _digest(T10 + DAY, "true", True),
    "q15_digest_scoped": f"WITH {LOG} " + _digest(T10 + 3 * DAY, "id % 10 = 3", False),
    "q17_shortest_hops": f"WITH RECURSIVE {BOTH}, {_reach('both_ways', 'SELECT CAST(0 AS BIGINT) AS id', 4)} SELECT depth AS hops, count(*) AS n FROM first GROUP BY depth",
    "q20_canonical_components": f"""WITH b AS (SELECT c_custkey, c_nationkey AS a, c_mktsegment AS s, c_acctbal, CASE WHEN 1 - (c_acctbal - lag(c_acctbal) OVER w) / 10000 >= 0.9 THEN 0 ELSE 1 END AS new FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey)),
      i AS (SELECT *, sum(new) OVER (PARTITION BY a, s ORDER BY c_acctbal, c_custkey ROWS UNBOUNDED PRECEDING) AS island FROM b) SELECT {_node(3, 'c_custkey')} AS id, min({_node(3, 'c_custkey')}) OVER (PARTITION BY a, s, island) AS root FROM i""",
    "q21_host_attribution": f"""SELECT {_node(1, 'n_nationkey')} AS id, {_node(1, 'n_nationkey')} AS host FROM nation UNION ALL SELECT {_node(2, 's_suppkey')}, {_node(1, 's_nationkey')} FROM supplier
      UNION ALL SELECT {_node(5, 'o_orderkey')}, {_node(1, 'c_nationkey')} FROM orders LEFT JOIN customer ON o_custkey = c_custkey UNION ALL SELECT {_node(4, 'p_partkey')}, NULL FROM part""",
    "q22_describe_type": """WITH few AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 500), f AS (SELECT count(*) AS n, arg_min(c_name, c_custkey) AS name, arg_min(c_mktsegment, c_custkey) AS seg FROM few)
      SELECT 'identity' AS section, 'service.instance.id' AS key, n AS seen, name AS example FROM f UNION ALL SELECT 'attributes', 'service.name', n, name FROM f UNION ALL SELECT 'attributes', 'segment', n, seg FROM f""",
    "q23_relation_shapes": f"WITH {RELS} SELECT type, ft AS from_type, tt AS to_type, true AS structural, count(*) AS n FROM rels GROUP BY ALL",
    "q24_liveness_expiry": f"WITH {LIVES} SELECT id, CAST(life AS BIGINT) AS life, start_ns, end_ns FROM ends WHERE ended_by = 'liveness_expiry'",
    "q25_refcount_intervals": f"WITH {LIVES} SELECT id, CAST(life AS BIGINT) AS life, CAST(sum(CASE WHEN start_ns - p > 900000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY life ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incarnation, start_ns, end_ns, ended_by FROM (SELECT *, lag(end_ns) OVER (PARTITION BY id ORDER BY life) AS p FROM ends)",
    "q26_removal_by_absence": """WITH r AS (SELECT o_orderpriority AS producer, o_custkey AS source, o_orderkey AS seq, list(DISTINCT l_partkey) AS targets FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
      p AS (SELECT *, lag(targets) OVER (PARTITION BY producer, source ORDER BY seq) AS old FROM r) SELECT producer, source, seq, unnest(list_filter(old, lambda x: NOT list_contains(targets, x))) AS target FROM p WHERE old IS NOT NULL""",
    "q27_parked_edges": f"""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, epoch_us(o_orderdate) * 1000 AS said_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey), b AS (SELECT l_partkey, min(epoch_us(l_shipdate)) * 1000 AS born FROM lineitem GROUP BY 1)
      SELECT l_orderkey || '-' || l_partkey AS edge, CASE WHEN greatest(born, said_at) - said_at <= {30 * DAY} THEN greatest(born, said_at) - said_at END AS waited_ns FROM e JOIN b USING (l_partkey)""",
    "q28_aliases": f"WITH {BELIEFS} SELECT 'service.instance.id' AS key, 's:' || t_name AS alias, min('s:' || f_name) AS canonical FROM beliefs WHERE confidence BETWEEN 0.9 AND 1 AND t_name <> f_name GROUP BY t_name HAVING min(f_name) = max(f_name)",
    "q29_coalesce": f"WITH {LOG} SELECT seq, change_type FROM (SELECT *, lag(change_type) OVER w AS p, lead(change_type) OVER w AS n FROM log WINDOW w AS (PARTITION BY id ORDER BY {ARRIVED})) WHERE NOT (change_type = 'entity.unchanged' AND coalesce(p, '') = 'entity.unchanged' AND coalesce(n, '') = 'entity.unchanged')",
    "q30_prune": f"WITH {LOG} SELECT seq, change_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at_ns DESC, seq DESC) AS k FROM log) WHERE recorded_at_ns >= {T15} OR (k = 1 AND change_type <> 'entity.deleted')",
    "q31_baselines": f"""WITH {LOG}, last AS (SELECT id, min(event_time_ns) AS born, arg_max(change_type, ({ARRIVED})) AS now, arg_max(event_time_ns, ({ARRIVED})) AS newest, arg_max(status, ({ARRIVED})) FILTER (change_type <> 'entity.unchanged') AS status FROM log GROUP BY id)
      SELECT id, status, CAST({T15} AS BIGINT) AS event_time_ns FROM last WHERE born <= {T15} AND now <> 'entity.deleted' AND newest > {T15}""",
    "q32_serial_overlap": "SELECT 'SN0' || (s_suppkey // 3) AS serial, count(*) AS n_devices FROM supplier GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey // 5) % 2 END) < 2 AND length('SN0' || min(s_suppkey // 3)) >= 4",
    "q33_type_cap": "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM c) SELECT CASE WHEN k <= 7 THEN p_brand ELSE 'other' END AS type, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "q34_vocabulary": "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'up', 'down', 'testing', 'unknown', 'dormant', 'not_present', 'lower_layer_down') GROUP BY 1",
    "q35_annotation_merge": "SELECT o_custkey AS fingerprint, o_orderpriority AS key, arg_max(o_orderstatus, o_orderkey) AS value, max(o_orderkey) AS updated_at FROM orders GROUP BY 1, 2 HAVING arg_max(o_orderstatus, o_orderkey) <> 'P'",
    "q36_telemetry_keys": TELEMETRY,
    "q37_endpoint_resolution": """WITH e AS (SELECT o_orderkey AS endpoint, 'a' || (o_custkey % 500) AS address, o_orderkey % 20 AS port, CASE o_orderkey % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' END AS transport, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 30 END AS scope FROM orders),
      l AS (SELECT p_partkey AS listener, 'a' || (p_partkey % 400) AS bind, p_size % 20 AS port, CASE p_partkey % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' END AS transport, p_partkey % 25 AS host FROM part),
      h AS (SELECT 'a' || (c_custkey % 450) AS address, min(c_nationkey) AS host FROM customer GROUP BY 1),
      x AS (SELECT e.*, CASE WHEN scope IS NULL THEN h.host WHEN scope IN (SELECT n_nationkey FROM nation) THEN scope END AS place FROM e LEFT JOIN h USING (address)),
      r AS (SELECT endpoint, any_value(place) AS place, min(l.listener) FILTER (scope IS NULL AND l.bind = x.address) AS bound, min(l.listener) FILTER (l.host = x.place) AS near FROM x LEFT JOIN l ON l.port = x.port AND (l.bind = x.address OR l.host = x.place) AND coalesce(l.transport = x.transport, true) GROUP BY endpoint)
      SELECT endpoint, CAST(coalesce(bound, near, place) AS BIGINT) AS target, CASE WHEN bound IS NOT NULL THEN 'bind' WHEN near IS NOT NULL THEN 'port' WHEN place IS NOT NULL THEN 'host' END AS how FROM r""",
    "q38_heartbeat_tally": f"WITH {LOG} SELECT change_type, count(*) AS n FROM log WHERE event_time_ns BETWEEN {JAN} AND {JAN + 40 * DAY} GROUP BY 1",
    "q39_logship_gap": """WITH s AS (SELECT 't' || (c_custkey % 7) AS tenant, (c_custkey // 7) * 10 + CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 0 END AS from_seq, (c_custkey // 7) * 10 + CASE WHEN c_custkey % 13 = 0 THEN 12 ELSE 9 END AS to_seq FROM customer),
      x AS (SELECT *, 1 + max(to_seq) OVER (PARTITION BY tenant ORDER BY from_seq, to_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected FROM s) SELECT tenant, from_seq, to_seq, expected, CASE WHEN from_seq > expected THEN 'gap' ELSE 'overlap' END AS fault FROM x WHERE from_seq <> expected""",
    "q40_contested_names": f"""WITH {OBS}, r AS (SELECT * FROM (SELECT id, scope AS name, event_time_ns AS said_at, seq, lag(scope) OVER (PARTITION BY id ORDER BY event_time_ns, seq) AS p FROM obs WHERE kind = 'state') WHERE p IS NULL OR p <> name)
      SELECT id, count(*) AS n_returns FROM (SELECT *, lag(said_at) OVER (PARTITION BY id, name ORDER BY said_at, seq) AS last FROM r) WHERE said_at - last <= {3 * DAY} GROUP BY id""",
}
_NATIONS = f"SELECT {_node(1, 'n_nationkey')} AS id FROM nation"
_DOWN = RELS + ", down AS (SELECT t AS src, f AS dst, type FROM rels)"
ORACLE_SQL["q16_neighbors_d2"] = f"WITH RECURSIVE {BOTH}, {_reach('both_ways', _NATIONS + ' WHERE n_nationkey < 3', 2)} SELECT root, node, depth, via FROM first WHERE depth > 0"
ORACLE_SQL["q18_impact"] = f"WITH RECURSIVE {_DOWN}, {_reach('down', _NATIONS, 10)} SELECT root, depth, count(*) AS n FROM first WHERE depth > 0 GROUP BY ALL"
ORACLE_SQL["q19_impact_by_type"] = f"WITH RECURSIVE {_DOWN}, {_reach('down', _NATIONS, 10)} SELECT root, CAST(node // {S} AS INTEGER) AS kind, count(*) AS n FROM first WHERE depth > 0 GROUP BY ALL"
_REGIONS = f"SELECT {_node(0, 'r_regionkey')} AS id FROM region"
ORACLE_SQL["q41_neighbors_d2_all"] = f"WITH RECURSIVE {BOTH}, {_reach('both_ways', _NATIONS, 2)} SELECT root, node, depth, via FROM first WHERE depth > 0"
ORACLE_SQL["q42_shortest_hops_all"] = f"WITH RECURSIVE {BOTH}, {_reach('both_ways', _REGIONS, 4)} SELECT root, depth AS hops, count(*) AS n FROM first GROUP BY ALL"
ORACLE_SQL["q43_digest_by_producer"] = f"WITH {LOG} " + _digest(T10 + 3 * DAY, "true", False).replace("change_type, type, keys, scope, delete_source", "producer, change_type, type, keys, scope, delete_source")
ORACLE_SQL["q44_history_known_all"] = f"WITH {LOG} SELECT seq, id, change_type, event_time_ns, recorded_at_ns FROM log WHERE event_time_ns >= {T10} AND recorded_at_ns <= {T15}"
_CUSTOMER = _fp("service.instance", ("service.instance.id", "'s:' || c_name"))
_DEVICES = "SELECT CASE s_suppkey % 5 WHEN 0 THEN 's:Cisco' WHEN 1 THEN 's:hpe' WHEN 2 THEN 'i:729' WHEN 3 THEN 's: arista' END AS vendor FROM supplier"
ORACLE_SQL["q45_resolved_handles"] = f"""SELECT 'host:host.id=' || n_nationkey AS handle, CAST({_node(1, 'n_nationkey')} AS VARCHAR) AS id FROM nation UNION ALL SELECT 'network.segment:network.segment.id=' || r_name, CAST({_node(0, 'r_regionkey')} AS VARCHAR) FROM region
  UNION ALL SELECT {_CUSTOMER}, CAST(min({_node(3, 'c_custkey')}) OVER (PARTITION BY c_name) AS VARCHAR) FROM customer UNION ALL SELECT 'host:' || s_suppkey, NULL FROM supplier UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'process:process.pid=' || o_orderkey || ',process.creation.time=' || strftime(o_orderdate, '%Y-%m-%d'), CAST({_node(5, 'o_orderkey')} AS VARCHAR) FROM orders"""
_CARDS = f"""SELECT {_node(0, 'r_regionkey')} AS id, 'network.segment' AS type, {_fp('network.segment', ('network.segment.id', "'s:' || r_name"))} AS fingerprint, r_name AS name FROM region
  UNION ALL SELECT {_node(1, 'n_nationkey')}, 'host', {_fp('host', ('host.id', "'i:' || n_nationkey"))}, n_name FROM nation UNION ALL SELECT {_node(2, 's_suppkey')}, 'network.device', {_fp('network.device', ('network.device.id', "'s:' || s_name"))}, NULL FROM supplier
  UNION ALL SELECT {_node(3, 'c_custkey')}, 'service.instance', {_CUSTOMER}, c_name FROM customer UNION ALL SELECT {_node(4, 'p_partkey')}, 'db', {_fp('db', ('db.instance.id', "'i:' || p_partkey"))}, p_name FROM part
  UNION ALL SELECT {_node(5, 'o_orderkey')}, 'process', {_fp('process', ('process.creation.time', "'s:' || strftime(o_orderdate, '%Y-%m-%d')"), ('process.pid', "'i:' || o_orderkey"))}, NULL FROM orders"""
ORACLE_SQL["q46_entity_cards"] = f"""WITH {RELS}, e AS ({_CARDS}), o AS (SELECT f AS id, count(*) AS n_out FROM rels GROUP BY 1), i AS (SELECT t AS id, count(*) AS n_in FROM rels GROUP BY 1)
  SELECT id, type, fingerprint, coalesce(name, fingerprint) AS name, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM e LEFT JOIN o USING (id) LEFT JOIN i USING (id)"""
ORACLE_SQL["q47_relation_page"] = f"""WITH {RELS}, r AS (SELECT type || ':' || substr(sha256(type || chr(31) || f || chr(31) || t), 1, 32) AS relation_id, f AS from_id, t AS to_id FROM rels WHERE type = 'depends_on' AND tt = 'network.device'),
  p AS (SELECT *, row_number() OVER (ORDER BY relation_id) AS k, count(*) OVER () AS n FROM r WHERE relation_id > 'depends_on:8') SELECT relation_id, from_id, to_id, base64(encode(relation_id)) AS cursor, n > 40 AS has_next_page FROM p WHERE k <= 40"""
ORACLE_SQL["q48_cascade"] = f"""WITH {LOG}, e AS (SELECT DISTINCT o_custkey AS from_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS to_id FROM orders), g AS (SELECT id, event_time_ns, seq FROM log WHERE change_type = 'entity.deleted')
  SELECT DISTINCT from_id, to_id, event_time_ns, seq, 'cascade' AS delete_source FROM e JOIN g ON id = from_id OR id = to_id"""
ORACLE_SQL["q49_speakers"] = f"""WITH {OBS}, said AS (SELECT id, CASE scope WHEN 'm3' THEN '' ELSE producer || '/' || scope END AS speaker, max(recorded_at_ns) AS heard, arg_max(kind, ({ARRIVED})) AS kind, arg_max(CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END, ({ARRIVED})) * {DAY} AS interval_ns FROM obs WHERE recorded_at_ns <= {T15} GROUP BY ALL)
  SELECT id, coalesce(string_agg(speaker, ',' ORDER BY speaker) FILTER (speaker <> ''), '') AS asserted_by, count(*) FILTER (speaker = '') AS n_anonymous, max(interval_ns) AS interval_ns FROM said WHERE kind = 'state' AND heard + interval_ns > {T15} GROUP BY id"""
ORACLE_SQL["q50_inert_beliefs"] = f"""WITH {BELIEFS}, b AS (SELECT {_node(3, 'f')} AS from_id, {_node(3, 't')} AS to_id, confidence AS c FROM beliefs WHERE f IS NOT NULL), m AS (SELECT from_id, to_id, CASE WHEN to_id % 5 = 0 THEN NULL WHEN to_id % 7 = 0 THEN c + 1 ELSE c END AS c FROM b)
  SELECT from_id, to_id, CASE WHEN c IS NULL THEN 'missing' ELSE 'out of range' END AS reason FROM m WHERE c IS NULL OR c NOT BETWEEN 0 AND 1"""
ORACLE_SQL["q51_neighbor_page"] = f"""WITH {RELS}, b AS (SELECT f AS root, t AS node, type, true AS outgoing FROM rels UNION ALL SELECT t, f, type, false FROM rels WHERE f <> t), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY root ORDER BY node, type, outgoing) AS INTEGER) AS place FROM b JOIN ({_NATIONS}) n ON n.id = root WHERE type IN ('runs_on', 'attached_to'))
  SELECT root, node, type, outgoing, place FROM r WHERE place <= 50"""
ORACLE_SQL["q52_attribute_problems"] = """WITH a AS (SELECT ['oper_state', 'admin_state', 'duplex', 'interface.type', 'host.chassis.type', 'host.virtualization'][event_id % 6 + 1] AS key, (event_id // 6) % 4 AS w FROM events),
  p AS (SELECT key, CASE w WHEN 0 THEN CASE WHEN key IN ('admin_state', 'interface.type', 'host.chassis.type') THEN 'outside' END WHEN 1 THEN 'outside' WHEN 2 THEN 'no string' ELSE 'empty' END AS problem, ['unknown', 'auto', '7', ''][w + 1] AS value FROM a)
  SELECT key, value, problem, key <> 'host.virtualization' AS refused, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY ALL"""
ORACLE_SQL["q53_vendor_hygiene"] = f"SELECT count(vendor) AS population, count(*) FILTER (vendor <> 's:hpe') AS non_normative, count(*) FILTER (vendor IS NULL) AS retired FROM ({_DEVICES})"
ORACLE_SQL["q54_newest_in_window"] = f"WITH {LOG} SELECT 'default' AS tenant, max(event_time_ns) AS newest_ns FROM log WHERE event_time_ns BETWEEN {T10} AND {T10 + DAY // 2} HAVING count(*) > 0"
ORACLE_SQL["q55_touching_and_tail"] = f"WITH {LOG} SELECT seq, id, change_type FROM log WHERE seq > 500 AND id = 7"

_PROBLEMS = lambda key, rules: "\n".join(["", *[f"{'UNION ALL ' if i else ''}SELECT {key}, '{name}' AS problem, {advisory} AS advisory FROM e WHERE {where}" for i, (name, advisory, where) in enumerate(rules)]])
ORACLE_SQL["q56_belief_problems"] = """WITH e AS (SELECT *, CASE WHEN left(confidence, 2) IN ('d:', 'i:') THEN TRY_CAST(substr(confidence, 3) AS DOUBLE) END AS c FROM (SELECT CAST(c_custkey AS BIGINT) AS edge,
  CASE c_custkey % 7 WHEN 6 THEN 'resolves_to' WHEN 5 THEN 'runs_on' ELSE 'same_as' END AS type, [NULL, 'd:0.5', 'i:1', 's:high', 'd:1.5', 'd:-0.25'][c_custkey % 6 + 1] AS confidence,
  [NULL, ' ', 'rekey', 'serial', 'k8s_api'][c_custkey % 5 + 1] AS basis FROM customer))""" + _PROBLEMS("edge", [
    ("no basis", True, "type = 'same_as' AND (basis IS NULL OR trim(basis) = '')"), ("no confidence", False, "type = 'same_as' AND confidence IS NULL"),
    ("confidence is no number", False, "type = 'same_as' AND confidence IS NOT NULL AND c IS NULL"), ("confidence is outside [0, 1]", False, "type = 'same_as' AND c NOT BETWEEN 0 AND 1"),
    ("confidence is not that of its basis", False, "type = 'same_as' AND c BETWEEN 0 AND 1 AND c <> 1 AND basis IN ('rekey', 'k8s_api', 'vm_id_match')"),
    ("confidence is read by nothing", True, "type = 'resolves_to' AND confidence IS NOT NULL"),
])
_OCTETS = lambda sep: f" || '{sep}' || ".join(f"substr(h, {i}, 2)" for i in range(1, 12, 2))
ORACLE_SQL["q57_spelling_problems"] = f"""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS thing, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
  u AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS uuid FROM o),
  e AS (SELECT thing, 'identity' AS field, 'host.id' AS key, 's' AS kind, [h, upper(uuid), uuid, 'web-' || thing, upper(h)][thing % 5 + 1] AS t FROM u
    UNION ALL SELECT thing, 'identity', 'interface.name', 's', 'eth0' FROM o WHERE thing % 6 = 0 UNION ALL SELECT thing, 'identity', 'tags', 'a', '' FROM o WHERE thing % 9 = 0
    UNION ALL SELECT thing, 'attributes', CASE WHEN thing % 4 < 2 THEN 'mac' ELSE 'network.device.id' END, 's', [upper({_OCTETS("-")}), {_OCTETS(":")}, 'mac:' || {_OCTETS("-")}, 'serial:' || {_OCTETS("-")}][thing % 4 + 1] FROM o)""" + _PROBLEMS("thing, field, key", [
    ("raw machine id", False, "key = 'host.id' AND length(t) = 32 AND regexp_full_match(lower(t), '[0-9a-f]+')"),
    ("upper-case host id", False, "key = 'host.id' AND length(t) = 36 AND t <> lower(t) AND regexp_full_match(t, '[0-9A-Fa-f-]+')"),
    ("hardware address in another form", False, "(key = 'mac' OR t LIKE 'mac:%') AND NOT regexp_full_match(replace(t, 'mac:', ''), '([0-9A-F]{2}-){5}[0-9A-F]{2}')"),
    ("retired key in an identity", False, "key = 'interface.name'"), ("value is no scalar", False, "kind = 'a'"),
])
ORACLE_SQL["q58_record_problems"] = """WITH e AS (SELECT CAST(event_id AS BIGINT) AS record, event_id % 10 = 8 AS deletes, [NULL, 's:host', 'i:5', 's:', 's:db'][event_id % 5 + 1] AS type, event_id % 7 AS own,
  [NULL, 'i:60', 'i:-1', 'd:1.5'][event_id % 4 + 1] AS every, event_id % 3 = 0 AS related, event_id % 6 AS producer FROM events WHERE event_id % 10 <> 9)""" + _PROBLEMS("record", [
    ("no type", False, "type IS NULL"), ("type is no string", False, "type LIKE 'i:%'"), ("type is empty", False, "type = 's:'"), ("no identity", False, "own = 0"), ("identity is empty", False, "own = 1"),
    ("interval is no integer", False, "every = 'd:1.5'"), ("interval is negative", False, "every = 'i:-1'"), ("relationships on a delete", False, "deletes AND related"), ("anonymous producer", True, "producer < 3"),
])
ORACLE_SQL["q59_fleet_metrics"] = f"""WITH {RELS}, e AS ({_CARDS}), d AS (SELECT CASE WHEN (s_suppkey // 2) % 3 = 0 THEN 't' || (s_suppkey % 2) ELSE 't2' END AS tenant, s_suppkey AS id,
  CASE WHEN s_suppkey % 7 = 0 THEN 'S' ELSE 'SN-' END || (s_suppkey // 2) AS serial, CASE WHEN s_suppkey % 4 = 1 THEN 'other' WHEN s_suppkey % 5 > 0 THEN 'cisco' END AS vendor FROM supplier),
  n AS (SELECT * FROM d WHERE length(serial) >= 4)
SELECT 'entities' AS metric, '' AS label, count(*) AS value FROM e UNION ALL SELECT 'relations', '', count(*) FROM rels UNION ALL SELECT 'serial_population', '', count(*) FROM n
UNION ALL SELECT 'entities_by_type', type, count(*) FROM e GROUP BY type
UNION ALL SELECT 'events', '', CAST(sum(m) AS BIGINT) FROM (SELECT max(event_id) AS m FROM events GROUP BY user_id % 3)
UNION ALL SELECT 'serial_overlaps', '', count(*) FROM (SELECT 1 FROM n GROUP BY tenant, serial HAVING count(*) > 1 AND count(DISTINCT vendor) < 2)"""


def _rfc3339(ns: str) -> str:
    return f"""strftime(make_timestamp(({ns}) // 1000000000 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ({ns}) % 1000000000 > 0 THEN '.' || rtrim(lpad(CAST(({ns}) % 1000000000 AS VARCHAR), 9, '0'), '0') ELSE '' END || 'Z'"""


ORACLE_SQL["q60_restored_from_snapshot"] = f"WITH {LOG} " + _state(ARRIVED)
ORACLE_SQL["q61_tombstones"] = f"""WITH {LOG}, last AS (SELECT id, arg_max(change_type, ({ARRIVED})) AS now, arg_max(status, ({ARRIVED})) FILTER (change_type NOT IN ('entity.unchanged', 'entity.deleted')) AS status, max(recorded_at_ns) AS deleted_ns, arg_max(seq, ({ARRIVED})) AS q FROM log WHERE recorded_at_ns <= {T15} GROUP BY id)
  SELECT id, status, {_rfc3339("deleted_ns")} AS deleted_at FROM last WHERE now = 'entity.deleted' AND deleted_ns + {5 * DAY} >= {T15} ORDER BY deleted_ns DESC, q DESC LIMIT 1024"""
ORACLE_SQL["q62_entity_timeline"] = f"""WITH {LOG}, {ELOG}, x AS (SELECT *, CAST(split_part(edge, '>', 1) AS BIGINT) AS f, CAST(split_part(edge, '>', 2) AS BIGINT) AS t FROM elog)
  SELECT id AS entity, CAST(id AS VARCHAR) AS thing, change_type, event_time_ns, seq FROM log UNION ALL SELECT unnest(list_distinct([f, t])), 'depends_on>' || edge, change_type, event_time_ns, seq FROM x"""
ORACLE_SQL["q63_incident_relations"] = f"""WITH {RELS}, r AS (SELECT type || ':' || substr(sha256(type || chr(31) || f || chr(31) || t), 1, 32) AS relation_id, * FROM rels WHERE type = 'runs_on'), b AS (SELECT f AS id, relation_id, f, t, ft AS kind FROM r UNION ALL SELECT t, relation_id, f, t, tt FROM r WHERE f <> t)
  SELECT id, relation_id, f AS from_id, t AS to_id FROM b WHERE kind IN ('host', 'service.instance')"""
ORACLE_SQL["q64_fleet_totals"] = f"""WITH {OBS}, t AS (SELECT count(DISTINCT id) AS e, count(*) FILTER (kind = 'delete') AS r, max(seq) AS s, max(seq) FILTER (seq % 2 = 0) AS n, min(event_time_ns) AS h FROM obs GROUP BY id % 3)
  SELECT CAST(sum(e) AS BIGINT) AS entities, CAST(sum(r) AS BIGINT) AS relations, CAST(sum(s) AS BIGINT) AS seq, max(n) AS snapshot_seq, max(h) AS horizon_ns FROM t"""
ORACLE_SQL["q65_ingest_counters"] = """WITH r AS (SELECT 't' || (user_id % 5) AS tenant, event_id % 10 NOT IN (7, 9) AS entity, event_id % 6 = 2 AS refused, event_id % 4 = 0 AS unknown, event_id % 3 AS dropped FROM events),
  c AS (SELECT tenant, count(*) FILTER (entity AND NOT refused) AS handled, count(*) FILTER (NOT entity) AS ignored, count(*) FILTER (entity AND refused) AS rejected, CAST(coalesce(sum(dropped) FILTER (entity), 0) AS BIGINT) AS values_dropped, count(*) FILTER (entity AND NOT refused AND unknown) AS unknown_types FROM r GROUP BY tenant)
  SELECT tenant, counter, n FROM (UNPIVOT c ON handled, ignored, rejected, values_dropped, unknown_types INTO NAME counter VALUE n)"""
ORACLE_SQL["q66_refused_promises"] = f"WITH {OBS} SELECT producer, count(*) AS total, max(recorded_at_ns) AS last_ns FROM obs WHERE kind = 'state' AND seq % 9 + 1 > 7 GROUP BY producer"
_SAVED = OBS + f""", said AS (SELECT id, producer || '/' || scope AS speaker, kind, recorded_at_ns AS said_at, seq, CASE seq % 5 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE seq % 5 END * {DAY} AS promise FROM obs WHERE recorded_at_ns <= {T15}),
  newest AS (SELECT *, CASE WHEN promise > {7 * DAY} THEN 0 ELSE promise END AS every FROM (SELECT *, row_number() OVER (PARTITION BY id, speaker ORDER BY said_at DESC, seq DESC) AS k FROM said) WHERE k = 1 AND kind = 'state'),
  held AS (SELECT id, speaker, CASE WHEN every > 0 THEN said_at + every END AS deadline_ns, every AS interval_ns FROM newest WHERE every = 0 OR said_at + every > {T15})"""
ORACLE_SQL["q67_restored_deadlines"] = f"WITH {_SAVED} SELECT id, speaker, CASE WHEN interval_ns > 0 THEN greatest(deadline_ns, {T15 + DAY // 2} + interval_ns) END AS deadline_ns, interval_ns FROM held"
ORACLE_SQL["q68_resolved_edges"] = f"""WITH {BELIEFS}, a AS (SELECT t_name AS alias, min(f_name) AS canonical FROM beliefs WHERE confidence BETWEEN 0.9 AND 1 AND t_name <> f_name GROUP BY t_name HAVING min(f_name) = max(f_name)),
  ids AS (SELECT c_name AS name, min({_node(3, 'c_custkey')}) AS id FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1), r AS (SELECT n.name, coalesce(i.id, j.id) AS id, i.id IS NULL AND j.id IS NOT NULL AS swapped FROM (SELECT DISTINCT c_name AS name FROM customer) n LEFT JOIN ids i USING (name) LEFT JOIN a ON a.alias = n.name LEFT JOIN ids j ON j.name = a.canonical)
  SELECT {_node(3, 'b.f')} || '>' || {_node(3, 'b.t')} AS edge, x.id AS from_id, y.id AS to_id, CASE WHEN x.id IS NULL OR y.id IS NULL THEN 'missing' WHEN (x.swapped OR y.swapped) AND x.id = y.id THEN 'collapsed' ELSE 'resolved' END AS outcome FROM beliefs b JOIN r x ON x.name = b.f_name JOIN r y ON y.name = b.t_name"""
ORACLE_SQL["q69_inherited_deadlines"] = f"""WITH {_SAVED}, e AS (SELECT o_orderkey AS edge, o_custkey AS from_id, 'p' || (o_orderkey % 3) || '/m' || (o_orderkey % 4) AS speaker, o_orderkey % 5 = 0 AS own FROM orders)
  SELECT edge, from_id, e.speaker, CASE WHEN own THEN {T15 + DAY} ELSE deadline_ns END AS deadline_ns, CASE WHEN own THEN {DAY} ELSE coalesce(interval_ns, 0) END AS interval_ns FROM e LEFT JOIN held ON held.id = from_id AND held.speaker = e.speaker"""
_H = 820_454_400 * 10**9
ORACLE_SQL["q70_window_reach"] = f"""WITH w AS (SELECT o_orderkey, epoch_us(o_orderdate) * 1000 + o_orderkey % 1000 * 1000000 AS s FROM orders), r AS (SELECT *, CASE WHEN s >= {_H} THEN 'whole' WHEN s + {30 * DAY} <= {_H} THEN 'empty' ELSE 'partial' END AS reach FROM w)
  SELECT o_orderkey, reach, CASE WHEN reach <> 'empty' THEN {_rfc3339(f"greatest(s, {_H})")} END AS answerable_from FROM r"""
_KEYS = {"region": ("network.segment", "network.segment.id", "segment.name"), "nation": ("host", "host.id", "host.name", "status"), "supplier": ("network.device", "network.device.id", "hw.vendor", "chassis.serial"), "customer": ("service.instance", "service.instance.id", "service.name", "segment"), "part": ("db", "db.instance.id", "db.name", "brand"), "orders": ("process", "process.pid", "process.creation.time", "status", "priority")}
ORACLE_SQL["q71_key_carriers"] = "SELECT key, string_agg(type, ', ' ORDER BY type) AS types, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{key}' AS key, '{kind}' AS type, count(*) AS n FROM {table}" for table, (kind, *keys) in _KEYS.items() for key in keys) + ") WHERE n > 0 GROUP BY key"
