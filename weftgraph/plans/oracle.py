"""DuckDB twins of queries.py, written from the definitions and not from the Spark code."""

from __future__ import annotations


def ledger() -> str:
    """Common table expressions ``sight`` and ``e`` (edges)."""
    return """
base AS (
  SELECT 'svc-' || c_nationkey AS c, 'svc-' || s_nationkey AS s, p_brand AS brand, p_type AS ptype, c_mktsegment AS segment,
    l_returnflag AS flag, o_orderpriority AS priority, 'orders/' || l_orderkey AS path, l_linenumber AS line
  FROM lineitem, orders, customer, supplier, part
  WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND l_partkey = p_partkey),
sight AS (
  SELECT s AS actor, 'pub' AS rel, brand AS object, CASE WHEN flag = 'N' THEN '-' ELSE 'key=' || flag END AS label, 'CODE' AS tag, path, line FROM base
  UNION ALL SELECT c, 'sub', brand, 'group=' || c, 'CODE', path, line FROM base
  UNION ALL SELECT c, 'http', s, 'GET /' || priority, 'CODE', path, line FROM base WHERE c <> s
  UNION ALL SELECT s, 'http', 'ext-' || ptype, 'POST /v1/' || ptype, 'CODE', path, line FROM base
  UNION ALL SELECT c, 'grpc', 'ref-' || segment, '-', 'INFERENCE', path, line FROM base
  UNION ALL SELECT s, 'pub', 'returns.' || brand, '-', 'CODE', path, line FROM base WHERE flag = 'R'
  UNION ALL SELECT c, 'sub', 'promo.' || segment, 'group=' || c, 'CODE', path, line FROM base
  UNION ALL SELECT 'svc-' || n_nationkey, 'uses', 'db-' || replace(r_name, ' ', '-'), 'sql', 'CODE', 'nations/' || n_nationkey, 1 FROM nation, region WHERE n_regionkey = r_regionkey),
perfile AS (SELECT actor, rel, object, label, min(tag) AS tag, path, path || ':' || string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR) AS item FROM sight GROUP BY actor, rel, object, label, path),
e AS (SELECT actor, rel, object, label, min(tag) AS tag, string_agg(item, '; ' ORDER BY path) AS receipts FROM perfile GROUP BY actor, rel, object, label)"""


NODES = """
n AS (
  SELECT 'svc-' || n_nationkey AS id, 'svc' AS kind, lower(replace(r_name, ' ', '-')) AS tech FROM nation, region WHERE n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT p_brand, 'topic', 'kafka' FROM part
  UNION ALL SELECT DISTINCT 'returns.' || p_brand, 'topic', 'kafka' FROM part
  UNION ALL SELECT DISTINCT 'promo.' || c_mktsegment, 'topic', 'kafka' FROM customer
  UNION ALL SELECT 'db-' || replace(r_name, ' ', '-'), 'db', 'postgres' FROM region
  UNION ALL SELECT DISTINCT 'ext-' || p_type, 'ext', 'http' FROM part
  UNION ALL SELECT DISTINCT 'ref-' || c_mktsegment, 'ref', 'grpc' FROM customer)"""

E = f"WITH RECURSIVE {ledger()}"
EN = f"WITH RECURSIVE {ledger()},{NODES}"
_SVC = """
pairs AS (
  SELECT DISTINCT dependent, dependency FROM (
    SELECT actor AS dependent, object AS dependency FROM e WHERE rel NOT IN ('pub', 'sub')
    UNION ALL SELECT r.actor, w.actor FROM e r JOIN e w ON r.object = w.object AND r.rel = 'sub' AND w.rel = 'pub') WHERE dependent <> dependency)"""
_VIEW = "SELECT actor, rel, object, label, tag, receipts"
_LINES = """
files AS (SELECT 'pages/' || page_id AS path, html AS t FROM pages UNION ALL SELECT 'documents/' || doc_id, text FROM documents),
cut AS (SELECT path, string_split(CASE WHEN t LIKE '%' || chr(10) THEN t[:-2] ELSE t END, chr(10)) AS a FROM files WHERE t IS NOT NULL AND t <> ''),
lines AS (SELECT path, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS text FROM cut)"""


def _closure(frm: str, to: str, start: str, hops: int, extra: str = "") -> str:
    return f"""{E},{_SVC},
p AS (SELECT {frm} AS f, {to} AS t FROM pairs {extra}),
r AS (SELECT {start} AS id, 0 AS ring FROM e WHERE rel = 'http' UNION SELECT p.t, r.ring + 1 FROM r JOIN p ON p.f = r.id WHERE r.ring < {hops})
SELECT id AS node, min(ring)::BIGINT AS ring FROM r GROUP BY id HAVING min(ring) > 0"""


_IMPACT_EXTRA = "UNION SELECT object, actor FROM e WHERE rel = 'sub'"


def _finding(rule: str, severity: str, finding: str, participants: str, evidence: str, frm: str, cte: str = E) -> str:
    return f"{cte} SELECT '{rule}' AS id, '{severity}' AS severity, {finding} AS finding, {participants} AS participants, {evidence} AS evidence FROM {frm}"


_T2 = "(SELECT DISTINCT c.actor AS x, c.object AS p, s.object AS t FROM e c JOIN e s ON s.actor = c.actor AND s.rel = 'sub' JOIN e w ON w.actor = c.object AND w.rel = 'pub' AND w.object = s.object WHERE c.rel IN ('http', 'grpc') AND c.actor <> c.object)"
_T3 = "(SELECT object, string_agg(actor, ', ' ORDER BY actor) AS users, string_agg(actor, ',' ORDER BY actor) AS who, string_agg(actor || ' uses ' || object, '; ' ORDER BY actor) AS ev FROM (SELECT DISTINCT actor, object FROM e JOIN n ON n.id = e.object AND n.kind = 'db' WHERE rel = 'uses') GROUP BY object HAVING count(*) >= 2)"
_T4 = "(SELECT object, count(*) FILTER (WHERE rel = 'pub') AS pubs, count(*) FILTER (WHERE rel = 'sub') AS subs FROM e WHERE rel IN ('pub', 'sub') GROUP BY object HAVING pubs = 0 OR subs = 0)"
_T9 = "(SELECT actor, e.object, b.k FROM e JOIN (SELECT object, count(DISTINCT actor) AS k FROM e WHERE rel = 'sub' GROUP BY object HAVING k >= 2) b ON b.object = e.object WHERE rel = 'pub' AND label NOT LIKE '%key=%')"
_VISITS = """
ev AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
sight AS (
  SELECT 'svc-' || event_type AS actor, 'http' AS rel, 'svc-' || nx AS object, 'GET /next' AS label, 'CODE' AS tag, 'users/' || user_id AS path, dayofyear(ts) AS line FROM ev WHERE nx <> event_type
  UNION ALL SELECT 'svc-' || event_type, 'uses', CASE WHEN value < 10 THEN 'db-small' ELSE 'db-large' END, 'sql', 'CODE', 'users/' || user_id, dayofyear(ts) FROM ev
  UNION ALL SELECT 'svc-' || event_type, 'pub', event_type || '.seen', '-', 'CODE', 'users/' || user_id, dayofyear(ts) FROM ev),
e AS (SELECT actor, rel, object, label, min(tag) AS tag, count(DISTINCT path || ':' || line) AS places FROM sight GROUP BY actor, rel, object, label),
n AS (SELECT DISTINCT 'svc-' || event_type AS id, 'svc' AS kind FROM events UNION ALL SELECT DISTINCT event_type || '.seen', 'topic' FROM events UNION ALL VALUES ('db-small', 'db'), ('db-large', 'db'))"""
V = f"WITH RECURSIVE {_VISITS}"
_SYNC_PATHS = """
c AS (SELECT DISTINCT actor AS a, object AS b FROM e WHERE rel IN ('http', 'grpc', 'gql', 'ws') AND actor <> object),
w AS (SELECT a AS start, '/' || a || '/' || b || '/' AS p, b AS at, 1 AS hops FROM c
  UNION ALL SELECT start, p || c.b || '/', c.b, hops + 1 FROM w JOIN c ON c.a = w.at WHERE hops < 6 AND instr(p, '/' || c.b || '/') = 0)"""
_CYCLES = """
cc AS (SELECT DISTINCT actor AS a, object AS b FROM e WHERE rel IN ('http', 'grpc', 'gql') AND actor <> object),
cw AS (SELECT DISTINCT a AS root, [a] AS p, a AS at, 1 AS hops FROM cc
  UNION ALL SELECT root, list_append(p, b), b, hops + 1 FROM cw JOIN cc ON cc.a = cw.at WHERE hops < 6 AND b > root AND NOT list_contains(p, b)),
cyc AS (SELECT p, root FROM cw JOIN cc ON cc.a = cw.at AND cc.b = cw.root)"""
_HUBS = "(SELECT node, count(*) AS k FROM (SELECT actor AS node FROM e UNION ALL SELECT object FROM e) WHERE node IN (SELECT id FROM n WHERE kind = 'svc') GROUP BY node HAVING k >= 6 AND k * 10 >= 3 * (SELECT count(*) FROM e))"
_CHAINS = "(SELECT start, max(hops) AS depth FROM w GROUP BY start HAVING max(hops) >= 3)"
_ONCE = "(SELECT actor, rel, object, label FROM sight WHERE rel IN ('http', 'grpc', 'gql', 'ws') AND tag = 'CODE' GROUP BY ALL HAVING count(DISTINCT path || ':' || line) = 1)"
_SNAPSHOTS = f"""{ledger()},
was AS (SELECT * FROM sight WHERE NOT (rel = 'pub' AND object LIKE 'returns.%')),
now AS (SELECT actor, rel, object, CASE WHEN rel = 'uses' THEN 'jdbc' ELSE label END AS label, tag, path, line FROM sight WHERE label <> 'GET /5-LOW'),
e_o AS (SELECT DISTINCT actor, rel, object, label FROM was), e_n AS (SELECT DISTINCT actor, rel, object, label FROM now)"""
_DIFF = f"""WITH {_SNAPSHOTS},
side AS (SELECT *, true AS was FROM (FROM e_o EXCEPT FROM e_n) UNION ALL SELECT *, false FROM (FROM e_n EXCEPT FROM e_o)),
k AS (SELECT *, count(*) FILTER (WHERE was) OVER w AS gone, count(*) FILTER (WHERE NOT was) OVER w AS come FROM side WINDOW w AS (PARTITION BY actor, rel, object)),
d AS (SELECT actor, rel, object, max(label) FILTER (WHERE was) AS old_label, max(label) FILTER (WHERE NOT was) AS new_label, 'relabelled' AS change FROM k WHERE gone = 1 AND come = 1 GROUP BY actor, rel, object
  UNION ALL SELECT actor, rel, object, CASE WHEN was THEN label END, CASE WHEN NOT was THEN label END, CASE WHEN was THEN 'removed' ELSE 'added' END FROM k WHERE NOT (gone = 1 AND come = 1))"""
_MID = "CASE WHEN kind IN ('svc', 'ref') THEN 's_' WHEN kind IN ('topic', 'queue') THEN 't_' WHEN kind = 'ext' THEN 'x_' ELSE 'd_' END || regexp_replace(id, '[^A-Za-z0-9]', '_', 'g')"
_ELIDE = "CASE WHEN length({0}) > 28 THEN substr({0}, 1, 14) || '…' || right({0}, 13) ELSE {0} END"
_ALL = f"""{V},{_SYNC_PATHS},{_CYCLES},
f AS (SELECT 'T1' AS id, 'high' AS severity FROM cyc UNION ALL SELECT 'T2', 'med' FROM {_T2} UNION ALL SELECT 'T3', 'high' FROM {_T3} UNION ALL SELECT 'T4', 'low' FROM {_T4} UNION ALL SELECT 'T5', 'med' FROM {_CHAINS}
  UNION ALL SELECT 'T6', 'med' FROM {_HUBS} UNION ALL SELECT 'T7', 'low' FROM (SELECT actor, object FROM e WHERE rel IN ('http', 'grpc', 'gql', 'ws') GROUP BY actor, object HAVING count(DISTINCT label) >= 4)
  UNION ALL SELECT 'T8', 'low' FROM {_ONCE} UNION ALL SELECT 'T9', 'info' FROM {_T9} UNION ALL SELECT 'T11', 'info' FROM n WHERE kind = 'ref'
  UNION ALL SELECT 'T12', 'info' FROM (SELECT count(*) FILTER (WHERE tag <> 'CODE') AS k, count(*) AS n FROM e) WHERE 5 * k > n)"""

_T7 = "(SELECT actor, object FROM sight WHERE rel IN ('http', 'grpc', 'gql', 'ws') GROUP BY actor, object HAVING count(DISTINCT label) >= 4)"
_T10 = "(SELECT DISTINCT a.actor AS p, b.actor AS c, a.object AS t, x.object AS u FROM e a JOIN e b ON a.object = b.object AND a.rel = 'pub' AND b.rel = 'sub' JOIN e x ON x.actor = b.actor AND x.rel = 'pub' JOIN e y ON y.object = x.object AND y.rel = 'sub' AND y.actor = a.actor WHERE a.actor < b.actor AND a.object <> x.object)"
_T11 = "(SELECT DISTINCT object AS id FROM e WHERE (rel = 'grpc' OR rel = 'http' AND object NOT IN (SELECT 'svc-' || n_nationkey FROM nation WHERE n_regionkey <> 0)) AND object NOT IN (SELECT id FROM n WHERE kind = 'ext') UNION SELECT id FROM n WHERE kind = 'ref')"
#: Components of the calls between services by mutual reachability, and chains through the eight services that most call (enough for six hops).
_DENSE = """
call AS (SELECT DISTINCT actor AS a, object AS b FROM sight WHERE rel IN ('http', 'grpc', 'gql') AND actor <> object),
reach AS (SELECT a, b FROM call UNION SELECT reach.a, call.b FROM reach JOIN call ON call.a = reach.b),
comp AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
first8 AS (SELECT b AS x FROM call WHERE b IN (SELECT a FROM call) GROUP BY b ORDER BY count(*) DESC, b LIMIT 8),
chain AS (SELECT a AS start, [a, b] AS p, b AS at, 1 AS hops FROM call
  UNION ALL SELECT start, list_append(p, b), b, hops + 1 FROM chain JOIN call ON call.a = chain.at WHERE hops < 6 AND b IN (SELECT x FROM first8) AND NOT list_contains(p, b)),
depth AS (SELECT start, max(hops) AS depth FROM chain GROUP BY start)"""
_FULL = f"""{EN},{_DENSE},
f AS (SELECT 'T1' AS id, 'high' AS severity FROM (SELECT DISTINCT component FROM comp) UNION ALL SELECT 'T2', 'med' FROM {_T2} UNION ALL SELECT 'T3', 'high' FROM {_T3} UNION ALL SELECT 'T4', 'low' FROM {_T4}
  UNION ALL SELECT 'T5', 'med' FROM depth WHERE depth >= 3 UNION ALL SELECT 'T6', 'med' FROM {_HUBS} UNION ALL SELECT 'T7', 'low' FROM {_T7} UNION ALL SELECT 'T8', 'low' FROM {_ONCE} UNION ALL SELECT 'T9', 'info' FROM {_T9}
  UNION ALL SELECT 'T10', 'info' FROM {_T10} UNION ALL SELECT 'T11', 'info' FROM {_T11} UNION ALL SELECT 'T12', 'info' FROM (SELECT count(*) FILTER (WHERE tag <> 'CODE') AS k, count(*) AS n FROM e) WHERE 5 * k > n)"""
_STEPS = """WITH RECURSIVE
o AS (SELECT o_custkey || ':' || o_orderpriority AS src, lead(o_custkey || ':' || o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders),
c AS (SELECT DISTINCT src, dst FROM o WHERE dst IS NOT NULL AND src <> dst),
r AS (SELECT src, dst FROM c UNION SELECT r.src, c.dst FROM r JOIN c ON c.src = r.dst),
comp AS (SELECT x.src AS id, min(x.dst) AS component FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src)"""

#: What the files of bind.sources() say, from the tables and not from the text.
_FILES = """
na AS (SELECT n_nationkey::VARCHAR AS n, n_regionkey::VARCHAR AS r FROM nation),
su AS (SELECT s_suppkey::VARCHAR AS k, n, r, 'svc-' || n || '/src/supplier' || s_suppkey || '.py' AS path FROM supplier JOIN na ON n = s_nationkey::VARCHAR),
cu AS (SELECT c_custkey::VARCHAR AS k, n, r, (c_custkey % 25)::VARCHAR AS m, (c_custkey % 5)::VARCHAR AS t, 'svc-' || n || '/src/customer' || c_custkey || '.ts' AS path FROM customer JOIN na ON n = c_nationkey::VARCHAR)"""

#: What the files of bind.idioms() say.
_IDIOMS = """
na AS (SELECT n_nationkey::VARCHAR AS n, n_regionkey::VARCHAR AS r, ((n_nationkey + 1) % 25)::VARCHAR AS m, 'svc-' || n_nationkey AS svc, 'svc-' || n_nationkey || '/src/main/resources/application' AS app FROM nation),
cu AS (SELECT c_custkey AS k, (c_custkey % 5)::VARCHAR AS t, na.*, svc || '/src/c' || c_custkey || '.ts' AS path FROM customer JOIN na ON n = c_nationkey::VARCHAR),
su AS (SELECT s_suppkey AS k, (s_suppkey % 5)::VARCHAR AS t, na.*, svc || '/src/S' || s_suppkey || '.java' AS path FROM supplier JOIN na ON n = s_nationkey::VARCHAR)"""

ORACLE_SQL = {
    "idiom_edges": f"""WITH {_IDIOMS}
SELECT svc AS actor, 'http' AS rel, 'svc-' || m AS object, 'ANY /customers/{{id}}/{{id}}' AS label, 'CODE' AS tag, NULL::VARCHAR AS note, 3 * count(*) + 1 AS places FROM cu GROUP BY svc, m
UNION ALL SELECT svc, 'pub', 'shipped.' || r, '-', 'CODE', NULL, count(*) + 1 FROM cu GROUP BY svc, r
UNION ALL SELECT svc, 'pub', 'made.' || r, '-', 'CODE', NULL, 2 * count(*) + 1 FROM su GROUP BY svc, r
UNION ALL SELECT svc, 'sub', 'other.' || n, '-', 'CODE', 'base file; all values: prod.' || n || ' (' || app || '-prod.yml:2), other.' || n || ' (' || app || '.yml:4)', count(*) + 1 FROM su GROUP BY svc, n, app
UNION ALL SELECT svc, 'sub', 'late.' || t, '-', 'CODE', NULL, count(*) FROM su GROUP BY svc, t
UNION ALL SELECT svc, 'sub', 'app.none?', '-', 'INFERENCE', 'confirm: what app.none names', count(*) FROM su GROUP BY svc
UNION ALL SELECT svc, 'pub', 'kept.' || r, 'key=id', 'CODE', NULL, count(*) FROM su GROUP BY svc, r
UNION ALL SELECT svc, 'grpc', 'svc-' || m, 'Level', 'CODE', NULL, 1 FROM na""",
    "idiom_gaps": f"""WITH {_IDIOMS} SELECT svc AS subject, 'unresolved http NONE_' || t || '_URL' AS detail, count(*) AS places FROM cu GROUP BY svc, t
UNION ALL SELECT path, 'read but not declared: NONE_' || t || '_URL', 1 FROM cu""",
    "idiom_rungs": """WITH c AS (SELECT count(*) AS c FROM customer), s AS (SELECT count(*) AS s FROM supplier)
SELECT 'http' AS rel, 3::BIGINT AS rung, c AS hits FROM c UNION ALL SELECT 'http', 7, c FROM c UNION ALL SELECT 'pub', 4, c FROM c UNION ALL SELECT 'pub', 3, s FROM s UNION ALL SELECT 'pub', 1, s FROM s
UNION ALL SELECT 'sub', unnest([2, 3, 6]), s FROM s UNION ALL SELECT 'grpc', 7, count(*) FROM nation""",
    "idiom_receivers": f"WITH {_IDIOMS} SELECT path, 'p' AS name, 'kafka' AS family FROM cu UNION ALL SELECT path, 'template', 'kafka' FROM su",
    "idiom_nodes": "SELECT 'svc-' || n_nationkey AS id, 'svc' AS kind, 'npm' AS tech, 'svc-' || n_nationkey || '/package.json' AS path, 2::BIGINT AS line FROM nation",
    "idiom_hosts": "SELECT 'svc-' || n_nationkey AS host, 'svc-' || n_nationkey AS id, 'svc' AS kind FROM nation",
    "idiom_verified": f"WITH {_IDIOMS} SELECT unnest(['receipt', 'definition']) AS rule, svc AS actor, 'grpc' AS rel, 'svc-' || m AS object, 'Level' AS label FROM na",
    "variable_states": f"WITH {_IDIOMS} SELECT 'PEER' || n || '_URL' AS var, 'unread' AS state FROM na WHERE n NOT IN (SELECT n FROM cu) UNION ALL SELECT DISTINCT 'NONE_' || t || '_URL', 'undeclared' FROM cu",
    "uncovered_ecosystems": "SELECT DISTINCT ['cargo', 'ruby', 'php', 'elixir'][n_regionkey] AS ecosystem FROM nation WHERE n_regionkey BETWEEN 1 AND 4",
    "iac_channels": """SELECT 'infra/p' || p_partkey || '.tf' AS path, 1::BIGINT AS line, ['topic', 'queue', 'queue', 'topic'][p_partkey % 5 + 1] AS kind, ['kafka', 'sqs', 'pubsub', 'servicebus'][p_partkey % 5 + 1] AS tech, 'part-' || p_partkey AS name FROM part WHERE p_partkey % 5 < 4""",
    "config_trees": f"""WITH {_IDIOMS}, x AS (SELECT unnest([('docker-compose.n' || n || '.yml', 3, 'services.' || svc || '.build', 'build', './' || svc), ('docker-compose.n' || n || '.yml', 5, 'services.' || svc || '.environment.PEER' || n || '_URL', 'PEER' || n || '_URL', 'http://svc-' || m || ':8080'),
  (svc || '/package.json', 2, 'name', 'name', '@shop/' || svc), (svc || '/package.json', 3, 'dependencies.kafkajs', 'kafkajs', '2'), (app || '.yml', 3, 'app.topics.made', 'made', 'made.' || r), (app || '.yml', 4, 'app.other', 'other', 'other.' || n), (app || '-prod.yml', 2, 'app.other', 'other', 'prod.' || n)]) AS t FROM na)
SELECT t[1] AS path, t[2]::BIGINT AS line, t[3] AS key, t[4] AS leaf, t[5] AS value FROM x""",
    "route_shapes": """WITH p AS (SELECT p_partkey AS k, p_brand AS b, k = (SELECT max(p_partkey) FROM part) AS is_last FROM part),
q AS (SELECT 'parts/' || k AS path, CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN b LIKE 'Brand#1%' THEN b WHEN b LIKE 'Brand#2%' THEN 'left' WHEN is_last THEN 'last' WHEN k % 2 = 0 THEN 'catalog' END AS service_id, CASE WHEN b LIKE 'Brand#2%' THEN 2 ELSE 1 END AS m FROM p)
SELECT path, method, service_id, CASE WHEN service_id IS NULL THEN 0 ELSE m END::BIGINT AS matches, CASE WHEN service_id IS NOT NULL AND m = 1 THEN 'INFERENCE' ELSE 'GAP' END AS outcome FROM q""",
    "rpc_calls": "SELECT 'Stock' || (n_nationkey + 1) % 25 AS name, 'svc-' || n_nationkey || '/client.go' AS path, 2::BIGINT AS line, unnest(['Level', 'Other']) AS rpc FROM nation",
    "bind_nodes": f"WITH {NODES} SELECT id, kind, tech, kind || '/' || id || ':1' AS receipts FROM n",
    "bind_edges": f"{E} {_VIEW} FROM e",
    "bind_gaps": "SELECT o_orderkey::VARCHAR AS subject, 'priority not specified' AS detail, 'orders/' || o_orderkey || ':1' AS receipts FROM orders WHERE o_orderpriority LIKE '%NOT SPECIFIED'",
    "flow_orient": f"{E} SELECT actor, rel, object, label, CASE rel WHEN 'sub' THEN object ELSE actor END AS src, CASE rel WHEN 'sub' THEN actor ELSE object END AS dst FROM e",
    "dep_orient": f"{E} SELECT actor, rel, object, label, CASE rel WHEN 'pub' THEN object ELSE actor END AS dependent, CASE rel WHEN 'pub' THEN actor ELSE object END AS dependency FROM e",
    "lens_focus": f"""{E}, s AS (SELECT max(actor) AS x FROM e WHERE rel = 'http')
{_VIEW} FROM e, s WHERE actor = x OR object = x OR (rel = 'pub' AND object IN (SELECT object FROM e, s WHERE rel = 'sub' AND actor = x)) OR (rel = 'sub' AND object IN (SELECT object FROM e, s WHERE rel = 'pub' AND actor = x))""",
    "lens_data": f"""{EN}, u AS (SELECT actor, object, kind, label FROM e JOIN n ON n.id = e.object WHERE rel = 'uses' AND kind IN ('db', 'cache', 'store'))
SELECT actor, u.object, kind, label, users, users >= 2 AS shared FROM u JOIN (SELECT object, count(DISTINCT actor) AS users FROM u GROUP BY object) c ON c.object = u.object""",
    "lens_overview": f"{E} {_VIEW} FROM e WHERE rel <> 'dep'",
    "overview_clusters": f"WITH {NODES} SELECT kind AS cluster, count(*) FILTER (WHERE kind <> 'ext') AS members, count(*) FILTER (WHERE kind = 'ext') AS external, count(*) FILTER (WHERE kind = 'ext') || ' external APIs' AS collapsed FROM n GROUP BY kind",
    "lineage_channels": f"""{E}, st AS (SELECT DISTINCT r.object AS f, w.object AS t FROM e r JOIN e w ON r.actor = w.actor AND r.rel = 'sub' AND w.rel = 'pub' WHERE r.object <> w.object),
r AS (SELECT min(object) AS id, 0 AS ring FROM e WHERE rel = 'pub' UNION SELECT st.t, ring + 1 FROM r JOIN st ON st.f = r.id WHERE ring < 4)
SELECT id, min(ring)::BIGINT AS ring FROM r GROUP BY id HAVING min(ring) > 0""",
    "lens_lineage": f"""{E}, st AS (SELECT DISTINCT r.object AS f, w.object AS t FROM e r JOIN e w ON r.actor = w.actor AND r.rel = 'sub' AND w.rel = 'pub' WHERE r.object <> w.object),
s AS (SELECT min(object) AS x FROM e WHERE rel = 'pub'),
r AS (SELECT x AS id, 0 AS ring FROM s UNION SELECT st.t, ring + 1 FROM r JOIN st ON st.f = r.id WHERE ring < 4),
g AS (SELECT id, min(ring) AS ring FROM r GROUP BY id),
rd AS (SELECT DISTINCT actor AS reader, ring + 1 AS nxt FROM e JOIN g ON object = id WHERE rel = 'sub')
{_VIEW} FROM e WHERE rel = 'sub' AND object IN (SELECT id FROM g)
UNION {_VIEW} FROM e, s WHERE rel = 'pub' AND object = x
UNION {_VIEW} FROM e JOIN g ON object = id AND ring > 0 WHERE rel = 'pub' AND EXISTS (SELECT 1 FROM rd WHERE reader = actor AND g.ring <= nxt AND nxt <= 4)
UNION {_VIEW} FROM e WHERE rel IN ('http', 'grpc', 'gql', 'ws') AND actor IN (SELECT reader FROM rd) AND object IN (SELECT actor FROM e, s WHERE rel = 'pub' AND object = x)""",
    "lens_impact": _closure("dependency", "dependent", "max(object)", 3, _IMPACT_EXTRA),
    "lens_deps": _closure("dependent", "dependency", "max(actor)", 3),
    "full_impact": _closure("dependency", "dependent", "max(object)", 3, _IMPACT_EXTRA),
    "impact_reasons": f"""{E},{_SVC}, p AS (SELECT dependency AS f, dependent AS t FROM pairs {_IMPACT_EXTRA}),
r AS (SELECT max(object) AS id, 0 AS ring FROM e WHERE rel = 'http' UNION SELECT p.t, r.ring + 1 FROM r JOIN p ON p.f = r.id WHERE r.ring < 3),
g AS (SELECT id, min(ring) AS ring FROM r GROUP BY id),
why AS (SELECT r.actor AS node, w.actor AS source, 'consumes ' || r.object AS why FROM e r JOIN e w ON r.object = w.object AND r.rel = 'sub' AND w.rel = 'pub'
  UNION SELECT actor, object, 'calls ' || object FROM e WHERE rel NOT IN ('pub', 'sub'))
SELECT a.id AS node, a.ring::BIGINT AS ring, string_agg(DISTINCT why, '; ' ORDER BY why) AS reasons FROM why JOIN g a ON a.id = node JOIN g b ON b.id = source WHERE node <> source AND a.ring > 0 AND b.ring = a.ring - 1 GROUP BY a.id, a.ring""",
    "lens_path": f"""{V}, fl AS (SELECT CASE rel WHEN 'sub' THEN object ELSE actor END AS a, CASE rel WHEN 'sub' THEN actor ELSE object END AS b, bool_or(rel IN ('http', 'grpc', 'gql', 'ws')) AS call FROM e GROUP BY 1, 2 HAVING a <> b),
z AS (SELECT max(object) AS id FROM e WHERE rel = 'uses'),
w AS (SELECT min(actor) AS p, min(actor) AS cur, 0 AS hops, true AS sync FROM e WHERE rel = 'http'
  UNION ALL SELECT p || '/' || b, b, hops + 1, sync AND call FROM w JOIN fl ON a = cur WHERE hops < 6 AND cur <> (SELECT id FROM z) AND instr('/' || p || '/', '/' || b || '/') = 0)
SELECT p AS path, hops::BIGINT AS hops, sync FROM w WHERE cur = (SELECT id FROM z) AND hops > 0""",
    "path_steps": f"""{V}, fl AS (SELECT DISTINCT CASE rel WHEN 'sub' THEN object ELSE actor END AS a, CASE rel WHEN 'sub' THEN actor ELSE object END AS b FROM e WHERE actor <> object),
w AS (SELECT [min(actor)] AS p, 0 AS hops FROM e WHERE rel = 'http' UNION ALL SELECT list_append(p, b), hops + 1 FROM w JOIN fl ON a = p[-1] WHERE hops < 6 AND NOT list_contains(p, b))
SELECT array_to_string(p, '/') AS path, unnest(range(1, len(p) + 1))::BIGINT AS step, unnest(p) AS node FROM w WHERE hops > 0""",
    "lens_diff": f"{_DIFF} SELECT * FROM d",
    "diff_relabelled": f"{_DIFF} SELECT actor, rel, object, old_label, new_label FROM d WHERE change = 'relabelled'",
    "lens_custom_stores": f"{E} {_VIEW} FROM e WHERE object LIKE 'db-%'",
    "view_nodes": f"""{EN}, s AS (SELECT max(actor) AS x FROM e WHERE rel = 'http'),
v AS (SELECT * FROM e, s WHERE actor = x OR object = x OR (rel = 'pub' AND object IN (SELECT object FROM e, s WHERE rel = 'sub' AND actor = x)) OR (rel = 'sub' AND object IN (SELECT object FROM e, s WHERE rel = 'pub' AND actor = x)))
SELECT id, kind, tech FROM n WHERE id IN (SELECT actor FROM v UNION SELECT object FROM v)""",
    "view_stats": f"{E} SELECT (SELECT count(DISTINCT x) FROM (SELECT actor AS x FROM e UNION ALL SELECT object FROM e)) AS nodes, count(*) AS edges, count(*) FILTER (WHERE tag = 'CODE') AS code, count(*) FILTER (WHERE tag <> 'CODE') AS inferred FROM e",
    "consolidate_sightings": f"WITH {ledger()} SELECT actor, rel, object, label, count(*) AS sightings, min(path) AS first_path FROM sight GROUP BY ALL",
    "receipt_rows": f"WITH {ledger()}, k AS (SELECT DISTINCT actor, rel, object, label, path, line FROM sight) SELECT rel, path, count(*) AS receipts FROM k GROUP BY rel, path",
    "fold_labels": f"""WITH {ledger()}, k AS (SELECT *, min(CASE WHEN label <> '-' THEN label END) OVER w AS lo, max(CASE WHEN label <> '-' THEN label END) OVER w AS hi FROM sight WINDOW w AS (PARTITION BY actor, rel, object))
SELECT actor, rel, object, CASE WHEN label = '-' AND lo = hi THEN lo ELSE label END AS label, count(*) AS sightings FROM k GROUP BY ALL""",
    "feign_labels": f"""WITH {ledger()}, k AS (SELECT actor, rel, object, list_sort(list(DISTINCT label)) AS l FROM sight WHERE rel = 'http' GROUP BY ALL)
SELECT actor, rel, object, array_to_string(l[1:3], ', ') AS shown, CASE WHEN len(l) > 3 THEN '+' || (len(l) - 3) || ' more' ELSE '' END AS more FROM k""",
    "full_degree": f"WITH {ledger()}, k AS (SELECT DISTINCT actor, rel, object, label FROM sight) SELECT node, count(*) AS degree FROM (SELECT actor AS node FROM k UNION ALL SELECT object FROM k) GROUP BY node",
    "review_t1": f"""{V},{_CYCLES} SELECT 'T1' AS id, 'high' AS severity, 'sync cycle ' || array_to_string(list_append(p, root), ' → ') AS finding, array_to_string(p, ',') AS participants,
array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || ' sync ' || list_append(p, root)[i + 1]), '; ') AS evidence FROM cyc""",
    "review_t2": _finding("T2", "med", "x || ' reads ' || t || ' and calls its producer ' || p", "x || ',' || p", "x || ' sub ' || t || '; ' || x || ' call ' || p", _T2),
    "review_t3": _finding("T3", "high", "object || ' is used by ' || users", "who", "ev", _T3, EN),
    "review_t4": f"""{E} SELECT 'T4' AS id, 'low' AS severity, o.object || CASE WHEN subs = 0 THEN ' has no consumer' ELSE ' has no producer' END AS finding, string_agg(DISTINCT actor, ',' ORDER BY actor) AS participants,
string_agg(DISTINCT actor || CASE WHEN subs = 0 THEN ' pub ' ELSE ' sub ' END || o.object, '; ' ORDER BY actor || CASE WHEN subs = 0 THEN ' pub ' ELSE ' sub ' END || o.object) AS evidence FROM {_T4} o JOIN e ON e.object = o.object AND rel IN ('pub', 'sub') GROUP BY o.object, subs""",
    "review_t5": f"{V},{_SYNC_PATHS} SELECT 'T5' AS id, 'med' AS severity, 'sync chain of ' || CASE WHEN depth >= 6 THEN '>=6' ELSE depth::VARCHAR END || ' hops from ' || start AS finding, start AS participants, '' AS evidence FROM {_CHAINS}",
    "review_t6": f"{V} SELECT 'T6' AS id, 'med' AS severity, node || ' has degree ' || k AS finding, node AS participants, '' AS evidence FROM {_HUBS}",
    "review_t7": f"WITH {ledger()} SELECT 'T7' AS id, 'low' AS severity, actor || ' makes ' || count(DISTINCT label) || ' different calls to ' || object AS finding, actor || ',' || object AS participants, actor || ' ' || min(rel) || ' ' || object AS evidence FROM sight WHERE rel IN ('http', 'grpc', 'gql', 'ws') GROUP BY actor, object HAVING count(DISTINCT label) >= 4",
    "review_t8": _finding("T8", "low", "actor || ' names ' || object || ' in code'", "actor", "actor || ' ' || rel || ' ' || object", _ONCE),
    "review_t9": _finding("T9", "info", "actor || ' writes ' || object || ' without a key for ' || k || ' consumers'", "actor", "actor || ' pub ' || object", _T9),
    "review_t10": _finding(
        "T10",
        "info",
        "p || ' and ' || c || ' answer each other over ' || t || ' and ' || u",
        "p || ',' || c",
        "p || ' pub ' || t || '; ' || c || ' sub ' || t || '; ' || c || ' pub ' || u || '; ' || p || ' sub ' || u",
        "(SELECT DISTINCT a.actor AS p, b.actor AS c, a.object AS t, x.object AS u FROM e a JOIN e b ON a.object = b.object AND a.rel = 'pub' AND b.rel = 'sub' JOIN e x ON x.actor = b.actor AND x.rel = 'pub' JOIN e y ON y.object = x.object AND y.rel = 'sub' AND y.actor = a.actor WHERE a.actor < b.actor AND a.object <> x.object)",
    ),
    "review_t11": f"""{EN}, d AS (SELECT DISTINCT object AS id FROM e WHERE (rel = 'grpc' OR rel = 'http' AND object NOT IN (SELECT 'svc-' || n_nationkey FROM nation WHERE n_regionkey <> 0)) AND object NOT IN (SELECT id FROM n WHERE kind = 'ext') UNION SELECT id FROM n WHERE kind = 'ref')
SELECT 'T11' AS id, 'info' AS severity, id || ' has no contract in scope' AS finding, id AS participants, '' AS evidence FROM d""",
    "review_t12": f"{E}, h AS (SELECT count(*) FILTER (WHERE tag <> 'CODE') AS k, count(*) AS n FROM e) SELECT 'T12' AS id, 'info' AS severity, k || ' of ' || n || ' edges are not from code' AS finding, '' AS participants, '' AS evidence FROM h WHERE 5 * k > n",
    "review_severities": f"{_ALL} SELECT severity, count(*) AS findings FROM f GROUP BY severity",
    "review_all_severities": f"{_FULL} SELECT id, severity, count(*) AS findings FROM f GROUP BY id, severity",
    "review_all_cycles": f"""{E},{_DENSE}, m AS (SELECT component, list(id ORDER BY id) AS ids FROM comp GROUP BY component),
k AS (SELECT component, min(b) AS x FROM comp JOIN call ON call.a = component AND (b, component) IN (SELECT (a, b) FROM call) GROUP BY component)
SELECT 'T1' AS id, 'high' AS severity, 'sync cycles among ' || len(ids) || ' services, such as ' || component || ' → ' || x || ' → ' || component AS finding, array_to_string(ids, ',') AS participants, component || ' sync ' || x || '; ' || x || ' sync ' || component AS evidence FROM m JOIN k USING (component)""",
    "review_all_chains": f"{E},{_DENSE} SELECT 'T5' AS id, 'med' AS severity, 'sync chain of ' || CASE WHEN depth >= 6 THEN '>=6' ELSE depth::VARCHAR END || ' hops from ' || start AS finding, start AS participants, '' AS evidence FROM depth WHERE depth >= 3",
    "review_all_health": f"""{_FULL} SELECT (SELECT count(*) FROM n WHERE kind = 'svc') AS services, (SELECT count(*) FROM n WHERE kind = 'ref') AS referenced, (SELECT count(*) FROM e) AS edges,
  (SELECT round(100 * count(*) FILTER (WHERE tag = 'CODE') / count(*))::BIGINT FROM e) AS code_percent, (SELECT max(depth)::BIGINT FROM depth) AS sync_depth, count(*) FILTER (WHERE id = 'T1') AS cycles, count(*) FILTER (WHERE id = 'T3') AS shared_stores,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'med') AS med, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info FROM f""",
    "sync_components": f"{_STEPS} SELECT id, component FROM comp",
    "condensed_chains": f"""{_STEPS}, d AS (SELECT DISTINCT coalesce(x.component, src) AS a, coalesce(y.component, dst) AS b FROM c LEFT JOIN comp x ON x.id = src LEFT JOIN comp y ON y.id = dst WHERE coalesce(x.component, src) <> coalesce(y.component, dst)),
w AS (SELECT a AS id, b AS at, 1 AS h FROM d UNION SELECT w.id, d.b, h + 1 FROM w JOIN d ON d.a = w.at)
SELECT id, max(h)::BIGINT AS depth FROM (SELECT id, h FROM w UNION ALL SELECT b, 0 FROM d) GROUP BY id""",
    "chain_depths": f"""{_STEPS}, w AS (SELECT src AS start, [src, dst] AS p, dst AS at, 1 AS h FROM c UNION ALL SELECT start, list_append(p, c.dst), c.dst, h + 1 FROM w JOIN c ON c.src = w.at WHERE h < 4 AND NOT list_contains(p, c.dst))
SELECT start, max(h)::BIGINT AS depth FROM w GROUP BY start""",
    "review_warned": f"{EN} SELECT x AS id FROM {_T2} UNION SELECT p FROM {_T2} UNION SELECT actor FROM e WHERE rel = 'uses' AND object IN (SELECT object FROM {_T3})",
    "review_inferred": f"""{E} SELECT 'T9' AS id, actor || ' writes ' || object || ' without a key for ' || k || ' consumers' AS finding, object LIKE 'Brand#1%' AS inferred FROM {_T9}
UNION ALL SELECT DISTINCT 'T8', actor || ' names ' || object || ' in code', false FROM {_ONCE} GROUP BY actor, rel, object""",
    "review_health": f"""{_ALL} SELECT (SELECT count(*) FROM n WHERE kind = 'svc') AS services, (SELECT count(*) FROM n WHERE kind = 'ref') AS referenced, (SELECT count(*) FROM e) AS edges,
  (SELECT round(100 * count(*) FILTER (WHERE tag = 'CODE') / count(*))::BIGINT FROM e) AS code_percent, (SELECT max(hops)::BIGINT FROM w) AS sync_depth, count(*) FILTER (WHERE id = 'T1') AS cycles, count(*) FILTER (WHERE id = 'T3') AS shared_stores,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'med') AS med, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info FROM f""",
    "review_to_be": f"""{E}, g AS (SELECT DISTINCT actor, rel, object FROM e WHERE rel = 'pub' AND object LIKE 'returns.%')
SELECT actor, rel, object, label, tag FROM e WHERE (actor, rel, object) NOT IN (SELECT (actor, rel, object) FROM g) UNION ALL SELECT actor, rel, substr(object, 9), NULL, NULL FROM g""",
    "check_dangling": f"{EN} SELECT actor, rel, object, label, m AS missing FROM (SELECT actor, rel, object, label, unnest([actor, object]) AS m FROM e) WHERE m NOT IN (SELECT id FROM n WHERE kind <> 'ext')",
    "check_dup_nodes": "SELECT 'CHK-5' AS check_id, 'node again: db-' || replace(r_name, ' ', '-') AS message FROM region",
    "check_missing_note": f"{E} SELECT 'CHK-7' AS check_id, 'no note on INFERENCE edge' AS message, count(*) AS n FROM e WHERE object = 'ref-BUILDING' HAVING count(*) > 0",
    "check_duplicate_keys": f"{E} SELECT actor, rel, object, label, 2::BIGINT AS n FROM e WHERE rel = 'uses'",
    "check_sorted": f"""WITH {NODES}, l AS (SELECT 'N ' || id || ' ' || kind || ' ' || tech || ' | ' || kind || '/' || id || ':1' AS v FROM n), k AS (SELECT v, row_number() OVER (ORDER BY reverse(v), v) AS line_no FROM l)
SELECT 'CHK-3' AS check_id, line_no FROM (SELECT line_no, v, lag(v) OVER (ORDER BY line_no) AS b FROM k) WHERE b >= v""",
    "check_receipt_range": f"""{E}, k AS (SELECT 'orders/' || l_orderkey AS path, max(l_linenumber) AS n_lines FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
SELECT check_id, message, count(*) AS n FROM (
  SELECT 'CHK-10' AS check_id, 'no file ' || path AS message FROM perfile WHERE path NOT IN (SELECT path FROM k)
  UNION ALL SELECT 'CHK-11', s.path || ' has no line ' || line FROM (SELECT DISTINCT actor, rel, object, label, path, line FROM sight) s JOIN k ON k.path = s.path WHERE line < 1 OR line > n_lines) GROUP BY ALL""",
    "check_outside_ledger": f"WITH {_SNAPSHOTS} FROM e_n EXCEPT FROM e_o",
    "refresh_invalidate": f"{E} {_VIEW} FROM e WHERE split_part(receipts, ':', 1) NOT IN (SELECT 'orders/' || o_orderkey FROM orders WHERE o_orderstatus = 'O')",
    "refresh_merge": f"""WITH {_SNAPSHOTS}, both_ AS (FROM was UNION ALL FROM now),
per AS (SELECT actor, rel, object, label, min(tag) AS tag, path, path || ':' || string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR) AS item FROM both_ GROUP BY actor, rel, object, label, path)
SELECT actor, rel, object, label, min(tag) AS tag, string_agg(item, '; ' ORDER BY path) AS receipts FROM per GROUP BY actor, rel, object, label""",
    "refresh_changed_files": "SELECT 'documents/' || doc_id AS path FROM documents WHERE length(CASE WHEN length(text) % 7 = 0 THEN text || '!' ELSE text END) % 11 = 0 OR length(text) % 7 = 0",
    "refresh_dep_subsumed": f"""{E}, h AS (SELECT least(actor, object) AS lo, greatest(actor, object) AS hi FROM e WHERE rel = 'http'), d AS (SELECT DISTINCT actor, object FROM e WHERE rel IN ('http', 'grpc'))
SELECT 'http' AS rel, count(*) AS edges FROM h UNION ALL SELECT 'dep', count(*) FROM d WHERE (least(actor, object), greatest(actor, object)) NOT IN (SELECT (lo, hi) FROM h) HAVING count(*) > 0""",
    "sweep_hits": f"""WITH {_LINES} SELECT family, count(*) AS hits, count(DISTINCT path) AS files FROM (
  SELECT 'link' AS family, path FROM lines WHERE text LIKE '%href="%' UNION ALL SELECT 'markup', path FROM lines WHERE text LIKE '%<script%' OR text LIKE '%<style%'
  UNION ALL SELECT 'license', path FROM lines WHERE regexp_matches(text, '(?i)licen[sc]e') UNION ALL SELECT 'entity', path FROM lines WHERE text LIKE '%&amp;%') GROUP BY family""",
    "echo_hits": f"WITH {_LINES}, h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS name FROM pages), k AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._-]*')) AS name FROM lines) SELECT h.name, path, line::BIGINT AS line FROM k JOIN h ON h.name = k.name",
    "host_extract": "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^(https?):', 1) AS scheme, regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g') AS slug FROM pages",
    "link_targets": """SELECT href, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""",
    "owner_deepest_prefix": """WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://|[?].*$', '', 'g') AS path FROM pages), r AS (SELECT array_to_string(string_split(path, '/')[1:2], '/') AS root FROM p UNION SELECT string_split(path, '/')[1] FROM p)
SELECT path, max_by(root, length(root)) AS service_id FROM p LEFT JOIN r ON starts_with(path, root || '/') GROUP BY path""",
    "mermaid_ids": f"""WITH {NODES}, k AS (SELECT id, kind, {_MID} AS m FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY id) AS i FROM k)
SELECT id, CASE WHEN i = 1 THEN m ELSE m || '_' || i END AS mid, CASE kind WHEN 'queue' THEN 'topic' WHEN 'store' THEN 'db' ELSE kind END AS class FROM r""",
    "mermaid_edges": f"""{EN}, k AS (SELECT id, kind, {_MID} AS m FROM n), r AS (SELECT id, CASE WHEN row_number() OVER (PARTITION BY m ORDER BY id) = 1 THEN m ELSE m || '_' || row_number() OVER (PARTITION BY m ORDER BY id) END AS mid FROM k),
f AS (SELECT CASE rel WHEN 'sub' THEN object ELSE actor END AS a, CASE rel WHEN 'sub' THEN actor ELSE object END AS b, tag, rel || CASE WHEN label = '-' THEN '' ELSE ' ' || label END AS l FROM e)
SELECT '  ' || x.mid || CASE tag WHEN 'CODE' THEN ' -->' ELSE ' -.->' END || '|"' || {_ELIDE.format('l')} || '"| ' || y.mid AS line FROM f JOIN r x ON x.id = a JOIN r y ON y.id = b""",
    "drawio_geometry": f"""{V}, es AS (SELECT actor AS a, object AS b, row_number() OVER (ORDER BY rel IN ('http', 'grpc', 'gql', 'ws'), actor, rel, object, label) AS i FROM e WHERE actor <> object),
fold AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS reach, []::VARCHAR[] AS took
  UNION ALL SELECT es.i, CASE WHEN list_contains(reach, es.b || '>' || es.a) THEN reach ELSE list_distinct(list_concat(reach, flatten([[x || '>' || y
      for y in list_concat([es.b], [split_part(r, '>', 2) for r in reach if split_part(r, '>', 1) = es.b])] for x in list_concat([es.a], [split_part(r, '>', 1) for r in reach if split_part(r, '>', 2) = es.a])]))) END,
    CASE WHEN list_contains(reach, es.b || '>' || es.a) THEN took ELSE list_append(took, es.a || '>' || es.b) END FROM fold JOIN es ON es.i = fold.i + 1),
k AS (SELECT DISTINCT split_part(t, '>', 1) AS a, split_part(t, '>', 2) AS b FROM (SELECT unnest(took) AS t FROM (SELECT took FROM fold ORDER BY i DESC LIMIT 1))),
walk AS (SELECT id, 0 AS rank FROM n UNION SELECT k.b, rank + 1 FROM walk JOIN k ON k.a = walk.id),
rk AS (SELECT id, max(rank) AS rank FROM walk GROUP BY id),
place AS (SELECT 0 AS rank, list(struct_pack(id := id, row := r)) AS rows FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM rk WHERE rank = 0)
  UNION ALL SELECT p.rank + 1, list_concat(p.rows, (SELECT list(struct_pack(id := id, row := r)) FROM (SELECT m.id, row_number() OVER (ORDER BY avg(u.x.row), m.id) - 1 AS r FROM rk m JOIN k ON k.b = m.id JOIN (SELECT unnest(p.rows) AS x) u ON u.x.id = k.a WHERE m.rank = p.rank + 1 GROUP BY m.id)))
  FROM place p WHERE p.rank < (SELECT max(rank) FROM rk)),
pos AS (SELECT x.id AS id, x.row AS row FROM (SELECT unnest(rows) AS x FROM (SELECT rows FROM place ORDER BY rank DESC LIMIT 1))),
g AS (SELECT n.id, kind, rank, row, CASE kind WHEN 'svc' THEN 160 WHEN 'topic' THEN 140 ELSE 120 END AS w, CASE kind WHEN 'db' THEN 80 ELSE 60 END AS h FROM n JOIN rk ON rk.id = n.id JOIN pos ON pos.id = n.id)
SELECT id, rank::BIGINT AS rank, row::BIGINT AS row, (40 + rank * 240 + (160 - w) // 2)::BIGINT AS x, (40 + row * 140)::BIGINT AS y, w::BIGINT AS width, h::BIGINT AS height FROM g""",
    "label_elide": f"""SELECT page_id, {_ELIDE.format('url')} AS label, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '&lt;br&gt;') AS xml FROM pages""",
    "ledger_text": f"""{EN} SELECT 0::BIGINT AS block, 'N ' || id || ' ' || kind || ' ' || tech || ' | ' || kind || '/' || id || ':1' AS line FROM n
UNION ALL SELECT 1, 'E ' || actor || ' ' || rel || ' ' || object || ' | ' || label || ' | ' || tag || ' | ' || receipts || CASE WHEN rel = 'grpc' THEN ' | confirm: contract of ' || substr(object, 5) ELSE '' END FROM e
UNION ALL SELECT 2, 'G ' || o_orderkey || ' | priority not specified | orders/' || o_orderkey || ':1' FROM orders WHERE o_orderpriority LIKE '%NOT SPECIFIED'""",
    "key_spellings": """WITH k AS (SELECT p_partkey, 'partType.' || regexp_replace(p_type, '[^A-Za-z]', '', 'g') AS k FROM part), s AS (SELECT *, lower(regexp_replace(k, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS sn FROM k)
SELECT p_partkey, k || ',' || upper(regexp_replace(sn, '[^A-Za-z0-9]+', '_', 'g')) || ',' || regexp_replace(sn, '[^A-Za-z0-9]+', '.', 'g') || ',' || string_split(k, '.')[2] || ',' || sn AS keys FROM s""",
    "token_budget": "SELECT source, sum(octet_length(encode(text)) // 4)::BIGINT AS tokens, sum(octet_length(encode(text)) // 4) > 20000 AS over FROM documents GROUP BY source",
    "after_context": f"WITH {_LINES}, k AS (SELECT path, max(line) AS n FROM lines GROUP BY path) SELECT l.path, l.line::BIGINT AS line, least(2, n - l.line)::BIGINT AS following FROM lines l JOIN k ON k.path = l.path WHERE l.path LIKE 'documents/%' AND text LIKE '%|%'",
    "stream_refresh": """SELECT 'user-' || user_id % 10 AS actor, 'pub' AS rel, event_type AS object, count(DISTINCT strftime(ts, '%Y-%m-%d %H'))::BIGINT AS places FROM events GROUP BY ALL""",
    "extract_edges": f"""WITH {_FILES}, f AS (
  SELECT 'svc-' || n AS actor, 'pub' AS rel, 'restock.' || r AS object, 'key=part' AS label, 'CODE' AS tag, path FROM su, range(2)
  UNION ALL SELECT 'svc-' || n, 'http', 'svc-' || r, 'GET /stock/{{id}}', 'CODE', path FROM su WHERE n <> r
  UNION ALL SELECT 'svc-' || n, 'http', 'api.bank' || n || '.com', 'POST /v1/pay', 'CODE', path FROM su
  UNION ALL SELECT 'svc-' || n, 'uses', 'db-' || r, 'sql', 'CODE', path FROM su
  UNION ALL SELECT 'svc-' || n, 'sub', 'restock.' || t, 'group=shop', 'CODE', path FROM cu
  UNION ALL SELECT 'svc-' || n, 'grpc', 'svc-' || m, '-', 'CODE', path FROM cu WHERE n <> m
  UNION ALL SELECT 'svc-' || n, 'http', 'svc-' || m, 'ANY /n' || m || '/customers/{{id}}', 'INFERENCE', unnest([path, 'svc-' || m || '/server.go']) FROM cu WHERE n <> m
  UNION ALL SELECT 'svc-' || n, 'http', 'stripe', '-', 'CODE', path FROM cu
  UNION ALL SELECT 'svc-' || n, 'pub', 'audit.' || r, '-', 'CODE', 'svc-' || n || '/src/main/resources/application.properties' FROM na
  UNION ALL SELECT 'prices-' || r_regionkey, 'pub', 'work-' || r_regionkey, '-', 'CODE', 'infra/region' || r_regionkey || '.tf' FROM region)
SELECT actor, rel, object, label, tag, count(*) AS sightings, min(path) AS first_path FROM f GROUP BY actor, rel, object, label, tag""",
    "extract_gaps": f"""WITH {_FILES} SELECT 'svc-' || n AS subject, 'no single route /none/{{id}}' AS detail, count(*) AS places FROM cu GROUP BY n
UNION ALL SELECT 'svc-' || n, 'unresolved pub topicOf', count(*) FROM cu GROUP BY n""",
    "sweep_families": """WITH c AS (SELECT count(*) AS c FROM customer), s AS (SELECT count(*) AS s FROM supplier)
SELECT 'kafka' AS family, 'pub' AS rel, c + s AS hits, c + s AS files FROM c, s UNION ALL SELECT 'kafka', 'sub', c, c FROM c UNION ALL SELECT 'http', 'http', 3 * s + 2 * c, s + c FROM c, s
UNION ALL SELECT 'grpc', 'grpc', c, c FROM c UNION ALL SELECT 'store', 'uses', s, s FROM s""",
    "gate_families": "SELECT unnest(['kafka', 'http', 'graphql', 'websocket', 'grpc', 'store']) AS family",
    "ladder_rungs": """WITH c AS (SELECT count(*) AS c FROM customer), s AS (SELECT count(*) AS s FROM supplier)
SELECT 'pub' AS rel, 2::BIGINT AS rung, s AS hits FROM s UNION ALL SELECT 'pub', 7, c FROM c UNION ALL SELECT 'sub', 1, c FROM c UNION ALL SELECT 'http', 1, 3 * s + 2 * c FROM c, s
UNION ALL SELECT 'grpc', 6 + 1, c FROM c UNION ALL SELECT 'uses', 1, s FROM s""",
    "service_names": "SELECT 'svc-' || n_nationkey AS service_id, 'svc-' || n_nationkey AS root_path, 'go' AS tech, 'svc-' || n_nationkey || '/go.mod' AS path, 1::BIGINT AS line FROM nation",
    "grpc_owner_tag": """WITH s AS (SELECT DISTINCT c_custkey % 30 AS k FROM customer)
SELECT 'Nation' || k AS name, CASE WHEN n_regionkey <= 3 THEN 'svc-' || k ELSE 'Nation' || k END AS object, CASE WHEN n_regionkey <= 3 THEN 'svc' ELSE 'ref' END AS kind, CASE WHEN n_regionkey < 3 THEN 'CODE' ELSE 'INFERENCE' END AS tag FROM s LEFT JOIN nation ON n_nationkey = k""",
    "route_match": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/[0-9]+(/|$)', '/{id}\\1', 'g') AS template FROM pages),
h AS (SELECT DISTINCT host, template FROM p), k AS (SELECT template, count(*) AS n FROM h GROUP BY template)
SELECT 'pages/' || page_id AS path, p.template, h.host AS service_id, n AS matches, CASE WHEN n = 1 THEN 'INFERENCE' ELSE 'GAP' END AS outcome FROM p JOIN h ON h.template = p.template JOIN k ON k.template = p.template""",
    "yaml_sections": """WITH f AS (SELECT 'deploy/' || n_nationkey || '/compose.yml' AS path, n_nationkey AS n, n_regionkey AS r FROM nation)
SELECT path, 'services' AS section, NULL AS entry, 1::BIGINT AS lines, NULL AS image, NULL::BIGINT AS variables FROM f
UNION ALL SELECT path, 'services', 'svc-' || n, 4, 'postgres:1' || r, 1 FROM f UNION ALL SELECT path, 'services', 'cache-' || n, 2, 'redis:7', 0 FROM f
UNION ALL SELECT path, 'volumes', NULL, 1, NULL, NULL FROM f UNION ALL SELECT path, 'volumes', 'data', 1, NULL, NULL FROM f""",
    "source_manifests": "SELECT 'svc-' || n_nationkey || '/go.mod' AS path, 'go' AS ecosystem FROM nation UNION ALL SELECT 'svc-' || n_nationkey || '/src/main/resources/application.properties', 'spring' FROM nation",
    "source_line_counts": f"""WITH {_FILES} SELECT path, 7::BIGINT AS n_lines FROM su UNION ALL SELECT path, 7 FROM cu UNION ALL SELECT 'infra/region' || r_regionkey || '.tf', 4 FROM region
UNION ALL SELECT 'svc-' || n || '/' || f, k FROM na, (VALUES ('go.mod', 3), ('server.go', 6), ('src/main/resources/application.properties', 1)) x(f, k)""",
    "source_routes": f"WITH {_FILES} SELECT 'svc-' || n || '/server.go' AS path, 5::BIGINT AS line, 'GET' AS method, '/n' || n || '/customers/{{id}}' AS template FROM na",
    "source_symbols": f"WITH {_FILES} SELECT path, 2::BIGINT AS line, 'TOPIC' AS key, 'restock.' || r AS value FROM su",
    "source_config": f"""WITH {_FILES} SELECT 'svc-' || n || '/src/main/resources/application.properties' AS path, 1::BIGINT AS line, 'spring.cloud.stream.bindings.audit-out-0.destination' AS key, 'audit.' || r AS value FROM na
UNION ALL SELECT 'infra/region' || r_regionkey || '.tf', unnest([2, 3]), unnest(['topic_arn', 'endpoint']), unnest(['aws_sns_topic.prices-' || r_regionkey || '.arn', 'aws_sqs_queue.work-' || r_regionkey || '.arn']) FROM region""",
    "source_owners": f"""WITH {_FILES}, p AS (SELECT path, 'svc-' || n AS s FROM su UNION ALL SELECT path, 'svc-' || n FROM cu UNION ALL SELECT 'svc-' || n || '/' || f, 'svc-' || n FROM na, (VALUES ('go.mod'), ('server.go'), ('src/main/resources/application.properties')) x(f) UNION ALL SELECT 'infra/region' || r_regionkey || '.tf', NULL FROM region)
SELECT path, s AS service_id, s AS root FROM p""",
    "source_bindings": f"WITH {_FILES} SELECT 'svc-' || n || '/src/main/resources/application.properties' AS path, 1::BIGINT AS line, 'pub' AS rel, 'audit.' || r AS channel FROM na",
    "source_subscriptions": "SELECT 'prices-' || r_regionkey AS topic, 'work-' || r_regionkey AS queue, 'infra/region' || r_regionkey || '.tf' AS path, 1::BIGINT AS line FROM region",
    "source_registrations": "SELECT 'Nation' || n_nationkey AS name, 'svc-' || n_nationkey || '/server.go' AS path, 4::BIGINT AS line FROM nation",
    "source_vendors": f"WITH {_FILES} SELECT 'stripe' AS vendor, path, 7::BIGINT AS line FROM cu",
    "source_window": f"""WITH {_FILES} SELECT path, 2::BIGINT AS hit, unnest(range(1, 5))::BIGINT AS line, unnest(['import {{ Kafka }} from "kafkajs";', 'await consumer.subscribe({{ topic: "restock.' || t || '", groupId: "shop" }});', 'const c = new Nation' || m || 'Client(addr, grpc.credentials.createInsecure());', 'await fetch("/n' || m || '/customers/' || k || '");']) AS text FROM cu""",
    "source_receipts": f"""WITH {_FILES}, f AS (
  SELECT 'svc-' || n AS actor, 'pub' AS rel, 'restock.' || r AS object, 'key=part' AS label, path, path || ':2,3' AS item FROM su
  UNION ALL SELECT 'svc-' || n, 'uses', 'db-' || r, 'sql', path, path || ':6' FROM su
  UNION ALL SELECT 'svc-' || n, 'pub', 'audit.' || r, '-', 'svc-' || n || '/src', 'svc-' || n || '/src/main/resources/application.properties:1' FROM na
  UNION ALL SELECT 'prices-' || r_regionkey, 'pub', 'work-' || r_regionkey, '-', 'infra', 'infra/region' || r_regionkey || '.tf:1' FROM region)
SELECT actor, rel, object, label, 'CODE' AS tag, string_agg(item, '; ' ORDER BY path) AS receipts FROM f GROUP BY actor, rel, object, label""",
    "image_kinds": "SELECT p_partkey, [ 'db', 'cache', 'store', NULL, NULL, 'db'][p_partkey % 6 + 1] AS kind, p_partkey % 6 = 3 AS broker FROM part",
    "channel_names": r"""WITH k AS (SELECT p_brand AS name FROM part UNION SELECT replace(p_type, ' ', '.') FROM part UNION SELECT p_partkey::VARCHAR FROM part)
SELECT name, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]*') AND NOT regexp_full_match(name, '[0-9]+') AS valid, string_split(name, '.')[-1] AS last FROM k""",
    "edge_sentences": f"{E} SELECT actor, rel, object, label, CASE WHEN tag = 'CODE' THEN actor || ' ' || rel || ' ' || object ELSE actor || ' appears to ' || rel || ' ' || object || ' (unconfirmed: confirm: contract of ' || substr(object, 5) || ')' END AS sentence FROM e",
    "edge_captions": f"{E} SELECT actor, rel, object, label, actor || CASE WHEN tag = 'CODE' THEN ' → ' ELSE ' ⇢ ' END || object || CASE WHEN label = '-' THEN '' ELSE ' · ' || label END AS caption FROM e",
    "stats_line": f"{E} SELECT (SELECT count(DISTINCT x) FROM (SELECT actor AS x FROM e UNION ALL SELECT object FROM e)) || ' nodes · ' || count(*) || ' edges (' || count(*) FILTER (WHERE tag = 'CODE') || ' CODE / ' || count(*) FILTER (WHERE tag <> 'CODE') || ' inferred)' AS line FROM e",
    "health_line": f"""{_ALL} SELECT (SELECT count(*) FROM n WHERE kind = 'svc') || ' services (+0 referenced) · ' || (SELECT count(*) FROM e) || ' edges (100% CODE) · sync depth ' || (SELECT max(hops) FROM w) || ' · cycles ' || count(*) FILTER (WHERE id = 'T1') || ' · shared stores ' || count(*) FILTER (WHERE id = 'T3')
|| ' · ' || count(*) FILTER (WHERE severity = 'high') || ' high / ' || count(*) FILTER (WHERE severity = 'med') || ' med / ' || count(*) FILTER (WHERE severity = 'low') || ' low / ' || count(*) FILTER (WHERE severity = 'info') || ' info' AS line FROM f""",
    "check_summary": f"{EN} SELECT 'ok: ' || (SELECT count(*) FROM n) || ' nodes, ' || (SELECT count(*) FROM e) || ' edges, ' || (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '%NOT SPECIFIED') || ' gaps' AS line",
    "silent_nodes": "SELECT 'svc-purchase' AS id, 'no edges' AS warning UNION ALL SELECT 'purchase.seen', 'no producer'",
    "reachable_pairs": f"""{V}, c AS (SELECT DISTINCT actor AS a, object AS b FROM e WHERE rel = 'http'), r AS (SELECT a, b, 1 AS h FROM c UNION SELECT r.a, c.b, h + 1 FROM r JOIN c ON c.a = r.b WHERE h < 3) SELECT DISTINCT a, b FROM r""",
    "with_assertions": f"{E} SELECT rel, tag, count(*) AS edges FROM (SELECT rel, tag FROM e UNION ALL SELECT 'uses', 'UNVERIFIED' FROM region) GROUP BY rel, tag",
    "shard_footers": f"""WITH {_FILES}, s AS (SELECT n, count(*) AS k FROM su GROUP BY n), c AS (SELECT n, count(*) AS k FROM cu GROUP BY n),
sx AS (SELECT n, sum(1 + 2 + (n <> r)::INT + 1) AS code FROM su GROUP BY n), cx AS (SELECT n, sum(2 + (n <> m)::INT) AS code FROM cu GROUP BY n), ix AS (SELECT n, count(*) AS inf FROM cu WHERE n <> m GROUP BY n),
rx AS (SELECT m AS n, count(*) AS inf FROM cu WHERE n <> m GROUP BY m)
SELECT 'svc-' || na.n AS shard, coalesce(5 * s.k, 0) + coalesce(5 * c.k, 0) AS hits, (1 + coalesce(sx.code, 0) + coalesce(cx.code, 0))::BIGINT AS code, (coalesce(ix.inf, 0) + coalesce(rx.inf, 0))::BIGINT AS inferred, 2 * coalesce(c.k, 0) AS gaps
FROM na LEFT JOIN s USING (n) LEFT JOIN c USING (n) LEFT JOIN sx USING (n) LEFT JOIN cx USING (n) LEFT JOIN ix USING (n) LEFT JOIN rx USING (n)
UNION ALL SELECT 'infra', 0, (SELECT count(*) FROM region), 0, 0""",
    "ledger_round_trip": f"""WITH {ledger()}, k AS (SELECT DISTINCT actor, rel, object, label, tag, path, line FROM sight)
SELECT actor, rel, object, label, tag, CASE WHEN rel = 'grpc' THEN 'confirm: contract of ' || substr(object, 5) END AS note, count(*)::BIGINT AS places FROM k GROUP BY actor, rel, object, label, tag""",
    "gap_round_trip": "SELECT o_orderkey::VARCHAR AS subject, 'priority not specified' AS detail, 'orders/' || o_orderkey || ':1' AS receipts FROM orders WHERE o_orderpriority LIKE '%NOT SPECIFIED'",
    "node_round_trip": f"WITH {NODES} SELECT id, kind, tech, kind || '/' || id || ':1' AS receipts FROM n",
    "refresh_sweep": f"""{E}, o AS (SELECT 'orders/' || o_orderkey AS path FROM orders WHERE o_orderstatus = 'O'),
k AS (SELECT actor, rel, object, label FROM e WHERE split_part(receipts, ':', 1) NOT IN (SELECT path FROM o) UNION SELECT actor, rel, object, label FROM sight WHERE path IN (SELECT path FROM o) AND object NOT LIKE 'returns.%')
SELECT rel, count(*) AS edges FROM k GROUP BY rel""",
}
