"""The queries of the catalogue as SQL for DuckDB."""

from __future__ import annotations

NODES = """nodes(path, size_bytes, package) AS (
  SELECT 'region/' || r_regionkey, 1::BIGINT, NULL::VARCHAR FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 10, NULL FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, floor(abs(c_acctbal))::BIGINT, NULL FROM customer
  UNION ALL SELECT 'orders/' || o_orderkey, floor(o_totalprice)::BIGINT, NULL FROM orders
  UNION ALL SELECT 'part/' || p_partkey, p_size::BIGINT, p_brand FROM part
  UNION ALL SELECT 'supplier/' || s_suppkey, floor(abs(s_acctbal))::BIGINT, 'nation-' || s_nationkey FROM supplier)"""
EDGES = """edges(src, dst, kind) AS (
  SELECT 'region/' || n_regionkey, 'nation/' || n_nationkey, 'static' FROM nation
  UNION SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 'static' FROM customer
  UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'static' FROM supplier
  UNION SELECT 'customer/' || o_custkey, 'orders/' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'static' WHEN 'O' THEN 'dynamic' ELSE 'type_only' END FROM orders
  UNION SELECT 'orders/' || l_orderkey, 'part/' || l_partkey, CASE l_returnflag WHEN 'R' THEN 'dynamic' ELSE 'static' END FROM lineitem
  UNION SELECT 'part/' || l_partkey, 'supplier/' || l_suppkey, 'static' FROM lineitem WHERE l_linenumber = 1)"""
GRAPH = f"WITH RECURSIVE {NODES}, {EDGES}"


def _reach(name: str, entry: str, where: str, edges: str = "edges") -> str:
    return f"{name}(node) AS (SELECT '{entry}' UNION SELECT dst FROM {name} JOIN {edges} ON src = node WHERE {where})"


STATIC, BOTH = "kind = 'static'", "kind <> 'type_only'"


def _closures(entry: str, s: str = "s", d: str = "d", edges: str = "edges") -> str:
    return f"{_reach(s, entry, STATIC, edges)}, {_reach(s + 'all', entry, BOTH, edges)}, {d}(node) AS (SELECT node FROM {s}all EXCEPT SELECT node FROM {s})"


def _weight(of: str, weight: str, count: str) -> str:
    return f"SELECT coalesce(sum(size_bytes), 0)::BIGINT AS {weight}, count(*) AS {count} FROM {of} JOIN nodes ON path = node"


def _packages(of: str) -> str:
    return f"SELECT package AS name, sum(size_bytes)::BIGINT AS total_size_bytes, count(*) AS file_count FROM {of} JOIN nodes ON path = node WHERE package IS NOT NULL GROUP BY package"


T = f"{GRAPH}, {_closures('region/0')}"

SIDES = f", pa AS ({_packages('s')}), pb AS ({_packages('t')}), qa AS ({_packages('d')}), qb AS ({_packages('e')})"
TWO = f"{T}, {_closures('region/1', 't', 'e')}{SIDES}"
WITHOUT = f"""{GRAPH}, ea AS (SELECT * FROM edges WHERE dst NOT IN (SELECT path FROM nodes WHERE package IN ('nation-3', 'nation-4'))),
eb AS (SELECT * FROM edges WHERE dst NOT IN (SELECT path FROM nodes WHERE package IN ('Brand#1', 'Brand#2'))), {_closures('region/0', edges='ea')}, {_closures('region/0', 't', 'e', 'eb')}{SIDES}"""


#: Rounds of the fixpoint of dominators that the SQL unrolls. The tests check that the last one changes nothing.
ROUNDS = 14


def _dominated(where: str, reached: str) -> str:
    """dom(node, x): each reached node's dominators, as the ancestors in a breadth-first tree less what some predecessor lacks, round by round."""
    out = f"""links AS (SELECT DISTINCT src, dst FROM edges WHERE {where} AND src IN (SELECT node FROM {reached}) AND dst <> 'region/0' AND src <> dst),
hops(node, depth) AS (SELECT 'region/0', 0 UNION SELECT dst, depth + 1 FROM hops JOIN links ON src = node WHERE depth < 40),
lvl AS (SELECT node, min(depth) AS depth FROM hops GROUP BY node),
par AS (SELECT dst AS node, min(src) AS parent FROM links JOIN lvl a ON a.node = src JOIN lvl b ON b.node = dst WHERE b.depth = a.depth + 1 GROUP BY dst),
up(node, x) AS (SELECT node, node FROM lvl UNION SELECT up.node, parent FROM up JOIN par ON par.node = x),
inn AS (SELECT dst, count(*) AS n FROM links GROUP BY dst), d0 AS MATERIALIZED (SELECT * FROM up)"""
    for k in range(1, ROUNDS + 1):
        out += f""",
d{k} AS MATERIALIZED (SELECT c.dst AS node, x FROM (SELECT links.dst, x, count(*) AS k FROM links JOIN d{k - 1} ON d{k - 1}.node = src GROUP BY links.dst, x) c JOIN inn ON inn.dst = c.dst WHERE k = n AND c.dst <> x UNION ALL SELECT node, node FROM lvl)"""
    return out + f""",
weights AS (SELECT x AS path, sum(size_bytes)::BIGINT AS exclusive_size_bytes FROM d{ROUNDS} JOIN nodes ON path = node GROUP BY x)"""


DEPTH = f"""depths(node, depth) AS (SELECT 'region/0', 0 UNION SELECT dst, depth + 1 FROM depths JOIN edges ON src = node WHERE {STATIC} AND depth < 25),
depth(node, depth) AS (SELECT node, min(depth) FROM depths GROUP BY node)"""


def _steps(hits: str) -> str:
    """Edges between levels up to the first level with a target."""
    return f"""hit(node) AS ({hits}),
open(src, dst) AS (SELECT src, dst FROM edges WHERE {STATIC} AND src NOT IN (SELECT node FROM hit)),
walk(node, depth) AS (SELECT 'region/0', 0 UNION SELECT dst, depth + 1 FROM walk JOIN open ON src = node WHERE depth < 25),
level(node, depth) AS (SELECT node, min(depth) FROM walk GROUP BY node),
goal(depth) AS (SELECT min(depth) FROM level JOIN hit USING (node)),
steps AS (SELECT src, dst, b.depth FROM open JOIN level a ON a.node = src JOIN level b ON b.node = dst WHERE b.depth = a.depth + 1)"""


PART = "SELECT min(node) FROM depth WHERE node LIKE 'part/%' AND depth = (SELECT min(depth) FROM depth WHERE node LIKE 'part/%')"
CHAINS = f"""{GRAPH}, {DEPTH}, {_steps(PART)},
ways(path) AS (SELECT ['region/0'] UNION ALL SELECT list_append(path, dst) FROM ways JOIN steps ON src = path[len(path)] AND steps.depth = len(path) WHERE steps.depth <= (SELECT depth FROM goal)),
full_chains AS (SELECT path FROM ways WHERE path[len(path)] IN (SELECT node FROM hit)),
named AS (SELECT path, list_transform(path, lambda p: CASE WHEN p LIKE 'part/%' THEN 'x' ELSE p END) AS key FROM full_chains),
chains AS (SELECT min(path) AS path FROM named GROUP BY key)"""

PATHS = """WITH paths AS (SELECT p_partkey, lower(replace(p_brand, '#', '')) AS name, p_partkey::VARCHAR AS k FROM part),
p AS (SELECT p_partkey, name, CASE p_partkey % 8 WHEN 0 THEN 'app/src/m' || k || '.ts' WHEN 1 THEN 'app/node_modules/' || name || '/index.js'
  WHEN 2 THEN 'app/node_modules/@s/' || name || '/lib/x' || k || '.mjs' WHEN 3 THEN 'app/node_modules/.pnpm/' || name || '@1/node_modules/' || name || '/a.js'
  WHEN 4 THEN 'venv/site/' || name || '/__init__.py' WHEN 5 THEN 'venv/site/' || name || '.cpython-311.so' WHEN 6 THEN 'venv/site/' || name || '-1.dist-info/RECORD'
  ELSE 'app/.git/o' || k || '.ts' END AS path FROM paths)"""
CHANGES = """WITH m AS (SELECT user_id, avg(value) FILTER (event_id % 2 = 1) AS a, avg(value) FILTER (event_id % 2 = 0) AS b FROM events GROUP BY user_id),
c AS (SELECT user_id, a / b - 1 AS change FROM m WHERE a IS NOT NULL AND b > 0)"""
TS = "('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'mts', 'cts')"

ORACLES = {
    "q01_edge_counts": f"{GRAPH} SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources FROM edges GROUP BY kind",
    "q02_dangling": f"{GRAPH} SELECT kind, count(*) AS unresolved, count(DISTINCT dst) AS targets FROM edges WHERE dst NOT IN (SELECT path FROM nodes WHERE NOT (path LIKE 'part/%' AND size_bytes = 1)) GROUP BY kind",
    "q03_packages": f"{GRAPH} SELECT package AS name, sum(size_bytes)::BIGINT AS total_size_bytes, count(*) AS file_count FROM nodes WHERE package IS NOT NULL GROUP BY package ORDER BY 2 DESC, 1 LIMIT 10",
    "q04_imports": f"{GRAPH} SELECT path, kind FROM edges JOIN nodes ON path = dst WHERE src = 'nation/3'",
    "q05_importers": f"{GRAPH} SELECT path, kind FROM edges JOIN nodes ON path = src WHERE dst = 'nation/3'",
    "q06_static_weight": f"{T} {_weight('s', 'static_weight', 'static_module_count')}",
    "q07_dynamic_only_weight": f"{T} {_weight('d', 'dynamic_only_weight', 'dynamic_only_module_count')}",
    "q07b_include_dynamic": f"{T}, w AS ({_weight('sall', 'static_weight', 'static_module_count')}) SELECT *, 0::BIGINT AS dynamic_only_weight, 0::BIGINT AS dynamic_only_module_count FROM w",
    "q08_heavy_packages": f"{T} {_packages('s')} ORDER BY 2 DESC, 1 LIMIT 10",
    "q09_heavy_packages_ignoring": f"{T} SELECT * FROM ({_packages('s')}) WHERE name NOT IN ('Brand#1', 'nation-3')",
    "q10_dynamic_packages": f"{T} SELECT name, total_size_bytes FROM ({_packages('d')})",
    "q11_exclusive_weight": f"{T}, {_dominated(STATIC, 's')} SELECT * FROM weights",
    "q11b_exclusive_weight_dynamic": f"{T}, {_dominated(BOTH, 'sall')} SELECT * FROM weights",
    "q11c_modules_by_cost": f"{T}, {_dominated(STATIC, 's')} SELECT weights.* FROM weights JOIN nodes USING (path) WHERE package IS NULL AND path <> 'region/0'",
    "q12_depths": f"{GRAPH}, {DEPTH} SELECT depth, count(*) AS modules FROM depth GROUP BY depth",
    "q13_threshold": f"{T}, w AS ({_weight('s', 'static_weight', 'n')}) SELECT static_weight, 1000000::BIGINT AS threshold, static_weight > 1000000 AS exceeded FROM w",
    "q14_path_count": f"""{GRAPH}, {_steps("SELECT path FROM nodes WHERE package = 'Brand#7'")},
ways(node, depth, n) AS (SELECT 'region/0', 0, 1::BIGINT UNION ALL SELECT dst, d, sum(n)::BIGINT FROM (SELECT dst, steps.depth AS d, n FROM ways JOIN steps ON src = node AND steps.depth = ways.depth + 1 WHERE steps.depth <= (SELECT depth FROM goal)) GROUP BY dst, d)
SELECT depth AS hop_count, sum(n)::BIGINT AS path_count FROM ways JOIN hit USING (node) WHERE depth = (SELECT depth FROM goal) GROUP BY depth""",
    "q15_chains": f"{CHAINS} SELECT array_to_string(path, '>') AS chain, array_to_string(list_transform(path[2:], lambda x: 'static'), '>') AS kinds, 'all_static' AS type FROM chains",
    "q16_chain_frequency": f"{CHAINS} SELECT p AS path, count(*) AS chains FROM (SELECT unnest(path) AS p FROM chains) GROUP BY p",
    "q17_cuts": f"""{CHAINS}, {_reach('s', 'region/0', STATIC)}, n AS (SELECT count(*) AS n FROM chains),
freq AS (SELECT p, count(*) AS f FROM (SELECT unnest(path) AS p FROM chains) GROUP BY p),
{_dominated(STATIC, 's')}
SELECT p AS path, f AS chains_broken, exclusive_size_bytes FROM freq JOIN n ON f = n JOIN weights ON path = p WHERE p <> 'region/0' AND p NOT IN (SELECT node FROM hit)""",
    "q18_diff_sections": f"""{WITHOUT}
SELECT 'only_in_a' AS section, name, total_size_bytes FROM pa WHERE name NOT IN (SELECT name FROM pb)
UNION ALL SELECT 'only_in_b', name, total_size_bytes FROM pb WHERE name NOT IN (SELECT name FROM pa)
UNION ALL SELECT 'dynamic_only_in_a', name, total_size_bytes FROM qa WHERE name NOT IN (SELECT name FROM qb)
UNION ALL SELECT 'dynamic_only_in_b', name, total_size_bytes FROM qb WHERE name NOT IN (SELECT name FROM qa)""",
    "q19_shared_packages": f"{TWO} SELECT count(*) AS shared_count FROM pa JOIN pb USING (name)",
    "q20_diff_dynamic": f"{TWO} SELECT name, qa.total_size_bytes AS size_a, qb.total_size_bytes AS size_b FROM qa FULL JOIN qb USING (name)",
    "q21_diff_summary": f"""{TWO}, w AS (SELECT (SELECT sum(size_bytes)::BIGINT FROM s JOIN nodes ON path = node) AS a, (SELECT sum(size_bytes)::BIGINT FROM t JOIN nodes ON path = node) AS b,
  coalesce((SELECT sum(size_bytes)::BIGINT FROM d JOIN nodes ON path = node), 0) AS x, coalesce((SELECT sum(size_bytes)::BIGINT FROM e JOIN nodes ON path = node), 0) AS y)
SELECT 'region/0' AS entry_a, 'region/1' AS entry_b, a AS weight_a, b AS weight_b, b - a AS weight_delta, x AS dynamic_weight_a, y AS dynamic_weight_b, y - x AS dynamic_weight_delta,
  (SELECT count(*) FROM pa JOIN pb USING (name)) AS shared_count FROM w""",
    "q22_snapshot_json": f"""{T}, pa AS ({_packages('s')}), qa AS ({_packages('d')})
SELECT 'region/0' AS entry, (SELECT sum(size_bytes)::BIGINT FROM s JOIN nodes ON path = node) AS static_weight, (SELECT count(*) FROM pa) AS n_packages, (SELECT coalesce(sum(total_size_bytes), 0)::BIGINT FROM pa) AS package_bytes,
  coalesce((SELECT sum(size_bytes)::BIGINT FROM d JOIN nodes ON path = node), 0) AS dynamic_weight, (SELECT count(*) FROM qa) AS n_dynamic""",
    "q23_format_size": f"""{GRAPH} SELECT path, CASE WHEN size_bytes >= 1000000 THEN printf('%.1f MB', size_bytes / 1000000.0::DOUBLE) WHEN size_bytes >= 1000 THEN printf('%.0f KB', size_bytes / 1000.0::DOUBLE)
ELSE size_bytes || ' B' END AS size FROM nodes""",
    "q24_parse_size": """SELECT p_partkey, ' ' || p_size || CASE p_partkey % 5 WHEN 0 THEN '.5 MB' WHEN 1 THEN 'KB' WHEN 2 THEN 'B' WHEN 3 THEN '' ELSE 'x' END || ' ' AS text,
CASE p_partkey % 5 WHEN 0 THEN p_size * 1000000 + 500000 WHEN 1 THEN p_size * 1000 WHEN 4 THEN NULL ELSE p_size END::BIGINT AS bytes FROM part""",
    "q25_node_package": PATHS + " SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN name WHEN 2 THEN '@s/' || name WHEN 3 THEN name END AS package FROM p",
    "q26_python_package": PATHS + " SELECT p_partkey, CASE p_partkey % 8 WHEN 4 THEN name WHEN 5 THEN name END AS package FROM p",
    "q27_looks_like_path": PATHS + f""", t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN path WHEN 1 THEN '@' || name ELSE name || '.ts' END AS text FROM p)
SELECT p_partkey, text, NOT starts_with(text, '@') AND (contains(text, '/') OR regexp_extract(text, '\\.([^./]+)$', 1) IN {TS}) AS is_path FROM t""",
    "q28_watch_filter": PATHS + " SELECT p_partkey, p_partkey % 8 = 0 AS relevant FROM p",
    "q28b_package_relative_path": PATHS + """ SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN name || '/index.js' WHEN 2 THEN name || '/lib/x' || p_partkey || '.mjs' WHEN 3 THEN name || '/a.js'
WHEN 4 THEN name || '/__init__.py' ELSE list_extract(string_split(path, '/'), -1) END AS shown FROM p""",
    "q29_completion": f"{GRAPH} SELECT path FROM nodes WHERE path LIKE 'part/1%' ORDER BY path LIMIT 20",
    "q30_median": "SELECT event_type, median(value) AS median FROM events GROUP BY event_type",
    "q31_mad": "SELECT event_type, round(mad(value), 9) AS mad FROM events GROUP BY event_type",
    "q32_moments": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, round(stddev_samp(value) / avg(value), 6) AS cv FROM events GROUP BY event_type",
    "q33_trimmed_mean": """SELECT event_type, round(avg(value), 6) AS trimmed_mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n
FROM events WHERE value IS NOT NULL) WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1) GROUP BY event_type""",
    "q34_welch": """WITH m AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type)
SELECT a.event_type, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t,
  round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS df
FROM m a, m b WHERE a.event_type <> 'click' AND b.event_type = 'click'""",
    "q34b_p_value": """WITH m AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type),
w AS (SELECT a.event_type, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS df
  FROM m a, m b WHERE a.event_type <> 'click' AND b.event_type = 'click'),
-- Student's distribution as the share of cos(x)^(df - 1) up to atan(|t| / sqrt(df)), by Simpson's rule
steps AS (SELECT k, CASE WHEN k = 0 OR k = 100000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS c FROM range(0, 100001) r(k)),
parts AS (SELECT event_type, any_value(atan(abs(t) / sqrt(df))) * sum(c * cos(atan(abs(t) / sqrt(df)) * k / 100000) ** (df - 1)) AS part, any_value(pi() / 2) * sum(c * greatest(0, cos(pi() / 2 * k / 100000)) ** (df - 1)) AS whole
  FROM w, steps GROUP BY event_type)
SELECT event_type, round(1 - part / whole, 6) AS p FROM parts""",
    "q35_noise_floor": CHANGES + " SELECT round(CASE WHEN count(*) < 3 THEN 0.01 ELSE greatest(0.01, 1.4826 * mad(change)) END, 6) AS noise_floor FROM c",
    "q35b_bias_adjusted": CHANGES + " SELECT user_id, round(change - (SELECT CASE WHEN count(*) < 3 THEN 0 ELSE median(change) END FROM c), 6) AS change FROM c",
    "q36_transitive_importers": f"""{GRAPH}, up(node, depth) AS (SELECT 'part/1', 0 UNION SELECT src, depth + 1 FROM up JOIN edges ON dst = node WHERE {STATIC} AND depth < 25), least(node, depth) AS (SELECT node, min(depth) FROM up GROUP BY node)
SELECT depth, count(*) AS modules FROM least GROUP BY depth""",
}
