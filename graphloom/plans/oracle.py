"""DuckDB SQL that each registered query must equal."""

from __future__ import annotations

NODES = r"""nodes AS (
  SELECT 0::BIGINT AS id, 'repo' AS kind, 'repo' AS name, '' AS path, NULL::BIGINT AS parent, 0::BIGINT AS loc, []::VARCHAR[] AS tags, false AS external
  UNION ALL SELECT 1 + r_regionkey, 'package', r_name, r_name, 0, 0, [], false FROM region
  UNION ALL SELECT 100 + n_nationkey, 'package', n_name, r_name || '/' || n_name, 1 + n_regionkey, 0, [], false FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 500 + CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT), 'package', p_brand, 'external:' || p_brand, 0, 0, [], true FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT 10000 + s_suppkey, 'file', s_name, s_name, 100 + s_nationkey, s_suppkey % 100 + 1, ['http-server'], false FROM supplier
  UNION ALL SELECT 1000000 + c_custkey, 'file', c_name, c_name, 100 + c_nationkey, c_custkey % 50 + 1, ['route:/' || lower(c_mktsegment), 'http-client'], false FROM customer
  UNION ALL SELECT 100000000 + o_orderkey, 'symbol', 'o' || o_orderkey, c_name || '#' || o_orderkey, 1000000 + o_custkey, 0,
    [CASE o_orderstatus WHEN 'F' THEN 'db' WHEN 'O' THEN 'queue' ELSE 'process' END], false FROM orders JOIN customer ON o_custkey = c_custkey)"""
CALLS = """SELECT 100000000 + l_orderkey AS src, 10000 + l_suppkey AS dst, 'calls' AS kind, l_returnflag AS label, count(*)::BIGINT AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_suppkey, l_returnflag"""
FLOWS = """SELECT 10000 + s_suppkey AS src, 1000000 + k AS dst, 'flow' AS kind, 'http /' || n_name AS label, 1::BIGINT AS weight
  FROM supplier JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1) ON s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey"""
IMPORTS = r"""SELECT 1000000 + o_custkey AS src, 500 + CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT) AS dst, 'imports' AS kind, NULL AS label, count(*)::BIGINT AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand"""
EDGES = f"""edges AS ({CALLS} UNION ALL {FLOWS} UNION ALL {IMPORTS}
  UNION ALL SELECT parent, id, 'contains', NULL, 1 FROM nodes WHERE parent IS NOT NULL)"""
HOME = f"""edges AS (SELECT 100000000 + l_orderkey AS src, 10000 + l_suppkey AS dst, 'calls' AS kind, l_returnflag AS label, count(*)::BIGINT AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
  GROUP BY l_orderkey, l_suppkey, l_returnflag UNION ALL {FLOWS})"""
CLOSURE = """closure AS (SELECT id AS node, id AS ancestor, 0::BIGINT AS dist FROM nodes
  UNION ALL SELECT c.node, n.parent, c.dist + 1 FROM closure c JOIN nodes n ON c.ancestor = n.id WHERE n.parent IS NOT NULL)"""
BASE = f"WITH RECURSIVE {NODES}, {EDGES}, {CLOSURE}"
PROGRESS = """said AS (SELECT event_id AS seq, ts, 'r' || user_id % 50 AS run, event_id % 16 AS k, event_type, user_id, value, props,
    CASE WHEN event_id % 16 BETWEEN 7 AND 13 THEN event_type END AS role, CASE WHEN event_id % 16 BETWEEN 7 AND 13 AND event_id % 3 > 0 THEN user_id::VARCHAR END AS target,
    CASE WHEN event_id % 16 BETWEEN 8 AND 11 THEN 'reading' WHEN event_id % 16 = 12 THEN 'searching' END AS kind FROM events)"""
HOME_BASE = f"WITH RECURSIVE {NODES}, {HOME}, {CLOSURE}"


def lifted(keep: str) -> str:
    return f"""keep AS (SELECT id FROM nodes WHERE {keep}),
up AS (SELECT node, arg_min(ancestor, dist) AS target FROM closure WHERE ancestor IN (SELECT id FROM keep) GROUP BY node),
view AS (SELECT a.target AS src, b.target AS dst, kind, sum(weight)::BIGINT AS weight, list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL))[1:6] AS labels
  FROM edges JOIN up a ON src = a.node JOIN up b ON dst = b.node WHERE kind <> 'contains' AND a.target <> b.target GROUP BY 1, 2, 3)"""


PACKAGE, FILE, SYMBOL = "kind = 'package'", "kind = 'file' OR external", "kind = 'symbol' OR external"
FOCUS = "(kind = 'package' AND id <> 100) OR (parent = 100 AND kind = 'file')"
VIEW = "SELECT src, dst, kind, weight, coalesce(array_to_string(labels, '|'), '') AS labels FROM view"
DEGREE = """deg AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, (sum(i) + sum(o))::BIGINT AS degree FROM
  (SELECT src AS id, 0 AS i, weight AS o FROM view UNION ALL SELECT dst, weight, 0 FROM view) GROUP BY id)"""
HOPS = """hops AS (SELECT * FROM edges e WHERE kind IN ('calls', 'flow') AND NOT (kind = 'calls' AND EXISTS
  (SELECT 1 FROM nodes n WHERE n.kind = 'symbol' AND n.id = e.dst AND n.parent = e.src)))"""
SINKS = """sinks AS (SELECT id, t AS sink FROM (SELECT id, unnest(tags) AS t FROM nodes) WHERE t IN ('db', 'fs', 'queue', 'process')
  UNION ALL SELECT id, 'unmatched ' || t FROM (SELECT id, unnest(tags) AS t FROM nodes WHERE list_contains(tags, 'http-client') AND id NOT IN (SELECT src FROM edges WHERE kind = 'flow'))
  WHERE starts_with(t, 'route:') OR starts_with(t, 'ipc:'))"""
#: Traces as one recursion: each row is a step, with the stack of what is left to visit and what has been expanded.
WALKS = f"""WITH RECURSIVE {NODES}, {EDGES}, {CLOSURE}, {HOPS}, {SINKS},
walked AS (SELECT DISTINCT src, dst, kind, label FROM hops), goes AS (SELECT DISTINCT src FROM walked),
alive AS (SELECT id FROM sinks UNION SELECT src FROM walked WHERE kind = 'flow' UNION SELECT h.src FROM walked h JOIN alive ON h.dst = alive.id WHERE h.kind = 'calls'),
kids AS (SELECT src, list({{'dst': dst, 'flow': kind = 'flow', 'via': label}} ORDER BY label NULLS FIRST, dst, kind) AS kids FROM walked
  WHERE kind = 'flow' OR dst IN (SELECT id FROM alive) GROUP BY src),
walk AS (SELECT DISTINCT src AS entry, 0 AS step, NULL::BIGINT AS parent, src AS node, NULL::VARCHAR AS via, false AS flow, 0 AS depth, false AS repeat, [src] AS expanded,
    list_transform(list_reverse(list_filter(kids.kids, lambda k: k.dst <> src)), lambda k: {{'dst': k.dst, 'flow': k.flow, 'via': k.via, 'parent': 0::BIGINT, 'depth': 1, 'path': [src, k.dst]}}) AS stack
  FROM kids WHERE src NOT IN (SELECT dst FROM walked) AND src IN (SELECT id FROM alive)
  UNION ALL SELECT entry, step + 1, top.parent, top.dst, top.via, top.flow, top.depth, top.r, list_append(expanded, top.dst),
    list_concat(stack[1:len(stack) - 1], CASE WHEN top.r OR top.depth >= 24 OR kids.kids IS NULL THEN [] ELSE
      list_transform(list_reverse(list_filter(kids.kids, lambda k: NOT list_contains(top.path, k.dst))), lambda k: {{'dst': k.dst, 'flow': k.flow, 'via': k.via, 'parent': (w.step + 1)::BIGINT, 'depth': top.depth + 1, 'path': list_append(top.path, k.dst)}}) END)
  FROM (SELECT entry, step, expanded, stack, {{'dst': t.dst, 'flow': t.flow, 'via': t.via, 'parent': t.parent, 'depth': t.depth, 'path': t.path, 'r': list_contains(expanded, t.dst) AND t.dst IN (SELECT src FROM goes)}} AS top
        FROM (SELECT *, stack[len(stack)] AS t FROM walk WHERE len(stack) > 0 AND step < 299)) w LEFT JOIN kids ON kids.src = top.dst),
ends AS (SELECT entry, bool_or(flow) AS flows, bool_or((step = 299 AND len(stack) > 0) OR (depth >= 24 AND NOT repeat AND node IN (SELECT src FROM goes))) AS truncated FROM walk GROUP BY entry),
lanes AS (SELECT node, arg_min(ancestor, dist) AS pack FROM closure WHERE ancestor IN (SELECT id FROM nodes WHERE kind = 'package') GROUP BY node),
rest AS (SELECT id, list(sink) AS sinks FROM sinks GROUP BY id),
steps AS (SELECT w.entry, w.step::BIGINT AS step, w.parent, w.node, w.via, w.flow, w.depth::BIGINT AS depth, w.repeat, ends.truncated, n.name, n.path, n.tags[1] AS lang, coalesce(p.name, '') AS lane, coalesce(rest.sinks, []) AS sinks
  FROM walk w JOIN ends ON ends.entry = w.entry AND ends.flows JOIN nodes n ON n.id = w.node LEFT JOIN lanes ON lanes.node = w.node LEFT JOIN nodes p ON p.id = lanes.pack LEFT JOIN rest ON rest.id = w.node),
firsts AS (SELECT entry, 'langs' AS what, lang AS v, min(step) AS met FROM steps WHERE lang IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT entry, 'lanes', lane, min(step) FROM steps GROUP BY 1, 3
  UNION ALL SELECT entry, 'via', via, min(step) FROM steps WHERE flow AND via IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT entry, 'sinks', s, min(step) FROM (SELECT entry, step, unnest(sinks) AS s FROM steps) GROUP BY 1, 3),
told AS (SELECT entry, {", ".join(f"coalesce(string_agg(v, '|' ORDER BY met) FILTER (WHERE what = '{c}'), '') AS {c}" for c in ("langs", "lanes", "via", "sinks"))}, count(*) FILTER (WHERE what = 'langs') AS n_langs FROM firsts GROUP BY entry),
summary AS (SELECT s.entry, n.path AS entry_path, n.name, count(*) FILTER (WHERE flow) AS hops, count(*) AS steps, langs, lanes, told.via, told.sinks, bool_or(truncated) AS truncated, n_langs
  FROM steps s JOIN nodes n ON n.id = s.entry JOIN told ON told.entry = s.entry GROUP BY ALL)"""
ROUTE = r"""CASE WHEN trim({0}) = '' THEN NULL ELSE (SELECT CASE WHEN NOT starts_with(q, '/') THEN NULL ELSE
  coalesce(nullif(regexp_replace(array_to_string(list_transform(string_split(regexp_extract(q, '^([^?#]*)', 1), '/'),
  lambda x: CASE WHEN regexp_matches(trim(x), '^[:*$].*|^\{{.*\}}$|^<.*>$|^[0-9]+$|.*\*.*') THEN '*' ELSE trim(x) END), '/'), '/+$', ''), ''), '/') END
  FROM (SELECT CASE WHEN contains(trim({0}), '://') THEN coalesce(nullif(regexp_extract(trim({0}), '://[^/]*(/.*)$', 1), ''), '/') ELSE trim({0}) END AS q)) END"""
CHAIN = """chain AS (SELECT user_id, row_number() OVER w - 1 AS pos, event_id, event_type, lead(event_type) OVER w AS next_type
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
MESSAGES = """m AS (SELECT conv_id AS journey, turn AS ord, role AS src, lead(role) OVER w AS dst, CASE WHEN contains(text, '?') THEN 'ask' ELSE 'tell' END AS kind
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
PROJECTED = """p AS (SELECT *, row_number() OVER w AS place, CASE WHEN lag(src) OVER w = src AND lag(dst) OVER w = dst AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS fresh
  FROM m WHERE dst IS NOT NULL AND src <> dst WINDOW w AS (PARTITION BY journey ORDER BY ord)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY journey ORDER BY ord) AS island FROM p)"""


SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x')"
TITLE = "array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '[-_ ]'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"
CODE = f"""code AS (SELECT n.id, n.name, n.parent, n.loc, 'file' AS kind, CASE WHEN n.id < 1000000 THEN 'go' WHEN n.id % 2 = 0 THEN 'python' ELSE 'typescript' END AS lang,
  p.path || '/' || CASE n.id % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'alpha' ELSE 'beta_x' END || '/' || n.name || CASE WHEN n.id < 1000000 THEN '.go' WHEN n.id % 2 = 0 THEN '.py' ELSE '.ts' END AS path,
  CASE WHEN n.id < 1000000 THEN CASE WHEN n.parent % 3 = 0 THEN n.tags ELSE [] END WHEN n.id % 10 = 0 THEN ['env:PG_' || (n.id % 100)] WHEN n.id % 50 = 1 THEN n.tags ELSE [] END AS tags, p.name AS package, p.path AS dir
  FROM nodes n JOIN nodes p ON n.parent = p.id WHERE n.kind = 'file'),
parts AS (SELECT s.id, c.id AS file, c.path || '#' || s.id AS path, CASE WHEN s.id % 20 = 1 THEN s.tags ELSE [] END AS tags FROM nodes s JOIN code c ON s.parent = c.id WHERE s.kind = 'symbol'),
met AS (SELECT id AS file, unnest(tags) AS t, id AS node FROM code UNION ALL SELECT file, unnest(tags), id FROM parts),
ft AS (SELECT c.package, c.path, m.t, min(m.node) AS node FROM met m JOIN code c ON m.file = c.id GROUP BY 1, 2, 3),
grp AS (SELECT *, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'alpha' ELSE 'beta_x' END AS dirname FROM code),
sz AS (SELECT package, count(DISTINCT dirname) AS groups, count(*) AS n FROM grp GROUP BY 1),
titled AS (SELECT g.id, g.package, g.path, CASE WHEN groups = 1 AND n <= 6 THEN {TITLE.format("g.name")} WHEN dirname = '' THEN 'Core' ELSE {TITLE.format("dirname")} END AS name FROM grp g JOIN sz USING (package)),
placed AS (SELECT *, 'c:' || {SLUG.format("package")} || '/' || {SLUG.format("name")} AS component FROM titled)"""
ENDS = """spot AS (SELECT id, id AS file, path FROM code UNION ALL SELECT id, file, path FROM parts),
e AS (SELECT a.path AS f, b.path AS t, kind AS via, label, ka.component AS ka, kb.component AS kb FROM edges x JOIN spot a ON x.src = a.id JOIN spot b ON x.dst = b.id JOIN placed ka ON a.file = ka.id JOIN placed kb ON b.file = kb.id WHERE kind <> 'contains' AND a.file <> b.file),
ev AS (SELECT level, src, dst, f, t, via, min(label) AS label FROM (SELECT 'component' AS level, ka AS src, kb AS dst, f, t, via, label FROM e UNION ALL SELECT 'container', split_part(ka, '/', 1), split_part(kb, '/', 1), f, t, via, label FROM e) WHERE src <> dst GROUP BY 1, 2, 3, 4, 5, 6),
few AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY level, src, dst ORDER BY f, t, via) <= 12),
said AS (SELECT level, src, dst, label, row_number() OVER (PARTITION BY level, src, dst ORDER BY min(f || chr(1) || t || chr(1) || via)) AS r FROM few WHERE via = 'flow' GROUP BY 1, 2, 3, 4),
words AS (SELECT level, src, dst, string_agg(label, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS l, count(*) AS n FROM said GROUP BY 1, 2, 3)"""
MODEL = {
    "model_containers": f"""{BASE}, {CODE},
of AS (SELECT package, count(*) AS files, sum(loc)::BIGINT AS loc, arg_min(lang, path) AS first, any_value(dir) AS dir FROM code GROUP BY 1),
has AS (SELECT package, list(DISTINCT t) AS ts FROM ft GROUP BY 1),
ln AS (SELECT package, arg_max(lang, (s, lang)) AS language FROM (SELECT package, lang, sum(greatest(loc, 1)) AS s FROM code GROUP BY 1, 2) GROUP BY 1),
dep AS (SELECT c.package, x.name AS dep, sum(e.weight) AS w FROM edges e JOIN nodes x ON e.dst = x.id AND x.external JOIN code c ON e.src = c.id WHERE e.kind = 'imports' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c.package ORDER BY w DESC, dep) <= 3),
tech AS (SELECT package, string_agg(dep, ', ' ORDER BY w DESC, dep) AS deps FROM dep GROUP BY 1),
all_ AS (SELECT p.name AS package, p.path AS pdir, o.*EXCLUDE (package), coalesce(h.ts, []) AS ts, ln.language, tech.deps,
  CASE o.first WHEN 'go' THEN 'Go' WHEN 'python' THEN 'Python' WHEN 'typescript' THEN 'TypeScript' ELSE '' END AS lname
  FROM nodes p LEFT JOIN of o ON p.name = o.package LEFT JOIN has h ON p.name = h.package LEFT JOIN ln ON p.name = ln.package LEFT JOIN tech ON p.name = tech.package WHERE p.kind = 'package' AND NOT p.external),
k AS (SELECT *, CASE WHEN files IS NULL THEN 'tooling' WHEN list_contains(ts, 'http-server') THEN 'service' WHEN list_contains(ts, 'queue') AND NOT list_contains(ts, 'http-client') AND first <> 'typescript' THEN 'worker'
  WHEN first = 'typescript' AND list_contains(ts, 'http-client') THEN 'web' ELSE 'library' END AS kind,
  list_filter([CASE WHEN list_contains(ts, 'http-server') THEN 'serves HTTP routes' END, CASE WHEN list_contains(ts, 'http-client') THEN 'calls HTTP APIs' END, CASE WHEN list_contains(ts, 'db') THEN 'reads a database' END, CASE WHEN list_contains(ts, 'queue') THEN 'uses a queue' END], lambda x: x IS NOT NULL) AS ph FROM all_)
SELECT package, {TITLE.format("package")} AS name, kind, coalesce(language, '') AS language, concat_ws(', ', nullif(lname, ''), deps) AS technology,
  CASE WHEN files IS NULL THEN 'The `' || package || '` package has no source files of its own.' ELSE files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END || ' of ' || lname || ' in `' || pdir || '`' || CASE WHEN len(ph) > 0 THEN '; ' || array_to_string(ph, ', ') ELSE '' END || '.' END AS description,
  coalesce(files, 0) AS files, coalesce(loc, 0) AS loc, kind = 'tooling' OR coalesce(loc, 0) = 0 AS hidden FROM k""",
    "model_placement": f"{BASE}, {CODE} SELECT package, path, component, name FROM placed",
    "model_relationships": f"""{BASE}, {CODE}, {ENDS}
SELECT level, src, dst, CASE WHEN any_value(w.n) > 0 THEN any_value(w.l) || CASE WHEN any_value(w.n) > 3 THEN ' and ' || (any_value(w.n) - 3) || ' more' ELSE '' END WHEN NOT bool_or(via = 'calls') THEN 'imports' WHEN NOT bool_or(via = 'imports') THEN 'calls' ELSE 'imports and calls' END AS label,
  CASE WHEN level = 'container' AND bool_or(starts_with(label, 'http ')) THEN 'HTTP' ELSE '' END AS technology, count(*) AS n_evidence
FROM few LEFT JOIN words w USING (level, src, dst) GROUP BY level, src, dst""",
    "model_touches": f"""{BASE}, {CODE},
env AS (SELECT package, arg_min(t, (path, node)) AS t FROM ft WHERE regexp_matches(t, '^env:.*(DATABASE|DB|PG|SQL)') GROUP BY 1),
touch AS (SELECT package, 'database' AS kind, 0 AS o, 'Database' || coalesce(' (' || env.t[5:] || ')', '') AS name, 'reads and writes' AS verb, 'SQL' AS technology, path, '' AS key FROM ft LEFT JOIN env USING (package) WHERE ft.t = 'db'
  UNION ALL SELECT package, 'queue', 1, 'Queue', 'puts work on', 'queue', path, '' FROM ft WHERE t = 'queue'
  UNION ALL SELECT package, 'service', 3, 'Outside HTTP API', 'calls ' || t[7:], 'HTTP', path, t[7:] FROM ft WHERE starts_with(t, 'route:')),
chosen AS (SELECT kind, 'x:' || {SLUG.format("arg_min(name, package)")} AS x FROM touch GROUP BY 1),
both_ AS (SELECT 'container' AS level, 'c:' || {SLUG.format("t.package")} AS src, x AS dst, t.* FROM touch t JOIN chosen USING (kind) UNION ALL SELECT 'component', p.component, x, t.* FROM touch t JOIN chosen USING (kind) JOIN placed p ON t.path = p.path),
v AS (SELECT level, src, dst, key, any_value(verb) AS verb, any_value(technology) AS technology FROM both_ GROUP BY 1, 2, 3, 4)
SELECT v.level, v.src, v.dst, CASE WHEN v.level = 'container' THEN string_agg(v.verb, ', ' ORDER BY v.key) ELSE arg_min(v.verb, v.key) END AS label, any_value(v.technology) AS technology, any_value(n.n) AS n_evidence
FROM v JOIN (SELECT level, src, dst, least(count(DISTINCT path), 12) AS n FROM both_ GROUP BY 1, 2, 3) n USING (level, src, dst) GROUP BY 1, 2, 3""",
    "journey_drawn": """WITH m AS (SELECT conv_id AS journey, turn AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE role WHEN 'user' THEN 'p:user' WHEN 'system' THEN NULL ELSE 's' END AS src, CASE WHEN turn % 5 = 4 THEN 'x:log' ELSE 's' END AS dst, CASE WHEN contains(text, '?') THEN 'ask' ELSE 'tell' END AS label FROM conversations),
q AS (SELECT *, CASE WHEN lag(src) OVER w = src AND lag(dst) OVER w = dst THEN 0 ELSE 1 END AS fresh FROM m WHERE src IS NOT NULL AND src <> dst WINDOW w AS (PARTITION BY journey ORDER BY ord)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY journey ORDER BY ord) AS island FROM q)
SELECT journey, min(n) AS n, any_value(src) AS src, any_value(dst) AS dst, 'call' AS kind, CASE WHEN count(DISTINCT label) = 1 THEN any_value(label) ELSE arg_min(label, ord) || ', ' || CASE arg_min(label, ord) WHEN 'ask' THEN 'tell' ELSE 'ask' END END AS label FROM i GROUP BY journey, island""",
}


def oracles() -> dict[str, str]:
    out = LOOKUPS | MODEL | {
        "view_package": f"{BASE}, {lifted(PACKAGE)} {VIEW}",
        "view_file": f"{BASE}, {lifted(FILE)} {VIEW}",
        "view_symbol": f"{BASE}, {lifted(SYMBOL)} {VIEW}",
        "view_focus_nation": f"{BASE}, {lifted(FOCUS)} {VIEW}",
        "view_degree": f"{BASE}, {lifted(PACKAGE)}, {DEGREE} SELECT * FROM deg",
        "hotspots_file": f"{BASE}, {lifted(FILE)}, {DEGREE} SELECT id, path, fan_in, fan_out FROM nodes JOIN deg USING (id) WHERE kind = 'file' ORDER BY degree DESC, path LIMIT 20",
        "hotspots_package": f"{BASE}, {lifted(PACKAGE)}, {DEGREE} SELECT id, path, fan_in, fan_out FROM nodes JOIN deg USING (id) WHERE kind = 'package' AND NOT external ORDER BY degree DESC, path LIMIT 20",
        "stats_overview": f"""{BASE} SELECT count(*) FILTER (WHERE kind = 'file') AS files, count(*) FILTER (WHERE kind = 'symbol') AS symbols, count(*) FILTER (WHERE kind = 'package' AND NOT external) AS packages,
  count(*) FILTER (WHERE kind = 'package' AND external) AS external_packages, (sum(loc) FILTER (WHERE kind = 'file'))::BIGINT AS loc, (SELECT coalesce(sum(weight), 0)::BIGINT FROM edges WHERE kind = 'imports') AS imports,
  (SELECT coalesce(sum(weight), 0)::BIGINT FROM edges WHERE kind = 'calls') AS calls, (SELECT count(*) FROM edges WHERE kind = 'flow') AS flows FROM nodes""",
        "stats_by_kind": f"{BASE} SELECT kind, external, count(*) AS n, sum(loc)::BIGINT AS loc FROM nodes GROUP BY ALL",
        "loc_propagated": f"{BASE} SELECT ancestor AS id, sum(loc)::BIGINT AS loc FROM closure JOIN nodes ON node = id WHERE kind = 'file' GROUP BY ancestor",
        "edge_dedup_weight": f"WITH {NODES}, {EDGES} SELECT kind, label, count(*) AS n, sum(weight)::BIGINT AS weight FROM edges GROUP BY ALL",
        "closure_all": f"{BASE} SELECT * FROM closure",
        "ancestor_package": f"{BASE} SELECT node, arg_min(ancestor, dist) AS package FROM closure JOIN nodes ON ancestor = id WHERE kind = 'package' GROUP BY node",
        "search_parts": f"""WITH {NODES}, s AS (SELECT id, path, (CASE WHEN lower(name) = 'nation_1' THEN 100 WHEN starts_with(lower(name), 'nation_1') THEN 60 WHEN contains(lower(name), 'nation_1') THEN 40 WHEN contains(lower(path), 'nation_1') THEN 20 END
  - CASE kind WHEN 'repo' THEN 0 WHEN 'package' THEN 1 WHEN 'file' THEN 2 ELSE 3 END)::BIGINT AS score FROM nodes) SELECT * FROM s WHERE score IS NOT NULL ORDER BY score DESC, path, id LIMIT 20""",
        "search_empty": f"""WITH {NODES} SELECT id, path, (60 + CASE WHEN name = '' THEN 40 ELSE 0 END - CASE kind WHEN 'repo' THEN 0 WHEN 'package' THEN 1 WHEN 'file' THEN 2 ELSE 3 END)::BIGINT AS score FROM nodes ORDER BY score DESC, path, id LIMIT 50""",
        "nodes_filtered": f"WITH {NODES} SELECT id, path FROM nodes WHERE kind = 'file' AND len(list_filter(tags, lambda t: starts_with(t, 'route:/b'))) > 0 AND contains(path, '7')",
        "boundaries_all": f"WITH {NODES} SELECT id, path FROM nodes WHERE kind IN ('symbol', 'file') AND list_has_any(tags, ['db', 'env', 'fs', 'http-client', 'http-server', 'ipc-client', 'ipc-server', 'process', 'queue'])",
        "boundaries_prefix": f"WITH {NODES} SELECT id, path FROM nodes WHERE kind IN ('symbol', 'file') AND list_has_any(tags, ['db', 'env', 'fs', 'http-client', 'http-server', 'ipc-client', 'ipc-server', 'process', 'queue']) AND len(list_filter(tags, lambda t: starts_with(t, 'http-s'))) > 0",
        "flows_rows": f"WITH {NODES}, {EDGES} SELECT a.path AS src_path, b.path AS dst_path, coalesce(label, '') AS label FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE edges.kind = 'flow'",
        "hops": f"WITH {NODES}, {EDGES}, {HOPS} SELECT src, dst, kind, label, weight FROM hops",
        "entries": f"WITH {NODES}, {EDGES}, {HOPS} SELECT DISTINCT src AS id FROM hops WHERE src NOT IN (SELECT dst FROM hops)",
        "sinks": f"WITH {NODES}, {EDGES}, {SINKS} SELECT * FROM sinks",
        "leads_somewhere": f"WITH RECURSIVE {NODES}, {EDGES}, {HOPS}, {SINKS}, r AS (SELECT id FROM sinks UNION SELECT src FROM edges WHERE kind = 'flow' UNION SELECT h.src FROM hops h JOIN r ON h.dst = r.id WHERE h.kind = 'calls') SELECT DISTINCT id FROM r",
        "traces_steps": f"{WALKS} SELECT * REPLACE (array_to_string(sinks, '|') AS sinks) FROM steps",
        "traces_summary": f"{WALKS} SELECT * EXCLUDE (n_langs) FROM summary",
        "traces_order": f"{WALKS} SELECT entry, entry_path, hops, n_langs, steps FROM summary ORDER BY hops DESC, n_langs DESC, steps DESC, entry_path, entry LIMIT 20",
        "routes_normalized": f"SELECT page_id, url, {ROUTE.format('url')} AS route FROM pages",
        "cycles_file": f"""{HOME_BASE}, {lifted("kind = 'file'")}, e AS (SELECT DISTINCT src, dst FROM view), reach AS (SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON reach.dst = e.src),
c AS (SELECT a.src AS id, least(min(b.src), a.src) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT component, count(*)::BIGINT AS size FROM c GROUP BY component HAVING count(*) > 1""",
        "cycles_package": f"""{BASE}, {lifted(PACKAGE)}, e AS (SELECT DISTINCT src, dst FROM view), reach AS (SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON reach.dst = e.src),
c AS (SELECT a.src AS id, least(min(b.src), a.src) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT component, count(*)::BIGINT AS size FROM c GROUP BY component HAVING count(*) > 1""",
        "neighbours_supplier": f"WITH {NODES}, {EDGES} SELECT 'in' AS direction, edges.kind, label, weight, src AS other, path FROM edges JOIN nodes ON src = id WHERE dst = 10003 AND edges.kind <> 'contains' UNION ALL SELECT 'out', edges.kind, label, weight, dst, path FROM edges JOIN nodes ON dst = id WHERE src = 10003 AND edges.kind <> 'contains'",
        "neighbours_order": f"WITH {NODES}, {EDGES} SELECT 'out' AS direction, edges.kind, label, weight, dst AS other, path FROM edges JOIN nodes ON dst = id WHERE src = 100000005 AND edges.kind <> 'contains'",
        "path_between_files": f"""WITH RECURSIVE {NODES}, {EDGES}, b AS (SELECT src, dst FROM edges WHERE kind <> 'contains' UNION SELECT dst, src FROM edges WHERE kind <> 'contains'),
r AS (SELECT 100000001::BIGINT AS id, 0 AS d UNION SELECT b.dst, r.d + 1 FROM r JOIN b ON r.id = b.src WHERE r.d < 4),
near AS (SELECT id, min(d) AS d FROM r GROUP BY id), back AS (SELECT id, d FROM near WHERE id = 1000007 UNION ALL
SELECT (SELECT min(n.id) FROM near n JOIN b ON b.src = n.id AND b.dst = back.id WHERE n.d = back.d - 1), back.d - 1 FROM back WHERE back.d > 0)
SELECT d::BIGINT AS pos, id FROM back""",
        "lang_of_path": "SELECT page_id, CASE string_split(url, '.')[-1] WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' END AS lang FROM pages",
        "loc_nonblank": r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\f\r]')))::BIGINT AS loc FROM documents",
        "minified": "SELECT doc_id, (strlen(text) >= 4096 AND strlen(text) // greatest(length(text) - length(replace(text, chr(10), '')), 1) > 400) AS minified FROM documents",
        "slug_title": r"""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS slug,
  array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '[-_ ]'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM part""",
        "span_stats": "SELECT event_type AS name, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, max(value) AS max, arg_max(value, event_id) AS last FROM events GROUP BY 1",
        "log_query": """SELECT * FROM (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' ELSE 'debug' END AS level, props AS message FROM events)
  WHERE seq > 500 AND level IN ('error', 'warn', 'info') AND contains(lower(message), '"k": 7') ORDER BY seq DESC LIMIT 50""",
        "ring_buffer": "SELECT event_id AS seq, event_type AS level FROM events ORDER BY seq DESC LIMIT 5000",
        "fps_tumbling": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS frames FROM events GROUP BY 1",
        "paths_not_ignored": """SELECT c_custkey, r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
          WHERE NOT (n_name LIKE '%5' AND n_name NOT LIKE '%15') AND NOT (n_nationkey % 3 = 0 AND c_mktsegment = 'BUILDING')
          AND NOT (n_nationkey % 3 <> 1 AND c_name LIKE '%5' AND c_name NOT LIKE '%15') AND NOT (n_nationkey % 3 = 2 AND c_mktsegment LIKE 'MACH%' AND regexp_matches(c_name, '[2-4]$'))""",
        "progress_events": f"""WITH {PROGRESS} SELECT seq, (['started', 'stage', 'proposed', 'survey_done', 'container_done', 'journey_done', 'verified', 'agent_done', 'agent_activity', 'agent_activity', 'agent_activity', 'agent_activity', 'agent_activity', 'agent_started', NULL, NULL])[k + 1] AS event,
          CASE k WHEN 0 THEN event_type END AS model, CASE k WHEN 0 THEN user_id END AS containers, CASE k WHEN 0 THEN user_id % 7 END AS journeys, CASE k WHEN 0 THEN value > 50 END AS scout, CASE k WHEN 1 THEN event_type END AS stage, role, target,
          CASE k WHEN 13 THEN 'the ' || event_type END AS name, kind, CASE kind WHEN 'reading' THEN 'src/' || event_type END AS path, CASE kind WHEN 'searching' THEN props END AS query,
          CASE k WHEN 7 THEN value <= 100 END AS ok, CASE k WHEN 7 THEN value END AS cost_usd, CASE k WHEN 7 THEN user_id::DOUBLE END AS secs, CASE WHEN k = 7 AND value > 100 THEN props END AS error,
          CASE WHEN k IN (2, 3) THEN event_type WHEN k IN (4, 5, 6) THEN user_id::VARCHAR END AS inner,
          CASE WHEN k = 14 THEN 'unknown event lost' WHEN seq % 32 = 15 THEN 'not JSON' WHEN k = 15 THEN 'stage without stage' END AS problem,
          CASE WHEN k = 14 THEN '{{"event":"lost"}}' WHEN seq % 32 = 15 THEN '{{"event": "stage", ' WHEN k = 15 THEN '{{"event":"stage"}}' END AS raw FROM said""",
        "agents_progress": f"""WITH {PROGRESS}, moves AS (SELECT *, coalesce(target, '') AS whom, floor(epoch(ts))::BIGINT AS second FROM said WHERE role IS NOT NULL AND ts < TIMESTAMP '2024-01-20'),
          timed AS (SELECT *, min(second) OVER (PARTITION BY run, role, whom) + 864000 AS deadline FROM moves),
          ends AS (SELECT run, role, whom, value, user_id, props FROM timed WHERE k = 7 AND second < deadline QUALIFY row_number() OVER (PARTITION BY run, role, whom ORDER BY ts, seq) = 1),
          states AS (SELECT run, role, whom, deadline, max(CASE WHEN k = 13 THEN 'the ' || role END) AS name, count(*) FILTER (WHERE kind = 'reading') AS reads,
            arg_max(CASE kind WHEN 'reading' THEN 'src/' || role ELSE 'searching ' || props END, (ts, seq)) FILTER (WHERE kind IS NOT NULL) AS last FROM timed WHERE second < deadline GROUP BY ALL),
          told AS (SELECT s.*, e.value, e.user_id, e.props, CASE WHEN e.value <= 100 THEN 'done' WHEN e.value > 100 THEN 'failed' WHEN epoch(TIMESTAMP '2024-01-20') >= deadline THEN 'timed out' ELSE 'running' END AS status FROM states s LEFT JOIN ends e USING (run, role, whom))
          SELECT run, role, whom AS target, name, status, reads, CASE status WHEN 'running' THEN last END AS current, coalesce(value, 0.0) AS cost_usd, coalesce(user_id::DOUBLE, 0.0) AS secs,
          CASE status WHEN 'failed' THEN props WHEN 'timed out' THEN 'agent took longer than 864000s and was stopped' END AS error FROM told""",
        "reducer_by_user": "SELECT event_type AS role, user_id AS target, count(*) FILTER (WHERE value > 10 AND value <= 100) AS reads, bool_or(value > 100) AS done, round(sum(value), 4) AS cost, arg_max(props, event_id) AS last_path FROM events GROUP BY 1, 2",
        "event_chain_runs": f"WITH {CHAIN} SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE next_type <> event_type) AS hops, bool_or(event_type IN ('purchase', 'error')) AS sinks FROM chain GROUP BY user_id",
        "journey_project_containers": f"WITH {MESSAGES}, {PROJECTED} SELECT journey, src, dst, kind, min(place)::BIGINT AS n, count(*) AS merged FROM i GROUP BY journey, island, src, dst, kind",
        "journey_participants": "SELECT conv_id, string_agg(role, ',' ORDER BY o) AS participants FROM (SELECT conv_id, role, min(turn) AS o FROM conversations GROUP BY 1, 2) GROUP BY conv_id",
        "messages_dedup": "SELECT conv_id, role, min(turn)::BIGINT AS turn, count(*) AS n FROM conversations GROUP BY conv_id, role",
        "claims_overlay": "SELECT coalesce(d.doc_id, l.doc_id) AS src, coalesce(d.n_chars % 7, l.doc_id % 7)::BIGINT AS dst, coalesce(CASE WHEN l.quality = 1 THEN 'good' ELSE CASE WHEN l.quality = 0 THEN 'poor' END END, d.lang) AS label, CASE WHEN d.doc_id IS NOT NULL THEN 'code' ELSE 'claimed' END AS source FROM (SELECT * FROM documents WHERE doc_id % 3 > 0) d FULL JOIN (SELECT l.doc_id, quality, n_chars FROM labels l JOIN documents USING (doc_id)) l ON d.doc_id = l.doc_id AND d.n_chars % 7 = l.doc_id % 7",
        "verify_report": "SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS backed, count(*) FILTER (WHERE l.doc_id IS NULL) AS claimed, count(*) FILTER (WHERE d.source = 'src0') AS survey FROM documents d LEFT JOIN labels l USING (doc_id)",
        "components_group": r"""SELECT page_id, coalesce(array_to_string(list_transform(list_filter(regexp_split_to_array(g, '[-_ ]'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' '), 'Core') AS component FROM
  (SELECT page_id, list_filter(string_split(url, '/')[1:-2], lambda d: d <> '' AND d NOT IN ('src', 'lib', 'pkg', 'internal', 'app'))[1] AS g FROM pages)""",
        "unplaced_files": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09)",
        "main_language": "SELECT package, max({'s': s, 'lang': lang}).lang AS lang FROM (SELECT source AS package, lang, sum(greatest(n_chars // 1000, 1))::BIGINT AS s FROM documents GROUP BY 1, 2) GROUP BY package",
        "dep_rank": f"WITH {NODES}, {EDGES} SELECT package, dep, weight, rank FROM (SELECT n.parent AS package, e.dst AS dep, sum(weight)::BIGINT AS weight, row_number() OVER (PARTITION BY n.parent ORDER BY sum(weight) DESC, e.dst) AS rank FROM edges e JOIN nodes n ON e.src = n.id WHERE e.kind = 'imports' GROUP BY 1, 2) WHERE rank <= 3",
        "tags_union": "SELECT user_id AS id, string_agg(event_type, ',' ORDER BY o) AS tags FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) GROUP BY user_id",
        "evidence_capped": f"""WITH {NODES}, {EDGES}, x AS (SELECT DISTINCT o.parent AS p, s.parent AS q, e.src AS a, e.dst AS b, e.label AS via FROM edges e JOIN nodes o ON e.src = o.id JOIN nodes s ON e.dst = s.id WHERE e.kind = 'calls'),
y AS (SELECT *, row_number() OVER (PARTITION BY p, q ORDER BY a, b, via) AS n FROM x)
SELECT p AS src, q AS dst, count(*) AS n_evidence, string_agg(a || '>' || b || '>' || via, ';' ORDER BY n) AS evidence FROM y WHERE n <= 12 GROUP BY p, q""",
        "relationship_label": f"""{BASE}, {lifted(PACKAGE)}, l AS (SELECT a.target AS src, b.target AS dst, kind, label FROM edges JOIN up a ON src = a.node JOIN up b ON dst = b.node WHERE kind <> 'contains'),
g AS (SELECT src, dst, coalesce(list_sort(list(DISTINCT label) FILTER (WHERE kind = 'flow')), []) AS f, bool_or(kind = 'imports') AS i, bool_or(kind = 'calls') AS c FROM l GROUP BY 1, 2)
SELECT src, dst, CASE WHEN len(f) > 0 THEN array_to_string(f[1:3], ', ') || CASE WHEN len(f) > 3 THEN ' and ' || (len(f) - 3) || ' more' ELSE '' END WHEN i AND c THEN 'imports and calls' WHEN i THEN 'imports' ELSE 'calls' END AS label FROM g""",
        "rank_pick": """SELECT journey, container, ord FROM (SELECT *, row_number() OVER (PARTITION BY container ORDER BY ord) > 1 AS tier FROM
  (SELECT user_id AS journey, event_type AS container, event_id AS ord FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) ORDER BY tier, ord LIMIT 12)""",
        "endpoints_gaps": f"""WITH h AS (SELECT {ROUTE.format('url')} AS key, count(*) AS handlers FROM pages GROUP BY 1), c AS (SELECT {ROUTE.format('href')} AS key, count(*) AS callers FROM
  (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1)
SELECT coalesce(h.key, c.key) AS key, coalesce(handlers, 0) AS handlers, coalesce(callers, 0) AS callers, CASE WHEN callers IS NULL THEN 'no-callers' WHEN handlers IS NULL THEN 'no-handler' ELSE 'ok' END AS status
FROM (SELECT * FROM h WHERE key IS NOT NULL) h FULL JOIN (SELECT * FROM c WHERE key IS NOT NULL) c ON h.key = c.key""",
        "routes_matched": f"""WITH r AS (SELECT DISTINCT {ROUTE.format('url')} AS route FROM pages), s AS (SELECT route, string_split(route, '/') AS p FROM r WHERE route IS NOT NULL)
SELECT a.route AS client, b.route AS server FROM s a, s b WHERE a.route <> b.route AND
  len(list_filter(range(1, least(len(a.p), len(b.p)) + CASE WHEN len(a.p) = len(b.p) THEN 1 ELSE 0 END), lambda i: a.p[i] <> b.p[i] AND a.p[i] <> '*' AND b.p[i] <> '*')) = 0
  AND (len(a.p) = len(b.p) OR CASE WHEN len(a.p) < len(b.p) THEN a.p[-1] ELSE b.p[-1] END = '*')""",
        "set_difference": "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "set_union_priority": "SELECT doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'label' ELSE 'document' END AS source FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
        "upsert_journey": "SELECT conv_id AS id, CASE WHEN conv_id % 5 = 0 THEN 'changed' ELSE 'kept' END AS state FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 7 <> 0",
        "prefix_join_nearest": "SELECT page_id, max({'d': d, 'p': p}).p AS package FROM (SELECT page_id, 1 AS d, 'http:' AS p FROM pages WHERE starts_with(url, 'http:/') UNION ALL SELECT page_id, 1, 'https:' FROM pages WHERE starts_with(url, 'https:/') UNION ALL SELECT page_id, 4, array_to_string(string_split(url, '/')[1:4], '/') FROM pages WHERE len(string_split(url, '/')) > 4) GROUP BY page_id",
        "range_join_innermost": """SELECT event_id, def FROM (SELECT e.event_id, n.n_nationkey AS def, row_number() OVER (PARTITION BY e.event_id ORDER BY n.n_nationkey % 5, n.n_nationkey) AS r FROM events e
  LEFT JOIN nation n ON e.user_id BETWEEN n.n_nationkey * 6 AND n.n_nationkey * 6 + (n.n_nationkey % 5) * 10) WHERE r = 1""",
        "externals_named": "SELECT o_orderstatus AS kind, arg_min(o_orderpriority, o_orderkey) AS name, count(*) AS n FROM orders GROUP BY 1",
    }
    out["journey_merge"] = f"WITH {MESSAGES}, " + PROJECTED.replace(" AND lag(kind) OVER w = kind", "").replace(" AND src <> dst", "") + " SELECT journey, src, dst, min(place)::BIGINT AS n, count(*) AS merged FROM i GROUP BY journey, island, src, dst"
    out["view_labels_capped"] = "SELECT s_nationkey, l_linestatus, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linenumber))[1:6], '|') AS labels, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
    out["tag_classify_calls"] = classified()
    return out


def classified() -> str:
    """The rules over the same calls, by DuckDB's regular expressions."""
    from graphloom.functions.rules import CALLS
    from graphloom.plans.catalog import CALLEES

    text = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({text(a)}, {text(b)}, {text(f)})" for a, b, f in CALLEES)
    more = {"ipc-server": " AND lang IN ('typescript', 'javascript')", "http-server": " AND starts_with(coalesce(first, ''), '/')", "fs": " OR (callee = 'open' AND lang = 'python')"}
    cases = " ".join(f"WHEN regexp_matches(callee, {text(p)}){more.get(n, '')} THEN '{n}'" for n, p in CALLS.items())
    route = ROUTE.format("first")
    return f"""WITH calls(callee, lang, first) AS (VALUES {values}), k AS (SELECT *, CASE {cases} ELSE 'none' END AS class FROM calls)
SELECT callee, lang, coalesce(first, '') AS first, class, CASE WHEN class = 'none' THEN '' ELSE array_to_string(list_filter([class, CASE
  WHEN class = 'ipc-client' THEN 'ipc:' || first WHEN class IN ('http-server', 'http-client') THEN 'route:' || ({route}) WHEN class = 'env' AND regexp_matches(first, '^[A-Z0-9_]+$') THEN 'env:' || first
  WHEN class = 'queue' THEN 'topic:' || first END], lambda x: x IS NOT NULL), '|') END AS tags FROM k"""


#: A journey's answers one after the other, with the list of drafts that are taken.
MERGED = """WITH RECURSIVE said AS (SELECT conv_id AS journey, turn AS ord, role || '/' || (turn % 2) AS src, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'end') AS dst,
  CASE WHEN contains(text, 'a') THEN 'call' ELSE 'flow' END AS kind FROM conversations),
grained AS (SELECT *, CASE WHEN contains(src, '/') THEN regexp_replace(src, '/[^/]*$', '') ELSE src END AS a FROM said),
drafts AS (SELECT journey, list({'ord': ord, 'src': s, 'a': regexp_replace(s, '/[^/]*$', ''), 'dst': dst, 'kind': kind} ORDER BY ord) AS drafts
  FROM (SELECT *, CASE WHEN ord % 4 = 0 THEN 'user/0' ELSE src END AS s FROM said WHERE ord % 3 > 0) GROUP BY journey),
n AS (SELECT *, row_number() OVER (PARTITION BY journey ORDER BY ord) AS n FROM grained),
walk AS (SELECT journey, 0::BIGINT AS n, NULL::BIGINT AS ord, NULL::BIGINT AS draft, []::BIGINT[] AS used FROM (SELECT DISTINCT journey FROM said)
  UNION ALL SELECT journey, n, ord, hit, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END FROM (
    SELECT n.journey, n.n, n.ord, walk.used, coalesce(list_filter(d.drafts, lambda x: NOT list_contains(walk.used, x.ord) AND x.src = n.src AND x.dst = n.dst AND x.kind = n.kind)[1].ord,
      list_filter(d.drafts, lambda x: NOT list_contains(walk.used, x.ord) AND x.a = n.a AND x.dst = n.dst AND x.kind = n.kind)[1].ord)::BIGINT AS hit
    FROM walk JOIN n ON n.journey = walk.journey AND n.n = walk.n + 1 LEFT JOIN drafts d ON d.journey = n.journey))
SELECT journey, ord, draft FROM walk WHERE ord IS NOT NULL"""
NAMES = """WITH c AS (SELECT 'c:' || n_nationkey AS id, 'pack ' || (n_nationkey % 5) AS package, n_name AS name, n_nationkey AS ord FROM nation),
k AS (SELECT 'c:' || s_nationkey || '/' || s_suppkey AS id, 'Part ' || (s_suppkey % 40) AS name, s_suppkey AS b, c.ord AS a, c.name AS above FROM supplier JOIN c ON c.id = 'c:' || s_nationkey),
puts AS (SELECT id, unnest([id, package, name]) AS key, 0 AS s, ord AS a, -1 AS b, unnest([0, 1, 2]) AS i FROM c
  UNION ALL SELECT id, unnest([id, above || '/' || name, above || ' / ' || name]), 0, a, b, unnest([0, 1, 2]) FROM k UNION ALL SELECT id, name, 1, a, b, 0 FROM k
  UNION ALL SELECT 'p:' || lower(c_mktsegment), unnest(['p:' || lower(c_mktsegment), c_mktsegment]), 2, min(c_custkey), -1, unnest([0, 1]) FROM customer GROUP BY c_mktsegment
  UNION ALL SELECT 'x:' || lower(p_brand), unnest(['x:' || lower(p_brand), p_brand]), 3, min(p_partkey), -1, unnest([0, 1]) FROM part GROUP BY p_brand
  UNION ALL SELECT 'j:' || r_regionkey, unnest(['j:' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'Part ' || r_regionkey END]), 4, r_regionkey, -1, unnest([0, 1]) FROM region),
known AS (SELECT lower(trim(key)) AS key, first(id ORDER BY s, a, b, i, id) AS id, count(DISTINCT id) AS ids FROM puts GROUP BY 1),
asked AS (SELECT o_orderkey AS query, CASE o_orderkey % 5 WHEN 0 THEN 'Part ' || (o_custkey % 50) WHEN 1 THEN ' nation_' || (o_custkey % 30) || ' ' WHEN 2 THEN 'NATION_' || (o_custkey % 25) || ' / part ' || (o_custkey % 40)
  WHEN 3 THEN 'PACK ' || (o_custkey % 7) ELSE 'brand#' || (o_custkey % 60) END AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'NATION_' || (o_custkey % 25) END AS within FROM orders)
SELECT query, name, within, coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NOT NULL THEN x.ids ELSE coalesce(y.ids, 0) END AS ids
FROM asked LEFT JOIN known x ON x.key = lower(within || '/' || name) LEFT JOIN known y ON y.key = lower(trim(name))"""
STARTS = f"""{WALKS}, asked AS (SELECT o_orderkey AS query, CASE o_orderkey % 6 WHEN 0 THEN c_name || '#' || o_orderkey WHEN 1 THEN c_name WHEN 2 THEN 'GET /NATION_' || (o_custkey % 30) WHEN 3 THEN '/' || lower(c_mktsegment)
  WHEN 4 THEN 'Supplier#' || lpad(CAST(o_custkey % 120 AS VARCHAR), 9, '0') ELSE '' END AS start, CASE WHEN o_orderkey % 10 = 0 THEN c_name || '#' || o_orderkey ELSE '' END AS hint FROM orders JOIN customer ON o_custkey = c_custkey),
flowing AS (SELECT src AS id FROM edges WHERE kind = 'flow' UNION SELECT dst FROM edges WHERE kind = 'flow'),
traced AS (SELECT entry AS id FROM summary UNION SELECT src FROM edges WHERE kind = 'flow'),
refs AS (SELECT label AS key, src AS id, 0 AS side FROM edges WHERE kind = 'flow' UNION SELECT label, dst, 1 FROM edges WHERE kind = 'flow'
  UNION SELECT 'http ' || t[7:], id, 0 FROM (SELECT id, unnest(tags) AS t FROM nodes WHERE list_contains(tags, 'http-client') AND id NOT IN (SELECT id FROM flowing)) WHERE starts_with(t, 'route:')),
contracts AS (SELECT key, first(id ORDER BY side, id) FILTER (WHERE id IN (SELECT id FROM traced)) AS followed, coalesce(min(id) FILTER (WHERE side = 1), min(id) FILTER (WHERE side = 0)) AS named FROM refs GROUP BY key),
one AS (SELECT path, min(id) AS id FROM nodes GROUP BY path)
SELECT query, CASE WHEN h.entry IS NOT NULL THEN hint WHEN s.entry IS NOT NULL THEN start WHEN n.id IS NOT NULL THEN start WHEN k.key IS NOT NULL THEN p.path ELSE '' END AS entry,
  CASE WHEN h.entry IS NOT NULL THEN h.entry WHEN s.entry IS NOT NULL THEN s.entry WHEN n.id IS NOT NULL THEN t.id WHEN k.key IS NOT NULL THEN k.followed END AS trace,
  CASE WHEN h.entry IS NOT NULL OR s.entry IS NOT NULL THEN 'trace' WHEN n.id IS NOT NULL THEN CASE WHEN t.id IS NOT NULL THEN 'trace' ELSE 'symbol' END WHEN k.key IS NOT NULL THEN 'endpoint' ELSE 'none' END AS how
FROM asked LEFT JOIN summary h ON h.entry_path = hint LEFT JOIN summary s ON s.entry_path = start LEFT JOIN one n ON n.path = start AND contains(start, '#') LEFT JOIN traced t ON t.id = n.id
  LEFT JOIN contracts k ON k.key = CASE WHEN starts_with(start, 'GET ') THEN 'http ' || start[5:] WHEN starts_with(start, '/') THEN 'http ' || start END LEFT JOIN nodes p ON p.id = coalesce(k.followed, k.named)"""

LOOKUPS = {
    "drafts_merged": MERGED,
    "names_registered": NAMES,
    "starts_resolved": STARTS,
    "nodes_resolved": BASE + r""", q AS (SELECT c_name AS query FROM customer WHERE c_custkey % 20 = 0 UNION SELECT right(c_name, 2) FROM customer UNION SELECT n_name FROM nation
  UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 50 = 1 UNION SELECT '#' || o_orderkey FROM orders WHERE o_orderkey % 50 = 1 UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 50 = 1),
hit AS (SELECT query, id, 0 AS rule FROM q JOIN nodes ON id = TRY_CAST(query AS BIGINT) WHERE regexp_full_match(query, '[0-9]+')
  UNION ALL SELECT query, min(id), 1 FROM q JOIN nodes ON path = query WHERE NOT regexp_full_match(query, '[0-9]+') GROUP BY query
  UNION ALL SELECT query, id, 2 FROM q JOIN nodes ON ends_with(path, query) WHERE NOT regexp_full_match(query, '[0-9]+')
  UNION ALL SELECT query, id, 3 FROM q JOIN nodes ON name = query WHERE NOT regexp_full_match(query, '[0-9]+')),
n AS (SELECT query, rule, count(*) AS n, min(id) AS id FROM hit GROUP BY 1, 2), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY rule) = 1)
SELECT q.query, CASE WHEN n = 1 THEN id END AS id, coalesce(n, 0)::BIGINT AS matches FROM q LEFT JOIN b ON q.query = b.query""",
    "queue_flows": """SELECT a.event_id AS src, b.event_id AS dst, 'queue ' || a.user_id AS label FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'signup' AND b.event_type <> 'signup'""",
    "evidence_technology": """WITH e AS (SELECT user_id % 400 AS src, event_id % 5 AS dst, CASE event_type WHEN 'view' THEN 'HTTP' WHEN 'click' THEN 'IPC' WHEN 'purchase' THEN 'queue' END AS k, min(event_id) AS first_at FROM events GROUP BY 1, 2, 3)
SELECT src, dst, coalesce(string_agg(k, ', ' ORDER BY first_at) FILTER (WHERE k IS NOT NULL), '') AS technology FROM e GROUP BY src, dst""",
    "relationship_fallback": BASE + """, c AS (SELECT * FROM edges WHERE kind = 'calls'), own AS (SELECT DISTINCT src, dst FROM c WHERE label = 'R' AND weight > 1),
up AS (SELECT DISTINCT a.parent AS src, b.parent AS dst FROM c JOIN nodes a ON c.src = a.id JOIN nodes b ON c.dst = b.id WHERE c.src % 7 = 0)
SELECT m.src, m.dst, CASE WHEN own.src IS NOT NULL THEN 'own' WHEN up.src IS NOT NULL THEN 'container' END AS label FROM (SELECT DISTINCT src, dst FROM c) m
JOIN nodes a ON m.src = a.id JOIN nodes b ON m.dst = b.id LEFT JOIN own ON own.src = m.src AND own.dst = m.dst LEFT JOIN up ON up.src = a.parent AND up.dst = b.parent""",
    "endpoint_keys": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http ' || url WHEN 1 THEN 'http /p/' || page_id WHEN 2 THEN 'queue q' || page_id WHEN 3 THEN 'ipc word' || page_id || '|queue word' || page_id ELSE '' END AS keys FROM pages""",
    "flow_requests": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN '' ELSE trim(p_name) END AS name, CASE p_partkey % 4 WHEN 0 THEN 'a#' || p_partkey WHEN 1 THEN 'f#' || p_partkey WHEN 2 THEN 'b' ELSE '' END AS entry,
CASE p_partkey % 4 WHEN 0 THEN 'see @ x :: y' WHEN 1 THEN 'note' ELSE '' END AS note FROM part""",
    "entry_kinds": BASE + """ SELECT id, CASE WHEN list_contains(tags, 'http-server') THEN 'route' WHEN id % 10 = 3 THEN 'main' ELSE 'ui action' END AS entry_kind FROM nodes
WHERE list_contains(tags, 'http-server') OR id % 10 = 3 OR (id % 10 = 4 AND kind = 'symbol')""",
    "children_counts": BASE + " SELECT parent AS id, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY parent",
    "run_totals": "SELECT count(*) AS agents, count(*) FILTER (WHERE event_type = 'error') AS failures, round(coalesce(sum(value), 0), 2) AS cost FROM events",
    "names_distinct": """SELECT s_suppkey, name || CASE n WHEN 1 THEN '' ELSE ' ' || n END AS unique_name FROM (SELECT s_suppkey, 'n' || (s_suppkey % 3) AS name, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_suppkey) AS n FROM supplier)""",
    "names_shortened": "SELECT p_partkey, CASE WHEN length(trim(p_name)) <= 12 THEN trim(p_name) ELSE rtrim(trim(p_name)[1:11]) || '…' END AS short FROM part",
}
