"""Queries of the symbol and graph operators, over chunks and, for plain edges, over orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import table
from .registry import query

NAMES = r"regexp_extract_all({t}, '([A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|::)[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\(', 1)"
CALLED = "list_distinct(list_filter(" + NAMES + ", lambda x: x NOT IN ('if', 'while', 'for', 'switch', 'catch', 'assert')))"
CALL = f"""
    calls AS (SELECT DISTINCT buffer_id, chunk_id, file, caller, callee FROM (SELECT buffer_id, chunk_id, file, name AS caller, string_split(c, '.')[-1] AS callee FROM (SELECT buffer_id, chunk_id, file, name, unnest({CALLED.format(t='text')}) AS c FROM chunks WHERE text IS NOT NULL)) WHERE caller IS NULL OR callee <> caller),
    defs AS (SELECT buffer_id, name AS symbol, chunk_id, file, start_line, end_line FROM chunks WHERE name IS NOT NULL),
    edges AS (SELECT DISTINCT c.chunk_id AS src, d.dst, d.symbol FROM calls c JOIN (SELECT buffer_id, symbol, max(chunk_id) AS dst FROM defs GROUP BY buffer_id, symbol) d ON c.callee = d.symbol AND c.buffer_id = d.buffer_id WHERE c.chunk_id <> d.dst)"""
LOOSE = "(contains(lower({f}), 'test_') OR contains(lower({f}), '_test') OR contains(lower({f}), '/tests/') OR contains(lower({f}), '.spec.'))"


def chunks_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks")


@query("j1_call_edges", f"WITH {CALL} SELECT * FROM edges")
def j1_call_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.call_edges(chunks_of(spark, folder))


@query("j2_callees", f"WITH {CALL}, f AS (SELECT buffer_id, symbol, min_by(file, chunk_id) AS dfile FROM defs GROUP BY ALL) SELECT c.chunk_id, c.callee, coalesce(f.dfile, c.file) AS file, CASE WHEN f.dfile IS NULL THEN 'medium' ELSE 'high' END AS confidence FROM calls c LEFT JOIN f ON c.callee = f.symbol AND c.buffer_id = f.buffer_id")
def j2_callees(spark: SparkSession, folder: str) -> DataFrame:
    return G.callees(chunks_of(spark, folder))


IMPORTS = """imps AS (SELECT DISTINCT buffer_id, file, unnest(imports) AS module FROM chunks), i AS (SELECT buffer_id, file, replace(module, '.', '/') AS p, string_split(replace(module, '.', '/'), '/')[-1] AS tail FROM imps WHERE module IS NOT NULL),
    f AS (SELECT DISTINCT buffer_id, file AS target, regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM chunks),
    targets AS (SELECT DISTINCT i.buffer_id, i.file, f.target FROM i JOIN f ON i.buffer_id = f.buffer_id AND (contains(f.target, i.p) OR contains(f.stem, i.tail)) AND i.file <> f.target WHERE i.tail <> '')"""


@query("j3_import_targets", f"WITH {IMPORTS} SELECT * FROM targets")
def j3_import_targets(spark: SparkSession, folder: str) -> DataFrame:
    return G.import_targets(chunks_of(spark, folder))


@query("g6_dependencies", f"WITH {IMPORTS} SELECT DISTINCT buffer_id, file, 'outgoing' AS direction, module AS other FROM imps WHERE module IS NOT NULL UNION SELECT buffer_id, target, 'incoming', file FROM targets")
def g6_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return G.dependencies(chunks_of(spark, folder))


@query("g8_exported_graph", f"WITH {CALL}, {IMPORTS} SELECT buffer_id, 'node' AS kind, file AS src, NULL AS dst FROM chunks WHERE file IS NOT NULL UNION SELECT buffer_id, 'import', file, module FROM imps WHERE module IS NOT NULL UNION SELECT buffer_id, 'call', caller, callee FROM calls WHERE caller IS NOT NULL")
def g8_exported_graph(spark: SparkSession, folder: str) -> DataFrame:
    return G.exported_graph(chunks_of(spark, folder))


@query("j4_dead_code", f"WITH {CALL}, u AS (SELECT buffer_id, callee, count(DISTINCT chunk_id) AS callers FROM calls GROUP BY ALL) SELECT defs.buffer_id, symbol, chunk_id, coalesce(callers, 0) AS callers, CASE WHEN coalesce(callers, 0) = 0 THEN 'high' ELSE 'low' END AS confidence FROM defs LEFT JOIN u ON symbol = callee AND defs.buffer_id = u.buffer_id WHERE coalesce(callers, 0) <= 2")
def j4_dead_code(spark: SparkSession, folder: str) -> DataFrame:
    return G.dead_code(chunks_of(spark, folder))


@query("j5_unused_imports", f"""WITH e AS (SELECT DISTINCT buffer_id, chunk_id, file, module, regexp_extract(module, '[^./]*$') AS tail FROM (SELECT buffer_id, chunk_id, file, unnest(imports) AS module FROM chunks) WHERE module IS NOT NULL),
    w AS (SELECT DISTINCT buffer_id, file, unnest({CALLED.format(t='text')}) AS c FROM chunks)
    SELECT chunk_id, file, module FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.buffer_id = e.buffer_id AND w.file = e.file AND starts_with(w.c, e.tail))""")
def j5_unused_imports(spark: SparkSession, folder: str) -> DataFrame:
    return G.unused_imports(chunks_of(spark, folder))


@query("g1_definitions", "SELECT buffer_id, name AS symbol, chunk_id, file, start_line, end_line, CASE WHEN type IN ('function', 'nested_function', 'lambda') THEN 'function' WHEN type IN ('method', 'class', 'trait', 'interface', 'macro', 'module') THEN type ELSE 'variable' END AS kind FROM chunks WHERE name IS NOT NULL")
def g1_definitions(spark: SparkSession, folder: str) -> DataFrame:
    return G.definitions(chunks_of(spark, folder))


#: Dotted names: every third one has its file's stem before it, which no definition has.
ASKED_NAMES = "asked AS (SELECT DISTINCT buffer_id, CASE WHEN chunk_id % 3 = 0 THEN 'pkg.' || name ELSE name END AS asked FROM chunks WHERE name IS NOT NULL)"


@query("g1_dotted", f"""WITH {CALL}, {ASKED_NAMES}, h AS (SELECT a.buffer_id, a.asked, d.symbol, d.chunk_id, d.file, d.start_line, CASE WHEN d.symbol = a.asked THEN 1 ELSE 2 END AS way FROM asked a JOIN defs d ON a.buffer_id = d.buffer_id AND (d.symbol = a.asked OR d.symbol = string_split(a.asked, '.')[-1]))
    SELECT DISTINCT buffer_id, asked, symbol, chunk_id, file, start_line FROM h QUALIFY way = min(way) OVER (PARTITION BY buffer_id, asked)""")
def g1_dotted(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks_of(spark, folder)
    asked = c.filter("name IS NOT NULL").select("buffer_id", F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("pkg."), F.col("name"))).otherwise(F.col("name")).alias("asked"))
    return G.definition_of(c, asked)


@query("g2_references", r"""WITH l AS (SELECT buffer_id, file, start_line, text, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM chunks WHERE contains(text, 'token') AND (name IS NULL OR name <> 'token')), b AS (SELECT buffer_id, file, (start_line + n)::INT AS line, string_split(text, chr(10))[n + 1] AS body FROM l),
    r AS (SELECT buffer_id, file, line, CASE WHEN max(regexp_matches(body, '\btoken\b\s*\(')::INT) = 1 THEN 'high' ELSE 'medium' END AS confidence FROM b WHERE regexp_matches(body, '\btoken\b') GROUP BY ALL)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY buffer_id ORDER BY confidence, file, line) <= 50""")
def g2_references(spark: SparkSession, folder: str) -> DataFrame:
    return G.references(chunks_of(spark, folder), "token")


@query("g3_references", f"""WITH {CALL}, l AS (SELECT chunk_id, start_line, text, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM chunks WHERE text IS NOT NULL), b AS (SELECT chunk_id, start_line + n AS line, string_split(text, chr(10))[n + 1] AS body FROM l),
    u AS (SELECT chunk_id, line, trim(body, ' ') AS context, string_split(unnest({CALLED.format(t='body')}), '.')[-1] AS callee FROM b),
    f AS (SELECT chunk_id, callee, line, context FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id, callee ORDER BY line, context) = 1), s AS (SELECT c.*, f.line, f.context FROM calls c JOIN f USING (chunk_id, callee)),
    h AS (SELECT buffer_id, symbol AS callee, file AS hfile, start_line FROM defs QUALIFY row_number() OVER (PARTITION BY buffer_id, symbol ORDER BY chunk_id) = 1),
    r AS (SELECT DISTINCT s.buffer_id, s.callee AS symbol, 'incoming' AS direction, s.file, s.line, s.context, 'high' AS confidence FROM s JOIN (SELECT DISTINCT buffer_id, symbol FROM defs) d ON s.buffer_id = d.buffer_id AND s.callee = d.symbol
      UNION SELECT DISTINCT s.buffer_id, s.caller, 'outgoing', coalesce(h.hfile, s.file), coalesce(h.start_line, s.line), s.callee, CASE WHEN h.hfile IS NULL THEN 'medium' ELSE 'high' END FROM s LEFT JOIN h ON s.buffer_id = h.buffer_id AND s.callee = h.callee WHERE s.caller IS NOT NULL)
    SELECT buffer_id, symbol, direction, file, line::INT AS line, context, confidence FROM r QUALIFY row_number() OVER (PARTITION BY buffer_id, symbol, direction ORDER BY confidence, file, line, context) <= 50""")
def g3_references(spark: SparkSession, folder: str) -> DataFrame:
    return G.references_of_all(chunks_of(spark, folder))


EVERY = "starts AS (SELECT DISTINCT chunk_id AS start FROM chunks WHERE chunk_id % 100 = 0)"


@query("g4_g11_neighbourhood", f"""WITH RECURSIVE {CALL}, {EVERY}, walk AS (SELECT start, start AS node, 0 AS depth FROM starts UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.node = e.src WHERE w.depth < 3) SELECT start, node, min(depth)::INT AS depth FROM walk GROUP BY start, node""")
def g4_g11_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks_of(spark, folder)
    return G.reachable(G.call_edges(c), c.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("start")), 3)


@query("g9_dependency_graph", f"""WITH RECURSIVE {CALL}, {EVERY}, e AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT start, start AS node, 0 AS depth FROM starts UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN e ON w.node = e.src WHERE w.depth < 2),
    r AS (SELECT start, node FROM walk GROUP BY ALL) SELECT DISTINCT a.start, e.src, e.dst FROM r a JOIN r b USING (start) JOIN edges e ON e.src = a.node AND e.dst = b.node""")
def g9_dependency_graph(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks_of(spark, folder)
    return G.neighbourhood_graph(G.call_edges(c).select("src", "dst"), c.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("start")), 2)


@query("g10_paths", f"""WITH RECURSIVE {CALL}, starts AS (SELECT DISTINCT src AS start FROM edges), walk AS (SELECT start, [start] AS p, false AS cyclic FROM starts UNION SELECT w.start, list_append(w.p, e.dst), list_contains(w.p, e.dst) FROM walk w JOIN edges e ON w.p[-1] = e.src WHERE len(w.p) < 4 AND NOT w.cyclic) SELECT start, array_to_string(p, ' > ') AS path, cyclic FROM walk WHERE len(p) > 1""")
def g10_paths(spark: SparkSession, folder: str) -> DataFrame:
    edges = G.call_edges(chunks_of(spark, folder))
    return G.execution_paths(edges, edges.select(F.col("src").alias("start")).distinct(), 3)


@query("g10_branches", r"""WITH l AS (SELECT chunk_id, start_line, text, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM chunks WHERE text IS NOT NULL AND lower(trim(language)) = 'python'), b AS (SELECT chunk_id, (start_line + n)::INT AS line, string_split(text, chr(10))[n + 1] AS body FROM l)
    SELECT chunk_id, line, regexp_extract(body, '^\s*(if|elif|else|for|while|except)\b', 1) AS kind, trim(regexp_extract(body, '^\s*(?:if|elif|else|for|while|except)\b\s*(.*?)\s*:\s*(?:#.*)?$', 1)) AS condition FROM b WHERE regexp_matches(body, '^\s*(if|elif|else|for|while|except)\b.*:\s*(#.*)?$')""")
def g10_branches(spark: SparkSession, folder: str) -> DataFrame:
    return G.branches(chunks_of(spark, folder).filter("lower(trim(language)) = 'python'"))


#: Few imports of the data can be resolved, so edges between customers' numbers and nations stand beside those of files.
FILE_EDGES = "fe AS (SELECT buffer_id || '/' || file AS src, buffer_id || '/' || target AS dst FROM targets UNION SELECT 'c' || (c_custkey % 60), 'c' || c_nationkey FROM customer WHERE c_acctbal > 9000 AND c_custkey % 60 <> c_nationkey)"


@query("g7_cycles", f"""WITH RECURSIVE {IMPORTS}, {FILE_EDGES}, walk AS (SELECT [src, dst] AS p, false AS closed FROM fe WHERE dst > src UNION SELECT CASE WHEN e.dst = w.p[1] THEN w.p ELSE list_append(w.p, e.dst) END, e.dst = w.p[1] FROM walk w JOIN fe e ON w.p[-1] = e.src WHERE NOT w.closed AND len(w.p) <= 3 AND (e.dst = w.p[1] OR (len(w.p) < 3 AND e.dst > w.p[1] AND NOT list_contains(w.p, e.dst)))) SELECT DISTINCT array_to_string(p, ' > ') AS cycle FROM walk WHERE closed""")
def g7_cycles(spark: SparkSession, folder: str) -> DataFrame:
    t = G.import_targets(chunks_of(spark, folder))
    number = F.col("c_custkey") % 60
    more = table(spark, folder, "customer").filter("c_acctbal > 9000").select(F.concat(F.lit("c"), number).alias("src"), F.concat(F.lit("c"), "c_nationkey").alias("dst"))
    return G.cycles(t.select(F.concat_ws("/", "buffer_id", "file").alias("src"), F.concat_ws("/", "buffer_id", "target").alias("dst")).unionByName(more), 3)


@query("g5_call_chain", """WITH RECURSIVE e AS (SELECT DISTINCT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    walk AS (SELECT 'BUILDING' AS node, ['BUILDING'] AS p UNION SELECT e.dst, list_append(w.p, e.dst) FROM walk w JOIN e ON w.node = e.src WHERE len(w.p) < 4), b AS (SELECT p FROM walk WHERE node = 'EUROPE' ORDER BY len(p), p LIMIT 1)
    SELECT (n - 1)::INT AS step, p[n] AS node FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM b)""")
def g5_call_chain(spark: SparkSession, folder: str) -> DataFrame:
    n, r, c = (table(spark, folder, t) for t in ("nation", "region", "customer"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    down = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("src"), F.col("n_name").alias("dst"))
    return G.shortest_path(up.union(down), "BUILDING", "EUROPE")


@query("j6_owning_chunk", "SELECT s.file_id, s.line, arg_min(c.chunk_id, (c.start_line::BIGINT * 1000000000 + c.chunk_id)) AS chunk_id FROM (SELECT DISTINCT file_id, d.line AS line FROM (SELECT file_id, unnest(definitions) AS d FROM file_summaries)) s JOIN chunks c ON c.file_id = s.file_id AND s.line BETWEEN c.start_line AND c.end_line GROUP BY s.file_id, s.line")
def j6_owning_chunk(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "file_summaries").select("file_id", F.explode("definitions").alias("d")).select("file_id", F.col("d.line").alias("line")).distinct()
    return G.owning_chunk(chunks_of(spark, folder), lines)


RANGES = "ranges AS (SELECT s.buffer_id, s.path AS file, d.line AS b, d.line + 3 AS e FROM (SELECT file_id, unnest(definitions) AS d FROM file_summaries) x JOIN source_files s USING (file_id))"


def ranges_of(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files").select("file_id", "buffer_id", F.col("path").alias("file"))
    d = table(spark, folder, "file_summaries").select("file_id", F.explode("definitions").alias("d")).join(files, "file_id")
    return d.select("buffer_id", "file", F.col("d.line").alias("begin"), (F.col("d.line") + 3).alias("stop"))


@query("j7_overlapping", f"WITH {RANGES} SELECT DISTINCT c.buffer_id, c.chunk_id, c.file, c.name FROM chunks c JOIN ranges r ON c.buffer_id = r.buffer_id AND c.file = r.file AND c.start_line <= r.e AND c.end_line >= r.b")
def j7_overlapping(spark: SparkSession, folder: str) -> DataFrame:
    return G.overlapping(chunks_of(spark, folder), ranges_of(spark, folder))


@query("j15_coverage", f"WITH {CALL} SELECT d.buffer_id, d.file, d.start_line, d.end_line, count(DISTINCT t.chunk_id) AS tests, coalesce(array_to_string(list_sort(list_distinct(list(t.caller))), ','), '') AS names FROM defs d LEFT JOIN (SELECT * FROM calls WHERE {LOOSE.format(f='file')}) t ON t.callee = d.symbol AND t.buffer_id = d.buffer_id WHERE NOT {LOOSE.format(f='d.file')} GROUP BY d.buffer_id, d.file, d.start_line, d.end_line")
def j15_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return G.coverage(chunks_of(spark, folder))


def impact_sql(symbols: str) -> str:
    """SQL of the impact of the (buffer_id, symbol) that the query ``symbols`` gives."""
    return f"""WITH RECURSIVE {CALL}, {RANGES}, st AS (SELECT buffer_id, symbol, chunk_id AS start FROM defs WHERE (buffer_id, symbol) IN ({symbols})), walk AS (SELECT DISTINCT start, start AS node, 0 AS depth FROM st UNION SELECT w.start, e.src, w.depth + 1 FROM walk w JOIN (SELECT DISTINCT src, dst FROM edges) e ON w.node = e.dst WHERE w.depth < 6),
    hit AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0), r AS (SELECT st.buffer_id, st.symbol, h.node, h.depth, c.file, lower(regexp_extract(c.file, '[^/]*$')) AS n FROM st JOIN hit h USING (start) JOIN chunks c ON c.chunk_id = h.node),
    g AS (SELECT buffer_id, symbol, count(DISTINCT node) AS callers, count(DISTINCT file) AS files, count(*) FILTER (n IN ('main.py', 'app.py', 'api.py', 'server.py', '__init__.py', 'config.py', 'settings.py', 'middleware.py', 'models.py', 'schema.py', 'urls.py', 'router.py', 'views.py', 'controllers.py') OR contains(n, 'config') OR contains(n, 'main')) AS critical, max(depth) AS depth, count(*) FILTER (starts_with(n, 'test_') OR ends_with(n, '_test.py') OR contains(n, '.test.')) = 0 AS untested FROM r GROUP BY ALL),
    a AS (SELECT s.buffer_id, s.symbol, coalesce(callers, 0) AS callers, coalesce(files, 0) AS files, coalesce(critical, 0) AS critical, coalesce(depth, 0)::INT AS depth, coalesce(untested, true) AS untested FROM (SELECT DISTINCT buffer_id, symbol FROM st) s LEFT JOIN g USING (buffer_id, symbol)),
    b AS (SELECT *, round((CASE WHEN files = 0 THEN 0 WHEN files <= 3 THEN 0.05 WHEN files <= 8 THEN 0.15 ELSE 0.3 END + CASE WHEN depth >= 5 THEN 0.25 WHEN depth >= 3 THEN 0.15 WHEN depth >= 1 THEN 0.05 ELSE 0 END + least(0.25, 0.1 * critical) + CASE WHEN untested THEN 0.2 ELSE 0 END)::DOUBLE, 3) AS risk FROM a)
    SELECT *, CASE WHEN risk < 0.25 THEN 'low' WHEN risk < 0.6 THEN 'medium' ELSE 'high' END AS level FROM b"""


@query("g12_impact", impact_sql("SELECT buffer_id, symbol FROM defs"))
def g12_impact(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks_of(spark, folder)
    return G.impact(c, c.filter("name IS NOT NULL").select("buffer_id", F.col("name").alias("symbol")))


@query("g13_change_impact", impact_sql("SELECT c.buffer_id, c.name FROM chunks c JOIN ranges r ON c.buffer_id = r.buffer_id AND c.file = r.file AND c.start_line <= r.e AND c.end_line >= r.b WHERE c.name IS NOT NULL"))
def g13_change_impact(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks_of(spark, folder)
    return G.impact(c, G.overlapping(c, ranges_of(spark, folder)).filter("name IS NOT NULL").select("buffer_id", F.col("name").alias("symbol")))


@query("g14_impacted_tests", rf"""WITH {CALL}, ch AS (SELECT DISTINCT buffer_id, file, symbol FROM defs WHERE file IS NOT NULL), t AS (SELECT buffer_id, chunk_id, file AS test_file, text, imports FROM chunks WHERE text IS NOT NULL AND {LOOSE.format(f='file')}),
    w AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(text, '[A-Za-z_$][\w$]*')) AS word FROM t), f AS (SELECT DISTINCT buffer_id, file, CASE WHEN regexp_matches(regexp_extract(file, '[^/]*$'), '.\.[^.]+$') THEN regexp_replace(regexp_extract(file, '[^/]*$'), '\.[^.]+$', '') ELSE regexp_extract(file, '[^/]*$') END AS base FROM ch),
    p AS (SELECT f.buffer_id, f.file, t.chunk_id, t.test_file, (CASE WHEN contains(t.text, f.base) THEN 50 + CASE WHEN contains(t.text, f.file) THEN 50 ELSE 0 END ELSE 0 END) + CASE WHEN len(list_filter(t.imports, lambda x: contains(x, f.base))) > 0 THEN 20 ELSE 0 END AS points FROM f JOIN t ON f.buffer_id = t.buffer_id),
    s AS (SELECT p.buffer_id, p.file, c.symbol, p.test_file, p.points + CASE WHEN w.word IS NULL THEN 0 ELSE 40 + CASE WHEN k.callee IS NULL THEN 0 ELSE 30 END END AS score FROM p JOIN ch c ON p.buffer_id = c.buffer_id AND p.file = c.file LEFT JOIN w ON w.chunk_id = p.chunk_id AND w.word = c.symbol LEFT JOIN calls k ON k.chunk_id = p.chunk_id AND k.callee = c.symbol),
    m AS (SELECT buffer_id, file, symbol, test_file, max(score)::INT AS score FROM s WHERE score > 0 GROUP BY ALL) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY buffer_id, file, symbol ORDER BY score DESC, test_file) <= 20""")
def g14_impacted_tests(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks_of(spark, folder)
    return G.impacted_tests(c, G.definitions(c).select("buffer_id", "file", "symbol").distinct())


@query("g18_file_symbols", "SELECT buffer_id, file, count(*) AS symbols, count(DISTINCT name) AS names FROM chunks WHERE name IS NOT NULL GROUP BY ALL")
def g18_file_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return G.definitions(chunks_of(spark, folder)).groupBy("buffer_id", "file").agg(F.count("*").alias("symbols"), F.countDistinct("symbol").alias("names"))


@query("g19_symbol_metadata", rf"""WITH {CALL}, u AS (SELECT buffer_id, callee, count(DISTINCT chunk_id) AS called_by FROM calls GROUP BY ALL), m AS (SELECT chunk_id, count(*) AS calls_count FROM calls GROUP BY chunk_id), x AS (SELECT chunk_id, len(regexp_extract_all(text, '\b(if|elif|for|while|except|and|or|assert)\b')) + 1 AS complexity,
    regexp_extract(text, '(?s)["]{{3}}(.*?)["]{{3}}', 1) AS d1, regexp_extract(text, '(?s)['']{{3}}(.*?)['']{{3}}', 1) AS d2, trim(regexp_extract(text, '\)\s*->\s*([A-Za-z_][\w\[\], .]*)\s*:', 1)) AS ret FROM chunks)
    SELECT d.buffer_id, d.symbol, d.chunk_id, d.end_line - d.start_line + 1 AS loc, coalesce(u.called_by, 0) AS called_by, coalesce(m.calls_count, 0) AS calls_count, x.complexity::INT AS complexity, nullif(trim(CASE WHEN length(d1) > 0 THEN d1 ELSE d2 END, ' '), '') AS docstring, nullif(ret, '') AS returns
    FROM defs d JOIN x USING (chunk_id) LEFT JOIN u ON u.callee = d.symbol AND u.buffer_id = d.buffer_id LEFT JOIN m ON m.chunk_id = d.chunk_id""")
def g19_symbol_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return G.symbol_metadata(chunks_of(spark, folder))


@query("g17_full_context", f"""WITH {CALL}, u AS (SELECT d.buffer_id, d.symbol, count(DISTINCT c.chunk_id) FILTER (NOT {LOOSE.format(f='c.file')}) AS callers, coalesce(array_to_string(list_sort(list_distinct(list(c.file) FILTER ({LOOSE.format(f='c.file')}))), ','), '') AS tests FROM (SELECT DISTINCT buffer_id, symbol FROM defs) d LEFT JOIN calls c ON c.buffer_id = d.buffer_id AND c.callee = d.symbol GROUP BY ALL),
    o AS (SELECT buffer_id, caller AS symbol, coalesce(array_to_string(list_sort(list_distinct(list(callee))), ','), '') AS callees FROM calls WHERE caller IS NOT NULL GROUP BY ALL), h AS (SELECT buffer_id, symbol, chunk_id, file, start_line FROM defs QUALIFY row_number() OVER (PARTITION BY buffer_id, symbol ORDER BY chunk_id) = 1),
    t AS (SELECT c.buffer_id, n.symbol, count(*) AS errors FROM (SELECT buffer_id, chunk_id, unnest(regexp_extract_all(text, '(?s)try:[ \t\r]*\n(.*?)\bexcept\b', 1)) AS body FROM chunks WHERE text IS NOT NULL) c JOIN (SELECT DISTINCT buffer_id, symbol FROM defs) n ON c.buffer_id = n.buffer_id AND list_contains(regexp_extract_all(c.body, '[A-Za-z_$][A-Za-z0-9_$]*'), n.symbol) GROUP BY ALL)
    SELECT h.buffer_id, h.symbol, h.chunk_id, h.file, h.start_line, coalesce(u.callers, 0) AS callers, u.tests, coalesce(o.callees, '') AS callees, coalesce(t.errors, 0) AS errors FROM h LEFT JOIN u USING (buffer_id, symbol) LEFT JOIN o USING (buffer_id, symbol) LEFT JOIN t USING (buffer_id, symbol)""")
def g17_full_context(spark: SparkSession, folder: str) -> DataFrame:
    return G.full_context(chunks_of(spark, folder))
