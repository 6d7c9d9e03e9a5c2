"""Queries of signatures, types, documentation and the public interface, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import interfaces as I
from ..sources.tables import table
from .edit_queries import EMBED
from .graph_queries import CALL, LOOSE, chunks_of, impact_sql
from .registry import query
from .search_queries import ASKED, DOT, SCORED, TOKENS, bm25_chunks, top

#: Common SQL: every definition of the chunks with its parameters; those of the data hold no strings or brackets but of types.
SIG = r"""
    heads AS (SELECT buffer_id, chunk_id, file, text, unnest(regexp_extract_all(text, '(?ms)^[ \t]*(?:async\s+)?def\s+[A-Za-z_]\w*\s*\([^()]*\)[^:]*:')) AS h, generate_subscripts(regexp_extract_all(text, '(?ms)^[ \t]*(?:async\s+)?def\s+[A-Za-z_]\w*\s*\([^()]*\)[^:]*:'), 1) - 1 AS n FROM chunks WHERE text IS NOT NULL),
    cut AS (SELECT *, regexp_extract(h, 'def\s+(\w+)', 1) AS name, list_filter(list_transform(regexp_extract_all(regexp_extract(h, '(?s)\(([^()]*)\)', 1), '(?:[^,\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p NOT IN ('', 'self', 'cls', '*', '**', '/')) AS ps,
      nullif(trim(regexp_extract(h, '(?s)\)\s*->\s*(.*?)\s*:$', 1)), '') AS returns, regexp_matches(h, '^\s*async\s') AS is_async FROM heads),
    sig AS (SELECT buffer_id, chunk_id, file, n::INT AS n, name, list_transform(ps, lambda p: struct_pack(name := regexp_extract(p, '^\**\s*(\w+)', 1), type := nullif(trim(regexp_extract(p, '^\**\s*\w+\s*:\s*([^=]*)', 1)), ''), "default" := CASE WHEN contains(p, '=') THEN trim(regexp_extract(p, '=\s*(.*)$', 1)) END)) AS params, returns, is_async FROM cut)"""


@query("t9_signatures", f"WITH {SIG} SELECT * FROM sig")
def t9_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return I.signatures(chunks_of(spark, folder))


FIT = "(contains(lower({a}), '{p}') OR contains('{p}', lower({a})))"


@query("q20_type_search", f"""WITH {SIG}, s AS (SELECT *, coalesce({FIT.format(a='returns', p='dict')}, false) AS one, len(list_filter(params, lambda x: x.type IS NOT NULL AND {FIT.format(a='x.type', p='dict')})) > 0 AS two FROM sig),
    r AS (SELECT buffer_id, chunk_id, n, name, round(0.3 * one::INT + 0.2 * two::INT, 3)::DOUBLE AS score FROM s WHERE one OR two) SELECT *, row_number() OVER (PARTITION BY buffer_id ORDER BY score DESC, chunk_id, n)::INT AS rank FROM r QUALIFY rank <= 10""")
def q20_type_search(spark: SparkSession, folder: str) -> DataFrame:
    return I.type_search(I.signatures(chunks_of(spark, folder)), "dict")


CALLABLE = "callable[[int, str], dict]"
KIND = "coalesce(lower(params[{i}].type), '')"


@query("q20_callable_search", f"""WITH {SIG}, s AS (SELECT *, coalesce({FIT.format(a='returns', p=CALLABLE)}, false) AS one, len(list_filter(params, lambda x: x.type IS NOT NULL AND {FIT.format(a='x.type', p=CALLABLE)})) > 0 AS two, len(params) = 2 AS three, coalesce(contains(lower(returns), 'dict'), false) AS four,
    len(params) >= 1 AND (contains({KIND.format(i=1)}, 'int') OR contains('int', {KIND.format(i=1)})) AS a, len(params) >= 2 AND (contains({KIND.format(i=2)}, 'str') OR contains('str', {KIND.format(i=2)})) AS b FROM sig),
    r AS (SELECT buffer_id, chunk_id, n, name, round(least(1.0, 0.3 * one::INT + 0.2 * two::INT + 0.3 * three::INT + 0.2 * four::INT + 0.1 * a::INT + 0.1 * b::INT), 3)::DOUBLE AS score FROM s WHERE one OR two OR three OR four) SELECT *, row_number() OVER (PARTITION BY buffer_id ORDER BY score DESC, chunk_id, n)::INT AS rank FROM r QUALIFY rank <= 10""")
def q20_callable_search(spark: SparkSession, folder: str) -> DataFrame:
    return I.type_search(I.signatures(chunks_of(spark, folder)), "Callable[[int, str], dict]")


def again(name: str) -> str:
    """The SQL of embeddings over the table ``name`` instead of the chunks, under names of its own."""
    sql = EMBED.replace("FROM chunks", f"FROM {name}")
    for x in ("tk", "ex", "pl", "nm", "emb"):
        sql = re.sub(rf"\b{x}\b", f"{x}_{name}", sql)
    return sql


SIGNED = "ft AS (SELECT c.buffer_id, c.name AS symbol, c.chunk_id, s.name || '(' || array_to_string(list_transform(s.params, lambda x: x.name || coalesce(': ' || x.type, '')), ', ') || ')' || coalesce(' -> ' || s.returns, '') AS text, s.returns FROM chunks c JOIN sig s ON s.chunk_id = c.chunk_id AND s.n = 0 WHERE c.name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c.buffer_id, c.name ORDER BY c.chunk_id) = 1)"


@query("r16_inferred_types", f"WITH {SIG}, {SIGNED}, {EMBED}, {again('ft')} SELECT ft.buffer_id, ft.symbol, ft.chunk_id, ft.text AS signature, ft.returns, round(({DOT.format(a='a.embedding', b='b.embedding')} + 1) / 2, 4) AS confidence FROM ft JOIN emb_ft a USING (chunk_id) JOIN emb b USING (chunk_id)")
def r16_inferred_types(spark: SparkSession, folder: str) -> DataFrame:
    return I.inferred_types(chunks_of(spark, folder))


@query("r14_documentation", f"""WITH {SIG}, f AS (SELECT buffer_id, name AS symbol, min(chunk_id) AS chunk_id FROM chunks WHERE name IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
    d AS (SELECT f.buffer_id, f.symbol, f.chunk_id, '\"\"\"' || f.symbol || ' documentation.' || CASE WHEN len(params) > 0 THEN chr(10) || chr(10) || 'Args:' || array_to_string(list_transform(params, lambda x: chr(10) || '    ' || x.name || ' (' || coalesce(x.type, 'Any') || ')' || coalesce(', default: ' || x."default", '')), '') ELSE '' END || coalesce(chr(10) || chr(10) || 'Returns:' || chr(10) || '    ' || returns, '') || chr(10) || '\"\"\"' AS docstring
      FROM f JOIN sig s ON s.chunk_id = f.chunk_id AND s.n = 0),
    u AS (SELECT buffer_id, t, n, use, regexp_extract(use, '^(\\w+)', 1) AS symbol FROM (SELECT buffer_id, chunk_id AS t, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*\\s*\\([^)]*\\)')) AS use, generate_subscripts(regexp_extract_all(text, '[A-Za-z_]\\w*\\s*\\([^)]*\\)'), 1) AS n FROM chunks WHERE contains(file, 'test') AND text IS NOT NULL)),
    v AS (SELECT buffer_id, symbol, use, row_number() OVER (PARTITION BY buffer_id, symbol ORDER BY t, n) AS r FROM u QUALIFY r <= 5), e AS (SELECT buffer_id, symbol, string_agg(use, chr(10) ORDER BY r) AS examples FROM v GROUP BY ALL)
    SELECT d.*, coalesce(e.examples, '') AS examples FROM d LEFT JOIN e USING (buffer_id, symbol)""".replace('\\"', '"'))
def r14_documentation(spark: SparkSession, folder: str) -> DataFrame:
    return I.generated_documentation(chunks_of(spark, folder))


API = "api AS (SELECT DISTINCT c.buffer_id, c.file, c.type, c.name AS symbol, coalesce(array_to_string(list_transform(s.params, lambda x: x.name), ','), '') AS params FROM chunks c LEFT JOIN sig s ON s.chunk_id = c.chunk_id AND s.n = 0 WHERE c.type IN ('function', 'method', 'class') AND c.text <> '' AND NOT starts_with(c.name, '_'))"


@query("r13_interface", f"WITH {SIG}, {API} SELECT * FROM api")
def r13_interface(spark: SparkSession, folder: str) -> DataFrame:
    return I.public_interface(chunks_of(spark, folder))


@query("r13_interface_changes", f"""WITH {SIG}, {API}, o AS (SELECT buffer_id, file, type, symbol, max(params) AS was FROM api GROUP BY ALL), n AS (SELECT buffer_id, file, type, CASE WHEN length(symbol) % 5 = 0 THEN symbol || '_v2' ELSE symbol END AS symbol, max(CASE WHEN length(symbol) % 3 = 0 AND params <> '' THEN 'extra,' || params WHEN length(symbol) % 7 = 0 THEN '' ELSE params END) AS now FROM api GROUP BY ALL),
    b AS (SELECT buffer_id, file, type, symbol, was, now, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was <> now THEN 'changed' END AS change FROM o FULL JOIN n USING (buffer_id, file, type, symbol))
    SELECT buffer_id, file, type, symbol, change, change = 'removed' OR (change = 'changed' AND now = '' AND was <> '') AS breaking, CASE WHEN change = 'changed' AND starts_with(now, 'extra,') THEN 'extra' ELSE '' END AS params_added FROM b WHERE change IS NOT NULL""")
def r13_interface_changes(spark: SparkSession, folder: str) -> DataFrame:
    old = I.public_interface(chunks_of(spark, folder))
    n = F.length("symbol")
    new = old.withColumn("params", F.when((n % 3 == 0) & (F.col("params") != ""), F.concat(F.lit("extra,"), F.col("params"))).when(n % 7 == 0, "").otherwise(F.col("params"))).withColumn("symbol", F.when(n % 5 == 0, F.concat("symbol", F.lit("_v2"))).otherwise(F.col("symbol")))
    return I.interface_changes(old, new)


#: The data have no try blocks, so each chunk gets one that names it.
TRIED = "tried AS (SELECT * REPLACE (text || chr(10) || 'try:' || chr(10) || '    ' || coalesce(name, 'x') || '()' || chr(10) || 'except E:' || chr(10) || '    pass' AS text) FROM chunks)"


@query("r17_error_contexts", f"WITH {TRIED}, " + r"""e AS (SELECT buffer_id, chunk_id, file, start_line, text, regexp_extract_all(text, '(?s)(.*?try:[ \t\r]*\n.*?\bexcept\b)', 1) AS p FROM tried WHERE regexp_matches(text, '(?s)try:[ \t\r]*\n.*?\bexcept\b')),
    o AS (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM e), q AS (SELECT buffer_id, file, start_line, p[n] AS piece, array_to_string(p[1:n - 1], '') AS upto FROM o),
    b AS (SELECT buffer_id, file, (start_line + length(upto || split_part(piece, 'try:', 1)) - length(replace(upto || split_part(piece, 'try:', 1), chr(10), '')))::INT AS line, regexp_extract(piece, '(?s)try:[ \t\r]*\n(.*?)\bexcept\b', 1) AS body FROM q)
    SELECT DISTINCT b.buffer_id, d.symbol, b.file, b.line, substr(regexp_replace(b.body, '^\s+|\s+$', '', 'g'), 1, 200) AS context FROM b JOIN (SELECT DISTINCT buffer_id, name AS symbol FROM chunks WHERE name IS NOT NULL) d ON b.buffer_id = d.buffer_id AND list_contains(regexp_extract_all(b.body, '[A-Za-z_$][A-Za-z0-9_$]*'), d.symbol)""")
def r17_error_contexts(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks_of(spark, folder)
    return G.error_contexts(c.withColumn("text", F.concat("text", F.lit("\ntry:\n    "), F.coalesce("name", F.lit("x")), F.lit("()\nexcept E:\n    pass")))).distinct()


@query("r15_change_template", impact_sql("SELECT buffer_id, symbol FROM defs").replace("WITH RECURSIVE", f"WITH RECURSIVE {TOKENS.strip().replace('df AS', 'dfs AS')}, {ASKED.strip()}, {SCORED.strip().replace('JOIN df d', 'JOIN dfs d')},", 1).rsplit("SELECT *, CASE WHEN risk", 1)[0] + f""", hits AS (SELECT * FROM {top('scored', 10)}), f1 AS (SELECT h.qid, c.buffer_id, c.file, min(h.rank) AS rank FROM hits h JOIN chunks c ON c.chunk_id = h.id GROUP BY ALL),
    f2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, buffer_id, file)::INT AS place FROM f1 QUALIFY place <= 5), rk AS (SELECT c.buffer_id, c.file, max(b.risk) AS risk FROM (SELECT DISTINCT buffer_id, file, name FROM chunks WHERE name IS NOT NULL) c JOIN b ON b.buffer_id = c.buffer_id AND b.symbol = c.name GROUP BY ALL),
    te AS (SELECT d.buffer_id, d.file, array_to_string(list_sort(list_distinct(list(k.file))), ',') AS tests FROM defs d JOIN calls k ON k.buffer_id = d.buffer_id AND k.callee = d.symbol WHERE {LOOSE.format(f='k.file')} GROUP BY ALL)
    SELECT qid, buffer_id, file, place, coalesce(risk, 0)::DOUBLE AS risk, coalesce(tests, '') AS tests FROM f2 LEFT JOIN rk USING (buffer_id, file) LEFT JOIN te USING (buffer_id, file)""")
def r15_change_template(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.text import is_test_file_loose

    c = chunks_of(spark, folder)
    d = G.definitions(c)
    called = G.call_sites(c).filter(is_test_file_loose(F.col("file"))).select("buffer_id", F.col("callee").alias("symbol"), F.col("file").alias("test_file"))
    tests = d.join(called, ["buffer_id", "symbol"]).select("buffer_id", "file", "test_file").distinct()
    return I.change_template(bm25_chunks(spark, folder, 10), c, G.impact(c, d.select("buffer_id", "symbol")), tests)
