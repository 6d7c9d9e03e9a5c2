"""Queries of the analyzers, audit aggregates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyzers as A
from ..sources.tables import table
from .registry import query


def rules_sql(rules: list[tuple[str, str, str]], flags: str = "i", least: str = "low") -> str:
    """SQL for the findings of ``rules``; rules with a look-ahead, which RE2 lacks, are matched without it and sifted."""
    parts = []
    for kind, severity, p in rules:
        if A.SEVERITY[severity] < A.SEVERITY[least] or "(?!" in p:
            continue
        q = p.replace("'", "''")
        parts.append(f"""SELECT chunk_id, file, start_line, text, '{kind}' AS kind, '{severity}' AS severity, regexp_extract_all(text, '(?s:.*?)(?{flags}:{q})') AS pieces, '^(?s:.*?)((?{flags}:{q}))$' AS tail FROM chunks WHERE regexp_matches(text, '(?{flags}:{q})')""")
    each = " UNION ALL ".join(
        f"""SELECT chunk_id, file, (start_line + length(before) - length(replace(before, chr(10), '')))::INT AS line, kind, severity, trim(string_split(text, chr(10))[length(before) - length(replace(before, chr(10), '')) + 1], ' ' || chr(9) || chr(13)) AS context FROM (
        SELECT *, substr(upto, 1, length(upto) - length(regexp_extract(pieces[n], {part.split("AS pieces, ")[1].split(" AS tail")[0]}, 1))) AS before FROM (SELECT *, array_to_string(pieces[1:n], '') AS upto FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS n FROM ({part}))))"""
        for part in parts
    )
    return each


def chunks_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks")


#: Code that the data have none of; queries of rules that would find nothing look at the chunks with this at their end.
PLANT = """
@deprecated
class Base(Root):
    pass
class Leaf(Base, Mixin):
    def run(self):
        url = os.environ.get('APP_URL', 'x')
        key = os.getenv("APP_KEY")
        cfg = load('conf/app.yaml')
        password = 'hunter22'
        for u in User.objects.all():
            for i in range(len(u)):
                f = open('x')
                cur.execute('q')
                warnings.warn('deprecated', DeprecationWarning)
        # DEPRECATED
        cache.set('a', 1)
@app.get('/users')
async def users(): pass
@app.route("/items", methods=['POST'])
@login
def items(): pass
"""
PLANTED = "planted AS (SELECT * REPLACE (text || '" + PLANT.replace("'", "''") + "' AS text) FROM chunks)"


def planted(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).withColumn("text", F.concat("text", F.lit(PLANT)))


def over_planted(sql: str) -> str:
    """``sql`` over the planted chunks."""
    sql = sql.replace("FROM chunks", "FROM planted").replace("JOIN chunks", "JOIN planted")
    return f"WITH {PLANTED}, " + sql[len("WITH ") :] if sql.startswith("WITH ") else f"WITH {PLANTED} {sql}"


@query("r1_security", rules_sql(A.SECURITY, least="medium"))
def r1_security(spark: SparkSession, folder: str) -> DataFrame:
    return A.found(chunks_of(spark, folder), A.SECURITY, least="medium")


@query("r4_hotspots", over_planted(rules_sql([r for r in A.HOTSPOTS if "(?!" not in r[2]], "s")))
def r4_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return A.found(planted(spark, folder), [r for r in A.HOTSPOTS if "(?!" not in r[2]], "s")


#: The two rules with a look-ahead, which RE2 lacks: an open( that no "with" follows, an execute( that no fetch follows, on to the end of the text.
AHEAD = [("unclosed_file", "high", r"open\s*\([^)]*\)\s*", "with"), ("full_table_scan", "medium", r"\.execute\s*\([^)]*\)\s*", None)]


def ahead_sql() -> str:
    """The planted text has one such call of each kind at its end and nothing that follows there; other chunks' calls are counted as they stand."""
    parts = []
    for kind, severity, p, word in AHEAD:
        rest = f"NOT starts_with(substr(text, length(upto) + 1), '{word}')" if word else "NOT regexp_matches(substr(text, length(upto) + 1), '(?s).*(fetchmany|fetchone)')"
        parts.append(f"""SELECT chunk_id, file, '{kind}' AS kind, '{severity}' AS severity, start_line, text, upto, regexp_extract(piece, '^(?s:.*?)((?s:{p}))$', 1) AS hit FROM (SELECT *, pieces[n] AS piece, array_to_string(pieces[1:n], '') AS upto FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS n FROM (SELECT chunk_id, file, start_line, text, regexp_extract_all(text, '(?s:.*?)(?s:{p})') AS pieces FROM chunks WHERE regexp_matches(text, '(?s:{p})')))) WHERE {rest}""")
    return f"""SELECT chunk_id, file, (start_line + length(b) - length(replace(b, chr(10), '')))::INT AS line, kind, severity, trim(string_split(text, chr(10))[length(b) - length(replace(b, chr(10), '')) + 1], ' ' || chr(9) || chr(13)) AS context FROM (SELECT *, substr(upto, 1, length(upto) - length(hit)) AS b FROM ({" UNION ALL ".join(parts)}))"""


@query("r4_open_and_execute", over_planted(ahead_sql()))
def r4_open_and_execute(spark: SparkSession, folder: str) -> DataFrame:
    return A.found(planted(spark, folder), [r for r in A.HOTSPOTS if "(?!" in r[2]], "s")


@query("r6_secrets", over_planted(rules_sql([("hardcoded_secret", "high", A.ASSIGNED_SECRET[4:])])))
def r6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return A.found(planted(spark, folder), [("hardcoded_secret", "high", A.ASSIGNED_SECRET[4:])])


LINES = "l AS (SELECT chunk_id, file, type, start_line, text, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM chunks WHERE text IS NOT NULL), lines AS (SELECT chunk_id, file, type, (start_line + n)::INT AS line, string_split(text, chr(10))[n + 1] AS body FROM l)"


@query("w5_nested_loops", f"""WITH {LINES}, loops AS (SELECT *, length(regexp_extract(body, '^\\s*')) AS indent FROM lines WHERE type IN ('function', 'method') AND trim(body) <> '' AND (contains(body, 'for ') OR contains(body, 'while ')))
    SELECT chunk_id, file, line, 'nested_loop' AS kind, 'medium' AS severity, trim(body) AS context FROM (SELECT *, lag(indent) OVER (PARTITION BY chunk_id ORDER BY line) AS above FROM loops) WHERE above > 0 AND indent > above""")
def w5_nested_loops(spark: SparkSession, folder: str) -> DataFrame:
    return A.nested_loops(chunks_of(spark, folder))


@query("r5_deprecated", over_planted(rules_sql(A.DEPRECATED)))
def r5_deprecated(spark: SparkSession, folder: str) -> DataFrame:
    return A.found(planted(spark, folder), A.DEPRECATED)


TODO_SQL = A.TODO.replace("'", "''")


@query("r11_todos", f"""WITH {LINES} SELECT * FROM (SELECT chunk_id, file, line, upper(regexp_extract(body, '{TODO_SQL}', 1)) AS tag, CASE WHEN upper(regexp_extract(body, '{TODO_SQL}', 1)) IN ('FIXME', 'XXX') THEN 'high' WHEN upper(regexp_extract(body, '{TODO_SQL}', 1)) = 'HACK' THEN 'medium' ELSE 'low' END AS priority,
    nullif(regexp_extract(body, '{TODO_SQL}', 2), '') AS assignee, trim(regexp_replace(regexp_extract(body, '{TODO_SQL}', 3), '\\r$', '')) AS todo FROM lines WHERE regexp_matches(body, '{TODO_SQL}')) WHERE todo <> ''""")
def r11_todos(spark: SparkSession, folder: str) -> DataFrame:
    return A.todos(chunks_of(spark, folder))


NESTING = r"coalesce(list_max(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(regexp_extract(x, '^\s*')))), 0) // 4"
PATHS = r"1 + len(regexp_extract_all(text, '\b(if|elif|for|while|except|and|or|assert)\b'))"
PARAMS = r"len(list_filter(string_split(regexp_extract(text, '(?s)def\s+\w+\s*\((.*?)\)', 1), ','), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g') NOT IN ('', 'self', 'cls')))"
SMELL = f"s AS (SELECT chunk_id, file, start_line AS line, type, name, text, len(string_split(text, chr(10))) AS lines, {NESTING} AS deep, {PATHS} AS paths, {PARAMS} AS params FROM chunks WHERE type IN ('function', 'nested_function', 'method', 'class') AND text <> '')"


@query("r2_smells", f"""WITH {SMELL} SELECT chunk_id, file, line, 'long_function' AS kind, CASE WHEN lines > 100 THEN 'high' ELSE 'medium' END AS severity, lines::INT AS value FROM s WHERE lines > 50
    UNION ALL SELECT chunk_id, file, line, 'deep_nesting', CASE WHEN deep > 5 THEN 'high' ELSE 'medium' END, deep::INT FROM s WHERE deep > 3
    UNION ALL SELECT chunk_id, file, line, 'missing_docstring', 'medium', 0 FROM s WHERE type <> 'class' AND name IS NOT NULL AND NOT contains(text, '\"\"\"') AND NOT contains(text, '''''''')
    UNION ALL SELECT chunk_id, file, line, 'complex_logic', CASE WHEN paths > 20 THEN 'high' ELSE 'medium' END, paths::INT FROM s WHERE paths > 10
    UNION ALL SELECT chunk_id, file, line, 'too_many_params', CASE WHEN params > 8 THEN 'high' ELSE 'medium' END, params::INT FROM s WHERE params > 5""")
def r2_smells(spark: SparkSession, folder: str) -> DataFrame:
    return A.smells(chunks_of(spark, folder))


@query("r3_refactorings", f"""WITH s AS (SELECT chunk_id, text, len(string_split(text, chr(10))) AS lines, {NESTING} AS deep, {PATHS} AS paths FROM chunks WHERE name IS NOT NULL AND text <> '')
    SELECT chunk_id, 'extract_method' AS kind, lines::INT AS value FROM s WHERE lines > 30 UNION ALL SELECT chunk_id, 'simplify', paths::INT FROM s WHERE paths > 8
    UNION ALL SELECT chunk_id, 'add_types', 0 FROM s WHERE contains(text, 'def ') AND NOT contains(text, '->') UNION ALL SELECT chunk_id, 'flatten', deep::INT FROM s WHERE deep > 3""")
def r3_refactorings(spark: SparkSession, folder: str) -> DataFrame:
    return A.refactorings(chunks_of(spark, folder))


ENV = A.ENV_READ.replace("'", "''")


@query("r6_configuration", over_planted(f"""WITH e AS (SELECT chunk_id, n, regexp_extract_all(text, '{ENV}', 1)[n] AS name, regexp_replace(trim(regexp_extract_all(text, '{ENV}', 2)[n]), '^["'']+|["'']+$', '', 'g') AS d FROM (SELECT chunk_id, text, unnest(range(1, len(regexp_extract_all(text, '{ENV}', 1)) + 1)) AS n FROM chunks WHERE text IS NOT NULL)),
    f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{A.CONFIG_FILE.replace("'", "''")}', 1)) AS name FROM chunks)
    SELECT 'env' AS kind, name, nullif(d, '') AS "default" FROM e QUALIFY row_number() OVER (PARTITION BY name ORDER BY chunk_id, n) = 1 UNION ALL SELECT 'file', name, NULL FROM f"""))
def r6_configuration(spark: SparkSession, folder: str) -> DataFrame:
    return A.configuration(planted(spark, folder))


ROUTE = A.ENDPOINT.replace("'", "''")


@query("r7_endpoints", over_planted(f"""SELECT chunk_id, upper(CASE WHEN lower(regexp_extract(h, '{ROUTE}', 1)) = 'route' THEN 'GET' ELSE regexp_extract(h, '{ROUTE}', 1) END) AS verb, regexp_extract(h, '{ROUTE}', 2) AS path, regexp_extract(h, '{ROUTE}', 3) AS handler FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '{ROUTE}')) AS h FROM chunks)"""))
def r7_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    return A.endpoints(planted(spark, folder))


@query("r8_cache_libraries", " UNION ALL ".join(f"SELECT '{x}' AS library, count(*) AS chunks FROM chunks WHERE contains(text, '{x}') HAVING count(*) > 0" for x in A.CACHE_LIBRARIES))
def r8_cache_libraries(spark: SparkSession, folder: str) -> DataFrame:
    return A.cache_libraries(chunks_of(spark, folder))


@query("r9_module_mutables", f"SELECT DISTINCT chunk_id, unnest(regexp_extract_all(text || chr(10) || 'CACHE = {{}}' || chr(10) || 'SEEN: list = []', '{A.MODULE_MUTABLE}', 1)) AS name FROM chunks WHERE type IN ('module', 'orphan') AND text IS NOT NULL")
def r9_module_mutables(spark: SparkSession, folder: str) -> DataFrame:
    return A.module_mutables(chunks_of(spark, folder).withColumn("text", F.concat("text", F.lit("\nCACHE = {}\nSEEN: list = []"))))


@query("r12_unresolved_imports", "WITH e AS (SELECT DISTINCT buffer_id, chunk_id, file, unnest(imports) AS module FROM chunks), s AS (SELECT DISTINCT buffer_id, regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM chunks) SELECT e.* FROM e WHERE module IS NOT NULL AND split_part(module, '.', 1) NOT IN (" + ", ".join(f"'{m}'" for m in A.KNOWN_MODULES) + ") AND NOT EXISTS (SELECT 1 FROM s WHERE s.buffer_id = e.buffer_id AND s.stem = split_part(e.module, '.', 1))")
def r12_unresolved_imports(spark: SparkSession, folder: str) -> DataFrame:
    return A.unresolved_imports(chunks_of(spark, folder))


@query("r8_r9_r10_flags", r"""SELECT chunk_id, regexp_matches(text, '(?i)cache\.(set|put|add)\s*\(') AND NOT regexp_matches(text, '(?i)(cache\.(delete|clear|invalidate)|\.(delete|invalidate)\s*\()') AS cache_write_unsafe,
    regexp_matches(text, '\w+\.(append|extend|update|pop|remove|clear|add)\s*\(') AND NOT regexp_matches(text, '(Lock|RLock|Semaphore|threading\.)') AS unlocked_mutation, len(regexp_extract_all(text, '(Lock|RLock)\s*\(\s*\)')) > 1 AS many_locks,
    type IN ('function', 'method', 'nested_function') AND regexp_matches(text, '\b(for|while)\b') AND regexp_matches(text, '\.append\s*\(') AND NOT regexp_matches(text, '(max_|limit|cap|size|len\(|break|return)') AS growth,
    regexp_matches(text, '\w+\s*=\s*open\s*\([^)]*\)') AND NOT contains(text, '.close()') AND NOT contains(text, 'with open') AS unclosed, regexp_matches(text, 'self\.(\w+)\s*=\s*self\b') AS self_reference FROM chunks WHERE text IS NOT NULL""")
def r8_r9_r10_flags(spark: SparkSession, folder: str) -> DataFrame:
    return A.chunk_flags(chunks_of(spark, folder))


@query("a8_logging", " UNION ALL ".join(rf"SELECT '{x}' AS level, coalesce(sum(len(regexp_extract_all(text, '\.{x}\s*\('))), 0)::BIGINT AS calls FROM chunks" for x in A.LOG_LEVELS))
def a8_logging(spark: SparkSession, folder: str) -> DataFrame:
    return A.logging_counts(chunks_of(spark, folder))


COUNTS = {"try": r"len(regexp_extract_all(text, '\btry\s*:'))", "bare_except": r"len(regexp_extract_all(text, 'except\s*:'))", "broad_except": r"len(regexp_extract_all(text, 'except\s+Exception\s*:'))", "silent_pass": r"len(regexp_extract_all(text, 'except\s+\w+\s*:\s*\n\s*pass'))", "missing_finally": r"((contains(text, 'open(') OR contains(text, 'connect(')) AND regexp_matches(text, '\btry\s*:') AND NOT contains(text, 'finally:') AND NOT contains(text, 'with '))::INT"}


@query("a9_errors", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (n > 0) AS chunks, sum(n)::BIGINT AS total FROM (SELECT {v} AS n FROM chunks WHERE text IS NOT NULL)" for k, v in COUNTS.items()))
def a9_errors(spark: SparkSession, folder: str) -> DataFrame:
    return A.error_handling(chunks_of(spark, folder))


DOCUMENTED = "(contains(text, repeat(chr(34), 3)) OR contains(text, repeat(chr(39), 3)))"


@query("a6_quality", f"""WITH r AS (SELECT buffer_id, file, chunk_id, start_line, name, len(string_split(text, chr(10))) AS lines, (type IN ('function', 'method', 'nested_function'))::INT AS f, CASE WHEN type IN ('function', 'method', 'nested_function') THEN len(regexp_extract_all(text, '\\b(if|for|while|and|or|except|with)\\b')) ELSE 0 END AS b,
    CASE WHEN type IN ('function', 'method', 'nested_function') THEN {NESTING} ELSE 0 END AS deep, (type IN ('function', 'method', 'nested_function') AND {DOCUMENTED})::INT AS d, (type IN ('function', 'method', 'nested_function') AND (contains(text, '->') OR contains(array_to_string(string_split(text, chr(10))[1:2], chr(10)), ': ')))::INT AS t FROM chunks WHERE text IS NOT NULL),
    s AS (SELECT buffer_id, file, start_line, chunk_id, unnest(list_filter([CASE WHEN d = 0 AND name IS NOT NULL THEN 'document' END, CASE WHEN b > 8 THEN 'split' END, CASE WHEN lines > 50 THEN 'extract' END], lambda x: x IS NOT NULL)) AS what FROM r WHERE f = 1),
    q AS (SELECT buffer_id, file, string_agg(what || ':' || chunk_id, ',' ORDER BY start_line, chunk_id, what) AS suggestions FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY buffer_id, file ORDER BY start_line, chunk_id, what) <= 10) GROUP BY ALL),
    g AS (SELECT buffer_id, file, sum(lines)::BIGINT AS lines, sum(f)::BIGINT AS functions, sum(b)::BIGINT AS branches, max(deep)::INT AS nesting, sum(b)::DOUBLE / greatest(sum(f), 1) AS a, sum(d)::DOUBLE / greatest(sum(f), 1) AS c, sum(t)::DOUBLE / greatest(sum(f), 1) AS ty FROM r GROUP BY ALL),
    h AS (SELECT *, CASE WHEN a < 4 THEN 'low' WHEN a < 8 THEN 'medium' ELSE 'high' END AS complexity, CASE WHEN c > 0.8 THEN 'high' WHEN c > 0.4 THEN 'medium' ELSE 'low' END AS documentation FROM g),
    k AS (SELECT *, (CASE complexity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END + CASE documentation WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) / 2.0 AS s FROM h)
    SELECT buffer_id, file, lines, functions, branches, round(a, 1) AS average, nesting, round(c, 2) AS documented, round(ty, 2) AS typed, complexity, documentation, CASE WHEN s < 1.5 THEN 'low' WHEN s < 2.5 THEN 'medium' ELSE 'high' END AS overall, coalesce(suggestions, '') AS suggestions FROM k LEFT JOIN q USING (buffer_id, file)""")
def a6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return A.quality(chunks_of(spark, folder))


@query("a5_summary", """SELECT buffer_id, file, count(name) AS definitions, coalesce(array_to_string(list_sort(list_distinct(list(name))), ','), '') AS names, coalesce(array_to_string(list_sort(list_distinct(flatten(list(imports)))), ','), '') AS imports, coalesce(array_to_string(list_sort(list_distinct(list(type))), ','), '') AS types, max(end_line) AS last_line, count(*) AS chunks FROM chunks GROUP BY ALL""")
def a5_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.file_summary(chunks_of(spark, folder))


@query("r12_r19_syntax")
def r12_r19_syntax(spark: SparkSession, folder: str) -> DataFrame:
    return A.syntax_facts(chunks_of(spark, folder))


@query("t1_calls", r"""SELECT chunk_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|::)[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\(', 1), lambda x: x NOT IN ('if', 'while', 'for', 'switch', 'catch', 'assert')))), ' ') AS calls FROM chunks WHERE text IS NOT NULL""")
def t1_calls(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", F.array_join(T.calls(F.col("text")), " ").alias("calls"))


@query("t2_imports", r"""SELECT chunk_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?m)^[ \t]*(?:from\s+[A-Za-z_][A-Za-z0-9_.]*\s+import|import\s+[A-Za-z_][A-Za-z0-9_.]*)'), lambda x: regexp_extract(x, '(?:from|import)\s+([A-Za-z_][A-Za-z0-9_.]*)', 1)))), ' ') AS imports FROM chunks WHERE text IS NOT NULL""")
def t2_imports(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", F.array_join(T.python_imports(F.col("text")), " ").alias("imports"))


@query("t3_t4_t6_measures", rf"""SELECT chunk_id, ({PATHS})::INT AS complexity, len(regexp_extract_all(text, '\b(if|for|while|and|or|except|with)\b'))::INT AS branches, ({NESTING})::INT AS nesting, greatest(1, length(text) // 4)::INT AS tokens FROM chunks WHERE text IS NOT NULL""")
def t3_t4_t6_measures(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("text")
    return chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", T.complexity(c).alias("complexity"), T.branches(c).alias("branches"), T.nesting(c).alias("nesting"), T.estimated_tokens(c).alias("tokens"))


@query("t5_docstrings", r"""SELECT chunk_id, trim(CASE WHEN length(regexp_extract(text, '(?s)\"\"\"(.*?)\"\"\"', 1)) > 0 THEN regexp_extract(text, '(?s)\"\"\"(.*?)\"\"\"', 1) ELSE regexp_extract(text, '(?s)''''''(.*?)''''''', 1) END) AS doc FROM chunks WHERE text IS NOT NULL AND trim(CASE WHEN length(regexp_extract(text, '(?s)\"\"\"(.*?)\"\"\"', 1)) > 0 THEN regexp_extract(text, '(?s)\"\"\"(.*?)\"\"\"', 1) ELSE regexp_extract(text, '(?s)''''''(.*?)''''''', 1) END) <> ''""".replace('\\"', '"'))
def t5_docstrings(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).select("chunk_id", T.docstring(F.col("text")).alias("doc")).filter("doc IS NOT NULL")


@query("t8_hashes", "SELECT chunk_id, sha256(text) AS sha, md5(text) AS md FROM chunks WHERE text IS NOT NULL")
def t8_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query("t13_stripped", rf"""SELECT chunk_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (trim(x) = '' OR starts_with(trim(x), '#!/') OR contains(trim(x), 'coding:') OR contains(trim(x), '-*-') OR contains(trim(x), '__all__') OR regexp_matches(trim(x), '{T.LICENSE_LINE}'))), chr(10)) AS body FROM chunks WHERE text IS NOT NULL""")
def t13_stripped(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.packing import stripped

    return chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", stripped(F.col("text")).alias("body"))


@query("t16_intents", "WITH h AS (SELECT doc_id, [" + ", ".join("{'category': '%s', 'n': %s}" % (k, " + ".join(f"contains(lower(text), '{w}')::INT" for w in v)) for k, v in T.INTENT_KEYWORDS.items()) + """] AS hits FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, hits, list_max(list_transform(hits, lambda x: x.n)) AS n FROM h) SELECT doc_id, CASE WHEN n > 0 THEN list_filter(hits, lambda x: x.n = list_max(list_transform(hits, lambda y: y.n)))[1].category ELSE 'unknown' END AS category, CASE WHEN n > 0 THEN least(0.95, 0.5 + n / 5.0) ELSE 0.3 END::DOUBLE AS confidence FROM b""")
def t16_intents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", T.intent(F.col("text")).alias("i")).select("doc_id", "i.category", "i.confidence")


@query("t17_rename", r"SELECT chunk_id, regexp_replace(text, '\btoken\b', 'ticket', 'g') AS text FROM chunks WHERE regexp_matches(text, '\btoken\b')")
def t17_rename(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).filter(F.col("text").rlike(r"\btoken\b")).select("chunk_id", F.regexp_replace("text", r"\btoken\b", "ticket").alias("text"))


@query("t22_elements", rf"""WITH {LINES} SELECT chunk_id, count(*) FILTER (regexp_matches(body, '^\s*(async\s+)?def\s')) AS defs, count(*) FILTER (regexp_matches(body, '\b(raise|throw|except|catch|panic)\b')) AS errors, count(*) FILTER (regexp_matches(body, '^\s*(#|//)')) AS comments, count(*) AS n FROM lines GROUP BY chunk_id""")
def t22_elements(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("body")
    return A.code_lines(chunks_of(spark, folder)).groupBy("chunk_id").agg(F.count_if(c.rlike(r"^\s*(async\s+)?def\s")).alias("defs"), F.count_if(c.rlike(r"\b(raise|throw|except|catch|panic)\b")).alias("errors"), F.count_if(c.rlike(r"^\s*(#|//)")).alias("comments"), F.count("*").alias("n"))


@query("pred3_pred4_files", r"""WITH f AS (SELECT DISTINCT file, lower(regexp_extract(file, '[^/]*$')) AS n FROM chunks) SELECT file, regexp_matches(regexp_extract(file, '[^/]*$'), '^(test_.*\.py|.*_test\.py|.*\.(test|spec)\.(js|ts|jsx|tsx)|.*_test\.rs|.*_test\.go|.*Test\.java)$') AS packing, starts_with(n, 'test_') OR ends_with(n, '_test.py') OR contains(n, '.test.') AS impact,
    contains(lower(file), 'test_') OR contains(lower(file), '_test') OR contains(lower(file), '/tests/') OR contains(lower(file), '.spec.') AS loose, n IN ('main.py', 'app.py', 'api.py', 'server.py', '__init__.py', 'config.py', 'settings.py', 'middleware.py', 'models.py', 'schema.py', 'urls.py', 'router.py', 'views.py', 'controllers.py') OR contains(n, 'config') OR contains(n, 'main') AS critical FROM f""")
def pred3_pred4_files(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("file")
    return chunks_of(spark, folder).select("file").distinct().select("file", T.is_test_file(c).alias("packing"), T.is_test_file_impact(c).alias("impact"), T.is_test_file_loose(c).alias("loose"), T.is_critical_file(c).alias("critical"))


@query("s6_languages", "WITH e AS (SELECT file_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS x FROM source_files) SELECT file_id, CASE x " + " ".join(f"WHEN '{e}' THEN '{lang}'" for lang, exts in T.LANGUAGE_BY_EXTENSION.items() for e in exts) + " END AS language FROM e")
def s6_languages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_files").select("file_id", T.language_of(F.col("path")).alias("language"))
