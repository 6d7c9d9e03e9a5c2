"""Row-level analyzers: rules over the texts of chunks that give findings, and counts by chunk or file.

A rule is a row (kind, severity, pattern, advice). All rules of a scan are looked for in one pass over the texts; a text
is exchanged with nothing, so a scan is a projection and an explode. Lines are those of the file. Null and empty texts
have no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .graph import buffered

# --- fixed values: the rules -------------------------------------------------------------------------------------
SECURITY = [
    ("eval_usage", "high", r"eval\s*\("),
    ("exec_usage", "high", r"exec\s*\("),
    ("shell_injection", "high", r"subprocess\.call\s*\(.*shell\s*=\s*True"),
    ("os_system", "high", r"os\.system\s*\("),
    ("unsafe_pickle", "high", r"pickle\.load\s*\("),
    ("unsafe_yaml", "high", r"yaml\.load\s*\((?!.*Loader)"),
    ("sql_injection", "high", r"sql.*%s|f['\"].*SELECT|\.format\s*\(.*SELECT"),
    ("hardcoded_secret", "high", r"secret|password|api_key|token\s*=\s*['\"]"),
    ("assert_usage", "medium", r"assert\s+"),
    ("broad_except", "medium", r"\bexcept\s*:"),
    ("wildcard_import", "low", r"import\s+\*|from\s+\w+\s+import\s+\*"),
]
HOTSPOTS = [
    ("n_plus_one", "high", r"for\s+\w+\s+in\s+.*\.all\(\)|for\s+\w+\s+in\s+.*\.filter\(\)"),
    ("unbounded_growth", "high", r"while\s+True\s*:.*\.append\("),
    ("missing_prefetch", "medium", r"\.select_related\s*\(\s*\)"),
    ("inefficient_loop", "low", r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\("),
    ("slow_serialization", "medium", r"import\s+pickle|pickle\.dump|pickle\.load"),
    ("regex_in_loop", "medium", r"re\.compile\s*\(\s*\)"),
    ("unclosed_file", "high", r"open\s*\([^)]*\)\s*(?!with)"),
    ("full_table_scan", "medium", r"\.execute\s*\([^)]*\)\s*(?!.*fetchmany|.*fetchone)"),
]
DEPRECATED = [
    ("decorator", "low", r"@deprecated\b"),
    ("warning", "low", r"warnings\.warn\s*\([^)]*deprecated"),
    ("comment", "low", r"#\s*DEPRECATED"),
    ("deprecation_warning", "low", r"DeprecationWarning"),
]
TODO = r"(?i)(TODO|FIXME|HACK|XXX|NOTE)\s*(?:\(([^)]+)\))?\s*[:\-]?\s*(.*)"
TODO_PRIORITY = {"FIXME": "high", "HACK": "medium", "XXX": "high", "TODO": "low", "NOTE": "low"}
LOG_LEVELS = ["debug", "info", "warning", "error", "critical"]
CACHE_LIBRARIES = ["redis", "memcache", "lru_cache", "functools", "cachetools", "diskcache"]
ENDPOINT = r"""(?is)@\w+\.(get|post|put|delete|patch|route)\s*\(\s*["']([^"']+)["'][^)]*\)\s*(?:\r?\n\s*@[^\n]*)*\s*(?:async\s+)?def\s+(\w+)"""
ERROR_PATTERNS = {"try": r"\btry\s*:", "bare_except": r"except\s*:", "broad_except": r"except\s+Exception\s*:", "silent_pass": r"except\s+\w+\s*:\s*\n\s*pass"}
CACHE_INVALIDATION = r"(?i)(cache\.(delete|clear|invalidate)|\.(delete|invalidate)\s*\()"
CACHE_WRITE = r"(?i)cache\.(set|put|add)\s*\("
MUTATION = r"\w+\.(append|extend|update|pop|remove|clear|add)\s*\("
LOCK = r"(Lock|RLock|Semaphore|threading\.)"
BOUND = r"(max_|limit|cap|size|len\(|break|return)"
MODULE_MUTABLE = r"(?m)^([A-Za-z_]\w*)\s*(?::[^=\n]+)?=\s*(?:\[|\{|list\(|dict\(|set\()"
KNOWN_MODULES = [
    "os", "sys", "re", "json", "logging", "pathlib", "typing", "dataclasses", "collections", "abc",
    "functools", "itertools", "datetime", "hashlib", "io", "contextlib", "asyncio", "subprocess", "shutil", "tempfile",
    "time", "math", "unittest", "copy", "ast", "importlib", "inspect", "textwrap", "enum", "http",
    "urllib", "email", "csv", "sqlite3", "fastapi", "pydantic", "uvicorn", "numpy", "torch", "sentence_transformers",
]
CONFIG_FILE = r"""["']([^"'\n]*\.(?:yaml|yml|toml|ini|cfg|conf|json))["']"""
ENV_READ = r"""os\.(?:environ\.get|getenv)\s*\(\s*["'](\w+)["']\s*(?:,\s*([^)]+))?\)"""
ASSIGNED_SECRET = r"""(?i)(?:secret|password|api_key|token|auth_key|private_key)\s*=\s*["'][^"']{4,}["']"""
SEVERITY = {"low": 0, "medium": 1, "high": 2}
# -----------------------------------------------------------------------------------------------------------------


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)


def located(rows: DataFrame, pieces: Column, tail: Column) -> DataFrame:
    """``rows`` with line, context and hit for each of the ``pieces`` of a text, which end with a match each.

    ``tail`` gives the match from the column ``piece``, a text up to the end of the match.
    """
    each = rows.withColumn("pieces", pieces).select(*rows.columns, "pieces", F.posexplode("pieces").alias("n", "piece")).withColumn("hit", tail)
    upto = F.array_join(F.slice("pieces", F.lit(1), F.col("n") + 1), "")
    before = F.substring(upto, F.lit(1), F.length(upto) - F.length("hit"))
    lines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    context = F.trim(F.regexp_replace(F.element_at(F.split("text", "\n"), lines.cast("int") + 1), r"^\s+|\s+$", ""))
    return each.withColumn("line", (F.col("start_line") + lines).cast("int")).withColumn("context", context).drop("pieces", "piece")


def found(chunks: DataFrame, rules: list[tuple[str, str, str]], flags: str = "i", least: str = "low") -> DataFrame:
    """chunk_id, file, line, kind, severity, context: one row for each match of each rule (kind, severity, pattern).

    Matches are those of a left-to-right scan; context is the line on which a match begins, without margins.
    """
    rules = [r for r in rules if SEVERITY[r[1]] >= SEVERITY[least]]
    own = {kind: f"(?{flags}:{p})" for kind, _, p in rules}
    # A piece is what stands between two matches together with the second; \G lets no search begin elsewhere, so that what
    # follows the last match is read once. Texts without a match aren't cut.
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(sev).alias("severity"), F.when(F.col("text").rlike(own[k]), F.regexp_extract_all("text", F.lit(rf"\G(?s:.*?){own[k]}"), 0)).alias("pieces")) for k, sev, _ in rules])
    rows = chunks.filter("text IS NOT NULL").select("chunk_id", "file", "start_line", "text", F.explode(F.filter(each, lambda r: r["pieces"].isNotNull())).alias("r"))
    rows = rows.select("chunk_id", "file", "start_line", "text", "r.kind", "r.severity", F.col("r.pieces").alias("cut"))
    tail = F.lit(None).cast("string")
    for k, _, _ in rules:
        tail = F.when(F.col("kind") == k, F.regexp_extract("piece", f"^(?s:.*?)({own[k]})$", 1)).otherwise(tail)
    return located(rows, F.col("cut"), tail).select("chunk_id", "file", "line", "kind", "severity", "context")


def nested_loops(chunks: DataFrame) -> DataFrame:
    """chunk_id, file, line, kind, severity, context: loop lines that are deeper than the loop line before them."""
    lines = code_lines(chunks.filter(F.col("type").isin("function", "method"))).filter(F.length(F.trim("body")) > 0)
    loops = lines.filter(F.col("body").contains("for ") | F.col("body").contains("while ")).withColumn("indent", F.length(F.regexp_extract("body", r"^\s*", 0)))
    w = Window.partitionBy("chunk_id").orderBy("line")
    return loops.withColumn("above", F.lag("indent").over(w)).filter("above > 0 AND indent > above").select("chunk_id", "file", "line", F.lit("nested_loop").alias("kind"), F.lit("medium").alias("severity"), F.trim("body").alias("context"))


def code_lines(chunks: DataFrame) -> DataFrame:
    """chunk_id, file, type, name, line, body: the lines of each chunk with their numbers in the file."""
    return chunks.filter("text IS NOT NULL").select("chunk_id", "file", "type", "name", "start_line", F.posexplode(F.split("text", "\n")).alias("n", "body")).select("chunk_id", "file", "type", "name", (F.col("start_line") + F.col("n")).alias("line"), "body")


def todos(chunks: DataFrame) -> DataFrame:
    """chunk_id, file, line, tag, priority, assignee, todo: the marks of work to be done, with a text each."""
    lines = code_lines(chunks).filter(F.col("body").rlike(TODO))
    tag = F.upper(F.regexp_extract("body", TODO, 1))
    who, what = F.regexp_extract("body", TODO, 2), F.trim(F.regexp_replace(F.regexp_extract("body", TODO, 3), r"\r$", ""))
    priority = F.when(tag.isin("FIXME", "XXX"), "high").when(tag == "HACK", "medium").otherwise("low")
    return lines.select("chunk_id", "file", "line", tag.alias("tag"), priority.alias("priority"), F.when(F.length(who) > 0, who).alias("assignee"), what.alias("todo")).filter("todo <> ''")


def parameters(text: Column) -> Column:
    """How many parameters the first Python signature of ``text`` has, apart from self and cls."""
    inside = F.regexp_extract(text, r"(?s)def\s+\w+\s*\((.*?)\)", 1)
    return F.size(F.filter(F.split(inside, ","), lambda p: ~F.regexp_replace(p, r"^\s+|\s+$", "").isin("", "self", "cls")))


def smells(chunks: DataFrame, kinds: list[str] | None = None, least: str = "low", types: tuple[str, ...] = ("function", "nested_function", "method", "class")) -> DataFrame:
    """chunk_id, file, line, kind, severity, value: long, deep, complex, undocumented and parameter-rich definitions."""
    lines = F.size(F.split("text", "\n"))
    rows = chunks.filter(F.col("type").isin(list(types)) & (F.length("text") > 0)).select("chunk_id", "file", F.col("start_line").alias("line"), "type", "name", "text", lines.alias("lines"), T.nesting(F.col("text")).alias("deep"), T.complexity(F.col("text")).alias("paths"), parameters(F.col("text")).alias("params"))
    level = lambda c, high: F.when(c > high, "high").otherwise("medium")
    undocumented = F.col("type").isin("function", "method", "nested_function") & F.col("name").isNotNull() & ~F.col("text").contains('"""') & ~F.col("text").contains("'''")
    each = F.array(
        F.when(F.col("lines") > 50, F.struct(F.lit("long_function").alias("kind"), level(F.col("lines"), 100).alias("severity"), F.col("lines").alias("value"))),
        F.when(F.col("deep") > 3, F.struct(F.lit("deep_nesting").alias("kind"), level(F.col("deep"), 5).alias("severity"), F.col("deep").alias("value"))),
        F.when(undocumented, F.struct(F.lit("missing_docstring").alias("kind"), F.lit("medium").alias("severity"), F.lit(0).alias("value"))),
        F.when(F.col("paths") > 10, F.struct(F.lit("complex_logic").alias("kind"), level(F.col("paths"), 20).alias("severity"), F.col("paths").alias("value"))),
        F.when(F.col("params") > 5, F.struct(F.lit("too_many_params").alias("kind"), level(F.col("params"), 8).alias("severity"), F.col("params").alias("value"))),
    )
    out = rows.select("chunk_id", "file", "line", F.inline(F.filter(each, lambda x: x.isNotNull()))).filter(severity_rank(F.col("severity")) >= SEVERITY[least])
    return out.filter(F.col("kind").isin(kinds)) if kinds else out


def refactorings(chunks: DataFrame) -> DataFrame:
    """chunk_id, kind, value: definitions over 30 lines, with over 8 paths, without a result type or nested over 3 deep."""
    rows = chunks.filter(F.col("name").isNotNull() & (F.length("text") > 0)).select("chunk_id", "text", F.size(F.split("text", "\n")).alias("lines"), T.complexity(F.col("text")).alias("paths"), T.nesting(F.col("text")).alias("deep"))
    each = F.array(
        F.when(F.col("lines") > 30, F.struct(F.lit("extract_method").alias("kind"), F.col("lines").alias("value"))),
        F.when(F.col("paths") > 8, F.struct(F.lit("simplify").alias("kind"), F.col("paths").alias("value"))),
        F.when(F.col("text").contains("def ") & ~F.col("text").contains("->"), F.struct(F.lit("add_types").alias("kind"), F.lit(0).alias("value"))),
        F.when(F.col("deep") > 3, F.struct(F.lit("flatten").alias("kind"), F.col("deep").alias("value"))),
    )
    return rows.select("chunk_id", F.inline(F.filter(each, lambda x: x.isNotNull())))


def configuration(chunks: DataFrame) -> DataFrame:
    """kind, name, default: environment variables that are read (the first read tells the default), and configuration files."""
    rows = chunks.filter("text IS NOT NULL")
    env = rows.select("chunk_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(ENV_READ), 1).alias("name"), F.regexp_extract_all("text", F.lit(ENV_READ), 2).alias("default"))).alias("n", "x")).select("chunk_id", "n", "x.name", F.regexp_replace(F.trim("x.default"), r"""^["']+|["']+$""", "").alias("default"))
    first = env.groupBy("name").agg(F.min_by(F.when(F.length("default") > 0, F.col("default")), F.struct("chunk_id", "n")).alias("default"))
    files = rows.select(F.explode(F.regexp_extract_all("text", F.lit(CONFIG_FILE), 1)).alias("name")).distinct()
    return first.select(F.lit("env").alias("kind"), "name", "default").unionByName(files.select(F.lit("file").alias("kind"), "name", F.lit(None).cast("string").alias("default")))


def endpoints(chunks: DataFrame) -> DataFrame:
    """chunk_id, verb, path, handler: HTTP routes by decorators, with the function below."""
    rows, route = chunks.filter(F.col("text").rlike(ENDPOINT)), ENDPOINT
    zipped = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(route), i).alias(n) for i, n in ((1, "verb"), (2, "path"), (3, "handler"))])
    return rows.select("chunk_id", F.explode(zipped).alias("x")).select("chunk_id", F.upper(F.when(F.lower("x.verb") == "route", "GET").otherwise(F.col("x.verb"))).alias("verb"), "x.path", "x.handler")


def logging_counts(chunks: DataFrame) -> DataFrame:
    """level, calls: how often each level is logged."""
    rows = chunks.filter("text IS NOT NULL").select(*[F.regexp_count("text", F.lit(rf"\.{level}\s*\(")).alias(level) for level in LOG_LEVELS])
    return rows.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in LOG_LEVELS]).unpivot([], LOG_LEVELS, "level", "calls")


def error_handling(chunks: DataFrame) -> DataFrame:
    """kind, chunks, total: try blocks, bare and broad handlers, silent passes and missing clean-up."""
    c = F.col("text")
    needs = (c.contains("open(") | c.contains("connect(")) & c.rlike(r"\btry\s*:") & ~c.contains("finally:") & ~c.contains("with ")
    counts = {k: F.regexp_count(c, F.lit(p)) for k, p in ERROR_PATTERNS.items()} | {"missing_finally": needs.cast("int")}
    rows = chunks.filter("text IS NOT NULL").select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("n")) for k, v in counts.items()])).alias("x")).select("x.*")
    return rows.groupBy("kind").agg(F.count_if(F.col("n") > 0).alias("chunks"), F.sum("n").cast("bigint").alias("total"))


def chunk_flags(chunks: DataFrame) -> DataFrame:
    """chunk_id, cache_write_unsafe, unlocked_mutation, many_locks, growth, unclosed, self_reference: risks of each chunk."""
    c = F.col("text")
    invalidates, writes, mutates, locks = (c.rlike(p) for p in (CACHE_INVALIDATION, CACHE_WRITE, MUTATION, LOCK))
    grows = F.col("type").isin("function", "method", "nested_function") & c.rlike(r"\b(for|while)\b") & c.rlike(r"\.append\s*\(") & ~c.rlike(BOUND)
    unclosed = c.rlike(r"\w+\s*=\s*open\s*\([^)]*\)") & ~c.contains(".close()") & ~c.contains("with open")
    return chunks.filter("text IS NOT NULL").select("chunk_id", (writes & ~invalidates).alias("cache_write_unsafe"), (mutates & ~locks).alias("unlocked_mutation"), (F.regexp_count(c, F.lit(r"(Lock|RLock)\s*\(\s*\)")) > 1).alias("many_locks"), F.coalesce(grows, F.lit(False)).alias("growth"), unclosed.alias("unclosed"), c.rlike(r"self\.(\w+)\s*=\s*self\b").alias("self_reference"))


def cache_libraries(chunks: DataFrame) -> DataFrame:
    """library, chunks: how many chunks speak of each cache library that any does."""
    return chunks.select(F.explode(F.filter(F.array(*[F.lit(x) for x in CACHE_LIBRARIES]), lambda x: F.contains(F.col("text"), x))).alias("library")).groupBy("library").agg(F.count("*").alias("chunks"))


def module_mutables(chunks: DataFrame, types: tuple[str, ...] = ("module", "orphan")) -> DataFrame:
    """chunk_id, name: mutable values that are assigned at the left margin of chunks outside of definitions."""
    return chunks.filter(F.col("type").isin(list(types)) & F.col("text").isNotNull()).select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MODULE_MUTABLE), 1))).alias("name"))


def unresolved_imports(chunks: DataFrame) -> DataFrame:
    """buffer_id, chunk_id, file, module: imports whose first part is neither the stem of a file of the buffer nor a known module."""
    b = buffered(chunks)
    stems = b.select("buffer_id", F.regexp_replace(T.base_name(F.col("file")), r"\.[^.]*$", "").alias("first")).distinct()
    each = b.select("buffer_id", "chunk_id", "file", F.explode("imports").alias("module")).filter("module IS NOT NULL").withColumn("first", F.substring_index("module", ".", 1))
    return each.filter(~F.col("first").isin(KNOWN_MODULES)).join(stems, ["buffer_id", "first"], "left_anti").select("buffer_id", "chunk_id", "file", "module").distinct()


def quality(chunks: DataFrame) -> DataFrame:
    """buffer_id, file, lines, functions, branches, average, nesting, documented, typed, complexity, documentation, overall, suggestions: quality of each file.

    suggestions has the first ten, by line, of functions without documentation, with over 8 branches or over 50 lines.
    """
    code = F.col("type").isin("function", "method", "nested_function")
    c = F.col("text")
    n_lines, branches = F.size(F.split(c, "\n")), T.branches(c)
    documented = c.contains('"""') | c.contains("'''")
    typed = c.contains("->") | F.array_join(F.slice(F.split(c, "\n"), 1, 2), "\n").contains(": ")
    advice = F.array(F.when(~documented & F.col("name").isNotNull(), F.lit("document")), F.when(branches > 8, F.lit("split")), F.when(n_lines > 50, F.lit("extract")))
    each = F.when(code, F.transform(F.filter(advice, lambda x: x.isNotNull()), lambda x: F.struct("start_line", "chunk_id", x.alias("what")))).otherwise(F.array().cast("array<struct<start_line: int, chunk_id: bigint, what: string>>"))
    rows = buffered(chunks).filter("text IS NOT NULL").select(
        "buffer_id", "file", n_lines.alias("lines"), code.cast("int").alias("f"), F.when(code, branches).otherwise(0).alias("b"), F.when(code, T.nesting(c)).otherwise(0).alias("deep"), (code & documented).cast("int").alias("d"), (code & typed).cast("int").alias("t"), each.alias("advice"),
    )
    by = rows.groupBy("buffer_id", "file").agg(F.sum("lines").alias("lines"), F.sum("f").cast("bigint").alias("functions"), F.sum("b").cast("bigint").alias("branches"), F.max("deep").alias("nesting"), F.sum("d").alias("docs"), F.sum("t").alias("types"), F.slice(F.array_sort(F.flatten(F.collect_list("advice"))), 1, 10).alias("advice"))  # of one file
    n = F.greatest(F.col("functions"), F.lit(1))
    by = by.withColumn("avg0", F.col("branches") / n).withColumn("cov0", F.col("docs") / n).withColumn("typ0", F.col("types") / n)
    by = by.withColumn("complexity", F.when(F.col("avg0") < 4, "low").when(F.col("avg0") < 8, "medium").otherwise("high")).withColumn("documentation", F.when(F.col("cov0") > 0.8, "high").when(F.col("cov0") > 0.4, "medium").otherwise("low"))
    score = (F.when(F.col("complexity") == "high", 1).when(F.col("complexity") == "medium", 2).otherwise(3) + F.when(F.col("documentation") == "low", 1).when(F.col("documentation") == "medium", 2).otherwise(3)) / 2
    told = F.array_join(F.transform("advice", lambda x: F.concat_ws(":", x["what"], x["chunk_id"])), ",")
    return by.select(
        "buffer_id", "file", "lines", "functions", "branches", F.round("avg0", 1).alias("average"), "nesting", F.round("cov0", 2).alias("documented"), F.round("typ0", 2).alias("typed"), "complexity", "documentation",
        F.when(score < 1.5, "low").when(score < 2.5, "medium").otherwise("high").alias("overall"), told.alias("suggestions"),
    )


def file_summary(chunks: DataFrame) -> DataFrame:
    """buffer_id, file, definitions, names, imports, types, last_line, chunks: what each file defines and imports."""
    types = F.transform(F.array_distinct(F.collect_list("type")), lambda t: t)
    by = buffered(chunks).groupBy("buffer_id", "file").agg(
        F.count_if(F.col("name").isNotNull()).alias("definitions"), F.concat_ws(",", F.array_sort(F.collect_set("name"))).alias("names"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_set("imports"))))).alias("imports"), F.concat_ws(",", F.array_sort(types)).alias("types"), F.max("end_line").alias("last_line"), F.count("*").alias("chunks"),
    )
    return by


#: Imports, calls and names that code from an untrusted place must not use (fixed values).
BANNED_IMPORTS = {"os", "sys", "subprocess", "socket", "shutil", "ctypes", "multiprocessing", "threading", "signal", "importlib"}
BANNED_CALLS = {"eval", "exec", "compile", "__import__", "open", "input", "globals", "locals", "vars", "getattr", "setattr", "delattr"}


def syntax_facts(chunks: DataFrame) -> DataFrame:
    """chunk_id, parses, violations ARRAY<STRING>: of Python chunks, whether they parse (without their margin) and what they use that is banned."""
    import ast
    import textwrap

    import pandas as pd

    def facts(batches):
        for b in batches:
            out = []
            for i, text in zip(b["chunk_id"], b["text"], strict=True):
                try:
                    tree = ast.parse(textwrap.dedent(text.replace("\r", "")))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    out.append((i, False, []))
                    continue
                bad = set()
                for node in ast.walk(tree):
                    if isinstance(node, ast.Import | ast.ImportFrom):
                        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""]
                        bad |= {f"import {n}" for n in names if n.split(".")[0] in BANNED_IMPORTS}
                    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in BANNED_CALLS:
                        bad.add(f"call {node.func.id}")
                    elif isinstance(node, ast.Attribute) and node.attr.startswith("__") and node.attr.endswith("__"):
                        bad.add(f"attribute {node.attr}")
                out.append((i, True, sorted(bad)))
            yield pd.DataFrame(out, columns=["chunk_id", "parses", "violations"])

    rows = chunks.filter((F.lower(F.trim("language")) == "python") & F.col("text").isNotNull())
    return rows.select("chunk_id", "text").mapInPandas(facts, "chunk_id BIGINT, parses BOOLEAN, violations ARRAY<STRING>")
