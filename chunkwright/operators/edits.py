"""Edits of source texts as previews: imports, symbols, parameters, patches and rules that mend common faults.

Null texts stay null; a text to which an edit doesn't apply comes back as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How a language imports a module (fixed values).
IMPORT_LINE = {"python": "import {}", "javascript": "import '{}';", "typescript": "import '{}';", "java": "import {};", "go": 'import "{}"', "rust": "use {};"}
IMPORT_PATTERN = r"^\s*(?:import\b|from\s+\S+\s+import\b|use\s+\S+|const\s+\w+\s*=\s*require\s*\()"


def import_added(text: Column, module: str, language: str = "python") -> Column:
    """The text with an import after its last one, or at its top; a text that has it already stays."""
    line = IMPORT_LINE[language].format(module)
    lines = F.split(text, "\n")
    last = F.coalesce(F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(IMPORT_PATTERN), i + 1).otherwise(0))), F.lit(0))
    return F.when(F.array_contains(lines, line), text).otherwise(F.array_join(F.concat(F.slice(lines, F.lit(1), last), F.array(F.lit(line)), F.slice(lines, last + 1, 2**30)), "\n"))


def import_removed(text: Column, module: str) -> Column:
    """The text without the lines that import ``module``."""
    m = re.escape(module)
    drop = rf"""^\s*(?:import\s+{m}(?:\s+as\s+\w+)?\s*;?\s*$|from\s+{m}\s+import\b|import\s.*from\s+['"]{m}['"]|use\s+{m}\b|.*require\s*\(\s*['"]{m}['"]\s*\))"""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(drop)), "\n")


def renamed(text: Column, old: str, new: str) -> Column:
    """The text with the whole word ``old`` replaced."""
    return F.regexp_replace(text, rf"\b{re.escape(old)}\b", new)


def parameter_added(text: Column, function: str, parameter: str) -> Column:
    """The text with a parameter at the end of the signature of a Python function."""
    f = re.escape(function)
    return F.regexp_replace(F.regexp_replace(text, rf"(\bdef\s+{f}\s*\()\s*\)", f"$1{parameter})"), rf"(\bdef\s+{f}\s*\((?!\s*{re.escape(parameter)}\))[^()]*[^()\s,])\s*,?\s*\)", f"$1, {parameter})")


def symbol_edited(text: Column, symbol: str, body: str) -> Column:
    """The text with the Python definition of ``symbol``, from its first line to the last line indented deeper, replaced by ``body`` at its indentation.

    Lines of ``body`` are indented as the definition is; a text without the definition stays.
    """
    lines = F.split(text, "\n")
    head = rf"^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+{re.escape(symbol)}\b"
    at = F.coalesce(F.array_min(F.transform(lines, lambda x, i: F.when(x.rlike(head), i))), F.lit(-1))
    width = lambda x: F.length(F.regexp_extract(x, r"^\s*", 0))
    own = width(F.get(lines, at))
    stop = F.coalesce(F.array_min(F.transform(lines, lambda x, i: F.when((i > at) & (F.length(F.trim(x)) > 0) & (width(x) <= own) & ~x.rlike(r"^\s*\)"), i))), F.size(lines))
    # Blank lines before what follows belong to it.
    last = F.array_max(F.transform(F.slice(lines, F.lit(1), stop), lambda x, i: F.when(F.length(F.trim(x)) > 0, i + 1)))
    pad = F.repeat(F.lit(" "), own)
    new = F.transform(F.array(*[F.lit(x) for x in body.split("\n")]), lambda x: F.when(F.length(x) > 0, F.concat(pad, x)).otherwise(x))
    return F.when(at < 0, text).otherwise(F.array_join(F.concat(F.slice(lines, F.lit(1), at), new, F.slice(lines, last + 1, 2**30)), "\n"))


def method_extracted(text: Column, first: int, last: int, name: str) -> Column:
    """The text with its lines ``first`` to ``last`` (from 1) moved into a function ``name`` at the end, and a call in their place.

    A text of fewer lines stays.
    """
    lines = F.split(text, "\n")
    moved = F.slice(lines, first, last - first + 1)
    indent = F.regexp_extract(F.get(moved, 0), r"^\s*", 0)
    body = F.transform(moved, lambda x: F.when(F.length(F.trim(x)) == 0, F.lit("")).when(F.startswith(x, indent), F.concat(F.lit("    "), F.substring(x, F.length(indent) + 1, F.length(x)))).otherwise(F.concat(F.lit("    "), F.ltrim(x))))
    call = F.array(F.concat(indent, F.lit(f"{name}()")))
    kept = F.concat(F.slice(lines, 1, first - 1), call, F.slice(lines, last + 1, 2**30))
    return F.when(F.size(lines) < last, text).otherwise(F.array_join(F.concat(kept, F.array(F.lit(""), F.lit(""), F.lit(f"def {name}():")), body), "\n"))


def mended(text: Column) -> Column:
    """The text with bare handlers made to name Exception, comparisons with None by identity and no trailing white space."""
    out = F.regexp_replace(text, r"\bexcept\s*:", "except Exception:")
    out = F.regexp_replace(F.regexp_replace(out, r"==\s*None\b", "is None"), r"!=\s*None\b", "is not None")
    return F.regexp_replace(out, r"(?m)[ \t]+$", "")


def rule_findings(chunks: DataFrame) -> DataFrame:
    """chunk_id, line, rule: lines that the rules of all languages would change: files opened without a with, methods of Java without a visibility and
    definitions without documentation on the line above (or, in Python, below)."""
    lines = chunks.filter("text IS NOT NULL").select("chunk_id", "start_line", F.lower(F.trim("language")).alias("lang"), F.split("text", "\n").alias("l"))
    each = lines.select("chunk_id", "start_line", "lang", "l", F.posexplode("l").alias("n", "body")).withColumn("above", F.trim(F.get("l", F.col("n") - 1))).withColumn("below", F.trim(F.get("l", F.col("n") + 1)))
    python, java = F.col("lang") == "python", F.col("lang") == "java"
    definition = F.when(python, F.col("body").rlike(r"^\s*(?:async\s+)?def\s+\w+.*:\s*$")).when(java, F.col("body").rlike(r"^\s*(?:public|private|protected)\s+[\w<>\[\]., ]+\(.*\{\s*$")).when(F.col("lang") == "go", F.col("body").rlike(r"^func\s")).when(F.col("lang") == "javascript", F.col("body").rlike(r"^\s*(?:export\s+)?(?:async\s+)?function\s+\w+"))
    documented = F.when(python, F.coalesce(F.col("below").rlike(r"^[rRuU]?(?:\"|')"), F.lit(False))).otherwise(F.coalesce(F.col("above").rlike(r"^(?://|/\*|\*|@)|\*/$"), F.lit(False)))
    rules = F.array(
        F.when(python & F.col("body").rlike(r"^\s*\w+\s*=\s*open\s*\("), F.lit("resource_open")),
        F.when(java & F.col("body").rlike(r"^\s+(?:static\s+|final\s+)*(?:void|int|long|boolean|double|String|[A-Z]\w*(?:<[^>]*>)?)\s+\w+\s*\([^;]*\)\s*\{\s*$"), F.lit("add_visibility")),
        F.when(F.coalesce(definition, F.lit(False)) & ~documented, F.lit("add_documentation")),
    )
    return each.select("chunk_id", (F.col("start_line") + F.col("n")).alias("line"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def renames_previewed(chunks: DataFrame, old: str, new: str) -> DataFrame:
    """buffer_id, chunk_id, file, line, before, after: the lines that a renaming would change; nothing is written."""
    from .graph import buffered

    rows = buffered(chunks).filter(F.col("text").contains(old)).select("buffer_id", "chunk_id", "file", "start_line", F.posexplode(F.split("text", "\n")).alias("n", "before"))
    return rows.select("buffer_id", "chunk_id", "file", (F.col("start_line") + F.col("n")).alias("line"), "before", renamed(F.col("before"), old, new).alias("after")).filter("before <> after")


def patched(files: DataFrame, patches: DataFrame, key: str = "path", text: str = "content", fuzz: int = 3) -> DataFrame:
    """key, patched, applied: files with a unified diff (key, patch) applied; hunks may lie up to ``fuzz`` lines off.

    A patch of which any hunk doesn't fit leaves its file as it is.
    """
    import pandas as pd

    head = re.compile(r"@@ -(\d+)(?:,\d+)? \+\d+(?:,\d+)? @@")

    def apply(body: str, patch: str) -> tuple[str, bool]:
        lines, shift, hunks, now = body.split("\n"), 0, [], None
        for line in patch.split("\n"):
            if m := head.match(line):
                now = (int(m[1]) - 1, [], [])
                hunks.append(now)
            elif now is not None and line[:1] in (" ", "-", "+", ""):
                if line[:1] != "+" and line:
                    now[1].append(line[1:])
                if line[:1] != "-" and line:
                    now[2].append(line[1:])
        for at, old, new in hunks:
            spots = [at + shift + d for k in range(fuzz + 1) for d in ((k, -k) if k else (0,))]
            spot = next((s for s in spots if 0 <= s and lines[s : s + len(old)] == old), None)
            if spot is None:
                return body, False
            lines[spot : spot + len(old)] = new
            shift += len(new) - len(old)
        return "\n".join(lines), bool(hunks)

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(k, *apply(t or "", p or "")) for k, t, p in zip(b["k"], b["t"], b["p"], strict=True)], columns=[key, "patched", "applied"])

    rows = files.select(F.col(key).alias("k"), F.col(text).alias("t")).join(patches.select(F.col(key).alias("k"), F.col("patch").alias("p")), "k")
    return rows.mapInPandas(run, f"{key} {rows.schema['k'].dataType.simpleString()}, patched STRING, applied BOOLEAN")


#: What each role may do (fixed values).
PERMISSIONS = {
    "admin": ["create_buffer", "delete_buffer", "write_code", "commit", "discard", "reload_codebase", "search", "read_code", "embed_codebase", "view_audit_log"],
    "agent": ["create_buffer", "delete_buffer", "write_code", "commit", "discard", "reload_codebase", "search", "read_code", "embed_codebase"],
    "analyst": ["create_buffer", "delete_buffer", "write_code", "commit", "discard", "reload_codebase", "search", "read_code", "embed_codebase"],
    "reader": ["search", "read_code"],
    "guest": ["search", "read_code"],
}
#: Permissions that roles other than admin have for their own buffers only (fixed values).
OWN_ONLY = ["delete_buffer", "write_code", "commit", "discard", "reload_codebase", "embed_codebase"]


def permission_table(spark: SparkSession) -> DataFrame:
    """role, permission, own_only: the permissions of all roles."""
    return spark.createDataFrame([(role, p, role != "admin" and p in OWN_ONLY) for role, own in PERMISSIONS.items() for p in own], "role STRING, permission STRING, own_only BOOLEAN")


def denied(audit: DataFrame, needs: dict[str, str] | None = None, owners: DataFrame | None = None) -> DataFrame:
    """The audit rows whose role lacks the permission that the operation needs, by ``needs`` or, if it is the name of a permission, itself.

    With ``owners`` (buffer_id, owner) also those that would touch a buffer of another user with a permission for own buffers only. Operations that need
    no permission aren't judged; unknown and null roles have none.
    """
    every = sorted({p for own in PERMISSIONS.values() for p in own})
    need = F.create_map(*[F.lit(x) for pair in (needs or {p: p for p in every}).items() for x in pair])
    may = F.create_map(*[x for role, own in PERMISSIONS.items() for x in (F.lit(role), F.array(*map(F.lit, own)))])
    wanted = F.try_element_at(need, F.col("operation"))
    allowed = F.coalesce(F.array_contains(F.try_element_at(may, F.lower("role")), wanted), F.lit(False))
    if owners is None:
        return audit.filter(wanted.isNotNull() & ~allowed)
    rows = audit.join(owners.select("buffer_id", F.col("owner").alias("__owner")), "buffer_id", "left")
    foreign = wanted.isin(OWN_ONLY) & (F.lower("role") != "admin") & F.col("__owner").isNotNull() & ~F.col("user_id").eqNullSafe(F.col("__owner"))
    return rows.filter(wanted.isNotNull() & (~allowed | foreign)).drop("__owner").select(*audit.columns)


#: Profiles: least and greatest number of lines, whether tests are kept, and kinds of chunk that come first or last (fixed values).
PROFILES = {
    "reviewer": (3, 300, False, [], ["test", "example", "vendor", "internal"]),
    "debugger": (1, 80, True, ["exception_handler", "assertion", "debug_statement"], ["docstring_details", "vendor", "comment", "example"]),
    "architect": (3, 150, False, [], ["private_method", "test", "implementation_detail", "vendor", "docstring_implementation"]),
    "documenter": (5, 400, False, ["docstring", "example", "usage_example"], ["vendor", "internal_implementation"]),
    "generic": (3, 250, False, [], ["vendor"]),
}


def profiled(chunks: DataFrame, profiles: dict[str, tuple] = PROFILES) -> DataFrame:
    """profile, chunk_id, priority, rank: the chunks (with score) that each profile keeps, by falling priority: the score, times 1.5 for kinds that it
    prefers and .2 for those it leaves out."""
    n, test = F.col("end_line") - F.col("start_line") + 1, F.lower("file").contains("test")
    each = []
    for name, (least, most, tests, first, last) in profiles.items():
        priority = F.col("score") * F.when(F.col("type").isin(first), 1.5).otherwise(1.0) * F.when(F.col("type").isin(last), 0.2).otherwise(1.0)
        each.append(F.when(n.between(least, most) & (F.lit(tests) | ~test), F.struct(F.lit(name).alias("profile"), F.round(priority, 6).alias("priority"))))
    rows = chunks.select("chunk_id", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("priority"), "chunk_id")))
