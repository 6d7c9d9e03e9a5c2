"""Scalar text functions as Column expressions; all are built-in functions, so they stay inside code generation.

A null argument gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: names that the operators must agree on --------------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    "python": ["py", "pyw"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cxx", "cc", "hpp"],
    "rust": ["rs"],
    "go": ["go"],
    "ruby": ["rb", "erb"],
    "php": ["php"],
    "csharp": ["cs"],
    "swift": ["swift"],
    "kotlin": ["kt", "kts"],
    "scala": ["scala", "sc"],
    "r": ["r"],
    "objective_c": ["m"],
    "objective_cpp": ["mm"],
    "bash": ["sh", "bash", "zsh"],
    "powershell": ["ps1"],
    "perl": ["pl", "pm"],
    "lua": ["lua"],
    "sql": ["sql"],
    "html": ["html", "htm"],
    "xml": ["xml"],
    "css": ["css", "less"],
    "scss": ["scss", "sass"],
    "json": ["json"],
    "yaml": ["yaml", "yml"],
    "toml": ["toml"],
    "ini": ["ini", "cfg"],
    "markdown": ["md", "rst"],
    "dockerfile": ["dockerfile"],
    "makefile": ["makefile", "mk"],
    "cmake": ["cmake"],
    "dart": ["dart"],
    "elm": ["elm"],
    "elixir": ["ex", "exs"],
    "erlang": ["erl", "hrl"],
    "fsharp": ["fs", "fsx", "fsi"],
    "groovy": ["groovy", "gradle"],
    "julia": ["jl"],
    "nim": ["nim"],
    "ocaml": ["ml", "mli"],
    "pascal": ["pas", "pp"],
    "tcl": ["tcl"],
    "hcl": ["tf", "hcl"],
    "verilog": ["v"],
    "systemverilog": ["sv"],
    "vhdl": ["vhd", "vhdl"],
}
LANGUAGE_ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "c++": "cpp", "cxx": "cpp", "rs": "rust", "rb": "ruby", "cs": "csharp", "kt": "kotlin", "objc": "objective_c", "objcpp": "objective_cpp", "shell": "bash", "ps": "powershell", "docker": "dockerfile"}
SHEBANGS = [("python", "python"), ("node", "javascript"), ("bash", "bash"), ("sh", "bash"), ("zsh", "bash"), ("ruby", "ruby"), ("perl", "perl"), ("php", "php"), ("lua", "lua"), ("rscript", "r")]
CRITICAL_FILES = [
    "main.py", "app.py", "api.py", "server.py", "__init__.py", "config.py", "settings.py", "middleware.py", "models.py", "schema.py", "urls.py", "router.py",
    "views.py", "controllers.py",
]
CALL_KEYWORDS = ["if", "while", "for", "switch", "catch", "assert"]
INTENT_KEYWORDS = {
    "feature_addition": ["add", "implement", "create", "new feature", "support", "enable", "introduce", "allow", "build", "develop"],
    "bug_fix": ["fix", "bug", "error", "crash", "break", "issue", "fail", "broken", "not working", "problem", "wrong", "incorrect"],
    "refactoring": ["refactor", "cleanup", "reorganize", "simplify", "improve", "restructure", "rename", "extract", "consolidate", "optimize", "performance"],
    "documentation": ["document", "docstring", "comment", "example", "explain", "readme", "guide", "tutorial", "api", "help"],
    "testing": ["test", "unittest", "coverage", "mock", "verify", "assert", "validate"],
    "optimization": ["optimize", "fast", "speed", "performance", "efficient", "memory", "cache", "reduce latency", "throughput"],
    "cleanup": ["cleanup", "remove", "delete", "dead code", "unused", "deprecate", "retire", "decommission"],
}
TEST_NAME_BY_LANGUAGE = {
    "python": r"^(test_.*\.py|.*_test\.py)$", "javascript": r"^.*\.(test|spec)\.(js|ts|jsx|tsx)$", "typescript": r"^.*\.(test|spec)\.(js|ts|jsx|tsx)$", "rust": r"^.*_test\.rs$", "go": r"^.*_test\.go$",
    "java": r"^.*Test\.java$", "cpp": r"^.*_test\.(cpp|cc|cxx)$",
}
TEST_NAME = r"^(test_.*\.py|.*_test\.py|.*\.(test|spec)\.(js|ts|jsx|tsx)|.*_test\.rs|.*_test\.go|.*Test\.java)$"
LICENSE_LINE = r"(?i)^\s*((#|//|\*\s).*(license|copyright|spdx)|#\s*this file is part of|#\s*all rights reserved)"
# -----------------------------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lexical tokens: runs of letters and digits, cut at ``_`` and before a capital that follows a small letter or digit."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("[A-Za-z0-9]+"), 0), F.lower)


def words(text: Column) -> Column:
    """Lower-case runs of ``[A-Za-z0-9_]``."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def shingles(w: Column, n: int = 4) -> Column:
    """Hashes of the distinct runs of ``n`` of the words ``w``; fewer words are one run, none are the empty one.

    The words are zipped with themselves moved on by 1 to n - 1, so ``w`` isn't evaluated again for each run.
    """
    moved = F.arrays_zip(*[(w if i == 0 else F.slice(w, i + 1, 2**30)).alias(f"w{i}") for i in range(n)])
    runs = F.transform(F.slice(moved, 1, F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda z: F.xxhash64(F.concat_ws(" ", *[z[f"w{i}"] for i in range(n)])))
    return F.array_distinct(F.when(F.size(w) > 0, runs).otherwise(F.array(F.xxhash64(F.lit("")))))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column, hint: Column | None = None, first_line: Column | None = None) -> Column:
    """Language by hint, else by extension, special file name or shebang; null if none tells."""
    ext = F.lower(F.regexp_extract(base_name(path), r"(?<=.)\.([^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for lang, exts in LANGUAGE_BY_EXTENSION.items() for e in exts for x in (e, lang)])
    name = F.lower(base_name(path))
    special = F.when(name.startswith("dockerfile"), "dockerfile").when(name.isin("makefile", "gnumakefile"), "makefile").when(name == "cmakelists.txt", "cmake")
    found = F.coalesce(F.try_element_at(table, ext), special)
    if first_line is not None:
        parts = F.split(F.element_at(F.split(first_line, "/"), -1), r"\s+")
        program = F.lower(F.when((F.lower(parts[0]) == "env") & (F.size(parts) > 1), parts[1]).otherwise(parts[0]))
        bang = F.when(~first_line.startswith("#!/"), None)
        for key, lang in SHEBANGS:
            bang = bang.when(program.contains(key), lang)
        found = F.coalesce(found, bang)
    if hint is None:
        return found
    alias = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
    told = F.lower(F.trim(hint))
    return F.when(F.length(told) > 0, F.coalesce(F.try_element_at(alias, told), told)).otherwise(found)


def is_test_file(path: Column) -> Column:
    """Test file by the base name, as packing judges it."""
    return base_name(path).rlike(TEST_NAME)


def is_test_file_of(path: Column, language: Column) -> Column:
    """Test file by the base name and language; false for languages without a rule."""
    out = F.lit(False)
    for lang, pattern in TEST_NAME_BY_LANGUAGE.items():
        out = F.when(language == lang, base_name(path).rlike(pattern)).otherwise(out)
    return out


def is_test_file_impact(path: Column) -> Column:
    """Test file as impact analysis judges it."""
    name = F.lower(base_name(path))
    return name.startswith("test_") | name.endswith("_test.py") | name.contains(".test.")


def is_test_file_loose(path: Column) -> Column:
    """Test file if the path speaks of tests anywhere."""
    p = F.lower(path)
    return p.contains("test_") | p.contains("_test") | p.contains("/tests/") | p.contains(".spec.")


def is_critical_file(path: Column) -> Column:
    name = F.lower(base_name(path))
    return name.isin(CRITICAL_FILES) | name.contains("config") | name.contains("main")


def is_boilerplate(line: Column) -> Column:
    s = F.trim(line)
    return (F.length(s) == 0) | s.startswith("#!/") | s.contains("coding:") | s.contains("-*-") | s.contains("__all__") | s.rlike(LICENSE_LINE)


def calls(text: Column) -> Column:
    """Distinct names that are followed by an opening bracket, in order, without keywords."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|::)[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\("), 1)
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: ~x.isin(CALL_KEYWORDS))))


def python_imports(text: Column) -> Column:
    """Distinct modules of import lines."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:from\s+[A-Za-z_][A-Za-z0-9_.]*\s+import|import\s+[A-Za-z_][A-Za-z0-9_.]*)"), 0), lambda x: F.regexp_extract(x, r"(?:from|import)\s+([A-Za-z_][A-Za-z0-9_.]*)", 1))
    return F.array_sort(F.array_distinct(found))


def script_imports(text: Column) -> Column:
    """Distinct modules of ``import … from`` and of ``require`` lines."""
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"""(?m)^[ \t]*import\s+[^\n]*?\s+from\s+['"]([^'"\n]+)['"]"""), 1), F.regexp_extract_all(text, F.lit(r"""\brequire\s*\(\s*['"]([^'"\n]+)['"]\s*\)"""), 1))))


def complexity(text: Column) -> Column:
    """1 and the number of branching keywords."""
    return 1 + F.regexp_count(text, F.lit(r"\b(if|elif|for|while|except|and|or|assert)\b"))


def branches(text: Column) -> Column:
    """Branching keywords as the quality score counts them."""
    return F.regexp_count(text, F.lit(r"\b(if|for|while|and|or|except|with)\b"))


def nesting(text: Column) -> Column:
    """Greatest indentation of a line that isn't blank, in steps of four."""
    widths = F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.length(F.regexp_extract(x, r"^\s*", 0)))
    return F.floor(F.coalesce(F.array_max(widths), F.lit(0)) / 4).cast("int")


def docstring(text: Column) -> Column:
    """The first triple-quoted text, or null."""
    double, single = F.regexp_extract(text, r'(?s)"""(.*?)"""', 1), F.regexp_extract(text, r"(?s)'''(.*?)'''", 1)
    found = F.trim(F.when(F.length(double) > 0, double).otherwise(single))
    return F.when(F.length(found) > 0, found)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the code points, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def normalized(text: Column) -> Column:
    """Lower case without any white space, as duplicates are compared."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def signature(text: Column) -> Column:
    """The first line."""
    return F.substring_index(text, "\n", 1)


def intent(text: Column) -> Column:
    """struct(category, confidence) by keywords; the first category of the most hits wins, none gives unknown at 0.3."""
    low = F.lower(text)
    hits = F.array(*[F.struct(F.lit(name).alias("category"), F.size(F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(low, k))).alias("n")) for name, keys in INTENT_KEYWORDS.items()])
    most = F.array_max(F.transform(hits, lambda h: h["n"]))
    best = F.filter(hits, lambda h: h["n"] == most)[0]
    return F.struct(F.when(most > 0, best["category"]).otherwise("unknown").alias("category"), F.when(most > 0, F.least(F.lit(0.95), F.lit(0.5) + best["n"] / 5)).otherwise(F.lit(0.3)).alias("confidence"))


def glob_pattern(glob: str) -> str:
    """A glob as an unanchored pattern: ``*`` is any run, ``?`` any character."""
    import re

    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
