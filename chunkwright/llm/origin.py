"""Generated, minified, vendored and data-blob files, told from hand-written source.

Evidence, in this order: thresholds on layout statistics (maximum and mean line length, shares of white space and
alphanumerics, density of numeric literals, share of long encoded runs) that are tuned per language; for files that are laid out like
hand-written ones, the directory, the name, and a notice in the comments. Strings that only speak of such things are no evidence, since notices
count in comments alone, and neither is a single long line, since every threshold is on shares of the whole text.

Defined results: a null or empty content has statistics of zero and is judged by its path alone; a null path by its
content; size and lines are taken from the content, so null or wrong ones do no harm; plain configuration files are
hand-written unless a notice or directory says otherwise; repeated rows give one verdict each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: directories, names and notices ----------------------------------------------------------------
VENDOR_DIRS = {
    "vendor", "vendors", "vendored", "node_modules", "bower_components", "jspm_packages", "third_party", "thirdparty", "third-party", "3rdparty", "3rd_party",
    "site-packages", "dist-packages", "godeps", "_workspace", "pods", "carthage", "extern", "externals", "deps_src", "web_modules",
}
GENERATED_DIRS = {"gen", "generated", "__generated__", "autogen", "auto_generated", "generated-sources", "generated_src", "genfiles", "gen-src", "_generated"}
#: ``external/name-1.2`` is a copy of a release; ``external`` alone may be anything.
VERSIONED = re.compile(r"(?i)(?:^|/)(?:external|ext|contrib|lib|libs|deps)/[\w.]+-v?\d+(?:\.\d+)+/")
GENERATED_NAME = re.compile(
    r"(?i)(?:^zz_generated|\.pb\.(?:go|py|js|java|cc|h|ts)$|\.pb\.\w+$|_pb2(?:_grpc)?\.\w+$|_pb\.js$|\.g\.\w+$|\.generated\.\w+$|\.gen\.\w+$|_gen\.go$|\.designer\.\w+$|_generated\.\w+$|\.g\.dart$|^moc_|^bindata\.|_string\.go$|\.auto\.\w+$|[._-]autogen(?:erated)?\.\w+$|\.freezed\.\w+$)"
)
MINIFIED_NAME = re.compile(r"(?i)(?:[.\-_]min\.(?:js|mjs|cjs|jsx|css|\w+)$|\.bundle\.\w+$|[.\-]bundle\.min\.|[.\-](?=[0-9a-f]*\d)[0-9a-f]{8,20}\.(?:js|mjs|cjs|jsx|css)$|\.packed\.\w+$)")
GENERATED_NOTICE = re.compile(
    r"(?i)code generated by \S.*do not edit|@generated\b|<auto-?generated|auto-?generated\b(?!\s+(?:method|stub|constructor|catch|javadoc))(?=.*(?:do not|don't|instead|by|from|file))|(?:automatically|machine)[ -]generated (?:by|from|file|code)|(?:file|code|class|module) (?:was |is |has been )?(?:automatically |auto-?)generated (?:by|from)"
    r"|do not (?:hand[ -]?)?(?:edit|modify)\b.*(?:regenerat|generat|by hand|lost|overwrit)|generated (?:by|from) the \S+ (?:compiler|generator|tool)|generated by \S+ (?:compiler|generator|v?\d)|automatisch (?:erzeugt|generiert)|g[ée]n[ée]r[ée] (?:automatiquement|par)\b.*ne pas|ne pas (?:modifier|[ée]diter)|fichier g[ée]n[ée]r[ée]|generado (?:autom[áa]ticamente|por)\b.*no (?:editar|modificar)|no (?:editar|modificar) a mano|changes will be lost|nicht (?:von hand )?bearbeiten"
)
VENDOR_NOTICE = re.compile(
    r"(?i)\(c\)\s*(?:\d{4}(?:\s*-\s*\d{4})?)?,?\s*(?:the )?\S+ (?:project )?(?:authors|contributors|developers)\b|upstream (?:release|version|commit)\b|imported unchanged|(?:bundled|vendored|verbatim|unmodified|local) copy of|copied (?:verbatim )?from \S+ v?\d|see upstream|permission is (?:hereby )?granted|redistribution and use in source|licensed under the (?:apache|mit|bsd)|@license\b|(?:under|distributed under) its own licen[cs]e|this file is part of \S+ v?\d"
)
CONFIG = (".yaml", ".yml", ".json", ".toml", ".env", ".ini", ".cfg", ".conf", ".properties")
#: Per language: (mean line, longest line, white-space share) of minified text and the digit share of data.
LAYOUT = {"js": (200, 500, 0.10, 0.25), "mjs": (200, 500, 0.10, 0.25), "jsx": (200, 500, 0.10, 0.25), "css": (200, 500, 0.10, 0.30), "py": (250, 1000, 0.07, 0.22), "java": (250, 1000, 0.08, 0.22), "go": (250, 1000, 0.08, 0.22)}
DEFAULT_LAYOUT = (300, 1000, 0.08, 0.25)
#: Characters of data from which few lines are enough.
DATA_CHARS = 500
# -----------------------------------------------------------------------------------------------------------------

_OPENING = re.compile(r"\A﻿?(?:\s*(?:#![^\n]*\n|#[^\n]*(?:\n|\Z)|//[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z)|--[^\n]*(?:\n|\Z)|<!--.*?(?:-->|\Z)|\"\"\".*?\"\"\"|'''.*?'''|['\"]use strict['\"];?))+", re.S)
_LINE_COMMENT = re.compile(r"^[ \t]*(?:#|//|/\*|\*|--|<!--)(.*)$", re.M)
#: A notice holds one of these words, in lower case.
NOTICE_WORDS = ("generat", "do not", "don't", "erzeugt", "generiert", "bearbeiten", "g\u00e9n\u00e9r", "genere", "ne pas", "generado", "no editar", "no modificar", "will be lost")
#: Lines of data in other forms: rows of inserts and of key-value dumps.
DATA_LINE = re.compile(r"(?im)^\s*(?:insert into\b.*values.*$|\(?\s*-?\d+\s*,.*\)[,;]?\s*$|\{.*:.*\},?\s*$|\[.*\],?\s*$)")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_\-]{60,}|(?:\\x[0-9a-fA-F]{2}){12,}")
_NUMBER = re.compile(r"(?<![A-Za-z_\w])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?)\b")
_word = np.zeros(256, dtype=np.uint8)
_word[[*range(48, 58)]] = 1
_word[[*range(65, 91), *range(97, 123)]] = 2
_word[[9, 10, 13, 32]] = 3


def layout(text: str) -> dict[str, float]:
    """Layout statistics of ``text``."""
    if not text:
        return {"n_lines": 0, "max_line": 0, "mean_line": 0.0, "space": 0.0, "alnum": 0.0, "digit": 0.0, "numeric": 0.0, "encoded": 0.0}
    size = [len(x) for x in text.split("\n") if x.strip()] or [0]
    kinds = np.bincount(_word[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=4)
    total = int(kinds.sum())
    digits = int(kinds[1])
    many = digits > 0.12 * total
    return {
        "n_lines": len(size),
        "max_line": max(size),
        "mean_line": sum(size) / len(size),
        "space": float(kinds[3] / total),
        "alnum": float((kinds[1] + kinds[2]) / total),
        "digit": float(digits / total),
        "numeric": sum(len(x) for x in _NUMBER.findall(text)) / len(text) if many else float(digits / total),
        "encoded": sum(len(x) for x in _ENCODED.findall(text)) / len(text) if max(size) >= 48 else 0.0,  # no shorter line holds a run
    }


def opening(text: str) -> str:
    """The comments that open ``text``, and its first comment lines after a package or import line."""
    m = _OPENING.match(text)
    return m[0] if m else ""


def by_layout(name: str, text: str, facts: dict[str, float]) -> str | None:
    """minified or data by the layout statistics, else None; plain configuration is never judged by them."""
    if name.lower().endswith(CONFIG) or not facts["n_lines"]:
        return None
    mean, longest, space, digit = LAYOUT.get(name.rsplit(".", 1)[-1].lower(), DEFAULT_LAYOUT)
    if facts["mean_line"] >= mean and facts["max_line"] >= longest and facts["space"] <= space:
        return "minified"
    rows = [len(m[0]) for m in DATA_LINE.finditer(text)]
    if len(rows) >= 0.8 * facts["n_lines"] and (len(rows) >= 10 or sum(rows) >= DATA_CHARS):
        return "data"
    for share, least, lines in (("numeric", digit, 10), ("encoded", 0.5, 5)):
        if facts[share] >= least and (facts["n_lines"] >= lines or facts[share] * len(text) >= DATA_CHARS):
            return "data"
    return None


def by_path(path: str) -> tuple[str, str] | None:
    """(class, evidence) by directory or name."""
    dirs, name = path.lower().split("/")[:-1], path.split("/")[-1]
    if any(d in VENDOR_DIRS for d in dirs) or VERSIONED.search(path):
        return "vendored", "directory"
    if any(d in GENERATED_DIRS for d in dirs):
        return "generated", "directory"
    if GENERATED_NAME.search(name):
        return "generated", "name"
    return ("minified", "name") if MINIFIED_NAME.search(name) else None


def by_notice(text: str) -> str | None:
    """generated or vendored by a notice in the opening comments, or generated by one in a comment of its own."""
    head = opening(text)
    if head and GENERATED_NOTICE.search(head):
        return "generated"
    if head and VENDOR_NOTICE.search(head):
        return "vendored"
    low = text.lower()
    for m in _LINE_COMMENT.finditer(text) if any(w in low for w in NOTICE_WORDS) else ():
        if any(w in m[1].lower() for w in NOTICE_WORDS) and GENERATED_NOTICE.search(m[1]):
            return "generated"
    return None


def origin(path: str | None, text: str | None) -> tuple[str, str, dict[str, float]]:
    """(class, evidence, statistics): class is generated, minified, vendored, data or hand-written."""
    path, text = (path or "").replace("\\", "/"), text or ""
    facts = layout(text)
    if kind := by_layout(path.split("/")[-1], text, facts):
        return kind, "layout", facts
    if found := by_path(path):
        return *found, facts
    if kind := by_notice(text):
        return kind, "notice", facts
    return "hand-written", "", facts


STATS = ["n_lines", "max_line", "mean_line", "space", "alnum", "digit", "numeric", "encoded"]


def file_origins(files: DataFrame) -> DataFrame:
    """file_id, origin, evidence and the statistics of each row of ``files`` (file_id, path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [origin(p, t) for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            stats = [pa.array([float(f[2][s]) for f in found], pa.float64()) for s in STATS]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), *stats], ["file_id", "origin", "evidence", *STATS])

    return files.select(F.col("file_id").cast("bigint"), "path", "content").mapInArrow(run, "file_id BIGINT, origin STRING, evidence STRING, " + ", ".join(f"{s} DOUBLE" for s in STATS))


def not_handwritten(files: DataFrame) -> DataFrame:
    """file_id of the files that aren't hand-written, each once."""
    return file_origins(files.filter("file_id IS NOT NULL")).filter("origin <> 'hand-written'").select("file_id").distinct()
