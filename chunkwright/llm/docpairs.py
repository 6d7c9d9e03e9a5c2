"""Functions and methods paired with their documentation.

A lexer that knows strings and comments of each language walks a file once and gives the spans of both; what is left is
code. Definitions are found in the code alone, braces (indentation in Python) are matched to delimit them, and the
documentation is the docstring, or the documentation comment that ends on the line directly above the definition or its
decorators. Pairs whose documentation is empty or trivial are dropped.

Defined results: null and empty contents and files of other languages give no pairs; code that doesn't parse gives what
can be lexed (an unclosed string ends with its line, an unclosed block with the file); repeated rows give each pair
once; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.lex import LEXERS as BRACE_LEXERS
from ..functions.lex import NOT_NAMES as KEYWORDS
from ..functions.lex import lexed, matched_braces

SUFFIX = {"py": "python", "pyi": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "java": "java", "go": "go"}
LEAST_WORDS = 4

_dq, _sq = r"\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)", r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
LEXERS = {
    "python": re.compile(rf"(?P<c>#[^\n]*)|(?P<s>(?<![\w])[rRbBuUfF]{{0,2}}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|{_dq}|{_sq}))", re.S),
    **BRACE_LEXERS,
}
_args = r"\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\)"
_fn = rf"(?:async\b\s*+)?(?:function\b|(?:<[^<>()]*+>)?{_args}\s*+(?::[^=;{{}}\n]++)?=>|[\w$]++\s*+=>)"
#: Definitions as they begin on a line of code; Python's are searched for, the others are tried below each comment.
DEFINITIONS = {
    "python": [re.compile(r"^[ \t]*+(?:async[ \t]++)?def[ \t]++(\w+)", re.M)],
    "javascript": [
        re.compile(r"[ \t]*+(?:export\s++)?(?:default\s++)?(?:declare\s++)?(?:async\s++)?function\b\s*+\*?\s*+([\w$]+)\s*+(?:<[^<>()]*+>)?\s*+\("),
        re.compile(rf"[ \t]*+(?:export\s++)?(?:const|let|var)\s++([\w$]+)\s*+(?::[^=\n]++)?=\s*+{_fn}"),
        re.compile(rf"[ \t]*+(?:[\w$]+\.)*([\w$]+)\s*+[=:]\s*+{_fn}"),
        re.compile(rf"[ \t]*+(?:(?:static|async|private|public|protected|readonly|override)\s++)*(#?[\w$]+)\s*+(?::[^=;{{\n]++)?=\s*+{_fn}"),
        re.compile(rf"[ \t]*+(?:(?:static|async|get|set|private|public|protected|override|export|default)\s++)*\*?[ \t]*+(#?[\w$]+)\s*+(?:<[^<>()]*+>)?{_args}\s*+(?::[^={{;\n]++)?\{{"),
    ],
    "java": [re.compile(rf"[ \t]*+(?:@[\w.]++(?:{_args})?\s*+)*+((?:(?:[\w.$]+(?:<[^;{{}}()]*?>)?(?:\s*+\[\s*+\])*+|<[^<>;{{}}()=]*+(?:<[^<>]*+>[^<>;{{}}()=]*+)*+>)\s+)*)([A-Za-z_$][\w$]*)\s*+{_args}\s*+(?:\[\s*+\]\s*+)*+(?:throws\s++[\w.,\s<>]++)?(?:\{{|;|default\b)")],
    "go": [re.compile(r"func\b[ \t]*+(?:\([^()]*+\)[ \t]*+)?([A-Za-z_]\w*)[ \t]*+(?:\[[^\]\n]*+\][ \t]*+)?\(")],
}
_annotation = re.compile(rf"[ \t]*+@[\w.$]++[ \t]*+(?:{_args})?[ \t]*+(?:\r?\n|$)")
NOT_NAMES = {*KEYWORDS, "import"}
_java_not_type = {"return", "new", "else", "throw", "assert", "case", "await", "yield", "package", "import"}
_word = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_parts = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
_tag_line = re.compile(r"(?i)^\s*(?:@(?:param|arg|argument|returns?|throws|exception|type|typedef|template|yields?|raises?|see|since|author|version|deprecated|override|private|public|protected|async|static|inheritdoc|memberof|name|function|method|example|link|todo)\b.*|:(?:param|type|returns?|rtype|raises?|arg|keyword|var|ivar)\b.*)$")
_section = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|keyword args|keyword arguments|other parameters)\s*:?\s*$")
_rule = re.compile(r"^\s*[-=~*_]{3,}\s*$")
#: Sentences that only say that documentation is still to be written, or that a tool made a stub (fixed values).
STUB = re.compile(
    r"(?i)\b(?:todo|tbd|tbc|fixme|xxx|wip)\b|\bauto-?\s?generated\b|\bgenerated (?:method|constructor|function|by)\b|\b(?:method|constructor|catch|function) stub\b|\bstub(?:bed)?\b|\bundocumented\b|\bnot (?:yet )?documented\b|\bdocumented yet\b"
    r"|\b(?:missing|no|without|needs?|lacks?|add|write|insert|put|provide|fill in|complete) (?:a |an |the |some |any |proper |real |your |more )*(?:docs?|docstring|documentation|description|comment|javadoc|jsdoc|summary)\b|\b(?:docs?|docstring|documentation|description|comment|javadoc|summary) (?:goes here|here|to (?:be|come|follow|do)|pending|missing|needed|later|follows|will follow|is missing|comes? later)\b"
    r"|\bto be (?:documented|described|written|done|added|filled|completed|announced|defined)\b|\b(?:document|describe) (?:this|me|it|later)\b|\bdescription of\b.*\bhere\b|_summary_|_description_|\[(?:summary|description|type)\]|\bsee above\b|\bsame as above\b|\bplaceholder\b|\blorem ipsum\b|\bfill (?:me|this) in\b|\bcoming soon\b|\bwrite me\b|\bfix this (?:doc|comment)\b"
)


def plain_doc(doc: str, language: str) -> str:
    """The text of a documentation comment or docstring without its marks."""
    if language == "python":
        body = re.sub(r"^[rRbBuUfF]{0,2}", "", doc)
        mark = body[:3] if body[:3] in ('"""', "'''") else body[:1]
        return body[len(mark) : -len(mark) if body.endswith(mark) and len(body) >= 2 * len(mark) else None]
    lines = re.sub(r"^/\*+|\*+/$", "", doc.strip()).split("\n") if doc.lstrip().startswith("/*") else doc.split("\n")
    return "\n".join(re.sub(r"^\s*(?://+|\*+)?\s?", "", x) for x in lines)


def told(doc: str) -> str:
    """The documentation without parameter and return tags and sections, and without sentences that are stubs."""
    keep, indent = [], None
    for line in doc.replace("\r", "").split("\n"):
        width = len(line) - len(line.lstrip())
        if indent is not None and (not line.strip() or width > indent or _rule.match(line)):
            continue
        indent = None
        if _section.match(line):
            indent = width
            continue
        if not _tag_line.match(line) and not _rule.match(line):
            keep.append(line)
    sentences = re.split(r"(?<=[.!?])\s+|\n\s*\n", "\n".join(keep))
    return " ".join(s for s in sentences if not STUB.search(s))


def trivial(doc: str, name: str) -> bool:
    """Whether ``doc`` has under ``LEAST_WORDS`` distinct words of its own."""
    own = {p.lower() for p in _parts.findall(name)} | {name.lower()} | {p.lower() for p in re.split(r"[_\W\d]+", name)}
    words = {w.lower() for w in re.findall(r"[^\W\d]+(?:'[^\W\d_]+)?", told(doc))}
    words = {p for w in words for p in w.split("_") if p} if any("_" in w for w in words) else words
    return len(words - own) < LEAST_WORDS


_signature = re.compile(r"[()\[\]{}:]|\n(?=[ \t]*(?:def|class|async|return|@)\b)")


def _signature_end(code: str, at: int) -> int:
    """The place after the colon that ends a Python signature, however long it is; -1 if there is none."""
    depth = 0
    for m in _signature.finditer(code, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            return m.end()
        elif c[0] == "\n" and depth > 0:
            return -1
    return -1


def documented(text: str, language: str) -> list[tuple[str, int, int, str]]:
    """(name, line, last line, documentation) of each function or method of ``text`` that has any documentation."""
    if not any(x in text for x in (('"""', "'''", "def") if language == "python" else ("/**",) if language != "go" else ("//", "/*"))):
        return []
    code, spans = lexed(text, language, LEXERS)
    starts = [0]
    starts += [m.end() for m in re.finditer(r"\n", text)]
    def line(at: int) -> int:
        return bisect_right(starts, at)

    out: dict[int, tuple[str, int, int, str]] = {}
    if language == "python":
        strings = {s: e for s, e, k in spans if k == "s"}
        comments = {s: e for s, e, k in spans if k == "c"}
        lines = None
        for m in DEFINITIONS[language][0].finditer(code):
            at = _signature_end(code, m.end())
            if at < 0:
                continue
            while True:  # the next token after white space and comments
                w = re.compile(r"[ \t\r\n\f]*(?:\\\r?\n)?").match(text, at)
                at = w.end()
                if at not in comments:
                    break
                at = comments[at]
            if at not in strings or re.match(r"[rRuU]*[bBfF]", text[at : at + 3]):
                continue
            if lines is None:
                lines = code.split("\n")
            first = line(m.start(1))
            width = len(lines[first - 1]) - len(lines[first - 1].lstrip())
            last = end = line(strings[at])
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > width):
                end += 1
                if lines[end - 1].strip():
                    last = end
            out[m.start(1)] = (m[1], first, last, text[at : strings[at]])
        return list(out.values())

    # Documentation comments by the line on which they end; runs of line comments in Go are one comment.
    docs: dict[int, str] = {}
    run: list[tuple[int, int]] = []
    for s, e, k in spans:
        if k != "c":
            continue
        own_line = not code[starts[line(s) - 1] : s].strip()
        if text.startswith("/*", s):
            run = []
            if own_line and (text.startswith("/**", s) or language == "go") and not code[e : (text.find("\n", e) + 1 or len(text) + 1) - 1].strip():
                docs[line(e - 1)] = text[s:e]
        elif language == "go" and own_line:
            run = [*run, (s, e)] if run and line(run[-1][0]) == line(s) - 1 else [(s, e)]
            docs[line(s)] = "\n".join(text[a:b] for a, b in run)
    if not docs:
        return []
    ends = matched_braces(code)
    for above in docs:
        if above >= len(starts):
            continue
        begin = starts[above]
        # Decorators and annotations may stand between, also with arguments that go over several lines.
        while m := _annotation.match(code, begin):
            begin = m.end()
        for p in DEFINITIONS[language]:
            if not (m := p.match(code, begin)):
                continue
            group = 2 if language == "java" else 1
            name, at = m[group], m.start(group)
            if name in NOT_NAMES:
                continue
            if language == "java":
                kinds = re.findall(r"[\w$]+", m[1])
                if (not kinds and (not name[0].isupper() or m[0].endswith(";"))) or any(x in _java_not_type for x in kinds) or (kinds and kinds[0] in NOT_NAMES):
                    continue
            brace = code.find("{", m.end() - 1)
            out[at] = (name, line(at), line(ends.get(brace, at)), docs[above])
            break
    return list(out.values())


def pairs(path: str, text: str) -> list[tuple[str, int, int, str]]:
    """(name, line, last line, plain documentation) of the functions of one file whose documentation isn't trivial."""
    language = SUFFIX.get(path.rsplit(".", 1)[-1].lower())
    if language is None or not text:
        return []
    found = [(n, a, z, plain_doc(d, language)) for n, a, z, d in documented(text, language)]
    return [f for f in found if not trivial(f[3], f[0])]


def function_docs(files: DataFrame) -> DataFrame:
    """file_id, name, line, documentation, code: each function of ``files`` (file_id, path, content) with its documentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, path, text in zip(b.column("file_id").to_pylist(), b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if path and text:
                    found = pairs(path, text)
                    rows = text.split("\n") if found else []
                    out += [(i, n, a, " ".join(d.split()), "\n".join(rows[a - 1 : z])) for n, a, z, d in found]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file_id", "name", "line", "documentation", "code"])

    return files.filter("file_id IS NOT NULL").select("file_id", "path", "content").mapInArrow(run, "file_id BIGINT, name STRING, line INT, documentation STRING, code STRING")
