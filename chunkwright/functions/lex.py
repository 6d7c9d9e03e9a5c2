"""A lexer that knows strings and comments, and what can be read off the code that is left: braces and definitions.

Code that doesn't parse gives what can be lexed: an unclosed string ends with its line, an unclosed block with the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_block, _line = r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)", r"//[^\n]*"
_dq, _sq = r"\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)", r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
LEXERS = {
    "javascript": re.compile(rf"(?P<c>{_block}|{_line})|(?P<s>{_dq}|{_sq}|`(?:\\.|[^`\\])*(?:`|\Z))|(?P<r>(?:[=(,:;!&|?{{}}\[+]|\breturn)[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)", re.S),
    "java": re.compile(rf"(?P<c>{_block}|{_line})|(?P<s>\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|{_dq}|{_sq})", re.S),
    "go": re.compile(rf"(?P<c>{_block}|{_line})|(?P<s>{_dq}|{_sq}|`[^`]*(?:`|\Z))", re.S),
}
BRACE_LANGUAGES = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "java": "java", "go": "go"}
_nested = r"\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\)"
_java_word = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|sealed|strictfp)\s++)*+"
#: (type, pattern with the name in its last group) of definitions by language, as they begin on a line of code.
DEFINITIONS = {
    "javascript": [
        ("class", re.compile(r"^[ \t]*+(?:export\s++)?(?:default\s++)?(?:abstract\s++)?class\s++([\w$]+)", re.M)),
        ("function", re.compile(r"^[ \t]*+(?:export\s++)?(?:default\s++)?(?:async\s++)?function\b\s*+\*?\s*+([\w$]+)\s*+(?:<[^<>()]*+>)?\s*+\(", re.M)),
        ("function", re.compile(rf"^[ \t]*+(?:export\s++)?(?:const|let|var)\s++([\w$]+)\s*+(?::[^=\n]++)?=\s*+(?:async\b\s*+)?(?:function\b|{_nested}\s*+(?::[^=;{{}}\n]++)?=>|[\w$]++\s*+=>)", re.M)),
        ("method", re.compile(rf"^[ \t]++(?:(?:static|async|get|set|public|private|protected|override)\s++)*+\*?[ \t]*+(#?[\w$]+)\s*+{_nested}\s*+(?::[^={{;\n]++)?\{{", re.M)),
    ],
    "java": [
        ("class", re.compile(rf"^[ \t]*+{_java_word}(?:class|enum|record)\s++(\w+)", re.M)),
        ("interface", re.compile(rf"^[ \t]*+{_java_word}@?interface\s++(\w+)", re.M)),
        ("method", re.compile(rf"^[ \t]++{_java_word}(?:<[^<>;{{}}()]*+(?:<[^<>]*+>[^<>;{{}}()]*+)*+>\s*+)?(?:[\w.$]++(?:<[^;{{}}()]*?>)?(?:\s*+\[\s*+\])*+\s++)?(\w+)\s*+{_nested}\s*+(?:throws\s++[\w.,\s<>]++)?\{{", re.M)),
    ],
    "go": [
        ("method", re.compile(r"^func[ \t]*+\([^()]*+\)[ \t]*+(\w+)[ \t]*+\(", re.M)),
        ("function", re.compile(r"^func[ \t]++(\w+)[ \t]*+(?:\[[^\]\n]*+\])?[ \t]*+\(", re.M)),
        ("class", re.compile(r"^type[ \t]++(\w+)(?:\[[^\]\n]*+\])?[ \t]++struct\b", re.M)),
        ("interface", re.compile(r"^type[ \t]++(\w+)(?:\[[^\]\n]*+\])?[ \t]++interface\b", re.M)),
    ],
}
NOT_NAMES = {"if", "for", "while", "switch", "catch", "function", "return", "new", "else", "throw", "do", "try", "await", "typeof", "with", "synchronized", "super", "this", "assert", "case", "in", "of", "instanceof", "void", "delete", "yield"}


def lexed(text: str, language: str, lexers: dict[str, re.Pattern] = LEXERS) -> tuple[str, list[tuple[int, int, str]]]:
    """The code of ``text`` with comments and strings blanked out in place, and their spans as (begin, end, c or s)."""
    spans: list[tuple[int, int, str]] = []
    out, at = [], 0
    for m in lexers[language].finditer(text):
        kind = m.lastgroup
        begin = m.start() if kind != "r" else m.start() + m[0].index("/")
        if kind != "r":
            spans.append((begin, m.end(), kind))
        body = text[begin : m.end()]
        out += [text[at:begin], re.sub(r"[^\n]", " ", body) if "\n" in body else " " * len(body)]
        at = m.end()
    out.append(text[at:])
    return "".join(out), spans


def matched_braces(code: str) -> dict[int, int]:
    """Places of opening braces with those of their closing ones; unclosed ones end with the text."""
    ends, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.start()
    return ends | {s: len(code) - 1 for s in stack}


_step = re.compile(r"[(){}\[\];\n]")


def _body(code: str, at: int, language: str) -> int:
    """The brace that opens the body of a definition whose head goes on at ``at``; -1 if it has none."""
    depth = 0
    for m in _step.finditer(code, at):
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "{" and depth <= 0:
            # Go's empty interface and struct types stand in result lists as well.
            if language == "go" and code[: m.start()].rstrip().endswith(("interface", "struct")) and code[m.end() : m.end() + 1] == "}":
                continue
            return m.start()
        elif c == ";" and depth <= 0:
            return -1
    return -1


def definitions(text: str, language: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, type, name) of the definitions of ``text`` in a language with braces, outermost first."""
    code, _ = lexed(text, language)
    ends = matched_braces(code)
    starts = [0, *(m.end() for m in re.finditer(r"\n", text))]
    line = lambda at: bisect_right(starts, at)
    taken, out = set(), []
    for kind, pattern in DEFINITIONS[language]:
        for m in pattern.finditer(code):
            name, at = m[1], m.start(1)
            if at in taken or name in NOT_NAMES:
                continue
            brace = _body(code, m.end() - 1 if m[0][-1] in "({" else m.end(), language)
            if brace < 0 and kind != "function":
                continue
            begin = line(at)
            end = line(ends[brace]) if brace >= 0 and brace in ends else begin
            if kind == "function" and language == "javascript" and "=>" in m[0]:  # an expression without braces ends with its statement
                rest = code[m.end() :].lstrip()
                if not rest.startswith("{"):
                    stop = re.compile(r";|\n(?=[^\n]*\S)(?![ \t]+)").search(code, m.end())
                    end = line(stop.start()) if stop else line(len(code) - 1)
            taken.add(at)
            out.append((begin, end, kind, name))
    return sorted(out, key=lambda d: (d[0], -d[1], d[2]))
