"""Credentials embedded in source code: find them over all files and redact them.

1. Literals that stand where a credential would (assigned to a credential's name, in a login call, URL, comment or
   authorization header, or of a known token format) are indexed corpus-wide with the files that own them.
2. Placeholders are suppressed: by form (masks, references, words without structure) and by owner count: a value in
   more than ``MAX_OWNERS`` different texts is an example that everybody copies, unless it has a token format, is a
   login in a URL or is as irregular as a generated credential. Copies of one text count once.
3. The rare structured values left are confirmed. Every file is scanned again, once however many they are: its runs of
   letters and digits are probed against a sketch of the rarest run of each secret, hits are joined with the secrets, and an
   Aho-Corasick automaton of those that may be in the files of a batch finds them, also under other names and in other files.

Key blocks are found by their armour. The lines of a key's body are secrets of the redaction, so that a text that holds only
a part of a key block is redacted as well. Redaction keeps quotes, line ends and line numbers.

Defined results: null and empty contents hold nothing (redaction gives them back as they are); a null file_id is
left out; repeated rows give their lines once; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..sources.tables import written
from .kernels import U, CountMin, sketch_bits, sketch_of

MAX_OWNERS = 20

# --- fixed values: names, formats and placeholders ---------------------------------------------------------------
#: Last words of the names of credentials, written together.
NAME_ENDS = [
    "password", "passwort", "passwd", "pwd", "passphrase", "passcode", "motdepasse", "contrasena", "contraseña", "kennwort", "senha", "parola", "secret", "token",
    "credential", "credentials", "apikey", "accesskey", "signingkey", "encryptionkey", "privatekey", "secretkey", "authkey", "accountkey", "masterkey", "sharedkey",
    "deploykey", "servicekey", "hmackey", "sshkey", "clientkey", "authorization", "proxyauth", "authheader", "basicauth", "httpauth", "adminpass", "dbpass",
    "userpass", "rootpass", "smtppass", "mypass", "pass",
]
#: Names of ordinary things that end like a credential.
NOT_NAMES = ["publickey", "pubkey", "primarykey", "foreignkey", "pass", "bypass", "compass", "nexttoken", "pagetoken", "stoptoken", "unktoken", "padtoken", "csrftoken"]
#: Names whose values need no long or mixed form.
PASSWORD_NAME = re.compile(r"(?:pass\w*|pwd|motdepasse|contrase\w*|kennwort|senha|parola)$")
#: Formats of tokens that need no name beside them.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w\-]{16,}|xox[abeprs]-[\w\-]{12,}"
    r"|[sr]k_(?:live|prod)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{32,}|AIza[\w\-]{35}|ya29\.[\w\-]{20,}|hf_[A-Za-z0-9]{30,}|npm_[A-Za-z0-9]{30,}|pypi-[\w\-]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|dop_v1_[0-9a-f]{40,}"
    r"|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,})"
)
HEADER = re.compile(r"\b(?:Bearer|bearer|Basic|basic|BEARER|BASIC)[ \t]+([A-Za-z0-9+/=_\-.~]{12,})")
URL_LOGIN = re.compile(r"\b[a-z][a-z0-9+.\-]*://[^\s/:@\"'<>{}$]*:([^\s/@\"'<>]+)@")
CURL_LOGIN = re.compile(r"(?:\s-u|--user)[ =]+[\"']?[\w.\-]+:([^\s\"']+)")
CALL = re.compile(r"(?i)\b(?:login|log_in|connect|authenticate|auth|sign_?in|bind|logon|basic_?auth|set_?credentials)\s*\(")
SPOKEN = re.compile(r"(?i)\b(?:login|account|credentials?|user)\s+(?:was|is|are)\s+[\w.\-@]+\s*/\s*(\S.*?)\s*(?:\*/|-->)?$")
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PLACEHOLDER = re.compile(
    r"(?ix)^(?:[x*.\-_?\#0•]+|.*(?:\$\{|\{\{|<%|%\(|\$\().*|<.*>|\[.*\]|\{.*\}|%\w+%|\$\w+|env[:.].*|vault[:/].*|file[:/].*|secrets?[:/].*|ref[:+].*|arn:.*|keyring:.*|ssm:.*|/.*|\.\.?/.*|~/.*|https?://.*"
    r"|(?:prod|dev|stage|staging|test)/.*|.*(?:change_?-?me|replace_?-?me|example|placeholder|redacted|xxxxxx).*|.*(?<![a-z0-9])(?:your|here|dummy|masked|hidden|todo|tbd|fixme|insert|fake|sample|to_?be_?set|not_?set)(?![a-z0-9]).*"
    r"|(?:os|process|system|config|settings|env|getenv|secrets|vault|self|this)[.(\[].*|none|null|nil|true|false|undefined|n/a|password|passwort|secret|token|user|admin|root|test\w*|default|empty|string|str)$"
)
#: A line is looked at where one of these stands in it, in lower case.
KEYWORDS = [
    "pass", "pwd", "kennwort", "contrase", "senha", "parola", "secret", "token", "key", "auth", "cred", "login", "log_in", "connect(", "signin", "sign_in",
    "bind(", "bearer", "basic", "://", "curl", "account", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat-", "xoxa-", "xoxb-",
    "xoxe-", "xoxp-", "xoxr-", "xoxs-", "sk_live", "sk_prod", "rk_live", "rk_prod", "sk-", "aiza", "ya29.", "hf_", "npm_", "pypi-", "sg.", "dop_v1_", "eyj",
    "mot_de_passe", "motdepasse",
]
NAMED = re.compile(r"(?:pass(?:w(?:or[dt]|d)|phrase|code)?|pwd|mot_?de_?passe|contrase[nñ]a|kennwort|senha|parola|secret|token|credentials?|key|authorization|auth(?:[_\-]?header)?)")
# -----------------------------------------------------------------------------------------------------------------

_line_end = r"(?:\\n|\r?\n)"
#: What follows the head of a key block, and what stands before its end, line by line.
_body_below = re.compile(rf"(?:{_line_end}[^\w\n\\]*[A-Za-z0-9+/=]{{16,}}[^\w\n\\]*?)+(?:{_line_end}[^\w\n\\]*[A-Za-z0-9+/]{{1,15}}={{1,2}})?")
_body_above = re.compile(rf"(?:(?:^|(?<=\\n))[^\w\n\\]*[A-Za-z0-9+/=]{{4,}}[^\w\n\\]*{_line_end})+[^\w\n]*\Z", re.M)
_body_line = re.compile(r"[A-Za-z0-9+/=]{16,}")
_alnum = re.compile(r"[^\W_]+")
_escaped = re.compile(r"(?<=\\)n([^\W_]+)")
_right = re.compile(r"[\w\-]*")
_quoted = r"(?:\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`((?:\\.|[^`\\])*)`)"
_value = re.compile(
    r"[\"']?\s*\]?\s*(?::\s*(?:str|string|String|Optional\[str\]|bytes|any|const)\s*)?(?:=>|:=|\?=|==?|:|,)\s*(?:\(\s*)?(?:[rbuf]{0,2}|new String\()" + _quoted + r"((?:\s*(?:\+|\.\.|&)?\s*\\?\s*" + _quoted.replace("(\"", "(\"").replace("(((", "((") + r")*)"
)
_literal = re.compile(_quoted)
_bare = re.compile(r"[ \t]*(?:=|:)[ \t]*([^\s\"'`{\[(#][^\n]*?)[ \t]*(?:[ \t]#[^\n]*)?(?:\r?\n|$)")
_comment_value = re.compile(r"[ \t]*(?:[:=]|is|was)?[ \t]*([^\s\"'()=:]\S*)")
_mark = re.compile(r"[\\\"'`(\[{)\]},]")
_comment = re.compile(r"^\s*(?:export\s+)?(?:#|//|/\*|\*|--|;|<!--)|\s(?:#|//|/\*)\s")
_words = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
CONFIG = (".yaml", ".yml", ".env", ".toml", ".ini", ".cfg", ".conf", ".properties", ".json")


_held: list = []


def _keywords():
    """The automaton of ``KEYWORDS``, made once per process."""
    if not _held:
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in KEYWORDS:
            a.add_word(w, w)
        a.make_automaton()
        _held.append(a)
    return _held[0]


def credential_name(name: str) -> bool:
    """Whether a variable, key or setting called ``name`` would hold a credential."""
    flat = re.sub(r"[^a-zñ]", "", name.lower())
    if any(flat.endswith(n) for n in NOT_NAMES) and not any(flat.endswith(n) for n in NAME_ENDS if n.endswith("pass") and n != "pass"):
        if not (flat == "pass" or re.search(r"(?:^|[_\-])pass$", name, re.I)):
            return False
    return any(flat == n or flat.endswith(n) for n in NAME_ENDS)


def structured(value: str, password: bool) -> bool:
    """Whether ``value`` has the form of a credential rather than of a word, a sentence or a placeholder."""
    if len(value) < 6 or PLACEHOLDER.match(value) or len(set(value)) < 5:
        return False
    digit, lower, upper = (bool(re.search(p, value)) for p in (r"\d", r"[a-z]", r"[A-Z]"))
    special = bool(re.search(r"[^\w\s.\-/:,;]", value))
    if password:
        return (digit or special) and digit + lower + upper + special >= 2 and not re.search(r"[(){}]$|^\w+\(", value)
    if re.search(r"\s", value):
        return False
    return len(value) >= 12 and digit and (lower or upper) and not re.search(r"[(){}\[\]<>;]", value)


#: Letters that stand for others in words written with digits and signs.
_leet = str.maketrans("@4013$57", "aaoiesst")
#: Bits of a value over which it is no example, and words and rows that speak for one.
ENTROPY = 30.0
_example = re.compile(r"pass|word|secret|token|admin|login|user|welcome|qwert|letmein|change|example|sample|dummy|demo|test|hunter|1234|abcd|4321", re.I)
_word_run = re.compile(r"[a-z]{6,}|[A-Z]{6,}")


def irregular(value: str) -> bool:
    """Whether ``value`` is credential-like by itself, so that many owners don't make it an example."""
    if FORMATS.search(value):
        return True
    bits = sum(-n * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0
    return bits >= ENTROPY and not _word_run.search(value) and not _example.search(value) and not _example.search(value.lower().translate(_leet))


def candidates(path: str, text: str) -> list[tuple[str, list[str]]]:
    """(value, literal parts) of each literal that stands where a credential would and has the form of one."""
    out: list[tuple[str, list[str]]] = []
    low = text.lower()
    if len(low) != len(text):  # letters that grow in lower case would move the places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    config = path.lower().endswith(CONFIG) or "/.env" in path.lower()
    upto = line_end = -1
    for last, word in _keywords().iter(low):
        start = last - len(word) + 1
        if word == "key" and low.startswith(("key=lambda", "keyerror"), start):
            continue
        if start >= line_end:  # forms that belong to the line as a whole
            begin = text.rfind("\n", 0, start) + 1
            line_end = text.find("\n", last)
            line_end = len(text) if line_end < 0 else line_end
            line = text[begin:line_end]
            for f in FORMATS.finditer(line):
                if not PLACEHOLDER.match(f[0]):
                    out.append((f[0], [f[0]]))
            for p in (HEADER, URL_LOGIN, CURL_LOGIN):
                for f in p.finditer(line):
                    if not PLACEHOLDER.match(f[1]) and (p is not HEADER or structured(f[1], False)) and len(f[1]) >= 4:
                        out.append((f[1], [f[1]]))
            if (f := SPOKEN.search(line)) and structured(f[1], True):
                out.append((f[1], [f[1]]))
            for f in CALL.finditer(text, begin, line_end):
                args = [next(g for g in a.groups() if g is not None) if a else "" for a in [_literal.search(x) for x in _arguments(text, f.end())]]
                if len(args) >= 2 and structured(args[-1], True) and "://" not in args[-1]:
                    out.append((args[-1], [args[-1]]))
        if start < upto or not (m := NAMED.match(low, start)):
            continue
        first, stop = start, _right.match(text, m.end()).end()
        while first > 0 and (text[first - 1].isalnum() or text[first - 1] in "_-"):
            first -= 1
        name, upto = text[first:stop], stop  # a word is looked at once, so this is linear in the text
        if not credential_name(name):
            continue
        password = bool(PASSWORD_NAME.search(re.sub(r"[^a-zñ]", "", name.lower())))
        if v := _value.match(text, stop):
            parts = [next(g for g in a.groups() if g is not None) for a in _literal.finditer(text, v.start(1) - 1 if v.start(1) >= 0 else v.start(2) - 1 if v.start(2) >= 0 else v.start(3) - 1, v.end())]
            value = "".join(parts)
            bare = re.sub(r"^(?:Bearer|Basic|Token)\s+", "", value)
            if structured(bare, password):
                out.append((bare, [bare] if len(parts) == 1 else [p for p in parts if len(p) >= 4]))
            continue
        line = text[text.rfind("\n", 0, m.start()) + 1 : stop]
        if config or _comment.search(line):
            pattern = _comment_value if _comment.search(line) else _bare
            if v := pattern.match(text, stop):
                bare = re.sub(r"^(?:Bearer|Basic|Token)\s+", "", v[1].strip())
                if structured(bare, password) and (password or pattern is _bare or not re.fullmatch(r"[a-z]+", bare)):
                    out.append((bare, [bare]))
    return out


def _arguments(text: str, at: int) -> list[str]:
    """The top-level arguments of a call whose opening bracket ends at ``at``; none if it isn't closed."""
    depth, quote, begin, out, i = 0, "", at, [], at
    while m := _mark.search(text, i):
        i, c = m.start(), m[0]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                return [*out, text[begin:i]]
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[begin:i])
            begin = i + 1
        i += 1
    return []


def key_bodies(text: str) -> list[tuple[int, int]]:
    """Where the bodies of key blocks lie, also of blocks whose head or end isn't in the text."""
    if "PRIVATE KEY" not in text:
        return []
    out, at = [], 0
    ends = [(m.start(), m.end()) for m in KEY_END.finditer(text)]
    for m in KEY_BEGIN.finditer(text):
        if m.start() < at:
            continue
        end = next((e for e in ends if e[0] >= m.end()), None)
        later = KEY_BEGIN.search(text, m.end())
        if end is not None and (later is None or end[0] < later.start()):
            out.append((m.end(), end[0]))
            at = end[1]
        elif b := _body_below.match(text, m.end()):
            out.append((b.start(), b.end()))
            at = b.end()
    if ends and not any(z == ends[0][0] for _, z in out) and (b := _body_above.search(text[: ends[0][0]])):
        out.append((b.start(), b.end()))
    return sorted(out)


INDEXED = "value STRING, parts ARRAY<STRING>, owner BIGINT, own BOOLEAN, body BOOLEAN"


def index_literals(files: DataFrame) -> DataFrame:
    """value, parts ARRAY<STRING>, owner, own, body: the candidate literals of (path, content), once per text.

    own if the value is credential-like or a login in a URL; body if it is a line of a private key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text, o in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), b.column("owner").to_pylist(), strict=True):
                if text:
                    rows += [(v, p, o, irregular(v) or f":{v}@" in text and any(v == m[1] for m in URL_LOGIN.finditer(text)), False) for v, p in candidates(path or "", text)]
                    rows += [(v, [v], o, True, True) for s, e in key_bodies(text) for v in _body_line.findall(text[s:e].replace("\\n", "\n"))]
            if rows:
                kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["value", "parts", "owner", "own", "body"])

    return files.select("path", "content", F.xxhash64("content").alias("owner")).mapInArrow(run, INDEXED)


def confirmed(files: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """literal, body: the parts of all values that are rare enough to be secrets, or are such by themselves; body if it stands in key blocks only."""
    found = index_literals(files).distinct()
    rare = found.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.flatten(F.collect_set("parts")).alias("parts"), F.max("own").alias("own"), F.min("body").alias("body")).filter((F.col("owners") <= max_owners) | F.col("own"))
    return rare.select(F.explode("parts").alias("literal"), "body").groupBy("literal").agg(F.min("body").alias("body"))


def _hash(w: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(w) - (1 << 63)


def text_runs(text: str) -> set[str]:
    """The runs of letters and digits of ``text``, with those behind a written line end."""
    return {*_alnum.findall(text), *(_escaped.findall(text) if "\\n" in text else ())}


def keyed_literals(literals: DataFrame) -> DataFrame:
    """literal, body, run: each literal with the hash of the one of its runs that the fewest literals have, of those one of letters and digits together if there is one.

    Wherever a literal stands by itself in a text, all its runs are whole runs of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x, body, _hash(r), len(r) - 1000 * (r.isalpha() or r.isdigit())) for x, body in zip(b.column("literal").to_pylist(), b.column("body").to_pylist(), strict=True) for r in set(_alnum.findall(x))]
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["literal", "body", "run", "size"])

    each = literals.mapInArrow(run, "literal STRING, body BOOLEAN, run BIGINT, size INT")
    counted = each.join(each.groupBy("run").agg(F.count("*").alias("literals")), "run")
    first = F.row_number().over(Window.partitionBy("literal").orderBy("literals", F.desc("size"), "run"))
    return written(counted.withColumn("place", first).filter("place = 1").select("literal", "body", "run"), "secrets")


def possible(texts: DataFrame, literals: DataFrame) -> DataFrame:
    """owner, literals: of each of ``texts`` (owner, text) that may hold some of ``literals`` (literal, run) or a key block, which."""
    hashed = literals.select(F.array("run").alias("hashes"))
    sketch = sketch_of(hashed, sketch_bits(hashed.count(), 32), 1, 1)
    held, bits = texts.sparkSession.sparkContext.broadcast(sketch.cells), sketch.bits
    key = _hash("PRIVATE")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = CountMin(bits, 1, held.value), {}
        for b in batches:
            owners, runs = [], []
            for o, text in zip(b.column("owner").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text_runs(text) if text else ()
                own = [known.get(w) for w in words]
                new = [w for w, h in zip(words, own, strict=True) if h is None]
                if new:  # words come again and again; those in no secret are told apart once
                    hashes = np.array([_hash(w) for w in new], dtype=np.int64)
                    hit = seen.estimate(hashes.view(U)) > 0
                    if len(known) > 1_000_000:
                        known.clear()
                    known.update((w, int(h) if ok or h == key else 0) for w, h, ok in zip(new, hashes, hit, strict=True))
                    own = [known[w] if w in known else 0 for w in words]
                found = [h for h in own if h]
                owners += [o] * len(found)
                runs += found
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(runs, pa.int64())], ["owner", "run"])

    hits = texts.select("owner", "text").mapInArrow(run, "owner BIGINT, run BIGINT").distinct()
    found = hits.join(literals, "run", "left").filter(F.col("literal").isNotNull() | (F.col("run") == key))
    return written(found.groupBy("owner").agg(F.collect_set("literal").alias("literals")), "possible")  # of one text, as many as it may hold


def _scanner(literals: set[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in literals:
        a.add_word(x, len(x))
    if literals:
        a.make_automaton()

    def scan(text: str) -> list[tuple[int, int]]:
        """Places of whole confirmed literals; of overlapping ones the longest."""
        hits = []
        for end, n in a.iter(text) if literals else ():
            s, e = end - n + 1, end + 1
            if (s and text[s - 1].isalnum() and text[s].isalnum() and text[max(0, s - 2) : s] != "\\n") or (e < len(text) and text[e].isalnum() and text[e - 1].isalnum()):
                continue
            hits.append((s, e))
        return hits

    return scan


def _batch_scanner(b: pa.RecordBatch):
    """A scanner for the literals that may be in the texts of a batch."""
    return _scanner({x for own in b.column("literals").to_pylist() if own for x in own})


def secret_lines(files: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """file_id, line: the lines of ``files`` (file_id, path, content) that hold a secret or begin a key block."""
    files = files.filter("file_id IS NOT NULL AND content IS NOT NULL").select("file_id", "path", "content")
    literals = keyed_literals(confirmed(files, max_owners).filter("NOT body"))
    rows = files.select(F.col("file_id").cast("bigint"), F.xxhash64("content").alias("owner"), F.col("content").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scan, ids, lines = _batch_scanner(b), [], []
            for i, text in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = {text.count("\n", 0, s) + 1 for s in [*(s for s, _ in scan(text)), *(m.start() for m in KEY_BEGIN.finditer(text))]}
                ids += [i] * len(own)
                lines += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32())], ["file_id", "line"])

    return rows.join(possible(rows, literals), "owner").select("file_id", "text", "literals").mapInArrow(run, "file_id BIGINT, line INT").distinct()


_joined_after = re.compile(r"[\"'`]\s*(?:\+|\.\.|&|\\)?\s*" + _quoted)
_joined_before = re.compile(_quoted + r"\s*(?:\+|\.\.|&|\\)?\s*[\"'`]\Z")


def _with_short_parts(text: str, spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``spots`` with the short literals that are joined to one of them."""
    out = list(spots)
    for s, e in spots:
        while (m := _joined_after.match(text, e)) and 0 < len(m[m.lastindex]) < 4:
            out.append(m.span(m.lastindex))
            e = m.end(m.lastindex)
        while (m := _joined_before.search(text[max(0, s - 200) : s])) and 0 < len(m[m.lastindex]) < 4:
            s = max(0, s - 200) + m.start(m.lastindex)
            out.append((s, s + len(m[m.lastindex])))
    return out


def redacted_text(text: str, spots: list[tuple[int, int]], mark: str) -> str:
    """``text`` with the spots replaced by ``mark`` and the bodies of key blocks masked line by line."""
    blocks = key_bodies(text)
    out, at = [], 0
    for s, e in sorted([*_with_short_parts(text, spots), *blocks], key=lambda x: (x[0], -x[1])):
        if s < at:
            continue
        body = (s, e) in blocks
        out += [text[at:s], re.sub(r"[A-Za-z0-9+/=]{2,}", lambda m: "n" + "x" * (len(m[0]) - 1) if text[s + m.start() - 1] == "\\" else "x" * len(m[0]), text[s:e]) if body else mark]
        at = e
    return "".join([*out, text[at:]])


def redacted(files: DataFrame, texts: DataFrame, key: str, text: str, mark: str = "REDACTED", max_owners: int = MAX_OWNERS) -> DataFrame:
    """key, text, secrets: the rows of ``texts`` (files or their chunks) without the secrets confirmed over ``files``."""
    literals = keyed_literals(confirmed(files.filter("content IS NOT NULL").select("path", "content"), max_owners))
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("owner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scan, out, n = _batch_scanner(b), [], []
            for t, own in zip(b.column("text").to_pylist(), b.column("literals").to_pylist(), strict=True):
                spots = scan(t) if t and own else []
                keys = len(key_bodies(t)) if t and own is not None else 0
                out.append(redacted_text(t, spots, mark) if spots or keys else t)
                n.append(len(spots) + keys)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.string()), pa.array(n, pa.int32())], ["key", "text", "secrets"])

    joined = rows.join(possible(rows, literals), "owner", "left").select("key", "text", "literals")
    done = joined.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text STRING, secrets INT")
    return done.withColumnRenamed("key", key).withColumnRenamed("text", text)
