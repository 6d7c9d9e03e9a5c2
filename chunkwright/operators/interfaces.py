"""Signatures of Python functions and what follows from them: type search, inferred types, documentation, the public interface.

Null texts have no signature; a signature that isn't closed is left out; ties are broken by the least chunk_id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .embedding import embedded
from .graph import buffered
from .search import dot

SIGNATURE = "n INT, name STRING, params ARRAY<STRUCT<name: STRING, type: STRING, default: STRING>>, returns STRING, is_async BOOLEAN"
_head = re.compile(r"^[ \t]*(async\s+)?def\s+([A-Za-z_]\w*)\s*\(", re.M)
_mark = re.compile(r"[()\[\]{},:\n\"'#]")
_returns = re.compile(r"\s*(?:->\s*)?")


def _until(text: str, at: int, stops: str) -> int:
    """The first of the characters ``stops`` from ``at`` on that stands outside of brackets, strings and comments; -1 if there is none."""
    depth = 0
    while m := _mark.search(text, at):
        c, at = m[0], m.end()
        if depth == 0 and c in stops:
            return m.start()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "#":
            at = text.find("\n", at)
            if at < 0:
                return -1
        elif c in "\"'":
            while at < len(text) and text[at] not in (c, "\n"):
                at += 2 if text[at] == "\\" else 1
            at += 1
    return -1


def parsed_signatures(text: str) -> list[tuple[str, list[tuple[str, str | None, str | None]], str | None, bool]]:
    """(name, [(parameter, type, default)], result type, async) of the definitions of ``text``, which begin their lines; self, cls and bare marks are no parameters."""
    out = []
    for m in _head.finditer(text):
        params, at, end = [], m.end(), -1
        while (stop := _until(text, at, ",)")) >= 0:
            piece = re.sub(r"#[^\n]*", "", text[at:stop]).strip()
            if piece.lstrip("*") and piece not in ("self", "cls", "/"):
                named, default = piece, None
                equal = re.search(r"(?<![=!<>:])=(?!=)", piece)
                if equal:
                    named, default = piece[: equal.start()].strip(), piece[equal.end() :].strip()
                name, _, kind = named.partition(":")
                params.append((name.strip().lstrip("*"), kind.strip() or None, default))
            at = stop + 1
            if text[stop] == ")":
                end = at
                break
        if end < 0:
            continue
        colon = _until(text, end, ":")
        arrow = _returns.match(text, end)
        result = text[arrow.end() : colon].strip() if colon >= 0 and "->" in arrow[0] else None
        out.append((m[2], params, result or None, bool(m[1])))
    return out


def signatures(chunks: DataFrame) -> DataFrame:
    """buffer_id, chunk_id, file, n, name, params, returns, is_async: the n-th definition of each chunk."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = [(buffer, i, file, n, *s) for buffer, i, file, t in zip(b["buffer_id"], b["chunk_id"], b["file"], b["text"], strict=True) for n, s in enumerate(parsed_signatures(t))]
            yield pd.DataFrame(out, columns=["buffer_id", "chunk_id", "file", "n", "name", "params", "returns", "is_async"])

    rows = buffered(chunks).filter(F.col("text").rlike(r"\bdef\s")).select("buffer_id", "chunk_id", "file", "text")
    return rows.mapInPandas(run, "buffer_id STRING, chunk_id BIGINT, file STRING, " + SIGNATURE)


def type_search(found: DataFrame, pattern: str, top_k: int = 10) -> DataFrame:
    """buffer_id, chunk_id, n, name, score: signatures that fit a type pattern, the best ``top_k`` of each buffer.

    .3 for the result type, .2 for any parameter's, and for a pattern Callable[[a, b], r] .3 for as many parameters, .1 for each that fits
    the one at its place and .2 for the result; 1 at most. Types fit where one holds the other. Only such a hit of
    the first, second or number of parameters, or of a Callable's result, gives a row.
    """
    p = F.lit(pattern.strip().lower())
    fits = lambda a, b: F.contains(a, b) | F.contains(b, a)
    result = F.lower("returns")
    kinds = F.transform("params", lambda x: F.lower(F.coalesce(x["type"], F.lit(""))))
    one, two = F.coalesce(fits(result, p), F.lit(False)), F.exists(F.filter(kinds, lambda k: k != ""), lambda k: fits(k, p))
    parts = [F.when(one, 0.3).otherwise(0.0), F.when(two, 0.2).otherwise(0.0)]
    hits = [one, two]
    if m := re.search(r"callable\s*\[\s*\[(.*?)\]\s*,\s*(.*?)\s*\]", pattern.lower()):
        wanted = [x.strip() for x in m[1].split(",") if x.strip()]
        count, back = F.size("params") == len(wanted), F.coalesce(F.contains(result, F.lit(m[2].strip())), F.lit(False))
        each = [F.when(F.get(kinds, i).isNotNull() & fits(F.get(kinds, i), F.lit(w)), 0.1).otherwise(0.0) for i, w in enumerate(wanted)]
        parts += [F.when(count, 0.3).otherwise(0.0), F.when(back, 0.2).otherwise(0.0), *each]
        hits += [count, back]
    score, hit = parts[0], hits[0]
    for x in parts[1:]:
        score = score + x
    for x in hits[1:]:
        hit = hit | x
    rows = found.filter(hit).select("buffer_id", "chunk_id", "n", "name", F.round(F.least(F.lit(1.0), score), 3).alias("score"))
    w = Window.partitionBy("buffer_id").orderBy(F.desc("score"), "chunk_id", "n")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def described(name: Column, params: Column, returns: Column) -> Column:
    """A signature written out: name(a: int, b) -> str."""
    each = F.transform(params, lambda x: F.concat(x["name"], F.when(x["type"].isNotNull(), F.concat(F.lit(": "), x["type"])).otherwise("")))
    return F.concat(name, F.lit("("), F.array_join(each, ", "), F.lit(")"), F.when(returns.isNotNull(), F.concat(F.lit(" -> "), returns)).otherwise(""))


def inferred_types(chunks: DataFrame, encode=embedded) -> DataFrame:
    """buffer_id, symbol, chunk_id, signature, returns, confidence: the first signature of each symbol's first chunk that has one.

    confidence is (cosine + 1) / 2 of the embeddings of the signature written out and of the text. ``encode`` (rows, key, text) gives
    key and embedding, so that any encoder can be used.
    """
    first = signatures(chunks).filter("n = 0").join(chunks.filter("name IS NOT NULL").select("chunk_id", F.col("name").alias("symbol")), "chunk_id")
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("buffer_id", "symbol").orderBy("chunk_id"))).filter("r = 1")
    rows = first.select("buffer_id", "symbol", "chunk_id", described(F.col("name"), F.col("params"), F.col("returns")).alias("signature"), "returns")
    a = encode(rows, "chunk_id", "signature").select("chunk_id", F.col("embedding").alias("a"))
    b = encode(chunks.join(rows.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id", "text").select("chunk_id", F.col("embedding").alias("b"))
    return rows.join(a, "chunk_id").join(b, "chunk_id").select("buffer_id", "symbol", "chunk_id", "signature", "returns", F.round((dot(F.col("a"), F.col("b")) + 1) / 2, 4).alias("confidence"))


def generated_documentation(chunks: DataFrame, style: str = "google") -> DataFrame:
    """buffer_id, symbol, chunk_id, docstring, examples: a docstring in google, numpy or sphinx style for the first chunk of each symbol,
    and up to five calls of it in test files, in order."""
    if style not in ("google", "numpy", "sphinx"):
        raise ValueError("style must be google, numpy or sphinx")
    named = buffered(chunks).filter("name IS NOT NULL AND text IS NOT NULL").select("buffer_id", "chunk_id", F.col("name").alias("symbol"))
    first = named.groupBy("buffer_id", "symbol").agg(F.min("chunk_id").alias("chunk_id"))
    s = first.join(signatures(chunks).filter("n = 0").select("chunk_id", "params", "returns"), "chunk_id")
    param = F.transform("params", lambda x: F.concat(x["name"], F.lit(" ("), F.coalesce(x["type"], F.lit("Any")), F.lit(")"), F.when(x["default"].isNotNull(), F.concat(F.lit(", default: "), x["default"])).otherwise("")))
    head, none = F.concat(F.lit('"""'), F.col("symbol"), F.lit(" documentation.")), F.array().cast("array<string>")
    if style == "sphinx":
        body = F.concat(F.transform(param, lambda p: F.concat(F.lit(":param "), p)), F.when(F.col("returns").isNotNull(), F.array(F.concat(F.lit(":rtype: "), F.col("returns")))).otherwise(none))
    else:
        titles = {"google": (["", "Args:"], ["", "Returns:"]), "numpy": (["", "Parameters", "----------"], ["", "Returns", "-------"])}[style]
        listed = F.concat(F.array(*map(F.lit, titles[0])), F.transform(param, lambda p: F.concat(F.lit("    "), p)))
        body = F.concat(F.when(F.size("params") > 0, listed).otherwise(none), F.when(F.col("returns").isNotNull(), F.concat(F.array(*map(F.lit, titles[1])), F.array(F.concat(F.lit("    "), F.col("returns"))))).otherwise(none))
    docs = s.select("buffer_id", "symbol", "chunk_id", F.array_join(F.concat(F.array(head), body, F.array(F.lit('"""'))), "\n").alias("docstring"))
    tests = buffered(chunks).filter(F.col("file").contains("test") & F.col("text").isNotNull()).select("buffer_id", F.col("chunk_id").alias("t"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*\s*\([^)]*\)"), 0)).alias("n", "use"))
    uses = tests.withColumn("symbol", F.regexp_extract("use", r"^(\w+)", 1)).join(first.select("buffer_id", "symbol"), ["buffer_id", "symbol"], "left_semi")
    five = uses.withColumn("r", F.row_number().over(Window.partitionBy("buffer_id", "symbol").orderBy("t", "n"))).filter("r <= 5")
    examples = five.groupBy("buffer_id", "symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "use"))), lambda x: x["use"]), "\n").alias("examples"))
    return docs.join(examples, ["buffer_id", "symbol"], "left").select("buffer_id", "symbol", "chunk_id", "docstring", F.coalesce("examples", F.lit("")).alias("examples"))


def public_interface(chunks: DataFrame) -> DataFrame:
    """buffer_id, file, type, symbol, params: functions, methods and classes whose name doesn't begin with an underscore, with their parameters."""
    rows = buffered(chunks).filter("type IN ('function', 'method', 'class') AND name IS NOT NULL AND text <> '' AND NOT startswith(name, '_')").select("buffer_id", "chunk_id", "file", "type", F.col("name").alias("symbol"))
    params = F.concat_ws(",", F.transform("params", lambda x: x["name"]))
    return rows.join(signatures(chunks).filter("n = 0").select("chunk_id", params.alias("params")), "chunk_id", "left").select("buffer_id", "file", "type", "symbol", F.coalesce("params", F.lit("")).alias("params")).distinct()


def interface_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """buffer_id, file, type, symbol, change, breaking, params_added: what changed between two public interfaces.

    A removed symbol or a parameter that is gone breaks its users; added ones don't.
    """
    keys = ["buffer_id", "file", "type", "symbol"]
    o = old.groupBy(*keys).agg(F.max("params").alias("was"), F.lit(True).alias("o"))
    n = new.groupBy(*keys).agg(F.max("params").alias("now"), F.lit(True).alias("n"))
    both = o.join(n, keys, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    gone = F.size(F.array_except(split(F.col("was")), split(F.col("now")))) > 0
    return both.select(*keys, change.alias("change"), ((change == "removed") | ((change == "changed") & gone)).alias("breaking"), F.when(change == "changed", F.array_join(F.array_except(split(F.col("now")), split(F.col("was"))), ",")).otherwise("").alias("params_added")).filter("change IS NOT NULL")


def change_template(hits: DataFrame, chunks: DataFrame, risks: DataFrame, tests: DataFrame, files: int = 5) -> DataFrame:
    """qid, buffer_id, file, place, risk, tests: of the search hits (qid, id, rank) of each request the first ``files`` files to change, with the
    greatest risk of their symbols (buffer_id, symbol, risk) and the tests (buffer_id, file, test_file) that concern them."""
    where = buffered(chunks).select(F.col("chunk_id").alias("id"), "buffer_id", "file", F.col("name").alias("symbol"))
    first = hits.join(where, "id").groupBy("qid", "buffer_id", "file").agg(F.min("rank").alias("rank"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "buffer_id", "file"))).filter(F.col("place") <= files)
    own = where.filter("symbol IS NOT NULL").select("buffer_id", "file", "symbol").distinct().join(risks.select("buffer_id", "symbol", "risk"), ["buffer_id", "symbol"]).groupBy("buffer_id", "file").agg(F.max("risk").alias("risk"))
    need = tests.groupBy("buffer_id", "file").agg(F.concat_ws(",", F.array_sort(F.collect_set("test_file"))).alias("tests"))
    return first.join(own, ["buffer_id", "file"], "left").join(need, ["buffer_id", "file"], "left").select("qid", "buffer_id", "file", "place", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("tests", F.lit("")).alias("tests"))
