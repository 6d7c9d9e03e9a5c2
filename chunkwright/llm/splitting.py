"""Splitting of oversized texts at natural boundaries, with overlap.

A hierarchy of separators is tried from coarse to fine: section (blank lines before a heading or definition), paragraph,
line, sentence, word, character. A text is cut by the coarsest separator that helps and only parts that are still too
large are cut by the next one; parts are then packed greedily up to the limit. Each piece after the first begins with
exactly the last ``overlap`` characters of the piece before it; the cuts are at boundaries, the beginnings of overlaps needn't be.

Defined results: lengths are in code points; a text within its limit is one piece, as it stands; null texts give no piece
and empty ones one empty piece; a language that is null or not listed has the limits of ``default``; limits under 1
count as 1 and an overlap of half the limit or more as half of it less one, so that every piece makes progress;
repeated rows give repeated pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators from coarse to fine; a cut is made after what they match.
SEPARATORS = [
    re.compile(r"\n[ \t]*\r?\n(?:[ \t]*\r?\n)*(?=#{1,6} |(?:def|class|func|function|public|private|async|export|type|const)\b)"),
    re.compile(r"\n[ \t]*\r?\n(?:[ \t]*\r?\n)*"),
    re.compile(r"\n"),
    re.compile(r"[.!?;。！？][\"')\]]*\s+"),
    re.compile(r"\s+"),
]
#: A table of limits has one row per language, so it is collected; with more rows than this it is joined by shuffle.
LIMIT_ROWS = 100_000


def atoms(text: str, begin: int, end: int, most: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Consecutive parts of text[begin:end] of at most ``most`` code points each, cut as coarsely as possible."""
    if end - begin <= most:
        if end > begin:
            yield begin, end
        return
    if level == len(SEPARATORS):
        for at in range(begin, end, most):
            yield at, min(end, at + most)
        return
    at = begin
    for m in SEPARATORS[level].finditer(text, begin, end):
        if begin < m.end() < end:
            yield from atoms(text, at, m.end(), most, level + 1)
            at = m.end()
    yield from atoms(text, at, end, most, level + 1)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, fresh, end) of each piece: its text is text[begin:end] and what is new in it begins at ``fresh``."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, (limit - 1) // 2))
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out: list[tuple[int, int, int]] = []
    begin = fresh = end = 0
    # Atoms leave room for the overlap, so that it can stand before any of them.
    for a, b in atoms(text, 0, len(text), limit - overlap):
        if b - begin > limit:
            out.append((begin, fresh, end))
            begin, fresh = max(0, end - overlap), end
        end = b
    out.append((begin, fresh, end))
    return out


def split_texts(chunks: DataFrame, limits: DataFrame, everything: bool = False) -> DataFrame:
    """chunk_id, piece, pieces, start_line, end_line, begin, text, overlap: the pieces of the oversized ``chunks``.

    ``chunks`` needs chunk_id, text, language and start_line; ``limits`` language, max_chars and overlap_chars. ``begin`` is
    the offset in the text and ``overlap`` the number of characters shared with the piece before. With ``everything``
    texts within their limit are given as one piece.
    """
    if limits.limit(LIMIT_ROWS + 1).count() > LIMIT_ROWS:
        raise ValueError("limits must have one row per language")
    own = limits.select(F.lower(F.trim("language")).alias("lang"), "max_chars", "overlap_chars").dropDuplicates(["lang"])
    rows = chunks.select("chunk_id", "text", "start_line", F.lower(F.trim("language")).alias("lang")).filter("text IS NOT NULL")
    default = F.broadcast(own.filter("lang = 'default'").select(F.col("max_chars").alias("m0"), F.col("overlap_chars").alias("o0")).limit(1))
    rows = rows.join(F.broadcast(own.filter("lang <> 'default'")), "lang", "left").join(default, F.lit(True), "left")
    rows = rows.select("chunk_id", "text", "start_line", F.coalesce("max_chars", "m0").alias("most"), F.coalesce("overlap_chars", "o0", F.lit(0)).alias("over")).filter("most IS NOT NULL")
    if not everything:  # decided by built-in functions: texts that fit never reach Python
        rows = rows.filter(F.length("text") > F.greatest("most", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, text, line, most, over in zip(*(b.column(c).to_pylist() for c in ("chunk_id", "text", "start_line", "most", "over")), strict=True):
                cut = pieces(text, most, over)
                at, n = 0, line if line is not None else 1
                for k, (begin, fresh, end) in enumerate(cut):
                    n += text.count("\n", at, begin) if begin >= at else -text.count("\n", begin, at)
                    at = begin
                    last = n + text.count("\n", begin, max(begin, end - 1))
                    out.append((i, k, len(cut), n, last, begin, text[begin:end], fresh - begin))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            names = ["chunk_id", "piece", "pieces", "start_line", "end_line", "begin", "text", "overlap"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names)

    return rows.mapInArrow(run, "chunk_id BIGINT, piece INT, pieces INT, start_line INT, end_line INT, begin INT, text STRING, overlap INT")


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id of the chunks that had to be split, each once."""
    return split_texts(chunks, limits).filter("pieces > 1").select("chunk_id").distinct()
