"""Encoding of texts by a public byte-pair vocabulary, exactly as its merges would give it.

Texts are cut into pieces by the vocabulary's pattern. A piece that is no token is solved by prefix dynamic programming:
of each byte prefix exactly one token can be the last of its encoding, namely the token whose own prefix is encoded and
whose pair with the last token of that prefix no merge would break. These last tokens are kept, so that appending
bytes needs only the new prefixes, and an edit only those behind it.

Defined results: null and empty texts give an empty list; blank and odd texts are encoded as they stand; what looks like a
special token is ordinary text; repeated rows each give their list; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space of the pattern, and the pattern that cuts texts into pieces (fixed values of the public vocabulary).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
CACHE = 400_000


def vocabulary_path(spark: SparkSession | None = None, name: str = VOCABULARY) -> str:
    """The vocabulary file: ``chunkwright.tokenizers`` of the session, else CHUNKWRIGHT_TOKENIZERS, else /opt/tokenizers."""
    folder = spark.conf.get("chunkwright.tokenizers", None) if spark is not None else None
    return os.path.join(folder or os.environ.get("CHUNKWRIGHT_TOKENIZERS", "/opt/tokenizers"), name)


class Vocabulary:
    """Ranks of the tokens, and how each is made of two by the merges."""

    def __init__(self, lines: bytes):
        pairs = (x.split() for x in lines.splitlines() if x)
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.longest = max(map(len, self.rank))
        self.halves = self._halves()
        self.joined = {h: t for t, h in self.halves.items()}
        self._pair: dict[tuple[int, int], bool] = {}

    def _halves(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes each token: what is left when all merges of lower rank are done."""
        out = {}
        for word, rank in self.rank.items():
            if len(word) == 1:
                continue
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                best = min((self.rank.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
                if best[0] >= rank:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2:
                out[rank] = (self.rank[parts[0]], self.rank[parts[1]])
        return out

    def stands(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay two tokens beside each other.

        Undoes the merges from the last one back, along the seam; the pair breaks if at some moment the two tokens at the
        seam would have been merged before the merge that is undone.
        """
        known = self._pair.get((left, right))
        if known is not None:
            return known
        a, b, before, ok = left, right, 1 << 40, True
        while True:
            if self.joined.get((a, b), 1 << 41) < before:
                ok = False
                break
            ha, hb = self.halves.get(a), self.halves.get(b)
            if ha is None and hb is None:
                break
            # The later of the two merges is undone first; of equal ones the left was made first.
            if hb is None or (ha is not None and a > b):
                before, a = a, ha[1]
            else:
                before, b = b + 1, hb[0]
        if len(self._pair) < 2_000_000:
            self._pair[left, right] = ok
        return ok


class Prefixes:
    """The last token of each byte prefix of a growing piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [(-1, 0)]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the piece; prefixes that are known stay as they are."""
        self.data += more
        rank, data = self.v.rank, self.data
        for end in range(len(self.last), len(data) + 1):
            for begin in range(max(0, end - self.v.longest), end):
                token = rank.get(data[begin:end])
                if token is not None and (begin == 0 or self.v.stands(self.last[begin][0], token)):
                    self.last.append((token, begin))
                    break

    def replace(self, at: int, stop: int, by: bytes) -> None:
        """Put ``by`` in place of data[at:stop]; only prefixes behind ``at`` are made anew."""
        rest = by + self.data[stop:]
        self.data, self.last = self.data[:at], self.last[: at + 1]
        self.append(rest)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token, end = self.last[end]
            out.append(token)
        return out[::-1]


class Encoder(dict):
    """Pieces to their ids; pieces once solved are kept, up to ``CACHE`` of them."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        import re

        import regex

        self.v, self.ascii, self.any = vocabulary, re.compile(ASCII_PIECES), regex.compile(PIECES)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        token = self.v.rank.get(data)
        ids = (token,) if token is not None else tuple(Prefixes(self.v, data).ids())
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, (self.ascii if text.isascii() else self.any).findall(text))))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once per process."""
    if path not in _encoders:
        with open(path, "rb") as f:
            _encoders[path] = Encoder(Vocabulary(f.read()))
    return _encoders[path]


def _encoder_of(path: str, lines: bytes) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(lines))
    return _encoders[path]


def encoded(docs: DataFrame, key: str, text: str, counts_only: bool = False, path: str | None = None) -> DataFrame:
    """key and ids ARRAY<INT> (or only n_tokens INT) of each row of ``docs``.

    The vocabulary, of fixed size, is read once by the driver and broadcast, so executors need no file.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path(spark)
    with open(path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder_of(path, held.value)
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                own = b.slice(part, 1000)
                lists = [np.array(e.encode(t), dtype=np.int32) for t in own.column("t").to_pylist()]
                n = np.array([len(x) for x in lists], dtype=np.int32)
                if counts_only:
                    out = pa.array(n)
                else:
                    out = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([own.column("key"), out], [key, "n_tokens" if counts_only else "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"{key} {rows.schema['key'].dataType.simpleString()}, " + ("n_tokens INT" if counts_only else "ids ARRAY<INT>"))
