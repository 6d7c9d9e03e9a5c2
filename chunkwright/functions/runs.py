"""Runs of words as 64-bit hashes, cut by numpy from Arrow texts, and a bounded filter of such hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the polynomial hash and of the finaliser (fixed values).
BASE, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Bytes of text that are cut at a time; a longer text is cut alone.
SLAB = 1 << 20
#: By byte, the small letter, digit or ``_`` that it is in a word, else 0.
WORD = np.zeros(256, dtype=np.uint8)
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyz":
    WORD[_c] = WORD[ord(chr(_c).upper())] = _c


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that equal inputs stay equal and all bits depend on all bits."""
    h = (h ^ (h >> U(33))) * U(MIX_1)
    h = (h ^ (h >> U(33))) * U(MIX_2)
    return h ^ (h >> U(33))


_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= n."""
    if not _powers or len(_powers[0]) <= n:
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, SLAB) + 1, b, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers


def word_hashes(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins in the UTF-8 bytes ``data`` of texts that begin at ``texts``, and its hash; no word goes over the end of its text."""
    c = WORD[data]
    inside = c > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    opens, closes = texts[texts < len(c)], texts[texts > 0] - 1
    first[opens], last[closes] = inside[opens], inside[closes]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, i = np.zeros(len(starts), dtype=U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLAB, "right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = powers(int(hi - lo))
        p = np.zeros(hi - lo + 1, dtype=U)
        np.cumsum(c[lo:hi] * up[: hi - lo], out=p[1:])
        out[i:j] = mixed((p[ends[i:j] - lo] - p[starts[i:j] - lo]) * down[starts[i:j] - lo])
        i = j
    return starts, out


def distinct_runs(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct runs of ``n`` words (``[A-Za-z0-9_]``, in any letter case) each text has, and their hashes, text after text and sorted."""
    counts, parts, begin = np.zeros(len(texts), dtype=np.int64), [np.zeros(0, dtype=U)], 0
    if not len(texts):
        return counts, parts[0]
    texts = texts.cast(pa.large_string())
    for sign, letter in (("K", "k"), ("İ", "i")):  # the other signs whose small letters are of a word
        if pc.any(pc.match_substring(texts, sign)).as_py():
            texts = pc.replace_substring(texts, sign, letter)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + SLAB, "right")) - 1)
        starts, h = word_hashes(data[at[begin] : at[end]], at[begin:end] - at[begin])
        own = np.repeat(np.arange(begin, end), np.diff(np.searchsorted(starts, at[begin : end + 1] - at[begin])))
        if len(h) >= n:
            m = len(h) - n + 1
            run = h[:m]
            for i in range(1, n):
                run = mixed(run * U(BASE) + h[i : i + m])
            whole = own[:m] == own[n - 1 :]
            run, own = run[whole], own[:m][whole]
            order = np.lexsort((run, own))
            run, own = run[order], own[order]
            new = np.ones(len(run), dtype=bool)
            new[1:] = (run[1:] != run[:-1]) | (own[1:] != own[:-1])
            parts.append(run[new])
            counts += np.bincount(own[new], minlength=len(texts))
        begin = end
    return counts, np.concatenate(parts)


def list_array(counts: np.ndarray, hashes: np.ndarray) -> pa.Array:
    """The hashes as one list for each of the counts."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(hashes.view(np.int64)))


# --- filter of hashes ------------------------------------------------------------------------------------------
# A Bloom filter in slices: the first bits of a hash tell its slice, in which three bits are set. So each slice can
# be filled by one task, and none of those that were put in is ever missed.

SLICE_BITS = 19


def filter_bits(expected: int, per: int = 10, most: int = 28) -> int:
    """Bits, as a power of two, of a filter with about ``per`` for each of ``expected`` hashes; 32 MB at most, whatever is expected."""
    return max(SLICE_BITS, min(most, (max(1, expected) * per - 1).bit_length()))


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three places of each hash in a filter of ``1 << bits`` bits."""
    base = (h >> U(64 - bits)) >> U(SLICE_BITS) << U(SLICE_BITS)
    x = mixed(h ^ U(BASE))
    return [(base + (x >> U(SLICE_BITS * i) & U((1 << SLICE_BITS) - 1))).astype(np.int64) for i in range(3)]


def put(cells: np.ndarray, h: np.ndarray, bits: int) -> None:
    for p in places(h, bits):
        np.bitwise_or.at(cells, p >> 3, (1 << (p & 7)).astype(np.uint8))


def may_hold(cells: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """False only for hashes that were never put in."""
    out = np.ones(len(h), dtype=bool)
    for p in places(h, bits):
        out &= (cells[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out
