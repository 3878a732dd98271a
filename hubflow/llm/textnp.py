"""Words and shingles of a whole Arrow batch as 64-bit hashes (NumPy inside tasks).

A text's words are the maximal runs of bytes other than ASCII white space
(0x20, 0x09-0x0D) after lower-casing A-Z. A word's hash is a polynomial of
its bytes modulo 2**64, taken for all words of a batch at once from one
prefix sum, then mixed; equal words have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: white space and every ASCII character that is not a letter
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[128:] = False
NOT_LETTER[65:91] = False
NOT_LETTER[97:123] = False
_pow_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow_cache or len(_pow_cache["p"]) < n:
        m = max(n, 1 << 16)
        for name, base in (("p", _BASE), ("i", _BASE_INV)):
            x = np.full(m, base, dtype=U)
            x[0] = 1
            _pow_cache[name] = np.cumprod(x, dtype=U)
    return _pow_cache["p"], _pow_cache["i"]


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and UTF-8 bytes; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs, raw


def pieces(batches, column: str, nbytes: int = BLOCK_BYTES):
    """The batches cut into slices of about ``nbytes`` of text (one row at least)."""
    for b in batches:
        offs, _ = text_buffers(b.column(column))
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(offs, offs[i] + nbytes, side="right")) - 1
            j = min(max(i + 1, j), b.num_rows)
            yield b.slice(i, j - i)
            i = j


def words(offs: np.ndarray, raw: np.ndarray, spans: bool = False,
          gaps: np.ndarray = _IS_SPACE):
    """(hash per word, first word index per document [n+1]) and, with
    ``spans``, byte start and end of each word within ``raw``. ``gaps`` marks
    the bytes between words.

    Works through the rows in blocks of about BLOCK_BYTES, so memory follows
    the block and the words, not the batch's text.
    """
    n = len(offs) - 1
    hashes, starts_all, ends_all, firsts = [], [], [], [np.zeros(1, np.int64)]
    total, i = 0, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK_BYTES, side="right")) - 1)
        j = min(j, n)
        lo, hi = int(offs[i]), int(offs[j])
        b = raw[lo:hi]
        gap = gaps[b]
        # a document border ends a word as white space does
        word_here = ~gap
        before = np.empty(len(b) + 1, dtype=bool)
        before[0] = False
        before[1:] = word_here
        cut = np.zeros(len(b) + 1, dtype=bool)
        cut[(offs[i:j + 1] - lo)] = True
        start = np.flatnonzero(word_here & (~before[:-1] | cut[:-1]))
        ends_mask = np.empty(len(b), dtype=bool)
        if len(b):
            ends_mask[:-1] = ~word_here[1:] | cut[1:-1]
            ends_mask[-1] = True
        end = np.flatnonzero(word_here & ends_mask) + 1
        p, inv = _powers(len(b) + 1)
        acc = np.zeros(len(b) + 1, dtype=U)
        np.cumsum(_BYTE[_FOLD[b]] * p[:len(b)], out=acc[1:])
        h = mix((acc[end] - acc[start]) * inv[start] + (end - start).astype(U))
        hashes.append(h)
        if spans:
            starts_all.append(start + lo)
            ends_all.append(end + lo)
        firsts.append(total + np.searchsorted(start, offs[i + 1:j + 1] - lo, side="left"))
        total += len(h)
        i = j
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    out = (cat(hashes, U), np.concatenate(firsts))
    return (*out, cat(starts_all, np.int64), cat(ends_all, np.int64)) if spans else out


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words starting at each position (len(h) - n + 1 values)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(m, dtype=U)
    for k in range(n):
        out = out * U(0xC2B2AE3D27D4EB4F) + h[k:k + m]
    return mix(out)


def shingle_sets(h: np.ndarray, first: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingles per document; the whole sequence as one
    shingle where there are fewer than n words; empty where there is none."""
    g = ngram_hashes(h, n)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(g[a:b - n + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = ngram_hashes(h[a:b], b - a) ^ U(b - a)
        else:
            s = np.zeros(0, dtype=U)
        sets.append(s)
    return sets


def distinct_words(h: np.ndarray):
    """(index of one occurrence per distinct word, place of every word among them)."""
    _, at, place = np.unique(h, return_index=True, return_inverse=True)
    return at, place


def prefix_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray,
                  sizes: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per size: (hash of the words' first bytes, whether the word is longer)."""
    out, acc = [], np.zeros(len(start), dtype=U)
    top = max(len(raw) - 1, 0)
    for k in range(1, sizes.stop):
        b = raw[np.minimum(start + k - 1, top)] if len(raw) else np.zeros(len(start), np.uint8)
        acc = acc * U(_BASE) + _BYTE[_FOLD[b]]
        if k in sizes:
            out.append((mix(acc + U(k * 0xA0761D6478BD642F % (1 << 64))), end - start > k))
    return out
