"""Words and 64-bit hashes of whole texts, vectorised over the bytes of many texts at once.

Texts lie one after another in one UTF-8 buffer, as Arrow holds them; a word
never crosses the end of its text. Every eight
bytes of a span are mixed with their place, the results summed and mixed again, so
no algebraic relation between texts survives as in a polynomial; the hash depends
on the span's bytes alone, so every task and executor gets the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts are scanned in pieces of about so many bytes, to bound memory.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes with eight zeros after them, as ``eights`` needs them."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def eights(buffer: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The up to eight bytes from each place to its end, as little-endian integers; ``buffer`` is padded."""
    every = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    got, left = every[at].astype(np.uint64), ends - at
    short = np.flatnonzero(left < 8)
    got[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
    return got


def rest(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The spans of more than eight bytes and, for every further eight of theirs: where each span's begin, the offset, the span."""
    long_ = np.flatnonzero(ends - starts > 8)
    many = (ends[long_] - starts[long_] - 1) >> 3
    first = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64) if len(long_) else np.empty(0, np.int64)
    span = np.repeat(np.arange(len(long_)), many)
    return long_, first, (np.arange(len(span)) - first[span] + 1) * 8, long_[span]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray | None = None) -> np.ndarray:
    """The hash of each span of the byte array; ``head`` holds the ``eights`` of the spans where they are known."""
    if not len(starts):
        return np.empty(0, np.uint64)
    buffer = padded(data)
    total = mix((eights(buffer, starts, ends) if head is None else head) ^ np.uint64(_BASE))
    long_, first, offset, span = rest(starts, ends)
    if len(long_):
        more = eights(buffer, starts[span] + offset, ends[span])
        total[long_] += np.add.reduceat(mix(more ^ mix(offset.astype(np.uint64))), first)
    return mix(total + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Ranges of texts of about ``size`` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 offsets of the texts among the words.

    Words lie between ASCII white space, or are runs of the bytes for which
    ``letters`` (256 booleans) is true.
    """
    word = ~_SPACE[data] if letters is None else letters[data]
    first = np.empty(len(data) + 1, bool)
    first[0] = False
    first[1:] = word
    first = first[:-1]  # whether the byte before is a word's
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = False
    starts = np.flatnonzero(word & ~first)
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


#: ASCII letters and digits and all bytes beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte Latin-1 capitals in lower case."""
    low = _LOWER[data]
    high = np.flatnonzero(data >= 128)
    if len(high):
        b, before = data[high], data[np.maximum(high - 1, 0)]
        low[high[(before == 0xC3) & (high > 0) & (b < 0x9F) & (b != 0x97)]] += 32
    return low


def sequence_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words, or of all words of a shorter text; and the texts' offsets among them."""
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    base = np.uint64(_BASE)
    if len(words) >= k:
        run = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            run = run * base + words[j : len(words) - k + 1 + j]
        run = mix(run)
    else:
        run = np.empty(0, np.uint64)
    full = np.flatnonzero(counts >= k)
    out = np.empty(int(out_bounds[-1]), np.uint64)
    if len(full):
        length = n[full]
        at = np.repeat(bounds[full] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
        out[np.repeat(out_bounds[full] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))] = run[at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = np.uint64(0)
        for w in words[bounds[i] : bounds[i + 1]]:
            h = np.uint64((int(h) * _BASE + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[out_bounds[i]] = mix(np.array([h ^ np.uint64(counts[i])], np.uint64))[0]
    return out, out_bounds
