"""Token ids of whole texts, through the ``tokenizers`` library.

The result equals ``Tokenizer.encode(text, add_special_tokens=False)``. For a
vocabulary whose words end at white space (which it drops), a text's ids are
those of its chunks between ASCII white space, one after another. A chunk of
Latin letters and ASCII marks is cut into runs of either, as the vocabulary's
pattern cuts it, and each run goes to the library's merge model; any other chunk
goes through the whole tokenizer. Each different run or chunk is encoded once
and remembered in a table of fixed size, looked up for many words at a time by
64-bit hash and then compared byte by byte. A text with the opening of a special token, and every
text for a vocabulary of another build, goes through the whole tokenizer.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from tokenizers import Tokenizer

from . import bytescan

_SLOTS = 1 << 20
#: Ids held for remembered runs; then the table starts anew.
_MOST_IDS = 6_000_000
#: Bytes held of remembered runs, likewise.
_MOST_BYTES = 1 << 25

_SPACE, _LETTER, _MARK, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[65:91] = out[97:123] = out[128:] = _LETTER
    for lo, hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
        out[lo:hi] = _MARK
    out[39] = _OTHER  # an apostrophe may begin a clitic
    return out


_CLASS = _classes()


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else extra))
        extra += b not in printable
    return out


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            norm == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0].get("behavior") == "Removed" and bool(spec["model"].get("end_of_word_suffix"))
        )
        self.marks = sorted({t["content"][:2].encode() for t in spec.get("added_tokens", [])})
        self._reset()

    def _reset(self) -> None:
        self.head = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.uint32)
        self.many = np.zeros(_SLOTS, np.uint32)
        self.bytes_long = np.zeros(_SLOTS, np.uint32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.raw_at = np.zeros(_SLOTS, np.int64)
        self.raw = np.zeros(1 << 16, np.uint8)
        self.raw_used = 0

    def _room(self, n: int) -> None:
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n, len(self.ids)), np.uint32)])

    def _hold(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the bytes of the runs are held."""
        n = int(sizes.sum())
        if self.raw_used + n + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(max(n + 8, len(self.raw)), np.uint8)])
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.raw[self.raw_used : self.raw_used + n] = low[np.repeat(starts - before, sizes) + np.arange(n)]
        at = self.raw_used + before
        self.raw_used += n
        return at

    def _same(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the bytes held from ``at`` on are the runs' bytes, from the ninth on."""
        same = np.ones(len(starts), bool)
        long_, first, offset, span = bytescan.rest(starts, ends)
        if len(long_):
            a, b = starts[span] + offset, at[span] + offset
            equal = bytescan.eights(buffer, a, ends[span]) == bytescan.eights(self.raw, b, b + (ends[span] - a))
            same[long_] = np.logical_and.reduceat(equal, first)
        return same

    def _whole(self, raw: bytes) -> list[int]:
        return self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' n + 1 offsets among them."""
        out, lengths = [], []
        for i, j in bytescan.pieces(offsets):
            lo, hi = offsets[i], offsets[j]
            ids, n = self._piece(data[lo:hi], offsets[i : j + 1] - lo)
            out.append(ids)
            lengths.append(n)
        bounds = np.concatenate([[0], *lengths]).astype(np.int64)
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), np.cumsum(bounds)

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        raw = data.tobytes()
        if not self.by_word or any(m in raw for m in self.marks):
            if n > 1:
                parts = [self._piece(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])) for i in range(n)]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            ids = self._whole(raw)
            return np.array(ids, np.uint32), np.array([len(ids)])
        return self._by_word(data, offsets)

    def _by_word(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, low = _CLASS[data], bytescan.lower_ascii(data)
        high = np.flatnonzero(data >= 128)
        if len(high):  # two-byte Latin letters count as letters, all else beyond ASCII as other
            b, before = data[high], data[np.maximum(high - 1, 0)]
            tail = (before == 0xC3) & (high > 0) & (b < 0xC0)
            kind[high[~((b == 0xC3) | (tail & (b != 0x97) & (b != 0xB7)))]] = _OTHER
            low[high[tail & (b < 0x9F) & (b != 0x97)]] += 32
        inner = np.zeros(len(data), bool)  # the byte before is of the same text and no space
        inner[1:] = kind[:-1] != _SPACE
        edge = offsets[:-1][offsets[:-1] < len(data)]
        inner[edge] = False
        word = kind != _SPACE
        chunk = np.flatnonzero(word & ~inner)
        if not len(chunk):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        turn = np.zeros(len(data), bool)
        turn[1:] = kind[1:] != kind[:-1]
        odd = np.logical_or.reduceat(kind == _OTHER, chunk)
        starts = np.flatnonzero(word & (~inner | turn))
        own = np.searchsorted(chunk, starts, "right") - 1
        keep = ~odd[own] | (starts == chunk[own])
        starts, odd = starts[keep], odd[own[keep]]
        stop = np.ones(len(data) + 1, bool)
        stop[:-1] = ~word
        stop[edge] = True
        stop[starts] = True
        limits = np.flatnonzero(stop)
        ends = limits[np.searchsorted(limits, starts, "right")]
        buffer = bytescan.padded(low)
        head = bytescan.eights(buffer, starts, ends)
        keys = bytescan.span_hashes(low, starts, ends, head)
        sizes = (ends - starts).astype(np.uint32)
        slots = (keys >> np.uint64(44)).astype(np.int64)
        # the first eight bytes are held as a number, all of them for the runs beyond
        known = np.flatnonzero((self.head[slots] == head) & (self.bytes_long[slots] == sizes))
        known = known[self._same(buffer, starts[known], ends[known], self.raw_at[slots[known]])]
        row_at, row_many = self.at[slots].astype(np.int64), self.many[slots].astype(np.int64)
        new = np.ones(len(starts), bool)
        new[known] = False
        missing = np.flatnonzero(new)
        if len(missing):
            raw, seen, back = low.tobytes(), {}, np.empty(len(missing), np.int64)
            for k, (a, b) in enumerate(zip(starts[missing].tolist(), ends[missing].tolist())):
                back[k] = seen.setdefault(raw[a:b], len(seen))
            first = np.empty(len(seen), np.int64)
            first[back[::-1]] = missing[::-1]
            at, many = self._learn(raw, starts[first].tolist(), ends[first].tolist(), odd[first].tolist())
            row_at[missing], row_many[missing] = at[back], many[back]
            s, held = slots[first], self._hold(low, starts[first], (ends - starts)[first])
            self.head[s], self.at[s], self.many[s], self.bytes_long[s], self.raw_at[s] = head[first], at, many, sizes[first], held
        so_far = np.concatenate([[0], np.cumsum(row_many)])
        ids = self.ids[np.repeat(row_at - so_far[:-1], row_many) + np.arange(so_far[-1])]
        n = np.diff(so_far[np.searchsorted(starts, offsets)])
        if self.used > _MOST_IDS or self.raw_used > _MOST_BYTES:
            self._reset()
        return ids, n

    def _learn(self, raw: bytes, starts: list, ends: list, odd: list) -> tuple[np.ndarray, np.ndarray]:
        merge, letters, flat, many = self.merge, self.letters, [], []
        for a, b, other in zip(starts, ends, odd):
            unit = raw[a:b]
            if other:
                ids = self._whole(unit)
            elif unit.isascii():
                ids = [t.id for t in merge(unit.decode())]
            else:
                ids = [t.id for t in merge("".join([letters[x] for x in unit]))]
            flat += ids
            many.append(len(ids))
        many = np.array(many, np.int64)
        self._room(len(flat))
        at = self.used + np.concatenate([[0], np.cumsum(many)[:-1]])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return at, many


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)
