"""One pass over the texts of an Arrow batch: which of many literals, and of tests made of them, hold in a text, and how many words and sentences it has.

Every literal has a key, four (or three) of its bytes. The keys at all positions of a batch are looked up in a table of 65,536 slots by
numpy; where one fits, the whole literal is compared. The cost hardly grows with the number of literals. Work and memory are
bounded by the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_COMMON = dict(zip(b"etaoinsrhldcumfpgwybvkxjqz ", (12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 2, 1, 1, 1, 0, 0, 0, 0, 15)))
_MIX = np.uint32(2654435761)
_SPACE, _STOP, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b" \t\n\v\f\r")] = _SPACE
_CLASS[list(b".!?")] = _STOP
_LEADS = np.zeros(256, bool)  # first bytes of spaces beyond ASCII
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
LEAST = 3  # bytes of the shortest literal that is looked for


class Finder:
    """Which literals occur in each text."""

    def __init__(self, literals: list[str]):
        self.sizes = []
        keyed: dict[int, dict[int, list[tuple[int, int, bytes]]]] = {}
        for i, x in enumerate(literals):
            raw = x.encode()
            size = min(4, len(raw))
            at = min(range(len(raw) - size + 1), key=lambda o: sum(_COMMON.get(c, 0) for c in raw[o:o + size]))
            keyed.setdefault(size, {}).setdefault(int.from_bytes(raw[at:at + size], "little"), []).append((i, at, raw))
        for size, table in keyed.items():
            keys = np.array(sorted(table), np.uint32)
            slots = np.zeros(1 << 16, bool)
            slots[(keys * _MIX) >> np.uint32(16)] = True
            self.sizes.append((size, keys, slots, [table[int(k)] for k in keys]))

    def find(self, data: np.ndarray, ends: np.ndarray, found: np.ndarray) -> None:
        """Marks in `found` (literal, text) what occurs; the texts end at `ends` in `data`, the first begins at 0."""
        n = len(data)
        if n < LEAST:
            return
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        for lo in range(0, n, 1 << 18):  # pieces that stay in the processor's cache
            hi = min(n, lo + (1 << 18))
            b = padded[lo:hi + 3].astype(np.uint32)
            here = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16
            for size, keys, slots, entries in self.sizes:
                value = here | b[3:] << 24 if size == 4 else here
                at = np.flatnonzero(slots[(value * _MIX) >> np.uint32(16)])
                if not len(at):
                    continue
                value = value[at]
                which = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                fits = keys[which] == value
                at, which = at[fits] + lo, which[fits]
                order = np.argsort(which, kind="stable")
                at, which = at[order], which[order]
                kinds, firsts = np.unique(which, return_index=True)
                for k, first, last in zip(kinds, firsts, [*firsts[1:], len(which)]):
                    for i, offset, raw in entries[k]:
                        self._mark(data, ends, at[first:last] - offset, size, offset, i, raw, found)

    @staticmethod
    def _mark(data, ends, starts, size, offset, i, raw, found) -> None:
        starts = starts[(starts >= 0) & (starts + len(raw) <= len(data))]
        for j, c in enumerate(raw):
            if not offset <= j < offset + size:
                starts = starts[data[starts + j] == c]
        row = np.searchsorted(ends, starts, side="right")
        row = row[starts + len(raw) <= ends[row]] if len(row) else row  # a literal does not go on in the next text
        found[i, row] = True


def _classes(data: np.ndarray) -> np.ndarray:
    """Space, stop or other per byte; spaces of several bytes are spaces in all of them."""
    out = _CLASS[data]
    leads = np.flatnonzero(_LEADS[data])
    if len(leads):
        padded = np.concatenate((data, np.zeros(2, np.uint8)))
        a, b, c = data[leads], padded[leads + 1], padded[leads + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) |
                 ((a == 0xE2) & (((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))))
        for part in (leads[two], leads[two] + 1, leads[three], leads[three] + 1, leads[three] + 2):
            out[part] = _SPACE
    return out


def _per_text(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    return np.diff(np.searchsorted(at, ends, side="left"), prepend=0)


def counts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without space; runs without space or stop; pieces between stops that hold more than space."""
    if not len(data):
        return (np.zeros(len(ends), np.int64),) * 3
    kind = _classes(data)
    start = np.zeros(len(data) + 1, bool)
    start[0] = True
    start[ends] = True
    start = start[:-1]
    solid, other = kind != _SPACE, kind == _OTHER
    words = solid.copy()
    words[1:] &= ~solid[:-1] | start[1:]
    plain = other.copy()
    plain[1:] &= ~other[:-1] | start[1:]
    at = np.flatnonzero(plain | (kind == _STOP))
    row, opens = np.searchsorted(ends, at, side="right"), plain[at]
    opens[1:] &= ~plain[at[:-1]] | (row[1:] != row[:-1])
    return _per_text(np.flatnonzero(words), ends), _per_text(np.flatnonzero(plain), ends), _per_text(at[opens], ends)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text ends."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets[1:] - offsets[0]


TYPE = "struct<bits: array<bigint>, words: int, plain: int, sentences: int>"


def _holds(test, found: np.ndarray) -> np.ndarray:
    """A test over the literals of all texts: the number of a literal, or ("and" or "or", tests)."""
    if isinstance(test, int):
        return found[test]
    kind, parts = test
    return (np.logical_and if kind == "and" else np.logical_or).reduce([_holds(p, found) for p in parts])


def scanner(lows: list[str], texts: list[str], tests: list):
    """Function over Arrow columns (text, low): bits of the tests, 63 to a number, and the counts.

    The literals of `lows` are looked for in the lower-cased copy, those of `texts`, which are numbered after them, in the text itself.
    """
    finders = (Finder(lows), Finder(texts))

    def scan(text: pa.Array, low: pa.Array) -> pa.Array:
        found = np.zeros((len(lows) + len(texts), len(text)), bool)
        if lows:
            finders[0].find(*_bytes(low), found[:len(lows)])
        if texts:
            finders[1].find(*_bytes(text), found[len(lows):])
        width = -(-len(tests) // 63)
        bits = np.zeros((len(text), width), np.int64)
        for i, test in enumerate(tests):
            bits[:, i // 63] |= _holds(test, found).astype(np.int64) << np.int64(i % 63)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * width), pa.array(bits.ravel(), pa.int64()))
        return pa.StructArray.from_arrays([bits, *(pa.array(c, pa.int32()) for c in counts(*_bytes(text)))], ["bits", "words", "plain", "sentences"],
                                          mask=pc.or_(text.is_null(), low.is_null()))
    return scan
