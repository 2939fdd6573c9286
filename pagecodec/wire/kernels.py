"""Vectorised kernels on numpy arrays; strings are lists of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

DTYPES = {"int8": np.int8, "int16": np.int16, "int32": np.int32, "int64": np.int64, "uint8": np.uint8, "uint16": np.uint16, "uint32": np.uint32, "uint64": np.uint64, "float32": np.float32, "float64": np.float64}


def bits_of(v: np.ndarray) -> np.ndarray:
    """The values' bit patterns as unsigned integers of their width."""
    return np.ascontiguousarray(v).view(f"u{v.dtype.itemsize}")


def bit_lengths(u: np.ndarray) -> np.ndarray:
    """Bits needed by each unsigned value; exact for all 64-bit values."""
    u = u.astype(np.uint64)
    out = np.zeros(len(u), np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        high = (u >> np.uint64(shift)) != 0
        out[high] += shift
        u = np.where(high, u >> np.uint64(shift), u)
    return out + (u != 0)


def pack(u: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, least significant bit first."""
    if not width or not len(u):
        return b""
    cells = np.unpackbits(np.ascontiguousarray(u.astype("<u8")).view(np.uint8).reshape(len(u), 8), axis=1, bitorder="little")[:, :width]
    return np.packbits(cells.ravel(), bitorder="little").tobytes()


def unpack(buf: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    cells = np.zeros((n, 64), np.uint8)
    cells[:, :width] = np.unpackbits(np.frombuffer(buf, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(cells, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def best_width(u: np.ndarray, bytes_per_value: int) -> int:
    """Width of least packed bytes plus exceptions at value width and four bytes each; the lowest of equals."""
    n, h = len(u), np.bincount(bit_lengths(u), minlength=8 * bytes_per_value + 1)
    wider = n - np.cumsum(h)
    cost = (np.arange(len(h)) * n + 7) // 8 + wider * (bytes_per_value + 4)
    return int(cost.argmin())


def uint_for(top: int) -> str:
    """The narrowest unsigned type that holds ``top``."""
    return next(t for t, bits in (("uint8", 8), ("uint16", 16), ("uint32", 32), ("uint64", 64)) if top < 1 << bits)


def first_occurrence(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct keys in order of first occurrence, and each row's ordinal."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return first[order], rank[inverse.ravel()]


def keys_of(v) -> np.ndarray:
    """Integers equal exactly where the values are equal bit by bit."""
    if isinstance(v, list):
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(x, len(seen)) for x in v), np.int64, len(v))
    return bits_of(v)


def take(v, at):
    return [v[i] for i in at] if isinstance(v, list) else v[at]


def run_starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


TEN = np.array([float(f"1e{k}") for k in range(24)])
INVERSE = np.array([float(f"1e-{k}") for k in range(24)])


def alp_encode(v: np.ndarray, e: int, f: int) -> np.ndarray:
    """Rounded half away from zero; NaN becomes 0 and what doesn't fit is clipped."""
    with np.errstate(all="ignore"):
        x = v.astype(np.float64) * TEN[e] * INVERSE[f]
        x = np.where(np.isnan(x), 0.0, x)
        whole = np.trunc(x)
        x = whole + np.where(np.abs(x - whole) >= 0.5, np.copysign(1.0, x), 0.0)
        kind, top = (np.int32, 2147483647.0) if v.dtype == np.float32 else (np.int64, 9223372036854774784.0)
        return np.clip(x, -top, top).astype(kind)


def alp_decode(i: np.ndarray, e: int, f: int, dtype) -> np.ndarray:
    if dtype == np.float32:
        return i.astype(np.float32) * INVERSE[e].astype(np.float32) * TEN[f].astype(np.float32)
    return i.astype(np.float64) * INVERSE[e] * TEN[f]


def alp_exponents(v: np.ndarray) -> tuple[int, int]:
    s = v[:: len(v) // 64] if len(v) > 64 else v
    bits, best = bits_of(s), None
    for e in range(10 if v.dtype == np.float32 else 23):
        for f in range(e):
            x = int((bits_of(alp_decode(alp_encode(s, e, f), e, f, v.dtype)) != bits).sum())
            if best is None or (x, e - f) < best[:2]:
                best = (x, e - f, e, f)
    return best[2], best[3]


def alprd_cut(v: np.ndarray) -> tuple[int, np.ndarray]:
    """Left bits and the dictionary of left parts of least cost."""
    u = bits_of(v[:: len(v) // 1024] if len(v) > 1024 else v).astype(np.uint64)
    total, best = 8 * v.dtype.itemsize, None
    for cut in range(1, 17):
        left, n = np.unique(u >> np.uint64(total - cut), return_counts=True)
        order = np.lexsort((left, -n))[:8]
        k = len(order)
        cost = total - cut + max(1, (k - 1).bit_length()) + 32 * (len(u) - int(n[order].sum())) / len(u)
        if best is None or cost < best[0]:
            best = (cost, cut, left[order])
    return best[1], best[2].astype(np.uint16)


#: Bytes or codes of a page that are looked up at a time, which bounds the eight-byte cells made of them.
AT_ONCE = 1 << 18


class SymbolTable:
    """Up to 255 byte strings of at most eight bytes; code 255 escapes one literal byte.

    Encoding takes the longest symbol at each place, never beyond its string's end. All strings of a page go at once.
    """

    def __init__(self, symbols: list[bytes]):
        self.symbols = symbols
        self.lengths = np.array([*map(len, symbols), *[1] * (256 - len(symbols))], np.uint8)

    @cached_property
    def _longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where ranges of eight bytes, read as numbers, start that have one longest symbol, its code (255: none), and each code's next shorter one."""
        codes: dict[bytes, int] = {}
        for code, s in enumerate(self.symbols):
            codes.setdefault(s, code)
        starts = {0}
        for s in codes:
            low = int.from_bytes(s.ljust(8, b"\0"), "big")
            starts |= {low, low + (1 << 8 * (8 - len(s)))} - {1 << 64}
        longest = lambda cell, most: next((codes[cell[:n]] for n in range(most, 0, -1) if cell[:n] in codes), 255)
        order = sorted(starts)
        shorter = [longest(s, len(s) - 1) for s in self.symbols]
        return np.array(order, np.uint64), np.array([longest(x.to_bytes(8, "big"), 8) for x in order], np.uint8), np.array(shorter + [255] * (256 - len(shorter)), np.uint8)

    @classmethod
    def train(cls, strings: list[bytes], sample_bytes: int = 1 << 14, rounds: int = 5) -> SymbolTable:
        """Grow symbols by joining neighbours, keeping those that gain most bytes on an even sample."""
        total = sum(map(len, strings))
        step = max(1, total // sample_bytes)
        sample, table = strings[::step], cls([])
        flat, first = b"".join(sample), np.cumsum([0, *map(len, sample)])
        cells, fresh = np.ndarray((len(flat),), ">u8", flat + bytes(8), 0, (1,)), np.zeros(len(flat) + 1, bool)
        fresh[first] = True
        for _ in range(rounds):
            gain: dict[bytes, int] = {}
            last = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for low, at, code in table.parts(flat, first):
                at, size = at + low, table.lengths[code].astype(np.int64)
                before, width = np.concatenate((last[0], at)), np.concatenate((last[1], size))
                pair = width[:-1] + width[1:]
                joins = (pair <= 8) & ~fresh[before[1:]]
                starts, sizes, last = np.concatenate((at, before[:-1][joins])), np.concatenate((size, pair[joins])), (before[-1:], width[-1:])
                for n in range(1, 9):
                    found, times = np.unique(cells[starts[sizes == n]].astype(np.uint64) >> np.uint64(64 - 8 * n), return_counts=True)
                    raw = found.astype(">u8").tobytes()
                    for i, c in enumerate(times.tolist(), 1):
                        s = raw[8 * i - n : 8 * i]
                        gain[s] = gain.get(s, 0) + c * n
            table = cls([s for s, _ in sorted(gain.items(), key=lambda x: (-x[1], x[0]))[:255]])
        return table

    def parts(self, flat: bytes, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Spans of joined strings: where one starts, where in it parts start, and their codes (255: a literal byte).

        ``first``: where each string starts, and the end.
        """
        starts, cells, shorter = self._longest
        ends, size, at = first[1:], np.diff(first), 0
        for low in range(0, len(flat), AT_ONCE):
            n = min(AT_ONCE, len(flat) - low)
            ahead = np.ndarray((n,), ">u8", flat[low : low + n + 7].ljust(n + 7, b"\0"), 0, (1,)).astype(np.uint64)
            code = cells[np.searchsorted(starts, ahead, side="right") - 1]
            near = slice(*np.searchsorted(ends, (low + 1, low + n + 7)))
            for left in range(1, 8):  # bytes before the string's end
                last = ends[near][size[near] >= left] - left - low
                last = last[(last >= 0) & (last < n)]
                while len(last := last[self.lengths[code[last]] > left]):
                    code[last] = shorter[code[last]]
            marks, step = bytearray(n), self.lengths[code].tobytes()
            while at < n:
                marks[at] = 1
                at += step[at]
            at -= n
            found = np.flatnonzero(np.frombuffer(marks, np.uint8))
            yield low, found, code[found]

    def encode(self, strings: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The codes of all strings, and where each string's start, and the end."""
        flat, first = b"".join(strings), np.cumsum([0, *map(len, strings)])
        cuts, out, done = np.zeros(len(first), np.int64), [], 0
        for low, at, code in self.parts(flat, first):
            literal = code == 255
            places = np.concatenate(([0], np.cumsum(1 + literal)))
            cells = np.empty(int(places[-1]), np.uint8)
            cells[places[:-1]] = code
            cells[places[:-1][literal] + 1] = np.frombuffer(flat, np.uint8)[low + at[literal]]
            here = slice(*np.searchsorted(first, (low, low + AT_ONCE)))
            cuts[here] = done + places[np.searchsorted(at, first[here] - low)]
            out.append(cells.tobytes())
            done += len(cells)
        cuts[first == len(flat)] = done
        return b"".join(out), cuts

    def _ends(self, codes: bytes, cuts: np.ndarray, parts: list[bytes] | None = None) -> np.ndarray:
        """Where each row's bytes start, and the end; rows' codes lie between two of ``cuts``. ``parts`` collects the bytes.

        A cell is a code's symbol, nothing for an escape, or the literal behind it (256 more), which a row's end can cut off.
        """
        cells, sizes = np.zeros((512, 8), np.uint8), np.concatenate((self.lengths[:255], [0], np.ones(256, np.uint8))).astype(np.uint8)
        for i, s in enumerate(self.symbols):
            cells[i, : len(s)] = list(s)
        cells[256:, 0] = np.arange(256)
        kept, ends, done, escaped = np.arange(8) < sizes[:, None], np.zeros(len(cuts), np.int64), 0, False
        for low in range(0, len(codes), AT_ONCE):
            c = np.frombuffer(codes, np.uint8)[low : low + AT_ONCE].astype(np.int64)
            here = slice(*np.searchsorted(cuts, (low, low + len(c) + 1)))
            starts = np.zeros(len(c) + 1, bool)
            starts[cuts[here] - low] = True
            if escaped and not starts[0]:
                c[0] += 256
            high = np.flatnonzero(c == 255)  # of those in a row every other one is an escape
            fresh = starts[high] | np.concatenate(([True], np.diff(high) > 1))[: len(high)]
            rank = np.arange(len(high))
            escapes = high[(rank - np.maximum.accumulate(np.where(fresh, rank, 0))) % 2 == 0]
            literals = escapes[~starts[escapes + 1]] + 1
            escaped = len(escapes) > 0 and int(escapes[-1]) == len(c) - 1
            c[literals[literals < len(c)]] += 256
            if ((c >= len(self.symbols)) & (c < 255)).any():
                raise IndexError("a code without a symbol")
            ends[here] = done + np.concatenate(([0], np.cumsum(sizes[c], dtype=np.int64)))[cuts[here] - low]
            done += int(sizes[c].sum(dtype=np.int64))
            if parts is not None:
                parts.append(cells[c][kept[c]].tobytes())
        return ends

    def decoded_lengths(self, codes: bytes, cuts: np.ndarray) -> np.ndarray:
        """Bytes of each row."""
        return np.diff(self._ends(codes, cuts))

    def decode(self, codes: bytes, cuts: np.ndarray) -> list[bytes]:
        """Each row's bytes."""
        parts: list[bytes] = []
        ends = self._ends(codes, cuts, parts).tolist()
        flat = b"".join(parts)
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def to_bytes(self) -> bytes:
        return bytes([len(self.symbols), *map(len, self.symbols)]) + b"".join(self.symbols)

    @classmethod
    def from_bytes(cls, data: bytes) -> SymbolTable:
        n = data[0] if data else 0
        lengths = data[1 : 1 + n]
        if not data or len(lengths) != n or len(data) != 1 + n + sum(lengths) or any(not 1 <= x <= 8 for x in lengths):
            raise ValueError("bad symbol table")
        out, at = [], 1 + n
        for x in lengths:
            out.append(data[at : at + x])
            at += x
        return cls(out)
