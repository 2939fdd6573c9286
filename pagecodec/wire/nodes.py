"""Physical arrays and codec nodes: writing, bounded reading, decoding, slicing and point access.

All integers are little-endian. A physical array is a 20-byte header (version, type, flags, rows, body bytes) and its
body; a node is a 24-byte header (version, codec, type, 0, flags, rows, inline bytes), its inline body and children.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions import PTYPE_CODES, PTYPES, ptype_class
from . import kernels as k

CONST, RAW, DICT, RUNEND, ZIGZAG, BITPACK, FOR, SPARSE, SEQUENCE, ALP, FSST, ALPRD, DELTA, NULLABLE = range(1, 15)
NAMES = dict(zip(range(1, 15), "const raw dict runend zigzag bitpack for sparse sequence alp fsst alprd delta nullable".split(), strict=True))
ARRAY_HEADER, NODE_HEADER = struct.Struct("<BBHQQ"), struct.Struct("<BBBBIQQ")
PATCHED = BITMAP = 1
UNSIGNED = ("uint8", "uint16", "uint32", "uint64")


class FormatError(ValueError):
    """The bytes aren't a valid page, or go beyond the read limits."""


@dataclass(frozen=True)
class Limits:
    """Bounds on what a page may declare before anything of that size is allocated or decoded."""

    max_length: int = 1 << 26
    max_bytes: int = 1 << 30
    max_decoded: int = 64 << 20
    max_depth: int = 32
    max_work: int = 1 << 28


def ok(condition: bool, what: str) -> None:
    if not condition:
        raise FormatError(what)


# -- physical arrays -------------------------------------------------------------------------------------------------
def bitmap(valid: np.ndarray) -> bytes:
    return np.packbits(valid.astype(np.uint8), bitorder="little").tobytes()


def array_bytes(values, ptype: str, valid: np.ndarray | None = None) -> bytes:
    """One physical array; an all-valid one has no bitmap."""
    n = len(values)
    has = valid is not None and not valid.all()
    body = bitmap(valid) if has else b""
    if ptype == "string":
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in values]))).astype(np.uint64)
        total = int(offsets[-1])
        width = 1 if total <= 0xFF else 2 if total <= 0xFFFF else 4
        ok(total < 1 << 32, "strings of a page go beyond 4 GiB")
        body += struct.pack("<I", total) + offsets.astype(f"<u{width}").tobytes() + b"".join(values)
    else:
        body += np.ascontiguousarray(values, k.DTYPES[ptype]).tobytes()
    return ARRAY_HEADER.pack(1, PTYPE_CODES[ptype], int(has), n, len(body)) + body


class Cursor:
    """A position in a buffer; slices share its memory."""

    def __init__(self, data, limits: Limits = Limits()):
        self.data, self.at, self.limits, self.depth, self.work = memoryview(data), 0, limits, 0, limits.max_work

    def take(self, n: int) -> memoryview:
        ok(0 <= n <= len(self.data) - self.at, "the page ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def charge(self, n: int) -> None:
        """Account for validation that decodes a child."""
        ok(n <= self.limits.max_decoded, "a decode goes beyond its limit")
        self.work -= n
        ok(self.work >= 0, "validation goes beyond its work limit")


def read_array(c: Cursor, ptype: str) -> tuple:
    """Values and validity (None: all valid) of one physical array."""
    version, code, flags, n, size = ARRAY_HEADER.unpack(c.take(20))
    ok(version == 1, "unknown array version")
    ok(code == PTYPE_CODES[ptype], "another array type than declared")
    ok(flags in (0, 1), "unknown array flags")
    ok(n <= c.limits.max_length and size <= c.limits.max_bytes, "an array goes beyond the read limits")
    body = c.take(size)
    valid, at = None, 0
    if flags:
        at = (n + 7) // 8
        ok(len(body) >= at, "the validity bitmap ends early")
        cells = np.unpackbits(np.frombuffer(body[:at], np.uint8), bitorder="little")
        ok(not cells[n:].any(), "padding bits of a bitmap are set")
        valid = cells[:n].astype(bool)
        ok(not valid.all(), "an all-valid array has a bitmap")
    rest = body[at:]
    if ptype != "string":
        ok(len(rest) == n * PTYPES[code][1], "an array's size isn't its rows times its width")
        return np.frombuffer(rest, k.DTYPES[ptype]), valid
    ok(len(rest) >= 4, "a string array ends early")
    total = struct.unpack("<I", rest[:4])[0]
    room = len(rest) - 4 - total
    ok(room > 0 and room % (n + 1) == 0 and room // (n + 1) in (1, 2, 4, 8), "string offsets have no whole width")
    offsets = np.frombuffer(rest[4 : 4 + room], f"<u{room // (n + 1)}").astype(np.uint64)
    ok(offsets[0] == 0 and int(offsets[-1]) == total and bool((offsets[1:] >= offsets[:-1]).all()), "string offsets aren't monotonic over the buffer")
    buf, cuts = bytes(rest[4 + room :]), offsets.tolist()
    return [buf[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], valid


# -- nodes -----------------------------------------------------------------------------------------------------------
@dataclass
class Node:
    """One node. ``parts`` follow the inline body: children, and raw bytes where the format has them between."""

    codec: int
    ptype: str
    n: int
    body: bytes = b""
    parts: list = field(default_factory=list)
    flags: int = 0

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]

    @property
    def size(self) -> int:
        return 24 + len(self.body) + sum(x.size if isinstance(x, Node) else len(x) for x in self.parts)

    @property
    def tree(self) -> str:
        inner = ",".join(c.tree for c in self.children)
        return NAMES[self.codec] + (f"({inner})" if inner else "")

    def to_bytes(self) -> bytes:
        head = NODE_HEADER.pack(1, self.codec, PTYPE_CODES[self.ptype], 0, self.flags, self.n, len(self.body))
        return head + self.body + b"".join(x.to_bytes() if isinstance(x, Node) else x for x in self.parts)

    @property
    def decoded_bytes(self) -> int:
        """Bytes that decoding holds at once: this node's rows and its children's."""
        own = self.n * (PTYPES[PTYPE_CODES[self.ptype]][1] or 16)
        return own + len(self.body) * (self.ptype == "string") + sum(c.decoded_bytes for c in self.children)

    def decode(self, limits: Limits | None = Limits()) -> tuple:
        """Values and validity; refuses footprints beyond the limit before allocating (None: trusted)."""
        ok(limits is None or self.decoded_bytes <= limits.max_decoded, "decoding goes beyond its limit")
        return _decode(self)

    def values(self):
        return self.decode(None)[0]

    def value_at(self, i: int):
        """One row's value (None for null); codecs with direct access don't decode the page."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        c = self.children
        if self.codec == CONST:
            return read_array(Cursor(self.body), self.ptype)[0][0]
        if self.codec == SEQUENCE or self.codec == FOR or (self.codec == BITPACK and not self.flags):
            return self.slice(i, i + 1).values()[0]
        if self.codec == DICT:
            return c[0].value_at(int(c[1].value_at(i)))
        if self.codec == RUNEND:
            return c[0].value_at(int(np.searchsorted(c[1].values(), i, side="right")))
        values, valid = self.decode(None)
        return values[i] if valid is None or valid[i] else None

    def slice(self, start: int, end: int) -> Node:
        """Rows [start, end) as a node: of the same codec where that is cheap, else raw."""
        if not 0 <= start <= end <= self.n:
            raise ValueError("a slice needs 0 <= start <= end <= rows")
        m, c = end - start, self.children
        if self.codec == CONST and m:
            return Node(CONST, self.ptype, m, self.body)
        if self.codec == SEQUENCE and m:
            base, step = np.frombuffer(self.body, k.DTYPES[self.ptype])
            return sequence(base + k.DTYPES[self.ptype](start) * step, step, m, self.ptype) if start else Node(SEQUENCE, self.ptype, m, self.body)
        if self.codec == DICT:
            return Node(DICT, self.ptype, m, b"", [c[0], c[1].slice(start, end)])
        if self.codec in (ZIGZAG, FOR):
            return Node(self.codec, self.ptype, m, self.body, [c[0].slice(start, end)])
        if self.codec == BITPACK and not self.flags:
            width, group = self.body[0], start - start % 8  # eight values fill whole bytes
            u = k.unpack(self.body[1 + group * width // 8 :], end - group, width)[start - group :] if width else np.zeros(m, np.uint64)
            return Node(BITPACK, self.ptype, m, bytes([width]) + k.pack(u, width))
        values, valid = self.decode(None)
        return raw(values[start:end], self.ptype, None if valid is None else valid[start:end])


def raw(values, ptype: str, valid: np.ndarray | None = None) -> Node:
    return Node(RAW, ptype, len(values), array_bytes(values, ptype, valid))


def const(value, n: int, ptype: str) -> Node:
    return Node(CONST, ptype, n, array_bytes([value] if ptype == "string" else np.array([value], k.DTYPES[ptype]), ptype))


def sequence(base, step, n: int, ptype: str) -> Node:
    return Node(SEQUENCE, ptype, n, np.array([base, step], k.DTYPES[ptype]).tobytes())


def patches(offset: int, at: Node, values: Node) -> list:
    return [struct.pack("<Q", offset), at, values]


def bitpack(u: np.ndarray, ptype: str, width: int | None = None) -> Node:
    """Packed at the best width; wider values become patches. ``width``: given, no patches."""
    size = u.dtype.itemsize
    if width is None:
        width = k.best_width(u, size) if len(u) else 0
    wide = np.flatnonzero(k.bit_lengths(k.bits_of(u)) > width)
    node = Node(BITPACK, ptype, len(u), bytes([width]) + k.pack(k.bits_of(u), width))
    if len(wide):
        over = u[wide]
        node.flags = PATCHED
        node.parts = patches(0, raw(wide.astype(np.uint64), "uint64"), const(over[0], len(over), ptype) if (over == over[0]).all() else raw(over, ptype))
    return node


def _overlay(out, parts: list):
    """Apply patches (offset, indices, values) to decoded rows."""
    offset = struct.unpack("<Q", parts[0])[0]
    out = out.copy()
    out[parts[1].values().astype(np.int64) - offset] = parts[2].values()
    return out


def _decode(x: Node) -> tuple:
    c, dtype = x.children, k.DTYPES.get(x.ptype)
    if x.codec == RAW:
        return read_array(Cursor(x.body, Limits(1 << 62, 1 << 62)), x.ptype)
    if x.codec == NULLABLE:
        return c[0].values(), np.unpackbits(c[1].values(), count=x.n, bitorder="little").astype(bool)
    if x.codec == CONST:
        v = read_array(Cursor(x.body), x.ptype)[0]
        return (v * x.n if x.ptype == "string" else np.repeat(v, x.n)), None
    if x.codec == DICT:
        return k.take(c[0].values(), c[1].values().astype(np.int64)), None
    if x.codec == RUNEND:
        lengths = np.diff(np.concatenate(([0], c[1].values().astype(np.int64), [x.n])))
        v = c[0].values()
        return (k.take(v, np.repeat(np.arange(len(lengths)), lengths).tolist()) if isinstance(v, list) else np.repeat(v, lengths)), None
    if x.codec == ZIGZAG:
        z = c[0].values().astype(np.uint64)
        return ((z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))).astype(dtype), None
    if x.codec == BITPACK:
        out = k.unpack(x.body[1:], x.n, x.body[0]).astype(f"u{dtype().itemsize}").view(dtype)
        return (_overlay(out, x.parts) if x.flags else out), None
    if x.codec == FOR:
        return (c[0].values().view(f"u{dtype().itemsize}") + np.frombuffer(x.body, f"u{dtype().itemsize}")[0]).view(dtype), None
    if x.codec == SPARSE:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(x.body, np.uint8), count=x.n, bitorder="little")) if x.flags else c[1].values().astype(np.int64)
        fill, v = c[0].values(), c[-1].values()
        out = fill * x.n if isinstance(fill, list) else np.repeat(fill, x.n)
        for i, y in zip(at.tolist(), v, strict=True) if isinstance(out, list) else ():
            out[i] = y
        if not isinstance(out, list):
            out[at] = v
        return out, None
    if x.codec == SEQUENCE:
        base, step = np.frombuffer(x.body, dtype)
        with np.errstate(over="ignore"):
            return (np.arange(x.n).astype(dtype) * step + base).astype(dtype), None
    if x.codec == DELTA:
        u = f"u{dtype().itemsize}"
        with np.errstate(over="ignore"):
            return np.cumsum(np.concatenate((np.frombuffer(x.body, u), c[0].values().view(u))), dtype=u).view(dtype), None
    if x.codec == ALP:
        out = k.alp_decode(c[0].values(), x.body[0], x.body[1], dtype)
        return (_overlay(out, x.parts[1:]) if x.flags else out), None
    if x.codec == ALPRD:
        right, left, n_dict, words, lo, hi = _alprd_body(x)
        codes = k.unpack(lo, x.n, left).astype(np.int64)
        parts = words[codes].astype(np.uint64)
        if x.flags:
            parts = _overlay(parts, x.parts)
        return ((parts << np.uint64(right)) | k.unpack(hi, x.n, right)).astype(f"u{dtype().itemsize}").view(dtype), None
    table, codes = _fsst_body(x)
    return table.decode(codes, c[0].values().astype(np.int64)), None


def _alprd_body(x: Node) -> tuple:
    b = x.body
    ok(len(b) >= 3, "an ALP-RD body ends early")
    right, left, d = b[0], b[1], b[2]
    words = np.frombuffer(b[3 : 3 + 2 * d], np.uint16) if len(b) >= 3 + 2 * d else np.zeros(0, np.uint16)
    at, out = 3 + 2 * d, []
    for width in (left, right):
        ok(len(b) >= at + 4, "an ALP-RD body ends early")
        size = struct.unpack("<I", b[at : at + 4])[0]
        ok(size == (x.n * width + 7) // 8 and len(b) >= at + 4 + size, "a packed ALP-RD part has another size")
        out.append(b[at + 4 : at + 4 + size])
        at += 4 + size
    ok(at == len(b), "bytes follow an ALP-RD body")
    return right, left, d, words, *out


def _fsst_body(x: Node) -> tuple[k.SymbolTable, bytes]:
    b = x.body
    ok(len(b) >= 8, "an FSST body ends early")
    t = struct.unpack("<I", b[:4])[0]
    ok(len(b) >= 8 + t, "an FSST body ends early")
    size = struct.unpack("<I", b[4 + t : 8 + t])[0]
    ok(len(b) == 8 + t + size, "an FSST body has another size than declared")
    try:
        return k.SymbolTable.from_bytes(b[4 : 4 + t]), b[8 + t :]
    except ValueError as e:
        raise FormatError(str(e)) from e


# -- reading ---------------------------------------------------------------------------------------------------------
def load(data, ptype: str, limits: Limits = Limits()) -> Node:
    """Exactly one tree; trailing bytes are an error."""
    c = Cursor(data, limits)
    node = load_prefix(c, ptype)
    ok(c.at == len(c.data), "bytes follow the page")
    return node


def load_prefix(c: Cursor, ptype: str) -> Node:
    """One tree from a cursor, which then stands behind it."""
    return _read(c, (ptype,), True)


def _read(c: Cursor, types: tuple[str, ...], nullable: bool = False, rows: int | None = None, most: int | None = None) -> Node:
    """A validated node of one of ``types``, of exactly ``rows`` or at most ``most`` rows (both known before decoding)."""
    c.depth += 1
    ok(c.depth <= c.limits.max_depth, "the tree is too deep")
    version, codec, code, reserved, flags, n, size = NODE_HEADER.unpack(c.take(24))
    ok(version == 1 and reserved == 0, "unknown version or reserved byte")
    ok(codec in NAMES, "unknown codec")
    ok(code in PTYPES and PTYPES[code][0] in types, "another element type than declared")
    ok(n <= c.limits.max_length and size <= c.limits.max_bytes, "a node goes beyond the read limits")
    ok((rows is None or n == rows) and (most is None or n <= most), "a child has another number of rows than its parent allows")
    ptype = PTYPES[code][0]
    ok(flags == 0 or (flags == 1 and codec in (BITPACK, SPARSE, ALP, ALPRD)), "unknown flags")
    family, width = ptype_class(ptype), PTYPES[code][1]
    allowed = {ZIGZAG: ("signed",), BITPACK: ("signed", "unsigned"), FOR: ("signed", "unsigned"), SEQUENCE: ("signed", "unsigned"), DELTA: ("signed", "unsigned"), ALP: ("float",), ALPRD: ("float",), FSST: ("string",)}
    ok(family in allowed.get(codec, (family,)), "the codec doesn't hold this type")
    body = bytes(c.take(size))
    x = Node(codec, ptype, n, body, [], flags)
    fixed = {FOR: width, DELTA: width, SEQUENCE: 2 * width, ALP: 2, NULLABLE: 8}.get(codec, 0 if codec in (DICT, RUNEND, ZIGZAG) or (codec == SPARSE and not flags) else None)
    ok(fixed is None or size == fixed, "an inline body has another size than its codec says")

    def child(*a, **b) -> Node:
        x.parts.append(got := _read(c, *a, **b))
        return got

    def scan(node: Node):
        c.charge(node.decoded_bytes)
        return node.values()

    def ordered(v: np.ndarray, low: int, end: int, what: str) -> None:
        u = v.astype(np.uint64)
        ok(not len(u) or (int(u[0]) >= low and int(u[-1]) < end and bool((u[1:] > u[:-1]).all())), what)

    def read_patches(types: tuple[str, ...]) -> None:
        x.parts.append(bytes(c.take(8)))
        offset = struct.unpack("<Q", x.parts[-1])[0]
        at = child(UNSIGNED, most=n)
        ok(at.n > 0, "patches are empty")
        child(types, rows=at.n)
        ordered(scan(at), offset, offset + n, "patch indices aren't increasing inside the page")

    if codec == CONST:
        inner = Cursor(body, c.limits)
        v, valid = read_array(inner, ptype)
        ok(n > 0 and len(v) == 1 and valid is None and inner.at == size, "a constant needs rows and one value")
    elif codec == RAW:
        inner = Cursor(body, c.limits)
        v, valid = read_array(inner, ptype)
        ok(len(v) == n and inner.at == size, "a raw node's array has other rows")
        ok(nullable or valid is None, "a structural child has nulls")
    elif codec == NULLABLE:
        ok(nullable, "a structural child is nullable")
        count = struct.unpack("<Q", body)[0]
        ok(1 <= count <= n, "a null count out of range")
        child((ptype,), rows=n)
        cells = np.unpackbits(scan(child(("uint8",), rows=(n + 7) // 8)), bitorder="little")
        ok(not cells[n:].any() and n - int(cells[:n].sum()) == count, "the validity bytes don't give the null count")
    elif codec == DICT:
        v, o = child((ptype,)), child(UNSIGNED, rows=n)
        ok(not n or int(scan(o).max()) < v.n, "an ordinal out of range")
    elif codec == RUNEND:
        ok(n > 0, "run-end without rows")
        v = child((ptype,), most=n)
        ends = child(UNSIGNED, most=n - 1)
        ok(v.n == ends.n + 1 and ends.n <= int(np.iinfo(k.DTYPES[ends.ptype]).max), "runs and ends don't pair")
        ordered(scan(ends), 1, n, "run ends aren't increasing inside the page")
    elif codec == ZIGZAG:
        child(UNSIGNED, rows=n)
    elif codec == BITPACK:
        ok(size >= 1 and body[0] <= 8 * width and size == 1 + (n * body[0] + 7) // 8, "a packed body has another size")
        if flags:
            read_patches((ptype,))
    elif codec == FOR:
        child((ptype,), rows=n)
    elif codec == DELTA:
        ok(n >= 1, "delta without rows")
        child((ptype,), rows=n - 1)
    elif codec == SPARSE:
        ok(not flags or size == (n + 7) // 8, "a sparse bitmap has another size")
        child((ptype,), rows=1)
        if flags:
            cells = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")
            ok(not cells[n:].any(), "padding bits of a bitmap are set")
            child((ptype,), rows=int(cells[:n].sum()))
        else:
            at = child(UNSIGNED, most=n)
            ok(at.n <= int(np.iinfo(k.DTYPES[at.ptype]).max) + 1, "more indices than their type holds")
            child((ptype,), rows=at.n)
            ordered(scan(at), 0, n, "sparse indices aren't increasing inside the page")
    elif codec == SEQUENCE:
        ok(n > 0, "a sequence without rows")
    elif codec == ALP:
        ok(max(body) <= (10 if ptype == "float32" else 23), "an exponent out of range")
        child(("int32",) if ptype == "float32" else ("int64",), rows=n)
        if flags:
            read_patches((ptype,))
    elif codec == ALPRD:
        right, left, d, words, lo, _ = _alprd_body(x)
        ok(1 <= left <= 3 and 1 <= d <= 8 and len(words) == d and 8 * width - 16 <= right < 8 * width, "ALP-RD widths out of range")
        c.charge(8 * n)
        ok(not n or int(k.unpack(lo, n, left).max()) < d, "an ALP-RD code out of range")
        if flags:
            read_patches(("uint16",))
    elif codec == FSST:
        table, codes = _fsst_body(x)
        cuts, lengths = scan(child(UNSIGNED, rows=n + 1)).astype(np.int64), scan(child(UNSIGNED, rows=n)).astype(np.int64)
        ok(int(cuts[0]) == 0 and int(cuts[-1]) == len(codes) and bool((cuts[1:] >= cuts[:-1]).all()), "FSST offsets aren't monotonic over the codes")
        ok(bool((lengths <= 8 * np.diff(cuts)).all()), "an FSST length is longer than its codes can give")
        c.charge(int(lengths.sum()))
        try:
            ok(bool((table.decoded_lengths(codes, cuts) == lengths).all()), "an FSST row has another length")
        except IndexError as e:
            raise FormatError("an FSST code without a symbol") from e
    c.depth -= 1
    return x
