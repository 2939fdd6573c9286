"""Choosing a codec tree for a page: statistics, estimates, samples, exclusions, raw fallback."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions import PTYPE_CODES, PTYPES, ptype_class
from ..plans.estimates import EXCLUSIONS
from . import kernels as k
from . import nodes as x

MIN_RAW, MAP_LIMIT, STRING_LIMIT, FLOAT_LIMIT, LONG = 256, 256, 4096, 8192, 1024
WINDOW, MIN_WINDOWS, SEED, MUL, INC = 64, 16, 1234567890, 6364136223846793005, 1442695040888963407


@dataclass(frozen=True)
class Options:
    """Depth of cascading (0 or less: 3), codecs never used, and a bound on any buffer that is built."""

    depth: int = 3
    exclude: frozenset[str] = frozenset()
    max_bytes: int = 64 << 20


@dataclass(frozen=True)
class Context:
    depth: int
    exclude: frozenset[str]
    sample: bool = False
    nulls: int = 0
    trace: list | None = field(default=None, compare=False)
    max_bytes: int = 64 << 20
    #: Builds a child in the planner's stead: of parent, place, values and type.
    make: Callable | None = field(default=None, compare=False)
    #: Strings last coded by a symbol table and what came of it: a short page is its own sample, and isn't coded twice.
    coded: list | None = field(default=None, compare=False)

    def build(self, parent: str, place: int, v, ptype: str) -> x.Node:
        """A structural child, planned or made by a caller's builder, of the rows given and without nulls."""
        within(v, ptype, self.max_bytes)
        node = plan(v, ptype, self.child(parent, place)) if self.make is None else self.make(parent, place, v, ptype)
        if not isinstance(node, x.Node) or node.n != len(v) or node.ptype != ptype or node.codec == x.NULLABLE:
            raise ValueError(f"a child of {parent} must be a page of {len(v)} rows of {ptype} without nulls")
        return node

    def child(self, parent: str, place: int) -> Context:
        return replace(self, depth=self.depth - 1, exclude=self.exclude | {parent, *EXCLUSIONS.get((parent, place), ())}, nulls=0, trace=None, coded=None)


def within(v, ptype: str, most: int) -> None:
    if raw_size(v, ptype) > most:
        raise MemoryError("a buffer of the page is larger than the build limit")


class NotApplicable(Exception):
    """A scheme doesn't fit the page."""


def raw_size(v, ptype: str) -> int:
    if ptype != "string":
        return 44 + len(v) * PTYPES[PTYPE_CODES[ptype]][1]
    total = sum(map(len, v))
    return 48 + (len(v) + 1) * (1 if total <= 0xFF else 2 if total <= 0xFFFF else 4) + total


def sample_windows(n: int) -> list[tuple[int, int]]:
    """The 64-row windows of a page of n rows; the whole page if they would cover it."""
    runs = max(MIN_WINDOWS, -(-(n // 100 // WINDOW) // MIN_WINDOWS) * MIN_WINDOWS)
    if runs * WINDOW >= n:
        return [(0, n)]
    short, long_parts, state, at, out = n // runs, n % runs, SEED, 0, []
    for i in range(runs):
        size = short + (i < long_parts)
        state = (state * MUL + INC) & (2**64 - 1)
        take = min(size, WINDOW)
        start = at + (state >> 33) % (size - take + 1)
        out.append((start, start + take))
        at += size
    return out


def sampled(v):
    w = sample_windows(len(v))
    if len(w) == 1:
        return v
    return [y for a, b in w for y in v[a:b]] if isinstance(v, list) else np.concatenate([v[a:b] for a, b in w])


@dataclass
class Stats:
    n: int
    runs: int
    distinct: int
    most: int
    keys: np.ndarray


def stats(v, ptype: str, nulls: int) -> Stats:
    keys = k.keys_of(v)
    n, runs = len(keys), len(k.run_starts(keys))
    _, c = np.unique(keys, return_counts=True)
    d, most = len(c), int(c.max()) if len(c) else 0
    family = ptype_class(ptype)
    limit = n if family == "float" or ptype == "uint8" else STRING_LIMIT if family == "string" else max(1, min(MAP_LIMIT, n // 2))
    if d > limit or (family == "float" and d > MAP_LIMIT) or (n and nulls >= n - n // 10):
        most = 0
        d = d if family == "float" and d > MAP_LIMIT else n
    return Stats(n, runs, d, most, keys)


# -- builders --------------------------------------------------------------------------------------------------------
def build_dict(v, ptype: str, ctx: Context) -> x.Node:
    first, codes = k.first_occurrence(k.keys_of(v))
    values, t = k.take(v, first.tolist() if isinstance(v, list) else first), k.uint_for(max(0, len(first) - 1))
    return x.Node(x.DICT, ptype, len(v), b"", [ctx.build("dict", 0, values, ptype), ctx.build("dict", 1, codes.astype(k.DTYPES[t]), t)])


def build_runend(v, ptype: str, ctx: Context) -> x.Node:
    starts = k.run_starts(k.keys_of(v))
    t = k.uint_for(max(0, len(v) - 1))
    return x.Node(x.RUNEND, ptype, len(v), b"", [ctx.build("runend", 0, k.take(v, starts.tolist() if isinstance(v, list) else starts), ptype), ctx.build("runend", 1, starts[1:].astype(k.DTYPES[t]), t)])


def build_sparse(v, ptype: str, ctx: Context, fill=None) -> x.Node:
    """Index or bitmap form, whichever is smaller; constant if nothing differs. ``fill``: given, not counted."""
    keys = k.keys_of(v)
    if fill is None:
        u, inverse, c = np.unique(keys, return_inverse=True, return_counts=True)
        last = np.zeros(len(u), np.int64)
        last[inverse.ravel()] = np.arange(len(keys))
        best = np.lexsort((last, -c))[0]
        same, fill = keys == u[best], v[int(last[best])]
    else:
        same = np.array([y == fill for y in v]) if isinstance(v, list) else keys == k.bits_of(np.array([fill], k.DTYPES[ptype]))[0]
    at = np.flatnonzero(~same)
    if not len(at):
        return x.const(fill, len(v), ptype)
    t = k.uint_for(max(0, len(v) - 1))
    one = [fill] if ptype == "string" else np.array([fill], k.DTYPES[ptype])
    head, values = ctx.build("sparse", 0, one, ptype), ctx.build("sparse", 2, k.take(v, at.tolist() if isinstance(v, list) else at), ptype)
    index = x.Node(x.SPARSE, ptype, len(v), b"", [head, ctx.build("sparse", 1, at.astype(k.DTYPES[t]), t), values])
    bits = x.Node(x.SPARSE, ptype, len(v), x.bitmap(~same), [head, values], x.BITMAP)
    return bits if bits.size < index.size else index


def build_zigzag(v: np.ndarray, ptype: str, ctx: Context) -> x.Node:
    w = v.astype(np.int64)
    z = ((w << 1) ^ (w >> 63)).view(np.uint64)
    t = k.uint_for(int(z.max()) if len(z) else 0)
    return x.Node(x.ZIGZAG, ptype, len(v), b"", [ctx.build("zigzag", 0, z.astype(k.DTYPES[t]), t)])


def build_for(v: np.ndarray, ptype: str, ctx: Context | None = None) -> x.Node:
    low = v.min()
    rest = (k.bits_of(v) - k.bits_of(np.array([low], v.dtype))[0]).astype(f"u{v.dtype.itemsize}")
    width = int(k.bit_lengths(rest).max())
    return x.Node(x.FOR, ptype, len(v), np.array([low], v.dtype).tobytes(), [x.bitpack(rest, ptype, width)])


def deltas(v: np.ndarray) -> np.ndarray:
    return (k.bits_of(v)[1:] - k.bits_of(v)[:-1]).view(v.dtype)


def build_delta(v: np.ndarray, ptype: str, ctx: Context) -> x.Node:
    return x.Node(x.DELTA, ptype, len(v), v[:1].tobytes(), [ctx.build("delta", 0, deltas(v), ptype)])


def build_alp(v: np.ndarray, ptype: str, ctx: Context) -> x.Node:
    e, f = k.alp_exponents(v)
    enc = k.alp_encode(v, e, f)
    wrong = np.flatnonzero(k.bits_of(k.alp_decode(enc, e, f, v.dtype)) != k.bits_of(v))
    if len(wrong) > len(v) // 2:
        raise NotApplicable
    node = x.Node(x.ALP, ptype, len(v), bytes([e, f]), [ctx.build("alp", 0, enc, "int32" if ptype == "float32" else "int64")])
    if len(wrong):
        t, over = k.uint_for(int(wrong[-1])), v[wrong]
        same = (k.bits_of(over) == k.bits_of(over)[0]).all()
        node.flags = x.PATCHED
        node.parts += x.patches(0, ctx.build("alp", 1, wrong.astype(k.DTYPES[t]), t), x.const(over[0], len(over), ptype) if same else x.raw(over, ptype))
    return node


def build_alprd(v: np.ndarray, ptype: str, ctx: Context) -> x.Node:
    cut, words = k.alprd_cut(v)
    total = 8 * v.dtype.itemsize
    u = k.bits_of(v).astype(np.uint64)
    left, right = (u >> np.uint64(total - cut)).astype(np.uint16), u & np.uint64((1 << (total - cut)) - 1)
    hit = left[:, None] == words[None, :]
    found = hit.any(1)
    wrong = np.flatnonzero(~found)
    if len(wrong) > len(v) // 2:
        raise NotApplicable
    bits = max(1, (len(words) - 1).bit_length())
    lo, hi = k.pack(np.where(found, hit.argmax(1), 0).astype(np.uint64), bits), k.pack(right, total - cut)
    body = bytes([total - cut, bits, len(words)]) + words.astype("<u2").tobytes() + struct.pack("<I", len(lo)) + lo + struct.pack("<I", len(hi)) + hi
    node = x.Node(x.ALPRD, ptype, len(v), body)
    if len(wrong):
        t = k.uint_for(int(wrong[-1]))
        node.flags = x.PATCHED
        node.parts = x.patches(0, ctx.build("alprd", 0, wrong.astype(k.DTYPES[t]), t), x.raw(left[wrong], "uint16"))
    return node


def build_fsst(v: list[bytes], ptype: str, ctx: Context) -> x.Node:
    if not ctx.coded or ctx.coded[0] is not v:
        table = k.SymbolTable.train(v)
        ctx = ctx if ctx.coded is not None else replace(ctx, coded=[])
        ctx.coded[:] = v, table.to_bytes(), *table.encode(v)
    _, head, packed, cuts = ctx.coded
    lengths = np.array([len(s) for s in v])
    a, b = k.uint_for(int(cuts[-1])), k.uint_for(int(lengths.max()) if len(lengths) else 0)
    body = struct.pack("<I", len(head)) + head + struct.pack("<I", len(packed)) + packed
    return x.Node(x.FSST, "string", len(v), body, [ctx.build("fsst", 0, cuts.astype(k.DTYPES[a]), a), ctx.build("fsst", 1, lengths.astype(k.DTYPES[b]), b)])


def build_bitpack(v: np.ndarray, ptype: str, ctx: Context) -> x.Node:
    return x.bitpack(v, ptype)


def build_sequence(v: np.ndarray, ptype: str, ctx: Context) -> x.Node:
    return x.sequence(v[0], deltas(v)[0], len(v), ptype)


BUILD = {"dict": build_dict, "runend": build_runend, "sparse": build_sparse, "zigzag": build_zigzag, "for": build_for, "delta": build_delta, "alp": build_alp, "alprd": build_alprd, "fsst": build_fsst, "bitpack": build_bitpack, "sequence": build_sequence}
ORDER = {"signed": ("sequence", "for", "delta", "dict", "runend", "sparse", "zigzag"), "unsigned": ("sequence", "for", "delta", "dict", "runend", "sparse", "bitpack"), "float": ("alp", "alprd", "runend", "sparse", "dict"), "string": ("dict", "runend", "fsst", "sparse")}


def packed(n: int, bits: int) -> int:
    return (n * bits + 7) // 8


def immediate(name: str, v, ptype: str, s: Stats, raw: int, ctx: Context) -> float | None:
    """The ratio of a scheme that needs no rows encoded; None if it doesn't apply or isn't of this kind."""
    n, w, unsigned = s.n, PTYPES[PTYPE_CODES[ptype]][1], ptype.startswith("u")
    if name == "sequence":
        if n < 2 or ctx.nulls:
            return None
        d = deltas(v)
        return raw / (24 + 2 * w) if d[0] and (d == d[0]).all() else None
    if ctx.depth <= 0:
        return None
    if name == "for" and n:
        low, high = int(v.min()), int(v.max())
        rw = (high - low).bit_length()
        if not 0 < rw < 8 * w or (unsigned and (low == 0 or rw >= high.bit_length())):
            return None
        return raw / (49 + w + packed(n, rw))
    if name == "bitpack":
        after = 25 + packed(n, int(v.max()).bit_length() if n else 0)
        return raw / after if after < raw else None
    if name == "dict" and ptype_class(ptype) in ("signed", "unsigned") and s.most and 1 < s.distinct <= n // 2:
        cb = (s.distinct - 1).bit_length()
        if raw < MIN_RAW:
            return raw / (24 + min(24 + 2 * w, 44 + s.distinct * w) + 25 + packed(n, cb))
        codes = min(cb * n, (cb + 32) * s.runs) if n >= 4 * s.runs else cb * n
        return 8 * w * n / (8 * w * s.distinct + codes)
    return None


def wants_sample(name: str, v, ptype: str, s: Stats, raw: int, ctx: Context) -> bool:
    """Whether a scheme is to be tried on the sample."""
    if ctx.sample or ctx.depth <= 0 or raw < MIN_RAW:
        return False
    family, n = ptype_class(ptype), s.n
    if name == "runend":
        return n >= 4 * s.runs
    if name == "sparse":
        return n > 0 and min(s.most, n) >= n - n // 10
    if name == "zigzag":
        return bool((v < 0).any())
    if name in ("alp", "alprd"):
        return s.runs > 1 and not (2 <= s.distinct <= FLOAT_LIMIT and 16 * s.distinct <= n)
    if name == "fsst":
        return n >= LONG and sum(map(len, v)) >= LONG
    if name == "dict":
        return (family == "string" and s.distinct <= n // 2) or (family in ("signed", "unsigned") and not s.most)
    return False


def refined_delta(v: np.ndarray, ptype: str, raw: int, best: float, ctx: Context) -> float | None:
    """The delta estimate, worth its scan only if even one-bit residuals would beat the best so far."""
    n, w = len(v), v.dtype.itemsize
    if ctx.sample or ctx.depth <= 0 or n < LONG:
        return None
    after = lambda rw, shift: 24 + w + 25 + packed(n - 1, rw) + (24 + w if shift else 0)
    upper = 0.95 * raw / after(1, not ptype.startswith("u"))
    if upper <= max(1.25, best * 1.1):
        return None
    d = deltas(v)
    if (d == d[0]).all():
        return None
    low, high = int(d.min()), int(d.max())
    rw = (high - low).bit_length()
    ratio = 0.95 * raw / after(rw, not ptype.startswith("u") or low != 0)
    return ratio if ratio > max(1.25, best * 1.1) else None


def plan(v, ptype: str, ctx: Context) -> x.Node:
    """The tree for values without nulls."""
    n, raw, ctx = len(v), raw_size(v, ptype), replace(ctx, coded=[])
    s = stats(v, ptype, ctx.nulls)
    note = ctx.trace.append if ctx.trace is not None else lambda _: None
    chosen, best, ready = "raw", 1.0, None
    if n and s.runs == 1 and not ctx.sample and "const" not in ctx.exclude:
        node = x.const(v[0], n, ptype)
        note(("const", "immediate", node.size, raw / node.size))
        return node if node.size < raw else x.raw(v, ptype)
    names = [c for c in ORDER[ptype_class(ptype)] if c not in ctx.exclude]
    for c in names:
        r = immediate(c, v, ptype, s, raw, ctx)
        if r is not None:
            note((c, "immediate", round(raw / r), r))
            if r > 1 and r > best:
                chosen, best = c, r
    if n == 0 and ptype.startswith("u") and "bitpack" in names and ctx.depth > 0:
        return x.bitpack(v, ptype)
    part = None
    for c in names:
        if c == "delta" and chosen != "sequence":
            r = refined_delta(v, ptype, raw, best, ctx)
            if r is not None:
                note((c, "deferred", round(raw / r), r))
                chosen, best = c, r
        elif c == "dict" and ptype_class(ptype) == "float":
            w = PTYPES[PTYPE_CODES[ptype]][1]
            bits = 8 * w * s.distinct + max(0, s.distinct - 1).bit_length() * n
            if not ctx.sample and ctx.depth > 0 and 1 < s.distinct <= FLOAT_LIMIT and s.distinct <= n // 2 and bits < 8 * w * n and 8 * w * n / bits >= 0.9 * best:
                node = build_dict(v, ptype, ctx)
                note((c, "exact", node.size, raw / node.size))
                if raw / node.size > best:
                    chosen, best, ready = c, raw / node.size, node
        elif wants_sample(c, v, ptype, s, raw, ctx):
            part = sampled(v) if part is None else part
            try:
                size = BUILD[c](part, ptype, replace(ctx, sample=True)).size
            except NotApplicable:
                continue
            r = raw_size(part, ptype) / size
            note((c, "sample", size, r))
            if r > 1 and r > best:
                chosen, best = c, r
    if chosen == "raw":
        return x.raw(v, ptype)
    try:
        node = ready if chosen == "dict" and ready is not None else BUILD[chosen](v, ptype, ctx)
    except NotApplicable:
        return x.raw(v, ptype)
    return node if node.size < raw else x.raw(v, ptype)


def compress(v, ptype: str, valid: np.ndarray | None = None, options: Options = Options(), trace: list | None = None) -> x.Node:
    """The tree of a page. Null rows hold zero or empty. ``trace`` collects (codec, kind, bytes, ratio) of candidates."""
    ctx = Context(options.depth if options.depth > 0 else 3, options.exclude, trace=trace, max_bytes=options.max_bytes)
    n = len(v)
    within(v, ptype, options.max_bytes)
    if valid is None or valid.all():
        return plan(v, ptype, ctx)
    nulls = int(n - valid.sum())
    zero = b"" if ptype == "string" else k.DTYPES[ptype](0)
    masked = [y if ok else b"" for y, ok in zip(v, valid, strict=True)] if ptype == "string" else np.where(valid, v, zero).astype(k.DTYPES[ptype])
    plain = x.raw(masked, ptype, valid)
    inner = replace(ctx, nulls=nulls)
    if nulls == n:
        values, bits = x.const(zero, n, ptype), x.const(np.uint8(0), (n + 7) // 8, "uint8")
    else:
        forced = nulls >= n - n // 10 and "sparse" not in ctx.exclude
        values = build_sparse(masked, ptype, inner, zero) if forced else plan(masked, ptype, inner)
        bits = plan(np.frombuffer(x.bitmap(valid), np.uint8), "uint8", replace(ctx, trace=None))
    node = x.Node(x.NULLABLE, ptype, n, struct.pack("<Q", nulls), [values, bits])
    return plain if plain.size <= node.size else node
