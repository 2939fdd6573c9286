"""Binary pages: golden bytes, round trips, slices, the planner's choices and hostile input."""

import random

import numpy as np
import pytest

from pagecodec.wire import kernels as k
from pagecodec.wire import nodes as x
from pagecodec.wire import planner as p

I = np.arange(4096)


def lcg_doubles():
    s, out = 1234567, []
    for j in range(4096):
        s = (s * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        out.append(((0x3FF0 + j % 2) << 48) | (s >> 16))
    return np.array(out, np.uint64).view(np.float64)


def sparse(n, step, count, add):
    v = np.full(n, 7, np.uint32)
    v[step * np.arange(count)] = np.arange(count) + add
    return v


CHOICES = np.array([17, 1000003, -700001, 81234567, -91111113, 2000000011], np.int32)
CASES = [
    ("const", "uint32", np.full(4, 42, np.uint32)), ("sequence", "int64", -1_000_000 + 7 * I), ("for", "uint64", ((1 << 40) + (37 * I % 101)).astype(np.uint64)),
    ("bitpack", "uint32", (I % 16).astype(np.uint32)), ("sparse", "uint32", sparse(4096, 20, 200, 1000)), ("dict", "int32", CHOICES[(37 * I + I // 11) % 6]),
    ("delta", "uint64", ((1 << 40) + np.cumsum(I % 7 + 1)).astype(np.uint64)), ("alp", "float64", I * 0.01), ("alprd", "float64", lcg_doubles()),
    ("fsst", "string", [b"https://logs.example.com/v1/tenant/common/path/event/%08d" % j for j in range(4096)]), ("dict", "float64", np.array([1.1, 20.2, 300.3, 4000.4, 50000.5])[I % 5]),
    ("sparse", "uint32", sparse(1024, 10, 100, 1)), ("bitpack", "uint8", (np.arange(64) % 4).astype(np.uint8)), ("raw", "int64", np.array([], np.int64)), ("bitpack", "uint32", np.array([], np.uint32)), ("raw", "int64", np.array([7])),
]


def same(a, b):
    return a == b if isinstance(a, list) else len(a) == len(b) and bool((k.bits_of(a) == k.bits_of(np.asarray(b))).all())


@pytest.mark.parametrize(("want", "ptype", "v"), CASES)
def test_planner_and_round_trip(want, ptype, v):
    node = p.compress(v, ptype)
    data = node.to_bytes()
    assert node.tree.split("(")[0] == want
    assert len(data) == node.size
    back = x.load(data, ptype)
    assert same(back.values(), v)
    for a, b in ((0, 0), (3, 3), (5, 50), (0, len(v)), (1, len(v))):
        if a <= b <= len(v):
            assert same(x.load(back.slice(a, b).to_bytes(), ptype).values(), v[a:b])
    for i in range(0, len(v), 777):
        assert back.value_at(i) == v[i]


def test_golden_bytes():
    assert x.raw(np.array([1, 2, 3], np.uint32), "uint32").to_bytes().hex() == "010207000000000003000000000000002000000000000000" + "0107000003000000000000000c00000000000000" + "010000000200000003000000"
    assert x.ARRAY_HEADER.pack(1, 7, 1, 0x0102030405060708, 0x1112131415161718).hex() == "0107010008070605040302011817161514131211"


def test_sample_windows():
    assert [a for a, _ in p.sample_windows(4096)] == [122, 313, 531, 950, 1131, 1358, 1717, 1958, 2079, 2465, 2656, 2916, 3180, 3328, 3771, 4031]
    assert p.sample_windows(1024) == [(0, 1024)]
    assert [len(p.sample_windows(n)) for n in (65_536, 600_000, 1_000_000)] == [16, 96, 160]


@pytest.mark.parametrize(("valid", "tree"), [(np.isin(I, [5, 77, 900, 4000]), "nullable(sparse"), (np.zeros(4096, bool), "nullable(const,const)"), (I % 9 != 0, "nullable(for")])
def test_nulls(valid, tree):
    node = p.compress(I, "int64", valid)
    assert node.tree.startswith(tree)
    v, got = x.load(node.to_bytes(), "int64").decode()
    assert (got == valid).all() and (v[valid] == I[valid]).all()


def test_few_nulls_stay_raw():
    assert p.compress(np.array([1, 2, 3]), "int64", np.array([True, False, True])).tree == "raw"


@pytest.mark.parametrize("exclude", [(), ("dict",), ("dict", "runend"), ("dict", "runend", "sparse"), ("alp", "dict"), ("for", "delta", "dict")])
def test_random_pages(exclude):
    r = np.random.default_rng(7)
    for t in ("int8", "int32", "int64", "uint16", "uint64", "float32", "float64"):
        for n in (1, 2, 63, 300, 2000):
            for v in (r.integers(-100, 100, n), np.repeat(r.integers(0, 5, n), 7)[:n], np.cumsum(r.integers(0, 9, n)), r.integers(-(2**62), 2**62, n)):
                w = v.astype(np.float64) / 100 if t.startswith("float") else v
                w = w.astype(np.int64).astype(k.DTYPES[t]) if not t.startswith("float") else w.astype(k.DTYPES[t])
                node = p.compress(w, t, options=p.Options(exclude=frozenset(exclude)))
                assert same(x.load(node.to_bytes(), t).values(), w)
                assert node.size == len(node.to_bytes()) and node.size <= p.raw_size(w, t)


def test_bit_exact_floats():
    v = np.array([0.0, -0.0, np.nan, np.inf, -np.inf, 1.5, -0.0, 0.0] * 200)
    for exclude in ((), ("dict",), ("dict", "runend", "sparse")):
        node = p.compress(v, "float64", options=p.Options(exclude=frozenset(exclude)))
        assert same(x.load(node.to_bytes(), "float64").values(), v)
    nan = np.array([0x7FF8000000000001, 0x7FF8000000000002] * 40, np.uint64).view(np.float64)
    assert same(x.load(p.compress(nan, "float64").to_bytes(), "float64").values(), nan)


def test_wrapping_deltas():
    v = np.array([2**63 - 1, -(2**63), 0, -1] * 500, np.int64)
    node = p.build_delta(v, "int64", p.Context(3, frozenset()))
    assert same(x.load(node.to_bytes(), "int64").values(), v)


def test_strings():
    r = random.Random(3)
    for v in ([b"", b"a", b"", b"\xff\x00"] * 300, [bytes(r.randrange(256) for _ in range(r.randrange(9))) for _ in range(1500)], [b"k%d" % i for i in range(1500)]):
        for exclude in ((), ("dict", "runend", "sparse")):
            assert x.load(p.compress(v, "string", options=p.Options(exclude=frozenset(exclude))).to_bytes(), "string").values() == v


@pytest.mark.parametrize(("want", "ptype", "v"), CASES[:13])
def test_damaged_pages_are_refused_or_decode(want, ptype, v):
    """Any damage gives a format error or some page; never another failure."""
    data, r = bytearray(p.compress(v, ptype).to_bytes()), random.Random(5)
    for _ in range(150):
        bad = bytearray(data)
        bad[r.randrange(min(len(bad), 400))] = r.randrange(256)
        if r.random() < 0.3:
            bad = bad[: r.randrange(len(bad))]
        try:
            x.load(bytes(bad), ptype).decode()
        except x.FormatError:
            pass


def test_trailing_bytes_and_prefixes():
    node = p.compress(I, "int64")
    with pytest.raises(x.FormatError):
        x.load(node.to_bytes() + b"\0", "int64")
    c = x.Cursor(node.to_bytes() * 2)
    assert [x.load_prefix(c, "int64").n, x.load_prefix(c, "int64").n] == [4096, 4096]


def test_limits():
    data = p.compress(I * 3 % 1000, "int64").to_bytes()
    for limits in (x.Limits(max_length=10), x.Limits(max_bytes=10), x.Limits(max_decoded=100), x.Limits(max_depth=0)):
        with pytest.raises(x.FormatError):
            x.load(data, "int64", limits).decode(limits)
    deep = x.raw(np.zeros(1, np.int64), "int64")
    for _ in range(40):
        deep = x.Node(x.FOR, "int64", 1, bytes(8), [deep])
    with pytest.raises(x.FormatError):
        x.load(deep.to_bytes(), "int64")
    # a small stream that declares a huge decode for its validation is refused quickly
    huge = x.Node(x.RUNEND, "int64", 1 << 26, b"", [x.sequence(0, 1, 1 << 25, "int64"), x.sequence(1, 1, (1 << 25) - 1, "uint64")])
    with pytest.raises(x.FormatError):
        x.load(huge.to_bytes(), "int64")


def test_options():
    assert p.compress(I, "int64", options=p.Options(exclude=frozenset({"sequence"}))).tree != "sequence"
    with pytest.raises(MemoryError):
        p.compress(I, "int64", options=p.Options(max_bytes=100))
    with pytest.raises(ValueError):
        p.compress(I, "int64").slice(5, 3)
    with pytest.raises(IndexError):
        p.compress(I, "int64").value_at(4096)


def test_kernels():
    r = np.random.default_rng(1)
    for width in (1, 3, 8, 13, 31, 33, 63, 64):
        u = r.integers(0, 2**63, 101, dtype=np.uint64) & np.uint64((1 << width) - 1)
        assert (k.unpack(k.pack(u, width), 101, width) == u).all()
    u = np.array([0, 1, 2, 3, 4, 255, 256, 2**32, 2**63, 2**64 - 1], np.uint64)
    assert k.bit_lengths(u).tolist() == [int(a).bit_length() for a in u]
    v = np.array([12.34, 56.78] * 256)
    assert k.alp_exponents(v)[0] - k.alp_exponents(v)[1] == 2
