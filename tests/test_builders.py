"""Pages built by hand, child limits, narrow types."""

import numpy as np
import pytest

from pagecodec.wire import builders, nodes, planner

R = np.random.default_rng(8)
INTS = {"dict": R.integers(0, 5, 300), "runend": np.repeat(R.integers(0, 9, 30), 10), "sparse": np.where(R.random(300) < 0.1, R.integers(0, 100, 300), 7), "for": R.integers(90, 100, 300), "delta": np.cumsum(R.integers(0, 4, 300)), "sequence": np.arange(100)}


def same(node, v):
    got, valid = nodes.load(node.to_bytes(), node.ptype).decode()
    assert valid is None and (list(got) == list(v) if isinstance(got, list) else got.tobytes() == v.tobytes())


@pytest.mark.parametrize("ptype", ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64"])
@pytest.mark.parametrize("codec", INTS)
def test_integer_codecs_of_every_width(codec, ptype):
    v = (INTS[codec] % 120 if codec == "delta" else INTS[codec]).astype(ptype)
    node = builders.build(codec, v, ptype)
    assert nodes.NAMES[node.codec] == codec
    same(node, v)
    same(planner.compress(v, ptype), v)


@pytest.mark.parametrize("ptype", ["uint8", "uint16", "uint32", "uint64"])
def test_unsigned_packing(ptype):
    v = R.integers(0, 100, 500).astype(ptype)
    same(builders.build("bitpack", v, ptype), v)
    top = np.full(40, np.iinfo(v.dtype).max, v.dtype)
    same(planner.compress(np.concatenate((v, top)), ptype), np.concatenate((v, top)))


@pytest.mark.parametrize("ptype", ["float32", "float64"])
def test_floats_of_both_widths(ptype):
    short, rough = (R.integers(0, 9999, 600) / 100).astype(ptype), R.random(600).astype(ptype) + 1
    odd = np.concatenate((short, np.array([np.nan, np.inf, -0.0, 1e-30], ptype)))
    for codec, v in (("alp", short), ("alp", odd), ("alprd", rough), ("dict", short[:9].repeat(20)), ("runend", short[:9].repeat(20)), ("sparse", np.where(R.random(300) < 0.1, 1.5, 0).astype(ptype))):
        same(builders.build(codec, v, ptype), v)
        same(planner.compress(v, ptype), v)


def test_strings():
    v = [b"abc", b"", b"abcabc", "\u00e9".encode()] * 40
    for codec in ("dict", "runend", "fsst", "sparse"):
        same(builders.build(codec, v, "string"), v)


def test_builders_are_asked_and_checked():
    v, asked = np.arange(300) % 5, []
    note = lambda x, t: asked.append(t) or nodes.raw(x, t)
    same(builders.build("dict", v, "int64", builders.Children(note, None, {"uint8": note})), v)
    assert asked == ["int64", "uint8"]
    with pytest.raises(builders.BuilderRequired):
        builders.build("dict", v, "int64", builders.Children(note))
    for bad in (lambda x, t: None, lambda x, t: nodes.raw(x[1:], t), lambda x, t: planner.compress(x, t, np.arange(len(x)) > 0)):
        node_of = builders.Children(note, None, {"uint8": bad})
        try:
            built = builders.build("dict", v, "int64", node_of)
        except ValueError:
            continue
        assert built.children[1].codec != nodes.NULLABLE


def test_limits_of_children():
    v = [b"x" * 1000 + str(i % 3).encode() for i in range(300)]
    with pytest.raises(MemoryError):
        builders.build("dict", v, "string", max_bytes=10_000)
    wide = np.repeat(np.arange(2000), 2)
    builders.build("runend", wide, "int64", max_bytes=44 + 8 * 4000)
    with pytest.raises(MemoryError):
        builders.build("runend", wide, "int64", max_bytes=44 + 8 * 4000 - 1)
    with pytest.raises(MemoryError):
        planner.Context(1, frozenset(), max_bytes=100, make=builders.PLAIN.make).build("dict", 0, wide, "int64")


def test_nullable_view_and_copies():
    valid = np.arange(400) % 3 > 0
    page = planner.compress(np.where(valid, 5, 0), "int64", valid)
    values, bits = builders.as_nullable(page)
    assert values.n == 400 and np.unpackbits(bits.values(), count=400, bitorder="little").astype(bool).tolist() == valid.tolist()
    assert builders.as_nullable(values) is None
    out = np.zeros(10, np.int64)
    assert builders.copy_out(planner.compress(np.arange(50), "int64"), out) == 10 and out.tolist() == list(range(10))
    assert builders.copy_out(planner.compress(np.arange(4), "int64"), out) == 4


def test_schemes_are_public():
    assert [s.name for s in builders.SCHEMES["string"]] == ["dict", "runend", "fsst", "sparse"]
    with pytest.raises(ValueError):
        builders.build("alp", np.arange(5), "int64")
