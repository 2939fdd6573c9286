"""Symbol tables: all strings of a page at once against one string and one symbol at a time."""

import random

import numpy as np
import pytest

from pagecodec.wire import kernels, nodes, planner


def coded(symbols, s):
    out, at = b"", 0
    while at < len(s):
        fits = [(len(x), -i) for i, x in enumerate(symbols) if s.startswith(x, at)]
        size, code = max(fits, default=(1, 0))
        out += bytes([-code]) if fits else bytes((255, s[at]))
        at += size
    return out


def decoded(symbols, codes):
    out, at = b"", 0
    while at < len(codes):
        escape = codes[at] == 255
        out += codes[at + 1 : at + 2] if escape else symbols[codes[at]]
        at += 1 + escape
    return out


def trained(strings, rounds=5):
    symbols, step = [], max(1, sum(map(len, strings)) // (1 << 14))
    for _ in range(rounds):
        gain = {}
        for s in strings[::step]:
            codes, previous = coded(symbols, s), b""
            while codes:
                n = 1 + (codes[0] == 255)
                part, codes = decoded(symbols, codes[:n]), codes[n:]
                for x in (part, previous + part) if previous and len(previous + part) <= 8 else (part,):
                    gain[x] = gain.get(x, 0) + len(x)
                previous = part
        symbols = sorted(gain, key=lambda x: (-gain[x], x))[:255]
    return symbols


@pytest.mark.parametrize("at_once", [1, 8, 9, 1 << 18])
@pytest.mark.parametrize("alphabet", [b"ab", b"abc\0", b"\xff\xfea", b"\0", bytes(range(256))])
def test_strings_at_once(monkeypatch, at_once, alphabet):
    """The same table, codes and rows as one by one, wherever spans of the page end; also codes that nobody wrote."""
    monkeypatch.setattr(kernels, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    for turn in range(20):
        v = [bytes(rng.choices(alphabet, k=rng.choice([0, 0, 1, 2, 7, 8, 9, 40]))) for _ in range(rng.randrange(9))]
        table = kernels.SymbolTable.train(v)
        assert table.symbols == trained(v)
        if turn % 2:
            table = kernels.SymbolTable(sorted({bytes(rng.choices(alphabet, k=rng.randint(1, 8))) for _ in range(rng.randrange(255))}, key=lambda _: rng.random()))
        want = [coded(table.symbols, s) for s in v]
        codes, cuts = table.encode(v)
        assert codes == b"".join(want) and cuts.tolist() == np.cumsum([0, *map(len, want)]).tolist()
        assert table.decode(codes, cuts) == v and table.decoded_lengths(codes, cuts).tolist() == [len(s) for s in v]
        rows = [bytes(rng.choices([255, 255, 0, 1, 254], k=rng.randrange(9))) for _ in range(rng.randrange(9))]
        cuts = np.cumsum([0, *map(len, rows)])
        try:
            want = [decoded(table.symbols, r) for r in rows]
        except IndexError:
            with pytest.raises(IndexError):
                table.decode(b"".join(rows), cuts)
        else:
            assert table.decode(b"".join(rows), cuts) == want


@pytest.mark.parametrize("n", [1024, 3000])
def test_a_page_that_is_its_own_sample_is_coded_once(monkeypatch, n):
    v, seen, train = [b"https://logs.example.com/tenant/%06d" % (i * 7919) for i in range(n)], [], kernels.SymbolTable.train
    monkeypatch.setattr(kernels.SymbolTable, "train", lambda strings: seen.append(len(strings)) or train(strings))
    blob = planner.compress(v, "string").to_bytes()
    assert seen == [n] if n <= 1024 else seen == [1024, n]
    node = nodes.load(blob, "string")
    assert node.codec == nodes.FSST and node.values() == v
