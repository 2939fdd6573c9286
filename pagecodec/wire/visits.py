"""Predicates and point access on loaded pages: the codec's own structure is asked first, rows are decoded only if nothing else is left.

A test maps the values of an array (or list of bytes) to booleans. Constants ask it once, dictionaries once per distinct
value, run-ends once per run, sparse pages once for the fill and once per exception; null rows never match.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import kernels as k
from . import nodes as nd
from .nodes import Node

Test = Callable[[object], np.ndarray]


def _bits(x: Node) -> np.ndarray:
    """The marks of a bitmap body."""
    return np.unpackbits(np.frombuffer(x.body, np.uint8), count=x.n, bitorder="little").astype(bool)


def _mask(test: Test, values) -> np.ndarray:
    return np.asarray(test(values), bool) if len(values) else np.zeros(0, bool)


def places(x: Node) -> np.ndarray:
    """Where a sparse page has exceptions, in order."""
    return np.flatnonzero(_bits(x)) if x.flags else x.children[1].values().astype(np.int64)


def matching(x: Node, test: Test) -> np.ndarray:
    """The rows, in order, whose value satisfies the test."""
    c = x.children
    if not x.n:
        return np.zeros(0, np.int64)
    if x.codec == nd.CONST:
        values = nd.read_array(nd.Cursor(x.body), x.ptype)[0]
        return np.arange(x.n) if _mask(test, values).all() else np.zeros(0, np.int64)
    if x.codec == nd.DICT:
        hit = _mask(test, c[0].values())
        if not hit.any():  # codes aren't looked at
            return np.zeros(0, np.int64)
        return np.arange(x.n) if hit.all() else np.flatnonzero(hit[c[1].values().astype(np.int64)])
    if x.codec == nd.RUNEND:
        hit = _mask(test, c[0].values())
        if not hit.any():
            return np.zeros(0, np.int64)
        ends = np.concatenate(([0], c[1].values().astype(np.int64), [x.n]))
        return np.flatnonzero(np.repeat(hit, np.diff(ends)))
    if x.codec == nd.SPARSE:
        at, hit = places(x), _mask(test, c[-1].values())
        if not _mask(test, c[0].values()).any():
            return at[hit]
        out = np.ones(x.n, bool)
        out[at[~hit]] = False
        return np.flatnonzero(out)
    if x.codec == nd.NULLABLE:
        rows = matching(c[0], test)
        return rows[np.unpackbits(c[1].values(), count=x.n, bitorder="little").astype(bool)[rows]]
    values, valid = x.decode(None)
    hit = _mask(test, values)
    return np.flatnonzero(hit if valid is None else hit & valid)


def equal_codes(x: Node, value) -> np.ndarray | None:
    """Rows of a dictionary page whose code is that of ``value``, by bit planes of the codes; None if the page has no dictionary.

    With one distinct value no plane is read; planes are those that the dictionary's size needs, and reading ends when no row is left.
    """
    if x.codec == nd.NULLABLE:
        rows = equal_codes(x.children[0], value)
        return None if rows is None else rows[np.unpackbits(x.children[1].values(), count=x.n, bitorder="little").astype(bool)[rows]]
    if x.codec != nd.DICT:
        return None
    values = x.children[0].values()
    found = [i for i, v in enumerate(values) if v == value]
    if not found:
        return np.zeros(0, np.int64)
    rows = np.arange(x.n)
    if len(values) == 1:
        return rows
    codes = x.children[1].values().astype(np.int64)
    for plane in range((len(values) - 1).bit_length()):
        rows = rows[(codes[rows] >> plane & 1) == (found[0] >> plane & 1)]
        if not len(rows):
            break
    return rows


def value_at(x: Node, i: int):
    """One row's value (None for null), decoding no more than the codec forces."""
    if not 0 <= i < x.n:
        raise IndexError(i)
    c = x.children
    if x.codec == nd.NULLABLE:
        known = c[1].values()
        return value_at(c[0], i) if known[i >> 3] >> (i & 7) & 1 else None
    if x.codec == nd.SPARSE:
        at = places(x)
        k_ = int(np.searchsorted(at, i))
        return value_at(c[-1], k_) if k_ < len(at) and at[k_] == i else c[0].values()[0]
    if x.codec == nd.ZIGZAG:
        z = int(value_at(c[0], i))
        return k.DTYPES[x.ptype]((z >> 1) ^ -(z & 1))
    if x.codec == nd.BITPACK and x.flags:
        at = x.parts[1].values().astype(np.int64) - int.from_bytes(x.parts[0], "little")
        k_ = int(np.searchsorted(at, i))
        if k_ < len(at) and at[k_] == i:
            return value_at(x.parts[2], k_)
        return Node(nd.BITPACK, x.ptype, x.n, x.body).value_at(i)
    if x.codec == nd.DICT:
        return value_at(c[0], int(value_at(c[1], i)))
    if x.codec == nd.RUNEND:
        return value_at(c[0], int(np.searchsorted(c[1].values(), i, side="right")))
    return x.value_at(i)


def decode_into(x: Node, out: np.ndarray) -> None:
    """Decode a page of fixed-width values without nulls into a buffer of exactly its rows and type."""
    nd.ok(out.shape == (x.n,) and out.dtype == k.DTYPES[x.ptype], "the buffer has other rows or another type than the page")
    values, valid = x.decode()
    nd.ok(valid is None, "the page has nulls")
    out[:] = values
