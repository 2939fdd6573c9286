"""Building one codec's page by hand: the caller's functions build its structural children.

A builder takes values and their physical type and gives a page of as many rows, of that type and without nulls; that
it holds the same values is the caller's part. Unsigned children come in the narrowest type that fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions import ptype_class
from . import nodes as x
from . import planner

Builder = Callable[[object, str], x.Node]
#: Children that hold values of the page's own type, and the one that holds a sparse page's fill.
VALUES, FILLS = {("dict", 0), ("runend", 0), ("sparse", 2)}, {("sparse", 0)}


class BuilderRequired(ValueError):
    """The codec needs a child for which no builder is given."""


@dataclass(frozen=True)
class Children:
    """Builders of values, of a sparse fill (else as values), and of integers by physical type."""

    values: Builder | None = None
    fill: Builder | None = None
    integers: dict[str, Builder] = field(default_factory=dict)

    def make(self, parent: str, place: int, v, ptype: str) -> x.Node:
        build = (self.fill or self.values) if (parent, place) in FILLS else self.values if (parent, place) in VALUES else self.integers.get(ptype)
        if build is None:
            raise BuilderRequired(f"child {place} of {parent} needs a builder for {ptype}")
        return build(v, ptype)


def raw(v, ptype: str) -> x.Node:
    """The simplest builder."""
    return x.raw(v, ptype)


#: Raw children everywhere.
PLAIN = Children(raw, raw, {t: raw for t in ("uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64")})


@dataclass(frozen=True)
class Scheme:
    """A codec that the planner may choose for a family of types."""

    name: str
    build: Callable


#: The planner's choices by family, in the order in which equals win.
SCHEMES = {family: tuple(Scheme(n, planner.BUILD[n]) for n in names) for family, names in planner.ORDER.items()}


def build(codec: str, v, ptype: str, children: Children = PLAIN, *, max_bytes: int = planner.Options().max_bytes) -> x.Node:
    """A page of the codec, whatever it costs. Refuses values that the codec can't hold, and buffers beyond the limit."""
    if codec not in {s.name for s in SCHEMES[ptype_class(ptype)]}:
        raise ValueError(f"{codec} holds no {ptype}")
    planner.within(v, ptype, max_bytes)
    if not len(v):
        raise ValueError("an empty page has no structure")
    if codec == "sequence" and (len(v) < 2 or len(set(planner.deltas(v).tolist())) > 1 or not planner.deltas(v)[0]):
        raise ValueError("the values are no sequence")
    return planner.BUILD[codec](v, ptype, planner.Context(1, frozenset(), max_bytes=max_bytes, make=children.make))


def as_nullable(page: x.Node) -> tuple[x.Node, x.Node] | None:
    """The values and the validity bitmap of a nullable page; None of any other."""
    return (page.children[0], page.children[1]) if page.codec == x.NULLABLE else None


def copy_out(page: x.Node, out: np.ndarray) -> int:
    """Copy as many rows as both have; how many that is. Null rows give what is stored for them."""
    values = page.decode()[0]
    n = min(len(out), page.n)
    out[:n] = values[:n]
    return n
