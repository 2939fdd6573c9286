"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, scores (unigram) or merges (BPE, rebuilt from the
piece scores) and byte fallback are rebuilt as a tokenizers pipeline. Texts are cut before every run of markers and
around line breaks, which is exact when no piece has a marker after another character and none holds a line break
(checked on the vocabulary; else texts are encoded whole). New distinct cuts are encoded in multithreaded batches,
compared with the sentencepiece library (``parity``) and decoded again by the rebuilt decoder (``roundtrip``), so both hold
for whole texts; a text that holds the marker itself doesn't come back, as its markers are decoded to spaces.

Cases: null and empty texts have no tokens, with parity and round trip true; strings that look like special pieces
are plain text; very long texts are encoded whole; repeated rows are encoded alike; an empty table stays empty.

Scale: one narrow scan; a memo of bounded size per worker.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
MEMO = 150_000
#: New cuts that are encoded in one string.
TOGETHER = 500
#: Characters of the longest cut that stays in the memo.
LONGEST_KEPT = 64
SCHEMA = "doc_id long, n_tokens long, parity boolean, roundtrip boolean, ids array<int>"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    """What a serialised SentencePiece model says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @property
    def splits(self) -> bool:
        """Whether texts may be cut before markers and around line breaks."""
        return self.escape and not self.suffix and not any(MARK in p.lstrip(MARK) or "\n" in p for p, _, t in self.pieces if t in (NORMAL, USER))


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            m.kind, m.byte_fallback, m.unk_id, m.suffix = f.get(3, UNIGRAM), bool(f.get(35, 0)), f.get(40, 0), bool(f.get(24, 0))
        elif number == 3:
            f = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs that join into a piece, best piece first; pairs of one piece in vocabulary order."""
    ids = {p: i for i, (p, _, t) in enumerate(m.pieces) if t in (NORMAL, USER, UNUSED)}
    found = []
    for p, i in ids.items():
        for k in range(1, len(p)):
            a, b = ids.get(p[:k]), ids.get(p[k:])
            if a is not None and b is not None:
                found.append((-m.pieces[i][1], i, a, b, p[:k], p[k:]))
    return [x[4:] for x in sorted(found)]


def build(m: Model, *, normalise: bool = True):
    """The tokenizers pipeline; without ``normalise`` for text that already has its markers."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if m.kind == BPE:
        unk = m.pieces[m.unk_id][0]
        core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    t = Tokenizer(core)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if normalise and steps:
        t.normalizer = normalizers.Sequence(steps)
    users = [AddedToken(p, normalized=False, special=False) for p, _, k in m.pieces if k == USER]
    if users:
        t.add_tokens(users)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


class Codec:
    """Encodes texts; lives in a Python worker. Ids of cuts are remembered as bytes, four for each id."""

    def __init__(self, data: bytes, threads: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        if threads:
            os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = parse(data)
        self.whole, self.inner = build(self.model), build(self.model, normalise=False)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.plain = not self.model.charsmap and not self.model.squeeze
        self.line = self.inner.encode("\n", add_special_tokens=False).ids
        alone = len(self.line) == 1 and self.line[0] != self.model.unk_id
        self.exact = self.model.splits and self.plain and self.model.dummy_prefix and alone
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.memo: dict[str, bytes] = {}
        self.bad: set[str] = set()
        self.lossy: set[str] = set()
        self.threads = threads or 1

    def decode(self, ids: list[int]) -> str:
        """The text of the ids."""
        return self.whole.decode(ids, skip_special_tokens=False)

    def _one_by_one(self, cuts: list[str]) -> None:
        """Learn cuts singly. The library gives their ids only behind its dummy prefix or a line break."""
        alone = self.library.encode("\n")
        for c, e in zip(cuts, self.inner.encode_batch_fast(cuts, add_special_tokens=False), strict=True):
            ids = e.ids
            expected = alone[:1] if c == MARK else self.library.encode(c[1:]) if c.startswith(MARK) else self.library.encode("\n" + c)[len(alone) :]
            self.memo[c] = np.array(ids, np.int32).tobytes()
            if ids != expected:
                self.bad.add(c)
            if self.decode(self.line + ids) != "\n" + c.replace(MARK, " "):
                self.lossy.add(c)

    def learn(self, cuts: list[str]) -> None:
        """Encode new cuts, many in a string with line breaks between, on several threads; check and undo them together.

        Where a string's ids aren't the library's, or don't give its text again, its cuts are looked at one by one.
        """
        if len(self.memo) + len(cuts) > MEMO:
            self.memo, self.bad, self.lossy = {}, set(), set()
        self.memo["\n"] = np.array(self.line, np.int32).tobytes()
        cuts = [c for c in cuts if c != "\n"]
        groups = [cuts[i : i + TOGETHER] for i in range(0, len(cuts), TOGETHER)]
        strings = ["\n" + "\n".join(g) for g in groups]
        found = [e.ids for e in self.inner.encode_batch_fast(strings, add_special_tokens=False)]
        expected = self.library.encode(strings, num_threads=self.threads)
        surfaces = self.whole.decode_batch(found, skip_special_tokens=False)
        for group, s, ids, e, surface in zip(groups, strings, found, expected, surfaces, strict=True):
            flat = np.array(ids, np.int32)
            at = np.flatnonzero(flat == self.line[0])
            if e[1:] != ids or len(at) != len(group) or surface != s.replace(MARK, " "):
                self._one_by_one(group)
                continue
            data, ends = flat.tobytes(), (4 * np.append(at, len(flat))).tolist()
            self.memo.update((c, data[i + 4 : j]) for c, i, j in zip(group, ends, ends[1:], strict=False))

    def packed(self, texts: list[str | None]) -> list[tuple[bytes, bool, bool]]:
        """Ids as bytes, parity and round trip of each text."""
        if not self.exact:
            filled = [t or "" for t in texts]
            got = [e.ids if t else [] for t, e in zip(filled, self.whole.encode_batch(filled, add_special_tokens=False), strict=True)]
            return [(np.array(ids, np.int32).tobytes(), ids == e, self.decode(ids) == t) for t, ids, e in zip(filled, got, self.library.encode(filled), strict=True)]
        cuts = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set(chain.from_iterable(cuts))
        new = distinct - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.bad, self.lossy, new = {}, set(), set(), distinct
        if new:
            self.learn(list(new))
        get, fine = self.memo.__getitem__, not self.bad and not self.lossy
        out = [(b"".join(map(get, c)), fine or self.bad.isdisjoint(c), (fine or self.lossy.isdisjoint(c)) and MARK not in (t or "")) for c, t in zip(cuts, texts, strict=True)]
        for c in new:
            if len(c) > LONGEST_KEPT:
                del self.memo[c]
                self.bad.discard(c)
                self.lossy.discard(c)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], bool, bool]]:
        """Ids, parity and round trip of each text."""
        return [(np.frombuffer(ids, np.int32).tolist(), parity, back) for ids, parity, back in self.packed(texts)]


_codecs: dict[str, Codec] = {}


def codec(data: bytes, threads: int | None) -> Codec:
    """One per worker process and model."""
    key = hashlib.sha1(data).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(data, threads)
    return _codecs[key]


def encode(df: DataFrame, model_path: str, *, threads: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, parity, roundtrip, ids`` of every row."""
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data, threads)
        for b in common.slices(batches):
            out = c.packed(b.column(1).to_pylist())
            sizes = np.array([len(x[0]) // 4 for x in out], np.int64)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(x[0] for x in out), np.int32)))
            cells = [b.column(0).cast(pa.int64()), pa.array(sizes), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.bool_()), ids]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "n_tokens", "parity", "roundtrip", "ids"])

    return common.map_arrow(common.pick(df, doc_id=id_col, text=text_col), run, SCHEMA)


def decode(df: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from arrays of ids (null: empty text)."""
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data, None)
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return common.map_arrow(common.pick(df, doc_id=id_col, ids=ids_col), run, "doc_id long, text string")
