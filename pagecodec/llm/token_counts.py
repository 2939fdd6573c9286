"""Token counts of a byte-level BPE by the whole-token shortcut.

Offline proof: every vocabulary entry that is valid UTF-8 is encoded alone; those that come back as exactly one
token are *whole tokens*. Pre-tokenisation splits a text into pre-tokens that the merges never cross, so a
pre-token that is a whole token counts 1 without merging; every other distinct pre-token is merged once by the
library and remembered in a bounded memo.

Cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text follow the library's default
(one special token each); a text with a character outside ``TRUSTED`` (where the two regex engines' Unicode
versions may differ) is encoded by the library as a whole; texts are never cut. Repeated rows give repeated rows,
an empty table gives an empty table, null ids stay null.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: The split of GPT-2 style byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on which the library's and ``regex``'s classes agree (tests/llm checks every one).
TRUSTED = "\x00-՗Ḁ-₎₠-₿←-⏳─-⛿ぁ-ゖァ-ヺ一-龥가-힣\U0001f300-\U0001f5ff"
#: Distinct merged pre-tokens remembered per worker; when full the memo starts anew.
MEMO = 150_000
#: Characters of the longest merged pre-token that stays in the memo.
LONGEST_KEPT = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE, character to byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    extra = (b for b in range(256) if b not in set(keep))
    return out | {chr(256 + i): b for i, b in enumerate(extra)}


def merger(spec: str):
    """The library's tokenizer that merges one pre-token: the same model, no split and no added tokens."""
    from tokenizers import Tokenizer, pre_tokenizers

    j = json.loads(spec)
    t = Tokenizer.from_str(json.dumps(j | {"added_tokens": [], "post_processor": None, "truncation": None, "padding": None}))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return t


def supported(spec: str) -> bool:
    """Whether the shortcut's premises hold: no normaliser, plain byte-level split, special tokens unstripped."""
    j = json.loads(spec)
    p = j.get("pre_tokenizer") or {}
    plain = p.get("type") == "ByteLevel" and p.get("use_regex", True) and not p.get("add_prefix_space")
    return bool(plain and not j.get("normalizer") and j["model"]["type"] == "BPE" and all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in j["added_tokens"]))


def prove(spec: str) -> list[str]:
    """Vocabulary strings that encode alone as exactly one token."""
    to_byte, t = byte_chars(), merger(spec)
    found = []
    for token in json.loads(spec)["model"]["vocab"]:
        try:
            found.append(bytes(to_byte[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    return [s for s, e in zip(found, t.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1]


def _members(prop: str) -> str:
    """The trusted code points with a property, as the inside of a character class of ``re``."""
    trusted, has, runs = regex.compile(f"[{TRUSTED}]").match, regex.compile(prop).match, []
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000 and trusted(chr(c)) and has(chr(c)):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def fast_split() -> str:
    """``PATTERN`` for texts of trusted characters, with explicit classes that the ``re`` module scans twice as fast."""
    letter, number, blank = _members(r"\p{L}"), _members(r"\p{N}"), _members(r"\s")
    return f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{letter}{number}{blank}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


class Counter:
    """Counts tokens of texts; lives in a Python worker."""

    def __init__(self, spec: str, whole: list[str], split: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = merger(spec).model
        self.split = re.compile(split or fast_split()).findall
        self.odd = regex.compile(f"[^{TRUSTED}]").search
        stand_in = {b: c for c, b in byte_chars().items()}
        self.of_byte = [stand_in[b] for b in range(256)]
        self.of_ascii = {b: stand_in[b] for b in range(128)}
        specials = [a["content"] for a in json.loads(spec)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))).search if specials else lambda _: None
        self.whole = dict.fromkeys(whole, 1)
        self.memo: dict[str, int] = dict(self.whole)

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token, by the library's merges."""
        shown = piece.translate(self.of_ascii) if piece.isascii() else "".join(map(self.of_byte.__getitem__, piece.encode()))
        return len(self.model.tokenize(shown))

    def count(self, text: str) -> int:
        if self.odd(text) or self.special(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        pieces = self.split(text)
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, pieces))
        except KeyError:
            pass
        new = [p for p in set(pieces) if p not in memo]
        if len(memo) + len(new) > MEMO + len(self.whole):
            self.memo = memo = dict(self.whole)
            new = [p for p in set(pieces) if p not in memo]
        memo.update(zip(new, map(self.merged, new), strict=True))
        n = sum(map(memo.__getitem__, pieces))
        for p in new:
            if len(p) > LONGEST_KEPT:
                del memo[p]
        return n


_counters: dict[str, Counter] = {}


def counter(spec: str, whole: list[str], split: str) -> Counter:
    """One per worker process and vocabulary."""
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _counters:
        _counters[key] = Counter(spec, whole, split)
    return _counters[key]


def token_counts(df: DataFrame, tokenizer_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; one narrow scan, no shuffle."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    if not supported(spec):
        raise ValueError("the whole-token shortcut needs a byte-level BPE without normaliser")
    whole, split = prove(spec), fast_split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(spec, whole, split).count
        for b in common.slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()),
            ], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.map_arrow(common.pick(df, doc_id=id_col, text=text_col), run, SCHEMA)
