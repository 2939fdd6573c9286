"""Token counts and SentencePiece against the libraries; fingerprints against brute force."""

import hashlib
import random
import re
import struct

import pytest
from pagecodec.llm import ctph, queries, sentencepiece_backend, token_counts

BPE, PIECES = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
ODD = ["", " ", "\n\n  \t x", "a" * 5000, "don't we'll '''s 12345 ١٢٣ ½ x²", "<|endoftext|> a<|endoftext|>", "日本語テキスト 한국어 ไทย", "😀😀 é    \x00\x1f", "▁ ▁▁a <s> </s> <0x0A>", "AbC " * 3000, "  lead and trail  "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def counter():
    spec = open(BPE, encoding="utf-8").read()
    return token_counts.Counter(spec, token_counts.prove(spec))


def test_token_query_is_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_token_counts(spark, SF).collect()
    n = dict(zip(texts, (len(e.ids) for e in library.encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))
    assert {tuple(r) for r in got} == {(i, len(t.encode()), n[i], n[i] > 512) for i, t in texts.items()}
    assert len(got) == len(texts)


def test_counts_of_odd_texts(library, counter):
    r = random.Random(1)
    alphabet = "ab 'st\n\t1½é日😀▁<|> ́"
    texts = ODD + ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(2000)]
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert not any(len(k) > token_counts.LONGEST_KEPT for k in counter.memo.keys() - counter.whole.keys())


def test_memo_starts_anew(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    for t in ODD:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_trusted_characters_split_alike():
    """On every trusted code point the library's split and both patterns agree."""
    import regex
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    own, fast, trusted = regex.compile(token_counts.PATTERN), re.compile(token_counts.fast_split()), regex.compile(f"[{token_counts.TRUSTED}]").match
    for c in (chr(x) for x in range(0x20000) if not 0xD800 <= x < 0xE000):
        if trusted(c):
            t = f"a{c}a 1{c}1 .{c}. {c}{c} {c}"
            want = [t[a:b] for _, (a, b) in split(t)]
            assert own.findall(t) == want == fast.findall(t), hex(ord(c))


def test_counts_of_odd_documents(spark, odd, none, library):
    want = sorted(repr((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512)) for r in odd.collect())
    assert sorted(repr(tuple(r)) for r in token_counts.token_counts(odd, BPE).collect()) == want
    assert token_counts.token_counts(none, BPE).count() == 0


def test_unsupported_vocabularies_are_refused(spark, odd):
    with pytest.raises(ValueError):
        token_counts.token_counts(odd, queries.tokenizer_path("word_bpe_49k.json"))


# SentencePiece


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_backend.Codec(open(PIECES, "rb").read(), 2)


def check(codec, texts):
    import sentencepiece

    for (ids, parity, roundtrip), t, want in zip(codec.encode(texts), texts, codec.library.encode(texts), strict=True):
        assert (ids == want) == parity
        assert parity, t
        if roundtrip:
            assert codec.decode(ids) == t.replace(sentencepiece_backend.MARK, " ")
    assert sentencepiece.SentencePieceProcessor is type(codec.library)


def test_pieces_of_odd_texts(codec):
    r = random.Random(2)
    check(codec, ODD + ["".join(r.choices("ab ▁\n\té日😀.1", k=r.randrange(50))) for _ in range(2000)])


def test_round_trip_is_of_the_text_by_the_rebuilt_decoder(codec):
    texts = ["a b", "a▁b", "▁", " a  b \n 😀\x01", "é\n\n", "", "plain again", None]
    for t, (ids, _, roundtrip) in zip(texts, codec.encode(texts), strict=True):
        assert roundtrip == (codec.decode(ids) == (t or "")), t
    assert [r for _, _, r in codec.encode(["a▁b", "a b"])] == [False, True]
    whole = codec.whole

    class Broken:
        """A decoder that loses a character."""

        def __getattr__(self, name):
            return getattr(whole, name)

        def decode(self, ids, **kw):
            return whole.decode(ids, **kw).replace("q", "")

        def decode_batch(self, ids, **kw):
            return [self.decode(i, **kw) for i in ids]

    codec.whole = Broken()
    try:
        assert [r for _, _, r in codec.encode(["never seen qzqzq", "never seen zz"])] == [False, True]
    finally:
        codec.whole = whole
        codec.memo, codec.bad, codec.lossy = {}, set(), set()


def test_piece_query_is_the_library(spark, codec):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op5_sentencepiece(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for (i, t), want in zip(texts.items(), codec.library.encode(list(texts.values())), strict=True):
        assert got[i].ids == want and got[i].parity and got[i].n_tokens == len(want) and got[i].roundtrip and codec.decode(want) == t


def proto(number, value):
    """A protobuf field: text and bytes, floats or integers."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    n, out = value if isinstance(value, int) else len(value), b""
    key = number << 3 | (0 if isinstance(value, int) else 2)
    for x in (key, n):
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        out += bytes([x])
    return out if isinstance(value, int) else out + value


def unigram(squeeze=0, dummy=1):
    """A unigram model with byte fallback, put together by hand."""
    words = ["▁", "▁the", "▁a", "th", "he", "e", "t", "h", "a", "b", "ab", "▁ab", "aba", "bab", "é", ".", "▁▁"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((w, -1.0 - (7.31 * i * i) % 3.7, 1) for i, w in enumerate(words))]
    body = b"".join(proto(1, proto(1, p.encode()) + proto(2, s) + proto(3, k)) for p, s, k in pieces)
    return body + proto(2, proto(3, 1) + proto(35, 1) + proto(40, 0) + proto(41, 1) + proto(42, 2)) + proto(3, proto(1, b"identity") + proto(3, dummy) + proto(4, squeeze) + proto(5, 1))


def test_unigram_with_byte_fallback():
    c = sentencepiece_backend.Codec(unigram())
    assert c.model.kind == sentencepiece_backend.UNIGRAM and c.model.byte_fallback and c.exact
    r = random.Random(5)
    check(c, [*("".join(r.choices("abthe .é", k=r.randrange(1, 30))) for _ in range(1500)), "the ab日b", "\n", ""])


def test_unigram_that_squeezes_blanks():
    c = sentencepiece_backend.Codec(unigram(squeeze=1))
    assert not c.exact
    check(c, ["the  a", "ab ab", "  the b ", "a", ""])


def test_pieces_of_odd_documents(spark, odd, none, codec):
    out = sentencepiece_backend.encode(odd, PIECES)
    assert sorted(map(repr, ((r.doc_id, r.ids, r.parity) for r in out.collect()))) == sorted(repr((r.doc_id, codec.library.encode(r.text or ""), True)) for r in odd.collect())
    back = sorted(repr(tuple(r)) for r in sentencepiece_backend.decode(out, PIECES).collect())
    assert back == sorted(repr((r.doc_id, (r.text or "").replace("▁", " "))) for r in odd.collect())
    assert sentencepiece_backend.encode(none, PIECES).count() == 0


# fingerprints


def brute_likeness(a, b):
    def indel(x, y):
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            e = [i]
            for j, k in enumerate(y, 1):
                e.append(d[j - 1] if c == k else 1 + min(d[j], e[-1]))
            d = e
        return d[-1]

    def score(x, y):
        runs = {x[i : i + 7] for i in range(len(x) - 6)}
        return 1 - indel(x, y) / (len(x) + len(y)) if any(y[i : i + 7] in runs for i in range(len(y) - 6)) else float(x == y != "")

    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    pairs = [(a1, b1), (a2, b2)] if m == n else [(a1, b2)] if int(m) == 2 * int(n) else [(a2, b1)] if int(n) == 2 * int(m) else []
    return max((score(x, y) for x, y in pairs), default=0.0)


def brute_neighbours(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        own, other = ctph.fingerprint(t), ctph.fingerprint(new)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), own, other, brute_likeness(own, other), brute_likeness(own, ctph.fingerprint(following))))
    return out


def test_fingerprint_query_is_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in queries.op8_ctph(spark, SF).collect()}
    assert len(got) == len(rows)
    for want in brute_neighbours(rows):
        assert got[want[0]][:5] == want[:5] and got[want[0]][5:] == pytest.approx(want[5:])


def test_boundaries_follow_the_content():
    r = random.Random(8)
    text = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(800))
    a = ctph.fingerprint(text)
    assert ctph.likeness(a, ctph.fingerprint(text[:2500] + "some new words " + text[2500:])) > 0.9
    assert ctph.likeness(a, ctph.fingerprint(text[300:])) > 0.8
    assert ctph.likeness(a, ctph.fingerprint("".join(r.choices("ijklmnop ", k=len(text))))) == 0.0


def test_rolling_hash_sees_seven_bytes():
    r = random.Random(4)
    a, b = r.randbytes(200), r.randbytes(90)
    assert (ctph.rolling(a + a[:60])[206:] == ctph.rolling(b + a[:60])[96:]).all()
    assert len(ctph.rolling(b"x")) == 1


def test_fingerprints_of_odd_documents(spark, odd, none):
    got = ctph.edited_neighbours(odd).collect()
    assert len(got) == 13 and sum(r.doc_id is None for r in got) == 2
    assert all(r.fingerprint == "3::" for r in got if r.n_chars == 0)
    assert ctph.edited_neighbours(none).count() == 0
    one = ctph.edited_neighbours(odd.where("doc_id = 2")).first()
    assert one.near_next == 1.0
    ids = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(-50, 50)], "doc_id long, text string").repartition(5)
    want = brute_neighbours([(r.doc_id, r.text) for r in ids.collect()])
    rounded = lambda rows: sorted((*r[:5], round(r[5], 9), round(r[6], 9)) for r in rows)
    assert rounded(ctph.edited_neighbours(ids).collect()) == rounded(want)
    assert rounded(ctph.edited_neighbours(ids, range_bytes=10).collect()) == rounded(want)


def test_ranges_follow_the_bytes(spark):
    ids = spark.createDataFrame([(i, "word " * 40) for i in range(300)], "doc_id long, text string")
    few = ctph.edited_neighbours(ids).rdd.getNumPartitions()
    many = ctph.edited_neighbours(ids, range_bytes=500)
    assert many.rdd.getNumPartitions() == 300 * 200 // (500 * 4) > few
    assert many.count() == 300
