import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.bpe import MATRIX_BYTES, ByteBpe, bpe_decode, bpe_encode, bpe_round_trip
from tidemark.llm.tokens import Counting, compact_table, cut, opened_table, token_counts
from collections import Counter

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return ByteBpe.load(RANKS, P.PATTERN)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_whole_texts(docs, rows, library):
    out = bpe_round_trip(docs, RANKS, P.PATTERN)
    assert "IDS" not in out.columns and "text" not in out.columns
    want = sorted(str((r[0], hashlib.sha256(np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest(), (r[1] or "").encode())) for r in rows)
    assert sorted(str((r["doc_id"], hashlib.sha256(r["ids"]).hexdigest(), bytes(r["decoded"]))) for r in out.collect()) == want


def test_encode_then_decode(docs, nothing):
    enc = bpe_encode(docs.select("doc_id", "text"), RANKS, P.PATTERN, keep_text=True)
    for r in bpe_decode(enc, RANKS, P.PATTERN).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe_round_trip(nothing, RANKS, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=5))
def test_any_text(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))} if not hasattr(test_any_text, "lib") else None
    if ranks:
        test_any_text.lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        test_any_text.own = ByteBpe(ranks, P.PATTERN)
    assert [ids(x) for x in test_any_text.own.encode(texts)] == [test_any_text.lib.encode_ordinary(t) for t in texts]


def test_matrix_and_heap_agree(own, library):
    for piece in ("ab" * (MATRIX_BYTES // 2), "the" * 90, "q" * (MATRIX_BYTES + 1), "=" * 1000, "étude" * 70):
        raw = piece.encode()
        assert ids(own._heap(raw)) == library._core_bpe.encode_single_piece(raw)
        assert ids(own._matrix([raw], 1 << (len(raw) - 1).bit_length())[0]) == library._core_bpe.encode_single_piece(raw)


def test_unknown_id_is_refused(own):
    with pytest.raises(KeyError):
        own.decode(np.array([50256], "<u4").tobytes())


def test_counts(docs, rows, nothing):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted(str((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids))) for r in rows)
    for size in (5, 1000):
        got = token_counts(docs, path, P.PATTERN, size=size)
        assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in got.collect()) == want
    assert token_counts(nothing, path, P.PATTERN).count() == 0


def test_plain_ranges_are_split_as_the_library_splits():
    c = Counting(P.path("byte_bpe_50k.json"), P.PATTERN)
    pre = c.tokenizer.pre_tokenizer
    for ch in map(chr, range(0x110000)):
        if not 0xD800 <= ord(ch) <= 0xDFFF and not c.odd(ch):
            s = f"a{ch}b 1{ch}2 {ch}{ch}"
            assert [s[a:b] for _, (a, b) in pre.pre_tokenize_str(s)] == c.pieces_of(s), hex(ord(ch))


def test_table_and_summary():
    table = {"é": 3, " the": 1, "x" * 300: 9}
    assert opened_table(compact_table(table)) == table
    assert cut(Counter(a=5, b=3, c=1), 2) == Counter(a=4, b=2)


def test_the_faster_splitter_gives_the_same_pieces():
    import regex

    from tidemark.llm.common import piece_splitter

    fast, slow = piece_splitter(P.PATTERN), regex.compile(P.PATTERN).findall
    for ch in map(chr, range(0x3100)):
        for s in (f"a{ch}b 1{ch}2 {ch}{ch}", f"{ch}'s  {ch}\n{ch} _{ch}_", f"  {ch}"):
            assert fast(s) == slow(s), hex(ord(ch))
    assert piece_splitter(r"\s+|\S+")("a b") == ["a", " ", "b"]


ODD = [
    "price 5€ and 6 €€, now", "→ go → on", "🙂🙂 smile 👩‍👩‍👧 family", "مرحبا بالعالم 123 العربية", "नमस्ते दुनिया, कैसे हो", "สวัสดีชาวโลก ภาษาไทย",
    "<|endoftext|>€<|endoftext|>  a", "  €  \n\n→\t x", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 ① ② ③", "  　€ a", "'s€'ll 'x €'re", "€" * 3_000, "ሀሁ ʼn ՙ ᠎ x",
]


def test_odd_scripts_go_through_table_and_cache(spark, monkeypatch):
    """Every script is cut into pieces that are looked up; the library never counts a whole text of several pieces."""
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in ODD]
    own = Counting(path, P.PATTERN)
    asked: list[str] = []
    lengths = own.lengths
    monkeypatch.setattr(own, "lengths", lambda pieces: asked.extend(pieces) or lengths(pieces))
    assert own.count(ODD) == want
    pre = own.tokenizer.pre_tokenizer
    assert all(len(pre.pre_tokenize_str(p)) == 1 for p in asked) and len(asked) == len(set(asked))
    asked.clear()
    assert own.count(ODD) == want and all(len(p) > 64 for p in asked)
    got = token_counts(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3), path, P.PATTERN, size=20)
    assert [r["n_tokens"] for r in got.orderBy("doc_id").collect()] == want


def test_any_text_is_counted_as_the_library_counts():
    path = P.path("byte_bpe_50k.json")
    own, t = Counting(path, P.PATTERN), Tokenizer.from_file(path)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("€→ \n'sltm🙂नม"), max_size=60), max_size=4))
    def check(texts):
        assert own.count(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]

    check()
