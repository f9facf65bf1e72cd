import random

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import bpe as B
from siltstone.llm.kernels import text_buffers

from .helpers import LANG, documents, no_docs, odd_docs

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = ["don't", "it's", " 's", "''s", "we've they'll I'd", "  ", " ", "\n", "\n\n ", "é", "ñandú", "中文字", "😀", " ", "　x", "123", "½", "a1b2", "'", '"', "!!!", "\t", "'re", "'R", "aaaa", "aaaaaaaaa", "abababab", "-----", "x́", "\r\n", "end", "İ", "𝒳", "   lead"]


@pytest.fixture(scope="module")
def pair():
    with open(B.VOCABULARY, "rb") as f:
        bpe = B.Bpe.load(f.read())
    return bpe, tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids_of(bpe, texts):
    out = [None] * len(texts)
    for lo, hi, ids, ioff, b, o in bpe.encode(*text_buffers(pa.array(texts, pa.string()))):
        back, boff = bpe.decode(ids)
        assert back.tobytes() == b.tobytes()
        for d in range(lo, hi):
            out[d] = ids[ioff[d - lo] : ioff[d - lo + 1]].tolist()
    return out


def test_equals_tiktoken(pair, spark, sf):
    bpe, enc = pair
    r = random.Random(2)
    texts = ["".join(r.choice(WORDS) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["", "a" * 3000, " " * 50]
    texts += [x.text for x in documents(spark, sf).collect()]
    assert ids_of(bpe, texts) == [enc.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=40), max_size=4))
def test_any_text(pair, texts):
    bpe, enc = pair
    for t, ids in zip(texts, ids_of(bpe, texts)):
        assert enc.decode(ids) == t


def test_a_merge_may_make_a_pair_of_lower_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"aba": 299, b"bc": 400}
    bpe = B.Bpe(ranks)
    assert ids_of(bpe, ["abab", "ababa", "abc"]) == [bpe.one(b"abab"), bpe.one(b"ababa"), bpe.one(b"abc")]
    assert bpe.one(b"abab") == [299, 98]


def test_round_trip_and_edges(spark):
    assert B.encode(no_docs(spark)).collect() == []
    docs = odd_docs(spark)
    enc = B.encode(docs)
    rows = enc.collect()
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    want = sorted((r[0], r[1] or "") for r in docs.collect() if r[0] is not None)
    assert sorted(tuple(r) for r in B.decode(enc).collect()) == want
    with pytest.raises(Exception, match="outside the vocabulary"):
        B.decode(spark.createDataFrame([(1, [99999])], "doc_id long, ids array<int>")).collect()
    assert B.decode(spark.createDataFrame([(1, None), (2, [64])], "doc_id long, ids array<int>")).count() == 2
    assert LANG["en"] in {r.text for r in B.decode(enc).collect()}
