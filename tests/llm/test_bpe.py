import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voltide.llm import bpe
from voltide.llm.queries import op5_bpe, table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.Tables(PATH))


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query(spark, medium, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, medium, "documents").collect()}
    got = op5_bpe(spark, medium).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == digests(library, texts[r["doc_id"]]), r["doc_id"]


def test_hard_rows(docs, rows, none, library):
    got = sorted((tuple(r) for r in bpe.digest(docs, PATH).collect()), key=str)
    assert got == sorted(((r[0], *digests(library, r[1])) for r in rows), key=str)
    assert bpe.digest(none, PATH).count() == 0
    ids = {r["doc_id"]: r for r in bpe.encode(docs, PATH).collect()}
    assert ids[2]["decoded"] == library.decode(ids[2]["ids"], skip_special_tokens=False)


CORNERS = [":\U0003d000 a\U00033470b \u0558", "\u1c89\ua7cb\ua7dc \U00010d50x \U00016ea0", "İstanbul ΟΔΟΣ ΣΑΣ Straße ﬁ Å é ñ", "<|endoftext|>hello<|startoftext|>", "a<|endoftext|", "<|ENDOFTEXT|>", "don't WE'LL I'M it's'S '' 're", "１２３ ½ ² Ⅷ 12345", "  x　y​z﻿", "日本語 한국어 ไทย हिन्दी عربى", "🙂👍🏽👨‍👩‍👧 \U0001f1e9\U0001f1ea", "\0\x01\x1f\x7f\x80\x85\x1c", "_a_b__ c-d/e...!!!", "ẹ́ ẛ̣ Å", "\0<|endoftext|> \0", "ʼn ǰ ΐ ẖ K Å", "퟿  �", "ꙮ ⅓ Ⓐ ⁴ ₅ ª º", "ẞ ϒ ϴ Ω K", "w" * 3000]


@pytest.mark.parametrize("text", CORNERS)
def test_corners(library, coder, text):
    ids, decoded = coder.code([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
    assert decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcdest '<|>endofx.12ΣσİÍ")), max_size=60))
def test_any_text(library, coder, text):
    ids, decoded = coder.code([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
    assert decoded == library.decode(want, skip_special_tokens=False)


def test_speculation_is_used_and_repaired(coder):
    before = coder.repaired
    coder.code(["the quick brown fox jumps over a lazy dog unbelievably antidisestablishmentarianism"])
    assert coder.repaired - before < 8


def test_one_huge_word(library, coder):
    """A word of a megabyte is merged in a time in proportion, and the result is the library's on a piece that it manages."""
    r = random.Random(6)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    piece = word[: 1 << 13]
    assert np.frombuffer(coder.code([piece])[0][0], "<u4").tolist() == library.encode(piece, add_special_tokens=False).ids
    began = time.perf_counter()
    ids, decoded = coder.code([word])[0]
    assert len(ids) > 4 and decoded.replace(" ", "").replace("</w>", "") == word and time.perf_counter() - began < 60


def by_scanning(tables, ids):
    """Merging by looking at all pairs each time."""
    while True:
        ranks = [tables.merge.get(a * tables.size + b) for a, b in zip(ids, ids[1:])]
        known = [x for x in ranks if x is not None]
        if not known:
            return ids
        k = ranks.index(min(known))
        ids = [*ids[:k], tables.made[ranks[k]], *ids[k + 2 :]]


def test_exact_merging(coder):
    r = random.Random(7)
    letters = [coder.t.vocab[x] for x in "abeinorst"]
    for n in (1, 2, 3, 10, 60, 200):
        for _ in range(20):
            ids = [r.choice(letters) for _ in range(n)]
            assert coder.t.exact(list(ids)) == by_scanning(coder.t, ids)
