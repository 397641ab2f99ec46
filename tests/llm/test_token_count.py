import os
import random

import pyarrow as pa
import pytest

from tests.llm.corpora import frame, mixed, odd
from tidemark.llm.token_count import VOCABULARY, Counter, count_tokens, counts, load_vocabulary

tokenizers = pytest.importorskip("tokenizers")
SMALL = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), ("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -5.0), ("ba", -4.0), ("aba", -6.0), ("▁ab", -7.0), ("é", -3.5), ("bb", -3.9)]


def tokenizer(vocabulary):
    made = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, 0, True))
    made.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def strange(n):
    rng = random.Random(1)
    return ["", " ", "  a", "a\nb", "▁x", "<0x41>", "a" * 300] + ["".join(rng.choice(" \nabß日😀<0x41>é▁") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ties_and_unknowns_as_the_tokenizer():
    texts = strange(3000)
    want = [len(e.ids) for e in tokenizer(SMALL).encode_batch(texts, add_special_tokens=False)]
    assert counts(pa.array(texts), Counter(SMALL)).tolist() == want


def test_memory_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr("tidemark.llm.token_count.REMEMBERED", 3000)
    counter, texts = Counter(SMALL), ["ab" * 5000, *(f"{'a' * (i % 50)}b" for i in range(300)), "é ab aba"]
    want = [len(e.ids) for e in tokenizer(SMALL).encode_batch(texts, add_special_tokens=False)]
    for text, n in zip(texts, want, strict=True):
        assert counts(pa.array([text]), counter).tolist() == [n]
        assert sum(map(len, counter.known)) <= 3000


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")
def test_documents_as_the_tokenizer(spark):
    vocabulary = load_vocabulary()
    rows = mixed() + odd()
    got = count_tokens(frame(spark, rows, clash=True))
    want = [(r[0], len(tokenizer(vocabulary).encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert count_tokens(frame(spark, [])).count() == 0
