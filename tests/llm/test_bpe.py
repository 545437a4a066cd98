import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowguard.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_spec(queries.default_tokenizer()))


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def test_words_equal_the_library(encoder, library):
    rng = random.Random(1)
    words = ["aaaaaaaaaaa", "hahahahaha", "!!!!!!!!!!!!!", "mississippi", "<|endoftext|>x<|startoftext|>", "<|endoftext", "I'll we've 's"]
    words += ["".join(rng.choice("thenasio") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for w in words:
        assert ids(encoder, w) == library.encode(w, add_special_tokens=False).ids, w


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text_equals_the_library(encoder, library, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_toy_merges():
    vocab = {x: i for i, x in enumerate(["a", "b", "aa", "ab", "aab", "ba"])}
    spec = {"model": {"vocab": vocab, "merges": [["a", "a"], ["a", "b"], ["aa", "b"], ["b", "a"]]}}

    def by_merging(word):
        parts = list(word)
        for u, v in spec["model"]["merges"]:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return [vocab[p] for p in parts]

    a = bpe.Automaton(spec)
    for n in range(1, 11):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> i & 1] for i in range(n))
            assert a.word(word) == by_merging(word), word


def test_query_equals_the_library(spark, sf_dir, documents, library):
    got = {r["doc_id"]: r for r in queries.op7_bpe(spark, sf_dir).collect()}
    for r in documents.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(want) and g["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_edges(edge, nothing, library):
    spec = bpe.read_spec(queries.default_tokenizer())
    out = bpe.decode(bpe.encode(edge, spec), spec)
    assert out.columns == [*edge.columns, "token_ids", "decoded"]
    rows = out.collect()
    assert len(rows) == edge.count()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(nothing, spec).count() == 0
