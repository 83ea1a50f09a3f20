from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm import kernels as K
from stowage.llm.simhash import xxh64_fingerprint
from tests.llm.cases import simhash

TEXT = st.text(alphabet=st.sampled_from("ab A\t\n\x0b é日"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_spans_are_the_words_of_each_document(texts):
    raw, at = K.flat(pa.array([t.encode() for t in texts], pa.binary()))
    starts, ends, first = K.spans(raw, at)
    data = raw.tobytes()
    got = [[data[s:e] for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert got == [t.encode().split() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(1, 13))
def test_hashes_agree_exactly_where_words_do(texts, n):
    raw, at = K.flat(pa.array([t.encode() for t in texts], pa.binary()))
    starts, ends, _ = K.spans(raw, at)
    data = raw.tobytes()
    words = [data[s:e] for s, e in zip(starts, ends)]
    h = K.word_hashes(raw, starts, ends)
    grams = K.ngram_hashes(h, n)[: max(0, len(words) - n + 1)]
    seen: dict = {}
    for i, g in enumerate(grams.tolist()):
        assert seen.setdefault(tuple(words[i : i + n]), g) == g
    assert len(set(seen.values())) == len(seen)


def test_a_word_longer_than_a_chunk():
    data = b"x" * (3 * K.CHUNK + 17) + b" y " + b"x" * (3 * K.CHUNK + 17) + b" " + b"x" * (3 * K.CHUNK + 16)
    raw, at = K.flat(pa.array([data], pa.binary()))
    starts, ends, _ = K.spans(raw, at)
    h = K.word_hashes(raw, starts, ends)
    assert h[0] == h[2] != h[3]


def test_sliding():
    x = np.array([5, 3, 4, 1, 9], np.uint64)
    assert K.sliding(x, 3, np.minimum, 2**64 - 1).tolist() == [3, 1, 1, 1, 9]


@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_fingerprints(text):
    assert xxh64_fingerprint(text.encode(), 4) == simhash(text)


def test_the_leftmost_least_of_each_stretch():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 5, 12, 60):
        x = rng.integers(0, 6, n).astype(np.uint64)
        for width in (1, 2, 7, 38, 100):
            got = K.leftmost_least(x, width)
            assert got.tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(n)]


def test_words_and_windows_that_cancel_in_sums_have_other_hashes():
    """Thue-Morse words of two letters, and of two words: sums of powers of them are equal for 1024 of them."""
    signs = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = ("".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs))
    raw = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    starts, ends, _ = K.spans(raw, np.array([0, len(raw)]))
    a, b = K.word_hash_pairs(raw, starts, ends)
    assert a[0] != a[1] and b[0] != b[1]
    sentence = " ".join("ab"[s] for s in signs) + " " + " ".join("ba"[s] for s in signs)
    raw = np.frombuffer(sentence.encode(), np.uint8)
    starts, ends, _ = K.spans(raw, np.array([0, len(raw)]))
    grams = K.ngram_hashes(K.word_hashes(raw, starts, ends), 1024)
    assert grams[0] != grams[1024]
