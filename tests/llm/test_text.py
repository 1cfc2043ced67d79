import random

import numpy as np
import pyarrow as pa
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import text as tx


def hashed(texts, chunk):
    out = []
    for _, _, buf, offsets in tx.chunks(pa.array(texts, pa.string()), chunk):
        starts, ends, at = tx.segments(buf, offsets, tx.SPACE)
        h = tx.segment_hashes(buf, starts, ends)
        out += [h[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té ", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_hash_alike_wherever_they_stand(texts, chunk):
    known = {}
    for text, got in zip(texts, hashed(texts, chunk)):
        assert len(got) == len(words(text))
        for w, h in zip(words(text), got):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_words_across_blocks():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(200_000))
    whole, again = hashed([text], 1 << 30)[0], dict(zip(words(text), hashed([text], 1 << 30)[0]))
    assert whole == [again[w] for w in words(text)]
    assert hashed([w for w in list(again)[:500]], 100) == [[again[w]] for w in list(again)[:500]]


def test_ngrams_stay_in_their_rows():
    buf = np.frombuffer(b"a b c" + b"a b c d", dtype=np.uint8)
    offsets = np.array([0, 5, 12])
    starts, ends, at = tx.segments(buf, offsets, tx.SPACE)
    grams, first, gram_at = tx.ngrams(tx.segment_hashes(buf, starts, ends), at, 3)
    assert gram_at.tolist() == [0, 1, 3] and first.tolist() == [0, 3, 4] and grams[0] == grams[1] != grams[2]


def test_code_points():
    text = "aé𝒳z"
    buf = np.frombuffer((text + text).encode(), dtype=np.uint8)
    points, at = tx.code_points(buf, np.array([0, len(text.encode()), 2 * len(text.encode())]))
    assert at.tolist() == [0, 4, 8] and points[:4].tolist() == points[4:].tolist() and len(set(points.tolist())) == 4
