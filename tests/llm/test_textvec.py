"""Words, grams and hashes of Arrow text batches against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import textvec as tv

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c 日|", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_the_ascii_white_space_split(texts):
    data, offsets = tv.utf8(pa.array(texts, pa.string()))
    starts, ends, first = tv.split_words(data, offsets)
    got = [[bytes(data[starts[k]:ends[k]]) for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [(t or "").encode().split() for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_grams_stay_inside_their_text(texts, n):
    if not texts:
        return
    for a, b, t in tv.texts_of(pa.array(texts, pa.string())):
        ch, cf = t.char_grams(n)
        wh, wf = t.word_grams(n)
        seen_c, seen_w = {}, {}
        for i, text in enumerate(texts[a:b]):
            text = text or ""
            chars = [text[k:k + n] for k in range(len(text) - n + 1)]
            words = text.encode().split()
            grams = [tuple(words[k:k + n]) for k in range(len(words) - n + 1)]
            assert cf[i + 1] - cf[i] == len(chars) and wf[i + 1] - wf[i] == len(grams)
            for seen, h, keys in ((seen_c, ch[cf[i]:cf[i + 1]], chars), (seen_w, wh[wf[i]:wf[i + 1]], grams)):
                for key, value in zip(keys, h.tolist()):
                    assert seen.setdefault(key, value) == value
        for seen in (seen_c, seen_w):
            assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_chunks_and_windows():
    column = pa.array(["x" * 9, "ab", None, "", "cde"])[1:]
    data, offsets = tv.utf8(column)
    assert bytes(data) == b"abcde" and offsets.tolist() == [0, 2, 2, 2, 5]
    assert list(tv.chunks(np.array([0, 5, 50, 51, 52]), 10)) == [(0, 1), (1, 2), (2, 4)]
    x = np.random.default_rng(0).integers(0, 99, 200).astype(np.uint64)
    assert (tv.window_min(x, 7) == [x[i:i + 7].min() for i in range(194)]).all()
    assert (tv.window_max(x, 7) == [x[i:i + 7].max() for i in range(194)]).all()
