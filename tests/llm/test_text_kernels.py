import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldloom.llm import text_kernels as tk

from . import brute

TEXT = st.text(alphabet=st.sampled_from("abAB \n\t\x0b\x0c\ré€😀\x1c　"), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6))
def test_shingles_are_those_of_the_words(texts):
    got = [s for _, part in tk.pieces(pa.array(range(len(texts))), pa.array(texts, pa.string()), 8) for s in tk.shingle_sets(part, 2, True)]
    want = [brute.shingles(t, 2, True) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for a, x in zip(got, want, strict=True):
        for b, y in zip(got, want, strict=True):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_hashes_do_not_depend_on_blocks_or_slices(monkeypatch):
    texts = pa.array(["x" * 5, "one two three four five six", "", "one two three four five six"])
    whole = [s.tolist() for s in tk.shingle_sets(texts, 2, True)]
    assert whole[1] == whole[3]
    monkeypatch.setattr(tk, "BLOCK", 3)
    assert [s.tolist() for s in tk.shingle_sets(texts, 2, True)] == whole
    assert [s.tolist() for s in tk.shingle_sets(texts.slice(1, 2), 2, True)] == whole[1:3]


def test_letter_words():
    points, starts, ends, hashes, at = tk.letter_words(["ab 1c", "", "ab-Ü"])
    assert ["".join(map(chr, points[a:b])) for a, b in zip(starts, ends, strict=True)] == ["ab", "c", "ab", "Ü"]
    assert at.tolist() == [0, 2, 2, 4] and hashes[0] == hashes[2]


@pytest.mark.parametrize("n", [16, 1024, 2048, 1 << 17])
def test_regular_long_words_differ(n):
    a, b = brute.thue_morse(n), brute.thue_morse(n, "b", "a")
    words = [a, b, a[::-1], a + a, a + b, b + a, a[1:], a + "\0", a[:-1] + "\0"]
    for seed in (0, 1):
        assert len(set(tk.word_hashes(pa.array([" ".join(words)]), seed)[0].tolist())) == len(set(words))
    assert len(set(tk.letter_words([" ".join(words[:7])])[3].tolist())) == len(set(words[:7]))
    assert not set(tk.word_hashes(pa.array(words), 0)[0].tolist()) & set(tk.word_hashes(pa.array(words), 1)[0].tolist())


def test_hashes_of_short_words_are_one_to_one():
    words = [x + y + z for x in "\0abAé€😀" for y in ["", *"\0ab€"] for z in ["", *"\0xy"]]
    assert len(set(tk.word_hashes(pa.array(words))[0].tolist())) == len({brute.lower(w) for w in words})


def test_words_across_blocks(monkeypatch):
    texts = pa.array([f"{brute.thue_morse(i)} {'z' * (3 * i)} ab" for i in range(1, 60)])
    whole = tk.word_hashes(texts)[0].tolist()
    monkeypatch.setattr(tk, "BLOCK", 4)
    assert tk.word_hashes(texts)[0].tolist() == whole
