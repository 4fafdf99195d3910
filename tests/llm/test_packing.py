import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldloom.llm import packing
from foldloom.llm.token_ids import Ids

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXT = st.text(alphabet=st.sampled_from("ab 0.\n\t'sé　́\x1cΣ<|>"), max_size=40)


@pytest.mark.parametrize(("path", "spaced"), [(BYTES, True), (WORDS, False)])
def test_ids_are_the_tokenizers(path, spaced):
    plain, own = Tokenizer.from_file(path), Ids(path)
    assert own.spaced == spaced and not own.whole
    plain.encode_special_tokens = True

    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXT, max_size=5))
    def check(texts):
        texts = [*texts, "x" * 50 + " of " + "y" * 50, "a  b", " a", "<|endoftext|>"]
        ids, at = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]

    check()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_every_code_point_beside_punctuation(path):
    plain, own = Tokenizer.from_file(path), Ids(path)
    plain.encode_special_tokens = True
    for pattern in ("x {}. y", "{}!", "a{}b, {}; c", "e{}.\n{}?"):
        texts = [pattern.format(chr(c), chr(c)) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
        ids, at = own.encode(pa.array(texts))
        want = [x.ids for x in plain.encode_batch_fast(texts, add_special_tokens=False)]
        assert np.array_equal(np.diff(at), [len(x) for x in want]) and ids.tolist() == [i for x in want for i in x]


def test_files_of_other_kinds_are_tokenized_whole(tmp_path):
    from tokenizers import models, normalizers, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2, "b c": 70_000, **{f"w{i}": i for i in range(3, 69_000)}}, unk_token="[UNK]"))
    other.normalizer, other.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Split("|", "removed")
    other.save(str(tmp_path / "t.json"))
    own = Ids(str(tmp_path / "t.json"))
    ids, at = own.encode(pa.array(["A|b|B c", None, "", "w7|b c|a"]))
    assert own.whole and ids.dtype == np.uint32 and ids.tolist() == [0, 1, 70_000, 7, 70_000, 0] and at.tolist() == [0, 3, 3, 3, 6]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_of_letters_reach_the_tokenizer_alone(path, monkeypatch):
    """The tokenizer makes the ids of new words and no marks between them, whatever generations still know."""
    made, encoded = [], Ids._encoded
    monkeypatch.setattr(Ids, "_encoded", lambda self, texts, *how: made.append(sum(map(len, got := encoded(self, texts, *how)))) or got)
    plain, own, draw = Tokenizer.from_file(path), Ids(path, 500), np.random.default_rng(0)
    for _ in range(6):
        words = ["".join(map(chr, draw.integers(97, 123, n))) for n in draw.choice([3, 9, 60], 300)] + ["größe", "stöckchen"]
        texts = [f"the {' '.join(words)}", " ".join(f"the {w}" for w in words)]
        made.clear()
        ids, at = own.encode(pa.array(texts))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        assert sum(made) <= len(want[0]) + 2


def test_a_vocabulary_without_edges(tmp_path):
    """Where tokens don't tell words apart, marks do."""
    own = json.loads(Tokenizer.from_file(WORDS).to_str())
    own["model"]["end_of_word_suffix"] = None
    (tmp_path / "t.json").write_text(json.dumps(own))
    plain, ids = Tokenizer.from_file(str(tmp_path / "t.json")), Ids(str(tmp_path / "t.json"))
    texts = ["some words of letters", "and (others), 12 of them"]
    assert not ids.whole and ids.encode(pa.array(texts))[0].tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_every_piece_once(lengths):
    histogram = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, dtype=int)
    used = np.zeros(65, dtype=int)
    for combo, n in packing.plan(histogram):
        assert 0 < sum(combo) <= 64 and n > 0
        for x in combo:
            used[x] += n
    assert (used == histogram).all()


def test_least_squares_finds_an_exact_cover():
    histogram = np.zeros(65, dtype=int)
    histogram[[20, 44]] = 1000
    histogram[[10, 24, 30]] = 500
    assert sum(n for c, n in packing.plan(histogram) if sum(c) == 64) == 1500


def test_pieces_and_sequences(spark):
    texts = [None, "", "word", "word", "a few words"] + [" ".join(f"n{i * j % 97}" for j in range(i * 7)) for i in range(1, 40)]
    rows = list(enumerate(texts)) + [(None, "nameless")]
    got = packing.packed(spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, length int"), BYTES, width=256).collect()
    plain = Tokenizer.from_file(BYTES)
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
        total += at
    assert sorted(sequences) == list(range(len(sequences))) and total > 0.9 * 256 * len(sequences)


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


def test_equal_rows_and_a_very_long_text(spark):
    long = " ".join(f"n{i % 977}" for i in range(150_000))
    rows = [(1, "the same row")] * 300 + [(2, long), (None, None), (None, None)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, width=64).collect()
    plain = Tokenizer.from_file(BYTES)
    want = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == want and sum(r["doc_id"] == 1 for r in got) == 300
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)[:-1]]]).tolist() and sum(n for _, n in s) <= 64
