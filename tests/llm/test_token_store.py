import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldloom.llm import token_store as ts
from foldloom.llm.shared import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
NUMBER = st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 1 << 16), st.integers(0, (1 << 64) - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(NUMBER, max_size=300), st.integers(1, 130))
def test_coding(values, block):
    v = np.array(values, dtype=np.uint64)
    words, starts, sizes = ts.encode(v, block)
    assert sizes.sum() == len(v) and (ts.decode(words, len(v)) == v).all()
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        end = int(starts[i + 1]) if i + 1 < len(starts) else len(words)
        assert (ts.decode(words[a:end], n) == v[i * block : i * block + n]).all()


def test_small_ids_take_little_room():
    assert len(ts.encode(np.zeros(1200, np.uint64))[0]) == 10
    assert len(ts.encode(np.full(3000, 40_000, np.uint64))[0]) == 1000


def test_files_read_back(spark):
    texts = ["Words in UPPER and lower", "", None, "a" * 5000, "x y z " * 3000, "tie", "tie"]
    rows = [(7 * i - 9, t, 0) for i, t in enumerate(texts)] + [(None, "no key", 0), (5, "again", 1)]
    folder = new_path(spark, "ids-test")
    assert ts.write(spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4), folder, PATH, parts=3) == len(rows)
    got = sorted((tuple(r) for r in ts.read(spark, folder).collect()), key=lambda r: r[1])
    plain, at = Tokenizer.from_file(PATH), 0
    for (k, text, _), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert r == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_table(spark):
    folder = new_path(spark, "ids-test")
    assert ts.write(spark.createDataFrame([], "doc_id long, text string"), folder, PATH) == 0


def test_files_roll_over_and_are_read_in_blocks(spark):
    """Files of a few hundred bytes, null keys, rows that repeat a key, and a text of many blocks."""
    rows = [(None, f"no key {i}") for i in range(40)] + [(3, f"again {i % 5}") for i in range(60)] + [(i, f"text number {i}") for i in range(100, 140)] + [(500, "ab cd " * 20_000)]
    folder = new_path(spark, "ids-test")
    assert ts.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, parts=4, file_bytes=300) == len(rows)
    names = sorted(r["name"] for r in ts.file_names(spark, folder, "*.ids").collect())
    assert len({n.split("-")[1] for n in names}) > 2
    got = sorted(tuple(r)[1:] + (r["doc_id"],) for r in ts.read(spark, folder).collect())
    assert [g[0] for g in got] == np.cumsum([0, *[g[1] for g in got[:-1]]]).tolist()
    keys = [g[-1] for g in got]
    assert keys[:40] == [None] * 40 and keys[40:] == sorted(r[0] for r in rows[40:])
    plain = Tokenizer.from_file(PATH)
    crc = lambda t: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(g[-1]), g[2]) for g in got) == sorted((str(k), crc(t)) for k, t in rows)


def test_a_task_rolls_over(spark):
    rows = [(i, f"text number {i} " * 250) for i in range(3000)]  # over 12 MB: a file closes at slices of 4 MB of text
    folder = new_path(spark, "ids-test")
    assert ts.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), folder, PATH, parts=1, file_bytes=20_000) == 3000
    names = sorted(r["name"] for r in ts.file_names(spark, folder, "*.ids").collect())
    got = ts.read(spark, folder).orderBy("start").collect()
    assert len({n.split("-")[1] for n in names}) == 1 and len(names) > 1  # of one task
    assert [r["doc_id"] for r in got] == list(range(3000))


def test_not_a_file_of_ids():
    with pytest.raises(ValueError, match="not a file"):
        ts.File(pa.BufferReader(b"x" * 100))
