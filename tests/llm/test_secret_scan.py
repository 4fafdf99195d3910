import base64
import math
import random
import re
import string

import pytest

from foldloom.llm import secret_scan as s


def scan(spark, texts, **kw):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in s.scanned(rows, ["doc_id"], **kw).withColumn("spans", s.spans_text(s.F.col("secrets"))).collect()}


def test_base_spans(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    texts = [None, "", "my password = hunter22", "Secret: token: abcdefgh", 'API_KEY="abc" passwd:x', f"é {key} AKIASHORT", "0" * 24 + "g" + "f" * 23, "toKen=" + "ab" * 12, "ſecret=abcdefgh"]
    got = scan(spark, texts)
    assert [got[i]["spans"] for i in range(len(texts))] == ["", "", "assign:3:22", "", "", "access:2:22", "hex:0:24", "assign:0:30,hex:6:30", ""]
    assert [(got[7][f"n_{k}"]) for k in ("assign", "access", "hex")] == [1, 0, 1]
    assert got[0]["base_sha256"] == got[1]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_random_strings_are_found_and_words_are_not(spark):
    r = random.Random(5)
    pool = string.ascii_letters + string.digits
    keys = ["".join(r.choice(pool) for _ in range(n)) for n in (32, 40, 64) for _ in range(10)]
    words = ["internationalisationandmore", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789012345678901234567", "thisIsAnIdentifierOfSomeKind", "SCREAMING_IDENTIFIER_OF_KIND"]
    texts = [f"look at {k} here" for k in keys] + [f"look at {w} here" for w in words for _ in range(20)]
    got = scan(spark, texts)
    assert sum("random:" in got[i]["spans"] for i in range(30)) >= 28
    assert not any("random:" in got[i]["spans"] for i in range(30, len(texts)))


def test_battery_orders_strings_by_how_random_they_look():
    assert s.battery("q7Zk2LmXw9TbR4vNc8Hd")[1] < 1e-4 < s.battery("thequickbrownfoxjumps")[1]
    assert s.battery("")[1] == 1.0 and s.battery("=" * 30)[1] == 1.0


def test_more_tests_of_chance_raise_the_threshold():
    few = s.thresholds({(5, 80): 1, (5, 0): 10})
    many = s.thresholds({(5, 80): 1, (5, 0): 100_000})
    assert few[5] <= 80 and many.get(5, s.BINS) > 80
    assert s.thresholds({}) == {}


def test_redaction_merges_spans_and_keeps_columns(spark):
    assert s.redact("abcdef", [(1, 3), (2, 4), (5, 6)]) == "a[secret]e[secret]"
    rows = [(1, "x password=abcdefgh y", "spans", 21), (2, None, None, None), (2, "clean", "c", 5), (2, "clean", "c", 5)]
    got = s.redacted(spark.createDataFrame(rows, "doc_id long, text string, secrets string, n_chars long"), length="n_chars")
    assert got.columns == ["doc_id", "text", "secrets", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "x [secret] y", "spans", 12), *rows[1:]], key=str)


def test_empty_table(spark):
    assert s.scanned(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_a_long_text_of_many_spans(spark):
    text = " ".join(f"token={i:08d}" for i in range(20_000))
    assert scan(spark, [text])[0]["n_assign"] == 20_000


def test_what_base_spans_leave_of_a_run_is_tested(spark):
    r = random.Random(7)
    pool = string.ascii_letters + string.digits
    make = lambda: "".join(r.choice(pool) for _ in range(40))
    access, hexid = "AKIA" + "A1B2C3D4E5F6G7H8", "0123456789abcdef01234567"
    texts = [f"at {access}/{make()} x" for _ in range(5)] + [f"at /{hexid}/{make()} x" for _ in range(5)] + [f"at {make()}/{access}+{make()} x" for _ in range(5)]
    got = scan(spark, texts + ["plain internationalisationandmore text"] * 20)
    for i in range(5):
        assert f"access:3:23,random:23:{len(texts[i]) - 2}" == got[i]["spans"]
        assert f"hex:4:28,random:28:{len(texts[5 + i]) - 2}" == got[5 + i]["spans"]
        assert f"random:3:44,access:44:64,random:64:{len(texts[10 + i]) - 2}" == got[10 + i]["spans"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(len(t) < 50 and not set(t.split()) & set(texts[i].split()) - {"at", "x"} for i, t in s.redacted(docs).select("doc_id", "text").collect())


def test_stretches_left_of_a_run():
    text = "a" * 20 + "AKIA" + "B" * 16 + "-" + "c" * 19 + " " + "d" * 25
    spans = lambda base: [x[:2] for x in s.candidates(text, base)]
    assert spans([]) == [(0, 60), (61, 86)]
    assert spans([(20, 40, 1)]) == [(0, 20), (40, 60), (61, 86)]
    assert spans([(20, 40, 1), (22, 30, 2), (39, 41, 2)]) == [(0, 20), (61, 86)]
    assert spans([(50, 66, 0)]) == [(0, 50), (66, 86)] and spans([(0, 86, 0), (3, 4, 2)]) == []


def words_of(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("text").collect()
    return [w for r in rows for w in re.findall("[A-Za-z]{2,}", r["text"] or "")]


@pytest.mark.parametrize("length", [24, 40, 200, 3000])
def test_structured_text_passes_no_more_often_than_stated(spark, small, length):
    r, words = random.Random(length), words_of(spark, small)
    styles = [str.lower, str.upper, str.capitalize, lambda w: w.lower() + "_", lambda w: w.upper() + "_", lambda w: w.lower() + "/", lambda w: w.lower() + "-", lambda w: w.lower() + str(r.choice([1, 2, 10, 2024]))]
    hits = runs = 0
    for style in styles:
        for _ in range(200 if length < 1000 else 20):
            run = ""
            while len(run) < length:
                run += style(r.choice(words))
            hits += s.battery(run[:length])[1] <= s.ALPHA
            runs += 1
    assert hits <= 1.5 * s.ALPHA * runs


def test_long_regular_runs_are_structured():
    text = base64.b64encode(b"some text of a few words " * 40_000).decode()
    for run in ("-" * 70_000, "_" * 1_000_000, "thequickbrownfoxjumpsoverthelazydog" * 2000, "ab" * 300_000, "0123456789" * 500, text, text[:2000]):
        assert s.battery(run)[1] == 1.0
    r = random.Random(1)
    assert s.battery("".join(r.choice(string.ascii_letters + string.digits) for _ in range(100_000)))[1] < 1e-100


def test_long_runs_take_nothing_from_others(spark):
    r = random.Random(11)
    pool = string.ascii_letters + string.digits
    keys = ["".join(r.choice(pool) for _ in range(40)) for _ in range(60)]
    texts = keys + [f"{w}isationsandmorewords" for w in ("internal", "organ", "local") for _ in range(30)]
    found = lambda own: [x["spans"] for _, x in sorted(scan(spark, own).items())][: len(texts)]
    alone = found(texts)
    assert sum(x != "" for x in alone[:60]) >= 55 and not any(alone[60:])
    long = ["-" * 70_000, "_" * 5000, "thequickbrownfoxjumpsoverthelazydog" * 2000]
    both = scan(spark, texts + long)
    assert [both[i]["spans"] for i in range(len(texts))] == alone and not any(both[len(texts) + i]["spans"] for i in range(3))
    assert s.thresholds({(5, 200): 1000, (5, 0): 9000, (16, 0): 1}) == s.thresholds({(5, 200): 1000, (5, 0): 9001}) | {16: 200}


def test_nothing_above_alpha_passes():
    assert all(math.exp(-b / s.STEPS) <= s.ALPHA for b in s.thresholds({(c, 400): 50 for c in range(4, 20)} | {(4, 0): 1}).values())


@pytest.mark.parametrize("name", ["hex", "HEX", "lower", "upper", "base36", "BASE36", "base62", "base64", "base64url"])
def test_random_characters_of_each_encoding_are_told(name):
    r = random.Random(name)
    told = [s.battery("".join(r.choice(s.ENCODINGS[name]) for _ in range(64)))[1] <= s.ALPHA for _ in range(200)]
    assert sum(told) >= 0.9 * len(told)


def test_decimals_need_a_hundred_characters():
    r = random.Random(3)
    rate = lambda n: sum(s.battery("".join(r.choice(string.digits) for _ in range(n)))[1] <= s.ALPHA for _ in range(200)) / 200
    assert rate(128) >= 0.9 and rate(40) < 0.5


def test_groups_of_digits_count_without_their_separators():
    groups = "0f1e2d3c-4b5a-6978-8796-a5b4c3d2e1f0"
    assert s.battery(groups) == s.battery(groups.replace("-", "")) and s.battery(groups)[0] == "hex"
    assert s.battery("12-a2024-b7-c100-d12-e2024-f1")[0] == "base64url"  # short groups are versions and numbers


@pytest.mark.parametrize("length", [24, 40, 64, 200, 3000])
def test_structured_text_of_narrow_alphabets_passes_seldom(spark, small, length):
    r, words = random.Random(length), [w.lower() for w in words_of(spark, small)]
    hexed = [w for w in words if set(w) <= set("abcdef")] or ["face", "added", "bed"]
    number = lambda: str(r.choice([1, 2, 10, 2024, r.randrange(1000)]))
    makes = [lambda: r.choice(words), lambda: r.choice(words).upper(), lambda: r.choice(words) + number(), lambda: r.choice(words).upper() + number(), lambda: r.choice(hexed) + number(), lambda: r.choice(hexed).upper() + number(), number, lambda: f"{1990 + r.randrange(40)}{r.randrange(1, 13):02d}{r.randrange(1, 29):02d}"]
    hits = runs = 0
    for make in makes:
        for _ in range(200 if length < 1000 else 20):
            run = ""
            while len(run) < length:
                run += make()
            hits += s.battery(run[:length])[1] <= s.ALPHA
            runs += 1
    assert hits <= s.ALPHA * runs
