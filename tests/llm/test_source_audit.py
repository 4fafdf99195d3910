"""The audit of sources against plain loops, on small tables and odd ones."""

import re
from collections import Counter, defaultdict

import pyarrow as pa

from foldloom.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n string, term string"


def plain(rows, least, ranks=50):
    rows = [(x[2] or "", x[3] or "", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x[1] or "")) for x in rows]
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = TERM.findall(text)
        docs[lang].update(set(found))
        n[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        share = lambda k, m: 1 + 10**9 * (k + 5) // (m + 5 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(n[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(b, sum(abs(p[s][t] - p[b][t]) for t in kept)) for b in sources if b != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1)]
    return sorted(out)


def got(df, **k):
    return sorted(map(tuple, source_audit.audited(df, **k).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_whole_small_table(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(None, r["text"], r["lang"], r["source"]) for r in df.select("text", "lang", "source").collect()]
    want = plain(rows, 10)
    assert any(x[2] == "term" for x in want) and got(df, least=10) == want


def test_odd_rows(spark):
    rows = [(1, "Ab ab É é x1y", "en", "a", "n", "t")] * 3 + [(None, None, None, None, None, None), (2, "", "en", "lone", "", ""), (3, "1 2 3", "en", "digits", "", ""), (4, "ab É " + "long " * 20_000, "en", "b", "", "")]
    rows += [(5, "zz " * k, "de", s, "", "") for k in (1, 2) for s in ("s", "t", "")] + [(6, "only", "fr", "one", "", "")]
    assert got(spark.createDataFrame(rows, SCHEMA), least=2) == plain(rows, 2)
    assert got(spark.createDataFrame(rows, SCHEMA), least=99) == plain(rows, 99)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_blocks_and_pairs_that_are_sent_early(spark, small, monkeypatch):
    rows = [(i, f"w{i % 7} w{'abcdefgh'[i % 5]} common", "en", f"s{i % 9}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    want = plain(rows, 5)
    for name, size in (("BLOCK_TERMS", 3), ("TASK_PAIRS", 2)):
        monkeypatch.setattr(source_audit, name, size)
        assert got(df, least=5) == want


def test_open_runs_over_batches():
    rows = [("en", "a", s, b, 1, 2) for s in ("s", "t") for b in range(4)] + [("en", "b", "s", 0, 1, 1)]
    batch = lambda r: pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*r, strict=True)], names=["lang", "term", "source", "block", "docs", "n"])
    for cut in range(1, len(rows)):
        out = [r for b in source_audit._counted(2)([batch(rows[:cut]), batch(rows[cut:])]) for r in b.to_pylist()]
        assert {(r["term"], r["whole"], r["source"], r["n"]) for r in out} == {("a", False, "s", 8), ("a", False, "t", 8), ("a", True, "", 16)}


def test_shares_of_large_counts(spark):
    df = spark.createDataFrame([(4 * 10**15, 5 * 10**15, 10**6)], "n long, total long, v long").select(source_audit._share("n").alias("p"))
    assert df.first()["p"] == 1 + 10**9 * (4 * 10**15 + 5) // (5 * 10**15 + 5 * 10**6)
