import corpus_pipeline
from foldloom.llm import decontaminate, ngram_join, packing, quality_rules, secret_scan
from foldloom.llm.shared import table, written

from . import brute


def test_stages_against_plain_versions(spark, small):
    docs = table(spark, small, "documents")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), name)
        if name == "pack":
            assert {r["doc_id"] for r in docs.collect()} == set(kept)
            continue
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            measured = {i: brute.quality(t) for i, t in kept.items()}
            failed = {i for i, (n, _, _, _, again) in measured.items() if n < 10 or 100 * again > 20 * n}
            assert not failed & set(got) and len(got) > 0.7 * len(kept)
            want = {i: kept[i] for i in got}
        elif name == "near_duplicates":
            groups = brute.groups({i: brute.shingles(t, 4, True) for i, t in kept.items()}, 85, 100)
            want = {i: kept[i] for i in set(groups.values())}
        elif name == "decontamination":
            items = [brute.shingles(r["text"], 5) for r in table(spark, small, "benchmark").collect()]
            want = {i: t for i, t in kept.items() if not any(s and 5 * len(s & brute.shingles(t, 5)) >= 4 * len(s) for s in items)}
        else:
            assert set(got) == set(kept) and all("token = \"" not in t or "[secret]" in t for t in got.values())
            want = got
        assert got == want
        kept = got
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, small).count() == docs.count()


GOOD = " ".join(f"{a}{b} the" for a in ("morning", "evening", "winter", "summer", "river") for b in ("light", "shade", "song", "road", "house", "field"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, secrets string, id string, length long"


def folder_of(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_nulls_repeats_clashing_columns_and_long_texts(spark, tmp_path):
    row = lambda i, t: (i, t, None, None, None if t is None else len(t), "k", "c", "s", "i", 7)
    item = "a benchmark item of nine words that stands here"
    unlike = lambda i: " ".join(f"{w}{i}" if j % 2 else w for j, w in enumerate(GOOD.split()))
    secret = "password = hunter2222"
    long = " ".join(f"the{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)} word" for i in range(60_000))
    rows = [row(None, None), row(1, None), row(2, ""), row(3, "too short"), row(4, GOOD), row(5, GOOD.replace(" ", "  ")), row(4, GOOD), row(None, unlike("x")), row(None, unlike("x"))]
    rows += [row(6, unlike("y") + " " + item), row(7, unlike("z") + " " + secret), row(8, long)] + [row(20 + i, unlike("abcdefghij"[i])) for i in range(10)]
    d = folder_of(spark, tmp_path, rows, [(1, item), (2, None), (None, "x y z u v w")])
    docs, seen = table(spark, d, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), name)
        seen[name] = docs.collect()
        assert name == "pack" or docs.columns == columns
    ids = lambda name: sorted(str(r["doc_id"]) for r in seen[name])
    stay = [str(20 + i) for i in range(10)]
    assert ids("quality") == sorted(["4", "4", "5", "6", "7", "8", "None", "None", *stay])
    assert ids("near_duplicates") == sorted(["4", "4", "6", "7", "8", "None", "None", *stay])
    assert ids("decontamination") == sorted(["4", "4", "7", "8", "None", "None", *stay]) == ids("secrets")
    by = {r["doc_id"]: r for r in seen["secrets"]}
    assert by[7]["text"] == (unlike("z") + " [secret]") and by[7]["n_chars"] == len(by[7]["text"]) and by[8]["text"] == long
    assert all((r["kept"], r["component_id"], r["secrets"], r["id"], r["length"]) == ("k", "c", "s", "i", 7) for r in seen["secrets"])
    assert sum(r["start"] == 0 for r in seen["pack"]) == len(seen["secrets"])
    assert corpus_pipeline.run(spark, d).count() == len(seen["pack"])


def test_empty_tables(spark, tmp_path):
    d = folder_of(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_every_stage_goes_through_its_operator(spark, small, monkeypatch):
    calls = []
    for module, name in ((quality_rules, "quality_filter"), (ngram_join, "ngram_join"), (decontaminate, "decontaminated"), (secret_scan, "redacted"), (packing, "packed")):
        def spy(*a, own=getattr(module, name), name=name, **b):
            calls.append(name)
            return own(*a, **b)

        monkeypatch.setattr(module, name, spy)
    docs = table(spark, small, "documents").where("doc_id < 20")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small)
    assert calls == ["quality_filter", "ngram_join", "decontaminated", "redacted", "packed"]
