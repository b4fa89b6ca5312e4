"""The pipeline, stage by stage, against brute force on a small corpus."""

import random

import corpus_pipeline
from test_llm import aligned, brute_spans, prose


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    texts = [prose(rng, rng.randint(40, 90)).capitalize() + "." for _ in range(160)]
    junk = set(range(0, 160, 8))
    for i in junk:
        texts[i] = texts[i].upper().replace(" ", "!! ")
    items = [prose(rng, 30) for _ in range(4)]
    texts[5] = texts[5] + " " + items[1]
    copies = {11: 3, 13: 3, 21: 19}
    for a, b in copies.items():
        w = texts[b].split()
        w[-1] = f"end{a}"
        texts[a] = " ".join(w)
    texts[31] += " password=abcdefghijklmnop"
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r for r in now.collect()}
    good = set(range(160)) - junk
    assert len(good ^ set(left["quality_classifier"])) <= 2
    stay = {i for i in left["quality_classifier"] if not any(j < i and aligned(texts[i], texts[j]) >= 0.8 for j in left["quality_classifier"])}
    assert set(left["minhash_near_dedup"]) == stay and not set(copies) & stay
    assert set(left["benchmark_decontamination"]) == stay - {5}
    final = left["secret_scans"]
    assert set(final) == stay - {5} and not any(brute_spans(r.text) for r in final.values())
    assert all(r.text == texts[i] for i, r in final.items() if not brute_spans(texts[i])) and final[31].n_chars == len(final[31].text)
    assert set(left["best_fit_packing"]) == set(final)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_stages_on_odd_inputs(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, an empty table, a column whose name clashes."""
    rng = random.Random(3)
    good = prose(rng, 60)
    rows = [(1, good, None, None, 5, "x"), (1, good, None, None, 5, "x"), (2, None, "en", "s", None, None), (3, "", "en", "s", 0, "y"), (None, "a b", None, "s", 3, "z"), (None, None, None, None, None, None), (4, "password=abcdefghijklmnop", "en", None, None, "w")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, Text string"
    spark.createDataFrame([(i, 1, 0) for i in range(1, 5)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(rng, 30)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            assert out.columns == docs.columns and len(got) == n, name
            if name == "secret_scans" and n:
                text = {r[0]: r[1] for r in got}
                assert text[4] == "[SECRET]" and text[1] == good and text[2] is None and {r[4] for r in got if r[0] == 4} == {8}
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(pieces) == n and all(r.length >= 1 for r in pieces)
