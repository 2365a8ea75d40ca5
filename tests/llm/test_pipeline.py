"""The pipeline: what each stage drops, against brute force, and odd documents."""

import corpus_pipeline
from rodlake.llm import decontaminate, simhash
from rodlake.llm.common import save


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    before, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = save(stage(spark, before, tables), name)
        if k < 4:
            assert after.columns == docs.columns and after.exceptAll(before).count() == 0
        seen[name] = {r.doc_id for r in after.collect()}
        before = after
    text = {r.doc_id: r.text for r in docs.collect()}
    lettered = {d for d, t in text.items() if t and any(c.isalpha() for c in t)}
    assert seen["language_id"] == lettered
    gone = {r.doc_id for r in decontaminate.contamination_report(docs, spark.read.parquet(f"{tables}/benchmark.parquet")).where("contaminated").collect()}
    assert seen["benchmark_decontamination"] == seen["simhash_near_dedup"] - gone
    sets = {d: set(simhash.shingles(text[d].encode(), 5)) for d in seen["simhash_near_dedup"]}
    kept = sorted(sets)
    assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for i, a in enumerate(kept) for b in kept[:i])
    rows = before.collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and seen["sharding"] == seen["mixing"]
    assert all(r.text == text[r.doc_id] for r in rows)


def test_odd_documents(spark, tmp_path, tables):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "words here " * 9, None, "a", 9), (None, "other words there " * 9, "en", None, 9), (4, "999", "en", "a", 3), (3, "words here " * 9, None, "a", 9)]
    for n, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{tmp_path}/{n}/{t}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{n}").collect()
        assert sorted(str(r.doc_id) for r in got) == (["3", "None"] if data else [])


def test_clashing_columns_survive(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for c in ("lang_pred", "label", "_label", "k0", "s", "t", "c1", "hits", "gone", "_key", "copies", "gone_doc"):
        docs = docs.selectExpr("*", f"concat('{c}', doc_id) as `{c}`")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, tables)
        assert after.columns == docs.columns and after.count() > 100 and after.exceptAll(docs).count() == 0
    docs = docs.selectExpr("*", "'mine' as slot", "'row' as row")
    out = corpus_pipeline.STAGES[4][1](spark, docs, tables)
    kept = [c for c in docs.columns if c != "slot"]
    assert out.columns == [*kept, "size", "text_crc32", "shard", "slot"] and out.select(*kept).exceptAll(docs.select(*kept)).count() == 0 and out.count() == 200
