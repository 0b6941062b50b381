"""The pipeline's stages on one table, each against its own operator's brute force or rule."""

import re

import corpus_pipeline
from larder.llm import decontaminate, neardup

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    start, language, unique, clean, cleared, packed = seen
    assert all(d.columns == columns for d in seen[:-1])
    assert language.count() > 0.97 * start.count()
    lowest = {r.component_id for r in neardup.near_duplicates(language).collect()}
    assert {r.doc_id for r in unique.collect()} == lowest and unique.count() == len(lowest)
    leaking = {r.id for r in decontaminate.find_leaks(unique, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == lowest - leaking
    before, after = ({r.doc_id: r for r in d.collect()} for d in (clean, cleared))
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert r.n_chars == len(r.text) and not re.search(r'token = "[0-9a-f]{40}"|AKIA[0-9A-Z]{16}', r.text)
        assert r.text == before[d].text or "[" in r.text
    assert {r.doc_id for r in packed.collect()} == set(after)
    whole = corpus_pipeline.run(spark, FOLDER)
    key = lambda df: sorted((r.doc_id, r.piece, r.n_words) for r in df.collect())
    assert key(whole) == key(packed)
