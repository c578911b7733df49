from collections import Counter

import brute

import corpus_pipeline
from rampart.llm import queries
from rampart.llm.common import written


def test_stages_against_brute_force(spark, sample, sf):
    docs, columns = sample, sample.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_copies", "near_copies", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, sf))
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert all(after[i] == before[i] for i in after)
        if name == "language":
            und = {i for i, r in before.items() if not any(c.isalpha() for c in r.text or "")}
            assert set(before) - set(after) == und
        if name == "exact_copies":
            last = {}
            for i, r in before.items():
                t = r.text.encode().lower()
                last[t] = max(last.get(t, i), i)
            assert set(after) == set(last.values())
        if name == "near_copies":
            rows = [(i, r.text) for i, r in before.items()]
            assert set(after) == {min(rows[k][0] for k in group) for group in brute.resembling(rows).values()}
        if name == "mixing":
            assert 0.7 < sum(len(r.text.split()) for r in after.values()) / sum(len(r.text.split()) for r in before.values()) < 0.9
    rows = [(r.doc_id, r.text) for r in after.values()]
    got = docs.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == Counter(brute.pieces(rows, queries.tokenizer_path()))
    assert sum(len(r.ids) for r in got) == sum(r.length for r in got)
    run = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in run.collect()) == Counter((r.doc_id, r.start, r.ids_crc32) for r in got)


def test_awkward_and_empty_documents(spark, sf):
    for df in (brute.awkward(spark), brute.empty(spark)):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, sf))
            assert docs.columns == df.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert len({r.doc_id for r in out}) == docs.select("doc_id").distinct().count()
