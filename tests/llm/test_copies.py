from collections import Counter

import brute
from pyspark.sql import functions as F

from rampart.llm import copies


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check(df, out):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out)
    assert got == Counter(brute.exact_copies(rows_of(df)))
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) <= {1} and len(kept) == len({r.text_sha256 for r in out})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_copies_agree_with_brute_force(spark, sample):
    for df in (brute.awkward(spark), brute.empty(spark), sample):
        check(df, copies.copies(df, keep="largest").collect())


def test_collisions_do_not_join_texts(spark, sample):
    weak = lambda norm: F.unhex(F.substring(F.md5(norm), 1, 2))
    for df in (brute.awkward(spark), sample):
        check(df, copies.copies(df, keep="largest", hash_of=weak).collect())


def test_smallest_id_stays_by_default(spark):
    out = copies.copies(brute.awkward(spark)).filter("kept").collect()
    assert {r.doc_id for r in out} == {1, 4, 6, 7, 8, 9, None}


def test_drop_copies_keeps_rows_whole(spark, sample):
    df = brute.awkward(spark)
    for keep, want in (("largest", [None, 3, 5, 6, 7, 8, 9]), ("smallest", [None, 1, 4, 6, 7, 8, 9])):
        out = copies.drop_copies(df, keep)
        assert out.columns == df.columns
        assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is not None, x or 0)) == want
    assert copies.drop_copies(brute.empty(spark)).count() == 0
    kept = copies.copies(sample, "largest").filter("kept")
    assert sorted(r.doc_id for r in copies.drop_copies(sample, "largest").collect()) == sorted(r.doc_id for r in kept.collect())
