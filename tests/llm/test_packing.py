from collections import Counter

import brute
import pytest

from rampart.llm import packing, queries


def test_pieces_agree_with_brute_force(spark, sample):
    path = queries.tokenizer_path()
    for df in (brute.awkward(spark), brute.empty(spark), sample):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        out = packing.pack(df, path).collect()
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == Counter(brute.pieces(rows, path))
        assert sorted(r.sequence_id for r in out) == list(range(len(out)))
        assert all(r.offset == 0 and len(r.ids) == r.length and r.length & (r.length - 1) == 0 for r in out)
        by_id = sorted(out, key=lambda r: r.sequence_id)
        assert [r.length for r in by_id] == sorted((r.length for r in out), reverse=True)


def test_forgetting_changes_nothing(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    tok, slow = packing.WordTokenizer(path), Tokenizer.from_file(path)
    import numpy as np

    for text in ["Hello, hello WORLD's end!! 123 a1b2 'tis ’tis", "x" * 5000 + " ñandú Å", "<|startoftext|>a b<|endoftext|> c", "  q\u0085r\x0bs\x1ct"]:
        assert np.frombuffer(tok.ids(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids


def test_longest_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(brute.empty(spark), queries.tokenizer_path(), longest=1000)
    assert packing.binary_lengths(4096 + 13, 2048) == [2048, 2048, 8, 4, 1]


def test_numbers_do_not_depend_on_the_shuffle(spark, sample):
    """Repeated rows without an id and an equal text are numbered by every task that holds some."""
    df = sample.select("doc_id", "text").unionByName(spark.range(300, numPartitions=4).selectExpr("cast(null as long) as doc_id", "'one two three' as text"))
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, packing.pack(df, queries.tokenizer_path(), with_ids=False).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1] and len(set(found[0])) == len(found[0])
