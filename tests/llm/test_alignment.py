import hashlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rampart.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "héllo wörld 日本 🎉 ok\n x  ", "  lead", " ", "\n", "a▁b c d", "x <|endoftext|> <s> </s> <unk> <0x0A> y", "é", "日本語 テキスト 𝔘𝔫𝔦 𐍈",
    "tab\tx  y   z ", "it's 12'll don't", "\x00 \x1c a \x85 b", "a\u00a0b \u3000 c", "ﬁ ½ Å Å", " a", "a ", "word " * 500, "🎉🎉 🎉x‍♀️ ok", "▁", "é" * 3000,
]


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(A, B)


def plain(both, text):
    """Ids and byte ranges of the whole text's tokens, straight from the libraries."""
    if not text:
        return None
    sides = []
    for ids, side in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.sides[0]), (both.b.encode(text), both.sides[1])):
        found = [side.tokens[i] for i in ids]
        if b"".join(found) != (" " + text).encode():
            return None
        stops = np.cumsum([len(t) for t in found]).tolist()
        sides.append(list(zip(ids, [0, *stops], stops)))
    return sides


def groups_of(sides):
    a, b = sides
    out, start = [], 0
    for cut in sorted({e for *_, e in a} & {e for *_, e in b}):
        out.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in sides))
        start = cut
    return ";".join(out)


def links_of(sides):
    a, b = sides
    return [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]


def expected(both, texts):
    found = [plain(both, t) for t in texts]
    links = [links_of(f) if f else [] for f in found]
    count = Counter(p for x in links for p in x)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [
        (len(f[0]) if f else 0, len(f[1]) if f else 0, groups_of(f).count(";") + 1 if f else 0, len(x), groups_of(f) if f else "",
         sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x))
        for f, x in zip(found, links)
    ]


def test_decoded_vocabularies(both):
    a, b = both.sides
    assert a.tokens[50256] == b"<|endoftext|>" and sorted(t for t in a.tokens if len(t) == 1) == [bytes([i]) for i in range(256)]
    for i in (3, 13, 258):
        assert b.tokens[i] == bytes([i - 3])
    assert both.chunked


@pytest.mark.parametrize("text", ODD)
def test_chunks_give_the_whole_texts_groups(both, text):
    found = plain(both, text)
    assert "".join(both.text[n] for n in both.chunks([text])[0])[:-1] == (groups_of(found) if found else "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab '’é日🎉▁\u0301\u200d\n\t\x00<>0x1 ."), max_size=30))
def test_any_text(both, text):
    found = plain(both, text)
    assert "".join(both.text[n] for n in both.chunks([text])[0])[:-1] == (groups_of(found) if found else "")


def test_remembering_less_changes_nothing(both, monkeypatch):
    texts = ODD + ["one two three " * 9, "two three four"]
    want = ["".join(both.text[n] for n in x) for x in both.chunks(texts)]
    monkeypatch.setattr(alignment, "REMEMBERED", 2)
    monkeypatch.setattr(alignment, "BLOB", 3)
    assert want == ["".join(both.text[n] for n in both.chunks([t])[0]) for t in texts]


def rows_of(df):
    return sorted((repr(r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("frequent", [1 << 16, 20, 1])
def test_counts_over_all_texts(spark, both, frequent):
    """Pairs beyond the frequent ones go the other way to the same numbers."""
    texts = [t for _, t, *_ in brute.AWKWARD if not t or len(t) < 1000] + ODD[:-1]
    ids = [i % 7 if i % 5 else None for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "1 as pairs", "2 as groups", "3 as _row")
    got = alignment.align(df, A, B, frequent=frequent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    assert rows_of(got) == sorted((repr(i), *x) for i, x in zip(ids, expected(both, texts)))


def test_sample(spark, sample, both):
    rows = sample.select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in rows if r.text is None or len(r.text) < 3000][:120]
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("sha")
    got = alignment.align(spark.createDataFrame(short, "doc_id long, text string"), A, B, columns=(digest,))
    want = [
        (repr(i), *x[:4], x[5], x[6], hashlib.sha256(x[4].encode()).hexdigest() if x[4] else "")
        for (i, _), x in zip(short, expected(both, [t for _, t in short]))
    ]
    assert rows_of(got) == sorted(want)


def test_empty_table(spark):
    assert alignment.align(brute.empty(spark), A, B).count() == 0
