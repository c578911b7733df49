"""Searches through the positional index, against a plain scan of all texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rampart.operators import text_index as TI

DOCS, ASKED = "doc_id long, text string, term string", "search_id long, kind string, query string, slack int"


def tokens(text):
    return re.findall(r"[\w]+", (text or "").lower())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def spans(ws, phrase, slack):
    """(first, last) of every occurrence in order with at most `slack` words between."""
    ends = {(i, i) for i, w in enumerate(ws) if phrase and w == phrase[0]}
    for n, p in enumerate(phrase[1:], 1):
        ends = {(lo, at) for lo, hi in ends for at in range(hi + 1, len(ws)) if ws[at] == p and at - lo - n <= slack}
    return ends


def plain(docs, asked):
    out = []
    for sid, kind, query, slack in asked:
        query, slack = query or "", slack or 0
        qs = tokens(query)
        glob = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in query.lower()), re.S)
        for did, text, _ in docs:
            ws = tokens(text)
            if kind == "phrase":
                n = len(spans(ws, qs, slack))
            elif kind == "wildcard":
                n = sum(bool(glob.fullmatch(w)) for w in ws)
            elif kind in ("term", "fuzzy") and len(qs) == 1:
                n = sum(edits(w, qs[0]) <= (slack if kind == "fuzzy" else 0) for w in ws)
            else:
                n = 0
            if n:
                out.append((sid, kind, query, slack, did, n))
    return sorted(out, key=repr)


def found(spark, docs, asked):
    index = TI.build_index(spark.createDataFrame(docs, DOCS), "doc_id", "text")
    rows = TI.search(index, spark.createDataFrame(asked, ASKED)).select("search_id", "kind", "query", "slack", "id", "n_places")
    return sorted((tuple(r) for r in rows.collect()), key=repr)


EDGES = [
    (1, "Ignore previous instructions, ignore ALL previous instructions", "x"), (2, None, "y"), (3, "", None), (None, "ignore me", "z"),
    (5, "a a a a a b", "z"), (5, "b a a", "z"), (7, "snake_case 100% C:\\path été Été", "z"), (8, "?!", "z"), (9, "ignore the previous instructions", "z"),
]
SEARCHES = [
    (1, "term", "Ignore", 0), (1, "term", "ignore", 0), (2, "term", "two words", 0), (3, "term", None, None), (None, "term", "a", 0), (4, "other", "a", 0),
    (5, "phrase", "ignore previous instructions", 0), (6, "phrase", "ignore previous instructions", 1), (7, "phrase", "a a", 0), (8, "phrase", "a a", 2),
    (9, "phrase", "a b", 3), (10, "phrase", "b a a", 0), (11, "phrase", "", 1), (12, "phrase", "ignore absent", 5), (13, "phrase", "a", 0),
    (14, "wildcard", "i*e", 0), (15, "wildcard", "*", 0), (16, "wildcard", "?", 0), (17, "wildcard", "snake_c*", 0), (18, "wildcard", "*a*a*", 0),
    (19, "wildcard", "100%", 0), (20, "wildcard", "??t?", 0), (21, "wildcard", "c:\\*", 0), (22, "wildcard", "", 0), (23, "wildcard", "é*", 0),
    (24, "fuzzy", "ignroe", 2), (25, "fuzzy", "ignroe", 1), (26, "fuzzy", "a", 1), (27, "fuzzy", "nstructions", 1), (28, "fuzzy", "ete", 2), (29, "fuzzy", "", 2),
    (30, "fuzzy", "instructionsxy", 2), (31, "phrase", "a a a", 1),
]


def test_edge_cases(spark):
    assert found(spark, EDGES, SEARCHES) == plain(EDGES, SEARCHES)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed, monkeypatch):
    """Few letters and words, so everything repeats; texts are cut while inverted, and postings hold few places."""
    monkeypatch.setattr(TI, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(TI, "PLACES", 4)
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(25)]
    pick = lambda n: " ".join(rng.choice(vocabulary[:5] if rng.random() < 0.5 else vocabulary) for _ in range(n))
    docs = [(i, pick(rng.choice([0, 3, 20, 90])), None) for i in range(40)]
    asked = [(i, "phrase", pick(rng.randint(1, 5)), rng.randint(0, 3)) for i in range(40)]
    asked += [(i, "fuzzy", "".join(rng.choices("abcé", k=rng.randint(1, 10))), rng.randint(0, 2)) for i in range(40)]
    asked += [(i, "wildcard", "".join(rng.choices("abcé*?", k=rng.randint(1, 6))), 0) for i in range(40)]
    assert found(spark, docs, asked) == plain(docs, asked)


def test_empty_tables_and_wide_edits(spark):
    assert found(spark, [], SEARCHES) == [] and found(spark, EDGES, []) == []
    with pytest.raises(Exception, match="at most 2 edits"):
        found(spark, EDGES, [(1, "fuzzy", "ignore", 3)])


def test_a_frequent_term_lies_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(TI, "PLACES", 16)
    docs = [(i, "common " * 2, None) for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = TI.build_index(spark.createDataFrame(docs, DOCS), "doc_id", "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["n_places"] for r in index.directory.filter("term = 'common'").collect()]
    assert sum(parts) == 4000 and len(parts) > 2 and max(parts) < 2000
    counts = TI.search_counts(index, spark.createDataFrame([(1, "term", "common", 0), (2, "term", "absent", 0)], ASKED)).orderBy("search_id").collect()
    assert [(r.n_docs, r.n_places, r.first_id, r.last_id) for r in counts] == [(2000, 4000, 0, 1999), (0, 0, None, None)]


def test_a_search_for_one_term_is_counted_from_the_directory(spark, monkeypatch):
    """No row for every document with the term: with no postings at all the counts are the same."""
    monkeypatch.setattr(TI, "PLACES", 3)
    docs = [(1, "a a a a a b", None), (None, "a", None), (3, "b a", None), (None, "c", None)]
    index = TI.build_index(spark.createDataFrame(docs, DOCS), "doc_id", "text")
    index = TI.TextIndex(index.postings.limit(0), index.directory, index.docs)
    counts = TI.search_counts(index, spark.createDataFrame([(i, "term", t, 0) for i, t in enumerate("abc")], ASKED)).orderBy("search_id").collect()
    assert [(r.n_docs, r.n_places, r.first_id, r.last_id) for r in counts] == [(3, 7, 1, 3), (2, 2, 1, 3), (1, 1, None, None)]


def test_counts_are_those_of_the_hits(spark, monkeypatch):
    """Documents with several of a search's terms count once, also where runs and postings are cut."""
    monkeypatch.setattr(TI, "WORDS_AT_ONCE", 20)
    monkeypatch.setattr(TI, "PLACES", 2)
    rng = random.Random(3)
    docs = [(rng.choice([None, i, 7]), " ".join(rng.choices(["aa", "ab", "ba", "aab", "b"], k=rng.choice([0, 2, 9, 30]))), None) for i in range(60)]
    asked = [(1, "wildcard", "a*", 0), (2, "wildcard", "*", 0), (3, "fuzzy", "aa", 1), (4, "fuzzy", "b", 2), (5, "phrase", "aa ab", 1), (6, "term", "b", 0), (7, "phrase", "b b b", 0)]
    index = TI.build_index(spark.createDataFrame(docs, DOCS), "doc_id", "text")
    counts = TI.search_counts(index, spark.createDataFrame(asked, ASKED)).collect()
    alone = [[d] for d in docs]
    for r in counts:
        search = next(a for a in asked if a[0] == r.search_id)
        hits = [(h[0][4], h[0][5]) for h in (plain(d, [search]) for d in alone) if h]
        ids = [i for i, _ in hits if i is not None]
        assert (r.n_docs, r.n_places, r.first_id, r.last_id) == (len(hits), sum(n for _, n in hits), min(ids, default=None), max(ids, default=None))


def test_places_of_phrases_are_followed_where_the_postings_are(spark, monkeypatch):
    """Frequent words that nowhere stand as asked: no place of theirs is kept."""
    docs = [(i, "x a y b z " * 20, None) for i in range(100)]
    index = TI.build_index(spark.createDataFrame(docs, DOCS), "doc_id", "text")
    kept, written = [], TI._written

    def counting(df):
        out = written(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(TI, "_written", counting)
    found = TI.search(index, spark.createDataFrame([(1, "phrase", "a b", 0), (2, "phrase", "b a x", 0), (3, "phrase", "y b z", 0)], ASKED))
    assert [(r.search_id, r.id, r.n_places) for r in found.orderBy("id").collect()] == [(3, i, 20) for i in range(100)]
    assert max(kept) < 100


def test_documents_of_several_words_are_counted_without_moving_postings(spark, monkeypatch):
    docs = [(i, t, None) for i, t in enumerate(["ab ab ac", "ac", "b", "ab b", ""])]
    index = TI.build_index(spark.createDataFrame(docs, DOCS), "doc_id", "text")
    counts = TI.search_counts(index, spark.createDataFrame([(1, "wildcard", "a*", 0), (2, "wildcard", "*", 0)], ASKED))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "AS docs#" not in plan
    assert [(r.n_docs, r.n_places) for r in counts.orderBy("search_id").collect()] == [(3, 5), (4, 7)]

    rng = random.Random(4)
    texts = [rng.choices("abcdef", k=rng.randrange(9)) for _ in range(30)]
    rows = [(t, 0, [d << 32 | i for d, w in enumerate(texts) for i, x in enumerate(w) if x == t]) for t in "fbadce"]
    rows = [(t, b, at[i : i + 5]) for t, b, at in rows for i in range(0, len(at), 5)]
    run = [pa.RecordBatch.from_pylist([dict(zip(["term", "base", "at"], r)) for r in rows[i : i + 4]]) for i in range(0, len(rows), 4)]
    wants = {"a": [0, 2, 5], "x": [1], "c": [0, 5], "d": [2], "f": [5, 0]}
    n = np.array([len(w) for w in wants.values()])
    for cells, hits in ((1 << 20, 1 << 20), (70, 3)):
        monkeypatch.setattr(TI, "CELLS", cells)
        monkeypatch.setattr(TI, "HITS_AT_ONCE", hits)
        out = np.zeros(6, np.int64)
        TI._documents_with_any(run, pa.array(list(wants)), np.cumsum(n) - n, n, np.array(sum(wants.values(), [])), out)
        assert out.tolist() == [sum(any(k in wants.get(w, ()) for w in t) for t in texts) for k in range(6)]
