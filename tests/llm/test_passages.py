import random

import brute
import numpy as np
import pyarrow as pa

from rampart.llm import passages


def planted(seed=7):
    """Documents of random words; some hold a passage of 60 words, whole or with a few words
    changed, put in or left out.  Returns rows, and the ids of each passage."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, holders, doc = [], [], 0
    for _ in range(8):
        passage, ids = words(60), []
        for copy in range(5):
            line = list(passage)
            if copy >= 3:
                line[rng.randrange(10, 25)] = "changed"
                del line[rng.randrange(30, 35)]
                line.insert(rng.randrange(40, 50), "new")
            text = words(rng.randrange(0, 200)) + line + words(rng.randrange(0, 200))
            rows.append((doc, " ".join(text)))
            ids.append(doc)
            doc += 1
        holders.append(ids)
    for _ in range(30):
        rows.append((doc, " ".join(words(rng.randrange(0, 400)))))
        doc += 1
    return rows, holders


def test_planted_passages_are_found_and_nothing_else(spark):
    rows, holders = planted()
    text = {i: t.split() for i, t in rows}
    out = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = {(r.ref_doc_id, r.doc_id) for r in out}
    for ids in holders:
        assert {(ids[0], i) for i in ids[1:]} <= seen
    of = {i: n for n, ids in enumerate(holders) for i in ids}
    assert all(of.get(a, -1) == of.get(b, -2) for a, b in seen)
    for r in out:
        x, y = text[r.doc_id][r.start_word : r.end_word], text[r.ref_doc_id][r.ref_start : r.ref_end]
        assert len(x) == r.end_word - r.start_word >= 40 and len(y) == r.ref_end - r.ref_start >= 40
        assert x[0] == y[0] and x[-1] == y[-1] and 0.8 <= r.identity <= 1
        assert len(set(x) & set(y)) >= 0.8 * len(set(x))
        assert (x == y) == (r.identity == 1)


def test_long_common_runs_of_the_sample_are_linked(spark, sample):
    rows = [(r.doc_id, r.text.lower().split()) for r in sample.collect()]
    at = {}
    for i, w in rows:
        for p in range(len(w) - 49):
            at.setdefault(tuple(w[p : p + 50]), set()).add(i)
    want = {frozenset((min(ids), i)) for ids in at.values() for i in ids if i != min(ids)}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for r in passages.passages(sample).collect():
        parent[root(r.doc_id)] = root(r.ref_doc_id)
    assert want and all(len({root(i) for i in pair}) == 1 for pair in want)


def test_awkward_rows(spark):
    assert passages.passages(brute.empty(spark)).count() == 0
    long = " ".join(map(str, range(100)))
    rows = brute.AWKWARD + [(i, long, "en", "a", 0) for i in (30, 31, 31, 32, None)]
    df = spark.createDataFrame(rows, brute.SCHEMA).selectExpr("*", "1 as ref", "2 as h", "3 as words")
    out = sorted(tuple(r) for r in passages.passages(df).collect())
    assert out == [(i, 0, 100, 30, 0, 100, 100, 1.0) for i in (31, 32)]


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = ("Über  die\tBrücke\n" * 50 + "x" * 300 + " end ").encode()
    want = passages.word_hashes(text)
    words = text.lower().split()
    assert len(want) == len(words) and len(set(want.tolist())) == len(set(words))
    for size in (1, 7, 64):
        monkeypatch.setattr(passages, "BLOCK", size)
        assert (passages.word_hashes(text) == want).all()


def brute_score(a, b, cost):
    best = []
    for j in range(len(a)):
        links = [best[i] + cost * (a[i] + b[i]) for i in range(j) if a[i] < a[j] and b[i] < b[j]]
        best.append(1 + max(0, max(links, default=-1) - cost * (a[j] + b[j])))
    return max(best)


def test_chains_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 25))
        ties = sorted({(int(x), int(y)) for x, y in rng.integers(0, 30, (n, 2))})
        a, b = (np.array(c) for c in zip(*ties))
        found = passages.chains(a, b, 10**6)
        assert sorted(i for line in found for i in line) == list(range(len(a)))
        scores = []
        for line in found:
            assert (np.diff(a[line]) > 0).all() and (np.diff(b[line]) > 0).all()
            scores.append(len(line) - 0.01 * (a[line[-1]] - a[line[0]] + b[line[-1]] - b[line[0]]))
        assert abs(max(scores) - brute_score(a, b, 0.01)) < 1e-9


def test_chains_are_cut_at_gaps():
    a = np.array([0, 5, 10, 60, 65])
    assert [x.tolist() for x in passages.chains(a, a, 32)] == [[0, 1, 2], [3, 4]]


def test_passages_put_together_from_earlier_documents_are_found(spark):
    """Two documents share 55 words whose halves stand in two earlier ones, each under the least length."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(0, 160, 4):
        first, second = words(28), words(27)
        for n, part in enumerate((first, second, first + second, first + second)):
            rows.append((i + n, " ".join(words(30) + part + words(30))))
        want.add((i + 3, i + 2, 30, 85, 30, 85, 55))
    exact = words(40)  # a run of no more than the least length, its parts elsewhere too
    for n, part in enumerate((exact[:14], exact[14:28], exact[28:], exact[7:21], exact[21:35], exact, exact)):
        rows.append((200 + n, " ".join(words(20) + part + words(20))))
    want.add((206, 205, 20, 60, 20, 60, 40))
    out = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.ref_doc_id, r.start_word, r.end_word, r.ref_start, r.ref_end, r.matched_words) for r in out} == want


def test_exact_runs_survive_a_gap_and_a_short_anchor():
    """55 equal words, 27 against 30 others with frequent words in common, 10 equal words."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        exact, anchor = rng.integers(1000, 10**6, 55), rng.integers(1000, 10**6, 10)
        other = lambda n: np.where(rng.random(n) < 1 / 3, rng.integers(0, 3, n), rng.integers(1000, 10**6, n))
        x, y = (np.concatenate((other(20), exact, other(n), anchor, other(20))) for n in (27, 30))
        a = np.array([20, 40, 70, 20 + 55 + 27])
        found = passages.align(x, y, a, a + [0, 0, 0, 3], 5, 40, 0.8)
        assert any(s <= 20 and e >= 75 and s2 <= 20 and e2 >= 75 for s, e, s2, e2, _ in found)
        assert all(min(e - s, e2 - s2) >= 40 and n >= 0.8 * max(e - s, e2 - s2) for s, e, s2, e2, n in found)


def test_parts_are_the_longest_stretches():
    rng = np.random.default_rng(6)
    for _ in range(300):
        s, t = (np.cumsum(rng.choice([1, 1, 1, 2, 4], 40)) for _ in "st")
        found = passages.parts(s, t, 12, 0.8)
        good = [
            (min(s[j] - s[i], t[j] - t[i]) + 1, i, j) for i in range(40) for j in range(i, 40)
            if min(s[j] - s[i], t[j] - t[i]) + 1 >= 12 and j - i + 1 >= 0.8 * (max(s[j] - s[i], t[j] - t[i]) + 1)
        ]
        assert bool(found) == bool(good)
        if good:
            assert max(min(s[j] - s[i], t[j] - t[i]) + 1 for i, j in found) == max(good)[0]
            assert all(any(i <= q and p <= j for p, q in found) for _, i, j in good)  # nothing more fits beside them


def test_rows_are_hashed_together_as_alone():
    texts = ["", "a b", None, " A  b\tc d e ", "x", "f g h i j k l m n o p q r s t u v w x y z"] * 3
    column = pa.array(["cut", *texts], pa.string()).slice(1)
    words, edges = passages.hashed(column)
    h, at, starts, seed = passages.seeds(words, edges, 5, 6)
    assert [words[s:e].tolist() for s, e in zip(edges, edges[1:])] == [passages.word_hashes((t or "").encode()).tolist() for t in texts]
    for i, (s, e) in enumerate(zip(edges, edges[1:])):
        grams = passages.grams(words[s:e], 5)
        want = [w + int(grams[w : w + 6].argmin()) for w in range(max(len(grams) - 5, min(len(grams), 1)))]
        mine = (at >= s) & (at < e)
        assert sorted(at[mine] - s) == sorted(set(want)) and set(h[mine].view(np.uint64)) == {grams[w] for w in want}
        if len(grams) >= 6:
            whole = (starts >= s) & (starts < e)
            assert (starts[whole] - s).tolist() == list(range(len(grams) - 5)) and (at[seed[whole]] - s).tolist() == want


def test_ties_in_order_are_chained_without_the_tree(monkeypatch):
    """Pairs of documents together give what each gives alone; only pairs out of order go through the tree."""
    rng, rows, calls, tree = np.random.default_rng(4), [], [], passages._tree
    monkeypatch.setattr(passages, "_tree", lambda a, *more: calls.append(len(a)) or tree(a, *more))
    for doc in range(200):
        a = np.sort(rng.choice(400, 12, replace=False))
        b = rng.permutation(a) if doc % 10 == 0 else a + doc
        rows += [(doc, doc // 3, x, y) for x, y in zip(a, b)]
    doc, ref, a, b = np.array(rows).T
    for fewest in (1, 2, 3):
        order, edges = passages.lined_up(doc, ref, a, b, 32, fewest)
        found = sorted((doc[i[0]], *a[i], *b[i]) for i in np.split(order, edges[1:-1]))
        alone = [(d, *a[doc == d][i], *b[doc == d][i]) for d in range(200) for i in passages.chains(a[doc == d], b[doc == d], 32) if len(i) >= fewest]
        assert found == sorted(alone)
    assert set(calls) == {12} and len(calls) == 3 * (20 + 20)


def test_straight_chains_are_compared_as_by_align():
    rng = np.random.default_rng(8)
    sides, xs, ys, a, b, n, want = ([], []), [0], [0], [], [], [], []
    for _ in range(600):
        x = rng.integers(0, 10**6, int(rng.integers(30, 180)))
        y = np.where(rng.random(len(x)) < rng.choice([0, 0.1, 0.3]), rng.integers(0, 3, len(x)), x)
        p = int(rng.integers(0, len(x) - 12))
        size = int(rng.integers(5, min(len(x) - p, 90) + 1))
        y[p : p + 5] = x[p : p + 5]
        y[p + size - 5 : p + size] = x[p + size - 5 : p + size]
        gone = int(rng.integers(0, min(p, 20) + 1))
        y = y[gone:]
        anchors = np.array([p, p + size - 5][: 2 if size > 5 else 1])
        sides[0].append(x), sides[1].append(y), a.append(p), b.append(p - gone), n.append(size)
        xs.append(xs[-1] + len(x)), ys.append(ys[-1] + len(y))
        want.append(passages.align(x, y, anchors, anchors - gone, 5, 40, 0.8))
    x, y = map(np.concatenate, sides)
    xs, ys = (np.array((at[:-1], at[1:])) for at in (xs, ys))
    spans, sure = passages.straight(x, y, xs, ys, *map(np.array, (a, b, n)), 40, 0.8)
    for i, found in enumerate(want):
        assert sure[i] < 0 or found == [tuple(spans[:, i].tolist())] * sure[i]
    assert all((sure == s).sum() > 20 for s in (-1, 0, 1))


def test_texts_under_one_id_are_compared_as_far_as_they_reach(spark):
    word = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(word)), (2, " ".join(word[100:])), (2, " ".join(word[150:210])), (2, "a b c")]
    out = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = {(r.doc_id, r.ref_doc_id, r.start_word, r.end_word, r.ref_start, r.ref_end, r.matched_words) for r in out}
    assert {(2, 1, 0, 200, 100, 300, 200), (2, 1, 0, 60, 150, 210, 60)} <= seen
