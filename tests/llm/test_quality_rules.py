import random
from collections import Counter

import brute

from rampart.llm import rules


def measure(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered),
    )


def test_measurements_agree_with_brute_force(spark, sample):
    for df in (brute.awkward(spark), brute.empty(spark), sample):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = Counter((r.doc_id, *(r[n] for n in rules.NUMBERS)) for r in rules.ledger(df).collect())
        assert got == Counter((i, *measure(t)) for i, t in rows)


def test_repeated_words_of_random_texts():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice("ab") for _ in range(rng.randrange(60))]
        assert rules.measure(" ".join(words).encode())[5] == measure(" ".join(words))[5]


def test_colliding_window_hashes_are_told_apart(monkeypatch):
    words = [b"%d" % (i % 13) for i in range(40)] + [b"x"] * 3
    want = rules.repeated_words(words)
    monkeypatch.setattr(rules, "_MIX", rules.np.uint64(0))
    assert rules.repeated_words(words) == want == measure(" ".join(w.decode() for w in words))[5]


def test_ablations_agree_with_the_ledger(spark, sample):
    led = rules.ledger(sample.unionByName(brute.awkward(spark).select(*sample.columns)))
    bits = [r.fail_bits for r in led.collect()]
    for r in rules.ablations(led).collect():
        names = [n for n in rules.POLICIES[r.policy] if n != r["without"]]
        assert r.total == len(bits) and r.kept == sum(b & rules.mask(tuple(names)) == 0 for b in bits)
    assert rules.ablations(rules.ledger(brute.empty(spark))).count() == 0
