import hashlib
import random
import zlib

from rampart.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def trunc(c, n):
    """The remainder with the sign of c, as SQL has it."""
    return c - n * int(c / n)


def plain(rows, among=100, heads=6):
    """Every node by listing all prefixes of all rebuilt conversations."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    for c, turns in convs.items():
        convs[c] = [t[1:] for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))]
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(convs.get(c - trunc(c, among), [])[:h] + turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in below)]
        ends = ",".join(str(c) for c in sorted(ids) if built[c] == node)
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(x) == len(node) + 1 for x in below), len(childless),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in tries.conversation_trie(df).collect()), key=repr)


def some(seed, n, span):
    """Conversations over few texts, so that many prefixes are shared and many conversations are equal."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-span, span), n):
        for turn in range(rng.randrange(1, 8)):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "bb", "", None, "日本🎉"])))
    rng.shuffle(rows)
    return rows


def unambiguous(rows):
    """Equal turn numbers only where role and text are equal or the role tells them apart."""
    seen, out = {}, []
    for r in rows:
        if seen.setdefault((r[0], r[1], r[2] or ""), r[3] or "") == (r[3] or ""):
            out.append(r)
    return out


def test_nodes_equal_a_plain_version(spark):
    for seed, n, span in ((1, 60, 300), (2, 150, 100)):
        rows = unambiguous(some(seed, n, span))
        assert found(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "2 as pos", "3 as a", "4 as x")) == plain(rows)


def test_slices_and_blocks_change_nothing(spark, monkeypatch):
    rows = unambiguous(some(3, 80, 200)) + [(900, t, "user", str(t % 5)) for t in range(60)] + [(1000, t, "user", str(t % 5)) for t in range(60)]
    want = plain(rows)
    monkeypatch.setattr(tries, "SLICE", 4)
    monkeypatch.setattr(tries, "BLOCK", 3)
    assert found(spark.createDataFrame(rows, SCHEMA)) == want


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "no id"), (7, 0, "user", "x"), (7, 0, "user", "x"), (100, None, None, None), (101, 0, "user", "gone"), (-7, 0, "user", "below zero"),
        (300, 0, "user", "long " * 20_000), (301, 0, "user", "ab"), (302, 0, "usera", "b"),
    ]
    rows += [(c, 0, "user", "the same") for c in range(500, 560)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_sample(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(df) == plain(rows)


def test_empty_table(spark):
    assert tries.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tries.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
