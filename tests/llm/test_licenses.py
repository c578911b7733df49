from collections import Counter

import brute

from rampart.llm import licenses

LICENSE_ROWS = [
    (20, "Released under the MIT License. MIT-license!  apache\nLICENSE, general public license general public license", "en", "a", 0),
    (21, "mit licenses, apachelicense, general public", "en", "a", 0),
    (22, "x " * 40 + "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and the associated "
         "documentation files (the \"Software\"), to deal in the Software without any restriction", "en", "a", 0),
    (23, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
         "conditions are met: MIT LICENSE", "en", "a", 0),
    (24, "permission is hereby granted", "en", "a", 0),
]


def base(text):
    words, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            words += [word] if word else []
            word = ""
        else:
            word += c
    places = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({lab for _, lab in places}))


def test_base_columns_agree_with_brute_force(spark, sample):
    extra = spark.createDataFrame(LICENSE_ROWS, brute.SCHEMA)
    for df in (brute.awkward(spark), brute.empty(spark), sample, extra):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        out = licenses.licenses(df).collect()
        assert Counter(tuple(r[:6]) for r in out) == Counter((i, *base(t)) for i, t in rows)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in out)


def test_notices_with_changed_words(spark):
    out = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(LICENSE_ROWS, brute.SCHEMA)).collect()}
    assert out[20].labels == "apache,gpl,mit" and out[20].n_base == 5 and out[20].score == 1
    assert out[21].labels == "" and out[21].score == 0
    assert out[22].labels == "mit" and out[22].n_base == 0 and 0.5 <= out[22].score < 1
    assert out[23].labels == "bsd,mit" and out[23].base_labels == "mit"
    assert out[24].labels == ""


def test_spans_give_their_place(spark):
    _, spans = licenses.scan_licenses(spark.createDataFrame(LICENSE_ROWS[2:3], brute.SCHEMA))
    span, = spans.collect()
    assert (span.first_word, span.last_word) == (40, 68)


def test_pieces_of_a_notice_beside_a_whole_one(spark):
    """They neither hide it nor stretch it over the length of two notices; each whole one has its span."""
    mit = next(n for n, label in licenses.NOTICES.items() if label == "mit")
    n, tail = len(mit.split()), " " + " ".join(mit.split()[-4:])
    made = [mit + tail * 40, tail * 40 + " " + mit, (mit + " ") * 3, tail * 40, mit + tail * 40 + " x" * 20 + " " + mit, mit]
    rows, spans = licenses.scan_licenses(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    found = {i: [] for i in range(len(made))}
    for r in rows.join(spans, "_row").collect():
        found[r.doc_id].append(r)
    assert [len(found[i]) for i in range(len(made))] == [1, 1, 3, 0, 2, 1]
    assert all(r.label == "mit" and r.coverage == 1 and r.last_word - r.first_word < 2 * n for rs in found.values() for r in rs)
    assert [r.score for r in licenses.licenses(spark.createDataFrame([(1, made[0])], "doc_id long, text string")).collect()] == [1.0]
