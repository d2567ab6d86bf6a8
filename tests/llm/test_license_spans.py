"""Covered template spans of licence scans."""

import random
import re

from lexquarry.llm import license_scan
from lexquarry.llm.registry import op4_license_scan

PHRASES = [*license_scan.BASE, *(t for _, t in license_scan.TEMPLATES)]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *_step(row, x, b)]
    return row[-1]


def _step(row, x, b):
    left = 0
    for j, y in enumerate(b):
        left = row[j] + 1 if x == y else max(row[j + 1], left)
        yield left


def test_spans(spark):
    k = next(i for i, p in enumerate(PHRASES) if p.startswith("permission is"))
    body, size = PHRASES[k], len(PHRASES[k].split())
    words = body.split()
    cut = " ".join(words[:10] + ["odd"] + words[11:])
    rows = [f"a b {body} c", f"{body} x y {body}", f"z {cut}", " ".join(words[:5]), "the MIT License and mit license, mit license", None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in license_scan.scan_licenses(df).collect()}
    assert got[0] == [(k, "mit", 2, 1 + size, 1.0)]
    assert got[1] == [(k, "mit", 0, size - 1, 1.0), (k, "mit", size + 2, 2 * size + 1, 1.0)]
    assert [s[:4] for s in got[2]] == [(k, "mit", 1, size)] and abs(got[2][0][4] - (size - 1) / size) < 1e-9
    assert got[4] == [(0, "mit", i, i + 1, 1.0) for i in (1, 4, 6)]
    assert got[3] == got[5] == got[6] == []


def test_spans_hold_their_words(spark):
    rng, rows = random.Random(4), []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(PHRASES).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["odd", "the", "license", ""])
            text += words[rng.randint(0, 2) :] + rng.choices(["some", "of", "software"], k=rng.randint(0, 8))
        rows.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in license_scan.scan_licenses(df).collect():
        words = re.findall(r"[^ ]+", r.text)
        assert set(filter(None, r.labels.split(","))) == {s.label for s in r.spans}
        assert r.score == max((s.coverage for s in r.spans), default=r.score)
        for s in r.spans:
            phrase = PHRASES[s.template].split()
            part = words[s.first : s.last + 1]
            assert part[0] in phrase and part[-1] in phrase and s.coverage * len(phrase) <= _common(part, phrase) + 1e-9
        for a in r.spans:
            assert not any(a is not b and a.template == b.template and a.first <= b.last and b.first <= a.last for b in r.spans)


def test_query_returns_spans(spark):
    rows = op4_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert all(bool(r.spans) == bool(r.labels) for r in rows) and any(r.spans for r in rows)
