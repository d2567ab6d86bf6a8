"""Offending offsets, in the operator and in the registered query."""

import re

import numpy as np
import pyarrow as pa

from lexquarry.llm import labelled, registry, toxicity

SF = "/root/testdata/sf0.01"


def _want(text, chance):
    """Runs of toxic words; words are cut one at a time, so that places are those of the text itself."""
    words = [(a, b) for m in re.finditer(r"\S+", text) for a, b in _words(text, m.start(), m.end())]
    out, last = [], False
    for (a, b), x in zip(words, chance, strict=True):
        if x >= 0.5 and last:
            out[-1] = (out[-1][0], b)
        elif x >= 0.5:
            out.append((a, b))
        last = x >= 0.5
    return out


def _words(text, a, b):
    place = [i for i in range(a, b) for _ in text[i].lower()]
    return [(place[m.start()], place[m.end() - 1] + 1) for m in re.finditer(r"\w+", text[a:b].lower())]


def test_offsets_of_the_text():
    text = "İİ, you Stupid moron!"
    words = re.findall(r"\w+", text.lower())
    chance = np.array([float(w in ("stupid", "moron")) for w in words])
    assert [text[s["start"] : s["end"]] for s in toxicity.spans_of(text, chance)] == ["Stupid moron"]


def test_registered(spark):
    docs, labels = registry.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.Model.fit(labelled.sample(docs, labels.where(labelled.fold("doc_id", 5) != 0), "toxic"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows, some = registry.op9_toxicity(spark, SF).collect(), 0
    assert len(rows) == docs.count()
    for r in rows:
        text = texts[r.doc_id] or ""
        _, chance, _, _ = model.reader()(pa.array([text]))
        assert [(s.start, s.end) for s in r.spans] == _want(text, chance)
        some += bool(r.spans)
    assert some
