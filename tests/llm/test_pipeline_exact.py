"""The pipeline's rows, stage by stage, against brute force on a small fixture."""

import hashlib
import random

import corpus_pipeline
from lexquarry.llm import decontaminate
from test_operators import _tiktoken, brute_components, semi_global

ITEMS = [(1, "It was a bright cold day in April, and the clocks were striking thirteen."), (2, "Call me Ishmael, some years ago, never mind how long.")]


def _fixture():
    """(doc_id, text, toxic, good): invented prose, copies and near copies, passages of the benchmark; a quarter has no label."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("the", "ing", "tion", "er", "an", "ou") for b in ("st", "nd", "re", "ly", "ha", "wh", "es")]
    words += [w for _, item in ITEMS for w in item.replace(",", "").replace(".", "").split()]  # a model knows nothing of words it never met
    rows = []
    for i in range(400):
        text = [rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(20, 60))]
        toxic, good = i % 5 == 0, i % 3 != 0
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["stupid", "moron", "scumbag", "scumlike"]))
        rows.append((i, " ".join(text if good else [w + rng.choice(["***", "%%%", "$$$"]) for w in text]), int(toxic), int(good)))
    clean = [t for _, t, toxic, good in rows if good and not toxic]
    more = [clean[0], clean[1], clean[1], clean[2].upper(), " ".join(clean[3].split()[:-1]), " ".join(clean[4].split()[: len(clean[4].split()) // 2])]
    item = ITEMS[0][1]
    for at, passage in enumerate((item, item.replace("bright", "brigth"), item[: len(item) // 2], ITEMS[1][1].upper())):
        more.append(f"{clean[10 + at]} {passage} {clean[20 + at]}")
    return rows + [(1000 + i, t, 0, 1) for i, t in enumerate(more)]


def test_rows(spark, tmp_path, monkeypatch):
    rows = _fixture()
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write("documents", [(d, t, "en") for d, t, _, _ in rows], "doc_id long, text string, lang string")
    write("labels", [(d, good, toxic) for d, _, toxic, good in rows if d < 1000 and d % 4], "doc_id long, quality int, toxic int")
    write("benchmark", ITEMS, "item_id long, text string")
    seen = {}

    def kept(name, stage):
        def f(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            seen[name] = sorted(r.doc_id for r in out.select("doc_id").collect())
            return out

        return f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, kept(name, stage)) for name, stage in corpus_pipeline.STAGES])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text, want = {d: t for d, t, _, _ in rows}, {}
    want["toxicity"] = [d for d, _, toxic, _ in rows if not toxic]
    want["quality"] = [d for d, _, toxic, good in rows if good and not toxic]
    parts = brute_components([(d, text[d]) for d in want["quality"]])
    want["near duplicates"] = [d for d, (_, _, first) in parts.items() if first]
    plain = [decontaminate.plain_text(t) for _, t in ITEMS]
    want["decontamination"] = [d for d in want["near duplicates"] if not any(semi_global(y, decontaminate.plain_text(text[d])) <= len(y) // 10 for y in plain)]
    want["token ids"] = want["decontamination"]
    for name, ids in want.items():
        assert seen[name] == sorted(ids), name
    assert [len(want[k]) for k in want] == sorted({len(ids) for ids in want.values()}, reverse=True) + [len(want["token ids"])]
    library = _tiktoken()
    ids = {d: library.encode_ordinary(text[d]) for d in want["token ids"]}
    assert {r.doc_id: (r.token_ids, r.n_tokens, r.decoded_sha256) for r in got} == {d: (x, len(x), hashlib.sha256(text[d].encode()).hexdigest()) for d, x in ids.items()}
    assert len(got) == len(ids)
