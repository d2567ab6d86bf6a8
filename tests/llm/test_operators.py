"""The corpus operators against brute force, libraries and round trips, on small fixtures."""

import base64
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexquarry.llm import bpe_codec, components, decontaminate, fingerprint, huffman, labelled, license_scan, main_text, near_dup, quality, token_count, token_files, toxicity

WORDS = ["the", "Anat", "thnd###", "éeauou", "of,", "Licence", "各国語", "a1b2", "x" * 70, "don't", "<|endoftext|>", " ", "Straße!!", "J̌", "🙂"]
texts = st.lists(st.sampled_from(WORDS + [" ", "  ", "\n", "\t "]), max_size=30).map(" ".join) | st.text(max_size=60)
BYTES, MULTI, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "   "), (3, "x"), (None, "no id at all here"), (4, "Same text twice."), (5, "Same text twice."), (6, "The Cat sat " * 3000)]
    rows += [(10 + i, " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))) for i in range(60)]
    rows += [rows[5]]
    return spark.createDataFrame([(d, t, "mine", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_tokens string, score int")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# Token counts, BPE, token files


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_count_as_library(rows):
    counter = token_count._loaded.setdefault("t", token_count.Counter(BYTES, public_tokenizers.PATTERN))
    library = globals().setdefault("_lib", Tokenizer.from_file(BYTES))
    _, n = counter.count(pa.array(rows))
    assert n.tolist() == [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]


def test_count_frame(spark, docs):
    out = token_count.count_tokens(docs, BYTES, public_tokenizers.PATTERN)
    assert set(out.columns) == {"doc_id", "text", "score", "n_bytes", "n_tokens", "over_limit"}
    library = Tokenizer.from_file(BYTES)
    for r in out.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)
    assert token_count.count_tokens(empty(spark), BYTES, public_tokenizers.PATTERN).count() == 0


def _tiktoken():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=80, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_codec_as_library(rows):
    codec = bpe_codec._loaded.setdefault(MULTI, None) or bpe_codec._loaded.__setitem__(MULTI, bpe_codec.Codec(MULTI, public_tokenizers.PATTERN)) or bpe_codec._loaded[MULTI]
    library = globals().setdefault("_tik", _tiktoken())
    for text, (n, ids, data) in zip(rows, codec.encode(pa.array(rows))):
        want = library.encode_ordinary(text)
        assert (n, ids, data) == (len(want), ",".join(map(str, want)), text.encode())


def test_codec_frame(spark, docs):
    library = _tiktoken()
    for r in bpe_codec.encode_digests(docs, MULTI, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    for r in bpe_codec.encode_decode(docs, MULTI, public_tokenizers.PATTERN).collect():
        assert r.decoded == (r.text or "") and r.token_ids == library.encode_ordinary(r.text or "")
    assert bpe_codec.encode_decode(empty(spark), MULTI, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=2000), st.integers(9, 20))
def test_huffman(ids, limit):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=1)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and sum(0.5**int(n) for n in lengths if n) <= 1
    payload, bits = huffman.pack(ids, lengths, huffman.codes_of(lengths))
    assert huffman.unpack(payload, bits, len(ids), *huffman.table_of(lengths)).tolist() == ids.tolist()


def test_huffman_is_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert int((huffman.code_lengths(counts) * counts).sum()) == 132
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_encoder_as_library(rows):
    encoder = token_files._loaded.setdefault("t", token_files.Encoder(WORD))
    ids, sizes = encoder.encode(pa.array(rows), 2)
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(rows, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_ROWS", 9)
    files = token_files.write(spark, docs, WORD, 2)
    library = Tokenizer.from_file(WORD)
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    start, got = 0, sorted(token_files.read(*files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    for r, (_, text) in zip(got, rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.digests(*token_files.write(spark, empty(spark), WORD, 2)).count() == 0


# Near duplicates


def brute_components(rows):
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


@pytest.mark.parametrize(("short", "block", "low", "split"), [(48, 40_000, near_dup.LOW, 20_000), (2, 200, near_dup.LOW, 1), (2, 200, 0, 1)])
def test_near_dup(spark, docs, monkeypatch, short, block, low, split):
    """Short and long lists, with and without estimates, hubs dealt out or not."""
    monkeypatch.setattr(near_dup, "LIST", short)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(components, "SPLIT", split)
    monkeypatch.setattr(components, "SALTS", 5)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=90)
    rows = [(d, t) for d, t in dict(pairs(docs)).items() if d is not None]
    for i in range(40):  # edits from few to many, so that some link through others only
        text = list(base)
        for at in rng.sample(range(90), rng.randint(0, 6)):
            text[at] = rng.choice(words)
        rows.append((100 + i, " ".join(text) if i % 2 else " ".join(text).upper()))
    rows += [(200 + i, " ".join(base[:60] + rng.choices(words, k=30))) for i in range(15)]
    rows.append((100, dict(rows)[100]))
    got = near_dup.find(spark, spark.createDataFrame(rows + [(None, "alone")], "doc_id long, text string"), low).collect()
    want = brute_components(dict(rows).items())
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    assert near_dup.find(spark, empty(spark)).count() == 0


def test_one_of_each(spark, docs):
    kept = near_dup.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    want = {d for d, (_, _, k) in brute_components([p for p in set(pairs(docs)) if p[0] is not None]).items() if k}
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(want)
    assert kept.where("doc_id IS NULL").count() == 1


# Decontamination


def semi_global(item, text):
    column, best = list(range(len(item) + 1)), len(item)
    for c in text:
        new = [0]
        for i, q in enumerate(item):
            new.append(min(column[i] + (q != c), column[i + 1] + 1, new[i] + 1))
        column, best = new, min(best, new[-1])
    return best


def test_matcher():
    rng = random.Random(1)
    items = [(i, "".join(rng.choice("ab c") for _ in range(rng.choice([12, 63, 64, 65, 130])))) for i in range(20)] + [(90, None), (91, "--")]
    matcher = decontaminate.Matcher(items)
    found = []
    for _ in range(30):
        s = list(rng.choice(items[:20])[1])
        for _ in range(rng.randint(0, 8)):
            at, kind = rng.randrange(len(s)), rng.random()
            s[at : at + (kind < 0.6)] = [] if 0.3 < kind < 0.6 else [rng.choice("abc")]
        pad = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 50)))
        found.append(decontaminate.plain_text(pad() + "".join(s) + pad()))
    want = {(k, a): d for k, t in enumerate(found) for a, (_, y) in enumerate(matcher.items) if (d := semi_global(y, t)) <= matcher.budget[a]}
    assert {(k, a): d for k, a, d, _ in matcher.find(found)} == want and want


def test_leaks(spark, docs, monkeypatch):
    item = "It was a bright cold day in April, and the clocks were striking thirteen."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item), (4, "Call me Ishmael, some years ago, never mind how long.")], "item_id long, text string")
    edited = item.upper().replace("BRIGHT", "BRIGTH").replace(",", " -")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(500, f"before {item} after"), (501, edited), (502, item[: len(item) // 2])], "doc_id long, text string"))
    for size in (4 << 20, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(more, bench).collect()) == [(500, 1), (501, 1)]
        assert decontaminate.clean(more, bench).count() == more.count() - 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(more, none).count() == 0 and decontaminate.clean(docs, none).columns == docs.columns
    assert decontaminate.leaks(empty(spark), bench).count() == 0


# Fingerprints


def canon(t):
    t = t.lower() if t.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", t).strip(" ")


def brute_fingerprints(rows):
    out = {}
    rows = sorted((d, t or "") for d, t in rows)
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        sums = ["".join(f"{h:016x}" for h in (xxhash.xxh64_intdigest(b, 42), xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(b"second half", 42)))) for b in (canon(t).encode(), canon(edited).encode())]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *sums, float(canon(t) == canon(edited)), float(canon(t) == canon(following)))
    return out


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    forms = ["Straße ﬁn", "STRASSE  fin", "x", None, "", "É a", "É  A ", "a　b", "A b\n", "İstanbul", "ΣΑΣ", "q" * 50]
    rows = [(i * 3, t) for i, t in enumerate(forms * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in fingerprint.fingerprints(spark, df).collect()} == brute_fingerprints(rows)
    named = {}
    for r in fingerprint.fingerprints(spark, df, bits=1).collect():  # digests of two bits collide
        assert named.setdefault(r.fingerprint, canon(dict(rows)[r.doc_id] or "")) == canon(dict(rows)[r.doc_id] or "")
    assert len(named) == len({canon(t or "") for t in forms})
    assert fingerprint.fingerprints(spark, empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (1, "x y z w"), (1, "x y z w")], "doc_id long, text string")
    assert fingerprint.fingerprints(spark, odd).count() == 3


# Licences


def test_automaton():
    rng = random.Random(2)
    for _ in range(150):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 8))] for _ in range(rng.randint(1, 4))]
        automaton, text = license_scan.Automaton(seqs), [rng.randrange(4) for _ in range(20)]
        for i, (state, size) in enumerate(automaton.statistics(text)):
            best, places = 0, set()
            for n in range(1, i + 2):
                at = {(k, e) for k, q in enumerate(seqs) for e in range(n - 1, len(q)) if q[e + 1 - n : e + 1] == text[i + 1 - n : i + 1]}
                best, places = (n, at) if at else (best, places)
            assert size == best and (not size or automaton.places[state] == places)


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark, docs):
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction"
    rows = [None, "", "MIT License mit license", "the mit", "license mit license", "gnu General\nPublic--License é mit  license general public", body, body[:40], "x " * 500 + "Apache License"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").union(docs.select("doc_id", "text"))
    out = license_scan.scan_licenses(df).collect()
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    by = {r.text: r for r in out}
    assert by[body].labels == "mit" and by[body].n_base == 0 and by[body[:40]].labels == ""
    assert license_scan.scan_licenses(docs).count() == docs.count() and license_scan.scan_licenses(empty(spark)).count() == 0


# Main text

PAGE = (
    '<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now and save a lot of money today.</div>{}'
    '<aside><p>Related stories of the day</p></aside><section id="comments"><p>I do not agree with this at all.</p></section><form><label>Name</label></form><footer>&copy; all of us here</footer><script>var x = "<p>no</p>";</script></body></html>'
)
BODY = '<{0}><h1>A &amp; B</h1><p>Some words\n here <b>are</b> good.</p><div class="advert">Advert text</div><ul><li>One item</li></ul><p>The last&nbsp;words<br>end.</p></{0}>'
WANT = "A & B\nSome words here are good.\nOne item\nThe last words end."


def test_main_text(spark):
    pages = [(1, PAGE.format(BODY.format("article"))), (2, PAGE.format(BODY.format('div class="content"').replace('</div class="content">', "</div>"))), (3, None), (4, ""), (5, "<p>cut <b"), (6, "plain & text"), (7, "<script>var x"), (1, PAGE.format(BODY.format("article")))]
    df = spark.createDataFrame(pages, "page_id long, html string")
    weights = main_text.learn(df)
    assert weights["word"] > 0 and weights["<footer>"] < 0
    got = main_text.main_text(df, weights).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == [WANT, WANT, WANT, "", "", "cut", "plain & text", ""]
    assert all(r.n_chars == len(r.text) for r in got)
    none = df.where("false")
    assert main_text.main_text(none, main_text.learn(none)).count() == 0
    assert main_text.extract(PAGE.format(BODY.format("article")), main_text.Weights()) == WANT


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pabdiv \"'=!-&;", max_size=80))
def test_any_markup(page):
    main_text.extract(page, main_text.Weights())


def test_best_run():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.randint(-3, 3) for _ in range(rng.randint(0, 12))]
        a, b = main_text.best_run(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])


# Classifiers


def test_forward_backward():
    rng = np.random.default_rng(0)
    sizes, trans = np.array([0, 1, 5, 32, 33, 200, 0, 64]), np.array([[0, -2.0], [0.3, 1.1]])
    e = rng.normal(0, 3, sizes.sum())
    got, at = toxicity.Chains(sizes).marginals(e, trans)[0], 0
    for n in sizes:
        part, a, forward = e[at : at + n], np.array([1.0, 0.0]), []
        for x in part:
            a = a @ (np.exp(trans) * np.array([1, np.exp(x)]))
            a = a / a.sum()
            forward.append(a)
        b, backward = np.ones(2), [np.ones(2)]
        for x in part[:0:-1]:
            b = (np.exp(trans) * np.array([1, np.exp(x)])) @ b
            b = b / b.sum()
            backward.append(b)
        if n:
            both = np.array(forward) * np.array(backward[::-1])
            assert np.allclose(got[at : at + n], both[:, 1] / both.sum(1))
        at += n


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("the", "ing", "tion", "er", "an", "ou") for b in ("st", "nd", "re", "ly", "ha", "wh", "es")]
    rows = []
    for i in range(400):
        text = [rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(20, 60))]
        toxic, good = i % 5 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["stupid", "moron", "scumbag", "scumlike"]))
        if not good:
            text = [w + rng.choice(["***", "%%%", "$$$"]) for w in text]
        rows.append((i, " ".join(text), int(toxic), int(good)))
    return rows


def test_toxicity(spark, judged, docs):
    model = toxicity.Model.fit([(t, y) for i, t, y, _ in judged if i % 4])
    df = spark.createDataFrame([(i, t) for i, t, _, _ in judged if i % 4 == 0], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    assert all(got[i].predicted == y for i, _, y, _ in judged if i % 4 == 0)
    for i, t, y, _ in judged:
        if i % 4 == 0 and y:
            assert {t[s.start : s.end] for s in got[i].spans} & {"stupid", "moron", "scumbag", "scumlike"}
    out = toxicity.score_toxicity(docs, model)
    assert out.count() == docs.count() and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    nothing = toxicity.Model.fit([])
    assert {r.score for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.0}


def test_quality(spark, judged, docs):
    model = quality.Model.fit([(t, y) for i, t, _, y in judged if i % 4])
    df = spark.createDataFrame([(i, t) for i, t, _, _ in judged if i % 4 == 0], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in quality.score_quality(df, model).collect()}
    assert all(got[i] == y for i, _, _, y in judged if i % 4 == 0)
    assert quality.with_quality(docs, model).columns == docs.columns
    assert quality.score_quality(docs, model).count() == docs.count() and quality.score_quality(empty(spark), model).count() == 0
    assert quality.Model.fit([]).score(pa.array(["x", None])).min() > 0.5 and quality.Model.fit([("x", 0)]).score(pa.array(["x"]))[0] < 0.5


def test_sample(spark, docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (5, None), (999, 1), (6, 0)], "doc_id long, y int")
    assert sorted(labelled.sample(docs, labels, "y")) == sorted([("x", 1), ("Same text twice.", 1), (dict(pairs(docs))[6], 0)])
    assert len(labelled.sample(docs, labels, "y", most=100)) == 2 and labelled.sample(empty(spark), labels, "y") == []
    got = {r[0]: r[1] for r in docs.select("doc_id", labelled.fold("doc_id", 5)).where("doc_id IS NOT NULL").collect()}
    assert all(f == zlib.crc32(str(d).encode()) % 5 for d, f in got.items())


def test_near_dup_without_ids(spark):
    """Rows without a doc_id take the component of an equal set; a set that only they have links nothing."""
    words = [f"w{i}" for i in range(120)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(7, text), (None, text), (None, near), (None, near), (9, "something else altogether")]
    got = near_dup.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(
        [("7", 116, "7", True), ("None", 116, "7", False), ("None", 116, "None", True), ("None", 116, "None", True), ("9", 1, "9", True)]
    )


def _shuffle_bytes(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_written_tables_leave_no_shuffle_files(spark):
    """what led to a written table goes with it."""
    from lexquarry.sources.scratch import scratch

    before = _shuffle_bytes(spark)
    scratch(spark).keep(spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).count(), "grouped")
    assert _shuffle_bytes(spark) <= before


def test_likely_pairs_of_values_that_must_meet(spark):
    """nodes that share fewer values than alike sketches must give no pair; those that share as many do."""
    rows = [(v, i, 64, 30) for i in range(30) for v in range(20)] + [(1000 + v, i, 64, 2) for i in (3, 7) for v in range(12)]
    info = near_dup.met(spark.createDataFrame(rows, "value long, id long, n int, df long"), near_dup.LOW)
    assert sorted(map(tuple, near_dup.likely_pairs(info).collect())) == [(3, 7)]


def test_one_of_each_leaves_texts_where_they_are(spark):
    """texts of documents that surely stay or go are not shuffled; repeated ids and rows without one are whole."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=4000))) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(50)] + [rows[9], (None, rows[0][1])]
    df = near_dup.scratch(spark).keep(spark.createDataFrame(rows, "doc_id long, text string"), "texts")
    before = _shuffle_bytes(spark)
    kept = near_dup.one_of_each(spark, df).collect()
    assert _shuffle_bytes(spark) - before < 300 * 4000 // 4
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == list(range(300)) and len(kept) == 301
