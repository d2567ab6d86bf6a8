"""Katz backoff against a dictionary version, whitening against numpy, collocations against plain counting."""

import collections
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import collocations, katz, registry, whitening

SF = "/root/testdata/sf0.001"
PAGES = ["a b c a b d", "a b c. A b c", "", None, "d d d d e", "a b\x0bc  f", "g h i j k l a b c"] * 3


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Dictionary:
    """The same model with dictionaries, probabilities by recursion."""

    def __init__(self, texts, order, k=katz.K):
        self.k, self.order = k, order
        self.counts = [collections.Counter() for _ in range(order + 1)]
        for text in texts:
            w = [None, *self.tokens(text)]
            for i in range(1, len(w)):
                self.counts[1][w[i],] += 1
                for m in range(2, order + 1):
                    if i - m + 1 >= 0:
                        self.counts[m][tuple(w[i - m + 1 : i + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.loss = [None, *map(self.losses, self.counts[1:])]
        self.after = [collections.defaultdict(dict) for _ in range(order + 1)]
        for m in range(2, order + 1):
            for g, c in self.counts[m].items():
                self.after[m][g[:-1]][g[-1]] = c

    @staticmethod
    def tokens(text):
        return [*re.findall("[^\x20\x09-\x0d]+", _lower(text)), ""]

    def losses(self, counts):
        n = [sum(c == r for c in counts.values()) for r in range(1, self.k + 2)]
        plain = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        turing = [r - (r + 1) * n[r] / n[r - 1] if n[r - 1] else 0 for r in range(1, self.k + 1)]
        return [0.0, *[t if 0 < t < r else plain for r, t in enumerate(turing, 1)]]

    def lost(self, m, c):
        return self.loss[m][min(c, self.k)]

    def p(self, context, word):
        m = len(context) + 1
        if m == 1:
            c = self.counts[1].get((word,), 0)
            return (c - self.lost(1, c)) / self.n if c else (sum(self.lost(1, c) for c in self.counts[1].values()) / self.n if self.n else 1.0)
        after = self.after[m].get(context)
        if not after:
            return self.p(context[1:], word)
        total = sum(after.values())
        if word in after:
            return (after[word] - self.lost(m, after[word])) / total
        left = sum(self.lost(m, c) for c in after.values()) / total
        return left / (1 - sum(self.p(context[1:], w) for w in after)) * self.p(context[1:], word)

    def score(self, text):
        w = [None, *self.tokens(text)]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i]), w[i])) for i in range(1, len(w)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_equals_dictionaries(spark, order):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PAGES)] + [(None, "a b z"), (3, "b c q a b")], "doc_id long, text string")
    learned = F.col("doc_id") % 4 != 1
    rows = docs.select("doc_id", "text", F.coalesce(learned, F.lit(False)).alias("y")).collect()
    model = Dictionary([r["text"] for r in rows if r["y"]], order)
    scored, found = katz.evaluate(spark, docs, learned, order=order)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], round(r["score"], 9), round(r["base_score"], 9)) for r in scored.collect())
    base = lambda t: sum(math.log10((model.counts[1].get((w,), 0) + 1) / (model.n + model.v + 1)) for w in model.tokens(t))
    assert got == sorted((-1 if r["doc_id"] is None else r["doc_id"], len(model.tokens(r["text"])), round(model.score(r["text"]), 9), round(base(r["text"]), 9)) for r in rows)
    assert (found.tokens, found.distinct) == (model.n, model.v)
    for context in list(model.after[order])[:20] if order > 1 else [()]:
        assert abs(sum(model.p(context, w) for (w,) in model.counts[1]) + model.p(context, "never seen") - 1) < 1e-9
    # a stored model scores other texts alike
    again, _ = katz.evaluate(spark, docs.where("doc_id > 5"), model=found)
    want = {(r["doc_id"], r["n_tokens"]): r["score"] for r in scored.collect()}
    assert all(abs(want[r["doc_id"], r["n_tokens"]] - r["score"]) < 1e-12 for r in again.collect())


def test_katz_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    scored, model = katz.evaluate(spark, docs, F.lit(False))
    assert (model.tokens, model.distinct) == (0, 0) and {(r["score"], r["base_score"], r["n_known"]) for r in scored.collect()} == {(0.0, 0.0, 0)}
    assert katz.evaluate(spark, docs.limit(0), F.lit(True))[0].count() == 0
    long = spark.createDataFrame([(1, "x y " * 100_000), (2, "x y")], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("block", F.lit(2))
    rows = katz.evaluate(spark, long, F.lit(True))[0].collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {1: 200_001, 2: 3}


def test_losses():
    assert katz.losses([10, 4, 2, 1, 1, 0])[1] == pytest.approx(0.2)
    assert katz.losses([0] * 6)[1] == 0.5
    assert all(0 < x < r for r, x in enumerate(katz.losses([7, 9, 0, 3, 3, 8])) if r)


def test_packed_columns():
    columns = [np.arange(-3, 300), np.zeros(0, np.float64), np.array([1.5, -2.0]), np.array([1, 0], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, katz.unpack(katz.pack(*columns))))


def test_language_model_query(spark):
    rows = registry.op11_language_model(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["n_tokens"] == len(docs[r["doc_id"]].split()) + 1 for r in rows if docs[r["doc_id"]].isascii() and not re.search("[\x1c-\x1f]", docs[r["doc_id"]]))


def test_whitening_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    own = table.toPandas()
    x = np.floor(1024 * np.stack(own["embedding"].to_list()).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    want = centred @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    got = registry.op12_whitening(spark, SF).toPandas()
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[own["vec_id"]].to_numpy()
    assert np.abs(wide * np.sign((wide * want).sum(0)) - want).max() < 1e-9
    assert (got[got["component"] == 1].set_index("vec_id").loc[own["vec_id"]]["deviation"].to_numpy() == ((n * x - sums) ** 2).sum(1)).all()
    assert np.allclose(sorted(got["explained"].unique()), sorted(values[::-1][:8] / values.sum()))


def test_whitening_edges(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.5, 0.25]), (None, [0.1, -0.5]), (7, [-0.3, 0.9]), (8, [1.0]), (5, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("w", F.lit(1))
    out = whitening.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["5"] * 4 + ["7"] * 2 + ["None"] * 2 and {r["n"] for r in out} == {4}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 2.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert {r["component"]: r["whitened"] is None for r in huge} == {1: False, 2: True}  # no variance is left beside the first
    one = whitening.whiten(df.where("vec_id = 5")).collect()
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(0, None, None, 0.0)}
    assert whitening.whiten(df.limit(0)).collect() == []


def _phrases(rows, least, top):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", _lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = {(lang, s) for (lang, w), a in found.items() if len(w) == 3 for s in (w[:2], w[1:]) if 100 * a >= 50 * f[lang, s]}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


@pytest.mark.parametrize("share", [10_000, 20])
def test_collocations_equal_counting(spark, share):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert {tuple(r) for r in collocations.collocations(spark, docs, least=4, top=300, share=share).collect()} == _phrases(rows, 4, 300)


@pytest.mark.parametrize("share", [10_000, 3])
def test_collocations_edges(spark, share):
    rows = [("a\x00b c. A\x00B c", None), ("a\x01b c! a b c", None), (None, "en"), ("", ""), ("x\x01\x00 y " * 20, "l\x00g"), ("the the the " * 9, "en"), ("q r" + " s" * 50_000, "long")] * 3
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    assert {tuple(r) for r in collocations.collocations(spark, df, least=3, share=share).collect()} == _phrases(rows, 3, 2000)
    assert collocations.collocations(spark, df.limit(0)).collect() == []


def test_dealing_many_heavy_beginnings(spark):
    """Where a suffix goes takes one look at its words, not one pass over a slice for each heavy beginning."""
    text = " ".join(f"w{i % 3001} v{i % 499}" for i in range(150_000))
    docs = spark.createDataFrame([(text, "en"), ("w1 v1 b. w1 v1 c", "und")], "text string, lang string").coalesce(1)
    many = [(f"en\0w{i}\0", 1) for i in range(3001)] + [(f"en\0w{i}\0v{j}\0", 2) for i in range(1, 17) for j in range(499)] + [(f"en\0x{i}\0", 1) for i in range(4000)]

    def dealt(heavy):
        began = time.time()
        collocations.suffixes(docs, 3, heavy).agg(F.sum("part")).collect()
        return time.time() - began

    dealt(many[:1])
    assert dealt(many) < 3 * dealt(many[:1]) + 1
    few, rows = (collocations.suffixes(docs, 3, heavy).collect() for heavy in (many[:1], many))
    assert sorted((r["key"], r["n"]) for r in rows) == sorted((r["key"], r["n"]) for r in few)
    two = {(f"w{i}", f"v{j}") for i in range(1, 17) for j in range(499)}
    parts = collections.defaultdict(set)
    for r in rows:
        lang, *w = r["key"].split("\0")[:-1]
        parts[(lang, *w[: 3 if lang == "en" and tuple(w[:2]) in two else 2 if lang == "en" and w[0][0] == "w" else 1])].add(r["part"])
    assert all(len(p) == 1 for p in parts.values())  # by a heavy beginning and the next word, else by the first word
    assert len(set.union(*parts.values())) > 0.99 * len(parts)


def test_pieces_and_distinct_rows():
    texts = ["Ab c", "", "d", ". ,", "e\tÄÖ!É f;", "\r", "g", None, "G  g.g", "A\x00 \x01"]
    words, codes, text = collocations.piece_words(pa.array(texts))
    found = [(words[int(c) - 1].as_py().decode(), int(t)) if c else None for c, t in zip(codes, text)]
    assert found == [("ab", 0), ("c", 0), None, ("d", 2), None, ("e", 4), ("ÄÖ", 4), None, ("É", 4), ("f", 4), None, ("g", 6), None, ("g", 8), ("g", 8), None, ("g", 8), None, ("a\x01\x01", 9), ("\x01\x02", 9), None]
    columns = [np.array([1, 0, 1, 2, 1, 0]), np.array([5, 0, 5, 5, 4, 0]), np.array([0, 7, 0, 1, 9, 7])]
    want = [[0, 1, 1, 2], [0, 4, 5, 5], [7, 9, 0, 1]], [2, 1, 2, 1]
    for spans in ([3, 6, 10], [1 << 20, 1 << 30, 1 << 30]):  # also where one number is too short for a row
        rows, n = collocations.distinct_rows(columns, spans)
        assert ([r.tolist() for r in rows], n.tolist()) == want


def test_scores_without_tables(spark, tmp_path, monkeypatch):
    """What only later texts need isn't written; words go once they are counted; the scores are the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found, size, files = [], [], katz.scratch(spark)
    monkeypatch.setattr(katz, "scratch", lambda _: files)
    for tables in (True, False):
        files.root = f"file://{tmp_path}/{tables}"
        rows, model = katz.evaluate(spark, docs, F.col("doc_id") % 3 != 0, tables=tables)
        found.append({r["doc_id"]: tuple(r)[1:] for r in rows.collect()})
        size.append(sum(f.stat().st_size for f in (tmp_path / str(tables)).rglob("*.parquet")))
        assert not list((tmp_path / str(tables)).rglob("blocks-*/*"))
    assert found[0].keys() == found[1].keys() and all(found[0][k] == pytest.approx(found[1][k], rel=1e-9) for k in found[0])
    assert size[1] < 0.7 * size[0]
    with pytest.raises(ValueError, match="without tables"):
        katz.evaluate(spark, docs, model=model)


def test_blocks_join_batches(spark):
    """A block holds as many batches of a task as fit: the messages between blocks and parts are as many as their product."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(True).alias("train")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        rows = katz.blocks(docs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert len(rows) <= 1 + 2 * size // katz.BLOCK < docs.count() // 20
    assert sorted(i for r in rows for i in r["ids"]) == sorted(r["doc_id"] for r in docs.collect())


def test_many_small_messages():
    """Packing for many parts at once gives back each part's rows, whatever the sizes of numbers and parts."""
    sizes = np.array([0, 3, 1, 0, 4, 2, 0])
    keys = [np.array([-2, -2, 5, 1 << 40, -1, -1, 7, 7, 0, 3]), np.array([-2, 9, 0, 4, 1, 1, -1, 300, 2, 2]), np.array([0, -1, 2, 3, 4, 5, 6, 7, 8, 70_000])]
    n, lower, hot = np.arange(10), np.arange(10) * 1000, np.arange(10) % 2
    over = np.array([6, 6, 1, 2, 1 << 33, 1 << 33, 4, 4, 5, 9])
    data = list(katz.pack_grams(sizes, keys, n, lower, over, hot))
    got, columns = katz.unpack_grams(data, 3)
    assert got.tolist() == sizes.tolist() and all((a == b).all() for a, b in zip(columns, [*keys, n, lower, over, hot]))
    got, columns = katz.unpack_grams(data[1:3], 3)
    assert got.tolist() == [3, 1] and all((a == b[:4]).all() for a, b in zip(columns, [*keys, n, lower, over, hot]))
    (low, size), (count, _) = katz.unpack_each(list(katz.pack_each((np.array([0.5, -1.0, 1e300]), np.array([0, 1, 1, 3])), (np.array([1 << 63, 7], np.uint64), np.array([0, 2, 2, 2])))), 2)
    assert low.view(np.float64).tolist() == [0.5, -1.0, 1e300] and size.tolist() == [1, 0, 2] and count.tolist() == [1 << 63, 7]


def test_split_words():
    texts = ["", None, " \t", "A b\x0bc", "b", "\x1c\u2003É b\r\n", "a\x00 a", "é" * 3 + " Z"]
    words, codes, count = katz.split_words(pa.array(texts, pa.string()))
    found, want = [words[int(i)].as_py() for i in codes], [Dictionary.tokens(t)[:-1] for t in texts]
    assert found == [w.encode() for t in want for w in t] and count.tolist() == [len(t) for t in want]
    words, codes, count = katz.split_words(pa.array([None, ""], pa.string()))
    assert (len(words), len(codes), count.tolist()) == (0, 0, [0, 0])


def test_katz_of_blocks_and_parts_equals_dictionary(spark):
    """Several blocks, parts and contexts that aren't hot; scored again from the tables, which then answer from stored rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(5)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = Dictionary([t for i, t in sorted(texts.items()) if i % 3], 3)
    scored, found = katz.evaluate(spark, docs, F.col("doc_id") % 3 != 0, parts=7)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert got.keys() == texts.keys() and len(found.levels[1].hot) < len(model.after[2])
    for i in sorted(texts)[:25]:
        assert got[i] == pytest.approx(model.score(texts[i]), abs=1e-6)
    again = katz.evaluate(spark, docs.where("doc_id % 5 = 0"), model=found)[0].collect()
    assert again and all(r["score"] == pytest.approx(got[r["doc_id"]], abs=1e-9) for r in again)
