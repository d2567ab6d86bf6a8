"""What the registered queries return: columns, types, rows, and values that follow from the tables alone."""

import hashlib
import zlib

import numpy as np
import pytest

from lexquarry.llm import license_scan, quality, registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_fingerprints": [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")],
    "op3_token_files": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op4_license_scan": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")],
    "op6_bpe_codec": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op7_near_duplicates": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    "op8_token_counts": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")],
    "op9_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op10_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, texts, name):
    out = registry.queries()[name](spark, SF)
    assert out.dtypes[: len(COLUMNS[name])] == COLUMNS[name]
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == set(texts)
    own = sorted(texts)
    for at, d in enumerate(own):
        r, t = rows[d], texts[d]
        if name == "op2_fingerprints":
            following, n = texts[own[(at + 1) % len(own)]], len(t) // 4
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest())
        elif name == "op6_bpe_codec":
            assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        elif name == "op7_near_duplicates":
            assert r.kept == (r.doc_id == r.component_id)
        elif name == "op8_token_counts":
            assert r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 512)
        elif name in ("op9_toxicity", "op10_quality"):
            folds, fold = (5, 0) if name == "op9_toxicity" else (3, 1)
            assert r.held_out == (zlib.crc32(str(d).encode()) % folds == fold)
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    if name == "op3_token_files":
        ends = np.cumsum([rows[d].n_tokens for d in own]).tolist()
        assert [rows[d].start for d in own] == [0, *ends[:-1]]


# The classifier against a dense and slow form of it.


def grams_of(text):
    """Feature numbers of a text's tokens, by plain integers."""
    tokens = quality._TOKEN.findall(text)
    mask = (1 << 64) - 1

    def bucket(h):
        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask
        return (h >> 46) % quality.BUCKETS

    word = [quality._hash("w", t.lower()) for t in tokens]
    form = [quality._hash("s", quality.shape(t)) ^ (0x9E3779B97F4A7C15 if i and t == tokens[i - 1] else 0) for i, t in enumerate(tokens)]
    pair = lambda h: [bucket(((h[i - 1] if i else 1) * 0xD6E8FEB86659FD93 + x) & mask) for i, x in enumerate(h)]
    return [*map(bucket, word), *map(bucket, form), *pair(word), *pair(form)], len(tokens)


def dense(text):
    x = np.zeros(quality.BUCKETS + 1)
    at, n = grams_of(text)
    for b in at:
        x[b] += quality.SCALE / max(1, n)
    x[-1] = 1.0
    return x


def test_quality_against_dense_vectors():
    rng = np.random.default_rng(3)
    words = np.array(["the", "Anat", "###", "x1", "UP", "of,", "of", "of", "Über"])
    rows = [(" ".join(rng.choice(words[: 5 + 4 * (i % 2)], rng.integers(0, 30))), i % 2) for i in range(24)]
    y = np.array([label for _, label in rows], float)
    xs = [dense(t).astype(np.float32).astype(float) for t, _ in rows]
    z, n = np.zeros(quality.BUCKETS + 1), np.zeros(quality.BUCKETS + 1)

    def weights():
        w = -(z - np.sign(z) * quality.L1) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + quality.L2)
        return np.where(np.abs(z) <= quality.L1, 0.0, w)

    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for step in range(quality.PASSES):
        for i in np.random.default_rng(step).permutation(len(rows)):
            w = weights()
            g = (1 / (1 + np.exp(-(w @ xs[i]))) - y[i]) * balance[i] * xs[i]
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA * w
            n += g * g
    want, model = weights(), quality.Model.fit(rows)
    assert np.allclose(model.weights, want[:-1], atol=1e-4) and np.isclose(model.bias, want[-1], atol=1e-4)
    import pyarrow as pa

    texts = [t for t, _ in rows] + ["", None, "New words HERE ###"]
    got = model.score(pa.array(texts))
    for t, s in zip(texts, got):
        assert np.isclose(s, 1 / (1 + np.exp(-(dense(t or "")[:-1] @ model.weights + model.bias))), atol=1e-5)


def test_later_parts_of_licences(spark):
    rows = [
        (1, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "mit"),
        (2, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
        (3, "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'AS IS' BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache"),
        (4, "The goods are provided without warranty.", ""),
    ]
    out = license_scan.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in out} == {d: label for d, _, label in rows}
    assert all(r.score >= license_scan.COVER for r in out if r.doc_id < 4)
