"""Decoded bytes come from the ids by the vocabulary, not from the input."""

import random
import time

import public_tokenizers
import pyarrow as pa
import tiktoken

from lexquarry.llm import bpe_codec


def test_whole_tokens_are_decoded():
    codec = bpe_codec.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = next(w for w in ("the", "and", "of", "a") if w.encode() in codec.ranks)
    token = codec.ranks[whole.encode()]
    assert codec.encode(pa.array([whole])) == [(1, str(token), whole.encode())]
    codec.words.clear()
    codec.db.execute(f"UPDATE vocabulary SET hex = '{b'wrong'.hex()}' WHERE token = {token}")
    assert codec.encode(pa.array([whole])) == [(1, str(token), b"wrong")]


def test_long_words():
    """Words of many windows, with and without a token that two windows have in common, against the library."""
    codec = bpe_codec.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["".join(rng.choice(letters) for _ in range(100_000)), "a" * 100_000, "哈" * 9000, "abcab" * 3000, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(9000)), "-" * 20_000 + " " * 3000]
    for _ in range(60):  # words that repeat, whose windows need not agree
        unit = "".join(rng.choice("abcé哈-é ") for _ in range(rng.randrange(1, 12)))
        texts.append(unit * rng.randrange(1, 200))
    for text in texts:
        ids, ends = codec.ids(pa.array([text]))
        assert ids.tolist() == library.encode_ordinary(text) and ends.tolist() == [0, len(ids)]
        assert codec.decode(ids, ends) == [text.encode()]


def test_few_rows_and_words(monkeypatch):
    """Bounds of queries and of the memory change nothing."""
    codec = bpe_codec.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["The first of several texts, unanswerable.", None, "unanswerable " * 40, "", "x" * 300]
    want = codec.encode(pa.array(texts))
    for name, value in (("QUERY_BYTES", 20), ("ROWS", 50), ("WORDS", 2), ("DECODED", 3)):
        monkeypatch.setattr(bpe_codec, name, value)
        codec.words.clear()
        assert codec.encode(pa.array(texts)) == want
    assert [d for _, _, d in want] == [(t or "").encode() for t in texts]


def test_very_long_word():
    """A word of 400,000 letters takes twice to three times what one of 200,000 takes, not four times."""
    codec = bpe_codec.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng, seconds = random.Random(8), []
    for size in (200_000, 400_000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        start = time.process_time()
        ids, ends = codec.ids(pa.array([word]))
        seconds.append(time.process_time() - start)
        assert codec.decode(ids, ends) == [word.encode()]
    print(seconds)
    assert seconds[1] < 3.2 * seconds[0] + 0.5
