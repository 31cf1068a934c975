import hashlib
import random

import numpy as np
import pytest

from tabularium.llm import bpe

ALPHABET = " \n\t'sllabcéè日本𝔘  　​12²..!|-<|endoftext|>\r\x85́\x00"
PIECES = [" ", "the ", "<|endoftext|>", "don't", "  \n", "x" * 40, "word word. "]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(bpe.default_vocabulary())
    out.no_truncation()
    out.no_padding()
    return out


def texts(n, seed):
    rng = random.Random(seed)
    passage = "".join(rng.choice(PIECES) for _ in range(300))
    for _ in range(n):
        own = "".join(rng.choice([rng.choice(ALPHABET), rng.choice(ALPHABET), *PIECES]) for _ in range(rng.randint(0, 150)))
        yield own + passage * rng.randint(0, 1) + own[:20]


@pytest.mark.parametrize("bits", [4, 10])
def test_same_ids_and_text_as_the_library(reference, bits):
    own = bpe.Encoder(bpe.default_vocabulary(), room=200_000, bits=bits)
    every = list(texts(400, bits))
    for text, ids in zip(every, own.encode_all(every)):
        assert own.encode(text) == ids
        want = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == reference.decode(want, skip_special_tokens=False) == text
    assert own.reused and own.used <= 200_000


def test_passages_are_encoded_once():
    own = bpe.Encoder(bpe.default_vocabulary(), bits=6)
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000))
    own.encode("first words " + passage)
    before = own.encoded
    own.encode("others, and more of them " + passage)
    assert own.encoded - before <= 3


def test_cuts_follow_the_content():
    data = random.Random(1).randbytes(20_000)
    a, b = (bpe.cuts(np.frombuffer(x, np.uint8)).tolist() for x in (data, b"0123456789" + data))
    assert a and set(x + 10 for x in a) <= set(b)


def test_safe_places():
    text = "ab c\n\n dé ł\xa0 \xad x² !\t y\x00 z 日 k "
    data = text.encode()
    visible = lambda c: "\x21" <= c <= "\x7e" or "\xa1" <= c <= "\u017f" and c != "\xad"
    want = [len(text[:k].encode()) for k in range(1, len(text)) if text[k] in " \n" and visible(text[k - 1])]
    assert bpe.safe_places(np.frombuffer(data, np.uint8)).tolist() == want


def test_rows(spark, reference):
    rows = [(1, None, 1), (2, "", 1), (3, "a <|endoftext|>b", 1), (3, "a <|endoftext|>b", 1), (None, "é" * 100_000, 1), (4, "日本 語", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.encode(docs, outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(out) == len(rows)
    by_text = {r.decoded: r for r in out}
    for _, text, _ in rows:
        r = by_text[text or ""]
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert (bytes(r.ids), r.n_tokens) == (ids, len(ids) // 4)
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.encode(docs.limit(0)).count() == 0
