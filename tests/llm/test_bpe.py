import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from remembra.llm import bpe
from remembra.llm.bpe import Encoder, bpe_report, vocabulary

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(2)
    out = [None, "", " ", "a", "it's  we'll\n\n  x\t\ty  ", "<|endoftext|>", "naïve Größe 東京 😀😀 é", "\x00\x1c\x1d\x1f\x85\xa0 ​　 x", "a\x1c\x1c b\x1f", "A" * 700, "ab" * 5000 + "é" * 300, "1234567890" * 40, "!?" * 200 + " " * 900 + "x"]
    alphabet = "aeinrstlou  éßñ.,\n'’0189中́😀\x1f\x85"
    out += ["".join(r.choice(alphabet) for _ in range(r.choice([3, 40, 400]))) for _ in range(150)]
    return out


def test_tokens_equal_the_librarys(oracle):
    encoder = Encoder(vocabulary(PATH, PATTERN))
    data = texts()
    for _ in range(2):  # from memory the second time
        ids, bounds = encoder.encode([x or "" for x in data])
        for k, x in enumerate(data):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == oracle.encode_ordinary(x or ""), repr(x)


def test_matrix_equals_heap():
    v = vocabulary(PATH, PATTERN)
    r = random.Random(4)
    group = [bytes(r.choice(b"aeinrst\xc3\xa9") for _ in range(r.randint(2, 64))) for _ in range(300)]
    assert [x.tolist() for x in v._matrix(group, 64)] == [v._heap(x).tolist() for x in group]


def test_report(spark, oracle, monkeypatch):
    data = texts()
    rows = [(i, x, 3) for i, x in enumerate(data)] + [(4, data[4], 3)]
    got = bpe_report(spark.createDataFrame(rows, "doc_id long, text string, tokens int"), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = oracle.encode_ordinary(data[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((data[r.doc_id] or "").encode()).hexdigest()
    assert bpe_report(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


def test_forgetting(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = Encoder(vocabulary(PATH, PATTERN))
    for x in texts():
        assert encoder.encode([x or ""])[0].tolist() == oracle.encode_ordinary(x or "")
