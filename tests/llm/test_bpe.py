import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from factloom.llm import bpe

FILE = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def pair():
    path = public_tokenizers.path(FILE)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.encoder(path, public_tokenizers.PATTERN), other


def test_same_ids_as_the_library(pair):
    own, other = pair
    draw = random.Random(3)
    alphabets = ["etaoin shrdlu", "aaab ", "éèñß🙂漢字 　\x1c\x85 \n\t", "0123456789²½'s've \r\n", "<|endoftext|> "]
    for _ in range(4000):
        text = "".join(draw.choice(draw.choice(alphabets)) for _ in range(draw.randint(0, 40)))
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_long_pieces_take_linear_time(pair):
    own, other = pair
    for text in ("a" * 60_000, "ab" * 20_000, " " * 30_000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_rows(spark, odd, pair):
    _, other = pair
    out = bpe.encode_documents(odd).collect()
    texts = [r.text or "" for r in odd.select("text").collect()]
    wanted = sorted(hashlib.sha256(np.array(other.encode_ordinary(t), "<u4").tobytes()).hexdigest() for t in texts)
    assert sorted(r.ids_sha256 for r in out) == wanted
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert all(len(r.ids) == r.n_tokens for r in out)
    assert bpe.encode_documents(odd.limit(0), ids=False).collect() == []
