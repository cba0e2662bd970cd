import os
import random

import pytest

from tidemark.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.default_vocabulary()), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})


def test_like_reference_on_odd_texts(spark, reference):
    r = random.Random(1)
    alphabet = "abcdeeeaaa thein  \n\tABé日本語🙂ñ0123--==__..​\x07"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 200))) for _ in range(400)]
    texts += ["<|endoftext|>", " ", "\r\n\r\n", "a" * 30_000, "ab" * 9_000, "日本" * 5_000, "=-" * 5_000, " " * 3_000]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {x.doc_id: x.ids for x in bpe.token_ids(rows, "doc_id", "text").collect()}
    assert all(got[i] == reference.encode_ordinary(t) for i, t in enumerate(texts))


def test_null_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a")], "doc_id long, text string")
    got = bpe.token_ids(rows, "doc_id", "text").collect()
    assert len(got) == 5 and [x.ids for x in got if x.doc_id in (1, 2)] == [[], []]
    assert bpe.token_ids(rows.limit(0), "doc_id", "text").count() == 0


def test_corpus_and_other_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    for x in bpe.token_ids(docs, "doc_id", "text").collect():
        assert x.ids == (t.encode(texts[x.doc_id], add_special_tokens=False).ids if texts[x.doc_id] else [])


def test_every_token_is_its_own_encoding():
    ranks = bpe.read_ranks(bpe.default_vocabulary())
    e = bpe.encoder(bpe.default_vocabulary(), bpe.default_pattern())
    wrong = [t for t, i in list(ranks.items())[::7] if e._encode(t.decode("latin-1")) != (i,)]
    assert wrong == []
