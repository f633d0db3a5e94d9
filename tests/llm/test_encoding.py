import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from fotoloom.llm.encoding import default_vocabulary, encode_corpus, encoder, merge_word, token_counts


@pytest.fixture(scope="module")
def others():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), t


ODD = [
    "a\x1cb \x1d\x85c\n\n \x1fd", "  \n 　x\n\ny​ \n", " \x1c\x1c  x", "x\r\n\r\ny\x0b\x0cz", "A" * 5000 + " " * 3000 + "=" * 7777, "½²Ⅷ٣x", "\n\n\n", "\n a", "a \n", "'s't 'll I'll it's",
    "ab\n\x1cfoo", "ab\n\n\x1ffoo\n\x85", "<|endoftext|>a<|endoftext|>", "", " ", "🙂‍↔️ é‍", "﻿word\xadbreak", "日本語のテキスト\n한국어\n\n  العربية", " x \ny",
]


def test_odd_texts(others):
    _, tk, hf = others
    mine = encoder(default_vocabulary())
    for text in ODD:
        assert mine.encode(text) == tk.encode_ordinary(text) == hf.encode(text, add_special_tokens=False).ids, repr(text)[:60]


def test_random_texts(others):
    _, tk, _ = others
    mine, rng = encoder(default_vocabulary()), random.Random(1)
    alphabet = "ab Z'sl1٣²\n\r\t \x1c\x85 {}|=é日🙂́_-."
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert mine.encode(text) == tk.encode_ordinary(text), repr(text)


def test_every_entry_is_what_its_bytes_merge_to(others):
    ranks = others[0]
    assert all(merge_word(w, ranks) == [r] for w, r in ranks.items())


def test_round_trip_of_the_documents(spark, small, others):
    _, tk, _ = others
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.ids for r in encode_corpus(docs, "doc_id", "text").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got == {k: tk.encode_ordinary(t) for k, t in texts.items()}
    assert all(tk.decode(got[k]) == t for k, t in texts.items())
    assert {r.doc_id: r.tokens for r in token_counts(docs, "doc_id", "text", "source").collect()} == {k: len(v) for k, v in got.items()}


def test_nulls_repetitions_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a a", 0), (3, "a a", 0), (None, "a", 0)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.ids) for r in encode_corpus(df, "doc_id", "text").collect())
    assert got[1:3] == [(1, []), (2, [])] and got[3] == got[4] and len(got[0][1]) == 1
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
