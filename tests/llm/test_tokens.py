"""op1 and op5 against the libraries that they stand for."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contactloom.llm import byte_bpe, queries, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_vocabulary(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(byte_bpe.read_vocabulary(JSON))


TEXTS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abtheri '\n 0")), max_size=400)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXTS, min_size=1, max_size=6))
def test_codec_equals_library(codec, library, texts):
    ids, bounds = codec.encode(texts)
    data, offsets = codec.decode(ids, bounds)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode_ordinary(text)
        assert data[offsets[k] : offsets[k + 1]].tobytes() == text.encode()


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(TEXTS, TEXTS.map(lambda t: t + "<|endoftext|>" + t)), min_size=1, max_size=6))
def test_counter_equals_library(counter, texts):
    library = Tokenizer.from_file(JSON)
    assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_rows_by_heap_equal_matrix(codec, library):
    for text in ("ab" * 3000, "x" * 2000, "ñ" * 900, "thethe" * 500):
        ids, _ = codec.encode([text])
        assert ids.tolist() == library.encode_ordinary(text)


def test_unordered_merges_go_one_by_one(counter):
    pieces = [b"abababab", b"aaaa", b"thethethe"]
    together = counter.count_pieces(pieces).tolist()
    counter.ordered = False
    try:
        assert counter.count_pieces(pieces).tolist() == together
    finally:
        counter.ordered = True


def test_op1(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, sf_dir).collect()}
    for r in docs:
        ids = np.array(library.encode_ordinary(r.text), "<u4")
        own = got[r.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_op5(spark, sf_dir):
    library = Tokenizer.from_file(JSON)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op5_token_counts(spark, sf_dir).collect()}
    for r in docs:
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 1024)


def test_odd_rows(odd_docs, library):
    clashing = odd_docs.withColumn("IDS", F.lit(1)).withColumn("n_Tokens", F.lit("x"))
    for r in byte_bpe.round_trip(clashing, RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    apart = byte_bpe.decode(byte_bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in apart.collect())
    counted = token_counts.count_tokens(clashing, JSON)
    assert counted.columns.count("n_tokens") == 1 and counted.count() == odd_docs.count()


def test_empty_table(no_docs):
    assert byte_bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(no_docs, JSON).count() == 0
